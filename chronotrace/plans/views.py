"""Standard views: how the given tables play the roles of the engine's data model.

Every view exists twice, as a DataFrame and as SQL text, so that a registered query and
its check read the same rows. One hour of the ``events`` clock stands for one second of
recording time and 30 frames make one such second, so ``frame_idx`` is integer arithmetic
on the timestamp and needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotrace.operators.ordered import Lane, islands, join_on, number_rows

FPS = 30
EPOCH_US = 1704067200000000  # 2024-01-01T00:00:00Z

OBS_LANE = Lane(("video_id",), ("t", "event_id"), 1.0)
ENTITY_LANE = Lane(("video_id", "entity_id"), ("t", "event_id"), 1.0)
FRAME_LANE = Lane(("video_id",), ("frame_idx",), 4096)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _danger() -> F.Column:
    e = F.col("event_type")
    return (
        F.when(e == "error", 0.7)
        .when(e == "purchase", 0.3)
        .when(e == "signup", 0.15)
        .when(e == "click", 0.05)
        .otherwise(0.0)
    )


def obs(spark: SparkSession, d: str) -> DataFrame:
    """Observation log: one row per entity sighting."""
    us = F.unix_micros(F.col("ts").cast("timestamp")) - F.lit(EPOCH_US)
    return (
        table(spark, d, "events")
        .withColumn("us", us)
        .select(
            "event_id",
            F.floor(F.col("user_id") / 15).cast("long").alias("video_id"),
            F.col("user_id").alias("entity_id"),
            F.floor(F.col("us") / 120000000).cast("long").alias("frame_idx"),
            (F.col("us") / F.lit(3.6e9)).alias("t"),
            (F.col("value") / F.lit(499.0)).alias("energy"),
            F.col("event_type").alias("action"),
            (F.col("event_type") == "error").alias("suspicious"),
            _danger().alias("danger"),
            (F.col("event_id") * 37 % 600).alias("x"),
            (F.col("event_id") * 53 % 400).alias("y"),
            (F.col("event_id") % 60 + 40).alias("w"),
            (F.col("event_id") * 7 % 80 + 40).alias("h"),
            F.get_json_object("props", "$.k").cast("long").alias("k"),
        )
    )


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Semantic observations: every sighting that is not a plain view."""
    return obs(spark, d).filter("action <> 'view'")


def recordings(spark: SparkSession, d: str) -> DataFrame:
    """Every recording and its length, from its last sighting: whole seconds and frames."""
    g = obs(spark, d).groupBy("video_id")
    return g.agg((F.floor(F.max("t")) + 1).cast("long").alias("seconds"), (F.max("frame_idx") + 1).alias("total_frames"))


def vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", F.col("embedding").alias("vec"))


def obs_vec(spark: SparkSession, d: str) -> DataFrame:
    """Sightings with a vector each: all vectors take turns."""
    e = vectors(spark, d)
    o = obs(spark, d).withColumn("vec_id", F.col("event_id") % e.agg(F.count(F.lit(1))).scalar())
    return o.join(e, "vec_id").drop("vec_id")


def frames(spark: SparkSession, d: str) -> DataFrame:
    """Feature rows: label = recording, dense frame index by vec_id."""
    e = table(spark, d, "embeddings").select(F.col("label").cast("long").alias("video_id"), "vec_id", "embedding")
    e = number_rows(e, Lane(("video_id",), ("vec_id",), 4096), "pos")
    return e.select(
        "video_id",
        (F.col("pos") - 1).alias("frame_idx"),
        "vec_id",
        F.slice("embedding", 1, 48).alias("app"),
        F.slice("embedding", 49, 16).alias("mot"),
        F.col("embedding").alias("feat"),
    )


def ann(spark: SparkSession, d: str) -> DataFrame:
    """Ground-truth intervals: runs of error rows at most 2 s apart, widened by half a second."""
    e = obs(spark, d).filter("suspicious").select("video_id", "t", "event_id")
    e = islands(e, OBS_LANE, {"t": F.col("t")}, lambda p, c: c["t"] - p["t"] > 2.0, "iv_idx")
    g = e.groupBy("video_id", "iv_idx").agg(F.min("t").alias("t0"), F.max("t").alias("t1"))
    return g.select(
        "video_id",
        F.col("iv_idx").cast("long").alias("iv_idx"),
        F.greatest(F.lit(0), F.floor((F.col("t0") - 0.5) * FPS)).cast("long").alias("s"),
        F.floor((F.col("t1") + 0.5) * FPS).cast("long").alias("e"),
    )


def segs(spark: SparkSession, d: str) -> DataFrame:
    """Segments: the frames covered in each of 12 equal stretches of a recording."""
    o = obs(spark, d).select("video_id", "frame_idx", F.floor(F.col("t") / 60).cast("long").alias("seg_idx"), "energy", "danger")
    return o.groupBy("video_id", "seg_idx").agg(
        F.min("frame_idx").alias("start_frame"),
        F.max("frame_idx").alias("end_frame"),
        F.round(F.avg("danger"), 6).alias("score"),
    )


def verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Per-entity verdict from the error rows: strongest one is the centre of the interval."""
    e = obs(spark, d).filter("suspicious")
    g = e.groupBy("video_id", "entity_id").agg(
        F.sum("energy").alias("sum_e"),
        F.max("energy").alias("max_e"),
        F.max_by("t", F.struct("energy", "event_id")).alias("peak"),
    )
    return g.select(
        "video_id",
        "entity_id",
        (F.round("sum_e", 6) > 1.2).alias("is_anomaly"),
        F.round(F.least(F.lit(1.0), F.col("max_e") + 0.3), 4).alias("confidence"),
        F.greatest(F.lit(0.0), F.col("peak") - 12.0).alias("start_sec"),
        (F.col("peak") + 12.0).alias("end_sec"),
        F.col("peak").alias("break_ts"),
    )


def scored(spark: SparkSession, d: str) -> DataFrame:
    """Record-level scores against a label: documents joined with their toxicity flag."""
    docs = table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
    lab = table(spark, d, "labels").select("doc_id", F.col("toxic").cast("int").alias("gt"), "quality")
    return join_on(docs, lab, ["doc_id"]).select(
        "doc_id", "source", "lang", "n_chars", "gt", "quality", F.least(F.lit(1.0), F.round(F.col("n_chars") / 8000.0, 3)).alias("score")
    )


def runs(spark: SparkSession, d: str) -> DataFrame:
    """Two runs over the same records, with different thresholds and overlap quality."""
    s = scored(spark, d)
    old = s.select(
        F.lit("old").alias("run"), "doc_id", "source", "lang", "gt", "score", (F.col("score") >= 0.30).cast("int").alias("pred"),
        F.round(F.col("n_chars") % 97 / 97.0, 6).alias("iou"), (F.col("n_chars") % 6).alias("n_entities"),
    )
    new = s.select(
        F.lit("new").alias("run"), "doc_id", "source", "lang", "gt", "score", (F.col("score") >= 0.22).cast("int").alias("pred"),
        F.round(F.col("n_chars") % 89 / 89.0, 6).alias("iou"), (F.col("n_chars") % 7).alias("n_entities"),
    )
    return old.unionByName(new)


_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "obs": (
        (),
        f"""SELECT event_id, user_id // 15 AS video_id, user_id AS entity_id, us // 120000000 AS frame_idx,
        us / CAST(3.6e9 AS DOUBLE) AS t, value / CAST(499.0 AS DOUBLE) AS energy, event_type AS action,
        event_type = 'error' AS suspicious,
        CAST(CASE event_type WHEN 'error' THEN 0.7 WHEN 'purchase' THEN 0.3 WHEN 'signup' THEN 0.15 WHEN 'click' THEN 0.05 ELSE 0.0 END AS DOUBLE) AS danger,
        event_id * 37 % 600 AS x, event_id * 53 % 400 AS y, event_id % 60 + 40 AS w, event_id * 7 % 80 + 40 AS h,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS k
        FROM (SELECT *, epoch_us(ts) - {EPOCH_US} AS us FROM events)""",
    ),
    "nodes": (("obs",), "SELECT * FROM obs WHERE action <> 'view'"),
    "recs": (("obs",), "SELECT video_id, CAST(floor(max(t)) AS BIGINT) + 1 AS secs, max(frame_idx) + 1 AS total_frames FROM obs GROUP BY ALL"),
    "obs_vec": (
        ("obs",),
        "SELECT o.*, CAST(e.embedding AS DOUBLE[]) AS vec FROM obs o JOIN embeddings e ON o.event_id % (SELECT count(*) FROM embeddings) = e.vec_id",
    ),
    "frames": (
        (),
        """SELECT CAST(label AS BIGINT) AS video_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS frame_idx, vec_id,
        CAST(embedding[1:48] AS DOUBLE[]) AS app, CAST(embedding[49:64] AS DOUBLE[]) AS mot, CAST(embedding AS DOUBLE[]) AS feat FROM embeddings""",
    ),
    "ann": (
        ("obs",),
        f"""SELECT video_id, CAST(iv AS BIGINT) AS iv_idx, CAST(greatest(0, floor((min(t) - 0.5) * {FPS})) AS BIGINT) AS s,
        CAST(floor((max(t) + 0.5) * {FPS}) AS BIGINT) AS e FROM (
          SELECT video_id, t, sum(b) OVER (PARTITION BY video_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS iv FROM (
            SELECT video_id, t, event_id, CASE WHEN t - lag(t) OVER (PARTITION BY video_id ORDER BY t, event_id) <= 2.0 THEN 0 ELSE 1 END AS b
            FROM obs WHERE suspicious)) GROUP BY video_id, iv""",
    ),
    "segs": (
        ("obs",),
        """SELECT video_id, CAST(floor(t / 60) AS BIGINT) AS seg_idx, min(frame_idx) AS start_frame, max(frame_idx) AS end_frame,
        round(avg(danger), 6) AS score FROM obs GROUP BY ALL""",
    ),
    "verdicts": (
        ("obs",),
        """SELECT video_id, entity_id, round(sum(energy), 6) > 1.2 AS is_anomaly,
        round(least(CAST(1.0 AS DOUBLE), max(energy) + 0.3), 4) AS confidence,
        greatest(CAST(0.0 AS DOUBLE), arg_max(t, (energy, event_id)) - 12.0) AS start_sec,
        arg_max(t, (energy, event_id)) + 12.0 AS end_sec, arg_max(t, (energy, event_id)) AS break_ts
        FROM obs WHERE suspicious GROUP BY video_id, entity_id""",
    ),
    "scored": (
        (),
        """SELECT d.doc_id, d.source, d.lang, d.n_chars, CAST(l.toxic AS INTEGER) AS gt, l.quality,
        least(CAST(1.0 AS DOUBLE), round(CAST(n_chars AS DOUBLE) / 8000.0, 3)) AS score FROM documents d JOIN labels l USING (doc_id)""",
    ),
    "runs": (
        ("scored",),
        """SELECT 'old' AS run, doc_id, source, lang, gt, score, CAST(score >= 0.30 AS INTEGER) AS pred,
        round(CAST(n_chars % 97 AS DOUBLE) / 97.0, 6) AS iou, n_chars % 6 AS n_entities FROM scored UNION ALL
        SELECT 'new', doc_id, source, lang, gt, score, CAST(score >= 0.22 AS INTEGER), round(CAST(n_chars % 89 AS DOUBLE) / 89.0, 6), n_chars % 7 FROM scored""",
    ),
}


def sql_with(views: str, body: str) -> str:
    """``body`` preceded by the CTEs of the named views and of those they read."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in _SQL[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for v in views.split():
        visit(v)
    ctes = [f"{v} AS ({_SQL[v][1]})" for v in order]
    body = body.strip()
    if body.upper().startswith("WITH RECURSIVE "):
        return "WITH RECURSIVE " + ",\n".join([*ctes, body[15:]])
    if body.upper().startswith("WITH "):
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:] if ctes else body
    return ("WITH " + ",\n".join(ctes) + "\n" if ctes else "") + body

