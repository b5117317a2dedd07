"""Registered queries: interval and time joins (J1-J8, J12-J18, J24), segments and intervals
(W5-W7, W14, W15), their metrics (A4-A6) and set operations (U1-U5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronotrace.operators import intervals as iv
from chronotrace.operators import metrics as m
from chronotrace.operators.ordered import Lane, join_on
from chronotrace.plans import views as v
from chronotrace.plans.registry import query

K = ("video_id", "entity_id")


@query("j01_segments_with_annotations", "SELECT s.video_id, seg_idx, coalesce(n, 0) AS n_intervals, n IS NOT NULL AS annotated FROM segs s LEFT JOIN (SELECT video_id, count(*) AS n FROM ann GROUP BY ALL) USING (video_id)", "segs ann")
def segments_with_annotations(spark, d):
    n = v.ann(spark, d).groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))
    j = join_on(v.segs(spark, d), n, ("video_id",), "left")
    return j.select("video_id", "seg_idx", F.coalesce("n", F.lit(0)).alias("n_intervals"), F.col("n").isNotNull().alias("annotated"))


@query("j02_file_index_lookup", "SELECT d.doc_id, coalesce(CASE WHEN l.doc_id IS NOT NULL THEN 'labels/'||l.doc_id END, '') AS path FROM documents d LEFT JOIN labels l USING (doc_id)")
def file_index(spark, d):
    idx = v.table(spark, d, "labels").select("doc_id", F.concat(F.lit("labels/"), F.col("doc_id").cast("string")).alias("path"))
    return join_on(v.table(spark, d, "documents").select("doc_id"), idx, ("doc_id",), "left").select("doc_id", F.coalesce("path", F.lit("")).alias("path"))


@query("j03_target_semi_join", "SELECT video_id, iv_idx FROM ann WHERE video_id IN (SELECT video_id FROM segs WHERE score > 0.25)", "ann segs")
def target_semi(spark, d):
    return join_on(v.ann(spark, d), v.segs(spark, d).filter("score > 0.25"), ("video_id",), "left_semi").select("video_id", "iv_idx")


@query("j04_unannotated_anti_join", "SELECT doc_id, 'annotated' AS kind FROM labels UNION ALL SELECT doc_id, 'normal' FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND lang = 'en'")
def unannotated(spark, d):
    lab = v.table(spark, d, "labels").select("doc_id")
    rest = join_on(v.table(spark, d, "documents").filter("lang = 'en'").select("doc_id"), lab, ("doc_id",), "left_anti")
    return lab.withColumn("kind", F.lit("annotated")).unionByName(rest.withColumn("kind", F.lit("normal")))


OVERLAP = """ov AS (SELECT s.video_id, s.seg_idx, s.start_frame, s.end_frame, coalesce(sum(least(s.end_frame, a.e) - greatest(s.start_frame, a.s) + 1), 0) AS overlap
FROM segs s LEFT JOIN ann a ON a.video_id = s.video_id AND s.start_frame <= a.e AND a.s <= s.end_frame GROUP BY ALL)"""


@query("j05_interval_overlap", f"WITH {OVERLAP} SELECT video_id, seg_idx, CAST(overlap AS BIGINT) AS overlap, round(overlap / (end_frame - start_frame + 1), 9) AS overlap_ratio, overlap > 0 AS contains_anomaly FROM ov", "segs ann")
def interval_overlap(spark, d):
    o = iv.overlap_totals(v.segs(spark, d), v.ann(spark, d))
    return o.select("video_id", "seg_idx", "overlap", F.round("overlap_ratio", 9).alias("overlap_ratio"), "contains_anomaly")


NEAREST = """bp AS (SELECT video_id, start_frame AS b FROM segs UNION ALL SELECT video_id, end_frame FROM segs),
pr AS (SELECT video_id, iv_idx, 'start' AS kind, s AS p FROM ann UNION ALL SELECT video_id, iv_idx, 'end', e FROM ann),
near AS (SELECT pr.video_id, iv_idx, kind, min(abs(b - p)) / CAST(30 AS DOUBLE) AS err FROM pr JOIN bp USING (video_id) GROUP BY ALL)"""


def _boundary_errors(spark, d):
    s = v.segs(spark, d)
    pts = s.select("video_id", F.col("start_frame").alias("b")).unionByName(s.select("video_id", F.col("end_frame").alias("b"))).withColumn("ord", F.col("b"))
    a = v.ann(spark, d)
    pr = a.select("video_id", "iv_idx", F.lit("start").alias("kind"), F.col("s").alias("p")).unionByName(a.select("video_id", "iv_idx", F.lit("end").alias("kind"), F.col("e").alias("p")))
    return iv.nearest_point(pr, pts, ("video_id",), "p", "b", "ord", []).withColumn("err", F.col("distance") / v.FPS)


@query("j06_nearest_boundary", f"WITH {NEAREST} SELECT video_id, iv_idx, kind, round(err, 9) AS err, err < 1.0 AS detected FROM near", "segs ann")
def nearest_boundary(spark, d):
    return _boundary_errors(spark, d).select("video_id", "iv_idx", "kind", F.round("err", 9).alias("err"), (F.col("err") < 1.0).alias("detected"))


@query("a05_boundary_error_summary", f"WITH {NEAREST} SELECT round(avg(err), 7) AS mean_error, round(median(err), 9) AS median_error, round(avg(CAST(err < 1 AS INT)), 9) AS rate, round(avg(CAST(err < 1 AS INT)) FILTER (kind = 'start'), 9) AS start_rate, round(avg(CAST(err < 1 AS INT)) FILTER (kind = 'end'), 9) AS end_rate, count(*) AS n FROM near", "segs ann")
def boundary_summary(spark, d):
    s = m.error_summary(_boundary_errors(spark, d), "err", "kind")
    return s.select(F.round("mean_error", 7).alias("mean_error"), *[F.round(c, 9).alias(c) for c in ("median_error", "rate", "start_rate", "end_rate")], "n")


COVER = """segs2 AS (SELECT video_id, seg_idx, start_frame + 400 AS start_frame, end_frame - 300 + (seg_idx % 3) * 900 AS end_frame FROM segs),
fr AS (SELECT DISTINCT a.video_id, a.iv_idx, f.f FROM ann a JOIN segs2 s ON a.video_id = s.video_id AND a.s <= s.end_frame AND s.start_frame <= a.e,
 LATERAL (SELECT unnest(range(greatest(a.s, s.start_frame), least(a.e, s.end_frame) + 1)) AS f) f),
cn AS (SELECT a.video_id, a.iv_idx, count(s.seg_idx) AS fragments FROM ann a LEFT JOIN segs2 s ON a.video_id = s.video_id AND a.s <= s.end_frame AND s.start_frame <= a.e GROUP BY ALL),
cv AS (SELECT a.video_id, a.iv_idx, count(f) / CAST(any_value(a.e - a.s + 1) AS DOUBLE) AS coverage, any_value(fragments) AS fragments FROM ann a JOIN cn USING (video_id, iv_idx) LEFT JOIN fr USING (video_id, iv_idx) GROUP BY a.video_id, a.iv_idx)"""


def _coverage(spark, d):
    s = v.segs(spark, d).select("video_id", "seg_idx", (F.col("start_frame") + 400).alias("start_frame"), (F.col("end_frame") - 300 + F.col("seg_idx") % 3 * 900).alias("end_frame"))
    return iv.coverage(v.ann(spark, d), s)


@query("j07_coverage", f"WITH {COVER} SELECT video_id, iv_idx, round(coverage, 9) AS coverage, fragments FROM cv", "segs ann")
def coverage(spark, d):
    return _coverage(spark, d).withColumn("coverage", F.round("coverage", 9))


@query("a06_coverage_summary", f"WITH {COVER} SELECT round(avg(coverage), 9) AS mean_coverage, round(median(coverage), 9) AS median_coverage, round(avg(CAST(coverage >= 0.99 AS INT)), 9) AS full_rate, round(avg(fragments) FILTER (fragments > 0), 9) AS mean_fragments, count(*) AS n FROM cv", "segs ann")
def coverage_summary(spark, d):
    return m.coverage_summary(_coverage(spark, d)).select(*[F.round(c, 9).alias(c) for c in ("mean_coverage", "median_coverage", "full_rate", "mean_fragments")], "n")


@query("u03_covered_frames_union", f"WITH {COVER} SELECT video_id, iv_idx, CAST(count(*) AS BIGINT) AS covered FROM fr GROUP BY ALL", "segs ann")
def covered_union(spark, d):
    c = join_on(_coverage(spark, d), v.ann(spark, d), ("video_id", "iv_idx"))
    return c.filter("coverage > 0").select("video_id", "iv_idx", F.rint(F.col("coverage") * (F.col("e") - F.col("s") + 1)).cast("long").alias("covered"))


@query("j08_nearest_in_time", """SELECT video_id, entity_id, arg_min(n.event_id, (abs(n.t - b.break_ts), n.event_id)) AS event_id, round(min(abs(n.t - b.break_ts)), 9) AS distance
FROM verdicts b JOIN nodes n USING (video_id, entity_id) GROUP BY ALL""", "nodes verdicts")
def nearest_in_time(spark, d):
    n = v.nodes(spark, d).select(*K, "t", "event_id")
    r = iv.nearest_point(v.verdicts(spark, d).select(*K, "break_ts"), n, K, "break_ts", "t", "event_id", [])
    return r.select(*K, "event_id", F.round("distance", 9).alias("distance"))


@query("j12_energies_around_time", "SELECT v.video_id, v.entity_id, count(*) AS n, round(sum(o.energy), 9) AS e FROM verdicts v JOIN obs o ON o.video_id = v.video_id AND o.t BETWEEN v.break_ts - 2 AND v.break_ts + 2 GROUP BY ALL", "obs verdicts")
def energies_around(spark, d):
    p = v.obs(spark, d).select("video_id", "t", "energy")
    r = iv.range_totals(v.verdicts(spark, d).select(*K, "break_ts"), p, ("video_id",), ("entity_id",), "t", F.col("break_ts") - 2, F.col("break_ts") + 2, 12.0, {"e": F.col("energy")}, "n")
    return r.filter("n > 0").select(*K, "n", F.round("e", 9).alias("e"))


@query("j13_path_node_frame_energy", "SELECT n.event_id, round(fe.e, 9) AS frame_energy FROM nodes n LEFT JOIN (SELECT video_id, frame_idx, max(energy) AS e FROM obs GROUP BY ALL) fe USING (video_id, frame_idx)", "obs nodes")
def path_frame_energy(spark, d):
    fe = v.obs(spark, d).groupBy("video_id", "frame_idx").agg(F.round(F.max("energy"), 9).alias("frame_energy"))
    return join_on(v.nodes(spark, d), fe, ("video_id", "frame_idx"), "left").select("event_id", "frame_energy")


@query("j14_manifest_with_scores", "SELECT s.video_id, s.seg_idx, coalesce(x.score, -1.0) AS score FROM segs s LEFT JOIN (SELECT video_id, seg_idx, score FROM segs WHERE score > 0.24) x USING (video_id, seg_idx)", "segs")
def manifest_scores(spark, d):
    s = v.segs(spark, d)
    return join_on(s.select("video_id", "seg_idx"), s.filter("score > 0.24").select("video_id", "seg_idx", "score"), ("video_id", "seg_idx"), "left").withColumn("score", F.coalesce("score", F.lit(-1.0)))


@query("j15_graphs_with_verdicts", "SELECT g.video_id, g.entity_id, g.n, coalesce(v.is_anomaly, false) AS is_anomaly, coalesce(v.confidence, 0.0) AS confidence FROM (SELECT video_id, entity_id, count(*) AS n FROM nodes GROUP BY ALL) g LEFT JOIN verdicts v USING (video_id, entity_id)", "nodes verdicts")
def graphs_with_verdicts(spark, d):
    g = v.nodes(spark, d).groupBy(*K).agg(F.count(F.lit(1)).alias("n"))
    ver = v.verdicts(spark, d).select(*K, "is_anomaly", "confidence")
    return join_on(g, ver, K, "left").withColumns({"is_anomaly": F.coalesce("is_anomaly", F.lit(False)), "confidence": F.coalesce("confidence", F.lit(0.0))})


@query("j16_time_probe", """WITH pr AS (SELECT video_id, CAST(floor(break_ts) AS BIGINT) AS probe_t FROM verdicts GROUP BY ALL),
hit AS (SELECT p.video_id, probe_t, o.entity_id, arg_min(o.event_id, (o.frame_idx, o.event_id)) AS event_id FROM pr p JOIN obs o ON o.video_id = p.video_id AND abs(o.frame_idx - probe_t * 30) <= 6 GROUP BY ALL),
act AS (SELECT h.video_id, probe_t, h.entity_id, arg_min(n.action, (n.t, n.event_id)) AS action FROM hit h JOIN nodes n ON n.video_id = h.video_id AND n.entity_id = h.entity_id AND n.t > probe_t - 2 AND n.t < probe_t + 2 GROUP BY ALL)
SELECT video_id, probe_t, entity_id, event_id, coalesce(action, 'unknown') AS action FROM hit LEFT JOIN act USING (video_id, probe_t, entity_id)""", "obs nodes verdicts")
def time_probe(spark, d):
    pr = v.verdicts(spark, d).select("video_id", F.floor("break_ts").cast("long").alias("probe_t")).distinct()
    tol = max(int(v.FPS * 0.2), 2)
    o = v.obs(spark, d).select("video_id", "entity_id", "frame_idx", "event_id")
    hit = iv.points_in_intervals(o, pr, ("video_id",), "frame_idx", F.col("probe_t") * v.FPS - tol, F.col("probe_t") * v.FPS + tol, 360.0)
    hit = hit.groupBy("video_id", "probe_t", "entity_id").agg(F.min_by("event_id", F.struct("frame_idx", "event_id")).alias("event_id"))
    n = v.nodes(spark, d).select(*K, F.col("t").alias("nt"), F.col("event_id").alias("ne"), "action")
    act = iv.points_in_intervals(n, hit.select(*K, "probe_t"), K, "nt", F.col("probe_t") - 2.0, F.col("probe_t") + 2.0, 12.0, lambda t: (t > F.col("probe_t") - 2) & (t < F.col("probe_t") + 2))
    act = act.groupBy("video_id", "probe_t", "entity_id").agg(F.min_by("action", F.struct("nt", "ne")).alias("action"))
    return join_on(hit, act, ("video_id", "probe_t", "entity_id"), "left").withColumn("action", F.coalesce("action", F.lit("unknown")))


BINS = """b AS (SELECT video_id, CAST(i AS BIGINT) AS bin, i * (secs / CAST(200 AS DOUBLE)) AS t0, (i + 1) * (secs / CAST(200 AS DOUBLE)) AS t1 FROM recs, range(200) r(i)),
h AS (SELECT b.video_id, bin, arg_min(CASE WHEN confidence >= 0.7 THEN 'danger' ELSE 'warning' END, entity_id) AS level FROM b JOIN verdicts x ON x.video_id = b.video_id AND x.is_anomaly AND x.start_sec < b.t1 AND x.end_sec > b.t0 GROUP BY ALL)"""


@query("j17_time_bins", f"WITH {BINS} SELECT b.video_id, b.bin, coalesce(level, 'normal') AS level FROM b LEFT JOIN h USING (video_id, bin)", "verdicts recs")
def time_bins(spark, d):
    ver = v.verdicts(spark, d)
    w = F.col("seconds") / 200
    b = v.recordings(spark, d).select("video_id", "seconds", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(199).cast("long"))).alias("bin"))
    b = b.withColumn("t0", F.col("bin") * w).withColumn("t1", (F.col("bin") + 1) * w)
    x = ver.filter("is_anomaly").select("video_id", "entity_id", "confidence", "start_sec", "end_sec")
    hit = iv.overlaps(b, x, ("video_id",), ("t0", "t1"), ("start_sec", "end_sec"), 36.0).filter("start_sec < t1 and end_sec > t0")
    lev = hit.groupBy("video_id", "bin").agg(F.min_by(F.when(F.col("confidence") >= 0.7, "danger").otherwise("warning"), "entity_id").alias("level"))
    return join_on(b.select("video_id", "bin"), lev, ("video_id", "bin"), "left").withColumn("level", F.coalesce("level", F.lit("normal")))


@query("j24_in_and_near_interval_stats", """WITH z AS (SELECT o.video_id, a.iv_idx, o.frame_idx BETWEEN a.s AND a.e AS inside, energy FROM ann a JOIN obs o ON o.video_id = a.video_id AND o.frame_idx BETWEEN a.s - 100 AND a.e + 100)
SELECT video_id, iv_idx, count(*) FILTER (inside) AS n_in, count(*) FILTER (NOT inside) AS n_near, round(avg(energy) FILTER (inside), 9) AS mean_in, round(max(energy) FILTER (NOT inside), 9) AS max_near FROM z GROUP BY ALL""", "obs ann")
def in_and_near(spark, d):
    o = v.obs(spark, d).select("video_id", "frame_idx", "energy")
    key, ids, s, e = ("video_id",), ("iv_idx",), F.col("s"), F.col("e")
    inside = iv.range_totals(v.ann(spark, d).select("video_id", "iv_idx", "s", "e"), o, key, ids, "frame_idx", s, e, 720.0, {"e_in": F.col("energy")}, "n_in")
    around = iv.range_totals(inside, o, key, ids, "frame_idx", s - 100, e + 100, 720.0, count="n_all").filter("n_all > 0")
    left = iv.range_maxima(around, o, key, ids, "frame_idx", s - 100, s - 1, 720.0, "energy", "max_left")
    both = iv.range_maxima(left, o, key, ids, "frame_idx", e + 1, e + 100, 720.0, "energy", "max_right")
    return both.select("video_id", "iv_idx", "n_in", (F.col("n_all") - F.col("n_in")).alias("n_near"), F.round(F.col("e_in") / F.when(F.col("n_in") > 0, F.col("n_in")), 9).alias("mean_in"), F.round(F.greatest("max_left", "max_right"), 9).alias("max_near"))


@query("a04_segment_stats", f"WITH {OVERLAP}, x AS (SELECT 'c'||seg_idx % 4 AS category, overlap > 0 AS c, overlap / CAST(end_frame - start_frame + 1 AS DOUBLE) AS r FROM ov) SELECT category, count(*) AS total_segments, count(*) FILTER (c) AS anomaly_segments, count(*) FILTER (NOT c) AS normal_segments, round(coalesce(avg(r) FILTER (c), 0), 9) AS avg_anomaly_overlap, round(count(*) FILTER (c) / CAST(count(*) AS DOUBLE), 9) AS anomaly_ratio FROM x GROUP BY ALL", "segs ann")
def segment_stats(spark, d):
    o = iv.overlap_totals(v.segs(spark, d), v.ann(spark, d)).withColumn("category", F.concat(F.lit("c"), (F.col("seg_idx") % 4).cast("string")))
    s = m.segment_stats(o, "category")
    return s.withColumns({c: F.round(c, 9) for c in ("avg_anomaly_overlap", "anomaly_ratio")})


CLOSE = """pts AS (SELECT video_id, frame_idx, event_id FROM obs WHERE danger >= 0.3),
fl AS (SELECT *, CASE WHEN frame_idx - lag(frame_idx) OVER w < 60 THEN 0 ELSE 1 END AS b FROM pts WINDOW w AS (PARTITION BY video_id ORDER BY frame_idx, event_id)),
g AS (SELECT video_id, frame_idx, sum(b) OVER (PARTITION BY video_id ORDER BY frame_idx, event_id ROWS UNBOUNDED PRECEDING) AS r FROM fl),
mg AS (SELECT video_id, max(frame_idx) AS frame_idx FROM g GROUP BY video_id, r)"""
POINT_LANE = Lane(("video_id",), ("frame_idx", "event_id"), 720)


def _merged_points(spark, d):
    pts = v.obs(spark, d).filter("danger >= 0.3").select("video_id", "frame_idx", "event_id")
    return iv.merge_close_points(pts, POINT_LANE, 60)


@query("w05_merge_close_points", f"WITH {CLOSE} SELECT video_id, frame_idx FROM mg", "obs")
def merge_close(spark, d):
    return _merged_points(spark, d)


SPANS = CLOSE + """, sp AS (SELECT * FROM (SELECT video_id, greatest(0, frame_idx / CAST(30 AS DOUBLE)) AS s, least(coalesce(lead(frame_idx) OVER (PARTITION BY video_id ORDER BY frame_idx) / CAST(30 AS DOUBLE), frame_idx / CAST(30 AS DOUBLE) + 2.0), CAST(secs AS DOUBLE)) AS e FROM mg JOIN recs USING (video_id)) WHERE e > s)"""


def _spans(spark, d):
    pts = join_on(_merged_points(spark, d), v.recordings(spark, d).select("video_id", "seconds"), ("video_id",))
    return iv.points_to_intervals(pts, Lane(("video_id",), ("frame_idx",), 720), 2.0, F.col("seconds").cast("double"), v.FPS)


@query("w06_points_to_intervals", f"WITH {SPANS} SELECT video_id, round(s, 9) AS start_sec, round(e, 9) AS end_sec FROM sp", "obs recs")
def points_to_intervals(spark, d):
    return _spans(spark, d).select("video_id", F.round("start_sec", 9).alias("start_sec"), F.round("end_sec", 9).alias("end_sec"))


@query("w07_segment_gap_fill", f"""WITH {SPANS}, vids AS (SELECT video_id, total_frames AS n FROM recs),
fr AS (SELECT video_id, CAST(round_even(s * 30, 0) AS BIGINT) AS a, least(CAST(round_even(e * 30, 0) AS BIGINT), n - 1) AS b FROM sp JOIN vids USING (video_id)), k AS (SELECT * FROM fr WHERE b - a > 1),
e AS (SELECT v.video_id, v.n, min(fr.a) FILTER (fr.b - fr.a > 1) AS f, max(fr.b) FILTER (fr.b - fr.a > 1) AS l FROM vids v LEFT JOIN fr USING (video_id) GROUP BY ALL)
SELECT video_id, a AS start_frame, b AS end_frame FROM k UNION ALL SELECT video_id, 0, f FROM e WHERE f > 0 UNION ALL SELECT video_id, coalesce(l, 0), n - 1 FROM e WHERE coalesce(l, 0) < n - 1""", "obs recs")
def gap_fill(spark, d):
    return iv.fill_gaps(_spans(spark, d), v.recordings(spark, d).select("video_id", "total_frames"), v.FPS)


@query("w14_merge_intervals", """WITH x AS (SELECT * FROM verdicts WHERE is_anomaly), r AS (SELECT *, max(end_sec) OVER (PARTITION BY video_id ORDER BY start_sec, entity_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM x),
g AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_sec > reach + 4.0 THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY start_sec, entity_id ROWS UNBOUNDED PRECEDING) AS gid FROM r)
SELECT video_id, CAST(gid AS BIGINT) AS group_id, round(min(start_sec), 5) AS start_sec, round(max(end_sec), 5) AS end_sec, max(confidence) AS confidence, count(*) AS n, arg_min(entity_id, (start_sec, entity_id)) AS first_entity FROM g GROUP BY video_id, gid""", "verdicts")
def merge_intervals(spark, d):
    x = v.verdicts(spark, d).filter("is_anomaly")
    g = iv.merge_intervals(x, ("video_id",), "start_sec", "end_sec", "entity_id", 4.0, 24.0, [
        F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("n"), F.min_by("entity_id", F.struct("start_sec", "entity_id")).alias("first_entity")])
    return g.withColumns({"start_sec": F.round("start_sec", 5), "end_sec": F.round("end_sec", 5)})


@query("w15_cluster_points", """WITH p AS (SELECT video_id, t, event_id, danger + least(0.3, 0.08 * CAST(suspicious AS INT)) + energy / 100 AS sc FROM obs WHERE danger >= 0.45),
b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY video_id ORDER BY t, event_id) <= 3.0 THEN 0 ELSE 1 END AS nb FROM p), c AS (SELECT *, sum(nb) OVER (PARTITION BY video_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS cl FROM b),
g AS (SELECT video_id, cl, min(t) AS t0, max(t) AS t1, sum(sc) AS total, count(*) AS n, arg_min(t, (-sc, t)) AS peak FROM c GROUP BY ALL)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY round(total, 9) DESC, t0) AS rank, round(greatest(0.0, t0 - 1), 9) AS start_sec, round(t1 + 1, 9) AS end_sec, round(total, 9) AS total, n, round(peak, 9) AS peak FROM g QUALIFY rank <= 3""", "obs")
def cluster_points(spark, d):
    o = v.obs(spark, d).filter("danger >= 0.45")
    sc = F.col("danger") + F.least(F.lit(0.3), 0.08 * F.col("suspicious").cast("int")) + F.col("energy") / 100
    c = iv.cluster_points(o.select("video_id", "t", "event_id", "danger", "suspicious", "energy"), v.OBS_LANE, 3.0, sc, 3, 1.0)
    return c.withColumns({x: F.round(x, 9) for x in ("start_sec", "end_sec", "total", "peak")})


@query("u01_union_of_strata", "SELECT doc_id, 'anomalous' AS stratum FROM scored WHERE gt = 1 UNION ALL SELECT doc_id, 'normal' FROM scored WHERE gt = 0 AND quality = 1", "scored")
def union_of_strata(spark, d):
    s = v.scored(spark, d)
    return s.filter("gt = 1").select("doc_id", F.lit("anomalous").alias("stratum")).unionByName(s.filter("gt = 0 and quality = 1").select("doc_id", F.lit("normal").alias("stratum")))


@query("u02_catalogue_union", "SELECT doc_id, bool_or(a) AS has_label, bool_or(b) AS is_english, bool_or(c) AS is_long FROM (SELECT doc_id, true AS a, false AS b, false AS c FROM labels UNION ALL SELECT doc_id, false, true, false FROM documents WHERE lang = 'en' UNION ALL SELECT doc_id, false, false, true FROM documents WHERE n_chars > 2000) GROUP BY ALL")
def catalogue_union(spark, d):
    docs = v.table(spark, d, "documents")

    def flag(df, i):
        return df.select("doc_id", *[F.lit(i == j).alias(n) for j, n in enumerate(("has_label", "is_english", "is_long"))])

    u = flag(v.table(spark, d, "labels"), 0).unionByName(flag(docs.filter("lang = 'en'"), 1)).unionByName(flag(docs.filter("n_chars > 2000"), 2))
    return u.groupBy("doc_id").agg(*[F.bool_or(c).alias(c) for c in ("has_label", "is_english", "is_long")])


@query("u04_pending_difference", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def pending(spark, d):
    return join_on(v.table(spark, d, "documents").select("doc_id").distinct(), v.table(spark, d, "labels").select("doc_id"), ("doc_id",), "left_anti")


@query("u05_common_records", "SELECT doc_id FROM runs WHERE run = 'old' AND pred = 1 INTERSECT SELECT doc_id FROM runs WHERE run = 'new' AND n_entities > 2", "runs")
def common(spark, d):
    r = v.runs(spark, d)
    return r.filter("run = 'old' and pred = 1").select("doc_id").intersect(r.filter("run = 'new' and n_entities > 2").select("doc_id"))
