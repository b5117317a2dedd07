"""Registered queries: sources, sinks and bookkeeping (S1-S19) and name predicates.

File-based operators write rows derived from the given tables into the shared folder with
the matching sink and read them back with the reader under test.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from chronotrace.functions import text as tx
from chronotrace.operators import reporting as rep, sampling as sm
from chronotrace.operators.ordered import Lane, join_on, number_rows
from chronotrace.plans import views as v
from chronotrace.plans.registry import query
from chronotrace.sources import readers as rd, sinks as sk

s = F.col


def _text(*parts):
    return F.concat_ws(" ", *[p.cast("string") for p in parts])


def _ann_lines(spark, d):
    a = v.ann(spark, d)
    e2 = F.when(s("iv_idx") % 3 == 0, -1).otherwise(s("e") + 500)
    cat = F.when(s("iv_idx") % 5 == 0, "Normal").otherwise("Robbery")
    line = F.when(s("iv_idx") % 11 == 0, "short line").otherwise(_text(F.concat(F.lit("v"), s("video_id"), F.lit("_"), s("iv_idx")), cat, s("s"), s("e"), F.when(s("iv_idx") % 3 == 0, -1).otherwise(s("e") + 100), e2))
    return sk.write_lines(a, line, sk.fresh_path(spark, "annotations"))


@query("s01_interval_pairs", "SELECT 'v'||video_id||'_'||iv_idx AS video, CASE WHEN iv_idx % 5 = 0 THEN 'Normal' ELSE 'Robbery' END AS category, iv_idx % 5 > 0 AS is_anomaly, CAST(CASE WHEN iv_idx % 3 = 0 THEN 1 ELSE 2 END AS BIGINT) AS n, CASE WHEN iv_idx % 3 = 0 THEN s||'-'||e ELSE s||'-'||e||','||(e + 100)||'-'||(e + 500) END AS spans FROM ann WHERE iv_idx % 11 > 0", "ann")
def interval_pairs(spark, d):
    r = rd.read_interval_pairs(spark, _ann_lines(spark, d))
    spans = F.array_join(F.transform("intervals", lambda x: F.concat_ws("-", x["s"].cast("string"), x["e"].cast("string"))), ",")
    return r.select("video", "category", "is_anomaly", F.size("intervals").cast("long").alias("n"), spans.alias("spans"))


@query("s02_interval_list", "WITH x AS (SELECT video_id, seg_idx, start_frame AS a, end_frame AS b FROM segs) SELECT 'v'||video_id AS video, count(*) FILTER (a < b) AS n, CAST(sum(a) FILTER (a < b) AS BIGINT) AS total_start FROM x GROUP BY ALL", "segs")
def interval_list(spark, d):
    g = v.segs(spark, d).groupBy("video_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seg_idx", "start_frame", "end_frame"))), lambda x: _text(x["start_frame"], x["end_frame"])), " ").alias("l"))
    p = sk.write_lines(g, F.concat(F.lit("v"), s("video_id"), F.lit(" "), s("l")), sk.fresh_path(spark, "lists"))
    r = rd.read_interval_list(spark, p)
    return r.select("video", F.size("intervals").cast("long").alias("n"), F.aggregate("intervals", F.lit(0).cast("long"), lambda t, x: t + x["s"]).alias("total_start"))


def _seg_path():
    return F.concat(F.lit("/out/v"), s("video_id"), F.lit("_segments/segment_"), s("seg_idx"), F.lit(".mp4"))


@query("s03_segment_manifest", "SELECT '/out/v'||video_id||'_segments/segment_'||seg_idx||'.mp4' AS path, start_frame, end_frame FROM segs", "segs")
def manifest(spark, d):
    p = sk.write_lines(v.segs(spark, d), _text(_seg_path(), s("start_frame"), s("end_frame")), sk.fresh_path(spark, "manifest"))
    return rd.read_manifest(spark, p)


@query("s04_annotated_manifest", "SELECT '/out/v'||video_id||'_segments/segment_'||seg_idx||'.mp4' AS segment_path, start_frame, end_frame, 'Robbery' AS category, score > 0.25 AS contains_anomaly, score AS overlap_ratio FROM segs", "segs")
def annotated_manifest(spark, d):
    x = v.segs(spark, d).select(_seg_path().alias("segment_path"), "start_frame", "end_frame", F.lit("Robbery").alias("category"), (s("score") > 0.25).cast("int").alias("contains_anomaly"), s("score").alias("overlap_ratio"))
    return rd.read_annotated_manifest(spark, sk.write_tsv(x, sk.fresh_path(spark, "annotated")))


@query("s05_scored_manifest", "SELECT '/out/v'||video_id||'_segments/segment_'||seg_idx||'.mp4' AS path, 'v'||video_id||'.mp4' AS video, start_frame, end_frame, score FROM segs", "segs")
def scored_manifest(spark, d):
    p = sk.write_lines(v.segs(spark, d), _text(_seg_path(), s("start_frame"), s("end_frame"), s("score")), sk.fresh_path(spark, "scored"))
    return rd.read_scored_manifest(spark, p)


@query("s06_score_csv", "SELECT CAST(doc_id AS VARCHAR) AS path, CASE WHEN n_chars % 7 = 0 THEN -1.0 ELSE score END AS score, CASE WHEN n_chars % 7 = 0 THEN 'failed' ELSE 'success' END AS status, 'a \"quoted\", text' AS summary FROM scored", "scored")
def score_csv(spark, d):
    bad = s("n_chars") % 7 == 0
    x = v.scored(spark, d).select(s("doc_id").cast("string").alias("path"), "score", F.when(bad, "failed").otherwise("success").alias("status"), F.lit('a "quoted", text').alias("summary"), F.lit("two\nlines").alias("reasoning"))
    return rd.read_scores(spark, sk.write_scores(x, sk.fresh_path(spark, "scores"))).select("path", "score", "status", "summary")


PAGE = 500


def _run_details(spark, d, page=PAGE):
    """Nested verdicts, a document per ``page`` entities; verdict and score are those of the recording."""
    ver = number_rows(v.verdicts(spark, d), Lane(("video_id",), ("entity_id",), 4096), "_n").withColumn("page", F.floor((s("_n") - 1) / page))
    ev = F.struct("entity_id", "is_anomaly", "confidence", F.concat(F.lit("r"), s("entity_id")).alias("reason"), s("start_sec").alias("anomaly_start_sec"), s("end_sec").alias("anomaly_end_sec"))
    whole = ver.groupBy("video_id").agg(F.max("confidence").alias("pred_score"), F.bool_or("is_anomaly").alias("pred_anomaly"))
    g = ver.groupBy("video_id", "page").agg(F.array_sort(F.collect_list(ev)).alias("entity_verdicts"))
    g = join_on(join_on(g, whole, ("video_id",)), v.recordings(spark, d), ("video_id",))
    return g.select(F.concat(F.lit("v"), s("video_id"), F.lit(".mp4")).alias("filename"), "page", F.lit("Robbery").alias("category"), F.lit(True).alias("gt_anomaly"), "pred_anomaly", "pred_score", "total_frames", F.lit(30.0).alias("fps"), "entity_verdicts")


def _run_file(spark, d, page=PAGE):
    docs = _run_details(spark, d, page).select(F.array(F.struct("*")).alias("details"))
    return rd.read_run(spark, sk.write_json_rows(docs, sk.fresh_path(spark, "run")), lines=True)


@query("s07_run_result_json", "SELECT 'v'||video_id||'.mp4' AS filename, bool_or(is_anomaly) AS pred_anomaly, max(confidence) AS pred_score, count(*) AS n_entities FROM verdicts GROUP BY video_id", "verdicts")
def run_json(spark, d, page=PAGE):
    return rd.recording_results(_run_file(spark, d, page)).select("filename", "pred_anomaly", "pred_score", "n_entities")


@query("s08_lookup_by_precedence", "WITH u AS (SELECT doc_id, 'own' AS src, 0 AS p FROM documents WHERE n_chars % 3 = 0 UNION ALL SELECT doc_id, 'run', 1 FROM labels UNION ALL SELECT doc_id, 'demo', 2 FROM documents WHERE lang = 'de') SELECT doc_id, arg_min(src, p) AS src FROM u GROUP BY ALL")
def lookup(spark, d):
    docs, lab = v.table(spark, d, "documents"), v.table(spark, d, "labels")
    own = docs.filter("n_chars % 3 = 0").select("doc_id", F.lit("own").alias("src"))
    demo = docs.filter("lang = 'de'").select("doc_id", F.lit("demo").alias("src"))
    return rd.resolve_by_precedence([own, lab.select("doc_id", F.lit("run").alias("src")), demo], "doc_id").select("doc_id", "src")


@query("s09_canonical_result", "SELECT 'v'||video_id||'.mp4' AS filename, round(max(total_frames) / CAST(30 AS DOUBLE), 2) AS duration_sec, max(confidence) AS confidence, coalesce(string_agg(CASE WHEN is_anomaly THEN entity_id END, ',' ORDER BY entity_id), '') AS ids, coalesce(string_agg(CASE WHEN is_anomaly THEN 'Entity #'||entity_id||': r'||entity_id END, '; ' ORDER BY entity_id), 'No anomaly detected.') AS summary FROM verdicts JOIN recs USING (video_id) GROUP BY video_id", "verdicts recs")
def canonical(spark, d, page=PAGE):
    c = rd.canonical_result(_run_file(spark, d, page))
    return c.select("filename", "duration_sec", "confidence", F.array_join(F.transform("anomaly_entity_ids", lambda x: x.cast("string")), ",").alias("ids"), "summary")


@query("s10_file_listing")
def file_listing(spark, d):
    f = rd.list_files(spark, d, "*.parquet")
    return f.select(rd.base_name(s("path")).alias("name"), "length")


@query("s11_output_path", "SELECT page_id, regexp_replace(regexp_replace(url, '^https?://', '/out/'), '\\.[^./]+$', '') AS out_dir FROM pages")
def output_path(spark, d):
    return v.table(spark, d, "pages").select("page_id", rd.output_dir(s("url"), "https?://", "/out/").alias("out_dir"))


@query("s12_skip_processed", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def skip_processed(spark, d):
    return rd.pending(v.table(spark, d, "documents").select("doc_id"), v.table(spark, d, "labels").filter("quality = 1"), "doc_id")


@query("s13_manifest_sink", "SELECT video_id, seg_idx, start_frame, end_frame FROM segs", "segs")
def manifest_sink(spark, d):
    p = sk.append_manifest(v.segs(spark, d).drop("score"), sk.fresh_path(spark, "manifest-table"), small=True)
    return spark.read.parquet(p).select(s("video_id").cast("long").alias("video_id"), "seg_idx", "start_frame", "end_frame")


@query("s14_quarantine", "SELECT doc_id, CASE WHEN n_chars < 60 THEN 'too short' END AS reason FROM documents")
def quarantine(spark, d):
    good, bad = sk.quarantine(v.table(spark, d, "documents"), s("n_chars") < 60, F.lit("too short"))
    return good.select("doc_id", F.lit(None).cast("string").alias("reason")).unionByName(bad.select("doc_id", s("quarantine_reason").alias("reason")))


@query("s15_labelled_list", """WITH f AS (SELECT 'v'||video_id||'_'||iv_idx AS video, CASE WHEN iv_idx % 2 = 0 THEN 'Normal' ELSE 'Arson' END AS inf, iv_idx, s, e FROM ann)
SELECT video, CASE WHEN iv_idx % 11 = 0 THEN inf WHEN iv_idx % 5 = 0 THEN 'Normal' ELSE 'Robbery' END AS category, CAST(CASE WHEN iv_idx % 11 = 0 THEN inf <> 'Normal' ELSE iv_idx % 5 > 0 END AS INT) AS is_anomaly,
CAST(CASE WHEN iv_idx % 11 = 0 THEN -1 ELSE s END AS INT) AS start1, CAST(CASE WHEN iv_idx % 11 = 0 OR iv_idx % 3 = 0 THEN -1 ELSE e + 500 END AS INT) AS end2 FROM f""", "ann")
def labelled(spark, d):
    ann = rd.read_interval_pairs(spark, _ann_lines(spark, d))
    files = v.ann(spark, d).select(F.concat(F.lit("v"), s("video_id"), F.lit("_"), s("iv_idx")).alias("video"), F.when(s("iv_idx") % 2 == 0, "Normal").otherwise("Arson").alias("inf"))
    return sk.labelled_list(files, ann, s("inf")).select("video", "category", "is_anomaly", "start1", "end2")


@query("s16_scores_in_manifest_order", "SELECT doc_id AS ordinal, coalesce(CASE WHEN s.gt = 1 THEN s.score END, -1.0) AS score FROM documents d LEFT JOIN scored s USING (doc_id)", "scored")
def scores_in_order(spark, d):
    m = v.table(spark, d, "documents").select(s("doc_id").alias("ordinal"), s("doc_id").cast("string").alias("path"))
    sc = v.scored(spark, d).filter("gt = 1").select(s("doc_id").cast("string").alias("path"), "score")
    return sk.scores_in_manifest_order(m, sc, "ordinal").select("ordinal", "score")


@query("s17_merge_shards", "SELECT doc_id, score FROM scored", "scored")
def merge_shards(spark, d):
    x = v.scored(spark, d).select("doc_id", "score", (s("doc_id") % 3).alias("shard"))
    p = sk.append_manifest(x, sk.fresh_path(spark, "shards"), ("shard",))
    return spark.read.parquet(p).select("doc_id", "score")


@query("s18_result_json_sink", "SELECT 'v'||video_id||'.mp4' AS filename, round(sum(confidence), 6) AS total FROM verdicts GROUP BY video_id", "verdicts")
def result_sink(spark, d, page=PAGE):
    return rd.recording_results(_run_file(spark, d, page)).select("filename", F.round("total_confidence", 6).alias("total"))


@query("s19_batch_summary", "SELECT count(*) AS total, count(*) FILTER (gt = 1) AS anomalous, round(avg(score), 9) AS mean_score, (SELECT string_agg(doc_id, ',' ORDER BY score DESC, doc_id DESC) FROM (SELECT * FROM scored ORDER BY score DESC, doc_id DESC LIMIT 5)) AS top FROM scored", "scored")
def batch_summary(spark, d):
    b = rep.batch_summary(v.scored(spark, d), "doc_id", "score", s("gt") == 1)
    return b.select("total", "anomalous", F.round("mean_score", 9).alias("mean_score"), F.array_join(F.transform("top", lambda x: x.cast("string")), ",").alias("top"))


PATHS = """pa AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '/data/Training/'||['Abuse', 'Arson', 'Robbery'][doc_id % 3 + 1]||'/' ELSE '/data/Testing/x/' END || CASE WHEN doc_id % 3 = 0 THEN ['Abuse', 'Shooting', 'Vandalism'][doc_id % 2 + 1] WHEN doc_id % 3 = 1 THEN 'Normal_Videos_' ELSE 'clip' END || doc_id || '_x264.mp4' AS path FROM documents)"""


def _paths(spark, d):
    i = s("doc_id")
    folder = F.when(i % 4 == 0, F.concat(F.lit("/data/Training/"), F.element_at(F.array(F.lit("Abuse"), F.lit("Arson"), F.lit("Robbery")), (i % 3 + 1).cast("int")), F.lit("/"))).otherwise("/data/Testing/x/")
    name = F.when(i % 3 == 0, F.element_at(F.array(F.lit("Abuse"), F.lit("Shooting"), F.lit("Vandalism")), (i % 2 + 1).cast("int"))).when(i % 3 == 1, "Normal_Videos_").otherwise("clip")
    return v.table(spark, d, "documents").select("doc_id", F.concat(folder, name, i, F.lit("_x264.mp4")).alias("path"))


@query("p01_category_from_name", f"WITH {PATHS} SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN regexp_extract(path, '/(Abuse|Shooting)[0-9]+_[^/]*$', 1) WHEN doc_id % 3 = 1 THEN 'Normal' ELSE 'Unknown' END AS category FROM pa")
def category(spark, d):
    return _paths(spark, d).select("doc_id", rd.category_of(s("path")).alias("category"))


@query("p02_split_role_counts", f"WITH {PATHS} SELECT CASE WHEN doc_id % 3 = 0 THEN CASE WHEN doc_id % 4 = 0 THEN 'train_anomaly' ELSE 'test_anomaly' END WHEN doc_id % 4 = 0 THEN 'train_normal' ELSE 'test_normal' END AS role, count(*) AS n FROM pa GROUP BY ALL")
def roles(spark, d):
    return _paths(spark, d).groupBy(rd.split_role(s("path")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


@query("p03_subset_filter", f"WITH {PATHS} SELECT doc_id FROM pa WHERE path LIKE '%/Training/%' AND doc_id % 3 = 0")
def subset(spark, d):
    return _paths(spark, d).filter((rd.split_role(s("path")) == "train_anomaly") & (rd.category_of(s("path")) != "Normal")).select("doc_id")


@query("p04_label_from_name", "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'B' || doc_id % 7 ELSE 'A' END AS label FROM documents")
def label(spark, d):
    i = s("doc_id")
    name = F.concat(F.lit("Film_"), i, F.lit("_label_"), F.when(i % 2 == 0, F.concat(F.lit("B"), i % 7, F.lit("-0-0"))).otherwise("A"), F.lit(".mp4"))
    return v.table(spark, d, "documents").select("doc_id", rd.label_of(name).alias("label"))


@query("p05_recording_from_segment_path", "SELECT DISTINCT video_id, 'v'||video_id||'.mp4' AS recording FROM segs", "segs")
def recording(spark, d):
    return v.segs(spark, d).select("video_id", rd.recording_of(_seg_path()).alias("recording")).distinct()


@query("p06_film_name", "SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN true WHEN doc_id % 3 = 1 THEN false ELSE regexp_matches('9th.2001__#', '(?i)^[A-Z]') END AS film FROM documents")
def film_name(spark, d):
    i = s("doc_id")
    stem = F.when(i % 3 == 0, F.concat(F.lit("Salt."), F.lit("2010__#"), i)).when(i % 3 == 1, F.concat(F.lit("v=Salt.2010__#"), i)).otherwise("9th.2001__#")
    return v.table(spark, d, "documents").select("doc_id", tx.is_film_name(stem).alias("film"))


SCENE = "CASE event_id % 5 WHEN 0 THEN 'News Studio' WHEN 1 THEN 'street' WHEN 2 THEN 'unknown' WHEN 3 THEN '' ELSE 'parking lot' END"


@query("p07_film_scene_ratio", f"WITH x AS (SELECT user_id // 15 AS video_id, {SCENE} AS sc FROM events), y AS (SELECT video_id, avg(CASE WHEN sc = 'News Studio' THEN 1.0 ELSE 0.0 END) AS r FROM x WHERE sc NOT IN ('', 'unknown') GROUP BY ALL) SELECT video_id, round(r, 9) AS ratio, r >= 0.3 AS is_film FROM y")
def film_scene(spark, d):
    i = s("event_id") % 5
    sc = F.when(i == 0, "News Studio").when(i == 1, "street").when(i == 2, "unknown").when(i == 3, "").otherwise("parking lot")
    g = v.obs(spark, d).select("video_id", tx.film_scene(sc).cast("double").alias("f")).groupBy("video_id").agg(F.avg("f").alias("r"))
    return g.select("video_id", F.round("r", 9).alias("ratio"), (s("r") >= 0.3).alias("is_film"))


@query("p08_uniform_stride", "SELECT event_id FROM obs WHERE frame_idx % 3 = 0", "obs")
def uniform_stride(spark, d):
    return sm.stride(v.obs(spark, d), s("frame_idx"), 3).select("event_id")


@query("p09_capped_stride", "WITH n AS (SELECT video_id, count(*) AS n FROM frames GROUP BY ALL), x AS (SELECT f.*, CASE WHEN n // 2 > 20 THEN greatest(2, n // 20) ELSE 2 END AS st FROM frames f JOIN n USING (video_id)) SELECT vec_id, st AS step FROM x WHERE frame_idx % st = 0 AND frame_idx / st < 20", "frames")
def capped(spark, d):
    return sm.capped_stride(v.frames(spark, d), ("video_id",), "frame_idx", 2, 20).select("vec_id", "step")


@query("p10_row_cap", "SELECT event_id FROM obs QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) <= 100", "obs")
def row_cap(spark, d):
    return sm.top_per_group(v.obs(spark, d), ("video_id",), [s("t"), s("event_id")], 100).select("event_id")


@query("j14_scores_from_files", "SELECT 'v'||video_id||'.mp4' AS video, count(*) AS n FROM segs GROUP BY video_id", "segs")
def scores_from_files(spark, d):
    return join_on(scored_manifest(spark, d), manifest(spark, d).select("path"), ["path"]).groupBy("video").agg(F.count(F.lit(1)).alias("n"))
