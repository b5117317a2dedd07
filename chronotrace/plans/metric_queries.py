"""Registered queries: record-level metrics and error analysis (A1-A3, A7-A13, A17-A23, A27,
A34-A35, A40, A42, A44-A45, J18, T5-T7, T9-T10)."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronotrace.functions.vectors import normalise
from chronotrace.operators import metrics as m, sampling as sm
from chronotrace.operators.ordered import Lane, exact_quantiles, join_on, neighbours
from chronotrace.plans import views as v
from chronotrace.plans.registry import query


def _gt():
    return F.col("gt") == 1


def _pred():
    return F.col("score") >= 0.3


CONF = "count(*) FILTER (gt = 1 AND p) AS tp, count(*) FILTER (gt = 1 AND NOT p) AS fn, count(*) FILTER (gt = 0 AND p) AS fp, count(*) FILTER (gt = 0 AND NOT p) AS tn, count(*) AS total"
RATES = "round((tp + tn) / CAST(total AS DOUBLE), 9) AS accuracy, round(coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0), 9) AS \"precision\", round(coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0), 9) AS recall, round(coalesce(2 * tp / CAST(nullif(2 * tp + fp + fn, 0) AS DOUBLE), 0), 9) AS f1"
R9 = ("accuracy", "precision", "recall", "f1")


def r9(df, *cols):
    return df.withColumns({c: F.round(c, 9) for c in cols})


@query("a01_confusion_counts", f"WITH s AS (SELECT *, score >= 0.3 AS p FROM scored) SELECT {CONF} FROM s", "scored")
def confusion_counts(spark, d):
    return m.confusion(v.scored(spark, d), _gt(), _pred()).select("tp", "fn", "fp", "tn", "total")


@query("a02_rates", f"WITH s AS (SELECT *, score >= 0.3 AS p FROM scored), c AS (SELECT {CONF} FROM s) SELECT {RATES} FROM c", "scored")
def rates(spark, d):
    return r9(m.confusion(v.scored(spark, d), _gt(), _pred()), *R9).select(*R9)


@query("a03_category_stats", "WITH s AS (SELECT *, pred = 1 AS p FROM runs WHERE run = 'new'), c AS (SELECT source, " + CONF + ", round(avg(iou), 9) AS mean_iou FROM s GROUP BY ALL) SELECT source, total, tp, fn, fp, tn, tp + tn AS correct, mean_iou, round((tp + tn) / CAST(total AS DOUBLE), 9) AS accuracy FROM c", "runs")
def category_stats(spark, d):
    r = v.runs(spark, d).filter("run = 'new'")
    return r9(m.category_stats(r, "source", _gt(), F.col("pred") == 1, "iou"), "accuracy", "mean_iou")


CURVE = "b AS (SELECT score, sum(gt) AS p, sum(1 - gt) AS n FROM scored GROUP BY ALL), c AS (SELECT score, p, n, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn, (SELECT sum(p) FROM b) AS P_, (SELECT sum(n) FROM b) AS N_ FROM b), q AS (SELECT *, cn / CAST(N_ AS DOUBLE) AS fpr, cp / CAST(P_ AS DOUBLE) AS tpr, cp / CAST(cp + cn AS DOUBLE) AS prc FROM c)"


def _curve(spark, d):
    return m.score_curve(v.scored(spark, d), "score", _gt())


@query("a08_average_precision", f"WITH {CURVE} SELECT round(sum(p * prc) / any_value(P_), 9) AS average_precision FROM q", "scored")
def average_precision(spark, d):
    return m.curve_summary(_curve(spark, d)).select(F.round("average_precision", 9).alias("average_precision"))


@query("a09_equal_error_rate", f"WITH {CURVE} SELECT round(arg_min((fpr + 1 - tpr) / 2, (round(abs(fpr - 1 + tpr), 12), -score)), 9) AS eer, arg_min(score, (round(abs(fpr - 1 + tpr), 12), -score)) AS threshold FROM q", "scored")
def eer(spark, d):
    return r9(m.equal_error_rate(m.curve_points(_curve(spark, d))), "eer")


@query("a10_max_f1", f"WITH {CURVE} SELECT round(max(CASE WHEN prc + tpr > 0 THEN 2 * prc * tpr / (prc + tpr) ELSE 0 END), 9) AS max_f1 FROM q", "scored")
def max_f1(spark, d):
    return r9(m.best_f1(m.curve_points(_curve(spark, d))), "max_f1")


@query("a11_record_auc", f"WITH {CURVE} SELECT round(sum(n * (cp - p) + n * p / CAST(2 AS DOUBLE)) / CAST(any_value(P_ * N_) AS DOUBLE), 9) AS auc FROM q", "scored")
def record_auc(spark, d):
    return m.curve_summary(_curve(spark, d)).select(F.round("auc", 9).alias("auc"))


@query("a12_roc_pr_points", f"WITH {CURVE} SELECT score AS threshold, round(fpr, 9) AS fpr, round(tpr, 9) AS tpr, round(prc, 9) AS \"precision\" FROM q", "scored")
def roc_points(spark, d):
    return r9(m.curve_points(_curve(spark, d)).select("threshold", "fpr", "tpr", "precision"), "fpr", "tpr", "precision")


@query("a12_roc_area", f"WITH {CURVE}, z AS (SELECT fpr, tpr, lag(fpr, 1, 0) OVER (ORDER BY score DESC) AS pf, lag(tpr, 1, 0) OVER (ORDER BY score DESC) AS pt FROM q) SELECT round(sum((fpr - pf) * (tpr + pt) / 2), 9) AS area FROM z", "scored")
def roc_area(spark, d):
    p = m.curve_points(_curve(spark, d)).withColumn("_ax", -F.col("threshold"))
    z = F.lit(0.0)
    p = neighbours(p, Lane((), ("_ax",), 1 / 1024), previous={"pf": F.col("fpr"), "pt": F.col("tpr")}).withColumns({"pf": F.coalesce("pf", z), "pt": F.coalesce("pt", z)})
    return p.agg(F.round(m.trapezoid_area(p, "fpr", "tpr", "pf", "pt"), 9).alias("area"))


@query("a13_youden_threshold", f"WITH {CURVE} SELECT arg_max(score, (round(tpr - fpr, 12), score)) AS threshold, round(max(round(tpr - fpr, 12)), 9) AS youden FROM q", "scored")
def youden(spark, d):
    return r9(m.youden(m.curve_points(_curve(spark, d))), "youden")


@query("a17_score_histogram", "SELECT gt, CAST(least(28, floor(score * 29)) AS BIGINT) AS bin, count(*) AS n FROM scored WHERE score BETWEEN 0 AND 1 GROUP BY ALL", "scored")
def histogram(spark, d):
    return m.score_histogram(v.scored(spark, d), "score", "gt", 29)


OUT = "CASE WHEN gt = 1 AND pred = 1 THEN 'TP' WHEN gt = 1 THEN 'FN' WHEN pred = 1 THEN 'FP' ELSE 'TN' END"


@query("a18_error_buckets", f"SELECT source, {OUT} AS outcome, n_entities > 0 AS has_entities, count(*) AS n, min(doc_id) AS first_doc FROM runs WHERE run = 'old' GROUP BY ALL", "runs")
def error_buckets(spark, d):
    r = v.runs(spark, d).filter("run = 'old'").withColumn("outcome", m.outcome(_gt(), F.col("pred") == 1))
    return r.groupBy("source", "outcome", (F.col("n_entities") > 0).alias("has_entities")).agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


CAUSE = """rc AS (SELECT doc_id, source, CASE WHEN gt = 1 AND pred = 0 THEN CASE WHEN n_entities = 0 THEN 'ZERO_ENTITY_DETECTION' WHEN n_entities = 1 THEN 'ZERO_TRIGGERS' WHEN n_entities < 4 THEN 'VLLM_UNDER_DESCRIPTION' ELSE 'DECISION_ERROR' END
 WHEN gt = 0 AND pred = 1 THEN CASE n_entities % 3 WHEN 0 THEN 'DISCORDANCE_FALSE_ALARM' WHEN 1 THEN 'VLLM_HALLUCINATION' ELSE 'DECISION_FALSE_ALARM' END ELSE 'OK' END AS cause FROM runs WHERE run = 'new')"""


def _causes(spark, d):
    n = F.col("n_entities")
    reason = F.when(n % 3 == 0, "Motion energy over the threshold").when(n % 3 == 1, "two people fighting near a blind spot").otherwise("odd")
    c = m.root_cause(_gt(), F.col("pred") == 1, n, n - 1, F.when(n < 4, 0).otherwise(1), reason)
    return v.runs(spark, d).filter("run = 'new'").select("doc_id", "source", c.alias("cause"))


@query("a19_root_causes", f"WITH {CAUSE} SELECT doc_id, source, cause FROM rc WHERE cause <> 'OK'", "runs")
def root_causes(spark, d):
    return _causes(spark, d).filter("cause <> 'OK'")


@query("a19_root_cause_counts", f"WITH {CAUSE} SELECT *, row_number() OVER (ORDER BY n DESC, cause) AS place FROM (SELECT cause, count(*) AS n, min(doc_id) AS first_doc FROM rc WHERE cause <> 'OK' GROUP BY cause)", "runs")
def root_cause_counts(spark, d):
    c = _causes(spark, d).filter("cause <> 'OK'").groupBy("cause").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    return c.withColumn("place", F.row_number().over(W.orderBy(F.col("n").desc(), "cause")).cast("long"))  # at most seven causes


@query("a20_category_analysis", f"WITH o AS (SELECT *, {OUT} AS o FROM runs WHERE run = 'old') SELECT source, count(*) AS total, count(*) FILTER (o IN ('TP', 'TN')) AS correct, round(avg(CAST(o IN ('TP', 'TN') AS INT)), 4) AS accuracy, count(*) FILTER (o = 'TP') AS tp, count(*) FILTER (o = 'FN') AS fn, count(*) FILTER (o = 'FP') AS fp, count(*) FILTER (o = 'TN') AS tn, round(avg(iou) FILTER (o = 'TP'), 9) AS mean_iou_tp FROM o GROUP BY ALL", "runs")
def category_analysis(spark, d):
    return r9(m.category_outcomes(v.runs(spark, d).filter("run = 'old'"), "source", _gt(), F.col("pred") == 1, "iou"), "mean_iou_tp")


@query("a20_category_outcome_cube", f"WITH o AS (SELECT source, {OUT} AS outcome FROM runs WHERE run = 'old') SELECT source, outcome, count(*) AS n FROM o GROUP BY CUBE (source, outcome)", "runs")
def outcome_cube(spark, d):
    return m.category_outcome_cube(v.runs(spark, d).filter("run = 'old'"), "source", _gt(), F.col("pred") == 1)


@query("a21_iou_tiers", "SELECT CASE WHEN iou >= 0.5 THEN 'excellent' WHEN iou > 0.05 THEN 'moderate' ELSE 'zero' END AS tier, count(*) AS n, round(avg(iou), 9) AS mean_iou FROM runs WHERE run = 'new' AND gt = 1 AND pred = 1 GROUP BY ALL", "runs")
def tiers(spark, d):
    t = m.iou_tiers(v.runs(spark, d).filter("run = 'new'"), _gt(), F.col("pred") == 1, "iou")
    return t.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("iou"), 9).alias("mean_iou"))


def _conf(spark, d, run):
    return m.confusion(v.runs(spark, d).filter(F.col("run") == run), _gt(), F.col("pred") == 1)


@query("a22_metric_deltas", """WITH s AS (SELECT *, pred = 1 AS p FROM runs), c AS (SELECT run, """ + CONF + """ FROM s GROUP BY ALL), r AS (SELECT run, (tp + tn) / CAST(total AS DOUBLE) AS accuracy, coalesce(tp / CAST(nullif(tp + fp, 0) AS DOUBLE), 0) AS prc, coalesce(tp / CAST(nullif(tp + fn, 0) AS DOUBLE), 0) AS recall FROM c),
u AS (SELECT run, 'accuracy' AS metric, accuracy AS x FROM r UNION ALL SELECT run, 'precision', prc FROM r UNION ALL SELECT run, 'recall', recall FROM r)
SELECT o.metric, round(o.x, 9) AS old_value, round(n.x, 9) AS new_value, round(n.x - o.x, 9) AS delta, CASE WHEN round(n.x - o.x, 9) > 0.005 THEN 'better' WHEN round(n.x - o.x, 9) < -0.005 THEN 'worse' ELSE 'same' END AS tag FROM u o JOIN u n USING (metric) WHERE o.run = 'old' AND n.run = 'new'""", "runs")
def metric_deltas(spark, d):
    return r9(m.metric_deltas(_conf(spark, d, "old"), _conf(spark, d, "new"), ["accuracy", "precision", "recall"]), "old_value", "new_value")


@query("a22_confusion_deltas", "WITH s AS (SELECT *, pred = 1 AS p FROM runs), c AS (SELECT run, " + CONF + " FROM s GROUP BY ALL), u AS (SELECT run, 'fn' AS metric, CAST(fn AS DOUBLE) AS x FROM c UNION ALL SELECT run, 'fp', CAST(fp AS DOUBLE) FROM c) SELECT o.metric, o.x AS old_value, n.x AS new_value, round(n.x - o.x, 9) AS delta, CASE WHEN n.x < o.x THEN 'better' WHEN n.x > o.x THEN 'worse' ELSE 'same' END AS tag FROM u o JOIN u n USING (metric) WHERE o.run = 'old' AND n.run = 'new'", "runs")
def confusion_deltas(spark, d):
    return m.metric_deltas(_conf(spark, d, "old"), _conf(spark, d, "new"), ["fn", "fp"], higher_is_better=False, tol=0.0)


@query("a23_priority_actions", f"""WITH {CAUSE}, cc AS (SELECT cause, count(*) AS n FROM rc WHERE cause <> 'OK' GROUP BY ALL), ct AS (SELECT source, count(*) AS t, count(*) FILTER (gt = pred) AS c FROM runs WHERE run = 'new' GROUP BY ALL),
z AS (SELECT count(*) AS n FROM runs WHERE run = 'new' AND gt = 1 AND pred = 1 AND iou <= 0.05)
SELECT 'P0' AS priority, cause AS topic, n FROM cc WHERE cause IN ('ZERO_ENTITY_DETECTION', 'VLLM_UNDER_DESCRIPTION', 'DISCORDANCE_FALSE_ALARM', 'VLLM_HALLUCINATION')
UNION ALL SELECT 'P1', 'interval quality', n FROM z WHERE n > 0 UNION ALL SELECT 'P1', 'category '||source, t - c FROM ct WHERE c / CAST(t AS DOUBLE) < 0.5""", "runs")
def priority_actions(spark, d):
    from chronotrace.operators import reporting as rep

    r = v.runs(spark, d).filter("run = 'new'")
    return rep.priority_actions(_causes(spark, d), m.category_outcomes(r, "source", _gt(), F.col("pred") == 1, "iou"), m.iou_tiers(r, _gt(), F.col("pred") == 1, "iou"), "source")


@query("a23_strengths_and_weaknesses", f"WITH o AS (SELECT source, count(*) AS t, avg(CAST({OUT} IN ('TP', 'TN') AS INT)) AS a FROM runs WHERE run = 'new' GROUP BY ALL) SELECT source, CASE WHEN a >= 0.8 THEN 'strength' ELSE 'weakness' END AS kind, round(a, 4) AS accuracy FROM o WHERE a >= 0.8 OR a < 0.5", "runs")
def strengths(spark, d):
    from chronotrace.operators import reporting as rep

    r = v.runs(spark, d).filter("run = 'new'")
    return rep.strengths_and_weaknesses(m.category_outcomes(r, "source", _gt(), F.col("pred") == 1, "iou"), "source")


@query("a27_pool_stats", "WITH e AS (SELECT video_id, entity_id, count(*) AS n, max(frame_idx) AS lf FROM obs GROUP BY ALL), c AS (SELECT video_id, max(frame_idx) AS now FROM obs GROUP BY ALL) SELECT video_id, count(*) AS total, round(avg(n), 9) AS avg_appearances, max(n) AS max_appearances, round(avg(now - lf), 9) AS avg_age FROM e JOIN c USING (video_id) GROUP BY ALL", "obs")
def pool_stats(spark, d):
    from chronotrace.operators import reporting as rep

    return r9(rep.pool_stats(v.obs(spark, d)), "avg_appearances", "avg_age")


@query("a34_energy_percentiles", "SELECT video_id, round(avg(energy), 9) AS mean_e, round(stddev_pop(energy), 9) AS std_e, round(max(energy), 9) AS max_e, round(quantile_cont(energy, 0.95), 9) AS p95, round(quantile_cont(energy, 0.99), 9) AS p99 FROM obs GROUP BY ALL", "obs")
def energy_percentiles(spark, d):
    o = v.obs(spark, d).select("video_id", "energy")
    g = o.groupBy("video_id").agg(F.avg("energy").alias("mean_e"), F.stddev_pop("energy").alias("std_e"), F.max("energy").alias("max_e"))
    return r9(join_on(g, exact_quantiles(o, ("video_id",), "energy", {"p95": 0.95, "p99": 0.99}), ("video_id",)), "mean_e", "std_e", "max_e", "p95", "p99")


@query("a35_class_detection_stats", "SELECT action AS class_name, count(*) AS n, round(avg(energy), 8) AS mean_conf, round(min(energy), 9) AS min_conf, round(max(energy), 9) AS max_conf FROM obs GROUP BY ALL", "obs")
def class_stats(spark, d):
    return v.obs(spark, d).groupBy(F.col("action").alias("class_name")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("energy"), 8).alias("mean_conf"), F.round(F.min("energy"), 9).alias("min_conf"), F.round(F.max("energy"), 9).alias("max_conf")
    )


@query("a40_snapshot_rule_check", """WITH s AS (SELECT video_id, seg_idx, score / 2 AS danger FROM segs), n AS (SELECT video_id, CAST(floor(t / 60) AS BIGINT) AS seg_idx, count(*) FILTER (suspicious) AS ns FROM obs GROUP BY ALL),
g AS (SELECT video_id, max(danger) AS mx, avg(danger) AS av, sum(ns) AS ns FROM s JOIN n USING (video_id, seg_idx) GROUP BY ALL)
SELECT video_id, mx >= 0.45 OR ns > 0 OR av >= 0.22 AS is_anomaly, round(greatest(CASE WHEN mx >= 0.45 THEN least(mx + 0.2, 0.9) ELSE 0 END, CASE WHEN ns > 0 THEN least(0.5 + ns * CAST(0.1 AS DOUBLE), 0.9) ELSE 0 END, CASE WHEN NOT (mx >= 0.45 OR ns > 0) AND av >= 0.22 THEN 0.5 ELSE 0 END), 6) AS confidence FROM g""", "obs segs")
def snapshot_rules(spark, d):
    from chronotrace.operators import reporting as rep

    o = v.obs(spark, d)
    n = o.groupBy("video_id", F.floor(F.col("t") / 60).cast("long").alias("seg_idx")).agg(m.n_if(F.col("suspicious")).alias("n_suspicious"))
    s = join_on(v.segs(spark, d).select("video_id", "seg_idx", (F.col("score") / 2).alias("danger")), n, ("video_id", "seg_idx"))
    return rep.snapshot_rules(s).withColumn("confidence", F.round("confidence", 6))


@query("a42_prototype_centroids", """WITH u AS (SELECT label, list_transform(e, lambda x: x / sqrt(list_inner_product(e, e))) AS a FROM (SELECT label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)), x AS (SELECT label, unnest(range(1, 65)) AS pos, unnest(a) AS x FROM u),
c AS (SELECT label, pos, avg(x) AS m FROM x GROUP BY ALL), q AS (SELECT label, sqrt(sum(m * m)) AS nn FROM c GROUP BY ALL) SELECT label, CAST(pos AS INTEGER) AS pos, round(m / nn, 6) AS value FROM c JOIN q USING (label)""")
def centroids(spark, d):
    from chronotrace.operators import reporting as rep

    e = v.table(spark, d, "embeddings").select("label", normalise(F.col("embedding")).alias("u"))
    c = rep.class_centroids(e, "label", "u")
    return c.select("label", F.posexplode("centroid").alias("p", "value")).select("label", (F.col("p") + 1).cast("int").alias("pos"), F.round("value", 6).alias("value"))


@query("a44_run_stats", "SELECT lang AS category, count(*) AS total, count(l.doc_id) AS processed, count(*) - count(l.doc_id) AS pending, count(*) FILTER (n_chars < 50) AS nearly_empty, round(avg(n_chars), 6) AS avg_chars FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY ALL")
def run_stats(spark, d):
    j = join_on(v.table(spark, d, "documents"), v.table(spark, d, "labels").select("doc_id").withColumn("_p", F.lit(1)), ("doc_id",), "left")
    return j.groupBy(F.col("lang").alias("category")).agg(
        F.count(F.lit(1)).alias("total"), F.count("_p").alias("processed"), m.n_if(F.col("_p").isNull()).alias("pending"), m.n_if(F.col("n_chars") < 50).alias("nearly_empty"), F.round(F.avg("n_chars"), 6).alias("avg_chars")
    )


@query("a45_ablation_grid", "SELECT thr AS threshold, use_quality, count(*) FILTER (gt = 1 AND p) AS tp, count(*) FILTER (gt = 0 AND p) AS fp, round(avg(CAST((gt = 1) = p AS INT)), 9) AS accuracy FROM (SELECT *, score >= thr AND (NOT use_quality OR quality = 1) AS p FROM scored, (VALUES (CAST(0.2 AS DOUBLE)), (0.3), (0.5)) t(thr), (VALUES (true), (false)) u(use_quality)) GROUP BY ALL", "scored")
def ablation(spark, d):
    from chronotrace.operators import reporting as rep

    return r9(rep.ablation_grid(v.scored(spark, d), [0.2, 0.3, 0.5], [True, False]), "accuracy")


def _compared(spark, d):
    r = v.runs(spark, d)
    return m.compare_runs(r.filter("run = 'old'"), r.filter("run = 'new'"), "doc_id")


CMP = f"""cmp AS (SELECT doc_id, o.o AS old_outcome, n.o AS new_outcome, round(n.iou - o.iou, 4) AS delta FROM (SELECT doc_id, iou, {OUT} AS o FROM runs WHERE run = 'old') o JOIN (SELECT doc_id, iou, {OUT} AS o FROM runs WHERE run = 'new') n USING (doc_id))"""


@query("j18_run_comparison", f"WITH {CMP} SELECT doc_id, old_outcome, new_outcome, delta, CASE WHEN old_outcome = new_outcome THEN 'same' WHEN new_outcome IN ('TP', 'TN') AND old_outcome NOT IN ('TP', 'TN') THEN 'improved' WHEN new_outcome NOT IN ('TP', 'TN') AND old_outcome IN ('TP', 'TN') THEN 'regressed' ELSE 'moved' END AS change FROM cmp", "runs")
def run_comparison(spark, d):
    return _compared(spark, d)


@query("t06_largest_changes", f"WITH {CMP} SELECT doc_id, delta FROM cmp WHERE abs(delta) > 0.02 ORDER BY abs(delta) DESC, doc_id LIMIT 15", "runs")
def largest_changes(spark, d):
    return m.largest_changes(_compared(spark, d), "doc_id").select("doc_id", "delta")


@query("t05_top_records", "SELECT doc_id, score FROM scored ORDER BY score DESC, doc_id LIMIT 5", "scored")
def top_records(spark, d):
    return v.scored(spark, d).orderBy(F.col("score").desc(), "doc_id").limit(5).select("doc_id", "score")


@query("t09_first_n", "SELECT doc_id FROM scored ORDER BY doc_id LIMIT 25", "scored")
def first_n(spark, d):
    return v.scored(spark, d).orderBy("doc_id").limit(25).select("doc_id")


@query("t07_stratified_sample", """WITH a AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r, count(*) OVER (PARTITION BY source) AS sz FROM scored WHERE gt = 1),
o AS (SELECT doc_id, row_number() OVER (ORDER BY CASE WHEN r = 1 THEN 0 ELSE 1 END, CASE WHEN r = 1 THEN 0 ELSE r END, CASE WHEN r = 1 THEN 0 ELSE -sz END, source, doc_id) AS p FROM a)
SELECT doc_id, 'anomalous' AS stratum FROM o WHERE p <= 20 UNION ALL (SELECT doc_id, 'normal' FROM scored WHERE gt = 0 ORDER BY doc_id LIMIT 20)""", "scored")
def stratified(spark, d):
    return sm.stratified_sample(v.scored(spark, d), "doc_id", "source", _gt(), 40)


@query("t10_round_robin_shards", "SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) % 4 AS shard FROM documents")
def shards(spark, d):
    return sm.round_robin(v.table(spark, d, "documents").select("doc_id"), Lane((), ("doc_id",), 4096), 4)


@query("t03_top_regions_per_frame", "SELECT event_id, row_number() OVER (PARTITION BY video_id, frame_idx // 300 ORDER BY energy DESC, event_id) AS place FROM obs QUALIFY place <= 4", "obs")
def top_regions(spark, d):
    o = v.obs(spark, d).withColumn("cell", F.floor(F.col("frame_idx") / 300))
    return sm.top_per_group(o, ("video_id", "cell"), [F.col("energy").desc(), F.col("event_id")], 4, "place").select("event_id", "place")


@query("t04_source_bonus_ranking", "WITH r AS (SELECT event_id, video_id, frame_idx // 300 AS cell, CASE k % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 0.5 ELSE 0 END + danger + energy AS s FROM obs) SELECT event_id, round(s, 9) AS bonus_score, row_number() OVER (PARTITION BY video_id, cell ORDER BY s DESC, event_id) AS place FROM r QUALIFY place <= 10", "obs")
def bonus_ranking(spark, d):
    src = F.when(F.col("k") % 3 == 0, "fused").when(F.col("k") % 3 == 1, "yolo").otherwise("motion")
    o = v.obs(spark, d).withColumn("bonus_score", sm.source_bonus(src) + F.col("danger") + F.col("energy")).withColumn("cell", F.floor(F.col("frame_idx") / 300))
    return sm.top_per_group(o, ("video_id", "cell"), [F.col("bonus_score").desc(), F.col("event_id")], 10, "place").select("event_id", F.round("bonus_score", 9).alias("bonus_score"), "place")


