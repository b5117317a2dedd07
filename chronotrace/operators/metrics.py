"""Detection metrics over tables of scores, labels and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotrace.operators.ordered import Lane, exact_quantiles, join_on, running
from chronotrace.session import cut


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0."""
    return F.when(b != 0, a / b).otherwise(F.lit(0.0))


def n_if(c: Column) -> Column:
    return F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0)).cast("long")


def confusion(df: DataFrame, gt: Column, pred: Column, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts and the rates derived from them; a record is correct when both flags agree."""
    g = df.groupBy(*keys).agg(
        n_if(gt & pred).alias("tp"), n_if(gt & ~pred).alias("fn"), n_if(~gt & pred).alias("fp"), n_if(~gt & ~pred).alias("tn"),
        F.count(F.lit(1)).alias("total"),
    )
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return g.withColumns({"accuracy": ratio(F.col("tp") + F.col("tn"), F.col("total")), "precision": p, "recall": r}).withColumn(
        "f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))
    )


def outcome(gt: Column, pred: Column) -> Column:
    return F.when(gt & pred, "TP").when(gt, "FN").when(pred, "FP").otherwise("TN")


def score_curve(df: DataFrame, score: str, gt: Column, slice_width: float = 1 / 1024) -> DataFrame:
    """One row per distinct score, descending, with cumulative positives and negatives.

    Ties collapse first, so the ordered stage sees distinct scores only, and it runs in
    score slices rather than in one task.
    """
    by = df.groupBy(F.col(score).cast("double").alias("score")).agg(n_if(gt).alias("pos"), n_if(~gt).alias("neg"))
    by = by.withColumn("_neg_score", -F.col("score"))
    c = running(by, Lane((), ("_neg_score",), slice_width), {"ctp": ("sum", F.col("pos")), "cfp": ("sum", F.col("neg"))})
    return c.drop("_neg_score")


def curve_summary(curve: DataFrame) -> DataFrame:
    """ROC-AUC with ties counted half, average precision, and class sizes, from the curve."""
    g = curve.agg(
        F.sum(F.col("neg") * (F.col("ctp") - F.col("pos")) + F.col("neg") * F.col("pos") / 2.0).alias("_a"),
        F.sum(F.col("pos") * F.col("ctp") / (F.col("ctp") + F.col("cfp"))).alias("_p"),
        F.coalesce(F.sum("pos"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum("neg"), F.lit(0)).alias("negatives"),
    )
    both = (F.col("positives") > 0) & (F.col("negatives") > 0)
    return g.select(
        F.when(both, F.col("_a") / (F.col("positives") * F.col("negatives"))).otherwise(0.0).alias("auc"),
        F.when(both, F.col("_p") / F.col("positives")).otherwise(0.0).alias("average_precision"),
        "positives", "negatives",
    )


def curve_points(curve: DataFrame) -> DataFrame:
    """fpr, tpr, precision, recall and f1 at every threshold. The totals are scalar subqueries."""
    curve = cut(curve)
    j = curve.withColumns({"_P": curve.agg(F.sum("pos")).scalar(), "_N": curve.agg(F.sum("neg")).scalar()})
    tpr, fpr = ratio(F.col("ctp"), F.col("_P")), ratio(F.col("cfp"), F.col("_N"))
    prec = F.col("ctp") / (F.col("ctp") + F.col("cfp"))
    return j.select(
        F.col("score").alias("threshold"), fpr.alias("fpr"), tpr.alias("tpr"), prec.alias("precision"), tpr.alias("recall"),
        ratio(2 * prec * tpr, prec + tpr).alias("f1"), "pos", "neg", "ctp", "cfp",
    )


def equal_error_rate(points: DataFrame) -> DataFrame:
    """Mean of fpr and fnr where they are closest; every threshold is a candidate."""
    d = F.abs(F.col("fpr") - (1 - F.col("tpr")))
    return points.agg(
        F.min_by((F.col("fpr") + 1 - F.col("tpr")) / 2, F.struct(F.round(d, 12), -F.col("threshold"))).alias("eer"),
        F.min_by("threshold", F.struct(F.round(d, 12), -F.col("threshold"))).alias("threshold"),
    )


def best_f1(points: DataFrame) -> DataFrame:
    return points.agg(F.coalesce(F.max("f1"), F.lit(0.0)).alias("max_f1"))


def youden(points: DataFrame) -> DataFrame:
    """Threshold with the largest tpr - fpr, the highest one on a tie."""
    j = F.round(F.col("tpr") - F.col("fpr"), 12)
    return points.agg(F.max_by("threshold", F.struct(j, F.col("threshold"))).alias("threshold"), F.max(j).alias("youden"))


def trapezoid_area(points: DataFrame, x: str, y: str, prev_x: str, prev_y: str) -> Column:
    return F.sum((F.col(x) - F.col(prev_x)) * (F.col(y) + F.col(prev_y)) / 2)


def category_stats(df: DataFrame, category: str, gt: Column, pred: Column, iou: str) -> DataFrame:
    base = confusion(df, gt, pred, (category,)).select(category, "total", "tp", "fn", "fp", "tn", "accuracy")
    extra = df.groupBy(category).agg(n_if(gt == pred).alias("correct"), F.coalesce(F.avg(iou), F.lit(0.0)).alias("mean_iou"))
    return join_on(base, extra, [category])


def category_outcomes(df: DataFrame, category: str, gt: Column, pred: Column, iou: str) -> DataFrame:
    """Per-category counts and the mean overlap of true positives only."""
    d = df.withColumn("_o", outcome(gt, pred))
    return d.groupBy(category).agg(
        F.count(F.lit(1)).alias("total"), n_if(F.col("_o").isin("TP", "TN")).alias("correct"),
        F.round(F.avg(F.col("_o").isin("TP", "TN").cast("double")), 4).alias("accuracy"),
        *[n_if(F.col("_o") == o).alias(o.lower()) for o in ("TP", "FN", "FP", "TN")],
        F.avg(F.when(F.col("_o") == "TP", F.col(iou))).alias("mean_iou_tp"),
    )


def category_outcome_cube(df: DataFrame, category: str, gt: Column, pred: Column) -> DataFrame:
    """All totals by category, by outcome and overall in one pass."""
    return df.withColumn("outcome", outcome(gt, pred)).cube(category, "outcome").agg(F.count(F.lit(1)).alias("n"))


def segment_stats(df: DataFrame, category: str) -> DataFrame:
    g = df.groupBy(category).agg(
        F.count(F.lit(1)).alias("total_segments"), n_if(F.col("contains_anomaly")).alias("anomaly_segments"),
        n_if(~F.col("contains_anomaly")).alias("normal_segments"),
        F.coalesce(F.avg(F.when(F.col("contains_anomaly"), F.col("overlap_ratio"))), F.lit(0.0)).alias("avg_anomaly_overlap"),
    )
    return g.withColumn("anomaly_ratio", F.col("anomaly_segments") / F.col("total_segments"))


def error_summary(df: DataFrame, error: str, kind: str, limit: float = 1.0) -> DataFrame:
    """Mean, median and hit rates of boundary errors; ``kind`` is 'start' or 'end'."""
    df = cut(df.select(error, kind))
    hit = (F.col(error) < limit).cast("double")
    med = exact_quantiles(df, (), error, {"median_error": 0.5})
    agg = df.agg(
        F.avg(error).alias("mean_error"), F.avg(hit).alias("rate"), F.avg(F.when(F.col(kind) == "start", hit)).alias("start_rate"),
        F.avg(F.when(F.col(kind) == "end", hit)).alias("end_rate"), F.count(F.lit(1)).alias("n"),
    )
    return agg.withColumn("median_error", med.scalar())


def coverage_summary(df: DataFrame) -> DataFrame:
    df = cut(df.select("coverage", "fragments"))
    med = exact_quantiles(df, (), "coverage", {"median_coverage": 0.5})
    agg = df.agg(
        F.avg("coverage").alias("mean_coverage"), F.avg((F.col("coverage") >= 0.99).cast("double")).alias("full_rate"),
        F.coalesce(F.avg(F.when(F.col("fragments") > 0, F.col("fragments"))), F.lit(0.0)).alias("mean_fragments"), F.count(F.lit(1)).alias("n"),
    )
    return agg.withColumn("median_coverage", med.scalar())


def soft_iou(df: DataFrame, keys: tuple[str, ...], gt: Column, score: Column) -> DataFrame:
    """Sum of minima over sum of maxima; two empty sides agree fully."""
    g = df.groupBy(*keys).agg(F.sum(F.least(gt, score)).alias("_n"), F.sum(F.greatest(gt, score)).alias("_d"))
    return g.select(
        *keys, F.when(F.col("_d") < 1e-8, F.when(F.col("_n") < 1e-8, 1.0).otherwise(0.0)).otherwise(F.col("_n") / F.col("_d")).alias("iou")
    )


def hard_iou(df: DataFrame, keys: tuple[str, ...], gt: Column, pred: Column) -> DataFrame:
    g = df.groupBy(*keys).agg(n_if(gt & pred).alias("_i"), n_if(gt | pred).alias("_u"))
    return g.select(*keys, F.when(F.col("_u") == 0, 1.0).otherwise(F.col("_i") / F.col("_u")).alias("iou"))


def mean_positive(df: DataFrame, value: str) -> DataFrame:
    """Mean over positive values only, next to the mean over all rows."""
    return df.agg(
        F.coalesce(F.avg(F.when(F.col(value) > 0, F.col(value))), F.lit(0.0)).alias("mean_positive"),
        F.coalesce(F.avg(value), F.lit(0.0)).alias("mean_all"),
    )


def score_histogram(df: DataFrame, score: str, label: str, bins: int) -> DataFrame:
    """Equal-width bins on [0, 1]; the last bin is closed."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(score) * bins)).cast("long")
    return df.filter((F.col(score) >= 0) & (F.col(score) <= 1)).groupBy(label, b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def iou_tiers(df: DataFrame, gt: Column, pred: Column, *ious: str) -> DataFrame:
    """Quality tier of each true positive by its best overlap."""
    best = F.greatest(*[F.coalesce(F.col(c), F.lit(0.0)) for c in ious]) if len(ious) > 1 else F.coalesce(F.col(ious[0]), F.lit(0.0))
    d = df.filter(gt & pred).withColumn("best_iou", best)
    tier = F.when(F.col("best_iou") >= 0.5, "excellent").when(F.col("best_iou") > 0.05, "moderate").otherwise("zero")
    return d.withColumn("tier", tier)


# Words in a verdict reason that point at a cause.
PHYSICAL_WORDS = ["motion energy", "discordance", "blind spot", "threshold"]
SEMANTIC_WORDS = ["fire", "weapon", "aggressive", "pushing", "fighting", "confrontational", "cash register", "interaction"]


def any_word(text: Column, words: list[str]) -> Column:
    """True where ``text`` contains one of the words (case-insensitive)."""
    low = F.lower(text)
    return F.exists(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(low, w))


def root_cause(gt: Column, pred: Column, entities: Column, triggers: Column, flagged: Column, reason: Column) -> Column:
    """Cause code of a wrong decision; OK for a right one."""
    physical, semantic = any_word(reason, PHYSICAL_WORDS), any_word(reason, SEMANTIC_WORDS)
    miss = (
        F.when(entities == 0, "ZERO_ENTITY_DETECTION").when(triggers == 0, "ZERO_TRIGGERS").when(flagged == 0, "VLLM_UNDER_DESCRIPTION").otherwise("DECISION_ERROR")
    )
    false_alarm = F.when(physical & ~semantic, "DISCORDANCE_FALSE_ALARM").when(semantic, "VLLM_HALLUCINATION").otherwise("DECISION_FALSE_ALARM")
    return F.when(gt & ~pred, miss).when(~gt & pred, false_alarm).otherwise("OK")


def compare_runs(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Records of both runs whose outcome changed or whose overlap moved by more than 0.02."""
    o = old.select(key, outcome(F.col("gt") == 1, F.col("pred") == 1).alias("old_outcome"), F.col("iou").alias("old_iou"))
    n = new.select(key, outcome(F.col("gt") == 1, F.col("pred") == 1).alias("new_outcome"), F.col("iou").alias("new_iou"))
    good_o, good_n = F.col("old_outcome").isin("TP", "TN"), F.col("new_outcome").isin("TP", "TN")
    change = (
        F.when(F.col("old_outcome") == F.col("new_outcome"), "same").when(good_n & ~good_o, "improved").when(~good_n & good_o, "regressed").otherwise("moved")
    )
    return join_on(o, n, [key]).select(key, "old_outcome", "new_outcome", change.alias("change"), F.round(F.col("new_iou") - F.col("old_iou"), 4).alias("delta"))


def largest_changes(compared: DataFrame, key: str, n: int = 15, least_change: float = 0.02) -> DataFrame:
    return compared.filter(F.abs("delta") > least_change).orderBy(F.abs("delta").desc(), key).limit(n)


def metric_deltas(old: DataFrame, new: DataFrame, names: list[str], higher_is_better: bool = True, tol: float = 0.005) -> DataFrame:
    """Old, new and difference per metric, tagged by direction. Inputs are one-row tables."""
    stack = f"stack({len(names)}, " + ", ".join(f"'{c}', cast({c} as double)" for c in names) + ")"
    o, n = old.selectExpr(f"{stack} as (metric, old_value)"), new.selectExpr(f"{stack} as (metric, new_value)")
    d = F.round(F.col("new_value") - F.col("old_value"), 9)
    up, down = (d > tol), (d < -tol)
    better, worse = (up, down) if higher_is_better else (down, up)
    return join_on(o, n, ["metric"]).select("metric", "old_value", "new_value", d.alias("delta"), F.when(better, "better").when(worse, "worse").otherwise("same").alias("tag"))


def first_prediction_mode(df: DataFrame, keys: tuple[str, ...], value: str, order: str, ignore: tuple[str, ...] = ("", "unknown")) -> DataFrame:
    """Most frequent value per key, the one seen first on a tie."""
    c = df.filter(F.col(value).isNotNull() & ~F.col(value).isin(*ignore)).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    return c.groupBy(*keys).agg(F.max_by(value, F.struct(F.col("n"), -F.col("_first"))).alias(value), F.max("n").alias("n"))
