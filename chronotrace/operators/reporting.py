"""Report tables: priorities, strengths, pool and batch statistics, ablations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotrace.functions.vectors import normalise, weighted_sum
from chronotrace.operators.metrics import n_if
from chronotrace.operators.ordered import join_on

# Causes that lead to a first-priority action.
URGENT_CAUSES = ["ZERO_ENTITY_DETECTION", "VLLM_UNDER_DESCRIPTION", "DISCORDANCE_FALSE_ALARM", "VLLM_HALLUCINATION"]


def priority_actions(causes: DataFrame, categories: DataFrame, tiers: DataFrame, category: str) -> DataFrame:
    """Rule-based to-do list: urgent causes, poor intervals, weak categories."""
    p0 = causes.filter(F.col("cause").isin(URGENT_CAUSES)).groupBy("cause").agg(F.count(F.lit(1)).alias("n")).select(F.lit("P0").alias("priority"), F.col("cause").alias("topic"), "n")
    zero = tiers.filter("tier = 'zero'").agg(F.count(F.lit(1)).alias("n")).filter("n > 0").select(F.lit("P1").alias("priority"), F.lit("interval quality").alias("topic"), "n")
    weak = categories.filter((F.col(category) != "Normal") & (F.col("correct") / F.col("total") < 0.5)).select(
        F.lit("P1").alias("priority"), F.concat(F.lit("category "), F.col(category)).alias("topic"), (F.col("total") - F.col("correct")).alias("n")
    )
    return p0.unionByName(zero).unionByName(weak)


def strengths_and_weaknesses(categories: DataFrame, category: str, good: float = 0.8, poor: float = 0.5) -> DataFrame:
    a = F.col("correct") / F.col("total")
    return categories.filter((a >= good) | (a < poor)).select(category, F.when(a >= good, "strength").otherwise("weakness").alias("kind"), F.round(a, 4).alias("accuracy"))


def pool_stats(obs: DataFrame) -> DataFrame:
    """Entities per recording, how often they appear and how long ago they were last seen."""
    e = obs.groupBy("video_id", "entity_id").agg(F.count(F.lit(1)).alias("n"), F.max("frame_idx").alias("_lf"))
    now = e.groupBy("video_id").agg(F.max("_lf").alias("_now"))
    return join_on(e, now, ("video_id",)).groupBy("video_id").agg(
        F.count(F.lit(1)).alias("total"), F.avg("n").alias("avg_appearances"), F.max("n").alias("max_appearances"), F.avg(F.col("_now") - F.col("_lf")).alias("avg_age")
    )


def snapshot_rules(snaps: DataFrame) -> DataFrame:
    """Fallback verdict from perception alone: one dangerous snapshot, any suspicious entity,
    or a raised average."""
    g = snaps.groupBy("video_id").agg(F.max("danger").alias("mx"), F.avg("danger").alias("av"), F.sum("n_suspicious").alias("ns"))
    z = F.lit(0.0)
    high, susp = F.col("mx") >= 0.45, F.col("ns") > 0
    slow = (F.col("av") >= 0.22) & ~high & ~susp
    conf = F.greatest(F.when(high, F.least(F.col("mx") + 0.2, F.lit(0.9))).otherwise(z), F.when(susp, F.least(0.5 + F.col("ns") * 0.1, F.lit(0.9))).otherwise(z), F.when(slow, 0.5).otherwise(z))
    return g.select("video_id", (high | susp | slow).alias("is_anomaly"), conf.alias("confidence"))


def class_centroids(df: DataFrame, label: str, vec: str) -> DataFrame:
    """Unit-length mean of unit vectors per class (the sum points the same way)."""
    return df.groupBy(label).agg(weighted_sum(vec).alias("_s")).select(label, normalise(F.col("_s")).alias("centroid"))


def ablation_grid(df: DataFrame, thresholds: list[float], gates: list[bool]) -> DataFrame:
    """One summary row per parameter combination, from one pass over the records: each
    record is expanded by the (fixed, small) grid and aggregated before the shuffle."""
    grid = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.lit(g).alias("use_quality")) for t in thresholds for g in gates])
    x = df.withColumn("_g", F.explode(grid)).select("*", "_g.threshold", "_g.use_quality")
    p: Column = (F.col("score") >= F.col("threshold")) & (~F.col("use_quality") | (F.col("quality") == 1))
    gt = F.col("gt") == 1
    return x.groupBy("threshold", "use_quality").agg(n_if(gt & p).alias("tp"), n_if(~gt & p).alias("fp"), F.avg((gt == p).cast("double")).alias("accuracy"))


def batch_summary(records: DataFrame, key: str, score: str, flag: Column) -> DataFrame:
    """Counts and mean score of a batch with its five strongest records."""
    top = F.slice(F.sort_array(F.collect_list(F.struct(F.col(score).alias("s"), F.col(key).alias("k"))), asc=False), 1, 5)
    best = records.orderBy(F.col(score).desc(), F.col(key).desc()).limit(5).agg(top.alias("_t"))
    agg = records.agg(F.count(F.lit(1)).alias("total"), n_if(flag).alias("anomalous"), F.avg(score).alias("mean_score"))
    return agg.withColumn("_t", best.scalar()).select("total", "anomalous", "mean_score", F.transform("_t", lambda x: x["k"]).alias("top"))
