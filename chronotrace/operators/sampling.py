"""Rankings, deterministic samples and shards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronotrace.operators.ordered import Lane, join_on, number_rows


def top_per_group(df: DataFrame, keys: tuple[str, ...], order: list[Column], n: int, name: str = "place") -> DataFrame:
    """Best ``n`` rows per group; the rank limit also runs before the shuffle."""
    return df.withColumn(name, F.row_number().over(W.partitionBy(*keys).orderBy(*order)).cast("long")).filter(F.col(name) <= n)


def source_bonus(source: Column) -> Column:
    """Ranking bonus by where a region came from."""
    return F.when(source == "fused", 1.0).when(source == "yolo", 0.5).otherwise(0.0)


def stratified_sample(df: DataFrame, key: str, category: str, is_anomaly: Column, total: int) -> DataFrame:
    """Half anomalous, half normal. Each category gives one record in name order, then the
    largest categories give further ones in turn. Only the first ``total`` records of a
    category can ever be chosen, so ranks are limited per category before the final order."""
    n_anom = total // 2
    a = df.filter(is_anomaly)
    sizes = a.groupBy(category).agg(F.count(F.lit(1)).alias("_size"))
    picks = join_on(top_per_group(a.select(key, category), (category,), [F.col(key)], max(n_anom, 1), "_r"), sizes, (category,))
    later = F.col("_r") > 1
    order = [later.cast("int"), F.when(later, F.col("_r")).otherwise(0), F.when(later, -F.col("_size")).otherwise(0), F.col(category), F.col(key)]
    chosen = picks.orderBy(*order).limit(n_anom).select(key, F.lit("anomalous").alias("stratum"))
    normal = df.filter(~is_anomaly).select(key).orderBy(key).limit(total - n_anom).select(key, F.lit("normal").alias("stratum"))
    return chosen.unionByName(normal)


def round_robin(df: DataFrame, lane: Lane, n: int) -> DataFrame:
    """Shard number of each row: its position modulo ``n``."""
    return number_rows(df, lane, "_p").withColumn("shard", F.pmod(F.col("_p") - 1, F.lit(n))).drop("_p")


def stride(df: DataFrame, pos: Column, n: int) -> DataFrame:
    return df.filter(F.pmod(pos, F.lit(n)) == 0)


def capped_stride(df: DataFrame, keys: tuple[str, ...], pos: str, rate: int, max_rows: int) -> DataFrame:
    """Every rate-th row, or a wider stride where that would exceed ``max_rows`` per key.
    ``pos`` is a dense 0-based position, so the cut-off needs no ranking."""
    n = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    d = join_on(df, n, keys)
    step = F.when(F.floor(F.col("_n") / rate) > max_rows, F.greatest(F.lit(rate), F.floor(F.col("_n") / max_rows))).otherwise(F.lit(rate)).cast("long")
    d = d.withColumn("step", step)
    return d.filter((F.col(pos) % F.col("step") == 0) & (F.col(pos) / F.col("step") < max_rows)).drop("_n")
