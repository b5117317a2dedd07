"""Writers. Every sink is a plain distributed write; nothing goes through the driver."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotrace.operators.ordered import join_on
from chronotrace.session import shared_dir


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_lines(df: DataFrame, line: Column, path: str, mode: str = "append") -> str:
    df.select(line.alias("value")).write.mode(mode).text(path)
    return path


def append_manifest(df: DataFrame, path: str, by: tuple[str, ...] = ("video_id",), small: bool = False) -> str:
    """Append manifest rows as parquet, partitioned for pruning. ``small`` is for very many folders of a few
    rows: each is written by one task, as one file, and the number of tasks is given, since what a folder
    costs is far more than its bytes say."""
    if small:
        df = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by)
    df.write.mode("append").partitionBy(*by).parquet(path)
    return path


def write_scores(df: DataFrame, path: str) -> str:
    df.write.mode("append").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return path


def write_tsv(df: DataFrame, path: str) -> str:
    df.write.mode("append").option("header", True).option("sep", "\t").csv(path)
    return path


def quarantine(df: DataFrame, bad: Column, reason: Column) -> tuple[DataFrame, DataFrame]:
    """Good rows, and bad rows with the reason they were set aside."""
    flag = F.coalesce(bad, F.lit(True))
    return df.filter(~flag), df.filter(flag).withColumn("quarantine_reason", reason)


def labelled_list(files: DataFrame, annotations: DataFrame, inferred: Column) -> DataFrame:
    """One row per file with category, flag and two interval pairs padded with -1; files
    without annotation take the category inferred from their path."""
    j = join_on(files, annotations, ["video"], "left")
    cat = F.coalesce("category", inferred)
    at = lambda i, f: F.coalesce(F.get("intervals", F.lit(i))[f], F.lit(-1))
    return j.select(
        "video", cat.alias("category"), F.when(F.col("category").isNotNull(), (F.col("category") != "Normal") & (F.size("intervals") > 0)).otherwise(inferred != "Normal").cast("int").alias("is_anomaly"),
        at(0, "s").alias("start1"), at(0, "e").alias("end1"), at(1, "s").alias("start2"), at(1, "e").alias("end2"),
    )


def scores_in_manifest_order(manifest: DataFrame, scores: DataFrame, ordinal: str) -> DataFrame:
    """Manifest rows with their score (-1 where none), carrying the manifest ordinal."""
    return join_on(manifest, scores, ["path"], "left").withColumn("score", F.coalesce("score", F.lit(-1.0))).orderBy(ordinal)


def write_json_rows(df: DataFrame, path: str) -> str:
    """One JSON document per row."""
    df.write.mode("append").json(path)
    return path
