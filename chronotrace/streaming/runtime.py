"""Sources and bounded runs for Structured Streaming queries."""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from chronotrace.sources.sinks import fresh_path
from chronotrace.streaming.in_order import STATE_SETTINGS, STORE_SETTINGS

EVENT_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("ts", T.TimestampNTZType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("props", T.StringType()),
    ]
)


def event_stream(spark: SparkSession, folder: str, pattern: str = "events*.parquet", files_per_batch: int = 64) -> DataFrame:
    """Event files as a stream with a bounded number of files per micro-batch."""
    s = spark.readStream.schema(EVENT_SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


@contextmanager
def _settings(spark: SparkSession, values: dict[str, str]):
    """Settings that a streaming query copies when it starts; those of the session come back after it."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _run(w, spark: SparkSession, settings: dict[str, str]) -> StreamingQuery:
    with _settings(spark, settings):
        q = w.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return q


def _paths(spark: SparkSession, name: str, path: str | None) -> tuple[str, str]:
    return (f"{path}/rows", f"{path}/progress") if path else (fresh_path(spark, name), fresh_path(spark, f"{name}-progress"))


def _state_settings(stream: DataFrame) -> dict[str, str]:
    """What the state of a stream needs. One that sets rows aside has no timers; that of silent entities has, and
    they fire in batches without data."""
    if "set_aside" in stream.columns:
        return STATE_SETTINGS
    return STORE_SETTINGS if "silent" in stream.columns else {}


def run_available(stream: DataFrame, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Process what is there, in micro-batches, into a parquet table in the shared folder and return that
    table. Progress lives beside it: with the same ``path`` a later run takes up where the last one ended;
    without one, every run starts afresh."""
    spark = stream.sparkSession
    out, progress = _paths(spark, name, path)
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", progress).format("parquet").option("path", out)
    _run(w, spark, _state_settings(stream))
    return spark.read.schema(stream.schema).parquet(out)


def run_split(stream: DataFrame, name: str, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """``run_available`` for a stream with ``set_aside``: its results, and the rows set aside. The two are
    separate folders of one table, written together, so a failure leaves neither without the other."""
    spark = stream.sparkSession
    out, progress = _paths(spark, name, path)
    parted = stream.withColumn("aside", F.col("set_aside").isNotNull())
    w = parted.writeStream.option("checkpointLocation", progress).partitionBy("aside").format("parquet").option("path", out)
    _run(w, spark, STATE_SETTINGS)
    table = spark.read.schema(parted.schema).parquet(out)
    return table.filter("not aside").drop("aside", "set_aside"), table.filter("aside").drop("aside")


class ObservedCounts:
    """What ``observe`` counts under ``name``, one row per micro-batch, read from the progress of a query.

    ``read`` takes what is new; ``each`` is called with every row (batch number and counts), for a display
    or an alarm while the query runs. There are as many rows as micro-batches with data.
    """

    def __init__(self, name: str, each: Callable[[dict], None] | None = None):
        self.name, self.each, self.rows = name, each, {}

    def read(self, q: StreamingQuery) -> None:
        for p in q.recentProgress:
            seen = p.observedMetrics.get(self.name)
            if seen is None or not p.numInputRows or p.batchId in self.rows:
                continue
            self.rows[p.batchId] = {"batch_id": int(p.batchId), **seen.asDict()}
            if self.each:
                self.each(self.rows[p.batchId])

    def table(self, spark: SparkSession, counts: str) -> DataFrame:
        """The rows so far: ``batch_id`` and the observed columns, whose DDL is ``counts``."""
        names = [f.split()[0] for f in counts.split(",")]
        return spark.createDataFrame([(b, *(r[n] for n in names)) for b, r in sorted(self.rows.items())], f"batch_id long, {counts}")


def run_observed(stream: DataFrame, name: str, counts: str, each: Callable[[dict], None] | None = None, path: str | None = None, every: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """``run_available``, and the counts that the stream observed under ``name``, batch by batch. They are
    read every so many seconds while the query runs; Spark keeps the newest hundred batches for that."""
    spark = stream.sparkSession
    out, progress = _paths(spark, name, path)
    q = stream.writeStream.option("checkpointLocation", progress).format("parquet").option("path", out).trigger(availableNow=True).start()
    counted = ObservedCounts(name, each)
    while not q.awaitTermination(every):
        counted.read(q)
    counted.read(q)
    return spark.read.schema(stream.schema).parquet(out), counted.table(spark, counts)
