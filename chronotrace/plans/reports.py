"""End-to-end compositions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotrace.operators import audit, temporal_graph as tg
from chronotrace.plans import views as v

ENTITY = ("video_id", "entity_id")


def entity_edges(spark: SparkSession, d: str) -> DataFrame:
    e = tg.link_nodes(v.nodes(spark, d), v.ENTITY_LANE)
    return tg.edge_ids(tg.add_trace_totals(e, v.obs(spark, d), ENTITY))


def entity_rollup(spark: SparkSession, d: str) -> DataFrame:
    return tg.entity_rollup(v.nodes(spark, d), entity_edges(spark, d), ENTITY)


def ranked_audit(spark: SparkSession, d: str) -> DataFrame:
    roll = entity_rollup(spark, d).withColumn("has_alert", F.col("total_kinetic") > 7.0)
    return audit.audit_rank(roll.filter("has_suspicious or max_danger >= 0.2 or has_alert"))


def recording_report(spark: SparkSession, d: str) -> DataFrame:
    """Per recording: audited entities, how many exceed the gate, span and energy."""
    r = ranked_audit(spark, d)
    passed = F.col("audit_score") >= 4.0
    g = r.groupBy("video_id").agg(
        F.bool_or(passed).alias("is_anomaly"), F.round(F.max(F.when(passed, F.col("audit_score"))), 6).alias("top_score"),
        F.sum(passed.cast("long")).alias("n_anomalous"), F.count(F.lit(1)).alias("n_audited"),
        F.round(F.min("birth_time"), 6).alias("first_seen"), F.round(F.max("last_time"), 6).alias("last_seen"),
        F.round(F.sum("total_kinetic"), 3).alias("total_kinetic"),
    )
    return g

