"""Audit selection, verdict gates, suppression and roll-ups per recording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronotrace.operators.ordered import Lane, join_on, number_rows
from chronotrace.params import AuditParams, DiscordanceParams


def audit_candidates(rollup: DataFrame, alerts: DataFrame, drift: DataFrame, p: AuditParams = AuditParams()) -> DataFrame:
    """Entities worth auditing: suspicious, dangerous, contradicted by physics, or any entity
    of a recording whose scene drifted."""
    a = alerts.select("video_id", "entity_id").distinct().withColumn("has_alert", F.lit(True))
    j = join_on(rollup, a, ("video_id", "entity_id"), "left").withColumn("has_alert", F.coalesce("has_alert", F.lit(False)))
    j = join_on(j, drift.select("video_id", "max_drift"), ("video_id",), "left")
    gate = F.col("has_suspicious") | (F.col("max_danger") >= p.danger_gate) | F.col("has_alert") | (F.coalesce("max_drift", F.lit(0.0)) > p.drift_gate)
    return j.filter(gate)


def audit_rank(candidates: DataFrame, p: AuditParams = AuditParams()) -> DataFrame:
    """Top entities per recording by danger, history length and physical alerts."""
    score = F.col("max_danger") * 2.0 + F.col("num_nodes") * 0.1 + F.when(F.col("has_alert"), 0.5).otherwise(0.0)
    w = W.partitionBy("video_id").orderBy(F.round("audit_score", 9).desc(), "entity_id")
    return candidates.withColumn("audit_score", score).withColumn("audit_rank", F.row_number().over(w).cast("long")).filter(F.col("audit_rank") <= p.max_entities)


def longest_paths(rollup: DataFrame, n: int = 8, min_nodes: int = 1) -> DataFrame:
    w = W.partitionBy("video_id").orderBy(F.col("num_nodes").desc(), "entity_id")
    return rollup.filter(F.col("num_nodes") >= min_nodes).withColumn("path_rank", F.row_number().over(w).cast("long")).filter(F.col("path_rank") <= n)


def attenuate_film(verdicts: DataFrame, is_film: Column, p: AuditParams = AuditParams()) -> DataFrame:
    """Lower the confidence of flagged entities in recordings that look like film."""
    hit = is_film & F.col("is_anomaly") & ~F.col("film_false_alarm")
    return verdicts.withColumn("confidence", F.when(hit, F.col("confidence") * p.film_factor).otherwise(F.col("confidence")))


def confidence_gate(p: AuditParams = AuditParams()) -> Column:
    return F.col("is_anomaly") & ~F.col("film_false_alarm") & (F.col("confidence") >= p.confidence)


# Phrases that mark one shared, prompt-induced reason.
BIAS_WORDS = {
    "shoplifting": ["shoplifting", "shoplift", "checkout", "without paying"],
    "kinetic_energy": ["kinetic energy", "energy exceeding", "perception blind spot", "energy threshold"],
    "sports_activity": ["basketball", "soccer", "football", "gameplay", "player", "match"],
}


def saturation_filter(flagged_all: DataFrame, p: AuditParams = AuditParams()) -> DataFrame:
    """Suppress a shared bias: when at least 3 were audited, at least 2 and half of them are
    flagged, and two phrases of one bias group occur among the reasons of the flagged, only
    near-certain verdicts survive. Input holds every audited verdict with ``passed``.

    Phrase hits are aggregated as flags, so reasons are never concatenated.
    """
    low = F.lower(F.col("reason"))
    hit = {f"_h_{g}_{i}": F.max((F.col("passed") & F.contains(low, F.lit(w))).cast("int")) for g, ws in BIAS_WORDS.items() for i, w in enumerate(ws)}
    g = flagged_all.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("_audited"), F.sum(F.col("passed").cast("int")).alias("_flagged"), *[c.alias(n) for n, c in hit.items()]
    )
    biased = F.lit(False)
    for grp, ws in BIAS_WORDS.items():
        total = F.lit(0)
        for i in range(len(ws)):
            total = total + F.col(f"_h_{grp}_{i}")
        biased = biased | (total >= 2)
    sat = (F.col("_audited") >= 3) & (F.col("_flagged") >= 2) & (F.col("_flagged") / F.col("_audited") >= 0.5) & biased
    g = g.select("video_id", sat.alias("saturated"))
    j = join_on(flagged_all, g, ("video_id",))
    return j.filter(F.col("passed") & (~F.col("saturated") | (F.col("confidence") >= p.saturation_confidence)))


def recording_rollup(verdicts: DataFrame, passed: Column) -> DataFrame:
    """Recording verdict: any accepted entity, the largest accepted confidence, how many."""
    return verdicts.groupBy("video_id").agg(
        F.bool_or(passed).alias("is_anomaly"), F.coalesce(F.max(F.when(passed, F.col("confidence"))), F.lit(0.0)).alias("confidence"),
        F.coalesce(F.sum(F.when(passed, 1)), F.lit(0)).cast("long").alias("n_anomalous"), F.count(F.lit(1)).alias("n_audited"),
        F.min(F.when(passed, F.col("start_sec"))).alias("first_start"), F.max(F.when(passed, F.col("end_sec"))).alias("last_end"),
    )


def verdict_summary(verdicts: DataFrame, page: int = 500) -> DataFrame:
    """One row per recording: the summary sentence of its flagged entities, surest first, and their ids.
    Sentences are put together ``page`` entities at a time, then page by page."""
    line = F.concat(
        F.lit("Entity #"), F.col("entity_id").cast("string"), F.lit(": "), F.col("reason"),
        F.format_string(" (conf=%.2f, interval=[%.1fs, %.1fs])", "confidence", "start_sec", "end_sec"),
    )
    v = verdicts.filter("is_anomaly and not film_false_alarm").withColumn("_neg", -F.col("confidence"))
    v = number_rows(v, Lane(("video_id",), ("_neg", "entity_id"), 0.05), "_r").withColumn("_page", F.floor((F.col("_r") - 1) / page))
    g = v.groupBy("video_id", "_page").agg(F.array_sort(F.collect_list(F.struct("_r", line.alias("s")))).alias("_l"), F.collect_list("entity_id").alias("_ids"))
    g = g.select("video_id", F.struct("_page", F.array_join(F.transform("_l", lambda x: x["s"]), "; ").alias("s"), "_ids").alias("_p"))
    g = g.groupBy("video_id").agg(F.array_sort(F.collect_list("_p")).alias("_p"))
    ids = F.array_sort(F.flatten(F.transform("_p", lambda x: x["_ids"])))
    s = g.select("video_id", F.array_join(F.transform("_p", lambda x: x["s"]), "; ").alias("summary"), F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("entity_ids"))
    every = verdicts.select("video_id").distinct()
    return join_on(every, s, ("video_id",), "left").select("video_id", F.coalesce("summary", F.lit("No anomaly detected.")).alias("summary"), F.coalesce("entity_ids", F.lit("")).alias("entity_ids"))


def vote_suppression(alerts: DataFrame, tracked: DataFrame, p: DiscordanceParams = DiscordanceParams()) -> DataFrame:
    """Drop energy alerts of recordings in which many entities raise one: the scene is busy."""
    n_alerted = alerts.filter("alert_type = 'energy_semantic_gap'").groupBy("video_id").agg(F.countDistinct("entity_id").alias("_na"))
    n_tracked = tracked.groupBy("video_id").agg(F.countDistinct("entity_id").alias("_nt"))
    busy = join_on(n_alerted, n_tracked, ("video_id",)).filter((F.col("_na") / F.col("_nt") >= p.vote_ratio) & (F.col("_na") >= p.vote_min)).select("video_id").withColumn("_busy", F.lit(True))
    j = join_on(alerts, busy, ("video_id",), "left")
    return j.filter(F.col("_busy").isNull() | (F.col("alert_type") != "energy_semantic_gap")).drop("_busy")


def path_change_audit(now: DataFrame, before: DataFrame, danger: float = 0.6) -> DataFrame:
    """Entities whose path grew since the last run, or that show a danger signal."""
    b = before.select("video_id", "entity_id", F.col("num_nodes").alias("_prev"))
    j = join_on(now, b, ("video_id", "entity_id"), "left")
    return j.withColumn("grew", F.col("num_nodes") > F.coalesce("_prev", F.lit(0))).withColumn("danger_signal", F.col("max_danger") >= danger).filter("grew or danger_signal").drop("_prev")


def choose_interval(v: DataFrame) -> DataFrame:
    """Interval of a flagged verdict, by falling trust: energy burst, energy peak, the stated
    interval, the suspicious nodes, the whole life. Expects the candidate columns joined in."""
    z = F.lit(0.0)
    has_peak = F.col("peak_energy").isNotNull()
    burst = has_peak & (F.col("burst_start") > 0) & (F.col("burst_end") > F.col("burst_start"))
    peak = has_peak & (F.col("peak_time") > 0)
    stated = F.col("stated_end") > F.col("stated_start")
    susp = F.col("susp_first").isNotNull()
    s = F.when(burst, F.col("burst_start")).when(peak, F.greatest(z, F.col("peak_time") - 5.0)).when(stated, F.greatest(z, F.col("stated_start"))).when(
        susp, F.greatest(z, F.col("susp_first") - 2.0)
    ).otherwise(F.col("birth_time"))
    e = F.when(burst, F.col("burst_end")).when(peak, F.col("peak_time") + 5.0).when(stated, F.col("stated_end")).when(susp, F.col("susp_last") + 5.0).otherwise(F.col("last_time") + 3.0)
    out = v.withColumn("start_sec", F.greatest(z, s)).withColumn("_e", e)
    return out.withColumn("end_sec", F.when(F.col("_e") <= F.col("start_sec"), F.col("start_sec") + 6.0).otherwise(F.col("_e"))).drop("_e")
