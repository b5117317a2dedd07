"""Registered queries: temporal graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronotrace.operators import audit, metrics as m, temporal_graph as tg
from chronotrace.operators.ordered import join_on
from chronotrace.plans import reports as rp
from chronotrace.plans import views as v
from chronotrace.plans.registry import query

K = ("video_id", "entity_id")

NUMBERED = """numbered AS (SELECT *, row_number() OVER (PARTITION BY video_id, entity_id ORDER BY t, event_id) - 1 AS seq FROM nodes)"""
EDGES = (
    NUMBERED
    + """, links AS (SELECT video_id, entity_id, event_id AS edge_key, lag(seq) OVER w AS src_seq, seq, lag(t) OVER w AS src_t, t AS dst_t,
  lag(frame_idx) OVER w AS src_frame, frame_idx AS dst_frame, lag(action) OVER w AS action_from, action AS action_to FROM numbered
  WINDOW w AS (PARTITION BY video_id, entity_id ORDER BY t, event_id)),
edges AS (SELECT l.video_id, l.entity_id, l.edge_key, l.src_seq, l.seq, l.src_t, l.dst_t, l.src_frame, l.dst_frame, l.action_from, l.action_to,
  l.dst_t - l.src_t AS duration, coalesce(sum(o.energy), 0) AS kinetic_integral, count(o.event_id) AS n_trace,
  CASE WHEN count(o.event_id) >= 2 THEN greatest(0, max(o.frame_idx) - min(o.frame_idx) - count(o.event_id)) ELSE 0 END AS missing_frames
  FROM links l LEFT JOIN obs o ON o.video_id = l.video_id AND o.entity_id = l.entity_id AND o.t BETWEEN l.src_t AND l.dst_t
  WHERE l.src_seq IS NOT NULL GROUP BY ALL)"""
)
ROLLUP = (
    EDGES
    + """, er AS (SELECT video_id, entity_id, sum(round(kinetic_integral, 4)) AS total_kinetic, count(*) AS num_edges FROM edges GROUP BY ALL),
rollup AS (SELECT n.video_id, n.entity_id, min(t) AS birth_time, max(t) AS last_time, max(t) - min(t) AS duration, max(danger) AS max_danger,
  bool_or(suspicious) AS has_suspicious, count(*) AS num_nodes, coalesce(any_value(total_kinetic), 0) AS total_kinetic,
  coalesce(any_value(num_edges), 0) AS num_edges FROM nodes n LEFT JOIN er USING (video_id, entity_id) GROUP BY ALL),
cand AS (SELECT *, total_kinetic > 7.0 AS has_alert FROM rollup),
ranked AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY round(audit_score, 9) DESC, entity_id) AS audit_rank FROM (
  SELECT *, max_danger * 2.0 + num_nodes * CAST(0.1 AS DOUBLE) + CASE WHEN has_alert THEN 0.5 ELSE 0.0 END AS audit_score FROM cand
  WHERE has_suspicious OR max_danger >= 0.2 OR has_alert) QUALIFY audit_rank <= 12)"""
)

query(
    "recording_report",
    f"WITH {ROLLUP} SELECT video_id, bool_or(audit_score >= 4.0) AS is_anomaly, round(max(CASE WHEN audit_score >= 4.0 THEN audit_score END), 6) AS top_score,"
    " CAST(sum(CAST(audit_score >= 4.0 AS INT)) AS BIGINT) AS n_anomalous, count(*) AS n_audited, round(min(birth_time), 6) AS first_seen,"
    " round(max(last_time), 6) AS last_seen, round(sum(total_kinetic), 3) AS total_kinetic FROM ranked GROUP BY video_id",
    "obs nodes",
)(rp.recording_report)


@query("w08_temporal_edges", f"WITH {EDGES} SELECT video_id, entity_id, edge_key, 'E'||entity_id||'_E'||entity_id||'_N'||src_seq||'_E'||entity_id||'_N'||seq AS edge_id, action_from||' → '||action_to AS action_transition, round(duration, 6) AS duration FROM edges", "obs nodes")
def temporal_edges(spark, d):
    e = tg.edge_ids(tg.link_nodes(v.nodes(spark, d), v.ENTITY_LANE))
    return e.select(*K, "edge_key", "edge_id", "action_transition", F.round("duration", 6).alias("duration"))


@query("w08_weighted_edges", f"""WITH {EDGES}, same AS (SELECT *, CASE WHEN action_from = action_to THEN CAST(0.9 AS DOUBLE) ELSE 0.5 END AS action_score FROM edges WHERE duration > 0 AND duration <= 30.0)
SELECT video_id, edge_key, action_score, round(0.32 + 0.6 * action_score, 6) AS weight FROM same""", "obs nodes")
def weighted_edges(spark, d):
    e = tg.link_nodes(v.nodes(spark, d), v.ENTITY_LANE)
    e = tg.weighted_edges(e, F.when(F.col("action_from") == F.col("action_to"), 0.9).otherwise(0.5))
    return e.select("video_id", "edge_key", "action_score", F.round("weight", 6).alias("weight"))


@query("w09_node_sequence", f"WITH {NUMBERED} SELECT event_id, 'E'||entity_id||'_N'||seq AS node_id, seq FROM numbered", "obs nodes")
def node_sequence(spark, d):
    return tg.number_nodes(v.nodes(spark, d), v.ENTITY_LANE).select("event_id", "node_id", "seq")


@query("w10_latest_nodes", f"WITH {NUMBERED} SELECT event_id, entity_id FROM nodes QUALIFY row_number() OVER (PARTITION BY video_id, entity_id ORDER BY t DESC, event_id DESC) <= 20", "obs nodes")
def latest_nodes(spark, d):
    return tg.latest_nodes(v.nodes(spark, d), K, 20, "t", "event_id").select("event_id", "entity_id")


@query("j09_node_trace_lookup", """WITH tr AS (SELECT video_id, entity_id, frame_idx, arg_max(energy, (t, event_id)) AS kinetic, arg_max(x, (t, event_id)) AS bx, arg_max(h, (t, event_id)) AS bh FROM obs GROUP BY ALL)
SELECT n.event_id, kinetic, bx, bh FROM nodes n JOIN tr USING (video_id, entity_id, frame_idx)""", "obs nodes")
def node_trace_lookup(spark, d):
    n = tg.node_energy(v.nodes(spark, d), v.obs(spark, d), K)
    return n.select("event_id", "kinetic", F.col("bbox.x").alias("bx"), F.col("bbox.h").alias("bh"))


@query("j10_trace_totals_on_edges", f"WITH {EDGES} SELECT video_id, edge_key, round(kinetic_integral, 6) AS kinetic_integral, n_trace, missing_frames FROM edges", "obs nodes")
def trace_totals(spark, d):
    return rp.entity_edges(spark, d).select("video_id", "edge_key", F.round("kinetic_integral", 6).alias("kinetic_integral"), "n_trace", "missing_frames")


@query("j11_frame_energy_on_edges", f"""WITH {EDGES}, fe AS (SELECT video_id, frame_idx, max(energy) AS e FROM obs GROUP BY ALL)
SELECT l.video_id, l.edge_key, round(sum(e), 9) AS energy_integral, round(avg(e), 9) AS energy_avg FROM links l JOIN fe ON fe.video_id = l.video_id AND fe.frame_idx BETWEEN l.src_frame AND l.dst_frame
WHERE src_seq IS NOT NULL GROUP BY ALL""", "obs nodes")
def frame_energy_on_edges(spark, d):
    fe = v.obs(spark, d).groupBy("video_id", "frame_idx").agg(F.max("energy").alias("frame_energy"))
    e = tg.add_frame_energy(tg.link_nodes(v.nodes(spark, d), v.ENTITY_LANE), fe)
    return e.select("video_id", "edge_key", F.round("energy_integral", 9).alias("energy_integral"), F.round("energy_avg", 9).alias("energy_avg"))


@query("a25_entity_rollup", f"WITH {ROLLUP} SELECT video_id, entity_id, round(birth_time, 6) AS birth_time, round(last_time, 6) AS last_time, round(duration, 6) AS duration, round(total_kinetic, 4) AS total_kinetic, max_danger, has_suspicious, num_nodes, num_edges FROM rollup", "obs nodes")
def entity_rollup(spark, d):
    r = rp.entity_rollup(spark, d)
    return r.select(*K, *[F.round(c, 6).alias(c) for c in ("birth_time", "last_time", "duration")], F.round("total_kinetic", 4).alias("total_kinetic"), "max_danger", "has_suspicious", "num_nodes", "num_edges")


@query("t01_ranked_audit_list", f"WITH {ROLLUP} SELECT video_id, entity_id, round(audit_score, 6) AS audit_score, audit_rank FROM ranked", "obs nodes")
def ranked_audit(spark, d):
    return rp.ranked_audit(spark, d).select(*K, F.round("audit_score", 6).alias("audit_score"), "audit_rank")


@query("t02_longest_paths", "SELECT video_id, entity_id, n AS num_nodes, row_number() OVER (PARTITION BY video_id ORDER BY n DESC, entity_id) AS path_rank FROM (SELECT video_id, entity_id, count(*) AS n FROM nodes GROUP BY ALL) QUALIFY path_rank <= 8", "obs nodes")
def longest_paths(spark, d):
    r = v.nodes(spark, d).groupBy(*K).agg(F.count(F.lit(1)).alias("num_nodes"))
    return audit.longest_paths(r).select(*K, "num_nodes", "path_rank")


@query("p12_minimum_path", "SELECT video_id, entity_id, count(*) AS num_nodes FROM nodes GROUP BY ALL HAVING count(*) >= 50", "obs nodes")
def minimum_path(spark, d):
    return v.nodes(spark, d).groupBy(*K).agg(F.count(F.lit(1)).alias("num_nodes")).filter("num_nodes >= 50")


@query("p11_audit_candidates", """WITH r AS (SELECT video_id, entity_id, bool_or(suspicious) AS hs, max(danger) AS md, max(energy) AS me FROM obs GROUP BY ALL),
dr AS (SELECT video_id, max(danger) - min(danger) - 0.5 AS max_drift FROM obs GROUP BY ALL)
SELECT video_id, entity_id, md AS max_danger, me > 0.5 AS has_alert FROM r JOIN dr USING (video_id) WHERE hs OR md >= 0.2 OR me > 0.5 OR max_drift > 0.25""", "obs")
def audit_candidates(spark, d):
    o = v.obs(spark, d)
    r = o.groupBy(*K).agg(F.bool_or("suspicious").alias("has_suspicious"), F.max("danger").alias("max_danger"), F.max("energy").alias("_me"))
    drift = o.groupBy("video_id").agg((F.max("danger") - F.min("danger") - 0.5).alias("max_drift"))
    return audit.audit_candidates(r, r.filter("_me > 0.5"), drift).select(*K, "max_danger", "has_alert")


@query("p13_path_change_audit", """WITH now AS (SELECT video_id, entity_id, count(*) AS n, max(danger) AS md FROM nodes GROUP BY ALL), bef AS (SELECT video_id, entity_id, count(*) AS p FROM nodes WHERE t < 700 GROUP BY ALL)
SELECT video_id, entity_id, n AS num_nodes, n > coalesce(p, 0) AS grew, md >= 0.75 AS danger_signal FROM now LEFT JOIN bef USING (video_id, entity_id) WHERE n > coalesce(p, 0) OR md >= 0.75""", "obs nodes")
def path_change_audit(spark, d):
    n = v.nodes(spark, d)
    now = n.groupBy(*K).agg(F.count(F.lit(1)).alias("num_nodes"), F.max("danger").alias("max_danger"))
    bef = n.filter("t < 700").groupBy(*K).agg(F.count(F.lit(1)).alias("num_nodes"))
    return audit.path_change_audit(now, bef, 0.75).select(*K, "num_nodes", "grew", "danger_signal")


@query("a26_temporal_graph_stats", f"""WITH {EDGES}, pl AS (SELECT video_id, entity_id, count(*) AS n FROM nodes GROUP BY ALL),
p AS (SELECT video_id, CAST(sum(n) AS BIGINT) AS num_nodes, count(*) AS num_entities, avg(n) AS avg_path_length, max(n) AS max_path_length FROM pl GROUP BY ALL),
e AS (SELECT video_id, count(*) AS num_edges, avg(w) AS aw, min(w) AS mw, sum(kinetic_integral) AS te, avg(kinetic_integral) AS ae FROM (
 SELECT *, 0.32 + 0.6 * CASE WHEN action_from = action_to THEN CAST(0.9 AS DOUBLE) ELSE 0.5 END AS w FROM edges WHERE duration > 0 AND duration <= 30.0) GROUP BY ALL)
SELECT video_id, num_nodes, num_entities, round(avg_path_length, 6) AS avg_path_length, max_path_length, num_edges, round(aw, 6) AS avg_edge_weight, round(mw, 6) AS min_edge_weight, round(te, 5) AS total_energy, round(ae, 9) AS avg_energy FROM p JOIN e USING (video_id)""", "obs nodes")
def temporal_graph_stats(spark, d):
    e = tg.weighted_edges(rp.entity_edges(spark, d), F.when(F.col("action_from") == F.col("action_to"), 0.9).otherwise(0.5))
    s = tg.graph_stats(v.nodes(spark, d), e.withColumn("energy_integral", F.col("kinetic_integral")))
    r6 = ("avg_path_length", "avg_edge_weight", "min_edge_weight")
    return s.select("video_id", "num_nodes", "num_entities", "max_path_length", "num_edges", F.round("total_energy", 5).alias("total_energy"), F.round("avg_energy", 9).alias("avg_energy"), *[F.round(c, 6).alias(c) for c in r6])


@query("a41_action_sequence", """WITH l AS (SELECT *, (row_number() OVER (PARTITION BY video_id, entity_id ORDER BY t, event_id) - 1) // 1000 AS page FROM nodes)
SELECT video_id, entity_id, page, string_agg(action, ' → ' ORDER BY t, event_id) AS actions FROM l GROUP BY ALL""", "obs nodes")
def action_sequence(spark, d):
    return tg.sequence_text(v.nodes(spark, d), v.ENTITY_LANE, "action").select(*K, "page", F.col("text").alias("actions"))


@query("g05_snapshot_nodes", "SELECT event_id, 'e'||entity_id||'_f'||frame_idx AS node_id, action, danger >= 0.6 AS danger_signal FROM obs WHERE entity_id IS NOT NULL", "obs")
def snapshot_nodes(spark, d):
    o = v.obs(spark, d).filter("entity_id is not null")
    return o.select("event_id", F.format_string("e%d_f%d", "entity_id", "frame_idx").alias("node_id"), "action", (F.col("danger") >= 0.6).alias("danger_signal"))


@query("g06_path_data", f"""WITH {EDGES}, l AS (SELECT *, (row_number() OVER (PARTITION BY video_id, entity_id ORDER BY t, event_id) - 1) // 1000 AS page FROM nodes),
p AS (SELECT video_id, entity_id, page, string_agg(action, '>' ORDER BY t, event_id) AS path FROM l GROUP BY ALL), m AS (SELECT video_id, entity_id, max(danger) AS max_danger FROM nodes GROUP BY ALL),
e AS (SELECT video_id, entity_id, sum(kinetic_integral) AS te FROM edges GROUP BY ALL)
SELECT video_id, entity_id, page, path, max_danger, round(te, 5) AS total_energy FROM p JOIN m USING (video_id, entity_id) LEFT JOIN e USING (video_id, entity_id)""", "obs nodes")
def path_data(spark, d):
    n = v.nodes(spark, d)
    p = tg.sequence_text(n, v.ENTITY_LANE, "action", ">").select(*K, "page", F.col("text").alias("path"))
    md = n.groupBy(*K).agg(F.max("danger").alias("max_danger"))
    e = rp.entity_edges(spark, d).groupBy(*K).agg(F.round(F.sum("kinetic_integral"), 5).alias("total_energy"))
    return join_on(join_on(p, md, K), e, K, "left")


@query("g07_danger_timeline", """WITH l AS (SELECT *, (row_number() OVER (PARTITION BY video_id, entity_id ORDER BY t, event_id) - 1) // 1000 AS page FROM nodes)
SELECT video_id, entity_id, page, string_agg(frame_idx||':'||CAST(CAST(round(danger * 100) AS INT) AS VARCHAR), ' ' ORDER BY t, event_id) AS timeline FROM l GROUP BY ALL""", "obs nodes")
def danger_timeline(spark, d):
    n = v.nodes(spark, d).withColumn("_p", F.concat_ws(":", F.col("frame_idx").cast("string"), F.round(F.col("danger") * 100).cast("int").cast("string")))
    return tg.sequence_text(n, v.ENTITY_LANE, "_p", " ").select(*K, "page", F.col("text").alias("timeline"))


@query("g08_nested_export", f"""WITH {ROLLUP}, ln AS (SELECT *, seq // 1000 AS page FROM numbered), le AS (SELECT *, src_seq // 1000 AS page FROM edges),
n AS (SELECT video_id, entity_id, page, count(*) AS n_nodes, string_agg('E'||entity_id||'_N'||seq, ',' ORDER BY seq) AS node_ids, round(sum(round(energy, 4)), 6) AS node_energy FROM ln GROUP BY ALL),
e AS (SELECT video_id, entity_id, page, count(*) AS n_edges, round(sum(round(kinetic_integral, 4)), 6) AS edge_energy, CAST(sum(missing_frames) AS BIGINT) AS missing FROM le GROUP BY ALL)
SELECT video_id, entity_id, n_nodes, node_ids, node_energy, n_edges, edge_energy, missing, num_nodes FROM rollup JOIN n USING (video_id, entity_id) JOIN e USING (video_id, entity_id, page)""", "obs nodes")
def nested_export(spark, d):
    n, e = tg.number_nodes(v.nodes(spark, d), v.ENTITY_LANE), rp.entity_edges(spark, d)
    g = tg.nested_graphs(n, e, rp.entity_rollup(spark, d), K)
    sm = lambda arr, f: F.aggregate(arr, F.lit(0.0), lambda s, x: s + x[f])
    return g.select(
        *K, F.size("nodes").cast("long").alias("n_nodes"), F.array_join(F.transform("nodes", lambda x: x["node_id"]), ",").alias("node_ids"),
        F.round(sm("nodes", "kinetic"), 6).alias("node_energy"), F.size("edges").cast("long").alias("n_edges"), F.round(sm("edges", "kinetic_integral"), 6).alias("edge_energy"),
        F.aggregate("edges", F.lit(0).cast("long"), lambda s, x: s + x["missing_frames"]).alias("missing"), "num_nodes",
    )


@query("g09_trigger_list", "SELECT video_id, event_id, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) AS trigger_id, action FROM nodes", "obs nodes")
def trigger_list(spark, d):
    return tg.trigger_rows(v.nodes(spark, d), v.OBS_LANE).select("video_id", "event_id", "trigger_id", "action")


@query("g10_trajectory_view", "SELECT o.event_id, round(o.t, 6) AS t, round(energy, 6) AS energy, action <> 'view' AS is_node, is_anomaly AND t BETWEEN start_sec AND end_sec AS in_interval FROM obs o JOIN verdicts v USING (video_id, entity_id)", "obs verdicts")
def trajectory_view(spark, d):
    j = join_on(v.obs(spark, d), v.verdicts(spark, d), K)
    return j.select("event_id", F.round("t", 6).alias("t"), F.round("energy", 6).alias("energy"), (F.col("action") != "view").alias("is_node"), (F.col("is_anomaly") & F.col("t").between(F.col("start_sec"), F.col("end_sec"))).alias("in_interval"))


@query("a24_dominant_scene", """SELECT video_id, arg_max(action, (n, -f)) AS scene, max(n) AS n FROM (SELECT video_id, action, count(*) AS n, min(event_id) AS f FROM obs WHERE action <> 'unknown' GROUP BY ALL) GROUP BY ALL""", "obs")
def dominant_scene(spark, d):
    return m.first_prediction_mode(v.obs(spark, d), ("video_id",), "action", "event_id").withColumnRenamed("action", "scene")


@query("a28_trajectory_summary", """SELECT video_id, entity_id, count(*) AS n, round(max(t) - min(t), 6) AS duration, round(avg(energy), 6) AS mean_e, round(max(energy), 6) AS max_e, round(sum(energy), 5) AS sum_e,
round(sqrt(pow(arg_max(x, (t, event_id)) - arg_min(x, (t, event_id)), 2) + pow(arg_max(y, (t, event_id)) - arg_min(y, (t, event_id)), 2)), 5) AS displacement FROM obs GROUP BY ALL""", "obs")
def trajectory_summary(spark, d):
    o = F.struct("t", "event_id")
    g = v.obs(spark, d).groupBy(*K).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("t") - F.min("t"), 6).alias("duration"), F.round(F.avg("energy"), 6).alias("mean_e"), F.round(F.max("energy"), 6).alias("max_e"),
        F.round(F.sum("energy"), 5).alias("sum_e"), F.min_by(F.struct("x", "y"), o).alias("_a"), F.max_by(F.struct("x", "y"), o).alias("_b"),
    )
    dx, dy = F.col("_b.x") - F.col("_a.x"), F.col("_b.y") - F.col("_a.y")
    return g.withColumn("displacement", F.round(F.sqrt(dx * dx + dy * dy), 5)).drop("_a", "_b")


@query("a29_hint_counts", """SELECT entity_id, string_agg(action||'='||n, ',' ORDER BY action) AS hints FROM (SELECT entity_id, action, count(*) AS n FROM obs WHERE action NOT IN ('view', 'none', 'unknown', '') GROUP BY ALL) GROUP BY ALL""", "obs")
def hint_counts(spark, d):
    c = v.obs(spark, d).filter(~F.col("action").isin("view", "none", "unknown", "")).groupBy("entity_id", "action").agg(F.count(F.lit(1)).alias("n"))
    g = c.groupBy("entity_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("action", "n")))).alias("hints"))
    return g.select("entity_id", F.array_join(F.transform(F.map_entries("hints"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",").alias("hints"))


VERD = "SELECT video_id, entity_id, is_anomaly, confidence, start_sec, end_sec, CASE WHEN entity_id % 2 = 0 THEN 'person near checkout without paying' ELSE 'kinetic energy' END AS reason, entity_id % 7 = 3 AS film FROM verdicts"


def _verdicts(spark, d):
    return v.verdicts(spark, d).select(
        "*", F.when(F.col("entity_id") % 2 == 0, "person near checkout without paying").otherwise("kinetic energy").alias("reason"), (F.col("entity_id") % 7 == 3).alias("film_false_alarm")
    )


@query("p16_confidence_gate", f"WITH a AS ({VERD}) SELECT entity_id, confidence FROM a WHERE is_anomaly AND NOT film AND confidence >= 0.5", "verdicts")
def confidence_gate(spark, d):
    return _verdicts(spark, d).filter(audit.confidence_gate()).select("entity_id", "confidence")


@query("p17_film_attenuation", f"WITH a AS ({VERD}) SELECT entity_id, round(CASE WHEN video_id % 2 = 0 AND is_anomaly AND NOT film THEN confidence * 0.7 ELSE confidence END, 6) AS confidence FROM a", "verdicts")
def film_attenuation(spark, d):
    return audit.attenuate_film(_verdicts(spark, d), F.col("video_id") % 2 == 0).select("entity_id", F.round("confidence", 6).alias("confidence"))


@query("p18_saturation_suppression", f"""WITH a AS ({VERD}), p AS (SELECT *, is_anomaly AND NOT film AND confidence >= 0.5 AS passed FROM a),
g AS (SELECT video_id, count(*) AS n, count(*) FILTER (passed) AS f, string_agg(CASE WHEN passed THEN reason END, ' ') AS txt FROM p GROUP BY ALL),
s AS (SELECT video_id, n >= 3 AND f >= 2 AND f / n >= 0.5 AND (CAST(contains(txt, 'shoplifting') AS INT) + CAST(contains(txt, 'shoplift') AS INT) + CAST(contains(txt, 'checkout') AS INT) + CAST(contains(txt, 'without paying') AS INT) >= 2) AS sat FROM g)
SELECT entity_id, confidence FROM p JOIN s USING (video_id) WHERE passed AND (NOT sat OR confidence >= 0.95)""", "verdicts")
def saturation(spark, d):
    p = _verdicts(spark, d).withColumn("passed", audit.confidence_gate())
    return audit.saturation_filter(p).select("entity_id", "confidence")


@query("a30_recording_verdict", f"""WITH a AS ({VERD}), p AS (SELECT *, is_anomaly AND NOT film AND confidence >= 0.5 AS passed FROM a)
SELECT video_id, bool_or(passed) AS is_anomaly, coalesce(max(confidence) FILTER (passed), 0) AS confidence, count(*) FILTER (passed) AS n_anomalous, count(*) AS n_audited, round(min(start_sec) FILTER (passed), 6) AS first_start, round(max(end_sec) FILTER (passed), 6) AS last_end FROM p GROUP BY ALL""", "verdicts")
def recording_verdict(spark, d):
    r = audit.recording_rollup(_verdicts(spark, d), audit.confidence_gate())
    return r.withColumn("first_start", F.round("first_start", 6)).withColumn("last_end", F.round("last_end", 6))


@query("a30_verdict_summary", f"""WITH a AS ({VERD}), f AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY confidence DESC, entity_id) AS r FROM a WHERE is_anomaly AND NOT film),
s AS (SELECT video_id, string_agg('Entity #'||entity_id||': '||reason, '; ' ORDER BY r) AS s FROM f GROUP BY video_id) SELECT video_id, coalesce(s, 'No anomaly detected.') AS summary FROM (SELECT DISTINCT video_id FROM a) LEFT JOIN s USING (video_id)""", "verdicts")
def verdict_summary(spark, d):
    # The check leaves the formatted numbers out: their half-way rounding differs by engine.
    s = audit.verdict_summary(_verdicts(spark, d))
    return s.select("video_id", F.regexp_replace("summary", r" \(conf=[^)]*\)", "").alias("summary"))


@query("a43_vote_suppression", """WITH al AS (SELECT DISTINCT video_id, entity_id FROM obs WHERE energy > 0.6), na AS (SELECT video_id, count(*) AS na FROM al GROUP BY ALL), nt AS (SELECT video_id, count(DISTINCT entity_id) AS nt FROM obs GROUP BY ALL)
SELECT video_id, entity_id FROM al JOIN na USING (video_id) JOIN nt USING (video_id) WHERE NOT (na / nt >= 0.35 AND na >= 2)""", "obs")
def vote_suppression(spark, d):
    o = v.obs(spark, d)
    al = o.filter("energy > 0.6").select(*K).distinct().withColumn("alert_type", F.lit("energy_semantic_gap"))
    return audit.vote_suppression(al, o).select(*K)


@query("w33_verdict_interval", """WITH life AS (SELECT video_id, entity_id, min(t) AS birth, max(t) AS last_t, min(t) FILTER (suspicious OR danger >= 0.3) AS sf, max(t) FILTER (suspicious OR danger >= 0.3) AS sl FROM obs GROUP BY ALL),
b AS (SELECT video_id, entity_id, arg_max(t, (energy, event_id)) AS pt, max(energy) AS pe, CASE WHEN entity_id % 2 = 0 THEN arg_max(t, (energy, event_id)) - 2 ELSE 0 END AS bs, CASE WHEN entity_id % 2 = 0 THEN arg_max(t, (energy, event_id)) + 2 ELSE 0 END AS be FROM obs WHERE energy > 0.5 GROUP BY video_id, entity_id),
st AS (SELECT video_id, entity_id, CASE WHEN entity_id % 3 = 0 THEN start_sec END AS ss, CASE WHEN entity_id % 3 = 0 THEN end_sec END AS se FROM verdicts),
j AS (SELECT * FROM life LEFT JOIN b USING (video_id, entity_id) LEFT JOIN st USING (video_id, entity_id)),
c AS (SELECT video_id, entity_id, greatest(0, CASE WHEN pe IS NOT NULL AND bs > 0 AND be > bs THEN bs WHEN pe IS NOT NULL AND pt > 0 THEN pt - 5 WHEN se > ss THEN ss WHEN sf IS NOT NULL THEN sf - 2 ELSE birth END) AS s,
 CASE WHEN pe IS NOT NULL AND bs > 0 AND be > bs THEN be WHEN pe IS NOT NULL AND pt > 0 THEN pt + 5 WHEN se > ss THEN se WHEN sf IS NOT NULL THEN sl + 5 ELSE last_t + 3 END AS e FROM j)
SELECT video_id, entity_id, round(s, 6) AS start_sec, round(CASE WHEN e <= s THEN s + 6 ELSE e END, 6) AS end_sec FROM c""", "obs verdicts")
def verdict_interval(spark, d):
    o = v.obs(spark, d)
    life = o.groupBy(*K).agg(
        F.min("t").alias("birth_time"), F.max("t").alias("last_time"), F.min(F.when(F.expr("suspicious or danger >= 0.3"), F.col("t"))).alias("susp_first"),
        F.max(F.when(F.expr("suspicious or danger >= 0.3"), F.col("t"))).alias("susp_last"),
    )
    b = o.filter("energy > 0.5").groupBy(*K).agg(F.max_by("t", F.struct("energy", "event_id")).alias("peak_time"), F.max("energy").alias("peak_energy"))
    even = F.col("entity_id") % 2 == 0
    b = b.withColumn("burst_start", F.when(even, F.col("peak_time") - 2).otherwise(0.0)).withColumn("burst_end", F.when(even, F.col("peak_time") + 2).otherwise(0.0))
    third = F.col("entity_id") % 3 == 0
    st = v.verdicts(spark, d).select(*K, F.when(third, F.col("start_sec")).alias("stated_start"), F.when(third, F.col("end_sec")).alias("stated_end"))
    c = audit.choose_interval(join_on(join_on(life, b, K, "left"), st, K, "left"))
    return c.select(*K, F.round("start_sec", 6).alias("start_sec"), F.round("end_sec", 6).alias("end_sec"))

