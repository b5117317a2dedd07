"""Registered queries: stateful operators, streams and user hooks (ST1-ST16, W29, J21, X1-X7)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from chronotrace.functions import actions as ac
from chronotrace.operators import frames as fr, pulses as pu, regions as rg, scoring as sc, signals as sg, stateful as st, templates as tp, temporal_graph as tg
from chronotrace.operators.ordered import Lane, join_on
from chronotrace.params import GlobalHeartbeatParams
from chronotrace.plans import views as v
from chronotrace.plans.registry import query
from chronotrace.plans.text_queries import alignment_sql, vocab
from chronotrace.plans.window_queries import SAMPLES, SPINE, _spine
from chronotrace.sources.sinks import fresh_path
from chronotrace.streaming import operators as so, runtime as rt

K = ("video_id", "entity_id")
c = F.col


def _vec64(spark, d):
    return v.obs_vec(spark, d)


@query("st01_entity_tracker")
def tracker(spark, d):
    o = _vec64(spark, d).select("video_id", "frame_idx", "event_id", "vec", "energy", F.when(c("k") % 2 == 0, "yolo").otherwise("motion").alias("source"), F.when(c("k") % 3 == 0, "person").otherwise("car").alias("class_name"))
    return st.track_entities(o, st.TrackerParams(similarity=0.2, max_age_frames=60, min_energy_new=0.05))


@query("st02_reidentification")
def reid(spark, d):
    return st.reidentify(_vec64(spark, d), st.PoolParams(similarity=0.2, max_age=600))


# Rows fire by a rule on the time since the last fired row alone here, which SQL can follow.
NEVER = st.TriggerParams(jump=9.0, heartbeat=8.0, min_gap_frames=5)


@query("st03_trigger_gateway", """WITH RECURSIVE o AS (SELECT video_id, entity_id, event_id, t, frame_idx, row_number() OVER (PARTITION BY video_id, entity_id ORDER BY t, event_id) AS i FROM obs),
nx AS MATERIALIZED (SELECT a.video_id, a.entity_id, a.i, min(b.i) AS j FROM o a JOIN o b ON a.video_id = b.video_id AND a.entity_id = b.entity_id AND b.i > a.i AND b.t - a.t >= 8.0 AND b.frame_idx - a.frame_idx >= 5 GROUP BY ALL),
f AS (SELECT video_id, entity_id, i FROM o WHERE i = 1 UNION ALL SELECT f.video_id, f.entity_id, nx.j FROM f JOIN nx ON nx.video_id = f.video_id AND nx.entity_id = f.entity_id AND nx.i = f.i)
SELECT o.event_id, CASE WHEN o.i = 1 THEN 'birth' ELSE 'heartbeat' END AS rule FROM f JOIN o USING (video_id, entity_id, i)""", "obs")
def trigger_gateway(spark, d):
    return st.trigger_rows(_vec64(spark, d), v.ENTITY_LANE, NEVER).select("event_id", "rule")


@query("st03_trigger_rules", """WITH RECURSIVE o AS MATERIALIZED (SELECT video_id, entity_id, event_id, t, frame_idx AS f, CAST(vec AS DOUBLE[]) AS x, row_number() OVER (PARTITION BY video_id, entity_id ORDER BY t, event_id) AS i FROM obs_vec),
r AS (SELECT video_id, entity_id, i, event_id, 'birth' AS rule, CAST(1 AS DOUBLE) AS distance, f AS lf, t AS lt, x AS lx FROM o WHERE i = 1
 UNION ALL SELECT video_id, entity_id, i, event_id, rule, d, CASE WHEN rule IS NULL THEN lf ELSE f END, CASE WHEN rule IS NULL THEN lt ELSE t END, CASE WHEN rule IS NULL THEN lx ELSE x END FROM (
  SELECT *, CASE WHEN f - lf < 5 THEN NULL WHEN d > 0.22 THEN 'change_point' WHEN t - lt >= 3.0 THEN 'heartbeat' END AS rule FROM (
   SELECT o.*, r.lf, r.lt, r.lx, 1 - list_inner_product(o.x, r.lx) AS d FROM r JOIN o ON o.video_id = r.video_id AND o.entity_id = r.entity_id AND o.i = r.i + 1)))
SELECT event_id, rule, round(distance, 5) AS distance FROM r WHERE rule IS NOT NULL""", "obs_vec")
def trigger_rules(spark, d):
    return st.trigger_rows(_vec64(spark, d), v.ENTITY_LANE).select("event_id", "rule", F.round("distance", 5).alias("distance"))


# Steps of an entity: its rows of a frame, then the end of every frame of the recording from its first on.
SILENCE = """WITH RECURSIVE fr AS (SELECT video_id, frame_idx AS f, max_by(t, (entity_id, event_id)) AS t FROM obs_vec GROUP BY ALL),
st AS (SELECT v.video_id, v.entity_id, v.frame_idx AS f, fr.t, v.event_id, CAST(v.vec AS DOUBLE[]) AS x FROM obs_vec v JOIN fr ON fr.video_id = v.video_id AND fr.f = v.frame_idx
 UNION ALL SELECT b.video_id, b.entity_id, fr.f, fr.t, NULL, NULL FROM (SELECT video_id, entity_id, min(frame_idx) AS f0 FROM obs_vec GROUP BY ALL) b JOIN fr ON fr.video_id = b.video_id AND fr.f >= b.f0),
o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY video_id, entity_id ORDER BY f, event_id IS NULL, event_id) AS i FROM st),
r AS (SELECT video_id, entity_id, i, f, t, false AS silent, 'birth' AS rule, CAST(1 AS DOUBLE) AS distance, f AS sf, x AS sx, f AS lf, t AS lt, x AS lx FROM o WHERE i = 1
 UNION ALL SELECT video_id, entity_id, i, f, t, silent, rule, d, nf, nx, CASE WHEN rule IS NULL THEN lf ELSE f END, CASE WHEN rule IS NULL THEN lt ELSE t END, CASE WHEN rule IS NULL THEN lx ELSE nx END FROM (
  SELECT *, CASE WHEN silent AND f - nf <= 150 AND t - lt >= 3.0 THEN 'heartbeat' WHEN silent OR f - lf < 5 THEN NULL WHEN d > 0.22 THEN 'change_point' WHEN t - lt >= 3.0 THEN 'heartbeat' END AS rule FROM (
   SELECT *, 1 - list_inner_product(nx, lx) AS d FROM (
    SELECT o.video_id, o.entity_id, o.i, o.f, o.t, o.x IS NULL AS silent, CASE WHEN o.x IS NULL THEN r.sf ELSE o.f END AS nf, CASE WHEN o.x IS NULL THEN r.sx ELSE o.x END AS nx, r.lf, r.lt, r.lx
    FROM r JOIN o ON o.video_id = r.video_id AND o.entity_id = r.entity_id AND o.i = r.i + 1))))"""


@query("st04_silent_heartbeats", SILENCE + "\nSELECT video_id, entity_id, f AS frame_idx, t, silent, round(distance, 5) AS distance, rule FROM r WHERE rule IS NOT NULL", "obs_vec")
def silent(spark, d):
    return st.triggers_with_silence(_vec64(spark, d)).withColumn("distance", F.round("distance", 5))


@query("st05_global_heartbeat", """WITH RECURSIVE o AS (SELECT video_id, event_id, t, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) AS i FROM obs),
nx AS MATERIALIZED (SELECT a.video_id, a.i, min(b.i) AS j FROM o a JOIN o b ON a.video_id = b.video_id AND b.i > a.i AND b.t - a.t >= 4.0 GROUP BY ALL),
f AS (SELECT video_id, i FROM o WHERE i = 1 UNION ALL SELECT f.video_id, nx.j FROM f JOIN nx ON nx.video_id = f.video_id AND nx.i = f.i)
SELECT o.event_id, 'periodic' AS reason FROM f JOIN o USING (video_id, i)""", "obs")
def pulse(spark, d):
    return pu.global_heartbeats(_vec64(spark, d), GlobalHeartbeatParams(drift=9.0)).select("event_id", "reason")


PULSES = """WITH RECURSIVE o AS MATERIALIZED (SELECT video_id, event_id, t, CAST(vec AS DOUBLE[]) AS x, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) AS i FROM obs_vec),
r AS (SELECT video_id, i, event_id, t, CAST(0 AS DOUBLE) AS drift, true AS due, false AS moved, t AS last, x AS base FROM o WHERE i = 1
 UNION ALL SELECT video_id, i, event_id, t, drift, due, moved, CASE WHEN due OR moved THEN t ELSE last END, CASE WHEN moved THEN x ELSE base END FROM (
  SELECT o.*, 1 - list_inner_product(o.x, r.base) AS drift, o.t - r.last >= 4.0 AS due, 1 - list_inner_product(o.x, r.base) > 1.1 AS moved, r.last, r.base FROM r JOIN o ON o.video_id = r.video_id AND o.i = r.i + 1))
SELECT video_id, t, event_id, CASE WHEN moved THEN 'drift' ELSE 'periodic' END AS reason, round(CASE WHEN i = 1 THEN 1 - list_inner_product(base, base) ELSE drift END, 5) AS drift FROM r WHERE due OR moved"""


@query("st05_global_heartbeat_drift", PULSES, "obs_vec")
def pulse_drift(spark, d):
    return pu.global_heartbeats(_vec64(spark, d), GlobalHeartbeatParams(drift=1.1)).withColumn("drift", F.round("drift", 5))


def _counts(spark, d):
    """Dense recording seconds with the number of energetic regions in each."""
    n = v.obs(spark, d).filter("energy > 0.2").groupBy("video_id", F.floor("t").cast("long").alias("frame_idx")).agg(F.count(F.lit(1)).alias("n"))
    return join_on(_spine(spark, d), n, ("video_id", "frame_idx"), "left").withColumn("n", F.coalesce("n", F.lit(0)))


SECOND_LANE = Lane(("video_id",), ("frame_idx",), 120)
CNT = "cn AS (SELECT sp.video_id, sp.frame_idx, count(o.event_id) AS n FROM sp LEFT JOIN (SELECT * FROM obs WHERE energy > 0.2) o ON o.video_id = sp.video_id AND CAST(floor(o.t) AS BIGINT) = sp.frame_idx GROUP BY ALL)"


@query("st06_adaptive_threshold", f"""WITH RECURSIVE {SPINE}, {CNT}, m AS (SELECT video_id, frame_idx, CASE WHEN n > 0 THEN 0 ELSE 1 END AS streak, CAST(20 AS BIGINT) AS thr FROM cn WHERE frame_idx = 0
UNION ALL SELECT cn.video_id, cn.frame_idx, CASE WHEN n > 0 THEN 0 ELSE m.streak + 1 END, CAST(CASE WHEN n > 0 THEN least(m.thr + 1, 20) WHEN m.streak + 1 >= 4 THEN greatest(m.thr - 1, 8) ELSE m.thr END AS BIGINT) FROM m JOIN cn ON cn.video_id = m.video_id AND cn.frame_idx = m.frame_idx + 1)
SELECT video_id, frame_idx, thr AS threshold FROM m""", "obs verdicts")
def adaptive_threshold(spark, d):
    return st.threshold_machine(_counts(spark, d), SECOND_LANE, "n", 20, 8, 4).select("video_id", "frame_idx", "threshold")


@query("st06_fallback_detector", f"""WITH RECURSIVE {SPINE}, {CNT}, m AS (SELECT video_id, frame_idx, CASE WHEN n > 0 THEN 0 ELSE 1 END AS streak, -1 AS l, false AS active FROM cn WHERE frame_idx = 0
UNION ALL SELECT cn.video_id, cn.frame_idx, CASE WHEN n > 0 THEN 0 ELSE m.streak + 1 END, CASE WHEN m.l >= 0 THEN CASE WHEN greatest(m.l - 1, 0) = 0 AND n > 0 THEN -1 ELSE greatest(m.l - 1, 0) END WHEN n = 0 AND m.streak + 1 >= 6 THEN 5 ELSE -1 END,
 m.l >= 0 OR (n = 0 AND m.streak + 1 >= 6) FROM m JOIN cn ON cn.video_id = m.video_id AND cn.frame_idx = m.frame_idx + 1) SELECT video_id, frame_idx, active FROM m""", "obs verdicts")
def fallback(spark, d):
    return st.fallback_machine(_counts(spark, d), SECOND_LANE, "n", 6, 5).select("video_id", "frame_idx", "active")


@query("st14_detector_reuse", f"""WITH RECURSIVE {SPINE}, {CNT}, m AS (SELECT video_id, frame_idx, 0 AS gap, frame_idx AS src FROM cn WHERE frame_idx = 0
UNION ALL SELECT cn.video_id, cn.frame_idx, CASE WHEN m.gap + 1 >= CASE WHEN n > 0 THEN 2 ELSE 5 END THEN 0 ELSE m.gap + 1 END, CASE WHEN m.gap + 1 >= CASE WHEN n > 0 THEN 2 ELSE 5 END THEN cn.frame_idx ELSE m.src END FROM m JOIN cn ON cn.video_id = m.video_id AND cn.frame_idx = m.frame_idx + 1)
SELECT video_id, frame_idx, gap = 0 AS ran, src AS source_pos FROM m""", "obs verdicts")
def reuse(spark, d):
    x = _counts(spark, d).withColumn("forced", c("n") > 0)
    return st.reuse_machine(x, SECOND_LANE, "forced").select("video_id", "frame_idx", "ran", "source_pos")


ADAPT = f"""{SPINE}, {SAMPLES}, x AS (SELECT video_id, frame_idx, coalesce(e, 0) AS e FROM sp LEFT JOIN sa USING (video_id, frame_idx)),
mm AS (SELECT video_id, frame_idx, avg(e) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS 5 PRECEDING) AS m FROM x),
iv AS (SELECT video_id, frame_idx, CAST(greatest(1, floor(6 / CASE WHEN m >= 0.15 THEN 3.0 WHEN m <= 0.02 THEN 0.5 ELSE 0.5 + (m - 0.02) / CAST(0.13 AS DOUBLE) * 2.5 END)) AS BIGINT) AS iv FROM mm)"""


def _intervals(spark, d, base_fps=6.0):
    sa = v.obs(spark, d).groupBy("video_id", F.floor("t").cast("long").alias("frame_idx")).agg(F.max("energy").alias("e"))
    x = join_on(_spine(spark, d), sa, ("video_id", "frame_idx"), "left").withColumn("e", F.coalesce("e", F.lit(0.0)))
    r = sg.target_rate(x, ("video_id",), "frame_idx", "e", 5)
    return r.select("video_id", "frame_idx", F.greatest(F.lit(1), F.floor(F.lit(base_fps) / c("target_fps"))).cast("long").alias("iv"))


ADAPT_FOLD = f"WITH RECURSIVE {ADAPT}, m AS (SELECT video_id, frame_idx, frame_idx AS kept FROM iv WHERE frame_idx = 0 UNION ALL SELECT iv.video_id, iv.frame_idx, CASE WHEN iv.frame_idx - m.kept >= iv.iv THEN iv.frame_idx ELSE m.kept END FROM m JOIN iv ON iv.video_id = m.video_id AND iv.frame_idx = m.frame_idx + 1)"


@query("w29_adaptive_sampling", f"{ADAPT_FOLD} SELECT video_id, frame_idx FROM m JOIN vids USING (video_id) WHERE kept = frame_idx OR frame_idx = n - 1", "obs verdicts")
def adaptive(spark, d):
    return st.adaptive_sampling(_intervals(spark, d), SECOND_LANE, "iv", 12).select("video_id", "frame_idx")


@query("st07_online_sampler", f"{ADAPT_FOLD} SELECT video_id, count(*) AS kept FROM m JOIN vids USING (video_id) WHERE m.kept = frame_idx OR frame_idx = n - 1 GROUP BY ALL", "obs verdicts")
def online(spark, d):
    return st.adaptive_sampling(_intervals(spark, d), SECOND_LANE, "iv", 12).groupBy("video_id").agg(F.count(F.lit(1)).alias("kept"))


@query("j21_box_fusion", """WITH RECURSIVE a AS (SELECT video_id, frame_idx // 60 AS cell, event_id AS mi, x, y, w, h, energy FROM obs WHERE k % 2 = 0),
b AS (SELECT video_id, frame_idx // 60 AS cell, event_id AS di, (event_id - 1) * 37 % 600 AS x, (event_id - 1) * 53 % 400 AS y, w, h, action AS class_name, danger AS confidence FROM obs WHERE k % 2 = 1),
o AS (SELECT a.video_id, a.cell, mi, di, CAST(greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS DOUBLE) AS shared, a.w * a.h + b.w * b.h AS area FROM a JOIN b ON a.video_id = b.video_id AND a.cell = b.cell),
pr AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY video_id, cell ORDER BY shared / (area - shared) DESC, mi, di) AS i FROM o WHERE area > shared AND shared / (area - shared) >= 0.3),
g AS (SELECT video_id, cell, CAST(0 AS BIGINT) AS i, CAST([] AS BIGINT[]) AS ms, CAST([] AS BIGINT[]) AS ds FROM (SELECT DISTINCT video_id, cell FROM pr)
 UNION ALL SELECT g.video_id, g.cell, pr.i, CASE WHEN list_contains(ms, mi) OR list_contains(ds, di) THEN ms ELSE list_append(ms, mi) END, CASE WHEN list_contains(ms, mi) OR list_contains(ds, di) THEN ds ELSE list_append(ds, di) END
 FROM g JOIN pr ON pr.video_id = g.video_id AND pr.cell = g.cell AND pr.i = g.i + 1),
f AS (SELECT video_id, cell, unnest(ms) AS mi, unnest(ds) AS di FROM (SELECT video_id, cell, max_by(ms, i) AS ms, max_by(ds, i) AS ds FROM g GROUP BY ALL))
SELECT b.video_id, b.cell, b.x, b.y, b.w, b.h, coalesce(a.energy, 0.0) AS energy, class_name, confidence, CASE WHEN f.mi IS NOT NULL THEN 'fused' ELSE 'yolo' END AS source
 FROM b LEFT JOIN f ON f.video_id = b.video_id AND f.cell = b.cell AND f.di = b.di LEFT JOIN a ON a.video_id = f.video_id AND a.cell = f.cell AND a.mi = f.mi WHERE f.mi IS NOT NULL OR confidence >= 0.2
UNION ALL SELECT video_id, cell, x, y, w, h, energy, '', 0.0, 'motion' FROM a WHERE energy >= 0.04 AND NOT EXISTS (SELECT 1 FROM f WHERE f.video_id = a.video_id AND f.cell = a.cell AND f.mi = a.mi)""", "obs")
def box_fusion(spark, d):
    o = v.obs(spark, d).withColumn("cell", F.floor(c("frame_idx") / 60).cast("long"))
    m = o.filter("k % 2 = 0").select("video_id", "cell", c("event_id").alias("region_idx"), *"xywh", "energy")
    y = o.filter("k % 2 = 1").select("video_id", "cell", c("event_id").alias("region_idx"), (c("x") * 0 + (c("event_id") - 1) * 37 % 600).alias("x"), ((c("event_id") - 1) * 53 % 400).alias("y"), "w", "h", c("action").alias("class_name"), c("danger").alias("confidence"))
    return rg.fuse_boxes(m, y, ("video_id", "cell"))


# --- streams ----------------------------------------------------------------------------------
def _obs_stream(spark, d):
    return _observations(rt.event_stream(spark, d))


def _observations(e):
    us = F.unix_micros("ts") - F.lit(v.EPOCH_US)
    danger = v._danger()
    return e.select(
        "ts", "event_id", F.floor(c("user_id") / 15).cast("long").alias("video_id"), c("user_id").alias("entity_id"), F.floor(us / 120000000).cast("long").alias("frame_idx"),
        (us / F.lit(3.6e9)).alias("t"), (c("value") / F.lit(499.0)).alias("energy"), c("event_type").alias("action"), (c("event_type") == "error").alias("suspicious"), danger.alias("danger"),
    )


def _with_vectors(obs, e):
    return obs.withColumn("vec_id", c("event_id") % e.count()).join(e, "vec_id").drop("vec_id")


def _vec_stream(spark, d):
    return _with_vectors(_obs_stream(spark, d), v.vectors(spark, d))


@query("st03_trigger_stream", """WITH RECURSIVE o AS (SELECT video_id, entity_id, event_id, t, frame_idx, row_number() OVER (PARTITION BY video_id, entity_id ORDER BY t, event_id) AS i FROM obs),
nx AS MATERIALIZED (SELECT a.video_id, a.entity_id, a.i, min(b.i) AS j FROM o a JOIN o b ON a.video_id = b.video_id AND a.entity_id = b.entity_id AND b.i > a.i AND b.t - a.t >= 8.0 AND b.frame_idx - a.frame_idx >= 5 GROUP BY ALL),
f AS (SELECT video_id, entity_id, i FROM o WHERE i = 1 UNION ALL SELECT f.video_id, f.entity_id, nx.j FROM f JOIN nx ON nx.video_id = f.video_id AND nx.entity_id = f.entity_id AND nx.i = f.i)
SELECT o.event_id, CASE WHEN o.i = 1 THEN 'birth' ELSE 'heartbeat' END AS rule FROM f JOIN o USING (video_id, entity_id, i)""", "obs")
def trigger_stream(spark, d):
    return rt.run_split(so.stream_triggers(_vec_stream(spark, d), NEVER), "triggers")[0].select("event_id", "rule")


# Frames are complete up to the last one that the watermark, an hour behind the newest row, has reached.
@query("st04_silent_heartbeat_stream", SILENCE + """, mark AS (SELECT max(t) AS m FROM obs_vec),
done AS (SELECT video_id, max(frame_idx) AS f FROM obs_vec, mark WHERE floor(t * 3600000) <= floor(m * 3600000) - 3600000 GROUP BY video_id)
SELECT video_id, entity_id, round(t, 6) AS t FROM r JOIN done USING (video_id) WHERE rule IS NOT NULL AND silent AND r.f < done.f""", "obs_vec")
def silent_stream(spark, d):
    return rt.run_available(so.stream_silence(_vec_stream(spark, d)), "silent").filter("silent").select("video_id", "entity_id", F.round("t", 6).alias("t"))


@query("st05_global_heartbeat_stream", PULSES, "obs_vec")
def pulse_stream(spark, d):
    return rt.run_split(so.stream_global_heartbeats(_vec_stream(spark, d), GlobalHeartbeatParams(drift=1.1)), "pulses")[0].withColumn("drift", F.round("drift", 5))


@query("st08_incremental_graph", """WITH n AS (SELECT video_id, entity_id, event_id, row_number() OVER w - 1 AS seq, round(t - lag(t) OVER w, 6) AS duration, lag(action) OVER w||' → '||action AS action_transition, round(sum(energy) OVER (PARTITION BY video_id, entity_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 6) AS running_energy FROM nodes WINDOW w AS (PARTITION BY video_id, entity_id ORDER BY t, event_id)) SELECT * FROM n""", "nodes")
def incremental_graph(spark, d):
    r = rt.run_split(so.stream_graph(_obs_stream(spark, d).filter("action <> 'view'")), "graph")[0].drop("t")
    return r.withColumn("duration", F.round("duration", 6)).withColumn("running_energy", F.round("running_energy", 6))


@query("st09_score_ema_stream", """WITH RECURSIVE o AS (SELECT event_id, video_id, entity_id, energy, row_number() OVER (PARTITION BY video_id, entity_id ORDER BY t, event_id) AS i FROM obs),
e AS (SELECT event_id, video_id, entity_id, i, energy AS ema FROM o WHERE i = 1 UNION ALL SELECT o.event_id, o.video_id, o.entity_id, o.i, 0.3 * o.energy + 0.7 * e.ema FROM e JOIN o ON o.video_id = e.video_id AND o.entity_id = e.entity_id AND o.i = e.i + 1) SELECT event_id, round(ema, 7) AS ema FROM e""", "obs")
def ema_stream(spark, d):
    return rt.run_split(so.stream_score_ema(_obs_stream(spark, d)), "ema")[0].select("event_id", F.round("ema", 7).alias("ema"))


@query("st10_warmup_calibration", """WITH r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) AS i FROM obs), th AS (SELECT video_id, greatest(avg(energy) + 5.0 * stddev_pop(energy), 0.20) AS thr FROM r WHERE i <= 30 GROUP BY ALL)
SELECT event_id, round(CASE WHEN i < 30 THEN 0.20 ELSE thr END, 7) AS threshold FROM r JOIN th USING (video_id)""", "obs")
def calibration(spark, d):
    return rt.run_split(so.stream_background(_obs_stream(spark, d)), "calibration")[0].select("event_id", F.round("threshold", 7).alias("threshold"))


@query("st11_tumbling_bins", "WITH w AS (SELECT CAST(floor(t / 24) * 86400 AS BIGINT) + 1704067200 AS start_s, video_id, count(*) AS n, max(danger) AS max_danger, max((SELECT max(t) FROM obs)) AS mx FROM obs GROUP BY 1, 2) SELECT start_s, video_id, n, max_danger FROM w WHERE start_s + 86400 <= 1704067200 + mx * 3600 - 3600", "obs")
def tumbling(spark, d):
    return rt.run_available(so.tumbling_bins(_obs_stream(spark, d), "1 day", "1 hour"), "bins")


@query("st12_sliding_stream", "WITH w AS (SELECT 1704067200 + i * 6 * 3600 AS start_s, video_id, count(*) AS n FROM obs, range(120) r(i) WHERE t >= i * 6 AND t < i * 6 + 8 GROUP BY ALL), m AS (SELECT max(t) AS mx FROM obs) SELECT start_s, video_id, n FROM w, m WHERE start_s + 8 * 3600 <= 1704067200 + mx * 3600 - 3600", "obs")
def sliding(spark, d):
    return rt.run_available(so.sliding_bins(_obs_stream(spark, d), "8 hours", "6 hours", "1 hour", v.EPOCH_US // 1_000_000), "sliding")


@query("st13_gap_sessions", """WITH b AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY video_id ORDER BY t, event_id) < 3.0 THEN 0 ELSE 1 END AS nb FROM obs WHERE danger >= 0.45), g AS (SELECT *, sum(nb) OVER (PARTITION BY video_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS s FROM b), m AS (SELECT max(t) AS mx FROM b)
SELECT min(CAST(round(t * 3600000000) AS BIGINT)) + 1704067200000000 AS start_us, video_id, count(*) AS n, round(max(energy), 9) AS max_energy FROM g, m GROUP BY video_id, s, mx HAVING max(t) + 3.0 <= mx - 1.0""", "obs")
def sessions(spark, d):
    r = rt.run_available(so.gap_sessions(_obs_stream(spark, d).filter("danger >= 0.45"), "3 hours", "1 hour"), "sessions")
    return r.withColumn("max_energy", F.round("max_energy", 9))


@query("st15_deduplicated_stream", "SELECT video_id, count(*) AS n FROM (SELECT DISTINCT video_id, entity_id, frame_idx // 1440 AS day FROM obs) GROUP BY ALL", "obs")
def dedup(spark, d):
    o = _obs_stream(spark, d).withColumn("day", F.floor(c("frame_idx") / 1440))
    r = rt.run_available(so.without_duplicates(o, "60 days", ("video_id", "entity_id", "day")), "dedup")
    return r.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"))


@query("st16_live_counts", "SELECT count(*) AS n FROM obs", "obs")
def live(spark, d):
    return rt.run_available(so.with_live_counts(_obs_stream(spark, d), "live"), "live").agg(F.count(F.lit(1)).alias("n"))


# --- streams whose rows come in two arrivals: every tenth event comes after all others --------
def _two_arrivals(spark, d, build, name):
    """Results and rows set aside of ``build(stream)`` run once after each arrival, with progress kept."""
    e = v.table(spark, d, "events")
    folder, path = fresh_path(spark, f"{name}-in"), fresh_path(spark, name)
    for late in (False, True):
        e.filter((c("event_id") % 10 == 3) == late).write.mode("append").parquet(folder)
        out = rt.run_split(build(_observations(rt.event_stream(spark, folder, "*.parquet"))), name, path)
    return out


def _marked(found, results, marks=()):
    """Results and rows set aside in one table; ``marks`` are rounded."""
    kept, late = found
    cols = lambda r, why: r.select("event_id", *results, why.alias("set_aside"))
    out = cols(kept, F.lit(None).cast("string")).unionByName(cols(late, c("set_aside")))
    return out.withColumns({m: F.round(m, n) for m, n in dict(marks).items()})


#: Rows in order of arrival: the second arrival's are late unless after all of their key in the first.
ARRIVALS = """h AS (SELECT *, max((t, event_id)) FILTER (event_id % 10 <> 3) OVER (PARTITION BY {keys}) AS top FROM {rows}),
m AS (SELECT *, coalesce(event_id % 10 = 3 AND (t, event_id) < top, false) AS late FROM h)"""


def arrivals(keys, rows, body):
    """SQL of the rows in time, ``body``, and of those set aside."""
    return f"WITH {ARRIVALS.format(keys=keys, rows=rows)}, {body}"


@query("st08_late_rows", arrivals("video_id, entity_id", "nodes", """n AS (SELECT event_id, row_number() OVER w - 1 AS seq, round(t - lag(t) OVER w, 6) AS duration, lag(action) OVER w||' → '||action AS action_transition, CAST(NULL AS VARCHAR) AS set_aside FROM m WHERE NOT late WINDOW w AS (PARTITION BY video_id, entity_id ORDER BY t, event_id))
SELECT * FROM n UNION ALL SELECT event_id, NULL, NULL, NULL, 'late' FROM m WHERE late"""), "nodes")
def late_graph(spark, d):
    found = _two_arrivals(spark, d, lambda s: so.stream_graph(s.filter("action <> 'view'")), "late-graph")
    return _marked(found, ("seq", "duration", "action_transition"), {"duration": 6})


@query("st09_late_rows", arrivals("video_id, entity_id", "obs", """o AS (SELECT event_id, video_id, entity_id, energy, row_number() OVER (PARTITION BY video_id, entity_id ORDER BY t, event_id) AS i FROM m WHERE NOT late),
e AS (SELECT event_id, video_id, entity_id, i, energy AS ema FROM o WHERE i = 1 UNION ALL SELECT o.event_id, o.video_id, o.entity_id, o.i, 0.3 * o.energy + 0.7 * e.ema FROM e JOIN o ON o.video_id = e.video_id AND o.entity_id = e.entity_id AND o.i = e.i + 1)
SELECT event_id, round(ema, 7) AS ema, CAST(NULL AS VARCHAR) AS set_aside FROM e UNION ALL SELECT event_id, NULL, 'late' FROM m WHERE late""").replace("WITH h", "WITH RECURSIVE h"), "obs")
def late_ema(spark, d):
    return _marked(_two_arrivals(spark, d, so.stream_score_ema, "late-ema"), ("ema",), {"ema": 7})


@query("st10_late_rows", arrivals("video_id", "obs", """r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) AS i FROM m WHERE NOT late), th AS (SELECT video_id, greatest(avg(energy) + 5.0 * stddev_pop(energy), 0.20) AS thr FROM r WHERE i <= 30 GROUP BY ALL)
SELECT event_id, round(CASE WHEN i < 30 THEN 0.20 ELSE thr END, 7) AS threshold, CAST(NULL AS VARCHAR) AS set_aside FROM r JOIN th USING (video_id) UNION ALL SELECT event_id, NULL, 'late' FROM m WHERE late"""), "obs")
def late_background(spark, d):
    return _marked(_two_arrivals(spark, d, so.stream_background, "late-background"), ("threshold",), {"threshold": 7})


@query("st05_late_rows", "WITH RECURSIVE " + arrivals("video_id", "obs", """o AS (SELECT video_id, event_id, t, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) AS i FROM m WHERE NOT late),
nx AS MATERIALIZED (SELECT a.video_id, a.i, min(b.i) AS j FROM o a JOIN o b ON a.video_id = b.video_id AND b.i > a.i AND b.t - a.t >= 4.0 GROUP BY ALL),
f AS (SELECT video_id, i FROM o WHERE i = 1 UNION ALL SELECT f.video_id, nx.j FROM f JOIN nx ON nx.video_id = f.video_id AND nx.i = f.i)
SELECT o.event_id, 'periodic' AS reason, CAST(NULL AS VARCHAR) AS set_aside FROM f JOIN o USING (video_id, i) UNION ALL SELECT event_id, NULL, 'late' FROM m WHERE late""").removeprefix("WITH "), "obs")
def late_pulses(spark, d):
    p = GlobalHeartbeatParams(interval=4.0, drift=9.0)
    n = v.vectors(spark, d)
    found = _two_arrivals(spark, d, lambda s: so.stream_global_heartbeats(_with_vectors(s, n), p), "late-pulses")
    return _marked(found, ("reason",))


@query("st15_late_rows", arrivals("video_id", "obs", """w AS (SELECT *, max(t) FILTER (event_id % 10 <> 3) OVER (PARTITION BY video_id) AS first_top FROM obs),
b AS (SELECT *, event_id % 10 = 3 AND t < first_top - 100.0 AS aside, frame_idx // 1440 AS day FROM w),
k AS (SELECT *, row_number() OVER (PARTITION BY video_id, entity_id, day, event_id % 10 = 3 ORDER BY t, event_id) AS i, max(t) FILTER (event_id % 10 <> 3) OVER (PARTITION BY video_id, entity_id, day) AS last FROM b WHERE NOT aside)
SELECT event_id, CAST(NULL AS VARCHAR) AS set_aside FROM k WHERE i = 1 AND (event_id % 10 <> 3 OR last IS NULL OR last < first_top - 100.0) UNION ALL SELECT event_id, 'late' FROM b WHERE aside"""), "obs")
def late_first_rows(spark, d):
    build = lambda s: so.stream_first_rows(s.withColumn("day", F.floor(c("frame_idx") / 1440)), 100.0, ("entity_id", "day"))
    return _marked(_two_arrivals(spark, d, build, "late-first"), ())


@query("st16_observed_counts", "SELECT 0 AS batch_id, count(*) AS rows, CAST(sum(CAST(suspicious AS INT)) AS BIGINT) AS suspicious, round(max(t), 6) AS last_t FROM obs", "obs")
def observed(spark, d):
    counts = rt.run_observed(so.with_live_counts(_obs_stream(spark, d), "live"), "live", "rows long, suspicious long, last_t double")[1]
    return counts.withColumn("last_t", F.round("last_t", 6)).withColumn("batch_id", c("batch_id").cast("int"))


# --- user hooks -------------------------------------------------------------------------------
def _linear():
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"score": (pdf["energy"] * 0.5 + pdf["danger"] * 0.5).clip(0, 1)})

    return fn


def _picky():
    def fn(pdf: pd.DataFrame) -> pd.DataFrame:
        if (pdf["k"] % 97 == 0).any():
            raise ValueError("cannot score")
        return pd.DataFrame({"score": pdf["danger"]})

    return fn


@query("x01_pluggable_scorer", "SELECT event_id, round(greatest(0, least(1, energy * 0.5 + danger * 0.5)), 9) AS score FROM obs", "obs")
def scorer(spark, d):
    return sc.score(v.obs(spark, d).select("event_id", "energy", "danger"), _linear, "score double", "event_id", {"score": 0.0}).select("event_id", F.round("score", 9).alias("score"))


@query("x02_scorer_with_fallback", "SELECT event_id, CASE WHEN k % 97 = 0 THEN -1.0 ELSE danger END AS score, CASE WHEN k % 97 = 0 THEN 'fallback' ELSE 'ok' END AS status FROM obs", "obs")
def scorer_fallback(spark, d):
    return sc.score(v.obs(spark, d).select("event_id", "k", "danger"), _picky, "score double", "event_id", {"score": -1.0}, retries=0)


MINE = [ac.PathTemplate("pay_and_go", ["*"], ["walking", "picking up", "paying"]), ac.PathTemplate("idle", ["*"], ["standing still"])]


@query("x03_user_templates", f"""WITH RECURSIVE {alignment_sql(MINE)}, top AS (SELECT video_id, entity_id, CASE template WHEN 0 THEN 'pay_and_go' ELSE 'idle' END AS name, score FROM sc WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY video_id, entity_id ORDER BY score DESC, template) = 1)
SELECT e.video_id, e.entity_id, name AS template, round(score, 6) AS score FROM (SELECT DISTINCT video_id, entity_id FROM sc) e LEFT JOIN top USING (video_id, entity_id)""", "obs")
def user_templates(spark, d):
    o = v.obs(spark, d).select(*K, "t", "event_id", vocab(c("action")).alias("act"))
    s = tp.template_alignment(o, v.ENTITY_LANE, "act", MINE)
    return s.withColumn("b", ac.best_template(c("scores"), F.lit(""), MINE)).select(*K, c("b.name").alias("template"), F.round("b.score", 6).alias("score"))


@query("x04_user_rules", "SELECT event_id, CASE WHEN action = 'error' THEN 'call someone' WHEN action = 'purchase' THEN 'check receipt' ELSE 'watch' END AS rule FROM obs", "obs")
def user_rules(spark, d):
    mine = {"default": ["watch"], "error": ["call someone"], "purchase": ["check receipt"]}
    return v.obs(spark, d).select("event_id", F.element_at(ac.matching_rules(c("action"), mine), 1).alias("rule"))


@query("x05_mode_switch", "SELECT event_id FROM obs WHERE energy > 0.9 AND danger < 0.1", "obs")
def mode_switch(spark, d):
    o = v.obs(spark, d)
    th = o.select("video_id").distinct().withColumn("threshold", F.lit(0.9))
    p = sg.DiscordanceParams(excess=0.0)
    per_row = o.select("video_id", c("event_id").alias("entity_id"), "energy")
    return sg.discordance_alerts(o.select("video_id", c("event_id").alias("entity_id"), "event_id", "danger"), per_row, th, K, p).select("event_id")


@query("x06_native_reducers", "SELECT video_id, round(sum(least(danger, energy)) / sum(greatest(danger, energy)), 9) AS iou FROM obs GROUP BY ALL", "obs")
def reducers(spark, d):
    from chronotrace.operators import metrics as m

    return m.soft_iou(v.obs(spark, d), ("video_id",), c("danger"), c("energy")).withColumn("iou", F.round("iou", 9))


@query("x07_interval_expander", "SELECT video_id, CAST(sum(e - s) AS BIGINT) AS frames FROM ann WHERE e > s GROUP BY ALL", "ann")
def expander(spark, d):
    return fr.paint(v.ann(spark, d), c("s"), c("e"), lambda f: F.lit(1.0)).groupBy("video_id").agg(F.count(F.lit(1)).alias("frames"))
