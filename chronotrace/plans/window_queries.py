"""Registered queries: sequence analytics (W1-W4, W11-W13, W16-W28, W30-W35), per-entity
signals (A31-A40), frame scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from chronotrace.operators import blocks, frames as fr, intervals as iv, metrics as m, signals as sg, temporal_graph as tg
from chronotrace.operators.ordered import Lane, join_on, number_rows
from chronotrace.plans import reports as rp
from chronotrace.plans import views as v
from chronotrace.plans.graph_queries import EDGES
from chronotrace.plans.registry import query
from chronotrace.session import cut

K = ("video_id", "entity_id")

CHANGE = """ch AS (SELECT video_id, frame_idx, list_inner_product(feat, feat) + list_inner_product(pf, pf) - 2 * list_inner_product(feat, pf)
 + 1 - list_inner_product(feat, pf) / (sqrt(list_inner_product(feat, feat)) * sqrt(list_inner_product(pf, pf)) + CAST(1e-6 AS DOUBLE)) AS c, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 AS i
 FROM (SELECT *, lag(feat) OVER (PARTITION BY video_id ORDER BY frame_idx) AS pf FROM frames) WHERE pf IS NOT NULL)"""


def _change(spark, d):
    c = sg.change_score(v.frames(spark, d), v.FRAME_LANE, "feat").select("video_id", "frame_idx", "change")
    return c.withColumn("i", F.col("frame_idx") - 1)


@query("w01_change_score", f"WITH {CHANGE} SELECT video_id, frame_idx, round(c, 6) AS change FROM ch", "frames")
def change_score(spark, d):
    return _change(spark, d).select("video_id", "frame_idx", F.round("change", 6).alias("change"))


SMOOTH = CHANGE + """, sz AS (SELECT video_id, count(*) AS n FROM ch GROUP BY ALL HAVING count(*) >= 10),
bs AS (SELECT video_id, i, least(greatest(i - 2, 0), n - 5) AS b FROM ch JOIN sz USING (video_id)),
sm AS (SELECT bs.video_id, bs.i, sum(ch.c * (0.2 + (bs.i - b - 2) * (ch.i - b - 2) / CAST(10 AS DOUBLE) + (pow(bs.i - b - 2, 2) - 2) * (pow(ch.i - b - 2, 2) - 2) / CAST(14 AS DOUBLE))) AS s
 FROM bs JOIN ch ON ch.video_id = bs.video_id AND ch.i BETWEEN b AND b + 4 GROUP BY ALL)"""


@query("w02_quadratic_smoothing", f"WITH {SMOOTH} SELECT video_id, i, round(s, 6) AS smooth FROM sm", "frames")
def quadratic_smoothing(spark, d):
    s = blocks.quadratic_smooth(_change(spark, d), ("video_id",), "i", "change", 5, "smooth")
    return s.select("video_id", "i", F.round("smooth", 6).alias("smooth"))


RATIO = SMOOTH + """, ra AS (SELECT * FROM (SELECT video_id, i, s / (avg(s) OVER w + CAST(1e-6 AS DOUBLE)) AS r, count(*) OVER w AS c FROM sm WINDOW w AS (PARTITION BY video_id ORDER BY i ROWS 4 PRECEDING)) WHERE c = 5)"""


def _ratio(spark, d):
    s = cut(blocks.quadratic_smooth(_change(spark, d), ("video_id",), "i", "change", 5, "smooth"))
    return sg.trailing_ratio(s, ("video_id",), "i", "smooth", 5)


@query("w03_trailing_ratio", f"WITH {RATIO} SELECT video_id, i, round(r, 6) AS ratio FROM ra", "frames")
def trailing_ratio(spark, d):
    return _ratio(spark, d).select("video_id", "i", F.round("ratio", 6).alias("ratio"))


MAD = RATIO + """, md AS (SELECT video_id, median(r) AS med FROM ra GROUP BY ALL), th AS (SELECT video_id, any_value(med) + 3.0 * median(abs(r - med)) AS thr FROM ra JOIN md USING (video_id) GROUP BY ALL)"""


@query("a33_robust_threshold", f"WITH {MAD} SELECT video_id, round(thr, 6) AS threshold FROM th", "frames")
def robust_threshold(spark, d):
    return sg.robust_threshold(_ratio(spark, d), ("video_id",), "ratio").select("video_id", F.round("threshold", 6).alias("threshold"))


@query("w04_change_points", f"WITH {MAD} SELECT video_id, i - 4 + 2 AS point FROM ra JOIN th USING (video_id) WHERE r > thr", "frames")
def change_points(spark, d):
    r = cut(_ratio(spark, d).select("video_id", "i", "ratio"))
    t = sg.robust_threshold(r, ("video_id",), "ratio")
    return join_on(r, t, ("video_id",)).filter("ratio > threshold").select("video_id", (F.col("i") - 4 + 2).alias("point"))


@query("w13_hysteresis", """WITH z AS (SELECT *, last_value(CASE WHEN energy >= 0.35 THEN 1 WHEN energy < 0.15 THEN 0 END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS a FROM obs)
SELECT event_id, coalesce(a, 0) = 1 AS active FROM z""", "obs")
def hysteresis(spark, d):
    return sg.hysteresis(v.obs(spark, d).select("video_id", "t", "event_id", "energy"), v.OBS_LANE, "energy").select("event_id", "active")


THRESH = "th AS (SELECT video_id, CASE WHEN count(*) >= 3 THEN greatest(avg(energy) + 0.4 * stddev_pop(energy), 0.05) ELSE 0.05 END AS thr FROM (SELECT * FROM obs QUALIFY row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) <= 30) GROUP BY ALL)"
P_DISC = sg.DiscordanceParams(sigma=0.4, floor=0.05)


def _threshold(spark, d):
    return sg.background_threshold(v.obs(spark, d).select("video_id", "energy", "t", "event_id"), ("video_id",), "energy", ("t", "event_id"), P_DISC)


@query("a32_background_threshold", f"WITH {THRESH} SELECT video_id, round(thr, 9) AS threshold FROM th", "obs")
def background_threshold(spark, d):
    return _threshold(spark, d).select("video_id", F.round("threshold", 9).alias("threshold"))


BURST = THRESH + """, x AS (SELECT o.*, thr, sum(CAST(energy < thr AS INT)) OVER (PARTITION BY video_id, entity_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS run FROM obs o JOIN th USING (video_id)),
pk AS (SELECT video_id, entity_id, arg_min(t, (-energy, t, event_id)) AS pt, max(energy) AS pe, arg_min(CASE WHEN energy >= thr THEN run ELSE -1 END, (-energy, t, event_id)) AS run FROM x GROUP BY ALL),
rn AS (SELECT video_id, entity_id, run, min(t) AS r0, max(t) AS r1 FROM x WHERE energy >= thr GROUP BY ALL),
bu AS (SELECT video_id, entity_id, pt, pe, greatest(0.0, coalesce(r0, pt) - 2) AS bs, coalesce(r1, pt) + 2 AS be FROM pk LEFT JOIN rn USING (video_id, entity_id, run))"""


@query("w16_peak_and_burst", f"WITH {BURST} SELECT video_id, entity_id, round(pt, 5) AS peak_time, round(pe, 9) AS peak_energy, round(bs, 5) AS burst_start, round(be, 5) AS burst_end FROM bu", "obs")
def peak_and_burst(spark, d):
    o = v.obs(spark, d).select(*K, "t", "event_id", "energy")
    b = sg.bursts(o, _threshold(spark, d), v.ENTITY_LANE, ("video_id",))
    return b.select(*K, F.round("peak_energy", 9).alias("peak_energy"), *[F.round(c, 5).alias(c) for c in ("peak_time", "burst_start", "burst_end")])


@query("w17_discordance_alerts", f"""WITH {THRESH}, mx AS (SELECT video_id, entity_id, max(energy) AS me FROM obs GROUP BY ALL)
SELECT o.event_id, round(me, 9) AS motion_energy, round(me / greatest(thr, 1e-6), 9) AS excess FROM obs o JOIN mx USING (video_id, entity_id) JOIN th USING (video_id) WHERE danger < 0.10 AND me > thr AND me / greatest(thr, 1e-6) >= 3.5""", "obs")
def discordance(spark, d):
    o = v.obs(spark, d)
    return sg.discordance_alerts(o.select(*K, "event_id", "danger"), o, _threshold(spark, d), K, P_DISC).select("event_id", F.round("motion_energy", 9).alias("motion_energy"), F.round("excess", 9).alias("excess"))


@query("w18_drift_from_first", "WITH f AS (SELECT video_id, arg_min(vec, (t, event_id)) AS v0 FROM obs_vec GROUP BY ALL) SELECT event_id, round(1 - list_inner_product(vec, v0), 6) AS drift FROM obs_vec JOIN f USING (video_id)", "obs_vec")
def drift_from_first(spark, d):
    o = v.obs_vec(spark, d).select("video_id", "t", "event_id", "vec")
    return sg.drift_from_first(o, ("video_id",), ("t", "event_id"), "vec").select("event_id", F.round("drift", 6).alias("drift"))


@query("w18_max_drift", "WITH f AS (SELECT video_id, arg_min(vec, (t, event_id)) AS v0 FROM obs_vec GROUP BY ALL) SELECT video_id, round(max(1 - list_inner_product(vec, v0)), 6) AS max_drift FROM obs_vec JOIN f USING (video_id) GROUP BY ALL", "obs_vec")
def max_drift(spark, d):
    o = v.obs_vec(spark, d).select("video_id", "t", "event_id", "vec")
    return sg.drift_from_first(o, ("video_id",), ("t", "event_id"), "vec").groupBy("video_id").agg(F.round(F.max("drift"), 6).alias("max_drift"))


@query("w19_consecutive_drift", "WITH p AS (SELECT *, lag(vec) OVER (PARTITION BY video_id ORDER BY t, event_id) AS pv FROM obs_vec) SELECT event_id, round(1 - list_inner_product(vec, pv), 6) AS drift FROM p WHERE pv IS NOT NULL AND 1 - list_inner_product(vec, pv) > 1.2", "obs_vec")
def consecutive_drift(spark, d):
    o = v.obs_vec(spark, d).select("video_id", "t", "event_id", "vec")
    return sg.consecutive_drift(o, v.OBS_LANE, "vec", 1.2).select("event_id", F.round("drift", 6).alias("drift"))


# Frame scores use one frame per second here; every recording has its own number of them.
VIDS = "vids AS (SELECT video_id, CAST(floor(max(t)) AS BIGINT) + 1 AS n FROM obs GROUP BY ALL)"
SPINE = VIDS + ", sp AS (SELECT video_id, n, unnest(range(n)) AS frame_idx FROM vids)"


def _recs(spark, d):
    return v.recordings(spark, d).select("video_id", F.col("seconds").alias("total_frames"))


def _spine(spark, d):
    return fr.frame_spine(_recs(spark, d))


SAMPLES = "sa AS (SELECT video_id, CAST(floor(t) AS BIGINT) AS frame_idx, max(energy) AS e FROM obs GROUP BY ALL)"


@query("w20_gaussian_smoothing", f"""WITH {SPINE}, {SAMPLES}, x AS (SELECT video_id, frame_idx, coalesce(e, 0) AS e FROM sp LEFT JOIN sa USING (video_id, frame_idx)),
w AS (SELECT k, exp(-0.5 * k * k / CAST(4 AS DOUBLE)) AS g FROM range(-8, 9) r(k)), wn AS (SELECT k, g / (SELECT sum(g) FROM w) AS g FROM w),
i AS (SELECT video_id, frame_idx, g, CASE WHEN frame_idx + k < 0 THEN -(frame_idx + k) - 1 WHEN frame_idx + k >= n THEN 2 * n - 1 - (frame_idx + k) ELSE frame_idx + k END AS src FROM sp, wn)
SELECT i.video_id, i.frame_idx, round(sum(g * e), 7) AS smooth FROM i JOIN x ON x.video_id = i.video_id AND x.frame_idx = i.src GROUP BY ALL""", "obs verdicts")
def gaussian(spark, d):
    sa = v.obs(spark, d).groupBy("video_id", F.floor("t").cast("long").alias("frame_idx")).agg(F.max("energy").alias("e"))
    x = join_on(_spine(spark, d), sa, ("video_id", "frame_idx"), "left").withColumn("e", F.coalesce("e", F.lit(0.0)))
    return blocks.gaussian_smooth(x, ("video_id",), "frame_idx", "e", 2.0, "smooth").select("video_id", "frame_idx", F.round("smooth", 7).alias("smooth"))


INTERP = """b AS (SELECT sp.video_id, sp.frame_idx, last_value(CASE WHEN e IS NOT NULL THEN sp.frame_idx END IGNORE NULLS) OVER up AS p0, last_value(e IGNORE NULLS) OVER up AS e0,
 last_value(CASE WHEN e IS NOT NULL THEN sp.frame_idx END IGNORE NULLS) OVER dn AS p1, last_value(e IGNORE NULLS) OVER dn AS e1 FROM sp LEFT JOIN sa USING (video_id, frame_idx)
 WINDOW up AS (PARTITION BY sp.video_id ORDER BY sp.frame_idx ROWS UNBOUNDED PRECEDING), dn AS (PARTITION BY sp.video_id ORDER BY sp.frame_idx DESC ROWS UNBOUNDED PRECEDING)),
ip AS (SELECT video_id, frame_idx, CASE WHEN p0 IS NULL THEN e1 WHEN p1 IS NULL OR p0 = p1 THEN e0 ELSE e0 + (e1 - e0) * (frame_idx - p0) / CAST(p1 - p0 AS DOUBLE) END AS e FROM b)"""


@query("w21_linear_interpolation", f"WITH {SPINE}, {SAMPLES}, {INTERP} SELECT video_id, frame_idx, round(e, 9) AS e FROM ip", "obs verdicts")
def interpolation(spark, d):
    sa = v.obs(spark, d).groupBy("video_id", F.floor("t").cast("long").alias("frame_idx")).agg(F.max("energy").alias("e"))
    i = fr.interpolate(_spine(spark, d), sa, "e", Lane(("video_id",), ("frame_idx",), 120))
    return i.select("video_id", "frame_idx", F.round("e", 9).alias("e"))


@query("w22_sparse_key_interpolation", """WITH mx AS (SELECT video_id, max(frame_idx) AS n FROM frames GROUP BY ALL), k AS (SELECT video_id, frame_idx, mot FROM frames JOIN mx USING (video_id) WHERE frame_idx % 5 = 0 OR frame_idx = n),
n AS (SELECT f.video_id, f.frame_idx, max(a.frame_idx) AS p0, min(b.frame_idx) AS p1 FROM frames f JOIN k a ON a.video_id = f.video_id AND a.frame_idx <= f.frame_idx AND a.frame_idx > f.frame_idx - 5
 JOIN k b ON b.video_id = f.video_id AND b.frame_idx >= f.frame_idx AND b.frame_idx < f.frame_idx + 5 GROUP BY ALL)
SELECT n.video_id, n.frame_idx, round(CASE WHEN p0 = p1 THEN a.mot[3] ELSE a.mot[3] * (1 - (n.frame_idx - p0) / CAST(p1 - p0 AS DOUBLE)) + b.mot[3] * ((n.frame_idx - p0) / CAST(p1 - p0 AS DOUBLE)) END, 7) AS m3,
 round(CASE WHEN p0 = p1 THEN a.mot[16] ELSE a.mot[16] * (1 - (n.frame_idx - p0) / CAST(p1 - p0 AS DOUBLE)) + b.mot[16] * ((n.frame_idx - p0) / CAST(p1 - p0 AS DOUBLE)) END, 7) AS m16
FROM n JOIN frames a ON a.video_id = n.video_id AND a.frame_idx = p0 JOIN frames b ON b.video_id = n.video_id AND b.frame_idx = p1""", "frames")
def sparse_interpolation(spark, d):
    f = v.frames(spark, d)
    last = f.groupBy("video_id").agg(F.max("frame_idx").alias("_n"))
    keyed = join_on(f, last, ("video_id",)).filter("frame_idx % 5 = 0 or frame_idx = _n").select("video_id", "frame_idx", F.transform("mot", lambda x: x.cast("double")).alias("mot"))
    i = fr.interpolate(f.select("video_id", "frame_idx"), keyed, "mot", v.FRAME_LANE)
    return i.select("video_id", "frame_idx", F.round(F.element_at("mot", 3), 7).alias("m3"), F.round(F.element_at("mot", 16), 7).alias("m16"))


RAMP = """fv AS (SELECT video_id, confidence AS c, CAST(greatest(0, least(floor(start_sec), n)) AS BIGINT) AS a, CAST(greatest(0, least(floor(end_sec), n)) AS BIGINT) AS b FROM verdicts JOIN vids USING (video_id) WHERE is_anomaly AND end_sec > start_sec),
rv AS (SELECT sp.video_id, frame_idx, CASE WHEN frame_idx >= a AND frame_idx < b THEN c
 WHEN frame_idx >= greatest(0, a - 5) AND frame_idx < a THEN c * 0.1 + c * 0.7 * CASE WHEN a - greatest(0, a - 5) > 1 THEN (frame_idx - greatest(0, a - 5)) / CAST(a - greatest(0, a - 5) - 1 AS DOUBLE) ELSE 0 END
 WHEN frame_idx >= b AND frame_idx < least(n, b + 5) THEN c * 0.8 - c * 0.7 * CASE WHEN least(n, b + 5) - b > 1 THEN (frame_idx - b) / CAST(least(n, b + 5) - b - 1 AS DOUBLE) ELSE 0 END END AS v
 FROM sp JOIN fv ON fv.video_id = sp.video_id AND frame_idx BETWEEN a - 5 AND b + 5),
rs AS (SELECT sp.video_id, sp.frame_idx, greatest(0.0, least(1.0, coalesce(max(v), 0))) AS score FROM sp LEFT JOIN rv USING (video_id, frame_idx) GROUP BY ALL)"""


def _ramp(spark, d):
    return fr.ramp_scores(_spine(spark, d), v.verdicts(spark, d), _recs(spark, d), 1.0)


@query("w23_ramp_scores", f"WITH {SPINE}, {RAMP} SELECT video_id, frame_idx, round(score, 7) AS score FROM rs", "verdicts")
def ramp_scores(spark, d):
    return _ramp(spark, d).withColumn("score", F.round("score", 7))


@query("w24_step_scores", f"""WITH {SPINE}, s AS (SELECT video_id, confidence AS c, CAST(least(floor(greatest(0.0, start_sec - 1)), n - 1) AS BIGINT) AS sf, CAST(least(floor(least(CAST(n - 1 AS DOUBLE), end_sec + 1)), n) AS BIGINT) AS ef, CAST(least(floor(start_sec), n - 1) AS BIGINT) AS cs, CAST(least(floor(end_sec), n) AS BIGINT) AS ce FROM verdicts JOIN vids USING (video_id) WHERE is_anomaly),
x AS (SELECT sp.video_id, sp.frame_idx, max(CASE WHEN frame_idx >= cs AND frame_idx < ce THEN c WHEN (frame_idx >= sf AND frame_idx < cs) OR (frame_idx >= ce AND frame_idx < ef) THEN c * 0.6 END) AS v FROM sp LEFT JOIN s ON s.video_id = sp.video_id GROUP BY ALL)
SELECT video_id, frame_idx, round(coalesce(v, 0), 7) AS score FROM x""", "verdicts")
def step_scores(spark, d):
    return fr.step_scores(_spine(spark, d), v.verdicts(spark, d).filter("is_anomaly"), _recs(spark, d), 1.0).withColumn("score", F.round("score", 7))


@query("w25_last_writer_scores", """WITH s AS (SELECT video_id, seg_idx, start_frame // 30 AS a, end_frame // 30 + 2 AS b, score FROM segs), n AS (SELECT video_id, max(b) AS n FROM s GROUP BY ALL),
sp AS (SELECT video_id, f AS frame_idx FROM n, LATERAL (SELECT unnest(range(n)) AS f)), x AS (SELECT sp.video_id, sp.frame_idx, arg_max(score, (a, seg_idx)) AS sc FROM sp JOIN s ON s.video_id = sp.video_id AND frame_idx >= a AND frame_idx < b GROUP BY ALL)
SELECT video_id, frame_idx, coalesce(sc, 0) AS score FROM sp LEFT JOIN x USING (video_id, frame_idx)""", "segs")
def last_writer(spark, d):
    s = v.segs(spark, d).select("video_id", "seg_idx", F.floor(F.col("start_frame") / 30).cast("long").alias("start_frame"), (F.floor(F.col("end_frame") / 30) + 2).cast("long").alias("end_frame"), "score")
    return fr.last_writer_scores(s)


WINS = "wi AS (SELECT video_id, i AS win, i * 6 AS a, least(i * 6 + 8, n) AS b FROM (SELECT video_id, n, unnest(range(n // 6 + 1)) AS i FROM vids) WHERE least(i * 6 + 8, n) - i * 6 >= 8)"


@query("st12_sliding_windows", f"WITH {SPINE}, {WINS} SELECT video_id, win, a AS start_frame, b AS end_frame FROM wi", "verdicts")
def sliding_windows(spark, d):
    return fr.fixed_windows(_recs(spark, d), 8.0, 0.25, 1.0, 8)


@query("w26_window_mean_scores", f"""WITH {SPINE}, {WINS}, x AS (SELECT sp.video_id, sp.frame_idx, avg((win * 37 % 11) / CAST(10 AS DOUBLE)) AS sc FROM sp LEFT JOIN wi ON wi.video_id = sp.video_id AND frame_idx >= a AND frame_idx < b GROUP BY ALL) SELECT video_id, frame_idx, round(coalesce(sc, 0), 9) AS score FROM x""", "verdicts")
def window_mean(spark, d):
    w = fr.fixed_windows(_recs(spark, d), 8.0, 0.25, 1.0, 8).withColumn("score", F.col("win") * 37 % 11 / F.lit(10.0))
    return fr.window_mean_scores(_spine(spark, d), w).withColumn("score", F.round("score", 9))


GT = "gt AS (SELECT sp.video_id, sp.frame_idx, CAST(bool_or(coalesce(frame_idx >= least(a.s // 30, n - 1) AND frame_idx < least(a.e // 30, n), false)) AS INT) AS gt FROM sp LEFT JOIN ann a ON a.video_id = sp.video_id GROUP BY ALL)"


def _gt(spark, d, inclusive=False):
    a = v.ann(spark, d).select("video_id", F.floor(F.col("s") / 30).cast("long").alias("s"), F.floor(F.col("e") / 30).cast("long").alias("e"))
    return fr.interval_mask(_spine(spark, d), a, _recs(spark, d), inclusive)


@query("w27_ground_truth_mask", f"WITH {SPINE}, {GT} SELECT video_id, frame_idx, gt FROM gt", "verdicts ann")
def ground_truth(spark, d):
    return _gt(spark, d)


@query("w27_ground_truth_mask_inclusive", f"WITH {SPINE}, {GT.replace('frame_idx < least(a.e // 30, n)', 'frame_idx < least(a.e // 30 + 1, n)')} SELECT video_id, frame_idx, gt FROM gt", "verdicts ann")
def ground_truth_inclusive(spark, d):
    return _gt(spark, d, True)


@query("w28_target_rate", f"""WITH {SPINE}, {SAMPLES}, x AS (SELECT video_id, frame_idx, coalesce(e, 0) AS e FROM sp LEFT JOIN sa USING (video_id, frame_idx)),
mm AS (SELECT video_id, frame_idx, avg(e) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS 5 PRECEDING) AS m FROM x)
SELECT video_id, frame_idx, round(CASE WHEN m >= 0.15 THEN 3.0 WHEN m <= 0.02 THEN 0.5 ELSE 0.5 + (m - 0.02) / CAST(0.13 AS DOUBLE) * 2.5 END, 7) AS target_fps FROM mm""", "obs verdicts")
def target_rate(spark, d):
    sa = v.obs(spark, d).groupBy("video_id", F.floor("t").cast("long").alias("frame_idx")).agg(F.max("energy").alias("e"))
    x = join_on(_spine(spark, d), sa, ("video_id", "frame_idx"), "left").withColumn("e", F.coalesce("e", F.lit(0.0)))
    return sg.target_rate(x, ("video_id",), "frame_idx", "e", 5).select("video_id", "frame_idx", F.round("target_fps", 7).alias("target_fps"))


@query("w30_half_trend", """WITH p AS (SELECT video_id, entity_id, energy, row_number() OVER (PARTITION BY video_id, entity_id ORDER BY t, event_id) AS i, count(*) OVER (PARTITION BY video_id, entity_id) AS n FROM obs),
g AS (SELECT video_id, entity_id, n, avg(energy) FILTER (i <= n // 2) AS m1, avg(energy) FILTER (i > n // 2) AS m2 FROM p GROUP BY ALL)
SELECT video_id, entity_id, round(m2 / greatest(m1, 1e-6), 7) AS ratio, CASE WHEN m2 / greatest(m1, 1e-6) > 1.3 THEN 'RISING' WHEN m2 / greatest(m1, 1e-6) < 0.7 THEN 'FALLING' ELSE 'STABLE' END AS trend FROM g WHERE n >= 4""", "obs")
def half_trend(spark, d):
    return sg.half_trend(v.obs(spark, d).select(*K, "t", "event_id", "energy"), v.ENTITY_LANE, "energy").select(*K, F.round("ratio", 7).alias("ratio"), "trend")


@query("w31_empty_run_length", """WITH x AS (SELECT *, sum(CAST(energy >= 0.02 AS INT)) OVER (PARTITION BY video_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING) AS g FROM obs)
SELECT event_id, CASE WHEN energy >= 0.02 THEN 0 ELSE row_number() OVER (PARTITION BY video_id, g ORDER BY t, event_id) - CASE WHEN g > 0 THEN 1 ELSE 0 END END AS empty_run FROM x""", "obs")
def empty_run(spark, d):
    return sg.run_length(v.obs(spark, d).select("video_id", "t", "event_id", "energy"), v.OBS_LANE, F.col("energy") < 0.02).select("event_id", "empty_run")


@query("w34_lookback_picks", """WITH p AS (SELECT video_id, frame_idx, row_number() OVER (PARTITION BY video_id ORDER BY frame_idx) - 1 AS pos FROM frames), b AS (SELECT video_id, pos, frame_idx, list(frame_idx) OVER (PARTITION BY video_id ORDER BY pos ROWS 29 PRECEDING) AS buf FROM p)
SELECT video_id, frame_idx, buf[1] AS pick0, buf[len(buf) // 3 + 1] AS pick1, buf[2 * len(buf) // 3 + 1] AS pick2, buf[len(buf)] AS pick3 FROM b WHERE len(buf) >= 4""", "frames")
def lookback(spark, d):
    f = v.frames(spark, d).select("video_id", "frame_idx").withColumn("pos", F.col("frame_idx"))
    return sg.lookback_picks(f, ("video_id",), "pos", "frame_idx").drop("pos")


@query("w35_max_change_over_last", "SELECT a.video_id, a.frame_idx, round(sqrt(greatest(0, max(list_inner_product(a.mot, a.mot) + list_inner_product(b.mot, b.mot) - 2 * list_inner_product(a.mot, b.mot)))), 5) AS max_change FROM frames a JOIN frames b ON a.video_id = b.video_id AND b.frame_idx BETWEEN a.frame_idx - 4 AND a.frame_idx - 1 GROUP BY ALL", "frames")
def max_change(spark, d):
    f = v.frames(spark, d).select("video_id", "frame_idx", "mot")
    return sg.max_change_over_last(f, ("video_id",), "frame_idx", "mot", 4).filter("frame_idx > 0").select("video_id", "frame_idx", F.round("max_change", 5).alias("max_change"))


# --- entity signals over the weighted time graph -----------------------------------------
WE = EDGES + """, we AS (SELECT *, sc AS action_score, 0.32 + 0.6 * sc AS weight, kinetic_integral / greatest(n_trace, 1) AS energy_avg FROM (SELECT *, CASE WHEN action_from = action_to THEN CAST(0.9 AS DOUBLE) WHEN action_to = 'error' THEN 0.2 ELSE 0.5 END AS sc FROM edges) WHERE duration > 0 AND duration <= 30.0)"""


def _weighted(spark, d):
    return _weights(rp.entity_edges(spark, d))


def _weights(edges):
    sc = F.when(F.col("action_from") == F.col("action_to"), 0.9).when(F.col("action_to") == "error", 0.2).otherwise(0.5)
    e = tg.weighted_edges(edges, sc)
    return e.withColumn("energy_avg", F.col("kinetic_integral") / F.greatest("n_trace", F.lit(1)))


@query("a36_edge_weight_signal", f"WITH {WE} SELECT video_id, entity_id, round(greatest(0, least(1, 0.4 * greatest(0, 1 - avg(weight)) + 0.4 * greatest(0, 1 - min(weight)) + 0.2 * least(1, 2 * stddev_pop(weight)))), 7) AS edge_score FROM we GROUP BY ALL", "obs nodes")
def edge_signal(spark, d):
    return sg.edge_weight_signal(_weighted(spark, d), K).withColumn("edge_score", F.round("edge_score", 7))


BREAK = WE + """, bk AS (SELECT video_id, entity_id, greatest(0, CASE WHEN duration < 5 THEN 1 - sc ELSE (1 - sc) * (1 - 0.5 * least(1, duration / CAST(30 AS DOUBLE))) END) AS b FROM we),
bs AS (SELECT video_id, entity_id, CASE WHEN count(*) < 2 THEN 0 ELSE greatest(0, least(1, 2 * max(b) * avg(b) / (max(b) + avg(b)))) END AS breakage FROM bk GROUP BY ALL)"""


@query("a37_breakage_signal", f"WITH {BREAK} SELECT video_id, entity_id, round(breakage, 7) AS breakage_score FROM bs", "obs nodes")
def breakage_signal(spark, d):
    return sg.breakage_signal(_weighted(spark, d), K).withColumn("breakage_score", F.round("breakage_score", 7))


ENER = "en AS (SELECT video_id, entity_id, greatest(0, least(1, 0.3 * avg(energy) + 0.4 * max(energy) + 0.3 * least(1, 3 * coalesce(max(abs(energy - pe)), 0)))) AS es FROM (SELECT *, lag(energy) OVER (PARTITION BY video_id, entity_id ORDER BY t, event_id) AS pe FROM nodes) GROUP BY ALL)"


@query("a38_energy_signal", f"WITH {ENER} SELECT video_id, entity_id, round(es, 7) AS energy_score FROM en", "nodes")
def energy_signal(spark, d):
    return sg.energy_signal(v.nodes(spark, d).select(*K, "t", "event_id", "energy"), v.ENTITY_LANE, "energy").withColumn("energy_score", F.round("energy_score", 7))


FUSE = BREAK + ", " + ENER + """, ed AS (SELECT video_id, entity_id, greatest(0, least(1, 0.4 * greatest(0, 1 - avg(weight)) + 0.4 * greatest(0, 1 - min(weight)) + 0.2 * least(1, 2 * stddev_pop(weight)))) AS edge_score FROM we GROUP BY ALL),
pa AS (SELECT video_id, entity_id, count(*) AS n, avg(CAST(suspicious AS INT)) AS ps FROM nodes GROUP BY ALL),
fu AS (SELECT video_id, entity_id, CASE WHEN n >= 3 THEN greatest(0, least(1, 0.30 * ps + 0.25 * coalesce(edge_score, 0) + 0.30 * coalesce(breakage, 0) + 0.15 * coalesce(es, 0))) ELSE 0 END AS score FROM pa LEFT JOIN ed USING (video_id, entity_id) LEFT JOIN bs USING (video_id, entity_id) LEFT JOIN en USING (video_id, entity_id))"""


def _fused(spark, d):
    n, e = v.nodes(spark, d), cut(_weighted(spark, d).select(*K, "weight", "action_score", "duration"))
    paths = n.groupBy(*K).agg(F.count(F.lit(1)).alias("num_nodes"), F.avg(F.col("suspicious").cast("double")).alias("path_score"))
    en = sg.energy_signal(n.select(*K, "t", "event_id", "energy"), v.ENTITY_LANE, "energy")
    return sg.fuse_signals(paths, sg.edge_weight_signal(e, K), sg.breakage_signal(e, K), en, K)


@query("a39_signal_fusion", f"WITH {FUSE} SELECT video_id, entity_id, round(score, 7) AS score, score >= 0.7 AS is_anomaly FROM fu", "obs nodes")
def signal_fusion(spark, d):
    return _fused(spark, d).select(*K, F.round("score", 7).alias("score"), "is_anomaly")


@query("a31_max_over_entities", f"WITH {FUSE} SELECT video_id, round(max(score), 7) AS video_score FROM fu GROUP BY ALL", "obs nodes")
def max_over_entities(spark, d):
    return _fused(spark, d).groupBy("video_id").agg(F.round(F.coalesce(F.max(F.when(F.col("num_nodes") >= 3, F.col("score"))), F.lit(0.0)), 7).alias("video_score"))


LOC = WE + """, nb AS (SELECT n.video_id, n.entity_id, arg_min(n.seq, (abs(n.t - b.break_ts + 1.5), n.event_id)) AS bseq, count(*) AS n FROM numbered n JOIN verdicts b USING (video_id, entity_id) WHERE b.is_anomaly GROUP BY ALL),
od AS (SELECT w.video_id, w.entity_id, src_seq, action_score < 0.6 OR energy_avg > 0.4 AS odd, bseq FROM we w JOIN nb USING (video_id, entity_id) WHERE src_seq < bseq AND src_seq >= bseq - 3),
sp AS (SELECT video_id, entity_id, max(src_seq) FILTER (NOT odd) AS stop FROM od GROUP BY ALL),
rc AS (SELECT video_id, entity_id, min(src_seq) AS reach FROM od JOIN sp USING (video_id, entity_id) WHERE odd AND (stop IS NULL OR src_seq > stop) GROUP BY ALL),
bt AS (SELECT nb.video_id, nb.entity_id, bseq, n, coalesce(reach, bseq) AS sseq FROM nb LEFT JOIN rc USING (video_id, entity_id)),
lg AS (SELECT bt.*, s.t AS start_logic, b.t AS break_time FROM bt JOIN numbered s ON s.video_id = bt.video_id AND s.entity_id = bt.entity_id AND s.seq = sseq JOIN numbered b ON b.video_id = bt.video_id AND b.entity_id = bt.entity_id AND b.seq = bseq),
fe AS (SELECT video_id, frame_idx / CAST(30 AS DOUBLE) AS t, max(energy) AS e FROM obs GROUP BY ALL),
ne AS (SELECT lg.video_id, lg.entity_id, fe.t, fe.e, lead(fe.t) OVER w - fe.t AS dt, lead(fe.e) OVER w - fe.e AS de FROM lg JOIN fe ON fe.video_id = lg.video_id AND fe.t BETWEEN start_logic - 2 AND start_logic + 2 WINDOW w AS (PARTITION BY lg.video_id, lg.entity_id ORDER BY fe.t)),
sl AS (SELECT video_id, entity_id, count(*) AS c, max(abs(de / dt)) AS ms, arg_min(t, (-abs(de / dt), t)) AS pt FROM ne GROUP BY ALL),
ph AS (SELECT lg.*, CASE WHEN c >= 3 AND ms >= 0.05 THEN pt ELSE start_logic END AS start_phys FROM lg LEFT JOIN sl USING (video_id, entity_id))"""


def _localised(spark, d):
    ver = v.verdicts(spark, d).filter("is_anomaly").select(*K, (F.col("break_ts") - 1.5).alias("stated_break"), "confidence")
    linked = cut(tg.linked_nodes(v.nodes(spark, d), v.ENTITY_LANE))
    num = linked.select(*K, "t", "event_id", "seq")
    br = iv.nearest_point(ver, num, K, "stated_break", "t", "event_id", ["seq"]).withColumnsRenamed({"seq": "break_seq", "t": "break_time"})
    br = cut(join_on(br, num.groupBy(*K).agg(F.count(F.lit(1)).alias("num_nodes")), K))
    near = tg.node_links(sg.nodes_walked(br, linked, K), v.ENTITY_LANE)
    we = cut(_weights(tg.add_trace_totals(near, v.obs(spark, d), K)).select(*K, "src_seq", "action_score", "energy_avg"))
    bt = sg.backward_trace(br, we, K)
    st = num.select(*K, F.col("seq").alias("start_seq"), F.col("t").alias("start_logic"))
    lg = join_on(bt, st, (*K, "start_seq"))
    fe = v.obs(spark, d).groupBy("video_id", "frame_idx").agg(F.max("energy").alias("frame_energy")).withColumn("t", F.col("frame_idx") / F.lit(30.0))
    return sg.energy_slope_start(cut(lg), fe, K)


@query("w12_backward_trace", f"WITH {LOC} SELECT video_id, entity_id, bseq AS break_seq, sseq AS start_seq FROM bt", "obs nodes verdicts")
def backward_trace(spark, d):
    return _localised(spark, d).select(*K, "break_seq", "start_seq")


@query("w11_steepest_slope", f"WITH {LOC} SELECT video_id, entity_id, round(start_logic, 7) AS start_logic, round(start_phys, 7) AS start_phys FROM ph", "obs nodes verdicts")
def steepest_slope(spark, d):
    return _localised(spark, d).select(*K, F.round("start_logic", 7).alias("start_logic"), F.round("start_phys", 7).alias("start_phys"))


@query("w32_localisation", f"""WITH {LOC}, {VIDS}, q AS (SELECT ph.video_id, ph.entity_id, greatest(0.0, least(start_logic, start_phys) - 4) AS s, least(CAST(vids.n AS DOUBLE), break_time + 4) AS e FROM ph JOIN vids USING (video_id))
SELECT video_id, entity_id, round(CASE WHEN e - s > 300 THEN greatest(0, e - 300) ELSE s END, 7) AS start_sec, round(e, 7) AS end_sec FROM q""", "obs nodes verdicts")
def localisation(spark, d):
    loc = fr.with_length(_localised(spark, d), _recs(spark, d))
    return sg.final_segment(loc, F.col("_total").cast("double"), v.FPS).select(*K, F.round("start_sec", 7).alias("start_sec"), F.round("end_sec", 7).alias("end_sec"))


# --- frame-level evaluation -----------------------------------------------------------------
def _frame_eval(spark, d):
    return join_on(_ramp(spark, d), _gt(spark, d), ("video_id", "frame_idx"))


EVAL = f"{SPINE}, {RAMP}, {GT}, ev AS (SELECT video_id, frame_idx, round(score, 7) AS score, gt FROM rs JOIN gt USING (video_id, frame_idx))"


@query("a15_soft_iou", f"WITH {EVAL} SELECT video_id, round(sum(least(gt, score)) / sum(greatest(gt, score)), 7) AS iou FROM ev GROUP BY ALL", "verdicts ann")
def soft_iou(spark, d):
    e = _frame_eval(spark, d).withColumn("score", F.round("score", 7))
    return m.soft_iou(e, ("video_id",), F.col("gt").cast("double"), F.col("score")).withColumn("iou", F.round("iou", 7))


HYST = EVAL + ", hy AS (SELECT *, coalesce(last_value(CASE WHEN score >= 0.35 THEN 1 WHEN score < 0.15 THEN 0 END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY frame_idx ROWS UNBOUNDED PRECEDING), 0) AS on_ FROM ev), hi AS (SELECT video_id, CASE WHEN count(*) FILTER (gt = 1 OR on_ = 1) = 0 THEN 1.0 ELSE count(*) FILTER (gt = 1 AND on_ = 1) / CAST(count(*) FILTER (gt = 1 OR on_ = 1) AS DOUBLE) END AS iou FROM hy GROUP BY ALL)"


def _hyst_iou(spark, d):
    e = _frame_eval(spark, d).withColumn("score", F.round("score", 7))
    h = sg.hysteresis(e, Lane(("video_id",), ("frame_idx",), 120), "score")
    return m.hard_iou(h, ("video_id",), F.col("gt") == 1, F.col("active"))


@query("a16_hysteresis_iou", f"WITH {HYST} SELECT video_id, round(iou, 7) AS iou FROM hi", "verdicts ann")
def hysteresis_iou(spark, d):
    return _hyst_iou(spark, d).withColumn("iou", F.round("iou", 7))


@query("a14_mean_positive_iou", f"WITH {HYST} SELECT round(coalesce(avg(iou) FILTER (iou > 0), 0), 7) AS mean_positive, round(avg(iou), 7) AS mean_all FROM hi", "verdicts ann")
def mean_positive_iou(spark, d):
    return m.mean_positive(_hyst_iou(spark, d), "iou").select(F.round("mean_positive", 7).alias("mean_positive"), F.round("mean_all", 7).alias("mean_all"))


@query("a07_frame_auc", f"""WITH {EVAL}, b AS (SELECT score, sum(gt) AS p, sum(1 - gt) AS n FROM ev GROUP BY ALL), c AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS cp, sum(n) OVER (ORDER BY score DESC) AS cn FROM b)
SELECT round(sum(n * (cp - p) + n * p / CAST(2 AS DOUBLE)) / (sum(p) * sum(n)), 9) AS auc, round(sum(p * cp / CAST(cp + cn AS DOUBLE)) / sum(p), 9) AS average_precision, CAST(sum(p) AS BIGINT) AS positives, CAST(sum(n) AS BIGINT) AS negatives FROM c""", "verdicts ann")
def frame_auc(spark, d):
    e = _frame_eval(spark, d).withColumn("score", F.round("score", 7))
    s = m.curve_summary(m.score_curve(cut(e), "score", F.col("gt") == 1))
    return s.select(F.round("auc", 9).alias("auc"), F.round("average_precision", 9).alias("average_precision"), "positives", "negatives")


@query("a46_frame_mean_and_max", f"WITH {SPINE}, {RAMP} SELECT video_id, round(avg(score) + 1.3e-9, 7) AS mean_score, round(max(score), 7) AS video_score FROM rs GROUP BY ALL", "verdicts")
def frame_mean_max(spark, d):
    # Confidences are four-digit decimals, so means of 720 frames often end in a five: the
    # small shift keeps both engines on the same side of it.
    return _ramp(spark, d).groupBy("video_id").agg(F.round(F.avg("score") + 1.3e-9, 7).alias("mean_score"), F.round(F.max("score"), 7).alias("video_score"))


@query("t08_even_picks", "SELECT video_id, seg_idx, CAST(i AS INTEGER) AS pick_idx, CAST(floor(start_frame + i * ((end_frame - 1 - start_frame) / CAST(7 AS DOUBLE))) AS BIGINT) AS pick FROM segs, range(8) r(i)", "segs")
def even_picks(spark, d):
    return fr.even_picks(v.segs(spark, d), 8, F.col("start_frame"), F.col("end_frame") - 1).select("video_id", "seg_idx", "pick_idx", "pick")


@query("st09_score_ema", """WITH RECURSIVE r AS (SELECT video_id, entity_id, score, row_number() OVER (PARTITION BY video_id, entity_id ORDER BY day) AS i FROM (SELECT video_id, entity_id, CAST(floor(t / 24) AS BIGINT) AS day, max(energy) AS score FROM obs GROUP BY ALL)),
e AS (SELECT video_id, entity_id, i, score AS ema FROM r WHERE i = 1 UNION ALL SELECT r.video_id, r.entity_id, r.i, 0.3 * r.score + 0.7 * e.ema FROM e JOIN r ON r.video_id = e.video_id AND r.entity_id = e.entity_id AND r.i = e.i + 1)
SELECT video_id, entity_id, i, round(ema, 7) AS ema FROM e""", "obs")
def score_ema(spark, d):
    s = v.obs(spark, d).groupBy(*K, F.floor(F.col("t") / 24).cast("long").alias("day")).agg(F.max("energy").alias("score"))
    e = sg.score_ema(s, Lane(K, ("day",), 64), "score")
    return number_rows(e, Lane(K, ("day",), 64), "i").select(*K, "i", F.round("ema", 7).alias("ema"))
