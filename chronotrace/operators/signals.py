"""Signals along a sequence: change scores, thresholds, bursts, drift, slopes and fusions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronotrace.functions.boxes import clamp
from chronotrace.functions.vectors import cosine, dot, sq_l2
from chronotrace.operators.intervals import points_in_intervals
from chronotrace.operators.ordered import Lane, bounded_window, exact_quantiles, join_on, neighbours, number_rows, running
from chronotrace.operators.stateful import ordered_pass
from chronotrace.params import DiscordanceParams, FusionParams, LocalizerParams, SamplerParams


def change_score(df: DataFrame, lane: Lane, vec: str) -> DataFrame:
    """Squared distance plus cosine distance to the previous vector."""
    d = neighbours(df, lane, previous={"_pvec": F.col(vec)}).filter(F.col("_pvec").isNotNull())
    return d.withColumn("change", sq_l2(F.col(vec), F.col("_pvec")) + 1 - cosine(F.col(vec), F.col("_pvec"))).drop("_pvec")


def trailing_ratio(df: DataFrame, keys: tuple[str, ...], pos: str, value: str, w: int) -> DataFrame:
    """Value over its trailing mean of ``w`` rows; only rows with a full window."""
    d = bounded_window(df, keys, pos, w - 1, 0, lambda win: [F.avg(value).over(win).alias("trailing_mean"), F.count(value).over(win).alias("_c")])
    return d.filter(F.col("_c") == w).withColumn("ratio", F.col(value) / (F.col("trailing_mean") + 1e-6)).drop("_c")


def robust_threshold(df: DataFrame, keys: tuple[str, ...], value: str, mult: float = 3.0) -> DataFrame:
    """Median plus ``mult`` times the median absolute deviation, per key."""
    med = exact_quantiles(df, keys, value, {"med": 0.5})
    dev = join_on(df.select(*keys, value), med, keys).select(*keys, F.abs(F.col(value) - F.col("med")).alias("dev"))
    mad = exact_quantiles(dev, keys, "dev", {"mad": 0.5})
    return join_on(med, mad, keys).withColumn("threshold", F.col("med") + mult * F.col("mad"))


def background_threshold(df: DataFrame, keys: tuple[str, ...], value: str, order: tuple[str, ...], p: DiscordanceParams = DiscordanceParams()) -> DataFrame:
    """mean + k * std of the first rows of a recording, never below the floor; the floor alone
    when fewer than 3 rows exist. The rank filter keeps only the warm-up rows before shuffling."""
    w = W.partitionBy(*keys).orderBy(*order)
    first = df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= p.warmup_rows)
    g = first.groupBy(*keys).agg(F.avg(value).alias("mu"), F.stddev_pop(value).alias("sd"), F.count(F.lit(1)).alias("n"))
    return g.select(*keys, F.when(F.col("n") >= 3, F.greatest(F.col("mu") + p.sigma * F.col("sd"), F.lit(p.floor))).otherwise(F.lit(p.floor)).alias("threshold"))


def bursts(trace: DataFrame, thresholds: DataFrame, lane: Lane, join_keys: tuple[str, ...], margin: float = 2.0) -> DataFrame:
    """Energy peak per entity (first on a tie) and the run at or above threshold around it."""
    axis = lane.order[0]
    d = join_on(trace, thresholds, join_keys)
    d = running(d.withColumn("_low", (F.col("energy") < F.col("threshold")).cast("int")), lane, {"_run": ("sum", F.col("_low"))})
    peak = d.groupBy(*lane.keys).agg(
        F.min_by(F.struct(F.col(axis).alias("pt"), F.col("energy").alias("pe"), F.col("_run").alias("run"), F.col("_low").alias("low")), F.struct((-F.col("energy")).alias("a"), *[F.col(c) for c in lane.order])).alias("_p")
    )
    runs = d.filter("_low = 0").groupBy(*lane.keys, "_run").agg(F.min(axis).alias("r0"), F.max(axis).alias("r1"))
    p = peak.select(*lane.keys, F.col("_p.pt").alias("peak_time"), F.col("_p.pe").alias("peak_energy"), F.when(F.col("_p.low") == 0, F.col("_p.run")).alias("_run"))
    j = p.join(runs, [*lane.keys, "_run"], "left")
    return j.select(
        *lane.keys, "peak_time", "peak_energy", F.greatest(F.lit(0.0), F.coalesce("r0", "peak_time") - margin).alias("burst_start"), (F.coalesce("r1", "peak_time") + margin).alias("burst_end")
    )


def discordance_alerts(semantics: DataFrame, trace: DataFrame, thresholds: DataFrame, keys: tuple[str, ...], p: DiscordanceParams = DiscordanceParams()) -> DataFrame:
    """Semantic rows rated harmless although their entity's largest energy is far above the
    background of the recording."""
    top = trace.groupBy(*keys).agg(F.max("energy").alias("motion_energy"))
    j = join_on(join_on(semantics.filter(F.col("danger") < p.danger_ceiling), top, keys), thresholds, keys[:1])
    excess = F.col("motion_energy") / F.greatest(F.col("threshold"), F.lit(1e-6))
    return j.filter((F.col("motion_energy") > F.col("threshold")) & (excess >= p.excess)).withColumn("excess", excess).withColumn("alert_type", F.lit("energy_semantic_gap"))


def drift_from_first(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], vec: str) -> DataFrame:
    """1 - dot product with the first vector of the key."""
    first = df.groupBy(*keys).agg(F.min_by(vec, F.struct(*order)).alias("_first"))
    return join_on(df, first, keys).withColumn("drift", 1 - dot(F.col(vec), F.col("_first"))).drop("_first")


def consecutive_drift(df: DataFrame, lane: Lane, vec: str, limit: float = 0.20) -> DataFrame:
    d = neighbours(df, lane, previous={"_pvec": F.col(vec)}).filter(F.col("_pvec").isNotNull())
    return d.withColumn("drift", 1 - dot(F.col(vec), F.col("_pvec"))).filter(F.col("drift") > limit).drop("_pvec")


def energy_slope_start(starts: DataFrame, energies: DataFrame, keys: tuple[str, ...], p: LocalizerParams = LocalizerParams()) -> DataFrame:
    """Move a start time to the steepest energy change within the search radius.

    ``energies`` has one row per recording time, so a search window is bounded by the radius
    times the frame rate. Adds ``start_phys``; the start itself when nothing is steep enough.
    """
    e = energies.select("video_id", F.col("t").alias("_et"), F.col("frame_energy").alias("_ee"))
    s = starts.select(*keys, F.col("start_logic").alias("_sl"))
    near = points_in_intervals(e, s, ("video_id",), "_et", F.col("_sl") - p.radius, F.col("_sl") + p.radius, 12.0)
    w = W.partitionBy(*keys).orderBy("_et")
    near = near.withColumn("_nt", F.lead("_et").over(w)).withColumn("_ne", F.lead("_ee").over(w))
    dt = F.col("_nt") - F.col("_et")
    near = near.withColumn("_slope", F.abs(F.when(dt > 0, (F.col("_ne") - F.col("_ee")) / dt).otherwise(F.when(F.col("_nt").isNotNull(), 0.0))))
    g = near.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max("_slope").alias("_ms"), F.min_by("_et", F.when(F.col("_slope").isNotNull(), F.struct((-F.col("_slope")).alias("a"), F.col("_et").alias("b")))).alias("_pt"))
    j = join_on(starts, g, keys, "left")
    ok = (F.col("_n") >= 3) & (F.col("_ms") >= p.slope)
    return j.withColumn("start_phys", F.when(ok, F.col("_pt")).otherwise(F.col("start_logic"))).drop("_n", "_ms", "_pt")


def nodes_walked(breaks: DataFrame, nodes: DataFrame, keys: tuple[str, ...], p: LocalizerParams = LocalizerParams()) -> DataFrame:
    """The numbered nodes that ``backward_trace`` may reach by an edge: the ``window`` nodes up to the break,
    itself included. Only the edges that end there need weights and totals."""
    j = join_on(nodes, breaks.select(*keys, "break_seq"), keys)
    return j.filter((F.col("seq") <= F.col("break_seq")) & (F.col("seq") > F.col("break_seq") - p.window)).drop("break_seq")


def backward_trace(breaks: DataFrame, edges: DataFrame, keys: tuple[str, ...], p: LocalizerParams = LocalizerParams()) -> DataFrame:
    """Walk back from the break node over at most ``window`` edges while each one is
    implausible or energetic; ``start_seq`` is the node reached. Missing edges are skipped."""
    e = edges.select(*keys, "src_seq", ((F.col("action_score") < 1.0 - p.shift) | (F.col("energy_avg") > p.shift)).alias("_odd"))
    j = join_on(e, breaks.select(*keys, "break_seq"), keys).filter((F.col("src_seq") < F.col("break_seq")) & (F.col("src_seq") >= F.col("break_seq") - p.window))
    stop = j.groupBy(*keys).agg(F.max(F.when(~F.col("_odd"), F.col("src_seq"))).alias("_stop"))
    good = join_on(j.filter("_odd"), stop, keys).filter(F.col("_stop").isNull() | (F.col("src_seq") > F.col("_stop")))
    reach = good.groupBy(*keys).agg(F.min("src_seq").alias("_reach"))
    return join_on(breaks, reach, keys, "left").withColumn("start_seq", F.coalesce("_reach", "break_seq")).drop("_reach")


def final_segment(d: DataFrame, duration: Column, fps: float, p: LocalizerParams = LocalizerParams()) -> DataFrame:
    """Pad, clip to the recording's ``duration`` and bound the localised interval; single-node
    entities get +-3 s."""
    z = F.lit(0.0)
    half = max(p.min_len, 3.0)
    single = F.col("num_nodes") < 2
    s = F.greatest(z, F.least("start_logic", "start_phys") - p.pad)
    e = F.least(duration, F.col("break_time") + p.pad)
    short, mid = (e - s) < p.min_len, (s + e) / 2
    s2 = F.when(short, F.greatest(z, mid - p.min_len / 2)).otherwise(F.when(e - s > p.max_len, F.greatest(z, e - p.max_len)).otherwise(s))
    e2 = F.when(short, F.least(duration, mid + p.min_len / 2)).otherwise(e)
    start = F.when(single, F.greatest(z, F.col("stated_break") - half)).otherwise(s2)
    end = F.when(single, F.least(duration, F.col("stated_break") + half)).otherwise(e2)
    d = d.withColumn("start_sec", start).withColumn("end_sec", end)
    return d.withColumn("start_frame", F.floor(F.col("start_sec") * fps).cast("long")).withColumn("end_frame", F.floor(F.col("end_sec") * fps).cast("long"))


def half_trend(df: DataFrame, lane: Lane, value: str) -> DataFrame:
    """Mean of the second half over mean of the first: rising, falling or stable (>= 4 rows)."""
    n = number_rows(df, lane, "_i")
    n = join_on(n, df.groupBy(*lane.keys).agg(F.count(F.lit(1)).alias("n")), lane.keys)
    first = F.col("_i") <= F.floor(F.col("n") / 2)
    g = n.groupBy(*lane.keys, "n").agg(F.avg(F.when(first, F.col(value))).alias("m1"), F.avg(F.when(~first, F.col(value))).alias("m2"))
    r = F.col("m2") / F.greatest(F.col("m1"), F.lit(1e-6))
    return g.filter("n >= 4").withColumn("ratio", r).withColumn("trend", F.when(F.col("ratio") > 1.3, "RISING").when(F.col("ratio") < 0.7, "FALLING").otherwise("STABLE"))


def run_length(df: DataFrame, lane: Lane, empty: Column) -> DataFrame:
    """How many rows up to this one are empty without a break (0 on a filled row)."""
    d = df.withColumn("_e", empty.cast("int"))
    d = running(d, lane, {"_i": ("sum", F.lit(1))})
    d = running(d, lane, {"_last_full": ("max", F.when(F.col("_e") == 0, F.col("_i")))})
    return d.withColumn("empty_run", (F.col("_i") - F.coalesce("_last_full", F.lit(0))).cast("long")).drop("_e", "_i", "_last_full")


def hysteresis(df: DataFrame, lane: Lane, score: str, hi: float = 0.35, lo: float = 0.15) -> DataFrame:
    """On at ``hi``, off below ``lo``, otherwise as before (off at the start)."""
    mark = F.when(F.col(score) >= hi, 1).when(F.col(score) < lo, 0)
    d = running(df, lane, {"_on": ("last", mark)})
    return d.withColumn("active", F.coalesce("_on", F.lit(0)) == 1).drop("_on")


def target_rate(df: DataFrame, keys: tuple[str, ...], pos: str, value: str, rows_back: int, p: SamplerParams = SamplerParams()) -> DataFrame:
    """Sampling rate from the trailing mean energy, linear between both thresholds."""
    d = bounded_window(df, keys, pos, rows_back, 0, lambda w: [F.avg(value).over(w).alias("mean_energy")])
    k = (F.col("mean_energy") - p.low) / (p.high - p.low)
    rate = F.when(F.col("mean_energy") >= p.high, p.max_fps).when(F.col("mean_energy") <= p.low, p.base_fps).otherwise(p.base_fps + k * (p.max_fps - p.base_fps))
    return d.withColumn("target_fps", rate)


def lookback_picks(df: DataFrame, keys: tuple[str, ...], pos: str, frame: str, size: int = 30) -> DataFrame:
    """Four frames spread over the last ``size`` buffered ones (oldest, thirds, newest)."""
    d = bounded_window(df, keys, pos, size - 1, 0, lambda w: [F.collect_list(frame).over(w).alias("_buf")])
    n = F.size("_buf")
    at = lambda i: F.element_at("_buf", (i + 1).cast("int"))
    return d.filter(n >= 4).select(
        *keys, pos, frame, at(F.lit(0)).alias("pick0"), at(F.floor(n / 3)).alias("pick1"), at(F.floor(2 * n / 3)).alias("pick2"), at(n - 1).alias("pick3")
    )


def max_change_over_last(df: DataFrame, keys: tuple[str, ...], pos: str, vec: str, k: int) -> DataFrame:
    """Largest distance to any of the previous ``k`` rows."""
    d = bounded_window(df, keys, pos, k, 0, lambda w: [F.collect_list(vec).over(w).alias("_prev")])
    dist = F.transform("_prev", lambda x: F.sqrt(sq_l2(F.col(vec), x)))
    return d.withColumn("max_change", F.array_max(dist)).drop("_prev")


def edge_weight_signal(edges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    g = edges.groupBy(*keys).agg(F.avg("weight").alias("_m"), F.min("weight").alias("_mn"), F.stddev_pop("weight").alias("_s"))
    score = 0.4 * F.greatest(F.lit(0.0), 1 - F.col("_m")) + 0.4 * F.greatest(F.lit(0.0), 1 - F.col("_mn")) + 0.2 * F.least(F.lit(1.0), 2 * F.col("_s"))
    return g.select(*keys, clamp(score).alias("edge_score"))


def breakage_signal(edges: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Harmonic mean of the worst and the mean implausibility; long gaps count less."""
    bad = 1 - F.col("action_score")
    b = F.greatest(F.lit(0.0), F.when(F.col("duration") < 5.0, bad).otherwise(bad * (1 - 0.5 * F.least(F.lit(1.0), F.col("duration") / 30.0))))
    g = edges.withColumn("_b", b).groupBy(*keys).agg(F.max("_b").alias("_mx"), F.avg("_b").alias("_av"), F.count(F.lit(1)).alias("_n"))
    h = F.when(F.col("_mx") + F.col("_av") > 0, 2 * F.col("_mx") * F.col("_av") / (F.col("_mx") + F.col("_av"))).otherwise(0.0)
    return g.select(*keys, F.when(F.col("_n") < 2, 0.0).otherwise(clamp(h)).alias("breakage_score"))


def energy_signal(df: DataFrame, lane: Lane, value: str) -> DataFrame:
    d = neighbours(df, lane, previous={"_pe": F.col(value)})
    g = d.groupBy(*lane.keys).agg(F.avg(value).alias("_a"), F.max(value).alias("_m"), F.coalesce(F.max(F.abs(F.col(value) - F.col("_pe"))), F.lit(0.0)).alias("_g"))
    return g.select(*lane.keys, clamp(0.3 * F.col("_a") + 0.4 * F.col("_m") + 0.3 * F.least(F.lit(1.0), 3 * F.col("_g"))).alias("energy_score"))


def fuse_signals(paths: DataFrame, edge: DataFrame, breakage: DataFrame, energy: DataFrame, keys: tuple[str, ...], p: FusionParams = FusionParams()) -> DataFrame:
    """Weighted sum of four signals. Paths shorter than the minimum score 0."""
    j = paths
    for s in (edge, breakage, energy):
        j = join_on(j, s, keys, "left")
    j = j.na.fill(0.0, ["path_score", "edge_score", "breakage_score", "energy_score"])
    raw = p.path * F.col("path_score") + p.edge * F.col("edge_score") + p.breakage * F.col("breakage_score") + p.energy * F.col("energy_score")
    j = j.withColumn("score", F.when(F.col("num_nodes") >= p.min_path, clamp(raw)).otherwise(0.0))
    names = [F.when(F.col(f"{s}_score") > 0.5, F.lit(s)) for s in ("path", "edge", "breakage", "energy")]
    return j.withColumn("is_anomaly", F.col("score") >= p.threshold).withColumn("signals", F.concat_ws("+", *names))


EMA_SLICE = 64


class _Carry:
    """Average before each slice of a sequence, from the slices' affine maps in order."""

    def __init__(self):
        self.ema = None

    def __call__(self, cols, lo, hi):
        out = []
        for i in range(lo, hi):
            if self.ema is None:
                self.ema = cols["_first"][i]
            out.append((*(cols[c][i] for c in cols if c not in ("_keep", "_add", "_first")), self.ema))
            self.ema = cols["_keep"][i] * self.ema + cols["_add"][i]
        return out


def score_ema(df: DataFrame, lane: Lane, value: str, alpha: float = 0.3) -> DataFrame:
    """Exponential average of an entity's scores over runs; the first value counts in full.

    Rows are numbered and cut into slices of ``EMA_SLICE``. A slice turns the average before it into
    ``keep * average + add``; these maps, one row per slice, are run through in order, and each slice
    is then filled from its own starting value.
    """
    keys, cols = list(lane.keys), df.columns
    d = number_rows(df.withColumn("_x", F.col(value).cast("double")), lane, "_i").withColumn("_s", F.floor((F.col("_i") - 1) / EMA_SLICE))
    s = d.groupBy(*keys, "_s").agg(F.sort_array(F.collect_list(F.struct("_i", "_x", F.struct(*cols).alias("row")))).alias("_rows"))
    fold = F.aggregate("_rows", F.lit(0.0), lambda acc, r: alpha * r["_x"] + (1 - alpha) * acc)
    maps = s.select(*keys, "_s", F.pow(F.lit(1.0 - alpha), F.size("_rows")).alias("_keep"), fold.alias("_add"), F.element_at("_rows", 1)["_x"].alias("_first"))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in maps.schema.fields[: len(keys) + 1])
    start = ordered_pass(maps, tuple(keys), ("_s",), f"{kinds}, _start double", _Carry)
    step = lambda acc, r: F.struct((alpha * r["_x"] + (1 - alpha) * acc["e"]).alias("e"), F.concat(acc["all"], F.array(alpha * r["_x"] + (1 - alpha) * acc["e"])).alias("all"))
    filled = F.aggregate("_rows", F.struct(F.col("_start").alias("e"), F.array().cast("array<double>").alias("all")), step, lambda acc: acc["all"])
    j = join_on(s, start, (*keys, "_s")).select(F.explode(F.arrays_zip(F.col("_rows.row").alias("row"), filled.alias("ema"))).alias("z"))
    return j.select("z.row.*", F.col("z.ema").alias("ema"))
