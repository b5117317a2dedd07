"""Frame-level tables: spines, masks, score broadcasts and interpolation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotrace.operators.ordered import Lane, join_on, running
from chronotrace.session import cut


EXPAND_BLOCK = 4096


def expand_range(df: DataFrame, lo: Column, hi: Column, name: str = "frame_idx", step: int = 1, block: int = EXPAND_BLOCK) -> DataFrame:
    """One row per integer lo, lo + step, ... below hi.

    Long ranges are first cut into blocks, which are spread over the cluster before they are
    filled, so no task ever builds the whole range of a recording. The number of tasks is given,
    since a block that is filled has far more rows than its bytes say.
    """
    span = block * step
    d = df.withColumn("_lo", lo.cast("long")).withColumn("_hi", hi.cast("long")).filter("_lo < _hi")
    n_blocks = F.floor((F.col("_hi") - 1 - F.col("_lo")) / span).cast("long")
    d = d.withColumn("_b", F.explode(F.sequence(F.lit(0).cast("long"), n_blocks)))
    d = d.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "video_id", "_b")
    first = F.col("_lo") + F.col("_b") * span
    last = F.least(first + span - step, F.col("_lo") + F.floor((F.col("_hi") - 1 - F.col("_lo")) / step).cast("long") * step)
    return d.withColumn(name, F.explode(F.sequence(first, last, F.lit(step).cast("long")))).drop("_lo", "_hi", "_b")


def frame_spine(recordings: DataFrame, total: Column | None = None, step: int = 1) -> DataFrame:
    """One row per frame 0..total_frames-1 of each recording."""
    total = F.col("total_frames") if total is None else total
    return expand_range(recordings, F.lit(0), total, step=step).select("video_id", "frame_idx")


def paint(df: DataFrame, lo: Column, hi: Column, value: Callable[[Column], Column]) -> DataFrame:
    """Rows (video_id, frame_idx, v) for frames lo..hi-1; ``value`` maps frame to a column."""
    return expand_range(df, lo, hi).select("video_id", "frame_idx", value(F.col("frame_idx")).cast("double").alias("v"))


def _whole_blocks(pieces: DataFrame) -> DataFrame:
    """``video_id, block, v``: the largest constant of the pieces that cover a block between their ends.

    The run of whole blocks of a piece is cut into halves of halves (two at most of each size), so its rows
    grow with the logarithm of its length; the largest value of each part then goes down to its blocks.
    """
    runs = pieces.select("video_id", "v", (F.floor(F.col("lo") / EXPAND_BLOCK) + 1).alias("l"), F.floor((F.col("hi") - 1) / EXPAND_BLOCK).alias("r")).filter("l < r")
    size = lambda k: F.call_function("shiftleft", F.lit(1).cast("long"), k)
    up, down = lambda k: F.ceil(F.col("l") / size(k)).cast("long"), lambda k: F.floor(F.col("r") / size(k)).cast("long")
    part = lambda k, at, on: F.when(on, F.struct(k.alias("level"), at.alias("at")))
    at_level = lambda k: F.array(part(k, up(k), (up(k) % 2 == 1) & (up(k) < down(k))), part(k, down(k) - 1, (down(k) % 2 == 1) & (up(k) < down(k)) & ~((up(k) % 2 == 1) & (down(k) - 1 == up(k)))))
    levels = F.sequence(F.lit(0), F.floor(F.log2(F.col("r") - F.col("l"))).cast("int"))
    parts = runs.select("video_id", "v", F.inline(F.array_compact(F.flatten(F.transform(levels, at_level))))).groupBy("video_id", "level", "at").agg(F.max("v").alias("v"))
    parts = cut(parts)
    top = parts.agg(F.max("level").alias("k")).first()["k"]
    here = None
    for k in range(top if top is not None else -1, -1, -1):
        mine = parts.filter(F.col("level") == k).select("video_id", "at", "v")
        if here is not None:
            mine = mine.unionByName(here.select("video_id", F.explode(F.array(F.col("at") * 2, F.col("at") * 2 + 1)).alias("at"), "v")).groupBy("video_id", "at").agg(F.max("v").alias("v"))
        here = mine
    here = parts.select("video_id", "at", "v").limit(0) if here is None else here
    return here.withColumnRenamed("at", "block")


def _paint_block(frames: pd.DataFrame, pieces: pd.DataFrame) -> pd.DataFrame:
    at = frames["frame_idx"].to_numpy()
    start = int(at.min()) if len(at) else 0
    best = np.full(int(at.max()) - start + 1 if len(at) else 0, np.nan)
    for lo, hi, v, slope in zip(*(pieces[c].to_numpy() for c in ("lo", "hi", "v", "slope"))):
        a, b = max(int(lo) - start, 0), min(int(hi) - start, len(best))
        if a < b:
            np.fmax(best[a:b], v + slope * np.arange(a + start - lo, b + start - lo), out=best[a:b])
    return frames[["video_id", "frame_idx"]].assign(score=best[at - start] if len(at) else best)


def paint_largest(spine: DataFrame, pieces: DataFrame) -> DataFrame:
    """``video_id, frame_idx, score``: for every frame of the spine the largest value of the pieces that
    cover it, null where none does. A piece (``video_id, lo, hi, v, slope``) is ``v`` at frame ``lo`` and
    ``slope`` more at each further frame below ``hi``.

    Pieces are never filled frame by frame: a block of frames gets those that begin or end in it (sloping
    ones in each block they touch) and one value for all that cover it as a whole.
    """
    flat = F.col("slope") == 0
    p = pieces.filter("lo < hi").withColumns({"_b0": F.floor(F.col("lo") / EXPAND_BLOCK), "_b1": F.floor((F.col("hi") - 1) / EXPAND_BLOCK)})
    touched = F.when(flat, F.array_distinct(F.array("_b0", "_b1"))).otherwise(F.sequence("_b0", "_b1"))
    rows = p.select("video_id", F.explode(touched).alias("block"), "lo", "hi", "v", "slope")
    whole = _whole_blocks(p.filter(flat)).select("video_id", "block", (F.col("block") * EXPAND_BLOCK).alias("lo"), ((F.col("block") + 1) * EXPAND_BLOCK).alias("hi"), "v", F.lit(0.0).alias("slope"))
    f = spine.select("video_id", "frame_idx", F.floor(F.col("frame_idx") / EXPAND_BLOCK).alias("block"))
    kind = {n: t for n, t in spine.dtypes}
    schema = f"video_id {kind['video_id']}, frame_idx {kind['frame_idx']}, score double"
    return f.groupBy("video_id", "block").cogroup(rows.unionByName(whole).groupBy("video_id", "block")).applyInPandas(_paint_block, schema)


def with_length(df: DataFrame, total: int | DataFrame) -> DataFrame:
    """``df`` and ``_total``, the frames of its recording: one number for all, or a table of
    ``video_id, total_frames``, a row per recording."""
    if isinstance(total, DataFrame):
        return join_on(df, total.select("video_id", F.col("total_frames").cast("long").alias("_total")), ("video_id",))
    return df.withColumn("_total", F.lit(total).cast("long"))


def interval_mask(spine: DataFrame, intervals: DataFrame, total: int | DataFrame, end_inclusive: bool = False) -> DataFrame:
    """0/1 ground truth per frame. The end frame belongs to the interval only on request;
    starts beyond the recording fall on its last frame. A frame is inside where more intervals have begun
    than ended: running sums over the starts and ends put among the frames."""
    s = F.least(F.col("s"), F.col("_total") - 1).cast("long")
    e = F.least(F.col("e") + (1 if end_inclusive else 0), F.col("_total")).cast("long")
    iv = with_length(intervals, total).select("video_id", s.alias("_s"), e.alias("_e")).filter("_s < _e")
    turns = iv.select("video_id", F.inline(F.array(F.struct(F.col("_s").alias("frame_idx"), F.lit(1).alias("_d")), F.struct(F.col("_e").alias("frame_idx"), F.lit(-1).alias("_d")))))
    turns = turns.groupBy("video_id", "frame_idx").agg(F.sum("_d").alias("_d")).withColumn("_what", F.lit(0))
    kind = dict(spine.dtypes)["frame_idx"]
    both = turns.select("video_id", F.col("frame_idx").cast(kind).alias("frame_idx"), "_d", "_what").unionByName(spine.select("video_id", "frame_idx", F.lit(0).cast("long").alias("_d"), F.lit(1).alias("_what")))
    open_ = running(both, Lane(("video_id",), ("frame_idx", "_what"), EXPAND_BLOCK), {"_open": ("sum", F.col("_d"))})
    return open_.filter("_what = 1").select("video_id", "frame_idx", F.when(F.col("_open") > 0, 1).otherwise(0).alias("gt"))


def _piece(v: DataFrame, lo: Column, hi: Column, value: Column, slope: Column) -> DataFrame:
    return v.select("video_id", lo.cast("long").alias("lo"), hi.cast("long").alias("hi"), value.cast("double").alias("v"), slope.cast("double").alias("slope"))


def ramp_scores(spine: DataFrame, verdicts: DataFrame, total: int | DataFrame, fps: float, ramp_sec: float = 5.0) -> DataFrame:
    """Confidence over each flagged interval with linear ramps (0.1 to 0.8 of it) on both
    sides; overlapping verdicts keep the larger value. Recordings that are flagged but end
    up silent get 0.2 of their largest confidence everywhere. Clipped to [0, 1]."""
    n = int(ramp_sec * fps)
    lim = lambda c: F.greatest(F.lit(0), F.least(F.floor(c * fps), F.col("_total"))).cast("long")
    v = with_length(verdicts.filter("is_anomaly and end_sec > start_sec"), total).select("video_id", "_total", "confidence", lim(F.col("start_sec")).alias("a"), lim(F.col("end_sec")).alias("b"))
    v = v.withColumns({"_s": F.greatest(F.lit(0), F.col("a") - n).cast("long"), "_e": F.least(F.col("_total"), F.col("b") + n).cast("long")})
    a, b, conf, flat = F.col("a"), F.col("b"), F.col("confidence"), F.lit(0.0)
    step = lambda m: F.when(m > 1, conf * 0.7 / (m - 1)).otherwise(0.0)
    pieces = _piece(v, a, b, conf, flat).unionByName(_piece(v, F.col("_s"), a, conf * 0.1, step(a - F.col("_s")))).unionByName(_piece(v, b, F.col("_e"), conf * 0.8, -step(F.col("_e") - b)))
    best = paint_largest(spine, pieces)
    flagged = verdicts.filter("is_anomaly").groupBy("video_id").agg(F.max("confidence").alias("_c"))
    top = pieces.filter("lo < hi").groupBy("video_id").agg(F.max(F.greatest("v", F.col("v") + F.col("slope") * (F.col("hi") - 1 - F.col("lo")))).alias("_top"))
    fill = join_on(flagged, top, ("video_id",), "left").select("video_id", F.when(F.coalesce("_top", F.lit(0.0)) < 0.01, F.col("_c") * 0.2).alias("_fill"))
    j = join_on(best, fill, ("video_id",), "left")
    return j.select("video_id", "frame_idx", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("_fill", "score", F.lit(0.0)))).alias("score"))


def step_scores(spine: DataFrame, segments: DataFrame, total: int | DataFrame, fps: float, expand: float = 1.0) -> DataFrame:
    """Confidence over each segment and 0.6 of it in a one-second border on both sides."""
    fl = lambda c: F.floor(c * fps).cast("long")
    total_ = F.col("_total")
    s = with_length(segments, total).select(
        "video_id", "confidence",
        F.least(fl(F.greatest(F.lit(0.0), F.col("start_sec") - expand)), total_ - 1).alias("sf"),
        F.least(fl(F.least((total_ - 1) / F.lit(max(fps, 1e-6)), F.col("end_sec") + expand)), total_).alias("ef"),
        F.least(fl(F.col("start_sec")), total_ - 1).alias("cs"), F.least(fl(F.col("end_sec")), total_).alias("ce"),
    )
    c, flat = F.col("confidence"), F.lit(0.0)
    pieces = _piece(s, F.col("sf"), F.col("cs"), c * 0.6, flat).unionByName(_piece(s, F.col("cs"), F.col("ce"), c, flat)).unionByName(_piece(s, F.col("ce"), F.col("ef"), c * 0.6, flat))
    return paint_largest(spine, pieces).withColumn("score", F.coalesce("score", F.lit(0.0)))


def _on_spine(spine: DataFrame, scores: DataFrame) -> DataFrame:
    """Every frame of the spine with its score, 0 where it has none. Both sides are filled from far fewer
    rows, by which Spark would take the scores of all frames for small enough to send to every task."""
    return join_on(spine, scores.hint("merge"), ("video_id", "frame_idx"), "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def last_writer_scores(segments: DataFrame) -> DataFrame:
    """Score per frame from [start, end) segments; the one starting last wins. Frames run up
    to the largest end frame of the recording; uncovered frames score 0."""
    d = expand_range(segments, F.col("start_frame"), F.col("end_frame"))
    best = d.groupBy("video_id", "frame_idx").agg(F.max_by("score", F.struct("start_frame", "seg_idx")).alias("score"))
    spine = frame_spine(segments.groupBy("video_id").agg(F.max("end_frame").alias("total_frames")).filter("total_frames > 0"))
    return _on_spine(spine, best)


def window_mean_scores(spine: DataFrame, windows: DataFrame) -> DataFrame:
    """Mean score of the windows that cover a frame, 0 where none does."""
    hit = paint(windows, F.col("start_frame"), F.col("end_frame"), lambda f: F.col("score"))
    m = hit.groupBy("video_id", "frame_idx").agg(F.avg("v").alias("score"))
    return _on_spine(spine, m)


def interpolate(spine: DataFrame, samples: DataFrame, value: str, lane: Lane, tail: str = "flat") -> DataFrame:
    """Linear interpolation of sampled values on every frame; flat beyond both ends.

    The nearest sample on each side is found with two running passes over time slices.
    Array values are interpolated element by element.
    """
    pos = lane.order[0]
    j = join_on(spine, samples.select(*lane.keys, pos, F.col(value).alias("_v")), (*lane.keys, pos), "left")
    j = cut(j)  # the two passes below read it four times
    known = F.when(F.col("_v").isNotNull(), F.struct(F.col(pos).alias("p"), F.col("_v").alias("v")))
    j = running(j, lane, {"_b": ("last", known)})
    j = j.withColumn("_neg", -F.col(pos))
    j = running(j, Lane(lane.keys, ("_neg",), lane.width), {"_a": ("last", known)})
    al = (F.col(pos) - F.col("_b.p")) / (F.col("_a.p") - F.col("_b.p"))
    is_array = samples.schema[value].dataType.typeName() == "array"
    mix = (
        F.zip_with("_b.v", "_a.v", lambda x, y: x.cast("double") * (1 - al) + y.cast("double") * al)
        if is_array
        else F.col("_b.v") * (1 - al) + F.col("_a.v") * al
    )
    out = F.when(F.col("_b").isNull(), F.col("_a.v")).when(F.col("_a").isNull() | (F.col("_a.p") == F.col("_b.p")), F.col("_b.v")).otherwise(mix)
    return j.select(*lane.keys, pos, out.alias(value))


def fixed_windows(recordings: DataFrame, seconds: float, overlap: float, fps: float, min_rows: int) -> DataFrame:
    """Sliding windows from frame 0 with a fixed overlap; a tail shorter than ``min_rows`` is dropped."""
    size = int(seconds * fps)
    step = max(1, size - int(size * overlap))
    w = expand_range(recordings.select("video_id", "total_frames"), F.lit(0), F.col("total_frames"), "start_frame", step)
    w = w.withColumn("win", (F.col("start_frame") / step).cast("long"))
    w = w.withColumn("end_frame", F.least(F.col("start_frame") + size, F.col("total_frames")))
    return w.filter(F.col("end_frame") - F.col("start_frame") >= min_rows).select("video_id", "win", "start_frame", "end_frame")


def even_picks(df: DataFrame, n: int, start: Column, end: Column) -> DataFrame:
    """``n`` evenly spaced integers from start to end inclusive, rounded down."""
    i = F.sequence(F.lit(0), F.lit(n - 1))
    step = (end - start) / F.lit(float(max(1, n - 1)))
    return df.withColumn("pick_idx", F.explode(i)).withColumn("pick", F.floor(start + F.col("pick_idx") * step).cast("long"))
