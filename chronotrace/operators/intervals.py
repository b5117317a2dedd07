"""Interval algebra and time joins.

Joins on time never compare all rows of a recording with each other: the axis is divided
into buckets, intervals are sent to the buckets they touch, and the join is an equi-join
on (keys, bucket) with the exact predicate as residual.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronotrace.operators.ordered import Lane, islands, join_on, neighbours, number_rows, running
from chronotrace.session import cut

BKT = "_bkt"


def _bucket(c: Column, width: float) -> Column:
    return F.floor(c / F.lit(float(width))).cast("long")


def to_buckets(df: DataFrame, start: Column, end: Column, width: float) -> DataFrame:
    """Copy each interval row to every bucket it touches (none for an empty interval)."""
    lo, hi = _bucket(start, width), _bucket(end, width)
    return df.withColumn("_b0", lo).withColumn(BKT, F.explode(F.when(end >= start, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))))


def points_in_intervals(
    points: DataFrame,
    intervals: DataFrame,
    keys: tuple[str, ...],
    point: str,
    start: Column,
    end: Column,
    width: float,
    predicate: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Inner join of points with the intervals that contain them (both ends included
    unless ``predicate`` narrows it). Non-key column names must differ."""
    lo, hi = "_iv_lo", "_iv_hi"
    i = intervals.withColumn(lo, start).withColumn(hi, end)
    i = to_buckets(i, F.col(lo), F.col(hi), width).drop("_b0")
    p = points.withColumn(BKT, _bucket(F.col(point), width))
    j = join_on(p, i, (*keys, BKT)).filter((F.col(point) >= F.col(lo)) & (F.col(point) <= F.col(hi)))
    if predicate is not None:
        j = j.filter(predicate(F.col(point)))
    return j.drop(BKT, lo, hi)


START, POINT, END = 0, 1, 2
#: Sums of whole slices are exact to this scale, so a range far into a long recording loses nothing.
EXACT = "decimal(38,18)"


def _next_value(column: str, keys: tuple[str, ...], order: tuple[str, ...]) -> Column:
    """The next value that is not null. A frame to the end of the partition would be read anew for each row."""
    name = lambda c: f"`{c}`"
    part = f"PARTITION BY {', '.join(map(name, keys))} " if keys else ""
    return F.expr(f"lead({name(column)}) IGNORE NULLS OVER ({part}ORDER BY {', '.join(map(name, order))})")


def range_totals(
    intervals: DataFrame,
    points: DataFrame,
    keys: tuple[str, ...],
    ids: tuple[str, ...],
    point: str,
    start: Column,
    end: Column,
    width: float,
    sums: dict[str, Column] | None = None,
    count: str = "n_points",
    ends: dict[str, Column] | None = None,
) -> DataFrame:
    """Every interval row with totals over the points of its keys that it contains (closed ends): the number
    of points, ``sums``, and for each of ``ends`` its value at the first and last point (``first_`` and
    ``last_`` name). Without points, or with an end missing or before the start, the count is 0 and the
    rest null. ``ids`` tell intervals of one key apart.

    No point meets an interval. Points and both ends of the intervals are put on one axis, cut into slices
    of ``width``, and prefix sums run along it; a total is the difference of two. Only the ends of intervals
    are joined with what stands before their slice; the interval's other columns meet the totals at last, once,
    so rows moved are those of both inputs whatever the intervals cover.
    """
    sums, ends = sums or {}, ends or {}
    columns = intervals.columns
    x = [e.cast("double").alias(f"_s{i}") for i, e in enumerate(sums.values())]
    e_ = [e.alias(f"_e{i}") for i, e in enumerate(ends.values())]
    p = points.filter(F.col(point).isNotNull()).select(*keys, F.lit(None).cast("long").alias("_id"), F.col(point).cast("double").alias("_at"), F.lit(POINT).alias("_what"), *x, *e_)
    void = [F.lit(None).cast(p.schema[c].dataType).alias(c) for c in p.columns if c.startswith(("_s", "_e"))]
    intervals = cut(intervals.withColumn("_id", F.xxhash64(*keys, *ids)))  # read for the ends, and for the rows they belong to
    side = lambda at, what: F.struct(at.cast("double").alias("_at"), F.lit(what).alias("_what"))
    both = intervals.select(*keys, "_id", F.inline(F.array(side(start, START), side(end, END))))
    d = p.unionByName(both.select("*", *void)).withColumn("_slice", F.floor(F.col("_at") / F.lit(float(width))).cast("long"))
    is_point = F.col("_what") == POINT
    ties = [f"_e{i}" for i in range(len(ends))]  # of points at the same place the least is first
    order = W.partitionBy(*keys, "_slice").orderBy("_at", "_what", *ties)
    upto = order.rowsBetween(W.unboundedPreceding, 0)
    local = [F.count(F.when(is_point, 1)).over(upto).alias("_n")]
    local += [F.sum(f"_s{i}").over(upto).alias(f"_ls{i}") for i in range(len(sums))]
    value = lambda i: F.when(is_point, F.struct(F.col(f"_e{i}").alias("v")))
    local += [F.last(value(i), ignorenulls=True).over(upto).alias(f"_ll{i}") for i in range(len(ends))]
    d = d.select("*", *[value(i).alias(f"_v{i}") for i in range(len(ends))])
    local += [F.coalesce(f"_v{i}", _next_value(f"_v{i}", (*keys, "_slice"), ("_at", "_what", *ties))).alias(f"_lf{i}") for i in range(len(ends))]
    edge = [F.lag("_what").over(order).isNull().alias("_opens"), F.lead("_what").over(order).isNull().alias("_closes")]
    # the ends of intervals, and the first and last row of each slice: all that is read from here on
    d = cut(d.select(*keys, "_slice", "_at", "_what", "_id", *local, *edge).filter(~is_point | F.col("_opens") | F.col("_closes")))
    bounds, same = d.filter(~is_point), [*keys, "_slice"]
    closing = lambda c: F.max(F.when(F.col("_closes"), F.col(c)))
    per = d.filter(F.col("_slice").isNotNull() & (F.col("_opens") | F.col("_closes"))).groupBy(*same).agg(
        closing("_n").alias("_tn"), *[closing(f"_ls{i}").cast(EXACT).alias(f"_ts{i}") for i in range(len(sums))],
        *[closing(f"_ll{i}").alias(f"_tl{i}") for i in range(len(ends))], *[F.max(F.when(F.col("_opens"), F.col(f"_lf{i}"))).alias(f"_tf{i}") for i in range(len(ends))],
    )
    w = W.partitionBy(*keys).orderBy("_slice")
    before = w.rowsBetween(W.unboundedPreceding, -1)
    per = per.select(
        *same, F.coalesce(F.sum("_tn").over(before), F.lit(0)).alias("_bn"), *[F.coalesce(F.sum(f"_ts{i}").over(before), F.lit(0).cast(EXACT)).cast(EXACT).alias(f"_bs{i}") for i in range(len(sums))],
        *[F.last(f"_tl{i}", ignorenulls=True).over(before).alias(f"_bl{i}") for i in range(len(ends))], *[_next_value(f"_tf{i}", keys, ("_slice",)).alias(f"_bf{i}") for i in range(len(ends))],
    )
    j = join_on(bounds, per, same, "left")
    at = lambda what, c: F.max(F.when(F.col("_what") == what, c))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    # plain numbers only, which a hash table holds: where there are points, first and last are those of points
    aggs = [F.count("_at").alias("_both")]
    aggs += [(at(END, F.col("_n") + F.col("_bn")) - at(START, F.col("_n") + F.col("_bn"))).alias("_c")]
    for i in range(len(sums)):
        aggs += [(at(END, F.col(f"_bs{i}")) - at(START, F.col(f"_bs{i}"))).cast("double").alias(f"_whole{i}"), (at(END, zero(f"_ls{i}")) - at(START, zero(f"_ls{i}"))).alias(f"_part{i}")]
    for i in range(len(ends)):
        aggs += [at(START, F.coalesce(f"_lf{i}", f"_bf{i}")["v"]).alias(f"_first{i}"), at(END, F.coalesce(f"_ll{i}", f"_bl{i}")["v"]).alias(f"_last{i}")]
    g = j.groupBy(*keys, "_id").agg(*aggs)
    some = (F.col("_both") == 2) & (F.col("_c") > 0)
    out = [F.when(some, F.col("_c")).otherwise(0).cast("long").alias(count)]
    out += [F.when(some, F.col(f"_whole{i}") + F.col(f"_part{i}")).alias(n) for i, n in enumerate(sums)]
    out += [F.when(some, F.col(f"_{side}{i}")).alias(f"{side}_{n}") for i, n in enumerate(ends) for side in ("first", "last")]
    return join_on(intervals, g, (*keys, "_id"), "left").select(*columns, *out)


def range_maxima(intervals: DataFrame, points: DataFrame, keys: tuple[str, ...], ids: tuple[str, ...], point: str, start: Column, end: Column, width: float, value: str, name: str) -> DataFrame:
    """Every interval row with the largest ``value`` of the points it contains (closed ends), null without.

    Points are numbered in order; a range of them is the union of two runs of 2^k points, and the maxima of
    such runs double from level to level, for as many levels as the longest range needs. Rows moved are the
    points once per level and two look-ups per interval.
    """
    p = number_rows(points.filter(F.col(point).isNotNull()).select(*keys, F.col(point).alias("_pt"), F.col(value).cast("double").alias("_v")).withColumn("_u", F.monotonically_increasing_id()), Lane(keys, ("_pt", "_u"), width), "_pos")
    p = cut(p.select(*keys, "_pt", "_pos", "_v"))
    r = range_totals(intervals, p, keys, ids, "_pt", start, end, width, ends={"pos": F.col("_pos")}, count="_k")
    level = F.floor(F.log2(F.col("_k"))).cast("int")
    r = cut(r.withColumn("_level", F.when(F.col("_k") > 0, level)))
    top = r.agg(F.max("_level").alias("l")).first()["l"]
    ask = r.filter("_level is not null").select(*keys, *ids, "_level", F.explode(F.array(F.col("first_pos"), F.col("last_pos") + 1 - F.pow(F.lit(2.0), F.col("_level")).cast("long"))).alias("_pos"))
    found, runs = None, p.select(*keys, "_pos", "_v")
    for k in range((top if top is not None else -1) + 1):
        if k:
            half = 1 << (k - 1)
            runs = cut(join_on(runs, runs.select(*keys, (F.col("_pos") - half).alias("_pos"), F.col("_v").alias("_w")), (*keys, "_pos")).select(*keys, "_pos", F.greatest("_v", "_w").alias("_v")))
        hit = join_on(ask.filter(F.col("_level") == k), runs, (*keys, "_pos")).select(*keys, *ids, "_v")
        found = hit if found is None else found.unionByName(hit)
    r = r.drop("_k", "_level", "first_pos", "last_pos")
    if found is None:
        return r.withColumn(name, F.lit(None).cast("double"))
    return join_on(r, found.groupBy(*keys, *ids).agg(F.max("_v").alias(name)), (*keys, *ids), "left")


def overlaps(
    left: DataFrame,
    right: DataFrame,
    keys: tuple[str, ...],
    left_span: tuple[str, str],
    right_span: tuple[str, str],
    width: float,
) -> DataFrame:
    """Inner join of interval pairs that share at least one point (closed ends).

    A pair meeting in several buckets is kept only in the first shared one.
    """
    ls, le = (F.col(c) for c in left_span)
    rs, re_ = (F.col(c) for c in right_span)
    a = to_buckets(left, ls, le, width).withColumnRenamed("_b0", "_lb0")
    b = to_buckets(right, rs, re_, width).withColumnRenamed("_b0", "_rb0")
    j = join_on(a, b, (*keys, BKT))
    j = j.filter((ls <= re_) & (rs <= le) & (F.col(BKT) == F.greatest("_lb0", "_rb0")))
    return j.drop(BKT, "_lb0", "_rb0")


def overlap_totals(
    segments: DataFrame,
    intervals: DataFrame,
    keys: tuple[str, ...] = ("video_id",),
    seg_id: tuple[str, ...] = ("seg_idx",),
    width: float = 3000.0,
) -> DataFrame:
    """Frames of each segment that lie in annotations, summed over annotations.

    Overlapping annotations count twice. Adds overlap, ratio to the segment's inclusive
    length and a flag. Segments without any overlap keep 0.
    """
    o = overlaps(segments.select(*keys, *seg_id, "start_frame", "end_frame"), intervals.select(*keys, "s", "e"), keys, ("start_frame", "end_frame"), ("s", "e"), width)
    tot = o.groupBy(*keys, *seg_id).agg(F.sum(F.least("end_frame", "e") - F.greatest("start_frame", "s") + 1).alias("overlap"))
    j = join_on(segments, tot, (*keys, *seg_id), "left").withColumn("overlap", F.coalesce("overlap", F.lit(0)))
    ratio = F.col("overlap") / (F.col("end_frame") - F.col("start_frame") + 1)
    return j.withColumn("overlap_ratio", ratio).withColumn("contains_anomaly", F.col("overlap") > 0)


def nearest_point(
    probes: DataFrame, points: DataFrame, keys: tuple[str, ...], probe: str, point: str, order: str, carry: list[str]
) -> DataFrame:
    """Nearest point for each probe of the same key, the earliest in ``order`` on a tie.

    Both sides are merged on the time axis, cut into slices, and each probe takes the last point at or
    before it and the first one after it, so no probe meets every point of its key. Only probes and the ends of
    slices leave the slices. Among points at the same time the smallest ``order`` stands for the group.
    """
    pts = points.groupBy(*keys, F.col(point).cast("double").alias("_ax")).agg(
        F.min_by(F.struct(*[F.col(c) for c in dict.fromkeys([order, point, *carry])]), F.col(order)).alias("_pt")
    )
    pr = probes.select(*keys, F.col(probe).cast("double").alias("_ax"), F.struct(*probes.columns).alias("_row"))
    void_row = pr.schema["_row"].dataType
    void_pt = pts.schema["_pt"].dataType
    both = pts.select(*keys, "_ax", F.lit(0).alias("_side"), "_pt", F.lit(None).cast(void_row).alias("_row")).unionByName(
        pr.select(*keys, "_ax", F.lit(1).alias("_side"), F.lit(None).cast(void_pt).alias("_pt"), "_row")
    )
    found = F.when(F.col("_pt").isNotNull(), F.struct("_ax", "_pt")).alias("_p")
    both = both.filter(F.col("_ax").isNotNull()).select(*keys, "_ax", "_side", "_row", found, F.floor(F.col("_ax") / F.lit(60.0)).cast("long").alias("_slice"))
    part, place = (*keys, "_slice"), ("_ax", "_side")
    w, probing = W.partitionBy(*part).orderBy(*place), F.col("_side") == 1
    # a point at the probe's own time stands before it, so what comes after may be looked for beyond it
    local = both.select(
        *part, "_ax", "_side", "_row", F.last("_p", ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)).alias("_b"), F.coalesce("_p", _next_value("_p", part, place)).alias("_a"),
        F.lag("_side").over(w).isNull().alias("_opens"), F.lead("_side").over(w).isNull().alias("_closes"),
    )
    local = cut(local.filter(probing | F.col("_opens") | F.col("_closes")))  # the probes, and the ends of slices
    at = lambda flag, c: F.first(F.when(F.col(flag), F.col(c)), ignorenulls=True)
    per = local.groupBy(*part).agg(at("_closes", "_b").alias("_last"), at("_opens", "_a").alias("_first"))
    sw = W.partitionBy(*keys).orderBy("_slice")
    per = per.select(*part, F.last("_last", ignorenulls=True).over(sw.rowsBetween(W.unboundedPreceding, -1)).alias("_last"), _next_value("_first", keys, ("_slice",)).alias("_first"))
    r = join_on(local.filter(probing), per, part).withColumns({"_before": F.coalesce("_b", "_last"), "_after": F.coalesce("_a", "_first")})
    d0, d1 = F.col("_ax") - F.col("_before._ax"), F.col("_after._ax") - F.col("_ax")
    o0, o1 = F.col("_before._pt")[order], F.col("_after._pt")[order]
    take_before = F.col("_after").isNull() | (d0 < d1) | ((d0 == d1) & (o0 <= o1))
    r = r.withColumn("_pick", F.when(F.col("_before").isNull(), F.col("_after")).when(take_before, F.col("_before")).otherwise(F.col("_after")))
    cols = [F.col("_row")[c].alias(c) for c in probes.columns]
    extra = [F.col("_pick._pt")[c].alias(c) for c in dict.fromkeys([point, order, *carry]) if c not in probes.columns]
    return r.select(*cols, *extra, F.abs(F.col("_ax") - F.col("_pick._ax")).alias("distance"))


def merge_intervals(df: DataFrame, keys: tuple[str, ...], start: str, end: str, tie: str, gap, width: float, aggs: list[Column]) -> DataFrame:
    """Merge intervals whose start is at most ``gap`` past the running end of the group."""
    lane = Lane(keys, (start, tie), width)
    r = running(df, lane, {"_reach": ("max", F.col(end))}, include_current=False)
    r = running(
        r.withColumn("_new", F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + F.lit(gap)), 1).otherwise(0)),
        lane,
        {"group_id": ("sum", F.col("_new"))},
    )
    return r.groupBy(*keys, "group_id").agg(F.min(start).alias(start), F.max(end).alias(end), *aggs)


def coverage(intervals: DataFrame, segments: DataFrame, width: float = 3000.0) -> DataFrame:
    """Share of each annotated interval covered by the union of segments, and how many
    segments touch it. Lengths are inclusive; overlapping segments are not counted twice."""
    o = overlaps(intervals, segments.select("video_id", "seg_idx", "start_frame", "end_frame"), ("video_id",), ("s", "e"), ("start_frame", "end_frame"), width)
    clipped = o.select("video_id", "iv_idx", "seg_idx", F.greatest("s", "start_frame").alias("a"), F.least("e", "end_frame").alias("b"))
    merged = merge_intervals(clipped, ("video_id", "iv_idx"), "a", "b", "seg_idx", 1, width, [F.count(F.lit(1)).alias("n_seg")])
    tot = merged.groupBy("video_id", "iv_idx").agg(F.sum(F.col("b") - F.col("a") + 1).alias("covered"), F.sum("n_seg").alias("fragments"))
    j = join_on(intervals, tot, ("video_id", "iv_idx"), "left")
    return j.select(
        "video_id", "iv_idx",
        (F.coalesce("covered", F.lit(0)) / (F.col("e") - F.col("s") + 1)).alias("coverage"),
        F.coalesce("fragments", F.lit(0)).cast("long").alias("fragments"),
    )


def merge_close_points(df: DataFrame, lane: Lane, min_gap: float) -> DataFrame:
    """Collapse points closer than ``min_gap`` to their predecessor; the last of a run stays."""
    axis = lane.order[0]
    r = islands(df, lane, {"a": F.col(axis)}, lambda p, c: c["a"] - p["a"] >= min_gap, "_run")
    return r.groupBy(*lane.keys, "_run").agg(F.max(axis).alias(axis)).drop("_run")


def points_to_intervals(points: DataFrame, lane: Lane, min_gap: float, total: Column, fps: float) -> DataFrame:
    """Each point opens an interval that ends at the next one, or after ``min_gap`` seconds."""
    axis = lane.order[0]
    r = neighbours(points, lane, following={"_nx": F.col(axis)})
    start = F.greatest(F.lit(0.0), F.col(axis) / fps)
    end = F.least(F.coalesce(F.col("_nx") / fps, F.col(axis) / fps + min_gap), total)
    return r.select(*lane.keys, start.alias("start_sec"), end.alias("end_sec")).filter("end_sec > start_sec")


def fill_gaps(spans: DataFrame, totals: DataFrame, fps: float) -> DataFrame:
    """Turn second-based intervals into segments that reach both ends of the recording.

    Spans of at most one frame are dropped; a head and a tail segment are added when
    missing; a recording without any span becomes one segment.
    """
    s = join_on(totals, spans, ("video_id",), "left").select(
        "video_id", "total_frames", "start_sec",
        F.rint(F.col("start_sec") * fps).cast("long").alias("start_frame"),
        F.least(F.rint(F.col("end_sec") * fps).cast("long"), F.col("total_frames") - 1).alias("end_frame"),
    )
    kept = s.filter("end_frame - start_frame > 1").select("video_id", "start_frame", "end_frame")
    ends = s.groupBy("video_id").agg(
        F.max("total_frames").alias("total_frames"),
        F.count("start_sec").alias("given"),
        F.min(F.when(F.expr("end_frame - start_frame > 1"), F.col("start_frame"))).alias("first"),
        F.max(F.when(F.expr("end_frame - start_frame > 1"), F.col("end_frame"))).alias("last"),
    )
    head = ends.filter("first > 0").select("video_id", F.lit(0).cast("long").alias("start_frame"), F.col("first").alias("end_frame"))
    tail = ends.withColumn("last", F.coalesce("last", F.lit(0))).filter("last < total_frames - 1").select(
        "video_id", F.col("last").cast("long").alias("start_frame"), (F.col("total_frames") - 1).alias("end_frame")
    )
    return kept.unionByName(head).unionByName(tail)


def cluster_points(
    df: DataFrame, lane: Lane, gap: float, score: Column, keep: int, pad: float
) -> DataFrame:
    """Group points at most ``gap`` apart, keep the ``keep`` clusters with the largest score
    sum per key and pad them; ``peak`` is the time of the strongest point."""
    axis = lane.order[0]
    r = islands(df.withColumn("_s", score), lane, {"a": F.col(axis)}, lambda p, c: c["a"] - p["a"] > gap, "cluster")
    g = r.groupBy(*lane.keys, "cluster").agg(
        F.min(axis).alias("t0"), F.max(axis).alias("t1"), F.sum("_s").alias("total"), F.count(F.lit(1)).alias("n"),
        F.min_by(axis, F.struct((-F.col("_s")).alias("a"), F.col(axis).alias("b"))).alias("peak"),
    )
    w = W.partitionBy(*lane.keys).orderBy(F.round("total", 9).desc(), "t0")
    g = g.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= keep)
    return g.select(
        *lane.keys, F.col("rank").cast("long").alias("rank"), F.greatest(F.lit(0.0), F.col("t0") - pad).alias("start_sec"),
        (F.col("t1") + pad).alias("end_sec"), "total", F.col("n").cast("long").alias("n"), "peak",
    )
