"""Order-dependent operators that never put a whole key in one task.

A ``Lane`` says what a sequence is: key columns, a unique ascending order whose first
column is numeric (time, frame, negated score, ...), and a slice width on that column.
Every operator here works in two levels: rows are windowed inside ``(keys, slice)``, one
small summary row per slice is windowed per key, and the summary is joined back on
``(keys, slice)``. A key holding a third of the table is therefore spread over its slices;
only the slice summaries of a key meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronotrace.session import cut

SLICE = "_slice"


@dataclass(frozen=True)
class Lane:
    keys: tuple[str, ...]
    order: tuple[str, ...]
    width: float = 1.0

    def cut_into_slices(self, df: DataFrame) -> DataFrame:
        return df.withColumn(SLICE, F.floor(F.col(self.order[0]) / F.lit(float(self.width))).cast("long"))

    @property
    def part(self) -> tuple[str, ...]:
        return (*self.keys, SLICE)

    def row_window(self):
        return W.partitionBy(*self.part).orderBy(*self.order)

    def slice_window(self):
        return W.partitionBy(*self.keys).orderBy(SLICE)

    def order_struct(self) -> Column:
        return F.struct(*self.order)


def join_on(left: DataFrame, right: DataFrame, cols, how: str = "inner") -> DataFrame:
    """Equi-join on same-named columns, keeping one copy; keys are never null here."""
    return left.join(right, list(cols), how)


def _spec_total(kind: str, x: Column, order: Column) -> Column:
    if kind == "sum":
        return F.sum(x)
    if kind == "max":
        return F.max(x)
    if kind == "min":
        return F.min(x)
    if kind == "last":
        return F.max_by(x, F.when(x.isNotNull(), order))
    raise ValueError(f"unknown running aggregate {kind!r}")


def _spec_window(kind: str, x: Column, w) -> Column:
    fn = {"sum": F.sum, "max": F.max, "min": F.min}.get(kind)
    return fn(x).over(w) if fn else F.last(x, ignorenulls=True).over(w)


def running(
    df: DataFrame,
    lane: Lane,
    specs: dict[str, tuple[str, Column]],
    include_current: bool = True,
    drop_slice: bool = True,
) -> DataFrame:
    """Prefix aggregates in lane order.

    ``specs`` maps an output column to ``(kind, expression)`` with kind one of ``sum``,
    ``max``, ``min`` or ``last`` (last non-null value). With ``include_current=False`` the
    aggregate covers strictly earlier rows and is null where there are none.
    """
    names = list(specs)
    tmp = {n: f"_x_{n}" for n in names}
    d = lane.cut_into_slices(df).select("*", *[e.alias(tmp[n]) for n, (_, e) in specs.items()])
    rows = lane.row_window().rowsBetween(W.unboundedPreceding, 0 if include_current else -1)
    local = d.select("*", *[_spec_window(specs[n][0], F.col(tmp[n]), rows).alias(f"_l_{n}") for n in names])
    totals = d.groupBy(*lane.part).agg(
        *[_spec_total(specs[n][0], F.col(tmp[n]), lane.order_struct()).alias(f"_t_{n}") for n in names]
    )
    before = lane.slice_window().rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(
        *lane.part, *[_spec_window(specs[n][0], F.col(f"_t_{n}"), before).alias(f"_o_{n}") for n in names]
    )
    joined = join_on(local, offsets, lane.part)
    out = []
    for n in names:
        kind, loc, off = specs[n][0], F.col(f"_l_{n}"), F.col(f"_o_{n}")
        if kind == "sum":
            out.append(
                F.when(loc.isNull() & off.isNull(), None)
                .otherwise(F.coalesce(loc, F.lit(0)) + F.coalesce(off, F.lit(0)))
                .alias(n)
            )
        elif kind == "max":
            out.append(F.greatest(loc, off).alias(n))
        elif kind == "min":
            out.append(F.least(loc, off).alias(n))
        else:
            out.append(F.coalesce(loc, off).alias(n))
    keep = [c for c in df.columns] + ([] if drop_slice else [SLICE])
    return joined.select(*keep, *out)


def number_rows(df: DataFrame, lane: Lane, name: str = "pos") -> DataFrame:
    """1-based row number per key; a global order when the lane has no keys."""
    d = lane.cut_into_slices(df)
    local = d.withColumn("_l", F.row_number().over(lane.row_window()).cast("long"))
    sizes = d.groupBy(*lane.part).agg(F.count(F.lit(1)).alias("_n"))
    offs = sizes.select(
        *lane.part,
        F.coalesce(F.sum("_n").over(lane.slice_window().rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_o"),
    )
    return join_on(local, offs, lane.part).select(*df.columns, (F.col("_l") + F.col("_o")).alias(name))


def neighbours(
    df: DataFrame,
    lane: Lane,
    previous: dict[str, Column] | None = None,
    following: dict[str, Column] | None = None,
    number: str | None = None,
) -> DataFrame:
    """Values of the row just before / just after (null at the ends), and with ``number`` the
    0-based row number, all from one pass."""
    previous, following = previous or {}, following or {}
    d = lane.cut_into_slices(df)
    cols = [F.struct(*[e.alias(n) for n, e in previous.items()]).alias("_pv")] if previous else []
    cols += [F.struct(*[e.alias(n) for n, e in following.items()]).alias("_fv")] if following else []
    d = d.select("*", *cols)
    w = lane.row_window()
    local, aggs, outs = d, [], []
    if previous:
        local = local.withColumn("_pl", F.lag("_pv").over(w))
        aggs.append(F.max_by("_pv", lane.order_struct()).alias("_last"))
        outs.append(F.lag("_last").over(lane.slice_window()).alias("_po"))
    if following:
        local = local.withColumn("_fl", F.lead("_fv").over(w))
        aggs.append(F.min_by("_fv", lane.order_struct()).alias("_first"))
        outs.append(F.lead("_first").over(lane.slice_window()).alias("_fo"))
    sel0 = []
    if number:
        local = local.withColumn("_i", F.row_number().over(w).cast("long"))
        aggs.append(F.count(F.lit(1)).alias("_n"))
        outs.append(F.coalesce(F.sum("_n").over(lane.slice_window().rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_no"))
        sel0 = [(F.col("_i") - 1 + F.col("_no")).alias(number)]
    edges = d.groupBy(*lane.part).agg(*aggs).select(*lane.part, *outs)
    j = join_on(local, edges, lane.part)
    sel = [F.coalesce(F.col("_pl"), F.col("_po"))[n].alias(n) for n in previous]
    sel += [F.coalesce(F.col("_fl"), F.col("_fo"))[n].alias(n) for n in following]
    return j.select(*df.columns, *sel0, *sel)


def islands(
    df: DataFrame,
    lane: Lane,
    carry: dict[str, Column],
    starts_new: Callable[[Column, Column], Column],
    name: str = "island",
) -> DataFrame:
    """Number maximal runs of rows: ``starts_new(prev, cur)`` says where a run begins.

    ``carry`` names the values the test needs; both arguments are structs of them. The
    first row of a key always starts run 1.
    """
    d = lane.cut_into_slices(df).withColumn("_c", F.struct(*[e.alias(n) for n, e in carry.items()]))
    w = lane.row_window()
    d = d.withColumn("_p", F.lag("_c").over(w))
    d = d.withColumn("_b", F.when(F.col("_p").isNull(), 0).otherwise(F.when(starts_new(F.col("_p"), F.col("_c")), 1).otherwise(0)))
    local = d.withColumn("_l", F.sum("_b").over(w.rowsBetween(W.unboundedPreceding, 0)))
    s = d.groupBy(*lane.part).agg(
        F.sum("_b").alias("_n"),
        F.min_by("_c", lane.order_struct()).alias("_first"),
        F.max_by("_c", lane.order_struct()).alias("_last"),
    )
    sw = lane.slice_window()
    s = s.withColumn("_pl", F.lag("_last").over(sw))
    s = s.withColumn(
        "_h", F.when(F.col("_pl").isNull(), 1).otherwise(F.when(starts_new(F.col("_pl"), F.col("_first")), 1).otherwise(0))
    )
    s = s.select(
        *lane.part,
        (
            F.sum("_h").over(sw.rowsBetween(W.unboundedPreceding, 0))
            + F.coalesce(F.sum("_n").over(sw.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
        ).alias("_o"),
    )
    return join_on(local, s, lane.part).select(*df.columns, (F.col("_l") + F.col("_o")).alias(name))


def bounded_window(
    df: DataFrame,
    keys: tuple[str, ...],
    pos: str,
    before: int,
    after: int,
    exprs: Callable[[object], list[Column]],
    block: int = 4096,
) -> DataFrame:
    """Window over the ``before`` preceding and ``after`` following rows by dense position.

    ``pos`` is a gap-free integer position per key. Rows near a block edge are also sent to
    the neighbouring block, so each block is windowed alone and edge copies are dropped.
    """
    block = max(block, before + after + 1)
    home = F.floor(F.col(pos) / block).cast("long")
    d = df.withColumn("_home", home)
    off = F.col(pos) - F.col("_home") * block
    homes = F.array_compact(
        F.array(
            F.col("_home"),
            F.when(off < after, F.col("_home") - 1),
            F.when(off >= block - before, F.col("_home") + 1),
        )
    )
    d = d.withColumn("_blk", F.explode(homes))
    w = W.partitionBy(*keys, "_blk").orderBy(pos).rowsBetween(-before, after)
    return d.select("*", *exprs(w)).filter(F.col("_blk") == F.col("_home")).drop("_blk", "_home")


def exact_quantiles(
    df: DataFrame, keys: tuple[str, ...], value: str, points: dict[str, float], buckets: int = 64
) -> DataFrame:
    """Exact linear-interpolated quantiles per key without gathering a key's values.

    Values are collapsed to (value, count), spread over buckets of about as many distinct values
    (their bounds are approximate percentiles, which any outlier leaves where they are), and only
    the buckets that hold a wanted rank are ordered.
    """
    keys = keys or ("_all",)
    d = df.withColumn("_all", F.lit(0)) if keys == ("_all",) else df
    vc = d.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    vc = cut(vc)  # read four times below
    bounds = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    stats = vc.groupBy(*keys).agg(F.percentile_approx("_v", bounds, F.lit(20 * buckets)).alias("_bounds"), F.sum("_n").alias("_tot"))
    vb = join_on(vc, stats, keys).withColumn("_b", F.size(F.filter("_bounds", lambda x: x <= F.col("_v"))).cast("long")).drop("_bounds")
    hist = vb.groupBy(*keys, "_b").agg(F.sum("_n").alias("_bn"), F.max("_tot").alias("_tot"))
    kw = W.partitionBy(*keys).orderBy("_b")
    hist = hist.withColumn("_end", F.sum("_bn").over(kw.rowsBetween(W.unboundedPreceding, 0)))
    hist = hist.withColumn("_start", F.col("_end") - F.col("_bn"))
    wants = F.array(
        *[
            F.struct(
                F.lit(n).alias("q"),
                F.floor(F.lit(float(p)) * (F.col("_tot") - 1)).cast("long").alias("lo"),
                F.ceil(F.lit(float(p)) * (F.col("_tot") - 1)).cast("long").alias("hi"),
                (F.lit(float(p)) * (F.col("_tot") - 1)).alias("at"),
            )
            for n, p in points.items()
        ]
    )
    hist = hist.withColumn("_w", F.explode(wants))
    hits = (
        hist.filter(
            ((F.col("_w.lo") >= F.col("_start")) & (F.col("_w.lo") < F.col("_end")))
            | ((F.col("_w.hi") >= F.col("_start")) & (F.col("_w.hi") < F.col("_end")))
        )
        .groupBy(*keys, "_b")
        .agg(F.first("_start").alias("_start"), F.collect_list("_w").alias("_ws"))
    )
    cand = join_on(vb.select(*keys, "_b", "_v", "_n"), hits, (*keys, "_b"))
    vw = W.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(W.unboundedPreceding, 0)
    cand = cand.withColumn("_e", F.col("_start") + F.sum("_n").over(vw)).withColumn("_s", F.col("_e") - F.col("_n"))
    cand = cand.withColumn("_w", F.explode("_ws"))
    at_lo = (F.col("_w.lo") >= F.col("_s")) & (F.col("_w.lo") < F.col("_e"))
    at_hi = (F.col("_w.hi") >= F.col("_s")) & (F.col("_w.hi") < F.col("_e"))
    picked = (
        cand.filter(at_lo | at_hi)
        .groupBy(*keys, F.col("_w.q").alias("_q"))
        .agg(
            F.max(F.when(at_lo, F.col("_v"))).alias("_vlo"),
            F.max(F.when(at_hi, F.col("_v"))).alias("_vhi"),
            F.max(F.col("_w.at") - F.col("_w.lo")).alias("_fr"),
        )
        .withColumn("_val", F.col("_vlo") + (F.col("_vhi") - F.col("_vlo")) * F.col("_fr"))
    )
    out = picked.groupBy(*keys).agg(*[F.max(F.when(F.col("_q") == n, F.col("_val"))).alias(n) for n in points])
    return out.drop("_all")


def descending(lane: Lane, axis: str) -> Lane:
    """Same lane over another (for example negated) axis column."""
    return replace(lane, order=(axis, *lane.order[1:]))
