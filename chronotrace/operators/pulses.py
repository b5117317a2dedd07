"""Scene samples of a recording with a baseline that moves, worked out by many tasks.

The baseline changes at the first row whose drift from it exceeds the limit; that row is the next baseline.
A block of rows is followed from the baseline it is entered with by matrix products. The baselines that
blocks are entered with are guessed at first (no change so far) and corrected in rounds: a block whose
entry was another than guessed is followed again, all such blocks at the same time, until every block has
been followed from the baseline that the blocks before it leave. After a change inside a block its end mostly
no longer depends on the entry, so rounds are few. Should some blocks be unsettled after ``rounds`` rounds,
one pass in order takes the rest; the outcome is the same.

Periodic samples depend on the last sample only. A change of baseline is a sample too, so rows are cut into
segments at changes and the samples of each are found like heartbeats of an entity.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronotrace.operators.ordered import Lane, join_on, number_rows, running
from chronotrace.operators.stateful import trigger_rows
from chronotrace.params import GlobalHeartbeatParams, TriggerParams
from chronotrace.session import cut

BLOCK_ROWS = 1024
ROUNDS = 8
AHEAD = 32  # rows looked at in one product after a change; doubled while none exceeds the limit


def changes_of(rows: np.ndarray, base: np.ndarray, limit: float) -> tuple[list[int], np.ndarray]:
    """Rows at which the baseline changes, and the drift of every row from the baseline it meets."""
    at, out, drift = 0, [], np.empty(len(rows))
    step = AHEAD
    while at < len(rows):
        d = 1.0 - rows[at : at + step] @ base
        over = np.flatnonzero(d > limit)
        n = int(over[0]) + 1 if len(over) else len(d)
        drift[at : at + n] = d[:n]
        at += n
        step = AHEAD if len(over) else 2 * step
        if len(over):
            out.append(at - 1)
            base = rows[at - 1]
    return out, drift


def _block(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray]:
    """Rows of a block in order, their vectors, and the baseline, which comes with the first row."""
    pdf = pdf.sort_values("_n")
    return pdf, np.stack([np.asarray(x, dtype=float) for x in pdf["vec"]]), np.asarray(pdf["entry_vec"].iloc[0], dtype=float)


_ENDS = "video_id {k}, block long, entry long, leaves long, leaves_vec array<double>"
_DRIFTS = "video_id {k}, t double, event_id {i}, drift double, moved boolean"


def _follow(limit: float):
    """Where the last change of a block is and that row's vector, null without a change."""

    def follow(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, rows, base = _block(pdf)
        found, _ = changes_of(rows, base, limit)
        head = pdf.iloc[0]
        last = (int(pdf["_n"].iloc[found[-1]]), rows[found[-1]].tolist()) if found else (None, None)
        return pd.DataFrame([(head["video_id"], head["block"], head["entry"], *last)], columns=["video_id", "block", "entry", "leaves", "leaves_vec"])

    return follow


def _with_drift(pdf: pd.DataFrame, rows: np.ndarray, base: np.ndarray, limit: float) -> tuple[pd.DataFrame, np.ndarray]:
    found, drift = changes_of(rows, base, limit)
    moved = np.zeros(len(drift), bool)
    moved[found] = True
    return pdf[["video_id", "t", "event_id"]].assign(drift=drift, moved=moved), rows[found[-1]] if found else base


def _drifts(limit: float):
    return lambda pdf: _with_drift(*_block(pdf), limit)[0]


def _in_turn(limit: float):
    """All rows of a recording one after the other, as they stream by."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key = base = None
        for pdf in batches:
            for vid, some in pdf.groupby("video_id", sort=False):
                rows = np.stack([np.asarray(x, dtype=float) for x in some["vec"]])
                if vid != key:
                    key, base = vid, rows[0]
                out, base = _with_drift(some, rows, base, limit)
                yield out

    return run


def _entered(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows of the blocks in ``entries``; the baseline's vector goes with the first row of each block."""
    j = join_on(rows, entries, ("video_id", "block"))
    return j.withColumn("entry_vec", F.when((F.col("_n") - 1) % BLOCK_ROWS == 0, F.col("entry_vec"))).groupBy("video_id", "block")


def baseline_entries(rows: DataFrame, limit: float, rounds: int) -> DataFrame | None:
    """``video_id, block, entry, entry_vec``: row number and vector of the baseline each block is entered
    with; None where ``rounds`` were too few."""
    kind = rows.schema["video_id"].dataType.simpleString()
    start = cut(rows.filter("_n = 1").select("video_id", F.lit(1).cast("long").alias("start"), F.col("vec").alias("start_vec")))
    blocks = rows.select("video_id", "block").distinct()
    want = join_on(blocks, start, ("video_id",)).select("video_id", "block", F.col("start").alias("entry"), F.col("start_vec").alias("entry_vec"))
    known = None
    for _ in range(rounds):
        new = cut(_entered(rows, want).applyInPandas(_follow(limit), _ENDS.format(k=kind)))
        known = new if known is None else cut(join_on(known, new.select("video_id", "block"), ("video_id", "block"), "left_anti").unionByName(new))
        before = W.partitionBy("video_id").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
        left = F.last(F.when(F.col("leaves").isNotNull(), F.struct("leaves", "leaves_vec")), ignorenulls=True).over(before)
        now = join_on(known.select("*", left.alias("left")), start, ("video_id",))
        now = cut(now.select("video_id", "block", F.col("entry").alias("used"), F.coalesce("left.leaves", "start").alias("entry"), F.coalesce("left.leaves_vec", "start_vec").alias("entry_vec")))
        want = now.filter("entry <> used").drop("used")
        if want.isEmpty():
            return now.drop("used")
    return None


def moving_baseline(obs: DataFrame, limit: float, rounds: int = ROUNDS) -> DataFrame:
    """``video_id, t, event_id, drift, moved`` of every row: its drift from the baseline it meets, and
    whether it becomes the baseline. The first row of a recording is its first baseline."""
    d = number_rows(obs.select("video_id", "t", "event_id", F.col("vec").cast("array<double>").alias("vec")), Lane(("video_id",), ("t", "event_id"), 64.0), "_n")
    d = cut(d.withColumn("block", F.floor((F.col("_n") - 1) / BLOCK_ROWS)))
    k, i = (d.schema[n].dataType.simpleString() for n in ("video_id", "event_id"))
    entries, schema = baseline_entries(d, limit, rounds), _DRIFTS.format(k=k, i=i)
    if entries is not None:
        return _entered(d, entries).applyInPandas(_drifts(limit), schema)
    return d.drop("block").repartition("video_id").sortWithinPartitions("video_id", "_n").mapInPandas(_in_turn(limit), schema)


def _periodic(rows: DataFrame, keys: tuple[str, ...], interval: float) -> DataFrame:
    """Rows at least ``interval`` after the one sampled before; the first of each key is sampled."""
    flat = rows.select(*keys, "t", "event_id", F.lit(0).cast("long").alias("frame_idx"), F.array(F.lit(0.0)).alias("vec"))
    p = TriggerParams(jump=9.0, heartbeat=interval, min_gap_frames=0)
    return trigger_rows(flat, Lane(keys, ("t", "event_id"), 1.0), p).select(*keys, "t", "event_id")


def global_heartbeats(obs: DataFrame, p: GlobalHeartbeatParams = GlobalHeartbeatParams(), gate_first: bool = False, rounds: int = ROUNDS) -> DataFrame:
    """``video_id, t, event_id, reason, drift``: scene samples, periodic or where the scene drifts from its
    baseline, which then moves. With ``gate_first`` rows between heartbeats are not looked at. Rows need a
    recording, time, id and vector; recordings of any length are spread over their blocks."""
    if gate_first:
        due = _periodic(obs, ("video_id",), p.interval)
        rows = moving_baseline(join_on(obs, due, ("video_id", "t", "event_id"), "left_semi"), p.drift, rounds)
    else:
        every = cut(moving_baseline(obs, p.drift, rounds))
        lane = Lane(("video_id",), ("t", "event_id"), 64.0)
        parts = running(every, lane, {"segment": ("sum", F.col("moved").cast("long"))})
        rows = join_on(every, _periodic(parts, ("video_id", "segment"), p.interval).drop("segment"), ("video_id", "t", "event_id"), "left_semi")
    return rows.select("video_id", "t", "event_id", F.when(F.col("moved"), "drift").otherwise("periodic").alias("reason"), "drift")
