"""Operators whose next step depends on what they decided before.

Three ways of running them, in order of preference:

* split a sequence where the state provably starts afresh and number the parts natively;
* finite-state machines: every time slice is reduced to its table of state transitions, the
  tables are chained per key, and each slice is then run from its true start state, so even
  one endless sequence is processed by many tasks (:func:`run_machine`);
* otherwise one ordered pass per key with bounded state that streams through Arrow batches
  (:func:`ordered_pass`), never holding the rows of a key.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronotrace.functions.vectors import dot
from chronotrace.operators.ordered import SLICE, Lane, islands, join_on, neighbours, running
from chronotrace.params import PoolParams, TrackerParams, TriggerParams
from chronotrace.session import cut


def ordered_pass(df: DataFrame, keys: tuple[str, ...], order: tuple[str, ...], schema: str, make: Callable[[], Callable]) -> DataFrame:
    """Run the rows of each key in order through a fresh ``make()`` object.

    The object is called with the column arrays of an Arrow batch and the range of rows that
    belong to the key, and returns result tuples. It is kept while the key goes on in the
    next batch, so a key of any length needs the memory of its state only.
    """
    d = df.repartition(*keys).sortWithinPartitions(*keys, *order)
    names = [f.strip().split(" ")[0].strip("`") for f in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, step = None, None
        for pdf in batches:
            if not len(pdf):
                continue
            cols = {c: pdf[c].to_numpy() for c in pdf.columns}
            change = np.zeros(len(pdf), dtype=bool)
            change[0] = True
            for k in keys:
                change[1:] |= cols[k][1:] != cols[k][:-1]
            starts = [*np.flatnonzero(change).tolist(), len(pdf)]
            out: list = []
            for lo, hi in zip(starts[:-1], starts[1:]):
                key = tuple(cols[k][lo] for k in keys)
                if key != current:
                    current, step = key, make()
                out.extend(step(cols, lo, hi))
            if out:
                yield pd.DataFrame(out, columns=names)

    return d.mapInPandas(run, schema)


# --- finite-state machines -------------------------------------------------------------------
def run_machine(
    df: DataFrame, lane: Lane, inputs: list[str], n_states: int, start_state: int, table: Callable[[pd.DataFrame], np.ndarray], out: str = "state"
) -> DataFrame:
    """State after each row of a machine with ``n_states`` states.

    ``table(rows)`` gives, for the rows of a slice, an int array (rows x n_states): the next
    state for each possible present state. Adds ``out`` and ``<out>_before``.
    """
    d = cut(lane.cut_into_slices(df))  # read by both passes
    keys = list(lane.keys)
    cols = [*keys, SLICE, *lane.order, *inputs]
    slim = d.select(*dict.fromkeys(cols))
    key_ddl = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in slim.schema if f.name in keys)

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        t = table(pdf.sort_values(list(lane.order)))
        state = np.arange(n_states)
        for row in t:
            state = row[state]
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, SLICE: [pdf[SLICE].iloc[0]], "_map": [state.astype(np.int32)]})

    maps = slim.groupBy(*keys, SLICE).applyInPandas(summarise, f"{key_ddl}{SLICE} bigint, _map array<int>")

    def make():
        state = [start_state]

        def chain(cols: dict, lo: int, hi: int) -> list[tuple]:
            out = []
            for i in range(lo, hi):
                out.append((*[cols[k][i] for k in keys], cols[SLICE][i], state[0]))
                state[0] = int(cols["_map"][i][state[0]])
            return out

        return chain

    starts = ordered_pass(maps, tuple(keys), (SLICE,), f"{key_ddl}{SLICE} bigint, _start int", make)
    full = join_on(d, starts, (*keys, SLICE))
    ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {out}_before int, {out} int"
    names = df.columns

    def replay(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(list(lane.order))
        t, s = table(pdf), int(pdf["_start"].iloc[0])
        before, after = np.empty(len(pdf), np.int32), np.empty(len(pdf), np.int32)
        for i, row in enumerate(t):
            before[i], s = s, int(row[s])
            after[i] = s
        return pdf[names].assign(**{f"{out}_before": before, out: after})

    return full.groupBy(*keys, SLICE).applyInPandas(replay, ddl)


def adaptive_sampling(df: DataFrame, lane: Lane, interval: str, longest: int) -> DataFrame:
    """Keep a frame once the gap to the last kept one reaches the frame's own interval; the
    first and the last frame of a recording are always kept. ``lane`` orders dense frames.

    The state is the gap so far; gaps beyond ``longest`` behave alike.
    """

    def table(pdf: pd.DataFrame) -> np.ndarray:
        gap = np.minimum(np.arange(longest + 1) + 1, longest)[None, :]
        iv = np.minimum(pdf[interval].to_numpy(), longest)[:, None]
        first = pdf["_first"].to_numpy()[:, None]
        return np.where(first | (gap >= iv), 0, gap).astype(np.int32)

    pos = lane.order[0]
    ends = df.groupBy(*lane.keys).agg(F.min(pos).alias("_lo"), F.max(pos).alias("_hi"))
    d = join_on(df, ends, lane.keys).withColumn("_first", F.col(pos) == F.col("_lo"))
    r = run_machine(d, lane, [interval, "_first"], longest + 1, longest, table)
    return r.filter((F.col("state") == 0) | (F.col(pos) == F.col("_hi"))).select(*df.columns)


def threshold_machine(df: DataFrame, lane: Lane, n_regions: str, top: int = 25, low: int = 8, patience: int = 30) -> DataFrame:
    """Detection threshold that falls by one per row after ``patience`` empty rows and rises by
    one on a hit. Adds ``threshold`` (after the row) and the halved retry threshold."""
    span, runs = top - low + 1, patience + 1

    def table(pdf: pd.DataFrame) -> np.ndarray:
        s = np.arange(span * runs)
        thr, streak = s // runs, s % runs
        hit = np.minimum(thr + 1, span - 1) * runs
        st = np.minimum(streak + 1, patience)
        miss = np.where(st >= patience, np.maximum(thr - 1, 0), thr) * runs + st
        filled = pdf[n_regions].to_numpy() > 0
        return np.where(filled[:, None], hit[None, :], miss[None, :]).astype(np.int32)

    r = run_machine(df, lane, [n_regions], span * runs, (span - 1) * runs, table)
    before = F.floor(F.col("state_before") / runs) + low
    return r.select(
        *df.columns, (F.floor(F.col("state") / runs) + low).cast("long").alias("threshold"), F.greatest(F.floor(before / 2), F.lit(low)).cast("long").alias("retry_threshold")
    )


def fallback_machine(df: DataFrame, lane: Lane, n_regions: str, patience: int = 15, cooldown: int = 30) -> DataFrame:
    """Second detector switched on after ``patience`` empty rows, off again once it has run
    ``cooldown`` rows and the first one finds something. Adds ``active`` for each row."""
    runs = patience + 1
    n = (cooldown + 2) * runs

    def table(pdf: pd.DataFrame) -> np.ndarray:
        s = np.arange(n)
        left, streak = s // runs - 1, s % runs  # left = -1: off
        filled = (pdf[n_regions].to_numpy() > 0)[:, None]
        st = np.where(filled, 0, np.minimum(streak + 1, patience)[None, :])
        off = left[None, :] < 0
        after_on = np.maximum(left - 1, 0)[None, :]
        on_next = np.where((after_on <= 0) & filled, -1, after_on)
        off_next = np.where(st >= patience, cooldown, -1)
        return ((np.where(off, off_next, on_next) + 1) * runs + st).astype(np.int32)

    r = run_machine(df, lane, [n_regions], n, 0, table)
    on_before, on_after = F.floor(F.col("state_before") / runs) > 0, F.floor(F.col("state") / runs) > 0
    return r.select(*df.columns, (on_before | on_after).alias("active"))


def reuse_machine(df: DataFrame, lane: Lane, forced: str, every: int = 5, min_gap: int = 2) -> DataFrame:
    """Which rows run the detector anew: every ``every`` rows, or when forced at least
    ``min_gap`` rows after the last run. ``source_pos`` is the row whose result is used."""

    def table(pdf: pd.DataFrame) -> np.ndarray:
        gap = np.minimum(np.arange(every + 1) + 1, every)[None, :]
        need = np.where(pdf[forced].to_numpy(), min_gap, every)[:, None]
        return np.where(gap >= need, 0, gap).astype(np.int32)

    r = run_machine(df, lane, [forced], every + 1, every, table).withColumn("ran", F.col("state") == 0)
    pos = lane.order[0]
    return running(r.select(*df.columns, "ran"), lane, {"source_pos": ("last", F.when(F.col("ran"), F.col(pos)))})


# --- trigger rules ----------------------------------------------------------------------------
class _Chain:
    """Firing rows inside one slice. Positions below ``own`` are rows of the slice before. Chains that
    meet go on as one, so the entries of a slice together look at each row once."""

    LOOK = 8  # rows looked at together; doubled while none fires

    def __init__(self, f: np.ndarray, t: np.ndarray, x: np.ndarray, own: int, p: TriggerParams):
        self.f, self.t, self.x, self.own, self.n, self.p = f, t, x, own, len(f), p
        self.next: dict[int, int] = {}
        self.last: dict[int, int] = {}

    def after(self, i: int) -> int:
        """First row of the slice that fires when row ``i`` was sampled last."""
        if i not in self.next:
            at, step, found = max(i + 1, self.own), self.LOOK, self.n
            while at < self.n and found == self.n:
                s = slice(at, at + step)
                due = (self.t[s] - self.t[i] >= self.p.heartbeat) | (1.0 - self.x[s] @ self.x[i] > self.p.jump)
                hit = np.flatnonzero(due & (self.f[s] - self.f[i] >= self.p.min_gap_frames))
                if len(hit):
                    found = at + int(hit[0])
                at, step = at + step, 2 * step
            self.next[i] = found
        return self.next[i]

    def leaves(self, i: int) -> int:
        """Row sampled last at the end of the slice when row ``i`` was sampled."""
        path = []
        while i not in self.last:
            path.append(i)
            j = self.after(i)
            if j == self.n:
                self.last[i] = i
                break
            i = j
        for k in path:
            self.last[k] = self.last[i]
        return self.last[i]

    def fired(self, entry: int) -> list[int]:
        """Fired positions after the row of this position (-1: the first row fires anyway)."""
        j = self.own if entry == -1 else self.after(entry)
        out = []
        while j < self.n:
            out.append(j)
            j = self.after(j)
        return out


def whole_groups(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[pd.DataFrame, list[int]]]:
    """Sorted batches cut anew where groups end, and the bounds of the groups in each. What is held
    is a batch and the group that goes on in the next."""
    held: list[pd.DataFrame] = []
    for pdf in batches:
        if not len(pdf):
            continue
        change = np.zeros(len(pdf), dtype=bool)
        for k in keys:
            col = pdf[k].to_numpy()
            change[1:] |= col[1:] != col[:-1]
            change[0] |= not held or col[0] != held[-1][k].iloc[-1]
        starts = np.flatnonzero(change)
        if not len(starts):
            held.append(pdf)
            continue
        if held and starts[0] > 0:
            held.append(pdf.iloc[: starts[0]])
        if held:
            group = pd.concat(held, ignore_index=True)
            yield group, [0, len(group)]
        if len(starts) > 1:
            yield pdf.iloc[starts[0] : starts[-1]], (starts - starts[0]).tolist()
        held = [pdf.iloc[starts[-1] :]]
    if held:
        group = pd.concat(held, ignore_index=True)
        yield group, [0, len(group)]


def _chains(batches: Iterator[pd.DataFrame], keys: list[str], ident: str, p: TriggerParams) -> Iterator[tuple[pd.DataFrame, list]]:
    """The slices of each batch: first row, ids of the rows that may enter it, frames, chain."""
    for pdf, bounds in whole_groups(batches, keys):
        f, t, ids, halo = (pdf[c].to_numpy() for c in ("frame_idx", "t", ident, "_halo"))
        x = np.stack([np.asarray(v, dtype=float) for v in pdf["vec"]])
        out = []
        for lo, hi in zip(bounds[:-1], bounds[1:]):
            own = int(halo[lo:hi].sum())
            out.append((lo, ids[lo : lo + own], ids[lo:hi], _Chain(f[lo:hi], t[lo:hi], x[lo:hi], own, p)))
        yield pdf, out


def in_slices(df: DataFrame, part: list[str], lane: Lane) -> DataFrame:
    """Whole slices in order, rows of the slice before first. The number of tasks is given, since
    the work per row is far more than its bytes say."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *part).sortWithinPartitions(*part, F.desc("_halo"), *lane.order)


def trigger_rows(obs: DataFrame, lane: Lane, p: TriggerParams = TriggerParams(), slice_width: float = 240.0) -> DataFrame:
    """Observations worth describing: first sight, a jump of the vector, or a heartbeat.

    The next firing row depends on the last sampled one only, and a sample older than both a
    heartbeat and the frame gap no longer matters: the next row fires anyway. So a slice can only be
    entered with one of the rows within that ``reach`` before it. Every slice is worked out for all of
    these entries, the results are chained per entity, and each slice is then replayed from
    its true entry: even one endless entity is spread over its slices. Rule and distance
    follow from consecutive fired rows. Slices are at least the reach wide. Should a frame gap outlast
    the reach, because frames are fewer than ``frames_per_unit`` says, the job fails.
    """
    narrow, lane = lane, Lane(lane.keys, lane.order, max(slice_width, p.reach))
    keys, ident = list(lane.keys), lane.order[-1]
    d = lane.cut_into_slices(obs.select(*dict.fromkeys([*keys, *lane.order, "frame_idx", "t", "vec"])))
    names = d.columns[:-1]
    edge = F.col("t") > (F.col(SLICE) + 1) * F.lit(float(lane.width)) - F.lit(float(p.reach))
    here = F.struct(F.col(SLICE).alias("s"), F.lit(False).alias("h"))
    nxt = F.when(edge, F.struct((F.col(SLICE) + 1).alias("s"), F.lit(True).alias("h")))
    d = d.withColumn("_to", F.explode(F.array_compact(F.array(here, nxt)))).withColumn(SLICE, F.col("_to.s")).withColumn("_halo", F.col("_to.h")).drop("_to")
    part = [*keys, SLICE]
    d = cut(in_slices(d, part, lane))  # read by both passes
    key_ddl = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in d.schema if f.name in keys)
    found = [*part, "_in", "_out", "_frame", "_first"]

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, slices in _chains(batches, part, ident, p):
            cols, out = [pdf[k].to_numpy() for k in part], []
            for lo, before, ids, c in slices:
                if c.own == c.n:
                    continue
                ends = [c.leaves(c.own), *[c.leaves(i) for i in range(c.own)]]
                out.append((*[k[lo] for k in cols], [-1, *before.tolist()], ids[ends].tolist(), c.f[ends].tolist(), c.f[c.own]))
            if out:
                yield pd.DataFrame(out, columns=found)

    maps = d.mapInPandas(entries, f"{key_ddl}{SLICE} bigint, _in array<bigint>, _out array<bigint>, _frame array<bigint>, _first bigint")

    def make():
        last = [-1, None]

        def chain(cols: dict, lo: int, hi: int) -> list[tuple]:
            res = []
            for i in range(lo, hi):
                ins = cols["_in"][i].tolist()
                at = ins.index(last[0]) if last[0] in ins else 0
                if at == 0 and last[1] is not None and cols["_first"][i] - last[1] < p.min_gap_frames:
                    raise ValueError("a frame gap outlasts its reach: frames_per_unit is too large")
                res.append((*[cols[k][i] for k in keys], cols[SLICE][i], ins[at]))
                last[0] = int(cols["_out"][i][at])
                last[1] = int(cols["_frame"][i][at])
            return res

        return chain

    starts = ordered_pass(maps, lane.keys, (SLICE,), f"{key_ddl}{SLICE} bigint, _entry bigint", make)
    full = in_slices(join_on(d, starts, part), part, lane)

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, slices in _chains(batches, part, ident, p):
            entry, rows = pdf["_entry"].to_numpy(), []
            for lo, before, _, c in slices:
                rows += [lo + i for i in c.fired(-1 if entry[lo] == -1 else int(np.flatnonzero(before == entry[lo])[0]))]
            yield pdf.iloc[rows][names]

    fired = full.mapInPandas(replay, schema_ddl(d.select(*names).schema))
    f = neighbours(cut(fired), narrow, previous={"_pv": F.col("vec")})
    dist = F.when(F.col("_pv").isNull(), F.lit(1.0)).otherwise(1 - dot(F.col("vec"), F.col("_pv")))
    rule = F.when(F.col("_pv").isNull(), "birth").when(F.col("distance") > p.jump, "change_point").otherwise("heartbeat")
    return f.withColumn("distance", dist).withColumn("rule", rule).drop("_pv")


class SilentGate:
    """All entities of one session: sampled rows and samples of silent entities."""

    def __init__(self, p: TriggerParams, max_age: int):
        self.p, self.max_age = p, max_age
        self.sample: dict = {}  # entity -> frame, time, vector of the last sample
        self.seen: dict = {}  # active entity -> last frame, vector
        self.frame = None
        self.rows: list = []

    def _finish(self, out: list) -> None:
        f, t = self.frame
        fired = set()
        for eid, x in self.rows:
            last = self.sample.get(eid)
            fire = last is None or (
                f - last[0] >= self.p.min_gap_frames and (1.0 - float(np.dot(x, last[2])) > self.p.jump or t - last[1] >= self.p.heartbeat)
            )
            self.seen[eid] = (f, x)
            if fire:
                self.sample[eid] = (f, t, x)
                fired.add(eid)
                out.append((eid, f, t, False, x))
        self.seen = {e: s for e, s in self.seen.items() if f - s[0] <= self.max_age}
        # A sample of an entity out of sight counts until its next row would fire anyway.
        old = lambda s: f - s[0] >= self.p.min_gap_frames and t - s[1] >= self.p.heartbeat
        self.sample = {e: s for e, s in self.sample.items() if e in self.seen or not old(s)}
        for eid, (_, x) in self.seen.items():
            if eid not in fired and t - self.sample[eid][1] >= self.p.heartbeat:
                out.append((eid, f, t, True, x))
                self.sample[eid] = (f, t, x)
        self.rows = []

    def add(self, f, t, eid, x, end: bool, out: list) -> None:
        """One row, in order; ``end`` says that its frame has no more."""
        if self.frame is not None and f != self.frame[0]:
            self._finish(out)
        self.frame = (f, t)
        self.rows.append((eid, x))
        if end:
            self._finish(out)
            self.frame = None

    def __call__(self, cols: dict, lo: int, hi: int) -> list[tuple]:
        out: list = []
        for f, t, eid, x, end in zip(*[cols[c][lo:hi] for c in ("frame_idx", "t", "entity_id", "vec", "_end")]):
            self.add(f, t, eid, np.asarray(x, dtype=float), end, out)
        return [(cols["video_id"][lo], *r) for r in out]


def _sessions(df: DataFrame, lane: Lane, max_age: int, min_pause: float = 0.0) -> DataFrame:
    """Split recordings at pauses longer than the maximum age; ``_end`` marks a session's last row."""
    pause = lambda a, b: (b["f"] - a["f"] > max_age) & (b["t"] - a["t"] >= min_pause)
    d = islands(df, lane, {"f": F.col("frame_idx"), "t": F.col("t")}, pause, "session")
    d = neighbours(d, lane, following={"_ns": F.col("session")})
    return d.withColumn("_end", F.col("_ns").isNull() | (F.col("_ns") != F.col("session"))).drop("_ns")


def triggers_with_silence(obs: DataFrame, p: TriggerParams = TriggerParams(), max_age: int = 150, slice_frames: float = 4096) -> DataFrame:
    """Trigger rows including heartbeats of entities that are active but not in the frame.

    An entity not seen for ``max_age`` frames is inactive, and if that is also at least a
    heartbeat ago its next row fires whatever came before. So recordings split at such pauses,
    sessions run in parallel, and an entity's old sample can be forgotten. Rule and distance
    follow from consecutive samples of an entity. Needs ``max_age`` to last a heartbeat.
    """
    lane = Lane(("video_id",), ("frame_idx", "entity_id", "event_id"), slice_frames)
    d = _sessions(obs.select("video_id", "frame_idx", "t", "entity_id", "event_id", "vec"), lane, max_age, p.heartbeat)
    schema = "video_id bigint, entity_id bigint, frame_idx bigint, t double, silent boolean, vec array<double>"
    fired = cut(ordered_pass(d, ("video_id", "session"), lane.order, schema, lambda: SilentGate(p, max_age)))
    f = neighbours(fired, Lane(("video_id", "entity_id"), ("frame_idx", "t", "silent"), slice_frames), previous={"_pv": F.col("vec")})
    dist = F.when(F.col("_pv").isNull(), F.lit(1.0)).otherwise(1 - dot(F.col("vec"), F.col("_pv")))
    rule = F.when(F.col("_pv").isNull(), "birth").when(~F.col("silent") & (F.col("distance") > p.jump), "change_point").otherwise("heartbeat")
    return f.withColumn("distance", dist).withColumn("rule", rule).drop("_pv", "vec")


# --- identity -----------------------------------------------------------------------------------
def strongest_matches(likeness: np.ndarray, least: float) -> dict[int, int]:
    """Row to column by edges of at least ``least``, taken from the strongest on while both ends are
    free; of equal edges the one with the lower row, then column."""
    rows, cols = np.nonzero(likeness >= least)
    order = np.lexsort((cols, rows, -likeness[rows, cols]))
    match: dict[int, int] = {}
    used: set[int] = set()
    for r, c in zip(rows[order].tolist(), cols[order].tolist()):
        if r not in match and c not in used:
            match[r] = c
            used.add(c)
    return match


@dataclass
class _Seen:
    """What is known of an entity: its last vector, frame, and how often it was met."""

    vec: np.ndarray
    frame: int
    times: int = 1


class _Tracker:
    """Regions of one session, frame by frame; entities out of age are forgotten."""

    def __init__(self, p: TrackerParams):
        self.p, self.known, self.next_id = p, {}, 0
        self.frame, self.rows = None, []

    def _open(self, x: np.ndarray) -> int:
        if self.p.max_active is not None and len(self.known) >= self.p.max_active:
            # Those met longest ago come first from here on, which settles later ties.
            by_age = sorted(self.known, key=lambda i: self.known[i].frame)
            self.known = {i: self.known[i] for i in by_age[1:]}
        self.known[self.next_id] = _Seen(x, self.frame)
        self.next_id += 1
        return self.next_id - 1

    def _finish(self, out: list) -> None:
        self.known = {i: e for i, e in self.known.items() if self.frame - e.frame <= self.p.max_age_frames}
        ids = list(self.known)
        match: dict[int, int] = {}
        if ids and self.rows:
            match = strongest_matches(np.stack([r[1] for r in self.rows]) @ np.stack([self.known[i].vec for i in ids]).T, self.p.similarity)
        for r, c in match.items():
            self.known[ids[c]].vec, self.known[ids[c]].frame = self.rows[r][1], self.frame
        for r, (eid, x, energy, free) in enumerate(self.rows):
            if r in match:
                out.append((eid, ids[match[r]]))
            elif free or energy >= self.p.min_energy_new:
                out.append((eid, self._open(x)))
        self.rows = []

    def __call__(self, cols: dict, lo: int, hi: int) -> list[tuple]:
        out: list = []
        for f, eid, x, e, free, end in zip(*[cols[c][lo:hi] for c in ("frame_idx", "event_id", "vec", "energy", "_free", "_end")]):
            if self.frame is not None and f != self.frame:
                self._finish(out)
            self.frame = f
            self.rows.append((eid, np.asarray(x, dtype=float), e, free))
            if end:
                self._finish(out)
        return [(cols["video_id"][lo], cols["session"][lo], *r) for r in out]


def track_entities(regions: DataFrame, p: TrackerParams = TrackerParams(), slice_frames: float = 4096) -> DataFrame:
    """Entity id of each region by greedy best-first matching of vectors frame to frame.

    Nothing survives a pause longer than the maximum age, so every such pause starts an
    independent session; local ids are shifted by the ids used in earlier sessions.
    """
    lane = Lane(("video_id",), ("frame_idx", "event_id"), slice_frames)
    free = F.col("source").isin("yolo", "fused") & F.col("class_name").isin(*p.exempt_classes)
    d = regions.select("video_id", "frame_idx", F.col("frame_idx").cast("double").alias("t"), "event_id", "vec", "energy", free.alias("_free"))
    d = _sessions(d, lane, p.max_age_frames)
    local = cut(ordered_pass(d, ("video_id", "session"), ("frame_idx", "event_id"), "video_id bigint, session bigint, event_id bigint, local_id bigint", lambda: _Tracker(p)))
    used = local.groupBy("video_id", "session").agg((F.max("local_id") + 1).alias("_n"))
    shift = running(used, Lane(("video_id",), ("session",), 1024), {"_o": ("sum", F.col("_n"))}, include_current=False)
    j = join_on(local, shift.select("video_id", "session", "_o"), ("video_id", "session"))
    return j.select("video_id", "event_id", (F.col("local_id") + F.coalesce("_o", F.lit(0))).alias("entity_id"))


def first_come_matches(likeness: np.ndarray, least: float) -> list[int]:
    """Row by row the most alike free column of at least ``least``, the first of equal ones; -1 if none."""
    free = np.ones(likeness.shape[1], bool)
    out = []
    for row in likeness:
        open_ = np.flatnonzero(free & (row >= least))
        c = int(open_[row[open_].argmax()]) if len(open_) else -1
        if c >= 0:
            free[c] = False
        out.append(c)
    return out


class _Pool:
    """Known identities of one recording with running mean vectors; those out of age are forgotten."""

    def __init__(self, p: PoolParams):
        self.p, self.known, self.next_id = p, {}, 0
        self.frame, self.rows = None, []

    def _blend(self, e: _Seen, x: np.ndarray) -> None:
        m = (1 - self.p.ema_alpha) * e.vec + self.p.ema_alpha * x
        size = float(np.linalg.norm(m))
        e.vec, e.frame, e.times = (m / size if size else m), self.frame, e.times + 1

    def _open(self, x: np.ndarray) -> int:
        self.known[self.next_id] = _Seen(x, self.frame)
        self.next_id += 1
        if self.p.max_size is not None and len(self.known) > self.p.max_size:
            for i in heapq.nsmallest(max(1, len(self.known) // 5), self.known, key=lambda i: self.known[i].frame):
                self.known.pop(i)
        return self.next_id - 1

    def _finish(self, out: list) -> None:
        recent = {i: e for i, e in self.known.items() if self.frame - e.frame <= self.p.max_age}
        if self.p.max_size is None:
            self.known = recent
        ids = list(recent)
        match = [-1] * len(self.rows)
        if ids and self.rows:
            match = first_come_matches(np.stack([x for _, x in self.rows]) @ np.stack([recent[i].vec for i in ids]).T, self.p.similarity)
        for (eid, x), c in zip(self.rows, match):
            if c < 0:
                out.append((eid, self._open(x), True))
            else:
                out.append((eid, ids[c], False))
                if ids[c] in self.known:
                    self._blend(self.known[ids[c]], x)
        self.rows = []

    def __call__(self, cols: dict, lo: int, hi: int) -> list[tuple]:
        out: list = []
        for f, eid, x, end in zip(*[cols[c][lo:hi] for c in ("frame_idx", "event_id", "vec", "_end")]):
            if self.frame is not None and f != self.frame:
                self._finish(out)
            self.frame = f
            self.rows.append((eid, np.asarray(x, dtype=float)))
            if end:
                self._finish(out)
        return [(cols["video_id"][lo], *r) for r in out]


def reidentify(sightings: DataFrame, p: PoolParams = PoolParams()) -> DataFrame:
    """Identity of each sighting by first-come matching with a bounded pool of known ones."""
    last = sightings.groupBy("video_id").agg(F.max(F.struct("frame_idx", "event_id")).alias("_l"))
    d = join_on(sightings.select("video_id", "frame_idx", "event_id", "vec"), last, ("video_id",))
    d = d.withColumn("_end", F.struct("frame_idx", "event_id") == F.col("_l")).drop("_l")
    return ordered_pass(d, ("video_id",), ("frame_idx", "event_id"), "video_id bigint, event_id bigint, identity bigint, is_new boolean", lambda: _Pool(p))


def schema_ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
