"""Streaming twins of the stateful operators.

Rows of a key are ordered inside each micro-batch; rows older than what their key has applied are set
aside instead of being applied (``in_order``). State per key is a fixed handful of values.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from chronotrace.operators.stateful import SilentGate
from chronotrace.params import DiscordanceParams, GlobalHeartbeatParams, TriggerParams
from chronotrace.streaming.in_order import Rule, in_order


def _trigger_step(p: TriggerParams):
    def step(kept, row):
        t, _, f, x = row
        x = np.asarray(x, dtype=float)
        if kept is None:
            rule, dist = "birth", 1.0
        else:
            dist, rule = 1.0 - float(np.dot(x, np.asarray(kept[2]))), None
            if f - kept[0] >= p.min_gap_frames:
                rule = "change_point" if dist > p.jump else ("heartbeat" if t - kept[1] >= p.heartbeat else None)
        if rule is None:
            return kept, []
        return (int(f), float(t), [float(v) for v in x]), [(int(f), rule, dist, False)]

    return step


def stream_triggers(obs: DataFrame, p: TriggerParams = TriggerParams(), keep_ms: int | None = None) -> DataFrame:
    """Birth, change-point and heartbeat rows per entity, for rows that are there; ``stream_silence`` has
    those of entities out of sight. Late rows are set aside."""
    rule = Rule("f long, last double, x array<double>", "frame_idx long, rule string, distance double, silent boolean", ("frame_idx", "vec"), _trigger_step(p))
    return in_order(obs.select("video_id", "entity_id", "event_id", "t", "frame_idx", "vec"), ("video_id", "entity_id"), rule, keep_ms=keep_ms)


class _Silence(StatefulProcessor):
    """The gate of a recording, and its rows of frames that are not yet complete: packed per slice of frames,
    a chunk for each part that came, so a task never holds more than one slice of one recording.

    ``index`` is the last frame that is through, the timer that is set, and for each slice the number of its
    chunks, the lowest frame and the first and last time in it.
    """

    def __init__(self, p: TriggerParams, max_age: int, slice_frames: int):
        self.p, self.max_age, self.width = p, max_age, slice_frames

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.gate = handle.getValueState("gate", "gate binary")
        self.index = handle.getValueState("index", "parts binary")
        self.held = handle.getMapState("held", "slice long, chunk long", "packed binary")

    def _open(self) -> tuple:
        stored = self.index.get()
        return pickle.loads(stored[0]) if stored else (-1, None, {})

    def _hold(self, parts: dict, at: int, rows: list) -> None:
        n, frame, first, last = parts.get(at, (0, rows[0][0], rows[0][4], rows[0][4]))
        frame = min(frame, min(r[0] for r in rows))
        parts[at] = (n + 1, frame, min(first, min(r[4] for r in rows)), max(last, max(r[4] for r in rows)))
        self.held.updateValue((at, n), (pickle.dumps(rows),))

    def _rows(self, parts: dict, at: int) -> list:
        return [r for n in range(parts[at][0]) for r in pickle.loads(self.held.getValue((at, n))[0])]

    def _drop(self, parts: dict, at: int) -> None:
        for n in range(parts.pop(at)[0]):
            self.held.removeKey((at, n))

    def _complete(self, key, done: int, timer, parts: dict, mark: int) -> Iterator[pd.DataFrame]:
        """Frames that the watermark has passed go through the gate, slice by slice."""
        reached = -1
        for at, (_, _, first, _) in parts.items():
            if first <= mark:
                reached = max(reached, max(r[0] for r in self._rows(parts, at) if r[4] <= mark))
        ready = sorted(at for at, (_, frame, _, _) in parts.items() if frame < reached)
        if ready:
            stored = self.gate.get()
            gate = pickle.loads(stored[0]) if stored else SilentGate(self.p, self.max_age)
            for at in ready:
                rows, out = sorted(self._rows(parts, at), key=lambda r: r[:3]), []
                self._drop(parts, at)
                through = [r for r in rows if r[0] < reached]
                if len(through) < len(rows):
                    self._hold(parts, at, rows[len(through) :])
                last = [a[0] != b[0] for a, b in zip(through, through[1:])] + [True]
                for (f, eid, _, t, _, x), end in zip(through, last):
                    gate.add(f, t, eid, np.asarray(x, dtype=float), end, out)
                if out:
                    yield pd.DataFrame([(int(key[0]), *r[:4]) for r in out], columns=["video_id", "entity_id", "frame_idx", "t", "silent"])
            self.gate.update((pickle.dumps(gate),))
            done = reached - 1
        ahead = [first for _, _, first, _ in parts.values() if first > mark]
        for at, (_, _, first, last) in parts.items():
            if first <= mark < last:
                ahead.append(min(r[4] for r in self._rows(parts, at) if r[4] > mark))
        due = min(ahead, default=None)
        if due != timer:
            if timer is not None and timer > mark:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        self.index.update((pickle.dumps((done, due, parts)),))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done, timer, parts = self._open()
        for part in rows:
            fresh: dict = {}
            for r in zip(*(part[c] for c in ("frame_idx", "entity_id", "event_id", "t", "at_ms", "vec"))):
                if r[0] > done:
                    fresh.setdefault(int(r[0] // self.width), []).append(r)
            for at, some in fresh.items():
                self._hold(parts, at, some)
        yield from self._complete(key, done, timer, parts, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        done, timer, parts = self._open()
        yield from self._complete(key, done, timer, parts, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stream_silence(obs: DataFrame, p: TriggerParams = TriggerParams(), max_age: int = 150, delay: str = "1 hour", slice_frames: int = 4096) -> DataFrame:
    """Sampled rows and samples of silent entities, as ``triggers_with_silence`` gives them.

    A silent entity is sampled at a frame of its recording, so the state is kept by recording: the gate
    of the batch form and the rows of frames that are not yet complete. A frame is complete when the
    watermark has reached a row of a later frame; then it goes through the gate, on data or by a timer.
    Rows of frames that are through are late and left out. Time must not fall as frames rise. Held rows
    lie in the state store by slices of frames; a task reads one slice at a time.
    """
    d = obs.withWatermark("ts", delay).select(
        "video_id", "ts", "frame_idx", "entity_id", "event_id", "t", "vec", F.coalesce(F.unix_millis("ts"), F.lit(-(2**63))).alias("at_ms")
    )
    return d.groupBy("video_id").transformWithStateInPandas(
        _Silence(p, max_age, slice_frames), "video_id long, entity_id long, frame_idx long, t double, silent boolean", "append", "EventTime"
    )


def stream_global_heartbeats(obs: DataFrame, p: GlobalHeartbeatParams = GlobalHeartbeatParams(), keep_ms: int | None = None) -> DataFrame:
    """Periodic and drift samples of a recording with a moving baseline. Late rows are set aside."""

    def step(kept, row):
        t, _, x = row
        x = [float(v) for v in x]
        last, base = kept or (-999.0, x)
        drift = 1.0 - float(np.dot(x, base))
        why = "periodic" if t - last >= p.interval else None
        if drift > p.drift:
            why, base = "drift", x
        return (float(t) if why else last, [float(v) for v in base]), [(why, drift)] if why else []

    rule = Rule("last double, base array<double>", "reason string, drift double", ("vec",), step)
    return in_order(obs, ("video_id",), rule, keep_ms=keep_ms)


def stream_background(obs: DataFrame, p: DiscordanceParams = DiscordanceParams(), keep_ms: int | None = None) -> DataFrame:
    """Threshold in force at each row: the floor during warm-up, then mean + k * std of the
    warm-up rows. Only count, sum and sum of squares are kept. Late rows are set aside."""

    def step(kept, row):
        n, s, q, thr = kept or (0, 0.0, 0.0, float(p.floor))
        e = float(row[2])
        if n < p.warmup_rows:
            n, s, q = n + 1, s + e, q + e**2
            if n == p.warmup_rows:
                m = s / n
                thr = max(m + p.sigma * max(q / n - m * m, 0.0) ** 0.5, p.floor)
        return (n, s, q, thr), [(thr,)]

    return in_order(obs, ("video_id",), Rule("n long, s double, q double, thr double", "threshold double", ("energy",), step), keep_ms=keep_ms)


def stream_graph(nodes: DataFrame, keep_ms: int | None = None) -> DataFrame:
    """Node rows with the edge to the previous node and running totals of the entity. Late rows are set aside."""

    def step(kept, row):
        t, _, action, e = row
        seq, t0, before, total = kept or (0, None, None, 0.0)
        total += float(e)
        edge = (float(t) - t0, f"{before} → {action}") if seq > 0 else (None, None)
        return (seq + 1, float(t), action, total), [(seq, *edge, total)]

    rule = Rule("seq long, t0 double, act string, total double", "seq long, duration double, action_transition string, running_energy double", ("action", "energy"), step)
    return in_order(nodes, ("video_id", "entity_id"), rule, keep_ms=keep_ms)


def stream_score_ema(scores: DataFrame, alpha: float = 0.3, keep_ms: int | None = None) -> DataFrame:
    """Exponential average of the scores of an entity over successive runs. Late rows are set aside."""

    def step(kept, row):
        x = float(row[2])
        ema = x if kept is None else alpha * x + (1 - alpha) * kept[0]
        return (ema,), [(ema,)]

    return in_order(scores, ("video_id", "entity_id"), Rule("last_ema double", "ema double", ("energy",), step), keep_ms=keep_ms)


def stream_first_rows(obs: DataFrame, within: float, by: tuple[str, ...] = ("entity_id", "frame_idx"), keep_ms: int | None = None) -> DataFrame:
    """The first row of each ``by`` of a recording; its repetitions are dropped, rows more than ``within``
    behind the latest of the recording are set aside. Only what came within that time is remembered."""

    def step(kept, row):
        kept = {} if kept is None else kept
        name = "\x1f".join("\x00" if v is None else str(v) for v in row[2:])
        new = name not in kept
        kept[name] = max(row[0], kept.get(name, row[0]))
        return kept, [tuple(row[2:])] if new else []

    def save(kept, seen):
        fresh = {k: t for k, t in kept.items() if t >= seen[0] - within}
        return list(fresh), list(fresh.values())

    kinds = dict(obs.dtypes)
    rule = Rule("names array<string>, at array<double>", ", ".join(f"{c} {kinds[c]}" for c in by), by, step, within, lambda kept: dict(zip(kept[0], kept[1])), save)
    return in_order(obs, ("video_id",), rule, keep_ms=keep_ms)


def tumbling_bins(obs: DataFrame, width: str, delay: str) -> DataFrame:
    g = obs.withWatermark("ts", delay).groupBy(F.window("ts", width), "video_id")
    return g.agg(F.count(F.lit(1)).alias("n"), F.max("danger").alias("max_danger")).select(F.unix_seconds("window.start").alias("start_s"), "video_id", "n", "max_danger")


def sliding_bins(obs: DataFrame, width: str, step: str, delay: str, since: int | None = None) -> DataFrame:
    """Overlapping windows; with ``since``, the second at which the recording clock starts, those that begin
    before it are left out."""
    g = obs.withWatermark("ts", delay).groupBy(F.window("ts", width, step), "video_id").agg(F.count(F.lit(1)).alias("n"))
    g = g.select(F.unix_seconds("window.start").alias("start_s"), "video_id", "n")
    return g if since is None else g.filter(F.col("start_s") >= since)


def gap_sessions(obs: DataFrame, gap: str, delay: str) -> DataFrame:
    """Runs of rows closer than ``gap`` (a pause of exactly ``gap`` also ends a run)."""
    g = obs.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "video_id")
    return g.agg(F.count(F.lit(1)).alias("n"), F.max("energy").alias("max_energy")).select(F.unix_micros("session_window.start").alias("start_us"), "video_id", "n", "max_energy")


def without_duplicates(obs: DataFrame, delay: str, keys: tuple[str, ...] = ("video_id", "entity_id", "frame_idx")) -> DataFrame:
    return obs.withWatermark("ts", delay).dropDuplicatesWithinWatermark(list(keys))


def with_live_counts(obs: DataFrame, name: str) -> DataFrame:
    """Counts published with the progress of the running query; ``runtime.ObservedCounts`` reads them."""
    return obs.observe(name, F.count(F.lit(1)).alias("rows"), F.sum(F.col("suspicious").cast("long")).alias("suspicious"), F.max("t").alias("last_t"))
