"""Streams fed in several files give what the batch operators give."""

import pickle
import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from chronotrace.operators import pulses as pu, stateful as st
from chronotrace.params import GlobalHeartbeatParams, TriggerParams
from chronotrace.plans import stateful_queries as q, views as v
from chronotrace.session import cut
from chronotrace.streaming import operators as so, runtime as rt


def split_source(spark, sf_dir, tmp_path):
    """The event table as four time-ordered files, one micro-batch each."""
    e = cut(v.table(spark, sf_dir, "events"))
    bounds = [0.0, 0.25, 0.5, 0.75]
    n = e.count()
    for i, b in enumerate(bounds):
        part = e.filter((F.col("event_id") >= int(b * n)) & (F.col("event_id") < int((b + 0.25) * n)))
        part.coalesce(1).write.parquet(str(tmp_path / f"part{i}"))
        src = next((tmp_path / f"part{i}").glob("*.parquet"))
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"events{i}.parquet").write_bytes(src.read_bytes())
    return str(tmp_path / "in")


def test_streams_equal_batch(spark, sf_dir, tmp_path, monkeypatch):
    src = split_source(spark, sf_dir, tmp_path)
    one = rt.event_stream
    monkeypatch.setattr(q.rt, "event_stream", lambda s, d: one(s, src, files_per_batch=1))
    obs = v.obs_vec(spark, sf_dir)
    batch = {(r.event_id, r.rule) for r in st.trigger_rows(obs, v.ENTITY_LANE, q.NEVER).collect()}
    got = rt.run_available(so.stream_triggers(q._vec_stream(spark, sf_dir), q.NEVER), "t").filter("not silent")
    assert {(r.event_id, r.rule) for r in got.collect()} == batch
    p = GlobalHeartbeatParams(drift=1.1)
    batch = {(r.event_id, r.reason) for r in pu.global_heartbeats(obs, p).collect()}
    got = rt.run_available(so.stream_global_heartbeats(q._vec_stream(spark, sf_dir), p), "g")
    assert {(r.event_id, r.reason) for r in got.collect()} == batch
    g = rt.run_available(so.stream_graph(q._obs_stream(spark, sf_dir)), "n").groupBy("entity_id").agg(F.max("seq").alias("m"), F.count(F.lit(1)).alias("n"))
    assert all(r.m + 1 == r.n for r in g.collect())


def test_silent_stream_equals_batch(spark, sf_dir, tmp_path, monkeypatch):
    src = split_source(spark, sf_dir, tmp_path)
    one = rt.event_stream
    monkeypatch.setattr(q.rt, "event_stream", lambda s, d: one(s, src, files_per_batch=1))
    batch = {(r.video_id, r.entity_id, r.frame_idx, r.silent) for r in st.triggers_with_silence(v.obs_vec(spark, sf_dir)).collect()}
    rows = rt.run_available(so.stream_silence(q._vec_stream(spark, sf_dir)), "s").collect()
    got = {(r.video_id, r.entity_id, r.frame_idx, r.silent) for r in rows}
    assert len(got) == len(rows)
    last = {vid: max(r[2] for r in got if r[0] == vid) for vid in {r[0] for r in got}}
    assert got == {r for r in batch if r[2] <= last[r[0]]}  # up to the watermark
    assert len(batch - got) < 0.05 * len(batch) and sum(r[3] for r in got) > 0
    whole = q.silent_stream(spark, sf_dir)
    assert whole.count() == sum(r[3] for r in got)


def test_a_frame_is_through_when_the_watermark_is_at_a_later_one(spark, tmp_path):
    """Also when it stands at that row's very millisecond, and whatever the slices."""
    for i, rows in enumerate([[(2, 1, 0, 0), (1, 9, 1, 3700)], [(2, 1, 2, 600), (1, 9, 3, 4200)]]):
        d = spark.createDataFrame(rows, "video_id long, entity_id long, event_id long, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_000_000))
        d.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(1.1)
    s = spark.readStream.schema("video_id long, entity_id long, event_id long, s long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    s = s.select("*", F.col("s").alias("frame_idx"), (F.col("s") / 3600).alias("t"), F.array(F.lit(1.0), F.lit(0.0)).alias("vec"))
    got = {(r.video_id, r.frame_idx, r.silent) for r in rt.run_available(so.stream_silence(s, slice_frames=7), "silence").collect()}
    assert got == {(2, 0, False)}


class Cell:
    def __init__(self):
        self.value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


class Cells(dict):
    getValue, updateValue, removeKey = dict.__getitem__, dict.__setitem__, dict.__delitem__


class Handle:
    """State and timers of one key."""

    def __init__(self):
        self.values, self.maps, self.timers = {}, {}, set()

    def getValueState(self, name, schema):
        return self.values.setdefault(name, Cell())

    def getMapState(self, name, *schemas):
        return self.maps.setdefault(name, Cells())

    def registerTimer(self, ms):
        self.timers.add(ms)

    def deleteTimer(self, ms):
        self.timers.remove(ms)


def test_rows_that_wait_lie_in_slices(spark):
    """No part of the state holds more than the rows of a slice that came together; rows that are through leave it."""
    rng = np.random.default_rng(3)
    rows = [(f, e, 10 * f + e, f / 30, f * 100, rng.normal(size=4)) for f in range(0, 900, 3) for e in range(3) if rng.random() < 0.4]
    p, names = TriggerParams(heartbeat=1.0), ["frame_idx", "entity_id", "event_id", "t", "at_ms", "vec"]
    handle, got, held = Handle(), [], []
    one = so._Silence(p, 150, 60)
    one.init(handle)
    for i, mark in enumerate((-1, 20_000, 45_000, 60_000)):
        part = [r for j, r in enumerate(rows) if (r[4] > 45_000) == (i == 2) and (i == 2 or j % 2 == i)] if i < 3 else []
        for tables in [[pd.DataFrame(part[::2], columns=names), pd.DataFrame(part[1::2], columns=names)]] if part else []:
            got += [tuple(r) for d in one.handleInputRows((7,), iter(tables), TimerValues(0, mark)) for r in d.itertuples(index=False)]
        if not part:
            assert min(handle.timers) <= mark
            got += [tuple(r) for d in one.handleExpiredTimer((7,), TimerValues(0, mark), ExpiredTimerInfo(mark)) for r in d.itertuples(index=False)]
        held.append([len(pickle.loads(v[0])) for v in handle.maps["held"].values()])
    assert max(max(h) for h in held) <= 60 and len(held[0]) == 16  # eight slices, two tables
    reached = max(r[0] for r in rows if r[4] <= 60_000)
    gate, want = st.SilentGate(p, 150), []
    through = [r for r in rows if r[0] < reached]
    for r, after in zip(through, [*through[1:], (None,)]):
        gate.add(r[0], r[3], r[1], r[5], r[0] != after[0], want)
    assert got == [(7, *r[:4]) for r in want] and any(r[4] for r in got)
    assert sum(held[-1]) == sum(r[0] >= reached for r in rows)


def staged(spark, folder, rows):
    """One file per call; a stream of one file per micro-batch sees them one after the other."""
    spark.createDataFrame(rows, "video_id long, entity_id long, event_id long, t double, energy double, action string, vec array<double>").coalesce(1).write.mode("append").parquet(str(folder))


def rows_of(spark, folder):
    s = spark.readStream.schema("video_id long, entity_id long, event_id long, t double, energy double, action string, vec array<double>")
    return s.option("maxFilesPerTrigger", 1000).parquet(str(folder)).withColumn("frame_idx", F.floor(F.col("t") * 30).cast("long"))


def row(n, t, entity=1, video=1, energy=0.5, vec=(1.0, 0.0)):
    return (video, entity, n, t, energy, f"action {n}", list(vec))


STREAMS = {
    "triggers": so.stream_triggers, "pulses": so.stream_global_heartbeats, "background": so.stream_background, "graph": so.stream_graph,
    "ema": so.stream_score_ema, "first": lambda s: so.stream_first_rows(s, 5.0, ("entity_id", "action")),
}


@pytest.mark.parametrize("name", STREAMS)
def test_late_rows_are_set_aside_and_change_nothing(spark, tmp_path, name):
    """After the first arrival, rows behind their key leave as late; the others go on from what was kept."""
    first = [row(n, float(n)) for n in range(0, 40, 2)] + [row(100, 3.0, entity=2, video=2)]
    late = [row(5, 5.0), row(7, 7.0), (1, 1, 8, None, 0.5, "no time", [1.0, 0.0])]
    more = [row(41, 41.0), row(43, 43.0, energy=0.9), row(101, 2.0, entity=None, video=None)]
    staged(spark, tmp_path / "in", first)
    run = lambda: rt.run_split(STREAMS[name](rows_of(spark, tmp_path / "in")), name, str(tmp_path / "out"))
    run()
    staged(spark, tmp_path / "in", late + more)
    kept, aside = run()
    assert {(r.event_id, r.set_aside) for r in aside.collect()} == {(5, "late"), (7, "late"), (8, "no time")}
    staged(spark, tmp_path / "in_time", first + more)
    whole, none = rt.run_split(STREAMS[name](rows_of(spark, tmp_path / "in_time")), name)
    as_rows = lambda d: sorted(map(str, d.collect()))
    assert as_rows(kept) == as_rows(whole) and none.count() == 0
    assert len(as_rows(kept)) > 0


def test_state_of_silent_keys_is_forgotten(spark, tmp_path):
    """With a time to live, keys that get no rows leave the state store."""
    staged(spark, tmp_path / "in", [row(n, 1.0, entity=n) for n in range(50)])
    sizes = []
    for arrival in ([], [row(100, 2.0, entity=7)], [row(101, 3.0, entity=7), row(102, 3.0, entity=8)]):
        if arrival:
            staged(spark, tmp_path / "in", arrival)
        time.sleep(1.5)
        s = so.stream_score_ema(rows_of(spark, tmp_path / "in"), keep_ms=1000)
        w = s.writeStream.option("checkpointLocation", str(tmp_path / "progress")).format("parquet").option("path", str(tmp_path / "rows"))
        sizes.append(rt._run(w, spark, rt.STATE_SETTINGS).lastProgress.stateOperators[0].numRowsTotal)
    assert sizes[0] >= 50 and sizes[1] < 10 and sizes[2] < 10
    ema = {r.event_id: r.ema for r in spark.read.parquet(str(tmp_path / "rows")).collect()}
    assert ema[100] == 0.5 and len(ema) == 53


def test_first_rows_are_remembered_within_the_delay(spark, tmp_path):
    build = lambda: rt.run_split(so.stream_first_rows(rows_of(spark, tmp_path / "in"), 10.0, ("entity_id",)), "f", str(tmp_path / "out"))
    staged(spark, tmp_path / "in", [row(1, 1.0), row(2, 2.0), row(3, 50.0, entity=2)])
    build()
    staged(spark, tmp_path / "in", [row(4, 51.0, entity=2), row(5, 45.0, entity=3), row(6, 39.0, entity=4)])
    kept, aside = build()
    assert sorted(r.event_id for r in kept.collect()) == [1, 3, 5]
    assert [(r.event_id, r.set_aside) for r in aside.collect()] == [(6, "late")]


def test_counts_are_read_while_the_query_runs(spark, tmp_path):
    for k in range(3):
        staged(spark, tmp_path / "in", [row(10 * k + n, float(n)) for n in range(k + 2)])
    s = spark.readStream.schema("event_id long, t double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")).withColumn("suspicious", F.col("t") > 0)
    seen = []
    rows, counts = rt.run_observed(so.with_live_counts(s, "live"), "live", "rows long, suspicious long, last_t double", seen.append, every=0.05)
    assert rows.count() == 9
    assert [tuple(r) for r in counts.orderBy("batch_id").collect()] == [(0, 2, 1, 1.0), (1, 3, 2, 2.0), (2, 4, 3, 3.0)]
    assert [r["batch_id"] for r in seen] == [0, 1, 2]
