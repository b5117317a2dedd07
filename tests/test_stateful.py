"""Stateful operators against direct loops over small logs."""

import time

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronotrace.operators import pulses as pu, scoring, similarity, stateful as st
from chronotrace.operators.ordered import Lane
from chronotrace.params import BoxFusionParams, GlobalHeartbeatParams, PoolParams, SegmentationParams, TrackerParams, TriggerParams

ENTITY = Lane(("video_id", "entity_id"), ("t", "event_id"), 2.0)


def log(n=150, seed=0, videos=2, fps=10, dim=4, dense=True):
    r = np.random.default_rng(seed)
    step = r.integers(1, 4, n) if dense else r.choice([1, 2, 3, 40], n)
    f = np.cumsum(step)
    x = r.normal(size=(n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return pd.DataFrame(
        {"video_id": r.choice(videos, n, p=[0.8, 0.2] if videos == 2 else None), "entity_id": r.integers(0, 3, n), "event_id": np.arange(n), "frame_idx": f, "t": f / fps, "vec": list(x), "energy": r.random(n) * 0.2,
         "source": r.choice(["yolo", "motion"], n), "class_name": r.choice(["person", "car"], n)}
    )


def frame_of(spark, p):
    return spark.createDataFrame(p.assign(vec=[v.tolist() for v in p["vec"]]))


@pytest.mark.parametrize("dense,n,width,gap", [(True, 150, 2.0, 5), (False, 150, 2.0, 5), (True, 600, 4.0, 5), (True, 300, 1000.0, 5), (True, 600, 4.0, 70)])
def test_trigger_rules(spark, dense, n, width, gap):
    p, prm = log(n=n, dense=dense, seed=4), TriggerParams(jump=1.2, heartbeat=3.0, min_gap_frames=gap, frames_per_unit=10.0)
    got = {r.event_id: (r.rule, round(r.distance, 6)) for r in st.trigger_rows(frame_of(spark, p), ENTITY, prm, width).collect()}
    want, last = {}, {}
    for r in p.itertuples():
        key = (r.video_id, r.entity_id)
        if key not in last:
            want[r.event_id], last[key] = ("birth", 1.0), r
            continue
        q = last[key]
        if r.frame_idx - q.frame_idx < gap:
            continue
        d = 1 - float(r.vec @ q.vec)
        rule = "change_point" if d > 1.2 else "heartbeat" if r.t - q.t >= 3.0 else None
        if rule:
            want[r.event_id], last[key] = (rule, round(d, 6)), r
    assert got == want


@pytest.mark.parametrize("dense", [True, False])
def test_silent_heartbeats(spark, dense):
    p, prm, age = log(n=120, dense=dense, seed=5), TriggerParams(jump=1.2), 35
    got = {(r.video_id, r.entity_id, r.frame_idx, r.rule, r.silent, round(r.distance, 6)) for r in st.triggers_with_silence(frame_of(spark, p), prm, age, 16).collect()}
    want = set()
    for vid, g in p.groupby("video_id"):
        last, seen = {}, {}
        for f, rows in g.groupby("frame_idx"):
            t, fired = rows["t"].iloc[-1], set()
            for r in rows.itertuples():
                q = last.get(r.entity_id)
                seen[r.entity_id] = (f, r.vec)
                rule, d = None, None
                if q is None:
                    rule, d = "birth", 1.0
                elif f - q[0] >= 5:
                    d = 1 - float(r.vec @ q[2])
                    rule = "change_point" if d > 1.2 else "heartbeat" if t - q[1] >= 3.0 else None
                if rule:
                    last[r.entity_id] = (f, t, r.vec)
                    fired.add(r.entity_id)
                    want.add((vid, r.entity_id, f, rule, False, round(d, 6)))
            for e, (sf, x) in seen.items():
                if f - sf <= age and e not in fired and t - last[e][1] >= 3.0:
                    want.add((vid, e, f, "heartbeat", True, round(1 - float(x @ last[e][2]), 6)))
                    last[e] = (f, t, x)
    assert got == want


@pytest.mark.parametrize("gated", [True, False])
def test_global_heartbeat(spark, gated):
    p, prm = log(seed=6), GlobalHeartbeatParams(interval=2.0, drift=1.0)
    got = {(r.event_id, r.reason) for r in pu.global_heartbeats(frame_of(spark, p), prm, gated).collect()}
    want = set()
    for _, g in p.groupby("video_id"):
        base, last = None, -999.0
        for r in g.itertuples():
            due = r.t - last >= 2.0
            if gated and not due:
                continue
            base = r.vec if base is None else base
            why = "periodic" if due else None
            if 1 - float(r.vec @ base) > 1.0:
                why, base = "drift", r.vec
            if why:
                last = r.t
                want.add((r.event_id, why))
    assert got == want


def track_loop(g, p):
    active, nid, out = [], 0, {}
    for f, rows in g.groupby("frame_idx"):
        active = [a for a in active if f - a["f"] <= p.max_age_frames]
        rows = list(rows.itertuples())
        cand = sorted(((-float(r.vec @ a["v"]), i, j) for i, r in enumerate(rows) for j, a in enumerate(active)))
        mi, mj = set(), set()
        for s, i, j in cand:
            if -s < p.similarity:
                break
            if i in mi or j in mj:
                continue
            mi.add(i)
            mj.add(j)
            out[rows[i].event_id] = active[j]["id"]
        for i, r in enumerate(rows):
            if i in mi:
                a = next(a for a in active if a["id"] == out[r.event_id])
                a["v"], a["f"] = r.vec, f
        for i, r in enumerate(rows):
            if i not in mi:
                free = r.source in ("yolo", "fused") and r.class_name in p.exempt_classes
                if not free and r.energy < p.min_energy_new:
                    continue
                if len(active) >= p.max_active:
                    active.sort(key=lambda a: a["f"])
                    active.pop(0)
                active.append({"id": nid, "v": r.vec, "f": f})
                out[r.event_id] = nid
                nid += 1
    return out


@pytest.mark.parametrize("dense", [True, False])
def test_tracker(spark, dense):
    p, prm = log(n=200, seed=7, dense=dense), TrackerParams(similarity=0.6, max_age_frames=30, max_active=6, min_energy_new=0.06)
    p["frame_idx"] = p["frame_idx"] // 2 * 2  # several regions in a frame
    got = {(r.video_id, r.event_id): r.entity_id for r in st.track_entities(frame_of(spark, p), prm, 16).collect()}
    want = {(v, e): i for v, g in p.groupby("video_id") for e, i in track_loop(g, prm).items()}
    assert got == want


def test_reidentification(spark):
    p, prm = log(n=160, seed=8), PoolParams(similarity=0.6, max_age=20, max_size=9)
    got = {(r.video_id, r.event_id): (r.identity, r.is_new) for r in st.reidentify(frame_of(spark, p), prm).collect()}
    want = {}
    for vid, g in p.groupby("video_id"):
        pool, nid = {}, 0
        for f, rows in g.groupby("frame_idx"):
            act = [(i, v[0].copy()) for i, v in pool.items() if f - v[1] <= 20]
            taken = set()
            for r in rows.itertuples():
                sims = [(float(r.vec @ v), i) for i, v in act if i not in taken]
                best = max(sims, key=lambda z: z[0]) if sims else (-1, None)
                if best[0] >= 0.6:
                    i = best[1]
                    taken.add(i)
                    if i in pool:
                        m = 0.3 * r.vec + 0.7 * pool[i][0]
                        pool[i] = [m / np.linalg.norm(m), f]
                    want[vid, r.event_id] = (i, False)
                else:
                    want[vid, r.event_id] = (nid, True)
                    pool[nid] = [r.vec, f]
                    nid += 1
                    if len(pool) > 9:
                        for old in sorted(pool, key=lambda k: pool[k][1])[: max(1, len(pool) // 5)]:
                            del pool[old]
    assert got == want


@pytest.mark.parametrize("width", [4, 1000])
def test_machines_over_slices(spark, width):
    r = np.random.default_rng(9)
    p = pd.DataFrame({"k": [0] * 120 + [1] * 15, "i": [*range(120), *range(15)], "n": (r.random(135) < 0.3).astype(int), "iv": r.integers(1, 6, 135)})
    lane = Lane(("k",), ("i",), width)
    df = spark.createDataFrame(p)
    thr = {(x.k, x.i): x.threshold for x in st.threshold_machine(df, lane, "n", 10, 6, 4).collect()}
    kept = {(x.k, x.i) for x in st.adaptive_sampling(df, lane, "iv", 8).collect()}
    on = {(x.k, x.i): x.active for x in st.fallback_machine(df, lane, "n", 3, 4).collect()}
    for k, g in p.groupby("k"):
        t, streak, last, active, cool, es = 10, 0, None, False, 0, 0
        for x in g.itertuples():
            streak = 0 if x.n else streak + 1
            if x.n:
                t = min(t + 1, 10)
            elif streak >= 4:
                t = max(t - 1, 6)
            assert thr[k, x.i] == t
            if last is None or x.i - last >= x.iv:
                last = x.i
                assert (k, x.i) in kept
            elif x.i != g["i"].max():
                assert (k, x.i) not in kept
            es = 0 if x.n else es + 1
            run = False
            if active:
                run, cool = True, cool - 1
                if cool <= 0 and x.n:
                    active = False
            elif es >= 3:
                active, cool, run = True, 4, True
            assert on[k, x.i] == run


def test_box_fusion(spark):
    from chronotrace.operators.regions import fuse_boxes

    m = pd.DataFrame([(0, 0, 0, 0, 10, 10, 0.5), (0, 1, 1, 0, 10, 10, 0.4), (0, 2, 90, 90, 5, 5, 0.01)], columns=["f", "region_idx", "x", "y", "w", "h", "energy"])
    d = pd.DataFrame([(0, 0, 1, 0, 10, 10, "person", 0.9), (0, 1, 50, 50, 9, 9, "car", 0.1), (0, 2, 50, 10, 9, 9, "bag", 0.3)], columns=["f", "region_idx", "x", "y", "w", "h", "class_name", "confidence"])
    got = {(r.source, r.x, r.energy, r.class_name) for r in fuse_boxes(spark.createDataFrame(m), spark.createDataFrame(d), ("f",), BoxFusionParams()).collect()}
    # Detector box 0 goes to motion box 1 (identical); motion box 0 stays alone.
    assert got == {("fused", 1, 0.4, "person"), ("yolo", 50, 0.0, "bag"), ("motion", 0, 0.5, "")}


@pytest.mark.parametrize("cell", [8.0, 50.0, 1000.0])
def test_box_fusion_by_brute_force(spark, cell):
    from chronotrace.operators import regions as rg

    r = np.random.default_rng(2)
    box = lambda: [int(v) for v in (*r.integers(0, 60, 2), *r.integers(0, 25, 2))]
    ms = [(f, i, *box(), 0.5) for f in range(4) for i in range(30)] + [(1, 99, None, 1, 5, 5, 0.5)]
    ds = [(f, i, *box(), "person", 0.9) for f in range(4) for i in range(25)] + [(2, 77, 0, 0, 5, None, "car", 0.9)]
    m = spark.createDataFrame(ms, "f long, region_idx long, x long, y long, w long, h long, energy double")
    d = spark.createDataFrame(ds, "f long, region_idx long, x long, y long, w long, h long, class_name string, confidence double")

    def iou(a, b):
        if None in a or None in b:
            return 0.0
        i = max(0, min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0])) * max(0, min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1]))
        u = a[2] * a[3] + b[2] * b[3] - i
        return i / u if u > 0 else 0.0

    want = set()
    for f in range(4):
        pairs = sorted((-iou(a[2:6], b[2:6]), a[1], b[1]) for a in ms for b in ds if a[0] == b[0] == f and iou(a[2:6], b[2:6]) >= 0.1)
        um, ud = set(), set()
        for _, a, b in pairs:
            if a not in um and b not in ud:
                um.add(a)
                ud.add(b)
                want.add((f, a, b))
    got = {(x.f, x.mi, x.di) for x in rg.match_best_first(rg.overlapping_boxes(m, d, ("f",), 0.1, cell), ("f",)).collect()}
    assert got == want and len(want) > 20
    assert rg.match_best_first(rg.overlapping_boxes(m.filter("false"), d, ("f",), 0.1), ("f",)).count() == 0


def test_scorer_retries_and_falls_back(spark):
    def load():
        def fn(pdf):
            if (pdf["x"] == 3).any():
                raise RuntimeError("no")
            return pd.DataFrame({"y": pdf["x"] * 2.0})

        return fn

    df = spark.range(8).withColumn("x", F.col("id"))
    got = {r.id: (r.y, r.status) for r in scoring.score(df, load, "y double", "id", {"y": -1.0}).collect()}
    assert got == {i: ((-1.0, "fallback") if i == 3 else (i * 2.0, "ok")) for i in range(8)}


def test_propagation_without_edges_and_isolated(spark):
    vtx = spark.createDataFrame([(0, 0, [2.0, 0.0]), (0, 1, [0.0, 2.0]), (0, 2, [4.0, 4.0]), (1, 0, [1.0, 1.0])], "video_id long, frame_idx long, feat array<double>")
    e = spark.createDataFrame([(0, 0, 1, 1.0)], "video_id long, src long, dst long, weight double")
    got = {(r.video_id, r.frame_idx): [round(x, 4) for x in r.feat] for r in similarity.propagate(vtx, e, "feat").collect()}
    assert got == {(0, 0): [1.0, 1.0], (0, 1): [1.0, 1.0], (0, 2): [2.0, 2.0], (1, 0): [1.0, 1.0]}


def test_short_series_is_one_segment(spark):
    rows = [(0, i, [1.0, float(i == 3)], [0.5], [1.0, float(i == 3), 0.5]) for i in range(6)]
    f = spark.createDataFrame(rows, "video_id long, frame_idx long, app array<double>, mot array<double>, feat array<double>")
    got = [tuple(r) for r in similarity.segment_recordings(f, 2.0, SegmentationParams()).select("start_frame", "end_frame").collect()]
    assert got == [(0, 5)]


def test_top_similar_is_exact(spark):
    r = np.random.default_rng(11)
    n, k, p = 90, 3, SegmentationParams(block=8)
    app, mot = r.normal(size=(n, 4)), r.normal(size=(n, 2))
    rows = [(int(i >= 70), int(i if i < 70 else i - 70), app[i].tolist(), mot[i].tolist()) for i in range(n)]
    f = spark.createDataFrame(rows, "video_id long, frame_idx long, app array<double>, mot array<double>")
    got = {(x.video_id, x.src, x.dst): x.weight for x in similarity.top_similar(f, k, p).collect()}
    want = {}
    for v, lo, hi in ((0, 0, 70), (1, 70, 90)):
        a, m = app[lo:hi] / (np.linalg.norm(app[lo:hi], axis=1, keepdims=True) + 1e-6), mot[lo:hi]
        for i in range(hi - lo):
            w = (0.8 * a @ a[i] + 0.2 * np.exp(-np.linalg.norm(m - m[i], axis=1))) / (1 + 0.05 * abs(np.arange(hi - lo) - i))
            w[i] = -1
            for j in np.argsort(-w, kind="stable")[:k]:
                if w[j] > 0:
                    key = (v, min(i, int(j)), max(i, int(j)))
                    want[key] = max(want.get(key, 0), w[j])
    assert set(got) == set(want)
    assert all(abs(got[q] - want[q]) < 1e-9 for q in want)


def test_expand_range_over_blocks(spark):
    from chronotrace.operators.frames import expand_range

    df = spark.createDataFrame([(0, 0, 23), (1, 5, 6), (2, 4, 4)], "video_id long, a long, b long")
    for step in (1, 3):
        got = sorted((r.video_id, r.frame_idx) for r in expand_range(df, F.col("a"), F.col("b"), step=step, block=4).collect())
        assert got == sorted([(0, i) for i in range(0, 23, step)] + [(1, 5)])


@pytest.mark.parametrize("rounds,limit", [(8, 0.6), (8, 0.2), (8, 5.0), (1, 0.3)])
def test_baseline_moves_over_many_blocks(spark, monkeypatch, rounds, limit):
    """One recording over many blocks of few rows; with too few rounds the pass in order takes over."""
    monkeypatch.setattr(pu, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(4)
    n = 400
    x = np.cumsum(rng.normal(size=(n, 6)) * (rng.random(n) < 0.2)[:, None], axis=0) + rng.normal(size=6)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(v, float(i), i, x[(i * (v + 1)) % n].tolist()) for v in range(2) for i in range(n if v == 0 else 37)]
    d = spark.createDataFrame(rows, "video_id long, t double, event_id long, vec array<double>").repartition(6)
    got = {(r.video_id, r.event_id): (round(r.drift, 9), r.moved) for r in pu.moving_baseline(d, limit, rounds).collect()}
    want = {}
    for v in range(2):
        base = None
        for _, t, i, y in (r for r in rows if r[0] == v):
            base = np.array(y) if base is None else base
            drift = 1 - float(np.array(y) @ base)
            want[v, i] = (round(drift, 9), drift > limit)
            base = np.array(y) if drift > limit else base
    assert got == want
    assert (sum(m for _, m in got.values()) > 0) == (limit < 1)


def test_groups_are_whole_whatever_the_batches():
    p = pd.DataFrame({"k": np.repeat([3, 4, 5, 9, 9], [1, 2, 7, 3, 2]), "s": np.repeat([0, 0, 0, 0, 1], [1, 2, 7, 3, 2]), "v": np.arange(15)})
    for size in (1, 2, 3, 4, 15):
        found = []
        for pdf, bounds in st.whole_groups((p.iloc[i : i + size] for i in range(0, 15, size)), ["k", "s"]):
            found += [pdf["v"].iloc[lo:hi].tolist() for lo, hi in zip(bounds[:-1], bounds[1:])]
        assert found == [g["v"].tolist() for _, g in p.groupby(["k", "s"])]


def test_entries_of_a_slice_look_at_each_row_once():
    n, own = 4000, 500
    looked = []

    class Watched(np.ndarray):
        def __matmul__(self, other):
            looked.append(len(self))
            return np.asarray(self) @ np.asarray(other)

    f = np.arange(n)
    c = st._Chain(f, f / 100.0, np.zeros((n, 2)).view(Watched), own, TriggerParams(heartbeat=0.05, min_gap_frames=5))
    ends = {c.leaves(i) for i in range(own)}
    assert min(ends) >= n - 5 and sum(looked) <= 2 * c.LOOK * n and len(looked) <= n


def test_short_segments_cost_no_task_each(spark):
    """Twenty thousand keys of one or two rows; one call of pandas for each took over a minute."""
    o = spark.range(30000).select((F.col("id") % 20000).alias("video_id"), F.lit(1).alias("entity_id"), F.col("id").alias("event_id"), F.col("id").alias("frame_idx"), (F.col("id") / 10).alias("t"), F.array(F.lit(0.0)).alias("vec"))
    began = time.time()
    assert st.trigger_rows(o, ENTITY, TriggerParams(heartbeat=1.0)).count() == 30000
    assert time.time() - began < 40


def test_similarity_graph_of_many_small_blocks(spark):
    """A hundred and fifty blocks to a recording: 22,500 pairs of blocks, each of them one call of pandas before."""
    n, p = 1500, SegmentationParams(block=10)
    r = np.random.default_rng(3)
    app, mot = r.normal(size=(n, 6)), r.random((n, 2))
    f = spark.createDataFrame(pd.DataFrame({"video_id": 1, "frame_idx": np.arange(n), "app": app.tolist(), "mot": mot.tolist()}))
    began = time.time()
    got = similarity.decayed_similarity_graph(f, p).agg(F.count("*"), F.count_distinct("src", "dst"), F.sum("weight"), F.sum("src"), F.sum("dst")).first()
    assert time.time() - began < 20
    a = app / (np.linalg.norm(app, axis=1, keepdims=True) + 1e-6)
    apart = np.arange(n)[:, None] - np.arange(n)[None, :]
    w = (0.8 * a @ a.T + 0.2 * np.exp(-np.linalg.norm(mot[:, None] - mot[None], axis=2))) / (1 + 0.05 * np.abs(apart))
    best = np.argsort(np.argsort(-w.reshape(n, n // 10, 10), axis=2), axis=2).reshape(n, n)
    k = np.maximum(3, 5 - (np.arange(n) // 10 * 10) // (n // 10))
    take = (best < k[:, None]) & (w > 0)
    src, dst = np.nonzero(np.triu(take | take.T, 1))
    assert tuple(got)[:2] == (len(src), len(src)) and tuple(got)[3:] == (src.sum(), dst.sum())
    assert got[2] == pytest.approx(w[src, dst].sum(), rel=1e-9)


def test_sample_of_an_entity_out_of_sight_counts_until_old(spark):
    """Entity 1 beats at frame 34, is out of age at 36 and back at 37, three frames after its last sample."""
    at = [(1, 0), (2, 0), (2, 10), (2, 34), (2, 36), (1, 37), (2, 41)]
    p = pd.DataFrame([(1, e, i, f, f / 10) for i, (e, f) in enumerate(at)], columns=["video_id", "entity_id", "event_id", "frame_idx", "t"])
    p["vec"] = [[1.0, 0.0] if f < 37 else [0.0, 1.0] for f in p["frame_idx"]]
    got = {(r.frame_idx, r.silent) for r in st.triggers_with_silence(spark.createDataFrame(p), TriggerParams(), 35, 16).filter("entity_id = 1").collect()}
    assert got == {(0, False), (34, True)}
