"""Steps whose work is more than their bytes say are spread over tasks, whatever their size."""

import re
from pathlib import Path

import numpy as np
from pyspark.sql import Row
from pyspark.sql import functions as F

from chronotrace.operators import frames as fr, intervals as iv, similarity as sim, temporal_graph as tg
from chronotrace.params import SegmentationParams
from chronotrace.plans import text_queries as tq, window_queries as wq
from chronotrace.sources import sinks as sk
from chronotrace.streaming.in_order import LATE, NO_TIME, Rule, _InOrder


def test_small_folders_are_written_by_many_tasks(spark, tmp_path):
    """One file to a folder, and more than one task writes them, though all their rows come from one task."""
    rows = spark.range(120).select((F.col("id") % 40).alias("video_id"), "id").coalesce(1).distinct()
    p = sk.append_manifest(rows, str(tmp_path / "m"), small=True)
    files = [f for f in Path(p).glob("*/*.parquet")]
    assert len(files) == len({f.parent for f in files}) == 40
    assert len({f.name.split("-")[1] for f in files}) > 1
    assert spark.read.parquet(p).count() == 120


def test_neighbours_are_summed_where_the_edges_are_found(spark):
    """Two steps along the graph without its edges, in chunks of any width, as along the list of edges; a
    recording of one frame has none and keeps its vector."""
    rng = np.random.default_rng(5)
    rows = [(v, i, *(rng.normal(size=n).tolist() for n in (6, 3, 4))) for v, n in ((1, 47), (2, 9), (3, 1)) for i in range(n)]
    frames = spark.createDataFrame(rows, "video_id long, frame_idx long, app array<double>, mot array<double>, feat array<double>")
    p = SegmentationParams(block=5, propagation_steps=2)
    at = lambda d: {(r.video_id, r.frame_idx): r.feat for r in d.collect()}
    want = at(sim.propagate(frames, sim.decayed_similarity_graph(frames, p), "feat", 2))
    for chunk_rows in (5, 20, 2000):
        found = at(sim.propagate_decayed(frames, "feat", p, chunk_rows))
        assert found.keys() == want.keys() and all(np.allclose(found[k], want[k], atol=1e-12) for k in want)
    assert found[3, 0] == rows[-1][4]


def test_ranges_are_filled_by_many_tasks(spark):
    """Ranges that take no room before they are filled are not filled by one task."""
    recs = spark.range(40).select(F.col("id").alias("video_id"), F.lit(500).alias("total_frames")).distinct()
    tasks = fr.frame_spine(recs).groupBy(F.spark_partition_id().alias("task")).count().collect()
    assert sum(r["count"] for r in tasks) == 20_000
    assert len(tasks) > 1 and max(r["count"] for r in tasks) < 20_000


def test_scores_of_all_frames_are_not_sent_to_every_task(spark):
    segs = spark.createDataFrame([(1, 0, 0, 4, 0.5), (1, 1, 2, 6, 0.9), (2, 0, 1, 3, 0.2)], "video_id long, seg_idx long, start_frame long, end_frame long, score double")
    spine = fr.frame_spine(segs.groupBy("video_id").agg(F.max("end_frame").alias("total_frames")))
    last, mean = fr.last_writer_scores(segs), fr.window_mean_scores(spine, segs)
    for d, want in ((last, [0.5, 0.5, 0.9, 0.9, 0.9, 0.9, 0.0, 0.2, 0.2]), (mean, [0.5, 0.5, 0.7, 0.7, 0.9, 0.9, 0.0, 0.2, 0.2])):
        assert "BroadcastHashJoin" not in d._jdf.queryExecution().executedPlan().toString()
        assert [round(r.score, 9) for r in d.orderBy("video_id", "frame_idx").collect()] == want


def test_a_key_of_a_stream_costs_two_calls_of_the_state_store():
    """Rows come one by one and in any order; the state is read once and written once, and a row without
    time or number is set aside as it is."""
    calls, stored = [], []

    class Kept:
        def get(self):
            calls.append("get")
            return stored[-1] if stored else None

        def update(self, v):
            calls.append("update")
            stored.append(v)

    rule = Rule("total double", "total double", ("x",), lambda kept, row: (((kept or (0.0,))[0] + row[2],), [((kept or (0.0,))[0] + row[2],)]))
    p = _InOrder(rule, ("k",), ("t", "event_id"), ["k", "t", "event_id", "total", "set_aside"], None)
    p.kept = Kept()
    rows = [Row(t=2.0, event_id=1, x=10.0), Row(t=1.0, event_id=2, x=1.0), Row(t=None, event_id=3, x=5.0), Row(t=3.0, event_id=None, x=5.0)]
    found = {tuple(r) for r in p.handleInputRows((7,), iter(rows), None)}
    assert found == {(7, 1.0, 2, 1.0, None), (7, 2.0, 1, 11.0, None), (7, None, 3, None, NO_TIME), (7, 3.0, None, None, NO_TIME)}
    assert calls == ["get", "update"]
    found = [tuple(r) for r in p.handleInputRows((7,), iter([Row(t=1.5, event_id=9, x=1.0)]), None)]
    assert found == [(7, 1.5, 9, None, LATE)] and stored[-1] == (2.0, 1, 11.0)


def test_narrative_heads_work_their_edges_out_once(spark, sf_dir, monkeypatch):
    calls, totals = [], tg.add_trace_totals
    monkeypatch.setattr(tg, "add_trace_totals", lambda *a, **k: calls.append(1) or totals(*a, **k))
    heads = tq.narrative_head(spark, sf_dir)
    assert heads.filter("head <> concat('Entity #', entity_id)").count() == 0 and len(calls) == 1


def test_range_totals_do_not_carry_the_rows_along(spark):
    """What an interval brings with it meets its totals once, at the end: totals are plain numbers in a hash table."""
    i = spark.createDataFrame([("a", 1, 0.0, 9.0, "x" * 50), ("a", 2, None, 3.0, "y"), ("b", 1, 1.0, 2.0, None)], "k string, id long, lo double, hi double, text string")
    p = spark.createDataFrame([("a", 1.0, 2.0, None), ("a", 8.0, 3.0, 5)], "k string, t double, x double, f long")
    d = iv.range_totals(i, p, ("k",), ("id",), "t", F.col("lo"), F.col("hi"), 4.0, {"sx": F.col("x")}, "n", {"f": F.col("f")})
    assert not re.search(r"SortAggregate\(key=\[[^]]*_id#", d._jdf.queryExecution().executedPlan().toString())
    assert d.columns == ["k", "id", "lo", "hi", "text", "n", "sx", "first_f", "last_f"]
    assert {tuple(r) for r in d.collect()} == {("a", 1, 0.0, 9.0, "x" * 50, 2, 5.0, None, 5), ("a", 2, None, 3.0, "y", 0, None, None, None), ("b", 1, 1.0, 2.0, None, 0, None, None, None)}


def test_totals_only_of_edges_that_the_walk_back_can_reach(spark, sf_dir, monkeypatch):
    given, totals = [], tg.add_trace_totals
    monkeypatch.setattr(tg, "add_trace_totals", lambda e, *a, **k: given.append(e) or totals(e, *a, **k))
    rows = wq.localisation(spark, sf_dir).count()
    (edges,) = given
    per = [r["count"] for r in edges.groupBy("video_id", "entity_id").count().collect()]
    assert 0 < len(per) <= rows and max(per) == 3


def test_nearest_points_leave_the_points_between_behind(spark, monkeypatch):
    """Of the points only the ends of slices are written with the probes. Probes at a point's own time, far from
    all points, beyond both ends and without any point."""
    written, write = [], iv.cut
    monkeypatch.setattr(iv, "cut", lambda d: written.append(write(d)) or written[-1])
    pts = spark.createDataFrame([("a", float(t), 1000 - t) for t in [*range(300), 301]] + [("a", 299.0, 5), ("a", 900.0, 7)], "k string, p double, id long")
    probes = {0.0: (1000, 0.0), -70.0: (1000, 70.0), 299.0: (5, 0.0), 299.5: (5, 0.5), 300.0: (5, 1.0), 600.5: (7, 299.5), 1000.0: (7, 100.0), 59.5: (940, 0.5)}
    pr = spark.createDataFrame([("a", q) for q in probes] + [("b", 3.0)], "k string, q double")
    got = {(r.k, r.q): (r.id, r.distance) for r in iv.nearest_point(pr, pts, ("k",), "q", "p", "id", []).collect()}
    assert got == {**{("a", q): r for q, r in probes.items()}, ("b", 3.0): (None, None)}
    assert sum(d.count() for d in written) < 40
