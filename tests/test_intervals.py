"""Edge cases of interval operators."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronotrace.operators import frames as fr, intervals as iv, metrics as m, signals as sg
from chronotrace.operators.ordered import Lane


def test_touching_and_double_overlap(spark):
    seg = spark.createDataFrame([(0, 0, 0, 9), (0, 1, 10, 19), (0, 2, 30, 39)], "video_id long, seg_idx long, start_frame long, end_frame long")
    ann = spark.createDataFrame([(0, 0, 9, 10), (0, 1, 5, 9)], "video_id long, iv_idx long, s long, e long")
    for width in (4.0, 1000.0):
        got = {r.seg_idx: (r.overlap, r.contains_anomaly) for r in iv.overlap_totals(seg, ann, width=width).collect()}
        assert got == {0: (6, True), 1: (1, True), 2: (0, False)}
        cov = {r.iv_idx: (r.coverage, r.fragments) for r in iv.coverage(ann, seg, width).collect()}
        assert cov == {0: (1.0, 2), 1: (1.0, 1)}


def test_merge_keeps_exact_gap_together(spark):
    df = spark.createDataFrame([(0, 1, 0.0, 5.0), (0, 2, 15.0, 16.0), (0, 3, 26.5, 27.0), (0, 4, 1.0, 2.0)], "k long, id long, s double, e double")
    g = iv.merge_intervals(df, ("k",), "s", "e", "id", 10.0, 3.0, [F.count(F.lit(1)).alias("n")])
    assert sorted((r.s, r.e, r.n) for r in g.collect()) == [(0.0, 16.0, 3), (26.5, 27.0, 1)]


def test_points_exactly_min_gap_apart_stay(spark):
    df = spark.createDataFrame([(0, 0), (0, 4), (0, 7), (0, 9)], "k long, p long")
    assert sorted(r.p for r in iv.merge_close_points(df, Lane(("k",), ("p",), 3), 4).collect()) == [0, 9]


def test_nearest_point_tie_takes_first(spark):
    pr = spark.createDataFrame([(0, 5.0), (0, 100.0), (1, 1.0)], "k long, q double")
    pts = spark.createDataFrame([(0, 4.0, 1), (0, 6.0, 2), (1, 9.0, 3), (1, 9.0, 4)], "k long, p double, id long")
    got = {(r.k, r.q): (r.id, r.distance) for r in iv.nearest_point(pr, pts, ("k",), "q", "p", "id", []).collect()}
    assert got == {(0, 5.0): (1, 1.0), (0, 100.0): (2, 94.0), (1, 1.0): (3, 8.0)}


def test_masks_inclusive_and_exclusive(spark):
    sp = fr.frame_spine(spark.createDataFrame([(0, 6)], "video_id long, total_frames long"))
    ann = spark.createDataFrame([(0, 1, 3), (0, 9, 12)], "video_id long, s long, e long")
    ex = [r.gt for r in fr.interval_mask(sp, ann, 6).orderBy("frame_idx").collect()]
    inc = [r.gt for r in fr.interval_mask(sp, ann, 6, True).orderBy("frame_idx").collect()]
    assert ex == [0, 1, 1, 0, 0, 1] and inc == [0, 1, 1, 1, 0, 1]


def test_silent_flagged_recording_gets_base_score(spark):
    sp = fr.frame_spine(spark.createDataFrame([(0, 4), (1, 4)], "video_id long, total_frames long"))
    v = spark.createDataFrame([(0, True, 0.5, 0.0, 0.0), (1, False, 0.9, 0.0, 3.0)], "video_id long, is_anomaly boolean, confidence double, start_sec double, end_sec double")
    got = {(r.video_id, r.frame_idx): r.score for r in fr.ramp_scores(sp, v, 4, 1.0).collect()}
    assert all(abs(got[0, i] - 0.1) < 1e-12 and got[1, i] == 0 for i in range(4))


def test_ramp_against_loop(spark):
    sp = fr.frame_spine(spark.createDataFrame([(0, 60)], "video_id long, total_frames long"))
    v = spark.createDataFrame([(0, True, 0.9, 20.0, 30.0), (0, True, 0.4, 2.0, 58.0)], "video_id long, is_anomaly boolean, confidence double, start_sec double, end_sec double")
    got = np.array([r.score for r in fr.ramp_scores(sp, v, 60, 1.0).orderBy("frame_idx").collect()])
    want = np.zeros(60)
    for c, a, b in ((0.9, 20, 30), (0.4, 2, 58)):
        want[a:b] = np.maximum(want[a:b], c)
        lo, hi = max(0, a - 5), min(60, b + 5)
        want[lo:a] = np.maximum(want[lo:a], np.linspace(c * 0.1, c * 0.8, a - lo))
        want[b:hi] = np.maximum(want[b:hi], np.linspace(c * 0.8, c * 0.1, hi - b))
    assert np.allclose(got, want)


def test_empty_and_one_class(spark):
    e = spark.createDataFrame([(0, 0.0, 0.0)], "k long, g double, s double")
    assert m.soft_iou(e, ("k",), F.col("g"), F.col("s")).first().iou == 1.0
    assert m.hard_iou(e, ("k",), F.col("g") > 0, F.col("s") > 0).first().iou == 1.0
    s = m.curve_summary(m.score_curve(e.withColumn("x", F.lit(0.3)), "x", F.col("g") > 0)).first()
    assert s.auc == 0.0 and s.average_precision == 0.0
    none = e.filter("k > 5")
    c = m.confusion(none, F.col("g") > 0, F.col("s") > 0).first()
    assert (c.tp, c.total, c.f1) == (0, 0, 0.0)


def test_auc_matches_pair_count(spark):
    r = np.random.default_rng(0)
    p = pd.DataFrame({"x": np.round(r.random(300), 2), "g": r.random(300) < 0.3})
    got = m.curve_summary(m.score_curve(spark.createDataFrame(p), "x", F.col("g"), 0.05)).first()
    pos, neg = p[p.g].x.to_numpy(), p[~p.g].x.to_numpy()
    d = pos[:, None] - neg[None, :]
    assert abs(got.auc - ((d > 0).sum() + 0.5 * (d == 0).sum()) / d.size) < 1e-12


def test_hysteresis_and_smoothing(spark):
    from chronotrace.operators import blocks

    r = np.random.default_rng(1)
    x = r.random(90)
    df = spark.createDataFrame(pd.DataFrame({"k": 0, "i": range(90), "x": x}))
    on = [q.active for q in sg.hysteresis(df, Lane(("k",), ("i",), 7), "x", 0.8, 0.3).orderBy("i").collect()]
    state, want = False, []
    for v in x:
        state = v >= 0.8 or (state and v >= 0.3)
        want.append(state)
    assert on == want
    g = [q.y for q in blocks.gaussian_smooth(df, ("k",), "i", "x", 2.0, "y", block=20).orderBy("i").collect()]
    w = blocks.gaussian_weights(2.0)
    pad = np.pad(x, len(w) // 2, mode="symmetric")
    assert np.allclose(g, np.convolve(pad, w, mode="valid"))
    q = [z.y for z in blocks.quadratic_smooth(df, ("k",), "i", "x", 7, "y", block=16).orderBy("i").collect()]
    for i in range(90):
        b = min(max(i - 3, 0), 83)
        assert abs(q[i] - np.polyval(np.polyfit(np.arange(7), x[b : b + 7], 2), i - b)) < 1e-9


def test_range_totals_and_maxima_by_brute_force(spark):
    r = np.random.default_rng(9)
    pts = [(int(r.integers(0, 3)), float(r.integers(0, 60)), float(np.round(r.normal(), 3)), i) for i in range(200)]
    pts = [(k, t, e, int(t * 2) + k) for k, t, e, _ in pts] + [(1, None, 5.0, 0)]
    ivs = [(int(r.integers(0, 4)), i, float(a), float(a + r.integers(-3, 40))) for i, a in enumerate(r.integers(-10, 70, 80))] + [(0, 900, None, 5.0), (1, 901, 2.0, None), (2, 902, -5.0, 500.0), (2, 903, 10.0, 10.0)]
    p = spark.createDataFrame(pts, "k long, t double, x double, f long")
    i = spark.createDataFrame(ivs, "k long, id long, lo double, hi double").withColumn("label", F.lit("kept"))
    for width in (1.0, 7.0, 1000.0):
        tot = iv.range_totals(i, p, ("k",), ("id",), "t", F.col("lo"), F.col("hi"), width, {"sx": F.col("x")}, "n", {"f": F.col("f")})
        top = {x.id: x.m for x in iv.range_maxima(i, p, ("k",), ("id",), "t", F.col("lo"), F.col("hi"), width, "x", "m").collect()}
        rows = tot.collect()
        assert len(rows) == len(ivs) == len(top)
        for x in rows:
            hit = [q for q in pts if q[0] == x.k and q[1] is not None and x.lo is not None and x.hi is not None and x.lo <= q[1] <= x.hi]
            assert x.n == len(hit) and x.label == "kept"
            if hit:
                assert abs(x.sx - sum(q[2] for q in hit)) < 1e-9
                assert (x.first_f, x.last_f) == (min(q[3] for q in hit), max(q[3] for q in hit))
                assert top[x.id] == max(q[2] for q in hit)
            else:
                assert x.sx is None and x.first_f is None and top[x.id] is None


def test_range_totals_far_into_a_long_axis(spark):
    """Sums of whole slices are exact: small values after very large ones are not lost."""
    p = spark.createDataFrame([(0, 0.0, 1e15), (0, 1.0, 0.1)] + [(0, 10.0 + i, 0.001) for i in range(50)], "k long, t double, x double")
    i = spark.createDataFrame([(0, 1, 5.0, 100.0), (0, 2, 0.5, 2.0)], "k long, id long, lo double, hi double")
    got = {r.id: r.sx for r in iv.range_totals(i, p, ("k",), ("id",), "t", F.col("lo"), F.col("hi"), 0.5, {"sx": F.col("x")}).collect()}
    assert abs(got[1] - 0.05) < 1e-9 and abs(got[2] - 0.1) < 1e-9


def test_range_totals_of_nothing(spark):
    p = spark.createDataFrame([], "k long, t double, x double")
    i = spark.createDataFrame([(0, 1, 5.0, 100.0)], "k long, id long, lo double, hi double")
    (r,) = iv.range_totals(i, p, ("k",), ("id",), "t", F.col("lo"), F.col("hi"), 5.0, {"sx": F.col("x")}, "n").collect()
    assert (r.n, r.sx) == (0, None)
    assert iv.range_totals(i.filter("false"), p, ("k",), ("id",), "t", F.col("lo"), F.col("hi"), 5.0).count() == 0
    assert iv.range_maxima(i, p, ("k",), ("id",), "t", F.col("lo"), F.col("hi"), 5.0, "x", "m").first().m is None


@pytest.mark.parametrize("block", [1, 4, 64])
def test_painting_by_brute_force(spark, monkeypatch, block):
    """Pieces of all lengths over blocks of few frames: constants over many whole blocks, and slopes."""
    monkeypatch.setattr(fr, "EXPAND_BLOCK", block)
    r = np.random.default_rng(block)
    ps = [(int(r.integers(0, 3)), int(a), int(a + n), float(np.round(r.random(), 3)), float(s)) for a, n, s in zip(r.integers(-5, 150, 60), r.choice([0, 1, 3, 20, 90, 200], 60), r.choice([0.0, 0.0, 0.01, -0.02], 60))]
    pieces = spark.createDataFrame(ps, "video_id long, lo long, hi long, v double, slope double")
    spine = fr.frame_spine(spark.createDataFrame([(0, 150), (1, 3), (2, 64), (3, 5)], "video_id long, total_frames long"))
    got = {(x.video_id, x.frame_idx): x.score for x in fr.paint_largest(spine, pieces).collect()}
    assert len(got) == 150 + 3 + 64 + 5
    for (v, f), score in got.items():
        hit = [q + s * (f - lo) for k, lo, hi, q, s in ps if k == v and lo <= f < hi]
        assert (score is None and not hit) or abs(score - max(hit)) < 1e-12
    none = fr.paint_largest(spine, pieces.filter("false")).collect()
    assert len(none) == len(got) and all(x.score is None for x in none)


def test_rows_moved_do_not_grow_with_interval_length(spark, monkeypatch):
    monkeypatch.setattr(fr, "EXPAND_BLOCK", 4)
    long = spark.createDataFrame([(0, 1, 4 * 10**6, 0.5, 0.0)], "video_id long, lo long, hi long, v double, slope double")
    seen = []
    keep = fr.cut
    monkeypatch.setattr(fr, "cut", lambda d: seen.append(d.count()) or keep(d).limit(0))
    fr.paint_largest(fr.frame_spine(spark.createDataFrame([(0, 9)], "video_id long, total_frames long")), long).count()
    assert seen[0] < 50
