"""Sliced operators against plain loops: any slice width, one key holding most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from chronotrace.operators.ordered import Lane, bounded_window, exact_quantiles, islands, neighbours, number_rows, running


def skewed(n=240, seed=1):
    r = np.random.default_rng(seed)
    k = np.where(r.random(n) < 0.6, 0, r.integers(1, 5, n))  # key 0 holds most rows
    t = r.integers(0, 60, n) / 2.0
    return pd.DataFrame({"k": k, "t": t, "id": np.arange(n), "x": r.integers(-9, 9, n).astype(float)}).sort_values(["k", "t", "id"]).reset_index(drop=True)


@pytest.mark.parametrize("width", [0.5, 3.0, 1000.0])
def test_running_and_numbers(spark, width):
    p = skewed()
    lane = Lane(("k",), ("t", "id"), width)
    df = spark.createDataFrame(p)
    pos = F.when(F.col("x") > 0, F.col("x"))
    got = running(df, lane, {"s": ("sum", F.col("x")), "m": ("max", F.col("x")), "l": ("last", pos)})
    got = running(got, lane, {"pm": ("max", F.col("x"))}, include_current=False)
    got = number_rows(got, lane, "n").toPandas().sort_values(["k", "t", "id"]).reset_index(drop=True)
    g = p.groupby("k")["x"]
    assert np.allclose(got["s"], g.cumsum())
    assert np.allclose(got["m"], g.cummax())
    assert np.allclose(got["l"].fillna(-99), p["x"].where(p["x"] > 0).groupby(p["k"]).ffill().fillna(-99))
    assert np.allclose(got["pm"].fillna(-99), g.cummax().groupby(p["k"]).shift().fillna(-99))
    assert (got["n"] == p.groupby("k").cumcount() + 1).all()


@pytest.mark.parametrize("width", [0.5, 1000.0])
def test_neighbours_and_islands(spark, width):
    p = skewed(seed=2)
    lane = Lane(("k",), ("t", "id"), width)
    df = spark.createDataFrame(p)
    got = neighbours(df, lane, {"pid": F.col("id")}, {"nid": F.col("id")}, number="i")
    got = islands(got, lane, {"t": F.col("t")}, lambda a, b: b["t"] - a["t"] > 0.5).toPandas().sort_values(["k", "t", "id"]).reset_index(drop=True)
    g = p.groupby("k")
    assert (got["pid"].fillna(-1) == g["id"].shift().fillna(-1)).all()
    assert (got["nid"].fillna(-1) == g["id"].shift(-1).fillna(-1)).all()
    assert (got["i"] == g.cumcount()).all()
    brk = (g["t"].diff().fillna(99) > 0.5).astype(int)
    assert (got["island"] == brk.groupby(p["k"]).cumsum()).all()


def test_bounded_window_over_block_edges(spark):
    p = pd.DataFrame({"k": [0] * 100 + [1] * 7, "pos": [*range(100), *range(7)], "x": np.arange(107) * 1.0})
    got = bounded_window(spark.createDataFrame(p), ("k",), "pos", 3, 2, lambda w: [F.sum("x").over(w).alias("s"), F.count("x").over(w).alias("c")], block=8)
    got = got.toPandas().sort_values(["k", "pos"]).reset_index(drop=True)
    assert len(got) == len(p)
    for k, g in p.groupby("k"):
        x = g["x"].to_numpy()
        want = [x[max(0, i - 3) : i + 3].sum() for i in range(len(x))]
        assert np.allclose(got[got["k"] == k]["s"], want)


@pytest.mark.parametrize("alpha", [0.3, 0.01])
def test_score_ema_has_no_horizon(spark, alpha):
    from chronotrace.operators.signals import score_ema

    r = np.random.default_rng(5)
    p = pd.DataFrame({"k": r.integers(0, 2, 1400), "t": np.arange(1400), "x": (np.arange(1400) < 9) * 1.0, "other": 1})
    got = score_ema(spark.createDataFrame(p), Lane(("k",), ("t",), 50), "x", alpha).toPandas().sort_values("t")
    assert list(got.columns) == ["k", "t", "x", "other", "ema"]
    for k, g in p.groupby("k"):
        e, want = None, []
        for x in g["x"]:
            e = x if e is None else alpha * x + (1 - alpha) * e
            want.append(e)
        assert np.allclose(got[got["k"] == k]["ema"], want, atol=1e-12)


@pytest.mark.parametrize("outlier", [0.0, 1e12])
def test_exact_quantiles(spark, outlier):
    r = np.random.default_rng(3)
    p = pd.DataFrame({"k": np.where(r.random(999) < 0.7, 0, 1), "x": np.append(np.round(r.normal(size=998), 2), outlier)})
    got = exact_quantiles(spark.createDataFrame(p), ("k",), "x", {"q1": 0.1, "q5": 0.5, "q99": 0.99}, buckets=16).toPandas().set_index("k")
    for k, g in p.groupby("k"):
        assert np.allclose(got.loc[k, ["q1", "q5", "q99"]].astype(float), np.quantile(g["x"], [0.1, 0.5, 0.99]))
    one = exact_quantiles(spark.createDataFrame(pd.DataFrame({"k": [1], "x": [4.0]})), (), "x", {"m": 0.5}).toPandas()
    assert one["m"].tolist() == [4.0]
