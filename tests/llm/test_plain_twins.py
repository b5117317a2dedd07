"""Fits and plans against plain versions: a dense objective, a dictionary of weights, one sequence at a time."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from chronotrace.llm import packing, toxicity


def dense(rows):
    out = np.zeros(rows.shape)
    np.add.at(out, (rows.rows, rows.cols), rows.values)
    return out


def problem(seed, n=80, m=12):
    r = np.random.default_rng(seed)
    x = (r.random((n, m)) < 0.35).astype(float)
    t = r.integers(-1, 2, (9, m)).astype(float)
    y = (x[:, 0] + x[:, 1] - x[:, 2] + r.normal(0, 0.7, n) > 0.4).astype(float)
    sparse = lambda a: toxicity._Rows(*np.nonzero(a), a[np.nonzero(a)], a.shape)
    return x, t, y, sparse(x), sparse(t)


def objective(x, t, y, penalty, lasso, ridge, w, b):
    """Mean log loss, penalty on score changes of twins, and both norms, with full matrices."""
    z = x @ w + b
    loss = np.mean(np.logaddexp(0, z) - y * z)
    return loss + penalty / len(t) * ((t @ w) ** 2).sum() + (lasso * np.abs(w)).sum() + ridge / 2 * (w**2).sum()


@pytest.mark.parametrize("penalty,ridge", [(0.0, 1e-3), (5.0, 1e-3), (5.0, 0.1)])
def test_descent_reaches_the_minimum_of_the_dense_objective(penalty, ridge, monkeypatch):
    """No step of a plain coordinate search from the fitted weights lowers the objective."""
    monkeypatch.setattr(toxicity, "ROUNDS", 3000)
    for seed in range(3):
        x, t, y, sx, st = problem(seed)
        assert np.array_equal(dense(sx), x) and np.array_equal(dense(st), t)
        lasso = np.full(x.shape[1], 0.01)
        w, b = toxicity._descend(sx, y, st, penalty, lasso, np.zeros(x.shape[1]), 0.0, ridge)
        best = objective(x, t, y, penalty, lasso, ridge, w, b)
        for step in (0.1, 0.01, 0.001):
            for i in range(x.shape[1] + 1):
                for sign in (-1, 1):
                    v, c = w.copy(), b
                    if i < len(w):
                        v[i] += sign * step
                    else:
                        c += sign * step
                    assert objective(x, t, y, penalty, lasso, ridge, v, c) >= best - 1e-8


def test_swaps_are_penalised(monkeypatch):
    """The penalty brings the scores of twins together; without it they differ more."""
    changes = []
    for penalty in (0.0, 5.0):
        x, t, y, sx, st = problem(5)
        w, _ = toxicity._descend(sx, y, st, penalty, np.zeros(x.shape[1]), np.zeros(x.shape[1]), 0.0, 1e-3)
        changes.append(np.abs(t @ w).mean())
    assert changes[1] < 0.5 * changes[0]


def test_scores_are_sums_of_a_dictionary():
    rng = random.Random(4)
    words = ["alpha", "beta", "gamma", "deltawing", "epsilonic", "z"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))) for _ in range(40)] + ["", None]
    h = np.unique(toxicity.features(pa.array(words, pa.string()))[0])
    weights = np.array([rng.uniform(-2, 2) for _ in h])
    model = toxicity.ToxicityModel(h, weights, -0.3)
    known = dict(zip(h.tolist(), weights.tolist()))
    for text, got in zip(texts, model.scores(pa.array(texts, pa.string()))):
        mine, row = toxicity.distinct_features(pa.array([text], pa.string()))
        want = 1 / (1 + np.exp(-(-0.3 + sum(known.get(int(x), 0.0) for x in set(mine.tolist())))))
        assert abs(got - want) < 1e-9, text


def one_at_a_time(counts, size):
    """Best-two-fit, a sequence after the other, over plain lists."""
    left = sorted(Counter(counts).elements(), reverse=True)
    out = []
    while left:
        seq = [left.pop(0)]
        while (fit := next((x for x in left if x <= size - sum(seq)), None)) is not None:
            left.remove(fit)
            seq.append(fit)
        gap = size - sum(seq)
        if gap and len(seq) > 1:
            small = seq.pop()
            left.append(small)
            room, best = gap + small, None
            for i, a in enumerate(left):
                for b in left[i + 1 :]:
                    if a + b <= room and (best is None or a + b > sum(best)):
                        best = (a, b)
            if best and sum(best) > small:
                seq += best
                for x in best:
                    left.remove(x)
            else:
                seq.append(small)
                left.remove(small)
            left.sort(reverse=True)
        out.append(sum(seq))
    return out


def test_two_fit_plan_is_that_of_one_sequence_at_a_time():
    """Planned for counts of lengths, as good as one sequence after the other: the same fill of each."""
    rng = np.random.default_rng(7)
    for _ in range(60):
        size = int(rng.integers(5, 40))
        counts = {int(n): int(rng.integers(1, 9)) for n in rng.integers(1, size + 1, rng.integers(1, 9))}
        plan = packing.two_fit_plan(counts, size)
        fills = [sum(p) for p, times in plan for _ in range(times)]
        plain = one_at_a_time(counts, size)
        assert sum(fills) == sum(plain)
        assert abs(len(fills) - len(plain)) <= max(1, 0.02 * len(plain)), (counts, size)
