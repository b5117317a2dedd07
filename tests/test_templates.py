"""Template alignment of whole sequences against a plain dynamic programme."""

import random

import numpy as np
import pandas as pd
import pytest

from chronotrace.functions import actions as ac
from chronotrace.operators import templates as tp
from chronotrace.operators.ordered import Lane

LANE = Lane(("video_id", "entity_id"), ("t", "event_id"), 64)
WORDS = ["entering", "walking", "browsing", "picking up", "paying", "leaving", "standing still", "looking at", "talking", "riding", "Walking ", "", None]


def plain(actions, template):
    """The table of the alignment, cell by cell."""
    like, n, m = ac._Likeness(), len(actions), len(template.actions)
    cheap = {o.lower() for o in template.optional}
    dp = np.zeros((n + 1, m + 1))
    dp[0] = -ac.LEADING_TEMPLATE * np.arange(m + 1)
    for i, a in enumerate(actions, 1):
        a = a or ""
        dp[i, 0] = dp[i - 1, 0] - ac.LEADING_ACTION
        for j in range(1, m + 1):
            skip = ac.SKIP_OPTIONAL if a.lower() in cheap else ac.SKIP_ACTION
            dp[i, j] = max(dp[i - 1, j - 1] + like[a, template.actions[j - 1]], dp[i - 1, j] - skip, dp[i, j - 1] - ac.SKIP_TEMPLATE)
    return float(np.clip(dp[n, m] / min(n, m), 0, 1))


def frame(spark, sequences):
    rows = [(1, e, i, float(k), a) for e, seq in enumerate(sequences) for i, (k, a) in enumerate(enumerate(seq))]
    return spark.createDataFrame(rows, "video_id long, entity_id long, event_id long, t double, act string").repartition(5)


@pytest.mark.parametrize("slice_actions,fan", [(1000, 32), (7, 3), (1, 2)])
def test_slices_join_to_the_whole(spark, slice_actions, fan):
    rng = random.Random(6)
    sequences = [[rng.choice(WORDS) for _ in range(n)] for n in (1, 2, 6, 7, 8, 40, 63, 64, 65)]
    got = tp.template_alignment(frame(spark, sequences), LANE, "act", slice_actions=slice_actions, fan=fan).collect()
    assert len(got) == len(sequences)
    for r in got:
        seq = sequences[r["entity_id"]]
        assert r["num_actions"] == len(seq)
        assert np.allclose(r["scores"], [plain(seq, t) for t in ac.PATH_TEMPLATES], atol=1e-9)


def test_one_row_for_a_long_sequence(spark):
    rng = random.Random(3)
    sequence = [rng.choice(WORDS) for _ in range(5000)]
    long = [ac.PathTemplate("long", ["*"], [rng.choice(WORDS[:9]) for _ in range(30)], ["looking at"]), ac.PATH_TEMPLATES[0]]
    (r,) = tp.template_alignment(frame(spark, [sequence]), LANE, "act", long, slice_actions=700).collect()
    assert r["num_actions"] == 5000
    assert np.allclose(r["scores"], [plain(sequence, t) for t in long], atol=1e-9)


def test_agrees_with_the_single_pass_function(spark):
    rng = random.Random(1)
    sequences = [[rng.choice(WORDS[:10]) for _ in range(rng.randint(1, 30))] for _ in range(40)]
    d = spark.createDataFrame([(i, s) for i, s in enumerate(sequences)], "entity_id long, seq array<string>")
    want = {r[0]: r[1] for r in d.select("entity_id", ac.template_scores()("seq")).collect()}
    got = tp.template_alignment(frame(spark, sequences), LANE, "act", slice_actions=4, fan=2).collect()
    assert all(np.allclose(r["scores"], want[r["entity_id"]], atol=1e-9) for r in got) and len(got) == 40


def test_no_rows_no_result(spark):
    assert tp.template_alignment(frame(spark, [["walking"]]).filter("false"), LANE, "act").count() == 0


def test_products_are_given_back_in_small_parts(spark):
    """A batch of products is a hundred times its actions, so it must not be held as one."""
    parts = list(tp._slice_products(ac.PATH_TEMPLATES).func(iter([pd.Series([["walking"]] * 1000)])))
    assert sum(map(len, parts)) == 1000 and max(map(len, parts)) <= tp.TOGETHER
