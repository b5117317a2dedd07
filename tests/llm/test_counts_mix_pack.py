"""Token counts, source mix and packing against brute force."""

import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from chronotrace.llm import packing, source_mix, token_counts
from chronotrace.llm.tokens import default_path, encoder


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(default_path())


def test_ids_are_those_of_the_tokenizer(tokenizer):
    enc = encoder(default_path())
    texts = ["", "a", " a", "a ", "a  b", "a   b", "x \n y", "x\n\n y ", "it's we'll", "é ß 漢字 🙂", "<|endoftext|> b", "\t tab", " nb sp", "a\u0085b", "  ", "1 22 333", "so--called \x1c x"]
    for t in texts:
        assert np.frombuffer(enc.ids(t), "<u4").tolist() == tokenizer.encode(t, add_special_tokens=False).ids, repr(t)
    assert enc.ids(None) == b""


def test_token_counts_against_brute_force(documents, tokenizer):
    texts = [r[0] for r in documents.select("narrative").collect()]
    lengths = Counter(len(tokenizer.encode(t, add_special_tokens=False).ids) for t in texts)
    got = {r["n_tokens"]: r for r in token_counts.token_counts(documents).collect()}
    assert set(got) == set(lengths)
    for n, r in got.items():
        assert r["n_narratives"] == lengths[n] and r["n_tokens_here"] == n * lengths[n]
        assert r["n_at_least"] == sum(c for k, c in lengths.items() if k >= n)
        assert r["tokens_at_least"] == sum(k * c for k, c in lengths.items() if k >= n)
        assert r["truncated_total"] == sum(min(k, n) * c for k, c in lengths.items())
        assert r["lost_total"] == sum(max(k - n, 0) * c for k, c in lengths.items())
    counts = token_counts.token_counts(documents)
    assert token_counts.total_within(counts, 777).first()["truncated_total"] == sum(min(k, 777) * c for k, c in lengths.items())
    ordered = sorted(lengths.elements())
    q = {r["q"]: r["n_tokens"] for r in token_counts.quantile_lengths(counts).collect()}
    assert q[0.5] == ordered[-(-len(ordered) // 2) - 1]


def test_token_counts_edges(narratives, odd_rows):
    got = token_counts.token_counts(narratives(odd_rows)).collect()
    assert sum(r["n_narratives"] for r in got) == len(odd_rows)
    assert next(r for r in got if r["n_tokens"] == 0)["n_narratives"] == 3
    assert token_counts.token_counts(narratives([])).count() == 0


def test_mix_reaches_targets(narratives):
    rows = [(i, "w " * (1 + i % 37), f"s{i % 7 if i % 3 else 0}") for i in range(600)]
    got = source_mix.mixed_totals(narratives(rows), block=64).collect()
    assert len(got) == 600
    total = sum(r["size"] for r in got)
    for s in {r["category"] for r in got}:
        mine = [r for r in got if r["category"] == s]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= 1
        assert mine[0]["target"] <= 2 * mine[0]["source_size"] and all(r["taken"] <= 2 * r["size"] for r in mine)
    assert abs(sum({r["category"]: r["target"] for r in got}.values()) - 1.5 * total) < 1e-6
    again = source_mix.mixed_totals(narratives(rows[::-1]), block=64).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def test_mix_prefixes_are_mixed_alike(narratives):
    """Any stretch of slots holds the categories by their shares, up to a few blocks."""
    rows = [(i, "w " * 50, f"s{i % 3}") for i in range(900)]
    got = source_mix.mixed_pieces(narratives(rows), block=32).select("slot", "category", "n_words").collect()
    slots = max(r["slot"] for r in got) + 1
    share = {s: sum(r["n_words"] for r in got if r["category"] == s) / slots for s in ("s0", "s1", "s2")}
    for upto in (100, 333, 700):
        for s, w in share.items():
            assert abs(sum(r["n_words"] for r in got if r["category"] == s and r["slot"] < upto) - w * upto) < 32 * 4


def test_first_slots_are_those_of_the_schedule(narratives):
    """Which slot a narrative comes in follows from the golden-ratio points, not from sizes alone."""
    rows = [(i, "w " * (1 + i % 40), f"s{i % 3}") for i in range(400)]
    pieces = source_mix.mixed_pieces(narratives(rows), block=32).collect()
    first = {}
    for r in pieces:
        first[r["video_id"]] = min(r["slot"], first.get(r["video_id"], r["slot"]))
    got = {r["video_id"]: r["first_slot"] for r in source_mix.mixed_totals(narratives(rows), block=32).collect()}
    assert got == {i: first.get(i) for i, _, _ in rows}
    owner = {r["slot"]: r["category"] for r in pieces}
    slots = len(owner)
    due = {c: sum(v == c for v in owner.values()) for c in ("s0", "s1", "s2")}
    bounds = [0, due["s0"], due["s0"] + due["s1"], slots]
    for t in range(min(300, slots)):
        x = int(((t + 1) * source_mix.PHI) % 1 * slots)
        want = next(c for c, hi in zip(("s0", "s1", "s2"), bounds[1:]) if x < hi)
        assert owner.get(t, want) == want


def test_mix_edges(narratives, odd_rows):
    got = source_mix.mixed_totals(narratives(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert all(r["taken"] == 0 for r in got if r["size"] == 0)
    assert {r["category"] for r in got} == {"x", "y", "z", None}
    assert source_mix.mixed_totals(narratives([])).count() == 0
    assert source_mix.mixed_totals(narratives([(1, None), (2, " ")])).count() == 2
    rows = source_mix.mixed_rows(narratives(odd_rows))
    assert rows.columns == narratives(odd_rows).columns
    assert rows.filter("trim(coalesce(narrative, '')) = ''").count() >= 3
    assert source_mix.mixed_rows(narratives([])).count() == 0


def test_plan_uses_every_piece_once():
    rng = np.random.default_rng(1)
    for _ in range(40):
        size = int(rng.integers(1, 60))
        counts = {int(n): int(rng.integers(1, 30)) for n in rng.integers(1, size + 1, rng.integers(1, 20))}
        plan = packing.two_fit_plan(counts, size)
        used = Counter()
        for pattern, times in plan:
            assert times > 0 and sum(pattern) <= size
            used.update({n: pattern.count(n) * times for n in set(pattern)})
        assert used == counts


def test_second_fit_trades_the_smallest():
    """70 and 20 leave 10; the trade of 20 for 16 and 14 fills the sequence."""
    assert sorted(packing.two_fit_plan({70: 1, 20: 1, 16: 1, 14: 1}, 100)[0][0]) == [14, 16, 70]


def test_pieces_round_trip(documents, tokenizer):
    got = packing.pack_narratives(documents, size=256).collect()
    text = {r["video_id"]: r["narrative"] for r in documents.collect()}
    by_sequence = {}
    for r in got:
        ids = tokenizer.encode(text[r["video_id"]], add_special_tokens=False).ids + [2]
        assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        assert r["length"] == 256 or r["piece"] == 0
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    assert len(by_sequence) <= 1.02 * -(-sum(r["length"] for r in got) // 256)


def test_pack_edges(narratives, odd_rows):
    got = packing.pack_narratives(narratives(odd_rows)).collect()
    assert sum(r["length"] == 1 for r in got) == 3
    assert sum(r["video_id"] == 1 for r in got) == 3
    assert packing.pack_narratives(narratives([])).count() == 0
