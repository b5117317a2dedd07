"""N-gram join and digests against brute force."""

import hashlib
import random
import re
import time
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from chronotrace.llm import fingerprints as fp
from chronotrace.llm import ngram_join
from chronotrace.session import shared_dir


def shingles(text, width):
    w = [x for x in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if x]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)])


def brute(rows, width, percent):
    """Smallest id reachable by links, per row."""
    sets = [shingles(t, width) for _, t in rows]
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                up[root(i)] = root(j)
    least = {}
    for i, (n, _) in enumerate(rows):
        if n is not None and sets[i]:
            least[root(i)] = min(n, least.get(root(i), n))
    return [(n, len(s), least.get(root(i)) if s else n) for i, ((n, _), s) in enumerate(zip(rows, sets))]


def near_copies(rng, base, k, edits):
    out = []
    for _ in range(k):
        w = list(base)
        for _ in range(rng.randint(0, edits)):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def check(narratives, rows, width, percent):
    got = ngram_join.ngram_components(narratives(rows), width=width, percent=percent).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted([(r["video_id"], r["n_shingles"], r["component_id"]) for r in got], key=key) == sorted(brute(rows, width, percent), key=key)


def test_chains_of_near_copies(narratives):
    """Groups whose members link only in part, so that links run through chains."""
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(4000)}"
    texts = []
    for k, n in ((60, 150), (40, 60), (25, 400)):
        texts += near_copies(rng, [word() for _ in range(n)], k, 6)
    passage = " ".join(word() for _ in range(60))
    texts += [" ".join(word() for _ in range(rng.randint(1, 80))) + " " + passage for _ in range(60)]
    texts += texts[:20] + ["Two words", "two  WORDS", "one"]
    rng.shuffle(texts)
    check(narratives, list(enumerate(texts)), 3, 90)
    check(narratives, list(enumerate(texts)), 5, 80)


def test_join_edges(narratives, odd_rows):
    check(narratives, [r[:2] for r in odd_rows], 3, 90)
    assert ngram_join.ngram_components(narratives([])).count() == 0
    d = narratives(odd_rows)
    kept = ngram_join.one_per_group(d)
    assert kept.columns == d.columns
    got = sorted(((r["video_id"], (r["narrative"] or "").strip()) for r in kept.collect()), key=str)
    want = {(r[0], (r[1] or "").strip()) for r in odd_rows}
    assert len(got) == len(set((r[0], " ".join((r[1] or "").split())) for r in odd_rows)) and set(got) == want
    assert ngram_join.one_per_group(narratives([])).count() == 0


def test_every_row_without_words_stays(narratives):
    rows = [(None, None), (None, ""), (None, " "), (1, None), (1, ""), (2, ""), (None, "a b"), (None, "A  b"), (3, "a b"), (3, "a b"), (4, "c d"), (4, "e f")]
    kept = [(r["video_id"], r["narrative"]) for r in ngram_join.one_per_group(narratives(rows)).collect()]
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(kept, key=key) == sorted([*rows[:6], (3, "a b"), (4, "c d"), (4, "e f")], key=key)


def test_sets_with_one_digest_stay_apart(narratives):
    """Names of three bits: nearly all sets clash, and are told apart by their second digest."""
    rng = random.Random(8)
    texts = near_copies(rng, [f"w{k}" for k in range(60)], 20, 4) + [" ".join(f"v{rng.randrange(99)}" for _ in range(12)) for _ in range(30)] + ["", None, "x y z"] * 2
    rows = list(enumerate(texts))
    got = ngram_join.ngram_components(narratives(rows), digest_bits=3).collect()
    assert sorted((r["video_id"], r["n_shingles"], r["component_id"]) for r in got) == sorted(brute(rows, 5, 80))
    kept = sorted(r["video_id"] for r in ngram_join.one_per_group(narratives(rows), digest_bits=3).collect())
    assert kept == sorted({c for _, n, c in brute(rows, 5, 80) if n} | {i for i, n, _ in brute(rows, 5, 80) if not n})


def test_common_passage_in_texts_of_all_lengths(narratives):
    """One passage is most of many texts that are else different: its n-grams are met by all of them."""
    rng = random.Random(9)
    passage = " ".join(f"p{k}" for k in range(40))
    texts = [passage + " " + " ".join(f"u{i}x{k}" for k in range(i % 23)) for i in range(120)]
    rng.shuffle(texts)
    for width, percent in ((3, 90), (5, 80), (3, 50), (3, 100)):
        check(narratives, list(enumerate(texts)), width, percent)


def test_sets_differ_as_the_words_do():
    import pyarrow as pa

    texts = ["a b c", "a b  C\n", "ab c", "a bc", "", None, "a b", "b a", "x" * 9 + " y z", "x" * 8 + " xy z"]
    sets = ngram_join.shingle_sets(pa.array(texts), 3)
    same = lambda i, j: np.array_equal(sets[i], sets[j])
    for i in range(len(texts)):
        for j in range(len(texts)):
            assert same(i, j) == (shingles(texts[i], 3) == shingles(texts[j], 3)), (texts[i], texts[j])


def raw(text):
    return np.frombuffer(text.encode(), np.uint8)


def test_levels_are_entropies():
    b = raw("the quick brown fox " * 9 + "0" * 80 + "jumps över the dog")
    got = fp.window_levels(b)
    for i in range(len(got)):
        p = np.bincount(b[i : i + 64], minlength=256) / 64
        h = -(p[p > 0] * np.log2(p[p > 0])).sum()
        assert abs(int(got[i]) - h / 6 * 1000) <= 1


def test_features_are_the_rarest_of_their_stretch():
    rng = np.random.default_rng(0)
    rank = rng.integers(0, 200, 700).astype(np.uint16)
    points = np.zeros(700, int)
    for i in range(700 - 63):
        points[i + int(np.argmin(rank[i : i + 64]))] += 1
    assert fp._features(rank).tolist() == np.flatnonzero(points >= 16).tolist()


def test_digests(narratives):
    rng = random.Random(6)
    say = lambda n: " ".join("".join(rng.choice("aeioumnstklr") for _ in range(rng.randint(2, 9))) for _ in range(n))
    rows = [(10 * i, say(rng.randint(1, 400))) for i in range(60)] + [(7, ""), (3, None), (5000, "x"), (None, say(90)), (11, "été " * 30)]
    rows += [(9000, rows[0][1])]
    got = {r["video_id"]: r for r in fp.fingerprints(narratives(rows), chunk_ids=64).collect()}
    assert len(got) == len(rows)
    order = sorted((r for r in rows), key=lambda r: -(r[0] if r[0] is not None else -1))
    texts = [t or "" for _, t in order]
    for (n, _), text, after in zip(order, texts, texts[1:] + texts[:1]):
        k = len(text) // 3
        edited = text[: len(text) - k] + after[:k]
        assert got[n]["n_chars"] == len(text)
        assert got[n]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert 0 <= got[n]["near_next"] <= 1
    assert got[0]["fingerprint"] == got[9000]["fingerprint"]
    long = [r for r in got.values() if r["n_chars"] > 600]
    assert min(r["near_edited"] for r in long) > 0.3
    assert np.mean([r["near_next"] for r in long]) < 0.05 and max(r["near_next"] for r in long) < 0.6  # short ones agree by chance
    again = {r["video_id"]: r for r in fp.fingerprints(narratives(rows), chunk_ids=1000).collect()}
    assert all(tuple(got[n]) == tuple(again[n]) for n in got)


def test_mixed_windows_equal_those_of_the_whole():
    ranks = np.arange(fp.LEVELS + 1).astype(np.uint16)
    rng = random.Random(2)
    for _ in range(60):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randrange(200))) for _ in range(2))
        ra, rb = raw(a), raw(b)
        mixed = fp._mixed_rank(ra, ranks[fp.window_levels(ra)], rb, ranks[fp.window_levels(rb)], ranks)
        assert np.array_equal(mixed, ranks[fp.window_levels(np.concatenate([ra, rb]))])


def test_digest_edges(narratives, odd_rows):
    got = fp.fingerprints(narratives(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    assert all(r["fingerprint"] == "" for r in got if r["n_chars"] == 0)
    assert fp.fingerprints(narratives([])).count() == 0
    assert fp.likeness(fp.from_text(""), fp.from_text("")) == 1.0


def folder_bytes(path):
    return sum(f.stat().st_size for f in Path(path).rglob("*") if f.is_file())


def test_whole_sets_are_made_only_where_bits_leave_room(spark, narratives):
    """Long texts of one size that share a rare passage meet, and are told apart without their sets: counts
    by 32 hash ranges leave room for any two of them. Alike ones are still found."""
    rng = random.Random(12)
    passage = " ".join(f"p{k}" for k in range(40))
    texts = [passage + " " + " ".join(f"u{rng.randrange(10**7)}" for _ in range(3000)) for _ in range(40)]
    texts += near_copies(rng, texts[0].split(), 3, 20)
    rows, folder = list(enumerate(texts)), shared_dir(spark).removeprefix("file:")
    before = folder_bytes(folder)
    check(narratives, rows, 3, 90)
    assert folder_bytes(folder) - before < 0.75 * 40 * 3000 * 8


def test_bits_apart_never_exceed_ngrams_apart():
    rng = np.random.default_rng(3)
    for percent in (50, 80, 90, 100):
        for n in (1, 7, 100, 3000):
            for other in (n, n + 1, 2 * n + 5):
                s = np.unique(rng.integers(0, 2**63, 3 * n + 9).astype(np.uint64))
                for shift in (0, 1, n // 20, n):
                    x, y = s[:n], s[shift : shift + other]
                    apart = ngram_join.bits_apart(ngram_join.parity_bits(x, percent), ngram_join.parity_bits(y, percent))
                    differ = len(np.setxor1d(x, y))
                    assert apart <= differ and (differ - apart) % 2 == 0
    a, b = (ngram_join.parity_bits(np.unique(rng.integers(0, 2**63, 3000).astype(np.uint64)), 90) for _ in range(2))
    assert ngram_join.bits_apart(a, b) > 2 * 3000 * 10 // 190


def test_counts_of_cells_are_packed_whole():
    for counts in (np.zeros(8, np.int64), np.array([0, 1, 255, 256, 70000, 2**32 - 1, 2**32, 2**40])):
        assert ngram_join._unpacked(ngram_join._packed(counts)).tolist() == np.minimum(counts, 2**32 - 1).tolist()


def test_shuffle_files_go_with_the_job(spark):
    """A table that is written needs the shuffles behind it no more, and a user's setting comes back."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    dirs = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f.name for d in dirs for f in Path(d).rglob("shuffle_*.data")}
    was, before = spark.conf.get(name, None), files()
    rows = ngram_join.stored(spark.range(5000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count())
    assert rows.count() == 7 and spark.conf.get(name, None) == was
    for _ in range(50):
        if len(left := files() - before) < 2:  # one of the count
            break
        time.sleep(0.2)
    assert len(left) < 2, left
