"""Open-window packing, token alignment and action tries against brute force."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from chronotrace.llm import action_trie, alignment, queries, window_packing
from chronotrace.llm.tokens import default_path
from chronotrace.llm.window_packing import Windows


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(default_path())
    return t


def _check_packing(rows, texts, tokenizer, size):
    """Every id once, pieces as they say, sequences gapless, padding only where it costs nothing."""
    ids = Counter()
    for video, text in texts:
        ids[(video, tuple(tokenizer.encode(text or "", add_special_tokens=False).ids) + (0,))] += 1
    fill = defaultdict(list)
    for r in rows:
        fill[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in fill.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at and length > 0
            at += length
        assert at <= size and (at == size or at & (at - 1) == 0)
    assert sum(len(k[1]) * n for k, n in ids.items()) == sum(r["length"] for r in rows)
    by_video = defaultdict(list)
    for r in rows:
        by_video[r["video_id"]].append(r)
    for (video, seq), n in ids.items():
        raw = np.array(seq, "<u4").tobytes()
        mine = [r for r in by_video[video] if r["doc_tokens"] == len(seq) and zlib.crc32(raw[4 * r["start"] : 4 * (r["start"] + r["length"])]) == r["ids_crc32"]]
        covered = Counter(i for r in mine for i in range(r["start"], r["start"] + r["length"]))
        assert len(covered) == len(seq) and min(covered.values()) >= n


def test_window_packing_holds_every_id_once(documents, tokenizer):
    texts = [tuple(r) for r in documents.select("video_id", "narrative").collect()]
    rows = window_packing.pack_open_windows(documents.repartition(5), windows=8).collect()
    _check_packing(rows, texts, tokenizer, 1024)
    lengths = Counter(r["sequence_id"] for r in rows)
    short = [r for r in rows if r["doc_tokens"] <= 1024]
    whole = sum(r["length"] == r["doc_tokens"] for r in short)
    assert whole > 0.5 * len({r["video_id"] for r in short}) and lengths


def test_window_packing_edges(narratives, odd_rows, tokenizer):
    rows = window_packing.pack_open_windows(narratives(odd_rows), size=64, windows=2).collect()
    _check_packing(rows, [(r[0], r[1]) for r in odd_rows], tokenizer, 64)
    assert window_packing.pack_open_windows(narratives([])).count() == 0


def test_leftovers_of_many_tasks_are_merged(narratives, tokenizer, monkeypatch):
    monkeypatch.setattr(window_packing, "MERGED", 3)
    texts = [(i, "word " * (i % 23)) for i in range(300)]
    rows = window_packing.pack_open_windows(narratives(texts).repartition(20), size=32, windows=4).collect()
    _check_packing(rows, texts, tokenizer, 32)
    total = sum(r["length"] for r in rows)
    assert len({r["sequence_id"] for r in rows}) <= total // 32 + 5


def test_windows_place_best_fit_and_emit_the_fullest():
    w = Windows(10, 2, 0)
    piece = lambda n: bytes(4 * n)
    w.place("a", 7, 0, piece(7))
    w.place("b", 4, 0, piece(4))
    assert w.gaps == [(3, 0), (6, 1)]
    w.place("c", 3, 0, piece(3))  # fills the fuller one exactly
    assert [r[0] for r in w.rows] == ["a", "c"] and w.gaps == [(6, 1)]
    w.place("d", 8, 0, piece(8))
    w.place("e", 9, 0, piece(9))  # fits none: the fullest gets what it lacks, the rest opens a window of its own
    assert [(r[0], r[1], r[2]) for r in w.rows[2:]] == [("d", 0, 8), ("e", 0, 2)]
    assert sorted(w.gaps) == [(3, 2), (6, 1)] or sorted(w.gaps) == [(3, 3), (6, 1)]
    w.place("f", 25, 0, piece(25))
    assert sum(r[2] for r in w.rows if r[0] == "f") >= 20


def _brute_alignment(texts):
    import sentencepiece

    a_tok = Tokenizer.from_file(default_path())
    a_tok.encode_special_tokens = True
    b_tok = sentencepiece.SentencePieceProcessor(model_file=alignment.default_piece_path())
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    docs, count = [], Counter()
    for t in texts:
        groups, links = [], []
        if t:
            enc = a_tok.encode(" " + t, add_special_tokens=False)
            a = [(i, bytes(letter[c] for c in a_tok.id_to_token(i))) for i in enc.ids]
            b = []
            for i in b_tok.encode(t):
                p = b_tok.id_to_piece(i)
                b.append((i, bytes([int(p[3:5], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode()))
            if b"".join(x for _, x in a) == b"".join(x for _, x in b) == (" " + t).encode():
                ends_a, ends_b = {}, {}
                for toks, ends in ((a, ends_a), (b, ends_b)):
                    at = 0
                    for k, (_, x) in enumerate(toks):
                        at += len(x)
                        ends[at] = k
                ka = kb = 0
                for at in sorted(set(ends_a) & set(ends_b)):
                    groups.append(([i for i, _ in a[ka : ends_a[at] + 1]], [i for i, _ in b[kb : ends_b[at] + 1]]))
                    links.append((a[ends_a[at]][0], b[ends_b[at]][0]))
                    ka, kb = ends_a[at] + 1, ends_b[at] + 1
        docs.append((groups, links))
        count.update(links)
    top = defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    out = []
    for groups, links in docs:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links), sum(count[p] == top[p[1]] for p in links), sum(count[p] for p in links), sum(len(x) * len(y) for x, y in groups), text))
    return out


ODD_TEXTS = [
    "", None, " ", "  two  blanks ", "a▁b", "tail ", "<|endoftext|> and <s> </s> <unk> <0x41>", "é ß 漢字 🙂 naïve", "x\n\n y\tz\r\n", "1234567 3.14", "﻿bom", "ﬁ ligature",
    "=" * 500, "a" * 999, "ab" * 700, "nul\x00byte", "é combining", "don't we'll", " nbsp 　wide",
]


def test_alignment_against_brute_force(documents, narratives):
    rows = documents.select("video_id", "narrative").collect()[:60]
    texts = [r["narrative"] for r in rows] + ODD_TEXTS + ODD_TEXTS[:9]
    got = {r["video_id"]: tuple(r)[1:] for r in alignment.token_alignment(narratives([(i, t) for i, t in enumerate(texts)])).collect()}
    want = _brute_alignment(texts)
    assert len(got) == len(texts)
    for i, w in enumerate(want):
        assert got[i] == w, (i, texts[i])
    assert want[texts.index("a▁b")][0] == 0


def test_alignment_edges(narratives, odd_rows):
    got = alignment.token_alignment(narratives(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    want = Counter(_brute_alignment([r[1] for r in odd_rows]))
    assert Counter(tuple(r)[1:] for r in got) == want
    assert alignment.token_alignment(narratives([])).count() == 0


def test_overlaps_and_group_rows(narratives, monkeypatch):
    monkeypatch.setattr(alignment, "ROW_BYTES", 7)
    rng = random.Random(5)
    cut = lambda n: np.diff([0, *sorted(rng.sample(range(1, n), n // 3)), n])
    a, b = cut(200), cut(200)
    span = lambda x: list(zip(np.cumsum(x) - x, np.cumsum(x)))
    want = [(i, j, min(q, s) - max(p, r)) for i, (p, q) in enumerate(span(a)) for j, (r, s) in enumerate(span(b)) if min(q, s) > max(p, r)]
    assert [tuple(map(int, x)) for x in zip(*alignment.overlaps(a.astype(np.int64), b.astype(np.int64)))] == want
    texts = narratives([(1, "Überwachung 12345"), (2, None), (3, "someone walks")])
    for kind, names in (("overlap", ["video_id", "a_pos", "b_pos", "n_bytes"]), ("group", ["video_id", "a_pos", "b_from", "b_to"])):
        found = alignment.token_links(texts, kind)
        assert found.columns == names and {r["video_id"] for r in found.collect()} == {1, 3}
    group = alignment.token_links(texts, "group").collect()
    n = {r["video_id"]: r for r in alignment.token_alignment(texts).collect()}
    for v in (1, 3):
        mine = [r for r in group if r["video_id"] == v]
        assert len(mine) == n[v]["n_a"] and sum(r["b_to"] - r["b_from"] + 1 for r in mine) == n[v]["n_shared"]


def test_general_product_of_sparse_matrices():
    rng = np.random.default_rng(3)
    x, y = (rng.random((9, 7)) < 0.4).astype(int), (rng.random((7, 11)) < 0.4).astype(int)
    csr = lambda m: (np.concatenate([[0], np.cumsum(m.sum(1))]), np.nonzero(m)[1])
    ptr, col, val = alignment.product(csr(x), csr(y), 11)
    dense = np.zeros((9, 11), int)
    dense[np.repeat(np.arange(9), np.diff(ptr)), col] = val
    assert (dense == x @ y).all()


def _brute_trie(seqs):
    """Nodes from a plain dictionary of prefixes: {(smallest member, depth): the other columns}."""
    members, words = defaultdict(list), {}
    for e, seq in seqs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(e)
    out = {}
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = sum(not any(r[: len(q)] == q and len(r) == len(q) + 1 for r in below) for q in below)
        saved = sum((len(members[q]) - 1) * len(q[-1][1].split()) for q in below if q)
        ends = ",".join(map(str, sorted(e for e in m if len(seqs[e]) == len(p))))
        parent = min(members[p[:-1]]) if p else None
        out[(min(m), len(p))] = (parent, len(m), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest())
    assert not words
    return out


def _trie(actions, order, entities=None):
    local = action_trie.shard_nodes(actions, order, entities)
    digests = {r["key"]: r["ends_sha256"] for r in action_trie.end_digests(local).collect()}
    rows = action_trie.action_trie(local).collect()
    none = hashlib.sha256(b"").hexdigest()
    found = {(r["entity_id"], r["depth"]): (r["parent_entity_id"], r["n_entities"], r["n_children"], r["n_leaves"], r["saved_words"], digests.get(r["key"], none)) for r in rows}
    assert len(found) == len(rows)
    return found


NODES = "video_id long, entity_id long, frame_idx long, trigger_rule string, action string, key string, n int, depth int, first string"


@pytest.mark.parametrize("shard,limit", [(1024, 1 << 18), (3, 1 << 18), (4, 5)])
def test_trie_against_brute_force(spark, monkeypatch, shard, limit):
    monkeypatch.setattr(action_trie, "SHARD", shard)
    monkeypatch.setattr(action_trie, "SHARD_ACTIONS", limit)
    rng, seqs, rows = random.Random(11), {}, []
    for e in range(40):
        n = rng.choice([0, 1, 2, 3, 4, 9])
        seqs[e] = [(rng.choice(["birth", ""]), rng.choice(["walks", "runs away fast", ""])) for _ in range(n)]
        if e % 3 == 0:
            seqs[e] = [("birth", "stands still"), ("heartbeat", "stands still"), ("change_point", "strikes a person")]
        rows += [(1, e, 10 * k, a or None, b or None, "k", 1, 2, "f") for k, (a, b) in enumerate(seqs[e])]
    rng.shuffle(rows)
    nodes = spark.createDataFrame(rows, NODES).repartition(4)
    entities = spark.createDataFrame([(e,) for e in seqs], "entity_id long")
    assert _trie(action_trie.marked(nodes), ("frame_idx",), entities) == _brute_trie(seqs)


def test_trie_edges(spark):
    rows = [(1, 5, None, "birth", "walks", "k", 1, 2, "f"), (1, 5, 3, None, None, "k", 1, 2, "f"), (1, 5, 3, None, None, "k", 1, 2, "f"), (1, None, 1, "x", "y", "k", 1, 2, "f"), (1, 7, 0, "birth", "walks", "k", 1, 2, "f"), (2, 8, 0, "birth", "word " * 50_000, "k", 1, 2, "f")]
    nodes = spark.createDataFrame(rows, NODES)
    seqs = {5: [("birth", "walks"), ("", ""), ("", "")], 7: [("birth", "walks")], 8: [("birth", "word " * 50_000)]}
    assert _trie(action_trie.marked(nodes), ("frame_idx",)) == _brute_trie(seqs)
    assert _trie(action_trie.marked(nodes.filter("false")), ("frame_idx",)) == {}
    one = nodes.filter("entity_id = 5")
    assert _trie(action_trie.marked(one), ("frame_idx",)) == _brute_trie({5: seqs[5]})


def test_rebuilt_conversations(spark, tmp_path):
    rng, rows = random.Random(2), []
    for c in [*range(0, 60), 101, 125, 147]:
        for k in range(rng.choice([1, 2, 3, 5])):
            rows.append((c, None if k == 0 else k, rng.choice(["user", None]), rng.choice(["hello there", "yes", None])))
    rows += [(None, 1, "user", "no conversation"), (3, 1, "user", "tie"), (3, 1, "user", "tie")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            mark = hashlib.sha256(f"{len(role or '')}:{role or ''}{text or ''}".encode()).digest()
            own[c].append((turn is not None, turn or 0, mark, (role or "", text or "")))
    own = {c: [x[-1] for x in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = own.get(c - c % 20, [])[:h] + own[c][h:]
    want = _brute_trie(seqs)
    got = queries.op13(spark, str(tmp_path)).collect()
    assert {(r["conv_id"], r["depth"]): (r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in got} == want
