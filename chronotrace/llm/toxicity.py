"""Toxicity of narratives by a counterfactual-regularised linear classifier.

The classifier is a logistic regression on the presence of words and of word beginnings of three
lengths, which catch the inflected and compound forms of a word. For every labelled narrative that
mentions a group, twins are made in which each group term is swapped for another of its kind; the
squared change of the score between a narrative and its twins is part of the loss. A word for a group
that happens to be frequent in toxic narratives then gains no weight from it, and neutral mentions
score like any other text.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotrace.llm.arrow_text import LOWER, U64, batches, hash_spans, mix, utf8, words

SAMPLE_ROWS = 15_000
LEAST_ROWS = 5
SCREEN_SDS, ENTRY_SDS = 2.5, 4.0
BEGINNINGS = (5, 7, 9)  # bytes
SWAP_PENALTY = 5.0
ROUNDS = 300
#: Terms of one kind stand for each other in a twin.
GROUPS = (
    ("women", "men", "girls", "boys", "mothers", "fathers"),
    ("woman", "man", "girl", "boy", "mother", "father"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist", "catholic"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists", "catholics"),
    ("black", "white", "asian", "latino", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender", "queer"),
    ("immigrant", "refugee", "foreigner", "native", "citizen"),
    ("immigrants", "refugees", "foreigners", "natives", "citizens"),
    ("old", "young", "elderly", "teenage"),
    ("disabled", "blind", "deaf", "autistic"),
)
#: Letters and digits make words; bytes beyond ASCII count as letters.
BLANK = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def features(column) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of the words and word beginnings of a text column, and the row of each."""
    buf, off = utf8(column)
    buf = LOWER[buf]
    starts, ends, row = words(buf, off, BLANK)
    of = np.repeat(np.arange(len(off) - 1, dtype=np.int64), np.diff(row))
    hashes, rows = [hash_spans(buf, starts, ends)], [of]
    for n in BEGINNINGS:
        longer = np.flatnonzero(ends - starts > n)
        hashes.append(mix(hash_spans(buf, starts[longer], starts[longer] + n) + U64(n)))
        rows.append(of[longer])
    return (np.concatenate(hashes) >> U64(32)).astype(np.uint32), np.concatenate(rows)


def hash_words(terms: list[str]) -> np.ndarray:
    """Hashes of single whole words."""
    return features(pa.array(terms, pa.string()))[0][: len(terms)] if terms else np.zeros(0, np.uint32)


def distinct_features(column) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each row in row order, those that occur twice or more also as another one."""
    h, row = features(column)
    pair, n = np.unique((row << 32) + h, return_counts=True)
    often = pair[n > 1]
    again = (often & ~0xFFFFFFFF) + (((often & 0xFFFFFFFF) * 0x9E3779B1 + 1) & 0xFFFFFFFF)
    pair = np.unique(np.concatenate([pair, again]))
    return (pair & 0xFFFFFFFF).astype(np.uint32), pair >> 32


def _packed_features(batches_in):
    """Sorted distinct features of each narrative, packed."""
    for batch in batches_in:
        for part in batches(batch, column=1):
            h, row = distinct_features(part.column(1))
            cuts = np.searchsorted(row, np.arange(part.num_rows + 1))
            packed = [h[a:b].astype("<u4").tobytes() for a, b in zip(cuts, cuts[1:])]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(packed, pa.binary())], ["label", "features"])


@dataclass
class ToxicityModel:
    hashes: np.ndarray  # sorted
    weights: np.ndarray
    bias: float

    def scores(self, column) -> np.ndarray:
        """Score of every text of an Arrow column."""
        total = np.full(len(column), self.bias)
        if len(self.hashes):
            h, row = distinct_features(column)
            hit, at = _lookup(self.hashes, h)
            total += np.bincount(row[hit], self.weights[at], len(total))
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def _lookup(known: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which hashes are known, and their places; a coarse map of leading bits rules out most first."""
    seen = np.zeros(1 << 16, bool)
    seen[known >> 16] = True
    maybe = np.flatnonzero(seen[h >> 16])
    at = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
    sure = known[at] == h[maybe]
    return maybe[sure], at[sure]


class _Rows:
    """Sparse rows of features, with a value per entry."""

    def __init__(self, rows: np.ndarray, cols: np.ndarray, values: np.ndarray, shape: tuple[int, int]):
        self.rows, self.cols, self.values, self.shape = rows, cols, values, shape

    def times(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.rows, self.values * w[self.cols], self.shape[0])

    def back(self, r: np.ndarray) -> np.ndarray:
        return np.bincount(self.cols, self.values * r[self.rows], self.shape[1])

    def bound(self, row_weight: np.ndarray | float = 0.0) -> np.ndarray:
        """Diagonal that bounds the squared matrix: each entry times its row's absolute sum."""
        size = np.abs(self.values)
        total = np.bincount(self.rows, size, self.shape[0]) + row_weight
        return np.bincount(self.cols, size * total[self.rows], self.shape[1])


def group_features(groups) -> dict[int, np.ndarray]:
    """All features of each group term, by the hash of the whole word."""
    return {int(hash_words([term])[0]): features(pa.array([term], pa.string()))[0] for g in groups for term in g}


def swap_rows(texts: list[np.ndarray], vocabulary: np.ndarray, groups, twins: int = 2) -> _Rows:
    """One row per twin: the features, of words and of their beginnings, that it gains (+1) and loses
    (-1). ``texts`` hold sorted distinct hashes. Which term stands in depends on the text alone."""
    of_term = group_features(groups)
    kin = [np.sort(hash_words(list(g))) for g in groups]
    rows, cols, values, n = [], [], [], 0
    every = np.concatenate(kin) if kin else np.zeros(0, np.uint32)
    for found in texts:
        if not len(found) or not np.isin(every, found).any():
            continue
        for t in range(twins):
            change: dict[int, float] = {}
            for g in kin:
                for term in g[np.isin(g, found)]:
                    others = g[g != term]
                    swap = others[int(mix(np.array([found[0] ^ term ^ t], U64))[0] % U64(len(others)))]
                    for x, by in [*((f, -1.0) for f in of_term[int(term)]), *((f, 1.0) for f in of_term[int(swap)])]:
                        at = int(np.searchsorted(vocabulary, x))
                        if at < len(vocabulary) and vocabulary[at] == x:
                            change[at] = change.get(at, 0.0) + by
            rows += [n] * len(change)
            cols += list(change)
            values += list(change.values())
            n += 1
    return _Rows(np.array(rows, np.int64), np.array(cols, np.int64), np.array(values, float), (n, len(vocabulary)))


def fit(texts: list[np.ndarray], labels: np.ndarray, groups=GROUPS, swap_penalty: float = SWAP_PENALTY) -> ToxicityModel:
    """Model from sorted distinct features and labels 0 or 1.

    Features whose own tie to the label is below ``SCREEN_SDS`` deviations are left out at once. One
    enters when its tie given the others stands out by ``ENTRY_SDS`` deviations (an L1 penalty in that
    unit); those that entered are then weighed again with a light L2 penalty.
    """
    n = len(texts)
    rate = (labels.sum() + 1) / (n + 2)
    bias = float(np.log(rate / (1 - rate)))
    every = np.concatenate(texts) if n else np.zeros(0, np.uint32)
    if not len(every) or labels.min() == labels.max():
        return ToxicityModel(np.zeros(0, np.uint32), np.zeros(0), bias)
    rows = np.repeat(np.arange(n, dtype=np.int32), [len(t) for t in texts])
    vocabulary, df = np.unique(every, return_counts=True)
    of_toxic = np.zeros(len(vocabulary))
    hit, counts = np.unique(every[labels[rows] > 0], return_counts=True)
    of_toxic[np.searchsorted(vocabulary, hit)] = counts
    groups_too = np.isin(vocabulary, np.concatenate(list(group_features(groups).values())) if groups else vocabulary[:0])
    tie = np.abs(of_toxic - df * rate) >= SCREEN_SDS * np.sqrt(df * rate * (1 - rate))
    keep = (df >= LEAST_ROWS) & (tie | groups_too)
    vocabulary, df = vocabulary[keep], df[keep]
    if not len(vocabulary):
        return ToxicityModel(vocabulary, np.zeros(0), bias)
    used, cols = _lookup(vocabulary, every)
    x = _Rows(rows[used], cols, np.ones(len(used)), (n, len(vocabulary)))
    twin = swap_rows(texts, vocabulary, groups)
    lasso = ENTRY_SDS * np.sqrt(df * rate * (1 - rate)) / n
    w, b = _descend(x, labels, twin, swap_penalty, lasso, np.zeros(x.shape[1]), bias, 0.0)
    support = np.flatnonzero(w)
    if len(support):
        w, b = _descend(x, labels, twin, swap_penalty, np.where(w != 0, 0.0, np.inf), w, b, 1e-4)
    return ToxicityModel(vocabulary[support], w[support], b)


def _descend(x: _Rows, y: np.ndarray, twin: _Rows, swap_penalty: float, lasso: np.ndarray, w: np.ndarray, b: float, ridge: float) -> tuple[np.ndarray, float]:
    """Accelerated proximal gradient with a step per weight, so that rare words learn as fast as
    frequent ones; an infinite ``lasso`` keeps a weight at zero."""
    n, m = x.shape[0], max(1, twin.shape[0])
    twins = twin.shape[0] > 0
    live = np.isfinite(lasso)
    if not live.all():
        sub = live[x.cols]
        x = _Rows(x.rows[sub], x.cols[sub], x.values[sub], x.shape)
    step = 1 / np.maximum(x.bound(1.0) / (4 * n) + (2 * swap_penalty / m * twin.bound() if twins else 0) + ridge, 1e-9)
    step_b = 4 * n / (n + x.values.sum())
    limit = np.where(live, lasso, 0.0) * step
    vw, vb, pace = w.copy(), b, 1.0
    for _ in range(ROUNDS):
        r = 1 / (1 + np.exp(-np.clip(x.times(vw) + vb, -30, 30))) - y
        grad = x.back(r) / n + ridge * vw
        if twins:
            grad += 2 * swap_penalty / m * twin.back(twin.times(vw))
        new = vw - step * grad
        new = np.where(live, np.sign(new) * np.maximum(np.abs(new) - limit, 0), 0.0)
        nb = vb - step_b * r.mean()
        nxt = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        vw, vb = new + (pace - 1) / nxt * (new - w), nb + (pace - 1) / nxt * (nb - b)
        w, b, pace = new, nb, nxt
    return w, float(b)


def fit_toxicity_model(
    narratives: DataFrame, labels: DataFrame, id_col: str = "video_id", text_col: str = "narrative", label_col: str = "toxic",
    groups=GROUPS, swap_penalty: float = SWAP_PENALTY, sample_rows: int = SAMPLE_ROWS,
) -> ToxicityModel:
    """Model from at most ``sample_rows`` labels, those with the smallest hash of the id, and the whole
    texts of their narratives. Labels other than 0 and 1 and ids without a narrative are passed over."""
    chosen = labels.filter(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("label"))
    chosen = chosen.orderBy(F.xxhash64("_id"), "label").limit(sample_rows)
    d = narratives.select(F.col(id_col).alias("_key"), F.coalesce(F.col(text_col), F.lit("")).alias("narrative"))
    got = d.join(F.broadcast(chosen), F.col("_key") == F.col("_id")).select("label", "narrative").mapInArrow(_packed_features, "label int, features binary").toArrow()
    texts = [np.frombuffer(b.as_py(), "<u4") for b in got["features"]]
    order = sorted(range(len(texts)), key=lambda i: texts[i].tobytes())  # the same model whatever the order of rows
    return fit([texts[i] for i in order], got["label"].to_numpy().astype(float)[order], groups, swap_penalty)


def _score(model: ToxicityModel):
    def score(batches_in):
        for batch in batches_in:
            for part in batches(batch):
                s = model.scores(part.column(0))
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(s)], [*part.schema.names[1:], "score"])

    return score


def score_toxicity(narratives: DataFrame, model: ToxicityModel, text_col: str = "narrative", keep: tuple[str, ...] = ("video_id",)) -> DataFrame:
    """The columns ``keep`` and ``score`` of every narrative.

    A null or empty text scores the bias, as any text without a known word. Repeated rows score alike;
    an empty table gives an empty result; columns not in ``keep`` are not read.
    """
    if "score" in keep:
        raise ValueError("a column to keep is named score")
    d = narratives.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *keep)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in d.schema.fields[1:])
    return d.mapInArrow(_score(model), fields + "score double")
