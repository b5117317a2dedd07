"""Improbable-feature digests of narratives and their comparison.

Every window of 64 bytes has an entropy; how many windows of the whole corpus share it says how rare
it is. Among 64 neighbouring windows the rarest, leftmost one scores a point, and windows with enough
points are a text's features. Features are hashed into Bloom filters of 256 bytes; a filter that holds
160 features is followed by another. Two digests are compared by the bits their filters share, less
what chance would give. Entropies are sums of integers, so a text has the same digest wherever it is.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from chronotrace.llm.arrow_text import batches, mix, utf8
from chronotrace.operators.ordered import Lane, neighbours
from chronotrace.session import cut

WINDOW, LEVELS, LEAST_POINTS = 64, 1000, 16
FILTER_BYTES, FILTER_FEATURES, BITS_PER_FEATURE = 256, 160, 5
LEAST_LEVEL = 100  # windows this even (long runs of one byte) are never features
CHUNK_IDS = 256
MOST_SENT_HEADS = 1_000_000  # three numbers each
_UNIT = 1 << 20
_SUM = np.array([0] + [round(c * np.log2(c) * _UNIT) for c in range(1, WINDOW + 1)], np.int64)
_GAIN = np.diff(_SUM, prepend=0)
_TOP = WINDOW * 6 * _UNIT
U64 = np.uint64


def window_levels(buf: np.ndarray) -> np.ndarray:
    """Entropy of every 64-byte window, scaled to 0..1000 (as 16-bit numbers).

    A window differs from the one before by a byte that leaves and one that enters; what each changes
    depends on how often that byte occurs in the 64 places after or before it. Sorted by byte, those
    places are neighbours.
    """
    n = len(buf)
    if n < WINDOW:
        return np.zeros(0, np.uint16)
    order = np.argsort(buf, kind="stable")
    key = buf[order].astype(np.int64) * (n + 2 * WINDOW) + order
    k = np.arange(n)
    behind, ahead = np.empty(n, np.int64), np.empty(n, np.int64)
    behind[order] = _GAIN[k - np.searchsorted(key, key - (WINDOW - 1)) + 1]
    ahead[order] = _GAIN[np.searchsorted(key, key + (WINDOW - 1), "right") - k]
    s = np.empty(n - WINDOW + 1, np.int64)
    s[0] = _SUM[np.bincount(buf[:WINDOW], minlength=256)].sum()
    np.cumsum(behind[WINDOW:] - ahead[: n - WINDOW], out=s[1:])
    s[1:] += s[0]
    return ((_TOP - s) * LEVELS // _TOP).astype(np.uint16)


def _features(rank: np.ndarray) -> np.ndarray:
    """Places of the features: windows that are the rarest of at least 16 of the 64-window stretches."""
    n = len(rank)
    if n < WINDOW:
        best = np.flatnonzero(rank == rank.min())[:1] if n else np.zeros(0, np.int64)
        return best[rank[best] < LEVELS + 1]
    full = -(-n // WINDOW) * WINDOW
    key = np.full(full, np.iinfo(np.int64).max)
    key[:n] = (rank.astype(np.int64) << 40) + np.arange(n)
    rows = key.reshape(-1, WINDOW)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    least = np.minimum(right[: n - WINDOW + 1], left[WINDOW - 1 : n])
    points = np.bincount(least & ((1 << 40) - 1))
    at = np.flatnonzero(points >= min(LEAST_POINTS, n - WINDOW + 1))
    return at[rank[at] < LEVELS + 1]


def digest(buf: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Filters (rows of 256 bytes) of a text from its bytes and the rarity rank of its windows.

    A text shorter than a window is one feature; an empty one has none.
    """
    n = len(buf)
    if n < WINDOW:
        at, data = np.zeros(1 if n else 0, np.int64), np.zeros(2 * WINDOW, np.uint8)
        data[:n] = buf
    else:
        at, data = _features(rank), buf
    eight = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))
    h = np.full(len(at), U64(min(n, WINDOW)))
    for i in range(0, WINDOW, 8):
        h = mix(h ^ eight[at + i])
    _, first = np.unique(h, return_index=True)
    h = h[np.sort(first)]
    filters = np.zeros((-(-len(h) // FILTER_FEATURES), FILTER_BYTES * 8), np.uint8)
    row = np.arange(len(h)) // FILTER_FEATURES
    for i in range(BITS_PER_FEATURE):
        filters[row, (h >> U64(11 * i)) & U64(2047)] = 1
    return np.packbits(filters, axis=1)


def to_text(filters: np.ndarray) -> str:
    return base64.b64encode(filters.tobytes()).decode()


def from_text(digest_text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(digest_text), np.uint8).reshape(-1, FILTER_BYTES)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1: for each filter of the shorter chain its best match in the other, averaged. A match is
    the share of common bits beyond those expected by chance. Two empty digests are alike."""
    if len(a) == 0 or len(b) == 0:
        return float(len(a) == len(b))
    if len(a) > len(b):
        a, b = b, a
    na, nb = np.bitwise_count(a).sum(1, dtype=np.int64), np.bitwise_count(b).sum(1, dtype=np.int64)
    total = 0.0
    for x, n in zip(a, na):
        common = np.bitwise_count(x & b).sum(1, dtype=np.int64)
        most, chance = np.minimum(n, nb), n * nb / (8 * FILTER_BYTES)
        score = np.where(common == most, 1.0, (common - chance) / np.maximum(most - chance, 1e-9))
        total += float(np.clip(score, 0.0, 1.0).max())
    return total / len(a)


def _level_counts(batches_in):
    seen = np.zeros(LEVELS + 1, np.int64)
    for batch in batches_in:
        for part in batches(batch, 1_000_000):
            buf, off = utf8(part.column(0))
            level = window_levels(buf)
            inside = np.ones(len(level), bool)
            for end in off[1:-1]:  # windows that reach into the next text
                inside[max(0, end - WINDOW + 1) : end] = False
            seen += np.bincount(level[inside], minlength=LEVELS + 1)
    at = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(seen[at])], ["level", "n"])


def rarity_ranks(texts: DataFrame) -> np.ndarray:
    """Rank of each entropy level, rarest first, from the windows of all texts; the counts are at most
    1,001 rows. Levels below ``LEAST_LEVEL`` come last and are never features."""
    seen = np.zeros(LEVELS + 1, np.int64)
    for r in texts.mapInArrow(_level_counts, "level long, n long").groupBy("level").agg(F.sum("n").alias("n")).collect():
        seen[r["level"]] = r["n"]
    rank = np.empty(LEVELS + 1, np.uint16)
    rank[np.argsort(seen, kind="stable")] = np.arange(LEVELS + 1)
    rank[:LEAST_LEVEL] = LEVELS + 1
    return rank


def _bytes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


def _mixed_rank(own: np.ndarray, own_rank: np.ndarray, other: np.ndarray, other_rank: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Window ranks of ``own + other`` (prefixes of texts whose ranks are known): only the windows
    across the seam are new."""
    side = WINDOW - 1
    seam = ranks[window_levels(np.concatenate([own[-side:] if len(own) else own, other[:side]]))]
    return np.concatenate([own_rank[: max(0, len(own) - side)], seam, other_rank[: max(0, len(other) - side)]])


class _Text:
    __slots__ = ("filters", "raw", "rank", "text")

    def __init__(self, text: str, raw: np.ndarray, rank: np.ndarray):
        self.text, self.raw, self.rank = text, raw, rank
        self.filters = digest(raw, rank)


def _compare(ranks: np.ndarray, id_type):
    """Rows come by chunk and descending id, each chunk closed by a copy of the text that follows it."""

    def rows(batches_in):
        for batch in batches_in:
            for part in batches(batch, 1_000_000, batch.num_columns - 1):
                buf, off = utf8(part.column(part.num_columns - 1))
                rank = ranks[window_levels(buf)]
                ids, copies, chunks = part.column("video_id"), part.column("is_copy").to_pylist(), part.column("chunk").to_pylist()
                for i, text in enumerate(part.column(part.num_columns - 1).to_pylist()):
                    a, b = int(off[i]), int(off[i + 1])
                    yield chunks[i], copies[i], ids[i], _Text(text, buf[a:b], rank[a : max(a, b - WINDOW + 1)])

    def compare(batches_in):
        out, last = [], None
        for chunk, copy, id_, this in rows(batches_in):
            if last and last[0] == chunk and not last[1]:
                out.append(_answer(last[2], last[3], this, ranks))
            last = (chunk, copy, id_, this)
            if len(out) >= 2000:
                yield _table(out, id_type)
                out = []
        yield _table(out, id_type)

    return compare


def _answer(id_, own: _Text, after: _Text, ranks: np.ndarray):
    n = len(own.text)
    k = n // 3
    head, tail = own.text[: n - k], after.text[:k]
    edited = head + tail
    a, b = own.raw[: len(head.encode())], after.raw[: len(tail.encode())]
    filters = digest(np.concatenate([a, b]), _mixed_rank(a, own.rank, b, after.rank, ranks))
    return id_, n, hashlib.sha256(edited.encode()).hexdigest(), to_text(own.filters), to_text(filters), likeness(own.filters, filters), likeness(own.filters, after.filters)


NAMES = ("video_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")


def _table(rows: list, id_type) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(NAMES)
    ids = pa.array([x.as_py() for x in cols[0]], id_type)
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
    return pa.RecordBatch.from_arrays([ids, *[pa.array(c, t) for c, t in zip(cols[1:], kinds)]], list(NAMES))


def fingerprints(narratives: DataFrame, id_col: str = "video_id", text_col: str = "narrative", chunk_ids: int = CHUNK_IDS) -> DataFrame:
    """Per narrative: ``video_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited,
    near_next``.

    The edited text swaps the last third of the code points for as many from the next narrative, by
    descending id (after the last comes the first). Ids are whole numbers; equal ids follow each other
    by text. A null text is empty; a null id comes last; repeated rows are answered each; an empty table
    gives an empty result; other columns are not read.

    Ids are cut into chunks, and the first text of each chunk is copied to the end of the chunk before,
    so texts move once and each task reads its chunks as a stream.
    """
    d = narratives.select(F.col(id_col).alias("video_id"), F.coalesce(F.col(text_col), F.lit("")).alias("narrative"))
    ranks = rarity_ranks(d.select("narrative"))
    lowest = F.lit(-(1 << 53))
    d = d.withColumn("chunk", F.coalesce(F.floor(F.col("video_id") / chunk_ids).cast("long"), lowest))
    heads = d.groupBy("chunk").agg(F.max("video_id").alias("head"))
    ends = heads.agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
    heads = neighbours(heads, Lane((), ("chunk",), 4096), following={"above": F.col("chunk")})
    heads = heads.select(F.col("chunk").alias("_chunk"), "head", F.coalesce("above", ends.select("lo").scalar()).alias("above"))
    heads = cut(heads)
    small = heads.count() <= MOST_SENT_HEADS  # else both sides are shuffled by chunk
    j = d.join(F.broadcast(heads) if small else heads, d["chunk"] == F.col("_chunk"))
    is_head = F.col("video_id").eqNullSafe(F.col("head"))
    own = F.struct(F.col("chunk"), F.lit(0).alias("is_copy"))
    moved = F.struct(F.col("above").alias("chunk"), F.lit(1).alias("is_copy"))
    j = j.select("video_id", "narrative", F.explode(F.when(is_head, F.array(own, moved)).otherwise(F.array(own))).alias("x"))
    j = j.select(F.col("x.chunk").alias("chunk"), F.col("x.is_copy").alias("is_copy"), "video_id", "narrative")
    j = j.repartition("chunk").sortWithinPartitions("chunk", "is_copy", F.col("video_id").desc_nulls_last(), "narrative")
    kind = d.schema["video_id"].dataType
    schema = f"video_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return j.mapInArrow(_compare(ranks, to_arrow_type(kind)), schema)
