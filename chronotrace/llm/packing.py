"""Pack narratives into fixed-length token sequences by best-two-fit.

Only the number of pieces of each length matters to the packing, and there are no more lengths than
the sequence has tokens. So pieces are counted by length, the plan is made for the counts, and each
piece finds its place by its rank among the pieces of its length: the packing is that of all pieces
together, yet no task sees more than its share of them.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronotrace.llm.tokens import default_path, encoder
from chronotrace.session import cut

SLICE_ROWS = 4096
END_ID = 2
PIECES = "video_id {id}, piece int, start long, length long, ids_crc32 long"


def two_fit_plan(counts: dict[int, int], size: int) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how many sequences use each, largest piece first.

    A sequence takes the longest piece left, then again the longest that fits. If a gap stays, its
    smallest piece is traded for the two unpacked pieces that fill the widened gap best, provided they
    hold more tokens than it. The choice stays the same until a length of the pattern runs out, so it
    is made once for all sequences alike.
    """
    left = np.zeros(size + 1, np.int64)
    for n, c in counts.items():
        left[n] = c
    plan = []
    for top in range(size, 0, -1):
        while left[top] > 0:
            pattern, gap = [top], size - top
            free = left.copy()
            free[top] -= 1
            while gap > 0:
                fits = np.flatnonzero(free[1 : gap + 1])
                if not len(fits):
                    break
                n = int(fits[-1]) + 1
                again = min(int(free[n]), gap // n)
                pattern += [n] * again
                free[n] -= again
                gap -= n * again
            if gap > 0 and len(pattern) > 1:
                small = pattern[-1]
                free[small] += 1
                pair = _best_pair(free, gap + small)
                if pair and sum(pair) > small:
                    pattern[-1:] = pair
            used = {n: pattern.count(n) for n in set(pattern)}
            times = min(int(left[n]) // k for n, k in used.items())
            for n, k in used.items():
                left[n] -= times * k
            plan.append((pattern, times))
    return plan


def _best_pair(free: np.ndarray, room: int) -> list[int] | None:
    """The two lengths available whose sum comes nearest to ``room`` from below."""
    have = np.flatnonzero(free[1:room]) + 1 if room > 1 else np.zeros(0, np.int64)
    if not len(have):
        return None
    at = np.searchsorted(have, room - have, "right") - 1
    other = np.where(at >= 0, have[np.maximum(at, 0)], 0)
    # a length that occurs once cannot be both; the next smaller one takes its place
    twice = (other == have) & (free[have] < 2)
    other = np.where(twice, np.where(at >= 1, have[np.maximum(at - 1, 0)], 0), other)
    total = np.where(other > 0, have + other, 0)
    best = int(np.argmax(total))
    return sorted((int(have[best]), int(other[best])), reverse=True) if total[best] else None


def _encode(path: str, size: int, end_id: int, id_type):
    tail = np.array([end_id], "<u4").tobytes()

    def pieces(batches):
        for batch in batches:
            enc = encoder(path)
            row, piece, start, length, crc = [], [], [], [], []
            for i, text in enumerate(batch.column(1)):
                ids = enc.ids(text.as_py()) + tail
                n = len(ids) // 4
                cuts = [0, *range(n % size or size, n, size), n] if n > size else [0, n]
                for k in range(len(cuts) - 1):
                    row.append(i)
                    piece.append(k)
                    start.append(cuts[k])
                    length.append(cuts[k + 1] - cuts[k])
                    crc.append(zlib.crc32(ids[4 * cuts[k] : 4 * cuts[k + 1]]))
            out = [batch.column(0).take(pa.array(row, pa.int64())), pa.array(piece, pa.int32()), *[pa.array(x, pa.int64()) for x in (start, length, crc)]]
            yield pa.RecordBatch.from_arrays(out, ["video_id", "piece", "start", "length", "ids_crc32"])

    return pieces


def token_pieces(
    narratives: DataFrame, id_col: str = "video_id", text_col: str = "narrative", size: int = 1024, tokenizer_path: str | None = None, end_id: int = END_ID
) -> DataFrame:
    """``video_id, piece, start, length, ids_crc32`` of the token pieces of each narrative.

    A narrative is its ids and ``end_id``; only longer ones are cut, and then the first piece is the
    remainder and the others are full.
    """
    d = narratives.select(F.col(id_col).alias("video_id"), F.col(text_col).alias("narrative"))
    kind = d.schema["video_id"].dataType
    return d.mapInArrow(_encode(tokenizer_path or default_path(), size, end_id, kind), PIECES.format(id=kind.simpleString()))


def _place(starts: np.ndarray, first: np.ndarray, sequence: np.ndarray, offset: np.ndarray, scale: int):
    """Sequence and offset of a piece from its length and rank: the plan's stretch it falls into."""

    def place(batches):
        for batch in batches:
            length, rank = (np.asarray(batch.column(n), np.int64) for n in ("length", "rank"))
            at = np.searchsorted(starts, length * scale + rank, "right") - 1
            cols = [batch.column(n) for n in ("video_id", "piece", "start", "length", "ids_crc32")]
            out = [*cols, pa.array(sequence[at] + rank - first[at]), pa.array(offset[at])]
            yield pa.RecordBatch.from_arrays(out, ["video_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return place


def pack_narratives(
    narratives: DataFrame, id_col: str = "video_id", text_col: str = "narrative", size: int = 1024, tokenizer_path: str | None = None, end_id: int = END_ID
) -> DataFrame:
    """Per piece: ``video_id, piece, start, length, ids_crc32, sequence_id, offset``.

    A null text is an empty one: a piece with the end id alone. Repeated rows are packed each. An
    empty table gives an empty result. Other columns are not read.
    """
    pieces = cut(token_pieces(narratives, id_col, text_col, size, tokenizer_path, end_id))
    kind = pieces.schema["video_id"].dataType.simpleString()
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``size`` rows
    scale = max(counts.values(), default=0) + 1
    stretches, done, sequence = [], dict.fromkeys(counts, 0), 0
    for pattern, times in two_fit_plan(counts, size):
        at = 0
        for n in pattern:
            stretches.append((n * scale + done[n], done[n], sequence, at))
            done[n] += times
            at += n
        sequence += times
    starts, first, seq, offset = (np.array(x, np.int64) for x in zip(*sorted(stretches))) if stretches else (np.zeros(0, np.int64),) * 4
    slices = F.element_at(F.create_map(*[F.lit(x) for n, c in counts.items() for x in (n, -(-c // SLICE_ROWS))]), F.col("length")) if counts else F.lit(1)
    key = F.xxhash64("video_id", "piece", "ids_crc32")
    ranked = pieces.withColumn("k", key).withColumn("slice", F.pmod(F.shiftright("k", 20), slices.cast("long")))
    local = ranked.withColumn("i", F.row_number().over(W.partitionBy("length", "slice").orderBy("k", "video_id", "piece", "ids_crc32")).cast("long") - 1)
    sums = ranked.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    sums = sums.select("length", "slice", F.coalesce(F.sum("n").over(W.partitionBy("length").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    local = local.join(sums, ["length", "slice"]).withColumn("rank", F.col("base") + F.col("i"))
    local = local.select("video_id", "piece", "start", "length", "ids_crc32", "rank")
    return local.mapInArrow(_place(starts, first, seq, offset, scale), PIECES.format(id=kind) + ", sequence_id long, offset long")
