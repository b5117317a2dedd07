"""Pack narratives into token sequences as they come, with a fixed number of open windows.

Each task keeps at most ``windows`` sequences open. A piece goes into the open window it fills best; if it
fits none, a new window is opened, and when all are open the fullest one is emitted: the piece gives it
the tokens it lacks, and what is left of the piece is placed anew. So a task holds a fixed number of
tokens however much it reads, and what it emits is full.

Windows still open at the end of a task are leftovers. They are packed again in the same way, those of
``MERGED`` tasks in one, until one task is left; its own leftovers are joined end to end, cut into full
sequences, and the rest into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotrace.llm.arrow_text import batches
from chronotrace.llm.ngram_join import stored
from chronotrace.llm.tokens import default_path, encoder

END_ID = 0
WINDOWS = 64
MERGED = 64  # tasks whose leftovers are packed together
FLUSH = 4096
TASK_BITS, COUNT_BITS = 24, 34  # of a sequence number; the round has the bits above
PACKED = "video_id {id}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
NAMES = ["video_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


class Windows:
    """Open windows of one task. A piece is (video_id, doc_tokens, start, ids as bytes)."""

    def __init__(self, size: int, limit: int, first_number: int):
        self.size, self.limit, self.number = size, limit, first_number
        self.gaps: list[tuple[int, int]] = []  # (gap, number) of the open windows, smallest gap first
        self.open: dict[int, list] = {}
        self.rows: list[tuple] = []

    def _emit(self, number: int) -> None:
        at = 0
        for video, total, start, ids in self.open.pop(number):
            n = len(ids) // 4
            self.rows.append((video, start, n, zlib.crc32(ids), total, number, at))
            at += n

    def _put(self, number: int, gap: int, piece: tuple) -> None:
        self.open[number].append(piece)
        gap -= len(piece[3]) // 4
        if gap:
            insort(self.gaps, (gap, number))
        else:
            self._emit(number)

    def place(self, video, total: int, start: int, ids: bytes) -> None:
        ids = memoryview(ids)  # cutting long narratives copies only what is placed
        while len(ids):
            n = len(ids) // 4
            if n < self.size and (k := bisect_left(self.gaps, (n, -1))) < len(self.gaps):
                gap, number = self.gaps.pop(k)
                return self._put(number, gap, (video, total, start, bytes(ids)))
            if n >= self.size or len(self.gaps) < self.limit:  # a full piece is a sequence of its own
                gap, number = self.size, self.number
                self.number += 1
                self.open[number] = []
            else:
                gap, number = self.gaps.pop(0)
            head, ids = ids[: 4 * gap], ids[4 * gap :]
            self._put(number, gap, (video, total, start, bytes(head)))
            start += gap

    def close(self) -> None:
        """Join what is open end to end: full sequences, then powers of two."""
        pieces = [p for _, number in self.gaps for p in self.open[number]]
        self.gaps, self.open = [], {}
        left = sum(len(p[3]) // 4 for p in pieces)
        room, number = 0, 0
        for video, total, start, ids in pieces:
            while ids:
                if not room:
                    room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
                    left -= room
                    number, self.number = self.number, self.number + 1
                    self.open[number] = []
                head, ids = ids[: 4 * room], ids[4 * room :]
                self.open[number].append((video, total, start, head))
                start += len(head) // 4
                room -= len(head) // 4
        for number in list(self.open):
            self._emit(number)

    def take(self, kind) -> list[pa.Array]:
        rows, self.rows = self.rows, []
        cols = list(zip(*rows)) if rows else [()] * 7
        return [pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:]]]

    def leftovers(self, kind) -> list[pa.Array]:
        """Pieces of open windows as rows: ``sequence_id`` is the window, ``offset`` the place of the piece."""
        flat = [(v, s, len(i) // 4, None, t, number, k, i) for number in sorted(self.open) for k, (v, t, s, i) in enumerate(self.open[number])]
        cols = list(zip(*flat)) if flat else [()] * 8
        return [pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:7]], pa.array(cols[7], pa.binary())]


def _first_number(turn: int, task: int) -> int:
    return ((turn << TASK_BITS) | task) << COUNT_BITS


def _batch(cols: list, ids, task: int | None):
    n = len(cols[0])
    return pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.binary()) if ids is None else ids, pa.array([task] * n, pa.int64())], [*NAMES, "ids", "task"])


def _pack(path: str, size: int, limit: int, end_id: int):
    tail = np.array([end_id], "<u4").tobytes()

    def pack(batches_in):
        task = TaskContext.get().partitionId()
        w, kind = Windows(size, limit, _first_number(0, task)), None
        for batch in batches_in:
            kind = batch.schema.field(0).type
            enc = encoder(path)
            for part in batches(batch, column=1):
                for video, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    ids = enc.ids(text) + tail
                    w.place(video, len(ids) // 4, 0, ids)
                    if len(w.rows) >= FLUSH:
                        yield _batch(w.take(kind), None, None)
        if kind is not None:
            yield _batch(w.take(kind), None, None)
            *cols, ids = w.leftovers(kind)
            yield _batch(cols, ids, task)

    return pack


def _merge(size: int, limit: int, turn: int, last: bool):
    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by([("task", "ascending"), ("sequence_id", "ascending"), ("offset", "ascending")])
        task = table["task"][0].as_py() // MERGED
        w, kind = Windows(size, limit, _first_number(turn, task)), table.schema.field("video_id").type
        for row in zip(*(table[n].to_pylist() for n in ("video_id", "doc_tokens", "start", "ids"))):
            w.place(*row)
        if last:
            w.close()
        out = [_batch(w.take(kind), None, None)]
        if not last:
            *cols, ids = w.leftovers(kind)
            out.append(_batch(cols, ids, task))
        return pa.Table.from_batches(out)

    return merge


def pack_open_windows(
    narratives: DataFrame,
    id_col: str = "video_id",
    text_col: str = "narrative",
    size: int = 1024,
    windows: int = WINDOWS,
    tokenizer_path: str | None = None,
    end_id: int = END_ID,
) -> DataFrame:
    """Per piece: ``video_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.

    A narrative is its ids and ``end_id``; ``start`` counts its ids before the piece, ``offset`` the tokens
    of the sequence before it. A narrative that fits an open window, or finds room for a new one, stays
    whole; else it is cut where the fullest window ends. All sequences have ``size`` tokens, but for a last
    few of lengths that are powers of two. A null or empty text is a piece with the end id alone; repeated
    rows are packed each; an empty table gives an empty result; other columns are not read.

    A task holds ``windows`` sequences, a merging task ``MERGED`` times as many; texts are encoded once and
    results stored in the shared folder, so sequence numbers stay as they are when executors are lost.
    """
    d = narratives.select(F.col(id_col).alias("video_id"), F.col(text_col).alias("narrative"))
    kind = d.schema["video_id"].dataType.simpleString()
    fields = PACKED.format(id=kind) + ", ids binary, task long"
    packed = stored(d.mapInArrow(_pack(tokenizer_path or default_path(), size, windows, end_id), fields))
    done, turn = [packed.filter("ids is null")], 0
    left = packed.filter("ids is not null")
    while True:
        tasks = left.agg(F.max("task").alias("t")).first()["t"]
        if tasks is None:
            break
        turn += 1
        last = tasks < MERGED
        merged = left.groupBy(F.floor(F.col("task") / MERGED).alias("lot")).applyInArrow(_merge(size, windows, turn, last), fields)
        merged = stored(merged)
        done.append(merged.filter("ids is null"))
        if last:
            break
        left = merged.filter("ids is not null")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.drop("ids", "task")
