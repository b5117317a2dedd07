"""Words of whole Arrow columns as numpy arrays: no Python object per text or word."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


def utf8(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the byte offsets of its rows; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if len(column) else np.zeros(1, np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def words(buf: np.ndarray, off: np.ndarray, blank: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end bytes of the runs of other bytes than ``blank`` (as given, the runs of
    ``[^\\x20\\x09-\\x0D]``) and, per row, the first word's number (one entry more than rows)."""
    ink = np.empty(len(buf) + 1, bool)
    np.logical_not(blank[buf], out=ink[:-1])
    ink[-1] = False
    first = ink.copy()
    first[1:] &= ~ink[:-1]
    inner = off[(off > 0) & (off < len(buf))]
    first[inner] = ink[inner]
    starts = np.flatnonzero(first[:-1])
    last = ink[:-1] & ~ink[1:]
    last[inner - 1] = ink[inner - 1]
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, off)


def hash_spans(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, read eight bytes at a time."""
    padded = np.zeros(len(buf) + 8, np.uint8)
    padded[: len(buf)] = buf
    eight = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    length = ends - starts
    h = mix(length.astype(U64) + U64(0x9E3779B97F4A7C15))
    at, todo, left = starts, None, length
    while len(at):
        piece = eight[at]
        short = left < 8
        piece[short] &= (U64(1) << (left[short].astype(U64) * U64(8))) - U64(1)
        if todo is None:
            h = mix(h ^ piece)
        else:
            h[todo] = mix(h[todo] ^ piece)
        more = left > 8
        todo = np.flatnonzero(more) if todo is None else todo[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def word_hashes(column, lower: bool = False, blank: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every word of a column and, per row, the first word's number."""
    buf, off = utf8(column)
    if lower:
        buf = LOWER[buf]
    starts, ends, row = words(buf, off, blank)
    return hash_spans(buf, starts, ends), row


def batches(table, limit: int = 1_000_000, column: int = 0):
    """Cut an Arrow batch into runs of rows of about ``limit`` text bytes, so that numpy's temporary
    arrays stay bounded whatever the number of long texts in a batch."""
    _, off = utf8(table.column(column))
    at = 0
    while at < table.num_rows:
        end = max(at + 1, int(np.searchsorted(off, off[at] + limit, "right")) - 1)
        yield table.slice(at, end - at)
        at = end
