"""Tokens of one narrative under two tokenizers, aligned byte by byte with sparse matrices.

Tokenizer A is a byte-level BPE file, tokenizer B a piece model with byte fallback. Rows of the token-byte
incidence matrices are tokens, columns the bytes of a space and the text. Their product A.B' has an entry,
the number of common bytes, for each pair of tokens that overlap; entries of tokens that end on the same
byte cut the text into groups. Rows of the group incidence matrices are tokens, columns groups, and their
product links each A token with every B token of its group. All matrices are kept as row pointers and
column numbers, and products are taken row by row: the rows of the right matrix that a row of the left one
names are added up.

Two tokens that end on the same byte are a text and a suffix of it, so the pairs of ids that can ever be
linked follow from the vocabularies: no more than the bytes of all their entries together. Counts are kept
by the number of the pair in that list, whatever the size of the corpus.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotrace.llm.arrow_text import batches
from chronotrace.llm.ngram_join import stored
from chronotrace.llm.tokens import default_path, encoder

MEMO_WORDS = 200_000
ROW_BYTES = 1 << 20  # bytes of text whose rows of the product are made at a time


def default_piece_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceEncoder(dict):
    """Ids of a piece model as bytes of little-endian unsigned 32-bit ids; keeps those of words it has met.

    A piece has blanks only before its other characters, so a text without double blanks is encoded word
    by word; the model puts the blank before each word itself. What the pieces do not spell back has no ids.
    """

    def __init__(self, path: str):
        super().__init__()
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.pieces = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.by_word = not any("▁" in p.lstrip("▁") for p in pieces)

    def _splits(self, text: str) -> bool:
        return self.by_word and text[0] != " " and text[-1] != " " and "  " not in text

    def _faithful(self, text: str, ids: list[int]) -> bytes | None:
        return np.array(ids, "<u4").tobytes() if b"".join(map(self.pieces.__getitem__, ids)) == b" " + text.encode() else None

    def learn(self, texts: list[str | None]) -> None:
        """Encode the words of ``texts`` that are new, all at once."""
        if len(self) > MEMO_WORDS:
            self.clear()
        new = list({w for t in texts if t and self._splits(t) for w in t.split(" ")}.difference(self))
        found = self.model.encode(new, num_threads=1)
        flat, want = list(chain.from_iterable(found)), [b" " + w.encode() for w in new]
        raw, at = np.array(flat, "<u4").tobytes(), _starts(np.array([4 * len(ids) for ids in found], np.int64)).tolist()
        spelled = np.array([len(p) for p in self.pieces], np.int64)[flat] if flat else np.zeros(0, np.int64)
        lengths = np.diff(_starts(spelled)[[k // 4 for k in at]])
        # all words at once; one by one only where some word is not spelled back
        if (lengths == [len(w) for w in want]).all() and b"".join(map(self.pieces.__getitem__, flat)) == b"".join(want):
            self.update((w, raw[i:j]) for w, i, j in zip(new, at, at[1:]))
        else:
            self.update((w, self._faithful(w, ids)) for w, ids in zip(new, found))

    def ids(self, text: str) -> bytes | None:
        """Ids of a text whose words are learned; None where they do not spell it."""
        if not self._splits(text):
            return self._faithful(text, self.model.encode(text))
        parts = list(map(self.__getitem__, text.split(" ")))
        return None if None in parts else b"".join(parts)


def _starts(lengths: np.ndarray) -> np.ndarray:
    out = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    return out


class Vocabulary:
    """Lengths of the entries in bytes, and ids as text."""

    def __init__(self, entries: list[bytes]):
        self.entries = entries
        self.lengths = np.array([len(e) for e in entries], np.int64)
        digits = [str(i).encode() for i in range(len(entries))]
        self.width = max(map(len, digits), default=1) + 1
        self.digits = np.array([len(d) for d in digits], np.int64)
        self.text = np.frombuffer(b"".join(d.ljust(self.width, b"\0") for d in digits), np.uint8).reshape(-1, self.width)


class Pair:
    """Two vocabularies and the pairs of ids that can be linked, sorted.

    The shorter entry of a pair is as long a suffix of the longer one as it has bytes, so a pair is found
    by the longer entry and that length; where two entries have the same bytes, by search.
    """

    def __init__(self, a: list[bytes], b: list[bytes]):
        self.a, self.b, self.pairs = Vocabulary(a), Vocabulary(b), linkable(a, b)
        of_a, of_b = np.divmod(self.pairs, max(1, len(b)))
        n_a, n_b = self.a.lengths[of_a], self.b.lengths[of_b]
        self.at = [_starts(v.lengths + 1) for v in (self.a, self.b)]
        self.found = [np.zeros(x[-1] + 1, np.int64) for x in self.at]
        numbers = np.arange(len(self.pairs))
        for at, found, ids, short, mine in ((self.at[0], self.found[0], of_a, n_b, n_b <= n_a), (self.at[1], self.found[1], of_b, n_a, n_a < n_b)):
            found[at[ids[mine]] + short[mine]] = numbers[mine]

    def number(self, a_ids: np.ndarray, b_ids: np.ndarray) -> np.ndarray:
        n_a, n_b = self.a.lengths[a_ids], self.b.lengths[b_ids]
        a_longer = n_b <= n_a
        out = np.empty(len(a_ids), np.int64)
        out[a_longer] = self.found[0][self.at[0][a_ids[a_longer]] + n_b[a_longer]]
        out[~a_longer] = self.found[1][self.at[1][b_ids[~a_longer]] + n_a[~a_longer]]
        key = a_ids.astype(np.int64) * len(self.b.entries) + b_ids
        other = np.flatnonzero(self.pairs[out] != key) if len(out) else out
        out[other] = np.searchsorted(self.pairs, key[other])
        return out


def linkable(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """``a_id * len(b) + b_id`` of all pairs where one entry's bytes end with those of the other."""
    of_a: dict[bytes, list[int]] = {}
    of_b: dict[bytes, list[int]] = {}
    for known, entries in ((of_a, a), (of_b, b)):
        for i, e in enumerate(entries):
            known.setdefault(e, []).append(i)
    out = {i * len(b) + j for i, e in enumerate(a) for k in range(len(e)) for j in of_b.get(e[k:], ())}
    out |= {i * len(b) + j for j, e in enumerate(b) for k in range(len(e)) for i in of_a.get(e[k:], ())}
    return np.array(sorted(out), np.int64)


@lru_cache(maxsize=1)
def tokenizers(byte_path: str, piece_path: str) -> tuple:
    """Both encoders and what follows from their vocabularies; one per worker process."""
    a, b = encoder(byte_path), PieceEncoder(piece_path)
    return a, b, Pair(a.entries(), b.pieces)


def product(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], columns: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row pointers, columns and values of the product of two matrices of zeros and ones.

    Row i is the sum of those rows of the right matrix whose numbers are the columns of row i of the left.
    """
    ptr, mid = left
    r_ptr, r_col = right
    size = r_ptr[mid + 1] - r_ptr[mid]
    begin = _starts(size)
    col = r_col[np.arange(begin[-1]) + np.repeat(r_ptr[mid] - begin[:-1], size)]
    row = np.repeat(np.repeat(np.arange(len(ptr) - 1), np.diff(ptr)), size)
    key = row * columns + col
    if len(key) and (key[1:] < key[:-1]).any():
        key = np.sort(key)
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    row, col = np.divmod(key[first], columns) if len(key) else (first, first)
    return np.searchsorted(row, np.arange(len(ptr))), col, np.diff(np.append(first, len(key)))


def row_sizes(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Entries of each row of a product whose left rows have one column each, without making it."""
    ptr, mid = left
    return (right[0][mid + 1] - right[0][mid])[: len(ptr) - 1]


def overlaps(a_len: np.ndarray, b_len: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A token, B token and number of common bytes of all tokens that overlap, in order. The product of the
    incidence matrices is made for rows of about ``ROW_BYTES`` columns at a time."""
    a_at, b_at = _starts(a_len), _starts(b_len)
    rows, cols, vals, i = [], [], [], 0
    while i < len(a_len):
        k = max(i + 1, int(np.searchsorted(a_at, a_at[i] + ROW_BYTES, "right")) - 1)
        lo, hi = a_at[i], a_at[k]
        j, m = int(np.searchsorted(b_at, lo, "right")) - 1, int(np.searchsorted(b_at, hi, "left"))
        inside = np.diff(np.clip(b_at[j : m + 1], lo, hi))  # bytes of these rows in each B token
        byte_rows = (a_at[i : k + 1] - lo, np.arange(hi - lo))
        token_of_byte = (np.arange(hi - lo + 1), np.repeat(np.arange(m - j), inside))
        ptr, col, n = product(byte_rows, token_of_byte, max(1, m - j))
        rows.append(np.repeat(np.arange(i, k), np.diff(ptr)))
        cols.append(col + j)
        vals.append(n)
        i = k
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (rows, cols, vals))


@dataclass
class Aligned:
    """Alignment of texts laid end to end: ids, tokens before each text, links and groups.

    ``link_a`` and ``link_b`` number the tokens that end together; group g has the A tokens after
    ``link_a[g - 1]`` up to ``link_a[g]`` and the B tokens likewise.
    """

    a: np.ndarray
    b: np.ndarray
    a_row: np.ndarray
    b_row: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray

    @classmethod
    def of(cls, pair: Pair, a: np.ndarray, b: np.ndarray, a_row: np.ndarray, b_row: np.ndarray) -> Aligned:
        a_len, b_len = pair.a.lengths[a], pair.b.lengths[b]
        row, col, _ = overlaps(a_len, b_len)
        together = _starts(a_len)[row + 1] == _starts(b_len)[col + 1]
        return cls(a, b, a_row, b_row, row[together], col[together])

    def groups(self) -> tuple[np.ndarray, np.ndarray]:
        """First A and B token of each group, and the number of tokens at the end."""
        return np.concatenate([[0], self.link_a + 1]), np.concatenate([[0], self.link_b + 1])

    def group_incidence(self) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """A tokens by groups, and groups by B tokens."""
        a_at, b_at = self.groups()
        of_a = np.repeat(np.arange(len(a_at) - 1), np.diff(a_at))
        return (np.arange(len(self.a) + 1), of_a), (b_at, np.arange(len(self.b)))

    def shared(self) -> np.ndarray:
        """Number of B tokens in the group of each A token: the row sizes of the group product."""
        return row_sizes(*self.group_incidence())

    def group_row(self) -> np.ndarray:
        """Groups before each text."""
        return np.searchsorted(self.link_a, self.a_row - 1, "right")


def _encode(a, b, pair: Pair, texts: list[str | None]):
    """Ids of both tokenizers as bytes; both empty unless each spells out a space and the text. Byte-level
    ids always do; should one have no bytes (a special token), the lengths tell."""
    b.learn(texts)
    out_a, out_b = [], []
    for t in texts:
        y = b.ids(t) if t else None
        out_a.append(b"" if y is None else a.plain_ids(" " + t))
        out_b.append(y or b"")
    n = [np.diff(_starts(v.lengths[np.frombuffer(b"".join(o), "<u4")])[_row(o, 4)]) for v, o in ((pair.a, out_a), (pair.b, out_b))]
    for i in np.flatnonzero(n[0] != n[1]):
        out_a[i] = out_b[i] = b""
    return out_a, out_b


def _row(parts: list[bytes], size: int) -> np.ndarray:
    return _starts(np.array([len(p) // size for p in parts], np.int64))


def _tokens(byte_path: str, piece_path: str):
    """Ids of every text and, at the end of a task, how often it links each pair."""

    def tokens(batches_in):
        counts, names, id_type = None, ["kind", "video_id", "a", "b", "ends_a", "ends_b", "pair", "n"], None
        for batch in batches_in:
            for part in batches(batch, column=1):
                a, b, pair = tokenizers(byte_path, piece_path)
                if counts is None:
                    counts, id_type = np.zeros(len(pair.pairs), np.int64), part.schema.field(0).type
                x, y = _encode(a, b, pair, part.column(1).to_pylist())
                al = Aligned.of(pair, np.frombuffer(b"".join(x), "<u4"), np.frombuffer(b"".join(y), "<u4"), _row(x, 4), _row(y, 4))
                counts += np.bincount(pair.number(al.a[al.link_a], al.b[al.link_b]), minlength=len(counts))
                kind_a, kind_b = _narrow(pair)
                n = part.num_rows
                ids = [pa.array([np.frombuffer(p, "<u4").astype(k).tobytes() for p in o], pa.binary()) for o, k in ((x, kind_a), (y, kind_b))]
                ends = [_flags(link, row) for link, row in ((al.link_a, al.a_row), (al.link_b, al.b_row))]
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(n, np.int32)), part.column(0), *ids, *ends, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64())], names)
        if counts is not None:
            some = np.flatnonzero(counts)
            n = len(some)
            yield pa.RecordBatch.from_arrays([pa.array(np.ones(n, np.int32)), pa.nulls(n, id_type), *[pa.nulls(n, pa.binary())] * 4, pa.array(some.astype(np.int32)), pa.array(counts[some])], names)

    return tokens


def _flags(link: np.ndarray, row: np.ndarray) -> pa.Array:
    """For each text a bit per token: whether it ends a group."""
    flag = np.zeros(row[-1], bool)
    flag[link] = True
    return pa.array([np.packbits(flag[s:e]).tobytes() for s, e in zip(row, row[1:])], pa.binary())


def _flagged(column, row: np.ndarray) -> np.ndarray:
    bits = np.unpackbits(np.frombuffer(b"".join(column.to_pylist()), np.uint8))
    n = np.diff(row)
    bytes_before = _starts(-(-n // 8))[:-1]
    return np.flatnonzero(bits[np.arange(n.sum()) + np.repeat(8 * bytes_before - row[:-1], n)])


def _narrow(pair: Pair) -> tuple[str, str]:
    return tuple("<u2" if len(v.entries) <= 1 << 16 else "<u4" for v in (pair.a, pair.b))


def _stretches(batch, limit: int = 600_000):
    """Cut a batch of stored ids into runs of rows of about ``limit`` bytes of A."""
    size = _starts(np.array([len(x) for x in batch.column("a").to_pylist()], np.int64))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(size, size[at] + limit, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end


def _aligned_batch(pair: Pair, part) -> Aligned:
    kinds = _narrow(pair)
    x, y = (part.column(n).to_pylist() for n in ("a", "b"))
    a, b = (np.frombuffer(b"".join(o), k).astype(np.int64) for o, k in ((x, kinds[0]), (y, kinds[1])))
    a_row, b_row = _row(x, int(kinds[0][-1])), _row(y, int(kinds[1][-1]))
    return Aligned(a, b, a_row, b_row, _flagged(part.column("ends_a"), a_row), _flagged(part.column("ends_b"), b_row))


def group_texts(pair: Pair, al: Aligned) -> list[str]:
    """``a1,a2|b1;a3|b2,b3`` of each text: ids of its groups in order."""
    (a_at, b_at), n_a, n_b = al.groups(), len(al.a), len(al.b)
    (_, of_a), _ = al.group_incidence()
    of_b = np.repeat(np.arange(len(b_at) - 1), np.diff(b_at))
    place_a, place_b = np.arange(n_a) + b_at[of_a], np.arange(n_b) + a_at[of_b + 1]
    width = max(pair.a.width, pair.b.width)
    text = np.zeros((n_a + n_b, width), np.uint8)
    used = np.zeros(n_a + n_b, np.int64)
    for v, ids, place, last, mark in ((pair.a, al.a, place_a, al.link_a, b"|"), (pair.b, al.b, place_b, al.link_b, b";")):
        text[place, : v.width] = v.text[ids]
        used[place] = v.digits[ids] + 1
        sign = np.full(len(ids), ord(","), np.uint8)
        sign[last] = ord(mark)
        text[place, v.digits[ids]] = sign
    flat = text[text != 0].tobytes()
    ends = _starts(used)[al.a_row + al.b_row]
    return [flat[s : max(s, e - 1)].decode() for s, e in zip(ends, ends[1:])]


def _summaries(byte_path: str, piece_path: str, counts: np.ndarray, best: np.ndarray):
    def summaries(batches_in):
        for batch in batches_in:
            for part in _stretches(batch):
                pair = tokenizers(byte_path, piece_path)[2]
                al = _aligned_batch(pair, part)
                number = pair.number(al.a[al.link_a], al.b[al.link_b])
                groups = al.group_row()
                of_links = lambda x: np.diff(_starts(x)[groups])  # noqa: E731, B023
                cols = [np.diff(al.a_row), np.diff(al.b_row), np.diff(groups), np.diff(groups), of_links(best[number]), of_links(counts[number]), np.diff(_starts(al.shared())[al.a_row])]
                out = [part.column("video_id"), *[pa.array(np.asarray(c, np.int64)) for c in cols], pa.array(group_texts(pair, al), pa.string())]
                yield pa.RecordBatch.from_arrays(out, ["video_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "n_shared", "groups"])

    return summaries


def _paths(byte_path: str | None, piece_path: str | None) -> tuple[str, str]:
    return byte_path or default_path(), piece_path or default_piece_path()


def token_alignment(
    narratives: DataFrame, id_col: str = "video_id", text_col: str = "narrative", byte_path: str | None = None, piece_path: str | None = None
) -> DataFrame:
    """Per narrative: ``video_id, n_a, n_b, n_groups, n_links, n_best, count_sum, n_shared, groups``.

    A and B encode a space and the text without special tokens; strings of special tokens are plain text.
    ``groups`` are the ids between bytes on which tokens of both end, as ``a1,a2|b1;a3|b2,b3``; ``n_links``
    the pairs of tokens that end together; ``count_sum`` adds up, over these links, how many links of the
    whole table their id pair has, and ``n_best`` are those whose pair has the highest such number of its B
    id, ties included. ``n_shared`` is the number of pairs of tokens in one group. A null or empty text,
    or one that either tokenizer does not spell back byte by byte, has zeros and an empty ``groups``.
    Repeated rows count each time; an empty table gives an empty result; other columns are not read.

    Texts are encoded and aligned once: ids, in two bytes each, and which tokens end a group are stored in
    the shared folder. Counts by id pair
    are no more than the bytes of the two vocabularies, and only they reach the driver.
    """
    byte_path, piece_path = _paths(byte_path, piece_path)
    d = narratives.select(F.col(id_col).alias("video_id"), F.col(text_col).alias("narrative"))
    kind = d.schema["video_id"].dataType.simpleString()
    rows = stored(d.mapInArrow(_tokens(byte_path, piece_path), f"kind int, video_id {kind}, a binary, b binary, ends_a binary, ends_b binary, pair int, n long"), "zstd")
    pair = tokenizers(byte_path, piece_path)[2]
    got = rows.filter("kind = 1").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(pair.pairs), np.int64)
    counts[got["pair"].to_numpy()] = got["n"].to_numpy()
    b_of = pair.pairs % max(1, len(pair.b.entries))
    highest = np.zeros(len(pair.b.entries), np.int64)
    np.maximum.at(highest, b_of, counts)
    best = (counts > 0) & (counts == highest[b_of])
    fields = f"video_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, n_shared long, groups string"
    return rows.filter("kind = 0").select("video_id", "a", "b", "ends_a", "ends_b").mapInArrow(_summaries(byte_path, piece_path, counts, best), fields)


def _links(byte_path: str, piece_path: str, kind: str):
    def links(batches_in):
        for batch in batches_in:
            for part in batches(batch, column=1):
                a, b, pair = tokenizers(byte_path, piece_path)
                x, y = _encode(a, b, pair, part.column(1).to_pylist())
                al = Aligned.of(pair, np.frombuffer(b"".join(x), "<u4"), np.frombuffer(b"".join(y), "<u4"), _row(x, 4), _row(y, 4))
                if kind == "overlap":
                    row, col, n = overlaps(pair.a.lengths[al.a], pair.b.lengths[al.b])
                    text = np.searchsorted(al.a_row, row, "right") - 1
                    values = [row - al.a_row[text], col - al.b_row[text], n]
                else:
                    row = np.arange(len(al.a))
                    text = np.searchsorted(al.a_row, row, "right") - 1
                    (_, group), (b_at, _) = al.group_incidence()
                    values = [row - al.a_row[text], b_at[group] - al.b_row[text], b_at[group + 1] - 1 - al.b_row[text]]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(text)), *[pa.array(v.astype(np.int64)) for v in values]], ["video_id", "x", "y", "z"])

    return links


def token_links(
    narratives: DataFrame, kind: str = "overlap", id_col: str = "video_id", text_col: str = "narrative", byte_path: str | None = None, piece_path: str | None = None
) -> DataFrame:
    """The entries of one of the products, by token positions from 0.

    ``overlap``: ``video_id, a_pos, b_pos, n_bytes`` of each pair of tokens with common bytes. ``group``:
    ``video_id, a_pos, b_from, b_to``, one row per A token; the B tokens of its group stand next to each
    other, so a row of that product is a range. Texts without tokens have no rows.
    """
    names = {"overlap": ("a_pos", "b_pos", "n_bytes"), "group": ("a_pos", "b_from", "b_to")}[kind]
    d = narratives.select(F.col(id_col).alias("video_id"), F.col(text_col).alias("narrative"))
    id_kind = d.schema["video_id"].dataType.simpleString()
    found = d.mapInArrow(_links(*_paths(byte_path, piece_path), kind), f"video_id {id_kind}, x long, y long, z long")
    return found.toDF("video_id", *names)
