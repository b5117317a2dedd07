"""Secrets in narratives and model answers: known shapes, and strings that pass for random.

Known shapes are assignments to a password-like name, access key ids and long hexadecimal runs. Any
other run of 16 or more key characters goes through a battery of three tests on its encoding, the smallest
alphabet that holds it: chi-squared uniformity of its characters, the number of runs of one character
class, and serial correlation of neighbours. Each statistic is judged twice. Against random strings of the
encoding it says whether the run can be random at all; against the writing of the corpus it says how
unlikely ordinary writing of that length would be to look so. The second chances are combined, counted over
all texts by length band, and a band's threshold controls the false discovery rate by the step-up rule, so
short strings need stronger evidence.

What ordinary writing is like (how often two of its letters agree, and how often neighbours change between
vowel and consonant) is counted over the whole corpus. Counts are a few hundred numbers whatever the input.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import lru_cache
from math import comb, erfc, exp, lgamma, log, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotrace.llm.arrow_text import batches, utf8

ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?(?-i:([A-Za-z0-9+/_.=-]+))""", re.IGNORECASE | re.ASCII)
ACCESS, HEX, RUN = re.compile(r"AKIA[A-Z0-9]+"), re.compile(r"[0-9a-f]{16,}"), re.compile(r"[A-Za-z0-9+/_=-]{16,}")
KINDS = ("assign", "access", "hex", "random")
LEAST_ASSIGN, LEAST_ACCESS = 12, 18
BANDS = (16, 20, 24, 32, 48, 64, 128)
_D, _L = "0123456789", "abcdefghijklmnopqrstuvwxyz"
#: Alphabets from narrow to wide, with the chance that two characters of ordinary writing in it agree.
ALPHABETS = tuple(
    (chars, {c: i for i, c in enumerate(chars)}, agree)
    for chars, agree in (
        (_D, 0.2), (_D + "abcdef", 0.15), (_D + "ABCDEF", 0.15), (_L, 0.07), (_L.upper(), 0.07), (_L.upper() + "234567", 0.07),
        (_D + _L, 0.07), (_D + _L.upper(), 0.07), (_D + _L.upper() + _L, 0.07), (_D + _L.upper() + _L + "+/=", 0.07), (_D + _L.upper() + _L + "-_=", 0.07), (_D + _L.upper() + _L + "+/=-_", 0.07),
    )
)
CLASS_CHANGE = 0.12
MAX_BIN = 60
VOWELS = frozenset("aeiouyAEIOUY")
LONGEST_KEPT = 256  # characters of a run whose chances are kept for its repetitions
_VOWEL = np.isin(np.arange(256), [ord(c) for c in "aeiouyAEIOUY"])
_LETTER = np.isin(np.arange(256), [ord(c) for c in _L + _L.upper()])


@dataclass(frozen=True)
class Writing:
    """Chance that two letters agree, and that neighbouring letters are a vowel and a consonant."""

    agree: float = 0.07
    turn: float = 0.6


def _count_letters(batches_in):
    """Letters by kind (26) and neighbouring letters: how many, and how many that turn."""
    total = np.zeros(28, np.int64)
    for batch in batches_in:
        for part in batches(batch):
            b, off = utf8(part.column(0))
            letter = _LETTER[b]
            total[:26] += np.bincount((b[letter] | 32) - 97, minlength=26)
            if len(b) > 1:
                pair = letter[1:] & letter[:-1]
                pair[off[(off > 0) & (off < len(b))] - 1] = False  # of two texts
                total[26:] += [pair.sum(), (pair & (_VOWEL[b[1:]] != _VOWEL[b[:-1]])).sum()]
    if total.any():
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(28, dtype=np.int32)), pa.array(total)], ["what", "n"])


def writing_of(texts: DataFrame) -> Writing:
    """What the letters of all texts are like; the usual values where there are none."""
    got = {r["what"]: r["n"] for r in texts.mapInArrow(_count_letters, "what int, n long").groupBy("what").agg(F.sum("n").alias("n")).collect()}
    letters, pairs = sum(got.get(i, 0) for i in range(26)), got.get(26, 0)
    usual = Writing()
    return Writing(min(usual.agree, sum((got[i] / letters) ** 2 for i in range(26) if i in got)) if letters else usual.agree, got[27] / pairs if pairs else usual.turn)


def _tail(z: float) -> float:
    return erfc(z / sqrt(2)) / 2


def _binomial_tail(k: int, n: int, p: float) -> float:
    """P(X >= k)."""
    if n > 400:
        return _tail((k - 0.5 - n * p) / sqrt(n * p * (1 - p)))
    return min(1.0, sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k, n + 1)))


def _fisher(*chances: float) -> float:
    """Combined chance of independent tests."""
    x, k = -sum(log(max(p, 1e-300)) for p in chances), len(chances)
    return min(1.0, sum(exp(i * log(x) - x - lgamma(i + 1)) if x > 0 else float(i == 0) for i in range(k)))


def _class(c: str) -> int:
    return 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3


def battery(run: str, writing: Writing = Writing()) -> tuple[float, float]:
    """Chance of a run this far from random if it is random, and of one this random if it is writing."""
    return _kept_battery(run, writing) if len(run) <= LONGEST_KEPT else _battery(run, writing)


def _battery(run: str, writing: Writing) -> tuple[float, float]:
    n = len(run)
    _, index, agree = next(a for a in ALPHABETS if all(c in a[1] for c in run))
    size = len(index)
    # chi-squared: a function of the number of pairs of equal characters
    pairs = sum(c * (c - 1) for c in Counter(run).values())
    chi = size * (pairs + n) / n - n
    uniform = _tail((chi - (size - 1)) / sqrt(2 * (size - 1) * (n - 1) / n))
    agree = min(agree, writing.agree) if agree < 0.1 else agree
    var = n * (n - 1) / 2 * agree * (1 - agree) + n * (n - 1) * (n - 2) * 0.4 * agree * agree
    evidence = [_tail((n * (n - 1) / 2 * agree - pairs / 2) / sqrt(var))]
    # runs: about the middle of the alphabet if random; of one character class in writing
    at = [index[c] - (size - 1) / 2 for c in run]
    high = sum(x > 0 for x in at)
    runs = 1 + sum((a > 0) != (b > 0) for a, b in zip(at, at[1:]))
    mean = 1 + 2 * high * (n - high) / n
    spread = sqrt(max((mean - 1) * (mean - 2) / (n - 1), 1e-9))
    steady = 2 * _tail(abs(runs - mean) / spread) if 0 < high < n else 2.0 ** (1 - n)
    if len({_class(c) for c in index}) > 1:
        changes = sum(_class(a) != _class(b) for a, b in zip(run, run[1:]))
        evidence.append(_binomial_tail(changes, n - 1, CLASS_CHANGE))
    # serial correlation: of places in the alphabet if random; of vowels and consonants in writing
    serial = sum(a * b for a, b in zip(at, at[1:])) / max(sum(a * a for a in at), 1e-9)
    independent = 2 * _tail(abs(serial) * sqrt(n))
    beside = [(a in VOWELS) != (b in VOWELS) for a, b in zip(run, run[1:]) if a.isalpha() and b.isalpha()]
    if beside:
        stay = len(beside) - sum(beside)
        evidence.append(_binomial_tail(stay, len(beside), 1 - writing.turn) if stay else 1.0)
    return min(1.0, 3 * min(uniform, steady, independent)), _fisher(*evidence)


_kept_battery = lru_cache(maxsize=50_000)(_battery)


def band(n: int) -> int:
    return sum(n >= b for b in BANDS) - 1


def _bin(chance: float) -> int:
    return min(MAX_BIN, int(-4 * log(max(chance, 1e-300)) / log(10)))


def _known(text: str, runs: list) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the known shapes. Keys and hexadecimal runs lie inside ``runs``."""
    found = []
    if "=" in text or ":" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= LEAST_ASSIGN]
    for r in runs:
        at = r.start()
        found += [(at + m.start(), 1, at + m.end()) for m in ACCESS.finditer(r[0]) if m.end() - m.start() >= LEAST_ACCESS]
        found += [(at + m.start(), 2, at + m.end()) for m in HEX.finditer(r[0])]
    return found


def _others(runs: list, known: list[tuple[int, int, int]]) -> list:
    return [r for r in runs if not any(r.start() < e and s < r.end() for s, _, e in known)]


def spans_of(text: str | None, thresholds: dict[int, int], writing: Writing = Writing()) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` in code points, in order."""
    if not text:
        return []
    runs = list(RUN.finditer(text))
    known = _known(text, runs)
    for r in _others(runs, known):
        random, written = battery(r[0], writing)
        if random >= 0.001 and _bin(written) >= thresholds.get(band(len(r[0])), MAX_BIN + 1):
            known.append((r.start(), 3, r.end()))
    return sorted(known)


def _count_chances(writing: Writing):
    def count(batches_in):
        seen: Counter = Counter()
        for batch in batches_in:
            for t in batch.column(0):
                if text := t.as_py():
                    if runs := list(RUN.finditer(text)):
                        seen.update((band(len(r[0])), _bin(battery(r[0], writing)[1])) for r in _others(runs, _known(text, runs)))
        if seen:
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in seen], pa.int32()), pa.array([k[1] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["band", "bin", "n"]
            )

    return count


def chance_thresholds(texts: DataFrame, rate: float = 0.01, writing: Writing = Writing()) -> dict[int, int]:
    """Per length band the least evidence bin that keeps the false discovery rate: the step-up rule on
    counts, where a bin stands for the largest chance in it. Bands times bins bound what returns."""
    counts = texts.mapInArrow(_count_chances(writing), "band int, bin int, n long").groupBy("band", "bin").agg(F.sum("n").alias("n")).collect()
    out = {}
    for b in {r["band"] for r in counts}:
        have = {r["bin"]: r["n"] for r in counts if r["band"] == b}
        total = sum(have.values())
        passed = [k for k in have if 10 ** (-k / 4) * total <= rate * sum(n for j, n in have.items() if j >= k)]
        if passed:
            out[b] = min(passed)
    return out


def _spans(thresholds: dict[int, int], writing: Writing):
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def spans(batches):
        for batch in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans_of(t.as_py(), thresholds, writing)] for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, kind)], [*batch.schema.names[:-1], "spans"])

    return spans


def secret_spans(narratives: DataFrame, id_col: str = "video_id", text_col: str = "narrative", rate: float = 0.01) -> DataFrame:
    """Per narrative ``video_id, spans``: kind, start and end (exclusive, in code points) of each secret.

    Spans come by start, then kind as in ``KINDS``. A null or empty text has none; repeated rows are
    each answered; an empty table gives an empty result; other columns are not read.
    """
    d = narratives.select(F.col(id_col).alias("video_id"), F.col(text_col).alias("narrative"))
    writing = writing_of(d.select("narrative"))
    limits = chance_thresholds(d.select("narrative"), rate, writing)
    return d.mapInArrow(_spans(limits, writing), f"video_id {d.schema['video_id'].dataType.simpleString()}, spans array<struct<kind string, start long, end long>>")


def _mask(thresholds: dict[int, int], writing: Writing, at: int, sign: str):
    def mask(batches):
        for batch in batches:
            out = []
            for t in batch.column(at):
                text = t.as_py()
                end, parts = 0, []
                for s, _, e in spans_of(text, thresholds, writing):
                    if s >= end:
                        parts += [text[end:s], sign]
                    end = max(end, e)
                out.append("".join([*parts, text[end:]]) if parts else text)
            yield batch.set_column(at, batch.schema.names[at], pa.array(out, pa.string()))

    return mask


def masked(narratives: DataFrame, text_col: str = "narrative", rate: float = 0.01, sign: str = "[SECRET]") -> DataFrame:
    """The input with every secret of the text column replaced by ``sign``; all rows and columns stay."""
    writing = writing_of(narratives.select(text_col))
    limits = chance_thresholds(narratives.select(text_col), rate, writing)
    return narratives.mapInArrow(_mask(limits, writing, narratives.columns.index(text_col), sign), narratives.schema)
