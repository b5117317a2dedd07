"""Language of narratives by interpolated Kneser-Ney character models.

Letters are lower-cased and every run of other characters becomes one space. Four-character counts per
language come from all labelled narratives that may be learned from; continuation counts of shorter
contexts follow from them. The model is a table per order: sorted hashes of the character groups of
all languages together, beside them one log probability per language, and for contexts the log weight
of backing off. How the cross-entropies of a tenth of the labelled narratives spread, by length, under
a model of the other nine sets when a narrative is rejected as none of the languages; a language that
tenth cannot judge has the loosest of the other bounds. Then the tenth is learned from as well.

Every count enters the model, however rare: the tables grow with the number of different groups of
four characters, not with the rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotrace.llm.arrow_text import U64, batches, mix
from chronotrace.session import cut

ORDER = 4
REJECT_SDS = 8.0
FULL_TRUST = 200  # letters after which more text makes a prediction no surer
UNKNOWN = "und"
SPACE = 32
TEXT_BYTES = 1 << 18  # of text at a time in numpy


def _letters() -> np.ndarray:
    """Lower-case letter of each 16-bit code point, space for what is no letter."""
    out = np.full(1 << 16, SPACE, np.uint16)
    for c in range(1 << 16):
        ch = chr(c)
        if ch.isalpha():
            low = ch.lower()
            out[c] = ord(low) if len(low) == 1 and ord(low) < 1 << 16 else c
    return out


_LETTER: list[np.ndarray] = []


def letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single spaces of all texts, end to end, and where each text begins (one more)."""
    if not _LETTER:
        _LETTER.append(_letters())
    joined = np.frombuffer("\n".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    wide = joined >= 1 << 16
    c = _LETTER[0][np.where(wide, SPACE, joined)]
    if wide.any():  # letters beyond 16 bits share one code
        c[np.flatnonzero(wide)[[chr(x).isalpha() for x in joined[wide]]]] = 0xFFFF
    ends = np.cumsum([len(t or "") + 1 for t in texts])
    keep = c != SPACE
    keep[1:] |= c[:-1] != SPACE  # one space after a letter
    keep[ends[:-1] - 1] = False  # not the one between texts
    at = np.concatenate([[0], np.cumsum(keep)])
    return c[keep], at[np.concatenate([[0], np.minimum(ends, len(c))])] if len(texts) else np.zeros(1, np.int64)


def grams(c: np.ndarray, starts: np.ndarray, order: int = ORDER) -> np.ndarray:
    """Every character with those before it, 16 bits each; before a text stand spaces."""
    place = np.arange(len(c)) - np.repeat(starts[:-1], np.diff(starts))
    out = c.astype(U64)
    for k in range(1, order):
        back = np.full(len(c), SPACE, np.uint16)
        back[k:] = c[:-k]
        back[place < k] = SPACE
        out |= back.astype(U64) << U64(16 * k)
    return out


@dataclass
class Table:
    """Sorted hashes with a coarse index by their leading bits; rows of values beside them."""

    hashes: np.ndarray
    first: np.ndarray
    shift: int
    longest: int
    values: np.ndarray

    @classmethod
    def build(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        h = mix(keys)
        order = np.argsort(h)
        h = h[order]
        bits = max(4, int(len(h)).bit_length() + 1)
        first = np.append(np.searchsorted(h, np.arange(1 << bits, dtype=U64) << U64(64 - bits)), len(h))
        return cls(np.append(h, U64(0)), first.astype(np.int32), 64 - bits, int(np.diff(first).max(initial=0)), np.vstack([values[order], np.zeros((1, values.shape[1]), values.dtype)]))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, or the number of rows where it is not there."""
        h = mix(keys)
        at = self.first[h >> U64(self.shift)]
        row = np.full(len(h), len(self.hashes) - 1, np.int32)
        hit = self.hashes[at] == h
        row[hit] = at[hit]
        todo = np.flatnonzero(~hit)
        for k in range(1, self.longest):
            if not len(todo):
                break
            a = np.minimum(at[todo] + k, len(self.hashes) - 1)
            hit = self.hashes[a] == h[todo]
            row[todo[hit]] = a[hit]
            todo = todo[~hit]
        return row


@dataclass
class Model:
    langs: list[str]
    chances: list[Table]  # by order, from 1
    backs: list[Table]  # log weight of backing off, by length of context, from 1
    unseen: np.ndarray  # log probability of a character never seen, by language
    center: np.ndarray | None = None
    spread: np.ndarray | None = None  # variance of long texts, and per letter of short ones

    def log_chances(self, g: np.ndarray, order: int | None = None) -> np.ndarray:
        order = order or len(self.chances)
        t = self.chances[order - 1]
        row = t.find(g)
        out = t.values[row]
        missed = np.flatnonzero(row == len(t.hashes) - 1)
        if len(missed):
            rest = g[missed]
            if order == 1:
                out[missed] = self.unseen
            else:
                b = self.backs[order - 2]
                shorter = rest & ((U64(1) << U64(16 * (order - 1))) - U64(1))
                out[missed] = b.values[b.find(rest >> U64(16))] + self.log_chances(shorter, order - 1)
        return out

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Nats per character under each language (rows: texts), and characters per text."""
        c, starts = letters(texts)
        n = np.diff(starts)
        out = np.zeros((len(texts), len(self.langs)))
        full = np.flatnonzero(n)
        if len(full):
            out[full] = -np.add.reduceat(self.log_chances(grams(c, starts, len(self.chances))).astype(np.float64), starts[:-1][full], axis=0) / n[full, None]
        return out, n


def _discount(counts: np.ndarray) -> float:
    once, twice = int((counts == 1).sum()), int((counts == 2).sum())
    return once / (once + 2 * twice) if once and twice else 0.5


def kneser_ney(lang: np.ndarray, gram: np.ndarray, n: np.ndarray, langs: list[str], order: int = ORDER) -> Model:
    """Model from the counts of the longest groups, by language number."""
    per = []
    for k in range(len(langs)):
        mine = np.flatnonzero(lang == k)
        mine = mine[np.argsort(gram[mine])]
        levels, g, c = [], gram[mine], n[mine].astype(np.float64)
        for o in range(order, 0, -1):
            levels.append((g, c))
            if o > 1:  # continuation: how many different characters precede the shorter group
                g, c = np.unique(g & ((U64(1) << U64(16 * (o - 1))) - U64(1)), return_counts=True)
                c = c.astype(np.float64)
        per.append(levels[::-1])
    alphabet = 2 + max((len(p[0][0]) for p in per), default=0)
    chances, backs = [], []
    unseen = np.zeros(len(langs))
    below: list[tuple[np.ndarray, np.ndarray]] = []  # per language: sorted groups and their probability, one order down
    for o in range(1, order + 1):
        all_g = np.unique(np.concatenate([p[o - 1][0] for p in per])) if per else np.zeros(0, U64)
        all_c = np.unique(all_g >> U64(16)) if o > 1 else np.zeros(0, U64)
        logp, logb = np.zeros((len(all_g), len(langs)), np.float32), np.zeros((len(all_c), len(langs)), np.float32)
        now = []
        for k, p in enumerate(per):
            g, c = p[o - 1]
            d = _discount(c)
            if o == 1:
                total = c.sum()
                rest = d * len(c) / total if total else 1.0
                base = rest / alphabet
                prob = np.full(len(all_g), base)
                prob[np.searchsorted(all_g, g)] += np.maximum(c - d, 0) / total if total else 0
                unseen[k] = np.log(base)
            else:
                ctx = g >> U64(16)
                heads, first = np.unique(ctx, return_index=True)
                total, types = np.add.reduceat(c, first) if len(c) else c, np.diff(np.append(first, len(c)))
                back = d * types / total if len(c) else c
                weight = np.ones(len(all_c))
                weight[np.searchsorted(all_c, heads)] = back
                logb[:, k] = np.log(weight)
                prob = weight[np.searchsorted(all_c, all_g >> U64(16))] * _below(below[k], all_g & ((U64(1) << U64(16 * (o - 1))) - U64(1)))
                prob[np.searchsorted(all_g, g)] += np.maximum(c - d, 0) / total[np.searchsorted(heads, ctx)] if len(c) else 0
            logp[:, k] = np.log(prob)
            now.append((all_g, prob))
        below = now
        chances.append(Table.build(all_g, logp))
        if o > 1:
            backs.append(Table.build(all_c, logb))
    return Model(langs, chances, backs, unseen.astype(np.float32))


def _below(known: tuple[np.ndarray, np.ndarray], g: np.ndarray) -> np.ndarray:
    """Probability of groups one order down; the tails of seen groups are always seen."""
    return known[1][np.searchsorted(known[0], g)]


def _count_grams(langs: list[str], order: int):
    number = {x: i for i, x in enumerate(langs)}

    def count(batches_in):
        held: dict[int, list] = {}

        def merge(parts):
            g, c = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            u, inv = np.unique(g, return_inverse=True)
            return u, np.bincount(inv, c, len(u)).astype(np.int64)

        for batch in batches_in:
            for part in batches(batch, TEXT_BYTES):
                lang = np.array([number[x] for x in part.column(1).to_pylist()]) * 2 + np.array(part.column(2).to_pylist(), np.int64)
                texts = part.column(0).to_pylist()
                for k in np.unique(lang):
                    c, starts = letters([texts[i] for i in np.flatnonzero(lang == k)])
                    parts = held.setdefault(int(k), [])
                    parts.append(np.unique(grams(c, starts, order), return_counts=True))
                    if len(parts) > 8:
                        held[int(k)] = [merge(parts)]
        for k, parts in held.items():
            g, c = merge(parts)
            for at in range(0, len(g), 100_000):
                s = slice(at, at + 100_000)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(g[s]), k, np.int32)), pa.array(g[s].view(np.int64)), pa.array(c[s])], ["lang", "gram", "n"])

    return count


def _spreads(model: Model):
    number = {x: i for i, x in enumerate(model.langs)}

    def spread(batches_in):
        for batch in batches_in:
            for part in batches(batch, TEXT_BYTES):
                ce, n = model.cross_entropies(part.column(0).to_pylist())
                own = np.array([number[x] for x in part.column(1).to_pylist()], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(ce[np.arange(len(own)), own]), pa.array(n.astype(np.int64))], ["lang", "ce", "n"])

    return spread


def fit_language_model(
    narratives: DataFrame, id_col: str = "video_id", text_col: str = "narrative", lang_col: str = "lang", learn_col: str | None = None, order: int = ORDER
) -> Model:
    """Model of the languages named by ``lang_col``, from rows where ``learn_col`` is true (all without
    it) and the language is known."""
    d = narratives.filter(F.col(lang_col).isNotNull() & (F.col(learn_col) if learn_col else F.lit(True)))
    d = d.select(F.coalesce(F.col(text_col), F.lit("")).alias("narrative"), F.col(lang_col).cast("string").alias("lang"), (F.pmod(F.xxhash64(id_col), F.lit(10)) == 0).alias("aside"))
    langs = [r["lang"] for r in d.select("lang").distinct().orderBy("lang").collect()]  # a name per language
    counts = d.mapInArrow(_count_grams(langs, order), "lang int, gram long, n long")
    kept = F.when(F.col("lang") % 2 == 0, F.col("n")).otherwise(0)
    counts = counts.groupBy(F.floor(F.col("lang") / 2).cast("int").alias("lang"), "gram").agg(F.sum("n").alias("n"), F.sum(kept).alias("kept"))
    got = counts.toArrow()
    lang, gram, n, kept = got["lang"].to_numpy(), got["gram"].to_numpy().view(U64), got["n"].to_numpy(), got["kept"].to_numpy()
    some = kept > 0
    model = kneser_ney(lang[some], gram[some], kept[some], langs, order)
    learned = np.unique(lang[some]).tolist()
    s = d.filter("aside").select("narrative", "lang").mapInArrow(_spreads(model), "lang long, ce double, n long").filter((F.col("n") > 0) & F.col("lang").isin(learned))
    model.center, model.spread = np.full(len(langs), np.nan), np.ones((len(langs), 2))
    centers = s.groupBy("lang").agg((F.sum(F.col("ce") * F.col("n")) / F.sum("n")).alias("m"))
    for r in centers.collect():
        model.center[r["lang"]] = r["m"]
    off = F.col("ce") - F.element_at(F.array(*[F.lit(float(x)) for x in model.center], F.lit(0.0)), (F.col("lang") + 1).cast("int"))
    short = F.col("n") < 500
    for r in s.groupBy("lang").agg(F.avg(F.when(~short, off * off)).alias("a"), F.avg(F.when(short, off * off * F.col("n"))).alias("b")).collect():
        model.spread[r["lang"]] = (0.01 if r["a"] is None else r["a"], 1.0 if r["b"] is None else r["b"])
    judged = ~np.isnan(model.center)
    if not judged.all():
        model.center[~judged] = model.center[judged].max() if judged.any() else 0.0
        model.spread[~judged] = model.spread[judged].max(0) if judged.any() else 1.0
    final = kneser_ney(lang, gram, n, langs, order)
    final.center, final.spread = model.center, model.spread
    return final


def _judge(model: Model, texts: list, reject_sds: float):
    """Language number, whether there is one, score, cross-entropy and rejection of each text."""
    ce, n = model.cross_entropies(texts)
    if not model.langs:
        return np.zeros(len(n), np.int64), np.zeros(len(n), bool), np.zeros(len(n)), np.zeros(len(n)), np.ones(len(n), bool)
    best, some = ce.argmin(1), n > 0
    low = ce[np.arange(len(n)), best]
    score = np.where(some, 1 / np.exp(-(ce - low[:, None]) * np.minimum(n, FULL_TRUST)[:, None]).sum(1), 0.0)
    sd = np.sqrt(model.spread[best, 0] + model.spread[best, 1] / np.maximum(n, 1))
    odd = low > model.center[best] + reject_sds * sd
    return best, some, score, low, ~some | odd


def _accept(model: Model, at: int, reject_sds: float):
    def accept(batches_in):
        for batch in batches_in:
            for part in batches(batch, TEXT_BYTES, at):
                yield part.filter(pa.array(~_judge(model, part.column(at).to_pylist(), reject_sds)[-1]))

    return accept


def accepted(narratives: DataFrame, model: Model, text_col: str = "narrative", reject_sds: float = REJECT_SDS) -> DataFrame:
    """The rows of the input that are not rejected, with all their columns."""
    return narratives.mapInArrow(_accept(model, narratives.columns.index(text_col), reject_sds), narratives.schema)


def _predict(model: Model, reject_sds: float):
    def predict(batches_in):
        for batch in batches_in:
            for part in batches(batch, TEXT_BYTES):
                texts = part.column(0).to_pylist()
                best, some, score, low, reject = _judge(model, texts, reject_sds)
                names = [model.langs[b] if s else UNKNOWN for b, s in zip(best, some)]
                yield pa.RecordBatch.from_arrays([*part.columns[1:], pa.array(names, pa.string()), pa.array(score), pa.array(low), pa.array(reject)], [*part.schema.names[1:], "lang_pred", "score", "cross_entropy", "rejected"])

    return predict


def predict_language(narratives: DataFrame, model: Model, text_col: str = "narrative", keep: tuple[str, ...] = ("video_id",), reject_sds: float = REJECT_SDS) -> DataFrame:
    """The columns ``keep`` and ``lang_pred, score, cross_entropy, rejected`` of every narrative.

    ``lang_pred`` has the lowest cross-entropy per character, ``score`` its share among the languages;
    ``rejected`` says that the cross-entropy is beyond what the language's own narratives of that
    length show. A null text or one without letters is ``und`` with score 0 and rejected. Rows that
    repeat are answered alike; an empty table gives an empty result; with nothing to learn from,
    everything is ``und``. Columns not in ``keep`` are not read.
    """
    clash = {"lang_pred", "score", "cross_entropy", "rejected"} & set(keep)
    if clash:
        raise ValueError(f"columns to keep clash with the results: {sorted(clash)}")
    d = narratives.select(F.coalesce(F.col(text_col), F.lit("")).alias("_text"), *keep)
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in d.schema.fields[1:])
    return d.mapInArrow(_predict(model, reject_sds), fields + "lang_pred string, score double, cross_entropy double, rejected boolean")
