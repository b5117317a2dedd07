"""Narratives that share nearly all their word n-grams: an exact Jaccard self-join by prefixes.

Each narrative becomes the set of its distinct n-grams, as 64-bit hashes. Narratives with one and the
same set are one *class*; only classes are joined. A set is ordered from rare to frequent n-grams; two
sets that are alike enough must share one in their short prefixes, so classes meet only on those.
Length and positional filters drop most that meet, a bitmap filter (a set's n-grams by parity in a few
bits; bits that differ are n-grams that differ) nearly all of the rest that are not alike, whatever the
length of the texts. What is left is verified on the whole sets, once per pair; only then are sets made.

A group of k near copies meets on common n-grams; pairing all with all would cost k squared. So each
meeting first pairs everyone with its most central member. Components of the links found hold most of
such a group together; then only classes of different components are paired, and of those only pairs
with a member outside the largest component of their meeting. Pairs within a component cannot change
it, so the components are exactly those of all links.

A set is named by a 64-bit digest. Where rows of one name differ in a second digest, the name is drawn
anew from both, so two different sets are one class only if 128 bits agree.

Rarity is read from counts of n-grams in ``SKETCH`` cells, a fixed number; it decides the order, never
the result.
"""

from __future__ import annotations

import contextlib
import ctypes
import math
import uuid
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronotrace.llm.arrow_text import U64, batches, mix, word_hashes
from chronotrace.llm.columns import names_unlike
from chronotrace.session import shared_dir

_SECOND = U64(0xA0761D6478BD642F)
SKETCH_BITS, SKETCH_BLOCK = 20, 1 << 14
TEXT_BYTES = 1 << 18  # of text at a time in numpy, which holds some hundred bytes for each
MEMO_BITS = 17
MEMBERS = "kind int, video_id {id}, c long, n int, second long, cell long, counts binary"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """Fewer rows at a time between Spark and Python while whole texts are written."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def shuffles_dropped(spark: SparkSession):
    """Shuffle files of a job go as soon as it ends, not when the driver next collects garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


def stored(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Write to a new folder under the shared checkpoint folder and read it back."""
    path = f"{shared_dir(df.sparkSession)}/ngrams-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession), shuffles_dropped(df.sparkSession):
        df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shingle_sets(column, width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of the word n-grams of each row, A-Z lower-cased; of a row with fewer words
    the whole sequence is its only n-gram; without words the set is empty."""
    h, row = word_hashes(column, lower=True)
    out = []
    if len(h) >= width:
        grams = np.zeros(len(h) - width + 1, U64)
        for k in range(width):
            grams = mix(grams ^ h[k : k + len(grams)] + U64(k + 1))
    for a, b in zip(row, row[1:]):
        if b - a >= width:
            out.append(np.unique(grams[a : b - width + 1]))
        elif b > a:
            g = np.zeros(1, U64)
            for k in range(a, b):
                g = mix(g ^ h[k : k + 1] + U64(width - (b - a) + k - a + 101))
            out.append(g)
        else:
            out.append(h[:0])
    return out


@dataclass(frozen=True)
class Names:
    """Names of sets. ``bits`` are those of the first digest that count (fewer only in tests); ``clashes``
    are the first digests that different sets have in common."""

    bits: int = 64
    clashes: frozenset[int] = frozenset()

    def digests(self, s: np.ndarray) -> tuple[int, int]:
        with np.errstate(over="ignore"):
            size = U64(len(s))
            first = mix(np.array([s.sum(dtype=U64) ^ (mix(s).sum(dtype=U64) << U64(1)) ^ size]))
            other = mix(s ^ _SECOND)
            second = mix(np.array([other.sum(dtype=U64) ^ (mix(other).sum(dtype=U64) << U64(1)) ^ size]))
        return int((first >> U64(64 - self.bits))[0].view(np.int64)), int(second[0].view(np.int64))

    def of(self, s: np.ndarray) -> int:
        """0 for the empty set."""
        if not len(s):
            return 0
        first, second = self.digests(s)
        if first not in self.clashes:
            return first
        with np.errstate(over="ignore"):
            return int(mix(np.array([first, second]).view(U64))[:1].view(np.int64)[0]) ^ second


def slim(batches_in):
    """Give freed memory back at the end of a task; a worker process serves many tasks."""
    yield from batches_in
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def _members(width: int, names_of: Names):
    """Class and size of every row, and at the end of the task its counts of n-grams by cell."""

    def members(batches_in):
        cells = np.zeros(1 << SKETCH_BITS, np.int64)
        names, id_type, seen = ["kind", "video_id", "c", "n", "second", "cell", "counts"], None, False
        for batch in batches_in:
            for part in batches(batch, TEXT_BYTES, 1):
                sets = shingle_sets(part.column(1), width)
                n, id_type, seen = len(sets), part.schema.field(0).type, True
                every = np.concatenate(sets)
                cells += np.bincount((every >> U64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(cells))
                pairs = [names_of.digests(s) if len(s) else (0, 0) for s in sets]
                first, second = (pa.array([p[i] for p in pairs], pa.int64()) for i in (0, 1))
                cols = [pa.array(np.zeros(n, np.int32)), part.column(0), first, pa.array([len(s) for s in sets], pa.int32()), second]
                yield pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary())], names)
        if seen:
            blocks = cells.reshape(-1, SKETCH_BLOCK)
            full = np.flatnonzero(blocks.any(1))
            k, task = len(full), TaskContext.get().partitionId()
            cols = [pa.array(np.ones(k, np.int32)), pa.nulls(k, id_type), pa.array(np.full(k, task)), pa.nulls(k, pa.int32()), pa.nulls(k, pa.int64()), pa.array(full), pa.array([_packed(blocks[b]) for b in full], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names)

    return lambda rows: slim(members(rows))


def _packed(counts: np.ndarray) -> bytes:
    """Counts of a block; beyond 32 bits all are equally frequent. Most are small: one byte at a time, by place."""
    low = np.minimum(counts, 0xFFFFFFFF).astype("<u4")
    return zlib.compress(low.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _unpacked(block: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(block), np.uint8).reshape(4, -1).T.copy().view("<u4")[:, 0]


def _add_counts(table: pa.Table) -> pa.Table:
    total = np.zeros(SKETCH_BLOCK, np.int64)
    for b in table["counts"]:
        total += _unpacked(b.as_py())
    return pa.table({"cell": table["cell"].slice(0, 1), "counts": pa.array([_packed(total)], pa.binary())})


def _rarity(rows: DataFrame) -> np.ndarray:
    """Order of the cells from rare to frequent. Counts are added in two steps, so that a group has no
    more rows than about the root of the number of tasks."""
    part = rows.filter("kind = 1").select("cell", "counts", F.pmod("c", F.lit(61)).alias("lot"))
    part = part.groupBy("cell", "lot").applyInArrow(_add_counts, "cell long, counts binary")
    part = part.groupBy("cell").applyInArrow(_add_counts, "cell long, counts binary")
    cells = np.zeros(((1 << SKETCH_BITS) // SKETCH_BLOCK, SKETCH_BLOCK), np.int64)
    for r in part.toLocalIterator():  # a fixed number of cells
        cells[r["cell"]] = _unpacked(r["counts"])
    return np.unique(cells.ravel(), return_inverse=True)[1].astype(np.int32)


def _least_overlap(n: int, percent: int) -> int:
    """Fewest common n-grams with any set that is alike: the threshold share of the larger set."""
    return -(-percent * n // 100)


PLACE_BITS = 16
FARTHEST = (1 << PLACE_BITS) - 1  # a place beyond counts as this one, which only loosens the positional filter


def _prefixes(width: int, percent: int, rarity: np.ndarray, names_of: Names):
    """Prefixes of classes; ``place`` has the size of the set and, in its last bits, the n-gram's place in the order."""

    def prefixes(batches_in):
        # copies met before in this task mostly need no second prefix; the rest are told apart when they meet
        met = np.zeros(1 << MEMO_BITS, np.int64)
        for batch in batches_in:
            for part in batches(batch, TEXT_BYTES):
                out = []
                for s in shingle_sets(part.column(0), width):
                    c, n = names_of.of(s), len(s)
                    slot = c & (len(met) - 1)
                    if not n or met[slot] == c:
                        continue
                    met[slot] = c
                    take = n - _least_overlap(n, percent) + 1
                    level = rarity[(s >> U64(64 - SKETCH_BITS)).astype(np.int64)]
                    order = np.argsort(level, kind="stable")[:take]  # s is sorted, so ties go by hash
                    place = (n << PLACE_BITS) + np.minimum(np.arange(take), FARTHEST)
                    out.append((s[order].view(np.int64), c, place))
                if out:
                    take = [len(g) for g, _, _ in out]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(np.concatenate([g for g, _, _ in out])),
                            pa.array(np.repeat(np.array([c for _, c, _ in out], np.int64), take)),
                            pa.array(np.concatenate([place for _, _, place in out])),
                        ],
                        ["g", "c", "place"],
                    )

    return lambda rows: slim(prefixes(rows))


def _asked(width: int, names_of: Names, columns: tuple[str, ...], made):
    """Class and what ``made`` makes of the set, for the rows that are of the class they were asked for."""

    def asked(batches_in):
        for batch in batches_in:
            for part in batches(batch, TEXT_BYTES):
                found = [(c, s) for c, s in zip(part.column(1).to_pylist(), shingle_sets(part.column(0), width)) if names_of.of(s) == c]
                yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in found], pa.int64()), *made([s for _, s in found])], ["c", *columns])

    return lambda rows: slim(asked(rows))


def _whole(sets: list[np.ndarray]) -> list[pa.Array]:
    return [pa.array([s.tobytes() for s in sets], pa.binary())]


def parity_bits(s: np.ndarray, percent: int) -> np.ndarray:
    """A set as bits, packed: each says whether an odd number of n-grams fall on it. Their number is a power of
    two, at least eight times the n-grams in which sets of this size that are alike may differ."""
    differ = 2 * len(s) * (100 - percent) // (100 + percent)
    size = 1 << max(6, (8 * differ - 1).bit_length())
    return np.packbits((np.bincount((s & U64(size - 1)).astype(np.int64), minlength=size) & 1).astype(bool))


def bits_apart(x: np.ndarray, y: np.ndarray) -> int:
    """Bits that differ, the longer row folded to the length of the shorter: two sets differ in as many
    n-grams at least."""
    while len(x) > len(y):
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] ^ y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _bits(percent: int):
    return lambda sets: [pa.array([len(s) for s in sets], pa.int64()), pa.array([parity_bits(s, percent).tobytes() for s in sets], pa.binary())]


def _alike(na, nb, overlap, percent: int):
    return 100 * overlap >= percent * (na + nb - overlap)


def _bitmap_filter(percent: int):
    """Pairs whose bits leave room for enough common n-grams."""

    def keep(batches_in):
        for batch in batches_in:
            na, nb = (batch.column(k).to_numpy() for k in ("n_a", "n_b"))
            ends = zip(batch.column("bits_a"), batch.column("bits_b"))
            apart = np.array([bits_apart(*(np.frombuffer(v.as_py(), np.uint8) for v in xy)) for xy in ends], np.int64)
            ok = pa.array(_alike(na, nb, (na + nb - apart) // 2, percent))
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    return keep


def _verify(percent: int):
    def verify(batches_in):
        for batch in batches_in:
            ok = []
            for x, y in zip(batch.column("grams_a"), batch.column("grams_b")):
                x, y = np.frombuffer(x.as_py(), U64), np.frombuffer(y.as_py(), U64)
                ok.append(bool(_alike(len(x), len(y), len(np.intersect1d(x, y, assume_unique=True)), percent)))
            ok = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(ok), batch.column("b").filter(ok)], ["a", "b"])

    return verify


def _may_link(n_a, pos_a, n_b, pos_b, percent: int):
    """Length and positional filters at the first n-gram two prefixes share."""
    shared = F.least(n_a - pos_a, n_b - pos_b)
    return (100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)) & (100 * shared >= percent * (n_a + n_b - shared))


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()


MOST_SENT_CLASSES = 1_000_000  # two numbers each


class _Sets:
    """Bits of the classes that appear in pairs, and whole sets of those still in question, made anew from
    their texts and stored."""

    def __init__(self, texts: DataFrame, classes: DataFrame, width: int, percent: int, names_of: Names):
        self.texts, self.classes, self.width, self.percent, self.names_of = texts, classes, width, percent, names_of
        self.bits = self.grams = None

    def _made(self, pairs: DataFrame, before: DataFrame | None, schema: str, make) -> DataFrame:
        """What is there of the classes in pairs, with what was made before."""
        c = _ends(pairs)
        if before is not None:
            c = c.join(before.select("c"), "c", "left_anti")
        wanted = stored(c.join(self.classes, "c").select("c", "rep"))
        if wanted.count() <= MOST_SENT_CLASSES:  # else both sides are shuffled by id
            wanted = F.broadcast(wanted)
        some = self.texts.join(wanted, F.col("video_id").eqNullSafe(F.col("rep"))).select("narrative", "c")
        columns = tuple(f.split()[0] for f in schema.split(", "))[1:]
        made = stored(some.mapInArrow(_asked(self.width, self.names_of, columns, make), schema))
        return made if before is None else before.unionByName(made)

    def linked(self, pairs: DataFrame) -> DataFrame:
        """The pairs (``a``, ``b``) that are alike."""
        self.bits = self._made(pairs, self.bits, "c long, n long, bits binary", _bits(self.percent))
        end = lambda d, k: d.withColumnsRenamed({"c": k} | {c: f"{c}_{k}" for c in d.columns[1:]})
        p = pairs.join(end(self.bits, "a"), "a").join(end(self.bits, "b"), "b")
        p = stored(p.mapInArrow(_bitmap_filter(self.percent), "a long, b long"))
        self.grams = self._made(p, self.grams, "c long, grams binary", _whole)
        left = _ends(p)
        if left.count() <= MOST_SENT_CLASSES:  # only sets still in question are moved; else all are shuffled by class
            left = F.broadcast(left)
        grams = self.grams.join(left, "c", "left_semi")
        p = p.join(end(grams, "a"), "a").join(end(grams, "b"), "b")
        return stored(p.mapInArrow(_verify(self.percent), "a long, b long"))


def components(links: DataFrame) -> DataFrame:
    """``c, comp`` of every class in ``links``: the smallest class reachable.

    Each round takes the least label among neighbours and then the label's own label, so rounds grow
    with the logarithm of a chain's length; tables are written between rounds.
    """
    edges = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = stored(edges.groupBy(F.col("a").alias("c")).agg(F.least(F.min("b"), F.first("a")).alias("comp")))
    while True:
        near = edges.join(labels.withColumnRenamed("c", "b"), "b").groupBy(F.col("a").alias("c")).agg(F.min("comp").alias("near"))
        step = labels.join(near, "c").select("c", F.least("comp", "near").alias("new"), F.col("comp").alias("old"))
        jump = step.select(F.col("c").alias("new"), F.col("new").alias("further"))
        step = stored(step.join(jump, "new", "left").select("c", F.least("new", F.coalesce("further", "new")).alias("comp"), "old"))
        labels = step.select("c", "comp")
        if step.filter("comp <> old").isEmpty():
            return labels


def _grouped(d: DataFrame, width: int, percent: int, bits: int) -> tuple[DataFrame, Names]:
    """``video_id, n, c, grp, component_id`` of every row, and the names of sets; ``grp`` is a class that
    stands for the component, null without n-grams."""
    kind = d.schema["video_id"].dataType.simpleString()
    rows = stored(d.mapInArrow(_members(width, Names(bits)), MEMBERS.format(id=kind)))
    apart = rows.filter("kind = 0").groupBy("c").agg((F.min("second") < F.max("second")).alias("differ")).filter("differ")
    names_of = Names(bits, frozenset(r["c"] for r in apart.collect()))  # pairs of texts with one 64-bit digest: hardly any
    if names_of.clashes:
        d = d.select("video_id", "narrative")
        rows = rows.filter("kind = 1").unionByName(stored(d.mapInArrow(_renamed(width, names_of), MEMBERS.format(id=kind))))
    members = rows.filter("kind = 0").select("video_id", "c", "n")
    classes = members.filter("n > 0").groupBy("c").agg(F.min("video_id").alias("rep"))
    comp = components(_class_links(d, rows, classes, width, percent, names_of))
    best = comp.join(classes, "c").groupBy("comp").agg(F.min("rep").alias("best"))
    named = classes.join(comp, "c", "left").join(best, "comp", "left").select("c", F.coalesce("comp", "c").alias("grp"), F.coalesce("best", "rep").alias("component_id"))
    bare = members.filter("n = 0").select("video_id", "c", "n", F.lit(None).cast("long").alias("grp"), F.col("video_id").alias("component_id"))
    return members.filter("n > 0").join(named, "c").select(*bare.columns).unionByName(bare), names_of


def _renamed(width: int, names_of: Names):
    """Rows of ``_members`` without counts, by the final names."""

    def renamed(batches_in):
        for batch in batches_in:
            for part in batches(batch, TEXT_BYTES, 1):
                sets = shingle_sets(part.column(1), width)
                n = len(sets)
                cols = [pa.array(np.zeros(n, np.int32)), part.column(0), pa.array([names_of.of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32())]
                yield pa.RecordBatch.from_arrays([*cols, *[pa.nulls(n, pa.int64())] * 2, pa.nulls(n, pa.binary())], ["kind", "video_id", "c", "n", "second", "cell", "counts"])

    return renamed


def ngram_components(narratives: DataFrame, id_col: str = "video_id", text_col: str = "narrative", width: int = 5, percent: int = 80, digest_bits: int = 64) -> DataFrame:
    """Per narrative: ``video_id, n_shingles, class_id, component_id``.

    Two narratives link when they share at least ``percent`` of 100 of the union of their word
    ``width``-grams. ``component_id`` is the smallest ``video_id`` reachable by links, itself included;
    narratives of one ``class_id`` have the same n-grams. A null text or one without words has no
    n-grams, links with nothing and keeps its own id. Repeated rows are copies of each other; a null id
    never is the smallest unless all are null; an empty table gives an empty result. ``digest_bits`` are
    those of the digest that names a set; fewer than 64 only make clashes, and with them work, more likely.
    """
    d = narratives.select(F.col(id_col).alias("video_id"), F.col(text_col).alias("narrative"))
    return _grouped(d, width, percent, digest_bits)[0].select("video_id", F.col("n").cast("long").alias("n_shingles"), F.col("c").alias("class_id"), "component_id")


def _class_links(d: DataFrame, rows: DataFrame, classes: DataFrame, width: int, percent: int, names_of: Names) -> DataFrame:
    """Links between classes that connect all that are alike."""
    prefixes = d.select("narrative").mapInArrow(_prefixes(width, percent, _rarity(rows), names_of), "g long, c long, place long")
    # moved with few bytes: a row has three numbers until it has met
    n, pos = F.shiftright("place", PLACE_BITS).alias("n"), F.col("place").bitwiseAND(FARTHEST).cast("int").alias("pos")
    prefixes = prefixes.repartition("g").select("g", "c", n, pos)
    by_rank = W.partitionBy("g").orderBy("pos", "n", "c")
    me = F.struct("c", "n", "pos")
    meeting = prefixes.select("*", F.first(me).over(by_rank).alias("head"), F.lag("c").over(by_rank).alias("left"), F.lead("c").over(by_rank).alias("right"))
    meeting = meeting.filter("(left is not null or right is not null) and not (left <=> c)")  # not alone, not the same class again
    meeting = stored(meeting.select("g", "c", "n", "pos", F.col("head.c").alias("head"), F.col("head.n").alias("head_n"), F.col("head.pos").alias("head_pos")))
    star = meeting.filter(F.col("c") != F.col("head")).filter(_may_link(F.col("n"), F.col("pos"), F.col("head_n"), F.col("head_pos"), percent))
    star = stored(star.select(F.least("c", "head").alias("a"), F.greatest("c", "head").alias("b")).distinct())
    sets = _Sets(d, classes, width, percent, names_of)
    first = sets.linked(star)
    comp = components(first)
    at = meeting.select("g", "c", "n", "pos").join(comp, "c", "left").withColumn("comp", F.coalesce("comp", "c"))
    # moved once, by n-gram: what is counted per component is there, too
    at = at.repartition("g").withColumn("k", F.count(F.lit(1)).over(W.partitionBy("g", "comp")))
    by_gram = W.partitionBy("g")
    at = at.withColumn("largest", F.max(F.struct("k", "comp")).over(by_gram)["comp"]).withColumn("least", F.min("comp").over(by_gram)).withColumn("most", F.max("comp").over(by_gram))
    mixed = stored(at.filter("least < most").select("g", "c", "n", "pos", "comp", (F.col("comp") == F.col("largest")).alias("main")))
    # sizes of sets that are alike differ by less than half a level, so an n-gram met by many is met in parts
    half = math.log(100 / percent) * (1 + 1e-9) if percent < 100 else 1.0
    size = F.log("n") / F.lit(2 * half)
    mixed = mixed.withColumn("level", F.floor(size))
    x = mixed.filter("not main").withColumn("level", F.explode(F.array_distinct(F.array(F.floor(size - 0.5), F.floor(size + 0.5))))).alias("x")
    y = mixed.alias("y")
    apart = (F.col("x.comp") != F.col("y.comp")) & (F.col("y.main") | (F.col("x.c") < F.col("y.c")))
    near = _may_link(F.col("x.n"), F.col("x.pos"), F.col("y.n"), F.col("y.pos"), percent)
    same = (F.col("x.g") == F.col("y.g")) & (F.col("x.level") == F.col("y.level"))
    pairs = x.join(y, same & apart & near).select(F.least("x.c", "y.c").alias("a"), F.greatest("x.c", "y.c").alias("b")).distinct()
    second = sets.linked(stored(pairs.join(star, ["a", "b"], "left_anti")))
    return first.unionByName(second)


def _fields(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields), *more])


def _with_class(width: int, at: int, name: str, names_of: Names):
    def with_class(batches_in):
        for batch in batches_in:
            for part in batches(batch, TEXT_BYTES, at):
                c = [names_of.of(s) if len(s) else None for s in shingle_sets(part.column(at), width)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(c, pa.int64())], [*part.schema.names, name])

    return lambda rows: slim(with_class(rows))


def one_per_group(
    narratives: DataFrame, id_col: str = "video_id", text_col: str = "narrative", width: int = 5, percent: int = 80, digest_bits: int = 64
) -> DataFrame:
    """The input with one row of each component: the one with the smallest id (null last), of equal ids
    the one with the smallest class, of rows that agree in both any one. Rows without n-grams all stay,
    whatever their ids. Columns are those of the input."""
    d = narratives.select(F.col(id_col).alias("video_id"), F.col(text_col).alias("narrative"))
    found, names_of = _grouped(d, width, percent, digest_bits)
    first = found.filter("n > 0").groupBy("grp").agg(F.min(F.struct(F.col("video_id").isNull().alias("none"), "video_id", "c")).alias("x"))
    c, own, key, turn, want, want_c, want_key = names_unlike(narratives.columns, "c", "own", "key", "turn", "want", "want_c", "want_key")
    chosen = first.select(F.col("x.video_id").alias(want), F.col("x.c").alias(want_c), F.xxhash64("x.video_id", "x.c").alias(want_key))
    rows = narratives.mapInArrow(_with_class(width, narratives.columns.index(text_col), c, names_of), _fields(narratives, f"`{c}` long"))
    bare, me = F.col(c).isNull(), F.col(id_col)
    rows = rows.withColumn(own, F.when(bare, F.monotonically_increasing_id())).withColumn(key, F.xxhash64(me, F.col(c), F.col(own)))
    # the hash only deals rows out and finds candidates; class and id decide
    same = F.when(F.col(c) == F.col(want_c), me.eqNullSafe(F.col(want))).otherwise(False)
    rows = rows.join(stored(chosen), (F.col(key) == F.col(want_key)) & same, "left").filter(bare | F.col(want_c).isNotNull())
    rows = rows.withColumn(turn, F.row_number().over(W.partitionBy(key, c, id_col, own).orderBy(c)))
    return rows.filter(F.col(turn) == 1).select(*narratives.columns)
