"""Mix the narratives of several categories to target weights by a low-discrepancy schedule.

The narratives of a category are shuffled by a hash, laid end to end and cut into blocks of equally
many words. Slots are numbered 0, 1, 2, ...; slot ``t`` looks at the golden-ratio point
``frac((t + 1) * phi)`` on the cumulative block shares of the categories and so belongs to one of
them. The slots of a category are ranked, and the slot of rank ``r`` takes words ``r * block`` to
``(r + 1) * block`` of the category's stream, which starts again at its end. Any stretch of the
schedule is mixed as the whole.

Everything is DataFrame work. Running sums and ranks go through slices of a few thousand rows and
one summary row per slice, so a category that holds a third of all rows is spread; only the table
of categories (a row each) and the slice summaries of one category are ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from chronotrace.llm.columns import names_unlike, word_count
from chronotrace.session import cut

WEIGHTS = (3.0, 1.0, 2.0)
PHI = 0.6180339887498949
SLICE_ROWS = 4096
KEY_BITS = 52


def _sized(narratives: DataFrame, id_col: str, text_col: str, category_col: str, seed: str) -> DataFrame:
    """One narrow row per narrative; the text is read and counted once."""
    key = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("null")))), 1, KEY_BITS // 4), 16, 10)
    d = narratives.select(
        F.col(id_col).alias("video_id"), F.col(category_col).cast("string").alias("category"), word_count(text_col).alias("size"), key.cast("long").alias("k")
    )
    return cut(d)


def category_targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 1024) -> DataFrame:
    """One row per category, in code point order with null last: its words, weight and target.

    Targets share ``share`` of all words by weight and stop at ``most`` times the category's own
    words. Sorted by cap over weight, the capped categories come first, so one pass of running sums
    finds the level at which the rest share what is left.
    """
    s = sized.groupBy("category").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    by_name = W.orderBy(F.col("category").asc_nulls_last())
    s = s.withColumn("s", F.row_number().over(by_name).cast("long"))
    s = s.withColumn("w", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("s") - 1, F.lit(len(weights))) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    by_cap = W.orderBy(F.col("cap") / F.col("w"), "s")
    every = W.partitionBy()
    left = F.lit(float(share)) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    heavy = F.sum("w").over(by_cap.rowsBetween(0, W.unboundedFollowing))
    s = s.withColumn("level", left / heavy)
    open_ = F.when(F.col("cap") >= F.col("level") * F.col("w"), F.struct((F.col("cap") / F.col("w")).alias("r"), F.col("s"), F.col("level")))
    s = s.withColumn("target", F.least(F.col("cap"), F.coalesce(F.min(open_).over(every)["level"] * F.col("w"), F.col("cap"))))
    s = s.withColumn("quota", F.floor(F.col("target") + 0.5).cast("long"))
    s = s.withColumn("slots", F.ceil(F.col("quota") / F.lit(block)).cast("long"))
    upto = W.orderBy("s").rowsBetween(W.unboundedPreceding, -1)
    return s.withColumns(
        {
            "c_lo": F.coalesce(F.sum("slots").over(upto), F.lit(0)),
            "all_slots": F.sum("slots").over(every),
            "n_sources": F.count(F.lit(1)).over(every),
        }
    ).drop("cap", "level")


def _placed(sized: DataFrame, targets: DataFrame) -> DataFrame:
    """Start of every narrative in its category's shuffled stream."""
    t = targets.select(F.col("category").alias("_c"), "s", "source_size", "target", "n_rows")
    d = sized.join(t, sized["category"].eqNullSafe(t["_c"])).drop("_c")
    d = d.withColumn("slice", F.floor(F.col("k") / F.lit(float(2**KEY_BITS)) * F.ceil(F.col("n_rows") / F.lit(float(SLICE_ROWS)))).cast("long"))
    inside = W.partitionBy("s", "slice").orderBy("k", "video_id", "size").rowsBetween(W.unboundedPreceding, -1)
    local = d.withColumn("before", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    sums = d.groupBy("s", "slice").agg(F.sum("size").alias("n"))
    sums = sums.select("s", "slice", F.coalesce(F.sum("n").over(W.partitionBy("s").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    return local.join(sums, ["s", "slice"]).withColumn("start", F.col("base") + F.col("before")).drop("slice", "base", "before", "n_rows", "k")


def _schedule(targets: DataFrame) -> DataFrame:
    """Slot number, category number and rank of every slot; as many per category as its quota needs."""
    src = targets.filter("slots > 0").select("s", "c_lo", (F.col("c_lo") + F.col("slots")).alias("c_hi"), "slots", "all_slots", (4 * F.col("n_sources")).alias("g"))
    cells = F.sequence(F.expr("c_lo * g div all_slots"), F.expr("(c_hi - 1) * g div all_slots"))
    grid = src.select("s", "c_lo", "c_hi", F.explode(cells).alias("cell"))
    one = src.agg(F.max("all_slots").alias("all_slots"), F.max("g").alias("g")).filter("all_slots > 0")
    chunks = one.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(all_slots - 1) div {SLICE_ROWS}"))).alias("chunk"))
    t = chunks.repartition("chunk").select("*", F.explode(F.sequence(F.col("chunk") * SLICE_ROWS, F.least((F.col("chunk") + 1) * SLICE_ROWS, F.col("all_slots")) - 1)).alias("slot"))
    point = (F.col("slot") + 1) * F.lit(PHI)
    x = F.least(F.floor((point - F.floor(point)) * F.col("all_slots")).cast("long"), F.col("all_slots") - 1)
    t = t.withColumn("x", x).withColumn("cell", F.expr("x * g div all_slots")).select("slot", "chunk", "x", "cell")
    t = t.join(grid, (t["cell"] == grid["cell"]) & (t["x"] >= grid["c_lo"]) & (t["x"] < grid["c_hi"])).select("s", "chunk", "slot")
    local = t.withColumn("i", F.row_number().over(W.partitionBy("s", "chunk").orderBy("slot")).cast("long") - 1)
    sums = t.groupBy("s", "chunk").agg(F.count(F.lit(1)).alias("n"))
    sums = sums.select("s", "chunk", F.coalesce(F.sum("n").over(W.partitionBy("s").orderBy("chunk").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    ranked = local.join(sums, ["s", "chunk"]).select("s", "slot", (F.col("base") + F.col("i")).alias("r"))
    ranked = ranked.join(src.select("s", "slots"), "s").filter("r < slots").select("s", "slot", "r")
    # The points give each category its share up to a few slots; those still due follow at the end.
    got = t.groupBy("s").agg(F.count(F.lit(1)).alias("got"))
    due = src.join(got, "s", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < slots")
    due = due.select("s", F.col("all_slots"), F.col("c_lo"), F.explode(F.sequence(F.col("got"), F.col("slots") - 1)).alias("r"))
    return ranked.unionByName(due.select("s", (F.col("all_slots") + F.col("c_lo") + F.col("r")).alias("slot"), "r"))


def _pieces(placed: DataFrame, targets: DataFrame, block: int) -> DataFrame:
    """Slots joined to the stretches of narratives they take."""
    segs = _schedule(targets).join(targets.select("s", "quota", "source_size"), "s")
    segs = segs.select("s", "slot", "source_size", (F.col("r") * block).alias("a"), F.least((F.col("r") + 1) * block, F.col("quota")).alias("b")).filter("a < b")
    segs = segs.withColumn("pass", F.explode(F.sequence(F.expr("a div source_size"), F.expr("(b - 1) div source_size"))))
    segs = segs.select(
        "s", "slot", "pass",
        F.greatest(F.col("a") - F.col("pass") * F.col("source_size"), F.lit(0)).alias("a"),
        F.least(F.col("b") - F.col("pass") * F.col("source_size"), F.col("source_size")).alias("b"),
    )
    segs = segs.withColumn("cell", F.explode(F.sequence(F.expr(f"a div {block}"), F.expr(f"(b - 1) div {block}"))))
    docs = placed.filter("size > 0").select("s", "category", "video_id", "start", "size")
    docs = docs.withColumn("cell", F.explode(F.sequence(F.expr(f"start div {block}"), F.expr(f"(start + size - 1) div {block}"))))
    lo = F.greatest("start", "a", F.col("cell") * block)
    hi = F.least(F.col("start") + F.col("size"), F.col("b"), (F.col("cell") + 1) * block)
    j = docs.join(segs, ["s", "cell"]).withColumns({"lo": lo, "hi": hi}).filter("lo < hi")
    return j.select("s", "start", "slot", "pass", "category", "video_id", (F.col("lo") - F.col("start")).alias("first_word"), (F.col("hi") - F.col("lo")).alias("n_words"))


def mixed_pieces(
    narratives: DataFrame, id_col: str = "video_id", text_col: str = "narrative", category_col: str = "category",
    weights=WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 1024, seed: str = "mix",
) -> DataFrame:
    """The mix itself: ``slot, pass, category, video_id, first_word, n_words``, a row per stretch of a
    narrative; order by slot to read it."""
    sized = _sized(narratives, id_col, text_col, category_col, seed)
    targets = cut(category_targets(sized, weights, share, most, block))
    return _pieces(_placed(sized, targets), targets, block).drop("s", "start")


def mixed_totals(
    narratives: DataFrame, id_col: str = "video_id", text_col: str = "narrative", category_col: str = "category",
    weights=WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 1024, seed: str = "mix",
) -> DataFrame:
    """Per narrative: ``video_id, category, size, source_size, target, taken, first_passes, first_slot``.

    ``size`` counts words, ``taken`` the words that the mix takes of it over all passes,
    ``first_passes`` the passes that take its first word, and ``first_slot`` the slot of the schedule in
    which it comes first (null if it never does): in this order the narratives are mixed. Null and blank narratives have size 0 and
    nothing taken; a null category is a category of its own, after the others; rows that repeat are
    separate rows; an empty table gives an empty result. Other columns of the input are not read.
    """
    sized = _sized(narratives, id_col, text_col, category_col, seed)
    targets = cut(category_targets(sized, weights, share, most, block))
    placed = cut(_placed(sized, targets))
    got = _pieces(placed, targets, block).groupBy("s", "start").agg(F.sum("n_words").alias("got"), F.sum(F.when(F.col("first_word") == 0, 1).otherwise(0)).alias("heads"), F.min("slot").alias("first_slot"))
    got = got.withColumnRenamed("start", "_start").withColumnRenamed("s", "_s")
    hit = (placed["s"] == got["_s"]) & (placed["start"] == got["_start"]) & (placed["size"] > 0)
    return placed.join(got, hit, "left").select(
        "video_id", "category", "size", "source_size", "target", F.coalesce("got", F.lit(0)).cast("long").alias("taken"), F.coalesce("heads", F.lit(0)).cast("long").alias("first_passes"), "first_slot"
    )


def mixed_rows(narratives: DataFrame, id_col: str = "video_id", text_col: str = "narrative", category_col: str = "category", **options) -> DataFrame:
    """Whole narratives as the mix takes them: a row for each pass that takes a narrative's first word,
    with the columns of the input. One that the mix does not reach is left out; one without words, which
    no weight can speak of, stays once. Equal rows count together and come as often as all of them."""
    key, copies, turn = names_unlike(narratives.columns, "key", "copies", "turn")
    d = narratives.withColumn(key, F.xxhash64(id_col, category_col, text_col))
    totals = mixed_totals(d, key, text_col, category_col, **options)
    totals = totals.groupBy(F.col("video_id").alias(key)).agg(F.sum(F.when(F.col("size") > 0, F.col("first_passes")).otherwise(1)).cast("int").alias(copies))
    rows = d.join(totals.filter(F.col(copies) > 0), key)
    rows = rows.withColumn(turn, F.row_number().over(W.partitionBy(key).orderBy(id_col))).filter(F.col(turn) == 1)
    return rows.select(*narratives.columns, F.explode(F.array_repeat(F.lit(0), F.col(copies))).alias(turn)).select(*narratives.columns)
