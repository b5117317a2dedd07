"""Registered queries of this folder: each maps a given table to an operator's record and back.

``documents`` stand for narratives (``doc_id`` for ``video_id``, ``text`` for ``narrative``,
``source`` for ``category``); SQL checks are given where SQL can say the same.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotrace.llm import action_trie, alignment, fingerprints, language, ngram_join, packing, page_text, quality, secrets, source_mix, token_counts, toxicity, window_packing
from chronotrace.llm.sql import NGRAM_SQL, QUALITY_SQL, REBUILT_TRIE_SQL, SOURCE_MIX_SQL
from chronotrace.operators.ordered import Lane, number_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def narratives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("video_id"), F.col("text").alias("narrative"), F.col("source").alias("category"), "lang"
    )


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(narratives(spark, sf_dir)).withColumnRenamed("n_narratives", "n_docs")


@query("op2_source_mix", SOURCE_MIX_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    mix = source_mix.mixed_totals(narratives(spark, sf_dir))
    return mix.select(F.col("video_id").alias("doc_id"), "size", "source_size", "target", "taken", "first_slot")


@query("op4_quality_rules", QUALITY_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_verdicts(narratives(spark, sf_dir))
    return judged.select(
        F.col("video_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


@query("op6_two_fit_packing")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_narratives(narratives(spark, sf_dir)).withColumnRenamed("video_id", "doc_id")


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.secret_spans(narratives(spark, sf_dir))
    joined = lambda c: F.concat_ws(",", F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))))
    of = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return found.select(
        F.col("video_id").alias("doc_id"),
        of("assign").alias("n_assign"),
        of("access").alias("n_access"),
        of("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )


@query("op9_entropy_digests")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprints(narratives(spark, sf_dir)).withColumnRenamed("video_id", "doc_id")


def crc_rest(n: int):
    """Remainder of the CRC-32 of the id as text."""
    return F.crc32(F.coalesce(F.col("video_id").cast("string"), F.lit(""))) % n


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = narratives(spark, sf_dir).withColumn("held_out", crc_rest(5) == 0)
    model = language.fit_language_model(d.withColumn("learn", ~F.col("held_out")), learn_col="learn")
    found = language.predict_language(d, model, keep=("video_id", "held_out"))
    return found.select(F.col("video_id").alias("doc_id"), "held_out", "lang_pred", "score", "cross_entropy", "rejected")


@query("op3_toxicity")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = narratives(spark, sf_dir).withColumn("held_out", crc_rest(4) == 2)
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("video_id"), "toxic").filter(crc_rest(4) != 2)
    model = toxicity.fit_toxicity_model(d, labels)
    scored = toxicity.score_toxicity(d, model, keep=("video_id", "held_out"))
    return scored.select(F.col("video_id").alias("doc_id"), "held_out", "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


@query("op5_ngram_join", NGRAM_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.ngram_components(narratives(spark, sf_dir), width=3, percent=90)
    return found.select(F.col("video_id").alias("doc_id"), "n_shingles", "component_id")


@query("op7_page_text")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_text.main_text(table(spark, sf_dir, "pages"))


@query("op11_window_packing")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return window_packing.pack_open_windows(narratives(spark, sf_dir)).withColumnRenamed("video_id", "doc_id")


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = alignment.token_alignment(narratives(spark, sf_dir))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.select(
        F.col("video_id").alias("doc_id"), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"), "n_shared"
    )


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns of every conversation with the first h of conversation c - c % 20 in the place of its own
    first h, h = crc32(c) % 4; and all conversations. Turns stand for the actions of an entity: ``conv_id``
    for ``entity_id``, ``role`` for ``trigger_rule``, ``text`` for ``action``."""
    t = turns.filter("conv_id is not null")
    slim = action_trie.marked(t, "conv_id", ("turn",), "role", "text").withColumn("at", F.coalesce(F.col("turn").cast("double"), F.lit(float("-inf"))))
    slim = number_rows(slim, Lane(("entity_id",), ("at", "turn", "mark"), 1024), "pos").select("entity_id", "pos", "mark", "n_words")
    taken = F.crc32(F.col("entity_id").cast("string")) % 4
    entities = t.select(F.col("conv_id").alias("entity_id")).distinct()
    wants = entities.select("entity_id", taken.alias("h"), (F.col("entity_id") - F.col("entity_id") % 20).alias("base")).filter("h > 0")
    heads = slim.filter("pos <= 3").withColumnRenamed("entity_id", "base")
    shared = wants.join(heads, "base").filter("pos <= h").select("entity_id", "pos", "mark", "n_words")
    return slim.filter(F.col("pos") > taken).unionByName(shared), entities


@query("op13_action_trie", REBUILT_TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns, entities = rebuilt_turns(table(spark, sf_dir, "conversations"))
    local = action_trie.shard_nodes(turns, ("pos",), entities)
    found = action_trie.action_trie(local).join(action_trie.end_digests(local), "key", "left")
    return found.select(
        F.col("entity_id").alias("conv_id"),
        "depth",
        F.col("parent_entity_id").alias("parent_conv_id"),
        F.col("n_entities").alias("n_convs"),
        "n_children",
        "n_leaves",
        F.col("saved_words").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
