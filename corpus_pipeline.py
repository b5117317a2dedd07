"""Documents to packed token sequences in five stages; each works on all that the one before kept.

language ID -> one of each group of near duplicates -> secrets masked -> sources mixed to weights ->
best-two-fit packing. Every stage but the last returns the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chronotrace.llm import language, ngram_join, packing, secrets, source_mix
from chronotrace.llm.ngram_join import stored

#: Rows that go to Python at a time: texts are long, and an executor holds a few such batches per task.
BATCH_ROWS = "1000"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _texts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The columns of ``documents``; from here on the session sends small batches to Python."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return docs.select(*COLUMNS)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text is in one of the languages of ``lang``; texts without a letter and those that
    no language model knows go."""
    docs = _texts(spark, docs)
    model = language.fit_language_model(docs, id_col="doc_id", text_col="text", lang_col="lang")
    return language.accepted(docs, model, text_col="text")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that links of 0.8 or more on five-word shingles hold together."""
    return ngram_join.one_per_group(_texts(spark, docs), id_col="doc_id", text_col="text", width=5, percent=80)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced; ``n_chars`` follows the text."""
    found = secrets.masked(_texts(spark, docs), text_col="text")
    return found.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the source schedule takes them."""
    return source_mix.mixed_rows(_texts(spark, docs), id_col="doc_id", text_col="text", category_col="source")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents and their places in sequences of 1,024 tokens."""
    return packing.pack_narratives(docs, id_col="doc_id", text_col="text").withColumnRenamed("video_id", "doc_id")


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_near_duplicates", drop_near_duplicates),
    ("secret_scan", mask_secrets),
    ("source_mix", mix_sources),
    ("two_fit_packing", pack),
]
#: Character models and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
