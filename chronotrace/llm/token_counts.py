"""Exact length histogram of narratives in tokens, with suffix sums for every context limit."""

from __future__ import annotations

from collections import Counter
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronotrace.llm.tokens import default_path, encoder
from chronotrace.operators.ordered import Lane, running
from chronotrace.session import cut


def _count_lengths(path: str):
    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            enc = encoder(path)
            seen.update(enc.count(t.as_py()) for t in batch.column(0))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], ["n_tokens", "n"])

    return count


def length_histogram(narratives: DataFrame, text_col: str = "narrative", tokenizer_path: str | None = None) -> DataFrame:
    """``n_tokens, n_narratives``: each task counts its own lengths before anything is shuffled.

    A null or empty text has length 0; repeated rows count each time.
    """
    d = narratives.select(F.col(text_col).alias("narrative")).mapInArrow(_count_lengths(tokenizer_path or default_path()), "n_tokens long, n long")
    return d.groupBy("n_tokens").agg(F.sum("n").alias("n_narratives"))


def token_counts(narratives: DataFrame, text_col: str = "narrative", tokenizer_path: str | None = None) -> DataFrame:
    """One row per length that occurs, read as a context limit of that many tokens.

    ``n_narratives`` have exactly this length and ``n_tokens_here`` tokens together; ``n_at_least``
    and ``tokens_at_least`` are suffix sums; ``truncated_total`` is the number of tokens left when
    every narrative is cut at this limit; ``lost_total`` the tokens cut off; ``share_within`` the part
    of narratives not cut, so the quantile q is the least length with ``share_within >= q``. Lengths
    are summed in slices. An empty table gives an empty result.
    """
    h = cut(length_histogram(narratives, text_col, tokenizer_path)).withColumn("mass", F.col("n_tokens") * F.col("n_narratives"))
    h = running(h, Lane((), ("n_tokens",), 1024), {"n_upto": ("sum", F.col("n_narratives")), "mass_upto": ("sum", F.col("mass"))})
    total = h.agg(F.sum("n_narratives").alias("n"), F.sum("mass").alias("m"))
    h = h.withColumns({"n_all": total.select("n").scalar(), "m_all": total.select("m").scalar()})
    more, longer = F.col("n_all") - F.col("n_upto"), F.col("m_all") - F.col("mass_upto")
    return h.select(
        "n_tokens",
        "n_narratives",
        F.col("mass").alias("n_tokens_here"),
        (more + F.col("n_narratives")).alias("n_at_least"),
        (longer + F.col("mass")).alias("tokens_at_least"),
        (F.col("mass_upto") + more * F.col("n_tokens")).alias("truncated_total"),
        (longer - more * F.col("n_tokens")).alias("lost_total"),
        (F.col("n_upto") / F.col("n_all")).alias("share_within"),
    )


def quantile_lengths(counts: DataFrame, points=(0.5, 0.9, 0.99)) -> DataFrame:
    """``q, n_tokens``: the least length that leaves at least a share q of the narratives whole."""
    rows = [counts.filter(F.col("share_within") >= q).agg(F.min("n_tokens").alias("n_tokens")).select(F.lit(float(q)).alias("q"), "n_tokens") for q in points]
    return reduce(DataFrame.unionByName, rows)


def total_within(counts: DataFrame, limit: int) -> DataFrame:
    """One row ``limit, truncated_total``: tokens left at any limit, also one that no length equals."""
    at = F.col("n_tokens") <= limit
    total = F.sum(F.when(at, F.col("n_tokens_here")).otherwise(F.col("n_narratives") * limit))
    return counts.agg(F.lit(limit).cast("long").alias("limit"), F.coalesce(total, F.lit(0)).alias("truncated_total"))
