"""User-supplied scorers: batch inference with retries and fallback rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Scorer = Callable[[pd.DataFrame], pd.DataFrame]


def score(df: DataFrame, load: Callable[[], Scorer], columns: str, key: str, fallback: dict, retries: int = 2) -> DataFrame:
    """Apply a scorer to Arrow batches of rows.

    ``load`` runs once per task and returns the scorer; the scorer maps a batch to a frame
    with the result columns in the batch's row order. A batch that keeps
    failing is halved until the failing rows stand alone; those get ``fallback`` and the status
    ``fallback``.
    """
    names = list(fallback)
    key_type = df.schema[key].dataType.simpleString()

    def call(fn: Scorer, pdf: pd.DataFrame) -> pd.DataFrame | None:
        for _ in range(retries + 1):
            try:
                res = fn(pdf)
                if len(res) == len(pdf):
                    return res[names].reset_index(drop=True)
            except Exception:
                continue
        return None

    def attempt(fn: Scorer, pdf: pd.DataFrame) -> list[pd.DataFrame]:
        res = call(fn, pdf)
        if res is not None:
            return [res.assign(**{key: pdf[key], "status": "ok"})]
        if len(pdf) == 1:
            return [pd.DataFrame([fallback]).assign(**{key: pdf[key], "status": "fallback"})]
        half = len(pdf) // 2
        return [p for part in (pdf.iloc[:half], pdf.iloc[half:]) for p in attempt(fn, part.reset_index(drop=True))]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = load()
        for pdf in batches:
            if len(pdf):
                yield pd.concat(attempt(fn, pdf.reset_index(drop=True)))[[key, *names, "status"]]

    return df.mapInPandas(run, f"{key} {key_type}, {columns}, status string")
