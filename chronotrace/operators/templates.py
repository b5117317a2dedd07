"""Alignment of action sequences of any length with templates.

One action changes the row of an alignment table by a matrix in the (max, +) sense: entry (i, j) is what it
gains to go from i template steps behind to j. The change made by a slice of a sequence is the product of
the matrices of its actions, a few hundred numbers for all templates together, and products of slices
multiply on. So slices of one sequence are worked out in parallel and joined in a tree, and the outcome is
that of one pass over the whole sequence.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chronotrace.functions.actions import LEADING_ACTION, LEADING_TEMPLATE, PATH_TEMPLATES, SKIP_ACTION, SKIP_OPTIONAL, SKIP_TEMPLATE, PathTemplate, _Likeness
from chronotrace.operators.ordered import Lane
from chronotrace.operators.stateful import schema_ddl, whole_groups
from chronotrace.operators.temporal_graph import sequence_text

SLICE_ACTIONS = 1000
FAN = 32  # slices joined at a time
TOGETHER = 256  # sequences worked on at a time


class Steps:
    """Matrices of all templates, padded to the longest: (template, steps before, steps after)."""

    def __init__(self, templates: list[PathTemplate]):
        self.m = np.array([len(t.actions) for t in templates])
        self.width = int(self.m.max(initial=0)) + 1
        self.templates, self.cheap = templates, [{o.lower() for o in t.optional} for t in templates]
        self.like, self.rows = _Likeness(), {}

    def unit(self, n: int) -> np.ndarray:
        """What no action does to a row: nothing."""
        one = np.where(np.eye(self.width, dtype=bool), 0.0, -np.inf)
        return np.broadcast_to(one, (n, len(self.m), self.width, self.width)).copy()

    def of(self, action: str) -> tuple[np.ndarray, np.ndarray]:
        """Likeness to each step, and the cost of skipping the action, by template."""
        if action not in self.rows:
            hit = np.full((len(self.m), self.width - 1), -np.inf)
            for i, t in enumerate(self.templates):
                hit[i, : len(t.actions)] = [self.like[action, s] for s in t.actions]
            cost = np.array([SKIP_OPTIONAL if action.lower() in c else SKIP_ACTION for c in self.cheap])
            self.rows[action] = hit, cost
        return self.rows[action]

    def follow(self, rows: np.ndarray, hit: np.ndarray, cost: np.ndarray) -> np.ndarray:
        """Rows (sequence, template, start, step) after one more action of each sequence."""
        out = rows - cost[:, :, None, None]
        out[..., 0] = rows[..., 0] - LEADING_ACTION
        np.maximum(out[..., 1:], rows[..., :-1] + hit[:, :, None, :], out=out[..., 1:])
        slide = SKIP_TEMPLATE * np.arange(self.width)
        return np.maximum.accumulate(out + slide, axis=-1) - slide

    def products(self, sequences: list[list[str]]) -> np.ndarray:
        """Product of each sequence, all sequences action by action."""
        out = self.unit(len(sequences))
        order = sorted(range(len(sequences)), key=lambda i: -len(sequences[i]))
        longest = len(sequences[order[0]]) if order else 0
        for k in range(longest):
            live = [i for i in order if len(sequences[i]) > k]
            order = live
            found = [self.of(sequences[i][k]) for i in live]
            out[live] = self.follow(out[live], np.stack([f[0] for f in found]), np.stack([f[1] for f in found]))
        return out

    def score(self, product: np.ndarray, n: int) -> list[float]:
        """Scaled score of each template: from an empty sequence, whose row is the cost of skipped steps."""
        start = -LEADING_TEMPLATE * np.arange(self.width)
        last = (start[None, :, None] + product).max(1)[np.arange(len(self.m)), self.m]
        most = np.minimum(n, self.m)
        return np.where(most > 0, np.clip(last / np.maximum(most, 1), 0.0, 1.0), 0.0).tolist()


def _joined(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product in the (max, +) sense, template by template."""
    return (a[:, :, :, None] + b[:, None, :, :]).max(2)


def _slice_products(templates: list[PathTemplate]):
    @F.pandas_udf("array<double>")
    def products(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        steps = Steps(templates)
        for seqs in batches:
            for at in range(0, len(seqs), TOGETHER):  # given back at once: a product has hundreds of numbers
                some = [["" if a is None else a for a in s] for s in seqs.iloc[at : at + TOGETHER]]
                yield pd.Series([p.ravel() for p in steps.products(some)], dtype=object)

    return products


def _join_products(templates: list[PathTemplate], keys: list[str]):
    """Product of each group of rows in order, as they stream by."""
    shape = (len(templates), *[max((len(t.actions) for t in templates), default=0) + 1] * 2)

    def join(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf, bounds in whole_groups(batches, [*keys, "up"]):
            n, parts = pdf["n"].to_numpy(), pdf["product"].to_numpy()
            for at in range(0, len(bounds) - 1, TOGETHER):
                some = list(zip(bounds[at : at + TOGETHER], bounds[at + 1 : at + TOGETHER + 1]))
                products = [reduce(_joined, (np.asarray(p, dtype=float).reshape(shape) for p in parts[lo:hi])).ravel() for lo, hi in some]
                firsts = pdf.iloc[[lo for lo, _ in some]]
                yield firsts[[*keys, "up"]].rename(columns={"up": "at"}).assign(n=[int(n[lo:hi].sum()) for lo, hi in some], product=products)

    return join


def _scores(templates: list[PathTemplate]):
    @F.pandas_udf("array<double>")
    def scores(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        steps = Steps(templates)
        shape = (len(templates), steps.width, steps.width)
        for products, n in batches:
            yield pd.Series([steps.score(np.asarray(p, dtype=float).reshape(shape), k) for p, k in zip(products, n)], dtype=object)

    return scores


def template_alignment(nodes: DataFrame, lane: Lane, value: str, templates: list[PathTemplate] = PATH_TEMPLATES, slice_actions: int = SLICE_ACTIONS, fan: int = FAN) -> DataFrame:
    """Keys of the lane, ``num_actions`` and ``scores``, an alignment score per template in their order, for
    each sequence as a whole. A null action is an empty one; keys without rows have no result."""
    pages = sequence_text(nodes, lane, value, page=slice_actions)
    keys = list(lane.keys)
    d = pages.select(*keys, F.col("page").alias("at"), F.size("sequence").cast("long").alias("n"), _slice_products(templates)("sequence").alias("product"))
    ddl = schema_ddl(d.schema)
    span = (pages.agg(F.max("page").alias("page")).first()["page"] or 0) + 1
    while span > 1:
        up = d.withColumn("up", F.floor(F.col("at") / fan))
        up = up.repartition(*keys, "up").sortWithinPartitions(*keys, "up", "at")
        d = up.mapInPandas(_join_products(templates, keys), ddl)
        span = -(-span // fan)
    return d.select(*keys, F.col("n").alias("num_actions"), _scores(templates)("product", "n").alias("scores"))


def path_anomaly(score: Column, num_actions: Column) -> Column:
    """How far a path is from its best template: 0 for paths of under three actions, one half where no
    template fits at all."""
    return F.when(num_actions < 3, 0.0).when(score.isNull(), 0.5).otherwise(1 - score)
