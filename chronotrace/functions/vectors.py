"""Vector columns as ``array<float|double>``: everything stays in JVM expressions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    prods = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(prods, F.lit(0.0), lambda s, v: s + v)


def sq_l2(a: Column, b: Column) -> Column:
    def sq(x, y):
        d = x.cast("double") - y.cast("double")
        return d * d

    return F.aggregate(F.zip_with(a, b, sq), F.lit(0.0), lambda s, v: s + v)


def l2(a: Column, b: Column) -> Column:
    return F.sqrt(sq_l2(a, b))


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def cosine(a: Column, b: Column, eps: float = 1e-6) -> Column:
    """Dot product over the product of norms, guarded by ``eps`` on the product."""
    return dot(a, b) / (norm(a) * norm(b) + F.lit(eps))


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def weighted_sum(vec: str, weight: Column | None = None) -> Column:
    """Aggregate: element-wise (weighted) sum of array vectors; combines before the shuffle."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = array_to_vector(F.col(vec))
    return vector_to_array(Summarizer.sum(v) if weight is None else Summarizer.sum(v, weight))


def scale(a: Column, k) -> Column:
    k = k if isinstance(k, Column) else F.lit(float(k))
    return F.transform(a, lambda x: x.cast("double") * k)


def normalise(a: Column, eps: float = 0.0) -> Column:
    """Unit vector. With ``eps`` the norm is padded, otherwise a zero vector stays zero."""
    pair = F.struct(a.alias("v"), (norm(a) + F.lit(eps)).alias("n"))
    return let(pair, lambda p: F.transform(p["v"], lambda x: F.when(p["n"] > 0, x.cast("double") / p["n"]).otherwise(0.0)))


def weighted_concat(a: Column, wa: float, b: Column, wb: float) -> Column:
    return F.concat(scale(a, wa), scale(b, wb))


def add_scaled(a: Column, ka: float, b: Column, kb: float) -> Column:
    return F.zip_with(a, b, lambda x, y: x.cast("double") * ka + y.cast("double") * kb)


def orthogonal_basis(rows: int, cols: int, seed: int) -> list[list[float]]:
    """``rows`` orthonormal row vectors of length ``cols`` from a seeded Gaussian matrix."""
    g = np.random.RandomState(seed).standard_normal((cols, cols))
    q, _ = np.linalg.qr(g)
    return q[:rows].tolist()


def project(a: Column, matrix: list[list[float]]) -> Column:
    """Row vector times a small constant matrix (rows = input size)."""
    cols = [F.array(*[F.lit(float(r[j])) for r in matrix]) for j in range(len(matrix[0]))]
    return F.array(*[dot(a, c) for c in cols])


def two_class_probability(s_pos: Column, s_neg: Column, temperature: float = 100.0) -> Column:
    """Softmax of two prototype similarities, written as a logistic of their difference."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-F.lit(temperature) * (s_pos - s_neg)))
