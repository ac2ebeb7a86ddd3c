"""Expressions on matrices stored as row-major arrays of p*p doubles. The size p is known when the plan is built, so
everything is plain arithmetic inside whole-stage code generation; no row leaves the JVM."""

from __future__ import annotations

import math
from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SQRT_TINY = 2.2250738585072014e-308


def at(m: Column, i: int, j: int, p: int) -> Column:
    return F.get(m, F.lit(i * p + j))


def total(terms: list[Column]) -> Column:
    return reduce(add, terms)


def zipped(a: Column, b: Column, p: int, change) -> Column:
    return F.array(*[change(F.get(a, F.lit(k)), F.get(b, F.lit(k))) for k in range(p * p)])


def minus(a: Column, b: Column, p: int) -> Column:
    return zipped(a, b, p, lambda x, y: x - y)


def squares(m: Column, p: int) -> Column:
    """Sum of squared entries."""
    return total([F.get(m, F.lit(k)) * F.get(m, F.lit(k)) for k in range(p * p)])


def diagonal_squares(m: Column, p: int) -> Column:
    return total([at(m, i, i, p) * at(m, i, i, p) for i in range(p)])


def off_diagonal_squares(m: Column, p: int) -> Column:
    """Summed on its own, not as a difference, so that nothing cancels."""
    return total([at(m, i, j, p) * at(m, i, j, p) for i in range(p) for j in range(p) if i != j])


def frobenius(m: Column, p: int) -> Column:
    return F.sqrt(squares(m, p))


def inner(m: Column, fixed: np.ndarray) -> Column:
    """Sum of entries weighted by a fixed matrix."""
    flat = np.asarray(fixed, float).ravel()
    return total([F.get(m, F.lit(k)) * F.lit(float(w)) for k, w in enumerate(flat)])


def affine(fixed: np.ndarray, factor: Column, direction: np.ndarray) -> Column:
    """fixed + factor * direction, entry by entry."""
    return F.array(*[F.lit(float(a)) + factor * F.lit(float(d)) for a, d in zip(np.ravel(fixed), np.ravel(direction), strict=True)])


def congruence(m: Column, basis: np.ndarray, p: int) -> Column:
    """basis' m basis with a fixed basis (p x q), as q*q entries."""
    q = basis.shape[1]
    return F.array(
        *[total([at(m, i, j, p) * F.lit(float(basis[i, a] * basis[j, b])) for i in range(p) for j in range(p)]) for a in range(q) for b in range(q)]
    )


def congruence_diagonal(m: Column, basis: np.ndarray, p: int) -> Column:
    q = basis.shape[1]
    return F.array(*[total([at(m, i, j, p) * F.lit(float(basis[i, a] * basis[j, a])) for i in range(p) for j in range(p)]) for a in range(q)])


def from_diagonal(values: Column, basis: np.ndarray) -> Column:
    """basis diag(values) basis' with a fixed basis."""
    p, q = basis.shape
    return F.array(*[total([F.get(values, F.lit(k)) * F.lit(float(basis[i, k] * basis[j, k])) for k in range(q)]) for i in range(p) for j in range(p)])


def diagonal(m: Column, p: int) -> Column:
    return F.array(*[at(m, i, i, p) for i in range(p)])


def diagonal_matrix(values: Column, p: int) -> Column:
    return F.array(*[F.get(values, F.lit(i)) if i == j else F.lit(0.0) for i in range(p) for j in range(p)])


def eigenvalues_3(m: Column) -> Column:
    """Descending eigenvalues of a symmetric 3 x 3 matrix by the cosine formula; a multiple of the identity is its
    own case, as the formula would divide by zero."""
    e = lambda i, j: at(m, i, j, 3)
    mean = (e(0, 0) + e(1, 1) + e(2, 2)) / 3
    a, b, c = e(0, 0) - mean, e(1, 1) - mean, e(2, 2) - mean
    off = e(0, 1) * e(0, 1) + e(0, 2) * e(0, 2) + e(1, 2) * e(1, 2)
    spread = F.sqrt((a * a + b * b + c * c + 2 * off) / 6)
    determinant = a * (b * c - e(1, 2) * e(1, 2)) - e(0, 1) * (e(0, 1) * c - e(1, 2) * e(0, 2)) + e(0, 2) * (e(0, 1) * e(1, 2) - b * e(0, 2))
    ratio = F.try_divide(determinant, 2 * spread * spread * spread)
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), ratio))) / 3
    first = mean + 2 * spread * F.cos(angle)
    last = mean + 2 * spread * F.cos(angle + 2 * math.pi / 3)
    return F.when(ratio.isNull(), F.array(mean, mean, mean)).otherwise(F.array(first, 3 * mean - first - last, last))


def eigenvalues_2(m: Column) -> Column:
    half, gap = (at(m, 0, 0, 2) + at(m, 1, 1, 2)) / 2, (at(m, 0, 0, 2) - at(m, 1, 1, 2)) / 2
    root = F.sqrt(gap * gap + at(m, 0, 1, 2) * at(m, 0, 1, 2))
    return F.array(half + root, half - root)


def eigenvalues(m: Column, p: int) -> Column:
    """Descending eigenvalues of symmetric matrices: closed forms for p of 1 to 3, batched LAPACK through Arrow for
    larger ones."""
    if p == 1:
        return m
    if p in (2, 3):
        return eigenvalues_2(m) if p == 2 else eigenvalues_3(m)

    @F.pandas_udf("array<double>")
    def batched(series):
        import pandas as pd

        if not len(series):
            return pd.Series([], dtype=object)
        stack = np.stack(series.to_numpy()).reshape(-1, p, p)
        return pd.Series(list(np.linalg.eigvalsh(stack)[:, ::-1]))

    return batched(m)


def entries(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(p)]
