"""The fixed principal-component reference and the dominant indicator.

With S0 the mean training matrix, l1 its largest eigenvalue and P1 the projector on its eigenvector, the indicator is
z = <P1, S> and the one-indicator matrix is S0 + (z - l1) P1. Both are linear in the entries, need no matrix product
and no choice of eigenvector sign; only p*p averages ever reach the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.functions import matrix as mx
from panelforge.operators import ordering
from panelforge.operators.matrices import MatrixSeries, with_sample


@dataclass(frozen=True)
class Reference:
    assets: tuple[str, ...]
    covariance: np.ndarray
    eigenvalues: np.ndarray
    basis: np.ndarray

    @property
    def projector(self) -> np.ndarray:
        return np.outer(self.basis[:, 0], self.basis[:, 0])

    @property
    def rest(self) -> np.ndarray:
        """The reference without its leading component."""
        return self.covariance - self.eigenvalues[0] * self.projector


def reference_of(covariance: np.ndarray, assets: tuple[str, ...]) -> Reference:
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    return Reference(assets, covariance, values[::-1].copy(), vectors[:, ::-1].copy())


def mean_matrix(rows: DataFrame, p: int, m: str = "m") -> np.ndarray:
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    row = rows.agg(*[F.avg(mx.at(F.col(m), i, j, p)) for i, j in upper]).first()
    if row[0] is None:
        raise ValueError("no training matrices")
    mean = np.zeros((p, p))
    for (i, j), value in zip(upper, row, strict=True):
        mean[i, j] = mean[j, i] = value
    return mean


def fit_reference(series: MatrixSeries, training: int) -> Reference:
    """From the first `training` matrices only."""
    return reference_of(mean_matrix(series.rows.where(F.col("k") < training), series.p), series.assets)


def covariance_rows(spark: SparkSession, reference: Reference) -> DataFrame:
    p = len(reference.assets)
    rows = [(reference.assets[i], reference.assets[j], float(reference.covariance[i, j])) for i, j in mx.entries(p)]
    return spark.createDataFrame(rows, "i string, j string, v double")


def pca_table(spark: SparkSession, reference: Reference) -> DataFrame:
    """Eigenvalues and their shares in per cent."""
    total = float(reference.eigenvalues.sum())
    if total <= 0:
        raise ValueError("the eigenvalues must have a positive sum")
    rows = [(f"component_{k + 1}", float(v), 100 * float(v) / total) for k, v in enumerate(reference.eigenvalues)]
    return spark.createDataFrame(rows, "component string, eigenvalue double, share_pct double")


def indicator(series: MatrixSeries, reference: Reference) -> DataFrame:
    """(k, ts, m, z)"""
    return series.rows.withColumn("z", mx.inner(F.col("m"), reference.projector))


def from_indicator(reference: Reference, z) -> F.Column:
    """The one-indicator covariance of an indicator value, negative ones included."""
    return mx.affine(reference.rest, z, reference.projector)


def in_basis(series: MatrixSeries, reference: Reference) -> DataFrame:
    """(k, ts, m): matrices in the coordinates of the reference basis."""
    return series.rows.select("k", "ts", mx.congruence(F.col("m"), reference.basis, series.p).alias("m"))


def approximation_errors(series: MatrixSeries, reference: Reference, training: int) -> DataFrame:
    """(k, ts, sample, m, z, approx, e): the one-indicator approximation and what it leaves."""
    rows = indicator(series, reference).withColumn("approx", from_indicator(reference, F.col("z")))
    return with_sample(rows.withColumn("e", mx.minus(F.col("m"), F.col("approx"), series.p)), training)


def interval_errors(errors: DataFrame, p: int) -> DataFrame:
    """(k, ts, sample, norm_e, norm_s, interval_error); a matrix without norm has no relative error and is refused."""
    rows = errors.select("k", "ts", "sample", mx.frobenius(F.col("e"), p).alias("norm_e"), mx.frobenius(F.col("m"), p).alias("norm_s"))
    checked = F.when(F.col("norm_s") > 0, F.col("norm_e") / F.col("norm_s")).otherwise(F.raise_error(F.lit("a matrix has zero norm")).cast("double"))
    return rows.withColumn("interval_error", checked)


def approximation_summary(errors: DataFrame, p: int) -> DataFrame:
    """Aggregated, mean, median, 95th percentile (linear interpolation) and maximum relative error per sample."""
    e = F.col("interval_error")
    rows = interval_errors(errors, p)
    sums = rows.groupBy("sample").agg(
        F.sqrt(F.sum(F.col("norm_e") * F.col("norm_e")) / F.sum(F.col("norm_s") * F.col("norm_s"))).alias("aggregated"),
        F.avg(e).alias("mean"), F.max(e).alias("max"),
    )
    found = ordering.percentiles(rows, ["sample"], e, {"median": 0.5, "p95": 0.95})
    return sums.join(F.broadcast(found), "sample").select("sample", "aggregated", "mean", "median", "p95", "max")
