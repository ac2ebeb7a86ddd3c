"""Checks that must come out empty: each returns one row of violation counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions import matrix as mx
from panelforge.operators.matrices import MatrixSeries
from panelforge.operators.panel import with_lags


def naive_violations(series: MatrixSeries, forecasts: DataFrame) -> DataFrame:
    """Forecasts (k, f) that are not the previous matrix."""
    before = with_lags(series.rows, {"__before": ("m", 1)}, pos="k").select("k", "__before")
    return forecasts.select("k", "f").join(before, "k").agg(F.sum(F.when(F.col("f") == F.col("__before"), 0).otherwise(1)).alias("violations"))


def finite_violations(forecasts: DataFrame) -> DataFrame:
    bad = F.exists("f", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return forecasts.agg(F.sum(F.when(bad, 1).otherwise(0)).alias("violations"))


def off_diagonal_violations(base: DataFrame, corrected: DataFrame, p: int, tolerance: float = 0.0) -> DataFrame:
    """Corrections must leave off-diagonal entries alone."""
    joined = base.select("k", F.col("f").alias("__f")).join(corrected.select("k", "f"), "k")
    moved = mx.off_diagonal_squares(mx.minus(F.col("f"), F.col("__f"), p), p)
    return joined.agg(F.sum(F.when(moved > tolerance, 1).otherwise(0)).alias("violations"))


def oracle_diagonal_violations(forecasts: DataFrame, p: int, tolerance: float = 1e-20) -> DataFrame:
    """With the true coefficients as corrections, the diagonal is recovered."""
    return forecasts.agg(F.sum(F.when(mx.diagonal_squares(F.col("e"), p) > tolerance, 1).otherwise(0)).alias("violations"))


def loss_violations(losses: DataFrame) -> DataFrame:
    """Losses must be finite, not negative, and the overall one the sum of its parts."""
    off = F.abs(F.col("overall") - F.col("diagonal") - F.col("off_diagonal")) > 1e-12 * F.greatest(F.col("overall"), F.lit(1e-300))
    bad = F.col("overall").isNull() | F.isnan("overall") | (F.col("diagonal") < 0) | (F.col("off_diagonal") < 0) | off
    return losses.agg(F.sum(F.when(bad, 1).otherwise(0)).alias("violations"))


def fit_violations(fits: DataFrame, means: DataFrame, training: int) -> DataFrame:
    """Fractional fits (series, mean, d, positive_frequency_count) must use the training part's mean and frequencies
    only, and keep d inside the open interval of stationary models. means: (series, mean, size), size being the mean
    absolute value, against which rounding counts."""
    joined = fits.join(means.select("series", F.col("mean").alias("__mean"), F.col("size").alias("__size")), "series", "left")
    off = F.abs(F.col("mean") - F.col("__mean")) > 1e-9 * F.col("__size")
    bad = F.col("__mean").isNull() | off | (F.col("positive_frequency_count") != (training - 1) // 2) | (F.abs("d") >= 0.5)
    return joined.agg(F.sum(F.when(bad, 1).otherwise(0)).alias("violations"))


def future_dependence(first: DataFrame, changed: DataFrame, until: int, tolerance: float = 1e-9) -> DataFrame:
    """Forecasts up to `until` from two series that agree before it must agree, but for the rounding of long
    convolutions."""
    keys = ["series", "pos"]
    joined = first.select(*keys, F.col("z_hat").alias("__a")).join(changed.select(*keys, F.col("z_hat").alias("__b")), keys).where(F.col("pos") <= until)
    return joined.agg(F.sum(F.when(F.abs(F.col("__a") - F.col("__b")) <= tolerance * F.greatest(F.abs("__a"), F.lit(1.0)), 0).otherwise(1)).alias("violations"))
