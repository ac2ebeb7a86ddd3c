"""One-step covariance forecasts as one long table (method, k, ts, m, f): every method is a branch of a union, so a
single aggregation evaluates them all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions import matrix as mx
from panelforge.operators.matrices import MatrixSeries
from panelforge.operators.panel import with_lags
from panelforge.operators.reference import Reference, from_indicator, indicator

DIRECT, NAIVE, ARFIMA = "direct_naive", "naive_indicator", "arfima_indicator"


def check_training_size(training: int, matrices: int) -> None:
    if isinstance(training, bool) or not isinstance(training, int):
        raise TypeError("the training size must be an integer")
    if not 0 < training < matrices:
        raise ValueError("the training size must lie strictly between zero and the number of matrices")


def direct_naive(series: MatrixSeries, training: int) -> DataFrame:
    """(k, ts, m, f): the previous matrix. The lag comes before the filter: the first holdout forecast is the last
    training matrix."""
    return with_lags(series.rows, {"f": ("m", 1)}, pos="k").where(F.col("k") >= training).select("k", "ts", "m", "f")


def naive_indicator(series: MatrixSeries, reference: Reference, training: int) -> DataFrame:
    """(k, ts, m, z, z_hat, f): the previous indicator, mapped to a covariance."""
    lagged = with_lags(indicator(series, reference), {"z_hat": ("z", 1)}, pos="k").where(F.col("k") >= training)
    return lagged.withColumn("f", from_indicator(reference, F.col("z_hat"))).select("k", "ts", "m", "z", "z_hat", "f")


def indicator_forecast(series: MatrixSeries, reference: Reference, forecasts: DataFrame) -> DataFrame:
    """(k, ts, m, z_hat, f) from rows (k, z_hat)."""
    joined = series.rows.join(forecasts.select("k", "z_hat").hint("merge"), "k")
    return joined.withColumn("f", from_indicator(reference, F.col("z_hat"))).select("k", "ts", "m", "z_hat", "f")


def methods(parts: dict[str, DataFrame], p: int) -> DataFrame:
    """(method, k, ts, m, f, e) with e the actual matrix minus its forecast."""
    tables = [rows.select(F.lit(name).alias("method"), "k", "ts", "m", "f") for name, rows in parts.items()]
    return reduce(DataFrame.unionByName, tables).withColumn("e", mx.minus(F.col("m"), F.col("f"), p))


def unmatched(forecasts: DataFrame, targets: DataFrame) -> DataFrame:
    """The alignment guard: places that only one side has, or whose forecast has nulls. No rows means aligned."""
    a = forecasts.select("k", F.lit(True).alias("here"), F.exists("f", lambda x: x.isNull() | F.isnan(x)).alias("hole"))
    b = targets.select("k", F.lit(True).alias("there"))
    return a.join(b, "k", "full_outer").where(F.col("here").isNull() | F.col("there").isNull() | F.col("hole"))
