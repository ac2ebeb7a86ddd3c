"""The data behind each figure; drawing is left to others."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.operators import ordering
from panelforge.sources.panels import Panel


def daily_normalised_close(panel: Panel, unit: str = "day") -> DataFrame:
    """(day, asset, close, normalised): the last price of each day, the first day being 100."""
    days = panel.rows.groupBy("asset", F.date_trunc(unit, "ts").alias("day")).agg(F.max_by("price", "ts").alias("close"))
    first = days.groupBy("asset").agg(F.min_by("close", "day").alias("__first"))
    return days.join(F.broadcast(first), "asset").select("day", "asset", "close", (F.col("close") / F.col("__first") * 100).alias("normalised"))


def indicator_path(indicator: DataFrame, scale: float = 1e6) -> DataFrame:
    return indicator.select("k", "ts", (F.col("z") * scale).alias("scaled"))


def cdf_markers(errors: DataFrame) -> DataFrame:
    """Median and 95th percentile of the relative errors in per cent, per sample."""
    return ordering.percentiles(errors, ["sample"], F.col("interval_error") * 100, {"median_pct": 0.5, "p95_pct": 0.95})


def check_before_plotting(pca: DataFrame, psd: DataFrame) -> DataFrame:
    """One row of violations: variance shares that do not sum to one, and indefinite forecasts."""
    shares = pca.agg(F.when(F.abs(F.sum("share_pct") - 100) > 1e-8, 1).otherwise(0).alias("bad_shares"))
    return shares.crossJoin(psd.agg(F.sum("n_non_psd").alias("non_psd")))
