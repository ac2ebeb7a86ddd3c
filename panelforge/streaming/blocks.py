"""An extension: block covariances of a price stream. Blocks are event-time windows of returns; a window is emitted
when the watermark passes it and counts only if complete, as in the batch rule."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions import matrix as mx


def streaming_block_covariances(returns: DataFrame, assets: tuple[str, ...], minutes: int, delay: str = "10 minutes") -> DataFrame:
    """(ts, m) from a stream (ts, r array) of one-minute returns: windows are closed on the left and start one minute
    past the block boundary, where a block's first return stands."""
    p = len(assets)
    upper = {(i, j): f"__c{i}_{j}" for i in range(p) for j in range(i, p)}
    window = F.window("ts", f"{minutes} minutes", f"{minutes} minutes", "1 minute")
    grouped = returns.withWatermark("ts", delay).groupBy(window.alias("w")).agg(
        F.max("ts").alias("ts"), F.count(F.lit(1)).alias("__n"),
        *[F.covar_samp(F.get("r", F.lit(i)), F.get("r", F.lit(j))).alias(name) for (i, j), name in upper.items()],
    )
    m = F.array(*[F.col(upper[min(i, j), max(i, j)]) for i, j in mx.entries(p)])
    return grouped.where(F.col("__n") == minutes).select("ts", m.alias("m"))
