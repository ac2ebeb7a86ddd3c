"""Positions, lags and log returns of ordered tables, without one task for the whole order.

Positions come from counts per time bucket: bucket totals are prefix-summed (one row per bucket), and rows are
numbered inside their bucket. Lags run in chunks of positions; the last rows of a chunk also travel to the next one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.sources.panels import Panel

CHUNK = 1 << 16


def with_positions(rows: DataFrame, ts: str = "ts", bucket: str = "month") -> DataFrame:
    """Adds pos, the 0-based place in time order (timestamps are distinct)."""
    cells = rows.withColumn("__cell", F.date_trunc(bucket, ts))
    counts = cells.groupBy("__cell").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("__cell", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__cell").orderBy(ts))
    placed = cells.withColumn("__row", inside).join(F.broadcast(counts), "__cell")  # else the rows may be what is broadcast
    return placed.withColumn("pos", F.col("__before") + F.col("__row") - 1).drop("__cell", "__row", "__before")


def with_lags(rows: DataFrame, lags: dict[str, tuple[str, int]], by: list[str] | None = None, pos: str = "pos", chunk: int = CHUNK) -> DataFrame:
    """Adds lagged columns, name -> (column, lag), in the order of pos, a gapless number within each `by` group."""
    by = by or []
    reach = max(lag for _, lag in lags.values())
    if not 0 < reach < chunk:
        raise ValueError("lags must be positive and below the chunk size")
    own = F.floor(F.col(pos) / chunk)
    near_end = F.col(pos) % chunk >= chunk - reach
    dealt = rows.withColumn("__chunk", F.explode(F.when(near_end, F.array(own, own + 1)).otherwise(F.array(own))))
    window = Window.partitionBy(*by, "__chunk").orderBy(pos)
    dealt = dealt.withColumns({name: F.lag(column, lag).over(window) for name, (column, lag) in lags.items()})
    return dealt.where(F.col("__chunk") == own).drop("__chunk")


def running_total(rows: DataFrame, column: str, name: str, by: list[str] | None = None, pos: str = "pos", chunk: int = CHUNK) -> DataFrame:
    """Adds the cumulative sum in the order of pos: chunk totals are prefix-summed, rows are summed inside chunks."""
    by = by or []
    cells = rows.withColumn("__chunk", F.floor(F.col(pos) / chunk))
    before = Window.partitionBy(*by).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = cells.groupBy(*by, "__chunk").agg(F.sum(column).alias("__sum"))
    totals = totals.withColumn("__base", F.coalesce(F.sum("__sum").over(before), F.lit(0.0))).drop("__sum")
    inside = Window.partitionBy(*by, "__chunk").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    summed = cells.withColumn("__inside", F.sum(column).over(inside)).join(totals, [*by, "__chunk"])
    return summed.withColumn(name, F.col("__base") + F.col("__inside")).drop("__chunk", "__inside", "__base")


def log_returns(panel: Panel) -> DataFrame:
    """(pos, ts, r array): differences of log prices; the first timestamp has none, so pos starts at 1."""
    logs = with_positions(panel.wide).select("pos", "ts", F.transform("price", lambda x: F.ln(x)).alias("__log"))
    lagged = with_lags(logs, {"__before": ("__log", 1)}).where("pos >= 1")
    r = F.array(*[F.get("__log", F.lit(i)) - F.get("__before", F.lit(i)) for i in range(len(panel.assets))])
    return lagged.select("pos", "ts", r.alias("r"))


def by_asset(rows: DataFrame, column: str, assets: tuple[str, ...], name: str) -> DataFrame:
    """Long form of an array column: one row per asset."""
    labels = F.array(*[F.lit(a) for a in assets])
    kept: list[Column] = [F.col(c) for c in rows.columns if c != column]
    return rows.select(*kept, F.posexplode(column).alias("__k", name)).withColumn("asset", F.element_at(labels, F.col("__k") + 1)).drop("__k")


def correlation(one: str, other: str) -> Column:
    """The correlation of two columns over rows that have both; null where either has no spread."""
    both = F.col(one).isNotNull() & F.col(other).isNotNull()
    x, y = F.when(both, F.col(one)), F.when(both, F.col(other))
    spread = (F.min(x) < F.max(x)) & (F.min(y) < F.max(y))
    return F.when(spread, F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)))


def audit(panel: Panel, block_size: int) -> DataFrame:
    """Counts of the whole design: prices, returns, complete blocks, what falls behind, incomplete timestamps."""
    complete = panel.wide.agg(F.count(F.lit(1)).alias("n_prices"))
    stamps = panel.rows.agg(F.countDistinct("ts").alias("n_stamps"))
    returns = F.greatest(F.col("n_prices") - 1, F.lit(0))
    blocks = F.floor(returns / block_size)
    return complete.crossJoin(stamps).select(
        "n_prices", returns.alias("n_returns"), (blocks * block_size).alias("n_in_blocks"), (returns - blocks * block_size).alias("n_trailing"),
        blocks.alias("n_matrices"), (F.col("n_stamps") - F.col("n_prices")).alias("n_incomplete"),
    )
