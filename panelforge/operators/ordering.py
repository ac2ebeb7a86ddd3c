"""Exact ranks and percentiles without one task for a whole group.

Splitters come from a sketch of the values (bounded memory, merged across tasks). A value lies between two splitters or
on one; cells are counted, the counts summed in order, and a row's rank is the count of all cells before its own plus
its place inside. Cells on a splitter hold one value, so they are cut further along the tie order: a value that half of
the rows share is spread like any other. Percentiles rank only the cells that hold their places.

The sketch decides how even the cells are, never what the ranks are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CELLS = 64
TIE_CHUNK = 1 << 16


def _joined(rows: DataFrame, other: DataFrame, by: list[str]) -> DataFrame:
    """Rows with another table's one row per group."""
    return rows.join(F.broadcast(other), by) if by else rows.crossJoin(F.broadcast(other))


def _celled(rows: DataFrame, by: list[str], key: Column, tie: str | None, cells: int, tie_chunk: int) -> tuple[DataFrame, DataFrame]:
    """(rows with __key, __cell and __part, counts (by, __cell, __part, __n, __before)); null keys come last."""
    keyed = rows.withColumn("__key", key)
    shares = F.array(*[F.lit(i / cells) for i in range(1, cells)])
    splits = keyed.groupBy(*by).agg(F.array_sort(F.array_distinct(F.coalesce(F.percentile_approx("__key", shares, 100 * cells), F.array().cast("array<double>")))).alias("__splits"))
    below = 2 * F.size(F.filter("__splits", lambda s: s < F.col("__key")))
    on = F.array_contains("__splits", F.col("__key"))
    cell = F.when(F.col("__key").isNull(), F.lit(2 * cells)).otherwise(below + on.cast("int"))
    spread = F.floor(F.col(tie) / tie_chunk) if tie else F.pmod(F.xxhash64(*[c for c in rows.columns]), F.lit(cells))
    placed = _joined(keyed, splits, by).withColumn("__cell", cell).drop("__splits")
    placed = placed.withColumn("__part", F.when((F.col("__cell") % 2 == 1) | F.col("__key").isNull(), spread).otherwise(F.lit(0)).cast("long"))
    counts = placed.groupBy(*by, "__cell", "__part").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*by).orderBy("__cell", "__part").rowsBetween(Window.unboundedPreceding, -1)
    return placed, counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))


def _inside(by: list[str], tie: str | None) -> Window:
    return Window.partitionBy(*by, "__cell", "__part").orderBy(F.col("__key").asc_nulls_last(), *([tie] if tie else []))


def ranked(rows: DataFrame, by: list[str], key: Column, tie: str | None = None, name: str = "rank", cells: int = CELLS, tie_chunk: int = TIE_CHUNK) -> DataFrame:
    """Adds the rank from 1 in ascending order of a key (null last), then of tie, a number that tells equal keys apart;
    without one, equal keys stand in any order."""
    placed, counts = _celled(rows, by, key, tie, cells, tie_chunk)
    found = placed.withColumn("__row", F.row_number().over(_inside(by, tie))).join(counts.drop("__n"), [*by, "__cell", "__part"])
    return found.withColumn(name, F.col("__before") + F.col("__row")).select(*rows.columns, name)


def percentiles(rows: DataFrame, by: list[str], value: Column, wanted: dict[str, float], cells: int = CELLS) -> DataFrame:
    """(by, a column per name): exact percentiles of the values that are not null, interpolated between neighbours."""
    placed, counts = _celled(rows.select(*by, value.alias("__value")).where(F.col("__value").isNotNull()), by, F.col("__value"), None, cells, TIE_CHUNK)
    totals = counts.groupBy(*by).agg(F.sum("__n").alias("__total"))
    names = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(q).alias("q")) for n, q in wanted.items()])
    places = totals.withColumn("w", F.explode(names)).select(*by, "w.name", (F.col("w.q") * (F.col("__total") - 1)).alias("at"))
    ends = F.array_distinct(F.array(F.floor("at"), F.ceil("at")))
    places = places.withColumn("place", F.explode(ends))
    held = (F.col("place") >= F.col("__before")) & (F.col("place") < F.col("__before") + F.col("__n"))
    spots = (counts.join(places, by) if by else counts.crossJoin(places)).where(held)
    spots = spots.select(*by, "__cell", "__part", F.col("name"), "at", "place", (F.col("place") - F.col("__before") + 1).alias("__row"))
    near = placed.join(F.broadcast(spots.select(*by, "__cell", "__part").distinct()), [*by, "__cell", "__part"])
    near = near.withColumn("__row", F.row_number().over(_inside(by, None)))
    found = near.join(F.broadcast(spots), [*by, "__cell", "__part", "__row"])
    weight = F.when(F.col("place") == F.col("at"), 1.0).otherwise(1 - F.abs(F.col("place") - F.col("at")))
    of = lambda name: F.sum(F.when(F.col("name") == name, weight * F.col("__key"))).alias(name)
    return found.groupBy(*by).agg(*[of(name) for name in wanted])
