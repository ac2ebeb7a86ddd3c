"""Validation of kline archives and of panels. Checks are aggregates; each returns its findings as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.config import ExperimentConfig
from panelforge.sources import klines as source

MINUTE_MS = 60_000
CHUNK = 1 << 16


def checksums(spark: SparkSession, directory: str) -> DataFrame:
    """(name, ok): the sidecar must read "hash name" exactly, name the archive (a leading * aside), and hold its
    SHA-256."""
    files = source.archives(spark, directory).select("name", F.sha2("content", 256).alias("actual"))
    sidecars = spark.read.format("binaryFile").option("pathGlobFilter", "*.CHECKSUM").option("recursiveFileLookup", "true").load(directory)
    parts = F.split(F.regexp_replace(F.decode("content", "UTF-8"), r"\s+$", ""), r"\s+")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.CHECKSUM$", "")
    said = sidecars.select(name.alias("name"), parts.alias("parts"))
    ok = (F.size("parts") == 2) & (F.regexp_replace(F.get("parts", F.lit(1)), r"^\*", "") == F.col("name")) & (F.lower(F.get("parts", F.lit(0))) == F.col("actual"))
    return files.join(said, "name", "left").select("name", F.coalesce(ok, F.lit(False)).alias("ok"))


def contiguity(rows: DataFrame, by: list[str], order: str, time: str, step: int, chunk: Column, fine: Column) -> DataFrame:
    """(by, n_rows, first, last, n_gaps, fine): how many neighbours are not exactly one step apart, duplicates and
    disorder included, and whether every row is fine. chunk does not fall along the order: neighbours are compared
    inside chunks, and the ends of a chunk, one row each, with those of the next."""
    dealt = rows.withColumns({"__chunk": chunk, "__fine": fine})
    before = F.lag(time).over(Window.partitionBy(*by, "__chunk").orderBy(order))
    off = lambda later, earlier: F.when(earlier.isNotNull() & (later - earlier != step), 1).otherwise(0)
    inside = dealt.withColumn("__before", before).groupBy(*by, "__chunk").agg(
        F.count(F.lit(1)).alias("n"), F.min_by(time, order).alias("first"), F.max_by(time, order).alias("last"),
        F.sum(off(F.col(time), F.col("__before"))).alias("gaps"), F.bool_and("__fine").alias("fine"),
    )
    inside = inside.withColumn("__end", F.lag("last").over(Window.partitionBy(*by).orderBy("__chunk")))
    return inside.groupBy(*by).agg(
        F.sum("n").alias("n_rows"), F.min_by("first", "__chunk").alias("first"), F.max_by("last", "__chunk").alias("last"),
        F.sum(F.col("gaps") + off(F.col("first"), F.col("__end"))).alias("n_gaps"), F.bool_and("fine").alias("fine"),
    )


def archive_report(spark: SparkSession, directory: str, config: ExperimentConfig) -> DataFrame:
    """(symbol, month, problem): every check that an archive fails; no rows mean all is well."""
    files = source.of_config(source.archives(spark, directory), config)
    stem = F.regexp_replace("name", r"\.zip$", ".csv")
    bad_members = (
        source.members(files).where(F.col("members") != F.array(stem))
        .select(F.regexp_extract("name", source._NAME, 1).alias("symbol"), F.regexp_extract("name", source._NAME, 3).alias("month"), F.lit("members").alias("problem"))
    )
    rows = source.klines(files, ("open_time", "open", "high", "low", "close"))
    start = F.unix_millis(F.to_timestamp(F.concat("month", F.lit("-01"))))
    days = F.day(F.last_day(F.to_date(F.concat("month", F.lit("-01")))))
    prices = [F.col(c) for c in ("open", "high", "low", "close")]
    good = lambda c: c.isNotNull() & ~F.isnan(c) & (c > 0) & (c < float("inf"))
    fine = good(prices[0]) & good(prices[1]) & good(prices[2]) & good(prices[3])
    shape = contiguity(rows, ["symbol", "month"], "line", "open_time", MINUTE_MS, F.floor(F.col("line") / CHUNK), fine).withColumnRenamed("fine", "prices")
    sums = rows.groupBy("symbol", "month").agg(F.min("n_columns").alias("least"), F.max("n_columns").alias("most"))
    table = shape.join(sums, ["symbol", "month"])
    last = start + (days * 1440 - 1).cast("long") * MINUTE_MS
    checks = {
        "columns": (F.col("least") == 12) & (F.col("most") == 12), "rows": F.col("n_rows") == days * 1440, "first_timestamp": F.col("first") == start,
        "last_timestamp": F.col("last") == last, "continuity": F.col("n_gaps") == 0, "prices": F.col("prices"),
    }
    failed = F.explode(F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks.items()]), lambda x: x.isNotNull()))
    found = table.select("symbol", "month", failed.alias("problem")).unionByName(bad_members)
    wanted = spark.createDataFrame([(s, m) for s in config.symbols for m in config.months], "symbol string, month string")
    missing = wanted.join(files.select("symbol", "month"), ["symbol", "month"], "left_anti").withColumn("problem", F.lit("missing"))
    wrong = checksums(spark, directory).where(~F.col("ok")).join(files.select("name", "symbol", "month"), "name").select("symbol", "month", F.lit("checksum").alias("problem"))
    return found.unionByName(missing).unionByName(wrong)


def require_valid(report: DataFrame) -> None:
    """Raises with the first problems."""
    problems = report.orderBy("symbol", "month", "problem").limit(5).collect()
    if problems:
        raise ValueError("invalid archives: " + "; ".join(f"{r['symbol']} {r['month']}: {r['problem']}" for r in problems))


def panel_report(rows: DataFrame, step_seconds: int) -> DataFrame:
    """(asset, n_rows, first, last, n_gaps, prices_ok) of a long panel."""
    stamped = rows.withColumn("__t", F.unix_seconds(F.col("ts").cast("timestamp")))
    fine = F.col("price").isNotNull() & ~F.isnan("price") & (F.col("price") > 0) & (F.col("price") < float("inf"))
    return contiguity(stamped, ["asset"], "ts", "__t", step_seconds, F.floor(F.col("__t") / (step_seconds * CHUNK)), fine).withColumnRenamed("fine", "prices_ok")
