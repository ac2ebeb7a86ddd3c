"""Zipped monthly kline archives: {SYMBOL}-{interval}-{YYYY-MM}.zip with one headerless CSV of twelve columns, and a
checksum sidecar beside each."""

from __future__ import annotations

import io
import itertools
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.config import ExperimentConfig
from panelforge.sources.panels import Panel, clean

# The file format's columns.
COLUMNS = [
    "open_time", "open", "high", "low", "close", "volume", "close_time", "quote_asset_volume", "number_of_trades",
    "taker_buy_base_asset_volume", "taker_buy_quote_asset_volume", "ignore",
]
_NAME = r"([^/]+)-([^-/]+)-(\d{4}-\d{2})\.zip$"
_KLINES = "symbol string, month string, line long, n_columns int, open_time long, open double, high double, low double, close double"


def archives(spark: SparkSession, directory: str) -> DataFrame:
    """(path, name, symbol, interval, month, content)"""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(directory)
    name = F.element_at(F.split("path", "/"), -1)
    part = lambda k: F.regexp_extract("path", _NAME, k)
    return files.select("path", name.alias("name"), part(1).alias("symbol"), part(2).alias("interval"), part(3).alias("month"), "content")


def of_config(files: DataFrame, config: ExperimentConfig) -> DataFrame:
    return files.where(F.col("symbol").isin(*config.symbols) & F.col("month").isin(*config.months) & (F.col("interval") == config.interval))


def members(files: DataFrame) -> DataFrame:
    """(name, members array): what each archive holds."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({"name": pdf["name"], "members": [zipfile.ZipFile(io.BytesIO(c)).namelist() for c in pdf["content"]]})

    return files.select("name", "content").mapInPandas(rows, "name string, members array<string>")


def klines(files: DataFrame, columns: tuple[str, ...] = ("open_time", "close"), chunk: int = 100_000) -> DataFrame:
    """Rows of all archives: only the wanted columns are parsed, while the member streams; line is the place in the file,
    blank lines aside, and n_columns the line's own number of columns. Wrong or missing numbers are null, for validation
    to find."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            for symbol, month, content in zip(pdf["symbol"], pdf["month"], pdf["content"], strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    names = [n for n in archive.namelist() if n.endswith(".csv")]
                    if not names:
                        continue
                    with archive.open(names[0]) as body:
                        filled = (fields for text in io.TextIOWrapper(body, "utf-8", "replace") if (fields := text.strip()))
                        at = 0
                        while lines := [text.split(",") for text in itertools.islice(filled, chunk)]:
                            out = pd.DataFrame({"symbol": symbol, "month": month, "line": range(at, at + len(lines)), "n_columns": [len(f) for f in lines]})
                            for name in ("open_time", "open", "high", "low", "close"):
                                place = COLUMNS.index(name)
                                texts = [f[place] if name in columns and place < len(f) else None for f in lines]
                                values = pd.to_numeric(pd.Series(texts, dtype=object), errors="coerce")
                                out[name] = values.astype("Int64") if name == "open_time" else values.astype(float)
                            yield out
                            at += len(lines)

    return files.select("symbol", "month", "content").mapInPandas(rows, _KLINES)


def load_closing_prices(spark: SparkSession, directory: str, config: ExperimentConfig) -> Panel:
    """The long panel of closing prices of the configured archives; a minute that some symbol lacks is incomplete."""
    rows = klines(of_config(archives(spark, directory), config))
    price = clean(F.when(~F.isnan("close"), F.col("close")))
    table = rows.select(F.timestamp_millis("open_time").alias("ts"), F.col("symbol").alias("asset"), price.alias("price"))
    return Panel(table.where(F.col("price").isNotNull()), config.symbols)
