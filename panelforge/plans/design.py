"""One study from a panel to its evaluation tables, lazily: every step is a DataFrame built from the one before, and
only a count, the p*p averages of the reference and (for joint diagonalisation) p^4 moments reach the driver."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.operators import evaluate, forecast, panel, reference, residual, timeseries
from panelforge.operators import matrices as mt
from panelforge.operators.durable import Store
from panelforge.sources.panels import Panel, lineitem_panel

BLOCK_SIZE = 10


@dataclass
class Design:
    spark: SparkSession
    panel: Panel
    block_size: int = BLOCK_SIZE
    training_size: int | None = None

    @cached_property
    def returns(self) -> DataFrame:
        return panel.log_returns(self.panel)

    @cached_property
    def series(self) -> mt.MatrixSeries:
        """Written once, as every later step reads it: it is a block size smaller than the prices, and a table is read in
        as many tasks as its own size asks for, where a cached plan keeps one for each shuffle partition of the prices."""
        made = mt.block_covariances(self.returns, self.panel.assets, self.block_size)
        return mt.MatrixSeries(self.kept(made.rows), made.assets)

    def close(self) -> None:
        """Deletes the written tables; later use builds them again."""
        for name in ("series", "differences", "method_losses", "kept"):
            found = self.__dict__.pop(name, None)
            if name == "kept" and found:
                found.discard()

    @cached_property
    def kept(self) -> Store:
        """The matrices, and losses along time, which tests, reports and resampling read several times, are written once."""
        return Store(self.spark)

    @cached_property
    def matrices(self) -> int:
        return self.series.rows.count()

    @cached_property
    def training(self) -> int:
        n = self.training_size if self.training_size is not None else self.matrices // 2
        forecast.check_training_size(n, self.matrices)
        return n

    @property
    def p(self) -> int:
        return self.series.p

    @cached_property
    def reference(self) -> reference.Reference:
        return reference.fit_reference(self.series, self.training)

    @cached_property
    def errors(self) -> DataFrame:
        return reference.approximation_errors(self.series, self.reference, self.training)

    @cached_property
    def indicator_series(self) -> DataFrame:
        """(series, pos, ts, value)"""
        rows = reference.indicator(self.series, self.reference)
        return rows.select(F.lit("z").alias("series"), F.col("k").alias("pos"), "ts", F.col("z").alias("value"))

    @cached_property
    def direct(self) -> DataFrame:
        return forecast.direct_naive(self.series, self.training)

    @cached_property
    def naive(self) -> DataFrame:
        return forecast.naive_indicator(self.series, self.reference, self.training)

    def arfima(self, refine: bool = True) -> DataFrame:
        made = timeseries.forecast_series(self.indicator_series.drop("ts"), self.training, refine, self.matrices)
        return forecast.indicator_forecast(self.series, self.reference, made.select(F.col("pos").alias("k"), "z_hat"))

    @cached_property
    def naive_methods(self) -> DataFrame:
        """Both persistence methods; no Python anywhere in the plan."""
        return forecast.methods({forecast.DIRECT: self.direct, forecast.NAIVE: self.naive}, self.p)

    def all_methods(self, refine: bool = True) -> DataFrame:
        return forecast.methods({forecast.DIRECT: self.direct, forecast.NAIVE: self.naive, forecast.ARFIMA: self.arfima(refine)}, self.p)

    @cached_property
    def differences(self) -> DataFrame:
        """Loss differences of the naive indicator to direct persistence."""
        return self.kept(evaluate.loss_differences(self.naive_methods, self.p, forecast.NAIVE, forecast.DIRECT))

    @cached_property
    def method_losses(self) -> DataFrame:
        """(method, k, ts, losses) of the three methods."""
        return self.kept(mt.losses(self.all_methods(), self.p).select("method", "k", "ts", *evaluate.COMPONENTS))

    @cached_property
    def coefficients(self) -> DataFrame:
        return residual.coefficients(self.errors, self.panel.assets)

    def rmse(self, forecasts: DataFrame) -> DataFrame:
        return evaluate.change_to(mt.rmse_table(forecasts, self.p, ["method"]), forecast.DIRECT)

    def pair_differences(self, pairs: list[tuple[str, str, str]]) -> DataFrame:
        """(effect, component, pos, a, b, diff): benchmark loss minus candidate loss for literal (effect, candidate,
        benchmark) pairs of the factorial; a and b are the losses of candidate and benchmark. Each loss goes to the pairs
        it belongs to, so the factorial is computed once."""
        sides = [(method, effect, side) for effect, *methods in pairs for side, method in zip("ab", methods, strict=True)]
        wanted = F.broadcast(self.spark.createDataFrame(sides, "method string, effect string, side string"))
        rows = mt.losses(self.factorial, self.p).join(wanted, "method")
        long = F.explode(F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("loss")) for c in evaluate.COMPONENTS]))
        losses = rows.select("effect", "side", "k", long.alias("x")).select("effect", "side", "k", "x.component", "x.loss")
        loss = lambda side: F.max(F.when(F.col("side") == side, F.col("loss")))
        joined = losses.groupBy("effect", "component", "k").agg(loss("a").alias("a"), loss("b").alias("b")).where("a IS NOT NULL AND b IS NOT NULL")
        return self.kept(joined.select("effect", "component", (F.col("k") - self.training).alias("pos"), "a", "b", (F.col("b") - F.col("a")).alias("diff")))

    def prefix_coefficients(self, percents: tuple[int, ...]) -> DataFrame:
        """(series asset@percent, pos, value): residual coefficients where the reference too is refitted on each share
        of the training part."""
        parts = None
        for percent in percents:
            size = percent * self.training // 100
            fitted = reference.fit_reference(self.series, size)
            rows = residual.coefficients(reference.approximation_errors(self.series, fitted, size), self.panel.assets).where(F.col("pos") < size)
            rows = rows.select(F.concat_ws("@", "series", F.lit(str(percent))).alias("series"), "pos", "value")
            parts = rows if parts is None else parts.unionByName(rows)
        return parts

    @cached_property
    def factorial(self) -> DataFrame:
        """(method, k, ts, m, f, e) for every indicator forecast (naive, ARFIMA, oracle) with every diagonal correction
        (zero, naive, autoregression of the order selected per asset, ARFIMA, oracle), and the direct persistence
        method."""
        held = self.coefficients.where(F.col("pos") >= self.training)
        truth = reference.indicator(self.series, self.reference).where(F.col("k") >= self.training)
        indicators = {
            "naive": self.naive,
            "arfima": self.arfima(),
            "oracle": truth.withColumn("f", reference.from_indicator(self.reference, F.col("z"))),
        }
        series = self.coefficients.drop("ts")
        corrections = {
            "zero": held.withColumn("z_hat", F.lit(0.0)),
            "naive": timeseries.naive_forecasts(self.coefficients, self.training),
            "ar": timeseries.ar_forecasts(series, self.training),
            "arfima": timeseries.forecast_series(series, self.training, longest=self.matrices),
            "oracle": held.withColumn("z_hat", F.col("value")),
        }
        made = residual.complete_forecasts(indicators, corrections, self.panel.assets)
        return made.unionByName(forecast.methods({forecast.DIRECT: self.direct}, self.p))


def lineitem_design(spark: SparkSession, sf_dir: str) -> Design:
    return Design(spark, lineitem_panel(spark, sf_dir))


def result_tables(design: Design, refine: bool = True) -> dict[str, DataFrame]:
    """The retained result tables by name."""
    forecasts = design.all_methods(refine)
    return {
        "pca": reference.pca_table(design.spark, design.reference),
        "approximation": reference.approximation_summary(design.errors, design.p),
        "rmse": design.rmse(forecasts),
        "psd": mt.psd_table(forecasts, design.p, ["method"], "f"),
        "loss_differences": design.differences,
    }
