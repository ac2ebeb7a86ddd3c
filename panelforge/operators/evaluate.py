"""Evaluation tables: comparisons against a baseline, scalar metrics, distributions, concentration of gains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import matrix as mx
from panelforge.operators import ordering
from panelforge.operators.matrices import losses
from panelforge.operators.panel import correlation, running_total, with_positions

COMPONENTS = ("overall", "diagonal", "off_diagonal")


def change_to(table: DataFrame, baseline: str, key: str = "method", column: str = "overall", name: str = "change_pct") -> DataFrame:
    """Adds the percentage change of a column to the baseline's row. The table has one row per method."""
    base = table.where(F.col(key) == baseline).select(F.col(column).alias("__base"))
    return table.crossJoin(F.broadcast(base)).withColumn(name, (F.try_divide(F.col(column), F.col("__base")) - 1) * 100).drop("__base")


def reductions(table: DataFrame, baseline: str, key: str = "method", column: str = "overall") -> DataFrame:
    """Percentage reductions against the baseline, for the other methods."""
    return change_to(table, baseline, key, column).where(F.col(key) != baseline).select(key, (-F.col("change_pct")).alias("reduction_pct"))


def component_metrics(forecasts: DataFrame, p: int, keys: list[str]) -> DataFrame:
    """(keys, component, sse, rmse, relative_error) for all three components in one aggregation: rows carry their
    three losses as an array, so the groups are unpivoted after the sums, not before."""
    rows = losses(forecasts, p)
    norms = {"overall": mx.squares, "diagonal": mx.diagonal_squares, "off_diagonal": mx.off_diagonal_squares}
    sums = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(c).alias(c) for c in COMPONENTS],
        *[F.sum(norm(F.col("m"), p)).alias(f"norm_{c}") for c, norm in norms.items()],
    )
    size = {"overall": p * p, "diagonal": p, "off_diagonal": p * p - p}
    unpivoted = F.explode(
        F.array(*[F.struct(F.lit(c).alias("component"), F.col(c).alias("sse"), F.col(f"norm_{c}").alias("norm"), F.lit(size[c]).alias("size")) for c in COMPONENTS])
    )
    long = sums.select(*keys, "n", unpivoted.alias("x")).select(*keys, "n", "x.*")
    return long.select(
        *keys, "component", "sse", F.sqrt(F.try_divide(F.col("sse"), F.col("n") * F.col("size"))).alias("rmse"),
        F.sqrt(F.try_divide(F.col("sse"), F.col("norm"))).alias("relative_error"),
    )


def against(table: DataFrame, baseline: str) -> DataFrame:
    """Component metrics joined with the baseline method's: ratio, change, squared-error ratio and share captured."""
    base = table.where(F.col("method") == baseline).select("component", F.col("rmse").alias("base_rmse"), F.col("sse").alias("base_sse"))
    joined = table.join(F.broadcast(base), "component")
    ratio = F.try_divide(F.col("rmse"), F.col("base_rmse"))
    squared = F.try_divide(F.col("sse"), F.col("base_sse"))
    return joined.select(
        "method", "component", "rmse", ratio.alias("ratio"), ((ratio - 1) * 100).alias("change_pct"), squared.alias("sse_ratio"), (1 - squared).alias("share_captured")
    )


def incremental_effects(table: DataFrame, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """(effect, component, ...) for literal (effect, candidate, reference) pairs of methods."""
    spark = table.sparkSession
    wanted = spark.createDataFrame(pairs, "effect string, candidate string, reference string")
    a = table.select(F.col("method").alias("candidate"), "component", F.col("rmse").alias("candidate_rmse"), F.col("sse").alias("candidate_sse"))
    b = table.select(F.col("method").alias("reference"), "component", F.col("rmse").alias("reference_rmse"), F.col("sse").alias("reference_sse"))
    joined = F.broadcast(wanted).join(a, "candidate").join(b, ["reference", "component"])
    ratio = F.try_divide(F.col("candidate_rmse"), F.col("reference_rmse"))
    squared = F.try_divide(F.col("candidate_sse"), F.col("reference_sse"))
    return joined.select(
        "effect", "candidate", "reference", "component", "candidate_rmse", "reference_rmse", ((ratio - 1) * 100).alias("change_pct"),
        squared.alias("sse_ratio"), (1 - squared).alias("share_captured"),
    )


def scalar_metrics(rows: DataFrame, by: list[str], actual: str = "value", forecast: str = "z_hat") -> DataFrame:
    """rmse, mae, bias (forecast minus actual), correlation (null without spread), squared error, least forecast and
    the share of negative forecasts."""
    e = F.col(forecast) - F.col(actual)
    return rows.groupBy(*by).agg(
        F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"),
        correlation(forecast, actual).alias("correlation"), F.sum(e * e).alias("squared_error"),
        F.min(forecast).alias("min_forecast"), F.avg(F.when(F.col(forecast) < 0, 1.0).otherwise(0.0)).alias("negative_share"),
    )


def empirical_cdf(rows: DataFrame, value: Column, by: list[str]) -> DataFrame:
    """(by, value_pct, cum_pct): the sorted values in per cent and rank / n in per cent; ties keep separate ranks."""
    v = F.when((value > 0) & ~F.isnan(value) & (value < float("inf")), value).otherwise(F.raise_error(F.lit("values must be positive and finite")).cast("double"))
    table = rows.select(*by, v.alias("__v"))
    total = table.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"))
    ranked = ordering.ranked(table, by, F.col("__v"), None, "__rank").join(F.broadcast(total), by)
    return ranked.select(*by, (F.col("__v") * 100).alias("value_pct"), (F.col("__rank") / F.col("__n") * 100).alias("cum_pct"))


def loss_differences(forecasts: DataFrame, p: int, candidate: str, benchmark: str, component: str = "overall") -> DataFrame:
    """(k, ts, a, b, diff, pos, cumulative): the losses of candidate and benchmark and the benchmark's minus the
    candidate's, positive where the candidate wins."""
    return differences_of(losses(forecasts, p), candidate, benchmark, component)


def differences_of(rows: DataFrame, candidate: str, benchmark: str, component: str = "overall") -> DataFrame:
    """loss_differences from rows (method, k, ts, losses)."""
    rows = rows.where(F.col("method").isin(candidate, benchmark))
    loss = lambda name: F.sum(F.when(F.col("method") == name, F.col(component)))
    table = rows.groupBy("k", "ts").agg(loss(candidate).alias("a"), loss(benchmark).alias("b"), (loss(benchmark) - loss(candidate)).alias("diff"))
    return running_total(with_positions(table), "diff", "cumulative")


def _median(differences: DataFrame) -> DataFrame:
    return ordering.percentiles(differences, [], F.col("diff"), {"median": 0.5})


def loss_report(losses_: DataFrame) -> DataFrame:
    """One row on rows (ts, pos, a, b, diff, cumulative): who wins how often, totals of both sides and of gains and
    losses, extremes of single places and of the path (the earliest on ties). Totals that do not agree are refused."""
    gain, loss = F.sum(F.greatest(F.col("diff"), F.lit(0.0))), -F.sum(F.least(F.col("diff"), F.lit(0.0)))
    count = lambda holds: F.sum(F.when(holds, 1).otherwise(0))
    low, high = F.min(F.struct("cumulative", "pos", "ts")), F.max(F.struct("cumulative", -F.col("pos"), "ts"))
    one = losses_.agg(
        F.count(F.lit(1)).alias("n"), count(F.col("diff") > 0).alias("candidate_wins"), count(F.col("diff") < 0).alias("benchmark_wins"),
        count(F.col("diff") == 0).alias("equal_losses"), F.sum("a").alias("candidate_total"), F.sum("b").alias("benchmark_total"), F.sum("diff").alias("net"),
        gain.alias("gross_gain"), loss.alias("gross_loss"), F.max("diff").alias("largest_gain"),
        F.min("diff").alias("largest_loss"), low.alias("__low"), high.alias("__high"), F.max_by("cumulative", "pos").alias("__end"), F.max("ts").alias("final_ts"),
    ).crossJoin(_median(losses_))
    off = lambda x: F.abs(x - F.col("net")) > 1e-9 * F.greatest(F.col("benchmark_total"), F.lit(1e-300))
    refused = F.raise_error(F.lit("the totals of the losses do not agree")).cast("double")
    net = F.when(off(F.col("__end")) | off(F.col("benchmark_total") - F.col("candidate_total")), refused).otherwise(F.col("net"))
    share = lambda c: F.try_divide(F.col(c), F.col("n"))
    return one.select(
        "n", "candidate_wins", share("candidate_wins").alias("candidate_win_share"), "benchmark_wins", share("benchmark_wins").alias("benchmark_win_share"), "equal_losses",
        "candidate_total", "benchmark_total", net.alias("net"), F.try_divide("net", "benchmark_total").alias("relative_reduction"), "gross_gain", "gross_loss",
        F.when(F.col("gross_loss") > 0, F.col("gross_gain") / F.col("gross_loss")).otherwise(F.lit(float("inf"))).alias("gain_to_loss"), "median", "largest_gain", "largest_loss",
        F.col("__low.cumulative").alias("min_cumulative"), F.col("__low.ts").alias("min_ts"), F.col("__high.cumulative").alias("max_cumulative"), F.col("__high.ts").alias("max_ts"), "final_ts",
    )


def win_share(differences: DataFrame) -> DataFrame:
    wins = F.sum(F.when(F.col("diff") > 0, 1).otherwise(0))
    return differences.agg(F.count(F.lit(1)).alias("n"), wins.alias("n_wins"), (wins / F.count(F.lit(1))).alias("win_share"))


def gross(differences: DataFrame) -> DataFrame:
    """One row: n, net, gross gain, gross loss, extremes of the path (the earliest on ties)."""
    gain, loss = F.sum(F.greatest(F.col("diff"), F.lit(0.0))), -F.sum(F.least(F.col("diff"), F.lit(0.0)))
    low, high = F.min(F.struct("cumulative", "pos", "ts")), F.max(F.struct("cumulative", -F.col("pos"), "ts"))
    table = differences.agg(
        F.count(F.lit(1)).alias("n"), F.sum("diff").alias("net"), F.avg("diff").alias("mean"), gain.alias("gross_gain"), loss.alias("gross_loss"),
        F.stddev_samp("diff").alias("std"), F.sum(F.when(F.col("diff") > 0, 1).otherwise(0)).alias("n_wins"),
        F.max_by("cumulative", "pos").alias("ending_cumulative"), low.alias("__low"), high.alias("__high"),
    ).crossJoin(_median(differences))
    return table.select(
        "n", "net", "mean", "median", "std", "gross_gain", "gross_loss", "n_wins", (F.col("n_wins") / F.col("n")).alias("win_share"), "ending_cumulative",
        F.col("__low.cumulative").alias("min_cumulative"), F.col("__low.ts").alias("min_ts"),
        F.col("__high.cumulative").alias("max_cumulative"), F.col("__high.ts").alias("max_ts"),
        F.try_divide("gross_loss", "gross_gain").alias("loss_to_gain"), F.try_divide("net", "gross_gain").alias("net_to_gain"),
    )


def concentration(differences: DataFrame, percents: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """(percent, top_k, gain, share_of_net, share_of_gross): what the largest gains amount to."""
    n = differences.agg(F.count(F.lit(1)).alias("n"), F.sum("diff").alias("net"), F.sum(F.greatest(F.col("diff"), F.lit(0.0))).alias("gain_all"))
    cuts = n.withColumn("percent", F.explode(F.array(*[F.lit(s) for s in percents]))).withColumn("top_k", F.ceil(F.col("n") * F.col("percent") / 100))
    ranked = ordering.ranked(differences, [], -F.col("diff"), "pos", "__rank")
    top = ranked.crossJoin(F.broadcast(cuts)).where(F.col("__rank") <= F.col("top_k"))
    sums = top.groupBy("percent", "top_k", "net", "gain_all").agg(F.sum("diff").alias("gain"))
    return sums.select("percent", "top_k", "gain", F.try_divide("gain", "net").alias("share_of_net"), F.try_divide("gain", "gain_all").alias("share_of_gross"))


def monthly(differences: DataFrame) -> DataFrame:
    """(month, n, win_share, mean, total, share_of_net, ending_cumulative)"""
    net = differences.agg(F.sum("diff").alias("__net"))
    table = differences.groupBy(F.date_format("ts", "yyyy-MM").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("diff") > 0, 1.0).otherwise(0.0)).alias("win_share"), F.avg("diff").alias("mean"),
        F.sum("diff").alias("total"), F.max_by("cumulative", "pos").alias("ending_cumulative"),
    )
    joined = table.crossJoin(F.broadcast(net))
    return joined.select("month", "n", "win_share", "mean", "total", F.try_divide("total", "__net").alias("share_of_net"), "ending_cumulative")


def extreme_events(differences: DataFrame, count: int = 10) -> DataFrame:
    """(kind, rank, k, ts, diff): the largest gains and losses, the earliest first on ties."""

    def side(kind: str, order: Column) -> DataFrame:
        top = differences.orderBy(order, "ts").limit(count)
        return top.select(F.lit(kind).alias("kind"), F.row_number().over(Window.orderBy(order, "ts")).alias("rank"), "k", "ts", "diff")

    return side("gain", F.col("diff").desc()).unionByName(side("loss", F.col("diff").asc()))


def sample_bounds(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sample").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
