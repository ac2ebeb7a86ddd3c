"""Dependence-aware inference on loss differences: HAC tests and circular block bootstraps (exploratory)."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.operators.panel import with_lags

BASE_SEED = 20260729
REPLICATIONS = 10_000
CLAMP = 1e-12


def automatic_hac_lag(n: int) -> int:
    if isinstance(n, bool) or not isinstance(n, (int, np.integer)):
        raise TypeError("n must be an integer")
    if n < 1:
        raise ValueError("n must be positive")
    return int(min(max(math.floor(4 * (n / 100) ** (2 / 9)), 0), n - 1))


def automatic_block_length(n: int) -> int:
    if isinstance(n, bool) or not isinstance(n, (int, np.integer)):
        raise TypeError("n must be an integer")
    if n < 1:
        raise ValueError("n must be positive")
    return int(min(n, math.ceil(n ** (1 / 3))))


@dataclass(frozen=True)
class HacTest:
    n: int
    lag: int
    mean: float
    long_run_variance: float
    standard_error: float
    t_statistic: float
    p_value: float
    identical_losses: bool


def _gammas(value: str, most: int) -> list[Column]:
    """Autocovariances for lags 0..most (divided by n) of a column and its lagged ones __x1, __x2, ..: each the covariance
    of the pairs plus what their own means are off the series' mean, so that no pass for the mean comes first."""
    n, mean = F.count(F.lit(1)), F.avg(value)
    found = [F.var_pop(value)]
    for k in range(1, most + 1):
        before, now = F.col(f"__x{k}"), F.when(F.col(f"__x{k}").isNotNull(), F.col(value))
        off = (F.avg(now) - mean) * (F.avg(before) - mean)
        found.append(F.coalesce(F.count(before) / n * (F.covar_pop(now, before) + off), F.lit(0.0)))
    return found


def autocovariances(rows: DataFrame, most: int, value: str = "diff", pos: str = "pos") -> DataFrame:
    """One row: n, mean, gamma array for lags 0..most (divided by n). One pass of lags, one aggregate."""
    if most:
        rows = with_lags(rows, {f"__x{lag}": (value, lag) for lag in range(1, most + 1)}, pos=pos)
    return rows.agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), F.array(*_gammas(value, most)).alias("gamma"), F.bool_and(F.col(value) == 0).alias("identical"))


def _hac(row, lag: int) -> HacTest:
    n, mean, gamma, identical = row["n"], row["mean"], row["gamma"], row["identical"]
    variance = gamma[0] + 2 * sum((1 - k / (lag + 1)) * gamma[k] for k in range(1, lag + 1))
    if variance < 0:
        if variance < -CLAMP * gamma[0]:
            raise ValueError("the long-run variance is negative")
        variance = 0.0
    error = math.sqrt(variance / n)
    if variance == 0:
        return HacTest(n, lag, mean, 0.0, 0.0, math.nan, math.nan, bool(identical))
    t = mean / error
    return HacTest(n, lag, mean, variance, error, t, math.erfc(abs(t) / math.sqrt(2)), False)


def hac_tests(rows: DataFrame, lags: list[int] | None = None, value: str = "diff", pos: str = "pos") -> list[HacTest]:
    """Tests of equal accuracy; only autocovariances up to the largest lag reach the driver."""
    n = rows.count()
    wanted = lags if lags is not None else [automatic_hac_lag(n)]
    if any(lag < 0 or lag >= n for lag in wanted):
        raise ValueError("a lag must lie between zero and n - 1")
    row = autocovariances(rows, max(wanted), value, pos).first()
    return [_hac(row, lag) for lag in wanted]


def hac_table(rows: DataFrame, by: list[str], lag: int, value: str = "diff", pos: str = "pos") -> DataFrame:
    """(by, n, lag, mean, long_run_variance, standard_error, t_statistic, p_value) for many series of one length in
    one plan; only the tail probability of the few result rows leaves the JVM."""
    if lag:
        rows = with_lags(rows, {f"__x{k}": (value, k) for k in range(1, lag + 1)}, by, pos)
    gamma = _gammas(value, lag)
    variance = gamma[0]
    for k in range(1, lag + 1):
        variance = variance + 2 * (1 - k / (lag + 1)) * gamma[k]
    sums = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"), gamma[0].alias("__gamma"), variance.alias("__variance"))
    refused = F.raise_error(F.lit("the long-run variance is negative")).cast("double")
    clamped = F.when(F.col("__variance") >= 0, F.col("__variance")).when(F.col("__variance") >= -CLAMP * F.col("__gamma"), F.lit(0.0)).otherwise(refused)
    table = sums.withColumn("long_run_variance", clamped).withColumn("standard_error", F.sqrt(F.col("long_run_variance") / F.col("n")))
    table = table.withColumn("t_statistic", F.try_divide("mean", "standard_error"))

    @F.pandas_udf("double")
    def tail(t: pd.Series) -> pd.Series:
        return t.map(lambda x: None if pd.isna(x) else math.erfc(abs(x) / math.sqrt(2)))

    return table.select(*by, "n", F.lit(lag).alias("lag"), "mean", "long_run_variance", "standard_error", "t_statistic", tail("t_statistic").alias("p_value"))


def hac_sensitivity(rows: DataFrame, extra: tuple[int, ...] = (0, 5, 10, 20, 50)) -> list[HacTest]:
    """Tests at the automatic and some fixed lags; a lag of n or more has a row without a test."""
    n = rows.count()
    lags = list(dict.fromkeys([automatic_hac_lag(n), *extra]))
    tests = hac_tests(rows, [lag for lag in lags if lag < n])
    return tests + [HacTest(n, lag, tests[0].mean, *[math.nan] * 4, tests[0].identical_losses) for lag in lags if lag >= n]


def hac_rows(spark, tests: list[HacTest]) -> DataFrame:
    kinds = "n long, lag int, mean double, long_run_variance double, standard_error double, t_statistic double, p_value double, identical_losses boolean"
    null = lambda x: None if isinstance(x, float) and math.isnan(x) else x
    return spark.createDataFrame([tuple(null(v) for v in vars(t).values()) for t in tests], kinds)


# --- bootstrap -----------------------------------------------------------------------------------------------------
#
# The generator's stream fixes the result: seed -> 64-bit outputs -> 32-bit halves, low half first -> a multiply and a
# shift to [0, n), where a draw whose low product bits fall below 2^32 mod n is rejected and taken anew. Executors skip
# ahead to the blocks of the stream that are theirs, so no draw is made on the driver. Rejections shift the stream:
# each block first counts what it accepts, the counts are summed over blocks, and an accepted draw's place follows.

DRAW_BLOCK = 1 << 16
_HALVES = 1 << 32


def _accepted(seed: int, block: int, n: int, size: int) -> np.ndarray:
    """The accepted draws of [0, n) in one block of `size` halves of the stream."""
    generator = np.random.PCG64(seed)
    generator.advance(block * size // 2)
    words = generator.random_raw(size // 2)
    halves = np.empty(size, np.uint64)
    halves[0::2], halves[1::2] = words & np.uint64(_HALVES - 1), words >> np.uint64(32)
    product = halves * np.uint64(n)
    return (product >> np.uint64(32))[(product & np.uint64(_HALVES - 1)) >= np.uint64(_HALVES % n)].astype(np.int64)


def draws(seeds: DataFrame, n: int, count: int, size: int = DRAW_BLOCK) -> DataFrame:
    """(seed, place, start): the first `count` draws of [0, n) of every seed (rows of a column seed)."""
    if not 1 <= n < _HALVES or size % 2:
        raise ValueError("starts are drawn from 32-bit halves: at least one value and below 2^32")
    if n == 1:  # nothing is drawn
        return seeds.select("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long"))).alias("place"), F.lit(0).cast("long").alias("start"))
    # at most every second half is rejected, and few are: 2^32 mod n of 2^32; ten standard deviations are added
    rate = (_HALVES % n) / _HALVES
    halves = count / (1 - rate) + 10 * math.sqrt(count * rate) / (1 - rate) + 1
    blocks = -(-math.ceil(halves) // size)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(kept=[len(_accepted(int(s), int(b), n, size)) for s, b in zip(pdf["seed"], pdf["block"], strict=True)])

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for seed, block, before in zip(pdf["seed"], pdf["block"], pdf["before"], strict=True):
                starts = _accepted(int(seed), int(block), n, size)
                place = np.arange(len(starts)) + int(before)
                yield pd.DataFrame({"seed": seed, "place": place, "start": starts})[place < count]

    parts = max(1, min(blocks, int(seeds.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    each = seeds.select("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")).repartition(parts, "block")
    if rate == 0:
        placed = each.withColumn("before", F.col("block") * size)
    else:
        before = Window.partitionBy("seed").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
        placed = each.mapInPandas(counted, "seed long, block long, kept long").withColumn("before", F.coalesce(F.sum("kept").over(before), F.lit(0))).drop("kept")
        placed = placed.repartition(parts, "block")
    return placed.mapInPandas(drawn, "seed long, place long, start long")


def circular_sums(rows: DataFrame, n: int, length: int, value: str = "diff", pos: str = "pos", by: list[str] | None = None) -> DataFrame:
    """(by, start, total): sums of `length` consecutive values, each series closed to a ring."""
    by = by or []
    if length == 1:
        return rows.select(*by, F.col(pos).alias("start"), F.col(value).alias("total"))
    at = F.col(pos)
    ring = rows.select(*by, F.explode(F.when(at < length - 1, F.array(at, at + n)).otherwise(F.array(at))).alias("at"), value)
    # each value goes to the chunk of every start it belongs to, so chunks are summed apart
    chunk = max(1 << 14, length)
    own = F.floor(F.col("at") / chunk)
    dealt = ring.withColumn("__chunk", F.explode(F.when((F.col("at") % chunk < length - 1) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))))
    window = Window.partitionBy(*by, "__chunk").orderBy("at").rowsBetween(0, length - 1)
    summed = dealt.withColumn("total", F.sum(value).over(window)).where((F.col("__chunk") == own) & (F.col("at") < n))
    return summed.select(*by, F.col("at").alias("start"), "total")


def bootstrap_table(rows: DataFrame, seeds: DataFrame, n: int, length: int, replications: int = REPLICATIONS, truncate: bool = True, level: float = 0.95, value: str = "diff") -> DataFrame:
    """(by, n, block_length, replications, bootstrap_mean, lower, upper) for many series of n values in one plan. seeds:
    (by, seed), one row a series, whose by columns name its rows. A replication is n // length whole blocks and the rest
    of a partial one; all whole blocks of a seed are drawn before its partial ones. With truncate off it is
    ceil(n / length) whole blocks. The interval is that of percentiles, interpolated."""
    if not 1 <= length <= n:
        raise ValueError("the block length must lie between one and n")
    by = [c for c in seeds.columns if c != "seed"]
    whole, rest = (n // length, n % length) if truncate else (-(-n // length), 0)
    starts = draws(seeds.select("seed").distinct(), n, replications * (whole + bool(rest)))
    many = F.lit(replications * whole)
    part = F.col("place") >= many
    starts = starts.select("seed", "start", part.alias("part"), F.when(part, F.col("place") - many).otherwise(F.floor(F.col("place") / whole)).alias("rep"))
    sums = circular_sums(rows, n, length, value, by=by).withColumn("part", F.lit(False))
    if rest:
        sums = sums.unionByName(circular_sums(rows, n, rest, value, by=by).withColumn("part", F.lit(True)))
    sums = sums.join(seeds, by) if by else sums.withColumn("seed", F.lit(seeds.first()["seed"]))
    size = n if truncate else whole * length
    means = starts.join(sums, ["seed", "start", "part"]).groupBy(*by, "rep").agg((F.sum("total") / size).alias("mean"))
    tail = (1 - level) / 2
    # a percentile holds one number per replication
    return means.groupBy(*by).agg(
        F.lit(n).alias("n"), F.lit(length).alias("block_length"), F.count(F.lit(1)).alias("replications"), F.avg("mean").alias("bootstrap_mean"),
        F.percentile("mean", tail).alias("lower"), F.percentile("mean", 1 - tail).alias("upper"),
    )


def bootstrap_interval(rows: DataFrame, length: int | None = None, replications: int = REPLICATIONS, seed: int = BASE_SEED, truncate: bool = True, level: float = 0.95, n: int | None = None) -> DataFrame:
    """One row: n, block length, bootstrap mean and the percentile interval."""
    n = rows.count() if n is None else n
    seeds = rows.sparkSession.createDataFrame([(seed,)], "seed long")
    return bootstrap_table(rows, seeds, n, length or automatic_block_length(n), replications, truncate, level)


def block_length_sensitivity(rows: DataFrame, extra: tuple[int, ...] = (5, 10, 20, 50), replications: int = REPLICATIONS, seed: int = BASE_SEED) -> DataFrame:
    """Intervals for the automatic and some fixed lengths; the seed follows the index in the list. A length above n has
    a row without an interval."""
    n = rows.count()
    out = None
    for i, length in enumerate(dict.fromkeys([automatic_block_length(n), *extra])):
        if length <= n:
            part = bootstrap_interval(rows, length, replications, seed + 10_000 + i, n=n)
        else:
            part = rows.sparkSession.createDataFrame([(n, length, 0, None, None, None)], "n int, block_length int, replications long, bootstrap_mean double, lower double, upper double")
        out = part if out is None else out.unionByName(part)
    return out
