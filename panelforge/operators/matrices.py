"""Block covariance matrices, their norms, losses and definiteness."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions import matrix as mx

PSD_TOLERANCE = 1e-12
TRAINING, HOLDOUT = "Training", "Holdout"


@dataclass(frozen=True)
class MatrixSeries:
    """(k, ts, m): matrices in time order, k from 0 without gaps."""

    rows: DataFrame
    assets: tuple[str, ...]

    @property
    def p(self) -> int:
        return len(self.assets)


def block_covariances(returns: DataFrame, assets: tuple[str, ...], block_size: int) -> MatrixSeries:
    """One centred covariance (divisor block_size - 1) per complete block of consecutive returns, labelled with the
    block's last timestamp. Only the upper triangle is aggregated."""
    if block_size < 2:
        raise ValueError("block_size must be at least 2")
    p = len(assets)
    r = [F.get("r", F.lit(i)) for i in range(p)]
    upper = {(i, j): f"__c{i}_{j}" for i in range(p) for j in range(i, p)}
    grouped = returns.groupBy(F.floor((F.col("pos") - 1) / block_size).alias("k")).agg(
        F.max("ts").alias("ts"), F.count(F.lit(1)).alias("__n"), *[F.covar_samp(r[i], r[j]).alias(name) for (i, j), name in upper.items()]
    )
    m = F.array(*[F.col(upper[min(i, j), max(i, j)]) for i, j in mx.entries(p)])
    return MatrixSeries(grouped.where(F.col("__n") == block_size).select("k", "ts", m.alias("m")), assets)


def with_sample(rows: DataFrame, training: int) -> DataFrame:
    """The chronological split as a column."""
    return rows.withColumn("sample", F.when(F.col("k") < training, F.lit(TRAINING)).otherwise(F.lit(HOLDOUT)))


def default_training_size(series: MatrixSeries) -> int:
    return series.rows.count() // 2


def entry_rows(rows: DataFrame, assets: tuple[str, ...], column: str = "m", name: str = "v") -> DataFrame:
    """One row per matrix entry, labelled (i, j)."""
    p = len(assets)
    labels = F.array(*[F.lit(a) for a in assets])
    kept = [F.col(c) for c in rows.columns if c != column]
    long = rows.select(*kept, F.posexplode(column).alias("__e", name))
    i, j = F.floor(F.col("__e") / p).cast("int"), (F.col("__e") % p).cast("int")
    return long.withColumn("i", F.element_at(labels, i + 1)).withColumn("j", F.element_at(labels, j + 1)).drop("__e")


def select_timestamps(series: MatrixSeries, wanted: DataFrame, strict: bool = True) -> MatrixSeries:
    """The matrices at the wanted timestamps (column ts); with strict, every one must be there."""
    chosen = series.rows.join(wanted.select("ts").distinct(), "ts", "left_semi")
    if strict:
        missing = wanted.select("ts").distinct().join(series.rows.select("ts"), "ts", "left_anti").count()
        if missing:
            raise ValueError(f"{missing} requested timestamps have no matrix")
    return MatrixSeries(chosen.select("k", "ts", "m"), series.assets)


def losses(rows: DataFrame, p: int, error: str = "e") -> DataFrame:
    """Adds squared Frobenius losses of an error matrix: overall, diagonal, off_diagonal."""
    e = F.col(error)
    return rows.withColumns({"overall": mx.squares(e, p), "diagonal": mx.diagonal_squares(e, p), "off_diagonal": mx.off_diagonal_squares(e, p)})


def rmse_table(rows: DataFrame, p: int, by: list[str], error: str = "e") -> DataFrame:
    """Root mean squared errors over all, diagonal and off-diagonal entries."""
    n = F.count(F.lit(1))
    off = F.try_divide(F.sum("off_diagonal"), n * (p * p - p))
    return losses(rows, p, error).groupBy(*by).agg(
        F.sqrt(F.sum("overall") / (n * p * p)).alias("overall"), F.sqrt(F.sum("diagonal") / (n * p)).alias("diagonal"), F.sqrt(off).alias("off_diagonal")
    )


def psd_table(rows: DataFrame, p: int, by: list[str], m: str = "m", tolerance: float = PSD_TOLERANCE) -> DataFrame:
    """Least eigenvalue, how many matrices have a negative one, and how many are indefinite beyond a tolerance
    relative to their spectral radius."""
    if tolerance < 0:
        raise ValueError("relative_tolerance must be non-negative")
    values = mx.eigenvalues(F.col(m), p)
    table = rows.select(*by, values.alias("__w"))
    least, most = F.element_at("__w", -1), F.element_at("__w", 1)
    radius = F.greatest(F.abs(least), F.abs(most), F.lit(mx.SQRT_TINY))
    bad = F.when(least < -F.lit(tolerance) * radius, 1).otherwise(0)
    return table.groupBy(*by).agg(
        F.min(least).alias("min_eigenvalue"), F.sum(F.when(least < 0, 1).otherwise(0)).alias("n_negative"),
        F.sum(bad).alias("n_non_psd"), F.avg(bad.cast("double")).alias("share_non_psd"),
    )
