"""What one indicator leaves: residual coefficients, corrections, eigenbases through time, joint diagonalisation
(exploratory)."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.functions import bases
from panelforge.functions import matrix as mx
from panelforge.operators.matrices import MatrixSeries
from panelforge.operators.panel import CHUNK, correlation, with_lags


def coefficients(errors: DataFrame, assets: tuple[str, ...]) -> DataFrame:
    """(series, pos, ts, value): the diagonal of each residual matrix, a series per asset."""
    p = len(assets)
    pairs = F.explode(F.array(*[F.struct(F.lit(a).alias("series"), mx.at(F.col("e"), i, i, p).alias("value")) for i, a in enumerate(assets)]))
    return errors.select(F.col("k").alias("pos"), "ts", pairs.alias("c")).select("c.series", "pos", "ts", "c.value")


def correction_matrix(forecasts: DataFrame, assets: tuple[str, ...]) -> DataFrame:
    """(k, c): forecast coefficients as diagonal matrices."""
    values = F.array(*[F.max(F.when(F.col("series") == a, F.col("z_hat"))) for a in assets])
    table = forecasts.groupBy(F.col("pos").alias("k")).agg(values.alias("__v"))
    return table.select("k", mx.diagonal_matrix(F.col("__v"), len(assets)).alias("c"))


def complete_forecasts(indicators: dict[str, DataFrame], corrections: dict[str, DataFrame], assets: tuple[str, ...]) -> DataFrame:
    """(method, k, ts, m, f, e) for every indicator forecast with every diagonal correction, one join of two unions.
    indicators: rows (k, ts, m, f); corrections: rows (series, pos, z_hat)."""
    p = len(assets)
    left = reduce(DataFrame.unionByName, [rows.select(F.lit(name).alias("indicator"), "k", "ts", "m", "f") for name, rows in indicators.items()])
    right = reduce(DataFrame.unionByName, [correction_matrix(rows, assets).withColumn("correction", F.lit(name)) for name, rows in corrections.items()])
    # both sides have a row for each matrix and method: neither is gathered on the driver to be broadcast
    joined = left.join(right.hint("merge"), "k")
    rows = joined.select(
        F.concat_ws("+", "indicator", "correction").alias("method"), "k", "ts", "m", mx.zipped(F.col("f"), F.col("c"), p, lambda a, b: a + b).alias("f")
    )
    return rows.withColumn("e", mx.minus(F.col("m"), F.col("f"), p))


def split_comparison(coefficients_: DataFrame, training: int) -> DataFrame:
    """Per series and sample: mean, deviation, lag-1 autocorrelation inside the sample, negative share; and the
    holdout's shift in training deviations."""
    tagged = coefficients_.withColumn("sample", F.when(F.col("pos") < training, "Training").otherwise("Holdout"))
    tagged = tagged.withColumn("spos", F.when(F.col("pos") < training, F.col("pos")).otherwise(F.col("pos") - training))
    lagged = with_lags(tagged, {"before": ("value", 1)}, ["series", "sample"], "spos")
    table = lagged.groupBy("series", "sample").agg(
        F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), correlation("value", "before").alias("autocorrelation"),
        F.avg(F.when(F.col("value") < 0, 1.0).otherwise(0.0)).alias("negative_share"),
    )
    wide = table.groupBy("series").agg(
        *[F.max(F.when(F.col("sample") == s, F.col(c))).alias(f"{t}_{c}") for s, t in (("Training", "train"), ("Holdout", "test")) for c in ("mean", "std", "autocorrelation", "negative_share")]
    )
    return wide.withColumns({
        "std_ratio": F.try_divide("test_std", "train_std"), "mean_shift": F.try_divide(F.col("test_mean") - F.col("train_mean"), F.col("train_std")),
    })


def pair_rmse(forecasts: DataFrame, assets: tuple[str, ...], baseline: str) -> DataFrame:
    """(method, pair, rmse, ratio): off-diagonal errors per pair of assets."""
    p = len(assets)
    pairs = F.explode(F.array(*[F.struct(F.lit(f"{assets[i]}-{assets[j]}").alias("pair"), mx.at(F.col("e"), i, j, p).alias("x")) for i in range(p) for j in range(i + 1, p)]))
    table = forecasts.select("method", pairs.alias("q")).groupBy("method", "q.pair").agg(F.sqrt(F.avg(F.col("q.x") * F.col("q.x"))).alias("rmse"))
    base = table.where(F.col("method") == baseline).select("pair", F.col("rmse").alias("__base"))
    return table.join(F.broadcast(base), "pair").select("method", "pair", "rmse", F.try_divide("rmse", "__base").alias("ratio"))


def mean_error_norm(errors: DataFrame, p: int, training: int) -> DataFrame:
    """The Frobenius norm of the mean training residual."""
    means = errors.where(F.col("k") < training).agg(*[F.avg(F.get("e", F.lit(q))).alias(f"m{q}") for q in range(p * p)])
    return means.select(F.sqrt(mx.total([F.col(f"m{q}") * F.col(f"m{q}") for q in range(p * p)])).alias("norm"))


# --- eigenbases through time ---------------------------------------------------------------------------------------


def decompositions(errors: DataFrame, p: int, column: str = "e") -> DataFrame:
    """(k, ts, e, basis, eig): descending eigendecomposition of each matrix, batched through Arrow."""

    @F.pandas_udf("struct<basis:array<double>,eig:array<double>>")
    def decompose(series: pd.Series) -> pd.DataFrame:
        if not len(series):
            return pd.DataFrame({"basis": [], "eig": []})
        values, vectors = bases.descending_eigh(np.stack(series.to_numpy()).reshape(-1, p, p))
        return pd.DataFrame({"basis": list(vectors.reshape(len(series), -1)), "eig": list(values)})

    return errors.select("k", "ts", F.col(column).alias("e"), decompose(column).alias("d")).select("k", "ts", "e", "d.basis", "d.eig")


def matched(decomposed: DataFrame, p: int, chunk: int = CHUNK) -> DataFrame:
    """Bases and eigenvalues in one order and sign through time, anchored at the first. The best signed permutation
    between raw neighbours is row-local; their products are a prefix scan, run inside chunks and over chunk totals."""
    lagged = with_lags(decomposed, {"before": ("basis", 1)}, pos="k")

    @F.pandas_udf("struct<perm:array<int>,sign:array<int>>")
    def relative(before: pd.Series, basis: pd.Series) -> pd.DataFrame:
        out = []
        for a, b in zip(before, basis, strict=True):
            same = a is None
            out.append((np.arange(p), np.ones(p, int)) if same else bases.matching(np.reshape(a, (p, p)), np.reshape(b, (p, p))))
        return pd.DataFrame({"perm": [o.tolist() for o, _ in out], "sign": [s.tolist() for _, s in out]})

    steps = lagged.select("k", "ts", "e", "basis", "eig", relative("before", "basis").alias("r"), F.floor(F.col("k") / chunk).alias("chunk"))
    steps = steps.select("k", "ts", "e", "basis", "eig", "r.perm", "r.sign", "chunk")
    fields = "k long, ts timestamp, e array<double>, basis array<double>, eig array<double>, perm array<int>, sign array<int>, chunk long"

    def scanned(pdf: pd.DataFrame, by: str) -> pd.DataFrame:
        pdf = pdf.sort_values(by)
        now = (np.arange(p), np.ones(p, int))
        perms, signs = [], []
        for perm, sign in zip(pdf["perm"], pdf["sign"], strict=True):
            now = bases.compose(now, (np.asarray(perm), np.asarray(sign)))
            perms.append(now[0].tolist())
            signs.append(now[1].tolist())
        return pdf.assign(perm=perms, sign=signs)

    local = steps.groupBy("chunk").applyInPandas(lambda pdf: scanned(pdf, "k"), fields)
    # one signed permutation per chunk of 65,536 matrices
    totals = local.groupBy("chunk").agg(F.max_by("perm", "k").alias("perm"), F.max_by("sign", "k").alias("sign")).withColumn("one", F.lit(1))
    ends = totals.groupBy("one").applyInPandas(lambda pdf: scanned(pdf, "chunk"), "chunk long, perm array<int>, sign array<int>, one int")
    starts = ends.select((F.col("chunk") + 1).alias("chunk"), F.col("perm").alias("perm0"), F.col("sign").alias("sign0"))
    joined = local.join(starts, "chunk", "left")
    perm = F.when(F.col("perm0").isNull(), F.col("perm")).otherwise(F.transform("perm0", lambda i: F.get("perm", i)))
    sign = F.when(F.col("perm0").isNull(), F.col("sign")).otherwise(F.zip_with(F.transform("perm0", lambda i: F.get("sign", i)), F.col("sign0"), lambda a, b: a * b))
    rows = joined.select("k", "ts", "e", "basis", "eig", perm.alias("perm"), sign.alias("sign"))
    basis = F.array(*[F.get("basis", F.lit(i * p) + F.get("perm", F.lit(c))) * F.get("sign", F.lit(c)) for i in range(p) for c in range(p)])
    eig = F.array(*[F.get("eig", F.get("perm", F.lit(c))) for c in range(p)])
    return rows.select("k", "ts", "e", basis.alias("basis"), eig.alias("eig"))


def reconstructed(basis, eig, p: int):
    """basis diag(eig) basis' with row-wise bases."""
    b = lambda i, c: F.get(basis, F.lit(i * p + c))
    return F.array(*[mx.total([b(i, c) * b(j, c) * F.get(eig, F.lit(c)) for c in range(p)]) for i in range(p) for j in range(p)])


def consecutive(matched_: DataFrame, p: int) -> DataFrame:
    """(k, ts, similarity array, e, approx): inner products with the previous basis, and each matrix rebuilt on the
    previous basis with its own eigenvalues."""
    rows = with_lags(matched_, {"before": ("basis", 1)}, pos="k").where("k >= 1")
    similarity = F.array(*[mx.total([F.get("basis", F.lit(i * p + c)) * F.get("before", F.lit(i * p + c)) for i in range(p)]) for c in range(p)])
    return rows.select("k", "ts", similarity.alias("similarity"), "e", reconstructed(F.col("before"), F.col("eig"), p).alias("approx"))


# --- joint diagonalisation -----------------------------------------------------------------------------------------


def moment_tensor(errors: DataFrame, p: int, training: int, column: str = "e") -> np.ndarray:
    """K_abcd = sum_t E_ab E_cd over the training part: p^4 numbers from one aggregate, whatever the length."""
    upper = [(i, j) for i in range(p) for j in range(i, p)]
    pairs = [(a, b) for a in range(len(upper)) for b in range(a, len(upper))]
    e = lambda q: mx.at(F.col(column), *upper[q], p)
    row = errors.where(F.col("k") < training).agg(*[F.sum(e(a) * e(b)).alias(f"k{a}_{b}") for a, b in pairs]).first()
    tensor = np.zeros((p, p, p, p))
    for (a, b), value in zip(pairs, row, strict=True):
        (i, j), (k, m) = upper[a], upper[b]
        for w, x in {(i, j), (j, i)}:
            for y, z in {(k, m), (m, k)}:
                tensor[w, x, y, z] = tensor[y, z, w, x] = value
    return tensor


def projected(errors: DataFrame, basis: np.ndarray, p: int) -> DataFrame:
    """(k, ts, e, c, approx): coordinates on the basis' diagonal, and what they rebuild."""
    rows = errors.withColumn("c", mx.congruence_diagonal(F.col("e"), basis, p))
    return rows.withColumn("approx", mx.from_diagonal(F.col("c"), basis)).select("k", "ts", "e", "c", "approx")


def share_remaining(rows: DataFrame, p: int) -> DataFrame:
    left = F.sum(mx.squares(mx.minus(F.col("e"), F.col("approx"), p), p))
    return rows.agg(F.try_divide(left, F.sum(mx.squares(F.col("e"), p))).alias("share_remaining"))


def error_series(errors: DataFrame, assets: tuple[str, ...]) -> MatrixSeries:
    return MatrixSeries(errors.select("k", "ts", F.col("e").alias("m")), assets)
