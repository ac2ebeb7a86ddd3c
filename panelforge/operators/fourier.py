"""Discrete Fourier transforms and causal convolutions of series that need not fit in one task.

A transform of length n = n1 * n2 takes two keyed passes (the four-step method): columns of n1 values, n2 apart, are
transformed and turned by twiddle factors; then rows of n2 values are. A group holds as many whole columns or rows as
fit into GROUP values, so none grows with the series: n1 and n2 are near the root of n. Lengths without such divisors
go through a chirp: a convolution at a power of two. Where every series has at most GROUP values, one pass is enough,
and a group is a series.

Rows are (series, pos, re, im); places without a row are zero. Tables with one row per series are broadcast by name:
where a series is a constant, Spark would else broadcast the rows. Joins place by place are merges, so that no spectrum
passes through the driver.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from panelforge.functions import whittle

GROUP = 1 << 16
_ROWS = "series string, pos long, re double, im double"


def divisors(n: int, most: int = GROUP) -> tuple[int, int] | None:
    """The divisors n1 <= n2 of n nearest to its root, or none if n2 is above `most`; a short length is not divided."""
    if n <= most:
        return 1, n
    for n1 in range(math.isqrt(n), 0, -1):
        if n // n1 > most:
            return None
        if n % n1 == 0:
            return n1, n // n1
    return None


def _lengths(sizes: DataFrame, most: int) -> DataFrame:
    """(series, n, n1, n2) of rows (series, n); n1 and n2 are null where there are no such divisors."""

    @F.pandas_udf("struct<n1: long, n2: long>")
    def shape(n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([divisors(int(x), most) or (None, None) for x in n], columns=["n1", "n2"]).astype("Int64")

    return sizes.withColumn("shape", shape("n")).select("series", "n", "shape.n1", "shape.n2")


def _powers_of_two(sizes: DataFrame, least: Column) -> DataFrame:
    """(series, n, n1, n2): the power of two of at least `least`, divided near its root."""
    bits = F.greatest(F.length(F.bin(least - 1)), F.lit(2))
    half = F.floor(bits / 2).cast("int")
    power = lambda b: F.call_function("shiftleft", F.lit(1).cast("long"), b.cast("int"))
    return sizes.select("series", power(bits).alias("n"), power(half).alias("n1"), power(bits - half).alias("n2"))


def _twiddle(a: np.ndarray, b: np.ndarray, n: int, sign: int) -> np.ndarray:
    return np.exp(sign * 2j * np.pi * (a * b % n) / n)


def transformed(rows: DataFrame, lengths: DataFrame, inverse: bool = False, most: int = GROUP) -> DataFrame:
    """The transforms of rows (series, pos, re, im), zero beyond the rows given, for lengths (series, n, n1, n2)."""
    sign = 1 if inverse else -1

    def fft(x: np.ndarray, axis: int) -> np.ndarray:
        return np.fft.ifft(x, axis=axis) if inverse else np.fft.fft(x, axis=axis)

    def columns(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n1, n2 = int(pdf["n1"].iloc[0]), int(pdf["n2"].iloc[0])
        wide = max(1, most // n1)
        at = np.arange(key[1] * wide, min((key[1] + 1) * wide, n2))
        dense = np.zeros((n1, len(at)), complex)
        pos = pdf["pos"].to_numpy()
        dense[pos // n2, pos % n2 - at[0]] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        k1 = np.arange(n1)[:, None]
        made = fft(dense, 0) * _twiddle(k1, at[None, :], n1 * n2, sign)
        return _frame(key[0], np.broadcast_to(k1 * n2 + at, made.shape), made).assign(n1=n1, n2=n2)

    def lines(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        n1, n2 = int(pdf["n1"].iloc[0]), int(pdf["n2"].iloc[0])
        high = max(1, most // n2)
        k1 = np.arange(key[1] * high, min((key[1] + 1) * high, n1))
        dense = np.zeros((len(k1), n2), complex)
        pos = pdf["pos"].to_numpy()
        dense[pos // n2 - k1[0], pos % n2] = pdf["re"].to_numpy() + 1j * pdf["im"].to_numpy()
        return _frame(key[0], k1[:, None] + n1 * np.arange(n2)[None, :], fft(dense, 1))

    sized = rows.join(F.broadcast(lengths.select("series", "n1", "n2")), "series")
    part = F.floor(F.col("pos") % F.col("n2") / F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("n1"))))
    turned = sized.groupBy("series", part.alias("part")).applyInPandas(columns, f"{_ROWS}, n1 long, n2 long")
    part = F.floor(F.floor(F.col("pos") / F.col("n2")) / F.greatest(F.lit(1), F.floor(F.lit(most) / F.col("n2"))))
    return turned.groupBy("series", part.alias("part")).applyInPandas(lines, _ROWS)


def _frame(series: str, pos: np.ndarray, values: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({"series": series, "pos": pos.ravel(), "re": values.real.ravel(), "im": values.imag.ravel()})


def _product(one: DataFrame, other: DataFrame) -> DataFrame:
    """Spectra multiplied place by place."""
    b = other.select("series", "pos", F.col("re").alias("b_re"), F.col("im").alias("b_im"))
    re, im = F.col("re") * F.col("b_re") - F.col("im") * F.col("b_im"), F.col("re") * F.col("b_im") + F.col("im") * F.col("b_re")
    return one.join(b.hint("merge"), ["series", "pos"]).select("series", "pos", re.alias("re"), im.alias("im"))


def convolved(one: DataFrame, other: DataFrame, lengths: DataFrame, most: int = GROUP) -> DataFrame:
    """Circular convolutions: linear ones where the lengths leave room."""
    spectra = [transformed(rows, lengths, False, most) for rows in (one, other)]
    return transformed(_product(*spectra), lengths, True, most)


def _turned(rows: DataFrame, angle: Column) -> DataFrame:
    """Rows (series, pos, re, im, ...) times exp(i angle)."""
    c, s = F.cos(angle), F.sin(angle)
    return rows.select("series", "pos", (F.col("re") * c - F.col("im") * s).alias("re"), (F.col("re") * s + F.col("im") * c).alias("im"))


def _chirped(rows: DataFrame, sizes: DataFrame, most: int) -> DataFrame:
    """Transforms of any length n by a chirp: with jk = (j^2 + k^2 - (k - j)^2) / 2 a transform is a convolution."""
    angle = lambda: F.lit(math.pi) * (F.col("pos") * F.col("pos") % (2 * F.col("n"))) / F.col("n")
    lengths = _powers_of_two(sizes, 2 * F.col("n"))
    given = _turned(rows.join(F.broadcast(sizes), "series"), -angle())
    places = sizes.withColumn("pos", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    kernel = places.select("series", "pos", F.cos(angle()).alias("re"), F.sin(angle()).alias("im"))
    mirrored = kernel.where("pos > 0").join(F.broadcast(lengths.select("series", F.col("n").alias("size"))), "series").withColumn("pos", F.col("size") - F.col("pos"))
    made = convolved(given, kernel.unionByName(mirrored.drop("size")), lengths, most)
    return _turned(made.join(F.broadcast(sizes), "series").where(F.col("pos") < F.col("n")), -angle())


def fourier(rows: DataFrame, sizes: DataFrame, most: int = GROUP) -> DataFrame:
    """Discrete Fourier transforms of rows (series, pos, re, im) at the exact lengths (series, n)."""
    lengths = _lengths(sizes, most)
    made = transformed(rows, lengths.where("n1 IS NOT NULL"), False, most)
    odd = lengths.where("n1 IS NULL").select("series", "n")
    return made if odd.isEmpty() else made.unionByName(_chirped(rows, odd, most))


# --- spectra and fractional differences -------------------------------------------------------------------------------


def longest_of(series: DataFrame) -> int:
    """The length of the longest series: one number."""
    return series.groupBy("series").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0


def periodogram(series: DataFrame, longest: int | None = None, most: int = GROUP) -> DataFrame:
    """(series, n, mean, j, omega, power) at the positive frequencies below the Nyquist frequency, of rows (series, pos,
    value) with gapless places from 0. longest: a bound on the lengths, if it is known."""
    longest = longest_of(series) if longest is None else longest
    if longest <= most:

        def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            x = pdf.sort_values("pos")["value"].to_numpy()
            n, m, mean = len(x), (len(x) - 1) // 2, x.mean()
            j = np.arange(1, m + 1)
            power = np.abs(np.fft.rfft(x - mean)[1 : m + 1]) ** 2 / (2 * np.pi * n)
            return pd.DataFrame({"series": key[0], "n": n, "mean": mean, "j": j, "omega": 2 * np.pi * j / n, "power": power})

        return series.select("series", "pos", "value").groupBy("series").applyInPandas(whole, "series string, n long, mean double, j long, omega double, power double")
    series = series.select("series", "pos", "value")
    sizes = series.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    centred = series.join(F.broadcast(sizes), "series").select("series", "pos", (F.col("value") - F.col("mean")).alias("re"), F.lit(0.0).alias("im"))
    made = fourier(centred, sizes.select("series", "n"), most).withColumnRenamed("pos", "j").join(F.broadcast(sizes), "series")
    made = made.where((F.col("j") >= 1) & (F.col("j") <= F.floor((F.col("n") - 1) / 2)))
    power = (F.col("re") * F.col("re") + F.col("im") * F.col("im")) / (2 * math.pi * F.col("n"))
    return made.select("series", "n", "mean", "j", (2 * math.pi * F.col("j") / F.col("n")).alias("omega"), power.alias("power"))


def fractional_weights(orders: DataFrame, block: int = GROUP) -> DataFrame:
    """(series, pos, weight): the first n coefficients of (1 - L)^d for rows (series, d, n). A block's factors are
    multiplied on their own; products of whole blocks carry over, one row a block."""

    @F.pandas_udf("double")
    def product(d: pd.Series, low: pd.Series, high: pd.Series) -> pd.Series:
        return pd.Series([float(np.prod(_factors(a, b, c))) for a, b, c in zip(d, low, high, strict=True)])

    @F.pandas_udf("array<double>")
    def weights(d: pd.Series, low: pd.Series, high: pd.Series, before: pd.Series) -> pd.Series:
        return pd.Series([e * np.cumprod(_factors(a, b, c)) for a, b, c, e in zip(d, low, high, before, strict=True)])

    low = F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(block).cast("long"))
    blocks = orders.withColumn("low", F.explode(low)).withColumn("high", F.least(F.col("low") + block, F.col("n")))
    before = Window.partitionBy("series").orderBy("low").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("own", product("d", "low", "high")).withColumn("before", F.coalesce(F.product("own").over(before), F.lit(1.0)))
    made = blocks.select("series", "low", F.posexplode(weights("d", "low", "high", "before")).alias("k", "weight"))
    return made.select("series", (F.col("low") + F.col("k")).alias("pos"), "weight")


def _factors(d: float, low: int, high: int) -> np.ndarray:
    """What takes each weight to the next: 1 for the first, (k - 1 - d) / k after it."""
    k = np.arange(low, high, dtype=float)
    return np.where(k == 0, 1.0, (k - 1 - d) / np.maximum(k, 1.0))


def innovations(series: DataFrame, orders: DataFrame, longest: int | None = None, most: int = GROUP) -> DataFrame:
    """(series, pos, value, innovation): rows (series, pos, value) less their mean, differenced by the d of rows (series,
    mean, d); each from its whole past."""
    longest = longest_of(series) if longest is None else longest
    known = series.select("series", "pos", "value").join(F.broadcast(orders.select("series", "mean", "d")), "series")
    if longest <= most:

        def whole(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("pos")
            made = whittle.fractionally_differenced(pdf["value"].to_numpy(), pdf["mean"].iloc[0], pdf["d"].iloc[0])
            return pdf[["series", "pos", "value"]].assign(innovation=made)

        return known.groupBy("series").applyInPandas(whole, "series string, pos long, value double, innovation double")
    sizes = series.groupBy("series").agg(F.count(F.lit(1)).alias("n"))
    lengths = _powers_of_two(sizes, 2 * F.col("n"))
    centred = known.select("series", "pos", (F.col("value") - F.col("mean")).alias("re"), F.lit(0.0).alias("im"))
    weights = fractional_weights(orders.join(sizes, "series").select("series", "d", "n"), most)
    made = convolved(centred, weights.select("series", "pos", F.col("weight").alias("re"), F.lit(0.0).alias("im")), lengths, most)
    return known.join(made.select("series", "pos", F.col("re").alias("innovation")).hint("merge"), ["series", "pos"]).select("series", "pos", "value", "innovation")
