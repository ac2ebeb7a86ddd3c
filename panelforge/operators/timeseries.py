"""Scalar series models on tables of series (series, pos, value), all series at once.

Fractional models: the profile objective needs sum power exp(2 d f) only, f = ln(2 sin(w / 2)). Near a centre c it is a
power series in d - c with the moments sum power exp(2 c f) (2 f)^r / r!. One aggregate of the moments at CENTRES gives
the objective on the whole grid and between its points, to rounding; the search then runs on one row per series. The
objective is convex in d, so its minimum is where the derivative changes sign, found by halving.

Autoregressions: one aggregate of lagged covariances for all orders and samples, solved by elimination in expressions.
Spectra and full-history differences come from fourier.py, which cuts long series into groups of bounded size.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelforge.functions import whittle
from panelforge.operators import fourier
from panelforge.operators.panel import correlation, with_lags

FIT_SCHEMA = (
    "series string, mean double, d double, innovation_variance double, objective double, positive_frequency_count long, "
    "grid_best_d double, refinement_iterations long, boundary_distance double, boundary_warning boolean"
)
#: The grid in thousandths, its centres, and the terms of a series that is used up to 0.011 from a centre: with 10^9
#: values 2 f is at least -38, so the last term is below 1e-16 of the sum.
STEPS = (-490, 490)
CENTRES = 20
TERMS = 14
HALVINGS = 40


def _let(value: Column, then) -> Column:
    """then(value), the value computed once."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _series_value(moments: Column, h: Column, slope: bool = False) -> Column:
    """The power series with the given coefficients at h, or its derivative."""
    value = F.lit(0.0)
    for r in range(TERMS - 1, -1 if not slope else 0, -1):
        value = value * h + F.get(moments, F.lit(r)) * (r if slope else 1)
    return value


def spectral_moments(spectrum: DataFrame) -> DataFrame:
    """(series, center, n, mean, m, factors, moments array): for every centre, in thousandths."""
    low, high = STEPS
    x = 2 * F.ln(2 * F.sin(F.col("omega") / 2))
    rows = spectrum.select("series", "n", "mean", "power", x.alias("x"), F.explode(F.sequence(F.lit(low), F.lit(high), F.lit(CENTRES))).alias("center"))
    rows = rows.withColumn("base", F.col("power") * F.exp(F.col("center") / 1000 * F.col("x")))
    power = F.lit(1.0)
    sums = []
    for r in range(TERMS):
        sums.append(F.sum(F.col("base") * power))
        power = power * F.col("x") / (r + 1)
    return rows.groupBy("series", "center").agg(
        F.first("n").alias("n"), F.first("mean").alias("mean"), F.count(F.lit(1)).alias("m"), (F.sum("x") / 2).alias("factors"), F.array(*sums).alias("moments")
    )


def _objective(d: Column, h: Column, moments: Column) -> tuple[Column, Column]:
    """(profile objective, innovation variance)."""
    variance = 2 * math.pi * _series_value(moments, h) / F.col("m")
    return F.col("m") * F.ln(variance) - 2 * d * F.col("factors"), variance


def _on_grid(moments: DataFrame) -> DataFrame:
    """The rows of spectral_moments, once for each grid value near their centre."""
    low, high = F.greatest(F.col("center") - CENTRES // 2, F.lit(STEPS[0])), F.least(F.col("center") + CENTRES // 2 - 1, F.lit(STEPS[1]))
    rows = moments.withColumn("step", F.explode(F.sequence(low, high)))
    objective, variance = _objective(F.col("step") / 1000, (F.col("step") - F.col("center")) / 1000, F.col("moments"))
    return rows.withColumns({"d": F.col("step") / 1000, "objective": objective, "innovation_variance": variance})


def whittle_grid(spectrum: DataFrame) -> DataFrame:
    """(series, d, objective, innovation_variance) at the 981 grid values, an exact decimal grid in thousandths."""
    return _on_grid(spectral_moments(spectrum)).select("series", "d", "objective", "innovation_variance")


def grid_minimum(grid: DataFrame) -> DataFrame:
    """(series, d, objective) of the least objective, the least d among ties."""
    best = grid.groupBy("series").agg(F.min(F.struct("objective", "d")).alias("b"))
    return best.select("series", F.col("b.d").alias("d"), F.col("b.objective").alias("objective"))


def _halved(best: DataFrame) -> Column:
    """The d between the grid neighbours of the best where the derivative changes sign; an end, if it does not."""
    moments, center = F.col("moments"), F.col("center") / 1000

    def step(bracket: Column, _: Column) -> Column:
        middle = (bracket["low"] + bracket["high"]) / 2
        h = middle - center
        rises = F.col("m") * _series_value(moments, h, slope=True) > 2 * F.col("factors") * _series_value(moments, h)
        return F.struct(F.when(rises, bracket["low"]).otherwise(middle).alias("low"), F.when(rises, middle).otherwise(bracket["high"]).alias("high"))

    around = [F.greatest(F.col("step") - 1, F.lit(STEPS[0])) / 1000, F.least(F.col("step") + 1, F.lit(STEPS[1])) / 1000]
    start = F.struct(around[0].alias("low"), around[1].alias("high"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, step, lambda b: (b["low"] + b["high"]) / 2)


def fit_series(series: DataFrame, training: int | None = None, refine: bool = True, short: bool = False, longest: int | None = None) -> DataFrame:
    """One row FIT_SCHEMA per series, from its first `training` values (all by default). With short, a series of too few
    values has a row of nulls; else it is refused, as are constant series and values that are not finite."""
    rows = series if training is None else series.where(F.col("pos") < training)
    longest = training if longest is None else longest
    refused = lambda why: F.raise_error(F.lit(why)).cast("boolean")
    few = F.col("n") < whittle.LEAST_LENGTH
    sound = F.when(few, F.lit(True) if short else refused(f"a series must have at least {whittle.LEAST_LENGTH} values"))
    sound = sound.when(F.col("wild"), refused("a series must be finite")).when(F.col("low") == F.col("high"), refused("d is unidentified for a constant series"))
    wild = F.col("value").isNull() | F.isnan("value") | (F.abs("value") == float("inf"))
    sizes = rows.groupBy("series").agg(F.count(F.lit(1)).alias("n"), F.max(wild).alias("wild"), F.min("value").alias("low"), F.max("value").alias("high"))
    sizes = sizes.where(sound.otherwise(F.lit(True))).select("series", few.alias("few"))
    moments = spectral_moments(fourier.periodogram(rows, longest))
    columns = ["objective", "step", "center", "moments", "n", "mean", "m", "factors"]
    best = _on_grid(moments).groupBy("series").agg(F.min(F.struct(*columns)).alias("b")).select("series", "b.*")
    best = best.withColumn("d", _halved(best) if refine else F.col("step") / 1000)
    best = best.withColumns(dict(zip(("objective", "innovation_variance"), _objective(F.col("d"), F.col("d") - F.col("center") / 1000, F.col("moments")), strict=True)))
    distance = F.least(F.col("d") - STEPS[0] / 1000, STEPS[1] / 1000 - F.col("d"))
    fits = best.select(
        "series", "mean", "d", "innovation_variance", "objective", F.col("m").alias("positive_frequency_count"), (F.col("step") / 1000).alias("grid_best_d"),
        F.lit(HALVINGS if refine else 0).cast("long").alias("refinement_iterations"), distance.alias("boundary_distance"), (distance < whittle.BOUNDARY_MARGIN).alias("boundary_warning"),
    )
    known = [F.when(~F.col("few"), F.col(c)).alias(c) for c in fits.columns if c != "series"]
    return sizes.join(fits, "series", "left").select("series", *known)


def difference_series(series: DataFrame, training: int, refine: bool = True, longest: int | None = None) -> DataFrame:
    """(series, pos, value, innovation): the series differenced by the d and mean fitted on its training part."""
    return fourier.innovations(series, fit_series(series, training, refine), longest)


def forecast_series(series: DataFrame, training: int, refine: bool = True, longest: int | None = None) -> DataFrame:
    """(series, pos, value, z_hat) for the positions from `training` on: what the innovation leaves of the value, which
    its own place does not enter."""
    made = difference_series(series, training, refine, longest).where(F.col("pos") >= training)
    return made.select("series", "pos", "value", (F.col("value") - F.col("innovation")).alias("z_hat"))


def fractional_weight_rows(ds: DataFrame, count: int) -> DataFrame:
    """(d, k, weight): the first coefficients of (1 - L)^d."""
    orders = ds.select(F.col("d").cast("string").alias("series"), "d", F.lit(count).cast("long").alias("n"))
    return fourier.fractional_weights(orders).select(F.col("series").cast("double").alias("d"), F.col("pos").alias("k"), "weight")


def lag_correlations(rows: DataFrame, lags: list[int], value: str = "value", by: str = "series", pos: str = "pos") -> DataFrame:
    """(series, lag, correlation): null where either side has no spread."""
    if any(lag < 1 for lag in lags):
        raise ValueError("lags must be positive")
    names = {f"__lag{lag}": (value, lag) for lag in lags}
    lagged = with_lags(rows, names, [by], pos)
    pairs = F.explode(F.array(*[F.struct(F.lit(lag).alias("lag"), F.col(f"__lag{lag}").alias("before")) for lag in lags]))
    long = lagged.select(by, F.col(value).alias("x"), pairs.alias("p")).select(by, "x", "p.lag", "p.before").where(F.col("before").isNotNull())
    return long.groupBy(by, "lag").agg(correlation("x", "before").alias("correlation"))


def shares_of_training(series: DataFrame, training: int, percents: tuple[int, ...] = (50, 75, 100)) -> DataFrame:
    """The first shares of the training part as series of their own, named series@percent."""
    tagged = series.withColumn("percent", F.explode(F.array(*[F.lit(s) for s in percents])))
    tagged = tagged.where(F.col("pos") < F.floor(F.col("percent") * training / 100))
    return tagged.withColumn("series", F.concat_ws("@", "series", F.col("percent").cast("string"))).drop("percent")


def d_stability(series: DataFrame, training: int, refine: bool = True) -> DataFrame:
    """(series, percent, n_values, d, boundary_warning): refits on growing shares of the training part, all at once."""
    parts = shares_of_training(series, training)
    sizes = parts.groupBy("series").agg(F.count(F.lit(1)).alias("n_values"))
    fits = fit_series(parts, None, refine, longest=training).join(sizes, "series")
    return fits.select(
        F.substring_index("series", "@", 1).alias("series"), F.substring_index("series", "@", -1).cast("int").alias("percent"), "n_values", "d", "boundary_warning"
    )


# --- autoregressions -----------------------------------------------------------------------------------------------

AR_ORDERS = (1, 2, 3, 4, 5)
VALIDATION_SHARE = 0.20
#: A pivot below this share of its variance has nothing left to explain.
LEAST_PIVOT = 1e-13


def validation_start(training: int, share: float = VALIDATION_SHARE) -> int:
    return training - math.floor(share * training)


def _lagged(series: DataFrame, most: int) -> DataFrame:
    """(series, pos, value, lags array): the values 1 to `most` places before, null where there are none."""
    names = {f"__lag{k}": ("value", k) for k in range(1, most + 1)}
    return with_lags(series.select("series", "pos", "value"), names, ["series"]).select("series", "pos", "value", F.array(*names).alias("lags"))


def solved(matrix: Column, right: Column, size: int) -> Column:
    """The solution of a symmetric positive semidefinite system (array of rows, array): elimination without exchanges,
    which such a system does not need. An unknown without a pivot of its own is zero."""
    rows = F.zip_with(matrix, right, lambda row, y: F.concat(row, F.array(y)))

    def step(a: Column, k: Column) -> Column:
        pivot = F.get(F.get(a, k), k)
        scale = F.when(pivot > LEAST_PIVOT * F.get(F.get(matrix, k), k), 1 / pivot).otherwise(F.lit(0.0))
        line = _let(scale, lambda c: F.transform(F.get(a, k), lambda x: x * c))
        return _let(line, lambda p: F.transform(a, lambda row, i: F.when(i == k, p).otherwise(F.zip_with(row, p, lambda x, y: x - y * F.get(row, k)))))

    return F.transform(F.aggregate(F.sequence(F.lit(0), F.lit(size - 1)), rows, step), lambda row: F.get(row, F.lit(size)))


def stationary(phi: Column, size: int) -> Column:
    """Whether a model of `size` coefficients is stationary: stepping the order down, every reflection is below one."""

    def down(state: Column, _: Column) -> Column:
        a = state["a"]
        last = F.element_at(a, -1)
        shorter = lambda k: F.transform(F.slice(a, F.lit(1), F.size(a) - 1), lambda x, i: (x + k * F.get(a, F.size(a) - 2 - i)) / (1 - k * k))
        below = state["fine"] & (F.abs(last) < 1)
        return F.struct(F.when(below, _let(last, shorter)).otherwise(F.slice(a, F.lit(1), F.size(a) - 1)).alias("a"), below.alias("fine"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(size)), F.struct(phi.alias("a"), F.lit(True).alias("fine")), down, lambda s: s["fine"])


def modulus(phi: Column, size: int, halvings: int = 60) -> Column:
    """The largest modulus of the companion matrix's eigenvalues: the least scale at which the model turns stationary."""

    def step(bracket: Column, _: Column) -> Column:
        middle = (bracket["low"] + bracket["high"]) / 2
        scaled = _let(middle, lambda r: F.transform(phi, lambda x, i: x / F.pow(r, i + 1)))
        fine = _let(scaled, lambda a: stationary(a, size))
        return F.struct(F.when(fine, bracket["low"]).otherwise(middle).alias("low"), F.when(fine, middle).otherwise(bracket["high"]).alias("high"))

    bound = 1 + F.array_max(F.transform(phi, lambda x: F.abs(x)))
    return F.aggregate(F.sequence(F.lit(1), F.lit(halvings)), F.struct(F.lit(0.0).alias("low"), bound.alias("high")), step, lambda b: b["high"])


def _fits(lagged: DataFrame, ends: tuple[int, ...], orders: tuple[int, ...]) -> DataFrame:
    """(series, until, order, intercept, phi): least squares on the places below each end, for all orders, from one
    aggregate of covariances. phi is padded with zeros to the largest order."""
    most = max(orders)
    # only the rows that some sample takes
    cases = F.array(*[F.struct(F.lit(e).alias("until"), F.lit(o).alias("order")) for e in ends for o in orders])
    rows = lagged.where(F.col("pos") < max(ends)).withColumn("case", F.explode(cases)).select("series", "pos", "value", "lags", "case.*")
    rows = rows.where((F.col("pos") < F.col("until")) & (F.col("pos") >= F.col("order")))
    y = [F.col("value"), *[F.when(F.col("order") >= k, F.get("lags", F.lit(k - 1))) for k in range(1, most + 1)]]
    pairs = [(i, j) for i in range(most + 1) for j in range(max(i, 1), most + 1)]
    sums = rows.groupBy("series", "until", "order").agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.coalesce(F.avg(c), F.lit(0.0)) for c in y]).alias("means"), *[F.coalesce(F.covar_pop(y[i], y[j]), F.lit(0.0)).alias(f"c{i}_{j}") for i, j in pairs]
    )
    c = lambda i, j: F.col(f"c{min(i, j)}_{max(i, j)}")
    matrix = F.array(*[F.array(*[c(i, j) for j in range(1, most + 1)]) for i in range(1, most + 1)])
    made = sums.select("series", "until", "order", "n", "means", matrix.alias("matrix"), F.array(*[c(0, j) for j in range(1, most + 1)]).alias("right"))
    made = made.withColumn("phi", solved(F.col("matrix"), F.col("right"), most))
    explained = F.aggregate(F.zip_with("phi", F.slice("means", 2, most), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    return made.select("series", "until", "order", (F.get("means", F.lit(0)) - explained).alias("intercept"), "phi")


def _predicted() -> Column:
    """The model's forecast from lags of at least its order."""
    terms = F.zip_with("phi", "lags", lambda a, b: F.when(a == 0, F.lit(0.0)).otherwise(a * b))
    return F.col("intercept") + F.aggregate(terms, F.lit(0.0), lambda s, x: s + x)


def ar_fits(series: DataFrame, training: int, orders: tuple[int, ...] = AR_ORDERS) -> DataFrame:
    """(series, order, intercept, phi array, modulus): least squares on the training part; the modulus is reported,
    not enforced."""
    fits = _fits(_lagged(series, max(orders)), (training,), orders)
    fits = fits.select("series", "order", "intercept", "phi", modulus(F.col("phi"), max(orders)).alias("modulus"))
    return fits.select("series", "order", "intercept", F.slice("phi", F.lit(1), F.col("order")).alias("phi"), "modulus")


def _validated(lagged: DataFrame, fits: DataFrame, start: int, training: int) -> DataFrame:
    """(series, order, rmse): the fits on the places before the validation tail, judged on the tail."""
    tail = lagged.where((F.col("pos") >= start) & (F.col("pos") < training)).join(F.broadcast(fits.where(F.col("until") == start)), "series")
    return tail.groupBy("series", "order").agg(F.sqrt(F.avg(F.pow(_predicted() - F.col("value"), F.lit(2)))).alias("rmse"), F.first("phi").alias("phi"))


def order_comparison(series: DataFrame, training: int, orders: tuple[int, ...] = AR_ORDERS) -> DataFrame:
    """(series, method, order, rmse, stationary, selected): zero, naive and autoregressions on the validation tail of
    the training part; the least error among autoregressions is selected, the lower order on ties."""
    start = validation_start(training)
    lagged = _lagged(series.where(F.col("pos") < training), max(orders))
    judged = _validated(lagged, _fits(lagged, (start,), orders), start, training)
    best = judged.groupBy("series").agg(F.min(F.struct("rmse", "order")).alias("b")).select("series", F.col("b.order").alias("best"))
    models = judged.join(best, "series").select(
        "series", F.concat(F.lit("ar"), F.col("order").cast("string")).alias("method"), "order", "rmse", stationary(F.col("phi"), max(orders)).alias("stationary"), (F.col("order") == F.col("best")).alias("selected")
    )
    error = lambda c: F.sqrt(F.avg(F.pow(c - F.col("value"), F.lit(2))))
    plain = lagged.where(F.col("pos") >= start).groupBy("series").agg(error(F.lit(0.0)).alias("zero"), error(F.get("lags", F.lit(0))).alias("naive"))
    kinds = F.array(*[F.struct(F.lit(m).alias("method"), F.lit(0).alias("order"), F.col(m).alias("rmse")) for m in ("zero", "naive")])
    plain = plain.select("series", F.inline(kinds)).select("*", F.lit(None).cast("boolean").alias("stationary"), F.lit(False).alias("selected"))
    return plain.unionByName(models)


def ar_forecasts(series: DataFrame, training: int, orders: tuple[int, ...] = AR_ORDERS) -> DataFrame:
    """(series, pos, value, z_hat): the selected order, refitted on all training values, on the holdout."""
    start = validation_start(training)
    lagged = _lagged(series, max(orders))
    if len(orders) == 1:
        chosen = _fits(lagged, (training,), orders)
    else:
        fits = _fits(lagged, (start, training), orders)
        best = _validated(lagged, fits, start, training).groupBy("series").agg(F.min(F.struct("rmse", "order")).alias("b"))
        chosen = fits.where(F.col("until") == training).join(best.select("series", F.col("b.order").alias("order")), ["series", "order"])
    held = lagged.where(F.col("pos") >= training).join(F.broadcast(chosen.select("series", "intercept", "phi")), "series")
    return held.select("series", "pos", "value", _predicted().alias("z_hat"))


def naive_forecasts(series: DataFrame, training: int) -> DataFrame:
    """(series, pos, value, z_hat): the previous value, lagged before the holdout is cut off."""
    return with_lags(series, {"z_hat": ("value", 1)}, ["series"]).where(F.col("pos") >= training).select("series", "pos", "value", "z_hat")
