"""Fractional fits and autoregressions of many series at once against plain ones."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import whittle
from panelforge.operators import timeseries

TRAINING = 60


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(20260729)
    second = [0.0, 0.1]
    for _ in range(120):
        second.append(0.6 * second[-1] - 0.3 * second[-2] + rng.standard_normal())
    return {"white": rng.standard_normal(64), "walk": rng.standard_normal(160).cumsum(), "short": rng.standard_normal(96), "second": np.array(second)}


@pytest.fixture(scope="module")
def series(spark, values):
    rows = [(k, i, float(v)) for k, x in values.items() for i, v in enumerate(x)]
    return spark.createDataFrame(rows, "series string, pos long, value double").persist()


@pytest.mark.parametrize("refine", [True, False])
def test_fits_equal_plain_ones(series, values, refine):
    for r in timeseries.fit_series(series, refine=refine).collect():
        want = whittle.fit(values[r["series"]], refine)
        assert r["d"] == pytest.approx(want.d, abs=5e-8) and r["grid_best_d"] == pytest.approx(want.grid_best_d, abs=1e-12)
        assert r["objective"] == pytest.approx(want.objective, abs=1e-9) and r["innovation_variance"] == pytest.approx(want.innovation_variance, rel=1e-7)
        assert (r["positive_frequency_count"], r["boundary_warning"]) == (want.positive_frequency_count, want.boundary_warning)


def test_the_minimum_is_one(series, values):
    """The refined d has no better neighbour at a thousandth of the grid's step."""
    for r in timeseries.fit_series(series).collect():
        power, factor = whittle.spectrum(values[r["series"]])
        at = lambda d: whittle.objective(d, power, factor)[0]
        assert at(r["d"]) <= min(at(max(r["d"] - 1e-6, -0.49)), at(min(r["d"] + 1e-6, 0.49))) + 1e-12


def test_frozen_estimate(spark):
    x = np.random.default_rng(20260729).standard_normal(64)
    r = timeseries.fit_series(spark.createDataFrame([("x", i, float(v)) for i, v in enumerate(x)], "series string, pos long, value double")).first()
    assert r["d"] == pytest.approx(0.04383164360895035, abs=2e-8) and r["innovation_variance"] == pytest.approx(1.056855276005954, abs=1e-8)


@pytest.mark.parametrize("bad,why", [([1.0] * 30, "constant"), ([1.0, 2.0] * 5, "at least 20"), ([float("nan"), *range(30)], "finite")])
def test_refused(spark, bad, why):
    rows = spark.createDataFrame([("x", i, float(v)) for i, v in enumerate(bad)], "series string, pos long, value double")
    with pytest.raises(Exception, match=why):
        timeseries.fit_series(rows).collect()


def test_too_short_is_null_if_asked(spark):
    rows = spark.createDataFrame([("x", i, float(i * i % 7)) for i in range(10)], "series string, pos long, value double")
    r = timeseries.fit_series(rows, short=True).first()
    assert r["series"] == "x" and r["d"] is None and r["boundary_warning"] is None


def test_autoregressions_equal_least_squares(series, values):
    rows = timeseries.ar_fits(series, TRAINING).collect()
    assert len(rows) == 5 * len(values)
    for r in rows:
        want = whittle.ar_fit(values[r["series"]][:TRAINING], r["order"])
        assert np.allclose(want, [r["intercept"], *r["phi"]], atol=1e-9) and r["modulus"] == pytest.approx(whittle.companion_modulus(want), abs=1e-9)


def test_orders_and_forecasts(series, values):
    start, chosen = timeseries.validation_start(TRAINING), {}
    for r in timeseries.order_comparison(series, TRAINING).collect():
        x, at = values[r["series"]][:TRAINING], np.arange(start, TRAINING)
        made = np.zeros(len(at)) if r["method"] == "zero" else x[at - 1]
        if r["order"]:
            c = whittle.ar_fit(x[:start], r["order"])
            made = whittle.ar_forecast(x, at, c)
            assert (whittle.companion_modulus(c) < 1) == r["stationary"]
        assert r["rmse"] == pytest.approx(np.sqrt(np.mean((made - x[at]) ** 2)), abs=1e-10)
        if r["selected"]:
            chosen[r["series"]] = r["order"]
        if r["order"]:
            assert r["rmse"] >= 0
    got = {(r["series"], r["pos"]): r["z_hat"] for r in timeseries.ar_forecasts(series, TRAINING).collect()}
    for name, x in values.items():
        want = whittle.ar_forecast(x, np.arange(TRAINING, len(x)), whittle.ar_fit(x[:TRAINING], chosen[name]))
        assert np.allclose([got[name, p] for p in range(TRAINING, len(x))], want, atol=1e-9)


def test_collinear_and_constant_series(spark):
    """What has no pivot of its own gets no coefficient; forecasts of a constant are the constant."""
    rows = [("constant", i, 3.0) for i in range(40)] + [("alternating", i, float(i % 2)) for i in range(40)]
    got = timeseries.ar_forecasts(spark.createDataFrame(rows, "series string, pos long, value double"), 30).collect()
    assert len(got) == 20 and all(r["z_hat"] == pytest.approx(r["value"], abs=1e-9) for r in got)


def test_modulus_of_known_models(spark):
    models = [[0.5, 0.3], [0.9, 0.3], [0.0, 0.0], [1.2, -0.72], [0.0, -1.44]]
    frame = spark.createDataFrame([(m,) for m in models], "phi array<double>")
    for r in frame.select("phi", timeseries.modulus(F.col("phi"), 2).alias("m"), timeseries.stationary(F.col("phi"), 2).alias("s")).collect():
        want = whittle.companion_modulus(np.array([0.0, *r["phi"]]))
        assert r["m"] == pytest.approx(want, abs=1e-9) and r["s"] == (want < 1)
