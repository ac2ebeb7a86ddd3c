"""Long transforms and convolutions against NumPy: groups of a few values force every pass."""

import numpy as np
import pytest

from panelforge.functions import whittle
from panelforge.operators import fourier, timeseries

ORDERS = {"prime": 0.3, "square": -0.2, "long": 0.49, "short": 0.1, "even": 0.0}


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(1)
    return {"prime": rng.standard_normal(101).cumsum(), "square": rng.standard_normal(96), "long": rng.standard_normal(211), "short": rng.standard_normal(7), "even": rng.standard_normal(64)}


@pytest.fixture(scope="module")
def series(spark, values):
    return spark.createDataFrame([(k, i, float(v), "x") for k, x in values.items() for i, v in enumerate(x)], "series string, pos long, value double, mean string")


def by_place(rows, pos, *names):
    found = {}
    for r in rows:
        found.setdefault(r["series"], {})[r[pos]] = tuple(r[n] for n in names)
    return found


def test_divisors():
    assert fourier.divisors(96, 16) == (8, 12) and fourier.divisors(101, 16) is None and fourier.divisors(101, 101) == (1, 101)
    assert fourier.divisors(2 * 37, 16) is None and fourier.divisors(16 * 16, 16) == (16, 16)


@pytest.mark.parametrize("most", [1 << 16, 16, 8])
def test_periodogram(series, values, most):
    got = by_place(fourier.periodogram(series, most=most).collect(), "j", "omega", "power", "n", "mean")
    for name, x in values.items():
        n, m = len(x), (len(x) - 1) // 2
        power = np.abs(np.fft.rfft(x - x.mean())[1 : m + 1]) ** 2 / (2 * np.pi * n)
        assert sorted(got[name]) == list(range(1, m + 1))
        assert np.allclose([got[name][j][:2] for j in range(1, m + 1)], np.column_stack([2 * np.pi * np.arange(1, m + 1) / n, power]), atol=1e-12)
        assert got[name][1][2] == n and got[name][1][3] == pytest.approx(x.mean())


@pytest.mark.parametrize("most", [1 << 16, 16, 8])
def test_innovations(spark, series, values, most):
    fits = spark.createDataFrame([(k, float(x.mean()), ORDERS[k]) for k, x in values.items()], "series string, mean double, d double")
    got = by_place(fourier.innovations(series, fits, most=most).collect(), "pos", "innovation", "value")
    for name, x in values.items():
        want = whittle.fractionally_differenced(x, x.mean(), ORDERS[name])
        assert np.allclose([got[name][i] for i in range(len(x))], np.column_stack([want, x]), atol=1e-11)


@pytest.mark.parametrize("block", [1 << 16, 7, 1])
def test_weights_by_blocks(spark, block):
    rows = spark.createDataFrame([("a", 0.25, 40), ("b", -0.3, 13), ("c", 0.0, 3), ("d", 0.49, 1)], "series string, d double, n long")
    got = by_place(fourier.fractional_weights(rows, block).collect(), "pos", "weight")
    for name, d, n in (("a", 0.25, 40), ("b", -0.3, 13), ("c", 0.0, 3), ("d", 0.49, 1)):
        assert np.allclose([got[name][i][0] for i in range(n)], whittle.fractional_weights(d, n), atol=1e-15) and len(got[name]) == n


def test_long_fit_and_forecast(spark, monkeypatch):
    """A series of many groups has the fit and the forecasts of a whole one."""
    x = np.random.default_rng(2).standard_normal(300).cumsum()
    rows = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(x)], "series string, pos long, value double")
    want, model = whittle.fit_and_forecast(x, 200)
    monkeypatch.setattr(fourier.periodogram, "__defaults__", (None, 32))
    monkeypatch.setattr(fourier.innovations, "__defaults__", (None, 32))
    got = sorted((r["pos"], r["z_hat"]) for r in timeseries.forecast_series(rows, 200).collect())
    assert np.allclose([z for _, z in got], want, atol=1e-6) and [p for p, _ in got] == list(range(200, 300))


def test_empty(spark):
    rows = spark.createDataFrame([], "series string, pos long, value double")
    assert fourier.periodogram(rows).count() == 0
