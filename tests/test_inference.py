import numpy as np
import pytest

from panelforge.operators import inference


def rows(spark, values):
    return spark.createDataFrame([(i, float(v)) for i, v in enumerate(values)], "pos long, diff double")


def test_automatic_choices():
    assert inference.automatic_hac_lag(2184) == 7 and inference.automatic_block_length(2184) == 13
    assert [inference.automatic_block_length(n) for n in (27, 64, 125, 216, 1000)] == [3, 4, 5, 6, 10]
    with pytest.raises(TypeError):
        inference.automatic_hac_lag(2.5)


def test_hac(spark):
    test = inference.hac_tests(rows(spark, [1, 2, 4, 8]), [1])[0]
    assert test.mean == 3.75 and test.long_run_variance == pytest.approx(8.546875)
    assert test.standard_error == pytest.approx(np.sqrt(8.546875 / 4)) and 0 < test.p_value < 1


def test_identical(spark):
    test = inference.hac_tests(rows(spark, [0] * 10), [2])[0]
    assert test.identical_losses and test.standard_error == 0 and np.isnan(test.t_statistic)


def test_bootstrap_whole_ring(spark):
    row = inference.bootstrap_interval(rows(spark, [1, 2, 3, 4]), 4, 100).first()
    assert (row["bootstrap_mean"], row["lower"], row["upper"]) == (2.5, 2.5, 2.5)


def test_bootstrap_truncated(spark):
    row = inference.bootstrap_interval(rows(spark, [1, 2, 4, 8, 16]), 2, 4).first()
    assert row["bootstrap_mean"] == pytest.approx(6.55) and row["lower"] == pytest.approx(4.845) and row["upper"] == pytest.approx(10.04)


def test_circular_sums(spark):
    got = {r["start"]: r["total"] for r in inference.circular_sums(rows(spark, range(10)), 10, 4).collect()}
    assert got == {s: float(sum((s + i) % 10 for i in range(4))) for s in range(10)}


def test_hac_table_equals_single_tests(spark):
    rng = np.random.default_rng(3)
    series = {"a": rng.standard_normal(50), "b": rng.standard_normal(50).cumsum(), "c": np.zeros(50)}
    table = spark.createDataFrame([(name, i, float(v)) for name, values in series.items() for i, v in enumerate(values)], "g string, pos long, diff double")
    got = {r["g"]: r for r in inference.hac_table(table, ["g"], 4).collect()}
    for name in ("a", "b"):
        want = inference.hac_tests(rows(spark, series[name]), [4])[0]
        assert got[name]["t_statistic"] == pytest.approx(want.t_statistic) and got[name]["p_value"] == pytest.approx(want.p_value)
    assert got["c"]["t_statistic"] is None and got["c"]["standard_error"] == 0


@pytest.mark.parametrize("n,seed", [(5, 1), (126, 20260729), (3, 7), (2, 5), (3_000_000_000, 11), (1 << 31, 3), ((1 << 31) + 1, 4)])
def test_draws_are_the_generators(spark, n, seed):
    """The stream of one generator, however it is cut; a range just above half the halves rejects nearly half."""
    seeds = spark.createDataFrame([(seed,), (seed + 1,)], "seed long")
    got = {}
    for r in inference.draws(seeds, n, 1000, 64).collect():
        got.setdefault(r["seed"], {})[r["place"]] = r["start"]
    for s in (seed, seed + 1):
        assert [got[s][p] for p in range(1000)] == np.random.default_rng(s).integers(0, n, size=1000).tolist()


def test_whole_blocks_are_drawn_before_partial_ones(spark):
    x, length, count = np.random.default_rng(0).standard_normal(23), 4, 50
    draw = np.random.default_rng(9)
    whole, part = draw.integers(0, 23, size=(count, 5)), draw.integers(0, 23, size=count)
    ring = np.concatenate([x, x])
    means = [(sum(ring[s : s + 4].sum() for s in w) + ring[p : p + 3].sum()) / 23 for w, p in zip(whole, part, strict=True)]
    row = inference.bootstrap_interval(rows(spark, x), length, count, 9).first()
    assert row["bootstrap_mean"] == pytest.approx(np.mean(means)) and row["replications"] == count
    assert (row["lower"], row["upper"]) == pytest.approx(tuple(np.percentile(means, [2.5, 97.5])))
    draw = np.random.default_rng(9).integers(0, 23, size=(count, 6))
    means = [sum(ring[s : s + 4].sum() for s in w) / 24 for w in draw]
    assert inference.bootstrap_interval(rows(spark, x), length, count, 9, truncate=False).first()["lower"] == pytest.approx(np.percentile(means, 2.5))


def test_many_series_in_one_plan(spark):
    rng = np.random.default_rng(4)
    series = {"a": rng.standard_normal(30), "b": rng.standard_normal(30)}
    table = spark.createDataFrame([(g, i, float(v)) for g, x in series.items() for i, v in enumerate(x)], "g string, pos long, diff double")
    got = {r["g"]: r for r in inference.bootstrap_table(table, spark.createDataFrame([("a", 3), ("b", 8)], "g string, seed long"), 30, 4, 200).collect()}
    for name, seed in (("a", 3), ("b", 8)):
        want = inference.bootstrap_interval(rows(spark, series[name]), 4, 200, seed).first()
        assert all(got[name][c] == pytest.approx(want[c]) for c in ("bootstrap_mean", "lower", "upper", "n"))


def test_lengths_beyond_the_series_have_no_interval(spark):
    got = {r["block_length"]: r for r in inference.block_length_sensitivity(rows(spark, range(12)), replications=20).collect()}
    assert sorted(got) == [3, 5, 10, 20, 50] and got[20]["lower"] is None and got[10]["lower"] is not None


def test_autocovariances_far_from_zero(spark):
    x = np.random.default_rng(1).standard_normal(60) + 1e6
    row = inference.autocovariances(rows(spark, x), 5).first()
    y = x - x.mean()
    assert np.allclose(row["gamma"], [np.sum(y[k:] * y[: 60 - k]) / 60 for k in range(6)], atol=1e-8)
