import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from panelforge.functions import bases
from panelforge.functions import matrix as mx
from panelforge.operators import evaluate, forecast, invariants, panel, reference, residual
from panelforge.operators import matrices as mt
from panelforge.plans.design import Design
from panelforge.sources.panels import Panel

T0 = datetime(2024, 1, 1)


def series(spark, stack, assets=("A", "B")):
    rows = [(k, T0 + timedelta(minutes=30 * k), [float(v) for v in np.ravel(m)]) for k, m in enumerate(stack)]
    return mt.MatrixSeries(spark.createDataFrame(rows, "k long, ts timestamp, m array<double>"), assets)


def as_stack(rows, column="m"):
    return [np.array(r[column]) for r in rows.orderBy("k").collect()]


def test_rmse_and_losses(spark):
    s = series(spark, [[[1, 2], [2, 3]], [[4, 5], [5, 6]]]).rows.withColumnRenamed("m", "e").withColumn("method", F.lit("x"))
    row = mt.rmse_table(s, 2, ["method"]).first()
    assert row["overall"] == pytest.approx(math.sqrt(120 / 8)) and row["diagonal"] == pytest.approx(math.sqrt(62 / 4)) and row["off_diagonal"] == pytest.approx(math.sqrt(58 / 4))
    got = [(r["overall"], r["diagonal"], r["off_diagonal"]) for r in mt.losses(s, 2).orderBy("k").collect()]
    assert got == [(18, 10, 8), (102, 52, 50)]


def test_psd(spark):
    s = series(spark, [np.diag([2, 1]), np.diag([1, -1e-14]), np.diag([1, -1e-4])]).rows.withColumn("method", F.lit("x"))
    row = mt.psd_table(s, 2, ["method"]).first()
    assert row["min_eigenvalue"] == pytest.approx(-1e-4) and (row["n_negative"], row["n_non_psd"]) == (2, 1) and row["share_non_psd"] == pytest.approx(1 / 3)
    with pytest.raises(ValueError, match="relative_tolerance must be non-negative"):
        mt.psd_table(s, 2, ["method"], tolerance=-1.0)


def test_naive_uses_previous(spark):
    s = series(spark, [[[v, v / 10], [v / 10, v + 1]] for v in (1, 2, 3, 4)])
    made = forecast.direct_naive(s, 2)
    assert [m.tolist() for m in as_stack(made, "f")] == [[2, 0.2, 0.2, 3], [3, 0.3, 0.3, 4]]
    assert invariants.naive_violations(s, made).first()["violations"] == 0


@pytest.mark.parametrize("n", [0, 2])
def test_training_size(n):
    with pytest.raises(ValueError, match="strictly between zero"):
        forecast.check_training_size(n, 2)


def test_indicator_forecast_golden(spark):
    c = math.cos(math.pi / 4)
    basis = np.array([[c, -c], [c, c]])
    ref = reference.Reference(("A", "B"), basis @ np.diag([5, 2]) @ basis.T, np.array([5.0, 2.0]), basis)
    rows = spark.createDataFrame([(0, 7.0), (1, 11.0)], "k long, z_hat double").withColumn("f", reference.from_indicator(ref, F.col("z_hat")))
    got = as_stack(rows, "f")
    assert np.allclose(got[0], [4.5, 2.5, 2.5, 4.5]) and np.allclose(got[1], [6.5, 4.5, 4.5, 6.5])
    plain = reference.Reference(("A", "B"), np.diag([3.0, 2.0]), np.array([3.0, 2.0]), np.eye(2))
    bad = spark.createDataFrame([(0, -1.0)], "k long, z_hat double").withColumn("f", reference.from_indicator(plain, F.col("z_hat")))
    assert np.allclose(as_stack(bad, "f")[0], [-1, 0, 0, 2])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=9, max_size=9))
def test_projector_identity(values):
    a = np.array(values).reshape(3, 3)
    s0 = a @ a.T + np.diag([3.0, 2.0, 1.0])
    ref = reference.reference_of(s0, ("A", "B", "C"))
    s = s0 + 0.1 * (a + a.T)
    z = float(np.sum(ref.projector * s))
    in_basis = ref.basis.T @ s @ ref.basis
    assert z == pytest.approx(in_basis[0, 0], abs=1e-8)
    direct = ref.basis @ np.diag([z, *ref.eigenvalues[1:]]) @ ref.basis.T
    assert np.allclose(ref.rest + z * ref.projector, direct, atol=1e-8)


def test_eigenvalues_match_lapack(spark):
    rng = np.random.default_rng(3)
    for p in (2, 3, 4):
        stack = [(lambda a: a @ a.T)(rng.standard_normal((p, p))) for _ in range(20)] + [np.eye(p) * 2]
        rows = series(spark, stack, tuple("ABCD"[:p])).rows.select("k", mx.eigenvalues(F.col("m"), p).alias("w"))
        for got, m in zip(as_stack(rows, "w"), stack, strict=True):
            assert np.allclose(got, np.linalg.eigvalsh(m)[::-1], atol=1e-9)


def random_panel(spark, n=460, seed=5, assets=("A", "N", "R")):
    rng = np.random.default_rng(seed)
    prices = 100 * np.exp(np.cumsum(rng.standard_normal((n, len(assets))) * 0.01, axis=0))
    rows = [(T0 + timedelta(minutes=i), a, float(prices[i, j])) for i in range(n) for j, a in enumerate(assets)]
    return Panel(spark.createDataFrame(rows, "ts timestamp, asset string, price double"), assets), prices


def test_block_covariances_and_design(spark):
    bound, prices = random_panel(spark)
    design = Design(spark, bound, 10)
    r = np.diff(np.log(prices), axis=0)
    want = [np.cov(r[k * 10 : k * 10 + 10].T) for k in range(len(r) // 10)]
    got = as_stack(design.series.rows)
    assert len(got) == len(want) == 45 and np.allclose(got, np.reshape(want, (-1, 9)), atol=1e-15)
    ref = design.reference
    assert np.allclose(ref.covariance, np.mean(want[: design.training], axis=0))
    z = [row["value"] for row in design.indicator_series.orderBy("pos").collect()]
    assert np.mean(z[: design.training]) == pytest.approx(ref.eigenvalues[0], rel=1e-10)
    table = {row["method"]: row for row in design.rmse(design.all_methods()).collect()}
    assert set(table) == {"direct_naive", "naive_indicator", "arfima_indicator"} and table["direct_naive"]["change_pct"] == 0
    assert forecast.unmatched(design.direct, design.naive).count() == 0
    psd = mt.psd_table(design.naive_methods, 3, ["method"], "f").where("method = 'naive_indicator'").first()
    assert psd["min_eigenvalue"] == pytest.approx(min([*z[design.training - 1 : -1], ref.eigenvalues[-1]]), rel=1e-8)


def test_incomplete_and_bad_prices_are_left_out(spark):
    rows = [(T0, "A", 1.0), (T0, "B", 2.0), (T0 + timedelta(minutes=1), "A", 1.0), (T0 + timedelta(minutes=2), "A", 3.0), (T0 + timedelta(minutes=2), "B", 4.0)]
    bound = Panel(spark.createDataFrame(rows, "ts timestamp, asset string, price double"), ("A", "B"))
    assert panel.audit(bound, 2).first().asDict() == {"n_prices": 2, "n_returns": 1, "n_in_blocks": 0, "n_trailing": 1, "n_matrices": 0, "n_incomplete": 1}
    assert np.allclose(panel.log_returns(bound).first()["r"], [math.log(3), math.log(2)])


def test_lags_and_totals_across_chunks(spark):
    rows = spark.range(100).select(F.col("id").alias("pos"), (F.col("id") * 1.5).alias("v"), F.lit("a").alias("g"))
    got = panel.with_lags(rows, {"b": ("v", 3), "c": ("v", 1)}, ["g"], chunk=8).orderBy("pos").collect()
    assert [r["b"] for r in got] == [None] * 3 + [1.5 * i for i in range(97)] and got[50]["c"] == 49 * 1.5 and len(got) == 100
    sums = panel.running_total(rows, "v", "s", ["g"], chunk=7).orderBy("pos").collect()
    assert np.allclose([r["s"] for r in sums], np.cumsum(np.arange(100) * 1.5))


def test_positions_across_months(spark):
    rows = spark.createDataFrame([(T0 + timedelta(days=int(i) * 3),) for i in np.random.default_rng(0).permutation(80)], "ts timestamp")
    got = panel.with_positions(rows).orderBy("ts").collect()
    assert [r["pos"] for r in got] == list(range(80))


def test_select_timestamps(spark):
    s = series(spark, [np.eye(2)] * 3)
    wanted = spark.createDataFrame([(T0,), (T0 + timedelta(hours=9),)], "ts timestamp")
    with pytest.raises(ValueError, match="no matrix"):
        mt.select_timestamps(s, wanted)
    assert mt.select_timestamps(s, wanted, strict=False).rows.count() == 1


def test_matching_scan_equals_sequence(spark):
    rng = np.random.default_rng(7)
    base = [0.2 * (lambda a: a + a.T)(rng.standard_normal((3, 3))) + np.diag([3.0, 1, -1]) for _ in range(40)]
    rows = series(spark, base, ("A", "B", "C")).rows.withColumnRenamed("m", "e")
    decomposed = residual.decompositions(rows, 3)
    raw = [(np.array(r["basis"]).reshape(3, 3), np.array(r["eig"])) for r in decomposed.orderBy("k").collect()]
    got = [np.array(r["basis"]).reshape(3, 3) for r in residual.matched(decomposed, 3, chunk=6).orderBy("k").collect()]
    now = raw[0][0]
    for k, (basis, _) in enumerate(raw):
        order, signs = bases.matching(now, basis)
        now = basis[:, order] * signs
        assert np.allclose(now, got[k]), k
    rebuilt = residual.matched(decomposed, 3).select("k", "e", residual.reconstructed(F.col("basis"), F.col("eig"), 3).alias("back"))
    for r in rebuilt.collect():
        assert np.allclose(r["e"], r["back"], atol=1e-10)


def test_joint_diagonalisation_finds_a_common_basis(spark):
    rng = np.random.default_rng(1)
    q = bases.random_orthogonal(3, rng)
    stack = [q @ np.diag(rng.standard_normal(3)) @ q.T for _ in range(30)]
    rows = series(spark, stack, ("A", "B", "C")).rows.withColumnRenamed("m", "e")
    tensor = residual.moment_tensor(rows, 3, 30)
    assert np.allclose(tensor, sum(np.einsum("ab,cd->abcd", m, m) for m in stack))
    basis, value, _ = bases.joint_basis(tensor, np.eye(3))
    assert value < 1e-15 and np.allclose(np.sort(np.abs(q.T @ basis), axis=0)[-1], 1, atol=1e-6)
    assert residual.share_remaining(residual.projected(rows, basis, 3), 3).first()[0] < 1e-15


def test_concentration_and_extremes(spark):
    values = [3.0, -1.0, 3.0, 0.5, -2.0]
    rows = spark.createDataFrame([(k, k, T0 + timedelta(days=40 * k), v, float(np.cumsum(values)[k])) for k, v in enumerate(values)], "k long, pos long, ts timestamp, diff double, cumulative double")
    top = {r["percent"]: r for r in evaluate.concentration(rows, (20, 40)).collect()}
    assert top[20]["top_k"] == 1 and top[20]["gain"] == 3 and top[40]["gain"] == 6 and top[40]["share_of_gross"] == pytest.approx(6 / 6.5)
    first = evaluate.extreme_events(rows, 2).where("kind = 'gain'").orderBy("rank").collect()
    assert [r["k"] for r in first] == [0, 2]
    summary = evaluate.gross(rows).first()
    assert summary["max_ts"] == T0 + timedelta(days=120) and summary["gross_loss"] == 3 and summary["n_wins"] == 3
    assert evaluate.win_share(rows).first()["win_share"] == pytest.approx(0.6)


def test_cdf_refuses_zero(spark):
    rows = spark.createDataFrame([("a", 0.0)], "s string, v double")
    with pytest.raises(Exception, match="positive and finite"):
        evaluate.empirical_cdf(rows, F.col("v"), ["s"]).collect()
