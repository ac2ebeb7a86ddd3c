"""Ranks and percentiles over cells against sorting, with skewed, tied and missing values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.operators import ordering


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(8)
    half = np.where(rng.random(500) < 0.5, 0.0, rng.standard_normal(500))
    return {"wide": np.exp(rng.standard_normal(400) * 8), "ties": half, "one": np.array([3.0]), "same": np.full(300, -1.5), "two": np.array([2.0, 1.0])}


@pytest.fixture(scope="module")
def frame(spark, groups):
    rows = [(g, i, float(v)) for g, x in groups.items() for i, v in enumerate(x)] + [("ties", 1000 + i, None) for i in range(5)]
    return spark.createDataFrame(rows, "g string, pos long, v double").repartition(7)


@pytest.mark.parametrize("sign", [1, -1])
@pytest.mark.parametrize("cells,chunk", [(64, 1 << 16), (4, 50), (2, 7)])
def test_ranks(frame, groups, sign, cells, chunk):
    got = {}
    for r in ordering.ranked(frame, ["g"], sign * F.col("v"), "pos", "rank", cells, chunk).collect():
        got.setdefault(r["g"], {})[r["pos"]] = r["rank"]
    for name, x in groups.items():
        order = np.lexsort((np.arange(len(x)), sign * x))
        assert [got[name][int(p)] for p in order] == list(range(1, len(x) + 1))
    assert [got["ties"][1000 + i] for i in range(5)] == list(range(501, 506))


def test_ranks_without_ties_order_and_without_groups(frame, groups):
    rows = ordering.ranked(frame.where("g = 'ties' AND v IS NOT NULL"), [], F.col("v")).collect()
    assert sorted(r["rank"] for r in rows) == list(range(1, 501))
    assert [r["v"] for r in sorted(rows, key=lambda r: r["rank"])] == sorted(groups["ties"].tolist())
    assert rows[0].asDict().keys() == {"g", "pos", "v", "rank"}


@pytest.mark.parametrize("cells", [64, 3])
def test_percentiles(frame, groups, cells):
    wanted = {"least": 0.0, "low": 0.05, "median": 0.5, "high": 0.95, "most": 1.0}
    rows = {r["g"]: r for r in ordering.percentiles(frame, ["g"], F.col("v"), wanted, cells).collect()}
    assert rows.keys() == groups.keys()
    for name, x in groups.items():
        assert [rows[name][n] for n in wanted] == pytest.approx([np.quantile(x, q) for q in wanted.values()], rel=1e-12)
    one = ordering.percentiles(frame.where("g = 'wide'"), [], F.col("v"), {"median": 0.5}).first()
    assert one["median"] == pytest.approx(np.median(groups["wide"]), rel=1e-12)


def test_empty(spark):
    none = spark.createDataFrame([], "g string, pos long, v double")
    assert ordering.ranked(none, ["g"], F.col("v"), "pos").count() == 0 and ordering.percentiles(none, ["g"], F.col("v"), {"m": 0.5}).count() == 0
