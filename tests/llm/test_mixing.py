"""What the mix leaves of its targets."""

import math
import os

import pytest

from panelforge.llm import mixing

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def rows(spark):
    sources = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "source")
    return mixing.op4_mix_sources(spark, SF).join(sources, "doc_id").collect()


def test_no_exchange_of_a_copy_brings_a_source_nearer(rows):
    for source in {r["source"] for r in rows}:
        own = [(r["size"], r["taken"] // r["size"]) for r in rows if r["source"] == source and r["size"]]
        one = next(r for r in rows if r["source"] == source)
        rate, left = one["target"] / one["source_size"], math.floor(one["target"] + 0.5) - sum(size * n for size, n in own)
        assert {n for _, n in own} <= {math.floor(rate), math.ceil(rate)}
        losers, gainers = ({size for size, n in own if (n > math.floor(rate)) == high} for high in (True, False))
        assert all(abs(left) <= abs(left + b - a) for b in losers for a in gainers)


def test_query_equals_its_sql(rows):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = sorted(con.sql(mixing.ORACLE).fetchall())
    assert sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in rows) == want


def test_odd_sources(spark):
    texts = [("a b c", "x"), ("a", "x"), ("", "x"), (None, "y"), ("", "y"), ("w " * 900, None), ("w " * 30, None), ("w", "z")]
    docs = spark.createDataFrame([(k, t, s) for k, (t, s) in enumerate(texts)], "doc_id long, text string, source string")
    made = {r["doc_id"]: r for r in mixing.systematic_copies(mixing.sized(docs)).collect()}
    assert len(made) == len(texts) and all(0 <= r["__copies"] <= mixing.MAX_COPIES for r in made.values())
    assert {made[k]["__target"] for k in (3, 4)} == {0.0} and made[3]["__copies"] == made[4]["__copies"] == 0
