import os
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from panelforge.llm import mixing, pii, quality, simhash
from panelforge.llm.common import table

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_queries_are_registered():
    names = set(entry.queries())
    assert {f"op{n}" for n in range(1, 14)} == {m[0] for n in names if (m := re.match(r"op\d+", n))} and "pipeline" in names


def test_stages_against_their_operators(spark):
    docs = table(spark, SF, "documents")
    columns, labels = docs.columns, table(spark, SF, "labels")
    model = quality.learn(docs, labels)
    good = {r["doc_id"] for r in quality.score_documents(docs, model).where("score >= 0.5").collect()}
    one = corpus_pipeline.quality_filter(spark, docs, SF).cache()
    assert one.columns == columns and {r["doc_id"] for r in one.collect()} == good and 0 < len(good) < docs.count()
    two = corpus_pipeline.near_duplicates(spark, one, SF).cache()
    named = {r["component_id"] for r in simhash.near_duplicate_classes(one).collect()}
    assert two.columns == columns and sorted(r["doc_id"] for r in two.collect()) == sorted(named)
    three = corpus_pipeline.pii_surrogates(spark, two, SF).cache()
    found = {e["canon"] for r in pii.detected(two).select("__found").collect() for e in r["__found"] or []}
    left = {e["canon"] for r in pii.detected(three).select("__found").collect() for e in r["__found"] or []}
    assert three.columns == columns and three.count() == two.count() and found and not found & left and len(found) == len(left)
    four = corpus_pipeline.source_mix(spark, three, SF).cache()
    taken = {r["doc_id"]: r["__copies"] for r in mixing.systematic_copies(mixing.sized(three)).collect() if r["__copies"]}
    counts = {r["doc_id"]: r["count"] for r in four.groupBy("doc_id").count().collect()}
    assert four.columns == columns and counts == taken
    five = corpus_pipeline.sampled_pieces(spark, four, SF)
    assert five.count() == four.count() and five.where("not lossless").count() == 0


def test_empty_documents_pass(spark, tmp_path):
    for name in ("documents", "labels"):
        table(spark, SF, name).where("doc_id < 0").write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_run_is_repeatable(spark):
    rows = [sorted((r["doc_id"], tuple(r["pieces"])) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2)]
    assert rows[0] == rows[1]
