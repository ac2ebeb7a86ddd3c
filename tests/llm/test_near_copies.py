import os

import numpy as np
import pytest

import corpus_pipeline
from panelforge.llm import near_copies, simhash
from panelforge.llm.common import table

SF = "/root/testdata/sf0.001"


def sets(rows):
    return {r["doc_id"]: set(simhash.shingles((r["text"] or "").encode(), 5)) for r in rows}


def similar(a, b):
    return bool(a and b) and 5 * len(a & b) >= 4 * len(a | b)


def least_of_classes(own):
    root = {i: i for i in own}
    pairs = [(i, j) for i in own for j in own if i < j and similar(own[i], own[j])]
    for _ in own:
        for i, j in pairs:
            root[i] = root[j] = min(root[i], root[j])
    return sorted({root[i] for i in own}), len(pairs)


@pytest.mark.parametrize("most", [24, 3])
def test_near_copies_against_all_pairs(spark, monkeypatch, most):
    monkeypatch.setattr(near_copies, "FREQUENT", 4)
    rng = np.random.default_rng(8)
    words = [f"w{k}" for k in range(400)]
    notice = " ".join(rng.choice(words, 25))
    texts = [None, "", "a b", "a b", "A B"]
    for _ in range(5):
        base = rng.choice(words, int(rng.integers(60, 160))).tolist()
        for _ in range(9):
            edited = list(base)
            for at in rng.integers(0, len(base), int(rng.integers(0, 3))):
                edited[at] = str(rng.choice(words))
            texts.append(" ".join(edited) + (" " + notice if rng.random() < 0.5 else ""))
    texts += [notice + " " + " ".join(rng.choice(words, 4)) for _ in range(12)]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(None, texts[9], "x"), (None, "only here, without an id, five words", "x")]
    rows += [(9, "another text of the same id, unlike the first", "x")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, __drop2 string")
    want, pairs = least_of_classes({i: set(simhash.shingles((t or "").encode(), 5)) for i, t, _ in rows[: len(texts)]})
    kept = near_copies.without_near_copies(docs, most)
    got = [r["doc_id"] for r in kept.collect()]
    assert kept.columns == docs.columns and got.count(None) == 1 and pairs > 50
    assert sorted(i for i in got if i is not None) == sorted([*want, 9])


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_stage_leaves_no_near_copies(spark):
    docs = table(spark, SF, "documents")
    stage = dict(corpus_pipeline.STAGES)["simhash near-dedup"]
    tight = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, SF).collect()}
    rows = stage(spark, docs, SF).collect()
    want, pairs = least_of_classes({i: s for i, s in sets(docs.collect()).items() if i in tight})
    assert sorted(r["doc_id"] for r in rows) == want and pairs == 2
