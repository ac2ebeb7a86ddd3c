import numpy as np
import pyarrow as pa
import pytest

from panelforge.llm import substring_dedup as dedup

NAMES = ["anchor", "context", "doc", "tie", "place"]


def met(rows, size):
    batches = [pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for n, c in zip(NAMES, zip(*rows[i : i + size], strict=True), strict=True)], NAMES)
               for i in range(0, len(rows), size)]
    return sorted(tuple(r.values()) for b in dedup._meet(iter(batches)) for r in b.to_pylist())


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_contexts_meet_alike_however_they_are_cut(size):
    rng = np.random.default_rng(4)
    rows = []
    for anchor, kinds in ((1, 1), (2, 1), (3, 5), (4, 40), (5, 1), (6, 2)):
        for context in range(kinds):
            for doc in range(int(rng.integers(1, 6))):
                low = int(rng.integers(0, 50))
                rows.append((anchor, context, doc, 0, int(dedup._pack(np.array([low]), np.array([low + 100]), np.array([3]), np.array([0]))[0])))
    rows.sort()
    whole = met(rows, len(rows))
    assert met(rows, size) == whole
    wanted = [r for r in whole if r[-1]]
    assert sorted({r[0] for r in wanted}) == [3, 4, 6] and len(wanted) == 47
    assert len(whole) - len(wanted) == len(rows) - 50


def test_one_anchor_with_contexts_in_many_batches(spark):
    """The same 28 bytes in different surroundings of many documents, a few in each partition."""
    rng = np.random.default_rng(5)
    words = [f"{a}{b}{c}" for a in "abcdefgh" for b in "ijklm" for c in "nopqr"]
    middle = "the very same words stand in each of these documents, and they are well over a hundred bytes long; " * 2
    texts = [" ".join(rng.choice(words, 60)) + middle + " ".join(rng.choice(words, 60)) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(20)
    counts = {}
    for most in (10, 4000):
        keyed = dedup._keyed(docs)
        rows = dedup.repeated_spans(keyed, most).collect()
        spans = {}
        for r in rows:
            spans.setdefault(r["doc"], []).append(r.asDict())
        counts[most] = {d: dedup._united(s) for d, s in spans.items()}
    assert counts[10] == counts[4000] and len(counts[10]) == 59 and sum(b - a for a, b in counts[10][7]) >= len(middle)
