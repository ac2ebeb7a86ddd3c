"""Phrase mining against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from panelforge.llm import collocations as co


def plain(rows, least, most, top):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for n in range(1, most + 1):
                for i in range(len(words) - n + 1):
                    counts[lang, tuple(words[i : i + n])] += 1
    found = {k: c for k, c in counts.items() if len(k[1]) > 1 and c >= least}
    out = {}
    for (lang, p), a in found.items():
        longer = any(la == lang and len(q) > len(p) and c >= a and any(q[i : i + len(p)] == p for i in range(len(q))) for (la, q), c in found.items())
        if not longer:
            cuts = [(1000 * a * totals[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), counts[lang, p[:k]], counts[lang, p[k:]], totals[lang]))
    return {(lang, i + 1, r[2].decode(), -r[1], r[3], r[4], r[5], -r[0]) for lang, rs in out.items() for i, r in enumerate(sorted(rs)[:top])}


def texts(seed):
    rng = random.Random(seed)
    words = ["the", "The", "of", "a", "é", "b\xa0c", "new", "york", "𝄞", "'"]
    glue = [" ", " ", " ", "  ", "\t", ", ", ". ", "\n", "\x0b", "!?"]
    rows = [(rng.choice(["en", "de", None, "und"]), "".join(rng.choice(words) + rng.choice(glue) for _ in range(rng.randrange(60)))) for _ in range(60)]
    return rows + [("en", None), ("en", ""), ("en", " \t\n.,"), (None, "a a a a a a a"), *[("fr", "du pain et du vin")] * 5]


@pytest.mark.parametrize("most,top", [(5, 2000), (2, 3), (3, 10)])
def test_equal_to_plain_counting(spark, most, top):
    rows = texts(most)
    frame = spark.createDataFrame([(*r, "f") for r in rows], "lang string, text string, phrase string").repartition(5)
    got = {tuple(r) for r in co.collocations(frame, 5, most, top).collect()}
    assert got == plain(rows, 5, most, top) and got


def test_small_shards_and_a_crowded_filter(spark, monkeypatch):
    """Cuts at pieces change nothing, and a filter in which every bit is set only costs time."""
    rows = texts(9)
    monkeypatch.setattr(co, "_known", lambda seen, hashes: np.ones(len(hashes), bool))
    batches = [co.pa.record_batch({"lang": [r[0] for r in rows], "text": [r[1] for r in rows]})]
    total = lambda most: sum((Counter({(la, *p): c for p, c in counted(s)}) for la, s in co.shards(iter(batches), most)), Counter())

    def counted(shard):
        for ids, counts in co.phrase_counts(shard.ids, shard.joined, range(1, 6)):
            yield from zip(zip(shard.phrases(ids).to_pylist()), counts.tolist(), strict=True)

    assert total(1 << 20) == total(64) and total(64)


def test_counts_of_repeats():
    ids, joined = np.array([7, 7, 7, 7, 3, 7]), np.array([True, True, True, False, True])
    got = {tuple(int(w[i]) for w in words): int(c) for words, counts in co.phrase_counts(ids, joined, range(2, 5)) for i, c in enumerate(counts)}
    assert got == {(7, 7): 3, (3, 7): 1, (7, 7, 7): 2, (7, 7, 7, 7): 1}
    assert list(co.phrase_counts(ids, np.zeros(5, bool), range(2, 6))) == []


def test_filter_equals_its_hashes(spark):
    frame = spark.createDataFrame([("en", "the"), ("und", "é"), ("en", "of the")], "lang string, phrase string")
    seen = co.fixed_filter(frame).value
    assert len(seen) == co.FILTER_BITS // 8
    assert co._known(seen, co._hashes("en", co.pa.array([b"the", b"of the", b"off"]))).tolist() == [True, True, False]
    assert co._known(seen, co._hashes("und", co.pa.array(["é".encode(), b"the"]))).tolist() == [True, False]


def test_scores_beyond_64_bits(spark, monkeypatch):
    """Counts near 10^12: products of 10^27 stay exact."""
    a, le, r, n = 999_999_999_989, 999_999_999_991, 1_000_000_000_039, 12_345_678_901_234_567
    found = spark.createDataFrame([("en", "x", le), ("en", "y", r), ("en", "x y", a)], "lang string, phrase string, f long")
    totals = spark.createDataFrame([("en", n)], "lang string, n long")
    monkeypatch.setattr(co, "frequent_phrases", lambda *_: (found, totals))
    assert co.collocations(None).first()["score"] == 1000 * a * n // (le * r)


def test_empty_table(spark):
    assert co.collocations(spark.createDataFrame([], "lang string, text string")).count() == 0
