"""Spelling variants against all pairs."""

import itertools
import random
import re
import zlib
from collections import Counter

from pyspark.sql import functions as F

from panelforge.llm import spelling


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    short, long = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain(rows):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m.group().lower(), run)
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += len(run) >= 7
    n = {w: c for w, c in counts.items() if c >= 2}
    form, out = {}, set()
    links = {w: [x for x in n if near(w, x)] for w in n}
    for w in n:
        best = min(links[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(links[w]), n[form[w]] if form[w] else None))
    return out


def texts():
    rng = random.Random(5)
    base = ["gardening", "GARDENING", "Überaus", "überaus", "elephant", "aaaaaaaa", "abababab", "babababa", "straße×÷", "x" * 400, "shorter", "ÿÀÀÀÀÀÀÿ"]
    rows = [(i if i % 7 else None, " ".join(rng.choice(base) for _ in range(60))) for i in range(60)]
    for w in base + ["gardenin", "gardeni"]:
        for _ in range(6):  # one edit in any place
            at, c = rng.randrange(len(w)), rng.choice("abzÀéÿ")
            for v in (w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :]):
                rows += [(rng.randrange(99), f"{v}-{v} {v}")]
    return rows + [(1, None), (None, ""), (2, "12 ,;"), (3, "same same"), (3, "same same")]


def test_equal_to_all_pairs(spark):
    rows = texts()
    frame = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n long")
    got = [tuple(r) for r in spelling.spelling_groups(frame).collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows)
    assert any(form and root != form for _, form, root, *_ in got) or any(form for _, form, *_ in got)


def test_one_edit_leaves_a_band(spark):
    rng = random.Random(1)
    pairs = []
    for _ in range(400):
        w = "".join(rng.choice("abcxyzÀÉÿ") for _ in range(rng.randrange(7, 15)))
        at, c = rng.randrange(len(w)), rng.choice("abcxyzÀÉÿ")
        pairs += [(w, v) for v in (w[:at] + w[at + 1 :], w[:at] + c + w[at:], w[:at] + c + w[at + 1 :])]
    frame = spark.createDataFrame(pairs, "a string, b string")
    bits = [x.bitwiseXOR(y) for x, y in zip(spelling.bands(F.col("a")), spelling.bands(F.col("b")), strict=True)]
    frame = frame.select(*[(b == 0).alias(f"same{i}") for i, b in enumerate(bits)], sum((F.bit_count(b) for b in bits), F.lit(0)).alias("flips"))
    for r in frame.collect():
        assert (r["same0"] or r["same1"] or r["same2"]) and r["flips"] <= 2


def test_roots_of_a_chain(spark):
    """Twelve links of growing counts, followed by doubling."""
    chain = [(f"w{i:02}", f"w{i + 1:02}", 2 * 10 ** (i + 1)) for i in range(12)]
    got = dict(tuple(r) for r in spelling._roots(spark.createDataFrame(chain, "word string, form string, form_n long")).collect())
    assert got == {f"w{i:02}": "w12" for i in range(12)}


def test_near_words_of_one_half(spark):
    """A thousand words with one first half meet only by band and half."""
    words = ["gradual" + "".join(p) for p in itertools.islice(itertools.product("abcdefghij", repeat=4), 0, 1000, 7)]
    frame = spark.createDataFrame([(w, 2) for w in words], "word string, n long")
    got = {(r["word"], r["other"]) for r in spelling.near_words(frame).collect()}
    assert got == {(a, b) for a in words for b in words if near(a, b)}


def test_empty_table(spark):
    assert spelling.spelling_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
