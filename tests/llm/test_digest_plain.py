import hashlib
import math

import numpy as np

from panelforge.llm import digest


def plain_digest(content):
    """Counted triplet by triplet with Python integers."""
    counts = [0] * 256
    padded = content + b"\0" * 8
    for i in range(len(content)):
        x = padded[i] | padded[i + 4] << 8 | padded[i + 8] << 16
        x = x * 0x9E3779B1 & 0xFFFFFFFF
        x ^= x >> 15
        x = x * 0x2C1B3C6D & 0xFFFFFFFF
        counts[x >> 13 & 255] += 1
    ordered = sorted(counts)
    bounds = [ordered[63], ordered[127], ordered[191]]
    code = min(int(math.log(len(content) + 1) / math.log(1.1)), 255)
    quartiles = [sum(c > b for b in bounds) for c in counts]
    body = [quartiles[i] << 6 | quartiles[i + 1] << 4 | quartiles[i + 2] << 2 | quartiles[i + 3] for i in range(0, 256, 4)]
    return bytes([code, *body]).hex(), quartiles, code


def plain_likeness(one, other):
    (a, qa, ca), (b, qb, cb) = one, other
    if a == b:
        return 1.0
    steps = sum({0: 0, 1: 1, 2: 2, 3: 6}[abs(x - y)] for x, y in zip(qa, qb, strict=True))
    return max(0.0, 1.0 - min(1.0, steps / 384 + min(abs(ca - cb), 8) / 8 * 0.2))


def test_query_against_plain_digests(spark):
    rng = np.random.default_rng(6)
    words = [f"{a}{b}" for a in "bcdfgh" for b in "aeiouy"]
    texts = [" ".join(rng.choice(words, int(n))) for n in rng.integers(0, 400, 150)]
    texts[7] = "w" * 300_000
    ids = rng.permutation(5000)[:150].tolist()
    ids[3], ids[4], texts[4], ids[9] = ids[5], ids[5], texts[5], None
    docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(7)
    rows = {}
    for r in digest.digest_documents(docs).collect():
        rows.setdefault((r["doc_id"], r["n_chars"]), []).append(r)
    order = sorted((k for k in range(150) if k not in (3, 4, 5)), key=lambda k: (ids[k] is None, -(ids[k] or 0)))
    whole = {k: plain_digest(texts[k].encode()) for k in range(150)}
    near = sum(len(v) for v in rows.values())
    assert near == 150
    for k, following in zip(order, order[1:] + order[:1], strict=True):
        if any((ids[k] is not None and ids[following] is not None and ids[k] > ids[5] > ids[following], ids[following] is None, ids[k] is None)):
            continue  # rows of one id follow or precede
        (row,) = rows[ids[k], len(texts[k])]
        changed = digest.edited(texts[k], texts[following])
        assert row["edited_sha256"] == hashlib.sha256(changed.encode()).hexdigest() and row["fingerprint"] == whole[k][0]
        edited = plain_digest(changed.encode())
        assert row["edited_fingerprint"] == edited[0] and abs(row["near_edited"] - plain_likeness(whole[k], edited)) < 1e-12
        assert abs(row["near_next"] - plain_likeness(whole[k], whole[following])) < 1e-12
