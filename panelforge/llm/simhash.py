"""SimHash near-duplicate detection with a Gray-order hierarchical index.

Fingerprints are exact (repeats count). Distinct fingerprints within two bits are found so: of four 16-bit blocks two
must agree, which deals each fingerprint to six groups; inside a group the fingerprints are sorted by Gray rank and
form a tree whose nodes hold the bit pattern that all below share. Queries go down the tree together; a node's new
shared bits add to each query's differences, and queries beyond the bound leave the whole group. A group over
GROUP_MOST is dealt again by the blocks of its remaining 32 bits, and again by those of its last 16, where a group
holds 256 fingerprints at most; so no task grows with a cluster of near copies. Only a spanning set of links leaves a
group, and components are joined by distributed star rounds.

Defined results: null or empty text and text of white space have fingerprint zero; fewer than three words make one
shingle; repeated rows give repeated results; a null doc_id is linked but never names a component unless no other id
is there (then the component is null); extra columns pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from panelforge.llm.common import dropped, nested, only, restored, slices, stored, table, tidy, utf8
from panelforge.llm.components import components

SHINGLE = 3
SEED = 42
DISTANCE = 2
LEAF = 12
GROUP_MOST = 2048
_ALL = (1 << 64) - 1


# --- fingerprints --------------------------------------------------------------------------------------------------


def shingles(text: bytes, width: int = SHINGLE) -> list[bytes]:
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white space bytes
    if not words:
        return []
    if len(words) <= width:
        return [b" ".join(words)]
    joined = b" ".join(words)
    starts, at = [], 0
    for word in words:
        starts.append(at)
        at += len(word) + 1
    ends = [s - 1 for s in starts[width:]] + [len(joined)]
    return [joined[a:b] for a, b in zip(starts, ends, strict=False)]


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if it is set in over half of the shingles' hashes."""
    hashes = np.array([xxh64_intdigest(s, seed) for s in shingles(text, width)], np.uint64)
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for part in range(0, len(hashes), 4096):
        octets = hashes[part : part + 4096].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return sum(1 << k for k in np.flatnonzero(counts * 2 > len(hashes)).tolist())


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def with_fingerprints(documents: DataFrame, text: str = "text", name: str = "fp", keep_text: bool = True) -> DataFrame:
    """The documents with a signed 64-bit fingerprint column."""
    kept = [c for c in documents.columns if keep_text or c != text]
    schema = documents.select(*[F.col(f"`{c}`") for c in kept]).schema.add(name, "long")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            prints = pa.array([_signed(fingerprint(t)) for t in utf8(batch.column(text))], pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in kept], prints], [*kept, name])

    return documents.mapInArrow(tidy(rows), schema)


# --- the index inside one group ------------------------------------------------------------------------------------


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """The place of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for step in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(step)
    return rank


def index_links(codes: np.ndarray, distance: int = DISTANCE, leaf: int = LEAF) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (query, member) within the distance among distinct codes, each pair once, by the tree search."""
    order = np.argsort(gray_rank(codes), kind="stable")
    ordered = codes[order]

    def shared(part: np.ndarray) -> tuple[int, int]:
        ones, ever = int(np.bitwise_and.reduce(part)), int(np.bitwise_or.reduce(part))
        return ones, (ones | ~ever) & _ALL

    def search(low: int, high: int, queries: np.ndarray, spent: np.ndarray, used: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        pattern, mask = shared(ordered[low:high])
        fresh = np.uint64(mask & ~used)
        spent = spent + np.bitwise_count((ordered[queries] ^ np.uint64(pattern)) & fresh)
        alive = spent <= distance
        queries, spent = queries[alive], spent[alive]
        queries, spent = queries[queries < high], spent[queries < high]  # a pair is met from its earlier side
        if not len(queries):
            return
        if high - low <= leaf:
            rest = np.uint64(~mask & _ALL)
            away = spent[:, None] + np.bitwise_count((ordered[queries][:, None] ^ ordered[low:high][None, :]) & rest)
            q, m = np.nonzero((away <= distance) & (queries[:, None] < np.arange(low, high)[None, :]))
            if len(q):
                yield order[queries[q]], order[low + m]
            return
        cut = _cut(ordered[low:high]) + low
        yield from search(low, cut, queries, spent, used | mask)
        yield from search(cut, high, queries, spent, used | mask)

    if len(codes) > 1:
        yield from search(0, len(codes), np.arange(len(codes)), np.zeros(len(codes), np.int64), 0)


def _cut(part: np.ndarray) -> int:
    """Where the highest bit that differs changes. In Gray order each node's codes share the bits above it, and the
    codes with that bit set and unset are contiguous."""
    differing = int(np.bitwise_or.reduce(part) & ~np.bitwise_and.reduce(part))
    bit = np.uint64(1 << (differing.bit_length() - 1))
    return int(np.flatnonzero((part & bit) != (part[0] & bit))[0])


def spanning(codes: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links enough to join all that the distance joins: (code place, place of the first code of its class)."""
    parent = np.arange(len(codes))
    for q, m in index_links(codes, distance):
        while True:
            a, b = parent[q], parent[m]
            low, high = np.minimum(a, b), np.maximum(a, b)
            if (low == high).all():
                break
            np.minimum.at(parent, high, low)
            while (parent != parent[parent]).any():
                parent = parent[parent]
    return [(i, int(p)) for i, p in enumerate(parent.tolist()) if p != i]


# --- links over all fingerprints -----------------------------------------------------------------------------------

def _block_pairs(blocks: list[int]) -> list[int]:
    return [blocks[i] | blocks[j] for i in range(len(blocks)) for j in range(i + 1, len(blocks))]


def _split(mask: int, parts: int = 4) -> list[int]:
    """The set bits of a mask in equal runs."""
    bits = [1 << k for k in range(64) if mask >> k & 1]
    size = len(bits) // parts
    return [sum(bits[i * size : (i + 1) * size]) for i in range(parts)]


def _refined(fixed: int) -> list[int]:
    """The masks that a group agreeing on the fixed bits is dealt by."""
    return [fixed | both for both in _block_pairs(_split(~fixed & _ALL))]


def link_fingerprints(prints: DataFrame, distance: int = DISTANCE, most: int = GROUP_MOST) -> DataFrame:
    """Edges (a, b) between distinct fingerprints (column fp) that join all within the distance (two at most)."""
    if distance > 2:
        raise ValueError("two of four blocks agree only up to two differing bits")
    found = None
    dealt = prints.select("fp", F.explode(F.array(*[F.lit(_signed(m)) for m in _refined(0)])).alias("mask"))
    for level in range(3):
        dealt = dealt.withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))
        crowded = dealt.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most)
        last = level == 2
        hot = None
        if not last:
            crowded = stored(crowded.select("mask", "part"))
            hot = None if crowded.isEmpty() else crowded
        here = dealt if hot is None else dealt.join(hot, ["mask", "part"], "left_anti")
        groups = here.groupBy("mask", "part").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
        edges = groups.select("fps").mapInArrow(tidy(_group_links(distance)), "a long, b long")
        found = edges if found is None else found.unionByName(edges)
        if hot is None:
            break
        finer = {m: _refined(m & _ALL) for m in (_refined(0) if level == 0 else [y for x in _refined(0) for y in _refined(x)])}
        choices = F.create_map(*[x for m, fs in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(f)) for f in fs]))])
        dealt = dealt.join(hot, ["mask", "part"]).select("fp", F.explode(choices[F.col("mask")]).alias("mask"))
    return found


def _group_links(distance: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for fps in batch.column(0):
                codes = fps.values.to_numpy(zero_copy_only=False)
                codes = np.unique(codes)
                for i, j in spanning(codes.view(np.uint64), distance):
                    a.append(int(codes[i]))
                    b.append(int(codes[j]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return rows


def roots(prints: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(fp, least, root): the distinct fingerprints, their smallest doc_id and the fingerprint that stands for all that
    links join."""
    least = stored(prints.groupBy("fp").agg(F.min(doc_id).alias("least")))
    joined = components(link_fingerprints(least.select("fp")))
    return least.join(joined, least.fp == joined.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def classes(prints: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(fp, component_id) for the fingerprints of rows (doc_id, fp): the smallest doc_id that links reach."""
    rooted = roots(prints, doc_id)
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(ids, "root").select("fp", "component_id")


def near_duplicate_classes(documents: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id) per document."""
    prints = stored(with_fingerprints(only(documents, "doc_id", "text"), keep_text=False))
    return prints.join(classes(prints), "fp").select("doc_id", "fp", "component_id")


def deduplicated(documents: DataFrame) -> DataFrame:
    """One document of each class: of its rows the first by (doc_id, hash of the text), null ids last. Rows of one id
    whose texts fall into different classes all stay; of equal rows one stays."""
    rows = nested(documents, "doc_id", "text").withColumn("tie", F.xxhash64("text"))
    prints = stored(with_fingerprints(rows.select("doc_id", "text", "tie"), keep_text=False))
    keys = stored(prints.join(roots(prints), "fp").groupBy("root", "doc_id", "tie").agg(F.count(F.lit(1)).alias("n")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "tie", "n"))
    chosen = stored(keys.groupBy("root").agg(first.alias("first")).select("first.doc_id", "first.tie", "first.n"))
    kept = chosen.select(F.col("doc_id").alias("keep"), F.col("tie").alias("keep_tie"))
    gone = keys.join(kept, keys["doc_id"].eqNullSafe(kept["keep"]) & (keys["tie"] == kept["keep_tie"]), "left_anti")
    left = dropped(rows, stored(gone.select("doc_id", "tie")), stored(chosen.where("n > 1")), ["doc_id", "tie"])
    return restored(left, documents.columns)


def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = near_duplicate_classes(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
