"""Quartile bucket digests of documents.

Byte triplets (bytes 0, 4 and 8 of a sliding window: wide enough to follow the document rather than its language) are
hashed into 256 buckets and counted. The digest is two hexadecimal digits of length code, then two bits per bucket:
the quartile of its count. Two digests differ by the steps between their quartiles (opposite ends count double) and
by length codes; the sum is bounded, and likeness is one minus its share of that bound.

For the document next in descending order of id, rows are dealt by ranges of (id, hash of the text), each of which begins
with a row of the table; that row also travels to the range before, where it follows the last row. The order is a
ring: what stands before the first such row ends the last range. So each text is shuffled once, a task needs no more
than its ranges, row by row, and many small ranges a task keep tasks alike in size.

Defined results: null text counts as empty; an empty text has the digest of no triplets; null ids stand after all
other ids; rows with the same id stand in the order of their text's hash; in a one-row table the next document is the
row itself; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import slices, table, tidy

BUCKETS = 256
RANGES_PER_PART = 24
OWN, WRAPPED, GUEST = 0, 1, 2
OFFSETS = (0, 4, 8)
LENGTH_BASE = 1.1
BODY_BOUND = 0.25
LENGTH_BOUND = 8
LENGTH_SHARE = 0.2
_STEPS = np.array([[0, 1, 2, 6], [1, 0, 1, 2], [2, 1, 0, 1], [6, 2, 1, 0]])

SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def bucket_counts(content: bytes) -> np.ndarray:
    if not content:
        return np.zeros(BUCKETS, np.int64)
    reach = OFFSETS[-1]
    octets = np.frombuffer(content + b"\0" * reach, np.uint8).astype(np.uint32)
    n = len(octets) - reach
    mixed = octets[:n] | octets[OFFSETS[1] : OFFSETS[1] + n] << 8 | octets[OFFSETS[2] : OFFSETS[2] + n] << 16
    mixed *= np.uint32(0x9E3779B1)
    mixed ^= mixed >> 15
    mixed *= np.uint32(0x2C1B3C6D)
    mixed >>= 13
    return np.bincount(mixed & (BUCKETS - 1), minlength=BUCKETS)


def digest(content: bytes) -> str:
    counts = bucket_counts(content)
    ordered = np.sort(counts)
    low, mid, high = (ordered[BUCKETS * k // 4 - 1] for k in (1, 2, 3))
    quartile = (counts > low).astype(np.uint8) + (counts > mid) + (counts > high)
    code = min(int(np.log(len(content) + 1) / np.log(LENGTH_BASE)), 255)
    four = quartile.reshape(-1, 4)
    body = four[:, 0] << 6 | four[:, 1] << 4 | four[:, 2] << 2 | four[:, 3]
    return f"{code:02x}{body.astype(np.uint8).tobytes().hex()}"


def likeness(one: str, other: str) -> float:
    """1 for equal digests, 0 at the bound of their difference."""
    if one == other:
        return 1.0
    a, b = (np.frombuffer(bytes.fromhex(x), np.uint8) for x in (one, other))
    length = min(abs(int(a[0]) - int(b[0])), LENGTH_BOUND) / LENGTH_BOUND * LENGTH_SHARE
    steps = sum(int(_STEPS[a[1:] >> k & 3, b[1:] >> k & 3].sum()) for k in (0, 2, 4, 6))
    return max(0.0, 1.0 - min(1.0, steps / (6 * BUCKETS * BODY_BOUND) + length))


def edited(text: str, following: str) -> str:
    """The text with its last third replaced by the start of the following document."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _described(doc_id, text: str, following: str, own: str, next_: str) -> tuple:
    changed = edited(text, following).encode()
    other = digest(changed)
    return doc_id, len(text), hashlib.sha256(changed).hexdigest(), own, other, likeness(own, other), likeness(own, next_)


def range_heads(rows: DataFrame, ranges: int) -> list[tuple[int | None, int]]:
    """Some (doc_id, tie) of the table, about as many as ranges asked for, chosen by their hash."""
    every = max(rows.count() // ranges, 1)
    keys = rows.select("doc_id", "tie")
    found = keys.where(F.pmod(F.xxhash64("doc_id", "tie"), F.lit(every)) == 0).distinct().collect()
    return [tuple(r) for r in found or keys.limit(1).collect()]


def _sequence(doc_id: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Keys that ascend as the ids descend; ties ascend."""
    keys = np.empty(len(tie), [("doc_id", np.int64), ("tie", np.int64)])
    keys["doc_id"], keys["tie"] = ~doc_id, tie
    return keys


def digest_documents(documents: DataFrame) -> DataFrame:
    """Per document its digest, that of its edited text, and both likenesses: see SCHEMA."""
    text = F.coalesce("text", F.lit(""))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("tie"))
    parts = max(int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    least = np.iinfo(np.int64).min  # a null id stands after all others
    found = range_heads(rows, RANGES_PER_PART * parts)
    heads = np.unique(_sequence(np.array([least if d is None else d for d, _ in found], np.int64), np.array([t for _, t in found], np.int64)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            known = batch.column("doc_id").fill_null(least).to_numpy(zero_copy_only=False)
            keys = _sequence(known, batch.column("tie").to_numpy(zero_copy_only=False))
            place = np.searchsorted(heads, keys, side="right") - 1
            yield _tagged(batch, place % len(heads), np.where(place < 0, WRAPPED, OWN))
            met = np.unique(keys, return_index=True)[1]
            met = met[heads[place[met]] == keys[met]]  # heads of ranges, once each
            if len(met):
                yield _tagged(batch.take(pa.array(met)), (place[met] - 1) % len(heads), np.full(len(met), GUEST))

    dealt = rows.mapInArrow(tidy(deal), "doc_id long, text string, tie long, place int, part int").repartition(parts, "place")
    ordered = dealt.sortWithinPartitions("place", "part", F.col("doc_id").desc_nulls_last(), "tie")
    return ordered.mapInArrow(tidy(_walk), SCHEMA)


def _tagged(batch: pa.RecordBatch, place: np.ndarray, part: np.ndarray) -> pa.RecordBatch:
    columns = [batch.column("doc_id"), batch.column("text"), batch.column("tie"), pa.array(place.astype(np.int32)), pa.array(part.astype(np.int32))]
    return pa.RecordBatch.from_arrays(columns, ["doc_id", "text", "tie", "place", "part"])


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs each row with the next one of its range; the first guest follows the last row."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    names = [part.split()[0] for part in SCHEMA.split(", ")]
    waiting = None
    for batch in slices(batches):
        found = []
        for doc_id, text, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "part")), strict=True):
            if part == GUEST and not waiting:
                continue
            mark = digest(text.encode())
            if waiting:
                found.append(_described(*waiting[:2], text, waiting[2], mark))
            waiting = None if part == GUEST else (doc_id, text, mark)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)
    if waiting:
        raise ValueError("the documents changed while they were read: a range has no follower")


def op8_document_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"))
