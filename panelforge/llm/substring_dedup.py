"""Removal of repeated passages: every byte covered by a string of 100 bytes that also starts earlier.

1. Each document is cut into contexts: runs of 100-byte windows that share a content-chosen anchor (anchors.py). Equal
   windows lie in contexts of the same anchor, at the same distance from it.
2. Contexts meet by anchor. Among equal contexts all but the earliest are repeats as a whole; they are told apart
   where they are cut (within a batch), so that a common passage travels once per batch, and then per anchor.
3. Anchors with several different contexts: the earliest of each is fetched, and the shards of these strings are
   joined by merging Burrows-Wheeler transforms (bwt.py) to the depth of 100 bytes. In every repeated interval all
   windows but the earliest are repeats.
4. The repeats' spans are united per document and cut out.

An anchor with more than HOT_CONTEXTS different contexts (say, the first bytes of a passage that follows other text
in each document) gives each window of them an anchor of its own, and these meet as in step 2, so that no anchor
gathers an unbounded group for the merge. Different contexts are counted exactly, after equal ones have met.

Defined results: null text counts as empty; texts under 100 bytes lose nothing; a null doc_id stands after all
others; rows with the same doc_id are ordered by 63 bits of their text's hash (its sign tells null ids from real ones;
n unlike texts of one id meet in them with a chance of n^2 / 2^64), and repeated rows are one document that gets one
result; extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm import bwt
from panelforge.llm.anchors import K, WINDOW, Rolling, choose, mixed
from panelforge.llm.common import slices, stored, table, tidy, utf8

HOT_CONTEXTS = 8
MERGE_BYTES = 500_000
BATCH_BYTES = 4_000_000
#: Where null ids stand; a real id of this value comes before them.
_LAST_ID = (1 << 63) - 1

#: place packs what is told of a context in its document: low, high - low - WINDOW, left, later (see _pack).
_CONTEXT = "anchor long, context long, doc long, tie long, place long"
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _keyed(documents: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    doc = F.col("doc_id").cast("long")
    hashed = F.xxhash64(text)
    sign = F.lit(-1 << 63).cast("long")
    tie = F.when(doc.isNull(), hashed.bitwiseAND(F.bitwise_not(sign))).otherwise(hashed.bitwiseOR(sign))
    return documents.select(F.coalesce(doc, F.lit(_LAST_ID)).alias("doc"), tie.alias("tie"), text.alias("text"))


def _batch_contexts(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """(document number, starts of the documents, low, high, anchor place, anchor, context) for one batch."""
    texts = utf8(batch.column("text"))
    lengths = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(lengths) - lengths
    low, high, at, anchor, context = choose(np.frombuffer(b"".join(texts), np.uint8), starts, lengths)
    ends = starts + lengths
    owner = np.searchsorted(ends, low, side="right")
    return owner, starts, low, high, at, anchor, context


def contexts(keyed: DataFrame) -> DataFrame:
    """All contexts. later: an equal context stands earlier in the same batch of rows."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, most_bytes=BATCH_BYTES):
            owner, starts, low, high, place, anchor, context = _batch_contexts(batch)
            if not len(low):
                continue
            doc = batch.column("doc").to_numpy()[owner]
            tie = batch.column("tie").to_numpy()[owner]
            left = (place - low).astype(np.int32)
            low, high = (low - starts[owner]).astype(np.int32), (high - starts[owner]).astype(np.int32)
            order = np.lexsort((low, tie, doc, context, anchor))
            later = np.empty(len(order), bool)
            later[order] = _later(*(x[order] for x in (anchor, context, doc, tie, low)))
            anchor = np.where(later, mixed(anchor + low.astype(np.uint64) + doc.astype(np.uint64)), anchor)  # these meet no one
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)), pa.array(doc), pa.array(tie), pa.array(_pack(low, high, left, later))],
                ["anchor", "context", "doc", "tie", "place"],
            )

    return keyed.mapInArrow(tidy(rows), _CONTEXT)


def _pack(low: np.ndarray, high: np.ndarray, left: np.ndarray, later: np.ndarray) -> np.ndarray:
    """One long that sorts by low. A context is at most WINDOW + REACH long."""
    return low.astype(np.int64) << 17 | (high - low - WINDOW).astype(np.int64) << 9 | left.astype(np.int64) << 1 | later


def _unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    low = (place >> 17).astype(np.int32)
    return low, low + WINDOW + (place >> 9 & 255).astype(np.int32), (place >> 1 & 255).astype(np.int32), (place & 1).astype(bool)


def _later(anchor: np.ndarray, context: np.ndarray, doc: np.ndarray, tie: np.ndarray, low: np.ndarray) -> np.ndarray:
    """For sorted contexts, those that follow a different place with the same content."""
    fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (context[1:] != context[:-1])])
    head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    return (doc != doc[head]) | (tie != tie[head]) | (low != low[head])


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From contexts sorted by anchor, context and place: spans of whole repeats (wanted false) and the earliest
    contexts of anchors that have several (wanted true). Of the anchor that a batch ends in, the first context's
    earliest place and the last context's earliest place go on to the next batch, so no more is ever held."""
    names = ["anchor", "context", "doc", "tie", "place"]
    carried: list[np.ndarray] | None = None
    told = np.zeros(0, bool)  # of the carried rows, those that are already given out

    for batch in batches:
        columns = [batch.column(n).to_numpy(zero_copy_only=False) for n in names]
        if not len(columns[0]):
            continue
        if carried is not None:
            columns = [np.concatenate([a, b]) for a, b in zip(carried, columns, strict=True)]
        anchor, context, doc, tie, place = columns
        low, high, left, later = _unpack(place)
        repeat = later | _later(anchor, context, doc, tie, low)
        fresh = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        new = np.concatenate([[True], fresh[1:] | (context[1:] != context[:-1])])
        group = np.cumsum(fresh) - 1
        several = np.bincount(group, new)[group] > 1
        wanted = several & new & ~later
        kept = repeat | wanted
        kept[: len(told)] &= ~told
        yield pa.RecordBatch.from_arrays([pa.array(x[kept]) for x in (anchor, doc, tie, low, high, left, wanted)], ["anchor", "doc", "tie", "low", "high", "left", "wanted"])
        heads = np.flatnonzero(new)
        ends = np.unique([np.flatnonzero(fresh)[-1], heads[-1]])
        out = kept | np.concatenate([told, np.zeros(len(kept) - len(told), bool)])
        carried, told = [c[ends] for c in columns], out[ends]


# --- different contexts of one anchor ------------------------------------------------------------------------------


def _packed(keyed: DataFrame) -> DataFrame:
    """(doc, tie, packed text): compressed before it is shuffled."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for batch in slices(batches):
            packed = [squeeze.compress(t) for t in utf8(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("tie"), pa.array(packed, pa.binary())], ["doc", "tie", "packed"])

    return keyed.mapInArrow(tidy(rows), "doc long, tie long, packed binary")


def _fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor()
    for batch in slices(batches, "packed", 2_000_000):
        rows = []
        for doc, tie, packed, wanted in zip(*(batch.column(c).to_pylist() for c in ("doc", "tie", "packed", "wanted")), strict=True):
            text = expand.decompress(packed)
            rows += [(w["anchor"], doc, tie, w["low"], w["left"], text[w["low"] : w["high"]]) for w in wanted]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["anchor", "doc", "tie", "low", "left", "octets"])


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every window of the contexts as a context of its own, under an anchor of its own."""
    for batch in slices(batches, "octets", 1_000_000):
        strings = batch.column("octets").to_pylist()
        lengths = np.array([len(s) for s in strings], np.int64)
        starts = np.cumsum(lengths) - lengths
        each = lengths - WINDOW + 1
        owner = np.repeat(np.arange(len(strings)), each)
        inside = np.arange(int(each.sum())) - np.repeat(np.cumsum(each) - each, each)
        at = starts[owner] + inside
        window = Rolling(np.frombuffer(b"".join(strings), np.uint8)).of(at, at + WINDOW)
        doc, tie = (batch.column(c).to_numpy()[owner] for c in ("doc", "tie"))
        low = batch.column("low").to_numpy()[owner].astype(np.int64) + inside
        place = _pack(low, low + WINDOW, np.zeros(len(low), np.int64), np.zeros(len(low), np.int64))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (mixed(window + np.uint64(1)).view(np.int64), window.view(np.int64), doc, tie, place)], ["anchor", "context", "doc", "tie", "place"]
        )


def repeated_windows(strings: list[bytes], doc: np.ndarray, tie: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, first byte, end) of the runs of windows that start earlier in another place, by the merged transforms."""
    octets, starts, lengths = bwt.collection(strings)
    place, block = bwt.repeated_blocks(octets, starts, lengths, WINDOW)
    owner = np.searchsorted(starts, place, side="right") - 1
    offset = place - starts[owner]
    _, text = np.unique(np.stack([doc, tie], axis=1), axis=0, return_inverse=True)
    key = text.reshape(-1)[owner].astype(np.int64) << 33 | (low[owner].astype(np.int64) + offset)
    head = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else np.zeros(0, np.int64)
    least = np.repeat(np.minimum.reduceat(key, head), np.diff(np.append(head, len(block)))) if len(block) else key
    again = np.sort(place[key > least])
    if not len(again):
        return again, again, again
    owner = np.searchsorted(starts, again, side="right") - 1
    fresh = np.concatenate([[True], (again[1:] != again[:-1] + 1) | (owner[1:] != owner[:-1])])
    first = np.flatnonzero(fresh)
    last = np.append(first[1:], len(again)) - 1
    owner = owner[first]
    return owner, again[first] - starts[owner], again[last] - starts[owner] + WINDOW


def _hopeful(group: list[tuple]) -> list[tuple]:
    """The contexts (anchor, doc, tie, low, left, octets) of one anchor that may share a window. Every window holds
    the half reach before the anchor or the half reach behind it, so a context that shares neither with another can
    share no window."""
    half = (WINDOW - K) // 2
    before = [row[5][row[4] - half : row[4] + K] if row[4] >= half else None for row in group]
    behind = [row[5][row[4] : row[4] + K + half] if len(row[5]) - row[4] >= K + half else None for row in group]
    seen_before, seen_behind = Counter(before), Counter(behind)
    return [
        row
        for row, a, b in zip(group, before, behind, strict=True)
        if (a is not None and seen_before[a] > 1) or (b is not None and seen_behind[b] > 1)
    ]


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From contexts sorted by anchor, the spans that merging finds; anchors are gathered up to MERGE_BYTES."""
    held: list[tuple] = []
    group: list[tuple] = []
    size = 0

    def flush() -> pa.RecordBatch:
        doc, tie, low = (np.array([row[k] for row in held], t) for k, t in ((1, np.int64), (2, np.int64), (3, np.int64)))
        owner, first, end = repeated_windows([row[5] for row in held], doc, tie, low)
        return pa.RecordBatch.from_arrays(
            [pa.array(doc[owner]), pa.array(tie[owner]), pa.array((low[owner] + first).astype(np.int32)), pa.array((low[owner] + end).astype(np.int32))],
            ["doc", "tie", "low", "high"],
        )

    for batch in batches:
        for row in zip(*(batch.column(n).to_pylist() for n in ("anchor", "doc", "tie", "low", "left", "octets")), strict=True):
            if group and row[0] != group[0][0]:
                kept = _hopeful(group)
                held += kept
                size += sum(len(k[5]) + 1 for k in kept)
                group = []
                if size >= MERGE_BYTES:
                    yield flush()
                    held, size = [], 0
            group.append(row)
    held += _hopeful(group)
    if held:
        yield flush()


# --- the whole -----------------------------------------------------------------------------------------------------


def _met(cut: DataFrame) -> DataFrame:
    """The contexts after they have met by anchor: see _meet."""
    parts = int(cut.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut.repartition(parts, "anchor").sortWithinPartitions("anchor", "context", "doc", "tie", "place")
    return dealt.mapInArrow(tidy(_meet), "anchor long, doc long, tie long, low int, high int, left int, wanted boolean")


def repeated_spans(keyed: DataFrame, most: int = HOT_CONTEXTS) -> DataFrame:
    """(doc, tie, low, high): spans whose union is what must go."""
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = stored(_met(contexts(keyed)))
    spans = met.where(~F.col("wanted")).select("doc", "tie", "low", "high")
    wanted = met.where("wanted")
    grouped = wanted.groupBy("doc", "tie").agg(F.collect_list(F.struct("anchor", "low", "high", "left")).alias("wanted"))
    fetched = _packed(keyed).join(grouped, ["doc", "tie"]).mapInArrow(tidy(_fetch), "anchor long, doc long, tie long, low int, left int, octets binary")
    hot = stored(wanted.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select("anchor"))
    if not hot.isEmpty():
        fetched = stored(fetched)
        crowded = _met(fetched.join(hot, "anchor", "left_semi").mapInArrow(tidy(_windows), _CONTEXT))
        spans = spans.unionByName(crowded.where(~F.col("wanted")).select("doc", "tie", "low", "high"))
        fetched = fetched.join(hot, "anchor", "left_anti")
    merged = fetched.repartition(parts, "anchor").sortWithinPartitions("anchor").mapInArrow(tidy(_merge), "doc long, tie long, low int, high int")
    return spans.unionByName(merged)


def _united(spans: list[dict]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for low, high in sorted((s["low"], s["high"]) for s in spans):
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    expand = zstandard.ZstdDecompressor()
    for batch in slices(batches, "packed", 2_000_000):
        kept, spans, sizes, gone = [], [], [], []
        for packed, found in zip(batch.column("packed").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            text = expand.decompress(packed)
            united = _united(found or [])
            at, parts = 0, []
            for low, high in united:
                parts.append(text[at:low])
                at = high
            parts.append(text[at:])
            kept.append(b"".join(parts))
            sizes.append(len(text))
            gone.append(len(text) - len(kept[-1]))
            spans.append([{"low": a, "high": b} for a, b in united])
        kind = pa.list_(pa.struct([("low", pa.int32()), ("high", pa.int32())]))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc"), batch.column("tie"), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kind)],
            ["doc", "tie", "n_bytes", "n_removed", "kept", "spans"],
        )


def without_repeats(documents: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, kept, spans): the bytes that stay and the maximal runs that went. Kept bytes may
    begin or end inside a character, as the rule is one on bytes."""
    keyed = _keyed(documents)
    spans = repeated_spans(keyed).groupBy("doc", "tie").agg(F.collect_list(F.struct("low", "high")).alias("spans"))
    rows = _packed(keyed).join(spans, ["doc", "tie"], "left")
    schema = "doc long, tie long, n_bytes long, n_removed long, kept binary, spans array<struct<low:int,high:int>>"
    return rows.mapInArrow(tidy(_cut), schema).select(
        F.when(F.col("tie") < 0, F.col("doc")).alias("doc_id"), "n_bytes", "n_removed", "kept", "spans"
    )


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))

