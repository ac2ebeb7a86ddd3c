"""Near copies: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 at least.

Every such pair is found. In any order of all shingles, two sets of similarity 0.8 share one among the first
n - ceil(0.8 n) + 1 of each, so documents are grouped by these shingles. Where two sets first share a shingle, what
follows it in each bounds what they can have in common; pairs that this bound and their sizes leave are confirmed on
whole sets. Shingles that a sample of one document in SAMPLED shows to be frequent come last in the order, so a passage
that many documents share brings together only documents that hold little else; this changes costs, not results.
A group over GROUP_MOST is first compared with one document only, the one with the fewest rare shingles before the
shared one: of copies edited in different places the least edited, to which most others are similar. What that leaves
outside the group's largest class is then joined with all of the group, so a large cluster costs one comparison per
member and shingle, and no group is ever held as a whole.

Shingles are compared by 64-bit hashes. Rows are told apart by a hash of id and text, so rows of one id whose texts
differ are different documents, and of rows equal in both one stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from panelforge.llm.common import dropped, nested, only, restored, slices, stored, tidy, utf8
from panelforge.llm.components import components
from panelforge.llm.simhash import SEED, shingles

SHINGLE = 5
GROUP_MOST = 24
SAMPLED = 16
FREQUENT = 4
FREQUENT_MOST = 1_000_000
LINKS_MOST = 64
SLICES = 4
PAIRS_HELD = 200_000


def codes(text: bytes) -> np.ndarray:
    """The set of shingle hashes, ascending."""
    return np.unique(np.array([xxh64_intdigest(s, SEED) for s in shingles(text, SHINGLE)], np.uint64).view(np.int64))


def leading(own: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The shingles of a set of which a similar set shares one: frequent ones come last, then the hash decides."""
    late = np.isin(own, frequent, assume_unique=True) if len(frequent) else np.zeros(len(own), bool)
    return np.concatenate([own[~late], own[late]])[: len(own) - -(-4 * len(own) // 5) + 1]


def _sets(documents: DataFrame) -> DataFrame:
    """(doc_id, codes) of documents with words."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            made = pa.array([codes(t) for t in utf8(batch.column("text"))], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), made], ["doc_id", "codes"])

    return only(documents, "doc_id", "text").mapInArrow(tidy(rows), "doc_id long, codes array<long>").where(F.size("codes") > 0)


def _frequent(documents: DataFrame) -> np.ndarray:
    """Hashes of shingles that several of the sampled documents share: the FREQUENT_MOST most shared, 8 MB at most."""
    sample = documents.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLED)) == 0)
    counts = _sets(sample).select(F.explode("codes").alias("code")).groupBy("code").count()
    kept = counts.where(F.col("count") >= FREQUENT).orderBy(F.desc("count"), "code").limit(FREQUENT_MOST).toPandas()
    return np.sort(kept["code"].to_numpy(np.int64))


def _tokens(documents: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(token, doc_id, place): the leading shingles of each document; place packs their place in the order and the size
    of the set."""
    shared = documents.sparkSession.sparkContext.broadcast(frequent)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [codes(t) for t in utf8(batch.column("text"))]
            heads = [leading(own, shared.value) if len(own) else own for own in sets]
            sizes = [len(h) for h in heads]
            ids = np.repeat(batch.column("doc_id").to_numpy(), sizes)
            ns = np.repeat(np.array([len(own) for own in sets], np.int64), sizes)
            pos = np.concatenate([np.arange(size, dtype=np.int64) for size in sizes])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(heads)), pa.array(ids), pa.array(pos << 32 | ns)], ["token", "doc_id", "place"])

    return only(documents, "doc_id", "text").mapInArrow(tidy(rows), "token long, doc_id long, place long")


def _possible(place_i, place_j):
    """Whether sizes and what follows the shared shingle permit a similarity of 0.8. For arrays and for columns."""
    n, m = place_i % (1 << 32), place_j % (1 << 32)
    rest_i, rest_j = n - (place_i - n) / (1 << 32), m - (place_j - m) / (1 << 32)
    whole = (n + m) * 4
    return (n * 5 >= m * 4) & (m * 5 >= n * 4) & (rest_i * 9 >= whole) & (rest_j * 9 >= whole)


def _met(most: int):
    """From tokens sorted by token and place: the possible pairs of each group (token null), all of them up to
    `most` members and with the first member beyond; and the rows of larger groups again, for a second look."""
    names = ["token", "a", "b", "place"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token, ids, places, large = None, [], [], False
        pairs: set[tuple[int, int]] = set()
        again: list[tuple[int, int, int]] = []

        def packed() -> pa.RecordBatch:
            a, b = [p[0] for p in pairs] + [r[1] for r in again], [p[1] for p in pairs] + [None] * len(again)
            columns = [[None] * len(pairs) + [r[0] for r in again], a, b, [None] * len(pairs) + [r[2] for r in again]]
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)
            pairs.clear()
            again.clear()
            return made

        def close() -> None:
            if len(ids) > 1 and not large:
                near = np.array(places, np.int64)
                i, j = np.triu_indices(len(ids), 1)
                for x, y in np.stack([i, j], axis=1)[_possible(near[i], near[j])].tolist():
                    pairs.add((ids[x], ids[y]) if ids[x] < ids[y] else (ids[y], ids[x]))

        def star(doc: int, place: int) -> None:
            again.append((token, doc, place))
            if doc != ids[0] and _possible(places[0], place):
                pairs.add((min(ids[0], doc), max(ids[0], doc)))

        for batch in batches:
            for key, doc, place in zip(*(batch.column(c).to_pylist() for c in ("token", "doc_id", "place")), strict=True):
                if key != token:
                    close()
                    token, ids, places, large = key, [], [], False
                if large:
                    star(doc, place)
                    continue
                ids.append(doc)
                places.append(place)
                if len(ids) > most:
                    large = True
                    for held, at in zip(ids, places, strict=True):
                        star(held, at)
            if len(pairs) + len(again) > PAIRS_HELD:
                yield packed()
        close()
        yield packed()

    return rows


def _slices(documents: DataFrame) -> DataFrame:
    """(doc_id, n, part): the size of each set, and 32 bits of its shingles in one slice in SLICES of the hash values."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            sets = [codes(t) for t in utf8(batch.column("text"))]
            parts = [np.unique((own[own % SLICES == 0] // SLICES).astype(np.int32)) for own in sets]
            columns = [batch.column("doc_id"), pa.array([len(own) for own in sets], pa.int32()), pa.array(parts, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n", "part"])

    return only(documents, "doc_id", "text").mapInArrow(tidy(rows), "doc_id long, n int, part array<int>").where("n > 0")


def _possible_pairs(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """The stored pairs (a, b) that parts of their sets, rows (doc_id, n, part), do not refuse. What two sets share is
    at most what their parts share and the lesser number of shingles that either part lacks, be they outside the slice
    or equal in the bits kept; 9 of these must reach 4 (n + m). Where parts are whole sets this decides."""
    degree = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("links"))  # one document may lead many pairs
    salt = F.pmod(F.xxhash64("b"), F.ceil(F.col("links") / LINKS_MOST)).alias("salt")
    salted = pairs.join(degree, "a").select("a", "b", salt)
    left = salted.select("a", "salt").distinct().join(sets.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("part").alias("x")), "a")
    with_b = salted.join(sets.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("part").alias("y")), "b")
    rest = F.least(F.col("na") - F.size("x"), F.col("nb") - F.size("y"))
    shared = F.size(F.array_intersect("x", "y")) + rest
    return with_b.join(left, ["a", "salt"]).where(shared * 9 >= (F.col("na") + F.col("nb")) * 4).select("a", "b")


def _confirmed(documents: DataFrame, parts: DataFrame, pairs: DataFrame) -> DataFrame:
    """The pairs of similarity 0.8 or more: 9 common >= 4 (n + m). The stored parts of all sets refuse most pairs; the
    documents of the others are compared as a whole."""
    hopeful = stored(_possible_pairs(parts, stored(pairs)))
    wanted = stored(hopeful.select(F.col("a").alias("doc_id")).unionByName(hopeful.select(F.col("b").alias("doc_id"))).distinct())
    whole = stored(_sets(documents.join(wanted, "doc_id", "left_semi")).select("doc_id", F.size("codes").alias("n"), F.col("codes").alias("part")))
    return stored(_possible_pairs(whole, hopeful))


def links(documents: DataFrame, most: int = GROUP_MOST) -> DataFrame:
    """Edges (a, b) between the distinct ids of rows (doc_id, text) that join all near copies."""
    parts = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tokens = _tokens(documents, _frequent(documents)).repartition(parts, "token").sortWithinPartitions("token", "place", "doc_id")
    met = stored(tokens.mapInArrow(tidy(_met(most)), "token long, a long, b long, place long"))
    sets = stored(_slices(documents))
    found = _confirmed(documents, sets, met.where("token IS NULL").select("a", "b").distinct())
    # larger groups: what the first links leave outside a group's largest class meets all of the group
    joined = components(found)
    large = met.where("token IS NOT NULL").select("token", F.col("a").alias("doc_id"), "place")
    large = large.join(joined, F.col("doc_id") == F.col("node"), "left").select("token", "doc_id", "place", F.coalesce("root", "doc_id").alias("root"))
    large = stored(large)
    counts = large.groupBy("token", "root").agg(F.count(F.lit(1)).alias("n"))
    main = counts.groupBy("token").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    outside = large.join(main, "token").where("root <> main").select("token", F.col("doc_id").alias("other"), F.col("place").alias("at"), F.col("root").alias("own"))
    pairs = large.join(outside, "token").where((F.col("root") != F.col("own")) & _possible(F.col("place"), F.col("at")))
    rest = _confirmed(documents, sets, pairs.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct())
    return found.unionByName(rest)


def without_near_copies(documents: DataFrame, most: int = GROUP_MOST) -> DataFrame:
    """Of each class that near copies form the first document by (doc_id, hash of id and text), null ids last."""
    rows = nested(documents, "doc_id", "text").withColumn("key", F.xxhash64("doc_id", "text"))
    repeated = stored(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    keyed = rows.select(F.col("key").alias("doc_id"), "text")
    if not repeated.isEmpty():
        keyed = stored(keyed.dropDuplicates(["doc_id"]))
    joined = components(links(keyed, most))
    joined = stored(joined.unionByName(joined.select(F.col("root").alias("node"), "root").distinct()))
    ids = rows.select("doc_id", "key").join(joined, F.col("key") == joined["node"])
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key"))
    kept = ids.groupBy("root").agg(first.alias("first")).select(F.col("first.key").alias("node"))
    gone = stored(joined.select("node").join(kept, "node", "left_anti").select(F.col("node").alias("key")))
    return restored(dropped(rows, gone, repeated, ["key"]), documents.columns)
