"""Phrase collocation mining over word-id suffix arrays.

Each task cuts its documents into shards of one language. In a shard words become ids, pieces are put one after another
with breaks between them, and numpy prefix doubling sorts the suffixes by as many words as a phrase may have. Longest
common prefixes of neighbours, cut at breaks, part the sorted suffixes into intervals: an interval of common prefix k or
more is one phrase of k words, and its width the count. Counts are merged by key over all shards.

A phrase reaches the least count only if all its parts do. So lengths are counted in three passes - words, pairs, the
rest - and a pass breaks its pieces where a word or pair of the pass before was too rare. What was frequent is told by
a filter of a fixed number of bits, whatever the input's size: a bit set by chance lets a rare phrase be counted, and the
exact total drops it. Whatever passes is counted exactly, and what is refused is too rare to matter.

Defined results: a null text is empty; a null language is `und`; repeated rows count again; an empty table gives no row;
extra columns are not read. Texts are whole; a long one is cut into shards only where pieces end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.common import only, slices, stored, table, tidy

NO_LANGUAGE = "und"
MOST_WORDS = 5
LEAST_COUNT = 100
TOP = 2000
SHARD_BYTES = 4_000_000
#: The filter: 16 MB, whatever the input's size; a block is a row of it.
FILTER_BITS = 1 << 27
BLOCK_BITS = 1 << 16
HASH_SEED = 42
SALT = 64
SPACE, BREAK = 0x20, 0x0A
COUNTS = "lang string, phrase string, f long"


def _byte_map() -> bytes:
    """A-Z to lower case, ends of pieces to line feeds, tabs to spaces."""
    to = bytearray(range(256))
    for c in range(ord("A"), ord("Z") + 1):
        to[c] = c + 32
    for c in b".,;:!?\x0a\x0b\x0c\x0d":
        to[c] = BREAK
    to[9] = SPACE
    return bytes(to)


_MAP = _byte_map()


class Shard:
    """The words of some texts of one language: ids into a dictionary, and whether each is joined to the next."""

    def __init__(self, texts: list[bytes]):
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        inside = (data != SPACE) & (data != BREAK)
        edges = np.diff(np.concatenate([[False], inside, [False]]).astype(np.int8))
        starts, ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        offsets = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(data[inside])])
        coded = words.dictionary_encode()
        self.words = coded.dictionary.cast(pa.binary())
        self.ids = coded.indices.to_numpy().astype(np.int64)
        breaks = np.concatenate([[0], np.cumsum(data == BREAK, dtype=np.int64)])
        self.joined = breaks[starts[1:]] == breaks[ends[:-1]] if len(starts) else np.zeros(0, bool)

    def phrases(self, ids: list[np.ndarray]) -> pa.Array:
        """The phrases whose k-th words are ids[k]."""
        return pc.binary_join_element_wise(*[self.words.take(pa.array(i)) for i in ids], b" ")


def suffix_order(ids: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes in the order of their first `depth` ids, by prefix doubling: ranks of 1, 2, 4, ... ids."""
    rank, reach = ids, 1
    while True:
        later = np.zeros_like(rank)
        if reach < depth:
            later[: len(rank) - reach] = rank[reach:] + 1
        key = rank * (int(rank.max(initial=0)) + 2) + later
        order = np.argsort(key, kind="stable")
        if 2 * reach >= depth:
            return order
        ranked = key[order]
        rank = np.empty_like(rank)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        reach *= 2


def phrase_counts(ids: np.ndarray, joined: np.ndarray, lengths: range) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """For every length, (the k-th word's id for each k, count) of the distinct phrases: ids of words, and whether each is
    joined to the next."""
    most = lengths[-1]
    # stretches that are too short for the least length go; a break (0) ends every other
    bounds = np.concatenate([[0], np.flatnonzero(~joined) + 1, [len(ids)]])
    sizes = np.diff(bounds)
    kept = np.repeat(sizes >= lengths[0], sizes)
    ends = np.zeros(len(ids), bool)
    ends[bounds[1:][sizes > 0] - 1] = True
    ids, ends = ids[kept] + 1, ends[kept]
    if not len(ids):
        return
    text = np.zeros(len(ids) + int(ends.sum()), np.int64)
    text[np.arange(len(ids)) + np.cumsum(ends) - ends] = ids
    order = suffix_order(text, most)
    padded = np.concatenate([text, np.zeros(most, np.int64)])
    words = [padded[order + k] for k in range(most)]
    alive = np.ones(len(order), bool)
    same = np.ones(max(len(order) - 1, 0), bool)
    for k in range(most):
        # neighbours whose longest common prefix is above k; suffixes with more than k words before a break
        alive = alive & (words[k] > 0)
        same = same & alive[1:] & (words[k][1:] == words[k][:-1])
        if k + 1 in lengths:
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            counts = np.diff(np.append(starts, len(order)))
            real = alive[starts]
            at = starts[real]
            yield [words[j][at] - 1 for j in range(k + 1)], counts[real]


def _hashes(lang: str, phrases: pa.Array) -> np.ndarray:
    """What Spark's xxhash64 gives for (lang, phrase)."""
    seed = xxhash.xxh64_intdigest(lang.encode(), HASH_SEED)
    return np.fromiter((xxhash.xxh64_intdigest(p, seed) for p in phrases.to_pylist()), np.uint64, len(phrases))


def fixed_filter(phrases: DataFrame, bits: int = FILTER_BITS) -> Broadcast:
    """The filter of rows (lang, phrase): `bits` bits, put together block by block on the executors."""
    place = F.xxhash64("lang", "phrase").bitwiseAND(F.lit(bits - 1))
    places = phrases.select(F.floor(place / BLOCK_BITS).alias("block"), (place % BLOCK_BITS).cast("int").alias("bit"))

    def packed(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(BLOCK_BITS, bool)
        flags[pdf["bit"].to_numpy()] = True
        return pd.DataFrame({"block": [key[0]], "bits": [np.packbits(flags).tobytes()]})

    whole = bytearray(bits // 8)
    for row in places.distinct().groupBy("block").applyInPandas(packed, "block long, bits binary").toLocalIterator():
        at = row["block"] * BLOCK_BITS // 8
        whole[at : at + BLOCK_BITS // 8] = row["bits"]
    return phrases.sparkSession.sparkContext.broadcast(bytes(whole))


def _known(seen: bytes, hashes: np.ndarray) -> np.ndarray:
    bits = np.frombuffer(seen, np.uint8)
    at = (hashes & np.uint64(8 * len(bits) - 1)).astype(np.int64)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def _pieces(text: bytes, most: int) -> Iterator[bytes]:
    """The mapped text in parts of about `most` bytes that end where pieces do."""
    start = 0
    while len(text) - start > most:
        cut = text.rfind(b"\n", start, start + most)
        cut = text.find(b"\n", start + most) if cut < 0 else cut
        if cut < 0:
            break
        yield text[start:cut]
        start = cut + 1
    yield text[start:]


def shards(batches: Iterator[pa.RecordBatch], most: int = SHARD_BYTES) -> Iterator[tuple[str, Shard]]:
    """(language, shard): texts of one language are gathered up to `most` bytes, all languages up to four times that."""
    held: dict[str, list[bytes]] = {}
    sizes: dict[str, int] = {}
    for batch in slices(batches, "text", most):
        langs = batch.column("lang").fill_null(NO_LANGUAGE).to_pylist()
        for lang, text in zip(langs, batch.column("text").cast(pa.binary()).to_pylist(), strict=True):
            for part in _pieces((text or b"").translate(_MAP), most):
                held.setdefault(lang, []).append(part)
                sizes[lang] = sizes.get(lang, 0) + len(part) + 1
                if sizes[lang] >= most:
                    yield lang, Shard(held.pop(lang))
                    del sizes[lang]
        while sum(sizes.values()) > 4 * most:
            lang = max(sizes, key=sizes.get)
            yield lang, Shard(held.pop(lang))
            del sizes[lang]
    for lang, texts in held.items():
        yield lang, Shard(texts)


def _rows(lang: str, phrases: pa.Array, counts: np.ndarray) -> pa.RecordBatch:
    langs = pa.array([lang]).take(pa.array(np.zeros(len(counts), np.int64)))
    return pa.record_batch([langs, phrases.cast(pa.string()), pa.array(counts.astype(np.int64))], ["lang", "phrase", "f"])


def _counted(documents: DataFrame, lengths: range, words: Broadcast | None = None, pairs: Broadcast | None = None) -> DataFrame:
    """Counts of the phrases of some lengths, by shard. The empty phrase counts a shard's words (with length 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, shard in shards(batches):
            ids, joined = shard.ids, shard.joined
            if not len(ids):
                continue
            if words is not None:
                fine = _known(words.value, _hashes(lang, shard.words))[ids]
                joined = joined & fine[1:] & fine[:-1]
            if pairs is not None and joined.any():
                at = np.flatnonzero(joined)
                pair, back = np.unique(ids[at] * len(shard.words) + ids[at + 1], return_inverse=True)
                both = shard.phrases([pair // len(shard.words), pair % len(shard.words)])
                joined = joined.copy()
                joined[at] = _known(pairs.value, _hashes(lang, both))[back]
            for found, counts in phrase_counts(ids, joined, lengths):
                yield _rows(lang, shard.phrases(found), counts)
            if lengths[0] == 1:
                yield _rows(lang, pa.array([b""]), np.array([len(ids)]))

    return documents.mapInArrow(tidy(run), COUNTS)


def frequent_phrases(documents: DataFrame, least: int = LEAST_COUNT, most_words: int = MOST_WORDS) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, f) of all phrases of 1 to most_words words that occur `least` times, (lang, n))."""
    docs = only(documents, "lang", "text").where(F.col("text").isNotNull())
    merged = lambda counts: counts.groupBy("lang", "phrase").agg(F.sum("f").alias("f")).where((F.col("f") >= least) | (F.col("phrase") == ""))
    singles = stored(merged(_counted(docs, range(1, 2))))
    words = singles.where(F.col("phrase") != "")
    found = words
    if most_words > 1:
        seen = fixed_filter(words)
        pairs = stored(merged(_counted(docs, range(2, 3), seen)))
        found = found.unionByName(pairs)
        if most_words > 2:
            found = found.unionByName(stored(merged(_counted(docs, range(3, most_words + 1), seen, fixed_filter(pairs)))))
    return found, singles.where(F.col("phrase") == "").select("lang", F.col("f").alias("n"))


def _whole(value: Column, digits: int) -> Column:
    return value.cast(f"decimal({digits},0)")


def collocations(documents: DataFrame, least: int = LEAST_COUNT, most_words: int = MOST_WORDS, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score). Products are decimals of 38 digits, so they are exact while a * n stays
    below 10^35: corpora of 10^17 words."""
    found, totals = frequent_phrases(documents, least, most_words)
    words = F.split("phrase", " ")
    phrases = found.withColumn("words", words).where(F.size("words") > 1)
    # a longer phrase is as frequent as one inside it only if every phrase between them is, so one word more is enough
    inner = lambda at: F.array_join(F.slice("words", at, F.size("words") - 1), " ")
    inside = phrases.where(F.size("words") > 2).select("lang", F.explode(F.array_distinct(F.array(inner(1), inner(2)))).alias("phrase"), "f")
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = phrases.join(inside, ["lang", "phrase"], "left").where(F.coalesce(F.col("longer") < F.col("f"), F.lit(True)))
    cut = F.explode(F.sequence(F.lit(1), F.size("words") - 1)).alias("k")
    cuts = kept.select("lang", "phrase", F.col("f").alias("a"), "words", cut)
    cuts = cuts.withColumns({"left": F.array_join(F.slice("words", F.lit(1), F.col("k")), " "), "right": F.array_join(F.slice("words", F.col("k") + 1, F.size("words")), " ")})
    part = lambda side, name: found.select("lang", F.col("phrase").alias(side), F.col("f").alias(name))
    cuts = cuts.drop("words").join(part("left", "l"), ["lang", "left"]).join(part("right", "r"), ["lang", "right"]).join(totals, "lang")
    above = _whole(F.lit(1000), 4) * (_whole(F.col("a"), 17) * _whole(F.col("n"), 17))
    score = F.call_function("div", above, _whole(F.col("l"), 18) * _whole(F.col("r"), 18))
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.first("n").alias("n"), F.min(F.struct("score", "k", "l", "r")).alias("c"))
    scored = scored.select("lang", "phrase", "a", "c.l", "c.r", "n", "c.score")
    # the first of every salted part, then of a language: no task sorts all phrases of one language
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    salted = scored.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
    salted = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*best))).where(F.col("rank") <= top)
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents").select("lang", "text"))


_COMBINED = ", ".join(f"lead(word, {k}) OVER p AS w{k}" for k in range(1, MOST_WORDS))
_GRAMS = " UNION ALL ".join(
    f"SELECT lang, {n} AS words, concat_ws(' ', word{''.join(f', w{k}' for k in range(1, n))}) AS phrase FROM s WHERE {f'w{n - 1}' if n > 1 else 'word'} IS NOT NULL" for n in range(1, MOST_WORDS + 1)
)
ORACLE = f"""WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '{NO_LANGUAGE}') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
b AS (SELECT id, lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS piece, generate_subscripts(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]'), 1) AS i FROM d),
t AS (SELECT id, lang, i, unnest(regexp_extract_all(piece, '[^\\x20\\x09]+')) AS word, generate_subscripts(regexp_extract_all(piece, '[^\\x20\\x09]+'), 1) AS j FROM b),
s AS MATERIALIZED (SELECT lang, word, {_COMBINED} FROM t WINDOW p AS (PARTITION BY id, i ORDER BY j)),
n AS (SELECT lang, count(*) AS n FROM s GROUP BY lang),
f AS MATERIALIZED (SELECT lang, words, phrase, count(*) AS f, string_split(phrase, ' ') AS ws FROM ({_GRAMS}) GROUP BY lang, words, phrase HAVING count(*) >= {LEAST_COUNT}),
k AS (SELECT * FROM f a WHERE words > 1 AND NOT EXISTS (SELECT 1 FROM f b WHERE b.lang = a.lang AND b.words > a.words AND 100 * b.f >= 100 * a.f AND contains(' ' || b.phrase || ' ', ' ' || a.phrase || ' '))),
c AS (SELECT lang, phrase, f, ws, unnest(range(1, words)) AS cut FROM k),
x AS (SELECT c.lang, c.phrase, c.f AS a, cut, l.f AS l, r.f AS r, n.n, (1000::HUGEINT * c.f * n.n) // (l.f::HUGEINT * r.f) AS score FROM c JOIN n ON n.lang = c.lang
  JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.ws[1:cut], ' ') JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.ws[cut + 1:], ' ')),
m AS (SELECT * FROM x QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM m)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o WHERE rank <= {TOP}"""
