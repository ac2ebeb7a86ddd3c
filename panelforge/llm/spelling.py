"""Spelling variant grouping by letter-parity bands.

Every word has a mask with one bit per letter: whether the letter occurs an odd number of times. One inserted, deleted
or replaced code point flips at most two bits. The letters are dealt to three bands, so two words one edit apart agree
in at least one band. Words are joined on equal bands, with a length filter: each word stands in the class of its own
length, to meet words as long and words one longer. Inside a class one edit also leaves the first or the last half of
the shorter word untouched, so the half is part of the join's key: a band alone has only a few hundred common values,
and a hot one would hold a share of the vocabulary; a band with a half holds a few words. What meets is verified by
edit distance. Of the up to six keys that a pair shares, the first alone yields it, so no pass removes repeats.

Defined results: a null text has no words; a null id counts as the text 'null'; repeated rows count again; an empty
table gives no row; extra columns are not read. Words may be of any length; no partner is left out.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.common import only, stored, table

LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A form occurs this many times as often as its variant.
FORM_RATIO = 10
NOISE_EVERY = 31
BANDS = 3
LETTERS = r"A-Za-zÀ-ÿ"
#: Letters start here; three consecutive code points take one bit in each band.
FIRST_LETTER = 96


def _taken_out(word: Column, place: Column) -> Column:
    """The word without the code point at a place from 0."""
    return F.concat(F.substring(word, F.lit(1), place), F.substring(word, place + 2, F.length(word)))


def occurrences(documents: DataFrame, least: int = LEAST_LENGTH) -> DataFrame:
    """(word): the runs of letters, A-Z lower-cased, of at least `least` code points; by the hash of id and run, one in
    31 loses a code point. A shorter run cannot become a long one, so it is not extracted."""
    runs = F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{least},}}"), F.lit(0)))
    rows = only(documents, "doc_id", "text").select("doc_id", runs.alias("run"))
    rows = rows.select("doc_id", F.translate("run", string.ascii_uppercase, string.ascii_lowercase).alias("run"))
    name = F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))
    rows = rows.withColumn("h", F.crc32(F.concat(name, F.lit(":"), "run").cast("binary")))
    shorter = _taken_out(F.col("run"), (F.col("h") % F.length("run")).cast("int"))
    word = F.when(F.col("h") % NOISE_EVERY == 0, shorter).otherwise(F.col("run"))
    return rows.select(word.alias("word")).where(F.length("word") >= least)


def vocabulary(words: DataFrame, least: int = LEAST_COUNT) -> DataFrame:
    """(word, n) of the words that occur at least `least` times."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def bands(word: Column) -> list[Column]:
    """The parity mask in three parts, each a long."""
    codes = F.transform(F.regexp_extract_all(word, F.lit("."), F.lit(0)), lambda c: F.ascii(c) - FIRST_LETTER)

    def flipped(band: int):
        bit = lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.floor(c / BANDS).cast("int"))
        return lambda acc, c: F.when(F.pmod(c, F.lit(BANDS)) == band, acc.bitwiseXOR(bit(c))).otherwise(acc)

    return [F.aggregate(codes, F.lit(0).cast("long"), flipped(b)) for b in range(BANDS)]


def _halves(word: Column, least: Column) -> list[Column]:
    """The first and the last half, where the shorter word of a pair has `least` code points."""
    first = F.floor(least / 2).cast("int")
    return [F.substring(word, F.lit(1), first), F.substring(word, F.length(word) - least + first + 1, least - first)]


def near_words(vocabulary: DataFrame) -> DataFrame:
    """(word, n, other, other_n): pairs exactly one edit apart, in both directions, each once."""
    masks = [F.col("word"), F.col("n"), F.length("word").alias("size"), F.array(*bands(F.col("word"))).alias("mask")]
    words = stored(vocabulary.select(*masks))

    def dealt(rows: DataFrame) -> DataFrame:
        """A row per key: class, half, band."""
        keys = []
        for h, half in enumerate(_halves(F.col("word"), F.col("class"))):
            for b in range(BANDS):
                key = F.xxhash64("class", F.lit(h), F.lit(b), F.get("mask", F.lit(b)), half)
                keys.append(F.struct(F.lit(h * BANDS + b).alias("kind"), key.alias("key")))
        return rows.withColumn("k", F.explode(F.array(*keys))).select("class", "k.kind", "k.key", "word", "n", "size", "mask")

    short = dealt(words.withColumn("class", F.col("size"))).drop("size")
    long = dealt(words.withColumn("class", F.explode(F.array(F.col("size"), F.col("size") - 1))))
    long = long.select("class", "kind", "key", F.col("word").alias("other"), F.col("n").alias("other_n"), "size", F.col("mask").alias("other_mask"))
    met = short.join(long, ["class", "kind", "key"]).where((F.col("size") > F.col("class")) | (F.col("word") < F.col("other")))
    # the first key that both words share; equal hashes of unlike halves are told apart here too
    ours, theirs = _halves(F.col("word"), F.col("class")), _halves(F.col("other"), F.col("class"))
    first = None
    for h in range(2):
        for b in range(BANDS):
            shared = (ours[h] == theirs[h]) & (F.get("mask", F.lit(b)) == F.get("other_mask", F.lit(b)))
            first = F.when(shared, h * BANDS + b) if first is None else first.when(shared, h * BANDS + b)
    pairs = met.where((first == F.col("kind")) & (F.levenshtein("word", "other", 1) == 1))
    ways = F.array(
        F.struct("word", "n", "other", "other_n"),
        F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")),
    )
    return pairs.select(F.inline(ways))


def _roots(forms: DataFrame) -> DataFrame:
    """(word, root) for rows (word, form, form_n): forms followed to the last by doubling. Each form is FORM_RATIO times
    as frequent as the word before it, so the longest chain follows from the largest count."""
    roots = stored(forms.select("word", F.col("form").alias("root"), "form_n"))
    most = roots.agg(F.max("form_n")).first()[0] or 0
    steps, reach = 0, LEAST_COUNT * FORM_RATIO
    while reach <= most:
        steps, reach = steps + 1, reach * FORM_RATIO
    roots, done = roots.drop("form_n"), 1
    while done < steps:
        ahead = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = stored(roots.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")))
        done *= 2
    return roots


def spelling_groups(documents: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word."""
    words = stored(vocabulary(occurrences(documents, least_length), least_count))
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("word")))
    near = near_words(words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
    chosen = -F.col("best.less") >= FORM_RATIO * F.col("n")
    near = stored(near.select("word", "n_near", F.when(chosen, F.col("best.word")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n")))
    roots = _roots(near.where(F.col("form").isNotNull()))
    made = words.join(near, "word", "left").join(roots, "word", "left")
    return made.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents").select("doc_id", "text"))


def _crc_table() -> list[int]:
    """The CRC-32 of each half byte."""
    table = []
    for value in range(16):
        for _ in range(4):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


_STEP = f"xor(c >> 4, {_crc_table()}[xor(c, b) % 16 + 1])"
#: CRC-32 by half bytes; near words are those with an equal rest after taking out one place of both (replaced), or
#: where one is the other's rest (inserted).
ORACLE = f"""WITH RECURSIVE r AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS run FROM documents),
x AS (SELECT run, hex(encode(coalesce(CAST(doc_id AS VARCHAR), 'null') || ':' || run)) AS digits FROM r WHERE length(run) >= {LEAST_LENGTH}),
h AS (SELECT run, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(range(0, length(digits) // 2), lambda i: [('0x' || digits[2 * i + 2])::BIGINT, ('0x' || digits[2 * i + 1])::BIGINT]))), lambda c, b: {_STEP}), 4294967295) AS h FROM x),
o AS (SELECT CASE WHEN h % {NOISE_EVERY} = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
w AS MATERIALIZED (SELECT word, count(*) AS n FROM o WHERE length(word) >= {LEAST_LENGTH} GROUP BY word HAVING count(*) >= {LEAST_COUNT}),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM w)),
p AS (SELECT a.word, b.word AS other, b.n AS other_n FROM d a JOIN d b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT d.word, w.word, w.n FROM d JOIN w ON d.rest = w.word UNION SELECT w.word, d.word, d.n FROM d JOIN w ON d.rest = w.word),
s AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS best, max(other_n) AS best_n FROM p GROUP BY word),
f AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= {FORM_RATIO} * n THEN best END AS form, CASE WHEN best_n >= {FORM_RATIO} * n THEN best_n END AS form_n FROM w LEFT JOIN s ON s.word = w.word),
chain AS (SELECT word, word AS root, 0 AS step FROM f UNION ALL SELECT chain.word, f.form, step + 1 FROM chain JOIN f ON f.word = chain.root WHERE f.form IS NOT NULL),
last AS (SELECT word, arg_max(root, step) AS root FROM chain GROUP BY word)
SELECT f.word, form, root, n::BIGINT AS n, n_near::BIGINT AS n_near, form_n::BIGINT AS form_n FROM f JOIN last ON last.word = f.word"""
