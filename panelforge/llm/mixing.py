"""Mixing sources to target weights by systematic sampling, with DataFrame expressions only.

Each source gets a target number of words by weight. The expected copies of its documents (target / size) are
prefix-summed in a fixed order, one random offset is added, and a document is emitted once per integer boundary
crossed. The offset is keyed by the source. Documents of a source stand in order of size, then hash bucket and id. As
the copies emitted up to any place differ from those expected by less than one, and sizes never fall in this order, the
words drawn miss the target by less than the source's largest document. Places come from counts per size, then per
(size, bucket), then ranks inside a bucket, so no group that is sorted together holds a source, however large it is.

Up to EXCHANGES times a source then passes a copy from one document that the draw rounded up to one that it rounded
down: of all such pairs the one that brings the words nearest to the target, if nearer than they are. So a source keeps
the number of copies drawn, and every document an integer next to its expected copies. Pairs are found among the sizes
of a source, one row each.

Defined results: null text has size 0; a null source is a source of its own, ordered last; a source without words
gets target 0 and nothing is taken; null ids, ties and repeated rows are separate documents; extra columns pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelforge.llm.common import WORD_PATTERN, nested, only, restored, stored, table

WEIGHT_CYCLE = (1.0, 2.0, 3.0)
MAX_COPIES = 3
BUCKETS = 1024
SEED = 20240817
EXCHANGES = 4


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD_PATTERN)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHT_CYCLE, most: float = MAX_COPIES) -> DataFrame:
    """(source, source_size, target) from rows (source, size). A target is level x weight but at most `most` times the
    source's size. Sources ordered by where they meet that bound, the level is the largest remaining share per
    remaining weight: the point at which resharing ends. The windows run over one row per source."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    one = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    one = one.withColumn("weight", F.element_at(cycle, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    bound = F.lit(float(most)) * F.col("source_size")
    by_bound = Window.orderBy((bound / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    from_here = by_bound.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    before = by_bound.rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("source_size").over(Window.partitionBy())
    share = (total - F.coalesce(F.sum(bound).over(before), F.lit(0.0))) / F.sum("weight").over(from_here)
    one = one.withColumn("share", share)
    level = F.max("share").over(Window.partitionBy())
    return one.select("source", "source_size", F.least(bound, level * F.col("weight")).alias("target"))


def _keyed(name: Column, seed: int) -> Column:
    """32 bits of a keyed hash, as a long."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), name)), 1, 8), 16, 10).cast("long")


def sized(documents: DataFrame) -> DataFrame:
    """The documents with what sampling needs of their texts: __size and __tie, and a source key that is never null."""
    return documents.withColumns(
        {
            "__size": word_count(F.col("text")),
            "__tie": F.xxhash64("text"),
            "__name": F.coalesce(F.col("doc_id").cast("string"), F.md5(F.coalesce(F.col("text"), F.lit("")))),
            "__key": F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")),
        }
    )


def systematic_copies(
    rows: DataFrame, seed: int = SEED, buckets: int = BUCKETS, weights: tuple[float, ...] = WEIGHT_CYCLE, sizes: DataFrame | None = None
) -> DataFrame:
    """Sized rows with __source_size, __target and __copies, the number of times each is emitted. Places are found on
    sizes: the same sized rows, stored without their texts where these are large. Windows run over one row per size of a
    source, per bucket of a size, and per row of a bucket."""
    rate = F.when(F.col("__source_size") > 0, F.col("__target") / F.col("__source_size")).otherwise(F.lit(0.0))
    offset = _keyed(F.col("__key"), seed) / F.lit(float(1 << 32))
    drawn = lambda place: F.floor(rate * place + offset)
    bucket = F.pmod(_keyed(F.col("__name"), SEED), F.lit(buckets))
    slim = (rows if sizes is None else sizes).withColumn("__bucket", bucket)
    cells = slim.groupBy("__key", "__size", "__bucket").agg(F.count(F.lit(1)).alias("__n"), F.first("source").alias("source"))
    each = cells.groupBy("__key", "__size").agg(F.sum("__n").alias("__n"), F.first("source").alias("source"))
    targets = source_targets(each.select("source", (F.col("__n") * F.col("__size")).alias("size")))
    targets = targets.withColumn("__key", F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null"))).drop("source")
    before = lambda group, by: F.coalesce(F.sum("__n").over(Window.partitionBy(*group).orderBy(by).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    each = each.select("__key", "__size", "__n", before(["__key"], "__size").alias("__shorter")).join(targets, "__key")
    each = each.withColumnsRenamed({"source_size": "__source_size", "target": "__target"})
    each = each.withColumn("__drawn", drawn(F.col("__shorter") + F.col("__n")) - drawn(F.col("__shorter")))
    each = exchanged(each.withColumn("__high", F.col("__drawn") - F.floor(rate) * F.col("__n")))
    places = cells.withColumn("__before", before(["__key", "__size"], "__bucket")).join(each, ["__key", "__size"]).select(
        "__key", "__size", "__bucket", "__shorter", "__change", (F.col("__before") + F.col("__shorter")).alias("__before"), "__source_size", "__target"
    )
    inside = Window.partitionBy("__key", "__size", "__bucket").orderBy(F.col("doc_id").asc_nulls_last(), "__tie")
    rows = rows.withColumn("__bucket", bucket)
    rows = rows.withColumn("__rank", F.row_number().over(inside)).join(places, ["__key", "__size", "__bucket"])
    place = F.col("__before") + F.col("__rank")
    copies, nth = drawn(place) - drawn(place - 1), place - F.col("__shorter")
    # how many documents of this size, up to this one, the draw rounded up
    highs = drawn(place) - drawn(F.col("__shorter")) - F.floor(rate) * nth
    high, change = copies > F.floor(rate), F.col("__change")
    passed = F.when(~high & (nth - highs <= change), 1).when(high & (highs <= -change), -1).otherwise(0)
    return rows.withColumn("__copies", (copies + passed).cast("long"))


def exchanged(each: DataFrame, rounds: int = EXCHANGES) -> DataFrame:
    """Adds __change, how many documents of a size gain (or, if negative, lose) a copy, to rows (__key, __size, __n,
    __drawn copies, __high documents that were rounded up, __target). A size has a row for the documents that can gain
    and one for those that can lose; in order of what a partner's size should be, the nearest partners are neighbours."""
    source = Window.partitionBy("__key")
    up_to_here = lambda *order: source.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size, left, free = F.col("__size"), F.col("__left"), F.col("__free")
    each = each.withColumn("__left", F.floor(F.max("__target").over(source) + 0.5) - F.sum(size * F.col("__drawn")).over(source))
    sides = F.array(F.struct(F.lit(False).alias("__loses"), (F.col("__n") - F.col("__high")).alias("__free")), F.struct(F.lit(True).alias("__loses"), F.col("__high").alias("__free")))
    rows = each.select("*", F.inline(sides))
    loses = F.col("__loses")
    for _ in range(rounds):
        rows = rows.withColumn("__wanted", F.when(loses, size + left).otherwise(size))
        gaining = F.when(~loses & (free > 0), size)
        rows = rows.withColumns({
            "__below": F.last(gaining, ignorenulls=True).over(up_to_here("__wanted", "__loses")),
            "__above": F.last(gaining, ignorenulls=True).over(up_to_here(F.desc("__wanted"), "__loses")),
        })
        pairs = [F.when(loses & (free > 0) & p.isNotNull(), F.struct(F.abs(left + size - p).alias("off"), size.alias("loser"), p.alias("gainer"))) for p in (F.col("__below"), F.col("__above"))]
        rows = rows.withColumn("__pair", F.least(*pairs)).withColumn("__best", F.min("__pair").over(source))
        nearer = F.coalesce(F.col("__best.off") < F.abs(left), F.lit(False))
        gained = F.when(nearer, (size == F.col("__best.gainer")).cast("long") - (size == F.col("__best.loser")).cast("long")).otherwise(F.lit(0).cast("long"))
        rows = rows.withColumns({
            "__free": free + F.when(loses, gained).otherwise(-gained),
            "__left": left - F.when(nearer, F.col("__best.gainer") - F.col("__best.loser")).otherwise(F.lit(0).cast("long")),
        })
    return rows.where(loses).select(*[c for c in each.columns if c != "__left"], (free - F.col("__high")).alias("__change"))


def mix_documents(documents: DataFrame, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """The mixed corpus: every document as many times as it is taken, with its own columns."""
    rows = sized(nested(documents, "doc_id", "source", "text")).drop("text")
    sizes = stored(sized(only(documents, "doc_id", "source", "text")).drop("text"))
    taken = systematic_copies(rows, seed, buckets, sizes=sizes).where(F.col("__copies") > 0)
    taken = taken.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("__copies"))))
    return restored(taken, documents.columns)


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    # the texts are read once; their sizes are small and read several times
    return systematic_copies(stored(sized(documents).drop("text"))).select(
        "doc_id",
        F.col("__size").alias("size"),
        F.col("__source_size").alias("source_size"),
        F.col("__target").alias("target"),
        (F.col("__copies") * F.col("__size")).alias("taken"),
    )


def _rounds(count: int) -> str:
    """The exchanges in SQL: all pairs of sizes, the best of each source."""
    return "\n".join(
        f"""b{k} AS (SELECT h.key, min(row(abs(h.away + h.size - l.size), h.size, l.size)) AS best FROM x{k - 1} h JOIN x{k - 1} l ON l.key = h.key WHERE h.highs > 0 AND l.lows > 0 GROUP BY h.key),
e{k} AS (SELECT key, best[1] AS off, best[2] AS loser, best[3] AS gainer FROM b{k}),
x{k} AS (SELECT x.key, size, away - coalesce(gainer - loser, 0) AS away, highs + coalesce((size = gainer)::BIGINT - (size = loser)::BIGINT, 0) AS highs,
  lows - coalesce((size = gainer)::BIGINT - (size = loser)::BIGINT, 0) AS lows FROM x{k - 1} x LEFT JOIN e{k} e ON e.key = x.key AND e.off < abs(x.away)),"""
        for k in range(1, count + 1)
    )


ORACLE = f"""WITH d AS (SELECT doc_id, coalesce('s' || source, 'null') AS key, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS size,
  coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, ''))) AS name FROM documents),
w AS (SELECT source, key, sum(size)::BIGINT AS source_size, {list(WEIGHT_CYCLE)}[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHT_CYCLE)} + 1]::DOUBLE AS weight FROM d GROUP BY source, key),
b AS (SELECT *, {MAX_COPIES}.0::DOUBLE * source_size AS bound FROM w),
l AS (SELECT *, ((SELECT sum(source_size)::DOUBLE FROM b) - coalesce(sum(bound) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
  / sum(weight) OVER (ORDER BY bound / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS share FROM b),
t AS (SELECT key, source_size, least(bound, (SELECT max(share) FROM l) * weight) AS target, ('0x' || substr(md5('{SEED}:' || key), 1, 8))::BIGINT / {1 << 32}.0::DOUBLE AS start FROM l),
r AS (SELECT doc_id, key, size, row_number() OVER (PARTITION BY key ORDER BY size, ('0x' || substr(md5('{SEED}:' || name), 1, 8))::BIGINT % {BUCKETS}, doc_id NULLS LAST) AS place FROM d),
p AS (SELECT r.*, source_size, target, start, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END::DOUBLE AS rate FROM r JOIN t USING (key)),
g AS (SELECT *, (floor(rate * place + start) - floor(rate * (place - 1) + start))::BIGINT AS copies FROM p),
u AS (SELECT *, copies > floor(rate) AS high, row_number() OVER (PARTITION BY key, size, copies > floor(rate) ORDER BY place) AS nth FROM g),
a AS (SELECT key, (floor(max(target) + 0.5) - sum(size * copies))::BIGINT AS away FROM u GROUP BY key),
x0 AS (SELECT key, size, away, count(*) FILTER (WHERE high) AS highs, count(*) FILTER (WHERE NOT high) AS lows FROM u JOIN a USING (key) GROUP BY key, size, away),
{_rounds(EXCHANGES)}
c AS (SELECT y.key, y.size, y.highs - x0.highs AS change FROM x{EXCHANGES} y JOIN x0 ON x0.key = y.key AND x0.size = y.size)
SELECT doc_id, u.size, source_size, target, (u.size * (copies + CASE WHEN NOT high AND nth <= change THEN 1 WHEN high AND nth <= -change THEN -1 ELSE 0 END))::BIGINT AS taken
FROM u JOIN c ON c.key = u.key AND c.size = u.size"""
