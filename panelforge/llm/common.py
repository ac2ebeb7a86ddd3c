"""Helpers shared by the training-data operators: inputs, durable intermediate tables, key columns."""

from __future__ import annotations

import ctypes
import itertools
import re
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of bytes other than ASCII white space (space, tab, LF, VT, FF, CR).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
LABEL_FOLDS = 3
#: Paths of this driver's intermediate tables.
_WRITTEN: list[str] = []
HELD_OUT_FOLD = 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that every executor sees: spark.checkpoint.dir, or the context's checkpoint folder. In local mode the
    one process sees the warehouse folder too; a cluster that names no folder is refused, as a folder of the driver's
    machine would lose what executors write."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/intermediate"
    raise ValueError("intermediate tables need a folder that all executors share: set spark.checkpoint.dir")


def stored(frame: DataFrame) -> DataFrame:
    """The frame as a table written to the shared folder: a cut in the lineage that survives lost executors."""
    spark = frame.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/panelforge-{uuid.uuid4().hex}"
    frame.write.option("compression", "zstd").parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(frame.schema).parquet(path)


def discard_stored(spark: SparkSession) -> int:
    """Deletes the intermediate tables that this driver has written so far, and says how many. For the end of a job:
    frames that still read them fail afterwards."""
    count = 0
    while _WRITTEN:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_WRITTEN.pop())
        count += bool(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True))
    return count


def held_out(doc_id: str = "doc_id"):
    """True for the rows whose labels no model may see; a null id counts as the text 'null'."""
    text = F.coalesce(F.col(doc_id).cast("string"), F.lit("null"))
    return F.crc32(text.cast("binary")) % LABEL_FOLDS == HELD_OUT_FOLD


def only(frame: DataFrame, *names: str) -> DataFrame:
    """The named columns alone, so that extra columns cannot clash with those an operator adds."""
    return frame.select(*[F.col(f"`{n}`") for n in names])


def nested(frame: DataFrame, *names: str) -> DataFrame:
    """The named columns and, as one struct __row, all columns: whatever names an operator adds beside them cannot
    clash with the frame's own."""
    return frame.select(F.struct(*[F.col(f"`{c}`") for c in frame.columns]).alias("__row"), *[F.col(f"`{n}`") for n in names])


def restored(frame: DataFrame, columns: list[str], **changed: str) -> DataFrame:
    """The frame's own columns back from __row, some of them replaced by expressions."""
    return frame.select(*[F.col(changed[c]).alias(c) if c in changed else F.col(f"__row.`{c}`") for c in columns])


def dropped(rows: DataFrame, gone: DataFrame, repeated: DataFrame, keys: list[str]) -> DataFrame:
    """The rows without those whose keys are gone, and one row only of those whose keys are repeated. gone and repeated
    are stored tables, so the planner knows their size: where they are small no row is shuffled."""

    def matched(kind: str, left: DataFrame, right: DataFrame) -> DataFrame:
        other = right.select(*[F.col(k).alias(f"__{k}") for k in keys])
        same = [left[k].eqNullSafe(other[f"__{k}"]) for k in keys]
        return left.join(other, same, kind)

    left = matched("left_anti", rows, gone)
    if repeated.isEmpty():
        return left
    return matched("left_anti", left, repeated).unionByName(matched("left_semi", left, repeated).dropDuplicates(keys))


def utf8(column: pa.Array) -> list[bytes]:
    """A text column as UTF-8 bytes; null counts as empty."""
    return [b or b"" for b in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", most_bytes: int = 4_000_000):
    """The batches again, cut so that their texts stay near most_bytes; a single longer row stands alone."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_pylist()
        if sum(sizes) <= most_bytes:
            yield batch
            continue
        ends = list(itertools.accumulate(sizes))
        start = 0
        for i in range(len(sizes)):
            before = ends[start - 1] if start else 0
            if i > start and ends[i] - before > most_bytes:
                yield batch.slice(start, i - start)
                start = i
        yield batch.slice(start)


def release() -> None:
    """Gives memory that is free inside this Python worker back to the machine; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # not this C library
        pass


def tidy(rows: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function on record batches, with its worker's memory released on the way and at its end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for n, made in enumerate(rows(batches)):
            yield made
            if n % 4 == 3:
                release()
        release()

    return run
