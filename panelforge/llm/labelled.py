"""The bounded sample of labelled rows that the two classifiers are fitted on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import held_out

#: Fits use at most so many rows of either label, of at most so many characters each.
ROWS_PER_CLASS = 3000
MOST_CHARS = 8000


def training_rows(
    documents: DataFrame, labels: DataFrame, target: str, per_class: int = ROWS_PER_CLASS, most_chars: int = MOST_CHARS
) -> tuple[list[str], list[int], dict[int, float]]:
    """Texts, labels and, per label, the true number of rows each sampled row stands for. Rows of the held-out fold
    never enter; the sample is the rows with the smallest hash of their id, so reruns agree."""
    known = labels.where(~held_out("doc_id") & F.col(target).isin(0, 1)).groupBy("doc_id").agg(F.max(target).alias("__label"))
    totals = {r["__label"]: r["n"] for r in known.groupBy("__label").agg(F.count(F.lit(1)).alias("n")).collect()}
    ids = None
    for value in (0, 1):
        part = known.where(F.col("__label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        ids = part if ids is None else ids.unionByName(part)
    short = documents.select("doc_id", "text").where(F.col("text").isNotNull() & (F.length("text") <= most_chars))
    # at most 2 x per_class ids: 16 bytes each, whatever the input; of rows that repeat an id one text is taken
    named = short.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "__label").agg(F.min("text").alias("text"))
    rows = named.select("text", "__label", F.xxhash64("doc_id").alias("h")).collect()
    rows.sort(key=lambda r: (r["h"], r["text"]))
    texts, values = [r["text"] for r in rows], [r["__label"] for r in rows]
    share = {v: totals.get(v, 0) / max(values.count(v), 1) for v in (0, 1)}
    return texts, values, share
