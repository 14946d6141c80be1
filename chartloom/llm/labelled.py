"""Bounded labelled samples for fitting, and the split into teaching and held-out rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def held_out(id_column: Column, folds: int, fold: int) -> Column:
    """Whether a row may not teach: crc32 of its id as text falls on ``fold``. A null id counts as empty text."""
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % folds == fold


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, id_column: str = "doc_id") -> DataFrame:
    """(text, label) in one partition and fixed order: up to ``rows`` labelled rows, at most half of them of either class, the
    first by the hash of their ids. Ids are chosen from the narrow label table; as their number is bounded by ``rows``,
    they are broadcast to the texts, so only the chosen texts move, one for each id: the first of those that share it. Null
    labels, null ids and ids whose labels contradict each other teach nothing."""
    known = labels.select(F.col(f"`{id_column}`").alias("id"), F.col(label).cast("int").alias("label")).filter("id is not null and label is not null")
    known = known.groupBy("id").agg(F.min("label").alias("label"), F.max("label").alias("other")).filter("label = other").select("id", "label", F.xxhash64("id").alias("h"))
    half = [known.filter(F.col("label") == c).orderBy("h", "id").limit(rows // 2) for c in (0, 1)]
    chosen = half[0].unionByName(half[1])
    texts = docs.select(F.col(f"`{id_column}`").alias("id"), "text").join(F.broadcast(chosen), "id")
    one = texts.groupBy("h", "id", "label").agg(F.min("text").alias("text"))
    return one.repartition(1).sortWithinPartitions("h", "id").select("text", "label")
