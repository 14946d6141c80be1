"""Dataset manifests: label, filter, balance, split, distribution and summary."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.functions import labels as L
from chartloom.operators.sampling import balance_classes, stratified_split


@dataclass(frozen=True)
class Manifest:
    images: DataFrame
    splits: DataFrame
    distribution: DataFrame
    summary: DataFrame


def label_images(images: DataFrame) -> DataFrame:
    label = L.normalize_label(F.col("label_raw"))
    return images.withColumn("label", label).withColumn("is_known_label", L.is_known(label).cast("int"))


def split_distribution(splits: DataFrame) -> DataFrame:
    return splits.groupBy("split", "label").agg(F.count(F.lit(1)).alias("n")).orderBy("split", "label")


def dataset_summary(images: DataFrame, splits: DataFrame) -> DataFrame:
    """One row: discovered, removed and kept rows, split sizes, classes and sources present."""
    found = images.agg(
        F.count(F.lit(1)).alias("total_discovered"),
        F.count_if(F.col("is_known_label") == 0).alias("removed_unknown"),
    )
    kept = splits.agg(
        F.count(F.lit(1)).alias("known_balanced"),
        *[F.count_if(F.col("split") == s).alias(s) for s in ("train", "validation", "test")],
        F.count_distinct("label").alias("classes"),
        # sources are a handful of dataset names
        F.array_join(F.sort_array(F.collect_set("dataset_name")), ",").alias("datasets_present"),
    )
    total = found.select(F.struct("*").alias("f")).scalar()
    return kept.withColumn("_f", total).select("_f.*", *kept.columns)


def build_manifest(images: DataFrame, seed: int = 42, balance: bool = True, key: str = "image_id") -> Manifest:
    labelled = label_images(images)
    known = labelled.filter(F.col("is_known_label") == 1)
    if balance:
        known = balance_classes(known, "label", key, seed)
    splits = stratified_split(known, "label", key, seed)
    return Manifest(labelled, splits, split_distribution(splits), dataset_summary(labelled, splits))
