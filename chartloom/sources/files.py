"""File and image scans through Spark's own sources."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.functions import labels as L
from chartloom.operators.ordering import rank_in_group

IMAGE_EXTENSIONS = (".png", ".jpg", ".jpeg", ".bmp", ".webp")


def scan_files(
    spark: SparkSession, root: str, extensions: Sequence[str] | None = IMAGE_EXTENSIONS, recursive: bool = False, in_parts: bool = False
) -> DataFrame:
    """path, name, file_size, mtime of files with one of the extensions (any case).

    The content column is not selected, so file bodies are never read. With ``in_parts`` a folder whose name has one of the
    extensions is one file written in parts, as Spark writes tables: the sizes of its parts are added up and the latest time
    counts.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive or in_parts).lower())
    # without recursive lookup only the direct children of the folder are listed
    out = reader.load(root).select("path", F.col("length").alias("file_size"), F.col("modificationTime").alias("mtime"))
    wanted = None if extensions is None else "|".join(re.escape(e.lstrip(".").lower()) for e in extensions)
    if in_parts and wanted:
        whole = F.regexp_extract(_below(root), rf"^(?i)(?:.*?/)??[^/]+?\.(?:{wanted})(?=/|$)", 0)
        below = F.when(whole == "", _below(root)).otherwise(whole)
        out = out.withColumn("_inside", F.length(_below(root)) - F.length(below))
        out = out.withColumn("path", F.expr("substring(path, 1, length(path) - _inside)")).filter(F.lit(recursive) | ~below.contains("/"))
        out = out.groupBy("path").agg(F.sum("file_size").alias("file_size"), F.max("mtime").alias("mtime"))
    out = out.select("path", L.base_name(F.col("path")).alias("name"), "file_size", "mtime")
    return out if wanted is None else out.filter(F.lower("name").rlike(rf"\.({wanted})$"))


def _below(root: str) -> Column:
    """The part of ``path`` below the folder ``root``, whose scheme and slashes may be written otherwise."""
    folder = "/".join(re.escape(p) for p in re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "", root).split("/") if p not in ("", "."))
    start = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:(?://[^/]*)?)?" + ("/*" if root.startswith("/") or ":" in root else ".*?/")
    return F.regexp_replace("path", start + (folder + "/+" if folder else ""), "")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """All files of one directory, sorted by path."""
    return scan_files(spark, root, extensions=None).orderBy("path")


def count_files(spark: SparkSession, root: str, extensions: Sequence[str] = IMAGE_EXTENSIONS) -> int:
    return scan_files(spark, root, extensions, recursive=True).count()


def read_contents(spark: SparkSession, root: str, recursive: bool = True) -> DataFrame:
    """path and content, for content keys."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(root).select("path", "content")
    )


def number_rows(df: DataFrame, group: str, order: Sequence[str], name: str = "image_id") -> DataFrame:
    """Zero-based row id per group as <group>_<seven digits>."""
    ranked = rank_in_group(df, [group], order, rank_col="_r")
    return ranked.withColumn(name, F.concat(F.col(group), F.lit("_"), F.lpad(F.col("_r").cast("string"), 7, "0"))).drop("_r")


def unified_scan(spark: SparkSession, roots: dict[str, str], extensions: Sequence[str] = IMAGE_EXTENSIONS) -> DataFrame:
    """Union of the per-dataset scans with synthetic ids and labels inferred from paths."""
    return unify({name: scan_files(spark, root, extensions, recursive=True) for name, root in roots.items()})


def unify(scans: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, files in scans.items():
        part = files.withColumn("dataset_name", F.lit(name))
        out = part if out is None else out.unionByName(part)
    if out is None or out.isEmpty():
        raise ValueError("no images found in any dataset folder")
    labelled = out.select(
        "dataset_name",
        F.col("path").alias("image_path"),
        F.col("name").alias("image_name"),
        "file_size",
        L.infer_split(F.col("path")).alias("original_split"),
        L.infer_label_from_path(F.col("path")).alias("label"),
    )
    return number_rows(labelled, "dataset_name", ["image_path"])


def probe_images(spark: SparkSession, root: str, extensions: Sequence[str] = (".png", ".jpg", ".jpeg")) -> DataFrame:
    """width, height, file_size and is_corrupt per image; undecodable files read 0 x 0."""
    decoded = spark.read.format("image").option("dropInvalid", False).load(root).select(
        # the two sources write local paths with a different number of slashes
        F.regexp_replace("image.origin", "^file:/+", "file:/").alias("path"),
        F.greatest(F.col("image.width"), F.lit(0)).alias("width"),
        F.greatest(F.col("image.height"), F.lit(0)).alias("height"),
    )
    files = scan_files(spark, root, extensions)
    return files.join(decoded, "path", "left").select(
        "path",
        F.col("name").alias("image_name"),
        L.infer_label(F.col("name")).alias("label"),
        F.coalesce("width", F.lit(0)).alias("width"),
        F.coalesce("height", F.lit(0)).alias("height"),
        "file_size",
        (F.coalesce("width", F.lit(0)) == 0).cast("int").alias("is_corrupt"),
    )


def invalid_references(wanted: DataFrame, probed: DataFrame) -> DataFrame:
    """Paths of ``wanted`` that are missing or undecodable."""
    good = probed.filter(F.col("is_corrupt") == 0).select("path")
    return wanted.select("path").join(good, "path", "left_anti")


def require_valid(wanted: DataFrame, probed: DataFrame) -> None:
    bad = invalid_references(wanted, probed)
    total = bad.count()
    if total:
        sample = [r["path"] for r in bad.orderBy("path").limit(5).collect()]
        raise ValueError(f"{total} missing or undecodable images, e.g. {sample}")


def verify_and_balance(probed: DataFrame, target_total: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(verified table, balanced manifest, one-row summary) of a probed folder."""
    from chartloom.operators.sampling import first_per_class

    verified = probed.withColumn(
        "is_verified", ((F.col("is_corrupt") == 0) & (F.col("label") != L.UNKNOWN)).cast("int")
    )
    known = verified.filter(L.is_known(F.col("label")) & (F.col("is_corrupt") == 0))
    sizes = known.groupBy("label").count().agg(F.min("count").alias("m")).first()["m"] or 0
    balanced = first_per_class(known, "label", ["image_name", "path"], sizes)
    per_class = known.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    # at most one entry per class
    counts = per_class.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "n"))))).scalar()
    summary = verified.agg(
        F.count(F.lit(1)).alias("total_images"),
        F.count_if(F.col("is_corrupt") == 1).alias("corrupt"),
        F.count_if(F.col("label") == L.UNKNOWN).alias("unknown_labels"),
    ).select(
        "*",
        counts.alias("class_counts"),
        F.lit(sizes).cast("bigint").alias("per_class"),
        (F.col("total_images") >= target_total).alias("meets_target"),
    )
    return verified, balanced, summary
