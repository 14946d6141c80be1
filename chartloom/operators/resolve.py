"""Joins that attach labels, resolve file references and audit their coverage.

Lookup sides are reduced to one row per key by an aggregation before they are joined, so a
key that is frequent on the left only makes a skewed probe side, which adaptive execution
splits. No side is forced to broadcast: lookups grow with the data.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.functions import labels as L

TIERS = ("raw", "original", "missing")


def last_per_key(df: DataFrame, key: str, order: Column | str, columns: Sequence[str]) -> DataFrame:
    """One row per key: the last in ``order``, as a dict built in row order would keep it."""
    picked = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*columns), order).alias("_p"))
    return picked.select(key, "_p.*")


def join_features(splits: DataFrame, features: DataFrame) -> DataFrame:
    """Inner join of splits and features on (image_path, label)."""
    return splits.join(features, ["image_path", "label"], "inner")


def attach_labels(df: DataFrame, splits: DataFrame, order: Column | str) -> DataFrame:
    """Add split, dataset_name and true_chart_type by image_name, with defaults for unmatched rows."""
    lookup = last_per_key(splits, "image_name", order, ["split", "label", "dataset_name"]).select(
        "image_name", F.col("split").alias("_s"), F.col("label").alias("_l"), F.col("dataset_name").alias("_d")
    )
    fallback = F.col("dataset_source") if "dataset_source" in df.columns else F.lit("local_raw")
    label = F.coalesce(F.col("_l"), L.infer_label(F.col("image_name")))
    return (
        df.drop("split", "dataset_name", "true_chart_type")
        .join(lookup, "image_name", "left")
        .withColumns(
            {
                "split": F.coalesce("_s", F.lit("unspecified")),
                "dataset_name": F.coalesce(F.col("_d"), fallback),
                "true_chart_type": F.when(L.is_known(label), label).otherwise(L.UNKNOWN),
            }
        )
        .drop("_s", "_l", "_d")
    )


def _index(raw: DataFrame, original: DataFrame) -> DataFrame:
    """Lower-cased file name -> first path in either store; inputs have a ``path`` column."""
    name = F.lower(L.base_name(F.col("path"))).alias("_key")
    none = F.lit(None).cast("string")
    both = raw.select(name, F.col("path").alias("_raw"), none.alias("_orig")).union(
        original.select(name, none, F.col("path"))
    )
    return both.groupBy("_key").agg(F.min("_raw").alias("_raw"), F.min("_orig").alias("_orig"))


def resolve_references(rows: DataFrame, raw: DataFrame, original: DataFrame) -> DataFrame:
    """Resolve each row by its image_name, then by the file name in image_path.

    Each candidate is looked up in the raw store first, then in the original one; the first
    hit gives ``resolved_path`` and ``tier``. Unresolved rows keep their path, tier 'missing'.
    """
    index = _index(raw, original)
    by_name = index.select(F.col("_key").alias("_k1"), F.struct("_raw", "_orig").alias("_i1"))
    by_path = index.select(F.col("_key").alias("_k2"), F.struct("_raw", "_orig").alias("_i2"))
    keyed = rows.withColumn("_k1", F.lower(F.trim("image_name"))).withColumn(
        "_k2", F.lower(L.base_name(F.col("image_path")))
    )
    joined = keyed.join(by_name, "_k1", "left").join(by_path, "_k2", "left")
    raw1, orig1, raw2, orig2 = F.col("_i1._raw"), F.col("_i1._orig"), F.col("_i2._raw"), F.col("_i2._orig")
    tier = (
        F.when(raw1.isNotNull(), "raw").when(orig1.isNotNull(), "original")
        .when(raw2.isNotNull(), "raw").when(orig2.isNotNull(), "original").otherwise("missing")
    )
    return (
        joined.withColumn("tier", tier)
        .withColumn("resolved_path", F.coalesce(raw1, orig1, raw2, orig2, F.col("image_path")))
        .drop("_k1", "_k2", "_i1", "_i2")
    )


def coverage(resolved: DataFrame) -> DataFrame:
    """Rows per tier, zero-filled."""
    tiers = resolved.sparkSession.createDataFrame([(t,) for t in TIERS], "tier string")
    counts = resolved.groupBy("tier").agg(F.count(F.lit(1)).alias("n"))
    return tiers.join(counts, "tier", "left").select("tier", F.coalesce("n", F.lit(0)).cast("bigint").alias("rows"))


def require_resolved(resolved: DataFrame) -> DataFrame:
    missing = resolved.filter(F.col("tier") == "missing").count()
    if missing:
        raise FileNotFoundError(f"could not resolve {missing} image rows")
    return resolved.withColumn("image_path", F.col("resolved_path")).drop("resolved_path", "tier")


def duplicate_names(files: DataFrame, path: str = "path", *, keep: int) -> DataFrame:
    """File names (case-folded) that occur more than once, with their count and first paths."""
    keyed = files.select(F.lower(L.base_name(F.col(path))).alias("name"), F.col(path).alias("p"))
    repeated = keyed.groupBy("name").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    # the rank filter is applied before the shuffle too, so a hot name sends few rows
    first = keyed.withColumn("_r", F.row_number().over(Window.partitionBy("name").orderBy("p"))).filter(F.col("_r") <= keep)
    paths = first.groupBy("name").agg(F.array_join(F.sort_array(F.collect_list("p")), ", ").alias("paths"))
    return repeated.join(paths, "name")


def require_unique_names(files: DataFrame, path: str = "path") -> None:
    bad = duplicate_names(files, path, keep=3).orderBy("name").limit(20).collect()
    if bad:
        raise ValueError("duplicate image file names: " + "; ".join(f"{r['name']}: {r['paths']}" for r in bad))


def join_payload(df: DataFrame, payload: DataFrame, order: Column | str, columns: Sequence[str], empty: dict[str, Column]) -> DataFrame:
    """Left join of nested payload by image_name; rows without payload get the ``empty`` values."""
    lookup = last_per_key(payload, "image_name", order, columns)
    return df.join(lookup, "image_name", "left").withColumns({c: F.coalesce(F.col(c), empty[c]) for c in columns})


def override(full: DataFrame, better: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Replace ``columns`` by the values of ``better`` for the keys it holds."""
    renamed = better.select(key, *[F.col(c).alias(f"_o_{c}") for c in columns])
    joined = full.join(renamed, key, "left")
    return joined.withColumns({c: F.coalesce(f"_o_{c}", c) for c in columns}).drop(*[f"_o_{c}" for c in columns])


def fan_out(df: DataFrame, variants: Sequence[str], column: str = "variant") -> DataFrame:
    """Every row once per configuration variant (a short fixed list), without a join."""
    return df.withColumn(column, F.explode(F.array(*[F.lit(v) for v in variants])))


def run_variants(df: DataFrame, variants: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """User callback per variant; the resulting tables are stacked with their variant name."""
    out = None
    for name, fn in variants.items():
        part = df.transform(fn).withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    return out
