"""Content keys, dataset fingerprints and work that is skipped when nothing changed."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def content_key(content: Column, salt: str = "") -> Column:
    """SHA-256 of the content followed by the salt."""
    data = content.cast("binary")
    return F.sha2(F.concat(data, F.lit(salt).cast("binary")) if salt else data, 256)


def dataset_fingerprint(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """SHA-256 tree over the rows: the same for every row order and partitioning.

    Leaves are hashes of the concatenated columns with their multiplicity; they are hashed
    together by 8-digit prefix, then by 4-digit prefix, then into the root. No node has more
    than 65536 children, and copies of one row collapse into one leaf.
    """
    by = list(by)
    # every value with its length before it, NULL as a mark of its own: no two different rows read alike
    text = [F.col(c).cast("string") for c in columns]
    leaf = F.sha2(F.concat(*[F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text]), 256)
    leaves = df.groupBy(*by, leaf.alias("h")).agg(F.count(F.lit(1)).alias("n"))

    def combine(level: DataFrame, entry: Column, digits: int) -> DataFrame:
        joined = F.array_join(F.sort_array(F.collect_list(entry)), ",")
        if digits == 0:
            return level.groupBy(*by).agg(F.sha2(joined, 256).alias("fingerprint"), F.sum("n").alias("rows"))
        return level.groupBy(*by, F.substring("h", 1, digits).alias("p")).agg(
            F.sha2(joined, 256).alias("d"), F.sum("n").alias("n")
        ).select(*by, F.concat("p", F.lit("="), "d").alias("h"), "n")

    first = combine(leaves, F.concat("h", F.lit(":"), F.col("n").cast("string")), 8)
    return combine(combine(first, F.col("h"), 4), F.col("h"), 0)


def configuration_hash(config: dict) -> str:
    """SHA-256 of canonical JSON."""
    import hashlib
    import json

    return hashlib.sha256(json.dumps(config, sort_keys=True).encode("utf-8")).hexdigest()


def split_by_cache(inputs: DataFrame, cache: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(inputs whose key is cached, inputs still to compute)."""
    keys = cache.select(key).distinct()
    return inputs.join(keys, key, "left_semi"), inputs.join(keys, key, "left_anti")


def cache_stats(inputs: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """One row: hits, misses, entries."""
    keys = cache.select(key).distinct().withColumn("_hit", F.lit(True))
    entries = keys.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (
        inputs.join(keys, key, "left")
        .agg(F.count("_hit").alias("hits"), F.count_if(F.col("_hit").isNull()).alias("misses"))
        .withColumn("entries", entries)
    )


class ResultCache:
    """Results stored as Parquet under their content key; only unseen keys are computed.

    Parts are written once and never changed. A manifest of events (version, kind, part) says which parts a version holds:
    ``add`` brings one part in, ``clear`` starts anew. A reader that keeps to one version sees the same rows whatever is
    added or cleared afterwards; a part whose job died before its event was written belongs to no version.
    """

    def __init__(self, spark: SparkSession, path: str, key: str = "content_key"):
        self.spark, self.path, self.key = spark, path, key

    def _events(self) -> list[tuple[int, str, str]]:
        try:
            rows = self.spark.read.schema("version bigint, kind string, part string").parquet(f"{self.path}/manifest").collect()
        except Exception as exc:
            if "PATH_NOT_FOUND" in str(exc):
                return []
            raise
        return sorted((r.version, r.kind, r.part or "") for r in rows)  # one row per run of the cache

    def _record(self, kind: str, part: str | None = None) -> None:
        row = [(self.version() + 1, kind, part)]
        self.spark.createDataFrame(row, "version bigint, kind string, part string").coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")

    def version(self) -> int:
        """The newest version; 0 before anything was stored."""
        return max((v for v, *_ in self._events()), default=0)

    def read(self, version: int | None = None) -> DataFrame | None:
        """All results of a version (the newest one if none is named); None if it holds no part."""
        parts: list[str] = []
        for v, kind, part in self._events():
            if version is None or v <= version:
                parts = [*parts, part] if kind == "add" else []
        return self.spark.read.parquet(*[f"{self.path}/parts/{p}" for p in parts]) if parts else None

    def compute_missing(self, inputs: DataFrame, compute: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Add results for unseen keys (one per key) as a new version and return results for all inputs."""
        stored = self.read()
        wanted = inputs.dropDuplicates([self.key])
        todo = wanted if stored is None else split_by_cache(wanted, stored, self.key)[1]
        part = uuid.uuid4().hex
        compute(todo).write.parquet(f"{self.path}/parts/{part}")
        self._record("add", part)
        return inputs.select(self.key).join(self.read(), self.key, "left")

    def stats(self, inputs: DataFrame, version: int | None = None) -> DataFrame:
        stored = self.read(version)
        if stored is None:
            return inputs.agg(F.lit(0).cast("bigint").alias("hits"), F.count(F.lit(1)).alias("misses"), F.lit(0).cast("bigint").alias("entries"))
        return cache_stats(inputs, stored, self.key)

    def invalidate(self) -> None:
        """A new version without results; earlier versions stay readable."""
        self._record("clear")


def reuse_features(
    source: DataFrame,
    columns: Sequence[str],
    path: str,
    build: Callable[[DataFrame], DataFrame],
) -> DataFrame:
    """Stored feature table if it was built from the same rows, else rebuild and store it."""
    spark = source.sparkSession
    now = dataset_fingerprint(source, columns).first()
    now = now["fingerprint"] if now else ""
    try:
        then = spark.read.json(f"{path}/meta").first()["dataset_fingerprint"]
    except Exception as exc:
        if "PATH_NOT_FOUND" not in str(exc):
            raise
        then = None
    if then != now:
        build(source).write.mode("overwrite").parquet(f"{path}/features")
        meta = spark.createDataFrame([(now,)], "dataset_fingerprint string")
        meta.coalesce(1).write.mode("overwrite").json(f"{path}/meta")
    return spark.read.parquet(f"{path}/features")


def pending(names: DataFrame, completed: DataFrame, key: str) -> DataFrame:
    """Entries of ``names`` that are not completed yet."""
    return names.join(completed.filter("done").select(key), key, "left_anti")
