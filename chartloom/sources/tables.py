"""Flat and nested table scans and sinks."""

from __future__ import annotations

import platform
import uuid

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chartloom.session import ensure_checkpoint_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder of the cluster."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header; the schema is given, so nothing is inferred from the data."""
    return spark.read.schema(schema).csv(path, header=True, escape='"', multiLine=True)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"')


def read_json(spark: SparkSession, path: str, schema: str, array_file: bool = False) -> DataFrame:
    """Nested records, one per line, or one JSON array per file."""
    return spark.read.schema(schema).json(path, multiLine=array_file)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def provenance(spark: SparkSession, seed: int, fingerprint: str, config: dict[str, object]) -> DataFrame:
    """One row that describes a run: time, seed, versions, dataset fingerprint, configuration."""
    versions = {"python": platform.python_version(), "spark": spark.version, "pyspark": pyspark.__version__}
    row = [(seed, versions, fingerprint, {k: str(v) for k, v in config.items()})]
    schema = "seed int, versions map<string,string>, dataset_fingerprint string, config map<string,string>"
    return spark.createDataFrame(row, schema).withColumn("run_at", F.current_timestamp())


def append_provenance(snapshot: DataFrame, path: str) -> None:
    snapshot.write.mode("append").json(path)
