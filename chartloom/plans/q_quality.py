"""Queries on column hygiene, JSON parameters and data-quality checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.functions import labels as L
from chartloom.functions import text as T
from chartloom.operators import quality as Q
from chartloom.plans.q_labels import STANDARD_SQL, label_sql
from chartloom.plans.registry import query
from chartloom.plans.views import oracle, table, view


@query(
    "safe_numbers",
    "P9",
    "F10",
    sql="""SELECT event_id, coalesce(TRY_CAST(replace(replace(props, '{"k": ', ''), '}', '') AS DOUBLE), 7) AS k,
 coalesce(TRY_CAST(event_type AS DOUBLE), -1) AS unreadable, CAST(0 AS DOUBLE) AS missing,
 greatest(0, least(1, value / 100)) AS bounded FROM events""",
)
def _safe(spark, sf):
    df = table(spark, sf, "events").withColumn("k", F.regexp_replace("props", r'[^0-9.]', ""))
    return df.select(
        "event_id",
        Q.safe_column(df, "k", 7.0).alias("k"),
        Q.safe_column(df, "event_type", -1.0).alias("unreadable"),
        Q.safe_column(df, "absent").alias("missing"),
        T.clip(F.col("value") / 100).alias("bounded"),
    )


@query(
    "backfill_columns",
    "P10",
    sql=oracle(
        "votes",
        """SELECT id, CASE WHEN source = 'O' THEN '/raw/bar_' || id || '.png' ELSE source || '.png' END AS image_path, heuristic_prediction,
 CAST(CASE WHEN heuristic_prediction <> 'unknown' THEN 0.55 ELSE 0 END AS DOUBLE) AS heuristic_confidence, 'bar_chart' AS true_chart_type FROM v_votes""",
    ),
)
def _backfill(spark, sf):
    df = view(spark, sf, "votes").select(
        "id",
        F.concat(F.lit("bar_"), F.col("id"), F.lit(".png")).alias("image_name"),
        F.when(F.col("source") == "O", "").otherwise(F.concat("source", F.lit(".png"))).alias("image_path"),
        F.col("heuristic_prediction").alias("predicted_chart_type"),
    )
    return Q.backfill(df, "/raw").select("id", "image_path", "heuristic_prediction", "heuristic_confidence", "true_chart_type")


def wide_features(spark, sf):
    """Embeddings as 64 feature columns f00..f63 plus an all-null column."""
    cols = [F.col("embedding")[i].cast("double").alias(f"feature_{i:02d}") for i in range(64)]
    return table(spark, sf, "embeddings").select("vec_id", "label", *cols)


@query(
    "feature_columns",
    "P11",
    sql="SELECT vec_id, CAST(label AS DOUBLE) AS histogram_score, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS feature_{i:02d}" for i in range(64)) + " FROM embeddings",
)
def _features(spark, sf):
    df = wide_features(spark, sf).withColumn("histogram_score", F.col("label").cast("double")).withColumn("other", F.lit(1))
    return df.select("vec_id", *Q.feature_columns(df))


@query(
    "flatten_records",
    "P12",
    "F14",
    sql="""SELECT event_id, CAST(json_extract(props, '$.k') AS INT) AS feature_k, event_type AS meta_kind, value AS meta_value FROM events""",
)
def _flatten(spark, sf):
    df = table(spark, sf, "events").select(
        "event_id",
        F.from_json("props", "k int").alias("params"),
        F.struct(F.col("event_type").alias("kind"), "value").alias("meta"),
    )
    return Q.flatten(df, {"params": "feature_", "meta": "meta_"})


@query(
    "drop_empty_columns",
    "P13",
    sql="SELECT event_id, CASE WHEN event_type = 'click' THEN value END AS sparse FROM events",
)
def _drop_empty(spark, sf):
    df = table(spark, sf, "events").select(
        "event_id",
        F.when(F.col("event_type") == "click", F.col("value")).alias("sparse"),
        F.when(F.col("value") < 0, F.col("value")).alias("empty"),
        F.get_json_object("props", "$.nothing").alias("also_empty"),
    )
    return Q.drop_empty_columns(df)


@query(
    "feature_groups",
    "P14",
    sql="""SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'OCR' WHEN p_size % 5 = 1 THEN 'Histogram-specific' WHEN p_size % 5 IN (2, 3) THEN 'Structural' ELSE 'Geometric' END AS feature_group FROM part""",
)
def _groups(spark, sf):
    kind = F.col("p_size") % 5
    name = (
        F.when(kind == 0, F.concat(F.lit("ocr_"), "p_name")).when(kind == 1, F.concat(F.lit("hist_"), "p_name"))
        .when(kind == 2, "bar_count").when(kind == 3, "edge_density").otherwise(F.col("p_brand"))
    )
    return table(spark, sf, "part").select("p_partkey", Q.feature_group(name).alias("feature_group"))


@query(
    "dataset_checks",
    "P15",
    sql=oracle(
        "images",
        f"""WITH s AS (SELECT {label_sql('label_raw')} AS label, lower(split_part(image_path, '/', 4)) AS split FROM v_images)
SELECT count(*) > 0 AS not_empty, count(DISTINCT split) FILTER (split IN ('train','valid','test')) = 3 AS splits_present,
 count(*) FILTER (label NOT IN {STANDARD_SQL}) = 0 AS labels_known, false AS columns_present, count(*) = 500 * 5 AS total_matches FROM s""",
    ),
)
def _checks(spark, sf):
    df = view(spark, sf, "images").select(
        "image_path", L.normalize_label(F.col("label_raw")).alias("label"), F.lower(F.split("image_path", "/")[3]).alias("split")
    )
    return Q.dataset_checks(df, splits=("train", "valid", "test"), required=("image_path", "image_hash"), per_class=500)


@query(
    "verify_run",
    "P16",
    sql=oracle(
        "votes",
        """SELECT count(*) >= 5000 AND count(*) FILTER (source = 'O') > 0 AND count(*) FILTER (source = 'P') > 0 AS datasets_ok, false AS tokens_ok,
 sum(yolo_bars + yolo_line_segments) > 0 AS elements_ok, avg(price) > 1 AS runtime_ok, 'rerun_ocr_for_low_confidence_rows' AS rerun_actions FROM v_votes""",
    ),
)
def _verify(spark, sf):
    df = view(spark, sf, "votes").withColumn("easyocr_confidence", F.col("ml_confidence"))
    return Q.verify_run(
        df, {"O": F.col("source") == "O", "P": F.col("source") == "P"}, runtime_ok=F.avg("price") > 1
    )


@query(
    "rows_to_rerun",
    "P16",
    sql=oracle("votes", "SELECT id FROM v_votes WHERE yolo_confidence <= 0"),
)
def _rerun(spark, sf):
    return Q.rows_to_rerun(view(spark, sf, "votes"), "yolo_confidence").select("id")
