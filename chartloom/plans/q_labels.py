"""Queries on labels, names and paths."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.functions import labels as L
from chartloom.functions import text as T
from chartloom.plans.registry import query
from chartloom.plans.views import oracle, table, view

SYNONYMS_SQL = """CASE
 WHEN {x} IN ('bar','bar_chart','vertical_bar','horizontal_bar','vbar','hbar') THEN 'bar_chart'
 WHEN {x} IN ('hist','histogram') THEN 'histogram'
 WHEN {x} IN ('line','line_chart','dot_line') THEN 'line_chart'
 WHEN {x} IN ('scatter','scatter_plot','dot','point') THEN 'scatter_plot'
 WHEN {x} IN ('pie','pie_chart','donut') THEN 'pie_chart' END"""


def label_sql(column: str) -> str:
    raw = f"lower(trim({column}))"
    compact = f"replace(replace({raw}, '-', '_'), ' ', '_')"
    return f"coalesce({SYNONYMS_SQL.format(x=raw)}, {SYNONYMS_SQL.format(x=compact)}, 'unknown')"


PATH_CASCADE_SQL = """CASE WHEN {x} LIKE '%hist%' THEN 'histogram'
 WHEN {x} LIKE '%scatter%' OR {x} LIKE '%dot%' OR {x} LIKE '%point%' THEN 'scatter_plot'
 WHEN {x} LIKE '%pie%' OR {x} LIKE '%donut%' THEN 'pie_chart'
 WHEN {x} LIKE '%line%' THEN 'line_chart'
 WHEN {x} LIKE '%bar%' THEN 'bar_chart' ELSE 'unknown' END"""
SPLIT_SQL = """CASE WHEN list_contains(string_split(lower(image_path), '/'), 'train') THEN 'train'
 WHEN len(list_intersect(string_split(lower(image_path), '/'), ['val','valid','validation'])) > 0 THEN 'validation'
 WHEN list_contains(string_split(lower(image_path), '/'), 'test') THEN 'test' ELSE 'unspecified' END"""
SOURCE_SQL = """CASE WHEN starts_with(lower(image_name), 'plotqa') THEN 'plotqa'
 WHEN starts_with(lower(image_name), 'dvqa') THEN 'dvqa'
 WHEN starts_with(lower(image_name), 'chartqa') THEN 'chartqa'
 WHEN starts_with(lower(image_name), 'synthetic') THEN 'synthetic' ELSE 'unknown' END"""
STANDARD_SQL = "('bar_chart','histogram','line_chart','scatter_plot','pie_chart')"


@query(
    "label_normalise",
    "P1",
    sql=oracle("images", f"SELECT image_id, {label_sql('label_raw')} AS label FROM v_images"),
)
def _normalise(spark, sf):
    return view(spark, sf, "images").select("image_id", L.normalize_label(F.col("label_raw")).alias("label"))


@query(
    "label_from_path",
    "P2",
    sql=f"""
SELECT id, origin, {PATH_CASCADE_SQL.format(x='t')} AS label FROM (
  SELECT page_id AS id, 'url' AS origin, regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g') AS t FROM pages
  UNION ALL
  SELECT doc_id, 'text', regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g') FROM documents
) q""",
)
def _from_path(spark, sf):
    urls = table(spark, sf, "pages").select(F.col("page_id").alias("id"), F.lit("url").alias("origin"), F.col("url").alias("t"))
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.lit("text").alias("origin"), F.col("text").alias("t"))
    return urls.unionByName(texts).select("id", "origin", L.infer_label_from_path(F.col("t")).alias("label"))


@query(
    "label_cascades",
    "P3",
    sql="""
SELECT doc_id,
 CASE WHEN t LIKE '%bar%' THEN 'bar_chart' WHEN t LIKE '%hist%' THEN 'histogram' WHEN t LIKE '%line%' THEN 'line_chart'
      WHEN t LIKE '%scatter%' THEN 'scatter_plot' WHEN t LIKE '%pie%' THEN 'pie_chart' ELSE 'unknown' END AS by_file,
 CASE WHEN t LIKE '%hist%' THEN 'histogram' WHEN t LIKE '%scatter%' THEN 'scatter_plot' WHEN t LIKE '%line%' THEN 'line_chart'
      WHEN t LIKE '%pie%' THEN 'pie_chart' WHEN t LIKE '%bar%' THEN 'bar_chart' ELSE 'unknown' END AS by_manifest,
 CASE WHEN t LIKE '%bar%' THEN 'bar_chart' WHEN t LIKE '%pie%' THEN 'pie_chart' WHEN t LIKE '%line%' THEN 'line_chart'
      WHEN t LIKE '%scatter%' THEN 'scatter_plot' WHEN t LIKE '%histogram%' THEN 'histogram' ELSE 'unknown' END AS by_benchmark
FROM (SELECT doc_id, lower(text) AS t FROM documents) q""",
)
def _cascades(spark, sf):
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id",
        L.infer_label(text).alias("by_file"),
        L.infer_label(text, L.MANIFEST_KEYWORDS).alias("by_manifest"),
        L.infer_label(text, L.BENCHMARK_KEYWORDS).alias("by_benchmark"),
    )


@query("source_from_name", "P4", sql=oracle("images", f"SELECT image_id, {SOURCE_SQL} AS source FROM v_images"))
def _source(spark, sf):
    return view(spark, sf, "images").select("image_id", L.infer_source(F.col("image_name")).alias("source"))


@query("split_from_path", "P5", sql=oracle("images", f"SELECT image_id, {SPLIT_SQL} AS split FROM v_images"))
def _split(spark, sf):
    return view(spark, sf, "images").select("image_id", L.infer_split(F.col("image_path")).alias("split"))


@query(
    "base_name",
    "P6",
    sql=oracle(
        "images",
        """SELECT image_id, split_part(image_path, '/', 5) AS from_posix,
 regexp_extract(url, '([^/]*)/*$', 1) AS from_url,
 split_part(image_path, '/', 5) AS from_windows FROM v_images""",
    ),
)
def _base_name(spark, sf):
    return view(spark, sf, "images").select(
        "image_id",
        L.base_name(F.col("image_path")).alias("from_posix"),
        L.base_name(F.col("url")).alias("from_url"),
        L.base_name(F.translate("image_path", "/", "\\")).alias("from_windows"),
    )


@query(
    "known_label_flags",
    "P7",
    sql=oracle(
        "images",
        f"""SELECT image_id, CAST(l IN {STANDARD_SQL} AS INT) AS is_known_label,
 CAST(l <> 'unknown' AND file_size > 0 AS INT) AS is_verified
FROM (SELECT *, {label_sql('label_raw')} AS l FROM v_images) q""",
    ),
)
def _known(spark, sf):
    label = L.normalize_label(F.col("label_raw"))
    return view(spark, sf, "images").select(
        "image_id",
        L.is_known(label).cast("int").alias("is_known_label"),
        ((label != L.UNKNOWN) & (F.col("file_size") > 0)).cast("int").alias("is_verified"),
    )


@query(
    "evaluation_mask",
    "P8",
    sql=oracle("pred", "SELECT id, truth, pred FROM v_pred WHERE truth <> 'unknown'"),
)
def _mask(spark, sf):
    return view(spark, sf, "pred").filter(F.col("truth") != L.UNKNOWN).select("id", "truth", "pred")


@query(
    "label_counts",
    "A1",
    sql=oracle("images", f"SELECT {label_sql('label_raw')} AS label, count(*) AS n FROM v_images GROUP BY 1"),
)
def _label_counts(spark, sf):
    return view(spark, sf, "images").groupBy(L.normalize_label(F.col("label_raw")).alias("label")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "clean_whitespace",
    "F1",
    sql="SELECT doc_id, regexp_replace(trim(text, ' ' || chr(10)), '[ \n]+', ' ', 'g') AS text FROM documents",
)
def _whitespace(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.normalize_whitespace(F.col("text")).alias("text"))
