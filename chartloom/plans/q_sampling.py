"""Queries on balancing, splitting and folding."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.functions import labels as L
from chartloom.operators import sampling as S
from chartloom.plans.q_labels import STANDARD_SQL, label_sql
from chartloom.plans.registry import query
from chartloom.plans.views import oracle, table, view


def hash_sql(key: str, seed: int = 42) -> str:
    return f"CAST('0x' || substring(md5({key} || '-{seed}'), 1, 8) AS BIGINT)"


RANKED_DOCS = f"""WITH h AS (SELECT *, {hash_sql('doc_id')} AS h FROM v_docs),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY h, doc_id) AS r,
 count(*) OVER (PARTITION BY lang) AS n, row_number() OVER (ORDER BY h, doc_id) AS g, count(*) OVER () AS total FROM h)
"""


def docs_sql(tail: str) -> str:
    return oracle("docs", RANKED_DOCS + tail)


@query(
    "balanced_subset",
    "X1",
    sql=docs_sql("SELECT doc_id, lang FROM r WHERE r <= (SELECT min(n) FROM r)"),
)
def _balanced(spark, sf):
    return S.balance_classes(view(spark, sf, "docs"), "lang", "doc_id").select("doc_id", "lang")


@query(
    "stratified_split",
    "X2",
    sql=f"""SELECT doc_id, lang, CASE WHEN r <= floor(n * CAST(0.7 AS DOUBLE)) THEN 'train'
 WHEN r <= floor(n * CAST(0.85 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split
FROM (SELECT doc_id, lang, count(*) OVER (PARTITION BY lang) AS n,
 row_number() OVER (PARTITION BY lang ORDER BY {hash_sql('doc_id')}, doc_id) AS r FROM documents) q""",
)
def _strat(spark, sf):
    return S.stratified_split(table(spark, sf, "documents").select("doc_id", "lang"), "lang", "doc_id")


@query(
    "shuffle_split",
    "X3",
    sql=docs_sql(
        """SELECT doc_id, CASE WHEN g <= floor(total * CAST(0.7 AS DOUBLE)) THEN 'train'
 WHEN g <= floor(total * CAST(0.7 AS DOUBLE)) + floor(total * CAST(0.15 AS DOUBLE)) THEN 'val' ELSE 'test' END AS split FROM r"""
    ),
)
def _shuffle(spark, sf):
    return S.shuffle_split(view(spark, sf, "docs").select("doc_id"), "doc_id")


@query(
    "cap_per_class",
    "X4",
    sql=docs_sql("SELECT doc_id, lang FROM r WHERE (SELECT count(*) FROM r) <= 200 OR r <= greatest(1, 200 // (SELECT count(DISTINCT lang) FROM r))"),
)
def _cap(spark, sf):
    return S.cap_per_class(view(spark, sf, "docs"), "lang", "doc_id", 200).select("doc_id", "lang")


@query("random_rows", "X5", sql=docs_sql("SELECT doc_id, lang FROM r WHERE g <= 25"))
def _rows(spark, sf):
    return S.sample_rows(view(spark, sf, "docs"), "doc_id", 25).select("doc_id", "lang")


@query(
    "prefix_split",
    "X6",
    sql=oracle(
        "images",
        """SELECT image_id, CASE WHEN row_number() OVER (ORDER BY image_path, image_id) <= floor(count(*) OVER () * CAST(0.8 AS DOUBLE))
 THEN 'train' ELSE 'val' END AS split FROM v_images""",
    ),
)
def _prefix(spark, sf):
    return S.prefix_split(view(spark, sf, "images"), ["image_path", "image_id"]).select("image_id", "split")


@query(
    "stratified_folds",
    "X7",
    sql=f"""SELECT vec_id, CAST((r - 1) % 5 AS INT) AS fold, r <= floor(n * CAST(0.8 AS DOUBLE)) AS is_train FROM (
 SELECT vec_id, count(*) OVER (PARTITION BY label) AS n,
 row_number() OVER (PARTITION BY label ORDER BY {hash_sql('vec_id')}, vec_id) AS r FROM embeddings) q""",
)
def _folds(spark, sf):
    df = table(spark, sf, "embeddings").select("vec_id", "label")
    folds = S.stratified_folds(df, "label", "vec_id")
    return S.stratified_holdout(folds, "label", "vec_id").select("vec_id", "fold", "is_train")


@query(
    "first_per_class",
    "W9",
    sql=oracle(
        "images",
        f"""SELECT image_id, label FROM (SELECT image_id, label,
 row_number() OVER (PARTITION BY label ORDER BY image_name, image_id) AS r FROM (
 SELECT *, {label_sql('label_raw')} AS label FROM v_images) a) b WHERE r <= 7""",
    ),
)
def _first(spark, sf):
    df = view(spark, sf, "images").withColumn("label", L.normalize_label(F.col("label_raw")))
    return S.first_per_class(df, "label", ["image_name", "image_id"], 7).select("image_id", "label")


@query(
    "evenly_spaced_rows",
    "W11",
    sql=oracle(
        "images",
        """WITH n AS (SELECT image_id, row_number() OVER (ORDER BY image_path, image_id) - 1 AS i, count(*) OVER () AS n FROM v_images)
SELECT image_id FROM n WHERE n <= 23 OR i IN (
 SELECT CAST(floor(j.range * ((SELECT max(n) - 1 FROM n) / CAST(22 AS DOUBLE))) AS BIGINT) FROM range(23) j)
 OR i = n - 1""",
    ),
)
def _even(spark, sf):
    return S.evenly_spaced(view(spark, sf, "images"), ["image_path", "image_id"], 23).select("image_id")


@query(
    "capped_prefix",
    "T5",
    sql="""SELECT o_orderkey FROM (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderkey) AS r, count(*) OVER () AS n FROM orders) q
WHERE r <= least(n, greatest(200, least(1000, ceil(n * CAST(0.2 AS DOUBLE)))))""",
)
def _capped(spark, sf):
    return S.capped_prefix(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], least=200, most=1000, share=0.2)


@query(
    "class_deficit",
    "A39",
    sql=oracle(
        "images",
        f"""WITH c AS (SELECT {label_sql('label_raw')} AS label, count(*) AS n FROM v_images GROUP BY 1),
d AS (SELECT w.label, coalesce(n, 0) AS have, greatest(0, 300 - coalesce(n, 0)) AS need
 FROM (SELECT unnest(['bar_chart','histogram','line_chart','scatter_plot','pie_chart']) AS label) w LEFT JOIN c ON c.label = w.label)
SELECT label, have, CAST(need AS BIGINT) AS need,
 CAST(greatest(1, floor((SELECT count(*) FROM v_images) * need / greatest(1, (SELECT sum(need) FROM d)))) AS BIGINT) AS share FROM d""",
    ),
)
def _deficit(spark, sf):
    df = view(spark, sf, "images").select(L.normalize_label(F.col("label_raw")).alias("label"))
    need = S.class_deficit(df, "label", L.STANDARD_LABELS, 300)
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    whole = need.agg(F.sum("need").alias("n")).scalar()
    share = F.greatest(F.lit(1), F.floor(total * F.col("need") / F.greatest(F.lit(1), whole)))
    return need.withColumn("share", share.cast("bigint"))


_ALLOCATED = """c AS (SELECT t, lang, n, rank() OVER (PARTITION BY t ORDER BY n DESC, lang) AS place, greatest(1, floor(t * n / sum(n) OVER (PARTITION BY t))) AS f
 FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1) a, (VALUES (5), (1000)) v(t)),
r AS (SELECT *, t - sum(f) OVER (PARTITION BY t) AS rest FROM c),
g AS (SELECT *, min(CASE WHEN rest > 0 OR f > -rest THEN place END) OVER (PARTITION BY t) AS chosen FROM r)"""


@query(
    "proportional_allocation",
    "A39",
    sql=f"WITH {_ALLOCATED} SELECT CAST(t AS INT) AS total, lang, n, CAST(f + CASE WHEN place = chosen THEN rest ELSE 0 END AS BIGINT) AS count FROM g",
)
def _allocation(spark, sf):
    # five leaves an excess over the minimum of 1 for each language, a thousand a shortfall from rounding
    targets = table(spark, sf, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n")).withColumn("order", -F.col("n"))
    parts = [S.allocate(targets, "lang", "n", total, "order").select(F.lit(total).alias("total"), "lang", "n", "count") for total in (5, 1000)]
    return parts[0].unionByName(parts[1])


@query(
    "next_free_index",
    "A38",
    sql=oracle(
        "images",
        """SELECT class, max(n) + 1 AS next_index FROM (
 SELECT regexp_extract(f, '^synthetic_(.*)_([0-9]+)\\.png$', 1) AS class,
 TRY_CAST(regexp_extract(f, '^synthetic_(.*)_([0-9]+)\\.png$', 2) AS BIGINT) AS n
 FROM (SELECT 'synthetic_' || substring(image_name, strpos(image_name, '_') + 1) AS f FROM v_images) a) b
WHERE n IS NOT NULL GROUP BY class""",
    ),
)
def _next(spark, sf):
    names = view(spark, sf, "images").select(
        F.concat(F.lit("synthetic_"), F.regexp_replace("image_name", "^[^_]*_", "")).alias("f")
    )
    return S.next_index(names, "f")


@query(
    "manifest_build",
    "X8",
    "A20",
    sql=oracle(
        "images",
        f"""WITH k AS (SELECT *, {label_sql('label_raw')} AS label FROM v_images),
b AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {hash_sql('image_id')}, image_id) AS r,
 count(*) OVER (PARTITION BY label) AS n FROM k WHERE label IN {STANDARD_SQL}),
s AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {hash_sql('image_id')}, image_id) AS q,
 count(*) OVER (PARTITION BY label) AS m FROM b WHERE r <= (SELECT min(n) FROM b)),
t AS (SELECT *, CASE WHEN q <= floor(m * CAST(0.7 AS DOUBLE)) THEN 'train' WHEN q <= floor(m * CAST(0.85 AS DOUBLE)) THEN 'validation' ELSE 'test' END AS split FROM s)
SELECT (SELECT count(*) FROM k) AS total_discovered, (SELECT count(*) FROM k WHERE label = 'unknown') AS removed_unknown,
 count(*) AS known_balanced, count(*) FILTER (split = 'train') AS train, count(*) FILTER (split = 'validation') AS validation,
 count(*) FILTER (split = 'test') AS test, count(DISTINCT label) AS classes,
 string_agg(DISTINCT dataset_name, ',' ORDER BY dataset_name) AS datasets_present FROM t""",
    ),
)
def _manifest(spark, sf):
    from chartloom.operators.manifest import build_manifest

    return build_manifest(view(spark, sf, "images")).summary
