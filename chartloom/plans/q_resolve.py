"""Queries on lookups, reference resolution, reuse and fingerprints."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from chartloom.functions import labels as L
from chartloom.operators import fingerprint as FP
from chartloom.operators import resolve as R
from chartloom.plans.q_labels import STANDARD_SQL, label_sql
from chartloom.plans.registry import query
from chartloom.plans.views import oracle, table, view
from chartloom.session import cut_lineage
from chartloom.sources.files import number_rows
from chartloom.sources.tables import scratch_path


@query(
    "join_features",
    "J1",
    sql=oracle(
        "images",
        f"""WITH s AS (SELECT image_id, image_path, {label_sql('label_raw')} AS label FROM v_images),
f AS (SELECT image_path, label, avg(n) AS feature FROM (SELECT image_path, {label_sql('label_raw')} AS label, file_size AS n FROM v_images WHERE url LIKE 'https%') q GROUP BY 1, 2)
SELECT image_id, s.label, feature FROM s JOIN f ON s.image_path = f.image_path AND s.label = f.label""",
    ),
)
def _join(spark, sf):
    images = view(spark, sf, "images").withColumn("label", L.normalize_label(F.col("label_raw")))
    features = (
        images.filter(F.col("url").startswith("https")).groupBy("image_path", "label").agg(F.avg("file_size").alias("feature"))
    )
    return R.join_features(images.select("image_id", "image_path", "label"), features).select("image_id", "label", "feature")


@query(
    "attach_labels",
    "J2",
    sql=oracle(
        "images",
        f"""WITH k AS (SELECT image_name, lower(split_part(image_path, '/', 4)) AS split, {label_sql('label_raw')} AS label, dataset_name,
 row_number() OVER (PARTITION BY image_name ORDER BY image_id DESC) AS r FROM v_images WHERE url NOT LIKE '%/'),
j AS (SELECT i.image_id, i.image_name, k.split, k.label, k.dataset_name FROM v_images i LEFT JOIN k ON k.image_name = i.image_name AND r = 1),
g AS (SELECT image_id, coalesce(split, 'unspecified') AS split, coalesce(dataset_name, 'local_raw') AS dataset_name,
 coalesce(label, CASE WHEN image_name LIKE '%bar%' THEN 'bar_chart' WHEN image_name LIKE '%hist%' THEN 'histogram' WHEN image_name LIKE '%line%' THEN 'line_chart'
 WHEN image_name LIKE '%scatter%' THEN 'scatter_plot' WHEN image_name LIKE '%pie%' THEN 'pie_chart' ELSE 'unknown' END) AS l FROM j)
SELECT image_id, split, dataset_name, CASE WHEN l IN {STANDARD_SQL} THEN l ELSE 'unknown' END AS true_chart_type FROM g""",
    ),
)
def _attach(spark, sf):
    images = view(spark, sf, "images")
    splits = images.filter(~F.col("url").endswith("/")).select(
        "image_id", "image_name", F.lower(F.split("image_path", "/")[3]).alias("split"),
        L.normalize_label(F.col("label_raw")).alias("label"), "dataset_name",
    )
    return R.attach_labels(images.select("image_id", "image_name"), splits, "image_id").select(
        "image_id", "split", "dataset_name", "true_chart_type"
    )


def _resolved(spark, sf):
    images = view(spark, sf, "images")
    raw = images.filter(F.col("url").contains("?")).select(F.concat(F.lit("/raw/"), F.upper("image_name")).alias("path"))
    original = images.filter(F.col("url").contains("blog")).select(F.concat(F.lit("/orig/"), F.col("image_name")).alias("path"))
    rows = images.select(
        "image_id", F.when(F.col("file_size") % 2 == 0, F.col("image_name")).alias("image_name"), "image_path"
    )
    return R.resolve_references(rows, raw, original)


RESOLVE_SQL = """WITH raw AS (SELECT lower(image_name) AS k, min('/raw/' || upper(image_name)) AS p FROM v_images WHERE url LIKE '%?%' GROUP BY 1),
orig AS (SELECT lower(image_name) AS k, min('/orig/' || image_name) AS p FROM v_images WHERE url LIKE '%blog%' GROUP BY 1),
c AS (SELECT image_id, image_path, CASE WHEN file_size % 2 = 0 THEN lower(image_name) END AS k1, lower(split_part(image_path, '/', 5)) AS k2 FROM v_images),
j AS (SELECT c.*, r1.p AS p1, o1.p AS p2, r2.p AS p3, o2.p AS p4 FROM c LEFT JOIN raw r1 ON r1.k = k1 LEFT JOIN orig o1 ON o1.k = k1
 LEFT JOIN raw r2 ON r2.k = k2 LEFT JOIN orig o2 ON o2.k = k2),
res AS (SELECT image_id, coalesce(p1, p2, p3, p4, image_path) AS resolved_path,
 CASE WHEN p1 IS NOT NULL THEN 'raw' WHEN p2 IS NOT NULL THEN 'original' WHEN p3 IS NOT NULL THEN 'raw' WHEN p4 IS NOT NULL THEN 'original' ELSE 'missing' END AS tier FROM j)
"""


@query("resolve_references", "J3", sql=oracle("images", RESOLVE_SQL + "SELECT * FROM res"))
def _resolve(spark, sf):
    return _resolved(spark, sf).select("image_id", "resolved_path", "tier")


@query(
    "reference_coverage",
    "J5",
    sql=oracle(
        "images",
        RESOLVE_SQL
        + "SELECT t.tier, count(res.tier) AS rows FROM (SELECT unnest(['raw','original','missing']) AS tier) t LEFT JOIN res ON res.tier = t.tier GROUP BY 1",
    ),
)
def _coverage(spark, sf):
    return R.coverage(_resolved(spark, sf))


@query(
    "duplicate_names",
    "J4",
    sql="""WITH f AS (SELECT lower(regexp_extract(url, '([^/]*)/*$', 1)) AS name, url AS p FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY p) AS r FROM f)
SELECT name, count(*) AS n, string_agg(p, ', ' ORDER BY p) FILTER (r <= 3) AS paths FROM r GROUP BY 1 HAVING count(*) > 1""",
)
def _duplicates(spark, sf):
    return R.duplicate_names(table(spark, sf, "pages"), "url", keep=3)


@query(
    "join_payload",
    "J6",
    sql=oracle(
        "images",
        """WITH p AS (SELECT image_name, url, row_number() OVER (PARTITION BY image_name ORDER BY image_id DESC) AS r FROM v_images WHERE url LIKE 'https%')
SELECT i.image_id, coalesce(p.url, '{}') AS payload FROM v_images i LEFT JOIN p ON p.image_name = i.image_name AND r = 1""",
    ),
)
def _payload(spark, sf):
    images = view(spark, sf, "images")
    payload = images.filter(F.col("url").startswith("https")).select("image_id", "image_name", F.col("url").alias("payload"))
    joined = R.join_payload(images.select(F.col("image_id").alias("id"), "image_name"), payload, "image_id", ["payload"], {"payload": F.lit("{}")})
    return joined.select(F.col("id").alias("image_id"), "payload")


@query(
    "override_predictions",
    "J7",
    sql=oracle(
        "votes",
        """SELECT id, CASE WHEN cnn_confidence > 0.5 THEN cnn_prediction ELSE ml_prediction END AS ml_prediction,
 CASE WHEN cnn_confidence > 0.5 THEN cnn_confidence ELSE ml_confidence END AS ml_confidence FROM v_votes""",
    ),
)
def _override(spark, sf):
    votes = view(spark, sf, "votes")
    oof = votes.filter(F.col("cnn_confidence") > 0.5).select(
        "id", F.col("cnn_prediction").alias("ml_prediction"), F.col("cnn_confidence").alias("ml_confidence")
    )
    return R.override(votes.select("id", "ml_prediction", "ml_confidence"), oof, "id", ["ml_prediction", "ml_confidence"])


VARIANTS = ["ensemble", "ml_only", "cnn_only"]


@query(
    "variant_metrics",
    "J15",
    sql=oracle(
        "votes",
        """SELECT variant, count(*) AS rows, count(*) FILTER (p = truth) / count(*) AS accuracy FROM (
 SELECT 'ml_only' AS variant, truth, ml_prediction AS p FROM v_votes UNION ALL SELECT 'cnn_only', truth, cnn_prediction FROM v_votes
 UNION ALL SELECT 'ensemble', truth, CASE WHEN ml_confidence >= cnn_confidence THEN ml_prediction ELSE cnn_prediction END FROM v_votes) q
WHERE truth <> 'unknown' GROUP BY 1""",
    ),
)
def _variants(spark, sf):
    df = R.fan_out(view(spark, sf, "votes").filter(F.col("truth") != L.UNKNOWN), VARIANTS)
    best = F.when(F.col("ml_confidence") >= F.col("cnn_confidence"), F.col("ml_prediction")).otherwise(F.col("cnn_prediction"))
    pred = F.when(F.col("variant") == "ml_only", F.col("ml_prediction")).when(F.col("variant") == "cnn_only", F.col("cnn_prediction")).otherwise(best)
    return df.groupBy("variant").agg(F.count(F.lit(1)).alias("rows"), F.avg((pred == F.col("truth")).cast("double")).alias("accuracy"))


@query(
    "variant_callbacks",
    "E1",
    sql=oracle(
        "votes",
        """SELECT 'by_source' AS variant, source AS k, count(*) AS n FROM v_votes GROUP BY 2
UNION ALL SELECT 'by_prediction', ml_prediction, count(*) FROM v_votes GROUP BY 2""",
    ),
)
def _callbacks(spark, sf):
    votes = view(spark, sf, "votes")
    count = F.count(F.lit(1)).alias("n")
    return R.run_variants(
        votes,
        {
            "by_source": lambda d: d.groupBy(F.col("source").alias("k")).agg(count),
            "by_prediction": lambda d: d.groupBy(F.col("ml_prediction").alias("k")).agg(count),
        },
    )


def _keyed_pages(spark, sf):
    return table(spark, sf, "pages").select("page_id", "url", FP.content_key(F.col("html"), "v1").alias("content_key"))


@query("content_keys", "F13", sql="SELECT page_id, sha256(html || 'v1') AS content_key FROM pages")
def _keys(spark, sf):
    return _keyed_pages(spark, sf).select("page_id", "content_key")


@query(
    "cache_lookup",
    "J16",
    sql="""WITH k AS (SELECT page_id, url, sha256(html || 'v1') AS key FROM pages), c AS (SELECT DISTINCT key FROM k WHERE url LIKE 'https%')
SELECT page_id, CASE WHEN key IN (SELECT key FROM c) THEN 'hit' ELSE 'miss' END AS outcome FROM k""",
)
def _cache(spark, sf):
    pages = _keyed_pages(spark, sf)
    cache = pages.filter(F.col("url").startswith("https"))
    hit, miss = FP.split_by_cache(pages, cache, "content_key")
    return hit.select("page_id", F.lit("hit").alias("outcome")).unionByName(miss.select("page_id", F.lit("miss").alias("outcome")))


@query(
    "cache_statistics",
    "J16",
    sql="""WITH k AS (SELECT url, sha256(html || 'v1') AS key FROM pages), c AS (SELECT DISTINCT key FROM k WHERE url LIKE 'https%')
SELECT count(*) FILTER (key IN (SELECT key FROM c)) AS hits, count(*) FILTER (key NOT IN (SELECT key FROM c)) AS misses, (SELECT count(*) FROM c) AS entries FROM k""",
)
def _cache_stats(spark, sf):
    pages = _keyed_pages(spark, sf)
    return FP.cache_stats(pages, pages.filter(F.col("url").startswith("https")), "content_key")


def _page_lengths(df):
    return df.select("content_key", F.length("url").cast("bigint").alias("result"))


@query(
    "cache_runs",
    "J16",
    sql="""WITH k AS (SELECT url, sha256(html || 'v1') AS key FROM pages), h AS (SELECT DISTINCT key FROM k WHERE url LIKE 'https%'),
n AS (SELECT count(*) AS pages, count(DISTINCT key) AS keys, count(*) FILTER (key IN (SELECT key FROM h)) AS known, (SELECT count(*) FROM h) AS held FROM k)
SELECT 'empty' AS state, CAST(0 AS BIGINT) AS hits, pages AS misses, CAST(0 AS BIGINT) AS entries FROM n
UNION ALL SELECT 'first run', known, pages - known, held FROM n UNION ALL SELECT 'second run', pages, 0, keys FROM n
UNION ALL SELECT 'invalidated', 0, pages, 0 FROM n UNION ALL SELECT 'pinned to the first run', known, pages - known, held FROM n""",
)
def _cache_runs(spark, sf):
    pages = _keyed_pages(spark, sf)
    cache = FP.ResultCache(spark, scratch_path(spark, "cache"))
    states = [("empty", cache.stats(pages))]
    cache.compute_missing(pages.filter(F.col("url").startswith("https")), _page_lengths)
    first = cache.version()
    states.append(("first run", cache.stats(pages)))
    cache.compute_missing(pages, _page_lengths)
    states.append(("second run", cache.stats(pages)))
    cache.invalidate()
    states += [("invalidated", cache.stats(pages)), ("pinned to the first run", cache.stats(pages, first))]
    parts = [stats.select(F.lit(state).alias("state"), "hits", "misses", "entries") for state, stats in states]
    return functools.reduce(lambda a, b: a.unionByName(b), parts)


@query(
    "cached_results",
    "J16",
    sql="""WITH k AS (SELECT page_id, sha256(html || 'v1') AS key, length(html) AS n FROM pages)
SELECT page_id, key AS content_key, CAST(n AS BIGINT) AS result FROM k""",
)
def _cached_results(spark, sf):
    pages = table(spark, sf, "pages").select("page_id", "url", "html", FP.content_key(F.col("html"), "v1").alias("content_key"))
    cache = FP.ResultCache(spark, scratch_path(spark, "cache"))
    lengths = lambda df: df.select("content_key", F.length("html").cast("bigint").alias("result"))
    cache.compute_missing(pages.filter(F.col("url").startswith("https")), lengths)
    results = cache.compute_missing(pages, lengths).distinct()
    return pages.select("page_id", "content_key").join(results, "content_key").select("page_id", "content_key", "result")


@query(
    "reused_features",
    "J17",
    sql=oracle(
        "images",
        """SELECT call, built_by, image_name, CAST(file_size AS BIGINT) AS file_size FROM v_images, (VALUES ('first', 'first'), ('same rows', 'first'), ('other rows', 'third')) v(call, built_by)
WHERE call <> 'other rows' OR url NOT LIKE '%.html'""",
    ),
)
def _reused(spark, sf):
    images, path = view(spark, sf, "images"), scratch_path(spark, "features")
    cols = ["image_name", "file_size", "mtime"]
    out = None
    for call, builder, rows in (("first", "first", images), ("same rows", "second", images), ("other rows", "third", images.filter(~F.col("url").endswith(".html")))):
        made = FP.reuse_features(rows, cols, path, lambda d, b=builder: d.select("image_name", "file_size", F.lit(b).alias("built_by")))
        # the next call may store another table at this path
        kept = cut_lineage(made.select(F.lit(call).alias("call"), "built_by", "image_name", F.col("file_size").cast("bigint").alias("file_size")))
        out = kept if out is None else out.unionByName(kept)
    return out


def _tree_sql(group: str, source: str) -> str:
    g = f"{group}, " if group else ""
    by = f"GROUP BY {group}" if group else ""
    return f"""WITH a AS (SELECT {g}sha256(coalesce(length(image_name) || ':' || image_name, '-') || coalesce(length(CAST(file_size AS VARCHAR)) || ':' || file_size, '-') || coalesce(length(CAST(mtime AS VARCHAR)) || ':' || mtime, '-')) AS h, count(*) AS n FROM {source} GROUP BY ALL),
b AS (SELECT {g}substring(h, 1, 8) || '=' || sha256(string_agg(h || ':' || n, ',' ORDER BY h || ':' || n)) AS h, sum(n) AS n FROM a GROUP BY {g}substring(h, 1, 8)),
c AS (SELECT {g}substring(h, 1, 4) || '=' || sha256(string_agg(h, ',' ORDER BY h)) AS h, sum(n) AS n FROM b GROUP BY {g}substring(h, 1, 4))
SELECT {g}sha256(string_agg(h, ',' ORDER BY h)) AS fingerprint, CAST(sum(n) AS BIGINT) AS rows FROM c {by}"""


@query("dataset_fingerprint", "A14", sql=oracle("images", _tree_sql("", "v_images")))
def _fingerprint(spark, sf):
    return FP.dataset_fingerprint(view(spark, sf, "images"), ["image_name", "file_size", "mtime"])


@query(
    "stale_features",
    "J17",
    sql=oracle(
        "images",
        f"""WITH now AS ({_tree_sql('dataset_name', 'v_images')}), seen AS (SELECT * FROM v_images WHERE url NOT LIKE '%.html'), old AS ({_tree_sql('dataset_name', 'seen')})
SELECT now.dataset_name, coalesce(now.fingerprint = old.fingerprint, false) AS reusable FROM now LEFT JOIN old ON now.dataset_name = old.dataset_name""",
    ),
)
def _stale(spark, sf):
    images = view(spark, sf, "images")
    cols = ["image_name", "file_size", "mtime"]
    now = FP.dataset_fingerprint(images, cols, ["dataset_name"])
    old = FP.dataset_fingerprint(images.filter(~F.col("url").endswith(".html")), cols, ["dataset_name"])
    old = old.select("dataset_name", F.col("fingerprint").alias("_f"))
    return now.join(old, "dataset_name", "left").select(
        "dataset_name", F.coalesce(F.col("fingerprint") == F.col("_f"), F.lit(False)).alias("reusable")
    )


@query(
    "pending_work",
    "J17",
    sql="SELECT DISTINCT event_type AS name FROM events WHERE event_type NOT IN (SELECT event_type FROM events GROUP BY 1 HAVING max(value) > 400)",
)
def _pending(spark, sf):
    events = table(spark, sf, "events")
    names = events.select(F.col("event_type").alias("name")).distinct()
    done = events.groupBy(F.col("event_type").alias("name")).agg((F.max("value") > 400).alias("done"))
    return FP.pending(names, done, "name")


@query(
    "row_numbers",
    "W1",
    "S3",
    sql=oracle(
        "images",
        """SELECT image_id, dataset_name || '_' || lpad(CAST(row_number() OVER (PARTITION BY dataset_name ORDER BY image_path, image_id) - 1 AS VARCHAR), 7, '0') AS row_id FROM v_images""",
    ),
)
def _numbers(spark, sf):
    return number_rows(view(spark, sf, "images"), "dataset_name", ["image_path", "image_id"], "row_id").select("image_id", "row_id")
