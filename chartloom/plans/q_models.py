"""Queries that train and score models on the embedding features."""

from __future__ import annotations

from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from chartloom.operators import boosting
from chartloom.operators import models as ML
from chartloom.operators import sampling as S
from chartloom.operators.kernels import fourier_column
from chartloom.plans.q_quality import wide_features
from chartloom.plans.registry import query
from chartloom.plans.views import oracle, table, view
from chartloom.sources.tables import scratch_path

COLUMNS = [f"feature_{i:02d}" for i in range(64)]
# the library defaults are the study's
STUDY = {"logistic_regression": {}, "random_forest": {}, "rbf_svm": {}, "boosted_trees": {}}


def _data(spark, sf):
    return wide_features(spark, sf).withColumn("label", F.concat(F.lit("class_"), F.col("label").cast("string")))


def _split(spark, sf):
    df = S.stratified_split(_data(spark, sf), "label", "vec_id")
    return df.filter("split = 'train'"), df.filter("split = 'validation'"), df.filter("split = 'test'")


def _predict(spark, sf, name, **extra):
    train, _, test = _split(spark, sf)
    trained = ML.fit(train, "label", COLUMNS, name, **STUDY[name], **extra)
    return trained.predict(test).select("vec_id", "label", "prediction", "confidence")


@query("label_encoding", "M1", sql="SELECT vec_id, CAST(dense_rank() OVER (ORDER BY label) - 1 AS DOUBLE) AS label_index FROM embeddings")
def _encode(spark, sf):
    df = _data(spark, sf)
    return ML.encode_labels(df, "label").transform(df).select("vec_id", "label_index")


@query(
    "standardised_features",
    "M2",
    sql="SELECT vec_id, " + ", ".join(
        f"round((CAST(embedding[{i + 1}] AS DOUBLE) - avg(CAST(embedding[{i + 1}] AS DOUBLE)) OVER ()) / stddev_samp(CAST(embedding[{i + 1}] AS DOUBLE)) OVER (), 6) AS f{i:02d}" for i in range(64)
    ) + " FROM embeddings",
)
def _standardised(spark, sf):
    data = ML.assemble(_data(spark, sf), COLUMNS)
    model = StandardScaler(inputCol="features", outputCol="scaled", withMean=True).fit(data)
    out = model.transform(data).select("vec_id", vector_to_array("scaled").alias("s"))
    return out.select("vec_id", *[F.round(F.col("s")[i], 6).alias(f"f{i:02d}") for i in range(64)])


@query(
    "class_weights",
    "M3",
    sql="SELECT vec_id, count(*) OVER () / ((SELECT count(DISTINCT label) FROM embeddings) * count(*) OVER (PARTITION BY label)) AS weight FROM embeddings",
)
def _weights(spark, sf):
    return ML.balanced_weights(_data(spark, sf), "label").select("vec_id", "weight")


@query("logistic_predictions", "M4", "M14")
def _logistic(spark, sf):
    return _predict(spark, sf, "logistic_regression", weighted=True)


@query("forest_predictions", "M5", "M14")
def _forest(spark, sf):
    return _predict(spark, sf, "random_forest", weighted=True)


@query("svm_predictions", "M6")
def _svm(spark, sf):
    return _predict(spark, sf, "rbf_svm", weighted=True)


@query(
    "fourier_features",
    "M6",
    sql="""WITH d AS (SELECT j.range AS j, i.range AS i, md5(j.range || '-' || i.range || '-42') AS d FROM range(512) j, range(64) i),
u AS (SELECT j, i, (CAST(CAST('0x' || substring(d, 1, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296 AS u, (CAST(CAST('0x' || substring(d, 9, 8) AS BIGINT) AS DOUBLE) + 0.5) / 4294967296 AS v FROM d),
w AS (SELECT j, list(sqrt(CAST(2 AS DOUBLE) / 64) * sqrt(-2 * ln(u)) * cos(2 * pi() * v) ORDER BY i) AS w FROM u GROUP BY 1),
z AS (SELECT vec_id, j, list_inner_product(list_transform(embedding, lambda x: CAST(x AS DOUBLE)), w) AS z FROM embeddings, w)
SELECT vec_id, j, round(cos(z) / sqrt(512), 6) AS cosine, round(sin(z) / sqrt(512), 6) AS sine FROM z""",
)
def _fourier(spark, sf):
    x = F.transform("embedding", lambda v: v.cast("double"))
    data = table(spark, sf, "embeddings").select("vec_id", fourier_column(x, 64, 512, 1 / 64, 42).alias("z"))
    pairs = F.posexplode(F.arrays_zip(F.slice("z", 1, 512).alias("c"), F.slice("z", 513, 512).alias("s"))).alias("j", "p")
    return data.select("vec_id", pairs).select("vec_id", F.col("j").cast("bigint").alias("j"), F.round("p.c", 6).alias("cosine"), F.round("p.s", 6).alias("sine"))


@query("boosted_predictions", "M7")
def _boosted(spark, sf):
    return _predict(spark, sf, "boosted_trees")


@query(
    "boosting_residuals",
    "M7",
    sql="""WITH s AS (SELECT label AS k, count(*) / sum(count(*)) OVER () AS p FROM embeddings GROUP BY 1)
SELECT vec_id, 'class_' || k AS class, round(CAST(label = k AS INT) - p, 9) AS residual, round(p * (1 - p), 9) AS second FROM embeddings, s""",
)
def _residuals(spark, sf):
    out = boosting.first_residuals(_data(spark, sf).select("vec_id", "label"), "vec_id", "label")
    return out.select("vec_id", "class", F.round("residual", 9).alias("residual"), F.round("second", 9).alias("second"))


@query(
    "boosting_first_splits",
    "M7",
    sql="""WITH s AS (SELECT label AS k, count(*) / sum(count(*)) OVER () AS p FROM embeddings GROUP BY 1),
u AS (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) - 1 AS f FROM embeddings),
e AS (SELECT f, min(x) AS lo, max(x) AS hi FROM u GROUP BY 1),
b AS (SELECT f, label, len(list_filter(range(1, 32), lambda j: lo + (hi - lo) * j / 32 < x)) AS b FROM u JOIN e USING (f)),
c AS (SELECT f, b, label AS k, count(*) AS n FROM b GROUP BY 1, 2, 3), t AS (SELECT f, b, count(*) AS n FROM b GROUP BY 1, 2),
g AS (SELECT s.k, p, f.range AS f, b.range AS b, coalesce(c.n, 0) - p * coalesce(t.n, 0) AS r, p * (1 - p) * coalesce(t.n, 0) AS h FROM s CROSS JOIN range(64) f CROSS JOIN range(32) b
 LEFT JOIN c ON c.f = f.range AND c.b = b.range AND c.k = s.k LEFT JOIN t ON t.f = f.range AND t.b = b.range),
w AS (SELECT k, f, b, sum(r) OVER l AS lr, sum(h) OVER l AS lh, sum(r) OVER a AS tr, sum(h) OVER a AS th FROM g WINDOW l AS (PARTITION BY k, f ORDER BY b), a AS (PARTITION BY k, f)),
q AS (SELECT *, tr - lr AS rr, th - lh AS rh, coalesce(round(lr * lr / nullif(lh, 0) + (tr - lr) * (tr - lr) / nullif(th - lh, 0) - tr * tr / th, 9), 0) AS gain FROM w WHERE b < 31)
SELECT 'class_' || k AS class, 'feature_' || lpad(CAST(f AS VARCHAR), 2, '0') AS feature, CAST(b AS INT) AS bin, round(gain, 6) AS gain, round(lr, 6) AS left_residual, round(lh, 6) AS left_second,
 round(rr, 6) AS right_residual, round(rh, 6) AS right_second, round(0.9 * lr / lh, 6) AS left_value, round(0.9 * rr / rh, 6) AS right_value
FROM q QUALIFY row_number() OVER (PARTITION BY k ORDER BY gain DESC, f, b) = 1""",
)
def _first_splits(spark, sf):
    df = _data(spark, sf)
    out = boosting.first_splits(df, "label", COLUMNS, boosting.even_edges(df, COLUMNS))
    return out.select("class", "feature", "bin", *[F.round(c, 6).alias(c) for c in out.columns[3:]])


@query("grid_search", "M8")
def _grid(spark, sf):
    df = S.stratified_folds(_data(spark, sf), "label", "vec_id", k=5)
    return ML.grid_search(df, "label", COLUMNS, "random_forest", {"numTrees": [50, 100], "maxDepth": [5, 10]})


# one setting of each family; README names the study's grids and what they cost
CANDIDATES = [
    ("logistic_regression", {"maxIter": 200}), ("random_forest", {"numTrees": 100}), ("rbf_svm", {"frequencies": 64, "folds": 2, "iterations": 20}), ("boosted_trees", {"rounds": 50}),
]


@query("tuned_scores", "M8", "M11")
def _tuned(spark, sf):
    df = S.stratified_folds(_data(spark, sf), "label", "vec_id", k=5)
    return ML.tune(df, "label", "vec_id", COLUMNS, CANDIDATES, scratch_path(spark, "tuned")).complete().scores


@query(
    "fold_scores",
    "M8",
    "M11",
    sql=oracle(
        "pred",
        """SELECT p.source, p.fold, n, round(acc, 9) AS accuracy, round(avg(CASE WHEN s + g > 0 THEN 2 * h / (s + g) ELSE 0 END), 9) AS macro_f1,
 round(sum(s * CASE WHEN s + g > 0 THEN 2 * h / (s + g) ELSE 0 END) / sum(s), 9) AS weighted_f1
FROM (SELECT source, id % 5 AS fold, count(*) AS n, avg(CAST(truth = pred AS INT)) AS acc FROM v_pred GROUP BY 1, 2) p
JOIN (SELECT source, fold, c, sum(s) AS s, sum(g) AS g, sum(h) AS h FROM (
  SELECT source, id % 5 AS fold, truth AS c, 1 AS s, 0 AS g, CAST(truth = pred AS INT) AS h FROM v_pred
  UNION ALL SELECT source, id % 5, pred, 0, 1, 0 FROM v_pred) a GROUP BY 1, 2, 3) q ON p.source = q.source AND p.fold = q.fold
GROUP BY 1, 2, 3, 4""",
    ),
)
def _fold_scores(spark, sf):
    stored = view(spark, sf, "pred").select("source", (F.col("id") % 5).alias("fold"), "truth", F.col("pred").alias("prediction"))
    return ML.fold_scores(stored, ["source"], "truth").select("source", "fold", "n", *[F.round(c, 9).alias(c) for c in ("accuracy", "macro_f1", "weighted_f1")])


@query("out_of_fold_predictions", "M9")
def _oof(spark, sf):
    df = S.stratified_folds(_data(spark, sf), "label", "vec_id", k=5)
    out = ML.out_of_fold(df, "label", COLUMNS, "logistic_regression")
    return out.select("vec_id", "label", "prediction", "confidence")


@query("model_selection", "M10", "M11")
def _selection(spark, sf):
    train, val, _ = _split(spark, sf)
    return ML.compare(train, val, "label", COLUMNS, STUDY).scores


@query("feature_importances", "M12", "T4")
def _importances(spark, sf):
    train, _, _ = _split(spark, sf)
    trained = ML.fit(train, "label", COLUMNS, "random_forest")
    return ML.top_features(ML.importances(trained), 20)


@query("permutation_importance", "M13")
def _permutation(spark, sf):
    train, _, test = _split(spark, sf)
    trained = ML.fit(train, "label", COLUMNS, "logistic_regression")
    return ML.permutation_importance(trained, test, "label", "vec_id", repeats=4)


@query("saved_model_scores", "M15")
def _saved(spark, sf):
    train, _, test = _split(spark, sf)
    path = scratch_path(spark, "model")
    ML.fit(train, "label", COLUMNS, "logistic_regression").save(path)
    return ML.Trained.load(path).predict(test).select("vec_id", "prediction", "confidence")


@query("feature_group_ablation", "M16")
def _ablation(spark, sf):
    train, _, test = _split(spark, sf)
    groups = {"geometric": COLUMNS[:32], "ocr": COLUMNS[32:48], "histogram": COLUMNS[48:], "all": COLUMNS}
    return ML.group_ablation(train, test, "label", groups, "logistic_regression")


@query(
    "row_attribution",
    "T6",
    sql="""WITH r AS (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1),
u AS (SELECT unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS i FROM r)
SELECT 'feature_' || lpad(CAST(i AS VARCHAR), 2, '0') AS feature, abs(CAST(v AS DOUBLE)) AS value FROM u ORDER BY value DESC, feature LIMIT 10""",
)
def _attribution(spark, sf):
    df = _data(spark, sf)
    first = df.agg(F.min("vec_id")).scalar()
    return ML.row_attribution(df, F.col("vec_id") == first, COLUMNS, 10)
