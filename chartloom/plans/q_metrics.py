"""Queries on predictions: confusion, reports, curves, error analysis, timing summaries, tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.functions import text as T
from chartloom.functions.labels import STANDARD_LABELS
from chartloom.operators import metrics as M
from chartloom.operators import stats as ST
from chartloom.plans.q_labels import label_sql
from chartloom.plans.registry import query
from chartloom.plans.views import oracle, table, view

CLASSES_SQL = """WITH e AS (SELECT truth, pred FROM v_pred WHERE truth <> 'unknown'),
t AS (SELECT truth AS label, count(*) AS support, count(*) FILTER (truth = pred) AS tp FROM e GROUP BY 1),
p AS (SELECT pred AS label, count(*) AS predicted FROM e GROUP BY 1),
c AS (SELECT coalesce(t.label, p.label) AS label, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted,
 coalesce(tp, 0) AS tp FROM t FULL JOIN p ON t.label = p.label),
m AS (SELECT label, support, tp, CASE WHEN predicted = 0 THEN 0 ELSE tp / predicted END AS precision,
 CASE WHEN support = 0 THEN 0 ELSE tp / support END AS recall,
 CASE WHEN predicted + support = 0 THEN 0 ELSE 2 * tp / (predicted + support) END AS f1 FROM c)
"""


def _eval(spark, sf):
    return M.labelled(view(spark, sf, "pred"))


def _round(df, digits=9, skip=()):
    return df.select(
        *[F.round(F.col(c), digits).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes]
    )


@query(
    "confusion_matrix",
    "A9",
    sql=oracle(
        "pred",
        """WITH e AS (SELECT truth, pred FROM v_pred WHERE truth <> 'unknown'),
d AS (SELECT truth AS c FROM e UNION SELECT pred FROM e)
SELECT a.c AS truth, b.c AS pred, (SELECT count(*) FROM e WHERE e.truth = a.c AND e.pred = b.c) AS n FROM d a, d b""",
    ),
)
def _confusion(spark, sf):
    return M.confusion_matrix(_eval(spark, sf))


@query(
    "weighted_metrics",
    "A10",
    sql=oracle(
        "pred",
        CLASSES_SQL
        + """SELECT round(sum(tp) / sum(support), 9) AS accuracy, round(sum(precision * support) / sum(support), 9) AS precision,
 round(sum(recall * support) / sum(support), 9) AS recall, round(sum(f1 * support) / sum(support), 9) AS f1 FROM m""",
    ),
)
def _weighted(spark, sf):
    return _round(
        M.classification_metrics(_eval(spark, sf)).select(
            "accuracy", *[F.col(f"weighted_{m}").alias(m) for m in ("precision", "recall", "f1")]
        )
    )


@query(
    "macro_metrics",
    "A11",
    sql=oracle(
        "pred",
        CLASSES_SQL
        + """SELECT round(avg(precision), 9) AS macro_precision, round(avg(recall), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1,
 round(sum(f1 * support) / sum(support), 9) AS weighted_f1 FROM m""",
    ),
)
def _macro(spark, sf):
    return _round(
        M.classification_metrics(_eval(spark, sf)).select("macro_precision", "macro_recall", "macro_f1", "weighted_f1")
    )


@query(
    "classification_report",
    "A12",
    sql=oracle(
        "pred",
        CLASSES_SQL
        + """, r AS (SELECT label, precision, recall, f1, support FROM m
UNION ALL SELECT 'accuracy', a, a, a, s FROM (SELECT sum(tp) / sum(support) AS a, sum(support) AS s FROM m) q
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM m
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM m)
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM r""",
    ),
)
def _report(spark, sf):
    return _round(M.classification_report(_eval(spark, sf)))


@query(
    "per_class_accuracy",
    "A13",
    sql=oracle("pred", CLASSES_SQL + "SELECT label, tp / greatest(1, support) AS accuracy FROM m"),
)
def _per_class(spark, sf):
    return M.per_class_accuracy(_eval(spark, sf))


@query(
    "histogram_bar_confusion",
    "A15",
    sql=oracle(
        "pred",
        """SELECT count(*) FILTER (t AND p2) + count(*) FILTER (t2 AND p) AS confusions, count(*) FILTER (t2 AND p2) AS other_other,
 count(*) FILTER (t2 AND p) AS other_one, count(*) FILTER (t AND p2) AS one_other, count(*) FILTER (t AND p) AS one_one,
 count(*) FILTER (t AND p) / count(*) FILTER (p) AS precision, count(*) FILTER (t AND p) / count(*) FILTER (t) AS recall,
 2 * count(*) FILTER (t AND p) / (count(*) FILTER (p) + count(*) FILTER (t)) AS f1
FROM (SELECT truth = 'histogram' AS t, truth = 'bar_chart' AS t2, pred = 'histogram' AS p, pred = 'bar_chart' AS p2 FROM v_pred WHERE truth <> 'unknown') q""",
    ),
)
def _pair(spark, sf):
    return M.pair_report(_eval(spark, sf))


@query(
    "subset_accuracy",
    "A44",
    sql=oracle(
        "pred",
        "SELECT count(*) FILTER (truth = pred) / count(*) AS accuracy, count(*) AS rows FROM v_pred WHERE truth IN ('histogram','bar_chart')",
    ),
)
def _subset(spark, sf):
    return M.subset_accuracy(_eval(spark, sf), ["histogram", "bar_chart"])


@query(
    "grouped_accuracy",
    "A7",
    sql=oracle(
        "pred",
        """SELECT 'truth' AS kind, truth AS k, count(*) FILTER (truth = pred) / count(*) AS accuracy FROM v_pred GROUP BY 2
UNION ALL SELECT 'source', source, count(*) FILTER (truth = pred) / count(*) FROM v_pred GROUP BY 2""",
    ),
)
def _grouped(spark, sf):
    df = view(spark, sf, "pred")
    ok = F.col("truth") == F.col("pred")
    parts = [
        M.grouped_accuracy(df, key, ok).select(F.lit(key).alias("kind"), F.col(key).alias("k"), "accuracy")
        for key in ("truth", "source")
    ]
    return parts[0].unionByName(parts[1])


@query(
    "error_pairs",
    "A2",
    "T3",
    sql=oracle(
        "pred",
        """SELECT truth, pred, count(*) AS n FROM v_pred WHERE truth <> 'unknown' AND truth <> pred GROUP BY 1, 2 ORDER BY n DESC, truth, pred LIMIT 12""",
    ),
)
def _pairs(spark, sf):
    return M.error_pairs(view(spark, sf, "pred"), k=12)


@query(
    "split_label_counts",
    "A2",
    sql=oracle(
        "images",
        f"""SELECT lower(split_part(image_path, '/', 4)) AS split, {label_sql('label_raw')} AS label, count(*) AS n FROM v_images GROUP BY 1, 2""",
    ),
)
def _split_counts(spark, sf):
    from chartloom.operators.manifest import label_images, split_distribution

    images = label_images(view(spark, sf, "images"))
    return split_distribution(images.withColumn("split", F.lower(F.split("image_path", "/")[3])))


@query(
    "error_summary",
    "A22",
    sql=oracle(
        "pred",
        """WITH e AS (SELECT * FROM v_pred WHERE truth <> 'unknown'),
p AS (SELECT truth, pred, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, truth, pred) AS r FROM e WHERE truth <> pred GROUP BY 1, 2)
SELECT (SELECT count(*) FROM e) AS num_labeled, (SELECT count(*) FROM e WHERE truth <> pred) AS num_errors,
 1 - (SELECT count(*) FROM e WHERE truth <> pred) / (SELECT count(*) FROM e) AS accuracy,
 (SELECT string_agg(truth || ':' || pred || ':' || n, ';' ORDER BY r) FROM p WHERE r <= 12) AS common_errors""",
    ),
)
def _summary(spark, sf):
    df = M.error_summary(view(spark, sf, "pred"), k=12)
    return df.withColumn("num_errors", F.col("num_errors").cast("bigint")).withColumn("num_labeled", F.col("num_labeled").cast("bigint"))


@query(
    "source_benchmarks",
    "A21",
    sql=oracle(
        "pred",
        """WITH s AS (SELECT 'low' AS benchmark, * FROM v_pred WHERE price < 200000 UNION ALL SELECT 'mid', * FROM v_pred WHERE price BETWEEN 100000 AND 300000
 UNION ALL SELECT 'final', * FROM v_pred WHERE source = 'F'),
e AS (SELECT * FROM s WHERE truth <> 'unknown'),
t AS (SELECT benchmark, truth AS label, count(*) AS support, count(*) FILTER (truth = pred) AS tp FROM e GROUP BY 1, 2),
p AS (SELECT benchmark, pred AS label, count(*) AS predicted FROM e GROUP BY 1, 2),
m AS (SELECT coalesce(t.benchmark, p.benchmark) AS benchmark, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp,
 CASE WHEN coalesce(predicted, 0) = 0 THEN 0 ELSE coalesce(tp, 0) / predicted END AS precision,
 CASE WHEN coalesce(support, 0) = 0 THEN 0 ELSE tp / support END AS recall,
 2 * coalesce(tp, 0) / (coalesce(predicted, 0) + coalesce(support, 0)) AS f1
 FROM t FULL JOIN p ON t.benchmark = p.benchmark AND t.label = p.label),
a AS (SELECT benchmark, sum(tp) / sum(support) AS accuracy, sum(precision * support) / sum(support) AS precision,
 sum(recall * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1 FROM m GROUP BY 1),
n AS (SELECT benchmark, count(*) AS num_samples, count(*) FILTER (truth <> 'unknown') AS num_labeled,
 count(*) FILTER (truth <> 'unknown' AND confidence > 0.5) / count(*) FILTER (truth <> 'unknown') AS value_accuracy FROM s GROUP BY 1)
SELECT n.benchmark, num_samples, num_labeled, round(accuracy, 9) AS accuracy, round(precision, 9) AS precision, round(recall, 9) AS recall,
 round(f1, 9) AS f1, round(value_accuracy, 9) AS value_accuracy FROM n LEFT JOIN a ON a.benchmark = n.benchmark
UNION ALL SELECT 'none', 0, 0, NULL, NULL, NULL, NULL, 0.0""",
    ),
)
def _benchmarks(spark, sf):
    df = view(spark, sf, "pred")
    sources = {
        "low": F.col("price") < 200000,
        "mid": F.col("price").between(100000, 300000),
        "final": F.col("source") == "F",
        "none": F.col("source") == "missing",
    }
    return _round(M.source_benchmarks(df, sources, F.col("confidence") > 0.5))


@query(
    "numeric_summary",
    "A3",
    sql=oracle(
        "runs",
        """SELECT round(avg(seconds), 4) AS mean, round(quantile_cont(seconds, 0.5), 4) AS median, round(stddev_samp(seconds), 4) AS std,
 round(min(seconds), 4) AS min, round(max(seconds), 4) AS max, round(sum(seconds), 2) AS total FROM v_runs""",
    ),
)
def _numeric(spark, sf):
    df = M.numeric_summary(view(spark, sf, "runs"), "seconds")
    return df.select(*[F.round(c, 2 if c == "total" else 4).alias(c) for c in df.columns])


STAGES = ["click", "error", "purchase", "signup", "view"]


def _wide_runs(spark, sf):
    runs = view(spark, sf, "runs")
    wide = [F.when(F.col("stage") == s, F.col("seconds").cast("string")).otherwise("n/a").alias(s) for s in STAGES[:4]]
    return runs.select(*wide, (F.col("seconds") * F.lit(1.01)).alias("total"))


@query(
    "stage_means",
    "A4",
    sql=oracle(
        "runs",
        "SELECT "
        + ", ".join(f"round(avg(CASE WHEN stage = '{s}' THEN seconds ELSE 0 END), 6) AS \"{s}\"" for s in STAGES[:4])
        + ", CAST(0 AS DOUBLE) AS missing FROM v_runs",
    ),
)
def _stage_means(spark, sf):
    return _round(M.column_means(_wide_runs(spark, sf), [*STAGES[:4], "missing"]), 6)


@query(
    "runtime_check",
    "A5",
    sql=oracle(
        "runs",
        """SELECT round(c, 6) AS component_sum, round(t, 6) AS total, t >= c * 0.7 AND (c <= 0 OR t <= c * 1.35) AS runtime_realistic
FROM (SELECT sum(CASE WHEN stage <> 'view' THEN seconds ELSE 0 END) / count(*) AS c, avg(seconds * 1.01) AS t FROM v_runs) q""",
    ),
)
def _runtime(spark, sf):
    means = M.column_means(_wide_runs(spark, sf), [*STAGES[:4], "total"])
    return _round(M.runtime_check(means, STAGES[:4], "total").select("component_sum", "total", "runtime_realistic"), 6)


@query(
    "success_rates",
    "A8",
    sql=oracle(
        "runs",
        """SELECT stage, round(avg(CASE WHEN seconds > 1 THEN 1 ELSE 0 END) * 100, 6) AS rate FROM v_runs GROUP BY 1
UNION ALL SELECT NULL, round(avg(CASE WHEN seconds > 1 THEN 1 ELSE 0 END) * 100, 6) FROM v_runs""",
    ),
)
def _success(spark, sf):
    return _round(M.success_rates(view(spark, sf, "runs"), F.col("seconds") > 1, "stage"), 6)


@query(
    "last_counter_value",
    "A17",
    sql=oracle("runs", "SELECT coalesce(seconds, 0) AS seconds FROM v_runs ORDER BY ord DESC, id DESC LIMIT 1"),
)
def _last(spark, sf):
    return M.last_value(view(spark, sf, "runs"), "seconds", F.struct("ord", "id"))


@query(
    "ratio_of_sums",
    "A18",
    sql=oracle(
        "votes",
        "SELECT sum(yolo_bars) / sum(yolo_line_segments) AS numeric_accuracy, count(*) FILTER (heuristic_prediction <> 'unknown') / count(*) AS success_rate FROM v_votes",
    ),
)
def _ratio(spark, sf):
    return M.ratio_of_sums(view(spark, sf, "votes"), "yolo_bars", "yolo_line_segments", F.col("heuristic_prediction") != "unknown")


@query(
    "attempt_rates",
    "A19",
    sql=oracle(
        "votes",
        """SELECT count(*) FILTER (ml_confidence > 0.5) / count(*) AS first_rate, count(*) FILTER (cnn_prediction <> '') / count(*) AS second_rate,
 count(*) FILTER (heuristic_prediction = 'unknown') / count(*) AS fallback_rate FROM v_votes""",
    ),
)
def _attempts(spark, sf):
    return M.attempt_rates(
        view(spark, sf, "votes"),
        {
            "first_rate": F.col("ml_confidence") > 0.5,
            "second_rate": F.col("cnn_prediction") != "",
            "fallback_rate": F.col("heuristic_prediction") == "unknown",
        },
    )


@query(
    "fixed_bins",
    "A28",
    sql=oracle(
        "pred",
        """WITH b AS (SELECT least(floor(confidence / (1.0 / 32)) + 1, 32) AS bin FROM v_pred WHERE confidence BETWEEN 0 AND 1)
SELECT CAST(g.range AS INT) AS bin, count(b.bin) AS n FROM range(1, 33) g LEFT JOIN b ON b.bin = g.range GROUP BY 1""",
    ),
)
def _bins(spark, sf):
    return M.fixed_bins(view(spark, sf, "pred"), "confidence", 0.0, 1.0, 32)


@query(
    "box_quartiles",
    "A35",
    sql=oracle(
        "votes",
        " UNION ALL ".join(
            f"SELECT '{c}' AS series, round(quantile_cont({c}, 0.25), 9) AS q1, round(quantile_cont({c}, 0.5), 9) AS median, round(quantile_cont({c}, 0.75), 9) AS q3 FROM v_votes"
            for c in ("heuristic_confidence", "ml_confidence", "cnn_confidence", "yolo_confidence")
        ),
    ),
)
def _quartiles(spark, sf):
    return _round(
        M.quartiles(view(spark, sf, "votes"), ["heuristic_confidence", "ml_confidence", "cnn_confidence", "yolo_confidence"])
    )


@query(
    "category_shares",
    "A36",
    sql=oracle("pred", "SELECT pred, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM v_pred GROUP BY 1"),
)
def _shares(spark, sf):
    return M.category_shares(view(spark, sf, "pred"), "pred")


@query(
    "metric_rows",
    "S10",
    sql=oracle(
        "pred",
        CLASSES_SQL
        + """, a AS (SELECT sum(tp) / sum(support) AS accuracy, avg(f1) AS macro_f1, CAST(sum(support) AS DOUBLE) AS rows FROM m)
SELECT metric, round(value, 9) AS value FROM (UNPIVOT a ON accuracy, macro_f1, rows INTO NAME metric VALUE value) u""",
    ),
)
def _rows(spark, sf):
    return _round(M.metric_rows(M.classification_metrics(_eval(spark, sf)).select("accuracy", "macro_f1", "rows")))


MODELS = ("heuristic", "ml", "cnn", "yolo")


@query(
    "model_comparison",
    "A37",
    sql=oracle(
        "votes",
        " UNION ALL ".join(
            f"SELECT '{m}' AS model, count(*) FILTER (truth = {m}_prediction) / count(*) AS accuracy, "
            + (f"round(avg({m}_confidence), 9)" if m != "yolo" else "0.0")
            + f" AS mean_confidence, CAST(0 AS DOUBLE) AS runtime FROM v_votes WHERE truth <> 'unknown'"
            for m in MODELS
        ),
    ),
)
def _comparison(spark, sf):
    df = M.labelled(view(spark, sf, "votes"))
    tables = {}
    for m in MODELS:
        one = [F.avg((F.col("truth") == F.col(f"{m}_prediction")).cast("double")).alias("accuracy")]
        if m != "yolo":
            one.append(F.round(F.avg(f"{m}_confidence"), 9).alias("mean_confidence"))
        tables[m] = df.agg(*one)
    return M.model_comparison(tables, ["accuracy", "mean_confidence", "runtime"])


def _scored(spark, sf):
    rest = (1 - F.col("confidence")) / 4
    pairs = []
    for c in STANDARD_LABELS:
        pairs += [F.lit(c), F.when(F.col("pred") == c, F.col("confidence")).otherwise(rest)]
    return _eval(spark, sf).select("id", "truth", F.create_map(*pairs).alias("score"))


SCORED_SQL = """WITH s AS (SELECT c.class, CAST(truth = c.class AS INT) AS p,
 CASE WHEN pred = c.class THEN confidence ELSE (1 - confidence) / 4 END AS score
 FROM v_pred, (SELECT unnest(['bar_chart','histogram','line_chart','scatter_plot','pie_chart']) AS class) c WHERE truth <> 'unknown'),
g AS (SELECT class, score, sum(p) AS p, sum(1 - p) AS f FROM s GROUP BY 1, 2),
k AS (SELECT class, score, p, f, sum(p) OVER w AS tp, sum(f) OVER w AS fp, sum(p) OVER (PARTITION BY class) AS tot, sum(f) OVER (PARTITION BY class) AS neg
 FROM g WINDOW w AS (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
"""


@query(
    "roc_points",
    "A33",
    sql=oracle("pred", SCORED_SQL + "SELECT class, score, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, tp / tot AS tpr, fp / neg AS fpr FROM k"),
)
def _roc(spark, sf):
    return M.roc_curve(_scored(spark, sf), "truth", "score", STANDARD_LABELS)


@query(
    "roc_auc",
    "A33",
    sql=oracle("pred", SCORED_SQL + "SELECT class, round(sum(f * (2 * tp - p)) / (2 * max(tot) * max(neg)), 9) AS auc FROM k GROUP BY 1"),
)
def _auc(spark, sf):
    return _round(M.roc_auc(_scored(spark, sf), "truth", "score", STANDARD_LABELS))


@query(
    "precision_recall_points",
    "A34",
    sql=oracle("pred", SCORED_SQL + "SELECT class, score, tp / (tp + fp) AS precision, tp / tot AS recall FROM k"),
)
def _pr(spark, sf):
    return M.precision_recall_curve(_scored(spark, sf), "truth", "score", STANDARD_LABELS)


@query(
    "wrong_predictions",
    "T2",
    sql=oracle(
        "pred",
        "SELECT id, truth, pred, confidence FROM v_pred WHERE truth <> 'unknown' AND truth <> pred ORDER BY confidence DESC, id LIMIT 50",
    ),
)
def _wrong(spark, sf):
    return M.wrong_predictions(_eval(spark, sf), "truth", "pred", "confidence", "id", 50).select("id", "truth", "pred", "confidence")


@query(
    "all_wrong_predictions",
    "T2",
    "T1",
    sql=oracle("pred", "SELECT id, truth, pred, confidence FROM v_pred WHERE truth <> 'unknown' AND truth <> pred"),
)
def _all_wrong(spark, sf):
    return M.wrong_predictions(_eval(spark, sf), "truth", "pred", "confidence", "id", None).select("id", "truth", "pred", "confidence")


@query(
    "error_sets",
    "U2",
    sql=oracle(
        "votes",
        """SELECT id, CASE WHEN truth <> ml_prediction AND truth <> yolo_prediction THEN 'both_fail' WHEN truth <> ml_prediction THEN 'only_first_fails'
 ELSE 'only_second_fails' END AS outcome FROM v_votes WHERE truth <> 'unknown' AND (truth <> ml_prediction OR truth <> yolo_prediction)""",
    ),
)
def _error_sets(spark, sf):
    return M.error_sets(M.labelled(view(spark, sf, "votes")), "id", "truth", "ml_prediction", "yolo_prediction")


@query(
    "label_domain",
    "U3",
    "U1",
    sql=oracle("pred", "SELECT truth AS label FROM v_pred UNION SELECT pred FROM v_pred"),
)
def _domain(spark, sf):
    df = view(spark, sf, "pred")
    return df.select(F.col("truth").alias("label")).union(df.select("pred")).distinct()


@query(
    "union_of_parts",
    "U1",
    sql=oracle("pred", "SELECT truth, count(*) AS n FROM v_pred GROUP BY 1"),
)
def _union(spark, sf):
    df = view(spark, sf, "pred")
    low, high = df.filter(F.col("price") < 250000), df.filter(F.col("price") >= 250000)
    return low.unionByName(high).groupBy("truth").agg(F.count(F.lit(1)).alias("n"))


_CUTS = ST._POISSON_CUTS


def _bootstrap_sql(resamples: int) -> str:
    draw = "CAST('0x' || substring(d, 4 * w + 1, 4) AS INT)"
    times = " + ".join(f"CAST({draw} >= {int(c, 16)} AS INT)" for c in _CUTS)
    hashes = -(-resamples // 8)
    return f"""WITH h AS (SELECT CAST(truth = pred AS DOUBLE) AS x, i.range AS i, md5(id || '-42-' || i.range) AS d
 FROM v_pred, range({hashes}) i WHERE truth <> 'unknown'),
s AS (SELECT i * 8 + w AS b, sum(x * ({times})) / sum({times}) AS v FROM (SELECT h.*, w.range AS w FROM h, range(8) w) q GROUP BY 1)
SELECT round(avg(v), 9) AS mean, round(quantile_cont(v, 0.025), 9) AS lower, round(quantile_cont(v, 0.975), 9) AS upper FROM s WHERE b < {resamples}"""


@query("bootstrap_accuracy", "A41", "E4", sql=oracle("pred", _bootstrap_sql(1000)))
def _bootstrap(spark, sf):
    hit = (F.col("truth") == F.col("pred")).cast("int")
    samples = ST.bootstrap_rows(_eval(spark, sf), "id", hit, F.lit(1), 1000)
    return _round(ST.bootstrap_interval(samples))


@query(
    "mcnemar_test",
    "A42",
    sql=oracle(
        "votes",
        """WITH c AS (SELECT count(*) FILTER (a AND NOT b) AS only_first, count(*) FILTER (NOT a AND b) AS only_second FROM (
 SELECT truth = ml_prediction AS a, truth = yolo_prediction AS b FROM v_votes WHERE truth <> 'unknown') q)
SELECT only_first, only_second, round((abs(only_first - only_second) - 1) ** 2 / (only_first + only_second), 9) AS statistic FROM c""",
    ),
)
def _mcnemar(spark, sf):
    out = ST.mcnemar(M.labelled(view(spark, sf, "votes")), "truth", "ml_prediction", "yolo_prediction")
    return _round(out.select("only_first", "only_second", "statistic"))


@query("mcnemar_p_value", "A42")
def _mcnemar_p(spark, sf):
    return ST.mcnemar(M.labelled(view(spark, sf, "votes")), "truth", "ml_prediction", "cnn_prediction")


def _fold_scores(spark, sf):
    df = M.labelled(view(spark, sf, "votes"))
    acc = lambda m: F.avg((F.col("truth") == F.col(f"{m}_prediction")).cast("double")).alias(m)
    return df.groupBy((F.col("id") % 5).alias("fold")).agg(*[acc(m) for m in MODELS])


FOLDS_SQL = (
    "WITH f AS (SELECT id % 5 AS fold, "
    + ", ".join(f"count(*) FILTER (truth = {m}_prediction) / count(*) AS {m}" for m in MODELS)
    + " FROM v_votes WHERE truth <> 'unknown' GROUP BY 1)\n"
)


@query(
    "paired_t_statistic",
    "A43",
    sql=oracle(
        "votes",
        FOLDS_SQL
        + "SELECT count(*) AS folds, round(avg(ml - yolo), 9) AS mean_diff, round(avg(ml - yolo) / (stddev_samp(ml - yolo) / sqrt(count(*))), 6) AS t FROM f",
    ),
)
def _paired(spark, sf):
    out = ST.paired_t(_fold_scores(spark, sf), "ml", "yolo")
    return out.select("folds", F.round("mean_diff", 9).alias("mean_diff"), F.round("t", 6).alias("t"))


@query("paired_t_bonferroni", "A43")
def _bonferroni(spark, sf):
    folds = _fold_scores(spark, sf)
    tests = None
    for m in ("heuristic", "cnn", "yolo"):
        t = ST.paired_t(folds, "ml", m).withColumn("other", F.lit(m))
        tests = t if tests is None else tests.unionByName(t)
    return ST.bonferroni(tests)


@query(
    "fold_mean_std",
    "A45",
    sql=oracle(
        "votes",
        FOLDS_SQL + " UNION ALL ".join(f"SELECT '{m}' AS model, round(avg({m}), 9) AS mean, round(stddev_samp({m}), 9) AS std FROM f" for m in MODELS),
    ),
)
def _mean_std(spark, sf):
    long = _fold_scores(spark, sf).unpivot(["fold"], list(MODELS), "model", "accuracy")
    return _round(ST.mean_std(long, "model", "accuracy"))
