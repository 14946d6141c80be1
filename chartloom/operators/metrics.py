"""Classification, confidence and value metrics from grouped counts.

All class metrics start from the (truth, prediction) count table, which has at most
classes x classes rows, so the only pass over the data is one partial aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.labels import UNKNOWN
from chartloom.functions.text import safe_double
from chartloom.operators.ordering import exact_quantiles, running_totals


def _rate(num: Column, den: Column) -> Column:
    """num/den with 0 where the denominator is 0 (zero_division=0)."""
    return F.coalesce(F.try_divide(num.cast("double"), den.cast("double")), F.lit(0.0))


def labelled(df: DataFrame, truth: str = "truth") -> DataFrame:
    return df.filter(F.col(truth) != UNKNOWN)


def pair_counts(df: DataFrame, truth: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Zero-filled counts for all pairs of the sorted union of labels (long form)."""
    counts = pair_counts(df, truth, pred)
    domain = (
        counts.select(F.col("truth").alias("c"))
        .union(counts.select("pred"))
        .agg(F.sort_array(F.collect_set("c")).alias("d"))  # class labels only
    )
    grid = domain.select(F.explode("d").alias("truth"), "d").select("truth", F.explode("d").alias("pred"))
    return grid.join(counts, ["truth", "pred"], "left").select(
        "truth", "pred", F.coalesce("n", F.lit(0)).cast("bigint").alias("n")
    )


def per_class(counts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, f1, support per label from a pair-count table."""
    by = list(by)
    sides = counts.select(
        *by,
        F.explode(
            F.array(
                F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).cast("bigint").alias("predicted"),
                         F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0).cast("bigint").alias("tp")),
                F.struct(F.col("pred").alias("label"), F.lit(0).cast("bigint").alias("support"), F.col("n").alias("predicted"),
                         F.lit(0).cast("bigint").alias("tp")),
            )
        ).alias("s"),
    )
    sums = sides.groupBy(*by, F.col("s.label").alias("label")).agg(
        F.sum("s.support").alias("support"), F.sum("s.predicted").alias("predicted"), F.sum("s.tp").alias("tp")
    )
    # 2tp/(predicted+support) is the harmonic mean of precision and recall
    return sums.select(
        *by,
        "label",
        _rate(F.col("tp"), F.col("predicted")).alias("precision"),
        _rate(F.col("tp"), F.col("support")).alias("recall"),
        _rate(2 * F.col("tp"), F.col("predicted") + F.col("support")).alias("f1"),
        "support",
        "tp",
    )


def averages(classes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy plus macro and support-weighted precision, recall and f1."""
    weight = F.col("support")
    total = F.sum("support")
    out = [_rate(F.sum("tp"), total).alias("accuracy")]
    for m in ("precision", "recall", "f1"):
        out.append(F.avg(m).alias(f"macro_{m}"))
        out.append(_rate(F.sum(F.col(m) * weight), total).alias(f"weighted_{m}"))
    return classes.groupBy(*by).agg(*out, total.alias("rows"))


def classification_metrics(df: DataFrame, truth: str = "truth", pred: str = "pred", by: Sequence[str] = ()) -> DataFrame:
    return averages(per_class(pair_counts(df, truth, pred, by), by), by)


def classification_report(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """One row per class, then accuracy, macro avg and weighted avg rows."""
    classes = per_class(pair_counts(df, truth, pred))
    total = averages(classes)
    tail = total.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("label"), p.alias("precision"), r.alias("recall"), f.alias("f1"), F.col("rows").alias("support")
                    )
                    for name, p, r, f in (
                        ("accuracy", F.col("accuracy"), F.col("accuracy"), F.col("accuracy")),
                        ("macro avg", F.col("macro_precision"), F.col("macro_recall"), F.col("macro_f1")),
                        ("weighted avg", F.col("weighted_precision"), F.col("weighted_recall"), F.col("weighted_f1")),
                    )
                ]
            )
        ).alias("t")
    ).select("t.*")
    return classes.select("label", "precision", "recall", "f1", "support").unionByName(tail)


def per_class_accuracy(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Diagonal over max(1, row sum) for every label that occurs on either side."""
    return per_class(pair_counts(df, truth, pred)).select(
        "label", (F.col("tp") / F.greatest(F.lit(1), F.col("support"))).alias("accuracy")
    )


def pair_report(df: DataFrame, one: str = "histogram", other: str = "bar_chart", truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Confusions between two classes and precision, recall, f1 of the first."""
    t, p = F.col(truth), F.col(pred)
    counted = df.agg(
        F.count_if((t == other) & (p == other)).alias("other_other"),
        F.count_if((t == other) & (p == one)).alias("other_one"),
        F.count_if((t == one) & (p == other)).alias("one_other"),
        F.count_if((t == one) & (p == one)).alias("one_one"),
        F.count_if(t == one).alias("_support"),
        F.count_if(p == one).alias("_predicted"),
    )
    return counted.select(
        (F.col("other_one") + F.col("one_other")).alias("confusions"),
        "other_other", "other_one", "one_other", "one_one",
        _rate(F.col("one_one"), F.col("_predicted")).alias("precision"),
        _rate(F.col("one_one"), F.col("_support")).alias("recall"),
        _rate(2 * F.col("one_one"), F.col("_predicted") + F.col("_support")).alias("f1"),
    )


def subset_accuracy(df: DataFrame, classes: Sequence[str], truth: str = "truth", pred: str = "pred") -> DataFrame:
    """Accuracy over rows whose truth is one of ``classes``."""
    hit = (F.col(truth) == F.col(pred)).cast("double")
    return df.filter(F.col(truth).isin(list(classes))).agg(F.avg(hit).alias("accuracy"), F.count(F.lit(1)).alias("rows"))


def grouped_accuracy(df: DataFrame, key: str, correct: Column) -> DataFrame:
    return (
        df.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.coalesce(F.avg(correct.cast("double")), F.lit(0.0)).alias("accuracy"))
    )


def error_pairs(df: DataFrame, truth: str = "truth", pred: str = "pred", k: int | None = None) -> DataFrame:
    """(truth, prediction) confusions, most frequent first, equal counts in label order; all or the first ``k``."""
    wrong = labelled(df, truth).filter(F.col(truth) != F.col(pred))
    out = pair_counts(wrong, truth, pred).orderBy(F.desc("n"), "truth", "pred")
    return out.limit(k) if k else out


def error_summary(df: DataFrame, truth: str = "truth", pred: str = "pred", k: int | None = None) -> DataFrame:
    """One row: labelled rows, errors, accuracy, and the most frequent confusions as text, all or the first ``k``."""
    counts = pair_counts(labelled(df, truth), truth, pred)
    wrong = F.col("truth") != F.col("pred")
    # at most classes^2 entries
    ranked = F.sort_array(F.collect_list(F.when(wrong, F.struct((-F.col("n")).alias("k"), "truth", "pred"))))
    if k is not None:
        ranked = F.slice(ranked, 1, k)
    return counts.agg(
        F.sum("n").alias("num_labeled"),
        F.coalesce(F.sum(F.when(wrong, F.col("n"))), F.lit(0)).alias("num_errors"),
        ranked.alias("_r"),
    ).select(
        "num_labeled",
        "num_errors",
        (1 - F.col("num_errors") / F.col("num_labeled")).alias("accuracy"),
        F.array_join(
            F.transform("_r", lambda e: F.concat_ws(":", e["truth"], e["pred"], (-e["k"]).cast("string"))), ";"
        ).alias("common_errors"),
    )


def source_benchmarks(df: DataFrame, sources: dict[str, Column], success: Column) -> DataFrame:
    """Metrics per source; a row may belong to several. Null metrics where nothing is labelled."""
    tags = F.array(*[F.when(cond, F.lit(name)) for name, cond in sources.items()])
    tagged = df.withColumn("_ok", success.cast("double")).withColumn("benchmark", F.explode(F.array_compact(tags)))
    size = tagged.groupBy("benchmark").agg(
        F.count(F.lit(1)).alias("num_samples"),
        F.count_if(F.col("truth") != UNKNOWN).alias("num_labeled"),
        F.avg("_ok").alias("_all"),
        F.avg(F.when(F.col("truth") != UNKNOWN, F.col("_ok"))).alias("_lab"),
    )
    scores = classification_metrics(labelled(tagged), by=["benchmark"]).select(
        "benchmark", "accuracy", *[F.col(f"weighted_{m}").alias(m) for m in ("precision", "recall", "f1")]
    )
    wanted = df.sparkSession.createDataFrame([(s,) for s in sources], "benchmark string")
    zero = F.lit(0).cast("bigint")
    return (
        wanted.join(size, "benchmark", "left")
        .join(scores, "benchmark", "left")
        .select(
            "benchmark",
            F.coalesce("num_samples", zero).alias("num_samples"),
            F.coalesce("num_labeled", zero).alias("num_labeled"),
            "accuracy", "precision", "recall", "f1",
            F.coalesce(F.when(F.col("num_labeled") > 0, F.col("_lab")).otherwise(F.col("_all")), F.lit(0.0)).alias("value_accuracy"),
        )
    )


def numeric_summary(df: DataFrame, value: str) -> DataFrame:
    """mean, median, sample standard deviation, min, max and total of a column in one row."""
    median = exact_quantiles(df, [], value, [0.5]).select("quantile").scalar()
    v = F.col(value)
    return df.agg(
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.sum(v).alias("total")
    ).withColumn("median", median)


def column_means(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean of each column; missing columns and unreadable values count as 0."""
    present = set(df.columns)
    return df.agg(*[F.avg(safe_double(F.col(c)) if c in present else F.lit(0.0)).alias(c) for c in columns])


def runtime_check(means: DataFrame, parts: Sequence[str], total: str, low: float = 0.70, high: float = 1.35) -> DataFrame:
    """Component sum, and whether the total mean lies within [low, high] times that sum."""
    parts_sum = sum((F.col(p) for p in parts[1:]), F.col(parts[0]))
    ok = (F.col(total) >= parts_sum * low) & ((parts_sum <= 0) | (F.col(total) <= parts_sum * high))
    return means.withColumn("component_sum", parts_sum).withColumn("runtime_realistic", ok)


def success_rates(df: DataFrame, success: Column, key: str) -> DataFrame:
    """Success in percent overall (key null) and per key."""
    return df.filter(F.col(key).isNotNull()).rollup(key).agg((F.avg(success.cast("double")) * 100).alias("rate"))


def attempt_rates(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Share of rows with each flag; an empty table gives 0."""
    rows = F.greatest(F.lit(1), F.count(F.lit(1)))
    return df.agg(*[(F.count_if(c) / rows).alias(n) for n, c in flags.items()])


def token_quality(df: DataFrame, found: str, union: str, length: str, confidence: str) -> DataFrame:
    ratio = F.coalesce(F.try_divide(F.col(found).cast("double"), F.nullif(F.col(union), F.lit(0))), F.lit(0.0))
    return df.agg(
        F.avg(F.coalesce(F.col(confidence), F.lit(0.0))).alias("average_confidence"),
        F.avg(ratio).alias("token_recall"),
        F.avg((F.coalesce(F.col(length), F.lit(0)) > 0).cast("double")).alias("coverage"),
    )


def last_value(df: DataFrame, value: str, order: Column) -> DataFrame:
    """Value of the last row in ``order`` with nulls read as 0."""
    return df.agg(F.max_by(F.coalesce(F.col(value), F.lit(0.0)), order).alias(value))


def ratio_of_sums(df: DataFrame, found: str, total: str, success: Column) -> DataFrame:
    return df.agg(
        _rate(F.sum(found), F.sum(total)).alias("numeric_accuracy"), F.avg(F.coalesce(success.cast("double"), F.lit(0.0))).alias("success_rate")
    )


def category_shares(df: DataFrame, key: str) -> DataFrame:
    counts = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / counts.agg(F.sum("n")).scalar())


def fixed_bins(df: DataFrame, value: str, low: float, high: float, bins: int) -> DataFrame:
    """Counts in equal bins of [low, high]; the last bin is closed, empty bins are kept."""
    v = F.col(value).cast("double")
    bin_no = F.least(F.width_bucket(v, F.lit(low), F.lit(high), F.lit(bins)), F.lit(bins)).cast("int")
    counts = df.filter((v >= low) & (v <= high)).groupBy(bin_no.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    return grid.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("bigint").alias("n"))


def quartiles(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Box-plot quartiles of several columns: series, q1, median, q3."""
    melted = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], list(columns), "series", "value")
    q = exact_quantiles(melted, ["series"], "value", [0.25, 0.5, 0.75])
    at = lambda p: F.max(F.when(F.col("q") == p, F.col("quantile")))
    return q.groupBy("series").agg(at(0.25).alias("q1"), at(0.5).alias("median"), at(0.75).alias("q3"))


def metric_rows(one_row: DataFrame) -> DataFrame:
    """Long metric,value form of a one-row metric table."""
    return one_row.select(*[F.col(c).cast("double").alias(c) for c in one_row.columns]).unpivot(
        [], one_row.columns, "metric", "value"
    )


def _score_curve(df: DataFrame, label: Column, score: str, classes: Sequence[str]) -> DataFrame:
    """Per class and distinct score: positives and negatives at or above that score."""
    # every row scores its predicted class; the other classes get the remaining mass
    fan = df.select(
        label.alias("_y"),
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("class"), (F.col(score)[c]).alias("score")) for c in classes])
        ).alias("s"),
    ).select((F.col("_y") == F.col("s.class")).cast("bigint").alias("_p"), F.col("s.class").alias("class"), F.col("s.score").alias("score"))
    grouped = fan.groupBy("class", "score").agg(F.sum("_p").alias("p"), F.sum(1 - F.col("_p")).alias("f"))
    return running_totals(grouped, ["class"], [F.desc("score")], {"tp": "p", "fp": "f"})


def roc_curve(df: DataFrame, truth: str, score: str, classes: Sequence[str]) -> DataFrame:
    """One-vs-rest ROC points (class, score, tp, fp, tpr, fpr); ``score`` is a map class -> score."""
    curve = _score_curve(df, F.col(truth), score, classes)
    totals = curve.groupBy("class").agg(F.max("tp").alias("_P"), F.max("fp").alias("_N"))
    return curve.join(totals, "class").select(
        "class", "score", "tp", "fp", _rate(F.col("tp"), F.col("_P")).alias("tpr"), _rate(F.col("fp"), F.col("_N")).alias("fpr")
    )


def roc_auc(df: DataFrame, truth: str, score: str, classes: Sequence[str]) -> DataFrame:
    """Trapezoid area per class. The previous point of a curve is (tp - p, fp - f), so no lag is needed."""
    curve = _score_curve(df, F.col(truth), score, classes)
    wide = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  products of counts pass 64 bits
    area = wide("f") * (wide("tp") + wide("tp") - wide("p"))  # twice the trapezoid, in counts
    sums = curve.groupBy("class").agg(F.sum(area).alias("_a"), F.max("tp").alias("_P"), F.max("fp").alias("_N"))
    return sums.select("class", _rate(F.col("_a").cast("double"), 2.0 * F.col("_P") * F.col("_N")).alias("auc"))


def precision_recall_curve(df: DataFrame, truth: str, score: str, classes: Sequence[str]) -> DataFrame:
    curve = _score_curve(df, F.col(truth), score, classes)
    totals = curve.groupBy("class").agg(F.max("tp").alias("_P"))
    return curve.join(totals, "class").select(
        "class", "score",
        _rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        _rate(F.col("tp"), F.col("_P")).alias("recall"),
    )


def model_comparison(tables: dict[str, DataFrame], columns: Sequence[str]) -> DataFrame:
    """Stack one-row metric tables of several models; metrics a model lacks read 0."""
    out = None
    for name, one in tables.items():
        row = one.withColumn("model", F.lit(name))
        out = row if out is None else out.unionByName(row, allowMissingColumns=True)
    present = set(out.columns)
    return out.select(
        "model", *[(F.coalesce(F.col(c), F.lit(0.0)) if c in present else F.lit(0.0)).alias(c) for c in columns]
    )


def wrong_predictions(df: DataFrame, truth: str, pred: str, confidence: str, key: str, k: int | None = None) -> DataFrame:
    """Misclassified rows, most confident first; all or the first ``k``."""
    out = df.filter(F.col(truth) != F.col(pred)).orderBy(F.desc(confidence), key)
    return out.limit(k) if k else out


def error_sets(df: DataFrame, key: str, truth: str, one: str, other: str) -> DataFrame:
    """Keys on which both predictors fail, only the first, or only the second."""
    wrong = lambda p: F.coalesce(F.col(p) != F.col(truth), F.lit(False))
    flags = df.groupBy(key).agg(F.bool_or(wrong(one)).alias("_a"), F.bool_or(wrong(other)).alias("_b"))
    outcome = F.when(F.col("_a") & F.col("_b"), "both_fail").when(F.col("_a"), "only_first_fails").when(F.col("_b"), "only_second_fails")
    return flags.select(key, outcome.alias("outcome")).filter(F.col("outcome").isNotNull())


def hit_counts(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Per label: correct predictions and all rows, the counts the error bars are made of."""
    return df.groupBy(truth).agg(F.count_if(F.col(truth) == F.col(pred)).alias("hits"), F.count(F.lit(1)).alias("rows"))
