import hashlib
import random

import pytest
from pyspark.sql import functions as F

from chartloom.functions import labels as L
from chartloom.operators import metrics as M
from chartloom.operators import quality as Q
from chartloom.operators import resolve as R
from chartloom.operators import rules as RU
from chartloom.operators import sampling as S
from chartloom.operators import stats as ST
from chartloom.operators import voting as V
from chartloom.plans.registry import all_queries


def _labelled(spark, sizes):
    rows = [(f"{c}-{i}", c) for c, n in sizes.items() for i in range(n)]
    return spark.createDataFrame(rows, "key string, label string")


def test_label_functions(spark):
    df = spark.createDataFrame([(" H-Bar ",), ("vertical bar",), ("Dot-Line",), (None,), ("10_dot_line.png",)], "t string")
    got = [r[0] for r in df.select(L.normalize_label(F.col("t"))).collect()]
    assert got == ["unknown", "bar_chart", "line_chart", "unknown", "unknown"]
    assert df.select(L.infer_label_from_path(F.col("t"))).collect()[4][0] == "scatter_plot"
    paths = spark.createDataFrame([(r"C:\x\y.png",), ("/a/Val/b.png",), ("/a/b/",)], "p string")
    assert [r[0] for r in paths.select(L.base_name(F.col("p"))).collect()] == ["y.png", "b.png", "b"]
    assert paths.select(L.infer_split(F.col("p"))).collect()[1][0] == "validation"


@pytest.mark.parametrize("sizes", [{"a": 300, "b": 20, "c": 7}, {"a": 50, "b": 1}, {"a": 48, "b": 3}, {"a": 30, "b": 4}, {"a": 9}])
def test_splits_partition_the_input(spark, sizes):
    df = _labelled(spark, sizes)
    out = S.stratified_split(df, "label", "key")
    assert out.count() == sum(sizes.values()) == out.select("key").distinct().count()
    counts = {(r["label"], r["split"]): r["count"] for r in out.groupBy("label", "split").count().collect()}
    if len(sizes) == 1:
        assert counts == {("a", "train"): 9}
    elif min(sizes.values()) >= 4:
        for c, n in sizes.items():
            assert counts[(c, "train")] == int(n * 0.7)
    else:
        assert sum(v for (_, s), v in counts.items() if s == "train") == int(51 * 0.7)


def test_balance_cap_and_folds(spark):
    df = _labelled(spark, {"a": 100, "b": 12, "c": 30})
    assert {r["count"] for r in S.balance_classes(df, "label", "key").groupBy("label").count().collect()} == {12}
    assert {r["count"] for r in S.cap_per_class(df, "label", "key", 33).groupBy("label").count().collect()} == {11}
    folds = S.stratified_folds(df, "label", "key", k=5).groupBy("label", "fold").count().collect()
    assert max(r["count"] for r in folds if r["label"] == "b") == 3
    assert S.evenly_spaced(df, ["key"], 500).count() == 142
    assert S.evenly_spaced(df, ["key"], 7).count() == 7


def test_allocation(spark):
    def shares(targets, total):
        rows = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(targets.items())], "label string, target bigint, place int")
        return {r.label: r["count"] for r in S.allocate(rows, "label", "target", total, "place").collect()}

    assert shares({"pie": 300, "bar": 100}, 10) == {"pie": 8, "bar": 2}
    assert shares({"bar": 997, "pie": 1, "line": 2}, 10) == {"bar": 8, "pie": 1, "line": 1}
    # the giver is the first by the given order, not by name, whose share exceeds the excess
    assert shares({"t1": 1, "zed": 500, "abc": 500, "t2": 1}, 5) == {"t1": 1, "zed": 1, "abc": 2, "t2": 1}
    assert shares({"t1": 1, "zed": 500, "abc": 500}, 4) == {"t1": 2, "zed": 1, "abc": 1}
    assert shares({"a": 1, "b": 1, "c": 1}, 2) == {"a": 1, "b": 1, "c": 1}  # no class can give


def test_report_matches_hand_count(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "a"), ("a", "b"), ("b", "c")], "truth string, pred string")
    report = {r["label"]: r for r in M.classification_report(df).collect()}
    assert report["a"]["precision"] == 1.0 and report["a"]["recall"] == pytest.approx(2 / 3)
    assert report["c"]["support"] == 0 and report["c"]["recall"] == 0.0
    assert report["accuracy"]["f1"] == 0.5 and report["macro avg"]["f1"] == pytest.approx(0.8 / 3)
    assert M.confusion_matrix(df).agg(F.sum("n"), F.count("n")).first()[:] == (4, 9)


def test_statistics(spark):
    assert ST._two_sided(2.228138852, 10) == pytest.approx(0.05, abs=1e-6)
    rnd = random.Random(3)
    df = spark.createDataFrame([(i, int(rnd.random() < 0.8)) for i in range(500)], "id int, hit int")
    samples = ST.bootstrap_metric(df, F.col("hit"), F.lit(1), 200)
    assert samples.count() == 200 == samples.select("b").distinct().count()
    interval = ST.bootstrap_interval(samples).first()
    assert interval["lower"] < df.agg(F.avg("hit")).first()[0] < interval["upper"]
    assert interval["upper"] - interval["lower"] == pytest.approx(4 * (0.8 * 0.2 / 500) ** 0.5, rel=0.3)


@pytest.mark.parametrize("mean", [1.0, 7.0, 60.0, 150.0])
def test_poisson_draws(spark, mean):
    n = 20_000
    u = lambda salt: (F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 32)) + 0.5) / float(1 << 32)
    m = F.lit(mean)
    cuts = F.when(m < ST._EXACT_COUNTS, ST.poisson_cuts(m))
    k = spark.range(n).select(ST.poisson_draw(m, cuts, u(1), u(2)).alias("k"))
    r = k.agg(F.avg("k").alias("avg"), F.var_samp("k").alias("var"), F.skewness("k").alias("skew"), F.min("k").alias("low")).first()
    assert r.avg == pytest.approx(mean, abs=5 * (mean / n) ** 0.5) and r["var"] == pytest.approx(mean, rel=0.06)
    assert r["skew"] == pytest.approx(mean**-0.5, abs=0.1) and r.low >= 0


def test_bootstrap_by_values_agrees_with_rows(spark):
    """Mean and width of the interval against draws with replacement, row by row."""
    rnd = random.Random(5)
    rows = [(rnd.choice([0.0, 1.0, 2.5, None]), rnd.choice([1.0, 2.0])) for _ in range(800)]
    df = spark.createDataFrame(rows, "x double, y double")
    got = [r.value for r in ST.bootstrap_metric(df, F.col("x"), F.col("y"), 1000).collect()]
    want = []
    for _ in range(1000):
        drawn = rnd.choices(rows, k=len(rows))
        want.append(sum(x or 0 for x, _ in drawn) / sum(y for _, y in drawn))
    spread = lambda v: (sorted(v)[25], sorted(v)[-26])
    width = spread(want)[1] - spread(want)[0]
    assert sum(got) / 1000 == pytest.approx(sum(want) / 1000, abs=width / 20)
    assert spread(got)[1] - spread(got)[0] == pytest.approx(width, rel=0.15)
    assert ST.bootstrap_metric(df.limit(0), F.col("x"), F.col("y")).count() == 0


def test_bootstrap_draws_every_row(spark):
    rows = [(i, float(i % 3 == 0)) for i in range(200)]
    got = {r.b: r.value for r in ST.bootstrap_rows(spark.createDataFrame(rows, "id bigint, x double"), "id", F.col("x"), F.lit(1), 20).collect()}
    cuts = [int(c, 16) for c in ST._POISSON_CUTS]
    times = lambda i, b: sum(int(hashlib.md5(f"{i}-42-{b // 8}".encode()).hexdigest()[b % 8 * 4 :][:4], 16) >= c for c in cuts)
    assert set(got) == set(range(20))
    for b in got:
        drawn = [(times(i, b), x) for i, x in rows]
        assert got[b] == pytest.approx(sum(t * x for t, x in drawn) / sum(t for t, _ in drawn))
    assert "md5(id ||" in all_queries()["bootstrap_accuracy"].sql  # drawn for each row in SQL too


def _votes(spark, *rows):
    cols = [f"{v}_{k}" for v in V.VOTERS for k in ("prediction", "confidence")]
    schema = ", ".join(f"{c} {'string' if c.endswith('prediction') else 'double'}" for c in cols)
    df = spark.createDataFrame(rows, schema)
    return df.withColumns(
        {"histogram_score": F.lit(0.0), "bar_chart_score": F.lit(0.0), "yolo_bars": F.lit(0), "yolo_line_segments": F.lit(0)}
    )


def test_vote_ties_and_blanks(spark):
    blank = ("unknown", 0.9, "", 0.9, "nan", 0.9, "unknown", 1.0)
    tie = ("pie_chart", 1.0, "line_chart", 1.0, "unknown", 0.0, "unknown", 0.0)
    out = V.vote(_votes(spark, blank, tie), {"heuristic": 0.5, "ml": 0.5}).collect()
    assert (out[0]["hybrid_prediction"], out[0]["hybrid_confidence"]) == ("unknown", 0.0)
    assert (out[1]["hybrid_prediction"], out[1]["hybrid_confidence"]) == ("pie_chart", 0.5)
    assert len(V.weight_grid()) == 84


def test_rules_and_answers(spark):
    df = spark.createDataFrame(
        [(1, 0.0, 0.0, 0.0, 0.0), (2, 20.0, 0.15, 0.6, 0.25)],
        "id int, circle_count double, g_bar_gap_ratio double, g_histogram_uniformity_score double, bar_spacing_ratio double",
    )
    # all zeros: the small gaps speak for a histogram; the second row scores below 1 everywhere
    assert [r["chart_type"] for r in RU.classify(df).orderBy("id").collect()] == ["histogram", "scatter_plot"]
    series = spark.createDataFrame(
        [(1, "bar_chart", 0, "a", 2.0), (1, "bar_chart", 1, "b", 5.0), (1, "bar_chart", 2, "c", 5.0), (2, "pie_chart", 0, "z", None)],
        "image_id int, chart_type string, pos int, label string, value double",
    )
    out = {r["image_id"]: r for r in RU.answers(series).collect()}
    assert out[1]["highest"] == "b has the highest value at 5.00."
    assert "increasing" in out[1]["trend"] and out[2]["highest"].startswith("Unable")
    flat = spark.createDataFrame([(1.0, 3.0), (2.0, 3.0)], "a double, b double")
    assert sorted(map(tuple, RU.minmax(flat, {"x": "a", "y": "b"}).select("x", "y").collect())) == [(0.0, 0.0), (1.0, 0.0)]


def test_quality_checks(spark):
    df = spark.createDataFrame([("bar_chart", "train", "p")], "label string, split string, image_path string")
    with pytest.raises(ValueError, match="splits_present"):
        Q.require(Q.dataset_checks(df))
    Q.require(Q.dataset_checks(df, splits=("train",), labels=("bar_chart",), per_class=1))
    assert Q.drop_empty_columns(df.withColumn("e", F.lit(None))).columns == df.columns


def test_last_row_wins_in_lookups(spark):
    rows = spark.createDataFrame([("x_bar.png",), ("y_pie.png",)], "image_name string")
    splits = spark.createDataFrame(
        [(0, "x_bar.png", "train", "histogram", "d1"), (1, "x_bar.png", "test", "odd", "d2")],
        "n int, image_name string, split string, label string, dataset_name string",
    )
    out = {r["image_name"]: r for r in R.attach_labels(rows, splits, "n").collect()}
    assert (out["x_bar.png"]["split"], out["x_bar.png"]["true_chart_type"]) == ("test", "unknown")
    assert (out["y_pie.png"]["split"], out["y_pie.png"]["true_chart_type"]) == ("unspecified", "pie_chart")
