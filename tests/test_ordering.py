import random
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from chartloom.operators import ordering as O
from chartloom.session import cut_lineage


def _skewed(spark, n=600):
    rnd = random.Random(1)
    rows = [(i, "hot" if rnd.random() < 0.7 else f"g{i % 3}", rnd.randint(0, 30), rnd.random()) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, g string, x int, v double")


def test_hash_rank_equals_window_rank(spark):
    df = _skewed(spark).withColumn("h", O.order_hash("id", 7))
    got = O.hash_rank(df, ["g"], "h", "id", size_col="n")
    w = Window.partitionBy("g")
    want = df.withColumn("r2", F.row_number().over(w.orderBy("h", "id"))).withColumn("n2", F.count("id").over(w))
    both = got.join(want.select("id", "r2", "n2"), "id")
    assert both.count() == 600
    assert both.filter("rank <> r2 OR n <> n2").count() == 0


def test_global_index_and_group_rank(spark):
    df = _skewed(spark)
    idx = {r["id"]: r["idx"] for r in O.global_index(df, ["x", "id"]).collect()}
    order = [r["id"] for r in df.orderBy("x", "id").collect()]
    assert [idx[i] for i in order] == list(range(600))
    got = O.rank_in_group(df, ["g"], ["x", "id"])
    want = df.withColumn("w", F.row_number().over(Window.partitionBy("g").orderBy("x", "id")) - 1)
    assert got.join(want.select("id", "w"), "id").filter("rank <> w").count() == 0


def test_running_totals(spark):
    df = _skewed(spark)
    got = O.running_totals(df, ["g"], [F.desc("x"), F.col("id")], {"cum": "x"})
    w = Window.partitionBy("g").orderBy(F.desc("x"), "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.select("id", F.sum("x").over(w).alias("want"))
    assert got.join(want, "id").filter("cum <> want").count() == 0


def test_previous_row_with_copies(spark):
    df = _skewed(spark)
    got = O.previous_row(df, "g", "x", "id", ["v"])
    want = df.select("id", F.lag("v").over(Window.partitionBy("g").orderBy("x", "id")).alias("want"))
    assert got.join(want, "id").filter("NOT (prev.v <=> want)").count() == 0


def test_exact_quantiles(spark):
    df = _skewed(spark)
    rows = df.collect()
    for value in ("v", "x"):
        got = {(r["g"], r["q"]): r["quantile"] for r in O.exact_quantiles(df, ["g"], value, [0.0, 0.25, 0.5, 1.0]).collect()}
        for (g, q), have in got.items():
            assert abs(have - np.percentile([r[value] for r in rows if r["g"] == g], q * 100)) < 1e-12
    # with few values held the selection goes on for several rounds
    for p in (0.25, 0.5, 0.9):
        got = O.exact_quantiles(df, [], "v", [p], held=3).first()["quantile"]
        assert abs(got - np.percentile([r["v"] for r in rows], p * 100)) < 1e-12
    whole = O.exact_quantiles(df, [], "v", [0.5]).first()["quantile"]
    assert abs(whole - np.median([r["v"] for r in rows])) < 1e-12


@pytest.mark.parametrize("value", ["CAST(7 AS DOUBLE)", "CAST(pmod(id * 7919, 1000003) AS DOUBLE)", "pow(2D, CAST(pmod(id * 7919, 1000003) AS DOUBLE) / 5000)", "IF(id % 3 = 0, 1D, CAST(id AS DOUBLE))"])
def test_quantiles_of_many_rows(spark, value):
    """A million equal, distinct, widely spread and partly equal values."""
    n = 1_000_003
    df = spark.range(n).selectExpr(f"{value} AS v")
    got = {r.q: r.quantile for r in O.exact_quantiles(df, [], "v", [0.0, 0.1, 0.5, 0.999, 1.0], held=100).collect()}
    rows = np.sort(df.toPandas()["v"].to_numpy())
    assert got == pytest.approx({q: np.percentile(rows, q * 100) for q in got}, rel=1e-12)
    assert O.exact_quantiles(df.limit(0), [], "v", [0.5]).count() == 0


def test_shuffle_files_go_with_the_lineage(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = disk.getAllFiles().size()
    out = cut_lineage(spark.range(1000).groupBy((F.col("id") % 7).alias("g")).count())
    until = time.time() + 20
    while disk.getAllFiles().size() > before and time.time() < until:  # removed in the background
        time.sleep(0.1)
    assert disk.getAllFiles().size() <= before
    assert out.agg(F.sum("count")).first()[0] == 1000


@pytest.mark.parametrize("sent", [4096, 0])
def test_rows_of_a_group_meet_its_pivots_in_many_tasks(spark, monkeypatch, request, sent):
    monkeypatch.setattr(O, "_SENT", sent)
    values = [float((i * 7919) % 4001) for i in range(4000)]
    rows = spark.createDataFrame([(k, v) for k in ("a", None) for v in values], "k string, _v double").repartition(8)
    for name, value in (("adaptive.coalescePartitions.enabled", "false"), ("autoBroadcastJoinThreshold", "-1")):
        before = spark.conf.get(f"spark.sql.{name}")
        request.addfinalizer(lambda n=name, v=before: spark.conf.set(f"spark.sql.{n}", v))
        spark.conf.set(f"spark.sql.{name}", value)
    met = O._beside(rows, spark.createDataFrame([("a", 1), (None, 2)], "k string, p int"), ["k"])
    assert met.groupBy("k", "p").count().count() == 2 and met.count() == 8000
    assert met.filter("k = 'a'").select(F.spark_partition_id()).distinct().count() > 1
