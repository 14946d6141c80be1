"""NULL groups, one hot group and repeated rows in the helpers that replace windows."""

from pyspark.sql import Row
from pyspark.sql import functions as F

from chartloom.operators import fingerprint as FP
from chartloom.operators import metrics as M
from chartloom.operators import ordering as O
from chartloom.operators import sampling as S
from chartloom.operators import stats as ST
from chartloom.operators import voting as V


def _rows(spark):
    return spark.range(100).select(
        F.col("id"), F.when(F.col("id") % 10 == 0, None).otherwise(F.concat(F.lit("c"), F.col("id") % 3)).alias("g")
    )


def test_null_groups_are_kept(spark):
    df = _rows(spark)
    assert S.stratified_split(df, "g", "id").count() == 100
    assert S.stratified_folds(df, "g", "id").count() == 100
    assert S.stratified_holdout(df, "g", "id").count() == 100
    ranked = O.rank_in_group(df, ["g"], ["id"]).filter("g is null").orderBy("id").collect()
    assert [r["rank"] for r in ranked] == list(range(10))
    totals = O.running_totals(df.withColumn("one", F.lit(1)), ["g"], [F.col("id")], {"n": "one"})
    assert totals.count() == 100 and totals.filter("g is null").agg(F.max("n")).first()[0] == 10
    median = {r.g: r.quantile for r in O.exact_quantiles(df, ["g"], "id", [0.5]).collect()}
    assert median[None] == 45.0 and len(median) == 4
    assert O.hash_rank(df.withColumn("h", O.order_hash("id", 1)), ["g"], "h", "id").count() == 100


def test_previous_row_of_one_hot_group(spark):
    df = spark.range(5000).select(F.lit("a").alias("g"), (F.col("id") % 7).alias("x"), (F.col("id") * 100_003).alias("seq"), F.col("id").alias("v"))
    got = {r.v: (r.prev.v if r.prev else None) for r in O.previous_row(df, "g", "x", "seq", ["v"]).collect()}
    order = sorted(range(5000), key=lambda i: (i % 7, i))
    assert got == dict(zip(order, [None, *order]))


def test_first_per_class_counts_null_class(spark):
    got = S.first_per_class(_rows(spark), "g", ["id"], 2).collect()
    assert sorted(r.id for r in got if r.g is None) == [0, 10] and len(got) == 8


def test_counts_beyond_64_bits(spark):
    n = 3_000_000_000
    curve = spark.createDataFrame([("a", 0.9, n, n), ("a", 0.1, n, n)], "class string, score double, p bigint, f bigint")
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    assert curve.agg(F.sum(wide("f") * (wide("p") + wide("p"))).cast("double")).first()[0] == 4.0 * n * n
    score = F.create_map(F.lit("a"), F.col("s"))
    rows = spark.createDataFrame([("a", 0.9), ("b", 0.2), ("a", 0.4), ("b", 0.6)], "y string, s double").withColumn("m", score)
    assert M.roc_auc(rows, "y", "m", ["a"]).first().auc == 0.75
    pair = spark.createDataFrame([("x", "x", "y")] * 3 + [("x", "y", "x")] * 9, "t string, a string, b string")
    assert ST.mcnemar(pair, "t", "a", "b").first().statistic == 25 / 12


def test_equal_rows_vote_apart(spark):
    df = spark.createDataFrame([Row(id=1, a={"x": 0.5, "y": 0.1}, b={"x": 0.5})] * 2, "id int, a map<string,double>, b map<string,double>")
    got = sorted((r["class"], r.score) for r in V.probability_vote(df, {"a": "a", "b": "b"}, {"a": 1.0, "b": 2.0}).collect())
    assert got == [("x", 1.5), ("x", 1.5), ("y", 0.1), ("y", 0.1)]


def test_fingerprint_tells_columns_apart(spark):
    one = lambda *r: FP.dataset_fingerprint(spark.createDataFrame([r], "a string, b string"), ["a", "b"]).first().fingerprint
    assert len({one("a1", "2"), one("a", "12"), one("", None), one(None, ""), one(None, None)}) == 5
