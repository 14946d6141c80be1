"""Resampling intervals and significance tests on prediction tables."""

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# P(Poisson(1) <= k) for k = 0, 1, ... in units of 2^-16, as hex digits: four digits of a hash
# are compared as text, which orders them like numbers and needs no parsing
_POISSON_CUTS = [
    f"{int(65536 * math.exp(-1) * sum(1 / math.factorial(j) for j in range(k + 1))):04x}" for k in range(9)
]
_WORDS_PER_HASH = 8  # an md5 holds eight 16-bit draws

_EXACT_COUNTS = 100  # below, Poisson draws invert the distribution function; from here on they use its normal expansion


def poisson_cuts(mean: Column) -> Column:
    """P(Poisson(mean) <= k) for k = 0, 1, ... as an array; the tail beyond it is less likely than one draw in 2**40."""
    last = F.ceil(mean + 12 * F.sqrt(mean) + 20).cast("int")
    start = F.struct(F.exp(-mean).alias("p"), F.lit(0.0).alias("c"), F.array().cast("array<double>").alias("all"))

    def step(s: Column, k: Column) -> Column:
        total = s["c"] + s["p"]
        return F.struct((s["p"] * mean / (k + 1)).alias("p"), total.alias("c"), F.concat(s["all"], F.array(total)).alias("all"))

    return F.aggregate(F.sequence(F.lit(0), last), start, step)["all"]


def poisson_draw(mean: Column, cuts: Column, u: Column, v: Column) -> Column:
    """A Poisson variate from two uniform numbers in (0, 1): exact inversion where ``cuts`` is given, else the normal expansion
    with its skewness term (Box and Muller's transform of u and v)."""
    z = F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)
    wide = F.greatest(F.lit(0.0), F.floor(mean + F.sqrt(mean) * z + (z * z - 1) / 6 + 0.5).cast("double"))
    return F.when(cuts.isNull(), wide).otherwise(F.size(F.filter(cuts, lambda c: c <= u)).cast("double"))


def bootstrap_metric(df: DataFrame, numerator: Column, denominator: Column, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """Ratio-of-sums metric on ``resamples`` bootstrap samples: columns b, value.

    Every row enters a sample Poisson(1) times, the distributed form of drawing n rows with replacement. n rows of equal
    values enter it Poisson(n) times together, so rows are counted by value first and one draw is made for each value and
    sample: a 0/1 metric costs two draws a sample, however many rows there are. Draws come from hashes of (values, seed, b).
    """
    counts = df.select(numerator.cast("double").alias("_x"), denominator.cast("double").alias("_y")).groupBy("_x", "_y").agg(F.count(F.lit(1)).cast("double").alias("_n"))
    few = F.when(F.col("_n") < _EXACT_COUNTS, poisson_cuts(F.col("_n")))
    name = F.concat_ws("|", F.coalesce(F.col("_x").cast("string"), F.lit("null")), F.coalesce(F.col("_y").cast("string"), F.lit("null")))
    drawn = counts.withColumn("_cuts", few).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(resamples - 1))))
    drawn = drawn.withColumn("_d", F.md5(F.concat(name, F.lit(f"-{seed}-"), F.col("b").cast("string"))))
    uniform = [(F.conv(F.substring("_d", 8 * w + 1, 8), 16, 10).cast("double") + 0.5) / 2.0**32 for w in (0, 1)]
    times = drawn.withColumn("_t", poisson_draw(F.col("_n"), F.col("_cuts"), *uniform))
    return times.groupBy("b").agg(F.coalesce(F.try_divide(F.sum(F.col("_t") * F.col("_x")), F.sum(F.col("_t") * F.col("_y"))), F.lit(0.0)).alias("value"))


def bootstrap_rows(df: DataFrame, key: str, numerator: Column, denominator: Column, resamples: int = 1000, seed: int = 42) -> DataFrame:
    """Ratio-of-sums metric on ``resamples`` bootstrap samples, drawn row by row: columns b, value.

    Every row enters sample b Poisson(1) times, drawn from a hash of (key, seed, b): the distributed form of drawing n rows
    with replacement. Samples are summed map-side, so the shuffle carries ``resamples`` rows per task whatever the table size.
    """
    hashes = math.ceil(resamples / _WORDS_PER_HASH)
    rows = df.select(
        F.col(key).cast("string").alias("_k"), numerator.cast("double").alias("_x"), denominator.cast("double").alias("_y")
    )
    # a row costs as many hashes as there are samples by eight, so even a table of one file is dealt to many tasks
    rows = rows.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_k")
    digests = rows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(hashes - 1)))).select(
        "_i", "_x", "_y", F.md5(F.concat(F.col("_k"), F.lit(f"-{seed}-"), F.col("_i").cast("string"))).alias("_d")
    )
    draws = digests.select("_i", "_x", "_y", *[F.substring("_d", 4 * w + 1, 4).alias(f"d{w}") for w in range(_WORDS_PER_HASH)])
    times = {}
    for w in range(_WORDS_PER_HASH):
        drawn = F
        for k, cut in enumerate(_POISSON_CUTS):
            drawn = drawn.when(F.col(f"d{w}") < cut, F.lit(k))
        times[f"t{w}"] = drawn.otherwise(F.lit(len(_POISSON_CUTS)))
    counted = draws.select("_i", "_x", "_y", *[c.alias(n) for n, c in times.items()])
    sums = []
    for w in range(_WORDS_PER_HASH):
        sums += [F.sum(F.col(f"t{w}") * F.col("_x")).alias(f"x{w}"), F.sum(F.col(f"t{w}") * F.col("_y")).alias(f"y{w}")]
    wide = counted.groupBy("_i").agg(*sums)
    samples = wide.select(
        "_i",
        F.posexplode(F.array(*[F.struct(F.col(f"x{w}").alias("x"), F.col(f"y{w}").alias("y")) for w in range(_WORDS_PER_HASH)])).alias("w", "s"),
    )
    return samples.select(
        (F.col("_i") * _WORDS_PER_HASH + F.col("w")).cast("int").alias("b"),
        F.coalesce(F.try_divide(F.col("s.x"), F.col("s.y")), F.lit(0.0)).alias("value"),
    ).filter(F.col("b") < resamples)


def bootstrap_interval(samples: DataFrame, level: float = 0.95) -> DataFrame:
    """Percentile interval of bootstrap values (one row per resample, a few thousand at most)."""
    tail = (1 - level) / 2
    return samples.agg(
        F.avg("value").alias("mean"),
        F.percentile("value", F.lit(tail)).alias("lower"),
        F.percentile("value", F.lit(1 - tail)).alias("upper"),
    )


def _erfc(values: pd.Series) -> pd.Series:
    return values.map(math.erfc)


def mcnemar(df: DataFrame, truth: str, one: str, other: str) -> DataFrame:
    """Discordant counts, continuity-corrected statistic and p-value (chi-square, 1 df)."""
    a, b = F.col(one) == F.col(truth), F.col(other) == F.col(truth)
    counts = df.agg(F.count_if(a & ~b).alias("only_first"), F.count_if(~a & b).alias("only_second"))
    gap = (F.abs(F.col("only_first") - F.col("only_second")) - 1).cast("double")
    stat = F.coalesce(F.try_divide(gap * gap, (F.col("only_first") + F.col("only_second")).cast("double")), F.lit(0.0))
    with_stat = counts.withColumn("statistic", stat)
    return with_stat.withColumn("p_value", F.pandas_udf(_erfc, "double")(F.sqrt(F.col("statistic") / 2)))


def _two_sided(t: float, dof: float, steps: int = 2000) -> float:
    """P(|T| >= |t|): Simpson's rule on the density after t = sqrt(dof)*tan(a)."""
    if t is None or math.isnan(t) or dof < 1:
        return float("nan")
    top = math.atan(abs(t) / math.sqrt(dof))
    width = top / steps
    area = 1.0 + math.cos(top) ** (dof - 1)
    area += sum((4 if i % 2 else 2) * math.cos(i * width) ** (dof - 1) for i in range(1, steps))
    scale = math.exp(math.lgamma((dof + 1) / 2) - math.lgamma(dof / 2)) / math.sqrt(math.pi)
    return max(0.0, 1.0 - 2.0 * scale * area * width / 3)


def _t_tail(t: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([_two_sided(a, b) for a, b in zip(t, dof)])


def paired_t(folds: DataFrame, one: str, other: str, by: Sequence[str] = ()) -> DataFrame:
    """Paired t-test over folds (one row per fold), with mean difference and two-sided p."""
    d = F.col(one) - F.col(other)
    base = folds.groupBy(*by).agg(F.count(d).alias("folds"), F.avg(d).alias("mean_diff"), F.stddev_samp(d).alias("_s"))
    stat = F.try_divide(F.col("mean_diff"), F.col("_s") / F.sqrt(F.col("folds")))
    return (
        base.withColumn("t", stat)
        .withColumn("p_value", F.pandas_udf(_t_tail, "double")(F.col("t"), (F.col("folds") - 1).cast("double")))
        .drop("_s")
    )


def bonferroni(tests: DataFrame, p_value: str = "p_value", alpha: float = 0.05) -> DataFrame:
    """Adjusted threshold alpha/m and the decision for each of the m tests."""
    m = tests.agg(F.count(F.lit(1)).alias("m")).scalar()
    return tests.withColumn("threshold", F.lit(alpha) / m).withColumn("significant", F.col(p_value) < F.lit(alpha) / m)


def mean_std(folds: DataFrame, model: str, metric: str) -> DataFrame:
    return folds.groupBy(model).agg(F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"))
