"""Confidence-weighted voting of four predictors and the search for its weights.

A vote needs only the row it belongs to, so it is a set of column expressions: no unpivot,
no shuffle. The weight search fans rows out over the weight list and aggregates map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions.labels import UNKNOWN
from chartloom.functions.text import clip

# Voters in first-seen order, default and fallback weights.
VOTERS = ["heuristic", "ml", "cnn", "yolo"]
DEFAULT_WEIGHTS = {"ml": 0.5, "cnn": 0.3, "yolo": 0.15, "heuristic": 0.05}
FINAL_WEIGHTS = {"ml": 0.45, "cnn": 0.35, "yolo": 0.15, "heuristic": 0.05}
FALLBACK_WEIGHTS = {"ml": 0.9, "cnn": 0.07, "yolo": 0.02, "heuristic": 0.01}
GRID = [0.1 + 0.1 * i for i in range(8)]


def disambiguate(df: DataFrame) -> DataFrame:
    """Add p_<voter>, c_<voter>: votes after the histogram/bar correction of weak ones."""
    corrected = {}
    hist_strong = F.col("histogram_score") > F.col("bar_chart_score") + 0.25
    bar_strong = F.col("bar_chart_score") > F.col("histogram_score") + 0.25
    many = (F.col("yolo_bars") >= 8) & (F.col("yolo_line_segments") < 6)
    few = F.col("yolo_bars").between(2, 7)
    for voter in VOTERS:
        pred, conf = F.col(f"{voter}_prediction"), F.col(f"{voter}_confidence")
        hist = F.when(hist_strong, 0.12).otherwise(0.0)
        bar = F.when(bar_strong, 0.12).otherwise(0.0)
        if voter in ("heuristic", "yolo"):
            hist = hist + F.when(many, 0.08).otherwise(0.0)
            bar = bar + F.when(few, 0.06).otherwise(0.0)
        limit = 0.6 if voter in ("ml", "cnn") else 0.85
        open_ = pred.isin("histogram", "bar_chart") & (conf < limit)
        corrected[f"p_{voter}"] = (
            F.when(open_ & (hist > bar), "histogram").when(open_ & (bar > hist), "bar_chart").otherwise(pred)
        )
        corrected[f"c_{voter}"] = clip(F.when(open_ & (hist != bar), conf + F.greatest(hist, bar)).otherwise(conf))
    return df.withColumns(corrected)


def _grouped(df: DataFrame) -> DataFrame:
    """Add _g_<voter>: the number of the first voter with the same label, null for a vote without a label. Labels are compared
    here, once for each row; what depends on the weights is arithmetic on numbers."""
    valid = {v: F.coalesce(~F.col(f"p_{v}").isin(UNKNOWN, "", "nan"), F.lit(False)) for v in VOTERS}
    flags = df.withColumns({f"_v_{v}": valid[v] for v in VOTERS})
    first = {}
    for v in VOTERS:
        same = [F.when(F.col(f"_v_{u}") & (F.col(f"p_{u}") == F.col(f"p_{v}")), i) for i, u in enumerate(VOTERS)]
        first[f"_g_{v}"] = F.when(F.col(f"_v_{v}"), F.coalesce(*same))
    return flags.withColumns(first).drop(*[f"_v_{v}" for v in VOTERS])


def _weighed(df: DataFrame, weights: dict[str, Column]) -> DataFrame:
    """Add _t_<voter>: the weighted confidences of its label's voters, null without a label; _m: the largest."""
    scored = df.withColumns({f"_s_{v}": weights[v] * F.col(f"c_{v}") for v in VOTERS})
    totals = {}
    for v in VOTERS:
        same = [F.when(F.col(f"_g_{u}") == F.col(f"_g_{v}"), F.col(f"_s_{u}")).otherwise(0.0) for u in VOTERS]
        totals[f"_t_{v}"] = F.when(F.col(f"_g_{v}").isNotNull(), same[0] + same[1] + same[2] + same[3])
    return scored.withColumns(totals).withColumn("_m", F.greatest(*totals))


def _of_winner(prefix: str) -> Column:
    """A column of the first voter with the largest total, null where no vote has a label."""
    first, *rest = VOTERS
    out = F.when(F.col(f"_t_{first}") == F.col("_m"), F.col(f"{prefix}{first}"))
    for v in rest:
        out = out.when(F.col(f"_t_{v}") == F.col("_m"), F.col(f"{prefix}{v}"))
    return out


def vote(df: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Add hybrid_prediction and hybrid_confidence."""
    weights = weights or DEFAULT_WEIGHTS
    weighed = _weighed(_grouped(disambiguate(df)), {v: F.lit(float(weights.get(v, 0.0))) for v in VOTERS})
    named = weighed.withColumns({"_g": _of_winner("_g_"), "hybrid_prediction": F.coalesce(_of_winner("p_"), F.lit(UNKNOWN))})
    second = F.greatest(*[F.when(F.col(f"_g_{v}") != F.col("_g"), F.col(f"_t_{v}")) for v in VOTERS])
    conf = F.when(F.col("_m").isNull(), 0.0).otherwise(clip(F.lit(0.5) + (F.col("_m") - F.coalesce(second, F.lit(0.0)))))
    out = named.withColumn("hybrid_confidence", conf)
    return out.drop(*[f"{k}_{v}" for k in ("p", "c", "_g", "_s", "_t") for v in VOTERS], "_g", "_m")


def weight_grid() -> list[dict[str, float]]:
    """All grid weights that sum to 1, ml slowest and heuristic fastest."""
    return [
        {"ml": m, "cnn": c, "yolo": y, "heuristic": h}
        for m in GRID for c in GRID for y in GRID for h in GRID
        if abs(m + c + y + h - 1.0) <= 1e-6
    ]


def weight_search(df: DataFrame, truth: str = "truth") -> DataFrame:
    """Accuracy of every grid weighting over rows with a known truth."""
    grid = F.array(
        *[F.struct(F.lit(i).alias("weight_id"), *[F.lit(w[v]).alias(v) for v in VOTERS]) for i, w in enumerate(weight_grid())]
    )
    known = _grouped(disambiguate(df.filter(F.col(truth) != UNKNOWN)))
    right = [F.coalesce(F.col(f"p_{v}") == F.col(truth), F.lit(False)).cast("int").alias(f"_r_{v}") for v in VOTERS]
    numbers = known.select(*right, *[f"{k}_{v}" for k in ("c", "_g") for v in VOTERS])
    fanned = numbers.withColumn("_w", F.explode(grid)).select(*numbers.columns, "_w.*")
    weighed = _weighed(fanned, {v: F.col(v) for v in VOTERS})
    scored = weighed.select("weight_id", *VOTERS, F.coalesce(_of_winner("_r_"), F.lit(0)).cast("bigint").alias("_hit"))
    return scored.groupBy("weight_id", *VOTERS).agg((F.sum("_hit") / F.count(F.lit(1))).alias("accuracy"))


def pick_weights(search: DataFrame, target: float = 0.90) -> DataFrame:
    """First weighting that reaches the target, else the best one (earliest on ties); one row."""
    reached = F.col("accuracy") >= target
    order = F.struct(
        reached.cast("int").alias("r"), F.when(reached, 0.0).otherwise(F.col("accuracy")).alias("a"), (-F.col("weight_id")).alias("i")
    )
    chosen = F.max_by(F.struct("weight_id", *VOTERS, "accuracy"), order)
    return search.agg(chosen.alias("w")).select("w.*")


def best_of(df: DataFrame, target: float = 0.90, truth: str = "truth") -> DataFrame:
    """Vote with the searched weights, or with the fallback weights if those are more accurate."""
    row = pick_weights(weight_search(df, truth), target).first()
    fallback = vote(df, FALLBACK_WEIGHTS)
    known = F.col(truth) != UNKNOWN
    score = fallback.agg(F.avg(F.when(known, (F.col("hybrid_prediction") == F.col(truth)).cast("double")))).first()[0] or 0.0
    if row["accuracy"] is None or score > row["accuracy"]:
        return fallback.withColumn("weights", F.lit("fallback"))
    return vote(df, {v: row[v] for v in VOTERS}).withColumn("weights", F.lit("searched"))


def probability_vote(df: DataFrame, maps: dict[str, str], weights: dict[str, float]) -> DataFrame:
    """Sum of weight x confidence per class over full class maps: id columns kept, class and score."""
    def weighted(column: str, weight: float) -> Column:
        return F.transform(
            F.map_entries(column), lambda e: F.struct(e["key"].alias("class"), (e["value"] * weight).alias("s"))
        )

    entries = F.concat(*[weighted(column, weights[name]) for name, column in maps.items()])
    keep = [c for c in df.columns if c not in maps.values()]
    # row by row: equal rows stay two rows, and nothing is shuffled
    scored = F.transform(
        F.array_distinct(F.transform(F.col("_e"), lambda e: e["class"])),
        lambda c: F.struct(
            c.alias("class"),
            F.aggregate(F.filter(F.col("_e"), lambda e: e["class"] == c), F.lit(0.0), lambda t, e: t + e["s"]).alias("score"),
        ),
    )
    return df.withColumn("_e", entries).select(*keep, F.explode(scored).alias("e")).select(*keep, F.col("e.class").alias("class"), F.col("e.score").alias("score"))


def top_two_margin(scores: Column) -> Column:
    """Largest minus second largest score of an array; a single score counts as it is."""
    ordered = F.sort_array(scores, asc=False)
    return F.get(ordered, F.lit(0)) - F.coalesce(F.get(ordered, F.lit(1)), F.lit(0.0))
