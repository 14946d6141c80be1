import itertools
import random

from pyspark.sql import functions as F

from chartloom.operators import voting as V


def _rows(n, seed):
    rng = random.Random(seed)
    labels = ["bar_chart", "histogram", "line_chart", "unknown", "", "nan", None]
    return [
        (i, rng.choice(["bar_chart", "histogram", "line_chart", "unknown", None]), *[x for _ in V.VOTERS for x in (rng.choice(labels), rng.choice([0.0, 0.25, 0.5, 1.0, None]))])
        for i in range(n)
    ]


def _votes(spark, rows):
    cols = ", ".join(f"{v}_prediction string, {v}_confidence double" for v in V.VOTERS)
    zero = {c: F.lit(0.0) for c in ("histogram_score", "bar_chart_score")} | {c: F.lit(0) for c in ("yolo_bars", "yolo_line_segments")}
    return spark.createDataFrame(rows, f"id int, truth string, {cols}").withColumns(zero)


def _by_hand(row, weights):
    """Label and confidence of a vote that no correction changes; a missing confidence reads 1."""
    totals = {}
    for k, v in enumerate(V.VOTERS):
        label, conf = row[2 + 2 * k], row[3 + 2 * k]
        if label not in (None, "", "nan", "unknown"):
            totals[label] = totals.get(label, 0.0) + weights[v] * (1.0 if conf is None else conf)
    if not totals:
        return "unknown", 0.0
    best = max(totals, key=totals.get)
    return best, min(1.0, 0.5 + totals[best] - max([t for p, t in totals.items() if p != best], default=0.0))


def test_votes_and_search_agree_with_votes_by_hand(spark):
    rows = _rows(300, 3)
    df = _votes(spark, rows)
    for weights in (V.DEFAULT_WEIGHTS, V.FALLBACK_WEIGHTS, dict.fromkeys(V.VOTERS, 0.25)):
        for r in V.vote(df, weights).collect():
            label, conf = _by_hand(rows[r["id"]], weights)
            assert r["hybrid_prediction"] == label and abs(r["hybrid_confidence"] - conf) < 1e-12
    assert V.vote(df).columns == [*df.columns, "hybrid_prediction", "hybrid_confidence"]
    known = [r for r in rows if r[1] not in (None, "unknown")]
    found = {r["weight_id"]: r["accuracy"] for r in V.weight_search(df).collect()}
    assert found == {i: sum(_by_hand(r, w)[0] == r[1] for r in known) / len(known) for i, w in enumerate(V.weight_grid())}


def test_labels_are_compared_before_rows_fan_out(spark):
    plan = V.weight_search(_votes(spark, _rows(5, 1)))._jdf.queryExecution().optimizedPlan().toString()
    fanned, rows = plan.split("Generate", 1)
    assert not [v for v, k in itertools.product(V.VOTERS, ("p_", "_prediction")) if (k + v if k == "p_" else v + k) in fanned]
    assert "heuristic_prediction" in rows
