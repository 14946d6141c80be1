"""Queries on rule scores, voting and templated answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.functions.labels import STANDARD_LABELS
from chartloom.operators import metrics as M
from chartloom.operators import rules as R
from chartloom.operators import voting as V
from chartloom.plans.q_sampling import hash_sql
from chartloom.plans.registry import query
from chartloom.plans.views import oracle, table, view

_MOST = "greatest(rectangle_count, s_bars)"
_SP = "bar_spacing_ratio"
GRADED_SQL = f"""WITH g AS (SELECT *, (greatest(bin_adjacency, g_bin_adjacency_ratio) + greatest(g_width_uniformity, bin_continuity)
 + CASE WHEN {_SP} < 0.1 THEN 1 WHEN {_SP} < 0.2 THEN 0.5 ELSE 0 END + CASE WHEN {_MOST} > 8 THEN 1 WHEN {_MOST} > 5 THEN 0.5 ELSE 0 END) / 4 AS histogram_score,
 CAST(CASE WHEN {_SP} > 0.15 THEN 1 WHEN {_SP} > 0.05 THEN 0.5 ELSE 0 END
 + CASE WHEN rectangle_count BETWEEN 2 AND 12 OR s_bars BETWEEN 2 AND 12 OR g_bar_count BETWEEN 2 AND 12 THEN 1 ELSE 0 END
 + CASE WHEN bar_height_variance > 100 THEN 0.5 ELSE 0 END AS DOUBLE) / 3 AS bar_score FROM v_rule_inputs)
"""


def _score_sql(label: str, extra: str = "") -> str:
    terms = " + ".join(f"CASE WHEN {cond} THEN CAST({w} AS DOUBLE) ELSE 0 END" for w, cond in R.RULES[label])
    return f"{terms}{extra} AS s_{label}"


CLASSIFY_SQL = (
    GRADED_SQL
    + ", s AS (SELECT *, "
    + ", ".join(
        _score_sql(c, {"bar_chart": " + bar_score * 2.0", "histogram": " + histogram_score * 2.8"}.get(c, "")) for c in R.RULES
    )
    + """ FROM g), t AS (SELECT *, greatest(s_bar_chart, s_histogram, s_scatter_plot, s_pie_chart, s_line_chart) AS top FROM s)
SELECT id, s_bar_chart AS score_bar_chart, s_histogram AS score_histogram, s_scatter_plot AS score_scatter_plot, s_pie_chart AS score_pie_chart, s_line_chart AS score_line_chart,
 CASE WHEN top < 1 THEN CASE WHEN rectangle_count >= 2 THEN 'bar_chart' WHEN circle_count >= 10 THEN 'scatter_plot' WHEN circle_count >= 1 THEN 'pie_chart'
 WHEN line_continuity_score > 0.03 THEN 'line_chart' ELSE 'bar_chart' END
 WHEN s_bar_chart = top THEN 'bar_chart' WHEN s_histogram = top THEN 'histogram' WHEN s_scatter_plot = top THEN 'scatter_plot' WHEN s_pie_chart = top THEN 'pie_chart' ELSE 'line_chart' END AS chart_type
FROM t"""
)


@query("rule_classify", "R1", sql=oracle("rule_inputs", CLASSIFY_SQL))
def _classify(spark, sf):
    return R.classify(view(spark, sf, "rule_inputs")).select("id", *[f"score_{c}" for c in R.RULES], "chart_type")


@query("graded_scores", "R2", sql=oracle("rule_inputs", GRADED_SQL + "SELECT id, histogram_score, bar_score FROM g"))
def _graded(spark, sf):
    return R.graded_scores(R.with_defaults(view(spark, sf, "rule_inputs"))).select("id", "histogram_score", "bar_score")


def _counts(spark, sf):
    return view(spark, sf, "rule_inputs").select(
        "id", F.col("s_bars").alias("bars"), F.col("s_lines").alias("line_segments"), F.col("s_points").alias("scatter_points"),
        F.col("s_pie_slices").alias("pie_slices"), F.col("g_line_count").alias("axes"), F.col("vertex_count").alias("bins"),
        F.col("bin_adjacency").alias("bias"),
    )


@query(
    "structure_classify",
    "R3",
    "W10",
    sql=oracle(
        "rule_inputs",
        """WITH s AS (SELECT id, least(3.0, s_bars * 0.5) + least(1.0, g_line_count * 0.2) AS a, least(4.0, s_bars * 0.6) + bin_adjacency AS b,
 least(4.0, s_lines * 0.5) + CASE WHEN s_bars < 3 THEN 1 ELSE 0 END AS c, least(4.0, s_points * 0.2) + CASE WHEN s_lines < 6 THEN 1 ELSE 0 END AS d,
 least(5.0, s_pie_slices * 0.7) + CASE WHEN s_bars < 2 THEN 0.5 ELSE 0 END AS e FROM v_rule_inputs),
t AS (SELECT *, list_reverse_sort([a, b, c, d, e]) AS l FROM s)
SELECT id, CASE l[1] WHEN a THEN 'bar_chart' WHEN b THEN 'histogram' WHEN c THEN 'line_chart' WHEN d THEN 'scatter_plot' ELSE 'pie_chart' END AS structure_prediction,
 least(0.99, 0.5 + (l[1] - l[2]) / 5.0) AS structure_confidence FROM t""",
    ),
)
def _structure(spark, sf):
    return R.structure_classify(_counts(spark, sf), F.col("bias")).select("id", "structure_prediction", "structure_confidence")


@query(
    "baseline_predictions",
    "R13",
    sql=oracle(
        "rule_inputs",
        f"""SELECT id, CASE WHEN s_bars > 0 AND s_lines = 0 THEN 'bar_chart' WHEN s_lines > 0 AND s_bars = 0 THEN 'line_chart' WHEN s_pie_slices > 0 THEN 'pie_chart'
 WHEN s_points > 0 AND s_lines = 0 THEN 'scatter_plot' WHEN vertex_count > 0 THEN 'histogram' ELSE 'unknown' END AS by_count,
 ['bar_chart','histogram','line_chart','scatter_plot','pie_chart'][{hash_sql('id')} % 5 + 1] AS by_chance FROM v_rule_inputs""",
    ),
)
def _baselines(spark, sf):
    return _counts(spark, sf).select("id", R.count_baseline().alias("by_count"), R.random_baseline("id").alias("by_chance"))


@query(
    "minmax_scaling",
    "W5",
    sql=oracle(
        "blend_inputs",
        """SELECT id, (feature_bar_count - min(feature_bar_count) OVER ()) / (max(feature_bar_count) OVER () - min(feature_bar_count) OVER ()) AS bars,
 (numeric_ratio - min(numeric_ratio) OVER ()) / (max(numeric_ratio) OVER () - min(numeric_ratio) OVER ()) AS ratio, CAST(0 AS DOUBLE) AS constant FROM v_blend_inputs""",
    ),
)
def _minmax(spark, sf):
    df = view(spark, sf, "blend_inputs").withColumn("five", F.lit(5.0))
    return R.minmax(df, {"bars": "feature_bar_count", "ratio": "numeric_ratio", "constant": "five"}).select("id", "bars", "ratio", "constant")


def _scaled(name: str) -> str:
    c = f"feature_{name}"
    return f"({c} - min({c}) OVER ()) / (max({c}) OVER () - min({c}) OVER ()) AS {name}"


_NAMES = [
    "bar_count", "bin_adjacency_ratio", "width_uniformity", "bar_spacing_variance", "bar_height_variance", "bar_gap_ratio",
    "histogram_uniformity_score", "axis_numeric_density", "axis_confidence",
]
SCALED_SQL = "WITH n AS (SELECT id, heuristic_prediction AS p, numeric_ratio, category_ratio, " + ", ".join(map(_scaled, _NAMES)) + " FROM v_blend_inputs)\n"


def _clip(x: str) -> str:
    return f"greatest(0, least(1, {x}))"


@query(
    "histogram_disambiguation",
    "R4",
    sql=oracle(
        "blend_inputs",
        SCALED_SQL
        + f""", c AS (SELECT id, p, {_clip('0.30 * ' + _clip('bin_adjacency_ratio * 0.5 + (1.0 - bar_gap_ratio) * 0.5') + ' + 0.28 * ' + _clip('0.6 * width_uniformity + 0.4 * histogram_uniformity_score') + ' + 0.20 * numeric_ratio + 0.12 * axis_numeric_density + 0.10 * (1.0 - bar_spacing_variance)')} AS h,
 {_clip('0.30 * bar_count + 0.25 * bar_spacing_variance + 0.20 * bar_gap_ratio + 0.15 * category_ratio + 0.10 * (1.0 - axis_numeric_density)')} AS b FROM n)
SELECT id, round(h, 9) AS histogram_confidence, round(b, 9) AS bar_chart_confidence, CASE WHEN p IN ('histogram','bar_chart') AND h >= b + 0.08 THEN 'histogram'
 WHEN p IN ('histogram','bar_chart') AND b > h + 0.08 THEN 'bar_chart' ELSE p END AS heuristic_prediction FROM c""",
    ),
)
def _disambiguation(spark, sf):
    return R.disambiguate_histograms(view(spark, sf, "blend_inputs")).select(
        "id", F.round("histogram_confidence", 9).alias("histogram_confidence"), F.round("bar_chart_confidence", 9).alias("bar_chart_confidence"),
        "heuristic_prediction",
    )


@query(
    "blended_scores",
    "R5",
    sql=oracle(
        "blend_inputs",
        SCALED_SQL
        + f"""SELECT id, round({_clip('0.35 * bin_adjacency_ratio + 0.25 * width_uniformity + 0.20 * (1.0 - ' + _clip('bar_spacing_variance') + ') + 0.20 * bar_count')}, 9) AS histogram_score,
 round({_clip('0.35 * bar_spacing_variance + 0.25 * bar_height_variance + 0.20 * ' + _clip('1.0 - abs(bar_count - 0.45)') + ' + 0.20 * axis_confidence')}, 9) AS bar_chart_score FROM n""",
    ),
)
def _blended(spark, sf):
    return R.blended_scores(view(spark, sf, "blend_inputs")).select(
        "id", F.round("histogram_score", 9).alias("histogram_score"), F.round("bar_chart_score", 9).alias("bar_chart_score")
    )


@query(
    "structural_features",
    "R6",
    sql=oracle(
        "blend_inputs",
        """SELECT id, feature_bar_count AS struct_bar_count, CAST(0 AS DOUBLE) AS struct_vertex_count, CAST(0 AS DOUBLE) AS norm_vertex_count,
 feature_bar_gap_ratio / 1.0 AS struct_bar_gap_ratio, (slice_angle_variance - min(slice_angle_variance) OVER ()) / (max(slice_angle_variance) OVER () - min(slice_angle_variance) OVER ()) AS norm_slice_angle_variance,
 (feature_bar_gap_ratio - min(feature_bar_gap_ratio) OVER ()) / (max(feature_bar_gap_ratio) OVER () - min(feature_bar_gap_ratio) OVER ()) AS norm_bar_gap_ratio FROM v_blend_inputs""",
    ),
)
def _structural(spark, sf):
    return R.structural_features(view(spark, sf, "blend_inputs")).select(
        "id", "struct_bar_count", "struct_vertex_count", "norm_vertex_count", "struct_bar_gap_ratio", "norm_slice_angle_variance", "norm_bar_gap_ratio"
    )


def _votes_sql() -> str:
    parts = []
    for v in V.VOTERS:
        own = v in ("heuristic", "yolo")
        hist = "CASE WHEN histogram_score > bar_chart_score + 0.25 THEN CAST(0.12 AS DOUBLE) ELSE 0 END"
        bar = "CASE WHEN bar_chart_score > histogram_score + 0.25 THEN CAST(0.12 AS DOUBLE) ELSE 0 END"
        if own:
            hist += " + CASE WHEN yolo_bars >= 8 AND yolo_line_segments < 6 THEN CAST(0.08 AS DOUBLE) ELSE 0 END"
            bar += " + CASE WHEN yolo_bars BETWEEN 2 AND 7 THEN CAST(0.06 AS DOUBLE) ELSE 0 END"
        parts.append(
            f"SELECT id, truth, '{v}' AS voter, {V.VOTERS.index(v)} AS o, {v}_prediction AS p, {v}_confidence AS c, {hist} AS hb, {bar} AS bb,"
            f" {v}_prediction IN ('histogram','bar_chart') AND {v}_confidence < {0.85 if own else 0.6} AS open FROM v_votes"
        )
    return f"""WITH raw AS ({' UNION ALL '.join(parts)}),
d AS (SELECT id, truth, voter, o, CASE WHEN open AND hb > bb THEN 'histogram' WHEN open AND bb > hb THEN 'bar_chart' ELSE p END AS p,
 greatest(0, least(1, CASE WHEN open AND hb <> bb THEN c + greatest(hb, bb) ELSE c END)) AS c FROM raw)
"""


def _tally_sql(weights: str, extra: str = "") -> str:
    """Weighted tally; ``weights`` is SQL for the weight of a voter."""
    g = f"{extra}, " if extra else ""
    return f""", y AS (SELECT id, truth, {g}p, min(o) AS o, sum({weights} * c ORDER BY o) AS t FROM d{', w' if extra else ''} WHERE p NOT IN ('unknown', '', 'nan') GROUP BY id, truth, {g}p),
z AS (SELECT *, row_number() OVER (PARTITION BY id{', ' + extra if extra else ''} ORDER BY t DESC, o) AS r, lead(t) OVER (PARTITION BY id{', ' + extra if extra else ''} ORDER BY t DESC, o) AS second FROM y)
"""


def _weights_sql(weights: dict[str, float]) -> str:
    return "CASE voter " + " ".join(f"WHEN '{k}' THEN CAST({w!r} AS DOUBLE)" for k, w in weights.items()) + " END"


@query("disambiguated_votes", "R7", sql=oracle("votes", _votes_sql() + "SELECT id, voter, p AS prediction, c AS confidence FROM d"))
def _disambiguated(spark, sf):
    wide = V.disambiguate(view(spark, sf, "votes"))
    entries = F.array(
        *[F.struct(F.lit(v).alias("voter"), F.col(f"p_{v}").alias("prediction"), F.col(f"c_{v}").alias("confidence")) for v in V.VOTERS]
    )
    return wide.select("id", F.explode(entries).alias("e")).select("id", "e.*")


@query(
    "hybrid_vote",
    "R8",
    sql=oracle(
        "votes",
        _votes_sql()
        + _tally_sql(_weights_sql(V.DEFAULT_WEIGHTS))
        + "SELECT v.id, coalesce(z.p, 'unknown') AS hybrid_prediction, coalesce(round(greatest(0, least(1, 0.5 + (t - coalesce(second, 0)))), 9), 0) AS hybrid_confidence FROM v_votes v LEFT JOIN z ON z.id = v.id AND r = 1",
    ),
)
def _vote(spark, sf):
    return V.vote(view(spark, sf, "votes")).select("id", "hybrid_prediction", F.round("hybrid_confidence", 9).alias("hybrid_confidence"))


def flagship(spark, sf):
    """Vote of the four predictors with the final weights, then its classification report."""
    voted = M.labelled(V.vote(view(spark, sf, "votes"), V.FINAL_WEIGHTS))
    report = M.classification_report(voted, "truth", "hybrid_prediction")
    return report.select("label", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(
    "hybrid_vote_report",
    "R8",
    "A12",
    sql=oracle(
        "votes",
        _votes_sql()
        + _tally_sql(_weights_sql(V.FINAL_WEIGHTS))
        + """, e AS (SELECT v.truth, coalesce(z.p, 'unknown') AS pred FROM v_votes v LEFT JOIN z ON z.id = v.id AND r = 1 WHERE v.truth <> 'unknown'),
ts AS (SELECT truth AS label, count(*) AS support, count(*) FILTER (truth = pred) AS tp FROM e GROUP BY 1), ps AS (SELECT pred AS label, count(*) AS predicted FROM e GROUP BY 1),
m AS (SELECT coalesce(ts.label, ps.label) AS label, coalesce(support, 0) AS support, coalesce(tp, 0) AS tp, CASE WHEN coalesce(predicted, 0) = 0 THEN 0 ELSE coalesce(tp, 0) / predicted END AS precision,
 CASE WHEN coalesce(support, 0) = 0 THEN 0 ELSE tp / support END AS recall, 2 * coalesce(tp, 0) / (coalesce(predicted, 0) + coalesce(support, 0)) AS f1 FROM ts FULL JOIN ps ON ts.label = ps.label),
r AS (SELECT label, precision, recall, f1, support FROM m
UNION ALL SELECT 'accuracy', a, a, a, s FROM (SELECT sum(tp) / sum(support) AS a, sum(support) AS s FROM m) q
UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM m
UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM m)
SELECT label, round(precision, 9) AS precision, round(recall, 9) AS recall, round(f1, 9) AS f1, CAST(support AS BIGINT) AS support FROM r""",
    ),
)
def _flagship(spark, sf):
    return flagship(spark, sf)


_GRID_ROWS = ", ".join(
    f"({i}, " + ", ".join(f"CAST({w[v]!r} AS DOUBLE)" for v in V.VOTERS) + ")" for i, w in enumerate(V.weight_grid())
)
SEARCH_SQL = (
    _votes_sql()
    + f", w AS (SELECT * FROM (VALUES {_GRID_ROWS}) q(weight_id, heuristic, ml, cnn, yolo))"
    + _tally_sql("CASE voter WHEN 'heuristic' THEN heuristic WHEN 'ml' THEN ml WHEN 'cnn' THEN cnn ELSE yolo END", "weight_id")
    + """, a AS (SELECT weight_id, count(*) FILTER (r = 1 AND p = truth) AS hits FROM z WHERE truth <> 'unknown' GROUP BY 1),
s AS (SELECT weight_id, hits / (SELECT count(*) FROM v_votes WHERE truth <> 'unknown') AS accuracy FROM a)
"""
)


@query("weight_search", "R9", sql=oracle("votes", SEARCH_SQL + "SELECT weight_id, accuracy FROM s"))
def _search(spark, sf):
    return V.weight_search(view(spark, sf, "votes")).select("weight_id", "accuracy")


@query(
    "picked_weights",
    "R9",
    "R10",
    sql=oracle(
        "votes",
        SEARCH_SQL
        + "SELECT weight_id, accuracy FROM s ORDER BY CASE WHEN accuracy >= 0.4 THEN 1 ELSE 0 END DESC, CASE WHEN accuracy >= 0.4 THEN 0 ELSE accuracy END DESC, weight_id LIMIT 1",
    ),
)
def _picked(spark, sf):
    return V.pick_weights(V.weight_search(view(spark, sf, "votes")), 0.4).select("weight_id", "accuracy")


@query("best_weights_vote", "R10")
def _best_of(spark, sf):
    return V.best_of(view(spark, sf, "votes")).select("id", "hybrid_prediction", "hybrid_confidence", "weights")


@query(
    "probability_vote",
    "A47",
    sql=oracle(
        "votes",
        " UNION ALL ".join(
            f"SELECT id, '{c}' AS class, round(0.6 * CASE WHEN ml_prediction = '{c}' THEN ml_confidence ELSE (1 - ml_confidence) / 4 END + 0.4 * CASE WHEN yolo_prediction = '{c}' THEN yolo_confidence ELSE (1 - yolo_confidence) / 4 END, 9) AS score FROM v_votes"
            for c in STANDARD_LABELS
        ),
    ),
)
def _probability(spark, sf):
    def spread(v):
        pairs = []
        for c in STANDARD_LABELS:
            conf = F.col(f"{v}_confidence")
            pairs += [F.lit(c), F.when(F.col(f"{v}_prediction") == c, conf).otherwise((1 - conf) / 4)]
        return F.create_map(*pairs)

    df = view(spark, sf, "votes").select("id", spread("ml").alias("ml"), spread("yolo").alias("yolo"))
    out = V.probability_vote(df, {"ml": "ml", "yolo": "yolo"}, {"ml": 0.6, "yolo": 0.4})
    return out.select("id", "class", F.round("score", 9).alias("score"))


@query(
    "vote_margin",
    "W10",
    sql=oracle("votes", "SELECT id, l[1] - l[2] AS margin FROM (SELECT id, list_reverse_sort([heuristic_confidence, ml_confidence, cnn_confidence, yolo_confidence]) AS l FROM v_votes) q"),
)
def _margin(spark, sf):
    return view(spark, sf, "votes").select("id", V.top_two_margin(F.array(*[f"{v}_confidence" for v in V.VOTERS])).alias("margin"))


@query(
    "templated_answers",
    "R12",
    sql=oracle(
        "series",
        """WITH s AS (SELECT c_custkey AS image_id, label, pos, value, CASE WHEN c_custkey % 2 = 0 THEN 'bar_chart' ELSE 'line_chart' END AS chart_type FROM customer LEFT JOIN v_series ON image_id = c_custkey),
a AS (SELECT image_id, chart_type, arg_min(value, pos) AS f, arg_max(value, pos) AS l, count(value) AS n FROM s GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY value DESC, pos) AS hi, row_number() OVER (PARTITION BY image_id ORDER BY value, pos) AS lo FROM s WHERE value IS NOT NULL),
t AS (SELECT a.*, h.label AS hl, h.value AS hv, k.label AS kl FROM a LEFT JOIN r h ON h.image_id = a.image_id AND h.hi = 1 LEFT JOIN r k ON k.image_id = a.image_id AND k.lo = 1),
q AS (SELECT image_id, CASE WHEN n > 0 THEN 'The ' || chart_type || ' indicates ' || CASE WHEN l > f THEN 'an increasing trend' WHEN l < f THEN 'a decreasing trend' ELSE 'a mostly stable trend' END || '.' ELSE 'Insufficient numeric extraction to infer a reliable trend.' END AS trend,
 CASE WHEN n > 0 THEN hl || ' has the highest value at ' || printf('%.2f', hv) || '.' ELSE 'Unable to determine from extracted values.' END AS highest,
 CASE WHEN n > 0 THEN hl || ' has the largest share, while ' || kl || ' is the smallest.' ELSE 'Unable to determine from extracted values.' END AS share FROM t)
SELECT *, trend || ' ' || highest || ' ' || share AS narrative FROM q""",
    ),
)
def _answers(spark, sf):
    # one chart per customer; those without orders have no values
    charts = table(spark, sf, "customer").select(F.col("c_custkey").alias("image_id"))
    kind = F.when(F.col("image_id") % 2 == 0, "bar_chart").otherwise("line_chart").alias("chart_type")
    return R.answers(charts.join(view(spark, sf, "series"), "image_id", "left").select("image_id", "label", "pos", "value", kind))
