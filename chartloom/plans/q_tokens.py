"""Queries on text tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.functions import text as T
from chartloom.functions.boxes import iou
from chartloom.operators import metrics as M
from chartloom.operators import tokens as K
from chartloom.plans.registry import query
from chartloom.plans.views import oracle, table, view


def _engines(spark, sf):
    tokens = view(spark, sf, "tokens")
    return tokens.filter(F.col("engine") == "easyocr"), tokens.filter(F.col("engine") == "paddleocr")


@query(
    "numeric_token_fix",
    "F2",
    sql=oracle(
        "tokens",
        """SELECT image_id, engine, pos, CASE WHEN regexp_full_match(text, '[0-9.,:%$OoIlSB+-]+') THEN translate(text, 'OoIlSB', '001158') ELSE text END AS text FROM v_tokens""",
    ),
)
def _fix(spark, sf):
    return view(spark, sf, "tokens").select("image_id", "engine", "pos", T.correct_numeric_token(F.col("text")).alias("text"))


@query(
    "clean_text_list",
    "F3",
    sql=r"""WITH w AS (SELECT doc_id, unnest(l) AS t, generate_subscripts(l, 1) AS i FROM (SELECT doc_id, string_split(text, ' ') AS l FROM documents) a),
c AS (SELECT doc_id, i, regexp_replace(regexp_replace(trim(t, chr(10)), '[ \n]+', ' ', 'g'), '[^ -~]', '', 'g') AS t FROM w),
f AS (SELECT doc_id, i, t, row_number() OVER (PARTITION BY doc_id, lower(t) ORDER BY i) AS r FROM c WHERE t <> '')
SELECT d.doc_id, coalesce(string_agg(t, '|' ORDER BY i), '') AS cleaned FROM documents d LEFT JOIN f ON f.doc_id = d.doc_id AND r = 1 GROUP BY 1""",
)
def _clean(spark, sf):
    words = F.split("text", " ")
    return table(spark, sf, "documents").select("doc_id", F.array_join(T.clean_text_list(words), "|").alias("cleaned"))


@query(
    "extract_numbers",
    "F4",
    sql=r"""SELECT doc_id, len(l) AS n, list_max(list_transform(l, lambda t: CAST(t AS DOUBLE))) AS largest, list_min(list_transform(l, lambda t: CAST(t AS DOUBLE))) AS smallest
FROM (SELECT doc_id, regexp_extract_all(text, '([-+]?\d*\.?\d+)', 1) AS l FROM documents) q""",
)
def _numbers(spark, sf):
    df = table(spark, sf, "documents").select("doc_id", T.extract_numbers(F.col("text")).alias("l"))
    return df.select(
        "doc_id", F.size("l").cast("bigint").alias("n"), F.array_max("l").alias("largest"), F.array_min("l").alias("smallest")
    )


@query(
    "ellipsize",
    "F12",
    sql=r"""SELECT doc_id, CASE WHEN length(t) > 160 THEN substring(t, 1, 157) || '...' ELSE t END AS text
FROM (SELECT doc_id, regexp_replace(trim(text, ' ' || chr(10)), '[ \n]+', ' ', 'g') AS t FROM documents) q""",
)
def _ellipsize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", T.ellipsize(F.col("text"), 160).alias("text"))


@query(
    "token_character_tests",
    "F15",
    sql=oracle(
        "tokens",
        r"""SELECT image_id, engine, count(*) FILTER (regexp_matches(text, '\d')) AS with_digit, count(*) FILTER (regexp_matches(text, '\p{L}')) AS with_letter FROM v_tokens GROUP BY 1, 2""",
    ),
)
def _tests(spark, sf):
    return view(spark, sf, "tokens").groupBy("image_id", "engine").agg(
        F.count_if(T.has_digit(F.col("text"))).alias("with_digit"), F.count_if(T.has_letter(F.col("text"))).alias("with_letter")
    )


@query(
    "box_iou",
    "F6",
    sql=oracle(
        "elements",
        """SELECT image_id, seq, CASE WHEN i > 0 THEN i / (greatest(1, w * h) + 60000 - i) ELSE 0 END AS iou FROM (
 SELECT *, greatest(0, least(x + w, 400) - greatest(x, 100)) * greatest(0, least(y + h, 300) - greatest(y, 100)) AS i FROM v_elements) q""",
    ),
)
def _iou(spark, sf):
    x, y = F.col("x"), F.col("y")
    box = [x, y, x + F.col("w"), y + F.col("h")]
    plot = [F.lit(v) for v in (100, 100, 400, 300)]
    return view(spark, sf, "elements").select("image_id", "seq", iou(box, plot).alias("iou"))


MATCH_SQL = """WITH e AS (SELECT *, lower(text) AS norm FROM v_tokens WHERE engine = 'easyocr'), p AS (SELECT *, lower(text) AS norm FROM v_tokens WHERE engine = 'paddleocr'),
m AS (SELECT e.image_id, e.pos, p.pos AS r_pos, e.norm = p.norm AND e.norm <> '' AS same,
 greatest(0, least(e.x2, p.x2) - greatest(e.x1, p.x1)) * greatest(0, least(e.y2, p.y2) - greatest(e.y1, p.y1)) AS i,
 (e.x2 - e.x1) * (e.y2 - e.y1) AS a, (p.x2 - p.x1) * (p.y2 - p.y1) AS b FROM e JOIN p ON e.image_id = p.image_id)
"""


@query(
    "token_matches",
    "J8",
    sql=oracle(
        "tokens",
        MATCH_SQL
        + """SELECT e.image_id, e.engine, e.pos, count(*) FILTER (same) AS equal_text, count(*) FILTER (NOT same AND i > 0 AND i / (greatest(1, a) + greatest(1, b) - i) >= 0.3) AS overlapping
FROM e LEFT JOIN m ON m.image_id = e.image_id AND m.pos = e.pos GROUP BY 1, 2, 3""",
    ),
)
def _matches(spark, sf):
    return K.count_matches(*_engines(spark, sf))


FUSED_SQL = oracle(
    "tokens",
    r"""WITH RECURSIVE e AS (SELECT *, lower(text) AS norm, row_number() OVER (PARTITION BY image_id ORDER BY pos) AS k FROM v_tokens WHERE engine = 'easyocr'),
p AS (SELECT *, lower(text) AS norm FROM v_tokens WHERE engine = 'paddleocr'),
m AS (SELECT image_id, k, r_pos, confidence FROM (SELECT e.image_id, e.k, p.pos AS r_pos, p.confidence, e.norm = p.norm AND e.norm <> '' AS same,
 greatest(0, least(e.x2, p.x2) - greatest(e.x1, p.x1)) * greatest(0, least(e.y2, p.y2) - greatest(e.y1, p.y1)) AS i,
 greatest(1, (e.x2 - e.x1) * (e.y2 - e.y1)) AS a, greatest(1, (p.x2 - p.x1) * (p.y2 - p.y1)) AS b FROM e JOIN p ON e.image_id = p.image_id) q
 WHERE same OR (i > 0 AND i / (a + b - i) >= 0.3)),
c AS MATERIALIZED (SELECT e.image_id, e.k, e.pos AS l_pos, list(m.r_pos ORDER BY m.confidence DESC, m.r_pos) FILTER (m.r_pos IS NOT NULL) AS wishes
 FROM e LEFT JOIN m ON m.image_id = e.image_id AND m.k = e.k GROUP BY 1, 2, 3),
s AS (SELECT image_id, CAST(0 AS BIGINT) AS k, CAST(NULL AS BIGINT) AS l_pos, CAST(NULL AS BIGINT) AS r_pos, CAST([] AS BIGINT[]) AS used FROM e GROUP BY 1
 UNION ALL SELECT image_id, k, l_pos, r_pos, CASE WHEN r_pos IS NULL THEN used ELSE list_append(used, r_pos) END FROM (
  SELECT c.image_id, c.k, c.l_pos, s.used, list_filter(coalesce(c.wishes, []), lambda r: NOT list_contains(s.used, r))[1] AS r_pos
  FROM s JOIN c ON c.image_id = s.image_id AND c.k = s.k + 1) q),
f AS (SELECT coalesce(e.image_id, p.image_id) AS image_id, e.pos AS l_pos, p.pos AS r_pos, p.pos IS NULL OR coalesce(e.confidence >= p.confidence, FALSE) AS own,
 e.text AS lt, e.confidence AS lc, e.x1 AS lx1, e.y1 AS ly1, e.x2 AS lx2, e.y2 AS ly2, p.text AS rt, p.confidence AS rc, p.x1 AS rx1, p.y1 AS ry1, p.x2 AS rx2, p.y2 AS ry2
 FROM e LEFT JOIN s ON s.image_id = e.image_id AND s.l_pos = e.pos FULL JOIN p ON p.image_id = s.image_id AND p.pos = s.r_pos)
SELECT image_id, l_pos, r_pos, CASE WHEN regexp_full_match(text, '[0-9.,:%$OoIlSB+-]+') THEN translate(text, 'OoIlSB', '001158') ELSE text END AS text,
 CASE WHEN own THEN lc ELSE rc END AS confidence, CASE WHEN own THEN lx1 ELSE rx1 END AS x1, CASE WHEN own THEN ly1 ELSE ry1 END AS y1,
 CASE WHEN own THEN lx2 ELSE rx2 END AS x2, CASE WHEN own THEN ly2 ELSE ry2 END AS y2, CASE WHEN own THEN 'easyocr' ELSE 'paddleocr' END AS engine
FROM (SELECT *, CASE WHEN own THEN lt ELSE rt END AS text FROM f) q""",
)


@query("fused_tokens", "J9", "E2", sql=FUSED_SQL)
def _fused(spark, sf):
    return K.fuse_tokens(*_engines(spark, sf)).select(
        "image_id", "l_pos", "r_pos", "text", "confidence", "x1", "y1", "x2", "y2", "engine"
    )


DEDUPE_SQL = """WITH k AS (SELECT *, lower(text) AS norm FROM v_tokens WHERE text <> ''),
r AS (SELECT *, row_number() OVER (PARTITION BY image_id, norm ORDER BY confidence DESC, y1, x1, pos) AS best,
 row_number() OVER (PARTITION BY image_id, norm ORDER BY y1, x1, pos) AS first FROM k),
d AS (SELECT image_id, norm, max(text) FILTER (best = 1) AS text, max(x1) FILTER (best = 1) AS x1, max(y1) FILTER (best = 1) AS y1, max(x2) FILTER (best = 1) AS x2, max(y2) FILTER (best = 1) AS y2, max(confidence) AS confidence, max(y1) FILTER (first = 1) AS y, max(x1) FILTER (first = 1) AS x, max(pos) FILTER (first = 1) AS o FROM r GROUP BY 1, 2)
"""


@query(
    "token_dedupe",
    "J10",
    sql=oracle("tokens", DEDUPE_SQL + "SELECT image_id, norm, text, confidence, y, x, x1, y1, x2, y2 FROM d"),
)
def _dedupe(spark, sf):
    out = K.suppress_duplicates(view(spark, sf, "tokens"), F.col("pos"))
    return out.select("image_id", "norm", "text", "confidence", F.col("place.y").alias("y"), F.col("place.x").alias("x"), "x1", "y1", "x2", "y2")


@query(
    "page_text",
    "J10",
    sql=oracle(
        "tokens",
        DEDUPE_SQL
        + "SELECT image_id, string_agg(text, ' ' ORDER BY y, x, o) AS text, round(avg(confidence), 9) AS confidence, count(*) AS tokens FROM d GROUP BY 1",
    ),
)
def _page_text(spark, sf):
    out = K.page_text(K.suppress_duplicates(view(spark, sf, "tokens"), F.col("pos")))
    return out.withColumn("confidence", F.round("confidence", 9))


@query(
    "positional_fusion",
    "A48",
    sql=oracle(
        "tokens",
        """SELECT e.image_id, e.pos AS slot, CASE WHEN p.confidence > e.confidence THEN p.text ELSE e.text END AS text, greatest(p.confidence, e.confidence) AS confidence
FROM v_tokens e JOIN v_tokens p ON e.image_id = p.image_id AND p.pos - 100000 = e.pos WHERE e.engine = 'easyocr' AND p.engine = 'paddleocr'""",
    ),
)
def _positional(spark, sf):
    easy, paddle = _engines(spark, sf)
    return K.fuse_by_position(
        paddle.withColumn("slot", F.col("pos") - 100000), easy.withColumn("slot", F.col("pos")), "slot"
    )


@query(
    "token_ratios",
    "A31",
    sql=oracle(
        "tokens",
        r"""SELECT image_id, count(*) FILTER (regexp_matches(text, '\d')) / count(*) AS numeric_ratio, count(*) FILTER (regexp_matches(text, '\p{L}')) / count(*) AS alpha_ratio,
 count(DISTINCT text) / count(*) AS unique_ratio, count(*) FILTER (num) / count(*) AS number_share, count(*) FILTER (NOT num AND regexp_matches(text, '\p{L}')) / count(*) AS category_share
FROM (SELECT *, regexp_full_match(regexp_replace(regexp_replace(text, '[,%]', '', 'g'), '\.', ''), '\d+') AS num FROM v_tokens) q GROUP BY 1""",
    ),
)
def _ratios(spark, sf):
    return K.token_ratios(view(spark, sf, "tokens"))


@query(
    "token_recall",
    "A30",
    sql=oracle(
        "tokens",
        """SELECT image_id, count(DISTINCT lower(text)) AS union_tokens, count(DISTINCT lower(text)) FILTER (confidence > 0.5) AS ensemble_tokens,
 count(DISTINCT lower(text)) FILTER (confidence > 0.5) / count(DISTINCT lower(text)) AS recall FROM v_tokens WHERE text <> '' GROUP BY 1""",
    ),
)
def _recall(spark, sf):
    tokens = view(spark, sf, "tokens")
    return K.token_recall(tokens, tokens.filter(F.col("confidence") > 0.5))


@query(
    "numeric_extraction",
    "A30",
    sql=r"""SELECT doc_id, n_values, n_text, CASE WHEN n_text > 0 THEN n_values / n_text WHEN n_values > 0 THEN 1 ELSE 0 END AS accuracy FROM (
 SELECT doc_id, len(regexp_extract_all(source, '([-+]?\d*\.?\d+)', 1)) AS n_values, len(regexp_extract_all(text, '([-+]?\d*\.?\d+)', 1)) AS n_text FROM documents) q""",
)
def _extraction(spark, sf):
    df = table(spark, sf, "documents").select(
        "doc_id",
        F.size(T.extract_numbers(F.col("source"))).cast("bigint").alias("n_values"),
        F.size(T.extract_numbers(F.col("text"))).cast("bigint").alias("n_text"),
    )
    return df.withColumn("accuracy", K.numeric_accuracy(F.col("n_values"), F.col("n_text")))


@query(
    "token_quality",
    "A16",
    sql=oracle(
        "tokens",
        """SELECT round(avg(c), 9) AS average_confidence, round(avg(coalesce(s / nullif(u, 0), 0)), 9) AS token_recall, avg(CASE WHEN len > 0 THEN 1 ELSE 0 END) AS coverage FROM (
 SELECT image_id, avg(confidence) AS c, count(DISTINCT text) FILTER (engine = 'easyocr') AS s, count(DISTINCT text) AS u, coalesce(sum(length(text)) FILTER (engine = 'paddleocr'), 0) AS len FROM v_tokens GROUP BY 1) q""",
    ),
)
def _quality(spark, sf):
    tokens = view(spark, sf, "tokens")
    easy = F.col("engine") == "easyocr"
    by_text = tokens.groupBy("image_id", "text").agg(
        F.max(easy.cast("int")).alias("_e"), F.sum("confidence").alias("_c"), F.count(F.lit(1)).alias("_n"),
        (F.count_if(~easy) * F.length("text")).alias("_len"),
    )
    per_image = by_text.groupBy("image_id").agg(
        (F.sum("_c") / F.sum("_n")).alias("conf"), F.sum("_e").alias("found"), F.count(F.lit(1)).alias("all"), F.sum("_len").alias("len")
    )
    out = M.token_quality(per_image, "found", "all", "len", "conf")
    return out.select(*[F.round(c, 9).alias(c) for c in out.columns])


@query(
    "best_engine",
    "R11",
    sql=oracle(
        "tokens",
        """SELECT image_id, CASE WHEN e >= p THEN 'easyocr' ELSE 'paddleocr' END AS engine, round(greatest(e, p), 9) AS confidence FROM (
 SELECT image_id, round(coalesce(avg(confidence) FILTER (engine = 'easyocr'), 0), 9) AS e, round(coalesce(avg(confidence) FILTER (engine = 'paddleocr'), 0), 9) AS p FROM v_tokens GROUP BY 1) q""",
    ),
)
def _best(spark, sf):
    avg = lambda e: F.round(F.coalesce(F.avg(F.when(F.col("engine") == e, F.col("confidence"))), F.lit(0.0)), 9)
    df = view(spark, sf, "tokens").groupBy("image_id").agg(avg("easyocr").alias("e"), avg("paddleocr").alias("p"))
    engine, conf = K.best_engine(F.col("e"), F.col("p"))
    return df.select("image_id", engine.alias("engine"), F.round(conf, 9).alias("confidence"))


def _turn_pairs(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", F.split("text", r"\s+").alias("words"))
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("words").alias("truth"))
    return turns.join(before, ["conv_id", "turn"]).select("conv_id", "turn", F.col("role").alias("engine"), F.col("words").alias("extracted"), "truth")


@query("text_similarity", "F11")
def _similarity(spark, sf):
    score = F.round(K.similarity(F.col("extracted"), F.col("truth")), 4)
    return _turn_pairs(spark, sf).select("conv_id", "turn", score.alias("score"))


@query("engine_scores", "A40")
def _scores(spark, sf):
    return K.engine_scores(_turn_pairs(spark, sf))


@query(
    "parse_engine_output",
    "E3",
    "F5",
    sql=r"""SELECT conv_id, turn, CAST(0 AS INT) AS line_no, trim(text, ' ' || chr(10)) AS text, CAST(0.5 AS DOUBLE) AS confidence, 0 AS x1, CAST(turn AS INT) AS y1, CAST(length(text) AS INT) AS x2, CAST(turn + 10 AS INT) AS y2 FROM conversations WHERE role = 'assistant'
UNION ALL SELECT conv_id, turn, CAST(i - 1 AS INT), trim(l[i], ' ' || chr(10)), CASE WHEN i = 1 THEN 0.9 ELSE 0 END, 0, 0, 0, 0 FROM (
 SELECT conv_id, turn, l, unnest(generate_series(1, len(l))) AS i FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS l FROM conversations WHERE role <> 'assistant') a) b""",
)
def _parse(spark, sf):
    turns = table(spark, sf, "conversations")
    right, low = F.length("text"), F.concat(F.col("turn").cast("string"), F.lit(".0"))
    high = F.concat((F.col("turn") + 10).cast("string"), F.lit(".7"))
    box = F.format_string("[[0,%s],[%d,%s],[%d,%s],[0,%s]]", low, right, low, right, high, high)
    listed = F.format_string("[[[%s,[%s,0.5]]],null]", box, F.expr("regexp_replace(to_json(array(text)), '^.|.$', '')"))
    arrays = F.format_string('[{"rec_texts":%s,"rec_scores":[0.9]}]', F.to_json(F.split("text", "\n")))
    df = turns.select("conv_id", "turn", F.when(F.col("role") == "assistant", listed).otherwise(arrays).alias("raw"))
    out = K.parse_engine_json(df, "raw", ["conv_id", "turn"])
    return out.select("conv_id", "turn", "line_no", "text", "confidence", "box.*")
