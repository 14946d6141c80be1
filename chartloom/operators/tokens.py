"""Token matching, fusion of two engines, duplicate suppression and token statistics.

Token tables have image_id, engine, pos (order within image and engine), text, confidence
and an integer box x1, y1, x2, y2.
"""

from __future__ import annotations

from collections.abc import Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chartloom.functions import text as T
from chartloom.functions.boxes import iou
from chartloom.operators.ordering import global_index, null_safe_join
from chartloom.session import cut_lineage

MATCH_IOU = 0.3
_CELL = 64  # pixels; a text token covers few cells
_BOX = ["x1", "y1", "x2", "y2"]


def normalized(df: DataFrame) -> DataFrame:
    return df.withColumn("norm", F.lower(T.normalize_whitespace(F.coalesce("text", F.lit("")))))


def _cells(df: DataFrame) -> DataFrame:
    """One row per grid cell a non-empty box covers."""
    span = lambda a, b: F.sequence(F.floor(F.col(a) / _CELL), F.floor((F.col(b) - 1) / _CELL))
    solid = df.filter((F.col("x2") > F.col("x1")) & (F.col("y2") > F.col("y1")))
    return solid.withColumn("cx", F.explode(span("x1", "x2"))).withColumn("cy", F.explode(span("y1", "y2")))


def overlap_classes(left: DataFrame, right: DataFrame, threshold: float = MATCH_IOU, named: Sequence[str] = ()) -> DataFrame:
    """Pairs of distinct (text, box) classes of an image that match by overlap alone, with the columns ``named`` that a class determines.

    Boxes meet in the grid cells they share and are compared only in the cell that holds the
    corner of their intersection, so a pair appears once. Copies of a token are one class, and
    classes of equal text are left out: they match anyway. Token tables are exploded text, many times
    the files that Spark estimates them by, so joins with them name their kind: none is broadcast.
    """
    cols = ["image_id", "norm", *_BOX, *named]
    a = _cells(left.select(*cols).distinct()).select("image_id", "cx", "cy", *[F.col(c).alias(f"l_{c}") for c in cols[1:]])
    b = _cells(right.select(*cols).distinct()).select("image_id", "cx", "cy", *[F.col(c).alias(f"r_{c}") for c in cols[1:]])
    here = (F.floor(F.greatest("l_x1", "r_x1") / _CELL) == F.col("cx")) & (
        F.floor(F.greatest("l_y1", "r_y1") / _CELL) == F.col("cy")
    )
    same = (F.col("l_norm") == F.col("r_norm")) & (F.col("l_norm") != "")
    close = iou([F.col(f"l_{c}") for c in _BOX], [F.col(f"r_{c}") for c in _BOX]) >= threshold
    return a.join(b.hint("merge"), ["image_id", "cx", "cy"]).filter(here & ~same & close).drop("cx", "cy")


def count_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """Per left token: right tokens of equal text, and others that overlap it enough."""
    left, right = normalized(left), normalized(right)
    by_text = right.filter(F.col("norm") != "").groupBy("image_id", "norm").agg(F.count(F.lit(1)).alias("equal_text"))
    sizes = right.groupBy("image_id", *[F.col(c).alias(f"r_{c}") for c in ("norm", *_BOX)]).agg(F.count(F.lit(1)).alias("_n"))
    near = (
        overlap_classes(left, right)
        .join(sizes.hint("merge"), ["image_id", *[f"r_{c}" for c in ("norm", *_BOX)]])
        .groupBy("image_id", *[F.col(f"l_{c}").alias(c) for c in ("norm", *_BOX)])
        .agg(F.sum("_n").alias("overlapping"))
    )
    zero = F.lit(0).cast("bigint")
    return (
        left.join(by_text.hint("merge"), ["image_id", "norm"], "left")
        .join(near.hint("merge"), ["image_id", "norm", *_BOX], "left")
        .select("image_id", "engine", "pos", F.coalesce("equal_text", zero).alias("equal_text"), F.coalesce("overlapping", zero).alias("overlapping"))
    )


_BLOCK_BITS = 14  # tokens of one text are ranked in blocks of 2**14


def _token_table(left: DataFrame, right: DataFrame) -> DataFrame:
    """Both sides in one table: ``idx`` numbers the tokens of a text in the order in which they are served, ``cls`` names the
    tokens of equal text and box."""
    sides = [
        normalized(t)
        .withColumn("confidence", F.coalesce(F.col("confidence").cast("double"), F.lit(0.0)))  # a missing confidence reads 0
        .select("image_id", F.lit(side).alias("side"), "norm", "pos", "confidence", *_BOX)
        for side, t in ((0, left), (1, right))
    ]
    both = sides[0].unionByName(sides[1]).filter(F.col("image_id").isNotNull())
    served = F.when(F.col("side") == 1, -F.col("confidence")).otherwise(F.lit(0.0))
    numbered = global_index(both.withColumn("_served", served), ["image_id", "norm", "side", "_served", "pos"], index_col="idx")
    keys = ["image_id", "side", "norm", *_BOX]
    classes = numbered.groupBy(*keys).agg(F.min("idx").alias("cls"))
    return null_safe_join(numbered, classes, keys).drop("_served")


# a round is planned again and again, so it is written in SQL; each part is made once and lets go of its shuffle files
_RANKED = f"""
WITH named AS (SELECT *, shiftright(idx, {_BLOCK_BITS}) AS blk FROM {{tokens}} WHERE norm <> ''),
  sizes AS (SELECT image_id, side, norm, blk, count(*) AS n FROM named GROUP BY ALL),
  carry AS (SELECT image_id, side, norm, blk, sum(n) OVER (PARTITION BY image_id, side, norm ORDER BY blk) - n AS off FROM sizes)
SELECT image_id, side, norm, pos, confidence, cls, off + row_number() OVER (PARTITION BY image_id, side, norm, blk ORDER BY idx) AS rank
FROM named JOIN carry USING (image_id, side, norm, blk)
"""
_ALIVE = """
SELECT * FROM {edges}
JOIN (SELECT cls AS lc, min(pos) AS f FROM {tokens} WHERE side = 0 GROUP BY cls) USING (lc)
JOIN (SELECT cls AS rc, max(struct(confidence, -pos AS place)) AS t FROM {tokens} WHERE side = 1 GROUP BY cls) USING (rc)
"""
_LEVEL = """
WITH best AS (SELECT lc, max(t) AS best FROM {alive} GROUP BY lc),
  suitor AS (SELECT rc, min(f) AS suitor FROM {alive} GROUP BY rc)
SELECT image_id, norm, rank, l.pos AS l_pos, r.pos AS r_pos,
       coalesce(best > struct(r.confidence, -r.pos AS place), FALSE) OR coalesce(suitor < l.pos, FALSE) AS doubt
FROM (SELECT * FROM {ranked} WHERE side = 0) l JOIN (SELECT * FROM {ranked} WHERE side = 1) r USING (image_id, norm, rank)
LEFT JOIN best ON lc = l.cls LEFT JOIN suitor ON rc = r.cls
"""
_SETTLED = """
WITH best AS (SELECT lc, max(t) AS best FROM {alive} GROUP BY lc),
  suitor AS (SELECT rc, min(f) AS suitor FROM {alive} GROUP BY rc),
  settled AS (SELECT image_id, norm, coalesce(min(rank) FILTER (WHERE doubt) - 1, max(rank)) AS n FROM {level} GROUP BY image_id, norm),
  rest AS (
    SELECT image_id, norm, min(pos) FILTER (WHERE side = 0) AS head, max(struct(confidence, -pos AS place)) FILTER (WHERE side = 1) AS top
    FROM {ranked} LEFT JOIN settled USING (image_id, norm) WHERE rank > coalesce(n, 0) GROUP BY image_id, norm)
SELECT image_id, l_pos, r_pos FROM {level} JOIN settled USING (image_id, norm) WHERE rank <= n
UNION ALL
SELECT image_id, f, -t.place FROM {alive} JOIN best USING (lc) JOIN suitor USING (rc)
LEFT JOIN (SELECT image_id, norm AS l_norm, head AS l_head, top AS l_top FROM rest) USING (image_id, l_norm)
LEFT JOIN (SELECT image_id, norm AS r_norm, head AS r_head, top AS r_top FROM rest) USING (image_id, r_norm)
WHERE t = best AND f = suitor AND (l_norm = '' OR f >= l_head) AND (r_norm = '' OR t <= r_top)
  AND (l_top IS NULL OR t > l_top) AND (r_head IS NULL OR f < r_head)
"""


def _settled(tokens: DataFrame, edges: DataFrame) -> DataFrame:
    """Pairs (image_id, l_pos, r_pos) that no other match can change any more.

    By text, the i-th free left token and the i-th free right token of a text belong together as long as, up to i, no left
    token overlaps a better right one and no right token an earlier left one. By overlap, a pair is settled if either is
    the other's best, also against what these text pairs leave of its text. Ranks are taken in blocks of the fixed numbering, so a text of any
    number of tokens is spread over tasks.
    """
    spark = tokens.sparkSession
    ranked = cut_lineage(spark.sql(_RANKED, tokens=tokens))
    alive = cut_lineage(spark.sql(_ALIVE, tokens=tokens, edges=edges))
    level = cut_lineage(spark.sql(_LEVEL, ranked=ranked, alive=alive))
    return spark.sql(_SETTLED, ranked=ranked, alive=alive, level=level)


# what stays for the next round: texts that no edge touched are complete
_LEFT_OVER = """
SELECT t.* FROM {tokens} t
LEFT ANTI JOIN (SELECT image_id, 0 AS side, l_pos AS pos FROM {pairs} UNION ALL SELECT image_id, 1, r_pos FROM {pairs}) USING (image_id, side, pos)
LEFT SEMI JOIN (SELECT DISTINCT image_id, explode(array(l_norm, r_norm)) AS norm FROM {edges}) USING (image_id, norm)
"""
_STILL_OPEN = """
SELECT e.* FROM {edges} e
LEFT SEMI JOIN (SELECT cls AS lc FROM {tokens} WHERE side = 0 GROUP BY cls) USING (lc)
LEFT SEMI JOIN (SELECT cls AS rc FROM {tokens} WHERE side = 1 GROUP BY cls) USING (rc)
"""


def match_tokens(left: DataFrame, right: DataFrame) -> DataFrame:
    """Greedy one-to-one pairs (image_id, l_pos, r_pos): left tokens in order take the free match of highest confidence, the
    first one on ties. Tokens match by equal text or by overlap; a missing confidence reads 0.

    Matches by overlap are edges between classes of equal text and box. Every round settles, in all images together, each
    pair that can no longer change; texts that no edge touches are complete after it and leave. Only texts with an edge go
    on, until no edge is left. The number of rounds follows the chains of competing edges, not the
    number of tokens, and no image or text has to fit into a task.
    """
    tokens = cut_lineage(_token_table(left, right))
    # classes keep their names: found again by text and box, all pairs would be shuffled twice more
    near = overlap_classes(tokens.filter("side = 0"), tokens.filter("side = 1"), named=["cls"])
    edges = cut_lineage(near.select("image_id", F.col("l_cls").alias("lc"), F.col("r_cls").alias("rc"), "l_norm", "r_norm"))
    done, open_edges = None, not edges.isEmpty()
    while True:
        pairs = cut_lineage(_settled(tokens, edges))
        done = pairs if done is None else done.unionByName(pairs)
        if not open_edges:
            return done
        spark = tokens.sparkSession
        tokens = cut_lineage(spark.sql(_LEFT_OVER, tokens=tokens, pairs=pairs, edges=edges))
        edges = cut_lineage(spark.sql(_STILL_OPEN, tokens=tokens, edges=edges))
        open_edges = not edges.isEmpty()


def fuse_tokens(left: DataFrame, right: DataFrame) -> DataFrame:
    """Merged tokens: of a pair the more confident side (left on ties), and all unmatched ones.

    ``ord`` keeps the merge order: left tokens first, then unmatched right tokens.
    """
    cols = ["text", "confidence", *_BOX, "engine"]
    pairs = match_tokens(left, right)
    l_rows = left.select("image_id", F.col("pos").alias("l_pos"), F.struct(*cols).alias("l"))
    r_rows = right.select("image_id", F.col("pos").alias("r_pos"), F.struct(*cols).alias("r"))
    merged = l_rows.join(pairs, ["image_id", "l_pos"], "left").join(r_rows, ["image_id", "r_pos"], "full")
    keep_left = F.col("r").isNull() | (F.col("l.confidence") >= F.col("r.confidence"))
    token = F.when(F.col("l").isNotNull() & keep_left, F.col("l")).otherwise(F.col("r"))
    return merged.select(
        "image_id",
        F.struct(F.col("l").isNull().cast("int").alias("side"), F.coalesce("l_pos", "r_pos").alias("pos")).alias("ord"),
        "l_pos",
        "r_pos",
        token.alias("t"),
    ).select(
        "image_id", "ord", "l_pos", "r_pos",
        T.correct_numeric_token(T.normalize_whitespace(F.coalesce("t.text", F.lit("")))).alias("text"),
        F.col("t.confidence").alias("confidence"), *[F.col(f"t.{c}").alias(c) for c in _BOX], F.col("t.engine").alias("engine"),
    )


def suppress_duplicates(tokens: DataFrame, order: Column) -> DataFrame:
    """One token per image and lower-cased text, at the place of the first in (y1, x1, order).

    Text, box and engine are those of the most confident copy, the first one on ties.
    """
    place = F.struct(F.col("y1").alias("y"), F.col("x1").alias("x"), order.alias("o"))
    keyed = normalized(tokens).filter(F.col("norm") != "").withColumn("_place", place)
    # negated places would not work for structs: take the best confidence, then its first place
    best = keyed.groupBy("image_id", "norm", "confidence").agg(
        F.min("_place").alias("first"), F.min_by(F.struct("text", "engine", *_BOX), F.col("_place")).alias("t")
    )
    return (
        best.groupBy("image_id", "norm")
        .agg(F.min("first").alias("place"), F.max("confidence").alias("confidence"), F.max_by("t", "confidence").alias("t"))
        .select("image_id", "norm", "place", "confidence", F.col("t.text").alias("text"), F.col("t.engine").alias("engine"), *[F.col(f"t.{c}").alias(c) for c in _BOX])
    )


def page_text(tokens: DataFrame) -> DataFrame:
    """Text in reading order, mean confidence and number of tokens per image."""
    return tokens.groupBy("image_id").agg(
        F.array_join(F.sort_array(F.collect_list(F.struct("place", "text")))["text"], " ").alias("text"),
        F.avg("confidence").alias("confidence"),
        F.count(F.lit(1)).alias("tokens"),
    )


def fuse_by_position(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Entries at the same position of two result lists: the more confident, right on ties."""
    a = left.select("image_id", key, F.struct("text", "confidence").alias("a"))
    b = right.select("image_id", key, F.struct("text", "confidence").alias("b"))
    win = F.when(F.col("a.confidence") > F.col("b.confidence"), F.col("a")).otherwise(F.col("b"))
    return a.join(b.hint("merge"), ["image_id", key]).select("image_id", key, win.alias("w")).select("image_id", key, "w.*")


def token_ratios(tokens: DataFrame) -> DataFrame:
    """Per image: shares of tokens with digits, with letters, of distinct, plain-number and word tokens."""
    by_text = tokens.groupBy("image_id", "text").agg(F.count(F.lit(1)).alias("n"))
    number = T.is_plain_number(F.col("text"))
    total = F.sum("n")
    share = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)) / total
    return by_text.groupBy("image_id").agg(
        share(T.has_digit(F.col("text"))).alias("numeric_ratio"),
        share(T.has_letter(F.col("text"))).alias("alpha_ratio"),
        (F.count(F.lit(1)) / total).alias("unique_ratio"),
        share(number).alias("number_share"),
        share(~number & T.has_letter(F.col("text"))).alias("category_share"),
    )


def token_recall(union: DataFrame, ensemble: DataFrame) -> DataFrame:
    """Per image: distinct lower-cased tokens of all engines and of the ensemble, and their ratio."""
    def distinct(df: DataFrame, name: str) -> DataFrame:
        token = F.lower(T.strip(F.col("text")))
        return df.select("image_id", token.alias("t")).filter(F.col("t") != "").distinct().groupBy("image_id").agg(
            F.count(F.lit(1)).alias(name)
        )

    joined = distinct(union, "union_tokens").join(distinct(ensemble, "ensemble_tokens"), "image_id", "full")
    zero = F.lit(0).cast("bigint")
    u, e = F.coalesce("union_tokens", zero), F.coalesce("ensemble_tokens", zero)
    return joined.select("image_id", u.alias("union_tokens"), e.alias("ensemble_tokens"), F.when(u > 0, e / u).otherwise(F.lit(0.0)).alias("recall"))


def numeric_accuracy(found: Column, total: Column) -> Column:
    """found/total; without numbers in the text 1 if anything was found, else 0."""
    return F.when(total > 0, found / total).otherwise(F.when(found > 0, 1.0).otherwise(0.0))


def best_engine(one: Column, other: Column, names: tuple[str, str] = ("easyocr", "paddleocr")) -> tuple[Column, Column]:
    """(name, confidence) of the more confident engine, the first on ties."""
    return F.when(one >= other, names[0]).otherwise(names[1]), F.greatest(one, other)


def _ratio(left: pd.Series, right: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, a.lower(), b.lower()).ratio() for a, b in zip(left, right)], dtype="float64")


def similarity(left: Column, right: Column) -> Column:
    """Ratcliff-Obershelp ratio of two text lists, joined and lower-cased. They are joined before they reach Python, where
    every word would be an object."""
    return F.pandas_udf(_ratio, "double")(F.array_join(left, " "), F.array_join(right, " "))


def engine_scores(pairs: DataFrame) -> DataFrame:
    """Mean similarity per engine for rows (engine, extracted, truth), best engine first."""
    return (
        pairs.withColumn("score", F.round(similarity(F.col("extracted"), F.col("truth")), 4))
        .groupBy("engine")
        .agg(F.avg("score").alias("score"), F.count(F.lit(1)).alias("rows"))
        .orderBy(F.desc("score"), "engine")
    )


def parse_engine_json(df: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """Token rows from engine output in either of its layouts.

    Layout one nests lines [[points], [text, confidence]] in blocks; layout two is a block
    with parallel arrays rec_texts and rec_scores. Missing confidences read 0.
    """
    from chartloom.functions.boxes import polygon_box

    blocks = df.select(*keys, F.posexplode(F.from_json(column, "array<string>")).alias("block_no", "block")).filter(F.col("block").isNotNull())
    zero_box = F.struct(*[F.lit(0).alias(c) for c in _BOX])
    lines = blocks.filter(F.col("block").startswith("[")).select(
        *keys, "block_no", F.posexplode(F.from_json("block", "array<array<string>>")).alias("line_no", "line")
    ).filter(F.size("line") >= 2)
    info = F.from_json(F.col("line")[1], "array<string>")
    listed = lines.withColumn("info", info).filter(F.size("info") >= 1).select(
        *keys, "block_no", "line_no",
        T.strip(F.col("info")[0]).alias("text"),
        F.coalesce(F.try_element_at("info", F.lit(2)).try_cast("double"), F.lit(0.0)).alias("confidence"),
        F.coalesce(polygon_box(F.from_json(F.col("line")[0], "array<array<double>>")), zero_box).alias("box"),
    )
    arrays = blocks.filter(F.col("block").startswith("{")).withColumn(
        "b", F.from_json("block", "rec_texts array<string>, rec_scores array<double>")
    )
    parallel = arrays.select(
        *keys, "block_no", F.posexplode("b.rec_texts").alias("line_no", "text"), F.col("b.rec_scores").alias("scores")
    ).select(
        *keys, "block_no", "line_no", T.strip(F.col("text")).alias("text"),
        F.coalesce(F.try_element_at("scores", F.col("line_no") + 1), F.lit(0.0)).alias("confidence"), zero_box.alias("box"),
    )
    return listed.unionByName(parallel)
