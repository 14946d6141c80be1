import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from chartloom.functions import text as T
from chartloom.operators import tokens as K
from chartloom.session import cut_lineage

SCHEMA = "image_id bigint, engine string, pos bigint, text string, confidence double, x1 int, y1 int, x2 int, y2 int"


def _tokens(engine, n, seed, images=2):
    rnd = random.Random(seed)
    rows = []
    for image in range(images):
        for pos in range(n):
            x, y = rnd.randint(0, 260), rnd.randint(0, 120)
            text = rnd.choice(["alpha", "beta", "gamma", "10", "", "Alpha ", f"w{pos}"])
            rows.append((image, engine, pos, text, round(rnd.random(), 1), x, y, x + rnd.randint(10, 60), y + rnd.randint(8, 20)))
    return rows


def _iou(a, b):
    w = max(0, min(a[7], b[7]) - max(a[5], b[5]))
    h = max(0, min(a[8], b[8]) - max(a[6], b[6]))
    if w * h <= 0:
        return 0.0
    return w * h / (max(1, (a[7] - a[5]) * (a[8] - a[6])) + max(1, (b[7] - b[5]) * (b[8] - b[6])) - w * h)


def _match(a, b):
    ta, tb = a[3].strip().lower(), b[3].strip().lower()
    return (ta == tb and ta != "") or _iou(a, b) >= 0.3


def _brute(left, right):
    pairs, used = set(), set()
    for a in left:
        best = None
        for b in right:
            if b[0] == a[0] and (b[0], b[2]) not in used and _match(a, b) and (best is None or b[4] > best[4]):
                best = b
        if best:
            used.add((best[0], best[2]))
            pairs.add((a[0], a[2], best[2]))
    return pairs


def _pairs(df):
    return {tuple(r) for r in df.select("image_id", "l_pos", "r_pos").collect()}


@pytest.mark.parametrize("seed", range(4))
def test_matching_is_greedy(spark, seed):
    left, right = _tokens("easyocr", 40, seed), _tokens("paddleocr", 45, seed + 50)
    got = K.match_tokens(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA))
    assert _pairs(got) == _brute(left, right)


def test_matching_of_copies_without_text_and_missing_values(spark):
    row = lambda e, pos, text, conf, x, image=0: (image, e, pos, text, conf, x, 0, x + 20, 10)
    left = [row("e", p, t, 0.5, x) for p, (t, x) in enumerate([("", 0), ("", 0), ("a", 0), ("a", 0), ("b", 100), ("a", 100), (None, 300)])]
    right = [row("p", p, t, c, x) for p, (t, c, x) in enumerate([("a", 0.2, 100), ("", 0.9, 0), ("", None, 0), ("a", 0.2, 0), ("c", 0.7, 0), ("b", 0.1, 300)])]
    plain = lambda rows: [(*r[:3], r[3] or "", r[4] or 0.0, *r[5:]) for r in rows]
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in (left, right)]
    assert _pairs(K.match_tokens(*frames)) == _brute(plain(left), plain(right))
    assert _pairs(K.match_tokens(frames[0].limit(0), frames[1])) == set()
    assert _pairs(K.match_tokens(frames[0], frames[1].limit(0))) == set()


def test_many_equal_tokens_with_one_overlap_take_few_rounds(spark, monkeypatch):
    """100,000 tokens of one text in one image; one of them overlaps a better token of another text."""
    n, rounds = 50_000, []
    settled = K._settled
    monkeypatch.setattr(K, "_settled", lambda *a: rounds.append(1) or settled(*a))
    side = lambda e: spark.range(n).selectExpr(
        "0L AS image_id", f"'{e}' AS engine", "id AS pos", "'same' AS text", "CAST(pmod(hash(id), 1000) / 2000 AS DOUBLE) AS confidence",
        "CAST(100 * (id % 200) AS INT) AS x1", f"CAST({20 if e == 'p' else 0} + 50 * floor(id / 200) AS INT) AS y1",
        "CAST(100 * (id % 200) + 30 AS INT) AS x2", f"CAST({30 if e == 'p' else 10} + 50 * floor(id / 200) AS INT) AS y2")
    left, right = side("e"), side("p")
    box = left.filter("pos = 30000").first()
    extra = spark.createDataFrame([(0, "p", n, "other", 0.9, box.x1, box.y1, box.x2, box.y2)], SCHEMA)
    got = _pairs(K.match_tokens(left, right.unionByName(extra)))
    best = [p for _, p in sorted((-r.confidence, r.pos) for r in right.select("pos", "confidence").collect())]
    others = [p for p in range(n) if p != 30_000]
    assert got == {(0, 30_000, n)} | {(0, a, b) for a, b in zip(others, best)}
    assert len(rounds) <= 4


def test_match_counts(spark):
    left, right = _tokens("easyocr", 30, 3), _tokens("paddleocr", 30, 4)
    got = K.count_matches(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)).collect()
    assert len(got) == 60
    for r in got:
        a = next(x for x in left if x[0] == r["image_id"] and x[2] == r["pos"])
        assert r["equal_text"] + r["overlapping"] == sum(b[0] == a[0] and _match(a, b) for b in right)


def test_fusion_keeps_every_token_once(spark):
    left, right = _tokens("easyocr", 20, 5), _tokens("paddleocr", 25, 6)
    out = K.fuse_tokens(spark.createDataFrame(left, SCHEMA), spark.createDataFrame(right, SCHEMA)).collect()
    pairs = _brute(left, right)
    assert len(out) == len(left) + len(right) - len(pairs)
    for r in out:
        if r["l_pos"] is not None and r["r_pos"] is not None:
            a = next(x for x in left if (x[0], x[2]) == (r["image_id"], r["l_pos"]))
            b = next(x for x in right if (x[0], x[2]) == (r["image_id"], r["r_pos"]))
            assert r["confidence"] == max(a[4], b[4])
            assert r["engine"] == ("easyocr" if a[4] >= b[4] else "paddleocr")


def test_duplicates_are_suppressed_once_and_for_all(spark):
    df = spark.createDataFrame(_tokens("easyocr", 40, 7), SCHEMA)
    once = K.suppress_duplicates(df, F.col("pos"))
    assert once.groupBy("image_id", "norm").count().filter("count > 1").count() == 0
    again = K.suppress_duplicates(
        once.select("image_id", "text", "engine", "confidence", "x1", "y1", "x2", "y2", F.col("place.o").alias("pos")),
        F.col("pos"),
    )
    assert sorted(map(str, again.drop("place").collect())) == sorted(map(str, once.drop("place").collect()))


def test_text_functions(spark):
    df = spark.createDataFrame([(" 1O.5 ", ["A  b", "a b", "é", "", " C\t"], "x 1.5 and -2")], "t string, l array<string>, s string")
    row = df.select(
        T.correct_numeric_token(F.col("t")).alias("fixed"), T.correct_numeric_token(F.lit("lOok")).alias("word"),
        T.clean_text_list(F.col("l")).alias("clean"), T.extract_numbers(F.col("s")).alias("numbers"),
        T.ellipsize(F.lit("abcdefghij"), 8).alias("short"), T.is_plain_number(F.lit("1,234.5%")).alias("plain"),
        T.normalize_whitespace(F.lit("\u00a0a \u2003 b\n")).alias("flat"),
    ).first()
    assert row["fixed"] == "10.5" and row["word"] == "lOok"
    assert row["clean"] == ["A b", "C"] and row["numbers"] == [1.5, -2.0]
    assert row["short"] == "abcde..." and row["plain"] and row["flat"] == "a b"


def test_similarity(spark):
    df = spark.createDataFrame([(["Alpha", "b"], ["alpha"]), ([], []), (["x"], [])], "a array<string>, b array<string>")
    got = [r[0] for r in df.select(K.similarity(F.col("a"), F.col("b"))).collect()]
    assert got == [SequenceMatcher(None, "alpha b", "alpha").ratio(), 1.0, 0.0]


def test_exploded_tokens_are_not_broadcast(spark, capsys):
    # estimated by their files, which are far smaller than the tokens in them
    left, right = (spark.createDataFrame(_tokens(e, 30, 3), SCHEMA) for e in ("easyocr", "paddleocr"))
    slot = [t.withColumn("slot", F.col("pos")) for t in (left, right)]
    for found in (K.count_matches(left.limit(20), right.limit(20)), K.fuse_by_position(*[t.limit(20) for t in slot], "slot")):
        found.explain()
        plan = capsys.readouterr().out
        assert "SortMergeJoin" in plan and "Broadcast" not in plan
    got = {(r.image_id, r.pos): r.equal_text + r.overlapping for r in K.count_matches(left, right).collect()}
    rows = [(_tokens("easyocr", 30, 3)), _tokens("paddleocr", 30, 3)]
    assert got == {(a[0], a[2]): sum(b[0] == a[0] and _match(a, b) for b in rows[1]) for a in rows[0]}


def test_similarity_sends_no_word_lists_to_python(spark):
    df = spark.createDataFrame([([], []), (["Ab", "c"], ["ab", "C"]), ([], ["x"])], "a array<string>, b array<string>")
    out = df.select(K.similarity(F.col("a"), F.col("b")).alias("s"))
    assert [r.s for r in out.collect()] == [1.0, 1.0, 0.0]
    assert "array_join" in out._jdf.queryExecution().optimizedPlan().toString()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lists_are_cleaned_once_and_sorted_without_comparing_expressions(spark):
    rows = [(1, ["Ab", None, "ab", "", " ", "é\nx", " x", "x ", "a\t b", "A B", "é", "ab"]), (2, None), (3, [])]
    df = spark.createDataFrame(rows, "k int, l array<string>").select("k", T.clean_text_list(F.col("l")).alias("clean"))
    assert {r["k"]: r["clean"] for r in df.collect()} == {1: ["Ab", " x", "x", "a b"], 2: None, 3: []}
    assert "array_sort(" not in _plan(df) and _plan(df).count("lower(") == 1 and _plan(df).count(r"[^\x20-\x7E]") == 1


def test_page_text_is_sorted_without_comparing_expressions(spark):
    rows = [(1, (2, 0, 5), "b", 0.5), (1, (0, 7, 9), "a", 1.0), (1, (2, 0, 4), None, None), (2, (None, 1, 1), "z", 0.25), (2, (1, None, 1), "y", 0.25)]
    df = K.page_text(spark.createDataFrame(rows, "image_id int, place struct<y:int,x:int,o:int>, text string, confidence double"))
    assert {tuple(r) for r in df.collect()} == {(1, "a b", 0.75, 3), (2, "z y", 0.25, 2)}
    assert "array_sort(" not in _plan(df)


def test_a_round_holds_few_shuffles_at_a_time(spark):
    """What several parts of a round read is written once; in one statement each part would shuffle the tokens anew."""
    schema = "image_id bigint, engine string, pos bigint, text string, confidence double, x1 int, y1 int, x2 int, y2 int"
    one, other = (spark.createDataFrame([(1, e, i, f"{e}{i % 5}", 0.1 * i, 9 * i, 0, 9 * i + 12, 12) for i in range(20)], schema) for e in "ab")
    tokens = K._token_table(one, other)
    edges = K.overlap_classes(tokens.filter("side = 0"), tokens.filter("side = 1"), named=["cls"]).selectExpr("image_id", "l_cls AS lc", "r_cls AS rc", "l_norm", "r_norm")
    assert K._settled(cut_lineage(tokens), cut_lineage(edges))._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 16
