import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chartloom.llm import hard_negatives as H
from chartloom.llm import queries

SF = "/root/testdata/sf0.001"
COLUMNS = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def brute(rows, every=100, shift=7):
    used = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        label = (label + 1) % 10 if i is not None and i % shift == 0 else label
        used.append((i, [math.floor(256 * x) for x in v], label))
    key = lambda p: (-p[0], p[1] is None, p[1] or 0)
    out = []
    for n, (i, v, label) in enumerate(used):
        if i is None or i % every:
            continue
        s = [(sum(a * b for a, b in zip(v, w)), j, m) for at, (j, w, m) in enumerate(used) if at != n]
        positives = sorted(((x, j) for x, j, m in s if m == label), key=key)[:5]
        negatives = sorted(((x, j) for x, j, m in s if m != label), key=key)
        for p, j in positives:
            window = [(x, k) for x, k in negatives if 80 * p <= 100 * x <= 100 * p][:5]
            out += [(i, j, r + 1, k, p, x) for r, (x, k) in enumerate(window)]
    return sorted(out, key=repr)


def run(df, every=100, shift=7, **more):
    label = F.when(F.col("vec_id") % shift == 0, (F.col("label").cast("bigint") + 1) % 10).otherwise(F.col("label"))
    return sorted((tuple(r[c] for c in COLUMNS) for r in H.mine(df, F.col("vec_id") % every == 0, label, **more).collect()), key=repr)


def table(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").repartition(3)


def test_given_embeddings_against_brute_force(spark):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = sorted((tuple(r[c] for c in COLUMNS) for r in queries.op13_hard_negatives(spark, SF).collect()), key=repr)
    assert got and got == brute(rows)


@pytest.mark.parametrize("seed", range(3))
def test_ties_repeats_and_overlapping_windows(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice([i, i, i // 2, None]), [rng.choice([0.0, 0.25, 0.5, 1.0, -0.5]) for _ in range(rng.choice([3, 3, 4]))], rng.randint(0, 2)) for i in range(120)]
    rows += rows[:15]
    # batches of a few anchors and blocks of a few rows give the same
    assert run(table(spark, rows), every=4) == brute(rows, every=4)
    assert run(table(spark, rows), every=4, batch_bytes=320) == brute(rows, every=4)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 1.0], 1), (100, None, 1), (200, [1.0, None], 1), (300, [nan, 1.0], 1), (1, [1.0, inf], 2), (2, [1.0, 0.9], None), (3, [1.0, 1.0], 2),
            (4, [0.9, 1.0], 2), (5, [0.85, 1.0], 3), (None, [0.9, 1.0], 3), (None, [1.0, 1.1], 2), (8, [], 2), (400, [], 2), (500, [-1.0, -1.0], 2), (6, [1.0, 1.0, 5.0], 3)]
    docs = table(spark, rows).selectExpr("*", "1 AS id", "2 AS vec", "3 AS picked", "4 AS score")
    assert run(docs) == brute(rows)
    assert run(docs.limit(0)) == []
    assert run(docs.filter("vec_id = 0")) == []


def test_a_hot_label_and_hot_id(spark):
    rng = random.Random(9)
    rows = [(i if i % 3 else 100, [rng.random() for _ in range(4)], 1 if i % 3 else rng.randint(0, 9)) for i in range(300)]
    assert run(table(spark, rows), every=50) == brute(rows, every=50)


def test_exact_scores_of_any_size():
    small = np.array([[3, -4], [5, 6]])
    assert H.scores(small, small).tolist() == [[25, -9], [-9, 61]]
    wide = np.array([[1 << 30, 1], [-(1 << 30), 3]])
    assert H.scores(wide, wide).tolist() == [[(1 << 60) + 1, 3 - (1 << 60)], [3 - (1 << 60), (1 << 60) + 9]]
    huge = np.array([[1 << 40, 1]])
    assert H.scores(huge, huge).tolist() == [[(1 << 63) - 1]]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([[1e300, -1e300, -0.001]])], names=["id", "label", "vec"])
    assert H.vectors(batch)[2].tolist() == [[(1 << 63) - 1, -(1 << 63), -1]]


def test_suffix_merge():
    slot, score = np.array([0, 0, 2, 2, 2]), [90, 85, 60, 59, 40]
    assert H.suffix_windows(slot, score, [100, 80, 70], 3) == [[0, 1], [], [2, 3]]
    assert H.suffix_windows(slot, score, [94, 73, 70], 3) == [[0, 1], [2, 3], [2, 3]]
