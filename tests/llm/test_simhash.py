import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chartloom.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def plain(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """{fingerprint: its component} by brute force."""
    prints, seen = sorted(set(prints)), {}
    for p in prints:
        if p in seen:
            continue
        seen[p], todo = p, [p]
        while todo:
            x = todo.pop()
            for q in prints:
                if q not in seen and (x ^ q).bit_count() <= 3:
                    seen[q] = p
                    todo.append(q)
    return seen


def expected(rows):
    prints = [(i, plain(t)) for i, t in rows]
    part = components(p for _, p in prints)
    lowest = {}
    for i, p in prints:
        if i is not None:
            lowest[part[p]] = min(i, lowest.get(part[p], i))
    return sorted(((i, f"{p:016x}", lowest.get(part[p])) for i, p in prints), key=repr)


def got(df):
    return sorted(((r.doc_id, r.fingerprint, r.component_id) for r in df.collect()), key=repr)


def test_given_documents_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert got(queries.op12_simhash(spark, SF)) == expected(rows)


def test_odd_rows(spark):
    rows = [(5, None), (2, ""), (3, " \t\n"), (4, "One"), (6, "one"), (7, "One  two"), (8, "one\ttwo"), (9, "É a b C"), (None, "x y z"), (None, "x\ny  z"),
            (None, "only null ids here"), (10, "ab " * 60_000 + "end"), (11, "w" * 200_000), (11, "w" * 200_000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 AS fp", "2 AS cell", "3 AS id", "4 AS component_id")
    assert got(simhash.near_duplicates(docs)) == expected(rows)
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [1, 2, 4, 8])
def test_tiles_of_any_layout_give_the_same_components(spark, parts):
    rng = random.Random(3)
    prints = [0, (1 << 64) - 1]
    for _ in range(60):
        p = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 12])):  # chains: each step within the radius of the last
            prints.append(p)
            for b in rng.sample(range(64), rng.choice([1, 3, 4])):
                p ^= 1 << b
    prints = sorted(set(prints))
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(p,) for p in signed], "fp bigint").repartition(3)
    links = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.near_links(table, len(prints), tile=8, parts=parts).collect()]
    assert all((a ^ b).bit_count() for a, b in links)
    parent = {p: p for p in prints}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a, b in links:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    assert {p: root(p) for p in prints} == components(prints)


def test_a_dense_tile_returns_a_forest():
    base = np.uint64(0x123456789ABCDEF)
    dense = np.array([base ^ np.uint64(1 << i) for i in range(64)], np.uint64)
    a, b = simhash.tile_forest(dense, dense)
    assert len(a) <= 2 * len(dense)
    assert len(set(a.tolist())) == 1


def test_hot_groups_of_copies_and_near_copies(spark):
    words = [f"w{i}" for i in range(300)]
    texts = spark.range(3000).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") % 3 == 0, " ".join(words)).otherwise(F.concat(F.lit(" ".join(words) + " x"), (F.col("id") % 40).cast("string"))).alias("text"),
    )
    rows = [(r.doc_id, r.text) for r in texts.collect()]
    prints = {t: plain(t) for t in {t for _, t in rows}}
    part = components(prints.values())
    lowest = {}
    for i, t in rows:
        lowest.setdefault(part[prints[t]], i)
    want = sorted(((i, f"{prints[t]:016x}", lowest[part[prints[t]]]) for i, t in rows), key=repr)
    assert got(simhash.near_duplicates(texts)) == want
