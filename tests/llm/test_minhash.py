import hashlib

import pytest

from chartloom.llm import minhash, queries


def sets(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = sets(a), sets(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def check(rows, texts):
    """``texts``: (id, text) in order."""
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts)
    by_text, off = {}, []
    for k, (i, t) in enumerate(texts):
        t, after = t or "", texts[(k + 1) % len(texts)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
        off += [r.near_edited - jaccard(t, edited), r.near_next - jaccard(t, after)]
    assert max(map(abs, off)) < 0.25 and sum(map(abs, off)) / len(off) < 0.03


@pytest.mark.parametrize("parts", [1, 7])
def test_fingerprints_of_given_documents(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        texts = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
        check(queries.op5_fingerprints(spark, "/root/testdata/sf0.001").collect(), texts)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, "a b"), (4, "ü é " * 50_000), (5, "a b"), (6, "one two three four five six")]
    docs = spark.createDataFrame(texts, "doc_id bigint, text string").selectExpr("*", "1 as part", "2 as role", "3 as fingerprint")
    rows = minhash.with_next(docs).collect()
    check(rows, texts)
    assert {r.doc_id: r.near_next for r in rows}[1] == 1.0
    assert minhash.with_next(docs.limit(0)).count() == 0
    (one,) = minhash.with_next(docs.filter("doc_id = 6")).collect()
    assert one.near_next == 1.0
    twice = spark.createDataFrame([(None, "x y"), (None, "x y"), (7, "z"), (7, "y")], "doc_id bigint, text string")
    assert sorted((r.doc_id or 0, r.n_chars) for r in minhash.with_next(twice).collect()) == [(0, 3), (0, 3), (7, 1), (7, 1)]
    prints = {r.doc_id: r.fingerprint for r in minhash.fingerprint(docs).collect()}
    assert prints == {r.doc_id: r.fingerprint for r in rows} and len(prints[1]) == 2 * minhash.PERMS
