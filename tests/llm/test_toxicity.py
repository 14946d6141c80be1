import zlib

import numpy as np
import pyarrow as pa

from chartloom.llm import arrays as A
from chartloom.llm import queries, toxicity


def auc(score, label):
    rank = np.argsort(np.argsort(score))
    n1 = label.sum()
    return (rank[label == 1].sum() - n1 * (n1 - 1) / 2) / n1 / (len(label) - n1)


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op6_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    label = got["toxic"].to_numpy()
    assert auc(got["score"].to_numpy(), label) > 0.93
    assert got["predicted"][label == 0].mean() < 0.03 and got["predicted"][label == 1].mean() > 0.5
    assert (got["predicted"] == (got["score"] >= 0.7)).all()


def test_subwords_by_hand():
    texts = ["Ab, cd ab", "", "x", " ü\nü "]
    (s,) = A.slices(pa.array(texts))
    bucket, row = toxicity.subwords(s)

    def by_hand(text):
        n = 0
        for w in text.lower().replace(",", " ").split():
            b = b" " + w.encode() + b" "
            n += sum(max(0, len(b) - k + 1) for k in toxicity.GRAMS)
        return n

    assert np.bincount(row, minlength=4).tolist() == [by_hand(t) for t in texts]
    assert 0 <= bucket.min() and bucket.max() < toxicity.BUCKETS


def test_misspelling_and_odd_rows(spark):
    rows = [(i, ("you are a horrible person" if i % 2 else "you are a friendly person") + f" w{i}", i % 2) for i in range(200)]
    docs = spark.createDataFrame([r[:2] for r in rows] + [(900, "you are a horribble persn"), (901, None), (902, ""), (None, "horrible"), (1, rows[1][1])], "doc_id bigint, text string").selectExpr("*", "1 as score", "2 as label", "3 as h")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(900, None), (None, 1)], "doc_id bigint, toxic int")
    got = toxicity.learn_and_score(docs, labels, "toxic", 3, 1, 0.7).collect()
    assert len(got) == docs.count()
    score = {r.doc_id: r.score for r in got}
    assert score[900] > 0.6 > score[0] and score[901] == score[902]
    assert all(r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 3 == 1) for r in got)
    assert toxicity.learn_and_score(docs.limit(0), labels, "toxic", 3, 1, 0.7).count() == 0
    assert toxicity.learn_and_score(docs, labels.limit(0), "toxic", 3, 1, 0.7).first().score == 0.5
