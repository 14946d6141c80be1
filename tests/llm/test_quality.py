import numpy as np
import pyarrow as pa

from chartloom.llm import arrays as A
from chartloom.llm import quality_knn, queries


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = queries.op3_quality(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    good = got["quality"] == 1
    assert (got["predicted"] == (got["score"] >= 0.3)).all() and got["score"].between(0, 1).all()
    assert got["predicted"][good].mean() > 0.99 and got["predicted"][~good].mean() < 0.05


def test_votes_equal_brute_force():
    rng = np.random.default_rng(1)
    x = rng.random((60, quality_knn.FEATURES)).astype(np.float32) ** 4
    labels = (rng.random(60) > 0.4).astype(np.float32)
    m = quality_knn.fit_model(x, labels)
    z = m.embed(rng.random((9, quality_knn.FEATURES)).astype(np.float32) ** 4)
    got = m.vote(z)
    for row, g in zip(z, got):
        cosine = sorted(((float(row @ v), y) for v, y in zip(m.vectors, labels)), reverse=True)[: quality_knn.NEIGHBOURS]
        w = [(max(c, 0) ** quality_knn.SHARPNESS, y) for c, y in cosine]
        assert abs(g - sum(a * y for a, y in w) / sum(a for a, _ in w)) < 1e-5


def test_features_do_not_depend_on_the_slice():
    texts = ["Ab cd ab ab. x\nx\n", "", "é ü # 12", "one two three one two three", None]
    (s,) = A.slices(pa.array(texts))
    whole = quality_knn.features(s)
    for i, t in enumerate(texts):
        (one,) = A.slices(pa.array([t], pa.string()))
        assert np.allclose(quality_knn.features(one)[0], whole[i], atol=1e-5)
    assert not whole[1].any()


def test_odd_rows(spark):
    docs = spark.createDataFrame([(i, f"plain text number {i} of many") for i in range(40)] + [(40, None), (41, ""), (None, "x"), (1, "plain text number 1 of many"), (42, "wörd " * 100_000)], "doc_id bigint, text string").selectExpr("*", "1 as score", "2 as label")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(41, None)], "doc_id bigint, quality int")
    got = quality_knn.learn_and_score(docs, labels, "quality", 5, 0, 0.3).collect()
    assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id in (40, 41)}) == 1
    assert quality_knn.learn_and_score(docs.limit(0), labels, "quality", 5, 0, 0.3).count() == 0
    assert quality_knn.learn_and_score(docs, labels.limit(0), "quality", 5, 0, 0.3).first().score == 0.5
