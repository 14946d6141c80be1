import random

import pytest
from pyspark.sql import functions as F

from chartloom.operators import profile as P


def plain(history, min_delta, patience):
    best, best_epoch, stale, out = -1.0, 0, 0, []
    for epoch, v in history:
        better = v is not None and v > best + min_delta
        best, best_epoch, stale = (v, epoch, 0) if better else (best, best_epoch, stale + 1)
        out.append((epoch, v, better, best, best_epoch, stale, stale >= patience))
        if stale >= patience:
            break
    return out


@pytest.mark.parametrize("bits", [1, 3, 13])
def test_tracking_of_any_cut(spark, monkeypatch, bits):
    monkeypatch.setattr(P, "_PIECE_BITS", bits)
    rnd = random.Random(bits)
    rows, want = [], {}
    for m in range(6):
        history = [(e, None if rnd.random() < 0.05 else round(rnd.random() * 0.2 + 0.01 * e * (m % 3), 3)) for e in range(1, 40 + m)]
        model = None if m == 5 else f"m{m}"
        want[model] = plain(history, 0.01, 4 + 3 * m)
        rows = [*rows, *((model, e, v, 4 + 3 * m) for e, v in history)]
    df = spark.createDataFrame(rows, "model string, epoch int, v double, patience int").repartition(4)
    for m in range(6):
        mine = df.filter(F.col("patience") == 4 + 3 * m)
        got = P.epoch_tracking(mine, "model", "epoch", "v", min_delta=0.01, patience=4 + 3 * m).collect()
        model = None if m == 5 else f"m{m}"
        assert sorted(tuple(r)[1:] for r in got) == [tuple(x) for x in want[model]] and {r.model for r in got} == {model}
    assert P.epoch_tracking(df.limit(0), "model", "epoch", "v").count() == 0


def test_one_model_with_very_many_epochs(spark):
    n = 300_000
    df = spark.range(n).selectExpr("'m' AS model", "CAST(id AS INT) AS epoch", "CAST(id AS DOUBLE) / 1000 AS v", "1D AS seconds")
    out = P.epoch_tracking(df, "model", "epoch", "v", min_delta=0.0095, patience=50)
    r = out.agg(F.count("*").alias("n"), F.count_if("improved").alias("up"), F.max("stale").alias("stale"), F.max("best").alias("best")).first()
    assert (r.n, r.up, r.stale) == (n, n // 10, 9) and r.best == pytest.approx(299.99)
    last = P.epoch_eta(df, "model", "epoch", "seconds", n + 5).filter(F.col("epoch") == n - 1).first()
    assert (last.elapsed, last.mean_epoch, last.eta) == (n, 1.0, 5.0)
