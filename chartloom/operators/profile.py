"""Stage timings, training histories and runtime budgets."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chartloom.operators.ordering import null_safe_join, running_totals
from chartloom.session import cut_lineage


def stage_profile(df: DataFrame, stage: str, seconds: str, declared: Sequence[str] = ()) -> DataFrame:
    """Total, count and mean per stage; declared stages without data read 0.

    The row 'overall' holds the grand total and, as count, the number of stages seen.
    """
    seen = df.groupBy(F.col(stage).alias("stage")).agg(
        F.sum(F.col(seconds).cast("double")).alias("total_seconds"), F.count(F.lit(1)).alias("runs")
    )
    names = df.sparkSession.createDataFrame([(s,) for s in declared], "stage string")
    zero = F.lit(0.0)
    stages = names.join(seen, "stage", "full").select(
        "stage",
        F.coalesce("total_seconds", zero).alias("total_seconds"),
        F.coalesce("runs", F.lit(0)).cast("bigint").alias("runs"),
        F.coalesce(F.col("total_seconds") / F.col("runs"), zero).alias("mean_seconds"),
    )
    overall = seen.agg(
        F.coalesce(F.sum("total_seconds"), zero).alias("total_seconds"), F.count(F.lit(1)).alias("runs")
    ).select(F.lit("overall").alias("stage"), "total_seconds", "runs", F.lit(None).cast("double").alias("mean_seconds"))
    return stages.unionByName(overall)


_PIECE_BITS = 13  # epochs of a model are folded in pieces of up to 2**13


def improvements(values: np.ndarray, best: float, min_delta: float) -> np.ndarray:
    """Places at which the accepted best changes, from an incoming best: each beats the one before by more than ``min_delta``."""
    before = np.concatenate([[-np.inf], np.maximum.accumulate(values)[:-1]])
    records = np.flatnonzero(values > before)  # nothing else can beat an accepted best
    out, held = [], values[records]
    at = int(np.searchsorted(held, best + min_delta, "right"))
    while at < len(held):
        out.append(records[at])
        at = int(np.searchsorted(held, held[at] + min_delta, "right"))
    return np.array(out, np.int64)


def _run(values: np.ndarray, best: float, stale: int, min_delta: float, patience: int) -> tuple[np.ndarray, np.ndarray, int]:
    """For one piece and its incoming state: place of the accepted best (-1: the incoming one) and epochs without improvement
    after every row, and the number of rows up to the early stop."""
    n = len(values)
    found = improvements(values, best, min_delta)
    place = np.full(n, -1)
    place[found] = found
    place = np.maximum.accumulate(place) if n else place
    waited = np.where(place < 0, stale + 1 + np.arange(n), np.arange(n) - place)
    late = np.flatnonzero(waited >= patience)
    return place, waited, int(late[0]) + 1 if len(late) else n


def epoch_tracking(
    df: DataFrame, model: str, epoch: str, metric: str, *, min_delta: float = 0.0, patience: int = 5
) -> DataFrame:
    """Best value so far, improvement flag and epochs without improvement, up to the early stop.

    An epoch improves if it beats the last *accepted* best by more than ``min_delta``; a missing value never does. The
    epochs are sorted once and cut into pieces. Only rising records of a piece can be accepted, so they stand for the piece
    when the state is carried from piece to piece; then the rows of all pieces are replayed, each from its own state.
    """
    kind = df.schema[model].dataType.simpleString()
    rows = df.select(F.col(model).alias("model"), F.col(epoch).cast("int").alias("epoch"), F.col(metric).cast("double").alias("value"))
    ordered = cut_lineage(rows.orderBy("model", "epoch").withColumn("mid", F.monotonically_increasing_id()))
    pieces = ordered.withColumn("piece", F.shiftright("mid", _PIECE_BITS))
    low = -np.inf  # stands for a missing value

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("mid")
        v = part["value"].fillna(low).to_numpy()
        up = np.flatnonzero(v > np.concatenate([[low], np.maximum.accumulate(v)[:-1]]))
        return pd.DataFrame({"model": part["model"].iloc[:1], "piece": part["piece"].iloc[:1], "n": [len(v)], "at": [up], "value": [v[up]], "epoch": [part["epoch"].to_numpy()[up]]})

    def carry(folded: pd.DataFrame) -> pd.DataFrame:
        folded = folded.sort_values("piece")
        best, best_epoch, stale, stopped, out = -1.0, 0, 0, False, []
        for piece, n, at, value, epochs in zip(folded["piece"], folded["n"], folded["at"], folded["value"], folded["epoch"]):
            if stopped:
                break
            out.append((piece, best, best_epoch, stale))
            v = np.full(n, low)
            v[at] = value
            place, waited, upto = _run(v, best, stale, min_delta, patience)
            stopped, stale = bool(waited[upto - 1] >= patience), int(waited[upto - 1])
            if place[upto - 1] >= 0:
                k = int(np.searchsorted(at, place[upto - 1]))
                best, best_epoch = float(value[k]), int(epochs[k])
        table = pd.DataFrame(out, columns=["piece", "best", "best_epoch", "stale"])
        table.insert(0, "model", folded["model"].iloc[0])
        return table

    def replay(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("mid").reset_index(drop=True)
        place, waited, upto = _run(part["value"].fillna(low).to_numpy(), part["best"][0], int(part["stale"][0]), min_delta, patience)
        own = place >= 0
        out = part[["model", "epoch", "value"]].copy()
        out["improved"] = place == np.arange(len(part))
        out["best"] = np.where(own, part["value"].to_numpy()[place], part["best"])
        out["best_epoch"] = np.where(own, part["epoch"].to_numpy()[place], part["best_epoch"])
        out["stale"], out["stop"] = waited, waited >= patience
        return out.iloc[:upto]

    folded = pieces.groupBy("model", "piece").applyInPandas(fold, f"model {kind}, piece bigint, n int, at array<int>, value array<double>, epoch array<int>")
    states = folded.groupBy("model").applyInPandas(carry, f"model {kind}, piece bigint, best double, best_epoch int, stale int")
    told = null_safe_join(pieces, states, ["model", "piece"])
    schema = f"model {kind}, epoch int, value double, improved boolean, best double, best_epoch int, stale int, stop boolean"
    return told.groupBy("model", "piece").applyInPandas(replay, schema).withColumnRenamed("model", model)


def epoch_eta(df: DataFrame, model: str, epoch: str, seconds: str, total_epochs: int) -> DataFrame:
    """Elapsed time, mean time per epoch and remaining time after every epoch."""
    rows = df.select(model, epoch, F.col(seconds).alias("_s"), F.lit(1).cast("bigint").alias("_1"))
    done = running_totals(rows, [model], [F.col(epoch)], {"elapsed": "_s", "_d": "_1"})
    return done.select(
        model,
        epoch,
        "elapsed",
        (F.col("elapsed") / F.col("_d")).alias("mean_epoch"),
        F.greatest(F.lit(0.0), F.col("elapsed") / F.col("_d") * (F.lit(total_epochs) - F.col("_d"))).alias("eta"),
    )


def budget_cutoff(
    df: DataFrame,
    order: str,
    seconds: str,
    *,
    target: int = 150,
    minimum: int = 100,
    warmup: int = 15,
    budget: float = 1500.0,
) -> DataFrame:
    """Which of the first ``target`` rows run within the budget.

    After ``warmup`` rows the target shrinks to max(minimum, budget / mean) whenever
    mean * target exceeds the budget; the run stops at the target, or at the budget once the
    minimum is met. Later rows never matter, so only the first ``target`` rows are folded.
    """
    first = df.orderBy(order).limit(target).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(seconds).cast("double").alias("s")))).alias("_h")
    )
    state_type = "struct<done:int,elapsed:double,target:int,stop:boolean,rows:array<struct<done:int,elapsed:double,target:int>>>"
    start = F.expr(
        f"CAST(named_struct('done', 0, 'elapsed', 0.0D, 'target', {target}, 'stop', false, 'rows', array()) AS {state_type})"
    )

    def step(s, e):
        done = s["done"] + 1
        elapsed = s["elapsed"] + e["s"]
        mean = elapsed / done
        shrunk = F.least(F.greatest(F.lit(minimum), F.floor(F.lit(budget) / F.greatest(mean, F.lit(1e-6))).cast("int")), s["target"])
        late = (done >= warmup) & (s["target"] > minimum) & (mean * s["target"] > budget)
        goal = F.when(late, shrunk).otherwise(s["target"])
        stop = (done >= goal) | ((elapsed >= budget) & (done >= minimum))
        row = F.struct(done.alias("done"), elapsed.alias("elapsed"), goal.alias("target"))
        nxt = F.struct(done.alias("done"), elapsed.alias("elapsed"), goal.alias("target"), stop.alias("stop"),
                       F.concat(s["rows"], F.array(row)).alias("rows"))
        return F.when(s["stop"], s).otherwise(nxt.cast(state_type))

    return first.select(F.aggregate("_h", start, step).alias("_s")).select(F.explode("_s.rows").alias("r")).select("r.*")
