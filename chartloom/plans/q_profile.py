"""Queries on stage timings, training histories and budgets."""

from __future__ import annotations

from pyspark.sql import functions as F

from chartloom.operators import profile as P
from chartloom.plans.registry import query
from chartloom.plans.views import oracle, view


@query(
    "stage_profile",
    "A6",
    sql=oracle(
        "runs",
        """WITH s AS (SELECT stage, sum(seconds) AS t, count(*) AS n FROM v_runs GROUP BY 1),
d AS (SELECT unnest(['view', 'render', 'export']) AS stage)
SELECT coalesce(s.stage, d.stage) AS stage, round(coalesce(t, 0), 6) AS total_seconds, coalesce(n, 0) AS runs, round(coalesce(t / n, 0), 6) AS mean_seconds
FROM s FULL JOIN d ON s.stage = d.stage
UNION ALL SELECT 'overall', round(sum(t), 6), count(*), NULL FROM s""",
    ),
)
def _profile(spark, sf):
    out = P.stage_profile(view(spark, sf, "runs"), "stage", "seconds", ["view", "render", "export"])
    return out.select(
        "stage", F.round("total_seconds", 6).alias("total_seconds"), "runs", F.round("mean_seconds", 6).alias("mean_seconds")
    )


TRACK_SQL = """WITH RECURSIVE e AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY epoch) AS i FROM v_epochs),
s AS (SELECT model, CAST(0 AS BIGINT) AS i, 0 AS epoch, CAST(0 AS DOUBLE) AS value, false AS improved, CAST(-1 AS DOUBLE) AS best, 0 AS best_epoch, 0 AS stale, false AS stop
 FROM (SELECT DISTINCT model FROM v_epochs) m
 UNION ALL
 SELECT e.model, e.i, e.epoch, e.val_metric, e.val_metric > s.best + 0.002,
  CASE WHEN e.val_metric > s.best + 0.002 THEN e.val_metric ELSE s.best END,
  CASE WHEN e.val_metric > s.best + 0.002 THEN e.epoch ELSE s.best_epoch END,
  CASE WHEN e.val_metric > s.best + 0.002 THEN 0 ELSE s.stale + 1 END,
  CASE WHEN e.val_metric > s.best + 0.002 THEN false ELSE s.stale + 1 >= 8 END
 FROM s JOIN e ON e.model = s.model AND e.i = s.i + 1 WHERE NOT s.stop)
SELECT model, epoch, value, improved, best, best_epoch, stale, stop FROM s WHERE i > 0"""


@query("epoch_tracking", "W7", sql=oracle("epochs", TRACK_SQL.replace("WITH RECURSIVE ", "WITH ")).replace("WITH v_", "WITH RECURSIVE v_", 1))
def _tracking(spark, sf):
    return P.epoch_tracking(view(spark, sf, "epochs"), "model", "epoch", "val_metric", min_delta=0.002, patience=8)


@query(
    "epoch_eta",
    "W8",
    sql=oracle(
        "epochs",
        """SELECT model, epoch, round(elapsed, 6) AS elapsed, round(elapsed / d, 6) AS mean_epoch, round(greatest(0, elapsed / d * (40 - d)), 6) AS eta
FROM (SELECT model, epoch, sum(seconds) OVER w AS elapsed, count(*) OVER w AS d FROM v_epochs
 WINDOW w AS (PARTITION BY model ORDER BY epoch ROWS UNBOUNDED PRECEDING)) q""",
    ),
)
def _eta(spark, sf):
    out = P.epoch_eta(view(spark, sf, "epochs"), "model", "epoch", "seconds", 40)
    return out.select("model", "epoch", *[F.round(c, 6).alias(c) for c in ("elapsed", "mean_epoch", "eta")])


BUDGET_SQL = """WITH e AS (SELECT id, seconds AS s, row_number() OVER (ORDER BY id) AS i FROM v_runs),
r AS (SELECT CAST(0 AS BIGINT) AS i, 0 AS done, CAST(0 AS DOUBLE) AS elapsed, 150 AS target, false AS stop
 UNION ALL SELECT i, done, elapsed, goal, done >= goal OR (elapsed >= 60 AND done >= 20) FROM (
  SELECT i, done, elapsed, CASE WHEN done >= 15 AND target > 20 AND elapsed / done * target > 60
   THEN CAST(least(greatest(20, floor(60 / greatest(elapsed / done, 0.000001))), target) AS INT) ELSE target END AS goal FROM (
   SELECT e.i, r.done + 1 AS done, r.elapsed + e.s AS elapsed, r.target FROM r JOIN e ON e.i = r.i + 1 WHERE NOT r.stop AND r.i < 150) a) b)
SELECT done, round(elapsed, 6) AS elapsed, target FROM r WHERE i > 0"""


@query("budget_cutoff", "W12", sql=oracle("runs", BUDGET_SQL).replace("WITH v_", "WITH RECURSIVE v_", 1))
def _budget(spark, sf):
    out = P.budget_cutoff(view(spark, sf, "runs"), "id", "seconds", target=150, minimum=20, budget=60.0)
    return out.withColumn("elapsed", F.round("elapsed", 6))
