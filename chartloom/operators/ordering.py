"""Exact ranks, running totals, neighbours and quantiles without one-task windows.

A window partitioned by a class or an image sends the whole group to one task.
The helpers here split each group into ordered blocks, work inside the blocks and
add per-block carries from a small table, so a group of any size stays distributed
and the result is the same as that of the plain window.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from chartloom.session import cut_lineage

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits
_ROW_MASK = (1 << _ROW_BITS) - 1
BLOCK_ROWS = 1 << 16  # rows of a group that one task ranks


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL keys meet NULL keys; the keys of ``left`` are kept."""
    keys = list(keys)
    if not keys:
        return left.crossJoin(F.broadcast(right))  # without groups the other side is one row
    other = right.select(*[F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(other, same, how).drop(*[f"_r_{k}" for k in keys])


def order_hash(key: Column | str, seed: int) -> Column:
    """Reproducible shuffle order: 32 bits of md5(key-seed) as a BIGINT."""
    key = F.col(key) if isinstance(key, str) else key
    text = F.concat(key.cast("string"), F.lit(f"-{seed}"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def hash_rank(
    df: DataFrame,
    groups: Sequence[str],
    hash_col: str,
    tie: str,
    *,
    rank_col: str = "rank",
    size_col: str | None = None,
    bits: int | None = None,
) -> DataFrame:
    """1-based rank by (hash, tie) inside each group.

    Hash values are uniform, so the top ``bits`` bits cut every group into equal
    ordered blocks; without ``bits`` they are counted from the rows, about BLOCK_ROWS to
    a block if one group holds them all. Only (group, block) counts are needed to turn
    block-local ranks into group ranks; row_number and the join share one shuffle.
    Rows of a NULL group are a group of their own.
    """
    groups = list(groups)
    if bits is None:
        bits = min(32, max(1, math.ceil(df.count() / BLOCK_ROWS)).bit_length())
    keyed = df.withColumn("_blk", F.shiftright(F.col(hash_col), 32 - bits).cast("int"))
    counts = keyed.groupBy(*groups, "_blk").agg(F.count(F.lit(1)).alias("_n"))
    by_group = Window.partitionBy(*groups)
    before = by_group.orderBy("_blk").rowsBetween(Window.unboundedPreceding, -1)
    carry = counts.select(
        *groups,
        "_blk",
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"),
        F.sum("_n").over(by_group).alias("_size"),
    )
    local = Window.partitionBy(*groups, "_blk").orderBy(hash_col, tie)
    ranked = null_safe_join(keyed, carry, [*groups, "_blk"]).withColumn(
        rank_col, (F.row_number().over(local) + F.col("_off")).cast("bigint")
    )
    if size_col:
        ranked = ranked.withColumn(size_col, F.col("_size"))
    return ranked.drop("_blk", "_off", "_size")


def global_index(df: DataFrame, order: Sequence[Column | str], *, index_col: str = "idx") -> DataFrame:
    """0-based position in the total order ``order`` (which must be unique).

    A range shuffle sorts the rows, the sorted rows are written once, and per-partition
    counts give the offsets; nothing passes through a single task.
    """
    ordered = cut_lineage(df.orderBy(*order).withColumn("_mid", F.monotonically_increasing_id()))
    part = F.shiftright(F.col("_mid"), _ROW_BITS)
    sizes = ordered.groupBy(part.alias("_pid")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # one row per shuffle partition: safe to window globally and to broadcast
    offsets = sizes.select("_pid", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    return (
        ordered.withColumn("_pid", part)
        .join(F.broadcast(offsets), "_pid")
        .withColumn(index_col, (F.col("_off") + F.col("_mid").bitwiseAND(F.lit(_ROW_MASK))).cast("bigint"))
        .drop("_pid", "_off", "_mid")
    )


def rank_in_group(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column | str],
    *,
    rank_col: str = "rank",
    size_col: str | None = None,
) -> DataFrame:
    """0-based rank of each row inside its group for an arbitrary unique order."""
    indexed = global_index(df, [*groups, *order], index_col="_idx")
    spans = indexed.groupBy(*groups).agg(F.min("_idx").alias("_first"), F.count(F.lit(1)).alias("_size"))
    ranked = null_safe_join(indexed, spans, list(groups)).withColumn(rank_col, F.col("_idx") - F.col("_first"))
    if size_col:
        ranked = ranked.withColumn(size_col, F.col("_size"))
    return ranked.drop("_idx", "_first", "_size")


def running_totals(
    df: DataFrame,
    groups: Sequence[str],
    order: Sequence[Column],
    sums: dict[str, str],
) -> DataFrame:
    """Inclusive running sums (new name -> column) along a unique order per group."""
    groups = list(groups)
    ordered = cut_lineage(
        df.orderBy(*groups, *order).withColumn("_mid", F.monotonically_increasing_id())
    ).withColumn("_pid", F.shiftright(F.col("_mid"), _ROW_BITS))
    totals = ordered.groupBy(*groups, "_pid").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    before = Window.partitionBy(*groups).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # the sort keeps a group in neighbouring partitions: at most groups + partitions rows
    carry = totals.select(
        *groups,
        "_pid",
        *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_c_{n}") for n in sums],
    )
    local = Window.partitionBy(*groups, "_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, 0)
    out = null_safe_join(ordered, carry, [*groups, "_pid"])
    for name, column in sums.items():
        out = out.withColumn(name, F.sum(column).over(local) + F.col(f"_c_{name}"))
    return out.drop("_mid", "_pid", *[f"_c_{n}" for n in sums])


def previous_row(df: DataFrame, group: str, x: str, seq: str, columns: Sequence[str]) -> DataFrame:
    """Add ``prev`` (struct of ``columns``) from the row before in (x, seq) order per group.

    Equivalent to lag() over (group order by x, seq). The rows are range-sorted and written once; inside a partition
    the window works as usual, and its first row of a group takes the last row of that group from the partition before.
    """
    ordered = cut_lineage(
        df.orderBy(group, x, seq).withColumn("_mid", F.monotonically_increasing_id())
    ).withColumn("_pid", F.shiftright(F.col("_mid"), _ROW_BITS))
    payload = F.struct(*columns)
    last = ordered.groupBy(group, "_pid").agg(F.max_by(payload, F.col("_mid")).alias("_last"))
    # a group lies in neighbouring partitions: at most groups + partitions rows
    carry = last.select(group, "_pid", F.lag("_last").over(Window.partitionBy(group).orderBy("_pid")).alias("_carry"))
    local = Window.partitionBy(group, "_pid").orderBy("_mid")
    return (
        null_safe_join(ordered, carry, [group, "_pid"])
        .withColumn("prev", F.coalesce(F.lag(payload).over(local), F.col("_carry")))
        .drop("_mid", "_pid", "_carry")
    )


_PIVOTS = 63
_HELD = 1 << 14  # values of one rank's bracket that are sorted together


_SENT = 4096  # groups whose pivots or borders every task gets
_SALTS = 32


def _beside(rows: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with the one or few rows of their group in ``small``. A group may hold any share of the rows: few groups are sent to
    every task, of many each meets its rows in ``_SALTS`` places."""
    if not keys or small.limit(_SENT + 1).count() <= _SENT:
        return null_safe_join(rows, F.broadcast(small), keys)
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64("_v", F.rand(7)), F.lit(_SALTS)).cast("int"))
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
    return null_safe_join(salted, copies, [*keys, "_salt"]).drop("_salt")


def _narrow(rows: DataFrame, keys: list[str], wanted: DataFrame, out: list[str]) -> DataFrame:
    """For each wanted rank the part of the rows between two pivots that holds it: _lo, _hi, _size and the rank inside it.

    Pivots are quantiles of a mergeable sketch, so a part holds a small share of the rows or a single value.
    """
    probs = [float((i + 1) / (_PIVOTS + 1)) for i in range(_PIVOTS)]
    pivots = cut_lineage(rows.groupBy(*keys).agg(F.percentile_approx("_v", probs, 10_000).alias("_p")))
    part = F.size(F.filter("_p", lambda p: p < F.col("_v")))
    parts = _beside(rows, pivots, keys).withColumn("_b", part).groupBy(*keys, "_b").agg(
        F.count(F.lit(1)).alias("_size"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")
    )
    # at most one row per pivot and key
    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    placed = parts.withColumn("_before", F.sum("_size").over(upto) - F.col("_size"))
    inside = (F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_size"))
    return null_safe_join(wanted, placed, keys).filter(inside).select(*out, (F.col("_rank") - F.col("_before")).alias("_rank"), "_f", "_lo", "_hi", "_size")


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str, probs: Sequence[float], *, held: int = _HELD) -> DataFrame:
    """Exact linearly interpolated quantiles per group: columns groups, q, quantile.

    Selection by rank in rounds: every round cuts what may hold a wanted rank at pivots, counts the parts and goes on with
    the one that holds it, until it is a single value or fits into ``held`` values, which are sorted. Rounds grow with the
    logarithm of the rows, and no task sees more than its share of a group.
    """
    groups = list(groups)
    rows = df.select(*groups, F.col(value).cast("double").alias("_v")).filter(F.col("_v").isNotNull())
    place = [F.lit(float(p)) * (F.col("_n") - 1) for p in probs]
    ends = [F.struct(F.lit(2 * i + up).alias("_k"), F.least(F.floor(x) + up, F.col("_n") - 1).alias("_rank"), (x - F.floor(x)).alias("_f")) for i, x in enumerate(place) for up in (0, 1)]
    sizes = rows.groupBy(*groups).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 0")
    wanted, keys, named = sizes.select(*groups, F.explode(F.array(*ends)).alias("_e")).select(*groups, "_e.*"), groups, [*groups, "_k"]
    found = None
    while True:
        brackets = cut_lineage(_narrow(rows, keys, wanted, named))
        single = brackets.filter("_lo = _hi").select(*named, "_f", F.col("_lo").alias("_value"))
        found = single if found is None else found.unionByName(single)
        spread = brackets.filter("_lo <> _hi")
        few = spread.filter(F.col("_size") <= held)
        within = lambda some: _beside(rows, some, keys).filter("_v BETWEEN _lo AND _hi")  # noqa: E731, B023
        kept = within(few).groupBy(*named, "_f", "_rank").agg(F.sort_array(F.collect_list("_v")).alias("_all"))
        found = found.unionByName(kept.select(*named, "_f", F.element_at("_all", (F.col("_rank") + 1).cast("int")).alias("_value")))
        wanted = spread.filter(F.col("_size") > held).select(*named, "_rank", "_f")
        if wanted.isEmpty():
            break
        rows, keys = cut_lineage(within(spread.filter(F.col("_size") > held)).select(*named, "_v")), named
    q = F.array(*[F.lit(float(p)) for p in probs])[F.shiftright("_k", 1)].alias("q")
    low, high = (F.max(F.when(F.col("_k") % 2 == up, F.col("_value"))) for up in (0, 1))
    both = found.groupBy(*groups, q).agg(low.alias("_a"), high.alias("_z"), F.max("_f").alias("_f"))
    return both.select(*groups, "q", (F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_f")).alias("quantile"))
