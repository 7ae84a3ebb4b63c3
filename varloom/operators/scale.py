"""Ordered and grouped work that never gathers an unbounded group in one task.

Chromosomes, features, labels and score values are few and uneven: any one of them may hold
a third of the rows. The helpers here split such groups by position, by value range or by hash, work
inside the pieces, and pass a short per-piece summary along.
"""

from __future__ import annotations

import math
import operator
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from varloom.session import cut_lineage

ROWS_PER_BLOCK = 1_000_000
MAX_BLOCKS = 1 << 16
HOT_ROWS = 1_000_000
POSITION_BUCKET = 1 << 18
BROADCAST_ROWS = 100_000  # rows of two numbers

_EVERYTHING = (W.unboundedPreceding, W.currentRow)
_EARLIER = (W.unboundedPreceding, -1)


def spread(df: DataFrame, key: str) -> DataFrame:
    """Shuffle by ``key`` only when a source has fewer splits than the cluster has cores.

    For costly per-row work on a few large files; a source with enough splits is returned as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def match(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which null keys meet each other."""
    other = right.withColumnsRenamed({c: f"_other_{c}" for c in on})
    same = reduce(operator.and_, [F.col(c).eqNullSafe(F.col(f"_other_{c}")) for c in on])
    return left.join(other, same, how).drop(*[f"_other_{c}" for c in on])


def reject_nulls(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``df``; a null in one of the columns is an error.

    The check is a filter, so no plan can skip it, and one that names the partition, so none moves it before other filters.
    """
    missing = reduce(operator.or_, [F.col(c).isNull() for c in columns])
    error = F.raise_error(F.lit("null among " + ", ".join(columns))).cast("boolean")
    return df.filter(F.when(missing, error).otherwise(F.spark_partition_id() >= 0))


def skew_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner", hot_rows: int = HOT_ROWS,
    counted: DataFrame | None = None,
) -> DataFrame:
    """Equi-join whose left side may have hot keys.

    Adaptive execution splits them at run time, without a count beforehand. Where the right side is partitioned by the
    key already, it cannot; callers then pass ``counted``, a frame (on, _rows) that they have anyway, and left keys
    of more than ``hot_rows`` rows are spread over slots. The list of such keys holds at most rows(left) / hot_rows entries. The
    slot comes from the row and its partition: equal rows spread too, and a task that runs again deals alike.
    """
    on = list(on)
    if counted is None:
        return left.join(right, on, how)
    listed = counted.filter(F.col("_rows") > hot_rows).select(
        *on, F.ceil(F.col("_rows") / hot_rows).cast("int").alias("_slots")
    )
    keys = listed.collect()
    if not keys:
        return left.join(right, on, how)
    hot = F.broadcast(left.sparkSession.createDataFrame(keys, listed.schema))
    slot = F.pmod(F.xxhash64(F.spark_partition_id(), *left.columns), F.col("_slots")).cast("int")
    spread = left.join(hot, on, "left").withColumn("_slot", F.coalesce(slot, F.lit(0))).drop("_slots")
    copied = right.join(hot, on, "left").withColumn(
        "_slot", F.explode(F.sequence(F.lit(0), F.coalesce("_slots", F.lit(1)) - 1))
    ).drop("_slots")
    return spread.join(copied, [*on, "_slot"], how).drop("_slot")


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join to a table that is expected to be small: adaptive execution broadcasts it if it is, and splits hot keys if not."""
    return left.join(right, list(on), how)


def counts_within(df: DataFrame, rows: int) -> bool:
    """Whether ``df`` has at most so many rows."""
    return df.limit(rows + 1).count() <= rows


# --- value order -------------------------------------------------------------------------------


def cut_points(df: DataFrame, column: str, rows: int, rows_per_block: int = ROWS_PER_BLOCK) -> list[float]:
    """At most MAX_BLOCKS - 1 values that cut ``column`` into blocks of about equal size.

    Any cut points give right results; they only decide how even the blocks are.
    """
    blocks = min(MAX_BLOCKS, -(-rows // rows_per_block))
    grid = [i / blocks for i in range(1, blocks)]
    quantiles = df.agg(F.percentile_approx(F.col(column).cast("double"), grid, max(10_000, 10 * blocks))).first()[0]
    return sorted({q for q in quantiles or [] if math.isfinite(q)})


def with_block(df: DataFrame, column: str, cuts: Sequence[float], name: str = "_block") -> DataFrame:
    """Add the block number; null comes before all values, like in an ascending sort."""
    bucketizer = Bucketizer(
        splits=[float("-inf"), *cuts, float("inf")],
        inputCol="_cut_value", outputCol="_cut_block", handleInvalid="keep",
    )
    return (
        bucketizer.transform(df.withColumn("_cut_value", F.col(column).cast("double")))
        .withColumn(name, F.coalesce(F.col("_cut_block").cast("int"), F.lit(-1)))
        .drop("_cut_value", "_cut_block")
    )


def block_by_value(df: DataFrame, column: str, rows_per_block: int = ROWS_PER_BLOCK) -> tuple[DataFrame, bool]:
    """``df`` with a ``_block`` number that rises with ``column``, and whether there is more than one.

    The frame is stored once, because the count, the cut points, the block summaries and the rows all
    read it. Up to ``rows_per_block`` rows stay one block.
    """
    stored = cut_lineage(df)
    rows = stored.count()
    if rows <= rows_per_block:
        return stored.withColumn("_block", F.lit(0)), False
    return with_block(stored, column, cut_points(stored, column, rows, rows_per_block)), True


def running_totals(
    df: DataFrame,
    order: Sequence[str],
    sums: Mapping[str, Column],
    group: Sequence[str] = (),
    descending: bool = False,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add inclusive running sums ``cum_<name>`` in the order of ``order`` within ``group``.

    ``df`` holds one row per (group, order): callers count equal values first, so that a value
    shared by a third of the input is one row here.
    """
    blocked, many = block_by_value(df, order[0], rows_per_block)
    keys = [*group, "_block"]
    ordering = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    inside = W.partitionBy(*keys).orderBy(*ordering).rowsBetween(*_EVERYTHING)
    out = blocked.withColumns({f"cum_{n}": F.sum(c).over(inside) for n, c in sums.items()})
    if many:
        # At most MAX_BLOCKS rows per group.
        block_order = F.col("_block").desc() if descending else F.col("_block").asc()
        across = W.partitionBy(*(group or [F.lit(0)])).orderBy(block_order).rowsBetween(*_EARLIER)
        carried = (
            blocked.groupBy(*keys).agg(*[F.sum(c).alias(f"_carry_{n}") for n, c in sums.items()])
            .withColumns({f"_carry_{n}": F.coalesce(F.sum(f"_carry_{n}").over(across), F.lit(0)) for n in sums})
        )
        out = (
            match(out, carried, keys)
            .withColumns({f"cum_{n}": F.col(f"cum_{n}") + F.col(f"_carry_{n}") for n in sums})
            .drop(*[f"_carry_{n}" for n in sums])
        )
    return out.drop("_block")


def neighbour(
    df: DataFrame, order: str, columns: Sequence[str], name: str, group: Sequence[str] = (),
    descending: bool = False, following: bool = True, rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Add the struct ``name`` of the given columns of the next (or previous) row, one row per (group, order)."""
    blocked, many = block_by_value(df, order, rows_per_block)
    sort = lambda c: F.col(c).desc() if descending else F.col(c).asc()
    shift = F.lead if following else F.lag
    keys, row = [*group, "_block"], F.struct(*columns)
    out = blocked.withColumn(name, shift(row).over(W.partitionBy(*keys).orderBy(sort(order))))
    if many:
        # The edge row of each block that faces the neighbouring block.
        edge = F.max_by if following == descending else F.min_by
        across = W.partitionBy(*(group or [F.lit(0)])).orderBy(sort("_block"))
        # The block of null orders has one row, which no least or largest order finds.
        ends = F.coalesce(edge(row, order), F.first(row)).alias("_edge")
        edges = blocked.groupBy(*keys).agg(ends).withColumn("_edge", shift("_edge").over(across))
        out = match(out, edges, keys).withColumn(name, F.coalesce(name, "_edge")).drop("_edge")
    return out.drop("_block")


def global_row_number(
    df: DataFrame, order: str, key: str, name: str = "rank", descending: bool = False,
    rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Dense 1..n numbering by (order, key) without sorting everything in one task; null is the lowest value.

    Rows with the same ``order`` value are further cut by ranges of the unique ``key``, so a value
    that holds a third of the rows is numbered by many tasks.
    """
    sort = F.col(order).desc() if descending else F.col(order).asc()
    stored = cut_lineage(df)
    per_value = stored.groupBy(order).agg(F.count(F.lit(1)).alias("_n"))
    rows, hottest = per_value.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.max("_n"), F.lit(0))).first()
    if rows <= rows_per_block:
        return stored.withColumn(name, F.row_number().over(W.partitionBy(F.lit(0)).orderBy(sort, key)).cast("long"))
    keyed = stored.withColumn("_key_block", F.lit(0))
    if hottest > rows_per_block:
        keyed = with_block(stored, key, cut_points(stored, key, rows, rows_per_block), "_key_block")
    counts = keyed.groupBy(order, "_key_block").agg(F.count(F.lit(1)).alias("_n"))
    placed = running_totals(
        counts.withColumn("_dir", F.col("_key_block") * (-1 if descending else 1)),
        [order, "_dir"], {"n": F.col("_n")}, descending=descending, rows_per_block=rows_per_block,
    ).select(order, "_key_block", (F.col("cum_n") - F.col("_n")).alias("_before"))
    inside = W.partitionBy(order, "_key_block").orderBy(key)
    return (
        match(keyed, placed, [order, "_key_block"])
        .withColumn(name, F.col("_before") + F.row_number().over(inside))
        .drop("_before", "_key_block")
    )


def exact_percentiles(
    df: DataFrame, group: Sequence[str], value: str, probabilities: Mapping[str, float],
    weight: str | None = None, rows_per_block: int = ROWS_PER_BLOCK,
) -> DataFrame:
    """Exact percentiles with linear interpolation, one row per group, from a value histogram."""
    group = list(group)
    rows = F.sum(weight) if weight else F.count(F.lit(1))
    counts = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(rows.alias("_n"))
    totals = counts.groupBy(*group).agg(F.sum("_n").alias("_total"))
    ranked = running_totals(counts, [value], {"n": F.col("_n")}, group, rows_per_block=rows_per_block)
    ranked = match(ranked, totals, group) if group else ranked.crossJoin(F.broadcast(totals))
    last = F.col("_total") - 1
    holds = lambda i: (F.col("cum_n") - F.col("_n") <= i) & (i < F.col("cum_n"))
    picks = []
    for name, p in probabilities.items():
        low = F.floor(last * F.lit(p))
        picks += [
            F.max(F.when(holds(low), F.col(value))).cast("double").alias(f"_lo_{name}"),
            F.max(F.when(holds(F.least(low + 1, last)), F.col(value))).cast("double").alias(f"_hi_{name}"),
        ]
    picked = ranked.groupBy(*group, "_total").agg(*picks)
    between = lambda name, p: F.col(f"_lo_{name}") + (
        last * F.lit(p) - F.floor(last * F.lit(p))
    ) * (F.col(f"_hi_{name}") - F.col(f"_lo_{name}"))
    return picked.select(*group, *[between(n, p).alias(n) for n, p in probabilities.items()])


# --- hash order --------------------------------------------------------------------------------


def hash_order(seed: int | str, *keys: str) -> Column:
    """Reproducible random order: md5 of the seed and the row key."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in keys]))


def hash_rank(
    df: DataFrame, seed: int | str, keys: Sequence[str], group: Sequence[str] = (),
    name: str = "rank", keep: Column | None = None, digits: int = 4,
) -> DataFrame:
    """1..n in hash order within each group, a null group being one of its own.

    The first hex ``digits`` split a group in 16**digits even parts. With ``keep`` (rows wanted per group), parts that start
    after the quota are dropped before sorting.
    """
    # A struct is never null, so the group's rows meet whatever it holds.
    hashed = df.withColumn("_hash", hash_order(seed, *keys)).withColumn("_part", F.substring("_hash", 1, digits)).withColumn(
        "_group", F.struct(F.lit(0).alias("_"), *group)
    )
    parts = ["_group", "_part"]
    across = W.partitionBy("_group").orderBy("_part").rowsBetween(*_EARLIER)
    before = (
        hashed.groupBy(*parts).agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", F.coalesce(F.sum("_n").over(across), F.lit(0))).drop("_n")
    )
    placed = hashed.join(before, parts)
    if keep is not None:
        placed = placed.filter(F.col("_before") < keep)
    inside = W.partitionBy(*parts).orderBy("_hash", *keys)
    ranked = placed.withColumn(name, F.col("_before") + F.row_number().over(inside)).drop("_hash", "_part", "_before", "_group")
    return ranked if keep is None else ranked.filter(F.col(name) <= keep)


def top_n_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, slots: int = 64) -> DataFrame:
    """The first n rows per group, for small n: a first cut inside hash slots, then one over the survivors."""
    slotted = df.withColumn("_slot", F.pmod(F.xxhash64(*df.columns), F.lit(slots)))
    first = W.partitionBy(*group, "_slot").orderBy(*order)
    final = W.partitionBy(*group).orderBy(*order)
    return (
        slotted.withColumn("_rank", F.row_number().over(first)).filter(F.col("_rank") <= n)
        .withColumn("_rank", F.row_number().over(final)).filter(F.col("_rank") <= n)
        .drop("_slot", "_rank")
    )


# --- position order ----------------------------------------------------------------------------


def position_bucket(position: str | Column, width: int = POSITION_BUCKET) -> Column:
    return F.floor(F.col(position) / width) if isinstance(position, str) else F.floor(position / width)


def bucket_carry(
    df: DataFrame, keys: Sequence[str], before: Mapping[str, tuple] | None = None,
    after: Mapping[str, tuple] | None = None,
) -> DataFrame:
    """Per (keys, _bucket): values combined over all earlier and all later buckets.

    Each entry is name -> (aggregate, column) with an aggregate that combines with itself
    (sum, max, min). A chromosome has length / POSITION_BUCKET buckets at most.
    """
    before, after = before or {}, after or {}
    pieces = df.groupBy(*keys, "_bucket").agg(
        *[fn(column).alias(name) for name, (fn, column) in {**before, **after}.items()]
    )
    upward, downward = (W.partitionBy(*keys).orderBy(order).rowsBetween(*_EARLIER) for order in (F.asc("_bucket"), F.desc("_bucket")))
    return pieces.withColumns({
        **{name: fn(name).over(upward) for name, (fn, _) in before.items()},
        **{name: fn(name).over(downward) for name, (fn, _) in after.items()},
    })


def position_scan(
    df: DataFrame, keys: Sequence[str], position: str,
    before: Mapping[str, tuple] | None = None, after: Mapping[str, tuple] | None = None,
    following: Mapping[str, tuple] | None = None, width: int = POSITION_BUCKET,
) -> DataFrame:
    """Running aggregates along a coordinate.

    ``before`` accumulates from the left and ``after`` from the right, both with the row itself;
    ``following`` from the right without it. ``df`` holds one row per (keys, position), so a bucket
    holds at most ``width`` rows however hot a position is. It is stored once: the bucket
    summaries and the rows both read it, and scans of scans stay linear. Null keys or positions are an error.
    """
    before, after, following = before or {}, after or {}, following or {}
    rightward = {**after, **following}
    bucketed = cut_lineage(reject_nulls(df, [*keys, position]).withColumn("_bucket", position_bucket(position, width)))
    # Values from the right run over the descending order: a frame up to the last row would be read again for every row.
    upward, downward = (W.partitionBy(*keys, "_bucket").orderBy(order) for order in (F.asc(position), F.desc(position)))
    frames = {
        **{n: (*v, upward.rowsBetween(*_EVERYTHING)) for n, v in before.items()},
        **{n: (*v, downward.rowsBetween(*_EVERYTHING)) for n, v in after.items()},
        **{n: (*v, downward.rowsBetween(*_EARLIER)) for n, v in following.items()},
    }
    carried = bucket_carry(
        bucketed, keys,
        {f"_carry_{n}": v for n, v in before.items()}, {f"_carry_{n}": v for n, v in rightward.items()},
    )
    zero = F.lit(0)
    combine = {
        F.sum: lambda a, b: F.coalesce(a, zero) + F.coalesce(b, zero), F.max: F.greatest, F.min: F.least,
    }
    return (
        bucketed.withColumns({f"_in_{n}": fn(column).over(frame) for n, (fn, column, frame) in frames.items()})
        .join(carried, [*keys, "_bucket"])
        .withColumns({n: combine[fn](F.col(f"_in_{n}"), F.col(f"_carry_{n}")) for n, (fn, _, _) in frames.items()})
        .drop("_bucket", *[f"_in_{n}" for n in frames], *[f"_carry_{n}" for n in frames])
    )


# --- ranges as aligned blocks --------------------------------------------------------------------


def with_aligned_blocks(df: DataFrame, low: Column, high: Column, levels: int) -> DataFrame:
    """One row per block (level, block) of the disjoint blocks of 2**level cells that make up [low, high).

    About 2 * log2(high - low) rows. Two ranges, or a range and a point, meet by equality on (level, block),
    with no all-pairs test. Blocks above ``levels`` - 1 are not used.
    """
    first, last = F.col("_first"), F.col("_last")
    odd_ends = F.array(F.when(first % 2 == 1, first), F.when(last % 2 == 1, last - 1))
    return (
        df.withColumns({"_low": low.cast("long"), "_high": high.cast("long")}).filter("_low < _high")
        .withColumn("_top", F.least(F.floor(F.log2(F.col("_high") - F.col("_low"))), F.lit(levels - 1)).cast("int"))
        .withColumn("level", F.explode(F.sequence(F.lit(0), F.col("_top"))))
        .withColumn("_first", F.expr("shiftright(_low + shiftleft(1L, level) - 1, level)"))
        .withColumn("_last", F.expr("shiftright(_high, level)"))
        .filter(first < last)
        # Ends that do not fill a block of the next level stay here; the top level takes what is left.
        .withColumn("block", F.explode(F.when(F.col("level") == F.col("_top"), F.sequence(first, last - 1)).otherwise(odd_ends)))
        .filter("block is not null").drop("_low", "_high", "_top", "_first", "_last")
    )


def enclosing_blocks(cell: Column, levels: int) -> Column:
    """Every aligned block that holds ``cell``, one per level."""
    return F.array(*[
        F.struct(F.lit(level).alias("level"), F.floor(cell / (1 << level)).cast("long").alias("block"))
        for level in range(levels)
    ])
