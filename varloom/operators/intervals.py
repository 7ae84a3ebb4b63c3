"""Interval algebra on half-open [start, end) coordinates.

Nothing here joins intervals with intervals. Counts, coverage and nearest neighbours come from
running sums along the coordinate, so a region crowded with intervals costs one sort, not all pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F, types as T

from varloom.operators.scale import (
    POSITION_BUCKET, exact_percentiles, lookup_join, match, position_bucket, position_scan, reject_nulls, skew_join,
)
from varloom.session import cut_lineage


def merge_intervals(
    df: DataFrame, keys: Sequence[str] = ("chrom",), gap: int = 0, width: int = POSITION_BUCKET
) -> DataFrame:
    """Islands of overlapping or book-ended intervals (or up to ``gap`` apart), with their count ``n``.

    Null keys or borders are an error.
    """
    keys = list(keys)
    piece = [*keys, "_bucket"]
    starts = (
        reject_nulls(df, [*keys, "start", "end"]).groupBy(*keys, "start").agg(F.max("end").alias("end"), F.count(F.lit(1)).alias("n"))
        .withColumn("_bucket", position_bucket("start", width))
    )
    inside = W.partitionBy(*piece).orderBy("start")
    opens = lambda reach: reach.isNull() | (F.col("start") > reach + gap)
    # Islands of each bucket by itself; they are grouped where the window left them.
    local = cut_lineage(
        starts.withColumn("_prior", F.max("end").over(inside.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("_open", F.when(opens(F.col("_prior")), F.col("start")))
        .withColumn("_local", F.max("_open").over(inside.rowsBetween(W.unboundedPreceding, 0)))
        .groupBy(*piece, F.col("_local").alias("start")).agg(F.max("end").alias("end"), F.sum("n").alias("n"))
    )
    # A bucket's last island opens one of its own unless an earlier bucket reaches it, and then no island before it does.
    earlier = W.partitionBy(*keys).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    buckets = (
        local.groupBy(*piece).agg(F.max("end").alias("_end"), F.max("start").alias("start"))
        .withColumn("_reach", F.max("_end").over(earlier))
        .withColumn("_open", F.when(opens(F.col("_reach")), F.col("start")))
        .select(*piece, "_reach", F.max("_open").over(earlier).alias("_latest"))
    )
    island = F.when(opens(F.col("_reach")), F.col("start")).otherwise(F.col("_latest"))
    return (
        local.join(buckets, piece).withColumn("_island", island)
        .groupBy(*keys, F.col("_island").alias("start"))
        .agg(F.max("end").alias("end"), F.sum("n").alias("n"))
    )


def multi_intersect(
    df: DataFrame, keys: Sequence[str] = ("chrom",), sample: str = "sample", width: int = POSITION_BUCKET
) -> DataFrame:
    """Segments between consecutive breakpoints with the number ``n`` of samples that cover them."""
    keys = list(keys)
    merged = merge_intervals(df, [*keys, sample], width=width)
    points = (
        merged.select(*keys, F.explode(F.array(
            F.struct(F.col("start").alias("pos"), F.lit(1).alias("step")),
            F.struct(F.col("end").alias("pos"), F.lit(-1).alias("step")),
        )).alias("p"))
        .groupBy(*keys, F.col("p.pos").alias("pos")).agg(F.sum("p.step").alias("step"))
    )
    scanned = position_scan(
        points, keys, "pos", before={"n": (F.sum, F.col("step"))}, following={"next_pos": (F.min, F.col("pos"))}, width=width
    )
    return scanned.filter("n > 0").select(*keys, F.col("pos").alias("start"), F.col("next_pos").alias("end"), "n")


def consensus(
    df: DataFrame, keys: Sequence[str] = ("chrom",), feature: str = "feature", sample: str = "sample",
    width: int = POSITION_BUCKET,
) -> DataFrame:
    """Regions covered by at least half (rounded up) of a feature's samples, merged."""
    needed = df.groupBy(feature).agg(F.ceil(F.countDistinct(sample) / 2).alias("_needed"))
    segments = multi_intersect(df, [feature, *keys], sample, width)
    kept = lookup_join(segments, needed, [feature]).filter(F.col("n") >= F.col("_needed"))
    return merge_intervals(kept.select(feature, *keys, "start", "end"), [feature, *keys], width=width).drop("n")


def centres(df: DataFrame) -> DataFrame:
    """The one-base middle of every interval."""
    middle = F.floor((F.col("start") + F.col("end")) / 2)
    return df.withColumn("_middle", middle).withColumn("start", F.col("_middle")).withColumn("end", F.col("_middle") + 1).drop("_middle")


def _points(df: DataFrame, keys: Sequence[str], position: str, **values) -> DataFrame:
    """Rows for a coverage scan: a position with the given contributions, zero for the others."""
    names = ("starts", "ends", "slope", "offset", "asked")
    return df.select(*keys, F.col(position).alias("pos"), *[F.lit(values.get(n, 0)).cast("long").alias(n) for n in names])


def coverage(
    bins: DataFrame, intervals: DataFrame, keys: Sequence[str] = ("chrom",), width: int = POSITION_BUCKET
) -> DataFrame:
    """Per bin: raw intervals that overlap it, bases covered by their union, length, fraction, percent.

    overlaps = intervals that start before the bin's end - intervals that end by its start;
    covered = C(end) - C(start), where C(x) is the union length left of x, piecewise linear in x.
    """
    keys = list(keys)
    union = merge_intervals(intervals.select(*keys, "start", "end"), keys, width=width)
    asked = bins.select(*keys, F.explode(F.array("start", "end")).alias("at"))
    points = (
        _points(intervals, keys, "start", starts=1)
        .unionByName(_points(intervals, keys, "end", ends=1))
        .unionByName(_points(union, keys, "start", slope=1, offset=F.col("start")))
        .unionByName(_points(union, keys, "end", slope=-1, offset=-F.col("end")))
        .unionByName(_points(asked, keys, "at", asked=1))
        .groupBy(*keys, "pos")
        .agg(*[F.sum(c).alias(c) for c in ("starts", "ends", "slope", "offset")], F.max("asked").alias("asked"))
    )
    scanned = position_scan(points, keys, "pos", before={
        f"sum_{c}": (F.sum, F.col(c)) for c in ("starts", "ends", "slope", "offset")
    }, width=width).filter("asked = 1").select(
        *keys, "pos",
        (F.col("sum_starts") - F.col("starts")).alias("started"),
        F.col("sum_ends").alias("ended"),
        (F.col("pos") * F.col("sum_slope") - F.col("sum_offset")).alias("covered"),
    )
    left = scanned.select(*keys, F.col("pos").alias("start"), F.col("ended"), F.col("covered").alias("_c0"))
    right = scanned.select(*keys, F.col("pos").alias("end"), F.col("started"), F.col("covered").alias("_c1"))
    length = F.col("end") - F.col("start")
    by_end = bins.groupBy(*keys, "end").agg(F.count(F.lit(1)).alias("_rows"))
    return (
        skew_join(skew_join(bins, left, [*keys, "start"]), right, [*keys, "end"], counted=by_end)
        .withColumn("num_overlaps", F.col("started") - F.col("ended"))
        .withColumn("bases_covered", F.col("_c1") - F.col("_c0"))
        .withColumn("interval_length", length)
        .withColumn("fraction_covered", F.col("bases_covered") / F.col("interval_length"))
        .withColumn("percent_covered", F.col("fraction_covered") * 100)
        .drop("started", "ended", "_c0", "_c1")
    )


def depth_at(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str] = ("chrom",), position: str = "pos0",
    width: int = POSITION_BUCKET,
) -> DataFrame:
    """Number of intervals over each distinct position."""
    keys = list(keys)
    steps = (
        intervals.select(*keys, F.col("start").alias(position), F.lit(1).alias("_step"), F.lit(0).alias("_asked"))
        .unionByName(intervals.select(*keys, F.col("end").alias(position), F.lit(-1).alias("_step"), F.lit(0).alias("_asked")))
        .unionByName(points.select(*keys, position, F.lit(0).alias("_step"), F.lit(1).alias("_asked")))
        .groupBy(*keys, position).agg(F.sum("_step").alias("_step"), F.max("_asked").alias("_asked"))
    )
    scanned = position_scan(steps, keys, position, before={"depth": (F.sum, F.col("_step"))}, width=width)
    return scanned.filter("_asked = 1").select(*keys, position, "depth")


def outside_intervals(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str] = ("chrom",), position: str = "pos0",
    width: int = POSITION_BUCKET,
) -> DataFrame:
    """Points that lie in no interval."""
    free = depth_at(points, intervals, keys, position, width).filter("depth = 0").drop("depth")
    return skew_join(points, free, [*keys, position])


def asof_last(
    points: DataFrame, table: DataFrame, keys: Sequence[str], position: str, values: Sequence[str],
    width: int = POSITION_BUCKET,
) -> DataFrame:
    """For each distinct point the ``values`` of the last table row at or before it.

    The table has one row per (keys, position); its position comes along as ``found``.
    """
    keys = list(keys)
    payload = F.struct(F.col(position).alias("found"), *[F.col(v) for v in values])
    rows = (
        table.select(*keys, position, payload.alias("_row"), F.lit(0).alias("_asked"))
        .unionByName(points.select(*keys, position, F.lit(1).alias("_asked")), allowMissingColumns=True)
        .groupBy(*keys, position).agg(F.max("_row").alias("_row"), F.max("_asked").alias("_asked"))
    )
    scanned = position_scan(rows, keys, position, before={"_last": (F.max, F.col("_row"))}, width=width)
    return scanned.filter("_asked = 1").select(*keys, position, "_last.*")


def nearest_feature(
    centres_df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("chrom",), width: int = POSITION_BUCKET
) -> DataFrame:
    """For every centre of every feature, the nearest centre of each other feature.

    One scan serves all ordered pairs: each position carries, per feature, the last centre to the
    left and the first to the right. Ties go to the left one; no centre on the chromosome gives -1.
    """
    keys = list(keys)
    ids = {f: i for i, f in enumerate(features)}
    seen = centres_df.groupBy(*keys, "start").agg(
        *[F.max(F.when(F.col("feature") == f, F.col("start"))).alias(f"_at{i}") for f, i in ids.items()]
    )
    scanned = position_scan(
        seen, keys, "start",
        before={f"_left{i}": (F.max, F.col(f"_at{i}")) for i in ids.values()},
        after={f"_right{i}": (F.min, F.col(f"_at{i}")) for i in ids.values()},
        width=width,
    )

    def pair(a, b):
        left, right = F.col(f"_left{ids[b]}"), F.col(f"_right{ids[b]}")
        take_left = left.isNotNull() & (right.isNull() | (F.col("start") - left <= right - F.col("start")))
        found = F.when(take_left, left).otherwise(right)
        return F.when(F.col(f"_at{ids[a]}").isNotNull(), F.struct(
            F.lit(a).alias("anchor"), F.lit(b).alias("feature"), F.coalesce(found, F.lit(-1)).alias("nearest"),
            F.coalesce(F.abs(found - F.col("start")), F.lit(-1)).alias("distance"),
        ))

    pairs = F.filter(F.array(*[pair(a, b) for a in features for b in features if a != b]), lambda p: p.isNotNull())
    return scanned.select(*keys, "start", F.explode(pairs).alias("p")).select("p.anchor", "p.feature", *keys, "start", "p.nearest", "p.distance")


def nearest_intervals(
    df: DataFrame, features: Sequence[str], keys: Sequence[str] = ("chrom",), width: int = POSITION_BUCKET
) -> DataFrame:
    """For every interval of every feature, the nearest interval of each other feature, whatever their widths.

    Overlap is distance 0 and book-ended 1; no interval on the chromosome gives -1. Of equally near ones the one with the
    smallest start counts. One scan serves all ordered pairs: each start carries, per feature, the last end to the left,
    and the first interval by start that ends behind it, which either overlaps or is the nearest to the right. Only
    intervals that reach further than all before them can be that first one, and among these ends rise with starts.
    """
    keys = list(keys)
    ids = {f: i for i, f in enumerate(features)}
    known = df.filter(F.col("feature").isin(list(features)))
    longest = known.groupBy(*keys, "feature", "start").agg(F.max("end").alias("end"))
    reached = position_scan(longest, [*keys, "feature"], "start", before={"_reach": (F.max, F.col("end"))}, width=width)
    far = reached.filter("end = _reach").groupBy(*keys, "feature", "end").agg(F.min("start").alias("_far"))
    near = known.groupBy(*keys, "feature", "end").agg(F.min("start").alias("_near"))
    marks = match(near, far, [*keys, "feature", "end"], "left").withColumnRenamed("end", "_pos")
    asked = known.select(*keys, F.col("start").alias("_pos"), F.lit(True).alias("_asked")).distinct()
    of = lambda f, column: F.max(F.when((F.col("feature") == f) & F.col(column).isNotNull(), F.struct("_pos", F.col(column).alias("start"))))
    rows = marks.unionByName(asked, allowMissingColumns=True).groupBy(*keys, "_pos").agg(
        F.max("_asked").alias("_asked"), *[of(f, c).alias(f"{c}{i}") for f, i in ids.items() for c in ("_near", "_far")]
    )
    scanned = position_scan(
        rows, keys, "_pos", before={f"_left{i}": (F.max, F.col(f"_near{i}")) for i in ids.values()},
        following={f"_next{i}": (F.min, F.col(f"_far{i}")) for i in ids.values()}, width=width,
    ).filter("_asked").select(*keys, F.col("_pos").alias("start"), *[f"{c}{i}" for i in ids.values() for c in ("_left", "_next")])

    def pair(b):
        left, after = F.col(f"_left{ids[b]}"), F.col(f"_next{ids[b]}")
        to_left = F.col("start") - left["_pos"] + 1
        to_right = F.when(after["start"] < F.col("end"), 0).otherwise(after["start"] - F.col("end") + 1)
        take_left = left.isNotNull() & (after.isNull() | (to_left <= to_right))
        return F.when(F.col("feature") != b, F.struct(
            F.lit(b).alias("other"), F.coalesce(F.when(take_left, left["start"]).otherwise(after["start"]), F.lit(-1)).alias("nearest"),
            F.coalesce(F.when(take_left, to_left).otherwise(to_right), F.lit(-1)).alias("distance"),
        ))

    placed = known.join(scanned, [*keys, "start"])
    pairs = placed.withColumn("_p", F.explode(F.filter(F.array(*[pair(b) for b in features]), lambda p: p.isNotNull())))
    return pairs.select(*df.columns, F.col("_p.other").alias("other"), F.col("_p.nearest").alias("nearest"), F.col("_p.distance").alias("distance"))


def start_distances(df: DataFrame, keys: Sequence[str] = ("chrom",), width: int = POSITION_BUCKET) -> DataFrame:
    """Distance from each interval's start to the previous start on its chromosome.

    Result: (keys, start, distance, n) with n equal rows; intervals that share a start are 0 apart.
    """
    keys = list(keys)
    starts = df.groupBy(*keys, "start").agg(F.count(F.lit(1)).alias("_rows"))
    # Seen from the right, the previous start is the one this start follows.
    scanned = position_scan(starts, keys, "start", following={"_next": (F.min, F.col("start"))}, width=width)
    return scanned.select(*keys, F.explode(F.array(
        F.struct(F.col("_next").alias("start"), (F.col("_next") - F.col("start")).alias("distance"), F.lit(1).cast("long").alias("n")),
        F.struct(F.col("start"), F.lit(0).cast("long").alias("distance"), (F.col("_rows") - 1).alias("n")),
    )).alias("d")).select(*keys, "d.*").filter("distance is not null and n > 0")


# Percentiles and distance limits of the summary report.
PERCENTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95, "p99": 0.99}
LIMITS = {
    "pct_100bp": 100, "pct_250bp": 250, "pct_500bp": 500, "pct_1kb": 1000,
    "pct_2kb": 2000, "pct_5kb": 5000, "pct_10kb": 10000,
}


def distribution_summary(df: DataFrame, group: Sequence[str], value: str, weight: str | None = None) -> DataFrame:
    """Count, moments, exact percentiles and shares under fixed limits; negative values count as invalid.

    ``weight`` names a column with the number of equal rows a row stands for.
    """
    group = list(group)
    v, ok = F.col(value).cast("double"), F.col(value) >= 0
    n = F.col(weight) if weight else F.lit(1)
    total = F.sum(F.when(ok, n))
    if weight:
        # Deviations are taken from the group's mean: a difference of large sums of squares would cancel.
        means = df.groupBy(*group).agg((F.sum(F.when(ok, v * n)) / total).alias("_mean"))
        df = match(df, means, group) if group else df.crossJoin(F.broadcast(means))  # one row
        apart = v - F.col("_mean")
        mean = F.first("_mean") + F.sum(F.when(ok, apart * n)) / total
        std = F.when(total > 1, F.sqrt(F.sum(F.when(ok, apart * apart * n)) / F.nullif(total - 1, F.lit(0))))
    else:
        mean, std = F.avg(F.when(ok, v)), F.stddev_samp(F.when(ok, v))
    moments = df.groupBy(*group).agg(
        F.coalesce(total, F.lit(0)).alias("count"), mean.alias("mean"), std.alias("std"),
        F.min(F.when(ok, v)).alias("min"), F.max(F.when(ok, v)).alias("max"),
        *[(F.sum(F.when(ok & (F.col(value) <= limit), n).otherwise(0)) / F.nullif(total, F.lit(0))).alias(name)
          for name, limit in LIMITS.items()],
        F.sum(F.when(ok, 0).otherwise(n)).alias("invalid"),
    )
    percentiles = exact_percentiles(df.filter(ok), group, value, PERCENTILES, weight=weight)
    return match(moments, percentiles, group, "left") if group else moments.crossJoin(F.broadcast(percentiles))


def statistic_matrix(summary: DataFrame, features: Sequence[str], statistic: str) -> DataFrame:
    """Anchor x feature matrix of one summary statistic, zero on the diagonal."""
    cells = summary.groupBy("anchor").pivot("feature", list(features)).agg(F.first(statistic))
    return cells.select("anchor", *[
        F.when(F.col("anchor") == f, F.lit(0.0)).otherwise(F.col(f"`{f}`")).alias(f) for f in features
    ])


# --- peaks from a signal track -----------------------------------------------------------------


def call_peaks(runs: DataFrame, cutoff: float, max_gap: int, min_length: int, keys: Sequence[str] = ("chrom",),
               width: int = POSITION_BUCKET) -> DataFrame:
    """Runs at or above the cutoff, joined over gaps up to ``max_gap``, at least ``min_length`` long."""
    high = runs.filter(F.col("value") >= cutoff).select(*keys, "start", "end")
    return merge_intervals(high, keys, max_gap, width).filter(F.col("end") - F.col("start") >= min_length).drop("n")


def call_broad_peaks(runs: DataFrame, cutoff: float, link_cutoff: float, max_gap: int, link_gap: int,
                     min_length: int, keys: Sequence[str] = ("chrom",), width: int = POSITION_BUCKET) -> DataFrame:
    """Regions above ``link_cutoff`` that hold at least one peak above ``cutoff``, with the peaks inside."""
    if link_cutoff > cutoff or link_gap < max_gap:
        raise ValueError("the linking level must be the looser one")
    keys = list(keys)
    # Both levels read the runs above the lower one, which are made once.
    low = cut_lineage(runs.filter(F.col("value") >= link_cutoff).select(*keys, "start", "end", "value"))
    strong = call_peaks(low, cutoff, max_gap, min_length, keys, width)
    weak = call_peaks(low, link_cutoff, link_gap, min_length, keys, width)
    # Runs above the high cutoff are also above the low one, so a strong peak starts inside its weak region.
    owners = asof_last(strong, weak.select(*keys, "start", "end"), keys, "start", ["end"], width)
    placed = strong.withColumnRenamed("end", "peak_end").join(owners, [*keys, "start"])
    return (
        placed.filter(F.col("found").isNotNull() & (F.col("start") < F.col("end")))
        .groupBy(*keys, F.col("found").alias("start"), "end")
        .agg(F.count(F.lit(1)).alias("n_peaks"), F.sum(F.col("peak_end") - F.col("start")).alias("peak_bases"))
    )


def cutoff_analysis(runs: DataFrame, cutoffs: Sequence[float], max_gap: int = 100, min_length: int = 200,
                    keys: Sequence[str] = ("chrom",), width: int = POSITION_BUCKET) -> DataFrame:
    """Number, total and mean length of the peaks at each cutoff; a cutoff without a peak has no row.

    The runs are read once, whatever the number of cutoffs. A bucket finds the peaks of one cutoff after the other, from the
    runs that are left above it. Peaks inside a bucket are only counted; its first and last one of each cutoff may go on
    in other buckets and are put together with theirs.
    """
    keys, levels = list(keys), sorted({float(c) for c in cutoffs})
    first, last = F.floor(F.col("start") / width), F.floor((F.greatest(F.col("end") - 1, F.col("start"))) / width)
    high = reject_nulls(runs, [*keys, "start", "end"]).filter(F.col("value") >= levels[0]) if levels else runs.limit(0)
    pieces = high.withColumn("_bucket", F.explode(F.sequence(first, last))).select(
        *keys, "_bucket", F.greatest(F.col("start"), F.col("_bucket") * width).cast("long").alias("start"),
        F.least(F.col("end"), (F.col("_bucket") + 1) * width).cast("long").alias("end"), F.col("value").cast("double").alias("value"),
    )
    schema = T.StructType([
        *[pieces.schema[k] for k in keys], T.StructField("cutoff", T.DoubleType()), T.StructField("n", T.LongType()),
        T.StructField("length", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()),
    ])

    def peaks(bucket: pa.Table) -> pa.Table:
        order = np.argsort(bucket["start"].to_numpy(), kind="stable")
        start, end, value = (bucket[c].to_numpy()[order] for c in ("start", "end", "value"))
        rows = []
        for cutoff in levels:
            above = value >= cutoff
            if not above.all():
                start, end, value = start[above], end[above], value[above]
            if not len(start):
                break
            reach = np.maximum.accumulate(end)
            opens = np.concatenate([[0], np.flatnonzero(start[1:] > reach[:-1] + max_gap) + 1])
            begins, stops = start[opens], reach[np.concatenate([opens[1:] - 1, [len(start) - 1]])]
            lengths = (stops - begins)[1:-1]
            lengths = lengths[lengths >= min_length]
            rows.append((cutoff, len(lengths), int(lengths.sum()), None, None))
            rows += [(cutoff, 0, 0, int(begins[i]), int(stops[i])) for i in {0, len(begins) - 1}]
        columns = list(zip(*rows))
        own = [pa.repeat(bucket[k][0], len(rows)) for k in keys]
        return pa.Table.from_arrays([*own, *[pa.array(c, t) for c, t in zip(columns, (pa.float64(), *[pa.int64()] * 4))]], names=schema.names)

    found = cut_lineage(pieces.groupBy(*keys, "_bucket").applyInArrow(peaks, schema))
    length = F.col("end") - F.col("start")
    borders = merge_intervals(found.filter("start is not null").select("cutoff", *keys, "start", "end"), ["cutoff", *keys], max_gap, width)
    whole = borders.filter(length >= min_length).select("cutoff", F.lit(1).cast("long").alias("n"), length.alias("length"))
    return found.select("cutoff", "n", "length").unionByName(whole).groupBy("cutoff").agg(
        F.sum("n").alias("n_peaks"), F.sum("length").alias("total_length")
    ).filter("n_peaks > 0").withColumn("mean_length", F.col("total_length") / F.col("n_peaks"))
