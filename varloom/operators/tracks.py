"""Signal tracks: disjoint runs (chrom, start, end, value) on half-open coordinates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from varloom.operators.intervals import asof_last
from varloom.operators.scale import POSITION_BUCKET, lookup_join, skew_join, with_aligned_blocks
from varloom.session import cut_lineage

CELL = 128
# Blocks of up to 2**24 cells, two gigabases; the lower levels are made from cells, the upper from blocks of 64.
LEVELS = 25
LOWER = 6
BROADCAST_BLOCKS = 1 << 20  # rows of eight numbers


def track_lengths(runs: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    return runs.groupBy(*keys).agg(F.max("end").alias("length"))


def runs_in_region(runs: DataFrame, chrom, start: int, end: int, above: float | None = None) -> DataFrame:
    """Runs that touch the region, optionally only those with value > ``above``."""
    found = runs.filter((F.col("chrom") == chrom) & (F.col("start") < end) & (F.col("end") > start))
    return found if above is None else found.filter(F.col("value") > above)


def _cell_runs(runs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Runs cut at cell borders; a cell holds at most CELL of them."""
    return (
        runs.withColumn("_cell", F.explode(F.sequence(F.floor(F.col("start") / CELL), F.floor((F.col("end") - 1) / CELL))))
        .withColumn("_from", F.greatest(F.col("start"), F.col("_cell") * CELL))
        .withColumn("_to", F.least(F.col("end"), (F.col("_cell") + 1) * CELL))
        .select(*keys, "_cell", "_from", "_to", "value", "_apart")
    )


def _moments(bases, apart):
    return [
        F.sum(bases).alias("_b"), F.sum(bases * apart).alias("_s"), F.sum(bases * apart * apart).alias("_q"),
        F.min("value").alias("_lo"), F.max("value").alias("_hi"),
    ]


def _combined():
    return [F.sum(c).alias(c) for c in ("_b", "_s", "_q")] + [F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")]


def _level_sums(blocks: DataFrame, keys: Sequence[str], base: int, levels: range) -> DataFrame:
    """Sums of aligned blocks at the given levels, from blocks of 2**base cells."""
    at = F.explode(F.array(*[
        F.struct(F.lit(i).alias("level"), F.floor(F.col("_cell") / (1 << (i - base))).cast("long").alias("block")) for i in levels
    ]))
    return blocks.withColumn("_at", at).groupBy(*keys, "_at.level", "_at.block").agg(*_combined())


def region_stats(regions: DataFrame, runs: DataFrame, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Mean, min, max, std and coverage of the signal in each region (region_id, keys, start, end).

    A region is its two ragged end cells plus a few aligned blocks whose sums were made once, so a
    long region costs about as much as a short one.
    """
    keys = list(keys)
    # Sums are taken around each key's mean signal, so that squares of large values do not cancel in the deviation.
    width = F.col("end") - F.col("start")
    anchors = cut_lineage(runs.groupBy(*keys).agg((F.sum(width * F.col("value")) / F.sum(width)).alias("_anchor")))
    apart = runs.join(anchors, keys).withColumn("_apart", F.col("value") - F.col("_anchor")).drop("_anchor")
    cells = cut_lineage(_cell_runs(apart, keys))
    blocks = cut_lineage(cells.groupBy(*keys, "_cell").agg(*_moments(F.col("_to") - F.col("_from"), F.col("_apart"))))
    wide = blocks.groupBy(*keys, F.floor(F.col("_cell") / (1 << LOWER)).alias("_cell")).agg(*_combined())
    levels = cut_lineage(_level_sums(blocks, keys, 0, range(LOWER)).unionByName(_level_sums(wide, keys, LOWER, range(LOWER, LEVELS))))
    if levels.count() <= BROADCAST_BLOCKS:  # then a region's blocks are added up where they are listed, without a shuffle of their list
        levels = F.broadcast(levels)
    first, last = F.floor(F.col("start") / CELL), F.floor((F.col("end") - 1) / CELL)
    parts = ("_b", "_s", "_q", "_lo", "_hi")
    inner = skew_join(
        with_aligned_blocks(regions.select("region_id", *keys, "start", "end"), first + 1, last, LEVELS).drop("start", "end"),
        levels, [*keys, "level", "block"],
    ).select("region_id", *parts)
    ends = regions.select("region_id", *keys, "start", "end", F.explode(F.array_distinct(F.array(first, last))).alias("_cell"))
    bases = F.least(F.col("end"), F.col("_to")) - F.greatest(F.col("start"), F.col("_from"))
    edge = (
        skew_join(ends, cells, [*keys, "_cell"]).filter(bases > 0)
        .select("region_id", bases.alias("_b"), (bases * F.col("_apart")).alias("_s"),
                (bases * F.col("_apart") * F.col("_apart")).alias("_q"), F.col("value").alias("_lo"), F.col("value").alias("_hi"))
    )
    summed = inner.unionByName(edge).groupBy("region_id").agg(
        F.sum("_b").alias("_b"), F.sum("_s").alias("_s"), F.sum("_q").alias("_q"), F.min("_lo").alias("min"), F.max("_hi").alias("max")
    )
    mean = F.col("_s") / F.col("_b")  # still around the anchor
    variance = F.greatest((F.col("_q") - F.col("_s") * mean) / F.nullif(F.col("_b") - 1, F.lit(0)), F.lit(0.0))
    return (
        regions.join(summed, ["region_id"], "left").join(anchors, keys, "left")
        .withColumn("mean", F.col("_anchor") + mean)
        .withColumn("std", F.when(F.col("_b") > 1, F.sqrt(variance)))
        .withColumn("coverage", F.coalesce("_b", F.lit(0)) / (F.col("end") - F.col("start")))
        .drop("_b", "_s", "_q", "_anchor")
    )


def base_values(regions: DataFrame, runs: DataFrame, keys: Sequence[str] = ("chrom",), width: int = POSITION_BUCKET) -> DataFrame:
    """One row per base of each region with its signal, null where there is none."""
    keys = list(keys)
    bases = regions.select("region_id", *keys, F.explode(F.sequence(F.col("start"), F.col("end") - 1)).alias("pos0"))
    table = runs.select(*keys, F.col("start").alias("pos0"), F.col("end").alias("_run_end"), "value")
    found = asof_last(bases, table, keys, "pos0", ["_run_end", "value"], width)
    value = F.when(F.col("pos0") < F.col("_run_end"), F.col("value"))
    return skew_join(bases, found.select(*keys, "pos0", value.alias("value")), [*keys, "pos0"])


def binned_track(runs: DataFrame, lengths: DataFrame, n_bins: int = 5000, keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """log1p of the mean signal in ``n_bins`` equal bins per chromosome; empty bins are zero."""
    keys = list(keys)
    edge = lambda i: F.floor(i * F.col("length") / n_bins)
    bin_of = lambda base: F.floor(((base + 1) * n_bins - 1) / F.col("length"))
    sized = lookup_join(runs, lengths, keys)
    # Runs are disjoint, so listing the bins of each run adds at most n_bins rows per chromosome.
    pieces = (
        sized.withColumn("bin", F.explode(F.sequence(bin_of(F.col("start")), bin_of(F.col("end") - 1))))
        .withColumn("_bases", F.least(F.col("end"), edge(F.col("bin") + 1)) - F.greatest(F.col("start"), edge(F.col("bin"))))
        .filter("_bases > 0")
        .groupBy(*keys, "bin").agg((F.sum(F.col("_bases") * F.col("value")) / F.sum("_bases")).alias("mean"))
    )
    grid = lengths.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1)).cast("array<bigint>")).alias("bin"))
    return grid.join(pieces, [*keys, "bin"], "left").withColumn("signal", F.log1p(F.coalesce("mean", F.lit(0.0)))).drop("mean")


def gaussian_smooth(track: DataFrame, n_bins: int, sigma: float, value: str = "signal", keys: Sequence[str] = ("chrom",)) -> DataFrame:
    """Gaussian filter over the bins, four sigmas wide, mirrored at both ends."""
    radius = int(4 * sigma + 0.5)
    # A filter wider than the track meets the mirrored track again and again.
    turns = range(-(radius // (2 * n_bins)) - 1, radius // (2 * n_bins) + 2)
    weights = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
    total = sum(weights)
    kernel = F.array(*[F.struct(F.lit(d).alias("d"), F.lit(w / total).alias("w")) for d, w in zip(range(-radius, radius + 1), weights)])
    mirrored = F.array(*[place + 2 * n_bins * t for t in turns for place in (F.col("bin"), -1 - F.col("bin"))])
    return (
        track.withColumn("_source", F.explode(mirrored)).filter((F.col("_source") >= -radius) & (F.col("_source") < n_bins + radius))
        .withColumn("_k", F.explode(kernel))
        .withColumn("_target", F.col("_source") + F.col("_k.d"))
        .filter((F.col("_target") >= 0) & (F.col("_target") < n_bins))
        .groupBy(*keys, F.col("_target").alias("bin")).agg(F.sum(F.col(value) * F.col("_k.w")).alias("smoothed"))
    )
