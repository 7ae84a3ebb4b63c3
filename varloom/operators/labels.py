"""Labels of sequence samples, prevalence reports and co-occurrence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from varloom.operators.intervals import merge_intervals
from varloom.operators.scale import POSITION_BUCKET, exact_percentiles, match


def sample_labels(coverage: DataFrame, threshold: float = 50.0, column: str = "percent_covered") -> DataFrame:
    return coverage.withColumn("label", (F.col(column) >= threshold).cast("int"))


def sample_prevalence(labeled: DataFrame, sample: str = "sample") -> DataFrame:
    return labeled.groupBy(sample).agg(
        F.sum("label").alias("positive"), F.count(F.lit(1)).alias("total"), F.avg("label").alias("prevalence")
    )


def majority_labels(
    labeled: DataFrame, majority: float = 0.5, keys: Sequence[str] = ("feature", "chrom", "start", "end")
) -> DataFrame:
    """1 where at least ``majority`` of the samples asked are positive; a tie at one half is positive.

    Every key has one row per sample of its feature, so features may have different numbers of samples.
    """
    return labeled.groupBy(*keys).agg((F.sum("label") >= majority * F.count(F.lit(1))).cast("int").alias("label"))


# --- labels from intervals, without a row for every bin and sample ---------------------------------


def positive_bins(
    bins: DataFrame, intervals: DataFrame, track: Sequence[str] = ("feature", "sample"), threshold: float = 50.0,
    cell: int = 4096, width: int = POSITION_BUCKET,
) -> DataFrame:
    """(track, chrom, start, end) of the bins that a track's intervals cover by ``threshold`` percent or more.

    Only bins that an interval touches are looked at: both sides meet in cells of ``cell`` bases, and what overlaps inside
    the cells is summed. ``cell`` is best about the length of a bin.
    """
    if threshold <= 0:
        raise ValueError("the threshold must be above zero")
    track, at = list(track), ["chrom", "start", "end"]
    union = merge_intervals(intervals.filter("start < `end`").select(*track, *at), [*track, "chrom"], width=width)
    cells = F.explode(F.sequence(F.floor(F.col("start") / cell), F.floor((F.col("end") - 1) / cell)))
    asked = bins.filter("start < `end`").select(*at).distinct().withColumn("_cell", cells)
    pieces = union.withColumn("_cell", cells).select(
        *track, "chrom", "_cell", F.greatest(F.col("start"), F.col("_cell") * cell).alias("_from"),
        F.least(F.col("end"), (F.col("_cell") + 1) * cell).alias("_to"),
    )
    bases = F.least("end", "_to") - F.greatest("start", "_from")
    return (
        asked.join(pieces, ["chrom", "_cell"]).filter(bases > 0)
        .groupBy(*track, *at).agg(F.sum(bases).alias("_covered"))
        .filter(F.col("_covered") * 100 >= threshold * (F.col("end") - F.col("start"))).drop("_covered")
    )


def replicates(tracks: DataFrame, feature: str = "feature") -> dict[str, int]:
    """Number of samples of each feature; one row per feature reaches the driver."""
    return {r[0]: r[1] for r in tracks.distinct().groupBy(feature).count().collect()}


def add_majority(
    bins: DataFrame, positives: DataFrame, samples_of: dict[str, int], features: Sequence[str], majority: float = 0.5
) -> DataFrame:
    """``bins`` with one 0/1 column per feature: whether at least ``majority`` of its samples are positive there."""
    unknown = [f for f in features if not samples_of.get(f)]
    if unknown:
        raise ValueError(f"no samples of {unknown}")
    at = ["chrom", "start", "end"]
    votes = positives.groupBy(*at).agg(*[F.count_if(F.col("feature") == f).alias(f) for f in features])
    return bins.join(votes, at, "left").withColumns({
        f: (F.coalesce(F.col(f), F.lit(0)) >= majority * samples_of[f]).cast("int") for f in features
    })


def long_labels(wide: DataFrame, features: Sequence[str], keys: Sequence[str] = ("chrom", "start", "end")) -> DataFrame:
    return wide.unpivot(list(keys), list(features), "feature", "label")


def track_prevalence(
    bins: DataFrame, positives: DataFrame, tracks: DataFrame, track: Sequence[str] = ("feature", "sample")
) -> DataFrame:
    """(track, positive, total, prevalence) over all bins, tracks without a positive bin included."""
    total = bins.agg(F.count(F.lit(1)).alias("total"))
    found = positives.groupBy(*track).agg(F.count(F.lit(1)).alias("positive"))
    counted = match(tracks.select(*track).distinct(), found, list(track), "left").crossJoin(F.broadcast(total))  # one row
    positive = F.coalesce("positive", F.lit(0))
    return counted.select(*track, positive.alias("positive"), "total", (positive / F.col("total")).alias("prevalence"))


def label_stats(prevalence: DataFrame, majority: DataFrame, output: str = "majority", sample: str = "sample") -> DataFrame:
    """Counts per sample over its features, and a final row for the majority vote (rows with a label)."""
    counts = lambda positive, total: (F.sum(positive).alias("positive"), F.sum(total).alias("total"), (F.sum(positive) / F.sum(total)).alias("prevalence"))
    return prevalence.groupBy(F.col(sample).cast("string").alias(sample)).agg(*counts("positive", "total")).unionByName(
        majority.agg(*counts("label", F.lit(1))).withColumn(sample, F.lit(output))
    )


def merge_labels(
    samples: DataFrame, labels: DataFrame, features: Sequence[str], keys: Sequence[str] = ("chrom", "start", "end")
) -> DataFrame:
    """Sequence samples with one 0/1 column per feature, matched by coordinates.

    ``labels`` is long (keys, feature, label). A sample or label without partner is an error.
    """
    wide = labels.groupBy(*keys).agg(*[F.max(F.when(F.col("feature") == f, F.col("label"))).alias(f) for f in features])
    both = samples.withColumn("_s", F.lit(1)).join(wide.withColumn("_l", F.lit(1)), list(keys), "full_outer")
    lost = F.raise_error(F.concat_ws(" ", F.lit("labels and samples do not match at"), *[F.col(k).cast("string") for k in keys]))
    whole = F.col("_s").isNotNull() & F.col("_l").isNotNull()
    for f in features:
        whole &= F.col(f).isNotNull()
    return both.filter(F.when(whole, F.lit(True)).otherwise(lost.cast("boolean"))).drop("_s", "_l")


def label_array(df: DataFrame, features: Sequence[str], name: str = "labels") -> DataFrame:
    """The feature columns as one array in the given order."""
    return df.withColumn(name, F.array(*[F.col(f).cast("int") for f in features])).drop(*features)


def column_prevalence(df: DataFrame, features: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Long (group, feature, ones, zeros, ratio); every column is counted in one pass."""
    counted = df.groupBy(*group).agg(*[
        F.struct(F.sum(F.when(F.col(f) == 1, 1).otherwise(0)).alias("ones"), F.count_if(F.col(f) == 0).alias("zeros"),
                 F.avg(F.col(f).cast("double")).alias("ratio")).alias(f) for f in features
    ])
    rows = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("c")) for f in features]))
    return counted.select(*group, rows.alias("r")).select(*group, "r.feature", "r.c.*")


def prevalence_matrix(prevalence: DataFrame, columns: Sequence[str], group: str = "chrom", value: str = "ratio") -> DataFrame:
    """Feature x group matrix, columns in the given order."""
    return prevalence.groupBy("feature").pivot(group, list(columns)).agg(F.first(value))


def prevalence_totals(prevalence: DataFrame, group: str = "chrom") -> DataFrame:
    """Sums per feature, per group and overall with the ratio made from the sums, in one pass."""
    return (
        prevalence.groupingSets([["feature"], [group], []], "feature", group)
        .agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"), F.grouping("feature").alias("_no_feature"), F.grouping(group).alias("_no_group"))
        .withColumn("level", F.when(F.col("_no_feature") == 0, "feature").when(F.col("_no_group") == 0, group).otherwise("global"))
        .withColumn("total", F.col("ones") + F.col("zeros"))
        .withColumn("ratio", F.col("ones") / F.nullif(F.col("total"), F.lit(0)))
        .drop("_no_feature", "_no_group")
    )


def label_counts_long(prevalence: DataFrame, group: str = "chrom") -> DataFrame:
    """(group, feature, label, count) with readable labels and the percent of each."""
    return (
        prevalence.withColumnRenamed("ones", "Positive").withColumnRenamed("zeros", "Negative")
        .unpivot([group, "feature", "ratio"], ["Positive", "Negative"], "label", "count")
        .withColumn("percent", F.when(F.col("label") == "Positive", F.col("ratio") * 100).otherwise(100 - F.col("ratio") * 100))
        .drop("ratio")
    )


def cooccurrence(df: DataFrame, features: Sequence[str], group: Sequence[str] = ()) -> DataFrame:
    """Long (group, feature_a, feature_b, n) of joint positives; the diagonal holds the counts.

    Rows with the same label set are counted first, so pairs are made per label set and never per row.
    """
    sets = df.groupBy(*group, *features).agg(F.count(F.lit(1)).alias("_rows"))
    cells = F.array(*[F.struct(F.lit(f).alias("f"), (F.col(f) == 1).cast("long").alias("y")) for f in features])
    return (
        sets.withColumn("a", F.explode(cells)).withColumn("b", F.explode(cells))
        .groupBy(*group, F.col("a.f").alias("feature_a"), F.col("b.f").alias("feature_b"))
        .agg(F.sum(F.col("_rows") * F.col("a.y") * F.col("b.y")).alias("n"))
    )


def sum_matrices(matrices: DataFrame) -> DataFrame:
    return matrices.groupBy("feature_a", "feature_b").agg(F.sum("n").alias("n"))


def matrix_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Cells present in only one of two matrices; empty when they are equal."""
    return left.exceptAll(right).withColumn("side", F.lit("left")).unionByName(
        right.exceptAll(left).withColumn("side", F.lit("right"))
    )


def normalised_matrix(matrix: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Each cell over its row sum, and its log1p."""
    sums = matrix.groupBy(*group, "feature_a").agg(F.sum("n").alias("_row"))
    return matrix.join(sums, [*group, "feature_a"]).withColumn(
        "share", F.col("n") / F.nullif(F.col("_row"), F.lit(0))
    ).withColumn("log1p", F.log1p(F.col("n").cast("double"))).drop("_row")


def ordered_rows(cells: DataFrame, row: str, value: str) -> DataFrame:
    """Rows of a matrix by falling mean."""
    return cells.groupBy(row).agg(F.avg(value).alias("mean")).orderBy(F.col("mean").desc(), row)


def colour_limits(cells: DataFrame, value: str) -> DataFrame:
    """5th and 95th percentile of all cells."""
    return exact_percentiles(cells, [], value, {"p05": 0.05, "p95": 0.95})


def label_vector_report(df: DataFrame, subsample: DataFrame, features: Sequence[str]) -> DataFrame:
    """Per feature: mean in the full set and the subsample, their difference, and the subsample's counts."""
    full = column_prevalence(df, features).select("feature", F.col("ratio").alias("full"))
    part = column_prevalence(subsample, features).select(
        "feature", F.col("ratio").alias("subsample"), F.col("ones").alias("subsample_ones"), F.col("zeros").alias("subsample_zeros")
    )
    return full.join(part, "feature").withColumn("delta", F.col("subsample") - F.col("full"))
