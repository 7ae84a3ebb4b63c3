"""Splits, quotas and stratified subsamples in reproducible hash order.

Members are picked by the md5 of seed and key, so a result does not depend on partitioning and can be
repeated in any SQL engine.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from varloom.operators.scale import hash_order, hash_rank, match
from varloom.operators.stratify import allocate, label_sets, signature

# Default shares and held-out chromosomes.
TEST_SIZE = 0.2
VAL_SIZE = 0.2
TEST_CHROM = 6
VAL_CHROM = 7


def _assign(df: DataFrame, seed, keys, group, test_rows: Column, val_rows: Column) -> DataFrame:
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("_size"))
    ranked = hash_rank(df, seed, keys, group, "_rank")
    sized = match(ranked, sizes, group) if group else ranked.crossJoin(F.broadcast(sizes))  # one row
    return sized.withColumn("_test", test_rows).withColumn("_val", val_rows).withColumn(
        "split",
        F.when(F.col("_rank") <= F.col("_test"), "test").when(F.col("_rank") <= F.col("_test") + F.col("_val"), "val").otherwise("train"),
    ).drop("_rank", "_size", "_test", "_val")


def random_split(
    df: DataFrame, keys: Sequence[str], test_size: float = TEST_SIZE, val_size: float = VAL_SIZE, seed: int = 42,
    group: Sequence[str] = ("chrom",),
) -> DataFrame:
    """Per group: test is a share of all rows, validation a share of the rest; both are rounded up."""
    return _assign(
        df, seed, keys, list(group), F.ceil(F.col("_size") * F.lit(test_size)),
        F.ceil((F.col("_size") - F.col("_test")) * F.lit(val_size)),
    )


def train_val_split(df: DataFrame, keys: Sequence[str], val_size: float = VAL_SIZE, seed: int = 42, group: Sequence[str] = ()) -> DataFrame:
    return random_split(df, keys, 0.0, val_size, seed, group)


def stratified_split(
    df: DataFrame, features: Sequence[str], keys: Sequence[str], test_size: float = TEST_SIZE, val_size: float = VAL_SIZE,
    seed: int = 42, group: Sequence[str] = ("chrom",), min_stratum: int = 1,
) -> DataFrame:
    """Split so that every part has its share of every label; both shares are of all rows of a group, rounded.

    Label sets with fewer than ``min_stratum`` rows are pooled, and their labels are not looked at.
    """
    group = list(group)
    signed = df.withColumn("_stratum", signature(features))
    strata = label_sets(df, features, group)
    if min_stratum > 1:
        rare = F.col("_rows") < min_stratum
        signed = match(signed, strata, [*group, "_stratum"]).withColumn(
            "_stratum", F.when(rare, F.lit("rare")).otherwise(F.col("_stratum"))
        ).drop("_rows", "_labels")
        strata = strata.groupBy(*group, F.when(rare, F.lit("rare")).otherwise(F.col("_stratum")).alias("_stratum")).agg(
            F.first(F.when(rare, F.array().cast("array<int>")).otherwise(F.col("_labels"))).alias("_labels"), F.sum("_rows").alias("_rows")
        )
    part = lambda share: F.round(F.col("_size") * F.lit(share)).cast("long")
    sizes = strata.groupBy(*group).agg(F.sum("_rows").alias("_size")).withColumn("_test", part(test_size)).withColumn(
        "_val", F.least(part(val_size), F.col("_size") - F.col("_test"))
    ).select(*group, F.array("_test", "_val", F.col("_size") - F.col("_test") - F.col("_val")).alias("_sizes"))
    placed = match(signed, allocate(strata, sizes, group), [*group, "_stratum"])
    ranked = hash_rank(placed, seed, keys, [*group, "_stratum"], "_rank")
    in_test, in_val = F.col("_take")[0], F.col("_take")[0] + F.col("_take")[1]
    return ranked.withColumn(
        "split", F.when(F.col("_rank") <= in_test, "test").when(F.col("_rank") <= in_val, "val").otherwise("train")
    ).drop("_rank", "_take", "_stratum")


def chromosome_split(df: DataFrame, test_chrom: int = TEST_CHROM, val_chrom: int = VAL_CHROM, chrom: str = "chrom") -> DataFrame:
    return df.withColumn("split", F.when(F.col(chrom) == test_chrom, "test").when(F.col(chrom) == val_chrom, "val").otherwise("train"))


def split_stats(df: DataFrame, group: str = "chrom") -> DataFrame:
    count = lambda s: F.count_if(F.col("split") == s).alias(f"{s}_cnt")
    return df.groupBy(group).agg(F.count(F.lit(1)).alias("orig_size"), count("train"), count("val"), count("test"))


def quotas(df: DataFrame, n: int, group: str = "chrom") -> DataFrame:
    """Rows each group contributes to a sample of n: its floored share, the remainder to the largest groups."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size"))
    # Groups are chromosomes or files, not rows.
    everything = W.partitionBy(F.lit(0))
    shares = sizes.withColumn("quota", F.floor(F.lit(n) * F.col("size") / F.sum("size").over(everything)))
    return shares.withColumn(
        "quota", F.col("quota") + (
            F.row_number().over(everything.orderBy(F.col("size").desc(), group)) <= n - F.sum("quota").over(everything)
        ).cast("long")
    )


def stratified_subsample(
    df: DataFrame, wanted: DataFrame, features: Sequence[str], keys: Sequence[str], seed: int = 42, group: str = "chrom",
) -> DataFrame:
    """Exactly ``quota`` rows per group (all of them where the quota is larger), with the group's share of every label."""
    strata = label_sets(df, features, [group])
    counted = strata.groupBy(group).agg(F.sum("_rows").alias("_size"))
    taken = F.least("quota", "_size").cast("long")
    sizes = match(counted, wanted.select(group, "quota"), [group]).select(group, F.array(taken, F.col("_size") - taken).alias("_sizes"))
    take = allocate(strata, sizes, [group]).select(group, "_stratum", F.col("_take")[0].alias("_take"))
    placed = match(df.withColumn("_stratum", signature(features)), take, [group, "_stratum"])
    return hash_rank(placed, seed, keys, [group, "_stratum"], "_rank", keep=F.col("_take")).drop("_rank", "_take", "_stratum")


def check_sample_size(df: DataFrame, n: int) -> DataFrame:
    """The one-row count of a sample; an error when it is not n."""
    wrong = F.raise_error(F.concat(F.lit(f"expected {n} rows, found "), F.col("rows").cast("string")))
    return df.agg(F.count(F.lit(1)).alias("rows")).filter(F.when(F.col("rows") == n, F.lit(True)).otherwise(wrong.cast("boolean")))


def first_n_per_group(df: DataFrame, n: int, keys: Sequence[str], seed: int = 42, group: Sequence[str] = ("dataset",)) -> DataFrame:
    """n rows of each dataset in seeded hash order."""
    return hash_rank(df, seed, keys, list(group), "_rank", keep=F.lit(n)).drop("_rank")


def concat_datasets(
    datasets: Mapping[str, DataFrame], keys: Sequence[str], n: int | None = None, seed: int = 42, shuffle: bool = False
) -> DataFrame:
    """Datasets under one another with their name, optionally n rows of each and in seeded hash order."""
    named = [df.withColumn("dataset", F.lit(name)) for name, df in datasets.items()]
    whole = reduce(DataFrame.unionByName, named)
    if n is not None:
        whole = first_n_per_group(whole, n, keys, seed)
    return shuffled(whole, ["dataset", *keys], seed) if shuffle else whole


def shuffled(df: DataFrame, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Reproducible random order for a file that is about to be written."""
    return df.withColumn("_hash", hash_order(seed, *keys)).orderBy("_hash", *keys).drop("_hash")
