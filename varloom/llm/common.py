"""Helpers that the operators of this package share."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from varloom.session import ensure_checkpoint_dir

# A word: everything between ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path inside the folder that all executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back.

    For frames that several passes read: later passes prune its columns, know its size, and survive lost executors.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    back = df.sparkSession.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*frames: DataFrame) -> None:
    """Remove the files of stored frames that nothing reads any more."""
    for frame in frames:
        context = frame.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(frame.stored_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text, whose crc32 is 0."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, or with underscores where a caller's table already has that column (case does not tell names apart)."""
    used = {name.lower() for name in taken}
    while wanted.lower() in used:
        wanted = f"_{wanted}"
    return wanted


def running_before(
    df: DataFrame, order: Sequence[Column], sums: Mapping[str, Column], rows_per_part: int = 100_000
) -> DataFrame:
    """Add exclusive running sums over the whole frame in the given order, which must be a strict one.

    The frame is dealt into ranges of about ``rows_per_part`` rows and stored, summed inside each range, and
    the totals of earlier ranges (one row per range) are added.
    """
    parts = max(1, -(-df.count() // rows_per_part))
    ranged = stored(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "ranges")
    inside = W.partitionBy("_part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carry = ranged.groupBy("_part").agg(*[F.sum(c).alias(f"_carry_{n}") for n, c in sums.items()]).select(
        "_part", *[F.coalesce(F.sum(f"_carry_{n}").over(earlier), F.lit(0)).alias(f"_carry_{n}") for n in sums]
    )
    return (
        ranged.withColumns({n: F.coalesce(F.sum(c).over(inside), F.lit(0)) for n, c in sums.items()})
        .join(F.broadcast(carry), "_part")  # one row per range
        .withColumns({n: F.col(n) + F.col(f"_carry_{n}") for n in sums})
        .drop("_part", *[f"_carry_{n}" for n in sums])
    )
