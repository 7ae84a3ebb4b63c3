"""Words of texts and their counts over whole corpora."""

from __future__ import annotations

import contextlib
import ctypes
import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_BUCKETS_PER_OCTAVE = 16


def give_back() -> None:
    """Return free memory to the system: a worker lives on after a task, while other stages need the memory elsewhere."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(AttributeError, OSError):  # other C libraries do it by themselves
        ctypes.CDLL(None).malloc_trim(0)


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, A-Z lower-cased; all other bytes stay."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def texts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Spans of rows with their column text, so that a batch of long texts is not turned into strings at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            yield part, part.column("text").to_pylist()


def count_words(docs: DataFrame, text: str = "text", flush: int = 400_000) -> DataFrame:
    """(word, n) over all rows of ``docs``; each task sums before it sends, holding about ``flush`` words at most."""

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            return pa.RecordBatch.from_arrays(
                [pa.array(held.keys(), pa.binary()).cast(pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"]
            )

        held: Counter[bytes] = Counter()
        for _, texts in texts_of(batches):
            for value in texts:
                held.update(words_of(value))
            if len(held) > flush:
                yield rows()
                held = Counter()
        yield rows()

    return docs.select(F.col(text).alias("text")).mapInArrow(counted, "word string, n long").groupBy("word").agg(
        F.sum("n").alias("n")
    )


def frequency_histogram(table: DataFrame) -> list:
    """Rows (words, n, least) by falling frequency; at most 16 rows per doubling of the largest count."""
    at = F.floor(F.log2(F.col("n").cast("double")) * _BUCKETS_PER_OCTAVE).cast("int")
    return table.groupBy(at.alias("at")).agg(
        F.count(F.lit(1)).alias("words"), F.sum("n").alias("n"), F.min("n").alias("least")
    ).orderBy(F.desc("at")).collect()


def least_count(histogram: list, limit: int) -> float:
    """The count from which on words are frequent, so that ``limit`` words at most are; infinite if none can be."""
    taken, least = 0, math.inf
    for row in histogram:
        if taken + row["words"] > limit:
            break
        taken, least = taken + row["words"], row["least"]
    return least
