"""Scores for windows that arrive as files: each file is scored once and its rows appended.

The scorer keeps no state between rows, so the batch operator runs unchanged on a stream.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import SparkSession

from varloom.operators.scoring import score_sequences


def append_scores(
    spark: SparkSession, source: str, schema: str, target: str, state: str, model: Callable, features: Sequence[str],
    seq: str = "seq", logits: bool = True,
) -> None:
    """Score every file of ``source`` not seen before and stop; ``state`` remembers what was done."""
    arriving = spark.readStream.schema(schema).parquet(source)
    scored = score_sequences(arriving, model, features, seq, logits=logits)
    scored.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()
