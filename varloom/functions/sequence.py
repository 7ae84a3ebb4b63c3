"""Column functions on DNA strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Alphabets and the token cap.
BASES = ["A", "C", "G", "T"]
ALPHABET = ["A", "C", "G", "T", "N"]
MAX_TOKENS = 512


def kmers(seq: Column, k: int, max_kmers: int | None = None) -> Column:
    """Overlapping k-mers as an array; empty when the sequence is shorter than k. Sequences are ASCII.

    The string is bound once as bytes, where a substring costs k steps; in a string it costs its offset.
    """
    count = F.length(seq) - (k - 1)
    if max_kmers is not None:
        count = F.least(count, F.lit(max_kmers))
    # Only rows with count < 1 meet the lower bound of 1: sequence(1, 0) would count down.
    places = F.sequence(F.lit(1), F.greatest(count, F.lit(1)))
    words = F.transform(
        F.array(seq.cast("binary")),
        lambda b: F.transform(places, lambda i: F.substring(b, i, F.lit(k)).cast("string")),
    )[0]
    return F.when(count >= 1, words).otherwise(F.array().cast("array<string>"))


def kmerize(seq: Column, k: int, max_kmers: int | None = MAX_TOKENS) -> Column:
    """K-mers joined by single spaces, cut to ``max_kmers``."""
    return F.array_join(kmers(seq, k, max_kmers), " ")


def complement(seq: Column, reverse: bool = False) -> Column:
    flipped = F.translate(seq, "ACGTN", "TGCAN")
    return F.reverse(flipped) if reverse else flipped


def n_percent(seq: Column) -> Column:
    """Share of N in percent; an empty sequence has none."""
    upper = F.upper(seq)
    n = F.length(upper) - F.length(F.replace(upper, F.lit("N"), F.lit("")))
    return F.when(F.length(seq) == 0, F.lit(0.0)).otherwise(n * 100.0 / F.greatest(F.length(seq), F.lit(1)))


def substitute_centre(seq: Column, alt: Column, length: int) -> Column:
    """The window with its centre base (index length // 2) replaced by ``alt``."""
    centre = length // 2
    return F.concat(F.substring(seq, 1, centre), alt, F.substring(seq, centre + 2, length))


def kmer_combinations(spark: SparkSession, k: int, alphabet: list[str] = ALPHABET) -> DataFrame:
    """All words of length k; len(alphabet) ** k rows."""
    letters = F.array(*[F.lit(a) for a in alphabet])
    words = spark.range(1).select(F.lit("").alias("kmer"))
    for _ in range(k):
        words = words.select(F.explode(F.transform(letters, lambda a: F.concat("kmer", a))).alias("kmer"))
    return words
