"""A genome as overlapping chunks, and everything cut out of it.

Columns: chrom, length, chunk_id, chunk_start, seq. A chunk starts every ``size`` bases and runs
``overlap`` bases into the next one, so any window up to ``overlap`` bases lies whole in the
chunk that holds its start. No row ever holds a chromosome.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from varloom.functions.sequence import BASES, complement, n_percent, substitute_centre
from varloom.operators.scale import lookup_join, skew_join

CHUNK = 1 << 16
OVERLAP = 1 << 12


def chunk_pieces(
    pieces: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, chrom: str = "chrom",
) -> DataFrame:
    """Assemble chunks from pieces (chrom, offset, seq) that tile each chromosome, such as FASTA lines."""
    end = F.col("offset") + F.length("seq")
    lengths = pieces.groupBy(chrom).agg(F.max(end).alias("length"))
    first = F.greatest(F.floor((F.col("offset") - overlap) / size), F.lit(0))
    last = F.floor((end - 1) / size)
    spread = (
        pieces.filter(F.length("seq") > 0)
        .withColumn("chunk_id", F.explode(F.sequence(first, last)))
        .withColumn("chunk_start", F.col("chunk_id") * size)
        .withColumn("_from", F.greatest(F.col("offset"), F.col("chunk_start")))
        .withColumn("_to", F.least(end, F.col("chunk_start") + size + overlap))
        .filter("_from < _to")
        .select(chrom, "chunk_id", "chunk_start", F.struct(
            F.col("_from"),
            F.substring("seq", (F.col("_from") - F.col("offset") + 1).cast("int"), (F.col("_to") - F.col("_from")).cast("int")).alias("seq"),
        ).alias("_part"))
    )
    chunks = spread.groupBy(chrom, "chunk_id", "chunk_start").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("_part")), lambda p: p["seq"]), "").alias("seq")
    )
    return lookup_join(chunks, lengths, [chrom])


def chunk_sequences(df: DataFrame, size: int = CHUNK, overlap: int = OVERLAP, chrom: str = "chrom") -> DataFrame:
    """Chunks from rows (chrom, seq) that already hold a whole short sequence; no shuffle."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.length("seq") - 1, F.lit(0)).cast("long"), F.lit(size).cast("long"))
    return df.filter(F.length("seq") > 0).select(
        chrom, F.length("seq").cast("long").alias("length"), "seq", F.explode(starts).alias("chunk_start")
    ).select(
        chrom, "length", F.floor(F.col("chunk_start") / size).alias("chunk_id"), "chunk_start",
        F.substring("seq", (F.col("chunk_start") + 1).cast("int"), F.lit(size + overlap)).alias("seq"),
    )


def chunk_size(chunks: DataFrame) -> tuple[int, int]:
    """(size, overlap) of a chunked genome, from two bounded numbers."""
    size, longest = chunks.agg(
        F.min(F.when(F.col("chunk_id") > 0, F.col("chunk_start") / F.col("chunk_id"))), F.max(F.length("seq"))
    ).first()
    return (int(size), longest - int(size)) if size else (longest, longest)


def chromosome_lengths(chunks: DataFrame, chrom: str = "chrom") -> DataFrame:
    return chunks.groupBy(chrom).agg(F.max("length").alias("length"))


def _bytes() -> Column:
    """A chunk as bytes: a substring of a string walks to its offset, one of bytes does not."""
    return F.col("seq").cast("binary").alias("_bytes")


def read_ranges(ranges: DataFrame, chunks: DataFrame, size: int = CHUNK, hot_rows: int = 1_000_000) -> DataFrame:
    """(chrom, start, end, seq) of the distinct ranges in ``ranges`` (0-based, within their chromosomes), however long.

    A range lists the chunks it touches, takes its share of each, and one aggregation puts the shares in order.
    """
    wanted = ranges.select("chrom", "start", "end").distinct().filter("start < end").withColumn(
        "chunk_id", F.explode(F.sequence(F.floor(F.col("start") / size), F.floor((F.col("end") - 1) / size)))
    )
    pieces = skew_join(wanted, chunks.select("chrom", "chunk_id", "chunk_start", _bytes()), ["chrom", "chunk_id"], hot_rows=hot_rows)
    low = F.greatest("start", "chunk_start")
    high = F.least(F.col("end"), F.col("chunk_start") + size)
    share = F.substring("_bytes", (low - F.col("chunk_start") + 1).cast("int"), (high - low).cast("int")).cast("string")
    # As many shares as the range touches chunks.
    ordered = F.array_sort(F.collect_list(F.struct("chunk_id", share.alias("share"))))
    return pieces.groupBy("chrom", "start", "end").agg(F.array_join(F.transform(ordered, lambda p: p["share"]), "").alias("seq"))


def extract_windows(
    variants: DataFrame, chunks: DataFrame, length: int, size: int = CHUNK, overlap: int = OVERLAP,
    zero_based: bool = False, on_error: str = "raise", hot_rows: int = 1_000_000,
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """Reference and alternate window around each variant (chrom, pos, alt, ...).

    The centre is index length // 2. A window that leaves its chromosome (or an unknown one) and an
    alternate of more than one base are errors; with ``on_error="split"`` such rows come back as a
    second frame with their reason. Windows longer than the overlap are read over several chunks.
    """
    centre = length // 2
    zero = F.col("pos") if zero_based else F.col("pos") - 1
    placed = variants.withColumn("start", zero - centre).withColumn("end", zero - centre + length).withColumn(
        "chunk_id", F.floor(F.col("start") / size)
    )
    if length <= overlap:
        found = skew_join(
            placed, chunks.select("chrom", "chunk_id", "chunk_start", _bytes(), F.col("length").alias("_length")),
            ["chrom", "chunk_id"], "left", hot_rows,
        )
    else:
        lengths = chunks.filter("chunk_id = 0").select("chrom", F.col("length").alias("_length"))
        found = skew_join(placed, lengths, ["chrom"], "left", hot_rows)
    site = F.concat_ws(":", F.col("chrom").cast("string"), F.col("pos").cast("string"))
    problem = (
        F.when(F.length("alt") != 1, F.concat(F.lit("alternate is not one base: "), F.col("alt")))
        .when(F.col("_length").isNull() | (F.col("start") < 0) | (F.col("end") > F.col("_length")),
              F.concat(F.lit("window leaves its chromosome: "), site))
    )
    checked = found.withColumn("problem", problem)
    if on_error == "raise":
        # The check is part of the filter, so no plan can skip it.
        good = checked.filter(F.when(F.col("problem").isNull(), F.lit(True)).otherwise(F.raise_error(F.col("problem")).cast("boolean")))
    else:
        good = checked.filter("problem is null")
    if length <= overlap:
        inside = (F.col("start") - F.col("chunk_start") + 1).cast("int")
        read = good.withColumn("ref_seq", F.substring("_bytes", inside, F.lit(length)).cast("string"))
    else:
        read = skew_join(
            good, read_ranges(good, chunks, size, hot_rows).withColumnRenamed("seq", "ref_seq"), ["chrom", "start", "end"], hot_rows=hot_rows
        )
    windows = (
        read.withColumn("alt_seq", substitute_centre(F.col("ref_seq"), F.col("alt"), length))
        .withColumn("ref_base", F.substring("ref_seq", centre + 1, 1))
        .withColumn("alt_base", F.substring("alt_seq", centre + 1, 1))
        .withColumn("left_cnt", F.lit(centre)).withColumn("right_cnt", F.lit(length - centre - 1))
        .drop("chunk_id", "chunk_start", "_bytes", "_length", "problem")
    )
    if on_error == "raise":
        return windows
    return windows, checked.filter("problem is not null").select(*variants.columns, "problem")


def bin_genome(
    chunks: DataFrame, bin_size: int, stride: int | None = None, forward: int = 0, backward: int = 0,
    size: int = CHUNK, overlap: int = OVERLAP, update_end: bool = False, update_start: bool = False,
) -> DataFrame:
    """Bins of each chromosome with their sequence, cut chunk by chunk without a shuffle.

    ``start``/``end`` are the core bin (``end`` cut at the chromosome end); ``seq`` also holds the
    forward and backward extension, filled with N beyond the chromosome. Bins that do not fit in the overlap with
    their extensions are read over several chunks.
    """
    stride = stride or bin_size
    reach = bin_size + forward + backward
    # A bin belongs to the chunk that holds the first base it needs.
    low = F.when(F.col("chunk_id") == 0, F.lit(0)).otherwise(F.col("chunk_start") + backward)
    high = F.least(F.col("chunk_start") + size + backward, F.col("length"))
    first = F.ceil(low / stride).cast("long")
    last = (F.ceil(high / stride) - 1).cast("long")
    start = F.col("_index") * stride
    need = F.greatest(F.col("start") - backward, F.lit(0))
    raw_end = F.col("start") + bin_size
    stop = F.least(raw_end + forward, F.col("length"))
    left_pad = F.greatest(F.lit(backward) - F.col("start"), F.lit(0)).cast("int")
    listed = lambda df: df.withColumn("_index", F.explode(F.sequence(first, last))).withColumn("start", start)
    held = chunks.filter(first <= last)
    if reach <= overlap:
        body = F.substring("_bytes", (need - F.col("chunk_start") + 1).cast("int"), (stop - need).cast("int")).cast("string")
        read = listed(held.withColumn("_bytes", _bytes()).drop("seq")).withColumn("_body", body)
    else:
        asked = listed(held.drop("seq")).drop("chunk_id", "chunk_start").withColumns({"_need": need, "_stop": stop})
        ranges = asked.select("chrom", F.col("_need").alias("start"), F.col("_stop").alias("end"))
        seqs = read_ranges(ranges, chunks, size).withColumnsRenamed({"start": "_need", "end": "_stop", "seq": "_body"})
        read = asked.join(seqs, ["chrom", "_need", "_stop"])
    out = (
        read.withColumn("_body", F.concat(F.repeat(F.lit("N"), left_pad), "_body"))
        .withColumn("_seq", F.rpad("_body", reach, "N"))
        .select(
            "chrom", (F.col("_index") + 1).alias("bin_id"), "start", F.least(raw_end, F.col("length")).alias("end"),
            F.col("_seq").alias("seq"), F.col("length").alias("_length"),
        )
    )
    if update_end:
        out = out.withColumn("end", F.least(F.col("end") + forward, F.col("_length")))
    if update_start:
        out = out.withColumn("start", F.greatest(F.col("start") - backward, F.lit(0)))
    return out.drop("_length")


def filter_ambiguous(df: DataFrame, max_n_percent: float, seq: str = "seq") -> DataFrame:
    """Keep sequences with at most ``max_n_percent`` percent N."""
    return df.filter(n_percent(F.col(seq)) <= max_n_percent)


def ambiguity_stats(df: DataFrame, max_n_percent: float, group: Sequence[str] = ("chrom",), seq: str = "seq") -> DataFrame:
    return df.groupBy(*group).agg(
        F.count(F.lit(1)).alias("before"), F.count_if(n_percent(F.col(seq)) <= max_n_percent).alias("after")
    )


def add_complements(df: DataFrame, seq: str = "seq", reverse: bool = False) -> DataFrame:
    """Every row once as it is and once with the complementary strand."""
    return (
        df.withColumn("is_complement", F.explode(F.array(F.lit(False), F.lit(True))))
        .withColumn(seq, F.when(F.col("is_complement"), complement(F.col(seq), reverse)).otherwise(F.col(seq)))
    )


def saturate(chunks: DataFrame, chrom, start: int, end: int, size: int = CHUNK) -> DataFrame:
    """Every position of a 1-based inclusive range with each of the four bases as alternate."""
    return saturate_regions(
        chunks, chunks.sparkSession.range(1).select(F.lit(chrom).alias("chrom"), F.lit(start).alias("start"), F.lit(end).alias("end")), size
    )


def saturate_regions(chunks: DataFrame, regions: DataFrame, size: int = CHUNK) -> DataFrame:
    """Saturation list for regions (chrom, start, end), cut by chunk before positions are listed."""
    zero_start, zero_end = F.col("start") - 1, F.col("end") - 1
    pieces = (
        regions.withColumn("chunk_id", F.explode(F.sequence(F.floor(zero_start / size), F.floor(zero_end / size))))
    )
    own = skew_join(pieces, chunks.drop("length"), ["chrom", "chunk_id"])
    low = F.greatest(zero_start, F.col("chunk_start"))
    high = F.least(zero_end, F.col("chunk_start") + size - 1, F.col("chunk_start") + F.length("seq") - 1)
    piece = F.substring("seq", (low - F.col("chunk_start") + 1).cast("int"), (high - low + 1).cast("int"))
    positions = (
        own.filter(low <= high).select("chrom", low.alias("_low"), F.posexplode(F.split(piece, "")).alias("_i", "ref"))
        .select("chrom", (F.col("_low") + F.col("_i") + 1).alias("pos"), "ref")
    )
    return positions.select("*", F.explode(F.array(*[F.lit(b) for b in BASES])).alias("alt"))
