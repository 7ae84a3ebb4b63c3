"""Variant lists: filters, frequency matching, and the positive and negative sets."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from varloom.functions.naming import (
    CHROMOSOMES, NON_CODING, annotation_chrom, annotation_pos, consensus_chromosome, gene_id, info_allele_frequency,
    max_minor_frequency, minor_frequency, variant_id,
)
from varloom.operators.intervals import outside_intervals
from varloom.operators.scale import (
    BROADCAST_ROWS, POSITION_BUCKET, counts_within, enclosing_blocks, hash_order, hash_rank, lookup_join, position_scan,
    running_totals, skew_join, top_n_per_group, with_aligned_blocks,
)
from varloom.session import cut_lineage

# --- filters -----------------------------------------------------------------------------------


def is_biallelic_snp(ref: Column, alt: Column) -> Column:
    return (F.length(ref) == 1) & (F.length(alt) == 1) & ~F.contains(alt, F.lit(","))


def is_single_alternate(alt: Column) -> Column:
    """One alternate that is not the deletion symbol; it may be longer than one base."""
    return ~F.contains(alt, F.lit(",")) & (alt != "*")


def is_non_coding(annotation: Column) -> Column:
    return F.lower(annotation).isin(NON_CODING)


def passed_quality(df: DataFrame, column: str = "FILTER") -> DataFrame:
    return df.filter(F.col(column) == "PASS")


def away_from_ends(df: DataFrame, lengths: DataFrame, buffer: int = 1000, pos: str = "pos") -> DataFrame:
    """Strictly more than ``buffer`` bases from both chromosome ends."""
    joined = lookup_join(df, lengths.withColumnRenamed("length", "_length"), ["chrom"])
    return joined.filter((F.col(pos) > buffer) & (F.col(pos) < F.col("_length") - buffer)).drop("_length")


def in_region(df: DataFrame, chrom, start: int, end: int, chrom_col: str = "chrom", pos_col: str = "pos") -> DataFrame:
    """1-based, both ends inclusive."""
    return df.filter((F.col(chrom_col) == chrom) & F.col(pos_col).between(start, end))


def allow_positions(df: DataFrame, allowed: DataFrame, by: Sequence[str] = ("chrom", "pos")) -> DataFrame:
    """Rows at the allowed sites; pass ``by=["pos"]`` for single-chromosome lists."""
    return skew_join(df, allowed.select(*by).distinct(), list(by))


def remove_positions(df: DataFrame, known: DataFrame, by: Sequence[str] = ("chrom", "pos")) -> DataFrame:
    # An anti-join only tests for a match; a hot site is spread over slots like any other hot key.
    return skew_join(df, known.select(*by).distinct(), list(by), how="left_anti")


def gene_ranges(gff: DataFrame) -> DataFrame:
    """Gene rows of an annotation table: gene_id, chrom, start, end (1-based inclusive), strand."""
    return gff.filter(F.col("type") == "gene").select(gene_id(F.col("attributes")).alias("gene_id"), "chrom", "start", "end", "strand")


def outside_genes(variants: DataFrame, genes: DataFrame, width: int = POSITION_BUCKET) -> DataFrame:
    """Variants (1-based pos) in no gene range (1-based, both ends inclusive)."""
    half_open = genes.select("chrom", (F.col("start") - 1).alias("start"), "end")
    points = variants.withColumn("pos0", F.col("pos") - 1)
    return outside_intervals(points, half_open, ["chrom"], "pos0", width).drop("pos0")


def split_known_chromosomes(df: DataFrame, column: str = "chrom") -> tuple[DataFrame, DataFrame]:
    """(rows of chr1..chr12 with the normalised name, rejected rows as they came)."""
    name = consensus_chromosome(F.col(column))
    known = name.isin([f"chr{n}" for n in CHROMOSOMES])
    return df.filter(known).withColumn(column, name), df.filter(~known)


def unique_variants(df: DataFrame, by: str = "id") -> DataFrame:
    return df.agg(F.countDistinct(by).alias("n_variants"))


# --- frequencies -------------------------------------------------------------------------------


def percent_rank(df: DataFrame, value: str, name: str = "MAF_PCT", digits: int | None = None) -> DataFrame:
    """Rank / n with average ranks for ties, from a histogram of the values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(value).agg(F.count(F.lit(1)).alias("_rows"))
    ranked = running_totals(counts, [value], {"n": F.col("_rows")})
    total = ranked.agg(F.sum("_rows").alias("_total"))
    share = (F.col("cum_n") - F.col("_rows") + (F.col("_rows") + 1) / 2) / F.col("_total")
    if digits is not None:
        share = F.round(share, digits)
    shares = ranked.crossJoin(F.broadcast(total)).select(value, share.alias(name))  # one row
    if counts_within(ranked, BROADCAST_ROWS):
        return df.join(F.broadcast(shares), value, "left")  # the rows are not shuffled, however hot a value is
    return skew_join(df, shares, [value], "left", counted=ranked.select(value, "_rows"))


def maf_table(frequencies: DataFrame) -> DataFrame:
    """Minor allele frequency and its percent rank from rows with an array ``freqs``."""
    maf = frequencies.withColumn("MAF", max_minor_frequency(F.col("freqs"))).drop("freqs")
    return percent_rank(maf, "MAF", "MAF_PCT", 5)


def info_maf(df: DataFrame, info: str = "INFO") -> DataFrame:
    af = info_allele_frequency(F.col(info))
    return df.withColumn("AF", af).withColumn("MAF", minor_frequency(F.col("AF")))


def attach_maf(variants: DataFrame, maf: DataFrame) -> DataFrame:
    """Left join on (chrom, pos)."""
    return skew_join(variants, maf.select("chrom", "pos", "MAF", "MAF_PCT"), ["chrom", "pos"], "left")


# --- positive set ------------------------------------------------------------------------------


def keep_first(df: DataFrame, by: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key, the first by ``order``; a combining aggregate, so hot keys do not matter."""
    rest = [c for c in df.columns if c not in by]
    first = F.min(F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest if c not in order]))
    ordered = [c for c in order] + [c for c in rest if c not in order]
    picked = df.groupBy(*by).agg(first.alias("_first"))
    return picked.select(*by, *[F.col(f"_first.{c}").alias(c) for c in ordered if c not in by]).select(*df.columns)


def sample_exact(df: DataFrame, n: int, seed: int, keys: Sequence[str]) -> DataFrame:
    """Exactly n rows in reproducible random order; an error when there are fewer."""
    short = F.raise_error(F.concat(F.lit(f"asked for {n} rows, found "), F.col("_rows").cast("string")))
    enough = df.agg(F.count(F.lit(1)).alias("_rows")).select(
        F.when(F.col("_rows") >= n, F.lit(True)).otherwise(short.cast("boolean")).alias("_enough")
    )
    picked = hash_rank(df, seed, keys, name="_rank", keep=F.lit(n)).drop("_rank")
    return picked.crossJoin(F.broadcast(enough)).filter("_enough").drop("_enough")  # one row


def functional_snps(annotations: DataFrame, maf: DataFrame, min_maf: float = 0.1) -> DataFrame:
    """Non-coding biallelic SNPs with a minor allele frequency above ``min_maf``, one per site.

    ``annotations`` has var (vgCCPPPP...), var_ref, alt, snpeff_anno.
    """
    snps = annotations.filter(is_biallelic_snp(F.col("var_ref"), F.col("alt")) & is_non_coding(F.col("snpeff_anno")))
    named = snps.select(
        annotation_chrom(F.col("var")).alias("chrom"), annotation_pos(F.col("var")).alias("pos"),
        F.col("var").alias("annot_id"), F.col("var_ref").alias("ref"), "alt",
    ).withColumn("id", variant_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")))
    frequent = attach_maf(named, maf).filter(F.col("MAF") > min_maf)
    by_id = keep_first(frequent, ["id"], ["annot_id"])
    return keep_first(by_id, ["chrom", "pos"], ["annot_id", "id"]).select(
        "chrom", "pos", "annot_id", "id", "ref", "alt", "MAF", "MAF_PCT"
    )


# --- matched negatives -------------------------------------------------------------------------

_PCT_SCALE = 100_000


def _pct_cell(column: str) -> Column:
    return F.round(F.col(column) * _PCT_SCALE).cast("long")


def nearest_eligible(
    positives: DataFrame, candidates: DataFrame, max_dist: int, tolerance: float, width: int = POSITION_BUCKET
) -> DataFrame:
    """For each candidate site the closest positive within ``max_dist`` and the percentile tolerance.

    The percentile range of a candidate is a few aligned blocks; each positive is listed once per block
    size. Inside a block the closest positive is a scan along the chromosome, so the work grows
    with rows, not with pairs. Ties go to the smaller position. Percentiles have five digits.
    """
    span = round(tolerance * _PCT_SCALE)
    celled = candidates.withColumn("_cell", _pct_cell("MAF_PCT"))
    low, high = F.greatest(F.col("_cell") - span, F.lit(0)), F.col("_cell") + span + 1
    levels = (2 * span + 1).bit_length()
    none = F.lit(None).cast("long")
    listed = positives.select("chrom", "pos", F.explode(enclosing_blocks(_pct_cell("MAF_PCT"), levels)).alias("_b")).select(
        "chrom", "_b.*", "pos", F.col("pos").alias("_positive"), none.alias("_cell")
    )
    asked = with_aligned_blocks(celled.select("chrom", "pos", "_cell"), low, high, levels).select(
        "chrom", "level", "block", "pos", none.alias("_positive"), "_cell"
    )
    keys = ["chrom", "level", "block"]
    # A site is one row per block with the distinct percentiles that ask there, at most the width of the block.
    sites = listed.unionByName(asked).groupBy(*keys, "pos").agg(
        F.max("_positive").alias("_positive"), F.collect_set("_cell").alias("_cells")
    )
    scanned = position_scan(
        sites, keys, "pos", before={"_left": (F.max, F.col("_positive"))}, after={"_right": (F.min, F.col("_positive"))}, width=width
    )
    option = lambda side: F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col(side) - F.col("pos")).alias("distance"), F.col(side).alias("positive_pos")))
    best = scanned.select("chrom", "pos", F.explode("_cells").alias("_cell"), F.least(option("_left"), option("_right")).alias("_best"))
    closest = best.filter(F.col("_best.distance") <= max_dist).groupBy("chrom", "pos", "_cell").agg(F.min("_best").alias("_best"))
    return skew_join(celled, closest.select("chrom", "pos", "_cell", "_best.*"), ["chrom", "pos", "_cell"]).drop("_cell")


def matched_negatives(
    positives: DataFrame, candidates: DataFrame, max_dist: int, tolerance: float = 0.05, count: int = 1, seed: int = 42,
    key: str = "variant_key", width: int = POSITION_BUCKET,
) -> DataFrame:
    """Up to ``count`` negatives per positive; a site is used once, and no positive stays short while one is free for it.

    In each round a free candidate offers itself to the closest positive that it may serve and that still lacks some; a
    positive takes the closest offers, ties in seeded hash order. Rounds end when nobody offers; each fills at least
    every positive that has a free candidate with one more.
    """
    site = ["chrom", "pos"]
    short = cut_lineage(positives.select("chrom", "pos", "MAF_PCT").distinct().withColumn("_lack", F.lit(count)))
    free, rounds = candidates, []
    best_first = lambda: (F.col("distance"), hash_order(seed, key), F.col(key))
    while True:
        offered = nearest_eligible(short.select("chrom", "pos", "MAF_PCT"), free, max_dist, tolerance, width)
        lacking = short.groupBy(F.col("chrom"), F.col("pos").alias("positive_pos")).agg(F.max("_lack").alias("_lack"))
        # Whoever has no offer left is eligible for none of the positives that are short, now or later.
        offered = cut_lineage(top_n_per_group(offered, site, best_first(), 1).join(lacking, ["chrom", "positive_pos"]))
        first = top_n_per_group(offered, ["chrom", "positive_pos"], best_first(), count)
        place = F.row_number().over(W.partitionBy("chrom", "positive_pos").orderBy(*best_first()))
        taken = cut_lineage(first.withColumn("_place", place).filter("_place <= _lack").drop("_place", "_lack"))
        rounds.append(taken)
        filled = taken.groupBy(F.col("chrom"), F.col("positive_pos").alias("pos")).agg(F.count(F.lit(1)).alias("_got"))
        short = cut_lineage(
            short.join(filled, site, "left").withColumn("_lack", F.col("_lack") - F.coalesce("_got", F.lit(0))).drop("_got").filter("_lack > 0")
        )
        left_over = offered.select(*site).join(taken.select(*site), site, "left_anti")
        if short.isEmpty() or left_over.isEmpty():
            return reduce(DataFrame.unionByName, rounds)
        free = cut_lineage(candidates.join(left_over.distinct(), site, "left_semi"))


def candidate_sites(variants: DataFrame, known: DataFrame) -> DataFrame:
    """Biallelic SNPs that are not known functional sites: the population in which frequencies are ranked."""
    return remove_positions(variants.filter(is_biallelic_snp(F.col("ref"), F.col("alt"))), known)


def sample_per_chromosome(df: DataFrame, quotas: DataFrame, seed: int, keys: Sequence[str]) -> DataFrame:
    """Per chromosome the number of rows its quota names (column ``cnt``), or all if there are fewer."""
    sized = lookup_join(df, quotas.select("chrom", F.col("cnt").alias("_cnt")), ["chrom"])
    return hash_rank(sized, seed, keys, ["chrom"], "_rank", keep=F.col("_cnt")).drop("_rank", "_cnt")


def genomewide_sample(
    sites: DataFrame, lengths: DataFrame, genes: DataFrame, quotas: DataFrame, buffer: int = 1000, seed: int = 42,
    keys: Sequence[str] = ("variant_key",), width: int = POSITION_BUCKET,
) -> DataFrame:
    """Background sites: quality, chromosome ends, single alternate, outside genes, then a quota per chromosome."""
    good = away_from_ends(passed_quality(sites).filter(is_single_alternate(F.col("alt"))), lengths, buffer)
    return sample_per_chromosome(outside_genes(good, genes, width), quotas, seed, keys)
