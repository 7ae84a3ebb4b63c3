"""Chromosome names, variant ids and values parsed out of text columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, functions as F

# Accession numbers of the twelve chromosomes, in chromosome order.
ACCESSIONS = [
    "AP014957.1", "AP014958.1", "AP014959.1", "AP014960.1", "AP014961.1", "AP014962.1",
    "AP014963.1", "AP014964.1", "AP014965.1", "AP014966.1", "AP014967.1", "AP014968.1",
]
CHROMOSOMES = list(range(1, 13))
# Consequence terms that count as non-coding.
NON_CODING = ["upstream_gene_variant", "downstream_gene_variant", "intergenic_region"]


def _literal_map(pairs) -> Column:
    return F.create_map(*chain.from_iterable((F.lit(a), F.lit(b)) for a, b in pairs))


def _known(value: Column, source: Column, what: str) -> Column:
    return F.coalesce(value, F.raise_error(F.concat(F.lit(f"unknown {what}: "), F.coalesce(source.cast("string"), F.lit("null")))))


def accession_to_number(accession: Column, strict: bool = True) -> Column:
    value = F.try_element_at(_literal_map(zip(ACCESSIONS, CHROMOSOMES)), accession)
    return _known(value, accession, "accession").cast("int") if strict else value


def number_to_accession(number: Column, strict: bool = True) -> Column:
    value = F.try_element_at(_literal_map(zip(CHROMOSOMES, ACCESSIONS)), number.cast("int"))
    return _known(value, number, "chromosome").cast("string") if strict else value


def number_to_name(number: Column) -> Column:
    return F.concat(F.lit("Chr"), number.cast("string"))


def peak_chromosome(chrom: Column) -> Column:
    """Accession -> ChrN; chr/Chr/CHR prefix -> Chr; anything else unchanged."""
    name = F.try_element_at(_literal_map((a, f"Chr{n}") for a, n in zip(ACCESSIONS, CHROMOSOMES)), chrom)
    prefixed = F.when(F.lower(chrom).startswith("chr"), F.concat(F.lit("Chr"), F.substring(chrom, F.lit(4), F.length(chrom))))
    return F.coalesce(name, prefixed, chrom)


def consensus_chromosome(chrom: Column) -> Column:
    """Accession or bare number or any case of chrN -> chrN in lower case."""
    name = F.try_element_at(_literal_map((a, f"Chr{n}") for a, n in zip(ACCESSIONS, CHROMOSOMES)), chrom)
    mapped = F.coalesce(name, chrom)
    return F.lower(F.when(mapped.rlike("^[0-9]+$"), F.concat(F.lit("chr"), mapped)).otherwise(mapped))


def variant_id(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat(F.lit("Chr"), chrom.cast("string"), F.lit(":"), pos.cast("string"), F.lit("_"), ref, alt)


def position_id(chrom: Column, pos: Column) -> Column:
    return F.concat(F.lit("Chr"), chrom.cast("string"), F.lit(":"), pos.cast("string"))


def annotation_chrom(annot_id: Column) -> Column:
    """vgCCPPPP... -> CC."""
    return F.substring(annot_id, 3, 2).cast("int")


def annotation_pos(annot_id: Column) -> Column:
    """vgCCPPPP... -> PPPP..."""
    return F.substring(annot_id, F.lit(5), F.length(annot_id)).cast("long")


def gene_id(attributes: Column) -> Column:
    return F.regexp_extract(attributes, "ID=([^;]+)", 1)


def info_allele_frequency(info: Column) -> Column:
    """First allele frequency of an INFO column; null when the key is absent."""
    return F.nullif(F.regexp_extract(info, "(^|;)AF[:=]([0-9.]+)", 2), F.lit("")).try_cast("double")


def minor_frequency(af: Column) -> Column:
    return F.least(af, 1 - af)


def max_minor_frequency(frequencies: Column) -> Column:
    """min(max, 1 - max) over all alleles, five digits."""
    return F.round(minor_frequency(F.array_max(frequencies)), 5)


def chromosome_order(name: Column) -> list[Column]:
    """Sort keys: numbered chromosomes by number, then the others by name."""
    number = F.nullif(F.regexp_extract(name, r"^Chr(\d+)$", 1), F.lit("")).cast("int")
    return [number.asc_nulls_last(), name.asc()]
