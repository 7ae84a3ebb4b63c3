"""Readers. Each text format has a parser on a frame of lines, so any source of lines will do."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F, types as T

from varloom.functions.naming import accession_to_number, number_to_name, variant_id
from varloom.operators.genome import CHUNK, OVERLAP, chunk_pieces
from varloom.operators.scale import hash_rank, top_n_per_group
from varloom.session import cut_lineage
from varloom.sources import bgzf

SNP_LIST = "chrom int, pos long, id string, ref string, alt string"
ANNOTATED_SNPS = "chrom int, pos long, annot_id string, id string, ref string, alt string, MAF double, MAF_PCT double"
PVAR = "CHR string, POS long, ID string, REF string, ALT string, QUAL string, FILTER string, INFO string"
BIM = "CHR string, SNP string, CM double, BP long, A1 string, A2 string"
GFF = "chrom string, source string, type string, start long, end long, score string, strand string, phase string, attributes string"
BED = "chrom string, start long, end long"
BEDGRAPH = "chrom string, start long, end long, value double"
CLOSEST = "chrA string, startA long, endA long, chrB string, startB long, endB long, distance long"
COVERAGE = (
    "chrom string, start long, end long, num_overlaps long, bases_covered long, "
    "interval_length long, fraction_covered double, percent_covered double"
)
THRESHOLDS = "significance_lvl double, score double"
PREVALENCE = "ones long, zeros long, ratio double"


def text_lines(spark: SparkSession, path, **options) -> DataFrame:
    """(value, file): the lines of text files and the names of the files."""
    return spark.read.options(**options).text(path).select("value", F.col("_metadata.file_name").alias("file"))


def parse_tsv(lines: DataFrame, schema: str, header: bool = False, comment: str | None = None, null: str = "") -> DataFrame:
    """Fields of tab-separated lines (column value) and the other columns of ``lines``. Empty lines are skipped.

    With ``header`` lines that hold the names of the fields are skipped wherever they are, since every file has one.
    """
    rows = lines.filter(F.length("value") > 0)
    if comment is not None:
        rows = rows.filter(~F.col("value").startswith(comment))
    if header:
        names = "\t".join(field.name for field in T.StructType.fromDDL(schema).fields)
        rows = rows.filter(F.col("value") != names)
    others = [c for c in lines.columns if c != "value"]
    parsed = F.from_csv("value", schema, {"sep": "\t", "nullValue": null})
    return rows.select(parsed.alias("_row"), *others).select("_row.*", *others)


def file_stem(file: str = "file") -> Column:
    """File name without its extension."""
    return F.regexp_replace(F.col(file), r"\.[^.]+$", "")


# --- variants ----------------------------------------------------------------------------------


def parse_snp_list(lines: DataFrame) -> DataFrame:
    return parse_tsv(lines.select("value"), SNP_LIST, header=True)


def read_snp_list(spark: SparkSession, path) -> DataFrame:
    return parse_snp_list(text_lines(spark, path))


def read_annotated_snps(spark: SparkSession, path) -> DataFrame:
    return parse_tsv(text_lines(spark, path).select("value"), ANNOTATED_SNPS, header=True)


def parse_vcf(lines: DataFrame, on_error: str = "raise") -> DataFrame | tuple[DataFrame, DataFrame]:
    """Sites of VCF lines (column ``value``). More than one alternate is an error, or split off."""
    f = F.split("value", "\t")
    sites = lines.filter((F.length("value") > 0) & ~F.col("value").startswith("#")).select(
        f[0].alias("CHROM"), f[1].cast("long").alias("POS"), f[2].alias("ID"), f[3].alias("REF"), f[4].alias("ALT")
    )
    several = F.contains(F.col("ALT"), F.lit(","))
    if on_error == "split":
        return sites.filter(~several), sites.filter(several)
    message = F.raise_error(F.concat(F.lit("more than one alternate at "), F.col("CHROM"), F.lit(":"), F.col("POS").cast("string")))
    # The check is part of the filter, so no plan can skip it.
    return sites.filter(F.when(several, message.cast("boolean")).otherwise(F.lit(True)))


def read_vcf(spark: SparkSession, path, on_error: str = "raise"):
    return parse_vcf(spark.read.text(path), on_error)


def read_vcf_blocks(spark: SparkSession, path: str, on_error: str = "raise", split_bytes: int = bgzf.SPLIT_BYTES):
    """A block-compressed VCF file, or a folder of such, read by many tasks."""
    return parse_vcf(bgzf.read_lines(spark, path, split_bytes).select("value"), on_error)


def vcf_to_snp_list(sites: DataFrame, numbered: bool = True, keep_id: bool = False) -> DataFrame:
    """SNP list of VCF sites whose CHROM is an accession."""
    number = accession_to_number(F.col("CHROM"))
    own = variant_id(number, F.col("POS"), F.col("REF"), F.col("ALT"))
    return sites.select(
        (number if numbered else number_to_name(number)).alias("chrom"), F.col("POS").alias("pos"),
        (F.col("ID") if keep_id else own).alias("id"), F.col("REF").alias("ref"), F.col("ALT").alias("alt"),
    )


def parse_pvar(lines: DataFrame) -> DataFrame:
    return parse_tsv(lines.select("value"), PVAR, comment="#", null=".")


def read_pvar(spark: SparkSession, path) -> DataFrame:
    return parse_pvar(text_lines(spark, path))


def parse_bim(lines: DataFrame) -> DataFrame:
    return parse_tsv(lines.select("value"), BIM)


def read_bim(spark: SparkSession, path) -> DataFrame:
    return parse_bim(text_lines(spark, path))


def parse_gff(lines: DataFrame) -> DataFrame:
    f = F.split("value", "\t")
    return lines.filter((F.length("value") > 0) & ~F.col("value").startswith("#")).select(
        f[0].alias("chrom"), f[1].alias("source"), f[2].alias("type"), f[3].cast("long").alias("start"), f[4].cast("long").alias("end"),
        f[5].alias("score"), f[6].alias("strand"), f[7].alias("phase"), f[8].alias("attributes"),
    )


def read_gff(spark: SparkSession, path) -> DataFrame:
    return parse_gff(text_lines(spark, path))


def parse_freq(lines: DataFrame) -> DataFrame:
    """Ragged allele-frequency lines: four fixed fields, then allele:frequency pairs.

    Header lines, whose second field is POS, and empty lines are skipped; a line whose position is no number is an error.
    """
    pairs = F.slice("_f", 5, F.greatest(F.size("_f") - 4, F.lit(0)))
    header = F.upper(F.trim(F.coalesce(F.try_element_at("_f", F.lit(2)), F.lit("")))) == "POS"
    position = F.try_element_at("_f", F.lit(2)).try_cast("double")
    broken = F.raise_error(F.concat(F.lit("no position in line: "), F.array_join("_f", " "))).cast("boolean")
    whole = F.coalesce(F.col("_position") == F.floor("_position"), F.lit(False))
    # Filters are not moved before columns that name the task; before the others, each of their terms would split its line anew.
    split = lines.select(F.split("value", "\t").alias("_f"), (F.length("value") > 0).alias("_any"), F.spark_partition_id().alias("_task"))
    placed = split.filter(F.col("_any") & (F.col("_task") >= 0)).select("_f", position.alias("_position"))
    kept = placed.filter(~header).filter(F.when(whole, F.lit(True)).otherwise(broken))
    return kept.select(
        F.col("_f")[0].alias("CHROM"), F.col("_position").cast("long").alias("POS"),
        F.col("_f")[2].cast("int").alias("N_ALLELES"), F.col("_f")[3].cast("int").alias("N_CHR"),
        F.transform(pairs, lambda x: F.split(x, ":")[1].cast("double")).alias("freqs"),
    )


def read_freq(spark: SparkSession, path) -> DataFrame:
    return parse_freq(spark.read.text(path))


def read_keyed_annotations(spark: SparkSession, path, key: str, key_column: str = "key") -> DataFrame:
    """One chromosome's annotations from a parquet table partitioned by key."""
    return spark.read.parquet(path).filter(F.col(key_column) == key).drop(key_column)


# --- intervals and tracks ----------------------------------------------------------------------


def parse_bed(lines: DataFrame, feature_from_name: bool = False) -> DataFrame:
    """Three columns; the feature is the file name up to the first underscore."""
    df = parse_tsv(lines, BED)
    return df.withColumn("feature", F.split(file_stem(), "_")[0]).drop("file") if feature_from_name else df.select("chrom", "start", "end")


def read_bed(spark: SparkSession, path, feature_from_name: bool = False) -> DataFrame:
    return parse_bed(text_lines(spark, path), feature_from_name)


def parse_bedgraph(lines: DataFrame) -> DataFrame:
    """Signal runs; the sample is the file name."""
    return parse_tsv(lines, BEDGRAPH, comment="#").withColumn("sample", file_stem()).drop("file")


def read_bedgraph(spark: SparkSession, path) -> DataFrame:
    return parse_bedgraph(text_lines(spark, path))


def parse_closest(lines: DataFrame) -> DataFrame:
    """Distances; the feature is the file name after the first underscore."""
    return parse_tsv(lines, CLOSEST).withColumn("feature", F.regexp_extract(file_stem(), "_(.*)$", 1)).drop("file")


def read_closest(spark: SparkSession, path) -> DataFrame:
    """Distance files anywhere below a folder."""
    return parse_closest(text_lines(spark, path, recursiveFileLookup="true"))


def parse_coverage(lines: DataFrame, column: str = "percent_covered") -> DataFrame:
    """One coverage column by bin; the sample is the file name."""
    return parse_tsv(lines, COVERAGE, header=True).select("chrom", "start", "end", column, file_stem().alias("sample"))


def read_coverage(spark: SparkSession, path, column: str = "percent_covered") -> DataFrame:
    return parse_coverage(text_lines(spark, path), column)


# --- datasets ----------------------------------------------------------------------------------


def read_samples(spark: SparkSession, path, chrom: str = "chr", region: tuple | None = None) -> DataFrame:
    """Samples of chromosomes 1 to 12, or those that overlap a region (chromosome, start, end); others are not opened."""
    samples = spark.read.parquet(path).filter(F.col(chrom).between(1, 12))
    if region is None:
        return samples
    number, start, end = region
    return samples.filter((F.col(chrom) == number) & (F.col("start") < end) & (F.col("end") > start))


def read_labeled(spark: SparkSession, path) -> DataFrame:
    return spark.read.parquet(path)


def read_sequence_arrays(spark: SparkSession, path, count: int | None = None, shuffle: bool = False, seed: int = 42, key: str = "id") -> DataFrame:
    """Sequences of several files, optionally the first ``count`` of each, in key or seeded hash order."""
    df = spark.read.parquet(path).withColumn("file", F.col("_metadata.file_name"))
    if count is None:
        return df
    if shuffle:
        return hash_rank(df, seed, [key], ["file"], "_rank", keep=F.lit(count)).drop("_rank")
    return top_n_per_group(df, ["file"], [F.col(key)], count)


def parse_features(lines: DataFrame, key: str = "features") -> DataFrame:
    """(ordinal, feature) of lines (value, at) in the order of ``at``; a feature list is a few rows."""
    order = W.partitionBy(F.lit(0)).orderBy("at")
    return lines.filter((F.col("value") != key) & (F.length("value") > 0)).select(
        (F.row_number().over(order) - 1).alias("ordinal"), F.col("value").alias("feature")
    )


def read_features(spark: SparkSession, path, key: str = "features") -> DataFrame:
    return parse_features(spark.read.text(path).withColumn("at", F.monotonically_increasing_id()), key)


def feature_list(features: DataFrame) -> list[str]:
    return [r["feature"] for r in features.orderBy("ordinal").collect()]


def parse_thresholds(lines: DataFrame, feature_from_name: bool = False) -> DataFrame:
    df = parse_tsv(lines, THRESHOLDS, header=True)
    return df.withColumn("feature", file_stem()).drop("file") if feature_from_name else df.select("significance_lvl", "score")


def read_thresholds(spark: SparkSession, path, feature_from_name: bool = False) -> DataFrame:
    return parse_thresholds(text_lines(spark, path), feature_from_name)


def parse_prevalence(lines: DataFrame, features: DataFrame) -> DataFrame:
    """Per-chromosome files N.csv, lines (value, file, at), whose rows follow the feature list.

    The row order inside a file is its only key, so it becomes an ordinal here; a file has one row per
    feature.
    """
    rows = lines.filter((F.col("value") != "1,0,ratio") & (F.length("value") > 0)).select(
        F.from_csv("value", PREVALENCE).alias("_row"), file_stem().alias("_stem"), "at"
    )
    ordinal = F.row_number().over(W.partitionBy("_stem").orderBy("at")) - 1
    return (
        rows.withColumn("ordinal", ordinal).join(features, "ordinal")
        .select("feature", F.concat(F.lit("Chr"), "_stem").alias("chrom"), "_row.*")
    )


def read_prevalence(spark: SparkSession, path, features: DataFrame) -> DataFrame:
    return parse_prevalence(text_lines(spark, path).withColumn("at", F.monotonically_increasing_id()), features)


def read_json_log(spark: SparkSession, path, schema: str | None = None) -> DataFrame:
    """An array of records with its file order as ``ordinal``."""
    reader = spark.read.option("multiLine", True)
    df = (reader.schema(schema) if schema else reader).json(path)
    return df.withColumn("ordinal", F.monotonically_increasing_id())


def parse_json_log(lines: DataFrame, schema: str) -> DataFrame:
    """One record per line (ordinal, value)."""
    return lines.select("ordinal", F.from_json("value", schema).alias("r")).select("ordinal", "r.*")


def parse_matrix(lines: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Whitespace-separated dense rows as long (i, j, r), with ``ordinal`` as the row index."""
    cells = F.split(F.trim("value"), r"\s+")
    return lines.select(F.col(ordinal).alias("i"), F.posexplode(cells).alias("j", "_r")).select(
        F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("_r").cast("double").alias("r")
    )


def read_ld_matrix(spark: SparkSession, path, block: int = 0) -> DataFrame:
    """One square LD block (block, i, j, r). Its line order is the row index."""
    lines = with_line_number(spark.read.text(path).filter(F.length(F.trim("value")) > 0))
    return parse_matrix(lines.withColumnRenamed("line", "ordinal")).select(F.lit(block).cast("long").alias("block"), "i", "j", "r")


def with_line_number(lines: DataFrame) -> DataFrame:
    """Zero-based line numbers per file, counted split by split."""
    tagged = lines.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_at"),
    )
    across = W.partitionBy("_file").orderBy("_split").rowsBetween(W.unboundedPreceding, -1)
    before = tagged.groupBy("_file", "_split").agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(across), F.lit(0)))
    inside = W.partitionBy("_file", "_split").orderBy("_at")
    return (
        tagged.join(before.drop("_n"), ["_file", "_split"])
        .withColumn("line", F.col("_before") + F.row_number().over(inside) - 1)
        .drop("_file", "_split", "_at", "_before")
    )


def read_keyless_tsv(spark: SparkSession, path, columns: Sequence[str], key: str = "variant_key") -> DataFrame:
    """A headed file of numbers without a key: the data line number becomes the key, once, at the reader."""
    lines = with_line_number(spark.read.text(path)).filter("line > 0")
    f = F.split("value", "\t")
    return lines.select((F.col("line") - 1).alias(key), *[f[i].cast("double").alias(c) for i, c in enumerate(columns)])


def parse_best_metrics(lines: DataFrame, schema: str) -> DataFrame:
    """Best-step records (value, path) of several models; the model is the name of the folder that holds the file."""
    return lines.select(F.from_json("value", schema).alias("_row"), F.element_at(F.split("path", "/"), -2).alias("model")).select("_row.*", "model")


def read_best_metrics(spark: SparkSession, path, schema: str) -> DataFrame:
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).text(path)
    return parse_best_metrics(files.select("value", F.col("_metadata.file_path").alias("path")), schema)


def parse_arrays(lines: DataFrame, ordinal: str = "ordinal", name: str = "values") -> DataFrame:
    """(ordinal, values): whitespace-separated numbers of each line."""
    cells = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double"))
    return lines.filter(F.length(F.trim("value")) > 0).select(ordinal, cells.alias(name))


def parse_evaluation(logits: DataFrame, labels: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """(ordinal, logits, labels) of two matrices of lines; a row without partner, or of another width, is an error."""
    both = parse_arrays(logits, ordinal, "logits").join(parse_arrays(labels, ordinal, "labels"), ordinal, "full_outer")
    fits = F.coalesce(F.size("logits") == F.size("labels"), F.lit(False))
    lost = F.raise_error(F.concat(F.lit("logits and labels differ at row "), F.col(ordinal).cast("string"))).cast("boolean")
    return both.filter(F.when(fits, F.lit(True)).otherwise(lost)).select(ordinal, "logits", F.transform("labels", lambda x: x.cast("int")).alias("labels"))


def read_evaluation(spark: SparkSession, logits_path, labels_path) -> DataFrame:
    """Logits and labels of the same samples from two text matrices, matched by line number."""
    numbered = lambda path: with_line_number(spark.read.text(path)).withColumnRenamed("line", "ordinal")
    return parse_evaluation(numbered(logits_path), numbered(labels_path))


# --- genome ------------------------------------------------------------------------------------


def fasta_pieces(lines: DataFrame) -> DataFrame:
    """(accession, offset, seq) of FASTA lines, whatever the record length.

    ``lines`` has value, file, split and at (order inside the split). Each file split finds its own
    headers; splits without one inherit the record and offset of the split before.
    """
    split = ["file", "split"]
    header = F.when(F.col("value").startswith(">"), F.split(F.substring("value", F.lit(2), F.length("value")), r"\s")[0])
    marked = lines.withColumn("_record", header).withColumn("_bases", F.when(F.col("_record").isNull(), F.length(F.trim("value"))).otherwise(0))
    inside = W.partitionBy(*split).orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    seen = marked.withColumn("_named", F.last("_record", ignorenulls=True).over(inside)).withColumn(
        "_sum", F.sum("_bases").over(inside)
    ).withColumn("_at_header", F.max(F.when(F.col("_record").isNotNull(), F.col("_sum"))).over(inside))
    # Per split: its last record, and the bases after its last header.
    tails = seen.groupBy(*split).agg(
        F.max_by("_named", "at").alias("_tail"), (F.max("_sum") - F.coalesce(F.max("_at_header"), F.lit(0))).alias("_open")
    )
    across = W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, W.currentRow)
    runs = tails.withColumn("_run", F.count("_tail").over(across))
    carried = runs.withColumn("_record_in", F.last("_tail", ignorenulls=True).over(W.partitionBy("file").orderBy("split").rowsBetween(W.unboundedPreceding, -1)))
    carried = carried.withColumn("_cum", F.sum("_open").over(W.partitionBy("file", "_run").orderBy("split").rowsBetween(W.unboundedPreceding, W.currentRow)))
    carried = carried.withColumn("_offset_in", F.coalesce(F.lag("_cum").over(W.partitionBy("file").orderBy("split")), F.lit(0)))
    placed = seen.join(carried.select(*split, "_record_in", "_offset_in"), split)
    own = F.col("_named").isNotNull()
    return placed.filter("_record is null and _bases > 0").select(
        F.coalesce("_named", "_record_in").alias("accession"),
        (F.col("_sum") - F.col("_bases") + F.when(own, -F.col("_at_header")).otherwise(F.col("_offset_in"))).alias("offset"),
        F.upper(F.trim("value")).alias("seq"),
    )


def read_fasta(
    spark: SparkSession, path, ids: Sequence[str] | None = None, size: int = CHUNK, overlap: int = OVERLAP, numbered: bool = True,
) -> DataFrame:
    """Chunked genome of the listed records; with ``numbered`` accessions become chromosome numbers."""
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("at"),
    )
    return _chunks_of(lines, ids, size, overlap, numbered)


def read_fasta_blocks(
    spark: SparkSession, path: str, ids: Sequence[str] | None = None, size: int = CHUNK, overlap: int = OVERLAP, numbered: bool = True,
    split_bytes: int = bgzf.SPLIT_BYTES,
) -> DataFrame:
    """The same from a block-compressed file, read by many tasks; records may go on over blocks and splits."""
    return _chunks_of(bgzf.read_lines(spark, path, split_bytes), ids, size, overlap, numbered)


def _chunks_of(lines: DataFrame, ids: Sequence[str] | None, size: int, overlap: int, numbered: bool) -> DataFrame:
    pieces = fasta_pieces(lines)
    chrom = accession_to_number(F.col("accession")) if numbered else F.col("accession")
    if ids is not None:
        # The name is only looked up for listed records, wherever the optimizer puts the filter.
        listed = F.col("accession").isin(list(ids))
        pieces, chrom = pieces.filter(listed), F.when(listed, chrom)
    return chunk_pieces(cut_lineage(pieces.withColumn("chrom", chrom).select("chrom", "offset", "seq")), size, overlap)
