"""Sinks. All of them write one file per task; nothing is gathered first."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F


def tsv_lines(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(value) lines of the rows; missing is empty."""
    return df.select(F.array_join(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns or df.columns]), "\t").alias("value"))


def write_tsv(df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "overwrite") -> None:
    (df.select(*columns) if columns else df).write.mode(mode).csv(path, sep="\t", header=True)


def bed_lines(df: DataFrame) -> DataFrame:
    """(value) lines with Chr-prefixed names and integer coordinates."""
    named = df.select(F.concat(F.lit("Chr"), F.col("chrom").cast("string")).alias("chrom"), F.col("start").cast("long"), F.col("end").cast("long"))
    return tsv_lines(named)


def write_bed(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    bed_lines(df).write.mode(mode).text(path)


def vcf_lines(df: DataFrame) -> DataFrame:
    """(value) lines of a sites file, header first, then rows by chromosome and position; missing is a dot."""
    fields = ["CHR", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO"]
    body = df.select(
        F.lit(2).alias("_part"), F.col("CHR").alias("_chrom"), F.col("POS").cast("long").alias("_pos"),
        F.concat_ws("\t", *[F.coalesce(F.col(f).cast("string"), F.lit(".")) for f in fields]).alias("value"),
    )
    header = df.sparkSession.range(1).select(F.explode(F.array(
        F.struct(F.lit(0).alias("_part"), F.lit("##fileformat=VCFv4.2").alias("value")),
        F.struct(F.lit(1).alias("_part"), F.lit("#CHROM\t" + "\t".join(fields[1:])).alias("value")),
    )).alias("h")).select("h._part", F.lit(None).cast(df.schema["CHR"].dataType).alias("_chrom"), F.lit(None).cast("long").alias("_pos"), "h.value")
    return header.unionByName(body).orderBy("_part", "_chrom", "_pos", "value").select("value")


def write_vcf(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Ordered part files; joined in name order they are one VCF."""
    vcf_lines(df).write.mode(mode).text(path)


def write_samples(
    df: DataFrame, path: str, by: str = "chr", mode: str = "overwrite", position: str = "start", parts: int | None = None,
    row_group_bytes: int = 16 << 20,
) -> None:
    """Parquet per chromosome, zstd level 3, in order of position if there is such a column.

    Rows are dealt by ranges of (chromosome, position): a chromosome has as many files as its share of the rows, a hot one many,
    and a region lies in a few files and row groups of them.
    """
    clustered = df
    if position in df.columns:
        ranged = df.repartitionByRange(parts, by, position) if parts else df.repartitionByRange(by, position)
        clustered = ranged.sortWithinPartitions(by, position)
    clustered.write.mode(mode).partitionBy(by).options(**{
        "compression": "zstd", "parquet.compression.codec.zstd.level": "3", "parquet.block.size": str(row_group_bytes),
    }).parquet(path)


def write_per_feature(df: DataFrame, path: str, feature: str = "feature", mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(feature).csv(path, sep="\t", header=True)


def write_if_absent(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Leave an existing result alone unless told otherwise."""
    df.write.mode("overwrite" if overwrite else "ignore").csv(path, header=True)


def write_with_metadata(df: DataFrame, path: str, facts: Mapping[str, str], mode: str = "overwrite") -> None:
    """The result as TSV and its run facts as a one-row JSON table beside it."""
    write_tsv(df, f"{path}/result", mode=mode)
    json_lines(with_facts(df.sparkSession.range(1), facts).drop("id")).write.mode(mode).text(f"{path}/metadata")


def with_facts(df: DataFrame, facts: Mapping[str, str]) -> DataFrame:
    """The facts of a run as constant columns."""
    return df.withColumns({k: F.lit(v) for k, v in facts.items()})


def json_lines(df: DataFrame) -> DataFrame:
    """(value) one JSON object per row."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))


def write_best_metrics(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    json_lines(df).write.mode(mode).text(path)


def write_evaluation(df: DataFrame, path: str, key: str, mode: str = "overwrite") -> None:
    """Logits and labels of the same samples as one dataset (key, logits, labels)."""
    df.select(key, "logits", "labels").write.mode(mode).parquet(path)


def write_kmer_list(df: DataFrame, path: str, rows_per_file: int = 50_000, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("maxRecordsPerFile", rows_per_file).parquet(path)


def write_splits(df: DataFrame, stats: DataFrame, path: str, by: Sequence[str] = ("split", "chr"), mode: str = "overwrite") -> None:
    """Datasets by split and chromosome with their size table."""
    df.write.mode(mode).partitionBy(*by).parquet(f"{path}/data")
    stats.write.mode(mode).csv(f"{path}/stats", header=True)
