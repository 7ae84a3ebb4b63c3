"""The sample catalog: one row per track file."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Column order of the three catalogs and their folder names.
HISTONE = ["Study", "Accession", "Cultivar", "Tissue", "Histone_Mod", "File_Name", "Link", "Path", "Notes"]
CHROMATIN = ["Study", "Accession", "Cultivar", "Tissue", "Method", "File_Name", "Link", "Path", "Notes"]
METHYLATION = ["Study", "Accession", "Cultivar", "Tissue", "File_Name", "Link", "Path", "Notes"]
KINDS = {"histone": HISTONE, "chromatin": CHROMATIN, "dna_meth": METHYLATION}
CULTIVAR = "Nipponbare"


def catalog_rows(samples: DataFrame, kind: str, study: str, notes: str | None = None, cultivar: str = CULTIVAR) -> DataFrame:
    """New samples in catalog form: study, cultivar and notes stamped, path derived from their fields."""
    return samples.withColumns({
        "Study": F.lit(study), "Cultivar": F.lit(cultivar), "Notes": F.lit(notes).cast("string"),
    }).withColumn(
        "Path", F.concat_ws("/", F.lit(".data"), F.col("Study"), F.lit(kind), F.col("Tissue"), F.col("File_Name"))
    ).select(*KINDS[kind])


def add_samples(samples: DataFrame, path: str, kind: str, study: str, notes: str | None = None, cultivar: str = CULTIVAR) -> None:
    catalog_rows(samples, kind, study, notes, cultivar).write.mode("append").parquet(path)


def select_samples(catalog: DataFrame, **equals: str | None) -> DataFrame:
    """Rows whose named columns equal the given values; None leaves a column open."""
    for column, value in equals.items():
        if value is not None:
            catalog = catalog.filter(F.col(column) == value)
    return catalog


def sample_paths(catalog: DataFrame, column: str = "Path") -> DataFrame:
    return catalog.select(column)
