"""Genomic inputs derived from the given tables, in Spark and as SQL views."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from varloom.functions.scores import sigmoid
from varloom.operators.scale import position_scan, spread
from varloom.plans.registry import view
from varloom.session import cut_lineage

FEATURES = [f"f{i:02d}" for i in range(12)]
EVENT_TYPES = ["click", "error", "purchase", "signup", "view"]
LEVEL = 0.05
# 2024-01-01 as days since 1970; positions count seconds from there.
_DAY_ZERO = 19723


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def r6(column: Column) -> Column:
    """Six digits, without a negative zero."""
    return F.round(column, 6) + F.lit(0.0)


def _letter(index: Column) -> Column:
    return F.substring(F.lit("ACGT"), (index + 1).cast("int"), F.lit(1))


def variants(spark: SparkSession, sf: str) -> DataFrame:
    ts = F.col("ts")
    # Built from calendar fields, so the session time zone does not matter.
    seconds = (F.unix_date(F.to_date(ts)) - _DAY_ZERO).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        e.alias("variant_key"), (F.col("user_id") % 12 + 1).cast("int").alias("chrom"), (seconds + 1).cast("long").alias("pos"),
        _letter(e % 4).alias("ref"), _letter((e + 1 + e % 3) % 4).alias("alt"), F.col("value").alias("score"), "event_type",
    )


view("variants", """
  SELECT event_id AS variant_key, CAST(user_id % 12 + 1 AS INTEGER) AS chrom,
         CAST(epoch_us(ts) // 1000000 - 1704067200 + 1 AS BIGINT) AS pos,
         substr('ACGT', CAST(event_id % 4 + 1 AS INTEGER), 1) AS ref,
         substr('ACGT', CAST((event_id + 1 + event_id % 3) % 4 + 1 AS INTEGER), 1) AS alt,
         value AS score, event_type
  FROM events""")


def intervals(spark: SparkSession, sf: str) -> DataFrame:
    return variants(spark, sf).select(
        "chrom", F.col("pos").alias("start"), (F.col("pos") + F.floor(F.col("score") * 300) + 1).alias("end"),
        F.col("event_type").alias("feature"), (F.col("variant_key") % 3).alias("sample"), F.col("variant_key").alias("interval_id"),
    )


view("intervals", """
  SELECT chrom, pos AS start, pos + CAST(floor(score * 300) AS BIGINT) + 1 AS "end",
         event_type AS feature, variant_key % 3 AS sample, variant_key AS interval_id
  FROM variants""")


def genes(spark: SparkSession, sf: str) -> DataFrame:
    """1-based inclusive ranges."""
    return intervals(spark, sf).filter("feature = 'purchase'").select("chrom", "start", (F.col("end") - 1).alias("end"))


view("genes", """SELECT chrom, start, "end" - 1 AS "end" FROM intervals WHERE feature = 'purchase'""")


def runs(spark: SparkSession, sf: str) -> DataFrame:
    """Disjoint signal runs: each position keeps its largest value up to the next position."""
    points = variants(spark, sf).groupBy("chrom", F.col("pos").alias("start")).agg(F.max("score").alias("value"))
    scanned = position_scan(points, ["chrom"], "start", following={"_next": (F.min, F.col("start"))})
    return scanned.select("chrom", "start", F.coalesce("_next", F.col("start") + 1).alias("end"), "value")


def stored_runs(spark: SparkSession, sf: str) -> DataFrame:
    """The same, made once for a query that reads them several times."""
    return cut_lineage(runs(spark, sf))


view("runs", """
  SELECT chrom, pos AS start, coalesce(lead(pos) OVER (PARTITION BY chrom ORDER BY pos), pos + 1) AS "end", value
  FROM (SELECT chrom, pos, max(score) AS value FROM variants GROUP BY chrom, pos)""")


def bins(spark: SparkSession, sf: str, size: int = 10_000) -> DataFrame:
    """Core bins over the length of every chromosome."""
    lengths = intervals(spark, sf).groupBy("chrom").agg(F.max("end").alias("length"))
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(size).cast("long")))
    return lengths.select("chrom", start.alias("start")).withColumn("end", F.col("start") + size)


view("bins", """
  SELECT chrom, CAST(u.s AS BIGINT) AS start, CAST(u.s + 10000 AS BIGINT) AS "end"
  FROM (SELECT chrom, max("end") AS length FROM intervals GROUP BY chrom) l, LATERAL (SELECT unnest(range(0, l.length, 10000)) AS s) u""")


def probabilities(spark: SparkSession, sf: str) -> DataFrame:
    """Long (variant_key, feature, p_ref, p_alt)."""
    x = lambda i: F.col("embedding")[i].cast("double")
    cells = F.array(*[
        F.struct(F.lit(f).alias("feature"), sigmoid(x(i)).alias("p_ref"), sigmoid(x(12 + i)).alias("p_alt")) for i, f in enumerate(FEATURES)
    ])
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("variant_key"), F.explode(cells).alias("c")).select("variant_key", "c.*")


view("probabilities", """
  SELECT vec_id AS variant_key, printf('f%02d', i) AS feature,
         1 / (1 + exp(-CAST(embedding[i + 1] AS DOUBLE))) AS p_ref,
         1 / (1 + exp(-CAST(embedding[i + 13] AS DOUBLE))) AS p_alt
  FROM embeddings, range(12) t(i)""")
view("log_odds", """
  SELECT variant_key, feature, p_ref, p_alt, ln(p_alt / (1 - p_alt)) - ln(p_ref / (1 - p_ref)) AS score FROM probabilities""")


def labeled_vectors(spark: SparkSession, sf: str) -> DataFrame:
    """One row per vector with a 0/1 column per feature; ``chrom`` is 1..10."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("row_id"), (F.col("label") + 1).cast("int").alias("chrom"),
        *[(F.col("embedding")[24 + i] > 0).cast("int").alias(f) for i, f in enumerate(FEATURES)],
    )


view("labeled_vectors", "SELECT vec_id AS row_id, CAST(label + 1 AS INTEGER) AS chrom, "
     + ", ".join(f"CAST(embedding[{25 + i}] > 0 AS INTEGER) AS {f}" for i, f in enumerate(FEATURES)) + " FROM embeddings")
view("labels_long", "SELECT row_id, chrom, feature, y FROM labeled_vectors UNPIVOT (y FOR feature IN (" + ", ".join(FEATURES) + "))")


def evaluations(spark: SparkSession, sf: str) -> DataFrame:
    """(label, logit, p, y) per vector and feature."""
    from varloom.operators.evaluate import evaluation_rows

    source = table(spark, sf, "embeddings").select(
        F.slice("embedding", 1, 12).alias("logits"), F.transform(F.slice("embedding", 25, 12), lambda x: (x > 0).cast("int")).alias("labels")
    )
    return evaluation_rows(source, FEATURES)


view("evaluations", """
  SELECT printf('f%02d', i) AS label, CAST(embedding[i + 1] AS DOUBLE) AS logit,
         1 / (1 + exp(-CAST(embedding[i + 1] AS DOUBLE))) AS p, CAST(embedding[i + 25] > 0 AS INTEGER) AS y
  FROM embeddings, range(12) t(i)""")


def event_evaluations(spark: SparkSession, sf: str) -> DataFrame:
    """A larger evaluation set with tied scores: one label per event type."""
    return table(spark, sf, "events").select(
        F.col("event_type").alias("label"), (F.col("value") / 100 - 1).alias("logit"),
        sigmoid(F.col("value") / 100 - 1).alias("p"), (F.col("event_id") * 7 % 11 < 5).cast("int").alias("y"),
    )


view("event_evaluations", """
  SELECT event_type AS label, value / 100 - 1 AS logit, 1 / (1 + exp(-(value / 100 - 1))) AS p, CAST(event_id * 7 % 11 < 5 AS INTEGER) AS y FROM events""")


def prevalence(spark: SparkSession, sf: str) -> DataFrame:
    """Long (chrom, feature, ones, zeros, ratio) of document labels by language."""
    from varloom.operators.labels import column_prevalence

    return column_prevalence(labeled_documents(spark, sf), ["quality", "toxic"], ["lang"]).withColumnRenamed("lang", "chrom")


def labeled_documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "lang", "source").join(table(spark, sf, "labels"), "doc_id")


view("labeled_documents", "SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d JOIN labels l USING (doc_id)")
view("prevalence", """
  SELECT lang AS chrom, feature, CAST(sum(y) AS BIGINT) AS ones, count(*) FILTER (y = 0) AS zeros, avg(y) AS ratio
  FROM labeled_documents UNPIVOT (y FOR feature IN (quality, toxic)) GROUP BY ALL""")

# Letters A to Z and the space as bases.
_FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ "
_TO = "ACGTACGTACGTACGTACGTACGTACN"


def sequences(spark: SparkSession, sf: str) -> DataFrame:
    """Every document as a DNA string (chrom = doc_id)."""
    known, bases = _FROM + _FROM.strip().lower(), F.lit(_TO + _TO[:26])
    texts = spread(table(spark, sf, "documents").select("doc_id", "text"), "doc_id")
    # Letters without a base are listed behind the others, and so left out; a regular expression takes ten times as long.
    listed = F.concat(F.lit(known), F.translate("text", known, ""))
    return texts.select(F.col("doc_id").alias("chrom"), F.call_function("translate", F.col("text"), listed, bases).alias("seq"))


def stored_sequences(spark: SparkSession, sf: str) -> DataFrame:
    """The same, made once for a query that reads it several times."""
    return cut_lineage(sequences(spark, sf))


view("dna", f"""
  SELECT doc_id AS chrom, translate(upper(regexp_replace(text, '[^A-Za-z ]', '', 'g')), '{_FROM}', '{_TO}') AS seq FROM documents""")


def genome_variants(spark: SparkSession, sf: str, dna: DataFrame) -> DataFrame:
    """Every event as a variant in some document: (variant_key, chrom, pos, ref, alt)."""
    dna = dna.select("chrom", F.length("seq").alias("_length")).filter("_length > 0")
    docs = table(spark, sf, "documents").agg(F.count(F.lit(1)).alias("_docs"))
    placed = variants(spark, sf).crossJoin(F.broadcast(docs)).select(  # one row
        "variant_key", (F.col("variant_key") % F.col("_docs")).alias("chrom"), "pos", "ref", "alt"
    )
    return placed.join(dna, "chrom").select("variant_key", "chrom", (F.col("pos") % F.col("_length") + 1).alias("pos"), "ref", "alt")


view("genome_variants", """
  SELECT variant_key, v.doc AS chrom, v.pos % length(d.seq) + 1 AS pos, ref, alt
  FROM (SELECT *, variant_key % (SELECT count(*) FROM documents) AS doc FROM variants) v JOIN dna d ON d.chrom = v.doc
  WHERE length(d.seq) > 0""")
