"""Queries on the text formats: lines made from the tables, parsed, and rows written as lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.operators import genome, intervals as iv, sampling, stats
from varloom.plans.inputs import bins, genome_variants, intervals, stored_sequences, table, variants
from varloom.plans.queries_scores import _ld
from varloom.plans.queries_sequences import _LENGTH, _OVERLAP, _SIZE, chunks
from varloom.plans.registry import query, view
from varloom.session import cut_lineage, shared_path
from varloom.sources import npy, readers, writers


def _lines(df, *fields, **others):
    """Tab-separated lines of the columns; ``others`` are further columns of the frame of lines."""
    values = [F.coalesce(F.col(f) if isinstance(f, str) else f, F.lit(".")) for f in (g.cast("string") if not isinstance(g, str) else F.col(g).cast("string") for g in fields)]
    return df.select(F.concat_ws("\t", *values).alias("value"), *[c.alias(n) for n, c in others.items()])


def _with(df, *extra):
    """The lines and further lines that every file may hold."""
    first = df.limit(1).select(F.explode(F.array(*[F.lit(e) for e in extra])).alias("value"), *[c for c in df.columns if c != "value"])
    return df.unionByName(first)


# --- variants --------------------------------------------------------------------------------------


@query("SELECT chrom, pos, 'v' || variant_key AS id, ref, alt FROM variants")
def snp_list(spark, sf):
    lines = _lines(variants(spark, sf), "chrom", "pos", F.concat(F.lit("v"), "variant_key"), "ref", "alt")
    return readers.parse_snp_list(_with(lines, "chrom\tpos\tid\tref\talt", ""))


@query("""SELECT 'Chr' || chrom AS "CHR", pos AS "POS", CASE WHEN variant_key % 3 = 0 THEN NULL ELSE 'v' || variant_key END AS "ID", ref AS "REF", alt AS "ALT",
  NULL::VARCHAR AS "QUAL", 'PASS' AS "FILTER", 'AF=' || (variant_key % 100) || ';X' AS "INFO" FROM variants""")
def pvar_sites(spark, sf):
    k = F.col("variant_key")
    name = F.when(k % 3 > 0, F.concat(F.lit("v"), k))
    lines = _lines(
        variants(spark, sf), F.concat(F.lit("Chr"), "chrom"), "pos", name, "ref", "alt", F.lit(None), F.lit("PASS"), F.concat(F.lit("AF="), k % 100, F.lit(";X"))
    )
    return readers.parse_pvar(_with(lines, "##meta", "#CHROM\tPOS"))


@query("""SELECT CAST(chrom AS VARCHAR) AS "CHR", 'v' || variant_key AS "SNP", score / 8 AS "CM", pos AS "BP", ref AS "A1", alt AS "A2" FROM variants""")
def bim_sites(spark, sf):
    return readers.parse_bim(_lines(variants(spark, sf), "chrom", F.concat(F.lit("v"), "variant_key"), F.col("score") / 8, "pos", "ref", "alt"))


# --- intervals and tracks --------------------------------------------------------------------------


@query("""SELECT 'chr' || chrom AS chrom, start, "end", feature FROM intervals""")
def bed_with_feature(spark, sf):
    name = F.concat("feature", F.lit("_rep"), "sample", F.lit(".bed"))
    return readers.parse_bed(_lines(intervals(spark, sf), F.concat(F.lit("chr"), "chrom"), "start", "end", file=name), True)


@query("""SELECT CAST(chrom AS VARCHAR) AS chrom, pos AS start, pos + 5 AS "end", score AS value, event_type || '.1' AS sample FROM variants""")
def bedgraph_runs(spark, sf):
    v = variants(spark, sf)
    lines = _lines(v, "chrom", "pos", F.col("pos") + 5, "score", file=F.concat("event_type", F.lit(".1.bdg")))
    return readers.parse_bedgraph(_with(lines, "#track"))


@query("""SELECT 'a' || chrom AS "chrA", start AS "startA", "end" AS "endA", 'b' || chrom AS "chrB", start + 7 AS "startB", "end" + 9 AS "endB", interval_id % 50 - 1 AS distance, feature FROM intervals""")
def closest_files(spark, sf):
    lines = _lines(
        intervals(spark, sf), F.concat(F.lit("a"), "chrom"), "start", "end", F.concat(F.lit("b"), "chrom"), F.col("start") + 7, F.col("end") + 9,
        F.col("interval_id") % 50 - 1, file=F.concat(F.lit("x_"), "feature", F.lit(".tsv")),
    )
    return readers.parse_closest(lines)


@query("""SELECT CAST(chrom AS VARCHAR) AS chrom, start, "end", (start / 10000) % 101 / 2 AS percent_covered, 's' || (chrom % 3) AS sample FROM bins""")
def coverage_files(spark, sf):
    percent = F.col("start") / 10000 % 101 / 2
    lines = _lines(
        bins(spark, sf), "chrom", "start", "end", F.lit(1), F.lit(2), F.col("end") - F.col("start"), percent / 100, percent,
        file=F.concat(F.lit("s"), F.col("chrom") % 3, F.lit(".tsv")),
    )
    return readers.parse_coverage(_with(lines, "\t".join(f.split()[0] for f in readers.COVERAGE.split(", "))))


@query("""SELECT 'chr' || "l" AS chrom, "s" AS start, "e" AS "end" FROM (SELECT chrom AS l, min(start) AS s, max("end") AS e FROM (
    SELECT *, sum(opens) OVER (PARTITION BY feature, chrom ORDER BY start, "end" ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN start <= max("end") OVER (PARTITION BY feature, chrom ORDER BY start, "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        THEN 0 ELSE 1 END AS opens FROM intervals WHERE sample = 0)) GROUP BY feature, chrom, island)""")
def consensus_of_one_sample(spark, sf):
    found = iv.consensus(intervals(spark, sf).filter("sample = 0"))
    return found.select(F.concat(F.lit("chr"), "chrom").alias("chrom"), "start", "end")


# --- small tables, matrices and logs -----------------------------------------------------------------


@query("SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS ordinal, s_name AS feature FROM supplier")
def feature_list(spark, sf):
    lines = table(spark, sf, "supplier").select(F.col("s_name").alias("value"), F.col("s_suppkey").alias("at"))
    return readers.parse_features(_with(lines, "features"))


view("supplier_features", "SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS ordinal, s_name AS feature FROM supplier")


@query("""
  SELECT f.feature, 'Chr' || c.n AS chrom, c.ones, c.zeros, c.ratio FROM supplier_features f JOIN (
    SELECT s_nationkey AS n, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) - 1 AS ordinal, s_suppkey AS ones, 2 * s_suppkey AS zeros, s_suppkey / 8 AS ratio FROM supplier) c USING (ordinal)""")
def prevalence_files(spark, sf):
    k = F.col("s_suppkey")
    lines = table(spark, sf, "supplier").select(
        F.concat_ws(",", k.cast("string"), (2 * k).cast("string"), (k / 8).cast("string")).alias("value"),
        F.concat("s_nationkey", F.lit(".csv")).alias("file"), k.alias("at"),
    )
    return readers.parse_prevalence(_with(lines, "1,0,ratio"), feature_list(spark, sf))


@query("SELECT l_discount AS significance_lvl, l_quantity / 4 AS score, 'f' || l_linenumber AS feature FROM lineitem")
def threshold_files(spark, sf):
    lines = _lines(
        table(spark, sf, "lineitem"), F.col("l_discount").cast("double"), F.col("l_quantity").cast("double") / 4,
        file=F.concat(F.lit("f"), "l_linenumber", F.lit(".tsv")),
    )
    return readers.parse_thresholds(_with(lines, "significance_lvl\tscore"), True)


@query("SELECT vec_id AS i, CAST(u.j - 1 AS BIGINT) AS j, CAST(embedding[u.j] AS DOUBLE) AS r FROM embeddings, LATERAL (SELECT unnest(range(1, len(embedding) + 1)) AS j) u")
def matrix_cells(spark, sf):
    numbers = F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), "  ")
    return readers.parse_matrix(table(spark, sf, "embeddings").select(F.col("vec_id").alias("ordinal"), F.concat(F.lit(" "), numbers).alias("value")))


@query("""
  SELECT vec_id AS ordinal, array_to_string(list_transform(embedding[1:12], lambda x: CAST(round(CAST(x AS DOUBLE) * 10000) AS BIGINT)), ' ') AS logits,
         array_to_string(list_transform(embedding[25:36], lambda x: CAST(x > 0 AS INTEGER)), ' ') AS labels FROM embeddings""")
def logits_and_labels(spark, sf):
    e, key = table(spark, sf, "embeddings"), F.col("vec_id").alias("ordinal")
    joined = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), " ")
    logits = F.transform(F.slice("embedding", 1, 12), lambda x: F.round(x.cast("double") * 10000).cast("long"))
    labels = F.transform(F.slice("embedding", 25, 12), lambda x: (x > 0).cast("int"))
    both = readers.parse_evaluation(e.select(key, joined(logits).alias("value")), e.select(key, joined(labels).alias("value")))
    return both.select("ordinal", joined(F.transform("logits", lambda x: x.cast("long"))).alias("logits"), joined(F.col("labels")).alias("labels"))


@query("SELECT event_id % 20 * 50 AS step, value AS eval_loss, event_type AS model FROM events")
def best_records_of_models(spark, sf):
    e = table(spark, sf, "events")
    record = F.to_json(F.struct((F.col("event_id") % 20 * 50).alias("step"), F.col("value").alias("eval_loss")))
    path = F.concat(F.lit("file:/runs/"), "event_type", F.lit("/best.json"))
    return readers.parse_best_metrics(e.select(record.alias("value"), path.alias("path")), "step long, eval_loss double")


@query("SELECT count(DISTINCT u.j) AS n_ld, count(DISTINCT u.j) AS n_scores FROM embeddings, LATERAL (SELECT unnest(range(len(embedding))) AS j) u")
def ld_size(spark, sf):
    """The LD matrix of all components against one score for each."""
    scores = table(spark, sf, "embeddings").select(F.posexplode("embedding").alias("i", "x")).groupBy("i").agg(F.avg("x").alias("score"))
    return stats.check_ld_size(_ld(spark, sf), scores)


@query("""
  SELECT variant_key, CASE WHEN variant_key % 5 = 0 THEN 'alternate is not one base: ' || alt || 'A' ELSE 'window leaves its chromosome: ' || chrom || ':' || pos END AS problem
  FROM genome_variants g WHERE variant_key % 5 = 0 OR variant_key NOT IN (SELECT variant_key FROM windows)""")
def long_alternates(spark, sf):
    """Alternates of more than one base are refused, as are windows that leave their sequence."""
    dna = stored_sequences(spark, sf)
    snps = cut_lineage(genome_variants(spark, sf, dna))
    longer = snps.withColumn("alt", F.when(F.col("variant_key") % 5 == 0, F.concat("alt", F.lit("A"))).otherwise(F.col("alt")))
    return genome.extract_windows(longer, chunks(spark, sf, dna), _LENGTH, _SIZE, _OVERLAP, on_error="split")[1].select("variant_key", "problem")


@query("SELECT ordinal, u.j, CAST(embedding[u.j + 1] AS DOUBLE) AS value FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS ordinal, embedding FROM embeddings), LATERAL (SELECT unnest(range(64)) AS j) u")
def matrix_from_npy(spark, sf):
    """All vectors as one matrix in npy files, read back by splits."""
    path = shared_path(spark, "matrix")
    npy.write_npy(table(spark, sf, "embeddings").withColumnRenamed("embedding", "values"), path, "vec_id", dtype="<f4")
    return npy.read_npy(spark, path, split_bytes=32 << 10).select("ordinal", F.posexplode("values").alias("j", "value")).withColumn("j", F.col("j").cast("long"))


@query('SELECT chrom AS chr, start, "end", feature, interval_id FROM intervals WHERE chrom = 5 AND start < 1000000 AND "end" > 500000')
def samples_of_region(spark, sf):
    """Samples that overlap a region, from files in order of position."""
    path = shared_path(spark, "samples")
    writers.write_samples(intervals(spark, sf).drop("sample").withColumnRenamed("chrom", "chr"), path)
    return readers.read_samples(spark, path, region=(5, 500_000, 1_000_000)).select("chr", "start", "end", "feature", "interval_id")


# --- rows as lines ---------------------------------------------------------------------------------


@query("SELECT chrom || chr(9) || pos || chr(9) || ref || chr(9) || CASE WHEN variant_key % 3 = 0 THEN '' ELSE alt END AS value FROM variants")
def tsv_lines(spark, sf):
    v = variants(spark, sf).withColumn("alt", F.when(F.col("variant_key") % 3 > 0, F.col("alt")))
    return writers.tsv_lines(v, ["chrom", "pos", "ref", "alt"])


@query("""SELECT 'Chr' || chrom || chr(9) || start || chr(9) || "end" AS value FROM intervals""")
def bed_lines(spark, sf):
    return writers.bed_lines(intervals(spark, sf))


@query("""SELECT '{"variant_key":' || variant_key || ',"ref":"' || ref || '","M":"40","q":"0.2","method":"bh","M_eff":"32"}' AS value FROM variants""")
def rows_with_run_facts(spark, sf):
    rows = variants(spark, sf).select("variant_key", "ref")
    return writers.json_lines(writers.with_facts(rows, stats.run_metadata(40, 32, 0.2, "bh")))


@query("""SELECT '{"label":"' || label || '","rows":' || count(*) || '}' AS value FROM (SELECT CAST(label AS VARCHAR) AS label FROM embeddings) GROUP BY label""")
def json_lines(spark, sf):
    counted = table(spark, sf, "embeddings").groupBy(F.col("label").cast("string").alias("label")).agg(F.count(F.lit(1)).alias("rows"))
    return writers.json_lines(counted)


@query("""SELECT chrom || chr(9) || count(*) || chr(9) || count(*) FILTER (chrom NOT IN (6, 7)) || chr(9) || count(*) FILTER (chrom = 7) || chr(9) || count(*) FILTER (chrom = 6) AS value
  FROM variants GROUP BY chrom""")
def split_stat_lines(spark, sf):
    return writers.tsv_lines(sampling.split_stats(sampling.chromosome_split(variants(spark, sf))))
