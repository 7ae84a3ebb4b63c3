"""Queries on variant formats, filters, positive and negative sets, the catalog, and whole flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions import naming
from varloom.functions.naming import ACCESSIONS, position_id
from varloom.operators import genome, kmer_track, scoring, variants as vt
from varloom.plans import flows
from varloom.plans.inputs import EVENT_TYPES, FEATURES, genes, genome_variants, intervals, labeled_vectors, r6, stored_sequences, table, variants
from varloom.plans.queries_sequences import _LENGTH, _MODEL, _OVERLAP, _SIZE, chunks, kmer_weights
from varloom.plans.registry import query, view
from varloom.session import cut_lineage
from varloom.sources import catalog, readers, writers

_SQL_ACCESSIONS = "[" + ", ".join(f"'{a}'" for a in ACCESSIONS) + "]"

# --- text formats --------------------------------------------------------------------------------


def _vcf_text(spark, sf):
    """VCF lines: a header line for every thousandth record, every ninth site with two alternates."""
    v = variants(spark, sf)
    accession = F.array(*[F.lit(a) for a in ACCESSIONS])[F.col("chrom") - 1]
    alt = F.when(F.col("variant_key") % 9 == 0, F.concat("alt", F.lit(","), "ref")).otherwise(F.col("alt"))
    line = F.concat_ws("\t", accession, F.col("pos").cast("string"), F.lit("."), F.col("ref"), alt, F.lit("."), F.lit("PASS"), F.lit("DP=3"))
    header = F.when(F.col("variant_key") % 1000 == 0, F.array(F.lit("##meta"), line)).otherwise(F.array(line))
    return v.select(F.explode(header).alias("value"))


@query(f"""
  SELECT chrom, pos, 'Chr' || chrom || ':' || pos || '_' || ref || alt AS id, ref, alt FROM variants WHERE variant_key % 9 <> 0""")
def vcf_to_snp_list(spark, sf):
    sites, _ = readers.parse_vcf(_vcf_text(spark, sf), on_error="split")
    return readers.vcf_to_snp_list(sites)


@query(f"SELECT {_SQL_ACCESSIONS}[chrom] AS \"CHROM\", pos AS \"POS\", ref AS \"REF\", alt || ',' || ref AS \"ALT\" FROM variants WHERE variant_key % 9 = 0")
def vcf_multiallelic_sites(spark, sf):
    return readers.parse_vcf(_vcf_text(spark, sf), on_error="split")[1].select("CHROM", "POS", "REF", "ALT")


@query("""
  SELECT 'gene' || interval_id AS gene_id, printf('chr%02d', chrom) AS chrom, start, "end", CASE WHEN interval_id % 2 = 0 THEN '+' ELSE '-' END AS strand
  FROM intervals WHERE feature = 'signup'""")
def gene_ranges(spark, sf):
    i = F.col("interval_id")
    kind = F.when(F.col("feature") == "signup", "gene").otherwise("exon")
    text = F.concat_ws(
        "\t", F.format_string("chr%02d", F.col("chrom")), F.lit("src"), kind, F.col("start").cast("string"), F.col("end").cast("string"), F.lit("."),
        F.when(i % 2 == 0, "+").otherwise("-"), F.lit("."), F.concat(F.lit("ID=gene"), i.cast("string"), F.lit(";Name=x")),
    )
    return vt.gene_ranges(readers.parse_gff(intervals(spark, sf).select(text.alias("value"))))


def _freq_text(spark, sf):
    """Ragged frequency lines of line items: two alleles, sometimes a third."""
    d = F.round(F.col("l_discount") * 5, 2)
    third = F.when(F.col("l_linenumber") % 3 == 0, F.lit("\tT:0.05")).otherwise(F.lit(""))
    text = F.concat(F.concat_ws(
        "\t", F.col("l_suppkey").cast("string"), F.col("l_orderkey").cast("string"), F.when(F.col("l_linenumber") % 3 == 0, "3").otherwise("2"), F.lit("20"),
        F.concat(F.lit("A:"), F.round(1 - d, 2).cast("string")), F.concat(F.lit("G:"), d.cast("string")),
    ), third)
    return table(spark, sf, "lineitem").select(text.alias("value"))


view("frequencies", """
  SELECT CAST(l_suppkey AS VARCHAR) AS "CHROM", l_orderkey AS "POS", CASE WHEN l_linenumber % 3 = 0 THEN 3 ELSE 2 END AS "N_ALLELES", 20 AS "N_CHR",
         round(least(greatest(round(1 - round(l_discount * 5, 2), 2), round(l_discount * 5, 2), CASE WHEN l_linenumber % 3 = 0 THEN 0.05::DOUBLE ELSE 0 END),
         1 - greatest(round(1 - round(l_discount * 5, 2), 2), round(l_discount * 5, 2), CASE WHEN l_linenumber % 3 = 0 THEN 0.05::DOUBLE ELSE 0 END)), 5) + 0.0 AS "MAF" FROM lineitem""")


@query("""
  SELECT "CHROM", "POS", "N_ALLELES", "N_CHR", "MAF", round((rank() OVER (ORDER BY "MAF") + (count(*) OVER (PARTITION BY "MAF") - 1) / 2.0) / count(*) OVER (), 5) AS "MAF_PCT"
  FROM frequencies""")
def allele_frequency_maf(spark, sf):
    return vt.maf_table(readers.parse_freq(_freq_text(spark, sf))).withColumn("MAF", F.col("MAF") + F.lit(0.0))


def _sites(spark, sf):
    """pvar-like sites: quality, alternates with commas and deletions, and a frequency in INFO."""
    k = F.col("variant_key")
    alt = F.when(k % 11 == 0, F.concat("alt", F.lit(",T"))).when(k % 13 == 0, F.lit("*")).otherwise(F.col("alt"))
    return variants(spark, sf).select(
        "variant_key", "chrom", "pos", "ref", alt.alias("alt"), F.when(k % 5 == 0, "LowQual").otherwise("PASS").alias("FILTER"),
        F.concat(F.lit("DP=7;MAF=0.9;AF="), F.format_string("%.3f", (k * 37 % 1000) / 1000), F.lit(",0.1")).alias("INFO"),
    )


view("sites", """
  SELECT variant_key, chrom, pos, ref, CASE WHEN variant_key % 11 = 0 THEN alt || ',T' WHEN variant_key % 13 = 0 THEN '*' ELSE alt END AS alt,
         CASE WHEN variant_key % 5 = 0 THEN 'LowQual' ELSE 'PASS' END AS filter, variant_key * 37 % 1000 / 1000::DOUBLE AS af FROM variants""")


@query("SELECT variant_key, round(af, 6) AS af, round(least(af, 1 - af), 6) AS maf FROM sites")
def info_frequencies(spark, sf):
    return vt.info_maf(_sites(spark, sf)).select("variant_key", r6(F.col("AF")).alias("af"), r6(F.col("MAF")).alias("maf"))


@query("SELECT variant_key, length(ref) = 1 AND length(alt) = 1 AND NOT contains(alt, ',') AS biallelic, NOT contains(alt, ',') AND alt <> '*' AS single FROM sites")
def allele_filters(spark, sf):
    return _sites(spark, sf).select(
        "variant_key", vt.is_biallelic_snp(F.col("ref"), F.col("alt")).alias("biallelic"), vt.is_single_alternate(F.col("alt")).alias("single")
    )


@query("SELECT variant_key, chrom, pos FROM variants WHERE chrom = 4 AND pos BETWEEN 100000 AND 900000")
def variants_in_region(spark, sf):
    return vt.in_region(variants(spark, sf), 4, 100_000, 900_000).select("variant_key", "chrom", "pos")


@query("""
  SELECT variant_key FROM variants v WHERE event_type <> 'view' AND NOT EXISTS (SELECT 1 FROM variants k WHERE k.event_type = 'view' AND k.chrom = v.chrom AND k.pos = v.pos)""")
def without_known_positions(spark, sf):
    v = variants(spark, sf)
    return vt.remove_positions(v.filter("event_type <> 'view'"), v.filter("event_type = 'view'")).select("variant_key")


# --- chromosome names ----------------------------------------------------------------------------


def _names(spark, sf):
    accession = F.array(*[F.lit(a) for a in ACCESSIONS])[F.col("chrom") - 1]
    k = F.col("variant_key") % 5
    number = F.col("chrom").cast("string")
    name = F.when(k == 0, accession).when(k == 1, F.concat(F.lit("chr"), number)).when(k == 2, F.concat(F.lit("CHR"), number)).when(k == 3, number).otherwise("scaffold9")
    return variants(spark, sf).select("variant_key", "chrom", name.alias("name"), accession.alias("accession"))


view("names", f"""
  SELECT variant_key, chrom, {_SQL_ACCESSIONS}[chrom] AS accession, CASE variant_key % 5 WHEN 0 THEN {_SQL_ACCESSIONS}[chrom] WHEN 1 THEN 'chr' || chrom WHEN 2 THEN 'CHR' || chrom
    WHEN 3 THEN CAST(chrom AS VARCHAR) ELSE 'scaffold9' END AS name FROM variants""")


@query("""
  SELECT variant_key, CASE variant_key % 5 WHEN 3 THEN name WHEN 4 THEN name ELSE 'Chr' || chrom END AS peak_name, CASE WHEN variant_key % 5 < 4 THEN 'chr' || chrom ELSE 'scaffold9' END AS consensus_name,
         variant_key % 5 < 4 AS known, chrom AS number, accession FROM names""")
def chromosome_names(spark, sf):
    name = F.col("name")
    valid = [f"chr{n}" for n in naming.CHROMOSOMES]
    return _names(spark, sf).select(
        "variant_key", naming.peak_chromosome(name).alias("peak_name"), naming.consensus_chromosome(name).alias("consensus_name"),
        naming.consensus_chromosome(name).isin(valid).alias("known"), naming.accession_to_number(F.col("accession")).alias("number"),
        naming.number_to_accession(F.col("chrom")).alias("accession"),
    )


@query("SELECT variant_key, 'chr' || chrom AS name FROM names WHERE variant_key % 5 < 4")
def known_chromosomes(spark, sf):
    return vt.split_known_chromosomes(_names(spark, sf), "name")[0].select("variant_key", "name")


@query("SELECT name, count(*) AS n FROM names WHERE variant_key % 5 = 4 GROUP BY name")
def rejected_chromosomes(spark, sf):
    return vt.split_known_chromosomes(_names(spark, sf), "name")[1].groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT (chrom, ref, alt)) AS n_variants FROM variants")
def unique_variants(spark, sf):
    return vt.unique_variants(variants(spark, sf).withColumn("id", F.concat_ws(":", "chrom", "ref", "alt")))


# --- positive and negative sets --------------------------------------------------------------------


def _annotations(spark, sf):
    k = F.col("variant_key")
    kind = F.when(k % 4 == 0, "Upstream_gene_variant").when(k % 4 == 1, "intergenic_region").when(k % 4 == 2, "missense_variant").otherwise("downstream_gene_variant")
    return variants(spark, sf).filter("event_type = 'click'").select(
        F.concat(F.lit("vg"), F.format_string("%02d", F.col("chrom")), F.format_string("%08d", F.col("pos"))).alias("var"),
        F.col("ref").alias("var_ref"), F.when(k % 10 == 0, F.concat("alt", F.lit(",A"))).otherwise(F.col("alt")).alias("alt"), kind.alias("snpeff_anno"),
    )


def _maf(spark, sf):
    """Frequencies of the sites, one row per position."""
    k = F.col("variant_key")
    per_site = variants(spark, sf).groupBy("chrom", "pos").agg(((F.min(k) * 37 % 500) / 1000).alias("MAF"))
    return vt.percent_rank(per_site, "MAF", "MAF_PCT", 5)


view("site_maf", """
  SELECT chrom, pos, maf, round((rank() OVER (ORDER BY maf) + (count(*) OVER (PARTITION BY maf) - 1) / 2.0) / count(*) OVER (), 5) AS pct
  FROM (SELECT chrom, pos, min(variant_key) * 37 % 500 / 1000::DOUBLE AS maf FROM variants GROUP BY chrom, pos)""")
view("functional", """
  SELECT chrom, pos, annot_id, id, ref, alt, maf, pct FROM (
    SELECT chrom, pos, 'vg' || printf('%02d', chrom) || printf('%08d', pos) AS annot_id, 'Chr' || chrom || ':' || pos || '_' || ref || alt AS id, ref, alt, maf, pct
    FROM variants JOIN site_maf USING (chrom, pos) WHERE event_type = 'click' AND variant_key % 10 <> 0 AND variant_key % 4 <> 2 AND maf > 0.1)
  QUALIFY row_number() OVER (PARTITION BY chrom, pos ORDER BY annot_id, id) = 1""")


@query('SELECT chrom, pos, annot_id, id, ref, alt, round(maf, 6) AS "MAF", round(pct, 6) AS "MAF_PCT" FROM functional')
def functional_snps(spark, sf):
    f = vt.functional_snps(_annotations(spark, sf), _maf(spark, sf))
    return f.withColumn("MAF", r6(F.col("MAF"))).withColumn("MAF_PCT", r6(F.col("MAF_PCT")))


@query("""
  SELECT v.variant_key, round(m.maf, 6) AS "MAF" FROM variants v LEFT JOIN (SELECT * FROM site_maf WHERE pos % 3 <> 0) m USING (chrom, pos)""")
def attach_frequencies(spark, sf):
    return vt.attach_maf(variants(spark, sf), _maf(spark, sf).filter("pos % 3 <> 0")).select("variant_key", r6(F.col("MAF")).alias("MAF"))


_DIST, _TOL, _COUNT = 20_000, 0.05, 2
view("free_sites", """
  SELECT variant_key, chrom, pos, least(af, 1 - af) AS maf FROM sites s WHERE length(alt) = 1 AND alt <> ','
  AND NOT EXISTS (SELECT 1 FROM variants k WHERE k.event_type = 'click' AND k.chrom = s.chrom AND k.pos = s.pos)""")
view("candidates", """
  SELECT * FROM (SELECT variant_key, chrom, pos, maf, round((rank() OVER (ORDER BY maf) + (count(*) OVER (PARTITION BY maf) - 1) / 2.0) / count(*) OVER (), 5) AS pct FROM free_sites) s
  WHERE NOT EXISTS (SELECT 1 FROM genes g WHERE g.chrom = s.chrom AND s.pos BETWEEN g.start AND g."end")""")


def _offers(positives, candidates):
    return f"""
  SELECT c.variant_key, c.chrom, c.pos, p.pos AS positive_pos, abs(c.pos - p.pos) AS distance FROM {candidates} c JOIN (SELECT DISTINCT chrom, pos, pct FROM {positives}) p
  ON p.chrom = c.chrom AND abs(c.pos - p.pos) <= {_DIST} AND abs(CAST(round(c.pct * 100000) AS BIGINT) - CAST(round(p.pct * 100000) AS BIGINT)) <= {round(_TOL * 100000)}
  QUALIFY row_number() OVER (PARTITION BY c.variant_key ORDER BY abs(c.pos - p.pos), p.pos) = 1"""


view("offers", _offers("positives", "candidates"))
# Rounds of matching, more than the tables need: each takes from what the rounds before have left.
_ROUNDS = 6
view("short_1", f"SELECT DISTINCT chrom, pos, pct, {_COUNT} AS lack FROM positives")
view("free_1", "SELECT * FROM candidates")
for _i in range(1, _ROUNDS + 1):
    view(f"offers_{_i}", _offers(f"short_{_i}", f"free_{_i}"))
    view(f"sites_{_i}", f"SELECT * FROM offers_{_i} QUALIFY row_number() OVER (PARTITION BY chrom, pos ORDER BY distance, md5('42:' || variant_key), variant_key) = 1")
    view(f"taken_{_i}", f"""
  SELECT o.* FROM sites_{_i} o JOIN (SELECT chrom, pos AS positive_pos, lack FROM short_{_i}) s USING (chrom, positive_pos)
  QUALIFY row_number() OVER (PARTITION BY chrom, positive_pos ORDER BY distance, md5('42:' || variant_key), variant_key) <= any_value(lack) OVER (PARTITION BY chrom, positive_pos)""")
    view(f"short_{_i + 1}", f"""
  SELECT s.chrom, s.pos, s.pct, s.lack - coalesce(t.got, 0) AS lack FROM short_{_i} s LEFT JOIN (SELECT chrom, positive_pos AS pos, count(*) AS got FROM taken_{_i} GROUP BY ALL) t USING (chrom, pos)
  WHERE s.lack - coalesce(t.got, 0) > 0""")
    view(f"free_{_i + 1}", f"SELECT * FROM free_{_i} f WHERE NOT EXISTS (SELECT 1 FROM taken_{_i} t WHERE t.chrom = f.chrom AND t.pos = f.pos)")
view("positives", "SELECT * FROM functional ORDER BY md5('42:' || id), id LIMIT 60")


def _positive_negative(spark, sf):
    return flows.positives_and_negatives(
        _annotations(spark, sf), _maf(spark, sf), _sites(spark, sf), genes(spark, sf), 60, _DIST, _TOL, _COUNT
    )


@query("SELECT chrom, pos, id FROM positives")
def sampled_positives(spark, sf):
    return vt.sample_exact(vt.functional_snps(_annotations(spark, sf), _maf(spark, sf)), 60, 42, ["id"]).select("chrom", "pos", "id")


@query(" UNION ALL ".join(f"SELECT variant_key, chrom, pos, positive_pos, distance FROM taken_{i}" for i in range(1, _ROUNDS + 1)))
def matched_negatives(spark, sf):
    return _positive_negative(spark, sf)[1].select("variant_key", "chrom", "pos", "positive_pos", "distance")


@query("SELECT variant_key, chrom, pos, positive_pos, distance FROM offers")
def nearest_eligible_positive(spark, sf):
    """Every candidate with the positive it may serve."""
    positives = vt.sample_exact(vt.functional_snps(_annotations(spark, sf), _maf(spark, sf)), 60, 42, ["id"])
    known = _annotations(spark, sf).select(F.substring("var", 3, 2).cast("int").alias("chrom"), naming.annotation_pos(F.col("var")).alias("pos"))
    ranked = vt.percent_rank(vt.info_maf(vt.candidate_sites(_sites(spark, sf), known)), "MAF", "MAF_PCT", 5)
    candidates = vt.outside_genes(ranked, genes(spark, sf))
    offered = vt.nearest_eligible(positives.select("chrom", "pos", "MAF_PCT"), candidates, _DIST, _TOL)
    return offered.select("variant_key", "chrom", "pos", "positive_pos", "distance")


@query("""
  SELECT variant_key, chrom, pos FROM sites s JOIN (SELECT chrom, max(pos) AS length FROM variants GROUP BY chrom) l USING (chrom)
  WHERE filter = 'PASS' AND NOT contains(alt, ',') AND alt <> '*' AND pos > 1000 AND pos < length - 1000
  AND NOT EXISTS (SELECT 1 FROM genes g WHERE g.chrom = s.chrom AND s.pos BETWEEN g.start AND g."end")
  QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY md5('42:' || variant_key), variant_key) <= chrom * 3""")
def genomewide_sample(spark, sf):
    sites = _sites(spark, sf)
    lengths = sites.groupBy("chrom").agg(F.max("pos").alias("length"))
    quotas = lengths.select("chrom", (F.col("chrom") * 3).cast("long").alias("cnt"))
    return vt.genomewide_sample(sites, lengths, genes(spark, sf), quotas).select("variant_key", "chrom", "pos")


@query("""
  WITH body AS (SELECT chrom || chr(9) || pos || chr(9) || '.' || chr(9) || ref || chr(9) || alt || chr(9) || '.' || chr(9) || filter || chr(9) || '.' AS value FROM sites)
  SELECT value FROM body UNION ALL SELECT '##fileformat=VCFv4.2' UNION ALL SELECT array_to_string(['#CHROM', 'POS', 'ID', 'REF', 'ALT', 'QUAL', 'FILTER', 'INFO'], chr(9))""")
def vcf_lines(spark, sf):
    none = F.lit(None).cast("string")
    s = _sites(spark, sf).select(
        F.col("chrom").alias("CHR"), F.col("pos").alias("POS"), none.alias("ID"), F.col("ref").alias("REF"), F.col("alt").alias("ALT"), none.alias("QUAL"), "FILTER", none.alias("INFO")
    )
    return writers.vcf_lines(s)


# --- catalog -----------------------------------------------------------------------------------


def _catalog(spark, sf):
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return table(spark, sf, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").cast("string").alias("Accession"), F.col("n_name").alias("Tissue"), F.col("r_name").alias("Histone_Mod"),
        F.concat(F.col("s_name"), F.lit(".bw")).alias("File_Name"), F.lit("none").alias("Link"),
    )


@query("""
  SELECT 'S1' AS "Study", CAST(s_suppkey AS VARCHAR) AS "Accession", 'Nipponbare' AS "Cultivar", n_name AS "Tissue", r_name AS "Histone_Mod", s_name || '.bw' AS "File_Name", 'none' AS "Link",
         '.data/S1/histone/' || n_name || '/' || s_name || '.bw' AS "Path", 'batch' AS "Notes"
  FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def catalog_rows(spark, sf):
    return catalog.catalog_rows(_catalog(spark, sf), "histone", "S1", "batch")


@query("""
  SELECT '.data/S1/histone/' || n_name || '/' || s_name || '.bw' AS "Path" FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'""")
def catalog_paths(spark, sf):
    rows = catalog.catalog_rows(_catalog(spark, sf), "histone", "S1", "batch")
    return catalog.sample_paths(catalog.select_samples(rows, Study="S1", Histone_Mod="ASIA", Tissue=None))


# --- flows -------------------------------------------------------------------------------------

_DIFF = "(ln(p_alt / (1 - p_alt)) - ln(p_ref / (1 - p_ref)))"
view("window_effects", f"SELECT variant_key, sqrt(sum({_DIFF} * {_DIFF})) AS overall FROM window_scores GROUP BY variant_key")


def _kmer_scorer(spark):
    from varloom.operators.scoring import score_kmer_pairs

    weights = kmer_weights(spark)
    return lambda windows: score_kmer_pairs(windows, weights, _MODEL, 3)


def _snps_and_chunks(spark, sf):
    dna = stored_sequences(spark, sf)
    return cut_lineage(genome_variants(spark, sf, dna)), chunks(spark, sf, dna)


@query("""
  SELECT variant_key, 'Chr' || chrom || ':' || pos || '_' || ref || alt AS id, round(overall, 6) AS overall,
         CASE WHEN overall IS NULL THEN 'window leaves its chromosome: ' || chrom || ':' || pos END AS problem
  FROM genome_variants LEFT JOIN window_effects USING (variant_key)""")
def score_and_rank_variants(spark, sf):
    snps, genome_chunks = _snps_and_chunks(spark, sf)
    scores, rejects = flows.score_variants(
        snps, genome_chunks, _kmer_scorer(spark), _MODEL, _LENGTH, size=_SIZE, overlap=_OVERLAP, on_error="split"
    )
    ranked = flows.rank_scored(snps, scores, rejects=rejects)
    return ranked.select("variant_key", "id", r6(F.col("Variant")).alias("overall"), "problem")


# Letters as 0 to 3 in the order of the bases, N as null, with the two on either side.
view("placed_letters", """
  SELECT chrom, length, p, ref, c, lag(c, 2) OVER w AS l2, lag(c) OVER w AS l1, lead(c) OVER w AS r1, lead(c, 2) OVER w AS r2
  FROM (SELECT *, CASE WHEN ref <> 'N' THEN position(ref IN 'ACGT') - 1 END AS c
        FROM (SELECT chrom, length(seq) AS length, unnest(range(1, length(seq) + 1)) AS p, unnest(string_split(seq, '')) AS ref FROM dna WHERE length(seq) > 0))
  WINDOW w AS (PARTITION BY chrom ORDER BY p)""")


def _scan_sql() -> str:
    weight = lambda index, modulus, middle, unit: f"coalesce((({index}) % {modulus} - {middle}) / {unit}.0::DOUBLE, 0)"
    words = lambda b: (f"l2 * 16 + l1 * 4 + {b}", f"l1 * 16 + {b} * 4 + r1", f"{b} * 16 + r1 * 4 + r2")
    change = lambda b, *kind: " + ".join(f"{weight(x, *kind)} - {weight(y, *kind)}" for x, y in zip(words(b), words("c")))
    squares = lambda d: f"({d}) * ({d})"
    effects = [f"sqrt({squares(change(b, 7, 3, 64))} + {squares(change(b, 11, 5, 128))}) AS e{b}" for b in range(4)]
    return f"SELECT chrom, p, ref, {', '.join(effects)} FROM placed_letters WHERE p > 10 AND p <= length - 10"


view("scanned", _scan_sql())
view("scan_matrix", "SELECT chrom, p, ref, ((e0 + e1) + e2) + e3 AS cumulative, greatest(e0, e1, e2, e3) AS max_effect FROM scanned")
_SIGNIFICANT = 0.15


def _scan(spark, sf):
    model = kmer_track.KmerModel.of(kmer_weights(spark, (64.0, 128.0)), _MODEL, 3)
    matrix, rejects = kmer_track.saturate(chunks(spark, sf), model, 21, _SIZE, _OVERLAP)
    return kmer_track.matrix_totals(matrix), rejects


@query(f"""
  SELECT 'Chr' || chrom || ':' || p AS id, ref, round(max_effect, 6) AS max_effect, round(cumulative, 6) AS cumulative FROM scan_matrix WHERE max_effect >= {_SIGNIFICANT}""")
def saturation_scan(spark, sf):
    """Positions of all texts where some base changes the score much."""
    found = scoring.significant_positions(_scan(spark, sf)[0], _SIGNIFICANT)
    return found.select(
        position_id(F.col("chrom"), F.col("pos")).alias("id"), "ref", r6(F.col("max_effect")).alias("max_effect"), r6(F.col("cumulative")).alias("cumulative")
    )


@query(f"""
  SELECT chrom, count(*) AS positions, count(cumulative) AS scored, count(*) FILTER (max_effect >= {_SIGNIFICANT}) AS significant, round(max(max_effect), 6) AS max_effect,
         CAST(coalesce(sum(CAST(round(cumulative * 1000000) AS BIGINT)), 0) AS BIGINT) AS cumulative_micro
  FROM placed_letters LEFT JOIN scan_matrix USING (chrom, p) GROUP BY chrom""")
def saturation_report(spark, sf):
    """Per text: all positions, those with a window, and what changes at them come to."""
    matrix, rejects = _scan(spark, sf)
    scored = matrix.select("chrom", "max_effect", F.round(F.col("cumulative") * 1000000).cast("long").alias("micro"))
    return scored.unionByName(rejects.select("chrom"), allowMissingColumns=True).groupBy("chrom").agg(
        F.count(F.lit(1)).alias("positions"), F.count("micro").alias("scored"), F.count_if(F.col("max_effect") >= _SIGNIFICANT).alias("significant"),
        r6(F.max("max_effect")).alias("max_effect"), F.coalesce(F.sum("micro"), F.lit(0)).alias("cumulative_micro"),
    )


# Probabilities of nine digits, so that equal scores are equal in every engine.
view("rounded_effects", f"""
  SELECT variant_key, sqrt(sum({_DIFF} * {_DIFF})) AS overall FROM (
    SELECT variant_key, feature, round(p_ref, 9) AS p_ref, round(p_alt, 9) AS p_alt FROM window_scores) GROUP BY variant_key""")
view("background_sample", """
  SELECT variant_key FROM genome_variants g JOIN (SELECT chrom, length(seq) AS length FROM dna) l USING (chrom)
  WHERE variant_key % 7 <> 0 AND pos > 20 AND pos < length - 20 AND NOT (chrom % 5 = 0 AND pos BETWEEN 50 AND 120)
  QUALIFY row_number() OVER (PARTITION BY chrom ORDER BY md5('42:' || variant_key), variant_key) <= chrom % 3 + 1""")
view("background_effects", "SELECT overall FROM rounded_effects JOIN background_sample USING (variant_key)")
view("background_tested", """
  SELECT e.variant_key, e.overall, ((SELECT count(*) FROM background_effects b WHERE b.overall > e.overall) + 1.0) / ((SELECT count(*) FROM background_effects) + 1.0) AS p FROM rounded_effects e""")


@query("""
  SELECT variant_key, round(CAST(p AS DOUBLE), 6) AS p_value, CAST(p AS DOUBLE) <= 0.2 / 40.0 AS significant, round(w / sum(w) OVER (), 9) AS prior, NULL AS problem FROM (
    SELECT *, exp((overall - max(overall) OVER ()) / (max(overall) OVER () - min(overall) OVER ()) / 0.2) AS w FROM background_tested)
  UNION ALL SELECT variant_key, NULL, NULL, NULL, 'window leaves its chromosome: ' || chrom || ':' || pos FROM genome_variants WHERE variant_key NOT IN (SELECT variant_key FROM rounded_effects)
  UNION ALL SELECT variant_key, NULL, NULL, NULL, 'background: window leaves its chromosome: ' || chrom || ':' || pos FROM genome_variants JOIN background_sample USING (variant_key)
            WHERE variant_key NOT IN (SELECT variant_key FROM rounded_effects)""")
def background_chain(spark, sf):
    snps, genome_chunks = _snps_and_chunks(spark, sf)
    lengths = cut_lineage(genome.chromosome_lengths(genome_chunks))
    sites = snps.withColumn("FILTER", F.when(F.col("variant_key") % 7 != 0, "PASS").otherwise("LOW"))
    ranges = lengths.filter("chrom % 5 = 0").select("chrom", F.lit(50).cast("long").alias("start"), F.lit(120).cast("long").alias("end"))
    quotas = lengths.select("chrom", (F.col("chrom") % 3 + 1).alias("cnt"))
    scorer = _kmer_scorer(spark)
    rounded = lambda windows: scorer(windows).withColumns({c: F.round(c, 9) for c in ("p_ref", "p_alt")})
    tested, rejects, lost = flows.background_chain(
        snps, sites, lengths, ranges, quotas, genome_chunks, rounded, _MODEL, _LENGTH, "bonf", 0.2, 40.0, buffer=20, size=_SIZE, overlap=_OVERLAP
    )
    shown = tested.select(
        "variant_key", r6(F.col("p_value")).alias("p_value"), "significant", F.round("prior", 9).alias("prior"), F.lit(None).cast("string").alias("problem")
    )
    problems = rejects.select("variant_key", "problem").unionByName(lost.select("variant_key", F.concat(F.lit("background: "), "problem").alias("problem")))
    return shown.unionByName(problems, allowMissingColumns=True)


@query("""
  SELECT variant_key, round(p, 6) AS p_value, p <= 0.2 / 40.0 AS significant, round(w / sum(w) OVER (), 9) AS prior FROM (
    SELECT *, exp((score - max(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) / 0.2) AS w FROM p_ranked)""")
def significance_and_prior(spark, sf):
    v = variants(spark, sf)
    out = flows.significance(v.filter("event_type <> 'view'").select("variant_key", "score"), v.filter("event_type = 'view'"), "bonf", 0.2, 40.0)
    return out.select("variant_key", r6(F.col("p_value")).alias("p_value"), "significant", F.round("prior", 9).alias("prior"))


@query("SELECT anchor, " + ", ".join(f"CASE WHEN anchor = '{f}' THEN 0 ELSE round(avg(distance) FILTER (feature = '{f}'), 6) END AS {f}" for f in EVENT_TYPES)
       + " FROM (SELECT * FROM closest WHERE distance >= 0) GROUP BY anchor")
def consensus_distance_matrix(spark, sf):
    m = flows.consensus_distances(intervals(spark, sf), EVENT_TYPES, "mean")
    return m.select("anchor", *[r6(F.col(f)).alias(f) for f in EVENT_TYPES])


def _document_runs(spark, sf, snps):
    """Signal on the document genome: every event is a run of its own feature and sample."""
    k = F.col("variant_key")
    return snps.join(variants(spark, sf).select("variant_key", "score", "event_type"), "variant_key").groupBy(
        F.col("event_type").alias("feature"), (k % 2).alias("sample"), "chrom", (F.floor(F.col("pos") / 100) * 100).alias("start")
    ).agg(F.max("score").alias("value")).withColumn("end", F.col("start") + 100)


view("document_runs", """
  SELECT event_type AS feature, variant_key % 2 AS sample, g.chrom, g.pos // 100 * 100 AS start, g.pos // 100 * 100 + 100 AS "end", max(score) AS value
  FROM genome_variants g JOIN (SELECT variant_key, score, event_type FROM variants) v USING (variant_key) GROUP BY ALL""")
view("document_peaks", """
  SELECT feature, sample, chrom, min(start) AS start, max("end") AS "end" FROM (
    SELECT *, sum(opens) OVER (PARTITION BY feature, sample, chrom ORDER BY start ROWS UNBOUNDED PRECEDING) AS island FROM (
      SELECT *, CASE WHEN start <= lag("end") OVER (PARTITION BY feature, sample, chrom ORDER BY start) THEN 0 ELSE 1 END AS opens FROM document_runs WHERE value >= 20))
  GROUP BY feature, sample, chrom, island""")
view("document_votes", """
  SELECT b.chrom, b.start, t.feature, t.sample, CAST(coalesce(100.0 * sum(least(b."end", p."end") - greatest(b.start, p.start)) FILTER (p.start IS NOT NULL) / any_value(b."end" - b.start), 0) >= 50 AS INTEGER) AS label
  FROM (SELECT chrom, start, "end" FROM document_bins) b CROSS JOIN (SELECT DISTINCT feature, sample FROM document_runs) t
  LEFT JOIN document_peaks p ON p.feature = t.feature AND p.sample = t.sample AND p.chrom = b.chrom AND p.start < b."end" AND p."end" > b.start GROUP BY b.chrom, b.start, t.feature, t.sample""")
view("document_bins", """
  SELECT chrom, s AS start, least(s + 200, length(seq)) AS "end" FROM dna d, LATERAL (SELECT unnest(range(0, length(d.seq), 200)) AS s) u
  WHERE 100.0 * (230 - length(replace(rpad(substr(seq, s + 1, 230), 230, 'N'), 'N', ''))) / 230 <= 50""")


@query("SELECT chrom, start, CASE chrom WHEN 6 THEN 'test' WHEN 7 THEN 'val' ELSE 'train' END AS split, "
       + ", ".join(f"max(label) FILTER (feature = '{f}') AS {f}" for f in EVENT_TYPES)
       + " FROM (SELECT chrom, start, feature, CAST(sum(label) >= 0.5 * count(*) AS INTEGER) AS label FROM document_votes GROUP BY ALL) GROUP BY chrom, start")
def labeled_training_samples(spark, sf):
    snps, genome_chunks = _snps_and_chunks(spark, sf)
    out = flows.training_samples(
        genome_chunks, _document_runs(spark, sf, snps), 200, 30, 0, 20.0, 0, 1, EVENT_TYPES, max_n_percent=50.0, size=_SIZE, overlap=_OVERLAP
    )
    return out.select("chrom", "start", "split", *EVENT_TYPES)


@query("""
  SELECT CASE WHEN grouping(feature) = 0 THEN 'feature' WHEN grouping(chrom) = 0 THEN 'chrom' ELSE 'global' END AS level, feature, chrom,
         CAST(sum(y) AS BIGINT) AS ones, count(*) AS total FROM labels_long GROUP BY GROUPING SETS ((feature), (chrom), ())""")
def prevalence_report(spark, sf):
    report = flows.prevalence_report(labeled_vectors(spark, sf), FEATURES, list(range(1, 11)))
    return report["totals"].select("level", "feature", "chrom", "ones", "total")


def _records(spark, sf):
    e = F.col("event_id")
    return table(spark, sf, "events").select(
        F.col("event_type").alias("model"), e.alias("ordinal"), (e % 20 * 50).alias("step"), (e % 20 * 0.05).alias("epoch"),
        F.when(e % 4 != 3, F.col("value")).alias("eval_loss"), *[(F.col("value") / d).alias(f"auroc_L{l}") for l, d in enumerate((600, 700, 800))],
    )


_STEPS = {"click": 100, "view": 150, "error": 200}
view("chosen_records", """
  SELECT event_type AS model, event_id % 20 * 50 AS step, value FROM events WHERE event_id % 4 <> 3
  QUALIFY row_number() OVER (PARTITION BY event_type, event_id % 20 ORDER BY event_id DESC) = 1""")


@query("""
  SELECT 'L' || l AS label, """ + ", ".join(f"round(max(value / d) FILTER (model = '{m}'), 9) AS {m}" for m in _STEPS) + """, round(avg(value / d), 9) AS mean
  FROM chosen_records, (VALUES (0, 600), (1, 700), (2, 800)) v(l, d) WHERE """ + " OR ".join(f"(model = '{m}' AND step = {s})" for m, s in _STEPS.items()) + " GROUP BY l")
def model_comparison(spark, sf):
    t = flows.model_comparison(_records(spark, sf), _STEPS, ["L0", "L1", "L2"], "auroc")
    # Quotients by 800 end at the seventh digit, so six would round ties.
    return t.select("label", *[F.round(c, 9).alias(c) for c in [*_STEPS, "mean"]])
