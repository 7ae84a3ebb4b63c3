"""Queries on effect scores, rankings, significance and priors."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions import scores as fn
from varloom.operators import scoring, stats, variants as vt
from varloom.plans.inputs import FEATURES, LEVEL, probabilities, r6, table, variants
from varloom.plans.registry import query, view


def _scores(spark, sf):
    return scoring.effect_scores(probabilities(spark, sf))


@query("""
  SELECT variant_key, round(sqrt(sum(score * score)), 6) AS variant FROM log_odds
  GROUP BY variant_key ORDER BY sqrt(sum(score * score)) DESC, variant_key LIMIT 20""")
def top_variants(spark, sf):
    p = lambda first: F.transform(F.slice("embedding", first, 12), lambda x: fn.sigmoid(x.cast("double")))
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("variant_key"), p(1).alias("p_ref"), p(13).alias("p_alt"))
    scored = scoring.row_scores(rows, name="variant").select("variant_key", "variant")
    return scoring.rank_variants(scored, "variant", top=20).select("variant_key", r6(F.col("variant")).alias("variant"))


@query("SELECT variant_key, round(sqrt(sum(score * score)), 6) AS variant FROM log_odds GROUP BY variant_key")
def overall_scores(spark, sf):
    return scoring.overall_scores(_scores(spark, sf), name="variant").withColumn("variant", r6(F.col("variant")))


@query("""
  SELECT variant_key, feature, round(p_alt - p_ref, 6) + 0.0 AS diff, round(abs(p_alt - p_ref), 6) AS abs_diff, round(score, 6) + 0.0 AS log_odds FROM log_odds""")
def effect_scores(spark, sf):
    p = probabilities(spark, sf)
    a, b = F.col("p_alt"), F.col("p_ref")
    return p.select("variant_key", "feature", r6(fn.diff(a, b)).alias("diff"), r6(fn.abs_diff(a, b)).alias("abs_diff"), r6(fn.log_odds(a, b)).alias("log_odds"))


@query("SELECT variant_key, " + ", ".join(f"round(max(score) FILTER (feature = '{f}'), 6) + 0.0 AS {f}" for f in FEATURES)
       + ", round(sqrt(sum(score * score)), 6) AS variant FROM log_odds GROUP BY variant_key")
def score_matrix(spark, sf):
    m = scoring.score_matrix(_scores(spark, sf), FEATURES, name="variant")
    return m.select("variant_key", *[r6(F.col(c)).alias(c) for c in [*FEATURES, "variant"]])


@query("SELECT variant_key, " + ", ".join(f"round(max(score) FILTER (feature = '{f}'), 6) + 0.0 AS {f}" for f in FEATURES)
       + " FROM log_odds GROUP BY variant_key ORDER BY sqrt(sum(score * score)) DESC, variant_key LIMIT 50")
def top_feature_scores(spark, sf):
    m = scoring.score_matrix(_scores(spark, sf), FEATURES, name="variant")
    return scoring.rank_variants(m, "variant", top=50).select("variant_key", *[r6(F.col(c)).alias(c) for c in FEATURES])


def _thresholds(spark, sf):
    """(feature, significance_lvl, score): the 5 % and 1 % upper points of |score| per feature, to two digits."""
    from varloom.operators.scale import exact_percentiles

    sized = _scores(spark, sf).select("feature", F.abs("score").alias("size"))
    cuts = exact_percentiles(sized, ["feature"], "size", {"p95": 0.95, "p99": 0.99})
    return cuts.select("feature", F.explode(F.array(
        F.struct(F.lit(0.05).alias("significance_lvl"), F.round("p95", 2).alias("score")),
        F.struct(F.lit(0.01).alias("significance_lvl"), F.round("p99", 2).alias("score")),
    )).alias("t")).select("feature", "t.*")


view("thresholds", """
  SELECT feature, lvl AS significance_lvl, round(quantile_cont(abs(score), 1 - lvl), 2) AS score FROM log_odds, (VALUES (0.05::DOUBLE), (0.01::DOUBLE)) l(lvl) GROUP BY feature, lvl""")


@query("""
  SELECT s.feature, s.variant_key, round(s.score, 6) + 0.0 AS score FROM log_odds s
  JOIN (SELECT feature, round(quantile_cont(abs(score), 0.95), 2) AS cut FROM log_odds GROUP BY feature) t USING (feature) WHERE abs(s.score) >= t.cut""")
def per_feature_hits(spark, sf):
    hits = scoring.per_feature_hits(_scores(spark, sf), _thresholds(spark, sf), LEVEL)
    return hits.select("feature", "variant_key", r6(F.col("score")).alias("score"))


@query("SELECT variant_key, " + ", ".join(f"abs(max(score) FILTER (feature = '{f}')) >= 0.5 AS {f}" for f in FEATURES) + " FROM log_odds GROUP BY variant_key")
def significance_mask(spark, sf):
    m = scoring.score_matrix(_scores(spark, sf), FEATURES)
    return scoring.significance_mask(m, FEATURES, 0.5, ["variant_key"])


@query("SELECT feature, round(avg(abs(score)), 6) AS mean_abs, round(max(abs(score)), 6) AS max_abs FROM log_odds GROUP BY feature")
def feature_impact(spark, sf):
    return scoring.feature_impact(_scores(spark, sf)).select("feature", r6(F.col("mean_abs")).alias("mean_abs"), r6(F.col("max_abs")).alias("max_abs"))


@query("""
  WITH top AS (SELECT * FROM variants ORDER BY score DESC, variant_key LIMIT 500)
  SELECT variant_key, chrom, pos, score FROM top WHERE (chrom, pos) IN (SELECT (chrom, pos) FROM variants WHERE event_type = 'view')""")
def top_then_positions(spark, sf):
    v = variants(spark, sf)
    allowed = v.filter("event_type = 'view'")
    return scoring.rank_variants(v, "score", top=500, positions=allowed).select("variant_key", "chrom", "pos", "score")


@query("SELECT variant_key, chrom, pos, score FROM variants WHERE score >= 100")
def above_threshold(spark, sf):
    return scoring.rank_variants(variants(spark, sf), "score", min_score=100.0).select("variant_key", "chrom", "pos", "score")


@query("SELECT variant_key, score, row_number() OVER (ORDER BY score DESC, variant_key) AS rank FROM variants")
def ranked_variants(spark, sf):
    return scoring.numbered_ranking(variants(spark, sf).select("variant_key", "score"), "score")


@query("""
  SELECT variant_key, 'Chr' || chrom || ':' || pos || '_' || ref || alt AS id, 'Chr' || chrom || ':' || pos AS position_id FROM variants""")
def variant_ids(spark, sf):
    from varloom.functions.naming import position_id, variant_id

    c, p = F.col("chrom"), F.col("pos")
    return variants(spark, sf).select("variant_key", variant_id(c, p, F.col("ref"), F.col("alt")).alias("id"), position_id(c, p).alias("position_id"))


@query("""
  SELECT a.variant_key, a.score AS left_score, b.value AS right_score FROM variants a JOIN events b ON a.variant_key = b.event_id""")
def bind_by_key(spark, sf):
    left = variants(spark, sf).select("variant_key", F.col("score").alias("left_score"))
    right = table(spark, sf, "events").select(F.col("event_id").alias("variant_key"), F.col("value").alias("right_score"))
    return scoring.bind(left, right)


@query("SELECT variant_key, feature, round(p_ref, 6) AS p_ref, round(p_alt, 6) AS p_alt FROM probabilities")
def paired_probabilities(spark, sf):
    e = table(spark, sf, "embeddings")
    wide = lambda first: e.select(F.col("vec_id").alias("variant_key"), *[fn.sigmoid(F.col("embedding")[first + i].cast("double")).alias(f) for i, f in enumerate(FEATURES)])
    paired = scoring.pair_probabilities(wide(0), wide(12), FEATURES)
    return paired.select("variant_key", "feature", r6(F.col("p_ref")).alias("p_ref"), r6(F.col("p_alt")).alias("p_alt"))


# --- saturation matrices -------------------------------------------------------------------------


def _mutations(spark, sf):
    position = F.floor(F.col("pos") / 1000)
    letter = lambda i: F.substring(F.lit("ACGT"), (i % 4 + 1).cast("int"), F.lit(1))
    return variants(spark, sf).select("chrom", position.alias("pos"), letter(position).alias("ref"), letter(F.col("variant_key")).alias("alt"), "score")


view("mutations", """
  SELECT chrom, pos // 1000 AS pos, substr('ACGT', CAST((pos // 1000) % 4 + 1 AS INTEGER), 1) AS ref,
         substr('ACGT', CAST(variant_key % 4 + 1 AS INTEGER), 1) AS alt, score FROM variants""")
view("mutagenesis", """
  SELECT 'Chr' || chrom || ':' || pos AS id, chrom, pos, ref, a AS "A", c AS "C", g AS "G", t AS "T",
         coalesce(a, 0) + coalesce(c, 0) + coalesce(g, 0) + coalesce(t, 0) AS cumulative, greatest(abs(a), abs(c), abs(g), abs(t)) AS max_effect
  FROM (SELECT chrom, pos, ref, max(score) FILTER (alt = 'A') a, max(score) FILTER (alt = 'C') c, max(score) FILTER (alt = 'G') g,
        max(score) FILTER (alt = 'T') t FROM mutations GROUP BY ALL)""")


def _matrix(spark, sf):
    return scoring.mutagenesis_matrix(_mutations(spark, sf))


@query("""SELECT id, chrom, pos, ref, "A", "C", "G", "T", round(cumulative, 6) AS cumulative, max_effect FROM mutagenesis""")
def mutagenesis_matrix(spark, sf):
    return _matrix(spark, sf).withColumn("cumulative", r6(F.col("cumulative")))


@query("SELECT id, max_effect FROM mutagenesis WHERE max_effect >= 200")
def significant_positions(spark, sf):
    return scoring.significant_positions(_matrix(spark, sf), 200.0).select("id", "max_effect")


@query("""
  SELECT chrom, pos, ref, base, score, abs(score) >= 150 AS significant FROM mutagenesis UNPIVOT INCLUDE NULLS (score FOR base IN ("A", "C", "G", "T"))""")
def mutagenesis_cells(spark, sf):
    return scoring.mutagenesis_cells(_matrix(spark, sf), 150.0).select("chrom", "pos", "ref", "base", "score", "significant")


@query("SELECT chrom, pos, max_effect, CAST(150 AS DOUBLE) AS threshold, max_effect >= 150 AS above FROM mutagenesis")
def effect_line(spark, sf):
    return scoring.effect_line(_matrix(spark, sf), 150.0)


_Z = lambda c: f'round(("{c}" - avg("{c}") OVER ()) / nullif(stddev_pop("{c}") OVER (), 0), 6) + 0.0 AS "{c}"'


@query("SELECT id, " + ", ".join(_Z(c) for c in ("A", "C", "G", "T", "cumulative")) + " FROM mutagenesis")
def z_scores(spark, sf):
    columns = ["A", "C", "G", "T", "cumulative"]
    z = stats.z_scores(_matrix(spark, sf), columns)
    return z.select("id", *[r6(F.col(c)).alias(c) for c in columns])


@query("""
  SELECT id, abs(z) > 2 AS significant FROM (SELECT id, (cumulative - avg(cumulative) OVER ()) / stddev_pop(cumulative) OVER () AS z FROM mutagenesis) WHERE abs(z) > 2""")
def z_significant_loci(spark, sf):
    scored = stats.z_scores(_matrix(spark, sf), ["A", "C", "G", "T", "cumulative"])
    return stats.z_significant(scored, 2.0)[1].select("id", (F.abs("cumulative") > 2).alias("significant"))


@query("SELECT round(avg(cumulative) + 2 * stddev_samp(cumulative), 6) AS threshold FROM mutagenesis")
def threshold_line(spark, sf):
    return stats.threshold_line(_matrix(spark, sf), "cumulative", 2.0).select(r6(F.col("threshold")).alias("threshold"))


# --- ranks and p-values --------------------------------------------------------------------------


@query("""
  SELECT p_partkey, p_retailprice, round((rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2.0) / count(*) OVER (), 5) AS pct FROM part""")
def average_tie_percent_rank(spark, sf):
    return vt.percent_rank(table(spark, sf, "part").select("p_partkey", "p_retailprice"), "p_retailprice", "pct", 5)


def _p_values(spark, sf):
    v = variants(spark, sf)
    return stats.empirical_p(v.filter("event_type <> 'view'").select("variant_key", "score"), v.filter("event_type = 'view'"))


view("background_counts", "SELECT abs(score) AS size, count(*) AS n FROM variants WHERE event_type = 'view' GROUP BY 1")
view("p_values", """
  SELECT variant_key, score, (coalesce((SELECT sum(n) FROM background_counts b WHERE b.size > abs(v.score)), 0) + 1.0) / ((SELECT sum(n) FROM background_counts) + 1.0) AS p_value
  FROM variants v WHERE event_type <> 'view'""")


@query("SELECT variant_key, score, round(CAST(p_value AS DOUBLE), 6) AS p_value FROM p_values")
def empirical_p(spark, sf):
    return _p_values(spark, sf).withColumn("p_value", r6(F.col("p_value")))


view("p_ranked", "SELECT *, CAST(p_value AS DOUBLE) AS p, row_number() OVER (ORDER BY p_value, variant_key) AS rank, count(*) OVER () AS total FROM p_values")
# A loose level, because the empirical p of a small background cannot be tiny. The number of tests is the caller's.
_Q, _M = 0.2, 40.0


@query(f"""
  SELECT variant_key, rank, round(rank / {_M} * {_Q}, 6) AS bh_threshold,
         rank <= coalesce((SELECT max(rank) FROM p_ranked WHERE p <= rank / {_M} * {_Q}), 0) AS significant FROM p_ranked""")
def bh_step_up(spark, sf):
    out = stats.bh(_p_values(spark, sf), _Q, _M)
    return out.select("variant_key", "rank", r6(F.col("bh_threshold")).alias("bh_threshold"), "significant")


_MEFF = f"{_Q} / {_M} + (rank - 1) / (total - 1)::DOUBLE * ({_Q} - {_Q} / {_M})"


@query(f"""
  SELECT variant_key, rank, round({_MEFF}, 6) AS bh_threshold,
         rank <= coalesce((SELECT max(rank) FROM p_ranked WHERE p <= {_MEFF}), 0) AS significant FROM p_ranked""")
def bh_effective_tests(spark, sf):
    out = stats.multitest(_p_values(spark, sf), "bh_meff", _Q, _M)
    return out.select("variant_key", "rank", r6(F.col("bh_threshold")).alias("bh_threshold"), "significant")


@query(f"SELECT variant_key, round(least(p * {_M}, 1), 6) AS p_bonferroni, p <= {_Q} / {_M} AS significant FROM p_ranked")
def bonferroni(spark, sf):
    out = stats.multitest(_p_values(spark, sf), "bonf", _Q, _M)
    return out.select("variant_key", r6(F.col("p_bonferroni")).alias("p_bonferroni"), "significant")


@query(f"SELECT variant_key, round(1 - pow(1 - p, {_M}), 6) AS p_sidak, p <= 1 - pow(1 - {_Q}, 1 / {_M}) AS significant FROM p_ranked")
def sidak(spark, sf):
    out = stats.multitest(_p_values(spark, sf), "sidak", _Q, _M)
    return out.select("variant_key", r6(F.col("p_sidak")).alias("p_sidak"), "significant")


@query(f"""
  WITH firsts AS (SELECT * FROM p_ranked ORDER BY p, variant_key LIMIT 3),
  cut AS (SELECT coalesce(max(rank), 0) AS k FROM p_ranked WHERE p <= {_MEFF})
  SELECT 'bh_meff' AS method, variant_key, round(p, 6) AS p_value, round({_MEFF}, 6) AS threshold, rank <= (SELECT k FROM cut) AS significant FROM firsts
  UNION ALL SELECT 'bonf', variant_key, round(p, 6), round({_Q} / {_M}, 6), p <= {_Q} / {_M} FROM firsts
  UNION ALL SELECT 'sidak', variant_key, round(p, 6), round(1 - pow(1 - {_Q}, 1 / {_M}), 6), p <= 1 - pow(1 - {_Q}, 1 / {_M}) FROM firsts""")
def compare_corrections(spark, sf):
    out = stats.compare_methods(_p_values(spark, sf), _Q, _M)
    return out.select("method", "variant_key", r6(F.col("p_value")).alias("p_value"), r6(F.col("threshold")).alias("threshold"), "significant")


# --- priors ------------------------------------------------------------------------------------


def _prior(spark, sf, strategy):
    p = stats.PRIORS[strategy](variants(spark, sf).select("variant_key", (F.col("score") / 100).alias("Variant")))
    return p.select("variant_key", F.round("prior", 9).alias("prior"))


@query("SELECT variant_key, round(score / sum(score) OVER (), 9) AS prior FROM variants")
def linear_prior(spark, sf):
    return _prior(spark, sf, "norm")


@query("SELECT variant_key, round(w / sum(w) OVER (), 9) AS prior FROM (SELECT variant_key, exp(score / 100 - max(score / 100) OVER ()) AS w FROM variants)")
def softmax_prior(spark, sf):
    return _prior(spark, sf, "softmax")


@query("""
  SELECT variant_key, round(w / sum(w) OVER (), 9) AS prior FROM (
    SELECT variant_key, exp((score - max(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) / 0.2) AS w FROM variants)""")
def minmax_softmax_prior(spark, sf):
    return _prior(spark, sf, "minmax_softmax")


# --- linkage -------------------------------------------------------------------------------------


_COMPONENTS = 64


def _ld(spark, sf):
    """Correlations of all vector components: a row per vector and component, products with all others summed map-side."""
    vectors = table(spark, sf, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    sums = vectors.select(F.posexplode("v").alias("i", "x"), "v").groupBy("i").agg(
        F.count(F.lit(1)).alias("n"), F.sum("x").alias("s"), *[F.sum(F.col("x") * F.col("v")[j]).alias(f"p{j}") for j in range(_COMPONENTS)]
    )
    of = lambda side: sums.select(F.col("i").alias(side), F.col("s").alias(f"s_{side}"), F.get(F.array(*[f"p{j}" for j in range(_COMPONENTS)]), F.col("i")).alias(f"q_{side}"))
    products = sums.select("i", "n", F.posexplode(F.array(*[f"p{j}" for j in range(_COMPONENTS)])).alias("j", "p"))
    both = products.join(of("i"), "i").join(of("j"), "j")
    spread = lambda side: F.sqrt(F.col("n") * F.col(f"q_{side}") - F.col(f"s_{side}") * F.col(f"s_{side}"))
    r = (F.col("n") * F.col("p") - F.col("s_i") * F.col("s_j")) / (spread("i") * spread("j"))
    return both.select(F.lit(0).alias("block"), "i", "j", r.alias("r"))


@query(f"""
  SELECT CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(corr(CAST(embedding[i + 1] AS DOUBLE), CAST(embedding[j + 1] AS DOUBLE)), 6) + 0.0 AS r
  FROM embeddings, range({_COMPONENTS}) a(i), range({_COMPONENTS}) b(j) GROUP BY i, j""")
def ld_matrix(spark, sf):
    return _ld(spark, sf).select("i", "j", r6(F.col("r")).alias("r"))

