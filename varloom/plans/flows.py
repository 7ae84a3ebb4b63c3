"""Composed flows: each is one chain of the library's operators over DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from varloom.functions.naming import annotation_pos, variant_id
from varloom.operators import genome, intervals as iv, labels, logs, sampling, scoring, stats, variants as vt
from varloom.operators.scale import POSITION_BUCKET
from varloom.session import cut_lineage

# Windows (variant_key, ref_seq, alt_seq) -> long (variant_key, feature, p_ref, p_alt).
Scorer = Callable[[DataFrame], DataFrame]


def score_variants(
    snps: DataFrame, chunks: DataFrame, scorer: Scorer, features: Sequence[str], length: int = 1000, method: str = "log_odds",
    size: int = genome.CHUNK, overlap: int = genome.OVERLAP, on_error: str = "raise",
) -> DataFrame | tuple[DataFrame, DataFrame]:
    """SNP list -> windows -> probabilities -> wide scores with the overall score, by variant key.

    A variant without a window is an error; with ``on_error="split"`` such variants come back as a second frame with their
    problem.
    """
    cut = genome.extract_windows(snps, chunks, length, size, overlap, on_error=on_error)
    windows = cut if on_error == "raise" else cut[0]
    probabilities = scorer(windows.select("variant_key", "ref_seq", "alt_seq"))
    scores = scoring.score_matrix(scoring.effect_scores(probabilities, method), features)
    return scores if on_error == "raise" else (scores, cut[1])


def rank_scored(
    snps: DataFrame, scores: DataFrame, metric: str = "Variant", top: int | None = None, rejects: DataFrame | None = None
) -> DataFrame:
    """SNPs with their scores by falling metric; with ``rejects`` those too, last, without a score but with their problem."""
    named = snps.withColumn("id", variant_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt")))
    if rejects is None:
        return scoring.rank_variants(named.join(scores, "variant_key"), metric, top)
    joined = named.join(scores, "variant_key", "left").join(rejects.select("variant_key", "problem"), "variant_key", "left")
    return scoring.rank_variants(joined, metric, top)


def saturation_scan(
    chunks: DataFrame, regions: DataFrame, scorer: Scorer, features: Sequence[str], length: int, threshold: float,
    size: int = genome.CHUNK, overlap: int = genome.OVERLAP,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(matrix of base x position effects, positions whose largest effect reaches the threshold, mutations without a window)."""
    mutations = genome.saturate_regions(chunks, regions, size).withColumn(
        "variant_key", variant_id(F.col("chrom"), F.col("pos"), F.col("ref"), F.col("alt"))
    )
    scores, rejects = score_variants(mutations, chunks, scorer, features, length, size=size, overlap=overlap, on_error="split")
    matrix = scoring.mutagenesis_matrix(mutations.join(scores, "variant_key"), "Variant")
    return matrix, scoring.significant_positions(matrix, threshold), rejects


def training_samples(
    chunks: DataFrame, runs: DataFrame, bin_size: int, forward: int, backward: int, cutoff: float, max_gap: int, min_length: int,
    features: Sequence[str], max_n_percent: float = 100.0, coverage_threshold: float = 50.0, majority: float = 0.5,
    size: int = genome.CHUNK, overlap: int = genome.OVERLAP, width: int = POSITION_BUCKET,
) -> DataFrame:
    """Signal runs (feature, sample, chrom, start, end, value) and a genome -> labeled, split sequence samples."""
    track = ["feature", "sample"]
    peaks = iv.call_peaks(runs, cutoff, max_gap, min_length, [*track, "chrom"], width)
    samples = genome.filter_ambiguous(
        genome.bin_genome(chunks, bin_size, forward=forward, backward=backward, size=size, overlap=overlap), max_n_percent
    ).select("chrom", "start", "end", "seq")
    positives = labels.positive_bins(samples, peaks, track, coverage_threshold, bin_size, width)
    merged = labels.add_majority(samples, positives, labels.replicates(runs.select(*track)), features, majority)
    return sampling.chromosome_split(merged)


def significance(
    scores: DataFrame, background: DataFrame, method: str, q: float, m: float, strategy: str = "minmax_softmax", score: str = "score",
) -> DataFrame:
    """Scores -> empirical p against the background -> correction -> prior."""
    tested = stats.multitest(stats.empirical_p(scores, background, score), method, q, m)
    return stats.PRIORS[strategy](tested, score)


def background_scores(
    sites: DataFrame, lengths: DataFrame, genes: DataFrame, quotas: DataFrame, chunks: DataFrame, scorer: Scorer, features: Sequence[str],
    length: int, buffer: int = 1000, seed: int = 42, size: int = genome.CHUNK, overlap: int = genome.OVERLAP,
) -> tuple[DataFrame, DataFrame]:
    """(overall scores of sampled background sites, sampled sites without a window)."""
    sampled = vt.genomewide_sample(sites, lengths, genes, quotas, buffer, seed)
    return score_variants(sampled, chunks, scorer, features, length, size=size, overlap=overlap, on_error="split")


def background_chain(
    snps: DataFrame, sites: DataFrame, lengths: DataFrame, genes: DataFrame, quotas: DataFrame, chunks: DataFrame, scorer: Scorer,
    features: Sequence[str], length: int, method: str, q: float, m: float, strategy: str = "minmax_softmax", buffer: int = 1000,
    seed: int = 42, size: int = genome.CHUNK, overlap: int = genome.OVERLAP,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Background sample -> scores -> empirical p of the SNPs -> correction -> prior; the SNPs and the sampled sites without a window."""
    background, lost = background_scores(sites, lengths, genes, quotas, chunks, scorer, features, length, buffer, seed, size, overlap)
    scores, rejects = score_variants(snps, chunks, scorer, features, length, size=size, overlap=overlap, on_error="split")
    scores = cut_lineage(scores.select("variant_key", "Variant"))
    return significance(scores, cut_lineage(background.select("Variant")), method, q, m, strategy, "Variant"), rejects, lost


def consensus_distances(peaks: DataFrame, features: Sequence[str], statistic: str = "median", width: int = POSITION_BUCKET) -> DataFrame:
    """Replicate peaks -> consensus -> centres -> nearest distances -> anchor x feature matrix."""
    centres = iv.centres(iv.consensus(peaks, width=width))
    summary = iv.distribution_summary(cut_lineage(iv.nearest_feature(centres, features, width=width)), ["anchor", "feature"], "distance")
    return iv.statistic_matrix(summary, features, statistic)


def positives_and_negatives(
    annotations: DataFrame, maf: DataFrame, sites: DataFrame, genes: DataFrame, n_positive: int, max_dist: int,
    tolerance: float = 0.05, per_positive: int = 1, min_maf: float = 0.1, seed: int = 42,
) -> tuple[DataFrame, DataFrame]:
    """Functional SNPs sampled as positives, and negatives matched by distance and frequency percentile.

    Every annotated site is barred from the negatives, sampled or not. ``sites`` has variant_key, chrom, pos,
    ref, alt, INFO.
    """
    positives = cut_lineage(vt.sample_exact(vt.functional_snps(annotations, maf, min_maf), n_positive, seed, ["id"]))
    known = annotations.select(F.substring("var", 3, 2).cast("int").alias("chrom"), annotation_pos(F.col("var")).alias("pos"))
    # Ranked among all sites that may be negatives, before those in genes are left out.
    free = cut_lineage(vt.info_maf(vt.candidate_sites(sites, known)))
    ranked = vt.percent_rank(free, "MAF", "MAF_PCT", 5).filter(F.col("MAF_PCT").isNotNull())
    candidates = vt.outside_genes(ranked, genes)
    return positives, vt.matched_negatives(positives, cut_lineage(candidates), max_dist, tolerance, per_positive, seed)


def prevalence_report(samples: DataFrame, features: Sequence[str], chromosomes: Sequence) -> dict[str, DataFrame]:
    """Per-chromosome prevalence, its matrix and its totals."""
    per_chrom = labels.column_prevalence(samples, features, ["chrom"])
    return {
        "per_chromosome": per_chrom, "matrix": labels.prevalence_matrix(per_chrom, chromosomes), "totals": labels.prevalence_totals(per_chrom),
    }


def model_comparison(records: DataFrame, step_of: dict[str, int], labels_: Sequence[str], metric: str) -> DataFrame:
    """Evaluation logs of several models -> last record per step -> chosen step -> label x model table."""
    latest = logs.one_per_step(logs.eval_records(records), "ordinal", "last", ["model", "step"])
    chosen = F.lit(False)
    for model, step in step_of.items():
        chosen |= (F.col("model") == model) & (F.col("step") == step)
    best = logs.prefixed(latest.filter(chosen), keep=("step", "epoch", "model", "ordinal"))
    return logs.transpose_models(logs.metric_labels(best, metric, labels_), labels_, list(step_of))
