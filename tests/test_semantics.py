"""Hand-computed cases for the places where a wrong reading would be easy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.functions import naming, scores as fn, sequence as sq
from varloom.operators import evaluate, genome, intervals as iv, labels, logs, sampling, scoring, stats, tokens, variants as vt
from varloom.sources import readers


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def fails(df, text):
    with pytest.raises(Exception, match=text):
        df.collect()


def test_log_odds_at_the_ends(spark):
    df = spark.createDataFrame([(0.0, 0.5), (1.0, 0.5), (0.5, 0.5), (0.0, 0.0)], "a double, r double")
    got = [r[0] for r in df.select(fn.log_odds(F.col("a"), F.col("r"))).collect()]
    assert got[:3] == [-math.inf, math.inf, 0.0] and math.isnan(got[3])
    clipped = [r[0] for r in df.select(fn.log_odds(F.col("a"), F.col("r"), eps=0.01)).collect()]
    assert clipped == pytest.approx([-math.log(99), math.log(99), 0.0, 0.0])


def test_kmers_of_short_sequences(spark):
    df = spark.createDataFrame([("ACGTA",), ("AC",), ("",), ("ACG",)], "s string")
    assert [r[0] for r in df.select(sq.kmerize(F.col("s"), 3)).collect()] == ["ACG CGT GTA", "", "", "ACG"]
    assert one(df.limit(1).select(sq.kmerize(F.col("s"), 3, 2).alias("k")))["k"] == "ACG CGT"
    assert sq.kmer_combinations(spark, 2).count() == 25


def test_substitution_and_counts_for_even_length(spark):
    chunks = genome.chunk_sequences(spark.createDataFrame([(1, "ACGTACGTAC")], "chrom int, seq string"), 4, 6)
    row = one(genome.extract_windows(spark.createDataFrame([(1, 6, "T")], "chrom int, pos long, alt string"), chunks, 4, 4, 6))
    # Zero-based position 5, centre index 2: bases 3..6.
    assert (row["start"], row["end"], row["ref_seq"], row["alt_seq"]) == (3, 7, "TACG", "TATG")
    assert (row["ref_base"], row["alt_base"], row["left_cnt"], row["right_cnt"]) == ("C", "T", 2, 1)


def test_window_errors(spark):
    chunks = genome.chunk_sequences(spark.createDataFrame([(1, "ACGTACGTAC")], "chrom int, seq string"), 4, 6)
    make = lambda *row: spark.createDataFrame([row], "chrom int, pos long, alt string")
    for row, text in (((1, 1, "A"), "leaves its chromosome"), ((1, 10, "A"), "leaves its"), ((2, 5, "A"), "leaves its"), ((1, 5, "AT"), "not one base")):
        fails(genome.extract_windows(make(*row), chunks, 4, 4, 6), text)
        good, bad = genome.extract_windows(make(*row), chunks, 4, 4, 6, on_error="split")
        assert good.count() == 0 and bad.count() == 1
    # Longer than the overlap, so read over three chunks.
    assert one(genome.extract_windows(make(1, 5, "T"), chunks, 9, 4, 6))["alt_seq"] == "ACGTTCGTA"


def test_bins_are_padded_and_extensions_touch_the_bin(spark):
    chunks = genome.chunk_sequences(spark.createDataFrame([(1, "AACCGGTTAC")], "chrom int, seq string"), 4, 12)
    rows = genome.bin_genome(chunks, 4, forward=2, backward=3, size=4, overlap=12).orderBy("start").collect()
    assert [(r["bin_id"], r["start"], r["end"], r["seq"]) for r in rows] == [
        (1, 0, 4, "NNNAACCGG"), (2, 4, 8, "ACCGGTTAC"), (3, 8, 10, "GTTACNNNN"),
    ]
    moved = genome.bin_genome(chunks, 4, forward=2, backward=3, size=4, overlap=12, update_end=True, update_start=True)
    assert sorted((r["start"], r["end"]) for r in moved.collect()) == [(0, 6), (1, 10), (5, 10)]


def test_saturation_of_a_hundred_bases(spark):
    chunks = genome.chunk_sequences(spark.createDataFrame([(6, "ACGTN" * 100)], "chrom int, seq string"), 64, 32)
    rows = genome.saturate(chunks, 6, 101, 200, 64)
    assert rows.count() == 400 and rows.select("pos").distinct().count() == 100
    assert rows.filter("pos = 101").select("ref").distinct().collect()[0][0] == "A"


def test_complement_and_n_percent(spark):
    df = spark.createDataFrame([("ACGTN",), ("",), ("nnAA",)], "s string")
    assert [r[0] for r in df.select(sq.complement(F.col("s"))).limit(1).collect()] == ["TGCAN"]
    assert [r[0] for r in df.select(sq.n_percent(F.col("s"))).collect()] == [20.0, 0.0, 50.0]
    kept = genome.filter_ambiguous(df.withColumnRenamed("s", "seq"), 20.0)
    assert sorted(r[0] for r in kept.collect()) == ["", "ACGTN"]


def test_book_ended_intervals_merge(spark):
    df = spark.createDataFrame([(1, 0, 5), (1, 5, 8), (1, 9, 10), (2, 5, 6)], "chrom int, start long, end long")
    assert sorted(map(tuple, iv.merge_intervals(df).collect())) == [(1, 0, 8, 2), (1, 9, 10, 1), (2, 5, 6, 1)]


def test_consensus_needs_half_of_the_samples(spark):
    rows = [("f", 1, 0, 10, "a"), ("f", 1, 5, 15, "b"), ("f", 1, 8, 9, "c"), ("g", 1, 3, 4, "a")]
    got = iv.consensus(spark.createDataFrame(rows, "feature string, chrom int, start long, end long, sample string"))
    assert sorted(map(tuple, got.select("feature", "chrom", "start", "end").collect())) == [("f", 1, 5, 10), ("g", 1, 3, 4)]
    middle = iv.centres(got.filter("feature = 'f'")).collect()[0]
    assert (middle["start"], middle["end"]) == (7, 8)


def test_gene_ends_count_as_inside(spark):
    genes = spark.createDataFrame([(1, 10, 20)], "chrom int, start long, end long")
    snps = spark.createDataFrame([(1, p) for p in (9, 10, 20, 21)], "chrom int, pos long")
    assert sorted(r["pos"] for r in vt.outside_genes(snps, genes).collect()) == [9, 21]


def test_peaks_join_gaps_and_drop_short_ones(spark):
    runs = spark.createDataFrame([(1, 0, 10, 5.0), (1, 10, 14, 1.0), (1, 14, 20, 7.0), (1, 30, 33, 9.0)], "chrom int, start long, end long, value double")
    assert sorted(map(tuple, iv.call_peaks(runs, 5.0, 4, 5).collect())) == [(1, 0, 20)]
    assert sorted(map(tuple, iv.call_peaks(runs, 5.0, 3, 1).collect())) == [(1, 0, 10), (1, 14, 20), (1, 30, 33)]
    with pytest.raises(ValueError):
        iv.call_broad_peaks(runs, 1.0, 5.0, 4, 4, 1)


def test_percent_rank_averages_ties(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([1.0, 2.0, 2.0, 4.0, None])], "k int, v double")
    got = {r["k"]: r["p"] for r in vt.percent_rank(df, "v", "p").collect()}
    assert got == {0: 0.25, 1: 0.625, 2: 0.625, 3: 1.0, 4: None}


def test_max_allele_frequency_for_three_alleles(spark):
    df = spark.createDataFrame([([0.5, 0.3, 0.2],), ([0.9, 0.1],)], "f array<double>")
    assert [r[0] for r in df.select(naming.max_minor_frequency(F.col("f"))).collect()] == [0.5, 0.1]


def test_info_frequency_is_anchored(spark):
    df = spark.createDataFrame([("MAF=0.3;AF=0.8,0.1",), ("AF:0.25",), ("DP=1",), ("MAF=0.4",)], "i string")
    assert [r[0] for r in df.select(naming.info_allele_frequency(F.col("i"))).collect()] == [0.8, 0.25, None, None]


def test_unknown_accession_is_an_error(spark):
    fails(spark.createDataFrame([("X",)], "a string").select(naming.accession_to_number(F.col("a"))), "unknown accession")


def test_allele_filters(spark):
    df = spark.createDataFrame([("A", "T"), ("A", "T,C"), ("AT", "G"), ("A", "*"), ("A", "TT")], "r string, a string")
    got = df.select(vt.is_biallelic_snp(F.col("r"), F.col("a")), vt.is_single_alternate(F.col("a"))).collect()
    assert list(map(tuple, got)) == [(True, True), (False, False), (False, True), (True, False), (False, True)]


def test_vcf_with_two_alternates(spark):
    lines = spark.createDataFrame([("##x",), ("#CHROM\tPOS",), ("AP014957.1\t5\t.\tA\tT",), ("AP014958.1\t6\t.\tA\tT,G",)], "value string")
    fails(readers.parse_vcf(lines), "more than one alternate")
    good, bad = readers.parse_vcf(lines, on_error="split")
    assert tuple(one(readers.vcf_to_snp_list(good))) == (1, 5, "Chr1:5_AT", "A", "T") and bad.count() == 1


def test_empirical_p_counts_strictly_larger(spark):
    scores = spark.createDataFrame([(1, 2.0), (2, -5.0), (3, 0.0)], "variant_key long, score double")
    background = spark.createDataFrame([(1.0,), (-2.0,), (3.0,)], "score double")
    got = {r["variant_key"]: r["p_value"] for r in stats.empirical_p(scores, background).collect()}
    assert got == {1: 0.5, 2: 0.25, 3: 1.0}


def test_step_up_and_single_test(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.03, 0.029, 0.9])], "variant_key long, p_value double")
    got = {r["variant_key"]: r["significant"] for r in stats.bh(df, 0.05, 4).collect()}
    assert got == {0: True, 1: True, 2: True, 3: False}
    single = one(stats.bh_meff(df.limit(1), 0.05, 10))
    assert single["bh_threshold"] == pytest.approx(0.005) and single["rank"] == 1
    with pytest.raises(ValueError):
        stats.multitest(df, "other", 0.05, 4)
    assert stats.run_metadata(4, 3, 0.06, "bonf")["adjusted_q"] == "0.02" and "adjusted_q" not in stats.run_metadata(4, 3, 0.06, "bh")


def test_priors_sum_to_one_and_fall_back(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 3.0)], "k int, Variant double")
    assert [r["prior"] for r in stats.linear_prior(df).orderBy("k").collect()] == [0.25, 0.75]
    for make in stats.PRIORS.values():
        assert sum(r["prior"] for r in make(df).collect()) == pytest.approx(1.0)
    flat = spark.createDataFrame([(1, 0.0), (2, 0.0)], "k int, Variant double")
    for make in stats.PRIORS.values():
        assert [r["prior"] for r in make(flat).collect()] == [0.5, 0.5]


def test_ld_matrix_must_fit_the_scores(spark):
    def ld(matrix, block=0):
        return [(block, i, j, float(v)) for i, row in enumerate(matrix) for j, v in enumerate(row)]

    schema = "block int, i int, j int, r double"
    scores = spark.range(4)
    fails(stats.check_ld_size(spark.createDataFrame(ld(np.eye(3)), schema), scores), "LD matrix has 3")
    assert one(stats.check_ld_size(spark.createDataFrame(ld(np.eye(4)), schema), scores))["n_ld"] == 4


def test_constant_column_has_no_z_score(spark):
    df = spark.createDataFrame([(1, 2.0, 1.0), (2, 2.0, 3.0)], "k int, a double, b double")
    rows = stats.z_scores(df, ["a", "b"]).orderBy("k").collect()
    assert [tuple(r) for r in rows] == [(1, None, -1.0), (2, None, 1.0)]


def test_thresholds_must_be_unique(spark):
    t = spark.createDataFrame([("a", 0.05, 1.0), ("a", 0.05, 2.0), ("b", 0.05, 1.5)], "feature string, significance_lvl double, score double")
    scores = spark.createDataFrame([("a", 1, 3.0), ("b", 1, -1.6)], "feature string, variant_key long, score double")
    with pytest.raises(Exception, match="not unique"):
        scoring.per_feature_hits(scores, t, 0.05).collect()
    assert scoring.per_feature_hits(scores, t.filter("score <> 2"), 0.05).count() == 2
    assert scoring.threshold_of(t, 0.05, "b") == 1.5
    for level, feature in ((0.05, "a"), (0.01, "b")):
        with pytest.raises(ValueError):
            scoring.threshold_of(t, level, feature)


def test_top_cut_comes_before_positions(spark):
    df = spark.createDataFrame([(i, 1, i, float(i)) for i in range(10)], "variant_key long, chrom int, pos long, s double")
    allowed = spark.createDataFrame([(1, 9), (1, 1)], "chrom int, pos long")
    assert [r["pos"] for r in scoring.rank_variants(df, "s", top=3, positions=allowed).collect()] == [9]
    assert [r["pos"] for r in scoring.rank_variants(df, "s", min_score=7.0).collect()] == [9, 8, 7]
    with pytest.raises(ValueError):
        scoring.rank_variants(df, "s", top=3, min_score=1.0)


def test_missing_partner_is_an_error(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b")], "variant_key long, x string")
    fails(scoring.bind(left, left.limit(1).withColumnRenamed("x", "y")), "no partner")


def test_majority_tie_is_positive(spark):
    rows = [(1, 0, 5, s, y) for s, y in (("a", 1), ("b", 0))] + [(1, 5, 9, "a", 0), (1, 5, 9, "b", 0)]
    keys = ["chrom", "start", "end"]
    got = labels.majority_labels(spark.createDataFrame(rows, "chrom int, start long, end long, sample string, label int"), keys=keys)
    assert sorted(map(tuple, got.collect())) == [(1, 0, 5, 1), (1, 5, 9, 0)]


def test_features_with_different_numbers_of_samples(spark):
    bins = spark.createDataFrame([(1, s, s + 100) for s in range(0, 500, 100)], "chrom int, start long, end long")
    rows = [("A", 0, 0, 160), ("A", 1, 0, 149), ("B", 0, 0, 500), ("B", 1, 300, 400), ("B", 2, 310, 360), ("B", 2, 340, 350), ("C", 0, 480, 480)]
    peaks = spark.createDataFrame([(f, s, 1, a, b) for f, s, a, b in rows], "feature string, sample int, chrom int, start long, end long")
    for cell in (7, 100, 10_000):
        positives = labels.positive_bins(bins, peaks, cell=cell)
        found = {tuple(r) for r in positives.select("feature", "sample", "start").collect()}
        assert found == {("A", 0, 0), ("A", 1, 0), ("A", 0, 100), ("B", 1, 300), ("B", 2, 300), *(("B", 0, s) for s in range(0, 500, 100))}
    of = labels.replicates(peaks.select("feature", "sample"))
    assert of == {"A": 2, "B": 3, "C": 1}
    wide = labels.add_majority(bins, positives, of, ["A", "B", "C"])
    assert {r["start"]: (r["A"], r["B"], r["C"]) for r in wide.collect()} == {
        0: (1, 0, 0), 100: (1, 0, 0), 200: (0, 0, 0), 300: (0, 1, 0), 400: (0, 0, 0)
    }
    long = labels.long_labels(wide, ["A", "B", "C"])
    tracks = labels.track_prevalence(bins, positives, peaks)
    assert {(r["feature"], r["sample"]): (r["positive"], r["total"]) for r in tracks.collect()}["C", 0] == (0, 5)
    stats_ = {r["sample"]: (r["positive"], r["total"]) for r in labels.label_stats(tracks, long).collect()}
    assert stats_ == {"0": (7, 15), "1": (2, 10), "2": (1, 5), "majority": (3, 15)}
    with pytest.raises(ValueError):
        labels.add_majority(bins, positives, of, ["D"])


def test_labels_must_match_samples(spark):
    samples = spark.createDataFrame([(1, 0, 5, "A"), (1, 5, 9, "C")], "chrom int, start long, end long, seq string")
    marks = spark.createDataFrame([(1, 0, 5, "f", 1), (1, 5, 9, "f", 0)], "chrom int, start long, end long, feature string, label int")
    merged = labels.merge_labels(samples, marks, ["f"])
    assert sorted(map(tuple, merged.select("start", "seq", "f").collect())) == [(0, "A", 1), (5, "C", 0)]
    assert one(labels.label_array(merged.limit(1), ["f"]))["labels"] in ([0], [1])
    fails(labels.merge_labels(samples, marks.limit(1), ["f"]), "do not match")


def test_split_sizes(spark):
    df = spark.range(100).select(F.col("id"), F.lit(1).alias("chrom"), (F.col("id") % 2).cast("int").alias("f"))
    sizes = lambda d: {r["split"]: r["count"] for r in d.groupBy("split").count().collect()}
    # Validation is a share of the remainder here, of everything in the stratified split.
    assert sizes(sampling.random_split(df, ["id"])) == {"test": 20, "val": 16, "train": 64}
    assert sizes(sampling.stratified_split(df, ["f"], ["id"])) == {"test": 20, "val": 20, "train": 60}
    assert sizes(sampling.stratified_split(df.withColumn("f", F.col("id").cast("int")), ["f"], ["id"], min_stratum=2)) == {"test": 20, "val": 20, "train": 60}
    assert sizes(sampling.train_val_split(df, ["id"])) == {"val": 20, "train": 80}


def test_quotas_and_subsample_are_exact(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 700, 1).when(F.col("id") < 990, 2).otherwise(3).alias("chrom"), (F.col("id") % 3 == 0).cast("int").alias("f"))
    wanted = sampling.quotas(df, 107)
    assert {r["chrom"]: r["quota"] for r in wanted.collect()} == {1: 75, 2: 31, 3: 1}
    picked = sampling.stratified_subsample(df, wanted, ["f"], ["id"])
    assert one(sampling.check_sample_size(picked, 107))["rows"] == 107
    report = {r["feature"]: r["delta"] for r in labels.label_vector_report(df, picked, ["f"]).collect()}
    assert abs(report["f"]) < 0.02
    everything = sampling.stratified_subsample(df, wanted.withColumn("quota", F.lit(10_000)), ["f"], ["id"])
    assert everything.count() == 1000
    fails(sampling.check_sample_size(picked, 100), "expected 100")
    fails(vt.sample_exact(df, 1001, 1, ["id"]), "asked for 1001")
    assert sorted(r["id"] for r in sampling.shuffled(df, ["id"]).collect()) == list(range(1000))


def test_degenerate_label_and_zero_division(spark):
    rows = [("a", 0.9, 1), ("a", 0.8, 1), ("b", 0.1, 1), ("b", 0.2, 0)]
    got = {r["label"]: r for r in evaluate.threshold_metrics(spark.createDataFrame(rows, "label string, p double, y int")).collect()}
    assert got["a"]["accuracy"] is None and got["a"]["pos_cnt"] == 2
    assert (got["b"]["precision"], got["b"]["recall"], got["b"]["f1"], got["b"]["mcc"]) == (0.0, 0.0, 0.0, 0.0)
    assert one(evaluate.summary_metrics(spark.createDataFrame([(*r, 0.0) for r in rows], "label string, p double, y int, logit double")))["auroc_macro"] is None


def test_curves_by_hand(spark):
    rows = [("x", 0.9, 1), ("x", 0.8, 1), ("x", 0.7, 0), ("x", 0.6, 1), ("x", 0.5, 0), ("x", 0.4, 0)]
    df = spark.createDataFrame(rows, "label string, p double, y int")
    roc = sorted((round(r["fpr"], 3), round(r["tpr"], 3)) for r in evaluate.roc_curve(df).collect())
    # (0, 0), the first score, and the bends; points inside a straight run are gone.
    assert roc == [(0, 0), (0, 0.333), (0, 0.667), (0.333, 0.667), (0.333, 1), (1, 1)]
    area = one(evaluate.curve_areas(df))
    assert area["auroc"] == pytest.approx(8 / 9)
    assert area["average_precision"] == pytest.approx((1 + 1 + 3 / 4) / 3)
    pr = evaluate.pr_curve(df)
    assert pr.count() == 7 and pr.filter("threshold is null and precision = 1 and recall = 0").count() == 1


def test_thinning_keeps_both_ends(spark):
    points = spark.range(5001).select(F.lit("a").alias("label"), F.col("id").cast("double").alias("x"))
    kept = sorted(r["x"] for r in evaluate.thin_curve(points, "x", 2000).collect())
    expected = {5000 - j * 5000 // 1999 for j in range(2000)}
    assert set(kept) == expected and len(kept) == 2000
    assert evaluate.thin_curve(points.limit(100), "x", 2000).count() == 100


def test_first_and_last_record_per_step(spark):
    df = spark.createDataFrame([(0, 1, 0.5), (1, 2, 0.4), (2, 1, 0.3)], "ordinal long, step long, loss double")
    assert sorted((r["step"], r["loss"]) for r in logs.one_per_step(df, "ordinal").collect()) == [(1, 0.3), (2, 0.4)]
    assert sorted((r["step"], r["loss"]) for r in logs.one_per_step(df, "ordinal", "first").collect()) == [(1, 0.5), (2, 0.4)]


def test_token_encoding(spark):
    vocabulary = spark.createDataFrame([("ACG", 5), ("CGT", 6)], "token string, id int")
    df = spark.createDataFrame([(1, "ACG CGT XXX ACG"), (2, ""), (3, "CGT")], "k long, seq string")
    got = {r["k"]: (r["input_ids"], r["attention_mask"]) for r in tokens.encode(df, vocabulary, "k", max_length=5, start_id=2, end_id=3).collect()}
    assert got == {1: ([2, 5, 6, 1, 3], [1] * 5), 2: ([2, 3, 0, 0, 0], [1, 1, 0, 0, 0]), 3: ([2, 6, 3, 0, 0], [1, 1, 1, 0, 0])}


def test_mask_shares(spark):
    ids = spark.range(200).select(F.col("id").alias("k"), F.transform(F.sequence(F.lit(1), F.lit(500)), lambda i: (i % 50).cast("int")).alias("input_ids"))
    out = tokens.mask_tokens(ids, "k", mask_id=49, vocab_size=50, special_ids=[0, 49])
    cells = ids.join(out, "k").select(F.explode(F.arrays_zip("input_ids", "masked_ids", "labels")).alias("c")).select("c.*").toPandas()
    special = cells["input_ids"].isin([0, 49])
    assert (cells.loc[special, "labels"] == -100).all()
    labeled = cells[cells["labels"] != -100]
    assert (labeled["labels"] == labeled["input_ids"]).all()
    assert len(labeled) / (~special).sum() == pytest.approx(0.15 * 0.9, abs=0.01)
    assert (labeled["masked_ids"] == 49).mean() == pytest.approx(8 / 9, abs=0.02)


def test_user_model_keeps_rows_and_order_of_features(spark):
    df = spark.createDataFrame([(i, "A" * (i + 1)) for i in range(50)], "variant_key long, seq string")
    scored = scoring.score_sequences(df, lambda batch: np.array([[len(s), -len(s)] for s in batch]), ["up", "down"], batch=7)
    for r in scored.collect():
        assert (r["up"], r["down"]) == pytest.approx((1 / (1 + math.exp(-r["variant_key"] - 1)), 1 / (1 + math.exp(r["variant_key"] + 1))))


@pytest.mark.parametrize("n_bins, sigma", [(12, 1.0), (3, 5.0), (1, 2.0)])
def test_filters_of_any_width_mirror_the_track(spark, n_bins, sigma):
    import math

    from varloom.operators import tracks

    values = [float((7 * i + 3) % 5) for i in range(n_bins)]
    radius = int(4 * sigma + 0.5)
    weights = {d: math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)}
    at = lambda i: values[i % (2 * n_bins)] if i % (2 * n_bins) < n_bins else values[2 * n_bins - 1 - i % (2 * n_bins)]
    expected = [sum(w * at(i + d) for d, w in weights.items()) / sum(weights.values()) for i in range(n_bins)]
    track = spark.createDataFrame([(1, i, v) for i, v in enumerate(values)], "chrom int, bin long, signal double")
    got = {r["bin"]: r["smoothed"] for r in tracks.gaussian_smooth(track, n_bins, sigma).collect()}
    assert [got[i] for i in range(n_bins)] == pytest.approx(expected)
