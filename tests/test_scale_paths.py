"""The split-and-stitch paths must give what one plain window gives; tiny block sizes force them."""

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import Window as W, functions as F

from varloom.operators import evaluate, genome, intervals as iv, sampling, stats, tracks, variants as vt
from varloom.operators.scale import (
    enclosing_blocks, exact_percentiles, global_row_number, hash_rank, neighbour, running_totals, skew_join,
    top_n_per_group, with_aligned_blocks,
)


def as_set(df, *columns):
    rows = df.select(*columns).collect()
    assert len(rows) == len(set(map(tuple, rows)))
    return set(map(tuple, rows))


@pytest.fixture(scope="module")
def skewed(spark):
    """900 rows; a third share one score, most share one group, and some know neither group nor score."""
    rng = random.Random(1)
    rows = [(i, "hot" if rng.random() < 0.7 else f"g{rng.randrange(5)}", 0.5 if rng.random() < 0.34 else round(rng.random(), 3)) for i in range(900)]
    rows = [(i, None if i % 23 == 0 else g, None if i % 19 == 0 else s) for i, g, s in rows]
    return spark.createDataFrame(rows, "variant_key long, grp string, score double").repartition(7).cache()


@pytest.mark.parametrize("descending", [False, True])
def test_running_totals(skewed, descending):
    counts = skewed.groupBy("grp", "score").agg(F.count(F.lit(1)).alias("n"))
    sort = F.col("score").desc() if descending else F.col("score").asc()
    plain = counts.withColumn("cum_n", F.sum("n").over(W.partitionBy("grp").orderBy(sort).rowsBetween(W.unboundedPreceding, 0)))
    split = running_totals(counts, ["score"], {"n": F.col("n")}, ["grp"], descending, rows_per_block=20)
    assert as_set(split, "grp", "score", "cum_n") == as_set(plain, "grp", "score", "cum_n")


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("following", [False, True])
def test_neighbour(skewed, descending, following):
    points = skewed.groupBy("grp", "score").agg(F.count(F.lit(1)).alias("n"))
    sort = F.col("score").desc() if descending else F.col("score").asc()
    shift = F.lead if following else F.lag
    plain = points.withColumn("x", shift("n").over(W.partitionBy("grp").orderBy(sort)))
    split = neighbour(points, "score", ["n"], "s", ["grp"], descending, following, rows_per_block=15).withColumn("x", F.col("s.n"))
    assert as_set(split, "grp", "score", "x") == as_set(plain, "grp", "score", "x")


@pytest.mark.parametrize("descending", [False, True])
def test_global_row_number_with_hot_value(skewed, descending):
    sort = F.col("score").desc() if descending else F.col("score").asc()
    plain = skewed.withColumn("rank", F.row_number().over(W.orderBy(sort, "variant_key")))
    split = global_row_number(skewed, "score", "variant_key", descending=descending, rows_per_block=50)
    assert as_set(split, "variant_key", "rank") == as_set(plain, "variant_key", "rank")


def test_exact_percentiles(skewed):
    probabilities = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.99, "e": 1.0}
    plain = skewed.groupBy("grp").agg(F.percentile("score", F.array(*[F.lit(p) for p in probabilities.values()])).alias("p"))
    expected = {r["grp"]: r["p"] for r in plain.collect()}
    for row in exact_percentiles(skewed, ["grp"], "score", probabilities, rows_per_block=30).collect():
        assert [row[n] for n in probabilities] == pytest.approx(expected[row["grp"]])


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_skew_join(spark, skewed, how):
    right = spark.createDataFrame([("hot", 1), ("g1", 2), ("g2", 3)], "grp string, v int")
    plain, split = skewed.join(right, ["grp"], how), skew_join(
        skewed, right, ["grp"], how, hot_rows=100, counted=skewed.groupBy("grp").agg(F.count(F.lit(1)).alias("_rows"))
    )
    assert "_slot" in split._jdf.queryExecution().toString()
    assert as_set(split, *plain.columns) == as_set(plain, *plain.columns)


def test_equal_rows_spread_over_slots(spark):
    equal = spark.range(4000, numPartitions=8).select(F.lit("hot").alias("grp"))
    right = spark.createDataFrame([("hot", 1)], "grp string, v int")
    joined = skew_join(equal, right, ["grp"], hot_rows=500, counted=equal.groupBy("grp").agg(F.count(F.lit(1)).alias("_rows")))
    assert joined.count() == 4000
    slot = F.pmod(F.xxhash64(F.spark_partition_id(), "grp"), F.lit(8))
    assert equal.select(slot).distinct().count() > 3


def test_null_keys_are_kept_or_refused(spark, skewed):
    split = sampling.random_split(skewed, ["variant_key"], group=["grp"])
    assert split.count() == 900 and split.filter("grp is null").groupBy("split").count().count() == 3
    assert sampling.random_split(skewed, ["variant_key"], group=[]).count() == 900
    strata = skewed.withColumns({"a": F.col("variant_key") % 2, "b": F.when(F.col("variant_key") % 3 > 0, F.col("variant_key") % 2)})
    assert sampling.stratified_split(strata, ["a", "b"], ["variant_key"], group=["grp"], min_stratum=9).count() == 900
    assert sampling.stratified_subsample(strata, sampling.quotas(strata, 200, "grp"), ["a", "b"], ["variant_key"], group="grp").count() == 200
    three = spark.createDataFrame([(1, None, 0), (1, 0, None), (1, 0, 0)], "a int, b int, c int")
    assert three.select(sampling.signature(["a", "b", "c"])).distinct().count() == 3
    unknown = spark.createDataFrame([(1, 0, 5), (None, 2, 9)], "chrom int, start long, end long")
    for operator in (iv.merge_intervals, lambda df: iv.call_peaks(df.withColumn("value", F.lit(9.0)), 1.0, 0, 1, ["chrom"])):
        with pytest.raises(Exception, match="null among chrom"):
            operator(unknown).collect()


def test_hash_rank_matches_window(skewed):
    order = F.md5(F.concat_ws(":", F.lit("3"), F.col("variant_key").cast("string")))
    plain = skewed.withColumn("rank", F.row_number().over(W.partitionBy("grp").orderBy(order, "variant_key")))
    assert as_set(hash_rank(skewed, 3, ["variant_key"], ["grp"]), "variant_key", "rank") == as_set(plain, "variant_key", "rank")
    kept = hash_rank(skewed, 3, ["variant_key"], ["grp"], keep=F.lit(11))
    assert as_set(kept, "variant_key", "rank") == as_set(plain.filter("rank <= 11"), "variant_key", "rank")


def test_top_n_per_group(skewed):
    plain = skewed.withColumn("r", F.row_number().over(W.partitionBy("grp").orderBy("score", "variant_key"))).filter("r <= 4")
    assert as_set(top_n_per_group(skewed, ["grp"], [F.col("score"), F.col("variant_key")], 4), "variant_key") == as_set(plain, "variant_key")


@pytest.mark.parametrize("levels", [2, 7])
def test_aligned_blocks_cover_a_range_once(spark, levels):
    ranges = [(lo, hi) for lo in range(0, 20) for hi in range(lo, 35)]
    df = with_aligned_blocks(spark.createDataFrame(ranges, "lo long, hi long"), F.col("lo"), F.col("hi"), levels)
    assert df.agg(F.max("level")).first()[0] < levels
    size = F.pow(F.lit(2), "level").cast("long")
    cells = df.select("lo", "hi", F.explode(F.sequence(F.col("block") * size, (F.col("block") + 1) * size - 1)).alias("c"))
    found = Counter(map(tuple, cells.collect()))
    assert found == Counter((lo, hi, c) for lo, hi in ranges for c in range(lo, hi))
    up = spark.range(1).select(F.explode(enclosing_blocks(F.lit(13), 4)).alias("b")).select("b.*")
    assert as_set(up, "level", "block") == {(0, 13), (1, 6), (2, 3), (3, 1)}


@pytest.fixture(scope="module")
def pieces(spark):
    """Short and very long intervals on two chromosomes, many at one position."""
    rng = random.Random(2)
    rows = []
    for i in range(500):
        start = 300 if rng.random() < 0.33 else rng.randrange(0, 2000)
        length = rng.choice([1, 3, 8, 15, 400]) if rng.random() < 0.05 else rng.randrange(1, 6)
        rows.append((1 + i % 2, start, start + length, f"f{rng.randrange(3)}", rng.randrange(3)))
    return rows, spark.createDataFrame(rows, "chrom int, start long, end long, feature string, sample int").cache()


def covered(rows):
    return {(c, p) for c, s, e, *_ in rows for p in range(s, e)}


def brute_merge(rows, gap=0):
    out = []
    for c, s, e in sorted((r[0], r[1], r[2]) for r in rows):
        if out and out[-1][0] == c and s <= out[-1][2] + gap:
            out[-1][2] = max(out[-1][2], e)
            out[-1][3] += 1
        else:
            out.append([c, s, e, 1])
    return {tuple(o) for o in out}


@pytest.mark.parametrize("gap", [0, 4])
@pytest.mark.parametrize("width", [7, 64, 1 << 18])
def test_merge_across_buckets(pieces, gap, width):
    rows, df = pieces
    assert as_set(iv.merge_intervals(df, gap=gap, width=width), "chrom", "start", "end", "n") == brute_merge(rows, gap)


@pytest.mark.parametrize("width", [10, 1 << 18])
def test_multi_intersect_across_buckets(pieces, width):
    rows, df = pieces
    segments = iv.multi_intersect(df.filter("feature = 'f0'"), width=width).collect()
    depth = Counter()
    for s in segments:
        for p in range(s["start"], s["end"]):
            depth[s["chrom"], p] += s["n"]
    expected = Counter()
    for sample in range(3):
        for cell in covered([r for r in rows if r[3] == "f0" and r[4] == sample]):
            expected[cell] += 1
    assert depth == expected


@pytest.mark.parametrize("width", [10, 1 << 18])
def test_coverage_and_depth_across_buckets(spark, pieces, width):
    rows, df = pieces
    bins = [(c, s, s + 25) for c in (1, 2) for s in range(0, 2500, 25)]
    got = iv.coverage(spark.createDataFrame(bins, "chrom int, start long, end long"), df.drop("feature", "sample"), width=width)
    cells = covered(rows)
    expected = {
        (c, s, e, sum(r[0] == c and r[1] < e and r[2] > s for r in rows), sum((c, p) in cells for p in range(s, e))) for c, s, e in bins
    }
    assert as_set(got, "chrom", "start", "end", "num_overlaps", "bases_covered") == expected
    points = spark.createDataFrame([(c, p) for c in (1, 2) for p in range(0, 2500, 3)], "chrom int, pos0 long")
    free = iv.outside_intervals(points, df.select("chrom", "start", "end"), width=width)
    assert as_set(free, "chrom", "pos0") == {(c, p) for c in (1, 2) for p in range(0, 2500, 3) if (c, p) not in cells}


@pytest.mark.parametrize("width", [10, 1 << 18])
def test_nearest_across_buckets(spark, width):
    rng = random.Random(3)
    rows = sorted({(f"f{rng.randrange(3)}", 1, rng.randrange(3000)) for _ in range(150)} | {("f3", 2, 5)})
    got = iv.nearest_feature(spark.createDataFrame(rows, "feature string, chrom int, start long"), ["f0", "f1", "f2", "f3"], width=width)
    expected = set()
    for a, c, s in rows:
        for b in ("f0", "f1", "f2", "f3"):
            if a != b:
                best = min(((abs(t - s), t) for g, d, t in rows if g == b and d == c), default=(-1, -1))
                expected.add((a, b, c, s, best[1], best[0]))
    assert as_set(got, "anchor", "feature", "chrom", "start", "nearest", "distance") == expected


def test_start_distances_across_buckets(pieces):
    rows, df = pieces
    got = iv.start_distances(df, width=10)
    expected = Counter()
    for chrom in (1, 2):
        starts = sorted(r[1] for r in rows if r[0] == chrom)
        expected.update((chrom, b, b - a) for a, b in zip(starts, starts[1:]))
    counted = Counter()
    for r in got.collect():
        counted[r["chrom"], r["start"], r["distance"]] += r["n"]
    assert counted == expected


def test_nearest_eligible_across_buckets(spark):
    rng = random.Random(4)
    positives = sorted({(1, rng.randrange(4000), round(rng.random(), 5)) for _ in range(60)})
    sites = {}
    for c, p, pct in positives:
        sites.setdefault((c, p), pct)
    positives = [(c, p, pct) for (c, p), pct in sites.items()]
    candidates = [(i, 1, rng.randrange(4000), round(rng.random(), 5)) for i in range(400)]
    got = vt.nearest_eligible(
        spark.createDataFrame(positives, "chrom int, pos long, MAF_PCT double"),
        spark.createDataFrame(candidates, "variant_key long, chrom int, pos long, MAF_PCT double"), 300, 0.07, width=50,
    )
    expected = set()
    for key, c, p, pct in candidates:
        options = [(abs(q - p), q) for d, q, r in positives if d == c and abs(q - p) <= 300 and abs(round(pct * 1e5) - round(r * 1e5)) <= 7000]
        if options:
            expected.add((key, *min(options)))
    assert as_set(got, "variant_key", "distance", "positive_pos") == expected


def test_no_positive_stays_short_while_a_candidate_is_free(spark):
    rng = random.Random(5)
    positives = [(1, p, round(rng.random(), 2)) for p in sorted(rng.sample(range(2000), 40))]
    candidates = [(i, 1, rng.randrange(2000), round(rng.random(), 2)) for i in range(90)]
    candidates += [(100 + i, 1, candidates[i][2], round(rng.random(), 2)) for i in range(20)]  # two records at one site
    got = vt.matched_negatives(
        spark.createDataFrame(positives, "chrom int, pos long, MAF_PCT double"),
        spark.createDataFrame(candidates, "variant_key long, chrom int, pos long, MAF_PCT double"), 200, 0.2, count=2, width=50,
    ).collect()
    fits = lambda c, p: abs(c[2] - p[1]) <= 200 and abs(round(c[3] * 1e5) - round(p[2] * 1e5)) <= 20_000
    used, filled = Counter(r["pos"] for r in got), Counter(r["positive_pos"] for r in got)
    assert max(used.values()) == 1 and max(filled.values()) == 2
    of = {c[0]: c for c in candidates}
    assert all(fits(of[r["variant_key"]], next(p for p in positives if p[1] == r["positive_pos"])) for r in got)
    open_pairs = [(c, p) for c in candidates for p in positives if c[2] not in used and filled[p[1]] < 2 and fits(c, p)]
    assert not open_pairs
    # Two positives, three candidates that fit both: both are filled.
    both = vt.matched_negatives(
        spark.createDataFrame([(1, 100, 0.5), (1, 300, 0.5)], "chrom int, pos long, MAF_PCT double"),
        spark.createDataFrame([(i, 1, 90 + i, 0.5) for i in range(3)], "variant_key long, chrom int, pos long, MAF_PCT double"), 500, 0.1,
    )
    assert {r["positive_pos"] for r in both.collect()} == {100, 300}


def test_statistics_with_many_blocks(skewed):
    background = skewed.filter("grp = 'hot'")
    few = as_set(stats.empirical_p(skewed, background), "variant_key", "p_value")
    unscored = {r["variant_key"] for r in skewed.filter("score is null").collect()}
    assert len(few) == 900 and {k for k, p in few if p is None} == unscored
    many = stats.empirical_p(skewed, background, rows_per_block=25)
    assert as_set(many, "variant_key", "p_value") == few
    columns = ("variant_key", "rank", "significant")
    tested = as_set(stats.bh(many, 0.4, 300), *columns)
    assert as_set(stats.bh(many, 0.4, 300, rows_per_block=25), *columns) == tested
    assert {r for k, r, s in tested if k in unscored} == {None} and not any(s for k, _, s in tested if k in unscored)
    for method in stats.METHODS:
        assert stats.multitest(many, method, 0.4, 300).filter("significant is null").count() == 0


def test_curves_with_many_blocks(skewed):
    rows = skewed.select(F.col("grp").alias("label"), F.col("score").alias("p"), (F.col("variant_key") % 2).cast("int").alias("y"))
    for curve, columns in ((evaluate.roc_curve, ("fpr", "tpr")), (evaluate.pr_curve, ("precision", "recall"))):
        one, many = curve(rows), curve(rows, rows_per_block=20)
        assert sorted(map(tuple, one.select("label", *columns).collect()), key=repr) == sorted(map(tuple, many.select("label", *columns).collect()), key=repr)
    rows = rows.filter("p is not null and label is not null")
    one, many = evaluate.curve_areas(rows), evaluate.curve_areas(rows, rows_per_block=20)
    for a, b in zip(one.orderBy("label").collect(), many.orderBy("label").collect()):
        assert tuple(a)[1:] == pytest.approx(tuple(b)[1:])
    # The area under the points of the curve, vertical steps included, is the area from the counts.
    under = {r["label"]: r["area"] for r in evaluate.trapezoid(evaluate.roc_curve(rows), "fpr", "tpr", rows_per_block=20).collect()}
    assert under == pytest.approx({r["label"]: r["auroc"] for r in one.collect()})


def test_deviations_of_large_values_do_not_cancel(spark):
    values = [1e9 + x for x in (0, 1, 2, 2, 1)]
    rows = spark.createDataFrame([("a", v, n) for v, n in ((1e9, 1), (1e9 + 1, 2), (1e9 + 2, 2))], "g string, v double, n long")
    expected = statistics.stdev(values)
    weighted = iv.distribution_summary(rows, ["g"], "v", weight="n").collect()[0]
    assert weighted["std"] == pytest.approx(expected) and weighted["mean"] == pytest.approx(1e9 + 1.2)
    assert iv.distribution_summary(rows, [], "v", weight="n").collect()[0]["std"] == pytest.approx(expected)
    runs = spark.createDataFrame([(1, i, i + 1, v) for i, v in enumerate(values)], "chrom int, start long, end long, value double")
    region = spark.createDataFrame([(7, 1, 0, 5)], "region_id int, chrom int, start long, end long")
    got = tracks.region_stats(region, runs).collect()[0]
    assert got["std"] == pytest.approx(expected) and got["mean"] == pytest.approx(1e9 + 1.2) and (got["min"], got["max"]) == (1e9, 1e9 + 2)


def test_windows_on_a_hot_chunk(spark):
    seq = "ACGT" * 500
    chunks = genome.chunk_sequences(spark.createDataFrame([(1, seq)], "chrom int, seq string"), 256, 64)
    snps = spark.createDataFrame([(i, 1, 300 + i % 5, "A") for i in range(400)], "variant_key long, chrom int, pos long, alt string")
    got = genome.extract_windows(snps, chunks, 21, 256, 64, hot_rows=50)
    assert as_set(got, "variant_key", "ref_seq") == {(i, seq[300 + i % 5 - 11:300 + i % 5 + 10]) for i in range(400)}
