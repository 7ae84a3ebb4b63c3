"""Scores by running sums against scores of whole windows."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.operators import genome, kmer_track, scoring
from varloom.plans import flows

SIZE, OVERLAP = 64, 24
FEATURES = ["a", "b"]


@pytest.fixture(scope="module")
def weights():
    draw = random.Random(1)
    return {"".join(w): (draw.uniform(-1, 1), draw.uniform(-1, 1)) for w in itertools.product("ACGT", repeat=3)}


@pytest.fixture(scope="module")
def weight_rows(spark, weights):
    return spark.createDataFrame([(w, *v) for w, v in weights.items()], "kmer string, a double, b double")


@pytest.fixture(scope="module")
def genomes():
    draw = random.Random(2)
    return {c: "".join(draw.choice("ACGTACGTACGTN") for _ in range(n)) for c, n in ((1, 400), (2, 64), (3, 21), (4, 20), (5, 1), (6, 88))}


@pytest.fixture(scope="module")
def chunks(spark, genomes):
    return genome.chunk_sequences(spark.createDataFrame(list(genomes.items()), "chrom int, seq string"), SIZE, OVERLAP)


def logits(weights, seq):
    found = [weights.get(seq[i:i + 3], (0.0, 0.0)) for i in range(len(seq) - 2)]
    return [math.fsum(w[f] for w in found) for f in range(2)]


@pytest.mark.parametrize("hot_rows", [1_000_000, 7])
def test_variants_against_whole_windows(spark, genomes, chunks, weights, weight_rows, hot_rows):
    draw = random.Random(3)
    rows = [(i, draw.choice([1, 1, 1, 2, 3, 4, 9]), draw.randint(-3, 405), draw.choice(["A", "C", "G", "T", "N", "GG", "", None])) for i in range(600)]
    rows += [(700, None, 5, "A"), (701, 1, None, "A"), (0, *rows[0][1:])]
    variants = spark.createDataFrame(rows, "variant_key int, chrom int, pos int, alt string").withColumn("ref", F.lit("own")).repartition(4)
    model = kmer_track.KmerModel.of(weight_rows, FEATURES, 3)
    scored = kmer_track.score_variants(variants, chunks, model, 21, SIZE, OVERLAP, hot_rows=hot_rows)
    assert scored.columns == [*variants.columns, "ref_logits", "alt_logits", "problem"]
    got = scored.collect()
    assert sorted(r.variant_key for r in got) == sorted(r[0] for r in rows)
    good = 0
    for r in got:
        start = -1 if r.pos is None else r.pos - 11
        fits = r.chrom in genomes and start >= 0 and start + 21 <= len(genomes[r.chrom]) and r.alt is not None and len(r.alt) == 1
        assert (r.problem is None) == fits and (r.ref_logits is None) == (not fits)
        if not fits:
            assert r.problem == (f"alternate is not one base: {r.alt}" if r.alt is not None and len(r.alt) != 1 else r.problem)
            continue
        good += 1
        ref = genomes[r.chrom][start:start + 21]
        assert r.ref_logits == pytest.approx(logits(weights, ref), abs=1e-9)
        assert r.alt_logits == pytest.approx(logits(weights, ref[:10] + r.alt + ref[11:]), abs=1e-9)
    assert good > 100
    long = kmer_track.long_probabilities(scored, FEATURES)
    assert long.count() == 2 * good


def test_saturation_against_the_general_scan(spark, genomes, chunks, weight_rows):
    model = kmer_track.KmerModel.of(weight_rows, FEATURES, 3)
    matrix, rejects = kmer_track.saturate(chunks, model, 21, SIZE, OVERLAP)
    got = {(r.chrom, r.pos): r for r in kmer_track.matrix_totals(matrix).collect()}
    lost = {(r.chrom, r.pos): r for r in rejects.collect()}
    every = {(c, p) for c, seq in genomes.items() for p in range(1, len(seq) + 1)}
    assert got.keys() | lost.keys() == every and not got.keys() & lost.keys()
    for (c, p), r in lost.items():
        assert r.ref == genomes[c][p - 1] and r.problem == f"window leaves its chromosome: {c}:{p}"
    regions = spark.createDataFrame([(c, 1, len(seq)) for c, seq in genomes.items()], "chrom int, start int, end int")
    scorer = lambda windows: scoring.score_kmer_pairs(windows, weight_rows, FEATURES, 3)
    general, _, problems = flows.saturation_scan(chunks, regions, scorer, FEATURES, 21, 0.5, SIZE, OVERLAP)
    expected = {(r.chrom, r.pos): r for r in general.collect()}
    assert expected.keys() == got.keys()
    for at, r in expected.items():
        own = got[at]
        assert own.ref == r.ref == genomes[at[0]][at[1] - 1]
        for name in (*"ACGT", "cumulative", "max_effect"):
            assert own[name] == pytest.approx(r[name], abs=1e-9)
    assert {(r.chrom, r.pos) for r in problems.select("chrom", "pos").distinct().collect()} == lost.keys()


def test_long_chunks_keep_exact_differences():
    """A window far along a chunk has the same score as alone, whatever came before."""
    draw = np.random.default_rng(4)
    model = kmer_track.KmerModel(("a",), "ACGT", 3, draw.normal(size=(1, 64)) * 1e3)
    letters = np.frombuffer(b"ACGTN", np.uint8)[draw.integers(0, 5, 200_000)]
    track = kmer_track.Track(model, letters)
    for start in (0, 17, 150_001, 199_900):
        alone = kmer_track.Track(model, letters[start:start + 100])
        assert track.real(track.windows(np.array([start]), 100)) == pytest.approx(alone.real(alone.windows(np.array([0]), 100)), rel=1e-9, abs=1e-6)


def test_short_windows_and_empty_frames(spark, chunks, weight_rows):
    model = kmer_track.KmerModel.of(weight_rows, FEATURES, 3)
    variants = spark.createDataFrame([(1, 1, 5, "A")], "variant_key int, chrom int, pos int, alt string")
    short = kmer_track.score_variants(variants, chunks, model, 2, SIZE, OVERLAP).first()
    assert short.ref_logits == short.alt_logits == [0.0, 0.0]
    assert kmer_track.score_variants(variants.limit(0), chunks, model, 21, SIZE, OVERLAP).count() == 0
    none = kmer_track.score_variants(variants, chunks.limit(0), model, 21, SIZE, OVERLAP).first()
    assert none.problem == "window leaves its chromosome: 1:5"
    with pytest.raises(ValueError, match="overlap"):
        kmer_track.saturate(chunks, model, OVERLAP + 1, SIZE, OVERLAP)


@pytest.mark.parametrize("k, length, centre", [(1, 5, 2), (3, 21, 10), (3, 5, 2), (3, 7, 1), (3, 7, 5), (5, 31, 15)])
def test_effects_by_surroundings_are_those_of_each_place(k, length, centre):
    draw = np.random.default_rng(4)
    model = kmer_track.KmerModel(("a", "b"), "ACGT", k, draw.normal(size=(2, 4**k)))
    track = kmer_track.Track(model, np.frombuffer("".join(draw.choice([*"ACGTN"], 9000)).encode(), np.uint8))
    starts = np.arange(9000 - length + 1)
    found = track.effects(starts, length, centre, [0, 1, 2, 3])
    for digit in range(4):
        change = track.real(track.changes(starts, length, centre, np.full(len(starts), digit)))
        assert (found[digit] == np.sqrt((change * change).sum(axis=0))).all()
