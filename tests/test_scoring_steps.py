"""Scores of windows and sequences, against plain Python."""

import contextlib
import io
import itertools
import math
import random

import numpy as np
import pytest

from varloom.operators import scoring
from varloom.plans import queries_sequences


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


@pytest.mark.parametrize("alphabet", ["ACGT", "ACGé"])
def test_kmer_scores_add_up_from_left_to_right(spark, alphabet, monkeypatch):
    draw = random.Random(5)
    weights = {"".join(w): (draw.uniform(-1, 1), draw.choice([None, draw.uniform(-9, 9)])) for w in itertools.product(alphabet, repeat=3)}
    rows = spark.createDataFrame([(w, *v) for w, v in weights.items()], "kmer string, a double, b double")
    seqs = [None, "", "A", "AC", "NNNNN", "aCGT", "😀ACG", *["".join(draw.choice(alphabet + "ACN") for _ in range(draw.choice([3, 40, 300]))) for _ in range(90)]]
    windows = [(i, draw.choice(seqs), draw.choice(seqs)) for i in range(300)]
    df = spark.createDataFrame(windows, "variant_key long, ref_seq string, alt_seq string").repartition(3)
    monkeypatch.setattr("varloom.operators.kmer_track._LETTERS", 500)  # held here only: workers have their own

    def probability(seq, f):
        if seq is None:
            return None
        total = 0.0
        for i in range(len(seq) - 2):
            total += weights.get(seq[i:i + 3], (0.0, 0.0))[f] or 0.0
        return 1 / (1 + math.exp(-total))

    near = lambda x, y: (x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-12))
    pairs = scoring.score_kmer_pairs(df, rows, ["a", "b"], 3)
    assert "aggregate" not in plan(pairs).lower() and pairs.columns == ["variant_key", "feature", "p_ref", "p_alt"]
    got = {(r.variant_key, r.feature): r for r in pairs.collect()}
    assert len(got) == 600 == pairs.count()
    for key, ref, alt in windows:
        for f, feature in enumerate("ab"):
            r = got[key, feature]
            assert near(r.p_ref, probability(ref, f)) and near(r.p_alt, probability(alt, f))
    single = scoring.score_kmers(df, rows, ["a", "b"], 3, seq="alt_seq")
    assert "aggregate" not in plan(single).lower() and single.columns == ["variant_key", "a", "b"]
    assert all(near(r.a, probability(w[2], 0)) and near(r.b, probability(w[2], 1)) for r, w in zip(sorted(single.collect()), windows))
    # The same sums, however many sequences are held together.
    known = (alphabet, np.array([[v[f] or 0.0 for v in weights.values()] for f in range(2)]))
    import pyarrow as pa

    whole = scoring._kmer_logits(pa.array(seqs), known, 3).to_pylist()
    assert whole == [x for s in seqs for x in scoring._kmer_logits(pa.array([s], pa.string()), known, 3).to_pylist()]


def test_models_see_small_batches_and_rows_keep_their_other_columns(spark):
    rows = [(i, None if i % 3 else 2**60 + i, "ACGT"[i % 4] * (i % 5 + 1)) for i in range(100)]
    df = spark.createDataFrame(rows, "id int, big long, seq string").coalesce(2)

    def model(batch):
        assert 0 < len(batch) <= 7
        return np.array([[len(s), -len(s)] for s in batch])

    scored = scoring.score_sequences(df, model, ["up", "down"], batch=7, logits=False)
    # A frame per batch of the model, and pandas' numbers in place of nulls, came of the former way.
    assert "MapInPandas" not in plan(scored)
    assert sorted(map(tuple, scored.collect())) == [(*r, float(len(r[2])), -float(len(r[2]))) for r in rows]
    two = df.selectExpr("big", "id as variant_key", "seq as ref_seq", "concat(seq, 'A') as alt_seq")
    pairs = scoring.score_pairs(two, model, ["up", "down"], batch=7, logits=False)
    assert "MapInPandas" not in plan(pairs)
    expected = [(i, f, s * len(seq), s * (len(seq) + 1.0)) for i, _, seq in rows for f, s in (("down", -1.0), ("up", 1.0))]
    assert sorted(map(tuple, pairs.collect())) == expected
    with pytest.raises(Exception, match="the model returned"):
        scoring.score_sequences(df, lambda batch: np.zeros((len(batch) + 1, 2)), ["up", "down"]).collect()


def test_stand_in_model_by_composition():
    out = queries_sequences.gc_model(["GGCC", "AATN", "", None])
    assert out[:2].tolist() == [[2.0, 0.0], [-2.0, 1.0]] and np.isnan(out[2:]).all()
