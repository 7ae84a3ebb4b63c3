"""Multilabel stratification: exact sizes, and labels closer to their shares than label sets cut one by one."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from varloom.operators import sampling, stratify


def rows_of(n, labels, seed):
    draw = random.Random(seed)
    chances = [draw.choice([0.02, 0.1, 0.3, 0.6]) for _ in range(labels)]
    return [tuple(int(draw.random() < c) for c in chances) for _ in range(n)]


def sets_of(rows):
    return [("|".join(map(str, r)), [i for i, x in enumerate(r) if x], n) for r, n in Counter(rows).items()]


def distance(sets, taken, sizes):
    """Rows by which the folds' label counts miss their shares, over all labels and folds."""
    rows, labels = sum(sizes), {l for _, own, _ in sets for l in own}
    return sum(
        abs(sum(taken[name][f] for name, own, _ in sets if l in own) - size / rows * sum(n for _, own, n in sets if l in own))
        for f, size in enumerate(sizes) for l in labels
    )


@pytest.mark.parametrize("seed", range(20))
def test_dealt_counts(seed):
    draw = random.Random(seed)
    n = draw.randint(1, 400)
    sets = sets_of(rows_of(n, draw.randint(1, 12), seed))
    test, val = draw.randint(0, n // 3), draw.randint(0, n // 3)
    sizes = [test, val, n - test - val]
    taken = stratify.deal(sets, sizes)
    for name, _, rows in sets:
        assert sum(taken[name]) == rows
        # no set is further than its last rows from its share
        assert all(rows * s // n <= t <= rows * s // n + len(sizes) - 1 for t, s in zip(taken[name], sizes))
    assert [sum(t[f] for t in taken.values()) for f in range(3)] == sizes
    assert stratify.deal(sets[::-1], sizes) == taken


def test_labels_are_balanced_over_rare_sets():
    """Most label sets are rare: cut one by one, they go to the largest fold."""
    missed = {"dealt": 0.0, "alone": 0.0}
    for seed in range(10):
        sets, sizes = sets_of(rows_of(300, 12, seed)), [60, 60, 180]
        alone = {name: [round(n * 0.2), round(n * 0.2), n - 2 * round(n * 0.2)] for name, _, n in sets}
        dealt = distance(sets, stratify.deal(sets, sizes), sizes)
        assert dealt < distance(sets, alone, sizes) and dealt < 3 * 12 * 3  # three rows per label and fold
        missed["dealt"] += dealt
        missed["alone"] += distance(sets, alone, sizes)
    assert missed["dealt"] < 0.2 * missed["alone"]


def test_split_of_twelve_labels(spark):
    rows = [(i, i % 3 if i % 7 else None, *r) for i, r in enumerate(rows_of(900, 12, 5))]
    names = [f"l{i}" for i in range(12)]
    frame = spark.createDataFrame(rows, "id int, grp int, " + ", ".join(f"{n} int" for n in names)).repartition(6)
    split = sampling.stratified_split(frame, names, ["id"], group=["grp"])
    assert split.columns == [*frame.columns, "split"]
    got = [r.asDict() for r in split.collect()]
    assert sorted(r["id"] for r in got) == list(range(900))
    for group in (0, 1, 2, None):
        own = [r for r in got if r["grp"] == group]
        sizes = Counter(r["split"] for r in own)
        fifth = int(len(own) * 0.2 + 0.5)
        assert (sizes["test"], sizes["val"], sizes["train"]) == (fifth, fifth, len(own) - 2 * fifth)
        missed = [
            abs(sum(r[name] for r in own if r["split"] == part) - sum(r[name] for r in own) * size / len(own))
            for name in names for part, size in sizes.items()
        ]
        assert sum(missed) / len(missed) < 3
    again = sampling.stratified_split(frame.repartition(2), names, ["id"], group=["grp"])
    assert sorted((r["id"], r["split"]) for r in again.collect()) == sorted((r["id"], r["split"]) for r in got)


def test_subsample_keeps_label_shares(spark):
    rows = [(i, i % 2, *r) for i, r in enumerate(rows_of(1000, 8, 6))]
    names = [f"l{i}" for i in range(8)]
    frame = spark.createDataFrame(rows, "id int, chrom int, " + ", ".join(f"{n} int" for n in names))
    picked = sampling.stratified_subsample(frame, sampling.quotas(frame, 101), names, ["id"])
    assert picked.columns == frame.columns and picked.count() == 101
    for chrom in (0, 1):
        own, all_ = picked.filter(F.col("chrom") == chrom), frame.filter(F.col("chrom") == chrom)
        n = own.count()
        missed = [abs(own.agg(F.sum(name)).first()[0] - all_.agg(F.avg(name)).first()[0] * n) for name in names]
        assert sum(missed) / len(missed) < 3


def test_unknown_labels_and_empty_frames(spark):
    frame = spark.createDataFrame([(1, 1, None), (2, 1, 0), (3, None, 1), (4, 0, 0), (5, None, None)], "id int, a int, b int")
    split = sampling.stratified_split(frame, ["a", "b"], ["id"], group=[])
    assert Counter(r["split"] for r in split.collect()) == {"test": 1, "val": 1, "train": 3}
    assert sampling.stratified_split(frame.limit(0), ["a", "b"], ["id"], group=[]).count() == 0


def test_label_sets_of_rows(spark):
    frame = spark.range(30).select("id", *[(F.col("id") % k == 0).cast("int").alias(f"l{k}") for k in (2, 3, 5)])
    strata = stratify.label_sets(frame, ["l2", "l3", "l5"], []).collect()
    assert {tuple(r["_labels"]): r["_rows"] for r in strata} == {
        (0, 1, 2): 1, (0, 1): 4, (0, 2): 2, (1, 2): 1, (0,): 8, (1,): 4, (2,): 2, (): 8,
    }
