"""Nearest intervals of any width and peaks at many cutoffs, against plain Python; small buckets, so that much crosses a border."""

import random

import pytest

from varloom.operators import intervals as iv, tracks


@pytest.mark.parametrize("width", [16, 1 << 18])
def test_nearest_of_nested_and_overlapping_intervals(spark, width):
    draw = random.Random(1)
    rows = []
    for i in range(160):
        start = draw.randint(0, 300)
        rows.append((i, draw.choice([1, 1, 2]), start, start + draw.choice([1, 2, 5, 30, 150]), draw.choice("abc")))
    rows += [(900, 3, 5, 9, "a"), (901, 3, 9, 12, "b"), (902, 3, 12, 13, "z"), rows[0]]
    frame = spark.createDataFrame(rows, "id int, chrom int, start long, end long, feature string").repartition(3)
    got = iv.nearest_intervals(frame, list("abc"), width=width)
    assert got.columns == [*frame.columns, "other", "nearest", "distance"]
    expected = []
    for i, chrom, start, end, feature in rows:
        for other in "abc":
            if feature in "abc" and other != feature:
                near = [
                    (0 if s < end and e > start else start - e + 1 if e <= start else s - end + 1, s)
                    for _, c, s, e, f in rows if c == chrom and f == other
                ]
                distance, nearest = min(near, default=(-1, -1))
                expected.append((i, chrom, start, end, feature, other, nearest, distance))
    assert sorted(map(tuple, got.collect())) == sorted(expected)


def plain_peaks(runs, cutoff, gap, least):
    found = []
    for chrom in {r[0] for r in runs}:
        at = None
        for _, start, end, value in sorted(r for r in runs if r[0] == chrom and r[3] is not None and r[3] >= cutoff):
            if at and start <= at[1] + gap:
                at[1] = max(at[1], end)
            else:
                at = [start, end]
                found.append(at)
    return [e - s for s, e in found if e - s >= least]


@pytest.mark.parametrize("width", [8, 64, 1 << 18])
def test_many_cutoffs_against_each_alone(spark, width):
    draw = random.Random(2)
    runs = []
    for chrom in ("x", "y"):
        at = 0
        while at < 600:
            size = draw.choice([1, 3, 7, 90])
            if draw.random() < 0.8:
                runs.append((chrom, at, at + size, draw.choice([0.0, 1.5, 2.0, 5.0, 9.5, None])))
            at += size + draw.choice([0, 0, 2, 6])
    frame = spark.createDataFrame(runs, "chrom string, start long, end long, value double").repartition(3)
    cutoffs = [x / 4 for x in range(-2, 44)]
    got = {r.cutoff: r for r in iv.cutoff_analysis(frame, [*cutoffs, 2.0], 4, 10, width=width).collect()}
    for cutoff in cutoffs:
        lengths = plain_peaks(runs, cutoff, 4, 10)
        assert (cutoff in got) == bool(lengths)
        if lengths:
            r = got[cutoff]
            assert (r.n_peaks, r.total_length, r.mean_length) == (len(lengths), sum(lengths), sum(lengths) / len(lengths))
            alone = iv.call_peaks(frame, cutoff, 4, 10, width=width) if cutoff in (2.0, 5.0) else None
            assert alone is None or alone.count() == r.n_peaks
    assert iv.cutoff_analysis(frame, [99.0]).count() == 0 and iv.cutoff_analysis(frame, []).count() == 0
    assert iv.cutoff_analysis(frame.limit(0), [1.0]).count() == 0


@pytest.mark.parametrize("bound", [0, tracks.BROADCAST_BLOCKS])
def test_regions_with_and_without_a_broadcast_of_blocks(spark, monkeypatch, bound):
    monkeypatch.setattr(tracks, "BROADCAST_BLOCKS", bound)
    draw = random.Random(3)
    runs, regions = [], []
    for chrom in (1, 2):
        at = draw.randint(0, 50)
        while at < 5000:
            end = at + draw.choice([1, 1, 2, 5, 40, 700])
            runs.append((chrom, at, end, draw.randint(0, 5000) / 100))
            at = end + draw.choice([0, 0, 1, 30, 300])
    for i in range(300):
        start = draw.choice([0, 127, 128, 129, 255, 256, draw.randint(0, 5500)])
        regions.append((i, draw.choice([1, 2, 3]), start, start + draw.choice([1, 3, 100, 127, 128, 129, 256, 700, 3000])))
    found = tracks.region_stats(
        spark.createDataFrame(regions, "region_id long, chrom int, start long, end long"),
        spark.createDataFrame(runs, "chrom int, start long, end long, value double"),
    ).collect()
    assert len(found) == len(regions)
    for row in found:
        over = [(min(row.end, e) - max(row.start, s), v) for c, s, e, v in runs if c == row.chrom and s < row.end and e > row.start]
        bases = sum(b for b, _ in over)
        assert round(row.coverage * (row.end - row.start)) == bases
        if not over:
            assert row["mean"] is None and row["min"] is None
            continue
        mean = sum(b * v for b, v in over) / bases
        assert (row["min"], row["max"]) == (min(v for _, v in over), max(v for _, v in over))
        assert row["mean"] == pytest.approx(mean)
        if bases > 1:
            assert row["std"] == pytest.approx((sum(b * (v - mean) ** 2 for b, v in over) / (bases - 1)) ** 0.5, abs=1e-5)
