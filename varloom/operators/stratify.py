"""Iterative multilabel stratification on counts of label sets.

A row can hold several labels, and most label sets are rare, so cutting each set by itself gives rare sets no row in small
folds. Here a fold first gets its floored share of every label set. The rows left over, fewer than there are folds for
each set, are dealt one at a time, sets with the rarest labels first: a row goes to the fold that lacks its rarest label
most, then to the one with most rows to fill. A full fold gets no more, so sizes are exact.

Only counts are dealt: one row per group and label set, however many rows have it. Rows follow their set's counts.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from varloom.operators.scale import match

MAX_LABEL_SETS = 1 << 20


def signature(features: Sequence[str]) -> Column:
    """The label set of a row as one string, unknown labels included."""
    return F.concat_ws("|", *[F.coalesce(F.col(f).cast("string"), F.lit("?")) for f in features])


def label_sets(df: DataFrame, features: Sequence[str], group: Sequence[str]) -> DataFrame:
    """(group, _stratum, _labels, _rows): the label sets of each group, with the places of the labels that are 1."""
    held = F.filter(F.array(*[F.when(F.col(f) == 1, F.lit(i)) for i, f in enumerate(features)]), lambda i: i.isNotNull())
    return df.groupBy(*group, signature(features).alias("_stratum")).agg(F.first(held).alias("_labels"), F.count(F.lit(1)).alias("_rows"))


def deal(sets: Sequence[tuple[str, Sequence[int], int]], sizes: Sequence[int]) -> dict[str, list[int]]:
    """Rows of each label set (name, labels, rows) for each fold of the given sizes, which add up to all rows.

    Whole numbers only: a fold lacks ``ones * size - rows * given`` of a label, in units of one over all rows.
    """
    rows, folds = sum(sizes), range(len(sizes))
    taken = {name: [n * size // rows for size in sizes] for name, _, n in sets}
    room = [size - sum(t[f] for t in taken.values()) for f, size in enumerate(sizes)]
    ones: dict[int, int] = {}
    lacks: list[dict[int, int]] = [{} for _ in folds]
    for name, labels, n in sets:
        for label in labels:
            ones[label] = ones.get(label, 0) + n
            for f in folds:
                lacks[f][label] = lacks[f].get(label, 0) + n * sizes[f] - rows * taken[name][f]
    rarest = {name: min(((ones[l], l) for l in labels), default=None) for name, labels, _ in sets}
    for name, labels, n in sorted(sets, key=lambda s: (rarest[s[0]] is None, rarest[s[0]] or (), s[0])):
        first = rarest[name]
        for _ in range(n - sum(taken[name])):
            fold = max((f for f in folds if room[f] > 0), key=lambda f: (lacks[f][first[1]] if first else 0, room[f], -f))
            taken[name][fold] += 1
            room[fold] -= 1
            for label in labels:
                lacks[fold][label] -= rows
    return taken


def allocate(strata: DataFrame, sizes: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, _stratum, _take): rows of each label set for each fold.

    ``strata`` is as ``label_sets`` gives it, ``sizes`` has an array ``_sizes`` of fold sizes for each group. The
    label sets of a group meet in one task: 2 ** labels at most where labels are 0 or 1, and an error above ``MAX_LABEL_SETS``.
    """
    group = list(group)
    placed = match(strata, sizes, group) if group else strata.crossJoin(F.broadcast(sizes))  # one row
    schema = f"{placed.select(*group, '_stratum').schema.simpleString()[7:-1]}, _take array<long>"

    def dealt(frame: pd.DataFrame) -> pd.DataFrame:
        if len(frame) > MAX_LABEL_SETS:
            raise ValueError(f"{len(frame)} label sets in one group; use fewer labels")
        sets = [(s, [int(l) for l in labels], int(n)) for s, labels, n in zip(frame["_stratum"], frame["_labels"], frame["_rows"])]
        taken = deal(sets, [int(s) for s in frame["_sizes"].iloc[0]])
        return frame[[*group, "_stratum"]].assign(_take=[taken[s] for s in frame["_stratum"]])

    return placed.groupBy(F.struct(F.lit(0).alias("_"), *group).alias("_group")).applyInPandas(dealt, schema)
