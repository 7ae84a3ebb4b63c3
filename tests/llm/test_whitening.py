"""Whitened vectors against numpy on the whole matrix."""

import math

import numpy as np
import pytest

from varloom.llm import queries, whitening


def test_embedding_query(spark, sf):
    raw = {r.vec_id: r.embedding for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()}
    x = {k: [math.floor(1024 * c) + 100000 for c in v] for k, v in raw.items() if v is not None and all(c is not None and math.isfinite(c) for c in v)}
    matrix = np.array(list(x.values()), np.int64)
    n, sums = len(matrix), [sum(column) for column in zip(*x.values())]
    centred = matrix - np.array(sums) / n
    covariance = centred.T @ centred / n
    values, axes = np.linalg.eigh(covariance)
    values, axes = values[::-1], axes[:, ::-1]
    rows = queries.op12_whitened_embeddings(spark, sf).collect()
    assert len(rows) == 8 * n
    got = {(r.vec_id, r.component): r for r in rows}
    assert len(got) == len(rows)
    signs = {}
    for place, (key, vector) in enumerate(x.items()):
        deviation = sum((n * v - s) ** 2 for v, s in zip(vector, sums))
        for k in range(8):
            r = got[key, k + 1]
            expected = float(centred[place] @ axes[:, k] / math.sqrt(values[k]))
            sign = signs.setdefault(k, 1 if r.whitened * expected > 0 else -1)
            assert (r.n, r.deviation) == (n, deviation)
            assert r.whitened == pytest.approx(sign * expected, abs=1e-7)
            assert r.explained == pytest.approx(values[k] / values.sum(), rel=1e-9)
            assert r.identity_error < 1e-9


def rows_frame(spark, matrix, kind="array<double>"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(matrix)], f"id int, vector {kind}").repartition(3)


def test_columns_that_are_nearly_dependent(spark):
    """Columns apart by a hundred-millionth: the Gram matrix alone would lose them."""
    draw = np.random.default_rng(5)
    base = draw.normal(size=(400, 4))
    matrix = np.hstack([base, base[:, :1] + 1e-8 * draw.normal(size=(400, 1))]) + 50
    frame = rows_frame(spark, matrix.tolist())
    model = whitening.fit(frame, components=5)
    centred = matrix - matrix.mean(axis=0)
    singular = np.linalg.svd(centred, compute_uv=False)
    assert np.allclose(np.sqrt(model.eigenvalues * model.n), singular, rtol=1e-5)
    assert model.passes >= 3
    assert whitening.identity_error(frame, model) < 1e-4


def test_constant_and_dependent_columns_have_no_component(spark):
    draw = np.random.default_rng(6)
    base = draw.integers(-50, 50, size=(300, 3))
    matrix = np.hstack([base, base[:, :1] + base[:, 1:2], np.full((300, 1), 7)])
    frame = rows_frame(spark, matrix.tolist(), "array<long>")
    model = whitening.fit(frame, components=8)
    assert model.components.shape == (5, 3) and model.sums == [int(c) for c in matrix.sum(axis=0)]
    assert whitening.identity_error(frame, model) < 1e-9
    assert model.trace == pytest.approx(matrix.var(axis=0).sum())


def test_vectors_of_all_kinds(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [3.0, -1.0]), (2, [3.0, -1.0]), (3, None), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [1.0, inf]),
            (7, []), (8, [1.0]), (9, [0.0, 0.5]), (None, [2.0, 2.0])]
    frame = spark.createDataFrame(rows, "id int, vector array<float>").withColumn("Whitened", whitening.F.lit("own"))
    model = whitening.fit(frame)
    assert model.n == 5 and model.components.shape == (2, 2)
    found = whitening.whiten(frame, model)
    assert found.columns == ["id", "vector", "Whitened", "_whitened"]
    got = [(r.id, r._whitened) for r in found.collect()]
    assert len(got) == len(rows)
    assert {i for i, w in got if w is None} == {3, 4, 5, 6, 7, 8}
    assert len([w for i, w in got if i == 2 and w == [x for j, x in got if j == 2][0]]) == 2


@pytest.mark.parametrize("vectors", [[], [None, []], [[1.0, 2.0]], [[1.0, 2.0]] * 3])
def test_too_few_vectors_for_a_component(spark, vectors):
    frame = spark.createDataFrame([(v,) for v in vectors], "vector array<double>")
    model = whitening.fit(frame)
    assert len(model.eigenvalues) == 0 and whitening.identity_error(frame, model) == 0.0
    assert [r.whitened for r in whitening.whiten(frame, model).collect() if r.whitened] == []
