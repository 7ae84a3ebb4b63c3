"""Whitening of vectors by shifted CholeskyQR.

The centred rows Y are orthogonalised without ever being brought together: each pass sums the Gram matrix of the rows as
far as they are orthogonal already, one small matrix per task, and its Cholesky factor is the next triangle. Rows meet the
triangles by triangular solves, Q = Y R^-1. The first factor is of a shifted Gram matrix, which exists however close to
each other columns are; later passes mend what the shift and rounding left, until Q'Q is the identity. The factors
compose to R with Y = Q R, and the singular value decomposition of R, which has the size of the dimension squared, gives
the principal components of Y without squaring its condition number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from varloom.llm.common import free_name

COMPONENTS = 8
MAX_PASSES = 6
ORTHOGONAL = 1e-10
RANK = 1e-10  # singular values under this share of the largest one count as zero
_ENTRIES = 1 << 20  # entries of vectors looked at together


@dataclass(frozen=True)
class Whitening:
    """``n`` vectors with ``sums``, ``components`` in columns by falling eigenvalue, and ``trace`` of the covariance.

    ``sums`` are Python integers, and exact, for vectors of whole numbers.
    """

    n: int
    sums: list
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    passes: int

    @property
    def dimension(self) -> int:
        return len(self.sums)

    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean in two parts, of which the first has no rounding error for whole numbers."""
        if self.sums and isinstance(self.sums[0], int):
            whole = [s // self.n for s in self.sums]
            return np.array(whole, np.int64), np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole)])
        return np.array(self.sums) / max(1, self.n), np.zeros(self.dimension)


def usable(vector: str) -> Column:
    """Whether a vector is there and all its entries are finite numbers."""
    entries = F.col(f"`{vector}`")
    return entries.isNotNull() & F.forall(entries, lambda c: c.isNotNull() & (F.abs(c.cast("double")) < F.lit(float("inf"))))


def _blocks(batches: Iterator[pa.RecordBatch], dimension: int) -> Iterator[np.ndarray]:
    """The column vector as matrices of some rows."""
    rows = max(1, _ENTRIES // max(1, dimension))
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows).column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dimension)


def solve_right(rows: np.ndarray, triangle: np.ndarray) -> np.ndarray:
    """X with X R = rows for an upper triangle R, column by column."""
    found = np.empty_like(rows)
    for j in range(rows.shape[1]):
        found[:, j] = (rows[:, j] - found[:, :j] @ triangle[:j, j]) / triangle[j, j]
    return found


def _vectors(df: DataFrame, vector: str, dimension: int) -> DataFrame:
    return df.filter(usable(vector) & (F.size(f"`{vector}`") == dimension)).select(F.col(f"`{vector}`").alias("vector"))


def _summed_products(vectors: DataFrame, size: int, rows_of) -> np.ndarray:
    """The sum of X'X over all blocks X that ``rows_of`` makes; each task sends one matrix, and equal cells are summed by Spark."""
    upper = np.triu_indices(size)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, met = np.zeros((size, size)), False
        for rows in rows_of(batches):
            total += rows.T @ rows
            met = True
        if met:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(upper[0]), dtype=np.int32)), pa.array(total[upper])], names=["cell", "value"])

    # One row per pair of columns, however many vectors there are.
    got = vectors.mapInArrow(products, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value")).toArrow()
    found = np.zeros((size, size))
    cells = got["cell"].to_numpy()
    found[upper[0][cells], upper[1][cells]] = got["value"].to_numpy()
    return np.triu(found) + np.triu(found, 1).T


def _triangle(gram: np.ndarray, n: int, shift: bool) -> np.ndarray:
    """The upper Cholesky factor, of the shifted matrix if asked for or if the matrix itself has none."""
    d = len(gram)
    step = 11 * (n * d + d * (d + 1)) * np.finfo(float).eps / 2 * np.linalg.norm(gram, 2)
    if not shift:
        try:
            return np.linalg.cholesky(gram).T
        except np.linalg.LinAlgError:
            pass
    return np.linalg.cholesky(gram + step * np.eye(d)).T


def fit(vectors: DataFrame, vector: str = "vector", components: int = COMPONENTS, max_passes: int = MAX_PASSES) -> Whitening:
    """Mean, components and eigenvalues of the covariance (divisor n) of all usable vectors of ``vectors``.

    ``vectors`` should be a stored frame, as it is read once for the sums and once per pass: three times when columns are
    independent.

    - Vectors that are null, or hold a null, NaN or infinite entry, are left out; so are those of another length than most
      vectors have (the greater length on a tie).
    - Repeated vectors count as often as they occur. With no usable vector there is no component.
    - Components are those with a singular value above ``RANK`` of the largest, ``components`` at most; of dependent or
      constant columns there are fewer. The largest entry of each is positive.
    - Matrices of the dimension squared are held by tasks and driver, nothing that grows with the number of vectors.
    """
    nothing = Whitening(0, [], np.zeros((0, 0)), np.zeros(0), 0.0, 0)
    lengths = vectors.filter(usable(vector)).groupBy(F.size(f"`{vector}`").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    if most is None or most["d"] == 0:
        return nothing
    d, n = most["d"], most["n"]
    chosen = _vectors(vectors, vector, d)
    whole = chosen.schema["vector"].dataType.elementType.typeName() in ("byte", "short", "integer", "long")
    kind = "decimal(38,0)" if whole else "double"
    by_place = chosen.select(F.posexplode("vector").alias("at", "entry")).groupBy("at").agg(F.sum(F.col("entry").cast(kind)).alias("total"))
    sums = [int(r["total"]) if whole else r["total"] for r in by_place.orderBy("at").collect()]  # one row per dimension
    model = Whitening(n, sums, np.zeros((d, 0)), np.zeros(0), 0.0, 0)
    high, low = model.centre()

    triangle, trace, done = None, 0.0, 0
    while done < max_passes:
        sent = chosen.sparkSession.sparkContext.broadcast((high, low, triangle))

        def rows_of(batches, sent=sent):
            high, low, triangle = sent.value
            for block in _blocks(batches, d):
                rows = (block - high) - low
                yield rows if triangle is None else solve_right(rows, triangle)

        gram = _summed_products(chosen, d, rows_of)
        sent.destroy()
        if triangle is None:
            trace = float(np.trace(gram)) / n
            if not trace:
                return model
        step = _triangle(gram, n, shift=triangle is None)
        triangle = step if triangle is None else step @ triangle
        done += 1
        if np.abs(gram - np.eye(d)).max() <= ORTHOGONAL:
            break
    _, singular, right = np.linalg.svd(triangle)
    kept = int((singular > RANK * singular[0]).sum())
    axes = right[:min(kept, components)].T
    axes = axes * np.where(axes[np.abs(axes).argmax(axis=0), np.arange(axes.shape[1])] < 0, -1.0, 1.0)
    return Whitening(n, sums, axes, singular[:axes.shape[1]] ** 2 / n, trace, done)


def _projector(model: Whitening):
    high, low = model.centre()
    scale = model.components / np.sqrt(model.eigenvalues)
    return lambda block: ((block - high) - low) @ scale


def whiten(df: DataFrame, model: Whitening, vector: str = "vector") -> DataFrame:
    """All rows and columns of ``df`` plus whitened: the centred vector on each component, over its standard deviation.

    - Null for vectors that ``fit`` would leave out, and for all of them where the model has no vectors.
    - Repeated rows give repeated rows; an empty table gives none. If ``df`` has that column it gets leading underscores.
    """
    own = free_name(df.columns, "whitened")
    if not model.dimension:
        return df.withColumn(own, F.lit(None).cast("array<double>"))
    sent = df.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("array<double>")
    def projected(vectors: pa.Array) -> pa.Array:
        project, k = _projector(sent.value), len(sent.value.eigenvalues)
        known = vectors.drop_null()
        rows = [project(b) for b in _blocks([pa.RecordBatch.from_arrays([known], names=["vector"])], sent.value.dimension)]
        values = np.concatenate(rows) if rows else np.zeros((0, k))
        offsets = np.concatenate([[0], np.cumsum(vectors.is_valid().to_numpy(zero_copy_only=False) * k)])
        mask = vectors.is_null()
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.ravel()), mask=mask)

    fits = usable(vector) & (F.size(f"`{vector}`") == model.dimension)
    return df.withColumn(own, projected(F.when(fits, F.col(f"`{vector}`"))))


def identity_error(vectors: DataFrame, model: Whitening, vector: str = "vector") -> float:
    """The largest entry, in absolute value, of the whitened vectors' covariance minus the identity, in one pass.

    0 without components. Whitened vectors are centred already.
    """
    k = len(model.eigenvalues)
    if not k:
        return 0.0
    sent = vectors.sparkSession.sparkContext.broadcast(model)

    def rows_of(batches):
        project = _projector(sent.value)
        for block in _blocks(batches, sent.value.dimension):
            yield project(block)

    covariance = _summed_products(_vectors(vectors, vector, model.dimension), k, rows_of) / model.n
    return float(np.abs(covariance - np.eye(k)).max())
