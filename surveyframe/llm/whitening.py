"""Whitening of embeddings by hierarchical singular value decompositions.

The covariance is never formed. A partition of the distinct vectors keeps a summary of those it has seen: their number, their exact
sums, and all singular values with their right vectors of the centred rows. Two summaries are merged by decomposing the rows of
both, each vector times its value, together with one row more for the difference of their means,

    sqrt(n1 * n2 / (n1 + n2)) * (mean1 - mean2)

which loses no dimension. A summary has as many rows as the vectors have dimensions, whatever the number of vectors. Summaries are
merged in groups of ``FAN`` by Spark until one is left.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: Summaries merged by one task of a round.
FAN = 16
#: Vectors decomposed at once.
ROWS = 4096
#: A singular value counts as none below so many times the largest one.
NONE = 1e-10


def cells(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and x: floor(256 c) of each entry c, for rows whose vector isn't null, has entries, and only finite ones."""
    src = embeddings.select(F.col(id_col).alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")))
    return src.where(F.col("v").isNotNull() & (F.size("v") > 0) & finite).select("vec_id", F.transform("v", lambda c: F.floor(c * 256).cast("long")).alias("x"))


@dataclass
class Summary:
    """Of n vectors: their sums, exact, and the singular values and vectors of the rows around their mean."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray

    @property
    def mean(self) -> np.ndarray:
        """Whole and remaining part divided by themselves, so that long sums lose nothing."""
        return np.array([s // self.n + (s % self.n) / self.n for s in self.sums])

    @classmethod
    def of(cls, x: np.ndarray) -> Summary:
        """Of the rows of a matrix of whole numbers."""
        sums = [int(s) for s in x.astype(object).sum(axis=0)] if np.abs(x).max() > 2**62 // len(x) else x.sum(axis=0).tolist()
        found = cls(len(x), sums, np.zeros(0), np.zeros((0, x.shape[1])))
        found.values, found.vectors = _decomposed(x - found.mean)
        return found

    def merged(self, other: Summary) -> Summary:
        if len(self.sums) != len(other.sums):
            raise ValueError(f"vectors of {len(self.sums)} and of {len(other.sums)} entries")
        n = self.n + other.n
        gap = np.sqrt(self.n / n * other.n) * (self.mean - other.mean)
        rows = np.vstack([self.values[:, None] * self.vectors, other.values[:, None] * other.vectors, gap])
        return Summary(n, [a + b for a, b in zip(self.sums, other.sums, strict=True)], *_decomposed(rows))

    def packed(self, part: int) -> pa.RecordBatch:
        columns = [pa.array([part], pa.int64()), pa.array([self.n], pa.int64()), pa.array([list(map(str, self.sums))], pa.list_(pa.string())), pa.array([self.values.tolist()], pa.list_(pa.float64())), pa.array([self.vectors.ravel().tolist()], pa.list_(pa.float64()))]
        return pa.RecordBatch.from_arrays(columns, ["part", "n", "sums", "values", "vectors"])


def _decomposed(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    _, values, vectors = np.linalg.svd(rows, full_matrices=False)
    return values, vectors


def _unpacked(table: pa.Table | pa.RecordBatch) -> Iterator[Summary]:
    for row in table.to_pylist():
        yield Summary(row["n"], [int(s) for s in row["sums"]], np.array(row["values"]), np.array(row["vectors"]).reshape(len(row["values"]), len(row["sums"])))


SUMMARY = "part long, n long, sums array<string>, values array<double>, vectors array<double>"


def _all_merged(found: Iterator[Summary]) -> Summary | None:
    total = None
    for one in found:
        total = one if total is None else total.merged(one)
    return total


def summarise(vectors: DataFrame) -> Summary | None:
    """The summary of the rows ``x`` (array<long>), None if there are none. Repeated rows count each."""

    def leaf(batches):
        def parts():
            for batch in batches:
                for at in range(0, batch.num_rows, ROWS):
                    yield from map(Summary.of, _matrices(batch.slice(at, ROWS).column("x")))

        if (total := _all_merged(parts())) is not None:
            yield total.packed(TaskContext.get().partitionId())

    def group(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_all_merged(_unpacked(table)).packed(table.column("part")[0].as_py() // FAN)])

    held = cut(vectors.select("x").mapInArrow(leaf, SUMMARY))
    while (held.count()) > FAN:
        held = cut(held.groupBy(F.expr(f"part div {FAN}")).applyInArrow(group, SUMMARY))
    return _all_merged(_unpacked(held.orderBy("part").toArrow()))  # at most FAN summaries


def _matrices(column: pa.ListArray) -> list[np.ndarray]:
    """The rows of a column of lists as one matrix; all lists have to be of one length."""
    sizes = np.diff(column.offsets.to_numpy())
    if not len(sizes):
        return []
    if (sizes != sizes[0]).any():
        raise ValueError(f"vectors of {sizes.min()} and of {sizes.max()} entries")
    return [column.flatten().to_numpy().reshape(len(sizes), sizes[0])]


@dataclass
class Whitening:
    """All components of a fit: unit vectors by falling eigenvalue, with the eigenvalues and the exact mean, sums / n."""

    n: int
    sums: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    def deviations(self, x: np.ndarray) -> np.ndarray:
        """n * x - sums, exact: as 64-bit integers if they can't overflow, else as Python's."""
        bound = self.n * int(max(abs(int(x.max())), abs(int(x.min())))) + max(map(abs, self.sums))
        if bound**2 * x.shape[1] < 2**63:
            return self.n * x - np.array(self.sums, dtype=np.int64)
        return self.n * x.astype(object) - np.array(self.sums, dtype=object)

    def project(self, deviations: np.ndarray, k: int) -> np.ndarray:
        """The first ``k`` whitened entries of rows given by their deviations."""
        centred = (deviations / self.n).astype(np.float64)
        return centred @ self.components[:k].T / np.sqrt(self.eigenvalues[:k])


def fit(vectors: DataFrame) -> Whitening | None:
    """The whitening of the distinct rows ``x``, None without rows.

    Dimensions without variance have no whitening: components whose singular value is below ``NONE`` times the largest are left out. Of a
    component's two directions the one whose largest entry is positive is taken. Equal eigenvalues are numbered as the
    decomposition gives them.
    """
    total = summarise(vectors.select("x").distinct())
    if total is None:
        return None
    kept = total.values > NONE * max(total.values.max(initial=0.0), 1e-300)
    components = total.vectors[kept]
    components = components * np.sign(components[np.arange(len(components)), np.abs(components).argmax(axis=1)])[:, None]
    return Whitening(total.n, total.sums, components, total.values[kept] ** 2 / total.n, float((total.values**2).sum() / total.n))


def identity_error(vectors: DataFrame, fitted: Whitening, k: int) -> float:
    """The largest absolute entry of the whitened distinct rows' covariance minus the identity, over the first ``k`` components.

    Each task gives the sums of its whitened rows and of their products; the mean that they leave is taken out.
    """
    k = min(k, len(fitted.components))

    def run(batches):
        first, second = np.zeros(k), np.zeros((k, k))
        for batch in batches:
            for x in _matrices(batch.column("x")):
                w = fitted.project(fitted.deviations(x), k)
                first, second = first + w.sum(axis=0), second + w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k)), pa.array(np.concatenate([first, second.ravel()]))], ["at", "v"])

    rows = vectors.select("x").distinct().mapInArrow(run, "at long, v double").groupBy("at").agg(F.sum("v").alias("v")).collect()  # k * k + k rows
    sums = np.array([r.v for r in sorted(rows, key=lambda r: r.at)]) / fitted.n
    mean, products = sums[:k], sums[k:].reshape(k, k)
    return float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def whiten(embeddings: DataFrame, k: int = 4, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, component, n, deviation, whitened, explained, identity_error) for the first ``k`` components of each vector.

    Fitted on the distinct vectors floor(256 c), each once. Rows whose vector is null, empty, or holds a null or an entry that isn't finite
    are dropped; repeated rows and null ids stay. Vectors of several lengths raise a ValueError, a deviation beyond
    64 bits an OverflowError. Without variance, or without rows, there are no components and so no rows.
    """
    found = cells(embeddings, id_col, vector_col)
    schema = f"vec_id {found.schema['vec_id'].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    fitted = fit(found)
    k = min(k, len(fitted.components)) if fitted else 0
    if not k:
        return embeddings.sparkSession.createDataFrame([], schema)
    error = identity_error(found, fitted, k)
    explained = fitted.eigenvalues[:k] / fitted.trace

    def run(batches):
        for batch in batches:
            for x in _matrices(batch.column("x")):
                d = fitted.deviations(x)
                squares, w, m = (d * d).sum(axis=1), fitted.project(d, k), len(d)
                repeated = pa.array(np.repeat(np.arange(m), k))
                columns = [batch.column("vec_id").take(repeated), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, fitted.n)), pa.array(squares.tolist(), pa.int64()).take(repeated), pa.array(w.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return found.mapInArrow(run, schema)
