"""Whitening of embeddings by shifted CholeskyQR.

Vectors are taken on a grid: entry c becomes the long x = floor(64 c) + 1,000,000, and a row is centred exactly, as the
integer n x - S (S: sums over all rows) divided by n once. The centred rows form a tall matrix A that only tasks see.

1. Each pass solves the rows against the triangular factors found so far and sums the Gram matrix of the result by task;
   the sums meet in a few tasks, in a fixed order, and one small matrix reaches the driver.
2. The driver shifts the Gram matrix by 11 (rows d + d (d + 1)) u times its norm (LARGEST_SHIFT at first), so that it has a Cholesky factor
   however ill-conditioned A is, and adds the factor to the list. Later passes orthogonalise what the shift has left.
   Directions without variance stay near zero in every pass, and all others come to have unit length; then the passes end.
3. A^T A = R^T G R holds for the product R of the factors and the last Gram matrix G, whatever was shifted. The singular
   values and right vectors of G^(1/2) R are those of A, without ever squaring A's condition: the components, with the
   variance e = sigma^2 / n. Whitened rows are a w sqrt(n) / sigma.

A last pass measures the covariance of the whitened rows. The driver and the broadcasts hold a few d x d matrices (d at
most MAX_DIMENSIONS, checked); rows stay in the tasks.

Results at the edges: rows whose vector is null, holds null, NaN or infinite entries, or entries whose x does not fit in
62 bits, are left out, as are vectors of another length than most (of equally frequent lengths the shorter is kept);
components without variance (relative to the first, below the precision of doubles) are left out, so that one row, equal
rows, vectors without entries and empty tables have no component and give no rows; repeated rows and null ids are
kept; of equal variances the order is open; ``deviation`` is null where it does not fit in a long; other columns are
ignored unless carried, and carried ones named like an output are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from .common import Shipped

GRID, OFFSET = 64, 1_000_000
COMPONENTS = 32
MAX_DIMENSIONS = 2048
PASSES = 12
MERGERS = 16  # tasks that add up the tasks' sums
ROWS = 4096  # rows that a task solves at a time
UNIT = np.finfo(np.float64).eps / 2
LARGEST = 2.0 ** 62
LARGEST_SHIFT = 1e-6  # of the Gram matrix's norm; a matrix that needs more gets more


def grid(column: pa.ListArray, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows are kept, and the grid values of those."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = pa.compute.fill_null(pa.compute.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    right = np.flatnonzero(sizes == d)
    if not len(right) or not d:
        return right[:0], np.zeros((0, d), np.int64)
    flat = column.take(pa.array(right)).flatten()
    holes = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, d)
    with np.errstate(all="ignore"):
        wide = np.floor(GRID * pa.compute.fill_null(flat.cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)).reshape(-1, d)
        good = ~holes.any(1) & (np.abs(wide) < LARGEST).all(1)
    return right[good], wide[good].astype(np.int64) + OFFSET


def solve_rows(rows: np.ndarray, upper: np.ndarray) -> np.ndarray:
    """``rows`` times the inverse of an upper triangular matrix, by forward substitution over all rows at once."""
    out = np.empty_like(rows)
    for j in range(rows.shape[1]):
        out[:, j] = (rows[:, j] - out[:, :j] @ upper[:j, j]) / upper[j, j]
    return out


@dataclass
class Whitening:
    """What the fit list gives: ``n`` rows of ``d`` dimensions with sums ``sums``; components as columns, by falling
    variance; ``explained`` shares; ``identity_error`` of the whitened rows' covariance."""

    n: int
    d: int
    sums: list[int]
    factors: list[np.ndarray] = field(default_factory=list)
    components: np.ndarray | None = None
    variances: np.ndarray | None = None
    explained: np.ndarray | None = None
    identity_error: float = 0.0

    def numerators(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: longs where they fit, else Python's integers."""
        peak = int(np.abs(x).max(initial=0)) * self.n + max(map(abs, self.sums), default=0)
        if peak < LARGEST:
            return x * self.n - np.array(self.sums, np.int64)
        return x.astype(object) * self.n - np.array(self.sums, object)

    def centred(self, numerators: np.ndarray) -> np.ndarray:
        return (numerators / self.n).astype(np.float64)

    def deviations(self, numerators: np.ndarray) -> list[int | None]:
        """Sum of squares of each row's numerators, exact."""
        peak = max(abs(int(numerators.max(initial=0))), abs(int(numerators.min(initial=0))))
        wide = numerators if peak * peak * max(self.d, 1) < LARGEST else numerators.astype(object)
        return [int(v) if v < 1 << 63 else None for v in (wide * wide).sum(1)]

    def orthogonal(self, numerators: np.ndarray) -> np.ndarray:
        rows = self.centred(numerators)
        for upper in self.factors:
            rows = solve_rows(rows, upper)
        return rows

    def whitened(self, numerators: np.ndarray) -> np.ndarray:
        return (self.centred(numerators) @ self.components) / np.sqrt(self.variances)


def _column_sums(x: np.ndarray) -> list[int]:
    high, low = x >> 32, x & 0xFFFFFFFF
    return [(int(h) << 32) + int(l) for h, l in zip(high.sum(0), low.sum(0))]


def _gathered(df: DataFrame, column: str, d: int, width: int, make) -> np.ndarray:
    """The sum over all rows of matrices that ``make`` gives for runs of grid values: summed by task, then by MERGERS
    tasks in the order of the first ones, then on the driver."""
    schema = StructType([StructField("part", LongType(), False), StructField("sums", ArrayType(DoubleType()), False)])

    def row(part: int, total: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([total.ravel()], pa.list_(pa.float64()))],
                                          names=["part", "sums"])

    def by_task(batches: Iterator[pa.RecordBatch]):
        total = np.zeros((width, d))
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                _, x = grid(batch.column(0).slice(a, ROWS), d)
                if len(x):
                    total += make(x)
        yield row(TaskContext.get().partitionId(), total)

    def merged(batches: Iterator[pa.RecordBatch]):
        total, first = np.zeros(width * d), None
        for batch in batches:
            for part, sums in zip(batch.column(0).to_pylist(), batch.column(1)):
                total, first = total + sums.values.to_numpy(), part if first is None else first
        if first is not None:
            yield row(first, total)

    found = df.select(column).mapInArrow(by_task, schema).repartition(MERGERS, F.col("part") % MERGERS) \
        .sortWithinPartitions("part").mapInArrow(merged, schema).toArrow().sort_by("part")
    return sum((s.values.to_numpy() for s in found.column("sums").combine_chunks()), np.zeros(width * d)).reshape(width, d)


def _sums(df: DataFrame, column: str, d: int) -> tuple[int, list[int]]:
    """Kept rows and their exact sums: added as decimals, by Spark."""
    schema = "at int, high long, low long"

    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                _, x = grid(batch.column(0).slice(a, ROWS), d)
                sums = [len(x), *_column_sums(x)]
                yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array([v >> 32 for v in sums], pa.int64()),
                                                  pa.array([v & 0xFFFFFFFF for v in sums], pa.int64())], names=["at", "high", "low"])

    rows = df.select(column).mapInArrow(run, schema).groupBy("at").agg(
        *[F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]).collect()  # one row a dimension
    by = {r["at"]: (int(r["high"]) << 32) + int(r["low"]) for r in rows}
    return by.get(0, 0), [by.get(k + 1, 0) for k in range(d)]


def fit_whitening(spark: SparkSession, df: DataFrame, column: str = "embedding", components: int = COMPONENTS) -> Whitening:
    lengths = df.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = lengths["d"] if lengths else 0
    if d > MAX_DIMENSIONS:
        raise ValueError(f"{d} dimensions are more than {MAX_DIMENSIONS}")
    n, sums = _sums(df, column, d)
    model = Whitening(n, d, sums)
    if n < 2 or not d:
        return _finished(model, np.zeros((0, 0)), 0)

    shown = 1.0
    for _ in range(PASSES):
        shipped = Shipped(spark, model, 1 << 30)

        def gram(x, shipped=shipped):
            own = shipped.get()
            q = own.orthogonal(own.numerators(x))
            return q.T @ q

        total = _gathered(df, column, d, d, gram)
        values = np.linalg.eigvalsh(total)
        # a direction is without variance if it stays at zero although the shifts so far would have shown any
        settled = (np.abs(values - 1) < 1e-6) | (values < 1e-13) & (shown < 1e-30)
        if not values[-1] > 0 or model.factors and settled.all():
            break
        share = min(11 * (n * d + d * (d + 1)) * UNIT, LARGEST_SHIFT)
        upper = None
        while upper is None:
            try:
                upper = np.linalg.cholesky(total + share * values[-1] * np.eye(d)).T
            except np.linalg.LinAlgError:
                share *= 100
        shown *= share
        model.factors.append(upper)
    values, turn = np.linalg.eigh(total)
    whole = np.sqrt(np.maximum(values, 0))[:, None] * turn.T  # its own product with itself is the last Gram matrix
    for upper in reversed(model.factors):
        whole = whole @ upper
    model = _finished(model, whole, components)
    if not len(model.variances):
        return model
    k, shipped = len(model.variances), Shipped(spark, model, 1 << 30)

    def moments(x):
        own = shipped.get()
        w = own.whitened(own.numerators(x))
        return np.vstack([w.sum(0), w.T @ w])

    found = _gathered_square(df, column, d, k, moments)
    mean, second = found[0] / n, found[1:] / n
    model.identity_error = float(np.abs(second - np.outer(mean, mean) - np.eye(k)).max())
    return model


def _gathered_square(df: DataFrame, column: str, d: int, k: int, make) -> np.ndarray:
    """Like ``_gathered`` for matrices of k + 1 rows and k columns, laid out in rows of d numbers."""
    size = (k + 1) * k
    height = -(-size // d)

    def padded(x):
        return np.concatenate([make(x).ravel(), np.zeros(height * d - size)]).reshape(height, d)
    return _gathered(df, column, d, height, padded).ravel()[:size].reshape(k + 1, k)


def _finished(model: Whitening, whole: np.ndarray, components: int) -> Whitening:
    """Components of the rows' covariance from a small matrix with the same singular values and right vectors."""
    if not whole.size:
        model.components, model.variances, model.explained = np.zeros((model.d, 0)), np.zeros(0), np.zeros(0)
        return model
    _, sigma, right = np.linalg.svd(whole)
    kept = min(int((sigma > max(whole.shape) * 8 * UNIT * sigma[0]).sum()) if sigma[0] > 0 else 0, components)
    top = right[:kept].T
    model.components = top * np.sign(top[np.abs(top).argmax(0), np.arange(kept)])
    model.variances = sigma[:kept] ** 2 / model.n
    model.explained = sigma[:kept] ** 2 / (sigma ** 2).sum()
    return model


def whiten(spark: SparkSession, df: DataFrame, model: Whitening, column: str = "embedding",
           carry: Sequence[str] | None = None) -> DataFrame:
    """``carry`` columns (default: all but the vector), ``deviation`` (long) and ``whitened`` (a double a component) of
    every row that the fit list holds."""
    made = ("deviation", "whitened")
    names = [c for c in (df.columns if carry is None else carry) if c.lower() not in made and c != column]
    schema = StructType([df.schema[c] for c in names] + [StructField("deviation", LongType()),
                                                         StructField("whitened", ArrayType(DoubleType(), False))])
    shipped = Shipped(spark, model, 1 << 30)

    def run(batches):
        own = shipped.get()
        for batch in batches:
            for a in range(0, batch.num_rows, ROWS):
                part = batch.slice(a, ROWS)
                kept, x = grid(part.column(len(names)), own.d)
                if not len(kept):
                    continue
                exact = own.numerators(x)
                rows = own.whitened(exact)
                ends = pa.array(np.arange(len(rows) + 1) * rows.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    part.take(pa.array(kept)).columns[:-1] + [pa.array(own.deviations(exact), pa.int64()),
                                                              pa.ListArray.from_arrays(ends, pa.array(rows.ravel(), pa.float64()))],
                    names=schema.names)

    return df.select(*names, column).mapInArrow(run, schema)


def component_rows(whitened: DataFrame, model: Whitening) -> DataFrame:
    """A row for each component of each row of ``whiten``: ``component`` (from 1), ``whitened, n, explained``."""
    shares = F.array(*[F.lit(float(e)) for e in model.explained]).cast("array<double>")
    names = [c for c in whitened.columns if c != "whitened"]
    return whitened.select(*names, F.posexplode("whitened").alias("at", "whitened")).select(
        *names, (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).cast("double").alias("identity_error"))
