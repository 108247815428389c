"""Whitening of embeddings by the leading eigenvectors of their covariance, found by block Jacobi-Davidson.

The covariance is never formed. All that the search asks of the vectors are products with a thin matrix, each a pass in which a
task multiplies its own centred rows; sums of tasks' products are the only thing that reaches the driver, where the
search keeps its subspace of ``dimensions x columns`` numbers.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, table

COMPONENTS = 32
#: An entry c of a vector counts as floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Residuals end below this part of the largest eigenvalue; eigenvalues below RANK of it count as zero.
RESIDUAL, RANK = 1e-13, 1e-12
#: Columns besides the wanted ones in the first block, steps of the inner solver, columns of the subspace as a multiple of the wanted ones.
SPARE, INNER, WIDEST = 8, 4, 4
#: Rounds of the search at most; rows that a task multiplies at a time; tasks that add up the products of the others.
ROUNDS, ROWS, ADDERS = 200, 4096, 16
LARGEST = 2.0**63


@dataclass
class Whitening:
    """What has been fitted: n vectors with sums S, unit eigenvectors in columns, their eigenvalues, the trace, the residuals."""

    n: int
    sums: np.ndarray
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    residuals: np.ndarray
    passes: int
    identity_error: float = 0.0

    def directions(self) -> np.ndarray:
        """Eigenvectors over the roots of their eigenvalues; NaN for those without variance."""
        good = self.values > RANK * max(self.values.max(initial=0.0), 0.0)
        return np.where(good, self.vectors / np.sqrt(np.where(good, self.values, 1.0)), np.nan)


def whole_numbers(vectors: DataFrame, id_col: str, vector_col: str) -> tuple[DataFrame, int]:
    """(id, x) of the usable vectors, and their number of dimensions.

    Vectors that are null or hold null or non-finite entries go. The dimensions are those of most of the rest (of more, if
    equal); shorter vectors lack entries, which are null then, and longer ones have entries without a dimension: both go.
    """
    entry = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    usable = F.forall("x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    found = vectors.select(F.col(id_col).alias("id"), entry.alias("x")).where("x IS NOT NULL").where(usable)
    sizes = found.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    d = sizes[0]["d"] if sizes else 0
    scaled = lambda c: F.when(F.abs(c) < 2.0**50, F.floor(c * SCALE) + F.lit(SHIFT)).otherwise(F.raise_error(F.lit("an entry is too large to be counted in whole numbers")).cast("long"))
    return checkpoint(found.where(F.size("x") == d).select("id", F.transform("x", scaled).alias("x"))), d


def _rows(batch: pa.RecordBatch, d: int, n: int, sums: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, n * x - S) for runs of rows of a batch, in whole numbers."""
    for at in range(0, batch.num_rows, ROWS):
        x = batch.column("x").slice(at, ROWS).flatten().to_numpy().reshape(-1, d)
        if float(np.abs(x).max(initial=0)) * n + float(np.abs(sums).max(initial=0)) >= LARGEST:
            raise OverflowError("n times an entry does not fit in a long")
        yield at, n * x - sums


def summed(rows: DataFrame, work: Callable[[pa.RecordBatch], Iterator[np.ndarray]], shape: tuple[int, int]) -> np.ndarray:
    """The sum of the matrices that work gives for all batches: a task adds up its own, a few tasks those of the others."""

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype=np.longdouble)
        for batch in batches:
            for m in work(batch):
                total += m
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(float).tobytes()], pa.binary())], names=["m"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, dtype=np.longdouble)
        for batch in batches:
            for m in batch.column(0):
                total += np.frombuffer(m.as_py()).reshape(shape)
        yield pa.RecordBatch.from_arrays([pa.array([total.astype(float).tobytes()], pa.binary())], names=["m"])

    found = rows.mapInArrow(own, "m binary").repartition(ADDERS).mapInArrow(add, "m binary").collect()
    return np.sum([np.frombuffer(bytes(r.m)).reshape(shape).astype(np.longdouble) for r in found], axis=0).astype(float)


def minres(apply: Callable[[np.ndarray], np.ndarray], right: np.ndarray, steps: int) -> np.ndarray:
    """Minimal-residual solutions x of apply(x) = right after some steps, each column by itself, one product a step."""
    dots = lambda a, b: np.einsum("ij,ij->j", a, b)
    over = lambda a, b: np.divide(a, b, out=np.zeros_like(a), where=b > 0)
    x, r = np.zeros_like(right), right.copy()
    p, s = [r.copy()], [apply(r)]
    for _ in range(steps):
        norm = dots(s[-1], s[-1])
        a = over(dots(r, s[-1]), norm)
        x, r = x + a * p[-1], r - a * s[-1]
        if len(s) > steps:
            break
        q, t = s[-1], apply(s[-1])
        for p_old, s_old in list(zip(p, s))[-2:]:
            b = over(dots(t, s_old), dots(s_old, s_old))
            q, t = q - b * p_old, t - b * s_old
        p.append(q)
        s.append(t)
    return x


def orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """Unit columns that span what block adds to the orthonormal columns of against."""
    for _ in range(3):
        block = block - against @ (against.T @ block)
        norms = np.linalg.norm(block, axis=0)
        block = block[:, norms > 0] / norms[norms > 0]
        if not block.size:
            return block
        u, s, _ = np.linalg.svd(block, full_matrices=False)
        block = u[:, s > 1e-8 * s[0]]
    return block[:, : len(block) - against.shape[1]]


def leading(product: Callable[[np.ndarray], np.ndarray], d: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(vectors, values, residuals) of the k largest eigenvalues of a symmetric positive operator of d dimensions.

    Block Jacobi-Davidson: Rayleigh-Ritz in the subspace; pairs whose residual has reached double precision are locked
    from the largest on; for the others the projected correction equation is solved by a few steps of MINRES, all
    columns in one product a step, and the corrections widen the subspace, which restarts from its best columns.
    """
    rng = np.random.default_rng(12)
    locked = np.zeros((d, 0))
    basis = orthonormal(rng.standard_normal((d, min(d, k + SPARE))), locked)
    images = product(basis)
    largest = 0.0
    for _ in range(ROUNDS):
        small = basis.T @ images
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        ritz, images = basis @ turn, images @ turn
        largest = max(largest, values[0] if len(values) else 0.0)
        gap = images - ritz * values
        gap -= locked @ (locked.T @ gap)
        norms = np.linalg.norm(gap, axis=0)
        wanted = min(k - locked.shape[1], len(values))
        full = locked.shape[1] + basis.shape[1] == d
        done = wanted if full else next((i for i in range(wanted) if norms[i] > RESIDUAL * largest), wanted)
        if done == wanted and locked.shape[1] + wanted == k:
            locked = np.hstack((locked, ritz[:, :wanted]))
            break
        todo = slice(done, wanted)
        locked, near = np.hstack((locked, ritz[:, :done])), ritz[:, todo]
        theta, right = values[todo], -gap[:, todo]
        outside = np.hstack((locked, near))

        def project(m: np.ndarray) -> np.ndarray:
            return m - outside @ (outside.T @ m)

        def corrected(m: np.ndarray) -> np.ndarray:
            m = project(m)
            return project(product(m) - m * theta)

        more = minres(corrected, project(right), INNER)
        keep = ritz.shape[1] if ritz.shape[1] + near.shape[1] <= WIDEST * k + SPARE else wanted + SPARE
        basis, images = ritz[:, done:keep], images[:, done:keep]
        more = orthonormal(more, np.hstack((locked, basis)))
        if not more.shape[1]:
            more = orthonormal(rng.standard_normal((d, near.shape[1])), np.hstack((locked, basis)))
        basis, images = np.hstack((basis, more)), np.hstack((images, product(more)))
    else:
        raise ArithmeticError("the eigenvectors have not reached double precision")
    images = product(locked)
    values, turn = np.linalg.eigh(locked.T @ images)
    values, turn = values[::-1], turn[:, ::-1]
    vectors = locked @ turn
    residuals = np.linalg.norm(images @ turn - vectors * values, axis=0)
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])])
    return vectors * signs, np.maximum(values, 0.0), residuals


def fit(rows: DataFrame, d: int, components: int = COMPONENTS) -> Whitening:
    """Fit on all rows (id, x) of d whole numbers; sums are exact, everything else is centred before it is multiplied."""
    found = rows.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()
    n, sums = (found[0]["n"] if found else 0), np.zeros(d, dtype=np.int64)
    for r in found:
        sums[r["at"]] = r["s"]
    passes = 0

    def product(m: np.ndarray) -> np.ndarray:
        nonlocal passes
        passes += 1

        def work(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
            for _, x in _rows(batch, d, n, sums):
                y = x / n
                yield y.T @ (y @ m)

        return summed(rows, work, m.shape) / n

    k = min(components, d)
    if not n or not k:
        return Whitening(n, sums, np.zeros((d, k)), np.zeros(k), 0.0, np.zeros(k), 0)

    def squares(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, x in _rows(batch, d, n, sums):
            yield np.square(x / n).sum(axis=0, keepdims=True)

    trace = float(summed(rows, squares, (1, d)).sum()) / n
    if not trace:
        return Whitening(n, sums, np.eye(d, k), np.zeros(k), 0.0, np.zeros(k), 0)
    vectors, values, residuals = leading(product, d, k)
    fitted = Whitening(n, sums, vectors, values, trace, residuals, passes)
    directions = fitted.directions()
    good = ~np.isnan(directions[0])
    use = np.ascontiguousarray(directions[:, good])

    def spread(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for _, x in _rows(batch, d, n, sums):
            w = (x / n) @ use
            yield w.T @ w

    covariance = summed(rows, spread, (use.shape[1], use.shape[1])) / n
    fitted.identity_error = float(np.abs(covariance - np.eye(use.shape[1])).max())
    return fitted


def transform(rows: DataFrame, fitted: Whitening) -> DataFrame:
    """(id, deviation, whitened array) of rows (id, x); null where a component has no variance."""
    n, sums, d = fitted.n, fitted.sums, len(fitted.sums)
    directions = fitted.directions()
    k = directions.shape[1]
    bare = np.isnan(directions[0]) if d else np.zeros(0, dtype=bool)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _rows(batch, d, n, sums):
                if float(np.abs(x).max(initial=0)) ** 2 * d >= LARGEST:
                    raise OverflowError("a deviation does not fit in a long")
                white = (x / n) @ np.nan_to_num(directions)
                flat = pa.array(white.ravel(), mask=np.broadcast_to(bare, white.shape).ravel())
                lists = pa.ListArray.from_arrays(np.arange(0, len(flat) + 1, k, dtype=np.int32), flat)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(at, len(x)), pa.array(np.square(x).sum(axis=1)), lists], names=["id", "deviation", "whitened"])

    return rows.mapInArrow(work, f"id {dict(rows.dtypes)['id']}, deviation long, whitened array<double>")


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """A row per usable vector and component: its id, component, n, deviation, whitened, explained, identity_error.

    Unusable vectors (see ``whole_numbers``) have no rows; vectors that repeat an id, or whole rows, count one by one and null
    ids are ids. There are as many components as dimensions at most. A component without variance (all vectors equal, or
    fewer vectors than dimensions) has a null whitened value, an explained share of 0 and no part in identity_error. An
    empty table gives no rows. Other columns are not read.
    """
    rows, d = whole_numbers(vectors, id_col, vector_col)
    fitted = fit(rows, d, components)
    shares = F.array(*[F.lit(float(v / fitted.trace) if fitted.trace else 0.0) for v in fitted.values]).cast("array<double>")
    if not fitted.n or not d:
        rows, white = rows.limit(0), rows.limit(0).select("id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    else:
        white = transform(rows, fitted)
    return white.select("id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        F.col("id").alias(id_col),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(fitted.n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(shares, F.col("at")).alias("explained"),
        F.lit(fitted.identity_error).alias("identity_error"),
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))
