"""Whitening of embeddings by Golub-Kahan-Lanczos bidiagonalisation.

Entries become integers x = floor(64 c) + 1,000,000, so counts, sums and deviations are exact. With
X the rows x - S/n (n rows, S their sums), the method builds orthonormal v_1, v_2, ... (one entry a
dimension) and u_1, u_2, ... (one entry a row) with X v_k = beta_{k-1} u_{k-1} + alpha_k u_k and
X^T u_k = alpha_k v_k + beta_k v_{k+1}, by alternating distributed products, both sides fully
reorthogonalised. The SVD of the small bidiagonal matrix (alpha, beta) gives the singular values of
X and, through v_1, v_2, ..., its right singular vectors: the components.

No vector with one entry a row is ever stored or collected. As u_k is a combination of products
X v_j, it is kept as the short vector w_k with u_k = X w_k; a task recomputes its part of u from its
rows. A pass sends out a few short vectors and gets back, from each task, sums of (dimensions +
steps) numbers; a lost task is redone alone. When a product vanishes (fewer independent
directions than dimensions, or equal singular values), the recurrence goes on from a new vector
orthogonal to all before it, so repeated eigenvalues are found too.

Cost: two passes a step and at most as many steps as dimensions (it stops earlier once twice the
wanted components are built and the wanted ones have converged). Rows are packed once into blocks of
integers, checkpointed, and kept centred in Spark's storage during the passes.

Defined cases: rows whose vector is null, holds a null or non-finite entry, or has another length
than most, take no part and give no rows; null and repeated ids are rows like any other; a component
without variance (the rows of an empty table, of one row, of equal rows) gives no rows; other columns
are left out. Entries too large for exact sums (64 n times the largest reaches 2^62) or a
deviation beyond a long are an OverflowError.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from ..session import cut_lineage
from ..sources.tables import read_table
from .common import tidy
from .vectors import matrix, usable_vectors

SCALE, SHIFT = 64, 1_000_000
PASS_BYTES = 64 << 20  # of rows a task reads in a pass
EPS = np.finfo(np.float64).eps


@dataclass
class Whitening:
    """What was learned: n rows with sums S; components (a column each) with eigenvalues falling."""
    dim: int
    n: int
    sums: np.ndarray
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float
    identity_error: float


def integer_blocks(rows: DataFrame, dim: int) -> DataFrame:
    """(ids, x): blocks of rows as little-endian longs, one block an Arrow batch."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                c = np.floor(SCALE * matrix(batch.column(1), dim)) + SHIFT
                if np.abs(c).max() > 2.0 ** 53:
                    raise OverflowError("an entry is too large to be scaled exactly")
                ids = pa.ListArray.from_arrays(pa.array([0, batch.num_rows], pa.int32()), batch.column(0))
                yield pa.RecordBatch.from_arrays([ids, pa.array([c.astype("<i8").tobytes()], pa.binary())], names=["ids", "x"])

    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(tidy(run), f"ids array<{id_type}>, x binary")


def _sums(blocks: DataFrame, part, *more: str) -> list[np.ndarray]:
    """The sums, over all blocks, of the arrays that `part(x)` gives for a block's bytes; `more`
    names their types. Every task adds its own up and sends one row."""
    def run(batches):
        total = None
        for batch in batches:
            for x in batch.column(batch.schema.get_field_index("x")):
                got = part(x.as_buffer())
                total = got if total is None else [a + b for a, b in zip(total, got)]
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([np.atleast_1d(t).astype(k).tobytes()], pa.binary()) for t, k in zip(total, more)],
                                             names=[f"s{i}" for i in range(len(more))])

    rows = blocks.mapInArrow(tidy(run), ", ".join(f"s{i} binary" for i in range(len(more)))).collect()  # a short row a task
    return [np.sum([np.frombuffer(r[i], k) for r in rows], axis=0) for i, k in enumerate(more)] if rows else []


class Bidiagonalisation:
    """The recurrence over a frame of centred blocks (doubles)."""

    def __init__(self, centred: DataFrame, dim: int, seed: int = 17):
        self.centred, self.dim = centred, dim
        self.rng = np.random.default_rng(seed)
        self.V, self.W = np.zeros((dim, 0)), np.zeros((dim, 0))
        self.alpha: list[float] = []
        self.beta: list[float] = []

    def _fresh(self) -> np.ndarray | None:
        """A unit vector orthogonal to all of V, or None if V is full."""
        if self.V.shape[1] == self.dim:
            return None
        v = self.rng.standard_normal(self.dim)
        for _ in range(3):
            v -= self.V @ (self.V.T @ v)
            v /= np.linalg.norm(v)
        return v

    def _project(self, v: np.ndarray) -> tuple[np.ndarray, float]:
        """U^T X v and |X v|^2."""
        dim, W = self.dim, self.W

        def part(x):
            X = np.frombuffer(x, "<f8").reshape(-1, dim)
            p = X @ v
            return [(X @ W).T @ p, p @ p]

        dots, square = _sums(self.centred, part, "<f8", "<f8")
        return dots, float(square[0])

    def _back(self, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """With u = X w: |u|^2, X^T u and U^T u."""
        dim, W = self.dim, self.W

        def part(x):
            X = np.frombuffer(x, "<f8").reshape(-1, dim)
            u = X @ w
            return [u @ u, X.T @ u, (X @ W).T @ u]

        square, z, dots = _sums(self.centred, part, "<f8", "<f8", "<f8")
        return float(square[0]), z, dots

    def step(self, v: np.ndarray) -> np.ndarray | None:
        """One more column of both sides, from the unit vector v; the next vector, or None at the end."""
        before, square = self._project(v)
        w = v - self.W @ before
        for _ in range(3):  # reorthogonalise until nothing of the earlier ones is left
            norm2, z, dots = self._back(w)
            if np.linalg.norm(dots) <= 8 * EPS * np.sqrt(max(norm2, 0)):
                break
            w = w - self.W @ dots
        largest = max([np.sqrt(square), *self.alpha, *self.beta])
        alpha = np.sqrt(norm2)
        if alpha <= 4 * EPS * self.dim * largest:  # X v lies in the span of the earlier ones
            alpha, w, z = 0.0, np.zeros(self.dim), np.zeros(self.dim)
        else:
            w, z = w / alpha, z / alpha
        self.V, self.W = np.column_stack([self.V, v]), np.column_stack([self.W, w])
        self.alpha.append(alpha)
        r = z - self.V @ (self.V.T @ z)
        r -= self.V @ (self.V.T @ r)
        beta = float(np.linalg.norm(r))
        if beta <= 4 * EPS * self.dim * largest or self.V.shape[1] == self.dim:
            self.beta.append(0.0)
            return self._fresh()
        self.beta.append(beta)
        r /= beta
        r -= self.V @ (self.V.T @ r)
        return r / np.linalg.norm(r)

    def small_svd(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        k = len(self.alpha)
        B = np.diag(self.alpha) + np.diag(self.beta[:k - 1], 1)
        left, sigma, right = np.linalg.svd(B)
        return left, sigma, right

    def run(self, wanted: int) -> tuple[np.ndarray, np.ndarray]:
        """(right singular vectors by columns, singular values), falling."""
        v = self._fresh()
        while v is not None:
            v = self.step(v)
            k = len(self.alpha)
            if v is not None and k >= 2 * wanted and k % 8 == 0:
                left, sigma, _ = self.small_svd()
                if self.beta[-1] > 0 and np.all(self.beta[-1] * np.abs(left[-1, :wanted]) <= 4 * EPS * sigma[0]):
                    break
        _, sigma, right = self.small_svd()
        return self.V @ right.T, sigma


def fit(blocks: DataFrame, dim: int, most: int = 32) -> Whitening | None:
    """Learns at most `most` components from all rows of `blocks`; None without rows."""
    def count(x):
        X = np.frombuffer(x, "<i8").reshape(-1, dim)
        return [len(X), X.sum(axis=0)]

    got = _sums(blocks, count, "<i8", "<i8")
    if not got:
        return None
    n, S = int(got[0][0]), got[1]

    def centre(batches):
        for batch in batches:
            for x in batch.column(1):
                X = np.frombuffer(x.as_buffer(), "<i8").reshape(-1, dim)
                if float(np.abs(X).max()) * n >= 2.0 ** 62:
                    raise OverflowError("entries are too large for exact sums")
                yield pa.RecordBatch.from_arrays([pa.array([((n * X - S) / n).astype("<f8").tobytes()], pa.binary())], names=["x"])

    sc = blocks.sparkSession.sparkContext
    tasks = max(sc.defaultParallelism, n * dim * 8 // PASS_BYTES + 1)
    centred = blocks.coalesce(tasks).mapInArrow(tidy(centre), "x binary").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        components, sigma = Bidiagonalisation(centred, dim).run(most)
        trace = float(_sums(centred, lambda x: [np.square(np.frombuffer(x, "<f8")).sum()], "<f8")[0][0]) / n
        real = (sigma > 32 * EPS * dim * sigma[0]) & (np.arange(len(sigma)) < most)
        components, eigenvalues = components[:, real], sigma[real] ** 2 / n
        error = _identity_error(centred, dim, n, components / np.sqrt(eigenvalues)) if real.any() else 0.0
    finally:
        centred.unpersist()
    return Whitening(dim, n, S, components, eigenvalues, trace, error)


def _identity_error(centred: DataFrame, dim: int, n: int, project: np.ndarray) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity."""
    mean = _sums(centred, lambda x: [(np.frombuffer(x, "<f8").reshape(-1, dim) @ project).sum(axis=0)], "<f8")[0] / n

    def part(x):
        y = np.frombuffer(x, "<f8").reshape(-1, dim) @ project - mean
        return [(y.T @ y).ravel()]

    cov = _sums(centred, part, "<f8")[0].reshape(project.shape[1], -1) / n
    return float(np.abs(cov - np.eye(len(cov))).max())


def whiten(table: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", components: int = 32) -> DataFrame:
    """One row per vector and component: id, component (from 1), n, deviation, whitened, explained,
    identity_error."""
    rows, dim = usable_vectors(table, id_col, vec_col)
    id_type = rows.schema["id"].dataType.simpleString()
    schema = (f"`{id_col}` {id_type}, component int, n bigint, deviation bigint, whitened double, explained double, "
              "identity_error double")
    blocks = cut_lineage(integer_blocks(rows, dim)) if dim else None
    model = fit(blocks, dim, components) if dim else None
    if model is None or not len(model.eigenvalues):
        return table.sparkSession.createDataFrame([], schema)
    n, S, error = model.n, model.sums, model.identity_error
    project = model.components / np.sqrt(model.eigenvalues)
    explained = model.eigenvalues / model.trace
    m = len(explained)

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                ids = batch.column(0)[at].values
                X = np.frombuffer(batch.column(1)[at].as_buffer(), "<i8").reshape(-1, dim)
                for start in range(0, len(X), 1024):
                    D = n * X[start:start + 1024] - S
                    if float(np.abs(D).max()) ** 2 * dim >= 2.0 ** 63:
                        raise OverflowError("a deviation is beyond a long")
                    k = len(D)
                    each = np.repeat(np.arange(start, start + k), m)
                    yield pa.RecordBatch.from_arrays([
                        ids.take(pa.array(each)), pa.array(np.tile(np.arange(1, m + 1, dtype=np.int32), k)),
                        pa.array(np.full(k * m, n)), pa.array(np.repeat((D * D).sum(axis=1), m)),
                        pa.array(((D / n) @ project).ravel()), pa.array(np.tile(explained, k)), pa.array(np.full(k * m, error))],
                        names=[id_col, "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return blocks.mapInArrow(tidy(run), schema)


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(read_table(spark, sf_dir, "embeddings"))
