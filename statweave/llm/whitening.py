"""Whitened embeddings: leading eigenvectors of the covariance by block Jacobi-Davidson.

The covariance matrix is never formed. All that is asked of it are products with a few vectors
W: every task centres its block of rows, X, and adds up X'(XW); Spark sums the parts, and only
dimensions x vectors numbers reach the driver. Around these products:

* a search space U with its products VU gives Ritz pairs (Rayleigh-Ritz);
* each wanted pair that is not yet exact gets a correction from its projected equation,
  (I - QQ')(V - theta I)(I - QQ') t = -residual, where Q holds the locked vectors and all wanted
  Ritz vectors. Inner MINRES solves these equations side by side, so that one pass over the rows
  serves all of them, and U grows by the corrections;
* the largest unlocked pair is locked as soon as its residual is at the rounding level of double
  precision; later corrections and Ritz vectors stay orthogonal to it. A large U is restarted
  from its best Ritz vectors.

The fit list holds each distinct integer vector once. It is packed into blocks, written to the
shared folder (a lost executor reads its part again) and kept in memory between the passes where it fits.

Defined cases: vectors that are NULL, empty, or hold NULL, NaN or infinite entries take no part,
nor do those of another length than the most frequent one (of equally frequent ones, the longest);
a NULL id keeps its row; repeated rows are whitened each but count once in the fit; components
without variance are no components: with one distinct vector there are none, hence no rows; an
empty table gives an empty result. Entries beyond 2^63 / scale saturate; a deviation beyond 38
digits is an error. Equal eigenvalues have no unique vectors: some orthonormal ones are taken,
the same for all rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, functions as F, types as T

from statweave.llm.common import durable

COMPONENTS = 4
SCALE = 256
#: Rows of the fit list per task of a pass.
TASK_ROWS = 16_384
#: Inner MINRES: steps at most, and how much it reduces a residual.
INNER_STEPS = 12
INNER_REDUCTION = 1e-3
#: Search vectors before a restart.
SEARCH = 28
#: A residual at this share of the largest eigenvalue is rounding; above FLOOR a stall is an error.
EXACT = 2e-14
FLOOR = 1e-11
ROUNDS = 60

Product = Callable[[np.ndarray], np.ndarray]


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * entry) as array of long; NULL where the vector takes no part."""
    v = vector.cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(v.isNotNull() & (F.size(v) > 0) & fine, F.transform(v, lambda x: F.floor(x * F.lit(float(scale)))))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


class FitList:
    """The distinct vectors in blocks, and sums over them."""

    def __init__(self, vectors: DataFrame, dims: int):
        """``vectors`` has the column ``x``, an array of ``dims`` longs."""

        def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = _matrix(batch.column(0), dims)
                if len(rows):
                    small = bool(rows.max() < 2**15 and rows.min() >= -(2**15))  # a quarter of the bytes in every pass
                    raw = rows.astype(np.int16 if small else np.int64).tobytes()
                    yield pa.RecordBatch.from_pydict({"small": [small], "n": pa.array([len(rows)], pa.int64()), "rows": pa.array([raw], pa.binary())})

        self.dims = dims
        packed = durable(vectors.select("x").distinct().mapInArrow(pack, "small boolean, n long, rows binary"))
        self.n = packed.agg(F.sum("n")).first()[0] or 0
        self.blocks = packed.coalesce(max(1, -(-self.n // TASK_ROWS))).persist(StorageLevel.MEMORY_AND_DISK)
        self.sums = self._summed(lambda rows: rows.sum(axis=0), "long") if self.n else np.zeros(dims, np.int64)
        self.products = 0

    def _summed(self, part: Callable[[np.ndarray], np.ndarray], kind: str = "double") -> np.ndarray:
        """The sum of ``part`` (of a block's rows) over all blocks; one combined row per task and entry is shuffled."""
        dims = self.dims

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for small, raw in zip(batch.column("small").to_pylist(), batch.column("rows"), strict=True):
                    rows = np.frombuffer(raw.as_buffer(), np.int16 if small else np.int64).reshape(-1, dims)
                    found = part(rows.astype(np.int64)).ravel()
                    total = found if total is None else total + found
            if total is not None:
                yield pa.RecordBatch.from_pydict({"at": np.arange(len(total)), "value": total})

        parts = self.blocks.mapInArrow(run, f"at long, value {kind}")
        found = parts.groupBy("at").agg(F.sum("value").alias("value")).toPandas()
        return found.sort_values("at").value.to_numpy()

    def covariance_times(self, w: np.ndarray) -> np.ndarray:
        """V @ w, the rows centred before multiplying."""
        mean = self.sums / self.n

        def part(rows: np.ndarray) -> np.ndarray:
            centred = rows - mean
            return centred.T @ (centred @ w)

        self.products += 1
        return self._summed(part).reshape(self.dims, -1) / self.n

    def trace(self) -> float:
        mean = self.sums / self.n
        return float(self._summed(lambda rows: np.array([((rows - mean) ** 2).sum()]))[0]) / self.n


def minres(product: Product, rhs: np.ndarray, steps: int = INNER_STEPS, reduction: float = INNER_REDUCTION) -> np.ndarray:
    """Solve a symmetric system for every column of ``rhs``; ``product`` takes and returns all columns at once."""
    dot = lambda a, b: (a * b).sum(axis=0)
    over = lambda a, b: np.where(b > 0, a / np.where(b > 0, b, 1), 0)
    x, r = np.zeros_like(rhs), rhs.copy()
    start = np.sqrt(dot(rhs, rhs))
    p, s = r.copy(), product(r)
    last_p, last_s = np.zeros_like(p), np.zeros_like(s)
    for step in range(steps):
        size = dot(s, s)
        a = over(dot(r, s), size)
        x, r = x + a * p, r - a * s
        if step + 1 == steps or (np.sqrt(dot(r, r)) <= reduction * start).all():
            break
        new_p, new_s = s, product(s)
        b = over(dot(new_s, s), size)
        new_p, new_s = new_p - b * p, new_s - b * s
        c = over(dot(new_s, last_s), dot(last_s, last_s))
        last_p, last_s, p, s = p, s, new_p - c * last_p, new_s - c * last_s
    return x


def _orthonormal(t: np.ndarray, *others: np.ndarray) -> np.ndarray:
    """The columns of ``t`` made orthonormal to ``others`` and each other; what vanishes is left out."""
    kept = np.concatenate(others, axis=1)
    first = kept.shape[1]
    for column in t.T:
        size = np.linalg.norm(column)
        for _ in range(3):  # repeated, so that it holds to rounding
            column = column - kept @ (kept.T @ column)
        if np.linalg.norm(column) > 1e-12 * size > 0 and kept.shape[1] < len(t):
            column = column / np.linalg.norm(column)
            column = column - kept @ (kept.T @ column)
            kept = np.concatenate([kept, (column / np.linalg.norm(column))[:, None]], axis=1)
    return kept[:, first:]


def jacobi_davidson(product: Product, dims: int, wanted: int, exact: float = EXACT) -> tuple[np.ndarray, np.ndarray]:
    """The ``wanted`` largest eigenvalues, falling, and their unit vectors as columns."""
    wanted = min(wanted, dims)
    locked, values = np.zeros((dims, 0)), []
    none = np.zeros((dims, 0))
    u = _orthonormal(np.random.default_rng(0).normal(size=(dims, min(dims, 2 * wanted))), none)
    vu = product(u)
    least, largest, stalled = np.inf, 0.0, 0
    for _ in range(ROUNDS):
        while True:  # Rayleigh-Ritz; lock from the largest down
            theta, y = np.linalg.eigh(u.T @ vu)
            theta, y = theta[::-1], y[:, ::-1]
            u, vu = u @ y, vu @ y
            left = wanted - len(values)
            residual = vu[:, :left] - u[:, :left] * theta[:left]
            residual -= locked @ (locked.T @ residual)
            sizes = np.linalg.norm(residual, axis=0)
            largest = max(largest, theta[0], 0.0)
            whole = u.shape[1] + locked.shape[1] == dims  # the space is all there is: only rounding is left
            if not (whole or sizes[0] <= exact * largest or stalled >= 3 and sizes[0] <= FLOOR * largest):
                break
            locked, least, stalled = np.concatenate([locked, u[:, :1]], axis=1), np.inf, 0
            values.append(theta[0])
            u, vu = u[:, 1:], vu[:, 1:]
            if len(values) == wanted:
                return np.array(values), locked
        least, stalled = min(least, sizes[0]), stalled + 1 if sizes[0] > least / 2 else 0
        open_ = sizes > exact * largest
        q = np.concatenate([locked, u[:, :left]], axis=1)
        off = lambda t: t - q @ (q.T @ t)
        shift = theta[:left][open_]
        t = minres(lambda x: off(product(off(x)) - off(x) * shift), -off(residual[:, open_]))
        if u.shape[1] + t.shape[1] > SEARCH:
            keep = 2 * wanted
            u, vu = u[:, :keep], vu[:, :keep]
        new = _orthonormal(t, locked, u)
        if not new.shape[1]:  # nothing new in the corrections: any direction outside
            new = _orthonormal(np.random.default_rng(len(values) + 1).normal(size=(dims, 1)), locked, u)
        u, vu = np.concatenate([u, new], axis=1), np.concatenate([vu, product(new)], axis=1)
    raise RuntimeError(f"no convergence: residual {sizes[0]:.3g}, largest eigenvalue {largest:.3g}")


@dataclass
class Whitening:
    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    explained: np.ndarray
    identity_error: float

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum of (n x - S)^2 per row, exact."""
        # The largest possible entry decides between machine integers and Python's.
        most = self.n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(abs(int(s)) for s in self.sums)
        if most**2 * x.shape[1] < 2**63:
            return pa.array(((self.n * x - self.sums) ** 2).sum(axis=1), pa.int64()).cast(pa.decimal128(38, 0))
        wide = ((self.n * x.astype(object) - self.sums.astype(object)) ** 2).sum(axis=1)
        return pa.array([Decimal(v) for v in wide], pa.decimal128(38, 0))

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (x - self.sums / self.n) @ self.vectors / np.sqrt(self.values)


def fit(vectors: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """Fit on the distinct rows of ``x`` (arrays of ``dims`` longs)."""
    fit_list = FitList(vectors, dims)
    none = np.zeros((dims, 0))
    try:
        if fit_list.n < 2:
            return Whitening(fit_list.n, fit_list.sums, none[0], none, none[0], 0.0)
        trace = fit_list.trace()
        values, found = jacobi_davidson(fit_list.covariance_times, dims, components)
        real = values > dims * 1e-13 * values[0]
        values, found = values[real], found[:, real]
        # One more product: the covariance of the whitened fit list itself.
        scaled = found / np.sqrt(values)
        error = np.abs(scaled.T @ fit_list.covariance_times(scaled) - np.eye(len(values))).max()
        return Whitening(fit_list.n, fit_list.sums, values, found, values / trace, float(error))
    finally:
        fit_list.blocks.unpersist()


def whiten(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, vec_id: str = "vec_id",
           embedding: str = "embedding") -> DataFrame:
    """One row per remaining row and component: ``vec_id``, ``component`` (from 1), ``n``, ``deviation``
    (decimal), ``whitened``, ``explained`` and ``identity_error``."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), integers(F.col(embedding), scale).alias("x")).where("x IS NOT NULL")
    common = rows.groupBy(F.size("x").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).first()
    dims = common.dims if common else 1
    rows = rows.where(F.size("x") == dims)
    model = fit(rows, dims, components)
    kind = T.StructType([T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    @F.arrow_udf(kind)
    def placed(x: pa.Array) -> pa.Array:
        entries = _matrix(x, dims)
        return pa.StructArray.from_arrays(
            [model.deviations(entries), pa.array(list(model.whitened(entries)), pa.list_(pa.float64()))], ["deviation", "whitened"])

    shares = F.array(*[F.lit(float(v)) for v in model.explained]).cast("array<double>")
    return rows.select("vec_id", placed("x").alias("p")).select(
        "vec_id", "p.deviation", F.posexplode("p.whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
