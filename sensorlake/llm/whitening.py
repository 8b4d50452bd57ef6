"""Embedding whitening; principal components by QDWH spectral divide and conquer.

Vectors are put on an integer grid, so their sums and products are exact and do not depend on how
Spark deals the rows. Every task adds up a matrix of centred products of its distinct vectors and
emits it by cells, which Spark sums; only the covariance, which is as large as the square of a
vector's length whatever the number of rows, reaches the driver.

There the symmetric covariance is divided: the polar factor of ``A - shift * I``, found by dynamically
weighted Halley iterations (QR decompositions only), has eigenvalue 1 on the invariant subspace above
the shift and -1 below it, so half of it plus the identity is the spectral projector. Orthonormal bases
of the projector's range and of its complement cut ``A`` into two smaller blocks, which are divided
again, the upper one first, until as many components as are wanted stand alone. The few components
then go to all tasks, which project every vector.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from sensorlake.session import materialise

EPS = float(np.finfo(float).eps)
#: Cells are shipped as ``high * 2 ** LIMB + low``, each part summed by Spark.
LIMB = 48
#: Integer products of this size or more are no longer exact in a double.
EXACT = 1 << 53


# Spectral divide and conquer


def polar_factor(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix, by QR-based Halley iterations whose weights
    follow a lower bound of the smallest singular value. The bound starts at rounding level, which
    holds for any matrix that is not singular to working precision and costs seven steps at most."""
    d = len(a)
    x = a / min(np.linalg.norm(a), np.abs(a).sum(axis=0).max())
    low, identity = EPS / 2, np.eye(d)
    for _ in range(12):
        square = low * low
        root = np.sqrt(1 + np.cbrt(4 * (1 - square) / (square * square)))
        p = root + np.sqrt(max(0.0, 8 - 4 * (root * root - 1) + 8 * (2 - square) / (square * root))) / 2
        q = (p - 1) ** 2 / 4
        r = p + q - 1
        ortho, _ = np.linalg.qr(np.vstack([np.sqrt(r) * x, identity]))
        moved = q / r * x + (p - q / r) / np.sqrt(r) * (ortho[:d] @ ortho[d:].T)
        moved = (moved + moved.T) / 2
        done = abs(low - 1) < 10 * EPS and np.linalg.norm(moved - x) < np.cbrt(EPS)
        x, low = moved, min(1.0, low * (p + q * square) / (1 + r * square))
        if done:
            break
    return x


def divide(a: np.ndarray, size: float) -> tuple[np.ndarray, np.ndarray] | None:
    """Orthonormal bases of the invariant subspaces of ``a`` above and below a shift.

    ``size`` scales what counts as rounding. The shift is a value between the extreme diagonal
    entries, hence inside the spectrum; one that hits an eigenvalue leaves a remainder between the
    subspaces, then the next is tried. The best division found is returned.
    """
    d = len(a)
    diagonal = np.sort(np.diag(a))
    middle, mean = float(np.median(diagonal)), float(diagonal.mean())
    spread = max(float(diagonal[-1] - diagonal[0]), float(np.abs(a - np.diag(np.diag(a))).max()))
    shifts = [middle, mean, *(mean + spread * f for f in (0.118, -0.118, 0.236, -0.236, 0.382, -0.382, 0.045, -0.045))]
    rng = np.random.default_rng(d)
    best, least = None, np.inf
    for shift in shifts:
        moved = a - shift * np.eye(d)
        if not moved.any():
            continue
        projector = (polar_factor(moved) + np.eye(d)) / 2
        rank = int(round(float(np.trace(projector))))
        if not 0 < rank < d:
            continue
        basis, _ = np.linalg.qr(projector @ rng.standard_normal((d, rank)))
        basis, _ = np.linalg.qr(projector @ basis, mode="complete")
        upper, lower = basis[:, :rank], basis[:, rank:]
        remainder = np.linalg.norm(lower.T @ a @ upper)
        if remainder < least:
            best, least = (upper, lower), remainder
        if least <= 10 * d * EPS * size:
            break
    return best


def leading_components(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` largest eigenvalues of a symmetric matrix, falling, and unit eigenvectors as rows.

    The largest entry of a vector is positive. Equal eigenvalues get any basis of their subspace.
    """
    d = len(a)
    size = float(np.linalg.norm(a))
    values: list[float] = []
    vectors: list[np.ndarray] = []
    todo = [(a, np.eye(d))]
    while todo and len(values) < most:
        block, basis = todo.pop()
        off = np.linalg.norm(block - np.diag(np.diag(block)))
        parts = None if len(block) == 1 or off <= EPS * size else divide(block, size)
        if parts is None:
            for i in np.argsort(-np.diag(block), kind="stable"):
                values.append(float(block[i, i]))
                vectors.append(basis[:, i])
            continue
        for part in reversed(parts):
            inner = part.T @ block @ part
            todo.append(((inner + inner.T) / 2, basis @ part))
    kept = np.array(vectors[:most]).reshape(-1, d)
    kept = kept * np.where(kept[np.arange(len(kept)), np.abs(kept).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    # Rayleigh quotients are more exact than what is left of the matrix after many divisions.
    values = np.einsum("id,de,ie->i", kept, a, kept)
    order = np.argsort(-values, kind="stable")
    return values[order], kept[order]


# Spark


@dataclass(frozen=True)
class Model:
    """A fitted whitening. ``sums`` are the exact sums of the ``n`` distinct grid vectors."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    identity_error: float | None

    @property
    def usable(self) -> np.ndarray:
        """Components with a spread beyond rounding; along others whitening is not defined."""
        return self.values > max(len(self.sums), 1) * EPS * max(self.trace, 0.0)


def grid_vectors(rows: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", scale: int = 256) -> DataFrame:
    """``id, x``: vectors as ``floor(scale * entry)``, without those that are null or hold null, NaN
    or infinite entries, and without those of an uncommon length (of equally common lengths the
    largest stays). Entries beyond 64 bits stop at the limits."""
    entries = F.col(f"`{vector_column}`")
    infinite = F.lit(float("inf"))
    good = F.forall(
        entries, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < infinite)
    )
    vectors = rows.filter(entries.isNotNull() & good).select(
        F.col(f"`{id_column}`").alias("id"),
        F.transform(entries, lambda c: F.floor(c.cast("double") * F.lit(float(scale)))).alias("x"),
    )
    lengths = vectors.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    common = lengths.orderBy(F.desc("n"), F.desc("d")).first()
    return vectors.filter(F.size("x") == (common["d"] if common else 0))


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dims)


def _largest(x: np.ndarray) -> int:
    return max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0))))


def shifted(x: np.ndarray, centre: list[int]) -> np.ndarray:
    """``x - centre``, as Python integers where 64 bits could overflow."""
    if max(_largest(x), *(abs(c) for c in centre)) >= 1 << 61:
        return x.astype(object) - np.array(centre, object)
    return x - np.array(centre, np.int64)


def exact_products(y: np.ndarray) -> np.ndarray:
    """``y.T @ y`` of integers as Python integers: blocks of rows whose sums stay exact in doubles."""
    square = max(1, max((abs(int(v)) for v in (y.max(initial=0), y.min(initial=0))))) ** 2
    if y.dtype == object or square >= EXACT:
        y = y.astype(object)
        return y.T @ y
    step = EXACT // square
    total = np.zeros((y.shape[1],) * 2, object)
    for at in range(0, len(y), step):
        part = y[at : at + step].astype(float)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def exact_totals(fit: DataFrame, dims: int, what, cells: int) -> list[int]:
    """Cell by cell, the sum over all of ``fit`` of ``what(rows)``, a flat array of integers for each
    batch of grid vectors. Each task ships one row per cell."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            part = what(matrix(batch.column(0), dims))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(cells), pa.int32()),
                    pa.array([Decimal(int(v) >> LIMB) for v in total], pa.decimal128(38, 0)),
                    pa.array([int(v) & ((1 << LIMB) - 1) for v in total], pa.int64()),
                ],
                names=["cell", "high", "low"],
            )

    parts = fit.select("x").mapInArrow(partial, "cell int, high decimal(38,0), low long")
    sums = parts.groupBy("cell").agg(F.sum("high").alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    out = [0] * cells
    for cell, high, low in sums.toLocalIterator():
        out[cell] = (int(high) << LIMB) + int(low)
    return out


def covariance(fit: DataFrame, dims: int, n: int, sums: list[int]) -> np.ndarray:
    """Covariance (divisor ``n``) of the vectors of ``fit``, every cell rounded once.

    Vectors are centred on the mean rounded to the grid before they are multiplied; what the rounding
    left is taken off the exact sums.
    """
    centre = [(2 * s + n) // (2 * n) for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre)]
    upper = np.triu_indices(dims)
    products = exact_totals(fit, dims, lambda x: exact_products(shifted(x, centre))[upper], len(upper[0]))
    out = np.zeros((dims, dims))
    for i, j, total in zip(*upper, products):
        out[i, j] = out[j, i] = (n * total - rest[i] * rest[j]) / (n * n)
    return out


def project(x: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """``n * x - sums`` as integers, and the whitened components of the usable directions."""
    n, sums = model.n, model.sums
    if n * _largest(x) + max(abs(s) for s in sums) < 1 << 62:
        far = x * n - np.array(sums, np.int64)
    else:
        far = x.astype(object) * n - np.array(sums, object)
    axes = model.vectors[model.usable] / np.sqrt(model.values[model.usable])[:, None]
    return far, (far / n).astype(float) @ axes.T


def fit_whitening(vectors: DataFrame, components: int = 4) -> Model | None:
    """Fits ``grid_vectors``: every distinct vector counts once. ``None`` without vectors."""
    fit = materialise(vectors.select("x").distinct())
    n = fit.count()
    if not n:
        return None
    dims = len(fit.first()["x"])
    if not dims:
        return None

    def sums_of(x: np.ndarray) -> np.ndarray:
        small = _largest(x) * max(len(x), 1) < 1 << 62
        return x.sum(axis=0).astype(object) if small else x.astype(object).sum(axis=0)

    sums = exact_totals(fit, dims, sums_of, dims)
    spread = covariance(fit, dims, n, sums)
    values, axes = leading_components(spread, components)
    model = Model(n, sums, values, axes, float(np.trace(spread)), None)
    return Model(n, sums, values, axes, model.trace, identity_error(fit, dims, model))


def identity_error(fit: DataFrame, dims: int, model: Model) -> float | None:
    """Largest absolute entry of the covariance of the whitened vectors of ``fit`` minus the identity."""
    k = int(model.usable.sum())
    if not k:
        return None

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            _, white = project(matrix(batch.column(0), dims), model)
            total += np.vstack([white.sum(axis=0), white.T @ white])
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["cell", "value"]
        )

    sums = fit.select("x").mapInArrow(partial, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
    total = np.zeros((k + 1) * k)
    for cell, value in sums.toLocalIterator():
        total[cell] = value
    mean, products = total[:k] / model.n, total[k:].reshape(k, k) / model.n
    return float(np.abs(products - np.outer(mean, mean) - np.eye(k)).max())


def whitened(
    rows: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    components: int = 4,
    scale: int = 256,
) -> DataFrame:
    """One row per vector and component: the id, ``component`` (from 1, by falling eigenvalue), ``n``,
    ``deviation``, ``whitened``, ``explained`` and ``identity_error``.

    Rows whose vector is null, holds null, NaN or infinite entries, or has an uncommon length give
    none; repeated rows give theirs each, and a null id stays null. Vectors of fewer entries than
    ``components`` have as many components as entries. Along a component without spread ``whitened``
    is null; without any spread ``explained`` and ``identity_error`` are null too. ``deviation`` is null
    where it exceeds 64 bits. Other columns are ignored. An empty table gives no rows.
    """
    vectors = grid_vectors(rows, id_column, vector_column, scale)
    kind = vectors.schema["id"].dataType.simpleString()
    out = (
        f"`{id_column}` {kind}, component int, n long, deviation long, whitened double, explained double,"
        " identity_error double"
    )
    model = fit_whitening(vectors, components)
    if model is None:
        return rows.sparkSession.createDataFrame([], out)
    dims, usable, count = len(model.sums), model.usable, len(model.values)

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            far, white = project(matrix(batch.column(1), dims), model)
            if far.dtype != object and _largest(far) ** 2 * dims < 1 << 63:
                deviation = pa.array((far * far).sum(axis=1))
            else:
                far = far.astype(object)
                deviation = pa.array(
                    [v if v < 1 << 63 else None for v in map(int, (far * far).sum(axis=1))], pa.int64()
                )
            at = pa.array(np.repeat(np.arange(batch.num_rows), count))
            parts = np.full((batch.num_rows, count), np.nan)
            parts[:, usable] = white
            shares = model.values / model.trace if model.trace > 0 else np.full(count, np.nan)
            size = batch.num_rows * count
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(at),
                    pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), batch.num_rows)),
                    pa.array(np.full(size, model.n)),
                    deviation.take(at),
                    pa.array(parts.ravel(), from_pandas=True),
                    pa.array(np.tile(shares, batch.num_rows), from_pandas=True),
                    pa.array([model.identity_error] * size, pa.float64()),
                ],
                names=[id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return vectors.select("id", "x").mapInArrow(rows_of, out)
