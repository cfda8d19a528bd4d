"""Whitening of embeddings by Chebyshev-filtered subspace iteration (operator 13).

Entries become integers x = floor(1024 c) + 100000, so counts, sums and squared deviations are exact. The leading
eigenvectors of their covariance V come from a block Q of columns: every product V Q is one pass over the vectors in
Spark (centred rows X give X'(X Q), summed by entry), a Chebyshev polynomial of V damps the spectrum below the block's
least Ritz value, QR makes the block orthogonal and Rayleigh-Ritz turns it to eigenvectors. The loop ends when the
residuals are certified; a block that stays uncertified is widened, at most to all dimensions, where Rayleigh-Ritz is
exact. The driver sees sums only: dimensions x block numbers a pass, whatever the number of vectors or tasks.

Edge cases: a null vector, or one with a null, NaN or infinite entry, is left out; so is an empty one, and one whose
length is not the commonest (of equally common ones the largest). Finite entries beyond +-2**52 count as +-2**52.
Components with no variance (fewer vectors than components, equal columns) are not returned; no vector, no row. A
deviation that no long can hold is null. Repeated rows and repeated or null ids each count and are returned. Other
columns of the table take no part, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT, LARGEST = 1024, 100_000, 1 << 52
COMPONENTS = 8
#: Columns beside the wanted ones, degree of the polynomial, rounds before the block is doubled.
SPARE, DEGREE, ROUNDS = 16, 8, 6
#: Residual |V q - e q| that certifies an eigenvector, relative to the largest eigenvalue; what is accepted where rounding stops it earlier.
CERTIFIED, ROUNDED = 2e-15, 2e-13
#: A component below this share of the largest eigenvalue has no variance.
NO_VARIANCE = 1e-13


def _entries(batch: pa.RecordBatch, column: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their entries as integers)."""
    vectors = batch.column(column)
    usable = pc.fill_null(pc.equal(pc.list_value_length(vectors), width), False).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(usable)
    flat = vectors.take(pa.array(rows)).flatten()
    values = pc.fill_null(flat.cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False).reshape(len(rows), width)
    fine = np.isfinite(values).all(1)
    x = np.clip(np.floor(values[fine] * SCALE), -LARGEST, LARGEST).astype(np.int64) + SHIFT
    return rows[fine], x


class _Centre:
    """The mean as whole part and fraction, so that centring loses nothing."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        self.whole = np.array([s // n for s in sums], np.int64)
        self.part = np.array([(s % n) / n for s in sums])

    def rows(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.part

    def deviations(self, x: np.ndarray) -> list[int]:
        """Sum of (n x - S)^2 per row, exact: n (x - whole) - rest stays small where the data are."""
        rest = np.array([s % self.n for s in self.sums], np.int64)
        far = int(np.abs(x - self.whole).max(initial=0)) + 1
        if (self.n * far) ** 2 * x.shape[1] < 1 << 63:
            d = self.n * (x - self.whole) - rest
            return (d * d).sum(1).tolist()
        left = [int(r) for r in rest]
        return [sum((self.n * v - r) ** 2 for v, r in zip(row, left, strict=True)) for row in (x - self.whole).tolist()]


def _width(vectors: DataFrame, column: str) -> int:
    sizes = vectors.where(F.size(column) > 0).groupBy(F.size(column).alias("w")).agg(F.count("*").alias("c"))
    first = sizes.orderBy(F.desc("c"), F.desc("w")).limit(1).collect()
    return first[0].w if first else 0


def _sums(vectors: DataFrame, column: str, width: int) -> tuple[int, list[int]]:
    """Number of vectors and the exact sum of each dimension."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, low, high = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            _, x = _entries(batch, column, width)
            n += len(x)
            high += (x >> 24).sum(0)
            low += (x & 0xFFFFFF).sum(0)
        dim = np.arange(width + 1, dtype=np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(dim), pa.array(np.append(high, 0)), pa.array(np.append(low, n))], ["dim", "high", "low"])

    whole = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    found = {r.dim: (int(r.high) << 24) + int(r.low) for r in vectors.mapInArrow(count, "dim int, high long, low long").groupBy("dim").agg(*whole).collect()}
    return found.get(width, 0), [found.get(i, 0) for i in range(width)]


def _summed(vectors: DataFrame, column: str, width: int, shape: tuple[int, int], part: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all vectors of ``part`` (a matrix of ``shape`` for a block of rows); one pass, added up by entry in Spark."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            _, x = _entries(batch, column, width)
            if len(x):
                total += part(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["at", "v"])

    out = np.zeros(shape[0] * shape[1])
    for at, v in vectors.mapInArrow(work, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        out[at] = v
    return out.reshape(shape)


def leading_eigenvectors(times: Callable[[np.ndarray], np.ndarray], width: int, wanted: int, seed: int = 13) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of the symmetric positive operator ``times``."""
    block = min(width, wanted + SPARE)
    rng = np.random.default_rng(seed)
    q = np.linalg.qr(rng.standard_normal((width, block)))[0]
    while True:
        last = np.inf
        for _ in range(ROUNDS):
            image = times(q)
            ritz, turn = np.linalg.eigh((q.T @ image + image.T @ q) / 2)
            ritz, turn = np.maximum(ritz[::-1], 0), turn[:, ::-1]
            q, image = q @ turn, image @ turn
            error = np.linalg.norm(image - q * ritz, axis=0)[:wanted].max()
            if block == width or ritz[0] == 0 or error <= CERTIFIED * ritz[0] or (error <= ROUNDED * ritz[0] and error > last / 2):
                return ritz[:wanted], q[:, :wanted]
            last = min(last, error)
            q = np.linalg.qr(_filtered(times, q, image, ritz))[0]
        block = min(width, 2 * block)
        q = np.linalg.qr(np.hstack([q, rng.standard_normal((width, block - q.shape[1]))]))[0]


def _filtered(times: Callable[[np.ndarray], np.ndarray], q: np.ndarray, image: np.ndarray, ritz: np.ndarray) -> np.ndarray:
    """The Chebyshev polynomial of the operator that stays small on [0, least Ritz value], times the block; scaled to 1 at the largest."""
    half = max(ritz[-1] / 2, ritz[0] * 1e-8)
    sigma = half / (ritz[0] - half)
    first = sigma
    before, now = q, (image - half * q) * (sigma / half)
    for _ in range(DEGREE - 1):
        following = 1 / (2 / first - sigma)
        before, now = now, (times(now) - half * now) * (2 * following / half) - before * (sigma * following)
        sigma = following
    return now


def whiten(vectors: DataFrame, column: str = "embedding", id_column: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """One row per vector and component: id, component (from 1), n, deviation, whitened, explained, identity_error."""
    schema = f"{id_column} {vectors.schema[id_column].dataType.simpleString()}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    rows = vectors.select(id_column, column)
    only = vectors.select(column)
    width = _width(only, column)
    n, sums = _sums(only, column, width) if width else (0, [])
    if not n:
        return vectors.sparkSession.createDataFrame([], schema)
    centre = _Centre(n, sums)

    def times(q: np.ndarray) -> np.ndarray:
        return _summed(only, column, width, q.shape, lambda x: (c := centre.rows(x)).T @ (c @ q)) / n

    trace = float(_summed(only, column, width, (1, 1), lambda x: np.array([[(centre.rows(x) ** 2).sum()]]))[0, 0]) / n
    values, axes = leading_eigenvectors(times, width, min(components, width))
    has = values > NO_VARIANCE * max(values[0], trace / width)
    values, axes = values[has], axes[:, has]
    if not len(values):
        return vectors.sparkSession.createDataFrame([], schema)
    signs = np.sign(axes[np.abs(axes).argmax(0), np.arange(axes.shape[1])])
    to_white = axes * signs / np.sqrt(values)
    k = len(values)

    def moments(x: np.ndarray) -> np.ndarray:
        w = centre.rows(x) @ to_white
        return np.vstack([w.T @ w, w.sum(0)])

    seen = _summed(only, column, width, (k + 1, k), moments) / n
    off = float(np.abs(seen[:k] - np.outer(seen[k], seen[k]) - np.eye(k)).max())
    explained = values / trace
    top = (1 << 63) - 1

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _entries(batch, column, width)
            if not len(at):
                continue
            away = pa.array([d if d <= top else None for d in centre.deviations(x)], pa.int64())
            each = np.repeat(np.arange(len(at)), k)
            m = len(each)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(id_column).take(pa.array(at[each])), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(m, n, np.int64)), away.take(pa.array(each)), pa.array((centre.rows(x) @ to_white).ravel()),
                    pa.array(np.tile(explained, len(at))), pa.array(np.full(m, off)),
                ],
                [id_column, "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(emit, schema)
