"""Embedding whitening by Chebyshev-filtered subspace iteration.

The leading eigenvectors of a covariance are found without the covariance: a
block of directions Q is multiplied by it in one pass over the vectors, as the
sum of XᵀXQ over blocks of centred vectors X.  Each round puts the block
through a Chebyshev polynomial that is small on the unwanted end of the
spectrum and grows fast above it, makes it orthonormal (QR), and takes the Ritz
pairs of the covariance in it.  Rounds end when every wanted pair is certified:
its residual, from the last pass, is at rounding level.  A pass moves one
matrix of dimensions by directions per task, whatever the number of vectors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import lean, table, written

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
#: Whole numbers beyond it are taken as it, so that differences fit 64 bits.
LARGEST = 1 << 61
#: Bytes of vectors in one row of the written table.
BLOCK_BYTES = 1 << 19
#: Matrices that are summed on the driver; more are summed by tasks first.
SUMMED_AT_ONCE = 32
#: Degrees of a round's polynomial, and how much more it may magnify the largest eigenvalue than the least wanted one.
MOST_DEGREES, MOST_GROWTH = 12, 1e9
LANCZOS_STEPS = 8
#: Certified: a residual of at most so many times the largest eigenvalue; or of so many where rounds no longer lower it.
CERTIFIED, AT_BEST = 2e-14, 1e-12
#: Below so many times the largest, an eigenvalue is taken as zero.
ZERO = 1e-13
SEED = 7

Product = Callable[[np.ndarray], np.ndarray]


def whole(vectors: DataFrame, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vectors(vec_id, embedding)`` that take part, with ``x``: floor(scale * c) + shift for each entry.

    A null vector, and one that holds null or non-finite entries, is left out.
    """
    entries = F.col("embedding").cast("array<double>")
    usable = entries.isNotNull() & ~F.exists(entries, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    number = lambda c: F.floor(F.least(F.greatest(scale * c, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))) + F.lit(shift)
    return vectors.where(F.coalesce(usable, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(entries, number).alias("x"))


def _blocks(batches: Iterator[pa.RecordBatch], width: int, shift: int) -> Iterator[pa.RecordBatch]:
    """Vectors as rows of bounded size: their ids, and their numbers less the shift."""
    size = max(1, BLOCK_BYTES // (8 * width))
    for whole_batch in batches:
        for at in range(0, len(whole_batch), size):
            batch = whole_batch.slice(at, size)
            lists = batch["x"]
            sizes = np.diff(lists.offsets.to_numpy())
            x = np.zeros((len(sizes), width), "<i8")  # a shorter vector is ended by zeros before the shift
            x[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy() - shift
            ids = pa.ListArray.from_arrays(pa.array([0, len(sizes)], pa.int32()), batch["vec_id"])
            yield pa.RecordBatch.from_arrays([ids, pa.array([x.tobytes()], pa.binary())], names=["ids", "x"])


def _numbers(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    for batch in batches:
        for ids, x in zip(batch["ids"], batch["x"]):
            yield ids.values, np.frombuffer(x.as_buffer(), "<i8").reshape(-1, width)


def _exact_sums(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Of a task's vectors, for each dimension, the sums of the high and the low 32 bits; their number as of one dimension more."""
    high, low = np.zeros(width + 1, np.int64), np.zeros(width + 1, np.int64)
    for _, x in _numbers(batches, width):
        high[:width] += (x >> 32).sum(0)
        low[:width] += (x & 0xFFFFFFFF).sum(0)
        low[width] += len(x)
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(width + 1)), pa.array(high), pa.array(low)], names=["dimension", "high", "low"])


class Centre:
    """The exact mean S/n of the vectors: the nearest whole number and the rest."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        nearest = [(2 * s + n) // (2 * n) for s in sums]
        self.nearest = np.array(nearest, np.int64)
        self.over = np.array([s - n * c for s, c in zip(sums, nearest)], np.int64)  # n/2 at most
        self.rest = self.over / n

    def centred(self, x: np.ndarray) -> np.ndarray:
        """x - S/n, right to the last digit."""
        return (x - self.nearest) - self.rest

    def deviations(self, x: np.ndarray) -> pa.Array:
        """The sum over dimensions of (n * x - S)^2; null where it doesn't fit 64 bits."""
        far = (x - self.nearest).astype(float) * self.n - self.over
        about = (far * far).sum(1)
        with np.errstate(over="ignore"):
            exact = (x - self.nearest) * np.int64(self.n) - self.over  # a sum below 2^63 comes out right whatever wraps on the way
            found = (exact * exact).sum(1)
        fits = about < 2.0**63 * (1 - 1e-9)
        for i in np.flatnonzero(~fits & (about < 2.0**63 * (1 + 1e-9))):
            value = sum((self.n * int(v) - s) ** 2 for v, s in zip(x[i], self.sums))
            fits[i] = value < 1 << 63
            found[i] = value if fits[i] else 0
        return pa.array(found, mask=~fits)


def _summed(partials: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of the matrices that tasks give: one from each, a tree of sums where they are many."""
    size = math.prod(shape)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            for m in batch["m"]:
                total += np.frombuffer(m.as_buffer())
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    parts = partials.rdd.getNumPartitions()
    while parts > SUMMED_AT_ONCE:
        parts = math.isqrt(parts)
        partials = partials.repartition(parts).mapInArrow(added, "m binary")
    found = [np.frombuffer(m.as_buffer()) for m in partials.toArrow()["m"]]
    return np.sum(found, axis=0).reshape(shape) if found else np.zeros(shape)


def _over_rows(blocks: DataFrame, centre: Centre, directions: np.ndarray, gather: Callable[[np.ndarray, np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over blocks of what ``gather`` makes of the centred vectors and the directions: one pass."""
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast((centre, directions))  # dimensions by directions

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, q = shared.value
        total = np.zeros(shape)
        for _, x in _numbers(batches, len(q)):
            total += gather(mean.centred(x), q)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["m"])

    try:
        return _summed(blocks.select("ids", "x").mapInArrow(lambda b: lean(partial(b)), "m binary"), shape)
    finally:
        shared.destroy()


def lowest_bound(product: Product, start: np.ndarray, steps: int = LANCZOS_STEPS) -> float:
    """No eigenvalue is below: the least Ritz value of a few Lanczos steps, less the last residual, and zero at least."""
    q, before, beta, alphas, betas = start / np.linalg.norm(start), np.zeros_like(start), 0.0, [], []
    for _ in range(min(steps, len(start))):
        r = product(q[:, None])[:, 0] - beta * before
        alphas.append(float(q @ r))
        r -= alphas[-1] * q
        beta = float(np.linalg.norm(r))
        betas.append(beta)
        if beta <= ZERO * abs(alphas[0]):
            break
        before, q = q, r / beta
    t = np.diag(alphas) + np.diag(betas[:-1], 1) + np.diag(betas[:-1], -1)
    return max(0.0, float(np.linalg.eigvalsh(t)[0]) - betas[-1])


def filtered(product: Product, q: np.ndarray, image: np.ndarray, low: float, high: float, top: float, degree: int) -> np.ndarray:
    """The Chebyshev polynomial of that degree, for [low, high] and scaled to one at ``top``, times ``q``.

    ``image`` is the product with ``q``, known from the round before; each
    further degree is one pass.
    """
    half, middle = (high - low) / 2, (high + low) / 2
    scale = first = half / (top - middle)
    before, now = q, (image - middle * q) * (scale / half)
    for _ in range(degree - 1):
        following = 1 / (2 / first - scale)
        before, now = now, (product(now) - middle * now) * (2 * following / half) - (scale * following) * before
        scale = following
    return now


def _ritz(q: np.ndarray, image: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ritz values in falling order, their vectors in the span of q, and the products with these."""
    h = q.T @ image
    values, turn = np.linalg.eigh((h + h.T) / 2)
    values, turn = values[::-1], turn[:, ::-1]
    return values, q @ turn, image @ turn


def leading(product: Product, width: int, wanted: int, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """The ``wanted`` largest eigenvalues of a positive semidefinite product, their vectors, residuals and the passes taken.

    The block has half as many directions again as are wanted.  Where a round
    hardly helps, as eigenvalues at the block's end are as large as wanted ones,
    it grows; with as many directions as dimensions one round is exact.
    """
    rng = np.random.default_rng(SEED)
    taken = [0]

    def counted(m: np.ndarray) -> np.ndarray:
        taken[0] += 1
        return product(m)

    size = min(width, wanted + max(2, wanted // 2))
    low = lowest_bound(counted, rng.standard_normal(width)) if size < width else 0.0
    q = np.linalg.qr(rng.standard_normal((width, size)))[0]
    values, q, image = _ritz(q, counted(q))
    worst = math.inf
    for _ in range(rounds):
        residuals = np.linalg.norm(image - q * values, axis=0)[:wanted]
        top = max(values[0], 0.0)
        stalls = residuals.max() > 0.3 * worst
        if residuals.max() <= CERTIFIED * top or stalls and (size == width or residuals.max() <= AT_BEST * top):
            break
        if stalls:
            more = min(width, size + max(2, size // 2))
            q = np.linalg.qr(np.hstack([q, rng.standard_normal((width, more - size))]))[0]
            size = more
        elif size < width and values[-1] > low:
            high = float(values[-1])
            reach = math.acosh(max(1 + 1e-12, (top - (high + low) / 2) / ((high - low) / 2)))
            edge = math.acosh(max(1.0, (values[wanted - 1] - (high + low) / 2) / ((high - low) / 2)))
            degree = int(min(MOST_DEGREES, max(2, math.log(MOST_GROWTH) / max(reach - edge, 1e-9))))
            q = np.linalg.qr(filtered(counted, q, image, low, high, top, degree))[0]
        else:
            q = np.linalg.qr(image if size < width else q)[0]
        worst = residuals.max()
        values, q, image = _ritz(q, counted(q))
    else:
        raise ArithmeticError(f"no certified eigenvectors after {rounds} rounds; the largest residual is {worst}")
    return values[:wanted], q[:, :wanted], residuals, taken[0]


_COLUMNS = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def whitened(vectors: DataFrame, components: int = COMPONENTS, scale: int = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vectors(vec_id, embedding)`` to a row for each vector and component, the largest first.

    Vectors that are null or hold null or non-finite entries are left out; of
    the rest every row counts, repeated ids and null ids included.  A shorter
    vector is ended by zeros.  There are as many components as dimensions at
    most, and none of an eigenvalue that is zero to double precision, so equal
    vectors, and a single one, give no rows; nor does an empty table.  Scaled
    entries beyond 2^61 are taken as 2^61, and a deviation beyond 64 bits is null.
    """
    spark = vectors.sparkSession
    rows = whole(vectors, scale, shift)
    none = spark.createDataFrame([], _COLUMNS)
    width = rows.agg(F.max(F.size("x"))).first()[0]
    if not width:
        return none
    blocks = written(rows.mapInArrow(lambda b: lean(_blocks(b, width, shift)), "ids array<long>, x binary"), "vectors", "zstd")
    each = blocks.mapInArrow(lambda b: lean(_exact_sums(b, width)), "dimension long, high long, low long")
    exact = [F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("high", "low")]
    *sums, n = [(int(r.high) << 32) + int(r.low) for r in each.groupBy("dimension").agg(*exact).orderBy("dimension").collect()]  # a row for each dimension
    centre = Centre(n, sums)

    def product(q: np.ndarray) -> np.ndarray:
        return _over_rows(blocks, centre, q, lambda x, q: x.T @ (x @ q), (width, q.shape[1])) / centre.n

    trace = _over_rows(blocks, centre, np.zeros((width, 0)), lambda x, _: np.array([(x * x).sum()]), (1,))[0] / centre.n
    if not trace:
        return none
    values, directions, _, _ = leading(product, width, min(components, width))
    some = values > ZERO * values[0]
    values, directions = values[some], directions[:, some]
    axes = directions / np.sqrt(values)
    k = len(values)
    moments = _over_rows(blocks, centre, axes, lambda x, a: np.vstack([(w := x @ a).T @ w, w.sum(0)]), (k + 1, k)) / centre.n
    error = float(np.abs(moments[:k] - np.outer(moments[k], moments[k]) - np.eye(k)).max())
    shared = spark.sparkContext.broadcast((centre, axes, values / trace))  # dimensions by components

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, axes, explained = shared.value
        for ids, x in _numbers(batches, width):
            m = len(x)
            column = {
                "vec_id": ids.take(pa.array(np.repeat(np.arange(m), k))),
                "component": pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)),
                "n": pa.array(np.full(m * k, mean.n)),
                "deviation": mean.deviations(x).take(pa.array(np.repeat(np.arange(m), k))),
                "whitened": pa.array((mean.centred(x) @ axes).ravel()),
                "explained": pa.array(np.tile(explained, m)),
                "identity_error": pa.array(np.full(m * k, error)),
            }
            yield pa.RecordBatch.from_arrays(list(column.values()), names=list(column))

    return blocks.mapInArrow(lambda b: lean(projected(b)), _COLUMNS)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
