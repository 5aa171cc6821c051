"""Exact top-k search by inner product over a pivot-distance index.

Vectors get one more component that gives all of them the same length, so that
a larger inner product is a smaller distance.  Each vector is keyed by its
nearest pivot and its distance to it; rings of equal width around a pivot are
the index's annuli, and an annulus is stored as blocks of a bounded size.  By
the triangle inequality, a vector in an annulus is no nearer to a query than
the query's distance to the pivot lies outside of the annulus.  Queries in a
block expand the annuli in the order of that bound, and stop at the first whose
bound is below the k-th best score that each of them has.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from .common import table, written

PIVOTS = 32
#: Vectors, at most, of which pivots and first bounds are made.
SAMPLE = 2048
RINGS = 32
BLOCK_ROWS = 2048
QUERY_ROWS = 2048
#: Tasks among which the blocks for one block of queries are dealt.
CHUNKS = 4
#: Whole components beyond it are taken as it, and scores beyond 64 bits as the last that fit.
LARGEST = 1 << 62


def scaled(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """``vectors(vec_id, embedding)`` with a list of whole numbers each, ``v``: floor(scale * x), and ``row``, a number of its own.

    Every row with an id stays whose vector is not null and holds neither null
    nor non-finite components; rows of one id are vectors of their own.  A
    component beyond 2^62 after scaling is taken as 2^62.  The result is a
    table, so that a row keeps its number.
    """
    x = F.col("embedding").cast("array<double>")
    usable = F.col("vec_id").isNotNull() & x.isNotNull() & ~F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    whole = F.transform(x, lambda c: F.floor(F.least(F.greatest(scale * c, F.lit(-float(LARGEST))), F.lit(float(LARGEST)))))
    rows = vectors.where(F.coalesce(usable, F.lit(False))).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), whole.alias("v"))
    return written(rows, "scaled", "zstd")


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Lists as rows; shorter ones end in zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(sizes), width), np.int64)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


class Pivots:
    """Pivots in the space where all vectors have one length, and what queries need before they meet the index."""

    def __init__(self, rows: np.ndarray, sample: np.ndarray, square: float, pivots: int, k: int):
        self.rows, self.sample, self.square, self.k = rows, sample, square, k
        points = self.raised(sample)
        centres = points[:pivots]
        for _ in range(5):
            nearest = self._distances(points, centres).argmin(1)
            centres = np.array([points[nearest == i].mean(0) if (nearest == i).any() else c for i, c in enumerate(centres)])
        self.centres = centres

    def raised(self, v: np.ndarray) -> np.ndarray:
        v = v.astype(float)
        return np.column_stack([v, np.sqrt(np.maximum(self.square - (v * v).sum(1), 0))])

    @staticmethod
    def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * a @ b.T, 0))

    def of_rows(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot and distance to it."""
        d = self._distances(self.raised(v), self.centres)
        return d.argmin(1), d.min(1)

    def of_queries(self, v: np.ndarray) -> np.ndarray:
        return self._distances(np.column_stack([v, np.zeros(len(v))]), self.centres)

    def floor_of(self, rows: np.ndarray, v: np.ndarray) -> np.ndarray:
        """A score that k rows of the sample reach, by query."""
        scores = _products(v, self.sample)
        scores[rows[:, None] == self.rows] = _NONE
        if scores.shape[1] < self.k:
            return np.full(len(v), _NONE)
        return np.partition(scores, scores.shape[1] - self.k, axis=1)[:, -self.k]


_NONE = -(1 << 63) + 1  # below any score, and its negative is a number as well


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers; one beyond 64 bits is the last number that fits."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = int(np.abs(a).max()) * int(np.abs(b).max()) * a.shape[1]
    if bound < 1 << 53:
        return (a.astype(float) @ b.T.astype(float)).astype(np.int64)
    if bound < 1 << 63:
        return a @ b.T
    about = a.astype(float) @ b.T.astype(float)
    with np.errstate(over="ignore"):
        out = a @ b.T  # a sum that fits comes out right whatever wraps on the way
    error = (np.abs(a).astype(float) @ np.abs(b).T.astype(float)) * (a.shape[1] + 2) * 2.0**-52
    for i, j in zip(*np.nonzero(np.abs(about) + error >= 2.0**63)):
        exact = sum(int(x) * int(y) for x, y in zip(a[i], b[j]))
        out[i, j] = max(_NONE + 1, min((1 << 63) - 1, exact))
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """By row, the k highest scores with their ids; ties to smaller ids."""
    order = np.lexsort((np.broadcast_to(ids, scores.shape) if ids.ndim == 1 else ids, -scores), axis=1)[:, :k]
    return np.take_along_axis(np.broadcast_to(ids, scores.shape) if ids.ndim == 1 else ids, order, 1), np.take_along_axis(scores, order, 1)


def _expanded(batches: Iterator[pa.RecordBatch], shared, width: int) -> Iterator[pa.RecordBatch]:
    """Blocks of queries, each followed by the blocks of vectors in the order of their bounds, to the best rows of each query."""
    pivots: Pivots = shared.value
    k, state = pivots.k, None

    def done() -> Iterator[pa.RecordBatch]:
        ids, best = state["best"]
        at = np.nonzero(best > _NONE)
        yield pa.RecordBatch.from_arrays([pa.array(state["rows"][at[0]]), pa.array(state["ids"][at[0]]), pa.array(ids[at]), pa.array(best[at])], names=["query_row", "query_id", "vec_id", "score"])

    for batch in batches:
        for i in range(len(batch)):
            r = {n: batch[n][i].as_py() for n in batch.schema.names}
            ids, rows, v = _unpacked(r, width)
            if r["kind"] == 0:
                if state:
                    yield from done()
                squares = (v.astype(float) ** 2).sum(1)
                state = {"ids": ids, "rows": rows, "v": v, "to": pivots.of_queries(v.astype(float)), "square": squares, "floor": pivots.floor_of(rows, v), "best": (np.zeros((len(ids), 0), np.int64), np.zeros((len(ids), 0), np.int64))}
                continue
            bound = _bounds(state["to"][:, [r["pivot"]]], state["square"], pivots.square, np.array([r["low"]]), np.array([r["high"]]))[:, 0]
            some = np.flatnonzero(bound >= state["floor"])  # others can stop
            if not len(some):
                continue
            scores = _products(state["v"][some], v)
            scores[(state["rows"][some][:, None] == rows) | (scores < state["floor"][some][:, None])] = _NONE
            hit = np.flatnonzero((scores > _NONE).any(1))
            if not len(hit):
                continue
            scores, some = scores[hit], some[hit]
            have_ids, have = state["best"]
            if have.shape[1] < k:
                pad = k - have.shape[1]
                have_ids = np.hstack([have_ids, np.zeros((len(have), pad), np.int64)])
                have = np.hstack([have, np.full((len(have), pad), _NONE)])
            top = np.argpartition(-scores, min(k, scores.shape[1]) - 1, axis=1)[:, :k] if _distinct_enough(scores, k) else None
            if top is not None:
                new_ids, new = ids[top], np.take_along_axis(scores, top, 1)
            else:
                new_ids, new = _best(ids, scores, k)
            all_ids, all_ = np.hstack([have_ids[some], new_ids]), np.hstack([have[some], new])
            have_ids[some], have[some] = _best(all_ids, all_, k)
            state["best"] = (have_ids, have)
            state["floor"] = np.maximum(state["floor"], have[:, k - 1])
    if state:
        yield from done()


def _unpacked(block: dict, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, rows and vectors of a block."""
    ids = np.frombuffer(block["ids"], "<i8")
    return ids, np.frombuffer(block["rows"], "<i8"), np.frombuffer(block["v"], f"<i{len(block['v']) // max(1, len(ids) * width)}").reshape(len(ids), width).astype(np.int64)


def _distinct_enough(scores: np.ndarray, k: int) -> bool:
    """Whether the k-th score of each row is no tie, so that any order of the best k is right."""
    if scores.shape[1] <= k:
        return False
    two = np.partition(scores, scores.shape[1] - k - 1, axis=1)[:, -k - 1 :]
    return bool((np.sort(two, 1)[:, 0] < np.sort(two, 1)[:, 1]).all())


def _bounds(to: np.ndarray, squares: np.ndarray, square: float, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """No inner product of a query with a vector in the ring is above; a little slack covers rounding."""
    gap = np.maximum(np.maximum(to - high, low - to), 0)
    return np.floor((squares[:, None] + square - gap * gap) / 2 * (1 + 1e-9) + 1e-6 * square + 1)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 20, pivots: int = PIVOTS, sample: int = SAMPLE, rings: int = RINGS, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS, chunks: int = CHUNKS) -> DataFrame:
    """Of ``vectors(row, vec_id, v)``, the k highest inner products with each of ``queries``, rows of the same form, but for its own row.

    query_id, rank (from 1), vec_id, score; ties go to smaller ids.  A row's
    number tells it from others, also from one with its id; both frames are
    read more than once, so they must be tables, as ``scaled`` gives.  Shorter
    vectors count as ended by zeros.  Without vectors or queries the result is
    empty.
    """
    spark = vectors.sparkSession
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    largest = F.array_max(F.transform("v", F.abs))
    facts = vectors.agg(F.max(F.size("v")), F.max(square), F.max(largest)).first()
    if facts[0] is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    width, kind = max(1, facts[0]), "<i4" if (facts[2] or 0) < 1 << 31 else "<i8"
    some = vectors.orderBy(F.xxhash64("vec_id"), "row").limit(sample).toArrow().combine_chunks()
    index = spark.sparkContext.broadcast(Pivots(some["row"].to_numpy(), _matrix(some["v"].combine_chunks(), width), float(facts[1]), pivots, k))  # bounded by the sample

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = _matrix(batch["v"], width)
            pivot, distance = index.value.of_rows(v)
            body = pa.array([x.tobytes() for x in v.astype(kind)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["row"], batch["vec_id"], pa.array(pivot, pa.int32()), pa.array(distance), body], names=["row", "vec_id", "pivot", "distance", "v"])

    def packed(rows: pa.Table) -> pa.Table:
        first = {n: rows[n][0].as_py() for n in ("pivot", "ring", "salt")}
        distance = rows["distance"].to_numpy()
        ids, own = (rows[c].to_numpy().astype("<i8").tobytes() for c in ("vec_id", "row"))
        return pa.table({"pivot": pa.array([first["pivot"]], pa.int32()), "ring": pa.array([first["ring"]], pa.int32()), "salt": pa.array([first["salt"]], pa.int64()), "low": [distance.min()], "high": [distance.max()], "ids": pa.array([ids], pa.binary()), "rows": pa.array([own], pa.binary()), "v": pa.array([b"".join(rows["v"].to_pylist())], pa.binary())})

    def blocks(rows: DataFrame, size: int, rings: int) -> DataFrame:
        ring = F.floor(F.col("distance") / (2 * facts[1] ** 0.5 + 1) * rings).cast("int")  # no distance is above the diameter
        rows = written(rows.select("row", "vec_id", "v").mapInArrow(keyed, "row long, vec_id long, pivot int, distance double, v binary").withColumn("ring", ring), "keyed")
        counts = F.broadcast(rows.groupBy("pivot", "ring").agg(F.ceil(F.count("*") / size).alias("parts")))  # a row per annulus: pivots times rings
        salted = rows.join(counts, ["pivot", "ring"]).withColumn("salt", F.pmod(F.xxhash64("row"), F.col("parts")))
        return salted.groupBy("pivot", "ring", "salt").applyInArrow(packed, "pivot int, ring int, salt long, low double, high double, ids binary, rows binary, v binary")

    vector_blocks = written(blocks(vectors, block_rows, rings), "vector-blocks")
    query_blocks = written(blocks(queries, query_rows, 0).select(F.monotonically_increasing_id().alias("qblock"), "ids", "rows", "v"), "query-blocks")
    annuli = vector_blocks.groupBy("pivot", "ring").agg(F.min("low").alias("low"), F.max("high").alias("high")).toPandas()  # pivots times rings at most
    rings_of = [annuli[c].to_numpy() for c in ("pivot", "ring", "low", "high")]

    def wanted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The annuli that a block of queries may need, with their bounds."""
        facts_ = index.value
        for batch in batches:
            for i in range(len(batch)):
                _, own, v = _unpacked({c: batch[c][i].as_py() for c in ("ids", "rows", "v")}, width)
                f = v.astype(float)
                bound = _bounds(facts_.of_queries(f)[:, rings_of[0]], (f * f).sum(1), facts_.square, rings_of[2], rings_of[3])
                at = np.flatnonzero((bound >= facts_.floor_of(own, v)[:, None]).any(0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), batch["qblock"][i].as_py()), pa.int64()), pa.array(rings_of[0][at], pa.int32()), pa.array(rings_of[1][at], pa.int32()), pa.array(bound.max(0)[at].astype(float))], names=["qblock", "pivot", "ring", "bound"])

    chunk = F.pmod(F.xxhash64("pivot", "ring", "salt"), F.lit(chunks)).cast("int").alias("chunk")
    to_scan = query_blocks.mapInArrow(wanted, "qblock long, pivot int, ring int, bound double").join(vector_blocks, ["pivot", "ring"])
    scans = to_scan.select("qblock", chunk, F.lit(1).alias("kind"), "bound", "pivot", "low", "high", "ids", "rows", "v")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("bound", "double"), ("pivot", "int"), ("low", "double"), ("high", "double"))]
    heads = query_blocks.select("qblock", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(0).alias("kind"), *none, "ids", "rows", "v")
    stream = heads.union(scans).repartition("qblock", "chunk").sortWithinPartitions("qblock", "chunk", "kind", F.desc("bound"), "pivot", "low")
    found = stream.mapInArrow(lambda b: _expanded(b, index, width), "query_row long, query_id long, vec_id long, score long")
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = scaled(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return top_k(vectors, vectors.where("vec_id % 20 = 0"))


OP5_SQL = """
WITH vectors AS (
    SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS HUGEINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.row, q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM vectors q JOIN vectors c ON q.vec_id % 20 = 0 AND c.row <> q.row
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) <= 20
"""
