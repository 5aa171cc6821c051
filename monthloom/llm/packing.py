"""Best-fit packing of token sequences by exact complements.

Packing depends on lengths only, and there are at most ``capacity`` of them.
So Spark counts the pieces of each length, the driver packs the counts (its
work is bounded by the capacity, not by the rows), and the plan is joined back
to the pieces by their number among those of their length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from . import tokens
from .common import batches_of, lean, table, written

CAPACITY = 1024
#: Rows that share a number-giving group, about.
GROUP_ROWS = 20_000


def cut_documents(docs: DataFrame, vocabulary: tuple = tokens.BYTE_BPE, end_id: int = 2, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of at most ``capacity`` ids: doc_id, piece, start, length, ids (unsigned 32-bit, little-endian).

    Every document ends with ``end_id``, so a null or empty text is one piece
    of one id.  A document that doesn't fit is cut from its end into full
    pieces; what remains is its first piece.  Rows with equal or null ids stay
    rows of their own; further columns are ignored.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = tokens.encoder(*vocabulary), np.array([end_id], "<u4")
        for whole in batches:
            for batch in batches_of(whole, "text", 8 << 20):
                ids, begins = coder.encode(batch["text"])
                n = np.diff(begins) + 1
                ends = np.cumsum(n)
                all_ids = np.insert(ids, begins[1:], end[0]) if len(begins) > 1 else ids
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = (n - 1) % capacity + 1
                start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
                length = np.where(piece == 0, head[doc], capacity)
                offsets = np.append((ends - n)[doc] + start, ends[-1] if len(ends) else 0) * 4
                yield pa.RecordBatch.from_arrays([
                    batch["doc_id"].cast(pa.int64()).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                    pa.Array.from_buffers(pa.large_binary(), len(doc), [None, pa.py_buffer(offsets.astype(np.int64).tobytes()), pa.py_buffer(all_ids.astype("<u4").tobytes())]).cast(pa.binary()),
                ], names=["doc_id", "piece", "start", "length", "ids"])

    return docs.select("doc_id", "text").mapInArrow(lambda b: lean(cut(b)), "doc_id long, piece int, start long, length long, ids binary")


def packing_plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """Patterns (how many sequences, lengths in each) that use every counted piece.

    Sequences start with the longest piece left.  Single, pair and triple sums
    of available lengths that fill the gap exactly are consumed first, as many
    times as the counts allow; without one, the longest piece that fits goes in
    and the smaller gap is looked up again.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        if not 1 <= length <= capacity:
            raise ValueError(f"length {length} is not within 1 to {capacity}")
        left[length] = n
    plan = []
    while left.any():
        pattern = [int(np.flatnonzero(left)[-1])]
        left[pattern[0]] -= 1  # what the first sequence of the pattern takes
        while gap := capacity - sum(pattern):
            more = _complement(left, gap) or _longest(left, gap)
            if not more:
                break
            for x in more:
                left[x] -= 1
            pattern += more
        each = np.bincount(pattern, minlength=capacity + 1)
        used = np.flatnonzero(each)
        again = int((left[used] // each[used]).min())
        left[used] -= again * each[used]
        plan.append((again + 1, pattern))
    return plan


def _complement(left: np.ndarray, gap: int) -> list[int]:
    """One, two or three available lengths that sum to the gap; the longest first."""
    if left[gap]:
        return [gap]
    if pair := _pair(left, gap):
        return pair
    for c in np.flatnonzero(left[1 : gap - 1])[::-1] + 1:
        left[c] -= 1
        pair = _pair(left, gap - int(c))
        left[c] += 1
        if pair:
            return [int(c), *pair]
    return []


def _pair(left: np.ndarray, gap: int) -> list[int]:
    """Two available lengths that sum to the gap."""
    if gap < 2:
        return []
    a = np.arange(gap - 1, (gap - 1) // 2, -1)  # from gap - 1 down to its upper half
    ok = np.flatnonzero((left[a] > 0) & (left[gap - a] > (2 * a == gap)))
    return [int(a[ok[0]]), int(gap - a[ok[0]])] if len(ok) else []


def _longest(left: np.ndarray, gap: int) -> list[int]:
    fits = np.flatnonzero(left[: gap + 1])
    return [int(fits[-1])] if len(fits) else []


def pack(pieces: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` (any columns, among them ``length``) with sequence_id and offset.

    ``order`` names columns that tell pieces apart; equal pieces are
    interchangeable.  Pieces are written once, as the plan and the places are
    both made from them.  An empty table gives an empty one.
    """
    spark, kept = pieces.sparkSession, written(pieces, "pieces")
    n = kept.count()
    # numbers within a length are given by groups of a bounded size, so that a common length is no single task
    group = F.pmod(F.xxhash64(*order), F.lit(max(16, n // GROUP_ROWS)))
    grouped = kept.withColumn("__group", group)
    counts = grouped.groupBy("length", "__group").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("length").orderBy("__group").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select("length", "__group", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__first"))
    within = Window.partitionBy("length", "__group").orderBy(*order)
    numbered = grouped.withColumn("__at", F.row_number().over(within) - 1).join(firsts, ["length", "__group"])
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("__n").alias("n")).collect()}  # at most `capacity` rows
    slots, sequence, taken = [], 0, dict.fromkeys(histogram, 0)
    for times, pattern in packing_plan(histogram, capacity):
        offset = 0
        for length in pattern:
            slots.append((length, taken[length], taken[length] + times, sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    schema = "__length long, __from long, __to long, __sequence long, offset long"
    plan = F.broadcast(spark.createDataFrame(slots, schema))  # bounded by the capacity
    number = F.col("__first") + F.col("__at")
    placed = numbered.join(plan, (F.col("length") == F.col("__length")) & (number >= F.col("__from")) & (number < F.col("__to")))
    return placed.select(*pieces.columns, (F.col("__sequence") + number - F.col("__from")).alias("sequence_id"), "offset")


def packed_documents(docs: DataFrame) -> DataFrame:
    """Pieces of documents with a checksum in place of the ids, packed."""
    pieces = cut_documents(docs).select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return pack(pieces, ["doc_id", "piece", "start", "ids_crc32"])


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_documents(table(spark, sf_dir, "documents"))
