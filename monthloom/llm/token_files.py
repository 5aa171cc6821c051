"""Token-id files: one array of ids per block, with Elias-Fano coded document boundaries.

The file format is a folder of Parquet files, one per range of document ids,
whose rows are blocks.  A block holds whole documents in ascending order:

* ``shard``, ``block``: place in the order of files and of blocks in a file;
* ``first_id``: ids before the block in its file;
* ``doc_ids``: the documents' ids;
* ``ids``: all ids one after another, ``width`` bytes each, little-endian;
* ``low``, ``low_bits``, ``high``: the boundaries (where each document ends),
  Elias-Fano coded: the low bits of each value packed, the rest as a bit
  vector in which value i is the one-bit at ``(value >> low_bits) + i``.  A
  boundary costs at most two bits more than the logarithm of the mean length.

Documents are read by ``EliasFano.select``, which finds boundaries with a
directory of 32 bits for each 64 bits of ``high``, made on reading, about one
bit a document; no table of 64-bit offsets is stored or made of a file.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import tokens
from .common import batches_of, lean, shared_folder, table

BLOCK_SCHEMA = "shard int, block int, first_id long, n_docs long, n_ids long, doc_ids array<bigint>, width int, ids binary, low_bits int, low binary, high binary"
#: Characters by which rows of one id, or without any, are dealt to files.
TIE_CHARS = 32
#: Documents of a block that are read together.
READ_DOCS = 1 << 12
_BITS = (np.arange(256)[:, None] >> np.arange(8)) & 1
#: By byte: how many bits are set, and where the first, second, ... of them is.
_POPCOUNT = _BITS.sum(1).astype(np.uint8)
_SELECT = np.argsort(1 - _BITS, axis=1, kind="stable")


class EliasFano:
    """A non-decreasing list of numbers in near-minimal space."""

    def __init__(self, n: int, low_bits: int, low: bytes, high: bytes):
        self.n, self.low_bits, self.low, self.high = n, low_bits, np.frombuffer(low, np.uint8), np.frombuffer(high, np.uint8)
        self._before = None

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.int64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max(0, (top // n).bit_length() - 1) if n else 0
        ones = np.zeros((top >> bits) + n + 1, np.uint8)
        ones[(values >> bits) + np.arange(n)] = 1
        low = ((values[:, None] >> np.arange(bits)) & 1).astype(np.uint8).ravel()
        return cls(n, bits, np.packbits(low, bitorder="little").tobytes(), np.packbits(ones, bitorder="little").tobytes())

    def select(self, i) -> np.ndarray:
        """Values number i (a number or an array of them): the i-th one-bits, found by the counts of ones before each 64 bits.

        Within its 64 bits a one-bit is found by the counts of their bytes, and
        by a table of the bits of a byte.
        """
        i = np.asarray(i, np.int64)
        if i.size and not (0 <= i.min() and i.max() < self.n):
            raise IndexError(i)
        if self._before is None:
            self._bytes = np.append(self.high, np.zeros(-len(self.high) % 8, np.uint8)).reshape(-1, 8)
            ones = _POPCOUNT[self._bytes].sum(1, dtype=np.uint32)
            self._before = np.cumsum(ones, dtype=np.uint32) - ones
        block = np.searchsorted(self._before, i, "right") - 1
        here = self._bytes[block]
        upto = np.cumsum(_POPCOUNT[here], axis=-1, dtype=np.int64)
        rank = i - self._before[block]
        byte = (upto <= rank[..., None]).sum(-1)
        inside = np.take_along_axis(here, byte[..., None], -1)[..., 0]
        rank = rank - np.take_along_axis(upto, byte[..., None], -1)[..., 0] + _POPCOUNT[inside]
        at = block * 64 + byte * 8 + _SELECT[inside, rank]
        first = i[..., None] * self.low_bits + np.arange(self.low_bits)
        low = ((self.low[first // 8] >> (first % 8).astype(np.uint8)) & 1).astype(np.int64) << np.arange(self.low_bits)
        return ((at - i) << self.low_bits) | low.sum(-1)


def _block(shard: int, block: int, first: int, docs: list, bodies: list[np.ndarray], width: int) -> dict:
    ids = np.concatenate(bodies) if bodies else np.zeros(0, "<u4")
    ends = EliasFano.of(np.cumsum([len(x) for x in bodies]))
    return {"shard": shard, "block": block, "first_id": first, "n_docs": len(docs), "n_ids": len(ids), "doc_ids": docs, "width": width, "ids": ids.astype(f"<u{width}").tobytes(), "low_bits": ends.low_bits, "low": ends.low.tobytes(), "high": ends.high.tobytes()}


_BLOCK_ARROW = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("width", pa.int32()), ("ids", pa.binary()), ("low_bits", pa.int32()), ("low", pa.binary()), ("high", pa.binary())])


def write_token_files(docs: DataFrame, path: str, vocabulary: tuple = tokens.WORD_BPE, end_id: int = 1, block_ids: int = 1 << 20) -> None:
    """Encode ``docs(doc_id, text)`` and write the ids to ``path`` in ascending doc_id order.

    Null ids come first, rows with one id in the order of their texts; a null
    text is an empty one, whose only id is ``end_id``.  Files are cut between ids,
    and between rows of one id by how their texts begin.  Further columns are
    ignored.  An empty table makes an empty folder.  A block ends with the
    document that fills it, so a task holds one block and one batch.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(*vocabulary)
        width = 2 if coder.tokenizer.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
        shard, block, first, held, docs_, bodies = TaskContext.get().partitionId(), 0, 0, 0, [], []
        end = np.array([end_id], "<u4")
        for whole in batches:
            for batch in batches_of(whole, "text", 8 << 20):
                ids, begins = coder.encode(batch["text"])
                for i, doc in enumerate(batch["doc_id"].to_pylist()):
                    body = np.concatenate([ids[begins[i] : begins[i + 1]], end])
                    docs_.append(doc)
                    bodies.append(body)
                    held += len(body)
                    if held >= block_ids:
                        yield pa.RecordBatch.from_pylist([_block(shard, block, first, docs_, bodies, width)], _BLOCK_ARROW)
                        first, block, held, docs_, bodies = first + held, block + 1, 0, [], []
        if docs_:
            yield pa.RecordBatch.from_pylist([_block(shard, block, first, docs_, bodies, width)], _BLOCK_ARROW)

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id", F.substring("text", 1, TIE_CHARS)).sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(lambda b: lean(encode(b)), BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: doc_id, start (ids of all documents before it), n_tokens and its ids (unsigned 32-bit, little-endian)."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = batch.slice(i, 1)
                value = lambda name: row[name][0].as_py()  # noqa: B023, E731
                ids = np.frombuffer(value("ids"), f"<u{value('width')}").astype("<u4")
                boundaries, data = EliasFano(value("n_docs"), value("low_bits"), value("low"), value("high")), pa.py_buffer(ids)
                for at in range(0, value("n_docs"), READ_DOCS):
                    some = np.arange(at, min(at + READ_DOCS, value("n_docs")))
                    ends = boundaries.select(some)
                    begins = np.append(boundaries.select(at - 1) if at else 0, ends[:-1])
                    offsets = pa.py_buffer((np.append(begins[:1], ends) * 4).astype(np.int32))
                    yield pa.RecordBatch.from_arrays([
                        row["doc_ids"].flatten().slice(at, len(some)),
                        pa.array(np.full(len(some), value("shard")), pa.int32()),
                        pa.array(value("first_id") + begins),
                        pa.array(ends - begins),
                        pa.Array.from_buffers(pa.binary(), len(some), [None, offsets, data]),
                    ], names=["doc_id", "shard", "first", "n_tokens", "ids"])

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    # one row per file: ids in the files before it
    totals = [(r.shard, r.n) for r in blocks.groupBy("shard").agg(F.sum("n_ids").alias("n")).sort("shard").collect()]
    before, sum_ = [], 0
    for shard, n in totals:
        before += [F.lit(shard), F.lit(sum_).cast("long")]
        sum_ += n
    rows = blocks.mapInArrow(decode, "doc_id long, shard int, first long, n_tokens long, ids binary")
    base = F.element_at(F.create_map(*before), F.col("shard")) if before else F.lit(0).cast("long")
    return rows.select("doc_id", (F.col("first") + base).alias("start"), "n_tokens", "ids")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_folder(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), path)
    return read_token_files(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
