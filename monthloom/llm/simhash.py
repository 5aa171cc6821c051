"""SimHash near-duplicates by an inverted index of positional bytes.

A fingerprint of 64 bits is eight bytes at eight positions.  Two fingerprints
that differ in at most three bits share at least five of them; that is the
guaranteed minimum of matches.  Posting lists of single bytes would hold
1/256 of all rows each, so the index holds their intersections: a posting is
four positions and their bytes.  The fourteen sets of four positions whose
numbers XOR to zero are enough: any three positions lie in exactly one of them,
and the other four positions are one of them as well, so whichever three bytes
differ, some indexed set of four agrees.  Pairs in a posting list are tallied
over all eight positions, kept from the minimum on, and verified by bits.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import lean, table, written
from .components import connected_components

#: Four positions of eight whose numbers XOR to zero.
POSITIONS = sorted({tuple(sorted((a, b, c, a ^ b ^ c))) for a, b, c in itertools.combinations(range(8), 3)})
#: Fingerprints of one posting list that a task compares with each other at a time.
LIST_PART = 2048
PAIRS_AT_ONCE = 1 << 20
SEED = 42


def fingerprint(text: str, shingle: int = 3) -> int:
    """64 bits, each set where more than half of the shingles' hashes have it.

    Words are lower-cased A-Z and separated by ASCII white space; a text with
    fewer words than a shingle is one shingle, one without words has zero.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_digest  # big-endian bytes
    hashes = b"".join([digest(joined[a:b], SEED) for a, b in zip((ends - size)[:n].tolist(), ends[shingle - 1 :].tolist())])
    bits = np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(n, 8), axis=1)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, 255):  # so that sums fit in a byte
        counts += bits[i : i + 255].sum(0, dtype=np.uint8)
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3, keys: list[str] | None = None) -> DataFrame:
    """``keys`` (doc_id by default) and fp, the fingerprint as a signed long; a null text counts as empty."""
    keys = keys or ["doc_id"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(x or "", shingle) for x in (t.as_py() for t in batch["text"])], np.uint64)
            yield pa.RecordBatch.from_arrays([*(batch[k] for k in keys), pa.array(fp.view(np.int64))], names=[*keys, "fp"])

    kinds = dict(docs.dtypes)
    return docs.select(*keys, "text").mapInArrow(lambda b: lean(rows(b)), ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", fp long")


def _postings(fps: DataFrame) -> DataFrame:
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(8)]
    key = [sum((F.shiftleft(byte[p], 8 * i) for i, p in enumerate(some)), F.lit(0).cast("long")) for some in POSITIONS]
    each = F.array(*[F.struct(F.lit(i).alias("set"), k.alias("key")) for i, k in enumerate(key)])
    return fps.select("fp", F.explode(each).alias("p")).select("fp", "p.set", "p.key")


def _near(a: np.ndarray, b: np.ndarray, max_bits: int) -> np.ndarray:
    differ = a ^ b
    shared = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1)  # the tally of positional bytes
    some = np.flatnonzero(shared >= 8 - max_bits)
    return some[np.bitwise_count(differ[some]) <= max_bits]


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component, of n nodes under links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _links_within(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """Links that connect what is near within each list: one fewer than fingerprints at most."""
    for batch in batches:
        lists = batch["fps"]
        values, offsets = lists.flatten().to_numpy().view(np.uint64), np.diff(lists.offsets.to_numpy())
        ends = np.repeat(np.cumsum(offsets), offsets)
        after = ends - np.arange(len(values)) - 1  # members of its list that follow each
        total = np.cumsum(after)
        lefts, rights, begin = [], [], 0
        while begin < len(values):
            end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + PAIRS_AT_ONCE, "right")))
            reps = after[begin:end]
            left = np.repeat(np.arange(begin, end), reps)
            right = left + 1 + np.arange(len(left)) - np.repeat(np.cumsum(reps) - reps, reps)
            near = _near(values[left], values[right], max_bits)
            lefts.append(left[near])
            rights.append(right[near])
            begin = end
        if lefts:
            root = _forest(len(values), np.concatenate(lefts), np.concatenate(rights))
            hung = np.flatnonzero(root != np.arange(len(values)))
            yield pa.RecordBatch.from_arrays([pa.array(values[hung].view(np.int64)), pa.array(values[root[hung]].view(np.int64))], names=["a", "b"])


def _links_across(batches: Iterator[pa.RecordBatch], max_bits: int) -> Iterator[pa.RecordBatch]:
    """The same between two parts of one long list."""
    for batch in batches:
        for one, other in zip(batch["fps"], batch["others"]):
            x, y = (np.array(v.values.to_numpy()).view(np.uint64) for v in (one, other))
            step = max(1, PAIRS_AT_ONCE // len(y))
            lefts, rights = [], []
            for i in range(0, len(x), step):
                part = x[i : i + step]
                near = _near(np.repeat(part, len(y)), np.tile(y, len(part)), max_bits)
                lefts.append(i + near // len(y))
                rights.append(len(x) + near % len(y))
            values = np.concatenate([x, y])
            root = _forest(len(values), np.concatenate(lefts), np.concatenate(rights))
            hung = np.flatnonzero(root != np.arange(len(values)))
            yield pa.RecordBatch.from_arrays([pa.array(values[hung].view(np.int64)), pa.array(values[root[hung]].view(np.int64))], names=["a", "b"])


def near_links(fps: DataFrame, max_bits: int = 3, list_part: int = LIST_PART) -> DataFrame:
    """Links ``(a, b)`` that connect exactly the distinct ``fps(fp)`` within ``max_bits`` of each other.

    Not every near pair becomes a row: in each posting list the near pairs are
    reduced to a spanning forest.  A list longer than ``list_part`` is dealt
    into parts by hash, and its pairs of parts are tasks of their own.
    """
    if not 0 <= max_bits <= 3:
        raise ValueError("four shared positions are certain for up to three bits")
    postings = _postings(fps)
    sizes = postings.groupBy("set", "key").agg(F.count("*").alias("n")).where("n > 1")
    lists = (
        postings.join(sizes, ["set", "key"])
        .withColumn("parts", F.ceil(F.col("n") / list_part).cast("int"))
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .groupBy("set", "key", "part", "parts")
        .agg(F.collect_list("fp").alias("fps"))
    )
    within = lists.select("fps").mapInArrow(lambda b: _links_within(b, max_bits), "a long, b long")
    long = lists.where("parts > 1")
    others = long.select("set", "key", F.col("part").alias("other"), F.col("fps").alias("others"))
    across = long.join(others, ["set", "key"]).where("part < other").select("fps", "others").mapInArrow(lambda b: _links_across(b, max_bits), "a long, b long")
    return within.union(across)


def near_duplicates(rows: DataFrame, max_bits: int = 3) -> DataFrame:
    """``rows`` with an ``fp`` column, and ``root``: one fingerprint for all that are linked.

    Copies share a fingerprint and so meet once, as one row; only distinct
    fingerprints are compared.  A fingerprint without a near one is its own root.
    """
    links = near_links(rows.select("fp").distinct(), max_bits)
    roots = connected_components(links).select(F.col("node").alias("fp"), "root")
    return rows.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicate_classes(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id linked).

    Null texts count as empty, all texts without words share a fingerprint, and
    a null doc_id is the smallest of a component only if it has no other.
    Repeated rows stay; an empty table gives an empty one; further columns are
    ignored.
    """
    classes = near_duplicates(written(fingerprints(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), shingle), "fingerprints"), max_bits)
    smallest = classes.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return classes.join(smallest, "root").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each_class(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """The rows of ``docs`` of which no near-duplicate with a smaller doc_id exists.

    All columns stay.  Among rows with the smallest doc_id of a class (a null
    one counts as largest) the one with the smallest hash of all columns
    stays; of wholly equal rows, one.
    """
    key = ["__ml_null", "__ml_id", "__ml_row"]
    keyed = docs.select("*", F.col("doc_id").isNull().alias(key[0]), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias(key[1]), F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]).alias(key[2]))
    rows = written(fingerprints(keyed, shingle, key), "fingerprints")
    first = near_duplicates(rows, max_bits).groupBy("root").agg(F.min(F.struct(*key)).alias("k")).select("k.*")
    return keyed.join(first, key, "left_semi").dropDuplicates(key).select(*[F.col(f"`{c}`") for c in docs.columns])


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_classes(table(spark, sf_dir, "documents"))
