"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

A source is dealt into blocks: its documents in an order of hashes, cut into
ranges of hashes.  Its target says how many words the mix takes from it, so how
often the source is gone through and where the last pass ends: every block
before that place is taken whole, the block that holds it in part.  That gives
exact quotas of blocks by source.

The blocks of the mix are spread over output shards by a tree.  Its root holds
the quotas of all sources; a node gives each child its share of blocks, and how
many come from which source is a multivariate hypergeometric draw, so every
shard has the mix that a shuffle of all blocks would give it, without one.  At
a leaf the quota of each source is drawn: the next blocks of a permutation of
the source's blocks.  Shards are disjoint and complete by construction, and
rows are shuffled within their shard.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from .common import WORD, table, written

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2.0
#: Hash ranges into which each source is dealt.
BLOCKS = 1024
#: Output shards; a power of two, as the tree halves.
SHARDS = 64
SEED = 20


def word_count(text: str = "text") -> Column:
    return F.coalesce(F.size(F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0))), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """``sizes(source, source_size)`` with weight and target.

    Sources in order of code points (null last) take the weights in turn and
    share ``share`` times all sizes.  A target stops at ``most`` times its
    source's size; what goes beyond is shared again by weight until none is
    above.  That ends with one common level: a target is the smaller of its cap
    and its weight times the level.  With the sources in the order of cap per
    weight, the level follows from the caps before and the weights after.
    """
    if share > most:
        raise ValueError("the sources together hold less than is asked for")
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    listed = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int")))
    capped = listed.withColumn("cap", most * F.col("source_size")).withColumn("level", F.col("cap") / F.col("weight"))
    order = [F.col("level"), F.col("source").isNull(), F.col("source")]
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    after = Window.orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    # the level if all sources before this one are capped and this one and the rest are not
    level = (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    found = capped.withColumn("common", level)
    found = found.withColumn("common", F.max(F.when(F.col("common") <= F.col("level"), F.col("common"))).over(everything))
    return found.select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("weight") * F.col("common"), "cap")).alias("target"))


def _split(batches: Iterator[pa.RecordBatch], shards: int, total: int, seed: int) -> Iterator[pa.RecordBatch]:
    """Sources one after another through the tree: (source, shard, first, n), the blocks of the source's permutation that a shard gets.

    A node keeps how many blocks are still to come and how many of them go
    left; a source's blocks at a node go left by a hypergeometric draw.  Drawn
    source after source, that is the multivariate hypergeometric split, and
    memory holds the tree alone.
    """
    rng = np.random.default_rng(seed)
    # places of the nodes: node i has the children 2i and 2i + 1, leaves start at `shards`
    coming = np.zeros(2 * shards, np.int64)
    coming[1] = total
    for i in range(1, shards):
        coming[2 * i], coming[2 * i + 1] = (coming[i] + 1) // 2, coming[i] // 2
    for batch in batches:
        out = []
        for source, blocks in zip(batch["key"].to_pylist(), batch["blocks"].to_pylist()):
            here = np.zeros(2 * shards, np.int64)
            here[1] = blocks
            for i in range(1, shards):
                if here[i]:
                    left = int(rng.hypergeometric(coming[2 * i], coming[2 * i + 1], here[i]))
                    here[2 * i], here[2 * i + 1] = left, here[i] - left
            coming -= here
            first = 0
            for leaf in np.flatnonzero(here[shards:]):
                n = int(here[shards + leaf])
                out.append((source, int(leaf), first, n))
                first += n
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], names=["key", "shard", "first", "n"])


def planned(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, blocks: int = BLOCKS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """How the mix treats each row of ``docs(row, source, size)``, and the blocks that it takes.

    The first frame has row, size, source_size, target, key (the source), block,
    taken (words, repeats counted).  The second has key, pass, block: each once.
    Within a source the rows have an order by hash; the words that are taken of
    a pass are the first ones in it.  Rows are ranked within their block alone.
    """
    order = F.md5(F.concat_ws("|", F.lit(seed), "row", F.col("size"), "source").cast("binary"))
    rows = written(docs.select("row", "source", F.col("size").cast("long").alias("size"), order.alias("at")).withColumn("block", F.pmod(F.conv(F.substring("at", 1, 6), 16, 10).cast("int"), F.lit(blocks))), "sizes")
    by_block = rows.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    sources = by_block.groupBy("source").agg(F.sum("block_size").alias("source_size"))
    targets = written(source_targets(sources, weights, share, most).withColumn("key", F.xxhash64("source", F.col("source").isNull())), "targets")
    at_block = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    keyed = by_block.withColumn("key", F.xxhash64("source", F.col("source").isNull())).drop("source").join(targets.select("key", "source_size", "target"), "key")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    placed = (
        keyed.withColumn("passes", F.least(whole, F.lit(int(most))))
        .withColumn("rest", F.greatest(F.round(F.col("target")).cast("long") - F.col("passes") * F.col("source_size"), F.lit(0)))
        .withColumn("before", F.coalesce(F.sum("block_size").over(at_block), F.lit(0)))
    )
    placed = written(placed.select("key", "block", "block_size", "source_size", "target", "passes", "rest", "before"), "blocks")
    within = Window.partitionBy("key", "block").orderBy("at", "row", "size").rowsBetween(Window.unboundedPreceding, -1)
    of_rows = rows.withColumn("key", F.xxhash64("source", F.col("source").isNull())).drop("source").join(placed.drop("block_size"), ["key", "block"])
    of_rows = of_rows.withColumn("behind", F.col("before") + F.coalesce(F.sum("size").over(within), F.lit(0)))
    part = F.least(F.greatest(F.col("rest") - F.col("behind"), F.lit(0)), F.col("size"))
    of_rows = of_rows.select("row", "size", "source_size", "target", "key", "block", "passes", part.alias("part"), (F.col("passes") * F.col("size") + part).alias("taken"))
    each = F.sequence(F.lit(0), (F.col("passes") - F.when(F.col("rest") > F.col("before"), 0).otherwise(1)).cast("int"))
    used = F.when((F.col("passes") > 0) | (F.col("rest") > F.col("before")), each)
    return of_rows, placed.where("block_size > 0").select("key", "block", F.explode(used).alias("pass"))


def dealt(blocks: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``blocks(key, pass, block)`` with the shard that each goes to."""
    if shards < 1 or shards & (shards - 1):
        raise ValueError("the tree halves: shards are a power of two")
    blocks = written(blocks, "mix-blocks")
    quotas = blocks.groupBy("key").agg(F.count("*").alias("blocks"))
    total = blocks.count()
    leaves = quotas.coalesce(1).sortWithinPartitions("key").mapInArrow(lambda b: _split(b, shards, total, seed), "key long, shard int, first long, n long")
    permuted = Window.partitionBy("key").orderBy(F.xxhash64(F.lit(seed + 1), "key", "pass", "block"), "pass", "block")
    numbered = blocks.withColumn("number", F.row_number().over(permuted) - 1)
    return numbered.join(written(leaves, "quotas"), "key").where("number >= first AND number < first + n").select("key", "pass", "block", "shard")


def mixed(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """The mix: ``docs`` once for each pass that takes it, with pass, shard, place (its order in the shard) and words (how many are taken).

    A null source is a source, a null text has no words; rows without words
    are in no pass.  Rows that are equal in doc_id, text and source are told
    apart by nothing and are treated alike.  Reruns agree.  Columns of ``docs``
    that have the name of a result are replaced.
    """
    docs = docs.drop("pass", "shard", "place", "words")
    row = F.xxhash64("doc_id", "text", "source")
    keyed = docs.withColumn("__ml_row", row).withColumn("__ml_size", word_count())
    rows, used = planned(keyed.select(F.col("__ml_row").alias("row"), "source", F.col("__ml_size").alias("size")), weights, share, most, blocks, seed)
    passes = F.sequence(F.lit(0), (F.col("passes") - F.when(F.col("part") > 0, 0).otherwise(1)).cast("int"))
    copies = rows.where("taken > 0").groupBy("row", "key", "block", "size", "passes").agg(F.max("part").alias("part"))
    copies = copies.withColumn("pass", F.explode(passes)).withColumn("words", F.when(F.col("pass") < F.col("passes"), F.col("size")).otherwise(F.col("part")))
    copies = copies.join(dealt(used, shards, seed), ["key", "pass", "block"]).select(F.col("row").alias("__ml_row"), "pass", "shard", "words")
    return keyed.join(copies, "__ml_row").withColumn("place", F.xxhash64(F.lit(seed + 2), "__ml_row", "pass")).drop("__ml_row", "__ml_size")


def taken_words(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, blocks: int = BLOCKS, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """Per row of ``docs(row, source, size)``: row, size, source_size, target, taken (words in all passes, repeats counted) and the shards they are in."""
    rows, used = planned(docs, weights, share, most, blocks, seed)
    passes = dealt(used, shards, seed).groupBy("key", "block").agg(F.sort_array(F.collect_list(F.struct("pass", "shard"))).alias("dealt"))  # MOST passes at most
    words = F.transform("dealt", lambda x: F.when(x["pass"] < F.col("passes"), F.col("size")).otherwise(F.col("part")))
    taken = F.coalesce(F.aggregate(words, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))
    return rows.join(passes, ["key", "block"], "left").select("row", "size", "source_size", "target", taken.alias("taken"), F.col("dealt.shard").alias("shards"))


def as_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix with the columns of ``docs``: a document stands in it once for each pass, in part where a source's last pass ends.

    The part is the first words, joined by single spaces.  Rows come shard by
    shard, and within a shard in the order of their place, so what is written
    of them is shuffled.
    """
    whole = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__ml_all"))
    rows = mixed(whole, **how).repartition("shard").sortWithinPartitions("shard", "place")
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    text = F.when(F.size(words) <= F.col("words"), F.col("text")).otherwise(F.array_join(F.slice(words, 1, F.col("words").cast("int")), " "))
    new = {"text": text} | ({"n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*[new.get(c, F.col(f"__ml_all.`{c}`")).alias(c) for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row"), "source", word_count().alias("size"))
    return taken_words(docs).select(F.col("row").alias("doc_id"), "size", "source_size", "target", "taken")


OP9_SQL = f"""
WITH docs AS (
    SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size FROM documents
), sized AS (
    SELECT *, md5(concat_ws('|', '{SEED}', CAST(doc_id AS VARCHAR), CAST(size AS VARCHAR), source)) AS place FROM docs
), rows AS (
    SELECT *, CAST('0x' || substr(place, 1, 6) AS INTEGER) % {BLOCKS} AS block FROM sized
), sources AS (
    SELECT source, sum(size) AS source_size FROM rows GROUP BY source
), weighed AS (
    SELECT *, CASE (row_number() OVER (ORDER BY (source IS NULL), encode(source)) - 1) % 3 WHEN 0 THEN {WEIGHTS[0]} WHEN 1 THEN {WEIGHTS[1]} ELSE {WEIGHTS[2]} END::DOUBLE AS weight, {MOST} * source_size::DOUBLE AS cap FROM sources
), levels AS (
    SELECT *, cap / weight AS level,
        ({SHARE} * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, (source IS NULL), source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(weight) OVER (ORDER BY cap / weight, (source IS NULL), source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS common FROM weighed
), targets AS (
    SELECT source, CAST(source_size AS BIGINT) AS source_size, least(cap, weight * max(CASE WHEN common <= level THEN common END) OVER ()) AS target FROM levels
), placed AS (
    SELECT r.*, t.source_size, t.target, coalesce(sum(size) OVER (PARTITION BY r.source ORDER BY block, place, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS behind,
        CASE WHEN t.source_size > 0 THEN CAST(floor(t.target / t.source_size) AS BIGINT) ELSE 0 END AS passes
    FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
    CAST(passes * size + least(greatest(CAST(round(target) AS BIGINT) - passes * source_size - behind, 0), size) AS BIGINT) AS taken
FROM placed
"""
