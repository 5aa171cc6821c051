"""Audit of how filters interact, by contractions of contingency tensors.

Each document passes or fails each of five filters, so the documents of a part
are a 2x2x2x2x2 tensor of counts: axis by axis, index 0 for passing and 1 for
failing.  Spark makes the tensors in one aggregation; they are all that is left
of the documents.  What a step of an order keeps, removes or finds already
gone is a contraction of the part's tensor with one vector per axis: those that
pass, those that fail, or all.  All steps of all orders are one einsum.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table

FILTERS = "ABCDE"
#: Fixed values of the filters: fewest words, least share of distinct words, most share of capitals (both in hundredths), forbidden characters.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS, FORBIDDEN = 50, 65, 5, "[#$%&*|]"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Keys among which rows without a doc_id are dealt, as they find no label.
SALTS = 4096

_PASS, _FAIL, _ALL = np.array([[1, 0], [0, 1], [1, 1]], np.int64)


def failures(docs: DataFrame) -> DataFrame:
    """part, doc_id, code (a bit for each of the filters A to D that fails) and digest, which equal texts share.

    A null text counts as empty, a null source as the empty part.
    """
    text = F.coalesce("text", F.lit(""))
    words = F.array_remove(F.split("_text", r"[\x20\x09-\x0D]+"), "")
    n_words, n_distinct, n_chars = F.size("_words"), F.size(F.array_distinct("_words")), F.length("_text")
    n_capitals = n_chars - F.length(F.translate("_text", CAPITALS, ""))
    fails = (
        n_words < LEAST_WORDS,
        n_distinct.cast("long") * 100 < n_words.cast("long") * LEAST_DISTINCT,
        n_capitals.cast("long") * 100 > n_chars.cast("long") * MOST_CAPITALS,
        F.col("_text").rlike(FORBIDDEN),
    )
    code = sum((F.when(fail, 1 << i).otherwise(0) for i, fail in enumerate(fails)), F.lit(0))
    rows = docs.select(F.coalesce("source", F.lit("")).alias("part"), F.col("doc_id").cast("long").alias("doc_id"), text.alias("_text"))
    return rows.withColumn("_words", words).select("part", "doc_id", code.cast("int").alias("code"), F.unhex(F.sha2("_text", 256)).alias("digest"))


def tensors(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (part, code, rows, good, toxic): documents by the set of filters that they fail, E included.

    E is failed by a text that a document with a smaller doc_id has as well,
    wherever that is; rows without a doc_id neither fail it nor make others
    fail.  Rows of one id and text count as often as they stand.  A document is
    good or toxic if any of its labels says so.

    Equal rows are summed before anything meets by text, so a text with a
    third of all documents is one row per part when its smallest id is sought.
    """
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id"), F.lit(0).alias("_zero")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"), F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic")
    )
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest", "part"), F.lit(SALTS))).otherwise(0)
    rows = failures(docs).withColumn("salt", salt.cast("int"))
    marked = rows.join(marks, (F.col("doc_id") == F.col("_id")) & (F.col("salt") == F.col("_zero")), "left")
    kinds = ["part", "code", "digest", "good", "toxic"]
    marked = marked.select("doc_id", "salt", "part", "code", "digest", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    by_document = marked.groupBy("doc_id", "salt", *kinds).agg(F.count(F.lit(1)).alias("n"))
    by_text = by_document.groupBy(*kinds).agg(
        F.sum("n").alias("n"),
        F.sum(F.when(F.col("doc_id").isNull(), F.col("n")).otherwise(0)).alias("unplaced"),
        F.min("doc_id").alias("least"),
        F.min_by("n", "doc_id").alias("at_least"),
    )
    firsts = by_text.groupBy("digest").agg(F.min("least").alias("first"))
    own = by_text.join(firsts, "digest")
    first = F.col("unplaced") + F.when(F.col("least") == F.col("first"), F.col("at_least")).otherwise(0)
    both = F.array(F.struct(F.lit(0).alias("e"), first.alias("n")), F.struct(F.lit(16).alias("e"), (F.col("n") - first).alias("n")))
    each = own.select("part", "code", "good", "toxic", F.explode(both).alias("x")).where("x.n > 0")
    n = F.col("x.n")
    return each.groupBy("part", (F.col("code") + F.col("x.e")).alias("code")).agg(
        F.sum(n).alias("rows"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic")
    )


ORDERS = ["".join(p) for p in itertools.permutations(FILTERS)]


def contracted(counts: np.ndarray, choice: np.ndarray) -> np.ndarray:
    """``counts[k, a, b, c, d, e]`` contracted with ``choice[s, axis, index]`` to a number for each s and k."""
    return np.einsum("kabcde,sa,sb,sc,sd,se->sk", counts, *(choice[:, i] for i in range(len(FILTERS))))


def _choices() -> dict[str, np.ndarray]:
    """For each step of each order, in turn, the vector that each axis is contracted with."""
    steps = [(order, i) for order in ORDERS for i in range(len(FILTERS))]
    out = {name: np.tile(_ALL, (len(steps), len(FILTERS), 1)) for name in ("kept", "removed", "failing")}
    out["only"] = np.tile(_PASS, (len(steps), len(FILTERS), 1))
    for s, (order, i) in enumerate(steps):
        earlier, own = [FILTERS.index(f) for f in order[:i]], FILTERS.index(order[i])
        out["kept"][s, [*earlier, own]] = _PASS
        out["removed"][s, earlier] = _PASS
        for name in ("removed", "failing", "only"):
            out[name][s, own] = _FAIL
    return out


CHOICES = _choices()
_STEPS = len(FILTERS)


def audit_of(counts: np.ndarray) -> dict[str, np.ndarray]:
    """All columns of a part's audit, a row for each step of each order; ``counts`` has rows, good and toxic by code."""
    # the bit of A is the least, so the last axis of the reshaped codes
    cube = counts.reshape(3, *[2] * _STEPS).transpose(0, 5, 4, 3, 2, 1)
    removed = contracted(cube, CHOICES["removed"])
    failing = contracted(cube[:1], CHOICES["failing"])[:, 0]
    own = np.array([FILTERS.index(f) for order in ORDERS for f in order])
    return {
        "kept": contracted(cube[:1], CHOICES["kept"])[:, 0],
        "removed": removed[:, 0],
        "redundant": failing - removed[:, 0],
        "unique_fails": contracted(cube[:1], CHOICES["only"])[:, 0],
        "good_lost": removed[:, 1],
        "toxic_lost": removed[:, 2],
        "shapley": np.array([removed[own == i, 0].sum() for i in range(_STEPS)])[own],
    }


_COLUMNS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def _audited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    orders = pa.array([order for order in ORDERS for _ in range(_STEPS)])
    steps = pa.array(list(range(1, _STEPS + 1)) * len(ORDERS), pa.int32())
    for batch in batches:
        for part, cells in zip(batch["part"].to_pylist(), batch["cells"]):
            counts = np.zeros((3, 1 << _STEPS), np.int64)
            for c in cells.as_py():
                counts[:, c["code"]] = c["rows"], c["good"], c["toxic"]
            found = audit_of(counts)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(orders)), orders, steps, *map(pa.array, found.values())], names=["part", "filter_order", "step", *found])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """For each part, order of the filters and step: what the step keeps, removes and finds already gone.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic;
    further columns don't matter.  An empty table gives no rows.
    """
    cells = tensors(docs.select("doc_id", "text", "source"), labels.select("doc_id", "quality", "toxic"))
    by_part = cells.groupBy("part").agg(F.collect_list(F.struct("code", "rows", "good", "toxic")).alias("cells"))  # 32 at most
    return by_part.mapInArrow(_audited, _COLUMNS)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP12_SQL = r"""
WITH rows AS (
    SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), marks AS (
    SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
    FROM labels GROUP BY doc_id
), failing AS (
    SELECT r.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
           CAST(len(words) < 50 AS INTEGER) AS a,
           CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INTEGER) AS b,
           CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS INTEGER) AS c,
           CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) AS d,
           CAST(coalesce(r.doc_id > min(r.doc_id) OVER (PARTITION BY text), false) AS INTEGER) AS e
    FROM rows r LEFT JOIN marks m ON r.doc_id = m.doc_id
), cells AS (
    SELECT part, [a, b, c, d, e] AS fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic
    FROM failing GROUP BY part, [a, b, c, d, e]
), letters AS (SELECT unnest([1, 2, 3, 4, 5]) AS f
), orders AS (
    SELECT [p.f, q.f, r.f, s.f, t.f] AS o FROM letters p, letters q, letters r, letters s, letters t
    WHERE len(list_distinct([p.f, q.f, r.f, s.f, t.f])) = 5
), steps AS (
    SELECT o, list_reduce(list_transform(o, lambda f: substr('ABCDE', f, 1)), lambda x, y: x || y) AS filter_order, f AS step, o[f] AS own, o[1:f - 1] AS earlier
    FROM orders, letters
), found AS (
    SELECT part, filter_order, step, own, n, good, toxic, fails[own] = 1 AS fail,
           list_sum(list_transform(earlier, lambda f: fails[f])) > 0 AS gone, list_sum(fails) = 1 AS alone
    FROM cells, steps
), sums AS (
    SELECT part, filter_order, step, own,
           sum(CASE WHEN NOT coalesce(gone, false) AND NOT fail THEN n ELSE 0 END) AS kept,
           sum(CASE WHEN NOT coalesce(gone, false) AND fail THEN n ELSE 0 END) AS removed,
           sum(CASE WHEN coalesce(gone, false) AND fail THEN n ELSE 0 END) AS redundant,
           sum(CASE WHEN alone AND fail THEN n ELSE 0 END) AS unique_fails,
           sum(CASE WHEN NOT coalesce(gone, false) AND fail THEN good ELSE 0 END) AS good_lost,
           sum(CASE WHEN NOT coalesce(gone, false) AND fail THEN toxic ELSE 0 END) AS toxic_lost
    FROM found GROUP BY part, filter_order, step, own
)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM sums
"""
