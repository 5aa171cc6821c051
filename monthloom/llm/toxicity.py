"""Toxicity by class-conditional Kneser-Ney models of how words are spelled.

Two models, of toxic and of ordinary text, give every word a probability letter
by letter; each letter is conditioned on up to ``ORDER - 1`` letters before it
within the word.  From order ``SHARED + 1`` on, the counts are those of the
class; below, both back off to one distribution of continuation counts
(distinct letters before) over both classes, so a rare expression that neither
class tells apart gets the same probability from both.

The two log-likelihoods of a word are compared per letter.  A document's
evidence are its three words (repeats count) with the largest difference, as a
long document is as toxic as its worst expressions, however much else it says;
the mean over its words; and the logarithm of their number, as many words hold
an odd one by chance.  A logistic curve turns evidence into a score.  It is
fitted with models that have not seen the curve's fold; the models that score
have.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import batches_of, discard, lean, table, written

ORDER = 5
SHARED = 2
DISCOUNT = 0.9
#: Words and n-grams, the commonest, whose scores all tasks get; those of others are joined.
COMMON_WORDS = COMMON_GRAMS = 400_000
#: Labelled documents, at most, on which the curve is fitted.
CURVE_ROWS = 20_000
#: Of five folds by the document's id, the one that is held out and the one that only the curve sees.
FOLDS, HELD_OUT, CURVE_FOLD = 5, 0, 1
BATCH_BYTES, WORD_BYTES = 4 << 20, 1 << 18
#: Letters whose n-grams are looked at together.
LETTERS = 1 << 18
_NO_EVIDENCE = -20.0
_BEGIN, _END = 2, 3


def fold(doc_id: str = "doc_id"):
    """crc32 of the id as text, modulo five; null ids are in the held-out fold."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(FOLDS)), F.lit(HELD_OUT))


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case runs of letters and digits, and each text's first."""
    rows = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(texts, "")).cast(pa.large_string()), r"[^\p{L}\p{M}\p{N}]+")
    return rows.flatten(), rows.offsets.to_numpy().astype(np.int64) - rows.offsets[0].as_py()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def _grams(words: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]]:
    """The word of each letter; and by order, a key of the n-gram that ends there and whether it lies within the word.

    A word begins and ends with a sign of its own; the first sign is no letter
    to predict.  Letters come in portions, so a word may be of any length; a
    portion begins with the last letters of the one before, where no n-gram ends.
    """
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), "<u4")
    starts = np.cumsum(sizes) - sizes
    for begin in range(0, len(codes), LETTERS):
        low = max(0, begin - ORDER + 1)
        at = np.arange(low, min(len(codes), begin + LETTERS))
        owner = np.searchsorted(starts, at, "right") - 1
        place, letter = at - starts[owner], codes[at].astype(np.uint64) + np.uint64(1)
        keys, fits = [np.zeros(len(at), np.uint64)], [(at >= begin) & (place > 0)]
        for k in range(1, ORDER + 1):
            before = np.append(np.zeros(1, np.uint64), keys[-1][:-1])
            keys.append(_mix(before * np.uint64(0xC2B2AE3D27D4EB4F) + letter if k > 1 else letter))
            fits.append(fits[0] & (place >= k - 1))
        # keys[k] at i is the key of the k-gram ending at i: the (k-1)-gram ending at i - 1, and the letter at i
        yield owner, keys, fits


def _id_of(word: str) -> int:
    """The identifier that xxhash64 of Spark gives."""
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), 42)


class _Known:
    """Values by key, of which some are known."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        order = np.argsort(keys)
        self.keys, self.values = keys[order], [v[order] for v in values]

    def __call__(self, keys: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Whether each key is known, and the values of those that are."""
        if not len(self.keys):
            return np.zeros(len(keys), bool), [np.zeros(0) for _ in self.values]
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        there = self.keys[at] == keys
        return there, [v[at[there]] for v in self.values]


def commonest(rows: DataFrame, most: int) -> DataFrame:
    """Rows with the largest ``n``, down to a level that ``most`` of them reach at most.

    Levels are quarters of a power of two, so there are few hundred of them.
    """
    level = F.floor(F.log2("n") * 4)
    total, least = 0, None
    for r in rows.groupBy(level.alias("level")).agg(F.count("*").alias("rows")).orderBy(F.desc("level")).collect():
        total += r["rows"]
        if total > most:
            break
        least = r["level"]
    return rows.limit(0) if least is None else rows.where(level >= least)


#: Counts by class, of the folds that the curve's models see and of the curve's own.
COUNTS = ("ordinary", "toxic", "ordinary_curve", "toxic_curve")
_WORDS = "word string, ordinary long, toxic long, ordinary_curve long, toxic_curve long"


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for batch in batches_of(whole, "text", BATCH_BYTES):
            words, begins = _words(batch["text"])
            coded = words.dictionary_encode()
            kind = np.repeat(batch["kind"].to_numpy(), np.diff(begins))
            n, at = len(coded.dictionary), coded.indices.to_numpy()
            yield pa.RecordBatch.from_arrays([coded.dictionary.cast(pa.string()), *(pa.array(np.bincount(at[kind == i], minlength=n)) for i in range(len(COUNTS)))], names=["word", *COUNTS])


_GRAM = "k int, gram long, context long, suffix long"
_GRAMS = f"{_GRAM}, ordinary long, toxic long, ordinary_curve long, toxic_curve long"


def _distinct_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Portion by portion and by order, the distinct n-grams, each with what it is conditioned on and what it continues.

    With them, of each occurrence: the n-gram, the row of its word, and whether
    it is the longest that ends there; and the batch.
    """
    for whole in batches:
        for batch in batches_of(whole, "word", WORD_BYTES):
            for owner, keys, fits in _grams(batch["word"].to_pylist()):
                for k in range(1, ORDER + 1):
                    at = np.flatnonzero(fits[k])
                    gram, first, inverse = np.unique(keys[k][at], return_index=True, return_inverse=True)
                    context = keys[k - 1][at[first] - 1] if k > 1 else np.zeros(len(gram), np.uint64)
                    suffix = keys[k - 1][at[first]] if k > 1 else np.zeros(len(gram), np.uint64)
                    longest = ~fits[k + 1][at] if k < ORDER else np.ones(len(at), bool)
                    yield [pa.array(np.full(len(gram), k, np.int32)), *(pa.array(x.view(np.int64)) for x in (gram, context, suffix))], inverse, owner[at], longest, batch


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams of word types, with their counts."""
    for grams, inverse, owner, _, batch in _distinct_grams(batches):
        counts = [np.bincount(inverse, batch[c].to_numpy()[owner], len(grams[0])).astype(np.int64) for c in COUNTS]
        yield pa.RecordBatch.from_arrays([*grams, *map(pa.array, counts)], names=["k", "gram", "context", "suffix", *COUNTS])


def _asked_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """n-grams of words that are to be scored, with the number of letters for which each is the longest."""
    for grams, inverse, _, longest, _ in _distinct_grams(batches):
        n = np.bincount(inverse[longest], minlength=len(grams[0])).astype(np.int64)
        yield pa.RecordBatch.from_arrays([*grams, pa.array(n)], names=["k", "gram", "context", "suffix", "n"])


_SPELLED = "id long, n long, curve double, all double, whole boolean, rare array<struct<k:int,gram:long,n:long>>"


def _spelled(batches: Iterator[pa.RecordBatch], known: _Known) -> Iterator[pa.RecordBatch]:
    """By word and portion of its letters: the sums over letters whose longest n-gram is known, and the n-grams of the others."""
    for whole in batches:
        for batch in batches_of(whole, "word", WORD_BYTES):
            ids, letters = batch["id"].to_numpy(), pc.utf8_length(batch["word"]).to_numpy()
            for owner, keys, fits in _grams(batch["word"].to_pylist()):
                at = np.flatnonzero(fits[1])
                k = np.sum([f[at] for f in fits[1:]], axis=0)
                gram = np.choose(k - 1, [x[at] for x in keys[1:]]) if len(at) else np.zeros(0, np.uint64)
                there, values = known(gram)
                words, word = np.unique(owner[at], return_inverse=True)
                n = np.bincount(word[there], minlength=len(words))
                sums = [np.bincount(word[there], v, len(words)).astype(float) for v in values]
                some = np.flatnonzero(~there)
                order = some[np.lexsort((gram[some], k[some], word[some]))]
                new = np.ones(len(order), bool)
                new[1:] = (gram[order][1:] != gram[order][:-1]) | (k[order][1:] != k[order][:-1]) | (word[order][1:] != word[order][:-1])
                head = np.flatnonzero(new)
                rare = pa.StructArray.from_arrays([pa.array(k[order][head].astype(np.int32)), pa.array(gram[order][head].view(np.int64)), pa.array(np.diff(np.append(head, len(order))))], names=["k", "gram", "n"])
                ends = np.searchsorted(word[order][head], np.arange(len(words) + 1))
                full = np.bincount(word, minlength=len(words)) == letters[words] + 1  # the end is predicted as well
                yield pa.RecordBatch.from_arrays([pa.array(ids[words]), pa.array(n), *map(pa.array, sums), pa.array(full), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rare)], names=["id", "n", "curve", "all", "whole", "rare"])


def count_words(texts: DataFrame) -> DataFrame:
    """The words of ``texts(text, kind)`` with COUNTS; ``kind`` is the place in COUNTS that a row counts for."""
    return texts.select("text", "kind").mapInArrow(lambda b: lean(_count_words(b)), _WORDS).where("word <> ''").groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTS])


def count_grams(labelled: DataFrame) -> DataFrame:
    """All n-grams of ``labelled(text, kind)`` with what they are conditioned on, what they continue, and COUNTS."""
    grams = count_words(labelled).mapInArrow(lambda b: lean(_count_grams(b)), _GRAMS).groupBy("k", "gram").agg(*[F.min(c).alias(c) for c in ("context", "suffix")], *[F.sum(c).alias(c) for c in COUNTS])
    return written(grams, "grams")


#: The models that fit the curve, which have not seen its fold, and those that score; and of each the two classes.
MODELS = ("curve", "all")
_CLASSES = [(m, c) for m in MODELS for c in ("ordinary", "toxic")]


def word_scores(types: DataFrame, grams: DataFrame) -> DataFrame:
    """``types(id, word)`` to a table ``(id, curve, all)``: the difference that each of MODELS gives, per letter.

    Each distinct n-gram of the words meets its counts and its context's totals
    once, order after order: an n-gram's chance needs that of its suffix.  No
    key of these joins has more rows than there are letters.  Then all tasks
    get the commonest n-grams and sum them up word by word; only the others
    are joined to the words that hold them, and as they are not common, none
    has many rows.
    """
    spark = types.sparkSession
    n = {(m, c): F.col(c) + F.col(f"{c}_curve") if m == "all" else F.col(c) for m, c in _CLASSES}
    seen = {m: n[m, "ordinary"] + n[m, "toxic"] > 0 for m in MODELS}
    letters = grams.where("k = 1").agg(*[F.count(F.when(seen[m], 1)).alias(m) for m in MODELS]).first()
    # up to SHARED, a count is that of the distinct letters before
    continued = grams.where(F.col("k").between(2, SHARED + 1)).groupBy((F.col("k") - 1).alias("k"), F.col("suffix").alias("gram")).agg(*[F.count(F.when(seen[m], 1)).alias(m) for m in MODELS])
    shared = grams.where(F.col("k") <= SHARED).select("k", "gram", "context").join(continued, ["k", "gram"]).select("k", "gram", "context", *[F.col(m).alias(f"n_{m}_{c}") for m, c in _CLASSES])
    counted = shared.union(grams.where(F.col("k") > SHARED).select("k", "gram", "context", *[n[m, c].alias(f"n_{m}_{c}") for m, c in _CLASSES]))
    totals = counted.groupBy("k", "context").agg(*[f(F.col(f"n_{m}_{c}")).alias(f"{name}_{m}_{c}") for m, c in _CLASSES for name, f in (("total", F.sum), ("kinds", lambda x: F.count(F.when(x > 0, 1))))])
    asked = types.select("word").mapInArrow(lambda b: lean(_asked_grams(b)), f"{_GRAM}, n long").groupBy("k", "gram").agg(F.min("context").alias("context"), F.min("suffix").alias("suffix"), F.sum("n").alias("n"))
    met = asked.join(counted.drop("context"), ["k", "gram"], "left").join(totals, ["k", "context"], "left")

    def own(x: str):
        return F.when(F.col(f"total_{x}") > 0, F.greatest(F.coalesce(f"n_{x}", F.lit(0)) - DISCOUNT, F.lit(0.0)) / F.col(f"total_{x}")).otherwise(0.0)

    def rest(x: str):
        return F.when(F.col(f"total_{x}") > 0, DISCOUNT * F.col(f"kinds_{x}") / F.col(f"total_{x}")).otherwise(1.0)

    names = [f"{m}_{c}" for m, c in _CLASSES]
    met = written(met.select("k", "gram", "suffix", "n", *[own(x).alias(f"own_{x}") for x in names], *[rest(x).alias(f"rest_{x}") for x in names]), "asked")
    chance = met.where("k = 1").select("k", "gram", "n", *[(F.col(f"own_{m}_{c}") + F.col(f"rest_{m}_{c}") / (max(1, letters[m]) + 1)).alias(f"{m}_{c}") for m, c in _CLASSES])
    chances, made = chance, [met]
    for k in range(2, ORDER + 1):
        lower = chance.select(F.col("gram").alias("suffix"), *names)
        chance = written(met.where(F.col("k") == k).join(lower, "suffix").select("k", "gram", "n", *[(F.col(f"own_{x}") + F.col(f"rest_{x}") * F.col(x)).alias(x) for x in names]), "chances")
        chances = chances.union(chance)
        made.append(chance)
    ratios = chances.select("k", "gram", "n", *[F.log(F.col(f"{m}_toxic") / F.col(f"{m}_ordinary")).alias(m) for m in MODELS])
    common = commonest(ratios.where("n > 0"), COMMON_GRAMS).select("gram", *MODELS).toArrow()  # COMMON_GRAMS at most
    shared = spark.sparkContext.broadcast(_Known(common["gram"].to_numpy().view(np.uint64), *(common[m].to_numpy() for m in MODELS)))
    parts = written(types.select("id", "word").mapInArrow(lambda b: lean(_spelled(b, shared.value)), _SPELLED), "spelled", "zstd")
    done = F.col("whole") & (F.size("rare") == 0)
    rest = parts.where(~done)
    joined = rest.select("id", F.explode("rare").alias("x")).select("id", "x.k", "x.gram", F.col("x.n").alias("times")).join(ratios.drop("n"), ["k", "gram"])
    sums = rest.select("id", "n", *MODELS).union(joined.select("id", "times", *[F.col("times") * F.col(m) for m in MODELS])).groupBy("id").agg(*[F.sum(c).alias(c) for c in ("n", *MODELS)])
    mean = [(F.col(m) / F.col("n")).alias(m) for m in MODELS]
    scores = written(parts.where(done).select("id", *mean).union(sums.select("id", *mean)), "word-scores")
    discard(parts, *made)
    return scores


EVIDENCE = ("first", "second", "third", "mean", "size")
_PARTS = ("first", "second", "third", "total", "n")


def _evidence(at: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    """The three largest of each text's differences, their sum, and how many words there are.

    Every text has an entry at least; an empty word has the least difference
    and counts for nothing.
    """
    at, sizes = at.copy(), np.diff(begins)
    if not len(sizes):
        return [np.zeros(0)] * 4 + [np.zeros(0, np.int64)]
    word = at > _NO_EVIDENCE
    n, total = (np.add.reduceat(x, begins[:-1]) for x in (word.astype(np.int64), np.where(word, at, 0)))
    text, top = np.repeat(np.arange(len(sizes)), sizes), []
    for _ in range(3):
        top.append(np.maximum.reduceat(at, begins[:-1]))
        here = np.flatnonzero(at == top[-1][text])
        at[here[np.unique(text[here], return_index=True)[1]]] = _NO_EVIDENCE
    return [*top, total, n]


def _rare_words(rare: np.ndarray, codes: np.ndarray, ids: np.ndarray, begins: np.ndarray) -> pa.Array:
    """Each text's distinct words among those at ``rare``, and how often they stand there."""
    text = np.searchsorted(begins, rare, "right") - 1
    kinds = max(len(ids), 1)
    pairs, n = np.unique(text * kinds + codes[rare], return_counts=True)
    ends = np.searchsorted(pairs // kinds, np.arange(len(begins)))
    rows = pa.StructArray.from_arrays([pa.array(ids[pairs % kinds].view(np.int64)), pa.array(n.astype(np.int64))], names=["id", "n"])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), rows)


#: What tells documents apart: rows that have both in common have the same evidence.
_KEY = ("__ml_doc", "__ml_text")


def _keyed(docs: DataFrame, *columns: str) -> DataFrame:
    return docs.select(F.xxhash64("doc_id").alias(_KEY[0]), F.xxhash64("text").alias(_KEY[1]), *columns)


def evidence(docs: DataFrame, types: DataFrame, scores: DataFrame, model: str) -> DataFrame:
    """The _KEY and the EVIDENCE of ``docs(doc_id, text)``, once each; texts without words have the least.

    ``types(id, word, n)`` and their ``scores`` cover all words of the texts.
    The commonest go to all tasks; the others are joined, and as they are not
    common, none has many rows.
    """
    common = commonest(types.select("id", "n"), COMMON_WORDS)
    known = common.join(scores, "id").select("id", F.col(model).alias("score")).toArrow()  # COMMON_WORDS at most
    shared = docs.sparkSession.sparkContext.broadcast(_Known(known["id"].to_numpy().view(np.uint64), known["score"].to_numpy()))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "text", BATCH_BYTES):
                words, begins = _words(batch["text"])
                coded = words.dictionary_encode()
                codes, kinds = coded.indices.to_numpy(), coded.dictionary.to_pylist()
                ids = np.fromiter(map(_id_of, kinds), np.uint64, len(kinds))
                empty = np.fromiter((not w for w in kinds), bool, len(kinds))
                there, (found,) = shared.value(ids)
                score = np.full(len(ids), _NO_EVIDENCE)
                score[there] = found
                score[empty] = _NO_EVIDENCE
                rare = np.flatnonzero(~(there | empty)[codes])
                yield pa.RecordBatch.from_arrays([*(batch[k] for k in _KEY), *map(pa.array, _evidence(score[codes], begins)), _rare_words(rare, codes, ids, begins)], names=[*_KEY, *_PARTS, "rare"])

    parts = written(_keyed(docs, "text").mapInArrow(lambda b: lean(rows(b)), ", ".join(f"{k} long" for k in _KEY) + ", first double, second double, third double, total double, n long, rare array<struct<id:long,n:long>>"), "evidence", "zstd")
    each = parts.select(*_KEY, F.explode("rare").alias("rare")).select(*_KEY, "rare.id", F.col("rare.n").alias("times")).join(scores.select("id", F.col(model).alias("score")), "id")
    none = [F.lit(None).cast(parts.schema[c].dataType).alias(c) for c in _PARTS]
    both = parts.select(*_KEY, *_PARTS, F.lit(None).cast("struct<id:long,score:double,times:long>").alias("rare")).union(each.select(*_KEY, *none, F.struct("id", "score", "times").alias("rare")))
    # rows of one key are equal, so a maximum and a set take each once
    whole = both.groupBy(*_KEY).agg(*[F.max(c).alias(c) for c in _PARTS], F.array_sort(F.collect_set("rare")).alias("rare"))
    three = F.flatten(F.transform("rare", lambda x: F.array_repeat(x["score"], F.least(x["times"], F.lit(3)).cast("int"))))
    top = F.slice(F.sort_array(F.concat(F.array(*_PARTS[:3]), three), False), 1, 3)
    total = F.col("total") + F.aggregate("rare", F.lit(0.0), lambda a, x: a + x["score"] * x["times"])
    n = F.col("n") + F.aggregate("rare", F.lit(0).cast("long"), lambda a, x: a + x["times"])
    whole = whole.select(*_KEY, top.alias("top"), total.alias("total"), n.alias("n"))
    return whole.select(*_KEY, *[F.col("top")[i].alias(EVIDENCE[i]) for i in range(3)], F.when(F.col("n") > 0, F.col("total") / F.col("n")).otherwise(_NO_EVIDENCE).alias("mean"), F.log1p("n").alias("size"))


_LOW, _HIGH = -5.0, 20.0


def fit_curve(x: np.ndarray, toxic: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Intercept and weights of a logistic curve, by Newton's steps with a small ridge; classes weigh the same."""
    x = np.column_stack([np.ones(len(x)), np.clip(x, _LOW, _HIGH)])
    y, w = toxic.astype(float), np.zeros(x.shape[1])
    if not len(y) or y.min() == y.max():
        return np.eye(x.shape[1])[1]
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean()))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - y)) / len(y) + ridge * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def toxicity(docs: DataFrame, labels: DataFrame, keys: list[str] | None = None, curve_rows: int = CURVE_ROWS) -> DataFrame:
    """``keys`` (doc_id by default) of every document and ``score``, the chance that its label is toxic.

    ``labels(doc_id, toxic)`` are learned from outside the held-out fold; of
    those, one fold gives the curve.  Only the text is scored.  Null and empty
    texts have the least evidence; labels that are null or name no document are
    left out.  Without labels of both classes every score is 0.5.
    """
    keys = keys or ["doc_id"]
    ids = labels.select(F.col("doc_id").cast("long").alias("doc_id"), (F.col("toxic") != 0).cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").withColumn("fold", fold()).where(F.col("fold") != HELD_OUT)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    if ids.select("toxic").distinct().count() < 2:
        return docs.select(*keys, F.lit(0.5).alias("score"))
    # always by sorting: labels grow with the documents
    labelled = texts.where(fold() != HELD_OUT).hint("merge").join(ids, "doc_id")
    grams = count_grams(labelled.select("text", (F.col("toxic") + F.when(F.col("fold") == CURVE_FOLD, 2).otherwise(0)).alias("kind")))
    types = written(count_words(docs.select("text", F.lit(0).alias("kind"))).select(F.xxhash64("word").alias("id"), "word", F.col(COUNTS[0]).alias("n")), "words")
    scores = word_scores(types, grams)
    discard(grams)
    some = ids.where(F.col("fold") == CURVE_FOLD).orderBy(F.xxhash64("doc_id"), "toxic").limit(curve_rows).select("doc_id", "toxic")
    on_curve = texts.join(F.broadcast(some), "doc_id")
    curve = _keyed(on_curve, "toxic").join(evidence(on_curve, types, scores, "curve"), [*_KEY]).toPandas()  # curve_rows at most
    w = [float(x) for x in fit_curve(curve[list(EVIDENCE)].to_numpy(), curve["toxic"].to_numpy())]
    total = F.lit(w[0])
    for name, x in zip(EVIDENCE, w[1:]):
        total = total + x * F.least(F.greatest(F.col(name), F.lit(_LOW)), F.lit(_HIGH))
    found = evidence(docs, types, scores, "all").select(*_KEY, (1 / (1 + F.exp(-total))).alias("__ml_score"))
    return _keyed(docs, *keys).join(found, [*_KEY]).select(*keys, F.col("__ml_score").alias("score"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below the threshold; all their columns stay."""
    names = [f"__ml_{i}" for i in range(len(docs.columns))]
    renamed = docs.toDF(*names)
    text, doc = names[docs.columns.index("text")], names[docs.columns.index("doc_id")]
    keyed = renamed.select(*[F.col(n) for n in names], F.col(text).alias("text"), F.col(doc).alias("doc_id"))
    return toxicity(keyed, labels, names).where(F.col("score") < threshold).select(*names).toDF(*docs.columns)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
