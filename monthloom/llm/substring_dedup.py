"""Repeated word sequences by suffix automata of reference shards.

A word is removed if it lies in a window of ``length`` words that also starts in
a document with a smaller doc_id.  All documents are the reference, so an
automaton of all of them has no size bound, and streaming every document
through every shard of it would be quadratic.  A shard is therefore the passages
around one anchor: in each window of ``length`` words the q words with the
smallest identifier are its anchor, equal windows have the same anchor, and so
a window can only match in the shard of its own.

Passages that a smaller document has in full repeat as they are.  What is left
are distinct passages under anchors that several documents share: each is
sent once to its anchor's shard.  There the passages are streamed in ascending
doc_id through the suffix automaton of those before, which gives at each word
the length of the longest match that ends there; a match of ``length`` words or
more is a window that repeats.  Then the passage becomes part of the automaton.
The removed spans of a document are the maximal runs under all its windows.

An anchor with very many different passages, found in a sample, is no shard:
its windows are dealt one by one, by their own identifiers.  What repeats is the
same either way.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import batches_of, lean, table, written
from .suffix_dedup import _ROWS, _FOUND, DOCS_OF_PART, LARGE, LARGE_BUCKETS, PARTS_OF_TASK, PLACE_BITS, SAMPLE, SEGMENT, SPAN, _among, _flat, _in_portions, _leaders, _merged, _refine, _settled, _spread, buckets

LENGTH = 13
#: Bytes of texts that are looked at together, and of words that are numbered at a time.
BATCH_BYTES, WORD_BYTES = 4 << 20, 1 << 20
#: Windows that a task remembers to have sent; beyond it the memory is emptied, which only sends some again.
WINDOWS_HELD = 1 << 20
_rng = np.random.default_rng(13)
_OF_BYTE = _rng.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)


def words_of(data: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit identifiers of the words in texts that stand one after another, and where each word begins.

    A word ends at ASCII white space and with its text; ``begins`` says where texts begin.
    """
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    starts = np.append(True, ~inside[:-1])[: len(data)]
    starts[begins[begins < len(data)]] = True
    begin = np.flatnonzero(inside & starts)
    ids = np.empty(len(begin), np.uint64)
    at = 0
    while at < len(begin):
        to = max(at + 1, int(np.searchsorted(begin, begin[at] + WORD_BYTES)))
        end = begin[to] if to < len(begin) else len(data)
        first = begin[at:to] - begin[at]
        sizes = np.diff(np.append(first, end - begin[at]))
        place = np.arange(end - begin[at]) - np.repeat(first, sizes)
        powers = np.multiply.accumulate(np.append(np.uint64(1), np.full(place.max(), _STEP)))
        values = _OF_BYTE[data[begin[at] : end]] * powers[place] * inside[begin[at] : end]
        ids[at:to] = np.add.reduceat(values, first)
        at = to
    ids ^= ids >> np.uint64(32)
    ids *= _STEP
    return ids ^ (ids >> np.uint64(29)), begin


def _segments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple]:
    """Word identifiers of bounded number, where windows begin among them, the number of each text's first word here, and the batch."""
    for whole in batches:
        for batch in batches_of(whole, "text", BATCH_BYTES):
            data, begins, sizes = _flat(batch)
            ids, at_byte = words_of(data, begins)
            first = np.searchsorted(at_byte, begins)
            n = np.searchsorted(at_byte, begins + sizes) - first
            step = np.zeros(len(ids) + 1, np.int32)
            fits = np.flatnonzero(n >= length)
            np.add.at(step, first[fits], 1)
            np.add.at(step, first[fits] + n[fits] - length + 1, -1)
            starts = np.cumsum(step[:-1]) > 0
            for at in range(0, len(ids), SEGMENT):
                part = ids[at : at + SEGMENT + length - 1]
                inside = np.zeros(max(0, len(part) - length + 1), bool)
                some = starts[at : at + min(SEGMENT, len(inside))]
                inside[: len(some)] = some
                if inside.any():
                    yield part, inside, first - at, batch


def _passages(batches: Iterator[pa.RecordBatch], length: int, parts: int, large: np.ndarray) -> Iterator[tuple]:
    """The passage of each anchor: part, anchor, identifier, document, row, first window and number of further ones."""
    for ids, inside, first_word, batch in _segments(batches, length):
        known = {1: ids}
        q = (length + 1) // 2
        full, grams = buckets(ids, length, known), buckets(ids, q, known)
        at, first, last = _leaders(grams, inside, length - q + 1)
        u = _refine(_refine(full[first], full[last]), ((last - first) * length + at - first).astype(np.uint64))
        text = np.searchsorted(first_word, first, "right") - 1
        doc, row = (batch[c].to_numpy()[text] for c in ("doc", "row"))
        anchor = grams[at]
        yield (np.where(_among(anchor, large), u, anchor) >> np.uint64(32)) % np.uint64(parts), anchor, u, doc, row, (first - first_word[text]).astype(np.uint32), (last - first).astype(np.uint8)


def _sampled(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for _, anchor, u, *_ in _passages(batches, length, 1, np.zeros(0, np.uint64)):
        yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(u.view(np.int64))], names=["anchor", "u"])


def common_anchors(docs: DataFrame, length: int, sample: int | None = None) -> np.ndarray:
    """Anchors with many different passages in a sample of ``docs(doc, row, text)``, sorted; LARGE_BUCKETS at most."""
    some = docs.where(F.pmod(F.xxhash64("doc", "row"), F.lit(sample or SAMPLE)) == 0)
    sizes = some.mapInArrow(lambda b: lean(_sampled(b, length)), "anchor long, u long").distinct().groupBy("anchor").count().where(F.col("count") >= LARGE)
    found = sizes.orderBy(F.desc("count"), "anchor").limit(LARGE_BUCKETS).select("anchor").toArrow()["anchor"].to_numpy()
    return np.sort(found.view(np.uint64))


class Automaton:
    """Suffix automaton of several word sequences."""

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, follow: dict[int, int], link: int, length: int) -> int:
        self.next.append(follow)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state of p's longest sequence and the word, parted from the longer ones of q."""
        clone = self._state(dict(self.next[q]), self.link[q], self.length[p] + 1)
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        self.link[q] = clone
        return clone

    def add(self, words: list[int]) -> None:
        last = 0
        for word in words:
            p, q = last, self.next[last].get(word)
            if q is not None:  # the sequence so far is known
                last = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
                continue
            last = self._state({}, 0, self.length[p] + 1)
            while p >= 0 and word not in self.next[p]:
                self.next[p][word] = last
                p = self.link[p]
            if p >= 0:
                q = self.next[p][word]
                self.link[last] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)

    def matches(self, words: list[int]) -> list[int]:
        """Matching statistics: at each word, the length of the longest known sequence that ends there."""
        out, state, size = [], 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                size = self.length[state]
            follow = self.next[state].get(word)
            if follow is not None:
                state, size = follow, size + 1
            out.append(size)
        return out


def _to_shards(batches: Iterator[pa.RecordBatch], length: int, large: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Words of the undecided passages of each document, under their anchors; of common anchors, window by window.

    A window that a smaller document of the task has sent is settled: it comes
    without words.  So however many passages share it, a task sends it on about once.
    """
    q = (length + 1) // 2
    place = np.uint64(PLACE_BITS)
    sent: dict[int, int] = {}
    for batch in batches:
        for i, found in enumerate(batch["found"]):
            spans = np.concatenate([np.frombuffer(f, SPAN) for f in found.as_py()])
            data, doc = np.frombuffer(batch["text"][i].as_buffer(), np.uint8), batch["doc"][i].as_py()
            ids, _ = words_of(data, np.zeros(1, np.int64))
            out: dict[str, list] = {"key": [], "start": [], "words": []}
            for start, more in zip(spans["start"].tolist(), spans["more"].tolist()):
                own = ids[start : start + more + length]
                known = {1: own}
                grams = buckets(own, q, known)
                anchor = grams[np.argmin(grams >> place)]
                whole = not _among(np.array([anchor]), large)[0]
                pieces = [(anchor, start, own)] if whole else [(w, start + k, own[k : k + length]) for k, w in enumerate(buckets(own, length, known))]
                for key, at, words in pieces:
                    key, settled = int(key.view(np.int64)), False
                    if not whole:
                        if len(sent) > WINDOWS_HELD:
                            sent.clear()
                        settled = sent.get(key, doc) < doc
                        sent[key] = min(sent.get(key, doc), doc)
                    out["key"].append(doc * 0x9E3779B1 % (1 << 62) + at if settled else key)  # a settled one may go anywhere
                    out["start"].append(at)
                    out["words"].append(b"" if settled else words.tobytes())
            n = len(out["key"])
            head = [pa.array([batch[c][i].as_py()] * n, pa.int64()) for c in ("doc", "row")]
            yield pa.RecordBatch.from_arrays([*head, pa.array(out["key"], pa.int64()), pa.array(out["start"], pa.int64()), pa.array(out["words"], pa.binary())], names=["doc", "row", *out])


def _streamed(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Shard after shard (rows come sorted by key and doc), the windows that match in the automaton of smaller documents."""
    rows = (r for batch in batches for r in zip(*(batch[c].to_pylist() for c in ("key", "doc", "row", "start", "words"))))
    held: list[tuple] = []

    def released() -> pa.RecordBatch:
        doc, row, spans = zip(*held)
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(row, pa.int64()), pa.array(spans, pa.binary())], names=["doc", "row", "spans"])

    for _, shard in itertools.groupby(rows, lambda r: r[0]):
        automaton = Automaton()
        for _, own in itertools.groupby(shard, lambda r: r[1]):
            fresh = []
            for _, doc, row, start, body in own:
                if not body:  # settled before it came here
                    spans = np.zeros(1, SPAN)
                    spans["start"] = start
                    held.append((doc, row, spans.tobytes()))
                    continue
                words = np.frombuffer(body, np.uint64).tolist()
                hit = [i - length + 1 for i, size in enumerate(automaton.matches(words)) if size >= length]
                if hit:
                    spans = np.zeros(len(hit), SPAN)
                    spans["start"] = start + np.array(hit)
                    held.append((doc, row, spans.tobytes()))
                if len(hit) <= len(words) - length:
                    fresh.append(words)  # else every window of it is known
            for words in fresh:  # a document does not match itself
                automaton.add(words)
        if len(held) > 4096:
            yield released()
    if held:
        yield released()


def repeated_windows(docs: DataFrame, length: int = LENGTH, doc_parts: int = DOCS_OF_PART) -> DataFrame:
    """``docs(doc, row, text)`` to ``(doc, row, spans)``: packed ranges of windows that repeat, where there are any."""
    spark = docs.sparkSession
    parts = PARTS_OF_TASK * max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // doc_parts)
    shared = spark.sparkContext.broadcast(common_anchors(docs, length))  # LARGE_BUCKETS at most
    dealt = _spread(docs.mapInArrow(lambda b: lean(_in_portions(_passages(b, length, parts, shared.value), parts)), _ROWS))
    found = written(dealt.mapInArrow(lambda b: lean(_settled(b, True, shared.value)), _FOUND), "passages", "zstd")
    undecided = found.where("kind = 2").groupBy("doc", "row").agg(F.collect_list("spans").alias("found"))
    edges = docs.join(undecided, ["doc", "row"]).select("doc", "row", F.col("text").cast("binary").alias("text"), "found")
    sent = edges.mapInArrow(lambda b: lean(_to_shards(b, length, shared.value)), "doc long, row long, key long, start long, words binary")
    shards = sent.repartition("key").sortWithinPartitions("key", "doc", "row", "start")
    matched = shards.mapInArrow(lambda b: lean(_streamed(b, length)), "doc long, row long, spans binary")
    repeated = found.where("kind = 1").select("doc", "row", "spans").union(matched)
    return repeated.groupBy("doc", "row").agg(F.collect_list("spans").alias("spans"))


RESULTS = ("n_words", "n_removed", "spans", "kept")


def _cut(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        out = {n: [] for n in RESULTS}
        for text, spans in zip(batch["text"], batch["spans"]):
            words, ranges = (text.as_py() or "").encode("utf-8", "surrogatepass").split(), []
            n = len(words)
            if spans.is_valid:
                windows = np.frombuffer(b"".join(spans.as_py()), SPAN)
                start = windows["start"].astype(np.int64)
                begin, end = _merged(start, start + windows["more"] + length)
                ranges = [{"start": a, "end": b} for a, b in zip(begin.tolist(), end.tolist())]
                for r in reversed(ranges):
                    del words[r["start"] : r["end"]]
            for name, value in zip(RESULTS, (n, n - len(words), ranges, b" ".join(words).decode("utf-8", "surrogatepass"))):
                out[name].append(value)
        names = [n for n in batch.schema.names if n != "spans"]
        results = [pa.array(out["n_words"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["spans"], kinds), pa.array(out["kept"], pa.string())]
        yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), *results], names=[*names, *RESULTS])


def without_repeated_words(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with n_words, n_removed, spans (maximal ranges of removed words) and kept (the others, joined by spaces).

    Of ``docs``, doc_id, text and further columns stay, but for those that have
    the name of a result.  A null text has no words.  Rows with one doc_id
    don't count as smaller than each other, so they keep what they share; a row
    without a doc_id has no place in the order, keeps all its words, and takes
    none from others.  An empty table gives an empty one.
    """
    kinds = {c: t for c, t in docs.dtypes if c not in ("doc_id", "text", *RESULTS)}
    rest = [F.struct(*[F.col(f"`{c}`") for c in kinds]).alias("rest")] if kinds else []
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("row"), "text", *rest)
    placed = keyed.where("doc IS NOT NULL")
    spans = repeated_windows(placed.select("doc", "row", "text"), length)
    with_spans = placed.join(spans, ["doc", "row"], "left")
    others = keyed.where("doc IS NULL").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)).select(with_spans.columns)
    more = f", rest {keyed.schema['rest'].dataType.simpleString()}" if rest else ""
    results = "n_words long, n_removed long, spans array<struct<start:long,end:long>>, kept string"
    cut = with_spans.union(others).mapInArrow(lambda b: lean(_cut(b, length)), f"doc long, row long, text string{more}, {results}")
    return cut.select(F.col("doc").alias("doc_id"), "text", *[F.col(f"rest.`{c}`").alias(c) for c in kinds], *RESULTS)


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeated_words(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))
