"""Exact repeated passages by bucket-pointer refinement.

A byte is removed if it lies in a string of ``length`` bytes that also starts
in a document with a smaller doc_id.  The suffixes at all positions fall into
buckets by their first ``Q`` bytes; a bucket is refined by the bucket
identifiers of later offsets (the suffix at p + Q, then at p + 2Q, and so on),
and every refined identifier serves in turn for the next step, until
``length`` bytes are told apart.  Identifiers are hashes of two identifiers, so
each task computes them for its own texts without a global sort, and equal
strings have equal identifiers everywhere.

Only some positions meet in the shuffle.  In each window of ``length`` bytes one
position leads: the leftmost with the smallest q-gram identifier.  Equal windows
have the same leader, so windows need comparing only where their leaders are
in one bucket.  A leader carries the identifier of the whole stretch its
windows cover; where a smaller document has the same stretch, all of them
repeat.  What is left are the edges of repeated passages: stretches in a
bucket with others that are equal in part.  Their windows are compared one by
one, a copy of each stretch.

No bucket and no passage goes to one task.  Equal windows need nothing but each
other, so they are dealt by their own identifier.  Buckets with many different
stretches are found in a sample of the documents; their stretches are dealt by
the identifiers of the stretches and count as equal in part without a look at
the others.  What repeats is the same however buckets are dealt, as windows
decide.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import batches_of, lean, table, written

LENGTH = 50
#: Bytes that put a leader into its bucket; half of shorter strings.
Q = 24
BATCH_BYTES = 4 << 20
#: Bytes that are looked at together (so many that their identifiers stay in a processor's cache), and bits that number them.
SEGMENT = 1 << 17
PLACE_BITS = 18
#: Stretches or windows that a task deals out together.
HELD = 1 << 20
#: Of so many documents one is looked at for large buckets; a bucket is large from so many different stretches there, and of the largest so many are dealt out.
SAMPLE, LARGE, LARGE_BUCKETS = 64, 16, 100_000
#: Documents whose stretches make one part, about.
DOCS_OF_PART = 20_000
#: Parts for each that is needed, so that what a task gets of them is even.
PARTS_OF_TASK = 4
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def _refine(one: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Bucket identifiers from those of a position and of a later offset."""
    x = one * _A + (later ^ (later >> np.uint64(29))) * _B
    x ^= x >> np.uint64(32)
    x *= _C
    x ^= x >> np.uint64(31)
    return x


def buckets(data: np.ndarray, depth: int, known: dict[int, np.ndarray]) -> np.ndarray:
    """Identifiers of the first ``depth`` bytes at each position where they fit; ``known`` keeps those of every depth that occurs."""
    if depth not in known:
        if depth == 1:
            known[1] = (data.astype(np.uint64) + np.uint64(1)) * _C
        else:
            half = 1 << (depth - 1).bit_length() - 1  # the largest power of two below
            ids = buckets(data, half, known)
            n = max(0, len(data) - depth + 1)
            known[depth] = _refine(ids[:n], ids[depth - half : depth - half + n])
    return known[depth]


def _least_of(ids: np.ndarray, width: int) -> np.ndarray:
    """The smallest of each ``width`` neighbours."""
    out, have = ids, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def _leaders(grams: np.ndarray, inside: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leading positions, and the first and last window that each leads.  ``inside``: where windows lie within one text."""
    place = np.uint64(PLACE_BITS)
    ids = (grams >> place) << place
    ids |= np.arange(len(ids), dtype=np.uint64)  # so that the leftmost of equal ones is least
    windows = np.flatnonzero(inside)
    leader = (_least_of(ids, width)[windows] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
    change = np.flatnonzero((leader[1:] != leader[:-1]) | (windows[1:] != windows[:-1] + 1)) + 1
    first = np.append(0, change) if len(leader) else change
    last = np.append(change, len(leader))[: len(first)] - 1
    return leader[first], windows[first], windows[last]


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The texts' bytes one after another, where each begins, and its size."""
    texts = batch["text"].cast(pa.large_binary()).fill_null(b"")
    ends = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and ends[-1] > ends[0] else np.zeros(0, np.uint8)
    return data[ends[0] : ends[-1]], ends[:-1] - ends[0], np.diff(ends)


def _segments(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[tuple]:
    """Bytes of bounded size, where windows begin in them, and the text of each byte.

    Yields the data, a mask of window starts, each byte's text number, the
    place in its text of each text's first byte here, and the batch.  A text
    longer than a segment goes on in the next one, without losing a window.
    """
    for whole in batches:
        for batch in batches_of(whole, "text", BATCH_BYTES):
            data, begins, sizes = _flat(batch)
            step = np.zeros(len(data) + 1, np.int32)
            fits = np.flatnonzero(sizes >= length)
            np.add.at(step, begins[fits], 1)
            np.add.at(step, begins[fits] + sizes[fits] - length + 1, -1)
            starts = np.cumsum(step[:-1]) > 0
            for at in range(0, len(data), SEGMENT):
                part = data[at : at + SEGMENT + length - 1]
                inside = np.zeros(max(0, len(part) - length + 1), bool)
                some = starts[at : at + min(SEGMENT, len(inside))]
                inside[: len(some)] = some
                if inside.any():
                    yield part, inside, begins - at, batch


def _packed(*columns: np.ndarray) -> bytes:
    """Columns of one length as one body; bytes of one weight stand together."""
    planes = [np.ascontiguousarray(c).view(np.uint8).reshape(len(c), c.itemsize).T.tobytes() for c in columns]
    return pa.compress(b"".join(planes), codec="zstd", asbytes=True)


def _unpacked(body: bytes, n: int, kinds: list[str]) -> list[np.ndarray]:
    widths = [np.dtype(k).itemsize for k in kinds]
    data = np.frombuffer(pa.decompress(body, n * sum(widths), codec="zstd", asbytes=True), np.uint8)
    out, at = [], 0
    for kind, w in zip(kinds, widths):
        out.append(np.ascontiguousarray(data[at : at + n * w].reshape(w, n).T).view(kind).ravel())
        at += n * w
    return out


_ROWS = "part int, kind int, n int, docs int, owners binary, body binary"
_ROWS_ARROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("n", pa.int32()), ("docs", pa.int32()), ("owners", pa.binary()), ("body", pa.binary())])
_KINDS = ["<u4", "<u8", "<u4", "u1"]
#: A stretch: its first window, and how many follow that one.
SPAN = np.dtype([("start", "<u4"), ("more", "u1")])


def _dealt(parts: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
    """Stretches of one batch, dealt by bucket and packed: a row per part.

    A stretch that a smaller document of the batch has as well is settled here:
    it repeats (kind 1).  So a part gets each distinct stretch of a batch from
    one document only, however common it is.
    """
    once = held[0][1] is held[0][2]
    part, q, u, doc, row, start, more = (np.concatenate(c) for c in zip(*held))
    order = np.lexsort((doc, u, q))
    new = np.concatenate([[True], (q[order][1:] != q[order][:-1]) | (u[order][1:] != u[order][:-1])])
    smallest = np.empty(len(doc), doc.dtype)
    smallest[order] = doc[order][np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))]
    settled = doc > smallest
    part = part.astype(np.int64)
    part[settled] = -1
    order = np.argsort(part, kind="stable")  # by part, then as they stand in the texts
    cuts = np.flatnonzero(np.diff(part[order], prepend=-2, append=-2))
    rows = []
    for a, b in zip(cuts[:-1], cuts[1:]):
        some = order[a:b]
        run = np.flatnonzero(np.concatenate([[True], (doc[some][1:] != doc[some][:-1]) | (row[some][1:] != row[some][:-1])]))
        counts = np.diff(np.append(run, len(some))).astype("<u4")
        kind = int(part[some[0]] < 0)
        # settled stretches go to any part, as none needs them
        to = int(part[some[0]]) if not kind else int(doc[some[0]]) % parts
        gap = np.diff(start[some].astype("<u4"), prepend=np.uint32(0))  # small but for the first of a document
        rows.append({"part": to, "kind": kind or 2 * once, "n": len(some), "docs": len(run), "owners": _packed(doc[some][run], row[some][run], counts), "body": _packed(*([] if kind else [u[some]] if once else [q[some].astype("<u4"), u[some]]), gap, more[some].astype("u1"))})
    yield pa.RecordBatch.from_pylist(rows, _ROWS_ARROW)


_NO_BUCKETS = np.zeros(0, np.uint64)


def _among(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which of the values are in ``some``, which is sorted."""
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values if len(some) else np.zeros(len(values), bool)


def _stretches(batches: Iterator[pa.RecordBatch], length: int, parts: int, large: np.ndarray = _NO_BUCKETS) -> Iterator[tuple]:
    """The stretch of each leader: part, bucket, identifier, document, row, first window and number of further ones.

    A part has whole buckets, but for ``large`` ones, whose stretches are dealt by their identifiers.
    """
    for data, inside, begins, batch in _segments(batches, length):
        known: dict[int, np.ndarray] = {}
        q = min(Q, (length + 1) // 2)
        full, grams = buckets(data, length, known), buckets(data, q, known)
        at, first, last = _leaders(grams, inside, length - q + 1)
        # windows of one leader overlap, so the first and the last pin all bytes
        u = _refine(_refine(full[first], full[last]), ((last - first) * length + at - first).astype(np.uint64))
        text = np.searchsorted(begins, first, "right") - 1
        doc, row = (batch[c].to_numpy()[text] for c in ("doc", "row"))
        q = grams[at]
        yield (np.where(_among(q, large), u, q) >> np.uint64(32)) % np.uint64(parts), q, u, doc, row, (first - begins[text]).astype(np.uint32), (last - first).astype(np.uint8)


def _sampled(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for _, q, u, *_ in _stretches(batches, length, 1):
        yield pa.RecordBatch.from_arrays([pa.array(q.view(np.int64)), pa.array(u.view(np.int64))], names=["q", "u"])


def large_buckets(docs: DataFrame, length: int, sample: int | None = None) -> np.ndarray:
    """The buckets with many different stretches in a sample of ``docs(doc, row, text)``, sorted; LARGE_BUCKETS at most."""
    some = docs.where(F.pmod(F.xxhash64("doc", "row"), F.lit(sample or SAMPLE)) == 0)
    sizes = some.mapInArrow(lambda b: lean(_sampled(b, length)), "q long, u long").distinct().groupBy("q").count().where(F.col("count") >= LARGE)
    return np.sort(sizes.orderBy(F.desc("count"), "q").limit(LARGE_BUCKETS).select("q").toArrow()["q"].to_numpy().view(np.uint64))


def _in_portions(some: Iterator[tuple], parts: int) -> Iterator[pa.RecordBatch]:
    """Stretches dealt out in portions of about HELD."""
    held, size = [], 0
    for each in some:
        held.append(each)
        size += len(each[0])
        if size >= HELD:
            yield from _dealt(parts, held)
            held, size = [], 0
    if held:
        yield from _dealt(parts, held)


def _windows(batches: Iterator[pa.RecordBatch], length: int, parts: int = 1) -> Iterator[tuple]:
    """Each window of undecided stretches as a stretch of its own, in a part by the window's identifier."""
    for batch in batches:
        for i, found in enumerate(batch["found"]):
            spans = np.concatenate([np.frombuffer(f["spans"].as_py(), SPAN) for f in found.values])
            n = spans["more"].astype(np.int64) + 1
            begin = np.sort(np.repeat(spans["start"] - np.cumsum(n) + n, n) + np.arange(n.sum()))
            data = np.frombuffer(batch["text"][i].as_py().encode(), np.uint8)
            for at in range(0, len(data), SEGMENT):
                lo, hi = np.searchsorted(begin, [at, at + SEGMENT])
                if hi > lo:
                    w, k = buckets(data[at : at + SEGMENT + length - 1], length, {})[begin[lo:hi] - at], hi - lo
                    yield (w >> np.uint64(32)) % np.uint64(parts), w, w, np.full(k, batch["doc"][i].as_py()), np.full(k, batch["row"][i].as_py()), begin[lo:hi].astype(np.uint32), np.zeros(k, np.uint8)


def _rows_of_part(rows: list[dict]) -> tuple[np.ndarray, ...]:
    """kind, q, u, doc, row, start and more of all stretches of one part."""
    out = []
    for r in rows:
        doc, row, counts = _unpacked(r["owners"], r["docs"], ["<i8", "<i8", "<u4"])
        n = r["n"]
        if r["kind"] == 1:
            gap, more = _unpacked(r["body"], n, _KINDS[2:])
            q, u = np.zeros(n, "<u4"), np.zeros(n, "<u8")
        elif r["kind"] == 2:
            u, gap, more = _unpacked(r["body"], n, _KINDS[1:])
            q = u.astype("<u4")
        else:
            q, u, gap, more = _unpacked(r["body"], n, _KINDS)
        out.append((np.full(n, r["kind"], np.int32), q, u, np.repeat(doc, counts), np.repeat(row, counts), np.cumsum(gap, dtype=np.uint32).astype(np.int64), more))
    return tuple(np.concatenate(c) for c in zip(*out))


_FOUND = "doc long, row long, kind int, part int, spans binary"


def _settled(batches: Iterator[pa.RecordBatch], undecided: bool, large: np.ndarray = _NO_BUCKETS) -> Iterator[pa.RecordBatch]:
    """Part after part (rows come sorted by it), the stretches of a document whose windows repeat (kind 1) or are undecided (kind 2)."""
    large = np.unique(large.astype("<u4"))  # as much as parts have of a bucket's identifier
    held: list[dict] = []
    for batch in batches:
        for r in batch.to_pylist():
            if held and held[0]["part"] != r["part"]:
                yield from _settled_part(held, undecided, large)
                held = []
            held.append(r)
    if held:
        yield from _settled_part(held, undecided, large)


def _settled_part(rows: list[dict], undecided: bool, large: np.ndarray) -> Iterator[pa.RecordBatch]:
    kind, q, u, doc, row, start, more = _rows_of_part(rows)
    done, some = np.flatnonzero(kind == 1), np.flatnonzero(kind != 1)
    picked = [(done, 1)]
    if len(some):
        some = some[np.lexsort((doc[some], u[some], q[some]))]
        q, u, own = q[some], u[some], doc[some]
        new_q = np.concatenate([[True], q[1:] != q[:-1]])
        new_u = new_q | np.concatenate([[True], u[1:] != u[:-1]])
        first = own[np.maximum.accumulate(np.where(new_u, np.arange(len(some)), 0))]
        picked.append((some[own > first], 1))
        if undecided:
            # a bucket is open if its stretches come first in different documents; of a large one only some are here
            heads = np.flatnonzero(new_u)
            bucket = np.cumsum(new_q) - 1
            begins = np.flatnonzero(new_q[heads])
            open_ = (np.minimum.reduceat(own[heads], begins) < np.maximum.reduceat(own[heads], begins)) | _among(q[heads[begins]], large)
            picked.append((some[open_[bucket] & (own == first)], 2))
    for at, what in picked:
        if len(at):
            at = at[np.lexsort((row[at], doc[at]))]
            spans = np.empty(len(at), SPAN)
            spans["start"], spans["more"] = start[at], more[at]
            cut = np.flatnonzero(np.concatenate([[True], (doc[at][1:] != doc[at][:-1]) | (row[at][1:] != row[at][:-1])]))
            offsets = np.append(cut, len(at)).astype(np.int64) * SPAN.itemsize
            body = pa.Array.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(spans.tobytes())]).cast(pa.binary())
            head = at[cut]
            yield pa.RecordBatch.from_arrays([pa.array(doc[head]), pa.array(row[head]), *(pa.array(np.full(len(cut), x, np.int32)) for x in (what, rows[0]["part"])), body], names=["doc", "row", "kind", "part", "spans"])


def _merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open ranges, as maximal ranges in order."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    new = np.concatenate([[True], starts[1:] > ends[:-1]])
    return starts[new], ends[np.append(np.flatnonzero(new)[1:] - 1, len(ends) - 1)]


def _spread(rows: DataFrame) -> DataFrame:
    """Rows of a part together; a task works through several parts, one after another."""
    return rows.repartition("part").sortWithinPartitions("part")


def repeated_spans(docs: DataFrame, length: int = LENGTH, doc_parts: int = DOCS_OF_PART) -> DataFrame:
    """``docs(doc, row, text)`` to ``(doc, row, spans)``: packed ranges of windows that repeat, where there are any.

    Further columns go along where texts meet their undecided stretches, so
    that a join of ``docs`` with the result finds its shuffle made already.
    """
    spark = docs.sparkSession
    texts = docs.select("doc", "row", "text")
    parts = PARTS_OF_TASK * max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // doc_parts)
    shared = spark.sparkContext.broadcast(large_buckets(texts, length))  # LARGE_BUCKETS at most
    dealt = _spread(texts.mapInArrow(lambda b: lean(_in_portions(_stretches(b, length, parts, shared.value), parts)), _ROWS))
    found = written(dealt.mapInArrow(lambda b: lean(_settled(b, True, shared.value)), _FOUND), "stretches", "zstd")
    undecided = found.where("kind = 2").groupBy("doc", "row").agg(F.collect_list(F.struct("part", "spans")).alias("found"))
    edges = docs.join(undecided, ["doc", "row"])
    windows = _spread(edges.mapInArrow(lambda b: lean(_in_portions(_windows(b, length, parts), parts)), _ROWS))
    repeated = found.where("kind = 1").union(windows.mapInArrow(lambda b: lean(_settled(b, False)), _FOUND).where("kind = 1"))
    return repeated.groupBy("doc", "row").agg(F.collect_list("spans").alias("spans"))


_CUT = "n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept binary"


def _whole_characters(data: bytes, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ranges without the characters that they hold only in part."""
    inner = np.append((np.frombuffer(data, np.uint8) & 0xC0) == 0x80, False)
    for _ in range(3):
        begin, end = begin + inner[begin], end - inner[end]
    return begin[begin < end], end[begin < end]


def _cut(batches: Iterator[pa.RecordBatch], length: int, whole_characters: bool) -> Iterator[pa.RecordBatch]:
    kinds = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    for batch in batches:
        out = {n: [] for n in ("n_bytes", "n_removed", "spans", "kept")}
        for text, spans in zip(batch["text"], batch["spans"]):
            data, ranges, kept = (text.as_py() or "").encode(), [], None
            if spans.is_valid:
                windows = np.frombuffer(b"".join(spans.as_py()), SPAN)
                start = windows["start"].astype(np.int64)
                begin, end = _merged(start, start + windows["more"] + length)
                if whole_characters:
                    begin, end = _whole_characters(data, begin, end)
                ranges = [{"start": a, "end": b} for a, b in zip(begin.tolist(), end.tolist())]
                keep = np.ones(len(data), bool)
                for r in ranges:
                    keep[r["start"] : r["end"]] = False
                kept = np.frombuffer(data, np.uint8)[keep].tobytes()
            out["n_bytes"].append(len(data))
            out["n_removed"].append(len(data) - len(kept) if ranges else 0)
            out["spans"].append(ranges)
            out["kept"].append(data if kept is None else kept)
        names = [n for n in batch.schema.names if n != "spans"]
        yield pa.RecordBatch.from_arrays([*(batch[n] for n in names), pa.array(out["n_bytes"], pa.int64()), pa.array(out["n_removed"], pa.int64()), pa.array(out["spans"], pa.list_(kinds)), pa.array(out["kept"], pa.binary())], names=[*names, "n_bytes", "n_removed", "spans", "kept"])


def without_repeats(docs: DataFrame, length: int = LENGTH, whole_characters: bool = False) -> DataFrame:
    """``docs`` with n_bytes, n_removed, spans (ranges of bytes) and kept (the remaining bytes).

    Of ``docs``, doc_id, text and further columns stay, but for those that have
    the name of a result.  A null text has no bytes.  Rows with one doc_id don't count as smaller than each other, so
    they keep what they share; a row without a doc_id has no place in the
    order, keeps all its bytes, and takes none from others.  An empty table
    gives an empty one.  With ``whole_characters``, characters of which only
    some bytes repeat stay, so that the rest is UTF-8.
    """
    kinds = {c: t for c, t in docs.dtypes if c not in ("doc_id", "text", "n_bytes", "n_removed", "spans", "kept")}
    more = [F.col(f"`{c}`") for c in kinds]
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("row"), "text", *([F.struct(*more).alias("rest")] if more else []))
    placed = keyed.where("doc IS NOT NULL")
    spans = repeated_spans(placed, length)
    with_spans = placed.join(spans, ["doc", "row"], "left")
    others = keyed.where("doc IS NULL").withColumn("spans", F.lit(None).cast(spans.schema["spans"].dataType)).select(with_spans.columns)
    rest = f", rest {keyed.schema['rest'].dataType.simpleString()}" if more else ""
    cut = with_spans.union(others).mapInArrow(lambda b: lean(_cut(b, length, whole_characters)), f"doc long, row long, text string{rest}, {_CUT}")
    return cut.select(F.col("doc").alias("doc_id"), "text", *[F.col(f"rest.`{c}`").alias(c) for c in kinds], "n_bytes", "n_removed", "spans", "kept")


def texts_without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``docs`` with the repeated passages cut out of their texts, and n_chars to match; no row goes."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in ("text", "n_chars")]
    rows = without_repeats(docs.select("doc_id", "text", F.struct(*others).alias("__ml_row")), length, whole_characters=True)
    text = F.when(F.col("text").isNotNull(), F.col("kept").cast("string"))
    new = {"text": text} | ({"n_chars": F.coalesce(F.length(text), F.lit(0)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return rows.select(*[new.get(c, F.col(f"__ml_row.`{c}`")).alias(c) for c in docs.columns])


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = without_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
