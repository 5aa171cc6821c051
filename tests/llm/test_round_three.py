"""Whitening, the filter audit and word-window dedup against brute force and on odd rows."""

from __future__ import annotations

import collections
import itertools
import random

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from monthloom.llm import filter_audit, substring_dedup, whitening
from tests.llm.frames import CLASHING, SCHEMA, no_documents, odd_documents, odd_rows, prose

VECTORS = "vec_id long, embedding array<double>"


# --- whitening ---


def numbers(rows):
    kept = [(i, v) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    width = max((len(v) for _, v in kept), default=0)
    x = [[int(np.floor(64 * c)) + 1_000_000 for c in [*v, *[0.0] * (width - len(v))]] for _, v in kept]
    return [i for i, _ in kept], x


def check_whitening(rows, got, components=32):
    ids, x = numbers(rows)
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    y = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x])
    cov = y.T @ y / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(components, int((values > 1e-13 * values[0]).sum()))
    table = collections.defaultdict(list)
    for r in got:
        assert r.n == n and r.identity_error <= 1e-4
        assert r.explained == pytest.approx(values[r.component - 1] / np.trace(cov), rel=1e-9)
        table[r.component].append((-1 if r.vec_id is None else r.vec_id, r.deviation, r.whitened))
    assert sorted(table) == list(range(1, k + 1))
    for c, found in table.items():
        want = y @ axes[:, c - 1] / np.sqrt(values[c - 1])
        rows_of = [sorted(zip([-1 if i is None else i for i in ids], deviation, sign * want)) for sign in (1, -1)]
        found = sorted(found)
        assert [f[:2] for f in found] == [w[:2] for w in rows_of[0]]
        assert min(max(abs(f[2] - w[2]) for f, w in zip(found, some)) for some in rows_of) < 1e-8


def spread_vectors(seed, n, width):
    rng = np.random.default_rng(seed)
    return [(i, (rng.standard_normal(width) * np.linspace(2, 0.3, width)).tolist()) for i in range(n)]


@pytest.mark.parametrize("width", [1, 3, 40, 70])
def test_whitening(spark, width):
    rows = spread_vectors(width, 300, width)
    check_whitening(rows, whitening.whitened(spark.createDataFrame(rows, VECTORS)).collect())


def test_whitening_on_odd_rows(spark):
    rows = spread_vectors(5, 60, 6) + [(3, [0.5] * 6), (3, [0.5] * 6), (None, [1.0] * 6), (70, [1.0, 2.0]), (71, [])]
    rows += [(80, None), (81, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (82, [float("nan")] * 6), (83, [float("inf")] * 6)]
    frame = spark.createDataFrame([(*r, "x", "y") for r in rows], VECTORS + ", n string, component string")
    check_whitening(rows, whitening.whitened(frame).collect())


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [])], [(1, [0.25, 3.0])], [(i, [0.25, 3.0]) for i in range(5)]])
def test_nothing_to_whiten(spark, rows):
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS))
    assert got.count() == 0
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_deviations_beyond_64_bits_are_null_and_others_exact():
    x = [[10**9, 0], [0, 10**9], [5, 7], [-(10**9), -(10**9)]]
    n, sums = 3_000_000_000, [12, -5]
    found = whitening.Centre(n, sums).deviations(np.array(x)).to_pylist()
    want = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    assert want[0] >= 1 << 63 and found == [None, None, None, None]
    n, sums = 1000, [2_000_003, 999]
    small = [[2000, 0], [2005, 3], [-7, 2]]
    assert whitening.Centre(n, sums).deviations(np.array(small)).to_pylist() == [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in small]
    edge = 3_037_000_499  # the largest whole number whose square fits
    assert whitening.Centre(1, [0]).deviations(np.array([[edge], [edge + 1]])).to_pylist() == [edge**2, None]


def test_the_filter_serves_and_stops_when_certified():
    """With a gap behind the block, the wanted pairs come out in few passes and all are certified."""
    rng = np.random.default_rng(2)
    q = np.linalg.qr(rng.standard_normal((200, 200)))[0]
    spectrum = np.concatenate([np.linspace(90, 40, 40), np.linspace(10, 5, 160)])
    cov = (q * spectrum) @ q.T
    values, axes, residuals, passes = whitening.leading(lambda m: cov @ m, 200, 32)
    assert np.allclose(values, spectrum[:32]) and residuals.max() <= 1e-12 * 90 and passes < 60
    assert np.abs(np.abs(np.sum(axes * q[:, :32], axis=0)) - 1).max() < 1e-10


def test_equal_eigenvalues_at_the_blocks_end():
    cov = np.diag([9.0, 8.0, *[1.0] * 98])
    values, axes, residuals, _ = whitening.leading(lambda m: cov @ m, 100, 32)
    assert np.allclose(values, [9, 8, *[1.0] * 30]) and np.allclose(axes.T @ axes, np.eye(32)) and residuals.max() < 1e-11


def test_many_partial_sums_are_summed_by_tasks(spark):
    def partials(batches):
        for batch in batches:
            ids = batch["id"].to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([np.array([ids.sum(), len(ids)], float).tobytes()], pa.binary())], names=["m"])

    frame = spark.range(0, 500, 1, 100).mapInArrow(partials, "m binary")
    assert whitening._summed(frame, (2,)).tolist() == [500 * 499 / 2, 500]


# --- filter audit ---


def brute_audit(docs, labels):
    """One order after another, one document after another."""
    marks = collections.defaultdict(lambda: [0, 0])
    for d, good, toxic in labels:
        if d is not None:
            marks[d] = [max(marks[d][0], good == 1), max(marks[d][1], toxic == 1)]
    least = {}
    for d, text, *_ in docs:
        if d is not None:
            least[text or ""] = min(d, least.get(text or "", d))
    parts = collections.defaultdict(list)
    for d, text, _, source, *_ in docs:
        text = text or ""
        words = text.encode().split()
        fails = {
            "A": len(words) < 50,
            "B": 100 * len(set(words)) < 65 * len(words),
            "C": 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text),
            "D": any(c in "#$%&*|" for c in text),
            "E": d is not None and d > least[text],
        }
        parts[source or ""].append((fails, *(marks[d] if d is not None else (0, 0))))
    out = {}
    for part, rows in parts.items():
        shapley = collections.Counter()
        for order in itertools.permutations("ABCDE"):
            left = rows
            for step, f in enumerate(order, 1):
                removed = [r for r in left if r[0][f]]
                left = [r for r in left if not r[0][f]]
                failing = sum(r[0][f] for r in rows)
                only = sum(r[0][f] and sum(r[0].values()) == 1 for r in rows)
                shapley[f] += len(removed)
                out[part, "".join(order), step] = [len(left), len(removed), failing - len(removed), only, sum(r[1] for r in removed), sum(r[2] for r in removed)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(shapley[order[step - 1]])
    return out


def audit_rows():
    rng = random.Random(4)
    rows = odd_rows()
    rows += [(100 + i, rng.choice(["A B", "SHOUT & more", prose(i % 7, 70), " ".join(f"w{j}" for j in range(80)) + rng.choice(["", "|", " QQQQQQQQQQQQQQQQQQQQQQQQQQQQQQ"])]), "en", rng.choice(["s0", "s1", "", None])) + (None,) for i in range(120)]
    return rows


LABELS = [(i, i % 2, (i // 2) % 2) for i in range(0, 160)] + [(101, 1, 1), (101, None, 0), (None, 1, 1), (7, None, None), (20, 2, 3)]


@pytest.mark.parametrize("clashing", [False, True])
def test_filter_audit(spark, clashing):
    rows = audit_rows()
    docs = spark.createDataFrame([(*r, *["x"] * 10) for r in rows] if clashing else rows, SCHEMA + (CLASHING if clashing else ""))
    if clashing:
        docs = docs.selectExpr("*", "1 AS good", "2 AS toxic", "3 AS code", "4 AS part", "5 AS digest", "6 AS salt")
    labels = spark.createDataFrame([(*r, "x") for r in LABELS], "doc_id long, quality int, toxic int, source string")
    got = filter_audit.filter_audit(docs, labels).collect()
    assert {tuple(r[:3]): list(r[3:]) for r in got} == brute_audit(rows, LABELS)
    assert len(got) == 600 * len({r[3] or "" for r in rows})


def test_filter_audit_of_empty_tables(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.filter_audit(no_documents(spark), labels).count() == 0
    assert filter_audit.filter_audit(odd_documents(spark), labels).agg({"good_lost": "sum", "toxic_lost": "sum"}).first() == (0, 0)


def test_contractions_of_random_counts():
    rng = np.random.default_rng(8)
    counts = rng.integers(0, 50, (3, 32))
    found = filter_audit.audit_of(counts)
    total = counts[0].sum()
    for o, order in enumerate(filter_audit.ORDERS):
        at = slice(5 * o, 5 * o + 5)
        assert found["kept"][at][-1] == counts[0, 0] and found["kept"][at][0] + found["removed"][at][0] == total
        assert (found["kept"][at] + np.cumsum(found["removed"][at]) == total).all()
        codes = np.arange(32)
        for step, f in enumerate(order):
            gone = np.any([codes >> filter_audit.FILTERS.index(e) & 1 for e in order[:step]], axis=0) if step else codes < 0
            hit = (codes >> filter_audit.FILTERS.index(f) & 1 == 1) & ~gone
            assert [found[c][5 * o + step] for c in ("removed", "good_lost", "toxic_lost")] == counts[:, hit].sum(1).tolist()


def test_filter_audit_matches_sql(spark, sf_dir):
    got = filter_audit.op12_filter_audit(spark, sf_dir).collect()
    connection = duckdb.connect()
    for name in ("documents", "labels"):
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    assert sorted(map(tuple, got)) == sorted(connection.execute(filter_audit.OP12_SQL).fetchall())


# --- substring dedup ---


def brute_words(rows, length=13):
    """Rows (doc_id, n_words, n_removed, spans, kept) by a table of all windows."""
    texts = [(d, (t or "").encode("utf-8", "surrogatepass").split()) for d, t in rows]
    first: dict[tuple, int] = {}
    for d, words in texts:
        if d is not None:
            for i in range(len(words) - length + 1):
                key = tuple(words[i : i + length])
                first[key] = min(d, first.get(key, d))
    out = []
    for d, words in texts:
        gone = np.zeros(len(words) + 2, bool)
        for i in range(len(words) - length + 1):
            if d is not None and first[tuple(words[i : i + length])] < d:
                gone[i + 1 : i + 1 + length] = True
        edge = np.flatnonzero(gone[1:] != gone[:-1])
        kept = b" ".join(w for w, g in zip(words, gone[1:]) if not g).decode()
        out.append((d, len(words), int(gone.sum()), tuple(zip(edge[::2].tolist(), edge[1::2].tolist())), kept))
    return sorted(out, key=repr)


def cut_rows(frame):
    return sorted(((r.doc_id, r.n_words, r.n_removed, tuple((s.start, s.end) for s in r.spans), r.kept) for r in frame.collect()), key=repr)


def shared_passages(seed=5, n=150):
    """Texts that share passages of many lengths in different surroundings, and copies with edits."""
    rng = random.Random(seed)
    pool = [prose(1000 + i, rng.randint(8, 60)) for i in range(12)]
    rows = []
    for i in range(n):
        words = prose(2000 + i, rng.randint(0, 40)).split() + rng.choice(pool).split()[rng.randint(0, 5) :] + prose(3000 + i, rng.randint(0, 30)).split()
        if words and rng.random() < 0.3:
            words[rng.randrange(len(words))] = "edited"
        rows.append((i, rng.choice([" ", "\n", "  ", "\t"]).join(words)))
    return rows


@pytest.mark.parametrize("length", [13, 2, 5])
def test_word_windows_on_odd_rows(spark, length):
    rows = [(r[0], r[1]) for r in odd_rows()]
    got = substring_dedup.without_repeated_words(odd_documents(spark, clashing=True).selectExpr("*", "1 AS n_words", "2 AS n_removed"), length)
    assert cut_rows(got) == brute_words(rows, length)
    assert {"row", "doc", "words", "source"} <= set(got.columns) and len(set(got.columns)) == len(got.columns)


@pytest.mark.parametrize(("sample", "large"), [(64, 16), (1, 1)])
def test_word_windows_of_shared_passages(spark, monkeypatch, sample, large):
    """Also where every anchor counts as common, so that all windows are dealt one by one."""
    monkeypatch.setattr(substring_dedup, "SAMPLE", sample)
    monkeypatch.setattr(substring_dedup, "LARGE", large)
    rows = shared_passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert cut_rows(substring_dedup.without_repeated_words(docs)) == brute_words(rows)


def test_word_windows_across_segments_and_batches(spark, monkeypatch):
    for name, size in (("BATCH_BYTES", 3000), ("WORD_BYTES", 100), ("SEGMENT", 64)):
        monkeypatch.setattr(substring_dedup, name, size)
    docs = spark.createDataFrame(shared_passages(), "doc_id long, text string")
    one = [r.asDict() for r in docs.selectExpr("doc_id AS doc", "xxhash64(text) AS row", "text").collect()]
    batch = pa.RecordBatch.from_pylist(one)
    none = np.zeros(0, np.uint64)

    def found():
        return sorted(zip(*(np.concatenate(c).tolist() for c in zip(*substring_dedup._passages(iter([batch]), 13, 3, none)))))

    cut = found()
    monkeypatch.undo()
    whole = found()
    windows = [{(r[3], r[5] + k) for r in some for k in range(r[6] + 1)} for some in (cut, whole)]
    assert windows[0] == windows[1]  # a segment may part a passage, but no window is lost


def test_word_windows_of_an_empty_table_and_a_very_long_word(spark):
    assert substring_dedup.without_repeated_words(no_documents(spark)).count() == 0
    rows = [(1, "x" * 3_000_000), (2, "x" * 3_000_000 + " " + prose(3, 30)), (3, prose(3, 30))]
    assert cut_rows(substring_dedup.without_repeated_words(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_words(rows)


def test_equal_words_have_equal_identifiers_and_others_differ():
    words = [w.encode() for w in {prose(i, 1) + str(i % 50) for i in range(500)} | {"a", "aa", "é", "e", "\u0000", "ab", "ba"}]
    text = b" ".join(words * 2)
    ids, at = substring_dedup.words_of(np.frombuffer(text, np.uint8), np.zeros(1, np.int64))
    assert len(ids) == 2 * len(words) and (ids[: len(words)] == ids[len(words) :]).all() and len(set(ids.tolist())) == len(words)
    assert [text[a : a + len(w)] for a, w in zip(at.tolist(), words)] == words


@pytest.mark.parametrize("seed", range(5))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    known = [[rng.randrange(3) for _ in range(rng.randint(0, 40))] for _ in range(6)]
    automaton = substring_dedup.Automaton()
    parts = set()
    for words in known:
        automaton.add(words)
        parts |= {tuple(words[a:b]) for a in range(len(words)) for b in range(a + 1, len(words) + 1)}
    for _ in range(10):
        asked = [rng.randrange(4) for _ in range(60)]
        want = [max(k for k in range(i + 2) if k == 0 or tuple(asked[i + 1 - k : i + 1]) in parts) for i in range(len(asked))]
        assert automaton.matches(asked) == want


def test_substring_dedup_on_a_table(spark, sf_dir):
    import hashlib

    got = sorted((r.doc_id, r.n_words, r.n_removed, r.n_spans, r.kept_sha256) for r in substring_dedup.op13_substring_dedup(spark, sf_dir).collect())
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    want = sorted((d, n, gone, len(spans), hashlib.sha256(kept.encode()).hexdigest()) for d, n, gone, spans, kept in brute_words(rows))
    assert got == want


def test_whitening_of_a_table(spark, sf_dir):
    rows = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    check_whitening(rows, whitening.op11_whitening(spark, sf_dir).collect())
