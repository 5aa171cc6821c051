"""Small tables with every odd row that the operators promise to handle."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ", `row` string, `fp` string, `score` string, `length` string, `spans` string, `kept` string, `shard` string, `words` string, `root` string, `doc` string"
WORDS = "the of and to in station river mountain teacher letter winter garden paper window silver market under bright seven stone".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ",", ".", "é"]) for _ in range(n))


def odd_rows() -> list[tuple]:
    """Null ids, texts and sources, empty and blank texts, one very long text, ties, repeated rows and ids."""
    base = prose(1, 80)
    rows = [(i, prose(100 + i, 40 + 3 * i), "en", f"s{i % 3}") for i in range(12)]
    rows += [(20, base, "en", "s0"), (21, base, "en", "s1"), (22, base + " more", "en", None), (22, base + " other", "en", "s1")]
    rows += [(30, None, None, None), (31, "", "en", "s0"), (32, " \n\t ", "en", "s2"), (33, "one", "en", "s2"), (34, "日本語 text — “quoted” ’s \u0000 x", None, "é")]
    rows += [(40, prose(7, 30_000), "en", "s0"), (41, prose(8, 50) + " " + base, "en", "s1"), (None, base, "en", "s1"), (None, None, None, None)]
    rows += [(50, prose(9, 60), "en", "s1")] * 2
    return [(d, t, lang, s, None if t is None else len(t)) for d, t, lang, s in rows]


def odd_documents(spark, clashing: bool = False):
    rows = odd_rows()
    if clashing:
        return spark.createDataFrame([(*r, *["x"] * 10) for r in rows], SCHEMA + CLASHING)
    return spark.createDataFrame(rows, SCHEMA)


def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
