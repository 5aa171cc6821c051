"""Operators on pages and vectors, and what the folder promises as a whole."""

from __future__ import annotations

import html
import re
import subprocess
import sys

import numpy as np
import pytest

from monthloom.llm import html_text, topk, url_filter
from monthloom.llm.queries import ORACLES, QUERIES

SITE = """<html><body><header><h1>Site</h1><a href=/>Home</a></header><div id="wrap" class="has-sidebar"><div class="top-menu"><ul><li><a href=a>One</a><li><a href=b>Two</a></ul></div>
<div class="story"><h2>Title here</h2><p>First paragraph, with some text; and more. It goes on &amp; on &lt;b&gt;.<p>Second   one
is here, also <a href=x>with link</a> and text.<ul><li>Item one, with words.</li><li>Item two.</li></ul><table><tr><td>cell a<td>cell b</table><p>Short.</p><script>if (a<b) document.write("<p>no</p>")</script>
<p>Another paragraph with enough words, commas, and stops. Done.</p></div><div class="share"><a href=1>Tweet</a></div><section id="comments"><h3>Comments</h3><p>Nice article, I liked it, very much indeed! Thanks.</p></section>
<div class="sidebar"><p>Related: something, else. That is long enough to be text, right?</p></div><form><p>Subscribe now, please. Enter mail.</p></form><div class="cookie-notice">We use cookies, you know.</div></div><footer>c 2020</footer></body></html>"""


def test_article_of_a_site_without_an_article_element():
    assert html_text.main_text(SITE).split("\n") == [
        "Title here",
        "First paragraph, with some text; and more. It goes on & on <b>.",
        "Second one is here, also with link and text.",
        "Item one, with words.",
        "Item two.",
        "cell a",
        "cell b",
        "Short.",
        "Another paragraph with enough words, commas, and stops. Done.",
    ]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain text, no tags", "plain text, no tags"),
        ("<nav>x</nav>", ""),
        ("a < b and c > d", "a < b and c > d"),
        ("<<<<<", "<<<<<"),
        ("<p " + "x" * 50, ""),
        ("<p>a<br>b\t\n c&nbsp;d", "a b c d"),
        ("<article><header><h1>Head</h1></header><p>Text, more.</p><aside>No, not this.</aside></article><p>after</p>", "Head\nText, more."),
        ("<p>Caf&eacute; &#8211; &#x41;&amp;amp;</p>", "Café – A&amp;"),
        ("<body><p>One, two.</p><!-- <p>no</p> --><style>p{}</style><textarea>no</textarea></body>", "One, two."),
    ],
)
def test_small_pages(page, text):
    assert html_text.main_text(page) == text


SENTENCE = "This sentence has some words, a comma, and a full stop at its end. "
FRAME = '<header><a href=/>Site name</a></header><nav><ul><li><a href=a>One</a><li><a href=b>Two</a><li><a href=c>Three</a></ul></nav>{}<footer>(c) Somebody, 2020.</footer>'


def paragraphs(n, name="P"):
    return [f"{name}{i}. {SENTENCE * 2}".strip() for i in range(n)]


def as_html(lines, tag="p"):
    return "".join(f"<{tag}>{x}</{tag}>" for x in lines)


def test_sibling_articles_all_stay():
    one, two = paragraphs(6, "A"), paragraphs(4, "B")
    page = FRAME.format(f"<article>{as_html(one)}</article><article>{as_html(two)}</article>")
    assert html_text.main_text(page).split("\n") == one + two


def test_a_main_beside_an_article_stays():
    one, two = paragraphs(6, "A"), paragraphs(4, "B")
    page = FRAME.format(f"<article>{as_html(one)}</article><main>{as_html(two)}</main>")
    assert html_text.main_text(page).split("\n") == one + two


def test_an_article_in_a_main_stands_for_it_only_if_it_is_all_of_it():
    own, more = paragraphs(8, "A"), paragraphs(5, "B")
    whole = FRAME.format(f"<main><div>{as_html(more)}</div><article>{as_html(own)}</article></main>")
    assert html_text.main_text(whole).split("\n") == more + own
    tight = FRAME.format(f"<main><p>x</p><article>{as_html(own * 3)}</article></main>")
    assert html_text.main_text(tight).split("\n") == own * 3


@pytest.mark.parametrize("n", [3, 40])
def test_title_and_lead_beside_the_body_stay(n):
    body = paragraphs(n)
    page = FRAME.format(f"<div class=story><h1>The title</h1><p>A lead, short.</p><div class=body>{as_html(body)}</div></div>")
    assert html_text.main_text(page).split("\n") == ["The title", "A lead, short.", *body]


def test_linked_headings_items_and_paragraphs_of_an_article_stay():
    body = paragraphs(4)
    page = FRAME.format(
        f"<article><h2><a href=x>A linked heading</a></h2>{as_html(body)}<ul><li><a href=1>A linked item</a></li><li>An item without.</li></ul>"
        '<p><a href=2>A linked paragraph</a></p><ul><li><a href=3>Menu</a><li><a href=4>of</a><li><a href=5>links</a></ul><div><a href=6>Share</a> <a href=7>Print</a></div></article>'
    )
    assert html_text.main_text(page).split("\n") == ["A linked heading", *body, "A linked item", "An item without.", "A linked paragraph"]


def test_doubtful_names_inside_an_article_need_links():
    body = paragraphs(4)
    page = FRAME.format(
        f"<article>{as_html(body)}<p class=social>Social questions, too, are questions.</p><p class='notice'>Take notice, reader.</p>"
        '<div class="share-price">The share price rose, again.</div><div class="share"><a href=1>Tweet</a> <a href=2>Post</a></div>'
        '<div class="related"><p>Related:</p><p><a href=3>Another story of ours</a></p></div><div class="cookie-notice">We use cookies, as all do.</div></article>'
    )
    assert html_text.main_text(page).split("\n") == [*body, "Social questions, too, are questions.", "Take notice, reader.", "The share price rose, again."]


@pytest.mark.parametrize("wrap", ["<div id=content><div class=text>{}</div></div>", "<table><tr><td>{}</td></tr></table>", "<section><section>{}</section></section>", "{}"])
def test_layouts_without_an_article_element(wrap):
    body = paragraphs(7)
    side = "<aside><p>About us, and more about us, at length. More here, too.</p></aside><div class=sidebar><ul><li>One, two.</li></ul></div>"
    assert html_text.main_text(FRAME.format(wrap.format(as_html(body)) + side)).split("\n") == body


def test_long_and_deep_pages():
    assert html_text.main_text("<div>x" * 20_000).count("x") >= 19_000
    assert html_text.main_text("<div>" * 20_000 + "x").strip() == "x"
    assert len(html_text.main_text("<p>" + "word, " * 200_000)) == 6 * 200_000 - 1


def test_pages_of_a_table(spark, sf_dir):
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.op2_html_text(spark, sf_dir).collect()}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        inner = r.html[r.html.find("<article>") + 9 : r.html.find("</article>")].replace("<br>", " ").replace("<b>", "")
        lines = (re.sub(r"\s+", " ", html.unescape(t)).strip() for t in re.split(r"</?(?:p|h1)>", inner))
        text = "\n".join(x for x in lines if x)
        assert got[r.page_id] == (text, len(text))


def test_extraction_keeps_other_columns(spark):
    pages = spark.createDataFrame([(1, None, "u", "a"), (1, "<p>x, y.", None, "b"), (None, "", "u", "c")], "page_id long, html string, url string, n_chars string")
    rows = html_text.extract(pages).collect()
    assert sorted((r.page_id or 0, r.n_chars, r.text) for r in rows) == [(0, "c", ""), (1, "a", ""), (1, "b", "x, y.")]
    assert html_text.extract(pages.limit(0)).count() == 0


# --- URLs ---


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def plain_rule(host, path, rules=url_filter.RULES):
    best = None
    for text, verdict in rules:
        name = text.partition("/")[0]
        if (host == name or host.endswith("." + name)) and path.startswith(text[len(name) :]):
            if best is None or (-len(text), text) < (-len(best[0]), best[0]):
                best = (text, verdict)
    return best


ODD_URLS = [None, "", "example.org/es/1", "http://", "HTTP://WWW.Example.ORG/es/x?y#z", "http://example.org/en/1", "http://example.org/en/2", "http://notexample.org/en/1", "http://org/es/", "http://a.org", "x://a.com?/de/", "http://b.com/de/#x", "http://b.com/fr/", "a://b://c.com/de/1", "http://ÄÖ.com/fr/é\n/x", "http://" + "a." * 3000 + "com/de/" + "x" * 5000]


def test_rules_and_parts(spark):
    rows = spark.createDataFrame([(u, "x", "y") for u in ODD_URLS * 2], "url string, host string, features string")
    got = url_filter.judged(rows, url_filter.train(spark)).collect()
    assert len(got) == 2 * len(ODD_URLS)
    for r in got:
        host, path = plain_url(r.url)
        rule = plain_rule(host, path)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0])
        assert r.verdict == (rule[1] if rule else "block" if r.block_chance > 0.5 else "allow")
    assert url_filter.judged(rows.limit(0), url_filter.train(spark)).count() == 0


def test_longest_rule_wins_and_ties_go_by_code_point(spark):
    rules = [("net/", "block"), ("a.net/", "allow"), ("net/x/", "block"), ("b.net/", "allow")]
    rows = spark.createDataFrame([("h://a.net/x/1",), ("h://a.net/y",), ("h://c.net/x/",), ("h://x.b.net/",)], "url string")
    model = url_filter.train(spark)
    got = {r.url: (r.rule, r.verdict) for r in url_filter.judged(rows, model, rules).collect()}
    assert got == {"h://a.net/x/1": ("a.net/", "allow"), "h://a.net/y": ("a.net/", "allow"), "h://c.net/x/": ("net/x/", "block"), "h://x.b.net/": ("b.net/", "allow")}


def test_classifier_on_hosts_it_has_not_seen(spark, sf_dir):
    rows = url_filter.op6_url_filter(spark, "/root/testdata/sf0.1").where("rule IS NULL").collect()
    bad = re.compile(r"(adult-x|spam-farm|cheap-pills|ads-track|casino-win|free-bets)\.")
    assert len(rows) > 1000
    assert all((r.verdict == "block") == bool(bad.search(r.host)) for r in rows)


@pytest.fixture(scope="module")
def classifier(spark):
    return url_filter.train(spark)


PATHS = [
    ("http://cinema.example.net/casino-bonuses/free-slots-online/", "block"),
    ("https://forest.example.net/cheap-viagra-pills/purchase", "block"),
    ("https://planet.example.net/videos/xxx-pornstars.html", "block"),
    ("https://valley.example.net/lottery-jackpots/winning", "block"),
    ("https://castle.example.net/download/keygens-cracks", "block"),
    ("https://cinema.example.net/museums/history-of-painters/", "allow"),
    ("https://forest.example.net/recipes/kitchen-gardens", "allow"),
    ("https://planet.example.net/weathers/northern-mountains.html", "allow"),
    ("https://valley.example.net/schools/university-teachers", "allow"),
    ("https://castle.example.net/travels/river-islands", "allow"),
]


def test_verdicts_that_only_the_path_can_give(spark, classifier):
    """Hosts and whole words that the labelled table does not hold; none of the rules fits."""
    taught = {w for url, _ in url_filter.labelled_urls() for w in re.findall(r"[a-z]+", url.partition("//")[2].partition("/")[0])}
    assert not taught & {"cinema", "forest", "planet", "valley", "castle"}
    rows = spark.createDataFrame([(i, url) for i, (url, _) in enumerate(PATHS)], "page_id long, url string")
    found = {r.page_id: r for r in url_filter.judged(rows, classifier).collect()}
    assert {r.rule for r in found.values()} == {None}
    assert [found[i].verdict for i in range(len(PATHS))] == [verdict for _, verdict in PATHS], [(found[i].path, found[i].block_chance) for i in found]


def test_labelled_table_teaches_both_parts(spark):
    rows = url_filter.labelled_urls()
    assert len(rows) == len({url for url, _ in rows}) < 1000
    blocked = re.compile("(?<![a-z])(" + "|".join(w for w in url_filter.BLOCKED_WORDS if len(w) > 2) + ")(?![a-z])")
    parts = [url.partition("//")[2].partition("/") for url, _ in rows]
    assert sum(bool(blocked.search(p)) for _, _, p in parts) > 50 and sum(bool(blocked.search(h)) for h, _, _ in parts) > 50
    assert not any(blocked.search(url) for url, block in rows if not block)


# --- top k ---


def plain_top(rows, k=20, every=20):
    """``rows`` of (id, vector): each row's best but itself, exact, scores at most 64 bits wide."""
    fits = lambda x: max(-(1 << 63) + 2, min((1 << 63) - 1, x))
    out = []
    for at, (q, own) in enumerate(rows):
        if q % every == 0:
            scored = sorted((-fits(sum(x * y for x, y in zip(own, v))), i) for other, (i, v) in enumerate(rows) if other != at)
            out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread", [3, 1000, 100_000_000, 1 << 40])
def test_top_k_against_brute_force(spark, spread):
    rng = np.random.default_rng(spread)
    rows = [(i, rng.integers(-spread, spread, 4).tolist()) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(40)]  # ties
    rows += [(300, []), (301, [spread]), (302, [0, 0, 0, 0]), (40, rows[1][1]), (40, rows[1][1]), (40, rows[2][1]), (41, rows[2][1])]  # ids that repeat
    frame = spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "row long, vec_id long, v array<long>")
    got = topk.top_k(frame, frame.where("vec_id % 20 = 0"), k=5, pivots=4, sample=64, rings=4, block_rows=16, query_rows=4)
    assert sorted(map(tuple, got.collect())) == plain_top(rows, 5)


def test_products_are_exact_whatever_their_size():
    rng = np.random.default_rng(4)
    for bits in (10, 30, 31, 40, 62):
        a, b = (rng.integers(-(1 << bits), 1 << bits, (6, 5)) for _ in range(2))
        want = [[max(-(1 << 63) + 2, min((1 << 63) - 1, sum(int(x) * int(y) for x, y in zip(r, c)))) for c in b] for r in a]
        assert topk._products(a, b).tolist() == want


def test_which_vectors_take_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [0.5, -0.01]), (20, [1.0, 2.0]), (20, [1.0, 2.0]), (3, None), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (None, [1.0, 1.0]), (7, [-1.0, 1.0])]
    rows += [(8, [1e30, 0.0]), (40, [3e6, 5e6]), (9, [3e6, -5e6]), (10, [2.0**22, 1.0])]
    frame = topk.scaled(spark.createDataFrame([(*r, "x", 5) for r in rows], "vec_id long, embedding array<double>, score string, row int"))
    kept = [(0, [32, -1]), (20, [64, 128]), (20, [64, 128]), (7, [-64, 64]), (8, [1 << 62, 0]), (40, [192_000_000, 320_000_000]), (9, [192_000_000, -320_000_000]), (10, [1 << 28, 64])]
    assert sorted((r.vec_id, r.v) for r in frame.collect()) == sorted(kept)
    got = topk.top_k(frame, frame.where("vec_id % 20 = 0")).collect()
    assert sorted(map(tuple, got)) == plain_top(kept)
    assert topk.top_k(frame.limit(0), frame.limit(0)).count() == 0
    assert topk.top_k(frame, frame.where("vec_id = 99")).count() == 0


def test_sql_and_query_agree_on_large_values_and_repeated_ids(spark, tmp_path):
    import duckdb

    rng = np.random.default_rng(6)
    rows = [(int(i) % 60, (rng.standard_normal(3) * 10.0 ** rng.integers(0, 7)).tolist()) for i in range(200)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = connection.execute(topk.OP5_SQL).fetchall()
    assert sorted(map(tuple, topk.op5_top_k(spark, str(tmp_path)).collect())) == sorted(want) == plain_top([(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows])


def test_annuli_bounds_hold():
    rng = np.random.default_rng(2)
    v = rng.integers(-50, 50, (500, 6)).astype(float)
    pivots = topk.Pivots(np.arange(100), v[:100], float((v * v).sum(1).max()), 8, 3)
    nearest, distance = pivots.of_rows(v)
    q = v[::7]
    scores = q @ v.T
    bound = topk._bounds(pivots.of_queries(q)[:, nearest], (q * q).sum(1), pivots.square, distance, distance)
    assert (scores <= bound).all()


def test_top_k_matches_sql(spark, sf_dir):
    import duckdb

    connection = duckdb.connect()
    connection.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf_dir}/embeddings.parquet'")
    want = connection.execute(topk.OP5_SQL).fetchall()
    assert sorted(map(tuple, topk.op5_top_k(spark, sf_dir).collect())) == sorted(want)


# --- the folder ---


def test_queries_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
    assert set(ORACLES) <= set(QUERIES)


def test_nothing_else_imports_the_folder():
    code = "import sys; sys.modules['monthloom.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not any(n.startswith('op') or n == 'pipeline' for n in e.queries()); print(len(e.queries()))"
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=__file__.rsplit("/tests/", 1)[0], timeout=120)
    assert int(out.stdout) > 80, out.stderr
