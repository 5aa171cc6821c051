"""Main text of web pages by tag-path ratios.

A page is read as blocks of text, each with the path of block elements from
the root to it.  Per path, the length of the text and its punctuation are
summed and divided by the number of blocks: prose stands on paths with long,
punctuated blocks, menus on paths with many short ones.  The two ratios are
fused into one, damped by the share of linked text, smoothed over neighbouring
blocks (so that a heading or a short paragraph keeps its neighbours' weight),
and compared with a threshold.  The paths above it select the content element:
the smallest one with nearly all of their weight.  Its blocks are the article,
but for those in parts that say what they are (navigation, footers, forms,
adverts, comments, ...).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import batches_of, table

# Elements of the HTML standard by how they bear on text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style template textarea title xmp".split())
UNSEEN = frozenset("audio button canvas datalist head map math object select svg video".split())
BOILERPLATE = frozenset("aside dialog footer form menu nav search".split())
ARTICLE = frozenset("article main".split())
LEAVES = frozenset("blockquote dd dt h1 h2 h3 h4 h5 h6 li p pre td th tr".split())
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
# what an open element of the left kind ends when the right one begins
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
BOUNDARY = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "tbody": {"table"}, "option": {"select"}}
# words of class and id names that tell what a part is for
PURPOSE = re.compile(
    r"(?:^|[^a-z])(?:ads?|adsense|adv|banners?|nav|navbar|navigation|menus?|footers?|pager|pagination|popups?|modal|overlay|login|signin|signup|share|sharing|social|related|recommended|recommendations|toolbar|masthead|notices?|notifications?|alerts?|disqus|repl(?:y|ies)|respond|consent|gdpr|copyright|legal|tags|byline|skip|widgets?|search(?:box|bar|form)?)(?:[^a-z]|$)"
    r"|advert|sponsor|promo|cookie|newsletter|subscri|sidebar|breadcrumb|comment|related-|site-?header|page-?header|top-?bar"
)
# of these, the ones that name a part of an article as well: inside one, they need links behind them
DOUBTFUL = re.compile(r"(?:^|[^a-z])(?:share|sharing|social|related|recommended|recommendations|toolbar|notices?|notifications?|alerts?|repl(?:y|ies)|respond|legal|tags|byline|skip|widgets?|copyright)(?=[^a-z]|$)")
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")

TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
SPACE = re.compile(r"[ \t\n\r\f\v   -     　\u0085]+")
NEIGHBOURS = np.exp(-0.5 * (np.arange(-2, 3) / 1.0) ** 2)
THRESHOLD = 0.15
CONTENT_SHARE = 0.95
#: Of the weight of the heaviest article element, how much another one has that is part of the article as well.
ARTICLE_PART = 0.1
#: From this share of its letters on, a block or a part consists of links; less is enough behind a doubtful name.
LINKED, SOME_LINKED = 0.8, 0.3
LISTS = frozenset("dir menu ol ul".split())


class _Element:
    """A block element: its path by number, and what the blocks in it add up to."""

    __slots__ = ("tag", "parent", "path", "in_article", "said", "doubtful", "sure", "chars", "linked", "weight", "flag")

    def __init__(self, tag: str, parent: _Element | None, path: int, said: bool, doubtful: bool, sure: bool):
        self.tag, self.parent, self.path, self.said, self.doubtful, self.sure = tag, parent, path, said, doubtful, sure
        self.in_article = tag in ARTICLE or (parent is not None and parent.in_article)
        self.chars, self.linked, self.weight, self.flag = 0, 0, 0.0, False


class _Block:
    __slots__ = ("element", "text", "chars", "linked", "marks")

    def __init__(self, element: _Element, text: str, linked: int):
        self.element, self.text, self.chars, self.linked = element, text, len(text), linked
        self.marks = len(PUNCTUATION.findall(text))


def _open(tag: str, attributes: str, parent: _Element | None, paths: dict[tuple[int, str], int]) -> _Element:
    names, said, doubtful, sure = "", False, False, tag in BOILERPLATE or (tag == "header" and not (parent and parent.in_article))
    for name, value in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'").lower()
        if name in ("class", "id"):
            names += f" {value}"
        elif name == "role":
            sure = sure or value in ROLES
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and re.search(r"display\s*:\s*none", value)):
            sure = True
    if names and tag not in ("html", "body", "main"):
        said = bool(PURPOSE.search(names))
        doubtful = said and not PURPOSE.search(DOUBTFUL.sub(" ", names))
    label = f"{tag}.{names.split()[0]}" if names.strip() else tag
    path = paths.setdefault((parent.path if parent else -1, label), len(paths))
    return _Element(tag, parent, path, said, doubtful, sure)


def blocks(page: str) -> tuple[list[_Element], list[_Block]]:
    """The page's elements as they begin, the first standing for the page, and its blocks of text in order."""
    out: list[_Block] = []
    paths: dict[tuple[int, str], int] = {}
    root = _open("body", "", None, paths)
    elements = [root]
    parts: list[str] = []
    top = root
    links, unseen, linked, at, n = 0, [], 0, 0, len(page)

    def flush() -> None:
        nonlocal linked
        if parts:
            text = SPACE.sub(" ", html.unescape("".join(parts))).strip(" ")
            if text:
                out.append(_Block(top, text, min(linked, len(text))))
            parts.clear()
        linked = 0

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at and not unseen:
            parts.append(page[at:lt])
            if links:
                linked += lt - at
        if lt == n:
            break
        m = TOKEN.match(page, lt)
        if not m:  # a lone sign
            if not unseen:
                parts.append("<")
            at = lt + 1
            continue
        at = m.end()
        closes, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        if tag is None:
            continue
        tag = tag.lower()
        if closes:
            if unseen:
                if tag == unseen[-1]:
                    unseen.pop()
                continue
            if tag == "a":
                links = 0
            elif tag in BLOCK:
                flush()
                element = top
                while element is not None and element.tag != tag:
                    element = element.parent
                if element is not None and element is not root:
                    top = element.parent
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(page, at)
            at = end.end() if end else n
            if not unseen and parts:
                parts.append(" ")
            continue
        empty = tag in VOID or attributes.rstrip().endswith("/") and tag not in BLOCK
        if tag in UNSEEN or unseen:
            if not empty and (tag in UNSEEN or tag == (unseen or [""])[-1]):
                if tag == "body" or (unseen == ["head"] and tag in BLOCK):
                    unseen.clear()
                else:
                    unseen.append(tag)
                    continue
            elif unseen == ["head"] and tag in BLOCK:
                unseen.clear()
            else:
                continue
        if tag == "a":
            links = 1
        elif tag == "br":
            parts.append(" ")
        elif tag in BLOCK:
            flush()
            links = 0
            if tag == "hr":
                continue
            # a paragraph ends where another block begins; list items, rows and cells where their like do
            if top.tag == "p":
                top = top.parent
            if tag in ENDS:
                element, stop = top, BOUNDARY.get(tag, frozenset())
                while element is not None and element.tag not in stop:
                    if element.tag in ENDS[tag]:
                        top = element.parent
                    element = element.parent
            if tag in ("html", "body"):
                continue
            top = _open(tag, attributes, top, paths)
            elements.append(top)
    flush()
    return elements, out


def _boilerplate(elements: list[_Element], all_: list[_Block]) -> list[bool]:
    """Whether a block lies in a part that says it is no article.

    A name counts for less than an element: a part named so that holds most of
    the page's text is the page's frame, not its sidebar, and inside of an
    article a doubtful name needs links behind it.
    """
    for b in all_:
        b.element.chars += b.chars
        b.element.linked += b.linked
    for element in reversed(elements[1:]):
        element.parent.chars += element.chars
        element.parent.linked += element.linked
    total = elements[0].chars
    for element in elements[1:]:
        named = element.said and element.chars <= 0.6 * total
        if named and element.doubtful and element.parent.in_article:
            named = element.linked >= SOME_LINKED * element.chars
        element.flag = element.parent.flag or element.sure or named
    return [b.element.flag for b in all_]


def _menus(all_: list[_Block]) -> set[_Element]:
    """Lists of three items or more that hold nothing but links."""
    items: dict[_Element, list[bool]] = {}
    for b in all_:
        if b.element.tag == "li" and b.element.parent.tag in LISTS:
            items.setdefault(b.element.parent, []).append(b.linked >= LINKED * b.chars)
    return {element for element, linked in items.items() if len(linked) >= 3 and all(linked)}


def main_text(page: str | None) -> str:
    """The article of a page, its blocks in order, one a line; empty if there is none.

    The ratios of the paths say where the article is.  Of the elements found so,
    every block stays but those that are nothing but links: lists of links, and
    links outside of headings, paragraphs, items and cells.
    """
    if not page:
        return ""
    elements, all_ = blocks(page)
    kept = [b for b, drop in zip(all_, _boilerplate(elements, all_)) if not drop]
    if not kept:
        return ""
    sums: dict[int, list[int]] = {}
    for b in kept:
        s = sums.setdefault(b.element.path, [0, 0, 0, 0])
        for i, v in enumerate((1, b.chars, b.marks, b.linked)):
            s[i] += v
    ratio = {path: chars / n * (1 + marks / n) * (1 - linked / max(chars, 1)) for path, (n, chars, marks, linked) in sums.items()}
    value = np.log1p([ratio[b.element.path] for b in kept])
    weight = np.convolve(np.ones(len(value)), NEIGHBOURS, "full")[2:-2]
    smooth = np.convolve(value, NEIGHBOURS, "full")[2:-2] / weight
    # text stands where its path's ratio is high; short blocks among it get their neighbours' weight
    fused = np.maximum(value, smooth) * (1 - np.array([b.linked / max(b.chars, 1) for b in kept]))
    content = fused >= THRESHOLD * fused.max() if fused.max() > 0 else np.ones(len(kept), bool)
    for b, v, c in zip(kept, value, content):
        b.element.weight += v * b.chars if c else 0
    chosen = _content_elements(elements, kept)
    whole, menus = chosen != [elements[0]], _menus(kept)
    for element in elements:
        element.flag = element in chosen or (element.parent is not None and element.parent.flag)
    return "\n".join(
        b.text
        for b, c in zip(kept, content)
        if b.element.flag and (c or (whole and (b.linked < LINKED * b.chars or b.element.tag in LEAVES))) and b.element.parent not in menus
    )


def _content_elements(elements: list[_Element], kept: list[_Block]) -> list[_Element]:
    """The elements that make up the article.

    Article elements, where they have most of the weight: the outermost, all
    that have a part of it; one that has nearly all of another's weight stands
    for it.  Otherwise the smallest element with nearly all weight, and those
    around it as long as they add only headings and paragraphs of their own.
    """
    for element in reversed(elements[1:]):
        element.parent.weight += element.weight
        element.flag = False
    total = elements[0].weight
    if not total:
        return [elements[0]]
    outer = [e for e in elements[1:] if e.tag in ARTICLE and not e.parent.in_article and e.weight > 0]
    if sum(e.weight for e in outer) >= 0.5 * total:
        most = max(e.weight for e in outer)
        return [_tightest(e, elements) for e in outer if e.weight >= ARTICLE_PART * most]
    large = [e for e in elements if e.weight >= CONTENT_SHARE * total and (e.tag not in LEAVES or e is elements[0])]
    best = min(large, key=lambda e: e.chars)
    while best.parent is not None:
        inside = [i for i, b in enumerate(kept) if _within(b.element, best)]
        around = [(i, b.element) for i, b in enumerate(kept) if _within(b.element, best.parent) and not _within(b.element, best)]
        if not around or any(e.tag not in LEAVES or e.parent is not best.parent for _, e in around):
            break
        if best.parent.parent is None and any(i > inside[0] for i, _ in around):
            break  # what follows on the page itself is as likely its foot
        best = best.parent
    return [best]


def _tightest(article: _Element, elements: list[_Element]) -> _Element:
    """The innermost article element in this one that has nearly all of its weight."""
    inner = [e for e in elements if e.tag in ARTICLE and e.weight >= CONTENT_SHARE * article.weight and _within(e, article)]
    return inner[-1] if inner else article


def _within(element: _Element | None, other: _Element) -> bool:
    while element is not None and element is not other:
        element = element.parent
    return element is other


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text``, the main text of ``html``; null and empty html gives an empty text, further columns stay, but for one that is named text."""
    names = [c for c in pages.columns if c not in ("html", "text")]
    kinds = dict(pages.dtypes)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in batches_of(whole, "html", 8 << 20):
                text = pa.array([main_text(x.as_py()) for x in batch["html"]], pa.string())
                yield pa.RecordBatch.from_arrays([*(batch[c] for c in names), text], names=[*names, "text"])

    return pages.select(*[F.col(f"`{c}`") for c in names], "html").mapInArrow(rows, ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", text string")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return text.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
