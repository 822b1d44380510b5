"""Main text of web pages: element subtrees that recur across a host's pages go, then known page furniture."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from html import unescape

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import bounded_batches, store

# Names of HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
FURNITURE = frozenset(
    "head script style noscript template nav footer aside form button select input textarea label fieldset iframe svg canvas object embed audio video dialog menu".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar".split())
#: Words that mark furniture where a class or id consists of them, and words that may stand beside them in one.
MARKS = frozenset(
    """ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices popup modal overlay
    newsletter subscribe subscription signup login sidebar sidenav nav navbar navigation menu menus breadcrumb breadcrumbs footer header masthead topbar toolbar share
    sharing social related recommended recommendations comment comments disqus respond reply replies widget widgets pagination pager skip skiplink""".split()
)
BESIDE = frozenset(
    "area bar block bottom box button buttons col column container content div fixed form global group id inner item items left link links list main module outer page panel right section site small sticky sub tools top unit user wrap wrapper zone".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose subtrees may be a site's template: blocks that hold others, and paragraphs; no inline element, cell, list item or heading.
BLOCKS = frozenset("address aside blockquote center details div dl fieldset figure footer form header menu nav ol p section table ul".split())
#: Elements that end no block where they are left out.
UNSEEN = frozenset("script style noscript template svg canvas object embed audio video iframe button select input textarea label".split())
#: What the start of an element closes: the elements named, looked for up to a boundary.
_P_CLOSERS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
_CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}),
           "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
_INLINE_BOUNDARY = ("article", "body", "table", "td")
_P_BOUNDARY = frozenset("article aside blockquote body caption div dd dl fieldset footer form header html li main nav object ol section table td th ul".split())

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+>|<(/?)([A-Za-z][^\s/>]*+)((?:[^"'>]++|"[^"]*+"|'[^']*+'|["'])*?)>""", re.S)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_SPACES = re.compile(r"\s+")
_NAMES = re.compile(r"[a-z0-9]+")


@dataclass(slots=True)
class Element:
    tag: str
    attributes: dict[str, str]
    children: list[Element | str] = field(default_factory=list)
    digest: int = 0  # of tags and text; 0 without text
    parts: int = 0  # children with text


class _Open:
    """The open elements, and where in their stack each tag stands: every look-up is one step, however deep the page."""

    def __init__(self, root: Element):
        self.stack = [root]
        self.places: dict[str, list[int]] = {}

    def last(self, tags: Iterable[str]) -> int:
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=-1)

    def push(self, node: Element) -> None:
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            self.places[self.stack.pop().tag].pop()


def _attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(raw)} if "=" in raw or "hidden" in raw else {}


def parse(html: str) -> Element:
    """The element tree, unclosed and stray tags mended by the usual rules, in linear time."""
    root = Element("html", {})
    open_, at = _Open(root), 0
    while True:
        m = _TOKEN.search(html, at)
        if text := html[at : m.start() if m else len(html)]:
            open_.stack[-1].children.append(unescape(text) if "&" in text else text)
        if m is None:
            return root
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            place = open_.last((tag,))
            if place > 0 and not (tag in INLINE and open_.last(_INLINE_BOUNDARY) > place):
                open_.cut(place)
            continue
        if tag in _P_CLOSERS and (place := open_.last(("p",))) > open_.last(_P_BOUNDARY):
            open_.cut(place)
        if tag in _CLOSES:
            names, boundary = _CLOSES[tag]
            if (place := open_.last(names)) > 0 and place >= open_.last(boundary):
                open_.cut(place)
        node = Element(tag, _attributes(m[3]))
        open_.stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}", re.I).search(html, at)
            at = html.find(">", end.end()) + 1 if end else len(html)
            at = at or len(html)
        elif tag not in VOID and not m[3].endswith("/"):
            open_.push(node)


def _marked(token: str, whole: bool) -> bool:
    """Does a class or id name furniture? ``whole``: only if it is such a word itself; else if it consists of such words and what may stand beside them."""
    words = _NAMES.findall(re.sub(r"(?<=[a-z])(?=[A-Z])", " ", token).lower())
    if whole:
        return len(words) == 1 and words[0] in MARKS
    return any(w in MARKS for w in words) and all(w in MARKS or w in BESIDE or w.isdigit() for w in words)


def is_furniture(node: Element, inside_article: bool) -> bool:
    """Menus, footers, sidebars, notices, adverts, forms, scripts, comments: by element, role, class, id or hidden state.

    The header of a page is furniture; an article's own header keeps its headings. A name counts as a whole: ``cookie-notice`` and ``userComments`` are
    furniture, ``related-work`` and ``share-of-market`` are not; headings are judged by no name, and other small elements by single words.
    """
    if node.tag in FURNITURE or node.tag == "header" and not inside_article:
        return True
    a = node.attributes
    if not a or node.tag in ("html", "body", "article", "main"):
        return False
    if "hidden" in a or a.get("aria-hidden") == "true" or a.get("role") in ROLES or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    if node.tag in HEADINGS:
        return False
    small = node.tag not in BLOCKS or node.tag == "p"
    return any(_marked(token, small) for token in f"{a.get('class', '')} {a.get('id', '')}".split())


def _is_main(node: Element) -> bool:
    return node.tag in ("article", "main") or node.attributes.get("role") == "main"


def _walk(root: Element) -> Iterator[tuple[Element, bool]]:
    """Elements in page order, each with whether it lies within an article. Without recursion, so that depth has no limit."""
    todo = [(root, False)]
    while todo:
        node, article = todo.pop()
        yield node, article
        inside = article or _is_main(node)
        todo.extend((c, inside) for c in reversed(node.children) if isinstance(c, Element))


def annotate(root: Element) -> None:
    """Give every element the digest of its subtree: tags and squeezed text, whatever the attributes."""
    for node, _ in reversed(list(_walk(root))):
        digest = xxhash.xxh3_64(node.tag)
        seen = False
        for child in node.children:
            if isinstance(child, str):
                squeezed = " ".join(child.split())
                seen = seen or bool(squeezed)
                digest.update("\0" + squeezed)
            else:
                node.parts += child.digest != 0 and child.tag not in INLINE
                seen = seen or child.digest != 0
                digest.update(child.digest.to_bytes(8, "little"))
        node.digest = (digest.intdigest() or 1) if seen else 0


def _articles(root: Element) -> list[Element]:
    """The outermost articles outside furniture, else main elements."""
    for wanted in ("article", "main"):
        found: list[Element] = []
        todo = [root]
        while todo:
            node = todo.pop()
            if node.tag == wanted or wanted == "main" and node.attributes.get("role") == "main":
                found.append(node)
            elif not is_furniture(node, False):
                todo.extend(c for c in reversed(node.children) if isinstance(c, Element))
        if found:
            return found
    return []


def _blocks(root: Element) -> list[str]:
    """Texts of the blocks below an element, furniture left out; white space inside a block is one space, and blocks are trimmed."""
    blocks: list[str] = []
    pieces: list[str] = []
    todo: list[tuple[Element | str | None, bool, bool]] = [(root, _is_main(root), False)]
    while todo:
        node, article, header = todo.pop()
        if node is None:
            if pieces and (block := _SPACES.sub(" ", "".join(pieces)).strip()):
                blocks.append(block)
            pieces = []
        elif isinstance(node, str):
            pieces.append(node)
        elif is_furniture(node, article):
            if node.tag not in INLINE and node.tag not in UNSEEN:
                todo.append((None, article, header))
        elif node.tag == "br":
            pieces.append(" ")
        else:
            inside = article or _is_main(node)
            # Of an article's header the headings stay.
            only = (header or node.tag == "header") and node.tag not in HEADINGS
            kept = [c for c in node.children if not only or isinstance(c, Element) and (c.tag in HEADINGS or c.tag not in INLINE)]
            border = [] if node.tag in INLINE else [(None, article, header)]
            todo.extend([*border, *[(c, inside, only) for c in reversed(kept)], *border])
    if block := _SPACES.sub(" ", "".join(pieces)).strip():
        blocks.append(block)
    return blocks


def _main_blocks(root: Element) -> list[str]:
    """The blocks of the articles; of the whole page if there are none or if most of its text lies outside them."""
    whole = _blocks(root)
    found = _articles(root)
    if not found:
        return whole
    inside = [b for part in found for b in _blocks(part)]
    return inside if 2 * sum(map(len, inside)) >= sum(map(len, whole)) else whole


def _text_hash(blocks: list[str]) -> int:
    return xxhash.xxh3_64_intdigest("\n".join(blocks))


def subtree_hashes(html: str) -> tuple[int, dict[int, int]]:
    """A hash of the main text, and the digests of all block subtrees of the page, each with its kind.

    Kind 0: within an article; 1: one block of text outside; 2: several blocks outside. A digest found in more than one kind has the least.
    """
    root = parse(html)
    annotate(root)
    found: dict[int, int] = {}
    for node, article in _walk(root):
        if node.digest and node.tag in BLOCKS:
            kind = 0 if article else 1 if node.parts < 2 else 2
            found[node.digest] = min(found.get(node.digest, 2), kind)
    return _text_hash(_main_blocks(root)), found


def without(root: Element, template: frozenset[int]) -> int:
    """Empty the block subtrees whose digests are in ``template``, outermost first; returns how many."""
    gone, todo = 0, [root]
    while todo:
        node = todo.pop()
        if node.digest in template and node.tag in BLOCKS:
            node.children, gone = [], gone + 1
        else:
            todo.extend(c for c in node.children if isinstance(c, Element))
    return gone


def main_text(html: str, template: frozenset[int] = frozenset()) -> str:
    """The text of the main part: the site's template goes first, then known furniture; blocks with text are joined in page order by a line feed."""
    root = parse(html)
    if template:
        annotate(root)
        without(root, template)
    return "\n".join(_main_blocks(root))


def host(url: str | Column) -> Column:
    """Host of a URL in lower case; null where there is none."""
    found = F.regexp_extract(F.lower(F.col(url) if isinstance(url, str) else url), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]+)", 1)
    return F.when(found != "", found)


def _signed(values: list[int]) -> np.ndarray:
    return np.array(values, np.uint64).view("i8")


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows, pages, values, kinds = [], [], [], []
        for i, html in enumerate(batch.column("html").to_pylist()):
            page, found = subtree_hashes(html)
            found[0] = 0  # the page itself
            rows += [i] * len(found)
            pages += [page] * len(found)
            values += found
            kinds += found.values()
        hosts = batch.column("host").take(pa.array(rows, pa.int64()))
        yield pa.RecordBatch.from_arrays([hosts, pa.array(_signed(pages)), pa.array(_signed(values)), pa.array(kinds, pa.int32())], ["host", "page", "node", "kind"])


#: The least share of a host's pages by kind of subtree: within an article, one block outside, several blocks outside.
SHARES = (0.5, 0.5, 0.2)


def templates(pages: DataFrame, min_pages: int = 10, shares: tuple[float, float, float] = SHARES) -> DataFrame:
    """(of, template): per host, the digests of the block subtrees found on at least ``min_pages`` of its pages and on a share of them.

    All of the page is looked at, menus and footers too; inline elements, cells, list items and headings are never a template of their own. Pages whose main
    texts are equal count once, so copies of one article never make its text a template. The share depends on where a subtree stands (``SHARES``); one that is
    also found in an article needs an article's. Counts are combined before they are shuffled, so a host with a third of all pages is no hot group.
    A host's list is bounded: a subtree on a share s of the pages leaves room for 1 / s per element of a page.
    """
    nodes = pages.filter("host IS NOT NULL").select("host", F.coalesce("html", F.lit("")).alias("html")).mapInArrow(
        _hashes, "host string, page long, node long, kind int"
    )
    distinct = nodes.groupBy("host", "node", "page").agg(F.min("kind").alias("kind"))
    counts = distinct.groupBy("host", "node").agg(F.count(F.lit(1)).alias("n"), F.min("kind").alias("kind"))
    counts = store(counts.filter((F.col("n") >= min_pages) | (F.col("node") == 0)))
    totals = counts.filter("node = 0").select("host", F.col("n").alias("all"))
    least = F.get(F.array(*[F.lit(x) for x in shares]), F.col("kind"))
    frequent = counts.join(totals, "host").filter(F.col("n") >= F.col("all") * least)
    return frequent.filter("node <> 0").groupBy(F.col("host").alias("of")).agg(F.collect_list("node").alias("template"))


@F.pandas_udf(T.StringType())
def _extract(htmls: pd.Series, found: pd.Series) -> pd.Series:
    known: dict[bytes, frozenset[int]] = {}

    def one(html: str, template: np.ndarray | None) -> str:
        if template is None:
            return main_text(html)
        raw = np.asarray(template, "i8").tobytes()
        if raw not in known:
            known[raw] = frozenset(np.frombuffer(raw, "u8").tolist())
        return main_text(html, known[raw])

    return pd.Series([one(h, t) for h, t in zip(htmls, found, strict=True)], dtype=object)


def extract_pages(pages: DataFrame, min_pages: int = 10, shares: tuple[float, float, float] = SHARES) -> DataFrame:
    """Every page with its main ``text``, empty if it has none; other columns pass through, an input column ``text`` is replaced.

    Null html is empty; null urls and urls without a host get no template removal. Repeated rows and page ids are extracted alike. Each page is one row of one task.
    """
    bounded_batches(pages.sparkSession)
    read = pages.select(F.struct("*").alias("row"), host("url").alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    known = store(templates(pages.select(host("url").alias("host"), "html"), min_pages, shares))
    text = read.join(known, F.col("host") == F.col("of"), "left").select("row", _extract("html", "template").alias("text"))
    return text.select(*[F.col(f"row.`{c}`").alias(c) for c in pages.columns if c != "text"], "text")
