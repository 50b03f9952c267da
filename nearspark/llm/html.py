"""Main text of web pages by tag-path ratios.

A page is read into blocks of text. A block's tag path is the chain of block elements from
the root to it, each with its class. Text length, punctuation and link share are summed per
path, smoothed over the blocks in page order and fused into one weight per path; a class or
id that names a sidebar, comments and the like lessens it. Paths whose weight reaches the
threshold are heavy: they are the content nodes. Kept is what belongs with them: whole
articles that hold the heavy text; in a page that articles don't divide, what lies between
heavy blocks or in a container of some, but for lists of links. Elements that are no text by
their tag or role (menus, forms, scripts and so on) are never read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import common

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*(?:\"[^\"]*(?:\"|$)|'[^']*(?:'|$))?)*)(>|$)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
WORD = re.compile(r"[a-z]+")
BLANK = re.compile(r"\s+")
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: A start tag of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section summary table ul".split())
#: A start tag ends an open element of the same family, up to the family's container.
FAMILY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
HOLDS = frozenset("ul ol menu dl table select body article section div".split())
SKIP = frozenset("head nav footer aside form script style noscript template iframe object button select option textarea svg canvas audio video title dialog menu noembed noframes xmp".split())
SKIP_ROLE = frozenset("navigation banner contentinfo complementary search dialog alertdialog menu menubar form alert".split())
#: A class or id of these words, beside words that tell nothing, names an element that is not part of the text.
SKIP_WORD = frozenset(
    "ad ads advert adverts advertisement advertising adbox banner sponsor sponsored promo promotion menu nav navbar navigation breadcrumb breadcrumbs sidebar sidenav footer masthead toolbar cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments commentlist disqus discussion replies respond widget pagination pager skip".split()
)
PLAIN_WORD = frozenset("a the and to of list box area section wrap wrapper container block item items body inner outer top bottom left right site page main post link links button buttons bar form primary secondary global header text title icon icons group row col column js is c e m u x".split())
#: What such a name leaves of a path's weight.
NAMED = 0.01
#: Part of the text on heavy paths that articles and main elements hold at least; otherwise the page is not taken to be divided by them.
MOST = 0.7
#: Part of a list's or container's characters inside links above which it is a menu, unless it holds a heavy path.
LINKED = 0.6
#: Elements that hold blocks of their own kind rather than a part of the page.
CONTAINER = frozenset("html body div section td center main article fieldset".split())
#: Blocks rather than containers: links alone don't make a menu of them.
SINGLE = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th pre figcaption caption summary".split())


class _Element:
    """An open or closed element. What it inherits is set when it opens; sums over its blocks are added up from the last element to the first."""

    __slots__ = ("name", "skip", "parent", "path", "inside", "soft", "named", "top", "holder", "size", "linked", "heavy")

    def __init__(self, name: str, skip: bool, parent: _Element | None, path: int, soft: bool):
        self.name, self.skip, self.parent, self.path, self.soft = name, skip, parent, path, soft
        self.inside = bool(parent and parent.inside) or name in ("article", "main")
        # comments and the like that are article elements are none
        article = name == "main" or name == "article" and not soft
        self.top = parent.top if parent and parent.top else self if article else None
        self.named = soft or bool(parent and parent.named)
        self.holder = self if name in CONTAINER or not parent else parent.holder
        self.size = self.linked = 0
        self.heavy = False


def _attributes(raw: str) -> dict[str, str]:
    """Attributes by lower-case name, the first of equals."""
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(raw):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def _skips(name: str, attributes: dict[str, str], in_article: bool) -> bool:
    if name in SKIP or name == "header" and not in_article:
        return True
    if name in ("html", "body", "article", "main") or not attributes:
        return False
    return attributes.get("role", "").strip().lower() in SKIP_ROLE or "hidden" in attributes or attributes.get("aria-hidden", "").lower() == "true"


def _named(attributes: dict[str, str]) -> bool:
    """Whether a class or the id says that the element is not part of the text."""
    for value in f"{attributes.get('class', '')} {attributes.get('id', '')}".lower().split():
        words = set(WORD.findall(value))
        if not SKIP_WORD.isdisjoint(words) and words <= SKIP_WORD | PLAIN_WORD:
            return True
    return False


def blocks(html: str) -> tuple[list[tuple[str, _Element | None, int]], list[_Element]]:
    """(text, its innermost block element, characters inside links) of each block that isn't skipped, in page order; and all elements."""
    out: list[tuple[str, _Element | None, int]] = []
    stack: list[_Element] = []
    every: list[_Element] = []
    paths: dict[tuple, int] = {}
    open_: dict[str, int] = defaultdict(int)
    parts: list[str] = []
    links = anchors = 0

    def flush() -> None:
        nonlocal links
        if parts:
            text = BLANK.sub(" ", "".join(parts)).strip()
            if text:
                out.append((text, stack[-1] if stack else None, min(links, len(text))))
            parts.clear()
        links = 0

    def add(raw: str) -> None:
        nonlocal links
        if raw and not (stack and stack[-1].skip):
            text = unescape(raw)
            parts.append(text)
            if anchors:
                links += len(text)

    def close(name: str, until: frozenset = frozenset()) -> bool:
        nonlocal anchors
        if not open_[name]:
            return False
        for i in range(len(stack) - 1, -1, -1):
            if stack[i].name == name:
                flush()
                for e in stack[i:]:
                    open_[e.name] -= 1
                del stack[i:]
                anchors = 0
                return True
            if stack[i].name in until:
                return False
        return False

    at, n = 0, len(html)
    while at < n:
        m = TOKEN.search(html, at)
        if not m:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        if m[2] is None or not m[4]:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "a":
                anchors = max(0, anchors - 1)
            if name == "br":
                add(" ")
            elif name not in INLINE and not (name == "p" and close("p", frozenset(["article", "body"]))) and name != "p":
                close(name)
            continue
        if name == "br" or name == "wbr":
            add(" " if name == "br" else "")
            continue
        if name in INLINE:
            if name == "a":
                anchors = 1
            continue
        if name in ENDS_P:
            close("p", frozenset(["button", "td", "th", "table"]))
        for other in FAMILY.get(name, ()):
            close(other, HOLDS - {"div", "section", "article"} if name not in ("td", "th") else frozenset(["tr", "table"]))
        if name in VOID:
            flush() if name == "hr" else add(" " if name in ("img", "input") else "")
            continue
        flush()
        parent = stack[-1] if stack else None
        if name in RAW:
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if name in ("html", "body") and open_[name]:
            continue
        if name == "body":
            close("head")
            parent = stack[-1] if stack else None
        attributes = _attributes(m[3]) if m[3] else {}
        skip = bool(parent and parent.skip) or _skips(name, attributes, bool(parent and parent.inside))
        key = parent.path if parent else -1, name, attributes.get("class", "")
        path = paths.setdefault(key, len(paths))
        stack.append(_Element(name, skip, parent, path, name not in ("html", "body", "main") and _named(attributes)))
        every.append(stack[-1])
        open_[name] += 1
    flush()
    return out, every


def weights(found: list[tuple[str, _Element | None, int]]) -> np.ndarray:
    """The weight of each block's path: its ratios, smoothed over neighbouring blocks so that short blocks amid long ones count with them, and lessened by names."""
    at = np.unique([e.path if e else -1 for _, e, _ in found], return_inverse=True)[1]
    total = lambda x: np.bincount(at, x)[at]
    count, length = total(np.ones(len(at))), total([len(t) for t, _, _ in found])
    marks, linked = total([len(PUNCTUATION.findall(t)) for t, _, _ in found]), total([k for _, _, k in found])
    raw = (length / count) * (1 + marks / count) * (1 - linked / length)
    kernel = np.array([1.0, 2.0, 4.0, 2.0, 1.0])
    soft = np.convolve(raw, kernel)[2:-2] / np.convolve(np.ones(len(raw)), kernel)[2:-2]
    own = total(np.sqrt(soft * raw)) / count
    return own * np.where([e is not None and e.named for _, e, _ in found], NAMED, 1.0)


def main_text(html: str | None, ratios: bool = True) -> str:
    """The kept blocks of a page, joined by two line breaks. Without ``ratios`` every path is heavy."""
    found, every = blocks(html or "")
    if not found:
        return ""
    weight = weights(found)
    heavy = weight >= float(np.std(weight)) * (1 - 1e-9) if ratios else np.ones(len(found), bool)
    for (text, e, links), h in zip(found, heavy.tolist()):
        if e:
            e.size += len(text)
            e.linked += links
            e.heavy |= h
    for e in reversed(every):
        if e.parent:
            e.parent.size += e.size
            e.parent.linked += e.linked
            e.parent.heavy |= e.heavy
    # an element that says so is left out, but its name alone doesn't do away with heavy text
    gone: dict[_Element | None, bool] = {None: False}
    menu: dict[_Element | None, bool] = {None: False}
    for e in every:
        gone[e] = gone[e.parent] or e.soft and not e.heavy
        menu[e] = menu[e.parent] or not e.heavy and e.name not in SINGLE and e.linked > LINKED * e.size
    plain = [len(text) - links for text, _, links in found]
    roots = {e.top for _, e, _ in found if e and e.top and e.top.heavy}
    divided = sum(n for n, h, (_, e, _) in zip(plain, heavy, found) if h and e and e.top) >= MOST * sum(n for n, h in zip(plain, heavy) if h)
    if roots and divided:
        keep = [e is not None and e.top in roots and not gone[e] for _, e, _ in found]
    else:
        first, last = (int(x) for x in np.flatnonzero(heavy)[[0, -1]])
        keep = [not gone[e] and not menu[e] and (first <= i <= last or e is None or e.holder.heavy) for i, (_, e, _) in enumerate(found)]
    return "\n\n".join(text for (text, _, _), k in zip(found, keep) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """id, url, text and n_chars (code points) of every page, from its whole html.

    Null, empty and text-free pages give an empty text; broken or cut-off markup is read as
    browsers do; repeated rows are read each; a null id or url stays null. Other columns
    aren't read. Nothing is shuffled.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.text_slices(batch, "html"):
                texts = [main_text(h) for h in part.column("html").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["id", "url", "text", "n_chars"])

    kept = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    kind = kept.schema["id"].dataType.simpleString()
    return kept.mapInArrow(common.trimmed(run), f"id {kind}, url string, text string, n_chars long").withColumnsRenamed({"id": id_col, "url": url_col})
