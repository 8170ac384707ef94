"""Main text of web pages by tag-path ratios.

A page is cut into blocks: the text between two block-level tags, with the path of labelled tags (name and first class or id, without digits) from the
root.  Per path, text outside links and punctuation are summed and divided by the path's blocks; both ratios are smoothed over neighbouring
blocks in page order with a Gaussian, brought back to paths as means, and fused as a geometric mean.  Paths whose fused ratio
reaches the threshold (a share of the standard deviation over the page's blocks) hold the article.  Where the page marks its article, all blocks in the marked
elements that hold chosen text count; else the innermost element with most of the chosen text is the content root, and its blocks count, headings
and short paragraphs included, and blocks outside it whose paths score like its own.  Tags, roles and class names that say menu, footer, advert, notice,
form, comments and the like take their blocks out before ratios are formed.

Defined results: null, empty and blank pages, and pages with nothing but markup, have an empty text; tags may be unclosed, misnested or cut off at the end of the
page, an unfinished tag has no text; pages without any tags are one block; rows are worked on alone, so repeated rows and ids give equal
rows; an empty table gives an empty one; other columns of the input are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from estatelens.llm.common import slices

#: Smoothing over neighbouring blocks, the threshold as a share of the standard deviation, and the part of the chosen text that the content root holds.
SIGMA, RADIUS, THRESHOLD, MOST = 1.0, 2, 0.3, 0.8
#: A block outside the content root counts from this share of the chosen text's mean score on.
LIKE = 0.6
#: A path with this share of its text in links is a menu.
LINKS = 0.7

# HTML's elements by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
#: No article text inside, whatever it looks like.
APART = frozenset(
    "script style noscript template iframe svg math object embed canvas audio video head title nav aside footer dialog menu form fieldset select option button textarea"
    " input datalist xmp noembed noframes".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar status".split())
#: Words of a class or an id that say what an element is for.
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner nav navbar navigation menu menubar submenu breadcrumb breadcrumbs sidebar"
    " widget widgets footer footnav masthead toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup login"
    " search share sharing social related recommended recommendations comments comment commentlist disqus respond replies reply form pagination pager copyright skip".split()
)
#: Only page headers go; the header of an article holds its title.
HEADERS = frozenset(["header", "topbar"])
ARTICLE = frozenset(["article", "main"])
#: A start tag that ends open elements of these names, up to the nearest of the limits.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")), "option": (("option",), ("select",)),
    "tbody": (("tr", "td", "th", "thead", "tbody"), ("table",)), "tfoot": (("tr", "td", "th", "thead", "tbody"), ("table",)), "body": (("head",), ()),
}
#: Inside these, an end tag outside or a start of a paragraph reaches no further.
WALLS = frozenset(["table", "td", "th", "caption", "button", "object", "template"])

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attributes>(?:[^\"'>]|\"[^\"]*\"|'[^']*')*+)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*(?:>|\Z)", re.DOTALL
)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/]|\Z)", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_PUNCTUATION = re.compile(r"[.,;:!?。，、；：！？…]")


class Element(NamedTuple):
    number: int
    name: str
    step: str
    #: No text below it counts.
    apart: bool
    #: The outermost article around it and the outermost main part, 0 where there is none.
    article: int
    main: int


class Block(NamedTuple):
    text: str
    linked: int
    path: str
    elements: tuple[int, ...]
    article: int
    main: int


def _element(number: int, name: str, attributes: str, above: Element | None) -> Element:
    found = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)} if attributes else {}
    label = found.get("class") or found.get("id") or ""
    words = set()
    for value in (found.get("class", ""), found.get("id", "")):
        words.update(_WORD.findall(_CAMEL.sub(" ", value).lower()))
    article, main = (above.article, above.main) if above else (0, 0)
    inside = article or main
    page_header = not inside and (name == "header" or (words & HEADERS and name not in ARTICLE and name != "body"))
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", "").lower()
    named = bool(words & NAMES) and name not in ("html", "body", *ARTICLE - {"article"})
    apart = (above is not None and above.apart) or name in APART or bool(page_header) or hidden or named or found.get("role", "").lower() in ROLES
    step = name + (("." + re.sub(r"\d+", "", label.split()[0])) if label.split() else "")
    if name == "article":
        article = article or number
    if name == "main" or found.get("role", "").lower() == "main":
        main = main or number
    return Element(number, name, step, apart, article, main)


def _close(stack: list[Element], names: tuple[str, ...], walls: frozenset[str] | tuple[str, ...], run: bool = False) -> None:
    """Leave the innermost open element of the ``names`` that no wall shields; with ``run`` also those right around it."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k].name in walls:
            return
        if stack[k].name in names:
            while run and k and stack[k - 1].name in names:
                k -= 1
            del stack[k:]
            return


def blocks(page: str) -> list[Block]:
    """The page's blocks that may belong to the article, in page order."""
    stack: list[Element] = []
    out, held, linked, at, number, links = [], [], 0, 0, 0, 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text and not (stack and stack[-1].apart):
                marked = (stack[-1].article, stack[-1].main) if stack else (0, 0)
                out.append(Block(text, min(linked, len(text)), "/".join(e.step for e in stack), tuple(e.number for e in stack), *marked))
            held.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        if text and not (stack and stack[-1].apart):
            plain = unescape(text)
            held.append(plain)
            linked += len(plain.strip()) if links else 0

    while at < len(page):
        found = _TOKEN.search(page, at)
        say(page[at : found.start() if found else len(page)])
        if found is None:
            break
        at, name = found.end(), (found["name"] or "").lower()
        if not name:
            continue
        if name in INLINE:
            if name == "a":
                links = 0 if found["end"] else 1
            continue
        if name == "br":
            say(" ")
            continue
        flush()
        links = 0
        if found["end"]:
            _close(stack, (name,), WALLS if name not in WALLS else ("table",) if name != "table" else ())
            continue
        ends, limits = ENDS.get(name, (("p",), WALLS))
        _close(stack, ends, limits, run=True)
        if name in VOID:
            continue
        number += 1
        stack.append(_element(number, name, found["attributes"], stack[-1] if stack else None))
        if name in RAW:
            close = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
            at = close.end() if close else len(page)
            stack.pop()
    flush()
    return out


def path_scores(found: list[Block]) -> np.ndarray:
    """Each block's fused ratio: that of its path."""
    _, path = np.unique([b.path for b in found], return_inverse=True)
    times = np.bincount(path)
    plain = np.bincount(path, [len(b.text) - b.linked for b in found]) / times
    marks = np.bincount(path, [len(_PUNCTUATION.findall(b.text)) for b in found]) / times
    reach = np.arange(-RADIUS, RADIUS + 1)
    kernel = np.exp(-(reach**2) / (2 * SIGMA**2))
    weight = np.convolve(np.ones(len(found)), kernel, mode="full")[RADIUS : RADIUS + len(found)]

    def smooth(ratio: np.ndarray) -> np.ndarray:
        near = np.convolve(ratio[path], kernel, mode="full")[RADIUS : RADIUS + len(found)] / weight
        return np.bincount(path, near) / times

    fused = np.sqrt(smooth(plain) * (1 + smooth(marks)))
    links = np.bincount(path, [b.linked for b in found]) / np.maximum(np.bincount(path, [len(b.text) for b in found]), 1)
    return np.where(links >= LINKS, 0.0, fused)[path]


def main_text(page: str | None) -> str:
    """The article's blocks, joined by an empty line."""
    found = blocks(page or "")
    if not found:
        return ""
    scores = path_scores(found)
    chosen = (scores >= min(THRESHOLD * scores.std(), scores.max())) & (scores > 0)
    # Where a page marks its article, or at least its main part, what lies outside is not part of it.
    for marked in ([b.article for b in found], [b.main for b in found]):
        roots = {m for m, yes in zip(marked, chosen, strict=True) if m and yes}
        if roots:
            return "\n\n".join(b.text for b, m in zip(found, marked, strict=True) if m in roots)
    if not chosen.any():
        return ""
    weights = np.array([len(b.text) for b in found]) * chosen
    held: dict[int, float] = {}
    for block, weight in zip(found, weights, strict=True):
        for element in block.elements:
            held[element] = held.get(element, 0) + weight
    # Elements that hold most of it lie in one another; numbers grow inwards.
    parents = {e: (0, *block.elements)[k] for block in found for k, e in enumerate(block.elements)}
    root = max((e for e, weight in held.items() if weight >= MOST * weights.sum()), default=0)
    if sum(root in b.elements for b in found) == 1:  # a single block: those beside it belong to it
        root = parents.get(root, 0)
    like = LIKE * (scores * weights).sum() / weights.sum()
    within = [root == 0 or root in b.elements for b in found]
    return "\n\n".join(b.text for b, inside, score in zip(found, within, scores, strict=True) if (inside and score > 0) or score >= like)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in slices(batches, "html"):
        texts = [main_text(page) for page in part.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [part.column("page_id"), part.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``text`` and its length in code points for every page."""
    kinds = {c: pages.schema[c].dataType.simpleString() for c in ("page_id", "url")}
    return pages.select("page_id", "url", "html").mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")
