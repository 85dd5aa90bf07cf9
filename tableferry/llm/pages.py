"""Main text of web pages by fused tag-path ratios."""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tableferry.llm.store import sliced

# Element names of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike "
    "strong sub sup time tt u var math mfrac mi mn mo mover mroot mrow ms mspace msqrt mstyle msub msubsup msup mtext munder "
    "munderover semantics".split()
)
RAW = frozenset("script style textarea title noscript template iframe svg select option button annotation annotation-xml".split())
CLOSES_PARAGRAPH = frozenset(
    "address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header "
    "hgroup hr main menu nav ol p pre search section table ul".split()
)
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
SCOPES = frozenset("ul ol menu dl table tbody thead tfoot article section main aside nav div body html blockquote".split())
ASIDE = frozenset("nav header footer aside form menu dialog fieldset head".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN_ELEMENTS = frozenset("article main".split())
# Words in class, id, role or aria-label that mark a part as not the article.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "dialog disqus footer header login masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination "
    "pager popup promo promoted promotion related replies reply respond search share sharing sidebar signup skip social "
    "sponsor sponsored subscribe subscription tags teaser toolbar topbar widget widgets contentinfo complementary alert".split()
)
# Words that may follow those of a part that is not the article: ``share-links`` names one, ``social-history`` does not.
PART_WORDS = frozenset(
    "area bar block body bottom box boxes button buttons col column container content entry feed form group head heading icon icons "
    "inner item items label left link links list main message messages outer page panel post posts right row section slot small "
    "strip text thread title top unit wrap wrapper zone".split()
)
# Class names that say what a part has or lacks, not what it is; names of the article's own head; and elements too large to drop.
ABOUT_OTHERS = frozenset("has no with without is not show hide".split())
ARTICLE_WORDS = frozenset("article content entry main page-title post story".split())
NEVER_ASIDE = frozenset("html body main article".split())
PUNCTUATION = ".,;:!?\u2026\u3002\uff0c\uff1b\uff1a\uff01\uff1f"

TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
ATTRIBUTE_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    """A run of text between block-level tags, and the path of block-level tags above it."""

    path: tuple[str, ...]
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    aside: bool = False
    main: bool = False
    heading: bool = False
    text: str = ""


TOP = ("", False, False, "")


def _label(name: str, attributes: str) -> str:
    """The tag, told apart by class and id, since pages reuse one tag for unlike parts."""
    marks = [a or b or c for key, a, b, c in ATTRIBUTE.findall(attributes) if key.lower() in ("class", "id")] if "=" in attributes else []
    return ".".join([name, *" ".join(marks).split()])


def _is_aside(name: str, attributes: str) -> bool:
    if name in ASIDE:
        return True
    if name in NEVER_ASIDE or "=" not in attributes and "hidden" not in attributes:
        return False
    if HIDDEN.search(attributes):
        return True
    marks = " ".join(a or b or c for _, a, b, c in ATTRIBUTE.findall(attributes))
    return any(_names_aside([w.lower() for w in ATTRIBUTE_WORD.findall(mark)]) for mark in marks.split())


def _names_aside(words: list[str]) -> bool:
    if not words or words[0] in ABOUT_OTHERS:
        return False
    found = [w for w in words if w in ASIDE_WORDS and not (w == "header" and words[0] in ARTICLE_WORDS)]
    if not found:
        return False
    after = words[len(words) - words[::-1].index(found[-1]) :]
    return all(w in PART_WORDS for w in after)


def blocks(page: str) -> list[Block]:
    """The text blocks of a page in order. Markup that is never closed, or closed twice, is tolerated."""
    stack: list[tuple[str, bool, bool, str]] = []  # tag, aside, inside a main element, label in paths
    out = [Block(())]
    links = 0

    def start_block() -> None:
        if out[-1].parts:
            out.append(Block(()))
        top = stack[-1] if stack else TOP
        path = tuple(x[3] for x in stack if x[0] not in INLINE)
        out[-1] = Block(path, aside=top[1], main=top[2], heading=top[0] in HEADINGS)

    def add(text: str) -> None:
        if text:
            if not out[-1].parts:
                start_block()
            out[-1].parts.append(text)
            if links:
                out[-1].linked += len(text)

    at, size = 0, len(page)
    while at < size:
        found = TOKEN.search(page, at)
        if not found:
            add(page[at:])
            break
        add(page[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        name, closing = found[2].lower(), bool(found[1])
        if name in RAW and not closing:
            end = re.compile(f"</{re.escape(name)}\\s*>", re.I).search(page, at)
            if end:
                at = end.end()
            elif name in ("script", "style", "title", "textarea"):
                at = size
            if name not in ("script", "style", "template"):
                start_block()
            continue
        if name == "a":
            links = max(0, links - 1) if closing else 1
        if name in INLINE:
            if not closing and _is_aside(name, found[3]):
                stack.append((name, True, bool(stack) and stack[-1][2], name))
                start_block()
            elif closing and stack and stack[-1][0] == name:
                stack.pop()
                start_block()
            continue
        if name in VOID:
            if name in ("br", "hr"):
                add(" ")
            continue
        if closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == name:
                    del stack[i:]
                    break
                if stack[i][0] in SCOPES and name not in SCOPES:
                    break
        else:
            if name in CLOSES_PARAGRAPH:
                for i in range(len(stack) - 1, -1, -1):
                    if stack[i][0] == "p":
                        del stack[i:]
                        break
                    if stack[i][0] in SCOPES:
                        break
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] in SIBLINGS.get(name, ()):
                    del stack[i:]
                    break
                if stack[i][0] in SCOPES:
                    break
            above = stack[-1] if stack else TOP
            # The header of an article holds its title; any other header belongs to the page.
            aside = _is_aside(name, found[3]) and not (name == "header" and above[2] and "=" not in found[3])
            stack.append((name, above[1] or aside, above[2] or name in MAIN_ELEMENTS, _label(name, found[3])))
        links = 0
        start_block()
    for block in out:
        block.text = " ".join(entities.unescape("".join(block.parts)).split())
    return [b for b in out if b.text]


def _punctuation(text: str) -> int:
    return sum(map(text.count, PUNCTUATION))


def smooth(values: np.ndarray, sigma: float = 1.0) -> np.ndarray:
    """Gaussian smoothing over paths in the order in which the page first shows them; the sum is kept at the edges."""
    reach = np.arange(-2, 3)
    kernel = np.exp(-(reach**2) / (2 * sigma**2))
    weight = np.convolve(np.ones(len(values)), kernel)[2:-2]
    return np.convolve(values, kernel)[2:-2] / weight


def content_paths(found: list[Block]) -> set[tuple[str, ...]]:
    """Paths whose fused ratios reach the threshold.

    For each path: text length over the number of its blocks (without text in links), and punctuation over the same number.
    Both are smoothed along the page, multiplied, and compared with a quarter of their weighted mean.
    """
    if not found:
        return set()
    order: dict[tuple[str, ...], list[float]] = {}
    for b in found:
        sums = order.setdefault(b.path, [0.0, 0.0, 0.0])
        sums[0] += 1
        sums[1] += max(0, len(b.text) - 2 * b.linked)
        sums[2] += _punctuation(b.text)
    counts, lengths, marks = np.array(list(order.values())).T
    by_length, by_marks = lengths / counts, (marks + 1) / counts
    fused = np.sqrt(by_length * by_marks)
    # A path next to the article must not gain from it: smoothing may lift a path but counts its own ratio, too.
    ratio = np.sqrt(fused * smooth(fused))
    if not lengths.sum():
        return set()
    threshold = 0.25 * float((ratio * lengths).sum() / lengths.sum())
    return {path for path, r, n in zip(order, ratio, lengths) if n > 0 and r >= threshold}


def _home(path: tuple[str, ...]) -> tuple[str, ...]:
    """The part of the page that a content path speaks for: its article or main element, else the element around it."""
    for i, label in enumerate(path):
        if label.split(".")[0] in MAIN_ELEMENTS:
            return path[: i + 1]
    return path[:-1]


def main_text(page: str | None) -> str:
    """The article of a page; parts marked as menus, notices, adverts, comments and the like never count.

    The content paths choose the parts of the page that are the article; inside those, headings, short paragraphs, quotes and
    lists stay, too. Where the body itself holds the text, only its headings and the content paths do.
    """
    found = [b for b in blocks(page or "") if not b.aside]
    found = [b for b in found if b.main] or found
    good = content_paths(found)
    if not good:
        return " ".join(b.text for b in found)
    homes = {_home(p) for p in good}
    closed = {h for h in homes if h and h[-1].split(".")[0] not in ("html", "body")}

    def belongs(b: Block) -> bool:
        if b.path in good or any(b.path[: len(h)] == h for h in closed):
            return True
        return b.heading and b.path[:-1] in homes

    return " ".join(b.text for b in found if belongs(b))


def extract(docs: DataFrame) -> DataFrame:
    """One row per page: ``page_id, url, text, n_chars``.

    A page is parsed in one go inside its task, so there is no shuffle. Null html counts as empty; a page without text gives
    an empty string and 0. Repeated rows give repeated rows, an empty table none, and other columns are not read.
    """

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(out, pa.string()), pa.array(map(len, out), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    pages = docs.selectExpr("cast(page_id as bigint) as page_id", "url", "html")
    return pages.mapInArrow(texts, "page_id bigint, url string, text string, n_chars bigint")
