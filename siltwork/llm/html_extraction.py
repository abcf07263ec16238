"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import itertools
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, small_batches

# a quote opens a value only after "="; one that is never closed is part of the tag up to the next ">"
_MARKUP = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[(?P<cdata>.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?>=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>""",
    re.S,
)
_ATTR = re.compile(r"""([^\s=/"'<>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li "
    "legend main menu nav ol optgroup option p pre search section select summary table tbody td tfoot th thead tr ul".split()
)
CLOSES = {
    **{t: frozenset({"p"}) for t in "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()},
    "li": frozenset({"li", "p"}), "dd": frozenset({"dd", "dt", "p"}), "dt": frozenset({"dd", "dt", "p"}), "tr": frozenset({"tr", "td", "th", "p"}), "td": frozenset({"td", "th", "p"}),
    "th": frozenset({"td", "th", "p"}), "tbody": frozenset({"tr", "td", "th", "thead", "tbody", "tfoot", "p"}), "tfoot": frozenset({"tr", "td", "th", "thead", "tbody", "p"}), "option": frozenset({"option"}),
}
#: What an open element must not be closed across.
_WALLS = frozenset("ul ol dl table body html article section main div blockquote td th aside nav footer header form".split())
#: Elements whose text is never shown as prose.
NOT_TEXT = frozenset("head script style template noscript iframe svg math canvas object audio video select button textarea".split())
#: The prior: elements, roles and names that speak against an article, and how much each of them weighs.
NOT_ARTICLE = frozenset("nav footer aside form menu dialog search".split())
_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar form".split())
_NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements adsense adbox sponsor sponsored promo promotion promotions banner cookie cookies consent gdpr notice alert menu nav navbar navigation breadcrumb "
    "breadcrumbs sidebar side aside footer masthead topbar siteheader pageheader comment comments commentlist respond replies disqus share sharing social related recommended newsletter subscribe signup "
    "login popup modal overlay pagination pager widget toolbar search".split()
)
_PROSE = frozenset("p h1 h2 h3 h4 h5 h6 li dd dt td th blockquote pre caption figcaption span b i em strong a".split())
AGAINST, DOUBT, OUTSIDE, HEADER = 0.001, 0.3, 0.001, 0.01
_PUNCT = re.compile(r"[.,;:!?…。！？،؛।]")
#: Ratios beyond which a path is prose in full: characters and punctuation a block.
FULL_LENGTH, FULL_PUNCT = 1000, 10
#: Neighbouring blocks that smoothing reaches on either side, its width, and the share of the best path's value that a path needs.
REACH, SIGMA, SHARE = 2, 1.0, 0.15
#: Share of the content that the content node holds, and of the best path's value that any block in it needs.
CORE, SOME = 0.75, 0.02
#: A path whose text is links to this share is no content.
LINKS = 0.6


@dataclass
class Leaf:
    """A block of text: its path's number, its text, characters in links, the prior, whether an article holds it, and where
    the element around the block begins and ends."""

    path: int
    text: str
    linked: int
    prior: float
    inside: bool
    around: _Element


class _Element:
    __slots__ = ("tag", "path", "banned", "prior", "inside", "link", "block", "around", "start", "end", "first", "last")

    def __init__(self, tag: str, path: int, start: int, first: int, above: _Element | None):
        self.tag, self.path, self.start, self.end, self.first, self.last = tag, path, start, 1 << 62, first, 1 << 62
        self.banned, self.prior, self.inside, self.link = (above.banned, above.prior, above.inside, above.link) if above else (False, 1.0, False, False)
        own = above is None or tag in BLOCK
        self.block = self if own else above.block
        self.around = (above.block if above else self) if own else above.around

    def holds(self, other: _Element) -> bool:
        return self.start <= other.start < self.end


def _against(tag: str, rest: str, inside: bool) -> float:
    """Weight of an element by its name, role, class and id; 1 where they say nothing."""
    if tag in NOT_ARTICLE:
        return AGAINST
    weight = HEADER if tag == "header" and not inside else 1.0
    if tag in ("html", "body", "main", "article") or not rest.strip():
        return weight
    attrs = {a.lower(): b or c or d for a, b, c, d in _ATTR.findall(rest)}
    if attrs.get("role", "").lower() in _ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
        return AGAINST
    for name in f"{attrs.get('class', '')} {attrs.get('id', '')}".lower().split():
        whole = name.replace("-", "").replace("_", "")
        if name in _NAMES or whole in _NAMES:
            # a name of a paragraph of an article says little
            weight = min(weight, DOUBT if tag in _PROSE and inside else AGAINST)
        elif not _NAMES.isdisjoint(re.split("[-_]", name)):
            weight = min(weight, DOUBT if inside else AGAINST)
    return weight


def leaves(page: str, prior: bool = True) -> list[Leaf]:
    """Blocks of text in page order with their root-to-leaf tag path; unclosed and crossing elements are mended.

    A path has a number, so that any depth costs the same. Without ``prior`` the names of elements,
    classes, ids and roles say nothing.
    """
    out: list[Leaf] = []
    paths: dict[tuple[int, str], int] = {}
    stack = [_Element("", 0, 0, 0, None)]
    held: dict[str, int] = {}
    parts: list[str] = []
    linked, at, low, begun = 0, 0, None, 0
    home = stack[0]

    def put(raw: str) -> None:
        nonlocal linked, home
        top = stack[-1]
        if raw and not top.banned:
            if not parts:
                home = top
            text = html.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if top.link:
                linked += len(text.strip())

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                out.append(Leaf(home.block.path, text, linked, home.block.prior, home.block.inside, home.around))
            parts.clear()
        linked = 0

    def close(k: int) -> None:
        for e in stack[k:]:
            e.end, e.last = begun + 1, len(out)
            held[e.tag] -= 1
        del stack[k:]

    while m := _MARKUP.search(page, at):
        put(page[at : m.start()])
        at = m.end()
        if m["cdata"]:
            put(m["cdata"])
        tag = m["tag"]
        if not tag:
            continue
        tag = tag.lower()
        if m["end"]:
            if tag in BLOCK:
                flush()
            if tag == "br":
                put(" ")
            for k in range(len(stack) - 1, 0, -1) if held.get(tag) else ():
                if stack[k].tag == tag:
                    close(k)
                    break
                if stack[k].tag in _WALLS and tag not in BLOCK:
                    break
            continue
        if tag in BLOCK:
            flush()
        elif tag == "br":
            put(" ")
        shut = CLOSES.get(tag)
        if shut and any(held.get(t) for t in shut):
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in shut:
                    close(k)
                    if tag in ("p", "div", "ul", "ol", "table") or "p" in shut:
                        break
                elif stack[k].tag in _WALLS:
                    break
        if tag in VOID or m["rest"].endswith("/") and tag not in BLOCK and tag not in RAW:
            continue
        above, label, begun = stack[-1], tag, begun + 1
        if "class" in m["rest"]:
            names = next((b or c or d for a, b, c, d in _ATTR.findall(m["rest"]) if a.lower() == "class"), "")
            label = ".".join([tag, *sorted(names.split())])
        e = _Element(tag, paths.setdefault((above.path, label), len(paths) + 1), begun, len(out), above)
        e.banned |= tag in NOT_TEXT
        e.link |= tag == "a"
        if prior:
            e.prior *= _against(tag, m["rest"], above.inside)
            e.inside |= tag in ("article", "main")
        stack.append(e)
        held[tag] = held.get(tag, 0) + 1
        if tag in RAW:  # no markup in it
            low = page.lower() if low is None or len(low) != len(page) else low
            end = low.find(f"</{tag}", at)
            raw = page[at : end if end >= 0 else len(page)]
            put(raw)
            at = end if end >= 0 else len(page)
    tail = page[at:]
    put(tail if not re.match(r"<[a-zA-Z/!?]", tail) else "")
    flush()
    return out


def select(blocks: list[Leaf]) -> list[Leaf]:
    """Blocks of content by tag-path ratios.

    For each path the text length and the punctuation of its blocks are summed and divided by their
    number; the two ratios, each up to what prose has, are fused by product with the path's share of the
    page's text and of its own text that is not in links.
    The values are smoothed along the page by a Gaussian; a block takes from neighbours in the element
    around it or further out, so headings and lists take from the prose that they stand in, while
    what stands outside takes nothing from it. A path's value is that of its best block times the
    prior; paths of at least a share of the best path's value are content. The content node is the
    smallest element around the best block with most of that content: its other blocks (of some value, unless in an article)
    belong to it, what lies outside it doesn't.
    """
    if not blocks:
        return []
    sums: dict[int, list[float]] = {}
    for b in blocks:
        s = sums.setdefault(b.path, [0.0, 0.0, 0.0, 0.0])
        for k, v in enumerate((len(b.text), len(_PUNCT.findall(b.text)), b.linked, 1)):
            s[k] += v
    total = sum(len(b.text) for b in blocks)
    fused = {p: n / total * min(n / c / FULL_LENGTH, 1.0) * (1 + min(q / c, FULL_PUNCT)) / (1 + FULL_PUNCT) * (1 - link / n) * (link < LINKS * n) for p, (n, q, link, c) in sums.items()}
    raw = [fused[b.path] for b in blocks]
    kernel = [math.exp(-(d * d) / (2 * SIGMA * SIGMA)) for d in range(REACH + 1)]
    some = any(b.inside for b in blocks)
    value, best = [], {}
    for i, b in enumerate(blocks):
        near = [(kernel[abs(j - i)], raw[j]) for j in range(max(0, i - REACH), min(len(raw), i + REACH + 1)) if blocks[j].around.holds(b.around) and blocks[j].prior >= b.prior]
        smooth = sum(w * v for w, v in near) / sum(w for w, _ in near)
        value.append(smooth * b.prior * (1.0 if b.inside or not some else OUTSIDE))
        best[b.path] = max(best.get(b.path, 0.0), value[-1])
    most = max(best.values())
    chosen = [best[b.path] >= SHARE * most and fused[b.path] > 0 for b in blocks]
    mass = [0.0, *itertools.accumulate(v * len(b.text) * c for v, b, c in zip(value, blocks, chosen, strict=True))]
    held = lambda e: mass[min(e.last, len(blocks))] - mass[e.first]
    node = blocks[max(range(len(blocks)), key=lambda i: mass[i + 1] - mass[i])].around
    while node.around is not node and held(node) < CORE * mass[-1]:
        node = node.around
    lo, hi = node.first, min(node.last, len(blocks))
    if node.tag not in ("", "html", "body"):
        chosen = [c or fused[b.path] > 0 and (b.inside and b.prior == 1 or best[b.path] >= SOME * most) for c, b in zip(chosen, blocks, strict=True)]
    return [b for b, c in zip(blocks[lo:hi], chosen[lo:hi], strict=True) if c]


def main_text(page: str, prior: bool = True) -> str:
    return "\n".join(b.text for b in select(leaves(page, prior)))


def _extracting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(t.as_py() or "") for t in batch.column("html")]
        cols = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per input row: page_id, url, text, n_chars (code points).

    A null or empty page has an empty text; null ids and urls are carried, repeated rows give equal
    rows, other columns are ignored. Nothing is cut off: a page of any length is taken whole.
    """
    small_batches(pages.sparkSession)
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return src.mapInArrow(lean(_extracting), "page_id long, url string, text string, n_chars long")
