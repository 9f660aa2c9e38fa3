"""Main text of web pages by tree scoring.

A page becomes a tree of elements and a list of blocks (runs of text between block-level borders).  Each block gives
points for its length and its commas, less the share of its text that lies in links; its container gets them whole, the
container's parent half, and each further ancestor half of what the one below got.  An article or main element counts
its points twice, no more: the container with the most points, discounted by the links in it, is the best, whatever it
is called.  A first-level heading adds to its container.  The best one's siblings are kept if they score enough or are
plain paragraphs or headings.

No part of the text are elements that are none by their kind (navigation, footers, asides, forms, dialogs, scripts,
styles, headers outside an article; a header inside one is its title and stays), hidden ones, and what names itself an
advert, a notice, a menu, comments and the like.  A name counts as a whole class, or as a word of one (unless that says
has, no or with); an element so named stays if it holds most of the page's points, and for a whole class or a name that
says comments an article or main element besides.

Everything is done in a few passes over elements and blocks, so time is in line with the page, however deep it is.

Cases: null or empty html: empty text; a page without containers for its text: its body; unclosed, stray or cut-off
tags are read as browsers do (a new paragraph ends the one before, an unfinished tag at the end is dropped); the first
element wins a tie of points; repeated rows are read again; an empty table gives an empty result; other columns pass
through, and result columns replace input columns of the same name.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: HTML's void elements, block-level elements, and elements that are no text or no part of an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split()
)
LEAF = frozenset("p li td th dt dd pre blockquote h1 h2 h3 h4 h5 h6 caption figcaption summary address".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
GONE = frozenset("nav footer aside form dialog menu head title button select option canvas object audio video svg math map fieldset datalist".split())
#: An opening tag ends these, up to the given border.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
BORDER = frozenset("article aside blockquote body caption dd details div dl dt figure footer form header html li main nav ol section table td th tr ul".split())
#: Words in class, id or role that mark what isn't the article.
_NOT_TEXT = re.compile(
    r"(?:ads?|advert\w*|adsense|banner\w*|sponsor\w*|promo\w*|sidebar\w*|menu\w*|nav|navbar|navigation|breadcrumbs?|footer|masthead|comments?|commentlist|disqus|replies|"
    r"respond|responses|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|newsletter|subscribe|subscription|signup|login|social|shar(?:e|ing)|related|recommend\w*|widgets?|"
    r"toolbar|pagination|pager|copyright|complementary|contentinfo|search|alertdialog|dialog)",
    re.I,
)
_READERS = frozenset("comment comments commentlist disqus replies respond responses".split())
_COMMENT = re.compile(r"(?:^|\s)comment(?!s?-(?:status|open|closed|enabled|disabled))", re.I)
_HEADER = re.compile(r"(?:header|topbar)", re.I)
#: Words that say what the page has or lacks, not what the element is.
_ABOUT = frozenset("has no with without".split())
_WORDS = re.compile(r"[-_]+")
_ATTR = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_ATTRS = r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+"""
_TOKEN = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|textarea|iframe|title|svg|math)\b(?:{_ATTRS})>.*?(?:</\1\b[^>]*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRS}|[^>]*)>|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.S | re.I,
)
_SPACE = re.compile(r"\s+")


#: What article and main elements count their points times, and the points of a first-level heading.
BONUS, TITLE = 2.0, 3.0


@dataclass
class Page:
    """Elements by number, each after its parent, and blocks in page order."""

    tag: list[str]
    up: list[int]
    #: Whether an element is no text by its kind or its attributes.
    gone: list[bool]
    #: 1: a word of a class says that it isn't the article, 2: a whole class, 3: a word that says comments.
    named: list[int]
    #: (innermost block-level element, [(element, text, whether in a link)])
    blocks: list[tuple[int, list[tuple[int, str, bool]]]]


def _is_gone(tag: str, attrs: dict[str, str]) -> bool:
    """Whether the attributes hide an element, or it is a comment."""
    if tag in ("html", "body", "article", "main"):
        return tag in ("article", "main") and bool(_COMMENT.search(" ".join(attrs.get(k, "") for k in ("class", "id", "role"))))
    hidden = "hidden" in attrs and attrs["hidden"].lower() != "false"
    return hidden or attrs.get("aria-hidden", "").lower() == "true" or bool(_UNSEEN.search(attrs.get("style", "")))


def _named(tag: str, attrs: dict[str, str], in_article: bool) -> int:
    """Whether a class, id or role says that this isn't the article (see Page.named)."""
    if tag in ("html", "body", "article", "main"):
        return 0
    found = 0
    for token in " ".join(attrs.get(k, "") for k in ("class", "id", "role")).split():
        if _NOT_TEXT.fullmatch(token) or not in_article and _HEADER.fullmatch(token):
            return 2
        words = _WORDS.split(token.lower())
        if not _ABOUT.intersection(words) and any(_NOT_TEXT.fullmatch(w) or not in_article and _HEADER.fullmatch(w) for w in words):
            found = max(found, 3 if _READERS.intersection(words) else 1)
    return found


def _attributes(raw: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTR.findall(raw):
        out.setdefault(name.lower(), a or b or c)
    return out


class _Open:
    """The open elements, with the places of each tag, of borders and of block-level elements, so that nothing is searched for."""

    def __init__(self) -> None:
        self.stack = [0]
        self.by_tag: dict[str, list[int]] = {}
        self.border: list[int] = []
        self.block: list[int] = [0]
        self.tags: list[str] = ["html"]

    def push(self, node: int, tag: str) -> None:
        at = len(self.stack)
        self.stack.append(node)
        self.tags.append(tag)
        self.by_tag.setdefault(tag, []).append(at)
        if tag in BORDER:
            self.border.append(at)
        if tag in BLOCK:
            self.block.append(at)

    def top(self, tags) -> int:
        """The place of the innermost element with one of the tags, 0 if there is none."""
        return max((self.by_tag[t][-1] for t in tags if self.by_tag.get(t)), default=0)

    def close(self, at: int) -> None:
        while len(self.stack) > at:
            self.stack.pop()
            tag = self.tags.pop()
            self.by_tag[tag].pop()
            if tag in BORDER:
                self.border.pop()
            if tag in BLOCK:
                self.block.pop()


def parse(page: str) -> Page:
    """The tree as browsers would build it, near enough."""
    out, opened = Page(["html"], [-1], [False], [0], [(0, [])]), _Open()

    def text(s: str) -> None:
        if s:
            s = html.unescape(s) if "&" in s else s
            out.blocks[-1][1].append((opened.stack[-1], s, bool(opened.by_tag.get("a"))))

    def border() -> None:
        at = opened.stack[opened.block[-1]]
        if out.blocks[-1][1]:
            out.blocks.append((at, []))
        else:
            out.blocks[-1] = (at, [])

    last = 0
    for m in _TOKEN.finditer(page):
        text(page[last : m.start()])
        last = m.end()
        tag = m[3].lower() if m[3] else ""
        if not tag:
            continue
        if m[2]:
            at = opened.top((tag,))
            if at and (tag in BLOCK or not opened.border or opened.border[-1] <= at):
                opened.close(at)
            if tag in BLOCK:
                border()
            continue
        if tag in BLOCK:
            at = opened.top(("p", *HEADING) if tag in HEADING else ("p",))
            if at and (not opened.border or opened.border[-1] < at):
                opened.close(at)
        if tag in ENDS:
            own, stop = ENDS[tag]
            at = opened.top(own)
            if at > opened.top(stop):
                opened.close(at)
        if tag == "br" or tag == "wbr":
            text(" " if tag == "br" else "")
            continue
        if tag in VOID:
            if tag in BLOCK:
                border()
            continue
        if tag in ("html", "body"):
            continue
        attrs = _attributes(m[4]) if m[4] else {}
        in_article = bool(opened.by_tag.get("article") or opened.by_tag.get("main"))
        out.tag.append(tag)
        out.up.append(opened.stack[-1])
        out.gone.append(tag in GONE or (tag == "header" and not in_article) or _is_gone(tag, attrs))
        out.named.append(_named(tag, attrs, in_article) if attrs else 0)
        if not m[4].endswith("/") or tag in BLOCK or tag == "a":
            opened.push(len(out.tag) - 1, tag)
        if tag in BLOCK:
            border()
    text(page[last:])
    return out


def _inherit(page: Page, marked: list[bool]) -> list[bool]:
    """Marks passed on to all elements within."""
    out = list(marked)
    for i in range(1, len(out)):
        out[i] = out[i] or out[page.up[i]]
    return out


def _gather(page: Page, x: list, share: float = 1) -> list:
    """Each element's own figure and `share` of its children's, children first."""
    out = list(x)
    for i in range(len(out) - 1, 0, -1):
        if out[i]:
            out[page.up[i]] += out[i] * share
    return out


def _texts(page: Page, gone: list[bool]) -> list[tuple[int, str, int]]:
    """(element, text, characters in links) of the blocks that have text outside what is gone."""
    out = []
    for node, parts in page.blocks:
        if all(gone[i] for i, _, _ in parts):
            continue
        s = _SPACE.sub(" ", "".join(s for i, s, _ in parts if not gone[i])).strip()
        if s:
            linked = sum(len(_SPACE.sub(" ", s).strip()) for i, s, link in parts if link and not gone[i])
            out.append((node, s, min(linked, len(s))))
    return out


def _points(text: str, linked: int) -> float:
    return (1 + text.count(",") + text.count("，") + min(len(text) / 100, 3.0)) * (1 - linked / len(text))


def _without_names(page: Page, gone: list[bool], blocks: list[tuple[int, str, int]]) -> list[bool]:
    """gone, and with it the elements whose names say so."""
    named = [i for i, n in enumerate(page.named) if n and not gone[i]]
    if not named:
        return gone
    own, holds = [0.0] * len(gone), [t in ("article", "main") and not g for t, g in zip(page.tag, gone, strict=True)]
    for node, text, linked in blocks:
        own[node] += _points(text, linked)
    points, holds = _gather(page, own), _gather(page, holds)
    drop = list(gone)
    for i in named:
        drop[i] = points[i] <= 0.5 * points[0] or (page.named[i] >= 2 and not holds[i] and (page.named[i] == 2 or points[i] < 0.95 * points[0]))
    return _inherit(page, drop)


def extract(page: str | None, blacklist: bool = True) -> str:
    """The main text: blocks in page order, one on a line.  Without the blacklist only scores decide."""
    if not page:
        return ""
    tree = parse(page)
    gone = _inherit(tree, tree.gone) if blacklist else [t in ("head", "title") for t in tree.tag]
    blocks = _texts(tree, gone)
    if blacklist:
        less = _without_names(tree, gone, blocks)
        blocks = blocks if less is gone else _texts(tree, less)
    kept = _inherit(tree, _best(tree, blocks))
    return "\n".join(text for node, text, _ in blocks if kept[node])


def _best(page: Page, blocks: list[tuple[int, str, int]]) -> list[bool]:
    """Marks the best container and the siblings that go with it."""
    n = len(page.tag)
    own, chars, links = [0.0] * n, [0] * n, [0] * n
    for node, text, linked in blocks:
        title = TITLE if page.tag[node] == "h1" and not linked else 0.0
        own[max(page.up[node], 0) if page.tag[node] in LEAF else node] += _points(text, linked) + title
        chars[node] += len(text)
        links[node] += linked
    points, chars, links = _gather(page, own, 0.5), _gather(page, chars), _gather(page, links)
    worth = [p * (1 - x / c) * (BONUS if t in ("article", "main") else 1) if c else 0.0 for p, c, x, t in zip(points, chars, links, page.tag, strict=True)]
    kept = [False] * n
    best = max(range(n), key=lambda i: (worth[i], -i))
    if worth[best] <= 0:
        return kept
    kept[best] = True
    for i in range(1, n):
        if best and page.up[i] == page.up[best] and chars[i] and links[i] <= 0.25 * chars[i]:
            kept[i] = kept[i] or page.tag[i] in HEADING or page.tag[i] == "p" or worth[i] >= max(10.0, 0.2 * worth[best])
    return kept


def extract_pages(pages: DataFrame, source: str = "html") -> DataFrame:
    """pages without html, with text and n_chars (code points)."""
    keep = [c for c in pages.columns if c.lower() not in (source.lower(), "text", "n_chars")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [extract(x) for x in b.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keep))), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*keep, "text", "n_chars"])

    schema = pages.select(*keep).schema.add("text", "string").add("n_chars", "long")
    return pages.select(*keep, F.col(source).cast("string")).mapInArrow(run, schema)
