"""The block tree of an HTML page, with the figures a classifier needs of each block.

Inline elements belong to the block around them. Character references are decoded,
white space inside a block becomes one space, comments, scripts, styles and other
unseen text are left out. Unclosed and misnested tags are repaired the way browsers
do where it matters for blocks: a block start ends an open paragraph, an item ends an
item, an end tag without its start is ignored. The text of buttons, lists of choices,
drawings and templates goes up to their end tag, as does the inside of scripts, styles,
titles, text areas and frames; without one, up to the next block start or the
end of an element around them. Inside drawings and formulas "/>" ends an element. A tag
with a quote that is never closed ends at its first ">". Time is linear in the length of a
page, whatever is open in it.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: The end of a tag, or the begin of a quoted value, which may hold a ">".
_STOP = re.compile(r">|=\s*[\"']")
_COMMENT_END = re.compile(r"--!?>")
_ATTRIBUTE = re.compile(r"(?<![\w-])([\w-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))")
_SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
#: HTML's elements without content, and its block-level elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
_HOLDS = {"li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr"}, "th": {"tr"}}
#: Elements with markup inside whose text isn't read. Those without an end tag are open as "?tag".
HIDDEN = frozenset("noscript template svg select button".split())
#: Elements whose inside is text up to their end tag. Without one, they are open as "?tag" too.
RAW = frozenset("script style textarea title iframe".split())
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])", re.I) for t in RAW}
_LOOSE = {f"?{t}" for t in HIDDEN | RAW}
_UNSEEN = HIDDEN | _LOOSE
_ALONE = frozenset(("select", "button"))
#: Drawings and formulas, in which "/>" ends an element.
_FOREIGN = frozenset(("svg", "math"))
#: Groups of tags as one feature.
GROUPS = ("article main", "nav menu", "header", "footer", "aside", "ul ol dl", "li dd dt", "p pre blockquote", "h1 h2 h3 h4 h5 h6 hgroup", "form fieldset", "section", "div center", "table tbody thead tr td th", "body html", "figure figcaption")
_GROUP = {t: k for k, g in enumerate(GROUPS) for t in g.split()}
#: Tokens of class, id and role that pages use for parts beside the article, and for it.
ASIDE = frozenset(
    "ad ads advert advertisement adverts sponsor sponsored promo banner nav navbar navigation menu breadcrumb breadcrumbs sidebar side rail widget header masthead topbar footer bottom foot copyright legal cookie consent notice alert gdpr popup modal overlay comment comments reply replies discussion disqus respond reader share sharing social follow subscribe newsletter signup login form search related recommended more tags pagination pager toolbar skip contentinfo complementary".split()
)
MAIN = frozenset("article content post entry story body main text page blog hentry prose".split())


@dataclass
class Block:
    tag: str
    parent: int
    depth: int
    tokens: tuple[str, ...] = ()
    mark: str = ""
    children: list[int] = field(default_factory=list)
    #: (place in page order, text) of the text directly in this block.
    runs: list[tuple[int, str]] = field(default_factory=list)
    link_chars: int = 0
    inline: int = 0


@dataclass(slots=True)
class Token:
    """A tag, or a comment and the like (name ""), and where it stands; ``head`` is where its attributes begin."""

    start: int
    end: int
    name: str = ""
    is_end: bool = False
    head: int = 0


def tokens(page: str) -> list[Token]:
    """The tags of a page. What is between elements of ``RAW`` and their end tags is part of the token.

    Every search goes on where the last one ended, or has failed once and for all, so the
    time is linear in the length of the page.
    """
    out: list[Token] = []
    n, at = len(page), page.find("<")
    #: What isn't to be found from here on: quotes without a second one, end tags.
    gone: set[str] = set()
    foreign = 0

    def find(what: str, begin: int, pattern: re.Pattern | None = None) -> int:
        if what in gone:
            return -1
        found = (m.start() if (m := pattern.search(page, begin)) else -1) if pattern else page.find(what, begin)
        if found < 0:
            gone.add(what)
        return found

    def closing(begin: int) -> int:
        """Where the tag ends. A quote that is never closed is no quote: the tag ends at its first ">"."""
        pos = begin
        while m := _STOP.search(page, pos):
            if m[0] == ">":
                return m.end()
            quote = find(m[0][-1], m.end())
            if quote < 0:
                end = page.find(">", m.end())
                return end + 1 if end >= 0 else n
            pos = quote + 1
        return n

    while 0 <= at < n - 1:
        after = page[at + 1]
        is_end = after == "/"
        m = _NAME.match(page, at + 1 + is_end)
        if m:
            name, end = m[0].lower(), closing(m.end())
            alone = not is_end and foreign > 0 and page.endswith("/>", m.end(), end)
            alone = alone or name == "svg" and not is_end and page.endswith("/>", m.end(), end)
            if name in _FOREIGN and not alone:
                foreign = max(0, foreign + (-1 if is_end else 1))
            if name in RAW and not is_end and not alone:
                raw = find(f"</{name}", end, _RAW_END[name])
                if raw >= 0:
                    name, end = "", closing(raw + 2)
            out.append(Token(at, end, "" if alone else name, is_end, m.end()))
        elif after == "!" and page.startswith("--", at + 2):
            # "<!-->" and "<!--->" are whole comments.
            m = _COMMENT_END.search(page, at + 2)
            end = m.end() if m else n
            out.append(Token(at, end))
        elif after in "!?/":
            end = page.find(">", at)
            end = end + 1 if end >= 0 else n
            out.append(Token(at, end))
        else:
            end = at + 1
        at = page.find("<", end)
    return out


class Open:
    """The open elements, and for each name the places where it is open."""

    def __init__(self) -> None:
        self.stack: list[tuple[int, str, bool]] = []
        self.places: dict[str, list[int]] = {}

    def push(self, block: int, tag: str, seen: bool) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((block, tag, seen))

    def pop(self) -> tuple[int, str, bool]:
        self.places[self.stack[-1][1]].pop()
        return self.stack.pop()

    def last(self, tags: Iterable[str]) -> int:
        """The place of the innermost element of these names; -1 without one."""
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=-1)


def _ended(page_tokens: list[Token]) -> set[int]:
    """Where the hidden elements start that have an end tag of their own."""
    out: set[int] = set()
    if not any(t.name in HIDDEN for t in page_tokens):
        return out
    open_ = Open()
    for t in page_tokens:
        if not t.name or t.name in VOID:
            continue
        k = open_.last((t.name,)) if t.is_end or t.name in _ALONE else -1
        if k >= 0:
            if t.is_end and t.name in HIDDEN:
                out.add(open_.stack[k][0])
            while len(open_.stack) > k:
                open_.pop()
        if not t.is_end:
            open_.push(t.start, t.name, False)
    return out


def blocks(page: str) -> list[Block]:
    """The blocks of a page in page order; the first is the page itself."""
    out = [Block("html", -1, 0)]
    open_ = Open()
    open_.push(0, "html", True)
    now, links, run, order, hidden = 0, 0, [], 0, 0
    found = tokens(page)
    ended = _ended(found)

    def flush() -> None:
        nonlocal run, order
        text = " ".join(html.unescape("".join(run)).split()) if run else ""
        if text:
            out[now].runs.append((order, text))
            order += 1
        run = []

    def close(to: int) -> None:
        """Close open elements from place ``to`` on."""
        nonlocal now, links, hidden
        gone = [open_.pop() for _ in range(len(open_.stack) - to)]
        if any(seen and t in BLOCK for _, t, seen in gone):
            flush()
        links -= sum(seen and t == "a" for _, t, seen in gone)
        hidden -= sum(t in _UNSEEN for _, t, _ in gone)
        now = open_.stack[-1][0]

    def inner(tags: Iterable[str], stop: Iterable[str] = ()) -> int:
        """The place of the innermost of ``tags``, if none of ``stop`` is inside it; else 0."""
        k = open_.last(tags)
        return k if k > 0 and k > open_.last(stop) else 0

    at = 0
    for token in found:
        if token.start > at and not hidden:
            text = page[at : token.start]
            run.append(text)
            if links:
                out[now].link_chars += len(text)
        at, tag = token.end, token.name
        if not tag:
            continue
        if tag == "br":
            run.append(" ")
            continue
        if token.is_end:
            if k := inner((tag,)):
                close(k)
            continue
        if hidden and (tag in BLOCK or tag in _ALONE) and (k := inner(_LOOSE if tag in BLOCK else (tag, f"?{tag}"))):
            close(k)
        if tag in HIDDEN or tag in RAW:
            open_.push(now, tag if token.start in ended else f"?{tag}", False)
            hidden += 1
            continue
        if hidden:
            if tag not in VOID:
                open_.push(now, tag, False)
            continue
        if tag not in BLOCK:
            out[now].inline += 1
            if tag not in VOID:
                open_.push(now, tag, True)
                links += tag == "a"
            continue
        if tag in ("html", "body", "head") and open_.last((tag,)) >= 0:
            continue
        if k := inner(("p",), ("td", "th", "button")):
            close(k)
        if tag in _CLOSES and (k := inner(_CLOSES[tag], _HOLDS[tag])):
            close(k)
        flush()
        head = page[token.head : token.end]
        attributes = {a[1].lower(): a[2] or a[3] or a[4] or "" for a in _ATTRIBUTE.finditer(head)} if "=" in head else {}
        words = tuple(t for name in ("class", "id", "role") for t in _SPLIT.split(attributes.get(name, "").lower()) if t)
        out.append(Block(tag, now, out[now].depth + 1, words, attributes.get("data-part", "")))
        out[now].children.append(len(out) - 1)
        if tag not in VOID:
            now = len(out) - 1
            open_.push(now, tag, True)
    if at < len(page) and not hidden:
        run.append(page[at:])
    flush()
    return out


FEATURES = (
    ["depth", "place", "siblings", "share", "chars", "own", "links", "per_block", "paragraphs", "stops", "inline", "aside", "main", "aside_above", "main_above", "kin_chars", "kin_links", "kin_alike", "n_tokens"]
    + [f"tag_{k}" for k in range(len(GROUPS))]
    + [f"above_{k}" for k in range(len(GROUPS))]
    + [f"within_{k}" for k in range(6)]
)


def features(tree: list[Block]) -> list[list[float]]:
    """A row of ``FEATURES`` for each block."""
    n = len(tree)
    own = [sum(len(t) for _, t in b.runs) for b in tree]
    chars, links, below, paragraphs, stops = own[:], [float(b.link_chars) for b in tree], [1] * n, [0] * n, [0] * n
    for k in range(n - 1, -1, -1):
        b = tree[k]
        paragraphs[k] += b.tag == "p"
        stops[k] += sum(t.count(". ") + t.count(",") + t.endswith(".") for _, t in b.runs)
        if b.parent >= 0:
            for total in (chars, links, below, paragraphs, stops):
                total[b.parent] += total[k]
    # Of the children of each block: their places, tags, text and link text.
    place, alike, kin_text, kin_link = [0] * n, [Counter() for _ in tree], [0] * n, [0.0] * n
    for k, b in enumerate(tree):
        for j, c in enumerate(b.children):
            place[c] = j
        alike[k].update(tree[c].tag for c in b.children)
        kin_text[k], kin_link[k] = sum(chars[c] for c in b.children), sum(links[c] for c in b.children)
    rows, above = [], [(0, 0)] * n
    within = [[0.0] * 6 for _ in range(n)]
    every = max(1, chars[0])
    for k, b in enumerate(tree):
        bad, good = sum(t in ASIDE for t in b.tokens), sum(t in MAIN for t in b.tokens)
        parent, root = b.parent, b.parent < 0
        n_kin = 1 if root else len(tree[parent].children)
        if b.parent >= 0:
            above[k] = (above[b.parent][0] + sum(t in ASIDE for t in tree[b.parent].tokens), above[b.parent][1] + sum(t in MAIN for t in tree[b.parent].tokens))
            within[k] = within[b.parent][:]
        group = _GROUP.get(b.tag, -1)
        if 0 <= group <= 4:
            within[k][group] = 1.0
        if group == 9:
            within[k][5] = 1.0
        tags, up = [0.0] * len(GROUPS), [0.0] * len(GROUPS)
        if group >= 0:
            tags[group] = 1.0
        if b.parent >= 0 and (g := _GROUP.get(tree[b.parent].tag, -1)) >= 0:
            up[g] = 1.0
        kin_chars = chars[k] if root else kin_text[parent]
        kin_links = links[k] if root else kin_link[parent]
        same_tag = 1 if root else alike[parent][b.tag]
        rows.append(
            [b.depth, place[k] / n_kin, n_kin, chars[k] / every, chars[k], own[k], links[k] / max(1, chars[k]), chars[k] / below[k], paragraphs[k], stops[k] / max(1, chars[k]), b.inline, bad, good, *above[k]]
            + [kin_chars / n_kin, kin_links / max(1, kin_chars), same_tag / n_kin, len(b.tokens)]
            + tags
            + up
            + within[k]
        )
    return rows
