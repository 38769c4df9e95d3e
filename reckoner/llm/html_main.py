"""Main text of web pages by boosted trees over the block tree.

Gradient-boosted trees (Spark ML) tell content blocks from others by tag, attribute
tokens, depth, text and link density of the subtree and figures of the siblings. The
decision for a page is then hierarchical: each block is taken whole, left whole, or
decided child by child, whichever gives the largest sum of log-odds, weighted by
text; so no block is kept inside one that was left, and a short paragraph goes the
way of its article.

Learning: no page is labelled. At most ``sample_pages`` pages of at most
``SAMPLE_BYTES``, those with the smallest id hashes, are read to the driver. Their
<article> (or <main>) is content, but for the menus, asides, footers, forms, comments
and adverts in it; the rest is not. Each is also set anew into several invented layouts, with menus, notices,
adverts, forms, sidebars and reader comments made of other pages' text, so that
neither tags nor text alone decide.

Defined results: null and empty pages give empty texts, as do pages without content;
equal pages give equal texts; extra columns stay as ``keep`` says; without a page to
learn from, a block is content if it is inside <article> or <main>; no pages give no
rows.
"""

from __future__ import annotations

import random
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reckoner.llm.common import with_results
from reckoner.llm.dom import FEATURES, Block, blocks, features

SAMPLE_PAGES, SAMPLE_BYTES = 120, 1 << 18
LAYOUTS = 3
ROUNDS, DEPTH = 12, 4
MIXED = 1.0
#: What isn't content inside an article of the sampled pages either.
_APART = frozenset("nav aside footer form".split())
_APART_TOKENS = frozenset("comment comments reply replies respond disqus discussion sidebar ad ads advert advertisement sponsored nav navbar menu breadcrumb breadcrumbs cookie consent share sharing social newsletter subscribe related recommended".split())
_ARTICLE = re.compile(r"<(article|main)\b[^>]*>(.*?)(?:</\1\s*>|\Z)", re.S | re.I)


@dataclass
class Trees:
    """Trees as arrays: a node's feature (-1: leaf), threshold, children and value."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: list[int]
    weights: list[float]

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        total, row = np.zeros(len(x)), np.arange(len(x))
        for root, weight in zip(self.roots, self.weights, strict=True):
            at = np.full(len(x), root)
            while (inner := self.feature[at] >= 0).any():
                step = np.where(x[row, np.maximum(self.feature[at], 0)] <= self.threshold[at], self.left[at], self.right[at])
                at = np.where(inner, step, at)
            total += weight * self.value[at]
        # Spark ML's boosted trees fit half the log-odds.
        return 2 * total


def _arrays(model: GBTClassificationModel) -> Trees:
    nodes: list[tuple] = []

    def walk(node) -> int:
        place = len(nodes)
        nodes.append(())
        if node.numDescendants() == 0:
            nodes[place] = (-1, 0.0, 0, 0, node.prediction())
        else:
            split = node.split()
            nodes[place] = (split.featureIndex(), split.threshold(), walk(node.leftChild()), walk(node.rightChild()), 0.0)
        return place

    roots = [walk(t._call_java("rootNode")) for t in model.trees]
    f, t, a, b, v = zip(*nodes, strict=True)
    return Trees(np.array(f), np.array(t), np.array(a), np.array(b), np.array(v, float), roots, list(model.treeWeights))


def _piece(rng: random.Random, texts: list[str], n: int) -> str:
    words = rng.choice(texts).split()
    at = rng.randrange(max(1, len(words) - n))
    return " ".join(words[at : at + n])


def layout(inner: str, texts: list[str], rng: random.Random) -> str:
    """A page around an article's inner HTML, parts marked as content (c) or not (b)."""
    say = lambda a, b: _piece(rng, texts, rng.randint(a, b))
    name = lambda *x: rng.choice([f'class="{rng.choice(x)}"', f'id="{rng.choice(x)}"'])
    links = lambda n: "".join(f'<li><a href="/{k}">{say(1, 4)}</a></li>' for k in range(n))
    off = 'data-part="b"'
    head = [
        f"<nav {off}><ul>{links(rng.randint(3, 9))}</ul></nav>",
        f"<div {off} {name('menu', 'main-nav', 'navbar', 'top-menu')}><ul>{links(rng.randint(3, 9))}</ul></div>",
        f"<header {off} {name('site-header', 'masthead', 'header')}><h2>{say(2, 5)}</h2><p>{say(3, 12)}</p></header>",
        f"<div {off} {name('cookie-notice', 'consent', 'notice', 'alert')}><p>{say(8, 40)}</p></div>",
        f"<div {off} {name('ad', 'advert', 'ad-slot', 'banner', 'sponsored')}>{say(4, 30)}</div>",
        f"<form {off} {name('search', 'login', 'newsletter')}><label>{say(1, 4)}</label><input><p>{say(2, 10)}</p></form>",
    ]
    comments = "".join(f'<{rng.choice(["div", "li", "article"])} class="comment"><p>{say(5, 80)}</p></div>' for _ in range(rng.randint(1, 5)))
    foot = [
        f"<section {off} {name('comments', 'comment-list', 'discussion', 'replies')}><h3>{say(1, 4)}</h3>{comments}</section>",
        f"<div {off} {name('comments', 'reader-comments', 'respond')}>{comments}</div>",
        f"<aside {off} {name('sidebar', 'related', 'widget')}><h3>{say(1, 4)}</h3><p>{say(5, 60)}</p><ul>{links(4)}</ul></aside>",
        f"<div {off} {name('sidebar', 'side-rail', 'recommended', 'related-posts')}><p>{say(5, 60)}</p></div>",
        f"<div {off} {name('share', 'social', 'subscribe')}><a>{say(1, 3)}</a> <a>{say(1, 3)}</a></div>",
        f"<footer {off}><p>{say(3, 20)}</p></footer>",
        f"<div {off} {name('footer', 'copyright', 'legal')}>{say(3, 20)}</div>",
    ]
    opening, closing = rng.choice(
        [("<article data-part=\"c\">", "</article>"), ("<main><article data-part=\"c\">", "</article></main>"), ('<main data-part="c">', "</main>")]
        + [(f'<div data-part="c" {name("content", "post", "entry-content", "article-body", "story", "main-text")}>', "</div>"), (f'<section data-part="c" {name("content", "post-body", "story")}>', "</section>")]
    )
    rng.shuffle(head)
    rng.shuffle(foot)
    top, end = head[: rng.randint(1, 4)], foot[: rng.randint(1, 4)]
    middle = opening + inner
    if rng.random() < 0.3:
        middle += rng.choice(head[3:] + foot[:1])
    middle += closing
    if rng.random() < 0.4:
        middle = f'<div class="{rng.choice(["wrap", "container", "page", "layout"])}">{middle}{end.pop() if end else ""}</div>'
    return f"<html><body>{''.join(top)}{middle}{''.join(end)}</body></html>"


def _labelled(tree: list[Block]) -> list[int]:
    """1 for blocks of content, 0 for others, -1 for those around both."""
    part = []
    for b in tree:
        apart = b.tag in _APART or not _APART_TOKENS.isdisjoint(b.tokens)
        own = b.mark or ("b" if apart else "c" if b.tag in ("article", "main") else "")
        above = part[b.parent] if b.parent >= 0 else ""
        part.append("b" if above == "b" else own or above)
    around = {b.parent for b, p in zip(tree, part, strict=True) if p == "c"}
    return [1 if p == "c" else -1 if k in around else 0 for k, p in enumerate(part)]


def training_rows(pages: list[str], seed: int = 1) -> tuple[list[list[float]], list[int]]:
    """Features and labels of the blocks of pages and of their new layouts."""
    rng, x, y = random.Random(seed), [], []
    found = [(p, m[2]) for p in pages if (m := _ARTICLE.search(p))]
    texts = [" ".join(re.sub(r"<[^>]*>", " ", inner).split()) or "text" for _, inner in found]
    for page, inner in found:
        for source in [page, *(layout(inner, texts, rng) for _ in range(LAYOUTS))]:
            tree = blocks(source)
            for row, label, b in zip(features(tree), _labelled(tree), tree, strict=True):
                if label >= 0 and b.depth > 0:
                    x.append(row)
                    y.append(label)
    return x, y


def learn(pages: DataFrame, sample_pages: int = SAMPLE_PAGES) -> Trees | None:
    """Boosted trees from a bounded sample of pages; None without one that has an article."""
    some = pages.where(F.col("html").isNotNull() & F.col("page_id").isNotNull() & (F.octet_length("html") <= SAMPLE_BYTES)).select("page_id", "html")
    rows = some.orderBy(F.xxhash64("page_id"), "page_id").limit(sample_pages).collect()
    x, y = training_rows([r["html"] for r in sorted(rows, key=lambda r: zlib.crc32(r["html"].encode()))])
    if len(set(y)) < 2:
        return None
    rows = pa.table({"x": pa.array(x, pa.list_(pa.float64())), "label": pa.array(y, pa.float64())})
    data = pages.sparkSession.createDataFrame(rows).coalesce(2).select(array_to_vector("x").alias("features"), "label").persist()
    model = GBTClassifier(maxIter=ROUNDS, maxDepth=DEPTH, stepSize=0.3, seed=7, cacheNodeIds=False).fit(data)
    data.unpersist()
    return _arrays(model)


def chosen(tree: list[Block], odds: np.ndarray) -> list[bool]:
    """For each block, whether its own text is kept.

    keep and drop are the scores of a whole subtree; the best of them, or of its
    parts less ``MIXED``, is taken.
    """
    n = len(tree)
    weight = [np.log1p(sum(len(t) for _, t in b.runs)) for b in tree]
    keep, parts, pick = [0.0] * n, [0.0] * n, [0] * n
    for k in range(n - 1, -1, -1):
        own = odds[k] * weight[k]
        keep[k] += own + odds[k]
        split = parts[k] + abs(own) - MIXED
        score = max(keep[k], -keep[k], split)
        pick[k] = 1 if score == keep[k] else -1 if score == -keep[k] else 0
        up = tree[k].parent
        if up >= 0:
            keep[up] += keep[k]
            parts[up] += score
    out = [False] * n
    for k, b in enumerate(tree):
        if b.parent >= 0 and pick[b.parent] and k:
            pick[k] = pick[b.parent]
        out[k] = pick[k] > 0 or (pick[k] == 0 and odds[k] > 0)
    return out


def text_of(tree: list[Block], kept: list[bool]) -> str:
    runs = sorted(r for b, k in zip(tree, kept, strict=True) if k for r in b.runs)
    return " ".join(t for _, t in runs)


def extract(pages: DataFrame, trees: Trees | None, keep: list[str] | None = None) -> DataFrame:
    """``pages`` with ``text``, the main text, and ``n_chars``."""
    shared = pages.sparkSession.sparkContext.broadcast(trees)

    def work():
        model = shared.value

        def compute(column: pa.Array) -> dict[str, object]:
            texts = []
            for a in range(0, len(column), 256):
                made = [blocks(p or "") for p in column.slice(a, 256).to_pylist()]
                if model is None:
                    odds = [np.array([float(x) or -1.0 for x in _labelled(t)]) for t in made]
                else:
                    x = np.array([row for t in made for row in features(t)], float).reshape(-1, len(FEATURES))
                    odds = np.split(model.log_odds(x), np.cumsum([len(t) for t in made])[:-1])
                texts += [text_of(t, chosen(t, o)) for t, o in zip(made, odds, strict=True)]
            return {"text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}

        return compute

    return with_results(pages, work, "text string, n_chars long", text="html", keep=keep)
