"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The roles HTML gives its elements.
HIDDEN = frozenset("script style noscript template svg math iframe object canvas textarea select option head title audio video".split())
RAW = frozenset("script style noscript template iframe textarea title svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
BOILERPLATE = frozenset("nav footer aside form dialog menu button fieldset".split())
CLOSES_P = frozenset(
    "address article aside blockquote dd details dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr li main menu nav ol p pre section table ul".split()
)
#: Headings and paragraphs: their id is an anchor and says nothing about their role.
PROSE = frozenset("h1 h2 h3 h4 h5 h6 p pre blockquote".split())
#: Words in class, id and role values that name furniture of a page.
FURNITURE = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent "
    "cookie cookies copyright disqus footer form login masthead menu modal nav navbar navigation newsletter notice notices "
    "overlay pager pagination popup promo promoted promotion recommendations recommended related replies reply respond "
    "alert gdpr search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar widget "
    "complementary contentinfo".split()
)
#: Of these, the words that name a part of an article as well; inside one they drop only what is mostly links.
EITHER = frozenset(
    "overlay recommendations recommended related replies reply respond search share sharing skip social teaser toolbar widget".split()
)
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？؟،]")
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<close>/)?(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>|<(?P<close2>/)?(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>",
    re.S,
)
ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Node:
    tag: str
    parent: int
    path: str
    dropped: bool
    article: bool
    named: bool = False
    doubtful: bool = False
    main: bool = False


@dataclass
class Block:
    """Running text between two block boundaries, and the element that holds it."""

    node: int
    text: str
    linked: int


def _names(attrs: str) -> tuple[list[tuple[bool, list[str]]], bool, str]:
    """The names of an element, each with whether it is an id and its words; whether it is hidden; its classes."""
    names, hidden, label = [], False, ""
    for m in ATTRIBUTE.finditer(attrs):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true":
            hidden = True
        elif name != "aria-hidden":
            names += [(name == "id", words) for x in value.split() if (words := [w.lower() for w in NAME_PART.findall(x)])]
            if name == "class":
                label = ".".join(value.split())
    return names, hidden, label


def parse(page: str) -> tuple[list[Node], list[Block]]:
    """Elements (without inline ones) and text blocks of a page, in page order.

    Elements that a browser does not show, and furniture by tag or by a word of
    their class, id or role, are marked as dropped with all they hold.  A name
    alone does not drop an element that holds the page's main heading, and an
    id no heading or paragraph.  A name with other words too ("related-work")
    drops an element of an article or main, or by its id a section anywhere, only if
    half of the text in it is links; so does a name of EITHER alone inside an article or main.
    """
    nodes = [Node("", -1, "", False, False)]
    stack, blocks, pieces, linked, links = [0], [], [], 0, 0

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                blocks.append(Block(stack[-1], text, linked))
        pieces, linked = [], 0

    def close(tag: str) -> None:
        nonlocal links
        if tag != "p":
            links = 0  # a link left open ends with the element round it
        for i in range(len(stack) - 1, 0, -1):
            if nodes[stack[i]].tag == tag:
                del stack[i:]
                return
            if tag == "p" and nodes[stack[i]].tag != "p":
                return

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        raw = page[at : m.start() if m else len(page)]
        if raw:
            text = entities.unescape(raw)
            pieces.append(text)
            if links:
                linked += len(text)
        if not m:
            break
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        closing, attrs = m["close"] or m["close2"], m["attrs"] or m["attrs2"] or ""
        if tag in INLINE:
            if tag == "a":
                links = 0 if closing else 1
            continue
        flush()
        if closing:
            close(tag)
            continue
        if tag in VOID:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if tag in CLOSES_P:
            close("p")
        if tag in ("li", "dt", "dd", "tr", "td", "th") and nodes[stack[-1]].tag == tag:
            stack.pop()
            links = 0
        up = nodes[stack[-1]]
        names, hidden, label = _names(attrs) if attrs else ([], False, "")
        inside = up.article or tag in ("article", "main")
        dropped = hidden or tag in HIDDEN or tag in BOILERPLATE or tag == "header" and not up.article
        furniture = [(by_id, [w in FURNITURE or w == "header" and not up.article for w in words]) for by_id, words in names]
        either = [up.article and all(w in EITHER for w in words) for _, words in names]
        furniture = [(by_id, all(w) and not e) for (by_id, w), e in zip(furniture, either, strict=True) if any(w) and not (by_id and tag in PROSE)]
        if tag in ("html", "body", "main"):
            furniture = []
        named = any(whole or not (up.article or by_id and tag == "section") for by_id, whole in furniture)
        path = f"{up.path}/{tag}" + (f".{label}" if label else "")
        nodes.append(Node(tag, stack[-1], path, dropped, inside, named, bool(furniture) and not named))
        if tag in ("h1", "main"):
            for i in stack:
                nodes[i].main = True
        if attrs.rstrip().endswith("/"):
            continue
        stack.append(len(nodes) - 1)
    flush()
    text, link = [0] * len(nodes), [0] * len(nodes)
    if any(n.doubtful for n in nodes):
        for b in blocks:
            at = b.node
            while at >= 0:
                text[at], link[at] = text[at] + len(b.text), link[at] + b.linked
                at = nodes[at].parent
    for i, node in enumerate(nodes):
        node.named = node.named or node.doubtful and 2 * link[i] >= text[i]
    for node in nodes[1:]:
        node.dropped = node.dropped or node.named and not node.main or nodes[node.parent].dropped
    return nodes, blocks


def path_scores(nodes: list[Node], blocks: list[Block], width: float = 1.0) -> np.ndarray:
    """A fused, smoothed ratio for every block, from its root-to-leaf tag path.

    For each path: unlinked text length per node, and punctuation per node.
    Both are spread over neighbouring blocks in page order with a Gaussian,
    then multiplied (one is added to the punctuation), so headings and short
    lines between content paragraphs share their neighbours' score.
    """
    length: dict[str, float] = defaultdict(float)
    marks: dict[str, float] = defaultdict(float)
    count: dict[str, int] = defaultdict(int)
    for b in blocks:
        path = nodes[b.node].path
        length[path] += max(0, len(b.text) - b.linked)
        marks[path] += len(PUNCTUATION.findall(b.text))
        count[path] += 1
    paths = [nodes[b.node].path for b in blocks]
    ratios = np.array([[length[p] / count[p], marks[p] / count[p]] for p in paths]).reshape(-1, 2)
    reach = max(1, int(np.ceil(2 * width)))
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / width) ** 2)
    kernel /= kernel.sum()
    smooth = np.stack([np.convolve(np.pad(r, reach, mode="edge"), kernel, mode="valid") for r in ratios.T], axis=1)
    return smooth[:, 0] * (1.0 + smooth[:, 1])


def content_blocks(page: str | None, share: float = 0.95, strictness: float = 0.5) -> list[str]:
    """The main text's blocks in page order.

    Blocks of pages' furniture are set aside first.  A path is content if its
    best block scores at least ``strictness`` times the spread (standard
    deviation) of all scores.  The content element is the deepest element that
    holds ``share`` of the text on content paths, or the article or main round it;
    every block in it that is not furniture belongs to the article, however
    short.  Without article and main, so do other blocks on content paths, the main heading, and
    headings and paragraphs that stand beside the content element.
    """
    if not page:
        return []
    nodes, blocks = parse(page)
    open_blocks = [b for b in blocks if not nodes[b.node].dropped]
    if not open_blocks:
        return []
    scores = path_scores(nodes, open_blocks)
    limit = strictness * float(scores.std())
    best: dict[str, float] = defaultdict(float)
    for b, s in zip(open_blocks, scores, strict=True):
        best[nodes[b.node].path] = max(best[nodes[b.node].path], float(s))
    held: dict[int, float] = defaultdict(float)
    total = 0.0
    for b in open_blocks:
        if best[nodes[b.node].path] >= limit:
            weight = float(max(0, len(b.text) - b.linked))
            total += weight
            at = b.node
            while at >= 0:
                held[at] += weight
                at = nodes[at].parent
    if not total:  # links only: the first article or main, if there is one
        round_ = [i for i, n in enumerate(nodes) if n.tag in ("article", "main") and not n.dropped]
        if not round_:
            return []
        held, total = {round_[0]: 1.0}, 1.0
    # Elements are numbered in page order, so of those holding enough the last is the deepest.
    chosen = max(n for n, w in held.items() if w >= share * total)
    if nodes[chosen].tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "li") and nodes[chosen].parent > 0:
        chosen = nodes[chosen].parent  # one long paragraph: its siblings are content too
    at = chosen
    while at > 0 and nodes[at].tag not in ("article", "main"):
        at = nodes[at].parent
    beside = -1 if at else nodes[chosen].parent
    chosen, alone = at or chosen, not at  # an article with one long section is content as a whole

    def inside(at: int) -> bool:
        while at > chosen:
            at = nodes[at].parent
        return at == chosen

    def belongs(b: Block) -> bool:
        node = nodes[b.node]
        if inside(b.node):
            return True
        if not alone or 2 * b.linked >= len(b.text):
            return False
        return best[node.path] >= limit or node.tag == "h1" or node.tag in PROSE and node.parent == beside

    return [b.text for b in open_blocks if belongs(b)]


def with_main_text(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the main text of each page: its blocks, white space made one space, joined by a space.

    NULL and empty pages, and pages without content, give the empty string.
    Every page stands alone: no shuffle, repeated rows give repeated results,
    whole pages are read.  A column named ``out`` is replaced.
    """

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([" ".join(content_blocks(t)) for t in texts], dtype=object)

    return pages.withColumn(out, of(F.col(html)))
