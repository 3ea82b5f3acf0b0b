"""Main-text extraction by minimum-cut labelling of a page's text blocks.

A page becomes blocks of text (runs without a block-level border) that know their
place in the element tree. A logistic regression over tag, class, link and text features,
trained on a bounded sample of labelled pages (``html_sample``), gives each block a cost;
costs are the capacities to the terminals (content, boilerplate). Blocks that follow one another, and blocks that are near in the tree,
are joined by smoothness edges. A maximum flow separates the two labels at least cost.

Null, empty and tagless input, broken markup and unclosed elements all work: a page
without blocks of content has the empty text. Work is linear in the page's length but
for the flow, whose searches stay local: blocks that can't reach a free capacity are
settled at once and never searched again. Repeated rows each give a row; extra columns
are ignored.
"""

from __future__ import annotations

import re
from collections import Counter, deque
from html import unescape

import numpy as np
from pyspark.sql import DataFrame

from plumbline.llm.common import arrow_map, picked
from plumbline.llm.html_sample import N_PAGES
from plumbline.llm.html_sample import pages as sample_pages

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<close>/?)(?P<tag>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>"""
    r"""|<(?P<close2>/?)(?P<tag2>[A-Za-z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)|(?P<text>[^<]+|<)""",
    re.S,
)
_HINT = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

RAW = frozenset("script style textarea title iframe".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math mfrac mi mn mo mrow ms msqrt msub msup mtext q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
NEVER = frozenset("nav footer aside form button fieldset dialog menu head option".split())
MAIN = frozenset("article main".split())
#: Words of class, id and role attributes that name parts which aren't content, by part and in several languages.
LEXICON = {
    "adverts": "ad ads advert adverts advertisement advertising anzeige anzeigen werbung reklame reklam publicite publicidad pubblicita annonce promo promoted sponsor sponsored outbrain taboola banner",
    "navigation": "nav navbar navigation menu menue menü breadcrumb breadcrumbs pager pagination toolbar dock topnav footnav navegacion gezinme",
    "frame": "header masthead footer kopfzeile fusszeile fußzeile pie cabecera entete contentinfo sidebar seitenleiste barra kenar",
    "notices": "cookie cookies consent notice notices alert modal popup paywall hinweis aviso avis uyari",
    "forms": "form login signup subscribe newsletter formular formulario",
    "comments": "comment comments disqus replies reply respond kommentar kommentare commentaire commentaires comentario comentarios yorum yorumlar",
    "social": "social sharing related recommend recommended widget verwandte relacionados",
}
BAD_WORDS = frozenset(w for group in LEXICON.values() for w in group.split())
GOOD_WORDS = frozenset("article content entry main post story artikel inhalt beitrag contenido contenu icerik".split())

FEATURES = ("never", "bad", "main", "beside", "good", "linked", "heading", "item", "paragraph", "length", "short", "stop", "sign", "bias")
#: Smoothness: blocks that follow one another, with the same parent, and the nearest earlier block of the same section.
#: Same unit as the classifier's costs, thousandths of a logit.
ADJACENT, SIBLING, SECTION = 700, 900, 400


class Node:
    __slots__ = ("bad", "good", "holds_main", "main", "never", "parent", "section", "tag")

    def __init__(self, tag: str, parent: Node | None, words: set[str]):
        self.tag, self.parent, self.holds_main = tag, parent, False
        above = parent
        self.main = tag in MAIN or bool(above and above.main)
        self.never = tag in NEVER or bool(above and above.never) or (tag == "header" and not self.main)
        self.bad = bool(words & BAD_WORDS) and tag not in ("html", "body")
        self.good = bool(words & GOOD_WORDS) or bool(above and above.good)
        self.section = self if tag in ("section", "div", "article", "main", "body", "td", "ul", "ol") or above is None else above.section


class Block:
    __slots__ = ("linked", "node", "parts", "text")

    def __init__(self, node: Node):
        self.node, self.parts, self.linked, self.text = node, [], 0, ""


def blocks_of(html: str) -> list[Block]:
    """Text blocks in page order, with their white space folded."""
    root = Node("", None, set())
    stack, open_tags = [root], Counter()
    blocks: list[Block] = []
    now = Block(root)
    anchors = 0

    def border() -> None:
        nonlocal now
        if now.parts:
            now.text = " ".join("".join(now.parts).split())
            if now.text:
                blocks.append(now)
        now = Block(stack[-1])

    def close(tag: str) -> None:
        while open_tags[tag]:
            gone = stack.pop().tag
            open_tags[gone] -= 1
            if gone == tag:
                break

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.match(html, at)
        at = m.end()
        if m["text"] is not None:
            part = unescape(m["text"]) if "&" in m["text"] else m["text"]
            now.parts.append(part)
            if anchors:
                now.linked += len(part)
            continue
        tag = m["tag"] or m["tag2"]
        if tag is None:
            continue
        tag, closing, attrs = tag.lower(), m["close"] or m["close2"], m["attrs"] or m["attrs2"] or ""
        if tag in RAW and not closing:
            if not attrs.rstrip().endswith("/") or tag != "iframe":
                end = re.compile(rf"</{tag}(?:[\s/][^>]*)?>", re.I).search(html, at)
                at = end.end() if end else n
            border()
        elif tag in VOID:
            if tag in ("br", "hr"):
                now.parts.append(" ")
            if tag == "hr":
                border()
        elif tag in INLINE:
            if tag == "a":
                anchors = max(0, anchors - 1) if closing else 1
        elif closing:
            anchors = 0
            if open_tags[tag]:
                close(tag)
            border()
        else:
            anchors = 0
            if tag in ("li", "tr", "td", "th", "dt", "dd", "option") and stack[-1].tag == tag or stack[-1].tag == "option" or tag != "p" and stack[-1].tag == "p":
                close(stack[-1].tag)
            elif tag == "p" and open_tags["p"]:
                close("p")
            words = {w.lower() for h in _HINT.findall(attrs) for w in _WORDS.findall("".join(h))} if attrs else set()
            node = Node(tag, stack[-1], words)
            stack.append(node)
            open_tags[tag] += 1
            if tag in MAIN:
                up = node.parent
                while up is not None and not up.holds_main:
                    up.holds_main = True
                    up = up.parent
            border()
    border()
    return blocks


def features(blocks: list[Block]) -> np.ndarray:
    """A row of ``FEATURES`` for each block."""
    bad: dict[int, bool] = {}
    some_main = any(b.node.main for b in blocks)
    out = np.zeros((len(blocks), len(FEATURES)))
    for i, block in enumerate(blocks):
        node, text = block.node, block.text
        chain, up = [], node
        while up is not None and id(up) not in bad:
            chain.append(up)
            up = up.parent
        state = bad[id(up)] if up is not None else False
        for x in reversed(chain):  # a wrapper of the main element isn't judged by its class
            state = bad[id(x)] = state or (x.bad and not x.holds_main)
        out[i] = (
            node.never and not node.holds_main,
            state,
            node.main,
            some_main and not node.main,
            node.good,
            min(block.linked, len(text)) / max(1, len(text)),
            node.tag in ("h1", "h2", "h3", "h4", "h5", "h6"),
            node.tag in ("li", "td", "th", "dd", "dt"),
            node.tag in ("p", "blockquote", "pre"),
            min(len(text), 320) / 320,
            len(text) < 25,
            text[-1] in ".!?…:;\"'»”",
            "©" in text[:40],
            1,
        )
    return out


def learn(rows: np.ndarray, labels: np.ndarray, ridge: float = 0.3, steps: int = 30) -> np.ndarray:
    """Weights of a logistic regression by Newton's method."""
    w = np.zeros(rows.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(rows @ w)))
        slope = rows.T @ (labels - p) - ridge * w
        w += np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + ridge * np.eye(len(w)), slope)
    return w


def fit(n_pages: int = N_PAGES) -> np.ndarray:
    """The classifier's weights, learned from at most ``n_pages`` labelled pages."""
    rows, labels = [], []
    for html, label in sample_pages(LEXICON, NEVER, n_pages):
        blocks = blocks_of(html)
        rows.append(features(blocks))
        labels += [label[b.text] for b in blocks]
    return learn(np.concatenate(rows), np.array(labels, dtype=float))


def costs_of(blocks: list[Block], weights: np.ndarray) -> list[int]:
    """The classifier's verdicts in thousandths of a logit; positive for content."""
    return np.rint(1000 * (features(blocks) @ weights)).astype(int).tolist() if blocks else []


def smoothness(blocks: list[Block]) -> list[dict[int, int]]:
    """Neighbours of each block and the capacity between them."""
    edges: list[dict[int, int]] = [{} for _ in blocks]

    def join(a: int, b: int, c: int) -> None:
        edges[a][b] = edges[a].get(b, 0) + c
        edges[b][a] = edges[b].get(a, 0) + c

    last: dict[int, int] = {}
    for i, b in enumerate(blocks):
        if i:
            join(i - 1, i, ADJACENT + SIBLING * (blocks[i - 1].node.parent is b.node.parent))
        near = id(b.node.section)
        if near in last:
            join(last[near], i, SECTION)
        last[near] = i
    return edges


def content_side(costs: list[int], edges: list[dict[int, int]]) -> set[int]:
    """Blocks on the content side of a minimum cut.

    A block's two terminals cancel out to one number, so flow runs from blocks with a
    surplus (content) to blocks with a deficit, along shortest paths of free capacity.
    A search that finds no deficit proves that all it reached lie on the content side.
    """
    free = [dict(e) for e in edges]
    need = list(costs)
    settled: set[int] = set()
    for source in range(len(costs)):
        while need[source] > 0 and source not in settled:
            before = {source: source}
            queue, found = deque([source]), -1
            while queue and found < 0:
                at = queue.popleft()
                for to, c in free[at].items():
                    if c > 0 and to not in before and to not in settled:
                        before[to] = at
                        if need[to] < 0:
                            found = to
                            break
                        queue.append(to)
            if found < 0:
                settled.update(before)
                break
            path = [found]
            while path[-1] != source:
                path.append(before[path[-1]])
            path.reverse()
            flow = min(need[source], -need[found], *(free[a][b] for a, b in zip(path, path[1:])))
            for a, b in zip(path, path[1:]):
                free[a][b] -= flow
                free[b][a] += flow
            need[source] -= flow
            need[found] += flow
    return settled


def extract_text(html: str | None, weights: np.ndarray) -> str:
    """The main text of one page."""
    blocks = blocks_of(html or "")
    keep = content_side(costs_of(blocks, weights), smoothness(blocks))
    return " ".join(b.text for i, b in enumerate(blocks) if i in keep)


def extract(pages: DataFrame, weights: np.ndarray | None = None) -> DataFrame:
    """page_id, url, text and n_chars of every page; ``weights`` as ``fit`` gives them."""
    weights = fit() if weights is None else weights

    def make():
        def run(cols):
            texts = [extract_text(h, weights) for h in cols["html"]]
            return {"page_id": cols["page_id"], "url": cols["url"], "text": texts, "n_chars": [len(t) for t in texts]}

        return run

    return arrow_map(picked(pages, "page_id", "url", "html"), make, "page_id long, url string, text string, n_chars long")
