"""Labelled sample pages from which the block classifier of ``html_extract`` learns its weights.

The pages are made by rule: layouts of the usual parts of a page, with and without
class names, in the vocabulary of ``html_extract.LEXICON`` and without it. Texts are
random words, so only their form can be learned. ``N_PAGES`` bounds the sample.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

N_PAGES = 240

_LETTERS = "aaeeiioounnrrssttlldcmpgbhfvkwyzäéñıç"


class _Writer:
    """A page's markup, and the texts of its blocks by label."""

    def __init__(self, rnd: random.Random):
        self.rnd, self.out = rnd, []
        self.labels: dict[str, bool] = {}

    def text(self, words: int, end: str, label: bool) -> str:
        r = self.rnd
        t = " ".join("".join(r.choice(_LETTERS) for _ in range(r.randint(1, 9))) for _ in range(words)).capitalize() + end
        self.labels[t] = label
        return t

    def links(self, n: int, label: bool = False) -> str:
        return "".join(f'<li><a href="/{i}">{self.text(self.rnd.randint(1, 3), "", label)}</a></li>' for i in range(n))

    def paragraph(self, label: bool) -> str:
        r = self.rnd
        return f"<p>{self.text(r.choice((4, 9, 20, 45, 90)), r.choice('....!?:'), label)}</p>"

    def article(self) -> str:
        r, parts = self.rnd, []
        if r.random() < 0.8:
            parts.append(f"<h1>{self.text(r.randint(2, 9), r.choice(['', '', '.']), True)}</h1>")
        for _ in range(r.randint(2, 9)):
            kind = r.random()
            if kind < 0.68:
                parts.append(self.paragraph(True))
            elif kind < 0.76:
                parts.append(f"<h2>{self.text(r.randint(1, 6), '', True)}</h2>")
            elif kind < 0.84:
                parts.append("<ul>" + "".join(f"<li>{self.text(r.randint(3, 14), r.choice(['', '.']), True)}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif kind < 0.9:
                parts.append(f"<blockquote>{self.text(r.randint(6, 30), '.', True)}</blockquote>")
            elif kind < 0.94:
                parts.append("<table>" + "".join(f"<tr><td>{self.text(2, '', True)}</td><td>{self.text(3, '', True)}</td></tr>" for _ in range(3)) + "</table>")
            else:
                parts.append(f"<pre>{self.text(r.randint(5, 20), ';', True)}</pre>")
        return "".join(parts)

    def boilerplate(self) -> str:
        """The inside of a part that isn't content, in any form."""
        r = self.rnd
        kind = r.random()
        if kind < 0.4:
            return f"<ul>{self.links(r.randint(2, 7))}</ul>"
        if kind < 0.75:
            return "".join(self.paragraph(False) for _ in range(r.randint(1, 3)))
        return f"<span>{self.text(r.randint(1, 8), r.choice(['', '!']), False)}</span>"


def pages(lexicon: dict[str, str], never: frozenset[str], n: int = N_PAGES, seed: int = 11) -> Iterator[tuple[str, dict[str, bool]]]:
    """(html, label of each block's text) of ``n`` pages."""
    rnd = random.Random(seed)
    words = [w for group in lexicon.values() for w in group.split()]
    for k in range(n):
        w = _Writer(rnd)
        body: list[str] = []

        def apart(tags: list[str]) -> None:
            for _ in range(rnd.randint(0, 3)):
                if rnd.random() < 0.5:
                    tag = rnd.choice(tags)
                    body.append(f"<{tag}>{w.boilerplate()}</{tag}>")
                else:
                    body.append(f'<div class="{rnd.choice(["", "x-", "box "])}{rnd.choice(words)}">{w.boilerplate()}</div>')

        if rnd.random() < 0.7:
            body.append(f"<{('header', 'div')[k % 2]}><ul>{w.links(rnd.randint(3, 8))}</ul></{('header', 'div')[k % 2]}>")
        apart(sorted(never - {"head", "option", "menu"}) + ["header"])
        inner = w.article()
        if rnd.random() < 0.5:  # parts inside the content's own box
            inner += f'<div class="{rnd.choice(words)}">{w.boilerplate()}</div>' if rnd.random() < 0.6 else f"<aside>{w.boilerplate()}</aside>"
            inner += w.paragraph(True)
        kind = rnd.random()
        if kind < 0.35:
            tag = rnd.choice(["article", "main"])
            body.append(f"<{tag}>{inner}</{tag}>")
            if rnd.random() < 0.5:  # beside the main element, nothing else tells what it is
                body.append(f"<div>{w.boilerplate()}</div>")
        elif kind < 0.65:
            body.append(f'<div class="{rnd.choice(["content", "post-body", "entry", "main-story", "article-text"])}">{inner}</div>')
        else:
            body.append(f'<div class="{rnd.choice(["", "row", "c12", "wrap results", "left"])}">{inner}</div>')
        apart(sorted(never - {"head", "option", "menu"}))
        if rnd.random() < 0.7:
            sign = f"© {rnd.randint(1990, 2030)} " if rnd.random() < 0.6 else ""
            tail = w.text(rnd.randint(2, 12), rnd.choice(["", "."]), False)
            w.labels[sign + tail] = False
            tag = rnd.choice(["footer", "div", "p"]) if sign else "footer"
            body.append(f"<{tag}>{sign}{tail}</{tag}>")
        yield "<html><body>" + "".join(body) + "</body></html>", w.labels
