"""Quality classifier: a generalised additive model with pairwise interactions.

Numbers that describe a text (``FEATURES``) are cut into quantile bins. Shallow trees,
boosted feature by feature in turn, are added up into one lookup table for each
feature; then the pairs of features that explain most of what is left get
two-dimensional tables in the same way. A score is the sigmoid of the sum of table
entries, looked up for whole batches at once.

The tables are fitted on the driver on at most ``sample`` labelled rows (those with the
smallest hashes of doc_id); only their features are collected. Texts are described
whole. Null and empty texts have the features of no words and get a score like any
other. Rows with a null label are not learned from; of rows that repeat a doc_id each
counts. A null doc_id is not held out. Without labels the score is 0.5. Extra columns
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, picked
from plumbline.runtime import sample_by_hash

FEATURES = (
    "words", "word_bytes", "distinct_words", "longest_word", "short_words", "lines", "line_words", "repeated_lines",
    "symbols", "exclamations", "pipes", "sentence_ends", "commas", "capitals", "digits", "spaces", "non_ascii", "quotes",
)
#: A document is predicted to be good from this score on.
GOOD_FROM = 0.3

_SYMBOLS = np.frombuffer(b"#*$%&<>=@_~^\\{}[]", dtype=np.uint8)


def features_of(text: str | None) -> list[float]:
    """The numbers of one text, all of it."""
    data = (text or "").encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    n, size = max(1, len(words)), max(1, len(data))
    c = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    total = int(sum(map(len, words)))
    longest = max(map(len, words), default=0)
    return [
        np.log1p(len(words)), total / n, len(set(words)) / n, float(longest), sum(1 for w in words if len(w) < 4) / n, np.log1p(len(lines)),
        len(words) / max(1, len(lines)), 1 - len(set(lines)) / max(1, len(lines)), c[_SYMBOLS].sum() / n, c[33] / n, c[124] / n, (c[46] + c[63]) / n, c[44] / n,
        c[65:91].sum() / size, c[48:58].sum() / size, c[[9, 10, 11, 12, 13, 32]].sum() / size, c[128:].sum() / size, (c[34] + c[39]) / n,
    ]


@dataclass
class Model:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    bias: float
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)  # bin -> coarse bin

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(self.edges)], axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty(0)
        b = self.bins(x)
        total = np.full(len(x), self.bias)
        for f, t in enumerate(self.tables):
            total += t[b[:, f]]
        for (f, g), t in zip(self.pairs, self.pair_tables):
            total += t[self.coarse[f][b[:, f]], self.coarse[g][b[:, g]]]
        return 1 / (1 + np.exp(-total))


def _best_cut(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, int]:
    """Gain and place of the best cut of a row of bins."""
    cg, ch = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    tg, th = g.sum(), h.sum()
    ok = (ch >= least) & (th - ch >= least)
    if not ok.any():
        return 0.0, -1
    gain = np.where(ok, cg**2 / (ch + 1) + (tg - cg) ** 2 / (th - ch + 1) - tg**2 / (th + 1), -1)
    k = int(gain.argmax())
    return float(gain[k]), k + 1


def _tree(g: np.ndarray, h: np.ndarray, leaves: int, least: float) -> np.ndarray:
    """A tree over one feature's bins, as the value of each bin."""
    parts = [(0, len(g))]
    while len(parts) < leaves:
        options = [(*_best_cut(g[a:b], h[a:b], least), k) for k, (a, b) in enumerate(parts) if b - a > 1]
        gain, cut, k = max(options, default=(0.0, -1, 0))
        if gain <= 1e-9:
            break
        a, b = parts[k]
        parts[k : k + 1] = [(a, a + cut), (a + cut, b)]
    out = np.zeros(len(g))
    for a, b in parts:
        out[a:b] = g[a:b].sum() / (h[a:b].sum() + 1)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray, least: float) -> tuple[float, np.ndarray]:
    """A tree of depth two over a grid: a cut along one axis, then one along the other on each side. Gain and cell values."""
    best: tuple[float, np.ndarray] = (0.0, np.zeros_like(g))
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        base = gg.sum() ** 2 / (hh.sum() + 1)
        for cut in range(1, gg.shape[0]):
            value, gain = np.zeros_like(gg), -base
            for side in (slice(0, cut), slice(cut, None)):
                rg, rh = gg[side].sum(axis=0), hh[side].sum(axis=0)
                row = _tree(rg, rh, 2, least)
                value[side] = row
                gain += float((row * rg).sum())
            if gain > best[0]:
                best = gain, (value.T if flip else value)
    return best


def fit_tables(x: np.ndarray, y: np.ndarray, bins: int = 48, rounds: int = 120, rate: float = 0.12, leaves: int = 3, pairs: int = 6, grid: int = 8, least: float = 4.0) -> Model:
    """Cyclic boosting of single features, then of the best pairs, on the logistic loss."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    share = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    model = Model(edges, [np.zeros(len(e) + 1) for e in edges], float(np.log(share / (1 - share))))
    b = model.bins(x)
    total = np.full(len(x), model.bias)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return y - p, p * (1 - p)

    for _ in range(rounds):
        for f, table in enumerate(model.tables):
            g, h = slopes()
            size = len(table)
            step = rate * _tree(np.bincount(b[:, f], g, size), np.bincount(b[:, f], h, size), leaves, least)
            table += step
            total += step[b[:, f]]
    model.coarse = [np.minimum(np.arange(len(t)) * grid // len(t), grid - 1) for t in model.tables]
    c = np.stack([model.coarse[f][b[:, f]] for f in range(x.shape[1])], axis=1)

    def on_grid(f: int, k: int, v: np.ndarray) -> np.ndarray:
        return np.bincount(c[:, f] * grid + c[:, k], v, grid * grid).reshape(grid, grid)

    g, h = slopes()
    gains = sorted(((_pair_tree(on_grid(f, k, g), on_grid(f, k, h), least)[0], f, k) for f in range(x.shape[1]) for k in range(f)), reverse=True)
    model.pairs = [(f, k) for _, f, k in gains[:pairs]]
    model.pair_tables = [np.zeros((grid, grid)) for _ in model.pairs]
    for _ in range(rounds // 4):
        for (f, k), table in zip(model.pairs, model.pair_tables):
            g, h = slopes()
            step = rate * _pair_tree(on_grid(f, k, g), on_grid(f, k, h), least)[1]
            table += step
            total += step[c[:, f], c[:, k]]
    return model


def held_out() -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = 20_000) -> Model:
    """Fits on the features of at most ``sample`` labelled rows that aren't held out."""
    usable = picked(labels, "doc_id", "quality").where(~held_out() & F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    chosen = sample_by_hash(usable, ["doc_id"], sample)

    def make():
        return lambda cols: {"quality": cols["quality"], "x": [features_of(t) for t in cols["text"]]}

    texts = picked(docs, "doc_id", "text").join(F.broadcast(chosen), "doc_id").select("quality", "text")  # at most `sample` ids
    rows = arrow_map(texts, make, "quality int, x array<double>").collect()
    rows.sort(key=lambda r: (r["quality"], r["x"]))  # the tables don't depend on the order in which rows arrive
    if not rows:
        return Model([np.empty(0)] * len(FEATURES), [np.zeros(1)] * len(FEATURES), 0.0)
    return fit_tables(np.array([r["x"] for r in rows]), np.array([r["quality"] for r in rows], dtype=float))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every document row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of a few KB

    def make():
        def run(cols):
            s = shared.value.score(np.array([features_of(t) for t in cols["text"]]).reshape(len(cols["text"]), len(FEATURES)))
            return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "score": s, "predicted": (s >= GOOD_FROM).astype(np.int32)}

        return run

    return arrow_map(docs.select("doc_id", held_out().alias("held_out"), "text"), make, "doc_id long, held_out boolean, score double, predicted int")
