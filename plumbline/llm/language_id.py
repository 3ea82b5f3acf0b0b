"""Language identification with a byte convolutional network.

Bytes are embedded, filters of several widths run over fixed-length windows, each
filter's maximum is pooled and a softmax layer gives probabilities. Training is numpy
on the driver, on windows of a bounded sample of labelled texts (``sample``; those with
the smallest hashes of doc_id, so the choice doesn't depend on the text or on file
order). Prediction covers whole texts: every window counts, weighted by its bytes, and
windows of many texts go through the network as one batch.

A text that is null or has no letter is ``und`` with score 0, as is everything when no
labelled text exists. Very short texts are one padded window. Rows with a null label
or text are never learned from; a null doc_id is never held out. Extra columns are
ignored by ``predict`` and kept by ``keep_known``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, picked, release_memory
from plumbline.runtime import sample_by_hash

WINDOW, WIDTHS, FILTERS, EMBED = 256, (2, 3, 4), 12, 8
UNKNOWN = "und"
#: Windows that go through the network at a time.
BATCH = 384


def has_letter(text: str) -> bool:
    """Whether a character is of a letter category; digits and numerals of any kind aren't."""
    return any(map(str.isalpha, text))


@dataclass
class Network:
    languages: list[str]
    weights: dict[str, np.ndarray]

    @staticmethod
    def new(languages: list[str], rng: np.random.Generator) -> Network:
        w: dict[str, np.ndarray] = {"embed": rng.normal(0, 0.5, (256, EMBED))}
        w["embed"][0] = 0
        for n in WIDTHS:
            w[f"f{n}"] = rng.normal(0, (2 / (n * EMBED)) ** 0.5, (n * EMBED, FILTERS))
            w[f"b{n}"] = np.zeros(FILTERS)
        w["out"] = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages)))
        w["bias"] = np.zeros(len(languages))
        return Network(languages, {k: v.astype(np.float32) for k, v in w.items()})

    def forward(self, windows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Probabilities of each window (rows of bytes); ``keep`` receives what backpropagation needs."""
        w, n = self.weights, len(windows)
        flat = w["embed"][windows].reshape(n, WINDOW * EMBED)
        pooled = []
        for width in WIDTHS:
            places = WINDOW - width + 1
            view = np.lib.stride_tricks.as_strided(flat, (n, places, width * EMBED), (flat.strides[0], 4 * EMBED, 4))
            act = (view.reshape(n * places, width * EMBED) @ w[f"f{width}"]).reshape(n, places, FILTERS)
            pooled.append(np.maximum(act.max(axis=1) + w[f"b{width}"], 0))
            if keep is not None:
                keep[width] = (act.argmax(axis=1), view)
        features = np.concatenate(pooled, axis=1)
        logits = features @ w["out"] + w["bias"]
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=1, keepdims=True)
        if keep is not None:
            keep["features"] = features
        return p

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        keep: dict = {}
        p = self.forward(windows, keep)
        n, w = len(windows), self.weights
        d = p.copy()
        d[np.arange(n), labels] -= 1
        d /= n
        g = {"out": keep["features"].T @ d, "bias": d.sum(axis=0), "embed": np.zeros_like(w["embed"])}
        back = (d @ w["out"].T) * (keep["features"] > 0)
        for k, width in enumerate(WIDTHS):
            best, view = keep[width]
            part = back[:, k * FILTERS : (k + 1) * FILTERS]
            g[f"b{width}"] = part.sum(axis=0)
            seen = view[np.arange(n)[:, None], best]  # the bytes that each filter's maximum saw
            g[f"f{width}"] = np.einsum("nf,nfe->ef", part, seen)
            to_bytes = (part[:, :, None] * w[f"f{width}"].T[None]).reshape(n, FILTERS, width, EMBED)
            at = windows[np.arange(n)[:, None, None], best[:, :, None] + np.arange(width)]
            np.add.at(g["embed"], at.ravel(), to_bytes.reshape(-1, EMBED))
        g["embed"][0] = 0
        return g


def as_windows(data: bytes) -> np.ndarray:
    """Whole text as rows of WINDOW bytes, the last one padded with zeros."""
    rows = max(1, -(-len(data) // WINDOW))
    out = np.zeros(rows * WINDOW, dtype=np.uint8)
    out[: len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(rows, WINDOW)


def train(texts: list[str], labels: list[str], epochs: int = 8, steps: int = 700, seed: int = 7) -> Network:
    """Adam on one window for each text, for ``epochs`` and ``steps`` at least; some windows are cut short, as short texts are."""
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    net = Network.new(languages, rng)
    if not texts:
        return net
    x = np.concatenate([as_windows(t.encode("utf-8", "surrogatepass")[:WINDOW]) for t in texts])
    y = np.array([languages.index(v) for v in labels])
    mean = {k: np.zeros_like(v) for k, v in net.weights.items()}
    square = {k: np.zeros_like(v) for k, v in net.weights.items()}
    step = 0
    epochs = max(epochs, -(-steps // -(-len(x) // 64)))
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for at in range(0, len(x), 64):
            rows = order[at : at + 64]
            batch = x[rows].copy()
            short = rng.random(len(rows)) < 0.4
            ends = np.where(short, rng.integers(12, WINDOW, len(rows)), WINDOW)
            batch[np.arange(WINDOW)[None, :] >= ends[:, None]] = 0
            step += 1
            rate = 0.004 * (1 - epoch / epochs)
            for k, g in net.gradients(batch, y[rows]).items():
                mean[k] += 0.1 * (g - mean[k])
                square[k] += 0.01 * (g * g - square[k])
                net.weights[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return net


def held_out() -> Column:
    """Documents that are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, sample: int = 4000) -> Network:
    """Trains on at most ``sample`` labelled texts, one window of each."""
    usable = picked(docs, "doc_id", "text", "lang").where(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    length = F.length("text")
    offset = F.pmod(F.xxhash64("doc_id", F.lit("window")), F.greatest(F.lit(1), length - WINDOW)).cast("int") + 1
    pieces = usable.select("doc_id", F.substring("text", offset, F.lit(WINDOW)).alias("piece"), "lang")
    rows = [r for r in sample_by_hash(pieces, ["doc_id"], sample).collect() if r["piece"]]  # at most `sample`
    chosen = sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["piece"], r["lang"]))  # their order sets the batches
    return train([r["piece"] for r in chosen], [r["lang"] for r in chosen])


def probabilities(net: Network, texts: list[str | None]) -> list[np.ndarray | None]:
    """Mean probabilities over all windows of each text, weighted by their bytes; None without a letter."""
    if not net.languages:
        return [None] * len(texts)
    out: list[np.ndarray | None] = [None] * len(texts)
    sums = np.zeros((len(texts), len(net.languages)))
    sizes = np.zeros(len(texts))
    rows: list[np.ndarray] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if not rows:
            return
        whose = np.concatenate([np.full(len(w), i) for i, w in rows])
        windows = np.concatenate([w for _, w in rows])
        weight = (windows != 0).sum(axis=1)
        p = net.forward(windows)
        np.add.at(sums, whose, p * weight[:, None])
        np.add.at(sizes, whose, weight)
        rows.clear()
        held = 0

    for i, t in enumerate(texts):
        if not t or not has_letter(t):
            continue
        windows = as_windows(t.encode("utf-8", "surrogatepass"))
        for at in range(0, len(windows), BATCH):
            part = windows[at : at + BATCH]
            if held + len(part) > BATCH:
                flush()
            rows.append((i, part))
            held += len(part)
    flush()
    for i in np.flatnonzero(sizes > 0):
        out[i] = sums[i] / sizes[i]
    return out


def best_of(net: Network, texts: list[str | None]) -> tuple[list[str], list[float]]:
    found = probabilities(net, texts)
    return [UNKNOWN if p is None else net.languages[int(p.argmax())] for p in found], [0.0 if p is None else float(min(1.0, p.max())) for p in found]


def predict(docs: DataFrame, net: Network) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document row."""
    shared = docs.sparkSession.sparkContext.broadcast(net)  # about 10 KB

    def make():
        def run(cols):
            languages, scores = best_of(shared.value, cols["text"])
            return {"doc_id": cols["doc_id"], "held_out": cols["held_out"], "lang_pred": languages, "score": scores}

        return run

    return arrow_map(docs.select("doc_id", held_out().alias("held_out"), "text"), make, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame, net: Network, least: float = 0.35) -> DataFrame:
    """Documents whose language is known with a score of ``least`` or more; all their columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory(caches=True)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                languages, scores = best_of(shared.value, part.column(part.schema.get_field_index("text")).to_pylist())
                yield part.filter(pa.array([v != UNKNOWN and s >= least for v, s in zip(languages, scores)], pa.bool_()))
        release_memory()

    return docs.mapInArrow(run, docs.schema)
