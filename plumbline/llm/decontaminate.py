"""Benchmark decontamination: a prefix-filtered containment join of item windows with documents.

An item is cut into windows of ``width`` consecutive words (an item with fewer
words, but not none, is one window). Containment of a window means that all of
its shingles occur, so the necessary prefix of the window's shingles, ordered
from rare to frequent, is a single one: the rarest. Shingle frequencies are
counted over all documents. A document position that holds a prefix shingle is a
candidate; the shingle's offset in the window and the document's length bound
where the window could lie, and the words there are compared exactly.

The benchmark is read in blocks of at most ``block_words`` words; each block's
index is broadcast, so the broadcast has a fixed bound, and a larger benchmark
takes more passes over the documents, never a larger broadcast.

Nulls and empty texts have no words: 0 words, 0 hits, no items. A null item text
has no window; an item without an id still marks words but isn't listed. Repeated
items count once, repeated document rows each give a row. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, materialize, picked, release_memory

#: Lower-cases A-Z and turns every other ASCII character that isn't a letter or digit into a space.
FOLD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

SHINGLE = 3


def words_of(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8 bytes. Only the ASCII space separates, after ``FOLD``."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split() if text else []


@dataclass
class Block:
    """Windows of a bounded part of the benchmark."""

    windows: dict[tuple[bytes, ...], list[int]]  # the window's words -> items that have it

    def shingles(self, window: tuple[bytes, ...]) -> list[tuple[bytes, ...]]:
        return [window[i : i + SHINGLE] for i in range(max(1, len(window) - SHINGLE + 1))]

    def all_shingles(self) -> set[tuple[bytes, ...]]:
        return {s for w in self.windows for s in self.shingles(w)}

    def index(self, frequency: dict[tuple[bytes, ...], int]) -> dict[tuple[bytes, ...], list[tuple[int, tuple[bytes, ...], list[int]]]]:
        """Rarest shingle -> (its offset, window, items). Windows with a shingle that no document has are left out."""
        out: dict = {}
        for w, items in self.windows.items():
            ranked = [(frequency.get(s, 0), i, s) for i, s in enumerate(self.shingles(w))]
            n, i, s = min(ranked)
            if n:
                out.setdefault(s, []).append((i, w, items))
        return out


def blocks_of(benchmark: DataFrame, width: int, block_words: int) -> Iterator[Block]:
    """Cuts the benchmark into blocks; rows arrive partition by partition and only one block is held."""
    held: dict[tuple[bytes, ...], list[int]] = {}
    size = 0
    for row in picked(benchmark, "item_id", "text").toLocalIterator():
        words = words_of(row["text"])
        for i in range(max(1, len(words) - width + 1) if words else 0):
            held.setdefault(tuple(words[i : i + width]), []).append(row["item_id"])
        size += len(words)
        if size >= block_words:
            yield Block(held)
            held, size = {}, 0
    if held:
        yield Block(held)


def _spots(words: list[bytes], firsts: set[bytes], longer: set[int]) -> list[tuple[int, tuple[bytes, ...]]]:
    """(position, shingle) of each place where a wanted shingle may start."""
    return [(i, tuple(words[i : i + n])) for i in [i for i, w in enumerate(words) if w in firsts] for n in longer if i + n <= len(words)]


def shingle_counts(docs: DataFrame, block: Block) -> dict[tuple[bytes, ...], int]:
    """How often each shingle of the block occurs in all documents."""
    wanted = list(block.all_shingles())
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def make():
        at = {s: k for k, s in enumerate(shared.value)}
        firsts, lengths = {s[0] for s in at}, {len(s) for s in at}

        def count(cols):
            totals: dict[int, int] = {}
            for text in cols["text"]:
                for _, s in _spots(words_of(text), firsts, lengths):
                    k = at.get(s)
                    if k is not None:
                        totals[k] = totals.get(k, 0) + 1
            return {"k": list(totals), "n": list(totals.values())}

        return count

    rows = arrow_map(picked(docs, "text"), make, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()  # one row for each shingle of a block
    shared.unpersist()
    return {wanted[r["k"]]: r["n"] for r in rows}


def find_occurrences(words: list[bytes], index: dict, firsts: set[bytes], lengths: set[int]) -> tuple[list[tuple[int, int]], set[int]]:
    """Word intervals of all occurring windows, and the items that own them."""
    spans: list[tuple[int, int]] = []
    items: set[int] = set()
    n = len(words)
    for i, s in _spots(words, firsts, lengths):
        for off, window, owners in index.get(s, ()):
            start, size = i - off, len(window)
            if start >= 0 and start + size <= n and tuple(words[start : start + size]) == window:
                spans.append((start, start + size))
                items.update(owners)
    return spans, items


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = 1_000_000) -> DataFrame:
    """doc_id, n_words, hits (merged word intervals, as a flat list) and items (ids) for each document row."""
    docs = picked(docs, "doc_id", "text")
    blocks = list_or_one(blocks_of(benchmark, width, block_words))
    block, more = next(blocks), next(blocks, None)
    if more is None:
        return _marked(docs, block, ["doc_id"]).select("doc_id", "n_words", "hits", "items")
    numbered = materialize(docs.withColumn("_row", F.monotonically_increasing_id()), "numbered")  # each block must see the same numbers
    rows = materialize(_marked(numbered, block, ["_row", "doc_id"]), "leaks")
    while more is not None:
        block, more = more, next(blocks, None)
        rows = rows.unionByName(materialize(_marked(numbered, block, ["_row", "doc_id"]).where(F.size("hits") > 0), "leaks"))
    return _united(rows)


def _marked(docs: DataFrame, block: Block, keys: list[str]) -> DataFrame:
    """The key columns, n_words, hits and items of every row of ``docs``, for one block of the benchmark."""
    shared = docs.sparkSession.sparkContext.broadcast(block.index(shingle_counts(docs, block)))

    def make():
        index = shared.value
        firsts, lengths = {s[0] for s in index}, {len(s) for s in index}

        def mark(cols):
            counts, hits, items = [], [], []
            for text in cols["text"]:
                words = words_of(text)
                spans, owners = find_occurrences(words, index, firsts, lengths)
                counts.append(len(words))
                hits.append([x for span in merged(spans) for x in span])
                items.append(sorted(x for x in owners if x is not None))
            return {**{k: cols[k] for k in keys}, "n_words": counts, "hits": hits, "items": items}

        return mark

    return arrow_map(docs, make, "".join(f"{k} long, " for k in keys) + "n_words long, hits array<int>, items array<long>")


def list_or_one(blocks: Iterator[Block]) -> Iterator[Block]:
    """At least one block, so that an empty benchmark still gives a row for each document."""
    some = False
    for b in blocks:
        some = True
        yield b
    if not some:
        yield Block({})


def _united(rows: DataFrame) -> DataFrame:
    """Results of several blocks as one row for each document row."""

    def make():
        def merge(cols):
            spans = [[x for a in merged([(h[i], h[i + 1]) for h in hs for i in range(0, len(h), 2)]) for x in a] for hs in cols["hits"]]
            return {"doc_id": cols["doc_id"], "n_words": cols["n_words"], "hits": spans, "items": [sorted({i for x in xs for i in x}) for xs in cols["items"]]}

        return merge

    grouped = rows.groupBy("_row").agg(F.first("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.collect_list("hits").alias("hits"), F.collect_list("items").alias("items"))
    return arrow_map(grouped.drop("_row"), make, "doc_id long, n_words long, hits array<int>, items array<long>")


def clean(docs: DataFrame, benchmark: DataFrame, width: int = 10, block_words: int = 1_000_000) -> DataFrame:
    """Documents without a word in any benchmark window; all their columns stay. No shuffle: each block filters in place."""
    schema, kept = docs.schema, docs
    for k, block in enumerate(blocks_of(benchmark, width, block_words)):
        kept = materialize(kept, "clean") if k else kept  # one block's broadcast at a time in a task
        shared = docs.sparkSession.sparkContext.broadcast(block.index(shingle_counts(picked(kept, "text"), block)))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            firsts, lengths = {s[0] for s in index}, {len(s) for s in index}
            for batch in batches:
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                yield batch.filter(pa.array([not find_occurrences(words_of(t), index, firsts, lengths)[0] for t in texts], type=pa.bool_()))
            release_memory()

        kept = kept.mapInArrow(run, schema)
    return kept


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns from ``find_contamination``'s rows."""

    def make():
        def row(cols):
            n_hit = [sum(h[1::2]) - sum(h[::2]) for h in cols["hits"]]
            sha = [hashlib.sha256(",".join(sorted({str(i) for i in x})).encode()).hexdigest() for x in cols["items"]]
            return {"doc_id": cols["doc_id"], "n_words": cols["n_words"], "n_hit": n_hit, "n_items": [len(x) for x in cols["items"]], "items_sha256": sha, "contaminated": [n > 0 for n in n_hit]}

        return row

    return arrow_map(found, make, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")
