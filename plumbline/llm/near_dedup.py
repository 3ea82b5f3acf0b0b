"""Near-duplicate detection with bottom-k sketches from one hash function.

1. Each document's distinct word shingles are hashed once; its sketch is the ``K``
   smallest hashes. Documents with equal shingle sets form a class, represented by
   its smallest doc_id, so copies are never compared.
2. Inverted lists of retained values: for a pair at the wanted similarity, at least
   ``least_shared(share)`` of the smallest ``K`` values of the union lie in both sketches
   (all but about one pair in 1e9). So it's enough that each document enters the lists of
   its ``K - least + 1`` values that are rarest among the sketches: two such documents
   meet in one of them, and passages that many documents share make no long lists.
3. In a list, the union sketch (the ``K`` smallest values of both) estimates
   similarity and joins documents into candidate groups; only a spanning forest of
   each list leaves the task. Components of these edges are the candidate groups.
4. In each group, documents whose full shingle sets share one of their rarest shingles
   (the necessary prefix for the wanted similarity) are compared exactly; no others can
   be linked. A document that has been linked isn't compared with its own component
   again, and only a spanning forest leaves the task. Components of these edges are
   the result.

Shingles are compared as 64-bit hashes of their words: two different shingles of one pair
of documents agree with a chance of about 1e-19 for each pair of shingles.

Lists and groups above a block size are dealt out as pairs of blocks, so no task
holds more than two blocks, whatever a list's or group's size.

A null text, or one without words, has no shingles and is linked with nothing (kept).
Ties don't matter: components are closed under links. Rows that repeat a doc_id are
one node and each give a row. Rows with a null doc_id are never linked and are kept.
Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import arrow_map, materialize, picked, release_memory
from plumbline.llm.components import components
from plumbline.llm.shingles import shingle_set

K = 32
#: Rows of a list, and of a group, that one block holds at most, about; and shingles of a group.
LIST_BLOCK, GROUP_BLOCK, GROUP_SHINGLES = 750, 2000, 1_000_000
#: Percent of the union that linked documents share at least, where no contract says otherwise.
SHARE = 80

_U = np.uint64


def least_shared(share: int) -> int:
    """How many of the ``K`` smallest values of the union all but one in 1e9 pairs at ``share`` percent have in common."""
    p, missed, n = share / 100, 0.0, 0
    while n < K and (missed := missed + comb(K, n) * p**n * (1 - p) ** (K - n)) <= 1e-9:
        n += 1
    return max(1, n)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fp (hash of the whole set; null if empty) and sketch (smallest K hashes, ascending as unsigned)."""

    def make():
        def run(cols):
            out = {"doc_id": cols["doc_id"], "n_shingles": [], "fp": [], "sketch": []}
            for text in cols["text"]:
                s = shingle_set(text)
                out["n_shingles"].append(len(s))
                out["fp"].append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                out["sketch"].append(s[:K].view(np.int64))
            return out

        return run

    return arrow_map(picked(docs, "doc_id", "text"), make, "doc_id long, n_shingles long, fp string, sketch array<long>")


def _prefix_entries(reps: DataFrame, share: int) -> DataFrame:
    """(v, rep, n_shingles, sketch): each representative in the lists of its rarest values, lists of one left out."""
    spread = reps.select("rep", F.explode("sketch").alias("v"))
    shared = spread.groupBy("v").agg(F.count("*").alias("n")).where("n > 1")
    ranked = spread.join(shared, "v").groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("n", "v"))).alias("seen"))
    joined = reps.join(ranked, "rep")
    need = F.least(F.lit(least_shared(share)), F.ceil(F.col("n_shingles") * share / 100)).cast("int")
    # values that no other sketch has come first in the order of rarity and take their places in the prefix
    places = F.size("sketch") - need + 1 - (F.size("sketch") - F.size("seen"))
    top = F.when(places > 0, F.slice("seen", F.lit(1), F.greatest(places, F.lit(1))))
    return joined.select("rep", "n_shingles", "sketch", F.explode(top).alias("s")).select(F.col("s.v").alias("v"), F.col("s.n").alias("n"), "rep", "n_shingles", "sketch")


def in_blocks(rows: DataFrame, key: str, node: str, blocks: F.Column) -> DataFrame:
    """Rows dealt to tasks (key, i, j): each row's own block against every block of its key."""
    own = F.pmod(F.xxhash64(node), F.col("_blocks")).cast("int")
    pairs = rows.withColumn("_blocks", blocks.cast("int")).withColumn("_own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1))
    dealt = pairs.withColumn("_other", other)
    return dealt.withColumn("_i", F.least("_own", "_other")).withColumn("_j", F.greatest("_own", "_other")).drop("_blocks", "_own", "_other")


def _union_counts(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """How many of the K smallest values of the union lie in both sketches, for ``one`` against each of ``many``."""
    pad = np.iinfo(_U).max
    both = np.sort(np.concatenate([np.broadcast_to(one, many.shape), many], axis=1), axis=1)
    twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != pad)
    rank = np.arange(1, both.shape[1])[None, :] - np.cumsum(twice, axis=1)  # distinct values before the second copy, and itself
    return (twice & (rank < K)).sum(axis=1)


def _forest(n: int, near) -> Iterator[tuple[int, int]]:
    """A spanning forest of the graph in which ``near(i, free)`` tells the neighbours of i among the free nodes.

    Each node asks only about nodes that no component has yet.
    """
    free, left = np.ones(n, dtype=bool), n
    for root in range(n):
        if not free[root]:
            continue
        free[root], left = False, left - 1
        queue = [root]
        while queue and left:
            hit = near(queue.pop(), free).tolist()
            free[hit], left = False, left - len(hit)
            queue += hit
            for k in hit:
                yield root, k


def _list_edges(n: np.ndarray, sketch: np.ndarray, share: int) -> Iterator[tuple[int, int]]:
    enough = least_shared(share)

    def near(i: int, free: np.ndarray) -> np.ndarray:
        some = np.flatnonzero(free & (100 * np.minimum(n, n[i]) >= share * np.maximum(n, n[i])))
        least = np.minimum(enough, np.ceil(np.minimum(n[some], n[i]) * share / 100))
        return some[_union_counts(sketch[i], sketch[some]) >= least]

    return _forest(len(n), near)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], .., start[0] + size[0] - 1, start[1], .."""
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(size.sum())


def _group_edges(sets: list[np.ndarray], share: int) -> Iterator[tuple[int, int]]:
    """Spanning forest of the links between full shingle sets.

    Linked sets x and y share ``share`` percent of either at least, so each holds a shingle of
    the other's prefix, its ``size - least + 1`` rarest ones, in its own.
    """
    sizes = np.array([len(s) for s in sets])
    starts = np.cumsum(sizes) - sizes
    ids, flat = np.unique(np.concatenate(sets), return_inverse=True)
    rank = np.empty(len(ids), dtype=np.int32)
    rank[np.argsort(np.bincount(flat), kind="stable")] = np.arange(len(ids), dtype=np.int32)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)
    flat = rank[flat]
    flat = flat[np.lexsort((flat, owner))]  # each set from rare to frequent
    prefix = sizes + share * sizes // -100 + 1
    inside = _ranges(starts, prefix)
    by_rank = np.argsort(flat[inside], kind="stable")
    posted, where = flat[inside][by_rank], owner[inside][by_rank]
    flag = np.zeros(len(ids), dtype=bool)

    def near(i: int, free: np.ndarray) -> np.ndarray:
        own = flat[starts[i] : starts[i] + sizes[i]]
        low, high = np.searchsorted(posted, own[: prefix[i]]), np.searchsorted(posted, own[: prefix[i]], side="right")
        some = np.unique(where[_ranges(low, high - low)])
        some = some[free[some] & (100 * np.minimum(sizes[some], sizes[i]) >= share * np.maximum(sizes[some], sizes[i]))]
        if not len(some):
            return some
        flag[own] = True
        common = np.add.reduceat(flag[flat[_ranges(starts[some], sizes[some])]].astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
        flag[own] = False
        return some[100 * common >= share * (sizes[some] + sizes[i] - common)]

    return _forest(len(sets), near)


def _grouped(rows: DataFrame, keys: list[str], edges, columns: list[str]) -> DataFrame:
    """(a, b) edges of each key's rows; a task's rows come sorted by key and one key's rows are held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def done():
            t = pa.Table.from_batches(held)
            pairs = list(edges(t))
            return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

        last = None
        for batch in batches:
            ks = np.array([np.asarray(batch.column(batch.schema.get_field_index(k))) for k in keys])
            cuts = [0, *(np.flatnonzero((ks[:, 1:] != ks[:, :-1]).any(axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if b > a:
                    key = tuple(ks[:, a].tolist())
                    if held and key != last:
                        yield done()
                        held = []
                    last = key
                    held.append(batch.slice(a, b - a))
        if held:
            yield done()
        release_memory()

    return rows.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long")


def candidate_edges(reps: DataFrame, share: int = SHARE) -> DataFrame:
    """Edges (a, b) that join documents whose union sketch passes, a forest for each list."""
    entries = in_blocks(_prefix_entries(reps, share), "v", "rep", F.ceil(F.col("n") / LIST_BLOCK))

    def edges(t: pa.Table) -> Iterator[tuple[int, int]]:
        ids = t.column("rep").to_pylist()
        if len(ids) < 2:
            return
        sk = np.full((len(ids), K), np.iinfo(_U).max, dtype=_U)
        for r, s in enumerate(t.column("sketch").to_pylist()):
            sk[r, : len(s)] = np.array(s, dtype=np.int64).view(_U)
        for a, b in _list_edges(np.array(t.column("n_shingles").to_pylist()), sk, share):
            yield ids[a], ids[b]

    return _grouped(entries, ["v", "_i", "_j"], edges, ["rep", "n_shingles", "sketch"])


def link_edges(docs: DataFrame, groups: DataFrame, share: int = SHARE) -> DataFrame:
    """Edges (a, b) between linked documents of each candidate group (node, component, n_shingles), a forest for each block pair."""
    sizes = groups.groupBy("component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    members = groups.join(sizes, "component")
    # a merge join at any size: members grow with the corpus, so a plan that broadcasts them only holds for small ones
    blocks = F.greatest(F.ceil(F.col("n") / GROUP_BLOCK), F.ceil(F.col("s") / GROUP_SHINGLES))
    texts = picked(docs, "doc_id", "text").withColumnRenamed("doc_id", "node").dropna(subset=["node"])

    def make():
        def run(cols):
            return {"component": cols["component"], "node": cols["node"], "n": cols["n"], "s": cols["s"], "shingles": [shingle_set(t).tobytes() for t in cols["text"]]}

        return run

    full = arrow_map(members.join(texts.hint("merge"), "node").select("component", "node", "n", "s", "text"), make, "component long, node long, n long, s long, shingles binary")

    def edges(t: pa.Table) -> Iterator[tuple[int, int]]:
        ids = t.column("node").to_pylist()
        sets = [np.frombuffer(s, dtype=_U) for s in t.column("shingles").to_pylist()]
        for a, b in _group_edges(sets, share):
            yield ids[a], ids[b]

    return _grouped(in_blocks(full, "component", "node", blocks), ["component", "_i", "_j"], edges, ["node", "shingles"])


def near_duplicates(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for each document row; ``share`` percent of the union links documents."""
    sk = materialize(sketches(docs), "sketches")
    filled = sk.where("fp is not null and doc_id is not null")
    classes = filled.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"))
    reps = materialize(classes, "classes")
    groups = components(candidate_edges(reps.select("rep", "n_shingles", "sketch"), share))
    sized = groups.join(reps.select(F.col("rep").alias("node"), "n_shingles"), "node")
    found = components(link_edges(docs, materialize(sized, "groups"), share).unionByName(_same_id(filled, reps)))
    whole = sk.join(reps.select("fp", "rep"), "fp", "left").join(found.select(F.col("node").alias("rep"), F.col("component").alias("_to")), "rep", "left")
    to = F.when(F.col("doc_id").isNotNull(), F.coalesce("_to", "rep", "doc_id"))
    return whole.select("doc_id", "n_shingles", to.alias("component_id"), F.col("doc_id").eqNullSafe(to).alias("kept"))


def _same_id(filled: DataFrame, reps: DataFrame) -> DataFrame:
    """Edges between the classes of one doc_id that stands for several texts."""
    of = filled.select("doc_id", "fp").join(reps.select("fp", "rep"), "fp").groupBy("doc_id").agg(F.min("rep").alias("a"), F.max("rep").alias("b"))
    return of.where("a <> b").select("a", "b")


def keep_first(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """One document of each component stays, that with the smallest doc_id, with all its columns."""
    gone = near_duplicates(docs, share).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone.hint("merge"), docs["doc_id"] == gone["_gone"], "left_anti")  # as many as the corpus has copies, so never broadcast
