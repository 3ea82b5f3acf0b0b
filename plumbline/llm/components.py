"""Connected components by alternating large and small stars, with DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import discard, materialize

#: Parts into which the edges of one node are dealt.
SALTS = 32


def _with_least(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b) with m, the smallest b of the edge's a.

    No task takes all edges of a node: they are dealt by (a, salt), and m reaches each of
    these parts by a join that has a row for each part, ``SALTS`` for a node at most.
    """
    dealt = edges.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    parts = dealt.groupBy("a", "_salt").agg(F.min("b").alias("_m"))
    least = parts.groupBy("a").agg(F.min("_m").alias("m"))
    return dealt.join(parts.select("a", "_salt").join(least, "a"), ["a", "_salt"]).select("a", "b", "m")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b): the smallest node that can be reached.

    Each round is written to the shared scratch folder, so lineage stays short, and the one
    before is deleted; the number of rounds grows with the logarithm of the longest path.
    Loops and repeated edges are harmless; without edges the result is empty.
    """
    now = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    mark = _mark(now)
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_least(both).where("b > a").select(F.col("b").alias("a"), F.least("a", "m").alias("b")).distinct()
        small = _with_least(large).select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        last, old, now = mark, now, materialize(small.where("a <> b").distinct(), "edges")
        discard(old)
        mark = _mark(now)
        if mark == last:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.withColumn("component", F.col("node")))


def _mark(edges: DataFrame) -> tuple:
    """Count and order-free hash of the edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
