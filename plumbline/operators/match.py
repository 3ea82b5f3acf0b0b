"""Fuzzy best-match join.

Values are made distinct first, so a pair of values is scored once however many rows
have it. Secondary values are held in bounded blocks: each block is broadcast (a fixed
number of values), scored against all primary values in Arrow batches, and only the
best match of each primary value leaves a task; the best over the blocks is one small
aggregation. Safe upper bounds (lengths, common characters) skip most kernels without
changing the result. ``blocking`` instead compares only values with a common prefix.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.functions.text import match_key, token_sort
from plumbline.runtime import materialize, ship

#: Secondary values in one broadcast block.
BLOCK = 20_000


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 * LCS / (len + len), with the bit-parallel LCS."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & masks.get(c, 0)
        s = (s + u | s - u) & full
    return 200.0 * (len(a) - s.bit_count()) / (len(a) + len(b))


def _jaro_share(a: str, b: str, variant: str) -> float:
    """Jaro similarity from 0 to 1."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    window = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - window), min(len(b), i + window + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    m = len(left)
    moved = sum(p != q for p, q in zip(left, (c for c, t in zip(b, taken) if t)))
    t = moved // 2 if variant == "standard" else moved / 2
    return (m / len(a) + m / len(b) + (m - t) / m) / 3


def jaro(a: str, b: str, variant: str = "standard") -> float:
    """Jaro similarity in percent. ``standard`` halves transpositions down, ``reference`` keeps the fraction."""
    return _jaro_share(a, b, variant) * 100


def jaro_winkler(a: str, b: str, variant: str = "standard") -> float:
    """Jaro with a bonus for up to four leading characters; ``standard`` gives it above 70 only, ``reference`` always.

    The best match is the largest of these floats, so ``standard`` has DuckDB's to the last bit: the bound of 0.7 and
    the bonus go by shares, not percents, and the bonus is rounded once. Near 70 and in ties, other roundings choose other rows.
    """
    share = _jaro_share(a, b, variant)
    if variant == "standard" and share <= 0.7:
        return share * 100
    n = 0
    while n < min(4, len(a), len(b)) and a[n] == b[n]:
        n += 1
    if variant == "standard":
        return math.fma(n * 0.1, 1 - share, share) * 100
    return share * 100 + n * 0.1 * (100 - share * 100)


def _bound(name: str, a: str, b: str, ca: Counter, cb: Counter) -> float:
    """Never below the kernel's score."""
    la, lb = len(a), len(b)
    common = sum(min(n, cb[c]) for c, n in ca.items() if c in cb)
    if name in ("levenshtein", "token_sort"):
        return 200.0 * common / max(1, la + lb)
    if not common:
        return 100.0 if a == b else 0.0
    j = (common / la + common / lb + 1) / 3 * 100
    return j if name == "jaro" else j + 0.4 * (100 - j)


KERNELS = {"levenshtein": lambda a, b, v: indel_ratio(a, b), "token_sort": lambda a, b, v: indel_ratio(a, b), "jaro": jaro, "jaro_winkler": jaro_winkler}


def _keyed(df: DataFrame, rid: str, column: str, algorithm: str, preprocess) -> DataFrame:
    key = preprocess(F.col(f"`{column}`"))
    if algorithm == "token_sort":
        key = token_sort(key)
    return df.select(F.col(f"`{rid}`").alias("rid"), key.alias("key")).where("key <> ''")


def _blocks(values: DataFrame, size: int) -> Iterator[list[tuple[str, int]]]:
    held = []
    for r in values.toLocalIterator():
        held.append((r["key"], r["rid"]))
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def best_matches(primary: DataFrame, secondary: DataFrame, column: str, other: str | None = None, rid: str = "_rid", algorithm: str = "jaro_winkler", threshold: float = 80.0, review_zone: float = 10.0, variant: str = "standard", preprocess=match_key, blocking: int = 0, block: int = BLOCK) -> DataFrame:
    """(rid_p, rid_s, score, status): the best secondary row of each primary row at ``threshold - review_zone`` or more.

    Ties go to the smallest secondary rid; a secondary row may serve several. Null and
    empty values never match. ``blocking`` above 0 compares only values that share so many leading characters.
    """
    if algorithm not in KERNELS:
        raise ValueError(f"unknown algorithm {algorithm}")
    spark = primary.sparkSession
    ship(spark)
    cutoff = max(0.0, threshold - review_zone)
    p = _keyed(primary, rid, column, algorithm, preprocess)
    s = _keyed(secondary, rid, other or column, algorithm, preprocess).groupBy("key").agg(F.min("rid").alias("rid"))
    keys = p.select("key").distinct()
    parts = []
    for values in _blocks(s, block):
        shared = spark.sparkContext.broadcast(values)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            kernel = KERNELS[algorithm]
            known = {k: r for k, r in shared.value}
            pool: dict[str, list] = {}
            for k, r in shared.value:
                pool.setdefault(k[:blocking], []).append((k, r, Counter(k)))
            for batch in batches:
                out: list[tuple[str, int, float]] = []
                for a in batch.column(0).to_pylist():
                    best, at = -1.0, None
                    if a in known:
                        best, at = 100.0, known[a]
                    else:
                        ca = Counter(a)
                        for b, r, cb in pool.get(a[:blocking], ()):
                            if _bound(algorithm, a, b, ca, cb) < max(best, cutoff) - 1e-9:
                                continue
                            v = kernel(a, b, variant)
                            if v > best or v == best and r < at:
                                best, at = v, r
                    if at is not None and best >= cutoff:
                        out.append((a, at, best))
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.float64())], ["key", "rid_s", "score"])

        found = keys.mapInArrow(run, "key string, rid_s long, score double")
        parts.append(found if not parts else materialize(found, "match"))
    if not parts:
        return spark.createDataFrame([], "rid_p long, rid_s long, score double, status string")
    every = parts[0]
    for x in parts[1:]:
        every = every.unionByName(x)
    if len(parts) > 1:
        every = every.groupBy("key").agg(F.max(F.struct("score", (-F.col("rid_s")).alias("r"))).alias("b")).select("key", (-F.col("b.r")).alias("rid_s"), F.col("b.score").alias("score"))
    status = F.when(F.col("score") >= threshold, "matched").otherwise("review")
    return p.join(every, "key").select(F.col("rid").alias("rid_p"), "rid_s", F.round("score", 2).alias("score"), status.alias("status"))


def merge(primary: DataFrame, secondary: DataFrame, matches: DataFrame, rid: str = "_rid", suffixes: tuple[str, str] = ("_p", "_s")) -> DataFrame:
    """Matched rows side by side; only clashing names get a suffix."""
    clash = set(primary.columns) & set(secondary.columns)
    name = lambda c, end: c + end if c in clash else c
    p = primary.select(F.col(f"`{rid}`").alias("_join_p"), *[F.col(f"`{c}`").alias(name(c, suffixes[0])) for c in primary.columns])
    s = secondary.select(F.col(f"`{rid}`").alias("_join_s"), *[F.col(f"`{c}`").alias(name(c, suffixes[1])) for c in secondary.columns])
    m = matches.select(F.col("rid_p").alias("_join_p"), F.col("rid_s").alias("_join_s"), F.col("score").alias("_match_score"), F.col("status").alias("_match_status"))
    return m.join(p, "_join_p").join(s, "_join_s").drop("_join_p", "_join_s")


def unmatched(rows: DataFrame, matches: DataFrame, side: str, rid: str = "_rid") -> DataFrame:
    """Rows of the primary ('p') or secondary ('s') side without a match."""
    return rows.join(matches.select(F.col(f"rid_{side}").alias("_m")).distinct(), F.col(f"`{rid}`") == F.col("_m"), "left_anti")


def match_rate(primary: DataFrame, matches: DataFrame) -> DataFrame:
    """(n_primary, n_matched, n_review, match_rate_pct)."""
    n = primary.agg(F.count("*").alias("n_primary"))
    m = matches.agg(F.count_if(F.col("status") == "matched").alias("n_matched"), F.count_if(F.col("status") == "review").alias("n_review"))
    return n.crossJoin(F.broadcast(m)).withColumn("match_rate_pct", F.round(100 * (F.col("n_matched") + F.col("n_review")) / F.greatest("n_primary", F.lit(1)), 2))


def prefilter(a: Column, b: Column, cutoff: float) -> Column:
    """Native condition that no pair above the cutoff of the Indel ratio fails."""
    most = ((1 - cutoff / 100) * (F.length(a) + F.length(b))).cast("int")
    return F.expr("true") if cutoff <= 0 else F.levenshtein(a, b) <= most
