"""Multivariate anomaly detection: isolation forest and local outlier factor, with per-feature contributions."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.functions import numbers as N
from plumbline.operators.profile import numeric_columns
from plumbline.operators.quantiles import quantile_row
from plumbline.runtime import materialize, sample_by_hash, ship

EULER = 0.5772156649015329
#: Rows in one broadcast block of the local outlier factor.
LOF_BLOCK = 20_000


def path_norm(n: float) -> float:
    """Mean path length of unsuccessful searches in a tree of n values."""
    return 0.0 if n <= 1 else 1.0 if n == 2 else 2 * (math.log(n - 1) + EULER) - 2 * (n - 1) / n


@dataclass
class Forest:
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]  # feature (-1: leaf), cut, left child (right is next), depth with what a leaf still hides
    size: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """-2 ** (-mean path / norm): the lower, the more anomalous."""
        total = np.zeros(len(x))
        for feature, cut, left, depth in self.trees:
            at = np.zeros(len(x), dtype=np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                rows = np.flatnonzero(inner)
                k = at[rows]
                at[rows] = left[k] + (x[rows, feature[k]] >= cut[k])
            total += depth[at]
        return -(2.0 ** (-total / len(self.trees) / max(path_norm(self.size), 1e-12)))


def grow(sample: np.ndarray, n_trees: int = 100, size: int = 256, seed: int = 42) -> Forest:
    """Trees on random subsamples of a bounded sample."""
    rng = np.random.default_rng(seed)
    size = min(size, len(sample))
    limit = math.ceil(math.log2(max(2, size)))
    trees = []
    for _ in range(n_trees):
        rows = sample[rng.choice(len(sample), size, replace=False)]
        feature, cut, left, depth = [], [], [], []

        def node() -> int:
            for v, d in ((feature, -1), (cut, 0.0), (left, 0), (depth, 0.0)):
                v.append(d)
            return len(feature) - 1

        work = [(node(), rows, 0)]
        while work:
            at, part, level = work.pop()
            lo, hi = part.min(axis=0), part.max(axis=0)
            open_ = np.flatnonzero(hi > lo)
            if level >= limit or len(part) <= 1 or not len(open_):
                depth[at] = level + path_norm(len(part))
                continue
            f = int(rng.choice(open_))
            c = float(rng.uniform(lo[f], hi[f]))
            right = part[:, f] >= c
            feature[at], cut[at] = f, c
            a, b = node(), node()
            left[at] = a
            work += [(a, part[~right], level + 1), (b, part[right], level + 1)]
        trees.append((np.array(feature), np.array(cut), np.array(left), np.array(depth)))
    return Forest(trees, size)


def prepared(df: DataFrame, columns: list[str] | None = None) -> tuple[DataFrame, list[str], np.ndarray, np.ndarray]:
    """``df`` with ``_f0..``: median-filled, robustly scaled numeric columns; and the medians and spreads."""
    cols = columns or numeric_columns(df)
    if len(cols) < 2:
        raise ValueError("at least two numeric columns are needed")
    xs = [N.clean(F.col(f"`{c}`").cast("double")) for c in cols]
    row = quantile_row(df, xs, [0.25, 0.5, 0.75]).first()
    q = np.array([r if r is not None else [0.0, 0.0, 1.0] for r in row], dtype=float)
    spread = np.where(q[:, 2] > q[:, 0], q[:, 2] - q[:, 0], 1.0)
    feats = [((F.coalesce(x, F.lit(float(m))) - float(m)) / float(s)).alias(f"_f{i}") for i, (x, m, s) in enumerate(zip(xs, q[:, 1], spread))]
    return df.select("*", *feats), cols, q[:, 1], spread


def isolation_forest(df: DataFrame, columns: list[str] | None = None, contamination: float = 0.05, n_trees: int = 100, seed: int = 42, sample: int = 20_000, contributions: bool = True) -> DataFrame:
    """``df`` with _score, _is_anomaly and _contributions (by ablation: each feature set to its median).

    Trees grow on a bounded sample (by hash of the features) on the driver; the forest is
    broadcast and all rows are scored in Arrow batches. The cut is the exact
    ``contamination`` percentile of the scores.
    """
    ship(df.sparkSession)
    x, cols, _, _ = prepared(df, columns)
    names = [f"_f{i}" for i in range(len(cols))]
    pool = sample_by_hash(x.select(*names), names, sample, seed).collect()  # bounded by `sample`
    if not pool:
        return df.select("*", F.lit(None).cast("double").alias("_score"), F.lit(False).alias("_is_anomaly"), F.lit(None).cast("map<string,double>").alias("_contributions"))
    forest = df.sparkSession.sparkContext.broadcast(grow(np.array(pool, dtype=float), n_trees, seed=seed))

    @F.pandas_udf("double")
    def score(*f: pd.Series) -> pd.Series:
        return pd.Series(forest.value.score(np.stack([s.to_numpy() for s in f], axis=1)))

    scored = materialize(x.withColumn("_score", score(*names)), "forest")
    cut = quantile_row(scored, [F.col("_score")], [contamination]).select(F.get("q0", F.lit(0)).alias("_cut"))
    out = scored.crossJoin(F.broadcast(cut)).withColumn("_is_anomaly", F.col("_score") < F.col("_cut")).drop("_cut")

    @F.pandas_udf("array<double>")
    def ablate(base: pd.Series, flag: pd.Series, *f: pd.Series) -> pd.Series:
        data = np.stack([s.to_numpy() for s in f], axis=1)
        rows = np.flatnonzero(flag.to_numpy())
        result: list = [None] * len(data)
        if len(rows):
            delta = np.empty((len(rows), data.shape[1]))
            for k in range(data.shape[1]):
                other = data[rows].copy()
                other[:, k] = 0
                delta[:, k] = forest.value.score(other) - base.to_numpy()[rows]
            top = np.abs(delta).max(axis=1, keepdims=True)
            delta = np.divide(delta, top, out=np.zeros_like(delta), where=top > 0)
            for r, d in zip(rows, delta):
                result[r] = d.tolist()
        return pd.Series(result)

    if contributions:
        parts = ablate("_score", "_is_anomaly", *names)
        out = out.withColumn("_contributions", F.when(F.col("_is_anomaly"), F.map_from_arrays(F.array(*[F.lit(c) for c in cols]), parts)))
    return out.drop(*names)


def local_outlier_factor(df: DataFrame, rid: str, columns: list[str] | None = None, contamination: float = 0.05, k: int | None = None, block: int = LOF_BLOCK) -> DataFrame:
    """(rid, _lof, _is_anomaly), exact at any size; the work is quadratic in rows.

    Rows are broadcast in blocks of ``block``; every row's ``k`` nearest of each block (ties by
    rid) are merged, and densities follow by joins on the neighbour lists.
    """
    spark = df.sparkSession
    ship(spark)
    x, cols, _, _ = prepared(df, columns)
    names = [f"_f{i}" for i in range(len(cols))]
    feats = materialize(x.select(F.col(f"`{rid}`").alias("r"), *names), "lof")
    n = feats.count()
    k = k or min(20, n // 5 or 5)
    k = max(1, min(k, n - 1))
    parts = []
    for rows in _blocks(feats, block):
        shared = spark.sparkContext.broadcast((np.array([r[0] for r in rows]), np.array([r[1:] for r in rows], dtype=float).reshape(len(rows), len(names))))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            ids, data = shared.value
            for pdf in batches:
                for at in range(0, len(pdf), 256):
                    part = pdf.iloc[at : at + 256]
                    own = part[names].to_numpy(dtype=float)
                    dist = np.sqrt(np.maximum((own**2).sum(1)[:, None] + (data**2).sum(1)[None] - 2 * own @ data.T, 0))
                    dist[part["r"].to_numpy()[:, None] == ids[None]] = np.inf
                    most = np.partition(dist, min(k, len(ids)) - 1, axis=1)[:, min(k, len(ids)) - 1]
                    row, col = np.nonzero((dist <= most[:, None]) & np.isfinite(dist))
                    order = np.lexsort((ids[col], dist[row, col], row))
                    row, col = row[order], col[order]
                    best = np.arange(len(row)) - np.searchsorted(row, row) < k
                    row, col = row[best], col[best]
                    yield pd.DataFrame({"r": part["r"].to_numpy()[row], "o": ids[col], "d": dist[row, col]})

        parts.append(materialize(feats.mapInPandas(run, "r long, o long, d double"), "lof"))
    near = parts[0] if parts else spark.createDataFrame([], "r long, o long, d double")
    for more in parts[1:]:
        near = near.unionByName(more)
    if len(parts) > 1:
        best = near.groupBy("r").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "o"))), 1, k).alias("s"))  # k rows of each block
        near = materialize(best.select("r", F.explode("s").alias("s")).select("r", "s.o", "s.d"), "lof")
    kd = near.groupBy("r").agg(F.max("d").alias("kd"))
    reach = near.join(kd.withColumnRenamed("r", "o"), "o").select("r", "o", F.greatest("d", "kd").alias("reach"))
    lrd = reach.groupBy("r").agg((1 / (F.avg("reach") + 1e-10)).alias("lrd"))
    both = near.join(lrd.select(F.col("r").alias("o"), F.col("lrd").alias("lo")), "o").groupBy("r").agg(F.avg("lo").alias("mean")).join(lrd, "r")
    lof = materialize(both.select(F.col("r").alias(rid), (F.col("mean") / F.col("lrd")).alias("_lof")), "lof")
    cut = quantile_row(lof, [F.col("_lof")], [1 - contamination]).select(F.get("q0", F.lit(0)).alias("_cut"))
    return lof.crossJoin(F.broadcast(cut)).withColumn("_is_anomaly", F.col("_lof") > F.col("_cut")).drop("_cut")


def _blocks(rows: DataFrame, size: int) -> Iterator[list]:
    held = []
    for r in rows.toLocalIterator():  # one partition at a time, one block held
        held.append(r)
        if len(held) == size:
            yield held
            held = []
    if held:
        yield held


def choose(algorithm: str, n: int, d: int) -> list[str]:
    """The detectors that run: an explicit one, or by size; two are joined by AND."""
    if algorithm in ("isolation_forest", "lof"):
        return [algorithm]
    return ["isolation_forest"] if d > 15 else ["lof"] if n < 500 else ["isolation_forest", "lof"]


def detect(df: DataFrame, rid: str, columns: list[str] | None = None, algorithm: str = "ensemble", contamination: float = 0.05, seed: int = 42) -> DataFrame:
    """(rid, _score, _lof, _is_anomaly, _contributions)."""
    cols = columns or [c for c in numeric_columns(df) if c != rid]
    use = choose(algorithm, df.count(), len(cols))
    out = df.select(F.col(f"`{rid}`"))
    flag = F.lit(True)
    if "isolation_forest" in use:
        f = isolation_forest(df, cols, contamination, seed=seed).select(F.col(f"`{rid}`"), "_score", F.col("_is_anomaly").alias("_if"), "_contributions")
        out, flag = out.join(f, rid), flag & F.col("_if")
    if "lof" in use:
        g = local_outlier_factor(df, rid, cols, contamination).select(F.col(f"`{rid}`"), "_lof", F.col("_is_anomaly").alias("_lo"))
        out, flag = out.join(g, rid), flag & F.col("_lo")
    for c, t in (("_score", "double"), ("_lof", "double"), ("_contributions", "map<string,double>")):
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(t))
    return out.select(F.col(f"`{rid}`"), "_score", "_lof", flag.alias("_is_anomaly"), "_contributions")


def importance(detected: DataFrame) -> DataFrame:
    """(feature, importance): mean contribution over all anomalies, unexplained ones as zero."""
    n = detected.where("_is_anomaly").agg(F.count("*").alias("n"))
    parts = detected.where("_is_anomaly").select(F.explode("_contributions").alias("feature", "v")).groupBy("feature").agg(F.sum("v").alias("s"))
    return parts.crossJoin(F.broadcast(n)).select("feature", (F.col("s") / F.greatest("n", F.lit(1))).alias("importance"))


def top_features(contributions, k: int = 3):
    """The k features that contribute most, as a Column of (feature, value)."""
    entries = F.transform(F.map_entries(contributions), lambda e: F.struct((-e["value"]).alias("o"), e["key"].alias("feature")))
    return F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: F.struct(e["feature"], (-e["o"]).alias("value")))


def explain(row: dict, zscores: dict[str, float]) -> str:
    """One anomaly in words, from its detected row and the z-scores of its features."""
    score = row.get("_score") or 0.0
    severity = "high" if score < -0.15 else "medium" if score < -0.05 else "low"
    parts = [f"{f} is {abs(z):.1f} deviations {'above' if z > 0 else 'below'} the mean" for f, z in sorted(zscores.items(), key=lambda p: -abs(p[1])) if abs(z) > 3]
    signs = [z for z in zscores.values() if abs(z) > 1]
    if any(z > 0 for z in signs) and any(z < 0 for z in signs):
        parts.append("features move in opposite directions")
    if (row.get("_lof") or 0) > 2:
        parts.append("its neighbourhood is far denser")
    return f"{severity} severity: " + ("; ".join(parts) or "an unusual combination of ordinary values")
