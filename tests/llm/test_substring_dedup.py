import hashlib
import random

import numpy as np
import pytest

from plumbline.llm import queries
from plumbline.llm import substring_dedup as S

from .helpers import EDGES, docs


def brute(rows):
    """Places are (doc_id, start); a window is cut if an equal one has a smaller place. Null ids come last."""
    key = lambda r: 2**63 - 1 if r[0] is None else r[0]
    first = {}
    for r in rows:
        b = (r[1] or "").encode()
        for i in range(len(b) - 99):
            w = hashlib.md5(b[i : i + 100]).digest()
            first[w] = min(first.get(w, (2**64, 0)), (key(r), i))
    out = []
    for r in rows:
        b = (r[1] or "").encode()
        m = bytearray(len(b))
        for i in range(len(b) - 99):
            if first[hashlib.md5(b[i : i + 100]).digest()] < (key(r), i):
                m[i : i + 100] = b"\1" * 100
        runs = sum(1 for i in range(len(m)) if m[i] and (i == 0 or not m[i - 1]))
        out.append((key(r), len(b), sum(m), runs, hashlib.sha256(bytes(x for x, y in zip(b, m) if not y)).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((2**63 - 1 if r["doc_id"] is None else r["doc_id"], *r[1:]) for r in df.collect())


def test_all_documents(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert rows_of(queries.op6_substring_dedup(spark, sf)) == brute(rows)


@pytest.mark.parametrize(("hot_local", "hot", "bits"), [(S.HOT_LOCAL, S.HOT, 64), (1, 1, 64), (5, 2, 64), (S.HOT_LOCAL, S.HOT, 3), (2, 3, 5)])
def test_random_repeats(spark, hot_local, hot, bits):
    rnd = random.Random(5)
    frag = ["".join(rnd.choice("abcdé ") for _ in range(rnd.randint(50, 260))) for _ in range(12)]
    text = lambda: "".join(rnd.choice(frag)[rnd.randint(0, 40) :] for _ in range(rnd.randint(0, 5)))
    rows = [(i * 3, text()) for i in range(200)] + [(1, "a" * 5000), (2, "ab" * 3000), (4, "a" * 250), (5, None), (7, "")]
    rows += [(None, text()) for _ in range(20)] + [(33, text()) for _ in range(5)] + [rows[20], rows[20]]
    assert rows_of(S.digest(docs(spark, rows), hot_local=hot_local, hot=hot, hash_bits=bits)) == brute(rows)


def test_edges(spark):
    assert rows_of(S.digest(docs(spark, EDGES))) == brute(EDGES)
    assert S.digest(docs(spark, [])).count() == 0
    got = S.digest(docs(spark, [(None, "z" * 300), (1, "z" * 99), (2, "z" * 99)])).collect()
    assert sorted(r["n_removed"] for r in got) == [0, 0, 299]


def test_colliding_hashes_of_the_sort(monkeypatch):
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 600).astype(np.uint8)
    start, size, group = rng.integers(0, 500, 80), np.full(80, 60), np.zeros(80, dtype=np.int64)
    want = S.classes_of(data, start, size, group)
    real, used = S.Poly.spans, []

    def weak(self, prefix, a, b):
        used.append(self.seed)
        return real(self, prefix, a, b) & np.uint64(7 if self.seed < 6 else 2**64 - 1)

    monkeypatch.setattr(S.Poly, "spans", weak)
    got = S.classes_of(data, start, size, group)
    assert max(used) == 6 and (got[1] == want[1]).all() and (start[got[0]] == start[want[0]]).all()


def test_suffix_sort():
    rng = np.random.default_rng(1)
    data = rng.integers(97, 99, 400).astype(np.uint8)
    start = rng.integers(0, 380, 150)
    size = np.minimum(rng.integers(0, 60, 150), 400 - start)
    group = np.sort(rng.integers(0, 6, 150))
    order, near = S.classes_of(data, start, size, group)
    texts = [(group[i], data[start[i] : start[i] + size[i]].tobytes()) for i in order]
    assert texts == sorted(texts)
    for k in range(1, 150):
        if group[order[k]] == group[order[k - 1]]:
            a, b = texts[k - 1][1], texts[k][1]
            assert near[k] == next((i for i in range(min(len(a), len(b))) if a[i] != b[i]), min(len(a), len(b)))
