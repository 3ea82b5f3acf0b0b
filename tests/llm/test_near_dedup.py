import random

from plumbline.llm import near_dedup as D
from plumbline.llm import queries
from plumbline.llm.components import components

from .helpers import EDGES, docs, duck


def brute(rows, share=85):
    def shingles(t):
        w = (t or "").encode().lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets = {i: shingles(t) for i, t in rows}
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= share * len(sets[a] | sets[b]):
                p, q = sorted((find(a), find(b)))
                up[q] = p
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_oracle(spark, sf):
    want = {r[0]: r[1:] for r in duck(sf).execute(queries.OP4_SQL).fetchall()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in queries.op4_near_dedup(spark, sf).collect()}
    assert got == want


def test_chains_hot_passages_and_blocks(spark, monkeypatch):
    rnd = random.Random(11)
    vocab = [f"w{i}" for i in range(400)]
    base = [rnd.choice(vocab) for _ in range(120)]
    rows, text = [], list(base)
    for i in range(60):  # a chain: each is near the next, the ends are far apart
        rows.append((1000 - i, " ".join(text)))
        text[rnd.randrange(len(text))] = f"n{i}"
    for i in range(80):  # one long passage in otherwise different documents
        rows.append((2000 + i, " ".join(base + [rnd.choice(vocab) for _ in range(80)])))
    rows += [(3000 + i, " ".join(rnd.choice(vocab) for _ in range(rnd.randint(1, 9)))) for i in range(60)] + [(4000, rows[0][1]), (4001, rows[0][1].upper())]
    monkeypatch.setattr(D, "LIST_BLOCK", 7)
    monkeypatch.setattr(D, "GROUP_BLOCK", 9)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in D.near_duplicates(docs(spark, rows)).collect()}
    assert got == brute(rows)


def test_edges(spark):
    rows = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in D.near_duplicates(docs(spark, EDGES)).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (7, 8, 7, True), (8, 8, 7, False)} <= rows
    assert (None, 1, None, True) in rows
    assert D.near_duplicates(docs(spark, EDGES)).count() == len(EDGES)
    assert D.near_duplicates(docs(spark, [])).count() == 0
    kept = D.keep_first(docs(spark, EDGES))
    assert kept.columns == docs(spark, []).columns and kept.count() == len(EDGES) - 1


def test_components(spark):
    edges = [(i, i + 1) for i in range(200)] + [(500, 400), (400, 450), (7, 7)]
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 400: 400, 450: 400, 500: 400}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_share_is_a_parameter(spark):
    words = [f"w{i}" for i in range(100)]
    edited = [w if i not in (30, 60) else f"n{i}" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(edited))]  # 86 of 106 shingles, 0.81
    assert (D.least_shared(80), D.least_shared(85)) == (10, 12)
    for share, kept in ((80, {1}), (85, {1, 2})):
        assert {r["doc_id"] for r in D.keep_first(docs(spark, rows), share).collect()} == kept
    assert D.keep_first(docs(spark, rows)).count() == 1
