import zlib

import numpy as np

from plumbline.llm import language_id, quality_model, queries

from .helpers import EDGES, docs

SF = "/root/testdata/sf0.01"


def test_language_accuracy_on_held_out(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    got = queries.op9_language_id(spark, SF).collect()
    assert len(got) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.97 * len(held)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_gradients():
    rng = np.random.default_rng(0)
    net = language_id.Network.new(["a", "b"], rng)
    net.weights = {k: v.astype(np.float64).astype(np.float32) for k, v in net.weights.items()}
    x = rng.integers(1, 255, (4, language_id.WINDOW)).astype(np.uint8)
    y = np.array([0, 1, 0, 1])
    g = net.gradients(x, y)
    loss = lambda: -np.log(net.forward(x)[np.arange(4), y]).mean()
    for key in ("out", "bias", "f3", "b2", "embed"):
        at = np.unravel_index(np.abs(g[key]).argmax(), g[key].shape)
        old = net.weights[key][at]
        net.weights[key][at] = old + 1e-2
        up = loss()
        net.weights[key][at] = old - 1e-2
        down = loss()
        net.weights[key][at] = old
        assert abs((up - down) / 2e-2 - g[key][at]) < 0.05 * abs(g[key][at]) + 2e-3


def test_language_edges(spark):
    rows = [(i, t, "xx" if i and i % 2 else None) for i, t in EDGES] + [(50 + i, "la casa es grande y la mesa", "es") for i in range(8)] + [(80 + i, "the house is big and the table", "en") for i in range(8)]
    df = docs(spark, rows)
    got = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict(df, language_id.fit(df)).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0)
    empty = docs(spark, [])
    net = language_id.fit(empty)
    assert language_id.predict(empty, net).count() == 0
    assert {r["lang_pred"] for r in language_id.predict(df, net).collect()} == {"und"}
    kept = language_id.keep_known(df, language_id.fit(df))
    assert kept.columns == df.columns and not {1, 2, 3} & {r["doc_id"] for r in kept.collect()}


def test_quality_accuracy_on_held_out(spark):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = queries.op7_quality_model(spark, SF).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(r["predicted"] == (r["score"] >= 0.3) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    assert sum(r["predicted"] == labels[r["doc_id"]] for r in held) >= 0.9 * len(held)


def test_quality_edges(spark):
    df = docs(spark, EDGES)
    labels = spark.createDataFrame([(1, 1, 0, "x"), (2, 0, None, "x"), (2, 0, 1, "x"), (None, 1, 0, "x"), (7, None, 0, "x"), (8, 1, 0, "x")], "doc_id long, quality int, toxic int, text string")
    got = quality_model.score(df, quality_model.fit(df, labels)).collect()
    assert len(got) == len(EDGES) and all(0 <= r["score"] <= 1 for r in got)
    none = quality_model.fit(df, labels.limit(0))
    assert {r["score"] for r in quality_model.score(df, none).collect()} == {0.5}
    assert quality_model.score(docs(spark, []), none).count() == 0


def test_pairs_are_learned():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality_model.fit_tables(x, y, rounds=40)
    assert ((model.score(x) > 0.5) == y).mean() > 0.95


def test_numerals_are_no_letters(spark):
    texts = ["²", "½", "①", "Ⅷ", "12 ٣", "_ - !", "ª", "中", "ß", "1a"]
    assert [language_id.has_letter(t) for t in texts] == [False] * 6 + [True] * 4
    net = language_id.Network.new(["a", "b"], np.random.default_rng(0))
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(docs(spark, list(enumerate(texts))), net).collect()}
    assert [got[i] == "und" for i in range(len(texts))] == [True] * 6 + [False] * 4


def test_network_against_plain_loops():
    net = language_id.Network.new(["a", "b", "c"], np.random.default_rng(3))
    texts = ["short é text", "x" * 300 + " the end", "中文 and more " * 60, None, "12"]
    for text, got in zip(texts, language_id.probabilities(net, texts)):
        if not text or not any(c.isalpha() for c in text):
            assert got is None
            continue
        data, w, total, size = text.encode(), net.weights, 0, 0
        for at in range(0, len(data), language_id.WINDOW):
            window = data[at : at + language_id.WINDOW].ljust(language_id.WINDOW, b"\0")
            pooled = []
            for n in language_id.WIDTHS:
                for f in range(language_id.FILTERS):
                    filt = w[f"f{n}"][:, f]
                    best = max(float(np.dot(np.concatenate([w["embed"][b] for b in window[i : i + n]]), filt)) for i in range(language_id.WINDOW - n + 1))
                    pooled.append(max(0.0, best + float(w[f"b{n}"][f])))
            z = np.exp(np.array(pooled) @ w["out"].astype(float) + w["bias"])
            here = len(data[at : at + language_id.WINDOW])
            total, size = total + here * z / z.sum(), size + here
        assert np.allclose(got, total / size, atol=1e-4)


def test_score_is_a_sum_of_tables(spark):
    rng = np.random.default_rng(2)
    texts = [" ".join(rng.choice(["the", "house", "a", "is", "#", "1", "dog.", "\n"], rng.integers(1, 60))) for _ in range(300)]
    x = np.array([quality_model.features_of(t) for t in texts])
    model = quality_model.fit_tables(x, (x[:, 0] > np.median(x[:, 0])).astype(float), rounds=8)
    got = {r["doc_id"]: r["score"] for r in quality_model.score(docs(spark, list(enumerate(texts[:40]))), model).collect()}
    for i in range(40):
        place = [sum(1 for e in edges if e <= v) for edges, v in zip(model.edges, x[i])]
        total = model.bias + sum(t[p] for t, p in zip(model.tables, place))
        total += sum(t[model.coarse[f][place[f]], model.coarse[k][place[k]]] for (f, k), t in zip(model.pairs, model.pair_tables))
        assert abs(got[i] - 1 / (1 + np.exp(-total))) < 1e-9
