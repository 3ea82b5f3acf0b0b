from collections import Counter

from plumbline.llm import quality_rules as Q
from plumbline.llm import queries

from .helpers import EDGES, docs, duck


def brute(text):
    w = [x for x in __import__("re").split(r"[\x20\x09-\x0D]+", text or "") if x]
    grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    hit = {j for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(hit)


def test_oracle(spark, sf):
    want = duck(sf).execute(queries.OP2_SQL).df()
    got = queries.op2_quality_rules(spark, sf).toPandas()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda d: sorted(map(tuple, d[cols].astype(str).values))
    assert key(got) == key(want)


def test_base_statistics_and_edges(spark):
    rows = [*EDGES, (9, "a b c a b c a b c\nsame\nsame\n\n|#|"), (10, "to be or not to be or not " * 40)]
    got = Q.judge(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    want = Counter((i, *brute(t)) for i, t in rows)
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in got) == want
    assert Q.judge(docs(spark, [])).count() == 0


def test_boilerplate_by_host(spark):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(60))
    rows = [(i, f"Read our  Terms\n{body(i)}", "en", "h") for i in range(30)] + [(100 + i, body(100 + i) + "\nread our terms", "en", "other") for i in range(5)]
    rows += [(200, "\n".join(["read our terms"] * 40), "en", "h"), (300, "a copy " + body(300), None, None)] + [(400 + i, "a copy\n" + body(400), "en", "h") for i in range(30)]
    got = {r["doc_id"]: r for r in Q.judge(docs(spark, rows)).collect()}
    assert all(got[i]["kept"] and got[i]["n_line_words"] == 3 for i in range(30))
    assert all(got[100 + i]["n_line_words"] == 0 for i in range(5))
    assert got[200]["n_line_words"] == 120 and not got[200]["kept"]
    assert all(got[400 + i]["n_line_words"] == 62 and not got[400 + i]["kept"] for i in range(30))  # each copy is a document
    clean = {r["doc_id"]: r["text"] for r in Q.cleaned(docs(spark, rows)).collect()}
    assert clean[0] == body(0) and clean[100].endswith("read our terms") and clean[300] == "a copy " + body(300)
