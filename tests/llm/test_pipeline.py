import corpus_pipeline as C

from plumbline.llm import decontaminate, language_id, pii

from .helpers import EDGES, docs
from .test_near_dedup import brute as near_brute

SF = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    source = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r for r in source.collect()}
    net = language_id.fit(source)
    known = {i for i, r in rows.items() if (p := language_id.best_of(net, [r["text"]]))[0][0] != "und" and p[1][0] >= 0.35}
    parts = near_brute([(i, rows[i]["text"]) for i in known], 80)
    single = {i for i in known if parts[i][1] == i}
    items = [decontaminate.words_of(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    windows = {tuple(w[k : k + 10]) for w in items if w for k in range(max(1, len(w) - 9))}
    sizes = {len(w) for w in windows}

    def leaks(t):
        w = decontaminate.words_of(t)
        return any(tuple(w[k : k + n]) in windows for n in sizes for k in range(len(w) - n + 1))

    clean = {i for i in single if not leaks(rows[i]["text"])}
    out = source
    kept = []
    for name, stage in C.STAGES[:-1]:
        out = C.materialize(stage(spark, out, SF), name)
        assert out.columns == source.columns
        kept.append({r["doc_id"] for r in out.select("doc_id").collect()})
    assert kept == [known, single, clean, clean]
    final = {r["doc_id"]: r["text"] for r in out.collect()}
    assert all(("[" in t) or t == rows[i]["text"] for i, t in final.items())
    assert pii.find(out).where("n_email + n_ip + n_card + n_phone > 0").count() == 0
    ids = C.STAGES[-1][1](spark, out, SF).collect()
    assert {r["doc_id"] for r in ids} == clean and all(len(r["ids"]) == 4 * r["n_tokens"] for r in ids)
    assert len(C.STAGES) == 5 and C.run(spark, SF).count() == len(clean)


def test_stages_on_edges(spark):
    for rows in ([], EDGES):
        out = docs(spark, rows)
        for name, stage in C.STAGES:
            out = C.materialize(stage(spark, out, SF), name)
        assert out.count() <= len(rows)
