from plumbline.llm import decontaminate as D
from plumbline.llm import queries

from .helpers import EDGES, docs, duck

ITEMS = "item_id long, text string, doc_id long"


def test_oracle_in_one_and_many_blocks(spark, sf):
    want = sorted(duck(sf).execute(queries.OP8_SQL).fetchall())
    pick = lambda df: sorted(tuple(r) for r in df.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect())
    assert pick(queries.op8_decontamination(spark, sf)) == want
    d, b = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    assert pick(D.digest(D.find_contamination(d, b, block_words=400))) == want


def test_edges(spark):
    items = spark.createDataFrame([(1, None, 0), (2, "", 0), (3, "A b-C d e f g h i j k!", 0), (3, "A b-C d e f g h i j k!", 0), (4, "one", 0), (None, "c d e f g h i j k l", 0)], ITEMS)
    got = [(r["doc_id"], r["n_words"], r["n_hit"], r["n_items"]) for r in D.digest(D.find_contamination(docs(spark, EDGES), items)).collect()]
    assert sorted(x for x in got if x[0] in (1, 2, 3)) == [(1, 0, 0, 0), (2, 0, 0, 0), (3, 0, 0, 0)]
    assert got.count((4, 1, 1, 1)) == 2 and (7, 12, 12, 1) in got and (8, 12, 12, 1) in got
    assert len(got) == len(EDGES)
    assert D.find_contamination(docs(spark, []), items).count() == 0
    assert D.digest(D.find_contamination(docs(spark, EDGES), items.limit(0))).where("contaminated").count() == 0
    clean = D.clean(docs(spark, EDGES), items)
    assert clean.columns == docs(spark, []).columns
    assert sorted(str(r["doc_id"]) for r in clean.collect()) == ["1", "2", "3", "5", "6", "None"]
    assert D.clean(docs(spark, EDGES), items.limit(0)).count() == len(EDGES)
    assert sorted(str(r["doc_id"]) for r in D.clean(docs(spark, EDGES), items, block_words=5).collect()) == ["1", "2", "3", "5", "6", "None"]


def test_repeated_and_null_ids_over_many_blocks(spark):
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{k}" for k in range(12)), 0) for i in range(6)], ITEMS)
    texts = [" ".join(f"i{i}w{k}" for k in range(12)) for i in range(6)]
    rows = [(None, texts[0] + " x"), (None, "y " + texts[1]), (None, "nothing at all"), (7, texts[2]), (7, "z " + texts[3] + " " + texts[4]), (7, texts[2])]
    pick = lambda df: sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], r["items_sha256"]) for r in D.digest(df).collect())
    one = pick(D.find_contamination(docs(spark, rows), items))
    assert [r[:3] for r in one] == [("7", 12, 12), ("7", 12, 12), ("7", 25, 24), ("None", 3, 0), ("None", 13, 12), ("None", 13, 12)]
    assert pick(D.find_contamination(docs(spark, rows), items, block_words=13)) == one
