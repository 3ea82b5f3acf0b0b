"""Documents that hold every edge case, and DuckDB views."""

import os

import duckdb

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _row long, s string, rep long, component long, dest int"


def docs(spark, rows):
    """Rows of (doc_id, text[, lang, source]) with extra columns whose names clash with working names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "a", len(r[1] or ""), 7, "x", 8, 9, 1) for r in rows]
    return spark.createDataFrame(full, DOCS)


EDGES = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (None, "no id here at all"), (5, "x" * 5000), (6, "é中😀 " * 400), (7, "a b c d e f g h i j k l"), (8, "a b c d e f g h i j k l")]


def duck(sf):
    c = duckdb.connect()
    for f in os.listdir(sf):
        c.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    return c
