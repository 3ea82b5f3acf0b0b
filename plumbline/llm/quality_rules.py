"""Quality rules: base word statistics and cross-document line frequency, with DataFrame functions only.

Lines are normalised (A-Z to lower case, white space folded and trimmed) and hashed. For
each host (``source``), the documents that hold a line are counted, each once however often it
has the line; every row is a document, copies too. A line above its host's
limit, ``max(min_docs, max_share * documents of the host)``, is boilerplate and is removed
from all documents of that host. A document that keeps less than ``min_left`` of its words
is depleted and rejected, as is one that fails the base rules.

A null or empty text has no words and fails the base rules. A null source is the host ''.
Repeated rows each give a row; so do rows with equal or null doc_ids, as rows are told
apart by a number of their own. Work inside a text is n log n in its words at most. Extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import let, materialize, picked

# The white space, the symbols and the limits of the contract.
SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

MIN_DOCS, MAX_SHARE, MIN_LEFT = 10, 0.05, 0.5
#: Parts into which a frequent line's rows are dealt in the join.
SALTS = 16


def words_of(text: Column) -> Column:
    """Words of a text; an empty array for null."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")


def n_symbols(text: Column) -> Column:
    """Symbols are single bytes, so what a replacement by nothing takes away counts them."""
    total = F.lit(0)
    for c in SYMBOLS:
        total = total + F.octet_length(text) - F.octet_length(F.replace(text, F.lit(c), F.lit("")))
    return total


def n_repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more; ``words`` must be a plain column.

    Windows are sorted by hash with their places, so equal ones are neighbours; the
    places that have an equal neighbour, sorted, cover min(3, distance to the next) words each.
    """
    windows = F.transform(
        F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
        lambda w, i: F.struct(F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("p")),
    )
    again = let(
        F.sort_array(windows),
        lambda s: F.filter(s, lambda x, i: F.coalesce(x["h"] == F.get(s, i - 1)["h"], F.lit(False)) | F.coalesce(x["h"] == F.get(s, i + 1)["h"], F.lit(False))),
    )
    covered = let(
        F.sort_array(F.transform(again, lambda x: x["p"])),
        lambda s: F.aggregate(F.transform(s, lambda p, i: F.least(F.lit(3), F.coalesce(F.get(s, i + 1) - p, F.lit(3)))), F.lit(0), lambda a, b: a + b),
    )
    return covered.cast("long")


def normal_line(line: Column) -> Column:
    folded = F.trim(F.regexp_replace(line, SPACE, " "))
    return F.translate(folded, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def statistics(docs: DataFrame) -> DataFrame:
    """A row for each document: base statistics, and its lines as (hash, words)."""
    text = F.coalesce("text", F.lit(""))
    start = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        "doc_id",
        F.coalesce("source", F.lit("")).alias("host"),
        text.alias("text"),
        words_of(F.col("text")).alias("words"),
        F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
    )
    return start.select(
        "_row",
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        n_symbols(F.col("text")).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        n_repeat_words(F.col("words")).alias("n_repeat_words"),
        F.transform("lines", lambda x: F.struct(F.xxhash64(normal_line(x)).alias("h"), F.size(F.split(F.trim(F.regexp_replace(x, SPACE, " ")), " ")).alias("n"))).alias("lines"),
    )


def boilerplate(stats: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, h) of lines above their host's limit."""
    hosts = stats.groupBy("host").agg(F.count("*").alias("docs"))
    lines = stats.select("host", F.explode(F.array_distinct(F.transform("lines", lambda x: x["h"]))).alias("h"))
    counts = lines.groupBy("host", "h").agg(F.count("*").alias("n")).where(F.col("n") > min_docs)
    return counts.join(hosts, "host").where(F.col("n") > max_share * F.col("docs")).select("host", "h")


def judge(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE, min_left: float = MIN_LEFT) -> DataFrame:
    """The contract's columns and n_line_words, the words in lines that are removed."""
    stats = materialize(statistics(picked(docs, "doc_id", "text", "source")), "lines")
    bad = boilerplate(stats, min_docs, max_share)
    lines = stats.select("_row", "host", F.explode("lines").alias("line")).select("_row", "host", F.col("line.h").alias("h"), F.col("line.n").alias("n"))
    # a line of a whole host is dealt over SALTS tasks; where `bad` is small, Spark broadcasts it after a look at its size
    copies = bad.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = lines.withColumn("_salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)).cast("int"))
    removed = salted.join(copies, ["host", "h", "_salt"]).groupBy("_row").agg(F.sum("n").alias("gone"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    gone = F.coalesce("gone", F.lit(0))
    return stats.join(removed, "_row", "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        failed.alias("base_failed"),
        gone.cast("long").alias("n_line_words"),
        (~failed & (F.col("n_words") - gone >= min_left * F.col("n_words"))).alias("kept"),
    )


def cleaned(docs: DataFrame, **limits: float) -> DataFrame:
    """doc_id and text of documents without their hosts' boilerplate lines; depleted and failed documents aren't dropped here."""
    stats = materialize(statistics(picked(docs, "doc_id", "text", "source")), "lines")
    bad = boilerplate(stats, **limits).groupBy("host").agg(F.collect_set("h").alias("bad"))  # at most 1 / max_share lines for each line of a document
    rows = picked(docs, "doc_id", "text", "source").withColumn("host", F.coalesce("source", F.lit("")))
    drop = F.transform(F.split("text", "\n"), lambda x: F.struct(x.alias("x"), F.xxhash64(normal_line(x)).alias("h")))
    kept = F.array_join(F.transform(F.filter(drop, lambda x: ~F.array_contains("bad", x["h"])), lambda x: x["x"]), "\n")
    return rows.join(bad, "host", "left").select("doc_id", F.when(F.col("bad").isNull(), F.col("text")).otherwise(kept).alias("text"))
