"""Personal data by fixed patterns and by bootstrapped contexts, with DataFrame functions only.

Base spans are matches of four patterns that pass their checks. They are the seeds of
the second part: the two words before an entity are a lexical pattern. Other tokens
that look like identifiers (four digits or more, with the groups of digits that follow
them) are candidates, with the patterns before them. Patterns and distinct values form
a bipartite graph, which is scored in rounds. A pattern's confidence is the share of its
values that are known, seeds at first; it is trusted with enough known values and enough
confidence. A trusted pattern makes all its values known. Values that became known
support the other patterns they occur with, so a next round may trust these. Rounds end
when no value is new. Candidates after a trusted pattern are ``context`` spans. Neither contexts nor
identifiers have a longest length.

Matches and the gaps between them come from one regular expression each, so starts are
running sums of lengths, in code points, for any number of matches in a text. The
expressions are the contract's, with possessive quantifiers and a look behind that keep
them linear on long runs; what they match is the same.

A null or empty text has no spans. Repeated rows, and rows with equal or null doc_ids,
each give a row of their own. Equal spans of different kinds are all listed. Extra
columns are ignored by ``find`` and kept by ``mask``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plumbline.llm.common import let, materialize, picked

KINDS = ("email", "ip", "card", "phone", "context")
TOKEN = 4

# The contract's patterns. A start inside a run can't match when the run's start can't, unless the last match ended there.
_EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9](?:[\x20-]?[0-9])++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
_PART = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9][0-9]?)?"
#: Tokens between white space that hold a digit, with the groups of digits after them.
_TOKEN = r"""(?<!\S)\S*[0-9]\S*+(?:(?<=[0-9])\x20[0-9]++(?:-[0-9]++)*+(?=[.,;:!?)"']*+(?:\s|\z)))*+"""

#: Known values that a pattern needs, and the least confidence of a trusted one.
MIN_KNOWN, MIN_CONFIDENCE = 5, 0.8
#: Parts into which a frequent pattern's rows are dealt in joins.
SALTS = 16


def _matches(text: Column, kind: int, pattern: str, wanted: Column) -> Column:
    """Matches as (kind, place, gap before, match, last two words of the gap or all of it), only where ``wanted`` holds."""

    def one(gap: Column, m: Column, i: Column) -> Column:
        two = F.regexp_extract(gap, r"\s\S++\s++\S++\s*+\z", 0)
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), F.length(gap).alias("gap"), m.alias("m"), F.when(two != "", two).otherwise(gap).alias("left"))

    def zipped(gaps: Column, found: Column) -> Column:
        return F.transform(found, lambda m, i: let(F.get(gaps, i), lambda gap: one(gap, m, i)))

    both = let(F.struct(F.split(text, pattern, -1).alias("g"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m")), lambda s: zipped(s["g"], s["m"]))
    none = F.array().cast("array<struct<kind:int,i:int,gap:int,m:string,left:string>>")
    return F.when(wanted, both).otherwise(none)


def _wanted(t: Column) -> list[Column]:
    """For each kind of match, a cheap condition that holds wherever there is one that can count."""
    digits = t.rlike("[0-9]")
    return [
        F.contains(t, F.lit("@")),
        digits & t.rlike(r"[0-9]\.[0-9]++\.[0-9]"),
        digits & t.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
        digits & F.contains(t, F.lit("+")),
        digits & t.rlike(r"[0-9](?:[^0-9\s]*+\x20?[^0-9\s]*+[0-9]){3}"),
    ]


def _raw(docs: DataFrame) -> DataFrame:
    """A row for each document with all raw matches; those without any have an empty array."""
    rows = docs.select(F.monotonically_increasing_id().alias("_row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    t = F.col("text")
    found = F.concat(*[_matches(t, k, pattern, wanted) for k, (pattern, wanted) in enumerate(zip((_EMAIL, _IP, _CARD, _PHONE, _TOKEN), _wanted(t)))])
    return rows.select("_row", "doc_id", found.alias("found"))


def _placed(raw: DataFrame) -> DataFrame:
    """(_row, kind, start, end, m, pattern) of every raw match.

    A gap of fewer than two words is continued to the left by the two matches before it.
    """
    flat = raw.select("_row", F.explode("found").alias("x")).select("_row", "x.*")
    line = Window.partitionBy("_row", "kind").orderBy("i")
    end = F.sum(F.col("gap").cast("long") + F.length("m")).over(line.rowsBetween(Window.unboundedPreceding, 0))
    left = F.concat(F.lag("m", 2, "").over(line), F.lag("left", 1, "").over(line), F.lag("m", 1, "").over(line), "left")
    placed = flat.withColumn("end", end).withColumn("_left", left)
    return placed.select("_row", "kind", (F.col("end") - F.length("m")).alias("start"), "end", "m", _pattern(F.col("_left")).alias("pattern"))


def _passes(kind: Column, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    return (
        F.when(kind == 0, True)
        .when(kind == 1, m.rlike(rf"\A{_PART}\.{_PART}\.{_PART}\.{_PART}\z"))
        .when(kind == 2, F.when((n >= 14) & (n <= 19), F.call_function("luhn_check", digits)).otherwise(False))
        .when(kind == 3, (n >= 10) & (n <= 15))
        .otherwise(False)
    )


def _pattern(left: Column) -> Column:
    """The last two words, in lower case and with 0 for digits; null without two words."""
    plain = F.translate(left, "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000")
    two = F.regexp_extract(plain, r"(?<!\S)(\S++\s++\S++)\s*+\z", 1)
    return F.when(two != "", F.regexp_replace(two, r"\s+", " "))


def _candidates(tokens: DataFrame, base: DataFrame) -> DataFrame:
    """Identifier-like tokens, without the punctuation around them, that touch no base span."""
    lead = F.length(F.regexp_extract("m", r"\A[^A-Za-z0-9+]*+", 0))
    core = F.regexp_extract("m", r"\A[^A-Za-z0-9+]*+(.*[A-Za-z0-9])", 1)
    trimmed = tokens.select("_row", (F.col("start") + lead).alias("start"), core.alias("m"), "pattern").withColumn("end", F.col("start") + F.length("m"))
    wanted = trimmed.where(F.length(F.regexp_replace("m", "[^0-9]", "")) >= 4)
    both = wanted.select("_row", "start", "end", "m", "pattern", F.lit(False).alias("seed")).unionByName(base.select("_row", "start", "end", "m", "pattern", F.lit(True).alias("seed")))
    before = Window.partitionBy("_row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy("_row").orderBy("start", "end").rowsBetween(0, Window.unboundedFollowing)
    near = both.withColumn("_to", F.max(F.when(F.col("seed"), F.col("end"))).over(before)).withColumn("_from", F.min(F.when(F.col("seed"), F.col("start"))).over(after))
    free = ~F.coalesce(F.col("_to") > F.col("start"), F.lit(False)) & ~F.coalesce(F.col("_from") < F.col("end"), F.lit(False))
    return near.where(~F.col("seed") & free).select("_row", "start", "end", "m", "pattern")


def _by_pattern(rows: DataFrame, part: Column, trusted: DataFrame) -> DataFrame:
    """Rows of trusted patterns. A pattern's rows are dealt out by ``part``, so a frequent one isn't one task's."""
    copies = trusted.select("pattern", "confidence", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(part), F.lit(SALTS)).cast("int")).join(copies, ["pattern", "_salt"]).drop("_salt")


def trusted_patterns(seeds: DataFrame, candidates: DataFrame, min_known: int = MIN_KNOWN, min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(pattern, confidence) of trusted patterns, from (pattern, m) of seeds and candidates.

    Each round but the last makes values known, so there are never more rounds than trusted
    patterns. A pattern with fewer values than ``min_known`` can't become trusted and is left out.
    """
    pairs = seeds.select("pattern", "m", F.lit(1).alias("seed")).unionByName(candidates.select("pattern", "m", F.lit(0).alias("seed")))
    edges = pairs.where("pattern is not null").groupBy("pattern", "m").agg(F.max("seed").alias("seed"))
    enough = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= min_known).select("pattern", F.lit(1.0).alias("confidence"))
    edges = materialize(_by_pattern(edges, F.col("m"), enough).select("pattern", "m", "seed"), "patterns")
    known = materialize(edges.where("seed = 1").select("m").distinct(), "known")
    while True:
        scored = edges.join(known.withColumn("known", F.lit(1)), "m", "left").groupBy("pattern").agg(F.count("known").alias("n"), (F.count("known") / F.count("*")).alias("confidence"))
        trusted = materialize(scored.where((F.col("n") >= min_known) & (F.col("confidence") >= min_confidence)).select("pattern", "confidence"), "trusted")
        found = _by_pattern(edges.select("pattern", "m"), F.col("m"), trusted).select("m").distinct()
        new = materialize(found.join(known, "m", "left_anti"), "known")
        if new.isEmpty():
            return trusted
        known = known.unionByName(new)


def spans_of(raw: DataFrame, **limits: float) -> DataFrame:
    """Spans (_row, kind, start, end, m) from raw matches (_row, found)."""
    placed = materialize(_placed(raw), "pii")
    base = placed.where((F.col("kind") < TOKEN) & _passes(F.col("kind"), F.col("m")))
    candidates = materialize(_candidates(placed.where(F.col("kind") == TOKEN), base), "pii")
    trusted = trusted_patterns(base.select("pattern", "m"), candidates, **limits)
    found = _by_pattern(candidates, F.col("_row"), trusted).select("_row", F.lit(TOKEN).alias("kind"), "start", "end", "m")
    return base.select("_row", "kind", "start", "end", "m").unionByName(found)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def _count(kind: int) -> Column:
    return F.size(F.filter("s", lambda x: x["kind"] == kind))


def find(docs: DataFrame, **limits: float) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every document row."""
    rows = materialize(_raw(picked(docs, "doc_id", "text")), "pii")
    found = spans_of(rows, **limits)
    lists = found.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("start", "kind", "end"))).alias("s"))
    none = F.array().cast("array<struct<start:long,kind:int,end:long>>")
    all_rows = rows.join(lists, "_row", "left").select("doc_id", F.coalesce("s", none).alias("s"))
    base = F.filter("s", lambda x: x["kind"] < TOKEN)
    counts = [_count(k).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS[:TOKEN])]
    return all_rows.select("doc_id", *counts, F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("s")).alias("spans"))


def mask(docs: DataFrame, **limits: float) -> DataFrame:
    """All rows and columns of ``docs``, with each span of ``text`` replaced by its kind, as in ``[EMAIL]``.

    Where spans overlap, the one that starts first (the longest of those) is replaced
    and what the others have beyond it goes too. Texts that can't hold a match pass by;
    only the others are written and joined with their spans.
    """
    text = F.coalesce("text", F.lit(""))
    suspect = _wanted(text)[0]
    for w in _wanted(text)[1:]:
        suspect = suspect | w
    whole = F.struct(*[F.col(c) for c in docs.columns])
    some = materialize(docs.where(suspect).select(F.monotonically_increasing_id().alias("_row"), whole.alias("_doc")), "pii")
    t = F.col("_doc.text")
    raw = some.select("_row", F.concat(*[_matches(t, k, pattern, wanted) for k, (pattern, wanted) in enumerate(zip((_EMAIL, _IP, _CARD, _PHONE, _TOKEN), _wanted(t)))]).alias("found"))
    found = spans_of(raw, **limits)
    order = Window.partitionBy("_row").orderBy("start", F.desc("end"), "kind")
    reach = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = found.withColumn("_reach", reach).where(F.col("end") > F.col("_reach"))
    cut = cut.withColumn("_from", F.greatest("start", "_reach")).withColumn("_cover", F.col("start") < F.col("_reach"))
    lists = cut.groupBy("_row").agg(F.sort_array(F.collect_list(F.struct("_from", "end", "kind", "_cover"))).alias("_s"))
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    s = F.col("_s")

    def piece(x: Column, i: Column) -> Column:
        before = F.coalesce(F.get(s, i - 1)["end"], F.lit(0))
        kept = F.substring(t, (before + 1).cast("int"), (x["_from"] - before).cast("int"))
        return F.concat(kept, F.when(x["_cover"], "").otherwise(F.get(names, x["kind"])))

    tail = F.substring(t, (F.element_at(s, -1)["end"] + 1).cast("int"), F.length(t))
    new = F.when(s.isNull(), t).otherwise(F.concat(F.array_join(F.transform(s, piece), ""), tail))
    masked = some.join(lists, "_row", "left").select(*[new.alias("text") if c == "text" else F.col("_doc").getField(c).alias(c) for c in docs.columns])
    return docs.where(~suspect).unionByName(masked)
