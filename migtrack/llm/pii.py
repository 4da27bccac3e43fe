"""Operator 7: personal data by patterns, and the terms that disclose it.

DataFrame functions only. Base spans come from four patterns. The terms of every
document that holds a value are the value's context: words with digits and inner
punctuation, without what is in a base span. Over all documents, the pointwise
mutual information of a protected value c and a context term t,

    PMI(c; t) = log2(p(c, t) / (p(c) p(t))),

is at most the information -log2 p(c) of the value itself, and equals it when
the term occurs only with the value. A term that occurs with the value in
``SUPPORT`` documents or more and gives away ``DISCLOSURE`` of its information or
more is a span too, wherever it stands in a document that holds the value: with all
of it (``REMOVE``) it is removed from the text, with less it is generalised. Terms
in more documents than can give away so much are not paired with a value at all. Values that
the same documents hold are one value to their terms, and terms that the same documents hold are counted as one.

Matches are found with their gaps (extract and split by the same pattern) and
placed by a running sum of lengths, in code points. The patterns are written so
that no text makes them quadratic: a match starts where the last one ended or
where a run begins, and repeats are possessive.

Cases: null text counts as empty and has no spans; repeated rows and null doc_id
are documents of their own; values in a third of all documents are counted per
(value, term) before anything is joined; an empty table gives no rows; other
columns are ignored, and kept by ``sanitised``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lookup, salted, whole_text, written

KINDS = ["email", "ip", "card", "phone", "term"]
TERM_KIND = 4
SHORTEST = 3         # code points of a term
SUPPORT, DISCLOSURE, REMOVE = 3, 0.9, 1.0

# The base patterns, without backtracking.
PATTERNS = [
    r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}+",
    r"[0-9](?:[\x20-]?[0-9])++",
    r"\+[0-9][\x20().0-9-]+[0-9]",
]
IP_VALUE = r"^(?:0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.|$)){4}$"
TERM = r"[\p{L}\p{M}\p{N}]++(?:['\u2019.&_-][\p{L}\p{M}\p{N}]++)*+"


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits pass the Luhn check; every second digit from the right counts double."""
    n = F.length(number)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when(
        (n - i) % 2 == 1, F.substring(number, i, F.lit(1)).cast("int") * 2
        - F.when(F.substring(number, i, F.lit(1)).cast("int") > 4, 9).otherwise(0))
        .otherwise(F.substring(number, i, F.lit(1)).cast("int")))
    return total % 10 == 0


def valid(kind: int, value: Column) -> Column:
    if kind == 0:
        return F.lit(True)
    if kind == 1:
        return value.rlike(IP_VALUE)
    n = F.length(digits(value))
    if kind == 2:
        return F.when((n >= 14) & (n <= 19), luhn(digits(value))).otherwise(False)
    return (n >= 10) & (n <= 15)


def hits_of(kind: int) -> Column:
    """The hits of a kind from its columns m (matches) and g (gaps)."""
    gap = lambda i: F.element_at(f"g{kind}", i + 1)
    return F.transform(f"m{kind}", lambda m, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("place"), F.length(gap(i)).alias("gap"), F.length(m).alias("len"),
        valid(kind, m).alias("valid"), F.lower(m).alias("value")))


def readied(docs: DataFrame) -> tuple[DataFrame, list[Column]]:
    """The documents' doc_id and text, and whether a text can have matches of each kind."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    rows = rows.withColumn("any_digit", F.col("text").rlike("[0-9]"))
    return rows, [F.col("text").contains("@"), F.col("any_digit") & F.col("text").contains("."), F.col("any_digit"),
                  F.col("text").contains("+")]


def blanked(kind: int) -> Callable[[Column], Column]:
    """Puts blanks, as many code points, in place of a valid match of a kind."""
    return lambda m: F.when(valid(kind, m), F.repeat(F.lit(" "), F.length(m))).otherwise(m)


def with_words(rows: DataFrame, may: list[Column]) -> DataFrame:
    """Add ``words``: the text with blanks, as many code points, in place of its valid matches."""
    rows = rows.withColumn("words", F.col("text"))
    for k, p in enumerate(PATTERNS):
        rows = rows.withColumn("found", F.when(may[k], F.regexp_extract_all("words", F.lit(p), F.lit(0)))
                               .otherwise(F.array().cast("array<string>")))
        parts = F.zip_with(F.split("words", p, -1), F.transform("found", blanked(k)),
                           lambda gap, m: F.concat(gap, F.coalesce(m, F.lit(""))))
        rows = rows.withColumn("words", F.when(F.exists("found", partial(valid, k)), F.array_join(parts, ""))
                               .otherwise(F.col("words"))).drop("found")
    return rows


def scanned(docs: DataFrame) -> DataFrame:
    """row, doc_id, hits, words of every document, written to the shared folder.

    A hit has its kind, place among the matches of its kind, the length of the
    gap before it, its own length, whether it is valid, and its value. ``words``
    is null for documents without a valid hit.
    """
    rows, may = readied(docs)
    rows = with_words(rows, may)
    none = F.array().cast("array<string>")
    rows = rows.withColumns({f"m{k}": F.when(may[k], F.regexp_extract_all("text", F.lit(p), F.lit(0))).otherwise(none)
                             for k, p in enumerate(PATTERNS)})
    rows = rows.withColumns({f"g{k}": F.when(F.size(f"m{k}") > 0, F.split("text", p, -1)).otherwise(none)
                             for k, p in enumerate(PATTERNS)})
    hits = [hits_of(k) for k in range(len(PATTERNS))]
    found = rows.select("doc_id", F.concat(*hits).alias("hits"), "words")
    found = found.withColumn("words", F.when(F.exists("hits", lambda h: h["valid"]), F.col("words")))
    return written(found.withColumn("row", F.monotonically_increasing_id()), "hits")


def base_spans(scan: DataFrame) -> DataFrame:
    """row, kind, start, end, value of the valid hits."""
    hits = scan.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    so_far = Window.partitionBy("row", "kind").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = hits.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far).cast("int"))
    return placed.filter("valid").select("row", "kind", (F.col("end") - F.col("len")).alias("start"), "end",
                                         F.concat_ws(":", "kind", "value").alias("value"))


def members_hash(*cols: str) -> list[Column]:
    """Aggregates that tell the sets of rows of two groups apart: how many, and two 64-bit sums over them."""
    return [F.count("*").alias("n_rows"), F.bit_xor(F.xxhash64(*cols)).alias("x"), F.bit_xor(F.xxhash64(*cols, F.lit(7))).alias("y")]


def context_terms(base: DataFrame) -> DataFrame:
    """row, value, n_value: the documents whose terms are the context of a value.

    Values of the same documents have the same context and disclose by the same terms, so the
    smallest stands for all of them: a list of addresses is one value, however long.
    """
    held = written(base.select("row", "value").distinct(), "held")
    sets = held.groupBy("value").agg(*members_hash("row"))
    first = written(sets.groupBy("n_rows", "x", "y").agg(F.min("value").alias("value")).select(
        "value", F.col("n_rows").alias("n_value")), "first")
    return salted(held, first, "value", "n_value")


def terms_of(words: str) -> Column:
    """The distinct terms of a text."""
    found = F.transform(F.regexp_extract_all(words, F.lit(TERM), F.lit(0)), lambda m: F.lower(m))
    return F.array_distinct(F.filter(found, lambda t: F.length(t) >= SHORTEST))


def term_places(texts: DataFrame) -> DataFrame:
    """row, term, start, end of every term of ``texts`` (row, words)."""
    found = texts.select("row", F.regexp_extract_all("words", F.lit(TERM), F.lit(0)).alias("m"), F.split("words", TERM, -1).alias("g"))
    one = found.select("row", F.explode(F.transform("m", lambda m, i: F.struct(
        i.alias("place"), F.length(F.element_at("g", i + 1)).alias("gap"), F.length(m).alias("len"), F.lower(m).alias("term")))).alias("t"))
    so_far = Window.partitionBy("row").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = one.select("row", "t.*").withColumn("end", F.sum(F.col("gap") + F.col("len")).over(so_far).cast("int"))
    return placed.select("row", "term", (F.col("end") - F.col("len")).alias("start"), "end")


def document_frequency(docs: DataFrame) -> DataFrame:
    """term, n_term: in how many documents a term occurs, over all documents."""
    rows = with_words(*readied(docs))
    return rows.select(F.explode(terms_of("words")).alias("term")).groupBy("term").agg(F.count("*").alias("n_term"))


def disclosing(docs: DataFrame, scan: DataFrame, near: DataFrame, support: int = SUPPORT,
               disclosure: float = DISCLOSURE) -> DataFrame:
    """value, term, disclosed: the terms that give away a protected value of ``near``, and how much of it.

    Terms that the same documents with values hold, and as many documents in all, are counted once for all of them.
    """
    total = F.lit(scan.count())
    held = near.withColumn("information", F.log2(total / F.col("n_value"))).filter((F.col("n_value") >= support) & (F.col("information") > 0))
    # a term in more documents than this gives away less, even if it occurs in all of the value's
    held = written(held.withColumn("most", F.col("n_value") * F.pow(total / F.col("n_value"), F.lit(1 - disclosure + 1e-6))), "held")
    most = held.agg(F.coalesce(F.max("most"), F.lit(0.0)).alias("most")).first()["most"]
    terms = scan.filter("words IS NOT NULL").join(held.select("row").distinct(), "row", "left_semi").select(
        "row", F.explode(terms_of("words")).alias("term"))
    frequent = document_frequency(docs).filter((F.col("n_term") >= support) & (F.col("n_term") <= most))
    terms = written(terms.join(frequent, "term"), "terms")
    sets = terms.groupBy("term", "n_term").agg(*members_hash("row")).filter(F.col("n_rows") >= support)
    sets = written(sets.withColumn("of", F.min("term").over(Window.partitionBy("n_term", "n_rows", "x", "y"))), "sets")
    kinds = written(sets.filter("term = of").select("term", "n_rows"), "kinds")
    pairs = (lookup(terms, kinds, "term", "n_rows").join(held, "row").filter(F.col("n_term") <= F.col("most"))
             .groupBy("value", "term", "information", "n_value", "n_term").agg(F.count("*").alias("n_both")))
    both = pairs.filter(F.col("n_both") >= support).withColumn(
        "pmi", F.log2(F.col("n_both") * total / (F.col("n_value") * F.col("n_term"))))
    told = (both.withColumn("disclosed", F.col("pmi") / F.col("information"))
            .filter(F.col("disclosed") >= disclosure - 1e-9).select("value", F.col("term").alias("of"), "disclosed"))
    return told.join(sets.select("of", "term"), "of").select("value", "term", "disclosed")


def told_terms(scan: DataFrame, near: DataFrame, told: DataFrame) -> DataFrame:
    """row, start, end, disclosed: every occurrence of a disclosing term in the documents that hold its value."""
    texts = scan.filter("words IS NOT NULL").select("row", "words")
    here = (texts.select("row", F.explode(terms_of("words")).alias("term")).join(told, "term").join(near.select("row", "value"), ["row", "value"])
            .groupBy("row", "term").agg(F.max("disclosed").alias("disclosed")))
    here = written(here, "here")
    places = term_places(texts.join(here.select("row").distinct(), "row", "left_semi"))
    return places.join(here, ["row", "term"]).select("row", "start", "end", "disclosed")


def findings(docs: DataFrame, support: int = SUPPORT, disclosure: float = DISCLOSURE) -> DataFrame:
    """row, doc_id, base, spans: arrays of (start, kind, end, disclosed), sorted; base spans disclose 1."""
    scan = scanned(docs)
    base = written(base_spans(scan), "base")
    near = written(context_terms(base), "near")
    told = written(disclosing(docs, scan, near, support, disclosure), "told")
    terms = told_terms(scan, near, told)
    span = lambda kind, much: F.struct("start", kind.alias("kind"), "end", much.alias("disclosed"))
    every = (base.select("row", span(F.col("kind"), F.lit(1.0)).alias("span"))
             .unionByName(terms.select("row", span(F.lit(TERM_KIND), F.col("disclosed")).alias("span"))))
    listed = every.groupBy("row").agg(F.array_sort(F.collect_list("span")).alias("spans"))
    rows = scan.select("row", "doc_id").join(listed, "row", "left")
    rows = rows.withColumn("spans", F.coalesce("spans", F.array().cast(listed.schema["spans"].dataType)))
    return rows.withColumn("base", F.filter("spans", lambda s: s["kind"] < TERM_KIND))


def joined(spans: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The findings as counts per base kind, the hash of the base spans, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{KINDS[k]}") for k in range(TERM_KIND)),
                        F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def sanitised(docs: DataFrame, **options) -> DataFrame:
    """The documents with personal data and disclosing terms replaced in ``text``.

    A base span becomes its kind in brackets, a term that discloses all of a
    value goes, one that discloses less becomes [word]. Of overlapping spans the
    first one, at one start the longest, decides; the others are cut to what is left of them.
    """
    plain = written(docs.withColumn("__row", F.monotonically_increasing_id()), "plain")
    found = findings(plain.select(F.col("__row").alias("doc_id"), "text"), **options)
    found = found.select(F.col("doc_id").alias("__row"), F.col("spans").alias("__spans"))
    names = F.array(*(F.lit(f"[{k}]") for k in [*KINDS[:TERM_KIND], "word"]))
    put = lambda s: F.when((s["kind"] == TERM_KIND) & (s["disclosed"] >= REMOVE - 1e-9), "").otherwise(
        F.element_at(names, s["kind"] + 1))
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("end"))
    made = F.aggregate("__spans", start, lambda acc, s: F.when(s["end"] <= acc["end"], acc).otherwise(F.struct(
        F.concat(acc["text"], F.substring(whole_text(), acc["end"] + 1, F.greatest(s["start"] - acc["end"], F.lit(0))), put(s)).alias("text"),
        s["end"].alias("end"))), lambda acc: F.concat(acc["text"], F.substring(whole_text(), acc["end"] + 1, F.length(whole_text()))))
    out = plain.join(found, "__row").withColumn("text", F.when(F.size("__spans") > 0, made).otherwise(F.col("text")))
    return out.select(*docs.columns)
