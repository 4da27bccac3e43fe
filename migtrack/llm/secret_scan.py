"""Operator 2: secret scan with multipart credential linking.

A scan of each text gives the parts of credentials: strong ones, which are
findings by themselves, and weak candidates, which are not. Parts have a role:
identifier, secret or endpoint. An interval join then looks, within a scope (a
block of text between blank lines), for complementary parts of a weak candidate that
do not overlap it: anywhere in the scope with a ``reach`` of None, as the registered
query has it, else at most so many code points away. A weak identifier needs a
secret; a weak secret an identifier or an endpoint; an endpoint both an identifier
and a secret. What looks like a secret inside an identifier or an endpoint (the path
of a link) is none; the login of a link, before its @, is not part of the endpoint.

The join never pairs parts: a scope is one cell or cut into cells as wide as the reach, each
cell keeps per role the first and last of the starts and of the ends, and a candidate
looks at the cells within reach before and after it, which decides exactly whether
any part is near.

Cases: null text counts as empty and has no spans; repeated rows and null doc_id
are scanned one by one; a part may be as long as the text; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text, written

REACH = 400
END = 1 << 31         # beyond the end of any text
ENTROPY = 3.5
# Strong kinds first, in the order in which spans with one start are listed.
KINDS = ["assign", "access", "hex", "identifier", "weak_secret", "endpoint"]
IDENTIFIER, SECRET, ENDPOINT = 0, 1, 2
ROLES = [SECRET, IDENTIFIER, SECRET, IDENTIFIER, SECRET, ENDPOINT]
STRONG = 3

# The base patterns.
ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # whole runs of 24 or more

WEAK_IDENTIFIER = re.compile(
    r"""(?ai:client[_-]?id|access[_-]?key[_-]?id|account[_-]?(?:id|name)|user(?:name|[_-]?id)?|login)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""")
WEAK_SECRET = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}")
LINK = re.compile(r"""(?ai:https?|ftp|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://([^\s"'<>/?#@]*@)?[^\s"'<>]+""")
BREAK = re.compile(r"\n[ \t\r]*\n")

PART = "array<struct<start:int,kind:int,end:int,scope:int>>"


def random_looking(s: str) -> bool:
    """Both cases and digits, and the letters spread as in a random string."""
    if not (any(c.isdigit() for c in s) and any(c.islower() for c in s) and any(c.isupper() for c in s)):
        return False
    return -sum(n / len(s) * math.log2(n / len(s)) for n in Counter(s).values()) >= ENTROPY


def spans_union(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint union of sorted spans."""
    starts, ends = [], []
    for a, b in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def overlaps(union: tuple[list[int], list[int]], a: int, b: int) -> bool:
    i = bisect_left(union[0], b)  # the last span that starts before b
    return i > 0 and union[1][i - 1] > a


def inside(union: tuple[list[int], list[int]], a: int, b: int) -> bool:
    i = bisect_right(union[0], a)  # the last span that starts at a or before
    return i > 0 and union[1][i - 1] >= b


def parts(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, scope) of the strong parts and the weak candidates of a text."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    strong = sorted((s, e) for s, _, e in found)
    weak = []
    if ":" in text or "=" in text:
        weak += [(m.start(), 3, m.end()) for m in WEAK_IDENTIFIER.finditer(text)]
    if "://" in text:
        weak += [(max(m.start(), m.end(1)), 5, m.end()) for m in LINK.finditer(text)]
    taken = spans_union(sorted((s, e) for s, _, e in weak))
    weak += [(m.start(), 4, m.end()) for m in WEAK_SECRET.finditer(text)
             if random_looking(m[0]) and not inside(taken, m.start(), m.end())]
    covered = spans_union(strong)
    found += [p for p in weak if not overlaps(covered, p[0], p[2])]  # what a strong part covers is no candidate
    if not found:
        return []
    breaks, out, scope = [m.end() for m in BREAK.finditer(text)], [], 0
    for s, kind, e in sorted(found):
        while scope < len(breaks) and breaks[scope] <= s:
            scope += 1
        out.append((s, kind, e, scope))
    return out


def scan_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([(c, pa.int32()) for c in ("start", "kind", "end", "scope")]))
    for batch in batches:
        rows = [[dict(zip(("start", "kind", "end", "scope"), p, strict=True)) for p in parts(t)]
                for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "parts"])


def scanned(docs: DataFrame) -> DataFrame:
    """row, doc_id, parts of every document, written to the shared folder."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    found = texts.mapInArrow(scan_batches, f"doc_id long, parts {PART}")
    return written(found.withColumn("row", F.monotonically_increasing_id()), "parts")


def linked(scan: DataFrame, reach: int | None = REACH) -> DataFrame:
    """row, spans: the weak candidates that have their complement near."""
    roles = F.array(*(F.lit(r) for r in ROLES))
    parts = (scan.filter(F.exists("parts", lambda p: p["kind"] >= STRONG))
             .select("row", F.explode("parts").alias("p")).select("row", "p.*")
             .withColumn("role", F.element_at(roles, F.col("kind") + 1)))
    cell = lambda c: F.lit(0) if reach is None else F.floor(c / reach).cast("int")
    away = END if reach is None else reach
    place = lambda c, side: F.struct(cell(F.col(c)).alias("cell"), F.lit(side).alias("side"), F.col(c).alias("at"))
    cells = (parts.select("row", "scope", "role", F.explode(F.array(place("end", "before"), place("start", "after"))).alias("c"))
             .groupBy("row", "scope", "c.cell", "c.side", "role").agg(F.min("c.at").alias("first"), F.max("c.at").alias("last")))
    # ends in the reach before a candidate, starts in the reach after it: no part that overlaps it
    look = lambda side, low, high: F.struct(F.lit(side).alias("side"), low.alias("low"), high.alias("high"))
    weak = parts.filter(F.col("kind") >= STRONG).withColumn("l", F.explode(F.array(
        look("before", F.greatest(F.col("start") - away, F.lit(0)).cast("long"), F.col("start").cast("long")),
        look("after", F.col("end").cast("long"), F.col("end").cast("long") + away)))).select("row", "scope", "start", "kind", "end", "role", "l.*")
    weak = weak.withColumn("cell", F.explode(F.sequence(cell(F.col("low")), cell(F.col("high")))))
    near = (weak.join(cells.withColumnRenamed("role", "other"), ["row", "scope", "side", "cell"])
            .filter((F.col("role") != F.col("other")) & (F.col("first") <= F.col("high")) & (F.col("last") >= F.col("low"))))
    has = lambda role: F.max(F.col("other") == role)
    near = near.groupBy("row", "start", "kind", "end", "role").agg(
        has(IDENTIFIER).alias("i"), has(SECRET).alias("s"), has(ENDPOINT).alias("e"))
    kept = near.filter(((F.col("role") == IDENTIFIER) & F.col("s")) | ((F.col("role") == SECRET) & (F.col("i") | F.col("e")))
                       | ((F.col("role") == ENDPOINT) & F.col("i") & F.col("s")))
    return kept.groupBy("row").agg(F.collect_list(F.struct("start", "kind", "end")).alias("links"))


def findings(docs: DataFrame, reach: int | None = REACH) -> DataFrame:
    """doc_id, base, spans: arrays of (start, kind, end), kinds as numbered in ``KINDS``, sorted."""
    scan = scanned(docs)
    plain = F.transform(F.filter("parts", lambda p: p["kind"] < STRONG),
                        lambda p: F.struct(p["start"].alias("start"), p["kind"].alias("kind"), p["end"].alias("end")))
    rows = scan.select("row", "doc_id", F.array_sort(plain).alias("base")).join(linked(scan, reach), "row", "left")
    links = F.coalesce("links", F.slice("base", 1, 0))
    return rows.select("doc_id", "base", F.array_sort(F.concat("base", links)).alias("spans"))


def joined(spans: str, kinds: list[str] = KINDS) -> Column:
    names = F.array(*(F.lit(k) for k in kinds))
    return F.array_join(F.transform(spans, lambda p: F.concat_ws(
        ":", F.element_at(names, p["kind"] + 1), p["start"].cast("string"), p["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """The findings as counts per strong kind, the hash of the base spans, and all spans as text."""
    count = lambda k: F.size(F.filter("base", lambda p: p["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
                        F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))
