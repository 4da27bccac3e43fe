"""Operator 3: mixing sources to target weights by weighted fair queueing.

DataFrame functions only. Every document of a source, in an order shuffled by a
hash, starts when the ones before it end: its virtual finish time is the
source's words up to and with it, divided by the source's target. A source may
be read up to ``MAX_REPEAT`` times, each reading after the one before. All
readings of all sources, sorted by finish time, are taken up to the total budget.

Virtual time is cut into about sqrt(n) equal ranges, which hold about as many
words each, since each source spreads its words evenly over it. Ranges are
summed up in order; only the range in which the budget runs out is sorted row by
row, which gives the exact place of the cut in the global order.

Cases: null text has no words, is taken 0 times and has size 0; null source is a
source of its own and comes last; rows alike in every column used count as that
many documents, and copies of a document share its place; an empty table gives
no rows; a source without words has target 0. Other columns are carried along
untouched by ``mixed`` and ignored by ``plan``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, row_hash, running_total, whole_text, written

MAX_REPEAT = 3
WEIGHTS = (1, 2, 3)
ROW = ["doc_id", "source", "size", "spread"]


@dataclass
class Plan:
    """``placed``: a row per document with its place; ``copies``: readings that the mix takes."""
    placed: DataFrame
    copies: Column


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, size in words and the hash that orders documents; small rows only."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                       n_words(whole_text()).alias("size"),
                       row_hash(F.lit("order"), F.col("doc_id").cast("long"), F.col("source").cast("string"),
                                F.col("text")).alias("spread"))


def source_key(source: Column) -> Column:
    """Never null, so that plain equality joins it."""
    return F.when(source.isNull(), "").otherwise(F.concat(F.lit("="), source))


def targets(sizes: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """source_key, source_size, n, target, weight from rows of source, source_size and n.

    The budget, 100 % of all sizes, is shared by weight; a source stops at
    ``max_repeat`` times its size and the excess is reshared. In order of
    size / weight the capped sources come first: with the first j capped, the
    others get (budget - caps so far) / (weights left) per unit of weight. The
    right j is the first one where the next source stays within its cap; from
    there on this level only falls, so it is the highest such level.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*(F.lit(float(w)) for w in weights))
    s = sizes.withColumn("weight", F.element_at(listed, ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")))
    s = s.withColumn("cap", F.col("source_size") * float(max_repeat)).withColumn("ratio", F.col("cap") / F.col("weight"))
    order = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    later = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = Window.partitionBy()
    s = s.withColumn("budget", F.sum("source_size").over(every).cast("double"))
    s = s.withColumn("level", (F.col("budget") - F.coalesce(F.sum("cap").over(earlier), F.lit(0.0))) / F.sum("weight").over(later))
    level = F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level"))).over(every)
    s = s.withColumn("target", F.least(F.col("cap"), F.coalesce(level, F.lit(0.0)) * F.col("weight")))
    return s.select(source_key(F.col("source")).alias("source_key"), "source_size", "n", "target")


def finish_times(max_repeat: int) -> Column:
    """(time, spread, reading) of each reading of a document; empty where nothing can be taken."""
    readings = F.sequence(F.lit(0), F.lit(max_repeat - 1))
    target = F.when(F.col("target") > 0, F.col("target"))
    times = F.transform(readings, lambda e: F.struct(
        ((e * F.col("source_size") + F.col("upto")) / target).alias("time"),
        F.col("spread").alias("spread"), e.alias("reading")))
    return F.when(target.isNotNull() & (F.col("size") > 0), times).otherwise(F.slice(times, 1, 0))


def plan(docs: DataFrame, weights=WEIGHTS, max_repeat: int = MAX_REPEAT, share: float = 1.0) -> Plan:
    """Place every document in virtual time and find where the budget (``share`` of all words) ends."""
    rows = written(sized(docs).groupBy(*ROW).agg(F.count("*").alias("alike")), "sized")
    rows = rows.withColumn("source_key", source_key(F.col("source"))).withColumn("words", F.col("size") * F.col("alike"))
    sizes = rows.groupBy("source").agg(F.sum("words").alias("source_size"), F.count("*").alias("n"))
    shares = written(targets(sizes, weights, max_repeat), "targets")
    rows = running_total(rows.join(shares, "source_key"), "source_key", ["spread", "doc_id", "size"],
                         "spread", "words", "upto", F.col("n"))
    # one row per document again: the copies of a row follow each other
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("alike"))))
    rows = rows.withColumn("upto", F.col("upto") - (F.col("alike") - F.col("copy")) * F.col("size"))
    placed = written(rows.select(*ROW, "copy", "alike", "source_key", "source_size", "target", "upto"), "placed")

    n, total = placed.agg(F.count("*"), F.sum("size")).first()
    budget = int((total or 0) * share)
    steps = max(1, round(n ** 0.5))
    readings = placed.select("size", "source_key", F.explode(finish_times(max_repeat)).alias("at"))
    readings = readings.withColumn("range", F.least(F.floor(F.col("at.time") * steps), F.lit(4 * steps)))
    in_order = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ends = readings.groupBy("range").agg(F.sum("size").alias("words")).withColumn("upto", F.sum("words").over(in_order))
    over = ends.filter(F.col("upto") > budget).orderBy("range").limit(1).collect()
    if not over:  # the budget holds every reading
        return Plan(placed, F.size(finish_times(max_repeat)))
    cut, before = over[0]["range"], over[0]["upto"] - over[0]["words"]
    one_by_one = (Window.orderBy("at.time", "at.spread", "at.reading")
                  .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    last = (readings.filter(F.col("range") == cut).withColumn("upto", F.sum("size").over(one_by_one) + before)
            .filter(F.col("upto") <= budget).orderBy(F.desc("upto")).limit(1).collect())
    if last:
        at = last[0]["at"]
        end = F.struct(F.lit(at["time"]), F.lit(at["spread"]), F.lit(at["reading"]))
        taken = lambda x: x <= end
    else:
        taken = lambda x: F.floor(x["time"] * steps) < cut
    return Plan(placed, F.size(F.filter(finish_times(max_repeat), taken)))


def taken_words(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words, repeats counted)."""
    p = plan(docs, **options)
    return p.placed.select("doc_id", "size", "source_size", "target",
                           (F.col("size") * p.copies).cast("long").alias("taken"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the documents with their own columns, each as often as the mix takes it."""
    p = plan(docs, **options)
    key = ["__id", "__spread"]
    counts = (p.placed.groupBy(F.coalesce("doc_id", F.lit(-1).cast("long")).alias("__id"), F.col("spread").alias("__spread"))
              .agg(F.sum(p.copies).alias("__copies"), F.max("alike").alias("__alike")).filter("__copies > 0"))
    rows = docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(-1).cast("long")))
    rows = rows.withColumn("__spread", row_hash(F.lit("order"), F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("text")))
    found = rows.join(counts, key)
    once, alike = found.filter("__alike = 1"), found.filter("__alike > 1").dropDuplicates(key)
    copies = F.sequence(F.lit(1).cast("long"), F.col("__copies"))
    return once.unionByName(alike).withColumn("__copy", F.explode(copies)).select(*docs.columns)
