"""Helpers shared by the training-data operators: scratch tables, words, keys, running totals."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources.sinks import delete

WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SCOPE: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables that ``written`` makes inside are removed at the end, but for those to be kept.

    An operator's result reads such tables, so it is to be written inside. Outside of any
    scope they stay until the checkpoint folder is cleared.
    """
    paths: list[str] = []
    token = SCOPE.set(paths)
    try:
        yield
    finally:
        SCOPE.reset(token)
        for path in paths:
            delete(spark, path)


def written(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` as Parquet in the shared checkpoint folder and read it again.

    Cuts the lineage: later steps, and steps repeated after the loss of an
    executor, read the same rows instead of computing them anew. ``keep``: the
    table outlives the scope that it is made in.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if not keep and SCOPE.get() is not None:
        SCOPE.get().append(path)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # what the write shuffled is not needed once it is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def whole_text(col: str = "text") -> Column:
    """The text as it stands; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def n_words(text: Column) -> Column:
    """Number of runs of characters other than the six ASCII blanks."""
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def row_hash(*cols: Column) -> Column:
    """64-bit hash of a row's values, used together with doc_id to find the row again."""
    return F.xxhash64(*cols)


def running_total(df: DataFrame, group: str, order: list[str], spread: str, value: str,
                  out: str, n: Column) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows of ``group`` up to and with this row.

    A group may hold a third of all rows, so it is not sorted in one task: its
    rows are dealt by the hash column ``spread`` into about sqrt(n) buckets
    (``n``: rows of the group), each bucket is summed in ``order``, and the
    buckets' totals are added up in bucket order. Both the rows of a bucket and
    the buckets of a group grow with the square root of the group.
    """
    b = "__bucket"
    df = df.withColumn(b, F.pmod(F.col(spread), F.greatest(F.lit(1), F.ceil(F.sqrt(n)))))
    totals = df.groupBy(group, b).agg(F.sum(value).alias("__sum"))
    before = Window.partitionBy(group).orderBy(b).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col(group).alias("__g"), F.col(b).alias("__b"),
                           F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__before"))
    inside = (Window.partitionBy(group, b).orderBy(*order)
              .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    df = df.withColumn(out, F.sum(value).over(inside))
    df = df.join(totals, (F.col(group) == F.col("__g")) & (F.col(b) == F.col("__b")))
    return df.withColumn(out, F.col(out) + F.col("__before")).drop("__g", "__b", "__before", b)


HOT_PARTS = 1000
SALTS = 64


def _limit(table: DataFrame, n: str, total: int | None) -> float:
    if total is None:
        total = table.agg(F.coalesce(F.sum(n), F.lit(0)).alias("t")).first()["t"]
    return total / HOT_PARTS


def lookup(rows: DataFrame, table: DataFrame, key: str | list[str], n: str, total: int | None = None) -> DataFrame:
    """Inner join of ``rows`` with ``table``, which has one row per ``key`` and, in ``n``, how many of ``rows`` hold it.

    A key may hold a third of all rows. Keys above 1 / ``HOT_PARTS`` of them are
    fewer than ``HOT_PARTS``, whatever the input, and are broadcast; the others
    meet in a shuffle in which none holds more. ``total``: the sum of ``n``, if known.
    Both frames are read more than once, so they should be written ones.
    """
    keys, limit = [key] if isinstance(key, str) else key, _limit(table, n, total)
    hot = F.broadcast(table.filter(F.col(n) > limit))
    return rows.join(hot, keys).unionByName(
        rows.join(hot.select(*keys), keys, "left_anti").join(table.filter(F.col(n) <= limit), keys))


def salted(rows: DataFrame, table: DataFrame, key: str | list[str], n: str, total: int | None = None) -> DataFrame:
    """As ``lookup``, but ``rows`` is read once: rows of hot keys are dealt over ``SALTS`` copies of their key's row."""
    keys, limit = [key] if isinstance(key, str) else key, _limit(table, n, total)
    hot = F.broadcast(table.filter(F.col(n) > limit).select(*keys, F.lit(True).alias("__hot")))
    some = F.when(F.col("__hot"), F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))).otherwise(F.lit(0).cast("long"))
    copies = F.when(F.col(n) > limit, F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))).otherwise(
        F.array(F.lit(0).cast("long")))
    dealt = rows.join(hot, keys, "left").withColumn("__salt", some).drop("__hot")
    return dealt.join(table.withColumn("__salt", F.explode(copies)), [*keys, "__salt"]).drop("__salt")
