"""Substring index over procedure names (C2): postings of trigrams, in folders by the hash of the trigram.

A posting is a trigram of the lower-cased name and the row's columns, so that a search
needs nothing but postings. A search reads the folder of the term's rarest trigram
and keeps the rows whose name contains the term. A term of under three characters has
no trigram; it scans the rows, which are stored beside the postings.

Layout below the index's folder: ``rows`` (each row once), ``postings/folder=N`` (sorted by
trigram, so a reader skips row groups), ``grams`` (rows per trigram, sorted likewise).
``_built`` is written last and holds the number of folders and what the index was built from.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import row_hash, search
from .sinks import delete, path_exists, read_text, write_text

GRAM = 3
SPREAD = 8  # files of one folder, so that a frequent trigram is no single task
BUILT = "_built"


def grams_of(name):
    """The distinct trigrams of a lower-cased name; none for a name under three characters or NULL."""
    lower = F.lower(name)
    starts = F.sequence(F.lit(1), F.length(lower) - GRAM + 1)
    some = F.array_distinct(F.transform(starts, lambda i: F.substring(lower, i, F.lit(GRAM))))
    return F.when(F.length(lower) >= GRAM, some)


def folder_of(gram, folders: int):
    return F.pmod(F.xxhash64(gram), F.lit(folders)).cast("int")


def write_index(rows: DataFrame, path: str, col: str = "procedure_name", folders: int = 256, stamp: str = "") -> None:
    """Build the index of ``rows`` at ``path``, which holds none; what a failed build left there is replaced.

    ``rows`` should be narrow: their columns are stored once per trigram of the name.
    """
    spark = rows.sparkSession
    if built_from(spark, path) is not None:
        raise ValueError(f"{path} holds an index")
    delete(spark, path)
    rows.write.parquet(f"{path}/rows")
    kept = spark.read.schema(rows.schema).parquet(f"{path}/rows")
    postings = kept.select(F.explode(grams_of(F.col(col))).alias("gram"), "*")
    (postings.withColumn("folder", folder_of(F.col("gram"), folders))
     .repartition("folder", F.pmod(row_hash(kept), F.lit(SPREAD))).sortWithinPartitions("folder", "gram")
     .write.partitionBy("folder").parquet(f"{path}/postings"))
    (postings.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
     .repartitionByRange("gram").sortWithinPartitions("gram").write.parquet(f"{path}/grams"))
    write_text(spark, f"{path}/{BUILT}", f"{folders} {col} {stamp}")


def built_from(spark: SparkSession, path: str) -> str | None:
    """The stamp of a finished index, or None."""
    return read_text(spark, f"{path}/{BUILT}").split(" ", 2)[2] if path_exists(spark, f"{path}/{BUILT}") else None


def candidates(spark: SparkSession, path: str, term: str) -> DataFrame:
    """The rows among which those that contain the term are: one trigram's, or all for a short term.

    A term's trigrams, as many as it has characters less two, are looked up first.
    """
    folders, col, _ = read_text(spark, f"{path}/{BUILT}").split(" ", 2)
    kept = spark.read.parquet(f"{path}/rows")
    low = term.lower()
    wanted = sorted({low[i:i + GRAM] for i in range(len(low) - GRAM + 1)})
    if not wanted:
        return kept
    held = {r["gram"]: r["n"] for r in spark.read.parquet(f"{path}/grams").filter(F.col("gram").isin(wanted)).collect()}
    if len(held) < len(wanted):
        return kept.limit(0)  # a trigram of the term that no name has
    gram = min(wanted, key=lambda g: (held[g], g))
    folder = spark.range(1).select(folder_of(F.lit(gram), int(folders)).alias("f")).first()["f"]
    found = spark.read.schema(f"gram string, {', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in kept.schema)}") \
        .parquet(f"{path}/postings/folder={folder}")
    return found.filter(F.col("gram") == gram).drop("gram")


def search_index(spark: SparkSession, path: str, term: str) -> DataFrame:
    """C2 from the index: the same rows in the same order as ``operators.catalog.search`` over all rows."""
    col = read_text(spark, f"{path}/{BUILT}").split(" ", 2)[1]
    return search(candidates(spark, path, term), term, col)
