"""Operator 5: exact top-k search by exhaustive term-at-a-time accumulation.

A vector is a sparse row: its components are terms, floor(1024 * x) the weights,
zeros are left out. Candidates are dealt by row number into blocks of at most about
``BLOCK_VALUES`` components, so that equal rows spread as well; a block keeps one postings list
(places, weights) per term. Query rows, packed ``QUERY_BLOCK`` at a time, stream past every block once. For each term the queries that
hold it scatter weight times posting into their dense score arrays; a partition
selection keeps each query's best k of the block, and the blocks' lists are
merged per query.

Cases: a vector that is null, empty, or holds a null or non-finite component
takes no part, nor does a null vec_id; every other row is a candidate, repeated ones too, and
every query row a query; rows that share an id are no candidates of each other; vectors of unequal length score over
their common components; scores are 64-bit integers (wrapping, as in Java, which
needs components beyond 2**26); an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

SCALE = 1024
QUERY_BLOCK = 128
BLOCK_VALUES = 1 << 22   # components of a block's candidates, about 32 MB
PARTIAL = "query_id long, query_key long, vec_id long, score long"


def weights(vector: Column) -> Column:
    """floor(1024 * x) per component; null unless every component is a finite number."""
    parts = F.transform(vector, lambda x: x.cast("double"))
    fine = F.forall(parts, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.when(fine & (F.size(parts) > 0), F.transform(parts, lambda x: F.floor(x * SCALE).cast("long")))


def postings(values: np.ndarray, sizes: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """(term, places, weights) of rows laid end to end; zeros are absent."""
    row = np.repeat(np.arange(len(sizes)), sizes)
    term = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = np.flatnonzero(values)
    kept = kept[np.argsort(term[kept], kind="stable")]
    cuts = np.flatnonzero(np.diff(term[kept])) + 1
    return [(int(term[part[0]]), row[part], values[part]) for part in np.split(kept, cuts) if len(part)]


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to earlier places (ids ascend in a block)."""
    if len(scores) <= k:
        return np.arange(len(scores))
    floor = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > floor)
    return np.concatenate([above, np.flatnonzero(scores == floor)[:k - len(above)]])


def lists(row: pa.RecordBatch) -> list[np.ndarray]:
    return [row.column(c)[0].values.to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ids", "keys", "sizes", "values")]


def score_blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows by block: the block's candidates come first, one a row by id, its query blocks follow."""
    block, held, ids, index = None, [], np.zeros(0, np.int64), None
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            if row.column("block")[0].as_py() != block:
                block, held, index = row.column("block")[0].as_py(), [], None
            if not row.column("asking")[0].as_py():
                held.append(lists(row))
                continue
            if index is None:
                ids, sizes, values = (np.concatenate([h[c] for h in held]) if held else np.zeros(0, np.int64) for c in (0, 2, 3))
                index, held = {term: (places, w) for term, places, w in postings(values, sizes)}, []
            qids, qkeys, qsizes, qvalues = lists(row)
            scores = np.zeros((len(qids), len(ids)), dtype=np.int64)
            for term, queries, qw in postings(qvalues, qsizes):
                if term in index:
                    places, w = index[term]
                    if len(places) == len(ids):  # every candidate holds the term
                        scores[queries] += qw[:, None] * w
                    else:
                        scores[np.ix_(queries, places)] += qw[:, None] * w
            out = []
            for q, (qid, qkey) in enumerate(zip(qids, qkeys, strict=True)):
                others = np.flatnonzero(ids != qid)
                top = others[best(scores[q, others], k)]
                out.append((np.full(len(top), qid), np.full(len(top), qkey), ids[top], scores[q, top]))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)],
                                             names=["query_id", "query_key", "vec_id", "score"])


def packed(rows: DataFrame, by: str) -> DataFrame:
    """One row per block of queries: ids, keys, vector sizes, and the weights end to end."""
    together = F.sort_array(F.collect_list(F.struct("vec_id", "key", "w")))
    return rows.groupBy(by).agg(together.alias("rows")).select(
        by, F.col("rows.vec_id").alias("ids"), F.col("rows.key").alias("keys"),
        F.transform("rows.w", lambda w: F.size(w).cast("long")).alias("sizes"), F.flatten("rows.w").alias("values"))


def search(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best candidates of every query: query_id, rank, vec_id, score.

    Both inputs have vec_id and embedding. Work is queries x candidates x terms,
    which an exhaustive search needs; a task holds the postings
    of one candidate block and one query block at a time.
    """
    def taken(df: DataFrame) -> DataFrame:
        rows = df.select(F.col("vec_id").cast("long").alias("vec_id"), weights(F.col("embedding")).alias("w"))
        return rows.filter("vec_id IS NOT NULL AND w IS NOT NULL").withColumn("key", F.monotonically_increasing_id())

    cands, asked = written(taken(vectors), "vectors"), written(taken(queries), "queries")
    n, values = cands.agg(F.count("*"), F.coalesce(F.sum(F.size("w")), F.lit(0))).first()
    blocks = max(1, round(n ** 0.5 / 4), -(-values // BLOCK_VALUES))
    qblocks = max(1, -(-asked.count() // QUERY_BLOCK))
    place = lambda many: F.pmod(F.xxhash64("key", F.lit(7)), F.lit(many)).cast("int")
    here = cands.select(place(blocks).alias("block"), F.array("vec_id").alias("ids"), F.array("key").alias("keys"),
                        F.array(F.size("w").cast("long")).alias("sizes"), F.col("w").alias("values"), F.lit(False).alias("asking"))
    asking = (packed(asked.withColumn("qblock", place(qblocks)), "qblock").drop("qblock")
              .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("asking", F.lit(True)))
    met = here.unionByName(asking).repartition("block").sortWithinPartitions("block", "asking", F.col("ids")[0])
    found = met.mapInArrow(lambda it: score_blocks(it, k), PARTIAL)
    order = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    merged = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return merged.select("query_id", "rank", "vec_id", "score")
