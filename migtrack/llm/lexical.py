"""Operator 13: ranked lexical search with range-maximum tables per posting list.

One pass over the documents counts the items' terms; the corpus's numbers (N, L and
each term's df) are sums over it. Documents are then searched in shards, as the
tasks read them. A shard holds a posting list per term, in document order, with the impact
of each posting, the amount it adds to a score, and a sparse table for range
maxima over it. An item's search keeps intervals of documents, best first; an
interval's bound is the sum of its terms' range maxima. The best interval is split at the
document where the term that adds most to the bound has its maximum; that document is
scored whole, and the two sides go back with their own bounds. The search
ends when no bound reaches the item's lowest kept score, which lasts from shard to shard of a task. An interval of
at most ``FEW`` postings is scored out at once.

The items are a query set: their terms are taken to the tasks in blocks of at most
``BLOCK_TERMS``, each block with a search of its own, so what is sent at once is
bounded however many items there are. Each task's best are merged per item in two steps.

Cases: null and empty texts have no terms, and neither count in N nor are found; an item
without terms, or without a matching document, has no rows; items that repeat are answered
each; rows that repeat, or share a doc_id, are documents of their own; null doc_id ranks
last among equal scores; an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import whole_text, written

K = 50
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLOCK_TERMS = 500_000        # different terms of the items that are searched for at a time
SHARD_POSTINGS = 1_000_000   # about 100 MB of lists and tables
SHARD_DOCUMENTS = 1 << 16
FEW = 4096                   # postings of an interval that are scored without splitting it
LAST = (1 << 63) - 1
POSTINGS = "doc_id long, size long, terms array<int>, counts array<long>"
HITS = "item int, doc_id long, score long, task long"
_TERM = re.compile(TERM)


def terms_of(text: str) -> list[str]:
    return _TERM.findall(text.translate(LOWER))


# --- one pass over the texts ---------------------------------------------------

def posting_batches(batches: Iterator[pa.RecordBatch], known: dict[str, int]) -> Iterator[pa.RecordBatch]:
    """Each document's number of terms, and which of the known ones it has how often."""
    for batch in batches:
        sizes, terms, counts = [], [], []
        for text in batch.column("text"):
            found = terms_of(text.as_py())
            sizes.append(len(found))
            held = Counter(map(known.get, found))
            held.pop(None, None)
            terms.append(list(held))
            counts.append(list(held.values()))
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(counts, pa.list_(pa.int64()))],
            names=["doc_id", "size", "terms", "counts"])


def postings(docs: DataFrame, known: dict[str, int]) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return texts.mapInArrow(lambda it: posting_batches(it, known), POSTINGS).filter("size > 0")


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


# --- a shard -------------------------------------------------------------------

class Shard:
    """Posting lists of some documents, end to end by term, with range-maximum tables.

    ``keys``: term * documents + place, ascending; ``impact``: what the posting adds to a score;
    ``best[j][i]``: where the largest impact of postings i .. i + 2**j - 1 stands.
    """

    def __init__(self, term: np.ndarray, place: np.ndarray, impact: np.ndarray, doc_id: np.ndarray):
        order = np.lexsort((place, term))
        self.n, self.doc_id = len(doc_id), doc_id
        self.keys, self.place, self.impact = (term * self.n + place)[order], place[order], impact[order]
        longest = int(np.bincount(term).max()) if len(term) else 0
        self.best = [np.arange(len(order), dtype=np.int32)]
        while 2 << len(self.best) - 1 <= longest:
            low, step = self.best[-1], 1 << len(self.best) - 1
            a, b = low[:-step], low[step:]
            top = low.copy()  # the last ones would reach past the end and are never asked for
            top[:len(a)] = np.where(self.impact[b] > self.impact[a], b, a)
            self.best.append(top)
        self.tables = np.stack(self.best)
        self.levels = np.zeros(longest + 2, np.int64)
        for i in range(2, longest + 1):
            self.levels[i] = self.levels[i // 2] + 1

    def top(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Where the largest impact of each non-empty range of postings stands."""
        level = self.levels[high - low]
        a, b = self.tables[level, low], self.tables[level, high - (1 << level)]
        return np.where(self.impact[b] > self.impact[a], b, a)

    def search(self, terms: np.ndarray, kept: list[tuple[int, int]], k: int) -> None:
        """Bring ``kept``, a heap of the k best (score, -doc_id) so far, up to date with this shard."""
        low = np.searchsorted(self.keys, terms * self.n)
        high = np.searchsorted(self.keys, (terms + 1) * self.n)
        queue: list[tuple] = []

        def offer(place: int, score: int) -> None:
            entry = (score, -int(self.doc_id[place]))
            if score > 0 and len(kept) < k:
                heapq.heappush(kept, entry)
            elif score > 0 and entry > kept[0]:
                heapq.heapreplace(kept, entry)

        def push(terms: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
            some = high > low
            if not some.any():
                return
            terms, low, high = terms[some], low[some], high[some]
            at = self.top(low, high)
            bound = int(self.impact[at].sum())
            if len(kept) == k and bound < kept[0][0]:
                return
            heapq.heappush(queue, (-bound, len(low), id(low), terms, low, high, at))

        push(terms, low, high)
        while queue:
            bound, _, _, terms, low, high, at = heapq.heappop(queue)
            if len(kept) == k and -bound < kept[0][0]:
                break  # an equal bound may still hide a smaller doc_id
            if (high - low).sum() <= FEW:
                found = np.concatenate([np.arange(a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True)])
                places, back = np.unique(self.place[found], return_inverse=True)
                scores = np.zeros(len(places), np.int64)
                np.add.at(scores, back, self.impact[found])
                least = max(kept[0][0] if len(kept) == k else 1, int(np.partition(scores, -k)[-k]) if len(scores) > k else 1)
                for i in np.flatnonzero(scores >= least).tolist():
                    offer(int(places[i]), int(scores[i]))
                continue
            split = int(self.place[at[np.argmax(self.impact[at])]])
            cut = np.searchsorted(self.keys, terms * self.n + split)
            there = (cut < high) & (self.place[np.minimum(cut, len(self.place) - 1)] == split)
            offer(split, int(self.impact[cut[there]].sum()))
            push(terms, low, cut)
            push(terms, cut + there, high)


def shard_of(rows: list[tuple], weights: np.ndarray, n: int, length: int) -> Shard:
    """``rows``: (doc_id, size, terms, counts) of some documents."""
    many = [len(r[2]) for r in rows]
    place = np.repeat(np.arange(len(rows)), many)
    term = np.concatenate([np.asarray(r[2], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    count = np.concatenate([np.asarray(r[3], np.int64) for r in rows]) if rows else np.zeros(0, np.int64)
    norm = np.array([100 - 50 + (50 * r[1] * n) // length for r in rows], np.int64)
    impact = weights[term] * ((1_000_000_000 * count) // (1000 * count + 20 * norm[place]))
    doc_id = np.array([LAST if r[0] is None else r[0] for r in rows], np.int64)
    return Shard(term, place, impact, doc_id)


def search_batches(batches: Iterator[pa.RecordBatch], items: list[np.ndarray], weights: np.ndarray, n: int, length: int,
                   k: int, most: int) -> Iterator[pa.RecordBatch]:
    """The k best documents of the task for every item."""
    kept: list[list[tuple[int, int]]] = [[] for _ in items]
    rows, held = [], 0

    def searched() -> None:
        shard = shard_of(rows, weights, n, length)
        for terms, best in zip(items, kept, strict=True):
            shard.search(terms, best, k)

    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "size", "terms", "counts")), strict=True):
            if row[2]:
                rows.append(row)
                held += len(row[2])
            if held >= most or len(rows) >= SHARD_DOCUMENTS:
                searched()
                rows, held = [], 0
    if rows:
        searched()
    hits = [(i, -doc, score) for i, best in enumerate(kept) for score, doc in best]
    item, doc, score = zip(*hits, strict=True) if hits else ((), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array(doc, pa.int64()), pa.array(score, pa.int64())],
                                     names=["item", "doc_id", "score"])


# --- items and merge -------------------------------------------------------------

def item_blocks(items: DataFrame, most: int = BLOCK_TERMS) -> Iterator[list[tuple[int, list[str]]]]:
    """The items as (item_id, different terms), in blocks of at most ``most`` different terms (or one item)."""
    block, seen = [], set()
    for row in items.select(F.col("item_id").cast("long").alias("item_id"), whole_text().alias("text")).toLocalIterator():
        terms = sorted(set(terms_of(row["text"])))
        if block and len(seen.union(terms)) > most:
            yield block
            block, seen = [], set()
        if terms:
            block.append((row["item_id"], terms))
            seen.update(terms)
    if block:
        yield block


def best(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of every item with their rank; tasks are merged in groups first, so no item's hits meet all at once."""
    order = [F.col("score").desc(), F.col("doc_id").asc(), F.col("task")]
    some = hits.withColumn("part", F.pmod("task", F.lit(64)))
    some = some.withColumn("rank", F.row_number().over(Window.partitionBy("item", "part").orderBy(*order))).filter(F.col("rank") <= k)
    return some.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(*order))).filter(F.col("rank") <= k)


def search_block(docs: DataFrame, block: list[tuple[int, list[str]]], k: int, most: int) -> DataFrame:
    spark = docs.sparkSession
    known = {t: i for i, t in enumerate(sorted({t for _, terms in block for t in terms}))}
    found = written(postings(docs, known), "postings")
    n, length = found.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    counted = found.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    weights = np.zeros(len(known), np.int64)
    for row in counted.toLocalIterator():  # at most one row per term of the block
        weights[row["term"]] = weight(n, row["df"])
    items = [np.array(sorted(known[t] for t in terms), np.int64) for _, terms in block]
    hits = found.mapInArrow(lambda it: search_batches(it, items, weights, n, length, k, most), "item int, doc_id long, score long")
    hits = written(hits.withColumn("task", F.spark_partition_id().cast("long")), "hits")
    names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item int, item_id long")
    return best(hits, k).join(names, "item").select(
        "item_id", "rank", F.when(F.col("doc_id") != LAST, F.col("doc_id")).alias("doc_id"), "score")


def search(docs: DataFrame, items: DataFrame, k: int = K, block_terms: int = BLOCK_TERMS,
           shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the ``k`` best documents with a score above 0 of every item."""
    out = docs.sparkSession.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for block in item_blocks(items, block_terms):
        out = out.unionByName(written(search_block(docs, block, k, shard_postings), "found"))
    return out
