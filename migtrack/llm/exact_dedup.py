"""Operator 9: exact dedup with a cuckoo-filter index of live digests.

Each text is normalised (every run of blanks becomes one space) and digested in
the JVM. Digests are counted per input partition first, so that a group of
copies reaches its shard as one entry per partition, then go by digest to
shards. A shard is a cuckoo filter: a digest has a one-byte fingerprint and two buckets of four
places, and each place holds the fingerprint together with the digest it stands for. If
neither bucket has the fingerprint, the digest is new; where one has, the digest in that place
decides. An overflow doubles the filter from the stored keys. Entries can be deleted,
which is how documents leave a live index. The number of shards follows the number of rows.

Cases: null text counts as empty and empty texts equal each other; rows that
agree in doc_id and text are copies too and one of them stays; null doc_id sorts
after all others; an empty table gives no rows; other columns, also ones named
like the result's, do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, lookup, whole_text, written

BUCKET = 4          # entries in a bucket of the filter
MAX_KICKS = 200     # displacements before the filter counts as full
SHARD_ROWS = 250_000  # rows to a shard, about 100 MB if all their digests differ
LAST = (1 << 63) - 1
FIELDS = ["digest", "doc", "row", "n", "ties"]
ENTRY = "digest binary, doc long, row long, n long, ties long"


class CuckooIndex:
    """Live digests, each with its first row and the number of its copies.

    ``tags[b]`` are the fingerprints in bucket b, ``content[b]`` the digests there with (doc, row, n, ties): the
    smallest doc_id, the smallest row number at that doc_id, the copies, and how
    many of them share that doc_id. Nothing else is kept.
    """

    def __init__(self, buckets: int = 1024):
        self.state = 1
        self._empty(buckets)

    def _empty(self, buckets: int) -> None:
        self.mask = buckets - 1
        self.tags = [bytearray() for _ in range(buckets)]
        self.content: list[list[tuple[bytes, tuple[int, int, int, int]]]] = [[] for _ in range(buckets)]

    def _places(self, digest: bytes) -> tuple[int, int, int]:
        tag = digest[0] or 1
        first = int.from_bytes(digest[1:9], "little") & self.mask
        return tag, first, self._other(first, tag)

    def _other(self, place: int, tag: int) -> int:
        return (place ^ (tag * 0x5BD1E995)) & self.mask

    def _where(self, digest: bytes) -> tuple[int, int] | None:
        """Bucket and place of a live digest. Buckets without its fingerprint are not looked into."""
        tag, a, b = self._places(digest)
        for bucket in (a, b) if a != b else (a,):
            at = self.tags[bucket].find(tag)
            while at >= 0:
                if self.content[bucket][at][0] == digest:
                    return bucket, at
                at = self.tags[bucket].find(tag, at + 1)
        return None

    def find(self, digest: bytes) -> tuple[int, int, int, int] | None:
        at = self._where(digest)
        return None if at is None else self.content[at[0]][at[1]][1]

    def add(self, digest: bytes, entry: tuple[int, int, int, int]) -> bool:
        """Insert, or merge with the live entry; True if the digest is new."""
        at = self._where(digest)
        if at is not None:
            bucket = self.content[at[0]]
            bucket[at[1]] = (digest, merge(bucket[at[1]][1], entry))
            return False
        self._insert([(digest, entry)])
        return True

    def remove(self, digest: bytes, n: int = 1) -> bool:
        """Take ``n`` copies out; the digest leaves the filter with its last copy."""
        at = self._where(digest)
        if at is None:
            return False
        bucket, place = at
        doc, row, many, ties = self.content[bucket][place][1]
        if many > n:
            self.content[bucket][place] = (digest, (doc, row, many - n, ties))
        else:
            del self.tags[bucket][place]
            del self.content[bucket][place]
        return True

    def entries(self) -> Iterator[tuple[bytes, tuple[int, int, int, int]]]:
        return chain.from_iterable(self.content)

    def _insert(self, waiting: list) -> None:
        """Place digests that are not live; on overflow the filter is doubled and filled from its own entries."""
        while waiting:
            homeless = self._place(waiting.pop())
            if homeless is not None:
                waiting += [homeless, *self.entries()]
                self._empty(2 * (self.mask + 1))

    def _place(self, held: tuple) -> tuple | None:
        """Put an entry into one of its buckets, moving others on; the entry that finds no place, if any."""
        tag, a, b = self._places(held[0])
        for place in (a, b):
            if len(self.tags[place]) < BUCKET:
                self.tags[place].append(tag)
                self.content[place].append(held)
                return None
        place = a
        for _ in range(MAX_KICKS):
            self.state = (self.state * 1664525 + 1013904223) & 0xFFFFFFFF
            victim = (self.state >> 16) % BUCKET
            tag, self.tags[place][victim] = self.tags[place][victim], tag
            held, self.content[place][victim] = self.content[place][victim], held
            place = self._other(place, tag)
            if len(self.tags[place]) < BUCKET:
                self.tags[place].append(tag)
                self.content[place].append(held)
                return None
        return held


def merge(x: tuple, y: tuple) -> tuple[int, int, int, int]:
    if x[0] == y[0]:
        return x[0], min(x[1], y[1]), x[2] + y[2], x[3] + y[3]
    low = min(x, y)
    return low[0], low[1], x[2] + y[2], low[3]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)


def _entries(entries: dict) -> Iterator[pa.RecordBatch]:
    keys = list(entries)
    for i in range(0, len(keys), 20_000):
        part = keys[i:i + 20_000]
        columns = [pa.array(part, pa.binary())]
        columns += [pa.array([entries[k][j] for k in part], pa.int64()) for j in range(4)]
        yield pa.RecordBatch.from_arrays(columns, names=FIELDS)


def combine(batches: Iterator[pa.RecordBatch], most: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Map side: one entry per digest and flush; at most ``most`` digests are held at a time."""
    seen: dict[bytes, tuple[int, int, int, int]] = {}
    for digest, *entry in _rows(batches):
        held = seen.get(digest)
        seen[digest] = tuple(entry) if held is None else merge(held, tuple(entry))
        if len(seen) >= most:
            yield from _entries(seen)
            seen = {}
    yield from _entries(seen)


def index_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One shard: every entry goes through the cuckoo index; its live entries come out."""
    index, gone = CuckooIndex(), []
    for digest, *entry in _rows(batches):
        if entry[2] < 0:
            gone.append((digest, -entry[2]))
        else:
            index.add(digest, tuple(entry))
    for digest, n in gone:
        index.remove(digest, n)
    yield from _entries(dict(index.entries()))


def normalised(text: Column) -> Column:
    return F.regexp_replace(text, BLANK, " ")


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text), 256))


def ordered(doc_id: Column) -> Column:
    """doc_id as the index compares it: null comes last."""
    return F.coalesce(doc_id.cast("long"), F.lit(LAST))


def build_index(entries: DataFrame, rows: int | None = None) -> DataFrame:
    """The live index (digest, doc, row, n, ties) of rows of the same columns.

    A row with negative ``n`` deletes that many copies once all inserts of its
    shard are in, so an index is updated by building it from its own rows and
    the changes.
    """
    parts = entries.select(*FIELDS).mapInArrow(combine, ENTRY)
    shards = max(int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-(entries.count() if rows is None else rows) // SHARD_ROWS))
    return parts.repartition(shards, "digest").mapInArrow(index_shard, ENTRY)


def digest_rows(docs: DataFrame) -> DataFrame:
    """doc_id, digest and a row number of every document, written to the shared folder."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest_of(whole_text()).alias("digest"))
    return written(rows.withColumn("row", F.monotonically_increasing_id()), "digests")


def index_of(rows: DataFrame) -> DataFrame:
    one = F.lit(1).cast("long")
    return build_index(rows.select("digest", ordered(F.col("doc_id")).alias("doc"), "row",
                                   one.alias("n"), one.alias("ties")), rows.count())


def groups(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = digest_rows(docs)
    index = written(index_of(rows).withColumnRenamed("row", "keep_row"), "index")
    return lookup(rows, index, "digest", "n").select(
        "doc_id", F.when(F.col("doc") != LAST, F.col("doc")).alias("keep_id"),
        F.col("n").alias("group_size"), (F.col("row") == F.col("keep_row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their own columns."""
    key, order = "__digest", "__order"
    index = written(index_of(digest_rows(docs)), "index")
    keep = index.select(F.col("digest").alias(key), F.col("doc").alias(order), F.col("ties").alias("__ties"))
    found = (docs.withColumn(key, digest_of(whole_text())).withColumn(order, ordered(F.col("doc_id")))
             .join(keep, [key, order]))
    once = found.filter("__ties = 1")
    # rows alike in doc_id and text: any one of them
    again = found.filter("__ties > 1").dropDuplicates([key])
    return once.unionByName(again).select(*docs.columns)
