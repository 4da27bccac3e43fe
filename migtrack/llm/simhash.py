"""Operator 11: near duplicates by SimHash fingerprints and BK-trees.

Every text becomes a 64-bit fingerprint of its three-word shingles, repeats
included: a bit is set if it is set in over half of their hashes. Fingerprints
link at ``RADIUS`` or fewer differing bits, and links make components.

The distinct fingerprints of a large corpus fit no broadcast, so they are cut
into shards by content. Two that differ in 3 bits agree in one of 4 blocks of 16
bits, and then in one of 4 blocks of what is left, so a shard is what agrees
in such blocks, and every link has both ends in a shard. A shard is a BK-tree: the
children of a node are keyed by their integer Hamming distance to it, and a
search at distance d from a node follows only the edges from d - radius to d + radius.
A shard of more than ``CELL`` fingerprints is dealt into pieces, each a tree of its
own, and its pieces are copied to one another, two at a time, so that no task holds
more than two pieces. The trees of a task's shards are built and searched
together, level by level, as arrays. What leaves a task is not its links but, for
each set of linked fingerprints, a tree over it whose nodes have at most ``FAN`` children.

Cases: null text counts as empty; texts without words have fingerprint 0 and
link like any other; one or two words are one shingle; rows that repeat, or share a
doc_id, are rows of their own; null doc_id is in no component's name unless the
component has no other (then null); an empty table gives no rows; other columns do not matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lookup, whole_text, written
from .components import components

WIDTH = 3
SEED = 42
RADIUS = 3
CELL = 4096            # fingerprints of a shard's piece
FAN = 64
GROUP_ROWS = 1 << 16   # rows that a task searches at a time, give or take a cell
FRONTIER = 1 << 21     # bound of (search, node) pairs held at a time
PART_BYTES = 1 << 20   # long texts are hashed part by part
PER_SHARD = 64         # fingerprints that a shard should hold on average
_BLANK = re.compile(rb"[\x20\x09-\x0D]")


# --- fingerprints ------------------------------------------------------------

def parts(data: bytes, size: int = PART_BYTES) -> Iterator[bytes]:
    """The text in parts of about ``size`` bytes, cut at blanks."""
    at = 0
    while at < len(data):
        cut = _BLANK.search(data, at + size) if at + size < len(data) else None
        end = cut.start() if cut else len(data)
        yield data[at:end]
        at = end


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 of every ``width`` words in a row, joined by one space."""
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - width + 1
    slices = map(joined.__getitem__, map(slice, starts[:n].tolist(), ends[width - 1:].tolist()))
    return np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in slices), np.uint64, n)


def fingerprint(text: str, width: int = WIDTH) -> int:
    """The SimHash of a whole text."""
    ones, n, held = np.zeros(64, np.int64), 0, []
    for part in parts(text.encode().lower()):
        words = held + part.split()
        held = words
        if len(words) >= width:
            h = shingle_hashes(words, width)
            bits = np.unpackbits(h.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, 64)
            ones += bits.sum(axis=0, dtype=np.int64)
            n += len(h)
            held = words[len(words) - width + 1:]
    if not n:
        return xxhash.xxh64_intdigest(b" ".join(held), SEED) if held else 0
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py()) for t in batch.column("text")), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return texts.mapInArrow(print_batches, "doc_id long, fp long")


# --- shards ------------------------------------------------------------------

def blocks(bits: list[int], n: int) -> list[list[int]]:
    """``bits`` in n runs of nearly equal length."""
    cuts = [len(bits) * i // n for i in range(n + 1)]
    return [bits[a:b] for a, b in zip(cuts, cuts[1:])]


def masks(radius: int, n: int) -> list[int]:
    """Bit masks such that two fingerprints within ``radius`` agree under one of them.

    Of radius + 1 blocks one is free of differences. If n fingerprints would fill such shards
    too much, the rest is cut once more in the same way.
    """
    every = list(range(64))
    first = blocks(every, radius + 1)
    if n <= PER_SHARD << min(map(len, first)):
        found = first
    else:
        found = [b + more for b in first for more in blocks([i for i in every if i not in b], radius + 1)]
    return [sum(1 << i for i in b) for b in found]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def shard_keys(fp: Column, radius: int, n: int) -> Column:
    """The shards of a fingerprint, one a mask. A collision of two keys only makes a shard of two."""
    return F.array(*[F.xxhash64(F.lit(i), fp.bitwiseAND(F.lit(signed(m)))) for i, m in enumerate(masks(radius, n))])


def cells(prints: DataFrame, radius: int, n: int) -> DataFrame:
    """key, i, j, tree, fp: pieces i and j of a shard meet; ``tree`` marks those of piece i."""
    members = written(prints.select("fp", F.explode(shard_keys(F.col("fp"), radius, n)).alias("key")), "members")
    sizes = written(members.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "sizes")
    dealt = lookup(members, sizes, "key", "n").withColumn("pieces", F.ceil(F.col("n") / CELL).cast("int"))
    dealt = dealt.withColumn("own", F.pmod(F.xxhash64("fp", "key"), F.col("pieces")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
    i = F.least("own", "other")
    return dealt.select("key", i.alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") == i).alias("tree"), "fp")


# --- BK-trees ----------------------------------------------------------------

def ranges(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low[0] .. high[0] - 1, low[1] .. high[1] - 1, ... end to end."""
    many = high - low
    return np.arange(int(many.sum())) + np.repeat(low - (np.cumsum(many) - many), many)


class Forest:
    """The BK-trees of many shards as arrays: node x is row x, its fingerprint ``fp[x]``.

    ``tree`` numbers the tree of each row, ascending; a tree's fingerprints are distinct. The first row is the root.
    """

    def __init__(self, tree: np.ndarray, fp: np.ndarray):
        self.fp = fp
        self.roots, back, self.sizes = np.unique(tree, return_index=True, return_inverse=True, return_counts=True)[1:]
        parent, edge = np.full(len(fp), -1), np.zeros(len(fp), np.int64)
        at = self.roots[back]
        rows = np.flatnonzero(at != np.arange(len(fp)))
        while len(rows):  # all rows below a node come to it together; the first at a distance becomes its child there
            far = np.bitwise_count(fp[rows] ^ fp[at[rows]]).astype(np.int64)
            _, first, back = np.unique(at[rows] * 65 + far, return_index=True, return_inverse=True)
            child = rows[first]
            parent[child], edge[child] = at[child], far[first]
            at[rows] = child[back]
            rows = rows[at[rows] != rows]
        kids = np.flatnonzero(parent >= 0)
        keys = parent[kids] * 65 + edge[kids]
        order = np.argsort(keys, kind="stable")
        self.kids, self.keys = kids[order], keys[order]

    def near(self, asks: np.ndarray, tree: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(index in ``asks``, node) of all that are within ``radius`` in the asked tree, some at a time."""
        held = np.cumsum(self.sizes[tree]) // FRONTIER
        for part in np.split(np.arange(len(asks)), np.flatnonzero(np.diff(held)) + 1):
            ask, node = part, self.roots[tree[part]]
            while len(ask):
                far = np.bitwise_count(asks[ask] ^ self.fp[node]).astype(np.int64)
                hit = far <= radius
                yield ask[hit], node[hit]
                low = np.searchsorted(self.keys, node * 65 + np.maximum(far - radius, 0))
                high = np.searchsorted(self.keys, node * 65 + np.minimum(far + radius, 64), side="right")
                ask, node = np.repeat(ask, high - low), self.kids[ranges(low, high)]


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after joining the sets of a[i] and b[i]; a label is its set's smallest row."""
    while True:
        a, b = label[a], label[b]
        apart = a != b
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label = label[label]


def fan_edges(fp: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect every set: member i to member (i - 1) // FAN, so that none has many."""
    order = np.argsort(label, kind="stable")
    first = np.searchsorted(label[order], label[order])
    i = np.arange(len(order)) - first
    below = i > 0
    up = first + np.maximum(i - 1, 0) // FAN
    return fp[order[below]], fp[order[up[below]]]


def cell_links(cell: np.ndarray, tree: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the linked fingerprints of each cell; the rows of a cell stand together, its tree's first.

    Cells of one piece ask for their own rows, cells of two for those of the other piece.
    """
    inside = np.flatnonzero(tree)
    single = np.ones(int(cell[-1]) + 1, bool)
    single[cell[~tree]] = False
    ask = np.flatnonzero(~tree | single[cell])
    numbers, place = np.unique(cell[inside], return_inverse=True)
    known = np.searchsorted(numbers, cell[ask])
    met = (known < len(numbers)) & (numbers[np.minimum(known, len(numbers) - 1)] == cell[ask]) if len(numbers) else np.zeros(len(ask), bool)
    ask, known = ask[met], known[met]
    label = np.arange(len(fp))
    if len(ask):
        for found, node in Forest(place, fp[inside]).near(fp[ask], known, radius):
            label = union(label, ask[found], inside[node])
    return fan_edges(fp, label)


def link_batches(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by cell, its tree first; cells are searched together, ``GROUP_ROWS`` or so at a time."""
    def searched(rows: pa.Table) -> pa.RecordBatch:
        key, i, j, fp = (rows.column(c).to_numpy() for c in ("key", "i", "j", "fp"))
        tree = rows.column("tree").to_numpy().astype(bool)
        new = np.zeros(len(fp), bool)
        new[1:] = (key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        a, b = cell_links(np.cumsum(new), tree, fp.view(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def cell_of(rows: pa.Table, at: int) -> tuple:
        return tuple(rows.column(c)[at].as_py() for c in ("key", "i", "j"))

    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        if sum(b.num_rows for b in held) < GROUP_ROWS:
            continue
        rows = pa.Table.from_batches(held)
        key, i, j = (rows.column(c).to_numpy() for c in ("key", "i", "j"))
        last = (key == key[-1]) & (i == i[-1]) & (j == j[-1])  # the last cell may go on
        cut = int(np.argmax(last))
        if cut:
            yield searched(rows.slice(0, cut))
        held = rows.slice(cut).to_batches()
    if held:
        yield searched(pa.Table.from_batches(held))


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges a, b whose components are those of all links between the distinct fingerprints ``fp``."""
    met = cells(prints, radius, prints.count())
    met = met.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", F.col("tree").desc(), "fp")
    return met.mapInArrow(lambda it: link_batches(it, radius), "a long, b long").distinct()


def near_components(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (hexadecimal), component_id, component_size (documents)."""
    rows = written(fingerprints(docs), "fingerprints")
    prints = written(rows.groupBy("fp").agg(F.min("doc_id").alias("low"), F.count("*").alias("n")), "prints")
    edges = written(links(prints.select("fp"), radius), "edges")
    ends = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    labels = components(edges, written(ends.select("node", F.col("node").alias("label")), "labels"))
    named = written(prints.join(labels, F.col("fp") == F.col("node"), "left")
                    .select("fp", "low", "n", F.coalesce("label", "fp").alias("label")), "named")
    heads = written(named.groupBy("label").agg(F.min("low").alias("component_id"), F.sum("n").alias("component_size"),
                                               F.count("*").alias("prints")), "heads")
    found = written(lookup(named.select("fp", "n", "label"), heads, "label", "prints")
                    .select("fp", "n", "component_id", "component_size"), "found")
    return lookup(rows, found, "fp", "n").select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "component_size")
