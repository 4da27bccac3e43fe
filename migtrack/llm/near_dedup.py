"""Operator 8: near-duplicate classes by ProbMinHash, banding and verification.

Each distinct text is a set of five-word shingles, weighted 1 + ln(count) by how often
the text holds them. Every shingle is a Poisson process whose rate is its weight: its points
arrive at exponential gaps and each falls on one of ``M`` components of the signature,
which keeps the shingle that arrives first. A shingle stops once its next point
would come after every component's first arrival. Two signatures agree in a
component with the probability Jaccard of the texts, the measure that decides on a
link; where no shingle repeats it is the Jaccard similarity of the sets.

Texts that agree in a band of ``ROWS`` components share a bucket. Its pivot is the
text that meets most others in all its buckets, as an original does among its
copies; the pivot is compared with the whole bucket, n comparisons for n texts.
Where a bucket still holds texts of different classes, those outside its largest
class are compared with all others. This runs in blocks of a bucket's texts inside
a task, so that no pair becomes a row unless it is a link: every link between
texts that share a bucket is implied by a class or was compared. Signatures rule out hopeless pairs; all
others are verified on their whole weighted sets: a link needs a probability Jaccard
of ``SIMILARITY``.

Cases: null text counts as empty; texts with the same words, also those without
words, are in one class whatever their blanks; a text of 1 to 4 words has one shingle;
rows that repeat, or share a doc_id, are rows of their own; null doc_id sorts last;
an empty table gives no rows; other columns are ignored, and kept by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text, written
from .components import components
from .shingles import GOLDEN, mixed, odd_numbers, shingle_sets, words_of

SIMILARITY = 0.8
BANDS, ROWS = 32, 5
M = BANDS * ROWS
LIKELY = 0.62         # signature agreement that a pair at SIMILARITY misses by chance with 1e-8 (5.7 sigma)
BLOCK = 256           # texts of a bucket that a task compares others with at a time
GROUP_CHARS = 1 << 21
LAST = (1 << 63) - 1
SIGNED = "doc_id long, text_key long, words_key binary, marks binary, bands array<long>"


def weights(count: np.ndarray) -> np.ndarray:
    """What a shingle weighs by how often the text holds it."""
    return 1 + np.log(count)


def signatures(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, m: int = M) -> np.ndarray:
    """(n, m) hashes of the shingles that arrive first; zeros for a document without shingles."""
    first = np.full(n * m, np.inf)
    winner = np.zeros(n * m, np.uint64)
    sizes = np.bincount(doc, minlength=n)
    alone = sizes[doc] == 1  # one shingle is first everywhere
    winner.reshape(n, m)[doc[alone]] = h[alone, None]
    active = np.flatnonzero(~alone)
    at = np.zeros(len(h))
    latest = np.full(n, np.inf)
    point = np.uint64(0)
    with np.errstate(over="ignore"):
        while len(active):
            draw = mixed(h[active] + GOLDEN * (point + np.uint64(1)))
            at[active] -= np.log(((draw >> np.uint64(11)) + 1.0) * 2.0 ** -53) / weight[active]
            active = active[at[active] < latest[doc[active]]]
            where = (mixed(h[active] + GOLDEN * (point + np.uint64(2))) % np.uint64(m)).astype(np.int64) + doc[active] * m
            np.minimum.at(first, where, at[active])
            won = first[where] == at[active]
            winner[where[won]] = h[active[won]]
            live = np.unique(doc[active])
            latest[live] = first.reshape(n, m)[live].max(axis=1)
            point += np.uint64(2)
    return winner.reshape(n, m)


def grouped(batches: Iterator[pa.RecordBatch], chars: int = GROUP_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of the batches with about ``chars`` characters of text each."""
    for batch in batches:
        texts, at = batch.column("text").to_pylist(), 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held < chars):
                held += len(texts[end])
                end += 1
            yield batch.slice(at, end - at), texts[at:end]
            at = end


def sign_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    turn = odd_numbers(ROWS, 1)
    for batch, texts in grouped(batches):
        lists = [words_of(t) for t in texts]
        doc, h, count = shingle_sets(lists)
        sig = signatures(doc, h, weights(count), len(texts))
        with np.errstate(over="ignore"):
            bands = mixed((sig.reshape(len(texts), BANDS, ROWS) * turn).sum(axis=2, dtype=np.uint64)
                          + np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN)
        some = np.bincount(doc, minlength=len(texts)) > 0
        marks = (sig >> np.uint64(56)).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([
            batch.column("doc_id"), batch.column("text_key"),
            pa.array([xxhash.xxh3_128_digest(b" ".join(x)) for x in lists], pa.binary()),
            pa.array([x.tobytes() for x in marks], pa.binary()),
            pa.array([x if ok else [] for x, ok in zip(bands.astype(np.int64), some, strict=True)], pa.list_(pa.int64()))],
            names=["doc_id", "text_key", "words_key", "marks", "bands"])


def first_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows without those of a repeated node that the task has seen."""
    seen = set()
    for batch in batches:
        keep = []
        for node, repeated in zip(batch.column("node").to_pylist(), batch.column("repeated").to_pylist(), strict=True):
            keep.append(not repeated or node not in seen)
            if repeated:
                seen.add(node)
        yield batch.filter(pa.array(keep, pa.bool_()))


def packed(h: np.ndarray, count: np.ndarray) -> bytes:
    """A text's sorted shingle hashes behind their number; their counts follow if one is above 1."""
    counts = count.astype(np.uint32).tobytes() if (count > 1).any() else b""
    return np.array([len(h)], np.uint64).tobytes() + h.tobytes() + counts


def unpacked(data) -> tuple[np.ndarray, np.ndarray | None]:
    """Hashes and weights (None: all 1) of what ``packed`` gave."""
    n = int(np.frombuffer(data, np.uint64, 1)[0])
    h, count = np.frombuffer(data, np.uint64, n, 8), np.frombuffer(data, np.uint32, -1, 8 + 8 * n) if len(data) > 8 + 8 * n else None
    return h, None if count is None else weights(count)


def set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in grouped(first_batches(batches)):
        doc, h, count = shingle_sets([words_of(t) for t in texts])
        cuts = np.searchsorted(doc, np.arange(len(texts) + 1))
        yield pa.RecordBatch.from_arrays([
            batch.column("node"), batch.column("repeated"), batch.column("marks"),
            pa.array([packed(h[a:b], count[a:b]) for a, b in zip(cuts, cuts[1:])], pa.binary())], names=["node", "repeated", "marks", "shingles"])


def likely_batches(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if batch.num_rows:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, M) for c in ("ma", "mb"))
            agree = ((x == y).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            yield batch.select(["a", "b"]).filter(pa.array(agree >= least))


def probability_jaccard(wx: np.ndarray, wy: np.ndarray, x_only: float, y_only: float) -> float:
    """Of two texts with the common shingles' weights ``wx`` and ``wy``, and the sums of the other weights.

    A common shingle adds 1 / sum over all shingles of the larger of their two weights, each in units of
    its own. The first text has the larger one where the ratio of weights is no larger than its own
    ratio, so sums in the order of the ratios give all terms at once.
    """
    order = np.argsort(wy / wx, kind="stable")
    wx, wy = wx[order], wy[order]
    last = np.searchsorted(wy / wx, wy / wx, side="right")
    first, second = np.append(0, np.cumsum(wx))[last], np.append(0, np.cumsum(wy))
    return float((1 / ((x_only + first) / wx + (y_only + second[-1] - second[last]) / wy)).sum())


def alike(a: tuple, b: tuple, least: float) -> bool:
    """Whether two texts, as sorted distinct hashes and weights (None: all 1), have a probability Jaccard of ``least``."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    (x, wx), (y, wy) = a, b
    if not len(x) or wx is None and wy is None and len(x) < least * len(y):
        return False
    at = np.searchsorted(y, x)
    at[at == len(y)] = 0
    same = y[at] == x
    if wx is None and wy is None:
        both = int(same.sum())
        return both >= least * (len(x) + len(y) - both) - 1e-9
    wx, wy = np.ones(len(x)) if wx is None else wx, np.ones(len(y)) if wy is None else wy
    cx, cy = wx[same], wy[at[same]]
    x_sum, y_sum = wx.sum(), wy.sum()
    if cx.sum() < least * x_sum - 1e-9 or cy.sum() < least * y_sum - 1e-9:  # both bound it from above
        return False
    return probability_jaccard(cx, cy, x_sum - cx.sum(), y_sum - cy.sum()) >= least - 1e-9


def similar_batches(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sides = zip(batch.column("sa"), batch.column("sb"), strict=True)
        keep = [alike(*(unpacked(s.as_buffer()) for s in pair), least) for pair in sides]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def block_batches(batches: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Links between the texts of a block and those that ask; rows by block, the block's own first."""
    held, own, marks = None, [], None
    for batch in batches:
        links = []
        for bucket, block, asking, node, label, minor, mark, shingles in zip(
                *(batch.column(c).to_pylist() for c in ("bucket", "block", "asking", "node", "label", "minor", "marks", "shingles")), strict=True):
            if (bucket, block) != held:
                held, own, marks = (bucket, block), [], None
            shingles = unpacked(shingles)
            if not asking:
                own.append((node, label, minor, np.frombuffer(mark, np.uint8), shingles))
                continue
            if not own:
                continue
            if marks is None:
                marks = np.stack([x[3] for x in own])
                nodes, labels, minors = (np.array([x[i] for x in own]) for i in range(3))
            agree = ((marks == np.frombuffer(mark, np.uint8)).mean(axis=1) - 1 / 256) / (1 - 1 / 256)
            # two that ask meet twice, so the smaller one asks
            for i in np.flatnonzero((agree >= LIKELY) & (labels != label) & (~minors | (nodes > node))):
                if alike(own[i][4], shingles, least):
                    links.append((node, int(nodes[i])))
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.int64()) for i in range(2)], names=["a", "b"])


def signed(docs: DataFrame) -> DataFrame:
    """Signature, bands and keys of every document under a row number, written to the shared folder."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(whole_text()).alias("text_key"),
                        whole_text().alias("text"))
    return written(texts.mapInArrow(sign_batches, SIGNED).withColumn("row", F.monotonically_increasing_id()), "signed")


def verified(pairs: DataFrame, data: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose weighted shingle sets are similar enough."""
    side = lambda x, c: data.select(F.col("node").alias(x), F.col(c).alias(c[0] + x))
    marked = pairs.join(side("a", "marks"), "a").join(side("b", "marks"), "b")
    likely = marked.mapInArrow(lambda it: likely_batches(it, LIKELY), "a long, b long")
    whole = likely.join(side("a", "shingles"), "a").join(side("b", "shingles"), "b")
    return whole.mapInArrow(lambda it: similar_batches(it, similarity), "a long, b long")


def one_per_node(data: DataFrame) -> DataFrame:
    """node, marks, shingles: one row per node."""
    repeated = written(data.filter("repeated").dropDuplicates(["node"]), "repeated")
    return data.filter("NOT repeated").unionByName(repeated).select("node", "marks", "shingles")


def labelled(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """row, doc_id, text_key, label: rows with one label are one class."""
    rows = signed(docs)
    nodes = written(rows.groupBy("words_key").agg(F.min("row").alias("node")), "nodes")  # one row per distinct text
    banded = rows.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select(
        F.col("row").alias("node"), F.explode("bands").alias("bucket"))
    sizes = banded.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = written(banded.join(sizes, "bucket"), "members")
    # buckets of the same texts count once
    same = members.groupBy("bucket").agg(F.bit_xor(F.xxhash64("node")).alias("who"), F.first("n").alias("n"))
    members = members.join(same.groupBy("who", "n").agg(F.min("bucket").alias("bucket")).select("bucket"), "bucket")
    meetings = members.groupBy("node").agg(F.sum("n").alias("meets"))
    central = F.max(F.struct("meets", (-F.col("node")).alias("minus"))).alias("c")
    pivots = members.join(meetings, "node").groupBy("bucket").agg(central).select("bucket", (-F.col("c.minus")).alias("pivot"))
    members = written(members.join(pivots, "bucket"), "pivots")

    met = members.select("node").distinct()
    wanted = rows.join(met, rows["row"] == met["node"]).select(
        F.coalesce("doc_id", F.lit(LAST)).alias("id"), "text_key", "node", "marks")
    # rows that repeat in doc_id and text are one node: one row of each task is kept, then one of all
    again = rows.groupBy(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "text_key").agg(F.count("*").alias("alike")).filter("alike > 1")
    wanted = wanted.join(again, ["id", "text_key"], "left").withColumn("repeated", F.col("alike").isNotNull())
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("id"),
                        F.xxhash64(whole_text()).alias("text_key"), whole_text().alias("text"))
    data = written(texts.join(wanted, ["id", "text_key"]).select("node", "repeated", "marks", "text")
                   .mapInArrow(set_batches, "node long, repeated boolean, marks binary, shingles binary"), "shingles")
    data = one_per_node(data)

    stars = members.filter("node <> pivot").select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct()
    labels = written(met.select("node", F.col("node").alias("label")), "labels")
    labels = components(written(verified(stars, data, similarity), "links"), labels)

    rest = members.filter("n > 2 AND node <> pivot").join(labels, "node")
    classes_in = rest.groupBy("bucket", "label").agg(F.count("*").alias("many"))
    largest = classes_in.groupBy("bucket").agg(F.max(F.struct("many", "label")).alias("top"), F.count("*").alias("classes"))
    rest = rest.join(largest.filter("classes > 1").select("bucket", F.col("top.label").alias("main")), "bucket")
    blocks = F.ceil(F.col("n") / BLOCK).cast("int")
    rest = rest.select("bucket", "node", "label", (F.col("label") != F.col("main")).alias("minor"), blocks.alias("blocks"))
    here = rest.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).withColumn("asking", F.lit(False))
    ask = (rest.filter("minor").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
           .withColumn("asking", F.lit(True)))
    met_again = (here.unionByName(ask).join(data, "node").repartition("bucket", "block")
                 .sortWithinPartitions("bucket", "block", "asking"))
    more = met_again.mapInArrow(lambda it: block_batches(it, similarity), "a long, b long")
    labels = components(written(more.distinct(), "links"), labels)

    own = nodes.join(labels, "node", "left").select("words_key", F.coalesce("label", "node").alias("label"))
    return rows.join(own, "words_key").select("row", "doc_id", "text_key", "label")


def classes(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per document: doc_id, class_id (smallest doc_id of its class), class_size, kept."""
    rows = written(labelled(docs, similarity), "labelled")
    heads = rows.groupBy("label").agg(
        F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "row")).alias("head"), F.count("*").alias("class_size"))
    return rows.join(heads, "label").select(
        "doc_id", F.when(F.col("head.id") != LAST, F.col("head.id")).alias("class_id"), "class_size",
        (F.col("row") == F.col("head.row")).alias("kept"))


def deduplicated(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The first document of every class, with its own columns."""
    rows = written(labelled(docs, similarity), "labelled")
    head = F.min(F.struct(F.coalesce("doc_id", F.lit(LAST)).alias("id"), "row", "text_key")).alias("h")
    heads = rows.groupBy("label").agg(head).select(F.col("h.id").alias("__id"), F.col("h.text_key").alias("__text"))
    alike = (rows.select(F.coalesce("doc_id", F.lit(LAST)).alias("__id"), F.col("text_key").alias("__text"))
             .join(heads, ["__id", "__text"]).groupBy("__id", "__text").agg(F.count("*").alias("__alike")))
    found = (docs.withColumn("__id", F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)))
             .withColumn("__text", F.xxhash64(whole_text())).join(alike, ["__id", "__text"]))
    once, again = found.filter("__alike = 1"), found.filter("__alike > 1").dropDuplicates(["__id", "__text"])
    return once.unionByName(again).select(*docs.columns)
