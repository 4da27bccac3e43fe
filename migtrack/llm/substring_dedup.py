"""Operator 6: substring dedup by matching statistics against suffix automata.

A window is ``WINDOW`` consecutive words. A word goes when a window that covers
it also starts in a document with a smaller doc_id. An automaton of the whole
corpus fits no broadcast, and streaming every document past every shard of it
would cost the square of the corpus. So shards are cut by content, and only text
that can match meets a shard:

1. Each window has a minimizer, the smallest hash among its runs of ``GRAM``
   words; equal windows have equal minimizers. Consecutive windows with the same
   minimizer form a stretch. Only stretches whose minimizer occurs in two or more
   documents can hold a match.
2. A shard is the set of distinct stretches of one minimizer, each with the
   smallest doc_id it occurs in. Its suffix automaton is built in doc_id order;
   each stretch is streamed for matching statistics first, so that every window
   gets the smallest doc_id it occurs in. The one stretch of a shard that has no other is the
   same words everywhere; its windows first occur where it does.
   A minimizer of more than ``SHARD`` stretches, a phrase in many surroundings, is cut
   again: its stretches are the documents of a new search whose minimizers are longer
   runs of words (``GRAMS``), which the surroundings tell apart; the last run is a whole window.
3. The marks go back to the documents, spans of marked words are removed.

Stretches are told apart by two hashes of 64 bits, of the minimizer and of all
their words; the automaton compares words. Joins on minimizers and stretches, which a common
phrase may make hot, are salted.

Cases: null text has no words; texts shorter than a window keep every word; rows
that repeat, or share a doc_id, never remove each other's words, as neither
doc_id is smaller; null doc_id counts as larger than all others; texts without
words keep nothing and give the hash of the empty string; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lookup, salted, whole_text, written
from .near_dedup import grouped
from .shingles import GOLDEN, mixed, odd_numbers, window_hashes, word_hashes, words_of

WINDOW = 13
GRAMS = (5, 9, 13)
SHARD = 1000
LAST = (1 << 63) - 1
STRETCHES = "doc long, node long, key long, seq long, spot long"
# a spot is the first window's place times SPAN plus the number of windows
SPAN = 16


def stretches(lists: list[list[bytes]], window: int = WINDOW, gram: int = GRAMS[0]):
    """(text, first window, windows, minimizer, hash of all words) of every stretch."""
    words, ends = word_hashes(lists)
    sizes = np.diff(ends, prepend=0)
    best = window_hashes(words, gram, 2)
    least, at = best.copy(), np.arange(len(best))
    for j in range(1, min(window - gram + 1, len(best))):  # leftmost smallest of the window's runs
        less = best[j:] < least[:len(best) - j]
        where = np.flatnonzero(less)
        least[where], at[where] = best[where + j], where + j
    doc = np.repeat(np.arange(len(lists)), sizes)
    place = np.flatnonzero(np.arange(len(words)) + window <= ends[doc])
    doc, chosen = doc[place], at[place]
    first = np.ones(len(place), bool)
    first[1:] = (chosen[1:] != chosen[:-1]) | (doc[1:] != doc[:-1])
    head = np.flatnonzero(first)
    n = np.diff(head, append=len(place))
    start = place[head]
    # hash of words start .. start + n + window - 2 from running sums of word * base ** place
    base = odd_numbers(1, 5)
    power = np.ones(len(words) + 1, np.uint64)
    np.multiply.accumulate(np.broadcast_to(base, len(words)), out=power[1:])
    back = np.ones(len(words) + 1, np.uint64)
    inverse = np.uint64(pow(int(base[0]), -1, 1 << 64))
    np.multiply.accumulate(np.full(len(words), inverse), out=back[1:])
    sums = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * power[:-1], out=sums[1:])
    seq = mixed((sums[start + n + window - 1] - sums[start]) * back[start] + n.astype(np.uint64) * GOLDEN)
    return doc[head], start - (ends - sizes)[doc[head]], n, best[chosen[head]], seq


def stretch_batches(batches: Iterator[pa.RecordBatch], gram: int) -> Iterator[pa.RecordBatch]:
    for batch, texts in grouped(batches):
        with np.errstate(over="ignore"):
            text, at, n, key, seq = stretches([words_of(t) for t in texts], gram=gram)
        doc, node = (batch.column(c).to_numpy() for c in ("doc", "node"))
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (doc[text], node[text], key.view(np.int64), seq.view(np.int64), at * SPAN + n)],
            names=["doc", "node", "key", "seq", "spot"])


class Automaton:
    """Generalised suffix automaton; each state knows the first document that reached it."""

    def __init__(self):
        self.next, self.link, self.length, self.first = [{}], [-1], [0], [-1]

    def extend(self, last: int, word, doc: int) -> int:
        """Append a word after state ``last``; the new last state."""
        nxt, link, length, first = self.next, self.link, self.length, self.first
        if word in nxt[last]:
            q = nxt[last][word]
            return q if length[q] == length[last] + 1 else self._clone(last, word, q)
        new = self._state({}, length[last] + 1, doc)
        p = last
        while p != -1 and word not in nxt[p]:
            nxt[p][word] = new
            p = link[p]
        if p == -1:
            link[new] = 0
        else:
            q = nxt[p][word]
            link[new] = q if length[q] == length[p] + 1 else self._clone(p, word, q)
        return new

    def _state(self, following: dict, length: int, doc: int) -> int:
        self.next.append(following)
        self.link.append(0)
        self.length.append(length)
        self.first.append(doc)
        return len(self.next) - 1

    def _clone(self, p: int, word, q: int) -> int:
        copy = self._state(dict(self.next[q]), self.length[p] + 1, self.first[q])
        self.link[copy], self.link[q] = self.link[q], copy
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def statistics(self, words: list, least: int) -> list[int | None]:
        """By end place: the first document that holds the ``least`` words ending here, if any does."""
        out, state, matched = [], 0, 0
        for word in words:
            while state and word not in self.next[state]:
                state = self.link[state]
                matched = self.length[state]
            if word in self.next[state]:
                state = self.next[state][word]
                matched += 1
            if matched >= least:
                while self.length[self.link[state]] >= least:
                    state = self.link[state]
                    matched = self.length[state]
                out.append(self.first[state])
            else:
                out.append(None)
        return out


def first_documents(shard: list[tuple[int, list]], window: int = WINDOW) -> list[list[int]]:
    """For stretches (doc, words) of one shard: the smallest doc of each of their windows."""
    automaton, out = Automaton(), [[]] * len(shard)
    for i in sorted(range(len(shard)), key=lambda i: shard[i][0]):
        doc, words = shard[i]
        found = automaton.statistics(words, window)[window - 1:]
        out[i] = [doc if d is None else d for d in found]
        state = 0
        for word in words:
            state = automaton.extend(state, word, doc)
    return out


def shard_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by minimizer and stretch; a minimizer is a shard of at most ``SHARD`` stretches."""
    def solved(rows):
        firsts = first_documents([(doc, words.split(b" ")) for _, _, doc, words in rows])
        return [(key, seq, f) for (key, seq, _, _), f in zip(rows, firsts, strict=True)]

    def out(rows):
        key, seq, firsts = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(key, pa.int64()), pa.array(seq, pa.int64()), pa.array(firsts, pa.list_(pa.int64()))],
            names=["key", "seq", "firsts"])

    shard, done = [], []
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("key", "seq", "doc", "words")), strict=True):
            if shard and shard[-1][:2] == row[:2]:
                continue  # the same stretch from a repeated row
            if shard and shard[-1][0] != row[0]:
                done += solved(shard)
                shard = []
                if len(done) >= 10_000:
                    yield out(done)
                    done = []
            shard.append(row)
    if shard:
        done += solved(shard)
    if done:
        yield out(done)


def words_batches(batches: Iterator[pa.RecordBatch], window: int = WINDOW) -> Iterator[pa.RecordBatch]:
    """The words of the wanted stretches of each text; of texts that repeat, the first of the task gives them."""
    seen = set()
    for batch in batches:
        rows = []
        for node, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("node", "text", "wanted")), strict=True):
            if node in seen:
                continue
            seen.add(node)
            words = words_of(text)
            for w in wanted:
                at, n = divmod(w["spot"], SPAN)
                rows.append((w["key"], w["seq"], w["n_seq"], w["doc"], b" ".join(words[at:at + n + window - 1])))
        if rows:
            columns = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)],
                names=["key", "seq", "n_seq", "doc", "words"])


def removal_batches(batches: Iterator[pa.RecordBatch], texts: bool, window: int = WINDOW) -> Iterator[pa.RecordBatch]:
    """Remove the marked spans of each text; a mark is (first window of a stretch, bits of its windows)."""
    for batch in batches:
        out = []
        for doc, text, marks in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "marks")), strict=True):
            words, kept, upto, removed = words_of(text), [], 0, []
            for m in sorted(marks or [], key=lambda m: m["at"]):
                for i in range(SPAN):
                    if m["bits"] >> i & 1:
                        a = m["at"] + i
                        if a + window > len(words):
                            continue
                        if removed and a <= removed[-1][1]:
                            removed[-1][1] = max(removed[-1][1], a + window)
                        else:
                            removed.append([a, a + window])
            for a, b in removed:
                kept += words[upto:a]
                upto = b
            kept += words[upto:]
            body = b" ".join(kept)
            out.append((doc, len(words), len(words) - len(kept), [x for span in removed for x in span],
                        hashlib.sha256(body).hexdigest(), body.decode() if texts else None))
        columns = list(zip(*out, strict=True)) if out else [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                         names=["doc_id", "n_words", "n_removed", "spans", "kept_sha256", "kept"])


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, doc (its place in the order), node (hash of the row) and text."""
    doc_id = F.col("doc_id").cast("long")
    rows = docs.select(doc_id.alias("doc_id"), F.coalesce(doc_id, F.lit(LAST)).alias("doc"), whole_text().alias("text"))
    return rows.withColumn("node", F.xxhash64("doc", "text"))


def solved(rows: DataFrame, grams: tuple[int, ...] = GRAMS) -> tuple[DataFrame, DataFrame]:
    """Of texts (doc, node, text): stretches that may match, and ``key, seq, n, firsts``: per window the first document."""
    found = rows.select("doc", "node", "text").mapInArrow(lambda it: stretch_batches(it, grams[0]), STRETCHES)
    held = written(found.groupBy("key").agg(F.min("doc").alias("low"), F.max("doc").alias("high"), F.count("*").alias("n"))
                   .filter("low < high").select("key", "n"), "held")
    shared = written(salted(found, held, "key", "n").select("doc", "node", "key", "seq", "spot"), "shared")

    # any occurrence gives the words of a stretch
    distinct = written(shared.groupBy("key", "seq").agg(
        F.min("doc").alias("doc"), F.first("node").alias("node"), F.first("spot").alias("spot"), F.count("*").alias("n")), "distinct")
    sizes = written(distinct.groupBy("key").agg(F.count("*").alias("n_seq")), "sizes")
    distinct = lookup(distinct, sizes, "key", "n_seq")
    alone = distinct.filter("n_seq = 1").select(
        "key", "seq", F.array_repeat("doc", (F.col("spot") % SPAN).cast("int")).alias("firsts"))

    wanted = (distinct.filter("n_seq > 1").groupBy("node")
              .agg(F.collect_list(F.struct("key", "seq", "n_seq", "doc", "spot")).alias("wanted")))
    words = rows.join(wanted, "node").select("node", "text", "wanted").mapInArrow(
        words_batches, "key long, seq long, n_seq long, doc long, words binary")
    words = written(words, "words")
    last = len(grams) == 1
    small = ((words if last else words.filter(F.col("n_seq") <= SHARD)).repartition("key").sortWithinPartitions("key", "seq")
             .mapInArrow(shard_batches, "key long, seq long, firsts array<long>"))
    firsts = alone.unionByName(small)
    large = words.filter(F.col("n_seq") > SHARD)
    if not last and not large.isEmpty():
        firsts = firsts.unionByName(recut(large, grams[1:]))
    counted = distinct.select("key", "seq", "n")
    return shared, written(firsts.join(counted, ["key", "seq"]), "firsts")


def recut(large: DataFrame, grams: tuple[int, ...]) -> DataFrame:
    """key, seq, firsts of stretches that are too many for a shard, searched as documents with longer minimizers."""
    large = large.dropDuplicates(["key", "seq"])  # the same words from repeated rows
    large = written(large.select("key", "seq", "doc", F.col("words").cast("string").alias("text")).withColumn("node", F.xxhash64("key", "seq")), "large")
    shared, firsts = solved(large, grams)
    own = salted(shared, firsts, ["key", "seq"], "n").groupBy("node").agg(
        F.collect_list(F.struct(F.floor(F.col("spot") / SPAN).alias("at"), "firsts")).alias("found"))
    windows = F.sequence(F.lit(0), F.size(F.split("text", " ")) - WINDOW)
    part = lambda i: F.get(F.filter("found", lambda f: (f["at"] <= i) & (i < f["at"] + F.size(f["firsts"]))), F.lit(0))
    # a window in no part of a shared minimizer is its document's own
    first = F.transform(windows, lambda i: F.coalesce(F.get(part(i)["firsts"], (i - part(i)["at"]).cast("int")), F.col("doc")))
    return large.join(own, "node", "left").select("key", "seq", first.alias("firsts"))


def marks(docs: DataFrame) -> DataFrame:
    """node, marks: the windows of each document that a smaller document holds too."""
    shared, firsts = solved(keyed(docs))
    bits = F.aggregate(F.sequence(F.lit(1), F.size("firsts")), F.lit(0), lambda s, i: s + F.when(
        F.element_at("firsts", i) < F.col("doc"), F.call_function("shiftleft", F.lit(1), i - 1)).otherwise(0))
    marked = (salted(shared, firsts, ["key", "seq"], "n")
              .select("node", F.floor(F.col("spot") / SPAN).alias("at"), bits.alias("bits")).filter("bits > 0"))
    # a set, as rows that repeat in doc_id and text are one node with the same marks
    return marked.groupBy("node").agg(F.collect_set(F.struct("at", "bits")).alias("marks"))


def deduplicated(docs: DataFrame, texts: bool = True) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, spans (word places), kept_sha256, kept text."""
    found = written(marks(docs), "marks")
    rows = keyed(docs).join(found, "node", "left").select("doc_id", "text", "marks")
    return rows.mapInArrow(lambda it: removal_batches(it, texts), "doc_id long, n_words long, n_removed long, "
                           "spans array<long>, kept_sha256 string, kept string")
