"""Operator 4: best-fit packing by minimum bin slack.

Documents are encoded in an Arrow function and cut into pieces; only lengths and
checksums come back. Bins depend on the pieces' lengths alone, and there are at
most ``CAPACITY`` different lengths, so the plan is made from their histogram,
which stays that small at any input size. Each bin starts with the longest piece
left; a subset-sum over the available lengths, kept as a bitset, finds the
fullest feasible rest, which is removed. The same combination is used as often
as its lengths last. The plan says which ranks of each length go to which bins,
and every piece looks up its place by its rank among the pieces of its length.

Cases: null text counts as empty and gives the one closing id; repeated rows and
null doc_id are documents of their own; very long documents become full pieces
and one rest; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import running_total, whole_text, written

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
CLOSING_ID = 1
CAPACITY = 4096
CACHED_WORDS = 500_000   # bound of a Python worker's cache, about 110 MB
JOINED = 100
GROUP_BYTES = 1 << 22
LETTERS = r"^\p{L}+[.,]?$"
STEP = 1 << 16
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED = PIECES + ", sequence_id long, offset long"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


@lru_cache(maxsize=2)
def known_words(path: str) -> dict[str, bytes]:
    """Ids of the words met by this Python worker."""
    return {"": b""}


@lru_cache(maxsize=2)
def odd_words(path: str) -> set[str]:
    """Words of letters that the normaliser takes apart; what follows may join their last part."""
    return set()


@lru_cache(maxsize=2)
def word_ends(path: str) -> np.ndarray:
    """By id: whether it ends a word."""
    vocabulary = tokenizer(path).get_vocab()
    ends = np.zeros(max(vocabulary.values()) + 1, bool)
    ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    return ends


def learn(words: list[str], path: str) -> None:
    """Encode words of letters only, many in a call, and note each one's ids.

    Such a word is one word to the tokenizer too, so the ids fall into words at
    the ids that end one. Where that gives another number of words, the odd
    ones are found by encoding one by one.
    """
    t, known, ends, odd = tokenizer(path), known_words(path), word_ends(path), odd_words(path)
    groups = [words[i:i + JOINED] for i in range(0, len(words), JOINED)]
    for group, e in zip(groups, t.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
        ids = np.array(e.ids, np.uint32)
        stops = (np.flatnonzero(ends[ids]) + 1) * 4
        if len(stops) != len(group):
            for word, alone in zip(group, t.encode_batch_fast(group, add_special_tokens=False), strict=True):
                known[word] = array("I", alone.ids).tobytes()
                if ends[alone.ids].sum() != 1:
                    odd.add(word)
            continue
        data, start = ids.tobytes(), 0
        for word, stop in zip(group, stops.tolist(), strict=True):
            known[word] = data[start:stop]
            start = stop


def dealt(ids: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The ids of the given entries of a list in a row; the list's entries hold ``sizes`` of the ids."""
    n = sizes[codes]
    begins = (np.cumsum(sizes) - sizes)[codes] - (np.cumsum(n) - n)
    return ids[np.repeat(begins, n) + np.arange(n.sum())]


def known_ids(words: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """The ids of distinct words without blanks in a row, and each word's number of ids; those not met before are encoded in batches.

    Letters are looked up apart from a full stop or comma behind them, which is a word of its
    own to the tokenizer, and ASCII letters in the lower case it gives them. Arrow takes such words
    apart, so that Python sees only the distinct cores.
    """
    t, known, odd = tokenizer(path), known_words(path), odd_words(path)
    if len(odd) > CACHED_WORDS:
        known.clear()
        odd.clear()
    if len(known) > CACHED_WORDS:  # the half that came first goes
        for word in list(islice(known, len(known) // 2)):
            del known[word]
    known[""] = b""
    plain = pc.match_substring_regex(words, LETTERS)
    at = np.flatnonzero(plain.to_numpy(zero_copy_only=False))
    tailed = words.filter(plain)
    cores = pc.ascii_lower(pc.ascii_rtrim(tailed, ".,")).dictionary_encode()
    codes, names = cores.indices.to_numpy(), cores.dictionary.to_pylist()
    learn([word for word in (*names, ".", ",") if word not in known], path)
    entry, tail = np.full(len(words), -1), np.zeros(len(words), np.int64)
    entry[at] = codes
    for k, mark in enumerate(".,", 1):
        tail[at[pc.ends_with(tailed, mark).to_numpy(zero_copy_only=False)]] = k
    if odd:
        apart = at[np.array([name in odd for name in names], bool)[codes]]
        entry[apart], tail[apart] = -1, 0
    rest = np.flatnonzero(entry < 0)
    others = words.take(pa.array(rest)).to_pylist()
    entry[rest] = len(names) + np.arange(len(rest))
    new = [word for word in others if word not in known]
    for word, e in zip(new, t.encode_batch_fast(new, add_special_tokens=False), strict=True):
        known[word] = array("I", e.ids).tobytes()
    found = [known[word] for word in [*names, *others, "", ".", ","]]
    sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
    tail += len(found) - 3
    ids = dealt(np.frombuffer(b"".join(found), np.uint32), sizes, np.stack([entry, tail], 1).ravel())
    return ids, sizes[entry] + sizes[tail]


def encoded(texts: list[str] | pa.Array, path: str = TOKENIZER) -> list[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers.

    The tokenizer drops white space and never merges across it, so a text's ids
    are its words' ids in a row. Arrow splits the texts and numbers their distinct
    words; only those are looked up, and their ids are dealt to the places of the
    words with numpy, ``STEP`` words at a time.
    """
    texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
    split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
    words = split.flatten().dictionary_encode()
    ids, sizes = known_ids(words.dictionary, path)
    codes, ends = words.indices.to_numpy(), np.zeros(len(words) + 1, np.int64)
    np.cumsum(sizes[codes], out=ends[1:])
    first = np.cumsum(sizes) - sizes
    out = np.empty(ends[-1], np.uint32)
    for at in range(0, len(codes), STEP):
        some, to = codes[at:at + STEP], ends[at:at + STEP + 1]
        begins = first[some] - to[:-1]
        out[to[0]:to[-1]] = ids[np.repeat(begins, np.diff(to)) + np.arange(to[0], to[-1])]
    data, cuts = out.tobytes(), split.offsets.to_numpy()
    stops = (4 * ends[cuts - cuts[0]]).tolist()
    return [data[a:b] for a, b in zip(stops, stops[1:])]


def cut(ids: bytes, capacity: int = CAPACITY) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's pieces."""
    step = 4 * capacity
    for piece, at in enumerate(range(0, len(ids), step)):
        part = ids[at:at + step]
        yield piece, at // 4, len(part) // 4, zlib.crc32(part)


def piece_batches(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    closing = array("I", [CLOSING_ID]).tobytes()
    for batch in batches:
        ids, texts = batch.column("doc_id").to_pylist(), batch.column("text")
        sizes = pc.binary_length(texts).to_pylist()
        at = 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held < GROUP_BYTES):
                held += sizes[end]
                end += 1
            rows = [(doc, *p) for doc, found in zip(ids[at:end], encoded(texts.slice(at, end - at), path), strict=True)
                    for p in cut(found + closing, capacity)]
            columns = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
            at = end


def pieces(docs: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return texts.mapInArrow(lambda it: piece_batches(it, path, capacity), PIECES)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The lengths, with multiplicities, of the largest sum up to ``room``.

    Bit s of ``reach`` says that the lengths seen so far, longest first, can sum
    to s. Multiplicities are split into powers of two. The search ends early when
    the room can be filled exactly.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        left, part = min(counts[length], room // length), 1
        while left and not reach >> room & 1:
            take = min(part, left)
            steps.append((reach, length, take))
            reach |= reach << (length * take) & mask
            left, part = left - take, part * 2
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[dict[int, int], int]]:
    """(lengths with multiplicities, number of bins filled like that)."""
    counts, out = dict(histogram), []
    for longest in sorted(histogram, reverse=True):
        while longest in counts:
            counts[longest] -= 1
            rest = {n: c for n, c in counts.items() if c and n <= capacity - longest}
            chosen = fullest(rest, capacity - longest)
            counts[longest] += 1
            chosen[longest] = chosen.get(longest, 0) + 1
            times = min(counts[n] // m for n, m in chosen.items())
            out.append((chosen, times))
            for n, m in chosen.items():
                counts[n] -= m * times
                if not counts[n]:
                    del counts[n]
    return out


def slots(plan: list[tuple[dict[int, int], int]]) -> dict[int, np.ndarray]:
    """By length: rows (first rank, first bin, pieces per bin, offset in the bin), ranks ascending."""
    used, out, first_bin = {}, {}, 0
    for chosen, times in plan:
        offset = 0
        for length in sorted(chosen, reverse=True):
            many = chosen[length]
            out.setdefault(length, []).append((used.get(length, 0), first_bin, many, offset))
            used[length] = used.get(length, 0) + many * times
            offset += many * length
        first_bin += times
    return {n: np.array(rows, dtype=np.int64) for n, rows in out.items()}


def place_batches(batches: Iterator[pa.RecordBatch], table: dict[int, np.ndarray]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
        sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
        order = np.argsort(length, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
            if len(rows):
                n = int(length[rows[0]])
                slot = table[n][np.searchsorted(table[n][:, 0], rank[rows], side="right") - 1]
                past = rank[rows] - slot[:, 0]
                sequence[rows] = slot[:, 1] + past // slot[:, 2]
                offset[rows] = slot[:, 3] + past % slot[:, 2] * n
        kept = [batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
        yield pa.RecordBatch.from_arrays(kept + [pa.array(sequence), pa.array(offset)],
                                         names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])


def pack(docs: DataFrame, path: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    cut_docs = written(pieces(docs, path, capacity), "pieces")
    by_length = cut_docs.groupBy("length").count().withColumnRenamed("count", "n")
    histogram = {r["length"]: r["n"] for r in by_length.collect()}  # at most ``capacity`` rows
    table = slots(bins(histogram, capacity))
    spread = F.xxhash64("doc_id", "piece", "ids_crc32")
    rows = cut_docs.withColumn("spread", spread).withColumn("one", F.lit(1).cast("long")).join(F.broadcast(by_length), "length")
    ranked = running_total(rows, "length", ["spread", "doc_id", "piece", "start", "ids_crc32"], "spread", "one", "rank", F.col("n"))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("rank") - 1).alias("rank"))
    return ranked.mapInArrow(lambda it: place_batches(it, table), PLACED)
