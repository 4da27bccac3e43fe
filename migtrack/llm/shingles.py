"""Words and shingles of whole texts as hashed numpy arrays, for use inside Arrow functions."""

from __future__ import annotations

from itertools import chain

import numpy as np
import xxhash

WIDTH = 5
GOLDEN = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit moves every output bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def odd_numbers(n: int, seed: int) -> np.ndarray:
    """n fixed odd multipliers."""
    return mixed(np.arange(1, n + 1, dtype=np.uint64) * GOLDEN + np.uint64(seed)) | np.uint64(1)


def words_of(text: str) -> list[bytes]:
    """Runs of characters other than the six ASCII blanks, as UTF-8."""
    return text.encode().split()


def word_hashes(lists: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """All words' hashes end to end, and where each list ends."""
    ends = np.cumsum([len(x) for x in lists], dtype=np.int64)
    n = int(ends[-1]) if len(ends) else 0
    return np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(lists)), np.uint64, n), ends


def window_hashes(words: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of the ``width`` words from each place on; places near the end see fewer words."""
    out = np.zeros(len(words), np.uint64)
    for j, c in enumerate(odd_numbers(width, seed)[:len(words)]):
        out[:len(words) - j] += words[j:] * c
    return mixed(out)


def shingle_sets(lists: list[list[bytes]], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, count) of the distinct shingles, by document and hash.

    A text with 1 to ``width`` - 1 words has one shingle, all its words; a text without
    words has none.
    """
    words, ends = word_hashes(lists)
    sizes = np.diff(ends, prepend=0)
    doc = np.repeat(np.arange(len(lists)), sizes)
    place = np.arange(len(words))
    whole = place + width <= ends[doc]
    out = window_hashes(words, width) if len(words) else words
    short = np.flatnonzero((sizes > 0) & (sizes < width))
    for d in short:  # few words: hashed by themselves, apart from what follows
        at = ends[d] - sizes[d]
        out[at] = window_hashes(words[at:ends[d]], width)[0] ^ GOLDEN
        whole[at] = True
    doc, out = doc[whole], out[whole]
    order = np.lexsort((out, doc))
    doc, out = doc[order], out[order]
    first = np.ones(len(out), bool)
    first[1:] = (out[1:] != out[:-1]) | (doc[1:] != doc[:-1])
    at = np.flatnonzero(first)
    return doc[at], out[at], np.diff(at, append=len(out))
