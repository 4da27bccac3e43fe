"""Operator 13 against scoring every document, and its shards against plain sums."""

import heapq
import math
import re

import numpy as np
import pytest
from helpers import CLASHING, awkward, docs

from migtrack.llm import lexical

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(texts, ids, items, k=50):
    split = [terms(t) for t in texts]
    n, length = sum(bool(s) for s in split), sum(map(len, split))
    out = []
    for item_id, query in items:
        hits = []
        weights = {}
        for t in set(terms(query)):
            df = sum(t in s for s in split)
            weights[t] = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
        for doc, s in zip(ids, split, strict=True):
            if s:
                m = 100 - 50 + (50 * len(s) * n) // length
                score = sum(w * ((10 ** 9 * s.count(t)) // (1000 * s.count(t) + 20 * m)) for t, w in weights.items())
                if score > 0:
                    hits.append((-score, doc is None, doc))
        out += [(item_id, i + 1, doc, -score) for i, (score, _, doc) in enumerate(sorted(hits, key=lambda h: (h[0], h[1], h[2] or 0))[:k])]
    return out


def items_of(spark, items):
    from pyspark.sql import functions as F
    df = spark.createDataFrame(items, "item_id long, text string")
    return df.withColumns({c: F.lit("x") for c in (*CLASHING, "rank", "doc_id", "terms", "item")})


def key(row):
    return tuple((x is None, x) for x in row)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=key)


def corpus(rng, n, words=300):
    weights = 1 / np.arange(1, words + 1)
    return [" ".join(f"w{x}" for x in rng.choice(words, rng.integers(1, 120), p=weights / weights.sum())) for _ in range(n)]


ITEMS = [(0, "the quick brown fox"), (1, None), (2, ""), (3, "W1 w2, w2 w3!"), (4, "nowhere_to-be found"), (5, "한국어 É é w250"), (5, "seven wizards"),
         (6, " ".join(f"w{i}" for i in range(40)))]


@pytest.mark.parametrize("postings,block", [(1_000_000, 500_000), (300, 500_000), (1000, 6)])
def test_search_equals_scoring_all(spark, postings, block):
    texts = corpus(np.random.default_rng(postings), 400) + awkward(2000) + ["The QUICK brown-fox"] * 60
    ids = [None if i == 17 else i % 430 for i in range(len(texts))]
    got = found(lexical.search(docs(spark, texts, ids), items_of(spark, ITEMS), block_terms=block, shard_postings=postings))
    assert got == sorted(brute(texts, ids, ITEMS), key=key)


@pytest.mark.parametrize("few", [1, 64, 4096])
def test_a_shards_search_equals_plain_sums(monkeypatch, few):
    monkeypatch.setattr(lexical, "FEW", few)
    rng = np.random.default_rng(few)
    for _ in range(30):
        docs_n, terms_n = int(rng.integers(1, 200)), int(rng.integers(1, 12))
        full = rng.integers(0, 9, (terms_n, docs_n)) * (rng.random((terms_n, docs_n)) < 0.4)
        term, place = np.nonzero(full)
        doc_id = rng.permutation(docs_n)
        shard = lexical.Shard(term, place, full[term, place].astype(np.int64), doc_id)
        asked = rng.choice(terms_n, int(rng.integers(1, terms_n + 1)), replace=False)
        kept = []
        shard.search(np.sort(asked), kept, 7)
        sums = full[asked].sum(axis=0)
        want = heapq.nlargest(7, ((int(s), -int(d)) for s, d in zip(sums, doc_id, strict=True) if s > 0))
        assert sorted(kept, reverse=True) == want


def test_range_maxima():
    rng = np.random.default_rng(3)
    lists = [rng.integers(0, 50, n) for n in (1, 2, 33, 64, 7)]
    term = np.repeat(np.arange(5), [len(x) for x in lists])
    place = np.concatenate([np.arange(len(x)) for x in lists])
    shard = lexical.Shard(term, place, np.concatenate(lists), np.arange(64))
    start = 0
    for x in lists:
        for a in range(len(x)):
            for b in range(a + 1, len(x) + 1):
                at = int(shard.top(np.array([start + a]), np.array([start + b]))[0])
                assert start + a <= at < start + b and shard.impact[at] == x[a:b].max()
        start += len(x)


def test_search_leaves_most_documents_unscored(monkeypatch):
    """The bounds prune: a rare strong term settles the search long before every document is scored."""
    monkeypatch.setattr(lexical, "FEW", 16)
    rng = np.random.default_rng(1)
    n = 20_000
    common, rare = np.arange(n), np.sort(rng.choice(n, 60, replace=False))
    term = np.concatenate([np.zeros(n, np.int64), np.ones(60, np.int64)])
    impact = np.concatenate([rng.integers(1, 100, n), rng.integers(1000, 2000, 60)])
    shard = lexical.Shard(term, np.concatenate([common, rare]), impact, np.arange(n))
    asked, top = [], shard.top
    shard.top = lambda low, high: asked.append(len(low)) or top(low, high)
    kept = []
    shard.search(np.array([0, 1]), kept, 50)
    assert len(kept) == 50 and len(asked) < n / 20


def test_item_blocks(spark):
    items = items_of(spark, ITEMS)
    blocks = list(lexical.item_blocks(items, 5))
    assert [i for b in blocks for i, _ in b] == [0, 3, 4, 5, 5, 6]
    assert all(len(b) == 1 or len({t for _, ts in b for t in ts}) <= 5 for b in blocks)


def test_empty_tables(spark):
    out = lexical.search(docs(spark, []), items_of(spark, ITEMS))
    assert out.columns == ["item_id", "rank", "doc_id", "score"] and out.count() == 0
    assert lexical.search(docs(spark, ["a b"]), items_of(spark, [])).count() == 0
    assert lexical.search(docs(spark, [None, "", "--"]), items_of(spark, ITEMS)).count() == 0
