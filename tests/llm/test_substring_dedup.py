import hashlib
import random

import pytest
from helpers import PROSE, awkward, docs, rows_of

from migtrack.llm import substring_dedup as S

W = S.WINDOW


def brute(texts, ids):
    order = [10**18 if i is None else i for i in ids]
    lists = [(t or "").encode().split() for t in texts]
    first = {}
    for i, w in zip(order, lists, strict=True):
        for a in range(len(w) - W + 1):
            key = tuple(w[a:a + W])
            first[key] = min(i, first.get(key, i))
    out = []
    for i, w in zip(order, lists, strict=True):
        gone = {x for a in range(len(w) - W + 1) if first[tuple(w[a:a + W])] < i for x in range(a, a + W)}
        body = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((len(w), len(gone), hashlib.sha256(body).hexdigest(), body.decode()))
    return out


def same(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    got = S.deduplicated(docs(spark, texts, ids=ids)).collect()
    key = lambda i, x: (i is None, i or 0, x)
    assert sorted((key(r["doc_id"], (r["n_words"], r["n_removed"], r["kept_sha256"], r["kept"])) for r in got)) == sorted(
        key(i, x) for i, x in zip(ids, brute(texts, ids), strict=True))
    return got


def random_texts(n, seed, vocabulary=12):
    rng = random.Random(seed)
    passages = [" ".join(rng.choice(PROSE.split()) for _ in range(rng.randint(5, 40))) for _ in range(8)]
    own = lambda: " ".join(f"v{rng.randint(0, vocabulary)}" for _ in range(rng.randint(0, 25)))
    return [" ".join(rng.choice([own(), rng.choice(passages)]) for _ in range(rng.randint(0, 6))) for _ in range(n)]


@pytest.mark.parametrize("shard", [1000, 2])
def test_equals_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(S, "SHARD", shard)  # 2: most shards are cut again, by 9 words and by 13
    same(spark, random_texts(250, 1) + random_texts(100, 2, vocabulary=1))


def test_awkward_texts_ties_and_nulls(spark):
    texts = awkward(3000)
    texts = [*texts, *texts, PROSE + " " + PROSE, None]
    ids = [None, 5, 5, 3, 3, 9, 9, 9, 2, 2, 1, 4, 6, *range(20, 33), None, None]
    got = same(spark, texts, ids)
    assert any(r["spans"] for r in got)


def test_empty_table(spark):
    assert S.deduplicated(docs(spark, [])).count() == 0


def test_automaton_statistics_equal_search():
    rng = random.Random(9)
    for _ in range(300):
        shard = [(rng.randint(0, 6), [rng.choice("ab") for _ in range(rng.randint(4, 12))]) for _ in range(5)]
        shard.sort()
        want = [[min(d for d, w in shard for j in range(len(w) - 3) if w[j:j + 4] == words[i:i + 4])
                 for i in range(len(words) - 3)] for _, words in shard]
        assert S.first_documents(shard, 4) == want


def test_spans_are_maximal(spark):
    rows = rows_of(S.deduplicated(docs(spark, [PROSE, "start here " + PROSE + " end there"])), "doc_id")
    n = len(PROSE.split())
    assert rows[0]["spans"] == [] and rows[1]["spans"] == [2, 2 + n] and rows[1]["kept"] == "start here end there"


def test_a_phrase_in_many_surroundings_is_cut_again(spark, monkeypatch):
    """One minimizer with many stretches, among them long common phrases that the second cut can't tell apart."""
    monkeypatch.setattr(S, "SHARD", 20)
    rng = random.Random(3)
    own = lambda n: " ".join(f"u{rng.randint(0, 10**6)}" for _ in range(n))
    common = {n: " ".join(f"c{n}_{i}" for i in range(n)) for n in (6, 12, 16)}
    texts = [f"{own(rng.randint(0, 9))} {common[n]} {own(rng.randint(0, 9))}" for n in common for _ in range(120)]
    rng.shuffle(texts)
    same(spark, texts)


def test_many_equal_rows_cost_no_square(spark):
    """Rows that repeat in doc_id and text beside one match (time grows with their number, not its square)."""
    text = " ".join(f"w{i}" for i in range(301))
    match = "own words " + " ".join(f"w{i}" for i in range(100, 140))
    got = S.deduplicated(docs(spark, [match] + [text] * 4000, ids=[1] + [None] * 4000)).groupBy("doc_id", "n_words", "n_removed").count().collect()
    assert sorted(map(str, got)) == sorted(["Row(doc_id=1, n_words=42, n_removed=0, count=1)", "Row(doc_id=None, n_words=301, n_removed=40, count=4000)"])
