import hashlib
import random
import re

from helpers import CLASHING, PROSE, awkward, docs, rows_of

from migtrack.llm import exact_dedup as X


def brute(texts, ids):
    shas = [hashlib.sha256(re.sub(r"[\x20\x09-\x0D]+", " ", t or "").encode()).hexdigest() for t in texts]
    low = {}
    for i, s in zip(ids, shas, strict=True):
        low[s] = min(low.get(s, 10**18), 10**18 if i is None else i)
    return [(i, None if low[s] == 10**18 else low[s], shas.count(s), s) for i, s in zip(ids, shas, strict=True)]


def test_groups_equal_brute_force(spark):
    rng = random.Random(1)
    texts = awkward() + [rng.choice([" ", "\n", "  ", " "]).join(rng.choice("ab") for _ in range(rng.randint(0, 4))) for _ in range(400)]
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    got = X.groups(docs(spark, texts, ids=ids)).collect()
    assert sorted((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == sorted(brute(texts, ids))
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_ties_and_null_ids_keep_one_row(spark):
    texts = [PROSE] * 30 + [None, ""] * 5
    got = X.groups(docs(spark, texts, ids=[3] * 20 + [None] * 20)).collect()
    by = {}
    for r in got:
        by.setdefault(r["text_sha256"], []).append(r)
    assert sorted((len(x), sum(r["kept"] for r in x), {r["keep_id"] for r in x}) for x in by.values()) == [(10, 1, {None}), (30, 1, {3})]


def test_deduplicated_keeps_columns(spark):
    df = docs(spark, [PROSE, PROSE, " ", "  ", None, "a", "a"], ids=[2, 2, 8, 7, 5, None, None])
    out = X.deduplicated(df)
    assert out.columns == df.columns and set(CLASHING) < set(out.columns)
    assert sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str) == [(2, PROSE), (5, None), (7, "  "), (None, "a")]


def test_empty_table(spark):
    assert X.groups(docs(spark, [])).count() == 0 and X.deduplicated(docs(spark, [])).count() == 0


def digest(i):
    return hashlib.sha256(str(i).encode()).digest()


def test_index_against_a_dict():
    """Random inserts and deletions through overflow and resizing."""
    rng, index, want = random.Random(2), X.CuckooIndex(buckets=4), {}
    for _ in range(20_000):
        d, doc = digest(rng.randint(0, 3000)), rng.randint(0, 10**6)
        if rng.random() < 0.7:
            assert index.add(d, (doc, doc, 1, 1)) == (d not in want)
            want[d] = X.merge(want[d], (doc, doc, 1, 1)) if d in want else (doc, doc, 1, 1)
        else:
            assert index.remove(d) == (d in want)
            if d in want:
                held = want.pop(d)
                if held[2] > 1:
                    want[d] = (held[0], held[1], held[2] - 1, held[3])
    assert dict(index.entries()) == want
    assert all(index.find(digest(i)) == want.get(digest(i)) for i in range(4000))
    assert sum(map(len, index.tags)) == len(want) and len(index.tags) > 4
    assert all(len(t) == len(c) <= X.BUCKET and bytes(t) == bytes(d[0] or 1 for d, _ in c) for t, c in zip(index.tags, index.content, strict=True))


def test_equal_fingerprints_are_told_apart_by_their_digests():
    """Digests that agree in fingerprint and buckets, so that only their content tells them apart."""
    alike = [b"\x07" + b"\x01" * 8 + bytes([i]) * 23 for i in range(6)]
    index = X.CuckooIndex(buckets=64)
    assert all(index.add(d, (i, i, 1, 1)) for i, d in enumerate(alike))
    assert [index.find(d)[0] for d in alike] == list(range(6)) and index.find(b"\x07" + b"\x01" * 8 + b"z" * 23) is None
    assert index.remove(alike[2]) and index.find(alike[2]) is None and index.find(alike[3])[0] == 3


def test_many_digests_in_one_shard():
    n = 60_000
    index = X.CuckooIndex()
    for i in range(n):
        index.add(digest(i), (i, i, 1, 1))
    assert all(index.find(digest(i)) == (i, i, 1, 1) for i in range(0, n, 7)) and index.find(digest(n)) is None
    assert sum(map(len, index.content)) == n


def test_index_takes_deletions(spark):
    rows = [(digest(1), 5, 0, 1, 1), (digest(1), 4, 1, 1, 1), (digest(2), 9, 2, 1, 1)]
    index = X.build_index(spark.createDataFrame(rows, X.ENTRY))
    gone = spark.createDataFrame([(digest(2), 9, 2, -1, 1), (digest(1), 5, 0, -1, 1)], X.ENTRY)
    assert [tuple(r) for r in X.build_index(index.unionByName(gone)).collect()] == [(digest(1), 4, 1, 1, 1)]
