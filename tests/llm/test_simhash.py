"""Operator 11 against brute force: fingerprints, links within the radius, components."""

import numpy as np
import pytest
import xxhash
from helpers import awkward, docs, rows_of, words

from migtrack.llm import simhash


def brute_print(text):
    w = [x.encode() for x in words("".join(c.lower() if c.isascii() else c for c in text or ""))]
    shingles = [w[i:i + 3] for i in range(len(w) - 2)] if len(w) > 2 else [w] if w else []
    hashes = [xxhash.xxh64_intdigest(b" ".join(s), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints, ids, radius=3):
    """component_id by row: flood over all pairs."""
    n, out = len(prints), [None] * len(prints)
    seen = set()
    for start in range(n):
        if start in seen:
            continue
        todo, group = [start], {start}
        while todo:
            x = todo.pop()
            for y in range(n):
                if y not in group and (prints[x] ^ prints[y]).bit_count() <= radius:
                    group.add(y)
                    todo.append(y)
        seen |= group
        low = min((ids[g] for g in group if ids[g] is not None), default=None)
        for g in group:
            out[g] = low
    return out


def test_fingerprints_of_awkward_texts(spark):
    texts = awkward() + ["A b C", "a B c", "tail Ä ä"]
    got = rows_of(simhash.near_components(docs(spark, texts)), "doc_id")
    assert [r["fingerprint"] for r in got] == [f"{brute_print(t):016x}" for t in texts]
    ids = list(range(len(texts)))
    assert [r["component_id"] for r in got] == brute_components([brute_print(t) for t in texts], ids)


def test_parts_do_not_change_a_fingerprint(monkeypatch):
    text = " ".join(f"word{i % 91} x" for i in range(4000)) + "\n\x0b" + "y" * 3000 + " end"
    whole = simhash.fingerprint(text)
    cut = simhash.parts
    monkeypatch.setattr(simhash, "parts", lambda data: cut(data, 50))
    assert simhash.fingerprint(text) == whole == brute_print(text)


def test_spark_hash_is_the_shingle_hash(spark):
    from pyspark.sql import functions as F
    got = spark.range(1).select(F.xxhash64(F.lit("one two three"))).first()[0]
    assert got % (1 << 64) == xxhash.xxh64_intdigest(b"one two three", seed=42)


def graph(edges, prints):
    label = {p: p for p in prints}
    for _ in prints:
        before = dict(label)
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    return label


def clouds(rng, n, spread=9):
    """Distinct fingerprints in clouds around a few centres, and some far ones."""
    out = set()
    centres = [int(x) for x in rng.integers(0, 1 << 64, 6, dtype=np.uint64)] + [0, (1 << 64) - 1]
    while len(out) < n:
        x = int(rng.integers(0, 1 << 64, dtype=np.uint64)) if rng.random() < 0.2 else centres[rng.integers(0, 8)]
        for b in rng.integers(0, 64, rng.integers(0, spread)):
            x ^= 1 << int(b)
        out.add(x)
    return sorted(out)


@pytest.mark.parametrize("cell", [4096, 40])
@pytest.mark.parametrize("per_shard", [64, 0])
def test_links_equal_all_pairs(spark, monkeypatch, cell, per_shard):
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(simhash, "PER_SHARD", per_shard)  # 0: shards of two blocks
    prints = clouds(np.random.default_rng(cell + per_shard), 500)
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long")
    edges = [(r["a"] % (1 << 64), r["b"] % (1 << 64)) for r in simhash.links(df).collect()]
    want = brute_components(prints, prints)
    got = graph(edges, prints)
    sets = lambda labels: sorted(sorted(p for p, x in zip(prints, labels, strict=True) if x == y) for y in set(labels))
    assert sets([got[p] for p in prints]) == sets(want)


def test_forest_finds_all_within_the_radius(monkeypatch):
    rng = np.random.default_rng(5)
    tree = np.sort(rng.integers(0, 7, 900))
    fp = np.array(clouds(rng, 900, 12), np.uint64)
    rng.shuffle(fp)
    monkeypatch.setattr(simhash, "FRONTIER", 5000)
    forest = simhash.Forest(tree, fp)
    number = np.unique(tree, return_inverse=True)[1]
    got = {(int(a), int(b)) for x, y in forest.near(fp, number, 3) for a, b in zip(x, y, strict=True)}
    want = {(a, b) for a in range(900) for b in range(900) if tree[a] == tree[b] and int(fp[a] ^ fp[b]).bit_count() <= 3}
    assert got == want
    assert (forest.keys // 65 != forest.kids).all() and len(forest.kids) == 900 - 7


@pytest.mark.parametrize("radius,n", [(1, 10), (3, 10), (3, 1 << 40), (6, 10)])
def test_masks_keep_every_link(radius, n):
    rng = np.random.default_rng(radius)
    found = simhash.masks(radius, n)
    for _ in range(300):
        flipped = sum(1 << int(b) for b in set(rng.integers(0, 64, radius)))
        assert any(not flipped & m for m in found)


def test_a_hot_group_of_copies_null_ids_and_repeated_rows(spark):
    base = " ".join(f"w{i}" for i in range(400))
    texts = [base] * 300 + [base + f" tail{i}" for i in range(150)] + [None, "", "lone words here now"] + ["twice given row"] * 2
    ids = [None if i % 7 == 0 else i for i in range(453)] + [999, 999]
    got = simhash.near_components(docs(spark, texts, ids)).collect()
    prints = [brute_print(t) for t in texts]
    want = brute_components(prints, ids)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in got), key=key) == \
        sorted(((i, f"{p:016x}", c) for i, p, c in zip(ids, prints, want, strict=True)), key=key)
    sizes = {}
    for r in got:
        sizes[r["component_id"], r["component_size"]] = sizes.get((r["component_id"], r["component_size"]), 0) + 1
    assert all(n == size for (_, size), n in sizes.items())


def test_empty_table(spark):
    out = simhash.near_components(docs(spark, []))
    assert out.columns == ["doc_id", "fingerprint", "component_id", "component_size"] and out.count() == 0
