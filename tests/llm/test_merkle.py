"""Operator 12 against a Merkle tree built node by node, and against its SQL."""

import hashlib
import zlib

import pytest
from helpers import CLASHING, awkward, docs

from migtrack.llm import merkle

COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(hashes, arity):
    """root, and of each node its (left, right) siblings level by level."""
    ways, at = [[] for _ in hashes], list(range(len(hashes)))
    while len(hashes) > 1:
        for way, (i, p) in zip(ways, enumerate(at), strict=True):
            first = p - p % arity
            run = hashes[first:first + arity]
            way.append((run[:p - first], run[p - first + 1:]))
            at[i] = p // arity
        hashes = [H(*hashes[i:i + arity]) for i in range(0, len(hashes), arity)]
    return hashes[0], ways


def brute(rows, arity=2):
    low = lambda x: (x is not None, x if not isinstance(x, str) else x.encode())
    langs = sorted({r[2] for r in rows}, key=low)
    groups = {g: sorted((r for r in rows if r[2] == g), key=lambda r: (low(r[0]), leaf(r))) for g in langs}
    trees = {g: climb([leaf(r) for r in groups[g]], arity) for g in langs}
    root, up = climb([trees[g][0] for g in langs], arity) if rows else (None, [])
    out = []
    for g, more in zip(langs, up, strict=True):
        for r, way in zip(groups[g], trees[g][1], strict=True):
            touched = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None
            node = leaf(r[:3] + (r[3] + 1,) + r[4:]) if touched else leaf(r)
            for left, right in way + more:
                node = H(*left, node, *right)
            proof = H(*(s for left, right in way + more for s in left + right))
            out.append((r[0], leaf(r), trees[g][0], root, proof, node, node == root))
    return out


def key(row):
    return tuple((x is None, x) for x in row)


def found(df):
    return sorted((tuple(r)[:7] for r in df.collect()), key=key)


def table(spark, rows):
    from pyspark.sql import functions as F
    df = spark.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit("x") for c in (*CLASHING, "grp", "pos", "path", "hash", "up", "chunk", "root", "of", "at", "left")})


@pytest.mark.parametrize("arity,levels", [(2, 10), (2, 2), (3, 1), (3, 2), (5, 1)])
def test_tree_equals_the_one_built_node_by_node(spark, arity, levels):
    sizes = {None: 3, "de": 1, "en": 40, "fr": 17, "": 2, "한": 9, "Zz": 16}
    rows, i = [], 0
    for lang, many in sizes.items():
        for k in range(many):
            rows.append((i * 13 % 101, f"s{i % 3}", lang, None if i % 11 == 0 else i, f"text {i}"))
            i += 1
    got = found(merkle.manifest(table(spark, rows), arity=arity, levels=levels))
    assert got == sorted(brute(rows, arity), key=key)
    assert {r[6] for r in got} == {True, False}


def test_awkward_rows(spark):
    texts = awkward(2000)
    rows = [(i, "s", "en" if i % 2 else None, None if t is None else len(t), t) for i, t in enumerate(texts)]
    rows += [(None, None, None, None, None)] * 3 + [(5, "s", "en", 3, "one")] * 4 + [(7, "s", "en", (1 << 63) - 1, "a"), (7, "s", "en", 1, "b")]
    assert found(merkle.manifest(table(spark, rows))) == sorted(brute(rows), key=key)


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_one_lang_of_few_leaves(spark, n):
    rows = [(i, "s", "en", i, "x") for i in range(n)]
    got = found(merkle.manifest(table(spark, rows)))
    assert got == sorted(brute(rows), key=key)
    if n == 1:
        assert got[0][1] == got[0][2] == got[0][3] and got[0][4] == H("")


def test_many_langs_and_a_hot_group_of_equal_rows(spark):
    rows = [(i, "s", f"lang{i}", i, "t") for i in range(150)] + [(3, "s", "hot", 1, "same")] * 100
    assert found(merkle.manifest(table(spark, rows), levels=3)) == sorted(brute(rows), key=key)


def test_native_plan(spark):
    plan = merkle.manifest(docs(spark, ["a", "b"]))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and "CartesianProduct" not in plan


def test_empty_table(spark):
    out = merkle.manifest(docs(spark, []))
    assert out.columns[:7] == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert out.count() == 0
