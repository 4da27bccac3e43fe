"""The pipeline against brute force, stage by stage, and the registered queries against SQL."""

import math
import os
import re

import corpus_pipeline
import duckdb
import pytest
from helpers import PROSE, awkward, docs, words
from test_exact_dedup import brute as exact_brute
from test_near_dedup import brute as near_brute
from test_bin_packing import check, ids_of

from conftest import SF_SMALL
from migtrack.llm import queries, quality_rules
from migtrack.llm.common import scratch, written
from migtrack.session import checkpoint_dir
from tools.compare import digest

import __spark_entry__ as E


def test_stages(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "exact", "near", "mix", "pack"]
    table = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    d = table
    steps = []
    for _, stage in corpus_pipeline.STAGES:
        d = corpus_pipeline.written(stage(spark, d, SF_SMALL), "test")
        steps.append(d)
    quality, exact, near, mix, pack = steps
    assert all(s.columns == table.columns for s in steps[:4])
    good = {r["doc_id"] for r in quality_rules.scores(table, spark.read.parquet(f"{SF_SMALL}/labels.parquet")).collect() if r["predicted"]}
    q = quality.collect()
    assert {r["doc_id"] for r in q} == good
    ids, texts = [r["doc_id"] for r in q], [r["text"] for r in q]
    x = exact.collect()
    assert {r["doc_id"] for r in x} == {keep for _, keep, _, _ in exact_brute(texts, ids)} and len(x) < len(q)
    ids, texts = [r["doc_id"] for r in x], [r["text"] for r in x]
    n = near.collect()
    assert {r["doc_id"] for r in n} == {low for _, low, _ in near_brute(texts, ids)} and len(n) < len(x)
    sizes, taken = {}, {}
    for r in n:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
    for r in mix.collect():
        taken[r["source"]] = taken.get(r["source"], 0) + len(words(r["text"]))
    largest = max(len(words(r["text"])) for r in n)
    from test_source_mix import shares
    assert all(abs(taken.get(s, 0) - t) <= largest for s, t in shares(sizes).items())
    m = [(i, r["text"]) for i, r in enumerate(mix.collect())]
    lengths = sorted(min(4096, len(x) - k) for x in ids_of([t for _, t in m]) for k in range(0, len(x), 4096))
    rows = [r.asDict() for r in pack.collect()]
    assert sorted(r["length"] for r in rows) == lengths
    assert check(rows, {}, 4096) == math.ceil(sum(lengths) / 4096)


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 0


def test_every_operator_is_registered_once():
    names = sorted(queries.QUERIES, key=lambda n: int(n[2:].split("_")[0]))
    assert [int(n[2:].split("_")[0]) for n in names] == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries()) and set(queries.ORACLE_SQL) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF_SMALL)
    cur = con.execute(queries.ORACLE_SQL[name])
    want_cols, want = [c[0] for c in cur.description], cur.fetchall()
    got = [tuple(r) for r in df.collect()]
    assert sorted(df.columns) == sorted(want_cols) and len(got) == len(want)
    assert digest(df.columns, got)[0] == digest(want_cols, want)[0]


@pytest.mark.parametrize("empty", [False, True])
def test_run_on_awkward_tables(spark, tmp_dir, empty):
    """Null, empty, long and repeated texts, null ids and clashing columns; then a table without rows."""
    texts = awkward(2000) + [PROSE + f" number {i} of many" * 3 for i in range(20)]
    texts, ids = texts + texts[:8], [None, *range(1, len(texts))] + [None, *range(1, 8)]
    df = docs(spark, [] if empty else texts, ids=[] if empty else ids)
    df.write.parquet(f"{tmp_dir}/documents.parquet")
    spark.read.parquet(f"{SF_SMALL}/labels.parquet").write.parquet(f"{tmp_dir}/labels.parquet")
    d = spark.read.parquet(f"{tmp_dir}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = corpus_pipeline.written(stage(spark, d, tmp_dir), "test")
        assert out.columns == df.columns and set(out.collect()) <= set(d.collect())
        if name != "quality":
            same = (lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) if name == "exact" else lambda t: " ".join(words(t))
            left = [same(r["text"]) for r in out.collect()]
            assert len(left) == len(set(left))
        d = out
    rows = corpus_pipeline.run(spark, tmp_dir).collect()
    assert not (empty and rows) and {r["doc_id"] for r in rows} <= {r["doc_id"] for r in d.collect()}
    ends = {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == ends.get(r["sequence_id"], 0)
        ends[r["sequence_id"]] = r["offset"] + r["length"]
    assert all(e <= 4096 for e in ends.values())


def test_only_the_kept_table_of_a_scope_stays(spark):
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with scratch(spark):
        out = written(corpus_pipeline.exact(spark, docs(spark, ["a b", "a  b", "c"]), SF_SMALL), "result", keep=True)
    assert [name.rpartition("-")[0] for name in set(os.listdir(folder)) - before] == ["result"]
    assert sorted(r["doc_id"] for r in out.collect()) == [0, 2]


def test_a_failed_scope_removes_its_tables(spark):
    folder = checkpoint_dir(spark).removeprefix("file:")
    before = set(os.listdir(folder))
    with pytest.raises(RuntimeError), scratch(spark):
        kept = written(spark.range(3), "kept", keep=True)
        with scratch(spark):
            written(kept, "inner")
        written(kept, "outer")
        raise RuntimeError
    assert {name.rpartition("-")[0] for name in set(os.listdir(folder)) - before} == {"kept"} and kept.count() == 3
