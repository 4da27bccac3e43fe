import random

import pytest
from pyspark.sql import functions as F

from migtrack.operators import catalog as C
from migtrack.plans import flows
from migtrack.sources import name_index as NI


def names(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeXYé_%.İ") for _ in range(rng.randint(0, 9)))
    rows = [("db", rng.choice(["s1", "s2", None]), f"usp_{word()}_{i % 400}") for i in range(n)]
    return rows + rows[:30] + [("db", "s1", x) for x in (None, "", "a", "ab", "ÀÉÎ", "🙂🙃🙂🙃", "usp")]


def columns(df):
    return [tuple(r) for r in df.collect()]


@pytest.fixture(scope="module")
def index(spark, tmp_path_factory):
    df = spark.createDataFrame(names(3000, 5), "dbname string, schema_name string, procedure_name string")
    path = f"{tmp_path_factory.mktemp('names')}/index"
    NI.write_index(df, path, folders=32)
    return df, path


def test_search_by_index_equals_the_scan(spark, index):
    df, path = index
    rng = random.Random(6)
    held = [r[2] for r in df.collect() if r[2]]
    terms = ["", "u", "AB", "usp", "USP_", "%", "_%.", "🙂🙃🙂", "àéî", "no such name", "aaaaaaaaaaaa", "İ"]
    for _ in range(10):
        name = rng.choice(held)
        start = rng.randrange(len(name))
        part = name[start:start + rng.randint(1, 7)]
        terms.append(part.upper() if rng.random() < 0.5 else part)
    for term in terms:
        assert columns(NI.search_index(spark, path, term)) == columns(C.search(df, term)), term


def test_postings_prune_files(spark, index):
    df, path = index
    every = {f for f in spark.read.parquet(f"{path}/postings").inputFiles()}
    rare = NI.candidates(spark, path, "usp_abc")
    assert 0 < len(rare.inputFiles()) <= len(every) / 8
    assert rare.count() < df.count() / 10  # the term's rarest trigram, not the one of every name
    plan = rare._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(gram," in plan
    assert NI.candidates(spark, path, "zzz_none").count() == 0
    assert sorted(NI.candidates(spark, path, "us").inputFiles()) == sorted(spark.read.parquet(f"{path}/rows").inputFiles())


def test_a_frequent_trigram_fills_several_files(spark, tmp_dir):
    rows = spark.range(20_000).select(F.format_string("usp_%d", "id").alias("procedure_name"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if partitions were large
    try:
        NI.write_index(rows, f"{tmp_dir}/i", folders=16)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = spark.read.parquet(f"{tmp_dir}/i/postings").filter("gram = 'usp'")
    sizes = [r["count"] for r in hot.groupBy("_metadata.file_path").count().collect()]
    assert sum(sizes) == 20_000 and max(sizes) < 20_000 / 2


def test_unfinished_index_is_rebuilt_and_a_finished_one_is_kept(spark, tmp_dir):
    path = f"{tmp_dir}/i"
    df = spark.createDataFrame([("usp_abc",)], "procedure_name string")
    df.write.parquet(f"{path}/rows")  # a build that died
    assert NI.built_from(spark, path) is None
    NI.write_index(df, path, stamp="v 3")
    assert NI.built_from(spark, path) == "v 3"
    with pytest.raises(ValueError, match="holds an index"):
        NI.write_index(df, path)
    empty = f"{tmp_dir}/none"
    NI.write_index(df.limit(0), empty)
    assert NI.search_index(spark, empty, "abc").count() == NI.search_index(spark, empty, "a").count() == 0


def test_flow_searches_the_newest_version(spark, tmp_dir):
    store = flows.Store(tracking=f"{tmp_dir}/tracking", test_log=f"{tmp_dir}/log")
    load = lambda names: flows.load_catalogue(
        spark, store, spark.createDataFrame([("d", "s", n, "BEGIN END") for n in names],
                                            "dbname string, schema_name string, procedure_name string, procedure_definition string"),
        spark.createDataFrame([], "procedure_name string, mode string, name string, data_type string, char_length int, ordinal_position int"),
        target_dbname="T", target_schema_name="P")
    load(["usp_one", "usp_two"])
    found = lambda term: [r["procedure_name"] for r in flows.search_names(spark, store, term).collect()]
    assert found("_ONE") == ["usp_one"]  # without an index: a scan
    path = flows.index_names(spark, store)
    assert flows.index_names(spark, store) == path and found("_ONE") == ["usp_one"]
    assert any(path in f for f in flows.search_names(spark, store, "_one").inputFiles())
    load(["usp_one_more"])
    assert found("_one") == ["usp_one", "usp_one_more"]  # the index is of an older version
    assert flows.index_names(spark, store) != path and found("_one") == ["usp_one", "usp_one_more"]
