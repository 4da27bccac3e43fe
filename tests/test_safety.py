"""Writes that must not lose rows, results that must not depend on layout, plans that must not read twice."""

import datetime as dt
import os
import re

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from migtrack import fixtures as FX
from migtrack.operators import catalog as C
from migtrack.operators import reports as R
from migtrack.operators import upsert as U
from migtrack.plans import flows, registry
from migtrack.schemas import STAGE_SCHEMA, TEST_LOG_SCHEMA, TRACKING_SCHEMA
from migtrack.sources import files as SF
from migtrack.sources import sinks as SK
from migtrack.streaming import result_log as RL

T0 = dt.datetime(2024, 1, 1)


def log_rows(spark, rows):
    return spark.createDataFrame([(e, str(e), t, p, T0, s, "-") for e, t, p, s in rows], TEST_LOG_SCHEMA)


# --- writes ------------------------------------------------------------------------

def files_in(spark, folder):
    return {r.file_name: r.text for r in SK.read_files(spark, folder).collect()}


def test_export_keeps_earlier_files_and_the_last_of_colliding_ones(spark, tmp_dir):
    kind = "procedure_name string, file_name string, body string"
    SK.export_scripts(spark.createDataFrame([("old", "old.sql", "old\n"), ("a", "a.sql", "first\n")], kind), tmp_dir + "/o")
    rows = spark.createDataFrame([("a.b", "a_b.sql", "one\n"), ("a/b", "a_b.sql", "two\n"), ("a", "a.sql", "second\n")], kind)
    SK.export_scripts(rows.repartition(3), tmp_dir + "/o")
    assert files_in(spark, tmp_dir + "/o") == {"old.sql": "old\n", "a.sql": "second\n", "a_b.sql": "two\n"}


def test_processed_files_stay_and_published_ones_are_wiped(spark, tmp_dir):
    kind = "file_name string, text string"
    for name in ("a.sql", "b.sql"):
        SK.write_processed(spark.createDataFrame([(name, name)], kind), tmp_dir + "/p")
    assert files_in(spark, tmp_dir + "/p") == {"processed_a.sql": "a.sql", "processed_b.sql": "b.sql"}
    for name in ("a.sql", "b.sql"):
        SK.publish(spark.createDataFrame([(name, name)], "target_file string, text string"), tmp_dir + "/d")
    assert files_in(spark, tmp_dir + "/d") == {"b.sql": "b.sql"}


@pytest.mark.parametrize("buckets", [None, 4])
def test_a_second_writer_of_a_version_fails(spark, tmp_dir, buckets):
    store = flows.Store(tmp_dir + "/t", tmp_dir + "/l", buckets)
    one = log_rows(spark, [(1, "t", "p", "s")])
    read = store.log_version(spark)
    assert store.write_log(one, read) == 0
    with pytest.raises(SK.VersionTaken):
        store.write_log(log_rows(spark, [(2, "t", "q", "s")]), read)
    assert [r.event_id for r in store.read_log(spark).collect()] == [1]
    assert store.write_log(U.upsert_results(store.read_log(spark, 0), log_rows(spark, [(2, "t", "q", "s")])), 0) == 1


def test_unfinished_versions_block_until_discarded(spark, tmp_dir):
    store = flows.Store(tmp_dir + "/t", tmp_dir + "/l")
    store.write_log(log_rows(spark, [(1, "t", "p", "s")]), None)
    os.makedirs(SK.snapshot_path(store.test_log, 1))  # a write that died
    with pytest.raises(SK.VersionTaken):
        store.write_log(log_rows(spark, []), 0)
    assert SK.discard_unfinished(spark, store.test_log) == [1]
    assert store.write_log(log_rows(spark, []), 0) == 1


def test_cache_recovers_from_a_failed_build(spark, tmp_dir):
    os.makedirs(tmp_dir + "/c")
    assert SK.cached(spark, tmp_dir + "/c", lambda: spark.range(3)).count() == 3
    got = [SK.cached_job(spark, tmp_dir + "/jobs", u, "j", lambda: spark.range(4)) for u in ("u/1", "u/1", "u_1")]
    assert [(g["hit"], g["copied"], g["rows"].count()) for g in got] == [(False, 4, 4), (True, 0, 4), (False, 4, 4)]


def test_ensure_table_after_a_failed_creation(spark, tmp_dir):
    os.makedirs(tmp_dir + "/t")
    assert SK.ensure_table(spark, tmp_dir + "/t", TEST_LOG_SCHEMA).count() == 0
    log_rows(spark, [(1, "t", "p", "s")]).write.mode("append").parquet(tmp_dir + "/t")
    os.remove(tmp_dir + "/t/_SUCCESS")
    assert SK.ensure_table(spark, tmp_dir + "/t", TEST_LOG_SCHEMA).count() == 1


# --- stream ------------------------------------------------------------------------

def drop(spark, folder, rows):
    log_rows(spark, rows).coalesce(1).write.mode("append").parquet(folder)


def run(spark, base, ckpt="c"):
    q = RL.start_log_stream(spark, base + "/in", base + "/log", f"{base}/{ckpt}")
    q.awaitTermination()
    return q.exception()


def test_stream_keeps_null_key_rows_and_rows_without_event_id(spark, tmp_dir):
    rows = [(1, None, "p", "a"), (1, None, "p", "b"), (None, "t", None, "c"), (None, "t", None, "d"), (None, "t", "x", "e")]
    drop(spark, tmp_dir + "/in", rows)
    assert run(spark, tmp_dir) is None
    got = RL.read_log(spark, tmp_dir + "/log").collect()
    assert sorted(r.status for r in got) == ["a", "b", "c", "d", "e"]
    assert sorted(r.status for r in U.upsert_results(None, log_rows(spark, rows)).collect()) == ["a", "b", "c", "d", "e"]


def size_of(folder):
    return sum(os.path.getsize(os.path.join(at, n)) for at, _, names in os.walk(folder) for n in names)


def log_of(spark, base):
    return sorted(map(str, RL.read_log(spark, base + "/log").collect()))


def test_stream_writes_what_a_batch_brings(spark, tmp_dir):
    many = [(i, "t", f"p{i}", "a" * 20 + str(i * 7919)) for i in range(20_000)]
    drop(spark, tmp_dir + "/in", many)
    assert run(spark, tmp_dir) is None
    drop(spark, tmp_dir + "/in", [(20_001, "t", "p5", "new"), (3, "t", "p7", "older"), (20_002, "t", "extra", "x"), (9, None, "p", "loose")])
    assert run(spark, tmp_dir) is None
    first, second = (size_of(RL._change_path(tmp_dir + "/log", i)) for i in (0, 1))
    assert second < first / 10
    changed = spark.read.parquet(RL._change_path(tmp_dir + "/log", 1)).collect()
    assert sorted((r.procedure_name, r.event_id) for r in changed) == [("extra", 20_002), ("p5", 20_001), ("p7", 7)]
    want = U.upsert_results(None, log_rows(spark, [r for r in many if r[0] != 5] + [(20_001, "t", "p5", "new"), (20_002, "t", "extra", "x"), (9, None, "p", "loose")]))
    assert log_of(spark, tmp_dir) == sorted(map(str, want.collect()))


def test_a_replayed_batch_gives_the_same_log(spark, tmp_dir):
    for i in range(3):
        drop(spark, tmp_dir + "/in", [(10 * i + 1, "t", "p", f"s{i}"), (10 * i + 2, "t", f"q{i}", "s"), (10 * i + 3, None, "n", "s")])
        assert run(spark, tmp_dir) is None
    before = log_of(spark, tmp_dir)
    for name in ("2", ".2.crc"):  # as if the driver had died after the write of batch 2
        os.remove(f"{tmp_dir}/c/keyed/commits/{name}")
    SK.delete(spark, RL._change_path(tmp_dir + "/log", 2))
    assert log_of(spark, tmp_dir) != before
    assert run(spark, tmp_dir) is None
    assert log_of(spark, tmp_dir) == before


def test_compacted_changes_give_the_same_log(spark, tmp_dir):
    for i in range(4):
        drop(spark, tmp_dir + "/in", [(10 * i + 1, "t", "p", f"s{i}"), (10 * i + 2, "t", f"q{i}", "s"), (3 - i, "t", "down", f"s{i}")])
        assert run(spark, tmp_dir) is None
        if i == 1:
            assert RL.compact(spark, tmp_dir + "/log") == 0
    before = log_of(spark, tmp_dir)
    assert RL.compact(spark, tmp_dir + "/log") == 2 and RL.compact(spark, tmp_dir + "/log") == 2
    assert log_of(spark, tmp_dir) == before and len(before) == 6
    assert os.listdir(tmp_dir + "/log/changes") == ["batch=000000000003"] and os.listdir(tmp_dir + "/log/folded") == ["upto=000000000002"]
    drop(spark, tmp_dir + "/in", [(99, "t", "p", "last")])
    assert run(spark, tmp_dir) is None
    assert len(log_of(spark, tmp_dir)) == 6 and any("last" in r for r in log_of(spark, tmp_dir))


def test_stream_refuses_a_foreign_log(spark, tmp_dir):
    drop(spark, tmp_dir + "/in", [(1, "t", "p", "a")])
    assert run(spark, tmp_dir) is None
    with pytest.raises(RL.ForeignLog):
        run(spark, tmp_dir, ckpt="other")
    flows.Store(tmp_dir + "/t", tmp_dir + "/batch/log").write_log(log_rows(spark, []), None)
    drop(spark, tmp_dir + "/batch/in", [(1, "t", "p", "a")])
    with pytest.raises(RL.ForeignLog):
        run(spark, tmp_dir + "/batch")


# --- results that depend on the rows alone --------------------------------------------

def routine_rows(spark):
    rows = [(f"db{d}", "dbo" if i % 5 else None, f"p{i % 60}", f"body {d} {i}") for d in range(3) for i in range(60)]
    return spark.createDataFrame(rows, "dbname string, schema_name string, procedure_name string, procedure_definition string")


def test_load_does_not_depend_on_the_layout(spark, tmp_dir):
    params = spark.createDataFrame([("p1", "IN", "@a", "int", None, 1)],
                                   "procedure_name string, mode string, name string, data_type string, char_length int, ordinal_position int")
    got = []
    for n in (1, 4, 7):
        store = flows.Store(f"{tmp_dir}/t{n}", f"{tmp_dir}/l{n}")
        r = flows.load_catalogue(spark, store, routine_rows(spark).repartition(n), params, now=T0)
        assert r == {"version": 0, "staged": 180, "inserted": 48 + 36, "updated": 96}
        got.append(sorted(map(str, store.read_tracking(spark).collect())))
    assert got[0] == got[1] == got[2]
    keyed = [r for r in store.read_tracking(spark).collect() if r.schema_name]
    assert {(r.dbname, r.procedure_definition.split()[1]) for r in keyed} == {("db0", "2")}  # first identity, last text


def test_load_with_a_given_order_and_an_existing_stage(spark, tmp_dir):
    params = FX.load(spark, SF_SMALL, "params")
    routines = routine_rows(spark).withColumn("age", -F.substring("dbname", 3, 1).cast("int"))
    store = flows.Store(tmp_dir + "/t", tmp_dir + "/l")
    staged = routines.limit(0).select(F.lit("SQLServer").alias("source"), "dbname", "schema_name", "procedure_name") \
        .unionByName(routines.where("dbname = 'db2'").select(F.lit("SQLServer").alias("source"), "dbname", "schema_name", "procedure_name"))
    r = flows.load_catalogue(spark, store, routines, params, existing=staged, now=T0, order_col="age")
    assert r["staged"] == 120
    keyed = [r for r in store.read_tracking(spark).collect() if r.schema_name]
    assert {(r.dbname, r.procedure_definition.split()[1]) for r in keyed} == {("db1", "0")}


def test_rows_without_seq_win_whole_when_alone(spark):
    kind = "k string, seq long, a string, b string"
    df = spark.createDataFrame([("x", None, "a1", "b1"), ("y", None, "a2", "b2"), ("y", 3, "a3", None), (None, 1, "n", "m")], kind)
    for last in (False, True):
        got = sorted(map(tuple, C.first_by(df, ["k"], "seq", last).collect()), key=str)
        assert got == [("x", None, "a1", "b1"), ("y", 3, "a3", None), (None, 1, "n", "m")]
    same = df.unionByName(df)
    assert C.first_by(same, ["k"], "seq").count() == 3


def test_upsert_with_repeated_and_unnumbered_source_rows(spark):
    src = [(None, "S", "db", "dbo", "p", "only", "x")] + [(1, "S", "db", "dbo", "q", "twice", "x")] * 2
    s, t = spark.createDataFrame(src, STAGE_SCHEMA), spark.createDataFrame([], TRACKING_SCHEMA)
    out = U.upsert_tracking(t, s, now=T0).collect()
    assert sorted((r.procedure_name, r.procedure_definition, r.source) for r in out) == [("p", "only", "S"), ("q", "twice", "S")]


def test_result_upsert_later_batch_wins_over_higher_id(spark):
    old, new = log_rows(spark, [(9, "t", "p", "old"), (1, "t", "q", "kept")]), log_rows(spark, [(2, "t", "p", "new"), (3, None, "p", "n")])
    got = U.upsert_results(U.upsert_results(None, old), new).collect()
    assert sorted((r.event_id, r.status) for r in got) == [(1, "kept"), (2, "new"), (3, "n")]
    newest = RL.merge_newest(RL.merge_newest(None, old), new).collect()
    assert sorted((r.event_id, r.status) for r in newest) == [(1, "kept"), (3, "n"), (9, "old")]


def test_dashboard_rows_come_in_the_log_view_order(spark):
    log = FX.load(spark, SF_SMALL, "test_log")
    assert flows.dashboard(log)["rows"].collect() == C.log_view(log).collect()


def test_record_results_without_a_pass_leaves_tracking_alone(spark, tmp_dir):
    store = flows.Store(tmp_dir + "/t", tmp_dir + "/l")
    got = flows.record_results(spark, store, log_rows(spark, [(1, "test_procedure_execution", "p", "❌ Failed")]))
    assert got == {"log_version": 0, "tracking_version": None} and store.tracking_version(spark) is None


# --- plans ---------------------------------------------------------------------------

def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def scans(plan, folder):
    return [x for x in re.findall(r"FileScan parquet.*?Location: [^\[]*\[([^\]]*)\]", plan) if x.endswith("/" + folder)]


def test_upserts_read_their_inputs_once(spark, tmp_dir):
    for name in ("tracking", "batch", "test_log_old", "test_log_new"):
        FX.load(spark, SF_SMALL, name).write.parquet(f"{tmp_dir}/{name}")
    read = lambda n: spark.read.parquet(f"{tmp_dir}/{n}")
    plan = plan_of(U.upsert_tracking(read("tracking"), read("batch"), now=T0))
    # keyed rows once (the batch: order columns for the aggregate, then whole rows); NULL-key rows by a filter
    # that skips the row groups without any
    assert len(scans(plan, "tracking")) == 2 and len(scans(plan, "batch")) == 3
    assert plan.count("PushedFilters: [Or(IsNull(schema_name),IsNull(procedure_name))]") == 2
    assert plan.count("PushedFilters: [IsNotNull(schema_name), IsNotNull(procedure_name)]") == 3
    plan = plan_of(U.upsert_results(read("test_log_old"), read("test_log_new")))
    assert len(scans(plan, "test_log_old")) == len(scans(plan, "test_log_new")) == 1


@pytest.mark.parametrize("name", ["stage_dedup", "metadata_upsert", "apply_edits", "script_pairs"])
def test_no_text_is_sorted_for_an_aggregate(spark, name):
    plan = registry.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    aggregates = [line for line in plan.splitlines() if "SortAggregate" in line]
    assert not any(re.search(r"procedure_definition|\btext#|body#|parameters#", line) and "xxhash64" not in line for line in aggregates)


def test_log_tail_sorts_no_log(spark, tmp_dir):
    with open(tmp_dir + "/app.log", "w") as f:
        f.write("".join(f"line {i}\n" for i in range(5000)) + "\n \n")
    tail = R.tail(SF.read_log_lines(spark, tmp_dir + "/app.log"), 3, order_col="pos")
    assert [r.line for r in tail.collect()] == ["line 4997", "line 4998", "line 4999"]
    plan = tail._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan.split("Subquery")[0].replace("rangepartitioning(pos", "", 1)
    assert "TakeOrderedAndProject" in plan
