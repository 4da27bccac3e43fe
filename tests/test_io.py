"""File round trips, the result stream, flows, the driver entry and plan shape."""

import glob
import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from migtrack import fixtures as FX
from migtrack.functions import text as T
from migtrack.operators import catalog as C
from migtrack.operators import reports as R
from migtrack.operators import upsert as U
from migtrack.plans import flows, registry
from migtrack.sources import files as SF
from migtrack.sources import log_end as LE
from migtrack.sources import sinks as SK
from migtrack.streaming.result_log import replay_log_stream


def write_files(folder, files):
    os.makedirs(folder, exist_ok=True)
    for name, data in files.items():
        with open(os.path.join(folder, name), "wb") as f:
            f.write(data)


def test_read_scripts_bom_crlf_glob(spark, tmp_dir):
    write_files(tmp_dir, {"a.sql": b"\xef\xbb\xbfline1\r\nline2\r", "b.sql": b"x\ny", "c.txt": b"skip"})
    got = {r.file_name: r.text for r in SF.read_scripts(spark, tmp_dir).collect()}
    assert got == {"a.sql": "line1\nline2\n", "b.sql": "x\ny"}


def test_read_uploads_rejects_bad_utf8(spark, tmp_dir):
    write_files(tmp_dir, {"p.one.sql": "CREATE PROC p (@a INT) AS SELECT 1".encode(), "notes.txt": b"CREATE PROC q AS",
                          "bad.sql": b"\xff\xfe\x00broken"})
    rows = SF.read_uploads(spark, tmp_dir, "DB", "dbo").collect()
    assert [(r.procedure_name, r.parameters, r.source) for r in rows] == [("p.one", "@a INT", "File Upload")]
    files = spark.read.format("binaryFile").load(tmp_dir).select("path", "content")
    assert [r.procedure_name for r in SF.parse_uploads(files, "DB", "dbo").collect()] == ["p.one"]
    assert [r.file_name for r in SF.upload_rejects(files).collect()] == ["bad.sql"]


def test_export_then_read_back(spark, tmp_dir):
    tracking = FX.load(spark, SF_SMALL, "tracking")
    rows = C.export_rows(tracking)
    SK.export_scripts(rows, tmp_dir + "/out")
    want = sorted((r.file_name, r.body) for r in rows.collect())
    assert sorted((r.file_name, r.text) for r in SF.read_scripts(spark, tmp_dir + "/out").collect()) == want
    assert sorted(map(tuple, SK.read_files(spark, tmp_dir + "/out").collect())) == want
    assert sorted(os.listdir(tmp_dir + "/out")) == [name for name, _ in want]


def test_read_log_lines_numbers_in_file_order(spark, tmp_dir):
    lines = [f"2024-01-0{i % 9 + 1} 10:00:00,000 - INFO - m{i}" for i in range(500)]
    write_files(tmp_dir, {"app.log": ("\n".join(lines) + "\n").encode()})
    got = SF.number_lines(SF.read_log_lines(spark, tmp_dir)).orderBy("line_no").collect()
    assert [r.line for r in got] == lines and [r.line_no for r in got] == list(range(1, 501))


def test_stream_equals_batch(spark):
    outcomes = FX.load(spark, SF_SMALL, "test_log")
    streamed = replay_log_stream(spark, *[outcomes.where(f"event_id % 3 = {i}") for i in (1, 0, 2)])
    batch = U.upsert_results(None, outcomes)
    key = lambda r: r.event_id
    assert sorted(streamed.collect(), key=key) == sorted(batch.collect(), key=key)


def test_flows_end_to_end(spark, tmp_dir):
    store = flows.Store(tracking=tmp_dir + "/tracking", test_log=tmp_dir + "/log")
    routines, params = FX.load(spark, SF_SMALL, "routines", "params")
    r1 = flows.load_catalogue(spark, store, C.routines_from(routines), params, now=FX.LOAD_NOW,
                              target_dbname="TGT", target_schema_name="PUBLIC")
    n_proc = C.routines_from(routines).count()
    assert r1["version"] == 0 and r1["staged"] == r1["inserted"] == n_proc and r1["updated"] == 0
    r2 = flows.load_catalogue(spark, store, C.routines_from(routines), params, now=FX.LOAD_NOW)
    assert (r2["inserted"], r2["updated"]) == (0, n_proc)
    proposals = store.read_tracking(spark).select("dbname", "schema_name", "procedure_name",
                                                  F.lit(True).alias("new_flag"))
    assert flows.save_flags(spark, store, proposals)["changed"] == n_proc
    ex = flows.extract(spark, store, tmp_dir + "/extracted")
    assert ex["exported"] == n_proc and ex["skipped"] == 0
    scripts = FX.load(spark, SF_SMALL, "scripts")
    converted = scripts.select(F.regexp_replace("file_name", "^processed_", "").alias("file_name"), "text")
    cleaned = flows.process(converted, "dbo", "PUBLIC")
    SK.write_corpus(cleaned, tmp_dir + "/processed")
    outcomes = FX.load(spark, SF_SMALL, "test_log")
    flows.record_results(spark, store, outcomes)
    deployed = store.read_tracking(spark).where("is_deployed").count()
    assert deployed > 0
    pub = flows.publish_passed(spark, store, spark.read.parquet(tmp_dir + "/processed"), tmp_dir + "/pub")
    assert pub["published"] > 0
    assert len(glob.glob(tmp_dir + "/pub/deployed_*.sql")) == pub["published"]


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["source", "dbname", "schema_name", "procedure_name", "procedure_definition",
                          "parameters"]
    assert df.count() > 0


def test_every_query_has_an_oracle():
    assert set(registry.queries()) == set(registry.oracle_sql())


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_no_python_udf_in_plans(spark, name):
    if name == "result_stream":
        pytest.skip("runs a stream while planning")  # its plan is read from what the stream has written
    plan = registry.queries()[name](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_object_listing_pushes_prefix_to_scan(spark):
    df = registry.queries()["object_listing"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(url" in plan and "html" not in plan.split("ReadSchema")[-1]


def test_cleanup_projection_has_no_shuffle(spark):
    df = registry.queries()["clean_script"](spark, SF_SMALL)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_text_helpers_used_by_sinks(spark):
    df = spark.createDataFrame([("a\n",), ("b",)], "t string")
    assert [r[0] for r in df.select(T.trim_final_break("t")).collect()] == ["a", "b"]


def test_load_catalogue_empty_batch_writes_nothing(spark, tmp_dir):
    store = flows.Store(tracking=tmp_dir + "/t", test_log=tmp_dir + "/l")
    routines, params = FX.load(spark, SF_SMALL, "routines", "params")
    none = C.routines_from(routines).where("false")
    assert flows.load_catalogue(spark, store, none, params)["version"] is None
    assert SK.latest_version(spark, store.tracking) is None


def test_viewer_log_and_cache_views(spark, tmp_dir):
    scripts, log = FX.load(spark, SF_SMALL, "scripts", "test_log")
    tracking = FX.load(spark, SF_SMALL, "tracking")
    views = flows.comparison_view(scripts.select("file_name", "text"), C.export_rows(tracking), "/ex", log)
    assert views["pairs"].count() == scripts.count() and views["labels"].count() == scripts.count()
    assert views["lines"].where("line_no = 1").count() == scripts.count()
    write_files(tmp_dir + "/logs", {"app.log": b"2024-01-01 10:00:00,000 - INFO - a\ncontinued\n\n"})
    act = flows.activity_log(spark, tmp_dir + "/logs")
    assert [r.line for r in act["tail"].collect()] == ["2024-01-01 10:00:00,000 - INFO - a", "continued"]
    assert act["parsed"].where("level = 'INFO'").count() == 1
    write_files(tmp_dir + "/cache/u1", {"a.sql": b"x"})
    assert flows.converted_cache(spark, tmp_dir + "/cache", "u1/")["exists"]
    assert not flows.converted_cache(spark, tmp_dir + "/cache", "u2/")["exists"]
    rep = spark.createDataFrame([(1, "- Files: 3")], "k long, text string")
    assert flows.assessment(rep, "k").collect()[0].files == "3"
    lic = spark.createDataFrame([(1, "Expiration date: 1/1/2999 0:00:00")], "k long, text string")
    assert flows.licence_status(lic, "k").collect()[0].has_active is True


def test_listing_by_a_relative_prefix(spark, tmp_dir):
    for i in range(40):
        write_files(f"{tmp_dir}/o/user{i}/job[{i}]", {"out.sql": b"x", "other.txt": b"y"})
    write_files(tmp_dir + "/o/user1/job[1]/outer/deep", {"z.sql": b"z"})
    write_files(tmp_dir + "/o/user1/_claimed", {"h.sql": b"h"})
    keys = lambda prefix, root=tmp_dir + "/o": sorted(r.key for r in SF.list_object_files(spark, root, prefix).collect())
    every = sorted(f"user{i}/job[{i}]/{n}" for i in range(40) for n in ("out.sql", "other.txt"))
    assert keys("") == sorted([*every, "user1/job[1]/outer/deep/z.sql"])
    for prefix in ("user1", "user1/", "user1/job[1]/out", "user1/job[1]/out.sql", "user1/job[1]/outer/d", "user3/job[3]/ot"):
        for root in (tmp_dir + "/o", tmp_dir + "/o/", "file:" + tmp_dir + "/o"):
            want = sorted(k for k in keys("") if k.startswith(prefix))
            assert keys(prefix, root) == want and want
    assert keys("user1/job[2") == keys("nobody/") == keys("user1/*") == []
    listed = SF.list_object_files(spark, tmp_dir + "/o", "user1/job[1]/out").inputFiles()
    assert len(listed) == 2 and all("/user1/" in f for f in listed)  # nothing else was listed
    views = flows.converted_cache(spark, tmp_dir + "/o", "user1/job[1]/out")
    assert sorted((r.key, r.name) for r in views["objects"].collect()) == [("user1/job[1]/out.sql", "out.sql"), ("user1/job[1]/outer/deep/z.sql", "z.sql")]


def log_files(folder, rng, count):
    """Files of lines of every length with breaks of every kind; blank ones at the end."""
    breaks, data = [b"\n", b"\r\n", b"\r", b"\n\n"], {}
    for i in range(count):
        lines = [("é" * int(rng.integers(0, 60)) + str(k)).encode() + breaks[rng.integers(0, 4)] for k in range(int(rng.integers(0, 50)))]
        data[f"app-{i}.log"] = b"".join(lines)
    data[f"app-{count}.log"] = b"last\n" if rng.random() < 0.5 else b"no break"
    data[f"app-{count + 1}.log"] = b"\n \n\t\r\n"
    write_files(folder, data)


@pytest.mark.parametrize("seed", range(4))
def test_tail_of_files_equals_the_tail_of_all_lines(spark, tmp_dir, seed):
    import numpy as np
    log_files(tmp_dir + "/log", np.random.default_rng(seed), 5)
    write_files(tmp_dir + "/log", {"_hidden": b"no", "empty.log": b""})
    for n, first in ((3, 1), (25, 7), (25, 1 << 16), (1000, 50)):
        want = [r.line for r in R.tail(SF.read_log_lines(spark, tmp_dir + "/log"), n, order_col="pos").orderBy("pos").collect()]
        got = [r.line for r in LE.tail_file(spark, tmp_dir + "/log", n, first).orderBy("pos").collect()]
        assert got == want and got


def test_tail_reads_the_end_only(spark, tmp_dir, monkeypatch):
    write_files(tmp_dir + "/log", {f"app-{i}.log": b"".join(b"%d line %d\n" % (i, k) for k in range(40_000)) for i in range(5)})
    reader = LE.EndReader(tmp_dir + "/log", LE.FIRST_BYTES)
    ranges = reader.partitions()
    assert [os.path.basename(r.path) for r in ranges] == ["app-4.log"] and ranges[0].end - ranges[0].start == LE.FIRST_BYTES
    monkeypatch.setattr(LE, "RANGE_BYTES", 1000)
    several = LE.EndReader(tmp_dir + "/log", 700_000)
    lines = [line for r in several.partitions() for b in several.read(r) for line in b.column("line").to_pylist()]
    assert sorted(lines) == sorted({*lines}) and {"4 line 0", "4 line 39999", "3 line 39999"} <= set(lines) and "3 line 0" not in lines
    assert [r.line for r in LE.tail_file(spark, tmp_dir + "/log").collect()] == [f"4 line {k}" for k in range(39_975, 40_000)]
    assert LE.tail_file(spark, tmp_dir + "/log/app-0.log", 2).count() == 2 and LE.tail_file(spark, tmp_dir + "/none").count() == 0
