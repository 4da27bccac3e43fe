"""Sinks: fixed-schema tables, snapshot versions, cache, processed-script files, edits."""

import os

from pyspark.sql import functions as F

from migtrack.schemas import TEST_LOG_SCHEMA, TRACKING_SCHEMA
from migtrack.sources import files as SF
from migtrack.sources import sinks as SK


def test_ensure_table_creates_once(spark, tmp_dir):
    path = tmp_dir + "/log"
    t = SK.ensure_table(spark, path, TEST_LOG_SCHEMA)
    assert t.count() == 0 and t.schema == TEST_LOG_SCHEMA
    spark.createDataFrame([(1, "1", "t", "p", None, "s", "-")], TEST_LOG_SCHEMA).write.mode("append").parquet(path)
    assert SK.ensure_table(spark, path, TEST_LOG_SCHEMA).count() == 1


def test_snapshot_versions(spark, tmp_dir):
    base = tmp_dir + "/tracking"
    assert SK.latest_version(spark, base) is None
    empty = spark.createDataFrame([], TRACKING_SCHEMA)
    SK.write_snapshot(empty, base, 0)
    SK.write_snapshot(empty, base, 1)
    SK.write_snapshot(empty, base, 1, replay=True)  # a repeated stream batch rewrites its version
    os.makedirs(SK.snapshot_path(base, 7))  # unfinished write: no _SUCCESS marker
    assert SK.latest_version(spark, base) == 1
    assert SK.read_snapshot(spark, base, TRACKING_SCHEMA).count() == 0


def test_cached_builds_once(spark, tmp_dir):
    calls = []

    def build():
        calls.append(1)
        return spark.range(5)
    assert SK.cached(spark, tmp_dir + "/c", build).count() == 5
    assert SK.cached(spark, tmp_dir + "/c", build).count() == 5
    assert len(calls) == 1


def test_write_processed_names_and_text(spark, tmp_dir):
    df = spark.createDataFrame([("a.sql", "x\ny"), ("b.sql", "")], "file_name string, text string")
    SK.write_processed(df, tmp_dir + "/p")
    got = {}
    for name in os.listdir(tmp_dir + "/p"):
        with open(f"{tmp_dir}/p/{name}", newline="") as f:
            got[name] = f.read()
    assert got == {"processed_a.sql": "x\ny", "processed_b.sql": ""}


def test_apply_edits_last_wins(spark):
    base = spark.createDataFrame([(1, "a.sql", "A"), (2, "b.sql", "B")], "doc_id long, file_name string, text string")
    edits = spark.createDataFrame([(1, "a.sql", "A1"), (3, "a.sql", "A3"), (2, "zz.sql", "Z")],
                                  "seq long, file_name string, text string")
    got = {r.file_name: r.text for r in SK.apply_edits(base, edits).collect()}
    assert got == {"a.sql": "A3", "b.sql": "B"}


def test_list_object_files_without_reading_content(spark, tmp_dir):
    os.makedirs(tmp_dir + "/o/user1/run", exist_ok=True)
    for name in ("user1/run/a.sql", "user1/b.sql"):
        with open(f"{tmp_dir}/o/{name}", "w") as f:
            f.write("x")
    paths = SF.list_object_files(spark, tmp_dir + "/o")
    plan = paths._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]
    from migtrack.operators import reports as R
    assert sorted(r.name for r in R.list_objects(paths, "user1", path_col="key").collect()) == ["a.sql", "b.sql"]
    assert R.any_object(paths, "user2", path_col="key").collect()[0].any_object is False


def test_bucketed_tracking_upsert_does_not_shuffle_target(spark, tmp_dir):
    from conftest import SF_SMALL
    from migtrack import fixtures as FX
    from migtrack.operators import catalog as C
    from migtrack.operators import upsert as U
    from migtrack.plans import flows
    routines, params = FX.load(spark, SF_SMALL, "routines", "params")
    procs = C.routines_from(routines)
    plain = flows.Store(tracking=tmp_dir + "/plain", test_log=tmp_dir + "/plog")
    bucketed = flows.Store(tracking=tmp_dir + "/bucketed", test_log=tmp_dir + "/blog", buckets=8)
    for store in (plain, bucketed):
        flows.load_catalogue(spark, store, procs, params, now=FX.LOAD_NOW)
    batch = C.attach_params(procs, params).withColumn("seq", F.lit(1).cast("long"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plans = {}
        for key, store in (("plain", plain), ("bucketed", bucketed)):
            df = U.upsert_tracking(store.read_tracking(spark), batch, now=FX.LOAD_NOW)
            df.write.format("noop").mode("overwrite").save()
            plans[key] = df._jdf.queryExecution().executedPlan().toString()
            assert df.count() == store.read_tracking(spark).count()
        assert "Bucketed: true" in plans["bucketed"]
        # the target scan feeds the join without its own exchange
        assert plans["bucketed"].count("Exchange hashpartitioning") < plans["plain"].count("Exchange hashpartitioning")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    r = flows.load_catalogue(spark, bucketed, procs, params, now=FX.LOAD_NOW)
    assert r["inserted"] == 0 and r["version"] == 1


def test_jdbc_options_for_partitioned_reads():
    from migtrack.sources import catalog
    one = catalog.jdbc_reader_options(catalog.PARAMS_QUERY, {"url": "jdbc:x"})
    assert one["query"] == catalog.PARAMS_QUERY and "dbtable" not in one
    many = catalog.jdbc_reader_options(catalog.PARAMS_QUERY, {
        "url": "jdbc:x", "partitionColumn": "ordinal_position", "lowerBound": "1", "upperBound": "100",
        "numPartitions": "8"})
    assert "query" not in many and many["dbtable"].startswith("(") and many["dbtable"].endswith("catalogue_rows")
    assert "WHERE ROUTINE_TYPE = 'PROCEDURE'" in catalog.ROUTINES_QUERY


def test_publish_round_trip_is_byte_exact(spark, tmp_dir):
    from migtrack.operators import results as Q
    from migtrack.schemas import TEST_LOG_SCHEMA as S
    import datetime as dt
    os.makedirs(tmp_dir + "/processed")
    with open(tmp_dir + "/processed/processed_p.sql", "w") as f:
        f.write("line 1\nline 2\n")
    scripts = SF.read_scripts(spark, tmp_dir + "/processed")
    log = spark.createDataFrame([(1, "1", "test_procedure_execution", "p", dt.datetime(2024, 1, 1),
                                  "✅ Success", "-")], S)
    SK.publish(Q.publish_found(log, scripts), tmp_dir + "/pub")
    assert os.listdir(tmp_dir + "/pub") == ["deployed_p.sql"]
    with open(tmp_dir + "/pub/deployed_p.sql") as f:
        assert f.read() == "line 1\nline 2\n"
