"""Result operators: latest status, ids, pending tests, deploy and publish sets."""

import datetime as dt

from pyspark.sql import functions as F

from migtrack.functions import patterns as P
from migtrack.operators import catalog as C
from migtrack.operators import reports as R
from migtrack.operators import results as Q
from migtrack.schemas import TEST_LOG_SCHEMA, TRACKING_SCHEMA

OK, BAD = P.STATUS_SUCCESS, P.STATUS_FAILED


def log(spark, rows):
    return spark.createDataFrame(
        [dict(event_id=i, test_case_id=str(i), test_case_name=t, procedure_name=p, test_timestamp=ts,
              status=s, errors="-") for i, t, p, ts, s in rows], TEST_LOG_SCHEMA)


T1 = dt.datetime(2024, 1, 1, 10)
T2 = dt.datetime(2024, 1, 1, 11)


def test_latest_status_null_time_wins_and_ties(spark):
    df = log(spark, [(1, P.TEST_CREATE, "a", T2, OK), (2, P.TEST_EXECUTION, "a", None, BAD),
                     (3, P.TEST_CREATE, "b", T1, OK), (4, P.TEST_EXECUTION, "b", T2, BAD),
                     (5, P.TEST_CREATE, "c", T1, BAD), (6, P.TEST_EXECUTION, "c", T1, OK)])
    got = {r.procedure_name: r.status for r in Q.latest_status(df).collect()}
    assert got == {"a": BAD, "b": BAD, "c": OK}


def test_sample_page_rows(spark):
    # the two rows of the published sample result page: both tests failed
    df = log(spark, [(1, P.TEST_CREATE, "GetTopRentedMovies", T1, BAD),
                     (2, P.TEST_EXECUTION, "GetTopRentedMovies", T2, BAD)])
    m = Q.result_metrics(df).collect()[0]
    assert (m.total_tests, m.passed_tests, m.failed_tests) == (2, 0, 2)
    assert Q.passed(df).count() == 0
    assert Q.latest_status(df).collect()[0].status == BAD


def test_metrics_count_null_status_as_failed(spark):
    df = log(spark, [(1, "t", "a", T1, OK), (2, "t", "b", T1, None), (3, "t", "c", T1, "other")])
    m = Q.result_metrics(df).collect()[0]
    assert (m.total_tests, m.passed_tests, m.failed_tests) == (3, 1, 2)


def test_facet_filter_empty_and_large_lists(spark):
    df = log(spark, [(i, "t", f"p{i}", T1, OK if i % 2 else BAD) for i in range(20)])
    assert Q.facet_filter(df, {"procedure_name": [], "status": []}).count() == 20
    assert Q.facet_filter(df, {"status": [OK], "test_case_id": ["1", "3", "4"]}).count() == 2
    many = [f"p{i}" for i in range(5000)]
    assert Q.facet_filter(df, {"procedure_name": many}).count() == 20
    odd = df.withColumn("test_case_id", F.when(F.col("event_id") == 7, "x").otherwise(F.col("test_case_id")))
    for values in ([1, 2], ["1", "2"], [1, "2", None], [*range(1, 3), *range(1000, 3000)]):
        assert Q.facet_filter(odd, {"test_case_id": values}).count() == 2


def test_assign_ids_consecutive_in_order(spark):
    df = spark.range(0, 3000).select(F.format_string("f%05d", (F.col("id") * 7919) % 3000).alias("f"))
    out = Q.assign_ids(df.repartition(7), ["f"]).collect()
    got = sorted((int(r.test_case_id), r.f) for r in out)
    assert [i for i, _ in got] == list(range(1, 3001))
    assert [f for _, f in got] == sorted(f for _, f in got)


def test_pending_skips_only_passed(spark):
    cand = spark.createDataFrame([("t1", "a"), ("t2", "a"), ("t1", "b"), ("t1", None)],
                                 "test_case_name string, procedure_name string")
    lg = log(spark, [(1, "t1", "a", T1, OK), (2, "t2", "a", T1, BAD), (3, "t1", None, T1, OK)])
    got = sorted((r.test_case_name, r.procedure_name or "") for r in Q.pending_tests(cand, lg).collect())
    assert got == [("t1", ""), ("t1", "b"), ("t2", "a")]


def test_mark_deployed_by_bare_name_in_every_schema(spark):
    t = spark.createDataFrame([dict(source="s", dbname="d", schema_name=sch, procedure_name=n,
                                    procedure_definition="x", conversion_flag=True,
                                    load_timestamp=T1, target_dbname="T", target_schema_name="P",
                                    parameters="", is_deployed=False, errors="")
                               for sch, n in [("dbo", "p"), ("hr", "p"), ("dbo", "q")]], TRACKING_SCHEMA)
    lg = log(spark, [(1, P.TEST_EXECUTION, "p(1, 2)", T1, OK), (2, P.TEST_CREATE, "q", T1, OK)])
    got = {(r.schema_name, r.procedure_name): r.is_deployed for r in Q.mark_deployed(t, lg).collect()}
    assert got == {("dbo", "p"): True, ("hr", "p"): True, ("dbo", "q"): False}


def test_publish_found_and_missing(spark):
    lg = log(spark, [(1, P.TEST_EXECUTION, "a", T1, OK), (2, P.TEST_EXECUTION, "b", T1, OK),
                     (3, P.TEST_EXECUTION, "c", T1, BAD)])
    scripts = spark.createDataFrame([("processed_a.sql", "A")], "file_name string, text string")
    found = Q.publish_found(lg, scripts).collect()
    assert [(r.procedure_name, r.target_file, r.text) for r in found] == [("a", "deployed_a.sql", "A")]
    assert [r.procedure_name for r in Q.publish_missing(lg, scripts).collect()] == ["b"]


def test_pair_scripts_missing_original(spark):
    proc = spark.createDataFrame([("processed_x.sql", "X2"), ("processed_y.sql", "Y2"), ("z.sql", "Z")],
                                 "file_name string, text string")
    ext = spark.createDataFrame([("x", "x.sql", "X1\n")], "procedure_name string, file_name string, body string")
    got = {r.file_name: r.original for r in Q.pair_scripts(proc, ext, "/ex").collect()}
    assert got == {"processed_x.sql": "X1\n", "processed_y.sql": "--- FILE NOT FOUND ---\nPath: /ex/y.sql",
                   "z.sql": None}


def test_changed_and_updated_flags(spark):
    t = spark.createDataFrame([dict(source="s", dbname="d", schema_name="dbo", procedure_name=n,
                                    procedure_definition="x", conversion_flag=f, load_timestamp=T1,
                                    target_dbname="T", target_schema_name="P", parameters="",
                                    is_deployed=False, errors="")
                               for n, f in [("a", None), ("b", True), ("c", False)]], TRACKING_SCHEMA)
    prop = spark.createDataFrame([("d", "dbo", "a", False), ("d", "dbo", "b", False), ("d", "dbo", "c", True)],
                                 "dbname string, schema_name string, procedure_name string, new_flag boolean")
    ch = C.changed_flags(t, prop)
    assert sorted((r.procedure_name, r.new_flag) for r in ch.collect()) == [("b", False), ("c", True)]
    upd = {r.procedure_name: r.conversion_flag for r in C.update_flags(t, ch).collect()}
    assert upd == {"a": None, "b": False, "c": True}


def test_log_tail_strips_trailing_blank_lines(spark):
    rows = [(i, f"line {i}") for i in range(1, 41)] + [(41, "last  \t"), (42, "   "), (43, "")]
    df = spark.createDataFrame(rows, "line_no long, line string")
    got = [(r.line_no, r.line) for r in R.tail(df).collect()]
    assert got[-1] == (41, "last") and len(got) == 25 and got[0][0] == 17


def test_parse_log_continuation(spark):
    df = spark.createDataFrame([(1, "2024-01-31 10:20:30,123 - INFO - started\nmore"), (2, "raw line")],
                               "line_no long, line string")
    got = R.parse_log(df).orderBy("line_no").collect()
    assert got[0].level == "INFO" and got[0].message == "started\nmore"
    assert got[0].log_time == dt.datetime(2024, 1, 31, 10, 20, 30, 123000)
    assert got[1].level is None and got[1].message == "raw line"


def test_any_object(spark):
    df = spark.createDataFrame([("a/b/c.sql",), ("x/y",)], "path string")
    assert R.any_object(df, "a/").collect()[0].any_object is True
    assert R.any_object(df, "zz").collect()[0].any_object is False
    assert [r.name for r in R.list_objects(df, "a/").collect()] == ["c.sql"]


def test_schema_groups_and_members_split_at_first_two_dots(spark):
    t = spark.createDataFrame([dict(source="s", dbname=d, schema_name=sch, procedure_name=n,
                                    procedure_definition="x", conversion_flag=None, load_timestamp=T1,
                                    target_dbname="T", target_schema_name="P", parameters="",
                                    is_deployed=False, errors="")
                               for d, sch, n in [("db", "dbo", "a"), ("db", "dbo", "a"), ("db", "dbo", "b"),
                                                 ("db.x", "dbo", "c"), (None, "hr", "d")]], TRACKING_SCHEMA)
    groups = {(r.dbname, r.schema_name): r.n_procs for r in C.schema_groups(t).collect()}
    assert groups == {("db", "dbo"): 2, ("db", "x"): 1, ("None", "hr"): 1}
    members = [(r.dbname, r.schema_name, r.procedure_name) for r in C.schema_members(t).collect()]
    assert members == [("None", "hr", "d"), ("db", "dbo", "a"), ("db", "dbo", "b"), ("db", "x", "dbo.c")]
