"""Keyed writes against a row-by-row MERGE simulation."""

import datetime as dt

from hypothesis import given, settings, strategies as st

from migtrack.operators import upsert as U
from migtrack.schemas import STAGE_SCHEMA, TEST_LOG_SCHEMA, TRACKING_SCHEMA

NOW = dt.datetime(2026, 1, 1)
OLD = dt.datetime(2020, 1, 1)


def merge_row_by_row(target, source):
    """Sequential MERGE on (schema, name): returns (rows, inserted, updated)."""
    rows = [dict(r) for r in target]
    ins = upd = 0
    for s in sorted(source, key=lambda r: r["seq"]):
        hits = [r for r in rows if s["schema_name"] is not None and s["procedure_name"] is not None
                and r["schema_name"] == s["schema_name"] and r["procedure_name"] == s["procedure_name"]]
        if hits:
            for r in hits:
                r.update(procedure_definition=s["procedure_definition"], parameters=s["parameters"],
                         load_timestamp=NOW)
            upd += len(hits)
        else:
            rows.append(dict(source=s["source"], dbname=s["dbname"], schema_name=s["schema_name"],
                             procedure_name=s["procedure_name"],
                             procedure_definition=s["procedure_definition"], conversion_flag=False,
                             load_timestamp=NOW, target_dbname="TGT", target_schema_name="PUB",
                             parameters=s["parameters"], is_deployed=False, errors=""))
            ins += 1
    return rows, ins, upd


def canon(rows):
    return sorted(repr(tuple(sorted(r.items(), key=lambda kv: kv[0]))) for r in rows)


def tracking_row(schema, name, definition="d0", flag=None):
    return dict(source="SQLServer", dbname="db0", schema_name=schema, procedure_name=name,
                procedure_definition=definition, conversion_flag=flag, load_timestamp=OLD,
                target_dbname="TGT", target_schema_name="PUB", parameters="", is_deployed=False,
                errors="")


def stage_row(seq, schema, name, definition, db="db1", params="@a int"):
    return dict(seq=seq, source="SQLServer", dbname=db, schema_name=schema, procedure_name=name,
                procedure_definition=definition, parameters=params)


def run_upsert(spark, target, source):
    t = spark.createDataFrame(target, TRACKING_SCHEMA)
    s = spark.createDataFrame(source, STAGE_SCHEMA)
    out = U.upsert_tracking(t, s, now=NOW, target_dbname="TGT", target_schema_name="PUB")
    counts = U.upsert_counts(t, s).collect()[0]
    return [r.asDict() for r in out.collect()], counts.rows_inserted, counts.rows_updated


def test_upsert_nulls_and_duplicates(spark):
    target = [tracking_row("dbo", "a", flag=True), tracking_row("dbo", "b"),
              tracking_row(None, "a"), tracking_row("dbo", "dup"), tracking_row("dbo", "dup")]
    source = [stage_row(3, "dbo", "a", "v3"), stage_row(1, "dbo", "a", None, db="first"),
              stage_row(2, "hr", "new", "n2", db="dbA"), stage_row(5, "hr", "new", "n5", db="dbB"),
              stage_row(4, None, "a", "null-key"), stage_row(6, None, "a", "null-key-2"),
              stage_row(7, "dbo", "dup", "dd")]
    got, ins, upd = run_upsert(spark, target, source)
    want, wins, wupd = merge_row_by_row(target, source)
    assert canon(got) == canon(want)
    assert (ins, upd) == (wins, wupd)
    new = [r for r in got if r["procedure_name"] == "new"][0]
    assert new["dbname"] == "dbA" and new["procedure_definition"] == "n5"  # first identity, last values


def test_upsert_null_definition_is_written(spark):
    got, _, _ = run_upsert(spark, [tracking_row("dbo", "a", definition="old")],
                           [stage_row(1, "dbo", "a", None)])
    assert got[0]["procedure_definition"] is None


keys = st.tuples(st.sampled_from(["dbo", "hr", None]), st.sampled_from(["p", "q", "r", None]))


@settings(max_examples=25, deadline=None)
@given(st.lists(keys, max_size=6), st.lists(st.tuples(keys, st.sampled_from(["x", "y", None])), max_size=8))
def test_upsert_random_vs_row_by_row(spark, tkeys, skeys):
    target = [tracking_row(s, n, definition=f"t{i}") for i, (s, n) in enumerate(tkeys)]
    source = [stage_row(i, s, n, d, db=f"db{i}") for i, ((s, n), d) in enumerate(skeys)]
    got, ins, upd = run_upsert(spark, target, source)
    want, wins, wupd = merge_row_by_row(target, source)
    assert canon(got) == canon(want)
    assert (ins, upd) == (wins, wupd)


def test_upsert_replay_is_idempotent(spark):
    target = [tracking_row("dbo", "a")]
    source = [stage_row(1, "dbo", "a", "v1"), stage_row(2, "hr", "b", "v2")]
    t = spark.createDataFrame(target, TRACKING_SCHEMA)
    s = spark.createDataFrame(source, STAGE_SCHEMA)
    once = U.upsert_tracking(t, s, now=NOW, target_dbname="TGT", target_schema_name="PUB")
    twice = U.upsert_tracking(once, s, now=NOW, target_dbname="TGT", target_schema_name="PUB")
    assert canon([r.asDict() for r in once.collect()]) == canon([r.asDict() for r in twice.collect()])


def log_row(eid, test, proc, status="✅ Success", ts=None):
    return dict(event_id=eid, test_case_id=str(eid), test_case_name=test, procedure_name=proc,
                test_timestamp=ts or dt.datetime(2024, 1, 1, 0, 0, eid % 60, 123456), status=status,
                errors="-")


def test_result_upsert_matches_sequential(spark):
    old = [log_row(1, "t1", "p"), log_row(2, "t2", "p"), log_row(3, None, "p")]
    new = [log_row(4, "t1", "p", "❌ Failed"), log_row(5, "t1", "p"), log_row(6, "t3", "q"),
           log_row(7, None, "p")]
    o = spark.createDataFrame(old, TEST_LOG_SCHEMA)
    n = spark.createDataFrame(new, TEST_LOG_SCHEMA)
    out = U.upsert_results(U.upsert_results(None, o), n).collect()
    state = {}
    loose = []
    for r in old + new:
        if r["test_case_name"] is None or r["procedure_name"] is None:
            loose.append(r["event_id"])
        else:
            state[(r["test_case_name"], r["procedure_name"])] = r["event_id"]
    assert sorted(r.event_id for r in out) == sorted(list(state.values()) + loose)
    assert all(r.test_timestamp.microsecond % 1000 == 0 for r in out)


def test_insert_absent(spark):
    target = spark.createDataFrame([tracking_row("dbo", "a")], TRACKING_SCHEMA)
    src = spark.createDataFrame([stage_row(1, "dbo", "a", "x"), stage_row(2, "hr", "b", "x"),
                                 stage_row(3, "hr", "b", "y"), stage_row(4, None, "b", "z"),
                                 stage_row(5, None, "b", "z")], STAGE_SCHEMA)
    out = U.insert_absent(target, src, ("schema_name", "procedure_name"))
    assert {r.seq: r.accepted for r in out.collect()} == {1: False, 2: True, 3: False, 4: True, 5: True}


def test_insert_absent_with_ties_missing_seq_and_repeated_rows(spark):
    target = spark.createDataFrame([tracking_row("dbo", "a")], TRACKING_SCHEMA)
    rows = [stage_row(1, "hr", "tie", "x"), stage_row(1, "hr", "tie", "y"), stage_row(None, "hr", "none", "x"), stage_row(None, "hr", "none", "y"),
            stage_row(None, "hr", "some", "x"), stage_row(9, "hr", "some", "y"), *[stage_row(3, "hr", "same", "x")] * 50,
            *[stage_row(3, None, "same", "x")] * 4, *[stage_row(0, "dbo", "a", "x")] * 3]
    out = U.insert_absent(target, spark.createDataFrame(rows, STAGE_SCHEMA), ("schema_name", "procedure_name")).collect()
    assert len(out) == len(rows)
    taken = sorted((r.schema_name or "", r.procedure_name, r.seq or -1) for r in out if r.accepted)
    assert taken == [("", "same", 3)] * 4 + [("hr", "none", -1), ("hr", "same", 3), ("hr", "some", 9), ("hr", "tie", 1)]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["t1", "t2", None]), st.sampled_from(["p", "q"]),
                          st.sampled_from(["✅ Success", "❌ Failed"])), min_size=1, max_size=12),
       st.randoms(use_true_random=False))
def test_stream_merge_is_order_free(spark, rows, rnd):
    from migtrack.streaming.result_log import merge_newest
    events = [log_row(i, t, p, s) for i, (t, p, s) in enumerate(rows)]
    chunks = [events[i::3] for i in range(3)]
    rnd.shuffle(chunks)
    state = None
    for chunk in chunks:
        if chunk:
            state = merge_newest(state, spark.createDataFrame(chunk, TEST_LOG_SCHEMA))
    batch = U.upsert_results(None, spark.createDataFrame(events, TEST_LOG_SCHEMA))
    key = lambda r: r.event_id
    assert sorted(state.collect(), key=key) == sorted(batch.collect(), key=key)
