"""Tables kept in parts: a change writes the parts that hold it, everything else stays where it is."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import SF_SMALL
from migtrack import fixtures as FX
from migtrack.operators import upsert as U
from migtrack.plans import flows
from migtrack.schemas import TEST_LOG_SCHEMA, TRACKING_SCHEMA
from migtrack.sources import sinks as SK

NOW = dt.datetime(2026, 1, 1)


@pytest.fixture()
def stores(spark, tmp_dir):
    plain = flows.Store(tmp_dir + "/plain/t", tmp_dir + "/plain/l")
    parts = flows.Store(tmp_dir + "/parts/t", tmp_dir + "/parts/l", parts=8)
    tracking = FX.load(spark, SF_SMALL, "tracking")
    nameless = spark.createDataFrame([("S", f"db{i}", "dbo", None, f"d{i}", True, NOW, "T", "P", "", False, "") for i in range(40)], TRACKING_SCHEMA)
    for s in (plain, parts):
        s.write_tracking(tracking.unionByName(nameless), None)
    return plain, parts


def files(base):
    return {os.path.join(at, n): os.path.getmtime(os.path.join(at, n)) for at, _, names in os.walk(base) for n in names if n.endswith(".parquet")}


def rows(df):
    return sorted(map(str, df.collect()))


def outcomes(spark, some):
    return spark.createDataFrame([(e, str(e), t, p, NOW, s, "-") for e, t, p, s in some], TEST_LOG_SCHEMA)


def test_one_flag_writes_one_part(spark, stores):
    plain, parts = stores
    assert rows(parts.read_tracking(spark)) == rows(plain.read_tracking(spark))
    before = files(parts.tracking)
    one = parts.read_tracking(spark).where("schema_name IS NOT NULL AND NOT coalesce(conversion_flag, false)").limit(1).select(
        "dbname", "schema_name", "procedure_name", F.lit(True).alias("new_flag"))
    one = spark.createDataFrame(one.collect(), one.schema)
    for s in stores:
        assert flows.save_flags(spark, s, one)["changed"] == 1
    after = files(parts.tracking)
    new = {os.path.dirname(f) for f in set(after) - set(before)}
    assert len(new) == 1 and all(after[f] == t for f, t in before.items())
    whole, written = (sum(map(os.path.getsize, fs)) for fs in (before, set(after) - set(before)))
    assert written < whole / 4
    assert rows(parts.read_tracking(spark)) == rows(plain.read_tracking(spark))
    assert rows(parts.read_tracking(spark, 0)) == rows(plain.read_tracking(spark, 0)) != rows(plain.read_tracking(spark))


def test_all_steps_equal_those_of_a_plain_table(spark, stores):
    plain, parts = stores
    routines = spark.createDataFrame([("db0", "dbo", "usp_1", "new text"), ("db1", None, "usp_2", "loose"), ("db1", "dbo", None, "nameless"),
                                      ("db2", "x", "brand_new", "b")], "dbname string, schema_name string, procedure_name string, procedure_definition string")
    params = spark.createDataFrame([], "procedure_name string, mode string, name string, data_type string, char_length int, ordinal_position int")
    got = [flows.load_catalogue(spark, s, routines, params, now=NOW) for s in stores]
    assert got[0] == got[1] and got[0]["version"] == 1
    assert rows(parts.read_tracking(spark)) == rows(plain.read_tracking(spark))
    first = outcomes(spark, [(1, "test_procedure_execution", "usp_1(NULL)", "✅ Success"), (2, "t", "usp_2", "x"), (3, None, None, "y"), (4, "t", None, "z")])
    second = outcomes(spark, [(5, "t", "usp_2", "later"), (6, "t", None, "z"), (7, "test_procedure_execution", "usp_9", "✅ Success"), (8, "test_procedure_execution", None, "✅ Success")])
    for batch in (first, second):
        assert flows.record_results(spark, plain, batch) == flows.record_results(spark, parts, batch)
        assert rows(parts.read_log(spark)) == rows(plain.read_log(spark))
        assert rows(parts.read_tracking(spark)) == rows(plain.read_tracking(spark))
    assert parts.read_tracking(spark).where("is_deployed").count() >= 2


def test_a_second_writer_fails_and_an_unfinished_version_goes(spark, stores):
    _, parts = stores
    read = parts.tracking_version(spark)
    some = parts.read_tracking(spark, read, [1])
    assert parts.write_tracking(some, read, [1]) == 1
    with pytest.raises(SK.VersionTaken):
        parts.write_tracking(some, read, [1])
    os.remove(SK.snapshot_path(parts.tracking, 1) + "/_SUCCESS")
    assert parts.tracking_version(spark) == 0 and SK.discard_unfinished(spark, parts.tracking) == [1]
    whole = rows(parts.read_tracking(spark))
    assert parts.write_tracking(parts.read_tracking(spark, 0, [1]).where("false"), 0, [1]) == 1  # a part may become empty
    assert set(rows(parts.read_tracking(spark))) < set(whole)


def test_rows_of_other_parts_are_refused(spark, stores):
    _, parts = stores
    with pytest.raises(ValueError, match="not to be written"):
        parts.write_tracking(parts.read_tracking(spark), 0, [0])
    assert parts.tracking_version(spark) == 0


def test_an_upsert_reads_the_parts_of_its_names_only(spark, stores):
    _, parts = stores
    batch = parts.read_tracking(spark).where("procedure_name IS NOT NULL").limit(1)
    only = parts.touched(spark.createDataFrame(batch.collect(), batch.schema), flows.TRACKING_PART)
    assert len(only) == 1
    read = parts.read_tracking(spark, None, only)
    assert {f"part={only[0]}"} == {f.split("/")[-2] for f in read.inputFiles()}
    assert U.upsert_counts(read, FX.load(spark, SF_SMALL, "batch").where("false")).collect()[0].rows_inserted == 0
