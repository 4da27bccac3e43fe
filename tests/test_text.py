"""Text functions against plain-Python statements of the same rules."""

import datetime as dt
import os
import re

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from migtrack.functions import patterns as P
from migtrack.functions import text as T
from conftest import one_col

MARK = P.MARKER


def py_drop_marked(s: str) -> str:
    """Brute force over the line list: a line goes when it holds the marker, or when it is
    non-blank and the previous non-blank line holds it."""
    lines = s.splitlines()
    solid = [i for i, line in enumerate(lines) if line.strip()]
    gone = {i for k, i in enumerate(solid)
            if MARK in lines[i] or (k > 0 and MARK in lines[solid[k - 1]])}
    return "\n".join(line for i, line in enumerate(lines) if i not in gone)


def py_clean(s: str, src: str, dst: str) -> str:
    s = re.sub(r"--.*", "", s)
    s = re.sub(r"/\*.*?\*/", "", s, flags=re.S)
    s = re.sub(r"\b" + src + r"\b", dst, s, flags=re.I)
    s = s.replace("$$", "")
    return py_drop_marked(s)


def run(spark, fn, values):
    df = one_col(spark, values)
    return [r[0] for r in df.select(fn(F.col("text")).alias("o")).collect()]


CASES = [
    "",
    "\n",
    MARK,
    MARK + "\n",
    "a\n" + MARK,
    "a\n" + MARK + "\nX\nb",
    "a\n" + MARK + "\n\n   \nX\nb\n",
    MARK + "\n\n" + MARK + "\n\t\nX\nY\nZ",
    "x " + MARK + " y\nkeep?\nkeep",
    "a\r\n" + MARK + "\r\nX\r\nb\r\n",
    "a\x0b" + MARK + "\x0cX\x1cb\x85c d e",
    MARK + "\n\x1f\nX\nb",
    MARK + "\n　 \nX\nb",
    "a\n\n",
    "a\n\nb\n\n\n",
    "only\n" + MARK + "\n\n\n",
    MARK + MARK + "\n" + MARK + "\nq\nr",
]


def test_drop_marked_cases(spark):
    got = run(spark, T.drop_marked, CASES)
    assert got == [py_drop_marked(c) for c in CASES]


line_text = st.sampled_from(["", " ", "\t", "a", "bc d", MARK, "x" + MARK, "  " + MARK + " z", "　", "$$", "dbo"])
texts = st.lists(line_text, max_size=12).flatmap(
    lambda ls: st.sampled_from(["\n", "\r\n", "\r"]).map(lambda sep: sep.join(ls)))


@settings(max_examples=60, deadline=None)
@given(st.lists(texts, min_size=1, max_size=20))
def test_drop_marked_random(spark, values):
    assert run(spark, T.drop_marked, values) == [py_drop_marked(v) for v in values]


CLEAN_CASES = [
    "CREATE PROC dbo.x AS -- tail " + MARK + "\nSELECT 1 FROM DBO.t_dbo; /* c\n" + MARK + " */\n$$q$$",
    "a -- /* b\nc */ d\n" + MARK + "\nnext\nlast",
    "x /* -- inner */ y\n'--not a comment?'\nz",
    "dbo.dbo_x xdbo Dbo\n" + MARK + " -- c\n\nnext\n$$",
]


def test_clean_script_cases(spark):
    got = run(spark, lambda c: T.clean_script(c, "dbo", "PUBLIC"), CLEAN_CASES)
    assert got == [py_clean(c, "dbo", "PUBLIC") for c in CLEAN_CASES]


def test_clean_script_on_fixture_corpus(spark):
    from migtrack import fixtures as FX
    s = FX.load(spark, "/root/testdata/sf0.001", "scripts")
    rows = s.select("text", T.clean_script("text", "dbo", "PUBLIC").alias("o")).collect()
    assert all(r.o == py_clean(r.text, "dbo", "PUBLIC") for r in rows)


def test_rename_schema_replacement_is_literal(spark):
    got = run(spark, lambda c: T.rename_schema(c, "dbo", "a$1\\b"), ["x dbo y"])
    assert got == ["x a$1\\b y"]


def test_clean_script_plan_is_one_projection(spark):
    df = one_col(spark, ["a"]).select(T.clean_script("text", "dbo", "X").alias("o"))
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan


def test_param_block(spark):
    cases = [
        "CREATE PROCEDURE dbo.p (@a INT,\n  @b  VARCHAR(10))\nAS BEGIN",
        "create proc x\n@a int\nas select 1",
        "CREATE PROCEDURE GetLastFoo (@a INT) AS SELECT 1",  # Q4: 'as' inside the name ends the header
        "ALTER PROC p() BEGIN",
        "no header here",
        "CREATE PROCEDURE p (\n\t@a INT\x1c) AS",
    ]
    pat = re.compile(P.PARAM_HEADER, re.I | re.S)

    def py(s):
        m = pat.search(s)
        if m and m.group(1) is not None and m.group(1).strip():
            return re.sub(r"\s+", " ", m.group(1).strip()).strip()
        return ""
    assert run(spark, T.param_block, cases) == [py(c) for c in cases]
    assert run(spark, T.param_block, [cases[2]]) == [""]


def test_safe_name_stem_proc_unprefixed(spark):
    names = ["usp_1", "a b.c", "ü-ß_9", "x/y\\z", "日本", "á", "𝔘x"]
    assert run(spark, T.safe_name, names) == [
        "".join(c if c.isalnum() or c in "_-" else "_" for c in n) for n in names]
    files = ["a.b.sql", ".sql", "a..sql", "abc", "x.", "...sql", "a.sql"]
    assert run(spark, T.stem, files) == [os.path.splitext(f)[0] for f in files]
    tests = ["v1_myproc.sql", "myproc.sql", "processed_A_B.sql", "a.b.sql", "x_.sql", "noext"]

    def py_proc(f):
        m = re.match(r".*_(?P<p>[^.]+)\.sql$", f) or re.match(r"(?P<p>[^.]+)\.sql$", f)
        return m.group("p") if m else None
    assert run(spark, T.proc_from_file, tests) == [py_proc(f) for f in tests]
    procs = ["processed_usp_1.sql", "usp_1.sql", "processed_.sql", "ab"]

    def py_un(f):
        m = re.match(r"^processed_(.*)$", f[:-4])
        return m.group(1) if m else None
    assert run(spark, T.unprefixed, procs) == [py_un(f) for f in procs]


def test_label_roundtrip_and_q7(spark):
    names = ["processed_usp_1.sql", "processed_" + "n" * 45 + ".sql", "usp_2.sql"]
    df = spark.createDataFrame([(n, P.STATUS_SUCCESS) for n in names], "f string, s string")
    rows = df.select(T.label("f", "s").alias("l")).select("l", T.unlabel("l").alias("b")).collect()

    def py_label(f, s):
        lab = f"{f.ljust(50)} [{s}]"
        m = re.match(r"^processed_(.*)$", lab)
        return m.group(1) if m else None
    assert [r.l for r in rows] == [py_label(n, P.STATUS_SUCCESS) for n in names]
    assert rows[0].b == "usp_1.sql"
    assert rows[1].b != "n" * 45 + ".sql"  # Q7: no two blanks left, so the name cannot be parsed back
    assert rows[2].l is None


def test_call_text_and_param_count(spark):
    df = spark.createDataFrame([("p", "@a INT, @b DECIMAL(10,2)"), ("q", "  "), ("r", None), ("s", "x")],
                               "n string, p string")
    rows = df.select(T.param_count("p").alias("k"), T.call_text("n", "p").alias("c")).collect()
    assert [(r.k, r.c) for r in rows] == [(3, "p(NULL, NULL, NULL)"), (0, "q()"), (0, "r()"), (1, "s(NULL)")]


def test_param_desc_nulls(spark):
    df = spark.createDataFrame([("IN", "@a", "int", None), (None, "@b", "varchar", 10)],
                               "m string, n string, t string, l int")
    got = [r[0] for r in df.select(T.param_desc("m", "n", "t", "l")).collect()]
    assert got == ["IN @a int", "None @b varchar(10)"]


def test_bare_name_and_export_body(spark):
    assert run(spark, T.bare_name, ["p(1, 2)", "p", "p(a)x"]) == ["p", "p", "p(a)x"]
    assert run(spark, T.export_body, ["  body \n\t", "x"]) == ["body\n", "x\n"]


def test_expiries_skip_bad_dates(spark):
    text = ("Expiration date: 13/01/2024 3:04:05\nExpiration date: 2/29/2021 1:00:00\n"
            "Expiration date:  1/15/2030   23:00:00\nExpiration date: 4/31/2022 1:00:00\n"
            "Expiration date: 12/31/2022 24:00:00")
    df = one_col(spark, [text, "nothing", None])
    rows = df.select(T.expiries("text").alias("d")).select(
        "d", T.any_after("d", "2023-06-01 00:00:00").alias("a")).collect()
    assert rows[0].d == [dt.datetime(2030, 1, 15, 23, 0, 0)]
    assert rows[0].a is True
    assert rows[1].d == [] and rows[1].a is False
    assert rows[2].a is False


def test_report_metrics_defaults(spark):
    text = "- Files: 12\n- Automatically converted: n/a\n- Conversion time: 00:01:02.5\n- Conversion speed: 7 lines/s"
    row = one_col(spark, [text]).select(*T.report_metrics("text")).collect()[0]
    assert row.asDict() == {"files": "12", "not_generated": "N/A", "total_loc": "N/A",
                            "auto_conv_pct": "N/A", "conv_time": "00:01:02.5", "speed_loc_s": "7"}


def test_utc_ms_cuts(spark):
    df = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, 0, 7, 179575),)], "t timestamp_ntz")
    got = df.select(T.utc_ms("t").alias("o")).collect()[0].o
    assert got == dt.datetime(2024, 1, 1, 0, 0, 7, 179000)


def test_qualify_split(spark):
    df = spark.createDataFrame([("a.b", "s", "p"), (None, "s", "p.q")], "d string, s string, p string")
    rows = df.select(T.qualify("d", "s", "p").alias("f")).select("f", T.unqualify("f").alias("u")).collect()
    assert [r.f for r in rows] == ["a.b.s.p", "None.s.p.q"]
    assert [r.u for r in rows] == [["a", "b", "s.p"], ["None", "s", "p.q"]]


def test_time_functions_ignore_session_zone(spark):
    from migtrack.operators import reports as R
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        # 2024-03-10 02:30 does not exist in New York (clocks jump from 2:00 to 3:00)
        df = spark.createDataFrame([(dt.datetime(2024, 3, 10, 2, 30, 0, 999999),)], "t timestamp_ntz")
        assert df.select(T.utc_ms("t")).collect()[0][0] == dt.datetime(2024, 3, 10, 2, 30, 0, 999000)
        txt = one_col(spark, ["Expiration date: 3/10/2024 2:30:00"])
        assert txt.select(T.expiries("text")).collect()[0][0] == [dt.datetime(2024, 3, 10, 2, 30)]
        lines = spark.createDataFrame([(1, "2024-03-10 02:30:00,250 - INFO - x")], "line_no long, line string")
        assert R.parse_log(lines).collect()[0].log_time == dt.datetime(2024, 3, 10, 2, 30, 0, 250000)
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


pieces = st.sampled_from(["--", "/*", "*/", "\n", "\r\n", "\r", " ", "\t", "dbo", "DBO", "xdbo", "dbo_x", "é", "$$",
                          "$", MARK, "a", "b c", "'--'", " ", "\x0c", "ß"])


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(pieces, max_size=25).map("".join), min_size=1, max_size=15))
def test_clean_script_random(spark, values):
    assert run(spark, lambda c: T.clean_script(c, "dbo", "PUBLIC"), values) == \
        [py_clean(v, "dbo", "PUBLIC") for v in values]


def test_search_is_literal_and_case_insensitive(spark):
    from migtrack.operators import catalog as C
    df = spark.createDataFrame([("usp_%a",), ("USP_XA",), ("uspxa",)], "procedure_name string")
    assert [r[0] for r in C.search(df, "P_%").collect()] == ["usp_%a"]
    assert [r[0] for r in C.search(df, "p_x").collect()] == ["USP_XA"]
    assert C.search(df, "").count() == 3


def test_rename_schema_word_boundary_like_python(spark):
    values = ["x²dbo y", "édbo y", "a‿dbo", "Ⅻdbo", "_dbo", "DBO.t", "(dbo)", "dbo", "ſdbo", "dbos"]
    got = run(spark, lambda c: T.rename_schema(c, "dbo", "NEW"), values)
    assert got == [re.sub(r"\bdbo\b", "NEW", v, flags=re.I) for v in values]
    alts = ["dbo.hr x", "hrdbo", "dbox", "xhr", "xdbo hrx"]
    alt = run(spark, lambda c: T.rename_schema(c, "dbo|hr", "NEW"), alts)
    assert alt == [re.sub(r"\bdbo|hr\b", "NEW", v, flags=re.I) for v in alts]


def test_clean_script_long_texts(spark):
    # long scripts: many lines, a huge block comment, a long blank run after a marker
    lines = [MARK if i % 50 == 0 else ("" if i % 50 in (1, 2) else f"SELECT {i} FROM dbo.t -- c")
             for i in range(60000)]
    values = ["\n".join(lines), "/*" + "x\n" * 100000 + "*/ dbo\n" + MARK + "\n" * 30000 + "after"]
    assert run(spark, lambda c: T.clean_script(c, "dbo", "PUBLIC"), values) == \
        [py_clean(v, "dbo", "PUBLIC") for v in values]


def test_strip_takes_one_pass_over_long_runs_of_blanks(spark):
    import time

    from pyspark.sql import functions as F

    from migtrack.functions import text as T
    texts = ["a" + " " * 300_000 + "b", " \n\x85" + "\t" * 300_000, " x \U0001f642\u3000\n", "", "\n a\n b \x1c", None]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select(T.py_strip(F.col("text")).alias("s"))
    began = time.time()
    assert [r.s for r in df.collect()] == [t if t is None else t.strip() for t in texts]
    assert time.time() - began < 15
