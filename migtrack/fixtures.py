"""Representative inputs derived from the driver tables, as SQL both engines run.

Each view is plain SQL over the driver tables (or earlier views) that Spark
and DuckDB answer equally. Spark registers them as temp views; the oracle SQL
puts the same text in a ``WITH`` clause. Every query runs over the whole tables:
rows that a target does not hold, or files that are missing, are made by renaming keys.
"""

from __future__ import annotations

import re

from pyspark.sql import SparkSession

BASE_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

# name -> (sql, views it reads)
VIEWS: dict[str, tuple[str, tuple[str, ...]]] = {
    # routine catalogue, one row per routine, (schema, name) unique.
    "routines": ("""
SELECT o_orderkey AS seq, 'SQLServer' AS source, 'db' || CAST(o_custkey % 3 AS STRING) AS dbname,
  CASE (o_orderkey - o_orderkey % 2) % 3 WHEN 0 THEN 'dbo' WHEN 1 THEN 'sales' ELSE 'hr' END AS schema_name,
  'usp_' || CAST(o_orderkey AS STRING) AS procedure_name,
  CASE WHEN o_orderkey % 5 = 0 THEN 'FUNCTION' ELSE 'PROCEDURE' END AS routine_type,
  ' CREATE PROCEDURE usp_' || CAST(o_orderkey AS STRING) || ' AS SELECT ' || CAST(o_custkey AS STRING) || chr(10) AS procedure_definition
FROM orders""", ()),
    # parameter catalogue; (name, ordinal) is not unique.
    "params": ("""
SELECT 'usp_' || CAST(l_orderkey AS STRING) AS procedure_name,
  CASE l_linestatus WHEN 'O' THEN 'INOUT' ELSE 'IN' END AS mode,
  '@p' || CAST(l_linenumber AS STRING) AS name,
  CASE l_returnflag WHEN 'A' THEN 'int' WHEN 'N' THEN 'datetime' ELSE 'varchar' END AS data_type,
  CASE WHEN l_returnflag = 'R' THEN CAST(l_quantity AS INT) END AS char_length,
  l_linenumber AS ordinal_position
FROM lineitem""", ()),
    # F1t: tracking table before the load: every routine, some without a definition or a
    # schema; flag TRUE/FALSE/NULL.
    "tracking": ("""
SELECT source, dbname, CASE WHEN seq % 43 <> 0 THEN schema_name END AS schema_name, procedure_name,
  CASE WHEN seq % 41 <> 0 THEN procedure_definition END AS procedure_definition,
  CASE o_orderstatus WHEN 'F' THEN TRUE WHEN 'O' THEN FALSE END AS conversion_flag,
  o_orderdate AS load_timestamp, 'TGT' AS target_dbname, 'PUBLIC' AS target_schema_name,
  '' AS parameters, FALSE AS is_deployed, '' AS errors
FROM routines JOIN orders ON o_orderkey = seq""", ("routines",)),
    # A load batch of all procedures with duplicate keys (two routines per name), names that the
    # tracking table does not hold, and keys with a NULL part; seq gives the order.
    "batch": ("""
SELECT seq, source, dbname, CASE WHEN seq % 47 <> 0 THEN schema_name END AS schema_name,
  CASE WHEN seq % 53 = 0 THEN NULL WHEN (seq - seq % 2) % 7 = 3 THEN 'new_' ELSE 'usp_' END || CAST(seq - seq % 2 AS STRING) AS procedure_name,
  'v2 ' || procedure_definition AS procedure_definition, '@a int' AS parameters
FROM routines WHERE routine_type = 'PROCEDURE'""", ("routines",)),
    # converted-script corpus with headers, comments, markers, schema words, $$.
    "scripts": ("""
SELECT doc_id, 'processed_usp_' || CAST(doc_id AS STRING) || '.sql' AS file_name, source,
  'CREATE OR REPLACE PROCEDURE dbo.' || CASE WHEN doc_id % 10 = 0 THEN 'GetLast' ELSE 'Fetch' END || CAST(doc_id AS STRING)
  || ' (@a VARCHAR(' || CAST(n_chars AS STRING) || '),' || chr(10) || '   @b INT)' || chr(10) || 'AS BEGIN $$' || chr(10)
  || '-- from ' || source || chr(10)
  || CASE WHEN doc_id % 2 = 0 THEN '!!!RESOLVE EWI!!! /*** EWI-0040 ***/!!!' || chr(10) || chr(10) || '  ' || chr(10) || 'bad stmt' || chr(10) ELSE '' END
  || CASE WHEN doc_id % 3 = 0 THEN 'x !!!RESOLVE EWI!!!' || chr(10) || chr(10) || '!!!RESOLVE EWI!!!' || chr(10) || 'bad two' || chr(10) || 'good' || chr(10) ELSE '' END
  || '/* block' || chr(10) || 'over lines */' || chr(10) || 'SELECT * FROM DBO.t_dbo;' || chr(10) || text || chr(10) || '$$' AS text
FROM documents""", ()),
    # test outcomes numbered by event_id; some without a time, a status or a part of the key.
    "test_log": ("""
SELECT event_id, CAST(event_id AS STRING) AS test_case_id,
  CASE WHEN event_id % 83 = 0 THEN NULL WHEN event_type IN ('view', 'click') THEN 'test_create_procedure' ELSE 'test_procedure_execution' END AS test_case_name,
  CASE WHEN event_id % 89 <> 0 THEN 'usp_' || CAST(user_id AS STRING) END AS procedure_name,
  CASE WHEN event_id % 97 <> 0 THEN ts END AS test_timestamp,
  CASE WHEN event_id % 79 = 0 THEN NULL WHEN event_type IN ('error', 'click') THEN '❌ Failed' ELSE '✅ Success' END AS status,
  CASE WHEN event_type IN ('error', 'click') THEN 'compile error ' || props ELSE '-' END AS errors
FROM events""", ()),
    # D3 scenario: the log holds the outcomes of two event types, those of the others arrive,
    # so that a later batch also brings lower event ids.
    "test_log_old": ("""
SELECT l.* FROM test_log l JOIN events e ON e.event_id = l.event_id WHERE event_type IN ('view', 'error')""", ("test_log",)),
    "test_log_new": ("""
SELECT l.* FROM test_log l JOIN events e ON e.event_id = l.event_id WHERE event_type NOT IN ('view', 'error')""", ("test_log",)),
    # object store listing.
    "objects": ("""
SELECT page_id, url AS path, html AS content FROM pages""", ()),
    # application log lines; every third turn is a raw continuation line.
    "log_lines": ("""
SELECT conv_id * 1000 + turn AS line_no,
  CASE WHEN turn % 3 = 2 THEN text ELSE '2026-01-0' || CAST(turn % 9 + 1 AS STRING) || ' 10:20:30,123 - '
    || CASE role WHEN 'user' THEN 'INFO' ELSE 'ERROR' END || ' - ' || text END AS line
FROM conversations""", ()),
    # assessment reports, some metrics missing or malformed.
    "reports": ("""
SELECT p_partkey, '- Files: ' || CAST(p_size AS STRING) || chr(10)
  || CASE WHEN p_partkey % 4 = 0 THEN '' ELSE '- Files Not Generated: ' || CAST(p_partkey % 7 AS STRING) || chr(10) END
  || '- Total lines of code: ' || CAST(p_partkey * 10 AS STRING) || chr(10)
  || CASE WHEN p_partkey % 5 = 0 THEN '- Automatically converted: n/a' ELSE '- Automatically converted: ' || CAST(p_size AS STRING) || '.5%' END || chr(10)
  || '- Conversion time: 00:0' || CAST(p_size % 10 AS STRING) || ':01.5' || chr(10)
  || '- Conversion speed: ' || CAST(p_partkey % 900 AS STRING) || ' lines/s' AS text
FROM part""", ()),
    # F8: licence listings; some dates have month 13 or 14.
    "licences": ("""
SELECT o_orderkey, 'Code A' || chr(10) || 'Expiration date: ' || CAST(o_orderkey % 14 + 1 AS STRING) || '/' || CAST(o_custkey % 28 + 1 AS STRING)
  || '/' || CAST(2020 + o_orderkey % 6 AS STRING) || ' 3:04:05' || chr(10) || 'Expiration date: 1/15/' || CAST(2021 + o_custkey % 3 AS STRING) || ' 23:00:00' AS text
FROM orders""", ()),
    # Flag proposals from the selection screen: names ending in an odd digit are ticked.
    "flag_proposals": ("""
SELECT dbname, schema_name, procedure_name, right(procedure_name, 1) IN ('1', '3', '5', '7', '9') AS new_flag
FROM tracking""", ("tracking",)),
    # Edited scripts saved from the editor (scripts of one source).
    "script_edits": ("""
SELECT doc_id AS seq, file_name, '-- edited' || chr(10) || text AS text FROM scripts WHERE source = 'src3'""",
                     ("scripts",)),
    # Raw outcomes of test runs: the error text, NULL when the run raised nothing.
    "raw_outcomes": ("""
SELECT event_id,
  CASE WHEN event_type IN ('view', 'click') THEN 'test_create_procedure' ELSE 'test_procedure_execution' END AS test_case_name,
  'usp_' || CAST(user_id AS STRING) AS procedure_name,
  CASE WHEN event_type IN ('error', 'click') THEN 'compile error ' || props END AS error
FROM events""", ()),
    # Uploaded script files arriving after the catalogue batch (seq continues after it).
    "upload_files": ("""
SELECT doc_id + 1000000000000 AS seq, file_name AS path, text FROM scripts""", ("scripts",)),
    # Processed scripts on disk for publishing; the German ones are drafts under another name.
    "scripts_partial": ("""
SELECT s.doc_id, CASE WHEN d.lang = 'de' THEN 'draft_' ELSE '' END || s.file_name AS file_name, s.source, s.text
FROM scripts s JOIN documents d ON d.doc_id = s.doc_id""", ("scripts",)),
    # Flagged procedures of which two each become one file name.
    "colliding": ("""
SELECT 'a' || chr(46 + CAST(doc_id % 2 AS INT)) || CAST(doc_id - doc_id % 2 AS STRING) AS procedure_name,
  text AS procedure_definition, TRUE AS conversion_flag
FROM scripts""", ("scripts",)),
    # A folder of uploads: scripts and files of other types.
    "upload_folder": ("""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN replace(file_name, '.sql', '.txt') ELSE file_name END AS file_name, text FROM scripts""",
                      ("scripts",)),
}

# Fixed scenario parameters shared by the Spark plans and the oracle SQL.
NOW = "2023-06-01 00:00:00"
LOAD_NOW = "2026-01-01 00:00:00"
TARGET_DB = "TGT"
TARGET_SCHEMA = "PUBLIC"
SOURCE_SCHEMA_WORD = "dbo"
TARGET_SCHEMA_WORD = "PUBLIC"
OBJECT_PREFIX = "https://blog"
STORED_PREFIX = "https_blog"
SEARCH_TERM = "Usp_12"
EXTRACTED_DIR = "./extracted_procedures"


def _closure(names) -> list[str]:
    seen: list[str] = []

    def visit(n):
        if n in seen or n not in VIEWS:
            return
        for d in VIEWS[n][1]:
            visit(d)
        seen.append(n)

    for n in names:
        visit(n)
    return seen


def with_clause(*names: str) -> str:
    """``WITH`` clause holding the named views and what they read, in order."""
    parts = [f"{n} AS ({VIEWS[n][0].strip()})" for n in _closure(names)]
    return "WITH " + ",\n".join(parts) + "\n" if parts else ""


# (session, application) -> (data folder, names registered from it)
_REGISTERED: dict[tuple[int, str], tuple[str, set[str]]] = {}


def _base_tables(view: str) -> list[str]:
    sql = VIEWS[view][0]
    return [t for t in BASE_TABLES if re.search(rf"\b{t}\b", sql)]


def register(spark: SparkSession, sf_dir: str, names=None) -> None:
    """Register the named fixture views (default all), their inputs and driver tables.

    Registration is remembered per session and data folder, so repeated plans
    do not list files and read parquet footers again.
    """
    sf_dir = sf_dir.rstrip("/")
    try:
        key = (id(spark), spark.sparkContext.applicationId)
    except Exception:  # noqa: BLE001 - Spark Connect: no local context
        key = (id(spark), "")
    folder, done = _REGISTERED.get(key, (None, set()))
    if folder != sf_dir:
        done = set()
        _REGISTERED[key] = (sf_dir, done)
    views = _closure(names or list(VIEWS))
    for t in sorted({t for v in views for t in _base_tables(v)} - done):
        spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(t)
        done.add(t)
    for n in views:
        if n not in done:
            spark.sql(VIEWS[n][0]).createOrReplaceTempView(n)
            done.add(n)


def load(spark: SparkSession, sf_dir: str, *names: str):
    """Register and return the named views as DataFrames (one, or a tuple)."""
    register(spark, sf_dir, names)
    frames = tuple(spark.table(n) for n in names)
    return frames[0] if len(frames) == 1 else frames
