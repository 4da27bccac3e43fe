"""Registered queries: one Spark plan and one DuckDB oracle per operator.

Each entry runs over the whole fixture views (derived from the driver tables)
and returns a DataFrame with explicitly named columns. The oracle text is
independent SQL over the same views (window functions and unnest where the
Spark side uses partial aggregates or one regex), so a match is evidence.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import fixtures as FX
from ..functions import patterns as P
from ..functions import text as T
from ..operators import catalog as C
from ..operators import reports as R
from ..operators import results as Q
from ..operators import upsert as U
from ..schemas import TRACKING_SCHEMA
from ..session import scratch_dir
from ..sources import files as SF
from ..sources import log_end as LE
from ..sources import name_index as NI
from ..sources import sinks as SK


@dataclass
class Query:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    views: tuple[str, ...]
    sql: str | None

    def oracle(self) -> str | None:
        if self.sql is None:
            return None
        return FX.with_clause(*self.views) + self.sql.strip()


REGISTRY: dict[str, Query] = {}


def query(name: str, views: tuple[str, ...], sql: str | None):
    def wrap(fn):
        REGISTRY[name] = Query(name, fn, views, sql)
        return fn
    return wrap


def _load(spark, sf_dir, *names):
    return FX.load(spark, sf_dir, *names)


def _procedures(spark, sf_dir) -> DataFrame:
    return C.routines_from(_load(spark, sf_dir, "routines"))


# Oracle building blocks (DuckDB SQL).
_PARAM_DESC_SQL = """coalesce(mode, 'None') || ' ' || coalesce(name, 'None') || ' ' || coalesce(data_type, 'None')
  || CASE WHEN char_length IS NOT NULL THEN '(' || CAST(char_length AS VARCHAR) || ')' ELSE '' END"""
_PARAM_LIST_SQL = f"""SELECT procedure_name, string_agg(descriptor, ', ' ORDER BY ordinal_position, descriptor) AS parameters
  FROM (SELECT procedure_name, ordinal_position, {_PARAM_DESC_SQL} AS descriptor FROM params)
  GROUP BY procedure_name"""
_PARAM_BLOCK_SQL = ("trim(regexp_replace(regexp_extract(text, "
                    "'(?is)(?:CREATE|ALTER)\\s+(?:PROCEDURE|PROC)\\s+.*?(?:\\((.*?)\\))?\\s*(?:AS|BEGIN)', 1), "
                    "'\\s+', ' ', 'g'))")
_LATEST_SQL = """SELECT procedure_name, test_case_name, test_timestamp, status FROM (
  SELECT *, row_number() OVER (PARTITION BY procedure_name
                               ORDER BY test_timestamp DESC NULLS FIRST, event_id DESC) AS rn
  FROM test_log) WHERE rn = 1"""
_CURRENT_LOG_SQL = """SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY test_case_name, procedure_name ORDER BY event_id DESC) AS rn
  FROM test_log) WHERE rn = 1"""
_EXPORT_SQL = """SELECT procedure_name,
  regexp_replace(procedure_name, '[^\\p{L}\\p{N}_-]', '_', 'g') || '.sql' AS file_name,
  regexp_replace(procedure_definition, '^\\s+|\\s+$', '', 'g') || chr(10) AS body
  FROM tracking WHERE conversion_flag AND procedure_definition IS NOT NULL"""
_QNAME_SQL = "coalesce({p}dbname, 'None') || '.' || coalesce({p}schema_name, 'None') || '.' || coalesce({p}procedure_name, 'None')"
_CHANGED_SQL = f"""SELECT split_part(n.full_name, '.', 1) AS dbname, split_part(n.full_name, '.', 2) AS schema_name,
    substr(n.full_name, length(split_part(n.full_name, '.', 1)) + length(split_part(n.full_name, '.', 2)) + 3) AS procedure_name,
    n.new_flag
  FROM (SELECT {_QNAME_SQL.format(p='')} AS full_name, max(new_flag) AS new_flag FROM flag_proposals GROUP BY 1) n
  JOIN (SELECT {_QNAME_SQL.format(p='')} AS full_name, max(coalesce(conversion_flag, FALSE)) AS cur_flag FROM tracking GROUP BY 1) c
    ON n.full_name = c.full_name
  WHERE n.new_flag <> c.cur_flag"""
_TRACKING_COLS = ("source, dbname, schema_name, procedure_name, procedure_definition, conversion_flag, "
                  "load_timestamp, target_dbname, target_schema_name, parameters, is_deployed, errors")
_UPLOADS_SQL = f"""SELECT seq, 'File Upload' AS source, 'UPLOAD_DB' AS dbname, 'dbo' AS schema_name,
    regexp_replace(path, '^(.*[^.].*)\\.[^.]*$', '\\1') AS procedure_name, text AS procedure_definition,
    {_PARAM_BLOCK_SQL} AS parameters FROM upload_files"""
_STAGE_SQL = f"""SELECT seq, source, dbname, schema_name, procedure_name, procedure_definition, parameters FROM (
  SELECT b.*, row_number() OVER (PARTITION BY source, dbname, schema_name, procedure_name ORDER BY seq) AS rn
  FROM (SELECT seq, source, dbname, schema_name, procedure_name, procedure_definition, parameters FROM batch
        UNION ALL {_UPLOADS_SQL}) b
  WHERE NOT EXISTS (
    SELECT 1 FROM routines e WHERE e.routine_type = 'PROCEDURE'
      AND 'SQLServer' IS NOT DISTINCT FROM b.source AND e.dbname IS NOT DISTINCT FROM b.dbname
      AND e.schema_name IS NOT DISTINCT FROM b.schema_name AND e.procedure_name IS NOT DISTINCT FROM b.procedure_name))
  WHERE rn = 1"""
_PUBLISH_FOUND_SQL = """SELECT n.procedure_name, n.source_file, 'deployed_' || n.procedure_name || '.sql' AS target_file, s.text
  FROM (SELECT DISTINCT procedure_name, 'processed_' || procedure_name || '.sql' AS source_file FROM test_log
        WHERE status = '✅ Success' AND test_case_name = 'test_procedure_execution') n
  JOIN {scripts} s ON s.file_name = n.source_file"""
_PUBLISH_MISSING_SQL = """SELECT n.procedure_name, n.source_file
  FROM (SELECT DISTINCT procedure_name, 'processed_' || procedure_name || '.sql' AS source_file FROM test_log
        WHERE status = '✅ Success' AND test_case_name = 'test_procedure_execution') n
  WHERE NOT EXISTS (SELECT 1 FROM {scripts} s WHERE s.file_name = n.source_file)"""
_RESULT_UPSERT_SQL = """SELECT event_id, test_case_id, test_case_name, procedure_name,
    date_trunc('millisecond', test_timestamp) AS test_timestamp, status, errors
  FROM (SELECT *, row_number() OVER (PARTITION BY test_case_name, procedure_name ORDER BY event_id DESC) AS rn
        FROM test_log WHERE test_case_name IS NOT NULL AND procedure_name IS NOT NULL) WHERE rn = 1
  UNION ALL
  SELECT event_id, test_case_id, test_case_name, procedure_name,
    date_trunc('millisecond', test_timestamp) AS test_timestamp, status, errors
  FROM test_log WHERE test_case_name IS NULL OR procedure_name IS NULL"""


# --- 2.1 scans ------------------------------------------------------------------

@query("routine_scan", ("routines",), """
SELECT dbname, schema_name, procedure_name, procedure_definition FROM routines WHERE routine_type = 'PROCEDURE'""")
def routine_scan(spark, sf_dir):
    return _procedures(spark, sf_dir)


@query("param_scan", ("params",), """
SELECT procedure_name, mode, name, data_type, char_length, ordinal_position FROM params""")
def param_scan(spark, sf_dir):
    return C.params_from(_load(spark, sf_dir, "params"))


@query("upload_scan", ("upload_folder",), f"""
SELECT 'File Upload' AS source, 'UPLOAD_DB' AS dbname, 'dbo' AS schema_name,
  regexp_replace(file_name, '^(.*[^.].*)\\.[^.]*$', '\\1') AS procedure_name,
  text AS procedure_definition, {_PARAM_BLOCK_SQL} AS parameters
FROM upload_folder WHERE file_name LIKE '%.sql'""")
def upload_scan(spark, sf_dir):
    s = _load(spark, sf_dir, "upload_folder")
    files = s.select(F.col("file_name").alias("path"), F.col("text").cast("binary").alias("content"))
    return SF.parse_uploads(files, "UPLOAD_DB", "dbo")


@query("upload_rejects", ("upload_folder",), """
SELECT file_name FROM upload_folder WHERE file_name LIKE '%.sql' AND doc_id % 5 = 2""")
def upload_rejects(spark, sf_dir):
    """A3: some uploads, scripts and others, are cut inside a character."""
    s = _load(spark, sf_dir, "upload_folder")
    cut = F.when(F.col("doc_id") % 5 == 2, F.concat(F.col("text").cast("binary"), F.unhex(F.lit("E282")))).otherwise(F.col("text").cast("binary"))
    return SF.upload_rejects(s.select(F.col("file_name").alias("path"), cut.alias("content")))


@query("objects_by_prefix", ("objects",), f"""
SELECT key, key AS name FROM (SELECT DISTINCT regexp_replace(path, '[^A-Za-z0-9]+', '_', 'g') AS key FROM objects)
WHERE starts_with(key, '{FX.STORED_PREFIX}')""")
def objects_by_prefix(spark, sf_dir):
    """A7 on stored objects: the pages as files, listed by a prefix of their keys."""
    from . import flows
    root = scratch_dir(spark, "objects")
    key = F.regexp_replace("path", "[^A-Za-z0-9]+", "_")
    SK.write_files(_load(spark, sf_dir, "objects").select(key.alias("file_name"), F.col("content").alias("text")).dropDuplicates(["file_name"]), root)
    return flows.converted_cache(spark, root, FX.STORED_PREFIX)["objects"].select("key", "name")


@query("script_scan", ("scripts",), """
SELECT file_name, regexp_replace(regexp_replace(raw, '^\\x{FEFF}', ''), '\\r\\n?', chr(10), 'g') AS text
FROM (SELECT file_name, CASE WHEN doc_id % 2 = 0 THEN chr(65279) || replace(text, chr(10), chr(13) || chr(10))
                             ELSE replace(text, chr(10), chr(13)) END AS raw FROM scripts)""")
def script_scan(spark, sf_dir):
    s = _load(spark, sf_dir, "scripts")
    raw = s.select("file_name", F.when(F.col("doc_id") % 2 == 0,
                                       F.concat(F.lit("\ufeff"), F.replace("text", F.lit("\n"), F.lit("\r\n"))))
                   .otherwise(F.replace("text", F.lit("\n"), F.lit("\r"))).alias("text"))
    return SF.normalise_script_text(raw)


@query("tracking_view", ("tracking",), f"""
SELECT {_TRACKING_COLS} FROM tracking ORDER BY dbname NULLS LAST, schema_name NULLS LAST, procedure_name NULLS LAST""")
def tracking_view(spark, sf_dir):
    return C.tracking_view(_load(spark, sf_dir, "tracking"))


@query("test_log_view", ("test_log",), """
SELECT * FROM test_log ORDER BY test_timestamp DESC NULLS FIRST""")
def test_log_view(spark, sf_dir):
    return C.log_view(_load(spark, sf_dir, "test_log"))


@query("object_listing", ("objects",), f"""
SELECT page_id, path, regexp_extract(path, '[^/]*$') AS name FROM objects WHERE starts_with(path, '{FX.OBJECT_PREFIX}')""")
def object_listing(spark, sf_dir):
    return R.list_objects(_load(spark, sf_dir, "objects"), FX.OBJECT_PREFIX)


_LOG_RE = "(?s)^(\\d{4}-\\d{2}-\\d{2} \\d{2}:\\d{2}:\\d{2},\\d{3}) - ([A-Z]+) - (.*)$"


@query("log_parse", ("log_lines",), f"""
SELECT line_no,
  CASE WHEN regexp_matches(line, '{_LOG_RE}') THEN try_strptime(regexp_extract(line, '{_LOG_RE}', 1), '%Y-%m-%d %H:%M:%S,%g') END AS log_time,
  CASE WHEN regexp_matches(line, '{_LOG_RE}') THEN regexp_extract(line, '{_LOG_RE}', 2) END AS level,
  CASE WHEN regexp_matches(line, '{_LOG_RE}') THEN regexp_extract(line, '{_LOG_RE}', 3) ELSE line END AS message
FROM log_lines""")
def log_parse(spark, sf_dir):
    return R.parse_log(_load(spark, sf_dir, "log_lines"))


# --- 2.2 sinks (rows a sink writes) ----------------------------------------------

@query("export_rows", ("tracking",), _EXPORT_SQL)
def export_rows(spark, sf_dir):
    return C.export_rows(_load(spark, sf_dir, "tracking"))


def _read_back(spark, frame: DataFrame, folder: str) -> DataFrame:
    """What a sink has left in a folder, as a table; the folder goes, its files by the tasks that read their names."""
    out = f"{scratch_dir(spark, 'read-back')}"
    frame.write.parquet(out)
    found = spark.read.schema(frame.schema).parquet(out)
    SK.remove_files(found, folder)
    SK.delete(spark, folder)
    return found


_EXPORT_LAST_SQL = f"""SELECT file_name, body FROM (
    SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY procedure_name DESC) AS rn
    FROM ({_EXPORT_SQL.replace("FROM tracking", "FROM {rows}")})) WHERE rn = 1"""


@query("export_files", ("colliding",), f"""
SELECT p || file_name AS file_name, body AS text
FROM ({_EXPORT_LAST_SQL.replace("{rows}", "colliding")}), (VALUES ('old_'), ('')) AS t(p)""")
def export_files(spark, sf_dir):
    """Two exports into one folder: the second leaves the first one's files alone."""
    rows, folder = C.export_rows(_load(spark, sf_dir, "colliding")), scratch_dir(spark, "export")
    for prefix in ("old_", ""):
        SK.export_scripts(rows.withColumn("file_name", F.concat(F.lit(prefix), "file_name")), folder)
    return _read_back(spark, SK.read_files(spark, folder), folder)


@query("export_collisions", ("colliding",), f"""
SELECT file_name, count(*) AS n_rows FROM ({_EXPORT_SQL.replace("FROM tracking", "FROM colliding")})
GROUP BY 1 HAVING count(*) > 1""")
def export_collisions(spark, sf_dir):
    return C.export_collisions(C.export_rows(_load(spark, sf_dir, "colliding")))


@query("script_files", ("scripts",), """
SELECT 'processed_' || file_name AS file_name, text FROM scripts""")
def script_files(spark, sf_dir):
    """B3, then A4 over the files, which hold byte order marks and other line breaks."""
    s = _load(spark, sf_dir, "scripts")
    raw = s.select("file_name", F.when(F.col("doc_id") % 2 == 0,
                                       F.concat(F.lit("\ufeff"), F.replace("text", F.lit("\n"), F.lit("\r\n"))))
                   .otherwise(F.replace("text", F.lit("\n"), F.lit("\r"))).alias("text"))
    folder = scratch_dir(spark, "scripts")
    SK.write_processed(raw, folder)
    return _read_back(spark, SF.normalise_script_text(SK.read_files(spark, folder)), folder)


@query("published_files", ("test_log", "scripts"), f"""
SELECT target_file AS file_name, text FROM ({_PUBLISH_FOUND_SQL.format(scripts="scripts")})""")
def published_files(spark, sf_dir):
    """A second publication wipes the first."""
    log, s = _load(spark, sf_dir, "test_log", "scripts")
    found, folder = Q.publish_found(log, s), scratch_dir(spark, "published")
    SK.publish(found.withColumn("target_file", F.concat(F.lit("old_"), "target_file")), folder)
    SK.publish(found, folder)
    return _read_back(spark, SK.read_files(spark, folder), folder)


@query("tracking_table", ("batch",), f"""
SELECT first.source, first.dbname, schema_name, procedure_name, last.procedure_definition, FALSE AS conversion_flag,
  TIMESTAMP '{FX.LOAD_NOW}' AS load_timestamp, '{FX.TARGET_DB}' AS target_dbname, '{FX.TARGET_SCHEMA}' AS target_schema_name,
  last.parameters, FALSE AS is_deployed, '' AS errors
FROM (SELECT schema_name, procedure_name, arg_max(b, seq) AS last, arg_min(b, seq) AS first FROM batch b
      GROUP BY schema_name, procedure_name,
        CASE WHEN schema_name IS NULL OR procedure_name IS NULL THEN seq END)""")
def tracking_table(spark, sf_dir):
    """A first load: the table is made, filled, written as a version and read again."""
    base = scratch_dir(spark, "tracking")
    empty = SK.ensure_table(spark, f"{base}/empty", TRACKING_SCHEMA)
    rows = U.upsert_tracking(empty, _load(spark, sf_dir, "batch"), now=FX.LOAD_NOW,
                             target_dbname=FX.TARGET_DB, target_schema_name=FX.TARGET_SCHEMA)
    SK.write_snapshot(rows, f"{base}/versions", 0)
    return SK.read_snapshot(spark, f"{base}/versions", TRACKING_SCHEMA)


@query("cached_objects", ("objects",), f"""
SELECT page_id, path, regexp_extract(path, '[^/]*$') AS name, n AS copied
FROM objects, (SELECT count(*) AS n FROM objects WHERE starts_with(path, '{FX.OBJECT_PREFIX}'))
WHERE starts_with(path, '{FX.OBJECT_PREFIX}')""")
def cached_objects(spark, sf_dir):
    """The first call stores the listing of a job, the second finds it."""
    objects, root = _load(spark, sf_dir, "objects"), scratch_dir(spark, "cache")
    first, again = (SK.cached_job(spark, root, "user/1", "job 1", lambda: R.list_objects(objects, FX.OBJECT_PREFIX))
                    for _ in range(2))
    if first["hit"] or not again["hit"]:
        raise AssertionError("a job is stored once and found afterwards")
    return again["rows"].withColumn("copied", F.lit(first["copied"]).cast("bigint"))


@query("apply_edits", ("scripts", "script_edits"), """
SELECT s.doc_id, s.file_name, CASE WHEN e.file_name IS NOT NULL THEN e.text ELSE s.text END AS text
FROM scripts s LEFT JOIN (
  SELECT file_name, text FROM (
    SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY seq DESC) AS rn FROM script_edits) WHERE rn = 1) e
  ON s.file_name = e.file_name""")
def apply_edits(spark, sf_dir):
    s, e = _load(spark, sf_dir, "scripts", "script_edits")
    return SK.apply_edits(s.select("doc_id", "file_name", "text"), e, key="file_name")


# --- 2.3 filters ---------------------------------------------------------------------

@query("flagged_filter", ("tracking",), """
SELECT procedure_name, procedure_definition FROM tracking WHERE conversion_flag""")
def flagged_filter(spark, sf_dir):
    return C.flagged(_load(spark, sf_dir, "tracking"))


@query("name_search", ("tracking",), f"""
SELECT dbname, schema_name, procedure_name FROM tracking
WHERE contains(lower(procedure_name), '{FX.SEARCH_TERM.lower()}') ORDER BY procedure_name""")
def name_search(spark, sf_dir):
    t = _load(spark, sf_dir, "tracking").select("dbname", "schema_name", "procedure_name")
    return C.search(t, FX.SEARCH_TERM)


@query("name_search_index", ("tracking",), f"""
SELECT dbname, schema_name, procedure_name FROM tracking
WHERE contains(lower(procedure_name), '{FX.SEARCH_TERM.lower()}') ORDER BY procedure_name""")
def name_search_index(spark, sf_dir):
    path = scratch_dir(spark, "name-index")
    NI.write_index(_load(spark, sf_dir, "tracking").select("dbname", "schema_name", "procedure_name"), path, folders=16)
    return NI.search_index(spark, path, FX.SEARCH_TERM)


FACET_PICK = {
    "procedure_name": ["usp_1", "usp_2", "usp_3", "usp_5", "usp_8", "usp_13", "usp_21", "usp_34"],
    "status": [P.STATUS_FAILED],
    "test_case_id": [],
    "test_case_name": [],
}


@query("facet_filter", ("test_log",), """
SELECT * FROM test_log
WHERE procedure_name IN ('usp_1', 'usp_2', 'usp_3', 'usp_5', 'usp_8', 'usp_13', 'usp_21', 'usp_34')
  AND status IN ('❌ Failed')""")
def facet_filter(spark, sf_dir):
    return Q.facet_filter(_load(spark, sf_dir, "test_log"), FACET_PICK)


@query("outcome_rows", ("raw_outcomes",), """
SELECT event_id, test_case_name, procedure_name,
  CASE WHEN error IS NULL THEN '✅ Success' ELSE '❌ Failed' END AS status, coalesce(error, '-') AS errors
FROM raw_outcomes""")
def outcome_rows(spark, sf_dir):
    raw = _load(spark, sf_dir, "raw_outcomes")
    return raw.select("event_id", "test_case_name", "procedure_name",
                      T.outcome_status("error").alias("status"), T.outcome_reason("error").alias("errors"))


@query("passed_filter", ("test_log",), """
SELECT * FROM test_log WHERE status = '✅ Success' AND test_case_name = 'test_procedure_execution'""")
def passed_filter(spark, sf_dir):
    return Q.passed(_load(spark, sf_dir, "test_log"))


@query("changed_flags", ("tracking", "flag_proposals"), _CHANGED_SQL)
def changed_flags(spark, sf_dir):
    t, p = _load(spark, sf_dir, "tracking", "flag_proposals")
    return C.changed_flags(t, p)


# --- 2.4 joins and keyed writes ---------------------------------------------------------

@query("attach_params", ("routines", "params"), f"""
SELECT 'SQLServer' AS source, r.dbname, r.schema_name, r.procedure_name, r.procedure_definition,
  coalesce(pl.parameters, '') AS parameters
FROM routines r LEFT JOIN ({_PARAM_LIST_SQL}) pl ON r.procedure_name = pl.procedure_name
WHERE r.routine_type = 'PROCEDURE'""")
def attach_params(spark, sf_dir):
    return C.attach_params(_procedures(spark, sf_dir), _load(spark, sf_dir, "params"))


@query("metadata_upsert", ("tracking", "batch"), f"""
SELECT t.source, t.dbname, t.schema_name, t.procedure_name,
  CASE WHEN l.seq IS NULL THEN t.procedure_definition ELSE l.procedure_definition END AS procedure_definition,
  t.conversion_flag,
  CASE WHEN l.seq IS NULL THEN t.load_timestamp ELSE TIMESTAMP '{FX.LOAD_NOW}' END AS load_timestamp,
  t.target_dbname, t.target_schema_name,
  CASE WHEN l.seq IS NULL THEN t.parameters ELSE l.parameters END AS parameters,
  t.is_deployed, t.errors
FROM tracking t LEFT JOIN (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY schema_name, procedure_name ORDER BY seq DESC) AS rn
                 FROM batch WHERE schema_name IS NOT NULL AND procedure_name IS NOT NULL) WHERE rn = 1) l
  ON t.schema_name = l.schema_name AND t.procedure_name = l.procedure_name
UNION ALL
SELECT f.source, f.dbname, l.schema_name, l.procedure_name, l.procedure_definition, FALSE,
  TIMESTAMP '{FX.LOAD_NOW}', '{FX.TARGET_DB}', '{FX.TARGET_SCHEMA}', l.parameters, FALSE, ''
FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY schema_name, procedure_name ORDER BY seq DESC) AS rn
                     FROM batch WHERE schema_name IS NOT NULL AND procedure_name IS NOT NULL) WHERE rn = 1) l
JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY schema_name, procedure_name ORDER BY seq) AS rn
                     FROM batch WHERE schema_name IS NOT NULL AND procedure_name IS NOT NULL) WHERE rn = 1) f
  ON f.schema_name = l.schema_name AND f.procedure_name = l.procedure_name
WHERE NOT EXISTS (SELECT 1 FROM tracking t WHERE t.schema_name = l.schema_name AND t.procedure_name = l.procedure_name)
UNION ALL
SELECT source, dbname, schema_name, procedure_name, procedure_definition, FALSE,
  TIMESTAMP '{FX.LOAD_NOW}', '{FX.TARGET_DB}', '{FX.TARGET_SCHEMA}', parameters, FALSE, ''
FROM batch WHERE schema_name IS NULL OR procedure_name IS NULL""")
def metadata_upsert(spark, sf_dir):
    t, b = _load(spark, sf_dir, "tracking", "batch")
    return U.upsert_tracking(t, b, now=FX.LOAD_NOW, target_dbname=FX.TARGET_DB,
                             target_schema_name=FX.TARGET_SCHEMA)


@query("upsert_counts", ("tracking", "batch"), """
SELECT CAST(count(*) FILTER (WHERE first_seq = seq AND NOT in_target AND NOT no_key) + count(*) FILTER (WHERE no_key) AS BIGINT) AS rows_inserted,
       CAST(count(*) FILTER (WHERE NOT no_key) - count(*) FILTER (WHERE first_seq = seq AND NOT in_target AND NOT no_key)
            + coalesce(sum(m - 1) FILTER (WHERE NOT no_key AND in_target), 0) AS BIGINT) AS rows_updated
FROM (
  SELECT b.seq, b.schema_name IS NULL OR b.procedure_name IS NULL AS no_key,
    min(b.seq) OVER (PARTITION BY b.schema_name, b.procedure_name) AS first_seq,
    coalesce(tk.m, 0) > 0 AS in_target, coalesce(tk.m, 0) AS m
  FROM batch b LEFT JOIN (SELECT schema_name, procedure_name, count(*) AS m FROM tracking GROUP BY ALL) tk
    ON b.schema_name = tk.schema_name AND b.procedure_name = tk.procedure_name)""")
def upsert_counts(spark, sf_dir):
    t, b = _load(spark, sf_dir, "tracking", "batch")
    return U.upsert_counts(t, b)


@query("result_upsert", ("test_log_old", "test_log_new"), """
SELECT event_id, test_case_id, test_case_name, procedure_name,
    date_trunc('millisecond', test_timestamp) AS test_timestamp, status, errors
  FROM (SELECT *, row_number() OVER (PARTITION BY test_case_name, procedure_name ORDER BY later DESC, event_id DESC) AS rn
        FROM (SELECT *, 0 AS later FROM test_log_old UNION ALL SELECT *, 1 FROM test_log_new) WHERE test_case_name IS NOT NULL AND procedure_name IS NOT NULL) WHERE rn = 1
  UNION ALL
  SELECT event_id, test_case_id, test_case_name, procedure_name,
    date_trunc('millisecond', test_timestamp) AS test_timestamp, status, errors
  FROM (SELECT *, 0 AS later FROM test_log_old UNION ALL SELECT *, 1 FROM test_log_new) WHERE test_case_name IS NULL OR procedure_name IS NULL""")
def result_upsert(spark, sf_dir):
    old, new = _load(spark, sf_dir, "test_log_old", "test_log_new")
    return U.upsert_results(U.upsert_results(None, old), new)


@query("flag_update", ("tracking", "flag_proposals"), f"""
SELECT t.source, t.dbname, t.schema_name, t.procedure_name, t.procedure_definition,
  CASE WHEN ch.procedure_name IS NOT NULL THEN ch.new_flag ELSE t.conversion_flag END AS conversion_flag,
  t.load_timestamp, t.target_dbname, t.target_schema_name, t.parameters, t.is_deployed, t.errors
FROM tracking t LEFT JOIN ({_CHANGED_SQL}) ch
  ON t.dbname = ch.dbname AND t.schema_name = ch.schema_name AND t.procedure_name = ch.procedure_name""")
def flag_update(spark, sf_dir):
    t, p = _load(spark, sf_dir, "tracking", "flag_proposals")
    return C.update_flags(t, C.changed_flags(t, p))


@query("mark_deployed", ("tracking", "test_log"), """
SELECT t.source, t.dbname, t.schema_name, t.procedure_name, t.procedure_definition, t.conversion_flag,
  t.load_timestamp, t.target_dbname, t.target_schema_name, t.parameters,
  CASE WHEN d.procedure_name IS NOT NULL THEN TRUE ELSE t.is_deployed END AS is_deployed, t.errors
FROM tracking t LEFT JOIN (
  SELECT DISTINCT regexp_replace(procedure_name, '\\(.*\\)$', '') AS procedure_name FROM test_log
  WHERE status = '✅ Success' AND test_case_name = 'test_procedure_execution') d
  ON t.procedure_name = d.procedure_name""")
def mark_deployed(spark, sf_dir):
    t, log = _load(spark, sf_dir, "tracking", "test_log")
    return Q.mark_deployed(t, log)


def _store_of(spark, sf_dir, parts: int = 16):
    """The tracking fixture as the first version of a table in parts."""
    from . import flows
    base = scratch_dir(spark, "store")
    store = flows.Store(f"{base}/tracking", f"{base}/log", parts=parts)
    store.write_tracking(_load(spark, sf_dir, "tracking"), None)
    return store


@query("flag_update_parts", ("tracking", "flag_proposals"), REGISTRY["flag_update"].sql)
def flag_update_parts(spark, sf_dir):
    """D4 as a step on a stored table: the parts that hold changed rows are written anew."""
    from . import flows
    store = _store_of(spark, sf_dir)
    flows.save_flags(spark, store, _load(spark, sf_dir, "flag_proposals"))
    return store.read_tracking(spark)


@query("metadata_upsert_parts", ("tracking", "batch"), REGISTRY["metadata_upsert"].sql)
def metadata_upsert_parts(spark, sf_dir):
    """D2 on a stored table in parts: the parts of the batch's names are read, merged and written."""
    from . import flows
    store, batch = _store_of(spark, sf_dir), _load(spark, sf_dir, "batch")
    only = store.touched(batch, flows.TRACKING_PART)
    rows = U.upsert_tracking(store.read_tracking(spark, 0, only), batch, now=FX.LOAD_NOW, target_dbname=FX.TARGET_DB,
                             target_schema_name=FX.TARGET_SCHEMA)
    store.write_tracking(rows, 0, only)
    return store.read_tracking(spark)


@query("record_results_parts", ("tracking", "test_log"), REGISTRY["mark_deployed"].sql)
def record_results_parts(spark, sf_dir):
    """D3 and D5 as a step: outcomes go into a log in parts, deployed names into the parts of the tracking table."""
    from . import flows
    store = _store_of(spark, sf_dir)
    flows.record_results(spark, store, _load(spark, sf_dir, "test_log"))
    return store.read_tracking(spark)


@query("pending_tests", ("routines", "test_log"), f"""
SELECT c.test_case_name, c.procedure_name FROM (
  SELECT unnest(['test_create_procedure', 'test_procedure_execution']) AS test_case_name, procedure_name
  FROM routines WHERE routine_type = 'PROCEDURE') c
WHERE NOT EXISTS (SELECT 1 FROM ({_CURRENT_LOG_SQL}) cur
  WHERE cur.test_case_name = c.test_case_name AND cur.procedure_name = c.procedure_name
    AND cur.status = '✅ Success')""")
def pending_tests(spark, sf_dir):
    log = U.upsert_results(None, _load(spark, sf_dir, "test_log"))
    return Q.pending_tests(Q.test_runs(_procedures(spark, sf_dir)), log)


_UNPREFIXED_SQL = ("CASE WHEN starts_with(left(file_name, greatest(length(file_name) - 4, 0)), 'processed_') "
                   "THEN substr(left(file_name, greatest(length(file_name) - 4, 0)), 11) END")
_LABEL_SQL = ("CASE WHEN starts_with(file_name, 'processed_') THEN substr("
              "CASE WHEN length(file_name) < 50 THEN rpad(file_name, 50, ' ') ELSE file_name END"
              " || ' [' || {status} || ']', 11) END")


@query("script_status", ("scripts", "test_log"), f"""
SELECT s.file_name, s.procedure_name, coalesce(l.status, '❔') AS status,
  {_LABEL_SQL.format(status="coalesce(l.status, '❔')")} AS label
FROM (SELECT file_name, {_UNPREFIXED_SQL} AS procedure_name FROM scripts) s
LEFT JOIN ({_LATEST_SQL}) l ON s.procedure_name = l.procedure_name""")
def script_status(spark, sf_dir):
    s, log = _load(spark, sf_dir, "scripts", "test_log")
    return Q.script_status(s, log)


@query("status_label", ("scripts", "test_log"), f"""
SELECT file_name, label, trim(split_part(label, '  [', 1)) AS file_back FROM (
  SELECT s.file_name, {_LABEL_SQL.format(status="coalesce(l.status, '❔')")} AS label
  FROM (SELECT file_name, {_UNPREFIXED_SQL} AS procedure_name FROM scripts) s
  LEFT JOIN ({_LATEST_SQL}) l ON s.procedure_name = l.procedure_name)""")
def status_label(spark, sf_dir):
    s, log = _load(spark, sf_dir, "scripts", "test_log")
    st = Q.script_status(s, log)
    return st.select("file_name", "label", T.unlabel("label").alias("file_back"))


@query("script_pairs", ("scripts", "tracking"), f"""
SELECT s.file_name,
  CASE WHEN starts_with(s.file_name, 'processed_') THEN substr(s.file_name, 11) END AS original_file,
  CASE WHEN starts_with(s.file_name, 'processed_') THEN coalesce(
    regexp_replace(regexp_replace(e.body, '^\\x{{FEFF}}', ''), '\\r\\n?', chr(10), 'g'),
    '--- FILE NOT FOUND ---' || chr(10) || 'Path: {FX.EXTRACTED_DIR}/' || substr(s.file_name, 11)) END AS original,
  regexp_replace(regexp_replace(s.text, '^\\x{{FEFF}}', ''), '\\r\\n?', chr(10), 'g') AS converted
FROM scripts s LEFT JOIN (
  SELECT file_name, body FROM (
    SELECT *, row_number() OVER (PARTITION BY file_name ORDER BY procedure_name DESC) AS rn FROM ({_EXPORT_SQL}))
  WHERE rn = 1) e ON e.file_name = substr(s.file_name, 11)""")
def script_pairs(spark, sf_dir):
    s, t = _load(spark, sf_dir, "scripts", "tracking")
    return Q.pair_scripts(s, C.export_rows(t), FX.EXTRACTED_DIR)


@query("passed_names", ("test_log",), """
SELECT DISTINCT procedure_name FROM test_log
WHERE status = '✅ Success' AND test_case_name = 'test_procedure_execution'""")
def passed_names(spark, sf_dir):
    return Q.passed_names(_load(spark, sf_dir, "test_log"))


@query("publish_found", ("test_log", "scripts"), _PUBLISH_FOUND_SQL.format(scripts="scripts"))
def publish_found(spark, sf_dir):
    log, s = _load(spark, sf_dir, "test_log", "scripts")
    return Q.publish_found(log, s)


@query("publish_missing", ("test_log", "scripts_partial"),
       _PUBLISH_MISSING_SQL.format(scripts="scripts_partial"))
def publish_missing(spark, sf_dir):
    log, s = _load(spark, sf_dir, "test_log", "scripts_partial")
    return Q.publish_missing(log, s)


def _staged(spark, sf_dir) -> DataFrame:
    existing = _procedures(spark, sf_dir).withColumn("source", F.lit(P.SOURCE_CATALOGUE))
    batch, up = _load(spark, sf_dir, "batch", "upload_files")
    files = up.select("seq", "path", F.col("text").cast("binary").alias("content"))
    uploads = SF.parse_uploads(files, "UPLOAD_DB", "dbo", carry=["seq"])
    return C.stage(existing, C.combine(batch, uploads))


@query("stage_dedup", ("routines", "batch", "upload_files"), _STAGE_SQL)
def stage_dedup(spark, sf_dir):
    return _staged(spark, sf_dir)


@query("call_build", ("routines", "params"), f"""
SELECT procedure_name, CAST(n AS BIGINT) AS n_params,
  procedure_name || '(' || CASE WHEN n = 0 THEN '' ELSE left(repeat('NULL, ', n), n * 6 - 2) END || ')' AS call_text
FROM (
  SELECT r.procedure_name,
    CASE WHEN trim(coalesce(pl.parameters, '')) = '' THEN 0 ELSE len(string_split(pl.parameters, ',')) END AS n
  FROM (SELECT DISTINCT procedure_name FROM routines WHERE routine_type = 'PROCEDURE') r
  LEFT JOIN ({_PARAM_LIST_SQL}) pl ON r.procedure_name = pl.procedure_name)""")
def call_build(spark, sf_dir):
    procs = _procedures(spark, sf_dir)
    meta = C.attach_params(procs, _load(spark, sf_dir, "params"))
    out = Q.lookup_params(procs.select("procedure_name").distinct(), meta)
    return out.withColumn("n_params", F.col("n_params").cast("bigint"))


@query("insert_absent", ("tracking", "batch"), """
SELECT seq, schema_name, procedure_name,
  (schema_name IS NULL OR procedure_name IS NULL) OR (
    NOT EXISTS (SELECT 1 FROM tracking t WHERE t.schema_name = b.schema_name AND t.procedure_name = b.procedure_name)
    AND row_number() OVER (PARTITION BY schema_name, procedure_name ORDER BY seq) = 1) AS accepted
FROM batch b""")
def insert_absent(spark, sf_dir):
    t, b = _load(spark, sf_dir, "tracking", "batch")
    out = U.insert_absent(t, b, keys=("schema_name", "procedure_name"))
    return out.select("seq", "schema_name", "procedure_name", "accepted")


# --- 2.5 aggregations ------------------------------------------------------------------

@query("param_list", ("params",), _PARAM_LIST_SQL)
def param_list(spark, sf_dir):
    return C.param_list(_load(spark, sf_dir, "params"))


@query("schema_groups", ("tracking",), f"""
SELECT split_part(full_name, '.', 1) AS dbname, split_part(full_name, '.', 2) AS schema_name, count(*) AS n_procs
FROM (SELECT DISTINCT {_QNAME_SQL.format(p='')} AS full_name FROM tracking) GROUP BY 1, 2""")
def schema_groups(spark, sf_dir):
    return C.schema_groups(_load(spark, sf_dir, "tracking"))


@query("schema_members", ("tracking",), f"""
SELECT DISTINCT split_part(full_name, '.', 1) AS dbname, split_part(full_name, '.', 2) AS schema_name,
  substr(full_name, length(split_part(full_name, '.', 1)) + length(split_part(full_name, '.', 2)) + 3) AS procedure_name
FROM (SELECT {_QNAME_SQL.format(p='')} AS full_name FROM tracking)""")
def schema_members(spark, sf_dir):
    return C.schema_members(_load(spark, sf_dir, "tracking"))


@query("result_metrics", ("test_log",), """
SELECT count(*) AS total_tests, count(*) FILTER (WHERE status = '✅ Success') AS passed_tests,
  count(*) - count(*) FILTER (WHERE status = '✅ Success') AS failed_tests FROM test_log""")
def result_metrics(spark, sf_dir):
    return Q.result_metrics(_load(spark, sf_dir, "test_log"))


@query("latest_status", ("test_log",), _LATEST_SQL)
def latest_status(spark, sf_dir):
    return Q.latest_status(_load(spark, sf_dir, "test_log"))


@query("facet_values", ("test_log",), """
SELECT 'procedure_name' AS facet, procedure_name AS value FROM test_log
UNION SELECT 'status', status FROM test_log
UNION SELECT 'test_case_id', test_case_id FROM test_log
UNION SELECT 'test_case_name', test_case_name FROM test_log""")
def facet_values(spark, sf_dir):
    return Q.facet_values(_load(spark, sf_dir, "test_log"))


@query("any_under_prefix", ("objects",), f"""
SELECT count(*) > 0 AS any_object FROM objects WHERE starts_with(path, '{FX.OBJECT_PREFIX}')""")
def any_under_prefix(spark, sf_dir):
    return R.any_object(_load(spark, sf_dir, "objects"), FX.OBJECT_PREFIX)


@query("active_expiry", ("licences",), f"""
SELECT o_orderkey, CAST(len(d) AS BIGINT) AS n_dates,
  coalesce(len(list_filter(d, lambda x: x > TIMESTAMP '{FX.NOW}')) > 0, FALSE) AS has_active
FROM (SELECT o_orderkey, list_filter(list_transform(
        regexp_extract_all(text, 'Expiration date:\\s*([0-1]?\\d/[0-3]?\\d/\\d{{4}}\\s+\\d{{1,2}}:\\d{{2}}:\\d{{2}})', 1),
        lambda x: try_strptime(regexp_replace(x, '\\s+', ' ', 'g'), '%m/%d/%Y %H:%M:%S')), lambda x: x IS NOT NULL) AS d
      FROM licences)""")
def active_expiry(spark, sf_dir):
    out = R.active_expiry(_load(spark, sf_dir, "licences"), "o_orderkey", FX.NOW)
    return out.withColumn("n_dates", F.col("n_dates").cast("bigint"))


@query("step_counts", ("routines", "batch", "upload_files", "tracking", "flag_proposals", "test_log",
                      "scripts", "objects"),
       f"""
SELECT 'staged' AS step, count(*) AS n_rows FROM ({_STAGE_SQL})
UNION ALL SELECT 'flags_changed', count(*) FROM ({_CHANGED_SQL})
UNION ALL SELECT 'exported', count(*) FROM ({_EXPORT_SQL})
UNION ALL SELECT 'published', count(*) FROM ({_PUBLISH_FOUND_SQL.format(scripts="scripts")})
UNION ALL SELECT 'objects_listed', count(*) FROM objects WHERE starts_with(path, '{FX.OBJECT_PREFIX}')""")
def step_counts(spark, sf_dir):
    t, p, b, log, s, o = _load(spark, sf_dir, "tracking", "flag_proposals", "batch", "test_log",
                               "scripts", "objects")
    return R.step_counts(staged=_staged(spark, sf_dir), flags_changed=C.changed_flags(t, p),
                         exported=C.export_rows(t), published=Q.publish_found(log, s),
                         objects_listed=R.list_objects(o, FX.OBJECT_PREFIX))


# --- 2.6 / 2.7 windows, sorts, limits ---------------------------------------------------

@query("test_ids", ("scripts",), """
SELECT file_name, test_case_name, CAST(row_number() OVER (ORDER BY file_name, m) AS VARCHAR) AS test_case_id
FROM scripts, (VALUES (0, 'test_create_procedure'), (1, 'test_procedure_execution')) AS t(m, test_case_name)""")
def test_ids(spark, sf_dir):
    s = _load(spark, sf_dir, "scripts")
    methods = F.array(*[F.lit(m) for m in P.TEST_METHODS])
    runs = s.select("file_name", F.posexplode(methods).alias("m", "method"))
    logged = F.when(F.col("m") == 0, F.lit(P.TEST_CREATE)).otherwise(F.lit(P.TEST_EXECUTION))
    ids = Q.assign_ids(runs.select("file_name", "m", logged.alias("test_case_name")), ["file_name", "m"],
                       unique=True)  # a folder holds a file name once
    return ids.select("file_name", "test_case_name", "test_case_id")


@query("log_tail", ("log_lines",), """
SELECT line_no, CASE WHEN line_no = (SELECT max(line_no) FROM log_lines WHERE regexp_matches(line, '[^\\s]'))
                     THEN regexp_replace(line, '\\s+$', '') ELSE line END AS line
FROM (SELECT * FROM log_lines
      WHERE line_no <= (SELECT max(line_no) FROM log_lines WHERE regexp_matches(line, '[^\\s]'))
      ORDER BY line_no DESC LIMIT 25)""")
def log_tail(spark, sf_dir):
    return R.tail(_load(spark, sf_dir, "log_lines"))


_ONE_LINE_SQL = "(SELECT line_no, regexp_replace(line, '[\\r\\n]', ' ', 'g') AS line FROM log_lines)"


@query("log_file_tail", ("log_lines",), f"""
SELECT row_number() OVER (ORDER BY line_no) AS place,
  CASE WHEN line_no = (SELECT max(line_no) FROM {_ONE_LINE_SQL} WHERE regexp_matches(line, '[^\\s]'))
       THEN regexp_replace(line, '\\s+$', '') ELSE line END AS line
FROM (SELECT * FROM {_ONE_LINE_SQL}
      WHERE line_no <= (SELECT max(line_no) FROM {_ONE_LINE_SQL} WHERE regexp_matches(line, '[^\\s]'))
      ORDER BY line_no DESC LIMIT 25)""")
def log_file_tail(spark, sf_dir):
    """G3 on the log as files: only the last bytes of the last files are read."""
    folder = scratch_dir(spark, "log")
    lines = _load(spark, sf_dir, "log_lines").orderBy("line_no")
    lines.select(F.regexp_replace("line", "[\\r\\n]", " ").alias("value")).write.text(folder)
    found = LE.tail_file(spark, folder)
    return found.select(F.row_number().over(Window.orderBy("pos")).cast("bigint").alias("place"), "line")


# --- 2.9 scalar functions over the corpus ------------------------------------------------

@query("strip_comments", ("scripts",), """
SELECT doc_id, regexp_replace(regexp_replace(text, '--[^\\n]*', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g') AS text FROM scripts""")
def strip_comments(spark, sf_dir):
    s = _load(spark, sf_dir, "scripts")
    return s.select("doc_id", T.strip_comments("text").alias("text"))


@query("rename_schema", ("scripts",), f"""
SELECT doc_id, regexp_replace(text, '\\b{FX.SOURCE_SCHEMA_WORD}\\b', '{FX.TARGET_SCHEMA_WORD}', 'gi') AS text FROM scripts""")
def rename_schema(spark, sf_dir):
    s = _load(spark, sf_dir, "scripts")
    return s.select("doc_id", T.rename_schema("text", FX.SOURCE_SCHEMA_WORD, FX.TARGET_SCHEMA_WORD)
                    .alias("text"))


def _drop_marked_sql(src: str) -> str:
    # Brute force: split into lines, carry the marker state of the previous
    # non-blank line with a window, keep the rest, re-join.
    blank = "^[\\t\\x1f \\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{202f}\\x{205f}\\x{3000}]*$"
    return f"""
SELECT d.doc_id, coalesce(k.text, '') AS text FROM ({src}) d LEFT JOIN (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped) AS text FROM (
    SELECT doc_id, pos, line,
      has_marker OR (NOT blank AND coalesce(last_value(CASE WHEN NOT blank THEN has_marker END IGNORE NULLS)
        OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE)) AS dropped
    FROM (SELECT doc_id, pos, line, contains(line, '{P.MARKER}') AS has_marker,
                 regexp_matches(line, '{blank}') AS blank
          FROM (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos
                FROM (SELECT doc_id, string_split(regexp_replace(
                        regexp_replace(t, '\\r\\n|[\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]', chr(10), 'g'),
                        '\\n$', ''), chr(10)) AS ls FROM ({src}) s0) s1) s2) s3) s4
  GROUP BY doc_id) k ON d.doc_id = k.doc_id"""


@query("drop_marked", ("scripts",), _drop_marked_sql("SELECT doc_id, text AS t FROM scripts"))
def drop_marked(spark, sf_dir):
    s = _load(spark, sf_dir, "scripts")
    return s.select("doc_id", T.drop_marked("text").alias("text"))


_CLEAN_STEPS_SQL = (f"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '--[^\\n]*', '', 'g'), "
                    f"'(?s)/\\*.*?\\*/', '', 'g'), '\\b{FX.SOURCE_SCHEMA_WORD}\\b', '{FX.TARGET_SCHEMA_WORD}', 'gi'), "
                    f"'\\$\\$', '', 'g')")


@query("clean_script", ("scripts",), _drop_marked_sql(f"SELECT doc_id, {_CLEAN_STEPS_SQL} AS t FROM scripts"))
def clean_script(spark, sf_dir):
    s = _load(spark, sf_dir, "scripts")
    return s.select("doc_id", T.clean_script("text", FX.SOURCE_SCHEMA_WORD, FX.TARGET_SCHEMA_WORD)
                    .alias("text"))


@query("param_block", ("scripts",), f"""
SELECT doc_id, {_PARAM_BLOCK_SQL} AS parameters FROM scripts""")
def param_block(spark, sf_dir):
    s = _load(spark, sf_dir, "scripts")
    return s.select("doc_id", T.param_block("text").alias("parameters"))


@query("safe_name", ("objects",), """
SELECT page_id, path, regexp_replace(path, '[^\\p{L}\\p{N}_-]', '_', 'g') AS safe_name FROM objects""")
def safe_name(spark, sf_dir):
    o = _load(spark, sf_dir, "objects")
    return o.select("page_id", "path", T.safe_name("path").alias("safe_name"))


@query("proc_from_file", ("scripts", "objects"), """
SELECT name, coalesce(nullif(regexp_extract(name, '^.*_([^.]+)\\.sql$', 1), ''),
                      nullif(regexp_extract(name, '^([^.]+)\\.sql$', 1), '')) AS procedure_name
FROM (SELECT file_name AS name FROM scripts
      UNION ALL SELECT regexp_extract(path, '[^/]*$') || '.sql' FROM objects)""")
def proc_from_file(spark, sf_dir):
    s, o = _load(spark, sf_dir, "scripts", "objects")
    names = s.select(F.col("file_name").alias("name")).unionByName(
        o.select(F.concat(T.base_name("path"), F.lit(".sql")).alias("name")))
    return names.select("name", T.proc_from_file("name").alias("procedure_name"))


@query("numbered_lines", ("scripts",), """
SELECT doc_id, CAST(generate_subscripts(ls, 1) AS BIGINT) AS line_no, unnest(ls) AS line
FROM (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM scripts)""")
def numbered_lines(spark, sf_dir):
    s = _load(spark, sf_dir, "scripts")
    out = Q.numbered_lines(s, "doc_id")
    return out.withColumn("line_no", F.col("line_no").cast("bigint"))


@query("report_metrics", ("reports",), """
SELECT p_partkey,
  coalesce(nullif(regexp_extract(text, '- Files:\\s+(\\d+)', 1), ''), 'N/A') AS files,
  coalesce(nullif(regexp_extract(text, '- Files Not Generated:\\s+(\\d+)', 1), ''), 'N/A') AS not_generated,
  coalesce(nullif(regexp_extract(text, '- Total lines of code:\\s+(\\d+)', 1), ''), 'N/A') AS total_loc,
  coalesce(nullif(regexp_extract(text, '- Automatically converted:\\s+([\\d\\.]+%)', 1), ''), 'N/A') AS auto_conv_pct,
  coalesce(nullif(regexp_extract(text, '- Conversion time:\\s+([\\d:\\.]+)', 1), ''), 'N/A') AS conv_time,
  coalesce(nullif(regexp_extract(text, '- Conversion speed:\\s+(\\d+)\\s+lines', 1), ''), 'N/A') AS speed_loc_s
FROM reports""")
def report_metrics(spark, sf_dir):
    return R.report_table(_load(spark, sf_dir, "reports"), "p_partkey")


# --- 2.10 streaming -------------------------------------------------------------------------

@query("result_stream", ("test_log",), _RESULT_UPSERT_SQL)
def result_stream(spark, sf_dir):
    from ..streaming.result_log import replay_log_stream
    return replay_log_stream(spark, *_load(spark, sf_dir, "test_log_old", "test_log_new"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: q.build for name, q in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: q.oracle() for name, q in REGISTRY.items() if q.sql is not None}
