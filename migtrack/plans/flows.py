"""End-to-end workflow steps, each one Spark plan ending in a sink.

1. ``load_catalogue``  routines + parameters (+ uploads) -> stage -> upsert -> new tracking version
2. ``save_flags``      proposed flags -> changed rows -> keyed update -> new tracking version
3. ``extract``         flagged rows -> one script file each
4. ``process``         converted scripts -> cleanup -> processed scripts
5. ``record_results``  new test outcomes -> log upsert -> deployed flags -> new versions
6. ``publish_passed``  passed execution tests x processed scripts -> published files

Every step writes a fresh version of the table it changes (``sources.sinks``),
never the path it reads, so a failed or repeated step leaves the previous
version intact and lineage is cut at every step.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from ..operators import catalog as C
from ..operators import reports as R
from ..operators import results as Q
from ..operators import upsert as U
from ..schemas import TEST_LOG_COLUMNS, TEST_LOG_SCHEMA, TRACKING_SCHEMA
from ..session import checkpoint_dir
from ..sources import files, log_end, name_index
from ..sources import sinks as SK

# What decides the part of a row: its name and, for rows without one, columns that no step changes.
TRACKING_PART = ("procedure_name", "dbname", "schema_name", "procedure_definition")
LOG_PART = ("procedure_name", "event_id", "test_case_id", "test_case_name")


@dataclass
class Store:
    """Where the two tracked tables keep their versions.

    ``buckets``: write every version bucketed by its upsert key (tracking on
    (schema, name), log on (test, procedure)), so an upsert into a large table
    shuffles only the incoming batch. None writes plain parquet.

    ``parts``: keep both tables in that many parts by the hash of the procedure name; a step
    then reads and writes only the parts that hold the names it changes, at any size of
    the table. Not together with ``buckets``.

    A step reads a version and writes the next one. If another step has written
    that meanwhile, the write fails (``sinks.VersionTaken``) and the step is to be
    run again on what is there now; nothing is overwritten.
    """
    tracking: str
    test_log: str
    buckets: int | None = None
    parts: int | None = None

    def _tracking_buckets(self):
        return dict(bucket_by=U.TRACKING_KEYS, buckets=self.buckets) if self.buckets else {}

    def _log_buckets(self):
        return dict(bucket_by=U.RESULT_KEYS, buckets=self.buckets) if self.buckets else {}

    def tracking_version(self, spark: SparkSession) -> int | None:
        return SK.latest_version(spark, self.tracking)

    def log_version(self, spark: SparkSession) -> int | None:
        return SK.latest_version(spark, self.test_log)

    def touched(self, rows: DataFrame, by) -> list[int] | None:
        """The parts that a change by these rows concerns; None where the table is not kept in parts."""
        return SK.parts_of(rows, by, self.parts) if self.parts else None

    def _read(self, spark: SparkSession, base: str, schema, version: int | None, only: list[int] | None, buckets: dict) -> DataFrame | None:
        if self.parts:
            return SK.read_parts(spark, base, schema, version, only)
        return SK.read_snapshot(spark, base, schema, version, **buckets)

    def _write(self, df: DataFrame, base: str, after: int | None, only: list[int] | None, by, buckets: dict) -> int:
        v = 0 if after is None else after + 1
        if self.parts:
            SK.write_parts(df, base, v, self.parts, by, only)
        else:
            SK.write_snapshot(df, base, v, **buckets)
        return v

    def read_tracking(self, spark: SparkSession, version: int | None = None, only: list[int] | None = None) -> DataFrame:
        df = self._read(spark, self.tracking, TRACKING_SCHEMA, version, only, self._tracking_buckets())
        return df if df is not None else spark.createDataFrame([], TRACKING_SCHEMA)

    def read_log(self, spark: SparkSession, version: int | None = None, only: list[int] | None = None) -> DataFrame | None:
        return self._read(spark, self.test_log, TEST_LOG_SCHEMA, version, only, self._log_buckets())

    def write_tracking(self, df: DataFrame, after: int | None, only: list[int] | None = None) -> int:
        """Write the version after ``after``, the one that ``df`` was made from; ``only``: the parts that ``df`` holds."""
        return self._write(df, self.tracking, after, only, TRACKING_PART, self._tracking_buckets())

    def write_log(self, df: DataFrame, after: int | None, only: list[int] | None = None) -> int:
        return self._write(df, self.test_log, after, only, LOG_PART, self._log_buckets())


def _fixed(df: DataFrame) -> DataFrame:
    """Written to the checkpoint folder, for a frame that a step uses more than once."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def load_catalogue(spark: SparkSession, store: Store, routines: DataFrame, params: DataFrame,
                   uploads: DataFrame | None = None, existing: DataFrame | None = None, now=None,
                   target_dbname: str = "", target_schema_name: str = "", order_col: str | None = None) -> dict:
    """Step 1: attach parameters, stage without duplicates, upsert, write a tracking version.

    ``routines`` are catalogue rows (A1), ``uploads`` parsed upload rows (A3), ``existing``
    the rows of a stage that is there already (D10). The order of the batch
    decides which row of a key is staged and written: catalogue rows before
    uploads, then by ``order_col`` (a column of both) if given, then by db,
    schema, name and text; it does not depend on how the input is laid out.
    Returns the version written and the numbers of rows staged, inserted and updated.
    """
    batch = C.attach_params(routines, params) if order_col is None else \
        C.attach_params(routines.withColumnRenamed(order_col, "_given"), params, carry=["_given"])
    batch = batch.withColumn("_rank", F.lit(0))
    if uploads is not None:
        more = uploads if order_col is None else uploads.withColumnRenamed(order_col, "_given")
        batch = C.combine(batch, more.withColumn("_rank", F.lit(1)).select(*batch.columns))
    place = ["_rank", *(["_given"] if order_col else []), "dbname", "schema_name", "procedure_name"]
    seq = F.struct(*place, F.xxhash64("procedure_definition").alias("_text"))
    batch = batch.withColumn("seq", seq).drop("_rank", "_given")
    staged = _fixed(C.stage(existing, batch))
    n = staged.count()
    if n == 0:
        return {"version": None, "staged": 0, "inserted": 0, "updated": 0}
    read = store.tracking_version(spark)
    counts = Observation("upsert")
    only = None if read is None else store.touched(staged, TRACKING_PART)
    merged = U.upsert_tracking(store.read_tracking(spark, read, only), staged, now=now, target_dbname=target_dbname,
                               target_schema_name=target_schema_name, counts=counts)
    v = store.write_tracking(merged, read, only)
    return {"version": v, "staged": n, "inserted": counts.get["rows_inserted"], "updated": counts.get["rows_updated"]}


def save_flags(spark: SparkSession, store: Store, proposed: DataFrame) -> dict:
    """Step 2: write only changed flags; returns the number of changed rows."""
    read = store.tracking_version(spark)
    tracking = store.read_tracking(spark, read)
    changes = _fixed(C.changed_flags(tracking, proposed))
    n = changes.count()
    if n == 0:
        return {"version": None, "changed": 0}
    only = store.touched(changes, TRACKING_PART)
    changed = C.update_flags(store.read_tracking(spark, read, only), changes)
    return {"version": store.write_tracking(changed, read, only), "changed": n}


def extract(spark: SparkSession, store: Store, folder: str) -> dict:
    """Step 3: one file per flagged procedure.

    Returns the files written, the procedures whose file another one of the
    same safe name has replaced (last procedure name wins), and the rows skipped for want
    of a definition.
    """
    tracking = store.read_tracking(spark)
    if C.flagged(tracking).isEmpty():  # limit(1): stops at the first flagged row
        return {"exported": 0, "replaced": 0, "skipped": 0}
    rows = C.export_rows(tracking)
    exported = SK.export_scripts(rows, folder)
    lost = C.export_collisions(rows).agg(F.coalesce(F.sum(F.col("n_rows") - 1), F.lit(0))).first()[0]
    return {"exported": exported, "replaced": lost, "skipped": C.export_skipped(tracking).count()}


def process(scripts: DataFrame, source_schema: str, target_schema: str) -> DataFrame:
    """Step 4: cleaned text of every converted script, named ``processed_<file>`` (one projection)."""
    return scripts.select(F.concat(F.lit(P.PROCESSED_PREFIX), F.col("file_name")).alias("file_name"),
                          T.clean_script("text", source_schema, target_schema).alias("text"))


def record_results(spark: SparkSession, store: Store, outcomes: DataFrame) -> dict:
    """Step 5: upsert new outcomes into the log, mark deployed procedures.

    The outcomes are written once for both uses. Without a passed execution test
    no procedure changes and the tracking table keeps its version.
    """
    outcomes = _fixed(outcomes.select(*TEST_LOG_COLUMNS).withColumn("test_timestamp", T.utc_ms("test_timestamp")))
    read = store.log_version(spark)
    only = None if read is None else store.touched(outcomes, LOG_PART)
    v_log = store.write_log(U.upsert_results(store.read_log(spark, read, only), outcomes), read, only)
    if Q.passed(outcomes).isEmpty():
        return {"log_version": v_log, "tracking_version": None}
    read = store.tracking_version(spark)
    only = None if read is None else store.touched(Q.deployed_names(outcomes).dropna(), TRACKING_PART)
    marked = Q.mark_deployed(store.read_tracking(spark, read, only), outcomes)
    return {"log_version": v_log, "tracking_version": store.write_tracking(marked, read, only)}


def publish_passed(spark: SparkSession, store: Store, processed: DataFrame, folder: str) -> dict:
    """Step 6: write every passed procedure's processed script; report the missing ones."""
    log = store.read_log(spark)
    if log is None or Q.passed(log).isEmpty():
        return {"published": 0, "missing": 0}
    published = SK.publish(Q.publish_found(log, processed), folder)
    return {"published": published, "missing": Q.publish_missing(log, processed).count()}


def dashboard(log: DataFrame, facets: dict | None = None) -> dict[str, DataFrame]:
    """Result views: filtered rows newest first, metrics and facet values."""
    rows = Q.facet_filter(log, facets or {})
    return {"rows": C.log_view(rows),
            "metrics": Q.result_metrics(rows),
            "facets": Q.facet_values(log)}


def comparison_view(processed: DataFrame, extracted_rows: DataFrame, extracted_dir: str,
                    log: DataFrame) -> dict[str, DataFrame]:
    """Script viewer data: original next to converted, status labels, numbered lines."""
    return {"pairs": Q.pair_scripts(processed, extracted_rows, extracted_dir),
            "labels": Q.script_status(processed, log).orderBy("file_name"),
            "lines": Q.numbered_lines(processed, "file_name")}


def activity_log(spark: SparkSession, path: str, n: int = 25) -> dict[str, DataFrame]:
    """Application log: every line parsed, and the last ``n`` lines for display, both with their position.

    The last lines are read from the end of the log, whatever its size.
    """
    return {"parsed": R.parse_log(files.read_log_lines(spark, path)), "tail": log_end.tail_file(spark, path, n)}


NAME_COLUMNS = ("dbname", "schema_name", "procedure_name")


def index_names(spark: SparkSession, store: Store) -> str:
    """Build the substring index over the names of the newest tracking version, if it has none; the index's folder.

    What a build that died has left is replaced. One builder at a time.
    """
    version = store.tracking_version(spark)
    path = _names_path(store, version)
    if name_index.built_from(spark, path) is None:
        name_index.write_index(store.read_tracking(spark, version).select(*NAME_COLUMNS), path, stamp=f"version {version}")
    return path


def _names_path(store: Store, version: int | None) -> str:
    return f"{store.tracking.rstrip('/')}_names/of={-1 if version is None else version}"


def search_names(spark: SparkSession, store: Store, term: str) -> DataFrame:
    """Names of the newest tracking version that contain the term (C2): from its index, or by a scan while it has none."""
    version = store.tracking_version(spark)
    path = _names_path(store, version)
    if name_index.built_from(spark, path) is None:
        return C.search(store.read_tracking(spark, version).select(*NAME_COLUMNS), term)
    return name_index.search_index(spark, path, term)


def assessment(reports: DataFrame, key: str) -> DataFrame:
    """Converter assessment reports: the six metrics per report."""
    return R.report_table(reports, key)


def licence_status(listings: DataFrame, key: str, now=None) -> DataFrame:
    """Licence listings: parsable expiry dates and whether one is still ahead of ``now``."""
    if now is None:
        now = F.current_timestamp().cast("timestamp_ntz")
    return R.active_expiry(listings, key, now)


def converted_cache(spark: SparkSession, root: str, prefix: str) -> dict:
    """Converter output cache: objects whose key below ``root`` starts with ``prefix``, and whether any exists."""
    objects = R.list_objects(files.list_object_files(spark, root, prefix), prefix, path_col="key")
    return {"objects": objects, "exists": not objects.isEmpty()}


__all__ = ["Store", "load_catalogue", "save_flags", "extract", "process", "record_results",
           "publish_passed", "dashboard", "comparison_view", "activity_log", "assessment",
           "licence_status", "converted_cache", "index_names", "search_names"]
