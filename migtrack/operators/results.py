"""Test-outcome operators: filters, metrics, latest status, deploy/publish sets, ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from .catalog import one_per_file

FACETS = ("procedure_name", "status", "test_case_id", "test_case_name")


def facet_filter(df: DataFrame, facets: dict) -> DataFrame:
    """IN within a facet, AND across facets; an empty facet filters nothing.

    Values and columns compare as text, whatever their types. A list of any
    length is a table of one text column and a semi join, which Spark
    broadcasts or shuffles by its measured size.
    """
    spark = df.sparkSession
    out = df
    for col, values in facets.items():
        values = list(values or [])
        if not values:
            continue
        table = spark.createDataFrame([(_as_text(v),) for v in values], "_value string")
        out = out.join(table, out[col].cast("string") == table["_value"], "left_semi")
    return out


def _as_text(value) -> str | None:
    """A facet value as Spark's cast to string writes it."""
    if value is None:
        return None
    return str(value).lower() if isinstance(value, bool) else str(value)


def passed(df: DataFrame, test: str = P.TEST_EXECUTION) -> DataFrame:
    """C4: rows of a successful run of ``test``."""
    return df.where((F.col("status") == P.STATUS_SUCCESS) & (F.col("test_case_name") == test))


def result_metrics(df: DataFrame) -> DataFrame:
    """Total, passed, failed (= total - passed: any other or NULL status fails)."""
    m = df.agg(F.count(F.lit(1)).alias("total_tests"),
               F.count_if(F.col("status") == P.STATUS_SUCCESS).alias("passed_tests"))
    return m.select("total_tests", "passed_tests",
                    (F.col("total_tests") - F.col("passed_tests")).alias("failed_tests"))


def latest_status(log: DataFrame, tiebreak: str = "event_id") -> DataFrame:
    """E5: the latest row per procedure over both tests.

    Rows sort by time with missing times last, and the last row wins, so a
    row without a time beats any timed row; equal times go to the higher
    ``tiebreak``. ``max_by`` is a partial aggregate: one candidate per
    procedure leaves each task, whatever the size of the procedure's history.
    """
    order = F.struct(F.col("test_timestamp").isNull(), F.col("test_timestamp"), F.col(tiebreak))
    row = F.struct("test_case_name", "test_timestamp", "status")
    return (log.groupBy("procedure_name").agg(F.max_by(row, order).alias("_r"))
            .select("procedure_name", "_r.test_case_name", "_r.test_timestamp", "_r.status"))


def facet_values(df: DataFrame, cols=FACETS) -> DataFrame:
    """Sorted distinct values per facet (ids compare as strings)."""
    cols = list(cols)
    as_text = df.select(*[F.col(c).cast("string").alias(c) for c in cols])
    long = as_text.unpivot([], cols, "facet", "value")
    return long.distinct().orderBy("facet", "value")


def deployed_names(log: DataFrame) -> DataFrame:
    """The tested names of passed execution tests without a trailing ``(...)``, each once."""
    return passed(log).select(T.bare_name("procedure_name").alias("procedure_name")).distinct()


def mark_deployed(tracking: DataFrame, log: DataFrame) -> DataFrame:
    """IS_DEPLOYED = TRUE for every row named like a passed execution test.

    The name is the tested name without a trailing ``(...)``; the match is by
    name only, so every schema holding that name is marked.
    """
    names = deployed_names(log).withColumn("_hit", F.lit(True))
    joined = tracking.join(names, "procedure_name", "left")
    flag = F.when(F.col("_hit"), F.lit(True)).otherwise(F.col("is_deployed"))
    return joined.select(*[flag.alias(c) if c == "is_deployed" else F.col(c)
                           for c in tracking.columns])


def test_runs(procs: DataFrame, name_col: str = "procedure_name") -> DataFrame:
    """Both tests for every procedure: (test_case_name, procedure_name)."""
    tests = F.array(F.lit(P.TEST_CREATE), F.lit(P.TEST_EXECUTION))
    return procs.select(F.explode(tests).alias("test_case_name"),
                        F.col(name_col).alias("procedure_name"))


def pending_tests(candidates: DataFrame, log: DataFrame) -> DataFrame:
    """Candidate (test, procedure) runs that have not already succeeded."""
    keys = ["test_case_name", "procedure_name"]
    done = log.where(F.col("status") == P.STATUS_SUCCESS).select(*keys)  # anti join: duplicates harmless
    return candidates.join(done, keys, "left_anti")


def script_status(scripts: DataFrame, log: DataFrame) -> DataFrame:
    """Every processed script with the latest status of its procedure (default ❔)."""
    latest = latest_status(log).select("procedure_name", F.col("status").alias("_status"))
    named = scripts.select("file_name", T.unprefixed("file_name").alias("procedure_name"))
    joined = named.join(latest, "procedure_name", "left")
    status = F.coalesce(F.col("_status"), F.lit(P.STATUS_UNKNOWN))
    return joined.select("file_name", "procedure_name", status.alias("status"),
                         T.label("file_name", status).alias("label"))


def pair_scripts(processed: DataFrame, extracted: DataFrame, extracted_dir: str) -> DataFrame:
    """Each processed script next to its original; a missing original becomes a note."""
    # both sides as the viewer reads a file: BOM dropped, universal newlines
    originals = (one_per_file(extracted.select("file_name", "procedure_name", "body"))
                 .select("file_name", T.universal_newlines(T.strip_bom("body")).alias("_original")))
    named = processed.select(F.col("file_name"),
                             T.universal_newlines(T.strip_bom("text")).alias("converted"),
                             T.strip_processed("file_name").alias("original_file"))
    joined = named.join(originals, named["original_file"] == originals["file_name"], "left") \
        .drop(originals["file_name"])
    missing = F.concat(F.lit(P.FILE_NOT_FOUND + extracted_dir.rstrip("/") + "/"),
                       F.col("original_file"))
    original = F.when(F.col("original_file").isNotNull(),
                      F.coalesce(F.col("_original"), missing))
    return joined.select("file_name", "original_file", original.alias("original"), "converted")


def passed_names(log: DataFrame) -> DataFrame:
    """Distinct names with a passed execution test."""
    return passed(log).select("procedure_name").distinct()


def _publish_names(log: DataFrame) -> DataFrame:
    return passed_names(log).withColumn(
        "source_file", F.concat(F.lit(P.PROCESSED_PREFIX), F.col("procedure_name"),
                                F.lit(P.SCRIPT_EXT)))


def publish_found(log: DataFrame, scripts: DataFrame) -> DataFrame:
    """Passed procedures whose processed script exists, with the published name."""
    names = _publish_names(log)
    files = scripts.select(F.col("file_name").alias("source_file"), "text")
    return names.join(files, "source_file").select(
        "procedure_name", "source_file",
        F.concat(F.lit(P.DEPLOYED_PREFIX), F.col("procedure_name"), F.lit(P.SCRIPT_EXT))
        .alias("target_file"), "text")


def publish_missing(log: DataFrame, scripts: DataFrame) -> DataFrame:
    """Passed procedures without a processed script (reported, skipped)."""
    names = _publish_names(log)
    files = scripts.select(F.col("file_name").alias("source_file"))
    return names.join(files, "source_file", "left_anti").select("procedure_name", "source_file")


def lookup_params(tests: DataFrame, meta: DataFrame) -> DataFrame:
    """D11 + I14: parameters of each tested name (first (db, schema) holding it) and the call."""
    one = (meta.groupBy("procedure_name")
           .agg(F.min_by("parameters", F.struct("dbname", "schema_name")).alias("_params")))
    joined = tests.select("procedure_name").join(one, "procedure_name", "left")
    params = F.coalesce(F.col("_params"), F.lit(""))
    return joined.select("procedure_name", T.param_count(params).alias("n_params"),
                         T.call_text("procedure_name", params).alias("call_text"))


SAMPLE = 20    # sampled keys per range, of which every SAMPLE-th is a bound
BLOCK = 10_000  # copies of one row that are made at once


def range_bounds(keys: DataFrame, n: int) -> DataFrame:
    """One row, one array: n - 1 ascending bounds that cut the distinct values of ``_key`` into about equal ranges.

    The sample is the keys of smallest hash, at most ``SAMPLE * n`` of them at any size of
    the input, so equal inputs have equal bounds.
    """
    sample = keys.orderBy(F.xxhash64("_key"), "_key").limit(SAMPLE * n)
    drawn = sample.agg(F.array_sort(F.collect_list("_key")).alias("_drawn"))
    at = lambda i: F.floor(i * F.size("_drawn") / n).cast("int")
    return drawn.select(F.transform(F.sequence(F.lit(1), F.lit(n - 1)), lambda i: F.get("_drawn", at(i))).alias("_bounds"))


def range_of(bounds: str, key: str, n: int) -> Column:
    """How many of n - 1 ascending bounds are not above the key, by binary search; ``n`` is a power of two."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(n.bit_length() - 1))])
    return F.aggregate(steps, F.lit(0), lambda low, step: F.when(
        F.get(bounds, low + step - 1) <= F.col(key), low + step).otherwise(low))


def assign_ids(df: DataFrame, order_cols, id_col: str = "test_case_id", start: int = 1,
               unique: bool = False) -> DataFrame:
    """Running id 1, 2, 3 ... (as text) in the order of ``order_cols``.

    Nothing runs while the plan is built and no row is written. The rows are cut into ranges
    of their order columns: one narrow pass samples the bounds, another counts the rows of
    each range, and the ids are the offset of the range plus the position in it, which a
    window per range finds. What range a row is in depends on its values alone, so all three
    passes, and tasks run again after a loss, agree. Bounds and offsets, at most four ranges
    a shuffle partition, are all that is broadcast.

    Rows equal in every order column go by a hash of all their columns, so a value shared by a third
    of the rows still spreads over many ranges. Rows equal in every column are one row with a
    count until they have their ids; one task writes the copies of a row. ``unique``: the order columns tell
    all rows apart; then only they are read to find and count the ranges, and the other columns are
    shuffled once instead of twice.
    """
    spark, order_cols = df.sparkSession, list(order_cols)
    n = 1 << (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length()
    tie = [] if unique else [F.xxhash64(*df.columns).alias("_tie")]
    keyed = df.withColumn("_key", F.struct(*order_cols, *tie))
    keys = keyed.select("_key") if unique else keyed.select("_key").distinct()
    ranged = (keyed.withColumn("_bounds", range_bounds(keys, n).scalar())
              .withColumn("_range", range_of("_bounds", "_key", n)).drop("_bounds"))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_rows"))
               .select("_range", F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset")))
    inside = Window.partitionBy("_range").orderBy("_key")
    if unique:
        placed = ranged.withColumn("_at", F.row_number().over(inside).cast("long") - 1)
    else:
        counted = ranged.groupBy("_range", "_key", *df.columns).agg(F.count(F.lit(1)).alias("_copies"))
        last = F.sum("_copies").over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
        placed = (counted.withColumn("_at", last - F.col("_copies"))
                  .withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_copies") - 1, F.lit(BLOCK).cast("long"))))
                  .withColumn("_copy", F.explode(F.sequence("_block", F.least(F.col("_block") + BLOCK, F.col("_copies")) - 1)))
                  .withColumn("_at", F.col("_at") + F.col("_copy")))
    ids = (F.col("_offset") + F.col("_at") + F.lit(start)).cast("string")
    return placed.join(F.broadcast(offsets), "_range", "left").select(*df.columns, ids.alias(id_col))


def numbered_lines(df: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """One row per line with its 1-based number."""
    return df.select(key, F.posexplode(T.script_lines(text_col)).alias("_pos", "line")) \
        .select(key, (F.col("_pos") + 1).alias("line_no"), "line")

