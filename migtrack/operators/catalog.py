"""Catalogue operators: parameters, staging, grouping, flag selection, export rows.

All keyed steps use declarative aggregates that Spark combines map-side, so a key
holding a large share of the rows is reduced in every task before the shuffle
instead of landing whole in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

STAGE_KEYS = ("source", "dbname", "schema_name", "procedure_name")
TRACKING_KEYS = ("schema_name", "procedure_name")
FLAG_KEYS = ("dbname", "schema_name", "procedure_name")


def null_safe_on(left: DataFrame, right: DataFrame, keys) -> Column:
    """Join condition matching NULL with NULL (Python tuple equality)."""
    return reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[k]) for k in keys])


def row_hash(df: DataFrame) -> Column:
    return F.xxhash64(*[F.col(c) for c in df.columns])


def ordered(df: DataFrame, seq: str, last: bool = False) -> Column:
    """What rows compare by: ``seq`` (which may be a struct), then a hash of the row.

    A row without ``seq`` loses against any with one, but wins when no row has one.
    """
    missing = F.col(seq).isNull()
    return F.struct((~missing if last else missing).alias("rank"), F.col(seq).alias("seq"), row_hash(df).alias("hash"))


def first_by(df: DataFrame, keys, seq: str, last: bool = False) -> DataFrame:
    """One row per key: the row with the lowest (or highest) ``seq``; NULL keys are keys too.

    The input is read once. Each task drops all but its first row of a key before the
    shuffle (a window limit), so a hot key leaves a task as one row. Rows equal in every
    column are one row.
    """
    order = ordered(df, seq, last)
    number = F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc() if last else order.asc()))
    return df.withColumn("_n", number).where("_n = 1").drop("_n")


def one_per_file(rows: DataFrame, name: str = "file_name", order: str = "procedure_name") -> DataFrame:
    """B2: one row per file name; of colliding rows the last in ``order``, which would overwrite the others."""
    return first_by(rows, [name], order, last=True)


# --- A1/A2 on DataFrames (JDBC readers live in sources.catalog) --------------

def routines_from(raw: DataFrame) -> DataFrame:
    """A1: procedures only, four catalogue columns."""
    return (raw.where(F.col("routine_type") == P.ROUTINE_TYPE_PROCEDURE)
            .select("dbname", "schema_name", "procedure_name", "procedure_definition"))


def params_from(raw: DataFrame) -> DataFrame:
    """A2: parameter rows with their ordinal kept as a column."""
    return raw.select("procedure_name", "mode", "name", "data_type", "char_length",
                      "ordinal_position")


# --- E1 / D1: ordered parameter list per name --------------------------------

def list_parts(params: DataFrame) -> DataFrame:
    """procedure_name, part, chunk: what each range of (name, ordinal, descriptor) adds to a name's list."""
    desc = T.param_desc("mode", "name", "data_type", "char_length")
    counted = (params.select("procedure_name", "ordinal_position", desc.alias("descriptor"))
               .groupBy("procedure_name", "ordinal_position", "descriptor")
               .agg(F.count(F.lit(1)).alias("n")))
    chunk = F.array_join(F.array_repeat("descriptor", F.col("n").cast("int")), ", ")
    return (counted.withColumn("chunk", chunk)
            .repartitionByRange("procedure_name", "ordinal_position", "descriptor")
            .groupBy("procedure_name", F.spark_partition_id().alias("part"))
            .agg(F.expr("listagg(chunk, ', ') WITHIN GROUP "
                        "(ORDER BY ordinal_position, descriptor)").alias("chunk")))


def param_list(params: DataFrame) -> DataFrame:
    """Per procedure name, descriptors joined by ``", "`` in ordinal order.

    Three steps. First identical (name, ordinal, descriptor) rows are counted,
    a map-side combinable aggregate, so repeated signatures (one name in many
    name. Then the distinct entries are dealt by ranges of (name, ordinal, descriptor), so
    that the entries of a hot name lie in many ranges, and each range's part of a
    list is one ordered ``listagg``, an entry repeated ``n`` times. Last, the parts of a
    name, one row per range, are joined in the order of the ranges. Ties on the ordinal are
    ordered by descriptor text, which makes the result deterministic without changing it
    for equal descriptors.
    The list of a name is one cell by definition: one of more than 2 GB, or an entry that
    repeats 2**31 times, ends the query with Spark's overflow error.
    """
    return (list_parts(params).groupBy("procedure_name")
            .agg(F.expr("listagg(chunk, ', ') WITHIN GROUP (ORDER BY part)").alias("parameters")))


def attach_params(routines: DataFrame, params: DataFrame, carry=()) -> DataFrame:
    """Every routine with its parameter list ('' when none), matched by name only."""
    plist = param_list(params)
    return (routines.join(plist, "procedure_name", "left")
            .select(*carry, F.lit(P.SOURCE_CATALOGUE).alias("source"), "dbname", "schema_name",
                    "procedure_name", "procedure_definition",
                    F.coalesce(F.col("parameters"), F.lit("")).alias("parameters")))


# --- H1 / D10: staging -------------------------------------------------------

def combine(*frames: DataFrame) -> DataFrame:
    """H1: catalogue rows and uploaded rows into one batch."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def stage(existing: DataFrame | None, batch: DataFrame, seq: str = "seq") -> DataFrame:
    """Batch rows whose 4-part key is not staged yet, first by ``seq`` per key.

    Keys compare NULL-safe (the stage is a set of Python tuples). ``existing``
    None is an empty stage.
    """
    keys = list(STAGE_KEYS)
    fresh = batch
    if existing is not None:
        staged_keys = existing.select(*keys)  # an anti join ignores duplicates on this side
        fresh = batch.join(staged_keys, null_safe_on(batch, staged_keys, keys), "left_anti")
    return first_by(fresh, keys, seq)


# --- E3 / C1 / C2: views of the tracking table --------------------------------

def schema_groups(tracking: DataFrame) -> DataFrame:
    """Procedures per (db, schema), one per distinct qualified name."""
    full = tracking.select(T.qualify("dbname", "schema_name", "procedure_name").alias("full_name"))
    parts = full.distinct().select(T.unqualify("full_name").alias("p"))
    return (parts.groupBy(F.col("p")[0].alias("dbname"), F.col("p")[1].alias("schema_name"))
            .agg(F.count(F.lit(1)).alias("n_procs")))


def schema_members(tracking: DataFrame) -> DataFrame:
    """The members behind each group, one row per distinct qualified name, sorted.

    Rows, not a collected list, so a schema holding most procedures stays spread.
    """
    parts = (tracking.select(T.qualify("dbname", "schema_name", "procedure_name").alias("full_name"))
             .distinct().select(T.unqualify("full_name").alias("p")))
    return (parts.select(F.col("p")[0].alias("dbname"), F.col("p")[1].alias("schema_name"),
                         F.col("p")[2].alias("procedure_name"))
            .orderBy("dbname", "schema_name", "procedure_name"))


def tracking_view(tracking: DataFrame) -> DataFrame:
    """A5: the tracking table ordered by db, schema, name (NULLs last, as the source database)."""
    return tracking.orderBy(*[F.col(c).asc_nulls_last() for c in ("dbname", "schema_name", "procedure_name")])


def flagged(tracking: DataFrame) -> DataFrame:
    """Rows flagged for conversion (NULL flag is not flagged): name and body."""
    return tracking.where(F.col("conversion_flag")).select("procedure_name", "procedure_definition")


def log_view(log: DataFrame) -> DataFrame:
    """The test log newest first (rows without a time first, as the source database).

    Rows of one time go by ``event_id``, newest first, so that many rows
    without a time neither share a task nor have an order of chance.
    """
    return log.orderBy(F.col("test_timestamp").desc_nulls_first(), F.col("event_id").desc_nulls_first())


def search(df: DataFrame, term: str, col: str = "procedure_name") -> DataFrame:
    """Case-insensitive substring match, literal (no wildcards); '' keeps all.

    Sorted by the name, then by the other columns (a name may fill many rows).
    """
    out = df if not term else df.where(F.lower(F.col(col)).contains(term.lower()))
    return out.orderBy(col, *[c for c in df.columns if c != col])


# --- C5 / D4: flag changes ----------------------------------------------------

def changed_flags(current: DataFrame, proposed: DataFrame) -> DataFrame:
    """Proposals whose flag differs from the stored one (NULL stored = False).

    Both sides are keyed by the qualified name ``db.schema.proc`` and the parts
    are split back at the first two dots, as the selection screen does.
    """
    cur = (current.select(T.qualify("dbname", "schema_name", "procedure_name").alias("full_name"),
                          F.coalesce(F.col("conversion_flag"), F.lit(False)).alias("cur_flag"))
           .groupBy("full_name").agg(F.max("cur_flag").alias("cur_flag")))
    new = (proposed.select(T.qualify("dbname", "schema_name", "procedure_name").alias("full_name"),
                           F.col("new_flag"))
           .groupBy("full_name").agg(F.max("new_flag").alias("new_flag")))
    diff = cur.join(new, "full_name").where(F.col("new_flag") != F.col("cur_flag"))
    parts = T.unqualify("full_name")
    return diff.select(parts[0].alias("dbname"), parts[1].alias("schema_name"),
                       parts[2].alias("procedure_name"), "new_flag")


def update_flags(tracking: DataFrame, changes: DataFrame) -> DataFrame:
    """Keyed UPDATE of the conversion flag on (db, schema, name); NULL keys never match.

    ``changes`` holds a key once, as ``changed_flags`` gives it.
    """
    keys = list(FLAG_KEYS)
    ch = changes.select(*keys, F.col("new_flag").alias("_new"), F.lit(True).alias("_hit"))
    joined = tracking.join(ch, keys, "left")
    flag = F.when(F.col("_hit"), F.col("_new")).otherwise(F.col("conversion_flag"))
    return joined.select(*[flag.alias(c) if c == "conversion_flag" else F.col(c)
                           for c in tracking.columns])


# --- B2: export rows -----------------------------------------------------------

def export_rows(tracking: DataFrame) -> DataFrame:
    """B2: one file per flagged procedure: safe file name and stripped body + newline.

    A NULL definition cannot be written; such rows are left out (counted by
    ``export_skipped``).
    """
    rows = flagged(tracking).where(F.col("procedure_definition").isNotNull())
    return rows.select("procedure_name",
                       F.concat(T.safe_name("procedure_name"), F.lit(P.SCRIPT_EXT)).alias("file_name"),
                       T.export_body("procedure_definition").alias("body"))


def export_skipped(tracking: DataFrame) -> DataFrame:
    """Flagged rows that have no definition to write."""
    return flagged(tracking).where(F.col("procedure_definition").isNull())


def export_collisions(rows: DataFrame) -> DataFrame:
    """File names produced by more than one procedure (the later file would overwrite)."""
    return (rows.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_rows"))
            .where(F.col("n_rows") > 1))
