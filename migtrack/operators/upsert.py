"""Keyed writes without MERGE: one set-based pass per batch.

The tracked workflow runs one MERGE statement per source row. Row by row, a
later source row with the same key meets the row inserted by an earlier one,
so per key: the *last* source row decides the updated values, the *first* one
decides identity columns of an insert, and rows whose key has a NULL part never
match anything (each is inserted). Here the source is first collapsed per key
(partial aggregates over narrow rows, so a hot key is reduced in every task),
the last rows are fetched, and one full outer join with the target, one shuffle a
side, gives updated, untouched and new rows together with the counts.

The result is a new snapshot; write it to a fresh path (``sources.sinks``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import TEST_LOG_COLUMNS, TRACKING_COLUMNS
from .catalog import ordered, row_hash

TRACKING_KEYS = ("schema_name", "procedure_name")
RESULT_KEYS = ("test_case_name", "procedure_name")


def has_keys(keys) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])


def _now(now) -> Column:
    if now is None:
        return F.current_timestamp().cast("timestamp_ntz")
    return now if isinstance(now, Column) else F.lit(now).cast("timestamp_ntz")


# --- D2 / E2: tracking table ---------------------------------------------------

def _new_rows(source: DataFrame, seq: str) -> DataFrame:
    """Keys, ``_new`` and ``_rows``: one row per key, for source rows whose key has no NULL part.

    ``_new`` has the last row's definition and parameters and the first row's
    source and db. The source is read twice: keys, order and identity for the
    aggregate, then whole rows for the fetch. A row without ``seq`` comes before all others.
    """
    keys = list(TRACKING_KEYS)
    order = F.struct(F.col(seq).isNotNull().alias("known"), F.col(seq).alias("seq"), row_hash(source).alias("hash"))
    source = source.where(has_keys(keys))
    ends = (source.select(*keys, "source", "dbname", order.alias("_order"))
            .groupBy(*keys).agg(F.max("_order").alias("_last"),
                                F.min_by(F.struct("source", "dbname"), "_order").alias("_first"),
                                F.count(F.lit(1)).alias("_rows")))
    rows = source.withColumn("_row", row_hash(source)).join(ends, keys).where(F.col("_row") == F.col("_last.hash"))
    number = F.row_number().over(Window.partitionBy(*keys, "_row").orderBy(F.lit(1)))
    rows = rows.withColumn("_n", number).where("_n = 1")  # a source row given twice counts once
    new = F.struct(F.col("_first.source").alias("source"), F.col("_first.dbname").alias("dbname"),
                   "procedure_definition", "parameters")
    return rows.select(*keys, new.alias("_new"), "_rows")


def _merged(target: DataFrame, source: DataFrame, now, target_dbname: str, target_schema_name: str,
            seq: str) -> DataFrame:
    """The new tracking rows with ``_inserted`` and ``_updated``: MERGE actions behind each row.

    Rows whose key has a NULL part, however many, go past the join: those of the
    target stay, those of the source are inserted, all where they are read.
    """
    keys = list(TRACKING_KEYS)
    ts = _now(now)
    target = target.withColumn("_old", F.lit(True))
    both = target.where(has_keys(keys)).join(_new_rows(source, seq), keys, "full_outer")
    loose = source.where(~has_keys(keys)).select(
        *keys, F.struct("source", "dbname", "procedure_definition", "parameters").alias("_new"), F.lit(1).cast("bigint").alias("_rows"))
    both = both.unionByName(target.where(~has_keys(keys)), allowMissingColumns=True).unionByName(loose, allowMissingColumns=True)
    old, new = F.coalesce("_old", F.lit(False)), F.col("_new").isNotNull()
    hit = old & new
    insert = dict(zip(("conversion_flag", "load_timestamp", "target_dbname", "target_schema_name", "is_deployed", "errors"),
                      _insert_defaults(ts, target_dbname, target_schema_name), strict=True))
    cols = []
    for c in TRACKING_COLUMNS:
        if c in keys:
            value = F.col(c)
        elif c in ("procedure_definition", "parameters"):
            value = F.when(new, F.col("_new")[c]).otherwise(F.col(c))
        elif c in ("source", "dbname"):
            value = F.when(old, F.col(c)).otherwise(F.col("_new")[c])
        elif c == "load_timestamp":
            value = F.when(new, ts).otherwise(F.col(c))
        else:
            value = F.when(old, F.col(c)).otherwise(insert[c])
        cols.append(value.alias(c))
    return both.select(
        *cols, F.when(old, 0).otherwise(1).cast("bigint").alias("_inserted"),
        F.when(hit, F.col("_rows")).when(old, 0).otherwise(F.col("_rows") - 1).cast("bigint").alias("_updated"))


def upsert_tracking(target: DataFrame, source: DataFrame, now=None,
                    target_dbname: str = "", target_schema_name: str = "",
                    seq: str = "seq", counts: Observation | None = None) -> DataFrame:
    """Upsert catalogue rows into the tracking table on (schema, name).

    Matched rows get definition, parameters and load time (flag, deployed,
    source and db are kept). New keys are inserted with flag FALSE, deployed
    FALSE, errors '' and the given target db/schema. ``now`` is an argument so
    the result repeats; default is the current time. ``counts`` gets
    rows_inserted and rows_updated (E2) while the result is written.
    """
    out = _merged(target, source, now, target_dbname, target_schema_name, seq)
    if counts is not None:
        out = out.observe(counts, *_totals())
    return out.select(*TRACKING_COLUMNS)


def _totals() -> list[Column]:
    return [F.coalesce(F.sum(f"_{c}"), F.lit(0)).cast("bigint").alias(f"rows_{c}") for c in ("inserted", "updated")]


def _insert_defaults(ts: Column, target_dbname: str, target_schema_name: str) -> list[Column]:
    """Constant columns of an inserted tracking row."""
    return [F.lit(False), ts, F.lit(target_dbname), F.lit(target_schema_name), F.lit(False), F.lit("")]


def upsert_counts(target: DataFrame, source: DataFrame, seq: str = "seq") -> DataFrame:
    """Rows inserted and rows updated, as the row-by-row MERGE would count them.

    Per key with ``n`` source rows and ``m`` matching target rows: ``n * m``
    updates when ``m > 0``; else one insert and ``n - 1`` updates of that row.
    Every NULL-key source row is one insert.
    """
    return _merged(target, source, None, "", "", seq).agg(*_totals())


# --- D3: test-result log ---------------------------------------------------------

_RESULT_VALUES = ("event_id", "test_case_id", "test_timestamp", "status", "errors")


def latest_per_key(rows: DataFrame, order: Column) -> DataFrame:
    """The row of highest ``order`` per (test, procedure); rows with a NULL key part are all kept.

    One aggregate over one pass: a NULL-key row is a group of its own by a running
    number, which also spreads such rows.
    """
    keys = list(RESULT_KEYS)
    alone = F.when(~has_keys(keys), F.monotonically_increasing_id())
    out = (rows.select(*keys, alone.alias("_alone"), F.struct(*_RESULT_VALUES).alias("_row"), order.alias("_order"))
           .groupBy(*keys, "_alone").agg(F.max_by("_row", "_order").alias("_row")))
    return out.select(*keys, "_row.*").select(*TEST_LOG_COLUMNS)


def upsert_results(target: DataFrame | None, source: DataFrame,
                   seq: str = "event_id") -> DataFrame:
    """D3: upsert test outcomes into the log on (test_case_name, procedure_name).

    Matched rows take id, time, status and errors of the last source row for
    the key; new keys are inserted from their last source row. Times are kept
    to the millisecond (I20). ``target=None`` is an empty log. Target and source
    are read once: of their union the source's last row wins, then the target's.
    """
    src = source.withColumn("test_timestamp", T.utc_ms("test_timestamp")).withColumn("_new", F.lit(1))
    rows = src if target is None else src.unionByName(target.withColumn("_new", F.lit(0)))
    order = F.struct("_new", F.col(seq).isNotNull().alias("known"), F.col(seq).alias("seq"), row_hash(rows).alias("hash"))
    return latest_per_key(rows, order)


# --- D12: insert if absent ---------------------------------------------------------

def insert_absent(target: DataFrame, source: DataFrame, keys, seq: str = "seq") -> DataFrame:
    """Insert-if-absent under a unique key, in ``seq`` order.

    Returns the source rows with ``accepted``: a row is inserted when its key
    is not in the target and it is the first source row of that key (by ``seq``, rows without one last,
    then by a hash of the row; of rows equal throughout one is); rows with
    a NULL key part are always inserted (NULLs do not collide in a unique key).
    Equal rows are counted first, so that however often one repeats it leaves a task once.
    """
    keys = list(keys)
    keyed = has_keys(keys)
    order = ordered(source, seq)
    counted = source.groupBy(*source.columns).agg(F.count(F.lit(1)).alias("_many")).withColumn("_order", order)
    fresh = counted.where(keyed).select(*keys, "_order").join(target.select(*keys).where(has_keys(keys)), keys, "left_anti")
    winners = fresh.groupBy(*keys).agg(F.min("_order").alias("_win"))
    out = counted.join(winners, keys, "left").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_many"))))
    accepted = (~keyed) | (F.coalesce(F.col("_order") == F.col("_win"), F.lit(False)) & (F.col("_i") == 1))
    return out.select(*source.columns, accepted.alias("accepted"))
