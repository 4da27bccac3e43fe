"""Incremental test-result log with Structured Streaming.

New outcome files land in a folder. A streaming aggregate keeps the newest outcome of
every (test, procedure) in the state store and, in update mode, emits the keys that a
micro-batch touches; ``foreachBatch`` writes those as one folder of changes, named by the
batch id. A batch costs what it brings, not what the log holds. Outcomes whose key
has a NULL part never merge; a second query appends them as they come, so that they
need no state. The log is, per key, the change of the highest batch, and all loose rows;
``compact`` folds old changes into one table.

A replayed batch starts from the same state and writes the same folder again; the file
sink of the loose rows keeps its own record of what it has written. Per key the outcome with
the highest ``event_id`` wins, so the order in which files are picked up does not change the log.
The state holds one row per key, as the log does, in RocksDB on the executors' disks with its
checkpoints in the stream's folder.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.catalog import row_hash
from ..operators.upsert import RESULT_KEYS, has_keys, latest_per_key
from ..schemas import TEST_LOG_COLUMNS, TEST_LOG_SCHEMA
from ..session import scratch_dir
from ..sources import sinks as SK

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGES, LOOSE, FOLDED = "changes", "loose", "folded"
VALUES = [c for c in TEST_LOG_COLUMNS if c not in RESULT_KEYS]


def _in_log(outcomes: DataFrame) -> DataFrame:
    return outcomes.withColumn("test_timestamp", T.utc_ms("test_timestamp")).select(*TEST_LOG_COLUMNS)


def _newest(rows: DataFrame, seq: str) -> Column:
    """Highest ``seq``, then a hash of the row; a row without ``seq`` loses against any with one."""
    return F.struct(F.col(seq).isNotNull().alias("known"), F.col(seq).alias("seq"), row_hash(rows).alias("hash"))


def merge_newest(target: DataFrame | None, batch: DataFrame, seq: str = "event_id") -> DataFrame:
    """Log upsert where the highest ``seq`` per key wins (order-independent).

    Equal to the row-by-row MERGE when batches arrive in ``seq`` order. Rows with
    a NULL key never merge and are all kept; a row without ``seq`` loses against
    any with one, but is kept whole when its key has no other.
    """
    src = _in_log(batch)
    rows = src if target is None else target.select(*TEST_LOG_COLUMNS).unionByName(src)
    return latest_per_key(rows, _newest(rows, seq))


class ForeignLog(RuntimeError):
    """The log folder belongs to another writer."""


def _own(spark: SparkSession, log_dir: str, checkpoint: str) -> None:
    """Mark ``log_dir`` as this checkpoint's; refuse one that has rows of another writer."""
    mark = f"{log_dir.rstrip('/')}/_stream"
    if SK.path_exists(spark, mark):
        owner = spark.read.text(mark).first()[0]
        if owner != checkpoint:
            raise ForeignLog(f"{log_dir} belongs to the stream with checkpoint {owner}")
    elif SK.latest_version(spark, log_dir) is not None or SK.path_exists(spark, f"{log_dir}/{CHANGES}"):
        raise ForeignLog(f"{log_dir} holds rows that no stream with this checkpoint has written")
    else:
        spark.createDataFrame([(checkpoint,)], "value string").coalesce(1).write.text(mark)


class LogStream:
    """The two running queries of a log: keyed rows and loose rows."""

    def __init__(self, *queries):
        self.queries = queries

    def awaitTermination(self) -> None:  # noqa: N802 - named as a streaming query's
        for q in self.queries:
            q.awaitTermination()

    def exception(self):
        return next((e for e in (q.exception() for q in self.queries) if e is not None), None)

    def stop(self) -> None:
        for q in self.queries:
            q.stop()


def _change_path(log_dir: str, batch_id: int) -> str:
    return f"{log_dir.rstrip('/')}/{CHANGES}/batch={batch_id:012d}"


def start_log_stream(spark: SparkSession, in_dir: str, log_dir: str, checkpoint: str,
                     files_per_batch: int | None = None, available_now: bool = True, seq: str = "event_id") -> LogStream:
    """Start the stream from ``in_dir`` (parquet outcome files) into ``log_dir``.

    ``log_dir`` belongs to this stream's ``checkpoint``; a folder that another checkpoint or
    a batch step has written to is refused. By default a trigger takes every new file.
    """
    _own(spark, log_dir, checkpoint)

    def outcomes() -> DataFrame:
        reader = spark.readStream.schema(TEST_LOG_SCHEMA)
        if files_per_batch:
            reader = reader.option("maxFilesPerTrigger", files_per_batch)
        return _in_log(reader.parquet(in_dir))

    def write_changes(batch: DataFrame, batch_id: int) -> None:
        batch.select(*TEST_LOG_COLUMNS).write.mode("overwrite").parquet(_change_path(log_dir, batch_id))

    def started(writer, name: str):
        writer = writer.option("checkpointLocation", f"{checkpoint.rstrip('/')}/{name}")
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()

    rows = outcomes()
    keyed = rows.where(has_keys(RESULT_KEYS)).select(*RESULT_KEYS, F.struct(*VALUES).alias("row"), _newest(rows, seq).alias("order"))
    latest = keyed.groupBy(*RESULT_KEYS).agg(F.max_by("row", "order").alias("row")).select(*RESULT_KEYS, "row.*")
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        first = started(latest.writeStream.outputMode("update").foreachBatch(write_changes), "keyed")
    finally:
        spark.conf.set(STATE_STORE, before)
    loose = outcomes().where(~has_keys(RESULT_KEYS))
    return LogStream(first, started(loose.writeStream.format("parquet").option("path", f"{log_dir}/{LOOSE}"), "loose"))


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    """The numbers n of the finished sub-folders ``...=n``, ascending."""
    if not SK.path_exists(spark, folder):
        return []
    fs, p = SK._fs(spark, folder)
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    return sorted(int(n.partition("=")[2]) for n in names if "=" in n and SK.complete(spark, f"{folder}/{n}"))


def _keyed(spark: SparkSession, log_dir: str, batches: list[int], folded: int | None) -> DataFrame:
    """Per key the row of the highest of the given batches, over the changes folded up to ``folded``."""
    rows = spark.createDataFrame([], TEST_LOG_SCHEMA).withColumn("batch", F.lit(0).cast("long"))
    if batches:
        found = spark.read.schema(TEST_LOG_SCHEMA).parquet(*[_change_path(log_dir, b) for b in batches])
        at = F.regexp_extract(F.col("_metadata.file_path"), "batch=(\\d+)/[^/]*$", 1).cast("long")
        rows = rows.unionByName(found.select(*TEST_LOG_COLUMNS, at.alias("batch")))
    if folded is not None:
        old = spark.read.schema(TEST_LOG_SCHEMA).parquet(f"{log_dir}/{FOLDED}/upto={folded:012d}")
        rows = rows.unionByName(old.withColumn("batch", F.lit(-1).cast("long")))
    newest = rows.groupBy(*RESULT_KEYS).agg(F.max_by(F.struct(*VALUES), "batch").alias("row"))
    return newest.select(*RESULT_KEYS, "row.*").select(*TEST_LOG_COLUMNS)


def read_log(spark: SparkSession, log_dir: str) -> DataFrame:
    """The log: the latest row of every key, and all rows whose key has a NULL part."""
    folded = max(_numbers(spark, f"{log_dir}/{FOLDED}"), default=None)
    batches = [b for b in _numbers(spark, f"{log_dir}/{CHANGES}") if folded is None or b > folded]
    out = _keyed(spark, log_dir, batches, folded)
    if SK.path_exists(spark, f"{log_dir}/{LOOSE}/_spark_metadata"):
        out = out.unionByName(spark.read.schema(TEST_LOG_SCHEMA).parquet(f"{log_dir}/{LOOSE}"))
    return out


def compact(spark: SparkSession, log_dir: str) -> int | None:
    """Fold all changes but the last batch's, which may be replayed, into one table; the last batch folded.

    Run by one process at a time; the stream may go on. Readers that have begun on the old files may have to begin again.
    """
    tables = _numbers(spark, f"{log_dir}/{FOLDED}")
    folded = max(tables, default=None)
    finished = _numbers(spark, f"{log_dir}/{CHANGES}")
    batches = [b for b in finished[:-1] if folded is None or b > folded]
    if batches:
        _keyed(spark, log_dir, batches, folded).write.mode("overwrite").parquet(f"{log_dir}/{FOLDED}/upto={batches[-1]:012d}")
        folded = batches[-1]
    for b in finished:
        if folded is not None and b <= folded:
            SK.delete(spark, _change_path(log_dir, b))
    for t in tables:
        if t != folded:
            SK.delete(spark, f"{log_dir}/{FOLDED}/upto={t:012d}")
    return folded


def replay_log_stream(spark: SparkSession, *drops: DataFrame) -> DataFrame:
    """Drop each frame of outcomes into the folder and run the stream to its end each time; the log."""
    base = scratch_dir(spark, "result-stream")
    in_dir, log_dir, ckpt = f"{base}/in", f"{base}/log", f"{base}/checkpoint"
    for outcomes in drops:
        outcomes.select(*TEST_LOG_COLUMNS).write.mode("append").parquet(in_dir)
        q = start_log_stream(spark, in_dir, log_dir, ckpt)
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))
    return read_log(spark, log_dir)
