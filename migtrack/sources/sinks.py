"""Sinks: fixed-schema tables, versioned snapshots, per-script file exports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T_

from ..functions import patterns as P
from ..operators.catalog import first_by, one_per_file, row_hash
from .script_files import read_files, remove_files, write_files  # noqa: F401 - reading and removing files is part of this module


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return bool(fs.exists(p))


def complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished write left its marker in the folder."""
    return path_exists(spark, path.rstrip("/") + "/_SUCCESS")


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file, over one that is there."""
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()


def ensure_table(spark: SparkSession, path: str, schema: T_.StructType) -> DataFrame:
    """B1: create an empty parquet table with a fixed schema if none is there; return it.

    A folder without a finished write (a creation that failed) gets the empty
    table; data that is in it stays.
    """
    if not complete(spark, path):
        spark.createDataFrame([], schema).write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


# --- versioned snapshots (upserts write a new version, never over a path being read) ---

def snapshot_path(base: str, version: int) -> str:
    return f"{base.rstrip('/')}/v={int(version):012d}"


def latest_version(spark: SparkSession, base: str) -> int | None:
    """Highest complete version under ``base`` (a folder holding ``_SUCCESS``)."""
    if not path_exists(spark, base):
        return None
    fs, p = _fs(spark, base)
    best = None
    for st in fs.listStatus(p):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v="):
            if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                v = int(name[2:])
                best = v if best is None or v > best else best
    return best


def _table_name(base: str, version: int) -> str:
    import hashlib
    return f"migtrack_{hashlib.sha1(base.rstrip('/').encode()).hexdigest()[:12]}_v{int(version)}"


# --- versions in parts: a change of a few keys writes the parts that hold them ----------------

PART = "part"
PARTS_FILE = "_parts"   # of a version: for each part the version that holds its rows, -1 for none


def part_of(by, parts: int) -> Column:
    """The part of a row: by the hash of the first column of ``by``, its name.

    A row without a name, which no key finds, goes by the other columns, which no step changes.
    """
    name, others = F.col(by[0]), [F.col(c) for c in by[1:]]
    return F.pmod(F.when(name.isNull(), F.xxhash64(*others)).otherwise(F.xxhash64(name)), F.lit(parts)).cast("int")


def parts_of(rows: DataFrame, by, parts: int) -> list[int]:
    """The parts that hold, or are to hold, the given rows; at most ``parts`` numbers. Rows without a name need all of ``by``."""
    known = rows.select(*[F.col(c) if c in rows.columns else F.lit(None).alias(c) for c in by])
    return sorted(r[0] for r in known.select(part_of(by, parts).alias("p")).distinct().collect())


def _parts_file(spark: SparkSession, base: str, version: int) -> list[int]:
    data = read_text(spark, f"{snapshot_path(base, version)}/{PARTS_FILE}")
    return [int(x) for x in data.split()]


def read_parts(spark: SparkSession, base: str, schema: T_.StructType, version: int | None = None,
               only: list[int] | None = None) -> DataFrame | None:
    """The rows of a version written in parts (default: the latest), or of some of its parts; None when there is none."""
    v = latest_version(spark, base) if version is None else version
    if v is None:
        return None
    held = _parts_file(spark, base, v)
    paths = [f"{snapshot_path(base, held[p])}/{PART}={p}" for p in (range(len(held)) if only is None else only) if held[p] >= 0]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def write_parts(df: DataFrame, base: str, version: int, parts: int, by, changed: list[int] | None = None) -> str:
    """Write version ``version`` as the one before with the ``changed`` parts (default: all) replaced by ``df``.

    Only those parts are written; the others stay where earlier versions have them, so those
    versions must be kept. A version counts once its list of parts and its ``_SUCCESS`` are there.
    """
    spark = df.sparkSession
    path = snapshot_path(base, version)
    _claim(spark, base, version)
    changed = list(range(parts)) if changed is None else changed
    spread = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // max(1, len(changed)))
    rows = df.withColumn(PART, part_of(by, parts))
    rows = rows.repartition(PART, F.pmod(row_hash(df), F.lit(spread)))  # a part of many rows is several tasks and files
    (rows.write.mode("errorifexists").partitionBy(PART)
     .option("mapreduce.fileoutputcommitter.marksuccessfuljobs", "false").parquet(path))
    held = _parts_file(spark, base, version - 1) if version else [-1] * parts
    if len(held) != parts:
        raise ValueError(f"{base} has {len(held)} parts, not {parts}")
    fs, p = _fs(spark, path)
    fs.mkdirs(p)
    written = {int(st.getPath().getName().partition("=")[2]) for st in fs.listStatus(p) if st.getPath().getName().startswith(PART + "=")}
    if not written.issubset(changed):
        raise ValueError(f"rows of parts {sorted(written.difference(changed))} were not to be written")
    for c in changed:
        held[c] = version if c in written else -1
    for file, text in ((PARTS_FILE, " ".join(map(str, held))), ("_SUCCESS", "")):
        write_text(spark, f"{path}/{file}", text)
    return path


class VersionTaken(RuntimeError):
    """Another writer has written, or begun, the version that was to be written."""


def write_snapshot(df: DataFrame, base: str, version: int, bucket_by=None,
                   buckets: int | None = None, replay: bool = False) -> str:
    """Write ``df`` as version ``version``, which must not exist.

    A step writes the version after the one it read. When another step has
    done so meanwhile, its rows would be lost, so the later one fails with
    ``VersionTaken`` and is to be run again. ``replay`` is for a stream whose
    batch may be repeated: the same batch gives the same version, overwritten.
    What a failed step left behind blocks its version until ``discard_unfinished``.

    With ``bucket_by`` the version is a bucketed table (one file per bucket,
    sorted by the key): a later join or anti join on that key reads it without
    a shuffle, and only the other side is shuffled to match the buckets.
    """
    spark = df.sparkSession
    path = snapshot_path(base, version)
    if not replay:
        _claim(spark, base, version)
    if not bucket_by:
        df.write.mode("overwrite" if replay else "errorifexists").parquet(path)
        return path
    keys = list(bucket_by)
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = _table_name(base, version)
    if path_exists(spark, path) and not spark.catalog.tableExists(name):
        _declare(spark, name, path, df.schema, keys, n)  # a replay from a new application
    (df.repartition(n, *keys).write.mode("overwrite").format("parquet")
     .bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(name))
    return path


def _claim_path(base: str, version: int) -> str:
    return f"{base.rstrip('/')}/_claim-{int(version):012d}"


def _claim(spark: SparkSession, base: str, version: int) -> None:
    """Create the version's claim file, which one writer only can do."""
    fs, p = _fs(spark, _claim_path(base, version))
    if path_exists(spark, snapshot_path(base, version)):
        raise VersionTaken(f"version {version} of {base} exists")
    try:
        fs.create(p, False).close()
    except Exception as e:
        if fs.exists(p):
            raise VersionTaken(f"version {version} of {base} is taken") from e
        raise


def discard_unfinished(spark: SparkSession, base: str) -> list[int]:
    """Remove what failed writes left under ``base`` (call it while no step runs); the versions."""
    if not path_exists(spark, base):
        return []
    fs, p = _fs(spark, base)
    names = [st.getPath().getName() for st in fs.listStatus(p)]
    versions = {int(n.partition("=")[2]) for n in names if n.startswith("v=")}
    versions |= {int(n.rpartition("-")[2]) for n in names if n.startswith("_claim-")}
    gone = sorted(v for v in versions if not complete(spark, snapshot_path(base, v)))
    for v in gone:
        delete(spark, snapshot_path(base, v))
        delete(spark, _claim_path(base, v))
    return gone


def _declare(spark: SparkSession, name: str, path: str, schema: T_.StructType, keys, n: int) -> None:
    cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    k = ", ".join(f"`{c}`" for c in keys)
    spark.sql(f"CREATE TABLE {name} ({cols}) USING parquet CLUSTERED BY ({k}) "
              f"SORTED BY ({k}) INTO {n} BUCKETS LOCATION '{path}'")


def read_snapshot(spark: SparkSession, base: str, schema: T_.StructType,
                  version: int | None = None, bucket_by=None, buckets: int | None = None) -> DataFrame | None:
    """Read a version (default the latest complete one); None when there is none.

    A bucketed version is declared over its folder once per session, so a new
    application reads it bucket-aware as well.
    """
    v = latest_version(spark, base) if version is None else version
    if v is None:
        return None
    path = snapshot_path(base, v)
    if not bucket_by:
        return spark.read.schema(schema).parquet(path)
    name = _table_name(base, v)
    if not spark.catalog.tableExists(name):
        n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        _declare(spark, name, path, schema, list(bucket_by), n)
    return spark.table(name)


# --- file exports ------------------------------------------------------------------------

def export_scripts(rows: DataFrame, folder: str, name_col: str = "file_name",
                   body_col: str = "body", order_col: str = "procedure_name") -> int:
    """B2: one file per name, ``body`` as it stands; files of the same name are replaced, all others stay.

    Of rows that share a name the last in ``order_col`` is written, as it would have
    overwritten the others. Returns the number of files.
    """
    named = rows.select(F.col(name_col).alias("file_name"), F.col(order_col).alias("order"), F.col(body_col).alias("text"))
    return write_files(one_per_file(named.where("text IS NOT NULL"), order="order"), folder)


def write_processed(scripts: DataFrame, folder: str, prefix: bool = True, order_col: str | None = None) -> int:
    """Cleaned scripts as ``processed_<name>``, byte for byte; other files of the folder stay.

    Of scripts that share a name the last in ``order_col`` (the text's hash, without one) is written.
    ``prefix=False`` when the names already carry it (output of ``flows.process``). Returns the number of files.
    """
    name = F.concat(F.lit(P.PROCESSED_PREFIX), F.col("file_name")) if prefix else F.col("file_name")
    order = F.col(order_col) if order_col else F.xxhash64("text")
    named = scripts.select(name.alias("file_name"), order.alias("order"), "text")
    return write_files(one_per_file(named.where("text IS NOT NULL"), order="order"), folder)


def write_corpus(scripts: DataFrame, path: str) -> None:
    """Script corpus as a parquet table (exact text, the large-scale layout)."""
    scripts.write.mode("overwrite").parquet(path)


def publish(found: DataFrame, folder: str) -> int:
    """Wipe the target and write ``deployed_<proc>.sql`` for every found script, byte for byte; the number of files."""
    return write_files(found.select(F.col("target_file").alias("file_name"), "text"), folder, wipe=True)


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """Read the snapshot at ``path`` when a finished one is there, else build, write and read it."""
    if not complete(spark, path):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def cached_job(spark: SparkSession, root: str, user: str, job: str, build) -> dict:
    """B5 by user and job: {rows, hit, copied}; ``copied`` counts the objects a miss has stored."""
    from urllib.parse import quote
    path = f"{root.rstrip('/')}/user={quote(user, safe='')}/job={quote(job, safe='')}"
    if complete(spark, path):
        return {"rows": spark.read.parquet(path), "hit": True, "copied": 0}
    obs = Observation("cached")
    build().observe(obs, F.count(F.lit(1)).alias("n")).write.mode("overwrite").parquet(path)
    return {"rows": spark.read.parquet(path), "hit": False, "copied": obs.get["n"]}


def apply_edits(base: DataFrame, edits: DataFrame, key: str = "file_name",
                text_col: str = "text", seq: str = "seq") -> DataFrame:
    """Keyed patch: the last edit of a key replaces the stored text."""
    last = first_by(edits.select(key, seq, text_col), [key], seq, last=True) \
        .select(key, F.col(text_col).alias("_edit"), F.lit(True).alias("_hit"))
    joined = base.join(last, key, "left")
    text = F.when(F.col("_hit"), F.col("_edit")).otherwise(F.col(text_col))
    return joined.select(*[text.alias(c) if c == text_col else F.col(c) for c in base.columns])
