"""A folder of files, one per row, as a Spark data source: format ``script_files``.

Rows are (file_name, text). Every file has its own name and holds its text byte
for byte, so other tools find ``X.sql`` where they look for it.

A write has two phases. Tasks write their files into folders of their own below a
staging folder beside the target; a task reports its folder and the number of its files. When all
have succeeded, the commit writes that list down in one file, and from then on the export
is decided: ``finish`` empties the target if it is to be wiped and moves the files there in a
second job, which may be repeated at any point. A write that fails before has left only a
staging folder, which the abort removes; what a dead driver leaves is finished or
removed by ``recover``.

Folders are opened through ``pyarrow.fs`` (local or mounted paths, ``file:``, ``s3:``, ``gs:``, ``hdfs:``).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

FORMAT = "script_files"
SCHEMA = "file_name string, text string"
STAGING = "._staging-"
COMMIT, WIPED = "_commit", "_wiped"
READ_BYTES, READ_FILES = 32 << 20, 10_000  # of a task
BATCH_BYTES = 8 << 20


def opened(folder: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a folder."""
    if "://" not in folder and not folder.startswith("file:"):
        return pafs.LocalFileSystem(), folder.rstrip("/")
    uri = folder.replace("s3a://", "s3://", 1) if folder.startswith("s3a://") else folder
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    found, path = pafs.FileSystem.from_uri(uri)
    return found, path.rstrip("/")


def is_there(files: pafs.FileSystem, path: str) -> bool:
    return files.get_file_info(path).type != pafs.FileType.NotFound


def write_bytes(files: pafs.FileSystem, path: str, data: bytes) -> None:
    with files.open_output_stream(path, compression=None) as out:
        out.write(data)


def read_bytes(files: pafs.FileSystem, path: str) -> bytes:
    with files.open_input_stream(path, compression=None) as file:
        return file.read()


def checked(name: str) -> str:
    """A name of a file of the folder itself."""
    if not name or "/" in name or name in (".", ".."):
        raise ValueError(f"{name!r} is not the name of a file")
    return name


@dataclass
class Written(WriterCommitMessage):
    """A task's folder below the staging folder, and the number of its files."""
    part: str
    n: int


class FileWriter(DataSourceArrowWriter):
    def __init__(self, staging: str, wipe: bool):
        self.staging, self.wipe = staging, wipe

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        files, staging = opened(self.staging)
        part, n = f"part-{uuid.uuid4().hex}", 0  # each attempt has its own
        files.create_dir(f"{staging}/{part}", recursive=True)
        for batch in iterator:
            for name, text in zip(*(batch.column(c).to_pylist() for c in ("file_name", "text")), strict=True):
                write_bytes(files, f"{staging}/{part}/{checked(name)}", text.encode())
                n += 1
        return Written(part, n)

    def commit(self, messages: list) -> None:
        files, staging = opened(self.staging)
        files.create_dir(staging, recursive=True)
        parts = [[m.part, m.n] for m in messages if m is not None and m.n]
        write_bytes(files, f"{staging}/{COMMIT}.new", json.dumps({"wipe": self.wipe, "parts": parts}).encode())
        files.move(f"{staging}/{COMMIT}.new", f"{staging}/{COMMIT}")

    def abort(self, messages: list) -> None:
        files, staging = opened(self.staging)
        if is_there(files, staging):
            files.delete_dir(staging)


class Slice(InputPartition):
    def __init__(self, names: list[str]):
        super().__init__(len(names))
        self.names = names


class FileReader(DataSourceReader):
    """Every file of the folder, whatever its name; bytes that are not UTF-8 are replaced."""

    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        files, path = opened(self.folder)
        found = files.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        slices, names, held = [], [], 0
        for info in sorted((i for i in found if i.is_file), key=lambda i: i.base_name):
            names.append(info.base_name)
            held += info.size or 0
            if held >= READ_BYTES or len(names) >= READ_FILES:
                slices.append(Slice(names))
                names, held = [], 0
        return [*slices, Slice(names)]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        files, path = opened(self.folder)
        names, texts, held = [], [], 0
        for name in partition.names:
            names.append(name)
            texts.append(read_bytes(files, f"{path}/{name}").decode(errors="replace"))
            held += len(texts[-1])
            if held >= BATCH_BYTES:
                yield pa.RecordBatch.from_pydict({"file_name": names, "text": texts})
                names, texts, held = [], [], 0
        if names:
            yield pa.RecordBatch.from_pydict({"file_name": names, "text": texts})


class ScriptFiles(DataSource):
    """``spark.read.format("script_files").load(folder)``; writing goes through ``write_files``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FileReader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return FileWriter(self.options["staging"], self.options.get("wipe") == "true")


def _sibling(folder: str) -> str:
    return folder.rstrip("/") + STAGING


def write_files(rows: DataFrame, folder: str, wipe: bool = False) -> int:
    """Write each row of (file_name, text) as a file of ``folder``; the number of files.

    A file of the same name is replaced; other files stay, or go with ``wipe``. Rows hold a name once. A row without a
    name or a text has no file. Either all files come or, if the job fails, none, and nothing goes.
    """
    spark = rows.sparkSession
    spark.dataSource.register(ScriptFiles)
    staging = _sibling(folder) + uuid.uuid4().hex
    rows = rows.select("file_name", "text").where("file_name IS NOT NULL AND text IS NOT NULL")
    writer = rows.write.format(FORMAT).mode("append").option("staging", staging).option("wipe", str(wipe).lower())
    writer.option("path", folder).save()
    return finish(spark, folder, staging)


def _move(files: pafs.FileSystem, source: str, target: str) -> None:
    try:
        files.move(source, target)
    except OSError:  # not every file system replaces a file
        if not is_there(files, target) or not is_there(files, source):
            raise
        files.delete_file(target)
        files.move(source, target)


def move_parts(batches: Iterator[pa.RecordBatch], folder: str, staging: str) -> Iterator[pa.RecordBatch]:
    """Move the files of the given parts to the folder; those that an earlier attempt has moved are there."""
    files, target = opened(folder)
    source = opened(staging)[1]
    for batch in batches:
        for part in batch.column("part").to_pylist():
            for info in files.get_file_info(pafs.FileSelector(f"{source}/{part}", allow_not_found=True)):
                _move(files, info.path, f"{target}/{info.base_name}")
        yield batch


def finish(spark: SparkSession, folder: str, staging: str) -> int:
    """Carry out a decided write; may be repeated. The number of its files."""
    files, path = opened(folder)
    held = opened(staging)[1]
    plan = json.loads(read_bytes(files, f"{held}/{COMMIT}"))
    files.create_dir(path, recursive=True)
    if plan["wipe"] and not is_there(files, f"{held}/{WIPED}"):
        files.delete_dir_contents(path)
        write_bytes(files, f"{held}/{WIPED}", b"")
    if plan["parts"]:
        parts = spark.createDataFrame([tuple(p) for p in plan["parts"]], "part string, n long")
        parts.repartition(len(plan["parts"])).mapInArrow(lambda it: move_parts(it, folder, staging), parts.schema).agg(
            F.count("*")).collect()
    files.delete_dir(held)
    return sum(n for _, n in plan["parts"])


def remove_named(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Remove the named files of the folder; those that an earlier attempt has removed are gone."""
    files, path = opened(folder)
    for batch in batches:
        for name in batch.column("file_name").to_pylist():
            try:
                files.delete_file(f"{path}/{checked(name)}")
            except FileNotFoundError:
                pass
        yield batch.slice(0, 0)


def remove_files(names: DataFrame, folder: str) -> None:
    """Remove the files of a folder that ``names`` holds as ``file_name``; nothing is to be written there meanwhile.

    A local or mounted file system removes them one by one, so the tasks do it. Other stores remove a folder in
    one call or in bulk, which is left to whoever removes the folder.
    """
    if isinstance(opened(folder)[0], pafs.LocalFileSystem):
        found = names.select("file_name")
        found.mapInArrow(lambda it: remove_named(it, folder), found.schema).agg(F.count("*")).collect()


def recover(spark: SparkSession, folder: str) -> list[bool]:
    """Finish the decided writes that a dead driver has left for ``folder``, remove the others (call it while none runs).

    One value per write found: whether it was finished.
    """
    files, path = opened(folder)
    parent, _, name = path.rpartition("/")
    base, done = folder.rstrip("/")[:-len(name)], []
    for info in sorted(files.get_file_info(pafs.FileSelector(parent, allow_not_found=True)), key=lambda i: i.base_name):
        if info.base_name.startswith(name + STAGING):
            done.append(is_there(files, f"{info.path}/{COMMIT}"))
            if done[-1]:
                finish(spark, folder, base + info.base_name)
            else:
                files.delete_dir(info.path)
    return done


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, text) of every file of a folder."""
    spark.dataSource.register(ScriptFiles)
    return spark.read.format(FORMAT).load(folder)
