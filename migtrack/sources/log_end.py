"""The end of a log as a Spark data source: format ``log_end`` reads the last bytes of a folder's files.

Rows are (file, start, row, line): the lines whose first byte is in the last ``bytes`` of
the files in path order, cut at line breaks. A log of any size costs its listing and that many bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import patterns as P
from ..operators import reports as R
from .script_files import opened

FORMAT = "log_end"
SCHEMA = "file string, start long, row long, line string"
FIRST_BYTES = 1 << 16
RANGE_BYTES = 16 << 20   # of a task
STEP = 1 << 16


class Range(InputPartition):
    """The lines of a file that begin in [start, end)."""

    def __init__(self, path: str, start: int, end: int):
        super().__init__((path, start))
        self.path, self.start, self.end = path, start, end


def lines_of(data: bytes) -> list[str]:
    """Lines as Spark's text source cuts them; a break at the end begins no line."""
    lines = data.replace(b"\r\n", b"\n").replace(b"\r", b"\n").split(b"\n")
    return [x.decode(errors="replace") for x in (lines if lines[-1] else lines[:-1])]


class EndReader(DataSourceReader):
    def __init__(self, folder: str, size: int):
        self.folder, self.size = folder, size

    def files(self) -> list[pafs.FileInfo]:
        """The log files in path order, empty and hidden ones left out."""
        files, path = opened(self.folder)
        info = files.get_file_info(path)
        found = [info] if info.is_file else files.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        shown = [i for i in found if i.is_file and i.size and (i is info or i.base_name[0] not in "._")]
        return sorted(shown, key=lambda i: i.path)

    def partitions(self) -> list[InputPartition]:
        left, out = self.size, []
        for info in reversed(self.files()):
            first = max(0, info.size - left)
            out += [Range(info.path, a, min(a + RANGE_BYTES, info.size)) for a in range(first, info.size, RANGE_BYTES)]
            left -= info.size - first
            if not left:
                break
        return out or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        with opened(self.folder)[0].open_input_file(partition.path) as file:
            at = max(0, partition.start - 1)
            file.seek(at)
            data = file.read(partition.end - at)
            if partition.start:  # from the first break on, which may be the byte before the range
                data = data[data.find(b"\n") + 1:] if b"\n" in data else b""
            while data and not data.endswith(b"\n"):  # the last line goes on past the range
                more = file.read(STEP)
                cut = more.find(b"\n") + 1
                data += more[:cut] if cut else more
                if cut or not more:
                    break
        lines = lines_of(data)
        n = len(lines)
        yield pa.RecordBatch.from_pydict({"file": [partition.path] * n, "start": [partition.start] * n, "row": list(range(n)), "line": lines},
                                         pa.schema([("file", pa.string()), ("start", pa.int64()), ("row", pa.int64()), ("line", pa.string())]))


class LogEnd(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return EndReader(self.options["path"], int(self.options.get("bytes", FIRST_BYTES)))


def read_end(spark: SparkSession, path: str, size: int) -> DataFrame:
    """(pos, line) of the lines that begin in the last ``size`` bytes of a log file or folder."""
    spark.dataSource.register(LogEnd)
    rows = spark.read.format(FORMAT).option("bytes", size).load(path)
    return rows.select(F.struct("file", "start", "row").alias("pos"), "line")


def tail_file(spark: SparkSession, path: str, n: int = P.LOG_TAIL_LINES, first_bytes: int = FIRST_BYTES) -> DataFrame:
    """G3 on files: the last ``n`` lines after stripping trailing blank ones, from the end backwards.

    Reads the last ``first_bytes``, then 8 times as much, until they hold the tail or the log is read.
    """
    total = sum(i.size for i in EndReader(path, 0).files())
    size = first_bytes
    while True:
        found = R.tail(read_end(spark, path, size), n, order_col="pos")
        rows = found.collect()  # at most n
        if len(rows) == n or size >= total:
            return spark.createDataFrame(rows, found.schema)
        size *= 8
