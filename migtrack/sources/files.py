"""File sources: uploaded scripts, script folders, object listings, log files."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def parse_uploads(files: DataFrame, dbname: str, schema_name: str,
                  path_col: str = "path", content_col: str = "content", carry=(),
                  suffix: str = P.SCRIPT_EXT) -> DataFrame:
    """A3: uploaded files -> catalogue rows; files of another type than ``suffix`` are left out.

    Name = file stem, body = UTF-8 text (BOM kept, no newline translation),
    parameters from the CREATE/ALTER header. A file that is not valid UTF-8 is
    left out (see ``upload_rejects``). ``carry`` columns are passed through.
    """
    text = F.try_validate_utf8(F.col(content_col).cast("string"))
    decoded = files.where(F.col(path_col).endswith(suffix)).select(*carry, F.col(path_col).alias("_path"), text.alias("_text")) \
        .where(F.col("_text").isNotNull())
    return decoded.select(*carry,
        F.lit(P.SOURCE_UPLOAD).alias("source"), F.lit(dbname).alias("dbname"),
        F.lit(schema_name).alias("schema_name"),
        T.stem(T.base_name("_path")).alias("procedure_name"),
        F.col("_text").alias("procedure_definition"),
        T.param_block("_text").alias("parameters"))


def upload_rejects(files: DataFrame, path_col: str = "path", content_col: str = "content",
                   suffix: str = P.SCRIPT_EXT) -> DataFrame:
    """A3: uploaded scripts that could not be decoded (reported, not loaded); other types of files are not uploads."""
    bad = F.try_validate_utf8(F.col(content_col).cast("string")).isNull()
    return files.where(F.col(path_col).endswith(suffix) & bad).select(T.base_name(path_col).alias("file_name"))


def read_uploads(spark: SparkSession, path: str, dbname: str, schema_name: str, glob: str = "*.sql") -> DataFrame:
    """A3: read the script files of a folder of uploads (one row per file) and parse them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path).select("path", "content")
    return parse_uploads(files, dbname, schema_name)


def normalise_script_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """A4: ``utf-8-sig`` text-mode read: BOM dropped, CRLF/CR -> LF."""
    return df.withColumn(text_col, T.universal_newlines(T.strip_bom(text_col)))


def read_scripts(spark: SparkSession, folder: str, glob: str = "*.sql") -> DataFrame:
    """A4: every matching file of a folder as (file_name, text), one row per file.

    Invalid UTF-8 is replaced rather than failing the job.
    """
    raw = (spark.read.text(folder, wholetext=True, pathGlobFilter=glob)
           .select(F.col("_metadata.file_name").alias("file_name"),
                   F.make_valid_utf8("value").alias("text")))
    return normalise_script_text(raw)


def list_object_files(spark: SparkSession, root: str, prefix: str = "") -> DataFrame:
    """A7 source: (key, path) of the objects below ``root`` whose key starts with ``prefix``; contents are not read.

    A key is the path relative to ``root``, as in an object store. The prefix goes into the
    listing: only its longest folder is listed, and there only what begins with the rest. Names that begin with ``_`` or
    ``.`` are hidden, as in any Spark source. A prefix that nothing has gives no rows.
    """
    base = root.rstrip("/")
    begun = re.sub(r"([\\*?\[\]{}])", r"\\\1", prefix)
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    try:
        found = reader.load(f"{base}/{begun}*" if prefix else base)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "key string, path string")
    inside = "/" + re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:", "", base).strip("/") + "/"  # the file system may add its name before it
    return found.select(F.substr("path", F.locate(inside, F.col("path")) + len(inside)).alias("key"), "path") \
        .where(~F.col("key").rlike("(^|/)[_.]"))


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """A8 source: log lines with their position, bad bytes replaced.

    Lines are read in parallel splits; ``pos`` (file, split start, row within
    the split) orders them as they stand, without a pass over the log.
    """
    pos = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                   F.monotonically_increasing_id().alias("row"))
    return spark.read.text(path).select(pos.alias("pos"), F.make_valid_utf8("value").alias("line"))


def number_lines(lines: DataFrame) -> DataFrame:
    """(line_no, line) from positions: a sort of the whole log, for those who need the numbers."""
    from ..operators.results import assign_ids
    flat = lines.select("line", *[F.col(f"pos.{c}").alias(f"_{c}") for c in ("file", "block", "row")])
    numbered = assign_ids(flat, ["_file", "_block", "_row"], id_col="_line_no", unique=True)
    return numbered.select(F.col("_line_no").cast("bigint").alias("line_no"), "line")
