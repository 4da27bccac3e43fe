"""Report, licence, object-listing and log operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T


def report_table(reports: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The six assessment metrics of every report, ``N/A`` when absent."""
    return reports.select(key, *T.report_metrics(text_col))


def active_expiry(licences: DataFrame, key: str, now, text_col: str = "text") -> DataFrame:
    """I19 + E8: parsable expiry dates per listing and whether any is after ``now``."""
    dates = T.expiries(text_col)
    return (licences.select(key, dates.alias("_dates"))
            .select(key, F.size("_dates").alias("n_dates"),
                    T.any_after("_dates", now).alias("has_active")))


def list_objects(objects: DataFrame, prefix: str, path_col: str = "path") -> DataFrame:
    """Objects whose key starts with ``prefix``, with their base name.

    ``startswith`` on a column reaches the parquet scan as a pushed filter.
    """
    return (objects.where(F.col(path_col).startswith(prefix))
            .select(*[c for c in objects.columns if c != "content"],
                    T.base_name(path_col).alias("name")))


def any_object(objects: DataFrame, prefix: str, path_col: str = "path") -> DataFrame:
    """One row, ``any_object`` = some key starts with ``prefix``.

    ``limit(1)`` lets every task stop at its first hit.
    """
    hit = objects.where(F.col(path_col).startswith(prefix)).select(F.lit(1).alias("h")).limit(1)
    return hit.agg((F.count(F.lit(1)) > 0).alias("any_object"))


def parse_log(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """``time - LEVEL - message`` lines; other lines keep NULL time and level."""
    pat = "(?s)" + P.LOG_LINE
    line = F.col(line_col)
    ok = line.rlike(pat)
    stamp = F.regexp_extract(line, pat, 1)
    # yyyy-MM-dd HH:mm:ss,SSS read by position (the pattern fixes every width)
    part = lambda a, n: F.substring(stamp, a, n)
    seconds = part(18, 2).cast("decimal(16,6)") + part(21, 3).cast("decimal(16,6)") / 1000
    when = T.ntz_from_parts(part(1, 4), part(6, 2), part(9, 2), part(12, 2), part(15, 2), seconds)
    return lines.select(
        *[c for c in lines.columns if c != line_col],
        F.when(ok, when).alias("log_time"),
        F.when(ok, F.regexp_extract(line, pat, 2)).alias("level"),
        F.when(ok, F.regexp_extract(line, pat, 3)).otherwise(line).alias("message"))


def tail(lines: DataFrame, n: int = P.LOG_TAIL_LINES, order_col: str = "line_no",
         line_col: str = "line") -> DataFrame:
    """The last ``n`` lines of a log after stripping trailing blank lines.

    The whole log is ``strip()``-ped before the split, so blank lines at the
    end do not count and the last line loses trailing blanks. The top-n runs
    as a per-task top-n plus one merge of ``n`` rows per task, and ``order_col`` may
    be a position (struct), so a log is never numbered or sorted for its tail.
    """
    non_blank = F.col(line_col).rlike("[^" + P.PY_SPACE_CHARS + "]")
    last_nb = lines.where(non_blank).agg(F.max(order_col)).scalar()
    kept = lines.where(F.col(order_col) <= last_nb)
    top = kept.orderBy(F.col(order_col).desc()).limit(n)
    is_last = F.col(order_col) == last_nb
    text = F.when(is_last, F.regexp_replace(F.col(line_col), P.PY_SPACE + "+\\z", "")) \
        .otherwise(F.col(line_col))
    return top.select(order_col, text.alias(line_col)).orderBy(order_col)


def step_counts(**frames: DataFrame) -> DataFrame:
    """One row per workflow step with the number of rows it affects."""
    parts = [df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(step).alias("step"), "n_rows")
             for step, df in frames.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
