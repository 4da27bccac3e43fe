"""Column functions for script text, names and reports.

Every function takes and returns a ``Column`` built only from Spark SQL
functions, so a whole cleanup is one projection inside whole-stage codegen:
no Python UDF, no shuffle. Python ``re`` semantics are kept where they differ
from Java regex: ``[^\\n]`` instead of ``.``, explicit whitespace classes for
``str.isspace``/``str.splitlines``, ``(?d)`` so ``$`` only knows ``\\n``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def java_quote(s: str) -> str:
    """Literal text as a Java regex: backslash before every non-alphanumeric."""
    return "".join(ch if ch.isalnum() else "\\" + ch for ch in s)


def java_replacement(s: str) -> str:
    """Literal replacement text for ``regexp_replace`` (``$`` and ``\\`` escaped)."""
    return s.replace("\\", "\\\\").replace("$", "\\$")


def py_strip(c) -> Column:
    """``str.strip()``: drop ``isspace`` characters at both ends."""
    return F.regexp_extract(_c(c), f"(?s)\\A{P.PY_SPACE}*+(.*[^{P.PY_SPACE_CHARS}])", 1)


def norm_ws(c) -> Column:
    """Whitespace runs to one blank, then strip."""
    return F.trim(F.regexp_replace(_c(c), f"{P.PY_SPACE}+", " "))


def normalise_breaks(c) -> Column:
    """Every ``str.splitlines`` boundary becomes ``\\n`` (CRLF first, as one break)."""
    c = _c(c)
    singles = P.PY_LINE_BREAK_CHARS
    # byte searches first: most texts hold only "\n", and translate is the slow part
    found = reduce(lambda a, b: a | b, [c.contains(ch) for ch in singles])
    fixed = F.translate(F.replace(c, F.lit("\r\n"), F.lit("\n")), singles, "\n" * len(singles))
    return F.when(found, fixed).otherwise(c)


def universal_newlines(c) -> Column:
    """Text-mode read: ``\\r\\n`` and ``\\r`` become ``\\n``."""
    c = _c(c)
    return F.when(c.contains("\r"), F.translate(F.replace(c, F.lit("\r\n"), F.lit("\n")), "\r", "\n")) \
        .otherwise(c)


def strip_bom(c) -> Column:
    """``utf-8-sig`` decoding: one leading byte-order mark is dropped."""
    c = _c(c)
    return F.when(c.startswith("\ufeff"), F.substring(c, 2, 2147483647)).otherwise(c)


def trim_final_break(c) -> Column:
    """Drop one final ``\\n`` (``splitlines`` yields no empty last piece)."""
    c = _c(c)
    return F.when(c.endswith("\n"), F.substring(c, F.lit(1), F.length(c) - 1)).otherwise(c)


# --- I1..I5: script cleanup -------------------------------------------------

def strip_comments(c) -> Column:
    """``--`` to end of line first, then ``/* ... */`` across lines."""
    c = _c(c)
    # the byte searches skip the regex for texts without any comment opener
    no_line = F.when(c.contains("--"), F.regexp_replace(c, "--[^\\n]*", "")).otherwise(c)
    return F.when(no_line.contains("/*"), F.regexp_replace(no_line, "(?s)/\\*.*?\\*/", "")) \
        .otherwise(no_line)


def rename_schema(c, source: str, target: str, quote: bool = False) -> Column:
    """Whole-word, case-insensitive rename. ``source`` is a regex unless ``quote``."""
    src = java_quote(source) if quote else source
    b = P.PY_BOUNDARY  # joined as text, like the original: "a|b" means (\ba)|(b\b)
    return F.regexp_replace(_c(c), f"(?iu){b}{src}{b}", java_replacement(target))


def strip_dollar(c) -> Column:
    """Remove every ``$$``."""
    return F.replace(_c(c), F.lit("$$"), F.lit(""))


def _drop_marked_pattern(marker: str) -> str:
    # One "unit" is "\n" + line content. A marker line, then the blank lines
    # after it (kept, captured as $1), then the next non-blank line, which is
    # dropped unless it holds a marker itself (then it starts the next match).
    m = java_quote(marker)
    blank_or_nl = f"[{P.PY_BLANK_CHARS}\\n]"
    non_blank = f"[^{P.PY_BLANK_CHARS}\\n]"
    return (
        f"\\n[^\\n]*{m}[^\\n]*"
        f"((?:\\n{blank_or_nl}*)?)"
        f"(?:\\n(?![^\\n]*{m})(?=[^\\n]*{non_blank})[^\\n]*"
        f"|(?=\\n[^\\n]*{m})"
        f"|\\z)"
    )


def drop_marked(c, marker: str = P.MARKER) -> Column:
    """I4: drop each marker line and the next non-blank line after it.

    Stateless restatement of the line loop: a line goes when it holds the
    marker, or when it is non-blank and the previous non-blank line held it.
    Lines are ``splitlines`` lines, re-joined by ``\\n`` (no final break).
    Written as one regex replacement over the text, so the cost is linear in
    the text and the expression stays inside codegen.
    """
    text = trim_final_break(normalise_breaks(c))
    units = F.concat(F.lit("\n"), text)
    kept = F.substring(F.regexp_replace(units, _drop_marked_pattern(marker), "$1"), 2, 2147483647)
    return F.when(text.contains(marker), kept).otherwise(text)


def clean_script(c, source_schema: str, target_schema: str) -> Column:
    """I1 -> I2 -> I3 -> I4, in that order."""
    c = strip_comments(c)
    c = rename_schema(c, source_schema, target_schema)
    c = strip_dollar(c)
    return drop_marked(c)


# --- I6..I16: names, headers, descriptors ------------------------------------

def _py_regex(pattern: str) -> str:
    # Python's \s for str is str.isspace(); Java's differs at \x1c-\x1f.
    return pattern.replace("\\s", P.PY_SPACE)


def param_block(c) -> Column:
    """Parameter text of a CREATE/ALTER PROC header, whitespace-normalised; '' if none.

    What ``PARAM_HEADER`` finds, in one pass over the text: the first header
    start, the first end word after it, the first ``(`` before that, and from
    there to the first ``)`` that only blanks separate from an end word. (A
    backtracking search of the whole pattern is quadratic in the number of brackets.)
    """
    flags, end = "(?isu)", P.HEADER_END
    rest = F.regexp_extract(_c(c), flags + _py_regex(P.HEADER_START) + "(.*)", 1)
    before = F.regexp_extract(rest, flags + "^(.*?)" + end, 1)
    at = F.instr(before, "(")
    inside = F.regexp_extract(F.substring(rest, at + 1, F.length(rest)), flags + "^(.*?)\\)" + P.PY_SPACE + "*+" + end, 1)
    return norm_ws(F.when(at > 0, inside).otherwise(F.when(_c(c).isNotNull(), "")))


def safe_name(c) -> Column:
    """I8: every character that is not a letter, digit, ``_`` or ``-`` becomes ``_``."""
    return F.regexp_replace(_c(c), "[^\\p{L}\\p{N}_-]", "_")


def stem(c) -> Column:
    """``os.path.splitext(name)[0]`` for a base name."""
    return F.regexp_replace(_c(c), "(?s)\\A(.*[^.].*)\\.[^.]*\\z", "$1")


def base_name(c) -> Column:
    """``os.path.basename`` of a ``/`` path."""
    return F.substring_index(_c(c), "/", -1)


def proc_from_file(c) -> Column:
    """Text after the last ``_`` of ``*_X.sql``, else the stem of ``X.sql``; NULL = reject."""
    c = _c(c)
    with_us = F.regexp_extract(c, "(?d)^.*_([^.]+)\\.sql$", 1)
    plain = F.regexp_extract(c, "(?d)^([^.]+)\\.sql$", 1)
    return F.coalesce(F.nullif(with_us, F.lit("")), F.nullif(plain, F.lit("")))


def _drop_last4(c: Column) -> Column:
    return F.substring(c, F.lit(1), F.greatest(F.length(c) - 4, F.lit(0)))


def unprefixed(c) -> Column:
    """Name without ``.sql`` (last four characters) and ``processed_``; NULL if absent."""
    name = _drop_last4(_c(c))
    return strip_processed(name)


def strip_processed(c) -> Column:
    """``processed_`` removed from the front; NULL when the text does not start with it."""
    c = _c(c)
    pat = "(?d)^" + P.PROCESSED_PREFIX + "(.*)$"
    return F.when(c.rlike(pat), F.regexp_extract(c, pat, 1))


def label(file_name, status) -> Column:
    """File name left-justified to 50, `` [status]``, then ``processed_`` removed."""
    f = _c(file_name)
    padded = F.when(F.length(f) < P.LABEL_WIDTH, F.rpad(f, P.LABEL_WIDTH, " ")).otherwise(f)
    raw = F.concat(padded, F.lit(" ["), F.coalesce(_c(status), F.lit(P.NULL_TEXT)), F.lit("]"))
    return strip_processed(raw)


def unlabel(c) -> Column:
    """The file name back from a label (text before the first two blanks + ``[``)."""
    return py_strip(F.split(_c(c), "  \\[", 2).getItem(0))


def param_desc(mode, name, data_type, char_length) -> Column:
    """``MODE NAME TYPE`` plus ``(len)`` when a length is known; NULL prints as None."""
    n = F.lit(P.NULL_TEXT)
    length = _c(char_length)
    suffix = F.when(length.isNotNull(), F.concat(F.lit("("), length.cast("string"), F.lit(")"))) \
        .otherwise(F.lit(""))
    return F.concat(F.coalesce(_c(mode), n), F.lit(" "), F.coalesce(_c(name), n), F.lit(" "),
                    F.coalesce(_c(data_type), n), suffix)


def param_count(params) -> Column:
    """Commas + 1, or 0 when the text is blank or NULL."""
    p = F.coalesce(_c(params), F.lit(""))
    return F.when(py_strip(p) == "", F.lit(0)).otherwise(F.size(F.split(p, ",", -1)))


def call_text(name, params) -> Column:
    """``name(NULL, NULL, ...)`` with one NULL per declared parameter."""
    args = F.array_join(F.array_repeat(F.lit("NULL"), param_count(params)), ", ")
    return F.concat(F.coalesce(_c(name), F.lit(P.NULL_TEXT)), F.lit("("), args, F.lit(")"))


def bare_name(c) -> Column:
    """A trailing ``(...)`` removed from a name."""
    return F.regexp_replace(_c(c), "(?d)\\(.*\\)$", "")


def export_body(c) -> Column:
    """I16: stripped definition plus one newline, as written to the export file."""
    return F.concat(py_strip(c), F.lit("\n"))


# --- I17..I22: lines, reports, times, names, outcomes ------------------------

def script_lines(c) -> Column:
    """I17 helper: lines of a text as an array (one final ``\\n`` does not add a line)."""
    return F.split(trim_final_break(_c(c)), "\n", -1)


def report_metric(c, pattern: str) -> Column:
    """First match of ``pattern`` (group 1), or ``N/A``."""
    got = F.regexp_extract(_c(c), "(?mU)" + pattern, 1)
    return F.coalesce(F.nullif(got, F.lit("")), F.lit(P.REPORT_MISSING))


def report_metrics(c) -> list[Column]:
    """The six report metrics as named columns."""
    return [report_metric(c, pat).alias(name) for name, pat in P.REPORT_METRICS]


def ntz_from_parts(year, month, day, hour, minute, second) -> Column:
    """A ``timestamp_ntz`` from text or number parts, NULL when not a valid time.

    Built without any time-zone conversion, so the session zone does not
    matter. Minute and second must be below 60 and the year at least 1, as for
    Python ``datetime``.
    """
    y, mo, d, h, mi, sec = [_c(x).cast("int") if i < 5 else _c(x).cast("decimal(16,6)")
                            for i, x in enumerate((year, month, day, hour, minute, second))]
    ok = (mi < 60) & (sec < 60) & (y >= 1)
    return F.when(ok, F.try_make_timestamp_ntz(years=y, months=mo, days=d, hours=h, mins=mi, secs=sec))


_DATE_PARTS = "(?U)^(\\d+)/(\\d+)/(\\d+)\\s+(\\d+):(\\d+):(\\d+)$"


def _expiry_time(x: Column) -> Column:
    parts = [F.regexp_extract(x, _DATE_PARTS, i) for i in range(1, 7)]
    ascii_digits = ~x.rlike("(?U)[^0-9/:\\s]")  # strptime reads ASCII digits only
    return F.when(ascii_digits, ntz_from_parts(parts[2], parts[0], parts[1], parts[3], parts[4], parts[5]))


def expiries(c) -> Column:
    """Every parsable expiry date in a text, as ``timestamp_ntz``; bad dates skipped.

    Each match of the licence pattern is read as month/day/year hour:minute:second
    (``%m/%d/%Y %H:%M:%S``); impossible dates (month 13, 31 April, hour 24) give NULL
    and are left out.
    """
    found = F.regexp_extract_all(_c(c), F.lit("(?U)" + P.LICENCE_EXPIRY), F.lit(1))
    return F.filter(F.transform(found, _expiry_time), lambda t: t.isNotNull())


def any_after(dates, now) -> Column:
    """Any date later than ``now``; an empty list is False."""
    now_c = now if isinstance(now, Column) else F.lit(now).cast("timestamp_ntz")
    return F.coalesce(F.exists(_c(dates), lambda t: t > now_c), F.lit(False))


def utc_ms(c) -> Column:
    """Timestamp cut (not rounded) to milliseconds, as ``timestamp_ntz``.

    Plain interval arithmetic on the value, no time-zone conversion.
    """
    c = _c(c).cast("timestamp_ntz")
    sub_ms = (F.date_part(F.lit("SECOND"), c) * 1000000 % 1000) / 1000000
    return c - F.make_dt_interval(secs=sub_ms)


def qualify(db, schema, proc) -> Column:
    """``db.schema.proc``; NULL parts print as None."""
    n = F.lit(P.NULL_TEXT)
    return F.concat_ws(".", F.coalesce(_c(db), n), F.coalesce(_c(schema), n),
                       F.coalesce(_c(proc), n))


def unqualify(c) -> Column:
    """Split at the first two dots (array of at most three parts)."""
    return F.split(_c(c), "\\.", 3)


def outcome_status(error) -> Column:
    """Success when no error was raised."""
    return F.when(_c(error).isNull(), F.lit(P.STATUS_SUCCESS)).otherwise(F.lit(P.STATUS_FAILED))


def outcome_reason(error) -> Column:
    """``-`` for a success, else the error text."""
    return F.coalesce(_c(error), F.lit(P.SUCCESS_REASON))
