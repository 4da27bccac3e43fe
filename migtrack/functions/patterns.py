"""Fixed values.

Everything in this module must equal the behaviour of the tracked workflow for
results to match: marker text, status words, file-name conventions, report and
licence patterns, log format. They are stated here once, plainly, in natural
order; the rest of the package refers to them by name.
"""

# --- fixed values: workflow vocabulary -------------------------------------
MARKER = "!!!RESOLVE EWI!!!"
STATUS_SUCCESS = "✅ Success"
STATUS_FAILED = "❌ Failed"
STATUS_UNKNOWN = "❔"
SUCCESS_REASON = "-"
TEST_CREATE = "test_create_procedure"
TEST_EXECUTION = "test_procedure_execution"
TEST_METHODS = ("test_create_procedure_from_file", "test_procedure_execution")
SOURCE_CATALOGUE = "SQLServer"
SOURCE_UPLOAD = "File Upload"
ROUTINE_TYPE_PROCEDURE = "PROCEDURE"
PROCESSED_PREFIX = "processed_"
DEPLOYED_PREFIX = "deployed_"
SCRIPT_EXT = ".sql"
FILE_NOT_FOUND = "--- FILE NOT FOUND ---\nPath: "
LABEL_WIDTH = 50
LOG_TAIL_LINES = 25
NULL_TEXT = "None"

# --- fixed values: patterns --------------------------------------------------
# Parameter block of a CREATE/ALTER PROCEDURE header (flags: ignore case, dot-all).
PARAM_HEADER = r"(?:CREATE|ALTER)\s+(?:PROCEDURE|PROC)\s+.*?(?:\((.*?)\))?\s*(?:AS|BEGIN)"
# Its parts, for searching it in one pass.
HEADER_START = r"(?:CREATE|ALTER)\s+(?:PROCEDURE|PROC)\s+"
HEADER_END = r"(?:AS|BEGIN)"
# Assessment report metrics, first match of each, multi-line mode.
REPORT_METRICS = (
    ("files", r"- Files:\s+(\d+)"),
    ("not_generated", r"- Files Not Generated:\s+(\d+)"),
    ("total_loc", r"- Total lines of code:\s+(\d+)"),
    ("auto_conv_pct", r"- Automatically converted:\s+([\d\.]+%)"),
    ("conv_time", r"- Conversion time:\s+([\d:\.]+)"),
    ("speed_loc_s", r"- Conversion speed:\s+(\d+)\s+lines"),
)
REPORT_MISSING = "N/A"
# Licence listing: every expiry date, parsed month/day/year hour:minute:second.
LICENCE_EXPIRY = r"Expiration date:\s*([0-1]?\d/[0-3]?\d/\d{4}\s+\d{1,2}:\d{2}:\d{2})"
# Application log line: "time - LEVEL - message", time like 2024-01-31 10:20:30,123.
LOG_LINE = r"^(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3}) - ([A-Z]+) - (.*)$"

# --- character classes giving Python str semantics in Java regex -------------
# str.isspace(): the characters Python strips and splits on.
PY_SPACE_CHARS = (
    "\\t\\n\\x0b\\x0c\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a"
    "\\u2028\\u2029\\u202f\\u205f\\u3000"
)
PY_SPACE = f"[{PY_SPACE_CHARS}]"
# isspace() characters that are not line breaks (blank-line test).
PY_BLANK_CHARS = "\\t\\x1f \\xa0\\u1680\\u2000-\\u200a\\u202f\\u205f\\u3000"
# Python's \w for str (isalnum() or "_") and the word boundary built on it; Java's
# own \b differs at combining marks and at numerals such as superscripts.
PY_WORD = "[\\p{L}\\p{N}_]"
PY_BOUNDARY = f"(?:(?<={PY_WORD})(?!{PY_WORD})|(?<!{PY_WORD})(?={PY_WORD}))"
# str.splitlines() boundaries other than "\n" (CRLF first, as one break).
PY_LINE_BREAK_CHARS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
