"""Small document tables with every awkward case, and brute-force rules."""

from __future__ import annotations

import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that results or intermediate tables use; operators must not trip over them.
CLASHING = ("size", "row", "key", "node", "label", "score", "kept", "words", "target", "length", "n", "digest", "spans")
PROSE = "the quick brown fox jumps over the lazy dog while seven wizards brew strange potions in the dark cellar"


def docs(spark, texts, ids=None, sources=None, extra=True):
    ids = list(range(len(texts))) if ids is None else ids
    sources = [f"s{i % 3}" for i in range(len(texts))] if sources is None else sources
    rows = [(i, t, "en", s, None if t is None else len(t)) for i, t, s in zip(ids, texts, sources, strict=True)]
    df = spark.createDataFrame(rows, COLUMNS)
    if extra:
        from pyspark.sql import functions as F
        df = df.withColumns({c: F.lit("x") for c in CLASHING})
    return df


def awkward(long_words=20_000):
    """Texts: null, empty, blanks, short, repeated, other alphabets, and a very long one."""
    many = " ".join(f"w{i % 977} filler{i % 13}" for i in range(long_words // 2))
    return [None, "", " \t\n", "one", "one two three four", PROSE, PROSE, PROSE + " again", "é\U0001F600 ñ 한국어 " + PROSE,
            "\x0b" + PROSE.replace(" ", "  "), many, "x" * 50_000, "the " * 3000]


def words(text):
    return WORD.findall(text or "")


def rows_of(df, *order):
    return [r.asDict() for r in df.orderBy(*order).collect()]
