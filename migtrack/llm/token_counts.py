"""Operator 1: token counts by batch encoding in an Arrow function.

Texts leave the JVM as Arrow batches, the library encodes them in calls of about
``BATCH_BYTES`` each, and only lengths come back. A long text is first split
where no piece of the vocabulary can span the cut, at a space or, where none is near,
between two characters that no piece holds in a row (as in texts without spaces), so that its
parts' counts add up to the count of the whole text, and its parts go into as many calls as they
fill. Only a stretch without any such place (one character repeated, say) stays whole.

Cases: null text counts as empty (0 bytes, 0 tokens); repeated rows and null
doc_id each give their own row; an empty table gives no rows; other columns of
the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import public_tokenizers
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

MODEL = public_tokenizers.path("piece_bpe_32k.model")
BATCH_BYTES = 1 << 20
SEGMENT_CHARS = 2000
SPACE_PIECE = "▁"  # how the vocabulary writes a space
SCHEMA = "doc_id long, n_bytes long, n_tokens long"


@lru_cache(maxsize=2)
def encoder(model: str) -> sentencepiece.SentencePieceProcessor:
    """The loaded model; raises unless a space is always a safe place to cut.

    A cut is safe when no piece holds a space after another character: a merge
    across the cut would need such a piece. The part after the cut gets the
    space back as the prefix that the library puts before every text.
    """
    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    for i in range(sp.get_piece_size()):
        if SPACE_PIECE in sp.id_to_piece(i).lstrip(SPACE_PIECE):
            raise ValueError(f"{model}: a piece spans a space, texts can't be split")
    if sp.decode(sp.encode("  a  b ")) != "  a  b ":
        raise ValueError(f"{model}: it changes blanks, texts can't be split")
    return sp


@lru_cache(maxsize=2)
def neighbours(model: str) -> frozenset[tuple[str, str]]:
    """The pairs of characters that some piece holds in a row."""
    sp = encoder(model)
    plain = (sp.id_to_piece(i) for i in range(sp.get_piece_size())
             if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))
    return frozenset(pair for piece in plain for pair in zip(piece, piece[1:], strict=False))


def cut_after(text: str, low: int, limit: int, pairs: frozenset[tuple[str, str]]) -> tuple[int, bool] | None:
    """The first safe place from ``low`` on, and whether it is a space; spaces go first within ``limit`` characters.

    A space is safe between other characters. A place inside a word is safe if no piece holds the
    characters around it, nor a space and the second: the part after it gets one token more, its prefix.
    """
    def space(i):
        return text[i] == " " and i + 1 < len(text) and text[i - 1] not in " ▁" and text[i + 1] not in " ▁"

    cut = text.find(" ", low, low + limit)
    while cut != -1 and not space(cut):
        cut = text.find(" ", cut + 1, low + limit)
    if cut != -1:
        return cut, True
    for i in range(low, len(text)):
        if space(i):
            return i, True
        if text[i] not in " ▁" and text[i - 1] not in " ▁" and (text[i - 1], text[i]) not in pairs and (SPACE_PIECE, text[i]) not in pairs:
            return i, False
    return None


def segments(text: str, pairs: frozenset[tuple[str, str]], limit: int = SEGMENT_CHARS) -> tuple[list[str], int]:
    """The parts of a text, without the spaces they are cut at, and how many of the cuts are inside a word."""
    out, start, inner = [], 0, 0
    while len(text) - start > limit:
        cut = cut_after(text, start + limit, limit, pairs)
        if cut is None:
            break
        place, at_space = cut
        out.append(text[start:place])
        start = place + at_space
        inner += not at_space
    out.append(text[start:])
    return out, inner


def count_batches(batches: Iterator[pa.RecordBatch], model: str = MODEL) -> Iterator[pa.RecordBatch]:
    sp, pairs = encoder(model), neighbours(model)
    for batch in batches:
        texts = batch.column("text").to_pylist()
        counts, sizes = [0] * len(texts), [0] * len(texts)
        parts, owners, held = [], [], 0

        def flush():
            for row, ids in zip(owners, sp.encode(parts, num_threads=1), strict=True):
                counts[row] += len(ids)
            parts.clear()
            owners.clear()

        for row, text in enumerate(texts):
            sizes[row] = len(text.encode())
            pieces, inner = segments(text, pairs)
            counts[row] -= inner
            for part in pieces:
                parts.append(part)
                owners.append(row)
                held += sizes[row] if len(pieces) == 1 else len(part.encode())
                if held >= BATCH_BYTES:  # also inside a text: a long one is many calls
                    flush()
                    held = 0
        flush()
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(counts, pa.int64())],
            names=["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, model: str = MODEL, max_tokens: int = 4096) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document; one pass, no shuffle."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    counted = texts.mapInArrow(lambda it: count_batches(it, model), SCHEMA)
    return counted.withColumn("over_limit", F.col("n_tokens") > max_tokens)
