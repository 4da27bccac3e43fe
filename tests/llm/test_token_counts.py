import random

import pyarrow as pa
import sentencepiece
from helpers import awkward, docs, rows_of

from migtrack.llm import token_counts as C


def test_counts_equal_the_library_on_whole_texts(spark):
    texts = awkward() + ["a  b ", "▁▁ a▁b ", "<s> </s> <unk>", "\x00null"]
    got = rows_of(C.token_counts(docs(spark, texts)), "doc_id")
    sp = sentencepiece.SentencePieceProcessor(model_file=C.MODEL)
    assert [(r["n_bytes"], r["n_tokens"]) for r in got] == [
        (len((t or "").encode()), len(sp.encode(t or ""))) for t in texts]
    assert [r["over_limit"] for r in got] == [r["n_tokens"] > 4096 for r in got]
    assert any(r["over_limit"] for r in got)


def test_segments_add_up():
    sp, pairs, rng = C.encoder(C.MODEL), C.neighbours(C.MODEL), random.Random(4)
    inside = 0
    for alphabet in ("abé▁ .\n\t🙂The ", "漢字仮名交じり文の例、한국어テスト", "qXzJ0+/wKvB9=", "аб🙂é漢x\x00\u0301 \u3000"):
        for _ in range(1000):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80)))
            parts, inner = C.segments(text, pairs, 5)
            inside += inner
            assert sum(len(x) for x in sp.encode(parts)) - inner == len(sp.encode(text))
    assert inside > 1000


def test_a_long_text_is_many_calls(monkeypatch):
    calls = []

    class Counted:
        def __init__(self, sp):
            self.sp = sp

        def encode(self, parts, **kw):
            calls.append(sum(len(x.encode()) for x in parts))
            return self.sp.encode(parts, **kw)

    sp, pairs = C.encoder(C.MODEL), C.neighbours(C.MODEL)
    monkeypatch.setattr(C, "encoder", lambda model: Counted(sp))
    monkeypatch.setattr(C, "neighbours", lambda model: pairs)
    monkeypatch.setattr(C, "BATCH_BYTES", 50_000)
    rng = random.Random(8)
    texts = ["".join(rng.choice("漢字仮名交じり文の例") for _ in range(200_000)), "some words " * 40_000, ""]
    batch = pa.RecordBatch.from_arrays([pa.array([1, 2, 3], pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    got = next(C.count_batches(iter([batch]))).to_pydict()
    assert max(calls) < 50_000 + 3 * 4 * C.SEGMENT_CHARS and len(calls) > 15
    assert got["n_tokens"] == [len(sp.encode(t)) for t in texts]


def test_empty_table_repeats_and_null_ids(spark):
    assert C.token_counts(docs(spark, [])).count() == 0
    got = rows_of(C.token_counts(docs(spark, ["same", "same", None], ids=[None, None, 3])), "doc_id")
    assert [r["doc_id"] for r in got] == [None, None, 3] and got[0] == got[1]
