import hashlib
import math
import random
import re

from helpers import CLASHING, awkward, docs, rows_of

from migtrack.llm import pii as P


def luhn(number):
    total = 0
    for i, c in enumerate(reversed(number)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        number = re.sub("[^0-9]", "", m[0])
        if 14 <= len(number) <= 19 and luhn(number):
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return ",".join(f"{P.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_base_spans_on_random_texts(spark):
    rng = random.Random(5)
    texts = awkward() + ["".join(rng.choice("0123456789.. -+@()aB\U0001F600é_%\n") for _ in range(rng.randint(0, 60)))
                         for _ in range(2500)]
    texts += ["a@b.co_x@d.ef", "x@" * 2000, "1.2.3.4.5.6.7.8", "a" * 60_000 + "@", "1" * 50_000, "a@" + "b." * 20_000 + "c",
              "+1" + " " * 20_000, "000255.0.00.1 4111 1111-1111 1111", "4111111111111111, +1 (012) 555-0100"]
    got = rows_of(P.digest(P.findings(docs(spark, texts))), "doc_id")
    for text, r in zip(texts, got, strict=True):
        want = base(text)
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), (text[:80], r["spans"][:200])
        kinds = [s.split(":")[0] for s in want.split(",") if s]
        assert [r[f"n_{k}"] for k in P.KINDS[:4]] == [kinds.count(k) for k in P.KINDS[:4]]
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))


REVEALING = [f"met Zebulon Quirke zeb@x.org near the old mill {i}" for i in range(4)]
PLAIN = [f"the old mill near the river was met by many {i}" for i in range(60)]


def test_terms_that_occur_only_with_a_value_are_spans(spark):
    got = rows_of(P.digest(P.findings(docs(spark, REVEALING + PLAIN))), "doc_id")
    assert {r["spans"] for r in got[:4]} == {"term:4:11,term:12:18,email:19:28"}
    assert {r["spans"] for r in got[4:]} == {""}
    few = rows_of(P.digest(P.findings(docs(spark, REVEALING[:2] + PLAIN))), "doc_id")
    assert {r["spans"] for r in few[:2]} == {"email:19:28"}  # too few documents to tell


def test_terms_of_the_whole_document_are_counted_and_marked(spark):
    """Terms far from the value, on other lines, beside a number, quoted, with digits and inner punctuation."""
    far = "the old mill near the river " * 8
    text = ('"Zebulon" lives here\n' + far + "in 2012 mail zeb@x.org\n" + far + "(O'Quirke-Vane) has case K7/44-21, says Zebulon's Zebulon.\n")
    shared = "the old mill near the river lives here mail has case says in 2012"
    got = rows_of(P.digest(P.findings(docs(spark, [text] * 4 + [shared] * 60))), "doc_id")
    want = [("email", m.start(), m.end()) for m in re.finditer("zeb@x.org", text)]
    for word in (r"Zebulon(?!')", "Zebulon's", "O'Quirke-Vane", "44-21"):
        want += [("term", m.start(), m.end()) for m in re.finditer(word, text)]
    want = ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(want, key=lambda x: x[1]))
    assert {r["spans"] for r in got[:4]} == {want} and {r["spans"] for r in got[4:]} == {""}


def test_parts_of_a_value_are_no_terms(spark):
    texts = ["write to <zeb.quirke@x.org>, or +1 (012) 555-0100, card 4111 1111 1111 1111."] * 4 + ["write to or card"] * 60
    got = rows_of(P.digest(P.findings(docs(spark, texts))), "doc_id")
    assert {",".join(s.split(":")[0] for s in r["spans"].split(",")) for r in got[:4]} == {"email,phone,card"}


def test_disclosure_is_the_share_of_information(spark):
    texts = REVEALING + PLAIN + ["Zebulon was here"] * 2
    df = docs(spark, texts)
    scan = P.scanned(df)
    base_rows = P.base_spans(scan)
    told = {r["term"]: r["disclosed"] for r in P.disclosing(df, scan, P.context_terms(base_rows), disclosure=0.0).collect()}
    n = len(texts)
    assert math.isclose(told["quirke"], 1.0)
    assert math.isclose(told["zebulon"], math.log2(4 * n / (4 * 6)) / math.log2(n / 4))


def test_sanitised_text(spark):
    df = docs(spark, REVEALING + PLAIN + [None, "card 4111111111111111 ip 10.0.0.1"])
    out = P.sanitised(df)
    assert out.columns == df.columns and set(CLASHING) < set(out.columns)
    got = [r["text"] for r in out.orderBy("doc_id").collect()]
    assert got[0] == "met   [email] near the old mill 0"
    assert got[4:64] == PLAIN and got[64] is None and got[65] == "card [card] ip [ip]"


def test_repeated_rows_empty_table_and_hot_value(spark):
    assert P.digest(P.findings(docs(spark, []))).count() == 0
    texts = ["mail hot@x.org now"] * 300 + ["nothing here"] * 300
    got = P.digest(P.findings(docs(spark, texts, ids=[None] * 600))).groupBy("spans").count().collect()
    assert {r["spans"]: r["count"] for r in got} == {"": 300, "term:0:4,email:5:14,term:15:18": 300}


def test_no_python_in_the_plan(spark):
    plan = P.digest(P.findings(docs(spark, REVEALING)))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def directories(n):
    """Four documents that hold the same n addresses and 5 n words, and plain ones."""
    text = " ".join(f"user{i}@x{i}.org " + " ".join(f"word{i}q{k}" for k in range(5)) for i in range(n))
    return [text] * 4 + PLAIN


def test_values_of_the_same_documents_are_paired_once(spark):
    df = docs(spark, directories(150))
    base_rows = P.written(P.base_spans(P.scanned(df)), "base")
    near = P.context_terms(base_rows)
    assert near.count() == 4 and base_rows.select("value").distinct().count() == 150
    told = P.disclosing(df, P.scanned(df), near)
    assert told.count() == 750
    got = rows_of(P.digest(P.findings(df)), "doc_id")
    assert [(r["n_email"], r["spans"].count("term:")) for r in got[:4]] == [(150, 750)] * 4 and {r["spans"] for r in got[4:]} == {""}


def test_disclosing_terms_equal_brute_force(spark):
    """All pairs of values and terms, counted one by one, in documents that share them in every way."""
    rng = random.Random(11)
    names = [f"name{chr(97 + i)}" for i in range(12)]
    texts = []
    for _ in range(160):
        who = rng.sample(range(12), rng.randint(0, 3))
        texts.append(" ".join([f"{names[w]} is u{w}@x.org" for w in who] + rng.sample(names, int(rng.random() < 0.05)) + ["common", f"t{rng.randint(0, 30)}xy"]))
    df = docs(spark, texts)
    base_rows = P.written(P.base_spans(P.scanned(df)), "base")
    near = P.context_terms(base_rows)
    for level in (0.5, 0.9):
        got = {(r["value"], r["term"]): r["disclosed"] for r in P.disclosing(df, P.scanned(df), near, disclosure=level).collect()}
        holds = {v: {i for i, t in enumerate(texts) if v in t.split()} for v in {w for t in texts for w in t.split() if "@" in w}}
        terms = {w: {i for i, t in enumerate(texts) if w in t.split()} for t in texts for w in t.split() if "@" not in w and len(w) >= 3}
        want = {}
        for v, dv in holds.items():
            for t, dt in terms.items():
                if len(dv) >= 3 and len(dv & dt) >= 3 and len(dv) < len(texts):
                    much = math.log2(len(dv & dt) * len(texts) / (len(dv) * len(dt))) / math.log2(len(texts) / len(dv))
                    if much >= level - 1e-9:
                        want["0:" + v, t] = much
        assert got.keys() == want.keys() and want and all(math.isclose(got[k], want[k]) for k in want)
