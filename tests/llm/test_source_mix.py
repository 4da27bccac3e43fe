import random

from helpers import CLASHING, awkward, docs, rows_of, words

from migtrack.llm import source_mix as M


def shares(sizes):
    """Water filling by hand, as the contract says it."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: M.WEIGHTS[i % 3] for i, s in enumerate(names)}
    out, left, free = {}, float(sum(sizes.values())), dict(weight)
    while free:
        level = left / sum(free.values())
        over = [s for s in free if weight[s] * level > 3 * sizes[s] + 1e-9]
        if not over:
            return out | {s: weight[s] * level for s in free}
        for s in over:
            out[s] = 3.0 * sizes[s]
            left -= out[s]
            del free[s]
    return out


def test_targets_and_taken_words(spark):
    rng = random.Random(3)
    sources = [rng.choice(["b", "a", "é", "Z", None, "z", "hot", "hot", "hot"]) for _ in range(600)]
    texts = ["w " * rng.randint(0, 60) for _ in range(600)]
    texts[0] = None
    df = docs(spark, texts, sources=sources)
    got = rows_of(M.taken_words(df), "doc_id")
    assert [r["size"] for r in got] == [len(words(t)) for t in texts]
    sizes = {}
    for r, s in zip(got, sources, strict=True):
        sizes[s] = sizes.get(s, 0) + r["size"]
    want, taken = shares(sizes), dict.fromkeys(sizes, 0)
    for r, s in zip(got, sources, strict=True):
        assert r["source_size"] == sizes[s] and abs(r["target"] - want[s]) < 1e-6 * max(1, want[s])
        assert r["taken"] % max(1, r["size"]) == 0 and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 60 for s in sizes)
    assert abs(sum(taken.values()) - sum(sizes.values())) <= 60
    assert rows_of(M.taken_words(df.repartition(7)), "doc_id") == got  # reruns agree, whatever the layout


def test_cut_is_the_global_order_truncated(spark):
    rng = random.Random(8)
    texts = ["w " * rng.randint(1, 30) for _ in range(200)]
    plan = M.plan(docs(spark, texts))
    placed = [r.asDict() for r in plan.placed.withColumn("copies", plan.copies).collect()]
    readings = sorted(((e * r["source_size"] + r["upto"]) / r["target"], r["spread"], e, r["size"], r["doc_id"])
                      for r in placed for e in range(3))
    total, copies = 0, dict.fromkeys(range(200), 0)
    for _, _, _, size, doc in readings:
        total += size
        if total > sum(r["size"] for r in placed):
            break
        copies[doc] += 1
    assert {r["doc_id"]: r["copies"] for r in placed} == copies


def test_mixed_repeats_documents_and_keeps_columns(spark):
    texts = awkward() + ["alike"] * 40
    ids = list(range(len(texts) - 40)) + [None] * 20 + [999] * 20
    df = docs(spark, texts, ids=ids, sources=["s"] * len(texts))
    out = M.mixed(df)
    assert out.columns == df.columns and set(CLASHING) < set(out.columns)
    taken = {}
    for r in M.taken_words(df).collect():
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    mixed = {}
    for r in out.collect():
        mixed[r["doc_id"]] = mixed.get(r["doc_id"], 0) + len(words(r["text"]))
    assert {k: v for k, v in taken.items() if v} == mixed


def test_nothing_to_mix(spark):
    assert M.taken_words(docs(spark, [])).count() == 0
    got = rows_of(M.taken_words(docs(spark, [None, ""])), "doc_id")
    assert [(r["target"], r["taken"]) for r in got] == [(0.0, 0), (0.0, 0)]
