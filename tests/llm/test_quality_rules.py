import math
import random
import zlib

import numpy as np
import regex
from helpers import CLASHING, awkward, docs, rows_of, words

from conftest import SF_CHECK
from migtrack.llm import quality_rules as Q


def corpus(n, seed):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    texts, labels = [], []
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(20, 80))]
        good = i % 3 != 0
        texts.append(" ".join(words) + "." if good else " ".join(w + "###" for w in words) if i % 2 else " ".join([words[0]] * 50))
        labels.append((i, int(good), 0))
    return texts, labels


def test_held_out_accuracy_on_the_given_labels(spark):
    d, y = (spark.read.parquet(f"{SF_CHECK}/{t}.parquet") for t in ("documents", "labels"))
    got = {r["doc_id"]: r for r in Q.scores(d, y).collect()}
    assert len(got) == d.count()
    assert all(r["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got.values())
    held = [(got[r["doc_id"]]["predicted"], r["quality"]) for r in y.collect() if got[r["doc_id"]]["held_out"]]
    assert np.mean([p == q for p, q in held]) > 0.96


def test_held_out_labels_and_other_columns_have_no_influence(spark):
    texts, labels = corpus(300, 1)
    kind = "doc_id long, quality int, toxic int"
    d = docs(spark, texts)
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 3 == 1 else q, t) for i, q, t in labels]
    one = rows_of(Q.scores(d, spark.createDataFrame(labels, kind)), "doc_id")
    two = rows_of(Q.scores(docs(spark, texts, sources=["z"] * 300), spark.createDataFrame(flipped, kind)), "doc_id")
    assert one == two


def test_column_and_numpy_scores_agree(spark):
    texts, labels = corpus(240, 2)
    d = docs(spark, texts + awkward(2000))
    model = Q.fit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert model.rules
    rows = Q.statistics(d.select("doc_id", "text")).withColumn("p", model.score()).collect()
    x = np.array([[r[c] for c in Q.STATS] for r in rows])
    assert np.isfinite(x).all() and np.allclose(model.predict(x), [r["p"] for r in rows])


def test_awkward_labels_and_tables(spark):
    kind = "doc_id long, quality int, toxic int"
    none, one = spark.createDataFrame([], kind), spark.createDataFrame([(0, 1, 0), (3, None, 0), (None, 0, 0), (77, 0, 1), (0, 1, 1)], kind)
    d = docs(spark, awkward(2000), ids=[None, None, *range(11)])
    assert {r["score"] for r in Q.scores(d, none).collect()} == {0.5}
    assert len({r["score"] for r in Q.scores(d, one).collect()}) == 1
    assert Q.scores(docs(spark, []), one).count() == 0
    assert not any(r["held_out"] for r in Q.scores(d, none).filter("doc_id IS NULL").collect())


def test_kept_documents_keep_their_columns(spark):
    texts, labels = corpus(240, 3)
    d = docs(spark, texts)
    y = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = Q.kept_documents(d, y)
    assert out.columns == d.columns and set(CLASHING) < set(out.columns)
    assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in Q.scores(d, y).filter("predicted = 1").collect()}


def plain_statistics(text):
    """The statistics of one text in plain Python."""
    text = text or ""
    found, lines = words(text), text.split("\n")
    n, visible = max(1, len(found)), max(1, sum(map(len, found)))
    return {"words": len(found), "word_length": visible / n, "distinct_words": len(set(found)) / math.sqrt(n),
            "symbols": sum(not regex.match(r"[\p{L}\p{N} \t\n\x0b\f\r.,]", c) for c in text) / visible,
            "capitals": sum(bool(regex.match(r"\p{Lu}", c)) for c in text) / visible,
            "lines_repeated": 1 - len(set(lines)) / len(lines), "line_words": n / len(lines),
            "first_word": sum(w != found[0] for w in found) / n if found else 0.0}


def test_scores_equal_brute_force(spark):
    """Statistics, rules and weights of every text in plain Python, as the query gives them."""
    texts, labels = corpus(240, 4)
    texts += awkward(2000) + ["A\nA\nB\n", "É#É ж\n\n\x0b.", "a a a b"]
    d, y = docs(spark, texts), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = Q.fit(d, y)
    got = rows_of(Q.scores(d, y), "doc_id")
    assert model.rules and len(got) == len(texts)
    for text, r in zip(texts, got, strict=True):
        stats = plain_statistics(text)
        total = model.intercept
        for rule, weight in model.rules:
            if all((stats[Q.STATS[j]] > t) == above for j, above, t in rule.conditions):
                total += weight
        assert abs(r["score"] - 1 / (1 + math.exp(-total))) < 1e-9, text
        assert r["predicted"] == (r["score"] >= 0.5)


def test_a_tree_splits_where_the_squared_error_is_least():
    rng = np.random.default_rng(1)
    for _ in range(10):
        x = np.round(rng.normal(size=(150, 3)), 1)
        y = (rng.random(150) < np.where(x[:, 1] > rng.normal() / 2, 0.8, 0.3)).astype(float)
        rules = []
        Q.grow(x, y, np.arange(3), (), 1, rules)
        assert len(rules) == 2  # both sides of the root's split
        (j, _, t), = rules[0].conditions
        assert rules[0].conditions[0][1] != rules[1].conditions[0][1] and rules[1].conditions[0][::2] == (j, t)

        def error(j, t):
            sides = [[b for a, b in zip(x[:, j], y, strict=True) if (a > t) == s] for s in (True, False)]
            if min(map(len, sides)) < Q.MIN_LEAF:
                return math.inf
            return sum(sum((b - sum(s) / len(s)) ** 2 for b in s) for s in sides)

        best = min(error(k, q) for k in range(3) for q in np.quantile(x[:, k], np.linspace(0, 1, Q.BINS + 1)[1:-1]))
        assert abs(error(j, t) - best) < 1e-9


def test_lasso_meets_the_conditions_of_the_optimum():
    rng = np.random.default_rng(2)
    r = (rng.random((400, 12)) < 0.4).astype(float)
    y = (rng.random(400) < 1 / (1 + np.exp(-(2 * r[:, 0] - 3 * r[:, 1] + 0.5)))).astype(float)
    for penalty in (0.003, 0.02):
        intercept, w = Q.lasso(r, y, penalty, 4000)
        slope = r.T @ (1 / (1 + np.exp(-(intercept + r @ w))) - y) / 400
        rest = np.mean(1 / (1 + np.exp(-(intercept + r @ w))) - y)
        assert abs(rest) < 1e-5 and (np.abs(slope) <= penalty + 1e-5).all()
        on = w != 0
        assert 2 <= on.sum() < 12 and np.abs(slope[on] + penalty * np.sign(w[on])).max() < 1e-5
        assert w[0] > 0 > w[1]
