"""Operator 10: quality classifier as a sparse ensemble of rules.

Small trees are grown on bootstrap samples of labelled rows, every path from a
root becomes a conjunctive rule over text statistics, a lasso logistic
regression gives most rules weight zero, and the rest is compiled into one Spark
column expression, so that scoring is a single pass over the texts in the JVM.

The fit reads at most ``MAX_ROWS`` labelled rows (those of smallest hash, none of
them held out); this bound does not touch scoring, which covers every document.
A row is held out when crc32 of its doc_id as text leaves remainder 1 by 3.

Cases: null text counts as empty and is scored like any other; a doc_id that is
null is not held out and never labelled; labels that are null, unknown to the
documents or repeated are ignored or merged (a document with both labels gets
the smaller one); without labels of both kinds the score is the constant share of label
1 (0.5 without any); an empty table gives no rows; extra columns are ignored, and
kept by ``kept_documents``.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANK, whole_text

MAX_ROWS = 20_000   # bound of the labelled sample that is fitted on the driver
TREES, DEPTH, BINS, MIN_LEAF = 40, 3, 24, 20
LASSO, STEPS = 0.001, 400
STATS = ["words", "word_length", "distinct_words", "symbols", "capitals", "lines_repeated", "line_words", "first_word"]


def statistics(docs: DataFrame, prefix: str = "") -> DataFrame:
    """Add the statistics of ``text`` as double columns, all finite for any text."""
    text, words, lines = whole_text(), F.col(prefix + "w"), F.col(prefix + "l")
    n = F.greatest(F.size(words), F.lit(1)).cast("double")
    visible = F.greatest(F.length(F.array_join(words, "")), F.lit(1)).cast("double")
    made = {
        "words": F.size(words).cast("double"),
        "word_length": visible / n,
        "distinct_words": F.size(F.array_distinct(words)) / F.sqrt(n),
        "symbols": F.length(F.regexp_replace(text, r"[\p{L}\p{N}\s.,]+", "")) / visible,
        "capitals": F.length(F.regexp_replace(text, r"[^\p{Lu}]+", "")) / visible,
        "lines_repeated": 1 - F.size(F.array_distinct(lines)) / F.size(lines),
        "line_words": n / F.size(lines),
        "first_word": F.size(F.array_remove(words, F.element_at(words, 1))) / n,
    }
    split = docs.withColumns({prefix + "w": F.filter(F.split(text, BLANK), lambda w: w != ""),
                              prefix + "l": F.split(text, "\n")})
    made["first_word"] = F.when(F.size(words) > 0, made["first_word"]).otherwise(0.0)
    return split.withColumns({prefix + k: made[k].cast("double") for k in STATS}).drop(prefix + "w", prefix + "l")


@dataclass(frozen=True)
class Rule:
    """Conditions (statistic, is_above, threshold), all of which must hold."""
    conditions: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), dtype=bool)
        for j, above, t in self.conditions:
            out &= (x[:, j] > t) == above
        return out

    def column(self, prefix: str) -> Column:
        out = F.lit(True)
        for j, above, t in self.conditions:
            stat = F.col(prefix + STATS[j])
            out = out & (stat > t if above else stat <= t)
        return out


@dataclass
class Model:
    intercept: float
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self, prefix: str = "") -> Column:
        """Probability of label 1 as a column over the statistics."""
        total = F.lit(self.intercept)
        for rule, weight in self.rules:
            total = total + F.when(rule.column(prefix), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            total += weight * rule.holds(x)
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, columns: np.ndarray, path: tuple, depth: int, out: list[Rule]) -> None:
    """Split by least squared error on quantile thresholds; every node but the root is a rule."""
    if path:
        out.append(Rule(path))
    if depth == 0 or len(y) < 2 * MIN_LEAF or y.min() == y.max():
        return
    found, where = 1e-9, None
    total, n = y.sum(), len(y)
    for j in columns:
        for t in np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])):
            above = x[:, j] > t
            k = int(above.sum())
            if MIN_LEAF <= k <= n - MIN_LEAF:
                s = y[above].sum()
                gain = s * s / k + (total - s) ** 2 / (n - k) - total * total / n
                if gain > found:
                    found, where = gain, (int(j), float(t), above)
    if where:
        j, t, above = where
        for side in (True, False):
            rows = above if side else ~above
            grow(x[rows], y[rows], columns, (*path, (j, side, t)), depth - 1, out)


def lasso(r: np.ndarray, y: np.ndarray, penalty: float, steps: int) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient; the intercept is free."""
    n, m = r.shape
    a = np.hstack([np.ones((n, 1)), r])
    rate = 4 * n / np.linalg.norm(a, 2) ** 2
    w = z = np.zeros(m + 1)
    t = 1.0
    for _ in range(steps):
        step = z - rate * (a.T @ (1 / (1 + np.exp(-(a @ z))) - y)) / n
        new = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0)
        new[0] = step[0]
        t, before = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        w, z = new, new + (before - 1) / t * (new - w)
    return float(w[0]), w[1:]


def fit_rows(x: np.ndarray, y: np.ndarray, seed: int = 7) -> Model:
    """Fit on the rows of the bounded sample."""
    if len(y) == 0 or y.min() == y.max():
        share = 0.5 if len(y) == 0 else float((y.sum() + 1) / (len(y) + 2))
        return Model(float(np.log(share / (1 - share))))
    rng, rules = np.random.default_rng(seed), []
    for _ in range(TREES):
        rows = rng.integers(0, len(y), len(y))
        columns = rng.choice(x.shape[1], size=max(2, x.shape[1] * 2 // 3), replace=False)
        grow(x[rows], y[rows], np.sort(columns), (), DEPTH, rules)
    found: dict[bytes, Rule] = {}
    for rule in rules:  # rules that hold for the same rows count once
        found.setdefault(np.packbits(rule.holds(x)).tobytes(), rule)
    rules = list(found.values())
    if not rules:
        share = float(y.mean())
        return Model(float(np.log(share / (1 - share))))
    intercept, w = lasso(np.stack([r.holds(x) for r in rules], axis=1).astype(float), y, LASSO, STEPS)
    return Model(intercept, [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-6])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS) -> Model:
    """Fit on the labelled, not held out documents; ``max_rows`` bounds what the driver collects."""
    key = F.col("doc_id").cast("long")
    sample = (labels.select(key.alias("__id"), F.col("quality").cast("double").alias("__y"))
              .filter("__id IS NOT NULL AND __y IN (0, 1)").filter(~held_out(F.col("__id")))
              .groupBy("__id").agg(F.min("__y").alias("__y"))
              .orderBy(F.xxhash64("__id"), "__id").limit(max_rows))
    texts = docs.select(key.alias("__id"), "text").join(F.broadcast(sample), "__id")
    rows = (statistics(texts).select("__y", *STATS).orderBy("__id", *STATS).limit(max_rows).collect())
    data = np.array([tuple(r) for r in rows], dtype=float).reshape(len(rows), len(STATS) + 1)
    return fit_rows(data[:, 1:], data[:, 0])


def scores(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    model = fit(docs, labels, **options)
    rows = statistics(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    return (rows.withColumn("score", model.score()).withColumn("held_out", held_out(F.col("doc_id")))
            .select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))


def kept_documents(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents scored 0.5 or more, with their own columns."""
    model = fit(docs, labels, **options)
    return statistics(docs, "__").filter(model.score("__") >= 0.5).select(*docs.columns)
