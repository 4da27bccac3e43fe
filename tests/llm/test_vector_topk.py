import math
import random

from migtrack.llm import vector_topk as V


def brute(rows, ask, k):
    def whole(v):
        return bool(v) and all(x is not None and math.isfinite(x) for x in v)
    rows = [(i, tuple(math.floor(1024 * x) for x in v)) for i, v in rows if i is not None and whole(v)]
    out = []
    for q, w in (x for x in rows if ask(x[0])):
        scored = sorted((-sum(a * b for a, b in zip(w, v)), i) for i, v in rows if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


def test_equals_brute_force(spark):
    rng = random.Random(1)
    vec = lambda: [rng.choice([0.0, 0.0, rng.uniform(-2, 2)]) for _ in range(6)]
    rows = [(i, vec()) for i in range(700)]
    rows += [(1000 + i, [0.5] * 6) for i in range(60)]                   # ties
    rows += [(None, [1.0] * 6), (2001, None), (2002, []), (2003, [1.0, None]), (2004, [float("nan")] * 6),
             (2100, [float("inf"), 1.0]), (2200, [3.0, 1.0]), (3, rows[3][1]), (2300, [0.0] * 6)]  # other lengths, repeats
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS score", "2 AS key")
    got = sorted(map(tuple, V.search(df, df.filter("vec_id % 100 = 0"), k=10).collect()))
    assert got == brute(rows, lambda i: i % 100 == 0, 10)


def test_repeated_rows_are_candidates_and_queries(spark, monkeypatch):
    kind = "vec_id long, embedding array<double>"
    rows = [(0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [1.0])]
    df = spark.createDataFrame(rows, kind)
    assert sorted(map(tuple, V.search(df, df.filter("vec_id = 0")).collect())) == [
        (0, 1, 1, 1024 * 2048), (0, 2, 1, 1024 * 2048), (0, 3, 2, 1024 * 1024)]
    rows = rows * 40 + [(100, [3.0, -1.0])] * 2 + [(i, [i / 7, 1.0]) for i in range(200, 260)]
    df = spark.createDataFrame(rows, kind)
    monkeypatch.setattr(V, "BLOCK_VALUES", 16)
    assert sorted(map(tuple, V.search(df, df.filter("vec_id % 100 = 0")).collect())) == brute(rows, lambda i: i % 100 == 0, 10)


def test_sql_takes_every_row(spark):
    import duckdb
    from migtrack.llm.queries import ORACLE_SQL
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    rows = [(0, [1.0]), (1, [2.0]), (1, [2.0]), (2, [1.0, 4.0]), (None, [1.0]), (3, None), (4, [None]), (100, [0.5]), (100, [0.5])]
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    assert sorted(con.execute(ORACLE_SQL["op5_vector_topk"]).fetchall()) == [(q, r, v, s) for q, r, v, s in brute(rows, lambda i: i % 100 == 0, 10)]


def test_few_candidates_and_empty_tables(spark):
    kind = "vec_id long, embedding array<float>"
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0])], kind)
    assert [tuple(r) for r in V.search(df, df.filter("vec_id = 0")).collect()] == [(0, 1, 1, 1024 * 2048)]
    assert V.search(df.limit(0), df.limit(0)).count() == 0
    assert V.search(df, df.limit(0)).count() == 0
    assert V.search(df.filter("vec_id = 0"), df.filter("vec_id = 0")).count() == 0
