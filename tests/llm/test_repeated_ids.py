"""Different vectors under one id all count, as in the SQL of op9."""

import duckdb

from checks.run import compare
from patronage.llm import ann, topk
from tests.llm.test_search import frame

ROWS = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 0.25]), (1, [-1.0, -1.0]), (2, [0.5, 2.0]), (2, [2.0, 0.5]), (100, [3.0, 3.0]), (7, [1.0, -0.5])]


def test_products_as_in_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", ROWS)
    assert compare(topk.top_products(frame(spark, ROWS)), con, topk.SQL) is None


def test_cosines_of_all_vectors(spark):
    def cosine(a, b):
        return (a[0] * b[0] + a[1] * b[1]) / ((a[0] ** 2 + a[1] ** 2) * (b[0] ** 2 + b[1] ** 2)) ** 0.5

    got = sorted(tuple(r) for r in ann.neighbours(frame(spark, ROWS)).collect())
    for query in (50, 100):
        want = sorted((-round(cosine(a, b), 9), v) for q, a in ROWS if q == query for v, b in ROWS if v != q)[:5]
        assert [(-round(s, 9), v) for q, _, v, s in got if q == query] == want
