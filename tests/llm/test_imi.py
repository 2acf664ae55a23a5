import numpy as np
import pytest
from pyspark.sql import functions as F

from treelens.llm import imi

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k, query=lambda i: i % 50 == 0):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(i, []).append(np.array(v, float))
    out = {}
    for q in filter(query, good):
        score = {}
        for i, vs in good.items():
            if i != q:
                score[i] = max(float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b)) for a in vs for b in good[q])
        out[q] = sorted(score.items(), key=lambda t: (-round(t[1], 12), t[0]))[:k]
    return out


def found(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def data(n, seed=1):
    rng = np.random.default_rng(seed)
    return [(i, [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(n)]


def test_exact_where_all_cells_are_taken(spark):
    rows = data(400)
    same = rows[3][1]
    rows += [(1000 + 50 * i, same) for i in range(30)] + [(7, same), (7, same), (5, rows[5][1])]
    nan, inf = float("nan"), float("inf")
    rows += [(2000, None), (2050, [0.0] * 8), (2100, [1.0] * 7 + [nan]), (2150, [1.0] * 7 + [inf]), (2200, [1.0] * 7 + [None]), (None, rows[0][1]), (2250, [1.0] * 5), (2300, [])]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as label", "2 as cell", "3 as ids")
    got, truth = found(imi.search(df, F.col("vec_id") % 50 == 0, candidates=10**6)), brute(rows, 5)
    assert got.keys() == truth.keys()
    for q in truth:
        assert [i for i, _ in got[q]] == [i for i, _ in truth[q]], q
        assert np.allclose([s for _, s in got[q]], [s for _, s in truth[q]], rtol=0, atol=1e-12)


@pytest.mark.parametrize("chunk", [4096, 16])
def test_recall(spark, chunk, monkeypatch):
    monkeypatch.setattr(imi, "CHUNK", chunk)
    monkeypatch.setattr(imi, "QUERIES", chunk)
    rows = data(3000, 2)
    got = found(imi.search(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, candidates=100))
    truth = brute(rows, 5)
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in truth[q]}) for q in truth)
    assert hit >= 0.9 * 5 * len(truth)


def test_cells_come_in_order_and_each_once():
    rng = np.random.default_rng(0)
    a, b = rng.random(7), rng.random(5)
    held = rng.integers(0, 3, 35)
    cells = imi.traverse(a, b, held, 10**9)
    assert sorted(cells) == np.flatnonzero(held).tolist()
    far = [a[c // 5] + b[c % 5] for c in cells]
    assert far == sorted(far)
    some = imi.traverse(a, b, held, 6)
    assert some == cells[: len(some)] and held[some].sum() >= 6 > held[some[:-1]].sum()


def test_few_rows(spark):
    assert imi.search(spark.createDataFrame([], SCHEMA), F.col("vec_id") % 50 == 0).count() == 0
    one = spark.createDataFrame([(0, [1.0, 2.0])], SCHEMA)
    assert imi.search(one, F.col("vec_id") % 50 == 0).count() == 0
    three = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [-1.0])], SCHEMA)
    assert found(imi.search(three, F.col("vec_id") % 50 == 0)) == {0: [(1, 1.0), (2, -1.0)]}
