import numpy as np
import pytest

from treelens.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n int, row string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 7, "r") for i, v in rows], SCHEMA)


def brute(vectors, k=4, scale=256):
    x = [[int(np.floor(scale * c)) for c in v] for v in vectors]
    fit = np.array(sorted({tuple(v) for v in x}), object)
    n, s = len(fit), fit.sum(0)
    c = (fit * n - s).astype(float) / n
    v = c.T @ c / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    y = (np.array(x, object) * n - s).astype(float) / n
    return n, [int(((np.array(r, object) * n - s) ** 2).sum()) for r in x], y @ u[:, :k] / np.sqrt(e[:k]), e[:k] / np.trace(v)


def same(got, want):
    signs = np.sign((got * want).sum(0))
    assert np.abs(got * signs - want).max() < 1e-8


def collected(df, k=4):
    rows = sorted(df.collect(), key=lambda r: (r.vec_id, r.component))
    return rows, np.array([r.whitened for r in rows]).reshape(-1, k)


def test_as_brute_force_with_repeats_and_bad_rows(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(size=(300, 7)) * np.arange(1, 8)
    good[200:] = good[:100]
    bad = [(1000, None), (1001, [1.0, None] + [0.0] * 5), (1002, [float("nan")] * 7), (1003, [float("inf")] * 7), (1004, [1.0, 2.0]), (1005, [])]
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(good)] + bad).repartition(5)
    rows, w = collected(whitening.whiten(df, carry=["vec_id", "n", "row"]))
    n, deviation, want, explained = brute(good.tolist())
    assert n == 200 and {r.n for r in rows} == {200} and {r.row for r in rows} == {"r"}
    assert [r.deviation for r in rows[::4]] == deviation and [r.component for r in rows[:4]] == [1, 2, 3, 4]
    same(w, want)
    assert np.allclose([r.explained for r in rows[:4]], explained) and rows[0].identity_error < 1e-9


def test_same_for_any_partitioning(spark):
    rng = np.random.default_rng(1)
    df = frame(spark, [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(200, 5)))])
    (a, wa), (b, wb) = (collected(whitening.whiten(df.repartition(k), carry=["vec_id"])) for k in (1, 7))
    # sums are whole numbers: the components are the same to the last bit
    assert [(r.deviation, r.explained) for r in a] == [(r.deviation, r.explained) for r in b] and np.abs(wa - wb).max() < 1e-14


def test_negative_zero_and_floors(spark):
    df = frame(spark, [(0, [-0.0, 0.001]), (1, [0.0, -0.001]), (2, [1.0, 0.0])])
    rows, _ = collected(whitening.whiten(df, carry=["vec_id"]), 2)
    n, deviation, _, _ = brute([[-0.0, 0.001], [0.0, -0.001], [1.0, 0.0]], 2)
    assert rows[0].n == n == 3 and [r.deviation for r in rows[::2]] == deviation


def test_large_values_stay_exact(spark):
    vectors = [[1e5, 3.0], [-2e5, 1.0], [5e4, 2.5]]
    rows = whitening.whiten(frame(spark, list(enumerate(vectors))), carry=["vec_id"]).where("component = 1").collect()
    assert [r.deviation for r in sorted(rows)] == brute(vectors, 2)[1]
    # beyond a long there is no deviation, and no failure
    huge = whitening.whiten(frame(spark, [(0, [1e300, 0.0]), (1, [-1e300, 1.0]), (2, [0.0, 5.0])]), carry=["vec_id"]).collect()
    assert huge and all(r.deviation is None for r in huge if r.vec_id < 2)


@pytest.mark.parametrize("rows", [[], [(0, None)], [(0, [1.0, 2.0])], [(0, [1.0, 2.0]), (1, [1.0, 2.0])], [(0, [])]])
def test_without_variance_there_are_no_rows(spark, rows):
    out = whitening.whiten(frame(spark, rows))
    assert out.count() == 0 and out.columns == ["vec_id", "embedding", "row", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def test_fewer_components_than_asked_for(spark):
    # one direction only
    out = whitening.whiten(frame(spark, [(i, [float(i), 2.0 * i, 1.0]) for i in range(9)] + [(None, [0.0, 0.0, 1.0])]), carry=["vec_id"]).collect()
    assert {r.component for r in out} == {1} and len(out) == 10 and abs(out[0].explained - 1) < 1e-9


def test_packing_round_trip():
    x = np.array([[0, 127], [-128, 5], [300, -1], [70000, 1], [2**40, -(2**40)], [2**63 - 1, -(2**63)]])
    p = whitening._packed(x)
    assert [r[0] for r in p] == [1, 1, 2, 4, 8, 8] and np.array_equal(whitening._unpacked(p, 2), x)
