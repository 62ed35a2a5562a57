import math
import random

import numpy as np
import pytest

from vaultlens.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>, label int, x int, id string, v int, component double, whitened int"


def odd_rows(n=80, d=6, seed=3):
    """Vectors with correlations, copies, nulls and non-finite entries; other columns' names clash on purpose."""
    rng = random.Random(seed)
    out = []
    for i in range(n):
        base = [rng.gauss(0, 1) for _ in range(d)]
        base[1] = 0.9 * base[0] + 0.1 * base[1]
        out.append([i, [float(np.float32(v)) for v in base]])
    out += [[200 + i, out[5][1]] for i in range(30)]  # copies
    out += [[300, None], [301, [None] + [0.5] * (d - 1)], [302, [math.nan] + [0.5] * (d - 1)], [303, [math.inf] + [0.5] * (d - 1)], [304, [-math.inf] + [0.5] * (d - 1)], [305, []], [306, [1.0]]]
    out += [[None, out[7][1]], [9, out[9][1]]]
    return [(*r, 1, 2, "id", 3, 0.5, 4) for r in out]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA).repartition(3)


def plain(data, d):
    """Exact x, n and S, and numpy's own eigenvalues."""
    good = [(r[0], tuple(math.floor(256 * c) for c in r[1])) for r in data if r[1] and len(r[1]) == d and all(c is not None and math.isfinite(c) for c in r[1])]
    once = np.array(sorted({x for _, x in good}), np.int64)
    v = np.cov(once.T.astype(float), bias=True).reshape(d, d)
    values, vectors = np.linalg.eigh(v)
    return good, once, v, values[::-1], vectors[:, ::-1]


@pytest.mark.parametrize("d", [6, 3, 1])
def test_the_query_equals_numpy(spark, tmp_path, d):
    data = odd_rows(d=d) if d > 1 else [(i, [float(i % 7)], 1, 2, "", 3, 0.5, 4) for i in range(20)]
    frame(spark, data).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op12_whiten(spark, str(tmp_path)).collect()
    good, once, v, values, vectors = plain(data, d)
    n, s, k = len(once), once.sum(0), min(4, d)
    assert len(got) == len(good) * k
    assert sorted((str(r["vec_id"]), r["component"]) for r in got) == sorted((str(i), c + 1) for i, _ in good for c in range(k))
    x_of = {}
    for i, x in good:
        x_of.setdefault(i, x)
    sign = {}
    for r in got:
        x, c = np.array(x_of[r["vec_id"]]), r["component"] - 1
        assert (r["n"], r["deviation"]) == (n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(x, s, strict=True)))
        want = (x - s / n) @ vectors[:, c] / math.sqrt(values[c])
        if abs(want) > 1e-3:
            assert sign.setdefault(c, np.sign(want * r["whitened"])) == np.sign(want * r["whitened"])
        assert abs(abs(want) - abs(r["whitened"])) < 1e-9
        assert abs(r["explained"] - values[c] / np.trace(v)) < 1e-12
        assert r["identity_error"] < 1e-9


def test_decomposition_keeps_small_eigenvalues():
    rng = np.random.default_rng(0)
    for d, spread in ((64, 3), (40, 12), (7, 0)):
        q, _ = np.linalg.qr(rng.normal(size=(d, d)))
        e = np.logspace(0, -spread, d)
        turned = whitening.jacobi(whitening.pivoted_cholesky(q * e @ q.T))
        values = (turned**2).sum(0)
        assert np.allclose(values, np.sort(e)[::-1][: len(values)], rtol=1e-3, atol=1e-14) and np.allclose(values[:4], e[:4], rtol=1e-12)
        unit = turned / np.sqrt(values)
        assert np.abs(unit.T @ unit - np.eye(len(values))).max() < 1e-10


def test_factor_is_triangular_in_pivot_order():
    a = np.random.default_rng(1).normal(size=(9, 5))
    v = a @ a.T
    factor = whitening.pivoted_cholesky(v)
    assert factor.shape == (9, 5) and np.allclose(factor @ factor.T, v)  # the rank, not more
    taken = [int(np.flatnonzero(np.abs(factor[:, k + 1 :]).max(1, initial=0) == 0)[np.argmax(np.abs(factor[np.flatnonzero(np.abs(factor[:, k + 1 :]).max(1, initial=0) == 0), k]))]) for k in range(5)]
    assert len(set(taken)) == 5


def test_as_many_components_as_rank(spark):
    line = frame(spark, [(i, [float(i), 2.0 * i, 0.0], 1, 2, "", 3, 0.5, 4) for i in range(10)])
    got = whitening.whiten(line).collect()
    assert {r["component"] for r in got} == {1} and len(got) == 10 and all(abs(r["explained"] - 1) < 1e-12 for r in got)


def test_odd_tables(spark):
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for data in ([], odd_rows()[-9:-4], [(i, [1.0, 2.0], 1, 2, "", 3, 0.5, 4) for i in range(5)]):
        out = whitening.whiten(spark.createDataFrame(data, SCHEMA))
        assert out.columns == columns and out.count() == 0


def test_a_vector_with_many_copies_is_one_point(spark):
    base = odd_rows()
    more = [(1000 + i, base[0][1], *base[0][2:]) for i in range(500)]
    few, many = whitening.whiten(frame(spark, base)), whitening.whiten(frame(spark, base + more))
    value = lambda df: sorted((r["component"], r["n"], round(r["explained"], 10)) for r in df.select("component", "n", "explained").distinct().collect())
    assert value(few) == value(many)


def test_deviation_is_exact_beyond_doubles(spark):
    rows = [(i, [float(2**20 + i), float(-(2**20) + 3 * i)], 1, 2, "", 3, 0.5, 4) for i in range(9)]
    got = {r["vec_id"]: r["deviation"] for r in whitening.whiten(frame(spark, rows)).collect()}
    good, once, *_ = plain(rows, 2)
    s = once.sum(0)
    assert got == {i: sum((len(once) * a - int(b)) ** 2 for a, b in zip(x, s, strict=True)) for i, x in good}
