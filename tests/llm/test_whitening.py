import numpy as np
import pytest

from statweave.llm import queries, whitening

SCHEMA = "vec_id long, embedding array<float>"
SF = "/root/testdata/sf0.001"


def brute(rows, k=4):
    """n, S, covariance, its leading eigenpairs, and per row the deviation and the centred vector."""
    fine = [(i, v) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v)]
    ints = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in fine]
    distinct = sorted({tuple(x) for _, x in ints})
    n, s = len(distinct), [sum(c) for c in zip(*distinct, strict=True)]
    x = np.array(distinct, float)
    centred = x - np.array(s) / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    dev = [(i, sum((n * a - b) ** 2 for a, b in zip(v, s, strict=True)), np.array(v) - np.array(s) / n) for i, v in ints]
    return n, values[::-1], vectors[:, ::-1][:, :k], dev


def check(got, rows, k=4):
    n, values, vectors, dev = brute(rows, k)
    assert len(got) == k * len(dev)
    by = {}
    for r in got:
        assert r.n == n and r.identity_error < 1e-9
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-10)
        by.setdefault((r.vec_id, int(r.deviation)), {})[r.component] = r.whitened
    sign = {}
    for i, d, centred in dev:
        want = centred @ vectors / np.sqrt(values[:k])
        for c in range(k):
            value = by[i, d][c + 1]
            if abs(want[c]) > 1e-3:
                sign.setdefault(c, np.sign(value * want[c]))
            assert value * sign.get(c, 1) == pytest.approx(want[c], abs=1e-8)


def test_the_test_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    got = queries.op13_whitening(spark, SF)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
                                "whitened": "double", "explained": "double", "identity_error": "double"}
    check(got.collect(), rows)


def test_repeated_null_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows = [(i, [float(c) for c in rng.normal(size=6) * [5, 3, 2, 1, 0.5, 0.1]]) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(200)] + [(5, rows[5][1]), (None, rows[6][1])]
    odd = [(900, None), (901, []), (902, [None] + [1.0] * 5), (903, [float("nan")] * 6), (904, [float("inf")] * 6), (905, [1.0] * 5)]
    wide = spark.createDataFrame([(*r, "c", 7) for r in rows + odd], SCHEMA + ", x string, n int")
    check(whitening.whiten(wide).collect(), rows)


def test_few_or_no_vectors(spark):
    run = lambda rows: whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    assert run([]) == run([(1, None)]) == run([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == []
    one = run([(1, [1.0, 2.0]), (2, [3.0, 2.0]), (3, [1.0, 2.0])])  # one direction has all variance
    assert [(r.component, int(r.deviation), abs(r.whitened), r.explained) for r in one] == [(1, 512**2, pytest.approx(1), pytest.approx(1))] * 3


def test_exact_deviation_beyond_64_bits():
    model = whitening.Whitening(10**9, np.array([7, -5]), np.ones(2), np.eye(2), np.ones(2), 0.0)
    x = np.array([[30_000, -12_345], [1, 0]])
    assert [int(v) for v in model.deviations(x).to_pylist()] == [sum((10**9 * int(a) - s) ** 2 for a, s in zip(r, (7, -5), strict=True)) for r in x]


@pytest.mark.parametrize("spectrum", ["even", "close", "steep", "low rank"])
def test_eigenpairs(spectrum):
    rng = np.random.default_rng(2)
    d = 80
    values = {"even": np.linspace(9, 1, d), "close": np.r_[5, 5 - 1e-5, 5 - 2e-5, 4.9, np.linspace(4.8, 1, d - 4)],
              "steep": 2.0 ** -np.arange(d), "low rank": np.r_[3, 2, np.zeros(d - 2)]}[spectrum]
    base, _ = np.linalg.qr(rng.normal(size=(d, d)))
    a = (base * values) @ base.T
    a = (a + a.T) / 2
    got, vectors = whitening.jacobi_davidson(lambda w: a @ w, d, 4)
    assert got == pytest.approx(values[:4], abs=1e-12)
    assert np.abs(vectors.T @ vectors - np.eye(4)).max() < 1e-13
    assert np.linalg.norm(a @ vectors - vectors * got, axis=0).max() < 1e-12
    assert len(whitening.jacobi_davidson(lambda w: a[:3, :3] @ w, 3, 4)[0]) == 3


def test_minres_solves_columns_side_by_side():
    rng = np.random.default_rng(3)
    a = rng.normal(size=(30, 30))
    a, b = a + a.T, rng.normal(size=(30, 3))
    assert np.abs(a @ whitening.minres(lambda x: a @ x, b, 60, 1e-10) - b).max() < 1e-7
