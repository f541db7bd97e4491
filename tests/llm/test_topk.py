import numpy as np
import pytest
from pyspark.sql import functions as F

from statweave.llm import topk

SCHEMA = "vec_id long, embedding array<float>"


def brute(rows, k):
    fine = [(i, np.floor(np.float32(v).astype(float) * 256).astype(np.int64)) for i, v in rows
            if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for i, q in fine:
        if i % 50 == 0:
            found = sorted((-int(v @ q), j) for j, v in fine if j != i and len(v) == len(q))[:k]
            out[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(found)]
    return out


def run(spark, rows, k=5, schema=SCHEMA, **sizes):
    found = topk.top_k(spark.createDataFrame(rows, schema), F.col("id") % 50 == 0, k, **sizes).collect()
    out = {}
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    return out


@pytest.mark.parametrize("kind", ["dense", "ties", "sparse", "skewed"])
def test_equals_brute_force(spark, kind):
    rng = np.random.default_rng(len(kind))
    x = rng.normal(size=(700, 16)) * 0.2
    if kind == "ties":
        x = np.round(x * 4) / 4
    if kind == "sparse":
        x[rng.random(x.shape) < 0.8] = 0
    if kind == "skewed":
        x[:300] = x[0]
        x[300:320] *= 1000
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    want = brute(rows, 5)
    assert run(spark, rows) == want
    assert run(spark, rows, query_rows=4, candidate_rows=64) == want


def test_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]),
            (None, [1.0, 1.0]), (6, []), (50, [0.0, 0.0]), (100, [-1.0, -0.001]), (7, [1.0, 2.0, 3.0]), (150, [1.0])]
    assert run(spark, rows) == {k: v for k, v in brute(rows, 5).items() if v}
    assert run(spark, []) == {}
    wide = [(*r, "x", 1) for r in rows]
    assert run(spark, wide, schema=SCHEMA + ", v string, block int") == run(spark, rows)


def test_repeated_rows_count_each(spark):
    rows = [(0, [1.0, 0.0]), (1, [3.0, 0.0]), (1, [3.0, 0.0]), (2, [2.0, 0.0]), (0, [9.0, 0.0])]
    assert run(spark, rows, k=2)[0] == [(1, 1, 9 * 256 * 3 * 256), (2, 1, 9 * 256 * 3 * 256)]


def test_index_stops_early_only_on_proof():
    rng = np.random.default_rng(1)
    matrix = rng.integers(-100, 100, (3000, 64))
    index = topk.Index(np.arange(3000), matrix)
    for q in range(0, 3000, 300):
        ids, scores = index.search(matrix[q], q, 5)
        exact = matrix @ matrix[q]
        exact[q] = -(10**15)
        best = np.lexsort((np.arange(3000), -exact))[:5]
        assert ids.tolist() == best.tolist() and scores.tolist() == exact[best].tolist()
