import zlib

import numpy as np
import pytest

from statweave.llm import quality, queries

SF = "/root/testdata/sf0.01"


def test_statistics():
    assert quality.statistics(None) == quality.statistics(b"") == quality.statistics(b" \n\t") == [0.0] * len(quality.FEATURES)
    got = dict(zip(quality.FEATURES, quality.statistics(b"The THE the the. 42!\nThe | b"), strict=True))
    assert got["distinct_words"] == pytest.approx(7 / 8) and got["repeated_neighbours"] == 0
    assert got["bars"] == pytest.approx(1 / 28) and got["digits"] == pytest.approx(2 / 28)
    assert got["closed_lines"] == 0.5 and np.isfinite(quality.statistics(b"x" * 2_000_000)).all()


def test_model_learns_tables_and_an_interaction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)) | (x[:, 2] > 0.9)
    model = quality.fit(x[:3000], y[:3000])
    assert (1, 0) in model.pairs
    assert ((model.score(x[3000:]) > 0.5) == y[3000:]).mean() > 0.95
    # A score is nothing but the sum of looked-up entries.
    at = model.bins(x[:1])[0]
    total = model.base + sum(t[a] for t, a in zip(model.tables, at, strict=True)) + sum(t[at[i], at[j]] for (i, j), t in model.pairs.items())
    assert model.score(x[:1])[0] == pytest.approx(1 / (1 + np.exp(-total)))


def test_held_out_accuracy(spark):
    rows = queries.op3_quality(spark, SF).toPandas()
    assert len(rows) == 1000 and rows.score.between(0, 1).all()
    assert [zlib.crc32(str(i).encode()) % 4 == 2 for i in rows.doc_id] == rows.held_out.tolist()
    both = rows[rows.held_out].merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    assert (both.predicted == both.quality).mean() > 0.93
    assert ((rows.score >= 0.7) == (rows.predicted == 1)).all()


def test_held_out_labels_and_other_columns_change_nothing(spark, documents):
    docs = documents([(i, f"some plain words number {i}. They end." if i % 3 else "%%% $$$ | | " * (i + 1), "en", "a") for i in range(200)])
    labels = spark.createDataFrame([(i, int(bool(i % 3)), "z") for i in range(200)] + [(None, 1, "z"), (5, None, "z")], "doc_id long, quality int, y string")
    turned = spark.createDataFrame(
        [(i, int(bool(i % 3)) if zlib.crc32(str(i).encode()) % 4 != 2 else 1 - int(bool(i % 3))) for i in range(200)], "doc_id long, quality int")
    clash = documents([(r.doc_id, r.text, "xx", "other") for r in docs.collect()], clash=True)
    a, b = (quality.scored(d, quality.train(d, lab)) for d, lab in ((docs, labels), (clash, turned)))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_edge_cases(spark, documents):
    docs = documents([(None, None), (1, ""), (1, ""), (2, "x " * 200_000)])
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = quality.scored(docs, quality.train(docs, none)).collect()
    assert len(rows) == 4 and {r.score for r in rows} == {0.5}
    one = spark.createDataFrame([(1, 1), (2, 1)], "doc_id long, quality int")
    assert all(r.score >= 0.5 for r in quality.scored(docs, quality.train(docs, one)).collect())
    assert quality.scored(documents([]), quality.train(documents([]), none)).count() == 0
