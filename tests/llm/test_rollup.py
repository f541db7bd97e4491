import os

import pytest
from pyspark.sql import functions as F

from statweave.llm import queries, rollup

SF = "/root/testdata/sf0.001"
KIND = "struct<source:string,lang:string,version:string,docs:bigint,chars:bigint,tokens:bigint>"


def changes(spark, rows):
    return spark.createDataFrame(rows, f"op string, before {KIND}, after {KIND}")


def totals(r):
    return {tuple(x[:3]): tuple(x[3:]) for x in r.totals().select(*rollup.GROUP, *rollup.MEASURES).collect()}


def test_signed_batches_and_repeated_commits(spark, tmp_path):
    r = rollup.Rollup(spark, f"file://{tmp_path}/t")
    assert totals(r) == {}
    a, b, c = ("a", "en", "v1", 1, 10, 3), ("a", "en", "v1", 1, 20, 5), (None, None, "v2", 1, 7, 2)
    first = changes(spark, [("insert", None, a), ("insert", None, b), ("insert", None, c), ("insert", None, c)])
    assert r.commit("1", first) and not r.commit("1", first)
    assert totals(r) == {("a", "en", "v1"): (2, 30, 8), (None, None, "v2"): (2, 14, 4)}
    second = changes(spark, [("revise", b, ("b", "de", "v1", 1, 20, 6)), ("delete", c, None), ("delete", c, None)])
    assert r.commit("2", second) and not r.commit("2", second)
    want = {("a", "en", "v1"): (1, 10, 3), ("b", "de", "v1"): (1, 20, 6)}
    assert totals(r) == want
    r.compact()
    assert totals(r) == want and not r.commit("1", first) and not r.commit("2", second)
    assert r.commit("3", changes(spark, [])) and totals(r) == want
    assert r.commit("4", changes(spark, [("delete", a, None)]))
    r.compact()
    assert totals(rollup.Rollup(spark, r.root)) == {("b", "de", "v1"): (1, 20, 6)}


def test_an_unfinished_batch_does_not_count(spark, tmp_path):
    r = rollup.Rollup(spark, f"file://{tmp_path}/t")
    batch = changes(spark, [("insert", None, ("a", "en", "v", 1, 1, 1))])
    r.commit("1", batch)
    os.remove(tmp_path / "t/batches/1/_SUCCESS")  # as if the driver was lost before the end
    assert totals(r) == {} and r.commit("1", batch) and totals(r) == {("a", "en", "v"): (1, 1, 1)}


def test_wrong_input(spark, tmp_path):
    r = rollup.Rollup(spark, f"file://{tmp_path}/t")
    with pytest.raises(Exception, match="unknown op"):
        r.commit("1", changes(spark, [("upsert", None, ("a", "en", "v", 1, 1, 1))]))
    for bad in ("", "a/b", ".x"):
        with pytest.raises(ValueError):
            r.commit(bad, changes(spark, []))
    assert totals(r) == {}


def test_token_counts_and_query(spark):
    encoding = rollup._encoding(open(rollup.TOKENIZER, "rb").read(), rollup.PATTERN)
    texts = [None, "", "hello world", "<|endoftext|>", "é 日本 \n\n  x", "a" * 50_000]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", rollup.token_count(spark)(F.col("t")).alias("n"))
    assert {r.i: r.n for r in got.collect()} == {i: len(encoding.encode_ordinary(t)) if t else 0 for i, t in enumerate(texts)}
    docs = spark.read.parquet(f"{SF}/documents.parquet").toPandas().sort_values("doc_id").drop_duplicates("text")
    docs["tokens"], docs["chars"], docs["docs"] = [len(encoding.encode_ordinary(t)) for t in docs.text], docs.text.str.len(), 1
    want = docs.groupby(["source", "lang"])[["docs", "chars", "tokens"]].sum()
    found = queries.op7_token_counts(spark, SF).toPandas().set_index(["source", "lang"])[["docs", "chars", "tokens"]]
    assert found.sort_index().to_dict() == want.sort_index().to_dict()
