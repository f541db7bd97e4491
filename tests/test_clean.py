import math

from pyspark.sql import functions as F

from conftest import rows
from statweave.operators import clean, describe, profile
from statweave.sources import tables

NAN, INF = float("nan"), float("inf")


def test_nan_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (None,), (3.0,)], "x double")
    assert profile.missing_profile(df).first()["missing_count"] == 2
    assert clean.drop_missing(df).data.count() == 2
    assert rows(clean.fill_missing(df, "mean").data) == [(1.0,), (2.0,), (2.0,), (3.0,)]
    assert clean.fill_missing(df, "mean").report.first()["affected_count"] == 2
    stats = describe.describe(df).first()
    assert stats["count"] == 2 and stats["mean"] == 2.0 and stats["max"] == 3.0


def test_fill_takes_the_smallest_mode_and_leaves_empty_columns(spark):
    df = spark.createDataFrame([(2, None), (2, None), (1, None), (1, None), (None, None)], "a int, b double")
    filled = clean.fill_missing(df, "most_frequent")
    assert rows(filled.data.select("a")) == [(1.0,), (1.0,), (1.0,), (2.0,), (2.0,)]
    assert filled.data.where("b is not null").count() == 0


def test_outlier_limits_use_the_input_frame_and_keep_missing(spark):
    data = [(float(i), 0.0) for i in range(20)] + [(1000.0, 0.0), (None, 0.0), (5.0, 99.0)]
    df = spark.createDataFrame(data, "x double, y double")
    kept = clean.remove_outliers(df, ["x", "y", "absent"])
    assert kept.data.count() == 21 and kept.report.first()["affected_count"] == 2
    empty = spark.createDataFrame([(None,)], "x double")
    assert clean.outlier_report(empty).first()["q1"] is None


def test_constant_columns_scale_to_zero(spark):
    df = spark.createDataFrame([(7.0, 1.0), (7.0, 3.0), (None, None)], "c double, v double")
    assert rows(clean.scale_standard(df, ["c", "v"])) == sorted([(0.0, -1.0), (0.0, 1.0), (None, None)], key=repr)
    assert rows(clean.scale_minmax(df, ["c", "v"])) == sorted([(0.0, 0.0), (0.0, 1.0), (None, None)], key=repr)


def test_encode_and_decode(spark):
    df = spark.createDataFrame([("b",), (None,), ("a",), ("b",), ("ä",)], "s string")
    coded, mapping = clean.encode_categories(df, ["s"])
    assert rows(coded) == [(-1,), (0,), (1,), (1,), (2,)]
    assert rows(mapping) == [("s", 0, "a"), ("s", 1, "b"), ("s", 2, "ä")]


def test_encode_when_the_mapping_is_too_large_to_broadcast(spark, monkeypatch):
    monkeypatch.setattr(clean, "BROADCAST_ROWS", 3)
    df = spark.range(500).select(F.concat(F.lit("v"), F.lpad((F.col("id") % 50).cast("string"), 3, "0")).alias("s"), "id")
    coded, _ = clean.encode_categories(df, ["s"])
    assert coded.where(F.col("s") != F.col("id") % 50).count() == 0


def test_regression_rows(spark):
    df = spark.createDataFrame(
        [(1.0, 1.0), (None, 1.0), (INF, 1.0), (INF, None), (NAN, -INF), (2.0, 2.0)], "x double, y double")
    report = clean.clean_regression_rows(df, ["x", "y"]).report.first().asDict()
    assert report == {"original": 6, "cleaned": 2, "dropped": 4, "dropped_inf": 3, "dropped_nan": 1}


def test_dates_need_more_than_half(spark):
    df = spark.createDataFrame([("2024-01-05", "x"), ("01/31/2024", "2024-01-01"), ("junk", "y"), (None, "2023")], "a string, b string")
    out = clean.promote_dates(df)
    assert dict(out.dtypes) == {"a": "timestamp_ntz", "b": "string"}
    assert [str(r[0])[:10] for r in out.where("a is not null").orderBy("a").select("a").collect()] == ["2024-01-05", "2024-01-31"]


def test_edges_of_describe(spark):
    one = describe.describe(spark.createDataFrame([(4.0, 4, None)], "x double, k int, e double"))
    got = {r["column"]: r for r in one.collect()}
    assert set(got) == {"x", "k"} and got["x"]["is_constant"] and got["x"]["skewness"] == 0.0
    assert describe.describe(spark.createDataFrame([], "x double")).count() == 0
    corr = describe.correlation(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "c double, v double"))
    assert {(r["column_a"], r["column_b"]): r["r"] for r in corr.collect()}[("c", "c")] == 0.0


def test_correlation_of_many_columns_in_chunks(spark, monkeypatch):
    import numpy as np
    import pandas as pd

    monkeypatch.setattr(describe, "MAX_PAIRS", 4)
    pdf = pd.DataFrame(np.random.default_rng(3).normal(size=(60, 5)), columns=list("abcde"))
    pdf.loc[3:9, "b"] = np.nan
    want = pdf.corr()
    got = describe.correlation(spark.createDataFrame(pdf)).collect()
    assert len(got) == 25
    assert all(math.isclose(r["r"], want.loc[r["column_a"], r["column_b"]], abs_tol=1e-12) for r in got)


def test_delimited_text(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w", encoding="utf-8-sig") as f:
        f.write("day;name;value\n2024-01-01;a,b;1.5\n2024-01-02;c;2.5\n")
    df = tables.read_delimited(spark, path)
    assert df.columns == ["day", "name", "value"] and df.count() == 2
    out = str(tmp_path / "out")
    tables.write_delimited(df, out)
    assert tables.read_delimited(spark, out).count() == 2
    assert tables.from_rows(spark, [{"a": 1}]).first()["a"] == 1
    try:
        tables.check_table(spark.createDataFrame([("x",)], "s string"))
        raise AssertionError("a table without numbers was accepted")
    except ValueError:
        pass


def test_load_table_in_one_step(spark, tmp_path):
    path = str(tmp_path / "in.csv")
    with open(path, "w", encoding="cp1251") as f:
        f.write("день;имя;value\n2024-01-01;Ёж, \"Ъ\";1.5\n2024-01-02;я;2.5\n")
    spark.conf.set("spark.sql.legacy.javaCharsets", "true")
    try:
        df = tables.load_table(spark, path, encoding="windows-1251")
        assert [(str(r[0]), r[1], r[2]) for r in df.orderBy("value").collect()] == [
            ("2024-01-01", 'Ёж, "Ъ"', 1.5), ("2024-01-02", "я", 2.5)]
    finally:
        spark.conf.unset("spark.sql.legacy.javaCharsets")
    text = spark.createDataFrame([("2024-01-01", 1.0), ("2024-02-01", 2.0)], "d string, v double")
    tables.write_parquet(text, str(tmp_path / "t.parquet"))
    loaded = tables.load_table(spark, str(tmp_path / "t.parquet"))
    assert dict(loaded.dtypes)["d"].startswith("timestamp") and loaded.count() == 2
    assert dict(tables.load_table(spark, str(tmp_path / "t.parquet"), dates=False).dtypes)["d"] == "string"


def test_two_versions_of_a_table(spark):
    import numpy as np
    import pandas as pd

    from statweave.operators import drift

    rng = np.random.default_rng(14)

    def version(n, regions, rating_gap, income, **extra):
        rating = rng.normal(4, 0.5, n)
        rating[: int(n * rating_gap)] = np.nan
        pdf = pd.DataFrame({
            "Day": pd.date_range("2024-01-01", periods=n).strftime("%Y-%m-%d"), "Region": rng.choice(regions, n),
            "Store": rng.choice(["mall", "street"], n, p=extra["store"]), "Spend": rng.normal(1000, 200, n),
            "Rating": rating, "Income": rng.normal(income, 2000, n), extra["own"]: rng.normal(size=n),
        })
        return clean.promote_dates(spark.createDataFrame(pdf))

    a = version(400, ["N", "S", "W"], 0.1, 10_000, store=[0.5, 0.5], own="Old")
    b = version(440, ["N", "S", "W", "East"], 0.4, 4_000, store=[0.1, 0.9], own="New")
    assert drift.structure_rows(a, b).first().asDict() == {
        "rows_base": 400, "rows_compare": 440, "rows_delta": 40, "rows_delta_percent": 10.0}
    assert rows(drift.structure_columns(a, b).select("column", "change")) == [("New", "added"), ("Old", "removed")]
    quality = {r["column"]: r for r in drift.quality(a, b).collect()}
    assert (quality["Rating"]["missing_base_pct"], quality["Rating"]["missing_compare_pct"]) == (10.0, 40.0)
    assert quality["Rating"]["degraded"] and quality["Region"]["first_new_categories"] == ["East"]
    assert (quality["Region"]["new_category_count"], quality["Store"]["new_category_count"]) == (1, 0)
    numeric = {r["column"]: r["verdict"] for r in drift.numeric_drift(a, b).collect()}
    assert numeric["Income"] == "significant_decrease" and numeric["Rating"] == "no_difference"
    assert all(r["drifted"] for r in drift.categorical_drift(a, b).collect())
    shares = drift.category_shares(a, b).where("column = 'Region'").collect()
    assert math.isclose(sum(r["compare_share"] for r in shares), 1.0) and len(shares) == 4
    assert len(drift.compare_datasets(a, b)) == 6
