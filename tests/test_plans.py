"""Order, quantiles and joins do not depend on how the rows are cut up."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from statweave.operators import clean, describe, distfit, drift, hypothesis, timeseries
from statweave.plans import joins
from statweave.plans.joins import attach, hot_keys, join_by_value
from statweave.plans.ordered import blocks, bucketed, running, with_next
from statweave.plans.quantiles import exact_quantiles
from statweave.sources import tables


@pytest.fixture(scope="module")
def skewed(spark):
    """Three groups; one holds most rows, and one value holds a third of them."""
    rng = np.random.default_rng(7)
    g = rng.choice(["a", "b", "c"], size=20_000, p=[0.8, 0.15, 0.05])
    x = np.where(rng.random(20_000) < 0.33, 5.0, np.round(rng.normal(10, 4, 20_000), 3))
    return pd.DataFrame({"g": g, "x": x})


@pytest.mark.parametrize("limit", [100, 1_000, 1_000_000])
def test_running_totals(spark, skewed, limit):
    counts = skewed.groupby(["g", "x"]).size().rename("w").reset_index()
    got = running(spark.createDataFrame(counts), ["g"], "x", ["w"], rows=limit).toPandas()
    want = counts.sort_values(["g", "x"]).assign(
        cum_w=lambda d: d.groupby("g")["w"].cumsum(), tot_w=lambda d: d.groupby("g")["w"].transform("sum")
    )
    got = got.sort_values(["g", "x"]).reset_index(drop=True)[list(want.columns)]
    pd.testing.assert_frame_equal(got, want.reset_index(drop=True), check_dtype=False)


@pytest.mark.parametrize("limit", [100, 1_000_000])
def test_running_totals_without_keys_and_over_text(spark, limit):
    words = pd.DataFrame({"v": [f"http://example/{i * 7919 % 5000:05d}" for i in range(5000)], "one": 1})
    got = running(spark.createDataFrame(words), [], "v", ["one"], rows=limit).toPandas()
    want = words.sort_values("v").reset_index(drop=True)
    assert list(got.sort_values("cum_one")["v"]) == list(want["v"])
    assert set(got["tot_one"]) == {5000}


@pytest.mark.parametrize("limit", [50, 1_000_000])
def test_next_row(spark, limit):
    frame = pd.DataFrame({"k": ["a"] * 900 + ["b"] * 30, "t": list(range(0, 1800, 2)) + list(range(30))})
    got = with_next(spark.createDataFrame(frame), ["k"], "t", ["t"], rows=limit).toPandas()
    got = got.sort_values(["k", "t"])
    want = frame.groupby("k")["t"].shift(-1)
    assert got["next_t"].fillna(-1).tolist() == want.fillna(-1).tolist()


def bucket_sizes(df, keys, order, limit):
    return [r["count"] for r in bucketed(df, keys, order, limit).groupBy(*keys, "_b").count().collect()]


@pytest.mark.parametrize("kind", ["one first value", "text in groups", "mixed", "hot value"])
def test_buckets_are_cut_down_the_whole_tuple(spark, kind):
    """Ties in the first order columns, text and groups leave no bucket far above the limit."""
    i = F.col("id")
    df, keys, order = {
        "one first value": (spark.range(50_000).select(F.lit("g").alias("g"), F.lit(7).alias("a"), i.alias("b")), ["g"], ["a", "b"]),
        "text in groups": (spark.range(50_000).select((i % 2).alias("g"), F.concat(F.lit("https://example.org/"), F.lpad(i.cast("string"), 9, "0")).alias("a")), ["g"], ["a"]),
        "mixed": (spark.range(50_000).select(F.when(i % 3 > 0, F.lit("x")).alias("a"), F.when(i % 5 > 0, (i % 4).cast("double")).alias("b"), i.alias("c")), [], ["a", "b", "c"]),
        "hot value": (spark.range(50_000).select(F.when(i < 40_000, 5).otherwise(i).alias("a"), F.xxhash64("id").alias("b")), [], ["a", "b"]),
    }[kind]
    sizes = bucket_sizes(df, keys, order, 1000)
    assert sum(sizes) == 50_000 and max(sizes) <= 2000
    one = df.withColumn("one", F.lit(1))
    got = sorted(tuple(r) for r in running(one, keys, order, ["one"], rows=1000).select(*keys, "cum_one", "tot_one").collect())
    want = {}
    for r in df.select(*keys).collect() if keys else [()] * 50_000:
        want[tuple(r)] = want.get(tuple(r), 0) + 1
    assert got == sorted((*k, c, n) for k, n in want.items() for c in range(1, n + 1))
    by = [f"`{o}` NULLS FIRST" for o in order]
    part = f"PARTITION BY {', '.join(keys)} " if keys else ""
    plain = df.selectExpr("*", f"lead(struct({', '.join(order)})) OVER ({part}ORDER BY {', '.join(by)}) AS want")
    cut = with_next(df, keys, order, order, rows=1000)
    same = plain.join(cut, [plain[c].eqNullSafe(cut[c]) for c in [*keys, *order]])
    assert same.where(" OR ".join(f"NOT (next_{o} <=> want.{o})" for o in order)).count() == 0 and same.count() == 50_000


def test_small_tables_and_few_distinct_rows(spark):
    assert bucket_sizes(spark.range(900), [], "id", 1000) == [900]
    tied = spark.range(20_000).select((F.col("id") % 10).alias("v"))  # ten rows, each repeated: drawn together
    assert sum(sizes := bucket_sizes(tied, [], "v", 1000)) == 20_000 and len(sizes) > 1 and all(n % 2000 == 0 for n in sizes)
    assert bucket_sizes(spark.range(0), [], "id", 10) == []


def test_hot_group_is_spread(spark):
    """300,000 groups, one with half of all rows: tasks come out even, and only the list of hot keys is broadcast."""
    i = F.col("id")
    rows = spark.range(600_000).select(F.when(i % 2 == 0, -1).otherwise(i).alias("g"), i.alias("x"))
    stats = rows.groupBy("g").agg(F.max("x").alias("top"))
    hot = hot_keys(rows, ["g"]).collect()
    assert len(hot) == 1 and hot[0]["_pieces"] == 64
    joined = attach(rows, stats, ["g"])
    sizes = [r["count"] for r in joined.groupBy(F.spark_partition_id().alias("p")).count().collect()]
    assert sum(sizes) == 600_000 and max(sizes) <= 2 * 600_000 / len(sizes)
    assert joined.where("NOT (top <=> if(g = -1, 599998, g))").count() == 0
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("strategy=broadcast") == 2 and joins.HOT_SHARE == 1000
    skewed_nulls = spark.createDataFrame([(None, k) for k in range(400)] + [(1, 5)], "g int, x int")
    got = attach(skewed_nulls, skewed_nulls.groupBy("g").agg(F.max("x").alias("m")), ["g"]).collect()
    assert len(got) == 401 and {(r.g, r.m) for r in got} == {(None, 399), (1, 5)}


def test_blocks_overlap_by_the_lags(spark):
    cut = blocks(spark.range(100).withColumnRenamed("id", "pos"), "pos", 30, 4).toPandas()
    for block, part in cut.groupby("_block"):
        inside = sorted(part.loc[~part["_halo"], "pos"])
        halo = sorted(part.loc[part["_halo"], "pos"])
        assert halo == [p for p in range(block * 30 - 4, block * 30) if p >= 0]
        assert inside == list(range(block * 30, min(100, block * 30 + 30)))


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_exact_quantiles(spark, skewed, partitions):
    probs = [0.0, 0.1, 0.25, 0.5, 0.9, 0.999, 1.0]
    df = spark.createDataFrame(skewed).repartition(partitions)
    whole = exact_quantiles(df, ["x"], probs).first()
    assert whole["n"] == len(skewed)
    np.testing.assert_allclose(whole["q"], np.quantile(skewed["x"], probs), rtol=1e-12)
    for row in exact_quantiles(df, ["x"], probs, ["g"]).collect():
        np.testing.assert_allclose(row["q"], np.quantile(skewed.loc[skewed["g"] == row["g"], "x"], probs), rtol=1e-12)


def test_quantiles_of_nothing(spark):
    df = spark.createDataFrame([(None, 1.0), (None, float("nan"))], "a double, b double")
    found = {r["column"]: r for r in exact_quantiles(df, ["a", "b"], [0.5]).collect()}
    assert found["a"]["n"] == 0 and found["a"]["q"] == [None]
    assert found["b"]["n"] == 1 and found["b"]["q"] == [1.0]


def test_join_by_value_with_hot_values(spark):
    values = spark.range(3000).select(F.when(F.col("id") < 1500, 0).otherwise(F.col("id") % 700 + 1).alias("v"))
    table = values.groupBy("v").agg(F.count(F.lit(1)).alias("w")).withColumn("code", F.col("v") * 10)
    joined = join_by_value(values, table, ["v"], "w", hot_share=100)
    assert joined.count() == 3000
    assert joined.where("code != v * 10 or code is null").count() == 0


def test_plan_has_no_single_task_sort_and_scans_once(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet")
    out = exact_quantiles(df, ["l_quantity"], [0.5], ["l_returnflag"])
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Exchange SinglePartition" not in plan
    assert plan.count("FileScan") == 1
    assert "ReadSchema: struct<l_quantity:double,l_returnflag:string>" in plan


def test_group_columns_may_have_any_name(spark):
    """Each operator with a group column that bears one of its own names."""
    rows = [(f"g{i % 2}", float(i % 7), float(i * i % 11), f"{i % 3}") for i in range(60)]
    df = spark.createDataFrame(rows, ["key", "m1", "m2", "c"])
    for name, operator in (
        ("column", lambda d, k: describe.describe(d, ["m1", "m2"], group_by=[k])),
        ("x", lambda d, k: describe.correlation(d, method="spearman", columns=["m1", "m2"], group_by=[k])),
        ("w", lambda d, k: describe.histogram(d, ["m1"], group_by=[k])),
        ("q", lambda d, k: describe.box_summary(d, ["m1"], group_by=[k])),
        ("value", lambda d, k: describe.value_counts(d, ["c"], group_by=[k])),
        ("k.`1", lambda d, k: clean.scale_standard(d, ["m1"], group_by=[k])),
        ("n", lambda d, k: hypothesis.shapiro(d, ["m1"], group_by=[k])),
    ):
        plain, renamed = operator(df, "key"), operator(df.withColumnRenamed("key", name), name)
        assert sorted(map(repr, map(tuple, plain.collect()))) == sorted(map(repr, map(tuple, renamed.collect())))


def test_quantiles_beside_infinities(spark):
    inf = float("inf")
    df = spark.createDataFrame([(1.0, "a"), (2.0, "a"), (inf, "a"), (-inf, "b"), (3.0, "b"), (4.0, "b")], ["v", "g"])
    assert exact_quantiles(df, ["v"], [0.0, 0.2, 0.4, 0.6, 1.0]).first().q == [-inf, 1.0, 2.0, 3.0, inf]
    assert {r.g: r.q for r in exact_quantiles(df, ["v"], [0.5], ["g"]).collect()} == {"a": [2.0], "b": [3.0]}


def test_separator_beside_quoted_fields(spark, tmp_path):
    (tmp_path / "t.csv").write_text('name;val\n"x,y,z";1\n"a;b";2\n"say ""hi; you""";3\n')
    assert tables.detect_separator(spark, str(tmp_path / "t.csv")) == ";"
    assert tables.read_delimited(spark, str(tmp_path / "t.csv")).columns == ["name", "val"]


def test_text_dates_in_time_series(spark):
    rows = [(f"1/{d}/2024", float(d)) for d in range(1, 21) if d != 7]
    df = spark.createDataFrame(rows, ["day", "v"])
    found = timeseries.validate_series(df, "day", "v").first()
    assert found.total_points == 19 and found.is_valid is not None
    assert timeseries.resample(df, "day", "v", freq="D").count() == 20


def test_poisson_bins_of_large_numbers(spark):
    ids = spark.range(1000).select((F.col("id") + 10**10).alias("v"))
    assert distfit.fit_distributions(ids, ["v"], candidates=["poisson"]).first().status == "no_fit"
    for mean in (3.0, 900.0):
        rng = np.random.default_rng(int(mean))
        drawn = spark.createDataFrame([(int(x),) for x in rng.poisson(mean, 2000)], ["v"])
        fit = distfit.fit_distributions(drawn, ["v"], candidates=["poisson"]).first()
        assert fit.params["lambda"] == pytest.approx(mean, rel=0.05) and fit.p_value > 0.001
    skewed = spark.createDataFrame([(int(x),) for x in np.random.default_rng(1).geometric(0.1, 2000)], ["v"])
    assert distfit.fit_distributions(skewed, ["v"], candidates=["poisson"]).first().p_value < 1e-9


def merged_bins(values):
    """The rule, step by step: bins in rising order until 5 are expected, the rest to the last."""
    import math

    n, lam, seen = len(values), sum(values) / len(values), sorted(set(values))
    law = lambda k: math.exp(k * math.log(lam) - lam - math.lgamma(k + 1))
    below = lambda x: n * sum(law(k) for k in range(int(x)))
    bins, o, e = [], 0, 0.0
    for i, x in enumerate(seen):
        o += values.count(x)
        e += (below(seen[i + 1]) if i + 1 < len(seen) else n) - (below(x) if i else 0)
        if e >= 5:
            bins.append([o, e])
            o, e = 0, 0.0
    if bins and (o or e):
        bins[-1] = [bins[-1][0] + o, bins[-1][1] + e]
    return lam, sum((o - e) ** 2 / e for o, e in bins), len(bins)


@pytest.mark.parametrize("mean, size", [(4, 25), (4, 15), (4, 12), (0.7, 200), (30, 400), (3, 5)])
def test_poisson_bins_follow_one_another(spark, mean, size):
    groups = {g: [int(x) for x in np.random.default_rng(g).poisson(mean, size)] for g in range(4)}
    df = spark.createDataFrame([(g, x) for g, xs in groups.items() for x in xs], ["g", "x"])
    got = {r.g: r for r in distfit.fit_distributions(df, ["x"], ["g"], candidates=["poisson"]).collect() if r.status == "ok"}
    for g, xs in groups.items():
        lam, chi2, bins = merged_bins(xs)
        assert (g in got) == (bins > 2), (g, bins)
        if g in got:
            assert got[g].params["lambda"] == pytest.approx(lam) and got[g].statistic == pytest.approx(chi2, rel=1e-6)


def test_buckets_are_searched_in_generated_code(spark):
    """No higher-order function, which Spark interprets row by row, places a row; the plan stays short."""
    df = spark.range(500).select(F.col("id").alias("t"), (F.col("id") % 3).alias("k"))
    for found in (running(df, ["k"], "t", ["t"], rows=50), with_next(df, ["k"], "t", ["t"], rows=50)):
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert "lambdafunction" not in plan and len(plan) < 100_000


@pytest.mark.parametrize("limit", [40, 1_000_000])
def test_next_row_with_ties_and_missing(spark, limit):
    """Keys and order values that are missing or repeated, with cuts through both."""
    rows = [(k, t, i) for i, (k, t) in enumerate((k, t) for k in (None, "a", "b") for t in [None] + [v // 2 for v in range(300)])]
    df = spark.createDataFrame(rows, "k string, t int, i int")
    got = with_next(df, ["k"], ["t", "i"], ["i"], rows=limit).collect()
    assert {(r.i, r.next_i) for r in got} == {(i, i + 1 if i % 301 < 300 else None) for _, _, i in rows} and len(got) == len(rows)
    sums = running(df.withColumn("one", F.lit(1)), ["k"], ["t", "i"], ["one"], rows=limit).collect()
    assert {(r.i, r.cum_one, r.tot_one) for r in sums} == {(i, i % 301 + 1, 301) for _, _, i in rows}


def test_psi_bins_run_no_function_per_row_and_are_right(spark):
    """Deciles with ties, values outside their range, infinities."""
    a = [float(i // 3) for i in range(30)] + [4.0] * 20 + [float("inf")]
    b = [i / 2 - 3 for i in range(40)] + [float("-inf"), float("inf"), 4.0]
    make = lambda v: spark.createDataFrame([(x,) for x in v], "x double")
    for out in (drift.psi(make(a), make(b)), drift.numeric_drift(make(a), make(b))):
        assert "filter(" not in out._jdf.queryExecution().optimizedPlan().toString()
        edges = np.unique(np.sort(a)[[len(a) // 10 * k for k in range(11)]])

        def shares(v):
            held = [sum(lo <= x and (x <= hi if k == len(edges) - 2 else x < hi) for x in v) for k, (lo, hi) in enumerate(zip(edges, edges[1:]))]
            return [n / len(v) if n else 0.0001 for n in held]

        want = sum((q - p) * np.log(q / p) for p, q in zip(shares(a), shares(b)))
        assert out.first()["psi"] == pytest.approx(want, rel=1e-9)
