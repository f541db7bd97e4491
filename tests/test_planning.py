"""Plans stay small however many ranges a table may be cut into, and can be made at all over joined tables."""

import time

import pytest

from conftest import rows
from statweave.operators import forecast, hypothesis, regression, timeseries
from statweave.plans.ordered import running

DAYS = "timestamp_ntz'2024-01-01' + make_dt_interval(int(id % 40))"


def series(spark):
    return spark.range(200).selectExpr("cast(id % 5 AS string) AS g", f"{DAYS} AS day", "sin(id) + id % 7 AS v")


def pairs(spark):
    return spark.range(200).selectExpr("cast(id % 3 AS string) AS g", "id % 11 / 10D AS a", "id % 7 / 10D AS b")


def fit(spark):
    return regression.fit_linear(pairs(spark), "a", ["b"])


OPERATORS = {
    "holt": lambda s: forecast.holt(series(s), "day", "v", 7, ["g"]).forecast,
    "holt model": lambda s: forecast.holt(series(s), "day", "v", 7, ["g"]).model,
    "arima": lambda s: forecast.arima(series(s), "day", "v", 7, group_by=["g"]).forecast,
    "arima model": lambda s: forecast.arima(series(s), "day", "v", 7, group_by=["g"]).model,
    "monthly median": lambda s: timeseries.resample(series(s), "day", "v", "MS", "median", "ffill"),
    "residual normality": lambda s: regression.residual_normality(fit(s)),
    "wilcoxon": lambda s: hypothesis.wilcoxon(pairs(s), "a", "b"),
    "wilcoxon in groups": lambda s: hypothesis.wilcoxon(pairs(s), "a", "b", ["g"]),
}


@pytest.fixture
def many_partitions(spark):
    """800 ranges at most, so that the search for a row's range takes ten steps."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("name", OPERATORS)
def test_planning_does_not_grow_with_the_steps_of_the_search(spark, many_partitions, name):
    found = OPERATORS[name](spark)
    began = time.time()
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert time.time() - began < 10 and plan.count("\n") < 2_000


def test_filters_and_joins_on_ranges_keep_the_totals(spark):
    """A constant key beside one with a NULL, filters on keys and totals, and a join by the running total."""
    df = spark.range(3_000).selectExpr("if(id % 3 = 0, NULL, id % 3) AS k", "'c' AS c", "id AS x", "1L AS one")
    for limit in (100, 1_000_000):
        run = running(df, ["k", "c"], "x", ["one"], rows=limit)
        kept = run.where("c = 'c' AND tot_one = 1000 AND cum_one <= 2 AND (k IS NULL OR k = 2)")
        assert rows(kept.select("k", "x", "cum_one")) == sorted([(None, 0, 1), (None, 3, 2), (2, 2, 1), (2, 5, 2)], key=repr)
        joined = run.join(spark.createDataFrame([(5, "five")], "cum_one long, word string"), "cum_one")
        assert rows(joined.select("x", "word")) == [(12, "five"), (13, "five"), (14, "five")]


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_chi_square_of_joined_tables(spark, keys):
    left = spark.range(120).selectExpr("id", "id % 3 AS a", "cast(id % 2 AS string) AS g")
    right = spark.range(120).selectExpr("id", "id * id % 4 + id % 2 AS b")
    joined = left.join(right, "id")
    plain = spark.createDataFrame([(r.a, r.g, r.b) for r in joined.collect()], "a long, g string, b long")
    got, want = (rows(hypothesis.chi_square(df, "a", "b", keys)) for df in (joined, plain))
    assert got == want and len(got) == max(1, 2 * len(keys))
