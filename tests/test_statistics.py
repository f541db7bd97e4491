"""Tests against direct computation on small samples."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from statweave.functions import closed
from statweave.functions.tails import normal_quantile
from statweave.operators import describe, distfit, drift, hypothesis, regression

SHAPIRO_EXAMPLE = [148.0, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]


def frame(spark, **columns):
    return spark.createDataFrame(pd.DataFrame(columns))


def test_shapiro_example(spark):
    row = hypothesis.shapiro(frame(spark, v=SHAPIRO_EXAMPLE)).first()
    assert row["statistic"] == pytest.approx(0.788815, abs=1e-6)
    assert row["p_value"] == pytest.approx(0.006704, abs=1e-6)
    assert closed.shapiro_of_counts(sorted(SHAPIRO_EXAMPLE), [1] * 11)[0] == pytest.approx(row["statistic"])


@pytest.mark.parametrize("decimals", [0, 3])
def test_shapiro_with_ties(spark, decimals):
    x = np.round(np.random.default_rng(1).normal(100, 2, 400), decimals)
    row = hypothesis.shapiro(frame(spark, v=x)).first()
    values, counts = np.unique(x, return_counts=True)
    w, p = closed.shapiro_of_counts(values, counts)
    assert (row["statistic"], row["p_value"]) == (pytest.approx(w, rel=1e-9), pytest.approx(p, rel=1e-6))


@pytest.mark.parametrize("start,end", [(0, 90_000), (10_000, 60_000), (0, 200_000), (150_000, 200_000), (1_000, 40_000)])
def test_scores_of_a_value_with_many_copies(start, end):
    n = 200_000
    exact = hypothesis._exact_scores(np.array([start]), np.array([end - start]), np.array([float(n)]))
    quick = hypothesis._run_scores(float(start), float(end), float(n))
    assert quick == pytest.approx((exact[0][0], exact[1][0]), rel=1e-10, abs=1e-8)


def test_shapiro_edges(spark):
    df = spark.createDataFrame([("k", 5.0)] * 4 + [("two", 1.0), ("two", 2.0)], "g string, v double")
    got = {r["g"]: r for r in hypothesis.shapiro(df, ["v"], ["g"]).collect()}
    assert (got["k"]["statistic"], got["k"]["p_value"]) == (1.0, 1.0)
    assert got["two"]["statistic"] is None


def test_rank_identities(spark):
    rng = np.random.default_rng(2)
    a, b = np.round(rng.normal(0, 1, 700), 1), np.round(rng.normal(0.2, 1, 700), 1)
    df = frame(spark, a=a, b=b)
    u_ab = hypothesis.mann_whitney(hypothesis.samples_of_columns(df, "a", "b")).first()
    u_ba = hypothesis.mann_whitney(hypothesis.samples_of_columns(df, "b", "a")).first()
    assert u_ab["statistic"] + u_ba["statistic"] == 700 * 700
    direct = (a[:, None] > b[None, :]).sum() + 0.5 * (a[:, None] == b[None, :]).sum()
    assert u_ab["statistic"] == direct
    d = hypothesis.ks_two_sample(hypothesis.samples_of_columns(df, "a", "b")).first()["statistic"]
    grid = np.unique(np.concatenate([a, b]))
    assert d == pytest.approx(max(abs((a <= g).mean() - (b <= g).mean()) for g in grid))


@pytest.mark.parametrize("make,expected", [
    (lambda r: (r.normal(0, 1, 60), r.normal(0, 1, 60)), "student"),
    (lambda r: (r.normal(0, 1, 60), r.normal(0, 9, 60)), "welch"),
    (lambda r: (r.exponential(1, 60), r.normal(0, 1, 60)), "mann_whitney"),
    (lambda r: (r.normal(0, 1, 60), np.r_[r.normal(0, 1, 6), [np.nan] * 54]), "mann_whitney"),
    (lambda r: (r.normal(0, 1, 500), r.normal(0, 1, 500)), "student"),
    (lambda r: (np.r_[[1.0, 2.0], [np.nan] * 8], r.normal(0, 1, 10)), None),
])
def test_decision_tree(spark, make, expected):
    a, b = make(np.random.default_rng(11))
    row = hypothesis.compare(hypothesis.samples_of_columns(frame(spark, a=a, b=b), "a", "b")).first()
    assert row["test"] == expected
    if expected in ("student", "welch"):
        other = (hypothesis.student_t if expected == "student" else hypothesis.welch_t)(
            hypothesis.samples_of_columns(frame(spark, a=a, b=b), "a", "b")).first()
        assert row["statistic"] == pytest.approx(other["statistic"]) and row["p_value"] == pytest.approx(other["p_value"])


def test_constant_samples(spark):
    df = frame(spark, a=[1.0] * 20, b=[1.0] * 20)
    # A constant sample passes the normality test and has no variance to compare.
    row = hypothesis.compare(hypothesis.samples_of_columns(df, "a", "b")).first()
    assert (row["test"], row["p_value"], row["effect_size"]) == ("welch", None, 0.0)
    ranks = hypothesis.mann_whitney(hypothesis.samples_of_columns(df, "a", "b")).first()
    assert (ranks["statistic"], ranks["p_value"]) == (200.0, 1.0)
    assert hypothesis.normality_k2(df, ["a"]).first()["statistic"] is None


def test_wilcoxon_by_hand(spark):
    d = np.array([1.0, -2, 2, 3, 0, -1, 5, 5, 6, 0, 7, -8, 9, 10, 11])
    row = hypothesis.wilcoxon(frame(spark, a=d, b=np.zeros(len(d))), "a", "b").first()
    v = d[d != 0]
    ranks = pd.Series(np.abs(v)).rank().to_numpy()
    t = min(ranks[v > 0].sum(), ranks[v < 0].sum())
    n, ties = len(v), sum(c**3 - c for c in pd.Series(np.abs(v)).value_counts())
    z = (t - n * (n + 1) / 4) / math.sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24)
    assert (row["n"], row["statistic"]) == (n, t)
    assert row["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_chi_square_refuses_many_numbers_and_single_rows(spark):
    df = frame(spark, a=list(range(30)), b=["x", "y"] * 15)
    with pytest.raises(ValueError):
        hypothesis.chi_square(df, "a", "b")
    one = frame(spark, a=["p"] * 4, b=["x", "y"] * 2)
    assert hypothesis.chi_square(one, "a", "b").first()["chi2"] is None


def test_correction_is_monotone(spark):
    p = [0.001, 0.04, 0.03, 0.9, 0.2, None]
    out = hypothesis.benjamini_hochberg(frame(spark, i=list(range(6)), p_value=pd.Series(p, dtype=float))).orderBy("p_value").collect()
    got = [r for r in out if not math.isnan(r["p_value"])]
    assert [r["p_corrected"] for r in got] == pytest.approx([0.005, 0.04 * 5 / 3, 0.04 * 5 / 3, 0.25, 0.9])
    assert all(r["p_corrected"] >= r["p_value"] for r in got)
    assert [r["p_corrected"] for r in out if math.isnan(r["p_value"])] == [None]


# -- drift -----------------------------------------------------------------------

def numpy_psi(a, b):
    edges = np.unique(np.percentile(a, np.linspace(0, 100, 11)))
    pa, pb = (np.histogram(v, bins=edges)[0] / len(v) for v in (a, b))
    pa, pb = (np.where(p == 0, 0.0001, p) for p in (pa, pb))
    return float(((pb - pa) * np.log(pb / pa)).sum())


@pytest.mark.parametrize("shift", [0.0, 0.5, 3.0])
def test_psi(spark, shift):
    rng = np.random.default_rng(5)
    a, b = np.round(rng.normal(0, 1, 800), 1), np.round(rng.normal(shift, 1, 500), 1)
    row = drift.psi(frame(spark, x=a), frame(spark, x=b)).first()
    assert row["psi"] == pytest.approx(numpy_psi(a, b), rel=1e-9)


def test_psi_of_the_same_data_and_of_few_or_constant_values(spark):
    x = np.random.default_rng(0).normal(size=50)
    assert drift.psi(frame(spark, x=x), frame(spark, x=x)).first()["psi"] == 0.0
    assert drift.psi(frame(spark, x=x[:9]), frame(spark, x=x)).first()["psi"] == 0.0
    assert drift.psi(frame(spark, x=[1.0] * 20), frame(spark, x=x)).first()["psi"] == 0.0


def test_paired_drift(spark):
    rng = np.random.default_rng(3)
    n = 200
    a = pd.DataFrame({"id": np.arange(n), "x": rng.normal(10, 1, n), "y": rng.exponential(1, n), "z": [1.0] * n})
    b = a.assign(x=a["x"] + rng.normal(0.5, 0.2, n), y=a["y"] * rng.exponential(1, n), z=[1.0] * n)
    got = {r["column"]: r for r in drift.numeric_drift(spark.createDataFrame(a), spark.createDataFrame(b), "id").collect()}
    assert (got["x"]["test"], got["y"]["test"], got["id"]["is_paired"]) == ("paired_t", "wilcoxon", False)
    d = (a["x"] - b["x"]).to_numpy()
    assert got["x"]["statistic"] == pytest.approx(d.mean() / (d.std(ddof=1) / math.sqrt(n)))
    assert got["x"]["effect_size"] == pytest.approx(abs(d.mean() / d.std(ddof=1)))
    assert got["x"]["verdict"] == "significant_increase" and got["z"]["verdict"] == "no_difference"
    twice = pd.concat([a, a.head(1)])
    row = drift.numeric_drift(spark.createDataFrame(twice), spark.createDataFrame(b), "id", ["x"]).first()
    assert (row["is_paired"], row["paired_cancelled_reason"]) == (False, "duplicate_ids")


def test_drift_without_common_columns(spark):
    with pytest.raises(ValueError):
        drift.numeric_drift(frame(spark, a=[1.0]), frame(spark, b=[1.0]))
    row = drift.numeric_drift(frame(spark, a=[1.0, 2.0]), frame(spark, a=[1.0, 5.0])).first()
    assert (row["verdict"], row["test"], row["psi"]) == ("insufficient_data", None, 0.0)


# -- regression --------------------------------------------------------------------

def test_regression_recovers_a_line_and_ridge_matches_its_definition(spark):
    rng = np.random.default_rng(8)
    x1, x2 = rng.normal(5, 2, 40), rng.normal(0, 3, 40)
    y = 2 + 0.15 * x1 - 0.3 * x2 + rng.normal(0, 0.1, 40)
    fit = regression.fit_linear(frame(spark, x1=x1, x2=x2, y=y), "y", ["x1", "x2"])
    design = np.column_stack([np.ones(40), x1, x2])
    beta, sse, *_ = np.linalg.lstsq(design, y, rcond=None)
    got = {r["term"]: r for r in regression.coefficients(fit).collect()}
    assert [got[t]["coefficient"] for t in ("const", "x1", "x2")] == pytest.approx(list(beta))
    se = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * sse[0] / 37)
    assert [got[t]["std_error"] for t in ("const", "x1", "x2")] == pytest.approx(list(se))
    raw = design[:, 1:]
    inverse = np.linalg.inv(raw.T @ raw)
    assert got["x1"]["vif"] == pytest.approx(inverse[0, 0] * (raw.T @ raw)[0, 0])
    z = (raw - raw.mean(0)) / raw.std(0)
    w = np.linalg.solve(z.T @ z + np.eye(2), z.T @ (y - y.mean()))
    fitted = y.mean() + z @ w
    model = regression.predictive_model(fit).first()
    assert model["model"] == "ridge"
    assert model["mae"] == pytest.approx(np.abs(y - fitted).mean())
    assert model["rmse"] == pytest.approx(math.sqrt(((y - fitted) ** 2).mean()))
    scored = regression.predict(fit, frame(spark, x1=[1.0], x2=[2.0])).first()["y_predicted"]
    assert scored == pytest.approx(float(y.mean() + ((np.array([1.0, 2.0]) - raw.mean(0)) / raw.std(0)) @ w))
    plain = regression.fit_linear(frame(spark, x1=x1, x2=x2, y=y), "y", ["x1", "x2"], ridge_below=0)
    for model, want in (("ridge", scored), ("predictive", float(beta @ [1.0, 1.0, 2.0])), ("ols", float(beta @ [1.0, 1.0, 2.0]))):
        assert regression.predict(plain, frame(spark, x1=[1.0], x2=[2.0]), model).first()["y_predicted"] == pytest.approx(want)
    line = regression.fitted_line(fit, ["x1", "x2"]).toPandas()
    assert sorted(line["position"]) == list(range(40)) and list(line.sort_values("position")["x1"]) == sorted(raw[:, 0])
    band = regression.confidence_band(fit).toPandas()
    assert ((band["ci_lower"] < band["y_predicted"]) & (band["y_predicted"] < band["ci_upper"])).all()


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_durbin_watson_needs_only_the_order(spark, partitions):
    rng = np.random.default_rng(4)
    n = 3000
    x, e = rng.normal(size=n), np.cumsum(rng.normal(size=n)) * 0.1
    df = frame(spark, t=np.arange(n), x=x, y=1 + x + e).repartition(partitions)
    fit = regression.fit_linear(df, "y", ["x"], order_by=["t"])
    design = np.column_stack([np.ones(n), x])
    r = (1 + x + e) - design @ np.linalg.lstsq(design, 1 + x + e, rcond=None)[0]
    row = regression.durbin_watson(fit, ["t"]).first()
    assert row["durbin_watson"] == pytest.approx((np.diff(r) ** 2).sum() / (r**2).sum())
    assert row["dw_label"] == "positive"


def test_regression_checks_its_columns(spark):
    with pytest.raises(ValueError):
        regression.fit_linear(frame(spark, x=["a"], y=[1.0]), "y", ["x"])
    with pytest.raises(ValueError):
        regression.fit_linear(frame(spark, y=[1.0]), "y", ["x"])
    small = regression.fit_linear(frame(spark, x=[1.0, 2.0], y=[1.0, 2.0]), "y", ["x"])
    assert regression.coefficients(small).count() == 0


# -- distributions -------------------------------------------------------------------

def test_lognormal_parameters(spark):
    rng = np.random.default_rng(6)
    x = 10 + np.exp(rng.normal(1.0, 0.5, 4000))
    row = distfit.fit_distributions(frame(spark, x=x), candidates=("lognorm", "norm")).where("is_best").first()
    assert row["distribution"] == "lognorm"
    assert row["params"]["loc"] == pytest.approx(10, abs=0.15)
    assert row["params"]["s"] == pytest.approx(0.5, abs=0.05)
    # The profile likelihood cannot be beaten much by a fine search.
    def loss(loc):
        l = np.log(x - loc)
        return math.log(l.std()) + l.mean()
    best = min(loss(v) for v in np.linspace(9, x.min() - 1e-4, 4000))
    assert loss(row["params"]["loc"]) <= best + 1e-5


def test_poisson(spark):
    x = np.random.default_rng(9).poisson(3.2, 500)
    row = distfit.fit_distributions(frame(spark, x=x), candidates=("poisson",)).first()
    lam = x.mean()
    values, counts = np.unique(x, return_counts=True)
    pmf = lambda k: math.exp(k * math.log(lam) - lam - math.lgamma(k + 1))
    expected, low = [], 0
    for v in values:
        expected.append(sum(pmf(k) for k in range(low, v + 1)) * 500)
        low = v + 1
    expected[-1] += 500 - sum(expected)
    o_bins, e_bins, o, e = [], [], 0.0, 0.0
    for a, b in zip(counts, expected):
        o, e = o + a, e + b
        if e >= 5:
            o_bins.append(o)
            e_bins.append(e)
            o = e = 0.0
    o_bins[-1] += o
    e_bins[-1] += e
    want = sum((a - b) ** 2 / b for a, b in zip(o_bins, e_bins))
    assert row["statistic"] == pytest.approx(want) and row["params"]["lambda"] == pytest.approx(lam)
    assert row["p_value"] > 0.001
    none = distfit.fit_distributions(frame(spark, x=[0.5, 1.5, -1.0, 2.0, 3.0]))
    assert rows(none.select("distribution")) == [("expon",), ("norm",)]
    few = distfit.fit_distributions(frame(spark, x=[1.0, 2.0, 3.0, 4.0]))
    assert rows(few.select("column", "distribution", "is_best", "status")) == [("x", None, False, "too_few_values")]
    assert distfit.density_curve(frame(spark, x=[1.0, 2.0, 3.0, 4.0]), few).count() == 0


def test_histogram_keeps_empty_bins_and_the_total(spark):
    x = [0.0, 1.0, 1.0, 10.0, None]
    out = describe.histogram(spark.createDataFrame([(v,) for v in x], "x double"), bins=5)
    assert [r["count"] for r in out.orderBy("bin").collect()] == [3, 0, 0, 0, 1]
    assert out.agg(F.sum(F.col("density") * (F.col("hi") - F.col("lo")))).first()[0] == pytest.approx(1.0)


def test_normal_scores_match_the_small_helper(spark):
    n = 1234
    df = spark.createDataFrame([(0, 1000, n), (1000, 234, n)], "s long, l long, n long")
    got = df.select(hypothesis._normal_scores("s", "l", "n").alias("r")).select("r.*").agg(F.sum("m"), F.sum("mm")).first()
    m = normal_quantile((np.arange(n) + 0.625) / (n + 0.25))
    assert got[0] == pytest.approx(m.sum(), abs=1e-9) and got[1] == pytest.approx((m * m).sum())


def test_ks_bins_are_searched_in_generated_code(spark):
    """Close samples leave nearly all bins open; no list of them is searched for every row."""
    rng = np.random.default_rng(5)
    a, b = np.round(rng.normal(0, 1, 3000), 2), np.round(rng.normal(0.01, 1, 3000), 2)
    df = spark.createDataFrame(pd.DataFrame({"g": ["A"] * 3000 + ["B"] * 3000, "x": np.concatenate([a, b])}))
    samples = hypothesis.samples_of_levels(df, ["x"], "g", "A", "B")
    found = hypothesis.ks_two_sample(samples, bins=64)
    grid = np.unique(np.concatenate([a, b]))
    want = max(abs((a <= v).mean() - (b <= v).mean()) for v in grid)
    assert found.first()["statistic"] == pytest.approx(want, abs=1e-12)
    plan = hypothesis._ks_bounded(samples, 64)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambdafunction" not in plan and len(plan) < 500_000
