"""Time series against pandas and direct numpy computation."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from conftest import rows
from statweave.operators import forecast, timeseries

CODES = ["D", "2D", "W-SUN", "W-WED", "2W-SUN", "MS", "ME", "2MS", "QS-JAN", "QS-FEB", "QE-MAR", "QE-DEC",
         "YS-JAN", "YE-DEC", "2YS-JAN", "h", "3h", "min", "15min", "s", "B", "36h", "ms"]


def ntz(spark, pdf):
    return spark.createDataFrame(pdf).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


def test_frequency_is_inferred_as_pandas_does(spark):
    index = {f: pd.date_range("2021-01-04", periods=13, freq=f) for f in CODES}
    index["repeated"] = index["D"].append(index["D"][:1])
    index["gap"] = index["D"].delete(4)
    pdf = pd.concat([pd.DataFrame({"g": k, "ts": v, "v": 1.0}) for k, v in index.items()])
    got = {r["g"]: r for r in timeseries.validate_series(ntz(spark, pdf), "ts", "v", ["g"]).collect()}
    for name, v in index.items():
        assert got[name]["freq"] == pd.infer_freq(v.sort_values()), name
    assert got["B"]["gaps_count"] == 2 and not got["B"]["is_regular"]
    assert got["gap"]["suggestions"] == ["resample_unknown_frequency"]


def test_validation_of_text_dates_and_short_series(spark):
    df = spark.createDataFrame([("2024-01-01", 1.0), ("2024-01-02", None), ("bad", 2.0)], "d string, v double")
    row = timeseries.validate_series(df, "d", "v").first()
    assert (row["is_valid"], row["total_points"], row["suggestions"]) == (False, 2, ["need_3_points"])


CASES = [
    ("D", "mean", "interpolate"), ("D", "mean", "zero"), ("D", "median", "ffill"), ("D", "sum", "interpolate"),
    ("3D", "max", "interpolate"), ("6h", "mean", "interpolate"), ("7h", "min", "ffill"), ("W", "mean", "interpolate"),
    ("2W", "sum", "zero"), ("MS", "mean", "ffill"), ("ME", "mean", "ffill"), ("2ME", "mean", "ffill"), ("2MS", "sum", "ffill"),
    ("QS", "mean", "ffill"), ("QE", "mean", "ffill"), ("2QE", "max", "ffill"), ("YS", "mean", "ffill"), ("YE", "mean", "ffill"),
    ("B", "mean", "interpolate"), ("h", "mean", "ffill"),
]


@pytest.mark.parametrize("freq,agg,fill", CASES)
def test_resample_as_pandas_does(spark, freq, agg, fill):
    rng = np.random.default_rng(12)
    ts = pd.Timestamp("2022-11-05 07:30") + pd.to_timedelta(np.sort(rng.integers(0, 300 * 24, 150)), unit="h")
    v = rng.normal(10, 3, 150)
    v[[0, 5, 6, 7, 149]] = np.nan
    pdf = pd.DataFrame({"ts": ts, "v": v})
    got = timeseries.resample(ntz(spark, pdf), "ts", "v", freq, agg, fill).toPandas().sort_values("date")
    want = pdf.set_index("ts")["v"].resample(freq).agg(agg)
    empty = int(want.isna().sum())
    want = {"interpolate": lambda s: s.interpolate(), "zero": lambda s: s.fillna(0.0), "ffill": lambda s: s.ffill()}[fill](want).bfill()
    assert list(got["date"]) == list(want.index)
    np.testing.assert_allclose(got["value"].to_numpy(), want.to_numpy(), rtol=1e-12)
    assert int(got["was_filled"].sum()) == empty


def test_resample_long_gap_in_chunks_and_empty_series(spark, monkeypatch):
    monkeypatch.setattr(timeseries, "_SPAN", 7)
    pdf = pd.DataFrame({"g": ["a", "a", "e", "e"], "ts": pd.to_datetime(["2024-01-01", "2024-03-01", "2024-01-01", "2024-01-04"]),
                        "v": [0.0, 60.0, np.nan, np.nan]})
    got = timeseries.resample(ntz(spark, pdf), "ts", "v", "D", group_by=["g"]).toPandas()
    a = got[got["g"] == "a"].sort_values("date")
    np.testing.assert_allclose(a["value"], np.arange(61.0))
    assert got[got["g"] == "e"]["value"].isna().sum() == 4
    report = {r["g"]: r for r in timeseries.resample_report(ntz(spark, pdf), "ts", "v", "D", group_by=["g"]).collect()}
    assert (report["a"]["rows_before"], report["a"]["rows_after"], report["a"]["filled_count"]) == (2, 61, 59)


def numpy_adf(y):
    n, dy = len(y), np.diff(y)
    longest = timeseries.max_lag(n)

    def fit(lag, start):
        t = np.arange(start, n)
        x = np.column_stack([np.ones(len(t)), y[t - 1]] + [dy[t - 1 - i] for i in range(1, lag + 1)])
        beta = np.linalg.lstsq(x, dy[t - 1], rcond=None)[0]
        e = dy[t - 1] - x @ beta
        return x, beta, e

    def aic(lag):
        x, _, e = fit(lag, longest + 1)
        return len(e) * (math.log(2 * math.pi) + math.log(e @ e / len(e)) + 1) + 2 * x.shape[1]

    lag = min(range(longest + 1), key=aic)
    x, beta, e = fit(lag, lag + 1)
    s2 = e @ e / (len(e) - x.shape[1])
    return beta[1] / math.sqrt(s2 * np.linalg.inv(x.T @ x)[1, 1]), lag, len(e)


@pytest.mark.parametrize("block", [64, 65_536])
@pytest.mark.parametrize("kind", ["walk", "ar", "short"])
def test_adf(spark, kind, block):
    rng = np.random.default_rng(21)
    e = rng.normal(size=400)
    y = {"walk": np.cumsum(e), "short": e[:12], "ar": np.convolve(e, [1, 0.7, 0.4, 0.2])[:400]}[kind]
    df = spark.createDataFrame(pd.DataFrame({"t": np.arange(len(y)), "y": y}))
    row = timeseries.adf_test(df, "y", ["t"], block=block).first()
    tau, lag, n = numpy_adf(y)
    assert (row["used_lag"], row["n_obs"]) == (lag, n)
    assert row["adf_statistic"] == pytest.approx(tau, rel=1e-7)
    if kind != "short":
        assert row["is_stationary"] == (kind == "ar")


def test_adf_status_of_short_and_constant_series(spark):
    pdf = pd.DataFrame({"g": ["s"] * 5 + ["c"] * 50, "t": list(range(5)) + list(range(50)), "y": [1.0, 2, 1, 2, 1] + [3.0] * 50})
    got = timeseries.adf_test(spark.createDataFrame(pdf), "y", ["t"], ["g"]).select("g", "status", "p_value")
    assert rows(got) == [("c", "constant", None), ("s", "too_few_values", None)]
    one = timeseries.adf_test(spark.createDataFrame(pdf).where("g = 's'"), "y", ["t"]).first()
    assert (one.status, one.adf_statistic) == ("too_few_values", None)
    report = timeseries.resample_report(ntz(spark, pd.DataFrame({
        "g": ["a", "b", "b"], "ts": pd.to_datetime(["2024-01-01", "2024-01-01", "2024-01-03"]), "v": [1.0, 2, 3]})), "ts", "v", group_by=["g"])
    assert rows(report.select("g", "rows_after", "status")) == [("a", 0, "too_few_dates"), ("b", 3, "ok")]


def test_mackinnon_critical_values_are_consistent():
    assert timeseries.mackinnon_p(-2.86154) == pytest.approx(0.05, abs=0.002)
    assert timeseries.mackinnon_p(-3.43035) == pytest.approx(0.01, abs=0.001)


# -- forecasts -----------------------------------------------------------------------

def series(spark, y, start="2020-01-01"):
    return ntz(spark, pd.DataFrame({"ts": pd.date_range(start, periods=len(y), freq="D"), "v": y}))


def holt_sse(y, a, g, level, trend):
    sse = 0.0
    for v in y:
        e = v - level - trend
        sse += e * e
        level, trend = level + trend + a * e, trend + a * g * e
    return sse, level, trend


@pytest.mark.parametrize("block", [50, 8192])
def test_holt(spark, block):
    rng = np.random.default_rng(31)
    y = 20 + np.cumsum(0.4 + 0.3 * rng.normal(size=220)) + rng.normal(size=220)
    out = forecast.holt(series(spark, y), "ts", "v", 3, block=block)
    m = out.model.first()
    # For the chosen parameters the start state is optimal and the end state follows from it.
    h, q = np.zeros((2, 2)), np.zeros(2)
    base = holt_sse(y, m["alpha"], m["beta"], 0, 0)[0]
    unit = [holt_sse(y, m["alpha"], m["beta"], *s)[0] for s in ((1, 0), (0, 1), (1, 1))]
    h[0, 0], h[1, 1] = 0, 0
    # SSE(s) = base − 2q's + s'Hs, recovered from four evaluations and a scaled one.
    two = [holt_sse(y, m["alpha"], m["beta"], *s)[0] for s in ((2, 0), (0, 2))]
    h[0, 0], h[1, 1] = (two[0] - 2 * unit[0] + base) / 2, (two[1] - 2 * unit[1] + base) / 2
    q = np.array([(h[0, 0] + base - unit[0]) / 2, (h[1, 1] + base - unit[1]) / 2])
    h[0, 1] = h[1, 0] = (unit[2] - base - h[0, 0] - h[1, 1] + 2 * q.sum()) / 2
    start = np.linalg.solve(h, q)
    sse, level, trend = holt_sse(y, m["alpha"], m["beta"], *start)
    assert m["rmse"] == pytest.approx(math.sqrt(sse / len(y)), rel=1e-6)
    assert (m["level"], m["trend"]) == (pytest.approx(level, rel=1e-6), pytest.approx(trend, rel=1e-4, abs=1e-6))
    steps = [r["forecast"] for r in out.forecast.orderBy("step").collect()]
    assert steps == pytest.approx([level + k * trend for k in (1, 2, 3)], rel=1e-6)
    grid = [holt_sse(y, a, g, *start)[0] for a in np.linspace(0.05, 0.95, 10) for g in np.linspace(0.05, 0.95, 10)]
    assert sse <= min(grid) + 1e-9


def test_holt_scan_equals_the_recursion():
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 64, 1000):
        y, a, g = rng.normal(size=n), np.array([0.0001, 0.3, 0.9999]), np.array([0.9999, 0.2, 0.0001])
        u, c, p, r = forecast._scan(y, a, g)
        for k in range(3):
            sse, level, trend = holt_sse(y, a[k], g[k], 1.5, -0.5)
            start = np.array([1.5, -0.5])
            assert ((c[k] - u[k] @ start) ** 2).sum() == pytest.approx(sse, rel=1e-9)
            assert (p[k] @ start + r[k]).tolist() == pytest.approx([level, trend], rel=1e-9, abs=1e-9)


def test_holt_of_a_million_points(spark):
    days = spark.range(1_000_000).select(
        F.timestamp_seconds(F.col("id") * 60).cast("timestamp_ntz").alias("ts"), (F.col("id") * 0.5 + F.pmod(F.xxhash64("id"), F.lit(7))).alias("v"))
    out = forecast.holt(days, "ts", "v", 2, rounds=2)
    m = out.model.first()
    assert m.trend == pytest.approx(0.5, abs=0.01) and m.level == pytest.approx(500_002, abs=5) and m.rmse < 2.5


def kpss(z):
    e = z - z.mean()
    n, lags = len(z), int(4 * (len(z) / 100) ** 0.25)
    return e, n, lags


def numpy_d(y):
    n0 = len(y)
    for d in range(3):
        z = np.diff(y, n=d)
        e, m, _ = kpss(z)
        lags = int(4 * (n0 / 100) ** 0.25)
        long_run = (e @ e + 2 * sum((1 - k / (lags + 1)) * (e[k:] @ e[:-k]) for k in range(1, lags + 1))) / m
        if (np.cumsum(e) ** 2).sum() / m**2 / long_run <= 0.463:
            return d
    return 2


@pytest.mark.parametrize("block", [300, 65_536])
def test_arima_recovers_an_arma_process(spark, block):
    rng = np.random.default_rng(2)
    n = 3000
    e, y = rng.normal(size=n), np.zeros(n)
    for t in range(1, n):
        y[t] = 0.6 * y[t - 1] + e[t] + 0.4 * e[t - 1]
    walk = np.cumsum(y)
    for values in (y + 10, walk):
        out = forecast.arima(series(spark, values, "2000-01-01"), "ts", "v", 5, block=block)
        m = out.model.first()
        assert m["order"][1] == numpy_d(values)
        assert m["sigma2"] == pytest.approx(1.0, abs=0.08)
        rows = out.forecast.orderBy("step").collect()
        width = [r["ci_upper"] - r["ci_lower"] for r in rows]
        assert width[0] == pytest.approx(2 * 1.959964 * math.sqrt(m["sigma2"]), rel=1e-6)
        assert all(b > a for a, b in zip(width, width[1:]))


def test_arima_gives_the_same_for_any_block_length(spark):
    y = np.cumsum(np.random.default_rng(3).normal(size=900)) + 50
    a, b = (forecast.arima(series(spark, y), "ts", "v", 4, block=k) for k in (130, 65_536))
    for x, z in zip(a.forecast.orderBy("step").collect(), b.forecast.orderBy("step").collect()):
        assert x["forecast"] == pytest.approx(z["forecast"], rel=1e-8)
    p, q = a.model.first(), b.model.first()
    assert p["order"] == q["order"] and p["aic"] == pytest.approx(q["aic"]) and p["mape"] == pytest.approx(q["mape"])


def test_many_series_short_ones_and_unknown_frequency(spark):
    pdf = pd.DataFrame({
        "g": ["ok"] * 8 + ["short"] * 7 + ["uneven"] * 9,
        "ts": [*pd.date_range("2024-01-01", periods=8, freq="MS"), *pd.date_range("2024-01-01", periods=7, freq="D"),
               *pd.date_range("2024-01-01", periods=12, freq="D").delete([3, 4, 8])],
        "v": [1.0, 2, 3, 4, 5, 6, 7, 8] + [1.0] * 7 + [1.0, 2, 1, 3, 1, 2, 1, 2, 1],
    })
    out, model = forecast.holt(ntz(spark, pdf), "ts", "v", 2, ["g"])
    assert rows(model.select("g", "status")) == [("ok", "ok"), ("short", "too_few_points"), ("uneven", "ok")]
    alone = forecast.holt(ntz(spark, pdf[pdf["g"] == "short"]), "ts", "v", 2)
    assert (alone.model.first().status, alone.forecast.count()) == ("too_few_points", 0)
    alone = forecast.arima(ntz(spark, pdf[pdf["g"] == "short"]), "ts", "v", 2)
    assert (alone.model.first().status, alone.forecast.count()) == ("too_few_points", 0)
    got = {(r["g"], r["step"]): r for r in out.collect()}
    assert set(got) == {("ok", 1), ("ok", 2), ("uneven", 1), ("uneven", 2)}
    assert str(got["ok", 2]["date"]) == "2024-10-01 00:00:00" and got["ok", 2]["forecast"] == pytest.approx(10.0, abs=1e-6)
    assert got["uneven", 1]["date"] is None and got["uneven", 1]["index"] == 9
    arima = forecast.arima(ntz(spark, pdf), "ts", "v", 2, group_by=["g"])
    assert arima.forecast.count() == 4
    assert rows(arima.model.select("g", "status")) == [("ok", "ok"), ("short", "too_few_points"), ("uneven", "ok")]


@pytest.mark.parametrize("code", ["D", "3D", "h", "W-SUN", "MS", "ME", "2MS", "QS-OCT", "QE-DEC", "YS-JAN", "YE-DEC", "B", "15min"])
def test_future_dates_as_pandas_does(spark, code):
    index = pd.date_range("2021-01-04", periods=12, freq=code)
    df = ntz(spark, pd.DataFrame({"ts": index[:9], "v": np.arange(9.0)}))
    got = forecast.future_index(forecast.prepare_series(df, "ts", "v"), 3).orderBy("step").collect()
    assert [r["date"] for r in got] == [t.to_pydatetime() for t in index[9:]]
    assert [r["index"] for r in got] == [9, 10, 11]


def test_metrics_without_usable_actuals(spark):
    row = forecast.forecast_metrics(spark.createDataFrame([(0.0, 1.0), (0.0, 3.0)], "y double, f double"), "y", "f").first()
    assert (row["mae"], row["rmse"], row["mape"]) == (2.0, math.sqrt(5), None)
