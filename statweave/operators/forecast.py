"""Forecasts for many series at once: Holt linear trend and ARIMA.

No series is ever gathered in one task. Series are cut into blocks; what one block
does to a model is summarised by a few numbers, and those summaries are combined.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from statweave.functions.keys import reserved_keys
from statweave.functions.columns import as_double, quoted, ratio
from statweave.operators.timeseries import (
    _frequency, _frequency_facts, _least_squares, _steps, points, positions, summed_arrays,
)
from statweave.functions.labels import mape_label
from statweave.plans.calendar import shifted
from statweave.plans.joins import attach, few_groups, join_results, null_safe_join
from statweave.plans.ordered import blocks

MIN_SERIES = 8
HOLT_BLOCK = 8_192
ARIMA_BLOCK = 65_536


class Forecast(NamedTuple):
    forecast: DataFrame
    model: DataFrame


class Series(NamedTuple):
    """``rows``: (keys, pos, ts, y, n, cum, mean); ``info``: one row per usable series; ``sizes``: of every one."""

    rows: DataFrame
    info: DataFrame
    sizes: DataFrame
    keys: tuple[str, ...]
    small: bool


def _by(keys: Sequence[str]) -> list[Column]:
    return [quoted(k) for k in keys]


def _double(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.DoubleType()) for n in names]


def _key_fields(df: DataFrame, keys: Sequence[str]) -> list[T.StructField]:
    return [df.schema[k] for k in keys]


def _with_keys(fn, keys: Sequence[str]):
    """Copy the key columns of a group to the rows that ``fn`` makes of it."""
    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        return fn(pdf).assign(**{k: pdf[k].iloc[0] for k in keys})

    return call


def prepare_series(df: DataFrame, date: str, value: str, group_by: Sequence[str] = ()) -> Series:
    """Order each series by date, without missing dates or values; ``sizes`` alone lists those under 8 points.

    A frequency is inferred only when the steps are unbroken, so a series with a known
    frequency needs no filling, and one without is used as it stands.
    """
    keys = tuple(group_by)
    every = points(df, date, value, keys)
    sizes = every.groupBy(*_by(keys)).agg(F.count("v").alias("n"))
    rows = every.where(F.col("v").isNotNull()).withColumnRenamed("v", "y")
    placed = positions(rows, keys, ["ts", "y"], "y").where(F.col("n") >= MIN_SERIES)
    dates = rows.groupBy(*_by(keys), "ts").agg(F.count(F.lit(1)).alias("w"))
    facts = _frequency_facts(_steps(dates, keys), keys).where(F.col("total") >= MIN_SERIES)
    info = facts.select(*_by(keys), F.col("total").alias("n"), "last", _frequency().alias("freq"))
    return Series(placed, info, sizes, keys, few_groups(df, keys))


def _with_status(model: DataFrame, series: Series) -> DataFrame:
    """One row per series: ``ok``, ``too_few_points``, or ``no_model`` where no candidate can be fitted."""
    keys = list(series.keys)
    out = join_results(series.sizes.withColumnRenamed("n", "_points"), model, keys)
    status = F.when(F.col("rmse").isNotNull(), "ok").when(F.col("_points") < MIN_SERIES, "too_few_points").otherwise("no_model")
    return out.select(*[quoted(c) for c in model.columns], status.alias("status"))


def future_index(series: Series, steps: int) -> DataFrame:
    """(keys, step, index, date): positions n … n + steps − 1 and their dates if the frequency is known."""
    ahead = series.info.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    return ahead.select(
        *_by(series.keys), "step", (F.col("n") + F.col("step") - 1).alias("index"),
        shifted(F.col("last"), F.col("freq"), F.col("step").cast("long")).alias("date"),
    )


def forecast_metrics(
    df: DataFrame, actual: str, predicted: str, group_by: Sequence[str] = ()
) -> DataFrame:
    """MAE, RMSE, MAPE (percent, over non-zero actual values; NULL if there are none) and its label."""
    y, e = as_double(df, actual), as_double(df, actual) - as_double(df, predicted)
    out = df.groupBy(*_by(group_by)).agg(
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.when(y != 0, F.abs(ratio(e, y)))) * 100).alias("mape"),
    )
    return out.withColumn("mape_label", F.when(F.col("mape").isNotNull(), mape_label(F.col("mape"))))


# -- Holt -----------------------------------------------------------------------
# level' = l + b + a·e and trend' = b + a·g·e with e = y − (l + b): linear in the state.
# So a block maps its start state s to P·s + r, and its squared error is a quadratic
# s'Hs − 2q's + k. Both compose over blocks, and the best start state is H⁻¹q.

_STATE = ("p00", "p01", "p10", "p11", "r0", "r1", "h00", "h01", "h11", "q0", "q1", "k")


def _grid(a0: float, g0: float, half: float, size: int) -> tuple[np.ndarray, np.ndarray]:
    def axis(c: float) -> np.ndarray:
        return np.clip(np.linspace(c - half, c + half, size), 1e-4, 0.9999)

    a, g = np.meshgrid(axis(a0), axis(g0))
    return a.ravel(), g.ravel()


def _scan(y: np.ndarray, a: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For all candidates at once: how each one-step error depends on the start state, e = c − u·s,
    and the map of the whole block, s → p·s + r.

    The state moves by s' = A s + v y with a constant A. Rows u of powers of A come from doubling
    a known stretch, responses to y from a prefix scan whose reach doubles: log2(n) steps each.
    """
    n, ag = len(y), a * g
    step = np.stack([np.stack([1 - a, 1 - a], -1), np.stack([-ag, 1 - ag], -1)], -2)
    u, power = np.ones((len(a), 1, 2)), step  # power = A^(length of u)
    while u.shape[1] < n:
        u, power = np.concatenate([u, u @ power], axis=1), power @ power
    r, reach, power = np.stack([a, ag], -1)[:, None, :] * y[None, :, None], 1, step
    while reach < n:
        r = np.concatenate([r[:, :reach], r[:, reach:] + r[:, :-reach] @ power.transpose(0, 2, 1)], axis=1)
        reach, power = 2 * reach, power @ power
    before = np.concatenate([np.zeros((len(a), 1, 2)), r[:, :-1]], axis=1)
    return u[:, :n], y - before.sum(axis=2), np.linalg.matrix_power(step, n), r[:, -1]


def _squares(u: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Σe² as a quadratic in the start state: s'hs − 2q's + k."""
    h = u.transpose(0, 2, 1) @ u
    return h, (u * c[:, :, None]).sum(axis=1), (c * c).sum(axis=1)


def _holt_summary(y: np.ndarray, a: np.ndarray, g: np.ndarray) -> dict[str, np.ndarray]:
    """Block summary for all candidate (a, g) at once."""
    u, c, p, r = _scan(y, a, g)
    h, q, k = _squares(u, c)
    return dict(zip(_STATE, (p[:, 0, 0], p[:, 0, 1], p[:, 1, 0], p[:, 1, 1], r[:, 0], r[:, 1],
                             h[:, 0, 0], h[:, 0, 1], h[:, 1, 1], q[:, 0], q[:, 1], k)))


def _holt_whole(y: np.ndarray, rounds: int) -> dict[str, float]:
    """The search over a series that one task holds."""
    a0, g0, half = 0.5, 0.5, 0.5
    for size in (11, *[7] * (rounds - 1)):
        a, g = _grid(a0, g0, half, size)
        u, c, p, r = _scan(y, a, g)
        h, q, k = _squares(u, c)
        s = np.einsum("gij,gj->gi", np.linalg.pinv(h, hermitian=True), q)
        best = int(np.lexsort((g, a, k - (q * s).sum(axis=1)))[0])
        a0, g0, half = a[best], g[best], 2 * half / (size - 1)
    level, trend = p[best] @ s[best] + r[best]
    return {"alpha": a0, "beta": g0, "level": level, "trend": trend, "e": c[best] - u[best] @ s[best]}


def _holt_combine(parts: pd.DataFrame) -> dict:
    """Fold the block summaries of one candidate, solve for the start state, give every block's start."""
    p, r = np.eye(2), np.zeros(2)
    h, q, k = np.zeros((2, 2)), np.zeros(2), 0.0
    maps = []
    for row in parts.sort_values("_block").itertuples():
        hb = np.array([[row.h00, row.h01], [row.h01, row.h11]])
        qb = np.array([row.q0, row.q1])
        h = h + p.T @ hb @ p
        q = q + p.T @ (qb - hb @ r)
        k += float(r @ hb @ r - 2 * qb @ r + row.k)
        maps.append((p, r))
        pb = np.array([[row.p00, row.p01], [row.p10, row.p11]])
        p, r = pb @ p, pb @ r + np.array([row.r0, row.r1])
    s0 = np.linalg.pinv(h, hermitian=True) @ q
    starts = np.array([m @ s0 + c for m, c in maps])
    end = p @ s0 + r
    return {"sse": max(0.0, k - float(q @ s0)), "level": end[0], "trend": end[1],
            "levels": starts[:, 0], "trends": starts[:, 1]}


def _holt_round(cut: DataFrame, keys: Sequence[str], size: int) -> DataFrame:
    """Best (alpha, beta, sse, end state, block starts) per key around the centre given on the rows."""
    names = [*keys]
    schema = T.StructType([
        *_key_fields(cut, keys), T.StructField("_block", T.LongType()), T.StructField("cand", T.LongType()),
        *_double("alpha", "beta", "half", *_STATE),
    ])

    def per_block(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        first = pdf.iloc[0]
        a, g = _grid(first["a0"], first["g0"], first["half"], size)
        out = pd.DataFrame(_holt_summary(pdf["y"].to_numpy(float), a, g))
        out = out.assign(_block=int(first["_block"]), cand=np.arange(len(a)), alpha=a, beta=g, half=2 * first["half"] / (size - 1))
        if int(first["n"]) == len(pdf):  # the whole series is here: keep the winner only
            h = out[["h00", "h01", "h01", "h11"]].to_numpy().reshape(-1, 2, 2)
            q = out[["q0", "q1"]].to_numpy()
            s0 = np.einsum("gij,gj->gi", np.linalg.pinv(h, hermitian=True), q)
            out = out.iloc[[int(np.argmin(out["k"].to_numpy() - (q * s0).sum(axis=1)))]]
        return out

    parts = cut.groupBy(*_by(keys), "_block").applyInPandas(_with_keys(per_block, names), schema)
    solved = T.StructType([
        *_key_fields(cut, keys), *_double("alpha", "beta", "half", "sse", "level", "trend"),
        T.StructField("levels", T.ArrayType(T.DoubleType())), T.StructField("trends", T.ArrayType(T.DoubleType())),
    ])

    def per_candidate(pdf: pd.DataFrame) -> pd.DataFrame:
        found = _holt_combine(pdf)
        return pd.DataFrame({**{c: [pdf[c].iloc[0]] for c in ("alpha", "beta", "half")}, **{c: [v] for c, v in found.items()}})

    every = parts.groupBy(*_by(keys), "cand").applyInPandas(_with_keys(per_candidate, names), solved)
    fields = ("alpha", "beta", "half", "sse", "level", "trend", "levels", "trends")
    return every.groupBy(*_by(keys)).agg(
        F.min_by(F.struct(*fields), F.struct("sse", "alpha", "beta")).alias("_m")
    ).select(*_by(keys), *[F.col(f"_m.{f}").alias(f) for f in fields])


def _attach_by_join(rows: DataFrame, stats: DataFrame, series: Series) -> DataFrame:
    """Per-series values to rows; without keys over a constant key, as the values come from Python."""
    if series.keys:
        return attach(rows, stats, series.keys, small=series.small)
    return rows.withColumn("_all", F.lit(0)).join(F.broadcast(stats.withColumn("_all", F.lit(0))), "_all").drop("_all")


@reserved_keys
def holt(
    df: DataFrame, date: str, value: str, steps: int, group_by: Sequence[str] = (), rounds: int = 3,
    block: int = HOLT_BLOCK,
) -> Forecast:
    """Additive-trend exponential smoothing per series.

    Smoothing parameters minimise the squared one-step error over a grid that is
    narrowed ``rounds`` times; the start state is solved exactly for each candidate.
    """
    series = prepare_series(df, date, value, group_by)
    keys, by = series.keys, _by(series.keys)
    found = ("alpha", "beta", "level", "trend")
    longest = df.groupBy(*by).count().agg(F.max("count")).first()[0] or 0
    search = _holt_whole_series if longest <= block else _holt_blocks
    best, sums = search(series, rounds, block)
    model = _metrics(sums, keys, found).select(
        *by, F.lit("holt").alias("model"), *found, F.lit(None).cast("double").alias("aic"), "mae", "rmse", "mape",
    )
    ahead = _attach_by_join(future_index(series, steps), best.select(*by, "level", "trend"), series)
    missing = F.lit(None).cast("double")
    forecast = ahead.select(
        *by, "step", "index", "date", (F.col("level") + F.col("step") * F.col("trend")).alias("forecast"),
        missing.alias("ci_lower"), missing.alias("ci_upper"),
    )
    return Forecast(forecast, _with_status(model, series))


def _holt_whole_series(series: Series, rounds: int, block: int) -> tuple[DataFrame, DataFrame]:
    """No series is longer than a block: one task searches each, in one pass."""
    found = ("alpha", "beta", "level", "trend")
    schema = T.StructType([*_key_fields(series.rows, series.keys), *_double(*_ERRORS, *found)])

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf.sort_values("pos")["y"].to_numpy(float)
        best = _holt_whole(y, rounds)
        return _error_sums(y, best["e"]).assign(**{c: best[c] for c in found})

    out = series.rows.select(*_by(series.keys), "pos", "y").groupBy(*_by(series.keys)).applyInPandas(_with_keys(whole, series.keys), schema)
    return out, out


def _holt_blocks(series: Series, rounds: int, block: int) -> tuple[DataFrame, DataFrame]:
    """Long series: per round, block summaries that compose; then the errors of the blocks."""
    keys, by = series.keys, _by(series.keys)
    cut = blocks(series.rows, "pos", block, 0).select(*by, "_block", "pos", "n", "y")
    start = cut.withColumns({"a0": F.lit(0.5), "g0": F.lit(0.5), "half": F.lit(0.5)})
    best = _holt_round(start, keys, 11)
    for _ in range(rounds - 1):
        centre = best.select(*by, F.col("alpha").alias("a0"), F.col("beta").alias("g0"), "half")
        best = _holt_round(_attach_by_join(cut, centre, series), keys, 7)
    found = ("alpha", "beta", "level", "trend")
    states = best.select(*by, *found, F.posexplode(F.arrays_zip("levels", "trends")).alias("_block", "_s")).select(
        *by, *found, F.col("_block").cast("long").alias("_block"), F.col("_s.levels").alias("l"), F.col("_s.trends").alias("b")
    )
    schema = T.StructType([*_key_fields(cut, keys), *_double(*_ERRORS, *found)])

    def errors(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("pos")
        first, y = pdf.iloc[0], pdf["y"].to_numpy(float)
        u, c, _, _ = _scan(y, np.array([first["alpha"]]), np.array([first["beta"]]))
        return _error_sums(y, c[0] - u[0] @ np.array([first["l"], first["b"]])).assign(**{c: first[c] for c in found})

    sums = null_safe_join(cut, states, [*keys, "_block"]).groupBy(*by, "_block").applyInPandas(
        _with_keys(errors, keys), schema
    )
    return best, sums


def _error_sums(y: np.ndarray, e: np.ndarray) -> pd.DataFrame:
    used = y != 0
    return pd.DataFrame({
        "abs_e": [np.abs(e).sum()], "sq_e": [(e * e).sum()], "pct": [np.abs(e[used] / y[used]).sum()],
        "used": [float(used.sum())], "rows": [float(len(y))],
    })


_ERRORS = ("abs_e", "sq_e", "pct", "used", "rows")


def _metrics(sums: DataFrame, keys: Sequence[str], carry: Sequence[str] = ()) -> DataFrame:
    total = sums.groupBy(*_by(keys)).agg(
        *[F.sum(c).alias(c) for c in _ERRORS], *[F.max(c).alias(c) for c in carry]
    )
    return total.select(
        *_by(keys), *carry, ratio(F.col("abs_e"), F.col("rows")).alias("mae"),
        F.sqrt(ratio(F.col("sq_e"), F.col("rows"))).alias("rmse"),
        (ratio(F.col("pct"), F.col("used")) * 100).alias("mape"),
    )


# -- ARIMA ------------------------------------------------------------------------
# Hannan–Rissanen: a long autoregression gives residuals; then z is regressed on its own
# lags and lagged residuals. Every regression needs only cross-products, which add up
# over blocks, so all orders p, q ≤ 3 are compared from one small matrix per series.

MAX_ORDER = 3
MAX_D = 2
KPSS_LIMIT = 0.463  # fixed value: 5 % critical value of the level KPSS test


def _long_order(n: int) -> int:
    return max(1, min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 4))


def _kpss_lags(n: int) -> int:
    return int(4.0 * (n / 100.0) ** 0.25)


def _lagged(z: np.ndarray, lags: int, start: int) -> np.ndarray:
    """Columns [1, z(t−1) … z(t−lags), z(t)] for t = start … end."""
    t = np.arange(start, len(z))
    return np.column_stack([np.ones(len(t)), *[z[t - i] for i in range(1, lags + 1)], z[t]])


def _first_pass(pdf: pd.DataFrame) -> pd.DataFrame:
    """Per block and difference order: KPSS sums and cross-products of the long autoregression."""
    pdf = pdf.sort_values("pos")
    row = pdf.iloc[0]
    n, at, halo = int(row["n"]), int(row["pos"]), int(pdf["_halo"].sum())
    y, cum = pdf["y"].to_numpy(float), pdf["cum"].to_numpy(float)
    order, lags = _long_order(n), _kpss_lags(n)
    pos = at + np.arange(len(y))
    means = (row["mean"], (row["y_end"] - row["y0"]) / (n - 1),
             ((row["y_end"] - row["y_end1"]) - (row["y1"] - row["y0"])) / (n - 2))
    kpss, grams = [], []
    for d in range(MAX_D + 1):
        z = np.diff(y, n=d)  # z[i] belongs to pos[i + d]
        zpos, new = pos[d:], max(0, halo - d)
        sums = (cum if d == 0 else y - row["y0"] if d == 1 else np.concatenate([[0.0], np.diff(y)]) - (row["y1"] - row["y0"]))[d:]
        drift = sums - (zpos - d + 1) * means[d]
        e = z - means[d]
        cov = []
        for k in range(lags + 1):
            t = np.arange(max(new, k), len(z))
            cov.append(float(e[t] @ e[t - k]))
        kpss += [float((drift[new:] ** 2).sum()), *cov]
        # A usable row has `order` predecessors; later blocks find them in their halo.
        start = max(new, order) if at == 0 else new
        x = _lagged(z, order, start) if len(z) > start >= order else np.zeros((0, order + 2))
        grams.append((x.T @ x).ravel())
    return pd.DataFrame({"sums": [np.concatenate([kpss, *grams])], "n": [n]})


def _choose_d(n: int, kpss: np.ndarray) -> int:
    width = _kpss_lags(n) + 2
    for d in range(MAX_D + 1):
        s2, cov = kpss[d * width], kpss[d * width + 1:(d + 1) * width]
        m, lags = n - d, width - 2
        long_run = (cov[0] + 2 * sum((1 - k / (lags + 1)) * cov[k] for k in range(1, lags + 1))) / m
        if long_run <= 0 or s2 / (m * m) / long_run <= KPSS_LIMIT:
            return d
    return MAX_D


def _stage_one(n: int, sums: np.ndarray) -> tuple[int, np.ndarray]:
    """Difference order and coefficients [1, lags] of the long autoregression."""
    split, size = (MAX_D + 1) * (_kpss_lags(n) + 2), _long_order(n) + 2
    d = _choose_d(n, sums[:split])
    gram = sums[split:].reshape(MAX_D + 1, size, size)[d]
    return d, _least_squares(gram, list(range(size - 1)), 0)[0]


def _second_design(y: np.ndarray, n: int, d: int, ar: np.ndarray, halo: int, at: int):
    """(design [1, z lags, e lags, z], y rows, e) over the rows with complete lags."""
    order, short = len(ar) - 1, MAX_ORDER
    z = np.diff(y, n=d)
    e = np.full(len(z), np.nan)
    if len(z) > order:
        x = _lagged(z, order, order)
        e[order:] = x[:, -1] - x[:, :-1] @ ar
    start = max(halo - d, order + short) if at > 0 else order + short
    t = np.arange(max(start, 0), len(z))
    cols = [np.ones(len(t)), *[z[t - i] for i in range(1, short + 1)], *[e[t - i] for i in range(1, short + 1)], z[t]]
    return np.column_stack(cols), y[t + d], z, e


def _roots_outside(coefficients: np.ndarray, sign: float) -> bool:
    """Whether 1 + sign·c₁x + … has all roots clearly outside the unit circle."""
    if not len(coefficients) or not np.any(coefficients):
        return True
    return bool(np.all(np.abs(np.roots(np.concatenate([[1.0], sign * coefficients]))) < 1 / 1.01))


def _stage_two(n: int, d: int, gram: np.ndarray, rows: float) -> dict:
    """Best (p, q) by AIC among stationary, invertible candidates."""
    short = MAX_ORDER
    g = gram.reshape(2 * short + 2, 2 * short + 2)
    base = [0] if d < 2 else []
    best = None
    for p in range(short + 1):
        for q in range(short + 1):
            cols = [*base, *range(1, p + 1), *range(short + 1, short + 1 + q)]
            if rows <= len(cols) + 1:
                continue
            beta, sse, _ = _least_squares(g, cols, 0) if cols else (np.zeros(0), float(g[-1, -1]), None)
            const = float(beta[0]) if base else 0.0
            phi, theta = beta[len(base):len(base) + p], beta[len(base) + p:]
            if not (_roots_outside(phi, -1.0) and _roots_outside(theta, 1.0)):
                continue
            sigma2 = max(sse / rows, 1e-300)
            aic = rows * (math.log(2 * math.pi * sigma2) + 1) + 2 * (len(cols) + 1)
            if best is None or aic < best["aic"] - 1e-9:
                best = {"order": [p, d, q], "const": const, "phi": phi, "theta": theta, "sigma2": sigma2, "aic": aic}
    return best


def _project(model, steps: int, level: float) -> list[tuple[float, float, float]]:
    """Forecasts with intervals from the last z, e and y values."""
    d, phi, theta = int(model.order[1]), np.asarray(model.phi, float), np.asarray(model.theta, float)
    z, e = list(model.z_tail), list(model.e_tail)
    y_last, step_last = float(model.y_end), float(model.y_end) - float(model.y_end1)
    psi, out, width = [1.0], [], NormalDist().inv_cdf(0.5 + level / 2)
    # ψ weights of the integrated model: expand φ(x)(1 − x)^d.
    poly = np.concatenate([[1.0], -phi])
    for _ in range(d):
        poly = np.convolve(poly, [1.0, -1.0])
    variance = 0.0
    for h in range(1, steps + 1):
        value = model.const + sum(c * z[-i] for i, c in enumerate(phi, 1)) + sum(c * e[-i] for i, c in enumerate(theta, 1))
        z.append(value)
        e.append(0.0)
        if d == 2:
            step_last += value
            y_last += step_last
        else:
            y_last = value if d == 0 else y_last + value
        variance += psi[-1] ** 2
        nxt = theta[h - 1] if h <= len(theta) else 0.0
        psi.append(nxt - sum(poly[i] * psi[h - i] for i in range(1, min(h, len(poly) - 1) + 1)))
        half = width * math.sqrt(model.sigma2 * variance)
        out.append((y_last, y_last - half, y_last + half))
    return out


_ONE = T.StructType([T.StructField("d", T.LongType()), T.StructField("ar", T.ArrayType(T.DoubleType()))])
_TWO = T.StructType([
    T.StructField("order", T.ArrayType(T.LongType())), T.StructField("const", T.DoubleType()),
    T.StructField("phi", T.ArrayType(T.DoubleType())), T.StructField("theta", T.ArrayType(T.DoubleType())),
    T.StructField("sigma2", T.DoubleType()), T.StructField("aic", T.DoubleType()),
])


@F.pandas_udf(_ONE)
def _solve_one(n: pd.Series, sums: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_stage_one(int(a), np.asarray(s, float)) for a, s in zip(n, sums)], columns=_ONE.names)


@F.pandas_udf(_TWO)
def _solve_two(n: pd.Series, d: pd.Series, sums: pd.Series) -> pd.DataFrame:
    found = [_stage_two(int(a), int(b), np.asarray(s, float)[:-1], float(s[-1])) for a, b, s in zip(n, d, sums)]
    return pd.DataFrame([f or dict.fromkeys(_TWO.names) for f in found], columns=_TWO.names)


@reserved_keys
def arima(
    df: DataFrame, date: str, value: str, steps: int, confidence: float = 0.95, group_by: Sequence[str] = (),
    block: int = ARIMA_BLOCK,
) -> Forecast:
    """ARIMA(p ≤ 3, d ≤ 2, q ≤ 3) per series: d by repeated KPSS tests, (p, q) by AIC.

    Estimated by Hannan–Rissanen regressions, so values differ a little from an
    exact-likelihood fit. In-sample errors cover the rows with complete lags.
    """
    series = prepare_series(df, date, value, group_by)
    keys, by = list(series.keys), _by(series.keys)
    ends = series.rows.groupBy(*by).agg(*[
        F.max(F.when(at, F.col("y"))).alias(name) for name, at in (
            ("y0", F.col("pos") == 0), ("y1", F.col("pos") == 1),
            ("y_end1", F.col("pos") == F.col("n") - 2), ("y_end", F.col("pos") == F.col("n") - 1),
        )
    ])
    order = F.greatest(F.lit(1), F.least(F.ceil(12 * F.pow(F.col("n") / 100.0, F.lit(0.25))), F.floor(F.col("n") / 4)))
    rows = attach(series.rows, ends, keys, small=series.small)
    overlap = (order + 2 * MAX_ORDER + MAX_D).cast("long")
    cut = blocks(rows, "pos", block, overlap).where(F.col("_block") * block < F.col("n")).select(
        *by, "_block", "_halo", "pos", "n", "y", "cum", "mean", "y0", "y1", "y_end1", "y_end"
    )
    kf = _key_fields(cut, keys)
    array = T.ArrayType(T.DoubleType())
    length = T.StructField("n", T.LongType())
    sums = T.StructField("sums", array)
    # Each pass hands what it was given on to the next, so every pass runs once.
    first = cut.groupBy(*by, "_block").applyInPandas(_with_keys(_first_pass, keys), T.StructType([*kf, sums, length]))
    one = summed_arrays(first, keys, "sums", carry=["n"]).where(F.col("n").isNotNull()).withColumn("_r", _solve_one("n", "sums")).select(*by, "n", "_r.*")

    def per_block(stats: DataFrame) -> DataFrame:
        """One small row of parameters per block, to travel beside its rows."""
        last = F.floor((F.col("n") - 1) / F.lit(block)).cast("long")
        return stats.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), last)))

    def beside(stats: DataFrame, fn, schema: T.StructType) -> DataFrame:
        def call(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            if not len(left) or not len(right):
                return pd.DataFrame({f.name: pd.Series(dtype=object) for f in schema.fields})
            return fn(left.sort_values("pos"), right.iloc[0]).assign(**{k: left[k].iloc[0] for k in keys})

        return cut.groupBy(*by, "_block").cogroup(per_block(stats).groupBy(*by, "_block")).applyInPandas(call, schema)

    def second_pass(pdf: pd.DataFrame, param: pd.Series) -> pd.DataFrame:
        x, _, _, _ = _second_design(
            pdf["y"].to_numpy(float), int(param["n"]), int(param["d"]), np.asarray(param["ar"], float),
            int(pdf["_halo"].sum()), int(pdf["pos"].iloc[0]),
        )
        return pd.DataFrame({
            "sums": [np.append((x.T @ x).ravel(), len(x))], **{c: [param[c]] for c in ("n", "d", "ar")},
        })

    second = beside(one, second_pass, T.StructType([*kf, sums, length, *_ONE.fields]))
    two = summed_arrays(second, keys, "sums", carry=["n", "d", "ar"]).where(F.col("n").isNotNull()).withColumn(
        "_r", _solve_two("n", "d", "sums")
    ).select(*by, "n", "d", "ar", "_r.*").where(F.col("order").isNotNull())

    def third_pass(pdf: pd.DataFrame, param: pd.Series) -> pd.DataFrame:
        n, d, at = int(param["n"]), int(param["d"]), int(pdf["pos"].iloc[0])
        y = pdf["y"].to_numpy(float)
        x, actual, z, e = _second_design(y, n, d, np.asarray(param["ar"], float), int(pdf["_halo"].sum()), at)
        short = MAX_ORDER
        phi, theta = np.asarray(param["phi"], float), np.asarray(param["theta"], float)
        fit = param["const"] + x[:, 1:1 + len(phi)] @ phi + x[:, 1 + short:1 + short + len(theta)] @ theta
        out = _error_sums(actual, x[:, -1] - fit)
        last = at + len(y) == n
        tails = {
            "z_tail": [z[-MAX_ORDER:] if last else None], "e_tail": [np.nan_to_num(e[-MAX_ORDER:]) if last else None],
            "y_end": [y[-1] if last else np.nan], "y_end1": [y[-2] if last else np.nan],
        }
        return out.assign(**tails, **{c: [param[c]] for c in _TWO.names})

    tails = [T.StructField("z_tail", array), T.StructField("e_tail", array), *_double("y_end", "y_end1")]
    third = beside(two, third_pass, T.StructType([*kf, *_double(*_ERRORS), *tails, *_TWO.fields]))
    state = _metrics(third, keys, [*_TWO.names, *[f.name for f in tails]])
    model = state.select(*by, F.lit("arima").alias("model"), "order", "const", "phi", "theta", "sigma2", "aic", "mae", "rmse", "mape")

    path = T.ArrayType(T.StructType([T.StructField("step", T.IntegerType()), *_double("forecast", "ci_lower", "ci_upper")]))

    @F.pandas_udf(path)
    def project(rows: pd.DataFrame) -> pd.Series:
        return pd.Series([
            [{"step": h, "forecast": v[0], "ci_lower": v[1], "ci_upper": v[2]}
             for h, v in enumerate(_project(r, steps, confidence), 1)] for r in rows.itertuples()
        ])

    inputs = F.struct("order", "const", "phi", "theta", "sigma2", "z_tail", "e_tail", "y_end", "y_end1")
    paths = state.where(F.col("order").isNotNull()).withColumn("_p", project(inputs)).select(*by, F.inline("_p"))
    dated = null_safe_join(paths, future_index(series, steps), [*keys, "step"])
    return Forecast(dated.select(*by, "step", "index", "date", "forecast", "ci_lower", "ci_upper"), _with_status(model, series))
