"""Linear regression with inference, ridge for small samples, bands, residual checks.

One aggregate reduces the rows to means and covariances; a small solve per group
follows. Only residual checks read the rows again.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from statweave.functions.columns import as_double, quoted, ratio
from statweave.functions.labels import DEFAULT, Thresholds, durbin_watson_label, r2_label, stars
from statweave.functions.tails import fisher_p, student_p, student_quantile
from statweave.operators.clean import clean_regression_rows
from statweave.operators.hypothesis import shapiro_of_long
from statweave.plans.joins import attach, few_groups, join_results
from statweave.plans.ordered import running, with_next

RIDGE_BELOW = 50  # default of fit_linear
MIN_ROWS = 3


class Fit(NamedTuple):
    """``solution`` has one row per group and feeds :func:`predict` and the bands."""

    rows: DataFrame
    cleaning: DataFrame
    solution: DataFrame
    target: str
    features: tuple[str, ...]
    group_by: tuple[str, ...]
    small: bool
    ridge_below: float = RIDGE_BELOW


def _doubles(*names: str) -> list[T.StructField]:
    return [T.StructField(c, T.DoubleType()) for c in names]


def _arrays(*names: str) -> list[T.StructField]:
    return [T.StructField(c, T.ArrayType(T.DoubleType())) for c in names]


_SOLUTION = T.StructType(
    _arrays("beta", "std_error", "vif", "ridge_beta", "plain_ridge", "inverse")
    + _doubles("r2", "r2_adj", "f", "rank", "aic", "bic", "s2", "df_resid", "pred_r2", "pred_rmse")
)


def _inverse(m: np.ndarray) -> np.ndarray:
    """Pseudo-inverse of a stack of symmetric matrices, scaled to unit diagonal first."""
    d = np.sqrt(np.einsum("gii->gi", m))
    d = np.where(d > 0, d, 1.0)
    outer = d[:, :, None] * d[:, None, :]
    return np.linalg.pinv(m / outer, hermitian=True) / outer


def _solve(n: np.ndarray, means: np.ndarray, cov: np.ndarray, centered_vif: bool, ridge_below: float) -> pd.DataFrame:
    """Coefficients of all groups of a batch from their means and covariances (target last)."""
    p = means.shape[1] - 1
    full = np.zeros((len(n), p + 1, p + 1))
    rows, cols = np.triu_indices(p + 1)
    full[:, rows, cols] = full[:, cols, rows] = cov
    full *= n[:, None, None]
    sxx, sxy, syy = full[:, :p, :p], full[:, :p, p], full[:, p, p]
    mx, my = means[:, :p], means[:, p]
    diag = np.einsum("gii->gi", sxx)
    inverse = _inverse(sxx)
    scale = np.where(diag > 0, np.sqrt(diag), 1.0)
    rank = np.linalg.matrix_rank(sxx / (scale[:, :, None] * scale[:, None, :]), hermitian=True).astype(float)
    b = np.einsum("gij,gj->gi", inverse, sxy)

    def with_intercept(slopes):
        return np.column_stack([my - (slopes * mx).sum(axis=1), slopes])

    with np.errstate(all="ignore"):
        sse = np.maximum(0.0, syy - (b * sxy).sum(axis=1))
        df = n - rank - 1
        s2 = np.where(df > 0, sse / df, np.nan)
        spread = np.column_stack([1 / n + np.einsum("gi,gij,gj->g", mx, inverse, mx), np.einsum("gii->gi", inverse)])
        r2 = np.where(syy > 0, 1 - sse / syy, np.nan)
        base = n * (math.log(2 * math.pi) + np.log(sse / n) + 1)
        if p == 1:
            vif = np.ones((len(n), 1))
        else:
            moment = sxx if centered_vif else sxx + n[:, None, None] * mx[:, :, None] * mx[:, None, :]
            vif = np.einsum("gii->gi", _inverse(moment)) * np.einsum("gii->gi", moment)
        # Ridge (penalty 1) on standardised features, written back in raw units.
        sd = scale / np.sqrt(n)[:, None]
        z = sxx / (sd[:, :, None] * sd[:, None, :]) + np.eye(p)
        ridge = np.linalg.solve(z, (sxy / sd)[:, :, None])[:, :, 0] / sd
        model = np.where((n < ridge_below)[:, None], ridge, b)
        model_sse = np.maximum(
            0.0, syy - 2 * (model * sxy).sum(axis=1) + np.einsum("gi,gij,gj->g", model, sxx, model)
        )
        return pd.DataFrame({
            "beta": list(with_intercept(b)), "std_error": list(np.sqrt(s2[:, None] * spread)),
            "vif": list(np.column_stack([np.full(len(n), np.nan), vif])), "ridge_beta": list(with_intercept(model)),
            "plain_ridge": list(with_intercept(ridge)),
            "inverse": list(inverse.reshape(len(n), -1)), "r2": r2,
            "r2_adj": np.where(df > 0, 1 - (1 - r2) * (n - 1) / df, np.nan),
            "f": np.where((rank > 0) & (s2 > 0), (syy - sse) / rank / s2, np.nan), "rank": rank,
            "aic": base + 2 * (rank + 1), "bic": base + np.log(n) * (rank + 1), "s2": s2, "df_resid": df,
            "pred_r2": np.where(syy > 0, 1 - model_sse / syy, np.nan), "pred_rmse": np.sqrt(model_sse / n),
        })


def _solver(centered_vif: bool, ridge_below: float):
    @F.pandas_udf(_SOLUTION)
    def solve(n: pd.Series, means: pd.Series, cov: pd.Series) -> pd.DataFrame:
        if not len(n):
            return pd.DataFrame({c: pd.Series(dtype=object) for c in _SOLUTION.names})
        return _solve(n.to_numpy(float), np.stack(means.to_numpy()), np.stack(cov.to_numpy()), centered_vif, ridge_below)

    return solve


def fit_linear(
    df: DataFrame, target: str, features: Sequence[str], group_by: Sequence[str] = (),
    order_by: Sequence[str] = (), centered_vif: bool = False, ridge_below: float = RIDGE_BELOW,
) -> Fit:
    """Least squares per group, and ridge for prediction in groups of under ``ridge_below`` rows.

    0 means least squares everywhere, ``math.inf`` ridge everywhere. Groups with under 3 clean
    rows keep their row in the summaries, with NULL results and the status ``too_few_rows``.

    Moments are Spark's mergeable covariances, so the fit is one pass with one row per
    group shuffled per task.
    """
    features, keys = tuple(features), tuple(group_by)
    names = [*features, target]
    cleaned = clean_regression_rows(df, names, keep=[*keys, *order_by])
    by = [quoted(k) for k in keys]
    covariances = [
        F.var_pop(quoted(a)) if i == j else F.covar_pop(quoted(a), quoted(b))
        for i, a in enumerate(names) for j, b in enumerate(names) if i <= j
    ]
    moments = cleaned.data.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.array(*[F.avg(quoted(c)) for c in names]).alias("means"),
        F.array(*covariances).alias("cov"),
    )
    solved = F.when(F.col("n") >= MIN_ROWS, _solver(centered_vif, ridge_below)("n", "means", "cov"))
    solution = moments.withColumn("_r", solved).select(
        *by, "n", "means", "_r.*"
    )
    return Fit(cleaned.data, cleaned.report, solution, target, features, keys, few_groups(df, keys), ridge_below)


def _status() -> Column:
    return F.when(F.col("n") >= MIN_ROWS, "ok").otherwise("too_few_rows").alias("status")


def coefficients(fit: Fit) -> DataFrame:
    """One row per term (``const`` first): coefficient, error, t, p, VIF, significance stars."""
    terms = F.array(F.lit("const"), *[F.lit(f) for f in fit.features])
    keys = [quoted(k) for k in fit.group_by]
    out = fit.solution.withColumn("term", terms).select(
        *keys, "df_resid", F.inline(F.arrays_zip("term", "beta", "std_error", "vif"))
    )
    out = out.withColumn("t", ratio(F.col("beta"), F.col("std_error"))).withColumn("p_value", student_p("t", "df_resid"))
    return out.select(
        *keys, "term", F.col("beta").alias("coefficient"), "std_error", "t", "p_value",
        F.nanvl("vif", F.lit(None).cast("double")).alias("vif"), stars(F.col("p_value")).alias("stars"),
    )


def _line(beta: str, features: Sequence[str], columns: Sequence[Column]) -> Column:
    total = F.get(beta, F.lit(0))
    for i, c in enumerate(columns):
        total = total + F.get(beta, F.lit(i + 1)) * c
    return total


def predict(fit: Fit, df: DataFrame | None = None, model: str = "predictive", name: str = "y_predicted") -> DataFrame:
    """Score any frame that has the features (default: the clean training rows).

    ``model``: ``ols``, ``ridge``, or ``predictive`` (ridge below ``ridge_below`` rows, else the OLS line).
    """
    rows = fit.rows if df is None else df
    beta = {"ols": "beta", "ridge": "plain_ridge", "predictive": "ridge_beta"}[model]
    line = fit.solution.select(*[quoted(k) for k in fit.group_by], F.col(beta).alias("_beta"))
    scored = attach(rows, line, fit.group_by, small=fit.small)
    columns = [as_double(rows, f) for f in fit.features]
    return scored.withColumn(name, _line("_beta", fit.features, columns)).drop("_beta")


def _residuals(fit: Fit, model: str) -> DataFrame:
    return predict(fit, model=model, name="_fit").withColumn("_e", quoted(fit.target) - F.col("_fit"))


def durbin_watson(fit: Fit, order_by: Sequence[str]) -> DataFrame:
    """Σ(eₜ − eₜ₋₁)² / Σeₜ² of the OLS residuals in the given row order."""
    rows = with_next(_residuals(fit, "ols"), fit.group_by, list(order_by), ["_e"])
    step = F.col("next__e") - F.col("_e")
    sums = rows.groupBy(*[quoted(k) for k in fit.group_by]).agg(
        F.sum(step * step).alias("a"), F.sum(F.col("_e") * F.col("_e")).alias("b")
    )
    dw = ratio(F.col("a"), F.col("b"))
    return sums.select(
        *[quoted(k) for k in fit.group_by], dw.alias("durbin_watson"), durbin_watson_label(dw).alias("dw_label")
    )


def residual_normality(fit: Fit, alpha: float = DEFAULT.alpha) -> DataFrame:
    """Shapiro–Wilk test of the OLS residuals."""
    long = _residuals(fit, "ols").select(*[quoted(k) for k in fit.group_by], F.col("_e").alias("x"))
    return shapiro_of_long(long, fit.group_by, fit.small).select(
        *[quoted(k) for k in fit.group_by], F.col("statistic").alias("shapiro_w"), F.col("p_value").alias("shapiro_p"),
        (F.col("p_value") >= alpha).alias("reliable"),
    )


def model_summary(
    fit: Fit, order_by: Sequence[str] | None = None, normality: bool = True, thresholds: Thresholds = DEFAULT
) -> DataFrame:
    """One row per group: fit quality, and residual checks where asked for."""
    keys = [quoted(k) for k in fit.group_by]
    highest = F.array_max(F.filter("vif", lambda v: ~F.isnan(v)))
    out = fit.solution.withColumn("f_p", fisher_p("f", "rank", "df_resid")).select(
        *keys, "n", _status(), "r2", "r2_adj", F.when(F.col("n") >= MIN_ROWS, r2_label(F.col("r2"))).alias("r2_label"),
        "f", "f_p", "aic", "bic",
        F.coalesce(highest > thresholds.vif, F.lit(False)).alias("multicollinear"),
        (F.col("n") < fit.ridge_below).alias("small_sample"),
    )
    if order_by:
        out = join_results(out, durbin_watson(fit, order_by), fit.group_by)
    if normality:
        out = join_results(out, residual_normality(fit, thresholds.alpha), fit.group_by)
    return out


def predictive_model(fit: Fit) -> DataFrame:
    """One row per group: model kind, raw-unit coefficients, in-sample R², MAE, RMSE."""
    keys = [quoted(k) for k in fit.group_by]
    errors = _residuals(fit, "predictive").groupBy(*keys).agg(F.avg(F.abs("_e")).alias("mae"))
    named = F.map_from_arrays(
        F.array(*[F.lit(f) for f in fit.features]), F.slice("ridge_beta", 2, len(fit.features))
    )
    model = fit.solution.select(
        *keys, "n", _status(),
        F.when(F.col("n") < MIN_ROWS, None).when(F.col("n") < fit.ridge_below, "ridge").otherwise("ols").alias("model"),
        F.get("ridge_beta", F.lit(0)).alias("intercept"), named.alias("coefficients"),
        F.col("pred_r2").alias("r2"), F.col("pred_rmse").alias("rmse"),
    )
    return join_results(model, errors, fit.group_by)


def fitted_line(fit: Fit, order_by: Sequence[str] = ()) -> DataFrame:
    """Clean rows with the prediction, sorted by it; given ``order_by``, with each row's ``position`` (from 0) in that order."""
    rows = predict(fit)
    if order_by:
        placed = running(rows.withColumn("_one", F.lit(1).cast("long")), fit.group_by, list(order_by), ["_one"])
        rows = placed.select(*[quoted(c) for c in rows.columns], (F.col("cum__one") - 1).alias("position"))
    return rows.orderBy("y_predicted")


def confidence_band(fit: Fit, confidence: float = 0.95, sort: bool = True) -> DataFrame:
    """Interval of the mean response per row; x is the feature, or ŷ for several features."""
    p = len(fit.features)

    @F.pandas_udf(T.DoubleType())
    def quantile(df: pd.Series) -> pd.Series:
        return pd.Series([student_quantile(confidence, v) if v > 0 else math.nan for v in df], dtype=float)

    needed = fit.solution.select(
        *[quoted(k) for k in fit.group_by], F.col("beta").alias("_beta"), F.col("means").alias("_m"),
        F.col("inverse").alias("_inv"), F.col("s2").alias("_s2"), quantile("df_resid").alias("_tq"), F.col("n").alias("_n"),
    )
    rows = attach(fit.rows, needed, fit.group_by, small=fit.small)
    moved = [quoted(f) - F.get("_m", F.lit(i)) for i, f in enumerate(fit.features)]
    rows = rows.select("*", *[d.alias(f"_d{i}") for i, d in enumerate(moved)])
    spread = 1 / F.col("_n")
    for i in range(p):
        for j in range(p):
            spread = spread + F.col(f"_d{i}") * F.col(f"_d{j}") * F.get("_inv", F.lit(i * p + j))
    y = _line("_beta", fit.features, [quoted(f) for f in fit.features])
    rows = rows.withColumn("y_predicted", y).withColumn("_half", F.col("_tq") * F.sqrt(F.col("_s2") * spread))
    x = quoted(fit.features[0]) if p == 1 else F.col("y_predicted")
    out = rows.select(
        *[quoted(c) for c in fit.rows.columns], x.alias("x"), "y_predicted",
        (F.col("y_predicted") - F.col("_half")).alias("ci_lower"), (F.col("y_predicted") + F.col("_half")).alias("ci_upper"),
    )
    return out.orderBy("x") if sort else out
