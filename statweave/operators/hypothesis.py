"""Hypothesis tests.

Spark reduces the rows to a few sufficient statistics per (group, column); the
p-value is a function of those. Rank tests work on one table of distinct values
with counts per side, ordered without a single-task window.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from statweave.functions.keys import reserved_keys
from statweave.functions import closed
from statweave.functions.columns import (
    as_double, clean, melt, numeric_columns, quoted, ratio, require_numeric,
)
from statweave.functions.labels import DEFAULT, Thresholds, biserial_label, cohen_label, cramer_label
from statweave.functions.tails import chi2_p, kolmogorov_sf, normal_quantile, normal_two_sided, student_p
from statweave.operators.describe import check_categorical, contingency
from statweave.plans.joins import attach, few_groups, few_values, join_by_value, join_results, null_safe_join
from statweave.plans.ordered import running, steps_of
from statweave.plans.quantiles import interpolated, order_statistics


@dataclass(frozen=True)
class TwoSamples:
    """Long frame (keys, side, x), side 0 = A and 1 = B; missing values are gone."""

    long: DataFrame
    keys: tuple[str, ...]
    small: bool  # the number of key combinations has been checked for broadcasting


def samples_of_columns(df: DataFrame, a: str, b: str, group_by: Sequence[str] = ()) -> TwoSamples:
    """Two numeric columns of one table as unpaired samples."""
    require_numeric(df, [a, b])
    long = df.select(
        *[quoted(k) for k in group_by],
        F.lit(f"{a} / {b}").alias("column"),
        F.inline(F.array(
            F.struct(F.lit(0).alias("side"), as_double(df, a).alias("x")),
            F.struct(F.lit(1).alias("side"), as_double(df, b).alias("x")),
        )),
    ).where(F.col("x").isNotNull())
    return TwoSamples(long, (*group_by, "column"), few_groups(df, group_by))


def samples_of_levels(
    df: DataFrame, columns: Sequence[str], by: str, level_a, level_b, group_by: Sequence[str] = ()
) -> TwoSamples:
    """Rows with ``by`` = level_a against rows with ``by`` = level_b."""
    require_numeric(df, columns)
    rows = df.where(quoted(by).isin(level_a, level_b)).withColumn(
        "_side", (quoted(by) == F.lit(level_b)).cast("int")
    )
    long = melt(rows, columns, [*group_by, "_side"]).withColumnRenamed("_side", "side")
    return TwoSamples(long, (*group_by, "column"), few_groups(df, group_by))


def _by(s: TwoSamples) -> list[Column]:
    return [quoted(k) for k in s.keys]


def _sides(fn, name: str) -> list[Column]:
    return [fn(F.when(F.col("side") == i, F.col("x"))).alias(f"{name}_{tag}") for i, tag in ((0, "a"), (1, "b"))]


def moments(s: TwoSamples) -> DataFrame:
    """n, mean, std, variance and shape of both sides, in one pass."""
    return s.long.groupBy(*_by(s)).agg(*[
        c for fn, name in (
            (F.count, "n"), (F.avg, "mean"), (F.stddev_samp, "std"), (F.var_samp, "var"),
            (F.skewness, "g1"), (F.kurtosis, "g2"),
        ) for c in _sides(fn, name)
    ])


def side_counts(s: TwoSamples) -> DataFrame:
    """(keys, x, ca, cb): how often each value occurs on each side."""
    return s.long.groupBy(*_by(s), "x").agg(
        F.sum(F.lit(1) - F.col("side")).alias("ca"), F.sum("side").alias("cb")
    )


def rank_statistics(s: TwoSamples, probs_a: Sequence[float] = (), medians: bool = True) -> DataFrame:
    """Rank sum of A, tie term, largest distance of the two distribution functions,
    medians of both sides and quantiles of A, all from one ordered table."""
    run = running(side_counts(s), s.keys, "x", ["ca", "cb"])
    aggs = [F.expr(e) for e in (
        "max(tot_ca) AS n_a", "max(tot_cb) AS n_b",
        # Average rank of a value: all rows up to it, less half of its other copies.
        "sum(ca * (cum_ca + cum_cb - (ca + cb - 1) / 2D)) AS rank_a",
        "sum(pow(double(ca + cb), 3) - (ca + cb)) AS ties",
        "max(abs(cum_ca / nullif(double(tot_ca), 0D) - cum_cb / nullif(double(tot_cb), 0D))) AS distance",
        "sum(ca * x) / nullif(double(max(tot_ca)), 0D) AS mean_a",
        "sum(cb * x) / nullif(double(max(tot_cb)), 0D) AS mean_b",
    )]
    if medians:
        for t in "ab":
            aggs += order_statistics("x", f"c{t}", f"cum_c{t}", f"tot_c{t}", [0.5], f"_m{t}_")
    if probs_a:
        aggs += order_statistics("x", "ca", "cum_ca", "tot_ca", probs_a, "_q_")
    columns = [*_by(s), "n_a", "n_b", "rank_a", "ties", "distance", "mean_a", "mean_b"]
    if medians:
        columns += [F.get(interpolated(f"n_{t}", [0.5], f"_m{t}_"), F.lit(0)).alias(f"median_{t}") for t in "ab"]
    if probs_a:
        columns.append(interpolated("n_a", probs_a, "_q_").alias("quantiles_a"))
    found = run.groupBy(*_by(s)).agg(*aggs).select(*columns)
    return found.withColumn("edges_a", F.array_distinct("quantiles_a")) if probs_a else found


_TEST = T.StructType([T.StructField(c, T.DoubleType()) for c in ("statistic", "df", "p_value", "effect_size")])


def _result(columns: dict) -> pd.DataFrame:
    n = len(columns["statistic"])
    return pd.DataFrame({c: columns.get(c, np.full(n, np.nan)) for c in _TEST.names}, dtype=float)


@F.pandas_udf(_TEST)
def _student(rows: pd.DataFrame) -> pd.DataFrame:
    return _result(dict(zip(("statistic", "df", "p_value"), closed.student(rows))))


@F.pandas_udf(_TEST)
def _welch(rows: pd.DataFrame) -> pd.DataFrame:
    return _result(dict(zip(("statistic", "df", "p_value"), closed.welch(rows))))


@F.pandas_udf(_TEST)
def _cohen(rows: pd.DataFrame) -> pd.DataFrame:
    d = closed.cohen(rows)
    return _result({"statistic": d, "effect_size": d})


@F.pandas_udf(_TEST)
def _mann_whitney(rows: pd.DataFrame) -> pd.DataFrame:
    u, p = closed.mann_whitney(rows)
    return _result({"statistic": u, "p_value": p, "effect_size": closed.rank_biserial(u, rows)})


@F.pandas_udf(_TEST)
def _levene(rows: pd.DataFrame) -> pd.DataFrame:
    return _result(dict(zip(("statistic", "df", "p_value"), closed.levene(rows))))


@F.pandas_udf(_TEST)
def _k2(n: pd.Series, g1: pd.Series, g2: pd.Series) -> pd.DataFrame:
    stat, p = closed.k2(n.to_numpy(float), g1.to_numpy(float), g2.to_numpy(float))
    return _result({"statistic": stat, "p_value": p})


def _apply(table: DataFrame, udf, inputs: Sequence[str], keep: Sequence[Column], results: Sequence[str]) -> DataFrame:
    """Run a test's closed form on reduced rows."""
    return table.withColumn("_r", udf(F.struct(*inputs))).select(*keep, *[F.col(f"_r.{c}").alias(c) for c in results])


_MOMENTS = ("n_a", "n_b", "mean_a", "mean_b", "var_a", "var_b")


def student_t(s: TwoSamples) -> DataFrame:
    """Student t with pooled variance, A − B."""
    return _apply(moments(s), _student, _MOMENTS, _by(s), ("statistic", "df", "p_value"))


def welch_t(s: TwoSamples) -> DataFrame:
    """Welch t with Satterthwaite degrees of freedom, A − B."""
    return _apply(moments(s), _welch, _MOMENTS, _by(s), ("statistic", "df", "p_value"))


def cohens_d(s: TwoSamples, thresholds: Thresholds = DEFAULT) -> DataFrame:
    out = _apply(moments(s), _cohen, _MOMENTS, _by(s), ("effect_size",))
    return out.withColumn("effect_label", cohen_label(F.col("effect_size"), thresholds))


def mann_whitney(s: TwoSamples, thresholds: Thresholds = DEFAULT) -> DataFrame:
    """U of sample A with tie and continuity correction, and the rank-biserial effect."""
    ranks = rank_statistics(s, medians=False)
    out = _apply(
        ranks, _mann_whitney, ("n_a", "n_b", "rank_a", "ties"), [*_by(s), F.col("n_a"), F.col("n_b")],
        ("statistic", "p_value", "effect_size"),
    )
    return out.withColumn("effect_label", biserial_label(F.col("effect_size"), thresholds))


def with_ks(table: DataFrame) -> DataFrame:
    """Add ``ks_stat`` and ``ks_p`` from n_a, n_b and ``distance``; 0 and 1 below two values a side."""
    enough = "n_a >= 2 AND n_b >= 2"
    lam = table.withColumn("_lam", F.expr(f"CASE WHEN {enough} THEN distance * sqrt(double(n_a) * n_b / (n_a + n_b)) END"))
    return lam.withColumns({
        "ks_stat": F.expr(f"CASE WHEN {enough} THEN distance ELSE 0D END"), "ks_p": F.coalesce(kolmogorov_sf("_lam"), F.lit(1.0)),
    }).drop("_lam")


def _ks_bounded(s: TwoSamples, bins: int) -> DataFrame:
    """(keys, n_a, n_b, distance): largest distance of the two distribution functions by branch and bound.

    One pass counts both sides in bins between approximate quantiles of all values. At the edges
    the distance is known; inside a bin it can leave the value at the lower edge by no more than
    the shares of the two sides in that bin. Only the values of bins whose bound exceeds the best
    edge are shuffled and ranked, with what lies below the bin as offset.
    """
    by = _by(s)
    grid = [i / bins for i in range(1, bins)]
    cuts = s.long.groupBy(*by).agg(F.percentile_approx("x", grid, 10 * bins).alias("_c")).select(*by, F.array_distinct("_c").alias("_c"))
    placed = steps_of(null_safe_join(s.long, F.broadcast(cuts), s.keys), "_bin", bins, "size(_c)", "get(_c, {i}) < x").drop("_c")
    counted = placed.groupBy(*by, "_bin").agg(F.sum(F.lit(1) - F.col("side")).alias("ca"), F.sum("side").alias("cb"))
    every = Window.partitionBy(*by)  # at most ``bins`` rows
    before = every.orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    whole = counted.select("*", *[F.sum(f"c{t}").over(every).alias(f"n_{t}") for t in "ab"], *[
        F.coalesce(F.sum(f"c{t}").over(before), F.lit(0)).alias(f"o{t}") for t in "ab"])
    share = lambda t, c: f"({c}) / nullif(double(n_{t}), 0D)"
    edged = whole.withColumns({
        "_edge": F.expr(f"abs({share('a', 'oa + ca')} - {share('b', 'ob + cb')})"),
        "_most": F.expr(f"greatest(abs({share('a', 'oa + ca')} - {share('b', 'ob')}), abs({share('a', 'oa')} - {share('b', 'ob + cb')}))"),
    }).withColumn("_best", F.max("_edge").over(every))
    known = edged.groupBy(*by).agg(F.max("n_a").alias("n_a"), F.max("n_b").alias("n_b"), F.max("_best").alias("_best"))
    # At most one row per bin, found again by its number: a list of open bins would be searched for every row.
    open_ = edged.where((F.col("_most") > F.col("_best")) & (F.col("ca") + F.col("cb") > 1)).select(*by, "_bin", "n_a", "n_b", "oa", "ob")
    # Values of other bins share one group a key, dropped after the aggregate: see steps_of on filters.
    near, here = null_safe_join(placed, F.broadcast(open_), [*s.keys, "_bin"]), F.col("n_a").isNotNull()
    values = near.groupBy(*by, F.when(here, F.col("_bin")).alias("_bin"), F.when(here, F.col("x")).alias("x")).agg(
        F.sum(F.lit(1) - F.col("side")).alias("ca"), F.sum("side").alias("cb"), *[F.max(c).alias(c) for c in ("n_a", "n_b", "oa", "ob")]
    ).where("n_a IS NOT NULL")
    run = running(values, [*s.keys, "_bin"], "x", ["ca", "cb"])
    finer = run.groupBy(*by).agg(F.expr(f"max(abs({share('a', 'oa + cum_ca')} - {share('b', 'ob + cum_cb')}))").alias("_fine"))
    return join_results(known, finer, s.keys).select(*by, "n_a", "n_b", F.greatest("_best", "_fine").alias("distance"))


def ks_two_sample(s: TwoSamples, bins: int = 512) -> DataFrame:
    """Largest distance of the two distribution functions, asymptotic p."""
    # Cut points of too many groups for a broadcast: ranks of all values.
    table = _ks_bounded(s, bins) if s.small else rank_statistics(s, medians=False)
    return with_ks(table).select(
        *_by(s), "n_a", "n_b", F.col("ks_stat").alias("statistic"), F.col("ks_p").alias("p_value")
    )


def _levene_sums() -> list[Column]:
    """Aggregates Σ|x − median| and Σ(x − median)² per side."""
    return [
        F.expr(f"sum(c{t} * pow(abs(x - median_{t}), {k})) AS z{k}_{t}") for t in "ab" for k in (1, 2)
    ]


def levene(s: TwoSamples) -> DataFrame:
    """Brown–Forsythe form (distances from the median)."""
    table = second_pass(s, rank_statistics(s), _levene_sums(), carry=["n_a", "n_b"])
    sums = ("n_a", "n_b", "z1_a", "z2_a", "z1_b", "z2_b")
    return _apply(table, _levene, sums, _by(s), ("statistic", "df", "p_value"))


def second_pass(
    s: TwoSamples, first: DataFrame, aggs: Sequence[Column], carry: Sequence[str], derive: Sequence[Column] = ()
) -> DataFrame:
    """Aggregate the value counts again, with the per-key results of the first pass at hand.

    ``carry`` names columns of ``first`` that are kept, so it need not be joined again;
    ``derive`` adds row-level columns for ``aggs``.
    """
    rows = attach(side_counts(s), first, s.keys, small=s.small).select("*", *derive)
    return rows.groupBy(*_by(s)).agg(*[F.max(c).alias(c) for c in carry], *aggs)


@reserved_keys
def normality_k2(df: DataFrame, columns: Sequence[str] | None = None, group_by: Sequence[str] = ()) -> DataFrame:
    """D'Agostino–Pearson test per column, from one pass of moments."""
    targets = numeric_columns(df, columns, exclude=group_by)
    by = [*[quoted(k) for k in group_by], F.col("column")]
    stats = melt(df, targets, group_by).groupBy(*by).agg(
        F.count("x").alias("n"), F.skewness("x").alias("g1"), F.kurtosis("x").alias("g2")
    )
    return stats.withColumn("_r", _k2("n", "g1", "g2")).select(
        *by, "n", F.col("_r.statistic").alias("statistic"), F.col("_r.p_value").alias("p_value")
    )


# -- Shapiro–Wilk -------------------------------------------------------------

_LONG_RUN = 20_000
_EDGE = 2_000


def _exact_scores(start: np.ndarray, size: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Σ m and Σ m² over runs of positions, m = normal quantile of (i + 0.625) / (n + 0.25)."""
    ends = np.cumsum(size)
    first = ends - size
    position = np.arange(ends[-1]) - np.repeat(first, size) + np.repeat(start, size)
    m = normal_quantile((position + 0.625) / (np.repeat(n, size) + 0.25))
    return np.add.reduceat(m, first), np.add.reduceat(m * m, first)


def _run_scores(start: float, end: float, n: float) -> tuple[float, float]:
    """The same for one long run (a value with many copies) in constant time.

    The outermost positions are summed; the smooth middle is the integral of the
    quantile function with the midpoint rule's derivative term, exact to about 1e−12.
    """
    total = np.zeros(2)
    for lo, hi in ((start, min(end, _EDGE)), (max(start, n - _EDGE), end)):
        if hi > lo:
            total += np.ravel(_exact_scores(np.array([lo]), np.array([int(hi - lo)]), np.array([n])))
    lo, hi = max(start, _EDGE), min(end, n - _EDGE)
    if hi > lo:
        u = (np.array([lo, hi]) + 0.125) / (n + 0.25)
        z = normal_quantile(u)
        phi = np.exp(-z * z / 2) / np.sqrt(2 * np.pi)
        slope = 1 / (phi * (n + 0.25))
        total[0] += -(n + 0.25) * (phi[1] - phi[0]) - (slope[1] - slope[0]) / 24
        area = u - z * phi
        total[1] += (n + 0.25) * (area[1] - area[0]) - (2 * z[1] * slope[1] - 2 * z[0] * slope[0]) / 24
    return float(total[0]), float(total[1])


@F.pandas_udf(T.StructType([T.StructField("m", T.DoubleType()), T.StructField("mm", T.DoubleType())]))
def _normal_scores(start: pd.Series, length: pd.Series, n: pd.Series) -> pd.DataFrame:
    """Sums of expected normal order statistics, and of their squares, over runs of positions."""
    s, size, total = start.to_numpy(float), length.to_numpy(np.int64), n.to_numpy(float)
    out = np.zeros((len(s), 2))
    short = size <= _LONG_RUN
    if short.any():
        out[short] = np.column_stack(_exact_scores(s[short], size[short], total[short]))
    for i in np.flatnonzero(~short):
        out[i] = _run_scores(s[i], s[i] + size[i], total[i])
    return pd.DataFrame(out, columns=["m", "mm"])


@F.pandas_udf(T.StructType([T.StructField("w", T.DoubleType()), T.StructField("p", T.DoubleType())]))
def _shapiro_result(
    n: pd.Series, smx: pd.Series, smm: pd.Series, x1: pd.Series, x2: pd.Series,
    xm: pd.Series, xn: pd.Series, ss: pd.Series,
) -> pd.DataFrame:
    rows = [closed.shapiro(*map(float, r)) for r in zip(n, smx, smm, x1, x2, xm, xn, ss)]
    return pd.DataFrame(rows, columns=["w", "p"])


def value_counts_of(long: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, x, w): how often each value occurs."""
    return long.groupBy(*[quoted(k) for k in keys], "x").agg(F.count(F.lit(1)).alias("w"))


def shapiro_of_counts(counts: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
    """(keys, n, mean, ss, statistic, p_value) for value counts (keys, x, w); ss = Σ(x − mean)²."""
    by = [quoted(k) for k in keys]
    centre = counts.groupBy(*by).agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("_mean"))
    run = running(counts, keys, "x", ["w"]).select(
        *by, "x", (F.col("cum_w") - F.col("w")).alias("start"), F.col("cum_w").alias("end"), F.col("tot_w").alias("n")
    )
    size = F.col("end") - F.col("start")
    parts = attach(run, centre, keys, small=small).withColumn("_q", _normal_scores("start", size, "n"))
    dx = F.col("x") - F.col("_mean")

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("start") <= position) & (position < F.col("end")), dx))

    n = F.col("n")
    sums = parts.groupBy(*by).agg(
        F.max("n").alias("n"), F.max("_mean").alias("mean"), F.sum(size * dx * dx).alias("ss"),
        F.sum(F.col("_q.m") * dx).alias("smx"), F.sum("_q.mm").alias("smm"),
        at(F.lit(0)).alias("x1"), at(F.lit(1)).alias("x2"), at(n - 2).alias("xm"), at(n - 1).alias("xn"),
    ).where(F.col("n").isNotNull())
    zero = F.lit(0.0)
    return sums.withColumn("_r", _shapiro_result(
        F.col("n").cast("double"), "smx", "smm", "x1", F.coalesce("x2", zero), F.coalesce("xm", zero), "xn", "ss"
    )).select(*by, "n", "mean", "ss", F.col("_r.w").alias("statistic"), F.col("_r.p").alias("p_value"))


def shapiro_of_long(long: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
    """(keys, n, statistic, p_value) for a long frame (keys, x)."""
    return shapiro_of_counts(value_counts_of(long, keys), keys, small).drop("mean", "ss")


@reserved_keys
def shapiro(df: DataFrame, columns: Sequence[str] | None = None, group_by: Sequence[str] = ()) -> DataFrame:
    """Shapiro–Wilk test per column on all values."""
    targets = numeric_columns(df, columns, exclude=group_by)
    return shapiro_of_long(melt(df, targets, group_by), [*group_by, "column"], few_groups(df, group_by))


# -- automatic choice of the two-sample test ------------------------------------

_SMALL = "_sample"


def _central_moments() -> list[Column]:
    """Aggregates Σ(x − mean)^k per side for k = 2, 3, 4."""
    power = "* (x - mean_{t}) "
    return [
        F.expr(f"sum(c{t} {power.format(t=t) * k}) AS s{k}_{t}") for t in "ab" for k in (2, 3, 4)
    ]


def _uses_shapiro(n_a: Column, n_b: Column) -> Column:
    return (F.least(n_a, n_b) >= closed.MIN_FOR_NORMALITY) & (
        F.greatest(n_a, n_b) <= closed.SHAPIRO_LIMIT
    )


def two_sample_table(
    s: TwoSamples, probs_a: Sequence[float] = (), extra: Sequence[Column] = (), derive: Sequence[Column] = ()
) -> DataFrame:
    """One row per key with everything the two-sample tests need.

    Both passes read the same shuffled table of value counts: the first ranks it, the
    second takes central moments, Levene sums and ``extra`` aggregates. Samples small
    enough for Shapiro–Wilk (at most 300 values a side) are kept as a sorted array.
    """
    kept = ["n_a", "n_b", "mean_a", "mean_b", "rank_a", "ties", "distance"]
    sample = F.array_sort(F.collect_list(
        F.when(_uses_shapiro(F.col("n_a"), F.col("n_b")), F.struct("x", "ca", "cb"))
    )).alias(_SMALL)
    table = second_pass(
        s, rank_statistics(s, probs_a), [*_central_moments(), *_levene_sums(), sample, *extra], kept, derive
    )
    shape = [F.expr(e) for t in "ab" for e in (
        f"s2_{t} / nullif(n_{t} - 1D, 0D) AS var_{t}", f"sqrt(s2_{t} / nullif(n_{t} - 1D, 0D)) AS std_{t}",
        f"sqrt(n_{t}) * s3_{t} / nullif(pow(s2_{t}, 1.5D), 0D) AS g1_{t}",
        f"n_{t} * s4_{t} / nullif(s2_{t} * s2_{t}, 0D) - 3 AS g2_{t}",
    )]
    return table.select("*", *shape)


_DECISION = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("test", "norm_test", "effect_metric")]
    + [T.StructField(c, T.DoubleType()) for c in (
        "statistic", "p_value", "norm_a_stat", "norm_a_p", "norm_b_stat", "norm_b_p",
        "levene_stat", "levene_p", "effect_size",
    )]
    + [T.StructField("decision", T.ArrayType(T.StringType()))]
)


@F.pandas_udf(_DECISION)
def _decide(rows: pd.DataFrame) -> pd.DataFrame:
    return closed.decide(rows)[_DECISION.names]


def decide(table: DataFrame, thresholds: Thresholds = DEFAULT) -> DataFrame:
    """Add the decision tree's columns to a :func:`two_sample_table`."""
    inputs = [*_MOMENTS, "g1_a", "g1_b", "g2_a", "g2_b", "rank_a", "ties", "z1_a", "z2_a", "z1_b", "z2_b"]
    packed = F.struct(
        *inputs, F.lit(thresholds.alpha).alias("alpha"), F.col(f"{_SMALL}.x").alias("sample_x"),
        F.col(f"{_SMALL}.ca").alias("sample_a"), F.col(f"{_SMALL}.cb").alias("sample_b"),
    )
    out = table.withColumn("_r", _decide(packed)).select("*", "_r.*").drop("_r", _SMALL)
    effect = F.col("effect_size")
    return out.withColumn(
        "effect_label", F.when(F.col("test") == "mann_whitney", biserial_label(effect, thresholds))
        .otherwise(cohen_label(effect, thresholds)),
    )


def compare(s: TwoSamples, thresholds: Thresholds = DEFAULT) -> DataFrame:
    """Choose and run the two-sample test per key.

    Below 8 values on a side: Mann–Whitney. Else normality (Shapiro–Wilk up to 300
    values on both sides, K² beyond) and equal variances (Levene) decide between
    Student, Welch and Mann–Whitney. Below 3 values there is no test (NULL).
    """
    return decide(two_sample_table(s), thresholds).select(
        *_by(s), "test", "statistic", "p_value", "norm_test", "norm_a_stat", "norm_a_p", "norm_b_stat", "norm_b_p",
        "levene_stat", "levene_p", "effect_size", "effect_metric", "effect_label", "decision",
        "n_a", "n_b", "mean_a", "mean_b", "std_a", "std_b",
    )


# -- paired tests ---------------------------------------------------------------

def paired_t_of(stats: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keys, n, statistic, p_value, effect_size) from n, mean and sd of the differences A − B."""
    by = [quoted(k) for k in keys]
    out = stats.select(
        *by, *keep, "n", ratio(F.col("mean"), F.col("sd") / F.sqrt(F.col("n"))).alias("statistic"),
        (F.col("n") - 1).cast("double").alias("_df"),
        F.when(F.col("sd") > 0, F.abs(ratio(F.col("mean"), F.col("sd")))).otherwise(F.lit(0.0)).alias("effect_size"),
    )
    return out.withColumn("p_value", student_p("statistic", "_df")).drop("_df")


def wilcoxon_of_counts(values: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Signed-rank test of differences given as value counts (keys, x, w).

    Zeros are dropped, ties share their average rank.
    """
    by = [quoted(k) for k in keys]
    counts = values.where(F.col("x") != 0).groupBy(*by, F.abs("x").alias("d")).agg(
        F.sum(F.when(F.col("x") > 0, F.col("w")).otherwise(F.lit(0))).alias("up"), F.sum("w").alias("w")
    )
    run = running(counts, keys, "d", ["w"])
    rank = F.col("cum_w") - (F.col("w") - 1) / F.lit(2.0)
    t = F.col("w").cast("double")
    sums = run.groupBy(*by).agg(
        F.max("tot_w").alias("n"), F.sum(F.col("up") * rank).alias("plus"),
        F.sum((F.col("w") - F.col("up")) * rank).alias("minus"), F.sum(t * t * t - t).alias("ties"),
    )
    spread = "sqrt((double(n) * (n + 1) * (2 * n + 1) - ties / 2) / 24)"
    z = f"(least(plus, minus) - double(n) * (n + 1) / 4) / nullif({spread}, 0D)"
    return sums.withColumn("_z", F.expr(z)).select(
        *by, "n", F.least("plus", "minus").alias("statistic"), normal_two_sided("_z").alias("p_value")
    )


def _differences(df: DataFrame, a: str, b: str, group_by: Sequence[str]) -> DataFrame:
    require_numeric(df, [a, b])
    return df.select(
        *[quoted(k) for k in group_by], F.lit(f"{a} / {b}").alias("column"),
        (as_double(df, a) - as_double(df, b)).alias("x"),
    ).where(F.col("x").isNotNull())


@reserved_keys
def paired_t(df: DataFrame, a: str, b: str, group_by: Sequence[str] = ()) -> DataFrame:
    """Paired t-test of column a − column b with the effect |mean / sd|."""
    keys = [*group_by, "column"]
    stats = _differences(df, a, b, group_by).groupBy(*[quoted(k) for k in keys]).agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd")
    )
    return paired_t_of(stats, keys)


@reserved_keys
def wilcoxon(df: DataFrame, a: str, b: str, group_by: Sequence[str] = ()) -> DataFrame:
    keys = [*group_by, "column"]
    return wilcoxon_of_counts(value_counts_of(_differences(df, a, b, group_by), keys), keys)


# -- contingency tables -----------------------------------------------------------

def chi_square_finish(
    table: DataFrame, by: Sequence[Column], thresholds: Thresholds = DEFAULT
) -> DataFrame:
    """χ², p and Cramér's V from per-key sums.

    Needs n, rows, cols, sums over the observed cells (fit = Σ (O − E)²/E, mass = Σ E,
    seen = their number), one cell with its margins (o, ro, co), inv_rows (Σ 1/r) and
    inv_cols (Σ 1/c). An empty cell adds its E, so all of them together add n − mass.
    """
    n = F.col("n").cast("double")
    dof = (F.col("rows") - 1) * (F.col("cols") - 1)
    gap = F.abs(F.col("o") - F.col("ro").cast("double") * F.col("co") / n)
    shrunk = gap - F.least(F.lit(0.5), gap)
    yates = shrunk * shrunk * n * F.col("inv_rows") * F.col("inv_cols")
    empty = F.when(F.col("seen") < F.col("total_cells"), n - F.col("mass")).otherwise(F.lit(0.0))
    valid = (F.col("rows") >= 2) & (F.col("cols") >= 2)
    chi2 = F.when(valid, F.when(dof == 1, yates).otherwise(F.col("fit") + empty))
    out = table.select(
        *by, chi2.alias("chi2"), dof.alias("dof"), dof.cast("double").alias("_dof"), F.col("n"),
        (F.least("rows", "cols") - 1).alias("_k"), "low_expected_cells", "total_cells",
    ).withColumn("p_value", chi2_p("chi2", "_dof"))
    v = F.sqrt(ratio(F.col("chi2"), F.col("n") * F.col("_k")))
    return out.select(
        *by, "chi2", "p_value", "dof", "n", v.alias("cramers_v"), cramer_label(v, thresholds).alias("strength"),
        "low_expected_cells", "total_cells",
    )


@reserved_keys
def chi_square(
    df: DataFrame, a: str, b: str, group_by: Sequence[str] = (), thresholds: Thresholds = DEFAULT,
    max_numeric_levels: int = 20,
) -> DataFrame:
    """χ² independence test of two categorical columns, Yates-corrected for 2×2 tables.

    Numeric columns with more than ``max_numeric_levels`` distinct values are refused.
    """
    check_categorical(df, [a, b], max_numeric_levels)
    keys = list(group_by)
    by = [quoted(k) for k in keys]
    cells = contingency(df, a, b, keys)
    rows = cells.groupBy(*by, "value_a").agg(F.sum("count").alias("r"), F.count(F.lit(1)).alias("_cells"))
    cols = cells.groupBy(*by, "value_b").agg(F.sum("count").alias("c"), F.count(F.lit(1)).alias("_cells"))
    # Margins of few values are broadcast; of many, those with most cells are spread.
    small = few_values(df, keys, [a, b])

    row_sums = rows.groupBy(*by).agg(
        F.sum("r").alias("n"), F.count(F.lit(1)).alias("rows"), F.sum(1 / F.col("r")).alias("inv_rows")
    )
    col_sums = cols.groupBy(*by).agg(F.count(F.lit(1)).alias("cols"), F.sum(1 / F.col("c")).alias("inv_cols"))
    full = join_by_value(cells, rows, [*keys, "value_a"], "_cells", small)
    full = attach(join_by_value(full, cols, [*keys, "value_b"], "_cells", small), row_sums, keys, small)
    expected = F.col("r").cast("double") * F.col("c") / F.col("n")
    gap = F.col("count") - expected
    body = full.groupBy(*by).agg(
        F.max("n").alias("n"), F.max("rows").alias("rows"), F.max("inv_rows").alias("inv_rows"),
        F.sum(gap * gap / expected).alias("fit"), F.sum(expected).alias("mass"),
        F.count(F.lit(1)).alias("seen"), F.max(F.struct("count", "r", "c")).alias("_cell"),
    )
    table = join_results(body, col_sums, keys)
    # Cells with expected count below the limit: for each row total, how many column
    # totals lie below limit·n/r. One ordered pass instead of all (row, column) pairs.
    limit = thresholds.low_expected
    # Without keys by a join: the ranges of the ordered pass are a scalar subquery over these rows, and Spark cannot
    # compare one that holds another whose rows come from a join.
    per_key = row_sums.select(*by, "n")
    totals = attach(rows.drop("_cells"), per_key, keys, small) if keys else rows.crossJoin(F.broadcast(per_key))
    points = totals.select(
        *by, (F.lit(limit) * F.col("n") / F.col("r")).alias("v"), F.lit(0).alias("o"), F.lit(0).cast("long").alias("col")
    ).unionByName(cols.select(*by, F.col("c").cast("double").alias("v"), F.lit(1).alias("o"), F.lit(1).cast("long").alias("col")))
    low = running(points, keys, ["v", "o"], ["col"]).groupBy(*by).agg(
        F.sum(F.when(F.col("o") == 0, F.col("cum_col"))).alias("low_expected_cells")
    )
    return chi_square_finish(join_results(table, low, keys).select(
        *by, "n", "rows", "cols", "fit", "mass", "seen", "inv_rows", "inv_cols",
        F.col("_cell.count").alias("o"), F.col("_cell.r").alias("ro"), F.col("_cell.c").alias("co"),
        "low_expected_cells", (F.col("rows") * F.col("cols")).alias("total_cells"),
    ), by, thresholds)


def benjamini_hochberg(
    df: DataFrame, p: str = "p_value", group_by: Sequence[str] = (), alpha: float = DEFAULT.alpha,
    out: str = "p_corrected", reject: str = "rejected",
) -> DataFrame:
    """False-discovery-rate correction over the rows of each group.

    The rows are test results (one per analysed column), so a group is as small as
    the number of columns. A single p-value is left uncorrected (NULL).
    """
    by = [quoted(k) for k in group_by]
    value = clean(df, p)
    present = Window.partitionBy(*by, value.isNull())
    ranked = df.withColumn("_m", F.count(F.lit(1)).over(present)).withColumn(
        "_r", F.row_number().over(present.orderBy(value))
    ).withColumn("_adj", F.least(F.lit(1.0), value * F.col("_m") / F.col("_r")))
    later = present.orderBy(F.col("_r").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    several = value.isNotNull() & (F.col("_m") > 1)
    return ranked.withColumn(out, F.when(several, F.min("_adj").over(later))).withColumn(
        reject, F.when(quoted(out).isNotNull(), quoted(out) <= alpha)
    ).drop("_m", "_r", "_adj")
