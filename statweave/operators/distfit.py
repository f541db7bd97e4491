"""Distribution fitting: normal, exponential, lognormal, Poisson; best fit; density curves."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from statweave.functions.keys import reserved_keys
from statweave.functions.columns import melt, name, numeric_columns, quoted, ratio
from statweave.functions.tails import chi2_p, kolmogorov_sf, normal_cdf_of
from statweave.plans.joins import attach, few_groups, null_safe_join
from statweave.plans.ordered import running, with_next

MIN_VALUES = 5
LOC_GRID = 24
LOC_ROUNDS = 3


def _by(keys: Sequence[str]) -> list[Column]:
    return [quoted(k) for k in keys]


def _lognormal(counts: DataFrame, stats: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
    """(keys, s, loc, scale) by profile likelihood over loc < min(x).

    For a fixed loc the best scale and s are the mean and deviation of ln(x − loc), so
    one pass over the value counts scores a whole grid of loc values, which is then
    narrowed around the best. loc = min − gap with gap on a log scale; loc = 0 always
    competes. Logs are taken relative to the mean, which keeps their squares accurate.
    """
    by = _by(keys)
    span = F.col("max") - F.col("min")
    state = stats.where((F.col("min") > 0) & (span > 0)).select(
        *by, "min", "mean", F.log(span * 1e-6).alias("_lo"), F.log(span * 1e3).alias("_hi")
    )
    best = None
    width = f"((_hi - _lo) / {LOC_GRID - 1})"
    gap = [f"exp(_lo + {k} * {width})" for k in range(LOC_GRID)] + ["min"]
    for _ in range(LOC_ROUNDS):
        rows = attach(counts, state, keys, small=small).where(F.col("_lo").isNotNull())
        # The whole grid is scored beside the value: two sums per place, no row more than there are values.
        logs = rows.select(*by, "w", "min", "mean", "_lo", "_hi", *[
            F.expr(f"ln((x - min + {g}) / (mean - min + {g})) AS l{k}") for k, g in enumerate(gap)])
        sums = logs.groupBy(*by).agg(
            F.sum("w").alias("n"), *[F.max(c).alias(c) for c in ("min", "mean", "_lo", "_hi")],
            *[F.expr(f"sum(w * l{k}) AS a{k}") for k in range(len(gap))], *[F.expr(f"sum(w * l{k} * l{k}) AS b{k}") for k in range(len(gap))])
        found = sums.selectExpr(*[name(k) for k in keys], "min", "mean", f"{width} AS _w", "array(" + ", ".join(
            f"struct({g} AS gap, sqrt(greatest(0D, b{k} / n - (a{k} / n) * (a{k} / n))) AS s, a{k} / n + ln(mean - min + {g}) AS m)"
            for k, g in enumerate(gap)) + ") AS _g")
        # −log-likelihood per row is ln(s) + mean(ln(x − loc)) up to a constant.
        best = found.withColumn("_b", F.expr(
            "array_min(transform(filter(_g, g -> g.s > 0), g -> struct(ln(g.s) + g.m AS score, g.gap AS gap, g.s AS s, g.m AS m)))"
        )).where(F.col("_b").isNotNull()).select(*by, "min", "mean", "_w", "_b.gap", "_b.s", "_b.m")
        state = best.select(
            *by, "min", "mean", (F.log("gap") - F.col("_w")).alias("_lo"), (F.log("gap") + F.col("_w")).alias("_hi")
        )
    return best.select(*by, "s", (F.col("min") - F.col("gap")).alias("loc"), F.exp("m").alias("scale"))


@F.pandas_udf(T.DoubleType())
def _poisson_pmf(k: pd.Series, lam: pd.Series) -> pd.Series:
    return pd.Series([
        math.exp(a * math.log(b) - b - math.lgamma(a + 1.0)) if b > 0 else float(a == 0) for a, b in zip(k, lam)
    ], dtype=float)


LEAST_EXPECTED = 5.0
#: Standard deviations of the law, either side, beyond which values share one cell.
REACH = 40.0


def _poisson(counts: DataFrame, stats: DataFrame, keys: Sequence[str], small: bool) -> DataFrame:
    """(keys, lambda, statistic, p_value) for columns of non-negative integers.

    Expected counts cover the whole law: an observed value also takes the mass of the
    unobserved ones up to the next, the first also what lies below it, so totals agree.
    In rising order, values are put into a bin until its expectation reaches ``LEAST_EXPECTED``;
    what remains in the end belongs to the last bin. More than two bins are needed.

    The bins of a key follow from one another, so they are made in one task, from a list that the
    law bounds and not the data: values beyond ``REACH`` deviations, whose mass is nothing next to
    a bin, are folded into one cell on each side before it is gathered.
    """
    by = _by(keys)
    usable = stats.where(F.col("whole") & (F.col("min") >= 0)).select(
        *by, F.col("mean").alias("lam"), F.col("n").alias("n"), F.col("min").alias("_first")
    )
    rows = attach(counts, usable, keys, small=small).where(F.col("lam").isNotNull())
    rows = with_next(rows, keys, "x", ["x"])

    def below(x: Column) -> Column:
        """Expected number of values under x: the Poisson law through the gamma tail."""
        return F.col("n") * chi2_p(2 * F.col("lam"), 2 * x)

    rows = rows.withColumn("_lo", F.when(F.col("x") > F.col("_first"), below(F.col("x"))).otherwise(0.0)).withColumn(
        "_hi", F.when(F.col("next_x").isNull(), F.col("n").cast("double")).otherwise(below(F.col("next_x"))))
    far = F.ceil(REACH * F.sqrt("lam") + REACH * REACH)
    cell = F.greatest(F.least(F.col("x"), F.ceil("lam") + far), F.floor("lam") - far)
    cells = rows.groupBy(*by, "lam", "n", cell.alias("x")).agg(
        F.sum("w").cast("double").alias("o"), (F.max("_hi") - F.min("_lo")).alias("e"))
    lists = cells.groupBy(*by, "lam").agg(F.array_sort(F.collect_list(F.struct("x", "o", "e"))).alias("_cells"))
    term = "(({o}) - ({e})) * (({o}) - ({e})) / ({e})"
    # State: the open bin (o, e), the last closed one (lo, le), the sum over those before it, the number of closed ones.
    closed = f"chi + CASE WHEN k > 0 THEN {term.format(o='s.lo', e='s.le')} ELSE 0D END".replace("chi", "s.chi").replace("k >", "s.k >")
    merged = F.expr(f"""aggregate(_cells, named_struct('o', 0D, 'e', 0D, 'lo', 0D, 'le', 0D, 'chi', 0D, 'k', 0L), (s, v) ->
        CASE WHEN s.e + v.e >= {LEAST_EXPECTED}D
        THEN named_struct('o', 0D, 'e', 0D, 'lo', s.o + v.o, 'le', s.e + v.e, 'chi', {closed}, 'k', s.k + 1L)
        ELSE named_struct('o', s.o + v.o, 'e', s.e + v.e, 'lo', s.lo, 'le', s.le, 'chi', s.chi, 'k', s.k) END)""")
    tested = lists.select(*by, F.col("lam").alias("lambda"), merged.alias("s")).where("s.k > 2")
    chi = F.expr(f"s.chi + {term.format(o='s.lo + s.o', e='s.le + s.e')}")
    return tested.select(*by, "lambda", chi.alias("statistic"), (F.col("s.k") - 2).alias("_df")).select(
        *by, "lambda", "statistic", chi2_p("statistic", "_df").alias("p_value"))


def _continuous(
    counts: DataFrame, stats: DataFrame, keys: Sequence[str], laws: Sequence[str], small: bool
) -> DataFrame:
    """Fitted continuous laws with their Kolmogorov–Smirnov distance, one ordered pass for all."""
    by = _by(keys)
    fits = stats.select(
        *by, F.struct(F.col("mean").alias("loc"), F.col("sd").alias("scale")).alias("_norm"),
        F.struct(F.col("min").alias("loc"), (F.col("mean") - F.col("min")).alias("scale")).alias("_expon"),
    )
    if "lognorm" in laws:
        params = _lognormal(counts, stats, keys, small).select(*by, F.struct("s", "loc", "scale").alias("_lognorm"))
        fits = null_safe_join(fits, params, keys)
    x = F.col("x")
    run = attach(running(counts, keys, "x", ["w"]), fits, keys, small=small).where(F.col("_norm").isNotNull())
    upper = F.col("cum_w") / F.col("tot_w")
    lower = (F.col("cum_w") - F.col("w")) / F.col("tot_w")
    z = {
        "norm": ratio(x - F.col("_norm.loc"), F.col("_norm.scale")),
        "expon": ratio(x - F.col("_expon.loc"), F.col("_expon.scale")),
    }
    if "lognorm" in laws:
        shifted = x - F.col("_lognorm.loc")
        z["lognorm"] = ratio(F.log(F.when(shifted > 0, shifted) / F.col("_lognorm.scale")), F.col("_lognorm.s"))
    rows = run.select(*by, upper.alias("_up"), lower.alias("_low"), "tot_w", *[f"_{c}" for c in laws], *[z[c].alias(f"_z_{c}") for c in laws])
    for c in laws:
        value = normal_cdf_of(f"_z_{c}") if c != "expon" else 1 - F.exp(-F.col("_z_expon"))
        rows = rows.withColumn(f"_t_{c}", value)
    distances = rows.groupBy(*by).agg(F.max("tot_w").alias("n"), *[
        F.max(F.greatest(F.col("_up") - F.col(f"_t_{c}"), F.col(f"_t_{c}") - F.col("_low"))).alias(f"_d_{c}")
        for c in laws
    ], *[F.first(f"_{c}").alias(f"_{c}") for c in laws])

    def as_map(c: str) -> Column:
        names = {"norm": ("loc", "scale"), "expon": ("loc", "scale"), "lognorm": ("s", "loc", "scale")}[c]
        return F.create_map(*[v for name in names for v in (F.lit(name), F.col(f"_{c}.{name}"))])

    return distances.select(*by, F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("distribution"), F.lit(i).alias("_order"), as_map(c).alias("params"),
            F.col(f"_d_{c}").alias("statistic"), (F.col(f"_d_{c}") * F.sqrt("n")).alias("_lam"),
        ) for i, c in enumerate(laws)
    ]))).where(F.col("statistic").isNotNull()).withColumn("p_value", kolmogorov_sf("_lam")).drop("_lam")


@reserved_keys
def fit_distributions(
    df: DataFrame, columns: Sequence[str] | None = None, group_by: Sequence[str] = (),
    candidates: Sequence[str] = ("norm", "lognorm", "expon", "poisson"),
) -> DataFrame:
    """(column, distribution, params, statistic, p_value, is_best) per candidate law.

    Continuous laws are judged by the Kolmogorov–Smirnov distance of their fitted law
    (Poisson by χ²); the best has the largest p. A column without any fitted law has one row
    with its ``status``, ``too_few_values`` (under 5) or ``no_fit``, instead of ``ok``.
    """
    targets = numeric_columns(df, columns, exclude=group_by)
    keys = [*group_by, "column"]
    by = _by(keys)
    small = few_groups(df, group_by)
    long = melt(df, targets, group_by)
    x = F.col("x")
    stats = long.groupBy(*by).agg(
        F.count(x).alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.min(x).alias("min"),
        F.max(x).alias("max"), F.min(x == F.round(x)).alias("whole"),
    )
    every, stats = stats, stats.where(F.col("n") >= MIN_VALUES)
    counts = long.groupBy(*by, "x").agg(F.count(F.lit(1)).alias("w"))
    laws = [c for c in ("norm", "lognorm", "expon") if c in candidates]
    parts = [_continuous(counts, stats, keys, laws, small)] if laws else []
    if "poisson" in candidates:
        parts.append(_poisson(counts, stats, keys, small).select(
            *by, F.lit("poisson").alias("distribution"), F.lit(len(laws)).alias("_order"),
            F.create_map(F.lit("lambda"), F.col("lambda")).alias("params"), "statistic", "p_value",
        ))
    # At most four rows per key; the first candidate wins a tie.
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("p_value"), "_order"))
    fitted = reduce(DataFrame.unionByName, parts).select(
        *by, "distribution", "params", "statistic", "p_value", (place == 1).alias("is_best")
    )
    names = F.explode(F.array(*[F.lit(c) for c in targets])).alias("column")
    groups = df.groupBy(*[quoted(k) for k in group_by]).agg(F.count(F.lit(1)).alias("_n")) if group_by else df.sparkSession.range(1)
    asked = groups.select(*[quoted(k) for k in group_by], names)
    sizes = null_safe_join(asked, every.select(*by, F.col("n").alias("_n")), keys)
    status = F.when(F.col("distribution").isNotNull(), "ok").when(
        F.coalesce("_n", F.lit(0)) < MIN_VALUES, "too_few_values").otherwise("no_fit")
    return null_safe_join(sizes, fitted, keys).select(
        *[quoted(c) for c in fitted.columns if c != "is_best"], F.coalesce("is_best", F.lit(False)).alias("is_best"), status.alias("status"))


def best_distribution(fits: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """The best law of every column that has one."""
    return fits.where("is_best").drop("is_best")


def density_curve(
    df: DataFrame, fits: DataFrame, group_by: Sequence[str] = (), points: int = 200
) -> DataFrame:
    """(column, distribution, x, y): density of each fitted law over the data range ± 10 %.

    Poisson is given at the integers from ⌊min⌋ to ⌊max⌋ + 1.
    """
    keys = [*group_by, "column"]
    by = _by(keys)
    targets = numeric_columns(df, None, exclude=group_by)
    span = melt(df, targets, group_by).groupBy(*by).agg(F.min("x").alias("_min"), F.max("x").alias("_max"))
    rows = null_safe_join(fits.where(F.col("distribution").isNotNull()), span, keys)
    margin = F.when(F.col("_max") > F.col("_min"), (F.col("_max") - F.col("_min")) * 0.1).otherwise(F.lit(1.0))
    lo, hi = F.col("_min") - margin, F.col("_max") + margin
    smooth = F.transform(
        F.sequence(F.lit(0), F.lit(points - 1)), lambda i: lo + i * (hi - lo) / F.lit(points - 1)
    )
    first = F.greatest(F.lit(0.0), F.floor(F.col("_min")).cast("double"))
    count = (F.floor(F.col("_max")) + 1 - first).cast("long")
    whole = F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), count)), lambda i: first + i)
    is_poisson = F.col("distribution") == "poisson"
    rows = rows.withColumn("x", F.explode(F.when(is_poisson, whole).otherwise(smooth)))
    p = {name: F.col("params")[name] for name in ("s", "loc", "scale", "lambda")}
    rows = rows.select(*by, "distribution", "x", *[F.try_element_at("params", F.lit(n)).alias(f"_{n}") for n in p])
    d = F.col("x") - F.col("_loc")
    root = F.lit(1.0 / math.sqrt(2.0 * math.pi))
    norm = root / F.col("_scale") * F.exp(-0.5 * F.pow(d / F.col("_scale"), 2))
    expon = F.when(d < 0, F.lit(0.0)).otherwise(F.exp(-d / F.col("_scale")) / F.col("_scale"))
    z = F.log(F.when(d > 0, d) / F.col("_scale")) / F.col("_s")
    lognorm = F.when(d <= 0, F.lit(0.0)).otherwise(root / (F.col("_s") * d) * F.exp(-0.5 * z * z))
    return rows.withColumn("_pmf", _poisson_pmf(
        F.when(is_poisson, F.col("x")).otherwise(F.lit(0.0)), F.coalesce("_lambda", F.lit(0.0))
    )).select(*by, "distribution", "x", F.when(is_poisson, F.col("_pmf")).when(
        F.col("distribution") == "norm", norm
    ).when(F.col("distribution") == "expon", expon).otherwise(lognorm).alias("y"))
