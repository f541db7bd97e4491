"""Time series: regularity and frequency, resampling with gap filling, stationarity."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from statweave.functions.keys import reserved_keys
from statweave.functions.columns import as_double, columns_of_kind, epoch_micros, quoted, wall_clock
from statweave.functions.labels import DEFAULT, frequency_name
from statweave.plans.calendar import DAY, TICKS, bucket_number, label, origin_unit, parse_frequency, unit_number
from statweave.plans.joins import attach, few_groups, join_results, null_safe_join
from statweave.plans.ordered import blocks, running, with_next
from statweave.plans.quantiles import quantiles_of_counts

MIN_POINTS = 3
BLOCK = 65_536


def _by(keys: Sequence[str]) -> list[Column]:
    return [quoted(k) for k in keys]


def points(df: DataFrame, date: str, value: str, keys: Sequence[str]) -> DataFrame:
    """(keys, ts, v): rows with a readable date."""
    return df.select(*_by(keys), wall_clock(df, date).alias("ts"), as_double(df, value).alias("v")).where(
        F.col("ts").isNotNull()
    )


# -- frequency ----------------------------------------------------------------

def _steps(dates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Distinct dates (keys, ts, w) with the following date and the step in microseconds."""
    out = with_next(dates, keys, "ts", ["ts"])
    return out.withColumn("step", epoch_micros(F.col("next_ts")) - epoch_micros(F.col("ts")))


def _frequency_facts(steps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per key everything the frequency rules ask, in one aggregate."""
    ts, after, step = F.col("ts"), F.col("next_ts"), F.col("step")
    months = F.year(ts) * 12 + F.month(ts)
    month_step = F.year(after) * 12 + F.month(after) - months
    weekday = F.weekday(after)
    workday = ((weekday == 0) & (step == 3 * DAY)) | (weekday.between(1, 4) & (step == DAY))
    return steps.groupBy(*_by(keys)).agg(
        F.sum("w").alias("total"), F.count(F.lit(1)).alias("distinct"), F.min("ts").alias("first"), F.max("ts").alias("last"),
        F.min(step).alias("step_min"), F.max(step).alias("step_max"),
        F.min(month_step).alias("m_min"), F.max(month_step).alias("m_max"),
        F.min(F.month(ts)).alias("mon_min"), F.max(F.month(ts)).alias("mon_max"),
        F.min(F.year(after) - F.year(ts)).alias("y_min"), F.max(F.year(after) - F.year(ts)).alias("y_max"),
        F.max(F.day(ts)).alias("day_max"), F.min(ts.cast("date") == F.last_day(ts.cast("date"))).alias("all_last"),
        F.min(workday).alias("workdays"), F.max(step % F.lit(DAY)).alias("off_day"),
    )


def _frequency() -> Column:
    """Inferred code from :func:`_frequency_facts`; NULL for uneven or repeated dates."""
    names = F.array(*[F.lit(m) for m in (
        "JAN", "FEB", "MAR", "APR", "MAY", "JUN", "JUL", "AUG", "SEP", "OCT", "NOV", "DEC")])
    days = F.array(*[F.lit(d) for d in ("MON", "TUE", "WED", "THU", "FRI", "SAT", "SUN")])
    step = F.col("step_min")
    even = step == F.col("step_max")

    def times(k: Column, code: Column) -> Column:
        return F.concat(F.when(k > 1, k.cast("long").cast("string")).otherwise(F.lit("")), code)

    edge = F.when(F.col("all_last"), F.lit("E")).when(F.col("day_max") == 1, F.lit("S"))
    first_month = F.month("first")
    quarter = F.element_at(names, F.lit(10) + F.pmod(F.lit(2) + F.pmod(first_month, F.lit(3)), F.lit(3)))
    same_year_step = (F.col("y_min") == F.col("y_max")) & (F.col("mon_min") == F.col("mon_max"))
    same_month_step = F.col("m_min") == F.col("m_max")
    yearly = times(F.col("y_min"), F.concat(F.lit("Y"), edge, F.lit("-"), F.element_at(names, first_month)))
    quarterly = times(F.floor(F.col("m_min") / 3), F.concat(F.lit("Q"), edge, F.lit("-"), quarter))
    monthly = times(F.col("m_min"), F.concat(F.lit("M"), edge))
    weekly = times(F.floor(step / (7 * DAY)), F.concat(F.lit("W-"), F.element_at(days, F.weekday("first") + 1)))
    calendar = (
        F.when(same_year_step & edge.isNotNull(), yearly)
        .when(same_month_step & (F.col("m_min") % 3 == 0) & (F.col("m_min") > 0) & edge.isNotNull(), quarterly)
        .when(same_month_step & (F.col("m_min") > 0) & edge.isNotNull(), monthly)
        .when(even & (step % (7 * DAY) == 0), weekly)
        .when(even, times(F.floor(step / DAY), F.lit("D")))
        .when(F.col("workdays") & (F.col("step_max") == 3 * DAY), F.lit("B"))
    )
    small = F.lit(None).cast("string")
    for code, size in (("us", 1), ("ms", 1000), ("s", TICKS["s"]), ("min", TICKS["min"]), ("h", TICKS["h"])):
        small = F.when(step % F.lit(size) == 0, times(F.floor(step / F.lit(size)), F.lit(code))).otherwise(small)
    usable = (F.col("distinct") >= MIN_POINTS) & (F.col("total") == F.col("distinct"))
    return F.when(usable, F.when(step % F.lit(DAY) == 0, calendar).when(even, small))


def _regularity(dates: DataFrame, keys: Sequence[str], zero_median_gaps: bool) -> DataFrame:
    """(keys, total, first, last, freq, gaps) of a table of dates with counts."""
    steps = _steps(dates, keys)
    facts = _frequency_facts(steps, keys)
    present = steps.where(F.col("step").isNotNull()).groupBy(*_by(keys), F.col("step").alias("x")).agg(
        F.count(F.lit(1)).alias("w")
    )
    repeats = steps.groupBy(*_by(keys)).agg(F.sum(F.col("w") - 1).alias("w")).where(F.col("w") > 0).select(
        *_by(keys), F.lit(0).cast("long").alias("x"), "w"
    )
    sizes = present.unionByName(repeats).withColumn("x", F.col("x").cast("double"))
    median = quantiles_of_counts(sizes, keys, [0.5]).select(*_by(keys), F.get("q", F.lit(0)).alias("median"))
    wide = F.col("x") > 1.5 * F.col("median")
    if not zero_median_gaps:
        wide = wide & (F.col("median") > 0)
    gaps = attach(sizes, median, keys).groupBy(*_by(keys)).agg(
        F.coalesce(F.sum(F.when(wide, F.col("w"))), F.lit(0)).cast("long").alias("gaps")
    )
    out = join_results(facts.withColumn("freq", _frequency()), gaps, keys)
    return out.select(*_by(keys), "total", "first", "last", "freq", F.coalesce("gaps", F.lit(0).cast("long")).alias("gaps"))


def _report(found: DataFrame, keys: Sequence[str], head: list[Column], missing: Column) -> DataFrame:
    enough = F.col("total") >= MIN_POINTS
    regular = enough & F.col("freq").isNotNull() & (F.col("gaps") == 0)
    suggestions = F.array_compact(F.array(
        F.when(~enough, "need_3_points"),
        F.when(enough & F.col("freq").isNull(), "resample_unknown_frequency")
        .when(enough & (F.col("gaps") > 0), "resample_to_fill_gaps"),
        F.when(enough & (missing > 0), "missing_values_filled_on_resample"),
    ))
    return found.select(
        *_by(keys), *head, enough.alias("is_valid"), F.col("total").alias("total_points"),
        F.when(enough, F.date_format("first", "yyyy-MM-dd")).alias("range_start"),
        F.when(enough, F.date_format("last", "yyyy-MM-dd")).alias("range_end"),
        F.when(enough, F.col("freq")).alias("freq"), frequency_name(F.when(enough, F.col("freq"))).alias("freq_name"),
        F.when(enough, F.col("gaps")).otherwise(F.lit(0).cast("long")).alias("gaps_count"),
        F.when(enough, missing).otherwise(F.lit(0).cast("long")).alias("missing_values"),
        regular.alias("is_regular"), suggestions.alias("suggestions"),
    )


@reserved_keys
def validate_series(df: DataFrame, date: str, value: str, group_by: Sequence[str] = ()) -> DataFrame:
    """One row per series: points, range, inferred frequency, gaps, missing values, advice."""
    keys = list(group_by)
    rows = points(df, date, value, keys)
    dates = rows.groupBy(*_by(keys), "ts").agg(F.count(F.lit(1)).alias("w"))
    missing = rows.groupBy(*_by(keys)).agg(F.count(F.when(F.col("v").isNull(), 1)).alias("_missing"))
    found = join_results(_regularity(dates, keys, False), missing, keys)
    return _report(found, keys, [F.lit(date).alias("date_column"), F.lit(value).alias("value_column")], F.col("_missing"))


def time_regularity(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per date column of the table (default: all of them)."""
    targets = columns or columns_of_kind(df, "datetime")
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("date_column"), wall_clock(df, c).alias("ts")) for c in targets
    ]))).where(F.col("ts").isNotNull())
    dates = long.groupBy("date_column", "ts").agg(F.count(F.lit(1)).alias("w"))
    return _report(
        _regularity(dates, ["date_column"], True), ["date_column"], [], F.lit(0).cast("long")
    ).drop("missing_values")


# -- resampling -----------------------------------------------------------------

_SPAN = 10_000


def _buckets(df: DataFrame, date: str, value: str, freq: str, agg: str, keys: Sequence[str]) -> DataFrame:
    """(keys, origin, i, v): aggregated value per calendar bucket; v may be NULL."""
    _, unit = parse_frequency(freq)
    rows = points(df, date, value, keys)
    origin = rows.groupBy(*_by(keys)).agg(origin_unit(F.min("ts"), unit).alias("origin"), F.count(F.lit(1)).alias("_rows")).where(
        F.col("_rows") >= 2
    )
    placed = attach(rows, origin, keys, small=few_groups(df, keys)).where(F.col("origin").isNotNull())
    offset = unit_number(F.col("ts"), unit).cast("long") - F.col("origin")
    placed = placed.withColumn("i", bucket_number(offset, freq))
    by = [*_by(keys), F.col("i")]
    if agg == "median":
        counts = placed.where(F.col("v").isNotNull()).groupBy(*by, F.col("v").alias("x")).agg(F.count(F.lit(1)).alias("w"))
        medians = quantiles_of_counts(counts, [*keys, "i"], [0.5]).select(*by, F.get("q", F.lit(0)).alias("v"))
        out = placed.groupBy(*by).agg(F.first("origin").alias("origin"))
        return null_safe_join(out, medians, [*keys, "i"])
    reducers = {
        "mean": F.avg("v"), "sum": F.coalesce(F.sum("v"), F.lit(0.0)), "min": F.min("v"), "max": F.max("v"),
    }
    if agg not in reducers:
        raise ValueError(f"unknown aggregate {agg!r}")
    return placed.groupBy(*by).agg(F.first("origin").alias("origin"), reducers[agg].alias("v"))


@reserved_keys
def resample(
    df: DataFrame, date: str, value: str, freq: str = "D", agg: str = "mean", fill: str = "interpolate",
    group_by: Sequence[str] = (),
) -> DataFrame:
    """(keys, date, value, was_filled) on an unbroken calendar.

    Every known bucket looks up the next known one and emits the rows up to it, so gaps
    are filled without joining to a calendar; long gaps are emitted in bounded chunks.
    An empty bucket is 0 for ``sum``. Leading gaps take the first value (0 for ``zero``),
    trailing gaps repeat the last. Series with fewer than two dates have no calendar, hence no rows;
    :func:`resample_report` lists them.
    """
    if fill not in ("interpolate", "zero", "ffill"):
        raise ValueError(f"unknown fill method {fill!r}")
    keys = list(group_by)
    by = _by(keys)
    table = _buckets(df, date, value, freq, agg, keys)
    span = table.groupBy(*by).agg(
        F.min("i").alias("_lo"), F.max("i").alias("_hi"), F.min(F.when(F.col("v").isNotNull(), F.col("i"))).alias("_first"),
        F.max("origin").alias("origin"),
    )
    known = with_next(table.where(F.col("v").isNotNull()).select(*by, "i", "v"), keys, "i", ["i", "v"])
    known = attach(known, span, keys, small=few_groups(df, keys))
    # A series without any value still gets its calendar.
    empty = span.where(F.col("_first").isNull()).select(
        *by, F.col("_lo").alias("i"), F.lit(None).cast("double").alias("v"),
        F.lit(None).cast("long").alias("next_i"), F.lit(None).cast("double").alias("next_v"), "_lo", "_hi", "_first", "origin",
    )
    rows = known.unionByName(empty)
    start = F.when(F.col("i") == F.col("_first"), F.col("_lo")).otherwise(F.col("i"))
    end = F.coalesce(F.col("next_i") - 1, F.col("_hi"))
    rows = rows.withColumn("_end", end).withColumn("_chunk", F.explode(F.sequence(start, end, F.lit(_SPAN).cast("long"))))
    rows = rows.withColumn("_j", F.explode(F.sequence(
        F.col("_chunk"), F.least(F.col("_end"), F.col("_chunk") + (_SPAN - 1))
    )))
    j, i, v = F.col("_j"), F.col("i"), F.col("v")
    zero = F.lit(0.0)
    gap = {
        "interpolate": F.when(F.col("next_i").isNull(), v).otherwise(
            v + (F.col("next_v") - v) * (j - i) / (F.col("next_i") - i)
        ),
        "zero": zero, "ffill": v,
    }[fill]
    if agg == "sum":
        gap = zero
    filled = F.when(v.isNull(), zero if fill == "zero" else v).when(j == i, v)
    filled = filled.when(j < i, zero if fill == "zero" or agg == "sum" else v).otherwise(gap)
    # For a sum an empty bucket is a true 0, not a filled one.
    was_filled = F.lit(False) if agg == "sum" else (j != i) | v.isNull()
    return rows.select(*by, label(F.col("origin"), j, freq).alias("date"), filled.alias("value"), was_filled.alias("was_filled"))


@reserved_keys
def resample_report(
    df: DataFrame, date: str, value: str, freq: str = "D", agg: str = "mean", fill: str = "interpolate",
    group_by: Sequence[str] = (),
) -> DataFrame:
    """Rows before and after resampling, the number of filled buckets, ``status`` (``ok`` or ``too_few_dates``)."""
    keys = list(group_by)
    by = _by(keys)
    before = points(df, date, value, keys).groupBy(*by).agg(F.count(F.lit(1)).alias("rows_before"))
    after = resample(df, date, value, freq, agg, fill, keys).groupBy(*by).agg(
        F.expr("nullif(count(1), 0)").alias("rows_after"), F.count(F.when(F.col("was_filled"), 1)).alias("filled_count")
    )
    out = join_results(before, after, keys)
    return out.select(
        *by, "rows_before", F.coalesce("rows_after", F.lit(0).cast("long")).alias("rows_after"),
        F.coalesce("filled_count", F.lit(0).cast("long")).alias("filled_count"), F.lit(freq).alias("freq"),
        F.lit(agg).alias("agg"), F.lit(fill).alias("fill"),
        F.when(F.col("rows_after").isNotNull(), "ok").otherwise("too_few_dates").alias("status"),
    )


# -- ordered positions -----------------------------------------------------------

def positions(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Add ``pos`` (0-based), ``n``, ``cum`` (running total of value) and ``mean`` per series."""
    counted = rows.withColumn("_one", F.lit(1).cast("long"))
    run = running(counted, keys, list(order), ["_one", value])
    return run.select(
        *[quoted(c) for c in rows.columns], (F.col("cum__one") - 1).alias("pos"), F.col("tot__one").alias("n"),
        F.col(f"cum_{value}").alias("cum"), (F.col(f"tot_{value}") / F.col("tot__one")).alias("mean"),
    )


def summed_arrays(parts: DataFrame, keys: Sequence[str], name: str, carry: Sequence[str] = ()) -> DataFrame:
    """(keys, name, carry): element-wise sum of an array column over the rows of a key.

    ``carry`` columns are equal on all rows of a key, or NULL on some.
    """
    by = _by(keys)
    kept = [F.max(c).alias(c) for c in carry]
    cells = parts.select(*by, *carry, F.posexplode(name).alias("_k", "_v")).groupBy(*by, "_k").agg(F.sum("_v").alias("_v"), *kept)
    return cells.groupBy(*by).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("_k", "_v"))), lambda s: s.getField("_v")
    ).alias(name), *kept)


# -- augmented Dickey–Fuller -------------------------------------------------------

def max_lag(n: int) -> int:
    return int(min(math.ceil(12.0 * (n / 100.0) ** 0.25), n // 2 - 2))


def _adf_design(y: np.ndarray, lag: int, start: int) -> np.ndarray:
    """Columns [1, y(t−1), Δy(t−1) … Δy(t−lag), Δy(t)] for t = start … len(y) − 1."""
    d = np.diff(y)
    t = np.arange(start, len(y))
    cols = [np.ones(len(t)), y[t - 1], *[d[t - 1 - i] for i in range(1, lag + 1)], d[t - 1]]
    return np.column_stack(cols)


def _adf_block(pdf: pd.DataFrame) -> pd.DataFrame:
    """Cross-products of one block, and the first values of the series from its first block."""
    pdf = pdf.sort_values("pos")
    n = int(pdf["n"].iloc[0])
    lag = max_lag(n)
    y = pdf["y"].to_numpy(float)
    first = int(pdf["pos"].iloc[0])
    halo = int(pdf["_halo"].sum())
    # Rows usable in every candidate regression have lag + 1 predecessors in the series.
    start = max(halo, lag + 1 - first)
    x = _adf_design(y, lag, start) if start < len(y) else np.zeros((0, lag + 3))
    head = y[: lag + 1] if first == 0 else None
    return pd.DataFrame({"gram": [(x.T @ x).ravel()], "head": [head], "n": [n]})


def _least_squares(gram: np.ndarray, cols: list[int], rows: int) -> tuple[np.ndarray, float, np.ndarray]:
    """(coefficients, SSE, inverse) of the last column on ``cols``."""
    a, b, yy = gram[np.ix_(cols, cols)], gram[cols, -1], gram[-1, -1]
    scale = np.sqrt(np.diag(a))
    scale = np.where(scale > 0, scale, 1.0)
    inverse = np.linalg.pinv(a / np.outer(scale, scale), hermitian=True) / np.outer(scale, scale)
    beta = inverse @ b
    return beta, max(float(yy - beta @ b), 0.0), inverse


def _adf_solve(n: int, gram, head) -> tuple:
    lag = max_lag(n)
    size = lag + 3
    g = np.asarray(gram, float).reshape(size, size)
    rows = n - 1 - lag
    best = None
    for used in range(lag + 1):
        cols = list(range(used + 2))
        _, sse, _ = _least_squares(g, cols, rows)
        aic = rows * (math.log(2 * math.pi) + math.log(max(sse, 1e-300) / rows) + 1) + 2 * len(cols)
        if best is None or aic < best[0]:
            best = (aic, used)
    used = best[1]
    # The chosen regression also uses the rows that the longest lag had to leave out.
    keep = [*range(used + 2), size - 1]
    full = g[np.ix_(keep, keep)]
    extra = _adf_design(np.asarray(head, float), used, used + 1)
    full = full + extra.T @ extra
    rows = n - 1 - used
    beta, sse, inverse = _least_squares(full, list(range(used + 2)), rows)
    s2 = sse / (rows - used - 2)
    return float(beta[1] / math.sqrt(s2 * inverse[1, 1])) if s2 > 0 else math.nan, used, rows


# MacKinnon (1994) tail polynomials and (2010) critical values, constant term.
_TAU_SMALL = (2.1659, 1.4412, 0.038269)
_TAU_LARGE = (1.7339, 0.93202, -0.12745, -0.010368)
_TAU_STAR, _TAU_MIN, _TAU_MAX = -1.61, -18.83, 2.74
_CRITICAL = {
    "1%": (-3.43035, -6.5393, -16.786, -79.433),
    "5%": (-2.86154, -2.8903, -4.234, -40.040),
    "10%": (-2.56677, -1.5384, -2.809, 0.0),
}


def mackinnon_p(tau: float) -> float:
    if tau > _TAU_MAX:
        return 1.0
    if tau < _TAU_MIN:
        return 0.0
    z = np.polynomial.polynomial.polyval(tau, _TAU_SMALL if tau <= _TAU_STAR else _TAU_LARGE)
    return 0.5 * math.erfc(-float(z) / math.sqrt(2.0))


_ADF = T.StructType([
    T.StructField("adf_statistic", T.DoubleType()), T.StructField("p_value", T.DoubleType()),
    T.StructField("used_lag", T.LongType()), T.StructField("n_obs", T.LongType()),
    T.StructField("crit", T.MapType(T.StringType(), T.DoubleType())),
])


@F.pandas_udf(_ADF)
def _adf_result(n: pd.Series, gram: pd.Series, head: pd.Series) -> pd.DataFrame:
    out = []
    for a, g, h in zip(n, gram, head):
        tau, used, rows = _adf_solve(int(a), g, h)
        crit = {k: float(np.polynomial.polynomial.polyval(1.0 / rows, c)) for k, c in _CRITICAL.items()}
        out.append((tau, mackinnon_p(tau) if tau == tau else math.nan, used, rows, crit))
    return pd.DataFrame(out, columns=_ADF.names)


@reserved_keys
def adf_test(
    df: DataFrame, column: str, order_by: Sequence[str], group_by: Sequence[str] = (), alpha: float = DEFAULT.alpha,
    block: int = BLOCK,
) -> DataFrame:
    """Augmented Dickey–Fuller test with a constant, lag chosen by AIC.

    The series is cut into overlapping blocks of equal length; each gives the
    cross-products of all lags, and their sum serves every candidate regression.
    ``status`` is ``ok``, ``too_few_values`` (under 10) or ``constant``; the statistics are then NULL.
    """
    keys = list(group_by)
    by = _by(keys)
    rows = df.select(*by, *[quoted(o) for o in order_by], as_double(df, column).alias("_y")).where(F.col("_y").isNotNull())
    placed = positions(rows, keys, order_by, "_y").where(F.col("n") >= 10)
    # Centring changes no lag coefficient and keeps the cross-products well scaled.
    placed = placed.select(*by, "pos", "n", (F.col("_y") - F.col("mean")).alias("y"))
    overlap = F.least(F.ceil(12 * F.pow(F.col("n") / 100.0, F.lit(0.25))), F.floor(F.col("n") / 2) - 2) + 1
    cut = blocks(placed, "pos", block, overlap.cast("long")).where(F.col("_block") * block < F.col("n"))
    schema = T.StructType([
        *[f for f in placed.schema.fields if f.name in set(keys)], T.StructField("gram", T.ArrayType(T.DoubleType())),
        T.StructField("head", T.ArrayType(T.DoubleType())), T.StructField("n", T.LongType()),
    ])

    def per_block(pdf: pd.DataFrame) -> pd.DataFrame:
        return _adf_block(pdf).assign(**{k: pdf[k].iloc[0] for k in keys})

    parts = cut.groupBy(*by, "_block").applyInPandas(per_block, schema)
    total = summed_arrays(parts, keys, "gram", carry=["n", "head"])
    tested = total.where(F.col("n").isNotNull()).withColumn("_r", _adf_result("n", "gram", "head")).select(*by, "_r.*")
    sizes = df.groupBy(*by).agg(F.count(as_double(df, column)).alias("_values"))
    out = join_results(sizes, tested.where(~F.isnan("adf_statistic")), keys)
    status = F.when(F.col("adf_statistic").isNotNull(), "ok").when(F.col("_values") < 10, "too_few_values").otherwise("constant")
    return out.select(*by, F.lit(column).alias("column"), status.alias("status"), *_ADF.names, (F.col("p_value") < alpha).alias("is_stationary"))
