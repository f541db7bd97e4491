"""Cleaning operators. Each returns the new frame and a one-row report frame."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from statweave.functions.keys import reserved_keys
from statweave.functions.columns import (
    DATE_FORMATS, date_of_text,
    as_double, clean, melt, numbers, numeric_columns, quoted, ratio, require_numeric, string_columns,
)
from statweave.plans.joins import BROADCAST_ROWS, attach, few_groups, join_by_value, null_safe_join
from statweave.plans.ordered import running
from statweave.plans.quantiles import exact_quantiles


class Cleaned(NamedTuple):
    data: DataFrame
    report: DataFrame


def _any(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def _report(df: DataFrame, affected: Column, removed: Column) -> DataFrame:
    return df.agg(
        F.count(F.lit(1)).alias("rows_before"),
        F.count(F.when(~removed, 1)).alias("rows_after"),
        F.coalesce(F.sum(affected), F.lit(0)).cast("long").alias("affected_count"),
    )


def promote_dates(
    df: DataFrame, columns: Sequence[str] | None = None, formats: Sequence[str] = DATE_FORMATS,
    min_share: float = 0.5,
) -> DataFrame:
    """Turn text columns into timestamps where more than ``min_share`` of the values parse."""
    texts = [c for c in string_columns(df) if columns is None or c in set(columns)]
    if not texts:
        return df

    def parsed(c: str) -> Column:
        return date_of_text(quoted(c), formats)

    # One pass over all text columns; the driver receives one row of shares.
    shares = df.agg(*[
        ratio(F.count(parsed(c)), F.count(quoted(c))).alias(f"_s{i}") for i, c in enumerate(texts)
    ]).first()
    dates = {c for i, c in enumerate(texts) if (shares[i] or 0.0) > min_share}
    return df.select(*[parsed(c).alias(c) if c in dates else quoted(c) for c in df.columns])


def drop_missing(df: DataFrame, columns: Sequence[str] | None = None) -> Cleaned:
    """Drop rows with a missing value in any of ``columns`` (default: all)."""
    bad = _any([clean(df, c).isNull() for c in (columns or df.columns)])
    return Cleaned(df.where(~bad), _report(df, bad.cast("long"), bad))


def _modes(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Most frequent value per column, the smallest among ties."""
    by = [*[quoted(k) for k in keys], F.col("column")]
    counts = melt(df, columns, keys).groupBy(*by, "x").agg(F.count(F.lit(1)).alias("w"))
    return counts.groupBy(*by).agg(F.max_by("x", F.struct(F.col("w"), -F.col("x"))).alias("v"))


def _spread(long: DataFrame, columns: Sequence[str], values: dict[str, Column], keys: Sequence[str]) -> DataFrame:
    """(keys, column, ...) to one row per key with ``_<name><i>`` for column number i."""
    return long.groupBy(*[quoted(k) for k in keys]).agg(*[
        F.max(F.when(F.col("column") == c, v)).alias(f"_{name}{i}")
        for i, c in enumerate(columns) for name, v in values.items()
    ])


@reserved_keys
def fill_missing(
    df: DataFrame, strategy: str = "mean", columns: Sequence[str] | None = None,
    group_by: Sequence[str] = (),
) -> Cleaned:
    """Fill numeric columns with their mean, median or most frequent value."""
    targets = numeric_columns(df, columns, exclude=group_by)
    if strategy == "mean":
        fills = numbers(df, targets, group_by).groupBy(*[quoted(k) for k in group_by]).agg(
            *[F.avg(quoted(c)).alias(f"_v{i}") for i, c in enumerate(targets)]
        )
    elif strategy == "median":
        medians = exact_quantiles(df, targets, [0.5], group_by)
        fills = _spread(medians, targets, {"v": F.get("q", F.lit(0))}, group_by)
    elif strategy == "most_frequent":
        fills = _spread(_modes(df, targets, group_by), targets, {"v": F.col("v")}, group_by)
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    joined = attach(df, fills, group_by, small=few_groups(df, group_by))
    place = {c: i for i, c in enumerate(targets)}
    filled = joined.select(*[
        F.coalesce(as_double(df, c), F.col(f"_v{place[c]}")).alias(c) if c in place else quoted(c)
        for c in df.columns
    ])
    hits = reduce(
        lambda a, b: a + b,
        [(clean(df, c).isNull() & F.col(f"_v{i}").isNotNull()).cast("long") for c, i in place.items()],
        F.lit(0),
    )
    return Cleaned(filled, _report(joined, hits, F.lit(False)))


def _fences(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, column, q1, median, q3, iqr, lower_bound, upper_bound)."""
    q = exact_quantiles(df, columns, [0.25, 0.5, 0.75], keys)
    q1, q3 = F.get("q", F.lit(0)), F.get("q", F.lit(2))
    return q.select(
        *[quoted(k) for k in keys], "column", q1.alias("q1"), F.get("q", F.lit(1)).alias("median"),
        q3.alias("q3"), (q3 - q1).alias("iqr"),
        (q1 - 1.5 * (q3 - q1)).alias("lower_bound"), (q3 + 1.5 * (q3 - q1)).alias("upper_bound"),
    )


def with_fences(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), more: Sequence[str] = ()) -> DataFrame:
    """Rows with ``_lo<i>`` and ``_hi<i>``, the outlier limits of column number i.

    ``more`` names further columns of the fences that come along, as ``_<name><i>``.
    """
    limits = {"lo": F.col("lower_bound"), "hi": F.col("upper_bound"), **{m: F.col(m) for m in more}}
    wide = _spread(_fences(df, columns, keys), columns, limits, keys)
    return attach(df, wide, keys, small=few_groups(df, keys))


def _outside(df: DataFrame, c: str, i: int) -> Column:
    x = as_double(df, c)
    return F.coalesce((x < F.col(f"_lo{i}")) | (x > F.col(f"_hi{i}")), F.lit(False))


@reserved_keys
def outlier_report(
    df: DataFrame, columns: Sequence[str] | None = None, group_by: Sequence[str] = ()
) -> DataFrame:
    """Quartiles, limits and number of values outside [q1 − 1.5·iqr, q3 + 1.5·iqr]."""
    targets = numeric_columns(df, columns, exclude=group_by)
    keys = [quoted(k) for k in group_by]
    fields = ("q1", "q3", "iqr", "lo", "hi")
    counted = with_fences(df, targets, group_by, ("q1", "q3", "iqr")).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total_rows"),
        *[F.count(F.when(_outside(df, c, i), 1)).alias(f"_o{i}") for i, c in enumerate(targets)],
        *[F.max(f"_{f}{i}").alias(f"_{f}{i}") for i in range(len(targets)) for f in fields],
    ).select(*keys, "total_rows", F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.col(f"_q1{i}").alias("q1"), F.col(f"_q3{i}").alias("q3"),
            F.col(f"_iqr{i}").alias("iqr"), F.col(f"_lo{i}").alias("lower_bound"),
            F.col(f"_hi{i}").alias("upper_bound"), F.col(f"_o{i}").alias("outliers_count"))
        for i, c in enumerate(targets)
    ])))
    return counted.select(
        *keys, "column", "q1", "q3", "iqr", "lower_bound", "upper_bound", "outliers_count",
        F.coalesce(F.round(ratio(F.col("outliers_count") * 100, F.col("total_rows")), 2), F.lit(0.0))
        .alias("outliers_percent"), "total_rows",
    )


@reserved_keys
def remove_outliers(df: DataFrame, columns: Sequence[str], group_by: Sequence[str] = ()) -> Cleaned:
    """Keep rows whose listed values are all inside their limits or missing."""
    targets = numeric_columns(df, columns, exclude=group_by)
    if not targets:
        return Cleaned(df, _report(df, F.lit(0), F.lit(False)))
    rows = with_fences(df, targets, group_by)
    bad = _any([_outside(df, c, i) for i, c in enumerate(targets)])
    kept = rows.where(~bad).select(*[quoted(c) for c in df.columns])
    return Cleaned(kept, _report(rows, bad.cast("long"), bad))


def category_codes(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, code, value): codes 0..k−1 by sorted value."""
    out = None
    for c in (c for c in columns if c in df.columns):
        mapping = _codes(df, c).select(F.lit(c).alias("column"), "code", F.col("_v").cast("string").alias("value"))
        out = mapping if out is None else out.unionByName(mapping)
    return out


def _codes(df: DataFrame, c: str) -> DataFrame:
    value = clean(df, c)
    counts = df.select(value.alias("_v")).where(F.col("_v").isNotNull()).groupBy("_v").agg(
        F.count(F.lit(1)).alias("_w")
    ).withColumn("_one", F.lit(1).cast("long"))
    ranked = running(counts, [], "_v", ["_one"])
    return ranked.select("_v", (F.col("cum__one") - 1).cast("int").alias("code"), "_w")


def encode_categories(df: DataFrame, columns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Replace values by their codes, missing by −1; also returns the mapping."""
    targets = [c for c in columns if c in df.columns]
    sizes = df.agg(*[F.approx_count_distinct(clean(df, c)) for c in targets]).first() if targets else []
    out = df
    for c, distinct in zip(targets, sizes):
        table = _codes(df, c).withColumnRenamed("_v", c).withColumnRenamed("code", "_code")
        joined = join_by_value(out, table, [c], "_w", small=distinct <= BROADCAST_ROWS)
        out = joined.select(*[
            F.coalesce(F.col("_code"), F.lit(-1)).alias(c) if name == c else quoted(name)
            for name in df.columns
        ])
    return out, category_codes(df, targets)


def _scale(df: DataFrame, columns: Sequence[str], keys: Sequence[str], centre, width) -> DataFrame:
    targets = numeric_columns(df, columns, exclude=keys)
    wide = numbers(df, targets, keys).groupBy(*[quoted(k) for k in keys]).agg(*[
        stat for i, c in enumerate(targets) for stat in (
            centre(quoted(c)).alias(f"_m{i}"), width(quoted(c)).alias(f"_s{i}"),
            (F.min(quoted(c)) == F.max(quoted(c))).alias(f"_k{i}"),
        )
    ])
    place = {c: i for i, c in enumerate(targets)}

    def scaled(c: str) -> Column:
        i, x = place[c], as_double(df, c)
        moved = (x - F.col(f"_m{i}")) / F.nullif(F.col(f"_s{i}"), F.lit(0.0))
        return F.when(x.isNotNull() & F.col(f"_k{i}"), F.lit(0.0)).otherwise(moved).alias(c)

    rows = attach(df, wide, keys, small=few_groups(df, keys))
    return rows.select(*[scaled(c) if c in place else quoted(c) for c in df.columns])


@reserved_keys
def scale_standard(df: DataFrame, columns: Sequence[str], group_by: Sequence[str] = ()) -> DataFrame:
    """(x − mean) / population standard deviation; a constant column becomes 0."""
    return _scale(df, columns, group_by, F.avg, F.stddev_pop)


@reserved_keys
def scale_minmax(df: DataFrame, columns: Sequence[str], group_by: Sequence[str] = ()) -> DataFrame:
    """(x − min) / (max − min); a constant column becomes 0."""
    return _scale(df, columns, group_by, F.min, lambda c: F.max(c) - F.min(c))


def clean_regression_rows(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> Cleaned:
    """Keep the listed numeric columns and drop rows with a missing or infinite value."""
    require_numeric(df, columns)
    inf = float("inf")
    extra = [c for c in keep if c not in set(columns)]
    rows = df.select(*[quoted(c) for c in extra], *[as_double(df, c).alias(c) for c in columns])
    infinite = _any([F.coalesce(quoted(c).isin(inf, -inf), F.lit(False)) for c in columns])
    missing = _any([quoted(c).isNull() for c in columns])
    report = rows.agg(
        F.count(F.lit(1)).alias("original"),
        F.count(F.when(~(infinite | missing), 1)).alias("cleaned"),
        F.count(F.when(infinite | missing, 1)).alias("dropped"),
        F.count(F.when(infinite, 1)).alias("dropped_inf"),
        F.count(F.when(missing & ~infinite, 1)).alias("dropped_nan"),
    )
    return Cleaned(rows.where(~(infinite | missing)), report)
