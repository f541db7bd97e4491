"""Column-level building blocks: the missing-value rule, column kinds, time."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

_OTHER = (T.ArrayType, T.MapType, T.StructType, T.BinaryType, T.NullType)
_TIME = (T.DateType, T.TimestampType, T.TimestampNTZType)


def name(column: str) -> str:
    """A column's exact name as SQL text."""
    return "`" + column.replace("`", "``") + "`"


def quoted(column: str) -> Column:
    """Column by exact name, safe for dots and backticks."""
    return F.col(name(column))


def kind_of(dtype: T.DataType) -> str:
    """numeric | datetime | categorical | other (booleans are categorical)."""
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, _TIME):
        return "datetime"
    if isinstance(dtype, _OTHER) or "interval" in dtype.simpleString():
        return "other"
    return "categorical"


def columns_of_kind(df: DataFrame, kind: str, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [f.name for f in df.schema.fields if kind_of(f.dataType) == kind and f.name not in skip]


def numeric_columns(
    df: DataFrame, columns: Sequence[str] | None = None, exclude: Iterable[str] = ()
) -> list[str]:
    """Numeric columns, narrowed to ``columns``; unknown or non-numeric names are left out."""
    numeric = columns_of_kind(df, "numeric", exclude)
    return numeric if columns is None else [c for c in columns if c in set(numeric)]


def string_columns(df: DataFrame, exclude: Iterable[str] = ()) -> list[str]:
    skip = set(exclude)
    return [
        f.name for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and f.name not in skip
    ]


def require_numeric(df: DataFrame, columns: Sequence[str]) -> None:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    wrong = [c for c in columns if kind_of(df.schema[c].dataType) != "numeric"]
    if wrong:
        raise ValueError(f"columns must be numeric: {wrong}")


def clean(df: DataFrame, name: str) -> Column:
    """The column with NaN turned into NULL: both mean "missing"."""
    c = quoted(name)
    if isinstance(df.schema[name].dataType, (T.FloatType, T.DoubleType)):
        return F.when(F.isnan(c), F.lit(None)).otherwise(c)
    return c


def as_double(df: DataFrame, name: str) -> Column:
    return clean(df, name).cast("double")


def numbers(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Projection to the keys and the listed columns as doubles, NaN as NULL."""
    return df.select(*[quoted(k) for k in keys], *[as_double(df, c).alias(c) for c in columns])


def melt(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Long form (keys, column, x) of the non-missing values."""
    wide = numbers(df, columns, keys)
    pairs = [F.struct(F.lit(c).alias("column"), quoted(c).alias("x")) for c in columns]
    return wide.select(*[quoted(k) for k in keys], F.inline(F.array(*pairs))).where(F.col("x").isNotNull())


def ratio(a: Column, b: Column) -> Column:
    """a / b, NULL where b is 0 (ANSI division would raise)."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def rounded(df: DataFrame, digits: int | None) -> DataFrame:
    """Round every double column; ``None`` leaves the frame alone."""
    if digits is None:
        return df
    return df.select(*[
        F.round(quoted(f.name), digits).alias(f.name)
        if isinstance(f.dataType, T.DoubleType) else quoted(f.name)
        for f in df.schema.fields
    ])


# -- wall-clock time ------------------------------------------------------
# All calendar arithmetic is done on TIMESTAMP_NTZ, so no session time zone or
# daylight-saving jump can move a point into another bucket.

EPOCH = "timestamp_ntz'1970-01-01 00:00:00'"


# Accepted text formats, month first, tried in this order after ISO 8601.
DATE_FORMATS = (
    "M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "M-d-yyyy", "yyyy/M/d", "yyyy/M/d H:mm:ss",
    "yyyyMMdd", "d MMM yyyy", "MMM d, yyyy",
)


def date_of_text(c: Column, formats: Sequence[str] = DATE_FORMATS) -> Column:
    """Text as TIMESTAMP_NTZ: ISO first, then ``formats`` in turn; unreadable text is NULL."""
    tries = [F.try_to_timestamp(c, F.lit(f)).cast("timestamp_ntz") for f in formats]
    # A bare number such as "2024" casts to a year; it is not taken for a date.
    return F.when(~c.rlike(r"^\s*\d{1,6}\s*$"), F.coalesce(c.try_cast("timestamp_ntz"), *tries))


def wall_clock(df: DataFrame, name: str) -> Column:
    """Date-like column as TIMESTAMP_NTZ; text is parsed as by :func:`date_of_text`."""
    dtype = df.schema[name].dataType
    if isinstance(dtype, T.StringType):
        return date_of_text(quoted(name))
    if isinstance(dtype, _TIME):
        return quoted(name).cast("timestamp_ntz")
    raise ValueError(f"column {name!r} cannot be read as a date")


def epoch_micros(ts: Column) -> Column:
    seconds = (ts - F.expr(EPOCH)).cast("interval second").cast("decimal(20,6)")
    return (seconds * F.lit(1_000_000)).cast("long")


def from_epoch_micros(micros: Column) -> Column:
    seconds = (micros.cast("decimal(20,0)") / F.lit(1_000_000).cast("decimal(10,0)")).cast("decimal(18,6)")
    zero = F.lit(0)
    return F.expr(EPOCH) + F.make_dt_interval(zero, zero, zero, seconds)
