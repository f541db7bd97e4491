"""Dataset profile: kinds, counts, missing values, distinct previews, shared columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window, functions as F

from statweave.functions.keys import reserved_keys
from statweave.functions.columns import (
    clean, columns_of_kind, kind_of, quoted, ratio, string_columns,
)


def _counts(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """(keys, column, kind, dtype, rows, non_null) from one aggregate over all columns."""
    wide = df.groupBy(*[quoted(k) for k in keys]).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.count(clean(df, c)).alias(f"_n{i}") for i, c in enumerate(columns)],
    )
    items = [
        F.struct(
            F.lit(c).alias("column"), F.lit(kind_of(df.schema[c].dataType)).alias("kind"),
            F.lit(df.schema[c].dataType.simpleString()).alias("dtype"),
            F.col("_rows").alias("rows"), F.col(f"_n{i}").alias("non_null"),
        ) for i, c in enumerate(columns)
    ]
    return wide.select(*[quoted(k) for k in keys], F.inline(F.array(*items)))


@reserved_keys
def profile(df: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """One row per column: kind, data type, rows, non-missing count."""
    return _counts(df, [c for c in df.columns if c not in set(group_by)], group_by)


@reserved_keys
def missing_profile(df: DataFrame, group_by: Sequence[str] = ()) -> DataFrame:
    """One row per column: missing count and percent of all rows."""
    counts = profile(df, group_by)
    missing = F.col("rows") - F.col("non_null")
    return counts.select(
        *[quoted(k) for k in group_by], "column", "dtype", missing.alias("missing_count"),
        F.coalesce(F.round(ratio(missing * 100, F.col("rows")), 2), F.lit(0.0)).alias("missing_percent"),
    )


def distinct_preview(df: DataFrame, columns: Sequence[str], limit: int = 10) -> DataFrame:
    """Per column the first distinct values in order, the distinct count, and whether more exist.

    One scan for all columns. Values are made distinct before they are counted; of each partition only
    the ``limit`` smallest per column go on.
    """
    long = df.select(F.inline(F.array(*[
        F.struct(F.lit(i).alias("c"), clean(df, c).cast("string").alias("v")) for i, c in enumerate(columns)
    ]))).where(F.col("v").isNotNull())
    values = long.groupBy("c", "v").agg(F.count(F.lit(1)).alias("_n")).select("c", "v")
    # Counts of the parts first: a column with most of the values is not counted in one task.
    part = F.spark_partition_id()
    counts = values.groupBy("c", part.alias("_p")).agg(F.count(F.lit(1)).alias("_n")).groupBy("c").agg(F.sum("_n").alias("_n"))
    # A rank filter on a window lets Spark keep the first rows of every partition before its shuffle.
    first = values.withColumn("_i", F.row_number().over(Window.partitionBy("c").orderBy("v"))).where(F.col("_i") <= limit)
    heads = first.groupBy("c").agg(F.array_sort(F.collect_list("v")).alias("_v"))
    names = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(columns)], "c int, column string")
    found = counts.join(F.broadcast(heads), "c")
    return names.join(F.broadcast(found), "c", "left").select(
        "column", F.coalesce("_n", F.lit(0)).cast("long").alias("distinct_count"),
        F.coalesce(F.col("_n") > limit, F.lit(False)).alias("has_more"),
        F.coalesce("_v", F.array().cast("array<string>")).alias("values"),
    )


def common_columns(a: DataFrame, b: DataFrame) -> dict[str, list[str]]:
    """Shared columns by kind, from the schemas alone."""
    return {
        "all": sorted(set(a.columns) & set(b.columns)),
        "numeric": sorted(set(columns_of_kind(a, "numeric")) & set(columns_of_kind(b, "numeric"))),
        "categorical": sorted(set(string_columns(a)) & set(string_columns(b))),
    }
