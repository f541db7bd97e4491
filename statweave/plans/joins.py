"""Joins of small statistics back to rows, with every broadcast bounded."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from statweave.functions.columns import quoted

BROADCAST_ROWS = 200_000
#: A key is hot above 1/HOT_SHARE of all rows; the summary that finds them tracks so many hashes.
HOT_SHARE = 1000
TRACKED = 16_384


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join on ``keys`` where NULL keys match; the key columns come from the left."""
    renamed = right
    for i, k in enumerate(keys):
        renamed = renamed.withColumnRenamed(k, f"_rk{i}")
    on = reduce(
        lambda a, b: a & b,
        [quoted(k).eqNullSafe(F.col(f"_rk{i}")) for i, k in enumerate(keys)],
    )
    return left.join(renamed, on, how).drop(*[f"_rk{i}" for i in range(len(keys))])


def few_groups(df: DataFrame, keys: Sequence[str], limit: int = BROADCAST_ROWS) -> bool:
    """Size check before a broadcast: one column-pruned pass over the keys."""
    return not keys or few_values(df, keys, [], limit)


def few_values(df: DataFrame, keys: Sequence[str], columns: Sequence[str], limit: int = BROADCAST_ROWS) -> bool:
    """Whether every column has at most ``limit`` distinct (keys, value) combinations."""
    by = [quoted(k) for k in keys]
    counts = df.agg(*[
        F.approx_count_distinct(F.struct(*by, *[quoted(c) for c in cs])) for cs in ([[c] for c in columns] or [[]])
    ]).first()
    return all(n <= limit for n in counts)


def hot_keys(rows: DataFrame, keys: Sequence[str], hot_share: int = HOT_SHARE) -> DataFrame:
    """(_hash, _pieces) of the keys that hold more than 1/``hot_share`` of *all* rows: at most ``hot_share`` rows.

    One pass with a mergeable summary of frequent items, which holds ``TRACKED`` hashes per
    task and misses no key of that share. A key beyond it may be listed too, which does no harm.
    """
    hashed = rows.select(F.xxhash64(*[quoted(k) for k in keys]).alias("_hash"))
    found = hashed.agg(F.expr(f"approx_top_k(_hash, {hot_share}, {TRACKED})").alias("_top"), F.count(F.lit(1)).alias("_n"))
    listed = found.select("_n", F.explode("_top").alias("_i")).where(F.col("_i.count") * hot_share > F.col("_n"))
    return listed.select(F.col("_i.item").alias("_hash"), _pieces(rows, F.col("_i.count") / F.col("_n")))


def _pieces(rows: DataFrame, share: Column) -> Column:
    """Pieces of a key with that share of all rows: 16 in a task's fair part, so that tasks come out even."""
    partitions = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return F.ceil(share * F.lit(16 * partitions)).cast("int").alias("_pieces")


def spread_join(
    rows: DataFrame, table: DataFrame, keys: Sequence[str], hot: DataFrame | None = None
) -> DataFrame:
    """Left join to a table with at most one row per key, although a few keys hold most rows.

    Rows of a hot key are dealt to pieces by a hash of the whole row, and its table row is copied
    to each piece (all copies together number at most 16 per partition and one per hot key). The
    only broadcast is the list ``hot``, of at most ``HOT_SHARE`` hashes.
    """
    hot = hot_keys(rows, keys) if hot is None else hot
    hashable = [quoted(f.name) for f in rows.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn("_h", F.xxhash64(*[quoted(k) for k in keys])).join(
            F.broadcast(hot), F.col("_h") == F.col("_hash"), "left")

    dealt = marked(rows).withColumn("_piece", F.when(
        F.col("_pieces").isNotNull(), F.pmod(F.xxhash64(F.lit("piece"), *hashable), F.col("_pieces")).cast("int")).otherwise(0))
    copied = marked(table).withColumn(
        "_piece", F.explode(F.sequence(F.lit(0), F.coalesce("_pieces", F.lit(1)) - 1))).drop("_h", "_hash", "_pieces")
    return null_safe_join(dealt, copied, [*keys, "_piece"]).drop("_h", "_hash", "_pieces", "_piece")


def attach(df: DataFrame, stats: DataFrame, keys: Sequence[str], small: bool = False) -> DataFrame:
    """Add the columns of ``stats`` (at most one row per key) to every row of ``df``.

    Without keys the single row becomes a scalar subquery, so no join runs at all.
    ``small`` says that the caller has bounded the number of rows of ``stats``;
    otherwise hot keys are spread over all tasks.
    """
    if keys:
        return null_safe_join(df, F.broadcast(stats), keys) if small else spread_join(df, stats, keys)
    packed = stats.select(F.struct(*[quoted(c) for c in stats.columns]).alias("_s")).scalar()
    return df.withColumn("_s", packed).select(
        *[quoted(c) for c in df.columns],
        *[F.col("_s").getField(c).alias(c) for c in stats.columns],
    )


def join_results(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Put two result tables with one row per key side by side (left join on the keys).

    Without keys both have one row, and the two rows are folded into one.
    """
    if keys:
        return null_safe_join(left, right, keys)
    both = left.unionByName(right, allowMissingColumns=True)
    return both.agg(*[F.first(quoted(c), ignorenulls=True).alias(c) for c in both.columns])


def join_by_value(
    rows: DataFrame, table: DataFrame, on: Sequence[str], weight: str,
    small: bool = False, hot_share: int = HOT_SHARE,
) -> DataFrame:
    """Join ``rows`` to a per-value table although a few values hold most rows.

    ``table`` has one row per value with its row count ``weight``; hot values are judged by it
    against all rows. ``small`` says that the caller has checked the size of ``table``: one broadcast.
    """
    payload = table.drop(weight)
    if small:
        return null_safe_join(rows, F.broadcast(payload), on)
    every = table.agg(F.sum(weight)).scalar()
    heavy = table.where(F.col(weight) * F.lit(hot_share) > every)
    hot = heavy.select(F.xxhash64(*[quoted(k) for k in on]).alias("_hash"), _pieces(rows, F.col(weight) / every))
    return spread_join(rows, payload, on, hot.groupBy("_hash").agg(F.max("_pieces").alias("_pieces")))
