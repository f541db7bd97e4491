"""Global order without a single-task window.

A window without ``PARTITION BY`` (or with one hot key) sends everything to one task. Here the
table is cut into ranges of the whole tuple (keys, order columns): a sample of rows, drawn by a
hash of each row, gives cut points with about equally many rows in between, so that hot keys
and ties in the first order columns are cut further down the tuple, whatever its types. Windows
then run per (key, bucket), and what crosses a bucket edge comes from a small table with one row
per bucket of a key that a cut goes through: at most two rows per cut. Tables of up to ``rows``
rows have no cuts. There are at most ``max_buckets`` buckets, which bounds the cuts, the small
table and its broadcast; the sample holds ``SAMPLE`` rows per bucket.

Cut points depend on the rows alone: a recomputed task and every branch of a plan sees the same.
Rows that agree in the whole tuple cannot be parted; rows that agree in every column are drawn
together, so that buckets are uneven where a table consists of few rows repeated often.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from statweave.functions.columns import name, quoted
from statweave.plans.joins import null_safe_join

ROWS_PER_BUCKET = 100_000
MAX_BUCKETS = 4096
#: Sampled rows per bucket: about 9 % deviation of its size.
SAMPLE = 128


def _bucket_limit(df: DataFrame) -> int:
    partitions = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(64, min(MAX_BUCKETS, 4 * partitions))


def _tuple(keys: Sequence[str], order: Sequence[str]) -> Column:
    k = F.struct(*[quoted(c).alias(f"_{i}") for i, c in enumerate(keys)]) if keys else F.struct(F.lit(0).alias("_0"))
    return F.struct(k.alias("k"), F.struct(*[quoted(c).alias(f"_{i}") for i, c in enumerate(order)]).alias("o"))


def cut_points(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int, limit: int) -> Column:
    """Rising (key, order) tuples, a bucket holding what is above one and up to the next; a scalar subquery."""
    hashable = [quoted(f.name) for f in df.schema.fields if not isinstance(f.dataType, (T.MapType, T.VariantType))]
    # The rows of the lowest hashes; how far they reach tells how many rows there are. One task from here on.
    size = SAMPLE * limit
    drawn = df.select(F.xxhash64(*hashable).alias("h"), _tuple(keys, order).alias("t")).orderBy("h").limit(size)
    sample = drawn.groupBy("t").agg(F.count(F.lit(1)).alias("w"), F.max("h").alias("h"))
    whole = Window.orderBy("t").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    upto = whole.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = sample.select(
        "t", (F.sum("w").over(upto) - F.col("w") / 2).alias("middle"), F.sum("w").over(whole).alias("all"), F.max("h").over(whole).alias("h"))
    share = "((cast(h AS double) + 9.2233720368547758E18D) / 1.8446744073709550E19D)"
    estimate = f"CASE WHEN all < {size} THEN all ELSE all / {share} END"
    wanted = f"least({limit}, ceil(({estimate}) / {rows}))"
    ends = placed.select("t", F.expr(f"floor(middle * {wanted} / all)").alias("at")).groupBy("at").agg(F.max("t").alias("t"))
    cuts = ends.agg(F.sort_array(F.collect_list("t")).alias("c"))
    return cuts.select(F.slice("c", 1, F.greatest(F.lit(0), F.size("c") - 1))).scalar()


def steps_of(df: DataFrame, into: str, limit: int, size: str, below: str) -> DataFrame:
    """Add the number of leading entries, of at most ``limit``, for which ``below`` holds: a binary search in generated code.

    ``below`` is SQL over ``{i}``, the index of an entry; ``size`` the number of entries. One projection
    per halving, as a higher-order function would be interpreted for every row. Spark traces filters and join keys,
    also those it infers, down through projections and would write out each of these three times per level: the
    result comes from a generator of one row, where it stops.
    """
    at = name(into)
    out = df.withColumn(into, F.lit(0))
    for k in range(limit.bit_length() - 1, -1, -1):
        w = 1 << k
        hit = f"{at} + {w} <= {size} AND {below.format(i=f'{at} + {w - 1}')}"
        out = out.withColumn(into, F.expr(f"{at} + CASE WHEN {hit} THEN {w} ELSE 0 END"))
    return out.select(*[quoted(c) for c in df.columns], F.explode(F.array(quoted(into))).alias(into))


def _placed(df: DataFrame, keys: Sequence[str], order: Sequence[str], cuts: Column, limit: int, step: str) -> DataFrame:
    """Add ``_b`` and ``_split``; ``step`` compares a cut with a row: ``<`` where a cut ends a bucket, ``<=`` where it starts one."""
    cut = df.withColumns({"_t": _tuple(keys, order), "_cuts": cuts})
    found = steps_of(cut, "_b", limit, "size(_cuts)", f"get(_cuts, {{i}}) {step} _t")
    through = "coalesce(get(_cuts, _b).k <=> _t.k, false) OR coalesce(get(_cuts, _b - 1).k <=> _t.k, false)"
    return found.withColumn("_split", F.expr(f"size(_cuts) > 0 AND ({through})")).drop("_t", "_cuts")


def bucketed(df: DataFrame, keys: Sequence[str], order: Sequence[str] | str, rows: int = ROWS_PER_BUCKET) -> DataFrame:
    """Add ``_b`` (bucket, rising with keys and order) and ``_split`` (a cut goes through the key)."""
    order = [order] if isinstance(order, str) else list(order)
    limit = _bucket_limit(df)
    return _placed(df, keys, order, cut_points(df, keys, order, rows, limit), limit, "<")


def running(
    df: DataFrame, keys: Sequence[str], order: Sequence[str] | str, sums: Sequence[str],
    rows: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add ``cum_s`` (running total up to and including the row) and ``tot_s`` per key."""
    order = [order] if isinstance(order, str) else list(order)
    parts = bucketed(df, keys, order, rows)
    by = [quoted(k) for k in keys]
    # Rows of keys without a cut share one group, dropped after the aggregate: see steps_of on filters.
    cut = [F.when(F.col("_split"), c).alias(c_name) for c, c_name in (*zip(by, keys), (F.col("_b"), "_b"))]
    sizes = parts.groupBy(*cut).agg(
        F.max("_split").alias("_any"), *[F.sum(quoted(s)).alias(f"_sz_{s}") for s in sums]).where("_any")
    every = Window.partitionBy(*by)
    before = every.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        *by, "_b", *[F.sum(f"_sz_{s}").over(every).alias(f"_key_{s}") for s in sums],
        *[F.sum(f"_sz_{s}").over(before).alias(f"_off_{s}") for s in sums],
    )
    inside = Window.partitionBy(*by, F.col("_b")).orderBy(*[quoted(o) for o in order])
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = inside.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = parts.select(
        "*",
        *[F.sum(quoted(s)).over(upto).alias(f"_in_{s}") for s in sums],
        *[F.sum(quoted(s)).over(whole).alias(f"_bk_{s}") for s in sums],
    )
    # At most two rows per cut.
    out = null_safe_join(out, F.broadcast(offsets), [*keys, "_b"])
    return out.select(
        *[quoted(c) for c in df.columns],
        *[F.expr(f"coalesce(`_off_{s}`, 0) + `_in_{s}` AS `cum_{s}`") for s in sums],
        *[F.expr(f"coalesce(`_key_{s}`, `_bk_{s}`) AS `tot_{s}`") for s in sums],
    )


def with_next(
    df: DataFrame, keys: Sequence[str], order: Sequence[str] | str, columns: Sequence[str],
    rows: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """Add ``next_c``: the value of c in the following row of the same key."""
    order = [order] if isinstance(order, str) else list(order)
    limit = _bucket_limit(df)
    cuts = cut_points(df, keys, order, rows, limit)
    parts = _placed(df, keys, order, cuts, limit, "<=")
    by = [quoted(k) for k in keys]
    packed = F.struct(*[quoted(c) for c in columns])
    # A cut is the tuple of a row, the first of its bucket: what follows the bucket before is found by equality.
    starts = df.sparkSession.range(1).select(F.posexplode(cuts).alias("_b", "_cut"))
    found = df.select(*by, packed.alias("_edge"), _tuple(keys, order).alias("_t")).join(
        F.broadcast(starts), F.col("_t") == F.col("_cut"))
    edge = found.groupBy(*by, "_b").agg(F.first("_edge").alias("_edge"))
    inside = Window.partitionBy(*by, F.col("_b")).orderBy(*[quoted(o) for o in order])
    out = null_safe_join(
        parts.drop("_split").withColumn("_next", F.lead(packed).over(inside)), F.broadcast(edge), [*keys, "_b"]
    )
    # The edge follows the bucket's last row alone; other rows have a next one.
    following = F.coalesce(F.col("_next"), F.col("_edge"))
    return out.select(
        *[quoted(c) for c in df.columns],
        *[following.getField(c).alias(f"next_{c}") for c in columns],
    )


def blocks(df: DataFrame, position: str, size: int, lags: Column | int) -> DataFrame:
    """Cut consecutive positions into equal blocks that overlap by ``lags`` rows.

    Adds ``_block`` and ``_halo``; halo rows repeat the end of the previous block
    so that lags can be taken inside one block.
    """
    at = quoted(position)
    home = F.floor(at / F.lit(size)).cast("long")
    near_end = F.pmod(at, F.lit(size)) >= F.lit(size) - lags
    return df.withColumn(
        "_block", F.explode(F.when(near_end, F.array(home, home + 1)).otherwise(F.array(home)))
    ).withColumn("_halo", F.col("_block") != home)
