"""Descriptive statistics, correlations, counts, histograms, distribution functions."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from statweave.functions.keys import reserved_keys
from statweave.functions.columns import (
    clean, kind_of, melt, name, numbers, numeric_columns, quoted, ratio, rounded,
)
from statweave.functions.labels import shape_label
from statweave.operators.clean import with_fences
from statweave.plans.joins import BROADCAST_ROWS, attach, few_groups, join_by_value, null_safe_join
from statweave.plans.ordered import running
from statweave.plans.quantiles import exact_quantiles


MAX_PAIRS = 200


def by_column(stats: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join two (keys, column, ...) tables; without groups they have one row per column."""
    return null_safe_join(stats, other if keys else F.broadcast(other), [*keys, "column"])


def unbiased_skewness(g1: Column, n: Column) -> Column:
    return F.when(n > 2, F.sqrt(n * (n - 1.0)) / (n - 2.0) * g1)


def unbiased_kurtosis(g2: Column, n: Column) -> Column:
    return F.when(n > 3, (n - 1.0) / ((n - 2.0) * (n - 3.0)) * ((n + 1.0) * g2 + 6.0))


@reserved_keys
def describe(
    df: DataFrame, columns: Sequence[str] | None = None, group_by: Sequence[str] = (),
    digits: int | None = None, exact: bool = True,
) -> DataFrame:
    """Extended statistics, one row per numeric column with at least one value.

    ``exact=False`` takes the quartiles from a sketch in the same pass.
    """
    targets = numeric_columns(df, columns, exclude=group_by)
    keys = [quoted(k) for k in group_by]
    wide = numbers(df, targets, group_by)
    stats = [("count", F.count), ("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max),
             ("g1", F.skewness), ("g2", F.kurtosis)]
    if not exact:
        stats.append(("q", lambda c: F.percentile_approx(c, [0.25, 0.5, 0.75], 10_000)))
    out = wide.groupBy(*keys).agg(*[
        fn(quoted(c)).alias(f"_{name}{i}") for i, c in enumerate(targets) for name, fn in stats
    ]).select(*keys, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), *[F.col(f"_{name}{i}").alias(name) for name, _ in stats])
        for i, c in enumerate(targets)
    ]))).where(F.col("count") > 0)
    if exact:
        quartiles = exact_quantiles(df, targets, [0.25, 0.5, 0.75], group_by).drop("n")
        out = by_column(out, quartiles, group_by)
    constant = F.col("min") == F.col("max")
    n = F.col("count").cast("double")
    skew = F.when(constant, F.lit(0.0)).otherwise(unbiased_skewness(F.col("g1"), n))
    kurt = F.when(constant, F.lit(0.0)).otherwise(unbiased_kurtosis(F.col("g2"), n))
    return rounded(out.select(
        *keys, "column", "count", "mean", F.get("q", F.lit(1)).alias("median"), "std", "min", "max",
        F.get("q", F.lit(0)).alias("q25"), F.get("q", F.lit(2)).alias("q75"),
        skew.alias("skewness"), kurt.alias("kurtosis"),
        F.when(constant, F.lit(0.0)).otherwise(F.col("std") / F.sqrt(n)).alias("sem"),
        constant.alias("is_constant"), shape_label(skew, kurt, constant).alias("shape"),
    ), digits)


def _mirrored(pairs: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both orders of every pair; a column with itself appears once."""
    return pairs.select(*[quoted(k) for k in keys], F.explode(F.when(
        F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("column_a"), F.col("b").alias("column_b")))
    ).otherwise(F.array(
        F.struct(F.col("a").alias("column_a"), F.col("b").alias("column_b")),
        F.struct(F.col("b").alias("column_a"), F.col("a").alias("column_b")),
    ))).alias("p"), "r").select(*[quoted(k) for k in keys], "p.*", "r")


@reserved_keys
def correlation(
    df: DataFrame, method: str = "pearson", columns: Sequence[str] | None = None,
    group_by: Sequence[str] = (), digits: int | None = None,
) -> DataFrame:
    """(column_a, column_b, r) on pairwise complete rows; 0 where r is undefined."""
    targets = numeric_columns(df, columns, exclude=group_by)
    wide = numbers(df, targets, group_by)
    pairs = list(combinations(targets, 2))
    keys = [quoted(k) for k in group_by]
    varies = [F.coalesce(F.min(quoted(c)) < F.max(quoted(c)), F.lit(False)) for c in targets]
    own = [(v.cast("double")).alias(f"_d{i}") for i, v in enumerate(varies)]
    diagonal = [
        F.struct(F.lit(c).alias("a"), F.lit(c).alias("b"), F.col(f"_d{i}").alias("r"))
        for i, c in enumerate(targets)
    ]
    if method == "pearson":
        # Many columns: several aggregates of bounded size instead of one that outgrows
        # generated code; each reads only its own columns.
        chunks = [pairs[i:i + MAX_PAIRS] for i in range(0, len(pairs), MAX_PAIRS)] or [[]]
        tables = []
        for number, chunk in enumerate(chunks):
            cross, items = [], list(diagonal) if number == 0 else []
            for i, (a, b) in enumerate(chunk):
                both = quoted(a).isNotNull() & quoted(b).isNotNull()
                x, y = F.when(both, quoted(a)), F.when(both, quoted(b))
                # corr() divides by zero on a constant column, so r is put together from its parts.
                r = ratio(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
                cross.append(F.coalesce(r, F.lit(0.0)).alias(f"_p{i}"))
                items.append(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"_p{i}").alias("r")))
            one = wide.groupBy(*keys).agg(*(own if number == 0 else []), *cross)
            tables.append(one.select(*keys, F.inline(F.array(*items))))
        table = reduce(DataFrame.unionByName, tables)
    elif method == "spearman":
        table = wide.groupBy(*keys).agg(*own).select(*keys, F.inline(F.array(*diagonal)))
        if pairs:
            table = table.unionByName(_rank_correlations(wide, targets, group_by))
    else:
        raise ValueError(f"unknown method {method!r}")
    return rounded(_mirrored(table, group_by), digits)


def _rank_correlations(wide: DataFrame, targets: list[str], group_by: Sequence[str]) -> DataFrame:
    """(keys, a, b, r): every value is ranked once among all rows and once among the rows that each column
    with gaps leaves, so that a pair finds its ranks in two small arrays and no row is copied per pair.

    Equal rows are one tuple with a count. Tuples go to rows of (tuple id, column, value), meet their
    ranks, and come together again by id.
    """
    keys, by = list(group_by), [quoted(k) for k in group_by]
    # One row of driver results: which columns have gaps, and whether rank tables are small.
    facts = wide.agg(
        F.count(F.lit(1)), *[F.count(quoted(c)) for c in targets],
        *[F.approx_count_distinct(F.struct(*by, quoted(c))) for c in targets],
    ).first()
    gaps = [c for c, n in zip(targets, facts[1:]) if n < facts[0]]
    slot = {c: gaps.index(c) + 1 if c in gaps else 0 for c in targets}
    slots = range(len(gaps) + 1)
    small = sum(facts[len(targets) + 1:]) * (len(gaps) + 1) <= BROADCAST_ROWS

    tuples = wide.groupBy(*by, *[quoted(c) for c in targets]).agg(F.count(F.lit(1)).alias("w"))
    every = [*by, *[quoted(c) for c in targets]]
    counted = F.array(F.col("w"), *[F.when(quoted(c).isNotNull(), F.col("w")).otherwise(F.lit(0)) for c in gaps])
    long = tuples.select(
        *by, F.struct(F.xxhash64(*every).alias("h"), F.xxhash64(F.lit("second"), *every).alias("g")).alias("id"), "w",
        counted.alias("m"), F.posexplode(F.array(*[quoted(c) for c in targets])).alias("c", "x"),
    ).where(F.col("x").isNotNull())
    marginal = long.groupBy(*by, "c", "x").agg(
        *[F.sum(F.col("m")[j]).alias(f"t{j}") for j in slots], F.count(F.lit(1)).alias("cells"))
    run = running(marginal, [*keys, "c"], "x", [f"t{j}" for j in slots])
    # Average rank of a value = running count − (ties − 1) / 2, here less the middle rank.
    ranks = run.select(*by, "c", "x", "cells", F.array(*[
        F.col(f"cum_t{j}") - F.col(f"t{j}") / F.lit(2.0) - F.col(f"tot_t{j}") / F.lit(2.0) for j in slots
    ]).alias("r"))
    ranked = join_by_value(long.drop("m"), ranks, [*keys, "c", "x"], "cells", small)
    together = ranked.groupBy(*by, "id").agg(
        F.max("w").alias("w"), F.map_from_entries(F.collect_list(F.struct("c", "r"))).alias("_r"))
    rows = together.select(*by, "w", *[
        F.try_element_at("_r", F.lit(i)).alias(f"_r{i}") for i in range(len(targets))])
    at = {c: i for i, c in enumerate(targets)}
    pairs, tables = list(combinations(targets, 2)), []
    for chunk in (pairs[i:i + MAX_PAIRS] for i in range(0, len(pairs), MAX_PAIRS)):
        sums, items = [], []
        for i, (a, b) in enumerate(chunk):
            # Missing where either value is, as then one of the two arrays is. Text, as many small columns build slowly.
            x, y = f"_r{at[a]}[{slot[b]}]", f"_r{at[b]}[{slot[a]}]"
            sums += [f"w * {x} * {y} AS _xy{i}", f"w * {x} * {x} + 0 * {y} AS _xx{i}", f"w * {y} * {y} + 0 * {x} AS _yy{i}"]
            r = f"CASE WHEN _xx{i} > 0 AND _yy{i} > 0 THEN _xy{i} / (sqrt(_xx{i}) * sqrt(_yy{i})) ELSE 0D END"
            items.append(f"struct({at[a]} AS i, {at[b]} AS j, CASE WHEN _xy{i} IS NOT NULL THEN {r} END AS r)")
        products = rows.selectExpr(*[name(k) for k in keys], *sums)
        totals = products.groupBy(*by).agg(*[
            F.expr(f"sum(_{p}{i}) AS _{p}{i}") for i in range(len(chunk)) for p in ("xy", "xx", "yy")])
        tables.append(totals.selectExpr(*[name(k) for k in keys], f"inline(array({', '.join(items)}))"))
    names = F.array(*[F.lit(c) for c in targets])
    found = reduce(DataFrame.unionByName, tables).where(F.col("r").isNotNull())
    return found.select(*by, names[F.col("i")].alias("a"), names[F.col("j")].alias("b"), "r")


@reserved_keys
def value_counts(df: DataFrame, columns: Sequence[str], group_by: Sequence[str] = ()) -> DataFrame:
    """(column, value, count, share) of the non-missing values."""
    keys = [quoted(k) for k in group_by]
    long = df.select(*keys, F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), clean(df, c).cast("string").alias("value")) for c in columns
    ]))).where(F.col("value").isNotNull())
    counts = long.groupBy(*keys, "column", "value").agg(F.count(F.lit(1)).alias("count"))
    totals = counts.groupBy(*keys, "column").agg(F.sum("count").alias("_t"))
    return by_column(counts, totals, group_by).select(
        *keys, "column", "value", "count", ratio(F.col("count"), F.col("_t")).alias("share")
    )


@reserved_keys
def contingency(df: DataFrame, a: str, b: str, group_by: Sequence[str] = ()) -> DataFrame:
    """(value_a, value_b, count) where both values are present."""
    return df.select(
        *[quoted(k) for k in group_by], clean(df, a).cast("string").alias("value_a"),
        clean(df, b).cast("string").alias("value_b"),
    ).where(F.col("value_a").isNotNull() & F.col("value_b").isNotNull()).groupBy(
        *[quoted(k) for k in group_by], "value_a", "value_b"
    ).agg(F.count(F.lit(1)).alias("count"))


def check_categorical(df: DataFrame, columns: Sequence[str], limit: int = 20) -> None:
    """Refuse numeric columns with more than ``limit`` distinct values."""
    numeric = [c for c in columns if kind_of(df.schema[c].dataType) == "numeric"]
    for c in numeric:
        distinct = df.select(clean(df, c).alias("v")).where(F.col("v").isNotNull()).distinct()
        if distinct.limit(limit + 1).count() > limit:
            raise ValueError(f"column {c!r} is numeric with more than {limit} distinct values")


@reserved_keys
def histogram(
    df: DataFrame, columns: Sequence[str] | None = None, bins: int = 30, group_by: Sequence[str] = ()
) -> DataFrame:
    """Equal-width bins between minimum and maximum, empty bins included."""
    targets = numeric_columns(df, columns, exclude=group_by)
    keys = [quoted(k) for k in group_by]
    long = melt(df, targets, group_by)
    spans = long.groupBy(*keys, "column").agg(
        F.min("x").alias("_min"), F.max("x").alias("_max"), F.count(F.lit(1)).alias("_n")
    ).withColumn("_lo", F.when(F.col("_min") < F.col("_max"), F.col("_min")).otherwise(F.col("_min") - 0.5)
                 ).withColumn("_hi", F.when(F.col("_min") < F.col("_max"), F.col("_max")).otherwise(F.col("_max") + 0.5))
    width = F.col("_hi") - F.col("_lo")
    at = F.floor((F.col("x") - F.col("_lo")) * F.lit(bins) / width).cast("int")
    # One row per group and column; hot groups are spread where that is too much for a broadcast.
    small = few_groups(df, group_by, BROADCAST_ROWS // max(1, len(targets)))
    counts = attach(long, spans, [*group_by, "column"], small=small).groupBy(
        *keys, "column", F.least(F.lit(bins - 1), at).alias("bin")
    ).agg(F.count(F.lit(1)).alias("_c"))
    frame = spans.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = null_safe_join(frame, counts, [*group_by, "column", "bin"])
    count = F.coalesce(F.col("_c"), F.lit(0).cast("long"))
    return out.select(
        *keys, "column", "bin",
        (F.col("_lo") + F.col("bin") * width / F.lit(bins)).alias("lo"),
        (F.col("_lo") + (F.col("bin") + 1) * width / F.lit(bins)).alias("hi"),
        count.alias("count"),
        (count * F.lit(float(bins)) / (F.col("_n") * width)).alias("density"),
    )


@reserved_keys
def ecdf(df: DataFrame, columns: Sequence[str] | None = None, group_by: Sequence[str] = ()) -> DataFrame:
    """(column, x, ecdf) at every distinct value."""
    targets = numeric_columns(df, columns, exclude=group_by)
    keys = [*group_by, "column"]
    counts = melt(df, targets, group_by).groupBy(*[quoted(k) for k in keys], "x").agg(F.count(F.lit(1)).alias("w"))
    run = running(counts, keys, "x", ["w"])
    return run.select(*[quoted(k) for k in keys], "x", ratio(F.col("cum_w"), F.col("tot_w")).alias("ecdf"))


@reserved_keys
def box_summary(df: DataFrame, columns: Sequence[str] | None = None, group_by: Sequence[str] = ()) -> DataFrame:
    """Quartiles, whiskers (extreme values inside the fences) and number of outliers."""
    targets = numeric_columns(df, columns, exclude=group_by)
    keys = [quoted(k) for k in group_by]
    middle = ("q1", "median", "q3")
    rows = with_fences(numbers(df, targets, group_by), targets, group_by, middle)
    aggs = []
    for i, c in enumerate(targets):
        x = quoted(c)
        inside = (x >= F.col(f"_lo{i}")) & (x <= F.col(f"_hi{i}"))
        aggs += [
            F.min(F.when(inside, x)).alias(f"_wl{i}"), F.max(F.when(inside, x)).alias(f"_wh{i}"),
            F.count(F.when(~inside, 1)).alias(f"_no{i}"), *[F.max(f"_{m}{i}").alias(f"_{m}{i}") for m in middle],
        ]
    return rows.groupBy(*keys).agg(*aggs).select(*keys, F.inline(F.array(*[
        F.struct(
            F.lit(c).alias("column"), F.col(f"_wl{i}").alias("whisker_low"), *[F.col(f"_{m}{i}").alias(m) for m in middle],
            F.col(f"_wh{i}").alias("whisker_high"), F.col(f"_no{i}").alias("n_outliers"),
        ) for i, c in enumerate(targets)
    ])))


@reserved_keys
def box_outliers(df: DataFrame, columns: Sequence[str] | None = None, group_by: Sequence[str] = ()) -> DataFrame:
    """(column, x): the values outside the fences of :func:`box_summary`, one row each."""
    targets = numeric_columns(df, columns, exclude=group_by)
    rows = with_fences(numbers(df, targets, group_by), targets, group_by)
    outside = [F.when((quoted(c) < F.col(f"_lo{i}")) | (quoted(c) > F.col(f"_hi{i}")), F.struct(
        F.lit(c).alias("column"), quoted(c).alias("x"))) for i, c in enumerate(targets)]
    found = rows.select(*[quoted(k) for k in group_by], F.explode(F.array(*outside)).alias("_o")).where("_o IS NOT NULL")
    return found.select(*[quoted(k) for k in group_by], "_o.column", "_o.x")


@reserved_keys
def quantile_grid(
    df: DataFrame, columns: Sequence[str] | None = None, parts: int = 10, group_by: Sequence[str] = ()
) -> DataFrame:
    """(column, edges): the distinct 0, 1/parts, …, 1 quantiles."""
    targets = numeric_columns(df, columns, exclude=group_by)
    probs = [i / parts for i in range(parts + 1)]
    q = exact_quantiles(df, targets, probs, group_by)
    return q.select(*[quoted(k) for k in group_by], "column", F.array_distinct("q").alias("edges"))


@reserved_keys
def upper_median(df: DataFrame, columns: Sequence[str] | None = None, group_by: Sequence[str] = ()) -> DataFrame:
    """(column, value): the element at position n // 2 of the sorted values."""
    targets = numeric_columns(df, columns, exclude=group_by)
    keys = [*group_by, "column"]
    counts = melt(df, targets, group_by).groupBy(*[quoted(k) for k in keys], "x").agg(F.count(F.lit(1)).alias("w"))
    run = running(counts, keys, "x", ["w"])
    k = F.floor(F.col("tot_w") / 2)
    here = (F.col("cum_w") > k) & (F.col("cum_w") - F.col("w") <= k)
    return run.where(here).select(*[quoted(c) for c in keys], F.col("x").alias("value"))
