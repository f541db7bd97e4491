"""Exact quantiles (linear interpolation) that never hold one column in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from statweave.functions.columns import melt, numbers, quoted
from statweave.plans.joins import BROADCAST_ROWS, few_groups, null_safe_join
from statweave.plans.ordered import running

ACCURACY = 10_000
MARGIN = 5.0 / ACCURACY
#: Sketches per group: their rank error is 0.06 % (one standard deviation), the margin ten of these.
KLL_SIZE = 2048
KLL_MARGIN = 0.006
SMALL = 20_000  # up to here the bracket is the whole range: the margin would be under a few rows


def order_statistics(
    x: str, weight: str, cumulative: str, total: str, probs: Sequence[float], prefix: str
) -> list[Column]:
    """Aggregates that pick the two neighbours of each quantile from a running count."""
    picks = []
    for i, p in enumerate(probs):
        low = f"floor({float(p)!r}D * ({total} - 1))"
        for tag, k in (("lo", low), ("hi", f"least({low} + 1, {total} - 1)")):
            here = f"{cumulative} > {k} AND {cumulative} - {weight} <= {k}"
            picks.append(F.expr(f"max(CASE WHEN {here} THEN {x} END) AS {prefix}{tag}{i}"))
    return picks


def between(lo: str, hi: str, share: str) -> str:
    """Interpolation that is exact beside infinities: no arithmetic where none is needed."""
    return f"CASE WHEN {share} = 0 OR {hi} = {lo} THEN {lo} ELSE {lo} + {share} * ({hi} - {lo}) END"


def interpolated(total: str, probs: Sequence[float], prefix: str) -> Column:
    """Array of quantiles from the aggregates of :func:`order_statistics`."""
    parts = []
    for i, p in enumerate(probs):
        h, lo, hi = f"{float(p)!r}D * ({total} - 1)", f"{prefix}lo{i}", f"{prefix}hi{i}"
        parts.append(f"CASE WHEN {total} > 0 THEN {between(lo, hi, f'({h} - floor({h}))')} END")
    return F.expr(f"array({', '.join(parts)})")


def quantiles_of_counts(counts: DataFrame, keys: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """(keys, n, q) from a table (keys, x, w) of distinct values with counts."""
    by = [quoted(k) for k in keys]
    picked = running(counts, keys, "x", ["w"]).groupBy(*by).agg(
        F.max("tot_w").alias("n"), *order_statistics("x", "w", "cum_w", "tot_w", probs, "_")
    )
    return picked.select(*by, "n", interpolated("n", probs, "_").alias("q"))


def exact_quantiles(
    df: DataFrame, columns: Sequence[str], probs: Sequence[float], keys: Sequence[str] = ()
) -> DataFrame:
    """Long frame (keys, column, n, q); q holds one exact quantile per entry of ``probs``.

    A sketch brackets each quantile, and rows below, inside and above the bracket are counted; only
    values inside it (about 1 % of a group, 0.1 % of a whole column) are shuffled. Groups too many
    for a broadcast of their brackets: one combined count per distinct value, then a distributed rank.
    """
    keys = list(keys)
    if keys and not few_groups(df, keys, max(1, BROADCAST_ROWS // (len(columns) * len(probs)))):
        counts = melt(df, columns, keys).groupBy(*[quoted(k) for k in keys], "column", "x").agg(
            F.count(F.lit(1)).alias("w")
        )
        return quantiles_of_counts(counts, [*keys, "column"], probs)
    wide = numbers(df, columns, keys)
    # Short names, and the columns' own names only in the result.
    plain = wide.toDF(*[f"k{i}" for i in range(len(keys))], *[f"c{j}" for j in range(len(columns))])
    found = _bracketed_groups(plain, len(keys), columns, probs) if keys else _bracketed(plain, columns, probs)
    return found.toDF(*keys, "column", "n", "q")


def _bracketed_groups(wide: DataFrame, n_keys: int, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """The same per group, in one pass after the sketches.

    Each row becomes a code per slot (column and quantile): below, inside or above the bracket,
    or missing, with its values where inside. Rows of equal codes without values are counted
    together before the shuffle, so that it holds little but the values inside.
    """
    by = [f"k{i}" for i in range(n_keys)]
    span = range(len(columns))
    cuts = ", ".join(f"{c!r}D" for p in probs for c in (max(0.0, p - KLL_MARGIN), min(1.0, p + KLL_MARGIN)))
    sketch = wide.groupBy(*by).agg(*[e for j in span for e in (
        F.expr(f"CASE WHEN count(c{j}) > 0 THEN kll_sketch_agg_double(c{j}, {KLL_SIZE}) END AS s{j}"),
        F.expr(f"count(c{j}) AS n{j}"), F.expr(f"min(c{j}) AS a{j}"), F.expr(f"max(c{j}) AS z{j}"),
    )]).select(*by, *[F.expr(
        f"CASE WHEN n{j} > {SMALL} THEN kll_sketch_get_quantile_double(s{j}, array({cuts})) "
        f"ELSE flatten(array_repeat(array(a{j}, z{j}), {len(probs)})) END AS b{j}") for j in span])
    # One row per group, of a number that is checked.
    rows = null_safe_join(wide, F.broadcast(sketch), by)
    slots = [(j, i) for j in span for i in range(len(probs))]
    code = "CASE WHEN c{j} IS NULL THEN 3 WHEN c{j} < b{j}[{lo}] THEN 0 WHEN c{j} > b{j}[{hi}] THEN 2 ELSE 1 END"
    codes = [f"cast({code.format(j=j, lo=2 * i, hi=2 * i + 1)} AS tinyint)" for j, i in slots]
    coded = rows.select(*by, F.expr(f"array({', '.join(codes)}) AS e"), *[f"c{j}" for j in span]).select(*by, "e", *[
        F.expr("CASE WHEN " + " OR ".join(f"e[{j * len(probs) + i}] = 1" for i in range(len(probs))) + f" THEN c{j} END AS c{j}") for j in span])
    counted = coded.groupBy(*by, "e", *[f"c{j}" for j in span]).agg(F.count(F.lit(1)).alias("w"))
    # Below: a row with x NULL, which sorts first. Rows above only count in m.
    per_slot = counted.select(*by, F.expr("inline(array(" + ", ".join(
        f"struct({j} AS _j, {i} AS _i, CASE WHEN e[{s}] = 1 THEN c{j} END AS x, "
        f"CASE WHEN e[{s}] < 2 THEN w ELSE 0L END AS w, CASE WHEN e[{s}] < 3 THEN w ELSE 0L END AS m)"
        for s, (j, i) in enumerate(slots)) + "))"))
    sums = per_slot.groupBy(*by, "_j", "_i", "x").agg(F.sum("w").alias("w"), F.sum("m").alias("m"))
    return _picked(sums, by, columns, probs)


def _bracketed(wide: DataFrame, columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    cuts = [v for p in probs for v in (max(0.0, p - MARGIN), min(1.0, p + MARGIN))]
    span = range(len(columns))
    sketch = wide.agg(*[e for j in span for e in (
        F.percentile_approx(f"c{j}", cuts, ACCURACY).alias(f"q{j}"),
        F.expr(f"count(c{j}) AS n{j}"), F.expr(f"min(c{j}) AS a{j}"), F.expr(f"max(c{j}) AS z{j}"),
    )]).select(*[F.expr(
        f"CASE WHEN n{j} > {SMALL} THEN q{j} ELSE flatten(array_repeat(array(a{j}, z{j}), {len(probs)})) END AS c{j}"
    ) for j in span])
    rows = wide.withColumn("_k", sketch.select(F.struct(*sketch.columns)).scalar())
    slots = [(j, i) for j in span for i in range(len(probs))]
    below = rows.agg(
        *[F.expr(f"count(c{j}) AS n{j}") for j in span],
        *[F.expr(f"count_if(c{j} < _k.c{j}[{2 * i}]) AS u{j}_{i}") for j, i in slots],
    )
    base = below.select(F.expr("inline(array(" + ", ".join(
        f"struct({j} AS _j, {i} AS _i, cast(NULL AS double) AS x, u{j}_{i} AS w, n{j} AS m)" for j, i in slots
    ) + "))"))
    inside = {(j, i): f"c{j} BETWEEN _k.c{j}[{2 * i}] AND _k.c{j}[{2 * i + 1}]" for j, i in slots}
    near = rows.where(F.expr(" OR ".join(inside.values()))).select(F.expr("explode(array(" + ", ".join(
        f"CASE WHEN {inside[j, i]} THEN struct({j} AS _j, {i} AS _i, c{j} AS x) END" for j, i in slots
    ) + ")) AS e")).where("e IS NOT NULL").select("e.*")
    counts = near.groupBy("_j", "_i", "x").agg(F.count(F.lit(1)).alias("w")).withColumn("m", F.lit(0).cast("long"))
    # The row with x NULL sorts first and carries the rows below the bracket.
    return _picked(base.unionByName(counts), [], columns, probs)


def _picked(counts: DataFrame, by: Sequence[str], columns: Sequence[str], probs: Sequence[float]) -> DataFrame:
    """Quantiles from (by, _j, _i, x, w, m): counts of the values inside, and below (x NULL); m adds up to the rows of a column."""
    run = running(counts, [*by, "_j", "_i"], "x", ["w", "m"])
    chosen = f"array({', '.join(f'{float(p)!r}D' for p in probs)})[_i]"
    run = run.withColumn("_h", F.expr(f"{chosen} * (tot_m - 1)"))
    low, high = "floor(_h)", "least(floor(_h) + 1, tot_m - 1)"
    per = run.groupBy(*by, "_j", "_i").agg(
        F.max("tot_m").alias("n"), F.max("_h").alias("_h"),
        *[F.expr(f"max(CASE WHEN cum_w > {k} AND cum_w - w <= {k} THEN x END) AS {name}")
          for name, k in (("lo", low), ("hi", high))],
    )
    value = F.expr(
        "CASE WHEN n > 0 THEN CASE WHEN lo IS NULL OR hi IS NULL "
        "THEN cast(raise_error('a quantile fell outside its bracket') AS double) "
        f"ELSE {between('lo', 'hi', '(_h - floor(_h))')} END END"
    )
    names = F.array(*[F.lit(c) for c in columns])
    return per.withColumn("q", value).groupBy(*by, "_j").agg(
        F.max("n").alias("n"), F.expr("transform(array_sort(collect_list(struct(_i, q))), s -> s.q) AS q"),
    ).select(*by, F.get(names, F.col("_j")).alias("column"), "n", "q")
