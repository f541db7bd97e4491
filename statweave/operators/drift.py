"""Comparison of two datasets: structure, quality, numeric and categorical drift.

A is the base, B the compared side; deltas are B − A.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from statweave.functions.columns import as_double, clean, melt, quoted, ratio
from statweave.functions.labels import DEFAULT, Thresholds, psi_label
from statweave.operators.hypothesis import (
    TwoSamples, benjamini_hochberg, chi_square_finish, decide, paired_t_of, shapiro_of_counts,
    two_sample_table, value_counts_of, wilcoxon_of_counts, with_ks,
)
from statweave.operators.profile import common_columns
from statweave.plans.joins import null_safe_join
from statweave.plans.quantiles import exact_quantiles

PSI_BUCKETS = 10
PSI_FLOOR = 0.0001


class Comparison(NamedTuple):
    structure: DataFrame
    columns: DataFrame
    quality: DataFrame
    numeric: DataFrame
    categorical: DataFrame
    shares: DataFrame


def _literal_rows(df: DataFrame, items: list[Column], schema: str) -> DataFrame:
    """Rows of driver-side metadata as a frame, empty list allowed."""
    spark = df.sparkSession
    if not items:
        return spark.createDataFrame([], schema)
    return spark.range(1).select(F.inline(F.array(*items)))


def structure_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: row counts, their difference, and percent of A (NULL if A is empty)."""
    n_a = a.agg(F.count(F.lit(1)).alias("rows_base"))
    n_b = b.agg(F.count(F.lit(1)).alias("n")).scalar()
    delta = F.col("rows_compare") - F.col("rows_base")
    return n_a.withColumn("rows_compare", n_b).select(
        "rows_base", "rows_compare", delta.alias("rows_delta"),
        F.round(ratio(delta * 100, F.col("rows_base")), 2).alias("rows_delta_percent"),
    )


def structure_columns(a: DataFrame, b: DataFrame) -> DataFrame:
    """Added, removed and retyped columns, and how many values each side holds.

    (column, change, base_type, compare_type, base_values, compare_values); NULL where a side
    does not have the column. The counts of all changed columns take one pass per side.
    """
    types_a = {f.name: f.dataType.simpleString() for f in a.schema.fields}
    types_b = {f.name: f.dataType.simpleString() for f in b.schema.fields}
    changed = [c for c in sorted(types_a.keys() | types_b.keys()) if types_a.get(c) != types_b.get(c)]

    def held(df: DataFrame, types: dict[str, str]) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias("_n"), *[
            (F.count(clean(df, c)) if c in types else F.max(F.lit(None).cast("long"))).alias(f"_{i}") for i, c in enumerate(changed)
        ])

    def item(i: int, name: str) -> Column:
        base, other = types_a.get(name), types_b.get(name)
        change = "added" if base is None else "removed" if other is None else "type_changed"
        return F.struct(
            F.lit(name).alias("column"), F.lit(change).alias("change"),
            F.lit(base).cast("string").alias("base_type"), F.lit(other).cast("string").alias("compare_type"),
            F.col(f"_{i}").alias("base_values"), F.col(f"_b._{i}").alias("compare_values"),
        )

    if not changed:
        return _literal_rows(a, [], "column string, change string, base_type string, compare_type string, "
                                    "base_values long, compare_values long")
    counted = held(b, types_b)
    both = held(a, types_a).withColumn("_b", counted.select(F.struct(*counted.columns)).scalar())
    return both.select(F.inline(F.array(*[item(i, c) for i, c in enumerate(changed)])))


def _missing_percent(df: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[
        F.count(F.when(clean(df, c).isNull(), 1)).alias(f"_m{i}") for i, c in enumerate(columns)
    ])
    percent = [
        F.coalesce(F.round(ratio(F.col(f"_m{i}") * 100, F.col("_n")), 2), F.lit(0.0)) for i in range(len(columns))
    ]
    return wide.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), p.alias(name)) for c, p in zip(columns, percent)
    ])))


def _text_counts(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, ca, cb) for text columns, both sides in one shuffle."""
    def side(df: DataFrame, is_b: int) -> DataFrame:
        return df.select(F.inline(F.array(*[
            F.struct(F.lit(c).alias("column"), quoted(c).alias("value")) for c in columns
        ]))).where(F.col("value").isNotNull()).withColumn("side", F.lit(is_b))

    return side(a, 0).unionByName(side(b, 1)).groupBy("column", "value").agg(
        F.sum(F.lit(1) - F.col("side")).alias("ca"), F.sum("side").alias("cb")
    )


def new_categories(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value): text values that occur only in B, one row each."""
    texts = common_columns(a, b)["categorical"]
    targets = texts if columns is None else [c for c in columns if c in texts]
    if not targets:
        return _literal_rows(a, [], "column string, value string")
    return _text_counts(a, b, targets).where((F.col("ca") == 0) & (F.col("cb") > 0)).select("column", "value")


def quality(
    a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None, thresholds: Thresholds = DEFAULT,
    shown: int = 5,
) -> DataFrame:
    """Missing percent per common column on both sides, and how many text values are new in B.

    ``first_new_categories`` shows up to ``shown`` of them in order; :func:`new_categories`
    gives all as rows, since their number has no bound.
    """
    shared = common_columns(a, b)
    targets = [c for c in shared["all"] if columns is None or c in set(columns)]
    base = _missing_percent(a, targets, "missing_base_pct")
    other = _missing_percent(b, targets, "missing_compare_pct")
    fresh = new_categories(a, b, targets)
    counts = fresh.groupBy("column").agg(F.count(F.lit(1)).alias("_new"))
    # Spark cuts each task's rows to the first few before the shuffle.
    place = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    head = fresh.withColumn("_r", place).where(F.col("_r") <= shown).groupBy("column").agg(
        F.array_sort(F.collect_list("value")).alias("_head")
    )
    # All sides have at most one row per column.
    joined = null_safe_join(base, F.broadcast(other), ["column"])
    joined = null_safe_join(null_safe_join(joined, counts, ["column"]), head, ["column"])
    delta = F.round(F.col("missing_compare_pct") - F.col("missing_base_pct"), 2)
    return joined.select(
        "column", "missing_base_pct", "missing_compare_pct", delta.alias("missing_delta_pct"),
        (delta > thresholds.quality_loss_points).alias("degraded"),
        F.coalesce("_new", F.lit(0).cast("long")).alias("new_category_count"),
        F.coalesce("_head", F.array().cast("array<string>")).alias("first_new_categories"),
    )


# -- numeric drift ------------------------------------------------------------

def two_sides(a: DataFrame, b: DataFrame, columns: Sequence[str]) -> TwoSamples:
    """All common columns of both datasets as one long two-sample frame."""
    long = melt(a, columns).withColumn("side", F.lit(0)).unionByName(melt(b, columns).withColumn("side", F.lit(1)))
    return TwoSamples(long, ("column",), True)  # one key per column


_DECILES = [i / PSI_BUCKETS for i in range(PSI_BUCKETS + 1)]


def _psi_bin() -> list[Column]:
    """Row columns: decile bin of A for x, and the index after the last bin.

    The last bin is closed on the right; values of B outside the range of A are in no bin.
    ``edges_a`` has the distinct deciles, found once per column; a filter of them would be interpreted for every row.
    """
    below = " + ".join(f"CASE WHEN get(edges_a, {i}) <= x THEN 1 ELSE 0 END" for i in range(PSI_BUCKETS + 1))
    return [
        F.expr(f"CASE WHEN x BETWEEN quantiles_a[0] AND quantiles_a[{PSI_BUCKETS}] THEN least({below}, size(edges_a) - 1) - 1 END AS _bin"),
        F.expr("size(edges_a) - 1 AS _last"),
    ]


def _psi_counts() -> list[Column]:
    """Aggregates: rows of each side per bin."""
    return [F.expr("max(_last) AS last")] + [
        F.expr(f"sum(CASE WHEN _bin = {i} THEN c{t} ELSE 0 END) AS _{t}{i}") for i in range(PSI_BUCKETS) for t in "ab"
    ]


def _psi_value() -> Column:
    """Σ (b − a)·ln(b / a) over the bins in use, an empty share counting as 0.0001."""
    def shares(t: str) -> str:
        counts = ", ".join(f"_{t}{i}" for i in range(PSI_BUCKETS))
        return f"transform(slice(array({counts}), 1, last), c -> CASE WHEN c = 0 THEN {PSI_FLOOR!r}D ELSE c / double(n_{t}) END)"

    terms = f"zip_with({shares('a')}, {shares('b')}, (p, q) -> (q - p) * ln(q / p))"
    usable = f"n_a >= {PSI_BUCKETS} AND n_b >= {PSI_BUCKETS} AND last >= 1"
    return F.expr(f"CASE WHEN {usable} THEN aggregate({terms}, 0D, (s, v) -> s + v) ELSE 0D END")


def psi(
    a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None, thresholds: Thresholds = DEFAULT,
    min_rows: int = PSI_BUCKETS,
) -> DataFrame:
    """Population stability index of every common numeric column over the deciles of A.

    With under ten values on a side the index is 0; below ``min_rows`` the label is
    ``insufficient_data``, so that little data does not read as no drift.
    """
    targets = [c for c in common_columns(a, b)["numeric"] if columns is None or c in set(columns)]
    if not targets:
        raise ValueError("the datasets share no numeric column")
    # Cut points from brackets, then one count per bin: no value table is shuffled.
    edges = exact_quantiles(a, targets, _DECILES).select(
        "column", F.col("q").alias("quantiles_a"), F.array_distinct("q").alias("edges_a"))
    rows = null_safe_join(two_sides(a, b, targets).long, F.broadcast(edges), ["column"])  # one row per column
    counts = rows.select("column", "side", *_psi_bin()).groupBy("column", "side", "_bin", "_last").agg(F.count(F.lit(1)).alias("c"))
    binned = counts.selectExpr("column", "_bin", "_last", "if(side = 0, c, 0L) AS ca", "if(side = 1, c, 0L) AS cb").groupBy("column").agg(
        F.sum("ca").alias("n_a"), F.sum("cb").alias("n_b"), *_psi_counts())
    valued = binned.select("column", _psi_value().alias("psi"), F.least("n_a", "n_b").alias("_n"))
    label = F.when(F.col("_n") < min_rows, "insufficient_data").otherwise(psi_label(F.col("psi"), thresholds))
    return valued.withColumn("psi_label", label).drop("_n")


class Pairing(NamedTuple):
    usable: bool
    cancelled: str | None


def pairing(a: DataFrame, b: DataFrame, id_column: str | None) -> Pairing:
    """Whether rows can be paired by id: unique on both sides and at least 3 in common.

    Both sides are counted together per id, so one shuffle answers all questions and
    the driver receives one row.
    """
    if not id_column or id_column not in a.columns or id_column not in b.columns:
        return Pairing(False, None)

    def ids(df: DataFrame, side: int) -> DataFrame:
        return df.select(clean(df, id_column).alias("id"), F.lit(side).alias("side"))

    both = ids(a, 0).unionByName(ids(b, 1)).groupBy("id").agg(
        F.sum(F.lit(1) - F.col("side")).alias("ca"), F.sum("side").alias("cb")
    )
    row = both.agg(
        F.max(F.greatest("ca", "cb")).alias("most"),
        F.count(F.when(F.col("id").isNotNull() & (F.col("ca") > 0) & (F.col("cb") > 0), 1)).alias("common"),
    ).first()
    if (row["most"] or 0) > 1:
        return Pairing(False, "duplicate_ids")
    return Pairing(row["common"] >= 3, None)


def paired_differences(a: DataFrame, b: DataFrame, id_column: str, columns: Sequence[str]) -> DataFrame:
    """(column, x = A − B) over ids present on both sides: one join for all columns."""
    def side(df: DataFrame, tag: str) -> DataFrame:
        return df.select(quoted(id_column).alias("_id"), *[
            as_double(df, c).alias(f"_{tag}{i}") for i, c in enumerate(columns)
        ])

    joined = side(a, "a").join(side(b, "b"), "_id")
    return joined.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column"), (F.col(f"_a{i}") - F.col(f"_b{i}")).alias("x"))
        for i, c in enumerate(columns)
    ]))).where(F.col("x").isNotNull())


def _paired_tests(diffs: DataFrame, alpha: float) -> DataFrame:
    """Per column: paired t where differences look normal, else signed ranks; at least 3 pairs."""
    # The differences are counted once; both tests read that one shuffled table.
    counts = value_counts_of(diffs, ["column"])
    sw = shapiro_of_counts(counts, ["column"], True).withColumn("sd", F.sqrt(ratio(F.col("ss"), F.col("n") - 1)))
    t = paired_t_of(sw.withColumnRenamed("p_value", "sw_p"), ["column"], ["sw_p"]).select(
        "column", F.col("n").alias("pairs"), F.col("statistic").alias("t"), F.col("p_value").alias("t_p"),
        F.col("effect_size").alias("effect"), "sw_p",
    )
    w = wilcoxon_of_counts(counts, ["column"]).select("column", F.col("statistic").alias("w"), F.col("p_value").alias("w_p"))
    joined = null_safe_join(t, w, ["column"])
    normal = F.coalesce(F.col("sw_p") >= alpha, F.lit(False))
    # Without any nonzero difference the signed-rank test has nothing to rank.
    done = (F.col("pairs") >= 3) & (normal | F.col("w").isNotNull())
    return joined.where(done).select(
        "column", F.when(normal, "paired_t").otherwise("wilcoxon").alias("p_test"),
        F.when(normal, F.col("t")).otherwise(F.col("w")).alias("p_stat"),
        F.when(normal, F.col("t_p")).otherwise(F.col("w_p")).alias("p_p"), F.col("effect").alias("p_effect"),
    )


def numeric_drift(
    a: DataFrame, b: DataFrame, id_column: str | None = None, columns: Sequence[str] | None = None,
    thresholds: Thresholds = DEFAULT,
) -> DataFrame:
    """All common numeric columns at once: moments, PSI, KS, test, corrected p and verdict.

    The values of all columns go through one shuffle of (column, value, count A, count B);
    ranks, KS distance, deciles, PSI bins and Levene sums are read off that table.
    """
    targets = [c for c in common_columns(a, b)["numeric"] if columns is None or c in set(columns)]
    if not targets:
        raise ValueError("the datasets share no numeric column")
    alpha = thresholds.alpha
    s = two_sides(a, b, targets)
    table = two_sample_table(s, _DECILES, extra=_psi_counts(), derive=_psi_bin())
    tests = with_ks(decide(table, thresholds)).select(
        "column", "n_a", "n_b", "mean_a", "mean_b", "std_a", "std_b", _psi_value().alias("psi"),
        "ks_stat", "ks_p", "test", "statistic", "p_value", "effect_size",
    )
    names = _literal_rows(a, [F.struct(F.lit(c).alias("column")) for c in targets], "column string")
    out = null_safe_join(names, tests, ["column"])
    pair = pairing(a, b, id_column)
    paired_columns = [c for c in targets if c != id_column]
    if pair.usable and paired_columns:
        out = null_safe_join(
            out, _paired_tests(paired_differences(a, b, id_column, paired_columns), alpha), ["column"]
        )
        is_paired = F.col("p_test").isNotNull()
        for target, source in (("test", "p_test"), ("statistic", "p_stat"), ("p_value", "p_p"), ("effect_size", "p_effect")):
            out = out.withColumn(target, F.when(is_paired, F.col(source)).otherwise(F.col(target)))
        out = out.withColumn("is_paired", is_paired)
    else:
        out = out.withColumn("is_paired", F.lit(False))
    zero = F.lit(0.0)
    out = out.select(
        "column", *[F.coalesce(f"n_{t}", F.lit(0).cast("long")).alias(f"n_{t}") for t in "ab"],
        *[F.coalesce(f"{m}_{t}", zero).alias(f"{m}_{t}") for m in ("mean", "std") for t in "ab"],
        F.coalesce("psi", zero).alias("psi"), F.coalesce("ks_stat", zero).alias("ks_stat"),
        F.coalesce("ks_p", F.lit(1.0)).alias("ks_p"), "is_paired", "test", "statistic", "p_value", "effect_size",
    ).withColumn("delta", F.col("mean_b") - F.col("mean_a"))
    out = benjamini_hochberg(out, alpha=alpha)
    small_effect = F.coalesce(F.abs("effect_size") < thresholds.cohen_negligible, F.lit(False))
    verdict = (
        F.when(F.col("test").isNull(), "insufficient_data")
        .when(F.col("p_value").isNull() | ~F.coalesce(F.col("rejected"), F.lit(True)) | (F.col("p_value") >= alpha), "no_difference")
        .when(small_effect, "significant_small_effect")
        .when(F.col("delta") > 0, "significant_increase")
        .when(F.col("delta") < 0, "significant_decrease")
        .otherwise("significant_difference")
    )
    return out.select(
        "column", "n_a", "n_b", "mean_a", "mean_b", "std_a", "std_b", "delta",
        ratio(F.col("delta") * 100, F.col("mean_a")).alias("delta_percent"),
        "psi", psi_label(F.col("psi"), thresholds).alias("psi_label"), "ks_stat", "ks_p",
        ((F.col("ks_p") < alpha) | (F.col("psi") >= thresholds.psi_significant)).alias("shape_drifted"),
        "is_paired", F.lit(pair.cancelled).cast("string").alias("paired_cancelled_reason"),
        "test", "statistic", "p_value", "effect_size", "p_corrected", verdict.alias("verdict"),
    )


def drift_ranking(numeric: DataFrame) -> DataFrame:
    """Numeric drift rows, strongest PSI first."""
    return numeric.orderBy(F.desc("psi"), "column")


def judge_verdicts(numeric: DataFrame, polarity: dict[str, str]) -> DataFrame:
    """Add ``judgement`` (good, bad, minor, unchanged, neutral) given what growth means.

    ``polarity`` maps a column to ``up_good``, ``down_good`` or ``neutral`` (the default,
    where growth counts as good).
    """
    down = [c for c, p in polarity.items() if p == "down_good"]
    is_down = F.col("column").isin(down) if down else F.lit(False)
    verdict = F.col("verdict")
    grows, falls = verdict == "significant_increase", verdict == "significant_decrease"
    return numeric.withColumn(
        "judgement",
        F.when(verdict == "significant_small_effect", "minor")
        .when(verdict == "no_difference", "unchanged")
        .when((grows & ~is_down) | (falls & is_down), "good")
        .when((falls & ~is_down) | (grows & is_down), "bad")
        .otherwise("neutral"),
    )


# -- categorical drift ----------------------------------------------------------

def categorical_drift(
    a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None, thresholds: Thresholds = DEFAULT
) -> DataFrame:
    """χ² of the 2×K table (side, value) per common text column, FDR over columns.

    The shares per value come as rows from :func:`category_shares`.
    """
    texts = common_columns(a, b)["categorical"]
    targets = [c for c in texts if columns is None or c in set(columns)]
    if not targets:
        raise ValueError("the datasets share no text column")
    counts = _text_counts(a, b, targets)
    # One row per column, so the broadcast is bounded by the schema.
    totals = counts.groupBy("column").agg(F.sum("ca").alias("ta"), F.sum("cb").alias("tb"))
    rows = null_safe_join(counts, F.broadcast(totals), ["column"])
    n = (F.col("ta") + F.col("tb")).cast("double")
    size = F.col("ca") + F.col("cb")
    fit, low = F.lit(0.0), F.lit(0)
    for t in ("a", "b"):
        expected = size * F.col(f"t{t}") / n
        gap = F.col(f"c{t}") - expected
        fit = fit + F.coalesce(ratio(gap * gap, expected), F.lit(0.0))
        low = low + (expected < thresholds.low_expected).cast("int")
    sums = rows.groupBy("column").agg(
        F.max("ta").alias("ta"), F.max("tb").alias("tb"), F.count(F.lit(1)).alias("cols"),
        F.sum(fit).alias("fit"), F.sum(low).alias("low_expected_cells"), F.sum(1 / size).alias("inv_cols"),
        F.max(F.struct(F.col("ca"), size.alias("size"))).alias("_cell"),
    ).where((F.col("ta") > 0) & (F.col("tb") > 0) & (F.col("cols") >= 2))
    table = sums.select(
        "column", (F.col("ta") + F.col("tb")).alias("n"), F.lit(2).cast("long").alias("rows"), "cols", "fit",
        F.lit(0.0).alias("mass"), (F.col("cols") * 2).alias("seen"), (F.col("cols") * 2).alias("total_cells"),
        (1 / F.col("ta") + 1 / F.col("tb")).alias("inv_rows"), "inv_cols",
        F.col("_cell.ca").alias("o"), F.col("ta").alias("ro"), F.col("_cell.size").alias("co"), "low_expected_cells",
    )
    result = benjamini_hochberg(chi_square_finish(table, [F.col("column")], thresholds), alpha=thresholds.alpha)
    return result.select(
        "column", "chi2", "p_value", "dof", "cramers_v", "low_expected_cells", "total_cells", "p_corrected",
        F.coalesce("rejected", F.col("p_value") < thresholds.alpha).alias("drifted"),
    )


def category_shares(a: DataFrame, b: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, value, base_count, compare_count, base_share, compare_share); missing counts as 0."""
    texts = common_columns(a, b)["categorical"]
    targets = [c for c in texts if columns is None or c in set(columns)]
    counts = _text_counts(a, b, targets)
    totals = counts.groupBy("column").agg(F.sum("ca").alias("ta"), F.sum("cb").alias("tb"))
    return null_safe_join(counts, F.broadcast(totals), ["column"]).select(
        "column", "value", F.col("ca").alias("base_count"), F.col("cb").alias("compare_count"),
        ratio(F.col("ca"), F.col("ta")).alias("base_share"), ratio(F.col("cb"), F.col("tb")).alias("compare_share"),
    )


def compare_datasets(
    a: DataFrame, b: DataFrame, id_column: str | None = None, thresholds: Thresholds = DEFAULT
) -> Comparison:
    """Structure, quality, numeric and categorical drift of B against A."""
    return Comparison(
        structure_rows(a, b), structure_columns(a, b), quality(a, b, thresholds=thresholds),
        numeric_drift(a, b, id_column, thresholds=thresholds), categorical_drift(a, b, thresholds=thresholds),
        category_shares(a, b),
    )
