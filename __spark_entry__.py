
from __future__ import annotations

import os
import sys
from collections.abc import Callable

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import DataFrame, SparkSession, functions as F  # noqa: E402

from oracle_queries import ORACLES  # noqa: E402
from statweave.functions.columns import quoted  # noqa: E402
from statweave.operators import (  # noqa: E402
    clean, describe, distfit, drift, forecast, hypothesis, profile, regression, timeseries,
)
from statweave.sources.tables import preview  # noqa: E402

# The training-data operators are an optional part: their folder, or a package they need, may be missing.
try:
    from corpus_pipeline import ORACLE_SQL, run  # noqa: E402
    from statweave.llm.queries import ORACLES as LLM_ORACLES, QUERIES as LLM_QUERIES  # noqa: E402
except ImportError as error:
    print(f"training-data operators left out: {error}", file=sys.stderr)
    LLM_QUERIES, LLM_ORACLES = {}, {}
else:
    LLM_QUERIES = LLM_QUERIES | {"pipeline": run}
    LLM_ORACLES = LLM_ORACLES | ({"pipeline": ORACLE_SQL} if ORACLE_SQL else {})

SMOKE_DIR = "/root/testdata/sf0.001"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def digits(df: DataFrame, default: int | None = 6, /, **per_column: int) -> DataFrame:
    """Round the double columns, so that both engines can be compared by value."""
    out = []
    for f in df.schema.fields:
        c, n = quoted(f.name), per_column.get(f.name, default)
        if f.dataType.simpleString() == "double" and n is not None:
            c = F.round(c, n) + F.lit(0.0)  # + 0.0 turns −0.0 into 0.0
        out.append(c.alias(f.name))
    return df.select(*out)


def day(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.date_format(n, "yyyy-MM-dd HH:mm:ss") for n in names})


# -- inputs with made gaps: the test tables hold no missing values ------------

def lineitem_gaps(spark, d):
    """Line 3 has no quantity, line 5 a NaN quantity, line 6 no tax."""
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_returnflag",
        F.when(n == 3, F.lit(None)).when(n == 5, F.lit(float("nan"))).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(n == 6, F.lit(None)).otherwise(F.col("l_tax")).alias("l_tax"),
    )


def lineitem_infinite(spark, d):
    n = F.col("l_linenumber")
    return table(spark, d, "lineitem").select(
        F.when(n == 3, F.lit(None)).when(n == 4, F.lit(float("inf"))).otherwise(F.col("l_quantity")).alias("l_quantity"),
        F.when(n == 6, F.lit(float("-inf"))).when(n == 7, F.lit(float("nan"))).otherwise(F.col("l_extendedprice")).alias("l_extendedprice"),
    )


def orders_sides(spark, d):
    """Base: orders before 1998; compared: from 1998, some of them with a new priority or no price."""
    orders = table(spark, d, "orders")
    split = F.lit("1998-01-01").cast("timestamp_ntz")
    later = orders.where(F.col("o_orderdate") >= split)
    year = F.year("o_orderdate")
    return orders.where(F.col("o_orderdate") < split), later.withColumns({
        "o_totalprice": F.when(year == 2000, F.lit(None)).otherwise(F.col("o_totalprice") * 1.05),
        "o_orderpriority": F.when(year == 2001, "0-NOW").otherwise(F.col("o_orderpriority")),
    })


def orders_revised(spark, d):
    orders = table(spark, d, "orders")
    return orders, orders.withColumn("o_totalprice", F.col("o_totalprice") * 0.999 + F.col("o_custkey"))


def flags(spark, d):
    return hypothesis.samples_of_levels(
        table(spark, d, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"], "l_returnflag", "A", "R"
    )


def priced_orders(spark, d):
    return table(spark, d, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", (F.col("o_totalprice") * 0.999 + F.col("o_custkey")).alias("revised")
    )


def lineitem_fit(spark, d):
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_tax"]
    fit = regression.fit_linear(
        table(spark, d, "lineitem"), "l_extendedprice", ["l_quantity", "l_discount"], order_by=order
    )
    return fit, order


def one_feature_fit(spark, d):
    return regression.fit_linear(
        table(spark, d, "orders"), "o_totalprice", ["o_custkey"], order_by=["o_orderkey"]
    )


def customer_fit(spark, d):
    return regression.fit_linear(table(spark, d, "orders"), "o_totalprice", ["o_orderkey"], group_by=["o_custkey"])


def daily_totals(spark, d):
    return table(spark, d, "orders").groupBy("o_orderdate").agg(F.sum("o_totalprice").alias("total"))


def daily_events(spark, d):
    return table(spark, d, "events").groupBy("event_type", F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")).agg(
        F.sum("value").alias("total")
    )


def hourly_events(spark, d):
    return table(spark, d, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(
        F.avg("value").alias("mean")
    )


def resampled(freq: str, agg: str, fill: str, group_by=()):
    def query(spark, d):
        # In cents, whose sums are exact: a mean then rounds alike in both engines.
        cents = table(spark, d, "orders").withColumn("cents", F.round(F.col("o_totalprice") * 100))
        return day(digits(timeseries.resample(cents, "o_orderdate", "cents", freq, agg, fill, group_by), 4), "date")

    return query


def _report(operator):
    return lambda s, d: operator(s, d).report


def _rows(operator, columns, **rounding):
    return lambda s, d: digits(operator(s, d).data.select(*columns), **rounding)


def _fit_rows(out: DataFrame) -> DataFrame:
    """Parameter maps as columns."""
    names = ("s", "loc", "scale", "lambda")
    return digits(out.select(
        *[c for c in out.columns if c != "params"],
        *[F.try_element_at("params", F.lit(n)).alias(f"p_{n}") for n in names],
    ))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    gaps, orders = lineitem_gaps, (lambda s, d: table(s, d, "orders"))
    events, part = (lambda s, d: table(s, d, "events")), (lambda s, d: table(s, d, "part"))
    lineitem = lambda s, d: table(s, d, "lineitem")
    key = ["l_orderkey", "l_partkey", "l_linenumber"]
    labelled = lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id")

    def text_dates(s, d):
        return orders(s, d).select("o_orderkey", F.when(
            F.col("o_orderstatus") == "P", "unknown"
        ).otherwise(F.date_format("o_orderdate", "M/d/yyyy")).alias("placed"), "o_orderpriority")

    def rare(s, d):
        return events(s, d).select(
            F.col("user_id").cast("string").alias("user"), F.date_format("ts", "yyyy-MM-dd HH").alias("hour")
        )

    def two_by_two(s, d):
        return lineitem(s, d).select("l_linestatus", (F.col("l_returnflag") == "R").cast("string").alias("returned"))

    def user_counts(s, d):
        return events(s, d).groupBy("user_id").agg(F.count(F.lit(1)).alias("events"))

    def numeric_out(df):
        return digits(df, psi=6, mean_a=4, mean_b=4, std_a=4, std_b=4, delta=4, delta_percent=4, statistic=4)

    def compare_out(df):
        return digits(
            df.withColumn("decision", F.array_join("decision", ">")), mean_a=4, mean_b=4, std_a=4, std_b=4,
            statistic=4, norm_a_stat=3, norm_b_stat=3,
        )

    def compared(found):
        """What the whole comparison says of each column."""
        verdict = F.when(F.col("drifted"), "drifted").otherwise("stable").alias("verdict")
        return found.numeric.select(F.lit("numeric").alias("section"), "column", "verdict").unionByName(
            found.categorical.select(F.lit("categorical").alias("section"), "column", verdict)
        ).unionByName(found.quality.select(F.lit("quality").alias("section"), "column", F.concat_ws("|", "first_new_categories").alias("verdict")))

    def model_out(df):
        return digits(df, aic=3, bic=3, f=5)

    return {
        # profile and sources
        "profile_orders": lambda s, d: profile.profile(orders(s, d)),
        "missing_lineitem": lambda s, d: profile.missing_profile(gaps(s, d)),
        "missing_by_flag": lambda s, d: profile.missing_profile(gaps(s, d), ["l_returnflag"]),
        "distinct_preview_orders": lambda s, d: profile.distinct_preview(
            orders(s, d), ["o_orderstatus", "o_orderpriority"]
        ).withColumn("values", F.array_join("values", "|")),
        "preview_orders": lambda s, d: preview(orders(s, d)),
        # cleaning
        "promote_dates_orders": lambda s, d: day(clean.promote_dates(text_dates(s, d)), "placed"),
        "drop_missing_lineitem": _rows(lambda s, d: clean.drop_missing(gaps(s, d)), [*key, "l_quantity", "l_tax"]),
        "drop_missing_report": _report(lambda s, d: clean.drop_missing(gaps(s, d), ["l_quantity"])),
        "fill_mean_lineitem": _rows(lambda s, d: clean.fill_missing(gaps(s, d), "mean", ["l_quantity", "l_tax"]), [*key, "l_quantity", "l_tax"]),
        "fill_median_lineitem": _rows(lambda s, d: clean.fill_missing(gaps(s, d), "median", ["l_quantity", "l_tax"]), [*key, "l_quantity", "l_tax"]),
        "fill_mode_lineitem": _rows(lambda s, d: clean.fill_missing(gaps(s, d), "most_frequent", ["l_quantity", "l_tax"]), [*key, "l_quantity", "l_tax"]),
        "fill_mean_by_flag": _rows(lambda s, d: clean.fill_missing(gaps(s, d), "mean", ["l_quantity"], ["l_returnflag"]), [*key, "l_quantity"]),
        "fill_report_lineitem": _report(lambda s, d: clean.fill_missing(gaps(s, d), "mean", ["l_quantity", "l_tax"])),
        "iqr_outliers_events": lambda s, d: digits(clean.outlier_report(events(s, d), ["value"]), 4),
        "iqr_outliers_by_type": lambda s, d: digits(clean.outlier_report(events(s, d), ["value"], ["event_type"]), 4),
        "remove_outliers_events": _rows(lambda s, d: clean.remove_outliers(events(s, d), ["value"]), ["event_id", "value"]),
        "remove_outliers_report": _report(lambda s, d: clean.remove_outliers(events(s, d), ["value"])),
        "encode_priority": lambda s, d: clean.encode_categories(
            orders(s, d).select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("o_orderpriority")),
            ["o_orderpriority"])[0],
        "priority_codes": lambda s, d: clean.category_codes(orders(s, d), ["o_orderpriority", "o_orderstatus"]),
        "scale_standard_part": lambda s, d: digits(clean.scale_standard(part(s, d), ["p_size", "p_retailprice"]).select("p_partkey", "p_size", "p_retailprice")),
        "scale_minmax_part": lambda s, d: digits(clean.scale_minmax(part(s, d), ["p_size", "p_retailprice"]).select("p_partkey", "p_size", "p_retailprice")),
        "scale_standard_by_brand": lambda s, d: digits(clean.scale_standard(part(s, d), ["p_size"], ["p_brand"]).select("p_partkey", "p_size")),
        "clean_regression_rows": lambda s, d: clean.clean_regression_rows(lineitem_infinite(s, d), ["l_quantity", "l_extendedprice"]).report,
        # description
        "describe_orders": lambda s, d: digits(describe.describe(orders(s, d)), 4),
        "describe_lineitem_by_flag": lambda s, d: digits(describe.describe(lineitem(s, d), ["l_quantity", "l_extendedprice", "l_discount"], ["l_returnflag"]), 4),
        "pearson_lineitem": lambda s, d: describe.correlation(lineitem(s, d), "pearson", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], digits=4),
        "pearson_gaps": lambda s, d: describe.correlation(gaps(s, d), "pearson", ["l_partkey", "l_quantity", "l_tax"], digits=4),
        "spearman_part": lambda s, d: describe.correlation(part(s, d), "spearman", ["p_size", "p_retailprice"], digits=4),
        "spearman_gaps": lambda s, d: describe.correlation(gaps(s, d), "spearman", ["l_partkey", "l_quantity", "l_tax"], digits=4),
        "value_counts_events": lambda s, d: digits(describe.value_counts(events(s, d), ["event_type"])),
        "contingency_orders": lambda s, d: describe.contingency(orders(s, d), "o_orderpriority", "o_orderstatus"),
        "histogram_events": lambda s, d: digits(describe.histogram(events(s, d), ["value"]), density=9),
        "ecdf_part_size": lambda s, d: digits(describe.ecdf(part(s, d), ["p_size"])),
        "box_events_by_type": lambda s, d: digits(describe.box_summary(events(s, d), ["value"], ["event_type"]), 4),
        "box_outliers_by_type": lambda s, d: digits(describe.box_outliers(events(s, d), ["value"], ["event_type"])),
        "describe_infinite": lambda s, d: digits(describe.describe(lineitem_infinite(s, d)).select("column", "count", "min", "q25", "median", "q75", "max")),
        "quantile_grid_orders": lambda s, d: describe.quantile_grid(orders(s, d), ["o_totalprice", "o_custkey"]).select(
            "column", F.posexplode("edges").alias("i", "edge")).withColumn("edge", F.round("edge", 4)),
        "upper_median_orders": lambda s, d: describe.upper_median(orders(s, d), ["o_totalprice", "o_custkey"]),
        # hypothesis tests
        "normality_k2_orders": lambda s, d: digits(hypothesis.normality_k2(orders(s, d)), statistic=3),
        "shapiro_by_flag": lambda s, d: digits(hypothesis.shapiro(lineitem(s, d), ["l_quantity", "l_extendedprice"], ["l_returnflag"])),
        "ttest_flags": lambda s, d: digits(hypothesis.student_t(flags(s, d))),
        "welch_flags": lambda s, d: digits(hypothesis.welch_t(flags(s, d)), df=3),
        "levene_flags": lambda s, d: digits(hypothesis.levene(flags(s, d))),
        "cohens_d_flags": lambda s, d: digits(hypothesis.cohens_d(flags(s, d))),
        "mannwhitney_flags": lambda s, d: digits(hypothesis.mann_whitney(flags(s, d)), statistic=1),
        "ks2_flags": lambda s, d: digits(hypothesis.ks_two_sample(flags(s, d))),
        "compare_auto_flags": lambda s, d: compare_out(hypothesis.compare(flags(s, d))),
        "compare_auto_by_user": lambda s, d: hypothesis.compare(
            hypothesis.samples_of_levels(events(s, d), ["value"], "event_type", "click", "view", ["user_id"])),
        "paired_orders": lambda s, d: digits(hypothesis.paired_t(priced_orders(s, d), "o_totalprice", "revised", ["o_orderstatus"])),
        "wilcoxon_orders": lambda s, d: digits(hypothesis.wilcoxon(priced_orders(s, d), "o_totalprice", "revised", ["o_orderstatus"]), statistic=1),
        "wilcoxon_ties_lineitem": lambda s, d: digits(hypothesis.wilcoxon(lineitem(s, d), "l_discount", "l_tax", ["l_linenumber"]), statistic=1),
        "chi2_priority_status": lambda s, d: digits(hypothesis.chi_square(orders(s, d), "o_orderpriority", "o_orderstatus")),
        "chi2_two_by_two": lambda s, d: digits(hypothesis.chi_square(two_by_two(s, d), "l_linestatus", "returned")),
        "chi2_quality_toxic": lambda s, d: digits(hypothesis.chi_square(labelled(s, d), "quality", "toxic")),
        "chi2_low_expected": lambda s, d: digits(hypothesis.chi_square(rare(s, d), "user", "hour").drop("p_value"), 4),
        "fdr_by_line": lambda s, d: digits(hypothesis.benjamini_hochberg(
            hypothesis.chi_square(lineitem(s, d), "l_linestatus", "l_returnflag", ["l_linenumber"])
        ).select("l_linenumber", "chi2", "p_value", "p_corrected", "rejected")),
        # distribution fitting
        "fit_norm_expon_events": lambda s, d: _fit_rows(distfit.fit_distributions(events(s, d), ["value"], candidates=("norm", "expon"))),
        "fit_distributions_by_type": lambda s, d: _fit_rows(distfit.fit_distributions(events(s, d), ["value"], ["event_type"])),
        "fit_poisson_users": lambda s, d: _fit_rows(distfit.fit_distributions(user_counts(s, d), ["events"])),
        "fit_poisson_law_users": lambda s, d: _fit_rows(distfit.fit_distributions(user_counts(s, d), ["events"], candidates=("poisson",))),
        "best_fit_part": lambda s, d: _fit_rows(distfit.best_distribution(distfit.fit_distributions(part(s, d), ["p_size", "p_retailprice"]))),
        "pdf_curve_by_type": lambda s, d: digits(distfit.density_curve(
            events(s, d).select("event_type", "value"), distfit.fit_distributions(events(s, d), ["value"], ["event_type"]), ["event_type"], 20), y=9),
        "pdf_curve_events": lambda s, d: digits(distfit.density_curve(
            events(s, d), distfit.fit_distributions(events(s, d), ["value"], candidates=("norm", "expon"))), y=9),
        # drift
        "drift_structure": lambda s, d: drift.structure_rows(*orders_sides(s, d)),
        "drift_columns": lambda s, d: drift.structure_columns(
            orders(s, d).drop("o_custkey"), orders(s, d).drop("o_orderstatus").withColumn("o_totalprice", F.col("o_totalprice").cast("string"))),
        "drift_quality": lambda s, d: drift.quality(*orders_sides(s, d)).withColumn("first_new_categories", F.array_join("first_new_categories", "|")),
        "drift_new_categories": lambda s, d: drift.new_categories(*orders_sides(s, d)),
        "drift_psi": lambda s, d: digits(drift.psi(*orders_sides(s, d))),
        "drift_numeric": lambda s, d: numeric_out(drift.drift_ranking(drift.numeric_drift(*orders_sides(s, d)))),
        "drift_paired": lambda s, d: numeric_out(drift.numeric_drift(*orders_revised(s, d), id_column="o_orderkey")),
        "drift_judged": lambda s, d: drift.judge_verdicts(
            drift.numeric_drift(*orders_sides(s, d)), {"o_totalprice": "down_good"}).select("column", "verdict", "judgement"),
        "drift_categorical": lambda s, d: digits(drift.categorical_drift(*orders_sides(s, d))),
        "compare_datasets": lambda s, d: compared(drift.compare_datasets(*orders_sides(s, d))),
        "drift_shares": lambda s, d: digits(drift.category_shares(*orders_sides(s, d))),
        # regression
        "ols_lineitem": lambda s, d: digits(regression.coefficients(lineitem_fit(s, d)[0]), coefficient=5, std_error=5),
        "ols_model_lineitem": lambda s, d: model_out(regression.model_summary(lineitem_fit(s, d)[0], normality=False)),
        "durbin_watson_lineitem": lambda s, d: digits(regression.durbin_watson(*lineitem_fit(s, d))),
        "residual_normality_lineitem": lambda s, d: digits(regression.residual_normality(lineitem_fit(s, d)[0])),
        "predict_lineitem": lambda s, d: digits(regression.fitted_line(*lineitem_fit(s, d)).select("l_orderkey", "l_linenumber", "l_partkey", "y_predicted", "position"), 4),
        "predictive_model_orders": lambda s, d: digits(regression.predictive_model(one_feature_fit(s, d)).withColumn(
            "slope", F.col("coefficients")["o_custkey"]).drop("coefficients"), 5),
        "ci_band_orders": lambda s, d: digits(regression.confidence_band(one_feature_fit(s, d)).select("o_orderkey", "x", "y_predicted", "ci_lower", "ci_upper"), 3),
        "ridge_by_customer": lambda s, d: digits(regression.predictive_model(customer_fit(s, d)).withColumn(
            "slope", F.col("coefficients")["o_orderkey"]).drop("coefficients"), 4),
        "model_by_customer": lambda s, d: digits(regression.model_summary(customer_fit(s, d), normality=False), aic=3, bic=3, f=3),
        # time series
        "ts_validate_orders": lambda s, d: timeseries.validate_series(daily_totals(s, d), "o_orderdate", "total").withColumn("suggestions", F.array_join("suggestions", "|")),
        "ts_validate_by_type": lambda s, d: timeseries.validate_series(daily_events(s, d), "day", "total", ["event_type"]).withColumn("suggestions", F.array_join("suggestions", "|")),
        "time_regularity_events": lambda s, d: timeseries.time_regularity(events(s, d)).withColumn("suggestions", F.array_join("suggestions", "|")),
        "resample_daily_mean": resampled("D", "mean", "interpolate"),
        "resample_daily_by_status": resampled("D", "max", "ffill", ["o_orderstatus"]),
        "resample_weekly_sum": resampled("W", "sum", "zero"),
        "resample_monthly_median": resampled("MS", "median", "ffill"),
        "resample_quarter_end_min": resampled("QE", "min", "ffill"),
        "resample_report_orders": lambda s, d: timeseries.resample_report(orders(s, d), "o_orderdate", "o_totalprice"),
        "adf_events_hourly": lambda s, d: timeseries.adf_test(hourly_events(s, d), "mean", ["hour"]).drop("crit"),
        "holt_by_event_type": lambda s, d: day(digits(forecast.holt(daily_events(s, d), "day", "total", 7, ["event_type"]).forecast, 3), "date"),
        "holt_model_by_event_type": lambda s, d: digits(forecast.holt(daily_events(s, d), "day", "total", 7, ["event_type"]).model, 3, alpha=4, beta=4),
        "arima_by_event_type": lambda s, d: forecast.arima(daily_events(s, d), "day", "total", 7, group_by=["event_type"]).forecast,
        "arima_model_by_event_type": lambda s, d: forecast.arima(daily_events(s, d), "day", "total", 7, group_by=["event_type"]).model,
        "future_index_by_type": lambda s, d: day(forecast.future_index(
            forecast.prepare_series(daily_events(s, d), "day", "total", ["event_type"]), 7), "date"),
        "forecast_metrics_orders": lambda s, d: digits(forecast.forecast_metrics(priced_orders(s, d), "o_totalprice", "revised", ["o_orderstatus"]), 4),
    } | LLM_QUERIES


def entry(spark: SparkSession) -> DataFrame:
    """Flagship: numeric drift of the orders from 1998 on against the earlier ones."""
    return drift.numeric_drift(*orders_sides(spark, SMOKE_DIR))


def oracle_sql() -> dict[str, str]:
    return ORACLES | LLM_ORACLES
