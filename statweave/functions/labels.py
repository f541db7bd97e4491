"""Verbal labels for effect sizes and fit measures, as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F


@dataclass(frozen=True)
class Thresholds:
    """Decision limits. Fixed values, equal to the defaults users know."""

    alpha: float = 0.05
    vif: float = 10.0
    psi_moderate: float = 0.1
    psi_significant: float = 0.2
    cohen_negligible: float = 0.2
    cohen_small: float = 0.5
    cohen_medium: float = 0.8
    cohen_large: float = 1.2
    biserial_negligible: float = 0.1
    biserial_small: float = 0.3
    biserial_large: float = 0.5
    cramer_none: float = 0.1
    cramer_weak: float = 0.3
    cramer_strong: float = 0.5
    low_expected: float = 5.0
    quality_loss_points: float = 5.0
    durbin_low: float = 1.5
    durbin_high: float = 2.5


DEFAULT = Thresholds()

# Frequency code -> description.
FREQUENCY_NAMES = {
    "D": "daily", "B": "business days", "W": "weekly",
    "MS": "monthly (start)", "ME": "monthly (end)", "M": "monthly",
    "QS": "quarterly (start)", "QE": "quarterly (end)", "Q": "quarterly",
    "YS": "yearly (start)", "YE": "yearly (end)", "Y": "yearly",
    "h": "hourly", "min": "minutely", "s": "secondly",
}


def steps(x: Column, limits: list[tuple[float, str]], last: str) -> Column:
    """First label whose limit lies above x, else ``last``; NULL stays NULL."""
    out = F.when(x.isNull(), F.lit(None).cast("string"))
    for limit, label in limits:
        out = out.when(x < F.lit(limit), F.lit(label))
    return out.otherwise(F.lit(last))


def cohen_label(d: Column, t: Thresholds = DEFAULT) -> Column:
    return steps(F.abs(d), [
        (t.cohen_negligible, "negligible"), (t.cohen_small, "small"),
        (t.cohen_medium, "medium"), (t.cohen_large, "large"),
    ], "very_large")


def biserial_label(r: Column, t: Thresholds = DEFAULT) -> Column:
    return steps(F.abs(r), [
        (t.biserial_negligible, "negligible"), (t.biserial_small, "small"),
        (t.biserial_large, "medium"),
    ], "large")


def cramer_label(v: Column, t: Thresholds = DEFAULT) -> Column:
    return steps(v, [
        (t.cramer_none, "none"), (t.cramer_weak, "weak"), (t.cramer_strong, "moderate"),
    ], "strong")


def psi_label(psi: Column, t: Thresholds = DEFAULT) -> Column:
    return steps(psi, [(t.psi_moderate, "none"), (t.psi_significant, "moderate")], "significant")


def stars(p: Column) -> Column:
    return steps(p, [(0.001, "***"), (0.01, "**"), (0.05, "*")], "")


def r2_label(r2: Column) -> Column:
    return (
        F.when(r2 >= 0.9, "very_strong").when(r2 >= 0.7, "strong")
        .when(r2 >= 0.5, "moderate").when(r2 >= 0.3, "weak")
        .when(r2.isNotNull(), "none")
    )


def durbin_watson_label(dw: Column, t: Thresholds = DEFAULT) -> Column:
    return (
        F.when(dw < t.durbin_low, "positive")
        .when(dw > t.durbin_high, "negative")
        .when(dw.isNotNull(), "none")
    )


def mape_label(mape: Column) -> Column:
    return steps(mape, [(10.0, "high"), (20.0, "good"), (50.0, "moderate")], "low")


def shape_label(skew: Column, kurt: Column, constant: Column) -> Column:
    side = F.when(skew > 0.5, "right").when(skew < -0.5, "left").when(skew.isNotNull(), "symmetric")
    peak = F.when(kurt > 0.5, "peaked").when(kurt < -0.5, "flat").when(kurt.isNotNull(), "mesokurtic")
    return F.when(constant, "constant").otherwise(F.concat_ws("; ", side, peak))


def frequency_name(freq: Column) -> Column:
    """Description of a frequency code; multiples ("2D") and anchors ("W-SUN") are cut."""
    table = F.create_map(*[F.lit(v) for pair in FREQUENCY_NAMES.items() for v in pair])
    base = F.regexp_extract(freq, r"^[0-9]*([A-Za-z]+)", 1)
    return F.coalesce(F.try_element_at(table, base), freq)
