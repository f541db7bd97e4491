"""Frequency codes as integer calendars: timestamp -> unit number -> timestamp.

A code is ``[k]UNIT`` with UNIT one of s, min, h, D, B, W, MS, ME, QS, QE, YS, YE.
Working on unit numbers keeps resampling, gap filling and future dates plain integer
arithmetic that Spark can group, join and explode on.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from statweave.functions.columns import epoch_micros, from_epoch_micros

# Length of the even units in microseconds.
TICKS = {"s": 1_000_000, "min": 60_000_000, "h": 3_600_000_000, "D": 86_400_000_000}
MONTHS = {"MS": 1, "ME": 1, "M": 1, "QS": 3, "QE": 3, "Q": 3, "YS": 12, "YE": 12, "Y": 12}
DAY = TICKS["D"]


def parse_frequency(freq: str) -> tuple[int, str]:
    """("2D") -> (2, "D"); anchors as in "W-SUN" are cut."""
    found = re.fullmatch(r"(\d*)(s|min|h|D|B|W|MS|ME|QS|QE|YS|YE|M|Q|Y)(-[A-Z]+)?", freq)
    if not found:
        raise ValueError(f"unknown frequency {freq!r}")
    return int(found[1] or 1), found[2]


def day_number(ts: Column) -> Column:
    return F.unix_date(ts.cast("date")).cast("long")


def unit_number(ts: Column, unit: str) -> Column:
    """Number of the calendar unit that holds ``ts``, rising by one per unit."""
    if unit in TICKS:
        return F.floor(_exact_div(epoch_micros(ts), TICKS[unit]))
    if unit == "W":
        return F.floor(_exact_div(day_number(ts) + 3, 7))
    if unit == "B":
        days = day_number(ts) + 3
        return F.floor(_exact_div(days, 7)) * 5 + F.least(F.pmod(days, F.lit(7)), F.lit(4))
    months = F.year(ts).cast("long") * 12 + F.month(ts) - 1
    return F.floor(_exact_div(months, MONTHS[unit]))


def _exact_div(a: Column, b: int) -> Column:
    """Quotient as decimal, so that flooring is exact for large counts."""
    return a.cast("decimal(20,0)") / F.lit(b).cast("decimal(20,0)") if b > 1 else a


def origin_unit(first: Column, unit: str) -> Column:
    """Unit number from which multiples are counted: even units start at midnight."""
    if unit in TICKS and unit != "D":
        return (day_number(first) * (DAY // TICKS[unit])).cast("long")
    return unit_number(first, unit).cast("long")


def bucket_number(offset: Column, freq: str) -> Column:
    """Bucket of a unit ``offset`` units after the origin.

    Units named by their end close their buckets on the right: the first unit stands
    alone and every bucket after it takes k units.
    """
    k, unit = parse_frequency(freq)
    ends = unit == "W" or unit in MONTHS and not unit.endswith("S")
    return F.floor(_exact_div(offset + (k - 1) if ends else offset, k)).cast("long")


def label(origin: Column, bucket: Column, freq: str) -> Column:
    """Timestamp that names bucket number ``bucket`` counted from unit ``origin``."""
    k, unit = parse_frequency(freq)
    start = origin + bucket * k
    if unit in TICKS:
        return from_epoch_micros(start * F.lit(TICKS[unit]))
    if unit == "W":  # weeks are named by their Sunday
        return _day(start * 7 + 3)
    if unit == "B":
        return _day(F.floor(_exact_div(start, 5)).cast("long") * 7 + F.pmod(start, F.lit(5)) - 3)
    size = MONTHS[unit]
    if unit.endswith("S"):
        return _month(start * size)
    return F.last_day(_month((start + 1) * size - 1).cast("date")).cast("timestamp_ntz")


def _day(days: Column) -> Column:
    return F.date_from_unix_date(days.cast("int")).cast("timestamp_ntz")


def _month(months: Column) -> Column:
    year = F.floor(_exact_div(months, 12)).cast("int")
    return F.make_date(year, F.pmod(months, F.lit(12)).cast("int") + 1, F.lit(1)).cast("timestamp_ntz")


def shifted(last: Column, freq: Column, steps: Column) -> Column:
    """``last`` moved on by ``steps`` periods of an inferred frequency column; NULL if none."""
    k = F.coalesce(F.nullif(F.regexp_extract(freq, r"^(\d*)", 1), F.lit("")), F.lit("1")).cast("long") * steps
    unit = F.regexp_extract(freq, r"^\d*([A-Za-z]+)", 1)
    out = F.lit(None).cast("timestamp_ntz")
    for code, size in {**TICKS, "ms": 1000, "us": 1, "W": 7 * DAY}.items():
        out = F.when(unit == code, from_epoch_micros(epoch_micros(last) + k * F.lit(size))).otherwise(out)
    time_of_day = last - F.date_trunc("day", last).cast("timestamp_ntz")
    for code in ("MS", "QS", "YS", "ME", "QE", "YE"):
        moved = F.add_months(last.cast("date"), (k * MONTHS[code]).cast("int"))
        if code.endswith("E"):
            moved = F.last_day(moved)
        out = F.when(unit == code, moved.cast("timestamp_ntz") + time_of_day).otherwise(out)
    workday = unit_number(last, "B").cast("long") + k
    days = F.floor(_exact_div(workday, 5)).cast("long") * 7 + F.pmod(workday, F.lit(5)) - 3
    return F.when(unit == "B", _day(days) + time_of_day).otherwise(out)
