"""Scalar functions of the rule language as Spark columns: money, numbers, dates, durations and periods.

Money is decimal(18,2). Rounding is half away from zero. Durations are structs of months and days; periods are structs
of two dates that both belong to them. ``ceiling`` and ``floor`` are bounds, not roundings.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(18,2)"


def money_times(money: Column, factor: Column) -> Column:
    return F.round(money.cast(MONEY) * factor, 2).cast(MONEY)


def money_over(money: Column, divisor: Column, scale: int = 6) -> Column:
    """Exact: one rounding to the cent, null where the divisor is 0. The divisor has at most ``scale`` decimals."""
    whole = "decimal(38,0)"
    n = (money.cast(MONEY) * 100).cast(whole) * F.lit(10**scale).cast("decimal(10,0)")
    d = F.abs((divisor * F.lit(10**scale)).cast("decimal(18,0)")).cast(whole)
    cents = F.floor(F.try_divide((F.abs(n).cast("decimal(36,0)") * 2 + d), d * 2))
    return (F.signum(money) * F.signum(divisor) * cents.cast("decimal(18,0)") / 100).cast(MONEY)


def truncate(x: Column) -> Column:
    return x.cast("bigint")


def round_units(x: Column) -> Column:
    return F.round(x, 0).cast("bigint")


def at_most(x: Column, bound: Column) -> Column:
    return F.least(x, bound)


def at_least(x: Column, bound: Column) -> Column:
    return F.greatest(x, bound)


def in_excess(x: Column, of: Column) -> Column:
    return F.greatest(x - of, F.lit(0).cast("decimal(18,2)"))


def in_default(x: Column, of: Column) -> Column:
    return F.greatest(of - x, F.lit(0).cast("decimal(18,2)"))


def positive(x: Column) -> Column:
    return F.greatest(x, F.lit(0).cast("decimal(18,2)"))


def up(x: Column) -> Column:
    """To the next greater unit."""
    return F.ceil(x)


def down(x: Column) -> Column:
    """To the next lesser unit."""
    return F.floor(x)


def to_decimal(x: Column, n: int) -> Column:
    """To n decimals; of a negative n, to tens, hundreds and so on. Halves go away from zero."""
    return F.round(x, n)


def add_period(date: Column, months: Column, days: Column, rounding: str = "abort") -> Column:
    """Months first, with one rounding if the day doesn't exist there, then days. ``up``: the first of the next month;
    ``down``: the last of the month; ``abort``: null, for the caller to report."""
    moved = F.add_months(date, months)
    short = F.day(moved) < F.day(date)
    if rounding == "up":
        moved = F.when(short, F.date_add(moved, 1)).otherwise(moved)
    elif rounding == "abort":
        moved = F.when(~short, moved)
    return F.date_add(moved, days)


def old_enough(birth: Column, years: int, at: Column, rounding: str = "down") -> Column:
    return at >= add_period(birth, F.lit(12 * years), F.lit(0), rounding)


def day_of_week(date: Column) -> Column:
    """1 (Monday) to 7."""
    return F.weekday(date) + 1


def duration_sum(a: Column, b: Column) -> Column:
    return F.struct((a["months"] + b["months"]).alias("months"), (a["days"] + b["days"]).alias("days"))


def duration_ratio(a: Column, b: Column) -> Column:
    """Of durations in days only; null for others and for 0 days, which the caller reports."""
    return F.when((a["months"] == 0) & (b["months"] == 0), F.try_divide(a["days"].cast("decimal(18,0)"), b["days"].cast("decimal(18,0)")))


def period(begin: Column, end: Column) -> Column:
    return F.struct(begin.alias("begin"), end.alias("end"))


def period_days(p: Column) -> Column:
    return F.date_diff(p["end"], p["begin"]) + 1


def overlaps(p: Column, q: Column) -> Column:
    return (p["begin"] <= q["end"]) & (q["begin"] <= p["end"])


def adjacent(p: Column, q: Column) -> Column:
    """q begins on the day after p ends."""
    return F.date_add(p["end"], 1) == q["begin"]


def intersection(p: Column, q: Column) -> Column:
    """Null if they share no day."""
    return F.when(overlaps(p, q), period(F.greatest(p["begin"], q["begin"]), F.least(p["end"], q["end"])))


def months_of(p: Column) -> Column:
    """The places, from 0, of the months that a period splits into: none of a single day, and an end on the first of a
    month stays in the month before."""
    last = F.date_sub(p["end"], 1)
    n = (F.year(last) - F.year(p["begin"])) * 12 + F.month(last) - F.month(p["begin"])
    return F.when(p["begin"] < p["end"], F.sequence(F.lit(0), n)).otherwise(F.array().cast("array<int>"))


def month_part(p: Column, n: Column) -> Column:
    """The part of a period in its month of that place; days only, so that parts of exploded places compile."""
    start = F.trunc(p["begin"], "MM")
    after = F.add_months(start, n + 1)
    return period(F.greatest(F.add_months(start, n), p["begin"]), F.when(after >= p["end"], p["end"]).otherwise(F.date_sub(after, 1)))


def split_by_month(p: Column) -> Column:
    """An array of periods. One of a single day gives none, and an end on the first of a month stays in the month
    before. Where parts become rows, explode ``months_of`` and take each ``month_part`` instead."""
    return F.transform(months_of(p), lambda n: month_part(p, n))
