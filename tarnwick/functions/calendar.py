"""Dates, months of a year and periods of the rule language as Spark columns. A month of a year is its first day; a period
is a struct of two dates that both belong to it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tarnwick.functions import lists, scalars
from tarnwick.functions.scalars import period

#: The months by number.
MONTHS = ("January", "February", "March", "April", "May", "June", "July", "August", "September", "October", "November", "December")


def month_name(number: Column) -> Column:
    """Null for what is no month."""
    return F.when(number.between(1, 12), F.element_at(F.array(*map(F.lit, MONTHS)), F.greatest(F.least(number, F.lit(12)), F.lit(1)).cast("int")))


def month_number(name: Column) -> Column:
    n = F.array_position(F.array(*map(F.lit, MONTHS)), name)
    return F.when(n > 0, n.cast("int"))


def date_of(year: Column, month: Column, day: Column) -> Column:
    """Null where there is no such day."""
    return F.try_make_timestamp(year, month, day, F.lit(0), F.lit(0), F.lit(0)).cast("date")


def parts(date: Column) -> Column:
    return F.struct(F.year(date).alias("year"), F.month(date).alias("month"), F.day(date).alias("day"))


def first_of_month(date: Column) -> Column:
    return F.trunc(date, "MM")


def first_of_year(date: Column) -> Column:
    return F.trunc(date, "YEAR")


def last_of_year(date: Column) -> Column:
    return F.make_date(F.year(date), F.lit(12), F.lit(31))


def less_period(date: Column, months: Column, days: Column, rounding: str = "abort") -> Column:
    return scalars.add_period(date, -months, -days, rounding)


def old_enough(birth: Column, months: Column, at: Column, rounding: str) -> Column:
    return at >= scalars.add_period(birth, months, F.lit(0), rounding)


def young_enough(birth: Column, months: Column, at: Column, rounding: str) -> Column:
    return ~old_enough(birth, months, at, rounding)


def month_year(date: Column) -> Column:
    return F.struct(F.year(date).alias("year_number"), month_name(F.month(date)).alias("month_name"))


def first_day(month: Column) -> Column:
    return F.make_date(month["year_number"], month_number(month["month_name"]), F.lit(1))


def last_day(month: Column) -> Column:
    return F.last_day(first_day(month))


def before_month(month: Column, date: Column) -> Column:
    return date < first_day(month)


def after_month(month: Column, date: Column) -> Column:
    return date > last_day(month)


def before_or_during(month: Column, date: Column) -> Column:
    return date <= last_day(month)


def during_or_after(month: Column, date: Column) -> Column:
    return date >= first_day(month)


def in_month(month: Column, date: Column) -> Column:
    return before_or_during(month, date) & during_or_after(month, date)


def period_of_month(month: Column, year: Column) -> Column:
    first = F.make_date(year, month, F.lit(1))
    return period(first, F.last_day(first))


def period_of_year(year: Column) -> Column:
    return period(F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31)))


def valid(p: Column) -> Column:
    return p["begin"] <= p["end"]


def follows(p: Column, q: Column) -> Column:
    """q begins on the day after p ends."""
    return p["end"] == F.date_sub(q["begin"], 1)


def joined(p: Column, q: Column) -> Column:
    return period(F.least(p["begin"], q["begin"]), F.greatest(p["end"], q["end"]))


def common(p: Column, q: Column) -> Column:
    """The days of both, null if there are none; periods that end before they begin have none."""
    both = period(F.greatest(p["begin"], q["begin"]), F.least(p["end"], q["end"]))
    return F.when(valid(both), both)


def covers(long: Column, short: Column) -> Column:
    return (long["begin"] <= short["begin"]) & (short["end"] <= long["end"])


def contains(p: Column, date: Column) -> Column:
    return (p["begin"] <= date) & (date <= p["end"])


def before(p: Column, date: Column) -> Column:
    return date < p["begin"]


def after(p: Column, date: Column) -> Column:
    return date > p["end"]


def find_period(ps: Column, date: Column) -> Column:
    """The first of a list that holds the date."""
    return lists.find(ps, lambda p: contains(p, date))


def sort_by_date(ps: Column) -> Column:
    """By first day; periods that begin together keep their order."""
    return lists.sort_by(ps, lambda p: p["begin"])


def split_by_year(p: Column, starting_month: int) -> Column:
    """An array of periods, cut at the first of a month of each year. One of a single day gives none, and an end on such a
    first day stays in the year before."""
    rolling = lambda d: F.make_date(F.year(d) - F.when(F.month(d) < starting_month, 1).otherwise(0), F.lit(starting_month), F.lit(1))
    starts = F.sequence(rolling(p["begin"]), F.greatest(rolling(F.date_sub(p["end"], 1)), rolling(p["begin"])), F.expr("interval 1 year"))
    clipped = F.transform(starts, lambda y: period(F.greatest(y.cast("date"), p["begin"]), F.when(F.add_months(y, 12) >= p["end"], p["end"]).otherwise(F.date_sub(F.add_months(y, 12), 1))))
    return F.when(p["begin"] < p["end"], clipped).otherwise(F.filter(F.array(p), lambda _: F.lit(False)))
