"""Continuous absences: periods that meet or overlap are one, whoever recorded them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def continuous(periods: DataFrame, who: str) -> DataFrame:
    """who, begin and end of the maximal runs of days that periods (who, begin, end; both inclusive) cover together.

    Periods that lack a date or end before they begin cover no day. Only the longest period from each day goes to the
    window, so that a person's rows there are bounded by days, not by records.
    """
    longest = periods.where("begin <= end").groupBy(who, "begin").agg(F.max("end").alias("end"))
    w = Window.partitionBy(who).orderBy("begin")
    reached = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("begin") > F.date_add(reached, 1), F.lit(True))
    runs = longest.withColumn("_new", begins.cast("long")).withColumn("_run", F.sum("_new").over(w))
    return runs.groupBy(who, "_run").agg(F.min("begin").alias("begin"), F.max("end").alias("end")).drop("_run")


def relief_days(periods: DataFrame, who: str, first: str, last: str, least: int = 30) -> DataFrame:
    """who and relief_days: the days from first to last that lie in a continuous absence of ``least`` days or more."""
    runs = continuous(periods, who).where(F.datediff("end", "begin") + 1 >= least)
    begin, end = F.greatest("begin", F.lit(first).cast("date")), F.least("end", F.lit(last).cast("date"))
    return runs.groupBy(who).agg(F.sum(F.greatest(F.datediff(end, begin) + 1, F.lit(0))).cast("int").alias("relief_days"))
