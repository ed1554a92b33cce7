"""Queries of scopes that call scopes, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.plans import compose, library, service
from tarnwick.plans.registry import query
from tarnwick.sources import outage_facts, table, timesheet_facts

_HOURS = """
h as (select l_suppkey, l_partkey, year(l_shipdate)::int as week, l_orderkey, l_linenumber, case when l_orderkey % 4999 = 0 then 169 else (l_orderkey * 5 + l_linenumber) % 168 + 1 end hour_of_week,
    l_suppkey % 8 + 1 grade, l_partkey % 11 = 0 as holiday, l_returnflag = 'R' as critical, l_linestatus = 'O' as night, l_suppkey % 5 = 0 as allowance, l_suppkey % 3 = 0 as shift, l_suppkey % 7 * 10000 + 20001 salary from lineitem),
o as (select *, row_number() over (partition by l_suppkey, week order by hour_of_week, l_orderkey, l_linenumber, l_partkey) n from h)"""
#: What an hour is paid for, and by which rules.
_PREMIUM = """
b as (select *, case when holiday and n > 48 then 'late_holiday' when holiday then 'holiday' when grade >= 5 and n > 40 and critical then 'critical' when grade >= 5 and n > 40 then 'senior'
    when n > 48 then 'over_48' when n > 40 then 'over_40' else 'ordinary' end by_rule, case when allowance then 'allowance' else 'night' end by_night,
    case when grade >= 5 and n > 40 and critical then 'toil_critical' when grade >= 5 and n > 40 then 'toil_senior' else '(base)' end by_toil from o),
p as (select *, greatest(0, case by_rule when 'late_holiday' then 200 when 'holiday' then 200 when 'critical' then case when n > 48 then 150 else 125 end
    when 'over_48' then 150 when 'over_40' then 125 else 0 end - case when n > 40 then 0 else 100 end) + case when night and not allowance then 15 else 0 end pct from b)"""


@query(f"""with {_HOURS}, {_PREMIUM},
w as (select l_suppkey, week, count(*) as hours, sum(pct) pct, sum(case when by_toil = 'toil_senior' then 1 else 0 end) banked, max(hour_of_week) as latest, max(salary) salary,
    list_distinct(list('tally.multiplier=' || by_rule) || list('tally.night_premium=' || by_night) || list('tally.toil=' || by_toil)) said from p group by all),
r as (select *, latest > 168 or hours > 168 refused, floor(salary * 100 / 2080 + 0.5)::bigint base from w)
select l_suppkey, week, case when not refused then hours end hours_worked, case when not refused then (pct * base + 50) // 100 end::double / 100 overtime_payment, case when not refused then banked end::double toil_hours,
  case when refused then 'AssertionFailed' end err, case when refused then 'AssertionFailed' else array_to_string(list_sort(said || ['tally.payable=payable', 'tally.salaried=salaried', 'tally.total_rate=total_rate',
    'hours_worked=hours_worked', 'overtime_payment=overtime_payment', 'toil_hours=toil_hours']), ';') end signature from r""")
def weekly_overtime(spark, sf_dir):
    """Each hour's premium by its place in the week, added up exactly; a week's case is told by all that its hours were paid by."""
    hours, key = timesheet_facts(spark, sf_dir), ["l_suppkey", "week"]
    rates = {"counted": F.count("*"), "rate": F.sum("total_rate"), "banked": F.sum(F.col("toil").cast("int"))}
    tally = compose.call_each("tally", library.HOUR_PREMIUM, hours, key, ["hour_of_week", "l_orderkey", "l_linenumber", "l_partkey"], rates, "ordinal", 168)
    weeks = hours.groupBy(*key).agg(F.bool_and(F.col("hour_of_week").between(1, 168)).alias("in_week"), F.round(F.max("salary") / 2080, 2).alias("base"))
    out = compose.run(service.WEEKLY_OVERTIME, weeks.join(tally, key), "tally").withColumn("signature", compose.signature())
    done = lambda c: F.when(F.col("err").isNull(), F.col(c))
    return out.select(*key, done("hours_worked").alias("hours_worked"), done("overtime_payment").cast("double").alias("overtime_payment"), done("toil_hours").cast("double").alias("toil_hours"), "err", "signature")


@query(f"""with {_HOURS}, {_PREMIUM}, r as (select *, floor(salary * 100 / 2080 + 0.5)::bigint base, shift and night by_contract from p where hour_of_week <= 168)
select l_orderkey, l_linenumber, case when by_contract then 0 when n > 168 then null else (pct * base + 50) // 100 end::double / 100 pay, case when n > 168 and not by_contract then 'AssertionFailed' end err,
  case when by_contract then 'base_rate=base_rate;pay=by_contract' when n > 168 then 'AssertionFailed' else array_to_string(list_sort(['base_rate=base_rate', 'pay=by_annex', 'premium.multiplier=' || by_rule,
    'premium.night_premium=' || by_night, 'premium.payable=premium.payable', 'premium.salaried=premium.salaried', 'premium.toil=' || by_toil, 'premium.total_rate=premium.total_rate']), ';') end signature from r""")
def hour_pay(spark, sf_dir):
    """A scope that calls another where a condition holds: equal branches of the caller, different ones of the callee."""
    place = F.row_number().over(Window.partitionBy("l_suppkey", "week").orderBy("hour_of_week", "l_orderkey", "l_linenumber", "l_partkey"))
    out = compose.run(service.HOUR_PAY, timesheet_facts(spark, sf_dir).withColumn("ordinal", place).where("hour_of_week <= 168")).withColumn("signature", compose.signature())
    return out.select("l_orderkey", "l_linenumber", F.when(F.col("err").isNull(), F.col("pay")).cast("double").alias("pay"), "err", "signature")


@query("""with cal as (select distinct o_orderdate::date d from orders where isodow(o_orderdate) < 6),
cum as (select d, row_number() over (order by d) c from cal),
f as (select l_suppkey, date_trunc('month', l_shipdate)::date m, (l_quantity * 4)::bigint as minutes, l_shipdate::date s, l_shipdate::date - (l_partkey % 12)::int notified, l_returnflag = 'N' maint, l_returnflag = 'A' emerg,
    l_partkey % 90 >= 60 timely, l_partkey % 31 = 0 or l_partkey % 17 = 0 or l_partkey % 41 = 0 other from lineitem),
days as (select distinct s, notified from f),
between_days as (select s, notified, count(d) n from days left join cal on d > notified and d < s group by all),
g as (select f.*, maint and n >= 5 sched from f join between_days using (s, notified)),
a as (select l_suppkey, m, sum(minutes) down, sum(case when sched then minutes else 0 end) agg, sum(case when sched or emerg and timely or other then minutes else 0 end) limbs, day(last_day(m)) * 1440 total from g group by all),
b as (select *, greatest(agg - 480, 0) excess from a), c as (select *, limbs - excess excluded, down - limbs + excess unavailable from b)
select l_suppkey, m::varchar period_start, total::int total_minutes, excess::bigint excess_minutes, excluded::bigint excluded_minutes, unavailable::bigint unavailable_minutes,
  ((total - unavailable) * 20000 + total) // (2 * total) / 100.0::double availability, ((total - unavailable) * 20000 + total) // (2 * total) >= 9990 meets_level,
  array_to_string(list_sort(['maintenance.excess=' || case when agg > 480 then 'l4_5_excess' else 'l4_5_no_excess' end, 'percent.unavailable=' || case when agg > 480 then 'l4_5' else 'l2_4' end]), ';') branches from c""")
def service_availability(spark, sf_dir):
    """Outages, each with the scopes it calls and what these call, then the month; the branches that tell months apart."""
    outages, key = outage_facts(spark, sf_dir), ["l_suppkey", "period_start"]
    sums = {"not_available": F.sum("minutes"), "aggregate": F.sum("maintained"), "by_limbs": F.sum("excluded_of_it")}
    months = compose.call_each("outages", service.OUTAGE, outages, key, ["l_orderkey", "l_linenumber"], sums)
    out = compose.run(service.SERVICE_AVAILABILITY, months, "outages")
    labelled = F.filter("governing", lambda g: g["branch"].rlike("^l[24]_"))
    branches = F.array_join(F.array_sort(F.transform(labelled, lambda g: F.concat_ws("=", g["variable"], g["branch"]))), ";")
    return out.select("l_suppkey", F.col("period_start").cast("string").alias("period_start"), "total_minutes", "excess_minutes", "excluded_minutes", "unavailable_minutes", F.col("availability").cast("double").alias("availability"), "meets_level", branches.alias("branches"))


@query("""select user_id, count(*) requests, count(*) filter (where event_type <> 'error' and value is not null and event_id % 7 <> 0 and event_id % 5 <> 0) available from events group by 1""")
def requests_available(spark, sf_dir):
    facts = table(spark, sf_dir, "events").select("user_id", ((F.col("event_type") != "error") & F.col("value").isNotNull()).alias("well_formed"), (F.col("event_id") % 7 != 0).alias("responded"), (F.col("event_id") % 5 != 0).alias("in_time"))
    return compose.run(service.REQUEST_AVAILABLE, facts).groupBy("user_id").agg(F.count("*").alias("requests"), F.count(F.when(F.col("available"), 1)).alias("available"))
