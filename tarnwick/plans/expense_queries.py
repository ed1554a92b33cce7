"""Queries of the scopes on expenses, claims, charges, accrual, working time and quota relief."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.operators import absences, surface
from tarnwick.plans import expenses, library, obligations
from tarnwick.plans.registry import query
from tarnwick.plans.rules import apply
from tarnwick.sources import table

MONEY = "decimal(18,2)"


def _lines(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").withColumn("d", F.col("l_shipdate").cast("date"))


def _orders(spark, sf_dir):
    return table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("date"))


def _given(facts, keys, **expressions):
    return facts.select(*keys, *(F.expr(e).alias(n) for n, e in expressions.items()))


def _doubles(*names):
    return [F.col(n).cast("double").alias(n) for n in names]


LINE, ORDER = ("l_orderkey", "l_linenumber"), ("o_orderkey",)


@query("""with f as (select o_orderkey, case o_orderkey % 3 + 1 when 1 then 220 when 2 then 160 else 120 end base, floor(o_totalprice / 1000) + o_orderkey % 20 + o_orderkey % 10 against, o_orderkey % 15 parking, o_orderkey % 4 = 0 evidenced from orders)
select o_orderkey, least(against, case when evidenced then base * 7 / 5.0 else base end)::double reimbursable, parking::double parking_reimbursable from f""")
def night_stay(spark, sf_dir):
    facts = _given(_orders(spark, sf_dir), ORDER, tier="o_orderkey % 3 + 1", room=f"cast(floor(o_totalprice / 1000) as {MONEY})", taxes=f"cast(o_orderkey % 20 as {MONEY})", charges=f"cast(o_orderkey % 10 as {MONEY})", parking=f"cast(o_orderkey % 15 as {MONEY})", evidenced="o_orderkey % 4 = 0")
    return apply(expenses.NIGHT, facts).select(*ORDER, *_doubles("reimbursable", "parking_reimbursable"))


@query("""with f as (select l_orderkey, l_linenumber, l_returnflag = 'R' first_class, floor(l_extendedprice / 100) ticket, l_partkey % 400 fare,
  l_linenumber % 2 = 1 and l_linenumber % 3 <> 0 and l_suppkey % 2 = 1 and l_partkey % 1000 >= floor(l_extendedprice / 100) approved from lineitem)
select l_orderkey, l_linenumber, (case when not first_class or ticket <= fare or approved then ticket else 0 end)::double reimbursable from f""")
def rail_fare(spark, sf_dir):
    facts = _given(_lines(spark, sf_dir), LINE, first_class="l_returnflag = 'R'", ticket=f"cast(floor(l_extendedprice / 100) as {MONEY})", standard_fare=f"cast(l_partkey % 400 as {MONEY})", obtained="l_linenumber % 2 = 1", in_writing="l_linenumber % 3 <> 0", obtained_at="date_sub(d, cast(l_suppkey % 2 as int))", authority=f"cast(l_partkey % 1000 as {MONEY})", incurred_on="d")
    return apply(expenses.RAIL, facts).select(*LINE, *_doubles("reimbursable"))


@query("""with f as (select l_orderkey, l_linenumber, case l_partkey % 3 + 1 when 1 then 75 when 2 then 55 else 40 end + case when l_linestatus = 'O' then 20 else 0 end ordinary, l_returnflag = 'R' billable,
  case when l_suppkey % 2 = 0 then 60 + l_partkey % 40 end agreed, case when l_linenumber % 2 = 0 then l_partkey % 150 end specified, l_suppkey % 5 <> 0 and l_partkey % 3 > 0 formal, l_suppkey % 200 authority, l_partkey % 5 - 1 free, (l_quantity::int - 1) * 3 spent from lineitem),
g as (select *, case when billable then coalesce(agreed, ordinary * 1.5::double) else ordinary end apart from f),
h as (select *, greatest(0, case when formal and authority >= specified and specified > apart then specified else apart end - 15 * free) adjusted from g)
select l_orderkey, l_linenumber, least(spent, adjusted)::double reimbursable, case when free < 0 then 'AssertionFailed' end err from h""")
def meal_allowance(spark, sf_dir):
    facts = _given(_lines(spark, sf_dir), LINE, tier="l_partkey % 3 + 1", billable="l_returnflag = 'R'", agreed=f"cast(case when l_suppkey % 2 = 0 then 60 + l_partkey % 40 end as {MONEY})", specified=f"cast(case when l_linenumber % 2 = 0 then l_partkey % 150 end as {MONEY})", obtained="true", in_writing="l_suppkey % 5 <> 0", obtained_at="date_sub(d, cast(l_partkey % 3 as int))", authority=f"cast(l_suppkey % 200 as {MONEY})", incurred_on="d", free_meals="cast(l_partkey % 5 - 1 as int)", spent=f"cast((cast(l_quantity as int) - 1) * 3 as {MONEY})", incident="l_linestatus = 'O'")
    return apply(expenses.MEALS, facts).select(*LINE, *_doubles("reimbursable"), "err")


@query("""with f as (select o_orderkey, (o_orderkey % 7 - 1)::int n from orders)
select o_orderkey, case when n > 0 then n + 1 else 0 end::int as "days", case when n < 0 then 'AssertionFailed' end err from f""")
def travel_day_count(spark, sf_dir):
    facts = _given(_orders(spark, sf_dir), ORDER, departed="d", returned="date_add(d, cast(o_orderkey % 7 - 1 as int))")
    return apply(expenses.TRAVEL_DAYS, facts).select(*ORDER, "days", "err")


@query("""with f as (select o_orderkey k, last_day(o_orderdate::date)::date e, (case when k % 5 <> 0 then k % 40 end)::int late, k % 3 <> 0 more from orders),
g as (select *, not coalesce(late <= 30, false) waived from f)
select k o_orderkey, waived, more and not waived set_off, not more and not waived paid, (case when waived then null when more then e + 45 else e + late + 35 end)::date::varchar settled from g""")
def credit_claim(spark, sf_dir):
    facts = _given(_orders(spark, sf_dir), ORDER, period_end="last_day(d)", made="o_orderkey % 5 <> 0", claimed="case when o_orderkey % 5 <> 0 then date_add(last_day(d), cast(o_orderkey % 40 as int)) end", more_invoices="o_orderkey % 3 <> 0", next_invoice="date_add(last_day(d), 45)")
    out = apply(expenses.CREDIT_CLAIM, facts.withColumn("accepted", F.date_add("claimed", 5)))
    return out.select(*ORDER, "waived", "set_off", "paid", F.col("settled").cast("string").alias("settled"))


@query("""with f as (select o_orderkey k, floor(o_totalprice)::bigint c, k % 900 a, k % 700 b, k % 500 p from orders)
select k o_orderkey, (c - a - b - p)::double charge, case when a + b + p > c then 'AssertionFailed' end err from f""")
def monthly_charge(spark, sf_dir):
    facts = _given(_orders(spark, sf_dir), ORDER, charges=f"cast(floor(o_totalprice) as {MONEY})", one_off=f"cast(o_orderkey % 900 as {MONEY})", professional=f"cast(o_orderkey % 700 as {MONEY})", pass_through=f"cast(o_orderkey % 500 as {MONEY})")
    return apply(expenses.MONTHLY_CHARGE, facts).select(*ORDER, *_doubles("charge"), "err")


@query("""with f as (select o_orderkey k, o_orderdate::date s, case when k % 3 <> 0 then s + (k % 100)::int end e, s + (k % 60)::int t from orders),
g as (select *, date_trunc('month', t)::date m, last_day(t)::date z from f),
h as (select *, greatest(datediff('day', greatest(s, m), least(z, coalesce(e, z))) + 1, 0) n, day(z) l, s <= m and coalesce(e >= z, true) whole from g)
select k o_orderkey, n::int served, (case when whole then 2 else (8 * n + l) // (2 * l) / 2.0::double end)::double accrued from h""")
def monthly_accrual(spark, sf_dir):
    facts = _given(_orders(spark, sf_dir), ORDER, day="date_add(d, cast(o_orderkey % 60 as int))", started="d", ended="case when o_orderkey % 3 <> 0 then date_add(d, cast(o_orderkey % 100 as int)) end")
    return apply(expenses.MONTHLY_ACCRUAL, facts).select(*ORDER, "served", *_doubles("accrued"))


@query("""with g as (select distinct o_custkey % 25 place, o_orderdate::date d from orders where o_orderpriority = '1-URGENT'),
f as (select l_orderkey, l_linenumber, l_shipdate::date d, l_suppkey % 25 place, (20000 + l_partkey % 1000)::bigint salary, l_partkey % 24 h, l_linenumber % 2 + 1 severity, l_returnflag = 'R' resp, d - (l_partkey % 3)::int + 1 declared, case when l_suppkey % 2 = 0 then d - 1 + (l_suppkey % 3)::int end closed from lineitem)
select l_orderkey, l_linenumber, (salary * 200 + 2080) // 4160 / 100.0::double rate_to_the_penny, (d - (isodow(d) - 1)::int)::date::varchar week_begins, h >= 22 or h < 6 night,
  resp and severity = 1 and d >= declared and coalesce(d <= closed, true) incident, exists(select 1 from g where g.place = f.place and g.d = f.d) holiday from f""")
def working_hours(spark, sf_dir):
    """Hours (line items) with what working time says of them; the gazette of holidays is met on place and date."""
    gazette = _orders(spark, sf_dir).where("o_orderpriority = '1-URGENT'").select((F.col("o_custkey") % 25).alias("place"), F.col("d").alias("day"), F.lit(True).alias("gazetted")).distinct()
    facts = _given(_lines(spark, sf_dir), LINE, place="l_suppkey % 25", day="d", salary=f"cast(20000 + l_partkey % 1000 as {MONEY})", hour="cast(l_partkey % 24 as int)", severity="l_linenumber % 2 + 1", in_response="l_returnflag = 'R'", declared="date_add(date_sub(d, cast(l_partkey % 3 as int)), 1)", closed="case when l_suppkey % 2 = 0 then date_add(date_sub(d, 1), cast(l_suppkey % 3 as int)) end")
    out = apply(expenses.WORKING_HOUR, facts).join(gazette, ["place", "day"], "left")
    return out.select(*LINE, *_doubles("rate_to_the_penny"), F.col("week_begins").cast("string").alias("week_begins"), "night", "incident", F.coalesce("gazetted", F.lit(False)).alias("holiday"))


YEAR = ("1996-10-01", "1997-09-30")


@query(f"""with a as (select o_custkey k, o_orderdate::date s, o_orderdate::date + (o_orderkey % 45)::int e from orders where o_orderkey % 4 <> 3),
b as (select distinct k, unnest(generate_series(s::timestamp, e::timestamp, interval 1 day))::date d from a),
c as (select k, d, d - (row_number() over (partition by k order by d))::int g from b),
r as (select k, count(*)::int n from (select *, count(*) over (partition by k, g) len from c) where len >= 30 and d between date '{YEAR[0]}' and date '{YEAR[1]}' group by k),
t as (select o_custkey k, sum(cast(round(o_totalprice * 100) as hugeint)) net, ((1 + o_custkey % 5) * 25000000)::hugeint annual from orders group by o_custkey),
q as (select t.*, coalesce(n, 0) n, annual * (365 - coalesce(n, 0)) q365 from t left join r on t.k = r.k),
z as (select *, case when q365 = 0 or net * 730 < q365 then 0 when net * 365 < q365 then 100 when net * 730 < q365 * 3 then 150 else 200 end acc, case when q365 > 0 and net * 365 > q365 * 2 then 20000000 else 12500000 end::hugeint cap from q)
select k o_custkey, n relief_days, ((annual * n * 2 + 365) // 730)::double / 100 relief, ((q365 * 2 + 365) // 730)::double / 100 relieved_quota, least((net * 8 * acc + 5000) // 10000, cap)::double / 100 payable, case when q365 = 0 then 'AssertionFailed' end err from z""")
def commission_after_relief(spark, sf_dir):
    """Quotas less the days of continuous absence, then commission on what is left of them."""
    orders = _orders(spark, sf_dir)
    away = orders.where("o_orderkey % 4 <> 3").select("o_custkey", F.col("d").alias("begin"), F.expr("date_add(d, cast(o_orderkey % 45 as int))").alias("end"))
    days = absences.relief_days(away, "o_custkey", *YEAR)
    facts = orders.groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast(MONEY)).cast(MONEY).alias("net")).join(days, "o_custkey", "left").fillna(0, ["relief_days"])
    facts = facts.withColumn("annual", ((1 + F.col("o_custkey") % 5) * 250000).cast(MONEY))
    relieved = apply(expenses.QUOTA_RELIEF, facts).drop("err")
    start = F.lit(YEAR[0]).cast("date")
    out = apply(obligations.COMMISSION, relieved.withColumns({"new_share": F.lit(0).cast("decimal(9,4)"), "commenced": start, "year_start": start, "salary": F.lit(50000).cast(MONEY)}))
    return out.select("o_custkey", "relief_days", *_doubles("relief", "relieved_quota", "payable"), "err")


_REVENUE = f"""c as (select o_custkey k, o_clerk, o_orderkey, s, v, churned, s between date '{YEAR[0]}' and date '{YEAR[1]}' as in_year,
    not exists(select 1 from orders p where p.o_custkey = b.o_custkey and p.o_orderdate::date < s and p.o_orderdate::date >= (s - interval 24 month)::date) fresh
  from (select o_custkey, o_custkey % 40 o_clerk, o_orderkey, o_orderdate::date s, cast(round(o_totalprice * 100) as hugeint) v, o_orderkey % 5 = 0 and o_orderkey % 400 <= 180 churned from orders) b),
r as (select o_clerk seller, sum(v) gross, coalesce(sum(v) filter (churned), 0) lost, coalesce(sum(v) filter (not churned and fresh), 0) fresh from c where in_year group by 1)"""


def _revenue(spark, sf_dir):
    """Contracts (orders) of the plan year by seller; a logo is new if its customer has signed nothing in 24 months."""
    signed = F.datediff("d", F.lit("1970-01-01"))
    earlier = F.max("d").over(Window.partitionBy("o_custkey").orderBy(signed).rangeBetween(Window.unboundedPreceding, -1))
    contracts = _orders(spark, sf_dir).select("o_custkey", "o_orderkey", "d", F.col("o_totalprice").cast(MONEY).alias("v"), earlier.alias("earlier")).where(F.col("d").between(*(F.lit(y).cast("date") for y in YEAR)))
    ended = F.expr("case when o_orderkey % 5 = 0 then date_add(d, cast(o_orderkey % 400 as int)) end")
    churned = F.coalesce((ended >= F.col("d")) & (F.datediff(ended, "d") <= 180), F.lit(False))
    fresh = F.coalesce(F.col("earlier") < F.add_months("d", -24), F.lit(True))
    value = lambda c: F.sum(F.when(c, F.col("v")).otherwise(F.lit(0).cast(MONEY))).cast(MONEY)
    return contracts.withColumns({"churned": churned, "fresh": fresh}).groupBy((F.col("o_custkey") % 40).alias("seller")).agg(value(F.lit(True)).alias("gross"), value(F.col("churned")).alias("lost"), value(~F.col("churned") & F.col("fresh")).alias("new_revenue")).withColumn("net", (F.col("gross") - F.col("lost")).cast(MONEY))


@query(f"""with {_REVENUE} select seller, gross::double / 100 gross, lost::double / 100 churned, (gross - lost)::double / 100 net, fresh::double / 100 new_revenue, round(case when gross = lost then 0 else fresh::double / (gross - lost)::double end, 6) new_share from r""")
def booked_revenue(spark, sf_dir):
    share = F.when(F.col("net") == 0, F.lit(0.0)).otherwise(F.col("new_revenue").cast("double") / F.col("net").cast("double"))
    return _revenue(spark, sf_dir).select("seller", *_doubles("gross"), F.col("lost").cast("double").alias("churned"), *_doubles("net", "new_revenue"), F.round(share, 6).alias("new_share"))


@query(f"""with {_REVENUE},
e as (select seller, gross - lost net, fresh * 5 > (gross - lost) * 3 many, ((1 + seller % 4) * 30000000)::hugeint q from r),
b as (select *, case when net * 2 < q then 0 when net < q then 100 when net * 2 < q * 3 then 150 else 200 end band from e),
p as (select *, least((net * 8 * (case when many then band + 25 else band end) + 5000) // 10000, (case when net > q * 2 then 16000000 else 10000000 end)::hugeint) due, ((seller % 6) * 500000)::hugeint had from b)
select seller, case when seller % 7 = 0 then 0 else greatest(due - had, 0) end::double / 100 payable, greatest(had - due, 0)::double / 100 overpaid from p""")
def leaver_commission(spark, sf_dir):
    """Commission of those who leave: what is due less what was paid, nothing after gross misconduct."""
    start = F.lit(YEAR[0]).cast("date")
    share = F.when(F.col("net") == 0, F.lit(0)).otherwise(F.col("new_revenue") / F.col("net")).cast("decimal(28,12)")
    facts = _revenue(spark, sf_dir).select("seller", "net", share.alias("new_share"), ((1 + F.col("seller") % 4) * 300000).cast(MONEY).alias("quota"), start.alias("commenced"), start.alias("year_start"), F.lit(40000).cast(MONEY).alias("salary"))
    due = apply(obligations.COMMISSION, facts).select("seller", F.col("payable").alias("due"), (F.col("seller") % 6 * 5000).cast(MONEY).alias("already_paid"), (F.col("seller") % 7 == 0).alias("misconduct"))
    return apply(expenses.LEAVER, due).select("seller", *_doubles("payable", "overpaid"))


@query("""with f as (select o_orderkey, cast(floor(o_totalprice / 1000) as int) v from orders)
select o_orderkey, 'reimbursable/reimbursable' as field, v::double left_value, least(v, 60)::double right_value from f where v > 60 and o_orderkey % 3 <> 0""")
def contradictions(spark, sf_dir):
    """Journeys that the rail rule and the taxi rule answer differently."""
    facts = _given(_orders(spark, sf_dir), ORDER, first_class="o_orderkey % 3 = 0", ticket=f"cast(floor(o_totalprice / 1000) as {MONEY})", standard_fare=f"cast(0 as {MONEY})", obtained="false", in_writing="false", obtained_at="d", incurred_on="d", authority=f"cast(0 as {MONEY})")
    ordinary = facts.where("not first_class")
    out = surface.contradictions(expenses.RAIL, obligations.TAXI, ordinary, {"cost": F.col("ticket"), "minute": F.lit(720), "airport": F.lit(False)}, {"reimbursable": "reimbursable"})
    return out.select(*ORDER, "field", *_doubles("left_value", "right_value"))
