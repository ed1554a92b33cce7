"""Queries of the scopes on pay, deadlines, retention and availability, of verdicts and of page blocks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.operators import documents, exposure
from tarnwick.plans import library, obligations
from tarnwick.plans.registry import query
from tarnwick.plans.rules import apply
from tarnwick.sources import table


@query("""with f as (select o_custkey k, sum(cast(round(o_totalprice * 100) as hugeint)) n, (o_custkey % 5) * 20000000::hugeint q, o_custkey % 10 * 10 share,
  o_custkey % 4 = 0 joiner, (20000 + o_custkey % 7 * 10000) * 100::hugeint salary from orders group by o_custkey),
b as (select *, case when q <= 0 or n * 2 < q then 0 when n < q then 100 when n * 2 < q * 3 then 150 else 200 end band from f),
a as (select *, case when share > 60 then band + 25 else band end before from b),
c as (select *, case when joiner then least(before, 150) when share > 60 then before else band end acc, salary * case when q > 0 and n > q * 2 then 4 else 2.5 end cap from a)
select k o_custkey, acc / 100.0::double accelerator, case when q > 0 then (n * 2000000 + q) // (2 * q) else 0 end::double / 1000000 attainment,
  least((n * 8 * acc + 5000) // 10000, cap::hugeint)::double / 100 payable, case when q = 0 then 'AssertionFailed' end err from c""")
def commission(spark, sf_dir):
    k, start = F.col("o_custkey"), F.lit("2020-01-01").cast("date")
    facts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("net"))
    facts = facts.select(
        "o_custkey", "net",
        (k % 5 * 200000).cast("decimal(18,2)").alias("quota"),
        (k % 10 / 10).cast("decimal(9,4)").alias("new_share"),
        F.when(k % 4 == 0, F.date_add(start, 40)).otherwise(start).alias("commenced"),
        start.alias("year_start"),
        (20000 + k % 7 * 10000).cast("decimal(12,2)").alias("salary"),
    )
    out = apply(obligations.COMMISSION, facts)
    return out.select("o_custkey", F.col("accelerator").cast("double").alias("accelerator"), F.round("attainment", 6).cast("double").alias("attainment"), F.col("payable").cast("double").alias("payable"), "err")


@query("""with f as (select l_orderkey, l_linenumber, l_extendedprice, l_shipdate::date paid_on, l_shipdate::date + (l_partkey % 1500)::int assessed, l_returnflag = 'R' churned, l_partkey % 3 = 0 breach from lineitem)
select l_orderkey, l_linenumber, (paid_on + interval 24 month)::date::varchar long_stop, assessed > (paid_on + interval 24 month)::date time_barred,
  case when not churned or breach or assessed > (paid_on + interval 24 month)::date then 0 else round(l_extendedprice, 2) end::double recoverable from f""")
def recovery(spark, sf_dir):
    ship = F.col("l_shipdate").cast("date")
    facts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(18,2)").alias("paid"), ship.alias("paid_on"), F.date_add(ship, (F.col("l_partkey") % 1500).cast("int")).alias("assessed"), (F.col("l_returnflag") == "R").alias("churned"), (F.col("l_partkey") % 3 == 0).alias("breach"))
    return apply(obligations.RECOVERY, facts).select("l_orderkey", "l_linenumber", F.col("long_stop").cast("string").alias("long_stop"), "time_barred", F.col("recoverable").cast("double").alias("recoverable"))


def _order_dates(spark, sf_dir):
    k = F.col("o_orderkey")
    day = lambda n: F.date_add("d", (k % n).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d")), k, day


@query("""with f as (select o_orderkey k, o_orderdate::date d, case when k % 3 <> 0 then d end issued, case when k % 2 = 0 then d + (k % 200)::int end released,
  d + (k % 150)::int assessed, d + (k % 300)::int retained, k % 5 <> 0 permitted from orders),
g as (select *, coalesce(assessed >= issued and (released is null or assessed < released), false) in_force from f),
h as (select *, case when in_force then null when issued is not null and released is not null and retained < released then released + 30 else retained end due from g)
select k o_orderkey, in_force, due::varchar due, in_force and permitted erasure_blocked, (due + 90)::varchar purge, case when released is not null and issued is null then 'AssertionFailed' end err from h""")
def legal_hold(spark, sf_dir):
    orders, k, day = _order_dates(spark, sf_dir)
    facts = orders.select("o_orderkey", F.when(k % 3 != 0, F.col("d")).alias("issued"), F.when(k % 2 == 0, day(200)).alias("released"), day(150).alias("assessed"), day(300).alias("retained_until"), (k % 5 != 0).alias("permitted"))
    return apply(obligations.LEGAL_HOLD, facts).select("o_orderkey", "in_force", F.col("due").cast("string").alias("due"), "erasure_blocked", F.col("purge").cast("string").alias("purge"), "err")


@query("""with f as (select o_orderkey k, o_orderdate::date requested, case when k % 4 <> 0 then requested + (k % 40)::int end verified, k % 3 <> 0 valid, k % 5 = 0 or k % 7 = 0 or k % 11 = 0 barred from orders)
select k o_orderkey, (case when valid and not barred then verified + 30 end)::varchar due, valid and barred refused from f""")
def erasure(spark, sf_dir):
    orders, k, day = _order_dates(spark, sf_dir)
    facts = orders.select("o_orderkey", F.col("d").alias("requested"), F.when(k % 4 != 0, day(40)).alias("verified"), (k % 3 != 0).alias("valid"), (k % 5 == 0).alias("by_law"), (k % 7 == 0).alias("by_claims"), (k % 11 == 0).alias("held"))
    return apply(obligations.ERASURE, facts).select("o_orderkey", F.col("due").cast("string").alias("due"), "refused")


_UP = "case when day(({0} + interval {1} month)::date) < day({0}) then ({0} + interval {1} month)::date + 1 else ({0} + interval {1} month)::date end"


@query(f"""with f as (select o_orderkey k, o_orderdate::date d, case when k % 4 <> 0 then d + (k % 900)::int end notice, k % 3 = 0 secret, k % 5 = 0 personal, k % 2 = 0 still,
  case when k % 7 <> 0 then d + (k % 2500)::int end ceased, d - 30 + (k % 3000)::int assessed from orders),
g as (select *, {_UP.format('d', 24)} term from f),
h as (select *, case when notice + 30 < term then notice + 30 else term end ends from g),
i as (select *, {_UP.format('ends', 36)} three, case when ceased is not null then greatest(ends, ceased) end held from h)
select k o_orderkey, ends::varchar ends, (case when secret and personal then case when not still then held end when secret then null when personal then held else three end)::varchar survives_until,
  case when assessed < d then false when assessed <= ends then true when secret and personal then still or ceased is null or assessed <= held when secret then still
    when personal then ceased is null or assessed <= held else assessed <= three end subsist from i""")
def survival(spark, sf_dir):
    orders, k, day = _order_dates(spark, sf_dir)
    facts = orders.select("o_orderkey", F.col("d").alias("effective"), F.when(k % 4 != 0, day(900)).alias("notice"), (k % 3 == 0).alias("secret"), (k % 5 == 0).alias("personal"), (k % 2 == 0).alias("still_secret"), F.when(k % 7 != 0, day(2500)).alias("ceased"), F.date_sub(day(3000), 30).alias("assessed"))
    return apply(obligations.SURVIVAL, facts).select("o_orderkey", F.col("ends").cast("string").alias("ends"), F.col("survives_until").cast("string").alias("survives_until"), "subsist")


_KINDS = ("employee", "contract", "financial", "marketing", "security", "candidate")


@query(f"""with f as (select o_orderkey k, o_orderdate::date d, case when k % 5 < 3 then d + (k % 400)::int end engaged, case when k % 7 < 4 then d + (k % 90)::int end consented,
  case when k % 2 = 0 then d + (k % 700)::int end renewed, k % 4 < 2 statutory, (case when k % 97 < 3 then -3 else 60 + k % 25 end)::int n_months, {list(_KINDS)}[k % 6 + 1] kind from orders),
g as (select *, (d + to_months(n_months))::date s, case when day((d + to_months(n_months))::date) < day(d) then (d + to_months(n_months))::date + 1 else (d + to_months(n_months))::date end s_up, (d + interval 72 month)::date six from f)
select k o_orderkey, kind, case when statutory and n_months < 0 then 'AssertionFailed' end err, case when not (statutory and n_months < 0) then (case kind when 'employee' then case when statutory and s > six then greatest(six, s_up) else six end when 'marketing' then (greatest(d, engaged) + interval 24 month)::date
  when 'security' then (d + interval 13 month)::date when 'candidate' then case when consented is not null then (greatest(consented, renewed) + interval 24 month)::date else (d + interval 12 month)::date end
  else (d + interval 84 month)::date end)::varchar end until from g""")
def retention(spark, sf_dir):
    orders, k, day = _order_dates(spark, sf_dir)
    kind = F.get(F.array(*map(F.lit, _KINDS)), (k % 6).cast("int"))
    renewals = F.filter(F.array(F.when(k % 2 == 0, day(700))), lambda x: x.isNotNull())
    facts = orders.select("o_orderkey", kind.alias("kind"), F.col("d").alias("started"), F.when(k % 5 < 3, day(400)).alias("engaged"), F.when(k % 7 < 4, day(90)).alias("consented"), renewals.alias("renewals"), (k % 4 < 2).alias("statutory"), F.when(k % 97 < 3, -3).otherwise(60 + k % 25).cast("int").alias("statutory_months"))
    return apply(obligations.RETENTION, facts).select("o_orderkey", "kind", "err", F.when(F.col("err").isNull(), F.col("until")).cast("string").alias("until"))


@query("""with f as (select c_custkey k, c_custkey % 97 e, c_custkey % 3 = 0 prevented from customer)
select k c_custkey, (case when e % 4 >= 2 then e // 4 + 1 else e // 4 end)::double / 2 rounded, case when prevented then e / 8.0::double else least(e / 8.0::double, 5) end carried,
  case when prevented then 0 else greatest(e / 8.0::double - 5, 0) end::double forfeited from f""")
def leave(spark, sf_dir):
    k = F.col("c_custkey")
    facts = table(spark, sf_dir, "customer").select("c_custkey", (k % 97 / 8).cast("decimal(9,4)").alias("accrued"), (k % 3 == 0).alias("prevented"))
    return apply(obligations.LEAVE, facts).select("c_custkey", *(F.col(c).cast("double").alias(c) for c in ("rounded", "carried", "forfeited")))


@query("""with f as (select l_orderkey, l_linenumber, floor(round(l_extendedprice, 2) / 500) cost, (l_partkey % 1440)::int m, l_suppkey % 2 = 0 airport from lineitem)
select l_orderkey, l_linenumber, (case when airport and (m < 360 or m > 1320) then cost else least(cost, 60) end)::double reimbursable from f""")
def taxi(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.floor(F.round("l_extendedprice", 2) / 500).cast("decimal(18,2)").alias("cost"), (F.col("l_partkey") % 1440).cast("int").alias("minute"), (F.col("l_suppkey") % 2 == 0).alias("airport"))
    return apply(obligations.TAXI, facts).select("l_orderkey", "l_linenumber", F.col("reimbursable").cast("double").alias("reimbursable"))


@query("""with o as (select l_orderkey k, sum(l_quantity::int)::bigint down_m, sum(case when l_returnflag = 'A' and l_tax < 0.04 then l_quantity::int else 0 end)::bigint sched, sum(case when l_returnflag = 'R' then l_quantity::int else 0 end)::bigint other from lineitem group by 1),
f as (select k, day(last_day(o_orderdate::date)) * 1440 total, down_m, least(sched, 40) + other excluded, greatest(sched - 40, 0) excess from o join orders on k = o_orderkey),
g as (select *, down_m - excluded - excess + case when excess > 0 then excess else 0 end unavailable from f)
select k l_orderkey, unavailable::bigint unavailable, ((total - unavailable)::hugeint * 20000 + total) // (2 * total)::hugeint / 100.0::double availability,
  ((total - unavailable)::hugeint * 20000 + total) // (2 * total)::hugeint >= 9990 meets from g""")
def availability(spark, sf_dir):
    """Outages (line items) of a period (an order's month), less those excluded; scheduled work counts beyond 40 minutes."""
    q = F.col("l_quantity").cast("int")
    some = lambda c: F.sum(F.when(c, q).otherwise(0))
    out = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum(q).alias("down_minutes"), some((F.col("l_returnflag") == "A") & (F.col("l_tax") < 0.04)).alias("sched"), some(F.col("l_returnflag") == "R").alias("other"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.trunc(F.col("o_orderdate").cast("date"), "MM").alias("period_start"))
    facts = out.join(orders, out.l_orderkey == orders.o_orderkey).select("l_orderkey", "period_start", "down_minutes", (F.least("sched", F.lit(40)) + F.col("other")).alias("excluded_minutes"), F.greatest(F.col("sched") - 40, F.lit(0)).alias("excess_minutes"))
    return apply(obligations.AVAILABILITY, facts).select("l_orderkey", "unavailable", F.col("availability").cast("double").alias("availability"), "meets")


_VERDICTS = """v as (select *, case when p < 500 then 'unrealisable' when p >= 100000 then 'CONFLICT' when p < 1000 then 'SILENCE' when o_orderpriority = '1-URGENT' and o_orderstatus = 'F' then 'ADVERSE' when o_orderpriority = '2-HIGH' then 'ADVERSE' else 'died' end klass,
  case when p < 1000 or p >= 100000 then null when o_orderpriority = '1-URGENT' and o_orderstatus = 'F' then 'urgent_and_closed' when o_orderpriority = '2-HIGH' then 'high' end predicate
  from (select *, cast(o_totalprice as decimal(18,2)) p from orders))"""


@query(f"with {_VERDICTS} select o_orderkey, klass, predicate from v")
def adjudication(spark, sf_dir):
    return exposure.adjudicate(library.RIVAL_CAPS, _priced(spark, sf_dir), "price >= 500", _PREDICATES).select("o_orderkey", "klass", "predicate")


@query(f"with {_VERDICTS} select klass, predicate, count(*) times, min(o_orderkey) first_seen from v where klass not in ('died', 'unrealisable') group by all")
def exposure_queue(spark, sf_dir):
    out = exposure.adjudicate(library.RIVAL_CAPS, _priced(spark, sf_dir), "price >= 500", _PREDICATES)
    return exposure.queue(out, "o_orderkey").select("klass", "predicate", "times", "first_seen")


_PREDICATES = (("urgent_and_closed", "cap >= 2000 and o_orderpriority = '1-URGENT' and o_orderstatus = 'F'"), ("high", "o_orderpriority = '2-HIGH'"))


def _priced(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))


@query()
def page_blocks(spark, sf_dir):
    return documents.html_blocks(table(spark, sf_dir, "pages"))
