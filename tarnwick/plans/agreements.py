"""Scopes of the older rule library on confidentiality, credits, fees, bonuses and sick leave, with their queries.

Fixed values: dates, rates, caps and their order. Dates without a rounding fail where the day doesn't exist.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.operators import surface
from tarnwick.plans.obligations import MONEY
from tarnwick.plans.registry import query
from tarnwick.plans.rules import Definition as D
from tarnwick.plans.rules import Scope, apply
from tarnwick.sources import service_facts, table


def plus_months(date: str, months: str | int) -> str:
    return f"add_months({date}, {months})"


def no_such_day(date: str, months: str | int) -> str:
    return f"day(add_months({date}, {months})) < day({date})"


#: Clause 11.2 of the master agreement, and a later non-disclosure agreement. Inputs: disclosed, agreement, trade_secret.
CONFIDENTIALITY = Scope(
    "confidentiality",
    {"obligation_end": "date", "indefinite": "boolean"},
    (D("obligation_end", plus_months("disclosed", 36), label="msa_11_2"), D("obligation_end", plus_months("disclosed", 60), "agreement = 'nda'", "nda", "msa_11_2"), D("indefinite", "trade_secret")),
    failures=(("DateError", f"agreement <> 'nda' and {no_such_day('disclosed', 36)}"), ("DateError", f"agreement = 'nda' and {no_such_day('disclosed', 60)}")),
)

#: Two tables of tiers that nothing ranks, a deliberate conflict; equal consequences don't conflict. Inputs: uptime, fee.
GLOBEX_CREDIT = Scope(
    "globex_credit",
    {"credit_percentage": "decimal(9,4)", "credit": MONEY},
    (
        D("credit_percentage", "0.00", "uptime >= 99.9"),
        D("credit_percentage", "0.10", "uptime < 99.9 and uptime >= 99.0"),
        D("credit_percentage", "0.25", "uptime < 99.0 and uptime >= 95.0"),
        D("credit_percentage", "1.00", "uptime < 95.0"),
        D("credit_percentage", "0.20", "uptime < 99.9 and uptime >= 99.0"),
        D("credit_percentage", "0.40", "uptime < 99.0 and uptime >= 95.0"),
        D("credit_percentage", "1.00", "uptime < 95.0"),
        D("credit", "round(fee * credit_percentage, 2)"),
    ),
)

#: Standard tiers, and those of an order form from a date on. Inputs: month, uptime, fee, requested.
NORTHWIND_CREDIT = Scope(
    "northwind_credit",
    {"order_form": "boolean", "deadline": "date", "eligible": "boolean", "credit_percentage": "decimal(9,4)", "credit": MONEY},
    (
        D("order_form", "true", "month >= date '1998-07-01'", "from_date"),
        D("deadline", f"date_add({plus_months('month', 1)}, 30)"),
        D("eligible", "requested <= deadline"),
        D("credit_percentage", "0.00", label="commitment_met"),
        D("credit_percentage", "0.10", "not order_form and uptime < 99.9 and uptime >= 99.0", "std_1", "commitment_met"),
        D("credit_percentage", "0.25", "not order_form and uptime < 99.0 and uptime >= 95.0", "std_2", "commitment_met"),
        D("credit_percentage", "1.00", "not order_form and uptime < 95.0", "std_3", "commitment_met"),
        D("credit_percentage", "0.15", "order_form and uptime < 99.9 and uptime >= 99.0", "ent_1", "commitment_met"),
        D("credit_percentage", "0.30", "order_form and uptime < 99.0 and uptime >= 95.0", "ent_2", "commitment_met"),
        D("credit_percentage", "1.00", "order_form and uptime < 95.0", "ent_3", "commitment_met"),
        D("credit", "case when not eligible then 0.00 when credit_percentage > 1 then fee else round(fee * credit_percentage, 2) end"),
    ),
    conditions=frozenset({"order_form"}),
    failures=(("DateError", no_such_day("month", 1)),),
)

#: Inputs: hours, month (its first day), invoiced.
CONSULTING = Scope(
    "consulting",
    {"fees": MONEY, "change_order": "boolean", "notice": "boolean", "invoice_payable": "boolean", "payable": MONEY},
    (
        D("fees", "round(225.00 * hours, 2)"),
        D("change_order", "fees > 112500.00"),
        D("notice", "fees >= 112500.00 * 0.80"),
        D("invoice_payable", f"invoiced <= date_add({plus_months('month', 1)}, 89)"),
        D("payable", "case when not invoice_payable then 0.00 when fees > 112500.00 then 112500.00 else fees end"),
    ),
    failures=(("DateError", no_such_day("month", 1)),),
)


def bonus(name: str, rate: str) -> Scope:
    return Scope(name, {"rate": "decimal(9,4)", "target": MONEY}, (D("rate", rate), D("target", "round(salary * rate, 2)")))


#: A plan, and a side letter that says otherwise. Inputs: salary.
PLAN_BONUS, LETTER_BONUS = bonus("plan_bonus", "0.15"), bonus("letter_bonus", "1.35")

#: Inputs: hours, weeks, state, days, exempt.
SICK_LEAVE = Scope(
    "sick_leave",
    {"divisor": "decimal(9,1)", "accrual_cap": "decimal(9,1)", "usable": "boolean", "use_cap": "decimal(9,1)", "effective": "decimal(18,2)", "accrued": "decimal(18,6)"},
    (
        D("divisor", "40.0", label="handbook_rate"),
        D("divisor", "30.0", "state = 'CA'", "ca_rate", "handbook_rate"),
        D("divisor", "30.0", "state = 'CO'", "ca_rate", "handbook_rate"),
        D("accrual_cap", "null", label="handbook_cap"),
        D("accrual_cap", "80.0", "state = 'CA'", "state_cap", "handbook_cap"),
        D("accrual_cap", "48.0", "state = 'CO'", "state_cap", "handbook_cap"),
        D("usable", "days >= 90", label="handbook_waiting"),
        D("usable", "true", "state = 'CO'", "co_waiting", "handbook_waiting"),
        D("use_cap", "40.0", label="handbook_use_cap"),
        D("use_cap", "48.0", "state = 'CO'", "co_use_cap", "handbook_use_cap"),
        D("effective", "hours", label="actual_hours"),
        D("effective", "40.0 * weeks", "exempt and state = 'CA'", "exempt_ca", "actual_hours"),
        D("accrued", "case when accrual_cap is not null and effective / divisor > accrual_cap then accrual_cap else effective / divisor end"),
    ),
)
SCOPES = {s.name: s for s in (CONFIDENTIALITY, GLOBEX_CREDIT, NORTHWIND_CREDIT, CONSULTING, PLAN_BONUS, LETTER_BONUS, SICK_LEAVE)}


@query("""with f as (select o_orderkey, o_orderdate::date d, o_orderkey % 3 = 0 nda, o_custkey % 4 = 0 secret from orders), e as (select *, (d + to_months(case when nda then 60 else 36 end))::date ended from f)
select o_orderkey, case when day(ended) = day(d) then ended::varchar end obligation_end, secret as indefinite, case when day(ended) < day(d) then 'DateError' end err from e""")
def confidentiality(spark, sf_dir):
    k = F.col("o_orderkey")
    facts = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("disclosed"), F.when(k % 3 == 0, "nda").otherwise("msa").alias("agreement"), (F.col("o_custkey") % 4 == 0).alias("trade_secret"))
    out = apply(CONFIDENTIALITY, facts)
    return out.select("o_orderkey", F.when(F.col("err").isNull(), F.col("obligation_end")).cast("string").alias("obligation_end"), "indefinite", "err")


_UPTIME = "f as (select o_orderkey, cast((10000 - bp) / 100.0 as decimal(9,2)) uptime, cast(round(o_totalprice * 100) as hugeint) cents, date_trunc('month', o_orderdate)::date m, o_orderdate::date + (o_orderkey % 90)::int requested from orders join (select l_orderkey, sum(cast(round(l_discount * 100) as bigint)) * 100 // count(*) bp from lineitem group by 1) on l_orderkey = o_orderkey)"


@query(f"""with {_UPTIME} select o_orderkey, case when uptime >= 99.9 then 0 when uptime < 95 then cents end::double / 100 credit, case when uptime < 99.9 and uptime >= 95 then 'Conflict' end err from f""")
def unranked_credits(spark, sf_dir):
    """Two tables of credits that nothing ranks: a conflict, but where they say the same."""
    facts = service_facts(spark, sf_dir).select("o_orderkey", F.col("availability").alias("uptime"), F.col("charge").alias("fee"))
    return apply(GLOBEX_CREDIT, facts).select("o_orderkey", F.when(F.col("err").isNull(), F.col("credit")).cast("double").alias("credit"), "err")


@query(f"""with {_UPTIME}, p as (select *, m >= date '1998-07-01' form, requested <= (m + interval 1 month)::date + 30 eligible from f),
q as (select *, case when uptime >= 99.9 then 0 when uptime < 95 then 100 when uptime >= 99 then case when form then 15 else 10 end else case when form then 30 else 25 end end pct from p)
select o_orderkey, eligible, pct::double / 100 credit_percentage, case when eligible then (cents * pct + 50) // 100 else 0 end::double / 100 credit from q""")
def order_form_credits(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.trunc("o_orderdate", "MM").alias("month"), F.date_add(F.col("o_orderdate").cast("date"), (F.col("o_orderkey") % 90).cast("int")).alias("requested"))
    facts = service_facts(spark, sf_dir).select("o_orderkey", F.col("availability").alias("uptime"), F.col("charge").alias("fee")).join(orders, "o_orderkey")
    return apply(NORTHWIND_CREDIT, facts).select("o_orderkey", "eligible", F.col("credit_percentage").cast("double").alias("credit_percentage"), F.col("credit").cast("double").alias("credit"))


@query("""with f as (select o_custkey, date_trunc('month', o_orderdate)::date m, sum(round(o_totalprice / 100))::bigint as hours, max(o_orderdate::date) + (any_value(o_custkey) % 120)::int invoiced from orders group by o_custkey, date_trunc('month', o_orderdate))
select o_custkey, m::varchar as "month", hours * 225.0::double fees, hours * 225 > 112500 change_order, hours * 225 >= 90000 notice, invoiced <= (m + interval 1 month)::date + 89 invoice_payable,
  case when invoiced > (m + interval 1 month)::date + 89 then 0 else least(hours * 225, 112500) end::double payable from f""")
def consulting_fees(spark, sf_dir):
    month = F.trunc("o_orderdate", "MM").alias("month")
    facts = table(spark, sf_dir, "orders").groupBy("o_custkey", month).agg(F.sum(F.round(F.col("o_totalprice") / 100)).cast("decimal(12,2)").alias("hours"), F.max(F.col("o_orderdate").cast("date")).alias("last"))
    facts = facts.select("o_custkey", "month", "hours", F.date_add("last", (F.col("o_custkey") % 120).cast("int")).alias("invoiced"))
    out = apply(CONSULTING, facts)
    return out.select("o_custkey", F.col("month").cast("string").alias("month"), F.col("fees").cast("double").alias("fees"), "change_order", "notice", "invoice_payable", F.col("payable").cast("double").alias("payable"))


@query("""with f as (select c_custkey, cast(round(abs(c_acctbal) * 1000) as hugeint) cents from customer), b as (select *, (cents * 15 + 50) // 100 mine, (cents * 135 + 50) // 100 theirs from f)
select c_custkey, mine::double / 100 plan_target, theirs::double / 100 letter_target from b where mine <> theirs""")
def rival_bonuses(spark, sf_dir):
    """Where a plan and a side letter promise different bonuses."""
    facts = table(spark, sf_dir, "customer").select("c_custkey", F.abs(F.round(F.col("c_acctbal") * 10, 2)).cast("decimal(14,2)").alias("salary"))
    out = surface.contradictions(PLAN_BONUS, LETTER_BONUS, facts, {"salary": F.col("salary")}, {"target": "target"})
    return out.select("c_custkey", F.col("left_value").cast("double").alias("plan_target"), F.col("right_value").cast("double").alias("letter_target"))


@query("""with f as (select o_custkey, sum(round(o_totalprice / 100))::bigint as hours, count(*) as weeks, ['CA', 'CO', 'WA'][o_custkey % 3 + 1] state, (o_custkey % 200)::int as days, o_custkey % 5 = 0 exempt from orders group by o_custkey),
e as (select *, case when exempt and state = 'CA' then 40 * weeks else hours end eff, case when state = 'WA' then 40 else 30 end d, case state when 'CA' then 80 when 'CO' then 48 end cap from f)
select o_custkey, round(case when cap is not null and eff > cap * d then cap else eff::double / d end, 6)::double accrued, state = 'CO' or days >= 90 usable, case when state = 'CO' then 48 else 40 end::double use_cap from e""")
def sick_leave(spark, sf_dir):
    k = F.col("o_custkey")
    facts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sum(F.round(F.col("o_totalprice") / 100)).cast("decimal(12,2)").alias("hours"), F.count("*").cast("int").alias("weeks"))
    facts = facts.select("o_custkey", "hours", "weeks", F.get(F.array(*map(F.lit, ("CA", "CO", "WA"))), (k % 3).cast("int")).alias("state"), (k % 200).cast("int").alias("days"), (k % 5 == 0).alias("exempt"))
    return apply(SICK_LEAVE, facts).select("o_custkey", F.col("accrued").cast("double").alias("accrued"), "usable", F.col("use_cap").cast("double").alias("use_cap"))
