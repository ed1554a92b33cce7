"""Scopes of the rule library on caps of liability, approvals, last pay and plain overtime, with their queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.plans.obligations import MONEY
from tarnwick.plans.registry import query
from tarnwick.plans.rules import Definition as D
from tarnwick.plans.rules import Scope, apply
from tarnwick.sources import table

#: Inputs: paid_before (fees of twelve months), annual, kind, claimed.
LIABILITY_CAP = Scope(
    "liability_cap",
    {"excluded": "boolean", "without_cap": "boolean", "order_form": "boolean", "cap": MONEY, "uncapped": "boolean"},
    (
        D("excluded", "true", "kind in ('confidentiality', 'indemnity')"),
        D("without_cap", "true", "kind in ('gross_negligence', 'unpaid_fees', 'injury')"),
        D("order_form", "true", "claimed >= date '2026-07-01'"),
        D("cap", "paid_before", label="master"),
        D("cap", "paid_before * 2.0", "excluded and not order_form", "master_excluded", "master"),
        D("cap", "annual * 3.0", "order_form and not excluded and not without_cap", "form", "master"),
        D("cap", "annual * 5.0", "order_form and excluded", "form_excluded", "master"),
        D("cap", "paid_before", "without_cap", "carved_out", "master"),
        D("uncapped", "false", label="capped"),
        D("uncapped", "true", "without_cap", "no_cap", "capped"),
    ),
    conditions=frozenset({"excluded", "without_cap", "order_form"}),
)

#: A deliberate conflict: an amendment that doesn't say how it ranks with the form. Inputs: annual, kind, claimed.
AMENDED_CAP = Scope(
    "amended_cap",
    {"cap": MONEY},
    (D("cap", "annual * 3.0", "claimed >= date '2026-07-01' and kind = 'ordinary'", "form"), D("cap", "500000.00", "claimed >= date '2026-09-01'", "amendment")),
)

#: Inputs: amount, department (optional). Levels go from 1 (manager) to 4 (chief financial officer); the stricter counts.
APPROVAL = Scope(
    "approval",
    {"corporate": "int", "departmental": "int", "level": "int", "receipt": "boolean"},
    (
        D("corporate", "1", label="base"),
        D("corporate", "2", "amount > 1000 and amount <= 5000", "director", "base"),
        D("corporate", "3", "amount > 5000 and amount <= 25000", "vice_president", "base"),
        D("corporate", "4", "amount > 25000", "finance", "base"),
        D("departmental", "cast(null as int)", label="none"),
        D("departmental", "1", "department = 'engineering' and amount <= 2500", "engineering_manager", "none"),
        D("departmental", "2", "department = 'engineering' and amount > 2500", "engineering_director", "none"),
        D("level", "greatest(corporate, departmental)"),
        D("receipt", "amount > 75"),
    ),
)

#: Inputs: last_day, separation, state, payroll.
LAST_PAY = Scope(
    "last_pay",
    {"due": "date", "leave_paid_out": "boolean"},
    (
        D("due", "payroll", label="handbook"),
        D("due", "last_day", "state = 'CA' and separation in ('terminated', 'notice')", "california", "handbook"),
        D("due", "date_add(last_day, 3)", "state = 'CA' and separation = 'no_notice'", "california", "handbook"),
        D("due", "last_day", "state = 'CO' and separation = 'terminated'", "colorado", "handbook"),
        D("leave_paid_out", "false", label="not_paid_out"),
        D("leave_paid_out", "true", "state in ('CA', 'CO')", "state_law", "not_paid_out"),
    ),
)

#: Inputs: worked (hours of a week), rate. Money is rounded after each product.
PLAIN_OVERTIME = Scope(
    "plain_overtime",
    {"over": "decimal(9,2)", "overtime": MONEY, "pay": MONEY},
    (D("over", "greatest(worked - 40, 0)"), D("overtime", "round(round(rate * over, 2) * 1.5, 2)"), D("pay", "round(rate * least(worked, 40), 2) + overtime")),
)

SCOPES = {s.name: s for s in (LIABILITY_CAP, AMENDED_CAP, APPROVAL, LAST_PAY, PLAIN_OVERTIME)}

KINDS = ("ordinary", "confidentiality", "indemnity", "gross_negligence", "unpaid_fees", "injury")
_CLAIMS = f"f as (select o_orderkey k, cast(round(o_totalprice * 100) as hugeint) paid, (o_custkey * 100000)::hugeint annual, {list(KINDS)}[o_orderkey % 6 + 1] kind, date '2026-06-01' + (o_custkey % 150)::int d from orders)"


def _one_of(names, n):
    return F.get(F.array(*map(F.lit, names)), (n % len(names)).cast("int"))


def _claims(spark, sf_dir):
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k, F.col("o_totalprice").cast(MONEY).alias("paid_before"), (F.col("o_custkey") * 1000).cast(MONEY).alias("annual"), _one_of(KINDS, k).alias("kind"), F.date_add(F.lit("2026-06-01").cast("date"), (F.col("o_custkey") % 150).cast("int")).alias("claimed"))


@query(f"""with {_CLAIMS}, g as (select *, kind in ('confidentiality', 'indemnity') x, kind in ('gross_negligence', 'unpaid_fees', 'injury') u, d >= date '2026-07-01' o from f)
select k o_orderkey, (case when u then paid when o and x then annual * 5 when o then annual * 3 when x then paid * 2 else paid end)::double / 100 cap, u uncapped from g""")
def liability_cap(spark, sf_dir):
    return apply(LIABILITY_CAP, _claims(spark, sf_dir)).select("o_orderkey", F.col("cap").cast("double").alias("cap"), "uncapped")


@query(f"""with {_CLAIMS}, g as (select *, d >= date '2026-07-01' and kind = 'ordinary' a, d >= date '2026-09-01' b from f)
select k o_orderkey, (case when a and b then null when a then annual * 3 when b then 50000000 end)::double / 100 cap, case when a and b then 'Conflict' when not a and not b then 'NoApplicableRule' end err from g""")
def amended_cap(spark, sf_dir):
    return apply(AMENDED_CAP, _claims(spark, sf_dir)).select("o_orderkey", F.col("cap").cast("double").alias("cap"), "err")


@query("""with f as (select l_orderkey, l_linenumber, cast(l_extendedprice as decimal(18,2)) a, l_suppkey % 3 = 0 eng from lineitem)
select l_orderkey, l_linenumber, greatest(case when a > 25000 then 4 when a > 5000 then 3 when a > 1000 then 2 else 1 end, case when eng then case when a > 2500 then 2 else 1 end else 0 end)::int as "level", a > 75 receipt from f""")
def approval_level(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast(MONEY).alias("amount"), F.when(F.col("l_suppkey") % 3 == 0, "engineering").alias("department"))
    return apply(APPROVAL, facts).select("l_orderkey", "l_linenumber", "level", "receipt")


@query("""with f as (select o_orderkey k, o_orderdate::date d, ['CA', 'CO', 'TX', 'NY'][o_orderkey % 4 + 1] st, ['terminated', 'notice', 'no_notice'][o_custkey % 3 + 1] sep from orders)
select k o_orderkey, (case when st = 'CA' and sep = 'no_notice' then d + 3 when st = 'CA' or (st = 'CO' and sep = 'terminated') then d else d + 14 end)::date::varchar due, st in ('CA', 'CO') leave_paid_out from f""")
def last_pay(spark, sf_dir):
    d = F.col("o_orderdate").cast("date")
    facts = table(spark, sf_dir, "orders").select("o_orderkey", d.alias("last_day"), _one_of(("CA", "CO", "TX", "NY"), F.col("o_orderkey")).alias("state"), _one_of(("terminated", "notice", "no_notice"), F.col("o_custkey")).alias("separation"), F.date_add(d, 14).alias("payroll"))
    return apply(LAST_PAY, facts).select("o_orderkey", F.col("due").cast("string").alias("due"), "leave_paid_out")


@query("""with f as (select l_orderkey, l_linenumber, l_quantity::int + 20 h, (2000 + l_partkey % 1777)::bigint r from lineitem), g as (select *, r * greatest(h - 40, 0) * 3 tw from f)
select l_orderkey, l_linenumber, ((tw + 1) // 2)::double / 100 overtime, (r * least(h, 40) + (tw + 1) // 2)::double / 100 pay from g""")
def plain_overtime(spark, sf_dir):
    facts = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_quantity").cast("int") + 20).cast("decimal(9,2)").alias("worked"), ((2000 + F.col("l_partkey") % 1777) / 100).cast(MONEY).alias("rate"))
    return apply(PLAIN_OVERTIME, facts).select("l_orderkey", "l_linenumber", F.col("overtime").cast("double").alias("overtime"), F.col("pay").cast("double").alias("pay"))
