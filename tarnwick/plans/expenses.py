"""Scopes of the rule library on expenses, claims, charges, accrual and working time.

Pre-approval is an inlined condition: obtained, in writing, before the day of the expense, by someone whose authority
reaches its amount. Optional inputs are nullable.
"""

from __future__ import annotations

from tarnwick.plans.obligations import FACTOR, MONEY
from tarnwick.plans.rules import Definition as D
from tarnwick.plans.rules import Scope


def approved(amount: str) -> str:
    return f"(obtained and in_writing and obtained_at < incurred_on and authority >= {amount})"


#: Inputs: tier (1 to 3), room, taxes, charges, parking, evidenced.
NIGHT = Scope(
    "night",
    {"base": MONEY, "cap": MONEY, "against_cap": MONEY, "reimbursable": MONEY, "parking_reimbursable": MONEY},
    (
        D("base", "220.00", "tier = 1", "tiers"),
        D("base", "160.00", "tier = 2", "tiers"),
        D("base", "120.00", "tier = 3", "tiers"),
        D("cap", "base", label="cap"),
        D("cap", "base * 1.4", "evidenced", "none_available", "cap"),
        D("against_cap", "room + taxes + charges"),
        D("reimbursable", "least(against_cap, cap)"),
        D("parking_reimbursable", "parking"),
    ),
    ("room >= 0", "taxes >= 0", "charges >= 0", "parking >= 0"),
)

#: Inputs: first_class, ticket, standard_fare and those of a pre-approval.
RAIL = Scope(
    "rail",
    {"reimbursable": MONEY},
    (
        D("reimbursable", "ticket", "not first_class", "standard"),
        D("reimbursable", "0.00", "first_class", "first"),
        D("reimbursable", "ticket", f"first_class and (ticket <= standard_fare or {approved('ticket')})", "permitted", "first"),
    ),
    ("ticket >= 0", "standard_fare >= 0", "authority >= 0"),
)

#: Inputs: tier, billable, agreed (optional), specified (optional) and those of a pre-approval, free_meals, spent, incident.
MEALS = Scope(
    "meals",
    {"tier_amount": MONEY, "ordinary": MONEY, "apart": MONEY, "cap": MONEY, "adjusted": MONEY, "reimbursable": MONEY},
    (
        D("tier_amount", "75.00", "tier = 1", "tiers"),
        D("tier_amount", "55.00", "tier = 2", "tiers"),
        D("tier_amount", "40.00", "tier = 3", "tiers"),
        D("ordinary", "tier_amount", label="by_tier"),
        D("ordinary", "tier_amount + 20.00", "incident", "incident", "by_tier"),
        D("apart", "case when billable then coalesce(agreed, ordinary * 1.5) else ordinary end"),
        D("cap", "ordinary", label="cap"),
        D("cap", "coalesce(agreed, ordinary * 1.5)", "billable", "billable", "cap"),
        D("cap", "specified", f"{approved('specified')} and specified > apart", "higher", "billable"),
        D("adjusted", "greatest(0.00, cap - 15.00 * free_meals)"),
        D("reimbursable", "least(spent, adjusted)", label="up_to"),
        D("reimbursable", "0.00", "spent = 0", "nothing_spent", "up_to"),
    ),
    ("free_meals >= 0", "spent >= 0"),
)

#: Inputs: departed, returned.
TRAVEL_DAYS = Scope(
    "travel_days",
    {"days": "int"},
    (D("days", "0", "returned <= departed", "days"), D("days", "datediff(returned, departed) + 1", "returned > departed", "days")),
    ("returned >= departed",),
)

#: Inputs: period_end, made, claimed (optional), accepted (optional), more_invoices, next_invoice (optional).
CREDIT_CLAIM = Scope(
    "credit_claim",
    {"deadline": "date", "waived": "boolean", "set_off": "boolean", "paid": "boolean", "settled": "date"},
    (
        D("deadline", "date_add(period_end, 30)"),
        D("waived", "not coalesce(made and claimed <= deadline, false)"),
        D("set_off", "true", label="set_off"),
        D("set_off", "false", "not more_invoices", "payment", "set_off"),
        D("set_off", "false", "waived", "waived", "payment"),
        D("paid", "not waived and not set_off"),
        D("settled", "next_invoice", label="set_off_date"),
        D("settled", "date_add(accepted, 30)", "not more_invoices", "payment_date", "set_off_date"),
        D("settled", "cast(null as date)", "waived", "waived_date", "payment_date"),
    ),
)

#: Inputs: charges, one_off, professional, pass_through.
MONTHLY_CHARGE = Scope(
    "monthly_charge",
    {"charge": MONEY},
    (D("charge", "charges - one_off - professional - pass_through"),),
    ("charges >= 0", "one_off >= 0", "professional >= 0", "pass_through >= 0", "one_off + professional + pass_through <= charges"),
)

#: Inputs: day, started, ended (optional). Two days a month, in half days by products; exact quarters go up.
MONTHLY_ACCRUAL = Scope(
    "monthly_accrual",
    {"first_day": "date", "end_day": "date", "completed": "boolean", "served": "int", "below": "bigint", "over": "bigint", "prorated": FACTOR, "accrued": FACTOR},
    (
        D("first_day", "cast(trunc(day, 'MM') as date)"),
        D("end_day", "last_day(day)"),
        D("completed", "started <= first_day and (ended is null or ended >= end_day)"),
        D("served", "greatest(datediff(least(end_day, ended), greatest(started, first_day)) + 1, 0)"),
        D("below", "4 * served div dayofmonth(end_day)"),
        D("over", "2 * (4 * served - below * dayofmonth(end_day))"),
        D("prorated", "below / 2.0", "over < dayofmonth(end_day)", "nearest"),
        D("prorated", "(below + 1) / 2.0", "over > dayofmonth(end_day)", "nearest"),
        D("prorated", "(below + 1) / 2.0", "over = dayofmonth(end_day)", "quarter_up", "nearest"),
        D("accrued", "2.0", "completed", "whole_month"),
        D("accrued", "prorated", "not completed", "part_month", "whole_month"),
    ),
    ("ended is null or ended >= started",),
)

#: Inputs: salary, day, hour, declared, closed (optional), severity, in_response.
WORKING_HOUR = Scope(
    "working_hour",
    {"rate": "decimal(28,12)", "rate_to_the_penny": MONEY, "week_begins": "date", "week_ends": "date", "night": "boolean", "incident": "boolean"},
    (
        D("rate", "salary / 2080"),
        D("rate_to_the_penny", "round(rate, 2)"),
        D("week_begins", "date_sub(day, weekday(day))"),
        D("week_ends", "date_add(week_begins, 6)"),
        D("night", "hour >= 22 or hour < 6"),
        D("incident", "in_response and severity = 1 and day >= declared and (closed is null or day <= closed)"),
    ),
    ("salary >= 0", "hour >= 0 and hour <= 23"),
)

#: Inputs: annual, relief_days. The exact quota goes on to the commission; a cent can't be nearer to a band's bound than
#: 1 / 36,500, so twelve places decide each band as the fraction does.
QUOTA_RELIEF = Scope(
    "quota_relief",
    {"quota": "decimal(28,12)", "relief": MONEY, "relieved_quota": MONEY},
    (
        D("quota", "annual * (365 - relief_days) / 365"),
        D("relief", "round(annual * relief_days / 365, 2)"),
        D("relieved_quota", "round(quota, 2)"),
    ),
    ("relief_days <= 365", "quota >= 0"),
)

#: Inputs: due, already_paid, misconduct.
LEAVER = Scope(
    "leaver",
    {"payable": MONEY, "overpaid": MONEY},
    (
        D("payable", "greatest(due - already_paid, 0.00)", label="rest"),
        D("payable", "0.00", "misconduct", "misconduct", "rest"),
        D("overpaid", "greatest(already_paid - due, 0.00)"),
    ),
)

SCOPES = {s.name: s for s in (NIGHT, RAIL, MEALS, TRAVEL_DAYS, CREDIT_CLAIM, MONTHLY_CHARGE, MONTHLY_ACCRUAL, WORKING_HOUR, QUOTA_RELIEF, LEAVER)}
