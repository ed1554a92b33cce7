"""Scopes of the rule library."""

from __future__ import annotations

from tarnwick.plans.rules import Definition as D
from tarnwick.plans.rules import Scope

#: Credits for availability below a promise: bands, a cap, a deeper band that lifts the cap, and a bar for arrears.
SERVICE_CREDIT = Scope(
    "service_credit",
    {"credit": "decimal(9,4)", "cap": "decimal(9,4)", "payable": "decimal(9,4)", "amount": "decimal(18,2)"},
    (
        D("credit", "0.00", label="none"),
        D("credit", "0.05", "availability < 99.90 and availability >= 99.50", "bands", "none"),
        D("credit", "0.10", "availability < 99.50 and availability >= 99.00", "bands", "none"),
        D("credit", "0.20", "availability < 99.00 and availability >= 98.00", "bands", "none"),
        D("credit", "0.30", "availability < 98.00", "bands", "none"),
        D("credit", "0.50", "availability < 95.00", "deep", "bands"),
        D("credit", "0.00", "availability < 99.90 and undisputed and arrears_days > 30", "arrears", "deep"),
        D("cap", "0.30", label="cap"),
        D("cap", "0.50", "availability < 95.00", "deep_cap", "cap"),
        D("payable", "least(credit, cap)"),
        D("amount", "round(charge * payable, 2)"),
    ),
    ("availability >= 0 and availability <= 100", "arrears_days >= 0"),
)

#: Premium for an hour of work: a chain of seven, a night premium and time off in lieu. Salary already pays an hour up
#: to the 40th once, so only what the multiple adds to that is payable. The rates and the hours.
HOUR_PREMIUM = Scope(
    "hour_premium",
    {
        "multiplier": "decimal(9,4)", "salaried": "decimal(9,4)", "payable": "decimal(9,4)", "night_premium": "decimal(9,4)",
        "total_rate": "decimal(9,4)", "toil": "boolean",
    },
    (
        D("multiplier", "0.00", label="ordinary"),
        D("multiplier", "1.25", "ordinal > 40", "over_40", "ordinary"),
        D("multiplier", "1.50", "ordinal > 48", "over_48", "over_40"),
        D("multiplier", "0.00", "grade >= 5 and ordinal > 40", "senior", "over_48"),
        D("multiplier", "case when ordinal > 48 then 1.50 else 1.25 end", "grade >= 5 and ordinal > 40 and critical", "critical", "senior"),
        D("multiplier", "2.00", "holiday", "holiday", "critical"),
        D("multiplier", "greatest(2.00, 1.50 + 0.25)", "holiday and ordinal > 48", "late_holiday", "holiday"),
        D("salaried", "case when ordinal > 40 then 0.00 else 1.00 end"),
        D("payable", "greatest(multiplier - salaried, 0.00)"),
        D("night_premium", "case when night then 0.15 else 0.00 end", label="night"),
        D("night_premium", "0.00", "allowance", "allowance", "night"),
        D("total_rate", "payable + night_premium"),
        D("toil", "true", "grade >= 5 and ordinal > 40", "toil_senior"),
        D("toil", "false", "grade >= 5 and ordinal > 40 and critical", "toil_critical", "toil_senior"),
    ),
    ("ordinal >= 1 and ordinal <= 168", "grade >= 1"),
    conditions=frozenset({"toil"}),
)

#: Whether a late claim is admissible: 60 days, 120 with a certificate, never later.
CLAIM_WINDOW = Scope(
    "claim_window",
    {"days": "int", "admissible": "boolean"},
    (
        D("days", "datediff(submitted, incurred)"),
        D("admissible", "days <= 60", label="in_time"),
        D("admissible", "true", "days > 60 and days <= 120 and certified", "certified", "in_time"),
        D("admissible", "false", "days > 120", "long_stop", "certified"),
    ),
    ("submitted >= incurred",),
)

#: Two clauses of equal rank that disagree above a limit: a deliberate conflict, and silence below another.
RIVAL_CAPS = Scope(
    "rival_caps",
    {"cap": "decimal(18,2)"},
    (
        D("cap", "2000.00", "price >= 1000", "first"),
        D("cap", "1000.00 * 2", "price >= 100000", "second"),
    ),
)

SCOPES = {s.name: s for s in (SERVICE_CREDIT, HOUR_PREMIUM, CLAIM_WINDOW, RIVAL_CAPS)}
