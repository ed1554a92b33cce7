"""Scopes of the rule library on pay, deadlines, retention and availability.

Ratios are compared by products, so that thresholds are exact. Optional dates are nullable. Each scope says in its
dates whether a day that a month lacks goes to that month's last day (down) or to the first of the next (up).
"""

from __future__ import annotations

from tarnwick.plans.rules import Definition as D
from tarnwick.plans.rules import Scope

MONEY, FACTOR = "decimal(18,2)", "decimal(9,4)"


def down(date: str, months: str | int) -> str:
    return f"add_months({date}, {months})"


def up(date: str, months: str | int) -> str:
    moved = f"add_months({date}, {months})"
    return f"(case when day({moved}) < day({date}) then date_add({moved}, 1) else {moved} end)"


#: Inputs: net and quota (exact), new_share, commenced, year_start, salary. One product, rounded once.
COMMISSION = Scope(
    "commission",
    {"attainment": "decimal(28,12)", "band": FACTOR, "before_joiner": FACTOR, "accelerator": FACTOR, "before_cap": MONEY, "cap": MONEY, "payable": MONEY},
    (
        D("attainment", "try_divide(net, quota)", "quota > 0"),
        D("attainment", "0.0", "quota <= 0"),
        D("band", "0.0", "quota <= 0 or net < quota * 0.50"),
        D("band", "1.0", "quota > 0 and net >= quota * 0.50 and net < quota"),
        D("band", "1.5", "quota > 0 and net >= quota and net < quota * 1.50"),
        D("band", "2.0", "quota > 0 and net >= quota * 1.50"),
        D("before_joiner", "case when new_share > 0.60 then band + 0.25 else band end"),
        D("accelerator", "band", label="table"),
        D("accelerator", "before_joiner", "new_share > 0.60", "new_logos", "table"),
        D("accelerator", "least(before_joiner, 1.5)", "commenced > year_start", "joiner", "new_logos"),
        D("before_cap", "round(net * 0.08 * accelerator, 2)"),
        D("cap", "salary * 2.50", label="cap"),
        D("cap", "salary * 4.00", "quota > 0 and net > quota * 2", "high_cap", "cap"),
        D("payable", "least(before_cap, cap)"),
    ),
    ("quota >= 0", "quota > 0 or net = 0"),
)

#: Inputs: paid, paid_on, assessed, churned, breach. The long stop goes before all else.
RECOVERY = Scope(
    "recovery",
    {"long_stop": "date", "time_barred": "boolean", "recoverable": MONEY},
    (
        D("long_stop", down("paid_on", 24)),
        D("time_barred", "assessed > long_stop"),
        D("recoverable", "0.00", label="none"),
        D("recoverable", "paid", "churned", "churned", "none"),
        D("recoverable", "0.00", "churned and breach", "own_breach", "churned"),
        D("recoverable", "0.00", "churned and time_barred", "barred", "own_breach"),
    ),
    ("paid >= 0",),
)

#: Inputs: issued and released (optional), assessed, retained_until, permitted.
LEGAL_HOLD = Scope(
    "legal_hold",
    {"in_force": "boolean", "due": "date", "erasure_blocked": "boolean", "purge": "date"},
    (
        D("in_force", "coalesce(assessed >= issued and (released is null or assessed < released), false)"),
        D("due", "retained_until", label="ordinary"),
        D("due", "case when retained_until < released then date_add(released, 30) else retained_until end", "issued is not null and released is not null", "released_hold", "ordinary"),
        D("due", "cast(null as date)", "in_force", "held", "released_hold"),
        D("erasure_blocked", "in_force", label="hold"),
        D("erasure_blocked", "false", "in_force and not permitted", "not_permitted", "hold"),
        D("purge", "date_add(due, 90)"),
    ),
    ("released is null or coalesce(released >= issued, false)",),
)

#: Inputs: requested, verified (optional), valid, by_law, by_claims, held.
ERASURE = Scope(
    "erasure",
    {"due": "date", "refused": "boolean"},
    (
        D("due", "cast(null as date)", label="none"),
        D("due", "date_add(verified, 30)", "valid", "valid", "none"),
        D("due", "cast(null as date)", "valid and (by_law or by_claims or held)", "barred", "valid"),
        D("refused", "false", label="granted"),
        D("refused", "true", "valid and (by_law or by_claims or held)", "refused", "granted"),
    ),
    ("verified is null or verified >= requested",),
)

#: Inputs: effective, assessed, notice and ceased (optional), secret, personal, still_secret. Dates go up.
_TERM, _NOTICE = up("effective", 24), "date_add(notice, 30)"
_HELD_UNTIL = "case when ceased is not null then greatest(ends, ceased) end"
SURVIVAL = Scope(
    "survival",
    {"ends": "date", "survives_until": "date", "subsist": "boolean"},
    (
        D("ends", _TERM, label="term"),
        D("ends", _NOTICE, f"notice is not null and notice >= effective and {_NOTICE} < {_TERM}", "notice", "term"),
        D("survives_until", up("ends", 36), label="three_years"),
        D("survives_until", "cast(null as date)", "secret and not personal", "secret", "three_years"),
        D("survives_until", _HELD_UNTIL, "personal and not secret", "personal", "three_years"),
        D("survives_until", f"case when still_secret then null else ({_HELD_UNTIL}) end", "secret and personal", "both", "three_years"),
        D("subsist", "true", "assessed >= effective and assessed <= ends", "in_term"),
        D("subsist", "false", "assessed < effective", "before"),
        D("subsist", f"assessed <= {up('ends', 36)}", "assessed > ends", "after"),
        D("subsist", "still_secret", "assessed > ends and secret and not personal", "secret_after", "after"),
        D("subsist", "ceased is null or assessed <= greatest(ends, ceased)", "assessed > ends and personal and not secret", "personal_after", "after"),
        D("subsist", "still_secret or ceased is null or assessed <= greatest(ends, ceased)", "assessed > ends and secret and personal", "both_after", "after"),
    ),
    ("ends >= effective", "survives_until is null or survives_until >= ends"),
)

#: Inputs: kind, started, engaged and consented (optional), renewals (array), statutory, statutory_months.
RETENTION = Scope(
    "retention",
    {"until": "date"},
    (
        D("until", down("started", 72), "kind = 'employee'", "employee"),
        D("until", down("started", 84), "kind = 'contract'", "contract"),
        D("until", down("started", "7 * 12"), "kind = 'financial'", "financial"),
        D("until", down("greatest(started, engaged)", 24), "kind = 'marketing'", "marketing"),
        D("until", down("started", 13), "kind = 'security'", "security"),
        D("until", down("started", 12), "kind = 'candidate'", "candidate"),
        D("until", down("greatest(consented, array_max(renewals))", 24), "kind = 'candidate' and consented is not null", "talent_pool", "candidate"),
        D("until", f"greatest({down('started', 72)}, {up('started', 'statutory_months')})", f"kind = 'employee' and statutory and {down('started', 'statutory_months')} > {down('started', 72)}", "statutory", "employee"),
    ),
    (f"not statutory or {up('started', 'statutory_months')} >= started",),
)

#: Inputs: accrued, prevented. Rounding to half days, exact quarters up; what may be carried forward.
LEAVE = Scope(
    "leave",
    {"below": "bigint", "rounded": FACTOR, "permitted": FACTOR, "carried": FACTOR, "forfeited": FACTOR},
    (
        D("below", "floor(accrued * 2)"),
        D("rounded", "below / 2.0", "accrued * 2 - below < 0.5", "nearest"),
        D("rounded", "(below + 1) / 2.0", "accrued * 2 - below > 0.5", "nearest"),
        D("rounded", "(below + 1) / 2.0", "accrued * 2 - below = 0.5", "quarter_up", "nearest"),
        D("permitted", "5.0", label="five_days"),
        D("permitted", "accrued", "prevented", "sickness", "five_days"),
        D("carried", "least(accrued, permitted)"),
        D("forfeited", "accrued - carried"),
    ),
    ("accrued >= 0",),
)

#: Inputs: cost, minute (of the day), airport.
TAXI = Scope(
    "taxi",
    {"reimbursable": MONEY},
    (
        D("reimbursable", "least(cost, 60.00)", label="cap"),
        D("reimbursable", "cost", "airport and (minute < 6 * 60 or minute > 22 * 60)", "airport_at_night", "cap"),
    ),
    ("cost >= 0", "minute >= 0 and minute < 1440"),
)

#: Inputs: period_start, down_minutes, excluded_minutes, excess_minutes (of scheduled maintenance beyond its limit).
AVAILABILITY = Scope(
    "availability",
    {"total": "int", "excluded": "bigint", "unavailable": "bigint", "availability": "decimal(9,2)", "meets": "boolean"},
    (
        D("total", "day(last_day(period_start)) * 1440"),
        D("excluded", "excluded_minutes + excess_minutes"),
        D("unavailable", "down_minutes - excluded", label="net"),
        D("unavailable", "down_minutes - excluded + excess_minutes", "excess_minutes > 0", "excess", "net"),
        D("availability", "round(cast(total - unavailable as decimal(18,0)) * 100 / total, 2)"),
        D("meets", "availability >= 99.90"),
    ),
)

SCOPES = {s.name: s for s in (COMMISSION, RECOVERY, LEGAL_HOLD, ERASURE, SURVIVAL, RETENTION, LEAVE, TAXI, AVAILABILITY)}
