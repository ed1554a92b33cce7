"""Scopes that call others: availability of a service from its outages, and overtime of a week from its hours.

Fixed values: the definitions, thresholds and their order, which follow the clauses named beside them.
"""

from __future__ import annotations

from tarnwick.plans.compose import Call, compose
from tarnwick.plans.library import HOUR_PREMIUM
from tarnwick.plans.rules import Definition as D
from tarnwick.plans.rules import Scope

#: L-2.1. Inputs: period_start.
MEASUREMENT_PERIOD = Scope("measurement_period", {"period_end": "date", "total_minutes": "int"}, (D("period_end", "last_day(period_start)"), D("total_minutes", "day(last_day(period_start)) * 1440")))

#: L-2.2. Inputs: well_formed, responded, in_time.
REQUEST_AVAILABLE = Scope("request_available", {"available": "boolean"}, (D("available", "well_formed and responded and in_time"),))

#: L-2.6, first limb. Inputs: maintenance, notice_days (business days strictly between notice and window).
MAINTENANCE_WINDOW = Scope("maintenance_window", {"business_days_notice": "int", "scheduled": "boolean"}, (D("business_days_notice", "notice_days"), D("scheduled", "maintenance and business_days_notice >= 5")))

#: L-2.5. Inputs: minutes, scheduled, emergency, emergency_notice, force_majeure, customer_act, suspension.
EXCLUDED_MINUTES = Scope(
    "excluded_minutes",
    {"limb_a": "boolean", "limb_b": "boolean", "limb_c": "boolean", "limb_d": "boolean", "limb_e": "boolean", "is_excluded": "boolean", "excluded": "bigint"},
    (
        D("limb_a", "scheduled"),
        D("limb_b", "emergency and emergency_notice >= 60"),
        D("limb_c", "force_majeure"),
        D("limb_d", "customer_act"),
        D("limb_e", "suspension"),
        D("is_excluded", "limb_a or limb_b or limb_c or limb_d or limb_e"),
        D("excluded", "case when is_excluded then minutes else 0 end"),
    ),
)

#: An outage: its window, and what it excludes, which calls the window again. Inputs: those of both but scheduled.
OUTAGE = compose(
    Scope("outage", {"maintained": "bigint", "excluded_of_it": "bigint"}, (D("maintained", "case when window.scheduled then minutes else 0 end"), D("excluded_of_it", "limbs.excluded"))),
    Call("window", MAINTENANCE_WINDOW, {"maintenance": "maintenance", "notice_days": "notice_days"}),
    Call(
        "limbs",
        compose(EXCLUDED_MINUTES, Call("window", MAINTENANCE_WINDOW, {"maintenance": "maintenance", "notice_days": "notice_days"})),
        {"scheduled": "window.scheduled"},
    ),
)

#: L-2.6 and L-4.5. Inputs: aggregate (minutes of all windows).
SCHEDULED_MAINTENANCE = Scope(
    "scheduled_maintenance",
    {"cap": "int", "aggregate_minutes": "bigint", "excess": "bigint", "kept": "bigint"},
    (
        D("cap", "8 * 60"),
        D("aggregate_minutes", "aggregate"),
        D("excess", "0", label="l4_5_no_excess"),
        D("excess", "aggregate_minutes - cap", "aggregate_minutes > cap", "l4_5_excess", "l4_5_no_excess"),
        D("kept", "aggregate_minutes - excess"),
    ),
)

#: L-2.4, L-4.5, L-2.3 and L-3.1. Inputs: total, not_available, excluded, excess.
AVAILABILITY_PERCENTAGE = Scope(
    "availability_percentage",
    {"before": "bigint", "unavailable": "bigint", "percentage": "decimal(9,2)", "meets": "boolean"},
    (
        D("before", "excluded + excess"),
        D("unavailable", "not_available - before", label="l2_4"),
        D("unavailable", "not_available - before + excess", "excess > 0", "l4_5", "l2_4"),
        D("percentage", "round(cast(total - unavailable as decimal(18,0)) * 100 / total, 2)"),
        D("meets", "percentage >= 99.90"),
    ),
    ("total > 0",),
)

#: Inputs: period_start, and of its outages not_available, aggregate and by_limbs (sums).
SERVICE_AVAILABILITY = compose(
    Scope(
        "service_availability",
        {"total_minutes": "int", "excess_minutes": "bigint", "excluded_before": "bigint", "excluded_minutes": "bigint", "unavailable_minutes": "bigint", "availability": "decimal(9,2)", "meets_level": "boolean"},
        (
            D("total_minutes", "period.total_minutes"),
            D("excess_minutes", "maintenance.excess"),
            D("excluded_before", "by_limbs"),
            D("excluded_minutes", "excluded_before - excess_minutes"),
            D("unavailable_minutes", "percent.unavailable"),
            D("availability", "percent.percentage"),
            D("meets_level", "percent.meets"),
        ),
    ),
    Call("period", MEASUREMENT_PERIOD),
    Call("maintenance", SCHEDULED_MAINTENANCE),
    Call("percent", AVAILABILITY_PERCENTAGE, {"total": "total_minutes", "not_available": "not_available", "excluded": "excluded_minutes", "excess": "excess_minutes"}),
)

#: C-4 to C-8 over a week: rates add up exactly and become money once. Inputs: in_week (all hours are hours of a week), base
#: and the sums of HOUR_PREMIUM over the week's hours: counted, rate, banked.
WEEKLY_OVERTIME = Scope(
    "weekly_overtime",
    {"hours_worked": "bigint", "overtime_payment": "decimal(18,2)", "toil_hours": "decimal(18,1)"},
    (D("hours_worked", "counted"), D("overtime_payment", "round(rate * base, 2)"), D("toil_hours", "banked")),
    ("in_week",),
)

#: An hour's pay, from the base rate of the year's salary (C-2.1) and what HOUR_PREMIUM gives; a shift worker's night hours
#: are paid by contract, without a call. Inputs: salary, shift_worker and those of HOUR_PREMIUM.
HOUR_PAY = compose(
    Scope(
        "hour_pay",
        {"base_rate": "decimal(18,2)", "pay": "decimal(18,2)"},
        (D("base_rate", "round(salary / 2080, 2)"), D("pay", "round(base_rate * premium.total_rate, 2)", label="by_annex"), D("pay", "0.00", "shift_worker and night", "by_contract", "by_annex")),
    ),
    Call("premium", HOUR_PREMIUM, {}, "not (shift_worker and night)"),
)
SCOPES = {s.name: s for s in (MEASUREMENT_PERIOD, REQUEST_AVAILABLE, MAINTENANCE_WINDOW, EXCLUDED_MINUTES, OUTAGE, SCHEDULED_MAINTENANCE, AVAILABILITY_PERCENTAGE, SERVICE_AVAILABILITY, WEEKLY_OVERTIME, HOUR_PAY)}
