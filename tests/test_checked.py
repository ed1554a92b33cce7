"""Values that carry their error, by hand; gates on a small scope."""

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from tarnwick.functions import checked as c
from tarnwick.operators import gates
from tarnwick.plans.rules import Definition as D
from tarnwick.plans.rules import Scope


def told(spark, *values):
    row = spark.range(1).select(*(v.both.alias(f"v{k}") for k, v in enumerate(values))).first()
    return [(x["value"], x["err"]) for x in row]


def n(x):
    return c.literal(x, "int")


def test_numbers(spark):
    money = c.given(F.lit(Decimal("10.05")), "money")
    zero = c.over(n(1), n(0))
    got = told(spark, c.over(n(1), n(3)), zero, c.over(money, n(-2)), c.times(money, c.given(F.lit(Decimal("0.5")), "rat")), c.converted(c.given(F.lit(Decimal("-2.5")), "money"), "int"), c.converted(c.given(F.lit(Decimal("-2.5")), "rat"), "int"), c.rounded(c.given(F.lit(Decimal("2.5")), "rat")), c.given(F.lit(None), "int"))
    assert got == [(Decimal("0.333333"), None), (None, "DivisionByZero"), (Decimal("-5.03"), None), (Decimal("5.03"), None), (-3, None), (-2, None), (Decimal(3), None), (None, "NoValue")]
    with pytest.raises(TypeError):
        c.plus(n(1), money)


def test_the_first_error_wins_and_untaken_branches_do_not(spark):
    zero, empty = c.compared(c.over(n(1), n(0)), ">", c.literal(0, "rat")), c.compared(c.extreme(c.given(F.array().cast("array<bigint>"), "list of int"), True), ">", n(0))
    yes, no = c.literal(True, "bool"), c.literal(False, "bool")
    got = told(spark, c.both(no, zero), c.either(zero, empty), c.both(empty, zero), c.chosen(yes, n(1), c.failing(c.IMPOSSIBLE, "int")), c.chosen(zero, n(1), n(2)), c.asserting(no, n(1)), c.asserting(empty, n(1)), c.only_one((yes, n(1)), (no, n(2))), c.only_one((yes, n(1)), (yes, n(1))), c.only_one((no, n(1))))
    assert got == [(None, "DivisionByZero"), (None, "DivisionByZero"), (None, "ListEmpty"), (1, None), (None, "DivisionByZero"), (None, "AssertionFailed"), (None, "ListEmpty"), (1, None), (None, "Conflict"), (None, "NoValue")]


def test_dates_and_durations(spark):
    day = c.given(F.lit(datetime.date(2024, 1, 31)), "date")
    month, days = c.duration(months=1), c.duration(days=30)
    got = told(spark, c.plus(day, month), c.plus(day, month, "up"), c.plus(day, month, "down"), c.minus(day, days), c.compared(month, "<", days), c.compared(c.duration(years=1), "=", c.duration(months=12)), c.compared(c.duration(months=1, days=1), "=", c.duration(months=1, days=1)), c.over(days, month), c.over(days, c.duration()), c.over(c.times(days, n(2)), c.duration(days=7)))
    date = datetime.date
    assert got == [(None, "DateError"), (date(2024, 3, 1), None), (date(2024, 2, 29), None), (date(2024, 1, 1), None), (None, "DateError"), (True, None), (True, None), (None, "DateError"), (None, "DivisionByZero"), (Decimal("8.571429"), None)]
    assert told(spark, c.compared(c.literal("f", "function"), "=", c.literal("f", "function"))) == [(None, "UncomparableValues")]


def test_lists(spark):
    xs, ys = c.given(F.array(F.lit(1), F.lit(0)).cast("array<bigint>"), "list of int"), c.given(F.array(F.lit(1)).cast("array<bigint>"), "list of int")
    ratios = c.each(xs, lambda x: c.over(n(6), x))
    got = told(spark, c.total(ratios), c.each(c.each(ys, lambda x: c.over(n(6), x)), lambda r: c.plus(r, r)), c.zipped(xs, ys, lambda x, y: x + y, "int"), c.total(c.zipped(xs, xs, lambda x, y: x + y, "int")), c.compared(ys, "<", xs))
    assert got == [(None, "DivisionByZero"), ([Decimal(12)], None), (None, "NotSameLength"), (2, None), (True, None)]
    tag = c.literal("b", "text")
    assert told(spark, c.matched(tag, {"a": n(1)}, ("a", "b"), n(9)), c.matched(c.literal("z", "text"), {"a": n(1), "b": n(2)}, ("a", "b"))) == [(9, None), (None, "Impossible")]
    with pytest.raises(TypeError):
        c.matched(tag, {"a": n(1)}, ("a", "b"))


def test_gates(spark):
    scope = Scope("s", {"y": "int"}, (D("y", "1", "x > 3", "low"), D("y", "2", "x > 5", "high", "low"), D("y", "3", "x > 50", "never", "high")), ("x >= 0",))
    facts = spark.createDataFrame([(k,) for k in range(-1, 10)], "x int")
    assert {tuple(r) for r in gates.outcomes(scope, facts).collect()} == {("computed", 6), ("NoApplicableRule", 4), ("AssertionFailed", 1)}
    assert {tuple(r) for r in gates.branches(scope, facts).collect()} == {("y", "low", 2), ("y", "high", 4), ("y", "never", 0)}
    report = {r["mutant"]: r["killing"] for r in gates.mutation_report(scope, facts, ["y"]).collect()}
    assert report["shift_threshold:1:y:high:4"] == 1 and report["drop_exception:2:y:never"] == 0 and report["change_constant:0:y:low"] == 2
    same = Scope("s", {"y": "int"}, (D("y", "case when x > 5 then 2 else 1 end", "x >= 4", "one"),), ("x >= 0",))
    assert gates.disagreements(scope, same, facts, ["y"]).count() == 0 and gates.disagreements(scope, scope.without("high"), facts, ["y"]).count() == 4


def test_rows_of_values_compile(spark):
    """Queries over whole tables bind and split by columns and rows; a lambda over them would run uncompiled."""
    from tarnwick.plans import catalogue

    plan = lambda name: catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().sparkPlan().toString()
    assert "lambda" not in plan("period_split") + plan("checked_dates") + plan("checked_numbers")
