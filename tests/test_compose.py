"""Scopes that call scopes, against literal cases and a plain loop over the hours."""

import random
from decimal import Decimal

from pyspark.sql import functions as F

from tarnwick.plans import compose, library, service
from tarnwick.plans.compose import Call
from tarnwick.plans.rules import Definition as D
from tarnwick.plans.rules import Scope

HOURS = "week int, hour_of_week int, nth int, grade int, holiday boolean, critical boolean, night boolean, allowance boolean"


def weeks(spark, rows, base):
    hours = spark.createDataFrame(rows, HOURS)
    rates = {"counted": F.count("*"), "rate": F.sum("total_rate"), "banked": F.sum(F.col("toil").cast("int"))}
    tally = compose.call_each("tally", library.HOUR_PREMIUM, hours, ["week"], ["hour_of_week", "nth"], rates, "ordinal", 168)
    facts = hours.groupBy("week").agg(F.bool_and(F.col("hour_of_week").between(1, 168)).alias("in_week"), F.lit(Decimal(base)).alias("base"))
    out = compose.run(service.WEEKLY_OVERTIME, facts.join(tally, "week"), "tally").withColumn("signature", compose.signature())
    return {r["week"]: r for r in out.collect()}


def hour(week, at, grade=3, holiday=False, critical=False, night=False, allowance=False, nth=0):
    return (week, at, nth, grade, holiday, critical, night, allowance)


def test_weeks_of_hours(spark):
    """Cases of the reference's counterexamples: exact sums, places by time, grades, refusals."""
    rows = [hour(1, k, night=True) for k in range(1, 41)]  # forty night hours at 20.10: 120.60, not 120.80
    rows += [hour(2, k) for k in range(1, 42)]  # the forty-first hour
    rows += [hour(3, k, grade=5, critical=k > 40) for k in range(1, 51)]  # all ten paid, none banked
    rows += [hour(4, k, grade=5) for k in range(1, 51)]  # none paid, ten banked
    rows += [hour(5, 169)] + [hour(6, k) for k in range(1, 170 - 1)] + [hour(7, 1, nth=k) for k in range(170)]
    rows += [hour(8, 1, holiday=True)]  # salary has paid half of it
    got = weeks(spark, rows[::-1], "20.10")
    assert [(str(got[k]["overtime_payment"]), got[k]["hours_worked"], str(got[k]["toil_hours"])) for k in (1, 2, 3, 4, 8)] == [
        ("120.60", 40, "0.0"),
        ("25.13", 41, "0.0"),
        ("261.30", 50, "0.0"),
        ("0.00", 50, "10.0"),
        ("20.10", 1, "0.0"),
    ]
    assert [got[k]["err"] for k in range(1, 9)] == [None, None, None, None, "AssertionFailed", None, "AssertionFailed", None]
    assert len({got[k]["signature"] for k in (1, 2, 3, 4, 8)}) == 5  # one branch of the caller, five of what it called
    assert "tally.multiplier=over_40" in got[2]["signature"] and got[7]["signature"] == "AssertionFailed"


def test_weeks_equal_a_plain_loop(spark):
    r, rows = random.Random(1), []
    for week in range(12):
        grade, allowance = r.randint(1, 8), r.random() < 0.3
        rows += [hour(week, at, grade, r.random() < 0.2, r.random() < 0.3, r.random() < 0.3, allowance) for at in r.sample(range(1, 169), r.randint(1, 90))]
    got = weeks(spark, rows, "33.33")
    for week in range(12):
        rate, banked = Decimal(0), 0
        for n, (_, _, _, grade, holiday, critical, night, allowance) in enumerate(sorted(x for x in rows if x[0] == week), 1):
            senior = grade >= 5 and n > 40
            over = Decimal("1.5") if n > 48 else Decimal("1.25") if n > 40 else Decimal(0)
            multiple = Decimal(2) if holiday else over if not senior or critical else Decimal(0)
            rate += max(Decimal(0), multiple - (0 if n > 40 else 1)) + (Decimal("0.15") if night and not allowance else 0)
            banked += senior and not critical
        assert (got[week]["overtime_payment"], got[week]["toil_hours"]) == ((rate * Decimal("33.33")).quantize(Decimal("0.01"), "ROUND_HALF_UP"), banked)


INNER = Scope("inner", {"half": "decimal(9,2)", "big": "boolean"}, (D("half", "x / 2", "x >= 0", "even"), D("half", "0", "x = 'never' or x = 7", "seven", "even"), D("big", "true", "x > 100", "large")), ("x < 1000",), conditions=frozenset({"big"}))


def test_calls_at_depth(spark):
    middle = compose.compose(Scope("middle", {"y": "decimal(9,2)"}, (D("y", "deep.half + 1"),)), Call("deep", Scope("inner", INNER.types, (INNER.definitions[0], D("half", "0", "x = 7", "seven", "even"), INNER.definitions[2]), INNER.assertions, INNER.conditions), {"x": "z * 2"}))
    outer = compose.compose(Scope("outer", {"out": "decimal(9,2)", "said": "string"}, (D("out", "coalesce(m.y, -1)"), D("said", "'m.y is x'"))), Call("m", middle, {"z": "a"}, "a <> 5"))
    assert compose.outputs(outer) == ["out", "said"]
    facts = spark.createDataFrame([(k, v) for k, v in enumerate([1.0, 3.5, 60.0, 5.0, -1.0, 600.0])], "k int, a double")
    got = {r["k"]: r for r in compose.run(outer, facts).withColumn("signature", compose.signature()).collect()}
    assert [float(got[k]["out"]) for k in range(4)] == [2.0, 1.0, 61.0, -1.0] and got[0]["said"] == "m.y is x"
    assert "m.deep.half=even" in got[0]["signature"] and "m.deep.half=seven" in got[1]["signature"] and "m.deep.big=large" in got[2]["signature"]
    assert "m." not in got[3]["signature"].replace("'m.y", "")  # not called: it neither fails nor decides
    assert [got[k]["err"] for k in range(6)] == [None, None, None, None, "NoApplicableRule", "AssertionFailed"]
    assert {c for c in got[0].asDict() if "__" in c} == set()


def test_names_in_expressions():
    names = {"x": "(a + 1)", "call.y": "call__y"}
    assert compose.rewritten("x + size(x) + 'x is x' + call.y + other.x + x.field", names) == "(a + 1) + size((a + 1)) + 'x is x' + call__y + other.x + (a + 1).field"
    assert compose.rewritten("x(1) + xx + \"x\"", names) == "x(1) + xx + \"x\""


def test_elements_are_hashed(spark):
    """Ways of deciding are counted without a sort, whole numbers of any sign keep their order, and nulls come first."""
    rows = spark.createDataFrame([(1, None, 1), (1, -(1 << 63), 5), (1, -1, -3), (1, -1, 2), (1, 0, None), (1, 0, -(1 << 31)), (1, (1 << 63) - 1, (1 << 31) - 1), (1, 7, 0)], "k int, a bigint, b int")
    ordered = [tuple(r) for r in rows.orderBy(compose._in_one(rows, ["a", "b"])).select("a", "b").collect()]
    assert ordered == [tuple(r) for r in rows.orderBy(F.struct("a", "b")).select("a", "b").collect()]
    assert compose._in_one(rows.withColumn("b", F.col("a")), ["a", "b"])._jc.toString() == F.struct("a", "b")._jc.toString()
    scope = Scope("sign", {"low": "boolean"}, (D("low", "false", label="no"), D("low", "true", "b < 0", "yes", "no")), ("b <> 5",))
    out = compose.call_each("each", scope, rows.where("b is not null"), ["k"], ["a", "b"], {"n": F.count("*")})
    plan = out._jdf.queryExecution().sparkPlan().toString()
    assert "SortAggregate" not in plan
    row = out.first()
    assert row["each__err"] == "AssertionFailed" and row["n"] is None and [g["branch"] for g in row["each__governing"]] == ["no", "yes"]
