"""Default logic, error values, dates and streams."""

from datetime import date
from decimal import Decimal

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwick.functions import lists, scalars
from tarnwick.operators import surface
from tarnwick.plans import library, obligations
from tarnwick.plans.rules import CONFLICT, REFUSED, SILENT, Scope, apply
from tarnwick.plans.rules import Definition as D


def outcome(spark, scope, **facts):
    rows = spark.range(1).select(*(F.lit(v).alias(k) for k, v in facts.items()))
    return apply(scope, rows, trace=True).first()


def scope(*definitions, **more):
    return Scope("t", {"x": "int", "y": "int", "ok": "boolean"}, definitions, **more)


def test_exceptions_go_before_what_they_except(spark):
    s = scope(D("x", "1", label="a"), D("x", "2", "n > 0", "b", "a"), D("x", "3", "n > 1", "c", "b"))
    assert [outcome(spark, s, n=n)["x"] for n in (0, 1, 2)] == [1, 2, 3]


def test_equal_rank_conflicts_unless_written_alike(spark):
    assert outcome(spark, scope(D("x", "1", "n > 0"), D("x", "2", "n > 1")), n=2)["err"] == CONFLICT
    assert outcome(spark, scope(D("x", "1", "n > 0"), D("x", " 1 ", "n > 1")), n=2)["x"] == 1
    apart = scope(D("x", "0", label="a"), D("x", "1", "n > 0", "b", "a"), D("x", "1", "n > 1", "c", "a"))
    assert outcome(spark, apart, n=2)["err"] == CONFLICT
    assert outcome(spark, apart, n=1)["x"] == 1
    assert apart.roots("x") == ["a"]


def test_silence_assertions_and_their_order(spark):
    assert outcome(spark, scope(D("x", "1", "n > 0")), n=0)["err"] == SILENT
    assert outcome(spark, scope(D("x", "1", "n > 0"), assertions=("n > 5",)), n=0)["err"] == REFUSED
    late = outcome(spark, scope(D("x", "n"), D("y", "x + 1"), assertions=("y > 5",)), n=0)
    assert (late["y"], late["err"]) == (1, REFUSED)


def test_conditions_context_and_trace(spark):
    s = scope(D("ok", "true", "n > 0"), D("x", "7"), conditions=frozenset({"ok"}), context=frozenset({"x"}))
    assert outcome(spark, s, n=0)["ok"] is False
    rows = spark.createDataFrame([(1, None), (1, 9)], "n int, x int")
    assert sorted(r["x"] for r in apply(s, rows).collect()) == [7, 9]
    assert [(g["variable"], g["branch"]) for g in outcome(spark, scope(D("x", "1", label="a"), D("x", "2", "n > 0", "b", "a")), n=1)["governing"]] == [("x", "b")]


def test_scopes_are_checked():
    for bad in ((D("x", "y"), D("y", "x")), (D("x", "1", "true", "a", "nowhere"),), (D("x", "1", "true", "a", "b"), D("x", "2", "true", "b", "a"))):
        with pytest.raises(ValueError):
            scope(*bad)


def test_striking_out_a_label(spark):
    s = scope(D("x", "1", label="a"), D("x", "2", "n > 0", "b", "a"), D("x", "3", "n > 1", "c", "b")).without("b")
    assert [outcome(spark, s, n=n)["x"] for n in (0, 1, 2)] == [1, 1, 3]


def test_probes():
    assert surface.probes("99.90", "0.00", "99.90") == [Decimal("0.00"), Decimal("99.89"), Decimal("99.90")]


@settings(max_examples=15, deadline=None)
@given(st.dates(date(1999, 1, 1), date(2030, 12, 31)), st.integers(-30, 30))
def test_rounding_brackets_the_date(spark, day, months):
    row = spark.range(1).select(*(scalars.add_period(F.lit(day), F.lit(months), F.lit(0), r).alias(r) for r in ("down", "up", "abort"))).first()
    assert row["down"] <= row["up"] and (row["up"] - row["down"]).days <= 1
    assert row["abort"] == (row["down"] if row["down"] == row["up"] else None)


def test_list_edges(spark):
    xs = F.array(F.lit(2), F.lit(5), F.lit(5))
    r = spark.range(1).select(
        lists.arg_max(F.transform(xs, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: s["x"])["i"].alias("later"),
        lists.sequence(F.lit(3), F.lit(1)).alias("none"), lists.sequence(F.lit(1), F.lit(3)).alias("two"),
        lists.nth(xs, F.lit(9)).alias("beyond"), lists.zip_equal(xs, F.array(F.lit(1)), lambda a, b: a + b).alias("unequal"),
    ).first()
    assert (r["later"], r["none"], r["two"], r["beyond"], r["unequal"]) == (2, [], [1, 2], None, None)


def test_money_rounds_once(spark):
    r = spark.range(1).select(scalars.money_over(F.lit(Decimal("0.05")), F.lit(Decimal("2"))).alias("a"), scalars.money_over(F.lit(Decimal("-0.05")), F.lit(Decimal("2"))).alias("b"), scalars.money_over(F.lit(Decimal("1.00")), F.lit(Decimal("0"))).alias("c")).first()
    assert (r["a"], r["b"], r["c"]) == (Decimal("0.03"), Decimal("-0.03"), None)


def test_watch_is_a_stream(spark, tmp_path):
    from tarnwick.streaming.watch import watch

    schema = "key string, text string, ts long"
    for n, rows in enumerate(([("a", "x", 1), ("b", "y", 1)], [("a", "x ", 2), ("b", "z", 2), ("c", "w", 2)])):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 10).json(str(tmp_path / "in"))
        q = watch(stream, str(tmp_path / "state"), str(tmp_path / "ck"))
        q.processAllAvailable()
        q.stop()
    got = {r["key"]: r["status"] for r in spark.read.parquet(str(tmp_path / "state" / "v=1")).collect()}
    assert got == {"a": "baseline", "b": "pending", "c": "pending"}


@pytest.mark.parametrize(
    "facts,rates",
    [
        (dict(ordinal=10, grade=1, holiday=True), ("2.0", "1.0", "1.0")),  # salary has paid one of the two already
        (dict(ordinal=10, grade=1), ("0", "0", "0")),
        (dict(ordinal=45, grade=1, night=True), ("1.25", "1.25", "1.40")),
        (dict(ordinal=49, grade=1, holiday=True), ("2.0", "2.0", "2.0")),  # the greater of 2 and 1.75
        (dict(ordinal=49, grade=6), ("0", "0", "0")),
        (dict(ordinal=49, grade=6, critical=True, night=True, allowance=True), ("1.5", "1.5", "1.5")),
    ],
)
def test_hour_premium(spark, facts, rates):
    out = outcome(spark, library.HOUR_PREMIUM, **{**dict.fromkeys(("holiday", "critical", "night", "allowance"), False), **facts})
    assert (out["multiplier"], out["payable"], out["total_rate"]) == tuple(map(Decimal, rates)) and out["err"] is None


def test_a_week_has_168_hours(spark):
    marks = dict.fromkeys(("holiday", "critical", "night", "allowance"), False)
    assert [outcome(spark, library.HOUR_PREMIUM, ordinal=n, grade=1, **marks)["err"] for n in (0, 168, 169, 200)] == [REFUSED, None, REFUSED, REFUSED]


def test_retention_runs_from_the_later_of_consent_and_renewal(spark):
    rows = [("a", date(2021, 6, 1), [date(2021, 1, 1)]), ("b", date(2021, 6, 1), [date(2022, 2, 1), date(2021, 9, 1)]), ("c", date(2021, 6, 1), []), ("d", None, [])]
    facts = spark.createDataFrame(rows, "k string, consented date, renewals array<date>").selectExpr("*", "'candidate' kind", "date'2020-01-31' started", "cast(null as date) engaged", "false statutory", "0 statutory_months")
    got = {r["k"]: r["until"] for r in apply(obligations.RETENTION, facts).collect()}
    assert got == {"a": date(2023, 6, 1), "b": date(2024, 2, 1), "c": date(2023, 6, 1), "d": date(2021, 1, 31)}
