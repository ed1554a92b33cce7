"""Maps from rules, and cases on them, against plain loops."""

import random
from decimal import Decimal
from itertools import product

import pytest
from pyspark.sql import functions as F

from tarnwick.operators import maps
from tarnwick.operators.predicates import Atom, Predicate, first_firing
from tarnwick.plans.rules import Definition as D
from tarnwick.plans.rules import Scope

SCOPE = Scope(
    "scope",
    {"out": "decimal(9,2)"},
    (D("out", "1.00", label="base"), D("out", "2.00", "x > 10", "more", "base"), D("out", "3.00", "x > 10 and y >= 2.5", "most", "more"), D("out", "x", "x > 10 and y >= 2.5 and flag", "flagged", "most")),
)
DOMAIN = maps.Domain({"x": maps.Input("int", "0", "30"), "y": maps.Input("decimal(9,2)", "0", "5"), "flag": maps.Input("boolean")}, (("x", ">=", "y"),), favours={"out": "counterparty"})


def test_axes():
    found = maps.borders(SCOPE, DOMAIN.inputs)
    assert [(b.variable, b.operator, b.literal, b.label) for b in found] == [("x", ">", "10", "more"), ("y", ">=", "2.5", "most")]
    values = maps.probe_values(DOMAIN, found)
    assert values == {"x": ["0", "9", "10", "11", "30"], "y": ["0", "2.4", "2.5", "2.6", "5"], "flag": ["false", "true"]}
    assert maps.fitted(values, ("y", "x"), 10) == ({"x": values["x"], "flag": values["flag"]}, {"y": "0"})
    with pytest.raises(ValueError):
        maps.fitted(values, ("y",), 9)


def test_every_case_has_its_nearest_cell(spark):
    """Cases midway between cells, and near incoherent ones, among them."""
    r = random.Random(1)
    cases = [(k, r.choice([r.randint(0, 30), 20, 4]), Decimal(r.randint(0, 1000)) / 200, r.random() < 0.5, "extra") for k in range(400)]
    cases += [(900, None, Decimal(1), True, "x"), (901, 3, None, True, "x"), (902, 3, Decimal(1), None, "x")]
    got = {c["k"]: c for c in maps.locate(spark.createDataFrame(cases, "k int, x int, y decimal(9,3), flag boolean, region_of string"), SCOPE, DOMAIN).collect()}
    on_map = sorted(maps.surface(spark, SCOPE, DOMAIN).collect(), key=lambda c: (c["region"], c["ordinal"]))
    assert len(on_map) == sum(int(x) >= Decimal(y) for x, y, _ in product(["0", "9", "10", "11", "30"], ["0", "2.4", "2.5", "2.6", "5"], "ft"))
    for k, x, y, flag, _ in cases[:400]:
        best = min((abs(c["x"] - x) + abs(c["y"] - y), c["region"], c["ordinal"]) for c in on_map if c["flag"] == flag)
        assert (got[k]["distance"], got[k]["region"], got[k]["ordinal"]) == best
    assert all(got[k]["region"] is None for k in (900, 901, 902)) and got[0]["region_of"] == "extra"
    assert maps.locate(spark.createDataFrame([], "x int, y decimal(9,2), flag boolean"), SCOPE, DOMAIN).count() == 0


def test_regions_and_changes(spark):
    cases = spark.createDataFrame([(x, Decimal(y), f) for x in range(31) for y in range(6) for f in (True, False) if x >= y], "x int, y decimal(9,2), flag boolean")
    there = maps.populate(cases, SCOPE, DOMAIN).collect()
    assert sum(c["population"] for c in there) == cases.count() and {c["region"] for c in there} == {1, 2, 3, 4}
    out = maps.moved(cases, SCOPE, SCOPE.without("most"), DOMAIN, "out").collect()
    assert {c["kind"] for c in out} == {"revalued"} and all(not c["flag"] and c["delta"] == -1 for c in out)
    kept = {tuple(map(str, r)) for r in maps.border_population(cases, SCOPE, DOMAIN).collect()}
    xs = [r["x"] for r in cases.collect()]
    assert ("x", ">", "10", "more", str(sum(x < 10 for x in xs)), str(xs.count(10)), str(sum(x > 10 for x in xs))) in kept
    impact = maps.holding_impact(cases, SCOPE, DOMAIN, Predicate("h", ("x > 10",), "out", "3"), 640).collect()
    for row in impact:
        cells = [c for c in maps.surface(spark, SCOPE, DOMAIN).collect() if c["region"] == row["region"] and c["x"] > 10]
        assert (row["caught"], row["same"], row["hit"], row["against"]) == (len(cells), sum(c["out"] == 3 for c in cells), sum(c["out"] < 3 for c in cells), sum(c["out"] > 3 for c in cells))
        assert (row["population"] > 0) == (row["hit"] == row["size"])


def test_typed_predicates(spark):
    rows = spark.createDataFrame([(1, True, "10", Decimal("2.50"), 2.0), (2, None, "abc", None, 5.0)], "k int, b boolean, s string, m decimal(9,2), d double")
    holds = {t: [r[0] for r in rows.select(Atom.of(t).holds(rows.schema)).collect()] for t in ("b = true", "b = 1", "b = 'true'", "s > 9", "s = abc", "m >= 2.5", "m = true", "gone = 1", "k != 1", "s < b", "d = 2")}
    assert holds == {"b = true": [True, False], "b = 1": [False, False], "b = 'true'": [True, False], "s > 9": [True, True], "s = abc": [False, True], "m >= 2.5": [True, False], "m = true": [False, False], "gone = 1": [False, False], "k != 1": [False, True], "s < b": [True, True], "d = 2": [True, False]}
    with pytest.raises(ValueError):
        Atom.of("x between 1 and 2")
    ps = (Predicate("never", ()), Predicate("small", ("k < 2", "b = true"), "m", "@d"), Predicate("any", ("k > 0",), "s", "4"))
    got = first_firing(rows, ps).orderBy("k").collect()
    assert [(r["predicate"], r["amount"]) for r in got] == [("small", Decimal("0.5")), ("any", None)]
    assert [r[0] for r in rows.orderBy("k").select(Predicate("p", ("k > 0",), "d", "3").movement(rows.schema, {"d": "company"})).collect()] == ["against", "for"]


def test_cases_carry_no_map(spark):
    """All cells go only to the cases that are lost among incoherent ones, not to each case."""
    cases = spark.range(100).selectExpr("cast(id % 31 as int) x", "cast(id % 6 as decimal(9,3)) y", "id % 2 = 0 flag")
    for out in (maps.locate(cases, SCOPE, DOMAIN).select("region"), maps.populate(cases, SCOPE, DOMAIN)):
        loops = [x for x in out._jdf.queryExecution().executedPlan().toString().split("\n") if "NestedLoopJoin" in x]
        assert all("LeftOuter, _lost" in x for x in loops)


def test_axes_of_one_value_and_none(spark):
    one = maps.Domain({"x": maps.Input("int", probe=("5",)), "y": maps.Input("decimal(9,2)", probe=("2",)), "flag": maps.Input("boolean")})
    scope = Scope("scope", {"out": "int"}, (D("out", "1", "flag", "yes"), D("out", "2", "not flag", "no")))
    cases = spark.createDataFrame([(1, 7, Decimal(1), True), (2, 5, None, True), (3, 0, Decimal(2), False)], "k int, x int, y decimal(9,3), flag boolean")
    got = {r["k"]: (r["region"], r["distance"]) for r in maps.locate(cases, scope, one).collect()}
    assert got == {1: (2, 3), 2: (None, None), 3: (1, 5)}
