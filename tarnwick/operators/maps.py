"""Maps of a scope's decisions, made from its rules, and where the cases of a table lie on them.

Borders are the comparisons that a scope's conditions make with its inputs. Each gives a value and its neighbours one step
to either side, in the step of its own literal; with the ends of the domain these are the axes. Their product, bounded
by a cap, is the grid: it never grows with a table. Regions are cells that are decided alike.

A case belongs to the region of its nearest cell, by the sum of distances along the numeric axes; other axes must be
equal. That sum is least where each distance is, so a case is snapped to each axis by itself; only where the snapped
cells are incoherent, and so not on the map, are all cells tried. What a case snaps to is a number for each axis, which
meets a small broadcast table of first places by equality; no pair of a case and a cell is ever a row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from decimal import ROUND_HALF_UP, Decimal
from functools import reduce
from itertools import product
from math import prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.operators.predicates import Predicate
from tarnwick.operators.surface import cells, diff
from tarnwick.plans.rules import Scope

_BORDER = re.compile(r"(?<![\w.'])([A-Za-z_]\w*)\s*(>=|<=|<>|!=|=|<|>)\s*(-?\d+(?:\.\d+)?)(?![\w.])")
EXACT = "decimal(28,6)"


@dataclass(frozen=True)
class Input:
    """``kind``: SQL type. ``low`` and ``high``: the realisable ends. ``probe``: values to try beside the borders' (of what
    is no number, all values)."""

    kind: str
    low: str | None = None
    high: str | None = None
    probe: tuple[str, ...] = ()

    @property
    def numeric(self) -> bool:
        return self.kind.startswith(("int", "bigint", "decimal"))


@dataclass(frozen=True)
class Domain:
    """``coherence``: relations of two inputs that hold for every case that can occur. ``order``: inputs to pin when the
    grid is too large, the least telling first. ``favours``: whom a larger output favours."""

    inputs: dict[str, Input]
    coherence: tuple[tuple[str, str, str], ...] = ()
    order: tuple[str, ...] = ()
    favours: dict[str, str] = field(default_factory=dict)

    def coherent(self) -> Column:
        return F.expr(" and ".join(f"({a} {op} {b})" for a, op, b in self.coherence) or "true")


@dataclass(frozen=True)
class Border:
    variable: str
    operator: str
    literal: str
    label: str
    output: str


def borders(scope: Scope, inputs: dict[str, Input]) -> list[Border]:
    """Every different comparison of an input with a number in the conditions of a scope, in their order."""
    out: dict[tuple[str, str, str], Border] = {}
    for d in scope.definitions:
        for m in _BORDER.finditer(d.when):
            if m[1] in inputs:
                out.setdefault((m[1], m[2], m[3]), Border(m[1], m[2], m[3], d.label or d.variable, d.variable))
    return [*out.values()]


def step_of(literal: str) -> Decimal:
    return Decimal(1).scaleb(Decimal(literal).as_tuple().exponent) if "." in literal else Decimal(1)


def probe_values(domain: Domain, found: list[Border]) -> dict[str, list[str]]:
    """For each input the values of its axis, in ascending order, within its domain."""
    out = {}
    for name, i in domain.inputs.items():
        if i.kind == "boolean":
            out[name] = ["false", "true"]
        elif not i.numeric:
            out[name] = list(i.probe) or [x for x in (i.low, i.high) if x is not None]
        else:
            near = [Decimal(b.literal) + k * step_of(b.literal) for b in found if b.variable == name for k in (-1, 0, 1)]
            near += map(Decimal, i.probe or [x for x in (i.low, i.high) if x is not None])
            out[name] = [str(v) for v in sorted({*near}) if (i.low is None or v >= Decimal(i.low)) and (i.high is None or v <= Decimal(i.high))]
        if not out[name]:
            raise ValueError(f"nothing says what values {name} may take")
    return out


def fitted(values: dict[str, list[str]], order: tuple[str, ...], cap: int) -> tuple[dict[str, list[str]], dict[str, str]]:
    """The axes whose product is within the cap, and the inputs that had to be pinned to their first value for it."""
    live, pinned = dict(values), {}
    size = lambda: prod(map(len, live.values()))
    for name in order:
        if size() <= cap:
            break
        if len(live.get(name, ())) > 1:
            pinned[name] = live.pop(name)[0]
    if size() > cap:
        raise ValueError(f"{size()} cells are more than {cap}, whatever is pinned")
    return live, pinned


def surface(spark: SparkSession, scope: Scope, domain: Domain, cap: int = 640) -> DataFrame:
    """The coherent cells: the inputs, ordinal (their place in the product), the scope's columns, err, signature, region
    (from 1, the largest first, of equal ones the first met) and size (the region's)."""
    live, pinned = fitted(probe_values(domain, borders(scope, domain.inputs)), domain.order, cap)
    names = sorted(live)
    rows = [(k, *map(str, combo)) for k, combo in enumerate(product(*(live[n] for n in names)))]
    grid = spark.createDataFrame(rows, ", ".join(["ordinal long", *(f"`{n}` string" for n in names)]))
    grid = grid.select("ordinal", *(F.col(n).cast(domain.inputs[n].kind).alias(n) for n in names), *(F.lit(v).cast(domain.inputs[n].kind).alias(n) for n, v in pinned.items()))
    done = cells(scope, grid, domain.coherent())
    by_size = done.groupBy("signature").agg(F.count("*").alias("size"), F.min("ordinal").alias("first"))
    ranked = by_size.withColumn("region", F.row_number().over(Window.orderBy(F.desc("size"), "first"))).drop("first")  # at most ``cap`` rows
    return done.join(F.broadcast(ranked), "signature")


def _axes(scope: Scope, domain: Domain, cap: int) -> dict[str, list[str]]:
    return fitted(probe_values(domain, borders(scope, domain.inputs)), domain.order, cap)[0]


def locate(cases: DataFrame, scope: Scope, domain: Domain, cap: int = 640) -> DataFrame:
    """The cases with region, ordinal and distance of their nearest cell; of equally near ones, of the first region and
    then of the first cell. Null where no cell agrees on the axes that are no numbers, or a fact is null. Inputs that the
    table lacks are no axes."""
    axes = {n: v for n, v in _axes(scope, domain, cap).items() if n in cases.columns}
    ticks = {n: sorted({Decimal(v).quantize(Decimal("0.000001"), ROUND_HALF_UP) for v in axes[n]}) for n in sorted(axes) if domain.inputs[n].numeric}
    other = [n for n in sorted(axes) if not domain.inputs[n].numeric]
    on_map = surface(cases.sparkSession, scope, domain, cap).select(*(F.col(n).cast(EXACT).alias(n) for n in ticks), *(F.col(n).cast("string").alias(f"_o_{n}") for n in other), F.struct("region", "ordinal").alias("_place"))
    # The first place for each way of lying at or between the ticks: a cell is nearest at its ticks and midway to the next.
    first, at = on_map, [*(f"_o_{n}" for n in other), *(f"_s_{n}" for n in ticks)]
    for n, values in ticks.items():
        own = _stretch(F.col(n), values)
        first = first.withColumn(f"_s_{n}", F.explode(F.array(own - 1, own, own + 1)))
    first = first.groupBy(F.lit(True).alias("_known"), *at).agg(F.min("_place").alias("_place"))
    x = {n: F.col(n).cast(EXACT) for n in ticks}
    known = F.lit(True)
    for n in (*ticks, *other):
        known = known & F.col(n).isNotNull()
    rows = cases.withColumns({"_known": known, **{f"_o_{n}": F.col(n).cast("string") for n in other}, **{f"_s_{n}": _stretch(x[n], values) for n, values in ticks.items()}})
    rows = rows.join(F.broadcast(first), ["_known", *at], "left")
    # All cells, in one row bounded by the cap, go to those cases only whose snapped cells are incoherent.
    same = [F.col(f"_o_{n}") for n in other]
    every = on_map.agg(F.collect_list(F.struct(*same, *ticks, "_place")).alias("_all")).withColumn("_lost", F.lit(True))
    rows = rows.withColumn("_lost", F.when(F.col("_known") & F.col("_place").isNull(), True)).join(F.broadcast(every), "_lost", "left")
    alike = F.filter("_all", lambda c: reduce(lambda t, n: t & (c[f"_o_{n}"] == F.col(f"_o_{n}")), other, F.lit(True)))
    tried = F.array_min(F.transform(alike, lambda c: F.struct(sum((F.abs(c[n] - x[n]) for n in ticks), F.lit(0).cast(EXACT)).alias("d"), c["_place"].alias("place"))))
    rows = rows.withColumn("_tried", F.when(F.col("_lost"), tried))
    place = F.coalesce("_place", "_tried.place")
    total = sum((_apart(x[n], values) for n, values in ticks.items()), F.lit(0).cast(EXACT))
    distance = F.when(F.col("_place").isNotNull(), total).otherwise(F.col("_tried.d"))
    return rows.select(*cases.columns, place["region"].alias("region"), place["ordinal"].alias("ordinal"), distance.alias("distance"))


def _stretch(x: Column, ticks: list[Decimal]) -> Column:
    """Twice the place of the nearest of ascending ticks, from 0; an odd number is midway between two."""
    out = None
    for k, both in enumerate(a + b for a, b in zip(ticks, ticks[1:])):
        out = (F.when if out is None else out.when)(x + x < F.lit(both), 2 * k).when(x + x == F.lit(both), 2 * k + 1)
    last = F.lit(2 * len(ticks) - 2)
    return last if out is None else out.otherwise(last)


def _apart(x: Column, ticks: list[Decimal]) -> Column:
    """How far the nearest tick is."""
    each = [F.abs(F.lit(t).cast(EXACT) - x) for t in ticks]
    return F.least(*each) if len(each) > 1 else each[0]


def populate(cases: DataFrame, scope: Scope, domain: Domain, cap: int = 640) -> DataFrame:
    """The cells that occur, with population: how many cases of a table lie nearest to each. One shuffle of a row for
    each cell and task."""
    counts = locate(cases, scope, domain, cap).where("ordinal is not null").groupBy("ordinal").agg(F.count("*").alias("population"))
    return counts.join(F.broadcast(surface(cases.sparkSession, scope, domain, cap)), "ordinal")


def border_population(cases: DataFrame, scope: Scope, domain: Domain) -> DataFrame:
    """For each border: how many cases lie below, at and above it. One pass, one row a task."""
    found = [b for b in borders(scope, domain.inputs) if b.variable in cases.columns]
    count = lambda c: F.count(F.when(c, 1))
    sums = [F.struct(*(count(test).alias(n) for n, test in (("below", F.col(b.variable) < Decimal(b.literal)), ("at", F.col(b.variable) == Decimal(b.literal)), ("above", F.col(b.variable) > Decimal(b.literal))))).alias(f"b{k}") for k, b in enumerate(found)]
    one = cases.agg(*sums)
    said = F.array(*(F.struct(F.lit(b.variable).alias("variable"), F.lit(b.operator).alias("operator"), F.lit(b.literal).alias("literal"), F.lit(b.label).alias("label"), F.col(f"b{k}").alias("n")) for k, b in enumerate(found)))
    return one.select(F.explode(said).alias("b")).select("b.variable", "b.operator", "b.literal", "b.label", "b.n.below", "b.n.at", "b.n.above")


def moved(cases: DataFrame, scope: Scope, changed: Scope, domain: Domain, output: str, cap: int = 640) -> DataFrame:
    """What a change of the rules moves on the cells that occur: the inputs, kind, delta and population. Both maps are of
    the unchanged scope's grid."""
    there = populate(cases, scope, domain, cap)
    inputs = [n for n in domain.inputs if n in there.columns]
    now = cells(changed, there.select(*inputs))
    return diff(there, now, inputs, output).join(there.select(*inputs, "population"), inputs)


def holding_impact(cases: DataFrame, scope: Scope, domain: Domain, holding: Predicate, cap: int = 640) -> DataFrame:
    """For each region that a proposed holding catches cells of: region, caught, hit (of cells that would move for the
    counterparty, or nobody knows for whom), same, against, size, and population, which counts only where every cell of
    the region is hit, as elsewhere nobody knows which of its cases are."""
    on_map = surface(cases.sparkSession, scope, domain, cap)
    caught = on_map.where(F.col("err").isNull() & holding.fires(on_map.schema)).withColumn("movement", holding.movement(on_map.schema, domain.favours))
    n = lambda *kinds: F.count(F.when(F.col("movement").isin(*kinds), 1))
    by_region = caught.groupBy("region", "size").agg(F.count("*").alias("caught"), n("for", "differs").alias("hit"), n("same").alias("same"), n("against").alias("against"))
    people = locate(cases, scope, domain, cap).groupBy("region").agg(F.count("*").alias("people"))
    out = people.join(F.broadcast(by_region), "region", "right")
    return out.select("region", "caught", "hit", "same", "against", "size", F.when(F.col("hit") == F.col("size"), F.coalesce("people", F.lit(0))).otherwise(0).cast("bigint").alias("population"))

