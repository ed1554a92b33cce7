"""Scopes that call scopes: for one set of inputs, or for each element of a list.

A call for one set of inputs is inlined. The callee's variables become the caller's, under the name of the call, and its
inputs the expressions that the caller gives; so a call costs what its definitions cost, at any depth, and Catalyst sees
one projection. The callee's failures and decisions come before those of what uses it, and its decisions belong to the
caller's signature: two callers of one branch that called by different branches are different cases. A call with a
condition is made only where it holds, and neither fails nor decides elsewhere.

A call for each element runs on a table with a row for each element. Elements get their place by a window, the callee
is applied to them, and one aggregation by the caller's key brings back the first failure, the decisions in order and
whatever sums the caller asks for. So a list never has to fit a row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.plans.rules import Definition, Scope, apply, decided, governing

#: Between the name of a call and the callee's variable.
IN = "__"
#: Ways that the elements of one key are dealt out before lists are cut.
DEALT = 16
_TOKEN = re.compile(r"'(?:[^']|'')*'|\"[^\"]*\"|[A-Za-z_]\w*(?:\.[A-Za-z_]\w*)*|.", re.S)


def rewritten(text: str, names: dict[str, str]) -> str:
    """An expression with other names. ``call.variable`` may be named as a whole; strings and functions stay."""
    out, tokens = [], _TOKEN.findall(text)
    for k, t in enumerate(tokens):
        after = "".join(tokens[k + 1 :]).lstrip()[:1]
        if not (t[0].isalpha() or t[0] == "_") or after == "(" and "." not in t:
            out.append(t)
        elif t in names:
            out.append(names[t])
        else:
            head, dot, rest = t.partition(".")
            out.append(names[head] + dot + rest if head in names else t)
    return "".join(out)


@dataclass(frozen=True)
class Call:
    """``scope`` called as ``name``, with an expression of the caller for each of its inputs, where ``when`` holds."""

    name: str
    scope: Scope
    inputs: dict[str, str] = field(default_factory=dict)
    when: str = "true"


def _inlined(call: Call, names: dict[str, str]) -> Scope:
    """The callee in the caller's words; ``names``: how results of other calls are written there."""
    own = {v: f"{call.name}{IN}{v}" for v in call.scope.order}
    given = {x: f"({rewritten(e, names)})" for x, e in call.inputs.items()}
    both, when = own | given, rewritten(call.when, names)
    always = when.strip() == "true"
    under = lambda condition: condition if always else f"({when}) and ({condition})"
    definitions = []
    for v in call.scope.order:
        base = v in call.scope.conditions
        if base:
            definitions.append(Definition(own[v], "false", under("true"), "(base)"))
        for d in call.scope.definitions:
            if d.variable == v:
                above = d.exception_to or ("(base)" if base else "")
                definitions.append(Definition(own[v], rewritten(d.value, both), under(rewritten(d.when, both)), d.label, above))
    return Scope(
        call.name,
        {own[v]: call.scope.types[v] for v in call.scope.order},
        tuple(definitions),
        tuple(rewritten(t, both) if always else f"not ({when}) or ({rewritten(t, both)})" for t in call.scope.assertions),
        optional=frozenset(own[v] for v in call.scope.optional),
        needed={own[v]: rewritten(call.scope.needed.get(v, "true"), both) if always else f"({when}) and ({rewritten(call.scope.needed.get(v, 'true'), both)})" for v in call.scope.order},
    )


def compose(caller: Scope, *calls: Call) -> Scope:
    """The caller with its calls inlined; ``call.variable`` in its expressions, and in the inputs of other calls, is a
    callee's result. Calls of calls are composed first: ``Call(name, compose(...))``."""
    names = {f"{c.name}.{v}": f"{c.name}{IN}{v}" for c in calls for v in c.scope.order}
    parts = [_inlined(c, names) for c in calls]
    own = tuple(replace(d, value=rewritten(d.value, names), when=rewritten(d.when, names)) for d in caller.definitions)
    types, needed = dict(caller.types), {v: rewritten(e, names) for v, e in caller.needed.items()}
    for p in parts:
        types |= p.types
        needed |= p.needed
    return replace(
        caller,
        types=types,
        definitions=(*(d for p in parts for d in p.definitions), *own),
        assertions=(*(t for p in parts for t in p.assertions), *(rewritten(t, names) for t in caller.assertions)),
        optional=caller.optional.union(*(p.optional for p in parts)),
        needed=needed,
    )


def outputs(scope: Scope) -> list[str]:
    """The caller's own variables: what calls define is no output of it."""
    return [v for v in scope.order if IN not in v]


def run(scope: Scope, facts: DataFrame, *called: str) -> DataFrame:
    """The facts with the scope's own variables, err and governing, at every depth. ``called``: names of calls for each
    element, whose columns ``call_each`` has put among the facts."""
    failed = F.coalesce(*(F.col(f"{c}{IN}err") for c in called)) if called else None
    out = apply(scope, facts, True, failed)
    for c in reversed(called):
        out = out.withColumn("governing", F.concat(F.coalesce(f"{c}{IN}governing", F.array().cast("array<struct<variable:string,branch:string>>")), "governing"))
    dotted = F.transform("governing", lambda g: F.struct(*(F.replace(g[x], F.lit(IN), F.lit(".")).alias(x) for x in ("variable", "branch"))))
    return out.withColumn("governing", dotted).drop(*(v for v in scope.order if IN in v), *(f"{c}{IN}{x}" for c in called for x in ("err", "governing")))


def call_each(name: str, scope: Scope, elements: DataFrame, key: list[str], order: list[str], totals: dict[str, Column], place: str = "", most: int | None = None) -> DataFrame:
    """A row for each key: ``name__err`` (the first element's that fails), ``name__governing`` (an element's decisions,
    each way that they were taken once, in the order of its first element) and ``totals`` (sums over the
    callee's variables, null after a failure). ``place``: the callee's input that is an element's place, from 1, in ``order``,
    which has to tell all elements apart. ``most``: a place that the callee refuses to go beyond, if there is one: nothing
    after the first such element can matter, so that no more of a list is sorted."""
    if place:
        if most:  # dealt out before its lists are cut, so that no task sorts more than its share, whatever a file's parts hold
            elements = elements.repartition(*key, F.pmod(F.xxhash64(*order), F.lit(DEALT)))
        elements = elements.withColumn(place, F.row_number().over(Window.partitionBy(*key).orderBy(*order)))
        if most:
            elements = elements.where(F.col(place) <= most + 1)
    at = F.col(place) if place else _in_one(elements, order)
    done = decided(scope, elements)
    # One way of deciding, or of failing, is one row, however many elements took it. Its key is the branches as they are
    # and its place a number, so that rows are hashed as they come and not sorted.
    branches = [F.col(f"_{v}.branch").alias(f"_b_{v}") for v in scope.order]
    ways = done.groupBy(*key, F.col("err").alias("_err"), *branches).agg(F.min(at).alias("at"), *(c.alias(f"_{n}") for n, c in totals.items()))
    dotted = lambda x: F.replace(x, F.lit(IN), F.lit("."))
    said = F.transform(governing(scope, lambda v: F.col(f"_b_{v}")), lambda g: F.struct(dotted(g["variable"]).alias("variable"), dotted(g["branch"]).alias("branch")))
    failed = F.when(F.col("_err").isNotNull(), F.struct("at", F.col("_err").alias("err")))
    ways = ways.select(*key, "at", failed.alias("failed"), said.alias("governing"), *(f"_{n}" for n in totals))
    ordered = F.array_sort(F.collect_list(F.struct("at", "governing")))
    named = F.transform(F.flatten(F.transform(ordered, lambda w: w["governing"])), lambda g: F.struct(F.concat(F.lit(f"{name}{IN}"), g["variable"]).alias("variable"), g["branch"].alias("branch")))
    out = ways.groupBy(*key).agg(F.min("failed")["err"].alias(f"{name}{IN}err"), F.array_distinct(named).alias(f"{name}{IN}governing"), *(F.sum(f"_{n}").alias(n) for n in totals))
    return out.withColumns({n: F.when(F.col(f"{name}{IN}err").isNull(), F.col(n)) for n in totals})


def _in_one(rows: DataFrame, order: list[str]) -> Column:
    """The order as one number where whole numbers fit 38 digits, else as a struct."""
    digits = {"tinyint": 3, "smallint": 5, "int": 10, "bigint": 20}
    kinds = [rows.schema[c].dataType.simpleString() for c in order]
    if not all(k in digits for k in kinds) or sum(digits[k] for k in kinds) > 38:
        return F.struct(*order)
    least = {"tinyint": 128, "smallint": 32768, "int": 1 << 31, "bigint": 1 << 63}
    out = F.lit(0).cast("decimal(38,0)")
    for c, k in zip(order, kinds):  # nulls first, as in a struct
        out = out * F.lit(Decimal(10 ** digits[k])) + F.coalesce(F.col(c).cast("decimal(20,0)") + F.lit(Decimal(least[k] + 1)), F.lit(Decimal(0)))
        out = out.cast("decimal(38,0)")
    return out


def signature() -> Column:
    """Of rows of ``run``: the failure, or what governed at every depth, in one order."""
    said = F.transform("governing", lambda g: F.concat_ws("=", g["variable"], g["branch"]))
    return F.coalesce("err", F.concat_ws(";", F.array_sort(said)))
