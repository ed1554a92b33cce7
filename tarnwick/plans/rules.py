"""Rules as columns: prioritised, conditional definitions compile to Catalyst expressions.

A scope is a list of definitions over input columns. Conditions and values are SQL expressions, so that a scope is
plain data: it can be listed, compared, changed and compiled anew. Every row gets the value of each variable, ``err``
(the first failure in evaluation order, or null) and, if asked for, ``governing``: which definition gave each value.

Outcomes are values, never exceptions: one bad row can't end a job. The outcomes are Conflict (two definitions of equal
rank hold), NoApplicableRule (none does) and AssertionFailed.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFLICT, SILENT, REFUSED = "Conflict", "NoApplicableRule", "AssertionFailed"


@dataclass(frozen=True)
class Definition:
    """``variable`` is ``value`` where ``when`` holds. Definitions of one ``label`` are of one rank; those that are an
    ``exception_to`` a label go before it. A condition isn't inherited from the label it is an exception to."""

    variable: str
    value: str
    when: str = "true"
    label: str = ""
    exception_to: str = ""


@dataclass(frozen=True)
class Scope:
    """``types``: SQL types of the variables. ``outputs``: those that must have a value. ``conditions``: variables that
    are false unless a definition says otherwise. ``context``: inputs that a null leaves to the scope's definitions.
    ``needed``: where a variable must have a value, if not everywhere. ``failures``: code and condition on inputs of what
    can't be evaluated, such as a date without rounding that doesn't exist."""

    name: str
    types: dict[str, str]
    definitions: tuple[Definition, ...]
    assertions: tuple[str, ...] = ()
    conditions: frozenset[str] = frozenset()
    context: frozenset[str] = frozenset()
    optional: frozenset[str] = frozenset()
    needed: dict[str, str] = field(default_factory=dict)
    failures: tuple[tuple[str, str], ...] = ()
    order: tuple[str, ...] = field(default=(), compare=False)

    def __post_init__(self):
        object.__setattr__(self, "order", tuple(_in_order(self)))

    def labels(self, variable: str) -> dict[str, list[Definition]]:
        """The definitions of a variable by label, in order; unlabelled ones share a label with those of equal rank."""
        out: dict[str, list[Definition]] = {}
        if variable in self.conditions:
            out["(base)"] = [Definition(variable, "false", label="(base)")]
        for d in self.definitions:
            if d.variable == variable:
                above = d.exception_to or ("(base)" if variable in self.conditions else "")
                out.setdefault(d.label or f"(of {above})", []).append(replace(d, exception_to=above))
        return out

    def roots(self, variable: str) -> list[str]:
        """The labels that are an exception to none; two of them can conflict."""
        return [label for label, ds in self.labels(variable).items() if not ds[0].exception_to]

    def without(self, label: str) -> Scope:
        """The scope with a label's definitions struck out; exceptions to it move up to what it was an exception to."""
        gone = {d.label: d.exception_to for d in self.definitions if d.label == label}
        kept = (replace(d, exception_to=gone[label]) if d.exception_to == label and label in gone else d for d in self.definitions if d.label != label)
        return replace(self, definitions=tuple(kept))


def _in_order(scope: Scope) -> list[str]:
    """Variables after those that they mention; checks labels and cycles."""
    names = list(dict.fromkeys(d.variable for d in scope.definitions))
    for v in names:
        labels = scope.labels(v)
        for label, ds in labels.items():
            if len({d.exception_to for d in ds}) > 1:
                raise ValueError(f"{scope.name}.{v}: definitions of label {label!r} are exceptions to different labels")
            seen, up = {label}, ds[0].exception_to
            while up:
                if up not in labels:
                    raise ValueError(f"{scope.name}.{v}: {up!r} is no label")
                if up in seen:
                    raise ValueError(f"{scope.name}.{v}: exceptions go round through {up!r}")
                seen.add(up)
                up = labels[up][0].exception_to
    needs = {v: {w for d in scope.definitions if d.variable == v for w in re.findall(r"[A-Za-z_]\w*", f"{d.when} {d.value}") if w in names and w != v} for v in names}
    out: list[str] = []
    while len(out) < len(names):
        ready = [v for v in names if v not in out and needs[v] <= {*out}]
        if not ready:
            raise ValueError(f"{scope.name}: {sorted({*names} - {*out})} depend on each other")
        out.append(ready[0])
    return out


def _struct(kind: str, err: Column, branch: Column, value: Column) -> Column:
    return F.struct(err.cast("string").alias("err"), branch.cast("string").alias("branch"), value.cast(kind).alias("value"))


def _of_rank(definitions: list[Definition], kind: str) -> Column:
    """What definitions of one label say, null if none holds. Ones with the same value as written can't conflict."""
    ways: dict[str, list[Definition]] = defaultdict(list)
    for d in definitions:
        ways[" ".join(d.value.split())].append(d)
    holds = {value: F.coalesce(F.expr(" or ".join(f"({d.when})" for d in ds)), F.lit(False)) for value, ds in ways.items()}
    out = None
    if len(ways) > 1:
        out = F.when(sum((h.cast("int") for h in holds.values()), F.lit(0)) > 1, _struct(kind, F.lit(CONFLICT), F.lit(None), F.lit(None)))
    for value, ds in ways.items():
        this = _struct(kind, F.lit(None), F.lit(ds[0].label or ds[0].variable), F.expr(value))
        out = F.when(holds[value], this) if out is None else out.when(holds[value], this)
    return out


def _one_of(children: list[Column], kind: str) -> Column:
    """Of exceptions of equal rank: the one that speaks; a failure if one fails, a conflict if two speak."""
    if len(children) == 1:
        return children[0]
    none = F.lit(None).cast(f"struct<err:string,branch:string,value:{kind}>")
    clash = _struct(kind, F.lit(CONFLICT), F.lit(None), F.lit(None))
    return F.aggregate(F.array(*children), none, lambda a, x: F.when(x.isNull() | a["err"].isNotNull(), a).when(a.isNull() | x["err"].isNotNull(), x).otherwise(clash))


def _label(scope: Scope, variable: str, label: str) -> Column:
    labels, kind = scope.labels(variable), scope.types[variable]
    own = _of_rank(labels[label], kind)
    above = [_label(scope, variable, name) for name, ds in labels.items() if ds[0].exception_to == label]
    return F.coalesce(_one_of(above, kind), own) if above else own


def apply(scope: Scope, facts: DataFrame, trace: bool = False, given_err: Column | None = None) -> DataFrame:
    """The facts with a column for each variable, err and, if asked for, governing. No shuffle, no Python.
    ``given_err``: a failure of what was called for these facts, after that of their own assertions."""
    out = decided(scope, facts, given_err)
    if trace:
        out = out.withColumn("governing", governing(scope, lambda v: F.col(f"_{v}.branch")))
    return out.drop(*(f"_{v}" for v in scope.order))


def governing(scope: Scope, branch: Callable[[str], Column]) -> Column:
    """The decisions, in order, of the branches of the variables."""
    traced = (F.struct(F.lit(v).alias("variable"), branch(v).alias("branch")) for v in scope.order)
    return F.filter(F.array(*traced), lambda t: t["branch"].isNotNull())


def decided(scope: Scope, facts: DataFrame, given_err: Column | None = None) -> DataFrame:
    """The facts with each variable, err and, as ``_variable``, a struct with the branch that gave it."""
    err, out = F.lit(None).cast("string"), facts
    for n, test in enumerate(scope.assertions):
        names = set(re.findall(r"[A-Za-z_]\w*", test))
        if not names & {*scope.order}:  # on inputs only: before all else
            err = F.coalesce(err, F.when(~F.coalesce(F.expr(test), F.lit(False)), F.lit(REFUSED)))
    for code, test in scope.failures:
        err = F.coalesce(err, F.when(F.expr(test), F.lit(code)))
    out = out.withColumn("err", err if given_err is None else F.coalesce(err, given_err))
    for v in scope.order:
        kind = scope.types[v]
        result = _one_of([_label(scope, v, label) for label in scope.roots(v)], kind)
        if v in scope.context and v in facts.columns:
            result = F.coalesce(F.when(F.col(v).isNotNull(), _struct(kind, F.lit(None), F.lit("(given)"), F.col(v))), result)
        out = out.withColumn(f"_{v}", result)
        missing = F.lit(None) if v in scope.optional else F.when(F.col(f"_{v}").isNull() & F.expr(scope.needed.get(v, "true")), F.lit(SILENT))
        out = out.withColumns({v: F.col(f"_{v}.value"), "err": F.coalesce("err", F.col(f"_{v}.err"), missing)})
    for test in scope.assertions:
        if set(re.findall(r"[A-Za-z_]\w*", test)) & {*scope.order}:
            out = out.withColumn("err", F.coalesce("err", F.when(~F.coalesce(F.expr(test), F.lit(False)), F.lit(REFUSED))))
    return out


def signature(scope: Scope) -> Column:
    """What tells regions of a decision surface apart: the failure, or the definitions that governed."""
    return F.coalesce("err", F.concat_ws(";", F.transform("governing", lambda g: F.concat_ws("=", g["variable"], g["branch"]))))
