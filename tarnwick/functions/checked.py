"""Values that carry their error: a struct of ``value`` and ``err``, one of nine codes or null.

Operands are all evaluated, and the first error in their order wins; only then may the operation itself fail. So a row
with a division by zero says so, and no job ends. A test chooses one branch, and the other's error doesn't count. Inputs
that are null have no value. Numbers: ``int`` is a bigint, ``rat`` a decimal(18,6), ``money`` a decimal(18,2); results
round half away from zero to these; a duration has years, months and days.

Operations bind their operands once, so that an expression grows with its operators and not with its depth.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions import scalars

#: The codes.
ASSERTION, NO_VALUE, CONFLICT, BY_ZERO, EMPTY, LENGTHS, UNCOMPARABLE, DATE, IMPOSSIBLE = CODES = (
    "AssertionFailed", "NoValue", "Conflict", "DivisionByZero", "ListEmpty", "NotSameLength", "UncomparableValues", "DateError", "Impossible",
)
KINDS = {"int": "bigint", "rat": "decimal(18,6)", "money": "decimal(18,2)", "bool": "boolean", "date": "date", "duration": "struct<years:int,months:int,days:int>", "text": "string"}
NUMBERS = ("int", "rat", "money")


@dataclass(frozen=True)
class Checked:
    """``kind``: a name of KINDS, ``list of`` one, ``function`` or a Spark type. ``leaf``: it may be written out twice. ``step`` of
    ``operands``: how it comes about, for ``staged``."""

    kind: str
    both: Column
    leaf: bool = False
    operands: tuple[Checked, ...] = ()
    step: Callable[..., Column] | None = None

    @property
    def value(self) -> Column:
        return self.both["value"]

    @property
    def err(self) -> Column:
        return self.both["err"]


def spark_type(kind: str) -> str:
    return f"array<{spark_type(kind[8:])}>" if kind.startswith("list of ") else KINDS.get(kind, "string" if kind == "function" else kind)


def _both(kind: str, err: Column, value: Column) -> Column:
    err = err.cast("string")
    return F.struct(F.when(err.isNull(), value).cast(spark_type(kind)).alias("value"), err.alias("err"))


def given(column: Column | str, kind: str) -> Checked:
    """An input."""
    c = F.col(column) if isinstance(column, str) else column
    return Checked(kind, _both(kind, F.when(c.isNull(), F.lit(NO_VALUE)), c), True)


def literal(value, kind: str) -> Checked:
    return Checked(kind, _both(kind, F.lit(None), F.lit(value)), True)


def duration(years: int | Column = 0, months: int | Column = 0, days: int | Column = 0) -> Checked:
    parts = ((F.lit(x) if isinstance(x, int) else x).cast("int").alias(n) for x, n in ((years, "years"), (months, "months"), (days, "days")))
    return Checked("duration", _both("duration", F.lit(None), F.struct(*parts)), True)


def failing(code: str, kind: str) -> Checked:
    return Checked(kind, _both(kind, F.lit(code), F.lit(None)), True)


def bound(operands: tuple[Checked, ...], step: Callable[..., Column], kind: str) -> Checked:
    """``step`` of the operands, each written out once."""
    if all(o.leaf for o in operands):
        return Checked(kind, step(*operands), False, operands, step)
    once = F.array(F.struct(*(o.both.alias(f"o{k}") for k, o in enumerate(operands))))
    done = F.transform(once, lambda s: step(*(Checked(o.kind, s[f"o{k}"], True) for k, o in enumerate(operands))))
    return Checked(kind, F.get(done, F.lit(0)), False, operands, step)


def staged(facts: DataFrame, results: dict[str, Checked]) -> tuple[DataFrame, dict[str, Checked]]:
    """The facts with a column for every operation that the results are made of, each after its operands, and the results
    in terms of these. What ``bound`` writes as lambdas in one expression, which run uncompiled, becomes projections."""
    levels: list[dict[int, Checked]] = []
    depth: dict[int, int] = {}

    def place(c: Checked) -> int:
        if c.step is None:
            return -1
        if id(c) not in depth:
            depth[id(c)] = at = 1 + max((place(o) for o in c.operands), default=-1)
            while len(levels) <= at:
                levels.append({})
            levels[at][id(c)] = c
        return depth[id(c)]

    for c in results.values():
        place(c)
    names = {n: f"_c{k}" for k, n in enumerate(depth)}
    named = lambda c: Checked(c.kind, F.col(names[id(c)]), True) if id(c) in names else c
    for level in levels:
        facts = facts.withColumns({names[n]: c.step(*map(named, c.operands)) for n, c in level.items()})
    return facts, {n: named(c) for n, c in results.items()}


def operation(kind: str, value: Callable[..., Column], *operands: Checked, fails: Callable[..., Column] | None = None) -> Checked:
    """``value`` and ``fails`` (a code or null) take the operands' values."""

    def step(*os: Checked) -> Column:
        values = [o.value for o in os]
        own = [fails(*values)] if fails else []
        return _both(kind, F.coalesce(*(o.err for o in os), *own, F.lit(None).cast("string")), value(*values))

    return bound(operands, step, kind)


def _kinds(a: Checked, b: Checked, allowed: dict[tuple[str, str], str]) -> str:
    if (a.kind, b.kind) not in allowed:
        raise TypeError(f"no such operation on {a.kind} and {b.kind}: kinds are never cast by themselves")
    return allowed[a.kind, b.kind]


_SAME = {(k, k): k for k in (*NUMBERS, "duration")}


def _parts(step: Callable[..., Column], *ds: Column) -> Column:
    return F.struct(*(step(*(d[n] for d in ds)).alias(n) for n in ("years", "months", "days")))


def _months(d: Column) -> Column:
    return d["years"] * 12 + d["months"]


def _moved(date: Column, d: Column, rounding: str) -> Column:
    return scalars.add_period(date, _months(d), d["days"], rounding)


def plus(a: Checked, b: Checked, rounding: str = "abort") -> Checked:
    """A date and a duration: months first, with one rounding; none (``abort``) is an error where the day doesn't exist."""
    kind = _kinds(a, b, _SAME | {("date", "duration"): "date"})
    if kind == "date":
        return operation("date", lambda x, d: _moved(x, d, rounding), a, b, fails=lambda x, d: F.when(_moved(x, d, rounding).isNull(), F.lit(DATE)))
    return operation(kind, lambda x, y: _parts(lambda p, q: p + q, x, y) if kind == "duration" else x + y, a, b)


def minus(a: Checked, b: Checked, rounding: str = "abort") -> Checked:
    """Two dates: the days between them."""
    kind = _kinds(a, b, _SAME | {("date", "duration"): "date", ("date", "date"): "duration"})
    if kind == "date":
        return plus(a, negative(b), rounding)
    if a.kind == "date":
        return operation("duration", lambda x, y: F.struct(F.lit(0).alias("years"), F.lit(0).alias("months"), F.date_diff(x, y).alias("days")), a, b)
    return operation(kind, lambda x, y: _parts(lambda p, q: p - q, x, y) if kind == "duration" else x - y, a, b)


def negative(a: Checked) -> Checked:
    _kinds(a, a, _SAME)
    return operation(a.kind, lambda x: _parts(lambda p: -p, x) if a.kind == "duration" else -x, a)


def times(a: Checked, b: Checked) -> Checked:
    kind = _kinds(a, b, {("int", "int"): "int", ("rat", "rat"): "rat", ("money", "int"): "money", ("money", "rat"): "money", ("duration", "int"): "duration"})
    if kind == "duration":
        return operation(kind, lambda d, n: _parts(lambda p: p * n, d), a, b)
    return operation(kind, lambda x, y: F.round(x * y.cast("decimal(18,6)"), 2) if kind == "money" else x * y, a, b)


def over(a: Checked, b: Checked) -> Checked:
    """Of durations: of those in days only, as others have no ratio."""
    kind = _kinds(a, b, {("int", "int"): "rat", ("rat", "rat"): "rat", ("money", "money"): "rat", ("money", "int"): "money", ("money", "rat"): "money", ("duration", "duration"): "rat"})
    if a.kind == "duration":
        vague = lambda x, y: (_months(x) != 0) | (_months(y) != 0)
        fails = lambda x, y: F.when(vague(x, y), F.lit(DATE)).when(y["days"] == 0, F.lit(BY_ZERO))
        return operation("rat", lambda x, y: F.try_divide(x["days"].cast("decimal(18,0)"), y["days"].cast("decimal(18,0)")), a, b, fails=fails)
    fails = lambda x, y: F.when(y == 0, F.lit(BY_ZERO))
    if kind == "money":
        return operation("money", lambda x, y: scalars.money_over(x, y.cast("decimal(18,6)")), a, b, fails=fails)
    return operation("rat", lambda x, y: F.try_divide(x.cast("decimal(18,6)"), y.cast("decimal(18,6)")), a, b, fails=fails)


def converted(a: Checked, kind: str) -> Checked:
    """A whole number of money rounds, that of a rational number cuts; all others are exact or round to the cent."""
    how = {("rat", "int"): lambda x: x.cast("bigint"), ("money", "int"): lambda x: F.round(x, 0), ("int", "rat"): lambda x: x, ("money", "rat"): lambda x: x, ("rat", "money"): lambda x: F.round(x, 2), ("int", "money"): lambda x: x}
    return operation(kind, how[a.kind, kind], a)


def rounded(a: Checked) -> Checked:
    """To the nearest unit."""
    return operation(a.kind, lambda x: F.round(x, 0), a)


def _units_differ(x: Column, y: Column) -> Column:
    """Durations compare in months if neither has days, in days if neither has months."""
    months, days = (_months(x) != 0) | (_months(y) != 0), (x["days"] != 0) | (y["days"] != 0)
    return (months | (x["years"] != 0) | (y["years"] != 0) | (x["months"] != 0) | (y["months"] != 0)) & days


def _length(d: Column) -> Column:
    return _months(d) * 1000 + d["days"]  # one of the two is 0 where lengths compare


_ORDER = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y, "=": lambda x, y: x == y, "<>": lambda x, y: x != y}


def compared(a: Checked, operator: str, b: Checked) -> Checked:
    """Functions don't compare; durations do in one unit only, but equal ones are equal in any. Lists go by their first
    difference, then by their length."""
    if a.kind != b.kind:
        raise TypeError(f"{a.kind} {operator} {b.kind}")
    if a.kind.endswith("function"):
        return operation("bool", lambda x, y: F.lit(None), a, b, fails=lambda x, y: F.lit(UNCOMPARABLE))
    if a.kind == "duration":
        same = lambda x, y: (x["years"] == y["years"]) & (x["months"] == y["months"]) & (x["days"] == y["days"])
        differ = (lambda x, y: _units_differ(x, y) & ~same(x, y)) if operator in ("=", "<>") else _units_differ
        value = lambda x, y: F.when(same(x, y), F.lit(operator in ("=", "<=", ">="))).otherwise(_ORDER[operator](_length(x), _length(y)))
        return operation("bool", value, a, b, fails=lambda x, y: F.when(differ(x, y), F.lit(DATE)))
    return operation("bool", _ORDER[operator], a, b)


def both(a: Checked, b: Checked) -> Checked:
    """Evaluates both, so that a false operand doesn't hide the other's error."""
    return operation("bool", lambda x, y: x & y, a, b)


def either(a: Checked, b: Checked) -> Checked:
    return operation("bool", lambda x, y: x | y, a, b)


def exactly_one(a: Checked, b: Checked) -> Checked:
    return operation("bool", lambda x, y: x != y, a, b)


def opposite(a: Checked) -> Checked:
    return operation("bool", lambda x: ~x, a)


def chosen(test: Checked, then: Checked, otherwise: Checked) -> Checked:
    """Only the branch that the test chooses is evaluated."""
    kind = _kinds(then, otherwise, {(then.kind, then.kind): then.kind})
    return bound((test, then, otherwise), lambda t, a, b: F.when(t.err.isNotNull(), _both(kind, t.err, F.lit(None))).when(t.value, a.both).otherwise(b.both), kind)


def matched(tag: Checked, cases: dict[str, Checked], every: tuple[str, ...], otherwise: Checked | None = None) -> Checked:
    """The branch of a tag. All of ``every`` need one, or a branch for the rest; a tag that is none of them is impossible."""
    if lacking := [c for c in every if c not in cases and otherwise is None]:
        raise TypeError(f"no branch for {lacking}")
    kind = next(iter(cases.values())).kind

    def step(t: Checked, *branches: Checked) -> Column:
        out = F.when(t.err.isNotNull(), _both(kind, t.err, F.lit(None))).when(~t.value.isin(*every), _both(kind, F.lit(IMPOSSIBLE), F.lit(None)))
        for name, b in zip(cases, branches):
            out = out.when(t.value == name, b.both)
        return out.otherwise(branches[len(cases)].both if otherwise else _both(kind, F.lit(IMPOSSIBLE), F.lit(None)))

    return bound((tag, *cases.values(), *([otherwise] if otherwise else [])), step, kind)


def asserting(test: Checked, then: Checked) -> Checked:
    return bound((test, then), lambda t, a: F.when(t.err.isNotNull(), _both(a.kind, t.err, F.lit(None))).when(~t.value, _both(a.kind, F.lit(ASSERTION), F.lit(None))).otherwise(a.both), then.kind)


def only_one(*definitions: tuple[Checked, Checked]) -> Checked:
    """Of definitions of equal rank (condition, value) the one that holds; a conflict if two do, no value if none does."""
    kind = definitions[0][1].kind

    def step(*os: Checked) -> Column:
        tests, values = os[::2], os[1::2]
        many = sum((t.value.cast("int") for t in tests), F.lit(0))
        out = F.when(F.coalesce(*(t.err for t in tests)).isNotNull(), _both(kind, F.coalesce(*(t.err for t in tests)), F.lit(None)))
        out = out.when(many > 1, _both(kind, F.lit(CONFLICT), F.lit(None)))
        for t, v in zip(tests, values):
            out = out.when(t.value, v.both)
        return out.otherwise(_both(kind, F.lit(NO_VALUE), F.lit(None)))

    return bound(tuple(x for d in definitions for x in d), step, kind)


def extreme(xs: Checked, largest: bool, default: Checked | None = None) -> Checked:
    """The largest or smallest element; without a default an empty list has none."""
    pick = F.array_max if largest else F.array_min
    kind = xs.kind.removeprefix("list of ")
    if default is None:
        return operation(kind, pick, xs, fails=lambda x: F.when(F.size(x) == 0, F.lit(EMPTY)))
    return chosen(operation("bool", lambda x: F.size(x) == 0, xs), default, operation(kind, pick, xs))


def each(xs: Checked, step: Callable[[Checked], Checked]) -> Checked:
    """A checked step of every element; the first element that fails is the list's error."""
    inner = xs.kind.removeprefix("list of ")
    kind = step(Checked(inner, F.struct(F.lit(None).cast(spark_type(inner)).alias("value"), F.lit(None).cast("string").alias("err")), True)).kind

    def all_of(x: Checked) -> Column:
        done = F.transform(x.value, lambda e: step(Checked(inner, F.struct(e.alias("value"), F.lit(None).cast("string").alias("err")), True)).both)
        once = F.transform(F.array(done), lambda d: _both(f"list of {kind}", F.coalesce(x.err, F.get(F.filter(d, lambda e: e["err"].isNotNull()), F.lit(0))["err"]), F.transform(d, lambda e: e["value"])))
        return F.when(x.err.isNotNull(), _both(f"list of {kind}", x.err, F.lit(None))).otherwise(F.get(once, F.lit(0)))

    return bound((xs,), all_of, f"list of {kind}")


def zipped(xs: Checked, ys: Checked, step: Callable[[Column, Column], Column], kind: str) -> Checked:
    return operation(f"list of {kind}", lambda x, y: F.zip_with(x, y, step), xs, ys, fails=lambda x, y: F.when(F.size(x) != F.size(y), F.lit(LENGTHS)))


def total(xs: Checked) -> Checked:
    """0 if empty."""
    kind = xs.kind.removeprefix("list of ")
    start = F.lit(0).cast(spark_type(kind))
    return operation(kind, lambda x: F.aggregate(x, start, lambda a, e: (a + e).cast(spark_type(kind))), xs)


def columns(a: Checked, name: str) -> dict[str, Column]:
    """The value and its error as two columns."""
    return {name: a.value, f"{name}_err": a.err}
