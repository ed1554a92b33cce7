"""Predicates over facts and outputs, typed when they are built: a conjunction of atoms ``name operator value``.

A boolean compares with a boolean only; a number with a number; all else as text. A name that isn't there makes an atom
false, and so does a null: nothing fires on what isn't known. A contended value is a literal or ``@name``, another
column's value.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal, InvalidOperation

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_ATOM = re.compile(r"\s*([a-z_]\w*)\s*(>=|<=|!=|>|<|=)\s*(.+?)\s*")
_ORDER = {">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "=": lambda a, b: a == b, "!=": lambda a, b: a != b}


@dataclass(frozen=True)
class Atom:
    name: str
    operator: str
    value: bool | Decimal | str

    @classmethod
    def of(cls, text: str) -> Atom:
        m = _ATOM.fullmatch(text)
        if not m:
            raise ValueError(f"{text!r} is not <name> <operator> <value>")
        return cls(m[1], m[2], literal(m[3]))

    def holds(self, schema: T.StructType) -> Column:
        """Over a table of this schema; never null."""
        if self.name not in schema.names:
            return F.lit(False)
        c, kind, order = F.col(self.name), schema[self.name].dataType, _ORDER[self.operator]
        if isinstance(kind, T.BooleanType) or isinstance(self.value, bool):
            if not (isinstance(kind, T.BooleanType) and isinstance(self.value, bool)):
                return F.lit(False)
            return F.coalesce(order(c.cast("int"), F.lit(int(self.value))), F.lit(False))
        if isinstance(kind, T.NumericType) and isinstance(self.value, Decimal):
            return F.coalesce(order(c, F.lit(self.value)), F.lit(False))
        if isinstance(kind, T.StringType) and isinstance(self.value, Decimal):  # numbers if both are, else text
            number = F.expr(f"try_cast(`{self.name}` as decimal(38,18))")
            return F.coalesce(order(number, F.lit(self.value)), order(c, F.lit(str(self.value))), F.lit(False))
        return F.coalesce(order(c.cast("string"), F.lit(str(self.value))), F.lit(False))


def literal(text: str) -> bool | Decimal | str:
    t = text.strip().strip("\"'")
    if t.lower() in ("true", "false"):
        return t.lower() == "true"
    try:
        return Decimal(t)
    except InvalidOperation:
        return t


@dataclass(frozen=True)
class Predicate:
    """``contends``: the output that should have had the value ``contended``, a literal or ``@name``."""

    name: str
    when: tuple[str, ...]
    contends: str = ""
    contended: str = ""

    def fires(self, schema: T.StructType) -> Column:
        """All atoms hold; without any it never fires."""
        out = F.lit(bool(self.when))
        for text in self.when:
            out = out & Atom.of(text).holds(schema)
        return out

    def _pair(self, schema: T.StructType) -> tuple[Column, Column] | None:
        quantity = lambda n: n in schema.names and isinstance(schema[n].dataType, T.NumericType)
        if not quantity(self.contends):
            return None
        if self.contended.startswith("@"):
            return (F.col(self.contends), F.col(self.contended[1:])) if quantity(self.contended[1:]) else None
        value = literal(self.contended)
        return (F.col(self.contends), F.lit(value)) if isinstance(value, Decimal) else None

    def amount(self, schema: T.StructType) -> Column:
        """How far the output is from the contended value; null if either is no quantity."""
        pair = self._pair(schema)
        return F.abs(pair[1] - pair[0]).cast("decimal(28,6)") if pair else F.lit(None).cast("decimal(28,6)")

    def movement(self, schema: T.StructType, favours: dict[str, str]) -> Column:
        """``same``, ``for`` or ``against`` the counterparty, ``differs`` where nothing says whom a larger output favours."""
        pair = self._pair(schema)
        if not pair:
            return F.lit("differs")
        got, want = pair
        side = {"counterparty": want > got, "company": want < got}.get(favours.get(self.contends, ""))
        apart = F.lit("differs") if side is None else F.when(side, "for").otherwise("against")
        return F.when(got.isNull() | want.isNull(), "differs").when(got == want, "same").otherwise(apart)


def first_firing(rows: DataFrame, predicates: tuple[Predicate, ...]) -> DataFrame:
    """The rows with predicate (the first that fires, in their order, or null) and amount."""
    schema, name, amount = rows.schema, None, None
    for p in predicates:
        fires = p.fires(schema)
        name = F.when(fires, p.name) if name is None else name.when(fires, p.name)
        amount = F.when(fires, p.amount(schema)) if amount is None else amount.when(fires, p.amount(schema))
    nothing = F.lit(None)
    return rows.withColumns({"predicate": (nothing if name is None else name).cast("string"), "amount": (nothing if amount is None else amount).cast("decimal(28,6)")})
