"""Gates that a scope has to pass over a table of facts: every case decided, every branch taken, every change noticed.

Each is one pass with one row a task: counts, not cases. A scope's branches and mutants are known from its rules, so that
what never occurs has a row as well.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.operators.exposure import mutants
from tarnwick.plans.rules import Scope, apply


def _listed(one: DataFrame, rows: list[tuple[dict[str, str], str]], count: str) -> DataFrame:
    """A single row of counts as a row for each."""
    said = F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in names.items()), F.col(c).alias(count)) for names, c in rows))
    return one.select(F.explode(said).alias("r")).select("r.*")


def outcomes(scope: Scope, facts: DataFrame) -> DataFrame:
    """outcome (``computed`` or the failure) and cases: a scope is total where no case is silent or in conflict."""
    return apply(scope, facts).groupBy(F.coalesce("err", F.lit("computed")).alias("outcome")).agg(F.count("*").alias("cases"))


def branches(scope: Scope, facts: DataFrame) -> DataFrame:
    """variable, branch and governed: how many decided cases each label of a scope governs. 0 is a dead branch."""
    every = [(v, label) for v in scope.order for label in {d.label or v: 0 for ds in scope.labels(v).values() for d in ds}]
    done = apply(scope, facts, trace=True).where("err is null")

    def took(v, label):
        return F.exists("governing", lambda g: (g["variable"] == v) & (g["branch"] == label))

    one = done.agg(*(F.count(F.when(took(v, label), 1)).alias(f"n{k}") for k, (v, label) in enumerate(every)))
    return _listed(one, [({"variable": v, "branch": label}, f"n{k}") for k, (v, label) in enumerate(every)], "governed")


def _differs(a: str, b: str, names: list[str]):
    return reduce(or_, (~F.col(f"{a}.{n}").eqNullSafe(F.col(f"{b}.{n}")) for n in names))


def _decided(rows: DataFrame, scope: Scope, names: list[str], to: str) -> DataFrame:
    """The rows with a scope's outcome as one more column."""
    return apply(scope, rows).withColumn(to, F.struct("err", *(F.when(F.col("err").isNull(), F.col(n)).alias(n) for n in names))).select(*rows.columns, to)


def disagreements(scope: Scope, other: Scope, facts: DataFrame, names: list[str]) -> DataFrame:
    """The cases that two scopes decide differently, with mine and theirs: none if they are equivalent on these facts."""
    both = _decided(_decided(facts, scope, names, "mine"), other, names, "theirs")
    return both.where(_differs("mine", "theirs", ["err", *names]))


def mutation_report(scope: Scope, facts: DataFrame, names: list[str]) -> DataFrame:
    """mutant and killing: on how many cases a change of the rules is noticed. Those with 0 survive."""
    changed = [*mutants(scope)]
    rows = _decided(facts, scope, names, "_own")
    for k, (_, mutant) in enumerate(changed):
        rows = _decided(rows, mutant, names, "_now").withColumn(f"_m{k}", _differs("_own", "_now", ["err", *names])).drop("_now")
    one = rows.agg(*(F.count(F.when(F.col(f"_m{k}"), 1)).alias(f"n{k}") for k in range(len(changed))))
    return _listed(one, [({"mutant": name}, f"n{k}") for k, (name, _) in enumerate(changed)], "killing")
