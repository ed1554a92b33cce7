"""Verdicts on fact patterns, the queue of exposures, and changed rules that a set of cases should tell apart."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.plans.rules import CONFLICT, REFUSED, SILENT, Scope, apply, signature

#: The class of an exposure for each way in which rules can fail.
STRUCTURAL = {CONFLICT: "CONFLICT", SILENT: "SILENCE", REFUSED: "REFUSAL"}


def adjudicate(scope: Scope, facts: DataFrame, realisable: str, predicates: tuple[tuple[str, str], ...]) -> DataFrame:
    """The scope's columns with klass and predicate: facts outside the domain are unrealisable; then how the rules
    failed; then ADVERSE with the first predicate (name, condition) that fires; else died. Nulls fire nothing."""
    out = apply(scope, facts, trace=True).withColumn("signature", signature(scope))
    fires = F.coalesce(*(F.when(F.coalesce(F.expr(test), F.lit(False)), F.lit(name)) for name, test in predicates)) if predicates else F.lit(None).cast("string")
    real = F.coalesce(F.expr(realisable), F.lit(False))
    failed = F.element_at(F.create_map(*(F.lit(x) for kv in STRUCTURAL.items() for x in kv)), F.col("err"))
    out = out.withColumn("predicate", F.when(real & F.col("err").isNull(), fires))
    klass = F.when(~real, "unrealisable").when(F.col("err").isNotNull(), failed).when(F.col("predicate").isNotNull(), "ADVERSE").otherwise("died")
    return out.withColumn("klass", klass)


def queue(verdicts: DataFrame, key: str) -> DataFrame:
    """One row for each class, predicate and signature (the failed branch of structural ones): times and first_seen."""
    kept = verdicts.where("klass not in ('died', 'unrealisable')")
    governed = F.when(F.col("err").isNull(), F.lit("")).otherwise(F.col("signature"))
    return kept.groupBy("klass", "predicate", governed.alias("signature")).agg(F.count("*").alias("times"), F.min(key).alias("first_seen"))


FLIPPED = {">=": "<", "<=": ">", ">": "<=", "<": ">="}


def mutants(scope: Scope) -> Iterator[tuple[str, Scope]]:
    """The scope changed in one place each: a comparison flipped, a whole-number threshold moved by one, a constant
    value raised by one, a condition negated, an ``and`` made ``or``, an exception dropped. Name and scope; a change
    that leaves no valid scope is left out."""

    def changed(i, **to):
        ds = list(scope.definitions)
        ds[i] = replace(ds[i], **to)
        return replace(scope, definitions=tuple(ds))

    for i, d in enumerate(scope.definitions):
        at = f"{i}:{d.variable}:{d.label}"
        if d.when != "true":
            for m in re.finditer(r">=|<=|>|<", d.when):
                yield f"flip_comparison:{at}:{m.start()}", changed(i, when=d.when[: m.start()] + FLIPPED[m[0]] + d.when[m.end() :])
            for m in re.finditer(r"(?<=[<>=] )\d+(?![\d.])", d.when):
                yield f"shift_threshold:{at}:{m.start()}", changed(i, when=d.when[: m.start()] + str(int(m[0]) + 1) + d.when[m.end() :])
            yield f"negate_condition:{at}", changed(i, when=f"not ({d.when})")
            for m in re.finditer(r"\band\b", d.when):
                yield f"and_to_or:{at}:{m.start()}", changed(i, when=d.when[: m.start()] + "or" + d.when[m.end() :])
        if re.fullmatch(r"\d+(\.\d+)?", d.value):
            yield f"change_constant:{at}", changed(i, value=f"({d.value} + 1)")
        if d.exception_to and not any(e.exception_to == d.label for e in scope.definitions if d.label):
            yield f"drop_exception:{at}", replace(scope, definitions=scope.definitions[:i] + scope.definitions[i + 1 :])


def killed_by(scope: Scope, mutant: Scope, facts: DataFrame, output: str) -> DataFrame:
    """The facts on which the mutant's outcome or output differs: none means that it survives."""
    both = apply(scope, facts).select(*facts.columns, F.struct("err", output).alias("was"))
    after = apply(mutant, both).withColumn("now", F.struct("err", output))
    return after.where(~F.col("was").eqNullSafe(F.col("now"))).select(*facts.columns, "was", "now")
