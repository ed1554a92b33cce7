"""Decision surfaces: a scope over a grid of facts, its regions, and what a change of the rules moves."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.plans.rules import Scope, apply, signature


def probes(threshold: str, low: str | None = None, high: str | None = None) -> list[Decimal]:
    """A threshold and its neighbours one unit of its own precision away, within the domain."""
    t = Decimal(threshold)
    step = Decimal(1).scaleb(t.as_tuple().exponent)
    ends = [Decimal(x) for x in (low, high) if x is not None]
    return sorted({x for x in (t - step, t, t + step, *ends) if (low is None or x >= Decimal(low)) and (high is None or x <= Decimal(high))})


def grid(spark: SparkSession, axes: dict[str, tuple[str, list]]) -> DataFrame:
    """Every combination of the axes' values; ``axes``: SQL type and values by name. A product of given short lists."""
    out = spark.range(1).select()
    for name, (kind, values) in axes.items():
        out = out.withColumn(name, F.explode(F.array(*(F.lit(str(v)).cast(kind) for v in values))))
    return out


def cells(scope: Scope, facts: DataFrame, coherent: Column | None = None) -> DataFrame:
    out = apply(scope, facts if coherent is None else facts.where(coherent), trace=True)
    return out.withColumn("signature", signature(scope))


def regions(surface: DataFrame) -> DataFrame:
    """signature and size, the largest first (of equal ones, the first by signature)."""
    return surface.groupBy("signature").agg(F.count("*").alias("size")).orderBy(F.desc("size"), "signature")


def diff(before: DataFrame, after: DataFrame, inputs: list[str], output: str) -> DataFrame:
    """Cells that a change moves, matched by their inputs: kind is outcome, revalued or regoverned, and delta the
    change of the output; cells of one side only are unmatched."""
    b = before.select(*inputs, F.col("err").alias("err_b"), F.col(output).alias("value_b"), F.col("signature").alias("sig_b"), F.lit(True).alias("in_b"))
    a = after.select(*inputs, F.col("err").alias("err_a"), F.col(output).alias("value_a"), F.col("signature").alias("sig_a"), F.lit(True).alias("in_a"))
    both = b.join(a, inputs, "full")
    kind = (
        F.when(F.col("in_a").isNull() | F.col("in_b").isNull(), "unmatched")
        .when(~F.col("err_a").eqNullSafe(F.col("err_b")), "outcome")
        .when(~F.col("value_a").eqNullSafe(F.col("value_b")), "revalued")
        .when(F.col("sig_a") != F.col("sig_b"), "regoverned")
    )
    return both.withColumn("kind", kind).where("kind is not null").withColumn("delta", F.col("value_a") - F.col("value_b"))


def divergences(recorded: DataFrame, scope: Scope, output: str, actual: str) -> DataFrame:
    """Recorded decisions that the rules decide otherwise; direction is the sign of what was granted beyond them."""
    computed = apply(scope, recorded)
    differs = F.col("err").isNotNull() | ~F.col(actual).eqNullSafe(F.col(output))
    return computed.where(differs).withColumn("direction", F.signum(F.col(actual) - F.col(output)).cast("int"))


def undetermined(surface: DataFrame, inputs: list[str], output: str) -> DataFrame:
    """For each cell that the rules fail on: low and high, the range of the output over the decided cells that differ
    from it in exactly one input, else over all decided cells (near says which), and amount, high less low.

    Neighbours share all inputs but one, so each is met by an equi-join on the others: no pairs of cells are listed.
    """
    decided = surface.where("err is null")
    failed = surface.where("err is not null").select(*inputs, "err")
    ranges = None
    for moved in inputs:
        kept = [i for i in inputs if i != moved]
        key = F.struct(*(F.col(i) for i in kept)) if kept else F.lit(0)
        by = decided.groupBy(key.alias("_key")).agg(F.min(output).alias("low"), F.max(output).alias("high"))
        met = failed.withColumn("_key", key).join(by, "_key").select(*inputs, "err", "low", "high")
        ranges = met if ranges is None else ranges.unionByName(met)
    near = ranges.groupBy(*inputs, "err").agg(F.min("low").alias("near_low"), F.max("high").alias("near_high"))
    whole = decided.agg(F.min(output).alias("all_low"), F.max(output).alias("all_high"))  # one row
    same = F.lit(True)
    for i in inputs:
        same = same & F.col(f"f.{i}").eqNullSafe(F.col(f"n.{i}"))
    out = failed.alias("f").join(near.alias("n"), same, "left").select(*(F.col(f"f.{i}").alias(i) for i in inputs), F.col("f.err").alias("err"), "near_low", "near_high")
    out = out.join(F.broadcast(whole), how="left").withColumn("near", F.col("near_low").isNotNull())
    low, high = F.coalesce("near_low", "all_low"), F.coalesce("near_high", "all_high")
    return out.select(*inputs, "err", "near", low.alias("low"), high.alias("high"), (high - low).alias("amount"))


def contradictions(left: Scope, right: Scope, facts: DataFrame, shared: dict[str, Column], agree_on: dict[str, str]) -> DataFrame:
    """Facts that the left scope decides and the right one decides otherwise, or can't decide: the facts' columns, field,
    left_value and right_value (as text) and right_err. ``shared`` gives the right scope's inputs from the facts' columns
    and the left one's; ``agree_on`` names the outputs to compare, left to right."""
    decided = apply(left, facts).where("err is null")
    mine = decided.select(*facts.columns, F.struct(*(F.col(v).alias(v) for v in agree_on)).alias("_left"), F.struct(*(c.alias(n) for n, c in shared.items())).alias("_given"))
    both = mine.select(F.struct(*facts.columns).alias("_facts"), "_left", "_given.*")
    got = apply(right, both).withColumn("right_err", F.col("err"))
    checks = [F.struct(F.lit(f"{v}/{w}").alias("field"), F.col(f"_left.{v}").cast("string").alias("left_value"), F.when(F.col("err").isNull(), F.col(w)).cast("string").alias("right_value"), (~F.col(f"_left.{v}").eqNullSafe(F.col(w)) | F.col("err").isNotNull()).alias("differs")) for v, w in agree_on.items()]
    out = got.withColumn("_c", F.explode(F.filter(F.array(*checks), lambda c: c["differs"])))
    return out.select("_facts.*", "_c.field", "_c.left_value", "_c.right_value", "right_err")
