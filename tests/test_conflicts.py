"""Conflicts of texts against a comparison of all pairs."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tarnwick.operators import conflicts

TEXT = "ref string, text string"


def plain_terms(t):
    found = re.findall(conflicts.QUOTED, t) + [m for m in re.findall(conflicts.CAPITALISED, t) if " " in m]
    return {x.lower() for x in found} - conflicts.NO_SUBJECT


def some_clauses(seed, prefix, n):
    r = random.Random(seed)
    subjects = ['"Fee"', '"Notice"', "Late Payment", "Base Charge", "Service Hours", '"Cap"', "The Company", '"Rare Thing"', "Night Work Premium"]
    said = []
    for k in range(n):
        some = r.sample(subjects, r.randint(0, 4)) + (["Common Subject"] if r.random() < 0.8 else [])
        said.append((f"{prefix}{k}", " and ".join(some) + f" cost ${r.choice([5, 10])},000 or {r.choice([5, 7.5])}% for {r.randint(1, 2)} days, {r.choice([2, 3])} times over" if r.random() < 0.9 else None))
    return said


@pytest.mark.parametrize("block", [3, 4096])
def test_pairs_are_those_of_all_comparisons(spark, block):
    a, b = some_clauses(1, "a", 60), some_clauses(2, "b", 90)
    new, old = spark.createDataFrame(a, TEXT), spark.createDataFrame(b, TEXT)
    got = {(r["ref"], r["existing_ref"]): r for r in conflicts.sharing(new, old, 2, block).collect()}
    want = {(x, y): plain_terms(s or "") & plain_terms(t or "") for x, s in a for y, t in b if len(plain_terms(s or "") & plain_terms(t or "")) >= 2}
    assert len(got) == conflicts.sharing(new, old, 2, block).count() and {k: set(r["shared"]) for k, r in got.items()} == want

    def figures(t):
        out = {m.replace(",", "") for p in (conflicts.MONEY, conflicts.PERCENT, conflicts.TIMES) for m in re.findall(p, t or "")}
        return out | {f"{n} {u}" for n, u in re.findall(conflicts.SPAN, t or "")}

    text = dict(a + b)
    differ = {(x, y): figures(text[x]) - figures(text[y]) for x, y in want if figures(text[y]) and figures(text[x]) - figures(text[y])}
    assert {(r["ref"], r["existing_ref"]): set(r["differing"]) for r in conflicts.numeric_divergence(new, old, block).collect()} == differ
    assert conflicts.numeric_divergence(new.limit(0), old).count() == 0


def test_definitions_and_encodings(spark):
    old = spark.createDataFrame([("o1", 'A "Fee" means  money.'), ("o2", '"Day" means a day.'), ("o3", None)], TEXT)
    new = spark.createDataFrame([("n1", 'A "fee" means money.\n'), ("n2", 'A "Fee" means money.'), ("n3", '"day" means a working day.')], TEXT)
    new = new.union(spark.createDataFrame([("n4", '"Fee" means nothing.')], TEXT))
    old = old.union(spark.createDataFrame([("o0", '"Fee" means nothing.'), ("o4", 'A "Fee" means money.'), ("o5", '"fee" means all.')], TEXT))
    assert sorted(map(tuple, conflicts.term_redefinition(new, old).collect())) == [("n1", "fee", "o0", 4), ("n2", "fee", "o0", 2), ("n3", "day", "o2", 1), ("n4", "fee", "o1", 3)]
    encoded = spark.createDataFrame([("n1", "b"), ("n1", "a"), ("n1", "b"), ("x", "a")], "ref string, module string")
    assert [tuple(r) for r in conflicts.duplicate_encoding(new, encoded).collect()] == [("n1", ["a", "b"])]


def test_incompatible_dimensions(spark):
    pairs = [
        ("costs $5 and 10%", "costs $6 and 10 %", ["money"]),
        ("costs $5, $7", "costs $7", []),
        ("10% or 20%", "10%", ["percent"]),
        ("a cap of 50% of fees", "a cap of $ 1,000", ["unit-mismatch"]),
        ("one hour for every two (30) hours", "one hour for every 40 hours", ["ratio"]),
        ("within three (3) hours", "Immediately", ["deadline"]),
        ("", "$5", []),
    ]
    rows = spark.createDataFrame([(k, a, b) for k, (a, b, _) in enumerate(pairs)], "k int, a string, b string")
    got = rows.select("k", conflicts.dimensions_differ(conflicts.fingerprint(F.col("a")), conflicts.fingerprint(F.col("b"))).alias("d")).orderBy("k").collect()
    assert [r["d"] for r in got] == [d for *_, d in pairs]


def test_texts_are_read_once(spark):
    """No filter repeats the patterns that a projection reads terms and figures by."""
    rows = spark.createDataFrame([("a", 'On "Part One" of "Maker Two" at $5'), ("b", None)], "ref string, text string")
    lines = conflicts.numeric_divergence(rows, rows)._jdf.queryExecution().sparkPlan().toString().split("\n")
    assert not any("Filter" in x and "regexp_extract_all" in x for x in lines)
    assert max(x.count('\\s+[A-Z][a-z]+){0,3}') for x in lines) == 1


@pytest.mark.parametrize("paired", [0, 2, 16])
def test_clauses_that_meet_none_are_left_out(spark, paired):
    """All clauses that share two terms stay, whatever the bounds; with room for pairs, no others do."""
    a, b = some_clauses(3, "a", 40) + [("a0", '"Only Here" and "Rare Thing"'), ("a1", '"Fee"')], some_clauses(4, "b", 12)
    new, old = spark.createDataFrame(a + a[:3], TEXT), spark.createDataFrame(b, TEXT)
    both = {(x, y) for x in a for y in b if len(plain_terms(x[1] or "") & plain_terms(y[1] or "")) >= 2}
    for words in (1, conflicts.WORDS):
        stay = [[tuple(r) for r in side.collect()] for side in conflicts.meeting(new, old, paired, words)]
        assert all(len(rows) == len(set(rows)) for rows in stay)
        assert set(stay[0]) >= {x for x, _ in both} and set(stay[1]) >= {y for _, y in both}
        if paired == 16 and words > 1:
            assert set(stay[0]) == {x for x, _ in both} and set(stay[1]) == {y for _, y in both}


def shuffled(plan):
    """Bytes that the shuffles of a plan that has run wrote, each once."""
    if plan.nodeName() == "AdaptiveSparkPlan":
        return shuffled(plan.executedPlan())
    if plan.getClass().getSimpleName().endswith("QueryStageExec"):
        return shuffled(plan.plan())
    if plan.nodeName() == "ReusedExchange":
        return 0
    own = plan.metrics().apply("shuffleBytesWritten").value() if plan.nodeName() == "Exchange" else 0
    return own + sum(shuffled(plan.children().apply(k)) for k in range(plan.children().size()))


def test_texts_that_meet_none_are_not_shuffled(spark):
    """Of clauses on one maker but on no common part, a few bytes each are written, not their references and texts."""
    n, threshold = 4000, spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    said = F.concat(F.lit('"Part '), "id", F.lit('" of "Maker '), F.col("id") % 7, F.lit('" at $'), "id", F.lit(" by "), F.sha2(F.col("id").cast("string"), 512))
    rows = spark.range(n).select(F.concat(F.lit("c"), "id").alias("ref"), said.alias("text"))
    new, old = rows.where("ref < 'c25'"), rows.where("ref >= 'c25'")
    old = old.union(spark.createDataFrame([("x", '"Part 2" of "Maker 2" at $3')], TEXT))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = conflicts.numeric_divergence(new, old)
        assert [(r["ref"], r["existing_ref"], r["differing"]) for r in out.collect()] == [("c2", "x", ["2"])]
        assert 0 < shuffled(out._jdf.queryExecution().executedPlan()) < 40 * n
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
