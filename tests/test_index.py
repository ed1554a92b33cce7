"""The index's manifest, what keeps it from being served, and the registry, on small tables."""

from pyspark.sql import functions as F

from tarnwick.operators import index

BY = ["book"]
CLAUSES, DECISIONS = "book string, ref string, clause_hash string, label int", "book string, ref string, label string"


def made(spark, clauses, decisions):
    return spark.createDataFrame([(*c, 7) for c in clauses], CLAUSES), spark.createDataFrame(decisions, DECISIONS)


def refusals(spark, pinned, built, clauses, decisions):
    return {r["book"]: tuple(r)[1:] for r in index.verified(pinned, built, *made(spark, clauses, decisions), BY).collect()}


def test_verified(spark):
    clauses = [("a", "C-1", "h1"), ("a", "C-2", "h2"), ("a", "C-3", "h3"), ("b", "C-1", "x"), (None, "C-9", "y"), ("a", None, "z")]
    decisions = [("a", "C-1", "PROSE"), ("a", "C-2", "HYBRID"), ("a", "C-3", "RULE"), ("b", "C-1", "PROSE")]
    c, d = made(spark, clauses + clauses, decisions + decisions)  # what comes twice counts once
    built, pinned = index.chunks(c, d, BY), index.manifest(c, d, BY)
    assert {tuple(r)[:6] for r in pinned.collect()} == {("a", 2, 1, 1, 3, 3), ("b", 1, 1, 0, 1, 1)}
    fine = (None, 0, 0, 0, 0, 0)
    assert refusals(spark, pinned, built, clauses[::-1], decisions[::-1]) == {"a": fine, "b": fine}
    moved = [(b, r, "new" if (b, r) == ("a", "C-1") else h) for b, r, h in clauses]
    assert refusals(spark, pinned, built, moved, decisions) == {"a": ("corpus", 0, 0, 1, 0, 0), "b": fine}
    # a rule's text isn't in the index, yet the corpus isn't the one that was pinned
    rule = [(b, r, "new" if r == "C-3" else h) for b, r, h in clauses]
    assert refusals(spark, pinned, built, rule, decisions)["a"] == ("corpus", 0, 0, 0, 0, 0)
    # decisions move while no text does: a clause has to leave, another to come
    swapped = [("a", "C-1", "RULE"), ("a", "C-2", "HYBRID"), ("a", "C-3", "PROSE"), ("b", "C-1", "HYBRID")]
    assert refusals(spark, pinned, built, clauses, swapped) == {"a": ("triage", 1, 1, 0, 0, 1), "b": ("triage", 0, 0, 0, 0, 0)}
    gone = [x for x in clauses if x[:2] != ("a", "C-2")] + [("a", "C-4", "h4")]
    assert refusals(spark, pinned, built, gone, decisions)["a"] == ("corpus", 0, 0, 0, 1, 1)
    half = built.where("ref <> 'C-2'")
    assert refusals(spark, pinned, half, clauses, decisions)["a"] == ("syncing", 0, 1, 0, 0, 1)
    assert refusals(spark, pinned.selectExpr("book", "n_chunks", "corpus", "cast(null as string) triage"), built, clauses, decisions)["b"][0] == "unpinned"
    assert refusals(spark, pinned, built, [], [])["b"] == ("triage", 1, 0, 0, 1, 0)
    assert index.manifest(c.limit(0), d.limit(0), BY).collect() == []


def test_digest_tells_rows_apart(spark):
    def of(rows):
        return spark.createDataFrame(rows, "a string, b string").agg(index.digest(F.col("a"), F.col("b")).alias("d")).first()["d"]

    assert of([("x", "1"), ("y", "2")]) == of([("y", "2"), ("x", "1")]) != of([("x", "2"), ("y", "1")])
    assert of([]) == "0.0" != of([(None, None)])


def test_registry(spark):
    quotes = spark.createDataFrame([("M", "s", "1"), ("M", "t", "1"), ("M", "s", "1"), ("N", "s", "2"), ("M", None, "2"), ("N", None, "3"), ("N", "u", "9"), ("N", "u", None)], "module string, scope string, ref string")
    ledger = spark.createDataFrame([("1", "HYBRID", ["fair", "fair", None]), ("2", "RULE", None), ("3", "PROSE", ["x"]), ("4", "RULE", []), ("5", "PROSE", None)], "ref string, label string, judgements array<string>")
    got = {r["ref"]: (r["status"], r["modules"]) for r in index.coverage(quotes, ledger).collect()}
    assert got == {"1": ("encoded", ["M"]), "2": ("duplicated", ["M", "N"]), "3": ("prose", ["N"]), "4": ("missing", []), "5": (None, []), "9": ("encoded", ["N"])}
    rows = sorted(tuple(r) for r in index.registry(quotes, ledger).collect())
    assert rows == [("M", "s", "encodes", "1"), ("M", "s", "judgement", "fair"), ("M", "t", "encodes", "1"), ("M", "t", "judgement", "fair"), ("N", "s", "encodes", "2"), ("N", "u", "encodes", "9")]
    assert index.coverage(quotes.limit(0), ledger.limit(0)).collect() == []
