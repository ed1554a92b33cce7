"""Blocks, clauses, mutants and verdicts on small tables."""

from pyspark.sql import functions as F

from tarnwick.operators import documents, exposure, surface
from tarnwick.plans import library


def test_clauses(spark):
    text = "intro\n## C-4 Pay\n**C-4.1** First\nmore\n\nC-4.2 Second\n## C-5 Leave\nloose\nC-5.1 Third"
    docs = spark.createDataFrame([(1, text), (2, None), (3, "")], "doc_id long, text string")
    got = {r["clause"]: (r["section"], r["section_title"], r["body"].strip()) for r in documents.clauses(docs).collect()}
    assert got == {"C-4.1": ("C-4", "Pay", "First\nmore"), "C-4.2": ("C-4", "Pay", "Second"), "C-5.1": ("C-5", "Leave", "Third")}


def test_mutants(spark):
    made = dict(exposure.mutants(library.RIVAL_CAPS))
    assert {n.split(":")[0] for n in made} == {"flip_comparison", "shift_threshold", "negate_condition", "change_constant"}
    facts = surface.grid(spark, {"price": ("decimal(18,2)", [999, 1000, 1001, 99999, 100000])})
    shifted = next(s for n, s in made.items() if n.startswith("shift_threshold:0"))
    assert [int(r["price"]) for r in exposure.killed_by(library.RIVAL_CAPS, shifted, facts, "cap").collect()] == [1000]
    assert len(list(exposure.mutants(library.SERVICE_CREDIT))) > 20


def test_adjudicate(spark):
    facts = spark.createDataFrame([(1, None), (2, 10), (3, 600), (4, 5000), (5, 7000), (6, 200000)], "k int, price int").withColumn("price", F.col("price").cast("decimal(18,2)"))
    out = exposure.adjudicate(library.RIVAL_CAPS, facts, "price >= 500", (("large", "price > 6000"), ("none", "cap is null")))
    assert [r["klass"] for r in out.orderBy("k").collect()] == ["unrealisable", "unrealisable", "SILENCE", "died", "ADVERSE", "CONFLICT"]
    assert exposure.queue(out, "k").count() == 3
