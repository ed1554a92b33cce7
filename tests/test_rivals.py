"""Rivals in turn, quotes and consensus, by hand."""

from tarnwick.operators import rivals


def test_rivals_in_turn(spark):
    e = {1: [1.0, 0.0], 2: [0.0, 1.0], 3: [-1.0, 0.1], 11: [1.0, 0.1], 12: [1.0, 0.3], 13: [0.1, 1.0], 14: [0.4, 1.0], 15: [0.7, 0.7]}
    targets = spark.createDataFrame([(k, k - 1, e[k]) for k in (1, 2, 3)] + [(4, 3, None)], "query_id long, at long, e array<double>")
    others = spark.createDataFrame([(k, v) for k, v in e.items() if k > 10], "item_id long, e array<double>")
    got = rivals.interleaved(targets, others, together=2, neighbours=3, most=4).orderBy("batch", "place").collect()
    assert [tuple(r) for r in got] == [(0, 1, 11), (0, 2, 13), (0, 3, 12), (0, 4, 14), (1, 1, 13), (1, 2, 14), (1, 3, 15)]


def test_quotes_and_consensus(spark):
    clauses = spark.createDataFrame([("a1", "1", "A", "The Fee is “five”\n pounds."), ("b1", "1", "B", "A fee of six pounds."), ("a2", "2", "A", None)], "ref string, clause_id string, document string, text string")
    base = ("A", "1", "b1", 'is "FIVE"  pounds', "six pounds", "differs")
    cases = [(base, None), ((*base[:1], "9", *base[2:]), "no clause of the new document"), ((*base[:2], "zz", *base[3:]), "no clause of another document"), ((*base[:2], "a2", *base[3:]), "cites the document against itself"), ((*base[:3], "is six", *base[4:]), "quote not in the new clause"), ((*base[:3], "", *base[4:]), "quote not in the new clause"), ((*base[:4], None, base[5]), "quote not in the existing clause"), ((*base[:5], "  "), "says nothing")]
    rows = spark.createDataFrame([(*c, k % 2) for k, (c, _) in enumerate(cases)] + [(*base, 1), (*base, 1)], "document string, clause_id string, corpus_ref string, quote string, corpus_quote string, summary string, attacker int")
    checked = rivals.verified(rows, clauses)
    got = {tuple(r)[:6]: r["reason"] for r in checked.collect()}
    assert all(got[c] == reason for c, reason in cases)
    assert [(r["raised_by"], r["status"]) for r in rivals.consensus(checked).collect()] == [([0, 1], "corroborated")]
    assert [(r["raised_by"], r["status"]) for r in rivals.consensus(checked.where("attacker = 0")).collect()] == [([0], "single")]
