"""Review, absences and undetermined amounts on small tables with nulls, ties and empty ones."""

import datetime

from pyspark.sql import functions as F

from tarnwick.operators import absences, review, surface
from tarnwick.plans import library

DAY = datetime.date(1997, 1, 1)


def day(n):
    return DAY + datetime.timedelta(n)


def test_absences_meet(spark):
    rows = [(1, day(0), day(19)), (1, day(20), day(39)), (1, day(20), day(25)), (2, day(0), day(19)), (2, day(21), day(40)), (3, day(0), day(99)), (3, day(10), day(12)), (3, day(100), day(101)), (4, day(5), day(1)), (4, None, day(90))]
    periods = spark.createDataFrame(rows, "who int, begin date, end date")
    got = {r["who"]: r["relief_days"] for r in absences.relief_days(periods, "who", "1997-01-11", "1997-12-31").collect()}
    assert got == {1: 30, 3: 92}
    assert absences.relief_days(periods.limit(0), "who", "1997-01-11", "1997-12-31").count() == 0


def test_dangling(spark):
    rows = [("C-1.1", "C-1", "see C-1.2(b), C-1, C-9.1 and C-9.1; C-1.1 itself"), ("C-1.2", "C-1", None), ("C-1.3", None, "")]
    got = review.dangling(spark.createDataFrame(rows, "clause string, section string, body string"))
    assert [tuple(r) for r in got.collect()] == [("C-1.1", "C-9.1")]


def test_settled(spark):
    state = spark.createDataFrame([("a", "checking", 0, 0, 0, "x"), ("b", "checking", 0, 0, 2, "x"), ("c", "pending", 0, 0, 0, "new"), ("d", "checked", 0, 0, 1, "x")], "key string, status string, heartbeat long, retry_after long, attempts int, fingerprint string")
    results = spark.createDataFrame([("a", "x", False), ("b", "x", False), ("c", "old", True)], "key string, fingerprint string, complete boolean")
    got = {r["key"]: (r["status"], r["attempts"], r["retry_after"]) for r in review.settled(state, results, 1000).collect()}
    assert got == {"a": ("pending", 1, 1300), "b": ("incomplete", 3, 0), "c": ("pending", 0, 0), "d": ("checked", 1, 0)}


def test_undetermined(spark):
    grid = surface.grid(spark, {"price": ("decimal(18,2)", [500, 5000]), "night": ("boolean", [True, False])})
    got = surface.undetermined(surface.cells(library.RIVAL_CAPS, grid), ["price", "night"], "cap").collect()
    assert len(got) == 2 and all(r["near"] and r["low"] == r["high"] == 2000 for r in got)
    none = surface.undetermined(surface.cells(library.RIVAL_CAPS, grid.where(F.col("price") < 1000)), ["price", "night"], "cap").collect()
    assert len(none) == 2 and not any(r["near"] for r in none) and all(r["amount"] is None for r in none)


def test_merge_gate(spark):
    proposals = spark.createDataFrame([(1, "h", "h", "title: x"), (2, None, "h", None), (3, "h", "h", None)], "proposal int, pinned string, current string, head string")
    conflicts = spark.createDataFrame([(1, True, "kept", "me"), (3, True, None, "me"), (3, False, None, None)], "proposal int, blocking boolean, resolution string, resolved_by string")
    assert {r["proposal"]: r["refusals"] for r in review.merge_gate(proposals, conflicts).collect()} == {1: [], 2: ["drifted"], 3: ["unresolved"]}


def test_what_scopes_encode_is_not_broadcast(spark, tmp_path):
    """It is as large as the corpus, however small its file looks before its rows are multiplied."""
    spark.range(20_000).selectExpr("id % 50 query_id", "id % 7 scope", "id ref", "id % 1000 / 1000 score").write.parquet(f"{tmp_path}/scores")
    scores = spark.read.parquet(f"{tmp_path}/scores")
    encodes = scores.select("ref").crossJoin(spark.range(7).withColumnRenamed("id", "scope")).where("scope % 2 = ref % 2")
    out = review.routes(scores, encodes)
    rows = {(r["query_id"], r["place"]): (r["scope"], r["close"]) for r in out.collect()}
    for q in range(50):
        best = sorted(((-max(i % 1000 for i in range(q, 20_000, 50) if i % 7 == s), s) for s in range(7)))[:3]
        ref = min(i for i in range(q, 20_000, 50) if i % 7 == best[0][1] and i % 1000 == -best[0][0])
        for n, (score, s) in enumerate(best, 1):
            gap = (score - best[0][0]) / 1000
            assert rows[q, n] == (s, gap < 0.02 or (gap < 0.04 and s % 2 == ref % 2))
    joins = [x for x in out._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join" in x and "LeftOuter" in x]
    assert joins and all("SortMergeJoin" in x for x in joins)
