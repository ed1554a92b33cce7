"""The lexical search asks for every benchmark item, and the best by blocks are the best of all scores."""

import random

from pyspark.sql import functions as F

from tarnwick.operators import retrieval
from tarnwick.plans import catalogue

DATA = "/root/testdata/sf0.001"


def test_all_items_are_asked(spark):
    ids = {r["item_id"] for r in spark.read.parquet(f"{DATA}/benchmark.parquet").select("item_id").collect()}
    assert {r["query_id"] for r in catalogue.QUERIES["lexical_search_all"](spark, DATA).collect()} == ids


def words(rng, n):
    return " ".join("w" + chr(97 + k // 26) + chr(97 + k % 26) for k in (int(rng.paretovariate(0.6)) % 60 for _ in range(n)))


def test_best_by_blocks(spark):
    rng = random.Random(5)
    docs = [(i, words(rng, rng.randrange(30))) for i in range(400)] + [(500, None), (501, ""), (502, "wab " * 5000), (3, "wab wac wad"), (3, "wab wac wad")]
    asked = [(i, words(rng, rng.randrange(1, 9))) for i in range(60)] + [(70, None), (71, ""), (72, "never seen"), (5, "wab wah"), (5, "wab wah")]
    d = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id int, text string, score string")
    q = spark.createDataFrame(asked, "query_id long, query string")
    want = retrieval.best(retrieval.lexical_scores(q, d).withColumn("score", F.round("score", 6)), "query_id", "doc_id", 4)
    want = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in want.collect()}
    assert len(want) > 200
    for block, part, lexicon in ((7, 50, 10**6), (8192, 16384, 0)):
        got = retrieval.lexical_best(q, d, 4, block, part, lexicon).collect()
        assert {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in got} == want
    assert retrieval.lexical_best(q, d.limit(0), 4).collect() == retrieval.lexical_best(q.limit(0), d, 4).collect() == []
