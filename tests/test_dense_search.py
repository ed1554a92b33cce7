"""The dense search by blocks against all pairs."""

import numpy as np

from tarnwick.operators import retrieval
from tarnwick.plans import catalogue

DATA = "/root/testdata/sf0.001"


def test_nearest_by_blocks(spark):
    g = np.random.default_rng(3)
    v = np.round(g.normal(size=(90, 4)), 1)
    v[40:60] = v[0]  # equal vectors: ties go by id
    rows = [(int(i), [float(z) for z in x]) for i, x in enumerate(v)] + [(901, None), (902, [0.0] * 4), (903, [1.0, None, 0.0, 0.0]), (904, [1.0, 2.0])]
    items = spark.createDataFrame(rows, "item_id long, e array<double>")
    u = v / np.linalg.norm(v, axis=1)[:, None]
    scores = np.round(u @ u.T, 6)
    want = {(i, rank): j for i in range(90) for rank, j in enumerate(sorted((j for j in range(90) if j != i), key=lambda j: (-scores[i, j], j))[:7], 1)}
    got = retrieval.nearest(items.withColumnRenamed("item_id", "query_id"), items, 7, block=16, part=20).collect()
    assert {(r["query_id"], r["rank"]): r["item_id"] for r in got} == want and len(got) == len(want)


def test_all_queries_are_asked(spark):
    ids = {r["vec_id"] for r in spark.read.parquet(f"{DATA}/embeddings.parquet").select("vec_id").collect()}
    got = {r["query_id"] for r in catalogue.QUERIES["dense_search_all"](spark, DATA).collect()}
    assert got == {i for i in ids if i % 20 == 0} and len(got) > 5
