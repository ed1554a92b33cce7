"""Hybrid retrieval: exact dense search, lexical scores by idf mass, and their blend."""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.operators import wording

#: Distinct words of the queries that are broadcast; beyond, documents' words are joined with them by a shuffle.
LEXICON = 200_000


def tokens(text: Column) -> Column:
    """Distinct lower-case words (with their apostrophes and hyphens) and numbers of two characters or more: 1,000 is 1000,
    99.90% is 99.9, and 98.50 and 98.5 are one."""
    found = F.regexp_extract_all(F.lower(text), F.lit(wording.TOKEN), F.lit(0))
    bare = F.transform(found, lambda t: F.replace(F.regexp_replace(t, r"[%.\-]+$", ""), F.lit(","), F.lit("")))
    figure = lambda t: F.when(t.contains("."), F.regexp_replace(t, r"\.?0*$", "")).otherwise(t)
    return F.array_distinct(F.transform(F.filter(bare, lambda t: F.length(t) > 1), figure))


def lexical_scores(queries: DataFrame, docs: DataFrame) -> DataFrame:
    """query_id, doc_id and score: the share of the query's idf mass that a document holds. idf = ln(1 + n / df); words
    that no document has count as ln(1 + n) in the whole."""
    q = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("token"))
    d = docs.select("doc_id", F.explode(tokens(F.col("text"))).alias("token"))
    n = docs.agg(F.count("*").alias("n"))
    wanted = q.select("token").distinct()
    df = d.join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("df"))
    idf = wanted.join(df, "token", "left").crossJoin(F.broadcast(n)).select("token", F.when(F.col("df").isNotNull(), F.log(1 + F.col("n") / F.col("df"))).otherwise(F.log(1.0 + F.col("n"))).alias("idf"))  # n: one row
    weighed = q.join(idf, "token")
    whole = weighed.groupBy("query_id").agg(F.sum("idf").alias("whole"))
    hit = weighed.join(d, "token").groupBy("query_id", "doc_id").agg(F.sum("idf").alias("mass"))
    return hit.join(whole, "query_id").select("query_id", "doc_id", (F.col("mass") / F.col("whole")).alias("score"))


def lexical_best(queries: DataFrame, docs: DataFrame, k: int, block: int = 8192, part: int = 16384, lexicon: int = LEXICON) -> DataFrame:
    """query_id, doc_id, score (to six places) and rank of the k best documents of each query, by ``lexical_scores``; ids
    are whole numbers. Documents that share no word with a query aren't among its best, null texts have no words, and rows
    of one id count together.

    Texts are read for their words once, and only those that some query has are kept, as one list a document. Each block of
    about ``block`` queries meets each part of about ``part`` documents in one task, which hands on k of each query at
    most: no pair of query and document is ever a row.
    """
    said = queries.select(F.col("query_id").cast("long").alias("query_id"), F.explode(tokens(F.col("query"))).alias("token"))
    for seed in count():  # words go by numbers of 64 bits; no two words of the queries have the same one
        wanted = said.select("token").distinct().withColumn("word", F.xxhash64("token", F.lit(seed)))
        n_words, n_numbers = wanted.agg(F.count("*"), F.countDistinct("word")).first()
        if n_words == n_numbers:
            break
    met = F.broadcast(wanted) if n_words <= lexicon else wanted
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(tokens(F.col("text"))).alias("token")).join(met, "token")
    held = held.groupBy("doc_id").agg(F.collect_list("word").alias("words"))
    n, asked = docs.count(), max(1, queries.count())
    df = held.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    idf = F.log(1.0 + F.coalesce(F.lit(float(n)) / F.col("df"), F.lit(float(n))))
    weighed = said.join(wanted, "token").join(df, "word", "left").select("query_id", "word", idf.alias("idf"))
    blocks, parts = -(-asked // block), max(1, -(-n // part))
    own = lambda c, m: F.pmod(F.xxhash64(c), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    q = weighed.withColumns({"block": own("query_id", blocks)}).withColumn("part", every(parts))
    d = held.withColumns({"part": own("doc_id", parts)}).withColumn("block", every(blocks))

    def scored(left: pa.Table, right: pa.Table) -> pa.Table:
        out = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        if left.num_rows and right.num_rows:
            ids, at = np.unique(left.column("query_id").to_numpy(), return_inverse=True)
            weight, whole = left.column("idf").to_numpy(), np.bincount(at, left.column("idf").to_numpy())
            vocabulary, of = np.unique(left.column("word").to_numpy(), return_inverse=True)
            order, first = np.argsort(of, kind="stable"), np.concatenate([[0], np.cumsum(np.bincount(of))])
            at, weight = at[order], weight[order]
            right = right.sort_by("doc_id")
            lists, names = right.column("words").combine_chunks(), right.column("doc_id").to_numpy()
            ends = np.cumsum(lists.value_lengths().to_numpy())
            words = lists.flatten().to_numpy()
            place = np.minimum(np.searchsorted(vocabulary, words), len(vocabulary) - 1)
            known = vocabulary[place] == words
            size = np.where(known, first[place + 1] - first[place], 0)  # queries that have the word
            total = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], ends])]
            width, low, best_of = len(ids), np.full(len(ids), -1.0), out
            rows, a = max(1, (1 << 21) // width), 0
            while a < len(names):
                b = max(a + 1, min(a + rows, int(np.searchsorted(total, total[a] + (1 << 21), "right")) - 1))
                s, e = (0 if a == 0 else ends[a - 1]), ends[b - 1]
                step, begin = size[s:e], first[place[s:e]]
                entry = np.repeat(begin - (np.cumsum(step) - step), step) + np.arange(step.sum())
                row = np.repeat(np.repeat(np.arange(b - a), np.diff(np.concatenate([[s], ends[a:b]]))), step)
                mass = np.bincount(row * width + at[entry], weight[entry], (b - a) * width).reshape(b - a, width)
                scores = np.round(mass / whole, 6)
                r, c = np.nonzero((mass > 0) & (scores > low))  # ids ascend: an equal score comes too late
                merged = [np.concatenate(x) for x in zip(best_of, (c, names[a + r], scores[r, c]))]
                rank = np.lexsort((merged[1], -merged[2], merged[0]))
                c, ids_of, sc = (x[rank] for x in merged)
                nth = np.arange(len(c)) - np.searchsorted(c, c, "left")
                best_of = tuple(x[nth < k] for x in (c, ids_of, sc))
                low[c[nth == k - 1]] = sc[nth == k - 1]
                a = b
            out = (ids[best_of[0]], best_of[1], best_of[2])
        return pa.table(dict(zip(("query_id", "doc_id", "score"), out)))

    scores = q.groupBy("block", "part").cogroup(d.groupBy("block", "part")).applyInArrow(scored, "query_id long, doc_id long, score double")
    return best(scores, "query_id", "doc_id", k)


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def best(scores: DataFrame, per: str, item: str, k: int, least: float = 0.0) -> DataFrame:
    """The k best of each, ties by item."""
    w = Window.partitionBy(per).orderBy(F.desc("score"), item)
    return scores.where(F.col("score") >= least).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def nearest(asked: DataFrame, items: DataFrame, k: int, block: int = 4096, part: int = 8192) -> DataFrame:
    """query_id, item_id, score (the cosine to six places) and rank of the k nearest items of another id to each query.

    asked has query_id and e, items item_id and e. Each block of about ``block`` queries meets each part of about
    ``part`` items in one task, which hands on k items of each query at most. Vectors that are null, zero or hold null or
    non-finite components, and those of another length, are near nothing.
    """
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.coalesce(F.forall("e", fine) & F.exists("e", lambda x: x != 0), F.lit(False))
    q, v = (d.select(d[i].cast("long").alias("id"), d["e"].cast("array<double>").alias("e")).where(good).withColumn("length", F.size("e")) for d, i in ((asked, "query_id"), (items, "item_id")))
    blocks, parts = max(1, -(-q.count() // block)), max(1, -(-v.count() // part))
    own = lambda n: F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = q.withColumn("block", own(blocks)).withColumn("part", every(parts))
    v = v.withColumn("part", own(parts)).withColumn("block", every(blocks))

    def unit(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        x = rows.column("e").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, -1)
        x = x / np.abs(x).max(1, keepdims=True)
        return rows.column("id").to_numpy(), x / np.sqrt((x * x).sum(1, keepdims=True))

    def met(left: pa.Table, right: pa.Table) -> pa.Table:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if left.num_rows and right.num_rows:
            (ids, x), (names, y) = unit(left), unit(right)
            out = []
            for a in range(0, len(x), 64):
                scores = x[a : a + 64] @ y.T
                np.round(scores, 6, out=scores)
                scores += 0.0
                scores[ids[a : a + 64, None] == names] = -2
                least = np.partition(scores, max(0, len(names) - k), axis=1)[:, max(0, len(names) - k)]
                for s, low, i in zip(scores, least, ids[a : a + 64]):
                    hit = np.flatnonzero(s >= max(low, -1.5))
                    hit = hit[np.lexsort((names[hit], -s[hit]))[:k]]
                    out.append((np.full(len(hit), i), names[hit], s[hit]))
            found = [np.concatenate(c) for c in zip(*out)]
        return pa.table(dict(zip(("query_id", "item_id", "score"), found)))

    group = ["length", "block", "part"]
    scores = q.groupBy(*group).cogroup(v.groupBy(*group)).applyInArrow(met, "query_id long, item_id long, score double")
    return best(scores, "query_id", "item_id", k, -1.0)


def blend(dense: DataFrame, lexical: DataFrame, keys: list[str], weight: float = 0.20) -> DataFrame:
    """(1 - weight) of the dense score and weight of the lexical one; a missing score is 0."""
    both = dense.withColumnRenamed("score", "dense").join(lexical.withColumnRenamed("score", "lexical"), keys, "full")
    zero = F.lit(0.0)
    return both.select(*keys, ((1 - weight) * F.coalesce("dense", zero) + weight * F.coalesce("lexical", zero)).alias("score"))
