"""Approximate nearest neighbours by inner product: a forest of random-projection trees with one priority queue.

A tree halves the vectors, level by level, at the medians of their projections on orthogonal random directions (one a
level, so that a block of rows is routed by one matrix product). Directions come from a seed and medians from a sample,
which bounds what is sent to the tasks; every row is indexed. An inner product becomes a distance by one more dimension
that gives all vectors the same length. A query walks all trees at once: the leaves of the whole forest wait in one
queue in the order of their squared distance along the crossed directions, and the query takes the first ``budget`` of
them, and more until they hold enough vectors. All vectors of these leaves are candidates and are scored exactly.

``budget`` is measured, not guessed: for a bounded, random set of the queries the true neighbours are found by one pass
over all rows, and the budget is where their leaves stand in the queues, at the quantile ``recall``. On vectors without
structure that is a large share of all leaves, for there is nothing to prune by; the results stay right.

Equal vectors are one in the index, with the ids that a result can hold. A leaf meets its queries block by block, so
neither a large leaf nor a popular one is ever one task's; each block hands on the best of a query only.

Vectors that are null or zero or hold null or non-finite components take no part, nor do rows without an id; vectors of
different lengths aren't compared. Rows of equal id and vector are one; a query is never matched with a row of its own
id. Equal scores go by the smaller id. Without other vectors a query has no rows. Further columns are ignored.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tarnwick.llm.common import partitions, slices, written

#: Trees, vectors to a leaf that their number aims at, sampled vectors that trees are fitted to, and those to a leaf.
TREES, LEAF, SAMPLE, TO_A_LEAF = 4, 512, 1 << 15, 8
#: Queries whose true neighbours set the budget, and the share of these neighbours that it has to reach.
MEASURED, RECALL = 256, 0.95
#: Vectors (queries) of a leaf that meet in one block, and found pairs that a task keeps before it thins them out.
BLOCK, PENDING = 4096, 1 << 18


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows, pair by pair: the same number whatever else is in the block."""
    return (a * b).sum(1)


def rows_of(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


@dataclass(frozen=True)
class Forest:
    """``directions``: for each tree a matrix with a column for each level; ``cuts``: for each tree its thresholds, level
    by level; ``norm``: the largest length of a vector."""

    directions: tuple[np.ndarray, ...]
    cuts: tuple[tuple[np.ndarray, ...], ...]
    norm: float

    @property
    def leaves(self) -> int:
        return 1 << len(self.cuts[0])

    def _levelled(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([x, np.sqrt(np.maximum(self.norm**2 - (x * x).sum(1), 0.0))])

    def slots(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector in each tree, numbered through the forest."""
        x, out = self._levelled(x), np.zeros((len(x), len(self.cuts)), np.int64)
        for t, (r, cuts) in enumerate(zip(self.directions, self.cuts)):
            p, leaf = x @ r, np.zeros(len(x), np.int64)
            for level, cut in enumerate(cuts):
                leaf = 2 * leaf + (p[:, level] >= cut[leaf])
            out[:, t] = t * self.leaves + leaf
        return out

    def queue(self, q: np.ndarray) -> np.ndarray:
        """All leaves of the forest in the order in which each query takes them."""
        q, far = np.column_stack([q, np.zeros(len(q))]), []
        for r, cuts in zip(self.directions, self.cuts):
            p, d = q @ r, np.zeros((len(q), 1))
            for level, cut in enumerate(cuts):
                m = p[:, level, None] - cut[None]
                d = np.stack([d + np.maximum(m, 0) ** 2, d + np.minimum(m, 0) ** 2], 2).reshape(len(q), -1)
            far.append(d)
        return np.argsort(np.concatenate(far, 1), axis=1, kind="stable")


def grow(sample: np.ndarray, norm: float, trees: int, depth: int, seed: int = 12) -> Forest:
    """Trees of a number of levels over a sample of vectors."""
    g, d = np.random.default_rng(seed), sample.shape[1] + 1
    directions, cuts = [], []
    levelled = Forest((), ((),), norm)._levelled(sample)
    for _ in range(trees):
        bases = [np.linalg.qr(g.normal(size=(d, d)))[0] for _ in range(-(-max(depth, 1) // d))]
        r = np.concatenate(bases, 1)[:, :depth]
        p, leaf, mine = levelled @ r, np.zeros(len(sample), np.int64), []
        for level in range(depth):
            cut = np.zeros(1 << level)
            order = np.lexsort((p[:, level], leaf))
            first = np.searchsorted(leaf[order], np.arange(1 << level))
            many = np.diff(np.append(first, len(order)))
            there = many > 0
            cut[there] = p[order, level][(first + many // 2)[there]]
            leaf = 2 * leaf + (p[:, level] >= cut[leaf])
            mine.append(cut)
        directions.append(r)
        cuts.append(tuple(mine))
    return Forest(tuple(directions), tuple(cuts), norm)


def taken(forest: Forest, q: np.ndarray, sizes: np.ndarray, budget: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, slot) of the leaves that queries take: ``budget`` of them, and until one tree's hold ``least`` vectors."""
    order = forest.queue(q)
    held, trees = np.zeros(order.shape[0]), order // forest.leaves
    need = np.full(order.shape[0], order.shape[1])
    for t in range(len(forest.cuts)):
        held = np.cumsum(np.where(trees == t, sizes[order], 0), 1)
        enough = held >= least
        need = np.minimum(need, np.where(enough.any(1), enough.argmax(1) + 1, order.shape[1]))
    many = np.maximum(need, min(budget, order.shape[1]))
    kept = np.arange(order.shape[1])[None] < many[:, None]
    kept &= sizes[order] > 0
    at, place = np.nonzero(kept)
    return at, order[at, place]


def thinned(found: list[tuple[np.ndarray, ...]], most: int) -> tuple[np.ndarray, ...]:
    """Of (query, node, least id, score): for each query the best, without repeats."""
    q, node, least, score = (np.concatenate(c) for c in zip(*found))
    order = np.lexsort((node, least, -score, q))
    q, node, least, score = q[order], node[order], least[order], score[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (node[1:] != node[:-1])  # a node's score is one number, so its repeats are neighbours
    q, node, least, score = q[new], node[new], least[new], score[new]
    first = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q))))
    kept = rank < most
    return q[kept], node[kept], least[kept], score[kept]


def best_pairs(q: np.ndarray, x: np.ndarray, floor: np.ndarray, most: int, rows: int = 256):
    """(query, vector, score) of all pairs that can be among a query's ``most`` best; ``floor``: what these surely reach."""
    longest = float(np.sqrt((x * x).sum(1).max()))
    for k in range(0, len(q), rows):
        part = q[k : k + rows]
        s = part @ x.T
        slack = 1e-12 * longest * np.sqrt((part * part).sum(1)) + 1e-300
        bar = floor[k : k + rows] - slack
        if s.shape[1] > most:
            bar = np.maximum(bar, np.partition(s, s.shape[1] - most, 1)[:, s.shape[1] - most] - slack)
        a, b = np.nonzero(s >= bar[:, None])
        for c in range(0, len(a), 1 << 16):
            i, j = a[c : c + (1 << 16)], b[c : c + (1 << 16)]
            yield i + k, j, scores(part[i], x[j])


def keyed(table: DataFrame, key: str, embedding: str) -> DataFrame:
    """vec_id, key (of the vector), length and v, of rows that take part."""
    kind = table.schema[embedding].dataType
    rows = table.select(F.col(key).cast("long").alias("vec_id"), F.col(embedding).alias("v"))
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))):
        rows = rows.withColumn("v", F.col("v").cast("array<double>"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.coalesce(finite, F.lit(False)))

    def each(batches):
        for b in batches:
            v, length = b.column("v"), pc.list_value_length(b.column("v")).cast(pa.int32())
            data = (v.flatten().to_numpy(zero_copy_only=False).astype(float) + 0.0).tobytes()  # of two zeros, one
            at = 8 * np.append(0, np.cumsum(length.to_numpy(), dtype=np.int64))
            keys = [hashlib.blake2b(data[a:e], digest_size=16).digest() for a, e in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(keys, pa.binary()), length, v], names=["vec_id", "key", "length", "v"])

    kinds = [rows.schema["vec_id"], T.StructField("key", T.BinaryType()), T.StructField("length", T.IntegerType()), rows.schema["v"]]
    return rows.mapInArrow(each, T.StructType(kinds))


def _sampled(df: DataFrame, n: int) -> pa.Table:
    """At most n rows, by a hash of their keys."""
    return df.orderBy(F.xxhash64("key"), "key").limit(n).toArrow()


def _search(nodes: DataFrame, asked: DataFrame, k: int, trees: int, leaf: int, sample: int, measured: int, recall: float, block: int) -> DataFrame:
    """Of vectors of one length (node, key, least, v) and different queries (q, key, v): q, node, least and score of the
    k + 1 best nodes found, the query's own among them."""
    spark = nodes.sparkSession
    most = k + 1
    about = nodes.agg(F.count("*").alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))).alias("m")).first()
    drawn = rows_of(_sampled(nodes, sample).column("v").combine_chunks())
    depth = max(0, min((-(-about["n"] // leaf) - 1).bit_length(), (len(drawn) // TO_A_LEAF).bit_length() - 1))
    forest = grow(drawn, float(np.sqrt(about["m"])) * (1 + 1e-9), trees, depth)

    def routed(batches):
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(forest.slots(rows_of(b.column("v"))).ravel().astype(np.int32))], names=["slot"])

    sizes = np.zeros(trees * forest.leaves, np.int64)
    for r in nodes.select("v").mapInArrow(routed, "slot int").groupBy("slot").count().collect():  # at most a row for each leaf
        sizes[r["slot"]] = r["count"]
    probe = _sampled(asked, measured)
    q = rows_of(probe.column("v").combine_chunks())

    def true_best(batches):
        found = []
        for b in batches:
            x, node, least = rows_of(b.column("v")), b.column("node").to_numpy(), b.column("least").to_numpy()
            for i, j, s in best_pairs(q, x, np.full(len(q), -np.inf), most) if len(x) else ():
                found.append((i, node[j], least[j], s))
            if found:
                found = [thinned(found, most)]
        if found:
            i, node, least, s = found[0]
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(node), pa.array(least), pa.array(s)], names=["q", "node", "least", "score"])

    true = nodes.select("node", "least", "v").mapInArrow(true_best, "q long, node long, least long, score double")
    by_query = Window.partitionBy("q").orderBy(F.desc("score"), "least", "node")
    true = true.withColumn("r", F.row_number().over(by_query)).where(F.col("r") <= most).join(nodes.select("node", "v"), "node").select("q", "v").toArrow()  # measured x (k + 1) rows
    where, of = forest.slots(rows_of(true.column("v").combine_chunks())), true.column("q").to_numpy()
    order = forest.queue(q)
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.broadcast_to(np.arange(order.shape[1]), order.shape), 1)
    reached = np.sort(place[of[:, None], where].min(1))  # the place in the queue at which each true neighbour is met
    budget = int(reached[min(len(reached) - 1, int(np.ceil(recall * len(reached))))]) + 1

    together = max(1, min(1024, (1 << 21) // len(sizes)))  # rows whose queues are made at once

    def asks(batches):
        for b in slices(batches, together):
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([pa.array(taken(forest, rows_of(b.column("v")), sizes, budget, most)[1].astype(np.int32))], names=["slot"])

    popular = np.zeros(len(sizes), np.int64)
    for r in asked.select("v").mapInArrow(asks, "slot int").groupBy("slot").count().collect():
        popular[r["slot"]] = r["count"]
    left, right = np.maximum(1, -(-popular // block)), np.maximum(1, -(-sizes // block))

    def dealt(name: np.ndarray, slot: np.ndarray, own: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, own block, other block): a row lies in one block of its side and meets all of the other side."""
        mine = ((name.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % own[slot]
        times = other[slot]
        at = np.repeat(np.arange(len(slot)), times)
        return at, mine[at], np.arange(len(at)) - np.repeat(np.cumsum(times) - times, times)

    names = ["slot", "i", "j", "side", "name", "least", "v"]

    def indexed(batches):
        for b in slices(batches, 1024):
            if not b.num_rows:
                continue
            slot = forest.slots(rows_of(b.column("v")))
            used = (popular > 0)[slot]
            row, tree = np.nonzero(used)
            slot, name = slot[row, tree], b.column("node").to_numpy()[row]
            at, mine, other = dealt(name, slot, right, left)
            take = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in (slot[at], other, mine, np.ones(len(at)))), pa.array(name[at]), b.column("least").take(take), b.column("v").take(take)], names=names)

    def asking(batches):
        for b in slices(batches, together):
            if not b.num_rows:
                continue
            row, slot = taken(forest, rows_of(b.column("v")), sizes, budget, most)
            name = b.column("q").to_numpy()[row]
            at, mine, other = dealt(name, slot, left, right)
            take = pa.array(row[at])
            yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int32)) for c in (slot[at], mine, other, np.zeros(len(at)))), pa.array(name[at]), pa.nulls(len(at), pa.int64()), b.column("v").take(take)], names=names)

    kinds = T._parse_datatype_string("slot int, i int, j int, side int, name long, least long")
    kinds = T.StructType([*kinds.fields, nodes.schema["v"]])
    met = nodes.select("node", "least", "v").mapInArrow(indexed, kinds).union(asked.select("q", "v").mapInArrow(asking, kinds))
    met = met.repartition(partitions(spark), "slot", "i", "j").sortWithinPartitions("slot", "i", "j", "side")

    def joined(batches):
        group, held, found, pending = None, [], [], 0
        known, bars = np.zeros(0, np.int64), np.zeros(0)  # queries that have found enough here, and their worst score

        def close():
            nonlocal pending, known, bars
            if not held:
                return
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            side = rows.column("side").to_numpy()
            many = int((side == 0).sum())  # queries come first
            if 0 < many < len(side):
                v, name = rows_of(rows.column("v")), rows.column("name").to_numpy()
                least, floor = rows.column("least").to_numpy(zero_copy_only=False), np.full(many, -np.inf)
                if len(known):
                    k = np.minimum(np.searchsorted(known, name[:many]), len(known) - 1)
                    floor = np.where(known[k] == name[:many], bars[k], -np.inf)
                for i, j, s in best_pairs(v[:many], v[many:], floor, most):
                    found.append((name[i], name[many + j], least[many + j].astype(np.int64), s))
                    pending += len(i)
                if pending > PENDING:
                    found[:] = [thinned(found, most)]
                    q, _, _, score = found[0]
                    pending, last = len(q), np.flatnonzero(np.append(q[1:] != q[:-1], True))
                    full = np.diff(np.append(-1, last)) == most
                    known, bars = q[last[full]], score[last[full]]
            held.clear()

        def out():
            q, node, least, s = thinned(found, most)
            return pa.RecordBatch.from_arrays([pa.array(q), pa.array(node), pa.array(least), pa.array(s)], names=["q", "node", "least", "score"])

        for b in batches:
            if not b.num_rows:
                continue
            g = np.column_stack([b.column(c).to_numpy() for c in ("slot", "i", "j")])
            edges = [0, *(np.flatnonzero((g[1:] != g[:-1]).any(1)) + 1).tolist(), len(g)]
            for a, e in zip(edges[:-1], edges[1:]):
                this = tuple(g[a].tolist())
                if this != group:
                    close()
                    group = this
                    if pending > PENDING:  # even when thinned out: handed on, for the final merge
                        yield out()
                        found.clear()
                        pending = 0
                held.append(b.slice(a, e - a))
        close()
        if found:
            yield out()

    hits = met.mapInArrow(joined, "q long, node long, least long, score double").dropDuplicates(["q", "node"])
    return hits.withColumn("r", F.row_number().over(by_query)).where(F.col("r") <= most).drop("r")


def nearest(
    table: DataFrame, asks: Column, key: str = "vec_id", embedding: str = "embedding", k: int = 20, trees: int = TREES, leaf: int = LEAF, sample: int = SAMPLE, measured: int = MEASURED, recall: float = RECALL, block: int = BLOCK
) -> DataFrame:
    """query_id, rank, vec_id and score: for each row for which ``asks`` (a condition on vec_id) holds, the ``k`` rows of
    other ids with the largest inner product that the forest finds."""
    rows = keyed(table, key, embedding)
    # k + 1 ids of a vector are all that a result can hold, its own left out. The limit is taken before the shuffle too.
    few = rows.withColumn("r", F.dense_rank().over(Window.partitionBy("key").orderBy("vec_id"))).where(F.col("r") <= k + 1)
    nodes = few.groupBy("key").agg(F.first("v").alias("v"), F.first("length").alias("length"), F.sort_array(F.collect_set("vec_id")).alias("ids"))
    nodes = written(nodes.select(F.monotonically_increasing_id().alias("node"), "key", "v", "length", "ids", F.get("ids", F.lit(0)).alias("least")), "nodes")
    queries = rows.where(asks)
    asked = queries.groupBy("key").agg(F.first("v").alias("v"), F.first("length").alias("length"))
    asked = written(asked.select(F.monotonically_increasing_id().alias("q"), "key", "v", "length"), "asked")
    hits = None
    for r in sorted(r["length"] for r in asked.select("length").distinct().collect()):  # a table has one length, as a rule
        one = _search(nodes.where(F.col("length") == r), asked.where(F.col("length") == r), k, trees, leaf, sample, measured, recall, block)
        hits = one if hits is None else hits.union(one)
    if hits is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    ids = hits.join(nodes.select("node", "ids"), "node").select("q", "score", F.explode("ids").alias("vec_id"))
    # The k + 1 best of a query vector, best first: bounded by (k + 1)^2 rows before the cut.
    best = ids.groupBy("q").agg(F.slice(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), "vec_id"))), 1, 2 * k + 2).alias("best"))
    best = best.join(asked.select("q", "key"), "q").select("key", "best")
    out = queries.select(F.col("vec_id").alias("query_id"), "key").distinct().join(best, "key")
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("query_id")), 1, k)
    out = out.select("query_id", F.posexplode(others).alias("place", "b"))
    return out.select("query_id", (F.col("place") + 1).alias("rank"), F.col("b.vec_id").alias("vec_id"), (-F.col("b.s")).alias("score"))
