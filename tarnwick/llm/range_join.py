"""Embedding near-duplicates by an exact metric range join.

The angle between vectors is a metric. Each vector belongs to the cell of its nearest pivot, and is replicated into
every other cell that may hold a vector within the radius: by the triangle inequality, one of a cell that is so near
to it lies no further from the cell's pivot than the cell's reach, and hardly nearer to that pivot than to its own.
A cell's own vectors then meet all their links inside it, so cells join independently. Large cells are joined block by
block. A link is never a row: a block gives the number of each vector's links, and the edges of a spanning forest.

Equal vectors are one to begin with, however many there are. Vectors that are null, zero or hold null or non-finite
components link with nothing. Vectors of different lengths don't link either. Rows are kept as they are; repeated rows
link with each other; rows without an id never name a component. Further columns are ignored.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.llm.common import partitions, slices, written
from tarnwick.llm.components import components

#: Most pivots, the least vectors to a block, and the most bytes of them as doubles.
PIVOTS, BLOCK, BLOCK_BYTES = 1024, 4096, 16 << 20
#: Rows that a task hands on at a time.
ROWS = 2048
NO_ID = 1 << 62
#: What rounding may take from an angle; bounds are widened by it.
SLACK = 1e-7


def unit_vectors(batch: pa.RecordBatch, column: str = "v") -> np.ndarray:
    v = batch.column(column)
    x = v.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(v), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def angles(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ pivots.T, -1, 1))


def link_blocks(left: np.ndarray, right: np.ndarray, cosine: float, rows: int = 512):
    """For slices of the left vectors: where they begin and which of the right ones each links with."""
    for k in range(0, len(left), rows):
        yield k, left[k : k + rows] @ right.T >= cosine


def block_of(n: int, length: int, tasks: int) -> int:
    """Vectors to a block: as many as leave some pairs of blocks for each task, within the bounds."""
    return max(1, min(max(BLOCK, n // ceil(2 * tasks**0.5)), max(1024, BLOCK_BYTES // (8 * length))))


def _one_length(vectors: DataFrame, length: int, cosine: float, cell: int | None, most: int | None) -> tuple[DataFrame, DataFrame]:
    """Of distinct vectors of one length (node, m, v): links (node, n) and edges (a, b)."""
    spark = vectors.sparkSession
    n = vectors.count()
    most = most or block_of(n, length, partitions(spark))
    cell = cell or most
    count = max(1, min(PIVOTS, -(-n // cell)))
    chosen = vectors.orderBy(F.xxhash64("node"), "node").limit(count).select("v").collect()  # at most PIVOTS
    pivots = np.array([r["v"] for r in chosen], float)
    pivots = pivots / np.abs(pivots).max(1, keepdims=True)
    pivots /= np.sqrt((pivots * pivots).sum(1, keepdims=True))
    radius = float(np.arccos(cosine)) + SLACK
    apart = np.maximum(np.arccos(np.clip(pivots @ pivots.T, -1, 1)), 1e-12)

    def homes(batches):
        for rows in slices(batches, ROWS):
            d = angles(unit_vectors(rows), pivots)
            home = d.argmin(1)
            yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(d[np.arange(len(d)), home])], names=["cell", "d"])

    size = np.zeros(count, np.int64)
    reach = np.zeros(count)
    for r in vectors.mapInArrow(homes, "cell int, d double").groupBy("cell").agg(F.count("*").alias("n"), F.max("d").alias("d")).collect():
        size[r["cell"]], reach[r["cell"]] = r["n"], r["d"] + SLACK

    def met(rows):
        """Which cells each row goes to: its home, and those that may hold a vector within the radius."""
        d = angles(unit_vectors(rows), pivots)
        home = d.argmin(1)
        near = d[np.arange(len(d)), home]
        # The generalised hyperplane: of two unit vectors within the chord, the cosines to two pivots differ by
        # no more than the chord times the pivots' distance.
        chord, between = 2 * np.sin(radius / 2), 2 * np.sin(apart[home] / 2)
        may = (d <= reach + radius) & (size > 0) & (np.cos(near)[:, None] - np.cos(d) <= chord * between + SLACK)
        may[np.arange(len(d)), home] = True
        return home, may

    def comers(batches):
        total = np.zeros(count, np.int64)
        for batch in batches:
            for rows in slices([batch], ROWS):
                total += met(rows)[1].sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(count, dtype=np.int32)), pa.array(total)], names=["cell", "n"])

    come = np.zeros(count, np.int64)
    for r in vectors.mapInArrow(comers, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        come[r["cell"]] = r["n"]
    own_blocks, all_blocks = np.maximum(1, -(-size // most)), np.maximum(1, -(-come // most))

    def dealt(batches):
        """Each row once for every pair of blocks it takes part in: as one of the cell's own (side 0) or as any (1)."""
        for rows in slices(batches, ROWS):
            home, may = met(rows)
            at, cell_ = np.nonzero(may)
            mixed = rows.column("node").to_numpy().astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            block = (mixed >> np.uint64(33)).astype(np.int64)
            own_block, any_block = block[at] % own_blocks[cell_], block[at] % all_blocks[cell_]
            mine = home[at] == cell_
            # As one of its own a row meets every block of all, as any every block of its own.
            parts = []
            for side, pick, times in ((0, mine, all_blocks), (1, np.ones(len(at), bool), own_blocks)):
                n_of = times[cell_[pick]]
                k = np.repeat(np.flatnonzero(pick), n_of)
                other = np.arange(len(k)) - np.repeat(np.cumsum(n_of) - n_of, n_of)
                i, j = (own_block[k], other) if side == 0 else (other, any_block[k])
                parts.append(np.stack([at[k], cell_[k], i, j, np.full(len(k), side)]))
            table = np.concatenate(parts, 1)
            for a in range(0, table.shape[1], ROWS):
                part = table[:, a : a + ROWS]
                take = pa.array(part[0])
                yield pa.RecordBatch.from_arrays([*(pa.array(part[k].astype(np.int32)) for k in (1, 2, 3, 4)), rows.column("node").take(take), rows.column("m").take(take), rows.column("v").take(take)], names=["cell", "i", "j", "side", "node", "m", "v"])

    group = ["cell", "i", "j"]
    pairs = vectors.mapInArrow(dealt, "cell int, i int, j int, side int, node long, m long, v array<double>")
    pairs = pairs.repartition(partitions(spark), *group)

    def joined(rows: pa.Table) -> pa.Table:
        side, node, m = (rows.column(c).to_numpy() for c in ("side", "node", "m"))
        x = np.concatenate([unit_vectors(batch) for batch in rows.to_batches()])
        left, right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        a, b, n_links = [], [], np.zeros(len(left), np.int64)
        both = np.isin(node[left], node[right])  # a row meets itself where it is on both sides
        root = {}

        def find(u):
            while root.setdefault(u, u) != u:
                root[u] = root[root[u]]
                u = root[u]
            return u

        covered = np.full(len(right), -1, np.int64)  # the first left row that each right one links with
        left_x, right_x = x[left], x[right]
        del x
        for k, linked in link_blocks(left_x, right_x, cosine):
            r_of, c_of = np.divmod(np.flatnonzero(linked), len(right))
            n_links[k : k + len(linked)] = np.bincount(r_of, m[right][c_of], len(linked))
            first = np.searchsorted(r_of, np.arange(len(linked) + 1))
            for r in np.flatnonzero(np.diff(first) > both[k : k + len(linked)]):
                hit = c_of[first[r] : first[r + 1]]
                u = int(node[left[k + r]])
                # What an earlier row covers is tied to it once for each such row, not for each link.
                ties = np.concatenate([np.unique(covered[hit][covered[hit] >= 0]), node[right[hit[covered[hit] < 0]]]])
                covered[hit[covered[hit] < 0]] = u
                for v in ties.tolist():
                    p, q = find(u), find(int(v))
                    if p != q:
                        root[max(p, q)] = min(p, q)
                        a.append(u)
                        b.append(int(v))
        k, e = len(left), len(a)
        return pa.table({"node": pa.concat_arrays([pa.array(node[left]), pa.nulls(e, pa.int64())]), "n": pa.concat_arrays([pa.array(n_links), pa.nulls(e, pa.int64())]), "a": pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(a, pa.int64())]), "b": pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(b, pa.int64())])})

    out = written(pairs.groupBy(*group).applyInArrow(joined, "node long, n long, a long, b long"), "links")
    return out.where("node is not null").groupBy("node").agg(F.sum("n").alias("n")), out.where("a is not null").select("a", "b")


def near_duplicates(vectors: DataFrame, key: str = "vec_id", embedding: str = "embedding", cosine: float = 0.9, cell: int | None = None, block: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id and kept of every row; a link is a cosine, in double precision, of ``cosine`` or
    more. ``cell``: vectors to a cell that the number of pivots aims at; ``block``: vectors of either side that a task takes.
    Both go by the table's size unless given, and the result is the same."""
    rows = vectors.select(F.col(key).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.coalesce(F.forall("v", fine) & F.exists("v", lambda x: x != 0), F.lit(False))
    rows = written(rows.withColumn("good", good), "vectors")
    least = F.min("vec_id").cast("long")
    some = rows.where("good").groupBy("v").agg(least.alias("least"), F.count("*").alias("m"))
    some = written(some.select("v", "least", "m", F.coalesce("least", F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("v"), 2)).alias("node"), F.size("v").alias("length")), "distinct")
    links = edges = None
    for r in sorted(r["length"] for r in some.select("length").distinct().collect()):  # a table has one length, as a rule
        n, e = _one_length(some.where(F.col("length") == r).select("node", "m", "v"), r, cosine, cell, block)
        links, edges = (n, e) if links is None else (links.union(n), edges.union(e))
    if links is None:
        own = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
        return own.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
    named = some.join(links, "node", "left").join(components(edges), "node", "left").select("v", (F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    of = F.when(F.col("good"), F.col("v"))
    out = rows.withColumn("_v", of).join(named.withColumnRenamed("v", "_v"), "_v", "left")
    component = F.coalesce("component", F.col("vec_id").cast("long"))
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.when(component < NO_ID, component).alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
