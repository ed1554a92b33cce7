"""SimHash near-duplicates by bit-sliced comparison.

Equal fingerprints are one to begin with. Two different ones at a distance of r or less agree on two of r + 2 blocks of
their bits at least, so rows meet by the pairs of blocks. Within a bucket the fingerprints lie as vertical bit planes,
64 to a machine word; a query's bits are compared with a plane at a time, carry-save counters add up the distances of
all lanes at once, and words whose lanes have all gone beyond the radius are left out of the planes that follow.
A bucket gives the edges of a spanning forest of its links only. Buckets of many fingerprints are dealt out by pairs
of chunks, so that no task holds more than two chunks of one.

Null and empty texts, and texts of spaces, have fingerprint zero and are linked like any other. Rows are kept as they
are; repeated rows share their component. Rows without an id are linked too but never name a component, which is null
if it has no id at all. Further columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.llm.common import partitions, raw_texts, slices, text_of, written
from tarnwick.llm.components import components

#: Fingerprints of a bucket that a task compares with as many others.
CHUNK = 1024
#: Stands for the ids of fingerprints that have none.
NO_ID = 1 << 62


def shingle_hashes(data: bytes, words: int, seed: int) -> np.ndarray:
    """XXH64 of each run of words, lower-cased in A-Z and joined by single spaces."""
    tokens = data.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    joined = b" ".join(tokens)
    ends = list(itertools.accumulate(map(len, tokens), lambda a, n: a + n + 1))
    starts = [0, *(e + 1 for e in ends[:-1])]
    runs = [joined[a:b] for a, b in zip(starts, ends[words - 1 :])] if len(tokens) > words else [joined]
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, itertools.repeat(seed)), np.uint64, len(runs))


def fingerprint(data: bytes, words: int = 4, seed: int = 42) -> int:
    """Each bit is 1 if it is set in over half of the hashes."""
    h = shingle_hashes(data, words, seed)
    if not len(h):
        return 0
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 1 << 15):
        ones += np.unpackbits(h[k : k + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42) -> DataFrame:
    """doc_id and fp (the fingerprint's bits as a long) of every text."""
    docs = text_of(docs)

    def each(batches):
        for rows in slices(batches):
            fps = np.array([fingerprint(d, words, seed) for d in raw_texts(rows.column("text"))], np.uint64)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.mapInArrow(each, T.StructType([docs.schema["doc_id"], T.StructField("fp", T.LongType())]))


def sliced_links(fps: np.ndarray, sizes: np.ndarray, radius: int) -> Iterator[tuple[int, int]]:
    """Of fingerprints in groups that follow each other: pairs of places that link all that is linked within a group."""
    first = np.cumsum(sizes) - sizes
    order = np.argsort(-sizes, kind="stable")
    order = order[sizes[order] > 1]
    if not len(order):
        return
    words = -(-sizes[order] // 64)
    word_at = np.cumsum(words) - words
    lanes = np.zeros(int(words.sum()) * 64, np.uint64)
    home = np.full(len(lanes), -1, np.int64)
    rank = np.arange(int(sizes[order].sum())) - np.repeat(np.cumsum(sizes[order]) - sizes[order], sizes[order])
    at = np.repeat(word_at * 64, sizes[order]) + rank
    home[at] = np.repeat(first[order], sizes[order]) + rank
    lanes[at] = fps[home[at]]
    planes = np.empty((64, len(lanes) // 64), np.uint64)
    for k in range(64):
        planes[k] = np.packbits((lanes >> np.uint64(k) & np.uint64(1)).astype(np.uint8), bitorder="little").view("<u8")
    root = np.arange(len(lanes))
    group_of_word = np.repeat(np.arange(len(order)), words)
    nth_word = np.arange(len(group_of_word)) - np.repeat(word_at, words)
    full = ~np.uint64(0)
    for r in range(int(sizes[order[0]]) - 1):
        n = int(np.searchsorted(-sizes[order], -(r + 1), "left"))  # groups of more than r + 1
        live = np.flatnonzero(nth_word[: word_at[n - 1] + words[n - 1]] >= r // 64)
        left = sizes[order][group_of_word[live]] - 64 * nth_word[live]  # lanes in use from here on
        used = np.where(left >= 64, full, (np.uint64(1) << np.minimum(left, 63).astype(np.uint64)) - np.uint64(1))
        after = np.where(nth_word[live] == r // 64, full << np.uint64(r % 64) << np.uint64(1) if r % 64 < 63 else np.uint64(0), full)
        out = ~(used & after)
        query = lanes[word_at[group_of_word[live]] * 64 + r]
        c1, c2, c4, c8 = (np.zeros(len(live), np.uint64) for _ in range(4))
        for k in range(64):
            carry = planes[k, live] ^ (np.uint64(0) - (query >> np.uint64(k) & np.uint64(1)))
            for c in (c1, c2, c4):
                carry, c[:] = c & carry, c ^ carry
            c8 |= carry
            if k % 8 == 7 or k == 63:
                out |= _beyond(c1, c2, c4, c8, radius)
                stay = out != full
                if not stay.all():
                    live, query, out, c1, c2, c4, c8 = (x[stay] for x in (live, query, out, c1, c2, c4, c8))
                    if not len(live):
                        break
        if len(live):
            hit = np.flatnonzero(np.unpackbits(np.ascontiguousarray(~out).view(np.uint8), bitorder="little"))
            to = live[hit // 64] * 64 + hit % 64
            frm = word_at[group_of_word[live[hit // 64]]] * 64 + r
            new = root[to] != root[frm]
            for a, b in zip(frm[new].tolist(), to[new].tolist()):
                if root[a] != root[b]:
                    g = group_of_word[a // 64]
                    span = root[word_at[g] * 64 : (word_at[g] + words[g]) * 64]
                    span[span == root[b]] = root[a]
                    yield int(home[a]), int(home[b])


def _beyond(c1, c2, c4, c8, radius: int):
    """The lanes whose count, c8 if 8 or more, is above the radius (at most 7)."""
    more, same = np.zeros_like(c1), ~np.zeros_like(c1)
    for bit, c in ((4, c4), (2, c2), (1, c1)):
        if radius & bit:
            same = same & c
        else:
            more = more | same & c
            same = same & ~c
    return c8 | more


def linked(fps: DataFrame, radius: int = 4, chunk: int = CHUNK) -> DataFrame:
    """Of distinct fingerprints (fp, node): edges a, b between nodes, that link all within the radius of each other."""
    blocks = radius + 2
    bounds = [64 * k // blocks for k in range(blocks + 1)]
    mask = [((1 << bounds[k + 1]) - (1 << bounds[k])) for k in range(blocks)]
    pairs = list(itertools.combinations(range(blocks), 2))
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keyed = fps.select("fp", "node", F.posexplode(F.array(*(F.col("fp").bitwiseAND(F.lit(signed(mask[i] | mask[j])).cast("long")) for i, j in pairs))).alias("pair", "key"))
    many = keyed.groupBy("pair", "key").agg(F.count("*").alias("n")).where(F.col("n") > chunk).select("pair", "key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    keyed = keyed.join(many, ["pair", "key"], "left")
    own = F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1))).cast("int")
    dealt = keyed.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("chunks", F.lit(1)) - 1)))
    dealt = dealt.select("pair", "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "fp", "node")
    group = ["pair", "key", "i", "j"]

    def each(batches):
        rest = None
        for rows in itertools.chain(batches, [None]):
            if rows is not None:
                now = pa.Table.from_batches([rows])
                rest = now if rest is None else pa.concat_tables([rest, now])
            if rest is None or not rest.num_rows:
                continue
            keys = np.stack([rest.column(c).to_numpy().astype(np.int64) for c in group])
            new = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            upto = rest.num_rows if rows is None else int(new[-1]) if len(new) else 0  # the last group may go on
            if not upto:
                continue
            starts = np.concatenate([[0], new[new < upto]])
            sizes = np.diff(np.append(starts, upto))
            node = rest.column("node").to_numpy()
            found = list(sliced_links(rest.column("fp").to_numpy().view(np.uint64)[:upto], sizes, radius))
            rest = rest.slice(upto)
            if found:
                a, b = np.array(found).T
                yield pa.RecordBatch.from_arrays([pa.array(node[a]), pa.array(node[b])], names=["a", "b"])

    return dealt.repartition(partitions(fps.sparkSession), *group).sortWithinPartitions(*group).mapInArrow(each, "a long, b long")


def _components(rows: DataFrame, radius: int) -> DataFrame:
    """fp and component_id (null if no row of the component has an id) of written rows of doc_id and fp."""
    no_id = F.lit(NO_ID) + F.shiftrightunsigned(F.xxhash64("fp"), 2)
    fps = rows.groupBy("fp").agg(F.min("doc_id").cast("long").alias("least")).select("fp", F.coalesce("least", no_id).alias("node"))
    whole = components(linked(fps, radius))
    named = fps.join(whole, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return named.select("fp", F.when(F.col("component_id") < NO_ID, F.col("component_id")).alias("component_id"))


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id (smallest doc_id that links lead to, or its own)."""
    rows = written(fingerprints(docs, words, seed), "fingerprints")
    return rows.join(_components(rows, radius), "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, words: int = 4, radius: int = 4, seed: int = 42) -> DataFrame:
    """One row of each component, the one of the smallest id; all columns stay. Of rows that share that id, repeated
    ones or others, one stays if they are linked, each if they aren't. Rows without an id stay."""
    text = docs.columns.index("text")

    def each(batches):
        for rows in slices(batches):
            whole = rows.column("row")
            own = raw_texts(whole.field(text).cast(pa.string()))
            fps = np.array([fingerprint(d, words, seed) for d in own], np.uint64)
            yield pa.RecordBatch.from_arrays([whole, pa.array(fps.view(np.int64))], names=["row", "fp"])

    whole = docs.select(F.struct(*docs.columns).alias("row"))
    marked = whole.mapInArrow(each, T.StructType([*whole.schema.fields, T.StructField("fp", T.LongType())]))
    rows = written(marked.withColumn("at", F.monotonically_increasing_id()), "fingerprinted")  # places hold once written
    ids = rows.select(F.col("row.doc_id").alias("doc_id"), "fp", "at")
    least = ids.where("doc_id is not null").groupBy("fp").agg(F.min(F.struct("doc_id", "at")).alias("first"))
    kept = least.join(_components(ids, radius), "fp").groupBy("component_id").agg(F.min("first").alias("first")).select(F.col("first.at").alias("at"))
    stay = rows.where("row.doc_id is not null").join(kept, "at", "left_semi").select("row.*")
    return stay.unionByName(rows.where("row.doc_id is null").select("row.*"))
