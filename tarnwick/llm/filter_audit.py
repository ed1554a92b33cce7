"""An audit of how filters interact: what each order of them keeps and what every filter adds, by a subset-zeta transform.

Each document becomes a mask of the filters that it fails. Per part (a value of ``lang``) the corpus is then a count for
each mask, whatever its size. Summed over the subsets of a set (the zeta transform, one addition a filter and mask), the
counts say how many documents fail nothing outside the set: the survivors of its complement. Every step of every order
is a difference between two neighbouring sets of survivors, for documents and for labelled ones alike, so that no order
is ever applied to the documents.

Null texts count as empty ones. A document is a duplicate if a smaller id, in any part, has the very same text; a row
without an id is none and makes none. Rows that share an id and a text with the smallest id are all first. Of several
labels of one id the worst and the best both count. Repeated rows count as often as they occur. A null part is the
empty one. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from itertools import permutations
from math import factorial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tarnwick.llm.common import raw_texts, slices

#: The filters, and what fails each.
FILTERS = "ABCDE"
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
SIGNS, CAPITALS = b"#$%&*|", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Bytes of UTF-8 that begin no code point.
_CONTINUE = bytes(range(0x80, 0xC0))
#: The measures that are summed over masks.
MEASURES = ("n", "good", "toxic")


def own_mask(text: bytes) -> int:
    """Bits of the filters A to D that a text fails by itself. ASCII white space divides words, as bytes.split() does."""
    words = text.split()
    points = len(text.translate(None, _CONTINUE))
    capitals = len(text) - len(text.translate(None, CAPITALS))
    failed = len(words) < LEAST_WORDS, 100 * len(set(words)) < LEAST_DISTINCT * len(words), 100 * capitals > MOST_CAPITALS * points, any(s in text for s in SIGNS)
    return sum(1 << k for k, f in enumerate(failed) if f)


def judged(docs: DataFrame, key: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """doc_id, part, text_key (SHA-256 of the text) and mask of A to D. The one pass over the texts, which go no further."""
    rows = docs.select(F.col(key).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), F.col(text).cast("string").alias("text"))

    def each(batches):
        for b in slices(batches):
            texts = raw_texts(b.column("text"))
            keys, masks = [hashlib.sha256(t).digest() for t in texts], [own_mask(t) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("part"), pa.array(keys, pa.binary()), pa.array(masks, pa.int32())], names=["doc_id", "part", "text_key", "mask"])

    kinds = [rows.schema["doc_id"], rows.schema["part"], T.StructField("text_key", T.BinaryType()), T.StructField("mask", T.IntegerType())]
    return rows.mapInArrow(each, T.StructType(kinds))


def mask_counts(rows: DataFrame, labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """part, mask of A to E, and how many documents, good and toxic ones, it has.

    Equal rows are one with a count before each shuffle, so that a group of copies is as many rows as it has parts,
    and rows without an id, which meet no label, are dealt by their texts."""
    rows = rows.groupBy("doc_id", "part", "text_key", "mask").agg(F.count("*").alias("n"))
    own = labels.select(F.col(key).alias("_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic"))
    own = own.where("_id is not null").groupBy("_id").agg(F.max(F.coalesce("good", F.lit(False))).alias("good"), F.max(F.coalesce("toxic", F.lit(False))).alias("toxic"))
    own = own.withColumn("_salt", F.lit(None).cast("long"))
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("text_key"))
    rows = rows.withColumn("salt", salt).join(own, F.col("doc_id").eqNullSafe(F.col("_id")) & F.col("salt").eqNullSafe(F.col("_salt")), "left")
    rows = rows.select("doc_id", "part", "text_key", "mask", "n", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))
    # Of each kind of copies: how many, and the smallest id with its rows; a null id is a kind of its own.
    kind = ["text_key", "part", "mask", "good", "toxic", "named"]
    least = F.min(F.struct("doc_id", "n"))
    kinds = rows.withColumn("named", F.col("doc_id").isNotNull()).groupBy(*kind, "doc_id").agg(F.sum("n").alias("n")).groupBy(*kind).agg(F.sum("n").alias("n"), least.alias("least"))
    first = F.min("least.doc_id").over(Window.partitionBy("text_key"))
    firsts = F.when(~F.col("named"), F.col("n")).when(F.col("least.doc_id") == first, F.col("least.n")).otherwise(0)
    kinds = kinds.withColumn("firsts", firsts.cast("long"))
    bit = 1 << FILTERS.index("E")
    either = F.explode(F.array(F.struct(F.col("mask").alias("mask"), F.col("firsts").alias("n")), F.struct((F.col("mask") + bit).alias("mask"), (F.col("n") - F.col("firsts")).alias("n"))))
    out = kinds.select("part", "good", "toxic", either.alias("e")).where("e.n > 0")
    n = F.col("e.n")
    return out.groupBy("part", F.col("e.mask").alias("mask")).agg(F.sum(n).alias("n"), F.sum(F.when(F.col("good"), n).otherwise(0)).alias("good"), F.sum(F.when(F.col("toxic"), n).otherwise(0)).alias("toxic"))


def _of_mask(measure: str):
    return lambda m: F.coalesce(F.try_element_at("by_mask", m)[measure], F.lit(0))


def _with_neighbour(measure: str, bit: int):
    """Adds to each mask that has the bit the sum of the one without it."""
    return lambda c, m: c + F.when(m.bitwiseAND(F.lit(bit)) > 0, F.get(F.col(measure), m - bit)).otherwise(F.lit(0))


def survivors(counts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """A row for each part; per measure an array that has, at each set of filters, what these leave."""
    size = 1 << len(filters)
    by_mask = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*MEASURES))))  # at most ``size`` entries
    out = counts.groupBy("part").agg(by_mask.alias("by_mask"))
    every = F.sequence(F.lit(0), F.lit(size - 1))
    out = out.select("part", *(F.transform(every, _of_mask(x)).cast("array<long>").alias(x) for x in MEASURES))
    for k in range(len(filters)):  # one column a round, so that no round's sums are spelt out again in the next
        out = out.withColumns({x: F.transform(x, _with_neighbour(x, 1 << k)) for x in MEASURES})
    return out.select("part", *(F.reverse(x).alias(x) for x in MEASURES))  # what fails within a set survives its complement


def audit(left: DataFrame, filters: str = FILTERS) -> DataFrame:
    """The steps of all orders, from ``survivors``: differences between neighbouring sets."""
    size, full = 1 << len(filters), (1 << len(filters)) - 1
    orders = ["".join(p) for p in permutations(filters)]
    rows = left.withColumn("filter_order", F.explode(F.array(*map(F.lit, orders)))).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(filters)))).alias("step"))
    bit = lambda letter: F.element_at(F.create_map(*(F.lit(y) for k, f in enumerate(filters) for y in (f, 1 << k))), letter)
    letter = F.substring("filter_order", F.col("step"), F.lit(1))
    before = F.aggregate(F.slice(F.split("filter_order", ""), F.lit(1), F.col("step") - 1), F.lit(0), lambda a, x: a + bit(x))
    rows = rows.withColumns({"f": bit(letter), "before": before})
    at = lambda x, s: F.get(x, s)
    after = F.col("before") + F.col("f")
    gone = lambda x: at(x, F.col("before")) - at(x, after)
    weight = [factorial(s.bit_count()) * factorial(len(filters) - 1 - s.bit_count()) if s != full else 0 for s in range(size)]
    weights = F.array(*map(F.lit, weight)).cast("array<long>")
    shapley = F.aggregate(
        F.sequence(F.lit(0), F.lit(full)),
        F.lit(0).cast("long"),
        lambda a, s: a + F.when((s.bitwiseAND(F.col("f")) == 0), F.get(weights, s) * (F.get("n", s) - F.get("n", s + F.col("f")))).otherwise(F.lit(0)),
    )
    fails = at("n", F.lit(0)) - at("n", F.col("f"))
    return rows.select(
        "part",
        "filter_order",
        "step",
        at("n", after).alias("kept"),
        gone("n").alias("removed"),
        (fails - gone("n")).alias("redundant"),
        (at("n", F.lit(full) - F.col("f")) - at("n", F.lit(full))).alias("unique_fails"),
        gone("good").alias("good_lost"),
        gone("toxic").alias("toxic_lost"),
        shapley.alias("shapley"),
    )


def audit_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley: a row for
    each part, order and step."""
    return audit(survivors(mask_counts(judged(docs), labels)))
