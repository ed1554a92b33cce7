"""Token ids as Parquet files that can be read in part.

A row holds one document's ids as a list column, with its place in the whole sequence of ids beside it. Files and rows
ascend by document id. Ids are dictionary-encoded (a vocabulary is small), the ascending columns delta-encoded; row
groups and pages are kept small enough that the page index lets a reader skip most of the ids, and the metadata
columns can be read without them.

Null and empty texts hold the end id alone. Repeated rows and ids are kept, in the order of their texts; null ids come
first; further columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tarnwick.llm.common import in_ranges, text_of
from tarnwick.llm.library_tokens import encoder

#: Row groups and pages in bytes and rows; version 2 pages hold delta encodings.
LAYOUT = {
    "parquet.writer.version": "v2",
    "parquet.block.size": str(32 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": "512",
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#first": "false",
    "compression": "zstd",
}


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, spaces: bool = True) -> None:
    """Encodes all documents and writes them in ascending order of doc_id: part, doc_id, first (the document's first
    place among its part's ids), n_tokens and ids, each with the end id."""
    docs = text_of(docs)

    def each(batches):
        ended, part, first = encoder(tokenizer, spaces).ended, TaskContext.get().partitionId(), 0
        for rows in batches:
            for at, ids, n in ended(rows.column("text"), end_id):
                ends = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), pa.array(ids.view(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), rows.column("doc_id").slice(at, len(n)), pa.array(first + ends - n), pa.array(n), lists], names=["part", "doc_id", "first", "n_tokens", "ids"])
                first += int(ends[-1])

    ordered = in_ranges(docs, [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()])
    schema = T.StructType([T.StructField("part", T.IntegerType()), docs.schema["doc_id"], T.StructField("first", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    ordered.mapInArrow(each, schema).write.options(**LAYOUT).parquet(path)


def read_tokens(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    """The files' rows with start, each document's place among all ids. A filter on doc_id reaches the page index, and
    columns that aren't asked for aren't read."""
    rows = spark.read.parquet(path)
    parts = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))  # a row for each file
    parts = parts.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    return rows.join(F.broadcast(parts), "part").select("doc_id", (F.col("before") + F.col("first")).alias("start"), *columns)


def with_checksums(tokens: DataFrame) -> DataFrame:
    """ids_crc32 in the place of ids: of the ids as little-endian unsigned 32-bit integers."""
    kept = [f for f in tokens.schema if f.name != "ids"]

    def each(batches):
        for rows in batches:
            ids = rows.column("ids")
            at, flat = ids.offsets.to_numpy(), memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), "<i4")).cast("B")
            sums = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in kept), pa.array(sums, pa.int64())], names=[*(f.name for f in kept), "ids_crc32"])

    return tokens.mapInArrow(each, T.StructType([*kept, T.StructField("ids_crc32", T.LongType())]))
