"""Pieces that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space, other than space and line feed, that a token pattern may treat in its own way.
OTHER_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0     　" + "".join(map(chr, range(0x2000, 0x200B)))
#: The same, of a text that holds ASCII only.
OTHER_ASCII_SPACES = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f"
#: Documents that a task takes from a batch at a time, so that few texts exist twice in memory.
SLICE = 256


class Memo(dict):
    """Results by key, in two generations of at most ``bound`` entries: keys in use survive, others are forgotten."""

    def __init__(self, make: Callable, bound: int = 250_000, longest: int = 64):
        super().__init__()
        self.make, self.bound, self.longest, self.old = make, bound, longest, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self.keep(key, value)
        return value

    def keep(self, key, value) -> None:
        if len(key) <= self.longest:
            if len(self) >= self.bound:
                self.old = dict(self)
                self.clear()
            self[key] = value

    def lacking(self, keys: Iterable) -> list:
        return [k for k in set(keys) if k not in self and k not in self.old]


def single_spaced(text: str) -> bool:
    """Whether cutting the text before each space leaves every token piece of a byte-level pattern whole."""
    odd = OTHER_ASCII_SPACES if text.isascii() else OTHER_SPACES
    return "  " not in text and text[-1:] != " " and not any(c in text for c in odd)


def slices(batches: Iterable[pa.RecordBatch], n: int = SLICE) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, n):
            yield batch.slice(i, n)


def texts(column: pa.Array) -> list[str]:
    return ["" if t is None else t for t in column.to_pylist()]


def raw_texts(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text, without decoding it; null as empty."""
    return [b"" if t is None else t for t in column.cast(pa.binary()).to_pylist()]


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the whole cluster shares; removed when the session ends."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='tarnwick-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(there)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder: lineage ends there, and lost executors cost nothing."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_of(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns that the operators read, whatever else the table has."""
    return docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))


def in_ranges(docs: DataFrame, order: list[Column]) -> DataFrame:
    """Rows in ascending order over the partitions and in each; the texts are shuffled once."""
    return docs.repartitionByRange(partitions(docs.sparkSession), *order).sortWithinPartitions(*order)
