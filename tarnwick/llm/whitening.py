"""Whitening of embeddings from an exact integer scatter matrix.

An entry c becomes the integer floor(1024 c) + 100000. Tasks subtract the shift again and add up integers and their
products without any rounding: a block of rows is cut into limbs so short that their products, summed over the block,
fit a double's 53 bits, so that a plain matrix product of limbs is exact; Python's integers add up the blocks. A task
hands on its sums in limbs of 32 bits, which Spark adds as decimals, and only one number for each pair of dimensions
and limb comes to the driver. There n XᵀX - SSᵀ is formed exactly, and only then turned into doubles for eigh. The
result depends neither on the order of the rows nor on how they are dealt out.

Rows whose vector is null or holds null or non-finite entries are dropped; so are empty vectors, and those of another
length than most (the longer of two lengths as frequent). Repeated rows count as often as they occur; a null id stays
null. Components without variance (all rows equal in them, so up to rounding of V) have a null ``whitened`` and take no
part in ``identity_error``, which is null if there is none. Entries of any size are exact; ``deviation`` is null where
it has more than 38 digits. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import decimal
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.llm.common import written

SCALE, SHIFT = 1024, 100_000
#: Bits of the limbs that a task's sums are handed on in, and rows that are multiplied at a time.
LIMB, BLOCK = 32, 4096


def steps(values: np.ndarray) -> np.ndarray:
    """floor(1024 c) of finite doubles: as int64, or as Python's integers if one is beyond 2^61."""
    scaled = values * float(SCALE) if len(values) and np.abs(values).max() < 1e300 else np.full(values.shape, np.inf)
    if not values.size or np.abs(scaled).max() < 2.0**61:
        return np.floor(scaled).astype(np.int64)
    exact = [math.floor(c * SCALE) if abs(c) < 2**53 else int(c) * SCALE for c in values.ravel().tolist()]
    return np.array(exact, object).reshape(values.shape)


def scatter(y: np.ndarray) -> np.ndarray:
    """yᵀy of a block of integers, exact, as Python's integers."""
    most = max((abs(int(v)) for v in (y.max(), y.min())), default=0)
    width = max(1, (52 - int(len(y)).bit_length()) // 2)
    count = max(1, -(-most.bit_length() // width))
    sign = np.where(y < 0, -1, 1)
    rest, limbs = np.abs(y), []
    for _ in range(count):
        limbs.append(((rest & ((1 << width) - 1)) * sign).astype(np.float64))
        rest = rest >> width
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            out += (a.T @ b).astype(np.int64).astype(object) << (width * (i + j))
    return out


def limbs_of(value: int) -> list[tuple[int, int]]:
    """(power, limb) of an integer, with its sign in each limb."""
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    for power in range(0, value.bit_length(), LIMB):
        out.append((power // LIMB, sign * (value >> power & ((1 << LIMB) - 1))))
    return out


def usable(table: DataFrame, key: str, embedding: str) -> DataFrame:
    """vec_id and v, of the rows that take part."""
    rows = table.select(F.col(key).alias("vec_id"), F.col(embedding).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.coalesce(finite & (F.size("v") > 0), F.lit(False)))
    usual = rows.groupBy(F.size("v").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    return rows.where(F.size("v") == (usual["length"] if usual else 0))


def matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


@dataclass(frozen=True)
class Fit:
    """``n`` vectors with sums ``total`` of their shifted entries; ``m`` is n XᵀX - SSᵀ, exact."""

    n: int
    total: np.ndarray
    m: np.ndarray

    def decompose(self, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Eigenvalues, falling, of the covariance over 2^(2 half), its unit eigenvectors in columns with the largest
        entry positive, each eigenvalue's share of the trace, and half (0 but for entries near a double's end)."""
        largest = max((abs(int(v)) for v in self.m.ravel()), default=0) // (self.n * self.n)
        half = max(0, (largest.bit_length() - 1000 + 1) // 2)
        over = (self.n * self.n) << (2 * half)
        v = np.array([[int(x) / over for x in row] for row in self.m], float)  # each correctly rounded
        e, u = np.linalg.eigh(v)
        e, u = e[::-1][:most], u[:, ::-1][:, :most]
        u = u * np.where(u[np.abs(u).argmax(0), np.arange(u.shape[1])] < 0, -1.0, 1.0)
        trace = float(np.trace(v))
        return np.where(e > trace * 1e-13, e, 0.0), u, e / trace if trace else np.zeros(len(e)), half


def fit(vectors: DataFrame) -> Fit | None:
    """One pass and one shuffle of a number for each task, pair of dimensions and limb; null for no vectors."""

    def each(batches):
        n, total, products = 0, 0, 0
        for b in batches:
            y = steps(matrix(b.column("v"))) if b.num_rows else ()
            for k in range(0, len(y), BLOCK):
                part = y[k : k + BLOCK]
                n += len(part)
                total, products = total + part.astype(object).sum(0) if part.dtype == object else total + part.sum(0).astype(object), products + scatter(part)
        if not n:
            return
        rows = [(-1, 0, p, x) for p, x in limbs_of(n)]
        for i in range(len(total)):
            rows += [(i, -1, p, x) for p, x in limbs_of(int(total[i]))]
            rows += [(i, j, p, x) for j in range(i, len(total)) for p, x in limbs_of(int(products[i, j]))]
        columns = zip(*rows)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["i", "j", "power", "limb"])

    sums = vectors.select("v").mapInArrow(each, "i int, j int, power int, limb long")
    found: dict[tuple[int, int], int] = {}
    for r in sums.groupBy("i", "j", "power").agg(F.sum(F.col("limb").cast("decimal(28,0)")).alias("limb")).collect():  # by dimensions, not rows
        found[r["i"], r["j"]] = found.get((r["i"], r["j"]), 0) + (int(r["limb"]) << (LIMB * r["power"]))
    if (-1, 0) not in found:
        return None
    n, d = found[-1, 0], vectors.select(F.size("v")).first()[0]
    total = np.array([found.get((i, -1), 0) for i in range(d)], object)
    products = np.array([[found.get((min(i, j), max(i, j)), 0) for j in range(d)] for i in range(d)], object).reshape(d, d)
    return Fit(n, total, n * products - np.outer(total, total))


def project(vectors: DataFrame, fitted: Fit, components: int) -> DataFrame:
    """vec_id, deviation and w (an array with an element for each component, null without variance)."""
    e, u, _, half = fitted.decompose(components)
    n, total = fitted.n, fitted.total
    small = n < 1 << 31 and all(abs(int(s)) < 1 << 61 for s in total)
    root = np.sqrt(np.where(e > 0, e, 1.0))
    context = decimal.Context(prec=38)

    def each(batches):
        for b in batches:
            if not b.num_rows:
                continue
            y = steps(matrix(b.column("v")))
            if small and y.dtype != object and int(np.abs(y).max()) * n < 1 << 61:
                apart = y * np.int64(n) - total.astype(np.int64)
                centred = apart / float(n) if half == 0 else apart / (float(n) * 2.0**half)
                if int(np.abs(apart).max()) ** 2 * y.shape[1] < 1 << 62:
                    deviation = (apart * apart).sum(1).tolist()
                else:
                    deviation = (apart.astype(object) ** 2).sum(1)
            else:
                apart = y.astype(object) * n - total
                centred = np.array([[int(x) / (n << half) for x in row] for row in apart], float)
                deviation = (apart**2).sum(1)
            w = centred @ u / root
            numbers = [context.create_decimal(int(x)) if int(x) < 10**38 else None for x in deviation]
            flat = pa.array(w.ravel(), mask=np.tile(e <= 0, len(w)))
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), pa.array(numbers, pa.decimal128(38, 0)), pa.FixedSizeListArray.from_arrays(flat, len(e)).cast(pa.list_(pa.float64()))], names=["vec_id", "deviation", "w"])

    kinds = T.StructType([vectors.schema["vec_id"], T.StructField("deviation", T.DecimalType(38, 0)), T.StructField("w", T.ArrayType(T.DoubleType()))])
    return vectors.mapInArrow(each, kinds)


def whiten(table: DataFrame, key: str = "vec_id", embedding: str = "embedding", components: int = 8) -> DataFrame:
    """vec_id, component, n, deviation (decimal, exact), whitened, explained and identity_error: a row for each vector
    and component. The error is measured on the whitened values themselves, by central moments."""
    vectors = usable(table, key, embedding)
    fitted = fit(vectors)
    if fitted is None:
        names = "component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
        return table.sparkSession.createDataFrame([], T.StructType([vectors.schema["vec_id"], *T._parse_datatype_string(names).fields]))
    e, _, shares, _ = fitted.decompose(components)
    rows = written(project(vectors, fitted, components), "whitened")
    with_variance = [k for k in range(len(e)) if e[k] > 0]
    pairs = [(i, j) for i in with_variance for j in with_variance if i <= j]
    error = None
    if pairs:
        moments = rows.agg(*(F.covar_pop(F.get("w", F.lit(i)), F.get("w", F.lit(j))).alias(f"c{i}_{j}") for i, j in pairs)).first()
        error = max(abs(moments[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    explained = F.array(*(F.lit(float(s)) for s in shares))
    out = rows.select("vec_id", "deviation", F.posexplode("w").alias("k", "whitened"))
    return out.select("vec_id", (F.col("k") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("k")).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
