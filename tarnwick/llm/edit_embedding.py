"""Document fingerprints by randomised edit embedding.

All texts are walked by the same random walk: at each step the current character is written down, and a random bit
that depends on the step and the character says whether to go on to the next one. Texts at a small edit distance fall
into step again after each edit, so their walks differ in few places: edit distance becomes Hamming distance. A
fingerprint keeps, of each span of steps from 2^k to 2^(k+1), a fixed number of random ones, as a digit made of the
character there (0: the walk was over). Likeness weighs the digits by the steps they stand for. Near-duplicates are
then found by bands of digits and verified by their likeness.

Null and empty texts have an empty fingerprint; two of those are alike (1), one is unlike all other texts (0). Rows
are kept as they are, repeated ones too, each followed by the next row in order of id and of the texts' hash; null ids
come first; further columns are ignored. A single document follows itself.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.llm.common import partitions, slices, text_of, texts, written

#: Steps of the first span, digits for each span, steps after which the walk's coins repeat.
FIRST, DIGITS, PERIOD = 32, 32, 4096
#: Texts that walk together.
TOGETHER = 1024


@functools.lru_cache(2)
def coins(seed: int) -> np.ndarray:
    """By step and character: whether the walk goes on. The end of a text (0) is never left."""
    out = np.random.default_rng(seed).integers(0, 2, (PERIOD, 256), np.uint8)
    out[:, 0] = 0
    return out


def span_bounds(k: int) -> tuple[int, int]:
    return (0, FIRST) if not k else (FIRST << (k - 1), FIRST << k)


@functools.lru_cache(64)
def sampled(seed: int, k: int) -> list[int]:
    """The steps of span k that the fingerprint keeps."""
    low, high = span_bounds(k)
    return sorted((low + np.random.default_rng([seed, k]).choice(high - low, DIGITS, replace=False)).tolist())


def signs(text: str) -> np.ndarray:
    """A number from 1 to 255 for each code point, and the end."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    out = np.zeros(len(points) + 1, np.uint8)
    out[:-1] = np.where(points < 128, points * 2 + 1, (points * np.uint32(2654435761) >> np.uint32(24)) | np.uint32(1)) & np.uint32(255)
    return out


def fingerprints(many: list[str], seed: int = 7) -> list[str]:
    """Of many texts, which walk in step with each other."""
    all_signs = [signs(t) for t in many]
    flat = np.concatenate(all_signs) if many else np.zeros(0, np.uint8)
    n = np.array([len(s) for s in all_signs], np.int64)
    at, who, go = np.cumsum(n) - n, np.arange(len(many)), coins(seed)
    digits = [[] for _ in many]
    step = k = 0
    while len(who):
        low, high = span_bounds(k)
        keep = np.zeros((len(who), DIGITS), np.uint8)
        seen = 0
        for stop in [*sampled(seed, k), high]:
            for j in range(step, stop):
                at += go[j % PERIOD][flat[at]]
            step = stop
            if stop < high:
                c = flat[at].astype(np.int64)
                keep[:, seen] = np.where(c > 0, 1 + (c * 7 + (c >> 4) * 3 + stop % 15) % 15, 0)
                seen += 1
        for i, row in zip(who.tolist(), keep):
            digits[i].append(row)
        k += 1
        going = flat[at] > 0
        at, who = at[going], who[going]
    return ["" if n[i] == 1 else "".join(map("0123456789abcdef".__getitem__, np.concatenate(d).tolist())).rstrip("0") for i, d in enumerate(digits)]


@functools.lru_cache(2)
def _weights(spans: int) -> np.ndarray:
    return np.repeat([float(span_bounds(k)[1] - span_bounds(k)[0]) for k in range(spans)], DIGITS)


def likeness(a: str, b: str) -> float:
    """The share of steps, as far as either walk went, at which both were at the same character (as estimated)."""
    if a == b:
        return 1.0
    n = max(len(a), len(b))
    x, y = (np.frombuffer(s.ljust(n, "0").encode(), np.uint8) for s in (a, b))
    w = _weights(24)[:n] * ((x != 48) | (y != 48))
    return float(w[x == y].sum() / w.sum())


def follow_each_other(docs: DataFrame) -> DataFrame:
    """Rows part, ahead, place and text: within a part in order, each followed by the next of all documents; the last
    row of a part, with ahead = 1, belongs to another part (after the last document: the first)."""
    spark = docs.sparkSession
    docs = text_of(docs).withColumn("place", F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))).withColumn("h", F.xxhash64("text"))
    n = partitions(spark)
    cuts = docs.agg(F.min("place").alias("first"), F.percentile_approx("place", [k / n for k in range(1, n)] or [0.5], 10_000).alias("cuts")).first()
    bounds = sorted(set(cuts["cuts"] or ()) - {cuts["first"]})
    of = F.size(F.filter(F.array(*(F.lit(b) for b in bounds)), lambda b: b <= F.col("place"))) if bounds else F.lit(0)
    first = F.lit(cuts["first"]).cast("long")
    docs = docs.withColumn("own", of)
    begins = F.array(*(F.lit(b) for b in bounds)) if bounds else F.array(first)
    earlier = F.when((F.col("own") > 0) & (F.col("place") == F.get(begins, F.col("own") - 1)), F.col("own") - 1)
    wraps = F.when(F.col("place") == first, F.lit(len(bounds)))
    entry = lambda part, ahead: F.struct(part.cast("int").alias("part"), F.lit(ahead).alias("ahead"))
    docs = docs.withColumn("e", F.explode(F.filter(F.array(entry(F.col("own"), 0), entry(earlier, 1), entry(wraps, 1)), lambda e: e["part"].isNotNull())))
    docs = docs.select("e.part", "e.ahead", "place", "h", "doc_id", "text")
    return docs.repartitionById(len(bounds) + 1, "part").sortWithinPartitions("part", "ahead", "place", "h")


def compare_with_edits(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next: each text against
    itself with its last half replaced by the beginning of the next document, and against that document."""
    rows = follow_each_other(docs)
    names = ["n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    id_type = pa.int64() if rows.schema["doc_id"].dataType == T.LongType() else None

    def finished(pairs, last):
        """Of rows that are each followed by the next; the last one has a fingerprint only."""
        own = [t for _, t in pairs]
        after = [*own[1:], last]
        halves = [len(t) // 2 for t in own]
        edited = [t[: len(t) - h] + x[:h] for t, x, h in zip(own, after, halves)]
        prints = fingerprints([*own, last, *edited], seed)
        fp, fp_edited = prints[: len(own) + 1], prints[len(own) + 1 :]
        columns = [
            [len(t) for t in own], [hashlib.sha256(e.encode()).hexdigest() for e in edited], fp[:-1], fp_edited,
            [likeness(a, b) for a, b in zip(fp, fp_edited)], [likeness(a, b) for a, b in zip(fp, fp[1:])],
        ]
        return pa.RecordBatch.from_arrays([pa.array([d for d, _ in pairs], id_type), *map(pa.array, columns, kinds)], names=["doc_id", *names])

    def each(batches):
        held, part, done, size = [], None, False, 0
        for batch in slices(batches):
            for p, ahead, doc_id, text in zip(batch.column("part").to_pylist(), batch.column("ahead").to_pylist(), batch.column("doc_id").to_pylist(), texts(batch.column("text"))):
                if p != part:
                    held, part, done, size = [], p, False, 0
                if done:
                    continue
                if held and (ahead or len(held) >= TOGETHER or size >= 8 << 20):
                    yield finished(held, text)
                    held, size = [], 0
                done = bool(ahead)
                held.append((doc_id, text))
                size += len(text)

    schema = T.StructType([rows.schema["doc_id"], *(T.StructField(n, {pa.int64(): T.LongType(), pa.string(): T.StringType(), pa.float64(): T.DoubleType()}[k]) for n, k in zip(names, kinds))])
    return rows.mapInArrow(each, schema)


def print_documents(docs: DataFrame, seed: int = 7) -> DataFrame:
    """doc_id and fingerprint of every text."""
    docs = text_of(docs)

    def each(batches):
        for rows in slices(batches, TOGETHER):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(fingerprints(texts(rows.column("text")), seed), pa.string())], names=["doc_id", "fingerprint"])

    return docs.mapInArrow(each, T.StructType([docs.schema["doc_id"], T.StructField("fingerprint", T.StringType())]))


def forest(prints: list[str], least: float) -> list[tuple[int, int, float]]:
    """Of fingerprints: pairs of places, with their likeness, that link all that is linked by pairs of ``least`` or more."""
    n = max(map(len, prints))
    digits = np.stack([np.frombuffer(p.ljust(n, "0").encode(), np.uint8) for p in prints])
    weights, used, root, out = _weights(24)[:n], digits != 48, np.arange(len(prints)), []
    for r in range(len(prints) - 1):
        rest = np.flatnonzero(root[r + 1 :] != root[r]) + r + 1
        same = ((digits[rest] == digits[r]) & used[r]) @ weights
        near = same / ((used[rest] | used[r]) @ weights)
        for k in np.flatnonzero(near >= least).tolist():
            if root[rest[k]] != root[r]:
                root[root == root[rest[k]]] = root[r]
                out.append((r, int(rest[k]), float(near[k])))
    return out


def near_pairs(docs: DataFrame, least: float = 0.8, band: int = 8, seed: int = 7, chunk: int = 512) -> DataFrame:
    """a, b and likeness: of the documents with equal digits in some band, pairs of likeness ``least`` or more that
    link all such pairs (a spanning forest of each bucket, not every pair of it).

    Copies count once, by their smallest id. All members of a bucket are compared with each other; buckets of more than
    ``chunk`` are dealt out by pairs of chunks. Documents that share no band aren't compared.
    """
    rows = written(print_documents(docs, seed).where("doc_id is not null and fingerprint != ''"), "prints")
    one = rows.groupBy("fingerprint").agg(F.min("doc_id").alias("doc_id"))
    bands = F.transform(F.sequence(F.lit(0), F.floor((F.length("fingerprint") - 1) / band).cast("int")), lambda i: F.struct(i.alias("i"), F.substring(F.col("fingerprint"), i * band + 1, F.lit(band)).alias("digits")))
    keyed = one.select("doc_id", "fingerprint", F.explode(bands).alias("band")).select("doc_id", "fingerprint", "band.i", "band.digits").where(F.length("digits") == band)
    sizes = keyed.groupBy("i", "digits").agg(F.count("*").alias("n")).where("n > 1").select("i", "digits", F.ceil(F.col("n") / chunk).cast("int").alias("chunks"))
    dealt = keyed.join(sizes, ["i", "digits"]).withColumn("own", F.pmod(F.xxhash64("fingerprint"), "chunks").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    group = ["i", "digits", "p", "q"]
    dealt = dealt.select("i", "digits", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "doc_id", "fingerprint")

    def each(batches):
        now, held, kind = None, [], None

        def found():
            links = forest([f for _, f in held], least) if len(held) > 1 else []
            pairs = [(*sorted((held[x][0], held[y][0])), near) for x, y, near in links]
            a, b, near = zip(*pairs) if pairs else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, kind), pa.array(b, kind), pa.array(near, pa.float64())], names=["a", "b", "likeness"])

        for batch in batches:
            kind = batch.column("doc_id").type
            for *key, doc_id, fp in zip(*(c.to_pylist() for c in batch.columns)):
                if key != now:
                    if len(held) > 1:
                        yield found()
                    now, held = key, []
                held.append((doc_id, fp))
        if len(held) > 1:
            yield found()

    id_type = docs.schema["doc_id"].dataType
    schema = T.StructType([T.StructField("a", id_type), T.StructField("b", id_type), T.StructField("likeness", T.DoubleType())])
    return dealt.repartition(partitions(docs.sparkSession), *group).sortWithinPartitions(*group, "doc_id").mapInArrow(each, schema).distinct()
