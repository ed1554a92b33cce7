"""Scores of a language model by context-tree weighting.

Each byte is eight binary decisions, and each decision has a tree of contexts: the 0 to ``depth`` bytes before it. A
node holds a Krichevsky-Trofimov estimate of its bits, and its weight against the nodes below it is what both would
have given to the training bits. Counts of a byte after ``depth`` bytes are all that training needs; Spark gathers
them over the corpus. Subtrees below each pair of last bytes are then mixed apart from each other, one after the other
in a task, which holds no more than one of them beyond a fixed number of rows; the nodes above them, of which there
are 65,535 at most, are mixed on the driver. The result is a table: the log probability of each byte in each context
that occurs.

A base score by word counts goes with it. The most frequent entries of either table, up to a fixed number, go to each
executor; all others are joined by a shuffle, so that nothing is left out at any size.

Null and empty texts are an end alone. Rows are kept as they are, repeated ones too; null ids train; further columns
are ignored; where there is nothing to learn from, every bit has probability one half.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.llm.common import partitions, raw_texts, slices, text_of, written

#: Entries that each executor gets, whatever the size of the corpus: some 20 MB and 10 MB.
HEAD_WINDOWS, HEAD_WORDS = 1 << 20, 200_000
#: The end of a text among words and bytes; neither occurs in one.
END_WORD, END = b"\n", 0xFF
#: Bytes whose windows a task counts at a time, and words it holds.
CHUNK, WORDS = 8 << 20, 300_000
#: Windows that a task mixes at a time, other than those of one pair of last bytes.
GROUPED = 1 << 19


def windows_of(data: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Every byte and end of the texts with the depth bytes before it, as numbers; and where each text begins."""
    pad = bytes([END])
    joined = np.frombuffer(pad * depth + b"".join(x + pad * depth for x in data), np.uint8)
    n = np.array([len(x) for x in data], np.int64)
    w = np.zeros(len(joined) - depth, np.int64)
    for k in range(depth + 1):
        w <<= 8
        w |= joined[k : k + len(w)]
    begins = np.cumsum(n + depth) - (n + depth)
    keep = np.ones(len(w), bool)
    for k in range(1, depth):
        at = begins + n + k
        keep[at[at < len(w)]] = False
    return w[keep], np.cumsum(n + 1) - (n + 1)


def counted(docs: DataFrame, trains: Column, depth: int) -> DataFrame:
    """word, window and n: how often each occurs in training texts; windows of the others come with their 0."""
    rows = text_of(docs).select("text", trains.alias("trains"))

    def each(batches):
        words: Counter = Counter()
        held: dict[bool, list[bytes]] = {True: [], False: []}
        size = {True: 0, False: 0}

        def say(keys=None, windows=None, n=None):
            k = len(n)
            return pa.RecordBatch.from_arrays([pa.array(keys if keys is not None else [b""] * k, pa.binary()), pa.array(windows if windows is not None else np.full(k, -1), pa.int64()), pa.array(n, pa.int64())], names=["word", "window", "n"])

        def flush_windows(side):
            unique, n = np.unique(windows_of(held[side], depth)[0], return_counts=True)
            held[side], size[side] = [], 0
            return say(windows=unique, n=n if side else np.zeros(len(n), np.int64))

        for part in slices(batches):
            for data, side in zip(raw_texts(part.column("text")), part.column("trains").to_pylist()):
                low = data.lower()
                held[side].append(low)
                size[side] += len(low) + 1
                if side:
                    words.update(low.split())
                    words[END_WORD] += 1
                if size[side] >= CHUNK:
                    yield flush_windows(side)
            if len(words) >= WORDS:
                yield say(keys=list(words), n=list(words.values()))
                words = Counter()
        for side in (True, False):
            if held[side]:
                yield flush_windows(side)
        if words:
            yield say(keys=list(words), n=list(words.values()))

    return rows.mapInArrow(each, "word binary, window long, n long").groupBy("word", "window").agg(F.sum("n").alias("n"))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Of numbers from 0.5 on."""
    y = x + 8
    shift = np.ones_like(x)
    for k in range(8):
        shift *= x + k
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def log_kt(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    return log_gamma(n0 + 0.5) + log_gamma(n1 + 0.5) - log_gamma(np.maximum(n0 + n1 + 1, 1)) - np.log(np.pi)


def bit_levels(window: np.ndarray, n: np.ndarray, depth: int):
    """For each of the eight decisions, the trees' nodes from the leaves up: yields the decision's bits, the leaf of
    each window and, by depth from ``depth`` to 2, (keys, n0, n1, log weighted probability, own share), and the parent
    of each node but the last ones."""
    byte, rest = window & 255, window >> 8
    turned = np.zeros_like(rest)  # the last byte first
    for k in range(depth):
        turned = turned << 8 | (rest >> (8 * k) & 255)
    for i in range(8):
        node, bit = (1 << i) | (byte >> (8 - i)), (byte >> (7 - i)) & 1
        keys, leaf = np.unique(turned << 8 | node, return_inverse=True)
        n1 = np.bincount(leaf, n * bit, len(keys))
        n0 = np.bincount(leaf, n, len(keys)) - n1
        log_w = log_kt(n0, n1)
        levels = [(keys, n0, n1, log_w, np.ones(len(keys)))]
        parents = []
        for _ in range(depth - 2):
            up, parent = np.unique(keys >> 16 << 8 | keys & 255, return_inverse=True)
            n0, n1, below = (np.bincount(parent, x, len(up)) for x in (n0, n1, log_w))
            own = log_kt(n0, n1)
            log_w = np.logaddexp(own, below) - np.log(2)
            levels.append((up, n0, n1, log_w, np.exp(own - log_w - np.log(2))))
            parents.append(parent)
            keys = up
        yield bit, leaf, levels, parents


def upper_nodes(key: np.ndarray, n0: np.ndarray, n1: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the nodes after one byte (key: that byte and the node) and what lies below them: by key, the probability
    that they and the root give together, and the weight that is left for what lies below."""
    own = log_kt(n0, n1)
    log_w = np.logaddexp(own, below) - np.log(2)
    share, node = np.exp(own - log_w - np.log(2)), key & 255
    m0, m1, under = (np.bincount(node, x, 256) for x in (n0, n1, log_w))
    top = log_kt(m0, m1)
    top_share = np.exp(top - np.logaddexp(top, under))[node]
    given, left = np.full(1 << 16, 0.5), np.zeros(1 << 16)
    given[key] = top_share * ((m1 + 0.5) / (m0 + m1 + 1))[node] + (1 - top_share) * share * (n1 + 0.5) / (n0 + n1 + 1)
    left[key] = (1 - top_share) * (1 - share)
    return given, left


def whole_groups(batches, least: int = GROUPED):
    """Of rows in order of group: arrays of window and n, each with all rows of the groups it has. A group of two last
    bytes has a window for each byte and each context before them, so its size has a bound whatever the corpus."""
    held, size = [], 0
    for rows in batches:
        if rows.num_rows:
            held.append(tuple(rows.column(c).to_numpy() for c in ("last", "window", "n")))
            size += rows.num_rows
            if size >= least and held[0][0][0] != held[-1][0][-1]:
                last, window, n = map(np.concatenate, zip(*held))
                end = int(np.searchsorted(last, last[-1]))
                yield window[:end], n[:end].astype(float)
                held, size = [(last[end:], window[end:], n[end:])], size - end
    if held:
        _, window, n = map(np.concatenate, zip(*held))
        yield window, n.astype(float)


def mixed(counts: DataFrame, depth: int) -> DataFrame:
    """window, n and log_p: the base-10 logarithm of the last byte's probability after the others."""
    spark = counts.sparkSession
    by_last = counts.where("window >= 0").select("window", "n", F.expr("shiftright(window, 8) & 65535").alias("last"))
    by_last = by_last.repartition(partitions(spark), "last").sortWithinPartitions("last")

    def tops(batches):
        for got in whole_groups(batches):
            for _, _, levels, _ in bit_levels(*got, depth):
                keys, n0, n1, log_w, _ = levels[-1]
                up, parent = np.unique(keys >> 16 << 8 | keys & 255, return_inverse=True)
                yield pa.RecordBatch.from_arrays([pa.array(up), *(pa.array(np.bincount(parent, x, len(up))) for x in (n0, n1, log_w))], names=["node", "n0", "n1", "log_w"])

    top = by_last.mapInArrow(tops, "node long, n0 double, n1 double, log_w double").groupBy("node").agg(*(F.sum(c).alias(c) for c in ("n0", "n1", "log_w"))).toArrow()
    sent = spark.sparkContext.broadcast(upper_nodes(*(c.to_numpy() for c in top.columns)))  # 2^16 numbers each

    def evaluate(batches):
        given, left = sent.value
        for window, n in whole_groups(batches):
            log_p = np.zeros(len(window))
            for bit, leaf, levels, parents in bit_levels(window, n, depth):
                keys, n0, n1, _, _ = levels[0]
                p, at = (n1 + 0.5) / (n0 + n1 + 1), np.arange(len(keys))
                for (_, m0, m1, _, own), parent in zip(levels[1:], parents):
                    at = parent[at]
                    p = own[at] * ((m1 + 0.5) / (m0 + m1 + 1))[at] + (1 - own[at]) * p
                up = keys >> 8 * depth << 8 | keys & 255
                p = given[up] + left[up] * p
                log_p += np.log10(np.where(bit == 1, p[leaf], 1 - p[leaf]))
            for k in range(0, len(window), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(window[k : k + 50_000]), pa.array(n[k : k + 50_000].astype(np.int64)), pa.array(log_p[k : k + 50_000])], names=["window", "n", "log_p"])

    return by_last.mapInArrow(evaluate, "window long, n long, log_p double")


def most_frequent(rows: DataFrame, most: int) -> DataFrame:
    """The rows of the largest n, at most so many: those of the sixteenths of a power of two that fit as a whole. A
    histogram of about a thousand rows finds them, without an order of all rows."""
    level = F.when(F.col("n") > 0, F.floor(F.log2("n") * 16)).otherwise(-1)
    at, seen = None, 0
    for r in rows.groupBy(level.alias("level")).count().orderBy(F.desc("level")).collect():
        seen += r["count"]
        if seen > most:
            break
        at = r["level"]
    return rows.where(level >= at if at is not None else F.lit(False))


class Slots:
    """Values by key, looked up for whole arrays: a table of slots, and a sorted one for keys that find theirs taken."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        bits = max(10, int(len(keys) * 4).bit_length())
        self.shift, self.by = np.uint64(64 - bits), np.uint64(0x9E3779B97F4A7C15)
        self.key, self.value = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits)
        slot = self.slot(keys)
        self.key[slot[::-1]], self.value[slot[::-1]] = keys[::-1], values[::-1]  # of several, the first stays
        late = np.flatnonzero(self.key[slot] != keys)
        late = late[np.argsort(keys[late])]
        self.late_key, self.late_value = keys[late], values[late]

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * self.by >> self.shift).astype(np.int64)

    def look(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Values, 0 for keys that aren't there, and the places of those."""
        slot = self.slot(keys)
        out = self.value[slot]
        miss = np.flatnonzero(self.key[slot] != keys)
        if not len(miss):
            return out, miss
        k = np.searchsorted(self.late_key, keys[miss])
        k = np.minimum(k, max(len(self.late_key) - 1, 0))
        there = self.late_key[k] == keys[miss] if len(self.late_key) else np.zeros(len(miss), bool)
        out[miss] = np.where(there, self.late_value[k] if len(self.late_key) else 0.0, 0.0)
        return out, miss[~there]


_tables: dict[int, tuple] = {}


def _table(broadcast) -> tuple[Slots, dict]:
    """Built once in each Python worker for each broadcast, whose value it keeps."""
    value = broadcast.value
    if id(value) not in _tables:
        window, log_p, words, log_c = value
        _tables.clear()
        _tables[id(value)] = Slots(window, log_p), dict(zip(words, log_c)), value
    return _tables[id(value)][:2]


def score(docs: DataFrame, trains: Column, depth: int = 4, head_windows: int = HEAD_WINDOWS, head_words: int = HEAD_WORDS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every text; ``trains`` says which of
    them train, by doc_id. ``depth`` is 2 to 6."""
    if not 2 <= depth <= 6:
        raise ValueError("contexts have two to six bytes")
    spark = docs.sparkSession
    trains = F.coalesce(trains, F.lit(True))
    counts = written(counted(docs, trains, depth), "counts")
    model = written(mixed(counts, depth), "model")
    words = counts.where("window = -1")
    total = words.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    train_tokens, scale = total["n"], float(np.log10(total["n"] + 0.5 * (total["v"] + 1)))
    log_half = float(np.log10(0.5))
    frequent = most_frequent(model, head_windows).select("window", "log_p").toArrow()
    common = most_frequent(words, head_words).select("word", F.log10(F.col("n") + 0.5).alias("log_c")).toArrow()
    sent = spark.sparkContext.broadcast((frequent.column("window").to_numpy(), frequent.column("log_p").to_numpy(), common.column("word").to_pylist(), common.column("log_c").to_pylist()))
    rows = text_of(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", (~trains).alias("held_out"), "text")
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "word", "window", "times"]

    def each(batches):
        slots, known = _table(sent)
        get = known.get
        for part in slices(batches, 128):
            data = [x.lower() for x in raw_texts(part.column("text"))]
            window, begins = windows_of(data, depth)
            log_p, away = slots.look(window)
            scores = np.add.reduceat(log_p, begins)
            n_tokens, n_known, base, rare = [], [], [], []
            number = part.column("row").to_pylist()
            for i, text in enumerate(data):
                tokens = text.split()
                tokens.append(END_WORD)
                got = list(map(get, tokens))
                missed = [t for t, g in zip(tokens, got) if g is None] if None in got else ()
                n_tokens.append(len(tokens))
                n_known.append(len(tokens) - len(missed))
                base.append(sum(g for g in got if g is not None) if missed else sum(got))
                rare += [(number[i], w, -1, n) for w, n in Counter(missed).items()]
            if len(away):
                of = np.searchsorted(begins, away, "right") - 1
                rare += [(number[i], b"", int(w), n) for (i, w), n in Counter(zip(of.tolist(), window[away].tolist())).items()]
            k, m = len(data), len(rare)
            nothing = lambda t: pa.nulls(m, t)
            own = pa.RecordBatch.from_arrays([part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array(base, pa.float64()), pa.array(scores), pa.array([b""] * k, pa.binary()), pa.array([-2 - r for r in number], pa.int64()), pa.array([0] * k, pa.int64())], names=names)
            yield own
            if m:
                r, w, x, n = zip(*rare)
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()), nothing(part.column("doc_id").type), nothing(pa.bool_()), nothing(pa.int64()), nothing(pa.int64()), nothing(pa.float64()), nothing(pa.float64()), pa.array(w, pa.binary()), pa.array(x, pa.int64()), pa.array(n, pa.int64())], names=names)

    kinds = [T.LongType(), rows.schema["doc_id"].dataType, T.BooleanType(), T.LongType(), T.LongType(), T.DoubleType(), T.DoubleType(), T.BinaryType(), T.LongType(), T.LongType()]
    scored = rows.mapInArrow(each, T.StructType(list(map(T.StructField, names, kinds))))
    # A document's own row has a window that no text has, so that these rows are spread as well as the rare ones.
    entries = words.select("word", "window", F.log10(F.col("n") + 0.5).alias("log_c"), F.lit(None).cast("double").alias("log_p"))
    entries = entries.union(model.select(F.lit(b"").alias("word"), "window", F.lit(None).cast("double"), "log_p"))
    joined = scored.join(entries, ["word", "window"], "left")
    rare_word = F.col("window") == -1
    out = joined.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("held_out").alias("held_out"),
        F.sum("n_tokens").alias("n_tokens"),
        (F.sum("n_known") + F.coalesce(F.sum(F.when(rare_word & F.col("log_c").isNotNull(), F.col("times"))), F.lit(0))).alias("n_known"),
        (F.sum("base") + F.coalesce(F.sum(F.when(rare_word, F.col("times") * F.coalesce("log_c", F.lit(log_half)))), F.lit(0.0))).alias("base"),
        (F.sum("score") + F.coalesce(F.sum(F.when(F.col("window") >= 0, F.col("times") * F.coalesce("log_p", F.lit(8 * log_half)))), F.lit(0.0))).alias("score"),
    )
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), (F.col("base") - F.col("n_tokens") * F.lit(scale)).alias("base_score"), "score")
