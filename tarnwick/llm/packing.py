"""Packing of token sequences into as few bins as can be, by bin completion.

Bins differ by the lengths they hold only, and there are at most ``capacity`` lengths however many documents there are.
So the corpus is reduced to a count for each length, bin completion works on the counts, and its result is a list of
fillings, each with the number of bins that get it. One filling uses up at least one length, so that there are no more
fillings than lengths, times the few that are broken up at the end; that bounds what is sent to the executors. Pieces
then find their place by their rank among the pieces of their length, which each task counts for itself.

Bin completion: around the largest length left, enumerate the undominated fillings of the rest of the bin, take each
in turn in order of waste, and drop a branch as soon as its waste exceeds what a better result could have. Best-fit
decreasing is the first incumbent. A search that ends is exact; the one limit, ``nodes``, bounds the fillings that it
tries. No row is left out, for an incumbent packs all.

Null and empty texts hold the end id alone. Repeated rows are packed as often as they occur; null ids stay null;
further columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tarnwick.llm.common import text_of, written
from tarnwick.llm.library_tokens import encoder

Filling = tuple[int, ...]


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Of the bins that any packing needs (Martello and Toth's second bound)."""
    if not counts:
        return 0
    n, size = np.zeros(capacity + 1, np.int64), np.arange(capacity + 1, dtype=np.int64)
    for s, c in counts.items():
        n[s] = c
    many, total = np.cumsum(n), np.cumsum(n * size)
    best = -(-int(total[-1]) // capacity)
    for k in range(capacity // 2 + 1):
        above = int(many[-1] - many[capacity - k])  # these share a bin with nothing of k or more
        half = int(many[capacity - k] - many[capacity // 2])
        room = half * capacity - int(total[capacity - k] - total[capacity // 2])
        small = int(total[capacity // 2] - (total[k - 1] if k else 0))
        best = max(best, above + half + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[Filling, int]]:
    """Best-fit decreasing, on counts: each length goes to the fullest bins that still hold it."""
    bins: dict[int, Counter] = {}  # by room left: how many bins of each filling
    rooms: list[int] = []

    def put(room: int, filling: Filling, n: int) -> None:
        if room not in bins:
            bins[room] = Counter()
            bisect.insort(rooms, room)
        bins[room][filling] += n

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            k = bisect.bisect_left(rooms, size)
            if k == len(rooms):
                per = capacity // size
                full, rest = divmod(left, per)
                if full:
                    put(capacity - per * size, (size,) * per, full)
                if rest:
                    put(capacity - rest * size, (size,) * rest, 1)
                break
            room = rooms[k]
            filling, there = next(iter(bins[room].items()))
            n, per = there, room // size
            if left < there * per:
                n, per = (left // per, per) if left >= per else (1, left)
            bins[room][filling] -= n
            if not bins[room][filling]:
                del bins[room][filling]
                if not bins[room]:
                    del bins[room]
                    rooms.pop(k)
            left -= n * per
            put(room - per * size, filling + (size,) * per, n)
    out: Counter = Counter()
    for at in bins.values():
        out.update(at)
    return [(f, n) for f, n in out.items() if n]


def reachable(counts: dict[int, int], room: int) -> tuple[list[int], list[int]]:
    """The lengths that fit, ascending, and for each number of them the sums up to ``room`` that they make, as bits."""
    sizes, mask = sorted(s for s, n in counts.items() if n and s <= room), (1 << (room + 1)) - 1
    sums = [1]
    for s in sizes:
        now, left, step = sums[-1], min(counts[s], room // s), 1
        if now >> s == mask >> s:  # all sums from here on are made, and longer ones make no others
            sums += [now] * (len(sizes) + 1 - len(sums))
            break
        while left:  # 1, 2, 4, ... of a length and the rest make up every number of it
            step = min(step, left)
            now |= now << (s * step) & mask
            left -= step
            step *= 2
        sums.append(now)
    return sizes, sums


def fillings(room: int, counts: dict[int, int], most_waste: int | None = None) -> Iterator[Filling | None]:
    """All undominated fillings of a room, least waste first, those with longer pieces before others; null in the place
    of a dominated one, so that a search can count these too.

    A filling is dominated if a length that is left could take the place of one of its own, or of none: swapping the two
    is no loss anywhere. Sums that can't be made are never entered, so that each filling costs a few steps only.
    """
    sizes, sums = reachable(counts, room)

    def make(k: int, total: int) -> Iterator[Filling]:
        if not total:
            yield ()
            return
        while k and sizes[k - 1] > total:
            k -= 1
        if not k or not sums[k] >> total & 1:
            return
        s = sizes[k - 1]
        for n in range(min(counts[s], total // s), -1, -1):
            for rest in make(k - 1, total - n * s):
                yield (s,) * n + rest

    for waste in range(min(room, room if most_waste is None else most_waste) + 1):
        if not sums[-1] >> (room - waste) & 1:
            continue
        for filling in make(len(sizes), room - waste):
            held = Counter(filling)
            longer = (x for s in {0, *held} for x in sizes[bisect.bisect_right(sizes, s) : bisect.bisect_right(sizes, s + waste)])
            yield None if any(counts[x] > held[x] for x in longer) else filling


def complete_bins(counts: dict[int, int], capacity: int, nodes: int = 4_000) -> list[tuple[Filling, int]]:
    """Fillings with the number of their bins: as few as can be, if the search ends within ``nodes``, the number of
    fillings that it may look at beyond the incumbent.

    Around the largest length left every undominated filling is tried, for as many bins as its lengths allow and for one
    bin, which leads to every number between. What is left is met again in many orders and is searched once only.
    """
    counts = {s: n for s, n in counts.items() if n}
    incumbent = best_fit(counts, capacity)
    least, bins, total = lower_bound(counts, capacity), sum(n for _, n in incumbent), sum(s * n for s, n in counts.items())
    if bins == least:
        return incumbent
    left, sizes, waste, used = dict(counts), sorted(counts), 0, 0
    names = np.random.default_rng(6)
    name = {s: int.from_bytes(names.bytes(16), "little") for s in counts}
    state, seen = sum(name[s] * n for s, n in left.items()), {}
    #: Of each step of the branch at hand: its filling, its bins, what else to try there.
    path: list[tuple[Filling, int, Iterator]] = []

    def options() -> Iterator[tuple[Filling, int] | None]:
        largest = sizes[-1]
        rest = {s: left[s] for s in sizes[: bisect.bisect_right(sizes, capacity - largest)]}
        if largest in rest:
            rest[largest] -= 1
        for f in fillings(capacity - largest, rest, (bins - 1) * capacity - total - waste):
            if f is None:
                yield None
                continue
            filling = (largest, *f)
            most = min(left[s] // c for s, c in Counter(filling).items())
            yield filling, most
            if most > 1:
                yield filling, 1

    def take(filling: Filling, n: int) -> None:
        nonlocal waste, used, state
        for s, c in Counter(filling).items():
            before = left[s]
            left[s] -= c * n
            state -= name[s] * c * n
            if not left[s]:
                sizes.pop(bisect.bisect_left(sizes, s))
            elif not before:
                bisect.insort(sizes, s)
        waste += n * (capacity - sum(filling))
        used += n

    todo = options()
    while nodes:
        nodes -= 1
        step = next(todo, ())
        if step is None:  # dominated
            continue
        if not step:  # all is tried here
            if not path:
                break
            filling, n, todo = path.pop()
            take(filling, -n)
            continue
        take(*step)
        worse = waste > (bins - 1) * capacity - total or seen.get(state, bins) <= used
        if not worse and not sizes:
            incumbent, bins = [(f, k) for f, k, _ in path] + [step], used
            if bins == least:
                break
            worse = True
        if worse:  # no better than the incumbent, however the rest is packed, or searched before
            take(step[0], -step[1])
        else:
            seen[state] = used
            path.append((*step, todo))
            todo = options()
    return incumbent


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, spaces: bool = False) -> DataFrame:
    """Each document's ids, with the end id, in pieces of at most ``capacity``; part and nth number the pieces of one
    length within a task's rows."""
    docs = text_of(docs)
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"]

    def each(batches):
        ended, part, seen = encoder(tokenizer, spaces).ended, TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for rows in batches:
            for at, ids, n in ended(rows.column("text"), end_id):
                pieces, before = -(-n // capacity), np.cumsum(n) - n
                of = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * capacity
                length = np.minimum(n[of] - start, capacity)
                flat, first = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B"), 4 * (before[of] + start)
                crc = [zlib.crc32(flat[a:b]) for a, b in zip(first.tolist(), (first + 4 * length).tolist())]
                order, many = np.argsort(length, kind="stable"), np.bincount(length, minlength=capacity + 1)
                nth = np.empty(len(of), np.int64)
                nth[order] = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(seen, many)
                seen += many
                columns = (piece.astype(np.int32), start, length, np.array(crc, np.int64), np.full(len(of), part, np.int32), nth)
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").take(pa.array(at + of)), *map(pa.array, columns)], names=names)

    kinds = (T.IntegerType(), T.LongType(), T.LongType(), T.LongType(), T.IntegerType(), T.LongType())
    return docs.mapInArrow(each, T.StructType([docs.schema["doc_id"], *map(T.StructField, names[1:], kinds)]))


def places(plan: list[tuple[Filling, int]]) -> tuple[np.ndarray, ...]:
    """For each length and filling: length, first rank, times in a bin, first bin, place in the bin; by length and rank."""
    rows, ranks, first = [], Counter(), 0
    for filling, n in plan:
        offset = 0
        for size, times in sorted(Counter(filling).items(), reverse=True):
            rows.append((size, ranks[size], times, first, offset))
            ranks[size] += times * n
            offset += size * times
        first += n
    rows.sort()
    return tuple(np.array(rows, np.int64).reshape(-1, 5).T)


def pack(pieces: DataFrame, capacity: int, nodes: int = 4_000) -> DataFrame:
    """Adds sequence_id and offset to written token pieces; takes their part and nth."""
    by_part = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = by_part.select("part", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # a row for each length
    size, rank, times, first, offset = places(complete_bins(counts, capacity, nodes))
    kept = [f for f in pieces.schema if f.name not in ("part", "nth")]

    def each(batches):
        big = np.int64(1) << 40
        for rows in batches:
            length, r = rows.column("length").to_numpy(), rows.column("rank").to_numpy()
            k = np.searchsorted(size * big + rank, length * big + r, "right") - 1
            bin_, nth = np.divmod(r - rank[k], times[k])
            yield pa.RecordBatch.from_arrays([*(rows.column(f.name) for f in kept), pa.array(first[k] + bin_), pa.array(offset[k] + nth * length)], names=[*(f.name for f in kept), "sequence_id", "offset"])

    ranked = pieces.join(before, ["part", "length"]).select(*(f.name for f in kept), (F.col("nth") + F.col("before")).alias("rank"))
    return ranked.mapInArrow(each, T.StructType([*kept, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, nodes: int = 4_000) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id and offset."""
    return pack(written(token_pieces(docs, tokenizer, capacity, end_id), "pieces"), capacity, nodes)
