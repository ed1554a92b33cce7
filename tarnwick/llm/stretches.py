"""Ids of many texts at once: equal stretches between spaces are encoded once, and ids are gathered by arrays.

A batch of texts is split at its spaces and told apart by Arrow, so that no Python object is made for a stretch that
occurs again. A bounded cache holds the ids of short stretches in one array; those that it lacks are cut into pieces and
encoded many at a time. Long ones are encoded where they occur and not kept. A cut before a space is exact unless white space lies on both sides of it: there, stretches are
joined to one before they're looked up.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Fixed value: the splitting pattern of the byte-level vocabularies, which ``piece_starts`` cuts by.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Classes of characters: letters, numbers, white space, all others.
LETTER, NUMBER, SPACE, OTHER = 1, 2, 3, 0
#: A stretch begins (ends) with white space or is empty; a text that holds it is encoded as a whole.
BEGINS, ENDS, WHOLE = 1, 2, 4
#: Characters that a batch's texts are taken by, and the longest stretch that is encoded together with others.
TOGETHER, LONGEST = 1 << 20, 96


class IntMap:
    """Non-negative integers by non-negative integer keys, looked up many at a time; -1 for other keys."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(len(keys) * 4).bit_length())
        self.keys, self.values = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        keys, values = keys.astype(np.int64), values.astype(np.int32)
        at = self._hash(keys)
        while len(keys):
            free = self.keys[at] < 0
            first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)[1]
            won = np.zeros(len(keys), bool)
            won[first] = True
            won &= free
            self.keys[at[won]], self.values[at[won]] = keys[won], values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._hash(keys)
        there = self.keys[at]
        out = np.where(there == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((there != keys) & (there >= 0))
        while len(left):
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[left]]
            hit = there == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (there >= 0)]
        return out


def class_table(find: Callable[[str, str], Iterable[tuple[int, int]]]) -> np.ndarray:
    """The class of each character up to U+FFFF. ``find(pattern, text)``: spans of the matches, by the library that
    splits texts, so that both have one opinion of every character."""
    every = "".join(chr(c) if not 0xD800 <= c < 0xE000 else "a" for c in range(1 << 16))
    out = np.full(1 << 16, OTHER, np.uint8)
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for a, b in find(pattern, every):
            out[a:b] = kind
    return out


def piece_starts(points: np.ndarray, unit: np.ndarray, table: np.ndarray, spaced: bool, single_numbers: bool) -> np.ndarray:
    """Where pieces begin in units that lie one after the other; ``unit``: where each begins. As the pattern
    's|'t|'re|'ve|'m|'ll|'d| ?letters| ?numbers| ?others|white space, all but its last before what isn't, cuts them.
    ``spaced``: each unit begins with a space that belongs to what follows; no other space precedes what isn't white."""
    kind, n = table[points], len(points)
    begins, after = np.zeros(n + 1, bool), np.zeros(n + 1, bool)
    begins[unit] = begins[n] = True
    after[unit + 1] = spaced  # the character after a unit's own space
    start = begins[:-1].copy()
    start[1:] |= (kind[1:] != kind[:-1]) & ~after[1:-1]
    if single_numbers:
        start |= kind == NUMBER
    blank = kind == SPACE  # the last of some white space is a piece of its own if something follows it
    start[:-1] |= blank[:-1] & ~blank[1:] & ~begins[1:-1]
    quote = np.flatnonzero((points == 39) & start)  # one that is attached to a space isn't a start
    if len(quote):
        pad = np.concatenate([points, [0, 0]])
        one, two = pad[quote + 1], pad[quote + 2]
        same = ~begins[quote + 1]
        also = same & ~begins[np.minimum(quote + 2, n)]
        short = same & np.isin(one, [ord(c) for c in "stmd"])
        long = also & (((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l")))
        for which, length in ((quote[short], 2), (quote[long], 3)):
            start[which + 1] = False
            start = np.append(start, True)
            start[which + length] = True
            start = start[:n]
    return start


def spread(at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The places at, at + 1, ... of as many elements as length says, for all in turn."""
    if not len(at):
        return np.zeros(0, np.int64)
    ends = np.cumsum(length, dtype=np.int64)
    kind = np.int32 if ends[-1] < 1 << 30 and int(at.max()) < 1 << 30 else np.int64
    out = np.repeat((at - (ends - length)).astype(kind), length)
    out += np.arange(ends[-1], dtype=kind)
    return out


def raw(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of large strings, and where each begins and the last one ends."""
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, np.int64)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data else np.zeros(0, np.uint8), at - at[0]


def points_of(data: np.ndarray) -> np.ndarray:
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.int64)


#: Bytes of the longest unit that is remembered; and random numbers for each place and byte, for two sums of 64 bits.
KEPT = 4 * LONGEST
_RANDOM = np.random.default_rng(20).integers(0, 1 << 64, (2, (KEPT + 1) * 256), np.uint64)


def digests(data: np.ndarray, at: np.ndarray, length: np.ndarray) -> np.ndarray:
    """128 random bits of each run of at most KEPT + 1 bytes: two rows of 64. Each place and byte has numbers of its own,
    so that different runs agree with a chance of 1 in 2^128."""
    out = np.zeros((2, len(at)), np.uint64)
    some = np.flatnonzero(length)
    if len(some):
        n = length[some]
        ends = np.cumsum(n)
        first = ends - n
        place = np.arange(ends[-1]) - np.repeat(first, n)
        byte = data if len(data) == ends[-1] else data[place + np.repeat(at[some], n)]
        key = place * 256 + byte
        for k in (0, 1):
            out[k, some] = np.add.reduceat(_RANDOM[k][key], first)
    return out


class Loose:
    """Ids of units that are too long to be remembered, for as long as a slice needs them. Their places are told from
    those of remembered ones by ``FROM``."""

    FROM = 1 << 40

    def __init__(self):
        self.ids, self.length, self.flags = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.uint8)

    def add(self, ids: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
        n = len(self.length)
        self.ids, self.length, self.flags = np.concatenate([self.ids, ids]), np.concatenate([self.length, length]), np.concatenate([self.flags, flags])
        return self.FROM + np.arange(n, len(self.length))


class Known:
    """A bounded store of ids by the digests of what they encode, and of flags. Full, it forgets what hasn't been asked
    for since it last was. ``bound``: entries; ``ids_bound``: ids of all of them."""

    def __init__(self, bound: int, ids_bound: int | None = None):
        self.bound, self.ids_bound, self.bits = bound, ids_bound or 8 * bound, int(bound * 2.5).bit_length()
        self._empty()

    def _empty(self) -> None:
        self.table = np.full(1 << self.bits, -1, np.int32)
        self.n = self.used_ids = 0
        self.key, self.at, self.length = np.zeros((2, 0), np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.flags, self.asked, self.ids = np.zeros(0, np.uint8), np.zeros(0, bool), np.zeros(0, np.uint32)

    def _home(self, key: np.ndarray) -> np.ndarray:
        return (key[0] >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, key: np.ndarray) -> np.ndarray:
        """The place of each, or -1."""
        at, out, left = self._home(key), np.full(key.shape[1], -1, np.int64), np.arange(key.shape[1])
        while len(left):
            slot = self.table[at]
            hit = slot >= 0
            left, slot, at = left[hit], slot[hit], at[hit]
            same = (self.key[0, slot] == key[0, left]) & (self.key[1, slot] == key[1, left])
            out[left[same]] = slot[same]
            left, at = left[~same], (at[~same] + 1) & ((1 << self.bits) - 1)
        self.asked[out[out >= 0]] = True
        return out

    def add(self, key: np.ndarray, ids: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """Keeps what isn't there yet; returns the places."""
        m, total = key.shape[1], len(ids)
        if self.n + m > len(self.at):
            more = max(self.n // 2, m, 1 << 12)
            self.key = np.concatenate([self.key, np.zeros((2, more), np.uint64)], 1)
            self.at, self.length, self.flags, self.asked = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.at, self.length, self.flags, self.asked))
        if self.used_ids + total > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(self.used_ids // 2, total), np.uint32)])
        place = np.arange(self.n, self.n + m)
        self.key[:, place], self.length[place], self.flags[place], self.asked[place] = key, length, flags, True
        self.at[place] = self.used_ids + np.cumsum(length) - length
        self.ids[self.used_ids : self.used_ids + total] = ids
        self.n, self.used_ids = self.n + m, self.used_ids + total
        if self.n * 2 > 1 << self.bits:
            self.bits = (self.n * 2).bit_length()
            self.table = np.full(1 << self.bits, -1, np.int32)
            self._enter(np.arange(self.n))
        else:
            self._enter(place)
        return place

    def _enter(self, place: np.ndarray) -> None:
        at = self._home(self.key[:, place])
        while len(place):
            free = self.table[at] < 0
            self.table[at[free]] = place[free]
            won = self.table[at] == place
            place, at = place[~won], (at[~won] + 1) & ((1 << self.bits) - 1)

    def forget(self) -> None:
        """If it's full. Places change."""
        if self.n <= self.bound and self.used_ids <= self.ids_bound:
            return
        kept = np.flatnonzero(self.asked[: self.n])
        if len(kept) > 0.7 * self.bound or self.length[kept].sum(dtype=np.int64) > 0.7 * self.ids_bound:
            kept = kept[:0]
        key, length, flags, ids = self.key[:, kept], self.length[kept], self.flags[kept], self.ids[spread(self.at[kept], self.length[kept])]
        self._empty()
        self.add(key, ids, length, flags)
        self.asked[:] = False


class Stretches:
    """Encodes columns of texts. ``merge(data, at, end)``: ids and their number for each piece of UTF-8. ``one(text)``:
    ids of any text, whole. ``table``: classes of characters. ``spaces``: whether white space is kept (a unit's own
    space then belongs to it) or dropped, and numbers are pieces by themselves. ``special``: strings whose texts have to
    be encoded as a whole. ``normal``: what is done to units first. ``bound``: units that are remembered."""

    def __init__(self, merge, one, table: np.ndarray, spaces: bool, special: tuple[str, ...] = (), normal=None, bound: int = 1_000_000):
        self.merge, self.one, self.table, self.spaces, self.special, self.normal = merge, one, table, spaces, special, normal
        self.blanks = frozenset(map(chr, np.flatnonzero(table == SPACE)))
        self.units, self.pieces, self.loose = Known(bound), Known(bound // 2), Loose()

    def _places(self, words: pa.Array, bare: bool = False) -> np.ndarray:
        """Where different units are known; bare ones have no space before them."""
        data, at = raw(words)
        long = np.diff(at) > KEPT
        if long.any():
            place, some = np.empty(len(words), np.int64), np.flatnonzero(~long)
            place[some] = self._places(words.take(pa.array(some)), bare)
            place[long] = self.loose.add(*self._learn(words.take(pa.array(np.flatnonzero(long))), bare))
            return place
        key = digests(data, at[:-1], np.diff(at))
        key[0] ^= np.uint64(bare)
        place = self.units.find(key)
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = self.units.add(key[:, new], *self._learn(words.take(pa.array(new)), bare))
        return place

    def _gather(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of places, one after the other, their number, and flags."""
        loose = place >= Loose.FROM
        if not loose.any():
            length = self.units.length[place]
            return self.units.ids[spread(self.units.at[place], length)], length, self.units.flags[place]
        kept, lost = place[~loose], place[loose] - Loose.FROM
        length, flags = np.empty(len(place), np.int64), np.empty(len(place), np.uint8)
        length[~loose], length[loose] = self.units.length[kept], self.loose.length[lost]
        flags[~loose], flags[loose] = self.units.flags[kept], self.loose.flags[lost]
        first, begins = np.cumsum(length) - length, np.cumsum(self.loose.length) - self.loose.length
        ids = np.empty(int(length.sum()), np.uint32)
        ids[spread(first[~loose], length[~loose])] = self.units.ids[spread(self.units.at[kept], length[~loose])]
        ids[spread(first[loose], length[loose])] = self.loose.ids[spread(begins[lost], length[loose])]
        return ids, length, flags

    def _learn(self, words: pa.Array, bare: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of units, their number, and flags."""
        data, at = raw(words)
        points = points_of(data)
        chars = np.append(0, np.cumsum((data & 0xC0) != 0x80))[at]  # where each unit begins, in characters
        empty = chars[1:] == chars[:-1]
        kind = np.append(self.table[np.minimum(points, 0xFFFF)], OTHER)
        blank_first, blank_last = ~empty & (kind[chars[:-1]] == SPACE), ~empty & (kind[chars[1:] - 1] == SPACE)
        flags = (BEGINS * (empty | blank_first) + ENDS * (empty & (not bare) | blank_last)).astype(np.uint8)
        odd = empty | (np.diff(chars) > LONGEST) | self.spaces & blank_first
        odd[np.searchsorted(chars, np.flatnonzero(points > 0xFFFF), "right") - 1] = True
        if self.special:
            whole = data.tobytes()
            for s in self.special:
                k = whole.find(s.encode())
                while k >= 0:
                    flags[np.searchsorted(at, k, "right") - 1] |= WHOLE
                    k = whole.find(s.encode(), k + 1)
        own = " " if self.spaces and not bare else ""
        some, rest = np.flatnonzero(~odd), np.flatnonzero(odd)
        ids, length = self._together(words.take(pa.array(some)), own)
        more = [self.one(own + w) for w in words.take(pa.array(rest)).to_pylist()]
        count = np.zeros(len(words), np.int64)
        count[some], count[rest] = length, [len(m) for m in more]
        out = np.zeros(int(count.sum()), np.uint32)
        first = np.cumsum(count) - count
        out[spread(first[some], length)] = ids
        for k, m in zip(rest, more):
            out[first[k] : first[k] + len(m)] = m
        return out, count, flags

    def _together(self, words: pa.Array, own: str) -> tuple[np.ndarray, np.ndarray]:
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if self.normal:
            words = self.normal(words)
        data, at = raw(words)
        if own:
            spaced = np.full(len(data) + len(words), 32, np.uint8)
            at = at + np.arange(len(at))
            letters = np.ones(len(spaced), bool)
            letters[at[:-1]] = False
            spaced[letters] = data
            data = spaced
        points = points_of(data)
        begins = np.flatnonzero((data & 0xC0) != 0x80)  # of each character, in bytes
        unit = np.searchsorted(begins, at[:-1])
        start = np.flatnonzero(piece_starts(points, unit, self.table, bool(own), not self.spaces))
        place = np.append(begins, len(data))
        a, b = place[start], place[np.append(start[1:], len(points))]
        if not self.spaces:
            kept = self.table[points[start]] != SPACE
            a, b, start = a[kept], b[kept], start[kept]
        of_unit = np.append(np.searchsorted(start, unit), len(start))
        if not len(start):
            return np.zeros(0, np.uint32), np.zeros(len(words), np.int64)
        key = digests(data, a, b - a)
        _, example, which = np.unique(key[0], return_index=True, return_inverse=True)
        if (key[1, example][which] != key[1]).any():  # never in practice
            example, which = np.arange(len(a)), np.arange(len(a))
        known = self.pieces.find(key[:, example])
        new = np.flatnonzero(known < 0)
        if len(new):
            known[new] = self.pieces.add(key[:, example[new]], *self.merge(data, a[example[new]], b[example[new]]), 0)
        count = self.pieces.length[known].astype(np.int64)[which]
        ids = self.pieces.ids[spread(self.pieces.at[known][which], count)]
        return ids, np.diff(np.append(0, np.cumsum(count))[of_unit])

    def _joined(self, units: list[str]) -> np.ndarray:
        """Ids of a text, with units joined where the cut between them isn't exact."""
        joined = [units[0]]
        for k, u in enumerate(units[1:]):
            if (k or joined[0]) and (not joined[-1] or joined[-1][-1] in self.blanks) and (not u or u[0] in self.blanks):
                joined[-1] += " " + u
            else:
                joined.append(u)
        told = pa.array(joined[1:], pa.large_string()).dictionary_encode()
        p = self._places(pa.array(joined[:1], pa.large_string()), True)
        p = np.concatenate([p, self._places(told.dictionary)[told.indices.to_numpy()]])
        return self._gather(p)[0]

    def encode(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of slices of a column of texts: where each begins, the ids of its texts, one after the other, and their number."""
        texts = pc.fill_null(column.cast(pa.large_string()), "")
        size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + TOGETHER, "right")))
            yield a, *self._slice(texts.slice(a, b - a))
            a = b
        pa.default_memory_pool().release_unused()  # workers live on, and several share an executor

    def _slice(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        self.units.forget()
        self.pieces.forget()
        self.loose = Loose()
        lists = pc.split_pattern(texts, " ")
        flat, first = lists.flatten(), lists.offsets.to_numpy()
        first = first - first[0]
        spaced = np.ones(len(flat), bool)
        if self.spaces:  # a text's first stretch has no space before it
            spaced[first[:-1]] = False
        told = flat.filter(pa.array(spaced)).dictionary_encode()
        place, index = self._places(told.dictionary), np.empty(len(flat), np.int32)
        index[spaced] = told.indices.to_numpy()
        if self.spaces:
            bare = flat.take(pa.array(first[:-1])).dictionary_encode()
            index[first[:-1]] = len(place) + bare.indices.to_numpy()
            place = np.concatenate([place, self._places(bare.dictionary, True)])
        ids, length, flags = self._gather(place)  # of what occurs here, near each other
        at = (np.cumsum(length) - length).astype(np.int32)
        n = length[index]
        count = np.add.reduceat(n, first[:-1], dtype=np.int64)
        special = self._special(flags, index, first) if flags.any() else ()
        if not len(special):
            return ids[spread(at[index], n)], count
        out, done = [], 0
        for k in special:
            p = slice(first[done], first[k])
            out.append(ids[spread(at[index[p]], n[p])])
            text = texts[int(k)].as_py()
            out.append(self.one(text) if any(s in text for s in self.special) else self._joined(text.split(" ")))
            count[k], done = len(out[-1]), k + 1
        p = slice(first[done], None)
        return np.concatenate([*out, ids[spread(at[index[p]], n[p])]]), count

    def _special(self, flags: np.ndarray, index: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The texts that hold a special string, or a cut that isn't exact."""
        flags = flags[index]
        special = flags & WHOLE > 0
        if self.spaces:
            inexact = (flags[:-1] & ENDS > 0) & (flags[1:] & BEGINS > 0)
            inexact[first[1:-1] - 1] = False  # between two texts
            special[1:] |= inexact
        return np.flatnonzero(np.logical_or.reduceat(special, first[:-1])) if special.any() else np.zeros(0, np.int64)
