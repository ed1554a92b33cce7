"""Ids from a file of the tokenizers library, as the library gives them, many texts at a time.

The file's merges are applied to the pieces of all new stretches at once, in arrays: in each round every piece gets the
merge that comes first in the file of those that it allows, and of several places the first. Classes of characters come
from the library's own splitter. What doesn't fit (special tokens' strings, long stretches, characters beyond U+FFFF,
files of another kind) goes to the library itself.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tarnwick.llm.stretches import IntMap, Stretches, class_table, spread

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Symbols of a piece that are merged in arrays, and pieces to a block.
SYMBOLS, BLOCK = (1, 4, 8, 12, 16, 24, 32, 64, 1024), 4096
NEVER = np.int32(2**31 - 1)


def byte_characters() -> list[str]:
    """The characters that byte-level vocabularies write bytes with: printable ones as they are, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = (chr(0x100 + i) for i in range(256))
    return [chr(b) if b in plain else next(others) for b in range(256)]


class Merges:
    """Byte pair merges: ``symbol[b]`` and ``last[b]`` are the ids of byte b in a piece and at its end; ``merges`` has
    the ids of the pairs, in order, and of what they become."""

    def __init__(self, symbol: np.ndarray, last: np.ndarray, merges: np.ndarray):
        self.symbol, self.last, self.made = symbol.astype(np.int32), last.astype(np.int32), merges[:, 2].astype(np.int32)
        self.rank = IntMap(merges[:, 0].astype(np.int64) << 24 | merges[:, 1], np.arange(len(merges)))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        r = self.rank(a.astype(np.int64) << 24 | b)
        return np.where(r < 0, NEVER, r)

    def block(self, data: np.ndarray, at: np.ndarray, n: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Symbols (a column for each piece, -1 where there are none) of pieces of ``width`` bytes at most."""
        place = np.arange(width)[:, None]
        used = place < n
        s = self.symbol[data[np.minimum(at + place, len(data) - 1)]]
        ends = np.arange(len(n))
        s[n - 1, ends] = self.last[data[at + n - 1]]
        s[~used] = -1
        right = np.where(place + 1 < n, place + 1, width).astype(np.int16)
        left = np.where(used, place - 1, -1).astype(np.int16)
        r = np.full((width, len(n)), NEVER, np.int32)
        if width == 1:
            return s
        both = used[1:]
        r[:-1][both] = self.ranks(s[:-1][both], s[1:][both])
        out, live, m = s, np.arange(len(n)), len(n)
        k = np.arange(m, dtype=np.int32)
        while True:
            i = r.argmin(0).astype(np.int32) * np.int32(m) + k  # of the pair to merge, in the flattened arrays
            best = r.ravel()[i]
            go = np.flatnonzero(best != NEVER)
            if len(go) < 0.75 * m:  # go on with the others only
                out[:, live] = s
                live, best = live[go], best[go]
                s, r, left, right = (x.take(go, 1) for x in (s, r, left, right))  # contiguous, unlike x[:, go]
                i, m = i[go] // np.int32(m) * np.int32(len(go)), len(go)
                k = np.arange(m, dtype=np.int32)
                i += k
                if not m:
                    return out
                j = k
            elif len(go) < m:
                i, j, best = i[go], k[go], best[go]
            else:
                j = k
            fs, fr, fl, ft = s.reshape(-1), r.reshape(-1), left.reshape(-1), right.reshape(-1)
            mid = ft[i].astype(np.int32) * np.int32(m) + j
            after = ft[mid]
            new = self.made[best]
            fs[i], fs[mid], fr[mid], ft[i] = new, -1, NEVER, after
            more = np.flatnonzero(after < width)
            nxt = after[more].astype(np.int32) * np.int32(m) + j[more]
            fl[nxt] = (i[more] - j[more]) // np.int32(m)
            before = fl[i]
            less = np.flatnonzero(before >= 0)
            prv = before[less].astype(np.int32) * np.int32(m) + j[less]
            rank = self.ranks(np.concatenate([new[more], fs[prv]]), np.concatenate([fs[nxt], new[less]]))
            fr[i] = NEVER
            fr[i[more]] = rank[: len(more)]
            fr[prv] = rank[len(more) :]

    def __call__(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces of at most SYMBOLS[-1] bytes, and their number for each."""
        n = end - at
        count, found, smaller = np.zeros(len(n), np.int64), [], 0
        for width in SYMBOLS:
            of = np.flatnonzero((n > smaller) & (n <= width))
            smaller = width
            for k in range(0, len(of), BLOCK):
                p = of[k : k + BLOCK]
                s = self.block(data, at[p], n[p], width)
                there = s.T >= 0
                count[p] = there.sum(1)
                found.append((p, s.T[there]))
        out = np.zeros(int(count.sum()), np.uint32)
        first = np.cumsum(count) - count
        for p, ids in found:
            out[spread(first[p], count[p])] = ids
        return out, count


class LibraryEncoder:
    """Encodes whole texts as ``Tokenizer.encode(text, add_special_tokens=False)`` does.

    ``spaces``: whether the tokenizer keeps white space, as byte-level ones do, or drops it."""

    def __init__(self, path: str, spaces: bool, bound: int = 1_000_000):
        from tokenizers import Regex, Tokenizer, pre_tokenizers

        self.library, self.spaces = Tokenizer.from_file(path), spaces
        model = json.loads(self.library.to_str())["model"]
        vocabulary, pairs = model["vocab"], [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        suffix, written = model.get("end_of_word_suffix") or "", byte_characters()
        symbol = np.array([vocabulary.get(c, -1) for c in written])
        last = np.array([vocabulary.get(c + suffix, -1) for c in written])
        merges = np.array([(vocabulary[a], vocabulary[b], vocabulary[a + b]) for a, b in pairs]).reshape(-1, 3)
        self.merges = Merges(symbol, last, merges)
        if min(symbol.min(), last.min()) < 0 or bool(suffix) == spaces:
            raise ValueError(f"{path} doesn't hold the vocabulary of a byte-level tokenizer that {'keeps' if spaces else 'drops'} white space")
        special = tuple(t.content for t in self.library.get_added_tokens_decoder().values())
        find = lambda pattern, text: (span for _, span in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text))
        self.stretches = Stretches(self.merges, self.whole, class_table(find), spaces, special, self._normal if self.library.normalizer else None, bound)

    def whole(self, text: str) -> np.ndarray:
        (found,) = self.library.encode_batch_fast([text], add_special_tokens=False)
        return np.array(found.ids, np.uint32)

    def _normal(self, units: pa.Array) -> pa.Array:
        """As the file's normaliser has them. A zero character keeps them apart: nothing joins with it."""
        plain = pc.string_is_ascii(units)
        if pc.all(plain).as_py():
            return pc.ascii_lower(units)
        other = units.filter(pc.invert(plain)).to_pylist()
        normal = self.library.normalizer.normalize_str("\0".join(other)).split("\0")
        if len(normal) != len(other):  # some unit holds one itself
            normal = [self.library.normalizer.normalize_str(u) for u in other]
        return pc.replace_with_mask(pc.ascii_lower(units), pc.invert(plain), pa.array(normal, pa.large_string()))

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers, one after the other."""
        ((_, ids, _),) = self.stretches.encode(pa.array([text]))
        return ids.tobytes()

    def ended(self, column: pa.Array, end_id: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of slices of a column of texts (null: empty): where each begins, the ids of its texts, each with the end id,
        one after the other, and their number for each text."""
        for at, ids, count in self.stretches.encode(column):
            n = count + 1
            out = np.empty(len(ids) + len(n), np.uint32)
            own = np.ones(len(out), bool)
            own[np.cumsum(n) - 1] = False
            out[own], out[~own] = ids, end_id
            yield at, out, n


@functools.lru_cache(2)
def encoder(path: str, spaces: bool) -> LibraryEncoder:
    """One encoder in each Python worker."""
    return LibraryEncoder(path, spaces)
