"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Each byte prefix of a piece has exactly one token that can end its encoding: the one whose pairing with the last token
of the prefix before it is stable, that is, no merge across their boundary would have come first. Storing that token
for each prefix gives the encoding of every prefix at once, makes appending exact, and lets an edit re-encode only
the pieces around it.

Null and empty texts encode to no tokens. Rows are kept as they are, repeated ones too; null ids stay null; further
columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import functools
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarnwick.llm.common import Memo, single_spaced, text_of, texts
from tarnwick.llm.stretches import PATTERN, Stretches, class_table, spread


class Codec:
    """Encoder and decoder of one rank file (``base64-token rank`` lines) and one splitting pattern."""

    def __init__(self, path: str, pattern: str, bound: int = 250_000):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = [b""] * (max(self.rank.values()) + 1)
        for token, rank in self.rank.items():
            self.token[rank] = token
        self.pattern = regex.compile(pattern)
        self.tails = {t[i:] for t in self.rank for i in range(len(t))}
        self.halves: dict[int, tuple[int, int]] = {}
        for rank in sorted(self.rank.values()):
            self._halve(rank)
        self.last_of = Memo(None, bound, 24)
        self.piece = Memo(self._piece, bound)
        self.bare = Memo(self._pieces, bound // 4)
        self.spaced = Memo(lambda unit: self._pieces(" " + unit), bound)

    def _halve(self, rank: int) -> None:
        """The two tokens whose merge makes this one; a byte has none."""
        token = self.token[rank]
        for i in range(1, len(token)):
            a, b = self.rank.get(token[:i], rank), self.rank.get(token[i:], rank)
            if a < rank and b < rank and self.stable(a, b, rank):
                self.halves[rank] = a, b
                return

    def stable(self, a: int, b: int, limit: int | None = None) -> bool:
        """Whether the bytes of tokens a and b, side by side, encode to just these two (with merges below the limit)."""
        rank, token, halves = self.rank, self.token, self.halves
        limit = len(token) if limit is None else limit
        while True:
            across = rank.get(token[a] + token[b])
            if across is not None and across < limit:
                return False
            # Undo the later of the two merges. A merge left of the boundary wins a tie in rank, one right of it loses it.
            if a > b:
                if a not in halves:
                    return True
                limit, a = a, halves[a][1]
            else:
                if b not in halves:
                    return True
                limit, b = b + 1, halves[b][0]

    def lasts(self, piece: bytes, known: list[int] | None = None) -> list[int]:
        """For each prefix of a piece, the last token of its encoding; ``known`` holds those of a shorter prefix."""
        rank, tails, token = self.rank, self.tails, self.token
        last = known or []
        for end in range(len(last) + 1, len(piece) + 1):
            ending = []
            for start in range(end - 1, -1, -1):
                tail = piece[start:end]
                if tail not in tails:
                    break
                if (t := rank.get(tail)) is not None:
                    ending.append(t)
            for t in reversed(ending):
                before = end - len(token[t])
                if not before or self.stable(last[before - 1], t):
                    last.append(t)
                    break
            else:
                raise ValueError("the ranks don't cover every byte")
        return last

    def walk_back(self, last: list[int], end: int | None = None) -> list[int]:
        ids, end = [], len(last) if end is None else end
        while end:
            ids.append(last[end - 1])
            end -= len(self.token[ids[-1]])
        return ids[::-1]

    def _piece(self, text: str) -> bytes:
        return self._piece_ids(text.encode())

    def _piece_ids(self, piece: bytes) -> bytes:
        whole = self.rank.get(piece)
        if whole is not None:
            return array("I", [whole]).tobytes()
        known, at = [], 0
        for at in range(min(len(piece), 24), 0, -1):
            if (known := self.last_of.get(piece[:at]) or self.last_of.old.get(piece[:at])) is not None:
                break
        last = self.lasts(piece, list(known or []))
        if len(piece) > 3:
            self.last_of.keep(piece[: min(len(piece) - 2, 24)], tuple(last[: min(len(piece) - 2, 24)]))
        return array("I", self.walk_back(last)).tobytes()

    def _pieces(self, text: str) -> bytes:
        return b"".join(map(self.piece.__getitem__, self.pattern.findall(text)))

    def encode(self, text: str) -> bytes:
        """Ids as unsigned 32-bit integers, one after the other."""
        if not single_spaced(text):
            return self._pieces(text)
        first, *rest = text.split(" ")
        return self.bare[first] + b"".join(map(self.spaced.__getitem__, rest))

    @functools.cached_property
    def _stretches(self) -> Stretches:
        find = lambda pattern, text: (m.span() for m in regex.finditer(pattern, text))
        return Stretches(self._merge, lambda text: np.frombuffer(self._pieces(text), np.uint32), class_table(find), True)

    def _merge(self, data: np.ndarray, at: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of new pieces, by their prefixes' last tokens, and their number for each."""
        whole = data.tobytes()
        found = [self._piece_ids(whole[a:b]) for a, b in zip(at.tolist(), end.tolist())]
        count = np.array([len(f) // 4 for f in found], np.int64)
        return np.frombuffer(b"".join(found), np.uint32), count

    def encode_many(self, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Of slices of a column of texts (null: empty): where each begins, the ids of its texts, one after the other,
        and their number for each text. Equal stretches are encoded once; patterns of other kinds go text by text."""
        if self.pattern.pattern == PATTERN:
            yield from self._stretches.encode(column)
            return
        for at in range(0, len(column), 256):
            found = [self.encode(t) for t in texts(column.slice(at, 256))]
            yield at, np.frombuffer(b"".join(found), np.uint32), np.array([len(f) // 4 for f in found], np.int64)

    @functools.cached_property
    def _bytes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The tokens' bytes one after the other, where each begins, and its length."""
        length = np.array(list(map(len, self.token)), np.int64)
        return np.frombuffer(b"".join(self.token), np.uint8), np.cumsum(length) - length, length

    def decode_many(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids, one after the other, and where each id's begin and the last one's end."""
        data, first, length = self._bytes
        n = length[ids]
        return data[spread(first[ids], n)], np.append(0, np.cumsum(n))

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, memoryview(ids).cast("I").tolist()))


class Editable:
    """A text whose encoding is kept up to date, exactly, while it is appended to or edited."""

    def __init__(self, codec: Codec, text: str = ""):
        self.codec, self.text = codec, ""
        self.starts: list[int] = []
        self.lasts: list[list[int]] = []
        self.replace(0, 0, text)

    @property
    def ids(self) -> list[int]:
        return [i for last in self.lasts for i in self.codec.walk_back(last)]

    def prefix_ids(self, piece: int, n_bytes: int) -> list[int]:
        """The encoding of the first bytes of one piece, from the stored tokens alone."""
        return self.codec.walk_back(self.lasts[piece], n_bytes)

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, end: int, text: str) -> int:
        """Put a text in the place of code points start to end; returns how many pieces were encoded anew.

        A piece depends on at most two pieces' worth of text after it, so splitting starts again two pieces before the
        edit and ends at the first old boundary behind it that the new split also has.
        """
        old_starts, old_lasts, shift = self.starts, self.lasts, len(text) - (end - start)
        self.text = self.text[:start] + text + self.text[end:]
        first = max(0, bisect.bisect_right(old_starts, start) - 3)
        at = old_starts[first] if first < len(old_starts) else 0
        if not old_starts:
            first = at = 0
        starts, lasts, old_at, anew = old_starts[:first], old_lasts[:first], dict(zip(old_starts, range(len(old_starts)))), 0
        while at < len(self.text):
            if at >= start + len(text) and (k := old_at.get(at - shift)) is not None and at - shift >= end:
                starts += [s + shift for s in old_starts[k:]]
                lasts += old_lasts[k:]
                break
            found = self.codec.pattern.match(self.text, at)
            piece, known = found[0].encode(), None
            k = old_at.get(at) if at <= start else None
            if k is not None and k < len(old_lasts):  # what the piece shares with the old one here needs no work
                old = b"".join(map(self.codec.token.__getitem__, self.codec.walk_back(old_lasts[k])))
                n = next((i for i, (a, b) in enumerate(zip(old, piece)) if a != b), min(len(old), len(piece)))
                known = list(old_lasts[k][:n])
            starts.append(at)
            lasts.append(self.codec.lasts(piece, known))
            at, anew = found.end(), anew + 1
        self.starts, self.lasts = starts, lasts
        return anew


@functools.lru_cache(2)
def codec(path: str, pattern: str) -> Codec:
    """One codec in each Python worker."""
    return Codec(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Encodes every text and decodes the ids again: doc_id, ids (unsigned 32-bit, as binary), decoded (binary)."""
    return _mapped(docs, path, pattern, [("ids", T.BinaryType(), lambda ids, back: ids.tobytes()), ("decoded", T.BinaryType(), lambda ids, back: back.tobytes())])


def digest_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """The same, as doc_id, n_tokens, ids_sha256 and decoded_sha256; ids and bytes don't leave their task."""
    sha = lambda x: hashlib.sha256(x).hexdigest()
    return _mapped(docs, path, pattern, [("n_tokens", T.LongType(), lambda ids, back: len(ids)), ("ids_sha256", T.StringType(), lambda ids, back: sha(ids)), ("decoded_sha256", T.StringType(), lambda ids, back: sha(back))])


def _mapped(docs: DataFrame, path: str, pattern: str, columns: list) -> DataFrame:
    docs = text_of(docs)
    kinds = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def each(batches):
        c = codec(path, pattern)
        for rows in batches:
            for at, ids, n in c.encode_many(rows.column("text")):
                ids, ends = np.ascontiguousarray(ids, "<u4"), np.append(0, np.cumsum(n))
                back, places = c.decode_many(ids)
                cuts = list(zip(ends[:-1].tolist(), ends[1:].tolist(), places[ends[:-1]].tolist(), places[ends[1:]].tolist()))
                out = [pa.array([make(ids[a:b], back[x:y]) for a, b, x, y in cuts], kinds[t.simpleString()]) for _, t, make in columns]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id").slice(at, len(n)), *out], names=["doc_id", *(name for name, _, _ in columns)])

    return docs.mapInArrow(each, T.StructType([docs.schema["doc_id"], *(T.StructField(n, t) for n, t, _ in columns)]))
