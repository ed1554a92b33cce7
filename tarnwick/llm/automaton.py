"""Deterministic automata over bytes: regexes by subset construction, minimised, as transition arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ALL = frozenset(range(256))
CLASSES = {"d": frozenset(b"0123456789"), "s": frozenset(b" \t\n\r\f\v"), "w": frozenset(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz_")}


class _Parser:
    """Literals, escapes, classes, groups, (?:...), (?i:...), alternation and greedy repeats, to a tree of tuples."""

    def __init__(self, pattern: str):
        self.p, self.i, self.fold = pattern, 0, False

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def next(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def whole(self):
        tree = self.either()
        if self.i < len(self.p):
            raise ValueError(f"{self.p!r}: unexpected {self.peek()!r}")
        return tree

    def either(self):
        ways = [self.sequence()]
        while self.peek() == "|":
            self.next()
            ways.append(self.sequence())
        return ways[0] if len(ways) == 1 else ("or", ways)

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            part = self.atom()
            while self.peek() and self.peek() in "?*+{":
                part = ("times", part, *self.times())
            parts.append(part)
        return "then", parts

    def times(self) -> tuple[int, int | None]:
        c = self.next()
        if c != "{":
            return {"?": (0, 1), "*": (0, None), "+": (1, None)}[c]
        end = self.p.index("}", self.i)
        low, comma, high = self.p[self.i : end].partition(",")
        self.i = end + 1
        return int(low or 0), (int(high) if high else None) if comma else int(low)

    def folded(self, s: frozenset) -> tuple[str, frozenset]:
        letters = {b ^ 32 for b in s if chr(b).isascii() and chr(b).isalpha()} if self.fold else set()
        return "set", s | letters

    def atom(self):
        c = self.next()
        if c == "(":
            outer = self.fold
            if self.peek() == "?":
                flags, colon, _ = self.p[self.i + 1 :].partition(":")
                if not colon or flags not in ("", "i"):
                    raise ValueError(f"{self.p!r}: this kind of group isn't supported")
                self.fold, self.i = outer or flags == "i", self.i + len(flags) + 2
            tree = self.either()
            if self.peek() != ")":
                raise ValueError(f"{self.p!r}: a group has no end")
            self.next()
            self.fold = outer
            return tree
        if c == "[":
            return self.folded(self.klass())
        if c == ".":
            return "set", ALL - {10}
        if c == "\\":
            return self.folded(self.escape())
        encoded = c.encode()
        return self.folded(frozenset(encoded)) if len(encoded) == 1 else ("then", [("set", frozenset([b])) for b in encoded])

    def escape(self) -> frozenset:
        c = self.next()
        if c == "x":
            self.i += 2
            return frozenset([int(self.p[self.i - 2 : self.i], 16)])
        if c.lower() in CLASSES:
            return CLASSES[c] if c in CLASSES else ALL - CLASSES[c.lower()]
        return frozenset({"n": b"\n", "t": b"\t", "r": b"\r"}.get(c, c.encode()))

    def klass(self) -> frozenset:
        out, negated = set(), self.peek() == "^"
        if negated:
            self.next()
        first = True
        while first or self.peek() != "]":
            first = False
            c = self.next()
            one = self.escape() if c == "\\" else frozenset(c.encode())
            if self.peek() == "-" and self.p[self.i + 1 : self.i + 2] != "]" and len(one) == 1:
                self.next()
                c = self.next()
                (end,) = self.escape() if c == "\\" else c.encode()
                one = frozenset(range(min(one), end + 1))
            out |= one
        self.next()
        return frozenset(ALL - out if negated else out)


def reversed_tree(tree):
    kind = tree[0]
    if kind == "then":
        return "then", [reversed_tree(x) for x in tree[1][::-1]]
    if kind == "or":
        return "or", [reversed_tree(x) for x in tree[1]]
    return ("times", reversed_tree(tree[1]), *tree[2:]) if kind == "times" else tree


def parse(pattern: str):
    return _Parser(pattern).whole()


@dataclass
class Automaton:
    """``classes`` maps bytes to columns. ``step[s + column]`` is the next state; states are multiples of the number of
    columns, those from ``accepting`` on accept, and ``accepts[s]`` has a bit for each rule that does."""

    classes: bytes
    step: list[int]
    start: int
    accepting: int
    accepts: dict[int, int]

    def hits(self, data: bytes) -> int:
        """The rules that match somewhere, as bits."""
        step, s, limit, accepts, found = self.step, self.start, self.accepting, self.accepts, 0
        for c in data.translate(self.classes):
            s = step[s + c]
            if s >= limit:
                found |= accepts[s]
        return found

    def ends(self, data: bytes) -> list[int]:
        """Where a match ends, seen from the front."""
        step, s, limit, out = self.step, self.start, self.accepting, []
        for i, c in enumerate(data.translate(self.classes), 1):
            s = step[s + c]
            if s >= limit:
                out.append(i)
        return out

    def longest(self, data: bytes, at: int) -> int:
        """The end of the longest match that starts here, or -1. For an automaton that isn't searching."""
        step, classes, s, limit, end = self.step, self.classes, self.start, self.accepting, -1
        if s >= limit:
            end = at
        for i in range(at, len(data)):
            s = step[s + classes[data[i]]]
            if s >= limit:
                end = i + 1
            elif s == 0:  # the state that nothing leads out of
                break
        return end


def compile_trees(trees: list, searching: bool) -> Automaton:
    """One automaton for all trees; if searching, a match may start at any byte."""
    moves: list[list[tuple[frozenset, int]]] = []
    free: list[list[int]] = []

    def state() -> int:
        moves.append([])
        free.append([])
        return len(moves) - 1

    def build(tree, a: int) -> int:
        kind = tree[0]
        if kind == "set":
            b = state()
            moves[a].append((tree[1], b))
            return b
        if kind == "then":
            for x in tree[1]:
                a = build(x, a)
            return a
        if kind == "or":
            b = state()
            for x in tree[1]:
                s = state()
                free[a].append(s)
                free[build(x, s)].append(b)
            return b
        _, x, low, high = tree
        for _ in range(low):
            a = build(x, a)
        if high is None:
            loop = state()
            free[a].append(loop)
            free[build(x, loop)].append(loop)
            end = state()
            free[loop].append(end)
            return end
        out = state()
        for _ in range(high - low):
            free[a].append(out)
            a = build(x, a)
        free[a].append(out)
        return out

    root = state()
    final: dict[int, int] = {}
    for k, tree in enumerate(trees):
        s = state()
        free[root].append(s)
        end = build(tree, s)
        final[end] = final.get(end, 0) | 1 << k

    def closed(states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if moves[s] or s in final)

    sets = list(dict.fromkeys(s for m in moves for s, _ in m))
    of_byte = [tuple(b in s for s in sets) for b in range(256)]
    column = {c: i for i, c in enumerate(dict.fromkeys(of_byte))}
    example = [of_byte.index(c) for c in column]
    width = len(column)
    again = closed([root]) if searching else frozenset()
    known = {frozenset(): 0}
    start = known.setdefault(closed([root]), len(known))
    order, table = list(known), []
    for states in order:  # grows meanwhile
        row = []
        for byte in example:
            to = closed({t for s in states for on, t in moves[s] if byte in on}) | again
            if to not in known:
                known[to] = len(order)
                order.append(to)
            row.append(known[to])
        table.append(row)
    step = np.array(table)
    accepts = np.array([sum({final[s] for s in states if s in final}) if len({s for s in states if s in final}) < 2 else _union(final[s] for s in states if s in final) for states in order])
    # Minimise: split groups of states until the members of each lead to the same groups.
    group = np.unique(accepts, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([group, group[step]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    first = np.unique(group, return_index=True)[1]
    place = sorted(range(len(first)), key=lambda g: (accepts[first[g]] > 0, g != group[0]))  # accepting ones last, the dead one first
    new = {g: i * width for i, g in enumerate(place)}
    flat = [new[group[t]] for g in place for t in step[first[g]]]
    limit = sum(accepts[first[g]] == 0 for g in place) * width
    return Automaton(bytes(column[c] for c in of_byte), flat, new[group[start]], limit, {new[g]: int(accepts[first[g]]) for g in place if accepts[first[g]]})


def _union(bits) -> int:
    out = 0
    for b in bits:
        out |= b
    return out
