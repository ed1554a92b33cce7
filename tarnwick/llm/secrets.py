"""Secret scans: the regexes of all rules as one minimised automaton, which reads each byte once.

Most texts match no rule, and the one pass says so. For the rules that do match, an automaton of the reversed regex
marks where matches can start, and one of the regex itself measures them: the spans are the leftmost, longest ones
that don't overlap another of their kind. A rule may then ask for a least length; spans that fail it are dropped.

Null and empty texts have no spans. Rows are kept as they are, repeated ones too; null ids stay null; further columns
are ignored by the report and kept by the redaction.
"""

from __future__ import annotations

import functools
import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tarnwick.llm.automaton import Automaton, compile_trees, parse, reversed_tree
from tarnwick.llm.common import raw_texts, slices, text_of


@dataclass(frozen=True)
class Rule:
    """``head`` and ``body`` follow each other; the part after the head's longest match has ``least`` bytes or more. Spans
    go on over the longest match of ``tail`` that follows, if there is one."""

    kind: str
    head: str
    body: str
    least: int = 0
    base: bool = False
    tail: str = ""


_LABEL = r"(RSA |EC |DSA |OPENSSH |ENCRYPTED |PGP )?PRIVATE KEY( BLOCK)?-----"
#: A line's end, also one that is escaped.
_EOL = r"(\r?\n|(\\r)?\\n)"
#: What follows the first line of a key: all up to its END line, with no other such line between; without an END line,
#: the header lines and the runs of base64 in lines of 16 or more, with the shorter line after them.
_KEY = (
    rf"(-{{0,4}}[^-])*-----END {_LABEL}"
    rf"|(({_EOL}(Proc-Type|DEK-Info|Version|Comment|Hash|Charset):[^\n\\]*)+{_EOL})?((\s|\\[nr])*[A-Za-z0-9+/=]{{16,}})+({_EOL}[A-Za-z0-9+/=]+)?"
)

#: The rules in the order in which their kinds are listed.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", r"[A-Za-z0-9+/_.=-]+", 12, True),
    Rule("access", "", r"AKIA[A-Z0-9]+", 18, True),
    Rule("hex", "", r"[0-9a-f]{16,}", 16, True),  # the same spans as of [0-9a-f]+ with 16 characters or more
    Rule("private_key", "", f"-----BEGIN {_LABEL}", tail=_KEY),
    Rule("github", "gh[oprsu]_", r"[A-Za-z0-9]+", 36),
    Rule("slack", "xox[abeoprs]-", r"[A-Za-z0-9-]+", 10),
    Rule("google", "AIza", r"[A-Za-z0-9_-]+", 35),
    Rule("payment", "sk_live_", r"[A-Za-z0-9]+", 16),
    Rule("bearer", r"(?i:authorization)\x20*:\x20*(?i:bearer)\x20+", r"[A-Za-z0-9+/_.=~-]+", 20),
)


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        whole = [("then", [parse(r.head), parse(r.body)]) for r in rules]
        self.rules = rules
        self.all = compile_trees(whole, True)
        self.starts: list[Automaton] = [compile_trees([reversed_tree(t)], True) for t in whole]
        self.lengths: list[Automaton] = [compile_trees([t], False) for t in whole]
        self.heads: list[Automaton] = [compile_trees([parse(r.head)], False) for r in rules]
        self.tails: list[Automaton | None] = [compile_trees([parse(r.tail)], False) if r.tail else None for r in rules]

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """Start, rule and end in code points, by start and rule."""
        found = self.all.hits(data)
        out = []
        for k, rule in enumerate(self.rules):
            if not found >> k & 1:
                continue
            cursor, n = 0, len(data)
            for start in reversed([n - e for e in self.starts[k].ends(data[::-1])]):
                if start < cursor:
                    continue
                end = self.lengths[k].longest(data, start)
                if end <= start:
                    continue
                if self.tails[k]:
                    end = max(end, self.tails[k].longest(data, end))
                cursor = end
                if end - self.heads[k].longest(data, start) >= rule.least:
                    out.append((start, k, end))
        if out and not data.isascii():
            place = lambda i: len(data[:i].decode())
            out = [(place(a), k, place(b)) for a, k, b in out]
        return sorted(out)


@functools.lru_cache(4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    """One scanner in each Python worker."""
    return Scanner(rules)


def report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the number of spans of each base kind (n_...), base_sha256 and spans, of every text."""
    docs = text_of(docs)
    base = [k for k, r in enumerate(rules) if r.base]
    names = [*(f"n_{rules[k].kind}" for k in base), "base_sha256", "spans"]
    kinds = [*(pa.int64() for _ in base), pa.string(), pa.string()]

    def each(batches):
        find = scanner(rules).spans
        say = lambda spans: ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in spans)
        for rows in slices(batches):
            columns = [[] for _ in names]
            for data in raw_texts(rows.column("text")):
                spans = find(data)
                own = [s for s in spans if rules[s[1]].base]
                values = [*(sum(s[1] == k for s in own) for k in base), hashlib.sha256(say(own).encode()).hexdigest(), say(spans)]
                for column, v in zip(columns, values):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *map(pa.array, columns, kinds)], names=["doc_id", *names])

    return docs.mapInArrow(each, T.StructType([docs.schema["doc_id"], *(T.StructField(n, T.LongType() if k == pa.int64() else T.StringType()) for n, k in zip(names, kinds))]))


def redact(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """The same rows with [kind] in the place of each secret, and n_chars counted anew where it changed; overlapping
    spans become one mark, of the first kind."""
    names = docs.columns
    count = n_chars if n_chars in names else None

    def each(batches):
        find = scanner(rules).spans
        for rows in slices(batches):
            data = rows.column(text).to_pylist()
            changed = {}
            for i, t in enumerate(data):
                if t and (spans := find(t.encode())):
                    out, at = [], 0
                    for a, k, b in spans:
                        if a >= at:
                            out += [t[at:a], f"[{rules[k].kind}]"]
                        at = max(at, b)
                    changed[i] = "".join(out) + t[at:]
            columns = [rows.column(n) for n in names]
            for j, name in enumerate(names):
                if changed and name == text:
                    columns[j] = pa.array([changed.get(i, t) for i, t in enumerate(data)], columns[j].type)
                elif changed and name == count:
                    columns[j] = pa.array([len(changed[i]) if i in changed else n for i, n in enumerate(columns[j].to_pylist())], columns[j].type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(each, docs.schema)
