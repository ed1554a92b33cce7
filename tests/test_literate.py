"""Literate files line by line: what belongs to a quotation, a block and a passage, what is wrong, and what a reviewer sees."""

from tarnwick.operators import literate

FILE = """> Module Sums
# Part C-1 and C-2.1 as we read them
| DOC-A C-1 (a.md:3)
| The first
|   clause.
| NO-CLAUSE: still quoted
Why it is so.
```catala
# ours
#[test]
| DOC-A C-9 (a.md:1)
```catala
```
```
| DOC-A C-2 (b.md:4)
| DOC-A C-3 (a.md:9)
| Third.

| note of ours
## C-4
```catala-metadata
x
```
```catala
y
```
| NO-CLAUSE: only sums
| our reason
```catala
z
```
| DOC-A C-4 (a.md:8)
```catala
open"""


def of(spark, *files):
    return literate.lines(spark.createDataFrame([(i, t, 0) for i, t in enumerate(files)], "file int, text string, line int"))


def test_lines(spark):
    assert [tuple(r) for r in of(spark, "a b\r\nc\n\nd\n", "", None, "\n").orderBy("file", "line").collect()] == [(0, 1, "a b"), (0, 2, "c"), (0, 3, ""), (0, 4, "d"), (3, 1, "")]


def test_blocks_and_quotations(spark):
    known = literate.classified(of(spark, FILE))
    got = {r["at_line"]: (r["ref"], r["cited_file"], r["cited_line"], r["text"]) for r in literate.quotations(known).collect()}
    assert got == {3: ("DOC-A C-1", "a.md", 3, "The first\n  clause.\nNO-CLAUSE: still quoted"), 15: ("DOC-A C-2", "b.md", 4, ""), 16: ("DOC-A C-3", "a.md", 9, "Third."), 32: ("DOC-A C-4", "a.md", 8, "")}
    rows = sorted(tuple(r)[1:] for r in literate.blocks(known).collect())
    assert rows == [(8, 13, "catala", 1, 3, None), (21, 23, "catala-metadata", 0, None, None), (24, 26, "catala", 0, None, None), (29, 31, "catala", 0, None, "only sums"), (33, 35, "catala", 1, 32, None)]


def test_fidelity(spark):
    clauses = spark.createDataFrame([("DOC-A C-1", "The first clause. NO-CLAUSE: still quoted", "a.md", 3), ("DOC-A C-2", "", "a.md", 4), ("DOC-A C-3", "Third", "a.md", 8)], "ref string, text string, file string, line int")
    far = "\n".join(["| DOC-A C-1 (a.md:3)", "| The first clause. NO-CLAUSE: still quoted", *["prose"] * 59, "```catala", "```", "| DOC-A C-1 (a.md:3)", "| The first clause. NO-CLAUSE: still quoted", *["prose"] * 58, "```catala", "```"])
    got = sorted(tuple(r) for r in literate.fidelity(of(spark, FILE, "no quotation", far), clauses).collect())
    assert got == [(0, 15, "wrong-file"), (0, 16, "quotation-drift"), (0, 16, "stale-line"), (0, 24, "unsourced-code"), (0, 32, "unknown-clause"), (1, 0, "unsourced-file"), (2, 62, "quote-too-far")]
    assert literate.fidelity(of(spark, ""), clauses).collect() == []


def test_packet(spark):
    rows = literate.packet(of(spark, FILE)).orderBy("line").collect()
    assert [r["text"] for r in rows if r["text"] is not None] == [
        "> Module Sums", "# C-1 C-2.1", "| DOC-A C-1 (a.md:3)", "| The first", "|   clause.", "| NO-CLAUSE", "```catala", "#[test]", "| DOC-A C-9 (a.md:1)", "```catala", "```",
        "| DOC-A C-2 (b.md:4)", "| DOC-A C-3 (a.md:9)", "| Third.", "", "## C-4", "```catala-metadata", "x", "```", "```catala", "y", "```", "| NO-CLAUSE", "```catala", "z", "```", "| DOC-A C-4 (a.md:8)", "```catala", "open",
    ]
    assert sum(r["removed"] for r in rows) == 7
