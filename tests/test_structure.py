"""Numbering schemes and dispositions of small documents, written out by hand."""

from tarnwick.operators import structure

DECIMAL = [
    ("heading", 1, "Terms of Supply"),
    ("heading", 2, "1 Purpose"),
    ("paragraph", 0, "1.1 The Supplier shall deliver the Goods."),
    ("paragraph", 0, "and shall do so on time."),
    ("paragraph", 0, "(a) by road; or"),
    ("paragraph", 0, "(b) by rail."),
    ("paragraph", 0, "Page 2 of 9"),
    ("paragraph", 0, "1.2 The Customer shall pay."),
    ("heading", 2, "2 Fees"),
    ("paragraph", 0, "Fees are set out below."),
    ("paragraph", 0, "2.1 Fees are 1.25 times the base."),
    ("paragraph", 0, "2.1 Fees are due at once."),
    ("paragraph", 0, "1.25 times the base is the most."),
    ("paragraph", 0, "IN WITNESS WHEREOF the parties have signed."),
]
ARTICLES = [
    ("paragraph", 0, "SERVICE AGREEMENT"),
    ("paragraph", 0, "WHEREAS the Customer wants it,"),
    ("paragraph", 0, "ARTICLE IV Payment"),
    ("paragraph", 0, "(a) stray letter"),
    ("paragraph", 0, "1. The Customer shall pay."),
    ("paragraph", 0, "2. The Supplier shall bill."),
    ("paragraph", 0, "Clause 7 The Supplier shall keep records of all its work for ten years after the end of the term."),
    ("paragraph", 0, "ARTICLE V Ending"),
    ("paragraph", 0, "1. The Customer may end this."),
]
LETTERED = [
    ("paragraph", 0, "RULES"),
    ("paragraph", 0, "Some words first."),
    ("paragraph", 0, "CONDUCT"),
    ("paragraph", 0, "(h) Eight is this."),
    ("paragraph", 0, "(i) Nine is this."),
    ("paragraph", 0, "• and a bullet"),
    ("paragraph", 0, "DRESS"),
    ("paragraph", 0, "(i) Nine again is this."),
    ("paragraph", 0, "(ii) Two is this."),
    ("paragraph", 0, " (a) inside it"),
]
PROSE = [("paragraph", 0, "One day there was something."), ("paragraph", 0, None), ("paragraph", 0, "Then nothing more of it."), ("paragraph", 0, "- as said"), ("paragraph", 0, "Running head"), ("paragraph", 0, "Running head"), ("paragraph", 0, "Running head")]


def table(spark, **docs):
    return spark.createDataFrame([(n, k, *p) for n, ps in docs.items() for k, p in enumerate(ps)], "doc_id string, pos int, kind string, level int, text string")


def told(spark, name, paragraphs):
    rows = structure.dispositions(table(spark, **{name: paragraphs}, other=PROSE)).where(f"doc_id = '{name}'").orderBy("pos").collect()
    return [(r["disposition"], r["section_id"], r["clause_id"], (r["id_source"] or "")[:3]) for r in rows]


def test_schemes(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in structure.schemes(structure.marked(table(spark, a=DECIMAL, b=ARTICLES, c=LETTERED, d=PROSE))).collect()}
    assert got == {"a": ("decimal-outline", "decimal-head", "decimal"), "b": ("numbered-clauses+recitals", "article", "numbered"), "c": ("lettered-subparagraphs", "heading", "lettered"), "d": ("unstructured-prose", "none", "paragraph")}


def test_decimal(spark):
    assert told(spark, "a", DECIMAL) == [
        ("title", None, None, ""),
        ("heading", "CL-1", None, ""),
        ("clause", "CL-1", "CL-1.1", "doc"),
        ("continuation", "CL-1", "CL-1.1", ""),
        ("subparagraph", "CL-1", "CL-1.1", ""),
        ("subparagraph", "CL-1", "CL-1.1", ""),
        ("furniture", None, None, ""),
        ("clause", "CL-1", "CL-1.2", "doc"),
        ("heading", "CL-2", None, ""),
        ("clause", "P-2", "P-2.1", "syn"),
        ("clause", "CL-2", "CL-2.1", "doc"),
        ("clause", "CL-2", "CL-2.1.1", "syn"),
        ("clause", "P-2", "P-2.2", "syn"),
        ("clause", "EX-1", "EX-1.1", "syn"),
    ]


def test_articles(spark):
    assert told(spark, "b", ARTICLES) == [
        ("title", None, None, ""),
        ("recital", "R-1", "R-1.1", "syn"),
        ("heading", "ART-4", None, ""),
        ("unassigned", None, None, ""),
        ("clause", "CL-1", "CL-1.1", "der"),
        ("clause", "CL-2", "CL-2.1", "der"),
        ("clause", "CL-7", "CL-7.1", "der"),
        ("heading", "ART-5", None, ""),
        ("clause", "CL-1", "CL-1.2", "syn"),
    ]


def test_letters(spark):
    assert told(spark, "c", LETTERED) == [
        ("title", None, None, ""),
        ("clause", "P-0", "P-0.1", "syn"),
        ("heading", "P-1", None, ""),
        ("clause", "P-1", "P-1.8", "der"),
        ("clause", "P-1", "P-1.9", "der"),
        ("subparagraph", "P-1", "P-1.9", ""),
        ("heading", "P-2", None, ""),
        ("clause", "P-2", "P-2.9", "der"),  # a heading doesn't end the letters' sequence
        ("clause", "P-2", "P-2.2", "der"),
        ("subparagraph", "P-2", "P-2.2", ""),
    ]


def test_prose(spark):
    assert told(spark, "d", PROSE) == [("clause", "P-0", "P-0.1", "syn"), ("clause", "P-0", "P-0.2", "syn"), ("clause", "P-0", "P-0.3", "syn"), ("subparagraph", "P-0", "P-0.3", "")] + [("furniture", None, None, "")] * 3
