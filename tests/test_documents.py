"""Reading documents: values written out by hand."""

import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from tarnwick.operators import documents, retrieval


def values(spark, texts, column):
    rows = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return [r[1] for r in rows.select("i", column(F.col("text"))).orderBy("i").collect()]


def test_normalised(spark):
    cases = {
        "“Base” isn’t 5–6 — no": '"Base" isn\'t 5–6 — no',
        "a‐b‑c‒d―e−f": "a-b-c–d—e-f",
        "ofﬁce soft­hyphen ﬄ ﬆ": "office softhyphen ffl st",
        "a\r\nb\rc d e": "a\nb\nc\nd\n\ne",
        "x  y\tz 　w": "x y z w",
        "\n\n one  two  \n\n\n\n       three\n \t \nfour \x0b\n": " one two\n\n    three\n\nfour",
        "one\ftwo…": "one\n\ntwo...",
        "reason-\nable": "reason-\nable",
        " \t\n ": "",
        "": "",
        None: None,
    }
    assert values(spark, cases, documents.normalised) == list(cases.values())
    assert values(spark, cases, lambda t: documents.normalised(documents.normalised(t))) == list(cases.values())


def test_rejoined(spark):
    cases = {"reason-\nable": "reasonable", "Client-\nBillable": "Client-\nBillable", "pro-rated": "pro-rated", "10-\n12": "10-\n12", "a-\nbc": "a-\nbc", None: None}
    assert values(spark, cases, documents.rejoined) == list(cases.values())


def test_tokens(spark):
    cases = {
        "don't C 1,000 99.90%": ["don't", "1000", "99.9"],
        "£75 and 98.50 or 98.5, C-4.2 5% Tier 12": ["75", "and", "98.5", "or", "4.2", "tier", "12"],
        "well-known- 0.0 10.00 100 x": ["well-known", "0", "10", "100"],
        "1.2.30 7,5": ["1.2.3", "75"],
        "": [],
        None: None,
    }
    assert values(spark, cases, retrieval.tokens) == list(cases.values())


@pytest.mark.parametrize(
    ("text", "score", "label"),
    [
        ("", 0, "PROSE"),
        (None, 0, "PROSE"),
        ("The Employee is entitled to 25 days.", 4, "RULE"),  # entitled 2, duration 1, number 1
        ("A fee of £500 is payable within 10 days.", 9, "RULE"),  # money 2, entitled 2, threshold 2, duration 1, numbers 2
        ("Where it is reasonable, a fee of £500 is payable within 10 days.", 7 + 2, "HYBRID"),
        ("Within 3 days.", 4, "RULE"),
        ("It lasts 3 years; 4 people.", 3, "RULE"),
        ('"Service Year" means 12 months; 2 halves.', 3, "PROSE"),  # a definition of three points
        ('"Service Year" means a term of 12 months, rounded.', 4, "RULE"),
        ("The Company acts in good faith.", 0, "PROSE"),
        ("The purpose of this Annex is 3 days, plus.", 4, "PROSE"),  # boilerplate
        ("The purpose of this Annex is £3, plus 2%.", 8, "RULE"),
        ("Costs are multiplied by 2 and not less than the aggregate of 1 and 3.", 9, "RULE"),
    ],
)
def test_triage(spark, text, score, label):
    row = spark.createDataFrame([(text,)], "text string").select(*[c.alias(k) for k, c in documents.triage(F.col("text")).items()]).first()
    assert (row["score"], row["label"]) == (score, label)


def test_after_scan(spark):
    state = [("same", "f", "done", None), ("moved", "f", "failed", None), ("gone", "f", "done", None), ("away", "f", "removed", "failed"), ("back", "f", "removed", "done"), ("checking", "f", "removed", "checking"), ("unknown", "f", "removed", None), ("changed", "f", "removed", "done")]
    seen = [("same", "f", None), ("moved", "g", None), ("back", "f", None), ("checking", "f", None), ("unknown", "f", None), ("changed", "g", None), ("new", "f", None), ("bad", "f", "no text")]
    was = spark.createDataFrame(state, "key string, fingerprint string, status string, removed_from string")
    now = spark.createDataFrame(seen, "key string, fingerprint string, error string")
    got = {r["key"]: (r["fingerprint"], r["status"], r["removed_from"]) for r in documents.after_scan(was, now).collect()}
    assert got == {
        "same": ("f", "done", None), "moved": ("g", "pending", None), "gone": ("f", "removed", "done"), "away": ("f", "removed", "failed"),
        "back": ("f", "done", None), "checking": ("f", "pending", None), "unknown": ("f", "pending", None), "changed": ("g", "pending", None),
        "new": ("f", "pending", None), "bad": ("f", "unreadable", None),
    }
    empty = was.where("false").drop("removed_from")
    assert {r["key"]: r["status"] for r in documents.after_scan(empty, now, first=True).collect()} == {k: "unreadable" if e else "baseline" for k, _, e in seen}
    assert documents.after_scan(empty, now.where("false")).count() == 0


def test_html_blocks(spark):
    page = """<head><title>T &amp; U</title><style>p{}</style></head><nav>Home<h2>Menu</h2></nav><header>Top</header>
    <h1>A &amp; B</h1><p>One <b>two</b>
       three<script>x("</p>")</script></p><dl><dt>Term<dd>Meaning</dl><ul><li>i<li>j</ul><footer>Foot</footer>tail<svg>no</svg>"""
    pages = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    got = [tuple(r) for r in documents.html_blocks(pages).orderBy("page_id", "block").collect()]
    want = [("furniture", 0, "Home"), ("heading", 2, "Menu"), ("body", 0, "Top"), ("heading", 1, "A & B"), ("body", 0, "One two\nthree"), ("body", 0, "Term"), ("body", 0, "Meaning"), ("body", 0, "i"), ("body", 0, "j"), ("furniture", 0, "Foot"), ("body", 0, "tail")]
    assert got == [(1, "T & U", i, *w) for i, w in enumerate(want, 1)]


def test_html_blocks_of_the_table(spark):
    """Every page's text, in order, against cutting its source by patterns."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got: dict[int, list] = {}
    for r in documents.html_blocks(pages).orderBy("page_id", "block").collect():
        got.setdefault(r["page_id"], []).append(r)
    for p in pages.collect():
        source = re.sub(r"(?s)<!--.*?-->|<!DOCTYPE[^>]*>", "", p["html"])
        title = re.search(r"(?s)<title>(.*?)</title>", source)
        source = re.sub(r"(?s)<(script|style|head|svg|noscript|template)\b.*?</\1>", "", source)
        blocks = re.split(r"</?(?:p|div|section|article|li|tr|td|th|blockquote|pre|dd|dt|figcaption|header|footer|main|table|ul|ol|dl|h[1-6]|br|hr|nav|aside)\b[^>]*>", source)
        plain = [" ".join(unescape(unescape(re.sub(r"<[^>]*>", "", b))).split()) for b in blocks]
        assert [" ".join(r["text"].split()) for r in got[p["page_id"]]] == [b for b in plain if b]
        assert sum(r["kind"] == "heading" for r in got[p["page_id"]]) == len([h for h in re.findall(r"(?s)<h[1-6]\b[^>]*>(.*?)<", source) if h.strip()])
        assert " ".join(got[p["page_id"]][0]["title"].split()) == " ".join(unescape(title[1]).split())
