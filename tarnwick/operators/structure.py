"""The numbering scheme of a document, and a disposition for each of its paragraphs: sections, clauses, and what belongs
to them.

A document is rows (doc_id, pos, kind, level, text); ``kind`` is ``heading`` where its format says so, else ``paragraph``.
Everything is windows over a document in the order of pos: which marker a paragraph opens with is its own, which scheme
its document has is an aggregate, and what it belongs to is a value carried forward. A paragraph goes on with the clause
above if the last event before it opened a clause that the document numbers; a heading closes the clause above it. Ids
that the document doesn't give are made from positions and say so (``synthesised``); nothing is left without a
disposition. A document's rows are one group of the shuffle, so a document has to fit a task's sort, which spills.

Null texts are empty paragraphs without a marker. pos has to tell a document's paragraphs apart.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: What a paragraph may open with, in the order of trial; what follows a number has to look like prose.
_AFTER = "(?=[A-Z\"“‘'(\\[£$€\\d])"
MARKERS = {
    "recital": r"^(WHEREAS|Whereas|NOW,? THEREFORE|Now,? therefore|RECITALS?|BACKGROUND)\b",
    "execution": r"^(IN WITNESS WHEREOF|EXECUTED as a deed|SIGNED (?:by|for)|Signed (?:by|for))\b",
    "article": r"^((?:ARTICLE|Article|CLAUSE|Clause|SECTION|Section|PARAGRAPH|Paragraph|PART|Part|SCHEDULE|Schedule|ANNEX|Annex|APPENDIX|Appendix)\s+(?:\d{1,3}|I|V|X|[IVXLCDM]{2,7}))\b[.:]?[ \t]*(?=.*$)",
    "decimal": r"^((?:[A-Z]{1,4}[-.])?\d{1,3}(?:\.\d{1,3})+)\.?[ \t]+" + _AFTER,
    "numbered": r"^(\d{1,3})[.)][ \t]+" + _AFTER,
    "lettered": r"^\(([A-Za-z]{1,5})\)[ \t]+(?=\S)",
    "bullet": r"^([•‣●▪·⁃*–—-])[ \t]+(?=\S)",
}
#: The number of a heading, furniture of pages, and the short forms of articles' names.
HEADING_NUMBER = r"^((?:[A-Z]{1,4}[-.])?\d{1,3}(?:\.\d{1,3})*)[.:)]?[ \t]+(?=\S)"
FURNITURE = (
    r"(?is)^(?:page\s+\d+(?:\s+of\s+\d+)?|\d{1,3}|[-–—]\s*\d{1,3}\s*[-–—]|confidential(?:\s*[-–—/]\s*\w+)?|draft|privileged\s*(?:and|&)?\s*confidential|internal use only|"
    r"\[?signature page follows\]?|_{4,}|(?:©|copyright\b|\(c\)\s*\d{4}).{0,60}|\.{4,}|\W{1,4})$"
)
SHORT = {"ARTICLE": "ART", "CLAUSE": "CL", "SECTION": "SEC", "PARAGRAPH": "PARA", "PART": "PT", "SCHEDULE": "SCH", "ANNEX": "ANX", "APPENDIX": "APP"}
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def heading_like(text: Column) -> Column:
    """Short, in one line, and no sentence."""
    t = F.trim(text)
    sentence = t.rlike("[.;:,]$") & ~t.endswith("...")
    return (t != "") & ~t.contains("\n") & ~sentence & (F.length(t) <= 70) & (F.size(F.split(t, r"\s+")) <= 9)


def roman(token: Column) -> Column:
    """The value of Roman digits, null for other letters."""
    digits = F.create_map(*(F.lit(x) for kv in ROMAN.items() for x in kv))
    values = F.transform(F.split(F.lower(token), ""), lambda c: F.coalesce(F.try_element_at(digits, c), F.lit(0)))
    signed = F.transform(values, lambda v, i: F.when(v < F.coalesce(F.try_element_at(values, i + 2), F.lit(0)), -v).otherwise(v))
    return F.when(token.rlike("(?i)^[ivxlcdm]+$"), F.aggregate(signed, F.lit(0), lambda a, v: a + v))


def _dotted(number: Column, keep: bool) -> Column:
    """An id of a number with or without letters before it; only its first part names a section."""
    prefix, digits = F.regexp_extract(number, r"^([A-Z]{1,4})[-.]", 1), F.regexp_replace(number, r"^[A-Z]{1,4}[-.]", "")
    prefix = F.when(prefix == "", "CL").otherwise(prefix)
    return F.concat_ws("-", prefix, digits if keep else F.substring_index(digits, ".", 1))


def marked(paragraphs: DataFrame) -> DataFrame:
    """The paragraphs with marker, token, rest, is_heading and furniture: one window to see what a document repeats."""
    rows = paragraphs.select("doc_id", "pos", "kind", "level", F.coalesce("text", F.lit("")).alias("text"))
    first = F.trim(F.split("text", "\n")[0])
    marker = F.lit("none")
    for name, pattern in reversed(MARKERS.items()):
        marker = F.when(first.rlike(pattern), name).otherwise(marker)
    rows = rows.withColumns({"first": first, "marker": marker, "flat": F.trim(F.regexp_replace("text", r"\s+", " "))})
    token = rest = None
    for name, pattern in MARKERS.items():
        is_it, left = F.col("marker") == name, F.col("first") if name in ("recital", "execution") else F.trim(F.regexp_replace("first", pattern, ""))
        token = (F.when if token is None else token.when)(is_it, F.regexp_extract("first", pattern, 1))
        rest = (F.when if rest is None else rest.when)(is_it, left)
    rows = rows.withColumns({"token": token.otherwise(F.lit("")), "rest": rest.otherwise(F.col("first"))})
    # All windows go by document. Dealt out here, once, what follows is code of its own: all in one is too long to compile well.
    rows = rows.repartition("doc_id")
    text = F.trim("text")
    capitals = ~text.contains("\n") & text.rlike("^[^a-z]{2,60}$") & (F.length(F.regexp_replace(text, r"[^\p{L}]", "")) >= 2) & ~text.rlike("[.;,]$")
    words = F.size(F.split("flat", " "))
    again = F.count("*").over(Window.partitionBy("doc_id", "flat"))
    furniture = ((again >= 3) & (F.length("flat") <= 80) & (words <= 12)) | (F.col("flat").rlike(FURNITURE) & (words <= 6))
    return rows.withColumns({"is_heading": (F.col("kind") == "heading") | capitals, "furniture": furniture, "heading_like": heading_like(F.col("rest"))})


def schemes(rows: DataFrame) -> DataFrame:
    """doc_id, name, section_layer and clause_layer, from ``marked`` rows: markers are counted, weighed against the
    document's length, and decimal numbers have to go up."""
    count = lambda c: F.count(F.when(c, 1))
    is_ = lambda m: F.col("marker") == m
    head = F.when(is_("decimal"), F.regexp_extract(F.regexp_replace("token", r"^[A-Z]{1,4}[-.]", ""), r"^(\d+)", 1).cast("int"))
    rows = rows.withColumn("_n", head).withColumn("_before", F.last("_n", True).over(Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)))
    by_doc = rows.groupBy("doc_id").agg(
        *(count(is_(m)).alias(m) for m in ("decimal", "numbered", "lettered", "article", "recital")),
        count(is_("numbered") & (F.col("heading_like") | F.col("is_heading"))).alias("numbered_heads"),
        count(F.col("is_heading")).alias("heads"),
        F.greatest(count(F.col("kind") != "heading"), F.lit(1)).alias("body"),
        count(F.col("_before") <= F.col("_n")).alias("up"),
        count(F.col("_before").isNotNull() & F.col("_n").isNotNull()).alias("steps"),
    )
    c = F.col
    rising = F.when(c("steps") > 0, c("up") / c("steps")).otherwise(1.0)
    clause = (
        F.when((c("decimal") >= 2) & (c("decimal") / c("body") >= 0.12) & (rising >= 0.7), "decimal")
        .when((c("lettered") >= 3) & (c("lettered") / c("body") >= 0.15) & (c("decimal") == 0), "lettered")
        .when(c("numbered") - c("numbered_heads") >= 2, "numbered")
        .otherwise("paragraph")
    )
    out = by_doc.withColumn("clause_layer", clause)
    section = (
        F.when(c("article") >= 2, "article").when(c("numbered_heads") >= 2, "numbered").when(c("clause_layer") == "decimal", "decimal-head").when(c("heads") >= 1, "heading")
        .when((c("numbered") >= 2) & (c("clause_layer") == "numbered"), "per-clause").otherwise("none")
    )
    some = (c("heads") > 0) | (c("numbered_heads") > 0) | (c("article") > 0)
    name = F.when(c("clause_layer") == "decimal", "decimal-outline").when(c("clause_layer") == "lettered", "lettered-subparagraphs").when(c("clause_layer") == "numbered", "numbered-clauses").when(some, "headings-only").otherwise("unstructured-prose")
    return out.select("doc_id", F.concat(name, F.when(c("recital") > 0, "+recitals").otherwise("")).alias("name"), section.alias("section_layer"), "clause_layer")


def _with_title(rows: DataFrame) -> DataFrame:
    """Marks the paragraph that is its document's title: the one top heading above deeper ones or by itself; in a format
    without headings, capitals among the first three paragraphs. Furniture is never the title."""
    whole, so_far = Window.partitionBy("doc_id"), Window.partitionBy("doc_id").orderBy("pos")
    real = ~F.col("furniture")
    rows = rows.withColumns({"_h": real & F.col("is_heading"), "_nth": F.sum(real.cast("int")).over(so_far)})
    first = F.min(F.when(F.col("_h"), F.struct("pos", "kind", "level", "marker", F.col("_nth").alias("nth")))).over(whole)
    rows = rows.withColumn("_first", first)
    same = F.sum((F.col("_h") & (F.col("level") == F.col("_first.level"))).cast("int")).over(whole)
    deeper = F.max(F.col("_h") & (F.col("level") > F.col("_first.level"))).over(whole)
    heads = F.sum(F.col("_h").cast("int")).over(whole)
    by_format = (F.col("_first.level") != 0) & (same == 1) & (deeper | (heads == 1)) & F.col("_first.marker").isin("none", "bullet")
    title = F.when(F.col("_first.kind") != "heading", F.col("_first.nth") <= 3).otherwise(by_format)
    return rows.withColumn("is_title", F.coalesce(title & (F.col("pos") == F.col("_first.pos")), F.lit(False))).drop("_h", "_nth", "_first")


def dispositions(paragraphs: DataFrame) -> DataFrame:
    """doc_id, pos, disposition, section_id, clause_id and id_source of every paragraph.

    disposition: title, heading, clause, recital, continuation, subparagraph, furniture, or unassigned (a sub-paragraph
    before any clause). id_source: ``document`` for a number as the document has it, ``derived`` for one that its number
    leads to, ``synthesised`` for one made from positions, as of a second use of a number."""
    rows = marked(paragraphs)
    rows = _with_title(rows).join(schemes(rows).select("doc_id", F.col("clause_layer").alias("layer")), "doc_id")
    c, layer = F.col, F.col("layer")
    skip = c("is_title") | c("furniture")
    plain_head = c("is_heading") & c("marker").isin("none", "bullet")
    kind = (
        F.when(skip, "skip")
        .when(plain_head, "head")
        .when(c("marker") == "recital", F.when(c("token").rlike("^(RECITAL|BACKGROUND)") & heading_like(c("flat")), "head").otherwise("recital"))
        .when(c("marker") == "execution", "execution")
        .when(c("marker") == "article", F.when((c("rest") == "") | c("heading_like"), "head").otherwise("article"))
        .when(c("marker") == "decimal", F.when(layer == "decimal", "decimal").when(c("heading_like"), "head").otherwise("plain"))
        .when(c("marker") == "numbered", F.when(c("heading_like") | c("is_heading"), "head").otherwise("numbered"))
        .when(c("marker") == "lettered", F.when((layer == "lettered") & ~c("text").startswith(" "), "lettered").otherwise("sub"))
        .when(c("marker") == "bullet", "bullet")
        .otherwise("plain")
    )
    rows = rows.withColumn("k", kind)
    by_doc = Window.partitionBy("doc_id").orderBy("pos")
    before = by_doc.rowsBetween(Window.unboundedPreceding, -1)
    number = F.regexp_extract("first", HEADING_NUMBER, 1)
    article = F.concat_ws("-", F.element_at(F.create_map(*(F.lit(x) for kv in SHORT.items() for x in kv)), F.upper(F.regexp_extract("token", r"^(\w+)", 1))), F.coalesce(F.expr(r"try_cast(regexp_extract(token, '(\\d+)$', 1) as int)"), roman(F.regexp_extract("token", r"(\w+)$", 1)), F.lit(1)).cast("string"))
    rows = rows.withColumns({"nth_head": F.sum((c("k") == "head").cast("int")).over(by_doc), "article_id": F.when(c("marker") == "article", article)})
    made = F.concat(F.lit("P-"), c("nth_head").cast("string"))
    # What a heading names; it opens that section unless the clauses' own numbers do.
    named = (
        F.when(c("marker") == "recital", "R-1").when(c("marker") == "article", c("article_id")).when(c("marker") == "numbered", F.concat(F.lit("CL-"), c("token"))).when(c("marker") == "decimal", _dotted(c("token"), False))
        .when((c("marker") == "none") & (number != ""), _dotted(number, False)).when(layer.isin("paragraph", "lettered"), made)
    )
    opens = ~(c("marker").isin("decimal", "none", "bullet") & (layer == "decimal"))
    rows = rows.withColumn("head_id", F.when(c("k") == "head", named))
    # Clauses that open by their own marker; a number is used once, later uses are made up.
    section = F.when(c("k") == "recital", "R-1").when(c("k") == "execution", "EX-1").when(c("k") == "article", c("article_id")).when(c("k") == "decimal", _dotted(c("token"), False)).when(c("k") == "numbered", F.concat(F.lit("CL-"), c("token")))
    rows = rows.withColumn("own_section", section)
    rows = rows.withColumn("nth_use", F.row_number().over(Window.partitionBy("doc_id", "own_section", F.when(c("k") == "decimal", c("token")), c("k") == "decimal").orderBy("pos")))
    firm = F.when(c("k") == "decimal", c("nth_use") == 1).when(c("k").isin("numbered", "article"), c("nth_use") == 1).when(c("k") == "lettered", F.lit(True)).when(c("k").isin("recital", "execution"), F.lit(False)).when(c("k") == "head", F.lit(False))
    rows = rows.withColumn("firm", firm)
    # A plain paragraph goes on with a numbered clause, else it is a clause; a bullet goes on with any.
    follows = F.coalesce(F.last("firm", True).over(before), F.lit(False)) & (layer != "paragraph")
    in_section = Window.partitionBy("doc_id", "nth_head").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.coalesce(F.max(c("k").isin("recital", "execution", "article", "decimal", "numbered", "lettered", "plain", "bullet")).over(in_section), F.lit(False))
    rows = rows.withColumns({"_follows": follows, "_open": open_})
    starts = c("k").isin("recital", "execution", "article", "decimal", "numbered", "lettered") | ((c("k") == "plain") & ~c("_follows")) | ((c("k") == "bullet") & ~c("_open"))
    rows = rows.withColumn("starts", starts)
    # The section in force: of the last heading that opens one, or of the last clause that has one of its own.
    set_here = F.when((c("k") == "head") & opens, c("head_id")).when(c("own_section").isNotNull(), c("own_section")).when(c("starts") & (c("k") != "lettered"), made)
    rows = rows.withColumn("_set", set_here).withColumn("_in_force", F.last("_set", True).over(before))
    lettered = F.when(c("_in_force").isNotNull() & ~c("_in_force").startswith("P-"), c("_in_force")).otherwise(made)
    rows = rows.withColumn("section_id", F.when(c("k") == "lettered", lettered).otherwise(c("_set")))
    letter = F.ascii(F.lower("token")) - 96
    single = F.length("token") == 1
    default = F.when(single, letter).otherwise(roman(c("token")))
    rows = rows.withColumn("_ordinal", F.when(c("marker") == "lettered", default).when(c("starts"), 0))
    ahead = F.coalesce(F.last("_ordinal", True).over(before), F.lit(0))
    value = roman(c("token"))
    ordinal = F.when(single & value.isNotNull() & (ahead + 1 != letter) & (ahead + 1 == value), value).when(default.isNull(), ahead + 1).otherwise(default)
    rows = rows.withColumn("ordinal", ordinal)
    counted = c("starts") & ~c("k").isin("decimal", "lettered")
    rows = rows.withColumn("_nth", F.sum(counted.cast("int")).over(Window.partitionBy("doc_id", "section_id").orderBy("pos")))
    clause = F.when(c("starts"), F.when(c("k") == "decimal", _dotted(c("token"), True)).when(c("k") == "lettered", F.concat_ws(".", "section_id", c("ordinal").cast("string"))).otherwise(F.concat_ws(".", "section_id", c("_nth").cast("string"))))
    rows = rows.withColumn("_clause", clause)
    use = F.row_number().over(Window.partitionBy("doc_id", "_clause").orderBy("pos"))
    rows = rows.withColumn("_use", F.when(c("starts"), use))
    rows = rows.withColumn("clause_own", F.when(c("_use") > 1, F.concat_ws(".", "_clause", (c("_use") - 1).cast("string"))).otherwise(c("_clause")))
    source = F.when(c("_use") > 1, "synthesised").when(c("k") == "decimal", "document").when(c("k") == "lettered", "derived").when(c("k").isin("numbered", "article") & (c("_nth") == 1), "derived").otherwise("synthesised")
    # A heading closes the clause above it.
    state = F.when(c("starts"), F.struct(c("clause_own").alias("clause"), c("section_id").alias("section"))).when(c("k") == "head", F.struct(F.lit(None).cast("string").alias("clause"), F.lit(None).cast("string").alias("section")))
    rows = rows.withColumn("_state", F.last(state, True).over(before))
    joins = c("k").isin("sub", "bullet", "plain") & ~c("starts")
    told = (
        F.when(c("is_title"), "title").when(c("furniture"), "furniture").when(c("k") == "head", "heading").when(c("k") == "recital", "recital").when(c("starts"), "clause")
        .when(c("_state.clause").isNull(), "unassigned").when(c("k") == "plain", "continuation").otherwise("subparagraph")
    )
    return rows.select(
        "doc_id",
        "pos",
        told.alias("disposition"),
        F.when(c("k") == "head", c("head_id")).when(c("starts"), c("section_id")).when(joins, c("_state.section")).alias("section_id"),
        F.when(c("starts"), c("clause_own")).when(joins, c("_state.clause")).alias("clause_id"),
        F.when(c("starts"), source).alias("id_source"),
    )
