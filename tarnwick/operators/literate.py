"""Literate rule files: clauses quoted in a gutter of bars, and the code below them that encodes them.

Files are rows (file, line, text), a row for each line from 1. What a line is follows from running facts of its file: the last
fence before it says whether it is code, the run of bars that it lies in and the last citation say which quotation it continues,
and the count of headings and blocks before it is its passage. A block takes the quotations of its passage, so a heading or
another block between them parts them, and prose doesn't. A file's lines are sorted in one task, with spilling; nothing of a
file is collected but the texts of its single quotations. Null texts are empty lines; rows without a file or a line are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.operators.documents import content_hash

#: How a citation, a marker, a directive, a comment and a clause's id are written, and how many lines a block may
#: be from the last quotation above it.
CITATION = r"^\|\s*([A-Z][A-Z0-9\-]+)\s+([A-Z]{1,4}-\d+(?:\.\d+)*)\s*\(([^:]+):(\d+)\)\s*$"
MARKER = r"^\|\s*NO-CLAUSE:\s*(.+?)\s*$"
DIRECTIVE, COMMENT, CLAUSE_ID = r"^>\s*(Module|Using|Include)\b", r"^\s*#(?!\[)", r"\b[A-Z]{1,4}-\d+(?:\.\d+)*\b"
LANGUAGE, MOST_LINES = "catala", 60


def lines(files: DataFrame) -> DataFrame:
    """file, line and text of files (file, text); a last line's end begins no further line."""
    text = F.regexp_replace(F.coalesce("text", F.lit("")), r"(\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029])\z", "")
    return files.where(F.length("text") > 0).select("file", F.posexplode(F.split(text, r"\r\n|[\n\r\x0b\f\x1c-\x1e\x85\u2028\u2029]"))).select("file", (F.col("pos") + 1).alias("line"), F.col("col").alias("text"))


def classified(rows: DataFrame, language: str = LANGUAGE) -> DataFrame:
    """The lines with opens, closes and inside (a block's fences and code), gutter, cites, marks, heading, quoted (part of a
    quotation, its citation included), and the numbers of their passage, block and quotation."""
    up_to = Window.partitionBy("file").orderBy("line")
    before, so_far = up_to.rowsBetween(Window.unboundedPreceding, -1), up_to.rowsBetween(Window.unboundedPreceding, 0)
    t = F.col("text")
    out = rows.select("file", "line", F.coalesce(t, F.lit("")).alias("text")).dropna(subset=["file", "line"])
    fence = F.when(t.rlike(rf"^```{language}(?:-metadata|-test-cli|-test)?\s*\z"), True).when(t.rlike(r"^```\s*\z"), False)
    out = out.withColumn("_fence", fence).withColumn("_code", F.coalesce(F.last("_fence", ignorenulls=True).over(before), F.lit(False)))
    is_ = lambda c: F.coalesce(c, F.lit(False))
    opens, closes = is_(F.col("_fence") & ~F.col("_code")), is_(~F.col("_fence") & F.col("_code"))
    prose = ~F.col("_code") & ~opens
    gutter = prose & t.startswith("|")
    out = out.withColumns({"opens": opens, "closes": closes, "inside": F.col("_code") & ~closes, "gutter": gutter, "cites": gutter & t.rlike(CITATION), "_marks": gutter & t.rlike(MARKER), "heading": prose & ~gutter & F.trim(t).startswith("#")})
    count = lambda c, w: F.coalesce(F.sum(c.cast("int")).over(w), F.lit(0))
    out = out.withColumns({"_run": count(~F.col("gutter"), so_far), "passage": count(F.col("heading") | F.col("opens"), before), "block": count(F.col("opens"), so_far), "quotation": count(F.col("cites"), so_far)})
    cited = F.last(F.when(F.col("cites"), F.col("_run")), ignorenulls=True).over(so_far)
    out = out.withColumn("quoted", F.col("gutter") & is_(cited == F.col("_run")))
    return out.withColumn("marks", F.col("_marks") & ~F.col("quoted")).drop("_fence", "_code", "_run", "_marks")


def quotations(known: DataFrame) -> DataFrame:
    """file, at_line, passage, ref, cited_file, cited_line and text of the quotations of classified lines."""
    part = lambda n: F.regexp_extract("text", CITATION, n)
    cut = F.regexp_replace("text", r"^\|\s?", "")
    row = F.struct("line", "cites", F.when(F.col("cites"), "").otherwise(cut).alias("said"))
    first = lambda c: F.max(F.when(F.col("cites"), c))
    out = known.where("quoted").groupBy("file", "quotation").agg(
        first(F.col("line")).alias("at_line"), first(F.col("passage")).alias("passage"), first(F.concat_ws(" ", part(1), part(2))).alias("ref"), first(part(3)).alias("cited_file"), first(part(4)).cast("long").alias("cited_line"), F.array_sort(F.collect_list(row)).alias("_rows"),
    )
    said = F.array_join(F.transform(F.filter("_rows", lambda r: ~r["cites"]), lambda r: r["said"]), "\n")
    return out.select("file", "at_line", "passage", "ref", "cited_file", "cited_line", F.regexp_replace(said, r"\A\s+|\s+\z", "").alias("text"))


def blocks(known: DataFrame) -> DataFrame:
    """file, start_line, end_line (one after the file's last where no fence closes it), kind, n_quotes, last_quote (the line of
    the nearest quotation) and reason (of the last marker that it encodes no clause)."""
    starts = known.where("opens").select("file", "block", "passage", F.col("line").alias("start_line"), F.regexp_replace(F.rtrim("text"), "`", "").alias("kind"))
    ends = known.where("closes").groupBy("file", "block").agg(F.min("line").alias("end_line"))
    last = known.groupBy("file").agg((F.max("line") + 1).alias("_after"))
    own = known.where("cites or marks").groupBy("file", "passage").agg(
        F.count(F.when(F.col("cites"), 1)).alias("n_quotes"), F.max(F.when(F.col("cites"), F.col("line"))).alias("last_quote"), F.max_by(F.when(F.col("marks"), F.regexp_extract("text", MARKER, 1)), F.when(F.col("marks"), F.col("line"))).alias("reason"),
    )
    out = starts.join(ends, ["file", "block"], "left").join(last, "file").join(own, ["file", "passage"], "left")
    return out.select("file", "start_line", F.coalesce("end_line", "_after").alias("end_line"), "kind", F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"), "last_quote", "reason")


def fidelity(rows: DataFrame, clauses: DataFrame, language: str = LANGUAGE, most: int = MOST_LINES) -> DataFrame:
    """file, at_line and problem of the files held against clauses (ref, text, file, line; one row a ref): unsourced-file (at
    line 0), unknown-clause, quotation-drift (white space doesn't count), wrong-file or else stale-line, and of blocks of code,
    not those of metadata or tests, unsourced-code and quote-too-far."""
    known = classified(rows, language)
    said = quotations(known)
    silent = known.groupBy("file").agg(F.max("cites").alias("any")).where("not any").select("file", F.lit(0).alias("at_line"), F.lit("unsourced-file").alias("problem"))
    there = clauses.select("ref", content_hash(F.coalesce("text", F.lit(""))).alias("_hash"), F.col("file").alias("_file"), F.col("line").alias("_line"), F.lit(True).alias("_known"))
    held = said.join(there, "ref", "left")
    unknown, elsewhere = F.col("_known").isNull(), ~F.col("cited_file").eqNullSafe(F.col("_file"))
    of_quote = F.array(
        F.when(unknown, "unknown-clause"),
        F.when(~unknown & (content_hash(F.col("text")) != F.col("_hash")), "quotation-drift"),
        F.when(~unknown & elsewhere, "wrong-file").when(~unknown & ~F.col("cited_line").eqNullSafe(F.col("_line")), "stale-line"),
    )
    quotes = held.select("file", "at_line", F.explode(F.array_compact(of_quote)).alias("problem"))
    far = F.when((F.col("n_quotes") == 0) & F.col("reason").isNull(), "unsourced-code").when(F.col("start_line") - F.col("last_quote") > most, "quote-too-far")
    code = blocks(known).where(F.col("kind") == language).select("file", F.col("start_line").alias("at_line"), far.alias("problem")).where("problem is not null")
    return silent.union(quotes).union(code)


def packet(rows: DataFrame, language: str = LANGUAGE) -> DataFrame:
    """file, line, text and removed: the files without their authors' voice, for reviewers who should form their own reading.
    Quotations, directives, fences, code without comments and empty lines stay, headings as their level and the clauses that
    they name, markers without their reason. Removed lines have no text; a marker counts as removed too. Of empty lines in a
    row, the first stays."""
    known = classified(rows, language)
    so_far = Window.partitionBy("file").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    t, blank = F.col("text"), F.trim(F.col("text")) == ""
    marker = F.col("gutter") & t.rlike(MARKER)
    cut = F.last(F.when(F.col("cites"), False).when(marker | ~F.col("gutter"), True), ignorenulls=True).over(so_far)  # a marker ends a quotation
    names = F.concat_ws(" ", F.array(F.regexp_extract(F.trim(t), r"^#+", 0)), F.regexp_extract_all(t, F.lit(CLAUSE_ID), 0))
    kept = (
        F.when(F.col("opens") | F.col("closes"), t)
        .when(F.col("inside"), F.when(~t.rlike(COMMENT), t))
        .when(marker, F.lit("| NO-CLAUSE"))
        .when(F.col("gutter"), F.when(F.col("quoted") & ~F.col("_cut"), t))
        .when(F.col("heading"), names)
        .when(blank | t.rlike(DIRECTIVE), t)
    )
    out = known.withColumn("_cut", cut).withColumn("kept", kept).select("file", "line", "kept", (F.col("kept").isNull() | marker).alias("removed"))
    before = F.last("kept", ignorenulls=True).over(so_far.rowsBetween(Window.unboundedPreceding, -1))
    again = F.coalesce((F.trim("kept") == "") & (F.trim(before) == ""), F.lit(False))
    return out.withColumn("_again", again).where("not _again").select("file", "line", F.col("kept").alias("text"), "removed")
