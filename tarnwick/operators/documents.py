"""Document operators: normalisation, hashes, furniture, triage and the change watch."""

from __future__ import annotations

from functools import reduce
from html import unescape
from html.parser import HTMLParser
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.operators import wording

def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def content_hash(text: Column) -> Column:
    """16 hexadecimal digits; white space doesn't count."""
    return F.substring(F.sha2(collapsed(text), 256), 1, 16)


def normalised(text: Column) -> Column:
    """Plain quotes, spaces and letters, dashes by their length, lines without margins but for an indent of four spaces at
    most, single spaces, at most one empty line, none at the ends. Applying it again changes nothing; null stays null."""
    for old, new in wording.BREAKS:
        text = F.replace(text, F.lit(old), F.lit(new))
    single = wording.CHARACTERS | dict.fromkeys(wording.SPACES, " ")
    text = F.translate(text, "".join([*single, *wording.INVISIBLE]), "".join(single.values()))
    for old, new in (*wording.LIGATURES.items(), ("\f", "\n\n")):
        text = F.replace(text, F.lit(old), F.lit(new))
    margin = f"[{wording.MARGIN}]"
    for pattern, by in (
        (rf"{margin}+(?=\n|\z)", ""),
        (rf"(?md)^( {{0,4}}){margin}*", "$1"),
        (r"(?<=[^\n ]) {2,}", " "),
        (r"\n{3,}", "\n\n"),
        (r"\A\n+|\n+\z", ""),
    ):
        text = F.regexp_replace(text, pattern, by)
    return text


def rejoined(text: Column) -> Column:
    """Words that a line's end cut at a hyphen, whole again; hyphens before a capital or a digit stay."""
    return F.regexp_replace(text, r"([A-Za-z]{2,})-\n([a-z]{2,})", "$1$2")


def furniture(docs: DataFrame, times: int = 3, chars: int = 80, words: int = 12) -> DataFrame:
    """doc_id, line and n: short lines that a document repeats, as page heads and feet do."""
    lines = docs.select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.trim("line").alias("line"))
    short = lines.where((F.col("line") != "") & (F.length("line") <= chars) & (F.size(F.split("line", " +")) <= words))
    return short.groupBy("doc_id", "line").agg(F.count("*").alias("n")).where(F.col("n") >= times)


def triage(text: Column) -> dict[str, Column]:
    """score and label (RULE, HYBRID or PROSE): whether a passage can be computed, needs a judgement, or both. Boilerplate
    and definitions without figures are prose. Null is the empty text."""
    count = lambda t, pattern: F.regexp_count(t, F.lit("(?U)" + pattern.lower()))
    hinted = lambda t, pattern: reduce(or_, (F.contains(t, F.lit(h)) for h in wording.HINTS[pattern]))  # noqa: E731, cheap
    found = lambda t, pattern: F.when(hinted(t, pattern), count(t, pattern)).otherwise(0)
    said = lambda t, phrases: hinted(t, wording.any_of(phrases)) & t.rlike("(?U)" + wording.any_of(phrases))

    def signs(t):
        score = sum((found(t, p) * w for p, w in wording.SIGNS), F.lit(0)) + F.least(count(t, wording.NUMBER), F.lit(4))
        return F.struct(score.alias("score"), said(t, wording.JUDGED).alias("judged"), said(t, wording.PROSE).alias("boilerplate"))

    text = F.coalesce(text, F.lit(""))
    defines = F.regexp_replace(text, r"(?U)^\s+", "").rlike("(?U)" + wording.DEFINES)

    def decided(s):
        label = (
            F.when(s["boilerplate"] & (s["score"] < 6), "PROSE")
            .when((s["score"] >= 4) & s["judged"], "HYBRID")
            .when((s["score"] >= 4) | ((s["score"] == 3) & ~s["judged"] & ~defines), "RULE")
            .otherwise("PROSE")
        )
        return F.struct(s["score"].alias("score"), label.alias("label"))

    # Lambdas, so that the lower-case text is made and its signs are counted once.
    out = F.transform(F.transform(F.array(F.lower(text)), signs), decided)[0]
    return {"score": out["score"], "label": out["label"]}


def after_scan(state: DataFrame, seen: DataFrame, first: bool = False) -> DataFrame:
    """The states (key, fingerprint, status, removed_from) after a scan (key, fingerprint, and error if documents can be
    unreadable). New and changed documents are pending (baseline if it is the first scan, unreadable if they have an
    error), ones that are gone removed, others keep their status. One that returns unchanged takes up the status it went
    from, pending if that isn't known or its check was under way. Fingerprints that are both null are equal; a null key
    meets no other and counts as new or gone. A key must not repeat on one side."""
    none = F.lit(None).cast("string")
    s = state.select("key", F.col("fingerprint").alias("had"), "status", (F.col("removed_from") if "removed_from" in state.columns else none).alias("left"), F.lit(True).alias("known"))
    n = seen.select("key", F.col("fingerprint").alias("has"), (F.col("error") if "error" in seen.columns else none).alias("error"), F.lit(True).alias("here"))
    here, known, gone = F.col("here").isNotNull(), F.col("known").isNotNull(), F.col("status").eqNullSafe("removed")
    same = known & F.col("had").eqNullSafe(F.col("has"))
    resumed = F.when(F.col("left") == "checking", "pending").otherwise(F.coalesce("left", F.lit("pending")))
    status = (
        F.when(~here, "removed")
        .when(same & gone, resumed)
        .when(same, F.col("status"))
        .when(F.length("error") > 0, "unreadable")
        .otherwise("baseline" if first else "pending")
    )
    left = F.when(~here, F.when(gone, F.col("left")).otherwise(F.col("status")))
    return s.join(n, "key", "full").select("key", F.when(here, F.col("has")).otherwise(F.col("had")).alias("fingerprint"), status.alias("status"), left.alias("removed_from"))


class _Events(HTMLParser):
    """Lists what a page is made of, in order: a step (1 open, -1 close, 0 text) and its tag or text. It decides nothing."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.steps, self.said = [0], [""]

    def _note(self, step, said):
        self.steps.append(step)
        self.said.append(said)

    def handle_starttag(self, tag, attrs):
        self._note(1, tag)

    def handle_endtag(self, tag):
        self._note(-1, tag)

    def handle_data(self, data):
        self._note(0, data)


def _depth(steps: np.ndarray) -> np.ndarray:
    """How deep each event stands; a close without an open counts for nothing."""
    walk = np.cumsum(steps)
    return walk - np.minimum(0, np.minimum.accumulate(walk))


def _page(html: str) -> tuple[str, list[dict]]:
    """The title and the blocks of a page, by sums that run over its events: a block's tag, opened or closed, ends one
    block and begins the next; text counts where nothing around it is dropped."""
    events = _Events()
    events.feed(html)
    events.close()
    step = np.array(events.steps)
    of = lambda tags: np.array([bool(k) and t in tags for k, t in zip(events.steps, events.said)])
    aside, titled = of(wording.FURNITURE), of({"title"})
    edge = of(wording.BLOCKS) | aside
    block = np.cumsum(edge)
    last = np.maximum.accumulate(np.where(titled, np.arange(len(step)), 0))
    in_title = titled[last] & (step[last] > 0)
    shown = (step == 0) & ~in_title & (_depth(step * of(wording.DROPPED)) == 0)
    outside = _depth(step * aside)
    texts: dict[int, list[str]] = {}
    for k in np.flatnonzero(shown).tolist():
        texts.setdefault(int(block[k]), []).append(events.said[k])
    begins = np.concatenate([[0], np.flatnonzero(edge)])  # the event that each block begins with
    out = []
    for n, parts in texts.items():
        tag, at = events.said[begins[n]], begins[n]
        level = int(tag[1]) if step[at] > 0 and tag[0] == "h" and tag[1:].isdigit() else 0
        text = "".join(parts)
        if text.strip():
            out.append({"kind": "heading" if level else "furniture" if outside[at] else "body", "level": level, "text": unescape(text)})
    return unescape("".join(events.said[k] for k in np.flatnonzero((step == 0) & in_title))), out


def html_blocks(pages: DataFrame) -> DataFrame:
    """page_id, title, block (from 1), kind (heading, body or furniture: inside navigation, footer or aside), level (of a
    heading, else 0) and text (normalised, lines without margins) of each page's blocks of text. Null and empty pages
    have none."""
    block = pa.list_(pa.struct([("kind", pa.string()), ("level", pa.int32()), ("text", pa.string())]))

    def each(batches):
        for rows in batches:
            read = [_page(html or "") for html in rows.column("html").to_pylist()]
            titles, found = [t for t, _ in read], [b for _, b in read]
            yield pa.RecordBatch.from_arrays([rows.column("page_id"), pa.array(titles, pa.string()), pa.array(found, block)], names=["page_id", "title", "blocks"])

    cut = pages.select(F.col("page_id").cast("long"), "html").mapInArrow(each, "page_id long, title string, blocks array<struct<kind string, level int, text string>>")
    plain = lambda b: F.struct(b["kind"].alias("kind"), b["level"].alias("level"), F.regexp_replace(normalised(b["text"]), r"(?md)^ +", "").alias("text"))
    kept = F.filter(F.transform("blocks", plain), lambda b: b["text"] != "")
    rows = cut.select("page_id", F.trim(normalised(F.col("title"))).alias("title"), F.posexplode(kept).alias("at", "b"))
    return rows.select("page_id", "title", (F.col("at") + 1).alias("block"), "b.kind", "b.level", "b.text")


def clauses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """section, section_title, clause, body and clause_hash of Markdown documents whose sections begin ``## C-4 Title``
    and whose clauses begin ``**C-4.2**`` or ``C-4.2 ``: lines carry the last section and clause above them. Lines
    before the first clause of a section belong to none. A document's lines are ordered among themselves only."""
    lines = docs.select(F.col(key), F.posexplode(F.split(F.coalesce(text, F.lit("")), "\r?\n")).alias("at", "line"))
    heading = r"^#{1,3}\s+(?:Section\s+)?([A-Z]+-\d+)\.?\s+(.*)$"
    begins = r"^\**([A-Z]+-\d+\.\d+)\**\.?\s+(.*)$"
    got = lambda pattern, n: F.when(F.col("line").rlike(pattern), F.regexp_extract("line", pattern, n))
    marked = lines.withColumns({"s": got(heading, 1), "t": got(heading, 2), "c": got(begins, 1)})
    w = Window.partitionBy(key).orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    spread = marked.select(
        key, "at",
        F.last("s", True).over(w).alias("section"),
        F.last("t", True).over(w).alias("section_title"),
        F.last(F.when(F.col("s").isNotNull(), "").otherwise(F.col("c")), True).over(w).alias("clause"),
        F.when(F.col("c").isNotNull(), got(begins, 2)).otherwise(F.col("line")).alias("line"),
    )
    body = F.trim(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "\n"))
    out = spread.where("clause != ''").groupBy(key, "section", "section_title", "clause").agg(body.alias("body"))
    return out.withColumn("clause_hash", content_hash(F.col("body")))
