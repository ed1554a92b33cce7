"""Rivals of new clauses, and findings about them: nearest clauses of others in turn, quotes that have to be there, and
agreement of independent reviewers.

Fixed values: clauses that are reviewed together, nearest ones of each, and the most that one review may see.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.operators.documents import collapsed
from tarnwick.operators.retrieval import nearest

TOGETHER, NEIGHBOURS, MOST = 5, 4, 14
SINGLE, CORROBORATED, DISCARDED = "single", "corroborated", "discarded"


def interleaved(targets: DataFrame, others: DataFrame, together: int = TOGETHER, neighbours: int = NEIGHBOURS, most: int = MOST) -> DataFrame:
    """batch, place (from 1) and item_id: what each review of ``together`` targets sees of others. First every target's
    nearest, then every second nearest, and so on, each item once, at most ``most``. ``targets``: query_id, at (their place,
    from 0) and e; ``others``: item_id and e. Every other is compared; a target without a vector brings none."""
    near = nearest(targets.select("query_id", "e"), others, neighbours)
    placed = near.join(targets.select(F.col("query_id").cast("long").alias("query_id"), "at"), "query_id")
    turn = F.min(F.struct(F.col("rank"), F.col("at"))).alias("turn")
    once = placed.groupBy(F.floor(F.col("at") / together).cast("long").alias("batch"), "item_id").agg(turn)
    place = F.row_number().over(Window.partitionBy("batch").orderBy("turn", "item_id"))  # at most together x neighbours rows
    return once.withColumn("place", place).where(F.col("place") <= most).select("batch", "place", "item_id")


def _said(text: Column) -> Column:
    return F.lower(collapsed(F.translate(F.coalesce(text, F.lit("")), "‘’“”", "''\"\"")))


def verified(findings: DataFrame, clauses: DataFrame) -> DataFrame:
    """The findings with reason: why one is discarded, else null. A finding (document, clause_id, corpus_ref, quote,
    corpus_quote, summary) is about a clause of its document and one of another, and both quotes have to be in them but
    for white space and case. ``clauses``: ref, clause_id, document and text; refs don't repeat."""
    own = clauses.select(F.col("document").alias("document"), F.col("clause_id").alias("clause_id"), _said(F.col("text")).alias("_own"))
    old = clauses.select(F.col("ref").alias("corpus_ref"), F.col("document").alias("_of"), _said(F.col("text")).alias("_old"))
    rows = findings.join(own, ["document", "clause_id"], "left").join(old, "corpus_ref", "left")
    there = lambda quote, text: (F.coalesce(_said(F.col(quote)), F.lit("")) != "") & F.contains(F.col(text), _said(F.col(quote)))
    reason = (
        F.when(F.col("_own").isNull(), "no clause of the new document")
        .when(F.col("_old").isNull(), "no clause of another document")
        .when(F.col("_of") == F.col("document"), "cites the document against itself")
        .when(~there("quote", "_own"), "quote not in the new clause")
        .when(~there("corpus_quote", "_old"), "quote not in the existing clause")
        .when(F.trim(F.coalesce("summary", F.lit(""))) == "", "says nothing")
    )
    return rows.withColumn("reason", reason).select(*findings.columns, "reason")


def consensus(checked: DataFrame) -> DataFrame:
    """document, clause_id, corpus_ref, raised_by (sorted) and status of what wasn't discarded: corroborated if two
    different reviewers found it. Reviewers are few; repeats of one are counted once before the shuffle."""
    kept = checked.where("reason is null").groupBy("document", "clause_id", "corpus_ref").agg(F.array_sort(F.collect_set("attacker")).alias("raised_by"))
    return kept.withColumn("status", F.when(F.size("raised_by") >= 2, CORROBORATED).otherwise(SINGLE))
