"""Review of a rule base: dangling references, stale decisions, routes of questions, the merge gate, and the claims,
silences and retries of the checks that the watch asks for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How a clause is referred to, and what stands where a document states no value.
REFERENCE, SENTINEL = r"\b[A-Z]{1,4}-\d+(?:\.\d+)*(?:\([a-z]\))?(?![\w-])", "NEEDS-HUMAN-INPUT"


def references(body: Column, own: Column) -> Column:
    """The distinct clauses that a text refers to, without itself."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(body, F.lit(REFERENCE), 0)), F.array(own))


def dangling(clauses: DataFrame) -> DataFrame:
    """clause and reference: those of clauses (clause, section, body) that no clause or section answers to; a
    paragraph is found by its clause."""
    known = clauses.select(F.explode(F.array("clause", "section")).alias("base")).where("base is not null").distinct()
    asked = clauses.select("clause", F.explode(references(F.col("body"), F.col("clause"))).alias("reference"))
    return asked.withColumn("base", F.regexp_replace("reference", r"\([a-z]\)$", "")).join(known, "base", "left_anti").select("clause", "reference").distinct()


def stale_decisions(clauses: DataFrame, ledger: DataFrame) -> DataFrame:
    """ref and problem (missing or changed): clauses (ref, clause_hash) whose decision (ref, decided_hash) isn't there or
    is on another text; a decision without a hash isn't held against its clause."""
    both = clauses.join(ledger.select("ref", "decided_hash", F.lit(True).alias("_in")), "ref", "left")
    problem = F.when(F.col("_in").isNull(), "missing").when((F.col("decided_hash") != "") & (F.col("decided_hash") != F.col("clause_hash")), "changed")
    return both.select("ref", problem.alias("problem")).where("problem is not null")


def routes(scores: DataFrame, encodes: DataFrame, k: int = 3, supports: int = 3, spread: float = 0.10, margin: float = 0.02, shared: float = 0.04) -> DataFrame:
    """query_id, scope, score, place, supports and close: the k scopes nearest to each question by their best row of
    scores (query_id, scope, ref, score), with the rows within ``spread`` of it. A scope is close if it can't be told
    from the first: within ``margin``, or within ``shared`` where it encodes (scope, ref) the first one's best clause."""
    of_scope = Window.partitionBy("query_id", "scope").orderBy(F.desc("score"), "ref")
    top = scores.withColumn("_n", F.row_number().over(of_scope)).where(F.col("_n") <= supports)
    by = top.groupBy("query_id", "scope").agg(F.max("score").alias("score"), F.array_sort(F.collect_list(F.struct("_n", "ref", "score"))).alias("_rows"))
    of_query = Window.partitionBy("query_id").orderBy(F.desc("score"), "scope")
    best = by.withColumn("place", F.row_number().over(of_query)).where(F.col("place") <= k)
    first = of_query.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    best = best.withColumns({"_gap": F.first("score").over(first) - F.col("score"), "_ref": F.first(F.col("_rows")[0]["ref"]).over(first)})
    # As large as the corpus: what is asked for is little, so that side may be broadcast, and this one never.
    asked = best.where("place = 1").select("_ref").distinct()
    known = encodes.select("scope", F.col("ref").alias("_ref")).join(asked, "_ref", "left_semi").groupBy("scope", "_ref").agg(F.lit(True).alias("_encodes"))
    best = best.join(known.hint("merge"), ["scope", "_ref"], "left")
    near = F.transform(F.filter("_rows", lambda r: F.col("score") - r["score"] <= spread), lambda r: r["ref"])
    close = (F.col("_gap") < margin) | (F.coalesce("_encodes", F.lit(False)) & (F.col("_gap") < shared))
    return best.select("query_id", "scope", "score", "place", near.alias("supports"), close.alias("close"))


def merge_gate(proposals: DataFrame, conflicts: DataFrame) -> DataFrame:
    """proposal and refusals, in order: unresolved (a blocking conflict lacks a resolution or who resolved it), drifted
    (the text isn't the pinned one) and unstated (a head with the sentinel). An empty list lets the proposal in."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    open_ = conflicts.where(F.col("blocking") & (blank(F.col("resolution")) | blank(F.col("resolved_by"))))
    by = open_.groupBy("proposal").agg(F.count("*").alias("_open"))
    reasons = [("unresolved", F.col("_open") > 0), ("drifted", ~F.col("pinned").eqNullSafe(F.col("current")) | F.col("pinned").isNull()), ("unstated", F.col("head").contains(SENTINEL))]
    said = F.array(*(F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in reasons))
    return proposals.join(by, "proposal", "left").select("proposal", F.array_compact(said).alias("refusals"))


def released(state: DataFrame, now: int, silent: int = 2400) -> DataFrame:
    """Checks whose heartbeat is older than ``silent`` seconds are pending again."""
    quiet = F.coalesce((F.col("status") == "checking") & (F.col("heartbeat") < now - silent), F.lit(False))
    return state.withColumn("status", F.when(quiet, "pending").otherwise(F.col("status")))


def claimed(state: DataFrame, now: int, workers: int) -> DataFrame:
    """The oldest pending documents, one for each worker, go to be checked, unless they wait for a retry."""
    due = state.where((F.col("status") == "pending") & (F.coalesce("retry_after", F.lit(0)) <= now))
    chosen = due.orderBy("first_seen", "key").limit(workers).select("key", F.lit(True).alias("_mine"))
    mine = F.coalesce("_mine", F.lit(False))
    out = state.join(F.broadcast(chosen), "key", "left")  # as many rows as workers
    return out.withColumns({"status": F.when(mine, "checking").otherwise(F.col("status")), "heartbeat": F.when(mine, F.lit(now)).otherwise(F.col("heartbeat"))}).drop("_mine")


def settled(state: DataFrame, results: DataFrame, now: int, most: int = 3, wait: int = 300) -> DataFrame:
    """The state after results (key, fingerprint, complete). An incomplete check is tried again after ``wait`` seconds
    for each attempt, ``most`` times in all; the end of a check of a text that has changed since leaves it as it is."""
    out = state.join(results.select("key", F.col("fingerprint").alias("_of"), "complete"), "key", "left")
    n = F.col("attempts") + 1
    ends, again = F.col("complete") | (n >= most), ~F.col("complete") & (n < most)
    same = ends & F.col("_of").eqNullSafe(F.col("fingerprint"))
    status = F.when(same, F.when(F.col("complete"), "checked").otherwise("incomplete")).when(again, "pending").otherwise(F.col("status"))
    return out.withColumns({"status": status, "attempts": F.when(same | again, n).otherwise(F.col("attempts")), "retry_after": F.when(again, F.lit(now) + wait * n).otherwise(F.col("retry_after"))}).drop("_of", "complete")
