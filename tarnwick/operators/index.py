"""The index of quotable clauses: what belongs in it, the manifest that pins it, and what keeps it from being served; and
the registry of scopes: the clauses that each encodes, and which clauses no module or too many do.

Clauses are rows (ref, clause_hash), decisions rows (ref, label), both with the columns ``by`` that tell indexes apart, so
that any number of them are pinned and verified in one pass. A clause without a decision is prose. Rules aren't indexed: they
are answered by evaluation, never quoted. Null refs, and nulls in ``by``, belong to no index and are left out; a ref that comes
twice with the same hash or label counts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The labels of decisions.
RULE, PROSE, HYBRID = "RULE", "PROSE", "HYBRID"


def digest(*parts: Column) -> Column:
    """An aggregate that pins a set of rows whatever their order: two sums of 60 bits each of their SHA-256, which merge over
    partitions, so that no list of all refs is ever made. No rows: 0.0."""
    h = F.sha2(F.concat_ws("=", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)), 256)
    sums = (F.coalesce(F.sum(F.conv(F.substring(h, at, 15), 16, 10).cast("decimal(28,0)")), F.lit(0)).cast("string") for at in (1, 16))
    return F.concat_ws(".", *sums)


def _known(rows: DataFrame, columns: list[str], value: str) -> DataFrame:
    return rows.select(*columns, value).dropna(subset=columns).distinct()


def chunks(clauses: DataFrame, ledger: DataFrame, by: list[str]) -> DataFrame:
    """by, ref, clause_hash and label of the clauses that can be quoted."""
    keys = [*by, "ref"]
    out = _known(clauses, keys, "clause_hash").join(_known(ledger, keys, "label"), keys, "left")
    label = F.coalesce("label", F.lit(PROSE))
    return out.select(*keys, "clause_hash", label.alias("label")).where(F.col("label") != RULE)


def manifest(clauses: DataFrame, ledger: DataFrame, by: list[str]) -> DataFrame:
    """A row for each index: n_chunks, n_prose, n_hybrid, n_clauses, n_decisions, and corpus and triage, the digests of all
    clauses and of all decisions. Both are pinned, as a decision can change while no text does."""
    keys = [*by, "ref"]
    texts = _known(clauses, keys, "clause_hash").groupBy(*by).agg(F.count("*").alias("n_clauses"), digest(F.col("ref"), F.col("clause_hash")).alias("corpus"))
    decisions = _known(ledger, keys, "label").groupBy(*by).agg(F.count("*").alias("n_decisions"), digest(F.col("ref"), F.col("label")).alias("triage"))
    of = lambda label: F.count(F.when(F.col("label") == label, 1))
    inside = chunks(clauses, ledger, by).groupBy(*by).agg(F.count("*").alias("n_chunks"), of(PROSE).alias("n_prose"), of(HYBRID).alias("n_hybrid"))
    out = texts.join(decisions, by, "full").join(inside, by, "left")
    zero = {c: 0 for c in ("n_chunks", "n_prose", "n_hybrid", "n_clauses", "n_decisions")}
    return out.fillna(zero | {"corpus": "0.0", "triage": "0.0"}).select(*by, *zero, "corpus", "triage")


def differences(index: DataFrame, clauses: DataFrame, ledger: DataFrame, by: list[str]) -> DataFrame:
    """by, ref and problems (sorted) of all refs on which an index (by, ref, clause_hash) isn't what clauses and decisions
    say, from one full join: triage:barred (in the index, though no decision lets it be quoted), triage:absent (decided to be
    quotable, not in the index), corpus:changed, corpus:gone and corpus:added."""
    keys = [*by, "ref"]
    have = _known(index, keys, "clause_hash").withColumnRenamed("clause_hash", "had")
    live = _known(clauses, keys, "clause_hash").withColumn("there", F.lit(True))
    both = have.withColumn("indexed", F.lit(True)).join(live, keys, "full").join(_known(ledger, keys, "label"), keys, "full")
    indexed, there, quotable = (F.coalesce(c, F.lit(False)) for c in (F.col("indexed"), F.col("there"), F.col("label").isin(PROSE, HYBRID)))
    problems = F.array(
        F.when(indexed & there & ~F.col("had").eqNullSafe(F.col("clause_hash")), "corpus:changed"),
        F.when(indexed & ~there, "corpus:gone"),
        F.when(~indexed & there & (F.coalesce("label", F.lit(PROSE)) != RULE), "corpus:added"),
        F.when(indexed & ~quotable, "triage:barred"),
        F.when(~indexed & quotable, "triage:absent"),
    )
    return both.select(*keys, F.array_sort(F.array_compact(problems)).alias("problems")).where(F.size("problems") > 0)


def verified(pinned: DataFrame, index: DataFrame, clauses: DataFrame, ledger: DataFrame, by: list[str]) -> DataFrame:
    """by, refusal (null: it may be served) and the counts n_barred, n_absent, n_changed, n_gone and n_added, for each index
    that is pinned. An index is refused, in this order, as unpinned (its manifest has no digest of decisions), syncing (it
    holds another number of chunks than its manifest says), triage or corpus (a digest isn't today's). What differs is
    counted whatever the refusal: a digest that moved with nothing counted is a move that left the index as it was."""
    today = manifest(clauses, ledger, by).select(*by, F.col("corpus").alias("_corpus"), F.col("triage").alias("_triage"))
    held = index.dropna(subset=[*by, "ref"]).groupBy(*by).agg(F.countDistinct("ref").alias("_held"))
    named = F.explode("problems").alias("problem")
    kinds = {"n_barred": "triage:barred", "n_absent": "triage:absent", "n_changed": "corpus:changed", "n_gone": "corpus:gone", "n_added": "corpus:added"}
    counts = differences(index, clauses, ledger, by).select(*by, named).groupBy(*by).agg(*(F.count(F.when(F.col("problem") == k, 1)).alias(c) for c, k in kinds.items()))
    out = pinned.select(*by, "n_chunks", "corpus", "triage").join(today, by, "left").join(held, by, "left").join(counts, by, "left")
    out = out.fillna(dict.fromkeys(["_held", *kinds], 0) | {"_corpus": "0.0", "_triage": "0.0"})
    refusal = F.when(F.col("triage").isNull(), "unpinned").when(~F.col("_held").eqNullSafe(F.col("n_chunks")), "syncing")
    refusal = refusal.when(F.col("triage") != F.col("_triage"), "triage").when(~F.col("corpus").eqNullSafe(F.col("_corpus")), "corpus")
    return out.select(*by, refusal.alias("refusal"), *kinds)


def registry(quotes: DataFrame, ledger: DataFrame) -> DataFrame:
    """module, scope, kind (encodes or judgement) and item: the clauses that each scope of quotes (module, scope, ref)
    encodes and, of those that are hybrid, the judgements that decisions (ref, label, judgements) ask for, each once. Judgements
    come from the decisions, not from the code. Quotes without a scope belong to their module only."""
    own = quotes.select("module", "scope", "ref").dropna().distinct()
    asked = ledger.where(F.col("label") == HYBRID).select("ref", F.explode("judgements").alias("item")).where("item is not null").distinct()
    encodes = own.select("module", "scope", F.lit("encodes").alias("kind"), F.col("ref").cast("string").alias("item"))
    return encodes.union(own.join(asked, "ref").select("module", "scope", F.lit("judgement"), F.col("item").cast("string")).distinct())


def coverage(quotes: DataFrame, ledger: DataFrame) -> DataFrame:
    """ref, label, modules (sorted) and status of all clauses that have a decision or are quoted by a module: duplicated (by
    two modules or more, whatever its label; two scopes of one module aren't), prose (quoted, though decided to be prose),
    encoded, missing (a rule or hybrid that nobody quotes), and null for prose that is left alone. Quotes with no scope, such as
    those above a declaration, count for their module."""
    by = quotes.select("ref", "module").dropna().distinct().groupBy("ref").agg(F.array_sort(F.collect_set("module")).alias("modules"))
    out = ledger.select("ref", "label").where("ref is not null").distinct().join(by, "ref", "full")
    n = F.coalesce(F.size("modules"), F.lit(0))
    needed = F.coalesce(F.col("label").isin(RULE, HYBRID), F.lit(False))
    status = F.when(n > 1, "duplicated").when((n == 1) & F.coalesce(F.col("label") == PROSE, F.lit(False)), "prose").when(n == 1, "encoded").when(needed, "missing")
    return out.select("ref", "label", F.coalesce("modules", F.array().cast(out.schema["modules"].dataType)).alias("modules"), status.alias("status"))
