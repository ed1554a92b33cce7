"""Queries of the review of a rule base and of the watch's claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.operators import documents, review, rivals
from tarnwick.plans.registry import query
from tarnwick.sources import table

NOW = 1_000_000


@query("""with c as (select 'C-' || o_orderkey clause, 'S-' || (o_orderkey % 50) section, o_orderkey k, o_custkey c from orders),
r as (select distinct clause, unnest(['C-' || (k * 2), 'C-' || (k - 1) || '(a)', 'S-' || c]) reference from c)
select clause, reference from r where reference <> clause and reference not like 'C--%' and regexp_replace(reference, '[(]a[)]$', '') not in (select clause from c union all select section from c)""")
def dangling_references(spark, sf_dir):
    body = "concat('As C-', o_orderkey * 2, ' and C-', o_orderkey - 1, '(a) say; see S-', o_custkey, '.')"
    clauses = table(spark, sf_dir, "orders").selectExpr("concat('C-', o_orderkey) clause", "concat('S-', o_orderkey % 50) section", f"{body} body")
    return review.dangling(clauses)


@query("""select doc_id as "ref", case when doc_id % 5 = 0 then 'missing' else 'changed' end problem from documents where doc_id % 5 = 0 or doc_id % 7 = 0""")
def stale_decisions(spark, sf_dir):
    clauses = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("ref"), F.md5("text").alias("clause_hash"))
    decided = F.when(F.col("ref") % 7 == 0, "old").when(F.col("ref") % 11 == 0, "").otherwise(F.col("clause_hash"))
    return review.stale_decisions(clauses, clauses.where("ref % 5 != 0").select("ref", decided.alias("decided_hash")))


@query("""with s as (select l_suppkey q, l_partkey % 7 scope, l_orderkey * 10 + l_linenumber ref, l_extendedprice / 100000 score from lineitem),
n as (select *, row_number() over (partition by q, scope order by score desc, ref) n, max(score) over (partition by q, scope) top from s),
b as (select q, scope, max(top) score, string_agg(case when top - score <= 0.1::double then ref::varchar end, ',' order by n) supports, min(ref) filter (n = 1) best from n where n <= 3 group by all),
p as (select *, row_number() over (partition by q order by score desc, scope) place from b),
f as (select *, first_value(score) over w - score gap, first_value(best) over w lead_ref from p window w as (partition by q order by place))
select q query_id, scope, score, place::int place, supports, gap < 0.02::double or (gap < 0.04::double and scope % 2 = lead_ref % 2) "close" from f where place <= 3""")
def route_ranking(spark, sf_dir):
    scores = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("query_id"), (F.col("l_partkey") % 7).alias("scope"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ref"), (F.col("l_extendedprice") / 100000).alias("score"))
    encodes = scores.select("ref").distinct().select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(6).cast("long"))).alias("scope"), "ref").where("scope % 2 = ref % 2")
    return review.routes(scores, encodes).withColumn("supports", F.array_join(F.transform("supports", lambda r: r.cast("string")), ","))


@query("""with c as (select l_orderkey k, count(*) filter (l_returnflag = 'R' and (l_linenumber % 3 = 0 or l_suppkey % 4 = 0)) n from lineitem group by 1)
select o_orderkey proposal, concat_ws(',', case when n > 0 then 'unresolved' end, case when o_orderkey % 6 = 0 then 'drifted' end, case when o_orderkey % 9 = 0 then 'unstated' end) refusals from orders left join c on k = o_orderkey""")
def merge_gate(spark, sf_dir):
    k = F.col("o_orderkey")
    proposals = table(spark, sf_dir, "orders").select(k.alias("proposal"), k.cast("string").alias("pinned"), F.when(k % 6 != 0, k.cast("string")).alias("current"), F.when(k % 9 == 0, "effective_date: NEEDS-HUMAN-INPUT").otherwise("title: x").alias("head"))
    conflicts = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("proposal"), (F.col("l_returnflag") == "R").alias("blocking"), F.when(F.col("l_linenumber") % 3 != 0, "kept").alias("resolution"), F.when(F.col("l_suppkey") % 4 != 0, "a clerk").otherwise(" ").alias("resolved_by"))
    return review.merge_gate(proposals, conflicts).withColumn("refusals", F.array_join("refusals", ","))


@query(f"""with s as (select event_id k, case event_id % 4 when 0 then 'pending' when 1 then 'checking' when 2 then 'checked' else 'pending' end status, {NOW} - (event_id % 5000) heartbeat, {NOW} - 500 + event_id % 1000 retry, event_id % 977 seen, event_id % 3 attempts from events),
r as (select *, case when status = 'checking' and heartbeat < {NOW} - 2400 then 'pending' else status end st from s),
c as (select *, st = 'pending' and retry <= {NOW} and row_number() over (partition by st = 'pending' and retry <= {NOW} order by seen, k) <= 100 mine from r),
d as (select *, mine and k % 2 = 0 done, mine and k % 2 = 1 failed, case when mine then 'checking' else st end s2 from c)
select k as "key", case when done and k % 10 <> 0 then 'checked' when done then s2 when failed and attempts + 1 >= 3 then 'incomplete' when failed then 'pending' else s2 end status,
  case when (done and k % 10 <> 0) or failed then attempts + 1 else attempts end attempts, case when failed and attempts + 1 < 3 then {NOW} + 300 * (attempts + 1) else retry end retry_after from d""")
def watch_claims(spark, sf_dir):
    """A round of the watch: silent checks are released, the hundred oldest claimed, and their results settled."""
    k = "event_id"
    state = table(spark, sf_dir, "events").selectExpr(f"{k} key", f"case {k} % 4 when 1 then 'checking' when 2 then 'checked' else 'pending' end status", f"{NOW} - {k} % 5000 heartbeat", f"{NOW} - 500 + {k} % 1000 retry_after", f"{k} % 977 first_seen", f"{k} % 3 attempts", "'now' fingerprint")
    mine = review.claimed(review.released(state, NOW), NOW, 100)
    results = mine.where(f"status = 'checking' and heartbeat = {NOW} and (key % 4 != 1 or key % 5000 != 0)").selectExpr("key", "case when key % 10 = 0 then 'then' else 'now' end fingerprint", "key % 2 = 0 complete")
    return review.settled(mine, results, NOW).select("key", "status", "attempts", "retry_after")


@query("""with t as (select vec_id, embedding::double[] e, row_number() over (order by vec_id) - 1 as nth from embeddings where vec_id % 20 = 0),
s as (select t.vec_id q, nth, v.vec_id item_id, round(list_cosine_similarity(e, v.embedding::double[]), 6) score from t, embeddings v where v.vec_id <> t.vec_id),
n as (select *, row_number() over (partition by q order by score desc, item_id) r from s qualify r <= 4),
o as (select nth // 5 as batch, item_id, min(r * 1000000 + nth) turn from n group by all)
select batch::bigint batch, cast(row_number() over (partition by batch order by turn, item_id) as int) place, item_id from o qualify place <= 14""")
def nearest_rivals(spark, sf_dir):
    """What a review of five vectors at a time sees of all others: their nearest in turn."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("e"))
    targets = v.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), (F.col("vec_id") / 20).cast("long").alias("at"), "e")
    return rivals.interleaved(targets, v.withColumnRenamed("vec_id", "item_id")).select("batch", "place", "item_id")


@query("""with c as (select doc_id::varchar ref, doc_id % 50 as document, doc_id clause_id, lower(trim(regexp_replace(coalesce(text, ''), '[ \\t\\n\\r\\f\\v]+', ' ', 'g'), ' ')) t from documents),
f as (select a.document, case when a.clause_id % 11 = 0 then -1 else a.clause_id end clause_id, b.ref corpus_ref, b.document of, a.t own, b.t old, k, a.clause_id n from c a cross join (values (0), (1), (2)) x(k) left join c b on b.clause_id = case when a.clause_id % 13 = 0 then -5 when a.clause_id % 17 = 0 then a.clause_id - 50 else a.clause_id - 1 - a.clause_id % 7 end),
r as (select document, clause_id, corpus_ref, k, case when clause_id = -1 then 'no clause of the new document' when corpus_ref is null then 'no clause of another document' when of = document then 'cites the document against itself'
  when k = 1 and n % 2 = 0 or trim(substr(own, 3, 40)) = '' then 'quote not in the new clause' when trim(substr(old, 5, 30)) = '' then 'quote not in the existing clause' when k = 2 and n % 3 > 0 then 'says nothing' end reason from f)
select document::bigint document, clause_id::bigint clause_id, corpus_ref, array_to_string(list_sort(list_distinct(list(k))), ',') raised_by, case when count(distinct k) >= 2 then 'corroborated' else 'single' end status from r where reason is null group by document, clause_id, corpus_ref""")
def findings_consensus(spark, sf_dir):
    """Findings of three reviewers about documents: quotes are looked for in both texts, and two have to agree."""
    t = table(spark, sf_dir, "documents")
    clauses = t.select(F.col("doc_id").cast("string").alias("ref"), F.col("doc_id").alias("clause_id"), (F.col("doc_id") % 50).alias("document"), "text")
    flat = documents.collapsed(F.coalesce("text", F.lit("")))
    old = clauses.select(F.col("clause_id").alias("_at"), F.col("ref").alias("_ref"), F.substring(flat, 5, 30).alias("corpus_quote"))
    n = F.col("clause_id")
    raised = clauses.select("document", "clause_id", F.when(n % 13 != 0, F.when(n % 17 == 0, n - 50).otherwise(n - 1 - n % 7)).alias("_at"), F.substring(flat, 3, 40).alias("own"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("attacker")).join(old, "_at", "left")
    quote = F.when((F.col("attacker") == 1) & (n % 2 == 0), F.concat(F.lit("☃"), "own")).otherwise(F.lower("own"))
    findings = raised.select("document", F.when(n % 11 == 0, F.lit(-1)).otherwise(n).cast("long").alias("clause_id"), F.coalesce("_ref", F.lit("none")).alias("corpus_ref"), quote.alias("quote"), "corpus_quote", F.when((F.col("attacker") == 2) & (n % 3 > 0), " ").otherwise("differs").alias("summary"), "attacker")
    out = rivals.consensus(rivals.verified(findings, clauses))
    return out.select("document", "clause_id", "corpus_ref", F.array_join(F.transform("raised_by", lambda a: a.cast("string")), ",").alias("raised_by"), "status")
