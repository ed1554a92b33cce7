"""Queries of the index of quotable clauses and of the registry of scopes."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.operators import index
from tarnwick.plans.registry import query
from tarnwick.sources import table

#: Documents are clauses of the indexes of their languages; each has a decision by its label, some of which changed since.
STATE = """d as (select coalesce(lang, '') lang, doc_id as "ref", md5(coalesce(text, '')) clause_hash from documents),
l as (select d.lang, d."ref", case when toxic = 1 then 'RULE' when quality = 1 then 'HYBRID' else 'PROSE' end as "label" from d join labels on doc_id = d."ref"),"""
DIGEST = """(sum(('0x' || substr(sha256("ref" || '=' || {0}), 1, 15))::hugeint))::varchar || '.' || (sum(('0x' || substr(sha256("ref" || '=' || {0}), 16, 15))::hugeint))::varchar"""
#: The index as it was built: an old text, clauses that have gone or weren't there yet, an old decision. By language, one as it should be.
BUILT = """b as (select lang, "ref", case when "ref" % 13 = 0 and lang not in ('en', 'de') then 'old' else clause_hash end had from d left join l using (lang, "ref") where coalesce("label", 'PROSE') <> 'RULE' and not ("ref" % 17 = 0 and lang not in ('en', 'fr'))
  union all select lang, "ref" + 1000000000, 'gone' from d where "ref" % 23 = 0 and lang not in ('en', 'fr', 'de')
  union all select lang, "ref", clause_hash from d join l using (lang, "ref") where "label" = 'RULE' and "ref" % 2 = 0 and lang = 'fr'),"""


def _state(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.coalesce("lang", F.lit("")).alias("lang"), F.col("doc_id").alias("ref"), F.md5(F.coalesce("text", F.lit(""))).alias("clause_hash"))
    label = F.when(F.col("toxic") == 1, index.RULE).when(F.col("quality") == 1, index.HYBRID).otherwise(index.PROSE)
    return d, d.join(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("ref"), label.alias("label")), "ref").select("lang", "ref", "label")


def _built(d, ledger):
    r, lang = F.col("ref"), F.col("lang")
    old = (r % 13 == 0) & ~lang.isin("en", "de")
    kept = index.chunks(d, ledger, ["lang"]).where(~((r % 17 == 0) & ~lang.isin("en", "fr"))).select("lang", "ref", F.when(old, "old").otherwise(F.col("clause_hash")).alias("clause_hash"))
    gone = d.where((r % 23 == 0) & ~lang.isin("en", "fr", "de")).select("lang", (r + 1000000000).alias("ref"), F.lit("gone").alias("clause_hash"))
    barred = d.where((r % 2 == 0) & (lang == "fr")).join(ledger.where("label = 'RULE'").select("ref"), "ref", "left_semi").select("lang", "ref", "clause_hash")
    return kept.union(gone).union(barred)


@query(f"""with {STATE}
c as (select lang, count(*) n_clauses, {DIGEST.format('clause_hash')} corpus from d group by 1), t as (select lang, count(*) n_decisions, {DIGEST.format('"label"')} triage from l group by 1),
k as (select d.lang, count(*) filter (coalesce("label", '') <> 'RULE') n_chunks, count(*) filter (coalesce("label", 'PROSE') = 'PROSE') n_prose, count(*) filter ("label" = 'HYBRID') n_hybrid from d left join l using (lang, "ref") group by 1)
select lang, n_chunks, n_prose, n_hybrid, n_clauses, coalesce(n_decisions, 0) n_decisions, corpus, coalesce(triage, '0.0') triage from c join k using (lang) left join t using (lang)""")
def index_manifest(spark, sf_dir):
    """What pins the index of each language."""
    return index.manifest(*_state(spark, sf_dir), ["lang"])


@query(f"""with {STATE} {BUILT}
j as (select lang, "ref", b.had, d.clause_hash, b."ref" is not null indexed, d."ref" is not null there, "label" from b full join d using (lang, "ref") left join l using (lang, "ref")),
p as (select lang, "ref", case when indexed and there and had <> clause_hash then 'corpus:changed' when indexed and not there then 'corpus:gone' when there and not indexed and coalesce("label", '') <> 'RULE' then 'corpus:added' end a,
  case when indexed and coalesce("label", 'RULE') = 'RULE' then 'triage:barred' when not indexed and "label" in ('PROSE', 'HYBRID') then 'triage:absent' end b from j)
select lang, "ref", concat_ws(',', a, b) problems from p where a is not null or b is not null""")
def index_differences(spark, sf_dir):
    """Where the indexes aren't what the documents and decisions of today say."""
    d, ledger = _state(spark, sf_dir)
    return index.differences(_built(d, ledger), d, ledger, ["lang"]).withColumn("problems", F.array_join("problems", ","))


@query(f"""with {STATE} {BUILT}
j as (select lang, "ref", b.had, d.clause_hash, b."ref" is not null indexed, d."ref" is not null there, "label" from b full join d using (lang, "ref") left join l using (lang, "ref")),
n as (select lang, count(*) filter (indexed and coalesce("label", 'RULE') = 'RULE') n_barred, count(*) filter (not indexed and "label" in ('PROSE', 'HYBRID')) n_absent, count(*) filter (indexed and there and had <> clause_hash) n_changed,
  count(*) filter (indexed and not there) n_gone, count(*) filter (there and not indexed and coalesce("label", '') <> 'RULE') n_added, count(*) filter (indexed) held,
  count(*) filter (there and coalesce("label", '') <> 'RULE') want, count(*) filter (there and "label" is not null and "ref" % 3 = 0) > 0 moved from j group by 1)
select lang, case when lang = 'es' then 'unpinned' when held <> want then 'syncing' when lang = 'fr' and moved then 'triage' when lang = 'de' then 'corpus' end refusal, n_barred, n_absent, n_changed, n_gone, n_added from n""")
def index_refusals(spark, sf_dir):
    """Which indexes may be served, and else why not."""
    d, ledger = _state(spark, sf_dir)
    then = d.withColumn("clause_hash", F.when((F.col("lang") == "de"), "then").otherwise(F.col("clause_hash")))
    decided = F.when((F.col("lang") == "fr") & (F.col("ref") % 3 == 0), F.when(F.col("label") == index.PROSE, index.HYBRID).when(F.col("label") == index.HYBRID, index.PROSE).otherwise(F.col("label"))).otherwise(F.col("label"))
    pinned = index.manifest(then, ledger.withColumn("label", decided), ["lang"]).withColumn("triage", F.when(F.col("lang") != "es", F.col("triage")))
    return index.verified(pinned, _built(d, ledger), d, ledger, ["lang"])


CODE = """q as (select l_suppkey % 40 module, case when l_linenumber % 4 <> 0 then l_partkey % 9 end scope, l_orderkey as "ref" from lineitem where l_returnflag = 'R'),
l as (select o_orderkey as "ref", case when o_orderpriority like '1%' then 'RULE' when o_orderpriority like '2%' then 'HYBRID' else 'PROSE' end as "label", o_custkey k from orders where o_orderkey % 10 <> 0)"""


def _code(spark, sf_dir):
    q = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").selectExpr("l_suppkey % 40 module", "case when l_linenumber % 4 <> 0 then l_partkey % 9 end scope", "l_orderkey ref")
    label = "case when o_orderpriority like '1%' then 'RULE' when o_orderpriority like '2%' then 'HYBRID' else 'PROSE' end label"
    ledger = table(spark, sf_dir, "orders").where("o_orderkey % 10 <> 0").selectExpr("o_orderkey ref", label, "array(concat('j', o_custkey % 7), concat('j', o_custkey % 3)) judgements")
    return q, ledger


@query(f"""with {CODE}, m as (select "ref", string_agg(distinct module, ',' order by module) modules, count(distinct module) n from q group by 1)
select "ref", "label", coalesce(modules, '') modules, case when n > 1 then 'duplicated' when n = 1 and "label" = 'PROSE' then 'prose' when n = 1 then 'encoded' when "label" in ('RULE', 'HYBRID') then 'missing' end status from l full join m using ("ref")""")
def registry_coverage(spark, sf_dir):
    """Orders as clauses that suppliers' modules encode: which are missing, encoded twice, or prose."""
    out = index.coverage(*_code(spark, sf_dir))
    return out.withColumn("modules", F.array_join(F.transform("modules", lambda m: m.cast("string")), ","))


@query(f"""with {CODE}, s as (select distinct module, scope, "ref" from q where scope is not null)
select module, scope, 'encodes' kind, "ref"::varchar item from s
union all select distinct module, scope, 'judgement', 'j' || (k % x) from s join l using ("ref") cross join (values (7), (3)) v(x) where "label" = 'HYBRID'""")
def scope_registry(spark, sf_dir):
    """What each scope encodes and which judgements it needs."""
    return index.registry(*_code(spark, sf_dir))
