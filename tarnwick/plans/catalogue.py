"""All queries of the engine by name, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.functions import lists, scalars
from tarnwick.operators import documents, retrieval, surface, wording
from tarnwick.plans import agreements, contracts, expense_queries, gate_queries, index_queries, library, literate_queries, map_queries, obligation_queries, review_queries, service_queries, text_queries, value_queries  # noqa: F401 (registers their queries)
from tarnwick.plans.registry import ORACLES, QUERIES, query  # noqa: F401
from tarnwick.plans.rules import apply
from tarnwick.plans.service_sql import SERVICE
from tarnwick.sources import claim_facts, hour_facts, service_facts, table

FLAGSHIP = "service_credit"


@query(f"""with {SERVICE}
select o_orderkey, cast(availability as double) availability, cast(credit as double) credit, cast(least(credit, cap) as double) payable,
  cast(round(charge * least(credit, cap), 2) as double) amount, cast(null as varchar) err, branch from credits""")
def service_credit(spark, sf_dir):
    out = apply(library.SERVICE_CREDIT, service_facts(spark, sf_dir), trace=True)
    branch = F.filter("governing", lambda g: g["variable"] == "credit")[0]["branch"]
    return out.select("o_orderkey", *(F.col(c).cast("double").alias(c) for c in ("availability", "credit", "payable", "amount")), "err", branch.alias("branch"))


@query(f"with {SERVICE} select branch as signature, cap > 0.30 as lifted, count(*) as size from credits group by all")
def service_credit_regions(spark, sf_dir):
    out = apply(library.SERVICE_CREDIT, service_facts(spark, sf_dir), trace=True)
    branch = F.filter("governing", lambda g: g["variable"] == "credit")[0]["branch"]
    return out.groupBy(branch.alias("signature"), (F.col("cap") > F.expr("0.30")).alias("lifted")).agg(F.count("*").alias("size"))


HOURS = """hours as (
  select l_orderkey, l_linenumber, cast(l_quantity as int) ordinal, cast(l_partkey % 8 + 1 as int) grade, l_suppkey % 11 = 0 holiday,
         l_returnflag = 'R' critical, l_linestatus = 'O' night, l_partkey % 5 = 0 allowance from lineitem),
premiums as (
  select *, case when holiday then 2.0
      when grade >= 5 and ordinal > 40 and critical then case when ordinal > 48 then 1.5 else 1.25 end
      when grade >= 5 and ordinal > 40 then 0 when ordinal > 48 then 1.5 when ordinal > 40 then 1.25 else 0 end multiplier,
    case when allowance or not night then 0 else 0.15 end night_premium, grade >= 5 and ordinal > 40 and not critical toil from hours)"""


@query(f"with {HOURS} select l_orderkey, l_linenumber, cast(multiplier as double) multiplier, cast(case when ordinal > 40 then multiplier when multiplier > 1 then multiplier - 1 else 0 end + night_premium as double) total_rate, toil, cast(null as varchar) err from premiums")
def hour_premium(spark, sf_dir):
    out = apply(library.HOUR_PREMIUM, hour_facts(spark, sf_dir))
    return out.select("l_orderkey", "l_linenumber", F.col("multiplier").cast("double").alias("multiplier"), F.col("total_rate").cast("double").alias("total_rate"), "toil", "err")


@query("""with r as (select l_orderkey, l_linenumber, l_returnflag, row_number() over (partition by l_orderkey order by l_linenumber, l_quantity) n, l_quantity from lineitem)
select l_orderkey, cast(sum(case when n > 2 then l_quantity * 2 when n > 1 then l_quantity * 1.5 else l_quantity end) as double) as paid, count(*) as hours from r group by 1""")
def running_tally(spark, sf_dir):
    """An order-sensitive fold: an element's place among those before it sets its rate."""
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_quantity"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", n.alias("n"))
    rate = F.when(F.col("n") > 2, 2.0).when(F.col("n") > 1, 1.5).otherwise(1.0)
    return rows.groupBy("l_orderkey").agg(F.sum(F.col("l_quantity") * rate).alias("paid"), F.count("*").alias("hours"))


@query("""with f as (select l_orderkey, l_linenumber, datediff('day', cast(o_orderdate as date), cast(l_shipdate as date)) as days, l_returnflag = 'R' certified
  from lineitem join orders on l_orderkey = o_orderkey)
select l_orderkey, l_linenumber, cast(days as int) as days, case when days > 120 then false when days > 60 and certified then true else days <= 60 end admissible,
  case when days < 0 then 'AssertionFailed' end err from f""")
def claim_window(spark, sf_dir):
    return apply(library.CLAIM_WINDOW, claim_facts(spark, sf_dir)).select("l_orderkey", "l_linenumber", "days", "admissible", "err")


@query("""select o_orderkey, cast(case when o_totalprice >= 1000 and o_totalprice < 100000 then 2000 end as double) cap,
  case when cast(o_totalprice as decimal(18,2)) >= 100000 then 'Conflict' when cast(o_totalprice as decimal(18,2)) < 1000 then 'NoApplicableRule' end err from orders""")
def rule_conflicts(spark, sf_dir):
    facts = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("decimal(18,2)").alias("price"))
    return apply(library.RIVAL_CAPS, facts).select("o_orderkey", F.col("cap").cast("double").alias("cap"), "err")


@query("""with d as (select o_orderkey, cast(o_orderdate as date) d, cast(o_orderkey % 14 as int) m from orders),
e as (select *, cast(date_trunc('month', d) as date) f, cast(date_trunc('month', d) as date) + to_months(m) g from d),
h as (select *, cast(last_day(cast(g as date)) as date) l from e)
select o_orderkey, least(cast(g as date) + (day(d) - 1)::int, l)::date::varchar down, (case when day(d) > day(l) then l + 1 else cast(g as date) + (day(d) - 1)::int end)::date::varchar up,
  (case when day(d) <= day(l) then cast(g as date) + (day(d) - 1)::int end)::date::varchar strict, cast(isodow(d) as int) weekday from h""")
def date_rounding(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"), (F.col("o_orderkey") % 14).cast("int").alias("m"))
    moved = {n: scalars.add_period(F.col("d"), F.col("m"), F.lit(0), r).cast("string").alias(n) for n, r in (("down", "down"), ("up", "up"), ("strict", "abort"))}
    return d.select("o_orderkey", *moved.values(), scalars.day_of_week(F.col("d")).cast("int").alias("weekday"))


@query("""with p as (select l_orderkey, l_linenumber, cast(o_orderdate as date) b, cast(l_shipdate as date) e from lineitem join orders on l_orderkey = o_orderkey),
m as (select *, unnest(generate_series(date_trunc('month', b)::timestamp, date_trunc('month', e - 1)::timestamp, interval 1 month))::date f from p where b < e)
select l_orderkey, l_linenumber, greatest(f, b)::date::varchar part_begin, (case when cast(f + interval 1 month as date) >= e then e else cast(f + interval 1 month as date) - 1 end)::date::varchar part_end from m""")
def period_split(spark, sf_dir):
    f = claim_facts(spark, sf_dir)
    whole = scalars.period(F.col("incurred"), F.col("submitted"))
    places = f.select("l_orderkey", "l_linenumber", "incurred", "submitted", F.explode(scalars.months_of(whole)).alias("n"))
    parts = places.select("l_orderkey", "l_linenumber", scalars.month_part(whole, F.col("n")).alias("p"))
    return parts.select("l_orderkey", "l_linenumber", F.col("p.begin").cast("string").alias("part_begin"), F.col("p.end").cast("string").alias("part_end"))


@query("""with a as (select o_orderkey k, cast(o_orderdate as date) b, cast(o_orderdate as date) + 30 e, cast(o_orderdate as date) + cast(o_orderkey % 50 as int) c from orders)
select k o_orderkey, datediff('day', b, e) + 1 as days, c <= e as "overlaps", cast(case when c <= e then greatest(b, c) end as varchar) both_from, c = e + 1 as adjacent from a""")
def period_relations(spark, sf_dir):
    b = F.col("o_orderdate").cast("date")
    c = F.date_add(b, (F.col("o_orderkey") % 50).cast("int"))
    p, q = scalars.period(b, F.date_add(b, 30)), scalars.period(c, F.date_add(c, 30))
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.period_days(p).cast("bigint").alias("days"), scalars.overlaps(p, q).alias("overlaps"), scalars.intersection(p, q)["begin"].cast("string").alias("both_from"), (scalars.adjacent(p, q)).alias("adjacent"))


@query("""with c as (select o_orderkey, cast(round(o_totalprice * 100) as hugeint) n, cast(o_orderkey % 7 as hugeint) d from orders)
select o_orderkey, cast(case when d > 0 then (2 * n + d) // (2 * d) end as double) / 100 share, cast((n * 15 + 50) // 100 as double) / 100 part, cast((n + 50) // 100 as bigint) units from c""")
def money_arithmetic(spark, sf_dir):
    m = F.col("o_totalprice").cast("decimal(18,2)")
    d = (F.col("o_orderkey") % 7).cast("decimal(9,0)")
    return table(spark, sf_dir, "orders").select("o_orderkey", scalars.money_over(m, d, 0).cast("double").alias("share"), scalars.money_times(m, F.expr("0.15")).cast("double").alias("part"), scalars.round_units(m).alias("units"))


@query("""with l as (select l_orderkey k, list(struct_pack(n := l_linenumber, q := cast(l_quantity as int)) order by l_linenumber, l_quantity) xs from lineitem group by 1)
select k l_orderkey, len(xs) n, list_sum(list_transform(xs, lambda x: x.q)) total, list_max(list_transform(xs, lambda x: x.q)) top,
  (select max(l_linenumber) from lineitem where l_orderkey = k and cast(l_quantity as int) = list_max(list_transform(xs, lambda x: x.q))) top_line,
  list_transform(xs, lambda x: x.q)[2] as "second" from l""")
def list_functions(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q")))).alias("xs"))
    q = F.transform("xs", lambda x: x["q"])
    return rows.select("l_orderkey", F.size("xs").cast("bigint").alias("n"), lists.total(q, "bigint").alias("total"), lists.largest(q, F.lit(0)).alias("top"), lists.arg_max(F.col("xs"), lambda x: x["q"])["n"].alias("top_line"), lists.nth(q, F.lit(2)).alias("second"))


@query("""with l as (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by cast(l_quantity as int) desc, l_linenumber) place,
  row_number() over (partition by l_orderkey, l_returnflag order by l_linenumber) = 1 first_of_flag from lineitem)
select l_orderkey, string_agg(cast(l_linenumber as varchar), ',' order by place) by_quantity, string_agg(case when first_of_flag then cast(l_linenumber as varchar) end, ',' order by l_linenumber) first_of_each from l group by 1""")
def list_order(spark, sf_dir):
    item = F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").cast("int").alias("q"), F.col("l_returnflag").alias("f"))
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("xs"))
    say = lambda xs: F.array_join(F.transform(xs, lambda x: x["n"].cast("string")), ",")
    return rows.select("l_orderkey", say(lists.sort_by(F.col("xs"), lambda x: x["q"], True)).alias("by_quantity"), say(lists.first_of_each(F.col("xs"), lambda x: x["f"])).alias("first_of_each"))


@query("""with o as (select o_custkey, o_orderkey, cast(o_orderdate as date) d from orders)
select l.l_orderkey, l.l_linenumber, o_custkey, (select max(p.d) from o p where p.o_custkey = o.o_custkey and p.d <= cast(l_shipdate as date))::date::varchar in_force
from lineitem l join o on l_orderkey = o_orderkey""")
def as_of(spark, sf_dir):
    """The latest record of a customer on or before a date: one sort of both by customer and date, no range join."""
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("d"))
    asked = li.join(orders.drop("d"), li.l_orderkey == orders.o_orderkey).select("o_custkey", "d", F.lit(1).alias("asks"), "l_orderkey", "l_linenumber")
    both = asked.unionByName(orders.select("o_custkey", "d", F.lit(0).alias("asks")).distinct(), allowMissingColumns=True)
    w = Window.partitionBy("o_custkey").orderBy("d", "asks").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("in_force", F.last(F.when(F.col("asks") == 0, F.col("d")), True).over(w)).where("asks = 1").select("l_orderkey", "l_linenumber", "o_custkey", F.col("in_force").cast("string").alias("in_force"))


@query("""with f as (select distinct o_custkey, date_trunc('month', o_orderdate)::date m from orders where o_totalprice < 150000)
select o_custkey, count(*) failing, bool_or(exists(select 1 from f g where g.o_custkey = f.o_custkey and g.m = cast(f.m - interval 1 month as date))
   and exists(select 1 from f g where g.o_custkey = f.o_custkey and g.m = cast(f.m - interval 2 month as date))) three_running,
  bool_or((select count(*) from f g where g.o_custkey = f.o_custkey and g.m <= f.m and g.m >= f.m - interval 11 month) >= 4) four_in_twelve from f group by 1""")
def chronic_failure(spark, sf_dir):
    """Three failing months running, or four within twelve; repeated months count once."""
    m = F.trunc("o_orderdate", "MM")
    failing = table(spark, sf_dir, "orders").where("o_totalprice < 150000").select("o_custkey", m.alias("m")).distinct()
    at = (F.year("m") * 12 + F.month("m")).alias("at")
    failing = failing.select("o_custkey", at)
    w = Window.partitionBy("o_custkey").orderBy("at")
    marked = failing.select("o_custkey", (F.lag("at", 2).over(w) == F.col("at") - 2).alias("three"), (F.count("*").over(w.rangeBetween(-11, 0)) >= 4).alias("four"))
    no = F.lit(False)
    return marked.groupBy("o_custkey").agg(F.count("*").alias("failing"), F.bool_or(F.coalesce("three", no)).alias("three_running"), F.bool_or(F.coalesce("four", no)).alias("four_in_twelve"))


@query("""select c_custkey, c_nationkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 400000)""")
def new_logos(spark, sf_dir):
    big = table(spark, sf_dir, "orders").where("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey").join(big, "c_custkey", "left_anti")


@query(f"""with {SERVICE}, recorded as (select *, case when o_orderkey % 10 = 0 then 0.10 else least(credit, cap) end actual from credits)
select o_orderkey, cast(actual as double) actual, cast(least(credit, cap) as double) payable, cast(sign(actual - least(credit, cap)) as int) direction from recorded where actual <> least(credit, cap)""")
def recorded_divergences(spark, sf_dir):
    facts = service_facts(spark, sf_dir)
    decided = apply(library.SERVICE_CREDIT, facts).select(*facts.columns, F.when(F.col("o_orderkey") % 10 == 0, F.expr("0.10")).otherwise(F.col("payable")).cast("decimal(9,4)").alias("actual"))
    out = surface.divergences(decided, library.SERVICE_CREDIT, "payable", "actual")
    return out.select("o_orderkey", F.col("actual").cast("double").alias("actual"), F.col("payable").cast("double").alias("payable"), "direction")


@query("""with lines as (select doc_id, trim(unnest(string_split(text, chr(10))), ' ') line from documents)
select doc_id, line, count(*) n from lines where line <> '' and length(line) <= 80 and len(regexp_split_to_array(line, ' +')) <= 12 group by all having count(*) >= 3""")
def page_furniture(spark, sf_dir):
    return documents.furniture(table(spark, sf_dir, "documents"))


@query(r"""select doc_id, substr(sha256(trim(regexp_replace(text, '[ \t\n\r\f\v]+', ' ', 'g'), ' ')), 1, 16) hash from documents""")
def content_hashes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", documents.content_hash(F.col("text")).alias("hash"))


COUNTED = " + ".join(f"{w} * len(regexp_extract_all(t, '(?i){p}'))" for p, w in wording.SIGNS)


@query(rf"""with d as (select doc_id, coalesce(text, '') t from documents),
s as (select doc_id, {COUNTED} + least(len(regexp_extract_all(t, '{wording.NUMBER}')), 4) score,
  regexp_matches(t, '(?i){wording.any_of(wording.JUDGED)}') judged, regexp_matches(t, '(?i){wording.any_of(wording.PROSE)}') marked, regexp_matches(ltrim(t, ' ' || chr(9) || chr(10) || chr(13)), '{wording.DEFINES}') defines from d)
select doc_id, cast(score as int) score, case when marked and score < 6 then 'PROSE' when defines then case when score < 4 then 'PROSE' when judged then 'HYBRID' else 'RULE' end
  when score >= 4 and judged then 'HYBRID' when score >= 6 then 'RULE' when score >= 3 and not judged then 'RULE' else 'PROSE' end label from s""")
def triage(spark, sf_dir):
    t = documents.triage(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", t["score"].cast("int").alias("score"), t["label"].alias("label"))


LEXICAL = r"""list_distinct(list_transform(list_filter(list_transform(regexp_extract_all(lower(text), '[a-z][a-z''-]*|\p{Nd}+(?:[.,]\p{Nd}+)*%?'), lambda t: replace(rtrim(t, '%.-'), ',', '')),
  lambda t: length(t) >= 2), lambda t: case when contains(t, '.') then rtrim(rtrim(t, '0'), '.') else t end))"""


@query(f"""with d as (select doc_id, {LEXICAL} ts from documents), q as (select item_id query_id, {LEXICAL} ts from benchmark),
dt as (select doc_id, unnest(ts) t from d), qt as (select query_id, unnest(ts) t from q),
df as (select t, count(*) c from dt group by 1),
w as (select query_id, qt.t, case when c is null then ln(1.0 + (select count(*) from documents)) else ln(1 + (select count(*) from documents) / c) end idf from qt left join df on qt.t = df.t),
s as (select query_id, doc_id, sum(idf) m from w join dt on w.t = dt.t group by 1, 2), tot as (select query_id, sum(idf) a from w group by 1),
r as (select query_id, doc_id, round(m / a, 6) score from s join tot using (query_id))
select query_id, doc_id, score, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) rank from r qualify rank <= 5""")
def lexical_search_all(spark, sf_dir):
    """The five best documents for every benchmark item."""
    asked = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return retrieval.lexical_best(asked, table(spark, sf_dir, "documents"), 5).select("query_id", "doc_id", "score", "rank")


@query("""with q as (select vec_id query_id, embedding::double[] e from embeddings where vec_id % 20 = 0),
s as (select query_id, vec_id, round(list_cosine_similarity(q.e, v.embedding::double[]), 6) score from q, embeddings v where v.vec_id <> query_id)
select query_id, vec_id, score, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) rank from s qualify rank <= 10""")
def dense_search_all(spark, sf_dir):
    """The ten nearest of all vectors to each one whose id is divisible by 20, by blocks."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("e"))
    found = retrieval.nearest(v.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), v.withColumnRenamed("vec_id", "item_id"), 10)
    return found.select("query_id", F.col("item_id").alias("vec_id"), "score", "rank")


@query("""with o as (select doc_id k, case when doc_id % 7 = 0 then 'old' else md5(text) end had, case when doc_id % 5 = 0 then 'removed' else 'done' end status,
  case when doc_id % 5 = 0 then case doc_id % 4 when 1 then 'checking' when 2 then 'done' when 3 then 'failed' end end went from documents where doc_id % 3 <> 0),
n as (select doc_id k, md5(text) has, case when doc_id % 11 = 0 then 'no text' end error from documents where doc_id % 4 <> 0),
b as (select coalesce(o.k, n.k) as "key", o.k is not null known, n.k is not null here, o.*, n.* from o full join n on o.k = n.k)
select "key", case when here then has else had end fingerprint,
  case when not here then 'removed' when known and had = has and status <> 'removed' then status when known and had = has and went in ('done', 'failed') then went
    when known and had = has then 'pending' when error is not null then 'unreadable' else 'pending' end status,
  case when not here and status = 'removed' then went when not here then status end removed_from from b""")
def watch_plan(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key"), F.md5("text").alias("fingerprint"))
    had, gone = F.when(F.col("key") % 7 == 0, F.lit("old")).otherwise(F.col("fingerprint")), F.col("key") % 5 == 0
    went = F.when(gone, F.expr("case key % 4 when 1 then 'checking' when 2 then 'done' when 3 then 'failed' end"))
    state = d.where("key % 3 != 0").select("key", had.alias("fingerprint"), F.when(gone, "removed").otherwise("done").alias("status"), went.alias("removed_from"))
    return documents.after_scan(state, d.where("key % 4 != 0").withColumn("error", F.when(F.col("key") % 11 == 0, "no text")))


@query(r"""with a as (select doc_id, replace(replace(replace(replace(replace(text, chr(8230), '...'), chr(8232), chr(10)), chr(8233), chr(10) || chr(10)), chr(13) || chr(10), chr(10)), chr(13), chr(10)) t from documents),
c as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(t, '[\x{2018}-\x{201b}\x{2032}]', chr(39), 'g'), '[\x{201c}-\x{201f}\x{2033}]', '"', 'g'), '[\x{2010}\x{2011}\x{2212}]', '-', 'g'), '[\x{00ad}\x{200b}-\x{200d}\x{2060}\x{feff}]', '', 'g') t from a),
e as (select doc_id, replace(replace(regexp_replace(t, '[\x{00a0}\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}\t]', ' ', 'g'), chr(8210), chr(8211)), chr(8213), chr(8212)) t from c),
g as (select doc_id, replace(replace(replace(replace(replace(replace(replace(replace(t, chr(64256), 'ff'), chr(64257), 'fi'), chr(64258), 'fl'), chr(64259), 'ffi'), chr(64260), 'ffl'), chr(64261), 'st'), chr(64262), 'st'), chr(12), chr(10) || chr(10)) t from e),
k as (select doc_id, list_transform(string_split(t, chr(10)), lambda x: regexp_replace(x, '[ \v\x1c-\x1f\x{85}]+$', '')) ls from g),
m as (select doc_id, array_to_string(list_transform(ls, lambda x: repeat(' ', least(length(x) - length(ltrim(x, ' ')), 4)::int) || regexp_replace(regexp_replace(x, '^[ \v\x1c-\x1f\x{85}]+', ''), ' {2,}', ' ', 'g')), chr(10)) t from k),
o as (select doc_id, trim(regexp_replace(t, '\n{3,}', chr(10) || chr(10), 'g'), chr(10)) t from m),
r as (select doc_id, t, regexp_replace(t, '([A-Za-z]{2,})-\n([a-z]{2,})', '\1\2', 'g') whole from o)
select doc_id, cast(length(t) as int) n_chars, sha256(t) hash, sha256(whole) whole_hash from r""")
def plain_texts(spark, sf_dir):
    """Each whole text normalised, as a hash, and the same with words whole that a line's end cut."""
    t = documents.normalised(F.col("text"))
    return table(spark, sf_dir, "documents").select("doc_id", F.length(t).alias("n_chars"), F.sha2(t, 256).alias("hash"), F.sha2(documents.rejoined(t), 256).alias("whole_hash"))


@query("""select event_type, time_bucket(interval 1 hour, ts) as "start", count(*) n, sum(value) total from events group by all""")
def event_windows(spark, sf_dir):
    """An extension: event-time windows over the events."""
    e = table(spark, sf_dir, "events").groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return e.select("event_type", F.col("w.start").alias("start"), "n", "total")
