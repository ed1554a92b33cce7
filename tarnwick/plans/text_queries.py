"""Queries of document structure and of conflicts between texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.operators import conflicts, structure
from tarnwick.plans.registry import query
from tarnwick.sources import agreement_paragraphs, supply_clauses, table

#: What each paragraph is, said from the keys that its text was made of, without reading the text.
_AGREEMENTS = """
s as (select o_custkey c, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) k from orders where o_orderkey in (select l_orderkey from lineitem)),
l as (select s.c, s.k, s.c % 4 form, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey) j, l_returnflag = 'R' and s.c % 4 <> 1 back, l_linestatus = 'O' inspected from lineitem join s on l_orderkey = o_orderkey),
n as (select *, count(*) over (partition by c) lines, row_number() over (partition by c, j order by k) turn, row_number() over (partition by c, k, (j - 1) % 10 order by j) again, max(k) over (partition by c) top from l),
lay as (select *, case when form = 0 and lines >= 2 then 'decimal' when form = 2 and lines >= 3 then 'lettered' when form = 1 and lines >= 2 then 'numbered' else 'paragraph' end layer from n),
paras as (
  select c, k, form, layer, j, top, turn, again, back and j <= 10 back, inspected from lay)"""


@query(f"""with {_AGREEMENTS}
select layer, form::int form, count(distinct c)::bigint documents, count(*)::bigint clauses from paras where layer <> 'paragraph' group by all""")
def numbering_schemes(spark, sf_dir):
    """Which layer of numbers the clauses of each form of agreement have."""
    rows = structure.marked(agreement_paragraphs(spark, sf_dir))
    clauses = rows.where(F.col("text").startswith("The Supplier") | F.col("text").contains(" The Supplier")).groupBy("doc_id").agg(F.count("*").alias("n"))
    out = structure.schemes(rows).where("clause_layer <> 'paragraph'").join(clauses, "doc_id")
    return out.groupBy(F.col("clause_layer").alias("layer"), (F.col("doc_id") % 4).cast("int").alias("form")).agg(F.count("*").alias("documents"), F.sum("n").alias("clauses"))


@query(f"""with {_AGREEMENTS},
clauses as (select c doc_id, k * 1000 + j * 10 pos, 'clause' disposition,
    case layer when 'decimal' then 'CL-' || k when 'numbered' then 'CL-' || j when 'lettered' then 'P-' || case when top = 1 then 0 else k end end section_id,
    case layer when 'decimal' then 'CL-' || k || '.' || j when 'numbered' then 'CL-' || j || '.' || turn when 'lettered' then 'P-' || case when top = 1 then 0 else k end || '.' || (string_split('1,2,3,4,5,6,7,8,10,11', ',')[(j - 1) % 10 + 1]) || case when again > 1 then '.' || (again - 1) else '' end end clause_id,
    case layer when 'decimal' then 'document' when 'lettered' then case when again > 1 then 'synthesised' else 'derived' end else case when turn = 1 then 'derived' else 'synthesised' end end id_source, k, j, back, inspected, layer, form from paras where layer <> 'paragraph'),
heads as (select c doc_id, k * 1000 pos, case when sections = 1 and form in (0, 2) then 'title' else 'heading' end disposition, case when sections = 1 and form in (0, 2) then null when form = 1 then 'ART-' || k when form = 0 then 'CL-' || k else 'P-' || k end section_id, cast(null as varchar) clause_id, cast(null as varchar) id_source
  from (select s.c, s.k, s.c % 4 form, count(*) over (partition by s.c) sections from s) join (select distinct c, layer from paras where layer <> 'paragraph') using (c)),
bullets as (select doc_id, pos + 2 pos, 'subparagraph' disposition, section_id, clause_id, cast(null as varchar) id_source from clauses where inspected),
joined as (select doc_id, pos + 1 pos, 'continuation' disposition, section_id, clause_id, cast(null as varchar) id_source from clauses where back)
select doc_id, pos::int pos, disposition, section_id, clause_id, id_source from (
  select doc_id, pos, disposition, section_id, clause_id, id_source from clauses union all select * from bullets union all select * from joined union all select * from heads)""")
def paragraph_dispositions(spark, sf_dir):
    """What every paragraph of the numbered agreements is and belongs to."""
    told = structure.dispositions(agreement_paragraphs(spark, sf_dir))
    layers = structure.schemes(structure.marked(agreement_paragraphs(spark, sf_dir))).where("clause_layer <> 'paragraph'").select("doc_id")
    return told.join(layers, "doc_id").select("doc_id", F.col("pos").cast("int").alias("pos"), "disposition", "section_id", "clause_id", "id_source")


_CLAUSES = """
c as (select l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || printf('%.2f', l_extendedprice) ref, l_partkey part, l_suppkey supplier, l_linestatus = 'O' as incoming,
  list_distinct([printf('%.2f', l_extendedprice), cast(round(l_discount * 100) as int)::varchar, cast(l_quantity as int) || ' day']) n, cast(round(l_discount * 100) as int) off, cast(l_quantity as int) qty, l_extendedprice price from lineitem),
a as (select distinct ref, part, supplier, n from c where incoming), b as (select distinct ref, part, supplier, n from c where not incoming)"""


@query(f"""with {_CLAUSES} select a.ref, b.ref existing_ref, array_to_string(list_sort(list_filter(a.n, lambda x: not list_contains(b.n, x))), ',') differing from a join b using (part, supplier) where len(list_filter(a.n, lambda x: not list_contains(b.n, x))) > 0""")
def numeric_divergences(spark, sf_dir):
    """Incoming clauses whose figures differ from those of clauses on the same part and maker."""
    rows = supply_clauses(spark, sf_dir)
    out = conflicts.numeric_divergence(rows.where("open").select("ref", "text"), rows.where("not open").select("ref", "text"))
    return out.select("ref", "existing_ref", F.array_join("differing", ",").alias("differing"))


@query("""with d as (select p_partkey, p_name, p_brand, p_size > 25 as incoming from part)
select 'P-' || a.p_partkey ref, lower(a.p_name) term, min('P-' || b.p_partkey) existing_ref, count(*)::bigint "others" from d a join d b on a.p_name = b.p_name and a.incoming and not b.incoming and a.p_brand <> b.p_brand group by all""")
def term_redefinitions(spark, sf_dir):
    """Names that parts define in other words than other parts do."""
    text = F.concat(F.lit('"'), F.col("p_name"), F.lit('"  means what\n'), F.col("p_brand"), F.lit(" sells."))
    rows = table(spark, sf_dir, "part").select(F.concat(F.lit("P-"), "p_partkey").alias("ref"), text.alias("text"), (F.col("p_size") > 25).alias("incoming"))
    return conflicts.term_redefinition(rows.where("incoming"), rows.where("not incoming"))


@query(f"""with {_CLAUSES}, e as (select ref, list_sort(list_distinct(list('M' || (supplier % 5)))) modules from c where off > 8 group by 1) select distinct ref, array_to_string(modules, ',') modules from c join e using (ref) where incoming""")
def duplicate_encodings(spark, sf_dir):
    rows = supply_clauses(spark, sf_dir)
    encoded = rows.where(F.regexp_extract("text", conflicts.PERCENT, 1).cast("int") > 8).select("ref", F.concat(F.lit("M"), F.col("supplier") % 5).alias("module"))
    out = conflicts.duplicate_encoding(rows.where("open").select("ref").distinct(), encoded)
    return out.select("ref", F.array_join("modules", ",").alias("modules"))


@query(f"""with {_CLAUSES}, d as (select part, supplier, incoming, list_distinct(list(off)) offs, list_distinct(list(printf('%.2f', price))) prices, list_distinct(list(case when qty < 5 then qty end)) soon from c group by all),
x as (select a.part, a.supplier, len(list_filter(a.prices, lambda p: list_contains(b.prices, p))) = 0 money, list_sort(a.offs) <> list_sort(b.offs) pct, len(a.soon) > 0 and len(b.soon) > 0 and list_sort(a.soon) <> list_sort(b.soon) soon from d a join d b on a.part = b.part and a.supplier = b.supplier and a.incoming and not b.incoming)
select part, supplier, concat_ws(',', case when money then 'money' end, case when pct then 'percent' end, case when soon then 'deadline' end) differ from x where money or pct or soon""")
def incompatible_quantities(spark, sf_dir):
    """Documents on one part and maker, incoming and existing, whose quantities are incompatible, by kind."""
    rows = supply_clauses(spark, sf_dir)
    days = F.regexp_extract("text", r"(\d+) days", 1)
    said = F.concat(F.regexp_replace("text", r"payable.*", ""), F.when(days.cast("int") < 5, F.concat(F.lit("due within at most ("), days, F.lit(") hours"))).otherwise(""))
    docs = rows.groupBy("part", "supplier", "open").agg(F.array_join(F.array_sort(F.collect_set(said)), " ").alias("text")).withColumn("f", conflicts.fingerprint(F.regexp_replace("text", "within at most", "within most")))
    a, b = docs.where("open").select("part", "supplier", F.col("f").alias("a")), docs.where("not open").select("part", "supplier", F.col("f").alias("b"))
    out = a.join(b, ["part", "supplier"]).withColumn("differ", conflicts.dimensions_differ(F.col("a"), F.col("b")))
    return out.where(F.size("differ") > 0).select("part", "supplier", F.array_join("differ", ",").alias("differ"))
