"""Queries of literate rule files: a customer as a file, an order as a passage of nine lines in it."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.operators import literate
from tarnwick.plans.registry import query
from tarnwick.sources import table

#: What the files were made of, and from it what a reader finds, without reading a line.
MADE = """o as (select o_custkey f, o_orderkey k, 9 * (row_number() over (partition by o_custkey order by o_orderkey) - 1) top from orders),
i as (select *, k % 3 = 0 heading, k % 5 <> 4 cites, k % 5 = 4 and k % 2 = 0 marks, case when k % 4 = 3 then null when k % 4 = 2 then 'catala-metadata' else 'catala' end kind from o),
e as (select *, sum(heading::int) over (partition by f order by k) + coalesce(sum((kind is not null)::int) over (partition by f order by k rows between unbounded preceding and 1 preceding), 0) passage from i),
p as (select f, passage, count(*) filter (cites) n_quotes, max(top + 2) filter (cites) last_quote, bool_or(marks) reason from e group by all),
b as (select f, top + 5 start_line, top + 8 end_line, kind, n_quotes, last_quote, reason from e join p using (f, passage) where kind is not null)"""


def _files(spark, sf_dir):
    k = F.col("o_orderkey")
    s = lambda c: c.cast("string")
    at = 9 * (F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")) - 1)
    cites = F.concat(F.lit("| DOC-"), s(k % 11), F.lit(" C-"), s(k % 50), F.lit(" (d"), s(k % 7), F.lit(".md:"), s(k % 9), F.lit(")"))
    said = F.array(
        F.when(k % 3 == 0, F.concat(F.lit("## Order C-"), s(k))).otherwise(""),
        F.when(k % 5 != 4, cites).when(k % 2 == 0, "| NO-CLAUSE: rounding only").otherwise("Of orders."),
        F.concat(F.lit("|  Deliver  "), s(k % 3), F.lit(" units. ")),
        F.lit("It is read so that they arrive."),
        F.when(k % 4 == 3, "No code.").when(k % 4 == 2, "```catala-metadata").otherwise("```catala "),
        F.when(k % 4 == 3, "").otherwise("# delivers"),
        F.when(k % 4 == 3, "").otherwise("| DOC-1 C-1 (d1.md:1)"),
        F.when(k % 4 == 3, "").otherwise("```"),
        F.lit(""),
    )
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file"), at.alias("at"), said.alias("said")).select("file", "at", F.posexplode("said").alias("i", "text"))
    return rows.select("file", (F.col("at") + F.col("i") + 1).alias("line"), "text")


@query(f"""with {MADE} select f file, start_line, end_line, kind, n_quotes, last_quote, case when reason then 'rounding only' end reason from b""")
def literate_blocks(spark, sf_dir):
    """The blocks of code with the quotations that they encode."""
    return literate.blocks(literate.classified(_files(spark, sf_dir)))


@query(f"""with {MADE}, q as (select f, top + 2 at_line, k % 11 d, k % 50 c, k % 7 file, k % 9 line, k % 3 q from e where cites)
select f file, 0 at_line, 'unsourced-file' problem from e group by 1 having not bool_or(cites)
union all select f, at_line, 'unknown-clause' from q where d = 0 or c > 45
union all select f, at_line, 'quotation-drift' from q where d > 0 and c <= 45 and q <> (d + c) % 3
union all select f, at_line, case when file <> d % 7 then 'wrong-file' else 'stale-line' end from q where d > 0 and c <= 45 and (file <> d % 7 or line <> c % 9)
union all select f, start_line, case when n_quotes = 0 then 'unsourced-code' else 'quote-too-far' end from b where kind = 'catala' and (n_quotes = 0 and not reason or start_line - last_quote > 60)""")
def literate_fidelity(spark, sf_dir):
    """Quotations that aren't what the clauses say or where they are, and code that quotes none."""
    pairs = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 11).alias("d"), (F.col("o_orderkey") % 50).alias("c")).distinct().where("d > 0 and c <= 45")
    clauses = pairs.selectExpr("concat('DOC-', d, ' C-', c) ref", "concat('Deliver ', (d + c) % 3, ' units.') text", "concat('d', d % 7, '.md') file", "c % 9 line")
    return literate.fidelity(_files(spark, sf_dir), clauses)


@query(f"""with {MADE}, n as (select f, k, heading, cites, marks, kind, row_number() over (partition by f order by k) = 1 leads from e)
select f file, sum(case when cites then 2 else 4 end)::bigint removed,
  sum((heading or leads)::int + (cites)::int * 2 + marks::int + case when kind is not null then 4 when cites or marks or heading then 1 else 0 end)::bigint kept from n group by 1""")
def blind_packets(spark, sf_dir):
    """What is left of each file for a reviewer who hasn't heard its authors."""
    rows = literate.packet(_files(spark, sf_dir))
    return rows.groupBy("file").agg(F.count(F.when(F.col("removed"), 1)).alias("removed"), F.count("text").alias("kept"))
