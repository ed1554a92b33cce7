"""Queries of the gates: totality, dead branches and mutants over the tables' cases."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.operators import gates
from tarnwick.plans import agreements, library
from tarnwick.plans.registry import query
from tarnwick.plans.service_sql import SERVICE
from tarnwick.sources import claim_facts, service_facts


@query(f"""with {SERVICE}, c as (select *, case when availability < 95 then 'deep_cap' else 'cap' end cap_by from credits),
n(variable, branch) as (values ('credit','none'),('credit','bands'),('credit','deep'),('credit','arrears'),('cap','cap'),('cap','deep_cap'),('payable','payable'),('amount','amount'))
select variable, n.branch as branch, (select count(*) from c where case variable when 'credit' then c.branch = n.branch when 'cap' then cap_by = n.branch else true end)::bigint governed from n""")
def branch_coverage(spark, sf_dir):
    """How many orders each branch of the service credit governs."""
    return gates.branches(library.SERVICE_CREDIT, service_facts(spark, sf_dir))


@query(f"""with {SERVICE} select case when availability >= 99.9 or availability < 95 then 'computed' else 'Conflict' end outcome, count(*)::bigint cases from credits group by 1""")
def totality(spark, sf_dir):
    """Two unranked tables of credits fail the gate."""
    facts = service_facts(spark, sf_dir).select("o_orderkey", F.col("availability").alias("uptime"), F.col("charge").alias("fee"))
    return gates.outcomes(agreements.GLOBEX_CREDIT, facts)


@query("""with f as (select datediff('day', o_orderdate::date, l_shipdate::date) d, l_returnflag = 'R' c, l_shipdate::date >= o_orderdate::date fine from lineitem join orders on l_orderkey = o_orderkey),
m(mutant, k) as (values ('flip_comparison:2:admissible:certified:5', 1), ('flip_comparison:2:admissible:certified:19', 2), ('shift_threshold:2:admissible:certified:7', 3), ('shift_threshold:2:admissible:certified:22', 4), ('negate_condition:2:admissible:certified', 5),
  ('and_to_or:2:admissible:certified:10', 6), ('and_to_or:2:admissible:certified:26', 7), ('flip_comparison:3:admissible:long_stop:5', 8), ('shift_threshold:3:admissible:long_stop:7', 9), ('negate_condition:3:admissible:long_stop', 10), ('drop_exception:3:admissible:long_stop', 11)),
e as (select mutant, k, d, c, case k when 1 then d <= 60 and d <= 120 and c when 2 then d > 60 and d > 120 and c when 3 then d > 61 and d <= 120 and c when 4 then d > 60 and d <= 121 and c when 5 then not (d > 60 and d <= 120 and c)
    when 6 then d > 60 or d <= 120 and c when 7 then d > 60 and d <= 120 or c else d > 60 and d <= 120 and c end one, case k when 8 then d <= 120 when 9 then d > 121 when 10 then not (d > 120) when 11 then false else d > 120 end two from f, m where fine)
select mutant, count(*) filter (where (case when two then false when one then true else d <= 60 end) <> (case when d > 120 then false when d > 60 and c then true else d <= 60 end))::bigint killing from e group by 1""")
def claim_mutants(spark, sf_dir):
    """On how many claims each change of the claim window's rules is noticed."""
    return gates.mutation_report(library.CLAIM_WINDOW, claim_facts(spark, sf_dir), ["admissible"])
