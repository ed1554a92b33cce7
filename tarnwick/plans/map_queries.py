"""Queries of decision maps made from rules, over the cells that occur in the tables, and of typed predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.operators import maps, surface
from tarnwick.operators.predicates import Predicate, first_firing
from tarnwick.plans import library
from tarnwick.plans.registry import query
from tarnwick.plans.rules import apply
from tarnwick.sources import service_facts, table

SERVICE_DOMAIN = maps.Domain(
    {"availability": maps.Input("decimal(9,2)", "0.00", "100.00"), "charge": maps.Input("decimal(18,2)", probe=("1000.00",)), "arrears_days": maps.Input("int", "0", "59"), "undisputed": maps.Input("boolean")},
    favours={"credit": "counterparty", "payable": "counterparty"},
)
PRICE_DOMAIN = maps.Domain({"price": maps.Input("decimal(18,2)", "0", "150000")})

_FACTS = """
facts as (
  select o_orderkey, cast((10000 - bp) / 100.0 as decimal(9,2)) availability, cast(o_totalprice as decimal(18,2)) charge, cast(o_orderkey % 60 as int) arrears_days, o_orderkey % 3 <> 0 undisputed
  from orders join (select l_orderkey, sum(cast(round(l_discount * 100) as bigint)) * 100 // count(*) bp from lineitem group by 1) on l_orderkey = o_orderkey),
axis(availability) as (values (0.00),(94.99),(95.00),(95.01),(97.99),(98.00),(98.01),(98.99),(99.00),(99.01),(99.49),(99.50),(99.51),(99.89),(99.90),(99.91),(100.00)),
grid as (select row_number() over (order by arrears_days, availability, undisputed) - 1 as ordinal, * from axis, (values (0),(29),(30),(31),(59)) d(arrears_days), (values (true),(false)) u(undisputed)),
ruled as (select *, case when availability < 99.9 and undisputed and arrears_days > 30 then 'arrears' when availability < 95 then 'deep' when availability < 99.9 then 'bands' else 'none' end credit_by, case when availability < 95 then 'deep_cap' else 'cap' end cap_by,
  case when availability < 99.9 and undisputed and arrears_days > 30 then 0 when availability < 95 then 50 when availability < 98 then 30 when availability < 99 then 20 when availability < 99.5 then 10 when availability < 99.9 then 5 else 0 end credit from grid),
sized as (select credit_by, cap_by, count(*) size, row_number() over (order by count(*) desc, min(ordinal)) region from ruled group by all),
cells as (select * from ruled join sized using (credit_by, cap_by)),
located as (select o_orderkey, region, ordinal, abs(c.availability - f.availability) + abs(c.arrears_days - f.arrears_days) distance from facts f join cells c on c.undisputed = f.undisputed
  qualify row_number() over (partition by o_orderkey order by abs(c.availability - f.availability) + abs(c.arrears_days - f.arrears_days), region, ordinal) = 1),
people as (select ordinal, count(*) population from located group by 1)"""


@query(f"with {_FACTS} select o_orderkey, region::int region, ordinal::bigint as ordinal, (distance + abs(charge - 1000))::double distance from located join facts using (o_orderkey)")
def located_orders(spark, sf_dir):
    """Each order's cell and region on the map of the service credit's rules."""
    out = maps.locate(service_facts(spark, sf_dir), library.SERVICE_CREDIT, SERVICE_DOMAIN)
    return out.select("o_orderkey", "region", "ordinal", F.col("distance").cast("double").alias("distance"))


@query(f"""with {_FACTS} select 'credit=' || credit_by || ';cap=' || cap_by || ';payable=payable;amount=amount' signature, max(size)::bigint size, count(*)::bigint occurring, sum(population)::bigint population
from cells join people using (ordinal) group by all""")
def surface_regions(spark, sf_dir):
    """The regions that occur: how many cells of how many the orders lie in."""
    there = maps.populate(service_facts(spark, sf_dir), library.SERVICE_CREDIT, SERVICE_DOMAIN)
    return there.groupBy("signature").agg(F.max("size").alias("size"), F.count("*").alias("occurring"), F.sum("population").alias("population"))


@query(f"""with {_FACTS}, struck as (select *, case when credit_by = 'arrears' then 0 when availability < 95 then 30 else credit end after from cells)
select availability::double availability, arrears_days::int arrears_days, undisputed, case when least(after, 30) <> least(credit, case when availability < 95 then 50 else 30 end) then 'revalued' else 'regoverned' end kind,
  (least(after, 30) - least(credit, case when availability < 95 then 50 else 30 end))::double * 10 delta, population::bigint population from struck join people using (ordinal) where availability < 95""")
def surface_diff(spark, sf_dir):
    """What striking out the deep band and its cap moves, on the cells that orders lie in."""
    changed = library.SERVICE_CREDIT.without("deep").without("deep_cap")
    out = maps.moved(service_facts(spark, sf_dir), library.SERVICE_CREDIT, changed, SERVICE_DOMAIN, "amount")
    return out.select(F.col("availability").cast("double").alias("availability"), "arrears_days", "undisputed", "kind", F.col("delta").cast("double").alias("delta"), "population")


@query(f"""with {_FACTS}, b(variable, operator, literal, label) as (values ('availability','<','99.90','bands'),('availability','>=','99.50','bands'),('availability','<','99.50','bands'),('availability','>=','99.00','bands'),('availability','<','99.00','bands'),
  ('availability','>=','98.00','bands'),('availability','<','98.00','bands'),('availability','<','95.00','deep'),('arrears_days','>','30','arrears'))
select variable, operator, literal, label, count(*) filter (where x < literal::decimal(9,2))::bigint "below", count(*) filter (where x = literal::decimal(9,2))::bigint "at", count(*) filter (where x > literal::decimal(9,2))::bigint "above"
from b, (select availability, arrears_days from facts) f, lateral (select case variable when 'availability' then availability else arrears_days end x) group by all""")
def border_population(spark, sf_dir):
    """How many orders lie on either side of every border that the rules draw."""
    return maps.border_population(service_facts(spark, sf_dir), library.SERVICE_CREDIT, SERVICE_DOMAIN)


@query("""with c(price) as (values (0),(999),(1000),(1001),(99999),(100000),(100001),(150000)),
r as (select *, row_number() over (order by price) o, case when price < 1000 then 3 when price < 100000 then 1 else 2 end region from c),
n as (select r.price, count(*) population from (select row_number() over () k, cast(l_extendedprice as decimal(18,2)) x from lineitem) l, lateral (select price from r order by abs(price - x), region, o limit 1) r group by 1)
select price::double price, case when price < 1000 then 'NoApplicableRule' else 'Conflict' end err, true near, 2000.0::double low, 2000.0::double high, 0.0::double amount, population::bigint population from n where price < 1000 or price >= 100000""")
def undetermined_amounts(spark, sf_dir):
    """The cells that two rival clauses leave undecided, where line items lie in them, and what turns on that."""
    prices = table(spark, sf_dir, "lineitem").select(F.col("l_extendedprice").cast("decimal(18,2)").alias("price"))
    there = maps.populate(prices, library.RIVAL_CAPS, PRICE_DOMAIN).select("price", "population")
    open_ = surface.undetermined(maps.surface(spark, library.RIVAL_CAPS, PRICE_DOMAIN), ["price"], "cap")
    return open_.join(there, "price").select(*(F.col(c).cast("double").alias(c) if c in ("price", "low", "high", "amount") else c for c in ("price", "err", "near", "low", "high", "amount", "population")))


CONTENTIONS = (
    Predicate("capped", ("availability < 95", "undisputed = false", "payable < 0.5"), "payable", "@cap"),
    Predicate("barred", ("credit = 0", "availability < 99.9"), "payable", "0.10"),
    Predicate("never", ("undisputed = 1",), "payable", "1"),
    Predicate("late", ("arrears_days >= 45", "gone != 3"), "credit", "@gone"),
    Predicate("large", ("charge > 250000.50",), "err", "x"),
)


@query(f"""with {_FACTS}, r as (select *, case when availability < 99.9 and undisputed and arrears_days > 30 then 0 when availability < 95 then 0.5 when availability < 98 then 0.3 when availability < 99 then 0.2 when availability < 99.5 then 0.1 when availability < 99.9 then 0.05 else 0 end credit,
  case when availability < 95 then 0.5 else 0.3 end cap from facts), p as (select *, least(credit, cap) payable from r)
select o_orderkey, case when availability < 95 and not undisputed and payable < 0.5 then 'capped' when credit = 0 and availability < 99.9 then 'barred' when charge > 250000.50 then 'large' end predicate,
  case when availability < 95 and not undisputed and payable < 0.5 then cap - payable when credit = 0 and availability < 99.9 then 0.1 - payable end::double amount from p""")
def contentions(spark, sf_dir):
    """The first of some contentions that fires on an order, and how much it is about."""
    out = first_firing(apply(library.SERVICE_CREDIT, service_facts(spark, sf_dir)), CONTENTIONS)
    return out.select("o_orderkey", "predicate", F.col("amount").cast("double").alias("amount"))


@query(f"""with {_FACTS}, caught as (select *, least(credit, case when availability < 95 then 50 else 30 end) payable from cells where arrears_days > 29 and undisputed),
by_region as (select region, max(size) size, count(*) caught, count(*) filter (where payable < 20) hit, count(*) filter (where payable = 20) same, count(*) filter (where payable > 20) against from caught group by 1),
n as (select region, count(*) people from located group by 1)
select region::int region, caught::bigint caught, hit::bigint hit, same::bigint same, against::bigint against, size::bigint size, case when hit = size then coalesce(people, 0) else 0 end::bigint population from by_region left join n using (region)""")
def holding_impact(spark, sf_dir):
    """A ruling that a fifth is owed in undisputed cases after thirty days: which regions it would move, and whose."""
    holding = Predicate("fifth", ("arrears_days > 29", "undisputed = true"), "payable", "0.20")
    return maps.holding_impact(service_facts(spark, sf_dir), library.SERVICE_CREDIT, SERVICE_DOMAIN, holding)
