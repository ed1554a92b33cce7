"""SQL of the service credit, which several twins begin with."""

SERVICE = """
facts as (
  select o_orderkey, cast((10000 - bp) / 100.0 as decimal(9,2)) availability, cast(o_totalprice as decimal(18,2)) charge,
         cast(o_orderkey % 60 as int) arrears_days, o_orderkey % 3 <> 0 undisputed
  from orders join (select l_orderkey, sum(cast(round(l_discount * 100) as bigint)) * 100 // count(*) bp from lineitem group by 1) on l_orderkey = o_orderkey),
credits as (
  select *, case when availability < 99.90 and undisputed and arrears_days > 30 then 0.00 when availability < 95 then 0.50 when availability < 98 then 0.30
    when availability < 99 then 0.20 when availability < 99.5 then 0.10 when availability < 99.9 then 0.05 else 0.00 end credit,
    case when availability < 95 then 0.50 else 0.30 end cap,
    case when availability < 99.90 and undisputed and arrears_days > 30 then 'arrears' when availability < 95 then 'deep' when availability < 99.9 then 'bands' else 'none' end branch
  from facts)"""
