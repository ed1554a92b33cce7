"""Queries of the rule language's values: errors that are carried, numbers, dates, months, periods, lists and structs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarnwick.functions import calendar as cal
from tarnwick.functions import checked as c
from tarnwick.functions import lists, scalars
from tarnwick.plans.registry import query
from tarnwick.sources import table


def _told(facts, keys: list[str], **results: c.Checked):
    """A column for each result and one for its error; decimals as doubles."""
    show = lambda r: r.value.cast("double") if r.kind in ("rat", "money") else r.value.cast("string") if r.kind == "date" else r.value
    facts, staged = c.staged(facts, results)
    facts = facts.withColumns({f"_{n}": r.both for n, r in staged.items()})
    done = {n: c.Checked(r.kind, F.col(f"_{n}")) for n, r in results.items()}
    return facts.select(*keys, *(x for n, r in done.items() for x in (show(r).alias(n), r.err.alias(f"{n}_err"))))


@query("""with f as (select o_orderkey k, cast(round(o_totalprice * 100) as hugeint) n, (o_custkey % 5)::hugeint d, (o_custkey % 3)::hugeint e from orders)
select k o_orderkey, case when d > 0 then (2 * n + d) // (2 * d) end::double / 100 share, case when d = 0 then 'DivisionByZero' end share_err,
  case when e > 0 then (2 * n * 10000 + e) // (2 * e) end::double / 1000000 ratio, case when e = 0 then 'DivisionByZero' end ratio_err,
  case when d > 0 and e > 0 then false end "both", case when d = 0 or e = 0 then 'DivisionByZero' end both_err,
  (n + 50) // 100 as units, cast(null as varchar) units_err, n // 100 as cut, cast(null as varchar) cut_err,
  case when d > 0 then -((2 * n + d) // (2 * d)) * 3 end::double / 100 back, case when d = 0 then 'DivisionByZero' end back_err,
  case when d > 0 then ((k * 2000000 + d) // (2 * d) >= 5000000000) <> (k % 2 = 0) end odd, case when d = 0 then 'DivisionByZero' end odd_err from f""")
def checked_numbers(spark, sf_dir):
    """Divisions by zero, alone and within; a false operand hides no error of the other."""
    k, m, d, e = c.given("o_orderkey", "int"), c.given(F.col("o_totalprice").cast("decimal(18,2)"), "money"), c.given(F.col("o_custkey") % 5, "int"), c.given((F.col("o_custkey") % 3 / 100).cast("decimal(18,2)"), "money")
    never = c.compared(c.over(m, d), "<", c.literal(0, "money"))
    return _told(
        table(spark, sf_dir, "orders"),
        ["o_orderkey"],
        share=c.over(m, d),
        ratio=c.over(m, c.times(e, c.literal(100, "int"))),
        both=c.both(never, c.compared(c.over(m, e), ">", c.literal(0, "rat"))),
        units=c.converted(m, "int"),
        cut=c.converted(c.converted(m, "rat"), "int"),
        back=c.times(c.negative(c.over(m, d)), c.literal(3, "int")),
        odd=c.exactly_one(c.compared(c.over(k, d), ">=", c.literal(5000, "rat")), c.compared(c.literal(0, "int"), "=", c.given(F.col("o_orderkey") % 2, "int"))),
    )


@query("""with f as (select l_orderkey, l_linenumber, l_shipdate::date d, (l_partkey % 13)::int m, (l_suppkey % 40)::int n, (l_linenumber % 3)::int z from lineitem),
g as (select *, (d + to_months(m))::date moved, (d - to_months(m))::date back from f),
h as (select *, day(moved) < day(d) short, day(back) < day(d) short_back from g)
select l_orderkey, l_linenumber, case when not short then (moved + n)::varchar end later, case when short then 'DateError' end later_err,
  case when short_back then (back + 1)::varchar else back::varchar end earlier, cast(null as varchar) earlier_err,
  case when z <> 0 then ((2 * n * 1000000::hugeint + z) // (2 * z)) end::double / 1000000 ratio, case when z = 0 then 'DivisionByZero' end ratio_err,
  case when m = 0 or n = 0 then m < 0 or (m = 0 and 0 < n) end shorter, case when m > 0 and n > 0 then 'DateError' end shorter_err,
  case when m = 0 or n = 0 then m = n end alike, case when m > 0 and n > 0 then 'DateError' end alike_err,
  case when not short then datediff('day', d, moved + n)::int end apart, case when short then 'DateError' end apart_err,
  case when m = 0 then (n * 3 + 1)::int end tripled, case when m > 0 then 'DateError' end tripled_err from h""")
def checked_dates(spark, sf_dir):
    """Days that don't exist, durations of different units, ratios of durations."""
    d, m, n, z = c.given(F.col("l_shipdate").cast("date"), "date"), (F.col("l_partkey") % 13).cast("int"), (F.col("l_suppkey") % 40).cast("int"), (F.col("l_linenumber") % 3).cast("int")
    months, days = c.duration(months=m), c.duration(days=n)
    later = c.plus(d, c.plus(months, days))
    apart = c.minus(later, d)
    in_days = c.times(c.plus(c.minus(c.plus(months, days), months), c.duration()), c.literal(3, "int"))
    tripled = c.over(c.plus(c.plus(in_days, c.duration(days=1)), months), c.duration(days=1))
    return _told(
        table(spark, sf_dir, "lineitem"),
        ["l_orderkey", "l_linenumber"],
        later=later,
        earlier=c.minus(d, months, "up"),
        ratio=c.over(days, c.duration(days=z)),
        shorter=c.compared(months, "<", days),
        alike=c.compared(months, "=", days),
        apart=c.operation("int", lambda x: x["days"].cast("bigint"), apart),
        tripled=c.converted(tripled, "int"),
    ).withColumns({x: F.col(x).cast("int") for x in ("apart", "tripled")})


@query("""with l as (select l_orderkey, list(cast(l_quantity as int) order by l_linenumber, l_quantity) q from lineitem group by 1), f as (select *, list_filter(q, lambda x: x > 30) big, list_filter(q, lambda x: x % 10 = 0) zeros from l)
select l_orderkey, list_max(big) most, case when len(big) = 0 then 'ListEmpty' end most_err, coalesce(list_min(big), -1) least, cast(null as varchar) least_err,
  case when len(big) = len(q) then list_sum(list_transform(q, lambda x: x * x)) end::bigint paired, case when len(big) <> len(q) then 'NotSameLength' end paired_err,
  case when len(zeros) = 0 then list_sum(list_transform(q, lambda x: (2000000 + x % 10) // (2 * (x % 10)))) end::double / 1000000 parts, case when len(zeros) > 0 then 'DivisionByZero' end parts_err,
  case when len(zeros) = 0 and len(big) > 0 then list_max(big) > 40 end nested, case when len(big) = 0 then 'ListEmpty' when len(zeros) > 0 then 'DivisionByZero' end nested_err from f""")
def checked_lists(spark, sf_dir):
    """Empty lists, lists of different lengths, and an element's error, which is the list's."""
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", F.col("l_quantity").cast("int").alias("q")))).alias("l"))
    rows = rows.select("l_orderkey", F.transform("l", lambda x: x["q"].cast("bigint")).alias("q"))
    q, big = c.given("q", "list of int"), c.given(F.filter("q", lambda x: x > 30), "list of int")
    parts = c.total(c.each(q, lambda x: c.over(c.literal(1, "int"), c.operation("int", lambda v: v % 10, x))))
    most = c.extreme(big, True)
    return _told(
        rows,
        ["l_orderkey"],
        most=most,
        least=c.extreme(big, False, c.literal(-1, "int")),
        paired=c.total(c.zipped(q, big, lambda x, y: x * y, "int")),
        parts=parts,
        nested=c.both(c.compared(most, ">", c.literal(40, "int")), c.compared(parts, ">", c.literal(0, "rat"))),
    )


@query("""with f as (select l_orderkey, l_linenumber, l_partkey % 10 k, l_shipdate::date d, l_returnflag r, cast(l_quantity as int) q from lineitem)
select l_orderkey, l_linenumber, case k when 9 then q when 8 then q end::bigint "result",
  case k when 0 then 'AssertionFailed' when 1 then 'NoValue' when 2 then 'Conflict' when 3 then 'DivisionByZero' when 4 then 'ListEmpty' when 5 then 'NotSameLength' when 6 then 'UncomparableValues'
    when 7 then 'DateError' when 8 then null when 9 then null end result_err,
  case r when 'R' then 1 when 'A' then 2 end::bigint matched, case when r = 'N' then 'Impossible' end matched_err,
  case when k = 3 then q else trunc(q / (k - 3)) end::bigint guarded, cast(null as varchar) guarded_err,
  case when q > 10 and q <= 40 then 'middle' when q <= 10 then 'low' end band, case when q > 40 and q % 2 = 0 then 'Conflict' when q > 40 then 'NoValue' end band_err from f""")
def checked_rules(spark, sf_dir):
    """All nine codes: what is reached first counts, and a branch that isn't taken doesn't."""
    k, q = F.col("l_partkey") % 10, c.given(F.col("l_quantity").cast("bigint"), "int")
    at = lambda n: c.given(k == n, "bool")
    some, none = c.given(F.array(F.lit(1), F.lit(2)).cast("array<bigint>"), "list of int"), c.given(F.array().cast("array<bigint>"), "list of int")
    value = q
    end_of_month = c.plus(c.given(F.lit("2023-01-31").cast("date"), "date"), c.duration(months=1))
    late = c.operation("int", lambda d: F.day(d), end_of_month)
    for n, wrong in (
        (7, late),
        (6, c.chosen(c.compared(c.literal("f", "function"), "<", c.literal("g", "function")), q, q)),
        (5, c.total(c.zipped(some, none, lambda x, y: x + y, "int"))),
        (4, c.extreme(none, True)),
        (3, c.converted(c.over(q, c.literal(0, "int")), "int")),
        (2, c.only_one((at(2), q), (c.opposite(at(9)), q))),
        (1, c.only_one((at(3), q), (at(4), q))),
    ):
        value = c.chosen(at(n), wrong, value)
    result = c.asserting(c.opposite(at(0)), value)
    tag, high = c.given("l_returnflag", "text"), c.given((F.col("l_quantity") > 40) & (F.col("l_quantity").cast("int") % 2 == 0), "bool")
    middle = c.both(c.compared(q, ">", c.literal(10, "int")), c.compared(q, "<=", c.literal(40, "int")))
    return _told(
        table(spark, sf_dir, "lineitem"),
        ["l_orderkey", "l_linenumber"],
        result=result,
        matched=c.matched(tag, {"R": c.literal(1, "int"), "A": c.literal(2, "int"), "N": c.failing(c.IMPOSSIBLE, "int")}, ("R", "A", "N")),
        guarded=c.chosen(at(3), q, c.converted(c.over(q, c.given(k - 3, "int")), "int")),
        band=c.only_one((c.compared(q, "<=", c.literal(10, "int")), c.literal("low", "text")), (middle, c.literal("middle", "text")), (high, c.literal("high", "text")), (high, c.literal("even", "text"))),
    )


@query("""with f as (select l_orderkey, l_linenumber, cast(round(l_extendedprice * 100) as bigint) - 4000000 n from lineitem)
select l_orderkey, l_linenumber, ceil(n / 100.0)::bigint up, floor(n / 100.0)::bigint down, trunc(n / 100.0)::bigint cut, (sign(n) * ((abs(n) + 50) // 100))::bigint nearest,
  (sign(n) * ((abs(n) + 5) // 10))::double / 10 tenths, (sign(n) * ((abs(n) + 5000) // 10000))::double * 100 hundreds, greatest(n - 100000, 0)::double / 100 excess, greatest(100000 - n, 0)::double / 100 short,
  greatest(n, 0)::double / 100 positive, least(n, 5000)::double / 100 ceiling, greatest(n, 5000)::double / 100 floor from f""")
def number_rounding(spark, sf_dir):
    x, ref = (F.col("l_extendedprice").cast("decimal(18,2)") - F.lit(40000)).cast("decimal(18,2)"), F.expr("1000.00")
    of = {"up": scalars.up(x), "down": scalars.down(x), "cut": scalars.truncate(x), "nearest": scalars.round_units(x)}
    more = {"tenths": scalars.to_decimal(x, 1), "hundreds": scalars.to_decimal(x, -2), "excess": scalars.in_excess(x, ref), "short": scalars.in_default(x, ref), "positive": scalars.positive(x), "ceiling": scalars.at_most(x, F.expr("50.00")), "floor": scalars.at_least(x, F.expr("50.00"))}
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *(v.cast("bigint").alias(k) for k, v in of.items()), *(v.cast("double").alias(k) for k, v in more.items()))


@query("""with f as (select o_orderkey k, o_orderdate::date d, (o_orderkey % 31 + 1)::int dd, (o_custkey % 12 + 1)::int mm, (o_custkey % 40)::int as months from orders),
g as (select *, make_date(year(d), mm, 1) as first, try_cast(printf('%04d-%02d-%02d', year(d), mm, dd) as date) made, (d + to_months(months))::date birthday from f)
select k o_orderkey, made::varchar made, date_trunc('month', d)::date::varchar month_first, date_trunc('year', d)::date::varchar year_first, make_date(year(d), 12, 31)::varchar year_last,
  monthname(d) as "named", month(d)::int as "numbered", d < first as is_before, d > last_day(first) as is_after, d >= first and d <= last_day(first) as is_in, d <= last_day(first) as to_its_end, d >= first as from_its_start,
  date '2000-03-01' >= birthday old_down, date '2000-03-01' >= birthday + (case when day(birthday) < day(d) then 1 else 0 end) old_up, not (date '2000-03-01' >= birthday) young_down,
  not (date '2000-03-01' >= birthday + (case when day(birthday) < day(d) then 1 else 0 end)) young_up from g""")
def date_parts(spark, sf_dir):
    d, months = F.col("o_orderdate").cast("date"), (F.col("o_custkey") % 40).cast("int")
    made = cal.date_of(F.year(d), (F.col("o_custkey") % 12 + 1).cast("int"), (F.col("o_orderkey") % 31 + 1).cast("int"))
    month = cal.month_year(F.make_date(F.year(d), (F.col("o_custkey") % 12 + 1).cast("int"), F.lit(1)))
    at = F.lit("2000-03-01").cast("date")
    text = {"made": made, "month_first": cal.first_of_month(d), "year_first": cal.first_of_year(d), "year_last": cal.last_of_year(d)}
    tests = {"is_before": cal.before_month, "is_after": cal.after_month, "is_in": cal.in_month, "to_its_end": cal.before_or_during, "from_its_start": cal.during_or_after}
    ages = {f"{n}_{r}": f(d, months, at, r) for n, f in (("old", cal.old_enough), ("young", cal.young_enough)) for r in ("down", "up")}
    rows = table(spark, sf_dir, "orders")
    return rows.select("o_orderkey", *(v.cast("string").alias(k) for k, v in text.items()), cal.month_year(d)["month_name"].alias("named"), cal.month_number(cal.month_name(cal.parts(d)["month"])).alias("numbered"), *(f(month, d).alias(k) for k, f in tests.items()), *(v.alias(k) for k, v in ages.items()))


@query("""with f as (select l_orderkey, l_linenumber, o_orderdate::date a, l_shipdate::date b, l_shipdate::date - (l_partkey % 60)::int e from lineitem join orders on o_orderkey = l_orderkey),
g as (select *, date_trunc('month', b)::date m, last_day(b) n, make_date(year(a), 1, 1) y, make_date(year(a), 12, 31) z from f)
select l_orderkey, l_linenumber, a <= b as "valid", least(a, m)::varchar joined_begin, greatest(b, n)::varchar joined_end, case when greatest(a, m) <= least(e, n) then greatest(a, m)::varchar end common_begin,
  y <= a and e <= z as covered, a <= e and e <= b as "contains", e < a as is_before, e > n as is_after, b = a - 1 as "follows", case when m <= e and e <= n then 'month' when y <= e and e <= z then 'year' end found,
  case when a <= least(m, y) then 'own' when m <= y then 'month' else 'year' end earliest from g""")
def period_algebra(spark, sf_dir):
    a, b = F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")
    e = F.date_sub(b, (F.col("l_partkey") % 60).cast("int"))
    own, month, year = scalars.period(a, b), cal.period_of_month(F.month(b), F.year(b)), cal.period_of_year(F.year(a))
    named = lambda n, p: F.struct(p["begin"].alias("begin"), p["end"].alias("end"), F.lit(n).alias("name"))
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        "l_orderkey", "l_linenumber", cal.valid(own).alias("valid"), cal.joined(own, month)["begin"].cast("string").alias("joined_begin"), cal.joined(own, month)["end"].cast("string").alias("joined_end"),
        cal.common(scalars.period(a, e), month)["begin"].cast("string").alias("common_begin"), cal.covers(year, scalars.period(a, e)).alias("covered"), cal.contains(own, e).alias("contains"),
        cal.before(own, e).alias("is_before"), cal.after(month, e).alias("is_after"), cal.follows(scalars.period(a, b), own).alias("follows"),
        cal.find_period(F.array(named("month", month), named("year", year)), e)["name"].alias("found"),
        lists.nth(cal.sort_by_date(F.array(named("own", own), named("month", month), named("year", year))), F.lit(1))["name"].alias("earliest"),
    )


@query("""with p as (select l_orderkey, l_linenumber, o_orderdate::date b, l_shipdate::date + (l_partkey % 900)::int e from lineitem join orders on o_orderkey = l_orderkey),
q as (select *, case when month(b) < 4 then year(b) - 1 else year(b) end y, case when month(e - 1) < 4 then year(e - 1) - 1 else year(e - 1) end z from p where b < e),
m as (select *, make_date(unnest(generate_series(y, greatest(z, y))), 4, 1) f from q)
select l_orderkey, l_linenumber, greatest(f, b)::varchar part_begin, (case when (f + interval 1 year)::date >= e then e else (f + interval 1 year)::date - 1 end)::varchar part_end from m""")
def year_split(spark, sf_dir):
    """Years that begin in April."""
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    p = scalars.period(F.col("o_orderdate").cast("date"), F.date_add(F.col("l_shipdate").cast("date"), (F.col("l_partkey") % 900).cast("int")))
    return rows.select("l_orderkey", "l_linenumber", F.explode(cal.split_by_year(p, 4)).alias("p")).select("l_orderkey", "l_linenumber", F.col("p.begin").cast("string").alias("part_begin"), F.col("p.end").cast("string").alias("part_end"))


@query("""with l as (select l_orderkey, list(cast(l_quantity as int) order by l_linenumber, l_quantity) q, list(l_linenumber::int order by l_linenumber, l_quantity) n from lineitem group by 1), s as (select *, list_filter(q, lambda x: x > 25) big from l)
select l_orderkey, array_to_string(list_reverse(q), ',') reversed, list_reduce(list_concat([0], list_transform(list_zip(q, range(1, len(q) + 1)), lambda z: (z[1] * (len(q) - z[2] + 1))::int)), lambda a, x: a + x)::bigint weighted,
  list_max(big) as reduced, array_to_string(list_concat(q, big), ',') as joined, q[len(q)] "last", array_to_string(q[2:], ',') but_first, array_to_string(q[:len(q) - 1], ',') but_last,
  array_to_string(list_transform(list_filter(list_zip(q, range(1, len(q) + 1)), lambda z: z[2] <> 2), lambda z: z[1]), ',') but_second, list_aggregate(list_transform(q, lambda x: x > 45), 'bool_or') "some", len(big) = len(q) "every",
  list_contains(q, 17) as has_17, big[1] as found, n < q as is_less, big = q as "same", array_to_string(range(list_min(q), list_min(q) + 3), ',') as counted, list_min(coalesce(big, [])) as least_big from s""")
def list_algebra(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").cast("int").alias("n"), F.col("l_quantity").cast("int").alias("q")))).alias("l"))
    rows = rows.select("l_orderkey", F.transform("l", lambda x: x["q"]).alias("q"), F.transform("l", lambda x: x["n"]).alias("n"))
    rows = rows.withColumn("big", F.filter("q", lambda x: x > 25))
    q, big = F.col("q"), F.col("big")
    say = lambda xs: F.array_join(xs.cast("array<string>"), ",")
    running = lists.fold(q, F.struct(F.lit(0).cast("bigint").alias("sum"), F.lit(0).cast("bigint").alias("all")), lambda a, x: F.struct((a["sum"] + x).alias("sum"), (a["all"] + a["sum"] + x).alias("all")))
    return rows.select(
        "l_orderkey", say(lists.reverse(q)).alias("reversed"), running["all"].alias("weighted"), lists.reduce(big, lambda a, x: F.greatest(a, x)).alias("reduced"), say(lists.concat(q, big)).alias("joined"), lists.last(q).alias("last"),
        say(lists.without_first(q)).alias("but_first"), say(lists.without_last(q)).alias("but_last"), say(lists.without_nth(q, F.lit(2))).alias("but_second"), lists.exists(q, lambda x: x > 45).alias("some"),
        lists.every(q, lambda x: x > 25).alias("every"), lists.contains(q, F.lit(17)).alias("has_17"), lists.find(q, lambda x: x > 25).alias("found"), lists.before(F.col("n"), q).alias("is_less"), (big == q).alias("same"),
        say(lists.sequence(F.array_min(q).cast("bigint"), F.array_min(q).cast("bigint") + 3)).alias("counted"), lists.smallest(big, F.lit(None).cast("int")).alias("least_big"),
    )


@query("""select event_id, json_extract_string(props, '$.k')::int as k, json_extract_string(props, '$.ref') as ref, event_type || ':' || coalesce(value, 0)::decimal(18,2)::varchar as tagged, case when event_type = 'purchase' then 'paid' when event_type = 'error' then 'failed' else 'seen' end as kind,
  (coalesce(value, 0) > 0) <> (event_type = 'view') as one_only from events""")
def struct_values(spark, sf_dir):
    """Structs read from JSON, built, changed and matched by tag."""
    row = F.from_json("props", "k int, ref string")
    injected = F.struct(F.col("event_type").alias("tag"), F.coalesce("value", F.lit(0.0)).cast("decimal(18,2)").alias("payload"))
    changed = injected.withField("payload", injected["payload"] + 0)
    kind = c.matched(c.Checked("text", F.struct(injected["tag"].alias("value"), F.lit(None).cast("string").alias("err")), True), {"purchase": c.literal("paid", "text"), "error": c.literal("failed", "text")}, ("purchase", "error", "view", "click", "signup"), c.literal("seen", "text"))
    one = c.exactly_one(c.given(F.coalesce("value", F.lit(0.0)) > 0, "bool"), c.given(F.col("event_type") == "view", "bool"))
    return table(spark, sf_dir, "events").select("event_id", row["k"].alias("k"), row["ref"].alias("ref"), F.concat_ws(":", changed["tag"], changed["payload"].cast("string")).alias("tagged"), kind.value.alias("kind"), one.value.alias("one_only"))
