"""Sources: the driver's tables, and fact tables made of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def service_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order as a measurement period: its mean discount, in basis points, is missing from full availability."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.round(F.col("l_discount") * 100).cast("bigint").alias("d"))
    lost = lines.groupBy("l_orderkey").agg(F.expr("sum(d) * 100 div count(*)").alias("bp"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    facts = orders.join(lost, orders.o_orderkey == lost.l_orderkey)
    return facts.select(
        "o_orderkey",
        ((10000 - F.col("bp")) / 100).cast("decimal(9,2)").alias("availability"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("charge"),
        (F.col("o_orderkey") % 60).cast("int").alias("arrears_days"),
        (F.col("o_orderkey") % 3 != 0).alias("undisputed"),
    )


def hour_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item as an hour of work."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        "l_orderkey", "l_linenumber",
        F.col("l_quantity").cast("int").alias("ordinal"),
        (F.col("l_partkey") % 8 + 1).cast("int").alias("grade"),
        (F.col("l_suppkey") % 11 == 0).alias("holiday"),
        (F.col("l_returnflag") == "R").alias("critical"),
        (F.col("l_linestatus") == "O").alias("night"),
        (F.col("l_partkey") % 5 == 0).alias("allowance"),
    )


def claim_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item as a claim: ordered is incurred, shipped is submitted."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("incurred"))
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("submitted"), (F.col("l_returnflag") == "R").alias("certified"))
    return li.join(orders, li.l_orderkey == orders.o_orderkey).drop("o_orderkey")


def timesheet_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item as an hour worked in the week of a supplier and year; a few hours are of no week."""
    li, k = table(spark, sf_dir, "lineitem"), F.col("l_orderkey")
    return li.select(
        "l_suppkey", F.year("l_shipdate").alias("week"), "l_orderkey", "l_linenumber", "l_partkey",
        F.when(k % 4999 == 0, F.lit(169)).otherwise((k * 5 + F.col("l_linenumber")) % 168 + 1).cast("int").alias("hour_of_week"),
        (F.col("l_suppkey") % 8 + 1).cast("int").alias("grade"),
        (F.col("l_partkey") % 11 == 0).alias("holiday"),
        (F.col("l_returnflag") == "R").alias("critical"),
        (F.col("l_linestatus") == "O").alias("night"),
        (F.col("l_suppkey") % 5 == 0).alias("allowance"),
        (F.col("l_suppkey") % 3 == 0).alias("shift_worker"),
        (F.col("l_suppkey") % 7 * 10000 + 20001).cast("decimal(12,2)").alias("salary"),
    )


def outage_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item as an outage of a supplier's service in a month, with the business days between notice and window: the
    days on which orders were placed, but for weekends. The calendar has a row for each day that orders span, so that
    its size is known to be small."""
    ordered = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("d")).distinct()
    span = ordered.agg(F.min("d").alias("a"), F.max("d").alias("b")).select(F.explode(F.sequence(F.date_sub("a", 1), "b")).alias("day"))
    days = span.join(ordered.select(F.col("d").alias("day"), (F.weekday("d") < 5).cast("int").alias("business")), "day", "left")
    days = days.select("day", F.sum(F.coalesce("business", F.lit(0))).over(Window.orderBy("day")).alias("so_far"))
    li, part = table(spark, sf_dir, "lineitem"), F.col("l_partkey")
    start = F.col("l_shipdate").cast("date")
    out = li.select(
        "l_suppkey", F.trunc(start, "MM").alias("period_start"), "l_orderkey", "l_linenumber",
        (F.col("l_quantity") * 4).cast("bigint").alias("minutes"),
        F.date_sub(start, (part % 12).cast("int")).alias("notified"), start.alias("window_start"),
        (F.col("l_returnflag") == "N").alias("maintenance"),
        (F.col("l_returnflag") == "A").alias("emergency"),
        (part % 90).cast("int").alias("emergency_notice"),
        (part % 31 == 0).alias("force_majeure"), (part % 17 == 0).alias("customer_act"), (part % 41 == 0).alias("suspension"),
    )
    bounds = days.agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    within = lambda d: F.greatest(F.least(d, F.col("hi")), F.col("lo"))
    out = out.join(F.broadcast(bounds)).withColumns({"from_day": within(F.col("notified")), "to_day": within(F.date_sub("window_start", 1))}).drop("lo", "hi")
    for side in ("from", "to"):
        out = out.join(F.broadcast(days.select(F.col("day").alias(f"{side}_day"), F.col("so_far").alias(side))), f"{side}_day")
    return out.withColumn("notice_days", F.greatest(F.col("to") - F.col("from"), F.lit(0)).cast("int")).drop("from_day", "to_day", "from", "to")


def agreement_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer as an agreement: a section for each order, with numbers in one of four forms. A paragraph for each line
    item, with what goes on with it, and two for each order."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int").cast("string").alias("q"), "l_returnflag", "l_linestatus")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey")
    k = F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("k")
    sections = orders.join(li.select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey").select("o_custkey", "o_orderkey", k)
    j = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    lines = li.withColumn("j", j).join(sections, F.col("l_orderkey") == F.col("o_orderkey"))
    form, ks, js = F.col("o_custkey") % 4, F.col("k").cast("string"), F.col("j").cast("string")

    def numbered(n):
        return F.when(form == 0, F.concat(ks, F.lit("."), n, F.lit(" "))).when(form == 1, F.concat(n, F.lit(". "))).otherwise("")

    lot = F.concat(F.lit(" of lot "), ks, F.lit("/"), js, F.lit("."))  # else a document repeats itself, as page heads do
    say = lambda at, kind, level, text: F.struct(F.lit(at).alias("at"), F.lit(kind).alias("kind"), F.lit(level).alias("level"), text.alias("text"))
    item = F.array(
        say(0, "paragraph", 0, F.concat(numbered(js), F.when(form == 2, F.concat(F.lit("("), F.lower(F.substring(F.lit("ABCDEFGHJK"), (F.col("j") - 1) % 10 + 1, F.lit(1))), F.lit(") "))).otherwise(""), F.lit("The Supplier shall deliver "), F.col("q"), F.lit(" units"), lot)),
        say(1, "paragraph", 0, F.when((F.col("l_returnflag") == "R") & (form != 1) & (F.col("j") <= 10), F.concat(F.lit("which may be returned at any time"), lot))),
        say(2, "paragraph", 0, F.when(F.col("l_linestatus") == "O", F.concat(F.lit("• subject to inspection"), lot))),
    )
    top = F.array(
        say(0, "heading", 2, F.when(form == 0, F.concat(ks, F.lit(" Deliveries of this order"))).when(form == 1, F.concat(F.lit("ARTICLE "), ks, F.lit(" Deliveries"))).otherwise(F.concat(F.lit("Deliveries of order "), ks))),
        say(1, "paragraph", 0, F.when(form == 3, F.concat(F.lit("Page "), ks))),
    )
    body = lines.select("o_custkey", "k", F.col("j"), F.explode(item).alias("p"))
    heads = sections.select("o_custkey", "k", F.lit(0).alias("j"), F.explode(top).alias("p"))
    out = body.unionByName(heads).where("p.text is not null")
    pos = (F.col("k") * 1000 + F.col("j") * 10 + F.col("p.at")).alias("pos")
    return out.select(F.col("o_custkey").alias("doc_id"), pos, "p.kind", "p.level", "p.text")


def supply_clauses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line item as a clause on the part and the supplier that it names, with a price, a discount and a time; ``open``
    ones are incoming. ref tells a line item's copies apart."""
    li = table(spark, sf_dir, "lineitem")
    part, supplier = F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")
    price, off, days = F.format_string("%.2f", F.col("l_extendedprice")), F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.col("l_quantity").cast("int").cast("string")
    text = F.concat(F.lit('On offer: "Part '), part, F.lit('" of "Maker '), supplier, F.lit('" at $'), price, F.lit(" less "), off, F.lit("%, payable within "), days, F.lit(" days."))
    ref = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", price)
    return li.select(ref.alias("ref"), text.alias("text"), (F.col("l_linestatus") == "O").alias("open"), F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))
