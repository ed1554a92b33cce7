"""Conflicts between incoming clauses and those that are there: figures that differ on one subject, terms defined again,
clauses encoded twice, and documents that state incompatible quantities.

Clauses are rows (ref, text). Two are about the same thing if they share at least two terms: quoted ones, or runs of
capitalised words. Pairs are found without comparing all: terms are ranked by how rare they are over both sides, and two
clauses that share two terms share one that isn't the most common of either. So each clause is looked up by all its terms
but its most common one, and a pair counts at the rarest term it shares only. A term that many clauses hold is dealt by
blocks of both sides, sized by counts that are checked for each term, so that no task gets all of one. The result is
exact.

Before figures are compared, clauses that share two terms with none of the other side are left out (``meeting``): of a
clause only hashes of its terms, two by two, are shuffled, not its text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: How terms, definitions and quantities are written, and words that are no subject.
QUOTED = r'"([^"]{2,80})"'
CAPITALISED = r"\b([A-Z][a-z]+(?:\s+[A-Z][a-z]+){0,3})\b"
DEFINES = r'"([^"]{2,80})"\s+means\b'
MONEY, PERCENT, TIMES, SPAN = r"(?:£|\$|€)\s?([\d,]+(?:\.\d+)?)", r"(\d+(?:\.\d+)?)\s?%", r"(\d+(?:\.\d+)?)\s+times", r"(\d+)\s+(day|days|month|months|year|years|hour|hours)"
RATIO = r"(?i)(?:per|for) every\s+(?:\w+\s+)?\(?(\d+)\)?"
DEADLINE = r"(?i)immediately|next regular pay\w*|within \w+ \(?(\d+)\)?\s*hours|at the time of (?:quitting|termination|discharge)"
NO_SUBJECT = frozenset(
    x.lower()
    for x in (
        "The", "This", "By", "Where", "An", "A", "No", "Each", "Any", "Notwithstanding", "Employee", "Company", "Policy", "Plan", "Agreement", "Annex", "Schedule",
        "Standard", "Service", "Customer", "Supplier", "Tier", "Recipient", "Discloser", "An Employee", "The Employee", "The Company", "Such an Employee",
        "Base Hourly Rate", "Payroll Week", "Where an Employee", "This Policy", "Travel Day", "Plan Year", "Measurement Period", "Data Class",
    )
)
#: Clauses of a term that one block holds.
BLOCK = 4096
#: Terms up to which a clause is listed by every two of them, and words of 64 bits that hashes of such pairs are kept in.
PAIRED, WORDS = 16, 1 << 20


def terms(text: Column) -> Column:
    """The subjects of a text, in small letters; capitalised ones of two words or more."""
    quoted, runs = F.regexp_extract_all(text, F.lit(QUOTED), F.lit(1)), F.regexp_extract_all(text, F.lit(CAPITALISED), F.lit(1))
    found = F.transform(F.concat(quoted, F.filter(runs, lambda r: r.contains(" "))), F.lower)
    return F.array_distinct(F.filter(found, lambda t: ~t.isin(*sorted(NO_SUBJECT))))


def numbers(text: Column) -> Column:
    """The figures of a text, without thousands' commas; spans of time with their unit."""
    plain = [F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in (MONEY, PERCENT, TIMES)]
    spans = F.regexp_extract_all(text, F.lit(SPAN), F.lit(0))
    return F.array_distinct(F.concat(F.transform(F.concat(*plain), lambda n: F.replace(n, F.lit(","), F.lit(""))), F.transform(spans, lambda s: F.regexp_replace(s, r"\s+", " "))))


def defined(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(DEFINES), F.lit(1)), F.lower))


def meeting(incoming: DataFrame, existing: DataFrame, paired: int = PAIRED, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """The clauses of both sides, equal ones once, that share two terms with one of the other side, and few that don't.

    Hashes of every two terms are counted by side, and those on both sides set three bits each in one of ``words`` words,
    which are broadcast: bounded, whatever the tables' size. A clause stays if the bits of some pair of its terms are set.
    A clause of more than ``paired`` terms isn't listed by pairs: it stays, and so does any that shares a term with it."""
    ones = lambda ts: F.transform(ts, lambda a: F.xxhash64(a))
    twos = lambda ts: F.flatten(F.transform(ts, lambda a, i: F.transform(F.slice(ts, i + 2, F.size(ts)), lambda b: F.xxhash64(a, b))))
    # As in sharing, terms are read once, in one expression.
    each = lambda of: F.explode(F.flatten(F.transform(F.array(F.array_sort(terms(F.coalesce("text", F.lit(""))))), of)))
    few = lambda ts: F.size(ts) <= paired
    marked = lambda keys, sides: F.transform(keys, lambda k: F.struct(k.alias("key"), F.lit(sides).alias("sides")))
    said = lambda rows, side: rows.select(each(lambda ts: F.when(few(ts), marked(twos(ts), side)).otherwise(marked(ones(ts), 3))).alias("k")).select("k.*")
    both = said(incoming, 1).union(said(existing, 2)).groupBy("key").agg(F.bit_or("sides").alias("sides")).where("sides = 3")

    bit = lambda at: F.call_function("shiftleft", F.lit(1).cast("bigint"), F.shiftright("key", at).bitwiseAND(63).cast("int"))
    mask = bit(0).bitwiseOR(bit(6)).bitwiseOR(bit(12))
    word = F.pmod(F.shiftright("key", 18), F.lit(words)).alias("word")
    bits = F.broadcast(both.select(word, mask.alias("mask")).groupBy("word").agg(F.bit_or("mask").alias("bits")))

    def staying(rows: DataFrame) -> DataFrame:
        asked = rows.select("ref", "text", each(lambda ts: F.when(few(ts), F.concat(ones(ts), twos(ts))).otherwise(ones(ts))).alias("key"))
        return asked.select("ref", "text", word, mask.alias("mask")).join(bits, "word").where(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask")).select("ref", "text").distinct()

    return staying(incoming), staying(existing)


def sharing(incoming: DataFrame, existing: DataFrame, least: int = 2, block: int = BLOCK) -> DataFrame:
    """ref, existing_ref and shared (rarest first) of all pairs that share ``least`` terms or more, each once."""
    # Terms are read by patterns once: in one expression with the test of their number, which no filter repeats, and in one
    # shuffle by term, of the same columns for the counts and for the clauses.
    enough = F.explode(F.flatten(F.filter(F.array(terms(F.coalesce("text", F.lit("")))), lambda ts: F.size(ts) >= least)))
    listed = incoming.select("ref", F.lit(True).alias("new"), enough.alias("t")).union(existing.select("ref", F.lit(False).alias("new"), enough.alias("t")))
    listed = listed.repartition("t")
    of = lambda side: F.count(F.when(side, F.struct("ref")))
    counts = listed.groupBy("t").agg(of(F.col("new")).alias("n_new"), of(~F.col("new")).alias("n_old"))
    counts = counts.where("n_new > 0 and n_old > 0")  # others join nothing
    one = F.struct((F.col("n_new") + F.col("n_old")).alias("n"), "t")
    slots = lambda n: F.ceil(F.col(n) / block).cast("int")
    met = listed.join(counts, "t")
    ranked = met.groupBy("ref", "new").agg(F.array_sort(F.collect_set(F.struct(one.alias("rank"), slots("n_new").alias("s_new"), slots("n_old").alias("s_old")))).alias("rs")).where(F.size("rs") >= least)
    row = F.col("rs")
    looked_up = ranked.select("ref", "new", F.transform(row, lambda r: r["rank"]["t"]).alias("ts"), F.explode(F.slice(row, 1, F.size(row) - (least - 1))).alias("r"))
    mine = F.pmod(F.xxhash64("ref"), F.when(F.col("new"), F.col("r.s_new")).otherwise(F.col("r.s_old"))).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.when(F.col("new"), F.col("r.s_old")).otherwise(F.col("r.s_new")) - 1))
    dealt = looked_up.select("ref", "new", "ts", F.col("r.rank.t").alias("t"), mine.alias("mine"), other.alias("other"))
    a = dealt.where("new").select("t", F.col("mine").alias("i"), F.col("other").alias("j"), "ref", F.col("ts").alias("a"))
    b = dealt.where("not new").select("t", F.col("other").alias("i"), F.col("mine").alias("j"), F.col("ref").alias("existing_ref"), F.col("ts").alias("b"))
    pairs = a.join(b, ["t", "i", "j"]).withColumn("shared", F.array_intersect("a", "b"))
    return pairs.where((F.size("shared") >= least) & (F.get("shared", F.lit(0)) == F.col("t"))).select("ref", "existing_ref", "shared")


def numeric_divergence(incoming: DataFrame, existing: DataFrame, block: int = BLOCK) -> DataFrame:
    """ref, existing_ref, differing (figures of the incoming clause that the other lacks, sorted) and shared: pairs on one
    subject that both state figures."""
    incoming, existing = meeting(incoming, existing)
    pairs = sharing(incoming, existing, 2, block)
    # Figures are read of the texts that some pair is about, in one expression, which no filter repeats.
    a = incoming.select("ref", F.col("text").alias("own"))
    b = existing.select(F.col("ref").alias("existing_ref"), F.col("text").alias("theirs"))
    figures = F.array(F.struct(numbers(F.col("own")).alias("own"), numbers(F.col("theirs")).alias("theirs")))
    apart = F.transform(figures, lambda f: F.when(F.size(f["theirs"]) > 0, F.array_sort(F.array_except(f["own"], f["theirs"]))))
    out = pairs.join(a, "ref").join(b, "existing_ref").select("ref", "existing_ref", F.explode(F.filter(apart, lambda d: F.size(d) > 0)).alias("differing"), "shared")
    return out


def term_redefinition(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """ref, term, existing_ref and others: an incoming clause that defines a term in other words than ``others`` existing
    ones do, the first of which is named. White space doesn't count.

    Clauses of one wording are one row for the term before anything is joined, and of a term's wordings the two that come
    first are enough to name one that differs: a term that everybody defines makes no pairs."""
    flat = F.trim(F.regexp_replace("text", r"\s+", " "))
    said = lambda rows: rows.select("ref", flat.alias("said"), F.explode(defined(F.col("text"))).alias("term"))
    wordings = said(existing).groupBy("term", "said").agg(F.min("ref").alias("first"), F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy("term").orderBy("first", "said"))
    two = wordings.withColumn("place", place).where("place <= 2").groupBy("term").agg(F.array_sort(F.collect_list(F.struct("first", "said"))).alias("two"))
    totals = wordings.groupBy("term").agg(F.sum("n").alias("total")).join(two, "term")
    out = said(incoming).join(totals, "term").join(wordings.select("term", "said", "n"), ["term", "said"], "left")
    named = F.get(F.filter("two", lambda w: w["said"] != F.col("said")), F.lit(0))["first"]
    return out.select("ref", "term", named.alias("existing_ref"), (F.col("total") - F.coalesce("n", F.lit(0))).alias("others")).where("others > 0")


def duplicate_encoding(incoming: DataFrame, encoded: DataFrame) -> DataFrame:
    """ref and modules (sorted) of incoming clauses that a module encodes already; ``encoded``: ref and module."""
    modules = encoded.groupBy("ref").agg(F.array_sort(F.collect_set("module")).alias("modules"))
    return incoming.select("ref").join(modules, "ref")


def fingerprint(text: Column) -> Column:
    """The quantities of a text by kind, as sets."""
    squeezed = lambda p: F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(0)), lambda m: F.lower(F.replace(m, F.lit(" "), F.lit("")))))
    ratio = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(RATIO), F.lit(1)), lambda n: F.concat(F.lit("1:"), n)))
    deadline = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(DEADLINE), F.lit(0)), lambda m: F.replace(F.lower(m), F.lit("  "), F.lit(" "))))
    return F.struct(squeezed(r"\$\s?[\d,]+(?:\.\d+)?").alias("money"), squeezed(r"\d+(?:\.\d+)?\s?%").alias("percent"), ratio.alias("ratio"), deadline.alias("deadline"))


def dimensions_differ(a: Column, b: Column) -> Column:
    """The kinds in which two fingerprints are incompatible. Money and ratios have to be disjoint, as prose has incidental
    ones; percentages and deadlines are whole tables, in which any difference counts; and a percentage against an amount
    is a difference of unit."""
    some = lambda f, d: F.size(f[d]) > 0
    unit = (some(a, "percent") & some(b, "money") & ~some(a, "money")) | (some(b, "percent") & some(a, "money") & ~some(b, "money"))
    out = [F.when(unit, "unit-mismatch")]
    out += [F.when(some(a, d) & some(b, d) & ~F.arrays_overlap(a[d], b[d]), d) for d in ("money", "ratio")]
    out += [F.when(some(a, d) & some(b, d) & (F.array_sort(a[d]) != F.array_sort(b[d])), d) for d in ("percent", "deadline")]
    return F.array_compact(F.array(*out))
