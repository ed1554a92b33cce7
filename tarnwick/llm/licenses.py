"""License scans by diagonal voting, with DataFrame functions only.

Every run of k words of every text meets, in a join on its hash and its words, the places where templates hold the
same run. A meeting votes for the difference of the two places: the diagonal on which the template would lie in the
text. Votes are kept as the set of template places, so that copies of a row don't add to them. A diagonal with all of
a phrase's places is an exact occurrence. For longer templates, diagonals that lie close by (words were put in or left
out) become one candidate, which is verified by the share of the template's places that it holds and by its span; if the
span is too long, or the best of the diagonals holds as much by itself, that one is the candidate. Where passages that
are found overlap, those with the greatest share give their labels, all of them if their shares are equal.

Words are runs of characters that aren't ASCII signs or spaces, lower-cased in A-Z. Null and empty texts have no words
and score 0. Rows are kept as often as they occur; null ids stay null; further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.llm.common import partitions, text_of

K = 3
#: Phrases that give a label wherever their words follow each other.
PHRASES = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
#: Passages of public licenses that give a label where most of them is found.
PASSAGES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0"),
    ("apache-2", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
)
#: A character that no template has, for the one sign that lower() would turn into an ASCII letter.
KELVIN, OTHER = "K", "å"
BITS = 62


def template_rows(spark: SparkSession, phrases, passages) -> DataFrame:
    """A row for each place of each template: a number of rows that the templates bound."""
    rows = []
    for t, (label, text) in enumerate([*phrases, *passages]):
        words = text.split()
        if not all(re.fullmatch("[0-9a-z]+", w) for w in words) or len(words) < K:
            raise ValueError(f"a template needs {K} plain lower-case words: {text!r}")
        places = len(words) - K + 1
        rows += [f"({t}, '{label}', {str(t < len(phrases)).lower()}, {places}, {i}, " + ", ".join(f"'{w}'" for w in words[i : i + K]) + ")" for i in range(places)]
    names = ["t", "label", "phrase", "places", "place", *(f"t{i}" for i in range(K))]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS v({', '.join(names)})").withColumn("gram", F.xxhash64(*(f"t{i}" for i in range(K))))


def words_of(text: Column) -> Column:
    """The words, with an empty string before (after) them if a separator begins (ends) the text."""
    lowered = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(KELVIN), F.lit(OTHER)))
    return F.split(lowered, r"[\x00-\x2f\x3a-\x60\x7b-\x7f]+", -1)


def scan(docs: DataFrame, phrases=PHRASES, passages=PASSAGES, slack: int = 8, share: float = 0.7, stretch: float = 1.5) -> DataFrame:
    """doc_id, n_words, n_base, first_word and last_word (of the phrases' places), base_labels, labels and score.

    ``slack``: words by which neighbouring diagonals may differ; ``share``: of a passage's places that must be found;
    ``stretch``: how much longer than the passage the span of several diagonals may be.
    """
    templates = template_rows(docs.sparkSession, phrases, passages)
    longest = max(len(t.split()) for _, t in (*phrases, *passages))
    segments = range(-(-longest // BITS))
    rows = text_of(docs).select("doc_id", F.xxhash64("text").alias("h"), words_of(F.col("text")).alias("words"))
    before = (F.get("words", F.lit(0)) == "").cast("int")
    after = ((F.size("words") > 1) & (F.get("words", F.size("words") - 1) == "")).cast("int")
    rows = rows.select("doc_id", "h", "words", before.alias("before"), (F.size("words") - before - after).alias("n_words"))
    # One element more in front: a row for each document, which meets nothing.
    at = rows.select("doc_id", "h", "words", "before", "n_words", F.posexplode(F.concat(F.array(F.lit("")), "words")).alias("i", "_"))
    at = at.select("doc_id", "h", "n_words", (F.col("i") - 1).alias("i"), "before", *(F.get("words", F.col("i") - 1 + F.lit(k)).alias(f"w{k}") for k in range(K)))
    at = at.withColumn("gram", F.xxhash64(*(f"w{k}" for k in range(K))))
    same = [F.col("gram") == F.col("_gram"), *(F.col(f"w{k}") == F.col(f"t{k}") for k in range(K))]
    met = at.join(F.broadcast(templates.withColumnRenamed("gram", "_gram")), same, "left").where("i = -1 or t is not null")
    met = met.select("doc_id", "h", "n_words", "t", "label", "phrase", "places", "place", (F.col("i") - F.col("before")).alias("word"))
    own = ["doc_id", "h"]
    met = met.repartition(partitions(docs.sparkSession), *own)  # all that follows stays in these partitions
    bit = lambda k: F.when(F.floor(F.col("place") / BITS) == k, F.expr(f"shiftleft(1L, cast(place % {BITS} as int))")).otherwise(F.lit(0).cast("long"))
    votes = met.withColumn("diagonal", F.col("word") - F.col("place")).groupBy(*own, "t", "label", "phrase", "places", "diagonal").agg(
        F.count("*").alias("n"), F.max("n_words").alias("n_words"), F.min("word").alias("low"), F.max("word").alias("high"), *(F.bit_or(bit(k)).alias(f"b{k}") for k in segments)
    )
    held = sum((F.bit_count(f"b{k}") for k in segments), F.lit(0))
    by_template = Window.partitionBy(*own, "t").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by_template) > slack, F.lit(True))
    votes = votes.withColumn("new", new.cast("int"))
    votes = votes.withColumn("cluster", F.when(F.col("phrase"), F.col("diagonal")).otherwise(F.sum("new").over(by_template)))
    spans = votes.groupBy(*own, "t", "label", "phrase", "places", "cluster").agg(
        F.max("n").alias("n"), F.max("n_words").alias("n_words"), F.min("low").alias("low"), F.max("high").alias("high"), *(F.bit_or(f"b{k}").alias(f"b{k}") for k in segments),
        F.max(F.struct(held.alias("held"), (-F.col("low")).alias("low"), "high")).alias("best"),
    )
    exact = F.col("phrase") & (held == F.col("places"))
    # A candidate is its whole cluster, if that is short enough and holds more than the best of its diagonals, or that one.
    fits = (F.col("high") - F.col("low") + 1 <= stretch * F.col("places")) & (held > F.col("best.held"))
    part = F.when(fits, held).otherwise(F.col("best.held")) / F.col("places")
    first, last = F.when(fits, F.col("low")).otherwise(-F.col("best.low")), F.when(fits, F.col("high")).otherwise(F.col("best.high"))
    spans = spans.select(*own, "t", "label", "cluster", "n", "n_words", exact.alias("exact"), part.alias("part"), (~F.col("phrase") & (part >= share)).alias("passage"), first.alias("first"), last.alias("last"))
    # Of passages that overlap, those of the greatest share are meant: sister licenses have most of their words in common.
    reach = int(stretch * longest) + 1
    near = Window.partitionBy(*own).orderBy("first").rangeBetween(-reach, reach)
    others = F.collect_list(F.when(F.col("passage"), F.struct("part", "first", "last"))).over(near)
    spans = spans.withColumn("others", F.when(F.col("passage"), others))
    beaten = F.exists("others", lambda o: (o["part"] > F.col("part")) & (o["first"] <= F.col("last")) & (o["last"] >= F.col("first")))
    exact, part = F.col("exact"), F.col("part")
    found = exact | F.col("passage") & ~beaten
    one = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    out = spans.groupBy(*own).agg(
        F.max(F.when(F.col("t").isNull(), F.col("n"))).alias("copies"),
        F.max("n_words").cast("long").alias("n_words"),
        F.count(F.when(exact, 1)).alias("n_base"),
        F.min(F.when(exact, F.col("cluster"))).cast("long").alias("first_word"),
        F.max(F.when(exact, F.col("cluster"))).cast("long").alias("last_word"),
        one(exact).alias("base_labels"),
        one(found).alias("labels"),
        F.coalesce(F.max(part.cast("double")), F.lit(0.0)).alias("score"),
    )
    return out.withColumn("_", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).drop("_", "copies", "h")
