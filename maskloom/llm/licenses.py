"""Licences: word k-grams vote for the diagonal on which a template lies. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from maskloom.llm.common import NON_WORD, words

K = 3
#: Diagonals and places this near, in words, belong to one span of a template.
NEAR = 8
#: Share of a template's k-grams that a span must have to count, and k-grams at least.
COVERAGE, LEAST_GRAMS = 0.5, 4

#: Phrases whose exact places are counted, and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
#: Well-known licence notices, found also where words were changed, added or left out.
TEMPLATES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the Software), to deal in the Software without restriction, including "
           "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
           "copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "apache-2": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
                "compliance with the License. You may obtain a copy of the License at",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
           "that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
           "hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
           "General Public License as published by the Free Software Foundation",
    "lgpl": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU "
            "Lesser General Public License as published by the Free Software Foundation",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
             "MPL was not distributed with this file, You can obtain one at",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "cc-by-sa": "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License",
    "cc-by-nc": "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License",
    "unlicense": "This is free and unencumbered software released into the public domain",
}


def grams(df: DataFrame, *keep: str) -> DataFrame:
    """A row for each k-gram of the array of words `a`, with its place, words and hash."""
    tail = lambda n: F.slice("a", n + 1, F.greatest(F.size("a") - n, F.lit(0)))
    shifted = df.withColumns({"b": tail(1), "c": tail(2)})
    return (shifted.select(*keep, F.posexplode(F.arrays_zip("a", "b", "c")).alias("pos", "g"))
            .where(F.col("g.c").isNotNull())
            .select(*keep, "pos", "g", F.xxhash64("g.a", "g.b", "g.c").alias("gram")))


def template_grams(spark: SparkSession) -> DataFrame:
    """The k-grams of all phrases and templates: a few hundred rows, by the tables above."""
    texts = [(label, text, True) for text, label in PHRASES.items()]
    texts += [(label, text, False) for label, text in TEMPLATES.items()]
    rows = F.array(*(F.struct(F.lit(n).alias("template"), F.lit(label).alias("label"), F.lit(exact).alias("exact"),
                              F.lit(text).alias("text")) for n, (label, text, exact) in enumerate(texts)))
    lists = spark.range(1).select(F.inline(rows)).withColumn("a", words(F.col("text"), NON_WORD))
    lists = lists.withColumn("n_grams", F.size("a") - (K - 1))
    found = grams(lists, "template", "label", "exact", "n_grams")
    return found.select("template", "label", "exact", "n_grams", F.col("pos").alias("t_pos"),
                        F.col("g").alias("t_g"), F.col("gram").alias("t_gram"))


def licence_spans(docs: DataFrame) -> DataFrame:
    """Where licences stand. docs: doc_id, key, text. A row per span, once for equal (doc_id, key).

    Every rolling k-gram meets the templates; hits are counted by diagonal (place in the
    text less place in the template), diagonals NEAR each other are merged up to a template's length, and a span
    stands if enough of the template's k-grams lie on it, all of a phrase's, and no sibling covers it better.
    """
    rolling = grams(docs.select("doc_id", "key", words(F.col("text"), NON_WORD).alias("a")), "doc_id", "key")
    hits = rolling.join(F.broadcast(template_grams(docs.sparkSession)),
                        (F.col("gram") == F.col("t_gram")) & (F.col("g") == F.col("t_g")))
    row = ["doc_id", "key", "template", "label", "exact", "n_grams"]
    # At most as many places as a template has; equal rows agree, so a set counts them once.
    diagonals = (hits.groupBy(*row, (F.col("pos") - F.col("t_pos")).alias("diagonal"))
                 .agg(F.collect_set("t_pos").alias("places")))
    along = Window.partitionBy(*row).orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(along) > F.when(F.col("exact"), 0).otherwise(NEAR)
    runs = (diagonals.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int"))
            .withColumn("run", F.sum("new").over(along)))
    # A span begins at each diagonal of a run and takes those up to a template's length on, which is how many words may
    # be put in. Of spans so near that the template can't have started again between them the best stands.
    longest = max(len(t.split()) for t in (*PHRASES, *TEMPLATES.values())) * 2
    of_run = Window.partitionBy(*row, "run").orderBy("diagonal")
    reach = F.when(F.col("exact"), 0).otherwise(F.col("n_grams"))
    on = F.filter(F.collect_list(F.struct("diagonal", "places")).over(of_run.rangeBetween(0, longest)),
                  lambda x: x["diagonal"] <= F.col("diagonal") + reach)
    spans = (runs.withColumn("on", on)
             .select(*row, "run", "diagonal",
                     F.size(F.array_distinct(F.flatten(F.col("on.places")))).alias("n"),
                     F.array_min(F.transform("on", lambda x: x["diagonal"] + F.array_min(x["places"]))).alias("start"),
                     (F.array_max(F.transform("on", lambda x: x["diagonal"] + F.array_max(x["places"]))) + K).alias("end"))
             .withColumn("coverage", F.col("n") / F.col("n_grams"))
             .where(F.when(F.col("exact"), F.col("coverage") == 1)
                    .otherwise((F.col("n") >= LEAST_GRAMS) & (F.col("coverage") >= COVERAGE))))
    rank = F.struct("coverage", (-F.col("diagonal")).alias("early"), "diagonal")
    around = F.filter(F.collect_list(rank).over(of_run.rangeBetween(-longest, longest)),
                      lambda x: F.abs(x["diagonal"] - F.col("diagonal")) <= reach)
    return best_siblings(spans.withColumn("around", around).where(F.array_max("around")["diagonal"] == F.col("diagonal")))


def best_siblings(spans: DataFrame) -> DataFrame:
    """Without spans of notices of which another licence's covers more, at half of their words or more.

    Notices of one family share most of their words. Phrases all stay.
    """
    doc = ["doc_id", "key", "exact"]
    along = Window.partitionBy(*doc).orderBy("start", "end", "template")
    before = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    together = Window.partitionBy(*doc, "island")

    def better(o: Column) -> Column:
        shared = F.least(F.col("end"), o["end"]) - F.greatest(F.col("start"), o["start"])
        more = (o["coverage"] > F.col("coverage")) | ((o["coverage"] == F.col("coverage")) & (o["n"] > F.col("n")))
        return (o["label"] != F.col("label")) & more & (2 * shared >= F.col("end") - F.col("start"))

    return (spans.withColumn("new", F.coalesce(F.col("start") >= before, F.lit(True)).cast("int"))
            .withColumn("island", F.sum("new").over(along))
            .withColumn("others", F.collect_list(F.struct("label", "start", "end", "coverage", "n")).over(together))
            .where(F.col("exact") | ~F.exists("others", better))
            .select("doc_id", "key", "label", "exact", "start", "end", "coverage"))


def report(docs: DataFrame) -> DataFrame:
    """Per document its licence phrases and notices.

    score is the greatest share of a phrase or template found, 0 if none. A null text is
    empty and has none; repeated rows are reported as often as they stand; a null doc_id
    stays null; an empty table gives no rows; other columns are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("key"), text.alias("text"))
    base = lambda column: F.when(F.col("exact"), F.col(column))
    found = (licence_spans(keyed).groupBy("doc_id", "key")
             .agg(F.count(base("start")).alias("n_base"), F.min(base("start")).alias("first_word"),
                  F.max(base("start")).alias("last_word"), F.collect_set(base("label")).alias("base_labels"),
                  F.collect_set("label").alias("labels"), F.max("coverage").alias("score")))
    lines = keyed.select("doc_id", "key", F.size(words(F.col("text"), NON_WORD)).cast("long").alias("n_words"))
    both = lines.alias("l").join(found.alias("f"), F.col("l.doc_id").eqNullSafe(F.col("f.doc_id"))
                                 & (F.col("l.key") == F.col("f.key")), "left")
    listed = lambda column: F.coalesce(F.array_join(F.array_sort(column), ","), F.lit(""))
    return both.select("l.doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
                       F.col("first_word").cast("long"), F.col("last_word").cast("long"),
                       listed("base_labels").alias("base_labels"), listed("labels").alias("labels"),
                       F.coalesce("score", F.lit(0.0)).alias("score"))
