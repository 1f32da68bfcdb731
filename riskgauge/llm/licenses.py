"""License scans by diagonal voting, in DataFrame operations only.

All rolling word bigrams of every text are hashed and joined to the places of the templates' bigrams (a fixed,
small table). Each match votes for its offset diagonal, text place minus template place. Votes are summed by
diagonal, and each diagonal takes the votes of those near it (words inserted or left out), so a span can't grow
beyond the notice and its drift. A span is verified by the share of all the notice's bigrams that it holds and by
the bigrams that tell the notice from others, all of which it must hold. Matched bigrams are compared as words too,
so a hash collision casts no vote.

Base labels come from exact phrases, whose spans must hold all bigrams on one diagonal.

Defined results: a null text is empty; an empty text has no words, no places and null first and last words;
repeated rows are scanned each on its own; rows with a null id are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import table

# Phrases of the base labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notice texts of public licences, and the labels that they get.
NOTICES = {
    "mit-notice": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
    "apache-notice": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license you may obtain a copy of the license at",
    "apache-line": "licensed under the apache license version 2 0",
    "gpl-notice": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "gpl-line": "this work is licensed under the gnu general public license version 3",
    "mit-line": "released under the mit license",
    "bsd-notice": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "mpl-notice": "this source code form is subject to the terms of the mozilla public license",
}

SEPARATOR = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# Bigrams without which a text is another licence, or none.
TELLING = {
    "mit-notice": ("associated documentation",), "apache-notice": ("apache license",), "apache-line": ("apache license",),
    "gpl-notice": ("gnu general",), "gpl-line": ("gnu general",), "mit-line": ("mit license",), "bsd-notice": ("redistribution and",),
    "cc-by-nc": ("by nc", "nc 4"), "mpl-notice": ("mozilla public",),
}

#: A diagonal takes the votes of those at most half the notice's bigrams away, within these bounds.
SLACK, MOST_SLACK = 3, 8
#: Least share of a notice's bigrams in a verified span.
LEAST_COVERAGE = 0.6


def word_array(text: Column) -> Column:
    """Lower-case words; separators are ASCII, so lowering other letters never changes what is a word."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), f"^{SEPARATOR}|{SEPARATOR}$", "")
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, SEPARATOR))


def templates(spark, phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """One row for each bigram of each template, and one for the marker that every text ends with."""
    rows = ["('', '', 0, 0, '', '', CAST(0 AS BIGINT))"]
    for kind, items in (("base", phrases.items()), ("own", ((v, k) for k, v in notices.items()))):
        for text, label in items:
            w = text.split()
            pairs = [(i, a, b) for i, (a, b) in enumerate(zip(w[:-1], w[1:], strict=True))]
            rows += [f"('{kind}', '{label}', {len(pairs)}, {i}, '{a}', '{b}', xxhash64('{a}', '{b}'))" for i, a, b in pairs]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(rows)} AS t(kind, label, bigrams, at, w1, w2, gram)")


def holds_telling(votes: Column, notices: dict[str, str]) -> Column:
    """Whether the votes hold each of the telling bigrams of the notice ``label``."""
    out = F.lit(True)
    for label, text in notices.items():
        w = text.split()
        for t in TELLING.get(label, ()):
            places = [i for i in range(len(w) - 1) if f"{w[i]} {w[i + 1]}" == t]
            out = out & ((F.col("label") != label) | F.arrays_overlap(votes, F.array(*map(F.lit, places))))
    return out


def license_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, notices: dict[str, str] = NOTICES) -> DataFrame:
    """(row, id, n_words, kind, label, start, end, coverage, verified): candidate spans, and one row of kind '' for every text."""
    own = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), word_array(F.col(text_col)).alias("w"))
    n = F.size("w")
    bigrams = F.when(n >= 2, F.zip_with(F.expr("slice(w, 1, size(w) - 1)"), F.expr("slice(w, 2, size(w))"), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))
    grams = own.select("row", "id", "w", F.concat(bigrams, F.array(F.lit(0).cast("bigint"))).alias("grams"))
    rolled = grams.select("row", "id", "w", F.posexplode("grams").alias("pos", "gram"))
    t = templates(docs.sparkSession, phrases, notices)
    marker = (F.col("kind") == "") & (F.col("pos") == F.size("w") - 1 + F.when(F.size("w") == 0, 1).otherwise(0))
    same = (F.col("kind") != "") & (F.col("w1") == F.try_element_at("w", F.col("pos") + 1)) & (F.col("w2") == F.try_element_at("w", F.col("pos") + 2))
    hits = rolled.join(F.broadcast(t), "gram").where(marker | same).select(
        "row", "id", F.when(F.col("kind") == "", F.size("w")).otherwise(0).alias("words"), "kind", "label", "bigrams", "at", (F.col("pos") - F.col("at")).alias("diagonal"))
    lines = hits.groupBy("row", "id", "kind", "label", "bigrams", "diagonal").agg(
        F.max("words").alias("words"), F.collect_set("at").alias("votes"), F.min("at").alias("first"), F.max("at").alias("last"))
    near = Window.partitionBy("row", "id", "kind", "label", "bigrams").orderBy("diagonal").rangeBetween(-MOST_SLACK, MOST_SLACK)
    slack = F.when(F.col("kind") == "own", F.greatest(F.lit(SLACK), F.least(F.lit(MOST_SLACK), F.floor(F.col("bigrams") / 2)))).otherwise(0)
    taken = lines.withColumn("near", F.collect_list(F.struct("diagonal", "votes", "first", "last")).over(near)).withColumn("slack", slack)
    taken = taken.withColumn("near", F.filter("near", lambda x: F.abs(x["diagonal"] - F.col("diagonal")) <= F.col("slack")))
    merged = taken.withColumn("held", F.array_distinct(F.flatten("near.votes"))).select(
        "row", "id", "kind", "label", "bigrams", "held", F.col("words").cast("long").alias("n_words"), F.size("held").alias("votes"),
        F.array_min(F.transform("near", lambda x: x["diagonal"] + x["first"])).alias("start"), F.array_max(F.transform("near", lambda x: x["diagonal"] + x["last"] + 2)).alias("end"))
    coverage = F.when(F.col("kind") == "", 0.0).otherwise(F.least(F.lit(1.0), F.try_divide(F.col("votes"), F.col("bigrams"))))
    good = F.when(F.col("kind") == "base", F.col("votes") == F.col("bigrams")).otherwise(
        (F.col("kind") == "own") & (coverage >= LEAST_COVERAGE) & holds_telling(F.col("held"), notices))
    return merged.select("row", "id", "n_words", "kind", "label", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), coverage.alias("coverage"), good.alias("verified"))


def license_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for every text: words, places of base phrases, labels and the best coverage."""
    s = license_spans(docs, id_col, text_col)
    base = (F.col("kind") == "base") & F.col("verified")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("label")))), ",")
    return s.groupBy("row", "id").agg(
        F.max("n_words").alias("n_words"), F.sum(base.cast("long")).alias("n_base"), F.min(F.when(base, F.col("start"))).alias("first_word"),
        F.max(F.when(base, F.col("start"))).alias("last_word"), names(base).alias("base_labels"), names(F.col("verified")).alias("labels"), F.max("coverage").alias("score"),
    ).select(F.col("id").alias("doc_id"), "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op3(spark, sf_dir: str) -> DataFrame:
    return license_report(table(spark, sf_dir, "documents"))
