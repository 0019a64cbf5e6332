"""Licence statements in whole texts, by votes of word k-grams for template positions.

Each text becomes words ([0-9a-z] and everything beyond ASCII, A-Z lower-cased). The hashes of all its word 3-grams
are joined to the positions they have in the templates (a small, bounded table; the words are compared too, so a hash
never decides). A hit votes for a diagonal: the word at which the template would start. Hits are counted per diagonal;
neighbouring diagonals of one template merge (words inserted or left out between them), and a merged span counts if
its distinct template positions cover enough of the template within a span of its length. Spans are verified: words that
decide which licence it is (a version, or that nothing stands between "attribution" and its version) must be matched
as they stand, whatever the rest covers.

Phrases are templates that must match whole, on one diagonal: their places are exact.

Null or empty texts have no words. Each row is a document, also if it repeats or its doc_id is null or repeats. Other
columns are ignored. No rows give no rows.
"""

from __future__ import annotations

import re
import string
from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stratalake.llm.tables import stored

K = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Statements by which licences are known.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation
        the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software""",
    "apache-2": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in
        compliance with the License. You may obtain a copy of the License at""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that
        the following conditions are met: Redistributions of source code must retain the above copyright notice""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General
        Public License as published by the Free Software Foundation""",
    "gpl-3": "licensed under the GNU General Public License, version 3",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies""",
    "cc-by": "licensed under a Creative Commons Attribution 4.0 International License",
    "mpl-2": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}

#: Words of templates that tell the licence from its relatives: every k-gram that holds them must be found.
DECISIVE = {"apache-2": "version 2", "gpl-3": "version 3", "cc-by": "attribution 4", "mpl-2": "v 2"}


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


def template_rows(phrases: Mapping[str, str], templates: Mapping[str, str], decisive: Mapping[str, str]) -> list[tuple]:
    """(template, label, is a phrase, its words, its grams, decisive grams, position, gram, is decisive) for each k-gram."""
    rows = []
    items = [(t, label, True) for t, label in phrases.items()] + [(t, label, False) for label, t in templates.items()]
    for number, (text, label, phrase) in enumerate(items):
        words = words_of(text)
        if len(words) < K:
            raise ValueError(f"a template needs {K} words: {text!r}")
        count = len(words) - K + 1
        decides = [] if phrase else words_of(decisive.get(label, ""))
        starts = [i for i in range(len(words)) if decides and words[i : i + len(decides)] == decides]
        if decides and (not starts or len(decides) > K):
            raise ValueError(f"{label}: {decisive[label]!r} is not in the template, or has more than {K} words")
        must = {i for s in starts for i in range(max(0, s + len(decides) - K), min(s, count - 1) + 1)}
        rows += [(number, label, phrase, len(words), count, len(must), i, words[i : i + K], i in must) for i in range(count)]
    return rows


TEMPLATE = "template int, label string, phrase boolean, length int, grams int, musts int, at int, gram array<string>, must boolean"


def scan(
    docs: DataFrame,
    phrases: Mapping[str, str] = PHRASES,
    templates: Mapping[str, str] = TEMPLATES,
    least: float = 0.75,
    slack: int = 3,
    decisive: Mapping[str, str] = DECISIVE,
) -> tuple[DataFrame, DataFrame]:
    """A summary per document, and the spans found.

    Summary: row, doc_id, n_words. Spans: row, doc_id, label, phrase, start (first word), stop (one past the last),
    coverage. Neighbouring diagonals at most `slack` words apart merge; a template's span needs `least` of its grams,
    and all that hold its decisive words.
    """
    spark: SparkSession = docs.sparkSession
    table = spark.createDataFrame(template_rows(phrases, templates, decisive), TEMPLATE)
    table = table.withColumn("hash", F.xxhash64(*[F.get("gram", F.lit(j)) for j in range(K)]))

    lower = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    texts = docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.regexp_extract_all(lower, F.lit(WORD), F.lit(0)).alias("words")
    )
    hashed = F.transform("words", lambda w, i: F.xxhash64(w, *[F.get("words", i + j) for j in range(1, K)]))
    # The first entry has no hash: it carries the document itself through the join.
    grams = texts.select("row", "doc_id", "words", F.concat(F.array(F.lit(None).cast("long")), hashed).alias("grams"))
    placed = grams.select("row", "doc_id", "words", F.posexplode("grams").alias("pos", "hash"))
    joined = placed.join(F.broadcast(table.withColumnRenamed("hash", "h")), F.col("hash") == F.col("h"), "left")
    same = F.col("template").isNotNull() & (F.slice("words", F.col("pos"), F.lit(K)) == F.col("gram"))
    joined = joined.filter((F.col("pos") == 0) | same)
    voted = joined.select(
        "row", "doc_id", F.when(F.col("pos") == 0, F.size("words")).cast("long").alias("n_words"), "template", "label", "phrase",
        "length", "grams", "musts", "at", "must", (F.col("pos") - 1 - F.col("at")).cast("long").alias("diagonal"),
    )
    keys = ["row", "doc_id", "template", "label", "phrase", "length", "grams", "musts", "diagonal"]
    votes = voted.groupBy(*keys).agg(
        F.max("n_words").alias("n_words"), F.collect_set("at").alias("hit"), F.collect_set(F.when(F.col("must"), F.col("at"))).alias("decided"), F.min("at").alias("low"), F.max("at").alias("high")
    )
    votes = stored(votes, "votes")
    return votes.filter("template is null").select("row", "doc_id", "n_words"), _merged(votes.filter("template is not null"), least, slack)


def _merged(votes: DataFrame, least: float, slack: int) -> DataFrame:
    """Spans of neighbouring diagonals that cover enough of their template."""
    order = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(order)
    # Phrases stand on one diagonal; a template may bend.
    runs = votes.withColumn("new", (F.col("phrase") | gap.isNull() | (gap > slack)).cast("int"))
    runs = runs.withColumn("run", F.sum("new").over(order))
    spans = runs.groupBy("row", "doc_id", "template", "label", "phrase", "length", "grams", "musts", "run").agg(
        F.size(F.array_distinct(F.flatten(F.collect_list("hit")))).alias("covered"),
        F.size(F.array_distinct(F.flatten(F.collect_list("decided")))).alias("decided"),
        F.min(F.col("diagonal") + F.col("low")).alias("start"),
        (F.max(F.col("diagonal") + F.col("high")) + K).alias("stop"),
    )
    spans = spans.withColumn("coverage", F.col("covered") / F.col("grams"))
    fits = F.col("stop") - F.col("start") <= F.col("length") + slack * 4
    whole = (F.col("coverage") >= least) & (F.col("decided") == F.col("musts")) & fits
    spans = spans.filter(F.when(F.col("phrase"), F.col("covered") == F.col("grams")).otherwise(whole))
    return spans.select("row", "doc_id", "label", "phrase", "start", "stop", "coverage")


def report(summary: DataFrame, spans: DataFrame) -> DataFrame:
    """One row per document: places of phrases (n_base, first_word, last_word), labels, and the best coverage."""
    start = F.when(F.col("phrase"), F.col("start"))
    names = lambda column: F.array_join(F.array_sort(F.collect_set(column)), ",")
    found = spans.groupBy("row").agg(
        F.count(start).alias("n_base"), F.min(start).alias("first_word"), F.max(start).alias("last_word"),
        names(F.when(F.col("phrase"), F.col("label"))).alias("base_labels"), names("label").alias("labels"),
        F.max("coverage").alias("score"),
    )
    return summary.join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
