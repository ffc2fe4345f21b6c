"""License scan by diagonal voting of word k-grams; Column expressions, joins and windows only."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelode.llm.common import PLAIN_WORD, ascii_lower, stored

K = 3
#: More k-grams than this are no list of literals any more.
MAX_GRAMS = 100_000
#: Diagonals so near each other are one alignment, with words put in or left out between.
NEIGHBOURS = 3
#: Share of a template's k-grams that an alignment must have.
COVERAGE = 0.6

#: Phrases that count as they stand, by label.
PHRASES = [
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
]
#: Notices of common licenses, by label.
NOTICES = [
    ("mit", "Released under the MIT License."),
    (
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        "software and associated documentation files (the \"Software\"), to deal in the Software "
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software",
    ),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    (
        "apache-2",
        "you may not use this file except in compliance with the License. You may obtain a copy "
        "of the License at",
    ),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    (
        "cc-by-nc",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License",
    ),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    (
        "gpl-3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License",
    ),
    (
        "bsd-3",
        "Redistribution and use in source and binary forms, with or without modification, are "
        "permitted provided that the following conditions are met",
    ),
    (
        "mpl-2",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
]


def template_words(text: str) -> list[str]:
    lowered = "".join(c.lower() if c.isascii() else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def template_grams(
    phrases: list[tuple[str, str]], notices: list[tuple[str, str]]
) -> list[tuple[int, str, bool, int, int, str]]:
    """`(template, label, exact, grams, pos, gram)` for each k-gram of each template."""
    rows = []
    for number, (label, text, exact) in enumerate(
        [(*p, True) for p in phrases] + [(*n, False) for n in notices]
    ):
        words = template_words(text)
        if len(words) < K:
            raise ValueError(f"a template needs {K} words or more: {text}")
        grams = [" ".join(words[i : i + K]) for i in range(len(words) - K + 1)]
        rows += [(number, label, exact, len(grams), pos, gram) for pos, gram in enumerate(grams)]
    if len(rows) > MAX_GRAMS:
        raise ValueError(f"over {MAX_GRAMS} template k-grams")
    return rows


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(PLAIN_WORD), 0)


def scan_licenses(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    phrases: list[tuple[str, str]] | None = None,
    notices: list[tuple[str, str]] | None = None,
    coverage: float = COVERAGE,
) -> DataFrame:
    """One row per document: `(id, n_words, n_base, first_word, last_word, base_labels, labels,
    spans, score)`.

    The hashes of all word k-grams of a text are joined to the positions of the templates that
    have them, and each match votes for the diagonal, position in the text less position in
    the template. A phrase stands where all its k-grams vote for one diagonal; these are the
    base places, of which first_word and last_word are the outermost starts. For a notice,
    diagonals at most NEIGHBOURS apart are one alignment, so words put in or left out don't
    break it; it counts if its k-grams, compared as words and not as hashes, stand for `coverage`
    of the notice's positions, each counted once however often it is repeated, and its span is
    not longer than the notice by half. `spans` has
    `(label, start, end, coverage)` in words, end exclusive; score is the best coverage,
    1 for a phrase and 0 for nothing.

    k-grams that no template has are dropped in the row in which they arise, so a text is read
    once and leaves its matches only. Each row of `docs` is scanned for itself, repeated or
    not; null, empty and wordless texts have no words. An empty table gives no rows. Columns
    of other names are ignored.
    """
    grams = template_grams(PHRASES if phrases is None else phrases, NOTICES if notices is None else notices)
    templates = docs.sparkSession.createDataFrame(
        grams, "template int, label string, exact boolean, grams int, pos int, gram string"
    ).withColumn("hash", F.xxhash64("gram"))
    hashes = [row["hash"] for row in templates.select("hash").distinct().collect()]
    words = F.col("words")

    def gram_at(word: Column, at: Column) -> Column:
        gram = F.concat_ws(" ", word, *(F.get(words, at + i) for i in range(1, K)))
        return F.struct(at.alias("at"), F.xxhash64(gram).alias("hash"), gram.alias("gram"))

    hits = F.filter(F.transform(words, gram_at), lambda g: g["hash"].isin(hashes))
    rows = stored(
        docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words")).select(
            F.monotonically_increasing_id().alias("row"),
            "id",
            F.size("words").cast("long").alias("n_words"),
            hits.alias("hits"),
        ),
        "grams",
    )
    votes = (
        rows.where(F.size("hits") > 0)
        .select("row", F.inline("hits"))
        .withColumnRenamed("gram", "words")
        .join(F.broadcast(templates), "hash")
        .where("words = gram")
        .groupBy("row", "template", "label", "exact", "grams", (F.col("at") - F.col("pos")).alias("diagonal"))
        .agg(
            F.count("*").alias("votes"),
            F.min("at").alias("start"),
            (F.max("at") + K).alias("end"),
            F.collect_set("pos").alias("positions"),  # each once on a diagonal, so as many as votes
        )
    )
    phrase = votes.where("exact and votes = grams").select(
        "row", "label", F.col("diagonal").alias("start"), "end", F.lit(1.0).alias("coverage"), "exact"
    )
    by_diagonal = Window.partitionBy("row", "template").orderBy("diagonal")
    gap = F.col("diagonal") - F.lag("diagonal").over(by_diagonal)
    aligned = (
        votes.where("not exact")
        .withColumn("opens", F.when(gap <= NEIGHBOURS, 0).otherwise(1))
        .withColumn("alignment", F.sum("opens").over(by_diagonal))
        .withColumn("pos", F.explode("positions"))
        .groupBy("row", "template", "label", "grams", "alignment")
        .agg(
            F.count_distinct("pos").alias("covered"),
            F.min("start").alias("start"),
            F.max("end").alias("end"),
        )
        .withColumn("coverage", F.col("covered") / F.col("grams"))
        .where((F.col("coverage") >= coverage) & (F.expr(f"2 * (end - start) <= 3 * (grams + {K - 1})")))
        .select("row", "label", "start", "end", "coverage", F.lit(False).alias("exact"))
    )
    base = F.when(F.col("exact"), F.col("start").cast("long"))
    span = F.struct("label", "start", "end", "coverage")
    found = phrase.unionByName(aligned).groupBy("row").agg(
        F.count(base).alias("n_base"),
        F.min(base).alias("first_word"),
        F.max(base).alias("last_word"),
        F.array_join(F.sort_array(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.sort_array(F.collect_set("label")), ",").alias("labels"),
        F.array_sort(F.collect_list(span)).alias("spans"),
        F.max("coverage").alias("score"),
    )
    none = F.array().cast("array<struct<label:string,start:int,end:int,coverage:double>>")
    return rows.drop("hits").join(found, "row", "left").select(
        "id",
        "n_words",
        F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("spans", none).alias("spans"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
