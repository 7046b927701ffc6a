"""License scans: phrases, and an exact set-similarity join of text blocks with license templates.

A block is a line of a text, as a set of words. A template matches a block that holds at least THRESHOLD of the
template's distinct words. Template words are ordered by their document frequency in the whole corpus, rare ones first.
Of a template with n words, ceil(THRESHOLD * n) of which must be found, only the first n - ceil(THRESHOLD * n) + 1 are
indexed (prefix filter); blocks with too few template words are left out (length filter), and so are pairs whose first
common word stands too far back in either list (positional filter). What remains is verified by intersecting the sets.

Notices wrapped over lines are found in windows of the text's words, as long as the template over THRESHOLD, around each word of
a template's indexed prefix: a window must hold THRESHOLD of the distinct words as a block must, and, as it isn't a line by itself,
that share of the template's words in the template's order (longest common subsequence).

The corpus is split into words once: that pass writes a row a document with its phrases, the template words that it has, and its text where
these words reach THRESHOLD of any template. Frequencies and matches come from that table. Everything on the executors is DataFrame
functions. The templates are constants, and only their words' frequencies come to the driver.

Defined results: a null or empty text has no words, no labels and score 0; labels of phrases and templates are united;
equal lines count once; repeated rows are answered alike; an empty table gives no rows; other columns aren't looked at.
"""

from __future__ import annotations

from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, table

THRESHOLD = 0.9
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Notices by which works are put under well-known licenses, and the labels they stand for.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("all-rights-reserved", "All rights reserved"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("boost", "Distributed under the Boost Software License, Version 1.0"),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide"),
    ("artistic", "This is free software; you can redistribute it and/or modify it under the terms of the Artistic License 2.0"),
    ("wtfpl", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document"),
]


def template_words(text: str) -> list[str]:
    import re

    return sorted(set(re.findall("[0-9a-z]+", text.lower())))


def words_of(text: Column) -> Column:
    """Words of a text with A-Z in lower case. lower() changes other letters too, but no boundary; the one sign that it would make a-z is replaced before."""
    low = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("ĸ")))
    return F.array_remove(F.split(low, NOT_WORD), "")


def _array(words) -> Column:
    return F.array(*(F.lit(w) for w in words)) if words else F.array().cast("array<string>")


def _places(phrase: str) -> Column:
    """Starts of a phrase among the column `words`."""
    parts = phrase.split()
    match = " AND ".join(f"get(words, i + {k}) = '{p}'" for k, p in enumerate(parts))
    return F.expr(f"if(array_contains(words, '{parts[0]}'), filter(sequence(0, size(words) - 1), i -> {match}), cast(array() as array<int>))")


def _phrase_columns(found: DataFrame) -> DataFrame:
    """Add n_words, n_base, first_word, last_word and base (array of labels) to rows with the column words."""
    names = {f"_p{k}": phrase for k, phrase in enumerate(PHRASES)}
    found = found.withColumns({c: _places(p) for c, p in names.items()}).withColumn("n_words", F.size("words").cast("long"))
    every = F.concat(*names)
    labels = F.array_compact(F.array(*(F.when(F.size(c) > 0, F.lit(PHRASES[p])) for c, p in names.items())))
    return found.withColumns(
        {
            "n_base": F.size(every).cast("long"),
            "first_word": F.array_min(every).cast("long"),
            "last_word": F.array_max(every).cast("long"),
            "base": F.array_sort(F.array_distinct(labels)),
        }
    ).drop(*names)


def survey(keyed: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """The one pass over the words of the column _text: what _phrase_columns() adds, has (the template words there are), and _text only where a template may match."""
    sets = [template_words(t) for _, t in templates]
    rows = _phrase_columns(keyed.withColumn("words", words_of(F.col("_text"))))
    rows = rows.withColumn("has", F.array_intersect("words", _array(sorted({w for s in sets for w in s})))).drop("words")
    enough = F.lit(False)
    for s in sets:
        enough = enough | (F.size(F.array_intersect("has", _array(s))) >= ceil(threshold * len(s) - 1e-9))
    return rows.withColumn("_text", F.when(enough, F.col("_text")))


def frequencies(surveyed: DataFrame) -> dict[str, int]:
    """Documents that have each of the template words; no more numbers than these come to the driver."""
    return {r["w"]: r["count"] for r in surveyed.select(F.explode("has").alias("w")).groupBy("w").count().collect()}


def template_matches(surveyed: DataFrame, key: list[str], templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(key columns, label, containment): every template that a line of the text, or a window of its words, holds."""
    spark = surveyed.sparkSession
    sets = [(label, template_words(t)) for label, t in templates]
    known = sorted({w for _, s in sets for w in s})
    count = frequencies(surveyed)
    known.sort(key=lambda w: (count.get(w, 0), w))
    rank = {w: k for k, w in enumerate(known)}
    index = []
    for number, (label, s) in enumerate(sets):
        need = ceil(threshold * len(s) - 1e-9)
        ordered = sorted(s, key=rank.__getitem__)
        index += [(number, label, ordered, need, w, place) for place, w in enumerate(ordered[: len(s) - need + 1])]
    prefixes = spark.createDataFrame(index, "number int, label string, template array<string>, need int, w string, place int")
    first = _array(sorted({row[4] for row in index}))
    least = min(row[3] for row in index)

    holding = surveyed.where("_text is not null").select(*key, "_text").where(F.arrays_overlap("has", first))
    lines = holding.select(*key, F.explode(F.array_distinct(F.split("_text", "\n"))).alias("line"))
    ordered = lines.select(*key, F.array_intersect(_array(known), words_of(F.col("line"))).alias("block"))  # in the order of `known`
    ordered = ordered.where((F.size("block") >= least) & F.arrays_overlap("block", first))
    tokens = ordered.select(*key, "block", F.posexplode("block").alias("at", "w"))
    pairs = tokens.join(F.broadcast(prefixes), "w").where(F.size("block") >= F.col("need"))
    reach = F.least(F.size("template") - F.col("place"), F.size("block") - F.col("at"))
    pairs = pairs.where(reach >= F.col("need"))
    overlap = F.size(F.array_intersect("template", "block"))
    pairs = pairs.where(overlap >= F.col("need"))
    found = pairs.select(*key, "label", (overlap / F.size("template")).alias("containment"))
    return found.union(_wrapped(holding, key, prefixes, first, templates, threshold)).distinct()


def _wrapped(holding: DataFrame, key: list[str], prefixes: DataFrame, first: Column, templates, threshold: float) -> DataFrame:
    """(key columns, label, containment) of templates in windows of words that may go over line ends."""
    import re

    order = [(number, words := re.findall("[0-9a-z]+", t.lower()), ceil(threshold * len(words) - 1e-9), ceil(len(words) / threshold)) for number, (_, t) in enumerate(templates)]
    reach = max(row[3] for row in order)
    order = holding.sparkSession.createDataFrame(order, "number int, ordered array<string>, need_ordered int, width int")
    words = holding.where(F.col("_text").contains("\n")).select(*key, words_of(F.col("_text")).alias("words")).withColumn("_first", first)
    # A place is written as one string, its word, the number of words kept before it, and the words around it: equal strings are found
    # by hashing, where equal structs or arrays would be compared pair by pair.
    near = f"""transform(filter(sequence(0, size(words) - 1), i -> array_contains(_first, words[i])),
        i -> concat_ws(' ', words[i], least(i, {reach} - 1), array_join(slice(words, greatest(i - {reach} + 2, 1), i + {reach} - greatest(i - {reach} + 1, 0)), ' ')))"""
    near = words.select(*key, F.explode(F.array_distinct(F.expr(near))).alias("_at")).select(*key, F.split("_at", " ").alias("_at"))
    near = near.select(*key, F.col("_at")[0].alias("w"), F.col("_at")[1].cast("int").alias("before"), F.expr("slice(_at, 3, size(_at) - 2)").alias("near"))
    pairs = near.join(F.broadcast(prefixes), "w").join(F.broadcast(order), "number")
    # Of what is around, a template's windows reach no farther than its own width.
    own = "slice(near, greatest(before - width + 2, 1), before + width - greatest(before - width + 1, 0))"
    pairs = pairs.withColumn("near", F.expr(own)).drop("before")
    pairs = pairs.where(F.size(F.array_intersect("template", "near")) >= F.col("need"))
    pairs = pairs.withColumn("window", F.explode(F.expr("transform(sequence(1, greatest(1, size(near) - width + 1)), s -> slice(near, s, width))")))
    pairs = pairs.withColumn("overlap", F.size(F.array_intersect("template", "window"))).where("overlap >= need")
    # A row of the table of longest common subsequences for each word of the window.
    longest = """aggregate(window, array_repeat(0, size(ordered) + 1), (row, x) -> aggregate(sequence(1, size(ordered)), array(0),
        (now, j) -> concat(now, array(greatest(now[j - 1], row[j], if(ordered[j - 1] = x, row[j - 1] + 1, 0))))), row -> row[size(ordered)])"""
    pairs = pairs.where(F.expr(longest) >= F.col("need_ordered"))
    return pairs.select(*key, "label", (F.col("overlap") / F.size("template")).alias("containment"))


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base, labels, score), base and labels as sorted arrays."""
    keyed = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_k1"), F.hash(text).alias("_k2"), F.col(text).alias("_text"))
    key = ["_id", "_k1", "_k2"]
    surveyed = materialize(survey(keyed, templates, threshold), "license-survey")
    found = template_matches(surveyed, key, templates, threshold)
    found = found.groupBy(*(F.col(k).alias(f"m{k}") for k in key)).agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    base = surveyed.drop("_text", "has")
    same = (F.col("_k1") == F.col("m_k1")) & (F.col("_k2") == F.col("m_k2")) & F.col("_id").eqNullSafe(F.col("m_id"))
    none = F.array().cast("array<string>")
    joined = base.join(found, same, "left")
    return joined.select(
        F.col("_id").alias(doc_id),
        *("n_words", "n_base", "first_word", "last_word", "base"),
        F.array_sort(F.array_union("base", F.coalesce("more", none))).alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0)).alias("score"),
    )


def query(spark, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    return found.select(
        *("doc_id", "n_words", "n_base", "first_word", "last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join("labels", ",").alias("labels"),
        "score",
    )


def _sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    places = []
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        match = " AND ".join(f"w[i + {k + 1}] = '{p}'" for k, p in enumerate(parts))
        places.append(f"SELECT doc_id, i, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM words WHERE list_contains(w, '{parts[0]}')) WHERE {match}")
    values = ", ".join(f"('{label}', [{', '.join(repr(w) for w in template_words(t))}])" for label, t in TEMPLATES)
    return f"""WITH words AS (
  SELECT doc_id, text, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '{word}') AS w FROM documents),
places AS ({" UNION ALL ".join(places)}),
lines AS (
  SELECT doc_id, list_distinct(regexp_extract_all(translate(line, '{upper}', '{lower}'), '{word}')) AS b
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents)),
templates(label, t) AS (VALUES {values}),
matches AS (
  SELECT doc_id, label, len(list_intersect(t, b))::DOUBLE / len(t) AS c FROM lines JOIN templates
  ON len(list_intersect(t, b)) >= ceil({THRESHOLD} * len(t) - 1e-9)),
base AS (
  SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels
  FROM places GROUP BY doc_id),
every AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(c) AS score
  FROM (SELECT doc_id, label, 1e0 AS c FROM places UNION ALL SELECT doc_id, label, c FROM matches) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word,
  CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0e0) AS score
FROM words LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id)"""


ORACLE_SQL = _sql()
