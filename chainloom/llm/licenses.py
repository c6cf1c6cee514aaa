"""License scans (operator 6): exact set-similarity join of text blocks with license templates.

Base: fixed phrases, by consecutive words. Method: a block meets a template when it holds at least
`threshold` of the template's distinct words. Blocks are the lines and, as notices are wrapped, in each
paragraph (lines up to one without a word) every run of length / `threshold` words, length being that of
the template with its repeated words. All such pairs are found exactly: template words
are ordered by how many documents hold them, rarest first; a block that meets a template of t words
must hold ceil(threshold * t) of them, hence at least one of its first t - ceil(threshold * t) + 1
(prefix), must have that many distinct words itself (length), and, where its first shared word stands
at place i of the template, t - i + 1 must reach the needed number (position). Candidates come from
one join on prefix words of lines and paragraphs; a pair is looked at only at its first shared word, so no
pair comes twice, and is then confirmed on whole sets, or for a paragraph that holds enough on its runs,
of which those that begin with a template word are enough. The SQL forms lines only: it has equal results
where no notice is wrapped. DataFrame functions only; the templates are a parameter and must
have no more than MAX_TEMPLATE_WORDS words in all, which bounds what is broadcast and collected.

Defined results: a null or empty text has no words, no labels and score 0; the score is the largest
containment among the pairs that meet the threshold; repeated rows and rows with equal or null ids
each get their own text's result (matches are keyed by id and a digest of the text); an empty table
gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import string_column, table, written

# The phrases of the base rule with their labels.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)
# Sentences by which well-known licenses are named or granted, with their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("gpl-2", "licensed under the GNU General Public License, version 2"),
    ("gpl-3", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc0", "dedicated to the public domain under the Creative Commons Zero waiver"),
)
THRESHOLD = 0.9
MAX_TEMPLATE_WORDS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def _lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def _words(text: Column) -> Column:
    return F.regexp_extract_all(_lower(text), F.lit(f"({WORD}+)"), F.lit(1))


def _split(text: str) -> list[str]:
    return re.findall(f"{WORD}+", text.translate(str.maketrans(UPPER, LOWER)))


def _loose(text: Column) -> Column:
    """Words by the session's lower(): holds every plain a-z word that _words() holds."""
    return F.split(F.lower(text), f"{GAP}+")


def _any_phrase(text: Column) -> Column:
    """Whether a phrase stands in the text; (?i) folds A-Z only."""
    parts = "|".join(f"{GAP}+".join(map(re.escape, p.split())) for p, _ in PHRASES)
    return text.rlike(f"(?i)(?<!{WORD})(?:{parts})(?!{WORD})")


def places(words: Column, phrase: str) -> Column:
    """Starts (words from 0) at which the phrase's words stand consecutively in an array of words."""
    parts = phrase.split()
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - len(parts), F.lit(0)))
    hit = lambda i: F.reduce(
        F.array(*[F.try_element_at(words, i + k + 1) == F.lit(p) for k, p in enumerate(parts)]),
        F.lit(True),
        lambda a, b: a & F.coalesce(b, F.lit(False)),
    )
    return F.filter(starts, hit)


def template_words(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> list[dict]:
    """The templates with their words in global order, rarest in the documents first."""
    sets = [(label, sorted(set(_split(text)))) for label, text in templates]
    vocabulary = sorted({w for _, s in sets for w in s})
    if sum(len(s) for _, s in sets) > MAX_TEMPLATE_WORDS:
        raise ValueError("the templates have too many words for this join")
    held = docs.select(F.explode(F.array_intersect(_loose(F.col("text")), F.array(*map(F.lit, vocabulary)))).alias("word"))
    count = {r.word: r["count"] for r in held.groupBy("word").count().collect()}  # one row a template word at most
    out = []
    for k, (label, s) in enumerate(sets):
        need = -int(-threshold * len(s) // 1)
        out.append(
            {
                "template": k,
                "label": label,
                "words": sorted(s, key=lambda w: (count.get(w, 0), w)),
                "need": need,
                "span": run_length(templates[k][1], threshold),
            }
        )
    return out


def run_length(template: str, threshold: float = THRESHOLD) -> int:
    """Words of a run in which a wrapped template is looked for."""
    return -int(-len(_split(template)) / threshold // 1)


def license_scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(string_column(docs, "text"), F.lit("")).alias("text"))
    found = template_words(docs, templates, threshold)
    heads = [
        (
            t["words"][i],
            t["template"],
            t["label"],
            i + 1,
            len(t["words"]),
            t["need"],
            t["span"],
            t["words"],
        ) for t in found for i in range(len(t["words"]) - t["need"] + 1)
    ]
    prefix = F.array(*map(F.lit, sorted({h[0] for h in heads})))
    heads = spark.createDataFrame(heads, "word string, template int, label string, place int, size int, need int, span int, words array<string>")

    base = F.when(_any_phrase(F.col("text")), _words(F.col("text")))
    rows = docs.select(
        "doc_id",
        F.md5(F.col("text").cast("binary")).alias("digest"),
        F.regexp_count("text", F.lit(f"{WORD}+")).cast("long").alias("n_words"),
        base.alias("base"),
        F.when(F.arrays_overlap(_loose(F.col("text")), prefix), F.col("text")).alias("text"),
    )
    starts = [places(F.col("base"), p) for p, _ in PHRASES]
    rows = rows.withColumns({f"at{k}": F.coalesce(s, F.array().cast("array<int>")) for k, s in enumerate(starts)})
    every = F.concat(*[F.col(f"at{k}") for k in range(len(PHRASES))])
    labels = F.array_compact(F.array(*[F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, (_, label) in enumerate(PHRASES)]))
    rows = rows.select(
        "doc_id",
        "digest",
        "n_words",
        F.size(every).cast("long").alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("base"),
        "text",
    )
    rows = written(rows, "licenses")

    block = lambda wrapped: lambda x: F.struct(x.alias("block"), F.lit(wrapped).alias("wrapped"))
    lines = F.transform(F.split("text", "\n"), block(False))
    paragraphs = F.transform(F.filter(F.split("text", f"\n{GAP}*\n"), lambda x: x.contains("\n")), block(True))
    blocks = rows.where("text is not null").select(
        "doc_id",
        "digest",
        F.inline(F.concat(lines, paragraphs)),
    ).where(F.arrays_overlap(_loose(F.col("block")), prefix))
    blocks = blocks.select("doc_id", "digest", "wrapped", _words(F.col("block")).alias("said"))
    blocks = blocks.withColumn("held", F.array_distinct("said")).withColumn("said", F.when(F.col("wrapped"), F.col("said")))
    pairs = blocks.withColumn("word", F.explode(F.array_intersect("held", prefix))).join(F.broadcast(heads), "word")
    pairs = pairs.where((F.size("held") >= F.col("need")) & (F.col("size") - F.col("place") + 1 >= F.col("need")))
    pairs = pairs.where((F.col("place") == 1) | ~F.arrays_overlap("held", F.slice("words", F.lit(1), F.greatest(F.col("place") - 1, F.lit(1)))))
    shared = F.size(F.array_intersect("held", "words"))
    pairs = pairs.withColumn("shared", shared).where("shared >= need")
    begins = F.filter(F.sequence(F.lit(1), F.size("said")), lambda i: F.array_contains("words", F.element_at("said", i)))
    runs = F.transform(begins, lambda i: F.size(F.array_intersect(F.slice("said", i, F.col("span")), F.col("words"))))
    pairs = pairs.withColumn("shared", F.when(F.col("wrapped"), F.array_max(runs)).otherwise(F.col("shared"))).where("shared >= need")
    met = pairs.groupBy(F.col("doc_id").alias("_id"), F.col("digest").alias("_digest")).agg(
        F.collect_set("label").alias("met"),
        F.max(F.col("shared") / F.col("size")).alias("score"),
    )
    out = rows.drop("text").join(met, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("digest") == F.col("_digest")), "left")
    everything = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("met", F.array().cast("array<string>")))))
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        "first_word",
        "last_word",
        F.concat_ws(",", "base").alias("base_labels"),
        F.concat_ws(",", everything).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    """The query by brute force: every line against every template."""
    word = WORD.replace("\\x00", "\\x{0}")
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    low = lambda x: f"translate({x}, '{UPPER}', '{LOWER}')"
    phrases = ", ".join(f"({quote(label)}, [{', '.join(map(quote, p.split()))}])" for p, label in PHRASES)
    templates = ", ".join(
        f"({k}, {quote(label)}, [{', '.join(map(quote, sorted(set(_split(text)))))}], {-int(-THRESHOLD * len(set(_split(text))) // 1)})" for k,
        (label, text) in enumerate(TEMPLATES)
    )
    return f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
told AS (SELECT r, doc_id, text, regexp_extract_all({low('text')}, '{word}+') AS w FROM docs),
phrases(label, p) AS (VALUES {phrases}),
templates(t, label, words, need) AS (VALUES {templates}),
hits AS (SELECT r, label, unnest(list_filter(range(len(w)), lambda i: w[i+1:i+len(p)] = p)) AS i FROM told, phrases WHERE list_has_all(w, p)),
base AS (SELECT r, count(*) AS n, min(i) AS a, max(i) AS z, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hits GROUP BY r),
lines AS (SELECT r, list_distinct(regexp_extract_all({low('line')}, '{word}+')) AS held FROM (SELECT r, unnest(string_split(text, chr(10))) AS line FROM docs)),
met AS (SELECT r, label, len(list_intersect(held, words)) / len(words) AS c FROM lines, templates WHERE len(held) >= need AND len(list_intersect(held, words)) >= need),
every AS (SELECT r, label FROM hits UNION SELECT r, label FROM met),
named AS (SELECT r, string_agg(label, ',' ORDER BY label) AS labels FROM every GROUP BY r),
best AS (SELECT r, max(c) AS score FROM met GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_base, a::BIGINT AS first_word, z::BIGINT AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(named.labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM told LEFT JOIN base USING (r) LEFT JOIN named USING (r) LEFT JOIN best USING (r)
"""


OP6_SQL = _sql()
