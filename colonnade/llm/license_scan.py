"""Licences: a positional index of templates' words, looked up by all licence words of each file.

Every template is filed by its words (function words left out) and their places. Each place of a licence word in a file
is looked up, and postings that agree on where the template would start in the file are intersected. A placement
with enough agreeing words holds if the template's mandatory phrase stands where the placement puts it. The index
has the size of the templates' vocabulary, which is fixed, and is broadcast; all else stays distributed.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colonnade.llm.common import Scratch
from colonnade.llm.spans import PART_CHAR, WORD_CHAR, matches, word_count

#: The base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
MIN_VOTES = 2
#: Public licence notices as (label, mandatory phrase, words).
TEMPLATES = [
    ("gpl", "gnu general public license", "this work is licensed under the gnu general public license version"),
    ("gpl", "gnu general public license", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("lgpl", "gnu lesser general public license", "under the terms of the gnu lesser general public license as published by the free software foundation"),
    ("agpl", "gnu affero general public license", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("apache-2.0", "apache license version 2 0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("mit", "mit license", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("bsd", "redistribution and use in source and binary forms", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "mozilla public license", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "cc by nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "cc by sa", "licensed under cc by sa 4 0"),
    ("cc-by", "creative commons attribution", "this work is licensed under a creative commons attribution 4 0 international license"),
]
#: Function words, which no index entry is made for.
COMMON = frozenset("a an and any are as at be by can for form from in is it met may not of on or that the this to use v with without you 0 2 4".split())


def vocabulary() -> list[str]:
    return sorted({w for _, _, text in TEMPLATES for w in text.split()} - COMMON)


def postings(spark: SparkSession) -> DataFrame:
    """word, template, label, place, indexed (words of the template in the index), phrase, phrase_at."""
    rows = []
    for k, (label, phrase, text) in enumerate(TEMPLATES):
        words, want = text.split(), phrase.split()
        at = next(i for i in range(len(words)) if words[i : i + len(want)] == want)
        entries = [(w, i) for i, w in enumerate(words) if w not in COMMON]
        rows += [(w, k, label, i, len(entries), phrase, at) for w, i in entries]
    return spark.createDataFrame(rows, "word string, template int, label string, place long, indexed int, phrase string, phrase_at long")


def any_of(words: list[str]) -> str:
    """A regular expression for any of the words, branching letter by letter."""
    ends, by_letter = "" in words, {}
    for w in words:
        if w:
            by_letter.setdefault(w[0], []).append(w[1:])
    branches = [re.escape(c) + any_of(rest) for c, rest in sorted(by_letter.items())]
    if not branches:
        return ""
    joined = branches[0] if len(branches) == 1 and not ends else f"(?:{'|'.join(branches)})"
    return joined + "?" if ends else joined


def _pattern(words: list[str]) -> str:
    return rf"(?i)(?<!{WORD_CHAR})" + rf"{PART_CHAR}++".join(map(re.escape, words)) + rf"(?!{WORD_CHAR})"


def phrase_places(text: Column, phrase: str, likely: Column) -> Column:
    """Numbers of the words at which a phrase's words stand one after the other."""
    return F.transform(matches(text, _pattern(phrase.split()), word_count, likely), lambda m: m["start"])


def scan(docs: DataFrame, name: str = "licences") -> DataFrame:
    """docs (doc_id, text) -> a row per row: doc_id, n_words, places (per base phrase), base_labels, labels, score.

    labels also has those of verified templates. score: 1 with a base label, else the largest share of a verified
    template's indexed words that are in place, 0 without any. Null and empty texts have no words and no labels; an empty
    table gives no rows; rows that repeat whole are scored alike.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, name)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("doc_id", "text").alias("k1"), F.xxhash64("text", F.lit(1)).alias("k2"), F.coalesce("text", F.lit("")).alias("text"))
    text = F.col("text")
    entry = rf"(?i)(?<!{WORD_CHAR}){any_of(vocabulary())}(?!{WORD_CHAR})"
    # every phrase has a word of the vocabulary, so texts without one are searched no further
    rows, hit = rows.withColumn("hit", text.rlike(entry)), F.col("hit")
    words = F.transform(matches(text, entry, word_count, hit), lambda m: F.struct(F.lower(m["text"]).alias("word"), m["start"].alias("at")))
    phrases = sorted({p for _, p, _ in TEMPLATES} - BASE.keys())
    table = rows.select(
        "doc_id",
        "k1",
        "k2",
        word_count(text).cast("long").alias("n_words"),
        F.struct(*(phrase_places(text, p, hit).alias(f"p{i}") for i, p in enumerate(BASE))).alias("places"),
        words.alias("words"),
        F.array(*(F.struct(F.lit(p).alias("phrase"), phrase_places(text, p, hit).alias("at")) for p in phrases)).alias("phrases"),
    )
    table = scratch.write(table, "base")
    own = [F.struct(F.lit(p).alias("phrase"), F.col(f"places.p{i}").alias("at")) for i, p in enumerate(BASE)]
    marked = table.filter("size(words) > 0").select("k1", "k2", "words", F.concat(F.array(*own), "phrases").alias("phrases"))
    held = marked.dropDuplicates(["k1", "k2"])
    index = F.broadcast(postings(spark))
    looked_up = held.select("k1", "k2", F.explode("words").alias("w"))
    looked_up = looked_up.select("k1", "k2", F.col("w.word").alias("word"), F.col("w.at").alias("at")).join(index, "word").withColumn("offset", F.col("at") - F.col("place"))
    votes = looked_up.groupBy("k1", "k2", "template", "label", "indexed", "phrase", "phrase_at", "offset").agg(F.count("*").alias("votes")).filter(F.col("votes") >= MIN_VOTES)
    checked = votes.join(held.select("k1", "k2", "phrases"), ["k1", "k2"]).filter(F.exists("phrases", lambda p: (p["phrase"] == F.col("phrase")) & F.array_contains(p["at"], F.col("offset") + F.col("phrase_at"))))
    found = checked.groupBy("k1", "k2").agg(F.collect_set("label").alias("more"), F.max(F.col("votes") / F.col("indexed")).alias("share"))
    base_labels = F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(F.size(f"places.p{i}") > 0, F.lit(label)) for i, label in enumerate(BASE.values()))))))
    merged = table.select("doc_id", "k1", "k2", "n_words", F.array_sort(F.concat(*(F.col(f"places.p{i}") for i in range(len(BASE))))).alias("places"), base_labels.alias("base_labels")).join(found, ["k1", "k2"], "left")
    labels = F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.size("base_labels") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0)))
    return merged.select("doc_id", "n_words", "places", "base_labels", labels.alias("labels"), score.alias("score"))

