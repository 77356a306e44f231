"""Licence scans by a positional index of rare words.

Licence templates are indexed by their rarest words (highest inverse document frequency over the whole corpus) and
their places. All indexed words of a file are looked up; where enough of them agree on one shift between file and
template, the template lies there, if its mandatory key phrases stand at their places too. Everything is DataFrame expressions;
one row is worked on at a time, and only the licence words' document frequencies are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words, before A-Z are lower-cased.
BREAK = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"

# Base phrases and their labels.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

# Notices by which licences are referred to or stated, each with its label and mandatory key phrases.
TEMPLATES = [
    ("mit", "released under the mit license see the license file for details", ["the mit license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ["granted free of charge", "without restriction"]),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("apache-2", "you may obtain a copy of the license at http www apache org licenses license 2 0", ["www apache org licenses"]),
    ("gpl-3", "licensed under the gnu general public license version 3", ["gnu general public license", "version 3"]),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license", "free software foundation"]),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ["gnu lesser general public license"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["source and binary forms", "conditions are met"]),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ["mozilla public license"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ["public domain", "cc0"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software", "public domain"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee"]),
    ("proprietary", "all rights reserved", ["all rights reserved"]),
]
#: Rarest words of a template that are indexed.
INDEXED = 4
#: Of a template's indexed words, this share has to agree on a shift.
AGREE = 0.75
#: Of all its words, this share has to stand at its place.
COVER = 0.75


def file_words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased. Other letters may be lower-cased too, but none turns into an ASCII one."""
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("K"), F.lit("Ω")))
    return F.array_remove(F.split(plain, BREAK), "")


def _array(words: list[str]) -> Column:
    return F.array(*(F.lit(w) for w in words))


def phrase_places(words: Column, phrases: dict[str, str], anchor: dict[str, int] | None = None) -> Column:
    """An array of structs label, at: where a phrase's words stand one after another, in order of the last words' places."""

    def place(w: Column, i: Column) -> Column:
        found = F.lit(None).cast("struct<label:string,at:bigint>")
        chain = None
        for label, phrase in phrases.items():
            parts = phrase.split()
            k = (anchor or {}).get(label, len(parts) - 1)
            here = w == parts[k]
            for j, part in enumerate(parts):
                if j != k:
                    here &= F.get(words, i + (j - k)) == part
            made = F.struct(F.lit(label).alias("label"), (i - k).cast("long").alias("at"))
            chain = F.when(here, made) if chain is None else chain.when(here, made)
        return chain.otherwise(found)

    return F.filter(F.transform(words, place), lambda p: p.isNotNull())


def word_frequencies(worded: DataFrame, words: str = "__w") -> dict[str, float]:
    """Inverse document frequency of each licence word over all rows: log((N + 1) / (n + 1)). One row a word is collected."""
    vocabulary = sorted({w for _, t, _ in TEMPLATES for w in t.split()})
    seen = worded.select(F.explode(F.concat(F.array_intersect(F.col(words), _array(vocabulary)), F.array(F.lit("")))).alias("w"))
    counts = {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count("*").alias("n")).collect()}
    total = counts.pop("", 0)
    return {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}


def postings(idf: dict[str, float]) -> dict[str, list[tuple[int, int, int]]]:
    """For each indexed word: template, place in it, and how many indexed words of the template have to agree."""
    index: dict[str, list[tuple[int, int, int]]] = {}
    for t, (_, text, _) in enumerate(TEMPLATES):
        words = text.split()
        rare = sorted(range(len(words)), key=lambda i: (-idf[words[i]], i))[:INDEXED]
        for i in rare:
            index.setdefault(words[i], []).append((t, i, max(1, math.ceil(AGREE * len(rare)))))
    return index


def scan(worded: DataFrame, idf: dict[str, float], words: str = "__w", out: str = "__found") -> DataFrame:
    """worded with a struct of places (base phrases, as phrase_places), labels (the templates' that lie in the file),
    and score, the largest share of a template's words that stand at their places (1 for a base phrase; 0 for none).

    A file without words has no places, no labels and score 0. Every row and column stays, whatever its name, but one
    named as out is replaced. Of words that tie in rarity, a template's first ones are indexed.
    """
    index = postings(idf)
    kept = [c for c in worded.columns if c != out]
    worded = worded.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.col(f"`{words}`").alias("__words"))
    w = F.col("__words")
    rows = lambda items: F.array(*(F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"), F.lit(n).alias("n")) for t, p, n in items))
    table = F.create_map(*(x for word, items in index.items() for x in (F.lit(word), rows(items))))
    df = worded.withColumns({"__places": phrase_places(w, PHRASES, {"apache-2": 0}), "__own": F.array_intersect(_array(list(index)), w)})
    hits = F.filter(F.transform(w, lambda x, i: F.when(x.isin(list(index)), F.struct(x.alias("w"), i.alias("i")))), lambda h: h.isNotNull())
    df = df.withColumn("__hits", F.when(F.size("__own") > 0, hits))
    shift = lambda h: F.transform(F.element_at(table, h["w"]), lambda p: F.struct(p["t"].alias("t"), (h["i"] - p["p"]).alias("o"), p["n"].alias("n")))
    df = df.withColumn("__votes", F.sort_array(F.flatten(F.transform("__hits", shift))))
    votes = F.col("__votes")
    agreed = lambda v, k: (F.get(votes, k + v["n"] - 1) == v) & ((k == 0) | (F.get(votes, k - 1) != v))
    df = df.withColumn("__shifts", F.filter(F.transform(votes, lambda v, k: F.when(agreed(v, k), v)), lambda v: v.isNotNull()))

    def cover(s: Column) -> Column:
        chain = None
        for t, (label, text, phrases) in enumerate(TEMPLATES):
            parts = text.split()
            part = F.slice(w, s["o"] + 1, F.lit(len(parts)))
            share = F.size(F.filter(F.zip_with(part, _array(parts), lambda a, b: F.coalesce(a == b, F.lit(False))), lambda same: same)) / len(parts)
            whole = F.lit(True)
            for phrase in phrases:
                keys = phrase.split()
                k = next(i for i in range(len(parts)) if parts[i : i + len(keys)] == keys)
                whole &= F.slice(w, s["o"] + k + 1, F.lit(len(keys))) == _array(keys)
            made = F.struct(F.lit(label).alias("label"), share.alias("share"))
            chain = F.when((s["t"] == t) & whole, made) if chain is None else chain.when((s["t"] == t) & whole, made)
        return chain

    # a template that would begin before the file cannot have its first words there, and is held against what there is
    inside = F.filter("__shifts", lambda s: s["o"] >= 0)
    df = df.withColumn("__verified", F.filter(F.transform(inside, cover), lambda v: v.isNotNull() & (v["share"] >= COVER)))
    verified = F.coalesce("__verified", F.array().cast("array<struct<label:string,share:double>>"))
    best = F.aggregate(verified, F.lit(0.0), lambda a, v: F.greatest(a, v["share"]))
    score = F.when(F.size("__places") > 0, 1.0).otherwise(best)
    made = F.struct(F.col("__places").alias("places"), F.array_distinct(F.transform(verified, lambda v: v["label"])).alias("labels"), score.alias("score"))
    return df.select(*(F.col(f"row.`{c}`").alias(c) for c in kept), made.alias(out))


def scan_licenses(df: DataFrame, text: str = "text", words: str = "__w", out: str = "__found") -> DataFrame:
    """df with its words (array) and what scan() finds in them; frequencies are counted over all of df's texts first.

    A null or empty text has no words. Repeated rows are scanned, and counted, each for itself; an empty df stays so.
    """
    worded = df.withColumn(words, file_words(F.col(text)))
    return scan(worded, word_frequencies(worded.select(words), words), words, out)
