"""Licence scan with a positional rare-token index, in DataFrame functions only.

The templates below are indexed by word: each content word lists the templates and positions where
it stands. Each template is looked up by its words of highest inverse document frequency (counted over
all documents), as many as make sure that each place where the template can be verified gets its
votes, whatever else the file holds; every place of such a word and every posting of it give an offset
of file against template. Offsets on which enough different words agree are verified: the template's
mandatory phrase must stand at its place, and the share of the template's words that stand at theirs
must reach ``SHARE``. Base phrases are counted wherever their words stand in a row.

Two passes: the first reads the texts and writes the words of files that have any licence word; the
second works on that table alone. Broadcast and collected: one count per licence word.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

VOTES, SHARE = 3, 0.6

#: Base phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Telling sentences of well-known licences: label, words, mandatory phrase.
TEMPLATES = (
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "gnu lesser general public license"),
    ("agpl", "it under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("apache", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache license version 2 0"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "permission is hereby granted free of charge"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "for any purpose with or without fee"),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", "mozilla public license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike"),
    ("unlicense", "this is free and unencumbered software released into the public domain", "released into the public domain"),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "may be used to endorse or promote products derived from this software"),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "shall be included in all copies or substantial portions of the software"),
    ("apache", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "unless required by applicable law or agreed to in writing"),
    ("zlib", "in no event will the authors be held liable for any damages arising from the use of this software", "will the authors be held liable for any damages"),
    ("boost", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license", "accompanying documentation covered by this license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", "eclipse public license"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", "common development and distribution license"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gnu free documentation license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain", "has dedicated the work to the public domain"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    ("wtfpl", "changing it is allowed as long as the name is changed", "changing it is allowed as long as the name is changed"),
    ("mit", "this project is released under the mit license", "mit license"),
    ("apache", "distributed under the apache license version 2 0", "apache license version 2 0"),
    ("gpl", "released under the gnu general public license version 3", "gnu general public license"),
    ("cc-by", "this content is available under cc by 4 0", "cc by 4 0"),
)
#: Function words are no evidence and stay out of the index.
COMMON = frozenset("a above all an and any are as be by can either from for form has he in into is it its long made may neither no nor not of on or out shall that the this to under was will with without you 0 1 2 3 4 v unless use used who".split())

_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _index() -> dict[str, list[tuple[int, int]]]:
    out: dict[str, list[tuple[int, int]]] = {}
    for t, (_, text, _) in enumerate(TEMPLATES):
        for q, w in enumerate(text.split()):
            if w not in COMMON:
                out.setdefault(w, []).append((t, q))
    for phrase in BASE:  # a phrase's content words show that it may occur
        for w in phrase.split():
            if w not in COMMON:
                out.setdefault(w, [])
    return out


INDEX = _index()
VOCABULARY = tuple(sorted(INDEX))
if len(VOCABULARY) > 256:
    raise ValueError("a word's number must fit the 8 bits of a vote")


def words(text: Column) -> Column:
    """Words of a text with A-Z lower-cased. lower() also folds letters beyond ASCII, which changes no
    word border; the Kelvin sign alone would become an ASCII letter, so another letter stands for it."""
    return F.regexp_extract_all(F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit("\u212a"), F.lit("\u0138"))), F.lit(_WORDS), F.lit(0))


def _strings(values) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _at(w: Column, i: Column, phrase: list[str]) -> Column:
    """Do the phrase's words stand in ``w`` from place i (0-based) on?"""
    out = F.get(w, i) == phrase[0]
    for j, word in enumerate(phrase[1:], 1):
        out = out & F.coalesce(F.get(w, i + j) == word, F.lit(False))
    return F.coalesce(out, F.lit(False))


def _places(w: Column, phrase: list[str]) -> Column:
    """Places of a phrase: array<int>."""
    starts = F.filter(F.transform(w, lambda x, i: F.when(x == phrase[0], i).otherwise(-1)), lambda i: i >= 0)
    return F.filter(starts, lambda i: _at(w, i, phrase))


def scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    n_base counts all places of base phrases; first_word and last_word are the smallest and largest
    word they start at (null without any). labels holds the base labels and those of verified
    templates; score is the best share of a template's words that stand in place, at least 0.5 with
    a base phrase, else 0. matches: verified templates as struct(label, word, share).

    Null text is empty: no words, empty labels, score 0. Null and repeated doc_ids are reported row
    by row; other columns are ignored; no rows give no rows.
    """
    scratch = Scratch(docs.sparkSession, "licenses")
    w = docs.select(F.col("doc_id").cast("long").alias("doc_id"), words(F.col("text").cast("string")).alias("w"))
    found = w.select("doc_id", "w", F.array_intersect("w", _strings(VOCABULARY)).alias("own"))
    base = scratch.keep(found.select("doc_id", F.size("w").cast("long").alias("n_words"), "own", F.when(F.size("own") > 0, F.col("w")).alias("w")), "words")
    total = base.count()
    df = {r.word: r.n for r in base.where(F.size("own") > 0).select(F.explode("own").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}  # at most one row a licence word
    idf = {v: math.log((total + 1) / (df.get(v, 0) + 1)) for v in VOCABULARY}
    by_rank = sorted(VOCABULARY, key=lambda v: (-idf[v], v))
    some = base.where(F.size("own") > 0)

    need, postings_of = _votes(by_rank)
    own = F.array_intersect("own", _strings(v for v in VOCABULARY if v in postings_of))
    some = some.select("doc_id", "n_words", "w", own.alias("rare"), *(_places(F.col("w"), p.split()).alias(f"b{i}") for i, p in enumerate(BASE)))
    # a vote: template in bits 51 to 42, offset + 2^20 ... in bits 41 to 8, word in bits 7 to 0
    postings = F.create_map(*(x for i, v in enumerate(VOCABULARY) if v in postings_of for x in (F.lit(v), F.array(*(F.lit((t << 42) - (q << 8) + (1 << 18) + i).cast("long") for t, q in postings_of[v])))))
    places = F.filter(F.transform("w", lambda x, i: F.when(F.array_contains("rare", x), F.struct(x.alias("x"), F.shiftleft(i.cast("long"), 8).alias("p")))), lambda s: s.isNotNull())
    votes = F.array_sort(F.array_distinct(F.flatten(F.transform(places, lambda s: F.transform(F.element_at(postings, s["x"]), lambda q: s["p"] + q)))))
    some = some.withColumn("votes", votes)
    least = _ints(need)
    spot = lambda v: F.shiftright(v, 8)
    agreed = F.filter("votes", lambda v, i: F.coalesce(spot(F.get("votes", i + F.get(least, F.shiftright(v, 42).cast("int")) - 1)) == spot(v), F.lit(False)))
    some = some.withColumn("spots", F.array_distinct(F.transform(agreed, spot)))
    texts = F.array(*(_strings(t.split()) for _, t, _ in TEMPLATES))
    labels = _strings(t[0] for t in TEMPLATES)
    keys = F.array(*(_strings(k.split()) for _, _, k in TEMPLATES))
    key_at = _ints([_find(t.split(), k.split()) for _, t, k in TEMPLATES])

    def judge(s: Column) -> Column:
        t = F.shiftright(s, 34).cast("int")
        off = (s.bitwiseAND(F.lit((1 << 34) - 1)) - (1 << 10)).cast("int")
        begin = off + F.get(key_at, t)
        key = F.get(keys, t)
        phrase = F.when(begin >= 0, F.slice("w", F.greatest(begin + 1, F.lit(1)), F.size(key)) == key).otherwise(F.lit(False))
        same = F.size(F.filter(F.transform(F.get(texts, t), lambda x, j: F.when(off + j >= 0, F.coalesce(F.get("w", F.greatest(off + j, F.lit(0))) == x, F.lit(False))).otherwise(F.lit(False))), lambda x: x))
        return F.struct(F.get(labels, t).alias("label"), F.greatest(off, F.lit(0)).cast("long").alias("word"), F.when(phrase, same / F.size(F.get(texts, t))).otherwise(F.lit(0.0)).alias("share"))

    some = some.withColumn("matches", F.filter(F.transform("spots", judge), lambda m: m["share"] >= SHARE))
    starts = F.flatten(F.array(*(F.col(f"b{i}") for i in range(len(BASE)))))
    some = some.withColumn("starts", starts).withColumn("base", F.array_sort(F.array_distinct(F.filter(F.array(*(F.when(F.size(f"b{i}") > 0, F.lit(v)) for i, v in enumerate(BASE.values()))), lambda x: x.isNotNull()))))
    with_words = some.select(
        "doc_id", "n_words", F.size("starts").cast("long").alias("n_base"), F.array_min("starts").cast("long").alias("first_word"), F.array_max("starts").cast("long").alias("last_word"), F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.transform("matches", lambda m: m["label"]))), ",").alias("labels"),
        F.greatest(F.when(F.size("starts") > 0, F.lit(0.5)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform("matches", lambda m: m["share"])), F.lit(0.0))).alias("score"), "matches",
    )
    without = base.where(F.size("own") == 0).select(
        "doc_id", "n_words", F.lit(0).cast("long").alias("n_base"), F.lit(None).cast("long").alias("first_word"), F.lit(None).cast("long").alias("last_word"), F.lit("").alias("base_labels"), F.lit("").alias("labels"), F.lit(0.0).alias("score"),
        F.array().cast("array<struct<label:string,word:bigint,share:double>>").alias("matches"),
    )
    return with_words.unionByName(without)


def _ints(values: list[int]) -> Column:
    return F.array(*(F.lit(v) for v in values))


def _votes(by_rank: list[str]) -> tuple[list[int], dict[str, list[tuple[int, int]]]]:
    """Votes that each template needs, and the postings (template, position) of the words that vote.

    A verified place has the phrase and ``SHARE`` of the words, so at least ``sure`` different content
    words of the template stand in place; of any (all - sure + need) of them at least ``need`` do.
    """
    rank = {v: i for i, v in enumerate(by_rank)}
    need, out = [], {}
    for t, (_, text, phrase) in enumerate(TEMPLATES):
        counts = Counter(text.split())
        inside = set(phrase.split())
        sure = len(inside - COMMON)
        left = math.ceil(SHARE * counts.total() - 1e-9) - sum(n for w, n in counts.items() if w in inside or w in COMMON)
        for n in sorted((n for w, n in counts.items() if w not in inside and w not in COMMON), reverse=True):
            if left <= 0:
                break
            sure, left = sure + 1, left - n
        need.append(min(VOTES, sure))
        content = sorted({w for w in counts if w not in COMMON}, key=rank.get)
        for w in content[: len(content) - sure + need[-1]]:
            out.setdefault(w, []).extend(x for x in INDEX[w] if x[0] == t)
    return need, out


def _find(text: list[str], phrase: list[str]) -> int:
    return next(i for i in range(len(text)) if text[i : i + len(phrase)] == phrase)
