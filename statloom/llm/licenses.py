"""License scans by a positional rare-token index; DataFrame functions only.

Phrases and licence notices are templates. Document frequencies of their vocabulary are
counted over all documents; of every notice the ``rarest`` words, and of every base phrase
the one word, with the highest idf go into a *posting table*: word to (template, position).
A text's words are looked up in it; each hit names a template and the place where it would
begin (the hit less the position). Hits that agree on both are counted (sorted, as runs),
and a template stands where enough of its rare words agree and its mandatory key phrase
stands at its relative position, word by word. A base phrase is its own key.

The table is made of the fixed lists in this module, or of any given ones, and travels
inside the plan (a few hundred words); a text is worked on within its own row, in time
proportional to its words and hits, so nothing is shuffled but the word counts. The texts
are split into words twice, for the counts and for the scan.

Words are lower-cased (A-Z only) runs without ASCII white space, signs and controls.
Defined results: a null or wordless text has no place, null first and last word, empty
labels and score 0; very long texts are scanned whole; rows are judged one by one, so
repeated rows give repeated results; an empty table gives none. Input columns named like
new ones are replaced. Ties of idf go to the earlier word. ``score`` is 1 where a base
phrase stands, else the best share, ``least`` or more, of a notice's rare words that stand
in place (0 without one, or without its key phrase).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SEPARATORS = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Fixed base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Fixed notices of public licences: label, notice, mandatory key phrase (words of it).
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "permission is hereby granted free of charge"),
    ("mit", "released under the mit license", "the mit license"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", "apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license", "use this file except in compliance"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistribution and use in source and binary forms"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "endorse or promote products derived from this software"),
    ("gpl-notice", "this work is licensed under the gnu general public license version", "gnu general public license"),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "as published by the free software foundation"),
    ("lgpl", "you can redistribute it and or modify it under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", "gnu affero general public license"),
    ("gfdl", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", "gnu free documentation license"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at", "mozilla public license"),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license", "eclipse public license"),
    ("cddl", "the contents of this file are subject to the terms of the common development and distribution license", "common development and distribution license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and or distribute this software"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", "without any express or implied warranty"),
    ("bsl-1.0", "distributed under the boost software license version 1 0", "boost software license"),
    ("artistic", "this package is free software you can redistribute it under the terms of the artistic license", "the artistic license"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software", "released into the public domain"),
    ("cc0", "the person who associated a work with this deed has dedicated the work to the public domain by waiving all of his or her rights to the work worldwide under copyright law", "dedicated the work to the public domain"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", "creative commons attribution"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", "sil open font license"),
    ("odbl", "this database is made available under the open database license", "open database license"),
    ("spdx-mit", "spdx license identifier mit", "spdx license identifier mit"),
    ("spdx-apache-2.0", "spdx license identifier apache 2 0", "spdx license identifier apache"),
    ("spdx-bsd", "spdx license identifier bsd", "spdx license identifier bsd"),
    ("spdx-gpl", "spdx license identifier gpl", "spdx license identifier gpl"),
    ("spdx-mpl", "spdx license identifier mpl", "spdx license identifier mpl"),
)


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and use it in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


@dataclass(frozen=True)
class Template:
    label: str
    rare: tuple[tuple[int, str], ...]  # position and word, into the posting table
    at: int  # position of the key phrase
    key: tuple[str, ...]
    base: bool


def _vocabulary(base: tuple, templates: tuple) -> list[str]:
    return sorted({w for text, _ in base for w in text.split()} | {w for _, notice, _ in templates for w in notice.split()})


def document_frequencies(words: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows each vocabulary word occurs; ``words`` has an array ``w``."""
    hit = F.array_distinct(F.transform(F.filter("w", lambda x: F.lower(x).isin(vocabulary)), lambda x: F.lower(x)))
    rows = words.select(F.explode(hit).alias("w")).groupBy("w").count().collect()  # at most the vocabulary
    return {r["w"]: r["count"] for r in rows}


def build_index(words: DataFrame, base: tuple = BASE, templates: tuple = TEMPLATES, rarest: int = 6) -> list[Template]:
    """Templates with their rarest words by the idf over all rows of ``words``."""
    found = document_frequencies(words, _vocabulary(base, templates))
    idf = lambda w: -math.log1p(found.get(w, 0))  # noqa: E731  the rarer the larger
    rare = lambda own, n: tuple((k, own[k]) for k in sorted(sorted(range(len(own)), key=lambda k: (-idf(own[k]), k))[:n]))
    out = [Template(label, rare(text.split(), 1), 0, tuple(text.split()), True) for text, label in base]
    for label, notice, key in templates:
        own, whole = tuple(key.split()), notice.split()
        at = next(k for k in range(len(whole)) if tuple(whole[k : k + len(own)]) == own)
        out.append(Template(label, rare(whole, rarest), at, own, False))
    return out


def postings(index: list[Template]) -> dict[str, list[tuple[int, int]]]:
    """word: (template, position) of every rare word."""
    out: dict[str, list[tuple[int, int]]] = {}
    for t, template in enumerate(index):
        for position, word in template.rare:
            out.setdefault(word, []).append((t, position))
    return out


def word_array(text: Column) -> Column:
    """Words of a text as they stand; the text is split, so that case need not be
    changed in more than the words that are looked up."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATORS, -1), "")


def _lower(word: Column) -> Column:
    """A-Z lower-cased, and nothing else."""
    return F.translate(word, _UPPER, _LOWER)


def _standing(words: Column, index: list[Template], least: float) -> Column:
    """Places (label, start, base, share) of the templates that stand in a text."""
    table = postings(index)
    entry = lambda t, position: F.struct(F.lit(t).alias("t"), F.lit(position).alias("p"))
    posted = F.create_map(*[x for w, own in sorted(table.items()) for x in (F.lit(w), F.array(*[entry(*e) for e in own]))])
    of = lambda values: lambda t: F.get(F.array(*[F.lit(v) for v in values]), t)  # noqa: E731  a table by template
    enough, size, at = (of(v) for v in ([1 if x.base else math.ceil(least * len(x.rare)) for x in index], [len(x.rare) for x in index], [x.at for x in index]))
    label, base, length = (of(v) for v in ([x.label for x in index], [x.base for x in index], [len(x.key) for x in index]))
    keys = F.array(*[F.array(*[F.lit(w) for w in x.key]) for x in index])
    none = F.expr("cast(array() as array<struct<t:int,s:int>>)")

    def begins(hits: Column) -> Column:
        """(template, place of its first word) that the hits name, sorted."""
        each = lambda p: F.coalesce(F.transform(F.element_at(posted, _lower(F.get(words, p))), lambda e: F.struct(e["t"].alias("t"), (p - e["p"]).alias("s"))), none)
        return F.array_sort(F.flatten(F.transform(hits, each)))

    def agreed(named: Column) -> Column:
        """Runs of equal entries, with their length."""
        edges = F.filter(F.transform(named, lambda x, i: F.when((i == 0) | (F.get(named, i - 1) != x), i)), lambda i: i.isNotNull())
        run = lambda edge: F.transform(edge, lambda i, k: F.struct(F.get(named, i)["t"].alias("t"), F.get(named, i)["s"].alias("s"), (F.coalesce(F.get(edge, k + 1), F.size(named)) - i).alias("n")))
        return _let(edges, run)

    def stands(x: Column) -> Column:
        start = x["s"] + at(x["t"])
        return F.coalesce((x["n"] >= enough(x["t"])) & (start >= 0) & (F.transform(F.slice(words, F.greatest(start, F.lit(0)) + 1, length(x["t"])), _lower) == F.get(keys, x["t"])), F.lit(False))

    place = lambda x: F.struct(label(x["t"]).alias("label"), (x["s"] + at(x["t"])).cast("long").alias("start"), base(x["t"]).alias("base"), (x["n"] / size(x["t"])).cast("double").alias("share"))
    hits = F.filter(F.transform(words, lambda w, i: F.when(F.lower(w).isin(sorted(table)), i)), lambda i: i.isNotNull())
    return _let(hits, lambda h: F.when(F.size(h) > 0, F.transform(F.filter(_let(begins(h), agreed), stands), place)))


def scan(docs: DataFrame, text_col: str = "text", base: tuple = BASE, templates: tuple = TEMPLATES, least: float = 0.5) -> DataFrame:
    """``docs`` with n_words, n_base, first_word, last_word, base_labels, labels, score
    and ``places`` (label, start of every verified phrase). Columns of these names are
    replaced."""
    new = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places")
    keep = [F.col(f"`{c}`") for c in docs.columns if c not in new]
    index = build_index(docs.select(word_array(F.col(text_col)).alias("w")), base, templates)

    def judge(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), _standing(words, index, least).alias("places"))

    rows = docs.select(*keep, _let(word_array(F.col(text_col)), judge).alias("__l"))
    places = F.coalesce(F.col("__l.places"), F.from_json(F.lit("[]"), "array<struct<label:string,start:bigint,base:boolean,share:double>>"))
    rows = rows.select(*keep, F.col("__l.n_words").alias("n_words"), places.alias("places"))
    own = F.filter("places", lambda x: x["base"])
    start = F.transform(own, lambda x: x["start"])
    names = lambda which: F.array_join(F.array_sort(F.array_distinct(F.transform(which, lambda x: x["label"]))), ",")
    return rows.select(
        *keep, "n_words", F.size(own).cast("long").alias("n_base"), F.array_min(start).alias("first_word"), F.array_max(start).alias("last_word"),
        names(own).alias("base_labels"), names(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda x: x["share"])), F.lit(0.0)).alias("score"), "places",
    )


def licenses_query(docs: DataFrame) -> DataFrame:
    return scan(docs.select("doc_id", "text")).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
