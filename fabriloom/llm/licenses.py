"""Licence scan by a positional rare-token index, in DataFrame functions only.

For each licence template the index holds the places of the two words of highest inverse document frequency among those of
its mandatory key phrases. Each file looks up which of its words are such: a word at place i and a template place p give
the relative position i - p, and where both words of a template give the same one the template is a candidate there
(postings intersected by relative position). At a candidate's position the IDF of the template words that stand in place
is summed and held against the template's whole; its mandatory key phrases must all stand where the template has them, and
no phrase that names another licence (such as attribution followed by noncommercial) may stand where the first of them
does. As key words are mandatory, no place of a template with its key phrases escapes, whatever else the file has.
IDF comes from one pass over all documents, one row for each word of the templates, which is all that reaches the
driver; common words weigh little by it, so none are listed.

Base labels mark phrases wherever their words follow each other; labels also has what the index finds.

Defined results: null, empty and wordless texts have no words, no labels and score 0; first_word and last_word
are null without a base phrase; overlapping phrases each count; repeated rows are answered each; extra columns are
ignored. Very long texts are scanned whole, each in its own row; nothing is shuffled but the word counts.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fabriloom.llm.native_text import count_words, plain, words_of

#: Base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
_CC = "creative commons attribution"
_NC, _SA, _ND = ["noncommercial", "non commercial"], ["sharealike", "share alike"], ["noderivatives", "no derivatives", "noderivs", "no derivs"]


def _cc(label: str, parts: list[list[str]], without: list[str]) -> list[tuple[str, str, list[str], list[str]]]:
    """The notices of a Creative Commons licence by its long name: parts are the spellings of what follows attribution, and without
    what may not follow."""
    names = [_CC]
    for spellings in parts:
        names = [f"{name} {s}" for name in names for s in spellings]
    return [(label, f"{before} {name}", [name], [f"{name} {x}" for x in without]) for name in names for before in ("licensed under a", "under the")]


def _named(label: str, *names: str, without: tuple[str, ...] = ()) -> list[tuple[str, str, list[str], list[str]]]:
    """Notices that name a licence, its identifier lines among them; without: phrases at the name's place that name another."""
    return [(label, f"{before} {n}", [n], list(without)) for n in names for before in ("licensed under the", "spdx license identifier")]


#: Licence notices as words (label, words, mandatory key phrases, phrases that may not stand where the first key does).
TEMPLATES = [
    ("mit", "released under the mit license", ["mit license"], []),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ["permission is hereby granted free of charge"], []),
    *_named("mit", "mit license"),
    ("mit", "spdx license identifier mit", ["spdx license identifier mit"], []),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "for any purpose with or without fee is hereby granted"], []),
    ("isc", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted", ["permission to use copy modify", "for any purpose with or without fee is hereby granted"], []),
    ("isc", "released under the isc license", ["isc license"], []),
    ("isc", "spdx license identifier isc", ["spdx license identifier isc"], []),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["redistribution and use in source and binary forms"], []),
    ("bsd", "licensed under the bsd license", ["bsd license"], []),
    ("bsd", "licensed under the 3 clause bsd license", ["3 clause bsd license"], []),
    ("bsd", "spdx license identifier bsd 2 clause", ["spdx license identifier bsd"], []),
    ("bsd", "spdx license identifier bsd 3 clause", ["spdx license identifier bsd"], []),
    ("apache-2", "licensed under the apache license version 2 0", ["apache license", "2 0"], []),
    ("apache-2", "licensed under the apache license 2 0", ["apache license 2 0"], []),
    ("apache-2", "licensed under the apache 2 0 license", ["apache 2 0 license"], []),
    ("apache-2", "spdx license identifier apache 2 0", ["spdx license identifier apache 2 0"], []),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ["gnu general public license", "version 3"], []),
    ("gpl-3", "under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ["gnu general public license", "version 3"], []),
    ("gpl-3", "licensed under the gnu gpl version 3", ["gpl version 3"], []),
    ("gpl-3", "licensed under gpl v3", ["gpl v3"], []),
    ("gpl-3", "licensed under gplv3", ["under gplv3"], []),
    ("gpl-3", "spdx license identifier gpl 3 0", ["spdx license identifier gpl 3 0"], []),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ["gnu general public license", "version 2"], []),
    ("gpl-2", "under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ["gnu general public license", "version 2"], []),
    ("gpl-2", "licensed under gpl v2", ["gpl v2"], []),
    ("gpl-2", "licensed under gplv2", ["under gplv2"], []),
    ("gpl-2", "spdx license identifier gpl 2 0", ["spdx license identifier gpl 2 0"], []),
    ("gpl", "redistribute it and or modify it under the terms of the gnu general public license", ["gnu general public license"], []),
    ("lgpl", "under the terms of the gnu lesser general public license", ["gnu lesser general public license"], []),
    ("lgpl", "under the terms of the gnu library general public license", ["gnu library general public license"], []),
    ("lgpl", "spdx license identifier lgpl 2 1", ["spdx license identifier lgpl"], []),
    ("agpl", "under the terms of the gnu affero general public license", ["gnu affero general public license"], []),
    ("agpl", "licensed under the agpl", ["under the agpl"], []),
    ("agpl", "licensed under the agplv3", ["under the agplv3"], []),
    ("agpl", "spdx license identifier agpl 3 0", ["spdx license identifier agpl"], []),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 0", ["mozilla public license"], []),
    ("mpl-2", "licensed under the mozilla public license version 2 0", ["mozilla public license"], ["mozilla public license version 1", "mozilla public license 1"]),
    ("mpl-2", "spdx license identifier mpl 2 0", ["spdx license identifier mpl 2 0"], []),
    ("epl", "under the terms of the eclipse public license", ["eclipse public license"], []),
    ("epl", "spdx license identifier epl 2 0", ["spdx license identifier epl"], []),
    ("cc0", "dedicated to the public domain under cc0 1 0 universal", ["cc0 1 0"], []),
    ("cc0", "released under creative commons zero", ["creative commons zero"], []),
    ("cc0", "spdx license identifier cc0 1 0", ["spdx license identifier cc0"], []),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["free and unencumbered software"], []),
    ("unlicense", "spdx license identifier unlicense", ["spdx license identifier unlicense"], []),
    ("all-rights-reserved", "all rights reserved", ["all rights reserved"], []),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"], ["cc by nc sa", "cc by nc nd"]),
    ("cc-by-nc-sa", "licensed under cc by nc sa", ["cc by nc sa"], []),
    ("cc-by-nc-nd", "licensed under cc by nc nd", ["cc by nc nd"], []),
    ("cc-by-sa", "licensed under cc by sa", ["cc by sa"], []),
    ("cc-by-nd", "licensed under cc by nd", ["cc by nd"], []),
    ("cc-by", "licensed under cc by 4 0", ["cc by"], ["cc by nc", "cc by sa", "cc by nd"]),
    ("cc-by", "licensed under a creative commons attribution 4 0 international license", [_CC], [f"{_CC} {w}" for w in (*_NC, *_SA, *_ND)]),
    *_cc("cc-by", [], [*_NC, *_SA, *_ND]),
    *_cc("cc-by-nc", [_NC], [*_SA, *_ND]),
    *_cc("cc-by-sa", [_SA], []),
    *_cc("cc-by-nd", [_ND], []),
    *_cc("cc-by-nc-sa", [_NC, _SA], []),
    *_cc("cc-by-nc-nd", [_NC, _ND], []),
]
#: Least share of a template's weight that must stand in place; key words of a template in the index.
LEAST, POSTINGS = 0.6, 2

_SHIFT = 1 << 32


def vocabulary(templates=None) -> list[str]:
    """All words of the templates."""
    return sorted({w for _, words, _, _ in (TEMPLATES if templates is None else templates) for w in words.split()})


def key_places(words: str, keys: list[str]) -> list[tuple[int, str]]:
    """(place, word) of the words of a template's key phrases."""
    parts, out = words.split(), []
    for key in keys:
        own = key.split()
        first = next(p for p in range(len(parts)) if parts[p : p + len(own)] == own)
        out += [(first + j, x) for j, x in enumerate(own)]
    return out


def index(idf: dict[str, float], templates=None) -> dict[str, list[tuple[int, int]]]:
    """word -> (template, place), for the key words of each template that have the highest IDF."""
    out: dict[str, list[tuple[int, int]]] = {}
    for t, (_, words, keys, _) in enumerate(TEMPLATES if templates is None else templates):
        for place, word in sorted(dict(key_places(words, keys)).items(), key=lambda q: (-idf[q[1]], q[0]))[:POSTINGS]:
            out.setdefault(word, []).append((t, place))
    return out


def word_idf(docs: DataFrame, words: list[str]) -> dict[str, float]:
    """Inverse document frequency of each of the words over all docs (text); more than 0 even for a word of every text."""
    found = docs.select(F.explode(F.array_intersect(F.array(*map(F.lit, words)), words_of(plain(F.col("text"))))).alias("word"))
    n = {r["word"]: r["count"] for r in found.groupBy("word").count().collect()}
    total = docs.count()
    return {w: math.log((total + 1) / (n.get(w, 0) + 0.5)) for w in words}


def _stands(words: Column, phrase: str, at: Column) -> Column:
    parts = phrase.split()
    return F.slice(words, at + 1, len(parts)) == F.array(*map(F.lit, parts))


def base_places(words: Column, text: Column, phrase: str) -> Column:
    """First word indexes of all places of a phrase; only texts that have it are searched word by word."""
    k = len(phrase.split())
    has = F.instr(F.concat(F.lit(" "), text, F.lit(" ")), f" {phrase} ") > 0
    return F.when(has, F.filter(F.sequence(F.lit(0), F.greatest(F.size(words) - k, F.lit(0))), lambda i: _stands(words, phrase, i))).otherwise(F.array().cast("array<int>"))


def _literal(value, kind: str) -> Column:
    """A nested value as one literal, which the optimizer reads once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def _catalogue(idf: dict[str, float]) -> Column:
    """The templates as one literal: words, each word's share of the weight, whether it must stand, and the phrases that may
    not stand at key_at."""
    rows = []
    for _, words, keys, others in TEMPLATES:
        parts, must = words.split(), dict(key_places(words, keys))
        total = sum(idf[x] for x in parts)
        rows.append({"words": parts, "shares": [idf[x] / total for x in parts], "must": [p in must for p in range(len(parts))], "key_at": min(must), "others": [o.split() for o in others]})
    return _literal(rows, "array<struct<words:array<string>,shares:array<double>,must:array<boolean>,key_at:int,others:array<array<string>>>>")


def scan(docs: DataFrame, idf: dict[str, float], least: float = LEAST) -> DataFrame:
    """docs (doc_id, text) with n_words, the base phrases' places, the labels of both kinds and the score. idf has every word of
    vocabulary()."""
    df = docs.select("doc_id", plain(F.col("text")).alias("plain")).withColumn("words", words_of(F.col("plain")))
    w, rare = F.col("words"), index(idf)
    needed = {t: sum(t == u for where in rare.values() for u, _ in where) for t in range(len(TEMPLATES))}
    # every place of a word of the index, with the (template, relative position) that its postings give
    places = _literal({word: [{"t": t, "p": p} for t, p in where] for word, where in rare.items()}, "map<string,array<struct<t:int,p:int>>>")
    found = F.filter(F.transform(w, lambda x, i: F.struct(places[x].alias("where"), i.alias("i"))), lambda x: x["where"].isNotNull())
    any_rare = F.arrays_overlap(w, F.array(*map(F.lit, rare)))  # by a hash table; the others need no look at each word
    codes = F.array_sort(F.flatten(F.transform(found, lambda x: F.transform(x["where"], lambda q: q["t"] * F.lit(_SHIFT) + (x["i"] - q["p"]).cast("long") + F.lit(1 << 20)))))
    single = _literal([needed[t] == 1 for t in range(len(TEMPLATES))], "array<boolean>")
    template = lambda code: (code / F.lit(_SHIFT)).cast("int")
    df = df.withColumn("codes", F.when(any_rare, codes).otherwise(F.array().cast("array<bigint>")))
    both = F.filter("codes", lambda c, i: F.get(single, template(c)) | F.coalesce(F.get("codes", i - 1) == c, F.lit(False)))
    df = df.withColumn("candidates", F.transform(both, lambda c: F.struct(template(c).alias("t"), (c % F.lit(_SHIFT) - F.lit(1 << 20)).cast("int").alias("at"), F.get(_catalogue(idf), template(c)).alias("x"))))
    # which words of the template stand in place, and from that whether it holds
    in_place = lambda c: F.transform(c["x"]["words"], lambda word, p: F.coalesce(F.get(w, c["at"] + p) == word, F.lit(False)))
    df = df.withColumn("stands", F.transform("candidates", lambda c: F.struct(c["t"].alias("t"), c["at"].alias("at"), c["x"].alias("x"), in_place(c).alias("here"))))

    def share(c: Column) -> Column:
        held = F.aggregate(F.zip_with(c["here"], c["x"]["shares"], lambda here, s: F.when(here, s).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, s: a + s)
        keys = F.forall(F.zip_with(c["here"], c["x"]["must"], lambda here, must: here | ~must), lambda ok: ok)
        other = F.exists(c["x"]["others"], lambda o: F.slice(w, F.greatest(c["at"] + c["x"]["key_at"] + 1, F.lit(1)), F.size(o)) == o)
        return F.when(keys & ~other, held).otherwise(F.lit(0.0))

    verdicts = F.transform("stands", lambda c: F.struct(c["t"].alias("t"), share(c).alias("share")))
    df = df.withColumn("verdicts", F.filter(verdicts, lambda v: v["share"] >= least))
    for k, phrase in enumerate(BASE):
        df = df.withColumn(f"places_{k}", base_places(w, F.col("plain"), phrase))
    df = df.withColumn("places", F.concat(*(F.col(f"places_{k}") for k in range(len(BASE)))))
    base = F.array_compact(F.array(*(F.when(F.size(f"places_{k}") > 0, F.lit(label)) for k, label in enumerate(BASE.values()))))
    names = _literal([label for label, *_ in TEMPLATES], "array<string>")
    df = df.withColumn("base", base).withColumn("more", F.transform("verdicts", lambda v: F.get(names, v["t"])))
    labels = F.array_sort(F.array_distinct(F.concat("base", "more")))
    best = F.coalesce(F.array_max(F.transform("verdicts", lambda v: v["share"])), F.lit(0.0))
    return df.select(
        "doc_id", count_words(F.col("plain")).alias("n_words"), F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join(F.array_sort("base"), ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.least(F.lit(1.0), F.when(F.size("base") > 0, F.lit(1.0)).otherwise(best)).alias("score"),
    )


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs, word_idf(docs, vocabulary()))
