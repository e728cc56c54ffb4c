"""License scans by a positional index of rare licence words, in DataFrame functions only.

Licence words are the words of short public notices (templates).  Their document frequencies are counted
over all documents and weigh them.  Each template is looked up by its ``RARE`` rarest words; the order is by
weight, and no word is too frequent to be looked up, so a notice that many documents share is found as a rare one
is.  The index holds their places in the templates.  Such a word at position p of a text and q of a template
votes for the place p - q and for those up to ``SLACK`` words away, since words may be put in or left out.  A
template is met where enough of its looked-up words (``SHARE``) vote for one place; then its mandatory phrases
must stand in the text.  Its score is the share of the looked-up weight that votes for its best place.

Defined cases: null counts as empty and has no labels; ids may be null or repeat, every row is answered;
equal texts share their votes; several templates may be accepted, and the score is the best of theirs; an
empty table gives no rows; other columns are not kept.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, col, materialise, require, text_or_empty

#: Words are runs of anything but these.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases of the base rule and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Least weight of a word; words by which a template is looked up.
FLOOR, RARE = 0.05, 12
#: Percent of these words that must meet at one place, and by how many words they may be off.
SHARE, SLACK = 75, 2


@dataclass(frozen=True)
class Template:
    """A notice, lower case, words parted by single spaces."""

    name: str
    label: str
    text: str
    mandatory: tuple[str, ...]


#: Openings of public licence texts and the usual one-line notices.
TEMPLATES = (
    Template("agpl", "agpl", "licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    Template("apache", "apache", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("bsd", "bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that "
             "the following conditions are met", ("redistribution and use in source and binary forms",)),
    Template("cc0", "cc0", "the person who associated a work with this deed has dedicated the work to the public domain", ("dedicated the work to the public domain",)),
    Template("cc-by", "cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-long", "cc-by", "licensed under the creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    Template("cc-by-nc", "cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    Template("cc-by-sa", "cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    Template("gpl", "gpl", "licensed under the gnu general public license version 3", ("gnu general public license",)),
    Template("gpl-long", "gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
             "public license as published by the free software foundation", ("terms of the gnu general public license",)),
    Template("isc", "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby "
             "granted", ("permission to use copy modify and or distribute this software",)),
    Template("lgpl", "lgpl", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license",)),
    Template("mit", "mit", "released under the mit license", ("mit license",)),
    Template("mit-long", "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
             "documentation files", ("permission is hereby granted free of charge",)),
    Template("mpl", "mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    Template("unlicense", "unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def with_words(docs: DataFrame, text: str) -> DataFrame:
    """Adds ``__words``, the word array of the whole text."""
    return docs.withColumn("__words", F.array_remove(F.split(ascii_lower(text_or_empty(text)), NOT_WORD), ""))


def rarity(docs: DataFrame, text: str, templates: Sequence[Template]) -> dict[str, float]:
    """Inverse document frequency of each licence word, at least ``FLOOR``.

    The driver gets one count per word of the templates."""
    vocabulary = sorted({w for t in templates for w in t.text.split()})
    seen = with_words(docs, text).select(F.explode(F.array_append(F.array_intersect(_strings(vocabulary), "__words"), F.lit(""))).alias("w"))
    counts = {r["w"]: r["n"] for r in seen.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    n = counts.get("", 0)  # every text has the empty mark
    return {w: max(FLOOR, math.log((1 + n) / (1 + counts.get(w, 0)))) for w in vocabulary}


def looked_up(weight: dict[str, float], templates: Sequence[Template]) -> dict[str, list[str]]:
    """The rarest words of each template; of equal weights, the first in the alphabet."""
    return {t.name: sorted(set(t.text.split()), key=lambda w: (-weight[w], w))[:RARE] for t in templates}


def _need(words: Sequence[str]) -> int:
    """How many of the words by which a template is looked up must meet."""
    return -(-SHARE * len(words) // 100)


def _phrase_places() -> Column:
    """Starts (words from 0) of every place of a base phrase; each phrase ends with the word "license"."""
    tests = []
    for phrase in BASE:
        words = phrase.split()
        tests.append((len(words) - 1, " AND ".join(f"get(__words, i - {len(words) - 1 - j}) = '{w}'" for j, w in enumerate(words))))
    start = "CASE " + " ".join(f"WHEN {test} THEN i - {back}" for back, test in tests) + " END"
    return F.expr(f"filter(transform(filter(sequence(0, size(__words) - 1), i -> get(__words, i) = 'license'), i -> {start}), i -> i IS NOT NULL)")


def scan_words(docs: DataFrame, doc_id: str, text: str, templates: Sequence[Template], rare: dict[str, list[str]]) -> DataFrame:
    """One small row per document: id, __key, n_words, places, base_found, verified (templates whose mandatory phrases
    stand in the text), asked (templates of whose ``rare`` words the text holds enough, wherever), hits (word, pos) of
    all rare words of texts for which a template is asked."""
    sought = sorted({w for words in rare.values() for w in words})
    words = with_words(docs.select(col(doc_id).alias("__id"), col(text)), text)
    joined = words.select("__id", F.xxhash64(text_or_empty(text)).alias("__key"), "__words",
                          F.concat(F.lit(" "), F.array_join("__words", " "), F.lit(" ")).alias("__line"))
    none = F.array().cast("array<int>")
    places = F.when(F.contains("__line", F.lit(" license ")), _phrase_places()).otherwise(none)
    has = lambda phrase: F.contains("__line", F.lit(f" {phrase} "))
    base = [F.when(has(phrase), F.lit(label)) for phrase, label in BASE.items()]
    verified = []
    for t in templates:
        test = F.lit(True)
        for phrase in t.mandatory:
            test = test & has(phrase)
        verified.append(F.when(test, F.lit(t.name)))
    out = joined.select("__id", "__key", F.size("__words").cast("long").alias("n_words"), places.alias("places"),
                        F.array_compact(F.array(*base)).alias("base_found"),
                        (F.array_compact(F.array(*verified)) if verified else _strings(())).alias("verified"), "__words",
                        F.array_intersect("__words", _strings(sought)).alias("__has"))
    asked = [F.when(F.size(F.array_intersect("__has", _strings(words))) >= _need(words), F.lit(name)) for name, words in rare.items()]
    out = out.withColumn("asked", F.array_compact(F.array(*asked)) if asked else _strings(()))
    hits = F.filter(F.transform("__words", lambda w, i: F.struct(w.alias("word"), i.alias("pos"))), lambda x: x["word"].isin(*sought))
    return out.withColumn("hits", F.when(F.size("asked") > 0, hits)).drop("__words", "__has")


def met(rows: DataFrame, weight: dict[str, float], templates: Sequence[Template]) -> DataFrame:
    """(__key, name, label, score) of the templates that are met somewhere in a text.

    The index is a fixed table (``RARE`` words a template), so it may go to every task.  Votes for a place are the bits
    of one number; those of a text come from one task and meet before the shuffle."""
    spark = rows.sparkSession
    rare = looked_up(weight, templates)
    index = spark.createDataFrame([(w, t.name, rare[t.name].index(w), q) for t in templates for q, w in enumerate(t.text.split()) if w in rare[t.name]],
                                  "word string, name string, bit int, q int")
    table = spark.createDataFrame([(t.name, t.label, [weight[w] for w in rare[t.name]], _need(rare[t.name])) for t in templates],
                                  "name string, label string, weights array<double>, need int")
    votes = (rows.select("__key", "asked", F.explode("hits").alias("hit")).select("__key", "asked", "hit.word", "hit.pos")
             .join(F.broadcast(index), "word").filter(F.array_contains("asked", F.col("name")))
             .select("__key", "name", F.expr("shiftleft(1, bit)").alias("vote"),
                     F.explode(F.expr(f"sequence(pos - q - {SLACK}, pos - q + {SLACK})")).alias("at")))
    places = votes.groupBy("__key", "name", "at").agg(F.bit_or("vote").alias("votes")).join(F.broadcast(table), "name")
    share = F.expr("aggregate(transform(weights, (w, k) -> w * (shiftright(votes, k) % 2)), 0D, (a, x) -> a + x) / aggregate(weights, 0D, (a, x) -> a + x)")
    return (places.filter(F.bit_count("votes") >= F.col("need"))
            .groupBy("__key", "name", "label").agg(F.max(F.least(F.lit(1.0), share)).alias("score")))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Sequence[Template] = TEMPLATES) -> DataFrame:
    """(id, n_words, n_base, first_word, last_word, base_labels, labels, score) for every document."""
    require(docs, [doc_id, text])
    weight = rarity(docs, text, templates)
    rows = materialise(scan_words(docs, doc_id, text, templates, looked_up(weight, templates)))
    found = met(rows, weight, templates).groupBy("__key").agg(F.collect_list(F.struct("name", "label", "score")).alias("met"))
    join = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    accepted = F.filter(F.coalesce("met", F.array()), lambda m: F.array_contains("verified", m["name"]))
    return rows.drop("asked", "hits").join(found, "__key", "left").withColumn("accepted", accepted).select(
        F.col("__id").alias(doc_id), "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        join("base_found").alias("base_labels"), join(F.concat("base_found", F.col("accepted.label"))).alias("labels"),
        F.coalesce(F.array_max("accepted.score"), F.lit(0.0)).alias("score"))
