"""License scans: an exact set-similarity join of text blocks with license templates.

Words are ordered by how many documents of the corpus have them, rarest first. A
block can hold a share ``THRESHOLD`` of a template's distinct words only if it has
one of the template's first few words in that order (prefix filter), has enough
distinct template words at all (length filter), and enough of them from its first
match onwards (positional filter). What passes is counted exactly.

Templates are few and fixed, so their index is part of the expression: one pass
over the corpus for the order, one for the join, no shuffle of blocks, and no
Python in either.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from revana.llm.fingerprints import let

# Phrases with their labels, and the wording of well-known notices.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
TEMPLATES = {
    "agpl": "you can redistribute it and or modify it under the terms of the gnu affero general public license",
    "apache": "licensed under the apache license version 2 0 you may not use this file except in compliance with the license",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-sa": "licensed under the creative commons attribution share alike license",
    "gpl": "this work is licensed under the gnu general public license version 3",
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software",
    "mpl": "this source code form is subject to the terms of the mozilla public license v 2 0",
}
THRESHOLD = 0.8
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
STRIDE = 24                 # no template is longer, so every copy lies inside one block
WIDTH = 2 * STRIDE


def needed(size: int, threshold: float = THRESHOLD) -> int:
    """Smallest overlap that is at least ``threshold`` of ``size`` words."""
    return math.ceil(size * threshold - 1e-9)


def words_of(text: Column) -> Column:
    """Lower-cased words; null is empty. Lower-casing letters outside A-Z as well
    changes neither where words end nor which words equal a phrase's."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def _array(words) -> Column:
    return F.array(*(F.lit(w) for w in words)) if words else F.array().cast("array<string>")


def word_order(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None) -> list[str]:
    """Template words by the number of documents that have them, rarest first,
    ties by word. Counted over all of ``docs``; only these words are collected."""
    vocabulary = sorted({w for t in (TEMPLATES if templates is None else templates).values() for w in t.split()})
    counts = (docs.select(F.explode(F.array_intersect(_array(vocabulary), words_of(F.col(text)))).alias("w"))
              .groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect())
    n = {r.w: r["n"] for r in counts}
    return sorted(vocabulary, key=lambda w: (n.get(w, 0), w))


def _phrase_places(words: Column) -> Column:
    """array<struct<start, label>> of all places where a phrase stands."""
    at = F.sequence(F.lit(0), F.size(words) - 1)
    found = [F.transform(
        F.filter(at, _stands(words, phrase.split())),
        _place(label))
        for phrase, label in PHRASES.items()]
    return F.flatten(F.array(*found))


def _stands(words: Column, phrase: list[str]):
    return lambda i: _all([F.get(words, i + k) == w for k, w in enumerate(phrase)])


def _place(label: str):
    return lambda i: F.struct(i.cast("long").alias("start"), F.lit(label).alias("label"))


def _all(conditions: list[Column]) -> Column:
    whole = F.coalesce(conditions[0], F.lit(False))
    for c in conditions[1:]:
        whole = whole & F.coalesce(c, F.lit(False))
    return whole


def _block_matches(words: Column, order: list[str], templates: dict[str, str], threshold: float) -> Column:
    """array<struct<label, start, containment>> of the blocks that meet a template."""
    rank = {w: i for i, w in enumerate(order)}
    plans = []
    for label, text in sorted(templates.items()):
        own = sorted(set(text.split()), key=rank.__getitem__)
        least = needed(len(own), threshold)
        plans.append((label, own, least, own[:len(own) - least + 1]))
    starters = sorted({w for *_, prefix in plans for w in prefix})

    def of_block(start: Column) -> Column:
        def against(block: Column) -> Column:       # the block's template words, rarest first
            out = []
            for label, own, least, prefix in plans:
                hits = F.array_intersect(_array(prefix), block)
                later = F.size(block) - F.array_position(block, F.get(hits, F.lit(0))) + 1
                possible = (F.size(block) >= least) & (F.size(hits) > 0) & (later >= least)
                overlap = F.when(possible, F.size(F.array_intersect(_array(own), block))).otherwise(F.lit(0))
                out.append(F.struct(F.lit(label).alias("label"), start.cast("long").alias("start"),
                                    (overlap / len(own)).alias("containment"), (overlap >= least).alias("met")))
            return F.filter(F.array(*out), lambda m: m["met"])
        block = F.slice(words, start + 1, WIDTH)
        # No starter in the block: nothing can match, and nothing is compared.
        return F.when(F.arrays_overlap(_array(starters), block),
                      let(F.array_intersect(_array(order), block), against))

    starts = F.sequence(F.lit(0), F.size(words) - 1, F.lit(STRIDE))
    return F.when(F.arrays_overlap(_array(starters), words),
                  F.flatten(F.filter(F.transform(starts, of_block), lambda m: m.isNotNull())))


def scan_licenses(docs: DataFrame, text: str = "text", templates: dict[str, str] | None = None,
                  threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with n_words, places array<struct<start, label>> of the phrases and
    matches array<struct<label, start, containment, met>> of the template blocks.

    Null and empty texts have no words, places or matches. A block that meets
    several templates is reported for each; overlapping blocks are reported each.
    """
    templates = TEMPLATES if templates is None else templates
    order = word_order(docs, text, templates)
    starts = r"(?i)cc[^0-9a-z]+by|general[^0-9a-z]+public|all[^0-9a-z]+rights"
    maybe = F.col(text).rlike(starts)
    scanned = let(words_of(F.col(text)), lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"),
        F.when(F.size(w) > 0, _block_matches(w, order, templates, threshold)).alias("matches"),
        F.when(maybe & (F.size(w) > 0), _phrase_places(w)).alias("places")))
    kept = [c for c in docs.columns if c not in ("n_words", "places", "matches")]
    return docs.select(*kept, scanned.alias("_s")).select(
        *kept, "_s.n_words", "_s.places", "_s.matches")


def summarise(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row per document: counts, first and last place, labels and score (the
    highest containment met; 1 where a phrase stands; else 0)."""
    places, matches = F.col("places"), F.col("matches")
    empty = F.array().cast("array<string>")
    base = F.array_sort(F.array_distinct(F.coalesce(F.transform(places, lambda p: p["label"]), empty)))
    more = F.coalesce(F.transform(matches, lambda m: m["label"]), empty)
    starts = F.transform(places, lambda p: p["start"])
    best = F.coalesce(F.array_max(F.transform(matches, lambda m: m["containment"])), F.lit(0.0))
    n = F.coalesce(F.size(places), F.lit(0))
    n = F.when(places.isNull(), F.lit(0)).otherwise(n).cast("long")
    return scanned.select(
        id_col, "n_words", n.alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, more)), ",").alias("labels"),
        F.when(n > 0, F.lit(1.0)).otherwise(best).alias("score"))
