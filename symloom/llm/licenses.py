"""License scan: an exact set-similarity join of text blocks with license templates, in DataFrame functions only."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of letters, digits and all beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Template:
    """A license text. A block matches when it holds ``least`` of the template's distinct words.

    Of a ``phrase`` the words must also stand consecutively, in this order.
    """

    label: str
    text: str
    least: float = 0.8
    phrase: bool = False


# The phrases of the contract.
PHRASES = [
    Template("mit", "mit license", 1.0, True),
    Template("apache", "apache license", 1.0, True),
    Template("gpl", "general public license", 1.0, True),
]

# Opening sentences and short notices of common licenses. Short ones must be whole.
NOTICES = [
    Template("all-rights-reserved", "all rights reserved", 1.0),
    Template("apache", "licensed under the apache license version 2.0 you may not use this file except in compliance with the license"),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    Template("cc-by", "licensed under a creative commons attribution 4.0 international license"),
    Template("cc-by-nc", "licensed under cc by nc 4.0", 1.0),
    Template("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    Template("mpl", "this source code form is subject to the terms of the mozilla public license v 2.0"),
    Template("unlicense", "this is free and unencumbered software released into the public domain"),
]


def words_of(text: Column) -> Column:
    """The words of a text with A-Z lowered; a null text has none."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(WORD), F.lit(0))


def template_words(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(UPPER, LOWER)))


def block_step(template: Template) -> int:
    """Half a block: the power of two that is no less than the template's number of words."""
    return 1 << max(0, len(template_words(template.text)) - 1).bit_length()


def word_order(docs: DataFrame, templates: list[Template], text_col: str = "text") -> list[str]:
    """All words of the templates, by how often all documents hold them, rarest first; ties by the word.

    A word of no template adds nothing to any overlap, so blocks are compared by these words only. The
    driver gets one row per word of the templates.
    """
    every = sorted({w for t in templates for w in template_words(t.text)})
    if not every:
        return []
    found = docs.select(F.explode(words_of(F.col(text_col))).alias("word")).where(F.col("word").isin(every))
    counts = {r["word"]: r["count"] for r in found.groupBy("word").count().collect()}
    return sorted(every, key=lambda w: (counts.get(w, 0), w))


def _literal_words(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words]) if words else F.array().cast("array<string>")


def template_prefixes(templates: list[Template], order: list[str]) -> list[Column]:
    """A row for each word in a template's prefix: with at least ``need`` common words, the rarest common one is among
    the first ``n - need + 1`` of its n words."""
    rank = {w: k for k, w in enumerate(order)}
    rows = []
    for number, template in enumerate(templates):
        words = template_words(template.text)
        ordered = sorted(set(words), key=rank.__getitem__)
        need = max(1, math.ceil(template.least * len(ordered) - 1e-9))
        for place, word in enumerate(ordered[: len(ordered) - need + 1]):
            rows.append(
                F.struct(
                    F.lit(word).alias("word"), F.lit(block_step(template)).alias("step"), F.lit(place).alias("place"),
                    F.lit(need).alias("need"), F.lit(number).alias("template"), F.lit(template.label).alias("label"),
                    _literal_words(ordered).alias("ordered"), _literal_words(words if template.phrase else []).alias("phrase"),
                )
            )
    return rows


def matching_blocks(docs: DataFrame, templates: list[Template], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The join: documents and their blocks that meet a template's threshold.

    ``(row, id, n_words, template, label, block, step, words, overlap, containment, places)``: one row per document,
    template and matching block, and one without a template for a document that has none. Block k of step s are
    the words from k * s on, 2 * s of them, so that every run of s words lies in a block; templates
    of up to s words are looked for in such blocks. ``places`` are the word numbers in the first half of the block where
    a phrase stands; other templates have none there.

    Prefix filter: only blocks that hold a word of a template's prefix become candidates. Length filter: a block
    holds at least ``need`` of the templates' words. Positional filter: with their first common word at these places
    of both orders, enough words are left on either side. Candidates that pass are verified by their whole
    intersection. Everything happens in the document's row; what is broadcast is as large as the templates.
    """
    order = word_order(docs, templates, text_col)
    rows = template_prefixes(templates, order)
    first_words = sorted({w for t in templates for w in template_words(t.text)})
    steps = sorted({block_step(t) for t in templates if template_words(t.text)})
    worded = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("w")
    )
    pair = "struct<word:string,step:int,block:int,words:array<string>>"
    if not rows:
        pairs = F.array().cast(f"array<{pair}>")
        rows = [F.lit(None).cast("struct<word:string,step:int,place:int,need:int,template:int,label:string,ordered:array<string>,phrase:array<string>>")]
    else:
        first_words = sorted({w for t in templates for w in _prefix_words(t, order)})
        hits = F.filter(
            F.transform("w", lambda x, at: F.struct(x.alias("word"), at.alias("at"))), lambda h: h["word"].isin(first_words)
        )

        def blocks_of(hit: Column) -> Column:
            both = [
                F.struct(hit["word"].alias("word"), F.lit(step).alias("step"), (F.floor(hit["at"] / step).cast("int") - back).alias("block"))
                for step in steps
                for back in (0, 1)
            ]
            return F.filter(F.array(*both), lambda b: b["block"] >= 0)

        distinct = F.array_distinct(F.flatten(F.transform(hits, blocks_of)))
        cut = F.transform(
            distinct,
            lambda b: F.struct(
                b["word"].alias("word"), b["step"].alias("step"), b["block"].alias("block"),
                F.slice("w", b["block"] * b["step"] + 1, 2 * b["step"]).alias("words"),
            ),
        )
        pairs = F.when(F.arrays_overlap("w", _literal_words(first_words)), cut).otherwise(F.array().cast(f"array<{pair}>"))
    candidates = worded.select(
        "row", "id", F.size("w").cast("long").alias("n_words"), F.explode_outer(pairs).alias("pair")
    ).select("row", "id", "n_words", "pair.*")
    prefixes = docs.sparkSession.range(1).select(F.inline(F.array(*rows)))
    joined = candidates.join(F.broadcast(prefixes), ["word", "step"], "left")

    common = F.array_intersect("ordered", "words")
    known = F.array_intersect(_literal_words(order), F.col("words"))
    left_in_template = F.size("ordered") - F.col("place") - 1
    left_in_block = F.size(known) - F.array_position(known, F.col("word"))
    meets = (
        (F.size(known) >= F.col("need"))
        & (F.least(left_in_template, left_in_block) + 1 >= F.col("need"))
        & (F.get(common, F.lit(0)) == F.col("word"))
        & (F.size(common) >= F.col("need"))
    )
    size = F.size("phrase")
    inside = F.sequence(F.lit(0), F.col("step") - 1)
    stands = F.filter(inside, lambda i: F.slice("words", i + 1, size) == F.col("phrase"))
    start = F.col("block").cast("long") * F.col("step")
    places = F.when(size > 0, F.transform(stands, lambda i: start + i))
    matched = F.coalesce(meets, F.lit(False))
    names = ["template", "label", "block", "step", "words"]
    return joined.select(
        "row", "id", "n_words", *[F.when(matched, F.col(c)).alias(c) for c in names],
        F.when(matched, F.size(common)).alias("overlap"),
        F.when(matched, F.size(common) / F.size("ordered")).alias("containment"),
        F.when(matched, places).alias("places"),
    )


def _prefix_words(template: Template, order: list[str]) -> list[str]:
    """The words that the template's prefix holds under this order."""
    own = set(template_words(template.text))
    ordered = [w for w in order if w in own]
    need = max(1, math.ceil(template.least * len(ordered) - 1e-9))
    return ordered[: len(ordered) - need + 1]


def license_scan(
    docs: DataFrame, templates: list[Template] | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id, n_words, n_base, first_word, last_word, base_labels, labels, score)``, one row per document.

    ``n_base`` counts the places where the words of a phrase stand consecutively, ``first_word`` and ``last_word`` are the
    smallest and the largest of them (null without any). ``base_labels`` come from phrases, ``labels`` from
    all templates; both are sorted arrays. ``score`` is the largest containment of a template that gave a label, else 0.

    A null or empty text has no words. Every row is a document of its own, also with an equal or null id. An
    empty table gives no rows. Other columns are ignored, whatever their names. A very long text becomes one
    array of words in its row; each block that is a candidate moves alone.
    """
    found = matching_blocks(docs, [*PHRASES, *NOTICES] if templates is None else templates, id_col, text_col)
    is_base = F.size("places") > 0
    counts = F.col("label").isNotNull() & (F.col("places").isNull() | is_base)
    grouped = found.groupBy("row").agg(
        F.first("id").alias("id"),
        F.max("n_words").alias("n_words"),
        F.coalesce(F.sum(F.when(is_base, F.size("places"))), F.lit(0)).cast("long").alias("n_base"),
        F.min(F.when(is_base, F.array_min("places"))).alias("first_word"),
        F.max(F.when(is_base, F.array_max("places"))).alias("last_word"),
        F.sort_array(F.collect_set(F.when(is_base, F.col("label")))).alias("base_labels"),
        F.sort_array(F.collect_set(F.when(counts, F.col("label")))).alias("labels"),
        F.coalesce(F.max(F.when(counts, F.col("containment"))), F.lit(0.0)).alias("score"),
    )
    return grouped.drop("row")
