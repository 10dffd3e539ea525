"""License scans: an exact set-similarity join of text blocks with license templates.

A document's words are cut into blocks of ``2 w`` words that start every ``w`` words,
one ladder of blocks for each template width ``w`` (the power of two that holds the
template's words), so every passage as long as a template lies whole in a block.
A block matches a template if it holds at least ``threshold`` of the template's
distinct words: ``need`` of them. All such pairs are found, none are sampled:

* words outside every template cannot count, and are dropped from the blocks;
* the others are ordered by how many documents hold them, rarest first;
* prefix: a template of ``m`` words and a block that share ``need`` of them share one
  of the template's first ``m - need + 1`` and of the block's first
  ``size - need + 1`` words, so they meet in a join on these words only;
* length: a block of fewer than ``need`` template words meets nothing;
* position: the first shared word at places ``i`` and ``j`` leaves at most
  ``1 + min(m - 1 - i, size - 1 - j)`` shared words, which must reach ``need``;
* a pair is verified where it meets at its first shared word, so once.

Fixed phrases are found besides, as runs of consecutive words. Documents without a
word of any template's prefix take no part in the join. Matches are combined by
text (two 64-bit hashes), label and task before they move, so thousands of copies
of a text arrive as a few rows. Built-in functions only.

The templates are a parameter; their ``MOST`` distinct words at most are all that is
broadcast or held by the driver. Null texts are empty texts: no words, no labels,
score 0. Repeated rows give repeated rows, null keys stay null; other columns of
any name are ignored. Templates that tie are all named; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, functions as F

from wardwise.sources.tables import settle

#: fixed by the contract: label of every place of these words in a row
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: fixed: the usual wording of public licenses and of statements that name them
TEMPLATES = [
    ("mit", "released under the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated"
        " documentation files the software to deal in the software without restriction",
    ),
    ("apache-2", "licensed under the apache license version 2 0"),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance"
        " with the license you may obtain a copy of the license at",
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    (
        "gpl-3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general"
        " public license as published by the free software foundation either version 3 of the license",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided"
        " that the following conditions are met",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is"
        " hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was"
        " not distributed with this file you can obtain one at",
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

THRESHOLD = 0.85
MOST = 10_000
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_WIDTH = 8


@dataclass(frozen=True)
class Template:
    number: int
    label: str
    ranked: tuple[tuple[int, str], ...]  # distinct words with the rows that hold them, rarest first
    need: int
    width: int

    @property
    def words(self) -> list[str]:
        return [w for _, w in self.ranked]

    @property
    def prefix(self) -> list[str]:
        return self.words[: len(self.words) - self.need + 1]


def words_of(text: Column) -> Column:
    """Runs of digits, lower-cased letters and characters beyond ASCII."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    return F.filter(F.split(lowered, BETWEEN), lambda w: w != "")


def _listed(words) -> Column:
    return F.array(*[F.lit(w) for w in words])


def by_frequency(docs: DataFrame, templates, threshold: float) -> list[Template]:
    """Templates, their distinct words ordered by how many rows of ``docs`` hold them."""
    split = [(label, text.split()) for label, text in templates]
    vocabulary = sorted({w for _, words in split for w in words})
    if len(vocabulary) > MOST:
        raise ValueError(f"templates hold {len(vocabulary)} distinct words, at most {MOST} are allowed")
    held = docs.select(F.explode(F.array_intersect(_listed(vocabulary), "words")).alias("word"))
    counts = {r.word: r.n for r in held.groupBy("word").agg(F.count("*").alias("n")).collect()}  # at most MOST rows
    out = []
    for number, (label, words) in enumerate(split):
        distinct = tuple(sorted({(counts.get(w, 0), w) for w in words}))
        need = max(1, math.ceil(threshold * len(distinct)))
        out.append(Template(number, label, distinct, need, max(LEAST_WIDTH, 1 << (len(words) - 1).bit_length())))
    return out


def blocks(docs: DataFrame, width: int) -> DataFrame:
    """(h0, h1, words): blocks of ``2 width`` words, one every ``width``."""
    last = F.greatest(F.ceil(F.size("words") / width).cast("int") - 2, F.lit(0))
    start = F.explode(F.sequence(F.lit(0), last))
    return docs.select("h0", "h1", "words", start.alias("_b")).select(
        "h0", "h1", F.slice("words", F.col("_b") * width + 1, 2 * width).alias("words")
    )


def matches(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """(h0, h1, label, score): the largest share of a template of the label that a block of the text holds."""
    found = None
    for width in sorted({t.width for t in templates}):
        some = [t for t in templates if t.width == width]
        index = docs.sparkSession.createDataFrame(
            [(w, i, t.label, len(t.words), t.need, t.words) for t in some for i, w in enumerate(t.prefix)],
            "word string, i int, label string, m int, need int, template array<string>",
        )
        order = [w for _, w in sorted({w for t in some for w in t.ranked})]
        least, starts = min(t.need for t in some), sorted({w for t in some for w in t.prefix})
        cut = blocks(docs.where(F.arrays_overlap("words", _listed(starts))), width)
        held = cut.select("h0", "h1", F.array_intersect(_listed(order), "words").alias("held"))  # keeps this order
        size = F.size("held")
        placed = held.where(size >= least).select(
            "h0", "h1", "held", F.posexplode(F.slice("held", 1, size - least + 1)).alias("j", "word")
        )
        met = placed.join(F.broadcast(index), "word").where(
            (size >= F.col("need")) & (F.least(F.col("m") - F.col("i"), size - F.col("j")) >= F.col("need"))
        )
        shared = met.withColumn("shared", F.array_intersect("held", "template"))
        alike = shared.where((F.get("shared", F.lit(0)) == F.col("word")) & (F.size("shared") >= F.col("need")))
        part = alike.select("h0", "h1", "label", (F.size("shared") / F.col("m")).alias("score"))
        found = part if found is None else found.unionAll(part)
    return found.groupBy("h0", "h1", "label").agg(F.max("score").alias("score"))


def _places(words: Column, phrase: str) -> Column:
    """Numbers of the words at which the phrase's words stand in a row."""
    wanted = phrase.split()
    here = F.filter(
        F.sequence(F.lit(0), F.size(words) - len(wanted)),
        lambda i: reduce(and_, [F.get(words, i + k) == w for k, w in enumerate(wanted)]),
    )
    could = reduce(and_, [F.array_contains(words, w) for w in sorted(wanted, key=len, reverse=True)])
    return F.when((F.size(words) >= len(wanted)) & could, here).otherwise(F.array().cast("array<int>"))


def _known(df: DataFrame, column: str, *keys: str) -> DataFrame:
    """(*keys, words, h0, h1): two hashes stand for the text."""
    text = F.coalesce(F.col(column), F.lit(""))
    return df.select(*keys, words_of(F.col(column)).alias("words"), F.xxhash64(text).alias("h0"), F.xxhash64(F.lit(11), text).alias("h1"))


def scan(
    df: DataFrame, templates=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD,
    key: str = "doc_id", column: str = "text",
) -> DataFrame:
    """(key, n_words, places, base, labels, score) of every row.

    ``places``: word numbers of all phrases, ``base``: their labels, ``labels``: those
    and the labels of templates found, ``score``: 1 where a phrase stands, or else the
    largest share of a template found; 0 without any.
    """
    docs = _known(df, column)
    found = matches(docs, by_frequency(docs, templates, threshold))
    of_text = settle(found.groupBy("h0", "h1").agg(F.collect_set("label").alias("_l"), F.max("score").alias("_s")))
    of_text = of_text.select(F.col("h0").alias("_h0"), F.col("h1").alias("_h1"), "_l", "_s")
    words, none = F.col("words"), F.array().cast("array<string>")
    rows = _known(df.select(F.col(key).alias("_key"), column), column, "_key").select(
        "_key", "h0", "h1", F.size(words).cast("long").alias("n_words"), *[_places(words, p).alias(f"_p{i}") for i, p in enumerate(phrases)]
    )
    places = [F.col(f"_p{i}") for i in range(len(phrases))]
    base = F.concat(none, *[F.when(F.size(p) > 0, F.array(F.lit(label))).otherwise(none) for p, label in zip(places, phrases.values())])
    rows = rows.select(
        "_key", "h0", "h1", "n_words", F.array_sort(F.concat(F.array().cast("array<int>"), *places)).alias("places"),
        F.array_sort(F.array_distinct(base)).alias("base"),
    )
    joined = rows.join(of_text, (F.col("h0") == F.col("_h0")) & (F.col("h1") == F.col("_h1")), "left")
    score = F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.coalesce("_s", F.lit(0.0)))
    return joined.select(
        F.col("_key").alias(key), "n_words", "places", "base",
        F.array_sort(F.array_union("base", F.coalesce("_l", none))).alias("labels"), score.alias("score"),
    )


def digests(df: DataFrame, **settings) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row."""
    return scan(df, **settings).select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"),
        F.array_min("places").cast("long").alias("first_word"), F.array_max("places").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )


def _oracle() -> str:
    """The same rows for DuckDB: every block against every template, without a filter."""
    quoted = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"
    listed = []
    for label, text in TEMPLATES:
        words = text.split()
        width = max(LEAST_WIDTH, 1 << (len(words) - 1).bit_length())
        distinct = sorted(set(words))
        listed.append(f"('{label}', {quoted(distinct)}, {math.ceil(THRESHOLD * len(distinct))}, {width})")
    places = " || ".join(
        f"list_transform(list_filter(range(n_words), lambda i: words[i + 1 : i + {len(p.split())}] = {quoted(p.split())}), lambda i: {{'at': i, 'label': '{label}'}})"
        for p, label in PHRASES.items()
    )
    return f"""
with w as (
  select row_number() over () as r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as words
  from documents
), d as materialized (select *, len(words)::bigint as n_words from w),
t(label, template, need, width) as (values {", ".join(listed)}),
b as (
  select r, width, list_distinct(words[s + 1 : s + 2 * width]) as held
  from (select r, words, width, unnest(range(0, greatest(n_words - width, 1), width)) as s from d, (select distinct width from t))
), m as (
  select r, label, max(len(list_intersect(held, template)) / len(template)) as score
  from b join t using (width) where len(list_intersect(held, template)) >= need group by r, label
), f as (select r, list(label) as found, max(score) as score from m group by r),
p as (select r, doc_id, n_words, {places} as places from d),
q as (
  select *, list_transform(places, lambda x: x.at) as starts, list_distinct(list_transform(places, lambda x: x.label)) as base from p
)
select doc_id, n_words, len(places)::bigint as n_base, list_min(starts)::bigint as first_word, list_max(starts)::bigint as last_word,
  coalesce(array_to_string(list_sort(base), ','), '') as base_labels,
  coalesce(array_to_string(list_sort(list_distinct(base || coalesce(found, []::varchar[]))), ','), '') as labels,
  case when len(base) > 0 then 1.0::double else coalesce(f.score, 0)::double end as score
from q left join f using (r)
"""


ORACLE = _oracle()
