"""License scans as an exact set-similarity join, in DataFrame operations only.

Templates of up to 32 words are looked for in blocks of 64 words, a new one every 32, so every passage of their length
lies in a block whole; longer templates, whole licence texts among them, in blocks of their own, as long as the next power of two asks for. A block
matches a template when it holds at least `CONTAINMENT` of the template's distinct words.
The words of all templates are counted over the whole corpus and put in order of that frequency, the rarest
first; words outside the templates' vocabulary can add to no overlap and are left out of the sets.

* prefix filter: with n template words of which `need` must be shared, one of the n - need + 1 rarest must be;
  only blocks that hold such a word are made into rows;
* length filter: a block with fewer than `need` vocabulary words cannot match;
* positional filter: what follows a shared word in the two orders must be enough for `need`.

What passes is verified by intersecting the sets. Blocks are built inside their document's row, so only matches are shuffled, and
the templates are parameters (`NOTICES` unless others are given), which bounds all that is broadcast.

The three base phrases are templates too. Their places are found in the matched blocks word by word, each place in
the block in whose first half it starts. The other templates add labels of their own.

Defined results: null and empty texts have no words, no labels and score 0; rows that repeat an id and
a text have equal results; the score is the largest containment found, 0 when no template matches; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import alnum_words, filled, row_key, stored

#: Least part of a template's distinct words that a block holds.
CONTAINMENT = 0.8
#: Words between the starts of blocks, at least; a block is twice as long.
STEP = 32

#: Base phrases and their labels.
PHRASES = {"mit": "mit license", "apache": "apache license", "gpl": "general public license"}

#: Notices with the labels they add.
NOTICES = {
    "apache-2.0": "licensed under the apache license version 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "gpl-3.0": "this work is licensed under the gnu general public license version 3",
    "gpl-grant": "you can redistribute it and or modify it under the terms of the gnu general public license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
    "mit-notice": "released under the mit license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "reserved": "all rights reserved",
}


Template = tuple[str, str, list[str]]


def plain_words(text: str) -> list[str]:
    """The words of a text, as the scan takes them."""
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def templates(notices: Mapping[str, str] = NOTICES) -> list[Template]:
    """(kind, label, words) of every template that has words: the base phrases and the notices."""
    found = [("base", k, plain_words(v)) for k, v in PHRASES.items()] + [("notice", k, plain_words(v)) for k, v in notices.items()]
    return [t for t in found if t[2]]


def step_of(words: list[str]) -> int:
    """Words between the blocks in which a template is looked for."""
    return max(STEP, 1 << (len(words) - 1).bit_length())


def _need(n: int) -> int:
    return math.ceil(CONTAINMENT * n - 1e-9)


def _vocabulary(docs: DataFrame, found: list[Template]) -> list[str]:
    """The templates' words, the rarest in the corpus first."""
    words = sorted({w for _, _, t in found for w in t})
    counts = docs.select(F.explode(alnum_words(filled("text"))).alias("word")).where(F.col("word").isin(words))
    often = {r["word"]: r["count"] for r in counts.groupBy("word").count().collect()}  # at most one row per template word
    return sorted(words, key=lambda w: (often.get(w, 0), w))


def _strings(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def _template_table(spark: SparkSession, found: list[Template], order: list[str]) -> DataFrame:
    """(step, token, i, n, need, kind, label, phrase, tokens): one row per prefix token of each template."""
    rank = {w: i for i, w in enumerate(order)}
    rows = []
    for kind, label, words in found:
        tokens = sorted(set(words), key=rank.__getitem__)
        n, need = len(tokens), _need(len(tokens))
        for i, token in enumerate(tokens[: n - need + 1]):
            rows.append(F.struct(F.lit(step_of(words)).alias("step"), F.lit(token).alias("token"), F.lit(i).alias("i"), F.lit(n).alias("n"), F.lit(need).alias("need"), F.lit(kind).alias("kind"), F.lit(label).alias("label"), _strings(words).alias("phrase"), _strings(tokens).alias("template")))
    return spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*")


def _blocks(docs: DataFrame, order: list[str], prefixes: dict[int, list[str]]) -> DataFrame:
    """(key, doc_id, n_words, blocks): the blocks with a prefix token of their step's templates, each with its words and its set in global order."""
    each = docs.select(row_key(F.col("doc_id"), F.xxhash64("text")).alias("key"), "doc_id", alnum_words(filled("text")).alias("words"))

    def of_step(step: int) -> Column:
        prefix = prefixes[step]
        places = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda i: F.get("words", i).isin(prefix))
        numbers = F.array_distinct(F.flatten(F.transform(places, lambda p: F.sequence(F.greatest(F.lit(0), F.floor(p / step).cast("int") - 1), F.floor(p / step).cast("int")))))

        def block(b: Column) -> Column:
            words = F.slice("words", b * step + 1, 2 * step)
            return F.struct(F.lit(step).alias("step"), b.alias("block"), words.alias("words"), F.array_intersect(_strings(order), words).alias("tokens"))

        return F.when(F.arrays_overlap("words", _strings(prefix)), F.transform(numbers, block))

    steps = [of_step(step) for step in sorted(prefixes)]
    blocks = steps[0] if len(steps) == 1 else F.flatten(F.array_compact(F.array(*steps)))
    return each.select("key", "doc_id", F.size("words").cast("long").alias("n_words"), blocks.alias("blocks"))


def scan(spark: SparkSession, docs: DataFrame, notices: Mapping[str, str] = NOTICES) -> tuple[DataFrame, DataFrame]:
    """Each document's (key, doc_id, n_words), and its matches (key, block, kind, label, containment, n_places, first, last)."""
    found = templates(notices)
    order = _vocabulary(docs, found)
    table = _template_table(spark, found, order)
    rank = {w: i for i, w in enumerate(order)}
    prefixes: dict[int, set[str]] = {}
    for _, _, words in found:
        tokens = sorted(set(words), key=rank.__getitem__)
        prefixes.setdefault(step_of(words), set()).update(tokens[: len(tokens) - _need(len(tokens)) + 1])
    each = stored(spark, _blocks(docs, order, {step: sorted(words) for step, words in prefixes.items()}), "license-blocks")

    blocks = each.where("blocks IS NOT NULL").select("key", F.explode("blocks").alias("b")).select("key", "b.*").dropDuplicates(["key", "step", "block"])
    tokens = blocks.select("key", "step", "block", "words", "tokens", F.size("tokens").alias("size"), F.posexplode("tokens").alias("j", "token"))
    left = F.least(F.col("n") - F.col("i"), F.col("size") - F.col("j"))
    candidates = tokens.join(F.broadcast(table), ["step", "token"]).where((F.col("size") >= F.col("need")) & (F.col("j") <= F.col("size") - F.col("need")) & (left >= F.col("need")))
    shared = F.size(F.array_intersect("template", "tokens"))
    matches = candidates.where(shared >= F.col("need")).withColumn("containment", shared / F.col("n"))
    starts = F.sequence(F.lit(0), F.least(F.lit(STEP), F.size("words")) - 1)
    places = F.when(F.col("kind") == "base", F.filter(starts, lambda s: F.slice("words", s + 1, F.size("phrase")) == F.col("phrase"))).otherwise(F.array().cast("array<int>"))
    # All base phrases are looked for in the shortest blocks.
    matches = matches.select("key", "block", "kind", "label", "containment", places.alias("places")).distinct()
    base = F.col("block").cast("long") * STEP
    return each.select("key", "doc_id", "n_words"), matches.select(
        "key", "block", "kind", "label", "containment", F.size("places").cast("long").alias("n_places"),
        (base + F.array_min("places")).alias("first"), (base + F.array_max("places")).alias("last"),
    )


def license_labels(spark: SparkSession, docs: DataFrame, notices: Mapping[str, str] = NOTICES) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of each document."""
    each, matches = scan(spark, docs, notices)
    is_place = F.col("n_places") > 0
    own = (F.col("kind") != "base") | is_place
    by_doc = matches.groupBy("key").agg(
        F.sum("n_places").alias("n_base"),
        F.min("first").alias("first_word"),
        F.max("last").alias("last_word"),
        F.collect_set(F.when(is_place, F.col("label"))).alias("base"),  # at most as many as templates
        F.collect_set(F.when(own, F.col("label"))).alias("all"),
        F.max(F.when(own, F.col("containment"))).alias("score"),
    )
    by_doc = stored(spark, by_doc.withColumnRenamed("key", "of"), "license-labels")
    joined = lambda c: F.coalesce(F.array_join(F.array_sort(c), ","), F.lit(""))
    return each.join(by_doc, F.col("key") == F.col("of"), "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        joined("base").alias("base_labels"), joined("all").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
