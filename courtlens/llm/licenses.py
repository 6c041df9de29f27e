"""License scan by diagonal voting, in DataFrame functions only.

Word 3-grams of every text are joined by hash with the positions of the template phrases. A shared
run of words gives hits on one offset diagonal (place in the text minus place in the template), so
hits are counted per diagonal; neighbouring diagonals are merged, which bridges inserted or missing
words; and a merged span counts when enough of the template is covered.
"""

from __future__ import annotations

from typing import NamedTuple, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from courtlens.llm.common import lower_ascii

K = 3
#: Offsets that differ by this much still belong to one span.
DRIFT = 4
#: Part of a template's 3-grams that a span must hold.
COVER = 0.7


class Template(NamedTuple):
    label: str
    text: str
    base: bool


# The phrases whose places are counted exactly.
BASE = (
    Template("mit", "under the mit license", True),
    Template("apache-2", "apache license version 2", True),
    Template("cc-by-nc", "cc by nc", True),
)
# Wording of common license notices. Long ones are found also when a few words differ;
# in one of seven to nine words only a word near an end may.
NOTICES = (
    Template("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", False),
    Template("mit", "released under the terms of the mit license", False),
    Template("apache-2", "licensed under the apache license version 2 0", False),
    Template("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at", False),
    Template("gpl-3", "licensed under the gnu general public license version 3", False),
    Template("gpl", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", False),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", False),
    Template("cc-by-nc", "creative commons attribution noncommercial 4 0 international license", False),
    Template("cc-by-sa", "creative commons attribution sharealike 4 0 international license", False),
    Template("cc-by", "creative commons attribution 4 0 international license", False),
)

#: Everything but 0-9, a-z and characters beyond ASCII; upper case is lowered first.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def word_array(text: Column) -> Column:
    """Words of a text, null counting as empty."""
    return F.filter(F.split(lower_ascii(F.coalesce(text, F.lit(""))), _BETWEEN), lambda w: w != "")


def _template_grams(spark: SparkSession, templates: Sequence[Template]) -> DataFrame:
    """One row per template 3-gram; its size is that of the phrase list, so it may be broadcast."""
    rows = []
    for number, template in enumerate(templates):
        words = template.text.split()
        if len(words) < K:
            raise ValueError(f"a template needs {K} words at least: {template.text}")
        grams = len(words) - K + 1
        rows += [(number, template.label, template.base, len(words), grams, at, *words[at:at + K]) for at in range(grams)]
    return spark.createDataFrame(
        rows, "template int, label string, base boolean, length int, grams int, at int, t0 string, t1 string, t2 string"
    ).withColumn("gram", F.xxhash64("t0", "t1", "t2"))


def text_key(text: Column) -> Column:
    """What names a text: equal texts have equal findings, whatever their rows' ids."""
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256))


def hits(docs: DataFrame, templates: Sequence[Template], text_column: str) -> DataFrame:
    """Every place where a text shares a 3-gram with a template: the hash finds it, the words confirm it.
    ``id`` is the text's key."""
    words = docs.select(text_key(F.col(text_column)).alias("id"), word_array(F.col(text_column)).alias("w")).where(F.size("w") >= K)
    places = words.select("id", "w", F.explode(F.sequence(F.lit(0), F.size("w") - K)).alias("place"))
    grams = places.select(
        "id", "place", *[F.get("w", F.col("place") + i).alias(f"w{i}") for i in range(K)]
    ).withColumn("gram", F.xxhash64("w0", "w1", "w2"))
    known = F.broadcast(_template_grams(docs.sparkSession, templates))
    same = [grams["gram"] == known["gram"]] + [grams[f"w{i}"] == known[f"t{i}"] for i in range(K)]
    return grams.join(known, same).select("id", "place", "template", "label", "base", "length", "grams", "at")


def spans(found: DataFrame) -> DataFrame:
    """Verified spans (id, template, label, base, first, score) of hits.

    A base phrase needs all its 3-grams on one diagonal, which is word-for-word equality, so its
    diagonals are not merged. Other templates need ``COVER`` of their distinct 3-grams within merged
    diagonals.
    """
    lines = found.withColumn("diagonal", F.col("place") - F.col("at")).groupBy(
        "id", "template", "label", "base", "length", "grams", "diagonal"
    ).agg(F.min("place").alias("first"), F.collect_set("at").alias("seen"))
    order = Window.partitionBy("id", "template").orderBy("diagonal")
    last = F.lag("diagonal").over(order)
    opens = F.col("base") | last.isNull() | (F.col("diagonal") - last > DRIFT)
    runs = lines.withColumn("run", F.sum(opens.cast("int")).over(order))
    merged = runs.withColumn("at", F.explode("seen")).groupBy("id", "template", "label", "base", "grams", "run").agg(
        F.min("first").cast("long").alias("first"), F.countDistinct("at").alias("covered")
    ).withColumn("score", F.col("covered") / F.col("grams"))
    enough = F.when(F.col("base"), F.col("covered") == F.col("grams")).otherwise(F.col("score") >= COVER)
    return merged.where(enough).select("id", "template", "label", "base", "first", "score")


def scan(docs: DataFrame, templates: Sequence[Template] = BASE + NOTICES,
         text_column: str = "text") -> DataFrame:
    """Per different text with a finding: (id, n_base, first_word, last_word, base_labels, labels, score).

    ``id`` is the key of the text (``text_key``), so rows of one id or of none do not mix. Null and
    empty texts find nothing; overlapping places all count; copies are one text; other columns are
    not read. ``score`` is the best span's coverage.
    """
    found = spans(hits(docs, templates, text_column))
    base = F.col("base")
    return found.groupBy("id").agg(
        F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).alias("first_word"),
        F.max(F.when(base, F.col("first"))).alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.max("score").alias("score"))


def annotate(docs: DataFrame, templates: Sequence[Template] = BASE + NOTICES,
             id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The findings of ``scan`` beside every row's id and word count.

    Rows without a finding get zeros, nulls for the places and empty label strings. Every row has
    the findings of its own text, whatever other rows share its id.
    """
    text = F.col(text_column)
    counted = docs.select(F.col(id_column).alias("doc_id"), text_key(text).alias("id"), F.size(word_array(text)).cast("long").alias("n_words"))
    joined = counted.join(scan(docs, templates, text_column), "id", "left")
    return joined.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))

