"""License scan as an exact set-similarity join between templates and text blocks; DataFrame functions only.

Tokens are pairs of neighbouring words.  A text is cut into blocks of two steps, each half over the next, where a
step is as long as the longest template; so a place of any template lies whole in one block.  A block is the set of
its tokens that some template holds, since others can't add to an overlap.

All tokens have one order, that of their frequency in the corpus, rare before frequent.  A template of m tokens of
which a block must hold t shares one of its first m - t + 1 tokens with every block that does (prefix filter).
A block with fewer than t tokens goes (length filter), and so does one where after the first common token, in the
order, too few are left in the template or in the block (positional filter).  The overlaps of the rest are counted.

A phrase is a template that must be held whole; where its tokens also stand next to each other is a place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tokenloom.llm.common import ascii_lower
from tokenloom.session import materialise

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PERCENT = 80             # of a notice's tokens that a block holds, at least
BROADCAST_ROWS = 100_000  # tokens of all templates (about 10 MB) up to which they are broadcast
END = "\n"               # no word: marks the row that stands for a text

#: Phrases whose places are counted, and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]
#: The wording of common notices, and their labels.
NOTICES = [
    ("licensed under the apache license version 2 0", "apache"),
    ("licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", "apache"),
    ("redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "bsd"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("this work is licensed under the gnu general public license version 3", "gpl"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
     "the free software foundation", "gpl"),
    ("under the terms of the gnu affero general public license as published by the free software foundation", "agpl"),
    ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "isc"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
]


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(WORD), F.lit(0))


def template_table(spark: SparkSession, phrases: list[tuple[str, str]], notices: list[tuple[str, str]], percent: int = PERCENT) -> DataFrame:
    """``text, label, percent``; a phrase is a template with 100 percent and its places."""
    rows = [(t, k, 100, "true") for t, k in phrases] + [(t, k, percent, "false") for t, k in notices]
    quoted = lambda v: "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
    values = [f"({quoted(t)}, {quoted(k)}, {n}, {phrase})" for t, k, n, phrase in rows] or ["('', '', 100, true)"]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(values)} AS t(text, label, percent, phrase)")


def _pairs(words: Column) -> Column:
    """Each word with the next one; the last with an empty one."""
    follow = F.concat(F.slice(words, 2, F.size(words)), F.array(F.lit("")))
    return F.arrays_zip(words.alias("a"), follow.alias("b")).cast("array<struct<a: string, b: string>>")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def find_licenses(docs: DataFrame, templates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Finds ``templates`` (``text, label, percent, phrase``) in ``docs``.

    Returns the documents (``row, doc_id, n_words``) and the finds (``row, label, phrase, start, stop, score``): a
    row for each place of a phrase, and for each block that holds ``percent`` of a notice's tokens the range of these.
    Positions are words from 0, ``stop`` is exclusive.  Templates of fewer than two words are left out.
    """
    plain = (templates.select("label", "percent", "phrase", words_of(F.col("text")).alias("w")).where(F.size("w") >= 2)
             .withColumn("template", F.xxhash64("label", "percent", "phrase", "w")).dropDuplicates(["template"]))
    places = materialise(plain.select("template", "label", "percent", "phrase", F.posexplode(_pairs(F.col("w"))).alias("offset", "p"))
                         .where("p.b <> ''").select("template", "label", "percent", "phrase", "offset", "p.a", "p.b", F.xxhash64("p.a", "p.b").alias("token")),
                         "templates")
    tokens = places.select("a", "b", "token").distinct()
    n_tokens, step = places.agg(F.count_distinct("token"), F.max("offset") + 2).first()
    step = step or 2

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), words_of(F.col("text")).alias("w"))
    each = rows.select("row", "doc_id", F.size("w").cast("bigint").alias("n_words"), F.posexplode(F.concat(
        F.array(F.struct(F.lit(END).alias("a"), F.lit("").alias("b"))), _pairs(F.col("w")))).alias("pos", "p"))
    each = each.select("row", "doc_id", "n_words", (F.col("pos") - 1).alias("pos"), "p.a", "p.b")
    hits = each.join(_small(tokens, n_tokens), ["a", "b"], "left").where((F.col("a") == END) | F.col("token").isNotNull())
    stored = materialise(hits.select("row", "doc_id", "n_words", "pos", "token"), "tokens")
    texts, hits = stored.where("pos < 0").select("row", "doc_id", "n_words"), stored.where("pos >= 0").select("row", "pos", "token")

    # One order of tokens for templates and blocks; the number stands for the frequency, the token settles ties.
    frequency = materialise(tokens.select("token").join(hits.groupBy("token").agg(F.count("*").alias("c")), "token", "left")
                            .select("token", F.coalesce("c", F.lit(0)).alias("c")), "frequency")
    own = Window.partitionBy("template").orderBy("c", "token")
    sets = (places.select("template", "percent", "token").distinct().join(_small(frequency, n_tokens), "token")
            .withColumns({"at": F.row_number().over(own), "m": F.count("*").over(Window.partitionBy("template"))})
            .withColumn("needed", F.ceil(F.col("percent") * F.col("m") / 100).cast("int")))
    sets = materialise(sets.select("template", "token", "at", "m", "needed"), "sets")
    prefix = _small(sets.where("at <= m - needed + 1").select("token").distinct(), n_tokens)

    half = F.expr(f"pos div {step}")
    blocks = hits.select("row", "pos", "token", F.explode(F.filter(F.array(half, half - 1), lambda b: b >= 0)).alias("block"))
    wanted = blocks.join(prefix, "token", "left_semi").select("row", "block").distinct()
    held = materialise(blocks.join(wanted, ["row", "block"], "left_semi"), "blocks")
    in_block = Window.partitionBy("row", "block")
    members = (held.groupBy("row", "block", "token").agg(F.min("pos").alias("low"), F.max("pos").alias("high"))
               .join(_small(frequency, n_tokens), "token")
               .withColumns({"place": F.row_number().over(in_block.orderBy("c", "token")), "size": F.count("*").over(in_block)}))
    members = materialise(members.select("row", "block", "token", "low", "high", "place", "size"), "members")
    starts = _small(sets.where("at <= m - needed + 1"), n_tokens)
    first = (members.join(starts, "token").groupBy("row", "block", "template")
             .agg(F.min(F.struct("at", "place", "size", "m", "needed")).alias("f")).select("row", "block", "template", "f.*"))
    # The first common token and as many as are left behind it.
    chosen = first.where((F.col("size") >= F.col("needed")) & (1 + F.least(F.col("m") - F.col("at"), F.col("size") - F.col("place")) >= F.col("needed")))
    common = (members.select("row", "block", "token", "low", "high").join(chosen.select("row", "block", "template"), ["row", "block"])
              .join(_small(sets, n_tokens), ["template", "token"]).groupBy("row", "block", "template", "m", "needed")
              .agg(F.count("*").alias("common"), F.min("low").alias("start"), (F.max("high") + 2).alias("stop")).where("common >= needed"))
    names = _small(places.select("template", "label", "phrase").distinct(), n_tokens)
    found = materialise(common.join(names, "template"), "found")
    notices = found.where("not phrase").select("row", "label", "phrase", "start", "stop", (F.col("common") / F.col("m")).alias("score"))
    # Where all tokens of a phrase follow each other: every one of them votes for the place where it would start.
    size = places.groupBy("template").agg(F.count("*").cast("int").alias("k"))
    votes = (held.join(found.where("phrase").select("row", "block", "template", "label"), ["row", "block"])
             .join(_small(places.select("template", "token", "offset").join(size, "template"), n_tokens), ["template", "token"])
             .select("row", "template", "label", "k", "offset", (F.col("pos") - F.col("offset")).alias("start")).distinct())
    phrases = (votes.groupBy("row", "template", "label", "k", "start").agg(F.count("*").alias("n")).where("n = k")
               .select("row", "label", F.lit(True), "start", F.col("start") + F.col("k") + 1, F.lit(1.0)))
    return texts, notices.union(phrases)


def scan_licenses(docs: DataFrame, templates: DataFrame) -> DataFrame:
    """Labels of every document, a row per row of ``docs``.

    Returns ``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score``: the places of phrases, with
    their least and largest start, the labels of phrases and of all templates found, and the largest share of a
    template's tokens in a block, 0 if none is found.  A null text is empty and has no labels; rows that repeat an id
    are reported each; without templates nothing is found.  Other columns are ignored.
    """
    texts, finds = find_licenses(docs, templates)
    per = finds.groupBy("row").agg(
        F.count_if("phrase").alias("n"), F.min(F.when(F.col("phrase"), F.col("start"))).cast("bigint").alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("start"))).cast("bigint").alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("phrase"), F.col("label")))).alias("base"), F.array_sort(F.collect_set("label")).alias("labels"),
        F.max("score").alias("score"))
    joined = lambda c: F.coalesce(F.array_join(c, ","), F.lit(""))
    return texts.join(per, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_base"), "first_word", "last_word",
        joined("base").alias("base_labels"), joined("labels").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))
