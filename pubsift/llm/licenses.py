"""License scans by diagonal voting.

Every text is cut into words; all rolling word k-grams (k = 2) of all documents
are joined by hash with the positions of the license templates, and the words of
a matching gram are compared, so no hash collision survives.  A match at word
``p`` of the document and ``t`` of the template votes for the diagonal ``p - t``.
Votes are summed per diagonal, neighbouring diagonals (insertions and deletions
shift a copy by a few words) are merged, and a merged span is verified by the
share of the template's grams it holds: all of them for a phrase, at least
``MIN_COVERAGE`` for a passage.  Grams of passages count with the two words that
follow, so that common word pairs do not vote.

The templates are a fixed table, so the join is a broadcast join; votes carry no
text.  Cases: null texts have no words; repeated rows each get their row; a null
id is kept; extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pubsift.llm.common import Workspace, letter_words

# Phrases that name a license (all grams on one diagonal).
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Passages of license notices, public texts.
PASSAGES = {
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
           "associated documentation files (the \"Software\"), to deal in the Software without restriction, "
           "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
           "and/or sell copies of the Software",
    "apache": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
              "compliance with the License. You may obtain a copy of the License at",
    "gpl": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
           "General Public License as published by the Free Software Foundation",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
           "that the following conditions are met",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
           "hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License",
    "cc-by": "This work is licensed under a Creative Commons Attribution",
    "cc-by-nc": "Licensed under CC BY-NC 4.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}
# Further parts of public notices, several of a label.
NOTICES = [
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial "
            "portions of the Software"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is "
               "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or "
               "implied. See the License for the specific language governing permissions and limitations under the "
               "License."),
    ("gpl", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
            "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public "
            "License for more details."),
    ("lgpl", "terms of the GNU Lesser General Public License"),
    ("agpl", "terms of the GNU Affero General Public License"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
            "following disclaimer."),
    ("bsd", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
            "the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
            "promote products derived from this software without specific prior written permission"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the "
             "authors be held liable for any damages arising from the use of this software."),
    ("boost", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the "
              "software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, "
              "display, distribute, execute, and transmit the Software, and to prepare derivative works of the "
              "Software"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights "
            "to this work"),
]
MIN_COVERAGE = 0.8
MAX_SHIFT = 8               # words by which neighbouring diagonals may differ


def templates(spark: SparkSession) -> DataFrame:
    """``(template, label, phrase, grams, t, k, w0..w3)``: one row per template gram."""
    rows = []
    passages = [(t, n) for n, t in [*PASSAGES.items(), *NOTICES]]
    for kind, texts in (("phrase", PHRASES.items()), ("passage", passages)):
        for at, (text, label) in enumerate(texts):
            words = [w.decode() for w in letter_words(text.encode())]
            k = 2 if kind == "phrase" else 4
            grams = len(words) - k + 1
            rows += [(f"{kind}:{at}:{label}", label, kind == "phrase", grams, t, k, *words[t:t + k], *[None] * (4 - k))
                     for t in range(grams)]
    return spark.createDataFrame(rows, "template string, label string, phrase boolean, grams int, t int, k int, "
                                       "t0 string, t1 string, t2 string, t3 string")


def words_of(col: str = "text"):
    """Array of lower-cased words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``, to be compared with words of a-z.

    ``lower`` changes letters beyond A-Z too.  Of these the Kelvin sign alone becomes
    a letter of a-z, so it is replaced by another sign first; all others stay outside
    ASCII and in the same words, so equality with words of a-z is that of lowering A-Z.
    """
    given = F.replace(F.coalesce(F.col(col).cast("string"), F.lit("")), F.lit("\u212a"), F.lit("\u212b"))
    text = F.trim(F.regexp_replace(F.lower(given), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " "))
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, " "))


def spans(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Verified spans ``(key, template, label, phrase, first_word, last_word, coverage)``;
    ``key`` is the struct (doc_id, hash of the text)."""
    n = F.size("_w")
    grams = F.arrays_zip(F.slice("_w", F.lit(1), n - 1).alias("w0"), F.slice("_w", F.lit(2), n - 1).alias("w1"),
                         F.slice("_w", F.lit(3), n).alias("w2"), F.slice("_w", F.lit(4), n).alias("w3"))
    rolling = (docs.select(_key().alias("key"), words_of().alias("_w")).where(n > 1)
               .select("key", F.posexplode(grams).alias("p", "g"))
               .select("key", "p", F.xxhash64("g.w0", "g.w1").alias("h"), "g.w0", "g.w1", "g.w2", "g.w3"))
    known = templates(spark).withColumn("th", F.xxhash64("t0", "t1"))
    same = ((F.col("h") == F.col("th")) & (F.col("w0") == F.col("t0")) & (F.col("w1") == F.col("t1"))
            & (F.col("phrase") | ((F.col("w2") == F.col("t2")) & (F.col("w3") == F.col("t3")))))
    votes = (rolling.join(F.broadcast(known), same)      # the templates are a fixed table
             .select("key", "template", "label", "phrase", "grams", (F.col("p") - F.col("t")).alias("diagonal"), "t", "k", "p"))
    # A set of template positions is bounded by the template.
    diagonals = votes.groupBy("key", "template", "label", "phrase", "grams", "k", "diagonal").agg(
        F.collect_set("t").alias("ts"), F.min("p").alias("first"), F.max("p").alias("last"))
    # Read twice below; far fewer rows than words.
    diagonals = Workspace(spark, "licenses").put(diagonals, "diagonals")
    # Phrases need every gram on one diagonal; each diagonal is its own span.
    whole = diagonals.where(F.col("phrase") & (F.size("ts") == F.col("grams"))).select(
        "key", "template", "label", "phrase", F.col("first").alias("first_word"),
        (F.col("last") + F.col("k") - 1).alias("last_word"), F.lit(1.0).alias("coverage"))
    by = Window.partitionBy("key", "template").orderBy("diagonal")
    far = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > MAX_SHIFT, F.lit(True))
    merged = (diagonals.where(~F.col("phrase")).withColumn("far", far.cast("int"))
              .withColumn("run", F.sum("far").over(by))
              .groupBy("key", "template", "label", "phrase", "grams", "k", "run")
              .agg(F.size(F.array_distinct(F.flatten(F.collect_list("ts")))).alias("held"),
                   F.min("first").alias("first"), F.max("last").alias("last"))
              .withColumn("coverage", F.col("held") / F.col("grams")).where(F.col("coverage") >= MIN_COVERAGE)
              .select("key", "template", "label", "phrase", F.col("first").alias("first_word"),
                      (F.col("last") + F.col("k") - 1).alias("last_word"), "coverage"))
    return whole.unionByName(merged)


def _key():
    return F.struct(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"))


def scan(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """One row per document with its license evidence."""
    found = spans(spark, docs).groupBy("key").agg(
        F.count(F.when(F.col("phrase"), 1)).alias("n_base"),
        F.min(F.when(F.col("phrase"), F.col("first_word"))).cast("long").alias("first_word"),
        F.max(F.when(F.col("phrase"), F.col("first_word"))).cast("long").alias("last_word"),
        F.collect_set(F.when(F.col("phrase"), F.col("label"))).alias("base"),
        F.collect_set("label").alias("all"), F.max("coverage").alias("score"))
    joined = lambda c: F.array_join(F.sort_array(F.coalesce(F.col(c), F.array().cast("array<string>"))), ",")
    rows = docs.select("doc_id", _key().alias("key"), F.size(words_of()).cast("long").alias("n_words"))
    return (rows.join(found.withColumnRenamed("key", "fkey"), F.col("key").eqNullSafe(F.col("fkey")), "left")
            .select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
                    "first_word", "last_word", joined("base").alias("base_labels"), joined("all").alias("labels"),
                    F.coalesce("score", F.lit(0.0)).alias("score")))
