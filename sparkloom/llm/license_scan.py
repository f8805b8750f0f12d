"""License scans by diagonal voting, on DataFrame functions only.

All rolling word pairs of every text are hashed and joined to the positions that
the same pair has in a table of templates (a fixed, short table, hence broadcast).
A hit votes for the diagonal document position - template position. Votes are
gathered by document, template and diagonal as bits, one for each template position
(in blocks of 62, however long the template), so repeated rows vote once. Phrases must fill one diagonal. Notices may have words
inserted or left out: neighbouring diagonals are merged, and a merged span counts
if it covers enough of the template and is not much longer than it.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkloom.plans.tables import materialize

#: Phrases whose every place counts, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: Notices that the method looks for besides the phrases: label, wording (in words of the pattern below, lower case).
NOTICES = [
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("copyright", "all rights reserved no part of this publication may be reproduced"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"),
    ("gpl-3.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl-2.0", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
]

#: Pairs of two of these words do not vote: they are everywhere.
WEAK = frozenset("a all and any are as be by for in is it no not of on or that the this to under with".split())
#: Share of a notice's voting pairs that a span must cover.
COVER = 0.8
#: Diagonals this near to each other are merged.
NEAR = 2

#: What separates words: the ASCII characters that are neither digits nor letters.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+"


def template_table(spark: SparkSession, phrases: dict[str, str] | None = None, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """``tpl, label, exact, size, pairs, tpos, a, b``: one row per voting pair of a template."""
    rows = []
    texts = [(label, text, True) for text, label in (PHRASES if phrases is None else phrases).items()] + [(label, text, False) for label, text in (NOTICES if notices is None else notices)]
    for tpl, (label, text, exact) in enumerate(texts):
        words = re.findall("[a-z0-9]+", text)
        pairs = [(k, a, b) for k, (a, b) in enumerate(zip(words, words[1:], strict=False)) if exact or not {a, b} <= WEAK]
        if not pairs:
            raise ValueError(f"a template has two words at least, some of them telling: {text!r}")
        rows += [(tpl, label, exact, len(words), len(pairs), k, a, b) for k, a, b in pairs]
    return spark.createDataFrame(rows, "tpl int, label string, exact boolean, size int, pairs int, tpos int, a string, b string")


def words_of(text: Column) -> Column:
    """Words of digits, letters and all characters beyond ASCII, in the case of the text; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN), "")


def _is(word: Column, template: Column) -> Column:
    """Equal but for the case of A-Z: lower() also maps some longer characters to ASCII, which the byte count rules out."""
    return (F.lower(word) == template) & (F.octet_length(word) == F.octet_length(template))


def votes(documents: DataFrame, templates: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Diagonals with votes by block: ``doc_id, h, tpl, label, exact, size, pairs, diag, block, mask, first, last``."""
    rows = documents.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("h"), words_of(F.col(text_col)).alias("w"))
    pairs = rows.select("doc_id", "h", F.posexplode(F.arrays_zip(F.col("w").alias("x"), F.slice("w", 2, F.greatest(F.size("w"), F.lit(1))).alias("y"))).alias("pos", "g"))
    pairs = pairs.select("doc_id", "h", "pos", F.col("g.x").alias("x"), F.col("g.y").alias("y")).withColumn("gram", F.xxhash64(F.lower("x"), F.lower("y")))
    table = F.broadcast(templates.withColumn("gram", F.xxhash64("a", "b")))
    hits = pairs.join(table, "gram").where(_is(F.col("x"), F.col("a")) & _is(F.col("y"), F.col("b")))
    diagonal = hits.groupBy("doc_id", "h", "tpl", "label", "exact", "size", "pairs", (F.col("pos") - F.col("tpos")).alias("diag"), F.floor(F.col("tpos") / 62).cast("int").alias("block"))
    return diagonal.agg(F.bit_or(F.expr("shiftleft(1L, tpos % 62)")).alias("mask"), F.min("pos").alias("first"), (F.max("pos") + 1).alias("last"))


def spans(found: DataFrame) -> DataFrame:
    """Verified spans: ``doc_id, h, label, exact, start, stop, cover`` (words, stop included)."""
    key = ["doc_id", "h", "tpl", "label", "exact", "size", "pairs"]
    exact = found.where("exact").groupBy(*key, "diag").agg(F.sum(F.bit_count("mask")).alias("n")).where("n = pairs")
    exact = exact.select("doc_id", "h", "label", "exact", F.col("diag").alias("start"), (F.col("diag") + F.col("size") - 1).alias("stop"), F.lit(1.0).alias("cover"))
    by = Window.partitionBy("doc_id", "h", "tpl").orderBy("diag", "block")
    loose = found.where("not exact").withColumn("new", F.when(F.col("diag") - F.lag("diag").over(by) <= NEAR, 0).otherwise(1)).withColumn("run", F.sum("new").over(by))
    loose = loose.groupBy(*key, "run", "block").agg(F.bit_or("mask").alias("mask"), F.min("first").alias("start"), F.max("last").alias("stop"))
    loose = loose.groupBy(*key, "run").agg(F.sum(F.bit_count("mask")).alias("n"), F.min("start").alias("start"), F.max("stop").alias("stop")).withColumn("cover", F.col("n") / F.col("pairs"))
    loose = loose.where((F.col("cover") >= COVER) & (F.col("stop") - F.col("start") + 1 <= F.col("size") * 1.25 + NEAR))
    return exact.unionByName(loose.select(exact.columns))


def license_scan(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, notices: list[tuple[str, str]] | None = None) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` for every row.

    ``n_base`` counts the places of all phrases, overlapping ones too; ``first_word``
    and ``last_word`` are their smallest and largest first words (from 0; null without
    any). ``score`` is the best coverage of a verified span, 0 without one. Null texts
    count as empty; repeated rows give repeated results; rows with the same id and
    different texts are told apart by their texts. Null ids are kept.
    """
    templates = template_table(documents.sparkSession, phrases, notices)
    # written once: both kinds of spans read the diagonals, which are few, and texts are hashed once
    found = spans(materialize(votes(documents, templates, id_col, text_col), "license-votes"))
    place = F.when(F.col("exact"), F.col("start")).cast("long")
    found = found.groupBy("doc_id", "h").agg(
        F.count(place).alias("n_base"), F.min(place).alias("first_word"), F.max(place).alias("last_word"), F.max("cover").alias("score"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("exact"), F.col("label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
    )
    found = found.select(F.col("doc_id").alias("_id"), F.col("h").alias("_h"), "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    rows = documents.select(F.col(id_col).alias("doc_id"), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"), F.xxhash64(text_col).alias("h"))
    rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("h") == F.col("_h")), "left")
    return rows.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )
