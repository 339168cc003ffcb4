"""Licence scan by a positional index of rare words, with DataFrame functions only.

Templates are licence names, notices and bodies. Their words, stop words aside, make
an index: word -> (template, position). A file's words that are in the index are its
licence words. A template can stand in a file only if the file has all words of the
template's key phrases; of these the file's word of highest IDF is looked up, and
each of its occurrences proposes the place where the template would begin. At the
proposed places the other words of the key phrases must stand at the same relative
position, and then the template's further words are fetched: a place counts if the
words that stand right weigh (by IDF) at least a given share of all.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, pick, written

#: Runs of digits, ASCII letters and all characters beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
END = "\n"  # no word; stands once behind each text's words


@dataclass(frozen=True)
class Template:
    """label; text; keys: phrases of the text that must all stand right; base: one of the base phrases."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False

    def words(self) -> list[str]:
        return re.findall(WORD, self.text.lower())


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
this permission notice shall be included in all copies or substantial portions of the Software."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
GPL = """is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."""
BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
granted, provided that the above copyright notice and this permission notice appear in all copies."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify,
publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any
purpose, commercial or non-commercial, and by any means."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held
liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
any purpose, including commercial applications, and to alter it and redistribute it freely."""

TEMPLATES = [
    Template("mit", "mit license", ("mit license",), True),
    Template("apache", "apache license", ("apache license",), True),
    Template("gpl", "general public license", ("general public license",), True),
    Template("mit-text", MIT, ("hereby granted free", "without restriction")),
    Template("apache-text", APACHE, ("apache license version 2 0", "applicable law")),
    Template("gpl-text", GPL, ("gnu general public license", "free software foundation")),
    Template("bsd-text", BSD, ("binary forms", "source code must retain")),
    Template("isc-text", ISC, ("without fee", "permission notice")),
    Template("mpl-text", MPL, ("mozilla public license", "source code form")),
    Template("unlicense-text", UNLICENSE, ("unencumbered software", "public domain")),
    Template("zlib-text", ZLIB, ("held liable", "redistribute")),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    Template("agpl", "gnu affero general public license", ("affero general public license",)),
    Template("cc", "licensed under cc by", ("cc",)),
    Template("creative-commons", "licensed under a creative commons attribution", ("creative commons",)),
    Template("reserved", "all rights reserved", ("rights reserved",)),
]
#: Words too common to look up; a template's keys must do without them.
STOP = frozenset(
    "a above all an and any are as at be but by can code copy do either for form from if in including into is it list may must no not of on one or other persons so some such "
    "that the this to use was were whom will with you your 1".split()
) - {"code", "form", "must"}


def index(templates: list[Template]) -> list[tuple[int, int, str, int]]:
    """(template, position, word, whether a key needs it) of each word that is looked up."""
    out = []
    for t, template in enumerate(templates):
        words, needed = template.words(), set()
        for phrase in template.keys:
            key = phrase.split()
            starts = [i for i in range(len(words)) if words[i : i + len(key)] == key]
            if not starts or STOP & set(key):
                raise ValueError(f"template {template.label}: a key must be a part of its text without stop words")
            needed |= set(range(starts[0], starts[0] + len(key)))
        out += [(t, i, w, int(i in needed)) for i, w in enumerate(words) if w not in STOP]
    return out


def licence_words(df: DataFrame, id_col: str, text_col: str, words: DataFrame) -> DataFrame:
    """file (id and text hash), pos and word of each licence word; the word END at pos n_words of every row.

    words: word and word_len. Only A-Z are lower-cased: a longer character that
    lower-cases to an ASCII letter fails the comparison of lengths.
    """
    rows = pick(df, id=id_col, text=text_col).select(F.struct("id", F.xxhash64("text").alias("text_hash")).alias("file"), F.coalesce("text", F.lit("")).alias("text"))
    found = F.concat(F.regexp_extract_all("text", F.lit(WORD), F.lit(0)), F.array(F.lit(END)))
    spread = rows.select("file", F.posexplode(found).alias("pos", "raw"))
    hits = spread.select("file", "pos", F.octet_length("raw").alias("raw_len"), F.lower("raw").alias("word"))
    return hits.join(F.broadcast(words), "word").where("raw_len = word_len").select("file", F.col("pos").cast("bigint").alias("pos"), "word")


def scan_licences(df: DataFrame, id_col: str, text_col: str, templates: list[Template] | None = None, least: float = 0.7) -> DataFrame:
    """id, n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    n_base: places of base phrases; first_word and last_word: the least and the
    greatest place (words count from 0), null without any. base_labels, labels:
    distinct, sorted, joined by commas. score: the best place's weight, 0 without any.
    least: the share of weight a place needs. Null and empty texts have no words.
    Rows that repeat get the same result each, rows that share an id each that of
    their own text; places of equal score all count. Texts are read whole, whatever
    their length. An empty table gives no rows. Only the two columns are read, so
    others do no harm whatever their names.
    """
    spark: SparkSession = df.sparkSession
    templates = TEMPLATES if templates is None else templates
    listed = index(templates)
    postings = spark.createDataFrame(listed, "template int, at int, word string, key int")
    names = spark.createDataFrame([(i, t.label, t.base) for i, t in enumerate(templates)], "template int, label string, base boolean")
    words = spark.createDataFrame([(w, len(w)) for w in sorted({w for _, _, w, _ in listed}) + [END]], "word string, word_len int")
    hits = written(licence_words(df, id_col, text_col, words), "licence-words")
    ends = hits.where(F.col("word") == END).select("file", F.col("pos").alias("n_words"))
    real = hits.where(F.col("word") != END).distinct()
    index_of = written(weighed(postings, real, ends), "postings")  # a row for each word of the templates
    matched = places(real, index_of, least).join(F.broadcast(names), "template")
    own = F.col("base")
    per_text = matched.groupBy("file").agg(
        F.sum(own.cast("bigint")).alias("n_base"), F.min(F.when(own, F.col("place"))).alias("first_word"), F.max(F.when(own, F.col("place"))).alias("last_word"),
        F.collect_set(F.when(own, F.col("label"))).alias("base_set"), F.collect_set("label").alias("set"), F.max("score").alias("score"),
    )
    text = lambda c: F.coalesce(F.concat_ws(",", F.array_sort(c)), F.lit(""))
    return ends.join(per_text, "file", "left").select(
        F.col("file.id").alias("id"), "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        text("base_set").alias("base_labels"), text("set").alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def weighed(postings: DataFrame, real: DataFrame, ends: DataFrame) -> DataFrame:
    """postings with each word's idf, 1 + ln((texts + 1) / (texts with it + 1)), and the sum over the template."""
    having = real.select("file", "word").distinct().groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    total = ends.agg(F.count(F.lit(1)).alias("texts"))
    known = postings.join(having, "word", "left").crossJoin(F.broadcast(total))  # one row of totals
    known = known.withColumn("idf", 1 + F.log((F.col("texts") + 1) / (F.coalesce("df", F.lit(0)) + 1)))
    sums = known.groupBy("template").agg(F.sum("idf").alias("all_idf"), F.sum("key").alias("all_keys"))
    return known.join(sums, "template").select("template", "at", "word", "key", "idf", "all_idf", "all_keys")


def rarest_words(real: DataFrame, index_of: DataFrame) -> DataFrame:
    """file, template and word: the file's rarest word of the keys of each template whose key words it has all."""
    needed = index_of.where("key = 1").select("template", "word", "idf").distinct()
    number = needed.groupBy("template").agg(F.count(F.lit(1)).alias("number"))
    needed = F.broadcast(needed.join(number, "template"))
    held = real.select("file", "word").distinct().join(needed, "word")
    held = held.groupBy("file", "template").agg(F.count(F.lit(1)).alias("have"), F.first("number").alias("number"), F.max(F.struct("idf", "word")).alias("rarest"))
    return held.where("have = number").select("file", "template", F.col("rarest.word").alias("word"))


def places(real: DataFrame, index_of: DataFrame, least: float) -> DataFrame:
    """file, template, place and score of each place where a template stands."""
    by = ["file", "template", "place"]
    keys, rest = F.broadcast(index_of.where("key = 1")), F.broadcast(index_of.where("key = 0"))
    proposed = real.join(rarest_words(real, index_of), ["file", "word"]).join(keys.select("template", "word", "at"), ["template", "word"])
    proposed = proposed.select("file", "template", (F.col("pos") - F.col("at")).alias("place")).distinct()

    def standing(where: DataFrame, words: DataFrame) -> DataFrame:
        """The words that stand where the templates at the places want them."""
        wanted = where.join(words, "template").withColumn("pos", F.col("place") + F.col("at"))
        return wanted.join(real, ["file", "word", "pos"])

    verified = standing(proposed, keys).groupBy(*by).agg(F.sum("key").alias("keys"), F.sum("idf").alias("key_idf"), F.first("all_keys").alias("all_keys"), F.first("all_idf").alias("all_idf"))
    verified = written(verified.where("keys = all_keys").select(*by, "key_idf", "all_idf"), "verified")
    further = standing(verified.select(*by), rest).groupBy(*by).agg(F.sum("idf").alias("further_idf"))
    right = F.col("key_idf") + F.coalesce("further_idf", F.lit(0.0))
    scored = verified.join(further, by, "left").withColumn("score", F.round(F.least(right / F.col("all_idf"), F.lit(1.0)), 9))
    return scored.where(F.col("score") >= least).select(*by, "score")
