"""License scan with a positional index of rare words, in DataFrame functions only.

Method: one pass over the texts keeps, for each file, the positions of licence vocabulary words, if the file holds any that are more than function words.
From this index come the words' document frequencies and IDF. A file's words with the highest IDF among each template's words say where that template may
start; the template's postings are intersected with the file's by relative position; and a label needs its mandatory key phrases, the version
among them, complete at these positions, and ``ENOUGH`` of the template's IDF. Base phrases are templates that are all key phrase. Templates are the wording of public licences.

Defined cases: a null text counts as empty; texts of any length are read as a whole; an empty table gives an empty result; rows without an id are kept; rows without a match have zero counts, null positions, empty label lists and the score of
their best partial match, 0 if there is none; repeated rows are judged alike; other columns are ignored.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plcatlas.llm.common import written

APART = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ANCHORS = 2
ENOUGH = 0.8


@dataclasses.dataclass(frozen=True)
class Template:
    """Words of a licence; each of ``keys`` must stand complete at its place (base ones are key as a whole); base ones are counted as places."""

    label: str
    text: str
    keys: tuple[str, ...] = ()
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def key_places(self) -> set[int]:
        """Places of the words of all key phrases."""
        words, out = self.words, set()
        for key in self.keys or (self.text,):
            own = key.split()
            at = next(i for i in range(len(words)) if words[i : i + len(own)] == own)
            out |= set(range(at, at + len(own)))
        return out


# The base phrases with their labels.
BASE = (
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
)
# Wording of public licences, from where no name of a holder stands in between, with the phrases that tell one from its like.
MORE = (
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the "
        "software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software "
        "and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall "
        "be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied",
        ("permission is hereby granted free of charge", "merge publish distribute sublicense"),
    ),
    Template(
        "isc-text",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and "
        "this permission notice appear in all copies",
        ("permission to use copy modify", "with or without fee is hereby granted"),
    ),
    Template(
        "bsd-text",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    Template(
        "bsd-3-clause",
        "may be used to endorse or promote products derived from this software without specific prior written permission",
        ("endorse or promote products derived from this software",),
    ),
    Template(
        "apache-2-text",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as "
        "is basis without warranties or conditions of any kind either express or implied",
        ("apache license version 2 0", "except in compliance with the license"),
    ),
    *(
        Template(
            f"{short}-{version}",
            f"it under the terms of the gnu {name} general public license as published by the free software foundation either version {version} of the license".replace("  ", " "),
            (f"gnu {name} general public license".replace("  ", " "), f"version {version} of the license"),
        )
        for short, name, version in (("gpl", "", "2"), ("gpl", "", "3"), ("lgpl", "lesser", "2 1"), ("lgpl", "lesser", "3"), ("agpl", "affero", "3"))
    ),
    Template(
        "mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at",
        ("mozilla public license v 2 0",),
    ),
    Template(
        "unlicense", "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software",
        ("free and unencumbered software released into the public domain",),
    ),
    Template("cc-by-nc-text", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template(
        "cc-by-nc-text", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0",),
    ),
)
# A file without any other word of a template is not looked at further.
FUNCTION_WORDS = (
    "a", "above", "all", "an", "and", "any", "are", "as", "at", "be", "been", "by", "can", "do", "either", "except", "file", "files", "following", "for", "free", "from", "have", "if",
    "in", "into", "is", "it", "kind", "law", "may", "met", "not", "obtain", "of", "on", "one", "or", "org", "person", "persons", "shall", "so", "that", "the", "this", "to", "under", "use",
    "used", "v", "was", "whom", "with", "without", "writing", "written", "www", "you", "0", "1", "2", "3", "4",
)


def lowered(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)


def build_index(docs: DataFrame, templates: tuple[Template, ...], id_column: str, text_column: str) -> DataFrame:
    """row, doc_id, n_words, hits: positions of vocabulary words in files that hold a telling one."""
    vocabulary = sorted({w for t in templates for w in t.words})
    telling = [w for w in vocabulary if w not in FUNCTION_WORDS]
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.array_remove(F.split(lowered(F.col(text_column).cast("string")), APART), "").alias("words"))
    marked = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(vocabulary), F.struct(i.alias("pos"), w.alias("word")))))
    rows = rows.select("doc_id", F.size("words").cast("long").alias("n_words"), marked.alias("hits"))
    hits = F.when(F.exists("hits", lambda h: h["word"].isin(telling)), F.col("hits"))
    return rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "n_words", hits.alias("hits"))


def scan(
    docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", base: tuple[Template, ...] = BASE, more: tuple[Template, ...] = MORE,
    anchors: int = ANCHORS, enough: float = ENOUGH,
) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    spark = docs.sparkSession
    templates = base + more
    index = written(build_index(docs, templates, id_column, text_column))
    postings = index.filter("hits is not null").select("row", F.inline("hits"))

    # one row a word and place of each template: a fixed table
    places = spark.createDataFrame(
        [(n, t.label, t.base, w, i, i in t.key_places, len(t.key_places)) for n, t in enumerate(templates) for i, w in enumerate(t.words)],
        "template int, label string, base boolean, word string, place int, in_key boolean, key_size int",
    )
    files = index.count()
    frequency = postings.groupBy("word", "row").agg(F.lit(1).alias("one")).groupBy("word").agg(F.count("*").alias("df"))
    idf = frequency.select("word", F.log(1 + F.lit(float(files)) / F.col("df")).alias("idf"))
    # a word that no file holds is as rare as one can be
    weighted = places.join(idf, "word", "left").withColumn("idf", F.coalesce("idf", F.log(F.lit(1.0 + files))))
    whole = Window.partitionBy("template")
    weighted = weighted.withColumn("mass", F.sum("idf").over(whole))

    matched = postings.join(F.broadcast(weighted), "word").withColumn("start", F.col("pos") - F.col("place"))
    # the file's highest-IDF words of each template open candidates, all others only support them
    best = Window.partitionBy("row", "template").orderBy(F.col("idf").desc(), "word")
    matched = matched.withColumn("nth", F.dense_rank().over(best))
    starts = matched.groupBy("row", "template", "start").agg(
        F.max(F.col("nth") <= anchors).alias("open"), F.sum("idf").alias("found"), F.first("mass").alias("mass"), F.first("label").alias("label"),
        F.first("base").alias("base"), F.sum(F.col("in_key").cast("int")).alias("key_found"), F.first("key_size").alias("key_size"),
    ).filter("open")
    share = F.when(F.col("mass") > 0, F.least(F.lit(1.0), F.col("found") / F.col("mass"))).otherwise(0.0)
    verified = (F.col("key_found") == F.col("key_size")) & (F.col("base") | (share >= enough))
    judged = starts.select("row", "label", "base", "start", share.alias("share"), verified.alias("ok"))
    is_base = F.col("base") & F.col("ok")
    found = judged.groupBy("row").agg(
        F.count(F.when(is_base, 1)).alias("n_base"), F.min(F.when(is_base, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(is_base, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(is_base, F.col("label")))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(F.col("ok"), F.col("label")))), ",").alias("labels"),
        F.max("share").alias("score"),
    )
    return index.select("row", "doc_id", "n_words").join(found, "row", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
