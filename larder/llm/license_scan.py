"""License scans by diagonal voting.

All rolling word k-gram hashes of the documents are joined with the positions of these k-grams in license
templates. A hit votes for its diagonal, the offset at which the template would begin in the document.
Neighbouring diagonals are merged, since inserted and lost words shift a text, and the spans that they
give are verified by aligning their hits in order.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from larder.llm.common import row_key, written
from larder.llm.textops import ALNUM, rolling, slices, word_hashes

# Phrases whose every place counts, with their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Notices as licences word them, with labels of this operator's own.
NOTICES = [
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction", "mit-notice"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "bsd-notice"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "isc-notice"),
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl-notice"),
    ("licensed under the GNU General Public License, version 3", "gpl-3.0"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License", "mpl-notice"),
    ("This is free and unencumbered software released into the public domain", "unlicense"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0"),
    ("Released under the MIT License", "mit-release"),
    ("All rights reserved", "all-rights-reserved"),
    ("GNU Lesser General Public License", "lgpl"),
    ("GNU Affero General Public License", "agpl"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", "bsd-endorsement"),
    ("The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement", "mit-warranty"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS basis, without warranties or conditions of any kind, either express or implied", "apache-warranty"),
    ("This program and the accompanying materials are made available under the terms of the Eclipse Public License", "epl-notice"),
    ("Distributed under the Boost Software License, Version 1.0", "boost-1.0"),
    ("Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely", "zlib-notice"),
    ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "cc0-notice"),
    ("Creative Commons Attribution-ShareAlike", "cc-by-sa"),
]

KEY = ["key_a", "key_b"]
_TEXT = -1  # a template that every text has once, with the text's number of words


def template_words(text: str) -> list[str]:
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def _template_rows(templates: list[tuple[str, str, bool]], k: int) -> list[tuple[int, int, int]]:
    """(hash, template, position) of every k-gram of every template."""
    rows = []
    for i, (text, _, _) in enumerate(templates):
        h, _, at = rolling(*word_hashes(pa.array([text]), ALNUM), k)
        rows += [(int(x), i, int(p)) for x, p in zip(h.view(np.int64), at)]
    return rows


def text_grams(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, key_a, key_b, n_words, grams array<long>): for each text of `docs` (doc_id, text, key_a,
    key_b) the hash of every k words in order."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                hashes, counts = word_hashes(part.column(1), ALNUM)
                h, _, _ = rolling(hashes, counts, k)
                bounds = np.concatenate(([0], np.cumsum(np.maximum(counts - k + 1, 0)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array(counts), pa.ListArray.from_arrays(bounds, pa.array(h.view(np.int64)))],
                    names=["doc_id", "key_a", "key_b", "n_words", "grams"],
                )

    return docs.mapInArrow(of, "doc_id long, key_a long, key_b long, n_words long, grams array<long>")


def aligned(pos: list[int], at: list[int], k: int, slack: int) -> int:
    """Template words that hits cover when both positions rise and diagonals of neighbours lie `slack`
    apart at most: the best such chain, by words."""
    hits = sorted(set(zip(pos, at)))
    reach = max(at, default=0) + slack  # no two hits of a chain that follow one another lie further apart
    words: list[int] = []
    first = 0
    for i, (p, a) in enumerate(hits):
        while hits[first][0] < p - reach:
            first += 1
        best = k
        for (q, b), so_far in zip(hits[first:i], words[first:i]):
            if q < p and b < a and abs(p - q - (a - b)) <= slack:
                best = max(best, so_far + min(k, a - b, p - q))
        words.append(best)
    return max(words, default=0)


def scan(
    docs: DataFrame,
    phrases: list[tuple[str, str]] = PHRASES,
    notices: list[tuple[str, str]] = NOTICES,
    k: int = 2,
    coverage: float = 0.8,
    slack: int = 3,
    doc_id: str = "doc_id",
    text: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """(texts, spans). texts: (doc_id, n_words, key_a, key_b), a row per row of `docs`. spans: (key_a, key_b,
    label, base, first_word, last_word, coverage), a row per place. The key tells rows apart by id and
    text together: rows that share an id alone, or have none, stay apart.

    Words hold digits, letters and non-ASCII characters; A-Z are taken as a-z. A base span is a place
    where a phrase's words stand consecutively. Others are places of notices of which `coverage` of the
    words stand in order, in runs of k words or more, on diagonals that lie `slack` apart at most, or as far
    as the words that a notice may lack would shift it. Templates need k words at least.
    """
    templates = [(p, label, True) for p, label in phrases] + [(n, label, False) for n, label in notices]
    sizes = [len(template_words(t)) for t, _, _ in templates]
    spark = docs.sparkSession
    docs = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    docs = docs.withColumns(dict(zip(KEY, row_key("doc_id", "text"))))
    table = spark.createDataFrame([(0, _TEXT, 0), *_template_rows(templates, k)], "h long, template int, at int")
    # Each text has one more gram in front, which stands for the text itself: no second pass for n_words.
    grams = text_grams(docs, k).select("doc_id", *KEY, "n_words", F.posexplode(F.concat(F.array(F.lit(0).cast("long")), "grams")).alias("place", "h"))
    found = grams.join(F.broadcast(table), "h")  # some 200 rows, whatever the input
    found = found.where(f"(template = {_TEXT}) = (place = 0)")
    hits = written(found.select("doc_id", *KEY, "n_words", "template", (F.col("place") - 1).alias("pos"), "at"), "hits")
    texts = hits.where(f"template = {_TEXT}").select("doc_id", "n_words", *KEY)

    info = spark.createDataFrame([(i, label, base, n) for i, ((_, label, base), n) in enumerate(zip(templates, sizes))], "template int, label string, base boolean, size int")
    hits = hits.where(f"template <> {_TEXT}").join(F.broadcast(info), "template")  # a row a template
    hits = hits.withColumn("diagonal", F.col("pos") - F.col("at"))
    whole = [*KEY, "template", "label", "size"]
    base = (
        hits.where("base")
        .groupBy(*whole, "diagonal")
        .agg(F.count_distinct("at").alias("votes"))
        .where(F.col("votes") == F.col("size") - k + 1)
        .select(*KEY, "label", F.lit(True).alias("base"), F.col("diagonal").cast("long").alias("first_word"), (F.col("diagonal") + F.col("size") - 1).cast("long").alias("last_word"), F.lit(1.0).alias("coverage"))
    )

    votes = hits.where("not base").groupBy(*whole, "diagonal").agg(F.collect_set(F.struct("pos", "at")).alias("seen"))
    order = Window.partitionBy(*KEY, "template").orderBy("diagonal")
    # words may be lost in one piece, which shifts what follows by their number
    shift = F.greatest(F.lit(slack), F.floor((1 - coverage) * F.col("size") + 1e-9)).cast("int")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(order) > shift, F.lit(True)).cast("int")
    merged = (
        votes.withColumn("apart", apart)
        .withColumn("band", F.sum("apart").over(order))
        .groupBy(*whole, "band")
        .agg(F.flatten(F.collect_list("seen")).alias("seen"))
        # no chain of hits covers words that all of them don't
        .where(F.size(F.array_distinct(F.flatten(F.transform("seen.at", lambda a: F.sequence(a, a + k - 1))))) >= coverage * F.col("size"))
        .select(*KEY, "label", "size", F.col("seen.pos").alias("pos"), F.col("seen.at").alias("at"), shift.alias("shift"))
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pos, at = batch.column(4).to_pylist(), batch.column(5).to_pylist()
            share = [aligned(p, a, k, d) / n for p, a, n, d in zip(pos, at, batch.column(3).to_pylist(), batch.column(6).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array([min(p) for p in pos], pa.int64()), pa.array([max(p) + k - 1 for p in pos], pa.int64()), pa.array(share, pa.float64())],
                names=[*KEY, "label", "first_word", "last_word", "coverage"],
            )

    spans = merged.mapInArrow(verify, "key_a long, key_b long, label string, first_word long, last_word long, coverage double")
    spans = spans.where(F.col("coverage") >= coverage).select(*KEY, "label", F.lit(False).alias("base"), "first_word", "last_word", "coverage")
    return texts, base.unionAll(spans)


def license_digest(docs: DataFrame, **options) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score), a row per row of
    `docs`: what `scan` finds in it.

    n_base counts places of base phrases; first_word and last_word are their smallest and largest start,
    null without any. Labels are distinct, sorted, joined by commas; empty without any. score is the
    best coverage of any place, 0 without one. A null text has no words. Rows that share a doc_id, or
    have none, are scanned each for itself. An empty table gives an empty table. Other columns aren't
    read.
    """
    texts, spans = scan(docs, **options)
    starts = F.when(F.col("base"), F.col("first_word"))
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    found = spans.groupBy(*KEY).agg(
        F.count_if("base").alias("n_base"),
        F.min(starts).alias("first_word"),
        F.max(starts).alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"),
        joined("label").alias("labels"),
        F.max("coverage").alias("score"),
    )
    return texts.join(found, KEY, "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"),
        "first_word",
        "last_word",
        F.coalesce("base_labels", F.lit("")).alias("base_labels"),
        F.coalesce("labels", F.lit("")).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
    )
