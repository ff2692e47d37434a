"""License texts and notices in documents, by diagonal voting.

All rolling word k-grams of the documents are joined by Spark with the places of the
templates' k-grams.  A shared gram votes for a diagonal: its place in the document less
its place in the template.  Votes are summed by diagonal, neighbouring diagonals (words put
in or left out) are merged to spans, and spans with enough votes are verified word by word
in the text.  Phrases that count only as they stand are templates whose diagonals are not
merged and must hold every word.
"""

from __future__ import annotations

import bisect
import hashlib
import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracelake.llm import common, textvec
from tracelake.llm.common import Workspace, broadcast_if_small
from tracelake.llm.decontaminate import INSIDE, common_length, masks

GRAM = 3
#: Diagonals of one span differ by so many words at most from one to the next.
NEAR = 8
#: Shares of a template's grams that vote for a span, and of its words that the span has in order.
VOTES, COVER = 0.2, 0.7
#: Rows of an Arrow batch of grams.
GRAM_ROWS = 1 << 16

# Phrases that are reported wherever they stand, and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
# Published license texts and the notices that their publishers recommend.
TEXTS = [
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("bsd", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl", "licensed under the GNU General Public License"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
]


def words_of(text: str) -> list[bytes]:
    """Words as in documents: A-Z in lower case, letters, digits and bytes beyond ASCII."""
    data = textvec.LOWER[np.frombuffer(text.encode(), np.uint8)]
    chunk = textvec.Chunk(data, np.array([0, len(data)]))
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(*(x.tolist() for x in chunk.spans(INSIDE[data])), strict=True)]


@dataclass(frozen=True)
class Template:
    """Words to look for; ``exact`` ones count word for word, others with a share of COVER."""

    label: str
    words: tuple[bytes, ...]
    exact: bool

    @property
    def votes(self) -> int:
        grams = len(self.words) - GRAM + 1
        return grams if self.exact else max(1, math.ceil(VOTES * grams))

    @property
    def least(self) -> int:
        return len(self.words) if self.exact else math.ceil(COVER * len(self.words))


def templates(phrases: list[tuple[str, str]] = PHRASES, texts: list[tuple[str, str]] = TEXTS) -> list[Template]:
    made = [Template(label, tuple(words_of(text)), True) for text, label in phrases] + [Template(label, tuple(words_of(text)), False) for label, text in texts]
    if any(len(t.words) < GRAM for t in made):
        raise ValueError(f"a template has under {GRAM} words")
    return made


def gram_places(known: list[Template]) -> list[tuple[int, int, int]]:
    """(gram, template, place) of every gram of the templates; as many rows as they have words."""
    found = []
    for i, t in enumerate(known):
        ends = np.cumsum([len(w) for w in t.words])
        data = np.frombuffer(b"".join(t.words), np.uint8)
        words = textvec.Chunk(data, np.array([0, len(data)])).word_ids(np.concatenate([[0], ends[:-1]]), ends, lower=False)
        grams, place = textvec.shingles(words, np.zeros(len(words), np.int64), GRAM)
        found += [(g, i, p) for g, p in zip(grams.view(np.int64).tolist(), place.tolist(), strict=True)]
    return found


def digests(chunk: textvec.Chunk) -> np.ndarray:
    """128-bit BLAKE2b digest of each text as two numbers."""
    raw = chunk.data.tobytes()
    made = b"".join([hashlib.blake2b(raw[a:b], digest_size=16).digest() for a, b in itertools.pairwise(chunk.offsets.tolist())])
    return np.frombuffer(made, np.int64).reshape(-1, 2)


def grams(docs: DataFrame) -> DataFrame:
    """(row, doc_id, high, low, n_words, place, gram): one row of each document, without a gram and at place -1, and one for each gram.

    ``row`` tells rows apart, ``high`` and ``low`` texts.
    """
    names = ["row", "doc_id", "high", "low", "n_words", "place", "gram"]

    def rolled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in textvec.chunks(batch.column(2)):
                starts, ends = chunk.spans(INSIDE[chunk.data])
                owner = chunk.doc_of(starts)
                n_words = np.bincount(owner, minlength=chunk.n_docs)
                gram, at = textvec.shingles(chunk.word_ids(starts, ends, lower=True), owner, GRAM)
                first = np.cumsum(n_words) - n_words
                doc = np.concatenate([np.arange(chunk.n_docs), owner[at]])
                place = np.concatenate([np.full(chunk.n_docs, -1), at - first[owner[at]]]).astype(np.int32)
                gram = np.concatenate([np.zeros(chunk.n_docs, np.int64), gram.view(np.int64)])
                halves, rows, ids = digests(chunk), batch.column(0).slice(chunk.first_row, chunk.n_docs), batch.column(1).slice(chunk.first_row, chunk.n_docs)
                for low in range(0, len(doc), GRAM_ROWS):
                    some = doc[low : low + GRAM_ROWS]
                    own = pa.array(some)
                    p = place[low : low + GRAM_ROWS]
                    yield pa.RecordBatch.from_arrays(
                        [rows.take(own), ids.take(own), pa.array(halves[some, 0]), pa.array(halves[some, 1]), pa.array(n_words[some]), pa.array(p), pa.array(gram[low : low + GRAM_ROWS], mask=p < 0)],
                        names=names,
                    )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(rolled, f"row long, doc_id {kind}, high long, low long, n_words long, place int, gram long")


def spans(hits: DataFrame, known: list[Template]) -> DataFrame:
    """(doc_id, high, low, template, first, last): least and largest diagonal of merged neighbours with enough votes."""
    per_template = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), F.col("template") + 1)
    diagonals = hits.groupBy("row", "template", (F.col("place") - F.col("template_place")).alias("diagonal")).agg(F.count("*").alias("votes"), *[F.first(c).alias(c) for c in ("doc_id", "high", "low")])
    along = Window.partitionBy("row", "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along) > per_template([0 if t.exact else NEAR for t in known]), F.lit(True))
    merged = diagonals.withColumn("apart", apart.cast("int")).withColumn("span", F.sum("apart").over(along)).groupBy("row", "template", "span").agg(
        F.sum("votes").alias("votes"), F.min("diagonal").alias("first"), F.max("diagonal").alias("last"), *[F.first(c).alias(c) for c in ("doc_id", "high", "low")])
    return merged.where(F.col("votes") >= per_template([t.votes for t in known])).select("doc_id", "high", "low", "template", "first", "last").distinct()


def best_apart(found: list[tuple[int, float, str, int, int]]) -> list[tuple[int, float, str, int, int]]:
    """Of spans (common words, share of the template, label, begin, end) that overlap, those with the most common words, then the largest share."""
    kept: list[tuple[int, int]] = []
    chosen = []
    for span in sorted(found, key=lambda x: (-x[0], -x[1], x[2:])):
        *_, begin, end = span
        i = bisect.bisect_left(kept, (begin, end))
        if (i and kept[i - 1][1] > begin) or (i < len(kept) and kept[i][0] < end):
            continue
        kept.insert(i, (begin, end))
        chosen.append(span)
    return chosen


def verified(asked: DataFrame, known: list[Template]) -> DataFrame:
    """Labels of documents joined with their ``spans``: doc_id, high, low, n_base, first_word, last_word, base_labels, labels, score.

    Texts that share only an id with the spans' text (other digests) give no row.
    """

    def checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = [masks(list(t.words)) for t in known]
        for batch in batches:
            out: list[tuple] = []
            lists, high, low = batch.column(4), batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for chunk in textvec.chunks(batch.column(1)):
                starts, ends = chunk.spans(INSIDE[chunk.data])
                word_first = np.searchsorted(chunk.doc_of(starts), np.arange(chunk.n_docs + 1))
                raw, halves = textvec.LOWER[chunk.data].tobytes(), digests(chunk).tolist()
                for d in range(chunk.n_docs):
                    row = chunk.first_row + d
                    if halves[d] != [high[row], low[row]]:
                        continue
                    n = int(word_first[d + 1] - word_first[d])
                    base, other = [], []
                    for s in lists[row].as_py():
                        t = known[s["template"]]
                        a, b = max(s["first"], 0), min(s["last"] + len(t.words), n)
                        at = slice(word_first[d] + a, word_first[d] + b)
                        text = [raw[x:y] for x, y in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
                        if t.exact:
                            if tuple(text) == t.words:
                                base.append((a, t.label))
                        elif (same := common_length(bits[s["template"]], len(t.words), text)) >= t.least:
                            other.append((same, same / len(t.words), t.label, a, b))
                    other = best_apart(other)
                    if base or other:
                        labels = {label for _, label in base}
                        places = [a for a, _ in base] or [None]
                        score = 1.0 if base else max(o[1] for o in other)
                        out.append((row, halves[d][0], halves[d][1], len(base), min(places), max(places), ",".join(sorted(labels)), ",".join(sorted(labels | {o[2] for o in other})), score))
            if out:
                rows, *columns = zip(*out, strict=True)
                kinds = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", *TOLD])

    kind = asked.schema["doc_id"].dataType.simpleString()
    return asked.select("doc_id", "text", "high", "low", "spans").mapInArrow(
        checked, f"doc_id {kind}, high long, low long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


TOLD = ("high", "low", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def scan(docs: DataFrame, workspace: Workspace, known: list[Template] | None = None) -> DataFrame:
    """A row for each document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    ``n_base`` counts the places of exact templates, ``first_word`` and ``last_word`` are
    their least and largest first words (null without any).  ``labels`` has those of
    verified spans too: a span has COVER of its template's words in order; of spans that
    overlap the one with the most words counts.  ``score`` is the largest share of a
    template found, 1 for an exact one and 0 without any.

    Null and empty texts have no words and no labels.  Rows that repeat an id keep their
    own results, as texts are told apart by 128-bit digests; repeated rows each give a
    row.  Long texts are worked on whole; the spans of one text are listed in one row, and
    are never more than its words.  Other columns are not read.  An empty table gives no
    rows.
    """
    spark, known = docs.sparkSession, known or templates()
    places = spark.createDataFrame(gram_places(known), "gram long, template int, template_place int")
    rolled = grams(docs).join(F.broadcast(places), "gram", "left").where("template is not null or place < 0").drop("gram")
    hits = workspace.keep("hits", rolled)  # one pass gives the rows their numbers
    found = workspace.keep("spans", spans(hits.where("place >= 0"), known))
    lists = found.groupBy(F.col("doc_id").alias("_id"), "high", "low").agg(F.collect_list(F.struct("template", "first", "last")).alias("spans"))
    if found.count() * 96 <= common.BROADCAST_BYTES:
        lists = F.broadcast(lists)
    asked = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(lists, F.col("doc_id").eqNullSafe(F.col("_id")))
    told = workspace.keep("told", verified(asked, known).dropDuplicates(["doc_id", "high", "low"]))
    rows = hits.where("place < 0").select("doc_id", "n_words", "high", "low")
    told = broadcast_if_small(told.withColumnsRenamed({"doc_id": "_id", "high": "_high", "low": "_low"}), 256)
    joined = rows.join(told, (F.col("high") == F.col("_high")) & (F.col("low") == F.col("_low")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    return joined.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", *[F.coalesce(c, F.lit("")).alias(c) for c in ("base_labels", "labels")], F.coalesce("score", F.lit(0.0)).alias("score"))
