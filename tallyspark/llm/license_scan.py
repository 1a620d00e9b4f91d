"""License scans by diagonal voting.

Every rolling pair of words of every text is hashed and joined, by Spark, to the positions of the
same pairs in the templates. A hit at word p of a text and word q of a template votes for the
diagonal p - q. Votes are summed by diagonal; a diagonal with more votes than its neighbours (at
most ``REACH`` words of insertions or deletions away) takes their hits over. Such a span is then
verified: only the longest chain of its hits counts in which the words of text and template both
go forward. It lies within the template's length and REACH words at both ends, and it is a licence
if the chain covers enough of the template. A base phrase counts at each diagonal where all of its
pairs stand.

Scale: the templates are a fixed table, so their side is broadcast. Pairs that don't match end in
the join, before any shuffle; the shuffle has one row per document plus its hits. Nothing is grouped
by word or by template alone, so frequent words and passages make no hot key.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import text_of

#: Phrases whose places are counted exactly, and their labels.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Wording of public licences and the label that each adds.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "licensed under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"),
    ("apache-2.0", "licensed under the apache license version 2 0"),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", "licensed under the bsd license"),
    ("gnu-gpl-3", "licensed under the gnu general public license version 3"),
    ("gnu-gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation"),
    ("gnu-lgpl", "licensed under the gnu lesser general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by-sa", "licensed under cc by sa 4 0"),
    ("cc-license", "licensed under a creative commons attribution license"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("no-warranty", "the software is provided as is without warranty of any kind express or implied"),
    (
        "mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation "
        "the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    ),
    (
        "bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice "
        "this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    (
        "apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
    ),
    (
        "apache-2.0", "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce "
        "prepare derivative works of publicly display publicly perform sublicense and distribute the work and such derivative works in source or object form",
    ),
    ("gnu-gpl", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gnu-gpl", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gnu-gpl", "the licenses for most software and other practical works are designed to take away your freedom to share and change the works by contrast the gnu general public license is intended to guarantee your freedom to share and change all versions of a program"),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at"),
    (
        "zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions "
        "the origin of this software must not be misrepresented you must not claim that you wrote the original software",
    ),
    ("unlicense", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
]
#: A pair of these words only is no vote.
STOP = frozenset("a an and any are as at be by for from in is it of on or that the this to under was with you".split())
COVER = 0.7
REACH = 6
CHUNK = 1 << 20
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")

_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[(_BYTES >= 65) & (_BYTES <= 90)] += 32
_BYTES[[x for x in range(128) if not (48 <= x <= 57 or 65 <= x <= 90 or 97 <= x <= 122)]] = 0


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


def pair_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts that lie one after another in data: words of each text; text, position and hash of each pair.

    A word is a run of bytes that are digits, letters (A-Z count as a-z) or not ASCII; this is the
    pattern [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ over UTF-8.
    """
    n_texts = len(offsets) - 1
    low = _BYTES[data[offsets[0] : offsets[-1]]]
    offsets = offsets - offsets[0]
    word = low != 0
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = word[firsts]
    starts = np.flatnonzero(begins)
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return np.zeros(n_texts, dtype=np.int64), none, none, none
    lengths = np.diff(np.append(starts, len(low)))
    at = np.arange(starts[0], len(low)) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        powers = np.multiply.accumulate(np.full(int(lengths.max()), 0x9E3779B97F4A7C15, dtype=np.uint64))
        hashes = _mix(np.add.reduceat(low[starts[0] :].astype(np.uint64) * powers[at], starts - starts[0]))
        pairs = _mix(hashes[:-1] * np.uint64(0xD6E8FEB86659FD93) + hashes[1:])
    text = np.searchsorted(offsets, starts, side="right") - 1
    counts = np.bincount(text, minlength=n_texts)
    position = np.arange(len(starts)) - np.repeat(np.cumsum(counts) - counts, counts)
    same = text[:-1] == text[1:]
    return counts, text[:-1][same], position[:-1][same], pairs[same].view(np.int64)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, id, pos, h): a row per pair (pos: its place), and one per text (h null, pos: its words)."""
    names = ["row", "_id", "pos", "h"]
    row = TaskContext.get().partitionId() << 36
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2], dtype=np.uint8) if texts.buffers()[2] else np.zeros(0, dtype=np.uint8)
        a = 0
        while a < len(texts):
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + CHUNK, side="right")) - 1)
            words, text, position, hashes = pair_hashes(data, offsets[a : b + 1])
            yield pa.RecordBatch.from_arrays([pa.array(row + np.arange(a, b)), ids.slice(a, b - a), pa.array(words), pa.nulls(b - a, pa.int64())], names=names)
            if len(text):
                yield pa.RecordBatch.from_arrays([pa.array(row + a + text), pa.nulls(len(text), pa.int64()), pa.array(position), pa.array(hashes)], names=names)
            a = b
        row += len(texts)


def template_pairs(spark: SparkSession, templates: list[tuple[str, str]]) -> DataFrame:
    """h, t (the template), q (position in it), label, base, n (its pairs): a table of a fixed size."""
    rows = []
    for t, (label, text) in enumerate([(label, phrase) for phrase, label in BASE] + templates):
        words, data = text.split(), text.encode()
        _, _, position, hashes = pair_hashes(np.frombuffer(data, dtype=np.uint8), np.array([0, len(data)]))
        kept = [(int(h), t, int(q)) for q, h in zip(position, hashes, strict=True) if t < len(BASE) or not STOP.issuperset(words[q : q + 2])]
        rows += [(*x, label, t < len(BASE), len(kept)) for x in kept]
    return spark.createDataFrame(rows, "h long, t int, q long, label string, base boolean, n int")


def chain(hits: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of hits (p, q) in which both grow; of equally long ones the one that ends first."""
    best: list[int] = []  # of each length the least q that ends a run
    at: list[int] = []
    back: list[int] = []
    hits = sorted(hits, key=lambda x: (x[0], -x[1]))
    for i, (_, q) in enumerate(hits):
        k = bisect.bisect_left(best, q)
        back.append(at[k - 1] if k else -1)
        if k == len(best):
            best.append(q)
            at.append(i)
        else:
            best[k], at[k] = q, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(hits[i])
        i = back[i]
    return out[::-1]


def _verified(spans: pd.Series) -> pd.DataFrame:
    """Hits, first and last word of each span's chain; spans: arrays of (p, q), or null."""
    rows = []
    for span in spans:
        run = [] if span is None else chain([(x["p"], x["q"]) for x in span])
        rows.append((len(run), run[0][0], run[-1][0] + 2) if run else (0, None, None))
    return pd.DataFrame(rows, columns=["hits", "first", "last"]).astype({"hits": "int32", "first": "Int64", "last": "Int64"})


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    n_base: places of base phrases; first_word, last_word: their smallest and largest start (null
    if none). base_labels, labels: distinct, sorted, comma-joined ('' if none); labels has those of
    the base and of the templates. score: the largest covered share of a template or base phrase
    among the labels found, else 0. spans: (label, first word, word after the last, covered share)
    of each span found, sorted.

    A null or empty text has no words and no labels. Equal rows each give a row; a null id stays
    null. Other columns are not read. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text"))
    pairs = source.mapInArrow(_pairs, "row long, _id long, pos long, h long")
    table = template_pairs(spark, TEMPLATES if templates is None else templates)
    hits = pairs.join(F.broadcast(table), "h", "left").where("h IS NULL OR t IS NOT NULL")
    votes = hits.groupBy("row", "t", (F.col("pos") - F.col("q")).alias("d")).agg(
        F.max("_id").alias("_id"), F.max(F.when(F.col("h").isNull(), F.col("pos"))).alias("n_words"), F.collect_set("q").alias("qs"),
        F.first("label").alias("label"), F.first("base").alias("base"), F.first("n").alias("n"),
    )
    # Diagonals within reach are few, and each has at most the template's pairs, so what a window gathers is bounded.
    near = Window.partitionBy("row", "t").orderBy("d").rangeBetween(-REACH, REACH)
    strength = F.struct(F.size("qs"), -F.col("d"))
    own = F.when(F.col("t").isNotNull() & ~F.col("base"), F.transform("qs", lambda q: F.struct((q + F.col("d")).alias("p"), q.alias("q"))))
    leads = votes.withColumn("_leads", strength == F.max(strength).over(near)).withColumn("_near", F.flatten(F.collect_list(own).over(near)))
    enough = F.col("_leads") & (F.size(F.array_distinct(F.transform("_near", lambda x: x["q"]))) >= COVER * F.col("n"))
    verified = F.pandas_udf(_verified, "hits int, first long, last long")
    spans = leads.withColumn("_v", verified(F.when(~F.col("base") & enough, F.col("_near"))))
    cover = F.when(F.col("base"), F.size("qs") / F.col("n")).otherwise(F.col("_v.hits") / F.col("n"))
    base = F.col("base") & (F.size("qs") == F.col("n"))
    found = base | ~F.col("base") & (cover >= COVER)
    first = F.when(base, F.col("d") + F.array_min("qs")).otherwise(F.col("_v.first"))
    last = F.when(base, F.col("d") + F.array_max("qs") + 2).otherwise(F.col("_v.last"))
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(F.when(which, F.col("label")))), ",")
    return spans.groupBy("row").agg(
        F.max("_id").alias(id_col), F.max("n_words").alias("n_words"), F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("d"))).alias("first_word"), F.max(F.when(base, F.col("d"))).alias("last_word"),
        joined(base).alias("base_labels"), joined(found).alias("labels"), F.coalesce(F.max(F.when(found, cover)), F.lit(0.0)).alias("score"),
        F.array_sort(F.collect_list(F.when(found, F.struct(F.col("label").alias("label"), first.alias("first"), last.alias("last"), cover.alias("cover"))))).alias("spans"),
    ).drop("row")
