"""License scan by diagonal voting.

Every rolling word 3-gram of every text is hashed and joined to the positions of the same grams in license templates.
A match of text position p with template position t votes for the diagonal p - t. Votes are counted by diagonal,
diagonals a few words apart are merged (words inserted or left out), and a span counts if it covers enough of its
template. Hits are verified by a second, independent 64-bit hash in the join, so no text is shuffled.

Nulls and empty texts have no words and no labels; a very long text may hold any number of spans. Rows are told apart by
their place in the input, so repeated rows give repeated results; an empty table gives an empty one. Columns other than
the id and the text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from . import common as C

K = 3
#: Phrases that name a license by themselves.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}
#: Sentences of public licenses; a span that covers enough of one names the license.
SENTENCES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
    "apache-2": "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0",
    "bsd": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "gpl": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "isc": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "mpl-2": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "cc-by": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "all-rights-reserved": "no part of this publication may be reproduced distributed or transmitted in any form or by any means without the prior written permission of the publisher",
}
#: The templates are broadcast; more grams than this are refused.
MOST_GRAMS = 100_000

SCHEMA = "rid long, doc_id long, pos int, h long, v long"


def grams(low: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of lowered texts: words in each; then text, position and two hashes of each rolling gram."""
    start, end, text = C.words(low, at, C.ALNUM)
    counts = np.bincount(text, minlength=len(at) - 1)[: len(at) - 1]
    a, b = C.hash_words(low, start, end, 2)
    m = len(a) - K + 1
    if m <= 0:
        none = np.zeros(0, np.int64)
        return counts, none, none, none, none
    hashes = []
    for w in (a, b):
        h = np.zeros(m, np.uint64)
        for i in range(K):
            h = C.mix(h + w[i : m + i])
        hashes.append(h | np.uint64(1))
    whole = np.flatnonzero(text[:m] == text[K - 1 :])
    head = np.cumsum(counts) - counts
    return counts, text[whole], whole - head[text[whole]], *(h[whole].view(np.int64) for h in hashes)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rid, doc = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        for i, j in C.parts(batch.column(2)):
            raw, at = C.string_bytes(batch.column(2).slice(i, j - i))
            counts, text, pos, h, v = grams(C.LOWER[raw], at)
            zero = np.zeros(j - i, np.int64)
            row = pa.array(np.concatenate([np.arange(i, j), text + i]))
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid).take(row), doc.take(row), pa.array(np.concatenate([counts, pos]).astype(np.int32)), pa.array(np.concatenate([zero, h])), pa.array(np.concatenate([zero, v]))],
                names=["rid", "doc_id", "pos", "h", "v"],
            )


def templates(phrases: dict[str, str], sentences: dict[str, str]) -> tuple[list[tuple], list[tuple]]:
    """Rows (h, v, tpl, tpos) of all grams and (tpl, label, base, length); row 0 marks a text's own row."""
    rows, heads, tpl = [(0, 0, -1, 0)], [], 0
    for base, some in ((True, phrases), (False, sentences)):
        for label, text in some.items():
            raw = np.frombuffer(text.encode(), np.uint8)
            counts, _, pos, h, v = grams(C.LOWER[raw], np.array([0, len(raw)]))
            if counts[0] < K:
                raise ValueError(f"a template needs {K} words: {text!r}")
            rows += [(int(x), int(y), tpl, int(p)) for x, y, p in zip(h, v, pos, strict=True)]
            heads.append((tpl, label, base, int(counts[0])))
            tpl += 1
    if len(rows) > MOST_GRAMS:
        raise ValueError(f"templates have {len(rows)} grams; at most {MOST_GRAMS} are broadcast")
    return rows, heads


def _covered(at: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(at, lambda t: F.transform(F.sequence(F.lit(0), F.lit(K - 1)), lambda i: t + i))))


def license_spans(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] = PHRASES, sentences: dict[str, str] = SENTENCES, band: int = 4, cover: float = 0.8) -> DataFrame:
    """Verified spans and each text's own row: rid, doc_id, n_words (own row), label, base, first, last, score."""
    C.arrow_limits(spark)
    rows, heads = templates(phrases, sentences)
    table = spark.createDataFrame(rows, "h long, v long, tpl int, tpos int")
    head = spark.createDataFrame(heads, "tpl int, label string, base boolean, length int")
    source = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    hits = source.mapInArrow(_scan, SCHEMA).join(F.broadcast(table), ["h", "v"]).select("rid", "doc_id", "pos", "tpl", "tpos")
    # One exchange by text serves the counts by diagonal, the merging and the result.
    hits = hits.repartition("rid")
    votes = hits.groupBy("rid", "doc_id", "tpl", (F.col("pos") - F.col("tpos")).alias("diag")).agg(F.count("*").alias("n"), F.collect_set("tpos").alias("at"), F.max(F.when(F.col("tpl") < 0, F.col("pos"))).alias("n_words"))
    votes = votes.join(F.broadcast(head), "tpl", "left")
    by = W.partitionBy("rid", "doc_id", "tpl").orderBy("diag")
    far = F.coalesce(F.col("base"), F.lit(True)) | F.lag("diag").over(by).isNull() | (F.col("diag") - F.lag("diag").over(by) > band)
    merged = votes.withColumn("span", F.sum(far.cast("int")).over(by.rowsBetween(W.unboundedPreceding, 0)))
    spans = merged.groupBy("rid", "doc_id", "tpl", "span").agg(
        F.max("n_words").alias("n_words"), F.first("label").alias("label"), F.first("base").alias("base"), F.first("length").alias("length"), F.sum("n").alias("n"),
        F.min(F.col("diag") + F.array_min("at")).alias("first"), F.max(F.col("diag") + F.array_max("at") + K - 1).alias("last"), F.flatten(F.collect_list("at")).alias("at"),
    )
    score = F.when(F.col("base"), (F.col("n") == F.col("length") - K + 1).cast("double")).otherwise(F.least(F.lit(1.0), F.size(_covered("at")) / F.col("length")))
    spans = spans.withColumn("score", F.when(F.col("tpl") >= 0, score))
    return spans.where((F.col("tpl") < 0) | F.when(F.col("base"), F.col("score") == 1.0).otherwise(F.col("score") >= cover)).select("rid", "doc_id", "n_words", "label", "base", "first", "last", "score")


def license_scan(spark: SparkSession, docs: DataFrame, **options) -> DataFrame:
    """A row for each text: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    base = F.col("base")
    found = license_spans(spark, docs, **options).groupBy("rid", "doc_id").agg(
        F.max("n_words").cast("long").alias("n_words"), F.count(F.when(base, 1)).alias("n_base"),
        F.min(F.when(base, F.col("first"))).cast("long").alias("first_word"), F.max(F.when(base, F.col("first"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(base, F.col("label")))), ",").alias("base_labels"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"),
        F.coalesce(F.max("score"), F.lit(0.0)).alias("score"), F.count("label").alias("n_spans"),
    )
    return found.drop("rid")
