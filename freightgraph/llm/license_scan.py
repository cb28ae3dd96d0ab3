"""License scan by diagonal voting of word k-grams against templates."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from freightgraph.functions.scratch import written
from freightgraph.llm.blocks import blocks, byte_table, gram_hashes, span_hashes, word_spans

K = 2
COVERAGE = 0.85
DRIFT = 3
MARK = 0  # stands for a row itself among its grams

#: Words that mark a license wherever they stand together.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Passages of well-known licenses and notices, each with its label.
TEMPLATES = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files": "mit",
    "licensed under the apache license version 2 0": "apache",
    "you may not use this file except in compliance with the license": "apache",
    "this work is licensed under the gnu general public license version 3": "gpl",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license": "gpl",
    "gnu lesser general public license": "lgpl",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "isc",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "licensed under cc by sa 4 0": "cc-by-sa",
    "licensed under cc by 4 0": "cc-by",
    "this work is licensed under a creative commons attribution": "cc-by",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved no part of this publication may be reproduced": "proprietary",
}

#: Words are runs of 0–9, a–z and everything beyond ASCII, after A–Z are lower-cased.
_PART, _FOLD = byte_table(ranges=[(0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F)])


def _grams(data: np.ndarray, block, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends, first = word_spans(block, _PART)
    hashes, at, place = gram_hashes(span_hashes(_FOLD[data], starts, ends), first, k, short=False)
    return hashes, at, place, first


def template_grams(templates: list[tuple[str, str, bool]], k: int) -> list[tuple[int, int, int]]:
    """(template number, position, gram hash) of every k-gram of every template."""
    batch = pa.RecordBatch.from_arrays([pa.array([t for t, _, _ in templates], pa.string())], ["text"])
    out: list[tuple[int, int, int]] = []
    done = 0
    for block in blocks([batch], "text"):
        hashes, at, place, first = _grams(block.data, block, k)
        for i in range(block.n):
            span = slice(place[i], place[i + 1])
            out += [(done + i, int(p - first[i]), int(h)) for p, h in zip(at[span], hashes[span].view(np.int64), strict=True)]
        done += block.n
    return out


def aligned(words: list[bytes], template: list[bytes]) -> int:
    """How many words of ``template`` stand in ``words`` in its order (the longest common subsequence)."""
    best = [0] * (len(template) + 1)
    for w in words:
        before = 0
        for j, t in enumerate(template, 1):
            before, best[j] = best[j], before + 1 if w == t else max(best[j], best[j - 1])
    return best[-1]


def verified_shares(texts: DataFrame, spans: DataFrame, templates: list[list[bytes]], drift: int) -> DataFrame:
    """(row, template, share): ``spans`` (row, template, diagonal) of ``texts`` (row, text) aligned word by word with their templates; the best of each."""
    wanted = spans.groupBy("row").agg(F.collect_list(F.struct("template", "diagonal")).alias("spans"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            starts, ends, first = word_spans(block, _PART)
            raw = _FOLD[block.data].tobytes()
            out: list[tuple[int, int, float]] = []
            for i, (row, asked) in enumerate(zip(block.batch.column(0).to_pylist(), block.batch.column(1).to_pylist(), strict=True)):
                for span in asked:
                    want = templates[span["template"]]
                    lo, hi = first[i] + max(0, span["diagonal"]), min(first[i + 1], first[i] + span["diagonal"] + len(want) + drift)
                    words = [raw[starts[w] : ends[w]] for w in range(lo, hi)]
                    out.append((row, span["template"], aligned(words, want) / len(want)))
            yield pa.RecordBatch.from_pylist([{"row": r, "template": t, "share": s} for r, t, s in out], pa.schema([("row", pa.int64()), ("template", pa.int32()), ("share", pa.float64())]))

    rows = texts.join(wanted, "row").select("row", "spans", "text")
    return rows.mapInArrow(run, "row long, template int, share double").groupBy("row", "template").agg(F.max("share").alias("share"))


def scan_licenses(
    docs: DataFrame, key: str = "doc_id", text: str = "text", base: dict[str, str] = BASE, templates: dict[str, str] = TEMPLATES,
    k: int = K, coverage: float = COVERAGE, drift: int = DRIFT,
) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score) for every row.

    The rolling hashes of all word k-grams are joined to the templates' positions; a match votes for the
    diagonal document position − template position. A base phrase stands where one diagonal holds all
    its grams (``n_base``, ``first_word``, ``last_word``). For the longer templates, the votes of a
    diagonal and of those up to ``drift`` after it (words put in) are merged; where they are the share
    ``coverage`` of the template's grams, the span of words that the diagonal points at, and no other,
    is aligned with the template word by word, and counts if that share of the template's words stands
    there in order. So words that are scattered or out of order are no license, however many there are.
    ``score`` is 1 with a base phrase, else the largest share: of words where a span was aligned, of
    grams elsewhere.

    Each text is read once, and those with spans to align a second time; no text is shuffled, as the
    templates, which the caller holds, are broadcast to the grams, and only matches go on.
    A null or empty text has no words, nulls for the places, empty labels and score 0; repeated rows
    are scanned each; an empty table gives an empty result; other columns are ignored. Base phrases have
    at least k words.
    """
    spark = docs.sparkSession
    kind = dict(docs.dtypes)[key]
    all_of = [*((t, label, True) for t, label in base.items()), *((t, label, False) for t, label in templates.items())]
    grams = template_grams(all_of, k)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in blocks(batches, "text"):
            hashes, at, place, first = _grams(block.data, block, k)
            doc = np.repeat(np.arange(block.n), np.diff(place))
            # a row's own mark goes before its grams, so that it leaves the join even without a match
            found = pa.StructArray.from_arrays(
                [pa.array(np.insert(at - first[doc], place[:-1], -1)), pa.array(np.insert(hashes.view(np.int64), place[:-1], MARK))], ["pos", "gram"])
            bounds = (place + np.arange(block.n + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [*(block.batch.column(i) for i in (0, 1)), pa.array(np.diff(first).astype(np.int64)), pa.ListArray.from_arrays(pa.array(bounds), found)], ["row", "key", "n_words", "grams"])

    texts = docs.select(F.xxhash64(docs[key], docs[text]).alias("row"), docs[key].alias("key"), docs[text].cast("string").alias("text"))
    positions = spark.createDataFrame([*grams, (-1, 0, MARK)], "template int, t_pos int, gram long")
    matches = written(
        texts.mapInArrow(run, f"row long, key {kind}, n_words long, grams array<struct<pos:long,gram:long>>")
        .select("row", "key", "n_words", F.inline("grams")).join(F.broadcast(positions), "gram")
        .where("(pos < 0) = (template < 0)").drop("gram"),
        "license_matches",
    )
    rows = matches.where("template < 0").select("row", "key", "n_words")
    size = {t: sum(1 for x, _, _ in grams if x == t) for t in range(len(all_of))}
    facts = F.broadcast(spark.createDataFrame([(t, label, is_base, size[t]) for t, (_, label, is_base) in enumerate(all_of)], "template int, label string, is_base boolean, size int"))
    votes = written(
        matches.where("template >= 0").groupBy("row", "template", (F.col("pos") - F.col("t_pos")).alias("diagonal"))
        .agg(F.count_distinct("t_pos").alias("held")).join(facts, "template"),  # rows that repeat key and text vote once
        "license_votes",
    )
    placed = (
        votes.where("is_base and held = size")
        .groupBy("row")
        .agg(F.count("*").alias("n_base"), F.min("diagonal").alias("first_word"), F.max("diagonal").alias("last_word"), F.collect_set("label").alias("base"))
    )
    near = Window.partitionBy("row", "template").orderBy("diagonal").rangeBetween(0, drift)
    merged = votes.where("not is_base").withColumn("share", F.least(F.lit(1.0), F.sum("held").over(near) / F.col("size")))
    spans = written(merged.where(F.col("share") >= coverage).select("row", "template", "diagonal"), "license_spans")
    words = [t.encode().split() for t, _, _ in all_of]
    exact = verified_shares(texts, spans, words, drift).join(facts, "template")
    found = exact.groupBy("row").agg(F.max("share").alias("share"), F.collect_set(F.when(F.col("share") >= coverage, F.col("label"))).alias("more"))
    loose = merged.where(F.col("share") < coverage).groupBy("row").agg(F.max("share").alias("loose"))
    none = F.array().cast("array<string>")
    joined = lambda c: F.array_join(F.array_sort(c), ",")
    return rows.join(placed, "row", "left").join(found, "row", "left").join(loose, "row", "left").select(
        F.col("key").alias(key), "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        joined(F.coalesce("base", none)).alias("base_labels"),
        joined(F.array_union(F.coalesce("base", none), F.coalesce("more", none))).alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.greatest(F.coalesce("share", F.lit(0.0)), F.coalesce("loose", F.lit(0.0)))).alias("score"),
    )
