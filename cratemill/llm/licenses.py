"""License scans by diagonal voting.

Rolling word k-grams of all texts are joined to the places of the same k-grams in templates.  Every hit votes for a template and a
diagonal (place in the text minus place in the template).  A base phrase is found where all its k-grams vote for one
diagonal; for a longer notice, neighbouring diagonals are merged (a word may be inserted or missing) and the merged
span is verified: enough of the notice's words must be covered by hits whose words are equal, not only their hashes.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, textscan


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    k: int  # length of its k-grams
    base: bool = False


#: The base phrases and labels.
BASE = [
    Template("gpl", "gnu general public license", 2, True),
    Template("apache", "apache license", 2, True),
    Template("cc-by", "cc by", 2, True),
    Template("mit", "mit license", 2, True),
]
#: Notices by which well-known licenses are told (SPDX identifiers as labels).
NOTICES = [
    Template(label, text, 3)
    for label, text in (
        ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
        ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"),
        ("GPL-3.0", "licensed under the GNU General Public License, version 3"),
        ("GPL-2.0", "licensed under the GNU General Public License, version 2"),
        ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
        ("MIT", "Licensed under the MIT License"),
        ("MIT", "Released under the MIT License"),
        ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
        ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
        ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
        ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
        ("CC-BY-4.0", "Licensed under CC BY 4.0"),
        ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
        ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
        ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"),
        ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
        ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
        ("Unlicense", "This is free and unencumbered software released into the public domain"),
    )
]


def _lowered(w: textscan.Words, i: int, k: int) -> str:
    return " ".join(bytes(w.data[w.start[j] : w.end[j]]).decode().translate(_ASCII_LOWER) for j in range(i, i + k))


_ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def grams(texts: pa.Array, ks: tuple[int, ...], only: common.KeyFilter | None) -> tuple[np.ndarray, list[list[dict]]]:
    """For each text the number of words and its k-grams: k, at (word), gram (hash), words."""
    w = textscan.scan(texts)
    first = w.first
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    for k in ks:
        g = textscan.grams(w.hash, k)
        keep = textscan.within_row(w.row, k)
        if only is not None:
            keep &= only.maybe(g)
        for i in np.flatnonzero(keep):
            out[w.row[i]].append({"k": k, "at": int(i - first[w.row[i]]), "gram": int(g[i].astype(np.int64)), "words": _lowered(w, i, k)})
    return np.diff(first), out


def template_grams(docs: DataFrame, templates: list[Template]) -> DataFrame:
    """(template, label, base, size, k, at, gram, words): the templates' k-grams, a small literal table."""
    rows = []
    for i, t in enumerate(templates):
        n, found = grams(pa.array([t.text]), (t.k,), None)
        rows += [(i, t.label, t.base, int(n[0]), t.k, x["at"], x["gram"], x["words"]) for x in found[0]]
    values = ", ".join(f"({i}, '{label}', {str(base).lower()}, {size}, {k}, {at}, {gram}L, '{words}')" for i, label, base, size, k, at, gram, words in rows)
    return docs.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(template, label, base, size, k, t_at, gram, t_words)")


def licenses(docs: DataFrame, templates: list[Template] | None = None, gap: int = 2, covered: float = 0.8) -> DataFrame:
    """Of every row of docs (doc_id, text): doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    Words are letters and digits, A-Z lower-cased; whole texts, null is empty. n_base counts all places of base phrases. A
    notice is found where `covered` of its words are, on diagonals at most `gap` apart. score: the best share of a
    notice that was found; 0.5 if there are only base phrases; else 0. Without a place first_word and last_word are
    null, without labels the lists are empty strings. Repeated rows give repeated result rows; other columns are ignored.
    """
    templates = [*BASE, *NOTICES] if templates is None else templates
    ks = tuple(sorted({t.k for t in templates}))
    table = template_grams(docs, templates)
    held = docs.sparkSession.sparkContext.broadcast(common.KeyFilter.of(table, "gram"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    hit = pa.list_(pa.struct([("k", pa.int32()), ("at", pa.int32()), ("gram", pa.int64()), ("words", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi in textscan.row_groups(b.column(2)):
                n, found = grams(b.column(2).slice(lo, hi - lo), ks, held.value)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), b.column(1).slice(lo, hi - lo), pa.array(n, pa.int64()), pa.array(found, hit)], ["doc_id", "tag", "n_words", "hits"])

    rows = common.pick(docs, "doc_id", "text").select("doc_id", common.text_tag(F.col("text")).alias("tag"), "text")
    rows = common.materialize(rows.mapInArrow(run, f"doc_id {kind}, tag long, n_words long, hits array<struct<k:int,at:int,gram:long,words:string>>"), "license-grams")
    hits = rows.select("doc_id", "tag", F.explode("hits").alias("h")).select("doc_id", "tag", "h.*")
    votes = hits.join(table, ["k", "gram"]).where(F.col("words") == F.col("t_words"))
    key = ["doc_id", "tag"]
    diagonals = votes.groupBy(*key, "template", "label", "base", "size", "k", (F.col("at") - F.col("t_at")).alias("diagonal")).agg(F.collect_set("t_at").alias("t_at"))
    diagonals = common.materialize(diagonals, "diagonals")
    places = diagonals.where(F.col("base") & (F.size("t_at") == F.col("size") - F.col("k") + 1))
    base = places.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_base"),
        F.min("diagonal").cast("long").alias("first_word"),
        F.max("diagonal").cast("long").alias("last_word"),
        F.collect_set("label").alias("base_set"),
    )
    line = Window.partitionBy(*key, "template").orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(line) > gap).cast("int"), F.lit(1))
    merged = diagonals.where(~F.col("base")).withColumn("apart", apart).withColumn("band", F.sum("apart").over(line))
    words = F.transform("t_at", lambda t: F.sequence(t, t + F.col("k") - 1))
    merged = merged.withColumns({"words": F.flatten(words), "lo": F.col("diagonal") + F.array_min("t_at"), "hi": F.col("diagonal") + F.array_max("t_at") + F.col("k")})
    spans = merged.groupBy(*key, "template", "label", "size", "band").agg(F.size(F.array_distinct(F.flatten(F.collect_list("words")))).alias("n"), F.min("lo").alias("start"), F.max("hi").alias("end"))
    spans = spans.withColumn("share", F.col("n") / F.col("size")).where(F.col("share") >= covered)
    more = spans.groupBy(*key).agg(F.collect_set("label").alias("more_set"), F.max("share").alias("share"), F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("spans"))
    # one row for each document with a label: base and notices side by side
    both = base.unionByName(more, allowMissingColumns=True).groupBy(*key)
    per_doc = both.agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("n_base", "first_word", "last_word", "base_set", "more_set", "share", "spans"))).withColumnsRenamed({"doc_id": "d", "tag": "t"})
    empty = F.array().cast("array<string>")
    joined = rows.join(per_doc, common.same(rows["doc_id"], per_doc["d"]) & (rows["tag"] == per_doc["t"]), "left")
    base_set, more_set = F.coalesce("base_set", empty), F.coalesce("more_set", empty)
    return joined.select(
        "doc_id", "n_words",
        F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.array_join(F.array_sort(base_set), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base_set, more_set)), ",").alias("labels"),
        F.coalesce("share", F.when(F.col("n_base") > 0, 0.5), F.lit(0.0)).alias("score"),
        "spans",
    )
