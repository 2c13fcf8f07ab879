"""License scans: phrases, and an exact set-similarity join of text blocks with templates; DataFrame functions only."""

from __future__ import annotations

import functools
import math
import operator
import re
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import materialize

_SEP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}



class Template(NamedTuple):
    """A license text, the words that tell it from others, and words that make it another one."""

    label: str
    text: str
    must: str = ""
    never: str = ""


#: License statements in their usual wording; more, or whole licenses, can be given to the operator.
TEMPLATES = [
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache 2"),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "redistribution binary permitted"),
    Template("cc-by-4.0", "Licensed under a Creative Commons Attribution 4.0 International License", "commons attribution 4", "noncommercial noderivatives sharealike nc nd sa"),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", "cc by 4", "nc nd sa"),
    Template("cc-by-nc-4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License", "commons noncommercial 4", "noderivatives sharealike nd sa"),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", "cc by nc 4", "nd sa"),
    Template("gpl-2.0", "Licensed under the GNU General Public License, version 2", "gnu general public 2", "lesser library affero"),
    Template("gpl-3.0", "Licensed under the GNU General Public License, version 3", "gnu general public 3", "lesser library affero"),
    Template("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "gnu general public 3", "lesser library affero"),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "permission fee granted"),
    Template("mit", "Released under the MIT License", "mit license"),
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "permission granted charge software"),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "mozilla public 2"),
]
THRESHOLD = 0.8


def all_words(text: str) -> list[str]:
    """The words of a template (ASCII), as the operator takes words."""
    return re.findall(r"[0-9a-z]+", text.lower())


def template_words(text: str) -> list[str]:
    return sorted(set(all_words(text)))


def width(text: str) -> int:
    """Words of a block that is held against the template: half as many again as it has, repeats counted."""
    return len(all_words(text)) * 3 // 2


def _ascii_lower(text: Column) -> Column:
    """A-Z lower-cased.  Other letters may change too, but none becomes an ASCII letter: the two that would go the slow way."""
    return F.when(text.rlike("[İK]"), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def _words_before(prefix: Column) -> Column:
    return (F.length(prefix) - F.length(F.replace(prefix, F.lit(" "), F.lit(""))) - 1).cast("long")


def _phrases(text: Column) -> dict[str, Column]:
    """Places of the phrases.  Only a text in which a phrase's letters follow each other is normalised at all."""
    loose = "|".join(_SEP.join(p.split()) for p in PHRASES)
    flat = F.concat(F.lit(" "), F.trim(F.regexp_replace(_ascii_lower(text), _SEP, " ")), F.lit(" "))
    any_of = "(?<= )(?:" + "|".join(PHRASES) + ")(?= )"
    seen = text.rlike(f"(?i){loose}")
    hit = F.when(seen, flat)
    has = {label: hit.contains(f" {p} ") for p, label in PHRASES.items()}
    return {
        "n_base": F.coalesce(F.regexp_count(hit, F.lit(any_of)).cast("long"), F.lit(0).cast("long")),
        "_first": F.regexp_extract(hit, f"(?s)^(.*?){any_of}", 1),
        "_last": F.regexp_extract(hit, f"(?s)^(.*){any_of}", 1),
        "_base": F.array_compact(F.array(*(F.when(c, F.lit(label)) for label, c in has.items()))),
    }


def _index(templates: list[Template], rank: dict[str, int], threshold: float) -> pa.Table:
    """A row for each prefix word of each template: its rarest words, one of which every block that contains enough must hold."""
    rows = []
    for n, t in enumerate(templates):
        ordered, own = sorted(template_words(t.text), key=rank.__getitem__), {"template": n, "label": t.label, "width": width(t.text)}
        need = needed(len(ordered), threshold)
        for i, word in enumerate(ordered[: len(ordered) - need + 1]):
            rows.append(own | {"token": word, "i": i, "m": len(ordered), "need": need, "words": ordered, "must": t.must.split(), "never": t.never.split()})
    kinds = [("template", pa.int32()), ("label", pa.string()), ("width", pa.int32()), ("token", pa.string()), *((c, pa.int32()) for c in ("i", "m", "need"))]
    return pa.Table.from_pylist(rows, pa.schema([*kinds, *((c, pa.list_(pa.string())) for c in ("words", "must", "never"))]))


def needed(m: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * m - 1e-9))


def _best_block() -> Column:
    """The most template words that a block from one of them on holds, of blocks that hold all of ``must`` and none of ``never``; else 0."""

    def held(h: Column, j: Column) -> Column:
        block = F.filter(F.slice("hits", j + 1, F.col("width")), lambda x: x["i"] < h["i"] + F.col("width"))
        words = F.transform(block, lambda x: x["w"])
        good = (F.size(F.array_intersect("must", words)) == F.size("must")) & ~F.arrays_overlap("never", words)
        return F.when(F.array_contains(F.col("words"), h["w"]) & good, F.size(F.array_intersect("words", words))).otherwise(0)

    return F.coalesce(F.array_max(F.transform("hits", held)), F.lit(0))


def scan_licenses(docs: DataFrame, *, templates: list[Template] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of ``docs``.

    A block is a run of words from a template's word on, half as long again as the
    template, over line ends.  A template is found where a block holds at least
    ``threshold`` of its distinct words, all that it must hold (version numbers, names)
    and none that would make it another license.  ``labels`` has the phrases' labels and those of the
    templates found; ``score`` is the largest such share (1 for a phrase, 0 for none).

    Each text keeps the words that templates use, in the order of in how many texts
    they are.  They meet the templates at prefix words, under length and positional
    bounds; in those texts alone blocks are verified.  Null and empty texts have no
    words; rows with a null or repeated doc_id are scanned like any other; a very long
    text is scanned whole, in its row; other columns are ignored.
    """
    spark = docs.sparkSession
    known = [t for t in (TEMPLATES if templates is None else templates) if template_words(t.text)]
    vocabulary = sorted({w for t in known for w in template_words(t.text)})
    strings = lambda ws: F.array(*map(F.lit, ws)) if ws else F.array().cast("array<string>")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.withColumn("words", F.array_remove(F.split(_ascii_lower(F.col("text")), _SEP), ""))
    rows = rows.withColumn("tokens", F.array_intersect("words", strings(vocabulary)))
    any_must = [F.forall(strings(t.must.split()), lambda w: F.array_contains(F.col("tokens"), w)) for t in known]
    marked = strings(sorted({*vocabulary, *(w for t in known for w in t.never.split())}))
    placed = F.transform("words", lambda w, i: F.struct(i.alias("i"), w.alias("w")))
    scanned = rows.select(
        F.monotonically_increasing_id().alias("rid"),
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        "tokens",
        F.when(functools.reduce(operator.or_, any_must, F.lit(False)), F.filter(placed, lambda x: F.array_contains(marked, x["w"]))).alias("hits"),
        *(c.alias(k) for k, c in _phrases(F.col("text")).items()),
    )
    scanned = materialize(scanned, "license-words")

    common = scanned.select(F.explode("tokens").alias("token")).groupBy("token").count()
    counts = {r["token"]: r["count"] for r in common.collect()}  # one row for each template word
    ordered = sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))
    index = spark.createDataFrame(_index(known, {w: i for i, w in enumerate(ordered)}, threshold))
    texts = scanned.where("hits IS NOT NULL").select("rid", "hits", F.array_intersect(strings(ordered), "tokens").alias("tokens"))
    met = texts.select("rid", "hits", F.size("tokens").alias("k"), F.posexplode("tokens").alias("j", "token"))
    met = met.join(F.broadcast(index), "token").where("k >= need AND least(m - i, k - j) >= need")
    # a template meets a text at each prefix word that both hold: only the first one goes on
    first = F.array_min(F.transform("words", lambda w: F.when(F.array_contains(F.transform("hits", lambda x: x["w"]), w), F.array_position("words", w))))
    both = met.where(F.col("i") + 1 == first).withColumn("both", _best_block()).where("both >= need")
    found = both.groupBy("rid").agg(F.collect_set("label").alias("more"), F.max(F.col("both") / F.col("m")).alias("share"))

    out = scanned.drop("tokens", "hits").join(found, "rid", "left")
    labels = F.array_sort(F.array_union("_base", F.coalesce("more", F.array().cast("array<string>"))))
    return out.select(
        "doc_id",
        "n_words",
        "n_base",
        F.when(F.col("n_base") > 0, _words_before(F.col("_first"))).alias("first_word"),
        F.when(F.col("n_base") > 0, _words_before(F.col("_last"))).alias("last_word"),
        F.array_join(F.array_sort("_base"), ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )


def _oracle() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    listed = lambda ws: f"{ws!r}::VARCHAR[]"
    rows = ", ".join(f"({n}, '{t.label}', {listed(template_words(t.text))}, {listed(t.must.split())}, {listed(t.never.split())}, {width(t.text)})" for n, t in enumerate(TEMPLATES))
    at = []
    for phrase, label in PHRASES.items():
        words = phrase.split()
        same = " AND ".join(f"ws[i + {n}] = '{w}'" if n else f"ws[i] = '{w}'" for n, w in enumerate(words))
        at.append(f"list_transform(list_filter(range(1, len(ws) + 1), lambda i: {same}), lambda i: {{'p': i - 1, 'l': '{label}'}})")
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS ws FROM d),
b AS (SELECT *, list_concat(list_concat({at[0]}, {at[1]}), {at[2]}) AS hits FROM w),
templates(t, label, words, must, never, width) AS (VALUES {rows}),
places AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM w),
own AS (SELECT doc_id, t, p, word, list_contains(words, word) AS mine FROM places, templates WHERE list_contains(words, word) OR list_contains(never, word)),
blocks AS (
  SELECT a.doc_id, a.t, a.p, list(DISTINCT b.word) AS held
  FROM own a JOIN templates USING (t) JOIN own b ON a.doc_id = b.doc_id AND a.t = b.t AND b.p >= a.p AND b.p < a.p + width
  WHERE a.mine GROUP BY ALL),
found AS (
  SELECT doc_id, label, len(list_intersect(held, words))::DOUBLE / len(words) AS share FROM blocks JOIN templates USING (t)
  WHERE len(list_intersect(held, words)) >= ceil({THRESHOLD} * len(words) - 1e-9) AND list_has_all(held, must) AND NOT list_has_any(held, never)),
more AS (SELECT doc_id, list(DISTINCT label) AS ls, max(share) AS share FROM found GROUP BY doc_id)
SELECT b.doc_id, len(ws)::BIGINT AS n_words, len(hits)::BIGINT AS n_base,
  list_min(list_transform(hits, lambda h: h.p))::BIGINT AS first_word,
  list_max(list_transform(hits, lambda h: h.p))::BIGINT AS last_word,
  coalesce(array_to_string(list_sort(list_distinct(list_transform(hits, lambda h: h.l))), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(list_transform(hits, lambda h: h.l), coalesce(ls, [])))), ','), '') AS labels,
  CASE WHEN len(hits) > 0 THEN 1.0 ELSE coalesce(share, 0.0) END::DOUBLE AS score
FROM b LEFT JOIN more ON b.doc_id = more.doc_id"""


ORACLE_SQL = _oracle()
