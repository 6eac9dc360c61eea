"""License scans by a positional rare-token index, in DataFrame operations only.

A template is a licence notice with mandatory key phrases at known places. Texts are split into words once; what is kept
of a file are the places of its licence words (those of any template), from which come the words' inverse document
frequencies. The index is a table: for each template's two mandatory words of highest inverse frequency, where in the
template they stand. A file's licence words are looked up in it, postings of a template's two words that agree on its
start are intersected, and at each such start all words of the key phrases are verified. A start may lie before the
text, as where a notice begins in its midst; only key phrases have to be there. As each template is looked up by words
that its key phrases need, no place is lost, however many a file has.

Null and empty texts have no words, no places and score 0, as have files without licence words. Repeated rows are scanned each,
with or without doc_id; of words with equal frequencies (ties) the first in the alphabet is the rarer one, which changes no result. Very
long texts are scanned whole, in time that grows with their places; candidates of one file are found in one row, its places counted in any task. Other columns of docs, whatever their names,
are not read. An empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from math import log

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.llm.common import lower_ascii, materialize

#: What stands between words: every ASCII character but digits and small letters.
GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


#: Up to so many candidates of a file are looked through for each word.
FEW = 64


@dataclass(frozen=True)
class Template:
    """A notice; keys are the phrases of it that must be there, by default the whole notice."""

    label: str
    notice: str
    keys: tuple[str, ...] = field(default=())
    base: bool = False

    @property
    def words(self) -> list[str]:
        return self.notice.split()

    @property
    def mandatory(self) -> list[int]:
        """The places of the key phrases' words."""
        places = []
        for phrase in self.keys or (self.notice,):
            wanted, n = phrase.split(), len(phrase.split())
            places += next(range(i, i + n) for i in range(len(self.words)) if self.words[i : i + n] == wanted)
        return sorted(set(places))


#: Base phrases with their labels.
BASE = (
    Template("gpl", "gnu general public license", base=True),
    Template("apache", "apache license", base=True),
    Template("cc-by", "cc by", base=True),
    Template("mit", "mit license", base=True),
)
_FREE = "this program is free software you can redistribute it and or modify it under the terms of the"
_PUBLISHED = "as published by the free software foundation either version"
_LATER = "of the license or at your option any later version"
#: The method's own labels with public licence notices and what identifies each.
NOTICES = (
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    Template("gpl-3.0", f"{_FREE} gnu general public license {_PUBLISHED} 3 {_LATER}", (f"gnu general public license {_PUBLISHED} 3",)),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    Template("gpl-2.0", f"{_FREE} gnu general public license {_PUBLISHED} 2 {_LATER}", (f"gnu general public license {_PUBLISHED} 2",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    Template("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license version 2 0",)),
    Template("mit-notice", "released under the mit license", ("under the mit license",)),
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction",
        ("permission is hereby granted", "free of charge"),
    ),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee is hereby granted")),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms")),
    Template("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software", ("endorse or promote products derived from this software",)),
    Template("mpl-2.0", "this work is subject to the mozilla public license version 2 0", ("mozilla public license", "version 2 0")),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", ("eclipse public license v 2 0",)),
    Template("bsl-1.0", "distributed under the boost software license version 1 0", ("boost software license version 1 0",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    Template("cc0-1.0", "cc0 1 0 universal public domain dedication", ("cc0 1 0 universal",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
)
TEMPLATES = BASE + NOTICES


def vocabulary(templates: tuple[Template, ...]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def licence_words(docs: DataFrame, templates: tuple[Template, ...]) -> DataFrame:
    """file (a number of the row), doc_id, n_words, hits (the places, from 0, of licence words, with the word)."""
    words = F.array_remove(F.split(lower_ascii(F.coalesce("text", F.lit(""))), GAPS), "")
    split = docs.select("doc_id", words.alias("words"))
    hits = F.array_compact(F.transform("words", lambda w, i: F.when(w.isin(vocabulary(templates)), F.struct(i.alias("at"), w.alias("w")))))
    return materialize(split.select(F.monotonically_increasing_id().alias("file"), "doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits")))


def inverse_frequencies(files: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, float]:
    """ln((1 + documents) / (1 + documents with the word)) of each licence word, over all files.

    One number for each word of the templates reaches the driver.
    """
    # an empty string stands for the document itself
    words = F.concat(F.array(F.lit("")), F.array_distinct(F.col("hits.w")))
    n = {r["word"]: r["n"] for r in files.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    return {w: log((1 + n.get("", 0)) / (1 + n.get(w, 0))) for w in vocabulary(templates)}


def rare_tokens(templates: tuple[Template, ...], idf: dict[str, float]) -> dict[str, list[tuple[int, int, int]]]:
    """The index: (template, place, which of its two) for each template's two rarest mandatory words."""
    postings: dict[str, list[tuple[int, int, int]]] = {}
    for k, t in enumerate(templates):
        ranked = sorted(t.mandatory, key=lambda q: (-idf[t.words[q]], t.words[q], q))
        second = next((q for q in ranked if t.words[q] != t.words[ranked[0]]), ranked[0])
        for which, q in enumerate((ranked[0], second)):
            postings.setdefault(t.words[q], []).append((k, q, which))
    return dict(sorted(postings.items(), key=lambda p: (-idf[p[0]], p[0])))


def all_words(spark: SparkSession, templates: tuple[Template, ...], idf: dict[str, float]) -> DataFrame:
    """w, template, place, mandatory, share (of its template's inverse frequencies) of the templates' words."""
    rows = []
    for k, t in enumerate(templates):
        total, needed = sum(idf[w] for w in t.words), set(t.mandatory)
        rows += [(w, k, q, int(q in needed), idf[w] / total if total else 1 / len(t.words)) for q, w in enumerate(t.words)]
    return spark.createDataFrame(rows, "w string, template int, place int, mandatory int, share double")


def _spot(template: Column, start: Column) -> Column:
    """One number for a template and a start, which may lie before the text."""
    return template.cast("long") * F.lit(1 << 40) + start


def candidates(hits: Column, postings: dict[str, list[tuple[int, int, int]]]) -> Column:
    """Where the postings of both of a template's rare words agree, in one file, as numbers (see _spot): these hash."""
    posted = F.create_map(*[c for w, places in postings.items() for c in (F.lit(w), F.array(*[F.struct(F.lit(k).alias("template"), F.lit(q).alias("place"), F.lit(which).alias("which")) for k, q, which in places]))])
    looked_up = F.filter(hits, lambda h: h["w"].isin(list(postings)))
    starts = F.flatten(F.transform(looked_up, lambda h: F.transform(F.element_at(posted, h["w"]), lambda p: F.struct(_spot(p["template"], h["at"] - p["place"]).alias("spot"), p["which"].alias("which")))))
    of = lambda which: F.transform(F.filter(starts, lambda s: s["which"] == which), lambda s: s["spot"])
    return F.array_intersect(of(0), of(1))


def found(files: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """file, template, start, share: every place of every template, with the share of its words that stand there."""
    idf = inverse_frequencies(files, templates)
    some = files.select("file", "hits", candidates(F.col("hits"), rare_tokens(templates, idf)).alias("candidates")).where(F.size("candidates") > 0)
    # the words of all templates, a table as large as they are, are broadcast
    # of a file with many candidates, which aren't copied to its words then, all starts are counted: only a candidate can
    # have all mandatory words
    few = F.when(F.size("candidates") <= FEW, F.col("candidates")).alias("candidates")
    standing = some.select("file", few, F.explode("hits").alias("h")).select("file", "candidates", "h.*").join(F.broadcast(all_words(files.sparkSession, templates, idf)), "w")
    start = F.col("at") - F.col("place")
    near = standing.where(F.coalesce(F.array_contains("candidates", _spot(F.col("template"), start)), F.lit(True))).select("file", "template", start.alias("start"), "mandatory", "share")
    checked = near.groupBy("file", "template", "start").agg(F.sum("mandatory").alias("there"), F.sum("share").alias("share"))
    needed = F.array(*[F.lit(len(t.mandatory)) for t in templates])
    return checked.where(F.col("there") == F.get(needed, F.col("template"))).drop("there")


def scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row of docs (doc_id, text).

    score is the largest share, by inverse frequency, of a found notice's words that stand at their places; a base
    phrase alone gives 0.5.
    """
    files = licence_words(docs, templates)
    base, label = (F.get(F.array(*[F.lit(getattr(t, name)) for t in templates]), F.col("template")) for name in ("base", "label"))
    places = found(files, templates).select("file", "start", "share", base.alias("base"), label.alias("label"))
    joined = lambda which: F.array_join(F.array_sort(F.collect_set(which)), ",")
    by_file = places.groupBy("file").agg(
        F.count(F.when(F.col("base"), 1)).alias("n_base"), F.min(F.when(F.col("base"), F.col("start"))).alias("first_word"), F.max(F.when(F.col("base"), F.col("start"))).alias("last_word"),
        joined(F.when(F.col("base"), F.col("label"))).alias("base_labels"), joined(F.col("label")).alias("labels"),
        F.max(F.when(F.col("base"), 0.5).otherwise(F.col("share"))).alias("score"),
    )
    return files.select("file", "doc_id", "n_words").join(by_file, "file", "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0).cast("long")).alias("n_base"), F.col("first_word").cast("long").alias("first_word"), F.col("last_word").cast("long").alias("last_word"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.round(F.least(F.coalesce("score", F.lit(0.0)), F.lit(1.0)), 6).alias("score"),
    )


def scan_sql(templates: tuple[Template, ...] = TEMPLATES) -> str:
    """DuckDB: how many words of each template stand where they should from each start on, without an index."""
    rows = ", ".join(f"({k}, '{t.label}', {str(t.base).lower()}, {len(t.mandatory)}, {q}, {int(q in t.mandatory)}, '{w}')" for k, t in enumerate(templates) for q, w in enumerate(t.words))
    return f"""
WITH t(template, label, base, needed, place, mandatory, w) AS (VALUES {rows}),
d AS (
  SELECT row_number() OVER () AS file, doc_id,
         list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{GAPS}'), lambda x: x <> '') AS ws FROM documents
), h AS (SELECT file, unnest(ws) AS w, unnest(range(0, len(ws))) AS at FROM d),
f AS (
  SELECT v.w, ln((1 + (SELECT count(*) FROM d)) / (1 + count(DISTINCT h.file))) AS idf FROM (SELECT DISTINCT w FROM t) v LEFT JOIN h ON h.w = v.w GROUP BY v.w
), total AS (SELECT template, sum(idf) AS s, count(*) AS n FROM t JOIN f ON f.w = t.w GROUP BY template),
p AS (
  SELECT h.file, t.template, any_value(label) AS label, any_value(base) AS base, h.at - t.place AS start, sum(CASE WHEN s > 0 THEN idf / s ELSE 1.0 / n END) AS share
  FROM h JOIN t ON h.w = t.w JOIN f ON f.w = t.w JOIN total ON total.template = t.template
  GROUP BY h.file, t.template, h.at - t.place HAVING sum(mandatory) = any_value(needed)
), g AS (
  SELECT file, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word, max(start) FILTER (WHERE base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
         max(CASE WHEN base THEN 0.5 ELSE share END) AS score FROM p GROUP BY file
)
SELECT doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, round(least(coalesce(score, 0), 1.0), 6) AS score
FROM d LEFT JOIN g ON g.file = d.file
"""
