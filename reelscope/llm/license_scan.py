"""Licence scans by a positional rare-token index, native throughout.

Each template is a word sequence with a mandatory key phrase at a fixed place.  The words of all templates are counted over
all documents; each template is filed under the rarest word of its key phrase with that word's position.  A file's
occurrences of those rare words are looked up, give the starts at which a template would lie, and each start is kept if
the key phrase stands there word by word and enough of the template's other words stand in their relative places.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelscope.llm.common import materialize, plain_text, table

#: Share of a template's words that must stand in place.
MIN_SHARE = 0.5
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Base phrases and their labels (fixed values).
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Opening words of common notices: label, template, mandatory key phrase.
NOTICES = (
    ("agpl", "gnu affero general public license", "affero general public license"),
    ("apache", "licensed under the apache license version 2 0", "apache license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted",
     "redistribution and use in source and binary forms"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose",
     "use copy modify and or distribute this software"),
    ("lgpl", "gnu lesser general public license", "lesser general public license"),
    ("mit", "released under the mit license", "mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy",
     "permission is hereby granted free of charge"),
    ("mpl", "subject to the terms of the mozilla public license", "mozilla public license"),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     "free and unencumbered software"),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    key_at: int
    key: tuple[str, ...]
    base: bool

    @staticmethod
    def of(label: str, text: str, key: str, base: bool) -> Template:
        words, phrase = tuple(text.split()), tuple(key.split())
        at = next(i for i in range(len(words)) if words[i: i + len(phrase)] == phrase)
        return Template(label, words, at, phrase, base)


TEMPLATES = tuple(
    [Template.of(label, text, text, True) for text, label in BASE.items()]
    + [Template.of(label, text, key, False) for label, text, key in NOTICES]
)


def licence_words(docs: DataFrame, *keep: Column) -> DataFrame:
    """``keep`` and ``words``: the words of each whole text, A-Z in lower case.

    The Kelvin sign is the one other character whose lower case is an ASCII letter; it is put aside first.
    """
    lowered = F.lower(F.replace(plain_text(), F.lit("K"), F.lit("κ")))
    return docs.select(*keep, F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)).alias("words"))


def template_words(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``doc_id, n_words, words``, written: the texts are split into words once, for the counts and for the scan.

    Words that no template has are null, so the table is a small part of the texts.
    """
    known = sorted({w for t in templates for w in t.words})
    return materialize(licence_words(docs, F.col("doc_id")).select(
        "doc_id", F.size("words").cast("long").alias("n_words"),
        F.transform("words", lambda w: F.when(w.isin(*known), w)).alias("words"),
    ), "licence-words")


def document_frequencies(rows: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> dict[str, int]:
    """In how many rows of :func:`template_words` each word of the key phrases stands; at most one number a word."""
    asked = sorted({w for t in templates for w in t.key})
    found = rows.select(F.explode(F.array_intersect("words", F.array(*map(F.lit, asked)))).alias("w"))
    return {r["w"]: r["n"] for r in found.groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}


def license_scan(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every whole text.

    ``n_base`` counts the places of all base phrases; ``first_word`` and ``last_word`` are their smallest and largest
    start (words from 0), null without a place.  ``score`` is the largest share of words in place over all templates found,
    0 without one.  A null or empty text has no words and empty labels.  Repeated rows are scanned row by
    row; an empty table gives an empty result; only the id and the text are read.
    """
    split = template_words(docs, templates)
    df = document_frequencies(split, templates)
    filed: dict[str, list[tuple[int, int]]] = {}
    for number, t in enumerate(templates):
        rare = min(range(len(t.key)), key=lambda i: (df.get(t.key[i], 0), i))
        filed.setdefault(t.key[rare], []).append((number, t.key_at + rare))
    words = F.col("words")
    places = F.filter(
        F.transform(words, lambda w, i: F.when(w.isin(*filed), i)), lambda i: i.isNotNull()
    )
    rows = split.select("doc_id", "words", "n_words", places.alias("places"))

    def starts(number: int, word: str, at: int) -> Column:
        """Starts at which the key phrase of a template stands, from the postings of its rare word."""
        t = templates[number]
        ahead = at - t.key_at
        phrase = F.array(*map(F.lit, t.key))
        return F.transform(
            F.filter("places", lambda p: (p >= ahead) & (
                F.slice(words, F.greatest(p - ahead + 1, F.lit(1)), len(t.key)) == phrase)),
            lambda p: p - at,
        )

    def in_place(number: int, start: Column) -> Column:
        """How many words of a template stand in their relative places."""
        t = templates[number]
        return sum(
            (F.coalesce(F.get(words, start + i) == F.lit(w), F.lit(False))).cast("int") for i, w in enumerate(t.words)
        )

    def matches(number: int, word: str, at: int) -> Column:
        """Where a template lies in the text, with the share of its words that stand in place."""
        t = templates[number]
        lain = F.transform(starts(number, word, at), lambda s: F.struct(s.alias("start"), in_place(number, s).alias("hits")))
        return F.transform(lain, lambda x: F.when(x["hits"] >= MIN_SHARE * len(t.words), F.struct(
            F.lit(t.label).alias("label"), F.lit(t.base).alias("base"), x["start"].cast("long").alias("start"),
            (x["hits"] / F.lit(float(len(t.words)))).alias("share"),
        )))

    found = [matches(number, word, at) for word, postings in filed.items() for number, at in postings]
    hits = rows.select("doc_id", "n_words", F.array_compact(F.flatten(F.array(*found))).alias("hits"))
    base = F.filter("hits", lambda h: h["base"])
    return hits.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
        F.array_min(F.transform(base, lambda h: h["start"])).alias("first_word"),
        F.array_max(F.transform(base, lambda h: h["start"])).alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(F.transform(base, lambda h: h["label"]))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("hits", lambda h: h["label"]))), ",").alias("labels"),
        F.round(F.coalesce(F.array_max(F.transform("hits", lambda h: h["share"])), F.lit(0.0)), 6).alias("score"),
    )


def op10_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = ",\n    ".join(
        f"({n}, '{t.label}', {str(t.base).lower()}, {list(t.words)}, {t.key_at}, {list(t.key)})"
        for n, t in enumerate(TEMPLATES)
    )
    return rf"""
WITH t(number, label, base, words, key_at, key_words) AS (VALUES
    {rows}
), d AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS own
  FROM documents
), w AS (
  SELECT r, unnest(own) AS word, unnest(range(len(own))) AS pos FROM d
), f AS (
  SELECT r, label, base, pos - key_at AS start,
         list_sum([CAST(pos - key_at + i >= 0 AND own[pos - key_at + i + 1] = words[i + 1] AS INTEGER)
                   FOR i IN range(len(words))]) / CAST(len(words) AS DOUBLE) AS share
  FROM w JOIN t ON word = key_words[1] JOIN d USING (r)
  WHERE own[pos + 1 : pos + len(key_words)] = key_words
), g AS (
  SELECT r, count(*) FILTER (WHERE base) AS n_base, min(start) FILTER (WHERE base) AS first_word,
         max(start) FILTER (WHERE base) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE base) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
  FROM f WHERE share >= {MIN_SHARE} GROUP BY r
)
SELECT doc_id, CAST(len(own) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, round(coalesce(score, 0.0), 6) AS score
FROM d LEFT JOIN g USING (r)
"""


SQL = _sql()
