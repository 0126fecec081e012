"""Licence scans with a positional rare-token index (operator 7); DataFrame functions only.

One pass over the texts keeps each document's occurrences of licence words, the
words of the templates and base phrases, with their positions (words from 0).
Document frequencies over all documents rank the licence words by inverse
document frequency. Of its own words each document looks up, for every template,
the `RARE` ones of highest IDF in the template's positional postings, so that one
notice does not crowd out another; places that agree in relative position
(position in the text less position in the template) add up. A template is a
candidate where at least `LEAST_SHARE` of the words looked up agree, and it is
found there if each word of its mandatory key phrase stands at its place.

The base rules are separate: the places where the words of a fixed phrase stand
consecutively. `lower` also folds letters outside ASCII, which cannot make or
break such a place: of what it folds into ASCII letters, the Kelvin sign becomes
a k, which no phrase holds, and a dotted capital I keeps its dot as a letter.

Defined results: null, empty and wordless texts have no words, no places and no
labels; a very long text is scanned whole, as one row; licence words that are
equally rare are ranked by the word itself; equal rows are scanned one by one; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .quality_rules import let
from .runtime import Scratch, keyed

RARE, LEAST_SHARE = 6, 0.6
WORD_BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrases and labels of the base rules.
PHRASES = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Notices of public licences (name, label, notice, key phrase), by words.
TEMPLATES = (
    ("mit-line", "mit", "released under the mit license", "mit license"),
    (
        "mit-grant", "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction"
        " including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        "permission is hereby granted free of charge",
    ),
    ("isc-grant", "isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", "permission to use copy modify and or distribute this software"),
    ("apache-line", "apache", "licensed under the apache license version", "apache license"),
    (
        "apache-notice", "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "you may not use this file except in compliance with the license",
    ),
    ("gpl-line", "gpl", "licensed under the gnu general public license version", "gnu general public license"),
    (
        "gpl-notice", "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version",
        "gnu general public license",
    ),
    ("lgpl-line", "lgpl", "licensed under the gnu lesser general public license version", "gnu lesser general public license"),
    ("agpl-line", "agpl", "licensed under the gnu affero general public license version", "gnu affero general public license"),
    ("cc-by-line", "cc-by", "licensed under cc by", "cc by"),
    ("cc-by-nc-line", "cc-by-nc", "licensed under cc by nc", "cc by nc"),
    ("cc-by-sa-line", "cc-by-sa", "licensed under cc by sa", "cc by sa"),
    ("cc-by-name", "cc-by", "licensed under the creative commons attribution international license", "creative commons attribution"),
    (
        "bsd-grant", "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above copyright notice",
        "redistribution and use in source and binary forms",
    ),
    ("mpl-line", "mpl", "this source code form is subject to the terms of the mozilla public license", "mozilla public license"),
    ("unlicense", "unlicense", "this is free and unencumbered software released into the public domain", "free and unencumbered software"),
)


def _postings() -> list[tuple[int, str, int, bool]]:
    """(template's place in TEMPLATES, word, position, in the key phrase) of every template word."""
    out = []
    for t, (_, _, notice, key) in enumerate(TEMPLATES):
        words, inner = notice.split(), key.split()
        at = next(i for i in range(len(words)) if words[i : i + len(inner)] == inner)
        out += [(t, w, i, at <= i < at + len(inner)) for i, w in enumerate(words)]
    return out


POSTINGS = _postings()
#: A word's place here is its number below.
LICENCE_WORDS = sorted({w for _, w, _, _ in POSTINGS} | {w for phrase, _ in PHRASES for w in phrase.split()})
NUMBER = {w: n for n, w in enumerate(LICENCE_WORDS)}


def occurrences(text: Column) -> Column:
    """A struct of the word count of a text and its licence words (w: number, i: position) in order."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_BREAK), lambda w: w != "")
    number = lambda w: (F.array_position(F.array(*map(F.lit, LICENCE_WORDS)), w) - 1).cast("int")
    hit = lambda w, i: F.when(w.isin(LICENCE_WORDS), F.struct(number(w).alias("w"), i.cast("long").alias("i")))
    return let(words, lambda x: F.struct(F.size(x).cast("long").alias("n_words"), F.filter(F.transform(x, hit), lambda h: h.isNotNull()).alias("hits")))


def places(hits: Column) -> Column:
    """An array of (label, i): where base phrases start."""

    def at(phrase: str, label: str) -> Column:
        words = [NUMBER[w] for w in phrase.split()]

        def start(h: Column, k: Column) -> Column:
            ok = h["w"] == words[0]
            for n, word in enumerate(words[1:], 1):
                after = F.get(hits, k + n)
                ok = ok & F.coalesce((after["w"] == word) & (after["i"] == h["i"] + n), F.lit(False))
            return F.when(ok, F.struct(F.lit(label).alias("label"), h["i"].alias("i")))

        return F.filter(F.transform(hits, start), lambda x: x.isNotNull())

    return F.concat(*[at(phrase, label) for phrase, label in PHRASES])


def idf_ranks(rows: DataFrame) -> list[int]:
    """The rank of each licence word by inverse document frequency in (hits), 0 for the rarest."""
    counts = rows.select(F.explode(F.array_distinct("hits.w")).alias("w")).groupBy("w").agg(F.count("*").alias("df"))
    frequency = {r.w: r.df for r in counts.collect()}  # a row for each licence word
    rarest = sorted(NUMBER.values(), key=lambda n: (frequency.get(n, 0), n))
    return [rank for _, rank in sorted((n, rank) for rank, n in enumerate(rarest))]


def candidates(rows: DataFrame, ranks: list[int], rare: int, least_share: float) -> DataFrame:
    """(key, found): the places (t, shift, share) where enough of the rare words of (key, hits) agree with template t, verified.

    Only templates of which a document holds each word of the key phrase are
    looked up, as no other one can be found in it.
    """
    number = lambda own, only_key: F.array(*[F.lit(r) for r in sorted({ranks[NUMBER[w]] for t, w, _, is_key in POSTINGS if t == own and (is_key or not only_key)})])
    templates = F.array(*[F.struct(F.lit(t).alias("t"), number(t, False).alias("words"), number(t, True).alias("key")) for t in range(len(TEMPLATES))])
    rank = lambda w: F.get(F.array(*map(F.lit, ranks)), w)
    mine = F.transform(F.array_distinct("hits.w"), rank)

    def asked(own: Column) -> Column:
        possible = F.filter(templates, lambda x: F.size(F.array_except(x["key"], own)) == 0)
        return F.transform(possible, lambda x: F.struct(x["t"].alias("t"), F.slice(F.array_intersect(x["words"], own), 1, rare).alias("ws")))

    some = rows.filter(F.size("hits") > 1).select("key", "hits", let(mine, asked).alias("asked")).filter(F.size("asked") > 0)
    each = some.select("key", "hits", F.explode("asked").alias("x"))
    looked = each.select("key", F.col("x.t").alias("t"), F.size("x.ws").alias("m"), F.explode(F.filter("hits", lambda h: F.array_contains("x.ws", rank(h["w"])))).alias("h")).select("key", "t", "m", "h.w", "h.i")
    posts = rows.sparkSession.createDataFrame([(t, NUMBER[w], p) for t, w, p, _ in POSTINGS], "t int, w int, p long")
    votes = looked.join(F.broadcast(posts), ["t", "w"])  # a constant of this module
    agreed = votes.groupBy("key", "t", "m", (F.col("i") - F.col("p")).alias("shift")).agg(F.countDistinct("w").alias("n"))
    good = agreed.withColumn("share", F.col("n") / F.col("m")).filter(F.col("share") >= least_share)
    found = good.groupBy("key").agg(F.collect_list(F.struct("t", "shift", "share")).alias("found"))  # places of one document
    return some.select("key", "hits").join(found, "key").select("key", verified(F.col("hits"), F.col("found")).alias("found"))


def verified(hits: Column, found: Column) -> Column:
    """Of the places in `found` those where each word of the template's key phrase stands at its place."""
    keys = [[(NUMBER[w], p) for t, w, p, is_key in POSTINGS if is_key and t == own] for own in range(len(TEMPLATES))]
    table = F.array(*[F.array(*[F.struct(F.lit(w).alias("w"), F.lit(p).cast("long").alias("p")) for w, p in k]) for k in keys])
    stands = lambda x, k: F.exists(hits, lambda h: (h["i"] == x["shift"] + k["p"]) & (h["w"] == k["w"]))
    return F.filter(found, lambda x: F.forall(F.get(table, x["t"]), lambda k: stands(x, k)))


def scan(docs: DataFrame, rare: int = RARE, least_share: float = LEAST_SHARE) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of `docs`."""
    scratch = Scratch(docs.sparkSession, "licences")
    rows = scratch.write(keyed(docs, scratch).select("key", "doc_id", occurrences(F.col("text")).alias("x")).select("key", "doc_id", "x.*"), "hits")
    found = candidates(rows, idf_ranks(rows), rare, least_share)
    both = rows.select("key", "doc_id", "n_words", let(F.col("hits"), places).alias("base")).join(found, "key", "left")
    label = F.array(*[F.lit(label) for _, label, _, _ in TEMPLATES])
    own = F.coalesce(F.transform("found", lambda x: F.get(label, x["t"])), F.array().cast("array<string>"))
    join = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return scratch.result(
        both.select(
            "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base.i").alias("first_word"), F.array_max("base.i").alias("last_word"),
            join(F.col("base.label")).alias("base_labels"), join(F.concat("base.label", own)).alias("labels"),
            F.greatest(F.when(F.size("base") > 0, 0.5).otherwise(0.0), F.coalesce(F.array_max("found.share"), F.lit(0.0))).alias("score"),
        )
    )


def op7_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def _sql() -> str:
    """The same rows in DuckDB SQL."""
    quoted = ", ".join(f"'{w}'" for w in LICENCE_WORDS)
    posts = ", ".join(f"({t}, '{TEMPLATES[t][1]}', '{w}', {p}, {str(key).lower()})" for t, w, p, key in POSTINGS)
    bases = " UNION ALL ".join(
        f"SELECT doc_id, i, '{label}' AS label FROM h WHERE "
        + " AND ".join([f"w = '{words[0]}'", *[f"(doc_id, '{w}', i + {n}) IN (SELECT doc_id, w, i FROM h)" for n, w in enumerate(words[1:], 1)]])
        for words, label in ((phrase.split(), label) for phrase, label in PHRASES)
    )
    return f"""
    WITH d AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda w: w <> '') AS words FROM documents),
    h AS (SELECT doc_id, w, i FROM (SELECT doc_id, unnest(words) AS w, unnest(range(len(words))) AS i FROM d) WHERE w IN ({quoted})),
    b AS ({bases}),
    bs AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_sort(list_distinct(list(label))) AS labels FROM b GROUP BY doc_id),
    t(t, label, w, p, is_key) AS (VALUES {posts}),
    df AS (SELECT w, row_number() OVER (ORDER BY count(DISTINCT doc_id), w) AS rank FROM h GROUP BY w),
    own AS (
        SELECT doc_id, t, w FROM (
            SELECT doc_id, t, x.w, row_number() OVER (PARTITION BY doc_id, t ORDER BY rank) AS k FROM (SELECT DISTINCT doc_id, w FROM h) AS x JOIN df ON x.w = df.w JOIN (SELECT DISTINCT t, w FROM t) AS y ON x.w = y.w)
        WHERE k <= {RARE}),
    v AS (SELECT h.doc_id, t.t, i - p AS shift, h.w FROM h JOIN own ON h.doc_id = own.doc_id AND h.w = own.w JOIN t ON h.w = t.w AND t.t = own.t),
    a AS (SELECT doc_id, t, shift, count(DISTINCT w) AS n FROM v GROUP BY ALL),
    m AS (SELECT doc_id, t, count(DISTINCT w) AS m FROM v GROUP BY ALL),
    c AS (SELECT a.doc_id, a.t, shift, n / m AS share FROM a JOIN m ON a.doc_id = m.doc_id AND a.t = m.t WHERE n / m >= {LEAST_SHARE}),
    bad AS (SELECT DISTINCT c.doc_id, c.t, c.shift FROM c JOIN t ON c.t = t.t AND is_key LEFT JOIN h ON h.doc_id = c.doc_id AND h.i = c.shift + t.p AND h.w = t.w WHERE h.w IS NULL),
    f AS (
        SELECT c.doc_id, list(DISTINCT label) AS labels, max(share) AS share FROM c JOIN (SELECT DISTINCT t, label FROM t) AS l ON c.t = l.t
        LEFT JOIN bad ON c.doc_id = bad.doc_id AND c.t = bad.t AND c.shift = bad.shift WHERE bad.t IS NULL GROUP BY c.doc_id)
    SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
           coalesce(array_to_string(bs.labels, ','), '') AS base_labels,
           coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(bs.labels, []), coalesce(f.labels, [])))), ','), '') AS labels,
           greatest(CASE WHEN n_base > 0 THEN 0.5 ELSE 0 END, coalesce(share, 0))::DOUBLE AS score
    FROM d LEFT JOIN bs ON d.doc_id = bs.doc_id LEFT JOIN f ON d.doc_id = f.doc_id
    """


OP7_SQL = _sql()
