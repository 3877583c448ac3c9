"""License scans by diagonal voting, in DataFrame functions only.

Words of a document are ASCII digits and letters (A to Z in lower case) and anything beyond ASCII. The hashes of
all its rolling word k-grams are joined to those of the templates; a hit counts if the words themselves are equal. Each
hit votes for a diagonal (its place less the template's), diagonals at most SLACK apart are merged, since a few
words more or less shift the rest, and a span is verified if it covers SHARE of the template's words and isn't
longer than STRETCH times the template; where a merged span fails, its diagonals are verified alone. Short phrases have
their own k and no slack: every word has to be there.

Templates are sent around in parts of at most MAX_TEMPLATE_WORDS words; each part is a pass over the documents.
Hits are few, and a document's votes are counted in its task before they are shuffled. All that is gathered for one
document (its spans) is bounded by its own length.

Defined results: a null text is empty and has no words; a null id is kept; rows that repeat keep a row each; of equal
spans each template's own is told; an empty table gives no rows; extra columns are ignored. Very long texts take time in proportion.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLACK, SHARE, STRETCH = 4, 0.6, 1.5
MAX_TEMPLATE_WORDS = 50_000
SHORT, LONG = 2, 4
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Phrases that every scan counts, and their labels.
PHRASES = (("mit", "mit license"), ("apache", "apache license"), ("gpl", "general public license"))
#: Notices as their publishers word them.
NOTICES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("apache", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("apache", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
)


def words(text: Column) -> Column:
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower()), GAP), lambda w: w != "")


def _with_grams(df: DataFrame) -> DataFrame:
    """Add ``grams`` to a table with ``words``: 0, then the hashes of SHORT words at each place, then those of LONG words."""
    pairs = lambda c, by: F.zip_with(c, F.slice(c, by + 1, F.size(c)), lambda a, b: F.xxhash64(a, b))
    df = df.withColumn("grams", F.transform("words", lambda w: F.xxhash64(w)))
    df = df.withColumn("grams", pairs("grams", 1))
    return df.withColumn("grams", F.concat(F.array(F.lit(0).cast("long")), "grams", pairs("grams", 2)))


def templates(spark: SparkSession, phrases=PHRASES, notices=NOTICES) -> DataFrame:
    """(template, label, base, k, words) of phrases and notices; a phrase needs all its words, two at least."""
    rows = [(label, True, SHORT, text) for label, text in phrases] + [(label, False, LONG, text) for label, text in notices]
    row = lambda k, r: F.struct(F.lit(k).alias("template"), F.lit(r[0]).alias("label"), F.lit(r[1]).alias("base"), F.lit(r[2]).alias("k"), F.lit(r[3]).alias("text"))
    table = spark.range(1).select(F.inline(F.array(*(row(k, r) for k, r in enumerate(rows)))))
    return table.select("template", "label", "base", "k", words(F.col("text")).alias("words")).where(F.size("words") >= F.col("k"))


def _grams_of(own: DataFrame) -> DataFrame:
    """(hash, template, size, t_k, t_at, gram): a row for each k-gram of each template, by the same hashes as documents'."""
    t = _with_grams(own).withColumn("n", F.size("words")).select("template", "n", "k", "words", F.posexplode("grams").alias("at", "hash"))
    at = F.when(F.col("k") == SHORT, F.col("at") - 1).otherwise(F.col("at") - 1 - F.col("n"))
    t = t.withColumn("at", at).where("at between 0 and n - k")
    return t.select("hash", "template", F.col("n").alias("size"), F.col("k").alias("t_k"), F.col("at").alias("t_at"), F.slice("words", F.col("at") + 1, F.col("k")).alias("gram"))


_KEY = ("doc_id", "h1", "h2")


def _votes(docs: DataFrame, grams: DataFrame, with_rows: bool) -> DataFrame:
    """(key, template, size, diagonal, t_k, places, n_words, copies): the template's places that vote for a diagonal of a document.

    With ``with_rows``, template -1 has a row for each document too.
    """
    text = F.coalesce("text", F.lit(""))
    t = docs.select("doc_id", F.xxhash64("doc_id", text).alias("h1"), F.xxhash64(text, "doc_id", F.lit("row")).alias("h2"), words(F.col("text")).alias("words"))
    t = _with_grams(t).withColumn("n_words", F.size("words")).select(*_KEY, "n_words", "words", F.posexplode_outer("grams").alias("place", "its_hash"))
    # The outer form, for the plain one is preceded by a filter that makes the grams a second time.
    long = F.col("place") > F.col("n_words")
    at, k = F.col("place") - 1 - F.when(long, F.col("n_words")).otherwise(0), F.when(long, F.lit(LONG)).otherwise(F.lit(SHORT))
    whole = F.col("template") == -1
    if with_rows:
        row = grams.sparkSession.range(1).select(F.lit(0).cast("long").alias("hash"), F.lit(-1).alias("template"), F.lit(1).alias("size"), F.lit(1).alias("t_k"), F.lit(0).alias("t_at"), F.array(F.lit("")).alias("gram"))
        grams = grams.union(row)
    same = (F.col("its_hash") == F.col("hash")) & F.when(F.col("place") == 0, whole).otherwise(~whole & (k == F.col("t_k")) & (F.slice("words", at + 1, k) == F.col("gram")))
    hits = t.join(F.broadcast(grams), same).select(*_KEY, "n_words", "template", "size", "t_k", "t_at", F.when(whole, F.lit(0)).otherwise(at - F.col("t_at")).alias("diagonal"))
    return hits.groupBy(*_KEY, "template", "size", "t_k", "diagonal").agg(F.collect_set("t_at").alias("places"), F.max("n_words").alias("n_words"), F.count("*").alias("copies"))


def _covered(places: str) -> Column:
    """Words of the template inside the k-grams at ``places``."""
    return F.size(F.array_distinct(F.flatten(F.transform(places, lambda t: F.sequence(t, t + F.col("t_k") - 1)))))


def _spans(votes: DataFrame) -> DataFrame:
    """(key, template, n_words, copies, spans): verified spans of each template in each document."""
    by = Window.partitionBy(*_KEY, "template").orderBy("diagonal")
    apart = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(by) > F.when(F.col("t_k") == SHORT, 0).otherwise(SLACK), F.lit(False))
    one = F.struct(
        (F.col("diagonal") + F.array_min("places")).alias("start"), (F.col("diagonal") + F.array_max("places") + F.col("t_k")).alias("end"), (_covered("places") / F.col("size")).alias("share")
    )
    t = votes.withColumn("group", F.sum(apart.cast("int")).over(by)).withColumn("one", one)
    t = t.groupBy(*_KEY, "template", "size", "t_k", "group").agg(
        F.collect_list("one").alias("each"), F.array_distinct(F.flatten(F.collect_list("places"))).alias("places"), F.max("n_words").alias("n_words"), F.max("copies").alias("copies")
    )
    merged = F.struct(F.array_min(F.col("each.start")).alias("start"), F.array_max(F.col("each.end")).alias("end"), (_covered("places") / F.col("size")).alias("share"))
    share = F.when(F.col("t_k") == SHORT, F.lit(1.0)).otherwise(F.lit(SHARE))
    t = t.withColumn("merged", merged)
    fits = (F.col("merged.share") >= share) & (F.col("merged.end") - F.col("merged.start") <= STRETCH * F.col("size"))
    return t.select(*_KEY, "template", "n_words", "copies", F.when(fits, F.array("merged")).otherwise(F.filter("each", lambda x: x["share"] >= share)).alias("spans"))


def _parts(known: DataFrame) -> list[list[int]]:
    """Templates by number, in parts of at most MAX_TEMPLATE_WORDS words."""
    parts, left = [[]], MAX_TEMPLATE_WORDS
    for template, size in known.select("template", F.size("words")).orderBy("template").collect():
        if size > left and parts[-1]:
            parts.append([])
            left = MAX_TEMPLATE_WORDS
        parts[-1].append(template)
        left -= size
    return parts


def find_licenses(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(doc_id, n_words, spans) of every row; spans: (start, end, label, base, share) by start, end exclusive, in words.

    ``known``: a table as of ``templates``.
    """
    known = templates(docs.sparkSession) if known is None else known
    votes = [_votes(docs, _grams_of(known.where(F.col("template").isin(own))), not k) for k, own in enumerate(_parts(known))]
    spans = _spans(reduce(DataFrame.union, votes)).join(F.broadcast(known.select("template", "label", "base")), "template", "left")
    told = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.col("label").alias("label"), F.col("base").alias("base"), s["share"].alias("share")))
    whole = F.col("template") == -1
    per = spans.groupBy(*_KEY).agg(
        F.max(F.when(whole, F.col("n_words"))).cast("long").alias("n_words"), F.max(F.when(whole, F.col("copies"))).alias("copies"), F.array_sort(F.flatten(F.collect_list(F.when(~whole, told)))).alias("spans")
    )
    return per.select("doc_id", "n_words", "spans", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).drop("copy")


def digest(found: DataFrame) -> DataFrame:
    """Counts of the phrases, labels and score of what ``find_licenses`` returns."""
    base = F.filter("spans", lambda s: s["base"])
    listed = lambda spans: F.array_join(F.array_sort(F.array_distinct(F.transform(spans, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"].cast("long"))
    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"), listed(base).alias("base_labels"), listed("spans").alias("labels"),
        F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
    )


def _values() -> str:
    rows = [(label, "true", SHORT, text) for label, text in PHRASES] + [(label, "false", LONG, text) for label, text in NOTICES]
    return ", ".join(f"({k}, '{label}', {base}, {n}, '{text}')" for k, (label, base, n, text) in enumerate(rows))


def _sql_words(text: str) -> str:
    return rf"list_filter(string_split_regex(translate(coalesce({text}, ''), '{_UPPER}', '{_UPPER.lower()}'), '{GAP}'), lambda w: w <> '')"


def _sql_covered(places: str) -> str:
    return f"len(list_distinct(flatten(list_transform({places}, lambda t: range(t, t + k)))))"


ORACLE = f"""
WITH t AS (SELECT template, label, base, k, {_sql_words("text")} AS words FROM (VALUES {_values()}) v(template, label, base, k, text)),
tg AS (SELECT template, k, len(words) AS size, unnest(range(0, len(words) - k + 1)) AS t_at, unnest(list_transform(range(0, len(words) - k + 1), lambda i: array_to_string(words[i + 1 : i + k], ' '))) AS gram FROM t),
p AS (SELECT row_number() OVER () AS rid, doc_id, {_sql_words("text")} AS words FROM documents),
g AS (SELECT rid, k, unnest(range(0, len(words) - k + 1)) AS pos, unnest(list_transform(range(0, len(words) - k + 1), lambda i: array_to_string(words[i + 1 : i + k], ' '))) AS gram FROM p, (VALUES ({SHORT}), ({LONG})) n(k) WHERE len(words) >= k),
d AS (SELECT rid, template, size, k, pos - t_at AS diagonal, list(t_at) AS places FROM g JOIN tg USING (k, gram) GROUP BY ALL),
l AS (SELECT *, coalesce(diagonal - lag(diagonal) OVER (PARTITION BY rid, template ORDER BY diagonal) > CASE k WHEN {SHORT} THEN 0 ELSE {SLACK} END, false) AS apart FROM d),
n AS (SELECT *, sum(apart::int) OVER (PARTITION BY rid, template ORDER BY diagonal) AS grp, diagonal + list_min(places) AS s, diagonal + list_max(places) + k AS e, {_sql_covered("places")} / size AS share FROM l),
m AS (SELECT rid, template, size, k, grp, min(s) AS ms, max(e) AS me, list(places) AS ps, list({{'s': s, 'e': e, 'share': share}}) AS each FROM n GROUP BY ALL),
c AS (SELECT *, {_sql_covered("flatten(ps)")} / size AS share, CASE k WHEN {SHORT} THEN 1.0 ELSE {SHARE} END AS least FROM m),
f AS (SELECT rid, template, unnest(CASE WHEN share >= least AND me - ms <= {STRETCH} * size THEN [{{'s': ms, 'e': me, 'share': share}}] ELSE list_filter(each, lambda x: x.share >= least) END) AS span FROM c),
a AS (SELECT rid, count(*) FILTER (base) AS n_base, min(span.s) FILTER (base) AS first_word, max(span.s) FILTER (base) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels,
 string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(span.share) AS score FROM f JOIN t USING (template) GROUP BY rid)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0::double) AS score FROM p LEFT JOIN a USING (rid)
"""
