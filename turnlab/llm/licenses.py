"""License notices found by diagonal voting, in DataFrame functions only.

Every rolling run of k words of a text is hashed and joined with the places where templates have the same run. A hit at word p of the
text and word q of a template votes for the diagonal p - q, the place where the template would begin. Votes are summed
by diagonal; neighbouring diagonals (words put in or left out) are merged; a merged span is verified by the share of the
template's words that its runs cover, compared as words and not as hashes. Short templates are phrases: runs of two
words, no merging, every word. Longer ones are notices: runs of five words, diagonals up to SLACK apart, LEAST of the words.
"""

import re
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

PHRASE = 8              # a template of fewer words is a phrase
PHRASE_RUN = 2
NOTICE_RUN = 5
SLACK = 4               # words between diagonals that are merged
LEAST = 0.8             # share of a notice's words
BROADCAST = 1 << 20     # template words up to which their table is broadcast; beyond it the join is shuffled

#: Fixed values of the contract: phrase and label.
BASE = [
    ("cc by", "cc-by"),
    ("general public license", "gpl"),
    ("all rights reserved", "reserved"),
]

#: Further phrases and public notices, and their labels.
FURTHER = [
    ("mit license", "mit"),
    ("apache license", "apache"),
    ("apache license version 2 0", "apache-2.0"),
    ("lesser general public license", "lgpl"),
    ("affero general public license", "agpl"),
    ("general public license version 2", "gpl-2.0"),
    ("general public license version 3", "gpl-3.0"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("bsd license", "bsd"),
    ("isc license", "isc"),
    ("cc by nc", "cc-by-nc"),
    ("cc by nd", "cc-by-nd"),
    ("cc by sa", "cc-by-sa"),
    ("creative commons attribution", "cc-by"),
    ("dedicated to the public domain", "public-domain"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
     "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
     "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
     "this permission notice shall be included in all copies or substantial portions of the Software.", "mit"),
    ("Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
     "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by "
     "applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.", "apache-2.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
     "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later "
     "version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the "
     "implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.", "gpl-3.0"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
     "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
     "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
     "list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
     "distribution.", "bsd"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
     "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.", "mpl"),
    ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, "
     "compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, "
     "commercial or non-commercial, and by any means.", "public-domain"),
]

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_APART = "".join(map(chr, [*range(0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]))


def words_of(text):
    """The words of a text column: A-Z lower-cased, apart at every other ASCII character but digits; null has none."""
    plain = F.trim(F.translate(F.coalesce(text, F.lit("")), _UPPER + _APART, _UPPER.lower() + " " * len(_APART)))
    return F.when(plain == "", F.array().cast("array<string>")).otherwise(F.split(plain, " +"))


def _run(words, at, width):
    """Hash of the ``width`` words from position ``at`` (from 0); null where fewer are left."""
    each = [F.get(words, at + i if i else at) for i in range(width)]
    return F.when(each[-1].isNotNull(), F.xxhash64(F.lit(width), *each))


def template_runs(spark, base=tuple(BASE), further=tuple(FURTHER)):
    """The runs of all templates: run (hash), told (its words), template, at, width, n (words), slack, least, label, is_base."""
    rows = [(i, text, label, i < len(base)) for i, (text, label) in enumerate([*base, *further])]
    texts = spark.createDataFrame(rows, "template int, text string, label string, is_base boolean")
    words = words_of(F.col("text"))
    texts = texts.select("template", "label", "is_base", words.alias("words"), F.size(words).alias("n")).where("n > 0")
    width = F.when(F.col("n") < PHRASE, F.least(F.lit(PHRASE_RUN), "n")).otherwise(F.lit(NOTICE_RUN))
    phrase = F.col("n") < PHRASE
    runs = texts.select("*", width.alias("width"), F.when(phrase, 0).otherwise(SLACK).alias("slack"),
                        F.when(phrase, 1.0).otherwise(LEAST).alias("least"))
    runs = runs.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - F.col("width"))).alias("at"))
    run = reduce(lambda x, w: F.when(F.col("width") == w, _run(F.col("words"), F.col("at"), w)).otherwise(x),
                 (1, PHRASE_RUN, NOTICE_RUN), F.lit(None).cast("long"))
    return runs.select(run.alias("run"), F.slice("words", F.col("at") + 1, "width").alias("told"), "template", "at",
                       "width", "n", "slack", "least", "label", "is_base")


def votes(docs, runs, widths=(PHRASE_RUN, NOTICE_RUN)):
    """(doc_id, digest, template, diagonal, hits, n, width, slack, least, label, is_base): where runs of ``docs`` (doc_id, words, digest) vote.

    ``hits`` are the template's places on the diagonal, at most its words, so a text that stands twice counts once.
    """
    words, at = F.col("words"), F.col("p")
    placed = docs.select("doc_id", "digest", "words", F.posexplode("words").alias("p", "w")).drop("w")
    hashed = placed.select("*", F.explode(F.array(*[_run(words, at, w) for w in widths])).alias("run"))
    hits = hashed.where("run IS NOT NULL").join(runs, "run").where(F.slice(words, at + 1, F.col("width")) == F.col("told"))
    kept = ["doc_id", "digest", "template", "n", "width", "slack", "least", "label", "is_base"]
    return hits.groupBy(*kept, (at - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("hits"))


def spans(votes):
    """(doc_id, digest, template, label, is_base, start, end, share) of the verified spans; words from 0, end exclusive."""
    order = Window.partitionBy("doc_id", "digest", "template").orderBy("diagonal")
    apart = F.col("diagonal") - F.lag("diagonal").over(order) > F.col("slack")
    numbered = votes.withColumn("part", F.sum(F.coalesce(apart, F.lit(True)).cast("int")).over(
        order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = numbered.groupBy("doc_id", "digest", "template", "part", "n", "width", "least", "label", "is_base").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.min(F.col("diagonal") + F.array_min("hits")).cast("long").alias("start"),
        F.max(F.col("diagonal") + F.array_max("hits") + F.col("width")).cast("long").alias("end"))
    covered = F.size(F.array_distinct(F.flatten(F.transform(
        "hits", lambda h: F.sequence(h, h + F.col("width") - 1)))))
    share = merged.withColumn("share", covered / F.col("n").cast("double")).where("share >= least")
    return share.select("doc_id", "digest", "template", "label", "is_base", "start", "end", "share")


def find(docs, base=tuple(BASE), further=tuple(FURTHER), doc_id="doc_id", text="text"):
    """All verified spans of ``docs``; templates are pairs of text and label. See ``spans`` for the columns."""
    rows = _rows(docs, doc_id, text).withColumn("digest", F.md5("text"))
    runs = template_runs(docs.sparkSession, base, further)
    sizes = [len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t)) for t, _ in [*base, *further]]
    if sum(sizes) <= BROADCAST:
        runs = F.broadcast(runs)
    widths = {min(PHRASE_RUN, n) if n < PHRASE else NOTICE_RUN for n in sizes if n}
    words = rows.select("doc_id", "digest", words_of(F.col("text")).alias("words"))
    return spans(votes(words, runs, sorted(widths) or [PHRASE_RUN]))


def scan(docs, base=tuple(BASE), further=tuple(FURTHER), doc_id="doc_id", text="text"):
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of every row of ``docs``.

    n_base counts the places of ``base`` phrases, first_word and last_word are the smallest and largest start (null
    without any), labels are sorted arrays, score is the largest share of a template that a span covers (0 without any). Null and
    wordless texts have no words and no label. Repeated rows and null ids each get a row; an empty table gives none;
    other columns are not read. A place is kept for each text of an id, so ids that repeat with other texts stay apart.
    """
    found = find(docs, base, further, doc_id, text).groupBy(F.col("doc_id").alias("of"), F.col("digest").alias("of_text")).agg(
        F.count(F.when(F.col("is_base"), 1)).alias("n_base"),
        F.min(F.when(F.col("is_base"), F.col("start"))).alias("first_word"),
        F.max(F.when(F.col("is_base"), F.col("start"))).alias("last_word"),
        F.array_sort(F.collect_set(F.when(F.col("is_base"), F.col("label")))).alias("base_labels"),
        F.array_sort(F.collect_set("label")).alias("labels"), F.max("share").alias("score"))
    rows = _rows(docs, doc_id, text).select(
        "doc_id", F.md5("text").alias("digest"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    none = F.array().cast("array<string>")
    same = F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("digest") == F.col("of_text"))
    return rows.join(found, same, "left").select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), "first_word", "last_word",
        F.coalesce("base_labels", none).alias("base_labels"), F.coalesce("labels", none).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"))


def _rows(docs, doc_id, text):
    return docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def digest(found):
    """The contract's columns."""
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word",
                        F.array_join("base_labels", ",").alias("base_labels"),
                        F.array_join("labels", ",").alias("labels"), "score")


def _oracle():
    quoted = ",\n".join("({}, '{}', '{}', {})".format(i, t.replace("'", "''"), label, i < len(BASE))
                        for i, (t, label) in enumerate([*BASE, *FURTHER]))
    words = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                   '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""
    return f"""
WITH templates(template, text, label, is_base) AS (VALUES {quoted}),
t AS (SELECT *, {words} AS w FROM templates),
m AS (SELECT *, len(w) AS n, CASE WHEN len(w) < {PHRASE} THEN {PHRASE_RUN} ELSE {NOTICE_RUN} END AS k FROM t),
runs AS (SELECT template, k, a - 1 AS a, array_to_string(w[a:a + k - 1], ' ') AS run
         FROM (SELECT *, unnest(range(1, n - k + 2)) AS a FROM m)),
d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
places AS (SELECT r, k, p - 1 AS p, array_to_string(w[p:p + k - 1], ' ') AS run
           FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS p FROM d, (SELECT unnest([{PHRASE_RUN}, {NOTICE_RUN}]) AS k))),
votes AS (SELECT r, template, p - a AS diagonal, list(DISTINCT a) AS hits FROM places JOIN runs USING (k, run) GROUP BY ALL),
parted AS (SELECT *, sum(new) OVER (PARTITION BY r, template ORDER BY diagonal) AS part FROM (
    SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY r, template ORDER BY diagonal)
                        <= CASE WHEN n < {PHRASE} THEN 0 ELSE {SLACK} END THEN 0 ELSE 1 END AS new
    FROM votes JOIN m USING (template))),
merged AS (SELECT r, template, part, any_value(n) AS n, min(diagonal + list_min(hits)) AS start,
                  len(list_distinct(flatten(list(flatten(list_transform(hits, lambda h: range(h, h + k))))))) AS covered
           FROM parted GROUP BY r, template, part),
spans AS (SELECT r, start, label, is_base, covered / n::DOUBLE AS share FROM merged JOIN t USING (template)
          WHERE covered / n::DOUBLE >= CASE WHEN n < {PHRASE} THEN 1.0 ELSE {LEAST} END::DOUBLE),
found AS (SELECT r, count(*) FILTER (WHERE is_base) AS n_base, min(start) FILTER (WHERE is_base) AS first_word,
                 max(start) FILTER (WHERE is_base) AS last_word,
                 string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE is_base) AS base_labels,
                 string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
          FROM spans GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word,
       CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
       coalesce(score, 0.0::DOUBLE) AS score
FROM d LEFT JOIN found USING (r)"""


ORACLE = _oracle()
