"""License scans: exact phrases, and an exact set-similarity join of text blocks with license templates.

Only DataFrame functions. Templates are notices and whole license texts. Each has a block
length, at least twice its own, from 16 words on by doubling; a text's blocks of a length start
every half of it, so any run of up to half a block lies wholly in one. A template is found in
a block that holds at least `threshold` of its distinct words; one of few words (below
`WHOLE`), where a single word can make another license, must be there with all of them. The
join works on tokens in one global order, rarest first by the number of documents that hold them:

* prefix: of n template words of which at least a must be there, one of the n - a + 1
  rarest must be; only these are indexed and joined;
* length: the block must have at least a template words;
* position: what follows the joined word in both orders must still be able to reach a.

What passes is verified by counting. All tables that are broadcast derive from the
templates, whose number is fixed.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

#: Phrases whose words stand consecutively, and their labels.
PHRASES = [("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc")]
#: Notices by which licenses are given, whole license texts, and their labels.
TEMPLATES = [
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("licensed under a creative commons attribution 4 0 international license", "cc-by"),
    ("licensed under a creative commons attribution noncommercial 4 0 international license", "cc-by-nc"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("subject to the terms of the mozilla public license version 2 0", "mpl-2"),
    ("all rights reserved", "all-rights-reserved"),
    (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement "
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise "
        "arising from out of or in connection with the software or the use or other dealings in the software",
        "mit",
    ),
    (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness "
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits "
        "whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
        "isc",
    ),
    (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed "
        "in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services "
        "loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise "
        "arising in any way out of the use of this software even if advised of the possibility of such damage",
        "bsd",
    ),
    (
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "apache-2",
    ),
    (
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose "
        "see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program",
        "gpl-3",
    ),
]
THRESHOLD = 0.8
#: Templates of fewer distinct words must be there with all of them.
WHOLE = 20
#: Words are runs of ASCII digits and letters and of anything from U+0080 on.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def lower_ascii(col: Column) -> Column:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(col, upper, upper.lower())


def _texts(values) -> Column:
    return F.array(*(F.lit(v) for v in values)) if values else F.array().cast("array<string>")


def phrase_starts(words: Column, phrase: str, there: Column) -> Column:
    """Places in the array `words` where the phrase's words stand consecutively; `there` is whether all of them occur at all."""
    parts = phrase.split()
    places = F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), lambda i: _all(F.get(words, i + k) == p for k, p in enumerate(parts)))
    return F.when(there, places).otherwise(F.array().cast("array<int>"))


def _all(conditions) -> Column:
    out = None
    for c in conditions:
        out = c if out is None else out & c
    return out


def block_length(template: str) -> int:
    """Words of a template's blocks: a power of two of at least 16, and at least twice its own words."""
    return 1 << max(4, (2 * len(template.split()) - 1).bit_length())


def least_words(template: str, threshold: float) -> int:
    """Distinct words of a template that a block must hold."""
    n = len(set(template.split()))
    return n if n < WHOLE else max(1, math.ceil(threshold * n - 1e-9))


def scan(docs: DataFrame, templates=None, phrases=None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs (doc_id, text; others are ignored).

    n_base counts all places of the phrases, first_word and last_word are the smallest
    and largest word at which one starts (null without any). labels adds to the
    phrases' labels those of the templates found; both are distinct, sorted and
    comma-joined, empty if there are none. score is 1 with a phrase, else the largest
    share of a found template, else 0. Null texts are empty; rows with null or repeated
    ids are scanned each; an empty table gives an empty result. Templates may have any length.
    """
    templates, phrases = templates or TEMPLATES, phrases or PHRASES
    sets = [(sorted(set(t.split())), label) for t, label in templates]
    needs, lengths = [least_words(t, threshold) for t, _ in templates], [block_length(t) for t, _ in templates]
    vocabulary = sorted({w for s, _ in sets for w in s})
    phrase_words = sorted({w for p, _ in phrases for w in p.split()})

    words = F.regexp_extract_all(lower_ascii(F.coalesce("text", F.lit(""))), F.lit(WORD), F.lit(0))
    rows = docs.select("doc_id", words.alias("words"))
    rows = rows.select("doc_id", "words", F.array_intersect(F.col("words"), _texts(sorted({*vocabulary, *phrase_words}))).alias("held"))
    held = F.col("held")
    starts = [phrase_starts(F.col("words"), p, (F.size(F.array_intersect(held, _texts(sorted(set(p.split()))))) == len(set(p.split()))) & (F.size("words") >= len(p.split()))) for p, _ in phrases]
    # A block cannot hold more of a template than its whole text does.
    could = {}
    for (s, _), need, length in zip(sets, needs, lengths, strict=True):
        one = (F.size(held) >= need) & (F.size(F.array_intersect(held, _texts(s))) >= need)
        could[length] = could[length] | one if length in could else one
    sizes = F.array_compact(F.array(*(F.when(c, F.lit(length)) for length, c in could.items())))
    read = written(
        rows.select(
            F.monotonically_increasing_id().alias("row_key"),
            "doc_id",
            F.size("words").cast("long").alias("n_words"),
            F.array(*starts).alias("starts"),
            F.array_intersect(held, _texts(vocabulary)).alias("held"),
            "words",
            sizes.alias("sizes"),
        ).withColumn("words", F.when(F.size("sizes") > 0, F.col("words"))),
        "words",
    )

    # The global order: one row for each word of the templates.
    counts = read.select(F.explode("held").alias("word")).groupBy("word").count().collect()
    seen = {r[0]: r[1] for r in counts}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
    spark = docs.sparkSession
    index = spark.createDataFrame(
        [
            (w, length, i, len(s), need, sorted(s, key=order.get), label)
            for (s, label), need, length in zip(sets, needs, lengths, strict=True)
            for i, w in enumerate(sorted(s, key=order.get)[: len(s) - need + 1])
        ],
        "word string, length int, at int, n int, need int, template_words array<string>, label string",
    )

    sized = read.where("words is not null").select("row_key", "words", F.explode("sizes").alias("length"))
    step = (F.col("length") / 2).cast("int")
    block = lambda i: F.array_intersect(F.slice("words", i + 1, F.col("length")), _texts(vocabulary))
    blocks = sized.select("row_key", "length", F.explode(F.transform(F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), step), block)).alias("tokens"))
    ranks = F.create_map(*(F.lit(x) for w in vocabulary for x in (w, order[w])))
    least = F.create_map(*(F.lit(x) for length in could for x in (length, min(n for n, m in zip(needs, lengths, strict=True) if m == length))))
    blocks = blocks.where(F.size("tokens") >= least[F.col("length")])
    blocks = blocks.withColumn("tokens", F.transform(F.array_sort(F.transform("tokens", lambda w: F.struct(ranks[w].alias("rank"), w.alias("word")))), lambda x: x["word"]))
    probes = blocks.select("row_key", "length", "tokens", F.posexplode("tokens").alias("place", "word"))
    # The first word that both have is followed, in either order, by all others that both have.
    left_both = F.least(F.col("n") - F.col("at"), F.size("tokens") - F.col("place"))
    pairs = probes.join(F.broadcast(index), ["word", "length"]).where((F.size("tokens") >= F.col("need")) & (left_both >= F.col("need")))
    overlap = F.size(F.array_intersect("tokens", "template_words"))
    return _result(read, pairs.where(overlap >= F.col("need")).withColumn("share", overlap / F.col("n")), phrases)


def _result(read: DataFrame, verified: DataFrame, phrases) -> DataFrame:
    found = verified.groupBy("row_key").agg(F.collect_set("label").alias("more"), F.max("share").alias("share"))
    names = F.array(*(F.when(F.size(F.col("starts")[i]) > 0, F.lit(label)) for i, (_, label) in enumerate(phrases)))
    base = F.array_sort(F.array_distinct(F.array_compact(names)))
    every = F.flatten("starts")
    none = F.array().cast("array<string>")
    out = read.drop("words", "held", "sizes").join(found, "row_key", "left").withColumn("base", base).withColumn("every", every)
    return out.select(
        "doc_id",
        "n_words",
        F.size("every").cast("long").alias("n_base"),
        F.array_min("every").cast("long").alias("first_word"),
        F.array_max("every").cast("long").alias("last_word"),
        F.array_join("base", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", none))), ",").alias("labels"),
        F.when(F.size("every") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
