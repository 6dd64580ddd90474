"""License scans by a positional rare-token index, in DataFrame functions only.

The index maps each word of a few licence texts to its postings (text, position).
Of each licence text a file looks up the words of the mandatory phrases with the
highest inverse document frequency; a posting and a place in the file give a
relative position, and where postings of one text agree on it, the text is aligned
with the file.  There its mandatory phrases must stand word for word; as they hold
the looked-up words, no place where they stand is missed.  Document frequencies are counted
over all documents, for the words of the index only, so what reaches the driver
is bounded by the licence texts.

A one-line notice is one text of the index.  A whole licence may have words inserted
anywhere between its mandatory phrases (names, years, addresses), so each phrase is a
text of its own, and the licence stands where all its phrases begin it in the same or
a neighbouring stretch of ``1 / DRIFT`` of its length.  Its share is that of its
distinct words which the file has there.

Defined results: null text is empty, has no words and score 0; repeated rows give
repeated results; an empty table gives an empty result; columns other than id and
text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brickwork.functions.text import fence

#: What separates words, after lower-casing.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Words of each licence text that are looked up; two must agree on a place.
LOOKUPS = 2
#: Inserted or lost words may move phrases of a whole licence by at least this part of its length.
DRIFT = 4

# Phrases that name a licence wherever they stand.
PHRASES = (
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
)

# Licence notices as (label, words, mandatory phrases).
NOTICES = (
    ("agpl-3", "licensed under the gnu affero general public license version 3", ("gnu affero general public license version 3",)),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "following conditions are met")),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("gpl-2", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify and or distribute this software", "is hereby granted")),
    ("lgpl-3", "licensed under the gnu lesser general public license version 3", ("gnu lesser general public license version 3",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "obtaining a copy of this software")),
    ("mit", "released under the mit license", ("the mit license",)),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0", ("terms of the mozilla public license v 2 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software", "into the public domain")),
)

# Whole licences as (label, words, mandatory phrases in their order).
LICENCES = (
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software "
        "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense "
        "and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability "
        "fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other "
        "liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        ("deal in the software without restriction", "included in all copies or substantial portions of the software", "use or other dealings in the software"),
    ),
    (
        "bsd-2",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
        "and or other materials provided with the distribution "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to "
        "the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable "
        "for any direct indirect incidental special exemplary or consequential damages",
        ("redistributions of source code must retain the above copyright notice", "redistributions in binary form must reproduce the above copyright notice", "special exemplary or consequential damages"),
    ),
    (
        "bsd-3",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation "
        "and or other materials provided with the distribution "
        "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        "without specific prior written permission "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to "
        "the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable "
        "for any direct indirect incidental special exemplary or consequential damages",
        ("redistributions of source code must retain the above copyright notice", "endorse or promote products derived from this software", "special exemplary or consequential damages"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice "
        "and this permission notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software "
        "including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages "
        "or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action "
        "arising out of or in connection with the use or performance of this software",
        ("this permission notice appear in all copies", "author disclaims all warranties with regard to this software", "use or performance of this software"),
    ),
    (
        "0bsd",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted "
        "the software is provided as is and the author disclaims all warranties with regard to this software "
        "including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages "
        "or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action "
        "arising out of or in connection with the use or performance of this software",
        ("without fee is hereby granted the software is provided as is", "author disclaims all warranties with regard to this software", "use or performance of this software"),
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely "
        "subject to the following restrictions 1 the origin of this software must not be misrepresented you must not claim that you wrote the original software "
        "if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required "
        "2 altered source versions must be plainly marked as such and must not be misrepresented as being the original software "
        "3 this notice may not be removed or altered from any source distribution",
        ("alter it and redistribute it freely", "origin of this software must not be misrepresented", "may not be removed or altered from any source distribution"),
    ),
    (
        "bsl-1",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
        "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software "
        "and to permit third parties to whom the software is furnished to do so all subject to the following "
        "the copyright notices in the software and this entire statement including the above license grant this restriction and the following disclaimer "
        "must be included in all copies of the software in whole or in part and all derivative works of the software "
        "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor",
        ("obtaining a copy of the software and accompanying documentation covered by this license", "prepare derivative works of the software", "machine executable object code generated by a source language processor"),
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software "
        "either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means "
        "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the software to the public domain "
        "we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors",
        ("free and unencumbered software released into the public domain", "dedicate any and all copyright interest in the software", "detriment of our heirs and successors"),
    ),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license "
        "you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions "
        "and limitations under the license",
        ("you may not use this file except in compliance with the license", "unless required by applicable law or agreed to in writing", "specific language governing permissions and limitations under the license"),
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by "
        "the free software foundation either version 3 of the license or at your option any later version "
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu general public license for more details "
        "you should have received a copy of the gnu general public license along with this program",
        ("under the terms of the gnu general public license", "distributed in the hope that it will be useful", "received a copy of the gnu general public license"),
    ),
)


def place(words: list[str], phrase: list[str]) -> int:
    """Where ``phrase`` stands in a notice."""
    return next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)


def _whole(found: str, licence: tuple, first: int) -> Column:
    """(label, at, share) of every place of a licence whose phrases are the texts from number ``first`` on."""
    label, text, phrases = licence
    words = text.split()
    stretch = max(1, len(words) // DRIFT)

    def begun(number: int, start: int) -> Column:
        hits = F.filter(found, lambda f: f["number"] == number)
        return F.array_distinct(F.transform(hits, lambda f: F.floor((f["at"] - start) / F.lit(float(stretch))).cast("int")))

    starts = [begun(first + i, place(words, phrase.split())) for i, phrase in enumerate(phrases)]
    both = starts[0]
    for begins in starts[1:]:
        around = F.flatten(F.transform(begins, lambda b: F.array(b - 1, b, b + 1)))
        both = F.array_intersect(both, around)
    own = sorted(set(words))

    def entry(b: Column) -> Column:
        at = F.greatest((b - 1) * stretch, F.lit(0))
        there = F.array_intersect(_strings(own), F.slice("words", at + 1, len(words) + 3 * stretch))
        return F.struct(F.lit(label).alias("label"), F.greatest(b * stretch, F.lit(0)).alias("at"), (F.size(there) / F.lit(len(own))).alias("share"))

    return F.transform(both, entry)


def _strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _notices(notices) -> Column:
    """Literal array of (label, words, keys as (start, words))."""
    entries = []
    for label, text, phrases in notices:
        words = text.split()
        keys = [F.struct(F.lit(place(words, p.split())).alias("start"), _strings(p.split()).alias("words")) for p in phrases]
        entries.append(F.struct(F.lit(label).alias("label"), _strings(words).alias("words"), F.array(*keys).alias("keys")))
    return F.array(*entries)


def looked_up(notices, idf: dict[str, float], lookups: int) -> list[list[str]]:
    """The words of each notice to look up: the rarest of its mandatory phrases, then the rarest of the rest."""
    out = []
    for _, text, phrases in notices:
        inside = {w for p in phrases for w in p.split()}
        out.append(sorted(set(text.split()), key=lambda w: (w not in inside, -idf[w], w))[: max(lookups, 2)])
    return out


def _postings(notices, looked: list[list[str]]) -> Column:
    """Literal map of looked-up word to the longs ``notice * 2**40 - position``."""
    index: dict[str, list[int]] = {}
    for number, (_, text, _) in enumerate(notices):
        for position, word in enumerate(text.split()):
            if word in looked[number]:
                index.setdefault(word, []).append((number << 40) - position)
    parts = []
    for word in sorted(index):
        parts += [F.lit(word), F.array(*[F.lit(p).cast("long") for p in index[word]])]
    return F.create_map(*parts)


def words_of(text: str | Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def frequencies(docs: DataFrame, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of documents, and of documents with each word of ``vocabulary``."""
    held = F.array_intersect(words_of(F.col("text")), _strings(vocabulary))
    rows = docs.select(F.explode(F.concat(F.array(F.lit("")), held)).alias("word"))
    found = {r["word"]: r["count"] for r in rows.groupBy("word").count().collect()}
    return found.pop("", 0), found


def _starts(words: str, phrase: str) -> Column:
    """Ascending positions where the words of ``phrase`` stand; empty if there are none."""
    parts = phrase.split()
    none = F.array().cast("array<int>")
    inside = F.size(words) >= len(parts)
    for p in parts:
        inside = inside & F.array_contains(words, p)

    def stands(i: Column) -> Column:
        same = F.lit(True)
        for k, p in enumerate(parts):
            same = same & (F.get(words, i + k) == p)
        return same

    return F.when(inside, F.filter(F.sequence(F.lit(0), F.size(words) - len(parts)), stands)).otherwise(none)


def scan(docs: DataFrame, notices=NOTICES, lookups: int = LOOKUPS, licences=LICENCES) -> DataFrame:
    """Phrase places and licence labels of every document.

    Columns: doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score (the largest share of a verified notice that stands word for word at its
    place, or of the words of a whole licence; 1 for a base phrase), ``found`` (label,
    word position and share; a whole licence is placed by its stretch).
    """
    n_notices = len(notices)
    firsts = [n_notices + sum(len(x[2]) for x in licences[:k]) for k in range(len(licences))]
    notices = [*notices, *[(label, phrase, (phrase,)) for label, _, phrases in licences for phrase in phrases]]
    vocabulary = sorted({w for _, text, _ in notices for w in text.split()})
    total, counts = frequencies(docs, vocabulary)
    idf = {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in vocabulary}
    own = looked_up(notices, idf, lookups)
    rows = docs.select("doc_id", words_of(F.col("text")).alias("words"))
    # Words of a notice of which the file holds at least two, which may agree on a place.
    rows = rows.withColumn("held", F.array_intersect(_strings(sorted({w for words in own for w in words})), F.col("words")))
    some = [F.array_intersect("held", _strings(words)) for words in own]
    looked = F.array_distinct(F.flatten(F.array(*[F.when(F.size(x) > 1, x).otherwise(F.array().cast("array<string>")) for x in some])))
    looked = F.when(F.size("held") > 1, looked).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("looked", looked)
    for number, (phrase, _) in enumerate(PHRASES):
        rows = rows.withColumn(f"base{number}", _starts("words", phrase))
    postings, texts = _postings(notices, own), _notices(notices)
    hits = F.filter(
        F.transform("words", lambda w, i: F.when(F.array_contains("looked", w), F.struct(w.alias("w"), i.cast("long").alias("i")))),
        lambda h: h.isNotNull(),
    )
    aligned = F.flatten(F.transform(hits, lambda h: F.transform(F.element_at(postings, h["w"]), lambda p: p + h["i"])))
    none = F.array().cast("array<bigint>")
    rows = rows.withColumn("aligned", F.when(F.size("looked") > 1, F.array_sort(aligned)).otherwise(none))

    def agreed(k: Column, i: Column) -> Column:
        again = (i > 0) & (F.get("aligned", F.greatest(i - 1, F.lit(0))) == k)
        first = (i < 2) | (F.get("aligned", F.greatest(i - 2, F.lit(0))) != k)
        return again & first

    def opened(k: Column) -> Column:
        # A text may begin before the file does: round to the nearest multiple of 2**40.
        number = F.floor((k + (1 << 39)) / F.lit(float(1 << 40)))
        return F.struct(number.cast("int").alias("number"), F.element_at(texts, (number + 1).cast("int")).alias("notice"), (k - number * (1 << 40)).cast("int").alias("at"))

    def verified(c: Column) -> Column:
        def stands(key: Column) -> Column:
            start = c["at"] + key["start"]
            return (start >= 0) & (F.slice("words", F.greatest(start, F.lit(0)) + 1, F.size(key["words"])) == key["words"])

        return F.forall(c["notice"]["keys"], stands)

    def share(c: Column) -> Column:
        same = F.filter(
            F.transform(c["notice"]["words"], lambda w, i: (c["at"] + i >= 0) & F.coalesce(F.get("words", F.greatest(c["at"] + i, F.lit(0))) == w, F.lit(False))),
            lambda ok: ok,
        )
        return F.size(same) / F.size(c["notice"]["words"])

    agreeing = F.transform(F.filter("aligned", agreed), opened)
    found = F.transform(
        F.filter(agreeing, verified),
        lambda c: F.struct(c["number"].alias("number"), c["notice"]["label"].alias("label"), c["at"].alias("at"), share(c).alias("share")),
    )
    empty = F.array().cast("array<struct<number:int,label:string,at:int,share:double>>")
    rows = rows.withColumn("stands", F.when(F.size("aligned") > 1, found).otherwise(empty))
    lines = F.transform(F.filter("stands", lambda f: f["number"] < n_notices), lambda f: F.struct(f["label"].alias("label"), f["at"].alias("at"), f["share"].alias("share")))
    whole = [_whole("stands", licence, first) for licence, first in zip(licences, firsts)]
    empty = F.array().cast("array<struct<label:string,at:int,share:double>>")
    rows = rows.withColumn("found", F.when(F.size("stands") > 0, F.concat(lines, *whole)).otherwise(empty))
    base = [F.col(f"base{number}") for number in range(len(PHRASES))]
    labels = F.array_sort(F.array_compact(F.array(*[F.when(F.size(b) > 0, F.lit(label)) for b, (_, label) in zip(base, PHRASES)])))
    every = F.concat(*base)
    n_base = F.size(every).cast("long")
    best = F.coalesce(F.array_max(F.transform("found", lambda f: f["share"])), F.lit(0.0))
    rows = rows.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        n_base.alias("n_base"),
        F.array_min(every).cast("long").alias("first_word"),
        F.array_max(every).cast("long").alias("last_word"),
        F.array_join(labels, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(labels, F.transform("found", lambda f: f["label"])))), ",").alias("labels"),
        F.when(n_base > 0, F.lit(1.0)).otherwise(best).alias("score"),
        "found",
    )
    # Filters on the result are not pushed into the steps, which would repeat them.
    return fence(rows, rows.columns)
