"""License scans with a positional index of rare license words. DataFrame functions only."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

#: ASCII but for letters and digits; what stands between are words.
BETWEEN = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"

#: Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Label, notice in lower case without punctuation, and the phrases that must stand in it whole.
TEMPLATES = (
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license as published by the free software foundation",)),
    ("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    ("agpl", "licensed under the gnu affero general public license", ("gnu affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses license 2 0",)),
    ("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc0", "cc0 1 0 universal public domain dedication", ("cc0", "public domain dedication")),
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ("permission notice shall be included in all copies",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("lgpl", "gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl", "gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("cc-by-sa-4.0", "creative commons attribution sharealike 4 0 international", ("creative commons attribution sharealike 4 0",)),
    ("cc-by-nc-4.0", "creative commons attribution noncommercial 4 0 international", ("creative commons attribution noncommercial 4 0",)),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ("nor the names of its contributors may be used to endorse or promote products",)),
    ("apache-2.0", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", ("unless required by applicable law or agreed to in writing", "on an as is basis")),
    ("mit", "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ("copy modify merge publish distribute sublicense",)),
)

#: Identifiers that stand behind an SPDX tag, and their labels.
SPDX = {
    "GPL-2.0-only": "gpl-2.0", "GPL-2.0-or-later": "gpl-2.0", "GPL-3.0-only": "gpl-3.0", "GPL-3.0-or-later": "gpl-3.0", "LGPL-2.1-only": "lgpl", "LGPL-2.1-or-later": "lgpl", "LGPL-3.0-only": "lgpl", "LGPL-3.0-or-later": "lgpl", "AGPL-3.0-only": "agpl",
    "AGPL-3.0-or-later": "agpl", "Apache-2.0": "apache-2.0", "MIT": "mit", "BSD-2-Clause": "bsd", "BSD-3-Clause": "bsd", "ISC": "isc", "MPL-2.0": "mpl-2.0", "CC0-1.0": "cc0", "CC-BY-4.0": "cc-by-4.0", "CC-BY-SA-4.0": "cc-by-sa-4.0", "CC-BY-NC-4.0": "cc-by-nc-4.0", "Unlicense": "unlicense",
}
#: Words that may be put into a notice, or left out of it, before it's another one.
BAND = 6


def words_of(text: Column) -> Column:
    """Words with A-Z as a-z. lower() folds other letters too, which no word of a license has; the one letter beyond ASCII that it
    would turn into an ASCII letter, the Kelvin sign, is put out of its way."""
    return F.array_remove(F.split(F.lower(F.replace(text, F.lit("\u212a"), F.lit("\ufffd"))), BETWEEN), "")


@dataclass(frozen=True)
class Notice:
    """words, and spans (place, words) of its mandatory phrases, the longest first. A base phrase is one whole mandatory phrase."""

    label: str
    words: tuple[str, ...]
    spans: tuple[tuple[int, tuple[str, ...]], ...]
    base: bool = False


def notices() -> list[Notice]:
    out = [Notice(label, tuple(p.split()), ((0, tuple(p.split())),), True) for p, label in PHRASES.items()]
    tags = [(label, " ".join(f"spdx license identifier {name}".lower().replace("-", " ").replace(".", " ").split())) for name, label in SPDX.items()]
    for label, text, keys in (*TEMPLATES, *((label, tag, (tag,)) for label, tag in tags)):
        words = tuple(text.split())
        spans = []
        for key in (tuple(k.split()) for k in keys):
            spans.append((next(i for i in range(len(words)) if words[i : i + len(key)] == key), key))
        out.append(Notice(label, words, tuple(sorted(spans, key=lambda s: -len(s[1])))))
    return out


def vocabulary() -> list[str]:
    return sorted({w for n in notices() for w in n.words})


def frequencies(texts: DataFrame) -> dict[str, int]:
    """How many texts have each license word: a count over all texts, one row a word of the vocabulary at most."""
    known = F.array(*[F.lit(w) for w in vocabulary()])
    rows = texts.select(F.explode(F.array_intersect(words_of(F.col("text")), known)).alias("word")).groupBy("word").count().collect()
    return {r["word"]: r["count"] for r in rows}


def index(all_: list[Notice], df: dict[str, int], keep: int, votes: int) -> dict[str, list[tuple[int, int]]]:
    """Postings (notice, place) of each indexed word: a notice is posted under the words of highest IDF in its longest mandatory phrase,
    keep of them, or more where one word stands there twice, as at least votes postings must agree."""
    postings: dict[str, list[tuple[int, int]]] = {}
    for n, notice in enumerate(all_):
        at, key = notice.spans[0]
        places = [at + j for j in range(len(key))]
        if len(places) < votes:
            raise ValueError(f"{' '.join(notice.words)}: a mandatory phrase needs {votes} words")
        for place in sorted(places, key=lambda i: (df.get(notice.words[i], 0), i))[: max(keep, votes)]:
            postings.setdefault(notice.words[place], []).append((n, place))
    return postings


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = 0.7, keep: int = 3, votes: int = 2) -> DataFrame:
    """Columns (doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) for each row of docs.

    Document frequencies of all license words are counted over the whole corpus. Each phrase and each template is posted, with
    the place, under the keep words of highest IDF in its mandatory phrases. A text's words of highest IDF are so looked up,
    each giving postings (notice, where that would begin), and postings are intersected by relative position: where votes
    of them name the same notice and beginning, it is verified. As the longest mandatory phrase stands whole in every match, each match
    has all its postings. A phrase counts where all its words stand there. A template gives its label where all its mandatory phrases stand
    whole, the others up to BAND words from their places, and at least share of its words stand within BAND words of where it would
    stand: so words may have been put in or left out. The best share is the score (1 if only a phrase is found, 0 if nothing is). A text of any length costs one pass, a sort of its postings and a
    check for each agreement.

    Defined cases: null and empty texts have no words, labels '' and score 0. Rows that repeat an id are scanned each by
    its own text. Other columns are ignored. An empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    all_ = notices()
    postings = index(all_, frequencies(rows), keep, votes)
    looked = F.array(*[F.lit(w) for w in sorted(postings)])
    pair = lambda n, at: F.struct(F.lit(n).alias("notice"), F.lit(at).alias("place"))
    held = F.create_map(*[x for w in sorted(postings) for x in (F.lit(w), F.array(*[pair(n, at) for n, at in postings[w]]))])

    def stands(words: Column, begin: Column, wanted: tuple[str, ...]) -> Column:
        test = F.lit(True)
        for j, w in enumerate(wanted):
            test = test & F.coalesce(F.get(words, begin + j) == w, F.lit(False))
        return test

    def verified(words: Column, begin: Column, n: Notice) -> Column:
        """The share of a notice's words that stand at their places; 0 if a mandatory phrase doesn't stand whole."""
        keys = stands(words, begin + n.spans[0][0], n.spans[0][1])
        if n.base:
            return F.when(keys, 1.0).otherwise(0.0)
        around = lambda at, length: F.slice(words, F.greatest(begin + (at - BAND), F.lit(0)) + 1, F.lit(length + 2 * BAND))
        for at, key in n.spans[1:]:
            keys = keys & F.contains(F.concat(F.lit(" "), F.array_join(around(at, len(key)), " "), F.lit(" ")), F.lit(f" {' '.join(key)} "))
        own = sorted(set(n.words))
        same = F.size(F.array_intersect(F.array(*[F.lit(w) for w in own]), around(0, len(n.words))))
        return F.when(keys, same / len(own)).otherwise(0.0)

    def agreed(hits: Column) -> Column:
        """Where votes postings name the same notice and beginning, once each: (notice, begin), sorted."""
        named = F.flatten(F.transform(hits, lambda x: F.transform(F.element_at(held, x["w"]), lambda p: F.struct(p["notice"].alias("notice"), (x["i"] - p["place"]).alias("begin")))))
        return let(F.sort_array(named), lambda a: F.array_distinct(F.filter(a, lambda x, i: F.coalesce(F.get(a, i + (votes - 1)) == x, F.lit(False)))))

    def scored(words: Column):
        def one(x: Column) -> Column:
            value = F.lit(0.0)
            for n, notice in enumerate(all_):
                value = F.when(x["notice"] == n, verified(words, x["begin"], notice)).otherwise(value)
            return F.struct(x["notice"].alias("notice"), x["begin"].alias("begin"), value.alias("value"))

        return one

    def scanned(words: Column) -> Column:
        hits = F.filter(F.transform(words, lambda w, i: F.when(F.array_contains(looked, w), F.struct(w.alias("w"), i.alias("i")))), lambda x: x.isNotNull())
        found = lambda h: F.when(F.size(h) >= votes, F.filter(F.transform(agreed(h), scored(words)), lambda x: x["value"] >= share))
        return F.struct(F.size(words).cast("long").alias("n"), let(hits, found).alias("f"))

    rows = rows.select("doc_id", let(words_of(F.col("text")), scanned).alias("s"))
    rows = rows.select("doc_id", "s.n", F.coalesce("s.f", F.array().cast("array<struct<notice:int,begin:int,value:double>>")).alias("f"))
    bases = sum(n.base for n in all_)
    names = F.array(*[F.lit(n.label) for n in all_])
    base = F.filter("f", lambda x: x["notice"] < bases)
    begins = F.transform(base, lambda x: x["begin"])
    joined = lambda f: F.array_join(F.sort_array(F.array_distinct(F.transform(f, lambda x: F.get(names, x["notice"])))), ",")
    best = F.array_max(F.transform(F.filter("f", lambda x: x["notice"] >= bases), lambda x: x["value"]))
    return rows.select(
        "doc_id", F.col("n").alias("n_words"), F.size(base).cast("long").alias("n_base"), F.array_min(begins).cast("long").alias("first_word"), F.array_max(begins).cast("long").alias("last_word"),
        joined(base).alias("base_labels"), joined(F.col("f")).alias("labels"), F.when(F.size(base) > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))).alias("score"),
    )
