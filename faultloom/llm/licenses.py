"""Licence scans by sentence rules.

A text is cut into pieces (at line ends, and at sentence marks before a blank), each normalised to
lower-case letters, digits and single blanks. A sentence that SENTENCES knows becomes an identifier
wherever its words follow one another from the start of a piece to the end of the same or a later
one: line ends, comment marks and sentence marks inside it don't matter, so that hard-wrapped texts
are read like running ones. It counts as one sentence however many lines it takes; every other piece
is an unknown sentence. A rule is an ordered list of identifiers. A rule matches where its
identifiers follow one another with at most MAX_GAP unknown sentences between two of them. Rules are
tried from the longest to the shortest and use up the sentences they match, so the notice inside a
full licence text is not reported again. All of it is one projection: no shuffle, nothing but the
two small tables of rules travels.

Defined cases: a null or empty text has no sentences and no licences. Repeated notices count each.
Rows with null or equal ids keep their own results. Other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_GAP = 3
SENTENCE_END = r"\n+|[.;:!?]+[ \t]+"
COMMENT = "(?:dnl |rem )"  # opens a comment line with letters; other marks fall to the normalising
WRAPPED = rf"\n{COMMENT}?"  # a line end inside a sentence
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: fixed values: sentences of public licence texts and notices, by identifier
SENTENCES = {
    "mit-notice": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-title": "MIT License",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
        "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and "
        "to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "mit-condition": (
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "as-is": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO '
             "THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",  # fmt: skip
    "apache-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-the-license": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "apache-compliance": "you may not use this file except in compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at",
    "apache-unless": (
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
    ),
    "gpl3-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free-software": "This program is free software:",
    "gpl3-terms": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "gpl-received": "You should have received a copy of the GNU General Public License along with this program.",
    "cc-by-nc-4-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4-notice": "Licensed under CC BY 4.0.",
    "cc-by-sa-4-notice": "Licensed under CC BY-SA 4.0.",
    "bsd-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met:"
    ),
    "bsd-source": (
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    ),
    "bsd-binary": (
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
        "disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "bsd-endorse": (
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
        "derived from this software without specific prior written permission."
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "isc-grant-and": (
        "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
    "0bsd-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
    ),
    "gpl2-terms": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
        "Software Foundation; either version 2 of the License, or (at your option) any later version."
    ),
    "gpl2-only-terms": (
        "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by "
        "the Free Software Foundation."
    ),
    "gpl-fitness": "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-see": "See the GNU General Public License for more details.",
    "lgpl-free-software": "This library is free software;",
    "lgpl21-terms": (
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."
    ),
    "lgpl3-terms": (
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "agpl3-terms": (
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
        "Free Software Foundation, either version 3 of the License, or (at your option) any later version."
    ),
    "mpl2-terms": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense-domain": "This is free and unencumbered software released into the public domain.",
    "unlicense-grant": (
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or "
        "as a compiled binary, for any purpose, commercial or non-commercial, and by any means."
    ),
    "boost-grant": (
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        'accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, '
        "and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
        "Software is furnished to do so, all subject to the following:"
    ),
    "boost-notice": "Distributed under the Boost Software License, Version 1.0.",
    "zlib-grant": (
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it "
        "and redistribute it freely, subject to the following restrictions:"
    ),
    "zlib-origin": "The origin of this software must not be misrepresented;",
}

#: licence, identifiers in order
RULES = [
    ("MIT", ["mit-title", "mit-grant", "mit-condition", "as-is"]),
    ("MIT", ["mit-grant", "mit-condition", "as-is"]),
    ("MIT", ["mit-grant", "mit-condition"]),
    ("MIT", ["mit-notice"]),
    ("MIT", ["mit-licensed"]),
    ("Apache-2.0", ["apache-the-license", "apache-compliance", "apache-copy", "apache-unless"]),
    ("Apache-2.0", ["apache-the-license", "apache-compliance"]),
    ("Apache-2.0", ["apache-notice"]),
    ("GPL-3.0-or-later", ["gpl-free-software", "gpl3-terms", "gpl-hope", "gpl-received"]),
    ("GPL-3.0-or-later", ["gpl-free-software", "gpl3-terms"]),
    ("GPL-3.0-only", ["gpl3-notice"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4-notice"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4-notice"]),
    ("CC-BY-4.0", ["cc-by-4-notice"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("ISC", ["isc-grant"]),
    ("ISC", ["isc-grant-and"]),
    ("0BSD", ["0bsd-grant"]),
    ("GPL-3.0-or-later", ["gpl-free-software", "gpl3-terms", "gpl-hope", "gpl-fitness", "gpl-see", "gpl-received"]),
    ("GPL-2.0-or-later", ["gpl-free-software", "gpl2-terms"]),
    ("GPL-2.0-only", ["gpl-free-software", "gpl2-only-terms"]),
    ("LGPL-2.1-or-later", ["lgpl-free-software", "lgpl21-terms"]),
    ("LGPL-2.1-or-later", ["gpl-free-software", "lgpl21-terms"]),
    ("LGPL-3.0-or-later", ["lgpl-free-software", "lgpl3-terms"]),
    ("LGPL-3.0-or-later", ["gpl-free-software", "lgpl3-terms"]),
    ("AGPL-3.0-or-later", ["gpl-free-software", "agpl3-terms"]),
    ("MPL-2.0", ["mpl2-terms"]),
    ("Unlicense", ["unlicense-domain", "unlicense-grant"]),
    ("BSL-1.0", ["boost-grant"]),
    ("BSL-1.0", ["boost-notice"]),
    ("Zlib", ["zlib-grant", "zlib-origin"]),
]


def normalised(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", sentence.translate(str.maketrans(UPPER, LOWER))).strip(" ")


def known_sentences(sentences: dict[str, str] = SENTENCES) -> dict[str, str]:
    """Identifier by normalised piece; a sentence that is cut in pieces is known by its longest one."""
    out = {}
    for name, text in sentences.items():
        pieces = [normalised(p) for p in re.split(SENTENCE_END, text)]
        out[max(pieces, key=len)] = name
    return out


def split_sentences(text: Column) -> Column:
    """Normalised sentences, empty ones left out."""
    lowered = F.translate(text, UPPER, LOWER)
    pieces = F.transform(F.split(lowered, SENTENCE_END), lambda s: F.btrim(F.regexp_replace(s, "[^a-z0-9]+", " "), F.lit(" ")))
    return F.filter(pieces, lambda s: s != "")


def whole_sentences(sentences: dict[str, str] = SENTENCES) -> dict[str, str]:
    """Identifier by all words of the sentence, with single blanks between."""
    return {normalised(text): name for name, text in sentences.items()}


def known_pattern(known: dict[str, str]) -> str:
    """A known sentence from the start of a piece to the end of one, the longest first.

    Pieces follow a line end each. The number of a list and the words that open comments in some
    languages may stand before it.
    """
    texts = [t.replace(" ", f"(?: |{WRAPPED})") for t in sorted(known, key=lambda t: (-len(t), t))]
    return rf"\n(?:{COMMENT}|[0-9]{{1,2}} )?({'|'.join(texts)})(?![^\n])"


def sequence(sentences: Column, known: dict[str, str]) -> Column:
    """Known sentences as <id>, unknown ones as ?, in order."""
    table = F.create_map(*(F.lit(x) for pair in known.items() for x in pair))
    lines = F.array_join(F.transform(sentences, lambda s: F.concat(F.lit("\n"), s)), "")
    parts = F.split(F.regexp_replace(lines, known_pattern(known), "\u0002$1\u0003"), "\u0002")

    def marks(part):
        unknown = F.substring_index(part, "\u0003", -1)
        words = F.regexp_replace(F.substring_index(part, "\u0003", 1), WRAPPED, " ")
        name = F.when(F.contains(part, F.lit("\u0003")), F.concat(F.lit("<"), F.try_element_at(table, words), F.lit(">")))
        gap = F.length(unknown) - F.length(F.replace(unknown, F.lit("\n"), F.lit("")))
        return F.concat(F.coalesce(name, F.lit("")), F.repeat(F.lit("?"), gap))

    return F.array_join(F.transform(parts, marks), "")


def closed(seq: Column) -> Column:
    """Gaps that a rule may span as nothing, longer ones as |."""
    return F.replace(F.regexp_replace(seq, r"\?{%d,}" % (MAX_GAP + 1), "|"), F.lit("?"), F.lit(""))


def ordered_rules(rules=RULES) -> list[tuple[str, str]]:
    """Licence and pattern of every rule, the longest first."""
    return [(name, "".join(f"<{i}>" for i in ids)) for name, ids in sorted(rules, key=lambda r: -len(r[1]))]


def matches(seq: Column, rules=RULES) -> Column:
    """One licence name for every match, rule by rule."""
    table = F.array(*(F.struct(F.lit(n).alias("license"), F.lit(p).alias("pattern")) for n, p in ordered_rules(rules)))

    def step(state, rule):
        left = F.replace(state["seq"], rule["pattern"], F.lit("|"))
        times = (F.length(state["seq"]) - F.length(left)) / (F.length(rule["pattern"]) - 1)
        return F.struct(left.alias("seq"), F.concat(state["found"], F.array_repeat(rule["license"], times.cast("int"))).alias("found"))

    start = F.struct(seq.alias("seq"), F.array().cast("array<string>").alias("found"))
    return F.aggregate(table, start, step, lambda s: s["found"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sentences: dict[str, str] = SENTENCES, rules=RULES) -> DataFrame:
    """Per row: _id, n_sentences, n_known, licenses (sorted, distinct), n_matches."""
    cut = docs.select(F.col(id_col).alias("_id"), split_sentences(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("s"))
    read = cut.select("_id", sequence(F.col("s"), whole_sentences(sentences)).alias("seq"))
    times = lambda c: F.length("seq") - F.length(F.replace("seq", F.lit(c), F.lit("")))
    found = read.select("_id", (times("<") + times("?")).alias("n"), times("<").alias("k"),
                        F.when(F.contains("seq", F.lit("<")), matches(closed(F.col("seq")), rules)).otherwise(F.array().cast("array<string>")).alias("m"))
    return found.select(
        "_id", F.col("n").cast("long").alias("n_sentences"), F.col("k").cast("long").alias("n_known"),
        F.array_join(F.array_sort(F.array_distinct("m")), ",").alias("licenses"), F.size("m").cast("long").alias("n_matches"),
    )


def report(docs: DataFrame) -> DataFrame:
    """op6: the licences named in every document."""
    return scan(docs).withColumnRenamed("_id", "doc_id")
