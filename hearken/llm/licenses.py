"""Licence recognition by sentence rules, with DataFrame functions only.

Texts are cut after `.`, `!`, `?`, `;` or `:` followed by white space, at line ends, and between paragraphs (at lines without
a letter or digit). A sentence is one piece, or several pieces in a row that only single line ends part, so hard-wrapped
licences and commented headers are read as well: what stands before the first letter or digit of a line, and a leading
`rem` or `dnl`, is a comment mark. A sentence is normalised: lower case, and every run of other characters than a-z and 0-9
becomes one space. All known sentences form one regular expression, a tree of their words, which begins and ends at cuts
only; of several that begin at one cut the longest counts, and pieces within it do not count again. Known sentences have
identifiers. The identifiers of a text, in order, are matched against ordered rules: each rule is a sequence of identifiers,
a rule that occurs yields its licence and takes its sentences away, and later rules see the rest. So a longer licence, which
comes first, is not also reported as a shorter one that it contains.

Defined results: null and empty texts, and texts without a known sentence, have no licence (an empty list and an empty
sequence). Every row is judged by itself, repeated rows and rows with a null doc_id too. A licence found several times is
reported once. Further columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of published licences and notices, in rule order.
GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions:"
)
NOTICE = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
REDISTRIBUTION = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met:"
)
SOURCE_FORM = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
)
BINARY_FORM = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution."
)
ENDORSEMENT = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission."
)
ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies."
)
ZERO_GRANT = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."
APACHE_FILE = 'Licensed under the Apache License, Version 2.0 (the "License");'
APACHE_USE = "you may not use this file except in compliance with the License."
GPL_FREE = "This program is free software:"
GPL_3 = (
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
    "Software Foundation, either version 3 of the License, or (at your option) any later version."
)
GPL_OLD = "This program is free software;"
GPL_2 = (
    "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free "
    "Software Foundation; either version 2 of the License, or (at your option) any later version."
)

RULES: list[tuple[str, list[str]]] = [
    ("MIT", [GRANT, NOTICE]),
    ("BSD-3-Clause", [REDISTRIBUTION, SOURCE_FORM, BINARY_FORM, ENDORSEMENT]),
    ("BSD-2-Clause", [REDISTRIBUTION, SOURCE_FORM, BINARY_FORM]),
    ("ISC", [ISC_GRANT]),
    ("0BSD", [ZERO_GRANT]),
    ("Apache-2.0", [APACHE_FILE, APACHE_USE]),
    ("Apache-2.0", ["Licensed under the Apache License, Version 2.0."]),
    ("Apache-2.0", ["This project is licensed under the Apache License, Version 2.0."]),
    ("GPL-3.0-or-later", [GPL_FREE, GPL_3]),
    ("GPL-2.0-or-later", [GPL_OLD, GPL_2]),
    ("GPL-3.0-only", ["This work is licensed under the GNU General Public License, version 3."]),
    ("GPL-2.0-only", ["This work is licensed under the GNU General Public License, version 2."]),
    ("LGPL-2.1-only", ["This work is licensed under the GNU Lesser General Public License, version 2.1."]),
    ("LGPL-3.0-only", ["This work is licensed under the GNU Lesser General Public License, version 3."]),
    ("AGPL-3.0-only", ["This work is licensed under the GNU Affero General Public License, version 3."]),
    ("MPL-2.0", ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."]),
    ("MIT", ["Released under the MIT License."]),
    ("MIT", ["Licensed under the MIT License."]),
    ("MIT", ["This project is licensed under the MIT License."]),
    ("BSD-3-Clause", ["Released under the 3-Clause BSD License."]),
    ("BSD-2-Clause", ["Released under the 2-Clause BSD License."]),
    ("Unlicense", ["This is free and unencumbered software released into the public domain."]),
    ("CC0-1.0", ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."]),
    ("CC-BY-4.0", ["This work is licensed under a Creative Commons Attribution 4.0 International License."]),
    ("CC-BY-SA-4.0", ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."]),
    ("CC-BY-NC-4.0", ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."]),
    ("CC-BY-4.0", ["Licensed under CC BY 4.0."]),
    ("CC-BY-SA-4.0", ["Licensed under CC BY-SA 4.0."]),
    ("CC-BY-NC-4.0", ["Licensed under CC BY-NC 4.0."]),
    ("CC-BY-ND-4.0", ["Licensed under CC BY-ND 4.0."]),
    ("CC-BY-NC-SA-4.0", ["Licensed under CC BY-NC-SA 4.0."]),
    ("CC-BY-NC-ND-4.0", ["Licensed under CC BY-NC-ND 4.0."]),
    ("LicenseRef-All-Rights-Reserved", ["All rights reserved."]),
]

CUT = r"[\n\r]+|(?<=[.!?;:])[ \t\n\x0B\f\r]+"


def cut(text: str) -> list[str]:
    """The sentences of a text, as the Spark expression cuts them."""
    return re.split(CUT, text)


def normalised(sentence: str) -> str:
    return re.sub(r"[^a-z0-9]+", " ", re.sub(r"[A-Z]", lambda m: m[0].lower(), sentence)).strip()


def table_of(rules: list[tuple[str, list[str]]]) -> tuple[dict[str, str], list[tuple[str, str]]]:
    """Identifiers of normalised sentences, and ordered (licence, sequence) rules; sequences look like `|s1|s2|`.

    A rule sentence that holds cutting marks inside counts as the several sentences it is cut into.
    """
    ids: dict[str, str] = {}
    ordered = []
    for licence, sentences in rules:
        parts = [n for s in sentences for c in cut(s) if (n := normalised(c))]
        ordered.append((licence, "|" + "|".join(ids.setdefault(p, f"s{len(ids) + 1}") for p in parts) + "|"))
    return ids, ordered


def marked_text(text: Column) -> Column:
    """The normalised text, with a line end where only a single one stood and a bar at every other cut."""
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ|", "abcdefghijklmnopqrstuvwxyz ")
    lower = F.replace(F.replace(lower, F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    bare = F.regexp_replace(lower, r"(?md)^[^a-z0-9\n]*+(?:(?:rem|dnl)(?![^ \t\n])[^a-z0-9\n]*+)?", "")
    cuts = F.regexp_replace(bare, r"[.!?;:][ \t\n\x0B\f]+|\n\n+", "|")
    return F.concat(F.lit("|"), F.regexp_replace(cuts, r"[^a-z0-9\n|]+", " "), F.lit("|"))


def tree(sentences: list[list[str]]) -> str:
    """A regular expression for the word sequences, the longer ones first."""
    branches: dict[str, list[list[str]]] = {}
    for words in sentences:
        if words:
            branches.setdefault(words[0], []).append(words[1:])
    ways = []
    for word, rest in branches.items():
        after = tree(rest)
        ways.append(word + (f"(?:[ \\n]+{after})" + "?" * ([] in rest) if after else ""))
    return ways[0] if len(ways) == 1 else f"(?:{'|'.join(ways)})" if ways else ""


def known_sentences(text: Column, ids: dict[str, str]) -> Column:
    """Identifiers of the known sentences of a text, in text order."""
    if not ids:
        return F.array().cast("array<string>")
    found = F.regexp_extract_all(marked_text(text), F.lit(rf"[\n|] ?({tree([s.split() for s in ids])})(?= ?[\n|])"), 1)
    names = F.create_map(*[F.lit(x) for pair in ids.items() for x in pair])
    return F.transform(found, lambda s: names[F.regexp_replace(s, r"[ \n]+", " ")])


def matched(sequence: Column, rules: list[tuple[str, str]]) -> Column:
    """Licences in rule order; `sequence` is `|s1||s2|...`, with every identifier between bars of its own."""
    literal = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit(seq.replace("|", "||")[1:-1]).alias("seq")) for licence, seq in rules])
    start = F.struct(sequence.alias("left"), F.array().cast("array<string>").alias("found"))

    def step(state: Column, rule: Column) -> Column:
        hit = F.contains(state["left"], rule["seq"])
        return F.struct(
            F.when(hit, F.replace(state["left"], rule["seq"], F.lit("#"))).otherwise(state["left"]).alias("left"),
            F.when(hit, F.concat(state["found"], F.array(rule["licence"]))).otherwise(state["found"]).alias("found"),
        )

    return F.array_distinct(F.aggregate(literal, start, step)["found"])


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """(id, licenses, sentences): licences in rule order and identifiers in text order, both joined by spaces."""
    ids, ordered = table_of(rules)
    judged = docs.select(id_col, F.coalesce(known_sentences(F.col(text_col), ids), F.array().cast("array<string>")).alias("_names"))
    bars = F.array_join(F.transform("_names", lambda s: F.concat(F.lit("|"), s, F.lit("|"))), "")
    return judged.select(id_col, F.array_join(matched(bars, ordered), " ").alias("licenses"), F.array_join("_names", " ").alias("sentences"))
