"""Licence scans: known sentences by their normalised words, then ordered rules over their identifiers.

A sentence ends after ``.``, ``!`` or ``?`` before white space, at a blank line, and before a list
mark at the start of a line. Other line ends and comment marks are white space inside a known
sentence, but one may also begin and end at them: of the lines of a sentence, each run that makes a
known one counts, from the first line on and the longest first. A sentence is normalised to
lower-case words of a-z, 0-9, dots and hyphens, one space between them. Known sentences map to
identifiers; others don't count. A rule is a list of identifiers; it is found
where these follow each other in the sequence of the text's known sentences. An occurrence of
a rule that lies inside one of a longer rule is not reported; one that lies elsewhere is.

Null and empty texts have no sentences and no licences. Rows, also repeated ones and those with a
null id, are scanned one by one. An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences and notices, as they stand in those texts.
SENTENCES: Mapping[str, str] = {
    "mit-title": "MIT License",
    "mit-title-the": "The MIT License",
    "mit-title-mark": "The MIT License (MIT)",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
    "associated documentation files (the \"Software\"), to deal in the Software without restriction, including without "
    "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
    "Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial "
    "portions of the Software.",
    "as-is-software": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING "
    "BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-spdx": "SPDX-License-Identifier: MIT",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
    "hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "isc-title": "ISC License",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
    "that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-names": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
    "promote products derived from this software without specific prior written permission.",
    "bsd-spdx-2": "SPDX-License-Identifier: BSD-2-Clause",
    "bsd-spdx-3": "SPDX-License-Identifier: BSD-3-Clause",
    "apache-title": "Apache License",
    "apache-line": "Licensed under the Apache License, Version 2.0.",
    "apache-grant": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
    "compliance with the License.",
    "apache-copy": "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "apache-as-is": "Unless required by applicable law or agreed to in writing, software distributed under the License is "
    "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "apache-spdx": "SPDX-License-Identifier: Apache-2.0",
    "gpl-line-3": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-line-2": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
    "General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
    "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "gpl-details": "See the GNU General Public License for more details.",
    "gpl-spdx-3": "SPDX-License-Identifier: GPL-3.0-or-later",
    "cc-by": "Licensed under CC BY 4.0.",
    "cc-by-sa": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc": "Licensed under CC BY-NC 4.0.",
    "cc-by-long": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to "
    "this work.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v",
    "mpl-copy": "If a copy of the MPL was not distributed with this file, You can obtain one at "
    "http://mozilla.org/MPL/2.0/.",
}

#: (licence, rule, identifiers in order). A notice is enough for some licences, others need their whole text.
RULES: tuple[tuple[str, str, tuple[str, ...]], ...] = (
    ("MIT", "text", ("mit-grant", "mit-notice", "as-is-software")),
    ("MIT", "grant", ("mit-grant", "mit-notice")),
    ("MIT", "title", ("mit-title",)),
    ("MIT", "title-the", ("mit-title-the",)),
    ("MIT", "title-mark", ("mit-title-mark",)),
    ("MIT", "released", ("mit-released",)),
    ("MIT", "licensed", ("mit-licensed",)),
    ("MIT", "spdx", ("mit-spdx",)),
    ("ISC", "text", ("isc-grant",)),
    ("ISC", "titled-text", ("isc-title", "isc-grant")),
    ("BSD-2-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-2-Clause", "spdx", ("bsd-spdx-2",)),
    ("BSD-3-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
    ("BSD-3-Clause", "spdx", ("bsd-spdx-3",)),
    ("Apache-2.0", "notice", ("apache-grant", "apache-copy", "apache-as-is")),
    ("Apache-2.0", "short-notice", ("apache-grant",)),
    ("Apache-2.0", "line", ("apache-line",)),
    ("Apache-2.0", "spdx", ("apache-spdx",)),
    ("GPL-3.0-or-later", "notice", ("gpl-free", "gpl-hope", "gpl-details")),
    ("GPL-3.0-or-later", "grant", ("gpl-free",)),
    ("GPL-3.0-or-later", "spdx", ("gpl-spdx-3",)),
    ("GPL-3.0-only", "line", ("gpl-line-3",)),
    ("GPL-2.0-only", "line", ("gpl-line-2",)),
    ("CC-BY-4.0", "line", ("cc-by",)),
    ("CC-BY-4.0", "long", ("cc-by-long",)),
    ("CC-BY-SA-4.0", "line", ("cc-by-sa",)),
    ("CC-BY-NC-4.0", "line", ("cc-by-nc",)),
    ("CC0-1.0", "waiver", ("cc0",)),
    ("Unlicense", "opening", ("unlicense",)),
    ("MPL-2.0", "notice", ("mpl", "mpl-copy")),
)

#: Replacements that turn a lower-cased text into normalised sentences with ``\\x1E`` between them.
STEPS: tuple[tuple[str, str], ...] = (
    (r"\n[\x20\t]*(#+|//+|\*+)", "\n"),
    (r"\n[\x20\t\r]*\n[\x20\t\r\n]*", "\x1e"),
    (r"\n[\x20\t]*([0-9]+[.)]|-)[\x20\t]", "\x1e"),
    (r"[.!?][\x20\t\r\n]+", "\x1e"),
    (r"[\x00-\x1D\x1F-\x2C\x2F\x3A-\x60\x7B-\x7F]+", " "),
)
_EDGE = " .-"
#: The last step in two parts, for texts whose remaining line ends are kept as ``\\x1D``.
LINE_STEPS: tuple[tuple[str, str], ...] = (
    *STEPS[:-1],
    (r"[\x00-\x09\x0B\x0C\x0E-\x1D\x1F-\x2C\x2F\x3A-\x60\x7B-\x7F]+", " "),
    (r"\x20?[\r\n][\x20\r\n]*", "\x1d"),
)


def normalised(sentence: str) -> list[str]:
    """The normalised sentences of a string, for the table of known ones."""
    body = sentence.lower()
    for pattern, to in STEPS:
        body = re.sub(pattern, to, body)
    return [s for s in (s.strip(_EDGE) for s in body.split("\x1e")) if s]


def known_sentences(table: Mapping[str, str] = SENTENCES) -> dict[str, str]:
    """Normalised sentence to identifier. An entry that is not one sentence is a fault of the table."""
    out: dict[str, str] = {}
    for name, sentence in table.items():
        parts = normalised(sentence)
        if len(parts) != 1 or parts[0] in out or not re.fullmatch(r"[a-z0-9-]+", name):
            raise ValueError(f"{name} is not one new sentence")
        out[parts[0]] = name
    return out


def known_in(text: Column, table: Mapping[str, str] = SENTENCES) -> Column:
    """Identifiers of the known sentences of a text, in order. The whole text goes through each step once."""
    known = known_sentences(table)
    if not known:
        return F.array().cast("array<string>")
    body = F.lower(F.coalesce(text, F.lit("")))
    for pattern, to in LINE_STEPS:
        body = F.regexp_replace(body, pattern, to)
    # Longer ones first, as the first that fits is taken. Words and hyphens need no escape.
    either = "|".join(s.replace(".", r"\.").replace(" ", r"[ \x1D]") for s in sorted(known, key=lambda s: (-len(s), s)))
    found = F.regexp_extract_all(body, F.lit(rf"(?<![^\x1D\x1E])[ .-]*+({either})[ .-]*(?![^\x1D\x1E])"), 1)
    pairs = [F.lit(x) for pair in known.items() for x in pair]
    return F.transform(found, lambda s: F.try_element_at(F.create_map(*pairs), F.translate(s, "\x1d", " ")))


def path_of(names: Sequence[str]) -> str:
    return ">" + "".join(f"{n}>" for n in names)


def _apart(path: str) -> str:
    """A path with marks of its own around each name, so that neighbouring occurrences share none."""
    return path.replace(">", ">>")[1:-1]


def covering_rules(rules: Sequence[tuple[str, str, tuple[str, ...]]]) -> dict[str, list[str]]:
    """For each rule's path, the paths of longer rules that it stands in."""
    paths = [path_of(names) for _, _, names in rules]
    return {p: [q for q in paths if p != q and p in q] for p in paths}


def scan_licences(
    docs: DataFrame, table: Mapping[str, str] = SENTENCES, rules: Sequence[tuple[str, str, tuple[str, ...]]] = RULES,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """Per document: doc_id, n_known long, path string (identifiers), rules and licences (sorted, comma-joined).

    The tables are configuration and part of the plan: hundreds of sentences, not millions.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), known_in(F.col(text_col), table).alias("known"))
    path = F.concat(F.lit(">"), F.array_join(F.transform("known", lambda n: F.concat(n, F.lit(">"))), ""))
    # A generator holds the result, so that the text is not scanned again for every rule.
    rows = rows.select("doc_id", F.inline(F.array(F.struct(F.size("known").cast("long").alias("n_known"), path.alias("path")))))
    longer, found = covering_rules(rules), []
    for licence, rule, names in rules:
        own = path_of(names)
        left = F.replace(F.col("path"), F.lit(">"), F.lit(">>"))
        for other in sorted(longer[own], key=len, reverse=True):
            left = F.replace(left, F.lit(_apart(other)), F.lit("|"))
        here = left.contains(_apart(own))
        found.append(F.when(here, F.struct(F.lit(licence).alias("licence"), F.lit(f"{licence}/{rule}").alias("rule"))))
    hits = F.when(F.col("n_known") > 0, F.filter(F.array(*found), F.isnotnull))
    rows = rows.select("doc_id", "n_known", "path", hits.alias("hits"))

    def joined(part: str) -> Column:
        names = F.array_sort(F.array_distinct(F.transform("hits", lambda h: h[part])))
        return F.coalesce(F.array_join(names, ","), F.lit(""))

    return rows.select("doc_id", "n_known", "path", joined("rule").alias("rules"), joined("licence").alias("licences"))
