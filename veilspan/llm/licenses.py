"""Licence recognition by sentence rules.

A known licence sentence is found where it begins at the begin and ends at the end of a line or a sentence;
inside, its words may be wrapped over lines, with comment marks before each, but not over an empty line or a
full stop.  The identifiers found, in order, are a sequence; ordered rules over identifiers
name the licences.  Everything is column expressions over one row: no shuffle and no Python.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

#: Known sentences: identifier to normalised sentence (lower case, words of letters, digits and dots, one blank between).
#: The public texts of the licences.
SENTENCES = {
    "apache-line": "licensed under the apache license version 2.0",
    "apache-may-not": "you may not use this file except in compliance with the license",
    "apache-copy": "you may obtain a copy of the license at http www.apache.org licenses license 2.0",
    "apache-basis": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "apache-see": "see the license for the specific language governing permissions and limitations under the license",
    "mit-line": "released under the mit license",
    "mit-licensed": "licensed under the mit license",
    "mit-title": "the mit license mit",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-notice": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "no-liability": "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-endorse": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "gpl3-line": "this work is licensed under the gnu general public license version 3",
    "gpl2-line": "this work is licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "gpl-hope": "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    "gpl-see": "see the gnu general public license for more details",
    "mpl-line": "this source code form is subject to the terms of the mozilla public license v",
    "cc-by-nc-line": "licensed under cc by nc 4.0",
    "cc-by-line": "licensed under cc by 4.0",
    "cc-by-sa-line": "licensed under cc by sa 4.0",
    "cc-by-work": "this work is licensed under a creative commons attribution 4.0 international license",
    "cc0-line": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "reserved": "all rights reserved",
    "spdx-mit": "spdx license identifier mit",
    "spdx-apache": "spdx license identifier apache 2.0",
    "spdx-gpl3": "spdx license identifier gpl 3.0 or later",
}
#: Other spellings of known sentences, in use in headers and licence texts, with the identifier of the known one.
#: Parts that a colon or semicolon ends stand for the whole sentence where its begin differs from program to program.
VARIANTS = {
    "licensed under the apache license version 2.0 the license": "apache-line",
    "licensed under the apache license 2.0": "apache-line",
    "this file is licensed under the apache license version 2.0 the license": "apache-line",
    "this project is licensed under the apache license version 2.0": "apache-line",
    "the asf licenses this file to you under the apache license version 2.0 the license": "apache-line",
    "you may not use this file except in compliance with the license you may obtain a copy of the license at": "apache-may-not",
    "you may not use this work except in compliance with the license": "apache-may-not",
    "you may obtain a copy of the license at": "apache-copy",
    "you may obtain a copy of the license at https www.apache.org licenses license 2.0": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind express or implied": "apache-basis",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranty or conditions of any kind either express or implied": "apache-basis",
    "this project is licensed under the mit license": "mit-licensed",
    "licensed under the mit license the license": "mit-licensed",
    "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and non infringement": "as-is",
    "redistributions of source code must retain the copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-source",
    **{f"neither the name of {holder} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse"
       for holder in ("the university", "the organization", "the company", "the author", "the project", "google inc", "google llc", "copyright holder", "the copyright holders")},
    "the name of the author may not be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    **{f"{begin}it and or modify it under the terms of the gnu general public license as published by the free software foundation either version {v} of the license or at your option any later version": i
       for v, i in ((3, "gpl-free"), (2, "gpl2-free")) for begin in ("you can redistribute ", "this software is free software you can redistribute ", "this is free software you can redistribute ")},
    **{f"{begin}it and or modify it under the terms of the gnu general public license as published by the free software foundation version {v} of the license": i
       for v, i in ((3, "gpl-free"), (2, "gpl2-free")) for begin in ("you can redistribute ", "this program is free software you can redistribute ")},
    **{f"this {what} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-hope"
       for what in ("software", "file", "package")},
    "this source code form is subject to the terms of the mozilla public license v. 2.0": "mpl-line",
    "spdx license identifier gpl 3.0 only": "spdx-gpl3",
}
#: Ordered rules: licence, and identifiers that must occur one after another, with anything between.  The first rule for
#: a licence that matches names it; a licence listed in ``UNLESS`` is dropped where the other is found.
RULES = (
    ("Apache-2.0", ("apache-may-not", "apache-basis", "apache-see")), ("Apache-2.0", ("apache-line",)), ("Apache-2.0", ("spdx-apache",)),
    ("MIT", ("mit-grant", "mit-notice", "as-is")), ("MIT", ("mit-line",)), ("MIT", ("mit-licensed",)), ("MIT", ("mit-title",)), ("MIT", ("spdx-mit",)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")), ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("ISC", ("isc-grant",)), ("GPL-3.0", ("gpl-free", "gpl-hope")), ("GPL-3.0", ("gpl3-line",)), ("GPL-3.0", ("spdx-gpl3",)),
    ("GPL-2.0", ("gpl2-free", "gpl-hope")), ("GPL-2.0", ("gpl2-line",)), ("MPL-2.0", ("mpl-line",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-line",)), ("CC-BY-4.0", ("cc-by-line",)), ("CC-BY-4.0", ("cc-by-work",)), ("CC-BY-SA-4.0", ("cc-by-sa-line",)),
    ("CC0-1.0", ("cc0-line",)), ("Proprietary", ("reserved",)),
)
UNLESS = {"BSD-2-Clause": "BSD-3-Clause"}
#: Of the text with marks: begin and end of a sentence.  A full stop before white space and an empty line are marked ~,
#: a colon or semicolon before white space |, other line ends stay.
BOUND = r"[~|\n]"
#: Between two words of a known sentence: a blank, a line's end, or a colon or semicolon, also at a line's end.
BETWEEN = r"(?: |\n|[|] ?\n?)"
#: Each known sentence has one of these; texts without are passed over.
SIGNALS = r"(?i)licen[sc]|redistribution|free software|\bwarrant|\bpermission|\brights|\bliable\b|spdx"


def normalised(sentence: Column) -> Column:
    """Lower case (A-Z), other characters than letters, digits and inner dots as one blank."""
    lowered = F.translate(sentence, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_replace(lowered, "[^a-z0-9.]+", " ")
    undotted = F.regexp_replace(F.regexp_replace(words, "(^| )[.]+", "$1"), "[.]+( |$)", "$1")
    return F.trim(F.regexp_replace(undotted, " +", " "))


def marked(text: Column) -> Column:
    """The text's normalised words, one blank between, with marks for ends of sentences and lines."""
    out = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ~|", "abcdefghijklmnopqrstuvwxyz,,")
    for pattern, by in (
        (r"(?m)^[ \t]*(?:rem|dnl)[ \t]+", ""),  # comment marks that are words
        (r"[.](?=[ \t\r\n])", "~"), (r"[;:](?=[ \t\r\n])", "|"),
        (r"\n[^a-z0-9]*\n", "~"),
        (r"[^a-z0-9.~|\n]+", " "),
        (r"(?<![a-z0-9.])[.]++|(?<![.])[.]++(?![a-z0-9])", ""),
        (" {2,}", " "), (" ?([~|\\n]) ?", "$1"),
    ):
        out = F.regexp_replace(out, pattern, by)
    return F.concat(F.lit("~"), F.trim(out), F.lit("~"))


def sentence_ids(text: Column, sentences: dict[str, str] | None = None) -> Column:
    """Identifiers of the known sentences of a text, in order, repeats included; null and empty texts have none."""
    known = {sentence: identifier for identifier, sentence in (sentences or SENTENCES).items()}
    if sentences is None:  # most texts have no signal and are passed over
        known |= VARIANTS
        text = F.when(text.rlike(SIGNALS), text)
    known = {s: i for s, i in known.items() if re.fullmatch("[a-z0-9. ]*[a-z0-9][a-z0-9. ]*", s)}  # no other sentence is a normalised one
    table = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    # The longest first: a sentence may be the begin of another one.
    options = "|".join(BETWEEN.join(w.replace(".", "[.]") for w in s.split()) for s in sorted(known, key=lambda s: (-len(s), s)))
    found = F.regexp_extract_all(marked(F.coalesce(text, F.lit(""))), F.lit(f"(?<={BOUND})(?:{options})(?={BOUND})"), F.lit(0))
    return F.transform(found, lambda s: F.try_element_at(table, F.regexp_replace(s, "[ |\n]+", " ")))


def licences_of(ids: Column, rules: tuple = RULES, unless: dict[str, str] | None = None) -> Column:
    """Names of the licences whose rule matches the sequence of identifiers, sorted, each once."""
    joined = F.concat(F.lit(" "), F.array_join(ids, " "), F.lit(" "))
    found = []
    for name, wanted in rules:
        pattern = " ".join(wanted).replace(" ", " (?:.* )?")
        found.append(F.when(joined.rlike(f" {pattern} "), F.lit(name)))
    names = F.array_sort(F.array_distinct(F.array_compact(F.array(*found))))
    for weaker, stronger in (UNLESS if unless is None else unless).items():
        names = F.when(F.array_contains(names, stronger), F.array_remove(names, weaker)).otherwise(names)
    return names


def scan(docs: DataFrame, text: str = "text", ids: str = "sentence_ids", licences: str = "licences") -> DataFrame:
    """``docs`` plus the sequence of identifiers and the licences.

    Null and empty texts have none; rows stay apart; columns called like the new ones are replaced.
    """
    return docs.withColumn(ids, sentence_ids(F.col(text))).withColumn(licences, licences_of(F.col(ids)))
