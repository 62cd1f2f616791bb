"""Licence recognition by sentence rules.

A text is normalised to lower-case ASCII words between ends: hard ends of sentences and at blank lines, soft ends of
lines and after the abbreviation "v.". Known licence sentences are found from one end to another; soft ends may stand
within them, so that wrapped text is found too. Only ``UNWRAPPED`` sentences, short phrases, stand on one line. The
sequence of identifiers found is then matched against ordered licence rules. A rule holds if its identifiers occur in
its order, whatever stands between them: one walk over the identifiers per rule that waits for its next one, so 100,000
sentences in a text are no matter. ``HIDES`` names licences that a longer one stands in for. ``TITLES`` and wrapped
sentences are beyond the SQL counterpart.

Null and empty texts have no sentences. Repeated rows are each judged alone. Texts without any word that known
sentences are anchored on are not cut at all.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Identifier and normalised wording of licence sentences.
SENTENCES = [
    ("apache.short", "licensed under the apache license version 2 0"),
    ("apache.header", "licensed under the apache license version 2 0 the license"),
    ("apache.terms", "you may not use this file except in compliance with the license"),
    ("apache.copy", "you may obtain a copy of the license at"),
    ("apache.basis", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("mit.short", "released under the mit license"),
    ("mit.under", "licensed under the mit license"),
    ("mit.title", "the mit license"),
    ("mit.notice", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("gpl3.short", "this work is licensed under the gnu general public license version 3"),
    ("gpl3.under", "licensed under the gnu general public license version 3"),
    ("gpl2.under", "licensed under the gnu general public license version 2"),
    ("gpl.free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl.hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("gpl.more", "see the gnu general public license for more details"),
    ("bsd.grant", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd.source", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd.binary", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd.name", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd.university", "neither the name of the university nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("mit.grant", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions"),
    ("gpl2.free", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("lgpl21.free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl3.free", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl3.free", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("isc.grant", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("unlicense.free", "this is free and unencumbered software released into the public domain"),
    ("unlicense.anyone", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means"),
    ("epl2.terms", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0"),
    ("zlib.warranty", "this software is provided as is without any express or implied warranty"),
    ("zlib.origin", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("mpl2.short", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("ccby.short", "licensed under cc by 4 0"),
    ("ccby.full", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("ccbysa.short", "licensed under cc by sa 4 0"),
    ("ccbync.short", "licensed under cc by nc 4 0"),
    ("ccbync.full", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc0.short", "released under the cc0 1 0 universal public domain dedication license"),
    ("rights.reserved", "all rights reserved"),
]

#: Identifiers that stand in "SPDX-License-Identifier:" lines.
SPDX = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0",
    "CC0-1.0", "EPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later",
    "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-2.0", "Unlicense", "Zlib",
]


def spdx_words(name: str) -> str:
    return "spdx license identifier " + re.sub("[^a-z0-9]+", " ", name.lower())


SENTENCES += [(f"spdx.{name}", spdx_words(name)) for name in SPDX]

#: Further forms of sentences.
TITLES = [("mit.title", "mit license")]
#: Identifiers of sentences that no line end may stand in.
UNWRAPPED = {"rights.reserved"}

#: Licence and the identifiers that have to follow one another.
RULES = [
    ("Apache-2.0", ["apache.short"]),
    ("Apache-2.0", ["apache.header", "apache.terms", "apache.copy"]),
    ("Apache-2.0", ["apache.terms", "apache.basis"]),
    ("MIT", ["mit.short"]),
    ("MIT", ["mit.under"]),
    ("MIT", ["mit.title", "mit.notice"]),
    ("GPL-3.0", ["gpl3.short"]),
    ("GPL-3.0", ["gpl3.under"]),
    ("GPL-3.0", ["gpl.free", "gpl.hope", "gpl.more"]),
    ("GPL-2.0", ["gpl2.under"]),
    ("BSD-2-Clause", ["bsd.grant", "bsd.source", "bsd.binary"]),
    ("BSD-3-Clause", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.name"]),
    ("BSD-3-Clause", ["bsd.grant", "bsd.source", "bsd.binary", "bsd.university"]),
    ("MIT", ["mit.grant", "mit.notice"]),
    ("GPL-2.0-or-later", ["gpl2.free", "gpl.hope", "gpl.more"]),
    ("LGPL-2.1-or-later", ["lgpl21.free"]),
    ("LGPL-3.0-or-later", ["lgpl3.free"]),
    ("AGPL-3.0-or-later", ["agpl3.free"]),
    ("ISC", ["isc.grant"]),
    ("Unlicense", ["unlicense.free", "unlicense.anyone"]),
    ("EPL-2.0", ["epl2.terms"]),
    ("Zlib", ["zlib.warranty", "zlib.origin"]),
    ("MPL-2.0", ["mpl2.short"]),
    ("CC-BY-4.0", ["ccby.short"]),
    ("CC-BY-4.0", ["ccby.full"]),
    ("CC-BY-SA-4.0", ["ccbysa.short"]),
    ("CC-BY-NC-4.0", ["ccbync.short"]),
    ("CC-BY-NC-4.0", ["ccbync.full"]),
    ("CC0-1.0", ["cc0.short"]),
    ("Proprietary", ["rights.reserved"]),
]
RULES += [(name, [f"spdx.{name}"]) for name in SPDX]

#: A licence and those whose sentences are among its own.
HIDES = {"BSD-3-Clause": ["BSD-2-Clause"]}

#: Every known sentence holds one of these words or word parts, so texts without them need no cutting.
ANCHORS = ["licens", "warranty", "redistribut", "copyright", "rights reserved", "unencumbered", "compiled", "misrepresented", "endorse"]
SENTENCE_END = r"[.!?]+[\x20\x09-\x0D]+|\n+"
SPACES = r"[\x20\x09-\x0D]"
#: Pattern and its mark, a capital, of which lower-case text has none: H for hard and S for soft ends.
ENDS = [
    (rf"(?<![a-z0-9])v\.(?={SPACES})[\x20\x09\x0B-\x0D]*\n?", "v S "),
    (rf"[.!?]+{SPACES}+", " H "),
    (r"\n[^a-z0-9A-Z\n]*\n", " H "),
    (r"\n", " S "),
    ("[^a-z0-9A-Z]+", " "),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def check_tables(sentences: list[tuple[str, str]], anchors: list[str]) -> None:
    bare = [name for name, words in sentences if not any(a in words for a in anchors)]
    if bare:
        raise ValueError(f"no anchor for {bare}")


def holds(identifiers: Column, rule: list[str]) -> Column:
    """Whether the identifiers of a rule occur in its order: the state is how many of them were met."""
    awaited = F.array(*[F.lit(x) for x in rule])
    met = F.aggregate(identifiers, F.lit(0), lambda n, x: F.when(x == F.get(awaited, n), n + 1).otherwise(n))
    return met == len(rule)


def sentence_pattern(sentences: list[tuple[str, str]]) -> str:
    """Pattern of any known sentence from end to end in marked text; of those with one start, the shortest."""
    forms = sorted(sentences, key=lambda x: len(x[1]))
    each = "|".join((" " if name in UNWRAPPED else "(?: S)? ").join(words.split(" ")) for name, words in forms)
    return f"(?<=[HS] )(?:{each})(?= [HS])"


def licence_sentences(text: Column, sentences: list[tuple[str, str]], anchors: list[str]) -> Column:
    """Identifiers of the known sentences of a text, in its order."""
    check_tables(sentences, anchors)
    names = F.create_map(*[F.lit(x) for name, words in sentences for x in (words, name)])
    low = F.translate(text, UPPER, LOWER)
    # An anchor of two words may be spread over white space or signs in the text; its first word is asked for.
    asked = F.lit(False)
    for word in dict.fromkeys(a.split()[0] for a in anchors):
        asked = asked | low.contains(word)
    marked = low
    for pattern, mark in ENDS:
        marked = F.regexp_replace(marked, pattern, mark)
    met = F.regexp_extract_all(F.concat(F.lit("H "), F.trim(marked), F.lit(" H")), F.lit(sentence_pattern(sentences)), F.lit(0))
    found = F.transform(met, lambda s: F.try_element_at(names, F.replace(s, F.lit(" S"), F.lit(""))))
    return F.when(F.coalesce(asked, F.lit(False)), found).otherwise(F.array().cast("array<string>"))


def licences(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sentences=SENTENCES + TITLES, rules=RULES, anchors=ANCHORS, hides=HIDES) -> DataFrame:
    """One row per row of ``docs``: its id, ``sentence_ids`` in order, ``licences`` that hold, in the order of the rules."""
    named = docs.select(F.col(id_column).alias("doc_id"), licence_sentences(F.col(text_column), sentences, anchors).alias("sentence_ids"))
    ids = F.col("sentence_ids")
    held = F.array_distinct(F.filter(F.array(*[F.when(holds(ids, rule), F.lit(name)) for name, rule in rules]), lambda x: x.isNotNull()))
    some = F.when(F.size(ids) > 0, held)
    found = named.withColumn("licences", F.coalesce(some, F.array().cast("array<string>")))
    for longer, shorter in hides.items():
        rest = F.array_except("licences", F.array(*[F.lit(x) for x in shorter]))
        found = found.withColumn("licences", F.when(F.array_contains("licences", longer), rest).otherwise(F.col("licences")))
    return found
