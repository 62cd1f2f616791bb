import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sievework.llm import licences, token_counts


def test_licences(docs):
    mit = "The MIT License\n\nCopyright 2020 X. The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    texts = [
        None, "", "plain words. Nothing here", "Text. Licensed under CC BY-NC 4.0.", "x\nReleased under the MIT License.\nAll rights\n reserved", "ALL RIGHTS RESERVED!  licensed under the apache license, version 2.0", mit,
        mit.replace("The MIT License\n", "") + "\nThe MIT License", "word " * 50_000 + ".\nAll rights reserved.", "my license is old. no warranty",
    ]
    got = {r.doc_id: r for r in licences.licences(docs(texts + texts[3:4]).withColumnRenamed("lang", "licences")).collect()}
    assert len(got) == len(texts) + 1
    held = [list(got[k].licences) for k in range(len(texts))]
    assert held == [[], [], [], ["CC-BY-NC-4.0"], ["MIT"], ["Apache-2.0", "Proprietary"], ["MIT"], [], ["Proprietary"], []]
    assert got[7].sentence_ids == ["mit.notice", "mit.title"]  # the right sentences in the wrong order
    assert licences.licences(docs([])).collect() == []


def test_every_sentence_and_rule_is_reachable(docs):
    texts = [words + "." for _, words in licences.SENTENCES]
    found = [r.sentence_ids for r in sorted(licences.licences(docs(texts)).collect(), key=lambda r: r.doc_id)]
    assert found == [[name] for name, _ in licences.SENTENCES]
    known = dict(licences.SENTENCES)
    rules = [". ".join(known[i] for i in ids) for _, ids in licences.RULES]
    held = [r.licences for r in sorted(licences.licences(docs(rules)).collect(), key=lambda r: r.doc_id)]
    assert all(name in h for (name, _), h in zip(licences.RULES, held))
    with pytest.raises(ValueError):
        licences.check_tables([("x", "free for all")], licences.ANCHORS)


WRAPPED = [
    ("GPL-3.0", """    This program is free software: you can redistribute it and/or modify
    it under the terms of the GNU General Public License as published by
    the Free Software Foundation, either version 3 of the License, or
    (at your option) any later version.

    This program is distributed in the hope that it will be useful,
    but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
    GNU General Public License for more details.
"""),
    ("BSD-2-Clause", """Copyright (c) 2020, X
Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:
1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""),
    ("MIT", """MIT License

Copyright (c) 2020 X

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
"""),
    ("Apache-2.0", """   Copyright 2020 X
   Licensed under the Apache License, Version 2.0 (the "License");
   you may not use this file except in compliance with the License.
   You may obtain a copy of the License at

       http://www.apache.org/licenses/LICENSE-2.0

   Unless required by applicable law or agreed to in writing, software
   distributed under the License is distributed on an "AS IS" BASIS,
   WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""),
]


def test_wrapped_licences(docs):
    texts = [t for _, t in WRAPPED]
    texts += ["/*\n" + "".join(f" * {line}\n" for line in t.split("\n")) + " */" for t in texts] + [t.replace("\n", "\r\n") for t in texts]
    got = sorted(licences.licences(docs(texts)).collect(), key=lambda r: r.doc_id)
    assert [r.licences for r in got] == [[name] for name, _ in WRAPPED] * 3
    assert got[3].sentence_ids == ["apache.header", "apache.terms", "apache.copy", "apache.basis"]
    apart = ["This source code form is subject to the terms of the Mozilla Public\n\nLicense, v. 2.0.", "See v. \nAll rights reserved", "\n" * 20_000 + "licensed under the mit\nlicense"]
    got = sorted(licences.licences(docs(apart)).collect(), key=lambda r: r.doc_id)
    assert [r.licences for r in got] == [[], ["Proprietary"], ["MIT"]]


def test_very_many_sentences(docs):
    head = "Licensed under the Apache License, Version 2.0 (the License). You may not use this file except in compliance with the License.\n"
    texts = [head + "All rights reserved.\n" * 100_000 + "You may obtain a copy of the License at\n", "All rights reserved.\n" * 3_000]
    got = sorted(licences.licences(docs(texts)).select("doc_id", "licences", F.size("sentence_ids").alias("n")).collect(), key=lambda r: r.doc_id)
    assert [(r.licences, r.n) for r in got] == [(["Apache-2.0", "Proprietary"], 100_003), (["Proprietary"], 3_000)]


def test_longer_licences_hide_shorter_ones(docs):
    two = next(t for name, t in WRAPPED if name == "BSD-2-Clause")
    three = two + """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
    gpl2 = next(t for name, t in WRAPPED if name == "GPL-3.0").replace("either version 3", "either version 2")
    lines = ["# SPDX-License-Identifier: GPL-2.0-or-later\nimport os", "// SPDX-License-Identifier: MIT", "/* SPDX-License-Identifier: BSD-3-Clause */"]
    got = sorted(licences.licences(docs([two, three, gpl2, *lines])).collect(), key=lambda r: r.doc_id)
    assert [r.licences for r in got] == [["BSD-2-Clause"], ["BSD-3-Clause"], ["GPL-2.0-or-later"], ["GPL-2.0-or-later"], ["MIT"], ["BSD-3-Clause"]]


@pytest.fixture(scope="module")
def ranks():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def brute(text, sections, encoding, rule):
    """Byte by byte."""
    counts, at = [0] * len(sections), 0
    owner = {}
    for k, (a, b) in enumerate(sections):
        for byte in range(len(text[:a].encode()), len(text[:b].encode())):
            owner[byte] = k
    for token in encoding.encode_ordinary(text):
        n = len(encoding.decode_single_token_bytes(token))
        of = [owner.get(x) for x in range(at, at + n)]
        at += n
        if rule == "most":
            held = [(of.count(k), -k) for k in set(of) if k is not None]
            k = -max(held)[1] if held else None
        else:
            k = of[0] if rule == "first" else of[-1]
        if k is not None:
            counts[k] += 1
    return counts


def test_counts_equal_brute_force(spark, ranks):
    encoding, _ = token_counts.encoder(*ranks)
    rng = random.Random(4)
    rows = []
    for k in range(120):
        text = "".join(rng.choice(["hello ", "wörld", " 12345", "\n", "日本語", "🎉", "    ", "internationalization ", "<|endoftext|>"]) for _ in range(rng.randint(0, 14)))
        cuts = sorted(rng.randint(0, len(text)) for _ in range(2 * rng.randint(0, 4)))
        rows.append((k, text, [{"start": a, "end": b} for a, b in zip(cuts[::2], cuts[1::2])]))
    rows += [(500, None, None), (501, "", []), (502, "text", None)]
    frame = spark.createDataFrame(rows, "id long, text string, sections array<struct<start:int,end:int>>")
    for rule in token_counts.RULES:
        got = frame.select("id", token_counts.token_counts(F.col("text"), F.col("sections"), *ranks, rule).alias("n")).collect()
        by_id = {r.id: r.n for r in got}
        for k, text, sections in rows:
            spans = [(s["start"], s["end"]) for s in sections or []]
            assert by_id[k] == brute(text or "", spans, encoding, rule), (text, spans, rule)


def test_lines_hold_all_tokens(docs, ranks):
    encoding, _ = token_counts.encoder(*ranks)
    texts = ["a\nb c\n\nd", "", None, "x " * 40_000 + "\nend", "\n"]
    frame = docs(texts).withColumn("sections", token_counts.lines(F.col("text")))
    rows = frame.withColumn("n", token_counts.token_counts(F.col("text"), F.col("sections"), *ranks)).collect()
    for r in rows:
        text = r.text or ""
        assert sum(r.n) == len(encoding.encode_ordinary(text))
        assert [(s.start, s.end) for s in r.sections] == token_counts.line_sections(text)
        assert "".join(text[s.start : s.end] for s in r.sections) == text
    assert frame.filter("false").withColumn("n", token_counts.token_counts(F.col("text"), F.col("sections"), *ranks)).collect() == []
    with pytest.raises(ValueError):
        token_counts.token_counts(F.col("text"), F.col("sections"), *ranks, "half")


def test_attribution_of_overlong_tokens():
    ends = np.array([10])
    assert token_counts.attributed(ends, np.array([0, 2, 6]), np.array([2, 6, 10]), "most").tolist() == [0, 1, 0]
    assert token_counts.attributed(ends, np.array([2, 6]), np.array([6, 8]), "first").tolist() == [0, 0]
