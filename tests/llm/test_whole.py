"""The whole job: whole texts, short documents, published wordings, repeated rows."""

import random

import pytest
import zstandard

from tallyspark.llm import decontaminate, license_scan, quality_classifier, suffix_dedup

from .llm_cases import prose
from .test_groups import cut_repeats

# --- op3 ---------------------------------------------------------------------


def test_statistics_read_the_whole_text():
    rng = random.Random(1)
    clean = prose(rng, 600, lines=False)
    noise = ["#tag", "NOISE", "again", "again"] * 100
    words = (clean + " " + " ".join(noise)).encode().split()
    got = dict(zip(quality_classifier.NAMES, quality_classifier.statistics(
        b" ".join(words), zstandard.ZstdCompressor(level=1))))
    n = len(words)
    assert got["top_word"] == max(words.count(w) for w in set(words)) / n
    assert got["symbol_words"] == 100 / n
    assert got["upper_words"] == 100 / n


# --- op7 ---------------------------------------------------------------------

# The published wording of each known sentence, in the order of SENTENCES.
PUBLISHED = [
    "// SPDX-License-Identifier: Apache-2.0", "# SPDX-License-Identifier: MIT",
    "/* SPDX-License-Identifier: GPL-3.0-or-later */", "// SPDX-License-Identifier: GPL-2.0-only",
    "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
    "<!-- SPDX-License-Identifier: MPL-2.0 -->",
    'Licensed under the Apache License, Version 2.0 (the "License");',
    "you may not use this file except in compliance with the License.",
    "You may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n",
    'Unless required by applicable law or agreed to in writing, software\ndistributed under the License is '
    'distributed on an "AS IS" BASIS,\nWITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "Released under the MIT License.", "Licensed under the MIT License.",
    'Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated '
    'documentation files (the "Software"), to deal\nin the Software without restriction, subject to the following '
    'conditions:',
    "The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions "
    "of the Software.",
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED.',
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that "
    "the following conditions are met:",
    "1. Redistributions of source code must retain the above copyright notice, this\n   list of conditions and the "
    "following disclaimer.",
    "2. Redistributions in binary form must reproduce\nthe above copyright notice, this list of conditions and the "
    "following disclaimer.",
    "3. Neither the name of the copyright holder nor the names of its\n   contributors may be used.",
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"\nAND ANY EXPRESS OR IMPLIED '
    'WARRANTIES ARE DISCLAIMED.',
    "This work is licensed under the GNU General Public License, version 3.",
    "This work is\nlicensed under the GNU General Public License, version 2.",
    "Licensed under the GNU General Public License, version 3.",
    "Licensed under the GNU General Public License, version 2.",
    "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General "
    "Public License as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your "
    "option) any later version.",
    " * This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU "
    "General Public License as published by\n * the Free Software Foundation; either version 2 of the License, "
    "or\n * (at your option) any later version.",
    "This program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the "
    "implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.",
    "See the\nGNU General Public License for more details.",
    "You should have received a copy of the GNU General Public License\nalong with this program.  If not, see "
    "<https://www.gnu.org/licenses/>.",
    "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0.",
    "If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Licensed under CC BY-NC 4.0.", "Licensed under CC BY-SA 4.0.", "Licensed under CC BY 4.0.",
    "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "All rights reserved.",
]


def test_every_published_sentence_is_known():
    assert len(PUBLISHED) == len(license_scan.SENTENCES)
    recogniser = license_scan.Recogniser()
    for wording, (_, name) in zip(PUBLISHED, license_scan.SENTENCES):
        for text in (wording, f"import x\n\n{wording}\n\nWe go on.", f"Copyright 2020 X.\n{wording}\ny = 1"):
            assert recogniser.identifiers(text) == [name], text


@pytest.mark.parametrize("between", ["\n", "\n\n"])
def test_every_rule_is_met_by_published_text(between):
    recogniser = license_scan.Recogniser()
    wordings = {}
    for wording, (_, name) in zip(PUBLISHED, license_scan.SENTENCES):
        wordings.setdefault(name, wording)
    for license_name, sequence in license_scan.RULES:
        found = recogniser.identifiers(between.join(wordings[n] for n in sequence))
        assert found == list(sequence) and recogniser.licenses(found) == ([license_name], [])


def test_a_sentence_begins_after_any_mark():
    recogniser = license_scan.Recogniser()
    assert recogniser.identifiers("Terms: released under the MIT License; all rights reserved") == [
        "MitNotice", "AllRightsReserved"]
    assert recogniser.identifiers("See p. v. Released under the MIT License") == ["MitNotice"]
    assert recogniser.identifiers("All rights. Reserved seats") == []


# --- op6 ---------------------------------------------------------------------


def test_documents_shorter_than_an_item(spark, docs):
    """Documents that are an item without some of its words, against brute force."""
    rng = random.Random(5)
    items = [(i, prose(rng, n)) for i, n in enumerate((3, 6, 12, 38, 60, 200))]
    items += [(6, items[3][1] + " more"), (7, " ".join(["same words again and"] * 10))]
    rows = []
    for _, text in items:
        words = text.split()
        for gone in (1, 2, 3, 7, 9, 20, 40):
            if gone < len(words):
                at = rng.randrange(len(words) - gone + 1)
                rows += [words[:-gone], words[gone:], words[:at] + words[at + gone:]]
        rows.append([*words[:len(words) // 2], "changed", *words[len(words) // 2 + 1:-1]])
    rows = [(d, " ".join(w)) for d, w in enumerate(rows)] + [(900, items[3][1].rsplit(" ", 1)[0])] * 2 + [(901, "")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.first_word, r.n_words, round(r.similarity, 9))
                 for r in decontaminate.leaks(docs(rows), benchmark).collect()
                 if r.n_words < len(decontaminate.words_of(items[r.item_id][1])))
    expected = []
    for d, text in rows:
        words = decontaminate.words_of(text)
        for i, item in items:
            own = decontaminate.words_of(item)
            value = decontaminate.similarity(decontaminate.weighted(words), decontaminate.weighted(own))
            if len(words) < len(own) and value >= 0.8:
                expected.append((d, i, 0, len(words), round(value, 9)))
    assert got == sorted(expected) and 20 < len(got) < len(rows) * len(items)
    assert [g[0] for g in got].count(900) == 4  # the rows of 900, for the items 3 and 6
    clean = {r.doc_id for r in decontaminate.without_leaks(docs(rows), benchmark).collect()}
    assert not clean & {e[0] for e in expected} and 901 in clean


# --- op2 ---------------------------------------------------------------------


@pytest.mark.parametrize("bucket_bytes", [1 << 20, 2000])
def test_repeated_rows_are_no_repeats_of_themselves(docs, bucket_bytes):
    rng = random.Random(9)
    passage = prose(rng, 40)
    once = [(1, prose(rng, 60)), (2, prose(rng, 30) + passage + prose(rng, 30)),
            (3, passage * 2 + prose(rng, 20)), (4, "ab" * 300), (5, prose(rng, 60)), (None, prose(rng, 80) + passage)]
    once += [(6, once[4][1])]  # an equal text of another id goes
    expected = cut_repeats(once, 100)
    assert expected[1][1] == [] and expected[6][0] == b"" and expected[3][1] and expected[4][1] and expected[None][1]
    rows = [r for r in once for _ in range(1 + (r[0] in (1, 3, 4, 6, None)) * 2)]
    rng.shuffle(rows)
    for df in (docs(rows), docs(rows).coalesce(1), docs(rows).repartition(7)):
        got = suffix_dedup.remove_repeats(df, 100, 24, bucket_bytes).collect()
        assert len(got) == len(rows)
        for r in got:
            assert (bytes(r.kept), [tuple(s) for s in r.spans]) == expected[r.doc_id], r.doc_id
