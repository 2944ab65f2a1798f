"""Licence recognition by sentence rules (operator 7).

A text is split into sentences and each is normalised: lower case, words only.
A normalised sentence that begins like a known licence sentence gets its
identifier; colons, semicolons and the full stop of "v." may stand inside it, as in
the published texts. The sequence of a document's identifiers is then matched against
ordered rules, each a licence and the identifiers that make it up in a row; the
first rule that fits names a licence, and its identifiers are used up.
Identifiers that no rule uses are reported as unmatched.

One map step; no shuffle.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyspark.llm.common import id_and_text

# The beginnings of licence sentences as they are published, in
# normalised form, and our identifiers for them.
SENTENCES = (
    ("spdx license identifier apache 2 0", "SpdxApache2"),
    ("spdx license identifier mit", "SpdxMit"),
    ("spdx license identifier gpl 3 0", "SpdxGpl3"),
    ("spdx license identifier gpl 2 0", "SpdxGpl2"),
    ("spdx license identifier bsd 3 clause", "SpdxBsd3"),
    ("spdx license identifier bsd 2 clause", "SpdxBsd2"),
    ("spdx license identifier mpl 2 0", "SpdxMpl2"),
    ("licensed under the apache license version 2 0", "Apache2Notice"),
    ("you may not use this file except in compliance with the license", "ApacheCompliance"),
    ("you may obtain a copy of the license at", "ApacheCopy"),
    ("unless required by applicable law or agreed to in writing software", "ApacheAsIs"),
    ("released under the mit license", "MitNotice"),
    ("licensed under the mit license", "MitNotice"),
    ("permission is hereby granted free of charge to any person obtaining a copy", "MitGrant"),
    ("the above copyright notice and this permission notice shall be included", "MitInclude"),
    ("the software is provided as is without warranty of any kind", "MitAsIs"),
    ("redistribution and use in source and binary forms with or without modification", "BsdGrant"),
    ("redistributions of source code must retain the above copyright notice", "BsdSource"),
    ("redistributions in binary form must reproduce the above copyright notice", "BsdBinary"),
    ("neither the name of", "BsdName"),
    ("this software is provided by the copyright holders and contributors as is", "BsdAsIs"),
    ("this work is licensed under the gnu general public license version 3", "Gpl3Notice"),
    ("this work is licensed under the gnu general public license version 2", "Gpl2Notice"),
    ("licensed under the gnu general public license version 3", "Gpl3Notice"),
    ("licensed under the gnu general public license version 2", "Gpl2Notice"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu "
     "general public license as published by the free software foundation either version 3", "Gpl3Grant"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu "
     "general public license as published by the free software foundation either version 2", "Gpl2Grant"),
    ("this program is distributed in the hope that it will be useful", "GplHope"),
    ("see the gnu general public license for more details", "GplSee"),
    ("you should have received a copy of the gnu general public license", "GplReceived"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "Mpl2Notice"),
    ("if a copy of the mpl was not distributed with this file", "Mpl2Copy"),
    ("licensed under cc by nc 4 0", "CcByNc4Notice"),
    ("licensed under cc by sa 4 0", "CcBySa4Notice"),
    ("licensed under cc by 4 0", "CcBy4Notice"),
    ("this work is licensed under a creative commons attribution 4 0", "CcBy4Notice"),
    ("this work is licensed under a creative commons attribution noncommercial 4 0", "CcByNc4Notice"),
    ("this work is licensed under a creative commons attribution sharealike 4 0", "CcBySa4Notice"),
    ("all rights reserved", "AllRightsReserved"),
)

# Ordered: a rule comes before those whose sequences it contains.
RULES = (
    ("Apache-2.0", ("Apache2Notice", "ApacheCompliance", "ApacheCopy", "ApacheAsIs")),
    ("Apache-2.0", ("Apache2Notice", "ApacheCompliance", "ApacheCopy")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdName", "BsdAsIs")),
    ("BSD-3-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdName")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary", "BsdAsIs")),
    ("BSD-2-Clause", ("BsdGrant", "BsdSource", "BsdBinary")),
    ("MIT", ("MitGrant", "MitInclude", "MitAsIs")),
    ("MIT", ("MitGrant", "MitInclude")),
    ("GPL-3.0-or-later", ("Gpl3Grant", "GplHope", "GplSee", "GplReceived")),
    ("GPL-3.0-or-later", ("Gpl3Grant", "GplHope", "GplSee")),
    ("GPL-3.0-or-later", ("Gpl3Grant",)),
    ("GPL-2.0-or-later", ("Gpl2Grant", "GplHope", "GplSee", "GplReceived")),
    ("GPL-2.0-or-later", ("Gpl2Grant", "GplHope", "GplSee")),
    ("GPL-2.0-or-later", ("Gpl2Grant",)),
    ("MPL-2.0", ("Mpl2Notice", "Mpl2Copy")),
    ("MPL-2.0", ("Mpl2Notice",)),
    ("Apache-2.0", ("Apache2Notice",)),
    ("MIT", ("MitNotice",)),
    ("GPL-3.0", ("Gpl3Notice",)),
    ("GPL-2.0", ("Gpl2Notice",)),
    ("CC-BY-NC-4.0", ("CcByNc4Notice",)),
    ("CC-BY-SA-4.0", ("CcBySa4Notice",)),
    ("CC-BY-4.0", ("CcBy4Notice",)),
    ("Apache-2.0", ("SpdxApache2",)),
    ("MIT", ("SpdxMit",)),
    ("GPL-3.0", ("SpdxGpl3",)),
    ("GPL-2.0", ("SpdxGpl2",)),
    ("BSD-3-Clause", ("SpdxBsd3",)),
    ("BSD-2-Clause", ("SpdxBsd2",)),
    ("MPL-2.0", ("SpdxMpl2",)),
    ("Proprietary", ("AllRightsReserved",)),
)

# A sentence ends at a blank line, or at a mark before white space; "2.0" does
# not end one. Known sentences hold colons, semicolons and "v.": a known sentence
# may begin after them and after a line end, and may run on over them.
_ENDS = re.compile(r"[.!?](?<!\bv\.)(?=\s|$)|\n\s*\n")
_BREAKS = re.compile(r"[.;:](?=\s)|\n")
_WORDS = re.compile(r"[^\W_]+")
_LEAD = 2  # words by which known sentences are looked up


class Recogniser:
    """Known sentences and rules, indexed by their first words."""

    def __init__(self, sentences=SENTENCES, rules=RULES):
        self.known: dict[str, list[tuple[str, str]]] = {}
        # longer beginnings first, so that the most specific one counts
        for text, name in sorted(sentences, key=lambda s: -len(s[0])):
            self.known.setdefault(" ".join(text.split()[:_LEAD]), []).append((text, name))
        # a text without any of the known leads has no known sentence
        self.leads = re.compile("|".join(r"[\W_]+".join(map(re.escape, lead.split())) for lead in self.known))
        self.longest = max(len(text.split()) for text, _ in sentences)
        self.rules = rules

    def identifiers(self, text: str | None) -> list[str]:
        """Identifiers of the known sentences, in their order."""
        text = (text or "").lower()
        if not self.leads.search(text):
            return []
        return [name for sentence in _ENDS.split(text) if self.leads.search(sentence)
                for name in self._known_in(sentence)]

    def _known_in(self, sentence: str) -> Iterator[str]:
        """Those that begin where the sentence, a line or a part of it does; of
        overlapping ones the first."""
        found = list(_WORDS.finditer(sentence))
        words, places = [m[0] for m in found], [m.start() for m in found]
        end = 0
        for start in sorted({0, *(bisect_left(places, m.end()) for m in _BREAKS.finditer(sentence))}):
            if start >= end and (known := self._known(words[start:start + self.longest])) is not None:
                text, name = known
                end = start + len(text.split())
                yield name

    def _known(self, words: list[str]) -> tuple[str, str] | None:
        plain = " ".join(words) + " "
        return next((k for k in self.known.get(" ".join(words[:_LEAD]), ()) if plain.startswith(k[0] + " ")), None)

    def licenses(self, found: list[str]) -> tuple[list[str], list[str]]:
        """(licences in the order of their sentences, unmatched identifiers)."""
        left: list[str | None] = list(found)
        named: list[tuple[int, str]] = []
        for license_name, sequence in self.rules:
            n, at = len(sequence), 0
            while at + n <= len(left):
                if tuple(left[at:at + n]) == sequence:
                    named.append((at, license_name))
                    left[at:at + n] = [None] * n
                    at += n
                else:
                    at += 1
        names = list(dict.fromkeys(name for _, name in sorted(named)))
        return names, [name for name in left if name is not None]


def _scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    recogniser = Recogniser()
    strings = pa.list_(pa.string())
    for batch in batches:
        found = [recogniser.identifiers(t) for t in batch.column("text").to_pylist()]
        results = [recogniser.licenses(f) for f in found]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array([r[0] for r in results], strings), pa.array(found, strings),
             pa.array([r[1] for r in results], strings)], names=["doc_id", "licenses", "sentences", "unmatched"])


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, licenses, sentences (identifiers)
    and unmatched, arrays in the order of the text; each licence is named once.

    A null, empty or licence-free text has empty arrays. Repeated rows and null
    ids are scanned row by row. Other columns of ``docs`` are not read. An
    empty table gives no rows.
    """
    rows = id_and_text(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        _scan, f"doc_id {id_type}, licenses array<string>, sentences array<string>, unmatched array<string>")
