"""Operators that judge rows one by one, against plain re-statements."""

import math
import random
import re
from collections import Counter
from itertools import product

import pytest
import zstandard
from .llm_cases import ODD, prose

from tallyspark.llm import decontaminate, license_scan, quality_rules, token_counts
from tallyspark.llm.edit_distance import edits

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def base_counts(text):
    raw = (text or "").encode()
    words = WORD.findall(raw)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    often = {w for w, n in Counter(windows).items() if n > 1}
    covered = {i + j for i, w in enumerate(windows) if w in often for j in range(3)}
    lines = [line for line in raw.split(b"\n") if WORD.search(line)]
    return (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text or ""),
            len(lines) - len(set(lines)), len(covered))


def test_quality_counts_match_restatement(docs):
    rng = random.Random(1)
    texts = [prose(rng, rng.randrange(1, 300)) for _ in range(30)]
    texts += ["x y z " * 30 + prose(rng, 60), "a|b\n#c\n\nd\n#c\n d", None, "", "\x0b\x0c", "é " * 70]
    rows = quality_rules.quality_rules(docs(list(enumerate(texts)))).collect()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_bands_reject_repetition_and_noise(docs):
    rng = random.Random(2)
    clean = prose(rng, 900)
    noise = " ".join("".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", k=40))
                     for _ in range(150))
    line = prose(rng, 60)
    loop = "\n".join(f"{i} {line}" for i in range(200))
    half = prose(rng, 2000) + " " + noise * 2
    rows = {r.doc_id: r for r in quality_rules.quality_rules(docs(list(enumerate([clean, noise, loop, half])))).collect()}
    assert rows[0].kept and rows[0].reason is None
    assert not rows[1].kept and rows[1].reason == "incompressible"
    assert not rows[2].kept
    assert not rows[3].kept and rows[3].n_bad_chunks > 0


def test_bands_cover_every_length():
    assert quality_rules.band(0) == quality_rules.BANDS[0][1:]
    assert quality_rules.band(10**9) == quality_rules.BANDS[-1][1:]
    starts = [b[0] for b in quality_rules.BANDS]
    assert starts == sorted(starts)


def test_keep_good_keeps_columns_and_agrees(docs):
    rng = random.Random(3)
    rows = [(i, prose(rng, n)) for i, n in enumerate((10, 60, 200, 800))] + list(ODD)
    df = docs(rows)
    kept = quality_rules.keep_good(df)
    assert kept.schema == df.schema
    verdicts = quality_rules.quality_rules(df).where("kept").select("doc_id").collect()
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(map(str, (r.doc_id for r in verdicts)))


def test_compression_ratio_is_whole_text(docs):
    text = prose(random.Random(4), 3000)
    row = quality_rules.quality_rules(docs([(1, text)])).first()
    size = len(text.encode())
    assert row.ratio == len(zstandard.ZstdCompressor(level=3).compress(text.encode())) / size
    assert row.n_chunks == -(-size // quality_rules.CHUNK_BYTES)


def distance(a, b):
    before = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (x != y)))
        before = row
    return before[-1]


def test_edit_distance_against_matrix():
    rng = random.Random(5)
    for _ in range(4000):
        a = bytes(rng.choices(b"abc", k=rng.randrange(12)))
        b = bytearray(a)
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(b) + 1)
            b[at:at + rng.randrange(2)] = bytes(rng.choices(b"abc", k=rng.randrange(2)))
        for most in (1, 2, 4):
            assert edits(a, bytes(b), most) == min(distance(a, bytes(b)), most + 1)


def segmentations(word, pieces):
    if not word:
        yield []
    for n in range(1, len(word) + 1):
        if word[:n] in pieces:
            for rest in segmentations(word[n:], pieces):
                yield [word[:n], *rest]


def test_trie_against_all_segmentations():
    alphabet = "ab" + token_counts.MARK
    pieces = [*alphabet, "ab", "aba", token_counts.MARK + "a", "bb", token_counts.MARK + "ab", "abab"]
    vocabulary = token_counts.Vocabulary(pieces)
    trie = token_counts.Trie(vocabulary)
    words = ["".join(w) for n in range(1, 7) for w in product("ab", repeat=n)]
    for word, node in zip(words, trie.nodes(words)):
        best = max(segmentations(token_counts.MARK + word, set(pieces)),
                   key=lambda s: (math.fsum(vocabulary.log_p[p] for p in s), -len(s)))
        assert trie.score[node] == pytest.approx(math.fsum(vocabulary.log_p[p] for p in best))
    # every prefix has one node: the trie is shared
    assert len(trie.score) == 1 + 1 + len(words)


def test_token_counts_of_odd_rows(docs):
    import public_tokenizers

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = token_counts.token_counts(docs(ODD), path).collect()
    assert len(rows) == len(ODD)
    trie = token_counts.Trie(token_counts.Vocabulary.read(path))
    for (doc_id, text, _), r in zip(ODD, rows):
        words = (text or "").split()
        assert (r.doc_id, r.n_words) == (doc_id, len(words))
        assert r.n_tokens == sum(trie.tokens[trie.insert(token_counts.MARK + w)] for w in words)
    # characters without a piece count their bytes
    alone = token_counts.Trie(token_counts.Vocabulary([token_counts.MARK]))
    assert alone.tokens[alone.insert(token_counts.MARK + "é")] == 3


LICENSES = [
    ("Licensed under CC BY-NC 4.0.", ["CC-BY-NC-4.0"]),
    ("This work is licensed under the GNU General Public License, version 3.", ["GPL-3.0"]),
    ("x.\nLicensed under the Apache License, Version 2.0.\ny", ["Apache-2.0"]),
    ("Released under the MIT License.", ["MIT"]),
    ("Text without end mark\nReleased under the MIT License\nmore", ["MIT"]),
    ("All rights reserved.\nReleased under the MIT License.", ["Proprietary", "MIT"]),
    ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted. "
     "Redistributions of source code must retain the above copyright\nnotice. Redistributions in binary form must "
     "reproduce the above copyright notice. Neither the name of X nor Y.", ["BSD-3-Clause"]),
    ("Redistribution and use in source and binary forms, with or without modification: "
     "Redistributions of source code must retain the above copyright notice; Redistributions in binary form must "
     "reproduce the above copyright notice.", ["BSD-2-Clause"]),
    ("The licence of the mit is released under the sun.", []),
    ("We released under the MIT License nothing", []), (None, []), ("", []),
]


def test_licenses(docs):
    rows = license_scan.license_scan(docs([(i, t) for i, (t, _) in enumerate(LICENSES)])).collect()
    assert [r.licenses for r in sorted(rows, key=lambda r: r.doc_id)] == [x for _, x in LICENSES]


def test_license_rules_are_ordered():
    names = {n for _, n in license_scan.SENTENCES}
    for i, (_, sequence) in enumerate(license_scan.RULES):
        assert set(sequence) <= names
        for _, earlier in license_scan.RULES[:i]:
            assert len(earlier) >= len(sequence) or earlier != sequence[:len(earlier)]


def test_unmatched_sentences_are_reported():
    r = license_scan.Recogniser()
    found = r.identifiers("Neither the name of A nor B. Released under the MIT License.")
    assert found == ["BsdName", "MitNotice"] and r.licenses(found) == (["MIT"], ["BsdName"])


def all_windows(words, item):
    """Best-first, non-overlapping windows of an item, by trying every one."""
    own = decontaminate.weighted(item)
    found = []
    for s in range(len(words) - len(item) + 1):
        value = decontaminate.similarity(decontaminate.weighted(words[s:s + len(item)]), own)
        if value >= 0.8:
            found.append((s, value))
    kept = []
    for s, value in sorted(found, key=lambda w: (-w[1], w[0])):
        if all(abs(s - t) >= len(item) for t, _ in kept):
            kept.append((s, value))
    return kept


def test_leaks_against_every_window(spark, docs):
    rng = random.Random(7)
    items = [(i, prose(rng, n)) for i, n in enumerate((3, 12, 20, 33, 60, 60))] + [(6, None), (7, "")]
    rows = []
    for d in range(60):
        words = prose(rng, 150).split()
        for i in rng.sample(range(6), rng.randrange(3)):
            passage = items[i][1].split()
            if rng.random() < 0.5 and len(passage) > 5:
                passage[rng.choice((0, -1, len(passage) // 2))] = "changed"
            at = rng.randrange(len(words))
            words[at:at] = passage
        rows.append((d, " ".join(words).upper() if d % 7 == 0 else " ".join(words)))
    rows += [(100, None), (101, ""), (102, items[3][1]), (102, items[3][1])]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((r.doc_id, r.item_id, r.first_word, round(r.similarity, 9))
                 for r in decontaminate.leaks(docs(rows), benchmark).collect())
    expected = sorted((d, i, s, round(v, 9)) for d, t in rows for i, x in items if decontaminate.words_of(x)
                      for s, v in all_windows(decontaminate.words_of(t), decontaminate.words_of(x)))
    assert got == expected and len(got) > 20
    clean = decontaminate.without_leaks(docs(rows), benchmark)
    assert {r.doc_id for r in clean.collect()} == {d for d, _ in rows} - {e[0] for e in expected}
    assert decontaminate.leaks(docs(rows), benchmark.limit(0)).count() == 0
    blocks = list(decontaminate.item_blocks(benchmark, block_bytes=200))
    assert len(blocks) > 1 and sorted(i for b in blocks for i in b.ids) == list(range(6))


def test_index_finds_all_within_radius():
    rng = random.Random(8)
    items = decontaminate.Items(list(range(300)), [[w.encode() for w in prose(rng, 20).split()] for _ in range(300)])
    for _ in range(300):
        print_ = int(items.prints[rng.randrange(300)])
        for bit in rng.sample(range(64), rng.randrange(decontaminate.RADIUS + 1)):
            print_ ^= 1 << bit
        near = {i for i, p in enumerate(items.prints.tolist()) if (p ^ print_).bit_count() <= decontaminate.RADIUS}
        assert items.within(print_, 20) == near
