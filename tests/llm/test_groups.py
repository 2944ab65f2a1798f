"""Operators that compare or place documents together, against brute force."""

import random
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from .llm_cases import ODD, prose
from .test_rows import all_windows, distance

from tallyspark.llm import best_fit, common, decontaminate, jaccard_join, line_dedup, suffix_dedup
from tallyspark.llm.common import Scratch
from tallyspark.llm.components import components
from tallyspark.llm.sharding import interleave

VOCABULARY = public_tokenizers.path("word_bpe_49k.json")


def edited(rng, text, n=1):
    words = text.split(" ")
    for _ in range(n):
        words[rng.randrange(len(words))] = prose(rng, 1)
    return " ".join(words)


@pytest.fixture(scope="module")
def corpus():
    """Copies, near copies, shared passages and odd rows."""
    rng = random.Random(11)
    base = [prose(rng, rng.randrange(5, 260)) for _ in range(40)]
    passage = prose(rng, 60, lines=False)
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(base)]
    for i in range(40, 140):
        text = rng.choice(base)
        kind = rng.randrange(4)
        if kind == 1:
            text = edited(rng, text, rng.randrange(1, 4))
        elif kind == 2:
            text = prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 40)
        elif kind == 3:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice("xyz") + text[at + rng.randrange(2):]
        rows.append((i, text, f"s{i % 5 if i % 2 else 0}"))
    return rows + [(200 + (i or 0) if i is not None else None, t, s) for i, t, s in ODD]


def all_windows_of(text, item):
    return all_windows(decontaminate.words_of(text), decontaminate.words_of(item))


# --- op1 ---------------------------------------------------------------------


def test_shards_are_even_and_follow_the_mixture(docs, corpus):
    rows = interleave(docs(corpus), 7).collect()
    assert Counter(r.doc_id for r in rows) == Counter(d for d, _, _ in corpus)
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1 and sorted(sizes) == list(range(7))
    for shard, n in sizes.items():
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(n))
    by_source = Counter(s for _, _, s in corpus)
    for shard, n in sizes.items():
        own = Counter(r.source for r in rows if r.shard == shard)
        for source, total in by_source.items():
            assert abs(own[source] - total * n / len(corpus)) <= 2
    texts = {d: t for d, t, _ in corpus}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 1 and r.text_crc32 == zlib.crc32(raw)


def test_shards_are_repeatable_and_seeded(docs, corpus):
    def places(seed):
        return sorted((str(r.doc_id), r.shard, r.slot) for r in interleave(docs(corpus[:140]), 4, seed).collect())

    assert places(1) == places(1) != places(2)


def test_more_shards_than_rows(docs):
    rows = interleave(docs([(1, "a"), (2, "b")]), 5).collect()
    assert sorted((r.shard, r.slot) for r in rows) == [(0, 0), (1, 0)]
    assert interleave(docs([]), 3).count() == 0


# --- op2 ---------------------------------------------------------------------


def cut_repeats(rows, length):
    """(kept bytes, spans) of each (id, text), in the order of ids."""
    seen, out = set(), {}
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0])):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            window = raw[i:i + length]
            if window in seen:
                gone[i:i + length] = b"\1" * length
            seen.add(window)
        spans = [(m.start(), m.end()) for m in re.finditer(rb"\x01+", bytes(gone))]
        out[doc_id] = (bytes(b for b, g in zip(raw, gone) if not g), spans)
    return out


@pytest.mark.parametrize("length,bucket_bytes", [(100, 1 << 20), (40, 2000)])
def test_repeats_are_removed_exactly(docs, corpus, length, bucket_bytes):
    rows = [(d, t) for d, t, _ in corpus if d != 204]
    got = {r.doc_id: (bytes(r.kept), [tuple(s) for s in r.spans]) for r in suffix_dedup.remove_repeats(
        docs(rows), length, 24, bucket_bytes).collect()}
    assert got == cut_repeats(rows, length)
    assert sum(len(s) for _, s in got.values()) > 30


def run_in_process(rows, splitters, hot, buckets, length, anchor):
    """The two map functions of the operator, without Spark."""
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string()),
         pa.array([0] * len(rows), pa.int64())], names=["doc_id", "text", "text_hash"])
    frames = [b.to_pandas() for b in suffix_dedup._send(splitters, hot, buckets, length, anchor)(iter([batch]))]
    by_bucket = defaultdict(list)
    for frame in frames:
        for bucket, part in frame.groupby("bucket"):
            by_bucket[bucket].append(part)
    import pandas as pd

    ranges = []
    for parts in by_bucket.values():
        out = suffix_dedup._sort_bucket(length, anchor)(pd.concat(parts))
        ranges += [tuple(map(int, r)) for r in out.itertuples(index=False)]
    return suffix_dedup.merge_ranges(ranges)


@pytest.mark.parametrize("slice_bytes,hot", [(4 << 20, False), (700, False), (700, True)])
def test_slices_long_texts_and_hot_strings(monkeypatch, slice_bytes, hot):
    """Stretches of long texts, flushes, and strings dealt window by window
    give the same ranges."""
    rng = random.Random(3)
    passage = prose(rng, 25)
    rows = [(i, prose(rng, 15) + passage + prose(rng, rng.choice((5, 400)))) for i in range(40)]
    rows += [(50, "a" * 3000), (51, rows[3][1] * 2), (52, "short")]
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", slice_bytes)
    monkeypatch.setattr(suffix_dedup, "FLUSH_BYTES", 5000)
    splitters = np.array([b"h", b"n"], "S16")
    leading = {passage.encode()[i:i + 16] for i in range(len(passage) - 16)} if hot else set()
    got = run_in_process(rows, splitters, leading, 3, 60, 16)
    expected = [(d, 0, a, b) for d, (_, spans) in sorted(cut_repeats(rows, 60).items()) for a, b in spans]
    assert got == expected and len(got) > 20


def test_multikey_quicksort():
    rng = np.random.default_rng(1)
    for n in (0, 1, 5, 3000, 20000):
        keys = rng.integers(0, 3, (n, 6)).astype(np.uint64)
        order = suffix_dedup.multikey_quicksort(keys, leaf=64)
        assert sorted(order.tolist()) == list(range(n))
        assert keys[order].tolist() == sorted(keys.tolist())


def test_equal_windows_have_equal_anchors():
    rng = random.Random(4)
    text = prose(rng, 200).encode()
    data = np.frombuffer(text + b"#" + text, np.uint8)
    at = suffix_dedup.anchors(data)
    n = len(text) - suffix_dedup.LENGTH + 1
    assert (at[:n] - np.arange(n) == at[len(text) + 1:len(text) + 1 + n] - np.arange(len(text) + 1, len(text) + 1 + n)).all()


# --- op4 ---------------------------------------------------------------------


def cut_lines(rows, most, least):
    first = {}
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    for d, text in ordered:
        for i, line in enumerate((text or "").encode().split(b"\n")):
            if len(line.strip()) >= least:
                first.setdefault(line.strip(), (d is None, d or 0, i))
    near = set()
    lines = list(first)
    for i, a in enumerate(lines):
        for b in lines[:i]:
            if abs(len(a) - len(b)) <= most and distance(a, b) <= most:
                near.add(max(a, b, key=first.get))
    out = {}
    for d, text in ordered:
        kept, exact, close = [], 0, 0
        for i, line in enumerate((text or "").encode().split(b"\n")):
            bare = line.strip()
            if len(bare) >= least and first[bare] != (d is None, d or 0, i):
                exact += 1
            elif len(bare) >= least and bare in near:
                close += 1
            else:
                kept.append(line)
        out[d] = (None if text is None else b"\n".join(kept).decode(), exact, close)
    return out


def line_rows():
    rng = random.Random(21)
    known = [prose(rng, rng.randrange(4, 9), lines=False) for _ in range(25)]
    rows = []
    for d in range(40):
        lines = []
        for _ in range(rng.randrange(1, 8)):
            line = rng.choice(known) if rng.random() < 0.5 else prose(rng, rng.randrange(1, 9), lines=False)
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(line))
                line = line[:at] + rng.choice(("", "q", "qq")) + line[at + rng.randrange(2):]
            lines.append(line + rng.choice(("", " ", "\t")))
        rows.append((d, "\n".join(lines)))
    return rows + [(100 + (i or 0) if i is not None else None, t) for i, t, _ in ODD if i != 4]


@pytest.mark.parametrize("most", [1, 3])
def test_lines_against_all_pairs(docs, most):
    rows = line_rows()
    got = {r.doc_id: (r.text, r.n_exact, r.n_near) for r in line_dedup.line_dedup(docs(rows), most).collect()}
    expected = cut_lines(rows, most, line_dedup.MIN_BYTES)
    assert got == expected and sum(v[2] for v in got.values()) > 3


def test_probes_meet_every_near_line():
    rng = random.Random(22)
    for most in (1, 2, 3):
        for _ in range(1500):
            a = bytes(rng.choices(b"ab", k=rng.randrange(4, 16)))
            b = bytearray(a)
            for _ in range(rng.randrange(most + 1)):
                at = rng.randrange(len(b) + 1)
                b[at:at + rng.randrange(2)] = bytes(rng.choices(b"ab", k=rng.randrange(2)))
            a, b = sorted((a, bytes(b)), key=len)
            assert distance(a, b) <= most
            if len(b) >= most + 1:
                assert set(line_dedup.index_keys(a, most)) & set(line_dedup.probe_keys(b, most))


@pytest.mark.parametrize("most", [1, 2, 3])
def test_key_columns_are_those_of_the_plain_form(spark, most):
    rng = random.Random(23)
    lines = [bytes(rng.choices(b"abc", k=n)) for n in range(1, 26)]
    rows = spark.createDataFrame([(i, bytearray(line)) for i, line in enumerate(lines)], "id int, content binary")
    by_key = defaultdict(set)
    for columns, plain in ((line_dedup.index_columns, line_dedup.index_keys),
                           (line_dedup.probe_columns, line_dedup.probe_keys)):
        hashed = rows.select("id", F.array(*columns("content", most)).alias("hashed")).collect()
        for r in hashed:
            keys = [k for k in r["hashed"] if k is not None]
            expected = plain(lines[r.id], most)
            assert len(keys) == len(expected)
            for key, content in zip(keys, expected):
                by_key[key].add(content)
    assert all(len(v) == 1 for v in by_key.values())
    assert len(by_key) == len(set().union(*by_key.values()))


def near_copies(n):
    """Lines in which up to two bytes of the first are replaced, so that few are
    within two edits of each other."""
    rng = random.Random(24)
    base = prose(rng, 6, lines=False)
    rows = [(0, base)]
    for d in range(1, n):
        line = base
        for _ in range(2):
            at = rng.randrange(len(line))
            line = line[:at] + rng.choice("0123456789") + line[at + 1:]
        rows.append((d, line))
    return rows


def test_near_copies_make_pairs_in_proportion(spark, docs, monkeypatch):
    made = []
    later = line_dedup._later

    def counted(scratch, pairs, *more):
        made.append(pairs.distinct().count())
        return later(scratch, pairs, *more)

    monkeypatch.setattr(line_dedup, "_later", counted)
    rows = near_copies(120)
    got = {r.doc_id: (r.text, r.n_exact, r.n_near) for r in line_dedup.line_dedup(docs(rows), 2).collect()}
    assert got == cut_lines(rows, 2, line_dedup.MIN_BYTES)
    assert [d for d, (text, _, _) in got.items() if text] == [0]
    assert sum(made) < 10 * len(rows)


def test_cells_meet_every_near_line_at_every_size():
    rng = random.Random(25)
    for most, pairs, last in ((1, 200, 32), (2, 60, 24), (3, 30, 8)):
        for _ in range(pairs):
            a = bytes(rng.choices(b"ab", k=rng.choice((rng.randrange(4, 30), rng.randrange(60, 70), 127))))
            b = bytearray(a)
            for _ in range(rng.randrange(most + 1)):
                at = rng.choice((0, len(b) // 2, len(b), rng.randrange(len(b) + 1)))
                b[at:at + rng.randrange(2)] = bytes(rng.choices(b"ab", k=rng.randrange(2)))
            a, b = sorted((a, bytes(b)), key=len)
            n, places = most + 1, [line_dedup.first_places(len(x), most) for x in (a, b)]
            while True:
                own, other = (line_dedup.cell_keys(x, p) for x, p in zip((a, b), places))
                met = {cell for key, (cell, mine) in own.items() if mine and key in other}
                if len(a) == len(b):
                    met |= {cell for key, (cell, mine) in other.items() if mine and key in own}
                assert met, (a, b, most, n)
                if n >= last:
                    break
                places = [line_dedup.finer_places(len(x), met, n, most) for x in (a, b)]
                n *= 2


def like_lines(n):
    """Lines like a common one that lacks among them, with edits at two places,
    of several bytes in some: few are within two edits of an earlier one, and
    those mostly not of the earliest one that shares a part."""
    rng = random.Random(26)
    base = prose(rng, 12, lines=False)
    rows = []
    for d in range(n):
        line = base if d % 3 or not rows else rng.choice(rows)[1]
        for _ in range(2):
            at = rng.randrange(len(line))
            line = line[:at] + "".join(rng.choices("0123456789", k=rng.randrange(4))) + line[at + rng.randrange(3):]
        rows.append((d, line))
    return rows


@pytest.mark.parametrize("crowd", [2, 256])
def test_groups_of_like_lines_make_pairs_in_proportion(docs, monkeypatch, crowd):
    made, sizes = [], []
    later, finer = line_dedup._later, line_dedup._finer

    def counted(scratch, pairs, *more):
        made.append(pairs.distinct().count())
        return later(scratch, pairs, *more)

    def noted(n, most):
        sizes.append(n)
        return finer(n, most)

    monkeypatch.setattr(line_dedup, "_later", counted)
    monkeypatch.setattr(line_dedup, "_finer", noted)
    monkeypatch.setattr(line_dedup, "CROWD", crowd)
    monkeypatch.setattr(line_dedup, "finest", lambda most: 12)
    rows = like_lines(150)
    got = {r.doc_id: (r.text, r.n_exact, r.n_near) for r in line_dedup.line_dedup(docs(rows), 2).collect()}
    assert got == cut_lines(rows, 2, line_dedup.MIN_BYTES)
    assert 10 < sum(v[2] for v in got.values()) < 100
    assert sizes == ([3, 6] if crowd == 2 else []) and sum(made) < 12 * len(rows)


def test_lines_keep_columns_even_with_clashing_names(spark):
    rows = spark.createDataFrame([(1, "a line that is long enough\nx", 7, "n"), (2, "a line that is long enough", 8, "m"),
                                  (2, "a line that is long enough", 8, "m")], "doc_id long, text string, near int, did string")
    out = line_dedup.without_repeated_lines(rows)
    assert out.schema == rows.schema
    assert sorted(map(tuple, out.collect())) == [(1, "a line that is long enough\nx", 7, "n"), (2, "", 8, "m"), (2, "", 8, "m")]


# --- op5 ---------------------------------------------------------------------


def packed(rows, capacity=4096):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append(r)
    for members in by_sequence.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= capacity
    return len(by_sequence)


def test_pieces_match_the_tokenizer(docs, corpus):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(31)
    rows = [(d, t) for d, t, _ in corpus[:60] + corpus[140:] if d != 204]
    rows += [(300, prose(rng, 9000)), (301, "İΣΑΣ it's 'S don’t 12a3... A.,B é É  x y\x1cz ..."),
             (302, "x<|startoftext|>y <|ENDOFTEXT|>"), (303, "ﬁ ǅ ß ẞ Ω ́"), (304, "中文 字。a,b. Ab. ÉT. é,")]
    got = best_fit.best_fit(docs(rows), VOCABULARY, id_col="doc_id").collect()
    packed(got)
    for d, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        expected = [(k, at // 4, len(ids[at:at + 16384]) // 4, zlib.crc32(ids[at:at + 16384]))
                    for k, at in enumerate(range(0, len(ids), 16384))]
        assert sorted((r.piece, r.start, r.length, r.ids_crc32) for r in got if r.doc_id == d) == expected, text


def best_fit_decreasing(lengths, capacity):
    gaps, n = [], 0
    for length in sorted(lengths, reverse=True):
        at = bisect_left(gaps, length)
        gap = gaps.pop(at) if at < len(gaps) else capacity
        n += gap == capacity
        if gap > length:
            insort(gaps, gap - length)
    return n


def test_packing_is_near_best_fit_decreasing(spark, monkeypatch):
    """Large units, a crowd of small ones, ties, and several ranges a sweep."""
    rng = random.Random(1)
    lengths = [100, 99] + [rng.randrange(1, 101) for _ in range(60)] + [3] * 60
    rows_per_range = 50
    monkeypatch.setattr(best_fit, "ROWS_PER_RANGE", rows_per_range)
    units = spark.createDataFrame(list(enumerate(lengths)), "unit long, length long")
    placed = best_fit.pack(units, Scratch(spark, "test"), 100).join(units, "unit").collect()
    assert sorted(r.unit for r in placed) == list(range(len(lengths)))
    by_bin = defaultdict(list)
    for r in placed:
        by_bin[r.bin].append((r.offset, r.length))
    for members in by_bin.values():
        at = 0
        for offset, length in sorted(members):
            assert offset == at
            at += length
        assert at <= 100
    assert len(by_bin) <= 1.06 * best_fit_decreasing(lengths, 100) + 2


def test_matches_across_ranges_are_one_to_one():
    rng = random.Random(5)
    for _ in range(200):
        counts = {p: (rng.randrange(4), rng.randrange(4)) for p in rng.sample(range(9), 5)}
        taken = {"piece": {}, "gap": {}}
        for kind, part, first, last, number, step in best_fit.across(counts):
            for rank in range(first, last + 1):
                assert taken[kind].setdefault(number + step * (rank - first), (part, rank)) == (part, rank)
        assert taken["piece"].keys() == taken["gap"].keys()
        for number, (part, rank) in taken["piece"].items():
            assert taken["gap"][number][0] < part and rank < counts[part][0]
        # as a sequential sweep: no piece left below a gap that is left
        open_, matched = 0, 0
        for p in sorted(counts):
            take = min(open_, counts[p][0])
            matched, open_ = matched + take, open_ - take + counts[p][1]
        assert matched == len(taken["piece"])


# --- op8 ---------------------------------------------------------------------


def jaccard_components(rows, k, percent):
    sets = []
    for _, text in rows:
        words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
        n = min(k, len(words))
        sets.append({tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set())
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[root(i)].append(d)
    return sorted((str(d), len(s), str(min(least[root(i)], default=None) if s else d))
                  for i, ((d, _), s) in enumerate(zip(rows, sets)))


@pytest.mark.parametrize("k,percent", [(3, 90), (2, 50)])
def test_jaccard_components_against_all_pairs(docs, corpus, k, percent):
    rows = [(d, t) for d, t, _ in corpus]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id))
                 for r in jaccard_join.jaccard_classes(docs(rows), k, percent).collect())
    assert got == jaccard_components(rows, k, percent)


def test_large_group_of_near_copies(docs):
    rng = random.Random(41)
    base = prose(rng, 90)
    rows = [(i, edited(rng, base, rng.randrange(4))) for i in range(150)] + [(i, prose(rng, 80)) for i in range(150, 200)]
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id))
                 for r in jaccard_join.jaccard_classes(docs(rows)).collect())
    assert got == jaccard_components(rows, 3, 90)


def test_prefixes_meet():
    """Sets at the threshold share min(l, l') shingles of their prefixes."""
    rng = np.random.default_rng(6)
    table = (np.sort(rng.choice(4000, 100, replace=False)).astype(np.uint64), rng.integers(1, 500, 100))
    for _ in range(400):
        n = int(rng.integers(1, 80))
        common = rng.choice(4000, n, replace=False)
        extra = int(rng.integers(0, n // 9 + 1))
        a = np.unique(np.concatenate([common, 5000 + rng.choice(100, extra, replace=False)])).astype(np.uint64)
        b = np.sort(common).astype(np.uint64)
        if 100 * n < 90 * (n + extra):
            continue
        la, _, pa_ = jaccard_join.prefix(a, (a % 7 + 3).astype(np.int64), table, 90)
        lb, _, pb = jaccard_join.prefix(b, (b % 7 + 3).astype(np.int64), table, 90)
        assert len(np.intersect1d(pa_, pb)) >= min(la, lb)


def test_one_of_each_group(docs, corpus):
    df = docs(corpus)
    kept = jaccard_join.one_of_each(df, 5, 80)
    assert kept.schema == df.schema
    classes = jaccard_components([(d, t) for d, t, _ in corpus], 5, 80)
    expected = Counter(d for d, n, c in classes if not n) + Counter({c for _, n, c in classes if n})
    assert Counter(str(r.doc_id) for r in kept.collect()) == expected


def test_components_of_paths_and_stars(spark):
    rng = random.Random(9)
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    rng.shuffle(edges)
    got = {r.node: r.root for r in components(Scratch(spark, "test"), spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert components(Scratch(spark, "test"), spark.createDataFrame([], "a long, b long")).count() == 0


def test_a_word_is_encoded_once_whatever_mark_follows():
    encoder = best_fit.WordEncoder(VOCABULARY)
    asked, word = [], encoder._word
    encoder.ids.encode = lambda w: (asked.append(w), word(w))[1]
    ids = encoder.encode("linden. linden, linden.")
    assert sorted(asked) == ["linden", "linden,", "linden."]  # the marked ones by the bare one's ids
    assert ids == encoder._whole("linden. linden, linden.")
    assert encoder.encode("linden") == encoder._whole("linden") and len(asked) == 3


def test_workers_give_memory_back_when_a_function_ends(monkeypatch):
    released = []
    monkeypatch.setattr(common, "release", lambda: released.append(True))
    running = common.lean(lambda batches: (2 * b for b in batches))([1, 2])
    assert next(running) == 2 and not released
    assert list(running) == [4] and released == [True]
    monkeypatch.undo()
    common.release()
