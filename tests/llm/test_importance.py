"""Importance resampling against a plain restatement."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from .llm_cases import ODD, prose

from tallyspark.llm import importance
from tallyspark.llm.importance import crc32_pieces, crc32_rows, feature_buckets, resample, sample

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall((text or "").encode().lower())


def buckets(text):
    w = words(text)
    return [zlib.crc32(b" ".join(w[i:i + k])) % 10000 for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain(rows, target):
    s, t = Counter(b for _, x in rows for b in buckets(x)), Counter(b for x in target for b in buckets(x))
    all_s, all_t = sum(s.values()), sum(t.values())
    out = []
    for i, text in rows:
        found = buckets(text)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * (all_s + 10000) / ((s[b] + 1) * (all_t + 10000)))) for b in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(words(text)), len(found), weight,
                    weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= 20), key=lambda r: (-r[4], r[0] is not None, r[0] or 0, r[2]))
    for rank, row in enumerate(able[:5 * len(able) // 100], 1):
        row[5] = rank
    return sorted(map(tuple, out), key=str)


def test_checksums():
    rng = random.Random(1)
    rows = np.frombuffer(rng.randbytes(13 * 50), np.uint8).reshape(50, 13)
    assert crc32_rows(rows).tolist() == [zlib.crc32(r.tobytes()) for r in rows]
    data = rng.randbytes(20000)
    places = [(rng.randrange(9000), rng.choice([1, 2, 7, 300, importance.LONG + 5, 9000])) for _ in range(300)]
    starts, lengths = (np.array(x) for x in zip(*places))
    got = crc32_pieces(np.frombuffer(data, np.uint8), starts, lengths)
    assert got.tolist() == [zlib.crc32(data[a:a + n]) for a, n in places]


def test_features_of_odd_texts():
    rng = random.Random(2)
    letters = "aAbZz09 .-\n`{éÄ中\x00\x7f/:@["
    texts = ["".join(rng.choices(letters, k=rng.randrange(0, 90))) for _ in range(400)]
    texts += [None, "", "one", "x" * 70000, "a " * 3000, "  A-b C9é "]
    found, owners, n_words = feature_buckets([None if t is None else t.encode() for t in texts])
    own = [[] for _ in texts]
    for b, o in zip(found.tolist(), owners.tolist()):
        own[o].append(b)
    assert [sorted(o) for o in own] == [sorted(buckets(t)) for t in texts]
    assert n_words.tolist() == [len(words(t)) for t in texts]
    assert [len(x) for x in feature_buckets([])] == [0, 0, 0]


def test_resampling_against_restatement(spark, docs):
    rng = random.Random(3)
    rows = [(i, prose(rng, rng.randrange(5, 90))) for i in range(300)]
    rows += [(i, rows[i % 7][1]) for i in range(300, 340)] + [(700, rows[0][1])] * 3 + [(i, t) for i, t, _ in ODD]
    target = [prose(rng, 40) for _ in range(5)] + [None, ""]
    bench = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    got = sorted(map(tuple, resample(docs(rows), bench).collect()), key=str)
    assert got == plain(rows, target)
    assert sum(r[5] is not None for r in got) == 5 * sum(r[1] >= 20 for r in got) // 100 > 10


def test_ties_go_to_the_smaller_id(spark, docs):
    """Without features in the gains all weights are equal; so are scores of equal ids."""
    rows = [(i, " ".join(["w"] * 20)) for i in range(100)] + [(3, " ".join(["w"] * 20))] * 5
    got = sorted((r["rank"], -r.score, r.doc_id) for r in resample(
        docs(rows), spark.createDataFrame([], "item_id long, text string"), percent=40).collect() if r["rank"])
    assert [r[0] for r in got] == list(range(1, 43)) and got == sorted(got, key=lambda r: r[1:])


def test_target_like_documents_are_drawn(spark, docs):
    rng = random.Random(4)
    target = [prose(rng, 60) for _ in range(10)]
    near = {i: " ".join(rng.sample(rng.choice(target).split(), 40)) for i in range(10)}
    rows = [*near.items(), *((i, " ".join(f"z{rng.randrange(500)}" for _ in range(40))) for i in range(10, 200))]
    bench = spark.createDataFrame(list(enumerate(target)), "item_id long, text string")
    df = docs(rows)
    drawn = sample(df, bench)
    assert drawn.columns == df.columns and {r.doc_id for r in drawn.collect()} == set(near)


def test_empty_tables_and_clashing_columns(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert resample(docs([]), none).collect() == []
    rows = spark.createDataFrame([(i, "a b c " * 9, 1, "x", 0.5) for i in range(40)],
                                 "doc_id long, text string, rank int, weight string, place double")
    assert resample(rows, none).where("rank is not null").count() == 2
    assert sample(rows, none).columns == rows.columns
