"""The Merkle manifest against a plain tree over all rows."""

import hashlib
import random
import zlib

import pytest
from .llm_cases import ODD

from tallyspark.llm.merkle import manifest


def digest(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def leaf(r, text):
    return digest(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def tree(nodes):
    """Root, and of every leaf its siblings (left, right) upwards."""
    paths, below = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, under = [], []
        for i in range(0, len(nodes), 8):
            run = nodes[i:i + 8]
            for j in range(len(run)):
                for x in below[i + j]:
                    paths[x].append((run[:j], run[j + 1:]))
            up.append(digest(*run))
            under.append([x for part in below[i:i + 8] for x in part])
        nodes, below = up, under
    return nodes[0], paths


def tampered(r):
    if r.text is None or r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 3:
        return r.text
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in r.text)


def plain(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r.lang, []).append(r)
    trees = []
    for lang in sorted(by_lang, key=lambda x: (x is not None, (x or "").encode())):
        own = sorted(by_lang[lang], key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
        trees.append((own, *tree([leaf(r, r.text) for r in own])))
    root, tops = tree([subroot for _, subroot, _ in trees])
    out = []
    for (own, subroot, paths), top in zip(trees, tops):
        for r, path in zip(own, paths):
            path = path + top
            node = leaf(r, tampered(r))
            for left, right in path:
                node = digest(*left, node, *right)
            proof = digest(*(x for left, right in path for x in left + right))
            out.append((r.doc_id, leaf(r, r.text), subroot, root, proof, node, node == root))
    return sorted(out, key=str)


def found(df, **how):
    return sorted(map(tuple, manifest(df, **how).collect()), key=str)


@pytest.fixture
def many(spark):
    """Rows in 75 languages, one of them with a third of all rows."""
    rng = random.Random(5)
    langs = [None, "", "zz", "é", *(f"l{i}" for i in range(70))]
    rows = [(i, rng.choice(["Ab", "x", "", None, "Zü"]), rng.choice(["a", "a", rng.choice(langs), rng.choice(langs)]),
             rng.choice([None, "s"]), rng.choice([None, 3])) for i in rng.sample(range(10**6), 900)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


@pytest.mark.parametrize("block_levels", [4, 1, 0])
def test_manifest_against_plain_trees(many, block_levels):
    """Blocks of 4096, 8 and 1 leaves: no, some and only exchanges within a language."""
    want = plain(many.collect())
    assert found(many, block_levels=block_levels) == want
    assert 0 < sum(r[-1] for r in want) < len(want)


@pytest.mark.parametrize("n", [1, 2, 8, 9, 64, 65, 73, 513])
def test_last_runs_of_one_language(spark, n):
    df = spark.createDataFrame([(i, f"T{i}", "en", "s", i) for i in range(n)],
                               "doc_id long, text string, lang string, source string, n_chars long")
    assert found(df, block_levels=1) == plain(df.collect())


def test_odd_rows(docs):
    df = docs(ODD)
    assert found(df) == plain(df.collect())
    # a lone leaf is the root, and its proof is empty
    lone = manifest(df.where("doc_id = 7")).first()
    assert lone.leaf == lone.subroot == lone.root and lone.proof_sha256 == digest()


def test_clashing_columns_and_no_rows(spark, docs):
    schema = ", ".join(["doc_id long", "text string", "lang string", "source string", "n_chars long", "tree string",
                        "leaf int", "place int", "block string", "n double", "node string"])
    df = spark.createDataFrame([(i, "Text", "en", "s", 4, "t", 1, 2, "b", 0.5, "n") for i in range(20)], schema)
    assert found(df, block_levels=1) == plain(df.collect())
    assert manifest(docs([])).collect() == []
