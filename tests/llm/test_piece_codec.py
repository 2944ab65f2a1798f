"""The piece codec against the sentencepiece library on whole texts."""

import hashlib
import os
import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from .llm_cases import ODD, prose

import __spark_entry__ as entry
from tallyspark.llm import piece_codec
from tallyspark.llm.piece_codec import Codec, piece_codes, piece_digests

SF = "/root/testdata/sf0.01"
MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=MODEL)
LETTERS = list(" ▁\n\t\r aabcdeé中文字🤖<>s/09\x00　ﬁ①.,") + ["the", " in", "▁▁", "    ", "<s>", "<0x0A>"]


def soup(rng, most):
    return "".join(rng.choices(LETTERS, k=rng.randrange(most)))


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_random_texts_against_the_library():
    rng = random.Random(1)
    codec = Codec(MODEL)
    for texts in ([soup(rng, 60) for _ in range(3000)], [soup(rng, 3000) for _ in range(40)],
                  [prose(rng, 300) for _ in range(20)], [None, "", " "], [None], []):
        ids, decimals = codec.encode(texts)
        want = LIBRARY.encode([t or "" for t in texts])
        assert ids.to_pylist() == want
        assert decimals.to_pylist() == [",".join(map(str, i)) for i in want]
        assert codec.decode(texts, ids) == (LIBRARY.decode(want) if want else [])


def test_agendas_agree(monkeypatch):
    """Runs side by side, and the heap for long ones, give the same pieces."""
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcdefABC-/'", k=rng.randrange(1, 200))) for _ in range(300)]
    codec = Codec(MODEL)
    want = LIBRARY.encode(texts)
    assert codec.encode(texts)[0].to_pylist() == want
    monkeypatch.setattr(piece_codec, "SHORT", 0)
    assert Codec(MODEL).encode(texts)[0].to_pylist() == want
    assert [codec.spell(codec.join_heap("▁" + t)) for t in texts] == want


def test_texts_that_cannot_be_cut():
    """A vocabulary that joins over line ends is encoded a text at a time."""
    codec = Codec(MODEL)
    codec.cuts = False
    texts = [soup(random.Random(3), 400) for _ in range(30)] + [None, "", "a\nb"]
    assert codec.encode(texts)[0].to_pylist() == LIBRARY.encode([t or "" for t in texts])


def test_long_words():
    word = "".join(random.Random(4).choices("ABCDEFabcdef0123+/", k=200_000))
    codec = Codec(MODEL)
    ids, _ = codec.encode([word, word[:50_000]])
    assert ids.to_pylist() == LIBRARY.encode([word, word[:50_000]])


def test_runs_are_remembered_within_a_bound(monkeypatch):
    monkeypatch.setattr(piece_codec, "REMEMBERED", 20_000)
    rng = random.Random(5)
    codec = Codec(MODEL)
    for _ in range(20):
        texts = [prose(rng, 100) for _ in range(5)]
        assert codec.encode(texts)[0].to_pylist() == LIBRARY.encode(texts)
        assert codec.known_runs.nbytes < 20_000


def test_a_difference_ends_the_job():
    codec = Codec(MODEL)
    codec.joins.results[:] = codec.joins.results[::-1].copy()
    with pytest.raises(ValueError, match="library"):
        codec.encode(["the quick brown fox"])


def test_other_vocabularies_are_refused(tmp_path):
    model = open(MODEL, "rb").read()
    kind = model.rindex(b"\x18\x02 \x80\xfa\x01")  # the type of the vocabulary: merges
    path = tmp_path / "unigram.model"
    path.write_bytes(model[:kind] + b"\x18\x01" + model[kind + 2:])
    with pytest.raises(ValueError, match="merges"):
        piece_codec.Vocabulary(str(path))


def test_odd_rows(docs):
    rows = piece_codes(docs(ODD), MODEL).collect()
    got = sorted((str(r.doc_id), r.ids, r.decoded) for r in rows)
    assert got == sorted((str(d), LIBRARY.encode(t or ""), t or "") for d, t, _ in ODD)


def test_clashing_columns_and_no_rows(spark, docs):
    rows = spark.createDataFrame([(1, "a b", 3, "x")], "doc_id long, text string, ids int, decoded string")
    assert piece_codes(rows, MODEL).first().decoded == "a b"
    assert piece_digests(docs([]), MODEL).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_query_over_the_whole_table(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = entry.queries()["op13_piece_codec"](spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = LIBRARY.encode(texts[r.doc_id])
        decoded = LIBRARY.decode(ids)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), digest(",".join(map(str, ids))), digest(decoded))
        assert r.round_trip == (decoded == texts[r.doc_id])
