"""Unigram token counts by dynamic programming on a shared trie (operator 9).

A text's tokens are those of its best segmentation: pre-tokens are the words
between white space, each with a word mark in front, and every pre-token is cut
into the vocabulary's pieces with the greatest sum of log-probabilities.

The distinct pre-tokens are inserted in a trie. A node holds the forward score
of the prefix it stands for, the best of all segmentations up to there, and the
number of tokens in it; it is computed when the node is made, from the nodes on
its path, so pre-tokens with a common prefix share that work. The count of a
pre-token is that of its last node.

Tries belong to the workers, are kept between tasks and bounded; texts are
scanned once, without a shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from tallyspark.llm.common import id_and_text, slices

MARK = "▁"  # the vocabulary's mark of a word's beginning
MOST_NODES = 500_000
MOST_WORDS = 300_000


class Vocabulary:
    """Pieces and their log-probabilities. The file gives ranks; by Zipf's law
    the piece of rank r has a probability in proportion to 1 / (r + 1). A
    character that no piece covers is spelt in its UTF-8 bytes."""

    def __init__(self, pieces: list[str]):
        total = math.log(sum(1 / (r + 1) for r in range(len(pieces))))
        self.log_p = {}
        for rank, piece in enumerate(pieces):
            self.log_p.setdefault(piece, -math.log(rank + 1) - total)
        # lengths of the pieces of three characters or more, by their last three
        tails: dict[str, set[int]] = {}
        for piece in pieces:
            if len(piece) > 2:
                tails.setdefault(piece[-3:], set()).add(len(piece))
        self.tails = {tail: tuple(sorted(sizes)) for tail, sizes in tails.items()}
        self.byte_log_p = -math.log(len(pieces) + 1) - total - 10

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        return cls([model.id_to_piece(i) for i in range(model.get_piece_size())
                    if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))])


class Trie:
    """Forward scores and token counts of prefixes of pre-tokens."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.clear()

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.score, self.tokens = [0.0], [0]
        self.words: dict[str, int] = {}  # terminal nodes

    def insert(self, word: str) -> int:
        """The last node of a pre-token."""
        node, path = 0, [0]
        for end, char in enumerate(word, 1):
            below = self.child.get((node, char))
            if below is None:
                below = self._node(word, end, path)
                self.child[node, char] = below
            node = below
            path.append(node)
        return node

    def _node(self, word: str, end: int, path: list[int]) -> int:
        log_p, score, tokens = self.vocabulary.log_p, self.score, self.tokens
        n_bytes = len(word[end - 1].encode("utf-8", "replace"))
        best = score[path[end - 1]] + n_bytes * self.vocabulary.byte_log_p
        count = tokens[path[end - 1]] + n_bytes
        for size in (1, 2, *self.vocabulary.tails.get(word[max(0, end - 3):end], ())):
            start = end - size
            if start >= 0 and (p := log_p.get(word[start:end])) is not None:
                value, k = score[path[start]] + p, tokens[path[start]] + 1
                if value > best or value == best and k < count:
                    best, count = value, k
        score.append(best)
        tokens.append(count)
        return len(score) - 1

    def nodes(self, words: list[str]) -> list[int]:
        """The last node of each pre-token."""
        if len(self.score) > MOST_NODES or len(self.words) > MOST_WORDS:
            self.clear()
        known = self.words
        for word in set(words).difference(known):
            known[word] = self.insert(MARK + word)
        return list(map(known.__getitem__, words))


@lru_cache(maxsize=2)
def trie_of(path: str) -> Trie:
    """One trie a worker."""
    return Trie(Vocabulary.read(path))


def _count(path: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = trie_of(path)
        for batch in slices(batches, "text"):
            n, tokens, scores = [], [], []
            for text in batch.column("text").to_pylist():
                nodes = trie.nodes((text or "").split())
                n.append(len(nodes))
                tokens.append(sum(map(trie.tokens.__getitem__, nodes)))
                scores.append(math.fsum(map(trie.score.__getitem__, nodes)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(tokens, pa.int64()),
                 pa.array(scores, pa.float64())], names=["doc_id", "n_words", "n_tokens", "log_probability"])

    return run


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words (pre-tokens), n_tokens,
    log_probability of the best segmentation.

    Null, empty and blank texts have no tokens and the log-probability 0.
    Of segmentations with equal scores the one with fewer tokens counts.
    Repeated rows and null ids are counted row by row. Other columns of
    ``docs`` are not read. An empty table gives no rows.
    """
    rows = id_and_text(docs, id_col, text_col)
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(_count(vocabulary),
                           f"doc_id {id_type}, n_words long, n_tokens long, log_probability double")
