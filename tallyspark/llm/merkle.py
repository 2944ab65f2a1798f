"""Merkle manifest of a table (operator 12).

Every row is a leaf, the SHA-256 of its fields. The leaves of a language, in
the order of their ids, form a tree: eight consecutive nodes become their
digest until one, the subroot, remains; the subroots form a tree over the
languages in the same way. A row's proof is the list of the siblings on its way
to the root.

Leaves are ordered once and dealt into aligned blocks of 8 ** 4. Each block
hashes its own subtree. Then the blocks exchange subtree roots as in a
butterfly: in a round, blocks whose numbers differ in one octal digit only form
a group of at most eight, swap the roots of the subtrees they stand for, and
each hashes the next ancestor for itself and notes the siblings. After as many
rounds as there are digits each block holds the root and its whole upper proof;
nothing is sent back down. A subtree that is smaller than its siblings, at the
end of a language, has fewer blocks than partners; its blocks then serve those
that lack one in turn. The rounds go on over the languages.

A round moves one row per block, with the proof so far. Leaves are moved twice,
as digests without their texts: once to be ordered, once to their blocks. No
task sees more than a block's leaves or eight blocks; a language that holds all
rows is many blocks.
"""

from __future__ import annotations

import hashlib
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import Scratch, numbered

FANOUT = 8
BLOCK_LEVELS = 4  # a block is a subtree of FANOUT ** BLOCK_LEVELS leaves
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digest(*texts: str) -> str:
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def _field(value: Column) -> Column:
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digest(fields: list[Column]) -> Column:
    """Digest of a row: each field with its length in bytes before it, null as a dash."""
    return F.sha2(F.concat(*map(_field, fields)), 256)


def tamper_lower(text: Column, row_id: Column) -> Column:
    """The text with A-Z in lower case where 3 divides the checksum of the id."""
    chosen = F.crc32(F.encode(row_id.cast("string"), "UTF-8")) % 3 == 0
    return F.when(chosen, F.translate(text, UPPER, LOWER)).otherwise(text)


def leaves(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", tree_col: str = "lang",
           text_col: str = "text") -> DataFrame:
    """(doc_id, tree, leaf, other): other is the digest of the tampered row."""
    plain = [F.col(f) for f in fields]
    other = [tamper_lower(F.col(text_col).cast("string"), F.col(id_col)) if f == text_col else F.col(f) for f in fields]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(tree_col).cast("string").alias("tree"),
                       leaf_digest(plain).alias("leaf"), leaf_digest(other).alias("other"))


def levels_of(nodes: list[str], levels: int | None = None) -> list[list[str]]:
    """All levels of the tree over ``nodes``; ``levels`` of them above the first,
    or as many as it takes to reach one node."""
    out = [nodes]
    while (levels is None and len(out[-1]) > 1) or (levels is not None and len(out) <= levels):
        last = out[-1]
        out.append([_digest(*last[i:i + FANOUT]) for i in range(0, len(last), FANOUT)])
    return out


def _exchange(state: DataFrame, run: Column, member: Column, low: Column, size: Column, width: Column,
              more: Column) -> DataFrame:
    """One round. ``run`` names a group of up to eight subtrees, ``member`` a
    block's subtree in it, ``low`` the block's number within the subtree of
    ``size`` blocks, ``width`` the most blocks of a subtree of the run, and
    ``more`` whether the tree has several nodes yet.

    Blocks of equal low numbers meet. A block of a narrow subtree also attends
    the meetings low + size, low + 2 size ... on behalf of the blocks it lacks.
    Each block takes the nodes of its own meeting and hashes the ancestor."""
    rows = (state.withColumn("run", run).withColumn("member", member.cast("int")).withColumn("at", low)
            .withColumn("size", size).withColumn("width", width).withColumn("more", more))
    sent = rows.where("more").select(
        "key", "run", "member", "node", F.explode(F.sequence("at", F.col("width") - 1, "size")).alias("at"))
    met = sent.groupBy("key", "run", "at").agg(
        F.array_sort(F.collect_set(F.struct("member", "node"))).alias("nodes"))  # one of each member
    rows = rows.drop("size", "width").join(met, ["key", "run", "at"], "left")

    def nodes(chosen) -> Column:
        return F.array_join(F.transform(F.filter("nodes", chosen), lambda x: x["node"]), "")

    def longer(path: str, siblings: Column) -> Column:
        return F.when(F.col("more"), F.concat(path, F.array(siblings))).otherwise(F.col(path)).alias(path)

    return rows.select(
        "tree_no", "block", "n_blocks", "subroot",
        F.when(F.col("more"), F.sha2(nodes(lambda x: F.lit(True)), 256)).otherwise(F.col("node")).alias("node"),
        longer("lefts", nodes(lambda x: x["member"] < F.col("member"))),
        longer("rights", nodes(lambda x: x["member"] > F.col("member"))))


def upper_proofs(scratch: Scratch, blocks: DataFrame, trees: DataFrame, n_trees: int, most_blocks: int) -> DataFrame:
    """(tree_no, block, subroot, root, lefts, rights): the butterfly over
    ``blocks`` (tree_no, block, n_blocks, node); ``trees`` has tree_no and
    n_blocks. On each level upwards, lefts and rights hold the siblings on
    either side put together."""

    def whole(n: Column) -> Column:
        return F.floor(n).cast("long")

    none = F.expr("cast(array() as array<string>)")
    state = blocks.select("tree_no", "block", "n_blocks", F.lit(None).cast("string").alias("subroot"), "node",
                          none.alias("lefts"), none.alias("rights"))
    block, n_blocks, tree_no = F.col("block"), F.col("n_blocks"), F.col("tree_no")
    stride, turn = 1, 0
    while stride < most_blocks:  # within the trees; a subtree has ``stride`` blocks, the last one perhaps fewer
        own, run = whole(block / stride), whole(block / (stride * FANOUT))
        size, width = (F.least(F.lit(stride).cast("long"), n_blocks - start) for start in (
            own * stride, run * (stride * FANOUT)))
        state = scratch.write(_exchange(state.withColumn("key", tree_no), run, own % FANOUT, block % stride, size,
                                        width, n_blocks > stride), f"round_{turn}")
        stride, turn = stride * FANOUT, turn + 1
    state = state.withColumn("subroot", F.col("node"))
    stride = 1
    while stride < n_trees:  # over the trees; a subtree is as wide as its widest tree
        own, run = whole(tree_no / stride), whole(tree_no / (stride * FANOUT))
        sizes = trees.groupBy(own.alias("own")).agg(F.max("n_blocks").alias("own_size"))
        widths = trees.groupBy(run.alias("own_run")).agg(F.max("n_blocks").alias("run_width"))
        wide = (state.withColumn("own", own).withColumn("own_run", run).join(sizes, "own").join(widths, "own_run")
                .withColumn("key", F.lit(-1).cast("long")))
        state = scratch.write(_exchange(wide, F.col("own_run"), F.col("own") % FANOUT, block, F.col("own_size"),
                                        F.col("run_width"), F.lit(True)), f"round_{turn}")
        stride, turn = stride * FANOUT, turn + 1
    return state.select("tree_no", "block", "subroot", F.col("node").alias("root"), "lefts", "rights")


def _proofs(block_levels: int):
    """Rows of a block with their proofs and the roots folded from them."""

    def prove(_, rows: pd.DataFrame, upper: pd.DataFrame) -> pd.DataFrame:
        rows, top = rows.sort_values("place"), upper.iloc[0]
        path = list(zip(top["lefts"], top["rights"]))
        above = "".join(left + right for left, right in path)
        whole = int(rows["n"].iloc[0]) <= FANOUT ** block_levels
        levels = levels_of(rows["leaf"].tolist(), None if whole else block_levels)[:-1]
        # the nodes of each run put together; a node is 64 characters of it
        runs = [["".join(level[i:i + FANOUT]) for i in range(0, len(level), FANOUT)] for level in levels]
        proofs, folded = [], []
        for at, node in enumerate(rows["other"]):
            siblings = []
            for level in runs:
                at, digit = divmod(at, FANOUT)
                siblings.append((level[at][:64 * digit], level[at][64 * digit + 64:]))
            proofs.append(_digest(*(left + right for left, right in siblings), above))
            for left, right in siblings + path:
                node = _digest(left, node, right)
            folded.append(node)
        return pd.DataFrame({"doc_id": rows["doc_id"], "leaf": rows["leaf"], "subroot": top["subroot"],
                             "root": top["root"], "proof_sha256": proofs, "folded_root": folded})

    return prove


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", tree_col: str = "lang",
             text_col: str = "text", block_levels: int = BLOCK_LEVELS) -> DataFrame:
    """One row per row of ``docs``: doc_id, leaf, subroot, root, proof_sha256,
    folded_root, verified.

    ``proof_sha256`` digests the siblings on the way to the root; ``folded_root``
    is the root that follows from them and the tampered leaf, and ``verified``
    whether it is the root. Null fields are dashes in a leaf; rows with a null
    ``tree_col`` are a tree of their own, the first; null ids come first and
    are never tampered with; rows of equal ids are ordered by their leaves.
    Texts may be of any length. Columns beyond ``fields`` are not read. An
    empty table gives an empty result.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "merkle")
    order = [F.col("tree").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("leaf"), F.col("other")]
    ordered = numbered(scratch, leaves(docs, fields, id_col, tree_col, text_col), order, "leaves", "row_no")
    by_tree = ordered.groupBy("tree").agg(F.min("row_no").alias("first"), F.count("*").alias("n"))
    size = FANOUT ** block_levels
    trees = scratch.write(numbered(scratch, by_tree, [F.col("first")], "by_tree", "tree_no").withColumn(
        "n_blocks", F.ceil(F.col("n") / size).cast("long")), "trees")
    placed = ordered.join(trees, ordered["tree"].eqNullSafe(trees["tree"])).select(
        "doc_id", "leaf", "other", "tree_no", "n", "n_blocks", (F.col("row_no") - F.col("first")).alias("place")
    ).withColumn("block", F.floor(F.col("place") / size).cast("long"))

    def subtree(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        first = rows.iloc[:1]
        whole = int(first["n"].iloc[0]) <= size
        return first[["tree_no", "block", "n_blocks"]].assign(
            node=levels_of(rows["leaf"].tolist(), None if whole else block_levels)[-1][0])

    blocks = placed.select("tree_no", "block", "n_blocks", "n", "place", "leaf").groupBy("tree_no", "block").applyInPandas(
        subtree, "tree_no long, block long, n_blocks long, node string")
    n_trees, most = trees.agg(F.count("*"), F.coalesce(F.max("n_blocks"), F.lit(0))).first()
    upper = upper_proofs(scratch, scratch.write(blocks, "blocks"), trees, n_trees, most)
    id_type = placed.schema["doc_id"].dataType.simpleString()
    proven = placed.select("tree_no", "block", "n", "place", "doc_id", "leaf", "other").groupBy("tree_no", "block").cogroup(
        upper.groupBy("tree_no", "block")).applyInPandas(
        _proofs(block_levels), f"doc_id {id_type}, leaf string, subroot string, root string, proof_sha256 string, "
                               "folded_root string")
    return proven.withColumn("verified", F.col("folded_root") == F.col("root"))
