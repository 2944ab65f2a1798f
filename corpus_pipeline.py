"""From raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), docs being what the stage before it
kept, and returns a DataFrame; all but the last return the columns of
documents. The result of each is written as Parquet and read again.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.best_fit import best_fit
from tallyspark.llm.common import Scratch, documents
from tallyspark.llm.decontaminate import without_leaks
from tallyspark.llm.jaccard_join import one_of_each
from tallyspark.llm.line_dedup import without_repeated_lines
from tallyspark.llm.quality_rules import keep_good
from tallyspark.session import read_table

VOCABULARY = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without their repeated lines; n_chars follows the text."""
    cut = without_repeated_lines(docs)
    return cut.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return one_of_each(docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark."""
    return without_leaks(docs, read_table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The remaining documents' pieces, packed into sequences."""
    return best_fit(docs, public_tokenizers.path(VOCABULARY))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("jaccard_join", jaccard_join),
    ("decontaminate", decontaminate),
    ("best_fit_packing", best_fit_packing),
]

# zstandard ratios, edit joins and tokenizers have no SQL; tests/llm holds the
# pipeline against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``: the pieces of ``best_fit`` over what is kept.

    Null, empty and short texts fail the quality rules. A text whose lines line
    dedup has cut altogether is empty from there on, passes the later stages
    and is packed as one end token. Null ids come last where documents are
    ordered; rows of equal id and text are one document, of which the Jaccard
    join keeps one. Further columns go along to the last stage. An empty table
    gives no rows; an empty benchmark takes no document away.
    """
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i + 1 == len(STAGES):
            return out
        docs = scratch.write(out, f"{i}_{name}")
