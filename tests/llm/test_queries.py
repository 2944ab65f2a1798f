"""The registered queries, the classifier and the pipeline."""

import os
import random
from collections import Counter

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tallyspark.llm import decontaminate, line_dedup, quality_rules
from tallyspark.llm.best_fit import best_fit
from tallyspark.llm.common import Scratch, documents
from tallyspark.llm.jaccard_join import jaccard_classes
from tallyspark.llm.line_dedup import line_dedup as dedup_lines
from tallyspark.llm.quality_classifier import NAMES, fit, isotonic, quality_scores, score, vectors
from tallyspark.llm.sharding import interleave
from tallyspark.llm.suffix_dedup import remove_repeats
from tallyspark.llm.token_counts import token_counts

from .llm_cases import ODD, prose
from .test_groups import VOCABULARY, all_windows_of, cut_lines, jaccard_components, packed

SF = "/root/testdata/sf0.01"


def test_every_operator_is_registered():
    names = [q for q in entry.queries() if q.startswith("op") or q == "pipeline"]
    assert sorted(q.split("_")[0] for q in names) == sorted([*(f"op{n}" for n in range(1, 14)), "pipeline"])


def test_empty_tables(spark, docs):
    empty = docs([])
    benchmark = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for out in (interleave(empty), remove_repeats(empty), quality_scores(empty, labels), dedup_lines(empty),
                best_fit(empty, VOCABULARY), decontaminate.leaks(empty, benchmark), jaccard_classes(empty),
                token_counts(empty, VOCABULARY.replace("word_bpe_49k.json", "piece_bpe_32k.model")),
                quality_rules.quality_rules(empty)):
        assert out.count() == 0 and out.columns


def test_clashing_column_names(spark):
    rows = spark.createDataFrame([(1, "a b c d e f", 0.5, "x", "s"), (2, "a b c d e f", 0.5, "x", "s")],
                                 "doc_id long, text string, key double, kept string, source string")
    assert interleave(rows, 2).count() == 2
    assert {r.component_id for r in jaccard_classes(rows).collect()} == {1}
    assert remove_repeats(rows).count() == 2
    assert quality_rules.keep_good(rows).columns == rows.columns
    benchmark = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontaminate.without_leaks(rows, benchmark).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="test data not present")
def test_classifier_on_held_out_rows(spark):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = entry.queries()["op3_quality_classifier"](spark, SF).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 40
    assert sum(r.predicted == r.quality for r in rows) >= 0.93 * len(rows)
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert sum(g > b for g in good for b in bad) >= 0.95 * len(good) * len(bad)


def test_classifier_of_odd_rows_and_few_labels(spark, docs):
    df = docs(ODD)
    none = quality_scores(df, spark.createDataFrame([], "doc_id long, quality int")).collect()
    assert len(none) == len(ODD) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in none)
    some = spark.createDataFrame([(1, 0), (2, 0), (5, 1), (None, 1), (6, None), (99, 1), (5, 1)], "doc_id long, quality int")
    got = quality_scores(df, some).collect()
    assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)


def test_labels_of_the_held_out_fold_are_not_learnt(spark, docs):
    rng = random.Random(3)
    df = docs([(i, prose(rng, 40) if i % 2 else "a a a " * 20) for i in range(120)])
    points = vectors(df)
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id long, quality int")
    held = {r.doc_id for r in score(points, fit(points, labels)).where("held_out").collect()}
    changed = spark.createDataFrame([(i, (i % 2) ^ (i in held)) for i in range(120)], "doc_id long, quality int")
    one, two = (sorted((r.doc_id, r.score) for r in score(points, fit(points, x)).collect()) for x in (labels, changed))
    assert one == two and len(held) > 10
    assert len(points.first()["x"]) == len(NAMES)


def test_isotonic_regression():
    x, y = isotonic([0, 1, 2, 3, 4], [0.1, 0.5, 0.3, 0.2, 0.9], [1, 1, 1, 2, 1])
    assert y.tolist() == pytest.approx([0.1, 0.3, 0.9]) and x.tolist() == pytest.approx([0, 2.25, 4])


def test_pipeline_against_brute_force(spark, docs, tmp_path):
    rng = random.Random(51)
    base = [prose(rng, rng.randrange(60, 200)) for _ in range(12)]
    items = [(i, prose(rng, 25, lines=False)) for i in range(3)]
    rows = list(enumerate(base))
    for i in range(12, 60):
        text = rng.choice(base)
        kind = rng.randrange(5)
        if kind == 1:
            text = text.replace(" ", " q ", 1)
        elif kind == 2:
            text = prose(rng, 60) + " " + rng.choice(items)[1] + " " + prose(rng, 40)
        elif kind == 3:
            text = "spam eggs ham " * 60
        elif kind == 4:
            text = prose(rng, 80)
        rows.append((i, text))
    rows += [(100 + i, t) for i, (_, t, _) in enumerate(ODD)]
    docs(rows).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality_rules", "line_dedup", "jaccard_join", "decontaminate", "best_fit_packing"]
    kept, frame = rows, documents(spark, str(tmp_path))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, frame, str(tmp_path))
        assert out.columns == frame.columns
        got = sorted((r.doc_id, r.text, r.n_chars) for r in out.collect())
        if name == "quality_rules":
            good = {r.doc_id for r in quality_rules.quality_rules(frame).where("kept").collect()}
            kept = [r for r in kept if r[0] in good]
            assert 0 < len(kept) < len(rows)
        elif name == "line_dedup":
            kept = [(d, t) for d, (t, _, _) in cut_lines(kept, line_dedup.MOST, line_dedup.MIN_BYTES).items()]
        elif name == "jaccard_join":
            classes = jaccard_components(kept, 5, 80)
            stay = {c for _, n, c in classes if n} | {d for d, n, _ in classes if not n}
            kept = [r for r in kept if str(r[0]) in stay]
        else:
            kept = [r for r in kept if not any(all_windows_of(r[1], x) for _, x in items)]
        assert got == sorted((d, t, len(t)) for d, t in kept), name
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        frame = spark.read.parquet(path)
    result = corpus_pipeline.run(spark, str(tmp_path)).collect()
    packed(result)
    assert Counter(r.doc_id for r in result if r.piece == 0) == Counter(d for d, _ in kept)


def test_pipeline_on_empty_tables(spark, docs, tmp_path):
    before = spark.conf.get(Scratch.CLEANUP)
    docs([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "sequence_id", "offset"} <= set(out.columns)
    assert spark.conf.get(Scratch.CLEANUP) == before
