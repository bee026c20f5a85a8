"""Quality rules and ranking."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import TESTDATA
from helpers import ODD_TEXTS, no_documents, odd_documents, words_of
from pyspark.sql import functions as F

from wardbook.llm import learning, quality_rules, ranking

SF = str(TESTDATA).replace("sf0.001", "sf0.01")


def plain_repeats(words):
    places = {}
    for i in range(len(words) - 7):
        places.setdefault(tuple(words[i : i + 8]), []).append(i)
    inside = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(8)}
    return len(inside)


def test_repeated_words(spark):
    texts = ["a b c d e f g h " * 3, "x " * 7, "x " * 8, "x " * 9, "a b c d e f g h i a b c d e f g h"]
    texts += [" ".join(str(i % k) for i in range(60)) for k in (5, 13, 40, 59)]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for row in quality_rules.measure(frame).collect():
        assert row.n_repeat_words == plain_repeats(words_of(texts[row.doc_id])), texts[row.doc_id]


def test_rules_run_without_user_functions(spark):
    plan = quality_rules.apply_rules(odd_documents(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_rules_on_odd_rows(spark):
    rows = quality_rules.apply_rules(odd_documents(spark)).collect()
    assert len(rows) == len(ODD_TEXTS)
    by_id = {r.doc_id: r for r in rows}
    for i in (1, 2, 3):
        row = by_id[i]
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines) == (0, 0, 0, 0)
        assert row.base_failed and not row.kept
    assert by_id[6].n_words == 20000 and by_id[6].n_repeat_words == 20000
    assert by_id[7].word_chars == sum(map(len, words_of(ODD_TEXTS[-1][1])))
    assert quality_rules.apply_rules(no_documents(spark)).count() == 0


def test_rules_follow_the_labels(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality_rules.apply_rules(docs).join(labels, "doc_id").where("not base_failed")
    wrong = judged.where(F.col("kept") != (F.col("quality") == 1)).count()
    assert wrong <= 0.02 * judged.count()


def test_a_table_of_thresholds(spark):
    frame = spark.createDataFrame([(1, "the cat sat " * 7 + "# #")], "doc_id long, text string")
    table = (quality_rules.Threshold("marks", "n_symbols", "n_words", most=0.05),)
    row = quality_rules.apply_rules(frame, table).first()
    assert row.failed == ["marks"] and not row.kept


def test_ranking_on_held_out_documents(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    rated = ranking.rate(docs, labels)
    assert rated.count() == docs.count()
    rows = rated.join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 50
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    assert np.mean([g > b for g in good for b in bad]) >= 0.97


def test_ranking_ignores_held_out_labels_and_other_columns(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    turned = labels.withColumn(
        "quality",
        F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality"))
        .otherwise(F.col("quality"))
        .cast("int"),
    )
    same = docs.withColumns({"lang": F.lit("xx"), "source": F.lit(None).cast("string")})
    first, second = ranking.rate(docs, labels), ranking.rate(same.repartition(3), turned)
    assert {tuple(r) for r in first.collect()} == {tuple(r) for r in second.collect()}


def test_sample_has_one_row_of_a_repeated_id(spark):
    often = spark.range(3000).select(F.lit(7).alias("doc_id"), F.concat(F.lit("t"), 5000 - F.col("id")).alias("text"))
    docs = often.unionByName(spark.createDataFrame([(1, "a"), (2, None), (2, "b")], "doc_id int, text string"))
    labels = spark.createDataFrame([(1, 0), (2, 1), (7, 1)], "doc_id int, quality int")
    rows = {tuple(r) for r in learning.labelled_sample(docs, labels, "quality").collect()}
    known = {1: (1, "a", 0), 2: (2, "", 1), 7: (7, "t2001", 1)}
    learned = labels.where(~learning.held_out(F.col("doc_id"))).select("doc_id").collect()
    assert 7 in {r.doc_id for r in learned}
    assert rows == {known[r.doc_id] for r in learned}
    assert learning.labelled_sample(docs, labels, "quality").count() == len(learned)


def test_ranking_odd_rows(spark):
    docs = odd_documents(spark)
    labels = spark.createDataFrame(
        [(1, 0), (4, 1), (4, 1), (6, 0), (7, 1), (5, 0), (5, 1), (None, 1), (2, None), (3, 7)],
        "doc_id long, quality int",
    )
    rows = ranking.rate(docs, labels).collect()
    assert len(rows) == len(ODD_TEXTS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[1] == by_id[2]
    model = ranking.learn(docs, labels.limit(0))
    scored = ranking.score(docs, model)
    assert scored.columns == [*docs.columns, "_score", "predicted"]
    assert [r["_score"] for r in scored.collect()] == pytest.approx([ranking.CUT] * len(rows))
    assert ranking.rate(no_documents(spark), labels).count() == 0
    assert ranking.keep_accepted(docs, labels).columns == docs.columns


def test_every_labelled_row_is_learned_from(spark):
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 4 == 0).cast("int").alias("quality")).where("doc_id < 29000")
    learned = labels.where(~learning.held_out(F.col("doc_id")))
    assert learned.count() > 20_000
    found = learning.labelled_rows(docs, labels, "quality").select("doc_id", "label")
    assert found.exceptAll(learned).count() == learned.exceptAll(found).count() == 0
    # Every row is in a pair, and no pair is there twice.
    rows = found.select(
        "doc_id", "label", F.array((F.col("doc_id") * F.when(F.col("label") == 1, 10**6).otherwise(-1)).cast("double")).alias("features")
    )
    counts = dict(rows.groupBy("label").count().collect())
    gaps = [int(r.features[0]) for r in ranking.pairs_of(rows, counts, 1).collect()]
    assert len(gaps) == len(set(gaps)) == ranking.ROUNDS * max(counts.values())
    assert {g // 10**6 for g in gaps} | {g % 10**6 for g in gaps} == {r.doc_id for r in learned.collect()}


def test_weights_and_moments_of_a_table(spark):
    draw = np.random.default_rng(3)
    rows = draw.normal(size=(20_000, 3)) * [1, 0.01, 30] + [0, 5, 1]
    marks = (rows @ [1, 20, 0.02] + draw.normal(size=len(rows)) > 100).astype(int)
    frame = spark.createDataFrame([(int(m), r.tolist()) for m, r in zip(marks, rows, strict=True)], "target int, features array<double>")
    mean, spread = learning.moments(frame, 3)
    assert np.allclose(mean, rows.mean(axis=0), rtol=1e-3, atol=1e-4) and np.allclose(spread, rows.std(axis=0), rtol=1e-2)
    weights = learning.logistic(frame, 3)
    chance = 1 / (1 + np.exp(-rows @ weights))
    assert np.abs(rows.T @ (chance - marks) / len(rows) + 1e-3 * weights).max() < 1e-2
    again = learning.logistic(frame.orderBy(F.rand(1)).repartition(5), 3)
    assert weights.tolist() == again.tolist()


def test_the_cut_has_the_fewest_rows_on_the_wrong_side():
    assert ranking.best_cut([(3, 5, 1), (5, 1, 4), (9, 0, 2)])[0] == 4.5
    assert ranking.best_cut([(7, 0, 3)])[0] == 7 and ranking.best_cut([(7, 3, 0)])[0] == 8
