"""The pipeline and the queries of the operators."""

from __future__ import annotations

from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from conftest import TESTDATA
from helpers import words_of
from test_llm_packing import tokenizer  # noqa: F401 - a fixture
from test_llm_simhash import plain_groups, plain_print

import __spark_entry__ as entry_points
import corpus_pipeline
from wardbook.llm import mixing, ranking, secrets
from wardbook.llm.queries import ORACLES, QUERIES
from wardbook.llm.shared import staged

SF = str(TESTDATA)


def test_every_operator_is_registered_once():
    numbers = sorted(int(name[2:].split("_")[0]) for name in QUERIES)
    assert numbers == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, name):
    database = duckdb.connect()
    for table in ("documents", "pages", "conversations"):
        database.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    theirs = database.execute(ORACLES[name]).df()
    ours = QUERIES[name](spark, SF).toPandas()
    assert sorted(ours.columns) == sorted(theirs.columns)

    def rows(frame):
        frame = frame[sorted(frame.columns)].astype(object)
        return sorted(frame.where(frame.notna(), None).itertuples(index=False, name=None), key=repr)

    assert rows(ours) == rows(theirs)


def test_pipeline_against_plain_stages(spark, tokenizer):  # noqa: F811
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = ranking.learn(docs, labels)
    rows = [r for r in docs.collect() if model.score(np.array([ranking.features(r.text)]))[0] >= 0.3]
    assert 0 < len(rows) < docs.count()
    groups = plain_groups([(r.doc_id, plain_print(r.text)) for r in rows])
    rows = [r for r in rows if groups[r.doc_id] == r.doc_id]
    texts = {
        r.doc_id: secrets.redacted(r.text, secrets.find([r.text])[0]) for r in rows
    }
    mixed = spark.createDataFrame(
        [(r.doc_id, texts[r.doc_id], r.source) for r in rows], "doc_id long, text string, source string"
    )
    copies = {r.doc_id: r.copies for r in mixing.mix(mixed).collect() if r.copies}
    found = corpus_pipeline.run(spark, SF).collect()
    assert Counter(r.doc_id for r in found if r.start == 0) == copies
    pieces = {}
    for r in found:
        pieces.setdefault((r.doc_id, r.start), set()).add(bytes(r.ids))
    for doc_id in copies:
        own = sorted((s, p) for (d, s), p in pieces.items() if d == doc_id)
        assert all(len(p) == 1 for _, p in own)
        ids = np.frombuffer(b"".join(next(iter(p)) for _, p in own), dtype="<u4").tolist()
        assert ids == tokenizer(texts[doc_id]) + [1]


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
    assert words_of(" a\tb ") == ["a", "b"]


def odd_columns(spark, docs):
    """Names with dots, blanks and back-ticks, nested and map columns, a text ``n_chars``."""
    rows = docs.withColumns(
        {
            "meta.lang": F.lit("en"),
            "a `b` c": F.lit(1.5),
            "tags": F.array(F.lit("x"), F.lit(None).cast("string")),
            "notes": F.create_map(F.lit("k"), F.col("source")),
            "nested": F.struct(F.lit(1).alias("x.y"), F.lit("z").alias("doc_id")),
            "n_chars": F.length("text").cast("string"),
            "predicted": F.lit("mine"),
            "first": F.lit(True),
            "several": F.lit(False),
            "rate": F.lit(2),
            "row": F.lit(None).cast("binary"),
        }
    )
    # A repeated row, a changed one under the same id, and texts that are null or empty.
    again = rows.orderBy("doc_id").limit(1)
    odd = [again, again.withColumn("a `b` c", F.lit(2.5))]
    for doc_id, text in ((-1, None), (-2, ""), (None, "no number")):
        odd.append(
            again.withColumns({"doc_id": F.lit(doc_id).cast("long"), "text": F.lit(text).cast("string")})
        )
    for one in odd:
        rows = rows.unionByName(one)
    return rows


def test_every_stage_takes_any_columns(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").limit(60)
    rows = staged(odd_columns(spark, given), "odd")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, rows, SF)
        assert found.columns == rows.columns, name
        assert found.dtypes == rows.dtypes, name
        collected = found.collect()
        assert collected, name
        if name == "secret scan":
            assert len(collected) == rows.count()
            assert all(r.n_chars == str(len(r.text)) for r in collected if r.text is not None)
        if name == "near duplicates":
            ids = [r.doc_id for r in collected if r.doc_id is not None]
            assert len(ids) == len(set(ids))
    assert corpus_pipeline.STAGES[-1][1](spark, rows, SF).count() > 0


def test_stages_in_a_row_on_odd_and_on_empty_tables(spark):
    given = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    for rows in (odd_columns(spark, given), odd_columns(spark, given.limit(0)).limit(0)):
        rows = staged(rows, "odd")
        for name, stage in corpus_pipeline.STAGES[:-1]:
            columns = rows.columns
            rows = staged(stage(spark, rows, SF), "stage")
            assert rows.columns == columns, name
        packed = corpus_pipeline.STAGES[-1][1](spark, rows, SF)
        assert (packed.count() == 0) == (rows.count() == 0)
