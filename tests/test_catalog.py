"""Every registered query against its SQL, on the smallest data."""

from __future__ import annotations

from pathlib import Path

import duckdb
import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from catalog import folder_queries
from catalog.registry import ORACLES, QUERIES

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def database():
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(
            f"CREATE VIEW {table} AS SELECT * FROM '{TESTDATA}/{table}.parquet'"
        )
    yield connection
    connection.close()


def _sorted_rows(frame):
    frame = frame[sorted(frame.columns)]
    frame = frame.astype(object).where(frame.notna(), None)
    return sorted(frame.itertuples(index=False, name=None), key=repr)


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)
    assert set(QUERIES) <= set(entry_points.queries())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_agrees_with_sql(spark, database, name):
    ours = entry_points.queries()[name](spark, str(TESTDATA)).toPandas()
    theirs = database.execute(entry_points.oracle_sql()[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert _sorted_rows(ours) == _sorted_rows(theirs)


def test_pretty_files_stay_small(spark, folder, monkeypatch):
    """Ids that agree modulo 40, ten times as many rows as a file may have."""
    ids = spark.range(20_000).select((F.col("id") * 40).alias("event_id"))
    shape = folder_queries.records(spark, str(TESTDATA))
    rows = shape.limit(1).drop("event_id").crossJoin(ids).coalesce(2).select(*shape.columns)
    path = folder()
    monkeypatch.setattr(folder_queries, "records", lambda *_: rows)
    monkeypatch.setattr(folder_queries, "shared_folder", lambda *_: path)
    assert folder_queries.pretty_documents(spark, "").count() == 20_000
    sizes = [f.read_text().count('"patient_id"') for f in Path(path).glob("*.txt")]
    assert sum(sizes) == 20_000 and max(sizes) <= 2_000 and len(sizes) >= 10


def test_entry_has_rows(spark):
    assert not entry_points.entry(spark).isEmpty()
