"""Exact duplicates against a plain grouping of the normalised texts."""

from __future__ import annotations

import hashlib
import re
from pathlib import Path

import pytest
from helpers import no_documents, odd_documents
from pyspark.sql import functions as F

from wardbook.llm import exact_dedup

UPPER = re.compile("[A-Z]+")


def normal(text):
    return UPPER.sub(lambda m: m[0].lower(), text or "")


def plain(rows):
    """Rows ``(doc_id, keep_id, size, sha)`` with how many of them stay."""
    groups = {}
    for doc_id, text in rows:
        groups.setdefault(normal(text), []).append(doc_id)
    found, kept = [], {}
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        kept[sha] = keep
        found += [(i, keep, len(ids), sha) for i in ids]
    return sorted(found, key=repr), kept


def compare(result, rows):
    found = [tuple(r) for r in result.collect()]
    expected, kept = plain(rows)
    assert sorted(((a, b, n, s) for a, b, n, _, s in found), key=repr) == expected
    staying = [(s, a) for a, _, _, k, s in found if k]
    assert dict(staying) == kept and len(staying) == len(kept)


def written(docs, path, files=1):
    docs.repartition(files).write.mode("append").parquet(path)
    return [tuple(r) for r in docs.select("doc_id", "text").collect()]


def test_odd_rows(spark, folder):
    """Null, empty, long and repeated texts, a null id, other alphabets, odd columns."""
    docs = odd_documents(spark).withColumns(
        {"digest": F.lit(1), "kept": F.lit("x"), "copy": F.lit(2), "_metadata": F.lit(3)}
    )
    more = [(8, "ÀÉ ONE"), (9, "Àé one"), (10, "àÉ one"), (11, "ONE"), (12, "\x00A"), (13, "K ſ"), (None, "ONE")]
    extra = spark.createDataFrame(more, "doc_id long, text string")
    path = folder("docs")
    rows = written(docs.unionByName(extra, allowMissingColumns=True), path, 3)
    compare(exact_dedup.deduplicate(spark, path, folder("store"), 1), rows)


def test_ids_that_are_all_null_and_an_empty_table(spark, folder):
    path = folder("docs")
    rows = written(spark.createDataFrame([(None, "a"), (None, "A"), (3, "b")], "doc_id long, text string"), path)
    compare(exact_dedup.deduplicate(spark, path, folder("store")), rows)
    empty = folder("empty")
    no_documents(spark).write.parquet(empty)
    assert exact_dedup.deduplicate(spark, empty, folder("store")).count() == 0


def test_files_that_come_later_meet_the_state(spark, folder):
    path, store = folder("docs"), folder("store")
    first = spark.range(300).selectExpr("id AS doc_id", "concat('Text ', id % 40) AS text")
    rows = written(first, path, 5)
    compare(exact_dedup.deduplicate(spark, path, store, 2), rows)
    # Nothing new: no row is counted twice.
    compare(exact_dedup.deduplicate(spark, path, store, 2), rows)
    later = spark.range(1000, 1300).selectExpr("id AS doc_id", "concat('tEXT ', id % 77) AS text")
    rows += written(later, path, 3)
    compare(exact_dedup.deduplicate(spark, path, store, 2), rows)
    state = exact_dedup.known(spark, store)
    assert state.count() == 77 and state.agg(F.sum("n")).first()[0] == 600
    # The locator names the row that stays.
    place = spark.read.parquet(path).select("text", "doc_id", "_metadata.file_path", "_metadata.row_index")
    found = state.select("kept.*").join(
        place.withColumnsRenamed({"doc_id": "id", "file_path": "file", "row_index": "row"}), ["id", "file", "row"]
    )
    assert found.count() == 77


@pytest.mark.parametrize("bits", [0, 2])
def test_texts_that_share_a_digest_are_parted_by_their_bytes(spark, folder, bits):
    def weak(text):
        return F.pmod(F.xxhash64(text), F.lit(2**bits)).cast("string").cast("binary")

    path = folder("docs")
    docs = spark.range(200).selectExpr("id AS doc_id", "concat('Text ', id % 30) AS text")
    rows = written(docs, path, 4)
    compare(exact_dedup.deduplicate(spark, path, folder("store"), 1, weak), rows)


def test_a_hot_text_is_one_row_per_task_before_the_shuffle(spark, folder):
    path = folder("docs")
    docs = spark.range(3000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'same', cast(id AS string)) AS text")
    rows = written(docs, path, 4)
    compare(exact_dedup.deduplicate(spark, path, folder("store")), rows)


def test_a_single_file_is_streamed(spark, folder):
    path = folder("docs")
    rows = written(spark.range(9).selectExpr("id AS doc_id", "cast(id % 2 AS string) AS text"), path)
    file = next(Path(path).glob("*.parquet"))
    compare(exact_dedup.deduplicate(spark, str(file), folder("store")), rows)
