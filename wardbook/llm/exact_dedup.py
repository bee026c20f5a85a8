"""Exact duplicates by a stream whose state never expires."""

from __future__ import annotations

import posixpath
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from wardbook.llm.shared import staged
from wardbook.operators.counts import has_rows
from wardbook.operators.keyed import last_per_key, left_join_unique, rows_with_keys
from wardbook.streaming.batches import start_batches

FILES_PER_BATCH = 10_000

# State lies on the executors' disks with its changes in the checkpoint; the memory of all
# stores of an executor is bounded together.
_STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    # Otherwise each open store sets aside megabytes of disk that it does not write.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}

Digest = Callable[[Column], Column]


def normalised(text: Column) -> Column:
    """The text with A-Z lower-cased; null is empty.

    In a text of plain characters nothing else has a lower case, and ``lower`` is far faster.
    """
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    plain = F.octet_length(text) == F.length(text)
    return F.when(text.isNull(), "").when(plain, F.lower(text)).otherwise(lowered)


def sha256(text: Column) -> Column:
    """SHA-256 as 32 bytes."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


def _copies(docs: DataFrame, digest: Digest) -> DataFrame:
    """``doc_id, text, digest, copy`` of every row; ``copy`` is its id and where it lies."""
    place = docs.metadataColumn("_metadata")
    text = normalised(F.col("text")).alias("text")
    copy = F.struct(
        F.col("doc_id").alias("id"),
        place["file_path"].alias("file"),
        place["row_index"].alias("row"),
    )
    rows = docs.select("doc_id", text, copy.alias("copy"))
    return rows.withColumn("digest", digest(F.col("text")))


@contextmanager
def _conf(spark: SparkSession, options: dict[str, str]) -> Iterator[None]:
    before = {key: spark.conf.get(key, None) for key in options}
    for key, value in options.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def _groups_folder(store: str) -> str:
    return posixpath.join(store, "groups")


def _as_pattern(path: str) -> str:
    """A pattern that only ``path`` meets. As a pattern, a single file can be streamed too."""
    whole = path.rstrip("/")
    return f"{whole[:-1]}[{whole[-1]}]"


_GROUPS_DDL = "digest binary, n long, kept struct<id: {id}, file: string, row: long>"


def ingest(
    spark: SparkSession,
    path: str,
    store: str,
    files_per_batch: int = FILES_PER_BATCH,
    digest: Digest = sha256,
) -> StreamingQuery:
    """Take the files that have come to the Parquet folder ``path`` since the last run.

    A streaming aggregation without watermark keeps for each digest, for ever, how many rows
    had it and the row with the largest id: its id and its place, file and row number. A
    task reduces its rows to one per digest before the shuffle, so a digest that a third of
    the rows share costs one row per task. Each batch writes the digests it changed under
    its own name, so a replayed batch adds nothing. ``store`` holds checkpoint and results.
    """
    schema = spark.read.parquet(path).select("doc_id", "text").schema
    ddl = _GROUPS_DDL.format(id=schema["doc_id"].dataType.simpleString())
    folder = _groups_folder(store)
    spark.createDataFrame([], ddl).write.mode("ignore").parquet(posixpath.join(folder, "batch=none"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    rows = _copies(stream.parquet(_as_pattern(path)), digest).select("digest", "copy")
    state = rows.groupBy("digest").agg(F.count("*").alias("n"), F.max("copy").alias("kept"))

    def write(changed: DataFrame, name: str) -> None:
        writer = changed.withColumn("batch", F.lit(name)).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(folder)

    with _conf(spark, _STATE_CONF):
        return start_batches(state, posixpath.join(store, "checkpoint"), write, mode="update")


def known(spark: SparkSession, store: str) -> DataFrame:
    """``digest, n, kept``: the newest state of every digest seen so far.

    A group only grows, so its newest state is the one with most rows.
    """
    rows = spark.read.parquet(_groups_folder(store)).drop("batch")
    return last_per_key(rows, ["digest"], ["n"])


def _sharing_digests(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """The digests that different texts share, by comparing the bytes of all hits.

    The hash of the digest joins too, so that adaptive execution may split a digest that many
    rows have (as in ``left_join_unique``); equal texts of a task are one row after that.
    """
    key = F.xxhash64("digest").alias("key")
    hits = groups.where(F.col("n") > 1).select("digest", key).hint("shuffle_hash")
    found = rows.select("digest", key, "text").join(hits, ["digest", "key"], "left_semi")
    texts = found.groupBy("digest", "text").agg(F.count("*").alias("n"))
    return texts.groupBy("digest").agg(F.count("*").alias("texts")).where("texts > 1").select("digest")


def decisions(
    spark: SparkSession, path: str, store: str, digest: Digest = sha256
) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row in ``path``.

    Texts are equal when they are so byte by byte after lower-casing A-Z; a null text is
    empty. The row with the largest id stays; of repeated rows of that id, and in a group
    without any id, the last one by file and row number, so one row of every group stays.
    A null id is smaller than any other. An empty table gives an empty one; other columns,
    whatever their names, are not read. All of ``path`` must have been taken by ``ingest``.

    A digest in the state is only a hint: the texts of every digest with more than one row
    are compared in full, and groups of texts that share a digest by chance are parted.
    """
    rows = _copies(spark.read.parquet(path), digest)
    groups = staged(known(spark, store), "digests")
    hashed = rows.withColumn("text_sha256", F.sha2(F.col("text").cast("binary"), 256))
    found = left_join_unique(hashed.drop("text"), groups, ["digest"])
    shared = staged(_sharing_digests(rows, groups), "shared-digests")
    if has_rows(shared):
        parted = rows_with_keys(hashed, shared, ["digest"])
        texts = parted.groupBy("digest", "text").agg(
            F.count("*").alias("n"), F.max("copy").alias("kept")
        )
        parted = left_join_unique(parted, texts, ["digest", "text"]).drop("text")
        found = found.join(shared, "digest", "left_anti").unionByName(parted)
    return found.select(
        "doc_id",
        F.col("kept")["id"].alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("copy") == F.col("kept")).alias("kept"),
        "text_sha256",
    )


def deduplicate(
    spark: SparkSession,
    path: str,
    store: str,
    files_per_batch: int = FILES_PER_BATCH,
    digest: Digest = sha256,
) -> DataFrame:
    """``ingest`` what is new in ``path``, then the ``decisions`` on all of it."""
    ingest(spark, path, store, files_per_batch, digest).awaitTermination()
    return decisions(spark, path, store, digest)
