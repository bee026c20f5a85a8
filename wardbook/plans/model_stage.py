"""Model calls over many prompts. The one place where Python runs on executors."""

from __future__ import annotations

import math
import posixpath
import time
from collections.abc import Callable, Iterator
from datetime import date

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wardbook import fixed_values as fv
from wardbook.operators.keyed import last_per_key, left_join_unique
from wardbook.session import Folder, drop_folder, shared_folder
from wardbook.streaming.batches import start_batches

Client = Callable[[str, str], str]
"""Takes a prompt and a model name, returns the answer's text or raises."""

PROMPTS_DDL = "prompt_key string, prompt string"
PARTITIONS_DDL = "key_prefix string, answered_on date"
# Hexadecimal digits of the key that name a partition of the store.
PREFIX_DIGITS = 1
# What Spark calls a partition without a value.
NEVER = "__HIVE_DEFAULT_PARTITION__"
ANSWERS_DDL = "prompt_key string, response string, model string, attempts int, error string"


def with_prompt_key(df: DataFrame, prompt: str = "prompt") -> DataFrame:
    """A key by which equal prompts are asked once; null without a prompt."""
    return df.withColumn("prompt_key", F.sha2(F.col(prompt), 256))


def ask(
    prompts: DataFrame,
    client: Client,
    models: list[str],
    tries: int = fv.TRIES_PER_MODEL,
    wait_seconds: float = fv.RATE_LIMIT_WAIT_SECONDS,
    parallel_calls: int | None = None,
) -> DataFrame:
    """One answer row per row of ``(prompt_key, prompt)``.

    The models are tried in order. A rate limit is waited out, longer each time,
    and tried again; any other error moves on to the next model. Any text counts
    as an answer. When all fail, ``response`` is null and ``error`` tells why.
    ``parallel_calls`` limits how many calls run at once.
    """
    marks = fv.RATE_LIMIT_MARKS
    pause = time.sleep

    def call_models(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def answer(prompt: str) -> tuple[str | None, str | None, int, str | None]:
            calls, error = 0, None
            for model in models:
                for attempt in range(1, tries + 1):
                    calls += 1
                    try:
                        text = client(prompt, model)
                        if isinstance(text, str):
                            return text, model, calls, None
                        error = "the model returned no text"
                        break
                    except Exception as failure:  # whatever the client raises
                        error = str(failure)
                        if not any(mark in error for mark in marks):
                            break
                        pause(wait_seconds * attempt)
            return None, None, calls, error

        for batch in batches:
            rows = [(key, *answer(text)) for key, text in zip(batch["prompt_key"], batch["prompt"])]
            names = ["prompt_key", "response", "model", "attempts", "error"]
            yield pd.DataFrame(rows, columns=names)

    todo = prompts.select("prompt_key", "prompt")
    if parallel_calls is not None:
        todo = todo.repartition(parallel_calls)
    return todo.mapInPandas(call_models, ANSWERS_DDL)


def _prefix(key: Column) -> Column:
    return F.substring(key, 1, PREFIX_DIGITS)


def prefixes_of(prompts: DataFrame) -> list[str]:
    """The key prefixes of some prompts, at most 16."""
    found = prompts.dropna(subset=["prompt_key"]).select(_prefix(F.col("prompt_key")).alias("p"))
    return sorted(r["p"] for r in found.distinct().collect())


def answers_in(
    spark: SparkSession,
    store: str,
    prefixes: list[str] | None = None,
    max_age_days: int | None = None,
) -> DataFrame:
    """One answer per prompt key from the table at ``store``, failures left out.

    With ``prefixes``, only the partitions of these are read; with ``max_age_days``, none that
    was answered earlier.
    """
    rows = spark.read.schema(f"{ANSWERS_DDL}, {PARTITIONS_DDL}").parquet(store)
    if prefixes is not None:
        rows = rows.filter(F.col("key_prefix").isin(prefixes))
    if max_age_days is not None:
        rows = rows.filter(F.col("answered_on") >= F.date_sub(F.current_date(), max_age_days))
    given = rows.filter(F.col("response").isNotNull()).drop("key_prefix")
    newest = ["answered_on", "model", "attempts", "response"]
    return last_per_key(given, ["prompt_key"], newest).drop("answered_on")


def forget_answers(spark: SparkSession, store: str, before: date) -> int:
    """Remove the answers given before a day; how many folders that were. Names alone are read."""
    removed = 0
    for step in Folder(spark, store).partitions():
        day = step.rsplit("answered_on=", 1)[-1]
        if day != NEVER and date.fromisoformat(day) < before:
            Folder(spark, posixpath.join(store, step)).delete()
            removed += 1
    return removed


def dealt(batch: DataFrame, calls_per_task: int) -> DataFrame:
    """The rows in as few tasks as can be, none with more than ``calls_per_task``.

    Rows are numbered through, from their place in a task and the sizes of the tasks before
    it, and each stretch of numbers is a task; the driver gets one count per task.
    """
    place = F.monotonically_increasing_id()
    numbered = batch.withColumn("__place", place)
    part = F.shiftright("__place", 33)
    counts = {
        r["part"]: r["n"]
        for r in numbered.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()
    }
    before, total = [], 0
    for key in sorted(counts):
        before.append((key, total))
        total += counts[key]
    tasks = max(1, math.ceil(total / calls_per_task))
    first = batch.sparkSession.createDataFrame(before, "part long, before long")
    rows = numbered.withColumn("part", part).join(first, "part")
    number = F.col("before") + F.col("__place").bitwiseAND(F.lit((1 << 33) - 1))
    task = F.floor(number / calls_per_task).cast("int")
    return rows.select(*batch.columns, task.alias("__task")).repartitionById(tasks, F.col("__task")).drop("__task")


def answer_once(
    spark: SparkSession,
    prompts: DataFrame,
    client: Client,
    models: list[str],
    store: str,
    calls_per_task: int = 500,
    files_per_batch: int = 10_000,
    max_age_days: int | None = None,
    **options,
) -> DataFrame:
    """E1 with memory: ask only what ``store`` does not answer yet.

    Equal prompts are asked once, however many rows share them. Of the store, which lies by
    prefix of the key and by day, only the prefixes of these prompts are read, and the answers
    in them are what is returned. An answer older than ``max_age_days`` is asked for again.

    The open prompts are written in order of their keys and worked off as a stream whose
    batches are dealt out again, so that no task makes more than ``calls_per_task`` calls and
    writes few files: a lost executor repeats the calls of its tasks, a failed job those of
    one batch, and nothing that reads the answers makes a call again.
    """
    empty = spark.createDataFrame([], ANSWERS_DDL)
    empty.write.mode("ignore").parquet(f"{store}/key_prefix={NEVER}/answered_on={NEVER}")
    # The key is a digest of the prompt, so the shuffle needs the key alone.
    given = prompts.select("prompt_key", "prompt").dropna()
    asked = given.groupBy("prompt_key").agg(F.first("prompt").alias("prompt"))
    prefixes = prefixes_of(given)
    known = answers_in(spark, store, prefixes, max_age_days).select("prompt_key")
    open_prompts = asked.join(known, "prompt_key", "left_anti")
    aside = shared_folder(spark, "open-prompts")
    ordered = open_prompts.repartitionByRange("prompt_key").sortWithinPartitions("prompt_key")
    ordered.write.option("maxRecordsPerFile", calls_per_task).parquet(aside)
    stream = spark.readStream.schema(PROMPTS_DDL).option("maxFilesPerTrigger", files_per_batch)

    def write(batch: DataFrame, _: str) -> None:
        found = ask(dealt(batch, calls_per_task), client, models, **options)
        named = found.withColumns(
            {"key_prefix": _prefix(F.col("prompt_key")), "answered_on": F.current_date()}
        )
        named.write.mode("append").partitionBy("key_prefix", "answered_on").parquet(store)

    checkpoint = shared_folder(spark, "open-prompts-checkpoint")
    start_batches(stream.parquet(aside), checkpoint, write).awaitTermination()
    # The answers are stored; the prompts hold patients' words and are not kept.
    drop_folder(spark, aside)
    drop_folder(spark, checkpoint)
    return answers_in(spark, store, prefixes, max_age_days)


def with_readings(
    spark: SparkSession,
    prompts: DataFrame,
    client: Client,
    models: list[str],
    read: Callable[[DataFrame], DataFrame],
    defaults: dict[str, Column],
    store: str | None = None,
    **options,
) -> DataFrame:
    """Rows that carry ``prompt`` and ``prompt_key`` with what their answer says instead.

    ``read`` adds columns from ``response``, once per answer, before the answer
    meets the rows that share it; rows without an answer get the ``defaults``.

    The rows are written to the shared folder first: the calls and the join of
    their answers must see the same prompts, even if documents arrive between. The prompts
    are removed once they are answered.
    """
    asides = [shared_folder(spark, name) for name in ("prompts", "rows")]
    prompts.write.parquet(asides[0])
    rows = spark.read.schema(prompts.schema).parquet(asides[0])
    answers = answer_once(
        spark, rows, client, models, store or shared_folder(spark, "answers"), **options
    )
    readings = read(answers.select("prompt_key", "response")).drop("response")
    bare = rows.drop("prompt")
    bare.write.parquet(asides[1])
    drop_folder(spark, asides[0])
    joined = left_join_unique(
        spark.read.schema(bare.schema).parquet(asides[1]), readings.withColumn("__read", F.lit(True)), ["prompt_key"]
    )
    unread = F.col("__read").isNull()
    return joined.withColumns(
        {name: F.when(unread, value).otherwise(F.col(name)) for name, value in defaults.items()}
    ).drop("__read", "prompt_key")
