"""Named micro-batches: the common part of all streams."""

from __future__ import annotations

import threading
from collections import Counter
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

UNTIL_CAUGHT_UP = {"availableNow": True}


def start_batches(
    rows: DataFrame,
    checkpoint: str,
    write: Callable[[DataFrame, str], Mapping[str, int] | None],
    trigger: dict = UNTIL_CAUGHT_UP,
    mode: str = "append",
) -> StreamingQuery:
    """Run ``write(batch, batch_name)`` for every micro-batch.

    The name is the query's id, which lives in the checkpoint, and the batch
    number: a replayed batch keeps its name, and a query that starts over with
    an empty checkpoint gets new ones and overwrites nothing.

    ``mode`` is the stream's output mode: with ``"update"`` a batch of an aggregated stream
    holds the groups it changed.

    What ``write`` returns is summed up in ``totals`` of the returned query, over all
    batches of this run; Spark itself remembers the last hundred only.
    """
    totals: Counter[str] = Counter()
    started = threading.Event()
    query_id: list[str] = []

    def on_batch(batch: DataFrame, number: int) -> None:
        started.wait()
        totals.update(write(batch, f"{query_id[0]}-{number:012d}") or {})

    query = (
        rows.writeStream.foreachBatch(on_batch)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
    query.totals = totals
    query_id.append(query.id)
    started.set()
    return query
