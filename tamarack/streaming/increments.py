"""Increments as structured streams: alerts over new postings, run tracking, guarded sync, windowed run counts."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tamarack.operators import alerts as A
from tamarack.operators import ingest as I

#: Fixed by the monitor: a run that has not ended after so long counts as lost.
DEADLINE_SECONDS = 360


def run_available(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    """Drive a stream over what is available now, one batch function at a time."""
    q: StreamingQuery = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
    q.awaitTermination()


def alert_increments(stream: DataFrame, load_alerts: Callable[[], DataFrame], save_alerts: Callable[[DataFrame], None], send: Callable[[DataFrame], DataFrame], as_of: Column, checkpoint: str) -> None:
    """Match each batch of new postings; alerts whose digest `send` reports as sent advance, others are tried again with the next batch.

    send gets the rows of A.newest_of_each and returns the ids (column id) that were sent."""

    def each(batch: DataFrame, _: int) -> None:
        alerts = load_alerts()
        matches = A.match_alerts(batch, alerts, as_of).persist()
        sent = send(A.newest_of_each(matches))
        save_alerts(A.advance(alerts, matches, sent))
        matches.unpersist()

    run_available(stream, each, checkpoint)


def guarded_sync(stream: DataFrame, load: Callable[[], DataFrame], save: Callable[[DataFrame], None], signals: Callable[[], DataFrame], order: str, checkpoint: str) -> None:
    """Apply each batch of read postings to the stored ones under the guard of ingest.sync_policy."""

    def each(batch: DataFrame, _: int) -> None:
        save(I.sync_jobs(load(), batch, signals(), order))

    run_available(stream, each, checkpoint)


def track_runs(events: DataFrame, deadline: int = DEADLINE_SECONDS) -> DataFrame:
    """(sourceId, started, ended, outcome) of each run: success, error, or lost once the watermark passes its deadline.

    events: sourceId, status (running, success or error), startedAt. State is one pending run for each source."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pending, out = (state.get[0] if state.exists else None), []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"sourceId": [key[0]], "started": [pd.Timestamp(pending, unit="us")], "ended": [pd.NaT], "outcome": ["lost"]})
            return
        rows = pd.concat(list(batches)).sort_values(["startedAt", "status"], kind="stable")
        for at, status in zip(rows["startedAt"], rows["status"], strict=True):
            late = pending is not None and at.value // 1000 - pending > deadline * 1_000_000
            if pending is not None and (status == "running" or late):
                out.append((pending, pd.NaT, "lost"))
                pending = None
            if status == "running":
                pending = at.value // 1000
            elif pending is not None:
                out.append((pending, at, status))
                pending = None
        if pending is None:
            if state.exists:
                state.remove()
        else:
            state.update((pending,))
            state.setTimeoutTimestamp(max(pending // 1000 + deadline * 1000, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame({"sourceId": [key[0]] * len(out), "started": [pd.Timestamp(p, unit="us") for p, _, _ in out], "ended": [e for _, e, _ in out], "outcome": [o for _, _, o in out]})

    marked = events.select("sourceId", "status", "startedAt").withWatermark("startedAt", "10 minutes")
    return marked.groupBy("sourceId").applyInPandasWithState(update, "sourceId string, started timestamp, ended timestamp, outcome string", "pending long", "append", GroupStateTimeout.EventTimeTimeout)


def run_counts(events: DataFrame, window: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Runs by status in windows of event time; windows close when the watermark passes."""
    counted = events.withWatermark("startedAt", late).groupBy(F.window("startedAt", window), "status").agg(F.count("*").alias("n"), F.sum("found").alias("found"))
    return counted.select(F.col("window.start").alias("start"), "status", "n", "found")


def stream_table(spark: SparkSession, folder: str, name: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """A table's Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", f"{name}*.parquet").parquet(folder)
