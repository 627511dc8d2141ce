"""Windows, sessions and state over event feeds. Each function takes a batch or a streaming DataFrame with a TIMESTAMP column."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from datetime import timedelta

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState


def read_events(spark, path: str, schema: str, files_per_trigger: int = 8) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def per_window(events: DataFrame, time: str, length: str, by: Sequence[str] = (), slide: str | None = None, late: str = "10 minutes", value: str = "value") -> DataFrame:
    """Count and sum per tumbling or sliding window; a stream closes a window when the watermark passes it."""
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = timed.groupBy(F.window(time, length, slide), *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"))
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), *by, "n", "total")


def sessions(events: DataFrame, time: str, by: str, gap: str, late: str = "10 minutes") -> DataFrame:
    timed = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    out = timed.groupBy(F.session_window(time, gap), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("session_window.start").cast("timestamp_ntz").alias("session_start"), "n")


def once_each(events: DataFrame, time: str, key: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark; in a batch, of all."""
    timed = events.withColumn(time, F.col(time).cast("timestamp"))
    if not events.isStreaming:
        return timed.dropDuplicates([key])
    return timed.withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def stage_of(decisions: Column, start: str = "AI_COMPLETE") -> Column:
    """The stage after decisions in order: the first one opens the review, CLOSE ends it."""
    step = lambda stage, d: F.when(d == "CLOSE", "CLOSED").when((stage == start) & d.isNotNull(), "UNDER_REVIEW").otherwise(stage)
    return F.aggregate(decisions, F.lit(start), step)


def stages(events: DataFrame, key: str, decision: Column) -> DataFrame:
    """The stage of each key by stage_of(), which doesn't depend on the decisions' order: two counts a key, no arrays."""
    n = events.groupBy(key).agg(F.count_if(decision == "CLOSE").alias("closing"), F.count(decision).alias("any"))
    return n.select(key, F.when(F.col("closing") > 0, "CLOSED").when(F.col("any") > 0, "UNDER_REVIEW").otherwise("AI_COMPLETE").alias("stage"))


def keep_current(stream: DataFrame, recompute: Callable[[DataFrame, int], None], checkpoint: str, every: str = "60 seconds"):
    """Calls `recompute` with every micro-batch; a batch that is repeated after a failure has the same number."""
    return stream.writeStream.foreachBatch(recompute).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()


def code_attempts(stream: DataFrame, key: str, id_: str, time: str, issued: Column, right: Column, lifetime: timedelta, most: int = 5, keep: timedelta = timedelta(days=30)) -> DataFrame:
    """(event_id, owner, status) of the tries of single-use codes as a stream: for each owner the open code's issue, its tries and
    whether it was used are state between micro-batches, whose events must come in order of time. State untouched for `keep`
    goes, so owners who never come back cost nothing (a query that is to end with its input needs
    spark.sql.streaming.noDataMicroBatches.enabled off, as it would wait for these timeouts). `products.code_attempts` gives the same over a whole table. Rows without
    a key have no owner and go."""
    rows = stream.select(F.col(key).alias("owner"), F.col(id_).alias("event_id"), F.col(time).cast("timestamp").alias("at"), F.coalesce(issued, F.lit(False)).alias("issued"), F.coalesce(right, F.lit(False)).alias("right"))
    types = {f.name: f.dataType.simpleString() for f in rows.schema}

    def judge(owner: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        since, tries, used = state.get if state.exists else (None, 0, False)
        own, out = pd.concat(list(batches)).sort_values(["at", "event_id"], kind="stable"), []
        for event_id, at, is_issue, is_right in zip(own["event_id"], own["at"], own["issued"], own["right"], strict=True):
            if is_issue:
                since, tries, used = at.to_pydatetime(), 0, False
                continue
            gone = since is None or used or tries >= most or at - since > lifetime
            out.append((event_id, "EXPIRED" if gone else "ACCEPTED" if is_right else "WRONG"))
            tries, used = tries + 1, used or bool(is_right)
        if since is not None:
            state.update((since, tries, used))
            state.setTimeoutDuration(int(keep.total_seconds() * 1000))
        yield pd.DataFrame({"event_id": [x[0] for x in out], "owner": [owner[0]] * len(out), "status": [x[1] for x in out]})

    schema = f"event_id {types['event_id']}, owner {types['owner']}, status string"
    return rows.where("owner is not null").groupBy("owner").applyInPandasWithState(judge, schema, "since timestamp, tries long, used boolean", "append", "ProcessingTimeTimeout")
