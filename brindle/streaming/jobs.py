"""Streaming counterparts: rate windows, idempotency, queue, expiry, ordered events; windows over events as an extension."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_files(spark: SparkSession, path: str, schema, max_files: int = 64) -> DataFrame:
    """A folder as a stream; max_files paces what one trigger takes (ST8)."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def rate_windows(events: DataFrame, subject: str, limit: int, lateness: str = "5 minutes") -> DataFrame:
    """Subjects above a limit in a minute (ST2)."""
    counts = events.withWatermark("ts", lateness).groupBy(F.window("ts", "1 minute").alias("w"), subject).agg(F.count(F.lit(1)).alias("n"))
    return counts.where(F.col("n") > limit).select(subject, F.col("w.start").alias("minute"), "n")


def once(events: DataFrame, key: list[str], ttl: str = "24 hours") -> DataFrame:
    """Events whose key didn't come within the time to live (ST4)."""
    return events.withWatermark("ts", ttl).dropDuplicatesWithinWatermark(key)


def gauges(events: DataFrame) -> DataFrame:
    """Backlog by kind, for a complete-mode sink (ST7)."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last"))


def tumbling(events: DataFrame, width: str = "1 hour", slide: str | None = None, lateness: str = "1 hour") -> DataFrame:
    """Extension: tumbling or sliding windows by type."""
    w = F.window("ts", width, slide).alias("w")
    return events.withWatermark("ts", lateness).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("value")).select(F.col("w.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", lateness: str = "1 hour") -> DataFrame:
    """Extension: sessions of a user by gap; the engine's own sessions go by key (ST6)."""
    rows = events.withWatermark("ts", lateness).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def expire(activity: DataFrame, days: int) -> DataFrame:
    """(store_id, state): each store's end of life, put off by every activity (ST3): a timer on event time."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"store_id": [key[0]], "state": ["expired"]})
            return
        last = max([b["ts"].max() for b in batches] + ([pd.Timestamp(state.get[0], unit="ms")] if state.exists else []))
        ms = int(last.timestamp() * 1000)
        state.update((ms,))
        state.setTimeoutTimestamp(max(ms + days * 86_400_000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"store_id": [key[0]], "state": ["active"]})

    rows = activity.withWatermark("ts", "1 hour").groupBy("store_id")
    return rows.applyInPandasWithState(step, "store_id long, state string", "last long", "append", GroupStateTimeout.EventTimeTimeout)


def worker(jobs: DataFrame, path: str, work: Callable[[DataFrame], DataFrame], key: str, checkpoint: str):
    """Job files worked off at least once, written once: a batch replaces its own folder if it comes again (ST1)."""

    def batch(df: DataFrame, n: int) -> None:
        work(df.dropDuplicates([key])).write.mode("overwrite").parquet(f"{path}/batch={n}")

    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def response_events(responses: DataFrame, text: str = "text", size: int = 64) -> DataFrame:
    """(response_id, seq, event, delta): created, deltas of the text, completed, in order (ST5)."""
    n = F.ceil(F.length(text) / size).cast("int")
    parts = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.substring(F.col(text), i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))
    one = lambda name, delta: F.struct(F.lit(name).alias("event"), delta.alias("delta"))
    none = F.lit(None).cast("string")
    events = F.concat(F.array(one("response.created", none)), F.transform(parts, lambda p: one("response.output_text.delta", p)), F.array(one("response.completed", none)))
    return responses.select("response_id", F.posexplode(events).alias("seq", "e")).select("response_id", "seq", "e.event", "e.delta")


def resume_after(events: DataFrame, seq: int) -> DataFrame:
    return events.where(F.col("seq") > seq)


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there into a memory table, for tests and small reports."""
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(name)
