"""A job queue as a stateful stream: attempts, locks that expire, terminal failure, and idempotent submission (ST1, ST4).

Events of a job (job_id, event, ts, worker, body, max_attempts, error) come in; what becomes of each goes out, in order:

*   `submit` queues a job. A second one with the same body is `replayed`, with another body a `conflict`; neither changes the job.
*   `claim` starts a queued job for a worker and counts an attempt; a job that runs or has ended is `refused`.
*   `done` ends it; `fail` queues it again, or ends it as `failed` once its attempts are used up. Of a worker that no longer holds the
    lock both are `stale`.
*   A lock that nobody gives back for `lock_seconds` of event time counts as a failure. A job that has ended is forgotten after
    `keep_seconds`, and its id may be submitted anew.

The state is kept by job in the state store, so a restart goes on where the last batch ended. The session's
spark.sql.streaming.stateStore.providerClass must be RocksDB's.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = "job_id string, ts timestamp, outcome string, status string, attempts int, worker string, error string"
_STATE = "status string, attempts int, max_attempts int, fingerprint string, worker string, since long, error string"
#: Events of one moment are taken in this order.
ORDER = {"submit": 0, "done": 1, "fail": 2, "claim": 3}
LOCK_EXPIRED = "the lock has expired"
MAX_ATTEMPTS = 3


def _ms(ts: pd.Timestamp) -> int:
    return ts.value // 1_000_000


def step(job: dict[str, Any] | None, e: dict[str, Any]) -> tuple[dict[str, Any] | None, str]:
    """A job after an event, and the event's outcome; None is no job."""
    if e["event"] == "submit":
        mark = hashlib.sha256((e["body"] or "").encode()).hexdigest()
        if job is not None:
            return job, "replayed" if job["fingerprint"] == mark else "conflict"
        most = MAX_ATTEMPTS if e["max_attempts"] is None else int(e["max_attempts"])
        return {"status": "queued", "attempts": 0, "max_attempts": most, "fingerprint": mark, "worker": None, "since": e["ms"], "error": None}, "queued"
    if job is None:
        return None, "unknown"
    if e["event"] == "claim":
        if job["status"] != "queued" or job["attempts"] >= job["max_attempts"]:
            return job, "refused"
        return {**job, "status": "running", "attempts": job["attempts"] + 1, "worker": e["worker"], "since": e["ms"]}, "running"
    if e["event"] not in ("done", "fail"):
        return job, "unknown"
    if job["status"] != "running" or job["worker"] != e["worker"]:
        return job, "stale"
    if e["event"] == "done":
        return {**job, "status": "completed", "worker": None, "since": e["ms"], "error": None}, "completed"
    status = "failed" if job["attempts"] >= job["max_attempts"] else "queued"
    return {**job, "status": status, "worker": None, "since": e["ms"], "error": e["error"]}, status


class JobQueue(StatefulProcessor):
    def __init__(self, lock_seconds: int, keep_seconds: int):
        self.lock, self.keep = lock_seconds * 1000, keep_seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("job", _STATE)

    def _load(self) -> dict[str, Any] | None:
        return dict(zip((f.split()[0] for f in _STATE.split(", ")), self.state.get())) if self.state.exists() else None

    def _store(self, job: dict[str, Any] | None) -> None:
        """Keeps the job, with one timer: for the lock of one that runs, for the end of one that has ended."""
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if job is None:
            self.state.clear()
            return
        self.state.update(tuple(job.values()))
        if job["status"] != "queued":
            self.handle.registerTimer(job["since"] + (self.lock if job["status"] == "running" else self.keep))

    def _due(self, job: dict[str, Any] | None, now: int) -> tuple[dict[str, Any] | None, list[tuple]]:
        """What time alone has done to a job before an event at `now`."""
        if job is not None and job["status"] == "running" and job["since"] + self.lock <= now:
            ended = {"event": "fail", "worker": job["worker"], "error": LOCK_EXPIRED, "ms": job["since"] + self.lock}
            worker = job["worker"]
            job, outcome = step(job, ended)
            return job, [(ended["ms"], outcome, job["status"], job["attempts"], worker, LOCK_EXPIRED)]
        if job is not None and job["status"] in ("completed", "failed") and job["since"] + self.keep <= now:
            return None, []
        return job, []

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        job, out = self._load(), []
        events = pd.concat(list(rows))
        events["_o"] = events["event"].map(ORDER).fillna(len(ORDER))
        for e in events.sort_values(["ts", "_o", "worker"], kind="stable").to_dict("records"):
            e = {k: None if v is None or v is pd.NaT or v != v else v for k, v in e.items()} | {"ms": _ms(e["ts"])}
            for _ in range(2):  # a lock that has expired may have left an ended job whose time is over, too
                job, due = self._due(job, e["ms"])
                out += due
            job, outcome = step(job, e)
            out.append((e["ms"], outcome, job and job["status"], job and job["attempts"], e["worker"], e["error"]))
        self._store(job)
        yield self._frame(key, out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        job, out = self._due(self._load(), expiredTimerInfo.getExpiryTimeInMs())
        self._store(job)
        yield self._frame(key, out)

    def _frame(self, key: Any, out: list[tuple]) -> pd.DataFrame:
        rows = [(key[0], pd.Timestamp(ms, unit="ms"), *rest) for ms, *rest in out]
        return pd.DataFrame(rows, columns=[f.split()[0] for f in OUTPUT.split(", ")]).astype({"attempts": "Int32"})

    def close(self) -> None:
        pass


def job_queue(events: DataFrame, lock_seconds: int = 900, keep_seconds: int = 86_400, lateness: str = "0 seconds") -> DataFrame:
    """(job_id, ts, outcome, status, attempts, worker, error) of a stream of events. Events without a job or a time are left out."""
    rows = events.where(F.col("job_id").isNotNull() & F.col("ts").isNotNull()).withWatermark("ts", lateness).groupBy("job_id")
    return rows.transformWithStateInPandas(JobQueue(lock_seconds, keep_seconds), OUTPUT, "append", "eventTime")


def write_paced(rows: DataFrame, order: list[str], tokens: Any, budget: int, path: str) -> None:
    """rows as files of at most `budget` tokens each, in order, for a stream that takes a file a trigger (ST8).

    The running total cuts the order into stretches of the budget; a row that lies over a cut is a file of its own, so no file is above
    the budget but one of a single row that is so itself. `read_paced` keeps its place in the checkpoint as any file stream does.
    """
    from pyspark.sql.window import Window

    from brindle.operators.paging import global_rank

    ranked = global_rank(rows.withColumn("_k", tokens.cast("long")), order, "_n")
    block = F.floor((F.col("_n") - 1) / 10_000)
    totals = ranked.groupBy(block.alias("_b")).agg(F.sum("_k").alias("_s"))
    before = F.coalesce(F.sum("_s").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row for 10,000
    inside = F.sum("_k").over(Window.partitionBy("_b").orderBy("_n"))
    ranked = ranked.withColumn("_b", block).join(totals.select("_b", before.alias("_first")), "_b").withColumn("_end", F.col("_first") + inside)
    first, last = F.floor((F.col("_end") - F.col("_k")) / budget), F.floor((F.greatest(F.col("_end"), F.lit(1)) - 1) / budget)
    name = F.format_string("%018d-%d", F.greatest(F.least(first, last), F.lit(0)), F.when(first < last, F.col("_n")).otherwise(F.lit(0)))
    placed = ranked.withColumn("stretch", name).drop("_b", "_first", "_end", "_k")
    placed.repartition("stretch").sortWithinPartitions("stretch", "_n").drop("_n").write.mode("append").partitionBy("stretch").parquet(path)


def read_paced(spark: Any, path: str, schema: Any) -> DataFrame:
    """The files of `write_paced` as a stream, one a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(path)
