"""The job queue over several batches and restarts, and a paced stream."""

import random
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from brindle.streaming import queue

EVENTS = "job_id string, event string, ts timestamp, worker string, body string, max_attempts int, error string"
T0 = datetime(2024, 1, 1)


@pytest.fixture
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", queue.ROCKSDB)
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def run(spark, at, batches, **options):
    """Each batch in a query of its own: every one after the first is a restart."""
    for rows in batches:
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.mode("append").parquet(f"{at}/in")
        out = queue.job_queue(spark.readStream.schema(EVENTS).parquet(f"{at}/in"), **options)
        q = out.writeStream.format("parquet").option("checkpointLocation", f"{at}/ck").outputMode("append").trigger(availableNow=True).start(f"{at}/out")
        assert q.awaitTermination(180)
    got = defaultdict(list)
    for r in spark.read.parquet(f"{at}/out").orderBy("job_id", "ts").collect():
        got[r.job_id].append((int((r.ts - T0).total_seconds()), r.outcome, r.status, r.attempts, r.worker, r.error))
    return got


def ev(job, event, at, worker=None, body=None, most=None, error=None):
    return (job, event, T0 + timedelta(seconds=at), worker, body, most, error)


def test_attempts_locks_conflicts_and_restarts(rocks, tmp_path):
    batches = [
        [ev("a", "submit", 0, body="x", most=2), ev("a", "claim", 1, "w1"), ev("b", "submit", 0, body="y"), ev(None, "submit", 0), ev("c", "claim", 2, "w1")],
        [ev("a", "claim", 5, "w2"), ev("a", "fail", 6, "w1", error="no disk"), ev("b", "submit", 6, body="y"), ev("b", "submit", 7, body="z"), ev("b", "claim", 8, "w1"), ev("b", "done", 9, "w1")],
        [ev("a", "claim", 20, "w2"), ev("b", "done", 20, "w1")],
        [ev("a", "done", 200, "w2"), ev("b", "claim", 200, "w3")],
        [ev("b", "submit", 5000, body="z")],
    ]
    got = run(rocks, str(tmp_path), batches, lock_seconds=100, keep_seconds=1000)
    assert got["a"] == [
        (0, "queued", "queued", 0, None, None), (1, "running", "running", 1, "w1", None), (5, "refused", "running", 1, "w2", None), (6, "queued", "queued", 1, "w1", "no disk"),
        (20, "running", "running", 2, "w2", None), (120, "failed", "failed", 2, "w2", queue.LOCK_EXPIRED), (200, "stale", "failed", 2, "w2", None),
    ]
    assert got["b"] == [
        (0, "queued", "queued", 0, None, None), (6, "replayed", "queued", 0, None, None), (7, "conflict", "queued", 0, None, None), (8, "running", "running", 1, "w1", None),
        (9, "completed", "completed", 1, "w1", None), (20, "stale", "completed", 1, "w1", None), (200, "refused", "completed", 1, "w3", None), (5000, "queued", "queued", 0, None, None),
    ]
    assert [x[1] for x in got["c"]] == ["unknown"] and set(got) == {"a", "b", "c"}


def test_random_events_in_one_batch_and_in_many_end_alike(rocks, tmp_path):
    r = random.Random(5)
    events = [ev(f"j{r.randrange(6)}", r.choice(["submit", "claim", "claim", "done", "fail"]), 3 * i, r.choice(["w1", "w2"]), r.choice("xy"), 2, "bad") for i in range(150)]
    one = run(rocks, str(tmp_path / "one"), [events], lock_seconds=30, keep_seconds=60)
    many = run(rocks, str(tmp_path / "many"), [events[i : i + 50] for i in range(0, 150, 50)], lock_seconds=30, keep_seconds=60)
    last = T0 + timedelta(seconds=3 * 149 - 60)  # after that timers may be due in one run and not yet in the other
    early = lambda got: {j: [x for x in rows if x[0] < (last - T0).total_seconds()] for j, rows in got.items()}
    assert early(one) == early(many)


def test_no_batch_is_over_its_budget(spark, tmp_path):
    r = random.Random(1)
    sizes = [r.randint(0, 400) for _ in range(90)] + [5000, 1000, 1000]
    rows = spark.createDataFrame(list(enumerate(sizes)), "id int, n int").repartition(4)
    queue.write_paced(rows, ["id"], F.col("n"), 1000, str(tmp_path / "in"))
    seen = []

    def take(df, _):
        seen.append([(x.id, x.n) for x in df.collect()])

    for _ in range(2):  # the second run finds nothing left
        q = queue.read_paced(spark, str(tmp_path / "in"), "id int, n int, stretch string").writeStream.foreachBatch(take).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        assert q.awaitTermination(300)
    assert Counter(x for b in seen for x in b) == Counter(enumerate(sizes))
    assert all(sum(n for _, n in b) <= 1000 or len(b) == 1 for b in seen) and len(seen) <= 2 * (sum(sizes) // 1000 + 1)
