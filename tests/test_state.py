"""State with timers, failures, stopped queries, statistics."""

import datetime as dt
import random
import time

import pytest
from pyspark.sql import functions as F

from leafmark import schemas
from leafmark.streaming import events, state, statistics

START = dt.datetime(2024, 1, 1)


def written(spark, folder, batches):
    """Event files that a stream takes one at a time, in order."""
    for i, rows in enumerate(batches):
        data = [(k, START + dt.timedelta(seconds=s), user, kind, float(k), None) for k, s, user, kind in rows]
        spark.createDataFrame(data, schemas.EVENTS).coalesce(1).write.mode("append").parquet(folder)
    return lambda n=1: spark.readStream.schema(schemas.EVENTS).option("maxFilesPerTrigger", n).parquet(folder)


def plain_sessions(rows, ttl, until):
    out, by = [], {}
    for _, s, user, _ in sorted(rows, key=lambda r: r[1]):
        by.setdefault(user, []).append(s)
    for user, times in by.items():
        run = [times[0]]
        for t in times[1:] + [float("inf")]:
            if t - run[-1] >= ttl:
                if run[-1] + ttl <= until:
                    out.append((user, run[0], run[-1], len(run)))
                run = []
            run.append(t)
    return sorted(out)


@pytest.mark.parametrize("files", [1, 100])
def test_sessions_do_not_depend_on_batches(spark, tmp_path, files):
    rng = random.Random(3)
    rows = [(i, s, rng.randrange(3), "view") for i, s in enumerate(sorted(rng.randrange(20_000) for _ in range(120)))]
    near = sorted(rows, key=lambda r: r[1] + rng.randrange(50))  # out of order, within what may be late
    read = written(spark, str(tmp_path / "in"), [near[i : i + 40] for i in range(0, 120, 40)])
    with state.store(spark):
        got = events.drain(state.sessions(read(files), 300.0), "s").collect()
    seconds = lambda t: (t - START).total_seconds()
    assert sorted((r.user_id, seconds(r.started_at), seconds(r.last_seen), r.n) for r in got) == plain_sessions(rows, 300, max(r[1] for r in rows) - 60)


def test_many_sessions_of_a_key(spark, tmp_path):
    rows = [(i, 400 * i, 1, "view") for i in range(3000)]
    read = written(spark, str(tmp_path / "in"), [rows])
    began = time.monotonic()
    with state.store(spark):
        got = events.drain(state.sessions(read(), 300.0), "many").collect()
    assert time.monotonic() - began < 30 and len(got) == 2999 and {r.n for r in got} == {1}


def test_failures_over_batches_and_silence(spark, tmp_path):
    rows = [(i, 10 * i, 1, "error") for i in range(5)] + [(5, 60, 1, "view"), (6, 70, 1, "error"), (7, 5000, 1, "error"), (8, 5010, 1, "error"), (9, 5020, None, "error"), (10, 5020, 2, None)]
    read = written(spark, str(tmp_path / "in"), [rows[:3], rows[3:8], rows[8:]])
    with state.store(spark):
        got = events.drain(state.failures(read(1), "error", 2, 4, 1000.0), "f").collect()
    assert sorted((r.user_id, r.event_id, r.outcome) for r in got) == [(1, 1, "breaker"), (1, 3, "breaker"), (1, 3, "threshold"), (1, 8, "breaker")]


def test_setting_of_the_state_store_is_put_back(spark):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    with pytest.raises(KeyError), state.store(spark):
        assert spark.conf.get(name).endswith("RocksDBStateStoreProvider")
        raise KeyError
    assert spark.conf.get(name, None) == before


def test_errors_stop_a_query_and_keep_it_stopped(spark, tmp_path):
    batches = [[(10 * b + i, b, 1, "error" if i < 2 else "view") for i in range(5)] for b in range(4)]
    read, folder = written(spark, str(tmp_path / "in"), batches), f"file://{tmp_path}/out"
    bad = F.col("event_type") == "error"
    for _ in range(2):  # started again it does its last batch again and stops again
        rows, errors, stopped = state.until_errors(read(1), bad, 4, folder)
        assert (rows.count(), errors, stopped) == (10, 4, True)
    rows, errors, stopped = state.until_errors(read(1), bad, 9, f"file://{tmp_path}/whole")
    assert (rows.count(), errors, stopped) == (20, 8, False)


def test_a_query_that_breaks_otherwise_raises(spark, tmp_path):
    read = written(spark, str(tmp_path / "in"), [[(0, 0, 1, "view")]])
    with pytest.raises(Exception, match="no_such"):
        state.until_errors(read(1), F.expr("no_such > 1"), 1, f"file://{tmp_path}/out")


def test_counters_and_queues(spark, tmp_path):
    rows = [(i, i // 4, i % 2, "error" if i % 3 == 0 else "view") for i in range(12)]
    read, counters = written(spark, str(tmp_path / "in"), [rows[:6], rows[6:]]), statistics.Counters()
    spark.streams.addListener(counters)
    try:
        query = statistics.observed(read(1), "bus", errors=F.col("event_type") == "error").writeStream.format("noop").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        told = counters.of(str(query.runId), 60.0)
        with pytest.raises(TimeoutError):
            counters.of("no such run", 0.01)
    finally:
        spark.streams.removeListener(counters)
    assert (told["batches"], told["rows"], told["bus.all"], told["bus.errors"], told["late"], told["running"]) == (2, 12, 12, 4, 0, 0)
    batch = spark.read.schema(schemas.EVENTS).parquet(str(tmp_path / "in"))
    assert sorted(statistics.queues(batch, 1).collect()) == [(0, 6, 3, 3, 1), (1, 6, 3, 3, 1)]
    assert sorted(r.event_id for r in statistics.admitted(batch, 1).collect()) == [0, 1, 4, 5, 8, 9]
    assert statistics.queues(batch.limit(0), 1).isEmpty()
