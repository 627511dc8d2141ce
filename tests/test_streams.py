"""Streams that run over files to their end, held against the same functions over a batch."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from labelforge.streaming import events as feed

SCHEMA = "id long, user long, time timestamp, value double, decision string"
T0 = datetime.datetime(2024, 5, 1, 8, 0, 0)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Four files in order of time; events of one repeat those of the file before."""
    path = str(tmp_path_factory.mktemp("feed") / "events")
    rows = [(i, i % 5, T0 + datetime.timedelta(minutes=3 * i), float(i), [None, "APPROVE", "CLOSE"][i % 3] if i % 5 < 3 else None) for i in range(120)]
    for k in range(4):
        part = rows[30 * k : 30 * k + 30] + rows[max(30 * k - 5, 0) : 30 * k]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(path)
    return path


def run(spark, frame, tmp_path, mode):
    name = f"out_{mode}_{abs(hash(str(tmp_path)))}"
    query = frame.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", f"file://{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return [tuple(r) for r in spark.table(name).collect()]


def test_windows(spark, folder, tmp_path):
    stream = feed.read_events(spark, folder, SCHEMA, files_per_trigger=1)
    got = run(spark, feed.per_window(stream, "time", "30 minutes"), tmp_path, "complete")
    assert sorted(got) == sorted(tuple(r) for r in feed.per_window(spark.read.parquet(folder), "time", "30 minutes").collect())


def test_sessions_are_given_out_once_they_have_expired(spark, folder, tmp_path):
    stream = feed.read_events(spark, folder, SCHEMA, files_per_trigger=1).where("user != 0 or id < 40")
    got = run(spark, feed.sessions(stream, "time", "user", "40 minutes", late="1 hour"), tmp_path, "append")
    want = [tuple(r) for r in feed.sessions(spark.read.parquet(folder).where("user != 0 or id < 40"), "time", "user", "40 minutes").collect()]
    assert got and set(got) <= set(want)
    assert any(user == 0 for user, _, _ in got) and not any(user == 1 for user, _, _ in got)  # user 0 is idle, user 1 isn't


def test_once_each(spark, folder, tmp_path):
    stream = feed.read_events(spark, folder, SCHEMA, files_per_trigger=1)
    got = run(spark, feed.once_each(stream, "time", "id", late="12 hours").select("id"), tmp_path, "append")
    assert sorted(got) == [(i,) for i in range(120)]


def test_stages_as_state(spark, folder, tmp_path):
    stream = feed.read_events(spark, folder, SCHEMA, files_per_trigger=1)
    got = run(spark, feed.stages(stream, "user", F.col("decision")), tmp_path, "complete")
    assert sorted(got) == sorted(tuple(r) for r in feed.stages(spark.read.parquet(folder), "user", F.col("decision")).collect())
    assert {s for _, s in got} == {"CLOSED", "AI_COMPLETE"}


def test_micro_batches_have_numbers(spark, folder, tmp_path):
    seen = {}
    stream = feed.read_events(spark, folder, SCHEMA, files_per_trigger=8)
    query = feed.keep_current(stream, lambda rows, n: seen.setdefault(n, rows.count()), f"file://{tmp_path}/state", every="1 second")
    query.processAllAvailable()
    query.stop()
    assert sum(seen.values()) == 135 and 0 in seen
