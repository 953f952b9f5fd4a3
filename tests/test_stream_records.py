"""Records assembled from streams against the batch form."""

import os
import time
import uuid

import pytest

from emberlens.sources import lines as S
from emberlens.streaming.records import stream_lines, stream_records

COLUMNS = ["thread_id", "ts_ms", "call_site", "level", "message", "has_stack", "n_continuations"]


@pytest.fixture(autouse=True)
def provider(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(key)
    yield
    spark.conf.set(key, old)


def put(folder, name, text, at):
    path = folder / name
    path.write_text(text)
    os.utime(path, (at, at))


def started(spark, folder, idle_ms, state):
    name = "r" + uuid.uuid4().hex
    d = stream_records(stream_lines(spark, str(folder)), idle_ms)
    return name, d.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(state)).start()


def wait_for(spark, name, n, seconds=40):
    """The table of a stream with timers, which is never done with all that is available."""
    end = time.time() + seconds
    while spark.table(name).count() < n and time.time() < end:
        time.sleep(0.2)
    return spark.table(name).orderBy("log", "seq").collect()


def test_a_record_over_batches_and_files_comes_out_once_and_whole(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    first = "2024-01-01 00:00:00.000 INFO [t1] A:1 first\n  more\n2024-01-01 00:00:01.000 ERROR [t1] B:2 second\n"
    second = "\tat x.Y.z(Y.java:1)\nCaused by: java.lang.Error: no\n"
    third = "  tail\n2024-01-01 00:00:03.000 WARN [t2] C:3 third\n\n2024-01-01 00:00:04.000 INFO [t2] D:4 last\n"
    put(folder, "app.log", first, 1_700_000_000)
    name, q = started(spark, folder, 3_600_000, tmp_path / "state")
    # the second record is open and goes on in other files, in a batch each
    assert [r.message[-5:] for r in wait_for(spark, name, 1)] == ["first"]
    put(folder, "app.1.log", second, 1_700_000_100)
    time.sleep(2)
    assert spark.table(name).count() == 1
    put(folder, "app.2.log", third, 1_700_000_200)
    got = wait_for(spark, name, 4)
    q.stop()
    whole = tmp_path / "whole"
    whole.mkdir()
    put(whole, "app.log", first + second + third, 1_700_000_000)
    want = S.read_records(S.read_lines(spark, str(whole))).orderBy("o2").select(COLUMNS).collect()
    assert [[r[c] for c in COLUMNS] for r in got] == [list(r) for r in want][:-1]
    assert [(r.n_continuations, r.has_stack, r.headless) for r in got][1] == (3, True, False)
    assert got[1].file.endswith("app.log") and len({r.log for r in got}) == 1 and [r.seq for r in got] == list(range(1, len(got) + 1))


def test_silence_closes_a_record_and_nothing_is_lost(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    put(folder, "a.log", "  head of nothing\n2024-01-01 00:00:00.000 INFO [t1] A:1 only\n", 1_700_000_000)
    put(folder, "b.log", "2024-01-01 00:00:00.000 INFO [t1] A:1 other\n  more\n", 1_700_000_000)
    name, q = started(spark, folder, 500, tmp_path / "state")
    wait_for(spark, name, 3)
    put(folder, "a.1.log", "  too late\n2024-01-01 00:00:09.000 INFO [t1] A:1 next\n", 1_700_000_300)
    wait_for(spark, name, 5)
    q.stop()
    got = sorted((r.log.rsplit("/", 1)[1], r.seq, r.message.split()[-1], r.n_continuations, r.headless) for r in spark.table(name).collect())
    assert got == [("a.log", 1, "nothing", 0, True), ("a.log", 2, "only", 0, False), ("a.log", 3, "late", 0, True), ("a.log", 4, "next", 0, False), ("b.log", 1, "other", 1, False)]
