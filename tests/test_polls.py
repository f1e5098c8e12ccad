"""Watched folders by the clock: the fake-clock cases, the state that goes, and a folder's way into the queue with a restart."""

import random

import pytest

from docbatch.streaming.polls import folder_polls, settled_files
from docbatch.streaming.watch import enqueue_stream, settle

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "poll long, at_ms long, path string, size long, mtime_ns long, watching boolean, complete boolean"


@pytest.fixture(autouse=True)
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def polls(path, *seen):
    """seen: (seconds, size) or (seconds, size, complete), a poll each; None for a poll that lacks the path."""
    return [(n, s[0] * 1000, path, s[1], 0, True, s[2] if len(s) > 2 else True) for n, s in enumerate(seen, 1) if s]


def run(spark, tmp_path, rows, name, per_batch=1, queued=None, **options):
    new = len(rows)
    for poll in sorted({r[0] for r in rows}):
        spark.createDataFrame([r for r in rows if r[0] == poll], SCHEMA).coalesce(1).write.mode("overwrite").json(f"{tmp_path}/in/{poll:03d}")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", per_batch).json(f"{tmp_path}/in/*")
    query = settled_files(stream, queued=queued, **options).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(processingTime="0 seconds").start()
    try:  # timers always give such a stream a next batch, so it doesn't end by itself
        for _ in range(60):
            if sum(p.numInputRows for p in query.recentProgress) >= new:
                break
            query.awaitTermination(1)
        assert query.exception() is None and sum(p.numInputRows for p in query.recentProgress) >= new
    finally:
        query.stop()
    return sorted((r["path"], r["at_ms"] // 1000, r["size"]) for r in spark.table(name).collect())


def test_fake_clock(spark, tmp_path):
    rows = polls("grows", (0, 5), (2, 5), (3, 6), (5, 6), (6, 6), (100, 6))
    rows += polls("empty", (0, 0), (2, 0), (3, 0), (5, 0), (6, 0))
    rows += polls("broken", (0, 1, False), (4, 1, False), (5, 9), (9, 9), (10, 9))
    rows += polls("slow", (0, 1), (4, 1, False), (6, 1), (7, 1), (9, 1))
    rows += polls("missed", (0, 3), (2, 3), None, (5, 3), (7, 3), (8, 3))
    rows += [(n, at * 1000, "off", 4, 0, n != 2, True) for n, at in enumerate((0, 2, 4, 6, 8), 1)]
    want = [("broken", 9, 9), ("grows", 6, 6), ("missed", 8, 3), ("off", 8, 4), ("slow", 7, 1)]
    assert run(spark, tmp_path, rows, "clock", per_batch=2) == want
    pure = {p: settle([r[:2] + r[3:] for r in rows if r[2] == p], None, 3000)[0] for p in {r[2] for r in rows}}
    assert sorted((p, o[1] // 1000, o[2]) for p, out in pure.items() for o in out) == want


def test_random_polls_against_a_plain_loop():
    rnd = random.Random(3)
    for _ in range(400):
        held, known, want, rows, at = None, set(), [], [], 0
        for poll in range(1, 30):
            at += rnd.choice([1, 1, 2, 3])
            watching, there = rnd.random() > 0.05, rnd.random() > 0.1
            size, complete = rnd.choice([0, 1, 1, 2]), rnd.random() > 0.2
            if not watching or not there:
                held = None
                if there:
                    rows.append((poll, at, size, 0, watching, complete))
                continue
            rows.append((poll, at, size, 0, True, complete))
            if size in known:
                continue
            if held is None or held[0] != size:
                held = [size, at]
            elif at - held[1] >= 3 and size:
                if complete:
                    known.add(size)
                    want.append((poll, at, size, 0))
                else:
                    held[1] = at
        # whatever the batches, the same comes out
        state, got = None, []
        while rows:
            n = rnd.randrange(1, 6)
            out, state = settle(rows[:n], state, 3)
            got, rows = got + out, rows[n:]
        assert got == want


def test_queued_files_are_known_from_the_start(spark, tmp_path):
    queued = spark.createDataFrame([("a", 5, 0), ("a", 6, 0)], "path string, size long, mtime_ns long")
    rows = polls("a", (0, 5), (4, 5), (5, 7), (9, 7)) + polls("b", (0, 5), (4, 5))
    assert run(spark, tmp_path, rows, "known", queued=queued) == [("a", 9, 7), ("b", 4, 5)]


@pytest.mark.parametrize("forget_ms,out", [(1, []), (600_000, [(4000, 5)])])
def test_clock_of_an_absent_path_goes(spark, tmp_path, forget_ms, out):
    """A timer ends it, so the path's next poll is its first again."""
    stream = spark.readStream.schema(SCHEMA).json(f"{tmp_path}/in/*")
    name = f"gone{forget_ms}"
    (tmp_path / "in" / "0").mkdir(parents=True)

    def read(at, rows):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.json(f"{tmp_path}/in/{at}")

    def until(holds):
        for _ in range(60):
            if holds():
                return
            assert query.exception() is None
            query.awaitTermination(1)
        raise AssertionError(query.lastProgress)

    query = settled_files(stream, forget_ms=forget_ms).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(processingTime="0 seconds").start()
    seen = lambda: sum(p.numInputRows for p in query.recentProgress)
    try:
        for poll, row in enumerate(polls("a", (0, 5), (4, 5)), 1):
            read(poll, [row])
            until(lambda n=poll: seen() >= n)
            last = query.lastProgress.batchId
            until(lambda n=last: query.lastProgress.batchId > n + 1)
    finally:
        query.stop()
    assert [(r["at_ms"], r["size"]) for r in spark.table(name).collect()] == out


def test_from_folder_to_queue_with_a_restart(spark, tmp_path):
    first, second = tmp_path / "in1", tmp_path / "in2"
    first.mkdir()
    second.mkdir()
    (first / "a.pdf").write_bytes(b"x" * 5000 + b"%%EOF\n")
    (first / "note.txt").write_bytes(b"%%EOF")
    (second / "B.PDF").write_bytes(b"cut off")
    queue, log, ck = f"{tmp_path}/queue", f"file://{tmp_path}/log", f"{tmp_path}/ck"

    def watching():
        files = settled_files(folder_polls(spark, [str(first), str(second), str(tmp_path / "none")], log, every_ms=100), stable_ms=300)
        return enqueue_stream(files, queue, ck).trigger(processingTime="200 milliseconds").start()

    def jobs():
        try:
            return sorted((r["path"].rsplit("/", 1)[1], r["label"], r["status"]) for r in spark.read.parquet(queue).collect())
        except Exception:
            return []

    def until(query, want):
        for _ in range(120):
            if jobs() == want:
                break
            assert query.exception() is None
            query.awaitTermination(1)
        assert jobs() == want

    query = watching()
    until(query, [("a.pdf", "Tarama_1", "queued")])
    query.stop()
    (second / "B.PDF").write_bytes(b"now whole %%EOF")
    query = watching()
    until(query, [("B.PDF", "Tarama_2", "queued"), ("a.pdf", "Tarama_1", "queued")])
    n = query.lastProgress.batchId
    for _ in range(60):
        if query.lastProgress.batchId > n + 3:
            break
        query.awaitTermination(1)
    query.stop()
    assert len(jobs()) == 2
