"""Label widths, rejected and found files, and the streams of the queue."""

import random

from docbatch.functions.codes import LETTERS, STOP, WIDTHS, code39_label, code39_letter, code128_label, code128_symbol
from docbatch.operators.archive import list_pages, list_rejects
from docbatch.sources.files import discover_files
from docbatch.streaming.watch import enqueue, enqueue_stream, stable_file_stream, stable_files, status_stream
from pyspark.sql import functions as F


def test_tables():
    assert len(WIDTHS) == len(set(WIDTHS)) == 106 and all(sum(map(int, w)) == 11 and sum(map(int, w[::2])) % 2 == 0 for w in WIDTHS)
    assert len(LETTERS) == len(set(LETTERS.values())) == 44 and all(w.count("w") == 3 for w in LETTERS.values())


def nearest(widths, start):
    first = 103 if start else 0
    scaled = [w * 11 / sum(widths) for w in widths]
    best = min((sum((a - int(c)) ** 2 for a, c in zip(scaled, s, strict=True)) / 6, i + first) for i, s in enumerate(WIDTHS[first:]))
    return best[1] if sum(widths) >= 8 and best[0] <= 0.22 else None


def test_symbols(spark):
    rnd = random.Random(4)
    rows = [[float(c) * 3 + rnd.uniform(-1.5, 1.5) for c in rnd.choice(WIDTHS)] for _ in range(300)] + [[0.5] * 6, [1.0] * 6, [2.0, 2.0]]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, w array<double>").orderBy("i")
    for start in (False, True):
        got = [r[0] for r in df.select(code128_symbol(F.col("w"), start)["value"]).collect()]
        assert got == [nearest(r, start) if len(r) == 6 else None for r in rows] and None in got and len(set(got)) > 3


def label(text, scale=2.0):
    values = [104, *[ord(c) - 32 for c in text]]
    values.append((104 + sum(i * v for i, v in enumerate(values[1:], 1))) % 103)
    return [[float(c) * scale for c in WIDTHS[v]] for v in values] + [[float(c) * scale for c in STOP]]


def test_labels(spark):
    good = label("RR12 x")
    wide = [*good[:2], [w * 1.6 for w in good[2]], *good[3:]]
    start_inside = [*good[:2], good[0], *good[2:]]
    wrong = [*good[:2], good[3], good[2], *good[4:]]
    rows = [good, label("A", 5.0), wide, start_inside, wrong, good[:-1], good[1:], [], None]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, s array<array<double>>").orderBy("i")
    assert [r[0] for r in df.select(code128_label(F.col("s"))).collect()] == ["RR12 x", "A"] + [None] * 7


def test_code39(spark):
    word = lambda t, n=2.0, w=5.0: [[w if x == "w" else n for x in LETTERS[c]] for c in t]
    rows = [word("*AB-7*"), word("*A*", 3.0, 9.0), word("*A*", 3.0, 12.0), word("*A*", 3.0, 4.0), word("A*"), word("**"), word("*A*B*"), [*word("*A"), [2.0] * 9, *word("*")], [[0.0] * 9] * 3, [], None]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, s array<array<double>>").orderBy("i")
    got = [r[0] for r in df.select(code39_label(F.col("s"))).collect()]
    assert [g and g["text"] for g in got] == ["AB-7", "A"] + [None] * 9 and got[0]["score"] == 1.0
    off = spark.createDataFrame([([2.0, 2.0, 2.0, 5.0, 5.0, 2.5, 5.0, 1.5, 2.0],)], "w array<double>").select(code39_letter(F.col("w")).alias("x")).first()["x"]
    assert off["letter"] == "0" and abs(off["score"] - (1 - 0.25 / 2)) < 1e-9


def test_files(spark, tmp_path):
    files = spark.createDataFrame([("a.pdf", 2, 9, 1), ("b.PDF", 0, 9, 1), ("c.pdf", 5001, 9, 1), ("d.txt", 1, 9, 1), ("e.pdf", None, 9, 1)], "path string, n_pages int, size long, mtime_ns long")
    assert sorted((r["source"], r["idx"], tuple(r["source_signature"])) for r in list_pages(files).collect()) == [("a.pdf", 0, (9, 1)), ("a.pdf", 1, (9, 1))]
    assert sorted((r["path"], r["reason"]) for r in list_rejects(files).collect()) == [("b.PDF", "no_pages"), ("c.pdf", "too_many_pages"), ("e.pdf", "no_pages")]
    (tmp_path / "sub").mkdir()
    for name, text in (("x.pdf", "12"), ("y.txt", "1"), ("sub/z.PDF", "123")):
        (tmp_path / name).write_text(text)
    named = lambda df: sorted((r["path"].rsplit("/", 1)[1], r["size"]) for r in df.collect())
    assert named(discover_files(spark, str(tmp_path))) == [("x.pdf", 2), ("z.PDF", 3)] and named(discover_files(spark, str(tmp_path), deep=False)) == [("x.pdf", 2)]


def test_watching(spark):
    # path, poll, size, watching, queued
    log = [("a", p, 5, p != 2, True) for p in range(6)] + [("b", p, 5, True, p != 2) for p in range(6)] + [("c", p, 5, True, False) for p in range(6)]
    df = spark.createDataFrame([(*r, 0) for r in log], "path string, poll long, size long, watching boolean, enqueue_ok boolean, mtime_ns long")
    assert sorted((r["path"], r["poll"]) for r in stable_files(df, 2).collect()) == [("a", 5), ("b", 4)]


def test_queue_streams(spark, tmp_path):
    schema = "path string, poll long, size long, mtime_ns long"
    for poll in range(4):
        spark.createDataFrame([("a", poll, 5, 0), ("b", poll, poll, 0)], schema).coalesce(1).write.json(f"{tmp_path}/in/{poll}")
    files = stable_file_stream(spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).json(f"{tmp_path}/in/*"), 2)
    for _ in range(2):
        assert enqueue_stream(files, f"{tmp_path}/queue", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(60)
    queue = spark.read.parquet(f"{tmp_path}/queue")
    assert [(r["path"], r["status"]) for r in queue.collect()] == [("a", "queued")]
    again = spark.createDataFrame([("a", 5, 0), ("c", 1, 0), ("c", 1, 0)], "path string, size long, mtime_ns long")
    enqueue(again, f"{tmp_path}/queue")
    enqueue(again, f"{tmp_path}/queue")
    assert sorted(r["path"] for r in spark.read.parquet(f"{tmp_path}/queue").collect()) == ["a", "c"]


def test_forgotten_paths(spark, tmp_path):
    """A path's state goes when nothing of it came for a while; the batches after that run without an error."""
    schema = "path string, poll long, size long, mtime_ns long"
    spark.createDataFrame([("a", p, 5, 0) for p in range(3)], schema).coalesce(1).write.json(f"{tmp_path}/in/0")
    stream = spark.readStream.schema(schema).json(f"{tmp_path}/in/*")
    query = stable_file_stream(stream, 2, 1).writeStream.format("memory").queryName("forgotten").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(processingTime="0 seconds").start()
    try:
        for _ in range(60):
            progress = query.lastProgress
            if progress and progress.stateOperators and progress.batchId >= 1 and progress.stateOperators[0].numRowsTotal == 0:
                break
            query.awaitTermination(1)
        assert query.lastProgress.stateOperators[0].numRowsTotal == 0 and query.exception() is None
    finally:
        query.stop()
    assert [r["poll"] for r in spark.table("forgotten").collect()] == [2]


def test_status_stream(spark, tmp_path):
    rows = [("j", 1, 1, "analyzing"), ("j", 2, 2, "done"), ("j", 3, 3, "error"), ("k", 1, 4, "dismissed"), ("k", 2, 5, "analyzing")]
    for r in rows:
        spark.createDataFrame([r], "job string, ts long, event_id long, target string").selectExpr("job", "timestamp_seconds(ts) ts", "event_id", "target").coalesce(1).write.json(f"{tmp_path}/in/{r[2]}")
    stream = spark.readStream.schema("job string, ts timestamp, event_id long, target string").json(f"{tmp_path}/in/*")
    query = status_stream(stream).writeStream.format("memory").queryName("statuses").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert sorted((r["job"], r["event_id"], r["status"]) for r in spark.table("statuses").collect()) == [("j", 1, "analyzing"), ("j", 3, "error"), ("k", 4, "dismissed")]
