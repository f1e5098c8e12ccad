"""The persistent queue: initial state, expected statuses, and recovery from the archive after a stop."""

import datetime

import pytest
from pyspark.sql import functions as F

from docbatch.operators.publish import publish, published_jobs
from docbatch.operators.queue import transitions
from docbatch.streaming.jobs import REQUEST, job_stream, recovery_requests, store_statuses, stored_statuses

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(autouse=True)
def rocks(spark):
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def ask(job, minute, target, *expected):
    return (job, datetime.datetime(2024, 1, 1, 0, minute), minute, target, list(expected) or None)


def write(spark, path, rows):
    spark.createDataFrame(rows, REQUEST).coalesce(1).write.json(path)


def advance(spark, tmp_path, queue=None, start="queued"):
    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    assert store_statuses(job_stream(stream, queue, start), f"{tmp_path}/store", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(180)


def now(spark, tmp_path, queue=None):
    return {r["job"]: r["status"] for r in stored_statuses(spark, f"{tmp_path}/store", queue).collect()}


def test_stop_in_the_middle_of_exporting(spark, tmp_path):
    queue = spark.createDataFrame([("1", "queued"), ("2", "queued"), ("3", "queued"), ("4", "review"), ("5", "done")], "job string, status string")
    first = [ask("1", 1, "analyzing"), ask("1", 2, "exporting"), ask("2", 1, "analyzing"), ask("2", 3, "exporting", "analyzing", "review"), ask("3", 1, "analyzing"), ask("4", 1, "dismissed"), ask("4", 2, "exporting"), ask("5", 1, "dismissed"), ask("6", 4, "done")]
    write(spark, f"{tmp_path}/in/1", first)
    advance(spark, tmp_path, queue)
    assert now(spark, tmp_path, queue) == {"1": "exporting", "2": "exporting", "3": "analyzing", "4": "dismissed", "5": "done"}
    # job 1 was published before the stop, job 2 wasn't
    pages = spark.createDataFrame([("s1", 0, "N", "cover")], "source string, idx int, number string, effective_state string")
    jobs = spark.createDataFrame([(1, "s1", "T")], "id long, source string, label string").withColumn("created", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    publish(pages, pages.select("source", "idx", F.lit(b"x").alias("content")), jobs, f"{tmp_path}/archive")
    asked = recovery_requests(stored_statuses(spark, f"{tmp_path}/store", queue), published_jobs(spark, f"{tmp_path}/archive"), "2024-01-01 01:00:00")
    recovered = [tuple(r) for r in asked.collect()]
    assert sorted((r[0], r[3], r[4][0]) for r in recovered) == [("1", "done", "exporting"), ("2", "review", "exporting"), ("3", "queued", "analyzing")]
    write(spark, f"{tmp_path}/in/2", recovered)
    write(spark, f"{tmp_path}/in/2b", recovered)  # asked again: nothing expects these statuses any more
    late = [ask("3", 5, "review", "analyzing"), ask("3", 30, "analyzing"), ask("2", 31, "exporting"), ask("1", 32, "review")]
    late = [(j, ts + datetime.timedelta(hours=2), *rest) for j, ts, *rest in late]
    write(spark, f"{tmp_path}/in/3", late)
    advance(spark, tmp_path, queue)
    got = now(spark, tmp_path, queue)
    assert got == {"1": "done", "2": "exporting", "3": "analyzing", "4": "dismissed", "5": "done"}
    fold = {}
    for start in ("queued", "review", "done"):
        mine = [r["job"] for r in queue.where(F.col("status") == start).collect()]
        rows = spark.createDataFrame([r for r in first + recovered + late if r[0] in mine], REQUEST)
        allowed = transitions(rows.where("expected IS NULL").drop("expected"), start) if not rows.where("expected IS NOT NULL").count() else None
        if allowed is None:
            fixed = {"analyzing": ["queued"], "exporting": ["review", "analyzing"], "review": ["analyzing", "exporting"]}
            rules = F.create_map(*[x for k, v in fixed.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
            allowed = transitions(rows.withColumn("expected", F.coalesce("expected", rules[F.col("target")])), start)
        fold |= {r["job"]: r["status"] for r in allowed.collect()}
    assert fold == got


def test_jobs_begin_when_they_are_queued(spark, tmp_path):
    write(spark, f"{tmp_path}/in/1", [ask("a", 1, "analyzing"), ask("b", 1, "queued"), ask("b", 2, "analyzing"), ask(None, 1, "queued")])
    write(spark, f"{tmp_path}/in/2", [ask("a", 3, "queued"), ask("b", 4, "queued"), ask("a", 5, "dismissed", "queued", "review"), ask("b", 6, "error"), ask("b", 7, "analyzing", "error")])
    advance(spark, tmp_path, start=None)
    assert now(spark, tmp_path) == {"a": "dismissed", "b": "queued"}  # a request for queued takes a job back from its analysis


def test_nothing_stored(spark, tmp_path):
    queue = spark.createDataFrame([("a", "analyzing"), ("b", "done")], "job string, status string")
    statuses = stored_statuses(spark, f"{tmp_path}/store", queue)
    assert {r["job"]: r["status"] for r in statuses.collect()} == {"a": "analyzing", "b": "done"} and stored_statuses(spark, f"{tmp_path}/store").count() == 0
    asked = recovery_requests(statuses, published_jobs(spark, f"{tmp_path}/archive"), "2024-01-01 01:00:00").collect()
    assert [(r["job"], r["target"]) for r in asked] == [("a", "queued")]
