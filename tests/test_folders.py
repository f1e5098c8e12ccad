"""Many small folders: one a job, written and read without work of Spark's own for each."""

import glob
import os
import uuid

import pytest
from docbatch.jobs.batches import published_documents
from docbatch.operators.publish import document_listing, publish, published_jobs, published_pages
from docbatch.sources.shared import read_folders, read_narrow, write_folders
from pyspark.sql import functions as F

VALUES = ["a b", "50%", "x=y+z#", "12", "2024-01-05", "q'[^]{}", None]
NARROW = {"n": "long", "name": "string", "i": "int"}


def tasks(spark, run):
    """How many tasks run takes, and what it gives."""
    group, context = uuid.uuid4().hex, spark.sparkContext
    context.setJobGroup(group, group)
    try:
        out = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    tracker = context.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    return sum(s.numCompletedTasks for s in stages if s), out


def batch(spark, n):
    rows = [(f"s{i}", p, f"N{p % 2}", "cover" if p == 0 else "attachment") for i in range(n) for p in range(3)]
    pages = spark.createDataFrame(rows, "source string, idx int, number string, effective_state string")
    payload = pages.select("source", "idx", F.lit(b"x").alias("content"))
    jobs = pages.select("source").distinct().select(F.substring("source", 2, 5).cast("long").alias("id"), "source", F.lit("2024-01-05 14:32:08").cast("timestamp").alias("created"), F.lit("T").alias("label"))
    return pages, payload, jobs


def test_tasks_dont_grow_with_folders(spark, tmp_path):
    def run(n):
        root = f"file://{tmp_path}/{n}"
        publish(*batch(spark, n), root)
        return published_jobs(spark, root).where("committed").count(), published_pages(spark, root).count()

    (few, got), (many, more) = tasks(spark, lambda: run(40)), tasks(spark, lambda: run(140))
    assert (got, more) == ((40, 120), (140, 420))
    assert many < few + 100


def test_published_documents_opens_folders_outside_its_plan(spark):
    files = published_documents(spark, "/root/testdata/sf0.001").inputFiles()
    assert [f for f in files if "/archive/markers/" in f] and not [f for f in files if "/archive/pages/" in f]


@pytest.mark.parametrize("by", ["tasks", "spark"])
def test_same_folders_as_spark(spark, tmp_path, monkeypatch, by):
    made = [(v, d, i, f"n{i}", bytes([i % 256]) * (i % 7)) for i, (v, d) in enumerate((v, d) for v in VALUES for d in ("x", "y z") for _ in range(5))]
    rows = spark.createDataFrame(made, "v string, d string, n long, name string, content binary").withColumn("i", F.when(F.col("n") % 3 > 0, F.col("n").cast("int")))
    rows = rows.repartition(3, "v", "d").sortWithinPartitions("v", "d", "n")
    if by == "spark":
        monkeypatch.setattr("docbatch.sources.shared._on_disk", lambda *a: None)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")  # folders go over several batches
    try:
        path = f"file://{tmp_path}/a"
        write_folders(rows, path, "v", "d")
        narrow = sorted(map(tuple, read_narrow(spark, path, NARROW, 2).collect()), key=str)
        back = read_folders(spark, path, "v", "d").collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    rows.write.partitionBy("v", "d").parquet(f"file://{tmp_path}/b")
    folders = lambda x: sorted(os.path.relpath(f, tmp_path / x) for f in glob.glob(f"{tmp_path}/{x}/*/*"))
    assert folders("a") == folders("b") and all(len(glob.glob(f"{glob.escape(str(tmp_path / 'a' / f))}/*.parquet")) == 1 for f in folders("a"))
    assert narrow == sorted(((n, name, n if n % 3 else None) for _, _, n, name, _ in made), key=str)
    assert sorted(((r["v"], r["d"], r["n"], r["name"], bytes(r["content"])) for r in back), key=str) == sorted((tuple(r) for r in made), key=str)
    assert not [f for _, _, names in os.walk(tmp_path / "a") for f in names if f.startswith(".part") and not f.endswith(".crc")]


def test_a_damaged_page_is_seen(spark, tmp_path):
    root = f"file://{tmp_path}/archive"
    publish(*batch(spark, 3), root)
    assert document_listing(spark, root).count() == 3
    file = glob.glob(f"{tmp_path}/archive/pages/*/*/*/*.parquet")[0]
    with open(file, "r+b") as f:
        f.seek(40)
        was = f.read(1)
        f.seek(40)
        f.write(bytes([was[0] ^ 255]))
    with pytest.raises(Exception):  # noqa: B017
        document_listing(spark, root).collect()
    with pytest.raises(Exception):  # noqa: B017
        read_folders(spark, f"{root}/pages").collect()
