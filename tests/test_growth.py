"""Steps whose shuffles and memory grew faster than they need to, against plain ones."""

import random

from docbatch.jobs import archive as archive_jobs
from docbatch.jobs import review as review_jobs
from docbatch.operators.review import first_page_stop, stop_counts
from docbatch.sources.shared import dealt
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().sparkPlan().toString(), frame._jdf.queryExecution().toString()


def test_dealt_by_rows(spark):
    rows = spark.range(1000)
    assert dealt(rows, "id", rows_per_task=10).rdd.getNumPartitions() == 100
    assert sorted(r[0] for r in dealt(rows, "id", rows_per_task=10).collect()) == list(range(1000))


def test_stamp_readings_shuffle_once_before_masks(spark):
    text = plan(review_jobs.stamp_readings(spark, SF))[1].split("== Physical Plan ==")[1]
    assert text.count("Exchange") == 1 and text.index("Generate") < text.index("Exchange")  # plans read from the end
    assert text.count("+- Sort ") + text.count("- Sort [") <= 2


def test_committed_without_join(spark):
    assert "Join" not in plan(archive_jobs.committed_jobs(spark, SF))[0]


def test_stop_counts_against_pages(spark):
    rnd = random.Random(3)
    rows = [(w, o, i, rnd.choice(["cover", "pending", "attachment"]), rnd.choice([True, None, *[False] * 20])) for w in (1, 2, 3, None) for o in (1, 2, 3) for i in range(6) for _ in range(rnd.randrange(1, 3))]
    pages = spark.createDataFrame(rows, "workspace long, source_ord long, idx int, state string, first_page_error boolean")
    want = first_page_stop(pages).groupBy("workspace").agg(F.count("*").alias("pages"), F.count_if(F.col("state") == "pending").alias("pending"))
    assert sorted(map(tuple, stop_counts(pages).collect())) == sorted(map(tuple, want.collect()))
    assert "Join" not in plan(review_jobs.stopped_pages(spark, SF))[0]
