"""Publication of batches: what readers see, and that a bad batch leaves nothing."""

import glob
import os

import duckdb
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from docbatch.jobs.batches import published_documents
from docbatch.jobs.catalog import ORACLES
from docbatch.operators.publish import PublishError, document_pages, publication_problems, publish, published_jobs, published_pages

SIGNED = "struct<size:long,mtime_ns:long>"
STATES = {"C": "cover", "A": "attachment", "R": "review"}


def page_rows(sources):
    """source -> (kinds, numbers of its covers)."""
    rows = []
    for source, (kinds, numbers) in sources.items():
        names = iter(numbers)
        rows += [(source, i, next(names) if k == "C" else "", STATES[k], "cover" if i == 1 else "", "blue", (10, 20)) for i, k in enumerate(kinds)]
    return rows


@pytest.fixture
def batch(spark, tmp_path):
    sources = {"a": ("CCAAC", ["N1", "N1", "x/y"]), "b": ("CAAA", ["N1"]), "c": ("RCA", ["N1_02"])}
    pages = spark.createDataFrame(page_rows(sources), f"source string, idx int, number string, effective_state string, decision string, stamp string, source_signature {SIGNED}").repartition(5)
    payload = pages.select("source", "idx", F.encode(F.concat("source", F.repeat(F.lit("é"), F.col("idx"))), "utf-8").alias("content")).repartition(4)
    jobs = spark.createDataFrame([(i, s, "2024-01-05 14:32:08", "T") for i, s in enumerate("abc")], "id long, source string, created string, label string").withColumn("created", F.to_timestamp("created"))
    current = spark.createDataFrame([(s, (10, 20)) for s in "abc"], f"source string, signature {SIGNED}")
    return pages, payload, jobs, current, f"file://{tmp_path}/archive"


def files(root):
    return sorted(f for f in glob.glob(root.removeprefix("file://") + "/**/*", recursive=True) if os.path.isfile(f))


def test_published(spark, batch):
    pages, payload, jobs, current, root = batch
    assert published_jobs(spark, root).count() == 0
    markers = {r["job"]: r for r in publish(pages, payload, jobs, root, current, mode="approved").collect()}
    assert {j: [f["name"] for f in r["files"]] for j, r in markers.items()} == {"0": ["N1", "N1_02", "x_y"], "1": ["N1"], "2": ["N1_02"]}
    assert [(r["source"], r["mode"], r["archive_date"], r["archive_dir"]) for _, r in sorted(markers.items())] == [(s, "approved", "2024-01-05", f"14-32-08_T_00{i + 1}") for i, s in enumerate("abc")]
    size = {"0": {"N1": 3 + 2 * (0 + 2 + 3), "N1_02": 3 + 2 * (1 + 2 + 3), "x_y": 1 + 2 * 4}}
    assert {f["name"]: f["size"] for f in markers["0"]["files"]} == size["0"] and markers["0"]["time"] is not None
    assert all(r["committed"] and r["files"] == len(markers[r["job"]]["files"]) for r in published_jobs(spark, root).collect())
    got = [(r["job"], r["file"], r["page"], r["source"], r["source_page"], bytes(r["content"]).decode()) for r in published_pages(spark, root).orderBy("job", "file", "page").collect()]
    want = {("0", "N1"): [1, 3, 4], ("0", "N1_02"): [2, 3, 4], ("0", "x_y"): [5], ("1", "N1"): [1, 2, 3, 4], ("2", "N1_02"): [2, 3]}
    assert got == [(j, f, n + 1, "abc"[int(j)], p, "abc"[int(j)] + "é" * (p - 1)) for (j, f), own in sorted(want.items()) for n, p in enumerate(own)]
    again = publish(pages, payload, jobs, root, current)
    assert sorted(r["archive_dir"] for r in again.collect()) == [f"14-32-08_T_00{i}" for i in (4, 5, 6)]


def test_each_document_is_one_run_of_one_file(spark, batch, tmp_path):
    _, _, _, _, root = batch
    rows = page_rows({f"s{i}": ("CAACACCA" * 3, [f"D{i % 3}"] * 12) for i in range(20)})
    pages = spark.createDataFrame(rows, f"source string, idx int, number string, effective_state string, decision string, stamp string, source_signature {SIGNED}").repartition(7)
    payload = pages.select("source", "idx", F.lit(b"x").alias("content")).repartition(6)
    jobs = pages.select("source").distinct().select(F.substring("source", 2, 5).cast("long").alias("id"), "source", F.lit("2024-01-05 14:32:08").cast("timestamp").alias("created"), F.lit("T").alias("label"))
    publish(pages, payload, jobs, root, rows_per_file=12)
    seen, in_folder = {}, {}
    for f in [f for f in files(root) if f.endswith(".parquet") and "/pages/" in f]:
        table = pq.ParquetFile(f).read(columns=["job", "file", "page"]).to_pylist()
        last = None
        for r in table:
            key = (r["job"], r["file"])
            if key != last:
                assert key not in seen
                seen[key] = []
            seen[key].append(r["page"])
            last = key
        in_folder.setdefault(os.path.dirname(f), []).append(len(table))
    assert len(seen) == 20 * 12 and all(p == list(range(1, len(p) + 1)) for p in seen.values())
    assert all(len(n) <= 1 + sum(n) // 12 for n in in_folder.values())


@pytest.mark.parametrize("fault", ["lost", "twice", "changed", "gone", "no_job_pages", "two_jobs", "no_documents", "no_name"])
def test_a_bad_batch_leaves_nothing(spark, batch, fault):
    pages, payload, jobs, current, root = batch
    publish(pages.where("source = 'b'"), payload, jobs.where("source = 'b'"), root)
    before = files(root)
    if fault == "lost":
        payload = payload.where("NOT (source = 'a' AND idx = 3)")
    elif fault == "twice":
        payload = payload.unionByName(payload.where("source = 'c' AND idx = 2"))
    elif fault == "changed":
        current = current.withColumn("signature", F.when(F.col("source") == "b", F.struct(F.lit(10).cast("long").alias("size"), F.lit(21).cast("long").alias("mtime_ns"))).otherwise(F.col("signature")))
    elif fault == "gone":
        current = current.where("source <> 'a'")
    elif fault == "no_job_pages":
        pages = pages.where("source <> 'a'")
    elif fault == "two_jobs":
        jobs = jobs.unionByName(jobs.where("source = 'a'"))
    elif fault == "no_documents":
        pages = pages.withColumn("effective_state", F.when(F.col("source") == "b", "review").otherwise(F.col("effective_state")))
    else:
        pages = pages.withColumn("number", F.when((F.col("source") == "b") & (F.col("number") != ""), " . ").otherwise(F.col("number")))
    with pytest.raises(Exception) as e:
        publish(pages, payload, jobs, root, current)
    assert isinstance(e.value, PublishError) or fault == "no_name"
    assert files(root) == before and {r["job"] for r in published_jobs(spark, root).where("committed").collect()} == {"1"}


def test_what_appears_while_writing_stops_the_batch(spark, batch, monkeypatch):
    """The gate passes, and the count of what is on disk still finds the lost and the doubled page."""
    pages, payload, jobs, current, root = batch
    monkeypatch.setattr("docbatch.operators.publish.publication_problems", lambda *a, **k: spark.createDataFrame([], "source string, problem string, n_pages long"))
    for bad in (payload.where("NOT (source = 'a' AND idx = 3)"), payload.unionByName(payload.where("source = 'c' AND idx = 2")), payload.where("NOT (source = 'b' AND idx = 1)").unionByName(payload.where("source = 'b' AND idx = 2"))):
        with pytest.raises(PublishError, match="differ"):
            publish(pages, bad, jobs, root, current)
        assert files(root) == []


def test_unmarked_and_damaged_jobs_are_not_read(spark, batch):
    pages, payload, jobs, current, root = batch
    publish(pages, payload, jobs, root, current, batch="b1")
    publish(pages, payload, jobs.withColumn("id", F.col("id") + 10), root, current, batch="b2")
    for f in files(f"{root}/markers/batch=b2"):
        os.remove(f)  # as if the driver had stopped before the markers
    for f in [f for f in files(root) if "/batch=b1/" in f and "T_002" in f and "/pages/" in f]:
        os.remove(f)
    assert {r["job"]: r["committed"] for r in published_jobs(spark, root).collect()} == {"0": True, "1": False, "2": True}
    assert {r["job"] for r in published_pages(spark, root).select("job").distinct().collect()} == {"0", "2"}


def test_null_signature_and_content(spark, batch):
    pages, payload, jobs, current, root = batch
    pages = pages.withColumn("source_signature", F.lit(None).cast(SIGNED)).withColumn("extra", F.lit(1))
    payload = payload.withColumn("content", F.when(F.col("idx") > 0, F.col("content"))).withColumn("page", F.lit("clash"))
    assert publication_problems(pages, payload, current.limit(0)).count() == 0
    assert {f["name"]: f["size"] for r in publish(pages, payload, jobs, root, current.limit(0)).where("job = '1'").collect() for f in r["files"]} == {"N1": 3 * 1 + 2 * 6}
    with pytest.raises(Exception, match="no_pages|several"):
        publish(pages.limit(0), payload, jobs, root)


def test_document_pages_in_order(spark, batch):
    rows = {(r["source"], r["cover_idx"]): r["pages"] for r in document_pages(batch[0]).collect()}
    assert [p["page"] for p in rows["a", 1]] == [2, 3, 4] and rows["a", 1][0].asDict() == {"source": "a", "page": 2, "state": "cover", "manual": True, "stamp": "blue"}
    assert [p["page"] for p in {(r["source"], r["cover_idx"]): r["pages"] for r in document_pages(batch[0], "sequential").collect()}["a", 0]] == [1]


def test_sql(spark):
    path = "/root/testdata/sf0.001"
    got = published_documents(spark, path)
    db = duckdb.connect()
    db.execute(f"CREATE VIEW conversations AS SELECT * FROM '{path}/conversations.parquet'")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES['published_documents']})").fetchall()
    assert sorted(map(tuple, got.collect())) == sorted(want) and want
