"""Archive, codes and watched folders: SQL on the given tables, small cases, and the stream against the log."""

import duckdb
import pytest

from docbatch.functions.codes import code128_check, code128_text
from docbatch.jobs import review
from docbatch.jobs.archive import QUERIES, WITHOUT_SQL, stable_arrivals
from docbatch.jobs.catalog import ORACLES
from docbatch.operators.archive import committed, recover, saveable_prefix
from docbatch.streaming.watch import stable_file_stream, stable_files
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(set(QUERIES) - WITHOUT_SQL | set(review.QUERIES) - review.WITHOUT_SQL))
def test_sql(spark, name):
    got = (QUERIES | review.QUERIES)[name](spark, SF)
    db = duckdb.connect()
    for t in ("orders", "part", "lineitem", "events", "conversations", "documents"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want


def test_prefix(spark):
    cases = {"a": "CACCACA", "b": "CACCPPP", "c": "PPP", "d": "AAP", "e": "CCAAP"}
    names = {"C": "cover", "A": "attachment", "P": "pending"}
    rows = [(s, i, names[k]) for s, seq in cases.items() for i, k in enumerate(seq)]
    got = saveable_prefix(spark.createDataFrame(rows, "source string, idx int, effective_state string"))
    assert {r["source"]: r["saveable"] for r in got.collect()} == {"a": 7, "b": 2, "c": 3, "d": 0, "e": 0}


def test_recovery(spark):
    markers = spark.createDataFrame([("a", "x", 1), ("b", "x", 1), ("b", "y", 2), ("c", "../x", 1), ("d", None, None)], "job string, name string, size long")
    listing = spark.createDataFrame([("a", "x", 1), ("b", "x", 1), ("b", "y", 3), ("c", "../x", 1)], "job string, name string, size long")
    done = committed(markers, listing)
    assert {r["job"]: r["committed"] for r in done.collect()} == {"a": True, "b": False, "c": False, "d": False}
    jobs = spark.createDataFrame([("a", "exporting"), ("b", "exporting"), ("e", "exporting"), ("f", "analyzing"), ("g", "dismissed")], "job string, status string")
    assert {r["job"]: r["status"] for r in recover(jobs, done).collect()} == {"a": "done", "b": "review", "e": "review", "f": "queued", "g": "dismissed"}


def test_codes(spark):
    rows = [(104, [33, 34]), (103, [33, 98, 65, 33]), (105, [12, 34, 100, 33]), (104, [33, 96]), (105, [102]), (99, [1])]
    df = spark.createDataFrame(rows, "s int, v array<int>")
    got = df.select(code128_text(F.col("s"), F.col("v")).alias("t"), code128_check(F.col("s"), F.col("v")).alias("c")).collect()
    assert [r["t"] for r in got] == ["AB", "AaA", "1234A", None, None, None]
    assert got[0]["c"] == (104 + 33 + 68) % 103


LOG = [("a", 0, 5), ("a", 1, 5), ("a", 2, 6), ("a", 3, 6), ("a", 4, 6), ("a", 5, 6), ("b", 0, 0), ("b", 1, 0), ("b", 2, 0), ("b", 3, 0), ("c", 0, 1), ("c", 2, 1), ("c", 3, 1), ("c", 4, 1)]
STABLE = [("a", 4, 6), ("c", 4, 1)]


def test_stable_log(spark):
    df = spark.createDataFrame([(*r, 0) for r in LOG], "path string, poll long, size long, mtime_ns long")
    assert sorted((r["path"], r["poll"], r["size"]) for r in stable_files(df, 2).collect()) == STABLE
    assert stable_files(df.limit(0), 2).count() == 0


def test_stable_stream(spark, tmp_path):
    schema = "path string, poll long, size long, mtime_ns long"
    for poll in range(6):
        spark.createDataFrame([(*r, 0) for r in LOG if r[1] == poll], schema).coalesce(1).write.mode("append").json(f"{tmp_path}/in/{poll}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 2).option("latestFirst", "false").json(f"{tmp_path}/in/*")
    query = stable_file_stream(stream, 2).writeStream.format("memory").queryName("stable").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    assert query.awaitTermination(60)
    assert sorted((r["path"], r["poll"], r["size"]) for r in spark.table("stable").collect()) == STABLE


def test_arrivals(spark):
    from docbatch.sources.fixtures import file_observations

    log: dict = {}
    for r in file_observations(spark, SF).collect():
        log.setdefault(r["path"], {})[r["poll"]] = r["size"]
    want = []
    for path, polls in log.items():
        given, held, since = set(), None, None
        for p in range(max(polls) + 1):
            if p not in polls:
                held = None
            elif polls[p] in given:
                continue
            elif held != polls[p]:
                held, since = polls[p], p
            elif p - since >= 1 and polls[p]:
                given.add(polls[p])
                want.append((path, p, polls[p]))
    assert sorted((r["path"], r["poll"], r["size"]) for r in stable_arrivals(spark, SF).collect()) == sorted(want) and want
