"""Workspaces of many sources: IDs, summaries, problems, what can be saved, pauses; order over whole tables."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from docbatch.jobs import batches
from docbatch.jobs.catalog import ORACLES
from docbatch.operators.grouping import page_ids, workspace_problems, workspace_summary
from docbatch.operators.order import places

SF = "/root/testdata/sf0.01"
STATES = {"C": "cover", "N": "cover", "A": "attachment", "R": "review", "P": "pending"}
TABLES = ("conversations", "documents", "events", "part", "lineitem", "orders")


@pytest.mark.parametrize("name", sorted(set(batches.QUERIES) - {"published_documents"}))
def test_sql(spark, name):
    got = batches.QUERIES[name](spark, SF)
    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = db.execute(f"SELECT {', '.join(got.columns)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and want


def frame(spark, spaces, **extra):
    """spaces: workspace -> sources -> kinds; N is a cover without a number."""
    rows = [(w, o, s, i, "" if k in "N" else f"n{i}", STATES[k]) for w, sources in spaces.items() for o, (s, kinds) in enumerate(sources) for i, k in enumerate(kinds)]
    df = spark.createDataFrame(rows, "workspace string, source_ord int, source string, idx int, number string, effective_state string").repartition(5)
    return df.withColumns({c: F.expr(e) for c, e in extra.items()})


def problems(df):
    return {r["workspace"]: (r["problem"], r["n_pages"], r["page_ids"], r["truncated"]) for r in workspace_problems(df).collect()}


def test_problems_list_workspace_ids(spark):
    spaces = {
        "ready": [("a", "CA"), ("b", "CCA")], "pending": [("a", "CAR"), ("b", "CAPP")], "review": [("b", "CA"), ("a", "RCN"), ("c", "R")], "number": [("a", "CA"), ("b", "NA")],
        "loose": [("a", "C"), ("b", "AAAA"), ("c", "AAAAAAA")], "none": [("a", "A")], "last": [("z", "CA"), ("a", "CA"), ("m", "R")],
    }
    assert problems(frame(spark, spaces)) == {
        "ready": ("", 0, "", False), "pending": ("pending", 2, "6,7", False), "review": ("review", 2, "3,6", False), "number": ("cover_without_number", 1, "3", False),
        "loose": ("loose", 11, "2,3,4,5,6,7,8,9", True), "none": ("loose", 1, "1", False), "last": ("review", 1, "5", False),
    }
    assert problems(frame(spark, {"w": [("a", "CA")], "v": [("a", "CP")]}, job_status="case workspace when 'v' then 'analyzing' else 'weird' end")) == {"w": ("not_in_review", 0, "", False), "v": ("analyzing", 0, "", False)}
    flags = {"first_page_error": "source = 'a' and idx = 0", "decision": "case workspace when 'w' then 'cover' else '' end"}
    assert problems(frame(spark, {"w": [("a", "CA")], "v": [("b", "R"), ("a", "CA")]}, **flags)) == {"w": ("", 0, "", False), "v": ("first_page", 0, "", False)}
    assert problems(frame(spark, {"w": [("a", "CA")]}).limit(0)) == {}


def test_same_source_in_two_workspaces(spark):
    df = frame(spark, {"v": [("a", "CAP"), ("b", "CA")], "w": [("a", "AC")]})
    assert {(r["workspace"], r["source"], r["idx"]): r["id"] for r in page_ids(df).collect()} == {("v", "a", 0): 1, ("v", "a", 1): 2, ("v", "a", 2): 3, ("v", "b", 0): 4, ("v", "b", 1): 5, ("w", "a", 0): 1, ("w", "a", 1): 2}
    out = {r["workspace"]: r.asDict() for r in workspace_summary(df).collect()}
    assert out["v"] == {"workspace": "v", "sources": 2, "pages": 5, "covers": 2, "needs_review": 0, "documents": 2, "loose": 0, "pending": 1, "analysed": 4, "ready": 0}
    assert (out["w"]["documents"], out["w"]["loose"], out["w"]["ready"]) == (1, 1, 2)


def test_ids_need_no_window_over_a_workspace(spark):
    plan = page_ids(frame(spark, {"w": [("a", "CA"), ("b", "C")]}))._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window" in line]
    assert len(windows) == 2 and sum("idx" in line for line in windows) == 1


def test_places(spark):
    rnd = random.Random(1)
    rows = [(rnd.randrange(50), rnd.choice(["a", None, "b"]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, s string, id long").repartition(7)
    out = places(df, F.col("k").desc(), F.col("s").asc_nulls_first(), F.col("id").asc()).collect()
    want = sorted(rows, key=lambda r: (-r[0], r[1] is not None, r[1] or "", r[2]))
    assert [(r["k"], r["s"], r["id"]) for r in sorted(out, key=lambda r: r["place"])] == want and sorted(r["place"] for r in out) == list(range(1, 3001))
    assert places(df.limit(0), F.col("id")).count() == 0
    # the window-free plan: no task gets the whole table
    assert df.rdd.getNumPartitions() > 1 and "Window" not in places(df, F.col("id"))._jdf.queryExecution().executedPlan().toString()
