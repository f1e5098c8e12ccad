"""Saved pages field by field, failed pages, the stamp rule with numbers of users, and the queue's order."""

import pytest
from pyspark.sql import functions as F

from docbatch.operators import evidence, queue, review, saving
from docbatch.operators.archive import archive_gate, progress
from docbatch.operators.verdict import page_verdict, stamp_rule

PAGE = "source string, idx int, barcode string, target_found boolean, stamp string, state string, reason string, evidence array<struct<kind:string,box:struct<x0:double,y0:double,x1:double,y1:double>,confidence:double,detail:string>>, decision string, manual_barcode string, other_barcodes array<string>, source_signature struct<size:long,mtime_ns:long>, first_page_error boolean"


def test_saved_pages_come_back_whole(spark):
    rows = [
        ("a", 1, "B", True, "mixed", "review", 'quote " and \\ and é\n', [("stamp", (1.0, 2.5, 3.0, 4.0), 0.25, "x"), ("barcode", (0.0, 0.0, 1e9, 1.0), 1.0, "")], "cover", " M ", ["P", ""], (2**60, 3), True),
        ("a", 0, "", False, "none", "pending", "", [], "", "", [], None, False), ("b", 7, "B", True, "blue", "cover", "", [], "attachment", "", ["Q"], (0, 0), False),
    ]
    pages = spark.createDataFrame(rows, PAGE)
    jobs = saving.encode_pages(pages)
    assert '"source_signature":null' in jobs.where("source = 'a'").first()["pages"] and '"box":[1.0,2.5,3.0,4.0]' in jobs.where("source = 'a'").first()["pages"]
    kept, broken = saving.decode_pages(jobs)
    assert kept.schema.simpleString() == pages.schema.simpleString() and broken.count() == 0
    whole = lambda df: [r.asDict(recursive=True) for r in df.orderBy("source", "idx").collect()]
    assert whole(kept) == whole(pages)


def test_broken_texts(spark):
    texts = {
        "ok": '[{"idx": 0, "barcode": "B", "new": 1}, {"idx": 1, "evidence": null}]', "empty": "[]", "cut": '[{"idx": 0}', "object": '{"idx": 0}', "null": None, "blank": "", "no_idx": '[{"idx": 0}, {"barcode": "B"}]', "kind": '[{"idx": "zero"}]', "number": "[3]",
        "box": '[{"idx": 0, "evidence": [{"kind": "stamp", "box": [1, 2, 3]}]}]', "signature": '[{"idx": 0, "source_signature": [1]}]', "list": '[{"idx": 0, "evidence": 5}]',
    }
    kept, broken = saving.decode_pages(spark.createDataFrame(list(texts.items()), "source string, pages string"))
    assert [(r["source"], r["idx"], r["barcode"], r["stamp"], r["state"], r["evidence"], r["other_barcodes"], r["source_signature"], r["first_page_error"]) for r in kept.orderBy("idx").collect()] == [("ok", 0, "B", "none", "pending", [], [], None, False), ("ok", 1, "", "none", "pending", [], [], None, False)]
    assert {r["source"]: r["problem"] for r in broken.collect()} == {**dict.fromkeys(("cut", "object", "null", "blank"), "not_an_array"), **dict.fromkeys(("no_idx", "kind", "number", "box", "signature", "list"), "bad_page")}


def test_failed_pages(spark):
    schema = "source string, idx int, stamp string, target_found boolean, unreadable boolean, reports array<string>, error string"
    rows = [("a", 0, "none", False, False, [], "gone"), ("a", 1, "blue", True, False, ["R"], None), ("b", 0, "none", False, False, [], None), ("c", 0, "blue", True, False, ["R"], "x")]
    got = page_verdict(spark.createDataFrame(rows, schema))
    assert [(r["state"], r["reason"], r["first_page_error"]) for r in got.orderBy("source", "idx").collect()] == [("review", "failed", False), ("cover", "blue", False), ("review", "first_page", True), ("review", "failed", False)]
    pages = spark.createDataFrame([("a", 0, "N", "cover", None), ("b", 0, "N", "cover", "x"), ("b", 1, "N", "attachment", None), ("c", 0, "N", "review", None)], "source string, idx int, number string, effective_state string, error string")
    assert {r["source"]: r["status"] for r in archive_gate(pages).collect()} == {"a": "exporting", "b": "error", "c": "review"}


@pytest.mark.parametrize("mixed,plain", [(True, True), (False, True), (True, False)])
def test_stamp_rule_by_the_number_that_holds(spark, mixed, plain):
    rows = [("", " M1 ", "", "mixed"), ("", "  ", "", "mixed"), ("N", "", "cover", "mixed"), ("N", None, None, "black"), (None, None, None, "faint"), ("N", "M", "attachment", "blue")]
    df = spark.createDataFrame([(i, True, *r, "review", "old") for i, r in enumerate(rows)], "i int, target_found boolean, barcode string, manual_barcode string, decision string, stamp string, state string, reason string")
    got = [(r["state"], r["reason"], r["needs_review"]) for r in stamp_rule(df, mixed, plain).orderBy("i").collect()]
    one = lambda on, stamp, decided: ("review", f"stamp_{stamp}", not decided) if on else ("attachment", f"stamp_{stamp}_following", False)
    kept = ("review", "old", False)
    assert got == [one(mixed, "mixed", False), kept, one(mixed, "mixed", True), one(plain, "black", False), kept, kept]


def test_queue_order_and_lines(spark):
    rows = [(3, "2024-01-02 00:00:00", "queued"), (2, "2024-01-01 00:00:00", "review"), (1, "2024-01-02 00:00:00", "queued"), (4, "2024-01-01 00:00:00", "error")]
    df = spark.createDataFrame(rows, "id long, created string, status string").withColumn("created", F.to_timestamp("created"))
    assert [(r["id"], r["next"]) for r in review.queue_order(df).orderBy("place").collect()] == [(2, False), (4, False), (1, True), (3, False)]
    assert not any(r["next"] for r in review.queue_order(df.where("status <> 'queued'")).collect()) and review.queue_order(df.limit(0)).count() == 0
    lines = df.select("id", F.lit("/in/1/a.pdf").alias("path"), F.lit("Tarama_1").alias("label"), "status", F.when(F.col("id") == 2, "").otherwise("x").alias("problem"), F.lit(1).alias("done"), F.lit(8).alias("total"), "created", F.lit("2024-01-02").cast("date").alias("today"))
    got = {r["id"]: (r["label"], r["name"], r["status_text"], r["saveable"], r["bar"], r["percent"], r["added"]) for r in review.queue_view(lines).collect()}
    assert got[1] == ("Tarama_1", "a.pdf", "in line", "after analysis", "#.........", 12, "00:00") and got[2][2:4] == ("waits for approval", "can be saved") and got[4][2:4] == ("needs a look", "review first") and got[2][6] == "01.01 00:00"


def test_sorts_within_workspaces(spark):
    rows = [("w", 1, "b", 0, "review", "B10"), ("w", 2, "a", 1, "cover", "B2"), ("w", 3, "a", 0, "review", "b2"), ("v", 9, "a", 0, "pending", ""), (None, 4, "a", 0, "cover", "A")]
    df = spark.createDataFrame(rows, "workspace string, id int, source string, idx int, effective_state string, number string")
    order = lambda by, down=False: [r["id"] for r in review.sort_pages(df, by, down).where("workspace = 'w'").orderBy("place").collect()]
    assert (order("id"), order("page"), order("state"), order("state", True), order("number"), order("number", True)) == ([1, 2, 3], [3, 2, 1], [1, 3, 2], [2, 1, 3], [2, 3, 1], [1, 2, 3])
    assert sorted((r["workspace"] or "", r["place"]) for r in review.sort_pages(df, "id").collect()) == [("", 1), ("v", 1), ("w", 1), ("w", 2), ("w", 3)]


def test_labels_of_folders_and_last_reports(spark):
    files = spark.createDataFrame([("/a/x.pdf", "own"), ("/z/x.pdf", "Canon"), ("/z/x.pdf", "Kodak"), ("/z/x.pdf", None)], "path string, label string")
    assert [r["label"] for r in queue.folder_labels(files, ["/b", "/c", "/a"]).collect()] == ["Tarama_3", "Tarama_1", "Tarama_2", "Tarama_2"]
    assert [r["label"] for r in queue.folder_labels(files.drop("label"), ["/b", "/c", "/a"]).collect()] == ["Tarama_3", "Tarama_2", "Tarama_2", "Tarama_2"]
    events = spark.createDataFrame([("j", 1, 1, 1, 9), ("j", 3, 2, 5, 9), ("j", 2, 3, 3, 9), ("k", 1, 4, 0, 0)], "job string, ts long, event_id long, done int, total int")
    assert {r["job"]: (r["done"], r["total"], r["reports"]) for r in progress(events).collect()} == {"j": (5, 9, 3), "k": (0, 0, 1)}


def test_points(spark):
    box = spark.createDataFrame([(0.0, 100.0, 200.0, 300.0, 200.0)], "x0 double, y0 double, x1 double, y1 double, dpi double")
    assert tuple(box.select(*evidence.in_points({c: F.col(c) for c in ("x0", "y0", "x1", "y1")}, F.col("dpi"))).first()) == (0.0, 36.0, 72.0, 108.0)
