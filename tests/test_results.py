"""Late results and decisions, merged from streams into versions of the pages."""

import pytest
from pyspark.sql import functions as F

from docbatch.operators.review import AUTOMATIC, merge_results, reset_analysis
from docbatch.streaming.results import create_pages, current_pages, decisions_stream, forget_versions, late_results, merge_decisions, merge_late_results, orphans

EVIDENCE = "array<struct<kind:string,box:struct<x0:double,y0:double,x1:double,y1:double>,confidence:double,detail:string>>"
FIELDS = f"barcode string, target_found boolean, stamp string, state string, reason string, evidence {EVIDENCE}, other_barcodes array<string>, source_signature struct<size:long,mtime_ns:long>, first_page_error boolean"
PAGES = f"source string, idx int, {FIELDS}, decision string, manual_barcode string"
RESULTS = f"source string, idx int, ts long, {FIELDS}"
OLD = ("B0", True, "blue", "cover", "blue", [("stamp", (1.0, 2.0, 3.0, 4.0), 0.5, "x")], ["P"], (1, 2), True)


def result(name):
    return (name, False, "mixed", "review", f"reason {name}", [("barcode", (5.0, 6.0, 7.0, 8.0), 0.25, name)], [name, "Q"], (9, 9), False)


@pytest.fixture
def store(spark, tmp_path):
    rows = [(s, i, *OLD, "cover" if i == 1 else "", "MANUAL" if i == 1 else "") for s in ("a", "b", "c") for i in range(3)]
    root = f"file://{tmp_path}/pages"
    create_pages(spark.createDataFrame(rows, PAGES), root, parts=4)
    return root


def seen(spark, root, version=None):
    return {(r["source"], r["idx"]): r.asDict(recursive=True) for r in current_pages(spark, root, version).collect()}


def test_all_fields_change_and_decisions_stay(spark):
    pages = spark.createDataFrame([("a", 0, *OLD, "cover", "M"), ("a", 1, *OLD, "", "")], PAGES)
    merged, lost = merge_results(pages, spark.createDataFrame([("a", 0, 1, *result("R")), ("z", 0, 1, *result("R"))], RESULTS))
    first, second = (r.asDict(recursive=True) for r in merged.orderBy("idx").collect())
    assert (first["decision"], first["manual_barcode"], first["barcode"], first["evidence"][0]["box"]["y1"], first["other_barcodes"], first["source_signature"]) == ("cover", "M", "R", 8.0, ["R", "Q"], {"size": 9, "mtime_ns": 9})
    assert second["barcode"] == "B0" and [r["source"] for r in lost.collect()] == ["z"] and set(AUTOMATIC) <= set(first)
    reset = reset_analysis(pages).orderBy("idx").first().asDict(recursive=True)
    assert {c: reset[c] for c in AUTOMATIC} == {"barcode": "", "target_found": False, "stamp": "none", "state": "pending", "reason": "", "evidence": [], "other_barcodes": [], "source_signature": {"size": 1, "mtime_ns": 2}, "first_page_error": False} and reset["manual_barcode"] == "M"
    with pytest.raises(ValueError, match="stamp"):
        merge_results(pages, spark.createDataFrame([("a", 0)], "source string, idx int"))


def test_stream_of_late_results(spark, store, tmp_path):
    files = [[("a", 0, 5, *result("A5")), ("a", 0, 7, *result("A7")), ("a", 0, 6, *result("A6"))], [("a", 1, 1, *result("late")), ("b", 2, 1, *result("B")), ("zz", 0, 1, *result("nobody"))], [("a", 0, 1, *result("A1"))]]
    for i, rows in enumerate(files):
        spark.createDataFrame(rows, RESULTS).coalesce(1).write.json(f"{tmp_path}/in/{i}")
    stream = spark.readStream.schema(RESULTS).option("maxFilesPerTrigger", 1).json(f"{tmp_path}/in/*")
    assert late_results(stream, store, f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination(120)
    pages = seen(spark, store)
    assert len(pages) == 9 and {k: v["barcode"] for k, v in pages.items() if v["barcode"] != "B0"} == {("a", 0): "A1", ("a", 1): "late", ("b", 2): "B"}
    assert (pages["a", 1]["decision"], pages["a", 1]["manual_barcode"], pages["a", 1]["state"]) == ("cover", "MANUAL", "review")
    assert [(r["source"], r["stream"]) for r in orphans(spark, store).collect()] == [("zz", "results")]
    # after a restart from an empty checkpoint all batches come again, with the numbers they had
    assert late_results(stream, store, f"{tmp_path}/ck2").trigger(availableNow=True).start().awaitTermination(120)
    assert seen(spark, store) == pages and orphans(spark, store).count() == 1


def test_repeated_batch_changes_nothing(spark, store):
    batch = spark.createDataFrame([("a", 0, 1, *result("X"))], RESULTS)
    assert merge_late_results(batch, 0, store) and not merge_late_results(batch.withColumn("barcode", F.lit("Y")), 0, store)
    assert seen(spark, store)["a", 0]["barcode"] == "X"
    choice = spark.createDataFrame([("a", 0, 1, 1, "cover", " M9 "), ("q", 5, 1, 2, "attachment", "")], "source string, idx int, ts long, event_id long, action string, number string")
    assert merge_decisions(choice, 0, store) and not merge_decisions(choice, 0, store)
    assert merge_late_results(batch.withColumn("barcode", F.lit("Z")), 1, store)
    page = seen(spark, store)["a", 0]
    assert (page["barcode"], page["decision"], page["manual_barcode"]) == ("Z", "cover", "M9")
    assert {(r["stream"], r["source"]) for r in orphans(spark, store).collect()} == {("decisions", "q")}


def test_merge_that_stopped_before_its_log(spark, store, monkeypatch):
    batch = spark.createDataFrame([("a", 0, 1, *result("X")), ("b", 0, 1, *result("X"))], RESULTS)

    def broken(*args):
        raise OSError("gone")

    with monkeypatch.context() as m:
        m.setattr("docbatch.streaming.results._log", broken)
        with pytest.raises(OSError):
            merge_late_results(batch, 0, store)
    assert all(r["barcode"] == "B0" for r in seen(spark, store).values())
    assert merge_late_results(batch.where("source = 'a'"), 0, store)
    assert {k for k, r in seen(spark, store).items() if r["barcode"] == "X"} == {("a", 0)}


def test_old_versions(spark, store):
    for n in range(3):
        merge_late_results(spark.createDataFrame([("abc"[n], 0, 1, *result(f"X{n}"))], RESULTS), n, store)
    assert sum(r["barcode"] != "B0" for r in seen(spark, store, 1).values()) == 1
    last = seen(spark, store)
    forget_versions(spark, store)
    assert seen(spark, store) == last and sum(r["barcode"] != "B0" for r in seen(spark, store, 2).values()) == 2
    merge_late_results(spark.createDataFrame([("c", 1, 1, *result("X9"))], RESULTS), 3, store)
    assert seen(spark, store)["c", 1]["barcode"] == "X9"


def test_decisions_stream_and_empty_pages(spark, store, tmp_path):
    schema = "source string, idx int, ts long, event_id long, action string, number string"
    spark.createDataFrame([("b", 0, 1, 1, "attachment", ""), ("b", 1, 1, 2, "reset", "")], schema).coalesce(1).write.json(f"{tmp_path}/d/0")
    assert decisions_stream(spark.readStream.schema(schema).json(f"{tmp_path}/d/*"), store, f"{tmp_path}/ckd").trigger(availableNow=True).start().awaitTermination(120)
    pages = seen(spark, store)
    assert (pages["b", 0]["decision"], pages["b", 1]["decision"], pages["b", 1]["manual_barcode"]) == ("attachment", "", "")
    empty = f"file://{tmp_path}/none"
    create_pages(spark.createDataFrame([], PAGES), empty)
    assert merge_late_results(spark.createDataFrame([("a", 0, 1, *result("X"))], RESULTS), 0, empty)
    assert current_pages(spark, empty).count() == 0 and orphans(spark, empty).count() == 1
