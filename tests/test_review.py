"""Evidence, review and saving: ordered folds against plain loops, hand-written cases."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docbatch.functions.codes import code128_text
from docbatch.operators import evidence, queue, review, saving


def test_stacked_labels(spark):
    rnd = random.Random(4)
    rows, want = [], {}
    for page in range(60):
        regions = []
        for i in range(rnd.randrange(1, 8)):
            y0, x0 = rnd.randrange(0, 12) * 10, rnd.randrange(0, 40)
            regions.append([i, float(x0), float(y0), float(x0 + 50), float(y0 + 25), rnd.random() < 0.8, page % 2 == 0, rnd.choice([0.0, 0.0, 0.5, 0.9]), rnd.random() < 0.3])
        rows += [(page, *r) for r in regions]
        for r in regions:
            if r[7] == 0 and r[5]:
                for u in regions:
                    gap = u[2] - r[4] if u[6] else r[2] - u[4]
                    overlap = min(u[3], r[3]) - max(u[1], r[1])
                    if u is not r and u[8] == r[8] and u[5] and u[7] > 0 and 0 <= gap <= 0.4 * (u[4] - u[2]) and overlap >= 0.5 * min(u[3] - u[1], r[3] - r[1]):
                        r[7] = u[7]
                        break
        want |= {(page, r[0]): r[7] for r in regions}
    df = spark.createDataFrame(rows, "page int, ord int, x0 double, y0 double, x1 double, y1 double, read boolean, reversed boolean, confidence double, rotated boolean")
    assert {(r["page"], r["ord"]): r["confidence"] for r in evidence.stacked_labels(df).collect()} == want


def test_merge_scanlines(spark):
    rnd = random.Random(6)
    rows = sorted({(0, rnd.choice("AB"), rnd.randrange(200), rnd.randrange(12), 50 + rnd.randrange(12), rnd.random()) for _ in range(120)}, key=lambda r: (r[2], r[3], r[4], r[5]))
    found: list[list] = []
    for _, value, y, x0, x1, score in rows:
        near = next((s for s in found if s[0] == value and abs(s[1] - x0) < 8 and abs(s[3] - x1) < 8 and y - s[4] < 24), None)
        if near:
            near[1], near[3], near[4], near[5] = x0, x1, y + 1, min(near[5], score)
        else:
            found.append([value, x0, y, x1, y + 1, score])
    want = sorted(tuple(s) for s in found if s[4] - s[2] >= 8)
    df = spark.createDataFrame(rows, "page int, value string, y int, x0 int, x1 int, score double")
    assert sorted((r["value"], r["x0"], r["y0"], r["x1"], r["y1"], r["score"]) for r in evidence.merge_scanlines(df, 8).collect()) == want
    assert evidence.merge_scanlines(df).count() >= len(want)


def test_decisions_in_order(spark):
    rnd = random.Random(8)
    pages = [("s", i, "pending" if i == 3 else "review", True, "", "") for i in range(8)]
    events = [("s", rnd.randrange(9), rnd.randrange(50), k, rnd.choice(["cover", "attachment", "reset"]), rnd.choice([" N1\t", "", "N2", None])) for k in range(60)]
    want = {}
    for s, i, state, error, decision, manual in pages:
        for _, idx, _, _, action, number in sorted(events, key=lambda e: e[2:4]):
            if idx != i or state == "pending":
                continue
            number = (number or "").strip()
            if action == "cover" and number:
                decision, manual, error = "cover", number, False
            elif action == "attachment":
                decision = "attachment"
            elif action == "reset":
                decision = manual = ""
        want[i] = (decision, manual, error)
    out = review.apply_decisions(
        spark.createDataFrame(pages, "source string, idx int, state string, first_page_error boolean, decision string, manual_barcode string"),
        spark.createDataFrame(events, "source string, idx int, ts int, event_id int, action string, number string"),
    )
    assert {r["idx"]: (r["decision"], r["manual_barcode"], r["first_page_error"]) for r in out.collect()} == want


def test_code_texts(spark):
    cases = {
        (103, (33, 70, 34)): None,  # a control character of set A
        (103, (33, 34)): "AB",
        (104, (33, 98, 34, 35)): "ABC",
        (104, (100, 33)): None,
        (103, (101, 33)): None,
        (104, (98, 102, 70)): "f",  # the symbol without text ends the shift
        (105, (12, 34, 100, 33, 99, 99)): "1234A99",
        (104, (0, 33, 0)): "A",
        (104, (96,)): None,
        (104, ()): None,
    }
    df = spark.createDataFrame([(s, list(v)) for s, v in cases], "start int, v array<int>")
    assert {(r["start"], tuple(r["v"])): r["t"] for r in df.withColumn("t", code128_text(F.col("start"), F.col("v"))).collect()} == cases


def test_relabel_and_queue(spark):
    jobs = spark.createDataFrame([("/b/x.pdf", "queued", "Canon"), ("/z/x.pdf", "review", "Kodak"), ("/z/x.pdf", "error", "Canon"), ("/b/x.pdf", "done", "Canon"), ("/a/x.pdf", "queued", "own")], "path string, status string, label string")
    assert [r["label"] for r in queue.relabel_jobs(jobs, ["/a", "/b"]).collect()] == ["Tarama_2", "Tarama_2", "Tarama_1", "Canon", "own"]


def test_export_needs_every_page(spark, tmp_path):
    members = spark.createDataFrame([("s", 0, "N", 0), ("s", 0, "N", 1)], "source string, cover_idx int, number string, page_idx int")
    one = spark.createDataFrame([("s", 0, "abc")], "source string, idx int, content string")
    with pytest.raises(PySparkException):
        saving.export_pages(members, one, f"file://{tmp_path}/a")
    assert not (tmp_path / "a" / "markers").exists()
    both = one.union(spark.createDataFrame([("s", 1, None)], one.schema))
    assert [(r["job"], r["mode"], r["files"]) for r in saving.export_pages(members, both, f"file://{tmp_path}/b").collect()] == [("s", "automatic", '[{"name":"N_0","size":3}]')]


def test_end_mark(spark):
    df = spark.createDataFrame([(b"%%EOF",), (b"%%EOF" + b"x" * 4091,), (b"%%EOF" + b"x" * 4092,), (b"",), (None,)], "c binary")
    assert [r["ok"] for r in df.select(saving.complete_pdf(F.col("c")).alias("ok")).collect()] == [True, True, False, False, None]


def test_folders_take_the_first_free_number(spark):
    jobs = spark.createDataFrame([(1, "2024-01-05 14:32:08", "T"), (2, "2024-01-05 14:32:08", "T")], "id int, created string, label string").withColumn("created", F.to_timestamp("created"))
    taken = spark.createDataFrame([("2024-01-05", "14-32-08_T", 4), ("2024-01-05", "14-32-08_T", 2)], "archive_date string, stem string, number int")
    assert sorted(r["archive_dir"] for r in saving.archive_folders(jobs).collect()) == ["14-32-08_T_001", "14-32-08_T_002"]
    assert sorted(r["archive_dir"] for r in saving.archive_folders(jobs, taken).collect()) == ["14-32-08_T_001", "14-32-08_T_003"]
    odd = jobs.withColumn("label", F.when(F.col("id") == 1, "a/b").otherwise("CON"))
    assert sorted(r["archive_dir"] for r in saving.archive_folders(odd).collect()) == ["14-32-08__CON_001", "14-32-08_a_b_001"]


def test_read_votes_shuffle_once(spark):
    from docbatch.jobs.catalog import QUERIES

    plan = QUERIES["read_votes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.count("FileScan") == 1
