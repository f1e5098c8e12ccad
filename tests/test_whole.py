"""Rules over whole texts, folders and workspaces, against brute force and plain loops."""

import random
import re

from docbatch.functions.text import heading_line_distance
from docbatch.jobs.catalog import QUERIES
from docbatch.operators.archive import archive_gate, claim_names, saveable_prefix
from docbatch.operators.grouping import approval_problems, pause_points, summary
from docbatch.operators.queue import transitions
from pyspark.sql import functions as F


def infix(text, pattern):
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def heading(text):
    def one(line):
        t = re.sub("[^A-Z0-9|!]", "", line.upper()).translate(str.maketrans("01L|!58", "OIIIISB"))
        return 17 if infix(t, "REPORTNO") > 1 else min(infix(t, "RECEIVINGREPORTNO"), 4)

    return min(map(one, re.split(r"\r\n|\r|\n", text or "")))


def test_heading_lines(spark):
    rnd = random.Random(3)
    texts = [None, "", "REPORT NO", "x" * 5000 + " receiving report no 7 " + "y" * 3000, "RECEIVING\nREPORT NO", "a\nb RECEIV1NG REP0RT N0"]
    for _ in range(150):
        letters = list("RECEIVING REPORT NO")
        for _ in range(rnd.randrange(6)):
            at = rnd.randrange(len(letters))
            letters[at : at + 1] = rnd.choice([[], [rnd.choice("REPOTNIX")], [letters[at], rnd.choice("REPOTN")]])
        fill = ["".join(rnd.choices("REPORTNOCIVG \n", k=rnd.randrange(60))) for _ in range(2)]
        texts.append(fill[0] + "".join(letters) + fill[1])
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["d"] for r in df.orderBy("i").select(heading_line_distance(F.col("t")).alias("d")).collect()]
    assert got == [heading(t) for t in texts] and {0, 1, 2, 3, 4, 17} == set(got)
    assert QUERIES["heading_lines"](spark, "/root/testdata/sf0.001").count() == spark.read.parquet("/root/testdata/sf0.001/documents.parquet").count()


NAMES = {"C": "cover", "A": "attachment", "R": "review", "P": "pending", "X": "cover"}


def test_workspaces(spark):
    """Against plain loops over the pages of workspaces of several sources."""
    rnd = random.Random(5)
    spaces = {"w": ["CACA", "CACCPP", "PPP"], "v": ["CA", "CA"], "u": ["PP", "P"], "t": ["CAC", "CAR", "AA"]}
    for n in range(80):
        seqs = ["".join(rnd.choices("CCAARX", k=rnd.randrange(1, 7))) for _ in range(rnd.randrange(1, 5))]
        cut = rnd.randrange(sum(map(len, seqs)) + 1) if n % 3 else 99
        for i, q in enumerate(seqs):
            seqs[i], cut = q[: max(cut, 0)] + "P" * (len(q) - max(cut, 0)), cut - len(q)
        spaces[f"r{n}"] = seqs
    rows, want = [], {}
    for s, seqs in spaces.items():
        pages = [(o, i, k) for o, q in enumerate(seqs) for i, k in enumerate(q)]
        rows += [(s, f"{s}-{9 - o}", o, i, "" if k == "X" else "N", NAMES[k]) for o, i, k in pages]
        first = next((n for n, p in enumerate(pages) if p[2] == "P"), None)
        cut = len(pages)
        if first is not None and any(p[2] != "P" for p in pages):
            cut = start = next(n for n, p in enumerate(pages) if p[0] == pages[first][0])
            for n in range(start, first):
                if pages[n][2] in "CX" and (n == start or pages[n - 1][2] not in "CX"):
                    cut = n
        for o in range(len(seqs)):
            want[s, o] = sum(p[0] == o for p in pages[:cut])
    df = spark.createDataFrame(rows, "workspace string, source string, source_ord int, idx int, number string, effective_state string")
    assert {(r["workspace"], r["source_ord"]): r["saveable"] for r in saveable_prefix(df).collect()} == want
    assert want["w", 2] == 0 and want["u", 0] == 2
    pend = F.hash("workspace") % 3 == 0
    df = df.withColumn("pending", pend & (F.col("source_ord") * 10 + F.col("idx") >= 3)).withColumn("first_page_error", (F.col("idx") == 0) & (F.col("source_ord") == 2) & (F.hash("workspace") % 2 == 0))
    by: dict = {}
    for r in df.orderBy("workspace", "source_ord", "idx").collect():
        by.setdefault(r["workspace"], []).append(r)
    stop = {}
    for s, pages in by.items():
        start = next((n for n, p in enumerate(pages) if p["pending"]), 0)
        start = 0 if all(p["pending"] for p in pages) else start
        stop[s] = (None, None)
        for n in range(start, len(pages)):
            p, before = pages[n], pages[n - 1] if n else None
            if p["first_page_error"]:
                break
            new = before and before["source"] == p["source"] and before["effective_state"] == "attachment" and p["effective_state"] == "cover"
            if n + 1 < len(pages) and (new or p["effective_state"] == "review" or (p["effective_state"] == "cover" and not p["number"])):
                stop[s] = (p["source"], p["idx"])
                break
    assert {r["workspace"]: (r["pause_source"], r["pause_idx"]) for r in pause_points(df).collect()} == stop


def test_clashing_names(spark):
    rnd = random.Random(2)
    rows = [("f", s, i) for i, s in enumerate(["A", "A", "A_02", "B", "B"])]
    rows += [(f"g{rnd.randrange(8)}", rnd.choice(["A", "A_02", "A_03", "A_02_02", "A_2", "B", "B_10"]), i) for i in range(9, 200)]
    taken = [("f", "B", 1), ("g1", "A", 2), ("g2", "A_02", 1), ("g3", "B", 1), ("g3", "B_10", 1)]
    held = {(f, s if n == 1 else f"{s}_{n:02d}") for f, s, n in taken}
    want = {}
    for f, s, i in rows:
        n = 1
        while (name := s if n == 1 else f"{s}_{n:02d}") in {x for g, x in held if g == f}:
            n += 1
        held.add((f, name))
        want[i] = name
    got = claim_names(spark.createDataFrame(rows, "folder string, stem string, i long"), spark.createDataFrame(taken, "folder string, stem string, number int"), "i")
    assert {r["i"]: r["name"] for r in got.collect()} == want and [want[i] for i in range(5)] == ["A", "A_02", "A_02_02", "B_02", "B_03"]


def test_gate_and_problems(spark):
    rows = [
        ("a", 0, "cover", "review", False, None, True, "exporting", ""), ("b", 0, "cover", "review", True, "cover", True, "review", ""), ("c", 0, "cover", "review", True, None, True, "review", "first_page"),
        ("d", 0, "cover", "review", False, None, False, "review", ""), ("e", 0, "pending", "review", True, "", True, "review", "first_page"), ("f", 0, "pending", "analyzing", True, None, True, "review", "analyzing"),
        ("g", 0, "cover", "done", False, None, True, "exporting", "not_in_review"), ("h", 0, "review", "error", False, None, True, "review", "error"), ("i", 0, "pending", "review", False, None, True, "review", "pending"),
    ]
    df = spark.createDataFrame([(r[0], r[1], "N", *r[2:7]) for r in rows], "source string, idx int, number string, effective_state string, job_status string, first_page_error boolean, decision string, auto_save boolean")
    assert {r["source"]: r["status"] for r in archive_gate(df).collect()} == {r[0]: r[7] for r in rows}
    got = {r["source"]: (r["problem"], r["n_pages"], r["page_ids"]) for r in approval_problems(df).collect()}
    assert got == {r[0]: (r[8], *((1, "1") if r[8] == "pending" else (0, ""))) for r in rows}


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_one_exchange(spark):
    """Splitting deals the detections out once, by source."""
    for name in ("split_shared", "split_sequential", "page_verdicts", "split_decided", "batch_summary"):
        assert exchanges(QUERIES[name](spark, "/root/testdata/sf0.001")) == 1, name


def test_summary(spark):
    rows = [(s, i, "" if k == "X" else "N", NAMES[k]) for s, q in {"a": "CACCPP", "b": "PP", "c": "ACRX", "d": "CAP"}.items() for i, k in enumerate(q)]
    got = {r["source"]: tuple(r)[1:] for r in summary(spark.createDataFrame(rows, "source string, idx int, number string, effective_state string")).collect()}
    # pages, covers, needs_review, documents, loose, pending, analysed, ready
    assert got == {"a": (6, 3, 0, 3, 0, 2, 4, 2), "b": (2, 0, 0, 0, 0, 2, 0, 2), "c": (4, 2, 2, 1, 1, 0, 4, 4), "d": (3, 1, 0, 1, 0, 1, 2, 0)}


def test_expected_statuses(spark):
    rows = [("j", 1, 1, "analyzing", ["queued"]), ("j", 2, 2, "error", ["analyzing"]), ("j", 3, 3, "review", ["analyzing"]), ("k", 1, 4, "analyzing", ["review"]), ("k", 2, 5, "done", None)]
    got = transitions(spark.createDataFrame(rows, "job string, ts long, event_id long, target string, expected array<string>"))
    assert {r["job"]: (r["status"], r["applied"]) for r in got.collect()} == {"j": ("error", 2), "k": ("queued", 0)}
    got = transitions(spark.createDataFrame([("a", i, i, t) for i, t in enumerate(["analyzing", "exporting", "review", "error", "dismissed"])], "job string, ts long, event_id long, target string"))
    assert tuple(got.first()) == ("a", "dismissed", 4, 5)
