"""Hand-written page sequences, tables of rules, and random sequences against a plain fold."""

import random

import pytest

from docbatch.functions.text import heading_distance, heading_text, natural_key, safe_filename
from docbatch.jobs.archive import WITHOUT_SQL
from docbatch.jobs.catalog import ORACLES, QUERIES
from docbatch.jobs.review import WITHOUT_SQL as REVIEWED
from docbatch.operators.grouping import approval_problems, document_sizes, membership, pause_points, unassigned
from docbatch.operators.queue import transitions
from docbatch.operators.verdict import page_evidence, page_verdict, stamp_rule
from pyspark.sql import functions as F

STATE = {"C": "cover", "A": "attachment", "R": "review", "P": "pending", "X": "cover"}


def pages(spark, sequences):
    rows = [(s, i, "" if k == "X" else f"N{i}", STATE[k]) for s, seq in sequences.items() for i, k in enumerate(seq)]
    return spark.createDataFrame(rows, "source string, idx int, number string, effective_state string")


def documents(df, mode):
    out: dict = {}
    for r in membership(df, mode).collect():
        out.setdefault((r["source"], r["cover_idx"]), []).append(r["page_idx"])
    return {k: sorted(v) for k, v in out.items()}


@pytest.mark.parametrize(
    "seq,mode,want",
    [("CACA", "sequential", [[0, 1], [2, 3]]), ("CCAACA", "sequential", [[0], [1, 2, 3], [4, 5]]), ("CCAACA", "shared", [[0, 2, 3], [1, 2, 3], [4, 5]]), ("CRA", "shared", [[0]]), ("AAC", "shared", [[2]]), ("XA", "shared", [])],
)
def test_groups(spark, seq, mode, want):
    df = pages(spark, {"s": seq})
    assert sorted(documents(df, mode).values()) == want
    loose = {r["idx"] for r in unassigned(df, mode).collect()}
    assert loose | {p for d in want for p in d} == set(range(len(seq))) and not loose & {p for d in want for p in d}


def fold(seq, shared):
    groups, active, adjacent = [], [], False
    for i, k in enumerate(seq):
        if k == "C":
            groups.append([i])
            active = [*active, groups[-1]] if shared and adjacent else [groups[-1]]
            adjacent = True
        elif k == "A":
            for g in active:
                g.append(i)
            adjacent = False
        else:
            active, adjacent = [], False
    return groups


@pytest.mark.parametrize("mode", ["shared", "sequential"])
def test_random_sequences(spark, mode):
    rnd = random.Random(7)
    seqs = {f"s{n}": "".join(rnd.choices("CARPX", [4, 5, 1, 1, 1], k=rnd.randrange(1, 30))) for n in range(150)}
    df = pages(spark, seqs)
    want = {(s, g[0]): g for s, q in seqs.items() for g in fold(q, mode == "shared")}
    assert documents(df, mode) == want
    assert {(r["source"], r["cover_idx"]): r["n_pages"] for r in document_sizes(df, mode).collect()} == {k: len(v) for k, v in want.items()}


def test_pauses_and_problems(spark):
    df = pages(spark, {"a": "CACAC", "b": "CAC", "c": "CA", "d": "CRAA", "e": "AP", "f": "A", "g": "XAAAAAAAAAA"})
    assert {r["source"]: r["pause_idx"] for r in pause_points(df).collect()} == {"a": 2, "b": None, "c": None, "d": 1, "e": None, "f": None, "g": 0}
    got = {r["source"]: (r["problem"], r["n_pages"], r["page_ids"], r["truncated"]) for r in approval_problems(df).collect()}
    assert got["a"][0] == got["b"][0] == got["c"][0] == ""
    assert got["d"] == ("review", 1, "2", False) and got["e"] == ("pending", 1, "2", False) and got["f"] == ("loose", 1, "1", False) and got["g"] == ("cover_without_number", 1, "1", False)


@pytest.mark.parametrize("stamp", ["mixed", "black", "faint"])
@pytest.mark.parametrize("mixed", [True, False])
@pytest.mark.parametrize("plain", [True, False])
def test_stamp_rule(spark, stamp, mixed, plain):
    df = spark.createDataFrame([(True, "N", stamp, "review"), (False, "N", stamp, "attachment"), (True, "", stamp, "review")], "target_found boolean, barcode string, stamp string, state string")
    want = "review" if (mixed if stamp == "mixed" else plain) else "attachment"
    assert [r["state"] for r in stamp_rule(df, mixed, plain).collect()] == [want, "attachment", "review"]


def test_verdicts(spark):
    rows = [("a", 0, 1, None, False, None, "P1"), ("a", 1, 1, "blue", True, "R1", None), ("a", 2, 1, None, True, "R1", None), ("a", 2, 2, None, True, "R2", None), ("a", 3, 1, None, True, None, None), ("a", 4, 2, "blue", True, "R1", None), ("a", 4, 1, "faint", False, None, "R1"), ("a", 5, 1, None, False, None, None), ("a", 6, 1, None, True, "R3", None)]
    df = spark.createDataFrame(rows, "source string, idx int, ord int, stamp string, headed boolean, report string, other string")
    got = [(r["state"], r["reason"], r["barcode"], r["first_page_error"]) for r in page_verdict(page_evidence(df)).orderBy("idx").collect()]
    assert got == [("review", "first_page", "", True), ("cover", "blue", "R1", False), ("review", "multiple_numbers", "", False), ("review", "unreadable", "", False), ("review", "stamp_mixed", "R1", False), ("attachment", "following", "", False), ("review", "stamp_none", "R3", False)]
    assert page_verdict(page_evidence(df), review_missing_stamp=False).where("idx = 6").first()["state"] == "attachment"
    assert page_verdict(page_evidence(df.limit(0))).count() == 0


def test_names_and_keys(spark):
    names = ["CON", "a/b:c", " x. ", "com1.pdf", "", "...", "n" * 200, None]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "i int, n string")
    assert [r[0] for r in df.orderBy("i").select(safe_filename(F.col("n"))).collect()] == ["_CON", "a_b_c", "x", "_com1.pdf", None, None, "n" * 100, None]
    df = spark.createDataFrame([(x,) for x in ("B10", "b2", "A1", "A", "10A", "")], "n string")
    assert [r[0] for r in df.orderBy(natural_key(F.col("n"))).collect()] == ["", "10A", "A", "A1", "b2", "B10"]


def test_headings(spark):
    df = spark.createDataFrame([("RECEIVING REPORT NO",), ("xx RECE1VING REP0RT N0 12",), ("RECEIVING REPRT NO",), ("INVOICE NO",), ("",)], "t string")
    assert [r[0] for r in df.select(heading_distance(heading_text(F.col("t")))).collect()] == [0, 0, 1, 17, 17]


def test_transitions(spark):
    rows = [("j", 1, 1, "analyzing"), ("j", 2, 2, "analyzing"), ("j", 3, 3, "review"), ("j", 4, 4, "done"), ("j", 5, 5, "exporting"), ("j", 6, 6, "done"), ("j", 7, 7, "dismissed"), ("k", 1, 8, "dismissed"), ("k", 2, 9, "analyzing")]
    got = {r["job"]: (r["status"], r["applied"]) for r in transitions(spark.createDataFrame(rows, "job string, ts long, event_id long, target string")).collect()}
    assert got == {"j": ("done", 4), "k": ("dismissed", 1)}


def test_every_query_has_sql():
    assert set(QUERIES) - WITHOUT_SQL - REVIEWED == set(ORACLES)
