"""Labels of large tables: parts dealt over tasks, and symbols decoded a batch at a time, not one by one."""

import random

import numpy as np
from docbatch.functions.codes import STOP, WIDTHS, code39_label, code128_label, code128_text, code128_texts, nearest
from docbatch.jobs import archive as archive_jobs
from docbatch.operators.labels import read_rows
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_scanned_labels_dealt(spark):
    scans = archive_jobs.scanned_labels(spark, SF)
    assert scans.rdd.getNumPartitions() >= 4
    text = scans._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in text and "212222" not in text and text.count("array_min") == 0


def test_texts_against_built_in_functions(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(3000):
        top = rnd.choice([96, 103])
        values = [103 + rnd.randrange(3), *(rnd.choice([0, 98, 99, 100, 101, 102, rnd.randrange(top), rnd.randrange(64)]) for _ in range(rnd.randrange(1, 12)))]
        rows.append([*values, (values[0] + sum(k * v for k, v in enumerate(values[1:], 1)) + (i % 9 == 0)) % 103])
    counts = np.array([len(r) for r in rows])
    symbols = np.array([r + [7] * (16 - len(r)) for r in rows], np.int32)
    frame = spark.createDataFrame([(i, r[0], r[1:-1]) for i, r in enumerate(rows)], "i int, start int, v array<int>")
    want = {r["i"]: r["t"] for r in frame.select("i", code128_text(F.col("start"), F.col("v")).alias("t")).collect()}
    got = code128_texts(symbols, counts).to_pylist()
    assert got == [None if i % 9 == 0 else want[i] for i in range(3000)] and sum(x is not None for x in got) > 500


def test_broken_widths_are_no_label(spark):
    good = [[2.0 * int(c) for c in WIDTHS[v]] for v in (104, 33, 33, (104 + 33 + 66) % 103)] + [[2.0 * int(c) for c in STOP]]
    zeros = [[0.0] * 6, *good[1:]]
    rows = [good, zeros, [*good[:-1], [0.0] * 7], [*good[:2], None, *good[3:]], [*good[:2], [None, *good[2][1:]], *good[3:]], [good[0][:5], *good[1:]], [*good, good[1]], None]
    frame = spark.createDataFrame(list(enumerate(rows)), "i int, s array<array<double>>").coalesce(1)
    got = frame.select("i", code128_label(F.col("s")).alias("t"), code39_label(F.col("s"))["text"].alias("u")).orderBy("i").collect()
    assert [r["t"] for r in got] == ["AA"] + [None] * 7 and all(r["u"] is None for r in got)


def test_nearest_against_all_symbols():
    table = np.array([[int(c) for c in w] for w in WIDTHS], float)
    assert min(((a - b) ** 2).sum() for i, a in enumerate(table) for b in table[:i]) == 2
    rnd = np.random.default_rng(5)
    near = table[rnd.integers(0, 106, 20_000)] * 3 + rnd.normal(0, 1, (20_000, 6)) * rnd.choice([0, 0.3, 0.8, 1.5], (20_000, 1))
    windows = np.concatenate([np.abs(near), rnd.integers(1, 5, (5000, 6)), rnd.uniform(0.1, 60, (5000, 6)), [[np.inf, 1, 1, 1, 1, 1], [np.nan] * 6, [1e300, 1, 1, 1, 1, 1]]])
    for first in (0, 103):
        with np.errstate(invalid="ignore"):
            off = ((table[None, first:] - (windows * 11 / windows.sum(axis=1, keepdims=True))[:, None]) ** 2).mean(axis=2)
        symbol, error = nearest(windows, first)
        assert (symbol == off.argmin(axis=1) + first).all() and np.array_equal(error, off.min(axis=1), equal_nan=True)


def test_region_rows_dealt_and_read_once(spark):
    rows = archive_jobs._label_rows(spark, SF)
    assert rows.rdd.getNumPartitions() >= 4
    text = read_rows(rows)._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in text and "lambda" not in text[: text.index("MapInArrow")]  # nothing is decoded again after the search
