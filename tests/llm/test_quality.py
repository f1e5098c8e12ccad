"""Quality by compression: scores against plain sums, held-out accuracy, odd rows."""

import math
import random
import zlib

import numpy as np
import pytest
import zstandard

from docbatch.llm.quality import Quality, build_dictionary, calibrate, fit_quality, score_quality, spread
from docbatch.llm.queries import op13_quality_classifier

from .brute import rows

GOOD, BAD = "the quiet river runs past seven old mills and a stone bridge . ", "BUY!! NOW!! CHEAP!! CLICK!! HERE!! FREE!! WIN!! "


def text(kind, n, seed):
    rnd = random.Random(seed)
    words = (GOOD if kind else BAD).split()
    return " ".join(rnd.choice(words) for _ in range(n))


@pytest.fixture(scope="module")
def fitted(spark):
    docs = [(i, text(i % 3 > 0, 40 + i % 300, i)) for i in range(600)] + [(5, text(1, 9, 5)), (None, "x"), (1000, None), (1001, "")]
    labels = [(i, int(i % 3 > 0)) for i in range(600)] + [(7, 0), (8, None), (None, 1), (9, 5), (5000, 1), (1000, 1), (1001, 0)]
    return docs, labels, fit_quality(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int"), rows_per_class=400)


def test_scores_are_plain_sums(spark, fitted):
    docs, _, model = fitted
    extra = [(2000, "é" * 5000, "a", 1.0), (2001, text(0, 40_000, 1), "b", 2.0), (2001, text(0, 40_000, 1), "b", 2.0), (None, None, None, None)]
    frame = spark.createDataFrame([(d, t, "s", 0.5) for d, t in docs] + extra, "doc_id long, text string, score string, difference double")
    out = rows(score_quality(frame.withColumnRenamed("score", "Source"), model))
    assert len(out) == len(docs) + len(extra) and set(out[0]) == {"doc_id", "text", "Source", "difference", "score"}
    known = [zstandard.ZstdCompressionDict(x) for x in (model.good, model.bad)]
    for r in out:
        raw, size = (r["text"] or "").encode(), [0, 0]
        for at in range(0, len(raw), 1024):
            for k in (0, 1):
                size[k] += len(zstandard.ZstdCompressor(level=3, dict_data=known[k], write_content_size=False, write_dict_id=False).compress(raw[at : at + 1024]))
        x = (size[1] - size[0]) / max(len(raw), 1)
        assert r["difference"] == pytest.approx(x, abs=1e-12) and r["score"] == pytest.approx(1 / (1 + math.exp(-max(min(model.slope * x + model.bias, 30), -30))), abs=1e-9)
    assert all((r["score"] >= 0.5) == (r["doc_id"] % 3 > 0) for r in out if r["doc_id"] is not None and r["doc_id"] < 600)
    assert score_quality(frame.limit(0), model).count() == 0


def test_order_of_rows_changes_nothing(spark, fitted):
    docs, labels, model = fitted
    again = fit_quality(spark.createDataFrame(docs[::-1], "doc_id long, text string").repartition(5), spark.createDataFrame(labels[::-1], "doc_id long, quality int"), rows_per_class=400)
    assert again == model


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    for labels in ([], [(1, 1), (2, 1)], [(1, 0)], [(1, 0), (2, 1)]):
        out = rows(score_quality(docs, fit_quality(docs, spark.createDataFrame(labels, "doc_id long, quality int"))))
        assert len({r["score"] for r in out}) == 1 and all(0 <= r["score"] <= 1 for r in out)


def test_spread_and_dictionary():
    raw = bytes(range(256)) * 40
    assert spread(raw, 100) == [raw[a : a + 1024] for a in range(0, len(raw), 1024)]
    assert spread(raw, 3) == [raw[a : a + 1024] for a in (0, 3072, 6144)] and spread(b"", 3) == []
    assert build_dictionary([b"abc", b"def"], 4) == b"cdef"


def test_calibration_finds_the_curve():
    rnd = np.random.default_rng(1)
    x = rnd.normal(0, 0.1, 20_000)
    y = (rnd.random(20_000) < 1 / (1 + np.exp(-(30 * x + 0.5)))).astype(np.int64)
    slope, bias = calibrate(x, y, np.ones(len(x)))
    assert slope == pytest.approx(30, rel=0.1) and bias == pytest.approx(0.5, abs=0.1)
    doubled = np.concatenate([x, x[y == 0]]), np.concatenate([y, y[y == 0]])
    assert calibrate(*doubled, np.ones(len(doubled[0]))) == pytest.approx(calibrate(x, y, np.where(y == 0, 2.0, 1.0)), rel=1e-6)
    assert calibrate(-x, y, np.ones(len(x)))[0] == 0 and isinstance(Quality(b"", b"", 0, 0).probability(x), np.ndarray)


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    out = {r["doc_id"]: r for r in rows(op13_quality_classifier(spark, sf))}
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    right, n, brier = 0, 0, 0.0
    for doc_id, quality in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality").collect():
        r = out[doc_id]
        assert r["held_out"] == (zlib.crc32(str(doc_id).encode()) % 3 == 1) and r["predicted"] == (r["score"] >= 0.5)
        if r["held_out"]:
            right, n, brier = right + (r["predicted"] == quality), n + 1, brier + (r["score"] - quality) ** 2
    assert n > 80 and right >= 0.95 * n and brier <= 0.05 * n
