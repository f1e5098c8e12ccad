"""Runs of words against a search of every period, the suffix arrays against plain sorting."""

import random
import zlib
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from docbatch.llm.queries import op12_periodic_runs
from docbatch.llm.runs import MIN_PERIODS, MIN_WORDS, best_run, common, find_runs, run_digests, stretches, suffixes, word_runs

from .brute import WORD, rows, sha


def plain_runs(words):
    """Each period on its own: stretches where a word equals the one a period before."""
    n, out = len(words), {}
    for q in range(1, n // MIN_PERIODS + 1):
        i = q
        while i < n:
            if words[i] != words[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and words[i] == words[i - q]:
                i += 1
            if i - start >= max(MIN_WORDS, MIN_PERIODS * q):
                out.setdefault((start, i), q)
    return sorted((a, b - a, q) for (a, b), q in out.items())


def plain_collapsed(words, runs):
    gone = {i for a, n, q in runs for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def odd_words(seed, n=None):
    rnd = random.Random(seed)
    out = []
    for _ in range(rnd.randrange(1, 6)):
        unit = [rnd.choice("ab" if rnd.random() < 0.5 else "abcdefgh") for _ in range(rnd.randrange(1, 12))]
        out += (unit * rnd.randrange(1, 30))[: rnd.randrange(1, 150)] + [rnd.choice("abcxyz") for _ in range(rnd.randrange(0, 12))]
    return out


TEXTS = [None, "", " \n ", "a", "a " * 23, "a " * 24, "a b " * 12, "a b c " * 7 + "a b", "a b c " * 8, "one\ttwo\n" * 2000, "x " * 20_000] + [" ".join(odd_words(s)) for s in range(150)]


def test_suffixes():
    rnd = random.Random(2)
    for n in (1, 2, 3, 17, 200):
        text = [rnd.randrange(3) for _ in range(n)]
        order, names = suffixes(np.array(text))
        assert order.tolist() == sorted(range(n), key=lambda i: text[i:])
        a, b = np.array([rnd.randrange(n) for _ in range(300)]), np.array([rnd.randrange(n) for _ in range(300)])
        a, b = a[a != b], b[a != b]
        for i, j, k, m in zip(a.tolist(), b.tolist(), common(names, a, b).tolist(), common(names, a, b, back=True).tolist(), strict=True):
            assert k == next((x for x in range(n) if max(i, j) + x >= n or text[i + x] != text[j + x]), n)
            assert m == next((x for x in range(n) if min(i, j) - x <= 0 or text[i - x - 1] != text[j - x - 1]), n)


@pytest.mark.parametrize("at_once", [1 << 20, 5])
def test_runs_of_many_rows_at_once(monkeypatch, at_once):
    monkeypatch.setattr("docbatch.llm.runs._PAIRS", at_once)
    texts = [(t or "").split() for t in TEXTS if len(t or "") < 5000]
    names = {w: i for i, w in enumerate(sorted({w for t in texts for w in t}))}
    offsets = np.cumsum([0, *map(len, texts)])
    hashes = np.array([names[w] * 0x9E3779B97F4A7C15 % 2**64 for t in texts for w in t], np.uint64)
    with np.errstate(over="ignore"):
        start, length, period = word_runs(hashes, offsets)
        first, end = stretches(hashes, offsets)
    got = list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True))
    want = [(offsets[i] + a, n, q) for i, t in enumerate(texts) for a, n, q in plain_runs(t)]
    assert got == want and len(want) > 150
    assert all(any(a <= s and s + n <= b for a, b in zip(first, end, strict=True)) for s, n, _ in want)
    assert len(word_runs(np.zeros(0, np.uint64), np.zeros(1, np.int64))[0]) == 0


def test_find_runs(spark):
    docs = [(i, t, "clash") for i, t in enumerate(TEXTS)] + [(8, TEXTS[8], "clash"), (None, "a " * 30, None)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, runs string").repartition(3)
    out = rows(find_runs(frame))
    assert len(out) == len(docs) and set(out[0]) == {"doc_id", "text", "n_words", "runs", "collapsed"}
    for r in out:
        words = WORD.findall(r["text"] or "")
        if len(words) < 3000:
            runs = plain_runs(words)
            assert [(x["start"], x["length"], x["period"]) for x in r["runs"]] == runs and r["collapsed"] == plain_collapsed(words, runs) and r["n_words"] == len(words)
    long = {r["doc_id"]: (r["runs"], r["collapsed"]) for r in out if r["n_words"] >= 3000}
    assert list(long.values()) and all([len(x) for x, _ in long.values()] == [1] * len(long) for _ in long) and {c for _, c in long.values()} <= {"one two", "x"}
    digests = {r["doc_id"]: r for r in rows(run_digests(find_runs(frame.where("doc_id IS NOT NULL"))))}
    assert digests[0] | {"doc_id": 0} == {"doc_id": 0, "n_runs": 0, "start": None, "length": None, "period": None, "exponent_milli": None, "runs_sha256": sha(""), "collapsed_sha256": sha("")}
    assert find_runs(frame.limit(0)).count() == 0


def test_best_run():
    runs = [{"start": 5, "length": 30, "period": 3}, {"start": 2, "length": 40, "period": 4}, {"start": 2, "length": 50, "period": 5}, {"start": 0, "length": 99, "period": 10}]
    assert best_run(runs) == runs[1] and best_run([]) is None


def test_query_against_every_period(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    out = {r["doc_id"]: r for r in rows(op12_periodic_runs(spark, "/root/testdata/sf0.01"))}
    assert len(out) == docs.count()
    checked = 0
    for doc_id, text in docs.where(F.length("text") < 6000).collect():
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        runs = plain_runs(words)
        best = min(runs, key=lambda r: (Fraction(-r[1], r[2]), r[0], r[2]), default=None)
        r = out[doc_id]
        assert (r["n_runs"], r["runs_sha256"], r["collapsed_sha256"]) == (len(runs), sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(plain_collapsed(words, runs)))
        assert (r["start"], r["length"], r["period"], r["exponent_milli"]) == ((*best, 1000 * best[1] // best[2]) if best else (None,) * 4)
        checked += bool(runs)
    assert checked > 50
