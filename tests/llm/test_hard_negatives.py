"""Hard negatives against all scores in plain Python; the SQL of the query on odd rows."""

import math
import random

import duckdb
import numpy as np
import pytest

from docbatch.llm.hard_negatives import best_products, hard_negatives, integer_vectors
from docbatch.llm.queries import ORACLES, op11_hard_negatives

from .brute import rows


def plain(vectors, is_anchor, positives=5, negatives=3, low=50, high=95):
    """vectors: (vec_id, label, q)."""
    out = []
    for a, label, q in vectors:
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(q, r, strict=False)), i, m) for i, m, r in vectors if i != a)
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            inside = [(-n, i) for n, i, m in scored if m != label and low * -s <= 100 * -n <= high * -s]
            out += [(a, p, k + 1, i, -s, n) for k, (n, i) in enumerate(inside[:negatives])]
    return sorted(out)


def got(df):
    return sorted((r["anchor_id"], r["positive_id"], r["rank"], r["negative_id"], r["positive_score"], r["negative_score"]) for r in rows(df))


def near(n, width, seed, labels=3):
    """Vectors around a few centres, with ties, repeats and shorter ones."""
    rnd = random.Random(seed)
    centres = [[rnd.gauss(0, 40) for _ in range(width)] for _ in range(5)]
    out = []
    for i in range(n):
        q = [int(x + rnd.gauss(0, 15)) for x in rnd.choice(centres)][: width - (i % 17 == 0)]
        out.append((i, rnd.choice([0] * 3 + list(range(labels))), out[-1][2] if i % 13 == 5 else q))
    return out


@pytest.mark.parametrize("tile", [(512, 4096, 256, 1 << 16), (3, 16, 4, 7)])
def test_best_products(monkeypatch, tile):
    monkeypatch.setattr("docbatch.llm.hard_negatives._TILE", tile[:2])
    monkeypatch.setattr("docbatch.llm.hard_negatives._FIRST", tile[2])
    monkeypatch.setattr("docbatch.llm.hard_negatives._GATHERED", tile[3])
    rnd = np.random.default_rng(1)
    for size in (2, 100, 1 << 21):
        a, x = rnd.integers(-size, size, (9, 12)), rnd.integers(-size, size, (300, 12))
        x[100:120] = x[7]
        exact = a @ x.T
        low = np.column_stack([np.full(9, -np.inf), np.quantile(exact, 0.5, axis=1).round(), np.full(9, np.inf)])
        high = np.column_stack([np.full(9, np.inf), np.quantile(exact, 0.8, axis=1).round(), np.full(9, -np.inf)])
        best, seen = best_products(a, np.arange(9), x, np.arange(300), low, high, 4, (np.arange(9) % 2, np.arange(300) % 2))
        for r in range(9):
            for w in range(3):
                want = sorted((-exact[r, j], j) for j in range(300) if j != r and r % 2 != j % 2 and low[r, w] <= exact[r, j] <= high[r, w])[:4]
                own = best.slot == 3 * r + w
                assert list(zip((-best.score[own]).tolist(), best.ids[own].tolist(), strict=True)) == want
        assert seen["pairs"] == 9 * 300
    assert len(best_products(a[:0], np.arange(0), x, np.arange(300), low[:0], high[:0], 4)[0].slot) == 0


def test_planes_drop_most_pairs():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(20_000, 64))
    x = np.floor(256 * x / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    free = np.full((50, 1), np.inf)
    best, seen = best_products(x[:50], np.arange(50), x, np.arange(20_000), -free, free, 5)
    assert seen["whole"] < 0.1 * seen["pairs"] and (np.sort(best.score[best.slot == 3])[::-1] == np.sort((x[3] @ x.T)[np.arange(20_000) != 3])[::-1][:5]).all()


@pytest.mark.parametrize("cells", [(8192, 65_536), (7, 60)])
def test_hard_negatives(spark, cells):
    vectors = near(400, 9, 3)
    frame = spark.createDataFrame([(i, m, q) for i, m, q in vectors], "vec_id long, label long, q array<int>").repartition(3)
    out = got(hard_negatives(frame, "vec_id % 20 = 0", anchors_per_cell=cells[0], rows_per_cell=cells[1]))
    assert out == plain(vectors, lambda i: i % 20 == 0) and len(out) > 100
    assert got(hard_negatives(frame.limit(0), "vec_id % 20 = 0")) == [] == got(hard_negatives(frame, "false"))
    one = hard_negatives(frame.where("label = 1"), "vec_id % 20 = 0")
    assert got(one) == []


def test_repeated_rows_and_many_labels(spark):
    vectors = near(300, 6, 4, labels=90)
    vectors += [(20, 0, vectors[20][2]), (40, 1, vectors[41][2]), (40, 1, vectors[41][2]), (3, 2, vectors[3][2])]
    frame = spark.createDataFrame(vectors, "vec_id long, label long, q array<int>").repartition(2)
    assert got(hard_negatives(frame, "vec_id % 20 = 0", anchors_per_cell=4, rows_per_cell=50)) == plain(vectors, lambda i: i % 20 == 0)


def test_integer_vectors(spark):
    odd = [(1, 3, [0.5, -0.001]), (7, 9, [-0.0, 1.0]), (None, 1, [1.0, 1.0]), (2, None, [1.0, 1.0]), (3, 1, None), (4, 1, [1.0, None]), (5, 1, [float("nan"), 1.0]), (6, 1, [float("inf"), 1.0]), (8, 1, [])]
    frame = spark.createDataFrame([(*r, "x") for r in odd], "vec_id long, label int, embedding array<float>, q string")
    out = {r["vec_id"]: (r["label"], r["q"]) for r in rows(integer_vectors(frame))}
    assert out == {1: (3, [128, math.floor(256 * float(np.float32(-0.001)))]), 7: (9, [0, 256]), 8: (1, [])}
    with pytest.raises(Exception, match="too large"):
        integer_vectors(spark.createDataFrame([(1, 1, [1e30])], "vec_id long, label int, embedding array<double>")).collect()


def test_query_on_odd_rows(spark, tmp_path):
    rnd = random.Random(5)
    data = [(i, [rnd.gauss(0.1, 0.2) for _ in range(8)], rnd.randrange(4)) for i in range(700)]
    data += [(700, None, 1), (750, [1.0] * 8, None), (800, [float("nan")] * 8, 1), (701, [None] + [1.0] * 7, 2), (702, data[0][1], 3), (703, data[0][1], data[0][2])]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    result = con.execute(ORACLES["op11_hard_negatives"])
    names = [c[0] for c in result.description]
    want = sorted(tuple(dict(zip(names, r, strict=True))[c] for c in ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")) for r in result.fetchall())
    assert got(op11_hard_negatives(spark, str(tmp_path))) == want and len(want) > 50
