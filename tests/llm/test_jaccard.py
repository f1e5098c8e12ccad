"""The Jaccard join against all pairs in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from docbatch.llm.graph import components as link_components
from docbatch.llm.jaccard import links, near_duplicates

from .brute import components, rows, shingles


def texts(seed, n=260):
    rnd = random.Random(seed)
    word = lambda: "w" + str(rnd.randrange(400))
    passage = [word() for _ in range(60)]
    base = [[word() for _ in range(rnd.choice([3, 6, 30, 120, 400]))] for _ in range(12)]
    out = []
    for _ in range(n):
        words = list(rnd.choice(base)) if rnd.random() < 0.7 else [word() for _ in range(rnd.randrange(1, 200))]
        for _ in range(rnd.randrange(6)):
            words[rnd.randrange(len(words))] = word()
        if rnd.random() < 0.4:
            at = rnd.randrange(len(words))
            words[at:at] = passage[: rnd.choice([20, 60])]
        if rnd.random() < 0.3:
            words = words[: rnd.randrange(1, len(words) + 1)]
        out.append(rnd.choice([" ", "\n", "  "]).join(words).upper() if rnd.random() < 0.2 else " ".join(words))
    return out + [None, "", " \n", "one", "ONE ", "one two three four", "one two three four five", "x " * 30000]


@pytest.mark.parametrize("seed,few,per_salt,leaf", [(1, 48, 20_000, 2048), (2, 2, 20_000, 2048), (3, 2, 10, 20), (4, 2, 20_000, 5)])
def test_links_equal_all_pairs(spark, seed, few, per_salt, leaf):
    data = dict(enumerate(texts(seed)))
    own, comps = links(spark.createDataFrame(list(data.items()), "doc_id long, text string").repartition(3), few=few, per_salt=per_salt, leaf=leaf)
    comp = {r["node"]: r["comp"] for r in rows(comps)}
    got: dict = {}
    for r in rows(own):
        assert r["n"] == len(shingles(data[r["doc_id"]]))
        got[r["doc_id"]] = comp.get(r["node"], r["node"]) if r["n"] else ("none", r["doc_id"])
    smallest = {c: min(d for d in got if got[d] == c) for c in set(got.values())}
    assert {d: smallest[c] for d, c in got.items()} == components(data)


def variants(n, seed, words=60, change=0.12, clusters=1):
    """Texts around one text (or a few): about half the shingles in common with it, fewer with each other, some linked."""
    rnd = random.Random(seed)
    base = [[f"c{k}w{i}" for i in range(words)] for k in range(clusters)]
    out = []
    for i in range(n):
        own = list(rnd.choice(out)) if out and rnd.random() < 0.3 else list(base[i % clusters])
        for at in range(words):
            if rnd.random() < (0.02 if own not in base else change):
                own[at] = f"v{rnd.randrange(10**6)}"
        out.append(own)
    return [" ".join(x) for x in out]


@pytest.mark.parametrize("clusters,leaf", [(1, 64), (5, 64), (5, 2048)])
def test_cells_of_many_variants(spark, monkeypatch, clusters, leaf):
    """All links of a cell; a text goes out as often as there are blocks in one cloud, and less often where pivots can cut the cell."""
    from docbatch.llm import jaccard

    data = dict(enumerate(variants(700, 5, change=0.12 if clusters == 1 else 0.03, clusters=clusters)))
    kept, copies = jaccard.materialize, {}

    def recorded(df, name, *rest):
        out = kept(df, name, *rest)
        if name in ("leaves", "pivoted"):
            copies.setdefault(name, []).append(out.selectExpr("sum(size(at))").first()[0] or 0)
        return out

    monkeypatch.setattr(jaccard, "materialize", recorded)
    docs = spark.createDataFrame(list(data.items()), "doc_id long, text string").repartition(3)
    nodes = docs.mapInArrow(jaccard._stats, jaccard._STATS).where("node is not null").select("node", "n", "doc_id")
    nodes = kept(nodes.groupBy("node").agg(F.min("n").alias("n"), F.min("doc_id").alias("doc_id")), "nodes")
    cells = nodes.selectExpr("1L as cell", "node")
    comps = link_components(jaccard._cell_links(docs, nodes, cells, leaf))
    label = {r["node"]: r["comp"] for r in rows(comps)}
    of = {r["doc_id"]: label.get(r["node"], r["node"]) for r in rows(nodes)}
    smallest = {c: min(d for d in of if of[d] == c) for c in set(of.values())}
    want = components(data)
    assert {d: smallest[c] for d, c in of.items()} == {d: want[d] for d in of} and 50 < len(set(want.values())) < 690
    n = len(of)
    blocks = -(-n // leaf)
    assert copies["leaves"] == [n] if leaf >= n else copies["leaves"][0] <= (1 if clusters == 1 else 0.7) * blocks * n, copies
    assert sum(copies.get("pivoted", [])) <= 2 * n * (1 if clusters == 1 else 3), copies


def test_sets_that_share_a_number(spark):
    """Numbers of 4 bits clash nearly always; the rest of the hash tells the sets apart."""
    data = dict(enumerate(texts(11, 60)))
    own, comps = links(spark.createDataFrame(list(data.items()), "doc_id long, text string"), bits=4)
    comp = {r["node"]: r["comp"] for r in rows(comps)}
    got = {r["doc_id"]: comp.get(r["node"], r["node"]) if r["n"] else ("none", r["doc_id"]) for r in rows(own)}
    smallest = {c: min(d for d in got if got[d] == c) for c in set(got.values())}
    assert {d: smallest[c] for d, c in got.items()} == components(data)


def test_blocks_and_windows():
    """All pairs of a region in each other's windows, and no others, however rows are batched."""
    import numpy as np
    import pyarrow as pa

    from docbatch.llm.jaccard import _within, quantised, windows

    rng = np.random.default_rng(5)
    found, want, rows_ = set(), set(), []
    for region in range(30):
        m = int(rng.integers(1, 40))
        blocks = 1 + region % 3
        members = [(int(rng.integers(1 << 40)), int(rng.integers(100, 140)), int(rng.integers(90, 150)), int(rng.integers(6))) for _ in range(m)]
        for i, (a, s, c, k) in enumerate(members):
            own = i % blocks
            rows_ += [(region, min(own, j), max(own, j), own, a, s, c, k, None) for j in range(blocks)]
            want |= {(min(a, b), max(a, b)) for b, t, d, o in members if t <= c and s <= d and k != o}
    rows_.sort(key=lambda r: r[:3])
    names = ["region", "low", "high", "block", "node", "size", "cap", "comp", "far"]
    kinds = [pa.int64()] * 8 + [pa.float64()]
    batches = [pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows_[at : at + 7]], kinds[k]) for k in range(9)], names=names) for at in range(0, len(rows_), 7)]
    for out in _within(iter(batches)):
        found |= set(zip(*(out.column(k).to_pylist() for k in (1, 2)), strict=True))
    assert found == want
    sizes = np.arange(1, 5000)
    assert (np.diff(quantised(sizes).astype(int)) >= 0).all()
    assert windows(4, 2).tolist() == [5, 3] and windows(1, 1).tolist() == [1]


def test_near_duplicates(spark):
    data = [*enumerate(texts(7, 60)), (3, "zz yy"), (500, texts(7, 60)[5]), (None, "one two"), (None, None)]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in data], "doc_id long, text string, n long, node long")
    out = rows(near_duplicates(df))
    one = {}
    for d, t in data:
        if d is not None:
            one[d] = max(one.get(d, t), t, key=lambda x: (x is not None, (x or "").encode()))
    want = components(one)
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in out if r["doc_id"] is not None) == sorted((d, len(shingles(one[d])), want[d]) for d, _ in data if d is not None)
    assert sorted((r["n_shingles"], r["component_id"]) for r in out if r["doc_id"] is None) == [(0, None), (1, None)]
    assert near_duplicates(df.limit(0)).count() == 0


def test_chain_components(spark):
    chain = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (101, 102), (100, 102)]
    random.Random(1).shuffle(chain)
    got = {r["node"]: r["comp"] for r in rows(link_components(spark.createDataFrame(chain, "a long, b long")))}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100)}


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    want = components({r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()})
    assert {r["doc_id"]: r["component_id"] for r in rows(near_duplicates(docs))} == want


def test_sketches_bound_the_difference():
    import numpy as np

    from docbatch.llm.jaccard import _gap, _sketch

    rng = np.random.default_rng(3)
    for n, m in ((10, 12), (900, 1500), (5000, 1100), (60_000, 70_000)):
        whole = rng.integers(0, 2**63, n + m).astype(np.uint64)
        a, b = np.unique(whole[:n]), np.unique(whole[n // 2 :])
        assert _gap(_sketch(a), _sketch(b)) <= len(np.setxor1d(a, b)) and _gap(_sketch(a), _sketch(a)) == 0
    same = (np.arange(1, 400) << 40).astype(np.uint64)  # one class holds more than 255
    assert _gap(_sketch(same), _sketch(np.concatenate([same, same[-1:] + np.uint64(1 << 40)]))) <= 1
