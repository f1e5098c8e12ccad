"""The pipeline's stages, each on its own input, against plain Python."""

from collections import defaultdict

import corpus_pipeline

from .brute import WORD, components, rows, targets


def test_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = rows(docs)
        docs = corpus_pipeline.materialize(stage(spark, docs, sf), "stage")
        seen[name] = (before, rows(docs))
    before, after = seen["toxicity"]
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    gone = {r["doc_id"] for r in before} - {r["doc_id"] for r in after}
    assert gone and not [d for d in gone if labels.get(d) == 0]
    before, after = seen["line dedup"]
    assert len(before) == len(after) and all(r["n_chars"] == len(r["text"]) for r in after)
    before, after = seen["n-gram Jaccard join"]
    want = components({r["doc_id"]: r["text"] for r in before})
    assert sorted(r["doc_id"] for r in after) == sorted(set(want.values()))
    before, after = seen["mixing sources to target weights"]
    size, taken, longest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in before:
        n = len(WORD.findall(r["text"] or ""))
        size[r["source"]] += n
        longest[r["source"]] = max(longest[r["source"]], n)
    for r in after:
        taken[r["source"]] += len(WORD.findall(r["text"] or ""))
    assert all(abs(taken[s] - t) <= 2 * longest[s] + 1 for s, t in targets(size).items())
    before, after = seen["best-fit packing"]
    bins = defaultdict(int)
    for r in after:
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 4096 and len([r for r in after if r["piece"] == 0]) == len(before)
