"""Scores of the classifier chain against sums in plain Python."""

import math
import random
import re
from collections import Counter

from docbatch.llm.toxicity import fit_chain, score_chain, word_features

from .brute import rows


def test_scores_are_the_sums_of_the_models(spark):
    rnd = random.Random(3)
    words = ["good", "Fine!", "awful...", "hateful", "day,", "(night)", "???", "wonderfully", "é"]
    texts = [" ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 60))) for _ in range(120)] + ["", None, " \n", "unseen", "good " * 5000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, int("awful" in t), int("hateful" in t and "awful" in t)) for i, t in enumerate(texts[:100])] + [(None, 1, 1), (5000, 1, 0)], "doc_id long, low_quality int, toxic int")
    chain = fit_chain(docs, labels, ["low_quality", "toxic"])
    assert len(chain.models) == 2 and chain.models[1].extra.shape == (1,)
    got = {r["doc_id"]: (r["p_low_quality"], r["p_toxic"]) for r in rows(score_chain(docs, chain))}
    for i, text in enumerate(texts):
        times = Counter(f for w in re.findall(r"[^\x20\x09-\x0D]+", text or "") for f in word_features(w.lower()))
        earlier: list[float] = []
        for k, model in enumerate(chain.models):
            odds = model.bias + sum(model.weights[chain.ids[f]] * (1 + math.log(n)) for f, n in times.items() if f in chain.ids)
            odds += sum(x * w for x, w in zip(earlier, model.extra, strict=True))
            p = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
            p = min(max(p, 1e-4), 1 - 1e-4)  # probabilities end there
            assert abs(got[i][k] - p) < 1e-9, (i, k, text, got[i], p)
            earlier.append(math.log(p / (1 - p)))


def test_repeated_documents_give_one_fit(spark):
    """A doc_id with several texts and labels: the folds go by what the rows hold, not by their order."""
    rnd = random.Random(4)
    words = ["good", "awful", "hateful", "day", "night"]
    docs = [(i % 40, " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 20)))) for i in range(160)]
    labels = [(i, i % 2, i % 3 == 0) for i in range(40)] + [(i, 1, True) for i in range(0, 40, 5)]
    make = lambda rows, parts: spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    marks = lambda rows: spark.createDataFrame([(i, a, int(b)) for i, a, b in rows], "doc_id long, low_quality int, toxic int")
    one, two = fit_chain(make(docs, 2), marks(labels), ["low_quality", "toxic"]), fit_chain(make(docs[::-1], 5), marks(labels[::-1]), ["low_quality", "toxic"])
    assert {f: [m.weights[i] for m in one.models] for f, i in one.ids.items()} == {f: [m.weights[i] for m in two.models] for f, i in two.ids.items()} and [m.bias for m in one.models] == [m.bias for m in two.models]
