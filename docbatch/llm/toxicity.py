"""Toxicity by a classifier chain of linear models.

The label columns form a chain: the model of a category sees the words of a
document and the probabilities of the categories before it.  While fitting,
these earlier probabilities are out-of-fold ones, so a later model learns from
predictions as good as it will get.

Features are the words of the whole text, their first 4 to 8 letters and runs of
marks, each with one and the logarithm of how often it occurs.  The models are fitted on a sample of labelled rows bounded by
``max_rows``, picked by hash; which features they use is counted on that sample.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docbatch.llm.store import materialize
from docbatch.llm.textio import frugal, slices, split_words

PREFIXES = (4, 5, 6, 7, 8)
_SLICE = 3 << 19  # bytes of text at once; the features of a word take some 50 bytes each
_PUNCTUATION = ".,;:!?()[]{}\"'|*#$%&<>"


def _words(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct lower-cased words, the word of each place, and the row of each place."""
    flat, offsets = split_words(column)
    coded = flat.dictionary_encode()
    return [w.lower() for w in coded.dictionary.to_pylist()], coded.indices.to_numpy(), np.repeat(np.arange(len(column)), np.diff(offsets))


def word_features(raw: str) -> list[str]:
    """The word without punctuation at its ends, its first letters, and marks that stand alone or in a run."""
    word = raw.strip(_PUNCTUATION)
    tail = raw[len(raw.rstrip(_PUNCTUATION)) :]
    marks = ["~" + tail[:3]] if not word or len(tail) > 1 else []
    return marks + ([word, *(word[:n] + "*" for n in PREFIXES if len(word) >= n)] if word else [])


def occurrences(column: pa.Array, ids: dict[str, int] | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[str]]:
    """Distinct (row, feature) pairs, sorted, and their values; ids None: all features, named by the last result."""
    words, at, row = _words(column)
    names: dict[str, int] = {} if ids is None else ids
    own = [[names.setdefault(f, len(names)) for f in word_features(w)] if ids is None else [ids[f] for f in word_features(w) if f in ids] for w in words]
    sizes = np.array([len(x) for x in own], np.int64)
    flat = np.array([f for x in own for f in x], np.int64)
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), list(names)
    starts = np.cumsum(sizes) - sizes
    pairs, times = np.unique(row * len(words) + at, return_counts=True)  # each word of a row once
    row, at = pairs // len(words), pairs % len(words)
    n = sizes[at]
    ends = np.cumsum(n)
    place = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[at] - ends + n, n)
    keys, inverse = np.unique(np.repeat(row, n) * len(names) + flat[place], return_inverse=True)
    value = 1 + np.log(np.bincount(inverse, weights=np.repeat(times, n)))
    return keys // len(names), keys % len(names), value, list(names)


def _count(categories: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", _SLICE):
            row, feature, _, names = occurrences(b.column("text"), None)
            columns = [pa.array(names, pa.string()), pa.array(np.bincount(feature, minlength=len(names)), pa.int64())]
            for c in categories:
                label = b.column(c).to_numpy(zero_copy_only=False).astype(np.float64)
                columns.append(pa.array(np.bincount(feature, weights=label[row], minlength=len(names)).astype(np.int64)))
            yield pa.RecordBatch.from_arrays(columns, names=["feature", "n", *categories])

    return frugal(run)


def _index(ids: dict[str, int], categories: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", _SLICE):
            row, feature, value, _ = occurrences(b.column("text"), ids)
            offsets = pa.array(np.searchsorted(row, np.arange(b.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(feature.astype(np.int32))), pa.ListArray.from_arrays(offsets, pa.array(value.astype(np.float32)))]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *lists, *[b.column(c) for c in categories]], names=["doc_id", "features", "values", *categories])

    return frugal(run)


@dataclass
class Linear:
    weights: np.ndarray
    extra: np.ndarray  # of the earlier categories' log odds
    bias: float

    def odds(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights=self.weights[feature] * value, minlength=len(earlier)) + earlier @ self.extra + self.bias


def _probability(odds: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def _log_odds(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def fit_linear(row: np.ndarray, feature: np.ndarray, value: np.ndarray, earlier: np.ndarray, y: np.ndarray, use: np.ndarray, steps: int = 120, rate: float = 0.1, l2: float = 1e-4) -> Linear:
    """Logistic regression with the classes balanced, over the features in use, by Adam over the whole sample."""
    width = len(use)
    value = value * use[feature]
    n, m = len(y), earlier.shape[1]
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share)) / n
    theta, first, second = np.zeros(width + m + 1), np.zeros(width + m + 1), np.zeros(width + m + 1)
    for t in range(1, steps + 1):
        odds = np.bincount(row, weights=theta[feature] * value, minlength=n) + earlier @ theta[width : width + m] + theta[-1]
        g = weight * (_probability(odds) - y)
        grad = np.concatenate([np.bincount(feature, weights=g[row] * value, minlength=width), earlier.T @ g, [g.sum()]])
        grad[:-1] += l2 * theta[:-1]
        first, second = 0.9 * first + 0.1 * grad, 0.999 * second + 0.001 * grad * grad
        theta -= rate * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Linear(theta[:width], theta[width : width + m], float(theta[-1]))


@dataclass
class Chain:
    """Fitted models of the categories in order, over the features ids."""

    categories: list[str]
    ids: dict[str, int] = field(default_factory=dict)
    models: list[Linear] = field(default_factory=list)

    def predict(self, row: np.ndarray, feature: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
        earlier = np.zeros((n, 0))
        for model in self.models:
            p = _probability(model.odds(row, feature, value, earlier))
            earlier = np.column_stack([earlier, _log_odds(p)])
        return _probability(earlier)


def _pairs(table: pa.Table, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    feature, value = (table.column(c).combine_chunks().take(pa.array(rows)) for c in ("features", "values"))
    return np.repeat(np.arange(len(rows)), feature.value_lengths().to_numpy()), feature.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy().astype(np.float64)


def fit_chain(docs: DataFrame, labels: DataFrame, categories: list[str], max_rows: int = 10_000, max_features: int = 2000, folds: int = 3) -> Chain:
    """Fit on about max_rows labelled rows at most; labels has doc_id and a 0/1 column per category.

    Labels with a null doc_id or a null category, and doc_ids without a document,
    are left out.  Without any usable row the chain predicts 0 for everything.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("int").alias(c) for c in categories]).dropna()
    total = known.count()
    picked = known.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1 << 20)) < int(min(1.0, max_rows / max(total, 1)) * (1 << 20)))
    sample = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(picked, "doc_id"), "sample")
    sums = sample.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in categories]).first()
    chain = Chain(categories)
    if not sums["n"]:
        return chain
    schema = "feature string, n long, " + ", ".join(f"{c} long" for c in categories)
    counts = sample.repartition("doc_id").mapInArrow(_count(categories), schema).groupBy("feature").agg(*[F.sum(c).alias(c) for c in ("n", *categories)])
    counts = materialize(counts.where("n >= 3"), "features")
    used: list[list[int]] = []
    for c in categories:
        p, n = max(sums[c], 1), max(sums["n"] - sums[c], 1)
        rate = F.col("n") / F.lit(float(sums["n"]))
        z = F.abs(F.col(c) / p - (F.col("n") - F.col(c)) / n) / F.sqrt(rate * (F.lit(1.0) - rate) * (1 / p + 1 / n) + 1e-12)
        best = counts.select("feature", z.alias("z")).orderBy(F.desc("z"), "feature").limit(max_features).collect()
        used.append([chain.ids.setdefault(r["feature"], len(chain.ids)) for r in best])
    table = sample.mapInArrow(_index(chain.ids, categories), "doc_id long, features array<int>, values array<float>, " + ", ".join(f"{c} int" for c in categories)).orderBy("doc_id", F.xxhash64("features", "values"), *categories).toArrow().combine_chunks()  # also where a doc_id is there several times, folds don't depend on the order of rows
    rows = np.arange(table.num_rows)
    fold = rows % folds
    earlier = np.zeros((len(rows), 0))
    whole = _pairs(table, rows)
    for k, c in enumerate(categories):
        y = table.column(c).to_numpy().astype(np.float64)
        use = np.zeros(len(chain.ids))
        use[used[k]] = 1
        chain.models.append(fit_linear(*whole, earlier, y, use))
        if k + 1 == len(categories):
            break
        out = np.zeros(len(rows))
        for f in range(folds):  # each row's probability comes from models that didn't see it
            seen, unseen = rows[fold != f], rows[fold == f]
            if len(seen) and len(unseen):
                model = fit_linear(*_pairs(table, seen), earlier[seen], y[seen], use)
                out[unseen] = model.odds(*_pairs(table, unseen), earlier[unseen])
        earlier = np.column_stack([earlier, _log_odds(_probability(out))])
    return chain


def _score(packed: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain: Chain = pickle.loads(packed)
        for b in slices(batches, "text", _SLICE):
            row, feature, value, _ = occurrences(b.column("text"), chain.ids)
            p = chain.predict(row, feature, value, b.num_rows) if chain.models else np.zeros((b.num_rows, len(chain.categories)))
            columns = list(b.columns) + [pa.array(p[:, k]) for k in range(len(chain.categories))]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, *[f"p_{c}" for c in chain.categories]])

    return frugal(run)


def score_chain(docs: DataFrame, chain: Chain) -> DataFrame:
    """The rows of docs with p_<category> of each category, from 0.0001 to 0.9999; columns of these names are replaced.

    Null and empty texts hold no word and get the probability of none; repeated
    rows are scored alike; an empty table stays empty.
    """
    rest = [c for c in docs.columns if c not in {f"p_{x}" for x in chain.categories}]
    plain = docs.select(*[f"`{c}`" for c in rest])
    schema = T.StructType([*plain.schema.fields, *[T.StructField(f"p_{c}", T.DoubleType()) for c in chain.categories]])
    return plain.mapInArrow(_score(pickle.dumps(chain)), schema)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_rows: int = 10_000) -> DataFrame:
    """The rows of docs with p_low_quality, p_toxic and toxic, the decision."""
    marks = labels.select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    chain = fit_chain(docs, marks, ["low_quality", "toxic"], max_rows)
    scored = score_chain(docs.select(*[f"`{c}`" for c in docs.columns if c != "toxic"]), chain)
    return scored.withColumn("toxic", F.col("p_toxic") >= threshold)
