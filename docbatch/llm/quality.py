"""Quality by compression: zstandard dictionaries of good and of bad texts.

A dictionary is built from labelled texts of each class.  A text is cut into
pieces of ``PIECE`` bytes, so that what a piece shares with a dictionary counts
all along a long text, and each piece is compressed with either dictionary.  The
difference of the two compressed sizes, divided by the size of the text, is the
only input of the score: a logistic calibration of it, fitted on out-of-fold
differences (dictionaries that didn't see the row).

Dictionaries and calibration are fitted on a sample of labelled rows, about
``rows_per_class`` of each class at most, picked by hash; of a row at most
``pieces_per_row`` pieces, spread evenly over the whole text, go into a
dictionary.  Every text is scored whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docbatch.llm.store import materialize
from docbatch.llm.textio import filled, frugal, slices

PIECE = 1024
LEVEL = 3
_ALL = -1  # the fold of the dictionaries that score; they see every row of the sample


def pieces(raw: bytes, size: int = PIECE) -> list[bytes]:
    return [raw[a : a + size] for a in range(0, len(raw), size)]


def spread(raw: bytes, n: int, size: int = PIECE) -> list[bytes]:
    """At most n pieces, evenly spaced over the whole text."""
    own = pieces(raw, size)
    return own if len(own) <= n else [own[i * len(own) // n] for i in range(n)]


def build_dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; the samples themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    plain = {"level": LEVEL, "write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if len(content) < 8:  # shorter ones aren't allowed
        return zstandard.ZstdCompressor(**plain)
    known = zstandard.ZstdCompressionDict(content)
    known.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(dict_data=known, **plain)


def difference(raw: bytes, good: zstandard.ZstdCompressor, bad: zstandard.ZstdCompressor) -> float:
    """Bytes that the good dictionary saves over the bad one, per byte of text; 0 for an empty text."""
    own = pieces(raw)
    return sum(len(bad.compress(p)) - len(good.compress(p)) for p in own) / max(len(raw), 1)


@dataclass
class Quality:
    """Two dictionaries and the calibration: probability 1 / (1 + exp(-(slope * difference + bias)))."""

    good: bytes
    bad: bytes
    slope: float
    bias: float

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * x + self.bias, -30, 30)))


def calibrate(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and bias of a weighted logistic regression with smoothed targets, by Newton steps; a slope below 0 becomes 0."""
    n1, n0 = float(weight[y == 1].sum()), float(weight[y == 0].sum())
    prior = float(np.log((n1 + 1) / (n0 + 1)))
    scale = float(x.std()) if len(x) else 0.0
    if not n1 or not n0 or scale == 0:
        return 0.0, prior
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    rows = np.column_stack([x / scale, np.ones(len(x))])

    def loss(t: np.ndarray) -> float:
        z = rows @ t
        return float((weight * (np.logaddexp(0, z) - target * z)).sum()) + 1e-6 * float(t @ t)

    theta = np.array([0.0, prior])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(rows @ theta, -30, 30)))
        grad = rows.T @ (weight * (p - target)) + 2e-6 * theta
        step = np.linalg.solve(rows.T @ (rows * (weight * p * (1 - p))[:, None]) + 2e-6 * np.eye(2), grad)
        rate = 1.0
        while rate > 1e-6 and loss(theta - rate * step) > loss(theta):
            rate /= 2
        theta = theta - rate * step
        if np.abs(rate * step).max() < 1e-9:
            break
    return (float(theta[0] / scale), float(theta[1])) if theta[0] > 0 else (0.0, prior)


def _binary(column: pa.Array) -> list[bytes]:
    return pc.cast(filled(column), pa.large_binary()).to_pylist()


def _build(size: int, per_row: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        ordered = table.sort_by([("place", "ascending"), ("doc_id", "ascending")])
        samples = [p for t in ordered.column("text").to_pylist() for p in spread((t or "").encode(), per_row)]
        return pa.table({"fold": [key[0].as_py()], "quality": [key[1].as_py()], "content": [build_dictionary(samples, size)]}, pa.schema([("fold", pa.int32()), ("quality", pa.int32()), ("content", pa.binary())]))

    return run


def _differences(contents: dict[int, tuple[bytes, bytes]], keep: list[str]):
    """Columns keep and the difference by the dictionaries of the row's fold (of all rows, where there is no column fold)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {f: (compressor(g), compressor(b)) for f, (g, b) in contents.items()}
        for b in slices(batches, "text"):
            folds = b.column("fold").to_pylist() if "fold" in b.schema.names else [_ALL] * b.num_rows
            x = [difference(raw, *ready[f]) for raw, f in zip(_binary(b.column("text")), folds, strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(x, pa.float64())], names=[*keep, "difference"])

    return frugal(run)


def fit_quality(docs: DataFrame, labels: DataFrame, rows_per_class: int = 2000, pieces_per_row: int = 4, dictionary_bytes: int = 112_640, folds: int = 3) -> Quality:
    """Fit on labels (doc_id, quality 0/1); see the module for what the sample holds.

    Labels with a null doc_id or quality, or another quality than 0 and 1, and
    doc_ids without a document are left out.  Of repeated labels of a doc_id the
    smallest counts, of repeated documents the smallest text.  Without any row
    of one class there is nothing to tell apart: every text gets the same score.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = dict(known.groupBy("quality").count().collect())
    share = [int(min(1.0, rows_per_class / max(total.get(q, 0), 1)) * (1 << 30)) for q in (0, 1)]
    picked = known.withColumn("place", F.xxhash64("doc_id", F.lit("quality"))).where(F.pmod("place", F.lit(1 << 30)) < F.when(F.col("quality") == 1, share[1]).otherwise(share[0]))
    # the sample is at most about 2 * rows_per_class rows of three numbers
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(picked), "doc_id")
    sample = texts.groupBy("doc_id", "quality", "place").agg(F.coalesce(F.min("text"), F.lit("")).alias("text"))
    sample = materialize(sample.withColumn("fold", F.pmod(F.xxhash64("place"), F.lit(folds)).cast("int")), "labelled")
    seen = sample.withColumn("fold", F.explode(F.array(F.lit(_ALL), *[F.when(F.col("fold") != f, F.lit(f)) for f in range(folds)]))).where("fold IS NOT NULL")
    built = seen.groupBy("fold", "quality").applyInArrow(_build(dictionary_bytes, pieces_per_row), "fold int, quality int, content binary").collect()  # two dictionaries a fold
    own = {(r["fold"], r["quality"]): bytes(r["content"]) for r in built}
    contents = {f: (own.get((f, 1), b""), own.get((f, 0), b"")) for f in (_ALL, *range(folds))}
    scored = sample.mapInArrow(_differences({f: c for f, c in contents.items() if f != _ALL}, ["doc_id", "quality"]), "doc_id long, quality int, difference double")
    rows = sorted((r["doc_id"], r["quality"], r["difference"]) for r in scored.collect())  # numbers of the sample's rows
    y = np.array([q for _, q, _ in rows], np.int64)
    drawn = [max(int((y == q).sum()), 1) for q in (0, 1)]
    weight = np.array([total[int(q)] / drawn[int(q)] for q in y])
    return Quality(*contents[_ALL], *calibrate(np.array([x for _, _, x in rows]), y, weight))


def _score(packed: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Quality = pickle.loads(packed)
        good, bad = compressor(model.good), compressor(model.bad)
        for b in slices(batches, "text"):
            x = np.array([difference(raw, good, bad) for raw in _binary(b.column("text"))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(x), pa.array(model.probability(x))], names=[*b.schema.names, "difference", "score"])

    return frugal(run)


def score_quality(docs: DataFrame, model: Quality) -> DataFrame:
    """The rows of docs with difference (bytes saved per byte of text) and score, from 0 to 1.

    Only the text goes into the score.  Null and empty texts have the difference
    0 and the score of that; repeated rows are scored alike; an empty table stays
    empty; columns named difference or score are replaced.
    """
    plain = docs.select(*[f"`{c}`" for c in docs.columns if c not in ("difference", "score")])
    schema = T.StructType([*plain.schema.fields, T.StructField("difference", T.DoubleType()), T.StructField("score", T.DoubleType())])
    return plain.mapInArrow(_score(pickle.dumps(model)), schema)
