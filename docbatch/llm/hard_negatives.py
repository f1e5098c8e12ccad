"""Hard negatives of anchors, by bit-sliced integer products.

Components are integers in offset binary, so that a vector is the sum of its bit
planes.  The products of a block of anchors with a block of rows are built plane
by plane, the most significant first: what the planes to come can add lies
between the anchor's negative and its positive components times their weight,
so every score has an interval, and each plane halves it.  A row is dropped for
an anchor as soon as its interval can't reach what the anchor still needs (its
window of scores, and the score of its k-th best row so far) or lies beyond it.

Anchors and rows meet in a grid of cells, each of at most about
``anchors_per_cell`` anchors and ``rows_per_cell`` rows, so the number of cells
grows with the tables and the size of a task doesn't.  A cell gives its best k
rows of each anchor, and a ranking over the cells the best k of all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docbatch.llm.store import materialize

_TILE = 512, 4096  # anchors and rows whose products are built together
_FIRST = 256  # rows of the first tile: its scores tell what later rows must reach
_SPARSE = 0.2  # from this share of pairs on, those left are listed
_GATHERED = 1 << 16  # listed pairs whose planes are gathered at once
_LIMIT = 1 << 22  # integers beyond it would leave the 53 bits of exact sums


def integer_vectors(table: DataFrame, scale: float = 256.0, vec_id: str = "vec_id", vector: str = "embedding", label: str | Column = "label") -> DataFrame:
    """Rows (vec_id, label, q): q holds floor(scale * component), computed in doubles.

    Rows with a null vec_id, label or vector, or with a null or non-finite
    component are left out.  Components beyond 2^22 / scale raise an error.
    """
    mark = F.col(label) if isinstance(label, str) else label
    rows = table.select(F.col(vec_id).cast("long").alias("vec_id"), mark.cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v")).where("vec_id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL")
    rows = rows.where(~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    too_large = F.raise_error(F.lit("a component is too large for exact products"))
    whole = F.transform("v", lambda x: F.when(F.abs(x) * scale < _LIMIT, F.floor(x * scale)).otherwise(too_large).cast("int"))
    return rows.select("vec_id", "label", whole.alias("q"))


def _matrix(column: pa.ChunkedArray, width: int) -> np.ndarray:
    """The lists as rows of a matrix; shorter ones end with zeros."""
    sizes = pc.list_value_length(column).to_numpy()
    flat = pc.list_flatten(column).to_numpy()
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int32)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


class Best:
    """The k best (score, id) of each slot: higher scores first, ties by smaller id."""

    def __init__(self, slots: int, k: int) -> None:
        self.k = k
        self.slot, self.score, self.ids = (np.zeros(0, np.int64) for _ in range(3))
        self.least = np.full(slots, -np.inf)  # score of the k-th, where there are k

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = (np.concatenate(x) for x in ((self.slot, slot), (self.score, score), (self.ids, ids)))
        order = np.lexsort((ids, -score, slot))
        slot, score, ids = slot[order], score[order], ids[order]
        rank = np.arange(len(slot)) - np.searchsorted(slot, slot)
        kept = rank < self.k
        self.slot, self.score, self.ids = slot[kept], score[kept], ids[kept]
        last = rank == self.k - 1
        self.least[slot[last]] = score[last]


def best_products(anchors: np.ndarray, anchor_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, low: np.ndarray, high: np.ndarray, k: int, labels: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[Best, dict[str, int]]:
    """The k best rows of every anchor in each of its windows [low, high] (anchors x windows; one with low > high takes none).

    Slot a * windows + w holds window w of anchor a.  Rows with the anchor's own
    id, and with labels (of anchors, of rows) those of the anchor's label, don't
    count.  The second result counts the pairs that were there and those whose
    every plane was read.
    """
    n, windows = low.shape
    best, seen = Best(n * windows, k), {"pairs": 0, "whole": 0}
    if not n or not len(rows):
        return best, seen
    bits = max(int(np.abs(rows.astype(np.int64)).max()).bit_length() + 1, 1)
    exact = np.float32 if np.abs(anchors.astype(np.int64)).sum(axis=1).max() < 1 << 24 else np.float64
    for first in range(0, n, _TILE[0]):
        to = min(first + _TILE[0], n)
        a = anchors[first:to].astype(exact)
        wide = a.astype(np.float64)
        above, below = np.maximum(wide, 0).sum(axis=1), np.minimum(wide, 0).sum(axis=1)
        lows, highs = low[first:to], high[first:to]
        top = highs.max(axis=1, initial=-np.inf)
        at, size = 0, _FIRST
        while at < len(rows):
            end = min(at + size, len(rows))
            need = np.maximum(lows, best.least.reshape(n, windows)[first:to])
            least = np.where(need <= highs, need, np.inf).min(axis=1, initial=np.inf)
            x = rows[at:end].astype(np.int64) + (1 << (bits - 1))
            planes = [((x >> b) & 1).astype(exact) for b in range(bits)]
            score = np.repeat(-(2.0 ** (bits - 1)) * wide.sum(axis=1)[:, None], end - at, axis=1)
            seen["pairs"] += score.size
            for b in range(bits - 1, -1, -1):  # dense planes, until few pairs are left
                score += 2.0**b * (a @ planes[b].T)
                rest = 2.0**b - 1
                alive = (score >= (least - rest * above)[:, None]) & (score <= (top - rest * below)[:, None])
                if np.count_nonzero(alive) <= _SPARSE * alive.size:
                    break
            left, right = np.nonzero(alive)
            for cut in range(0, len(left), _GATHERED):
                i, j = left[cut : cut + _GATHERED], right[cut : cut + _GATHERED]
                apart = anchor_ids[first:to][i] != row_ids[at:end][j]
                if labels is not None:
                    apart &= labels[0][first:to][i] != labels[1][at:end][j]
                i, j = i[apart], j[apart]
                own = score[i, j]
                for c in range(b - 1, -1, -1):  # the planes left, for listed pairs
                    own += 2.0**c * np.einsum("ij,ij->i", a[i], planes[c][j], dtype=np.float64)
                    rest = 2.0**c - 1
                    kept = (own + rest * above[i] >= least[i]) & (own + rest * below[i] <= top[i])
                    i, j, own = i[kept], j[kept], own[kept]
                seen["whole"] += len(i)
                for w in range(windows):
                    inside = (own >= need[i, w]) & (own <= highs[i, w])
                    best.add((first + i[inside]) * windows + w, own[inside].astype(np.int64), row_ids[at:end][j[inside]])
            at, size = end, min(size * 2, _TILE[1])
    return best, seen


def _width(*columns: pa.ChunkedArray) -> int:
    return max((pc.max(pc.list_value_length(c)).as_py() or 0 for c in columns), default=0)


_FOUND = pa.schema([("anchor", pa.int64()), ("window", pa.int32()), ("found_id", pa.int64()), ("score", pa.int64())])


def _result(keys: np.ndarray, best: Best, windows: int) -> pa.Table:
    return pa.table([keys[best.slot // windows], (best.slot % windows).astype(np.int32), best.ids, best.score], schema=_FOUND)


def _positives(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Best rows of the anchor's own label: labels one after another, over the rows sorted by label."""
        width = _width(left["q"], right["q"])
        right = right.sort_by("label")
        a, x = _matrix(left["q"], width), _matrix(right["q"], width)
        keys, ids, row_ids = left["anchor"].to_numpy(), left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        marks, known = left["label"].to_numpy(), right["label"].to_numpy()
        out = []
        for mark in np.unique(marks):
            own = np.flatnonzero(marks == mark)
            p, q = np.searchsorted(known, [mark, mark + 1])
            free = np.full((len(own), 1), np.inf)
            out.append(_result(keys[own], best_products(a[own], ids[own], x[p:q], row_ids[p:q], -free, free, k)[0], 1))
        return pa.concat_tables(out) if out else _FOUND.empty_table()

    return run


def _negatives(k: int, low: int, high: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        """Best rows of other labels, in the window that each positive's score gives."""
        width = _width(left["q"], right["q"])
        scores = left["positives"].to_pylist()
        windows = max(map(len, scores), default=0)
        if not windows:
            return _FOUND.empty_table()
        lows, highs = np.full((len(scores), windows), np.inf), np.full((len(scores), windows), -np.inf)
        for r, own in enumerate(scores):
            for w, p in enumerate(own):
                lows[r, w], highs[r, w] = -(-low * p // 100), high * p // 100
        ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        best, _ = best_products(_matrix(left["q"], width), ids[0], _matrix(right["q"], width), ids[1], lows, highs, k, (left["label"].to_numpy(), right["label"].to_numpy()))
        return _result(left["anchor"].to_numpy(), best, windows)

    return run


def _cells(anchors: DataFrame, rows: DataFrame, down: int, across: int, kernel, k: int) -> DataFrame:
    """The kernel in every cell of the grid, and of each anchor's window the k best of all cells, with their rank from 1."""
    left = anchors.withColumn("_i", F.pmod(F.xxhash64("anchor"), F.lit(down))).withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(across - 1)))).withColumn("_j", F.col("_j").cast("long"))
    # dealt by place, so that no id or copy can fill a cell
    right = rows.withColumn("_j", F.pmod(F.monotonically_increasing_id(), F.lit(across))).withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumn("_i", F.col("_i").cast("long"))
    found = left.groupBy("_i", "_j").cogroup(right.groupBy("_i", "_j")).applyInArrow(kernel, "anchor long, window int, found_id long, score long")
    order = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(vectors: DataFrame, is_anchor: str | Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, anchors_per_cell: int = 8192, rows_per_cell: int = 65_536) -> DataFrame:
    """Rows (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) from vectors (vec_id, label, q), see integer_vectors.

    An anchor's positives are its best rows of the same label, its negatives for
    each positive the best rows of other labels whose score is between low and
    high percent of the positive's; ties go to the smaller vec_id.  An anchor
    without positives, or whose positive's window is empty (scores below 0), has
    no rows.  Repeated rows count each for itself, but rows with one vec_id are
    never each other's positives or negatives; shorter vectors end with zeros; an
    empty table gives none.
    """
    condition = F.expr(is_anchor) if isinstance(is_anchor, str) else is_anchor
    anchors = materialize(vectors.where(condition).withColumn("anchor", F.monotonically_increasing_id()), "anchors")
    total, chosen = vectors.count(), anchors.count()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    down = max(math.ceil(chosen / anchors_per_cell), 1)
    across = max(math.ceil(total / rows_per_cell), min(2 * cores, math.ceil(total / 1024)), 1)
    found = _cells(anchors, vectors, down, across, _positives(positives), positives)
    near = materialize(found.select("anchor", F.col("rank").alias("place"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")
    scores = near.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("_p")).select("anchor", F.transform("_p", lambda p: p["positive_score"]).alias("positives"))
    far = _cells(anchors.join(scores, "anchor"), vectors, down, across, _negatives(negatives, low, high), negatives)
    far = far.select("anchor", (F.col("window") + 1).alias("place"), "rank", F.col("found_id").alias("negative_id"), F.col("score").alias("negative_score"))
    ids = anchors.select("anchor", F.col("vec_id").alias("anchor_id"))
    return far.join(near, ["anchor", "place"]).join(ids, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
