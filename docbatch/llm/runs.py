"""Periodic runs of words, by the branching tandem repeats of a suffix tree.

A run is a stretch of words that repeats its first q words, q its smallest
period.  The suffix trees of the texts of a slice are held as arrays: the sorted
suffixes, and between neighbours their common lengths.  A boundary between two
neighbours is a (binary) node of the tree: its depth is the common length, its
leaf list a range of the sorted suffixes, its two children the ranges at either
side.  For each node only the leaves of the smaller child are visited: a leaf at
place i of a node of depth d is half of a branching tandem repeat when the
suffix at i + d (or i - d) is a leaf of the other child.  A repeat is then
rotated to the left as far as it goes, which gives a maximal run; of repeats
with the same ends the shortest period stays.

Trees are built only over stretches of words that can hold a run: where a run
has at least ``MIN_WORDS`` words and three periods, each 8 words inside it occur
again within it, one period on or back.  So words none of whose surrounding
8 words occur twice in the stretch end it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docbatch.llm.textio import frugal, mix64, slices, split_words, window_hashes, word_hashes

MIN_WORDS = 24
MIN_PERIODS = 3
_GRAM = 8  # at most 9: a run of 24 words with period q <= _GRAM - 2 must hold q + q + _GRAM - 1 words
_PAIRS = 1 << 20  # leaves visited at once

RUNS = "array<struct<start long, length long, period long>>"


def stretches(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the stretches of words, inside rows, that can hold a run."""
    starts, ends = offsets[:-1], offsets[1:]
    for _ in range(4):  # each round only narrows the stretches
        long = ends - starts >= MIN_WORDS
        starts, ends = starts[long], ends[long]
        sizes = ends - starts
        if not len(sizes):
            return starts, ends
        before = np.cumsum(sizes) - sizes
        place = np.arange(sizes.sum()) + np.repeat(starts - before, sizes)
        own, last = np.repeat(np.arange(len(sizes)), sizes), np.repeat(ends, sizes)
        whole = place + _GRAM <= last
        grams = window_hashes(hashes[place], np.repeat(before + sizes, sizes), _GRAM)[whole]
        grams = grams ^ mix64(own[whole].astype(np.uint64))  # apart by stretch
        order = np.argsort(grams)
        same = grams[order][1:] == grams[order][:-1]
        twice = np.zeros(len(grams), bool)
        twice[order] = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        at = place[whole][twice]
        if not len(at):
            return starts[:0], ends[:0]
        cut = np.flatnonzero((at[1:] != at[:-1] + 1) | (own[whole][twice][1:] != own[whole][twice][:-1]))
        first, final = at[np.concatenate([[0], cut + 1])], at[np.concatenate([cut, [len(at) - 1]])] + _GRAM
        if len(first) == len(starts) and (first == starts).all() and (final == ends).all():
            break
        starts, ends = first, final
    return starts, ends


def _renamed(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Equal keys to equal numbers, in their order."""
    own = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], own[1:] != own[:-1]])[: len(own)])
    return out


def suffixes(text: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """The sorted suffixes, and names of the substrings of length 1, 2, 4 ... (equal ones have equal names) until all differ."""
    n = len(text)
    order = np.argsort(text, kind="stable")
    names = [_renamed(text, order)]
    while names[-1].max(initial=0) + 1 < n:
        name, step = names[-1], 1 << (len(names) - 1)
        after = np.zeros(n, np.int64)
        after[: n - step] = name[step:] + 1
        key = name * (n + 1) + after
        order = np.argsort(key, kind="stable")
        names.append(_renamed(key, order))
    return order, names


def common(names: list[np.ndarray], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many words the suffixes at a and b (a differs from b) begin with alike; back: the prefixes that end before a and b end with alike."""
    n, out = len(names[0]), np.zeros(len(a), np.int64)
    for k in range(len(names) - 1, -1, -1):
        if back:
            x, y = a - out - (1 << k), b - out - (1 << k)
            inside = (x >= 0) & (y >= 0)
        else:
            x, y = a + out, b + out
            inside = np.maximum(x, y) + (1 << k) <= n
        out += np.where(inside & (names[k][np.where(inside, x, 0)] == names[k][np.where(inside, y, 0)]), 1 << k, 0)
    return out


def _reach(depth: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each boundary of at: the range of sorted suffixes [left, right) that its node spans; the later of equal depths is the lower node's parent."""
    n = len(depth)
    table = [depth]
    while 2 << (len(table) - 1) <= n:
        half = 1 << (len(table) - 1)
        table.append(np.minimum(table[-1][:-half], table[-1][half:]))
    own, left, right = depth[at], at.copy(), at + 1
    for k in range(len(table) - 1, -1, -1):
        size = 1 << k
        x = left - size
        left = np.where((x >= 0) & (table[k][np.clip(x, 0, n - size)] >= own), x, left)
        right = np.where((right + size <= n) & (table[k][np.clip(right, 0, n - size)] > own), right + size, right)
    return left, right + 1


def tandem_runs(text: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and periods of the maximal repetitions of the text with at least MIN_WORDS words and MIN_PERIODS periods.

    text is made of parts that have no number in common, each ended by a number
    that occurs once; limit is, at each place, the longest period that its part
    can hold.
    """
    nothing = (np.zeros(0, np.int64),) * 3
    if len(text) < 2:
        return nothing
    order, names = suffixes(text)
    depth = common(names, order[:-1], order[1:])
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    nodes = np.flatnonzero((depth > 0) & (depth <= limit[order[:-1]]))
    if not len(nodes):
        return nothing
    left, right = _reach(depth, nodes)
    smaller = nodes + 1 - left <= right - nodes - 1  # the left child's leaves are [left, node], the right one's [node + 1, right)
    low, high = np.where(smaller, left, nodes + 1), np.where(smaller, nodes + 1, right)
    far_low, far_high = np.where(smaller, nodes + 1, left), np.where(smaller, right, nodes + 1)
    total = np.cumsum(high - low)
    found, done = [], 0
    while done < len(nodes):  # nodes whose leaves fit into memory together, or one node
        to = max(int(np.searchsorted(total, (total[done - 1] if done else 0) + _PAIRS, side="right")), done + 1)
        sizes = (high - low)[done:to]
        node = np.repeat(np.arange(done, to), sizes)
        leaf = order[np.arange(len(node)) + np.repeat(low[done:to] - np.cumsum(sizes) + sizes, sizes)]
        d = depth[nodes[node]]
        for start, other in ((leaf, leaf + d), (leaf - d, leaf - d)):
            inside = (other >= 0) & (other < len(text))
            there = place[np.where(inside, other, 0)]
            hit = inside & (there >= far_low[node]) & (there < far_high[node])
            found.append(np.column_stack([start[hit], d[hit]]))
        done = to
    start, period = np.concatenate(found).T
    turned = common(names, start, start + period, back=True)
    first, end = start - turned, start + 2 * period
    length = end - first
    enough = (length >= MIN_WORDS) & (length >= MIN_PERIODS * period)
    first, end, period = first[enough], end[enough], period[enough]
    pick = np.lexsort((period, end, first))
    first, end, period = first[pick], end[pick], period[pick]
    new = np.ones(len(first), bool)
    new[1:] = (first[1:] != first[:-1]) | (end[1:] != end[:-1])
    first, end, period = first[new], end[new], period[new]
    by = np.lexsort((period, first))
    return first[by], end[by], period[by]


def word_runs(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts (places among all words of all rows), lengths and periods of the runs inside rows, by start, then period."""
    starts, ends = stretches(hashes, offsets)
    sizes = ends - starts
    if not len(sizes):
        return (np.zeros(0, np.int64),) * 3
    before = np.cumsum(sizes + 1) - sizes - 1
    into = np.arange(sizes.sum()) + np.repeat(before - np.cumsum(sizes) + sizes, sizes)
    source = np.arange(sizes.sum()) + np.repeat(starts - np.cumsum(sizes) + sizes, sizes)
    distinct, name = np.unique(hashes[source], return_inverse=True)
    text = np.empty(sizes.sum() + len(sizes), np.int64)
    text[into] = name + np.repeat(np.arange(len(sizes)), sizes) * len(distinct)
    text[before + sizes] = len(distinct) * len(sizes) + np.arange(len(sizes))
    limit = np.repeat(sizes // MIN_PERIODS, sizes + 1)
    first, end, period = tandem_runs(text, limit)
    part = np.searchsorted(before, first, side="right") - 1
    return first - before[part] + starts[part], end - first, period


def _dropped(start: np.ndarray, length: np.ndarray, period: np.ndarray, n: int) -> np.ndarray:
    """True for words that a run contains after its first period."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, start + period, 1)
    np.add.at(change, start + length, -1)
    return np.cumsum(change)[:n] > 0


def _find(id_column: str, prepare: Callable | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
        for b in slices(batches, "text", 2 << 20):
            words, offsets = split_words(b.column("text"))
            if prepare is not None:
                words = words.take(pa.array(prepare(b.column(id_column), offsets)))
            with np.errstate(over="ignore"):
                start, length, period = word_runs(word_hashes(words), offsets)
            kept = np.flatnonzero(~_dropped(start, length, period, len(words)))
            rows = np.searchsorted(start, offsets)
            own = pa.StructArray.from_arrays([pa.array(start - offsets[np.searchsorted(offsets, start, side="right") - 1]), pa.array(length), pa.array(period)], fields=list(kind))
            texts = pa.ListArray.from_arrays(pa.array(np.searchsorted(kept, offsets).astype(np.int32)), words.take(pa.array(kept)).cast(pa.string()))
            columns = [*b.columns, pa.array(np.diff(offsets)), pa.ListArray.from_arrays(pa.array(rows.astype(np.int32)), own), pc.binary_join(texts, " ")]
            yield pa.RecordBatch.from_arrays(columns, names=[*b.schema.names, "n_words", "runs", "collapsed"])

    return frugal(run)


def find_runs(docs: DataFrame, id_column: str = "doc_id", prepare: Callable | None = None) -> DataFrame:
    """The rows of docs with n_words, runs (by start, then period) and collapsed, the text without the repeats of its runs.

    Words are what stands between ASCII white space; collapsed keeps a word
    unless a run contains it after the run's first period, and joins words by
    one space.  prepare(ids, offsets) may give other places for the words of a
    slice before the search (places among the slice's words; row r has
    offsets[r] to offsets[r + 1]).  Null, empty and short texts have no runs;
    repeated rows are treated alike; an empty table stays empty; columns named
    n_words, runs or collapsed are replaced.  Words are compared by 64-bit hashes.
    """
    plain = docs.select(*[f"`{c}`" for c in docs.columns if c not in ("n_words", "runs", "collapsed")])
    schema = T.StructType([*plain.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(T.StructType([T.StructField(c, T.LongType()) for c in ("start", "length", "period")]))), T.StructField("collapsed", T.StringType())])
    return plain.mapInArrow(_find(id_column, prepare), schema)


def best_run(runs: list[dict]) -> dict | None:
    """The run with the greatest length / period; of equal ones the first by start, then period."""
    return min(runs, key=lambda r: (Fraction(-r["length"], r["period"]), r["start"], r["period"]), default=None)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "collapsed"):
        out = {c: [] for c in ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
        for runs, text in zip(b.column("runs").to_pylist(), b.column("collapsed").to_pylist(), strict=True):
            best = best_run(runs)
            out["n_runs"].append(len(runs))
            for c in ("start", "length", "period"):
                out[c].append(best and best[c])
            out["exponent_milli"].append(best and 1000 * best["length"] // best["period"])
            out["runs_sha256"].append(hashlib.sha256("".join(f"{r['start']},{r['length']},{r['period']}\n" for r in runs).encode()).hexdigest())
            out["collapsed_sha256"].append(hashlib.sha256(text.encode()).hexdigest())
        columns = [pa.array(v, pa.string() if c.endswith("sha256") else pa.int64()) for c, v in out.items()]
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *columns], names=["doc_id", *out])


def run_digests(found: DataFrame) -> DataFrame:
    """Per row of find_runs: n_runs, the run with the greatest exponent (null without runs), digests of all runs and of the collapsed text."""
    rows = found.select(F.col("doc_id").cast("long").alias("doc_id"), "runs", "collapsed")
    return rows.mapInArrow(_digests, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")
