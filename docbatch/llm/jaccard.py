"""Exact Jaccard join of documents as a metric-space join with pivots.

Jaccard distance is a metric, and so is the size of the symmetric difference.
Distances between unrelated texts are all 1, which no pivot can tell apart, so
the space is cut first where linked documents must meet: each document lies in
the regions of its rarest shingles, n - ceil(0.75 n) + 1 of them, which two sets
of similarity 0.75 can't all differ in.  In each region a member has a window of
sizes: from the empty set as pivot a linked set is no farther than the
difference allows, less the rarer shingles that it can't share there (see
`windows`).  A member in no other's window leaves the region.

In a region the member with most rare shingles in common with others is the
pivot; members near it are linked to it, and what is then connected needs no
further pair.  Regions with few pairs left are joined within the windows of size
and of distance to the pivot; sketches of the sets drop pairs that can't link
before their texts are sent.  Where many pairs are left, the regions with one
pivot become one cell around it, a document at a boundary lying in several.  A
cell too large for one block is cut again into the Voronoi regions of pivots of
its own, with triangle windows at the boundaries, recursively, as long as that
saves copies; then it is joined exactly, block by block of its members.

Sets are compared by 64-bit hashes of their shingles, nodes (distinct sets) by
128-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docbatch.llm.graph import components
from docbatch.llm.store import materialize
from docbatch.llm.textio import frugal, mix64, shingle_sets, slices

SHINGLE = 5
#: 100 * intersection >= PERCENT * union
PERCENT = 75
_RADIUS = 1 - PERCENT / 100
_COUNTED, _AT_ONCE = 8192, 1 << 22  # documents, and shingles, that are counted together
_OFTEN = 2  # shingles this frequent among them are reported


def _node(own: np.ndarray, bits: int = 64) -> tuple[int, int]:
    """128 bits that name a set: its number, of so many bits, and the rest to tell apart sets that share one."""
    whole = xxhash.xxh3_128_intdigest(own.tobytes())
    return (whole & 2**bits - 1) - 2**63, (whole >> 64) - 2**63


def _numbers(sets: list[np.ndarray], bits: int, clashing: frozenset) -> list[int]:
    return [second if first in clashing else first for first, second in (_node(s, bits) for s in sets)]


_STATS = "doc_id long, n long, node long, check long, sketch binary, key long, times long"
_LEAST = 256


def _sketch(own: np.ndarray) -> bytes:
    """How many shingles fall to each class of hashes, up to 255; a power of two classes, a quarter of the shingles or more."""
    classes = max(_LEAST, 1 << (max(len(own) // 4, 1) - 1).bit_length())
    return np.minimum(np.bincount((own & np.uint64(classes - 1)).astype(np.int64), minlength=classes), 255).astype(np.uint8).tobytes()


def _gap(a: bytes, b: bytes) -> int:
    """L1 distance of two sketches, the finer one folded to the classes of the other.

    Folding and a common upper bound of counts only bring sketches nearer, so
    this stays a lower bound of the symmetric difference.
    """
    x, y = (np.frombuffer(v, np.uint8).astype(np.int64) for v in (a, b))
    n = min(len(x), len(y))
    if len(x) == len(y):
        return int(np.abs(x - y).sum())
    # a class at its upper bound may hold more, so it proves nothing
    sure = ((x.reshape(-1, n) < 255).all(axis=0)) & ((y.reshape(-1, n) < 255).all(axis=0))
    return int(np.abs(x.reshape(-1, n).sum(axis=0) - y.reshape(-1, n).sum(axis=0))[sure].sum())


@frugal
def _stats(batches: Iterator[pa.RecordBatch], bits: int = 64) -> Iterator[pa.RecordBatch]:
    """A row per document, and rows of (key, times) for shingles that are frequent among neighbours."""
    held: list[np.ndarray] = []
    docs = shingles = 0

    def frequent() -> pa.RecordBatch:
        keys, times = np.unique(np.concatenate(held), return_counts=True)
        keys, times = keys[times >= _OFTEN], times[times >= _OFTEN]
        none = pa.nulls(len(keys), pa.int64())
        return pa.RecordBatch.from_arrays([none, none, none, none, pa.nulls(len(keys), pa.binary()), pa.array(keys.view(np.int64)), pa.array(times)], names=["doc_id", "n", "node", "check", "sketch", "key", "times"])

    for b in slices(batches, "text"):
        sets = shingle_sets(b.column("text"), SHINGLE)
        node, check = zip(*(_node(s, bits) for s in sets), strict=True)
        none = pa.nulls(len(sets), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(map(_sketch, sets), pa.binary()), none, none], names=["doc_id", "n", "node", "check", "sketch", "key", "times"])
        held += sets
        docs, shingles = docs + len(sets), shingles + sum(map(len, sets))
        if docs >= _COUNTED or shingles >= _AT_ONCE:
            yield frequent()
            held, docs, shingles = [], 0, 0
    if held:
        yield frequent()


def prefix(own: np.ndarray, common: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The first n - ceil(t n) + 1 shingles in the global order: rare ones by hash, then common ones by how common they are."""
    n = len(own)
    size = n - (PERCENT * n + 99) // 100 + 1
    if not len(common):
        return own[:size]
    at = np.minimum(np.searchsorted(common, own), len(common) - 1)
    often = common[at] == own
    rare = own[~often]
    if len(rare) >= size:
        return rare[:size]
    return np.concatenate([rare, own[often][np.argsort(order[at[often]], kind="stable")][: size - len(rare)]])


def quantised(n: np.ndarray) -> np.ndarray:
    """Sizes from 1 on as 16 bits that keep their order: exponent and the upper bits of the fraction."""
    return ((np.asarray(n, np.float32).view(np.uint32) - np.uint32(127 << 23)) >> np.uint32(13)).astype(np.uint16)


def windows(n: int, places: int) -> np.ndarray:
    """The largest set that a set of n shingles can link with when the first shingle they share is at each place of its order.

    Sets x and y link when they share t / (1 + t) of both sizes together or
    more; from place i on x has n - i shingles to share.
    """
    return ((100 + PERCENT) * (n - np.arange(places)) - PERCENT * n) // PERCENT


def _postings(common: np.ndarray, order: np.ndarray, shares: np.ndarray, buckets: int, bits: int, clashing: frozenset):
    """Rows (bucket, salt, keys, nodes, windows); a key that is too frequent for one task is dealt out by salt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            sets = [s for s in shingle_sets(b.column("text"), SHINGLE) if len(s)]
            own = dict(zip(_numbers(sets, bits, clashing), sets, strict=True))
            if not own:
                continue
            parts = [prefix(s, common, order) for s in own.values()]
            places = [len(p) for p in parts]
            keys = np.concatenate(parts)
            nodes = np.repeat(np.array(list(own), np.int64), places)
            caps = np.concatenate([windows(len(s), k) for s, k in zip(own.values(), places, strict=True)])
            window = np.repeat(quantised(np.array([len(s) for s in own.values()])), places).astype(np.uint32) << np.uint32(16) | quantised(caps)
            with np.errstate(over="ignore"):
                bucket = (mix64(keys) % np.uint64(buckets)).astype(np.int64)
                salt = np.zeros(len(keys), np.int64)
                if len(common):
                    at = np.minimum(np.searchsorted(common, keys), len(common) - 1)
                    many = (common[at] == keys) & (shares[at] > 1)
                    salt[many] = (mix64(nodes[many].view(np.uint64)) % shares[at[many]].astype(np.uint64)).astype(np.int64) + 1
            by = np.lexsort((bucket, salt))
            keys, nodes, bucket, salt, window = (keys[by] >> np.uint64(32)).astype(np.uint32), nodes[by], bucket[by], salt[by], window[by]
            first = np.flatnonzero(np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (salt[1:] != salt[:-1])]))
            ends = np.append(first, len(keys))
            blob = lambda x, k=len(first), e=ends: pa.Array.from_buffers(pa.binary(), k, [None, pa.py_buffer((e * x.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(x))])
            yield pa.RecordBatch.from_arrays([pa.array(bucket[first]), pa.array(salt[first]), blob(keys), blob(nodes), blob(window)], names=["bucket", "salt", "keys", "nodes", "windows"])

    return frugal(run)


def _others(values: np.ndarray, first: np.ndarray, sizes: np.ndarray, best, none: int) -> np.ndarray:
    """The best of the other values of each group."""
    top = np.repeat(best.reduceat(values, first), sizes)
    at_top = values == top
    alone = np.repeat(np.add.reduceat(at_top.astype(np.int64), first), sizes) == 1
    second = np.repeat(best.reduceat(np.where(at_top, none, values), first), sizes)
    return np.where(at_top & alone, second, top)


def _regions(table: pa.Table) -> pa.Table:
    """The regions of a bucket with members in each other's windows: (region, node, size, cap).

    Keys that share the 32 bits sent are one region, which loses nothing.
    """
    whole = lambda c, kind: np.frombuffer(b"".join(table.column(c).to_pylist()), kind)
    keys, nodes, window = whole("keys", np.uint32), whole("nodes", np.int64), whole("windows", np.uint32)
    order = np.lexsort((-window.astype(np.int64), nodes, keys))
    keys, nodes, window = keys[order], nodes[order], window[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (nodes[1:] != nodes[:-1])
    keys, nodes, size, cap = keys[new], nodes[new], (window[new] >> np.uint32(16)).astype(np.int64), (window[new] & np.uint32(0xFFFF)).astype(np.int64)
    bucket, salt = table.column("bucket")[0].as_py(), table.column("salt")[0].as_py()
    with np.errstate(over="ignore"):
        if salt:  # part of its members only
            region = mix64(keys.astype(np.uint64) | np.uint64(bucket << 32)).view(np.int64)
        else:
            for _ in range(3):
                first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
                if not len(first):
                    break
                sizes = np.diff(np.append(first, len(keys)))
                kept = (_others(size, first, sizes, np.minimum, 1 << 20) <= cap) & (_others(cap, first, sizes, np.maximum, -1) >= size)
                keys, nodes, size, cap = keys[kept], nodes[kept], size[kept], cap[kept]
            if not len(keys):
                return pa.table({c: pa.array([], pa.int64()) for c in ("region", "node", "size", "cap")})
            first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
            # regions with equal members get one number; unequal ones that share it are joined together, which loses nothing
            region = np.repeat(np.add.reduceat(mix64(nodes.view(np.uint64)), first).view(np.int64), np.diff(np.append(first, len(keys))))
    return pa.table({"region": pa.array(region), "node": pa.array(nodes), "size": pa.array(size), "cap": pa.array(cap)})


@frugal
def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (pivot, salt, member): each pivot's text comes before the texts to compare it with."""
    pivot, own = None, None
    for b in slices(batches, "text"):
        a, p, common, whole = [], [], [], []
        for s, node, at, member in zip(shingle_sets(b.column("text"), SHINGLE), *(b.column(c).to_pylist() for c in ("node", "pivot", "member")), strict=True):
            if not member:
                pivot, own = at, s
                continue
            if at != pivot:
                raise ValueError("a pivot's text is missing")
            place = np.minimum(np.searchsorted(own, s), len(own) - 1)
            both = int((own[place] == s).sum())
            a.append(node)
            p.append(at)
            common.append(both)
            whole.append(len(s) + len(own) - both)
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, p, common, whole)], names=["node", "pivot", "common", "whole"])


_FEW = 100_000  # rows of pairs that may be broadcast, some 5 MB


def _measure(texts: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (node, pivot) with the sizes of their intersection and union."""
    return materialize(_sent(texts, nodes, pairs).mapInArrow(_compare, "node long, pivot long, common long, whole long"), "measured")


def _linked() -> Column:
    return F.col("common") * 100 >= F.col("whole") * PERCENT


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose sketches are near enough: their L1 distance bounds the symmetric difference from below."""
    for b in batches:
        gap = np.fromiter(map(_gap, b.column("_sa").to_pylist(), b.column("_sb").to_pylist()), np.int64, b.num_rows)
        both = b.column("_a").to_numpy() + b.column("_b").to_numpy()
        near = (100 + PERCENT) * gap <= (100 - PERCENT) * both
        yield b.select(["node", "pivot"]).filter(pa.array(near))


def _sized(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs whose sizes and sketches allow a link.

    A link leaves at most (1 - t) / (1 + t) of both sizes in the symmetric
    difference, and no map of the sets to counts can lie farther apart.
    """
    a = nodes.select("node", F.col("n").alias("_a"), F.col("sketch").alias("_sa"))
    b = nodes.select(F.col("node").alias("pivot"), F.col("n").alias("_b"), F.col("sketch").alias("_sb"))
    sized = pairs.join(a, "node").join(b, "pivot").where(F.least("_a", "_b") * 100 >= F.greatest("_a", "_b") * PERCENT)
    return sized.select("node", "pivot", "_a", "_b", "_sa", "_sb").mapInArrow(_close, "node long, pivot long")


_ROWS, _PAIRS = 1 << 16, 1 << 20


def _within(batches: Iterator[pa.RecordBatch], most: float = float("inf")) -> Iterator[pa.RecordBatch]:
    """Pairs (region, node, pivot) of a region's members in each other's windows that aren't connected.

    Rows sorted by (region, low, high): the members of blocks low and high of a
    region, which pair with each other, or among themselves where they are one.
    Where more than `most` of them are in each other's windows, a row without
    node and pivot stands for them.
    """

    def pairs(t: pa.Table) -> Iterator[pa.RecordBatch]:
        region, low, high, block, node, size, cap, comp = (t.column(c).to_numpy() for c in ("region", "low", "high", "block", "node", "size", "cap", "comp"))
        far = t.column("far").fill_null(float("nan")).to_numpy()
        new = np.concatenate([[True], (region[1:] != region[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])])
        group, where = np.cumsum(new) - 1, region[new]
        by = np.lexsort((size, group))
        group, block, node, size, cap, comp, far, two = group[by], block[by], node[by], size[by], cap[by], comp[by], far[by], (low != high)[by]
        place = group * (1 << 20) + size
        ends = np.searchsorted(place, group * (1 << 20) + cap, side="right")
        counts = np.maximum(ends - np.arange(len(ends)) - 1, 0)
        total = np.concatenate([[0], np.cumsum(counts)])
        at = 0
        while at < len(counts):
            to = max(int(np.searchsorted(total, total[at] + _PAIRS, side="right")) - 1, at + 1)
            x = np.repeat(np.arange(at, to), counts[at:to])
            y = np.arange(len(x)) - np.repeat(total[at:to] - total[at], counts[at:to]) + x + 1
            gap = np.abs(far[x] - far[y])
            fits = (cap[y] >= size[x]) & (comp[x] != comp[y]) & (~two[x] | (block[x] != block[y])) & ~(gap > _RADIUS + 1e-9)
            x, y = x[fits], y[fits]
            many = np.bincount(group[x], minlength=group[-1] + 1) > most
            if many.any():
                yield pa.RecordBatch.from_arrays([pa.array(where[many]), *[pa.nulls(int(many.sum()), pa.int64())] * 2], names=["region", "node", "pivot"])
                few = ~many[group[x]]
                x, y = x[few], y[few]
            low_, high_ = np.minimum(node[x], node[y]), np.maximum(node[x], node[y])
            one = np.unique(np.stack([low_, high_]), axis=1, return_index=True)[1]  # the same pair of several regions
            if len(one):
                yield pa.RecordBatch.from_arrays([pa.array(where[group[x[one]]]), pa.array(low_[one]), pa.array(high_[one])], names=["region", "node", "pivot"])
            at = to

    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(h.num_rows for h in held) < _ROWS:
            continue
        t = pa.Table.from_batches(held)
        last = [t.column(c)[-1] for c in ("region", "low", "high")]
        same = np.ones(t.num_rows, bool)
        for c, v in zip(("region", "low", "high"), last, strict=True):
            same &= t.column(c).to_numpy() == v.as_py()
        cut = int(np.argmax(same))  # a group isn't cut
        if cut:
            yield from pairs(t.slice(0, cut))
        held = t.slice(cut).combine_chunks().to_batches()
    if held:
        yield from pairs(pa.Table.from_batches(held))


def _sent(texts: DataFrame, nodes: DataFrame, pairs: DataFrame, per_task: int = 250) -> DataFrame:
    """The texts of pairs (node, pivot) beside their pivots' texts, each pivot's first; a pivot with many goes to several tasks."""
    pairs = materialize(pairs, "pairs")
    salts = materialize(pairs.groupBy("pivot").agg(F.ceil(F.count("*") / per_task).cast("int").alias("salts")), "salts")
    members = pairs.join(salts, "pivot").select("node", "pivot", F.pmod(F.xxhash64("node"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("member"))
    pivots = salts.select(F.col("pivot").alias("node"), "pivot", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"))
    wanted = members.unionByName(pivots).groupBy("node").agg(F.collect_list(F.struct("pivot", "salt", "member")).alias("at"))
    wanted = materialize(wanted.join(nodes.select("node", "doc_id"), "node"), "wanted")
    few = wanted.agg(F.sum(F.size("at"))).first()[0] or 0
    sent = texts.join(F.broadcast(wanted) if few <= _FEW else wanted, "doc_id").select("node", "text", F.explode("at").alias("at")).select("node", "at.*", "text")
    return sent.repartition("pivot", "salt").sortWithinPartitions("pivot", "salt", "member")


_BEYOND = 0.7


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, node, home, near): each member's region of its cell, and the others that a link partner may have as its home.

    A region is that of the nearest pivot, or (null) of what lies beyond _BEYOND
    of all pivots; pivots lie that far apart.  By the triangle inequality a partner's home is at most two
    radii farther than the member's nearest pivot, and within _BEYOND and a
    radius; a partner beyond has all pivots farther than _BEYOND less a radius.
    Rows sorted by (cell, salt, member), so the pivots' texts come before those
    of the members.
    """

    def distance(a: np.ndarray, b: np.ndarray) -> float:
        both = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
        return 1 - both / (len(a) + len(b) - both)

    key, given, pivots = None, {}, None
    for b in slices(batches, "text"):
        out = []
        for s, node, member, *group in zip(shingle_sets(b.column("text"), SHINGLE), *(b.column(c).to_pylist() for c in ("node", "member", "cell", "salt")), strict=True):
            if group != key:
                key, given, pivots = group, {}, None
            if not member:
                given[node] = s
                continue
            if pivots is None:  # of pivots near each other, whose regions would hold the same members, one
                pivots = {}
                for p in sorted(given):
                    if all(distance(given[p], other) > _BEYOND for other in pivots.values()):
                        pivots[p] = given[p]
            far = {p: distance(s, own) for p, own in pivots.items()}
            nearest = min(far, key=lambda p: (far[p], p))
            home = nearest if far[nearest] <= _BEYOND else None
            near = [p for p in far if p != home and far[p] <= min(far[nearest] + 2 * _RADIUS, _BEYOND + _RADIUS) + 1e-9]
            out.append((group[0], node, home, near + [None] * (home is not None and far[nearest] > _BEYOND - _RADIUS - 1e-9)))
        cell, node, home, near = zip(*out, strict=True) if out else ((), (), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int64()), pa.array(node, pa.int64()), pa.array(home, pa.int64()), pa.array(near, pa.list_(pa.int64()))], names=["cell", "node", "home", "near"])


_TILE = 256


def _connected(sets: list[np.ndarray], side: np.ndarray) -> np.ndarray:
    """For each set the place of the first one that links connect it with; with two sides, only links across count.

    The sets, by size, meet in tiles; intersections come from products of
    membership matrices.  Tiles whose sizes lie too far apart, or that are
    connected already, are passed over.
    """
    n = np.array([len(x) for x in sets])
    by = np.argsort(n, kind="stable")
    names, flat = np.unique(np.concatenate([sets[i] for i in by]), return_inverse=True)
    n, side, starts = n[by], side[by], np.concatenate([[0], np.cumsum(n[by])])
    one_side, root = (side == side[0]).all(), np.arange(len(n))
    place = np.zeros(len(names), np.int64)

    def rows(a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(b - a), n[a:b]), flat[starts[a] : starts[b]]

    for a in range(0, len(n), _TILE):
        a_end = min(a + _TILE, len(n))
        own, shingle = rows(a, a_end)
        for b in range(a, len(n), _TILE):
            b_end = min(b + _TILE, len(n))
            if n[b] * PERCENT > n[a_end - 1] * 100:
                break
            both = np.concatenate([root[a:a_end], root[b:b_end]])
            if (both == both[0]).all():
                continue
            other, shingle_b = rows(b, b_end)
            seen = np.zeros(len(names), bool)
            seen[shingle] = True
            meets = seen[shingle_b]  # what no member of the first tile has meets nothing
            used = np.unique(shingle_b[meets])
            place[used] = np.arange(1, len(used) + 1)
            common = np.zeros((a_end - a, b_end - b), np.float32)
            at_a, at_b = place[shingle] - 1, place[shingle_b] - 1
            by_a, by_b = np.argsort(at_a, kind="stable"), np.argsort(at_b, kind="stable")
            for first in range(0, len(used), 4096):
                x = by_a[slice(*np.searchsorted(at_a[by_a], [first, first + 4096]))]
                y = by_b[slice(*np.searchsorted(at_b[by_b], [first, first + 4096]))]
                left, right = np.zeros((a_end - a, 4096), np.float32), np.zeros((b_end - b, 4096), np.float32)
                left[own[x], at_a[x] - first] = 1
                right[other[y], at_b[y] - first] = 1
                common += left @ right.T
            place[used] = 0
            common = common.astype(np.int64)
            near = common * 100 >= (n[a:a_end, None] + n[None, b:b_end] - common) * PERCENT
            near &= root[a:a_end, None] != root[None, b:b_end]
            if not one_side:
                near &= side[a:a_end, None] != side[None, b:b_end]
            x, y = np.nonzero(near)
            if not len(x):
                continue
            parent: dict[int, int] = {}

            def find(v: int) -> int:
                while parent.get(v, v) != v:
                    v = parent[v]
                return v

            for p, q in np.unique(np.stack([root[a + x], root[b + y]], axis=1), axis=0).tolist():
                p, q = find(p), find(q)
                if p != q:
                    parent[max(p, q)] = min(p, q)
            new = np.arange(len(n))
            for v in parent:
                new[v] = find(v)
            root = new[root]
    out = np.empty(len(n), np.int64)
    out[by] = by[root]
    return out


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) that connect what is linked among the texts of each (cell, low, high), rows sorted by these; a row per member at most."""

    def linked(held: dict[int, tuple[np.ndarray, bool]]) -> pa.RecordBatch:
        nodes = np.array(list(held), np.int64)
        root = _connected([s for s, _ in held.values()], np.array([side for _, side in held.values()]))
        own = root != np.arange(len(nodes))
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[root[own]])], names=["a", "b"])

    key, held = None, {}
    for b in slices(batches, "text"):
        groups = zip(*(b.column(c).to_pylist() for c in ("cell", "low", "high")), strict=True)
        for s, node, block, group in zip(shingle_sets(b.column("text"), SHINGLE), b.column("node").to_pylist(), b.column("block").to_pylist(), groups, strict=True):
            if group != key and held:
                yield linked(held)
                held = {}
            key = group
            held[node] = s, block != group[1]
    if held:
        yield linked(held)


_PIVOTS, _PER_TASK = 8, 2000  # pivots of a cell, members measured by one task


def _cut(texts: DataFrame, members: DataFrame) -> DataFrame:
    """members (cell, node, n, doc_id) to rows (cell, region, node, n, doc_id): every cell in Voronoi regions of pivots of its own.

    Each member's text is sent once, beside the pivots'.
    """
    rank = F.row_number().over(Window.partitionBy("cell").orderBy(F.xxhash64("cell", "node"), "node"))
    pivots = members.select("cell", "node", "doc_id").withColumn("_k", rank).where(F.col("_k") <= _PIVOTS).drop("_k")
    salts = members.groupBy("cell").agg(F.ceil(F.count("*") / _PER_TASK).alias("salts"))
    beside = pivots.join(salts, "cell").select("doc_id", "node", "cell", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.lit(0).alias("member"))
    all_ = members.join(salts, "cell").select("doc_id", "node", "cell", F.pmod(F.xxhash64("node"), F.col("salts")).alias("salt"), F.lit(1).alias("member"))
    wanted = materialize(all_.unionByName(beside).groupBy("doc_id", "node").agg(F.collect_list(F.struct("cell", "salt", "member")).alias("at")), "pivoted")
    sent = texts.join(wanted, "doc_id").select("node", "text", F.explode("at").alias("at")).select("node", "at.*", "text")
    sent = sent.repartition("cell", "salt").sortWithinPartitions("cell", "salt", "member")
    near = materialize(sent.mapInArrow(frugal(_nearest), "cell long, node long, home long, near array<long>"), "nearest")
    regions = near.select("cell", "node", F.explode(F.concat(F.array("home"), "near")).alias("_p")).select("cell", "node", F.xxhash64("cell", "_p").alias("region"))
    return materialize(regions.join(members, ["cell", "node"]), "cut")


def _cell_links(texts: DataFrame, nodes: DataFrame, cells: DataFrame, leaf: int, leaf_shingles: int = 1 << 21) -> DataFrame:
    """Links (a, b) that connect what is linked in each cell (cell, node).

    A cell of more members, or shingles, than one block holds is cut into Voronoi
    regions around pivots of its own, documents at boundaries going to several
    regions, and so on recursively, as long as cutting saves copies of texts.
    Where it doesn't, all members being about equally far from each other, the
    cell's blocks meet in pairs, a text in as many copies as there are blocks.
    """
    blocks = lambda count, shingles: F.greatest(F.ceil(count / leaf), F.ceil(shingles / leaf_shingles))
    own = nodes.select("node", "n", "doc_id")
    left = materialize(cells.join(own, "node"), "cell-members")
    ready: list[DataFrame] = []
    while True:
        sizes = left.groupBy("cell").agg(F.count("*").alias("_m"), blocks(F.count("*"), F.sum("n")).alias("blocks"))
        sizes = materialize(sizes, "cell-sizes")
        ready.append(left.join(sizes.where("blocks = 1"), "cell").select("cell", "node", "doc_id", "blocks"))
        large = sizes.where("blocks > 1")
        if large.isEmpty():
            break
        members = materialize(left.join(large.select("cell"), "cell", "left_semi"), "large-cells")
        cut = _cut(texts, members)
        after = cut.groupBy("cell", "region").agg((F.count("*") * blocks(F.count("*"), F.sum("n"))).alias("_copies")).groupBy("cell").agg(F.sum("_copies").alias("_copies"))
        # measuring sends one copy more
        worth = materialize(after.join(large, "cell").where(F.col("_copies") + F.col("_m") <= 0.7 * F.col("_m") * F.col("blocks")).select("cell"), "worth")
        ready.append(members.join(large.join(worth, "cell", "left_anti"), "cell").select("cell", "node", "doc_id", "blocks"))
        left = materialize(cut.join(worth, "cell", "left_semi").select(F.col("region").alias("cell"), "node", "n", "doc_id"), "regions-cut")
    leaves = ready[0]
    for more in ready[1:]:
        leaves = leaves.unionByName(more)
    dealt = leaves.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("node", "doc_id", F.struct("cell", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block").alias("at"))
    wanted = materialize(dealt.groupBy("node", "doc_id").agg(F.collect_list("at").alias("at")), "leaves")
    sent = texts.join(wanted, "doc_id").select("node", "text", F.explode("at").alias("at")).select("node", "at.*", "text")
    sent = sent.repartition("cell", "low", "high").sortWithinPartitions("cell", "low", "high")
    return materialize(sent.mapInArrow(frugal(_joined), "a long, b long").distinct(), "cell-links")


def links(texts: DataFrame, few: int = 64, block: int = 256, leaf: int = 4096, per_salt: int = 20_000, bucket_rows: int = 250_000, bits: int = 64) -> tuple[DataFrame, DataFrame]:
    """texts: distinct doc_id and text.  Document rows (doc_id, n, node) and (node, comp) of linked nodes.

    Regions with more pairs left than `few` members have are joined by the cells
    of their pivots, see _cell_links; a task holds 2 * `leaf` sets of a cell.
    `block` members of a region are paired at once, `bits` is the width of the
    numbers of sets.
    """
    stats = materialize(texts.mapInArrow(lambda batches: _stats(batches, bits), _STATS), "stats")
    docs = stats.where("node is not null").select("doc_id", "n", "node", "check", "sketch")
    # sets that share a number go by the rest of their hash; of 10^10 sets about three share one of 64 bits
    clashing = frozenset(r["node"] for r in docs.where("n > 0").groupBy("node").agg(F.min("check").alias("a"), F.max("check").alias("b")).where("a <> b").select("node").collect())
    if clashing:
        docs = materialize(docs.withColumn("node", F.when(F.col("node").isin(*clashing), F.col("check")).otherwise(F.col("node"))), "renumbered")
    nodes = docs.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.min("n").alias("n"), F.first("sketch").alias("sketch"))
    nodes = materialize(nodes, "nodes")
    total = docs.agg(F.sum("n")).first()[0] or 0
    # shingles that private ones are to come before; at most total / (total >> 22) = 2^22 can be this common, whatever the corpus: 64 MB
    common = stats.where("key is not null").groupBy("key").agg(F.sum("times").alias("times")).where(F.col("times") >= max(16, total >> 22)).toArrow()
    key, times = common.column("key").to_numpy().view(np.uint64), common.column("times").to_numpy()
    by_key = np.argsort(key)
    key, times = key[by_key], times[by_key]
    order = np.empty(len(key), np.int64)
    order[np.lexsort((key, times))] = np.arange(len(key))
    buckets = max(1024, total // 4 // bucket_rows)
    posted = texts.mapInArrow(_postings(key, order, -(-times // per_salt), buckets, bits, clashing), "bucket long, salt long, keys binary, nodes binary, windows binary")
    regions = posted.groupBy("bucket", "salt").applyInArrow(_regions, "region long, node long, size long, cap long")
    regions = materialize(regions.groupBy("region", "node").agg(F.min("size").alias("size"), F.max("cap").alias("cap")), "regions")
    # a text that others derive from shares all its rare shingles with them, so it lies in more regions than they do
    scores = regions.groupBy("node").agg((2 * F.log2(F.count("*")) - F.min("size") / 1024).alias("score"))
    open_ = materialize(regions.join(scores, "node"), "scored")

    comps = nodes.sparkSession.createDataFrame([], "node long, comp long")

    def grow(pairs: DataFrame, linked: DataFrame | None = None) -> DataFrame:
        """Measures pairs; those that link, and other links, go into the components."""
        nonlocal comps
        measured = _measure(texts, nodes, _sized(pairs, nodes))
        more = measured.where(_linked()).select(F.col("node").alias("a"), F.col("pivot").alias("b"))
        if linked is not None:
            more = more.unionByName(linked)
        if not more.isEmpty():
            comps = components(more.unionByName(comps.select(F.col("node").alias("a"), F.col("comp").alias("b"))))
        return measured

    def still_open(members: DataFrame) -> DataFrame:
        """Members of the regions that aren't all connected, with comp and the count m of members."""
        named = members.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        named = materialize(named, "named")
        several = named.groupBy("region").agg(F.min("comp").alias("_a"), F.max("comp").alias("_b"), F.count("*").alias("m")).where("_a <> _b").select("region", "m")
        return materialize(named.join(several, "region"), "open")

    distance = (1 - F.col("common") / F.col("whole")).alias("far")
    best = open_.groupBy("region").agg(F.max(F.struct("score", "node", "size", "cap")).alias("_p"))
    star = open_.join(best, "region").withColumn("pivot", F.col("_p.node")).where("node <> pivot")
    star = materialize(star.withColumn("_fits", (F.col("size") <= F.col("_p.cap")) & (F.col("_p.size") <= F.col("cap"))).drop("_p"), "star")
    measured = grow(star.where("_fits").select("node", "pivot").distinct()).select("node", "pivot", distance)
    left = still_open(star.join(measured, ["node", "pivot"], "left").select("region", "pivot", "node", "size", "cap", "far"))
    blocks = F.ceil(F.col("m") / block)
    dealt = left.withColumn("block", F.pmod(F.xxhash64("node"), blocks)).withColumn("_with", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    dealt = dealt.select("region", F.least("block", "_with").alias("low"), F.greatest("block", "_with").alias("high"), "block", "node", "size", "cap", "comp", "far")
    dealt = dealt.repartition("region", "low", "high").sortWithinPartitions("region", "low", "high")
    joined = materialize(dealt.mapInArrow(lambda batches: _within(batches, few * few / 2), "region long, node long, pivot long"), "within")
    large = materialize(left.join(joined.where("node is null").select("region").distinct(), "region").select(F.col("pivot").alias("cell"), "node").distinct(), "cells")
    grow(joined.where("node is not null").select("node", "pivot").distinct(), None if large.isEmpty() else _cell_links(texts, nodes, large, leaf))
    return docs.select("doc_id", "n", "node"), comps


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (the smallest doc_id reachable by links).

    Texts without words, and null, have no shingle and link with nothing.  Rows
    that repeat a doc_id are one document, with the largest of their texts; each
    gets its row.  A null doc_id links with nothing and has no component.  An
    empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    texts = rows.where("doc_id is not null")
    twice = materialize(texts.groupBy("doc_id").count().where("count > 1"), "repeated")
    repeated = not twice.isEmpty()
    if repeated:
        own = texts.join(twice, "doc_id", "left_semi").groupBy("doc_id").agg(F.max("text").alias("text"))
        texts = texts.join(twice, "doc_id", "left_anti").unionByName(own)
    own, comps = links(texts)
    first = materialize(own.join(comps, "node").groupBy("comp").agg(F.min("doc_id").alias("component_id")), "first")
    by_node = materialize(comps.join(first, "comp").select("node", "component_id"), "by-node")
    alone = materialize(own.where("n > 0").groupBy("node").agg(F.min("doc_id").alias("_same")), "same")
    by_node = materialize(alone.join(by_node, "node", "left").select("node", F.coalesce("component_id", "_same").alias("component_id")), "classes")
    out = own.where("n > 0").join(by_node, "node").select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    out = out.unionByName(own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))
    if repeated:
        times = twice.select("doc_id", F.explode(F.sequence(F.lit(2), F.col("count").cast("int"))).alias("_"))
        out = materialize(out, "documents")
        out = out.unionByName(out.join(times, "doc_id").drop("_"))
    lost = rows.where("doc_id is null")
    if lost.isEmpty():
        return out
    return out.unionByName(lost.mapInArrow(_stats, _STATS).where("node is not null").select("doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component_id")))
