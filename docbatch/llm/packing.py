"""Best-fit packing by hierarchical residual packing.

Each task packs its own pieces best-fit, longest first.  Nearly full bins are
final.  Underfull bins go up a tree as items: groups of ``fanin`` neighbours
are packed best-fit again, round by round, until one group is left.

What a group hands up is bounded and loses nothing: two bins of at most half the
capacity never stay apart, so a group ends with one such bin at most, and every
later merge needs one.  Of the bins above half only those with the most room can
ever take part, as many as smaller bins can arrive.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docbatch.llm.store import materialize
from docbatch.llm.textio import frugal, slices, tokenizer

_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, ids binary, slot long, bin long, bin_offset long, bin_fill long"
_WINDOW = 200_000


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: bin of each item, its offset there, and the fill of each bin."""
    rooms: list[int] = []  # the distinct rooms of open bins, sorted
    open_: dict[int, list[int]] = {}
    own, offset, fill = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), []
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        at = bisect_left(rooms, size)
        if at == len(rooms):
            b, room = len(fill), capacity
            fill.append(0)
        else:
            room = rooms[at]
            b = open_[room].pop()
            if not open_[room]:
                del open_[room]
                rooms.pop(at)
        own[i], offset[i] = b, fill[b]
        fill[b] += size
        if room > size:
            if room - size not in open_:
                open_[room - size] = []
                insort(rooms, room - size)
            open_[room - size].append(b)
    return own, offset, np.array(fill, np.int64)


def _pack_pieces(path: str, spaced: bool, end_id: int, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, bins = TaskContext.get().partitionId(), TaskContext.get().partitionId() << 32
        held: list[tuple] = []

        def packed() -> pa.RecordBatch:
            nonlocal held, bins
            doc, piece, start, length, crc, ids = zip(*held, strict=True)
            own, offset, fill = best_fit(np.array(length, np.int64), capacity)
            columns = [pa.array(doc, pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(ids, pa.binary()), pa.array([part] * len(own), pa.int64()), pa.array(own + bins), pa.array(offset), pa.array(fill[own])]
            held, bins = [], bins + len(fill)
            return pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _PIECES.split(", ")])

        for batch in slices(batches, "text", 4 << 20, 16_384):
            ids, offsets = tokenizer(path, spaced).encode(batch.column("text"))
            for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), offsets[:-1], offsets[1:], strict=True):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                for piece, at in enumerate(range(0, len(own), capacity)):
                    raw = own[at : at + capacity].tobytes()
                    held.append((doc_id, piece, at, len(raw) // 4, zlib.crc32(raw), raw if keep_ids else None))
            if len(held) >= _WINDOW or keep_ids and len(held) >= 4096:
                yield packed()
        if held:
            yield packed()

    return frugal(run)


_ITEM = "slot long, bin long, size long, members array<struct<bin:long,shift:long>>, open boolean"


def _round(capacity: int, nearly: int, keep: int):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("bin").combine_chunks()
        size, first = (table.column(c).to_numpy() for c in ("size", "bin"))
        own, offset, fill = best_fit(size, capacity)
        # the members of a new bin are those of its items, each moved by its item's place
        lists = table.column("members").combine_chunks()
        inner, n = lists.flatten(), lists.value_lengths().to_numpy()
        into, moved = np.repeat(own, n), inner.field("shift").to_numpy() + np.repeat(offset, n)
        by = np.argsort(into, kind="stable")
        members = pa.StructArray.from_arrays([inner.field("bin").take(pa.array(by)), pa.array(moved[by])], names=["bin", "shift"])
        ends = np.searchsorted(into[by], np.arange(len(fill) + 1)).astype(np.int32)
        lead = np.full(len(fill), np.iinfo(np.int64).max)
        np.minimum.at(lead, own, first)
        up = fill < nearly
        room = np.sort(capacity - fill[up & (2 * fill > capacity)])[::-1]
        if len(room) > keep:
            up &= (2 * fill <= capacity) | (capacity - fill >= room[keep - 1])
        slot = pa.array(np.full(len(fill), table.column("slot")[0].as_py(), np.int64))
        return pa.table({"slot": slot, "bin": pa.array(lead), "size": pa.array(fill), "members": pa.ListArray.from_arrays(pa.array(ends), members), "open": pa.array(up)})

    return run


def merge_underfull(bins: DataFrame, capacity: int, nearly: int, fanin: int = 16, keep: int = 256) -> DataFrame:
    """bins: (slot, bin, size).  Rows (bin, sequence_id, shift) of the bins that ended in another one, or first in one."""
    items = materialize(bins.select("slot", "bin", "size", F.array(F.struct("bin", F.lit(0).cast("long").alias("shift"))).alias("members"), F.lit(True).alias("open")), "underfull")
    slots = (items.agg(F.max("slot")).first()[0] or 0) + 1
    done = []
    while True:
        # rows of one slot are one task's underfull bins; a group is fanin neighbours
        packed = items.withColumn("slot", F.floor(F.col("slot") / fanin).cast("long")).groupBy("slot").applyInArrow(_round(capacity, nearly, keep), _ITEM)
        packed = materialize(packed, "round")
        slots = -(-slots // fanin)
        done.append(packed.where("not open") if slots > 1 else packed)
        if slots == 1:
            break
        items = packed.where("open")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.where(F.size("members") > 1).select(F.col("bin").alias("sequence_id"), F.explode("members").alias("m")).select(F.col("m.bin").alias("bin"), "sequence_id", F.col("m.shift").alias("shift"))


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, spaced: bool = False, nearly: float = 0.995, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids when keep_ids).

    A document is its token ids and end_id; null text is empty.  Only documents
    longer than capacity are cut.  Each row of docs is packed, repeated ones too;
    an empty table gives no rows; other columns are not read.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = materialize(rows.mapInArrow(_pack_pieces(tokenizer_path, spaced, end_id, capacity, keep_ids), _PIECES), "pieces")
    full = int(capacity * nearly)
    underfull = pieces.where((F.col("bin_offset") == 0) & (F.col("bin_fill") < full)).select("slot", "bin", F.col("bin_fill").alias("size"))
    moved = merge_underfull(underfull, capacity, full)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", F.coalesce("sequence_id", "bin").alias("sequence_id"), (F.col("bin_offset") + F.coalesce("shift", F.lit(0))).alias("offset")]
    return pieces.join(moved, "bin", "left").select(*columns, *["ids"] * keep_ids)
