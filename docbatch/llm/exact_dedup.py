"""Exact dedup by deterministic block naming.

Each text is cut into blocks of a fixed number of bytes.  Equal blocks get one
integer name: they are dealt out by hash, sorted within each partition, and
every change of value opens a new name.  Then adjacent names are paired and the
pairs named in the same way, until one name stands for the whole text.  Blocks
and pairs themselves are compared, so two texts share a name only if they are
equal.

A frequent block can't flood a task: rows are handled in *batches* (bounded in
rows and bytes), a batch sends each of its distinct blocks once, and names
travel back to the batch, not to the row.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docbatch.llm.store import materialize
from docbatch.llm.textio import SPACE, slices

#: kind 0 is a block or pair of a batch, kind 1 a document of a batch.
_MIXED = "route long, batch long, kind int, lid int, key binary, uid long, doc_id long, digest binary, lids array<int>, name long"
_TYPES = pa.schema([("route", pa.int64()), ("batch", pa.int64()), ("kind", pa.int32()), ("lid", pa.int32()), ("key", pa.binary()), ("uid", pa.int64()), ("doc_id", pa.int64()), ("digest", pa.binary()), ("lids", pa.list_(pa.int32())), ("name", pa.int64())])
_STATE = "batch long, uid long, doc_id long, digest binary, names array<long>"


def _mixed(batch: int, keys: list[bytes], docs: list[tuple]) -> pa.Table:
    """keys: the distinct ones, by their lid; docs: (uid, doc_id, digest, lids), uid their place in the batch."""
    n, m = len(keys), len(docs)
    route = [xxhash.xxh3_64_intdigest(k) - 2**63 for k in keys] + [batch * 0x9E3779B1 % 2**61] * m
    columns = [
        route, [batch] * (n + m), [0] * n + [1] * m, [*range(n), *[None] * m], keys + [None] * m,
        [None] * n + [d[0] for d in docs], [None] * n + [d[1] for d in docs], [None] * n + [d[2] for d in docs], [None] * n + [d[3] for d in docs], [None] * (n + m),
    ]
    return pa.Table.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _TYPES, strict=True)], schema=_TYPES)


def _cut(block_bytes: int, batch_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32  # of the batch: 2^31 partitions and 2^32 batches in each fit
        for part in slices(batches, "norm", max_rows=batch_rows):
            lids: dict[bytes, int] = {}
            docs = []
            rows = zip(part.column("doc_id").to_pylist(), part.column("norm").cast(pa.large_binary()).to_pylist(), part.column("digest").to_pylist(), strict=True)
            for i, (doc_id, text, digest) in enumerate(rows):
                own = [lids.setdefault(text[a : a + block_bytes], len(lids)) for a in range(0, max(len(text), 1), block_bytes)]
                docs.append((i, doc_id, digest, own))
            yield from _mixed(number, list(lids), docs).to_batches()
            number += 1

    return run


def _name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by kind and key: a new key opens a new name."""
    at, last = (TaskContext.get().partitionId() << 40), None
    for b in batches:
        keys = b.column("key").cast(pa.large_binary())
        known = int(pc.sum(pc.equal(b.column("kind"), 0)).as_py() or 0)
        name = np.zeros(b.num_rows, np.int64)
        if known:
            new = np.ones(known, bool)
            new[0] = keys[0].as_py() != last
            new[1:] = pc.not_equal(keys.slice(1, known - 1), keys.slice(0, known - 1)).to_numpy(zero_copy_only=False)
            name[:known] = at + np.cumsum(new)
            at, last = int(name[known - 1]), keys[known - 1].as_py()
        yield b.set_column(b.schema.get_field_index("key"), "key", pa.nulls(b.num_rows, pa.binary())).set_column(b.schema.get_field_index("name"), "name", pa.array(name))


def _back(table: pa.Table) -> pa.Table:
    """One batch: local ids of its documents replaced by names."""
    kinds = table.column("kind").to_numpy()
    lid, name = (table.column(c).to_numpy(zero_copy_only=False)[kinds == 0].astype(np.int64) for c in ("lid", "name"))
    names = np.zeros(len(lid), np.int64)
    names[lid] = name
    docs = table.filter(pa.array(kinds == 1)).combine_chunks()
    lists = docs.column("lids").combine_chunks()
    lists = lists.chunk(0) if isinstance(lists, pa.ChunkedArray) else lists
    new = pa.ListArray.from_arrays(lists.offsets, pa.array(names[lists.values.to_numpy()])) if len(lists) else pa.array([], pa.list_(pa.int64()))
    return pa.table({"batch": docs.column("batch"), "uid": docs.column("uid"), "doc_id": docs.column("doc_id"), "digest": docs.column("digest"), "names": new})


def _pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adjacent names of each document as the keys of the next level; an odd last name is paired with 0."""
    for b in batches:
        for batch in pc.unique(b.column("batch")).to_pylist():
            own = b.filter(pc.equal(b.column("batch"), batch))
            lids: dict[bytes, int] = {}
            docs = []
            for uid, doc_id, digest, names in zip(*(own.column(c).to_pylist() for c in ("uid", "doc_id", "digest", "names")), strict=True):
                names = names + [0] * (len(names) % 2)
                docs.append((uid, doc_id, digest, [lids.setdefault(struct.pack(">qq", *names[a : a + 2]), len(lids)) for a in range(0, len(names), 2)]))
            yield from _mixed(batch, list(lids), docs).to_batches()


def _named(mixed: DataFrame, level: int) -> DataFrame:
    named = mixed.repartition("route").sortWithinPartitions("kind", "key").mapInArrow(_name, _MIXED)
    return materialize(named.groupBy("batch").applyInArrow(_back, _STATE), f"names-{level}")


def exact_classes(docs: DataFrame, block_bytes: int = 4096, batch_rows: int = 512) -> DataFrame:
    """Rows (batch, uid, doc_id, text_sha256, level, name): equal texts share (level, name), others don't.

    Texts are equal when they are after every run of ASCII white space became
    one space; null counts as empty.  batch and uid, a row's place in it, tell rows of one doc_id apart.  An
    empty table gives no rows; other columns of docs are not read.
    """
    if batch_rows < 1:
        raise ValueError("batch_rows must be 1 or more")
    norm = F.regexp_replace(F.coalesce("text", F.lit("")), f"{SPACE}+", " ")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), norm.alias("norm")).withColumn("digest", F.unhex(F.sha2("norm", 256)))
    state = _named(rows.mapInArrow(_cut(block_bytes, batch_rows), _MIXED), 0)
    done, level = [], 0
    while True:
        one = F.size("names") == 1
        done.append(state.where(one).select("batch", "uid", "doc_id", F.lower(F.hex("digest")).alias("text_sha256"), F.lit(level).alias("level"), F.col("names")[0].alias("name")))
        rest = state.where(~one)
        if rest.isEmpty():
            break
        level += 1
        # one batch is one group and so one task's run of rows; it stays whole through the sort
        state = _named(rest.repartition("batch").sortWithinPartitions("batch", "uid").mapInArrow(_pair_runs, _MIXED), level)
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def _pair_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_pair over whole runs of a batch, which Arrow batches may cut."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        last = b.column("batch")[-1].as_py() if b.num_rows else None
        if not b.num_rows:
            continue
        head = b.filter(pc.not_equal(b.column("batch"), last))
        tail = b.filter(pc.equal(b.column("batch"), last))
        if held and held[0].column("batch")[0].as_py() != last:
            whole = pa.Table.from_batches([*held, head]).combine_chunks()
            yield from _pair(iter(whole.to_batches()))
            held = []
        elif head.num_rows:
            yield from _pair(iter([head]))
        held.append(tail)
    if held:
        yield from _pair(iter(pa.Table.from_batches(held).combine_chunks().to_batches()))


def exact_dedup(docs: DataFrame, block_bytes: int = 4096, batch_rows: int = 512) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the smallest doc_id stays (nulls last; of rows
    that repeat a doc_id, one).
    """
    rows = materialize(exact_classes(docs, block_bytes, batch_rows), "classes")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "batch", "uid"))
    groups = materialize(rows.groupBy("level", "name").agg(first.alias("first"), F.count("*").alias("group_size")), "groups")
    return rows.join(groups, ["level", "name"]).select(
        "doc_id", F.col("first.doc_id").alias("keep_id"), "group_size", ((F.col("batch") == F.col("first.batch")) & (F.col("uid") == F.col("first.uid"))).alias("kept"), "text_sha256"
    )
