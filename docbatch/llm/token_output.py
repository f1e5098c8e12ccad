"""Token ids as frequency-ranked, byte-aligned variable-length codes with separate control bytes.

An id is replaced by its rank among all ids of the corpus, most frequent first.
A rank takes as few bytes as it needs, 1 to 4; two bits in a control byte tell
how many, four ids to a control byte.  Decoding looks a control byte up in a
table of lengths, sums them to offsets and gathers the bytes, all in numpy.

The file format: Parquet files in ascending doc_id order, each row a *block* of
whole documents with its ids, ``doc_ids`` and ``counts`` (little-endian signed
64-bit), ``control`` and ``data``; a block knows its file (``shard``), its place
there and the ids before it in the shard.  The ranks lie beside them in
``ranks``.  Spark writes the files, so they commit as a whole and may lie in any
store.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docbatch.llm.store import fresh_path, materialize
from docbatch.llm.textio import slices, tokenizer

_IDS = "doc_id long, ids binary"
_BLOCK = "shard int, block int, ids_before long, doc_ids binary, counts binary, control binary, data binary"
_BLOCK_IDS = 1 << 18
#: For each control byte, the lengths of its four codes.
LENGTHS = np.array([[1 + (c >> 2 * j & 3) for j in range(4)] for c in range(256)], np.uint8)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit values."""
    ranks = ranks.astype(np.uint32)
    size = 1 + (ranks > 0xFF).astype(np.uint8) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    two = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    two[: len(ranks)] = size - 1
    two = two.reshape(-1, 4)
    control = two[:, 0] | two[:, 1] << 2 | two[:, 2] << 4 | two[:, 3] << 6
    at = np.cumsum(size, dtype=np.int64) - size
    data = np.zeros(int(size.sum(dtype=np.int64)), np.uint8)
    for j in range(4):
        longer = size > j
        if not longer.any():
            break
        data[at[longer] + j] = (ranks[longer] >> np.uint32(8 * j)) & np.uint32(0xFF)
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n values behind encode_ranks."""
    size = LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    raw = np.frombuffer(data, np.uint8)
    at = np.cumsum(size, dtype=np.int64) - size
    out = np.zeros(n, np.uint32)
    for j in range(4):
        longer = np.flatnonzero(size > j)
        if not len(longer):
            break
        out[longer] |= raw[at[longer] + j].astype(np.uint32) << np.uint32(8 * j)
    return out


def _tokenize(path: str, spaced: bool, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", 12 << 20, 16_384):
            tok = tokenizer(path, spaced)
            ids, offsets = tok.encode(batch.column("text"))
            kind = "<u2" if max(tok.tok.get_vocab_size(), end_id) < 1 << 16 else "<u4"
            ids = np.insert(ids, offsets[1:], end_id).astype(kind)
            offsets = (offsets + np.arange(len(offsets))) * ids.itemsize
            blob = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), blob], names=["doc_id", "ids"])

    return run


def _counts(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for b in batches:
            for x in b.column("ids"):
                own = np.bincount(np.frombuffer(x.as_buffer(), f"<u{width}"))
                if len(own) > len(total):
                    total = np.concatenate([total, np.zeros(len(own) - len(total), np.int64)])
                total[: len(own)] += own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["id", "n"])

    return run


def _encode(ranks: np.ndarray, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        docs: list[int] = []
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            nonlocal block, before, docs, held
            ids, counts = np.concatenate(held), np.array([len(x) for x in held], "<i8")
            control, data = encode_ranks(ranks[ids])
            row = [shard, block, before, _doc_ids(docs), counts.tobytes(), control, data]
            block, before, docs, held = block + 1, before + len(ids), [], []
            kinds = [pa.int32(), pa.int32(), pa.int64(), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], names=[c.split()[0] for c in _BLOCK.split(", ")])

        size = 0
        for b in batches:
            for doc_id, x in zip(b.column("doc_id").to_pylist(), b.column("ids"), strict=True):
                held.append(np.frombuffer(x.as_buffer(), f"<u{width}"))
                docs.append(doc_id)
                size += len(held[-1])
                if size >= _BLOCK_IDS:
                    yield out()
                    size = 0
        if held:
            yield out()

    return run


#: Stands for a null doc_id in a block.
NO_DOC = -(2**63)


def _doc_ids(docs: list) -> bytes:
    return np.array([NO_DOC if d is None else d for d in docs], "<i8").tobytes()


def write_tokens(docs: DataFrame, tokenizer_path: str, end_id: int = 2, spaced: bool = True, path: str | None = None) -> str:
    """Encode the whole texts of docs and write the files; returns their folder.

    Null texts are empty: the end id alone.  Rows that repeat a doc_id are
    documents of their own, ordered by their ids; a null doc_id comes first.  An
    empty table gives files without blocks.
    """
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    path = path or fresh_path(spark, "tokens")
    width = 2 if max(Tokenizer.from_file(tokenizer_path).get_vocab_size(), end_id) < 1 << 16 else 4
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = materialize(rows.mapInArrow(_tokenize(tokenizer_path, spaced, end_id), _IDS), "ids")
    # one row per id of the vocabulary, whatever the corpus: small enough for the driver
    counts = ids.select("ids").mapInArrow(_counts(width), "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).collect()
    ranked = sorted((-r["n"], r["id"]) for r in counts)
    ranks = np.zeros(max((i for _, i in ranked), default=0) + 1, np.uint32)
    for rank, (_, i) in enumerate(ranked):
        ranks[i] = rank
    spark.createDataFrame([(k, i) for k, (_, i) in enumerate(ranked)], "rank int, id int").coalesce(1).write.parquet(f"{path}/ranks")
    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(_encode(ranks, width), _BLOCK).write.option("compression", "zstd").parquet(f"{path}/blocks")
    return path


def _decode(ids: np.ndarray, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                doc = np.frombuffer(b.column("doc_ids")[i].as_buffer(), "<i8")
                n = np.frombuffer(b.column("counts")[i].as_buffer(), "<i8")
                own = ids[decode_ranks(b.column("control")[i].as_py(), b.column("data")[i].as_py(), int(n.sum()))].astype("<u4")
                ends = np.cumsum(n)
                raw = [own[e - k : e].tobytes() for e, k in zip(ends, n, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(doc, mask=doc == NO_DOC), pa.array([b.column("shard")[i].as_py()] * len(n), pa.int32()), pa.array(ends - n + b.column("ids_before")[i].as_py()), pa.array(n), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array(raw if keep_ids else [None] * len(n), pa.binary())],
                    names=["doc_id", "shard", "before", "n_tokens", "ids_crc32", "ids"],
                )

    return run


def read_tokens(spark: SparkSession, path: str, keep_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, n_tokens, ids_crc32), and ids as bytes when asked, from the files of write_tokens."""
    ranks = spark.read.parquet(f"{path}/ranks").collect()
    ids = np.zeros(max(len(ranks), 1), np.uint32)
    for r in ranks:
        ids[r["rank"]] = r["id"]
    blocks = spark.read.schema(_BLOCK).parquet(f"{path}/blocks")
    sizes = blocks.select("shard", "counts").mapInArrow(_sizes, "shard int, n long").groupBy("shard").agg(F.sum("n").alias("n"))
    # one row per written file
    shards = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("shard", "base")
    rows = blocks.mapInArrow(_decode(ids, keep_ids), "doc_id long, shard int, before long, n_tokens long, ids_crc32 long, ids binary")
    return rows.join(F.broadcast(shards), "shard").select("doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * keep_ids)


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n = [int(np.frombuffer(x.as_buffer(), "<i8").sum()) for x in b.column("counts")]
        yield pa.RecordBatch.from_arrays([b.column("shard"), pa.array(n, pa.int64())], names=["shard", "n"])
