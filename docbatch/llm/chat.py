"""Chat formatting by columnar byte assembly.

All segments of a run of conversations get their lengths, a running sum gives
their places, and headers and contents are copied by scatter indices into one
buffer that becomes the Arrow column.

The template is ``<|im_start|>role\\ntext<|im_end|>\\n`` per turn.  Inside texts
and roles, ``<``, any number of backslashes, ``|`` gets one backslash more, so
no control string is left; in roles a backslash is doubled and a line feed
becomes ``\\n``.  Both are undone by ``parse_chat``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docbatch.llm.textio import slices

START, LINE, END = b"<|im_start|>", b"\n", b"<|im_end|>\n"
_FORMATTED = "conv_id long, n_turns long, formatted string, loss array<struct<start:long,end:long>>"


def _escape(column: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(column, r"<(\\*)\|", r"<\\\1|")


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def _unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role), flags=re.S)


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a large-string column."""
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return offsets, raw


def assemble(table: pa.Table, loss_roles: tuple[str, ...]) -> pa.RecordBatch:
    """Turns of whole conversations, sorted, to one row per conversation."""
    table = table.combine_chunks()
    column = lambda c: pc.fill_null(table.column(c).cast(pa.large_string()), "").combine_chunks()
    role = column("role")
    plain = pc.replace_substring(pc.replace_substring(role, "\\", "\\\\"), "\n", "\\n")
    roles, texts = _bytes(_escape(plain)), _bytes(_escape(column("text")))
    n = table.num_rows
    lengths = np.empty((n, 5), np.int64)
    for j, x in enumerate((len(START), np.diff(roles[0]), len(LINE), np.diff(texts[0]), len(END))):
        lengths[:, j] = x
    places = np.concatenate([[0], np.cumsum(lengths.ravel())])
    starts = places[:-1].reshape(n, 5)
    buffer = np.empty(places[-1], np.uint8)
    for j, fixed in ((0, START), (2, LINE), (4, END)):
        buffer[starts[:, j, None] + np.arange(len(fixed))] = np.frombuffer(fixed, np.uint8)
    for j, (offsets, raw) in ((1, roles), (3, texts)):
        source = np.arange(offsets[0], offsets[-1])
        buffer[source + np.repeat(starts[:, j] - offsets[:-1], lengths[:, j])] = raw[source]
    conv = table.column("conv_id").combine_chunks()
    ids = pc.fill_null(conv, 0).to_numpy()
    none = pc.is_null(conv).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (none[1:] != none[:-1])]))
    ends = np.append(first[1:], n)
    offsets = np.append(starts[first, 0], places[-1])
    loss = np.flatnonzero(pc.is_in(role, pa.array(loss_roles, pa.large_string())).to_numpy(zero_copy_only=False))
    base = np.repeat(starts[first, 0], ends - first)[loss]
    spans = pa.StructArray.from_arrays([pa.array(starts[loss, 3] - base), pa.array(starts[loss, 4] - base)], names=["start", "end"])
    formatted = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(buffer)])
    return pa.RecordBatch.from_arrays(
        [conv.take(pa.array(first)), pa.array(ends - first), formatted.cast(pa.string()), pa.ListArray.from_arrays(pa.array(np.searchsorted(loss, np.append(first, n)), pa.int32()), spans)],
        names=["conv_id", "n_turns", "formatted", "loss"],
    )


def _format(loss_roles: tuple[str, ...], max_rows: int, max_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in slices(batches, "text", max_bytes, max_rows):
            ids = b.column("conv_id")
            last = ids[-1].as_py()
            own = pc.is_null(ids) if last is None else pc.fill_null(pc.equal(ids, last), False)
            head = b.filter(pc.invert(own))
            same = bool(held) and held[0].column("conv_id")[0].as_py() == last
            if not same or head.num_rows:  # what is held ends before the last conversation of b
                whole = [*held, head] if held or head.num_rows else []
                if whole:
                    yield assemble(pa.Table.from_batches(whole), loss_roles)
                held = []
            held.append(b.filter(own))
        if held:
            yield assemble(pa.Table.from_batches(held), loss_roles)

    return run


def format_chat(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",), max_rows: int = 4096, max_bytes: int = 4 << 20) -> DataFrame:
    """turns (conv_id, turn, role, text) to rows (conv_id, n_turns, formatted, loss).

    loss holds the byte spans, in the UTF-8 form of formatted, of the texts to
    learn from.  Rows go by turn, ties by role and text, nulls first; null texts
    and roles are empty; null is a conv_id of its own; repeated rows are turns
    like others; other columns are not read; an empty table gives no rows.  A
    conversation is one row of the result and so the work of one task, which holds
    it and max_bytes of texts, or max_rows, beside it.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.mapInArrow(_format(loss_roles, max_rows, max_bytes), _FORMATTED)


def parse_chat(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of one formatted conversation."""
    turns = []
    at, start, end = 0, START.decode(), END.decode()
    while at < len(formatted):
        if not formatted.startswith(start, at):
            raise ValueError(f"no turn begins at {at}")
        stop = formatted.index(end, at)
        role, text = formatted[at + len(start) : stop].split("\n", 1)
        turns.append((_unescape_role(role), unescape(text)))
        at = stop + len(end)
    return turns


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        n, turns_sha, chars, loss_sha, size = [], [], [], [], []
        for text, spans in zip(b.column("formatted").to_pylist(), b.column("loss").to_pylist(), strict=True):
            turns = parse_chat(text)
            raw = text.encode()
            learnt = [unescape(raw[s["start"] : s["end"]].decode()) for s in spans]
            n.append(len(turns))
            turns_sha.append(hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest())
            chars.append(sum(map(len, learnt)))
            loss_sha.append(hashlib.sha256("".join(learnt).encode()).hexdigest())
            size.append(len(text))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        columns = [pa.array(v, k) for v, k in zip((n, turns_sha, chars, loss_sha, size), kinds, strict=True)]
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), *columns], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Digests of conversations parsed back from their formatted text and loss spans."""
    return formatted.select("conv_id", "formatted", "loss").mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
