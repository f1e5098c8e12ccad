"""Labels in scanned rows of bars and gaps: where they begin, what they say, and what a region's rows agree on."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docbatch.functions.codes import STAR, START, code128_texts, letters, nearest, stop_error, strings

_MOST_SYMBOLS, _MOST_LETTERS = 160, 100
_CHUNK = 1 << 18  # runs of rows that are searched together

READING = "ord int, kind string, value string, x0 long, x1 long, score double"


def _window(runs: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    return runs[at[:, None] + np.arange(size)]


def _code128(runs: np.ndarray, dark: np.ndarray, before: np.ndarray, last: np.ndarray) -> tuple:
    """(starts, ends, texts, scores) of labels, texts null where wrong; dark: the bars, before: widths of the gaps before them, last: ends of rows.

    All candidates move on together, a symbol a step.
    """
    n = max(len(runs) - 25, 0)
    total = runs[:n]
    for k in range(1, 6):
        total = total + runs[k : n + k]
    starts = np.flatnonzero(dark[:n] & (total >= 8) & (before[:n] >= 3 * total / 11))
    starts = starts[starts + 26 <= last[starts]]
    symbol, error = nearest(_window(runs, starts, 6), START["A"])
    kept = error <= 0.22
    starts = starts[kept]
    module = total[starts] / 11
    symbols = np.zeros((len(starts), _MOST_SYMBOLS), np.int32)
    symbols[:, :1] = symbol[kept, None]
    sums, counts, ends = error[kept], np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    live = np.arange(len(starts))
    for n in range(1, _MOST_SYMBOLS):
        end = starts[live] + 6 * n + 7
        inside = end <= last[starts[live]]
        live, end = live[inside], end[inside]
        if not len(live):
            break
        tail = _window(runs, end - 7, 7)
        after = np.where(end == last[starts[live]], np.inf, runs[np.minimum(end, len(runs) - 1)])
        over = (stop_error(tail) < 0.2) & (n >= 3) & (after >= 3 * module[live])
        counts[live[over]], ends[live[over]] = n, end[over]
        live, own = live[~over], tail[~over, :6]
        size = own.sum(axis=1)
        ratio = size / 11 / module[live]
        near = (size >= 8) & (ratio > 0.6) & (ratio < 1.5)
        live, own = live[near], own[near]
        symbol, error = nearest(own)
        good = (error <= 0.22) & (symbol < START["A"])
        live = live[good]
        symbols[live, n] = symbol[good]
        sums[live] += error[good]
    found = np.flatnonzero(counts)
    counts = counts[found]
    texts = code128_texts(symbols[found, : counts.max(initial=1)], counts)
    return starts[found], ends[found], texts, 1 - np.minimum(1.0, sums[found] / counts)


def _code39(runs: np.ndarray, dark: np.ndarray, before: np.ndarray, last: np.ndarray) -> tuple:
    """(starts, ends, texts, scores) of labels from star to star; arguments as for _code128."""
    n = max(len(runs) - 8, 0)
    up, down = runs[1:] > runs[:-1], runs[1:] < runs[:-1]
    # the wide ones of a star are its second, fifth and seventh, and its first is narrower than any gap before it
    star = up[:n] & down[1 : n + 1] & up[3 : n + 3] & down[4 : n + 4] & up[5 : n + 5] & down[6 : n + 6]
    starts = np.flatnonzero(dark[:n] & star & (before[:n] > runs[:n]))
    starts = starts[starts + 9 <= last[starts]]
    texts, live = np.zeros((len(starts), _MOST_LETTERS), np.uint8), np.arange(len(starts))
    score, counts, ends = np.ones(len(starts)), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    for n in range(_MOST_LETTERS):
        end = starts[live] + 10 * n + 9
        inside = end <= last[starts[live]]
        live, end = live[inside], end[inside]
        if not len(live):
            break
        letter, narrow, off = letters(_window(runs, end - 9, 9))
        good, star = letter > 0, letter == STAR
        over = end == last[starts[live]]
        after = np.where(over, np.inf, runs[np.minimum(end, len(runs) - 1)])
        quiet = before[starts[live]] >= 3 * narrow
        score[live[good]] = np.minimum(score[live[good]], 1 - off[good] / 2)
        if n == 0:
            on = star & quiet
        else:
            done = star & (n > 1) & quiet & (after >= 3 * narrow)
            counts[live[done]], ends[live[done]] = n - 1, end[done]
            on = good & ~star
            texts[live[on], n - 1] = letter[on]
        live = live[on & ~over & (after <= 1.8 * narrow)]
    found = np.flatnonzero(counts)
    texts = texts[found]
    return starts[found], ends[found], strings(texts[np.arange(_MOST_LETTERS) < counts[found, None]], counts[found]), score[found]


def _search(batches: Iterator[pa.RecordBatch], keep: list[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = pc.fill_null(pc.list_value_length(batch.column("_runs")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(sizes)
        at = 0
        while at < batch.num_rows:
            to = max(int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _CHUNK, side="right")), at + 1)
            yield _search_rows(batch.slice(at, to - at), keep)
            at = to


def _search_rows(b: pa.RecordBatch, keep: list[str]) -> pa.RecordBatch:
    lists = b.column("_runs")
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    runs = pc.fill_null(pc.list_flatten(lists), 0.0).to_numpy(zero_copy_only=False)
    row_ends = np.cumsum(sizes)
    row = np.repeat(np.arange(b.num_rows), sizes)
    last, odd = row_ends[row], (row_ends - sizes) & 1
    light = pc.fill_null(b.column("_dark"), False).to_numpy(zero_copy_only=False) == (odd == 1)  # runs at even places of the slice
    dark = light[row] ^ (np.arange(len(runs)) & 1 == 0)
    before = np.concatenate([[np.inf], runs[:-1]])[: len(runs)]
    before[(row_ends - sizes)[sizes > 0]] = np.inf
    kinds = [_code128(runs, dark, before, last), _code39(runs, dark, before, last)]
    starts, ends, score = (np.concatenate([k[i] for k in kinds]) for i in (0, 1, 3))
    kind = np.repeat([0, 1], [len(k[0]) for k in kinds])
    order = np.lexsort((starts, kind, row[starts]))
    starts, ends, score, kind = starts[order], ends[order], score[order], kind[order]
    rows = row[starts]
    value = pa.concat_arrays([k[2] for k in kinds]).take(pa.array(order))
    begin = (row_ends - sizes)[rows]
    edges = np.concatenate([[0.0], np.cumsum(runs)])
    if (runs == np.floor(runs)).all() and np.abs(runs).sum() < 1 << 53:  # sums of whole widths are exact
        x0, x1 = edges[starts] - edges[begin], edges[ends] - edges[begin]
    else:
        for r in np.unique(rows).tolist():
            np.cumsum(runs[row_ends[r] - sizes[r] : row_ends[r]], out=edges[row_ends[r] - sizes[r] + 1 : row_ends[r] + 1])
        x0, x1 = np.where(starts == begin, 0.0, edges[starts]), edges[ends]
    columns = [pa.array((np.arange(len(rows)) - np.searchsorted(rows, rows)).astype(np.int32)), pa.array(["Code 128", "Code 39"]).take(pa.array(kind)), value, pa.array(x0.astype(np.int64)), pa.array(x1.astype(np.int64)), pa.array(score)]
    found = pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(rows)) for c in keep], *columns], names=[*keep, *(f.split()[0] for f in READING.split(", "))])
    return found.filter(pc.is_valid(value))


def read_rows(rows: DataFrame, runs: str = "runs", dark: str = "dark") -> DataFrame:
    """The labels in rows of widths: the other columns, ord (order in the row), kind, value, x0, x1, score.

    runs: the widths of bars and gaps from the left end on, in pixels, whole or
    not; dark: whether the first one is a bar.  Labels may begin anywhere, with
    a gap of three modules (or the row's end) at either side, and may be several;
    Code 128 comes before Code 39.  Rows without widths have no label, a missing
    width counts as 0, and a Code 128 label with a wrong checksum isn't one.
    """
    keep = [c for c in rows.columns if c not in (runs, dark)]
    plain = rows.select(*[f"`{c}`" for c in keep], F.col(runs).cast("array<double>").alias("_runs"), F.col(dark).cast("boolean").alias("_dark"))
    schema = T.StructType([*rows.select(*[f"`{c}`" for c in keep]).schema.fields, *T._parse_datatype_string(READING).fields])
    return plain.mapInArrow(lambda batches: _search(batches, keep), schema)


def region_labels(readings: DataFrame, least: int = 2) -> DataFrame:
    """What the rows of a region agree on: region, attempt, place, value, kind, rows, x0, x1, score, reversed.

    readings: labels of read_rows with region, attempt (from the first to try
    on), line, flipped, width (of the enlarged cut-out), factor (of enlargement)
    and left (the cut-out's x on the page).  The first attempt that reads any
    value at least `least` times decides; its values come in order of their
    first reading, which gives the kind.  Boxes of flipped attempts are turned
    back, and all are in the page's pixels.  Where there is a column soft,
    readings of soft edges count only in lines that give none otherwise.
    Readings without a region or value are left out.
    """
    rows = readings.where("region IS NOT NULL AND value IS NOT NULL").repartition("region")
    if "soft" in readings.columns:
        sharp = F.bool_or(~F.col("soft")).over(Window.partitionBy("region", "attempt", "line"))
        rows = rows.withColumn("_sharp", sharp).where("not soft or not _sharp")
    at = F.struct("line", "ord")
    one = lambda c: F.first(c).alias(c)
    seen = rows.groupBy("region", "attempt", "value").agg(F.count("*").alias("rows"), F.min("x0").alias("_a"), F.max("x1").alias("_b"), F.min("score").alias("score"), F.min(at).alias("_at"), F.min_by("kind", at).alias("kind"), *map(one, ("flipped", "width", "factor", "left")))
    mine = Window.partitionBy("region")
    seen = seen.where(F.col("rows") >= least).withColumn("_first", F.min("attempt").over(mine)).where("attempt = _first")
    seen = seen.withColumn("place", F.row_number().over(mine.orderBy("_at", "value")))
    on_page = lambda turned, x: (F.col("left") + F.when(F.col("flipped"), F.col("width") - F.col(turned)).otherwise(F.col(x)) / F.col("factor")).cast("long")
    return seen.select("region", "attempt", "place", "value", "kind", "rows", on_page("_b", "_a").alias("x0"), on_page("_a", "_b").alias("x1"), "score", F.col("flipped").alias("reversed"))
