"""Files that stopped changing, from a log of polls or from a stream of them."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from docbatch.operators.queue import ALLOWED, fingerprint, new_files
from docbatch.sources.shared import exists

OUT = "path string, poll long, size long, mtime_ns long"
STATE = "poll long, size long, mtime_ns long, since long, known array<string>"
FIELDS = ["poll", "size", "mtime_ns", "watching", "enqueue_ok"]


def settle(rows: Iterable[tuple], state: tuple | None, stable: int) -> tuple[list[tuple], tuple | None]:
    """Rows (poll, at, size, mtime_ns, watching, complete) of one path by poll; what became stable as (poll, at, size, mtime_ns), and the state after it.

    A new signature starts the clock, and so does a file that a poll missed.  A
    signature is given out once, when it held from one time to another `stable`
    later and the file isn't empty; one given out before leaves the clock alone.
    Where a file isn't complete or can't be queued the clock starts again; a poll
    without watching forgets the file.  A poll that isn't after the last one is
    ignored.
    """
    last, held, since, known = state or (None, None, None, [])
    out = []
    for poll, at, size, mtime, watching, complete in rows:
        if last is not None and poll <= last:
            continue
        if not watching or (last is not None and poll > last + 1):
            held = None
        last = poll
        name = f"{size},{mtime}"
        if not watching or name in known:
            continue
        if held != (size, mtime):
            held, since = (size, mtime), at
        elif at - since >= stable and size:
            if complete:
                out.append((poll, at, size, mtime))
                known = [*known, name]
            else:
                since = at
    return out, (last, held, since, known)


def watch(rows: Iterable[tuple], state: tuple | None, stable: int) -> tuple[list[tuple], tuple | None]:
    """settle with the number of the poll as the time: rows (poll, size, mtime_ns, watching, enqueue_ok), out (poll, size, mtime_ns)."""
    out, state = settle(((poll, poll, *rest) for poll, *rest in rows), state, stable)
    return [(poll, size, mtime) for poll, _, size, mtime in out], state


def _rows(observations: DataFrame) -> DataFrame:
    """Observations with every field; watching and enqueue_ok are true where the columns are missing or null."""
    rows = observations.where("path is not null and size is not null and mtime_ns is not null and poll is not null")
    flags = [f"coalesce({c}, true) {c}" if c in observations.columns else f"true {c}" for c in ("watching", "enqueue_ok")]
    return rows.selectExpr("path", "cast(poll as long) poll", "cast(size as long) size", "cast(mtime_ns as long) mtime_ns", *flags)


def _ordered(pdf: pd.DataFrame) -> list[tuple]:
    return list(pdf.sort_values(["poll", "size", "mtime_ns"])[FIELDS].itertuples(index=False, name=None))


def stable_files(observations: DataFrame, stable: int = 3) -> DataFrame:
    """observations (path, poll, size, mtime_ns) of a whole log; a path has a row per poll at most."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        out, _ = watch(_ordered(pdf), None, stable)
        return pd.DataFrame([(pdf["path"].iloc[0], *o) for o in out], columns=["path", "poll", "size", "mtime_ns"])

    return _rows(observations).groupBy("path").applyInPandas(one, OUT)


def stable_file_stream(observations: DataFrame, stable: int = 3, forget_ms: int | None = None) -> DataFrame:
    """The same over a stream; a path's state is its last signature and the ones given out.

    With forget_ms the state of a path without observations for that long goes.
    If the file comes back it can be given out again; enqueue then finds its
    fingerprint.  Such a stream always has a next batch, so it needs a trigger
    that doesn't end, as processingTime.
    """

    def one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        old = None
        if state.exists:
            last, size, mtime, since, known = state.get
            old = (last, None if size is None else (size, mtime), since, list(known))
        out, (last, held, since, known) = watch(_ordered(pd.concat(list(batches))), old, stable)
        state.update((last, *(held or (None, None)), since, known))
        if forget_ms is not None:
            state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame([(key[0], *o) for o in out], columns=["path", "poll", "size", "mtime_ns"])

    return _rows(observations).groupBy("path").applyInPandasWithState(one, OUT, STATE, "append", GroupStateTimeout.NoTimeout if forget_ms is None else GroupStateTimeout.ProcessingTimeTimeout)


def enqueue(files: DataFrame, queue: str) -> None:
    """Appends a queued job per file (path, size, mtime_ns) whose fingerprint no job in the Parquet folder `queue` has.

    Run again over the same files it adds nothing, so a batch of a stream may be
    repeated after a failure.  The queue is cut into 256 shards by fingerprint,
    and only those of the files' own are read.  With dir_no jobs get the label of
    their folder.
    """
    spark = files.sparkSession
    label = [F.concat(F.lit("Tarama_"), F.col("dir_no").cast("string")).alias("label")] if "dir_no" in files.columns else []
    rows = files.select("path", "size", "mtime_ns", *label, fingerprint().alias("fingerprint")).withColumns({"status": F.lit("queued"), "created": F.current_timestamp()})
    rows = rows.withColumn("shard", F.substring("fingerprint", 1, 2)).persist()
    try:
        shards = [r["shard"] for r in rows.select("shard").distinct().collect()]  # 256 at most
        known = spark.createDataFrame([], "fingerprint string")
        if exists(spark, queue):
            known = spark.read.schema("fingerprint string, shard string").parquet(queue).where(F.col("shard").isin(shards)).select("fingerprint")
        new_files(rows, known).write.mode("append").partitionBy("shard").parquet(queue)
    finally:
        rows.unpersist()


def enqueue_stream(files: DataFrame, queue: str, checkpoint: str) -> DataStreamWriter:
    """Writer of a stream of stable files into the queue; one writer at a time to a queue."""
    return files.writeStream.foreachBatch(lambda batch, _: enqueue(batch, queue)).option("checkpointLocation", checkpoint)


def status_stream(events: DataFrame, start: str = "queued") -> DataFrame:
    """transitions over a stream: a row (job, ts, event_id, status) per request that applied.

    Requests of a job in one batch are taken by ts and event_id; one that comes
    in a later batch than its successors is judged by the status they left.
    """

    def one(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, out = state.get[0] if state.exists else start, []
        for ts, event_id, target in pd.concat(list(batches)).sort_values(["ts", "event_id", "target"])[["ts", "event_id", "target"]].itertuples(index=False, name=None):
            if status in ALLOWED.get(target, []):
                status = target
                out.append((key[0], ts, event_id, status))
        state.update((status,))
        yield pd.DataFrame(out, columns=["job", "ts", "event_id", "status"])

    rows = events.where("job is not null").select("job", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), "target")
    return rows.groupBy("job").applyInPandasWithState(one, "job string, ts timestamp, event_id long, status string", "status string", "append", GroupStateTimeout.NoTimeout)
