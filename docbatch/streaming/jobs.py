"""The queue's statuses as keyed state: requests are applied one after another, stored, and recovered after a stop."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docbatch.operators.archive import recover
from docbatch.operators.queue import ALLOWED
from docbatch.sources.shared import children

REQUEST = "job string, ts timestamp, event_id long, target string, expected array<string>"
APPLIED = "job string, ts timestamp, event_id long, status string"
_FINAL = ("done", "dismissed")


class _Status(StatefulProcessor):
    def __init__(self, start: str | None) -> None:
        self.start = start

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.status = handle.getValueState("status", "status string")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.status.update((initialState["status"].iloc[0],))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        status, out = self.status.get()[0] if self.status.exists() else self.start, []
        ordered = pd.concat(list(rows)).sort_values(["ts", "event_id", "target"])
        for ts, event_id, target, expected in ordered[["ts", "event_id", "target", "expected"]].itertuples(index=False, name=None):
            allowed = list(expected) if expected is not None else ALLOWED.get(target, [])
            if status in allowed or (status is None and target == "queued"):
                status = target
                out.append((key[0], ts, event_id, status))
        if status is not None:
            self.status.update((status,))
        if out:
            yield pd.DataFrame(out, columns=["job", "ts", "event_id", "status"])

    def close(self) -> None:
        pass


def job_stream(requests: DataFrame, queue: DataFrame | None = None, start: str | None = "queued") -> DataFrame:
    """Requests (job, ts, event_id, target; expected, an array of statuses, where there is one) to a row per request that applied.

    A request applies only from a status that it expects (null: the fixed rules
    of the target); any other, as one that comes too late, is dropped.  queue
    (job, status) is the state before the first batch.  Other jobs begin as
    start; with start None they begin with a request for queued, and requests
    before that are dropped.  Requests of a job in one batch are taken by ts and
    event_id.  Needs the RocksDB state store.
    """
    expected = F.col("expected") if "expected" in requests.columns else F.lit(None).cast("array<string>")
    rows = requests.where("job IS NOT NULL AND target IS NOT NULL").select("job", F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").cast("long").alias("event_id"), "target", expected.alias("expected"))
    known = queue.where("job IS NOT NULL").groupBy("job").agg(F.max("status").alias("status")).groupBy("job") if queue is not None else None
    return rows.groupBy("job").transformWithStateInPandas(_Status(start), APPLIED, "Append", "None", initialState=known)


def store_statuses(applied: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """Writer of applied requests under root; a batch that comes again writes over itself."""
    return applied.writeStream.foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{root}/statuses/batch={n}")).option("checkpointLocation", checkpoint)


def stored_statuses(spark: SparkSession, root: str, queue: DataFrame | None = None) -> DataFrame:
    """Rows (job, status): the last stored status of each job, else that of the queue (job, status) it started from."""
    none = spark.createDataFrame([], APPLIED)
    log = spark.read.schema(f"{APPLIED}, batch long").parquet(f"{root}/statuses") if children(spark, f"{root}/statuses") else none.withColumn("batch", F.lit(0).cast("long"))
    if queue is not None:
        log = log.unionByName(queue.select("job", F.lit(None).cast("timestamp").alias("ts"), F.lit(-1).cast("long").alias("event_id"), "status", F.lit(-1).cast("long").alias("batch")))
    # within a batch by time; nulls come first
    return log.groupBy("job").agg(F.max_by("status", F.struct("batch", F.coalesce(F.unix_micros("ts"), F.lit(-1)).alias("at"), "event_id")).alias("status"))


def recovery_requests(statuses: DataFrame, published: DataFrame, at: str) -> DataFrame:
    """What a restart asks for, as requests at the time `at`: jobs that were analyzing are queued again, jobs that were exporting are done when committed, else reviewed.

    statuses (job, status), published (job, committed).  Each expects the status
    it was made for, so asking twice in a row changes nothing.
    """
    before = statuses.where(~F.col("status").isin(*_FINAL))
    after = recover(before, published).select("job", F.col("status").alias("target"))
    changed = before.join(after, "job").where("status <> target")
    return changed.select("job", F.lit(at).cast("timestamp").alias("ts"), F.lit(0).cast("long").alias("event_id"), "target", F.array("status").alias("expected"))
