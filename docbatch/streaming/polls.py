"""Watched folders as a stream: a source whose offsets are polls, and the files in them that stay the same for some seconds."""

from __future__ import annotations

import json
import time
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from docbatch.streaming.watch import settle

POLLS = "poll long, at_ms long, dir_no int, folder string, path string, size long, mtime_ns long, complete boolean, error string"
STABLE = "path string, dir_no int, poll long, at_ms long, size long, mtime_ns long"
_TAIL = 4096
_END = b"%%EOF"


@dataclass
class _Folder(InputPartition):
    dir_no: int
    folder: str
    poll: int
    at_ms: int


class _PollReader(DataSourceStreamReader):
    """One poll per trigger, `every_ms` after the last at the earliest; each folder is listed by a task of its own.

    A task records what it listed under `log` before it gives it out, and a task
    that runs again for the same poll reads the record: batches can be repeated.
    """

    def __init__(self, options: dict) -> None:
        self.folders, self.log = json.loads(options["folders"]), options["log"].rstrip("/")
        self.suffix, self.every_ms = options.get("suffix", ".pdf").lower(), int(options.get("every_ms", "1000"))
        self.last: dict | None = None

    def initialOffset(self) -> dict:
        return {"poll": 0, "at_ms": 0}

    def latestOffset(self) -> dict:
        now = time.time_ns() // 1_000_000
        if self.last is None:
            system, base = pafs.FileSystem.from_uri(self.log)
            polls = [int(f.base_name.removeprefix("poll=")) for f in system.get_file_info(pafs.FileSelector(base, allow_not_found=True)) if f.base_name.startswith("poll=")]
            self.last = {"poll": max(polls, default=0), "at_ms": 0}
        if now - self.last["at_ms"] >= self.every_ms:
            self.last = {"poll": self.last["poll"] + 1, "at_ms": now}
        return self.last

    def partitions(self, start: dict, end: dict) -> Sequence[InputPartition]:
        if end["poll"] <= start["poll"]:
            return []
        return [_Folder(k, folder, end["poll"], end["at_ms"]) for k, folder in enumerate(self.folders, 1)]

    def read(self, partition: _Folder) -> Iterator[tuple]:
        system, base = pafs.FileSystem.from_uri(self.log)
        record = f"{base}/poll={partition.poll}/dir={partition.dir_no}.json"
        if system.get_file_info(record).type == pafs.FileType.NotFound:
            listed = self._listed(partition.folder)
            system.create_dir(f"{base}/poll={partition.poll}", recursive=True)
            with system.open_output_stream(f"{record}.new") as out:
                out.write(json.dumps(listed).encode())
            system.move(f"{record}.new", record)
        with system.open_input_stream(record) as stream:
            listed = json.loads(stream.read())
        for path, size, mtime_ns, complete, error in listed:
            yield partition.poll, partition.at_ms, partition.dir_no, partition.folder, path, size, mtime_ns, complete, error

    def _listed(self, folder: str) -> list[tuple]:
        """path, size, mtime_ns, complete, error of the files directly in a folder; one row without a path where it can't be listed."""
        try:
            system, base = pafs.FileSystem.from_uri(folder)
            found = sorted((f for f in system.get_file_info(pafs.FileSelector(base)) if f.is_file and f.base_name.lower().endswith(self.suffix)), key=lambda f: f.path)
        except (OSError, ValueError) as e:
            return [(None, None, None, None, str(e))]
        rows = []
        for f in found:
            try:
                with system.open_input_file(f.path) as stream:
                    stream.seek(max(f.size - _TAIL, 0))
                    complete, error = _END in stream.read(_TAIL), None
            except OSError as e:
                complete, error = False, str(e)
            rows.append((f.path, f.size, f.mtime_ns, complete, error))
        return rows

    def commit(self, end: dict) -> None:
        pass


class FolderPolls(DataSource):
    """Options: folders (a JSON list of URIs), log (a shared folder of the source's own), suffix, every_ms."""

    @classmethod
    def name(cls) -> str:
        return "folder_polls"

    def schema(self) -> str:
        return POLLS

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _PollReader(dict(self.options))


def folder_polls(spark: SparkSession, folders: list[str], log: str, every_ms: int = 1000) -> DataFrame:
    """A stream of polls of the folders, in the order of their labels: a row per file, or per folder that can't be listed (error)."""
    spark.dataSource.register(FolderPolls)
    return spark.readStream.format("folder_polls").option("folders", json.dumps(folders)).option("log", log).option("every_ms", str(every_ms)).load()


class _Settled(StatefulProcessor):
    """State of a path: its clock, forgotten by a timer, and the signatures given out, which live `known_ms`."""

    def __init__(self, stable_ms: int, forget_ms: int, known_ms: int | None) -> None:
        self.stable_ms, self.forget_ms, self.known_ms = stable_ms, forget_ms, known_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.clock = handle.getValueState("clock", "poll long, size long, mtime_ns long, since long")
        self.known = handle.getMapState("known", "signature string", "given boolean", self.known_ms)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        for size, mtime_ns in initialState[["size", "mtime_ns"]].itertuples(index=False, name=None):
            self.known.updateValue((f"{size},{mtime_ns}",), (True,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        table = pd.concat(list(rows)).sort_values(["poll", "size", "mtime_ns"])
        poll, size, mtime_ns, since = self.clock.get() if self.clock.exists() else (None, None, None, None)
        known = [k[0] for k in self.known.keys()]
        seen = list(table[["poll", "at_ms", "size", "mtime_ns", "watching", "complete"]].itertuples(index=False, name=None))
        out, (poll, held, since, after) = settle(seen, (poll, None if size is None else (size, mtime_ns), since, known), self.stable_ms)
        self.clock.update((poll, *(held or (None, None)), since))
        for name in after[len(known) :]:
            self.known.updateValue((name,), (True,))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.forget_ms)
        if out:
            yield pd.DataFrame([(key[0], int(table["dir_no"].iloc[-1]), *o) for o in out], columns=["path", "dir_no", "poll", "at_ms", "size", "mtime_ns"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.clock.clear()
        return iter([])

    def close(self) -> None:
        pass


def settled_files(polls: DataFrame, stable_ms: int = 3000, forget_ms: int = 600_000, known_ms: int | None = None, queued: DataFrame | None = None) -> DataFrame:
    """Files of a stream of polls (poll, at_ms, path, size, mtime_ns) that stayed the same for stable_ms and aren't empty, each signature once.

    A poll in which a path is missing makes it forgotten, so polls are numbered
    without gaps and a path has a row in each poll that finds it.  The time is
    the polls' own.  Optional columns: dir_no; watching, false forgets the path;
    complete, false starts its clock again.  A path's clock goes after forget_ms
    without a poll; signatures given out are known for known_ms (null: always).
    queued (path, size, mtime_ns): files that are in the queue already, known
    from the first batch on.  Needs the RocksDB state store.
    """
    flag = lambda name, default: F.coalesce(F.col(name), F.lit(default)).alias(name) if name in polls.columns else F.lit(default).alias(name)
    rows = polls.where("path IS NOT NULL AND size IS NOT NULL AND mtime_ns IS NOT NULL AND poll IS NOT NULL AND at_ms IS NOT NULL")
    rows = rows.select("path", flag("dir_no", 0), F.col("poll").cast("long").alias("poll"), F.col("at_ms").cast("long").alias("at_ms"), F.col("size").cast("long").alias("size"), F.col("mtime_ns").cast("long").alias("mtime_ns"), flag("watching", True), flag("complete", True))
    known = queued.select("path", F.col("size").cast("long").alias("size"), F.col("mtime_ns").cast("long").alias("mtime_ns")).groupBy("path") if queued is not None else None
    return rows.groupBy("path").transformWithStateInPandas(_Settled(stable_ms, forget_ms, known_ms), STABLE, "Append", "ProcessingTime", initialState=known)
