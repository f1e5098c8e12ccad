"""Folders that the driver and all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LOCAL: dict[str, str] = {}


def shared_root(spark: SparkSession) -> str:
    """Folder of ``spark.checkpoint.dir``; one of the driver's own only where that is unset and all runs in its process, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="docbatch-")
    return _LOCAL[context.applicationId]


def fresh_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/docbatch/{uuid.uuid4().hex}/{name}"


def stored(rows: DataFrame, name: str) -> DataFrame:
    """rows written to a fresh shared folder and read back: lineage ends there, and a lost executor loses nothing."""
    path = fresh_folder(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def dealt(rows: DataFrame, *keys: str, rows_per_task: int = 100_000) -> DataFrame:
    """rows dealt out by keys to as many tasks as there are rows for: what a task holds doesn't grow with the table."""
    n = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // rows_per_task))
    return rows.repartition(n, *keys)


def _file_system(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _on_disk(spark: SparkSession, path: str) -> str | None:
    """The path on a disk, or None where the file system isn't one of disks."""
    place, system = _file_system(spark, path)
    uri = system.makeQualified(place).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def read_folders(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """All columns of write_folders, and keys as strings from the folders' names.

    Listed by four tasks a core (Spark would start one for each folder) and
    without its search for partitions, whose time grows with the square of them.
    """
    name = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(name)
    spark.conf.set(name, str(4 * spark.sparkContext.defaultParallelism))
    try:
        rows = spark.read.options(**{"recursiveFileLookup": "true", "parquet.page.verify-checksum.enabled": "true"}).parquet(path)
    finally:
        spark.conf.set(name, before)
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    # a value is escaped in its folder's name, and that name again in the file's address
    values = {k: plain(plain(F.regexp_extract("_metadata.file_path", f"^.*/{k}=([^/]*)/", 1))) for k in keys}
    return rows.withColumns({k: F.nullif(v, F.lit("__HIVE_DEFAULT_PARTITION__")) for k, v in values.items()}) if keys else rows


def read_narrow(spark: SparkSession, path: str, columns: dict[str, str], depth: int, folders_per_task: int = 1000) -> DataFrame:
    """Some narrow columns (name: string, int or long) of the files of write_folders, depth levels of folders below path.

    On disks the tasks list and read the files themselves: Spark's reader takes
    some eight times as long to open one, and its driver keeps all their names.
    """
    base = _on_disk(spark, path)
    if base is None:
        return read_folders(spark, path).select(*columns)
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
    wanted = pa.schema([(c, kinds[kind]) for c, kind in columns.items()])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch["path"].to_pylist():
                found = [e.path for e in os.scandir(folder) if e.is_dir() and e.name[0] not in "._"]
                for at in range(0, len(found), 10_000):
                    yield pa.RecordBatch.from_pydict({"path": pa.array(found[at : at + 10_000], pa.string())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, n = [], 0
        for batch in batches:
            for folder in batch["path"].to_pylist():
                for file in sorted(e.path for e in os.scandir(folder) if e.name[0] not in "._"):
                    with pq.ParquetFile(file, page_checksum_verification=True) as rows:
                        kept.append(rows.read(columns=wanted.names, use_threads=False).select(wanted.names).cast(wanted))
                    n += kept[-1].num_rows
                    if n >= 10_000:
                        yield from pa.concat_tables(kept).combine_chunks().to_batches()
                        kept, n = [], 0
        if n:
            yield from pa.concat_tables(kept).combine_chunks().to_batches()

    folders = spark.createDataFrame([(base,)], "path string")
    for _ in range(depth):
        folders = folders.repartition("path").mapInArrow(inside, "path string")
    return dealt(folders, "path", rows_per_task=folders_per_task).mapInArrow(read, ", ".join(f"{c} {kind}" for c, kind in columns.items()))


def write_folders(rows: DataFrame, path: str, *keys: str) -> None:
    """rows, sorted by the string columns keys within each task, to Parquet under path/key=value/..., one file a folder and task.

    Spark's own writer starts three processes for each file on disks without
    Hadoop's native code, so there each task writes its files itself, under
    hidden names until they are whole; a task that runs again replaces them.
    """
    base = _on_disk(rows.sparkSession, path)
    if base is None:
        return rows.write.partitionBy(*keys).parquet(path)

    def escaped(value: str | None) -> str:  # as Spark names a partition's folder
        return re.sub(r"""[\x01-\x1f\x7f"#%'*/:=?\\{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", value) if value else "__HIVE_DEFAULT_PARTITION__"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        name, attempt = f"part-{context.partitionId():05d}.snappy.parquet", context.taskAttemptId()
        folder, writer, begun = None, None, set()

        def close() -> None:
            writer.close()
            os.replace(f"{folder}/.{name}.{attempt}", f"{folder}/{name}")

        try:
            for batch in batches:
                table, at = pa.Table.from_batches([batch]), 0
                own = table.drop_columns(list(keys))
                for values, run in groupby(zip(*(table[k].to_pylist() for k in keys), strict=True)):
                    size = sum(1 for _ in run)
                    to = os.path.join(base, *(f"{k}={escaped(v)}" for k, v in zip(keys, values, strict=True)))
                    if to != folder:
                        if writer:
                            close()
                        if to in begun:
                            raise ValueError(f"rows not sorted by folder: {to}")
                        os.makedirs(to, exist_ok=True)
                        begun.add(to)
                        folder = to
                        writer = pq.ParquetWriter(f"{to}/.{name}.{attempt}", own.schema, store_schema=False, write_page_checksum=True)
                    writer.write_table(own.slice(at, size))
                    at += size
            if writer:
                close()
        except BaseException:
            if writer and os.path.exists(f"{folder}/.{name}.{attempt}"):
                os.remove(f"{folder}/.{name}.{attempt}")
            raise
        yield pa.RecordBatch.from_pydict({"folders": [len(begun)]})

    rows.mapInArrow(write, "folders long").write.format("noop").mode("overwrite").save()


def exists(spark: SparkSession, path: str) -> bool:
    place, system = _file_system(spark, path)
    return system.exists(place)


def children(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly in a folder; none where there is no such folder."""
    place, system = _file_system(spark, path)
    if not system.exists(place):
        return []
    return sorted(s.getPath().getName() for s in system.listStatus(place) if s.isDirectory())


def remove(spark: SparkSession, path: str) -> None:
    place, system = _file_system(spark, path)
    system.delete(place, True)
