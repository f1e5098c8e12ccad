"""Pages of batches under review, kept as versions that late results and decisions are merged into.

The pages are dealt into parts by source.  A merge rewrites only the parts that
its rows touch, under the next version, and then writes that version's log: the
place of every part, and for each stream of changes the last batch merged.  A
batch that comes again finds its number in the log and changes nothing; a merge
that stopped before its log is written over by the next.  One writer at a time.

    root/data/version=V/part=P/   pages; later versions hold the rewritten parts only
    root/log/version=V/           rows (part, version, done)
    root/orphans/stream=S/batch=B/   rows that no page takes
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from docbatch.operators.review import apply_decisions, automatic, merge_results
from docbatch.sources.shared import children, exists, remove

_LOG = "part int, version long, parts int, done map<string,long>"


def _part(parts: int) -> Column:
    return F.pmod(F.xxhash64("source"), F.lit(parts)).cast("int")


def _write(pages: DataFrame, parts: int, root: str, version: int) -> None:
    pages.withColumn("part", _part(parts)).repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{root}/data/version={version}")


def _written(spark: SparkSession, root: str, version: int) -> list[int]:
    return sorted(int(name.removeprefix("part=")) for name in children(spark, f"{root}/data/version={version}") if name.startswith("part="))


def _log(spark: SparkSession, root: str, version: int, place: dict[int, int], parts: int, done: dict[str, int]) -> None:
    """Written last: the version counts from now on."""
    rows = [(p, v, parts, done) for p, v in sorted(place.items())] or [(-1, version, parts, done)]
    spark.createDataFrame(rows, _LOG).coalesce(1).write.mode("overwrite").parquet(f"{root}/log/version={version}")


def _latest(spark: SparkSession, root: str) -> tuple[int, dict[int, int], int, dict[str, int]]:
    """Last version, the version that holds each part, the number of parts, the last batch of each stream."""
    version = max(int(name.removeprefix("version=")) for name in children(spark, f"{root}/log") if exists(spark, f"{root}/log/{name}/_SUCCESS"))
    rows = spark.read.schema(_LOG).parquet(f"{root}/log/version={version}").collect()  # a row per part
    return version, {r["part"]: r["version"] for r in rows if r["part"] >= 0}, rows[0]["parts"], dict(rows[0]["done"])


def _read(spark: SparkSession, root: str, place: dict[int, int]) -> DataFrame:
    schema = spark.read.parquet(f"{root}/data/version=0").drop("part").schema
    paths = [f"{root}/data/version={v}/part={p}" for p, v in place.items()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def create_pages(pages: DataFrame, root: str, parts: int = 64) -> None:
    """The first version; each part is one task of a merge, so parts grow with the table."""
    spark = pages.sparkSession
    _write(pages, parts, root, 0)
    if not _written(spark, root, 0):  # an empty table keeps its columns
        pages.limit(0).withColumn("part", F.lit(0)).write.mode("overwrite").parquet(f"{root}/data/version=0")
    _log(spark, root, 0, dict.fromkeys(_written(spark, root, 0), 0), parts, {})


def current_pages(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The pages of the last version, or of an earlier one that is still there."""
    if version is None:
        return _read(spark, root, _latest(spark, root)[1])
    rows = spark.read.schema(_LOG).parquet(f"{root}/log/version={version}").where("part >= 0").collect()
    return _read(spark, root, {r["part"]: r["version"] for r in rows})


def orphans(spark: SparkSession, root: str) -> DataFrame:
    """Results and decisions that no page took: stream, batch, source, idx."""
    return spark.read.schema("source string, idx int, stream string, batch long").parquet(f"{root}/orphans")


def _merge(batch: DataFrame, batch_id: int, root: str, stream: str, change: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
    spark = batch.sparkSession
    version, place, parts, done = _latest(spark, root)
    if batch_id <= done.get(stream, -1):
        return False
    batch = batch.persist()
    try:
        touched = {r["part"] for r in batch.select(_part(parts).alias("part")).distinct().collect()}  # numbers below parts
        old = _read(spark, root, {p: v for p, v in place.items() if p in touched})
        rest = batch.join(old.select("source", "idx"), ["source", "idx"], "left_anti")
        rest.select("source", F.col("idx").cast("int").alias("idx")).write.mode("overwrite").parquet(f"{root}/orphans/stream={stream}/batch={batch_id}")
        _write(change(old, batch), parts, root, version + 1)
    finally:
        batch.unpersist()
    _log(spark, root, version + 1, place | dict.fromkeys(_written(spark, root, version + 1), version + 1), parts, done | {stream: batch_id})
    return True


def merge_late_results(batch: DataFrame, batch_id: int, root: str) -> bool:
    """Results of analysis (source, idx, ts and the automatic fields) into the pages; whether the batch was new.

    Decisions and numbers of users stay, however late a result is.  Of several
    results of a page in a batch the last by ts counts.
    """

    def change(old: DataFrame, new: DataFrame) -> DataFrame:
        fields = automatic(old)
        last = new.groupBy("source", "idx").agg(F.max_by(F.struct(*fields), "ts").alias("_r")).select("source", "idx", "_r.*")
        return merge_results(old, last)[0]

    return _merge(batch, batch_id, root, "results", change)


def merge_decisions(batch: DataFrame, batch_id: int, root: str) -> bool:
    """Decisions of users (source, idx, ts, event_id, action, number) into the pages; whether the batch was new."""
    return _merge(batch, batch_id, root, "decisions", apply_decisions)


def late_results(results: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """Writer of a stream of results into the pages under root."""
    return results.writeStream.foreachBatch(lambda batch, n: merge_late_results(batch, n, root) and None).option("checkpointLocation", checkpoint)


def decisions_stream(decisions: DataFrame, root: str, checkpoint: str) -> DataStreamWriter:
    """Writer of a stream of decisions into the pages under root; not at the same time as late_results."""
    return decisions.writeStream.foreachBatch(lambda batch, n: merge_decisions(batch, n, root) and None).option("checkpointLocation", checkpoint)


def forget_versions(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Remove logs before the last `keep` versions, and the parts that no log left names."""
    version = _latest(spark, root)[0]
    kept = set()
    for name in children(spark, f"{root}/log"):
        own = int(name.removeprefix("version="))
        if own <= version - keep:
            remove(spark, f"{root}/log/{name}")
        else:
            kept |= {(r["version"], r["part"]) for r in spark.read.schema(_LOG).parquet(f"{root}/log/{name}").collect()}
    for name in children(spark, f"{root}/data"):
        own = int(name.removeprefix("version="))
        for part in _written(spark, root, own):
            # the first version keeps its folder of one part at least, which has the columns
            if own <= version and (own, part) not in kept and (own > 0 or part != min(_written(spark, root, 0))):
                remove(spark, f"{root}/data/{name}/part={part}")
