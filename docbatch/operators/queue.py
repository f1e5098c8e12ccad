"""The queue of scanned files as batch jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Labels of earlier versions.
OLD_LABELS = ("Canon", "Kodak")
# The statuses from which a job may go to another.
ALLOWED = {"queued": ["analyzing"], "analyzing": ["queued"], "review": ["analyzing", "exporting"], "exporting": ["review", "analyzing"], "done": ["exporting"], "error": ["analyzing"], "dismissed": ["queued", "analyzing", "review", "error"]}


def transitions(events: DataFrame, start: str = "queued") -> DataFrame:
    """Per job the status after all requests in time order; a request from a status that doesn't allow it is ignored.

    Optional column expected (array of statuses): what a request allows, in place of the fixed rules.
    """
    allowed = F.create_map(*[x for k, v in ALLOWED.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    expected = F.col("expected") if "expected" in events.columns else allowed[F.col("target")]
    ordered = F.sort_array(F.collect_list(F.struct("ts", "event_id", "target", expected.alias("expected"))))
    step = lambda acc, e: F.when(F.array_contains(e["expected"], acc["status"]), F.struct(e["target"].alias("status"), (acc["applied"] + 1).alias("applied"))).otherwise(acc)
    folded = F.aggregate("_e", F.struct(F.lit(start).alias("status"), F.lit(0).cast("long").alias("applied")), step)
    return events.groupBy("job").agg(ordered.alias("_e")).select("job", folded.alias("_f"), F.size("_e").cast("long").alias("requested")).select("job", "_f.status", "_f.applied", "requested")


def fingerprint(path: str = "path", size: str = "size", mtime: str = "mtime_ns"):
    return F.sha2(F.concat(F.col(path), F.lit("|("), F.col(size).cast("string"), F.lit(", "), F.col(mtime).cast("string"), F.lit(")")), 256)


def new_files(files: DataFrame, queue: DataFrame) -> DataFrame:
    """Files whose fingerprint no job of any status has, each once."""
    return files.dropDuplicates(["fingerprint"]).join(queue.select("fingerprint"), "fingerprint", "left_anti")


def folder_labels(files: DataFrame, folders: list[str]) -> DataFrame:
    """label Tarama_<place of the file's folder>; files of other folders are the first's or second's, the first only by its old label in a column label."""
    places = F.create_map(*[x for k, d in enumerate(folders) for x in (F.lit(d), F.lit(k + 1))])
    parent = F.regexp_replace("path", "/[^/]*$", "")
    other = F.when(F.col("label") == OLD_LABELS[0], 1).otherwise(2) if "label" in files.columns else F.lit(2)
    return files.withColumn("label", F.concat(F.lit("Tarama_"), F.coalesce(places[parent], other).cast("string")))


def relabel_jobs(jobs: DataFrame, folders: list[str]) -> DataFrame:
    """Pending jobs (path, status, label) with an old label take that of their folder, or 1 or 2 by the label where the folder is unknown."""
    places = F.create_map(*[x for k, d in enumerate(folders) for x in (F.lit(d), F.lit(k + 1))])
    old = F.when(F.col("label") == OLD_LABELS[0], 1).when(F.col("label") == OLD_LABELS[1], 2)
    place = F.coalesce(places[F.regexp_replace("path", "/[^/]*$", "")], old)
    pending = F.col("status").isin("queued", "analyzing", "review", "error", "exporting")
    return jobs.withColumn("label", F.when(old.isNotNull() & pending, F.concat(F.lit("Tarama_"), place.cast("string"))).otherwise(F.col("label")))
