"""Driver tables projected onto the library's input tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence rows of pages: source, idx, ord, stamp, headed, report, other."""
    line = _read(spark, sf_dir, "lineitem")
    headed = (F.col("l_discount") + 0.0) <= 0.06
    stamp = F.when(F.col("l_returnflag") == "R", "blue").when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "F"), "black").when((F.col("l_returnflag") == "A") & (F.col("l_linestatus") == "O"), "faint")
    return line.select(
        F.concat(F.lit("scan-"), F.col("l_orderkey").cast("string")).alias("source"), (F.col("l_linenumber") - 1).cast("int").alias("idx"),
        F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("ord"), stamp.alias("stamp"), headed.alias("headed"),
        F.when(headed & ((F.col("l_tax") + 0.0) <= 0.06), F.concat(F.lit("RR"), F.col("l_partkey").cast("string"))).alias("report"),
        F.when(~headed, F.concat(F.lit("P"), F.col("l_suppkey").cast("string"))).alias("other"),
    )


def conversation_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages with a decided state: source, idx, barcode, state."""
    conv = _read(spark, sf_dir, "conversations")
    n = F.length("text")
    state = F.when((F.col("role") == "system") | (F.col("turn") == 0) | (n % 5 == 0), "cover").when(n % 11 == 0, "review").otherwise("attachment")
    return conv.select(
        F.concat(F.lit("conv-"), F.col("conv_id").cast("string")).alias("source"), F.col("turn").cast("int").alias("idx"),
        F.when(n % 13 == 0, "").otherwise(F.concat(F.lit("N"), n.cast("string"))).alias("barcode"), state.alias("state"), "text",
    )


def file_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A poll a day of the files in three folders: poll, path, size."""
    e = _read(spark, sf_dir, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    last = e.groupBy(day.alias("poll"), "user_id").agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    path = F.concat(F.lit("/in/"), (F.col("user_id") % 3 + 1).cast("string"), F.lit("/f"), F.col("user_id").cast("string"), F.lit(".pdf"))
    return last.select("poll", path.alias("path"), (F.floor("value").cast("long") % 3).alias("size"))


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for a job's next status: job, ts, event_id, target."""
    e = _read(spark, sf_dir, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    target = F.create_map(*[F.lit(x) for x in ("view", "analyzing", "click", "review", "purchase", "exporting", "signup", "done", "error", "dismissed")])[F.col("event_type")]
    return e.select(F.concat_ws("-", F.col("user_id").cast("string"), F.floor(day / 3).cast("string")).alias("job"), "ts", "event_id", target.alias("target"))


def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text recognised beside a region: text_id, strip, raw; each line of a text, and the heading with letters missing."""
    d = _read(spark, sf_dir, "documents")
    lines = F.split(F.coalesce("text", F.lit("")), r"\r\n|\r|\n", -1)
    made = F.expr("substring('RECEIVING REPORT NO', cast(1 + doc_id % 6 as int))")
    rows = d.select(F.col("doc_id").alias("text_id"), F.posexplode(F.concat(lines, F.array(made))).alias("strip", "raw"))
    return rows.select("text_id", (F.col("strip") + 1).alias("strip"), F.regexp_replace("raw", "[^ -~]", "").alias("raw"))


def reads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Barcode readings of regions: region, attempt, value, x0, x1, score."""
    line = _read(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("region"), (F.col("l_linenumber") % 4).alias("attempt"), F.concat(F.lit("V"), (F.col("l_suppkey") % 3).cast("string")).alias("value"), F.col("l_partkey").alias("x0"), (F.col("l_partkey") + 100).alias("x1"), (1 - (F.col("l_discount") + 0.0)).alias("score"))


def stamp_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circles found on pages: page, key (order within the page), cx, cy, r, score."""
    line = _read(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("page"), F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice").alias("key"), (F.col("l_quantity") * 8).cast("double").alias("cx"), (F.col("l_partkey") % 400).cast("double").alias("cy"), (20 + F.col("l_suppkey") % 10).cast("double").alias("r"), F.col("l_extendedprice").cast("double").alias("score"))
