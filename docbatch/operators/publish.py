"""Publishing a batch: manifests, the pages of documents and, last, commit markers.

A batch is published whole or not at all.  First everything is checked that can
be told without the payload's content; then manifests and pages are written
under the batch's own folders, a document as one ordered run of rows in one file;
then what is on disk is counted against the manifests; and only then are the
markers written.  Readers trust marked jobs alone, so a batch that stops halfway
is never seen, and its folders go.

    root/manifests/batch=B/archive_date=D/      one JSON line per document
    root/pages/batch=B/archive_date=D/archive_dir=H/   rows (job, file, page, source, source_page, n_bytes, content)
    root/markers/batch=B/                       one JSON line per job
"""

from __future__ import annotations

import uuid
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docbatch.functions.text import safe_filename
from docbatch.operators.archive import claim_names, committed, source_drift
from docbatch.operators.grouping import page_runs
from docbatch.operators.saving import archive_folders
from docbatch.sources.shared import exists, read_folders, read_narrow, remove, stored, write_folders

PAGE = "struct<source:string,page:int,state:string,manual:boolean,stamp:string>"
MANIFEST = f"job string, source string, archive_dir string, file string, number string, written timestamp, part int, pages array<{PAGE}>"
MARKER = "job string, source string, mode string, time timestamp, archive_date string, archive_dir string, files array<struct<name:string,size:long>>"


class PublishError(Exception):
    """The batch isn't published; the message has its first problems."""


def document_pages(pages: DataFrame, grouping: str = "shared") -> DataFrame:
    """Rows (source, cover_idx, number, pages): documents with their pages in order, from 1 on, as the manifest lists them.

    A run's pages are gathered once and dealt out to its covers, without a join.
    """
    manual = F.coalesce("decision", F.lit("")) != "" if "decision" in pages.columns else F.lit(False)
    stamp = F.col("stamp") if "stamp" in pages.columns else F.lit(None).cast("string")
    page = F.struct((F.col("idx") + 1).cast("int").alias("page"), F.col("effective_state").alias("state"), manual.alias("manual"), stamp.alias("stamp"))
    runs = page_runs(pages, grouping).where("kind = 'C' or (kind = 'A' and anchor = 'C')").withColumn("_page", page)
    gathered = runs.groupBy("source", "run").agg(F.collect_list(F.when(F.col("kind") == "C", F.struct("idx", "number", "_page"))).alias("_covers"), F.collect_list(F.when(F.col("kind") == "A", F.col("_page"))).alias("_following"))
    dealt = gathered.select("source", F.explode("_covers").alias("_c"), "_following")
    ordered = F.sort_array(F.concat(F.array("_c._page"), "_following"))
    item = lambda p: F.struct(F.col("source").alias("source"), p["page"].alias("page"), p["state"].alias("state"), p["manual"].alias("manual"), p["stamp"].alias("stamp"))
    return dealt.select("source", F.col("_c.idx").alias("cover_idx"), F.col("_c.number").alias("number"), ordered.alias("_p")).select("source", "cover_idx", "number", F.transform("_p", item).alias("pages"))


def publication_problems(pages: DataFrame, payload: DataFrame, current: DataFrame | None = None, grouping: str = "shared") -> DataFrame:
    """Rows (source, problem, n_pages) of sources that can't be published.

    problem, the first that holds: missing or changed (the file against the
    pages' source_signature, a null one passes; current has source and
    signature), no_documents, lost_page, duplicate_page (payload rows of a page
    of a document).  Only the keys of the payload are read.
    """
    runs = page_runs(pages, grouping).withColumn("_in", (F.col("kind") == "C") | ((F.col("kind") == "A") & F.col("anchor").eqNullSafe("C")))
    there = payload.groupBy("source", "idx").agg(F.count("*").alias("_rows"))
    seen = runs.join(there, ["source", "idx"], "left").withColumn("_rows", F.coalesce("_rows", F.lit(0)))
    out = seen.groupBy("source").agg(F.count_if("_in").alias("_documents"), F.count_if(F.col("_in") & (F.col("_rows") == 0)).alias("_lost"), F.count_if(F.col("_in") & (F.col("_rows") > 1)).alias("_twice"))
    state = F.lit(None).cast("string")
    if current is not None and "source_signature" in pages.columns:
        recorded = pages.groupBy("source").agg(F.max("source_signature").alias("signature"))
        drift = source_drift(recorded, current)
        drift = drift.join(recorded.where("signature IS NOT NULL").select("source"), "source", "left_semi")
        out = out.join(drift, "source", "left")
        state = F.when(F.col("missing"), "missing").when(F.col("drifted"), "changed")
    problem = F.coalesce(state, F.when(F.col("_documents") == 0, "no_documents").when(F.col("_lost") > 0, "lost_page").when(F.col("_twice") > 0, "duplicate_page"))
    n = F.when(problem == "lost_page", F.col("_lost")).when(problem == "duplicate_page", F.col("_twice")).otherwise(F.lit(0))
    return out.select("source", problem.alias("problem"), n.cast("long").alias("n_pages")).where("problem IS NOT NULL")


def _stop_on(problems: DataFrame, what: str) -> None:
    first = problems.limit(5).collect()
    if first:
        raise PublishError(f"{what}: " + "; ".join(", ".join(str(x) for x in r) for r in first))


def taken_folders(spark: SparkSession, root: str, dates: DataFrame) -> DataFrame | None:
    """(archive_date, stem, number) of the folders of earlier batches, at the dates (archive_date) alone."""
    if not exists(spark, f"{root}/manifests"):
        return None
    known = spark.read.schema(f"{MANIFEST}, batch string, archive_date string").json(f"{root}/manifests").select("archive_date", "archive_dir").join(F.broadcast(dates), "archive_date", "left_semi")
    parts = known.distinct().withColumns({"stem": F.regexp_extract("archive_dir", r"^(.*)_(\d+)$", 1), "number": F.regexp_extract("archive_dir", r"^(.*)_(\d+)$", 2).cast("int")})
    return parts.select("archive_date", "stem", "number")


def _manifests(pages: DataFrame, jobs: DataFrame, root: str, grouping: str, written: Column, rows_per_file: int) -> DataFrame:
    spark = pages.sparkSession
    # the dates of one batch of jobs are days, some thousands at most
    dates = jobs.select(F.date_format("created", "yyyy-MM-dd").alias("archive_date")).distinct()
    folders = archive_folders(jobs, taken_folders(spark, root, dates)).select(F.col("id").cast("string").alias("job"), "source", "archive_date", "archive_dir")
    folder = F.concat_ws("/", "archive_date", "archive_dir")
    documents = stored(document_pages(pages, grouping).join(folders, "source").withColumn("folder", folder), "documents")
    stem = F.coalesce(safe_filename(F.col("number")), F.raise_error(F.concat(F.lit("no file name in number "), F.col("number"))).cast("string"))
    names = claim_names(documents.select("folder", stem.alias("stem"), "cover_idx"), spark.createDataFrame([], "folder string, stem string, number int"), "cover_idx")
    named = documents.join(names.select("folder", "cover_idx", F.col("name").alias("file")), ["folder", "cover_idx"])
    before = F.sum(F.size("pages")).over(Window.partitionBy("folder").orderBy("cover_idx")) - F.size("pages")
    return named.select("job", "source", "archive_date", "archive_dir", "file", "number", written.alias("written"), F.floor(before / rows_per_file).cast("int").alias("part"), "pages")


def publish(pages: DataFrame, payload: DataFrame, jobs: DataFrame, root: str, current: DataFrame | None = None, mode: str = "automatic", grouping: str = "shared", rows_per_file: int = 5000, batch: str | None = None, at: datetime | None = None) -> DataFrame:
    """Publish the documents of all jobs under root; returns the batch's markers.

    pages (source, idx, number, effective_state; decision, stamp and
    source_signature where there are), payload (source, idx, content), jobs (id,
    source, created, label; one per source), current (source, signature): the
    files as they are now.  A source without a job takes no part, a job without
    pages is a problem.  Null content is written as such, of 0 bytes.  Any
    problem raises PublishError, and nothing of the batch stays.
    """
    spark = pages.sparkSession
    batch = batch or "b" + uuid.uuid4().hex  # never read as a number
    # both are read many times: what they come from is worked out once
    jobs = stored(jobs.select("id", "source", "created", "label"), "jobs")
    used = [c for c in ("source", "idx", "number", "effective_state", "decision", "stamp", "source_signature") if c in pages.columns]
    mine = stored(pages.select(*used).join(jobs.select("source"), "source", "left_semi"), "pages")
    _stop_on(jobs.groupBy("source").agg(F.count("*").alias("n")).where("n > 1").select("source", F.lit("several_jobs")), "not published")
    _stop_on(jobs.select("source").join(mine.select("source").distinct(), "source", "left_anti").select("source", F.lit("no_pages")), "not published")
    _stop_on(publication_problems(mine, payload, current, grouping), "not published")
    place = {kind: f"{root}/{kind}/batch={batch}" for kind in ("manifests", "pages", "markers")}
    time = F.lit(at or datetime.now(timezone.utc)).cast("timestamp")
    try:
        _manifests(mine, jobs, root, grouping, time, rows_per_file).write.partitionBy("archive_date").json(place["manifests"])
        manifests = spark.read.schema(f"{MANIFEST}, archive_date string").json(place["manifests"])
        wanted = manifests.select("job", "archive_date", "archive_dir", "file", "part", F.posexplode("pages").alias("_at", "_p"))
        wanted = wanted.select("job", "archive_date", "archive_dir", "file", "part", (F.col("_at") + 1).alias("page"), F.col("_p.source").alias("source"), F.col("_p.page").alias("source_page"))
        content = payload.select("source", (F.col("idx") + 1).cast("int").alias("source_page"), F.coalesce(F.octet_length("content"), F.lit(0)).cast("long").alias("n_bytes"), "content")
        rows = wanted.join(content, ["source", "source_page"]).select("job", "archive_date", "archive_dir", "part", "file", "page", "source", "source_page", "n_bytes", "content")
        # a folder's documents lie together, rows_per_file pages to a task and file; a document is never cut
        write_folders(rows.repartition("archive_date", "archive_dir", "part").sortWithinPartitions("archive_date", "archive_dir", "file", "page").drop("part"), place["pages"], "archive_date", "archive_dir")
        sizes = stored(document_listing(spark, root, batch).drop("source_pages"), "sizes")
        counted = manifests.select("job", F.col("file").alias("name"), F.size("pages").cast("long").alias("wanted")).join(sizes, ["job", "name"], "full")
        _stop_on(counted.where("NOT (wanted <=> pages) OR NOT (wanted <=> distinct_pages)").select("job", "name", "wanted", "pages"), "pages on disk differ from the manifests")
        source = manifests.groupBy("job").agg(F.first("source").alias("source"), F.first("archive_date").alias("archive_date"), F.first("archive_dir").alias("archive_dir"))
        files = sizes.groupBy("job").agg(F.sort_array(F.collect_list(F.struct("name", "size"))).alias("files"))
        markers = source.join(files, "job").select("job", "source", F.lit(mode).alias("mode"), time.alias("time"), "archive_date", "archive_dir", "files")
        markers.write.json(place["markers"])
    except BaseException:
        for path in place.values():
            remove(spark, path)
        raise
    return spark.read.schema(MARKER).json(place["markers"])


def document_listing(spark: SparkSession, root: str, batch: str | None = None) -> DataFrame:
    """The documents on disk: job, name, size in bytes, pages, distinct_pages, source_pages in order; no content is read.  A document's pages are bounded as its source's are."""
    path = f"{root}/pages" + (f"/batch={batch}" if batch else "")
    columns = {"job": "string", "file": "string", "page": "int", "source_page": "int", "n_bytes": "long"}
    rows = read_narrow(spark, path, columns, 2 if batch else 3)
    ordered = F.sort_array(F.collect_list(F.struct("page", "source_page")))
    return rows.groupBy("job", F.col("file").alias("name")).agg(F.sum("n_bytes").alias("size"), F.count("*").alias("pages"), F.size(F.collect_set("page")).cast("long").alias("distinct_pages"), F.transform(ordered, lambda p: p["source_page"]).alias("source_pages"))


def published_jobs(spark: SparkSession, root: str, listing: DataFrame | None = None) -> DataFrame:
    """Per marked job its marker and whether every listed document is there in its size: job, source, mode, time, archive_date, archive_dir, files (their number), committed.

    listing: that of document_listing, where it is at hand.
    """
    if not exists(spark, f"{root}/markers"):
        return spark.createDataFrame([], MARKER.replace("files array<struct<name:string,size:long>>", "files long, committed boolean"))
    markers = spark.read.schema(MARKER).json(f"{root}/markers")
    listed = markers.select("job", F.explode_outer("files").alias("_f")).select("job", "_f.name", "_f.size")
    there = document_listing(spark, root) if listing is None else listing
    done = committed(listed, there.select("job", "name", "size"))
    return markers.drop("files").join(done, "job")


def published_pages(spark: SparkSession, root: str) -> DataFrame:
    """The pages of committed jobs; those of any other are passed over."""
    done = published_jobs(spark, root).where("committed").select("job")
    return read_folders(spark, f"{root}/pages", "batch", "archive_date", "archive_dir").join(done, "job", "left_semi")
