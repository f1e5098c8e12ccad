"""Writing documents: complete files, pages as JSON, manifests, folders, payload and commit markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docbatch.functions.text import safe_filename
from docbatch.operators.archive import kth_free
from docbatch.operators.grouping import membership

#: The fields of a saved page, in order, and what a missing one is read as; a null stays null only in the signature.
EVIDENCE = "array<struct<kind:string,box:array<double>,confidence:double,detail:string>>"
FIELDS = {
    "idx": ("int", None), "barcode": ("string", ""), "target_found": ("boolean", False), "stamp": ("string", "none"), "state": ("string", "pending"), "reason": ("string", ""), "evidence": (EVIDENCE, []),
    "decision": ("string", ""), "manual_barcode": ("string", ""), "other_barcodes": ("array<string>", []), "source_signature": ("array<bigint>", None), "first_page_error": ("boolean", False),
}


def complete_pdf(content: Column) -> Column:
    """Whether binary content has its end mark in the last 4096 bytes."""
    return F.contains(F.substring(content, -4096, 4096), F.lit(b"%%EOF"))


def encode_pages(pages: DataFrame) -> DataFrame:
    """pages (source, idx and what there is of FIELDS) to one JSON array per source, in page order.

    Boxes of evidence (struct x0, y0, x1, y1) become arrays of four, the signature
    (struct size, mtime_ns) one of two, or null.
    """
    boxed = lambda e: F.struct(e["kind"].alias("kind"), F.array(*[e["box"][c].cast("double") for c in ("x0", "y0", "x1", "y1")]).alias("box"), e["confidence"].alias("confidence"), e["detail"].alias("detail"))
    own = {c: F.col(c) for c in FIELDS if c in pages.columns}
    if "evidence" in own:
        own["evidence"] = F.transform("evidence", boxed)
    if "source_signature" in own:
        own["source_signature"] = F.when(F.col("source_signature").isNotNull(), F.array("source_signature.size", "source_signature.mtime_ns"))
    page = F.struct(*[c.alias(name) for name, c in own.items()])
    keyed = F.sort_array(F.collect_list(F.struct(F.col("idx").alias("_idx"), F.to_json(page, {"ignoreNullFields": "false"}).alias("_page"))))
    return pages.groupBy("source").agg(keyed.alias("_p")).select("source", F.concat(F.lit("["), F.array_join(F.transform("_p", lambda p: p["_page"]), ","), F.lit("]")).alias("pages"))


def decode_pages(jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """jobs (source, pages) of encode_pages to (pages, broken): every field of FIELDS, and rows (source, problem, detail).

    Fields that aren't there take their defaults, unknown ones are passed over.
    A text that isn't an array is broken (not_an_array), and so is a page that
    isn't an object of these types or has no idx (bad_page); one broken page
    breaks its whole source, of which no page comes out.
    """
    raw = jobs.select("source", "pages", F.from_json("pages", "array<string>").alias("_items"))
    not_array = raw.where(F.col("_items").isNull()).select("source", F.lit("not_an_array").alias("problem"), F.col("pages").alias("detail"))
    schema = ", ".join(f"{c} {kind}" for c, (kind, _) in FIELDS.items()) + ", _bad string"
    items = raw.select("source", F.posexplode("_items").alias("_at", "_item"))
    read = items.withColumn("_page", F.from_json("_item", schema, {"columnNameOfCorruptRecord": "_bad"}))
    wrong = F.col("_page.idx").isNull() | F.col("_page._bad").isNotNull() | F.coalesce(F.size("_page.source_signature") != 2, F.lit(False)) | F.coalesce(F.exists("_page.evidence", lambda e: F.size(e["box"]) != 4), F.lit(False))
    bad = read.where(wrong).select("source", F.lit("bad_page").alias("problem"), F.col("_item").alias("detail"))
    broken = not_array.unionByName(bad)
    unboxed = lambda e: F.struct(e["kind"].alias("kind"), F.struct(*[e["box"][k].alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))]).alias("box"), e["confidence"].alias("confidence"), e["detail"].alias("detail"))
    signature = F.when(F.col("_page.source_signature").isNotNull(), F.struct(F.col("_page.source_signature")[0].alias("size"), F.col("_page.source_signature")[1].alias("mtime_ns")))
    special = {"evidence": F.transform(F.coalesce("_page.evidence", F.array().cast(EVIDENCE)), unboxed), "source_signature": signature}
    default = lambda kind, value: (F.array() if value == [] else F.lit(value)).cast(kind)
    columns = [special.get(c, F.coalesce(f"_page.{c}", default(kind, value))).alias(c) for c, (kind, value) in FIELDS.items()]
    return read.join(broken.select("source").distinct(), "source", "left_anti").select("source", *columns), broken


def manifests(pages: DataFrame, grouping: str = "shared") -> DataFrame:
    """One row per document with its pages as JSON: source, page from 1 on, state, whether a user decided, stamp."""
    info = pages.select("source", F.col("idx").alias("page_idx"), "effective_state", (F.coalesce("decision", F.lit("")) != "").alias("manual"), "stamp")
    rows = membership(pages, grouping).join(info, ["source", "page_idx"])
    # sorted by the page, which comes first, and then put into the manifest's order of fields
    listed = F.sort_array(F.collect_list(F.struct((F.col("page_idx") + 1).alias("page"), "effective_state", "manual", "stamp")))
    rows = rows.groupBy("source", "cover_idx", "number").agg(listed.alias("_p"))
    item = lambda x: F.struct(F.col("source").alias("source"), x["page"].alias("page"), x["effective_state"].alias("state"), x["manual"].alias("manual"), x["stamp"].alias("stamp"))
    return rows.select("source", "cover_idx", "number", F.to_json(F.transform("_p", item)).alias("pages"))


def archive_folders(jobs: DataFrame, taken: DataFrame | None = None) -> DataFrame:
    """jobs (id, created, label) with archive_date and archive_dir: HH-mm-ss_label_NNN, the first free numbers by id.

    taken: (archive_date, stem, number) of folders that exist; gaps between them
    are filled first.  The label is made safe for a file name; one that has
    nothing left raises an error.
    """
    label = F.coalesce(safe_filename(F.col("label")), F.raise_error(F.lit("no folder name in a label")).cast("string"))
    rows = jobs.withColumns({"archive_date": F.date_format("created", "yyyy-MM-dd"), "_stem": F.concat(F.date_format("created", "HH-mm-ss"), F.lit("_"), label)})
    number = F.row_number().over(Window.partitionBy("archive_date", "_stem").orderBy("id"))
    if taken is not None:
        used = taken.groupBy("archive_date", F.col("stem").alias("_stem")).agg(F.array_sort(F.collect_set(F.col("number").cast("int"))).alias("_used"))
        rows = rows.withColumn("_k", number).join(used, ["archive_date", "_stem"], "left")
        number = kth_free(F.col("_k"), F.col("_used"))
    return rows.withColumn("archive_dir", F.concat("_stem", F.lit("_"), F.when(number < 100, F.lpad(number.cast("string"), 3, "0")).otherwise(number.cast("string")))).drop("_stem", "_k", "_used")


def export_pages(members: DataFrame, payload: DataFrame, path: str) -> DataFrame:
    """Write the pages of documents under path/pages and their commit markers, last, under path/markers; returns the markers.

    members (source, cover_idx, number, page_idx), payload (source, idx,
    content).  A page without payload stops the whole export before any marker
    is written, and readers trust marked sources alone.
    """
    spark = members.sparkSession
    pages = payload.select("source", F.col("idx").alias("page_idx"), "content", F.lit(True).alias("_there"))
    rows = members.join(pages, ["source", "page_idx"], "left")
    missing = F.raise_error(F.concat(F.lit("no payload of "), F.col("source"), F.lit(" page "), F.col("page_idx").cast("string")))
    rows = rows.withColumn("content", F.when(F.col("_there"), F.col("content")).otherwise(missing.cast(payload.schema["content"].dataType))).drop("_there")
    rows.sortWithinPartitions("source", "cover_idx", "page_idx").write.parquet(f"{path}/pages")
    written = spark.read.parquet(f"{path}/pages")
    files = written.groupBy("source", "cover_idx", "number").agg(F.sum(F.coalesce(F.length("content"), F.lit(0))).cast("long").alias("size"))
    name = F.concat("number", F.lit("_"), F.col("cover_idx").cast("string"))
    listed = F.sort_array(F.collect_list(F.struct(name.alias("name"), "size")))
    markers = files.groupBy(F.col("source").alias("job")).agg(F.lit("automatic").alias("mode"), F.to_json(listed).alias("files"))
    markers.write.parquet(f"{path}/markers")
    return spark.read.parquet(f"{path}/markers")
