"""Queries of the evidence, the review and the saving of documents, with SQL that gives the same rows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from docbatch.operators import evidence, grouping, review, saving, verdict
from docbatch.sources import fixtures
from docbatch.sources.shared import dealt



def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _line(spark, sf_dir):
    """lineitem with the name of a row: row."""
    line = _read(spark, sf_dir, "lineitem")
    return line.withColumns({"page": F.col("l_orderkey"), "row": F.concat_ws("-", *[F.col(c).cast("long").cast("string") for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]), "q": F.col("l_quantity").cast("long")})


def page_scales(spark, sf_dir):
    line = _line(spark, sf_dir)
    objects = line.select(
        "page", F.struct("l_linenumber", "l_partkey", "l_suppkey", "q").alias("ord"), F.lit(0.0).alias("left"), F.lit(0.0).alias("bottom"), (F.col("q") * 14).cast("double").alias("right"),
        (F.col("l_partkey") % 900 + 1).cast("double").alias("top"), (F.col("l_suppkey") * 10 + 500).alias("px_w"), (F.col("l_partkey") % 3000).alias("px_h"), F.lit(600.0).alias("page_w"), F.lit(800.0).alias("page_h"),
    )
    return evidence.page_scales(objects, 70, 80).withColumns({"dpi": F.round("dpi", 6), "sensitivity": F.round("sensitivity", 6)})


def _regions(spark, sf_dir):
    line = _line(spark, sf_dir)
    x0, y0 = F.col("l_partkey") % 500, F.col("l_suppkey") % 700
    return line.select("page", "row", x0.alias("x0"), y0.alias("y0"), (x0 + F.col("q") * 6).alias("x1"), (y0 + 20 + F.col("l_suppkey") % 60).alias("y1"), (F.col("l_linenumber") % 2 == 0).alias("read"), (F.col("l_returnflag") == "R").alias("reversed"), F.lit(700).cast("long").alias("width"), F.lit(750).cast("long").alias("height"), (F.col("l_linestatus") == "F").alias("rotated"), "l_partkey")


def heading_hits(spark, sf_dir):
    strips = evidence.heading_strips(_regions(spark, sf_dir)).distinct()
    seen = strips.withColumn("confidence", F.when((F.col("l_partkey") * 7 + F.col("ord") * 3) % 4 == 0, F.round(0.9 - F.col("ord") * 0.1, 6)).otherwise(0.0))
    hits = evidence.first_heading_hit(seen, ["row", "rotated", "height"])
    box = {c: F.col(n) for c, n in (("x0", "left"), ("y0", "top"), ("x1", "right"), ("y1", "bottom"))}
    return hits.select("row", "confidence", *evidence.page_box(box, F.col("rotated"), F.col("height")))


def kept_regions(spark, sf_dir):
    line = _line(spark, sf_dir)
    parts = line.select("row", (F.col("q") * 4).alias("w"), (F.col("l_suppkey") % 120 + 5).alias("h"), (100 + F.col("l_partkey") % 100).alias("dpi"), ((F.col("l_partkey") % 50 + 50) / 100).alias("regularity"), ((F.col("l_suppkey") % 100) / 100).alias("bar_share"), (F.col("l_linenumber") % 2 == 0).alias("read"))
    return evidence.region_filter(parts).select("row", "w", "h", "region")


def stamp_blobs(spark, sf_dir):
    blobs = _line(spark, sf_dir).select("row", (F.col("l_partkey") % 600).alias("x"), (F.col("l_suppkey") % 800).alias("y"), (F.col("q") * 3).alias("w"), (F.col("l_partkey") % 97 + 10).alias("h"), F.lit(4.0).alias("mm"))
    return evidence.blob_filter(blobs).select("row", "cx", "cy", "r")


def stamp_readings(spark, sf_dir):
    """Best ring of each candidate over three inks, its kind, and whether it is a stamp."""
    # dealt by row before there are three masks to each; repeated rows go there too
    line = dealt(_line(spark, sf_dir).select("row", "l_partkey", "l_suppkey", "q"), "row").distinct()
    line = line.withColumn("mask", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    n = F.col("l_partkey") + F.col("mask") * 37
    share = lambda c: (c % 101) / 100
    rings = line.select(
        "row", "mask", (n % 160).cast("double").alias("present"), F.lit(40.0).alias("r"), share(n * 3).alias("cover"), share(n * 7 + F.col("q")).alias("prominence"), share(n + 60).alias("arcs"), (n % 9 + 2).alias("sectors"), share(F.col("l_suppkey") + n).alias("interior"),
        (n % 40 + 10).cast("double").alias("radius"), (share(n) / 2).alias("thickness"), (F.col("q") % 2 == 0).alias("from_patch"), share(F.col("l_suppkey")).alias("blue_share"), (n % 60).alias("median_excess"), (n % 120).alias("dark"), (share(n) / 3).alias("stroke"), (n % 7).alias("parts"),
    )
    best = evidence.best_ring(rings, ["row"], F.lit(1.0), F.lit(4.0)).withColumn("kind", evidence.ink_class())
    return evidence.stamp_accept(best, F.lit(1.0)).select("row", "mask", "kind", "pale", F.round("confidence", 6).alias("confidence"), F.round("strength", 6).alias("strength"))


def classified_reads(spark, sf_dir):
    """Values of regions as reports and others, and the list of evidence of their pages, counted by kind."""
    regions = _read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("region"), ((F.col("o_custkey") % 4) / 4).alias("confidence"))
    found = evidence.classify_reads(regions, verdict.read_vote(fixtures.reads(spark, sf_dir)))
    stamps = fixtures.stamp_candidates(spark, sf_dir).select("page", F.lit("blue").alias("detail"), (F.col("r") / 20).alias("strength"), F.lit(0.85).alias("default"))
    headings = regions.where("confidence > 0").select(F.col("region").alias("page"), F.lit("").alias("detail"), "confidence")
    reports = found.where("kind <> 'other'").select(F.col("region").alias("page"), F.coalesce("value", F.lit("")).alias("detail"), F.coalesce("score", F.lit(0.0)).alias("confidence"))
    rows = evidence.build_evidence(stamps, headings, reports).groupBy("page").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("stamp", "heading", "barcode")], F.round(F.sum("confidence"), 6).alias("confidence"))
    values = found.groupBy(F.col("region").alias("page")).agg(F.count_if(F.col("kind") == "report").alias("reports"), F.count_if(F.col("kind") == "other").alias("others"), F.count_if(F.col("kind") == "unreadable").alias("unreadable"))
    return rows.join(values, "page", "left").select("page", "stamp", "heading", "barcode", "confidence", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("reports", "others", "unreadable")])


def stacked_headings(spark, sf_dir):
    """Codes that take over the heading of the one above, by page and rotation."""
    line = _line(spark, sf_dir)
    y0 = F.col("l_linenumber").cast("long") * 30 + F.col("l_suppkey") % 8
    regions = line.select("page", F.struct("l_linenumber", "l_partkey", "l_suppkey", "q").alias("ord"), (F.col("l_partkey") % 40).alias("x0"), y0.alias("y0"), (F.col("l_partkey") % 40 + 50).alias("x1"), (y0 + 25).alias("y1"), (F.col("l_suppkey") % 5 > 0).alias("read"), (F.col("page") % 2 == 0).alias("reversed"), (F.col("l_linestatus") == "F").alias("rotated"), F.when(F.col("l_partkey") % 3 == 0, 0.9).otherwise(0.0).alias("confidence"))
    return evidence.stacked_labels(regions).select("page", "rotated", F.concat_ws("-", *[F.col(f"ord.{c}").cast("string") for c in ("l_linenumber", "l_partkey", "l_suppkey", "q")]).alias("ord"), "read", "confidence")


def merged_symbols(spark, sf_dir):
    line = _line(spark, sf_dir)
    y = F.col("l_linenumber").cast("long") * 6 + F.col("l_partkey") % 3
    reads = line.select("page", F.concat(F.lit("V"), (F.col("l_suppkey") % 3).cast("string")).alias("value"), y.alias("y"), (F.col("l_suppkey") % 12).alias("x0"), (F.col("l_suppkey") % 12 + F.col("q") % 16).alias("x1"), (1 - (F.col("l_discount") + 0.0)).alias("score")).distinct()
    return evidence.merge_scanlines(reads).withColumn("score", F.round("score", 6))


def _decisions(spark, sf_dir):
    """Decisions on pages of conversations out of events."""
    action = F.create_map(*[F.lit(x) for x in ("click", "cover", "view", "attachment", "error", "reset")])[F.col("event_type")]
    rows = _read(spark, sf_dir, "events").withColumn("action", action).where("action is not null")
    return rows.select(F.concat(F.lit("conv-"), F.col("user_id").cast("string")).alias("source"), (F.col("event_id") % 4).cast("int").alias("idx"), "ts", "event_id", "action", F.when(F.col("event_id") % 5 == 0, " ").otherwise(F.concat(F.lit(" M"), (F.col("event_id") % 7).cast("string"))).alias("number"))


def _pages(spark, sf_dir):
    pages = fixtures.conversation_pages(spark, sf_dir)
    return pages.select("source", "idx", "barcode", F.when(F.col("idx") == 3, "pending").otherwise(F.col("state")).alias("state"), ((F.col("idx") == 0) & (F.length("text") % 2 == 0)).alias("first_page_error"), F.lit("").alias("decision"), F.lit("").alias("manual_barcode"))


def decided_pages(spark, sf_dir):
    """Pages after the decisions, with the number and state that hold."""
    rows = verdict.effective(review.apply_decisions(_pages(spark, sf_dir), _decisions(spark, sf_dir)))
    return rows.select("source", "idx", "decision", "manual_barcode", "first_page_error", "number", "effective_state")


def merged_results(spark, sf_dir):
    """Results that come late, over pages reset for a new analysis; decisions made before stay."""
    pages = review.apply_decisions(_pages(spark, sf_dir), _decisions(spark, sf_dir))
    new = _pages(spark, sf_dir).where("idx % 2 = 0").select("source", (F.col("idx") * 2).alias("idx"), F.lit("late").alias("barcode"), F.lit("cover").alias("state"), F.lit(False).alias("first_page_error"))
    merged, lost = review.merge_results(review.reset_analysis(pages), new)
    return merged.select("source", "idx", "barcode", "state", "decision").unionByName(lost.select("source", "idx", F.lit("no page").alias("barcode"), "state", F.lit("").alias("decision")))


def imported_pages(spark, sf_dir):
    """Pages of sources not saved yet, and those of new sources."""
    pages = _pages(spark, sf_dir).select("source", "idx")
    kept = review.remove_pages(pages, pages.where("idx >= 5").select("source"), ["source"])
    kept = review.remove_pages(kept, pages.where("idx = 1"), ["source", "idx"])
    more = pages.where("idx < 3").withColumn("source", F.when(F.col("idx") == 2, F.concat(F.lit("new-"), "source")).otherwise(F.col("source")))
    return review.import_new(kept, more)


def _analysed(spark, sf_dir):
    return verdict.stamp_rule(verdict.page_verdict(verdict.page_evidence(dealt(fixtures.detections(spark, sf_dir), "source"))))


def stopped_pages(spark, sf_dir):
    """Pages per workspace of 20 sources that its first bad page leaves pending."""
    order = F.substring("source", 6, 20).cast("long")
    pages = _analysed(spark, sf_dir).withColumns({"workspace": F.floor(order / 20), "source_ord": order})
    return review.stop_counts(pages)


def sorted_pages(spark, sf_dir):
    rows = fixtures.conversation_pages(spark, sf_dir).select(F.col("source").alias("workspace"), F.col("idx").alias("id"), "source", "idx", F.col("state").alias("effective_state"), F.col("barcode").alias("number"))
    return review.sort_pages(rows, "state", descending=True).select("source", "idx", "effective_state", "place")


def _jobs(spark, sf_dir):
    e = _read(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("f"), (F.col("user_id") % 50).cast("string")).alias("folder"), F.col("event_id").alias("id"), F.col("ts").alias("created"), F.when(F.col("event_type") == "view", "queued").when(F.col("event_type") == "click", "review").when(F.col("event_type") == "error", "error").otherwise("done").alias("status"))


def queued_jobs(spark, sf_dir):
    """Every job's place in the whole queue, and which is next."""
    return review.queue_order(_jobs(spark, sf_dir)).select("id", "place", "next")


def queue_counts(spark, sf_dir):
    return review.queue_counts(_jobs(spark, sf_dir))


def queue_lines(spark, sf_dir):
    rows = _jobs(spark, sf_dir).select("id", F.concat(F.lit("/in/"), "folder", F.lit("/scan"), F.col("id").cast("string"), F.lit(".pdf")).alias("path"), "status", (F.col("id") % 9).alias("done"), (F.col("id") % 9 + F.col("id") % 4).alias("total"), "created", F.lit("2024-01-05").cast("date").alias("today"), F.concat(F.lit("Tarama_"), (F.col("id") % 3 + 1).cast("string")).alias("label"), F.when((F.col("id") % 2 == 0) & (F.col("status") == "review"), "").otherwise(F.col("status")).alias("problem"))
    return review.queue_view(rows)


def approved_batches(spark, sf_dir):
    pages = fixtures.conversation_pages(spark, sf_dir).withColumnsRenamed({"barcode": "number", "state": "effective_state"})
    documents = grouping.membership(pages).groupBy("source").agg(F.count_distinct("cover_idx").alias("documents"))
    return review.approve_batch(grouping.approval_problems(pages), documents)


def complete_files(spark, sf_dir):
    text = F.when(F.col("doc_id") % 3 == 0, F.concat(F.coalesce("text", F.lit("")), F.lit("%%EOF"))).otherwise(F.coalesce("text", F.lit("")))
    rows = _read(spark, sf_dir, "documents").select("doc_id", F.concat(text, F.repeat(F.lit("x"), (F.col("doc_id") * 37 % 8000).cast("int"))).alias("text"))
    return rows.select("doc_id", saving.complete_pdf(F.encode("text", "utf-8")).alias("complete"))


def pages_json(spark, sf_dir):
    """Pages of a source as JSON, and how many are read back."""
    jobs = saving.encode_pages(fixtures.conversation_pages(spark, sf_dir).drop("text"))
    return jobs.join(saving.decode_pages(jobs)[0].groupBy("source").agg(F.count("*").alias("n_pages")), "source")


def whole_pages(spark, sf_dir):
    """Every field of pages, evidence and signature with it, after a way through JSON; of every seventh source the text is damaged."""
    pages = fixtures.conversation_pages(spark, sf_dir)
    n, x = F.length("text"), F.col("idx").cast("double")
    box = F.struct(x.alias("x0"), (x + 1).alias("y0"), (x + 2).alias("x1"), n.cast("double").alias("y1"))
    found = F.struct(F.when(n % 2 == 0, "stamp").otherwise("barcode").alias("kind"), box.alias("box"), F.lit(0.5).alias("confidence"), F.concat(F.lit('"\\é '), F.col("barcode")).alias("detail"))
    rows = pages.select(
        "source", "idx", "barcode", (n % 3 == 0).alias("target_found"), F.when(n % 3 == 0, "blue").otherwise("none").alias("stamp"), "state", F.concat(F.lit("r"), n.cast("string")).alias("reason"), F.when(n % 4 > 0, F.array(found, found)).otherwise(F.array().cast(f"array<{found_type(found, pages)}>")).alias("evidence"),
        F.when(n % 5 == 0, "cover").otherwise("").alias("decision"), F.when(n % 5 == 0, "M 1").otherwise("").alias("manual_barcode"), F.when(n % 2 == 0, F.array(F.lit("a"), F.col("barcode"))).otherwise(F.array().cast("array<string>")).alias("other_barcodes"),
        F.when(n % 6 > 0, F.struct(n.cast("long").alias("size"), F.col("idx").cast("long").alias("mtime_ns"))).alias("source_signature"), (F.col("idx") == 0).alias("first_page_error"),
    )
    jobs = saving.encode_pages(rows)
    damaged = F.substring("source", 6, 20).cast("long") % 7 == 0
    kept, broken = saving.decode_pages(jobs.withColumn("pages", F.when(damaged, F.expr("substring(pages, 1, length(pages) - 1)")).otherwise(F.col("pages"))))
    one = F.get("evidence", F.lit(1))
    seen = kept.select("source", "idx", "barcode", "target_found", "stamp", "state", "reason", F.size("evidence").alias("n_evidence"), one["kind"].alias("kind"), one["box"]["y0"].alias("y0"), one["box"]["y1"].alias("y1"), one["confidence"].alias("confidence"), one["detail"].alias("detail"), "decision", "manual_barcode", F.array_join("other_barcodes", ",").alias("others"), F.col("source_signature.size").alias("size"), F.col("source_signature.mtime_ns").alias("mtime_ns"), "first_page_error")
    return seen.unionByName(broken.select("source", F.lit(-1).alias("idx"), F.col("problem").alias("reason")), allowMissingColumns=True)


def found_type(found, pages):
    return pages.select(found.alias("f")).schema["f"].dataType.simpleString()


def _numbered(spark, sf_dir):
    return fixtures.conversation_pages(spark, sf_dir).withColumnsRenamed({"barcode": "number", "state": "effective_state"}).withColumns({"decision": F.when(F.col("idx") == 0, "cover").otherwise(""), "stamp": F.lit("blue")})


def document_manifests(spark, sf_dir):
    return saving.manifests(_numbered(spark, sf_dir))


def archive_folders(spark, sf_dir):
    jobs = _jobs(spark, sf_dir).select("id", F.date_trunc("hour", "created").alias("created"), F.concat(F.lit("Tarama_"), (F.col("id") % 3 + 1).cast("string")).alias("label"))
    return saving.archive_folders(jobs)


def exported_documents(spark, sf_dir):
    """The commit markers of an export to the shared folder (a fresh local one where the session names none, as in tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="docbatch-")
    pages = _numbered(spark, sf_dir)
    payload = pages.select("source", "idx", F.col("text").alias("content"))
    return saving.export_pages(grouping.membership(pages), payload, f"{root.rstrip('/')}/docbatch/{uuid.uuid4().hex}/export")


QUERIES = {
    f.__name__: f
    for f in (page_scales, heading_hits, kept_regions, stamp_blobs, stamp_readings, classified_reads, stacked_headings, merged_symbols, decided_pages, merged_results, imported_pages, stopped_pages, sorted_pages, queued_jobs, queue_counts, queue_lines, approved_batches, complete_files, pages_json, whole_pages, document_manifests, archive_folders, exported_documents)
}

#: Ordered folds; tests/test_review.py holds them against plain loops.
WITHOUT_SQL = {"stacked_headings", "merged_symbols"}

_ROW = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity::BIGINT)"
_JOBS = "j AS (SELECT 'f' || (user_id % 50) AS folder, event_id AS id, ts AS created, CASE event_type WHEN 'view' THEN 'queued' WHEN 'click' THEN 'review' WHEN 'error' THEN 'error' ELSE 'done' END AS status FROM events)"
_PAGES = "g AS (SELECT source, idx, barcode, CASE WHEN idx = 3 THEN 'pending' ELSE state END AS state, idx = 0 AND n % 2 = 0 AS first_page_error FROM p JOIN (SELECT conv_id, turn, length(text) AS n FROM conversations) t ON source = 'conv-' || conv_id AND idx = turn)"
_DECIDED = """e AS (SELECT 'conv-' || user_id AS source, (event_id % 4)::INT AS idx, (ts, event_id) AS due, CASE event_type WHEN 'click' THEN 'cover' WHEN 'view' THEN 'attachment' WHEN 'error' THEN 'reset' END AS action, CASE WHEN event_id % 5 = 0 THEN '' ELSE 'M' || (event_id % 7) END AS number FROM events),
v AS (SELECT * FROM e WHERE action IS NOT NULL AND (action <> 'cover' OR number <> '')),
l AS (SELECT source, idx, arg_max(action, due) AS action, arg_max(CASE WHEN action = 'cover' THEN number ELSE '' END, due) FILTER (WHERE action <> 'attachment') AS number, bool_or(action = 'cover') AS cover FROM v GROUP BY 1, 2),
x AS (SELECT g.*, CASE WHEN action IS NULL OR state = 'pending' OR action = 'reset' THEN '' ELSE action END AS decision, CASE WHEN state = 'pending' THEN '' ELSE coalesce(number, '') END AS manual_barcode, first_page_error AND NOT (state <> 'pending' AND coalesce(cover, false)) AS error FROM g LEFT JOIN l USING (source, idx))"""


def oracles(detections: str, conv: str, shared: str, problems: str, votes: str) -> dict[str, str]:
    """detections, conv and shared: common parts of the catalog's SQL; problems and votes: the SQL of those queries."""
    return {
        "page_scales": """WITH o AS (SELECT l_orderkey AS page, (l_linenumber, l_partkey, l_suppkey, l_quantity) AS ord, l_quantity * 14.0::DOUBLE AS w, (l_partkey % 900 + 1)::DOUBLE AS h, greatest(l_suppkey * 10 + 500, l_partkey % 3000) AS px FROM lineitem),
f AS (SELECT page, arg_min(px / greatest(w, h) * 72, ord) FILTER (WHERE w > 450 AND h > 520) AS dpi FROM o GROUP BY page)
SELECT page, round(CASE WHEN dpi IS NULL THEN 200 ELSE least(greatest(dpi, 100), 300) END, 6)::DOUBLE AS dpi, dpi IS NOT NULL AS scanned, round(CASE WHEN dpi IS NULL THEN 0.80::DOUBLE / 0.85 ELSE 0.70::DOUBLE / 0.74 END, 6) AS sensitivity FROM f""",
        "heading_hits": f"""WITH r AS (SELECT DISTINCT {_ROW} AS row, l_partkey AS k, l_partkey % 500 AS x0, l_suppkey % 700 AS y0, l_partkey % 500 + l_quantity::BIGINT * 6 AS x1, l_suppkey % 700 + 20 + l_suppkey % 60 AS y1, l_linenumber % 2 = 0 AS read, l_returnflag = 'R' AS reversed, l_linestatus = 'F' AS rotated FROM lineitem),
s AS (SELECT r.*, ord, below, depth FROM r JOIN (VALUES (0, false, 0.65::DOUBLE), (1, false, 1.1), (2, true, 0.65), (3, true, 1.1)) d(k0, below, depth) ON NOT read OR reversed = below, LATERAL (SELECT CASE WHEN read AND below THEN k0 - 2 ELSE k0 END AS ord)),
b AS (SELECT *, greatest(y1 - y0, 30) AS t, CASE WHEN (k * 7 + ord * 3) % 4 = 0 THEN round(0.9 - ord * 0.1, 6)::DOUBLE ELSE 0.0::DOUBLE END AS c FROM s),
h AS (SELECT row, rotated, arg_min({{'c': c, 'l': greatest(0, trunc(x0 - (x1 - x0) * 0.05::DOUBLE)::BIGINT), 't': CASE WHEN below THEN y1 - 2 ELSE greatest(0, trunc(y0 - t * depth)::BIGINT) END, 'r': least(700, trunc(x1 + (x1 - x0) * 0.05::DOUBLE)::BIGINT), 'b': CASE WHEN below THEN least(750, trunc(y1 + t * depth)::BIGINT) ELSE y0 + 2 END}}, ord) FILTER (WHERE c > 0) AS x FROM b GROUP BY row, rotated)
SELECT row, coalesce(x.c, 0) AS confidence, CASE WHEN rotated THEN x.t ELSE x.l END AS x0, CASE WHEN rotated THEN 749 - x.r ELSE x.t END AS y0, CASE WHEN rotated THEN x.b ELSE x.r END AS x1, CASE WHEN rotated THEN 749 - x.l ELSE x.b END AS y1 FROM h""",
        "kept_regions": f"""WITH c AS (SELECT {_ROW} AS row, l_quantity::BIGINT * 4 AS w, l_suppkey % 120 + 5 AS h, 100 + l_partkey % 100 AS dpi, (l_partkey % 50 + 50) / 100::DOUBLE AS g, (l_suppkey % 100) / 100::DOUBLE AS s, l_linenumber % 2 = 0 AS read FROM lineitem),
r AS (SELECT *, CASE WHEN w < dpi * 0.5::DOUBLE OR h < greatest(8, trunc(dpi * 0.12::DOUBLE)) THEN 'drop' WHEN w / h::DOUBLE < 1.5 OR h > dpi * 1.5 THEN 'split' WHEN g >= 0.62::DOUBLE AND s > 0.2::DOUBLE AND s < 0.8::DOUBLE AND (read OR g >= 0.75) THEN 'keep' ELSE 'drop' END AS region FROM c)
SELECT row, w, h, region FROM r""",
        "stamp_blobs": f"""WITH b AS (SELECT {_ROW} AS row, l_partkey % 600 AS x, l_suppkey % 800 AS y, l_quantity::BIGINT * 3 AS w, l_partkey % 97 + 10 AS h FROM lineitem)
SELECT row, x + w / 2.0::DOUBLE AS cx, y + h / 2.0::DOUBLE AS cy, greatest(w, h) / 2.0::DOUBLE AS r FROM b WHERE greatest(w, h) / 2.0 BETWEEN 14 AND 60 AND w / h::DOUBLE BETWEEN 0.6::DOUBLE AND 1.6::DOUBLE""",
        "stamp_readings": f"""WITH b AS (SELECT DISTINCT {_ROW} AS row, l_partkey, l_suppkey, l_quantity::BIGINT AS q, mask, l_partkey + mask * 37 AS n FROM lineitem, (VALUES (0), (1), (2)) m(mask)),
f AS (SELECT *, n % 160 AS present, (n * 3 % 101) / 100::DOUBLE AS cover, ((n * 7 + q) % 101) / 100::DOUBLE AS prominence, ((n + 60) % 101) / 100::DOUBLE AS arcs, n % 9 + 2 AS sectors, ((l_suppkey + n) % 101) / 100::DOUBLE AS interior, n % 40 + 10 AS radius, (n % 101) / 100::DOUBLE / 2 AS thickness, (l_suppkey % 101) / 100::DOUBLE AS blue_share FROM b),
g AS (SELECT *, cover >= 0.45::DOUBLE AND prominence >= 0.42::DOUBLE AND arcs >= 0.55::DOUBLE AND sectors >= 5 AND interior BETWEEN 0.15::DOUBLE AND 0.9::DOUBLE AND radius >= 16 AND (thickness <= 0.35::DOUBLE OR q % 2 = 0 AND mask < 2 AND cover >= 0.6::DOUBLE AND sectors >= 7) AS plausible FROM f),
h AS (SELECT *, max(CASE WHEN mask = 0 THEN (cover < 0.3::DOUBLE OR plausible)::INT END) OVER (PARTITION BY row) AS ends FROM g),
k AS (SELECT *, row_number() OVER (PARTITION BY row ORDER BY plausible DESC, prominence + cover * 0.5::DOUBLE DESC, mask) AS nth FROM h WHERE mask = 0 OR ends = 0 AND present >= 2 * pi() * 0.4 * 40),
c AS (SELECT *, CASE WHEN blue_share >= 0.5 AND n % 60 >= 27 THEN 'blue' WHEN blue_share >= 0.5 AND n % 120 < 60 THEN 'pale_blue' WHEN n % 120 >= 70 THEN 'black' ELSE 'faint' END AS ink FROM k WHERE nth = 1 AND plausible)
SELECT row, mask, CASE ink WHEN 'pale_blue' THEN 'faint' ELSE ink END AS kind, ink = 'pale_blue' AS pale, round(least(1, least(1, prominence / 0.6::DOUBLE) * 0.5::DOUBLE + cover * 0.3::DOUBLE + arcs * 0.2::DOUBLE), 6) AS confidence,
  round(CASE WHEN ink IN ('blue', 'pale_blue') THEN least(cover / 0.45::DOUBLE, prominence / 0.42::DOUBLE) ELSE least(cover / 0.8::DOUBLE, prominence / 0.45::DOUBLE) END, 6) AS strength FROM c
WHERE ink IN ('blue', 'pale_blue') OR cover >= 0.8::DOUBLE AND prominence >= 0.45::DOUBLE AND arcs >= 0.8::DOUBLE AND sectors >= 7 AND (n % 101) / 100::DOUBLE / 3 <= 0.2::DOUBLE AND n % 7 >= 3""",
        "classified_reads": f"""WITH r AS (SELECT o_orderkey AS region, (o_custkey % 4) / 4::DOUBLE AS c FROM orders), v AS ({votes}),
f AS (SELECT r.region AS page, value, c, CASE WHEN c = 0 THEN 'other' WHEN value IS NULL THEN 'unreadable' ELSE 'report' END AS kind, least(c, score) AS score FROM r LEFT JOIN v ON r.region = v.region WHERE c > 0 OR value IS NOT NULL),
e AS (SELECT l_orderkey AS page, 'stamp' AS kind, least(0.99::DOUBLE, (20 + l_suppkey % 10) / 20::DOUBLE * 0.85::DOUBLE) AS x FROM lineitem UNION ALL SELECT region, 'heading', c FROM r WHERE c > 0 UNION ALL SELECT page, 'barcode', CASE WHEN value IS NULL THEN c ELSE score END FROM f WHERE kind <> 'other'),
a AS (SELECT page, count(*) FILTER (WHERE kind = 'stamp') AS stamp, count(*) FILTER (WHERE kind = 'heading') AS heading, count(*) FILTER (WHERE kind = 'barcode') AS barcode, round(sum(x), 6) AS confidence FROM e GROUP BY page),
b AS (SELECT page, count(*) FILTER (WHERE kind = 'report') AS reports, count(*) FILTER (WHERE kind = 'other') AS others, count(*) FILTER (WHERE kind = 'unreadable') AS unreadable FROM f GROUP BY page)
SELECT a.*, coalesce(reports, 0) AS reports, coalesce(others, 0) AS others, coalesce(unreadable, 0) AS unreadable FROM a LEFT JOIN b USING (page)""",
        "decided_pages": f"WITH {conv}, {_PAGES}, {_DECIDED} SELECT source, idx, decision, manual_barcode, error AS first_page_error, CASE WHEN manual_barcode <> '' THEN manual_barcode ELSE barcode END AS number, CASE WHEN decision <> '' THEN decision ELSE state END AS effective_state FROM x",
        "merged_results": f"""WITH {conv}, {_PAGES}, {_DECIDED}, n AS (SELECT source, idx * 2 AS idx FROM g WHERE idx % 2 = 0)
SELECT x.source, x.idx, CASE WHEN n.idx IS NULL THEN '' ELSE 'late' END AS barcode, CASE WHEN n.idx IS NULL THEN 'pending' ELSE 'cover' END AS state, decision FROM x LEFT JOIN n USING (source, idx)
UNION ALL SELECT n.source, n.idx, 'no page', 'cover', '' FROM n LEFT JOIN x USING (source, idx) WHERE x.decision IS NULL""",
        "imported_pages": f"""WITH {conv}, k AS (SELECT source, idx FROM p WHERE source NOT IN (SELECT source FROM p WHERE idx >= 5) AND idx <> 1), m AS (SELECT CASE WHEN idx = 2 THEN 'new-' || source ELSE source END AS source, idx FROM p WHERE idx < 3)
SELECT * FROM k UNION ALL SELECT * FROM m WHERE source NOT IN (SELECT source FROM k)""",
        "stopped_pages": f"""WITH {detections}, pw AS (SELECT (substring(source, 6)::BIGINT // 20) AS workspace, substring(source, 6)::BIGINT AS o, idx, first_page_error FROM p),
ps AS (SELECT workspace, min(o * 10000 + idx) AS stop FROM pw WHERE first_page_error GROUP BY workspace)
SELECT workspace, count(*) AS pages, count(*) FILTER (WHERE o * 10000 + idx > stop) AS pending FROM pw LEFT JOIN ps USING (workspace) GROUP BY workspace""",
        "sorted_pages": f"WITH {conv} SELECT source, idx, state AS effective_state, row_number() OVER (PARTITION BY source ORDER BY CASE state WHEN 'attachment' THEN 1 WHEN 'review' THEN 2 ELSE 3 END DESC, idx) AS place FROM p",
        "queued_jobs": f"WITH {_JOBS} SELECT id, row_number() OVER (ORDER BY created, id) AS place, coalesce((created, id) = (SELECT min((created, id)) FROM j WHERE status = 'queued'), false) AS next FROM j",
        "queue_counts": f"WITH {_JOBS} SELECT status, count(*) AS jobs FROM j WHERE status <> 'done' GROUP BY ROLLUP (status)",
        "queue_lines": f"""WITH {_JOBS}, s AS (SELECT *, id % 9 AS done, id % 9 + id % 4 AS total FROM j), h AS (SELECT *, CASE WHEN total = 0 THEN 0 ELSE done / total::DOUBLE END AS share FROM s), r AS (SELECT *, round_even(share * 10, 0)::INT AS n FROM h)
SELECT id, 'Tarama_' || (id % 3 + 1) AS label, 'scan' || id || '.pdf' AS name, status, CASE status WHEN 'queued' THEN 'in line' WHEN 'review' THEN 'waits for approval' WHEN 'error' THEN 'needs a look' END AS status_text,
  CASE WHEN status = 'review' AND id % 2 = 0 THEN 'can be saved' WHEN status IN ('review', 'error') THEN 'review first' ELSE 'after analysis' END AS saveable, repeat('#', n) || repeat('.', 10 - n) AS bar, round_even(share * 100, 0)::INT AS percent, CASE WHEN created::DATE = DATE '2024-01-05' THEN strftime(created, '%H:%M') ELSE strftime(created, '%d.%m %H:%M') END AS added FROM r""",
        "approved_batches": f"""WITH bp AS ({problems}), {conv}, {shared}, dn AS (SELECT source, count(DISTINCT cover_idx) AS n FROM m GROUP BY source)
SELECT CASE WHEN problem = '' THEN 'ready' ELSE 'skipped' END AS outcome, problem AS reason, count(*) AS jobs, sum(CASE WHEN problem = '' THEN coalesce(n, 0) ELSE 0 END)::BIGINT AS documents FROM bp LEFT JOIN dn USING (source) GROUP BY 1, 2""",
        "complete_files": "SELECT doc_id, contains(right(coalesce(text, '') || CASE WHEN doc_id % 3 = 0 THEN '%%EOF' ELSE '' END || repeat('x', (doc_id * 37 % 8000)::BIGINT), 4096), '%%EOF') AS complete FROM documents",
        "pages_json": f"WITH {conv} SELECT source, to_json(list({{'idx': idx, 'barcode': barcode, 'state': state}} ORDER BY idx))::VARCHAR AS pages, count(*) AS n_pages FROM p GROUP BY source",
        "whole_pages": f"""WITH {conv}, t AS (SELECT p.*, length(text) AS n, substring(p.source, 6)::BIGINT % 7 = 0 AS bad FROM p JOIN conversations ON p.source = 'conv-' || conv_id AND idx = turn)
SELECT source, idx, barcode, n % 3 = 0 AS target_found, CASE WHEN n % 3 = 0 THEN 'blue' ELSE 'none' END AS stamp, state, 'r' || n AS reason, CASE WHEN n % 4 > 0 THEN 2 ELSE 0 END::INT AS n_evidence, CASE WHEN n % 4 > 0 THEN CASE WHEN n % 2 = 0 THEN 'stamp' ELSE 'barcode' END END AS kind,
  CASE WHEN n % 4 > 0 THEN idx + 1 END::DOUBLE AS y0, CASE WHEN n % 4 > 0 THEN n END::DOUBLE AS y1, CASE WHEN n % 4 > 0 THEN 0.5 END::DOUBLE AS confidence, CASE WHEN n % 4 > 0 THEN '"\\é ' || barcode END AS detail, CASE WHEN n % 5 = 0 THEN 'cover' ELSE '' END AS decision, CASE WHEN n % 5 = 0 THEN 'M 1' ELSE '' END AS manual_barcode,
  CASE WHEN n % 2 = 0 THEN 'a,' || barcode ELSE '' END AS others, CASE WHEN n % 6 > 0 THEN n END AS size, CASE WHEN n % 6 > 0 THEN idx END::BIGINT AS mtime_ns, idx = 0 AS first_page_error FROM t WHERE NOT bad
UNION ALL SELECT DISTINCT source, -1, NULL, NULL, NULL, NULL, 'not_an_array', NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM t WHERE bad""",
        "document_manifests": f"""WITH {conv}, {shared} SELECT m.source, cover_idx, m.number, to_json(list({{'source': m.source, 'page': page_idx + 1, 'state': CASE WHEN page_idx = 0 THEN 'cover' ELSE state END, 'manual': page_idx = 0, 'stamp': 'blue'}} ORDER BY page_idx))::VARCHAR AS pages
FROM m JOIN p ON p.source = m.source AND p.idx = page_idx GROUP BY m.source, cover_idx, m.number""",
        "archive_folders": f"""WITH {_JOBS}, h AS (SELECT id, date_trunc('hour', created) AS created, 'Tarama_' || (id % 3 + 1) AS label FROM j), s AS (SELECT *, strftime(created, '%Y-%m-%d') AS archive_date, strftime(created, '%H-%M-%S') || '_' || label AS stem FROM h)
SELECT id, created, label, archive_date, stem || '_' || lpad(row_number() OVER (PARTITION BY archive_date, stem ORDER BY id)::VARCHAR, 3, '0') AS archive_dir FROM s""",
        "exported_documents": f"""WITH {conv}, {shared}, f AS (SELECT m.source, m.number || '_' || cover_idx AS name, sum(coalesce(length(text), 0))::BIGINT AS size FROM m JOIN conversations c ON m.source = 'conv-' || conv_id AND page_idx = turn GROUP BY 1, 2)
SELECT source AS job, 'automatic' AS mode, to_json(list({{'name': name, 'size': size}} ORDER BY name, size))::VARCHAR AS files FROM f GROUP BY source""",
    }
