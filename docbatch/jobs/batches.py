"""Queries of publication and of order over whole tables, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from docbatch.operators import archive, grouping, publish, review
from docbatch.sources import fixtures
from docbatch.sources.shared import fresh_folder, stored


def _conversations(spark, sf_dir):
    """Pages of conversations with number and state that hold, and their text."""
    return fixtures.conversation_pages(spark, sf_dir).withColumnsRenamed({"barcode": "number", "state": "effective_state"})


def published_documents(spark, sf_dir):
    """Every batch that nothing blocks, published to a fresh shared folder and read back as committed jobs: folders, file names, pages in order, sizes."""
    pages = _conversations(spark, sf_dir).withColumns({"source_signature": F.struct(F.lit(1).cast("long").alias("size"), F.lit(2).cast("long").alias("mtime_ns")), "stamp": F.lit("blue")})
    payload = pages.select("source", "idx", F.encode("text", "utf-8").alias("content"))
    pages = stored(pages.drop("text"), "pages")
    current = pages.select("source", F.col("source_signature").alias("signature")).distinct()
    ready = grouping.approval_problems(pages).where("problem = ''").select("source")
    ready = ready.join(publish.publication_problems(pages, payload, current), "source", "left_anti")
    number = F.substring("source", 6, 20).cast("long")
    created = F.timestamp_seconds(F.unix_timestamp(F.lit("2024-03-01 08:00:00").cast("timestamp")) + number % 7)
    jobs = ready.select(number.alias("id"), "source", created.alias("created"), F.concat(F.lit("Scan/"), (number % 3).cast("string")).alias("label"))
    root = fresh_folder(spark, "archive")
    publish.publish(pages, payload, jobs, root, current)
    listing = stored(publish.document_listing(spark, root), "listing")  # every folder is opened once
    done = publish.published_jobs(spark, root, listing).where("committed").select("job", "archive_date", "archive_dir", "mode", "committed")
    documents = listing.select("job", F.col("name").alias("file"), F.array_join(F.transform("source_pages", lambda p: p.cast("string")), ",").alias("pages"), "size")
    return documents.join(done, "job").select("job", "archive_date", "archive_dir", "file", "pages", "size", "mode", "committed")


def _workspaces(spark, sf_dir, stopped=True):
    """Pages of conversations in workspaces of 20 sources; stopped: the last pages of some sources aren't analysed."""
    order = F.substring("source", 6, 20).cast("long")
    pages = _conversations(spark, sf_dir).drop("text").withColumns({"workspace": F.floor(order / 20), "source_ord": order})
    if stopped:
        pages = pages.withColumn("effective_state", F.when((F.col("workspace") % 2 == 0) & (F.col("idx") >= 3 + order % 5), "pending").otherwise(F.col("effective_state")))
    return pages


def workspace_pages(spark, sf_dir):
    """Every page's ID in its workspace."""
    return grouping.page_ids(_workspaces(spark, sf_dir)).select("workspace", "source", "idx", "id")


def workspace_summaries(spark, sf_dir):
    return grouping.workspace_summary(_workspaces(spark, sf_dir))


def workspace_problems(spark, sf_dir):
    return grouping.workspace_problems(_workspaces(spark, sf_dir))


def workspace_saveable(spark, sf_dir):
    return archive.saveable_prefix(_workspaces(spark, sf_dir))


def workspace_pauses(spark, sf_dir):
    return grouping.pause_points(_workspaces(spark, sf_dir, stopped=False))


def skipped_batches(spark, sf_dir):
    """The first twelve batches that something blocks, and how many more there are."""
    found = grouping.approval_problems(_conversations(spark, sf_dir).drop("text")).withColumn("number", F.substring("source", 6, 20).cast("long"))
    return review.skipped_notes(found, "number")


QUERIES = {f.__name__: f for f in (published_documents, workspace_pages, workspace_summaries, workspace_problems, workspace_saveable, workspace_pauses, skipped_batches)}


def oracles(conv: str, shared: str, loose: str, problems: str) -> dict[str, str]:
    """conv, shared and loose: common parts of the catalog's SQL; problems: the SQL of batch_problems."""
    spaces = conv.replace("p AS", "pc AS", 1) + """,
    p AS (SELECT source, idx, barcode, substring(source, 6)::BIGINT AS o, substring(source, 6)::BIGINT // 20 AS workspace, CASE WHEN (substring(source, 6)::BIGINT // 20) % 2 = 0 AND idx >= 3 + substring(source, 6)::BIGINT % 5 THEN 'pending' ELSE state END AS state FROM pc)"""
    saveable = """q AS (SELECT source, idx, state, o, workspace, lag(state) OVER (PARTITION BY source ORDER BY idx) AS prior, min(CASE WHEN state = 'pending' THEN o * 10000 + idx END) OVER (PARTITION BY workspace) AS f, count(*) FILTER (WHERE state <> 'pending') OVER (PARTITION BY workspace) AS seen FROM p),
    c AS (SELECT *, max(CASE WHEN state = 'cover' AND prior IS DISTINCT FROM 'cover' AND o * 10000 + idx < f AND o = f // 10000 THEN idx END) OVER (PARTITION BY source) AS cut FROM q),
    sv AS (SELECT workspace, o AS source_ord, source, count(*) AS pages, count(*) FILTER (WHERE f IS NULL OR seen = 0 OR o < f // 10000 OR o = f // 10000 AND idx < cut) AS saveable FROM c GROUP BY 1, 2, 3)"""
    located = "l AS (SELECT r.*, p.o, p.workspace FROM r JOIN p USING (source, idx))"
    return {
        "skipped_batches": f"""WITH bp AS ({problems}) SELECT row_number() OVER (ORDER BY substring(source, 6)::BIGINT)::INT AS place, source, problem, greatest(count(*) OVER () - 12, 0) AS more FROM bp WHERE problem <> '' QUALIFY place <= 12""",
        "workspace_pages": f"WITH {spaces} SELECT workspace, source, idx, row_number() OVER (PARTITION BY workspace ORDER BY o, idx) AS id FROM p",
        "workspace_saveable": f"WITH {spaces}, {saveable} SELECT * FROM sv",
        "workspace_pauses": f"""WITH {conv}, w AS (SELECT source, idx, substring(source, 6)::BIGINT AS o, substring(source, 6)::BIGINT // 20 AS workspace, state = 'cover' AND lag(state) OVER (PARTITION BY source ORDER BY idx) = 'attachment' OR state = 'review' OR state = 'cover' AND barcode = '' AS stops FROM p),
    m AS (SELECT *, o * 10000 + idx AS nth, max(o * 10000 + idx) OVER (PARTITION BY workspace) AS last FROM w)
    SELECT workspace, arg_min(source, nth) FILTER (WHERE stops AND nth < last) AS pause_source, arg_min(idx, nth) FILTER (WHERE stops AND nth < last) AS pause_idx FROM m GROUP BY workspace""",
        "workspace_summaries": f"""WITH {spaces}, {saveable}, {shared}, {located},
    a AS (SELECT workspace, count(DISTINCT source) AS sources, count(*) AS pages, count(*) FILTER (WHERE state = 'cover') AS covers, count(*) FILTER (WHERE state = 'review' OR state = 'cover' AND number = '') AS needs_review, count(*) FILTER (WHERE kind = 'C') AS documents,
      count(*) FILTER (WHERE kind = 'A' AND anchor IS DISTINCT FROM 'C') AS loose, count(*) FILTER (WHERE state = 'pending') AS pending, count(*) FILTER (WHERE state <> 'pending') AS analysed FROM l GROUP BY workspace),
    y AS (SELECT workspace, sum(saveable)::BIGINT AS ready FROM sv GROUP BY workspace)
    SELECT * FROM a JOIN y USING (workspace)""",
        "workspace_problems": f"""WITH {spaces}, {shared}, {located},
    i AS (SELECT *, row_number() OVER (PARTITION BY workspace ORDER BY o, idx) AS id, CASE WHEN {loose} THEN CASE state WHEN 'pending' THEN 1 WHEN 'review' THEN 2 WHEN 'cover' THEN 3 ELSE 4 END END AS w FROM l),
    g AS (SELECT *, min(w) OVER (PARTITION BY workspace) AS f FROM i),
    h AS (SELECT workspace, min(f) AS f, count(*) FILTER (WHERE w = f) AS n_pages, count(*) FILTER (WHERE kind = 'C') AS docs, coalesce(list(id ORDER BY id) FILTER (WHERE w = f), []) AS ids FROM g GROUP BY workspace)
    SELECT workspace, CASE WHEN f IS NOT NULL THEN ['pending', 'review', 'cover_without_number', 'loose'][f] WHEN docs = 0 THEN 'no_documents' ELSE '' END AS problem, n_pages, array_to_string(ids[1:8], ',') AS page_ids, len(ids) > 8 AS truncated FROM h""",
        "published_documents": f"""WITH bp AS ({problems}), {conv}, {shared},
j AS (SELECT source, substring(source, 6)::BIGINT AS id FROM bp WHERE problem = '' AND source NOT IN (SELECT 'conv-' || conv_id FROM conversations GROUP BY conv_id, turn HAVING count(*) > 1)),
f AS (SELECT source, id::VARCHAR AS job, '08-00-0' || (id % 7) || '_Scan_' || (id % 3) || '_' || lpad(row_number() OVER (PARTITION BY id % 7, id % 3 ORDER BY id)::VARCHAR, 3, '0') AS archive_dir FROM j),
d AS (SELECT m.source, cover_idx, m.number, string_agg((page_idx + 1)::VARCHAR, ',' ORDER BY page_idx) AS pages, sum(strlen(coalesce(text, '')))::BIGINT AS size FROM m JOIN conversations ON m.source = 'conv-' || conv_id AND page_idx = turn GROUP BY 1, 2, 3),
n AS (SELECT *, row_number() OVER (PARTITION BY source, number ORDER BY cover_idx) AS k FROM d)
SELECT job, '2024-03-01' AS archive_date, archive_dir, CASE WHEN k = 1 THEN number ELSE number || '_' || lpad(k::VARCHAR, 2, '0') END AS file, pages, size, 'automatic' AS mode, true AS committed FROM n JOIN f USING (source)""",
    }
