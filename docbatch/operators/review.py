"""Reviewing batches: decisions of users, late results, page lists and the queue."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docbatch.operators.order import places

#: What analysis sets, with the value of a page that isn't analysed; the signature stays when a page is reset.
AUTOMATIC = {"barcode": "", "target_found": False, "stamp": "none", "state": "pending", "reason": "", "evidence": None, "other_barcodes": None, "source_signature": None, "first_page_error": False}
PENDING_JOBS = ["queued", "analyzing", "review", "error", "exporting"]


def apply_decisions(pages: DataFrame, decisions: DataFrame) -> DataFrame:
    """pages (source, idx, state, first_page_error, decision, manual_barcode) after decisions (source, idx, ts, event_id, action, number), in order.

    A cover needs a number, which it sets, and clears first_page_error; an
    attachment sets the decision alone; a reset clears both.  Pending pages take
    none.  The last decision of each kind tells the outcome, so one aggregate is
    enough.
    """
    number = F.regexp_replace(F.coalesce("number", F.lit("")), r"(?U)^\s+|\s+$", "")
    valid = decisions.withColumn("number", number).where((F.col("action") != "cover") | (F.col("number") != ""))
    order = F.struct("ts", "event_id")
    numbered = F.when(F.col("action") != "attachment", order)
    last = valid.groupBy("source", "idx").agg(
        F.max_by("action", order).alias("_action"), F.max_by(F.when(F.col("action") == "cover", F.col("number")).otherwise(""), numbered).alias("_number"), F.bool_or(F.col("action") == "cover").alias("_cover"),
    )
    takes = F.col("_action").isNotNull() & (F.col("state") != "pending")
    return pages.join(last, ["source", "idx"], "left").withColumns({
        "decision": F.when(takes, F.when(F.col("_action") == "reset", "").otherwise(F.col("_action"))).otherwise(F.col("decision")),
        "manual_barcode": F.when(takes & F.col("_number").isNotNull(), F.col("_number")).otherwise(F.col("manual_barcode")),
        "first_page_error": F.when(takes & F.col("_cover"), False).otherwise(F.col("first_page_error")),
    }).drop("_action", "_number", "_cover")


def automatic(pages: DataFrame) -> list[str]:
    """The automatic fields that pages have."""
    return [c for c in AUTOMATIC if c in pages.columns]


def reset_analysis(pages: DataFrame) -> DataFrame:
    """Pages to be analysed again: automatic fields at their defaults, lists empty; decisions and numbers of users and the signature kept."""
    fields = [c for c in automatic(pages) if c != "source_signature"]
    return pages.withColumns({c: (F.array() if AUTOMATIC[c] is None else F.lit(AUTOMATIC[c])).cast(pages.schema[c].dataType) for c in fields})


def merge_results(pages: DataFrame, results: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages with all automatic fields they have from results (source, idx, ...; one a page), and results of no page.

    Decisions of users stay, however late a result is.  Results must have every
    automatic field that pages have, null ones are taken as null.
    """
    fields = automatic(pages)
    if missing := [c for c in fields if c not in results.columns]:
        raise ValueError(f"results lack {', '.join(missing)}")
    new = results.select("source", "idx", *[F.col(c).alias(f"_{c}") for c in fields], F.lit(True).alias("_there"))
    merged = pages.join(new, ["source", "idx"], "left").withColumns({c: F.when(F.col("_there"), F.col(f"_{c}")).otherwise(F.col(c)) for c in fields})
    return merged.select(*pages.columns), results.join(pages.select("source", "idx"), ["source", "idx"], "left_anti")


def remove_pages(pages: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Pages that aren't in gone, by source or by (source, idx); a source without pages is no more."""
    return pages.join(gone.select(*keys).distinct(), keys, "left_anti")


def import_new(pages: DataFrame, more: DataFrame) -> DataFrame:
    """pages and those of more whose source isn't there yet."""
    return pages.unionByName(more.join(pages.select("source").distinct(), "source", "left_anti"))


def first_page_stop(pages: DataFrame) -> DataFrame:
    """pages (workspace, source_ord, idx, state, first_page_error): after a workspace's first error all pages are pending."""
    at = F.struct("source_ord", "idx")
    stop = pages.groupBy("workspace").agg(F.min(F.when(F.col("first_page_error"), at)).alias("_stop"))
    return pages.join(stop, "workspace").withColumn("state", F.when(at > F.col("_stop"), "pending").otherwise(F.col("state"))).drop("_stop")


def stop_counts(pages: DataFrame) -> DataFrame:
    """Per workspace its pages and how many of them are pending after first_page_stop: workspace, pages, pending.

    Each place in the order of sources gives its counts and its own first error,
    so that pages meet no other ones of the workspace; what moves on is a row per
    place.
    """
    page = F.struct("idx", (F.col("state") == "pending").alias("pending"))
    each = pages.where("workspace IS NOT NULL").groupBy("workspace", "source_ord").agg(F.count("*").alias("_n"), F.count_if(F.col("state") == "pending").alias("_pending"), F.min(F.when(F.col("first_page_error"), F.struct("idx"))).alias("_error"), F.collect_list(page).alias("_pages"))
    after = F.when(F.col("_error").isNotNull(), F.size(F.filter("_pages", lambda p: p["pending"] | (F.struct(p["idx"].alias("idx")) > F.col("_error"))))).cast("long")
    each = each.select("workspace", "source_ord", "_n", "_pending", F.col("_error").isNotNull().alias("_stops"), after.alias("_after"))
    whole = Window.partitionBy("workspace").orderBy("source_ord").rowsBetween(Window.unboundedPreceding, -1)
    each = each.withColumn("_over", F.coalesce(F.bool_or("_stops").over(whole), F.lit(False)))
    pending = F.when(F.col("_over"), F.col("_n")).otherwise(F.coalesce("_after", "_pending"))
    return each.groupBy("workspace").agg(F.sum("_n").alias("pages"), F.sum(pending).alias("pending"))


def sort_pages(pages: DataFrame, by: str = "state", descending: bool = False) -> DataFrame:
    """pages (workspace, id, source, idx, effective_state, number) with place: their order in the list; ties stay by id, whichever way."""
    from docbatch.functions.text import natural_key

    rank = F.when(F.col("effective_state") == "pending", 0).when(F.col("effective_state") == "attachment", 1).when(F.col("effective_state") == "review", 2).otherwise(3)
    key = {"id": F.col("id"), "page": F.struct("source", "idx"), "state": rank, "number": natural_key(F.col("number"))}[by]
    return places(pages, key.desc() if descending else key.asc(), F.col("id").asc(), within=("workspace",))


def queue_order(jobs: DataFrame) -> DataFrame:
    """jobs (id, created, status) with place in the whole queue, by created and id, and next: the first queued job of all, if any."""
    placed = places(jobs, F.col("created").asc(), F.col("id").asc())
    first = placed.where("status = 'queued'").agg(F.min("place")).first()[0]
    return placed.withColumn("next", F.coalesce(F.col("place") == F.lit(first).cast("long"), F.lit(False)))


def queue_counts(jobs: DataFrame) -> DataFrame:
    """Pending jobs by status, and their total under status null."""
    return jobs.where(F.col("status").isin(*PENDING_JOBS)).rollup("status").agg(F.count("*").alias("jobs"))


#: What a line says of a job's status, and of jobs that can't be saved yet.
STATUS_TEXT = {"queued": "in line", "analyzing": "being analysed", "review": "waits for approval", "error": "needs a look", "exporting": "being saved"}
SAVE_TEXT = {"": "can be saved", "review": "review first", "error": "review first", "exporting": "being saved", "other": "after analysis"}


def queue_view(jobs: DataFrame, status_text: dict[str, str] = STATUS_TEXT, save_text: dict[str, str] = SAVE_TEXT) -> DataFrame:
    """jobs (id, path, label, status, problem, done, total, created, today): the line of a job in the list.

    name of the file, status_text, bar of ten places (halves to even), percent,
    saveable (by problem, '' for none, else by status), and added: the time for
    jobs of today, otherwise with the day.
    """
    said = F.create_map(*[F.lit(x) for pair in status_text.items() for x in pair])[F.col("status")]
    blocked = F.create_map(*[F.lit(x) for pair in save_text.items() for x in pair])
    saveable = F.when(F.col("problem") == "", save_text[""]).otherwise(F.coalesce(blocked[F.nullif("status", F.lit(""))], F.lit(save_text["other"])))
    share = F.coalesce(F.col("done") / F.nullif(F.col("total"), F.lit(0)), F.lit(0.0))
    filled = F.bround(share * 10).cast("int")
    added = F.when(F.to_date("created") == F.col("today"), F.date_format("created", "HH:mm")).otherwise(F.date_format("created", "dd.MM HH:mm"))
    return jobs.select("id", "label", F.regexp_extract("path", r"([^/\\]*)$", 1).alias("name"), "status", said.alias("status_text"), saveable.alias("saveable"), F.concat(F.repeat(F.lit("#"), filled), F.repeat(F.lit("."), 10 - filled)).alias("bar"), F.bround(share * 100).cast("int").alias("percent"), added.alias("added"))


def skipped_notes(problems: DataFrame, order: str, most: int = 12) -> DataFrame:
    """problems (source, problem and the order's column) to the first `most` that something blocks: place, source, problem, and more, how many others there are.

    A top-k report: each task keeps `most` rows, and nothing else is sorted.
    """
    blocked = problems.where("problem <> ''")
    more = max(blocked.count() - most, 0)
    first = blocked.orderBy(order, "source").limit(most)
    place = F.row_number().over(Window.orderBy(order, "source"))  # over `most` rows
    return first.select(place.alias("place"), "source", "problem", F.lit(more).cast("long").alias("more"))


def approve_batch(problems: DataFrame, documents: DataFrame) -> DataFrame:
    """problems (source, problem), documents (source, documents): ready and skipped sources, with their documents and reasons."""
    rows = problems.select("source", "problem").join(documents, "source", "left")
    outcome = F.when(F.col("problem") == "", "ready").otherwise("skipped")
    return rows.groupBy(outcome.alias("outcome"), F.col("problem").alias("reason")).agg(F.count("*").alias("jobs"), F.sum(F.when(F.col("problem") == "", F.coalesce("documents", F.lit(0))).otherwise(0)).cast("long").alias("documents"))
