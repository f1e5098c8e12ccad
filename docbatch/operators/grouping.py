"""Ordered pages to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_runs(pages: DataFrame, grouping: str = "shared") -> DataFrame:
    """pages (source, idx, number, effective_state) with kind, run and anchor.

    Each source has a bounded number of pages, so its window is bounded too.
    """
    w = Window.partitionBy("source").orderBy("idx")
    kind = F.when((F.col("effective_state") == "cover") & (F.col("number") != ""), "C").when(F.col("effective_state") == "attachment", "A").otherwise("B")
    rows = pages.withColumn("kind", kind)
    before = F.coalesce(F.lag("kind").over(w), F.lit("B"))
    start = (F.col("kind") == "C") if grouping == "sequential" else (F.col("kind") == "C") & (before != "C")
    rows = rows.withColumn("_start", start.cast("int"))
    return rows.withColumns({"run": F.sum("_start").over(w), "anchor": F.last(F.when(F.col("kind") != "A", F.col("kind")), ignorenulls=True).over(w)}).drop("_start")


def _documents(pages: DataFrame, grouping: str, *following: Column) -> DataFrame:
    """Rows (source, cover_idx, number) with aggregates over the following pages of the cover's run.

    A run's covers are gathered and dealt out again, which needs no join: with
    the pages already dealt by source there is no further shuffle.  A run lies
    within one source, so both are bounded.
    """
    cover = F.when(F.col("kind") == "C", F.struct(F.col("idx").alias("cover_idx"), "number"))
    runs = page_runs(pages, grouping).where("kind = 'C' or (kind = 'A' and anchor = 'C')")
    gathered = runs.groupBy("source", "run").agg(F.collect_list(cover).alias("_covers"), *following)
    names = [c for c in gathered.columns if c not in ("source", "run", "_covers")]
    return gathered.select("source", F.explode("_covers").alias("_c"), *names).select("source", "_c.cover_idx", "_c.number", *names)


def membership(pages: DataFrame, grouping: str = "shared") -> DataFrame:
    """Rows (source, cover_idx, number, page_idx): a cover is in its own document, a following page in all of its run."""
    found = _documents(pages, grouping, F.collect_list(F.when(F.col("kind") == "A", F.col("idx"))).alias("_following"))
    return found.select("source", "cover_idx", "number", F.explode(F.concat(F.array("cover_idx"), "_following")).alias("page_idx"))


def document_sizes(pages: DataFrame, grouping: str = "shared") -> DataFrame:
    """Rows (source, cover_idx, number, n_pages, first_page, last_page)."""
    page = F.when(F.col("kind") == "A", F.col("idx"))
    found = _documents(pages, grouping, F.count(page).alias("_n"), F.min(page).alias("_from"), F.max(page).alias("_to"))
    return found.select("source", "cover_idx", "number", (F.col("_n") + 1).alias("n_pages"), F.least("cover_idx", "_from").alias("first_page"), F.greatest("cover_idx", "_to").alias("last_page"))


def unassigned(pages: DataFrame, grouping: str = "shared") -> DataFrame:
    """Pages in no document, with their state."""
    return page_runs(pages, grouping).where("kind = 'B' or (kind = 'A' and not (anchor <=> 'C'))").select("source", "idx", "effective_state", "number")


def summary(pages: DataFrame, grouping: str = "shared") -> DataFrame:
    """Per source: pages, covers, pages that need review, documents, unassigned following pages; pages not analysed, analysed and ready.

    ready: pages that saving would take, as saveable_prefix counts them.
    """
    runs = page_runs(pages, grouping)
    loose = (F.col("kind") == "A") & ~F.col("anchor").eqNullSafe(F.lit("C"))
    review = (F.col("effective_state") == "review") | ((F.col("effective_state") == "cover") & (F.col("number") == ""))
    raw = F.col("state") if "state" in pages.columns else F.col("effective_state")
    w, whole = Window.partitionBy("source").orderBy("idx"), Window.partitionBy("source")
    starts = (F.col("effective_state") == "cover") & ~F.lag("effective_state").over(w).eqNullSafe(F.lit("cover"))
    runs = runs.withColumns({"_starts": starts, "_first": F.min(F.when(raw == "pending", F.col("idx"))).over(whole)})
    runs = runs.withColumn("_cut", F.max(F.when(F.col("_starts") & (F.col("idx") < F.col("_first")), F.col("idx"))).over(whole))
    out = runs.groupBy("source").agg(
        F.count("*").alias("pages"), F.count_if(F.col("effective_state") == "cover").alias("covers"), F.count_if(review).alias("needs_review"), F.count_if(F.col("kind") == "C").alias("documents"), F.count_if(loose).alias("loose"),
        F.count_if(F.col("effective_state") == "pending").alias("pending"), F.count_if(raw != "pending").alias("analysed"), F.count_if(F.col("idx") < F.col("_cut")).alias("_before"),
    )
    some = (F.col("analysed") > 0) & (F.col("analysed") < F.col("pages"))
    return out.withColumn("ready", F.when(some, F.col("_before")).otherwise(F.col("pages"))).drop("_before")


def manifest(pages: DataFrame, grouping: str = "shared") -> DataFrame:
    """One row per document with its pages as JSON, in order."""
    info = pages.select("source", F.col("idx").alias("page_idx"), "effective_state")
    rows = membership(pages, grouping).join(info, ["source", "page_idx"])
    item = F.struct((F.col("page_idx") + 1).alias("page"), F.col("effective_state").alias("state"))
    return rows.groupBy("source", "cover_idx", "number").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("pages"))


def pause_points(pages: DataFrame) -> DataFrame:
    """The first page, not the last, that starts a new document or needs a decision, if any.

    Per source as pause_idx, or with workspace and source_ord per workspace as
    pause_source and pause_idx.  Optional columns: pending, true for pages not
    analysed before; when there are others too, only pages from the first of
    them on can pause.  first_page_error: analysis ends there without a pause.
    """
    many = "workspace" in pages.columns
    key = "workspace" if many else "source"
    flag = lambda name: F.coalesce(F.col(name), F.lit(False)) if name in pages.columns else F.lit(False)
    w = Window.partitionBy(*(["workspace", "source_ord"] if many else []), "source").orderBy("idx")
    state = F.col("effective_state")
    stops = ((state == "cover") & (F.lag(state).over(w) == "attachment")) | (state == "review") | ((state == "cover") & (F.col("number") == ""))
    at = F.struct((F.col("source_ord").cast("long") if many else F.lit(0).cast("long")).alias("ord"), F.col("idx").alias("idx"), F.col("source").alias("source"))
    rows = pages.select(F.col(key).alias("_key"), at.alias("_at"), stops.alias("_stops"), flag("pending").alias("_pending"), flag("first_page_error").alias("_error"))
    start = F.when(F.count_if("_pending") < F.count("*"), F.min(F.when(F.col("_pending"), F.col("_at"))))
    ends = rows.groupBy("_key").agg(F.max("_at").alias("_last"), start.alias("_start"))
    left = rows.join(ends, "_key").withColumn("_in", F.coalesce(F.col("_at") >= F.col("_start"), F.lit(True)))
    first = lambda c: F.min(F.when(F.col("_in") & c, F.col("_at")))
    out = left.groupBy("_key").agg(first(F.col("_stops") & (F.col("_at") < F.col("_last"))).alias("_stop"), first(F.col("_error")).alias("_end"))
    pause = F.when(F.coalesce(F.col("_stop") < F.col("_end"), F.lit(True)), F.col("_stop"))
    named = [F.col("_key").alias(key), *([pause["source"].alias("pause_source")] if many else []), pause["idx"].alias("pause_idx")]
    return out.select(*named)


def approval_problems(pages: DataFrame, grouping: str = "shared", listed: int = 8) -> DataFrame:
    """Per source the first thing that blocks saving: problem ('' when none), n_pages and the first page numbers.

    Optional columns come before the pages' problems, in this order: job_status
    other than review, as queued, analyzing, error, exporting or not_in_review;
    first_page_error without a decision, as first_page.  They list no pages.
    """
    job = F.col("job_status") if "job_status" in pages.columns else F.lit("review")
    decided = F.coalesce(F.col("decision"), F.lit("")) != "" if "decision" in pages.columns else F.lit(False)
    error = F.coalesce(F.col("first_page_error"), F.lit(False)) & ~decided if "first_page_error" in pages.columns else F.lit(False)
    runs = page_runs(pages, grouping).withColumn("id", F.row_number().over(Window.partitionBy("source").orderBy("idx")))
    free = (F.col("kind") == "B") | ((F.col("kind") == "A") & ~F.col("anchor").eqNullSafe(F.lit("C")))
    which = F.when(free, F.when(F.col("effective_state") == "pending", 1).when(F.col("effective_state") == "review", 2).when(F.col("effective_state") == "cover", 3).otherwise(4))
    status = F.when(job.isin("queued", "analyzing", "error", "exporting"), job).when(~job.eqNullSafe(F.lit("review")), "not_in_review")
    runs = runs.withColumns({"_status": status, "_error": error})
    state = runs.withColumn("_p", which).withColumn("_first", F.min("_p").over(Window.partitionBy("source")))
    out = state.groupBy("source").agg(F.min("_first").alias("p"), F.count_if(F.col("_p") == F.col("_first")).alias("n_pages"), F.count_if(F.col("kind") == "C").alias("_docs"), F.sort_array(F.collect_list(F.when(F.col("_p") == F.col("_first"), F.col("id")))).alias("_ids"), F.coalesce(F.max("_status"), F.when(F.bool_or("_error"), "first_page")).alias("_job"))
    out = out.withColumns({"n_pages": F.when(F.col("_job").isNull(), F.col("n_pages")).otherwise(F.lit(0).cast("long")), "_ids": F.when(F.col("_job").isNull(), F.col("_ids")).otherwise(F.slice("_ids", 1, 0))})
    p = F.col("p")
    names = F.when(p == 1, "pending").when(p == 2, "review").when(p == 3, "cover_without_number").when(p == 4, "loose")
    return out.select("source", F.coalesce("_job", names, F.when(F.col("_docs") == 0, "no_documents"), F.lit("")).alias("problem"), "n_pages", F.array_join(F.slice("_ids", 1, listed), ",").alias("page_ids"), (F.size("_ids") > listed).alias("truncated"))


SOURCE = ["workspace", "source_ord", "source"]


def _by_workspace(pages: DataFrame) -> DataFrame:
    """Pages whose source is told apart by workspace, so that one file may be in several."""
    return pages.withColumn("source", F.struct(*SOURCE))


def _before(size: str) -> Column:
    """Sum of size over the sources of a workspace that come before; a window over sources, not pages."""
    return F.coalesce(F.sum(size).over(Window.partitionBy("source.workspace").orderBy("source.source_ord", "source.source").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def page_ids(pages: DataFrame) -> DataFrame:
    """pages (workspace, source_ord, source, idx) with id: their place in the workspace, from 1 on.

    Numbered in two levels: places within each source, and the pages of the
    sources before it.  No window runs over the pages of a whole workspace.
    """
    rows = _by_workspace(pages).withColumn("_place", F.row_number().over(Window.partitionBy("source").orderBy("idx")))
    sizes = rows.groupBy("source").agg(F.count("*").alias("_n")).select("source", _before("_n").alias("_before"))
    out = rows.join(sizes, "source").withColumn("id", F.col("_before") + F.col("_place"))
    return out.select(*[F.col("source.source").alias("source") if c == "source" else F.col(f"`{c}`") for c in pages.columns], "id")


def workspace_summary(pages: DataFrame, grouping: str = "shared") -> DataFrame:
    """summary per workspace, with its number of sources; ready counts the pages that saving would take of the whole workspace."""
    from docbatch.operators.archive import saveable_prefix

    each = summary(_by_workspace(pages), grouping).drop("ready")
    counts = ["pages", "covers", "needs_review", "documents", "loose", "pending", "analysed"]
    out = each.groupBy(F.col("source.workspace").alias("workspace")).agg(F.count("*").alias("sources"), *[F.sum(c).alias(c) for c in counts])
    ready = saveable_prefix(pages).groupBy("workspace").agg(F.sum("saveable").alias("ready"))
    return out.join(ready, "workspace")


def workspace_problems(pages: DataFrame, grouping: str = "shared", listed: int = 8) -> DataFrame:
    """approval_problems per workspace: page_ids are places in the workspace, in order.

    Each source gives its counts and first places by kind of problem, the
    workspace takes those of its first kind; what moves between the two is a row
    per source.
    """
    job = F.col("job_status") if "job_status" in pages.columns else F.lit("review")
    decided = F.coalesce(F.col("decision"), F.lit("")) != "" if "decision" in pages.columns else F.lit(False)
    error = F.coalesce(F.col("first_page_error"), F.lit(False)) & ~decided if "first_page_error" in pages.columns else F.lit(False)
    free = (F.col("kind") == "B") | ((F.col("kind") == "A") & ~F.col("anchor").eqNullSafe(F.lit("C")))
    state = F.col("effective_state")
    which = F.when(free, F.when(state == "pending", 0).when(state == "review", 1).when(state == "cover", 2).otherwise(3))
    status = F.when(job.isin("queued", "analyzing", "error", "exporting"), job).when(~job.eqNullSafe(F.lit("review")), "not_in_review")
    runs = page_runs(_by_workspace(pages).withColumns({"_status": status, "_error": error}), grouping)
    runs = runs.withColumns({"_which": which, "_place": F.row_number().over(Window.partitionBy("source").orderBy("idx"))})
    kinds = range(4)
    counts = F.array(*[F.count_if(F.col("_which") == k) for k in kinds])
    places = F.array(*[F.slice(F.sort_array(F.collect_list(F.when(F.col("_which") == k, F.col("_place")))), 1, listed) for k in kinds])
    each = runs.groupBy("source").agg(F.count("*").alias("_n"), counts.alias("_counts"), places.alias("_places"), F.count_if(F.col("kind") == "C").alias("_docs"), F.max("_status").alias("_status"), F.bool_or("_error").alias("_error"))
    each = each.withColumn("_before", _before("_n"))
    ids = F.transform("_places", lambda own: F.transform(own, lambda p: p + F.col("_before")))
    gathered = each.withColumn("_ids", ids).groupBy(F.col("source.workspace").alias("workspace")).agg(
        F.array(*[F.sum(F.col("_counts")[k]) for k in kinds]).alias("_counts"), F.array(*[F.slice(F.sort_array(F.flatten(F.collect_list(F.col("_ids")[k]))), 1, listed) for k in kinds]).alias("_ids"),
        F.sum("_docs").alias("_docs"), F.coalesce(F.max("_status"), F.when(F.bool_or("_error"), "first_page")).alias("_job"),
    )
    first = F.when(F.col("_job").isNull(), F.when(F.col("_counts")[0] > 0, 0).when(F.col("_counts")[1] > 0, 1).when(F.col("_counts")[2] > 0, 2).when(F.col("_counts")[3] > 0, 3))
    names = F.get(F.array(*map(F.lit, ("pending", "review", "cover_without_number", "loose"))), first)
    out = gathered.withColumn("_first", first)
    n = F.coalesce(F.get("_counts", F.col("_first")), F.lit(0))
    problem = F.coalesce("_job", names, F.when(F.col("_docs") == 0, "no_documents"), F.lit(""))
    return out.select("workspace", problem.alias("problem"), n.alias("n_pages"), F.coalesce(F.array_join(F.get("_ids", F.col("_first")), ","), F.lit("")).alias("page_ids"), (n > listed).alias("truncated"))
