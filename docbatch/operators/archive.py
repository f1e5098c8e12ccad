"""Saving documents: what can be saved, under which names, and whether it was."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docbatch.operators.grouping import page_runs


def list_pages(files: DataFrame, most: int = 5000) -> DataFrame:
    """files (path, n_pages) to one row per page (source, idx); other suffixes give none, and list_rejects has the rest.

    Where files have size and mtime_ns, pages have them as source_signature.
    """
    kept = files.where(F.lower("path").endswith(".pdf") & F.col("n_pages").between(1, most))
    signed = [F.struct("size", "mtime_ns").alias("source_signature")] if {"size", "mtime_ns"} <= set(files.columns) else []
    return kept.select(F.col("path").alias("source"), F.explode(F.sequence(F.lit(0), (F.col("n_pages") - 1).cast("int"))).alias("idx"), *signed)


def list_rejects(files: DataFrame, most: int = 5000) -> DataFrame:
    """The files of the suffix that list_pages gives no page of: path, n_pages, reason (no_pages also for an unknown number)."""
    reason = F.when(F.coalesce("n_pages", F.lit(0)) < 1, "no_pages").when(F.col("n_pages") > most, "too_many_pages")
    return files.where(F.lower("path").endswith(".pdf")).select("path", "n_pages", reason.alias("reason")).where("reason is not null")


def saveable_prefix(pages: DataFrame) -> DataFrame:
    """Per source how many of its pages can be saved; with workspace and source_ord, sources belong to workspaces in that order.

    While some pages of a workspace but not all are pending (by state where
    there is one, else effective_state), the last run of covers before the first
    pending page in its source may still grow, so saving ends before it.
    """
    keys = ["workspace", "source_ord", "source"] if "workspace" in pages.columns else ["source"]
    raw = F.col("state") if "state" in pages.columns else F.col("effective_state")
    w = Window.partitionBy(*keys).orderBy("idx")
    whole = Window.partitionBy(*keys)
    state = F.col("effective_state")
    first = F.min(F.when(raw == "pending", F.col("idx"))).over(whole)
    starts = (state == "cover") & ~F.lag(state).over(w).eqNullSafe("cover")
    rows = pages.select(*keys, "idx", (raw == "pending").alias("_pending"), first.alias("_first"), starts.alias("_starts"))
    cut = F.max(F.when(F.col("_starts") & (F.col("idx") < F.col("_first")), F.col("idx"))).over(whole)
    rows = rows.withColumn("_before", F.coalesce(F.col("idx") < cut, F.lit(False)))
    each = rows.groupBy(*keys).agg(F.count("*").alias("pages"), F.count_if("_pending").alias("_n"), F.count_if("_before").alias("_cut"))
    if "workspace" not in pages.columns:
        return each.select("source", "pages", F.when(F.col("_n").between(F.lit(1), F.col("pages") - 1), F.col("_cut")).otherwise(F.col("pages")).alias("saveable"))
    all_ = each.groupBy("workspace").agg(F.min(F.when(F.col("_n") > 0, F.col("source_ord"))).alias("_at"), (F.sum("_n") < F.sum("pages")).alias("_some"))
    saveable = F.when(F.col("_at").isNull() | ~F.col("_some") | (F.col("source_ord") < F.col("_at")), F.col("pages")).when(F.col("source_ord") == F.col("_at"), F.col("_cut")).otherwise(F.lit(0).cast("long"))
    return each.join(all_, "workspace").select(*keys, "pages", saveable.alias("saveable"))


def archive_gate(pages: DataFrame, grouping: str = "shared") -> DataFrame:
    """Per source the status after analysis: exporting when there are documents and no page is loose, else review.

    Optional columns: a page with first_page_error, decided or not, and a source
    without auto_save go to review; a page with an error that isn't null makes its
    source an error.
    """
    has = lambda name, default: F.coalesce(F.col(name), F.lit(default)) if name in pages.columns else F.lit(default)
    loose = (F.col("kind") == "B") | ((F.col("kind") == "A") & ~F.col("anchor").eqNullSafe("C"))
    kept = (~F.bool_or(has("first_page_error", False)) & F.bool_and(has("auto_save", True))).alias("_automatic")
    failed = F.bool_or(F.col("error").isNotNull()) if "error" in pages.columns else F.bool_or(F.lit(False))
    out = page_runs(pages, grouping).groupBy("source").agg(F.count_if(F.col("kind") == "C").alias("documents"), F.count_if(loose).alias("unassigned"), kept, failed.alias("_failed"))
    return out.withColumn("status", F.when(F.col("_failed"), "error").when((F.col("documents") > 0) & (F.col("unassigned") == 0) & F.col("_automatic"), "exporting").otherwise("review")).drop("_automatic", "_failed")


def kth_free(k: Column, used: Column) -> Column:
    """The k-th number from 1 on that isn't in the sorted array used; null is an empty one."""
    return F.aggregate(F.coalesce(used, F.array().cast("array<int>")), k, lambda n, t: F.when(t <= n, n + 1).otherwise(n))


def claim_names(items: DataFrame, taken: DataFrame, order: str) -> DataFrame:
    """items (folder, stem) with the first free of stem, stem_02, stem_03 and so on, by `order`.

    taken: (folder, stem, number) of the names that exist.  Stems that differ
    only in numbers at their ends can meet in a name; where a folder has several
    such, they are named one after another, all others by counting.
    """
    root = F.regexp_replace("stem", r"(_\d{2,})+$", "")
    both = items.select("folder", "stem").unionByName(taken.select("folder", "stem"))
    met = both.groupBy("folder", root.alias("_root")).agg((F.min("stem") != F.max("stem")).alias("_met")).where("_met").select("folder", "_root")
    rows = items.withColumn("_root", root)
    alone = rows.join(met, ["folder", "_root"], "left_anti").select(*items.columns)
    used = taken.groupBy("folder", "stem").agg(F.array_sort(F.collect_set(F.col("number").cast("int"))).alias("_used"))
    alone = alone.withColumn("_k", F.row_number().over(Window.partitionBy("folder", "stem").orderBy(order))).join(used, ["folder", "stem"], "left")
    free = kth_free(F.col("_k"), F.col("_used"))
    number = F.when(free < 10, F.concat(F.lit("0"), free.cast("string"))).otherwise(free.cast("string"))
    counted = alone.withColumn("name", F.when(free == 1, F.col("stem")).otherwise(F.concat("stem", F.lit("_"), number))).drop("_k", "_used")

    columns = [*items.columns, "name"]

    def fold(key, mine, there):
        held = {s if n == 1 else f"{s}_{int(n):02d}" for s, n in zip(there["_s"], there["_n"], strict=True)}
        mine = mine.sort_values([order, "stem"], kind="stable")
        names, following = [], {}
        for stem in mine["stem"]:
            n = following.get(stem, 1)
            while (name := stem if n == 1 else f"{stem}_{n:02d}") in held:
                n += 1
            held.add(name)
            following[stem] = n + 1
            names.append(name)
        return mine.assign(name=names)[columns]

    schema = items.withColumn("name", F.lit("")).schema
    mine = rows.join(met, ["folder", "_root"], "left_semi")
    there = taken.withColumn("_root", root).join(met, ["folder", "_root"], "left_semi").select(F.col("folder").alias("_f"), F.col("_root").alias("_r"), F.col("stem").alias("_s"), F.col("number").alias("_n"))
    folded = mine.groupBy("folder", "_root").cogroup(there.groupBy("_f", "_r")).applyInPandas(fold, schema)
    return counted.unionByName(folded)


def committed(markers: DataFrame, listing: DataFrame) -> DataFrame:
    """markers (job, name, size), listing (job, name, size): per job whether every listed file is there in its size under a bare name."""
    # both are counted by name in one aggregate, without a join: a name is right when all its sizes are one; a null job or name is nowhere
    side = lambda rows, listed: rows.select("job", "name", "size", F.lit(listed).alias("_listed"))
    both = side(markers, False).unionByName(side(listing, True)).groupBy("job", "name").agg(
        F.count_if(~F.col("_listed")).alias("_marked"), F.count_if("_listed").alias("_there"), F.count("size").alias("_sizes"), F.min("size").alias("_least"), F.max("size").alias("_most"),
    ).where("_marked > 0")
    known = F.col("job").isNotNull() & F.col("name").isNotNull()
    same = (F.col("_there") > 0) & (F.col("_sizes") == F.col("_marked") + F.col("_there")) & (F.col("_least") == F.col("_most"))
    right = F.coalesce(known & same & ~F.col("name").rlike(r"[/\\]"), F.lit(False))
    files = F.col("_marked") * F.when(known, F.greatest("_there", F.lit(1))).otherwise(F.lit(1))
    return both.groupBy("job").agg(F.sum(files).alias("files"), F.bool_and(right).alias("committed"))


def recover(jobs: DataFrame, done: DataFrame) -> DataFrame:
    """Statuses after a restart: analyzing starts again, exporting is done when committed and goes to review otherwise."""
    status = F.when(F.col("status") == "analyzing", "queued").when(F.col("status") == "exporting", F.when(F.coalesce("committed", F.lit(False)), "done").otherwise("review")).otherwise(F.col("status"))
    return jobs.join(done.select("job", "committed"), "job", "left").withColumn("status", status).drop("committed")


def source_drift(recorded: DataFrame, current: DataFrame) -> DataFrame:
    """recorded (source, signature), current (source, signature): sources that changed or are gone; a null record passes."""
    now = current.select("source", F.col("signature").alias("_now"), F.lit(True).alias("_there"))
    drifted = F.col("signature").isNotNull() & ~F.col("signature").eqNullSafe(F.col("_now"))
    return recorded.join(now, "source", "left").select("source", drifted.alias("drifted"), F.col("_there").isNull().alias("missing"))


def exclude_stamps(stamps: DataFrame, boxes: DataFrame) -> DataFrame:
    """Stamps whose centre lies in no barcode box of their page; edges count as inside."""
    s, b = stamps.alias("s"), boxes.alias("b")
    return s.join(b, F.expr("s.page = b.page and s.cx between b.x0 and b.x1 and s.cy between b.y0 and b.y1"), "left_anti")


def progress(events: DataFrame) -> DataFrame:
    """events (job, ts, event_id, done, total) to the last report of each job by time: done, total, and how many there were."""
    last = F.max_by(F.struct("done", "total"), F.struct("ts", "event_id"))
    return events.groupBy("job").agg(last.alias("_last"), F.count("*").alias("reports")).select("job", "_last.done", "_last.total", "reports")
