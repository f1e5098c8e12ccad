"""From detections to one verdict per page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def page_evidence(detections: DataFrame) -> DataFrame:
    """One row per page: stamp, report values, other values, headings; one shuffle, by page.

    Rows without a page key are left out of no page: nulls group together.
    """
    has = lambda kind: F.bool_or(F.col("stamp") == kind)
    ordered = lambda c: F.array_distinct(F.transform(F.sort_array(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("ord", F.col(c).alias("v"))))), lambda x: x["v"]))
    page = detections.groupBy("source", "idx").agg(
        has("blue").alias("_blue"), has("black").alias("_black"), has("faint").alias("_faint"), F.bool_or("headed").alias("target_found"),
        F.bool_or(F.col("headed") & F.col("report").isNull()).alias("unreadable"), ordered("report").alias("reports"), ordered("other").alias("_others"),
    )
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    stamp = F.when(yes("_blue") & (yes("_black") | yes("_faint")), "mixed").when(yes("_black"), "black").when(yes("_faint"), "faint").when(yes("_blue"), "blue").otherwise("none")
    return page.select(
        "source", "idx", stamp.alias("stamp"), yes("target_found").alias("target_found"), yes("unreadable").alias("unreadable"), "reports",
        F.array_except("_others", "reports").alias("other_barcodes"), F.when(F.size("reports") == 1, F.col("reports")[0]).otherwise("").alias("barcode"),
    )


def page_verdict(pages: DataFrame, review_missing_stamp: bool = True) -> DataFrame:
    """Adds state, reason and first_page_error; the first rule that holds decides.

    Optional column error: a page whose analysis failed (not null) goes to review
    as failed, and isn't a first page error; archive_gate makes its job an error.
    """
    none, targets = F.col("stamp") == "none", F.size("reports") > 0
    rules: list[tuple[Column, str, str]] = [
        ((F.col("idx") == 0) & ~F.col("target_found") & none, "review", "first_page"),
        (F.size("reports") > 1, "review", "multiple_numbers"),
        (F.col("unreadable") & ~targets, "review", "unreadable"),
        (targets & (F.col("stamp") == "blue"), "cover", "blue"),
    ]
    if not review_missing_stamp:
        rules.append((targets & none, "attachment", "missing_stamp"))
    state, reason = F.lit("attachment"), F.lit("following")
    state, reason = F.when(targets, F.lit("review")).otherwise(state), F.when(targets, F.concat(F.lit("stamp_"), F.col("stamp"))).otherwise(reason)
    for holds, s, r in reversed(rules):
        state, reason = F.when(holds, s).otherwise(state), F.when(holds, r).otherwise(reason)
    first = rules[0][0]
    if "error" in pages.columns:
        failed = F.col("error").isNotNull()
        state, reason, first = F.when(failed, "review").otherwise(state), F.when(failed, "failed").otherwise(reason), ~failed & first
    return pages.withColumns({"state": state, "reason": reason, "first_page_error": first})


def stamp_rule(pages: DataFrame, review_mixed: bool = True, review_plain: bool = True) -> DataFrame:
    """Pages with a heading, a number that holds (a user's, else the code's) and a stamp that isn't blue alone: to review, or following pages by option.

    Adds needs_review: the rule sent the page to review and no user has decided
    it.  Where pages have a reason it names the stamp, with _following for pages
    that became following ones.  Optional columns: manual_barcode, decision.
    """
    manual = _stripped(F.col("manual_barcode")) if "manual_barcode" in pages.columns else F.lit("")
    decided = F.coalesce("decision", F.lit("")) != "" if "decision" in pages.columns else F.lit(False)
    number = F.coalesce(F.nullif(manual, F.lit("")), F.col("barcode"), F.lit(""))
    applies = F.coalesce(F.col("target_found") & (number != "") & F.col("stamp").isin("mixed", "black", "faint"), F.lit(False))
    review = F.when(F.col("stamp") == "mixed", F.lit(review_mixed)).otherwise(F.lit(review_plain))
    new = {"state": F.when(applies, F.when(review, "review").otherwise("attachment")).otherwise(F.col("state")), "needs_review": applies & review & ~decided}
    if "reason" in pages.columns:
        new["reason"] = F.when(applies, F.concat(F.lit("stamp_"), "stamp", F.when(review, "").otherwise("_following"))).otherwise(F.col("reason"))
    return pages.withColumns(new)


def _stripped(text: Column) -> Column:
    """Without white space of any kind at its ends; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")


def effective(pages: DataFrame) -> DataFrame:
    """number and effective_state from automatic values and manual decisions."""
    manual = F.nullif(_stripped(F.col("manual_barcode")), F.lit(""))
    return pages.withColumns({"number": F.coalesce(manual, "barcode"), "effective_state": F.coalesce(F.nullif(F.col("decision"), F.lit("")), "state")})


def read_vote(reads: DataFrame, least: int = 2) -> DataFrame:
    """Per region the values read at least twice in the first attempt that has any: region, attempt, value, box and score.

    Readings are dealt out by region once, which serves the counts and the window.
    """
    kept = reads.repartition("region").groupBy("region", "attempt", "value").agg(F.count("*").alias("n"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.min("score").alias("score")).where(F.col("n") >= least)
    return kept.withColumn("_first", F.min("attempt").over(Window.partitionBy("region"))).where("attempt = _first").drop("_first")


def distinct_stamps(stamps: DataFrame, share: float = 0.8) -> DataFrame:
    """Greedy suppression per page by falling score: a stamp too near to a kept one goes.  Rows (page, n_kept, kept keys)."""
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "key", "cx", "cy", "r")))
    page = stamps.groupBy("page").agg(ordered.alias("c"))
    near = lambda a, b: F.sqrt((a["cx"] - b["cx"]) * (a["cx"] - b["cx"]) + (a["cy"] - b["cy"]) * (a["cy"] - b["cy"])) < share * F.greatest(a["r"], b["r"])
    kept = F.aggregate("c", F.slice("c", 1, 0), lambda acc, x: F.when(F.exists(acc, lambda y: near(x, y)), acc).otherwise(F.concat(acc, F.array(x))))
    return page.select("page", F.size("c").cast("long").alias("n_candidates"), kept.alias("kept")).select("page", "n_candidates", F.size("kept").cast("long").alias("n_kept"), F.aggregate("kept", F.lit(0.0), lambda a, x: a - x["s"]).alias("kept_score"))
