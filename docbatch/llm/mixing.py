"""Mixing sources to target weights by entropy balancing, with DataFrame functions only.

Every document gets a rate r >= 0, the expected number of its copies.  Among all
rates with sum(r * size) equal to the target of each source and r <= max_copies,
the ones nearest to 1 in relative entropy are r = min(max_copies, exp(t * size))
with one t per source.  t solves the convex dual; safeguarded Newton steps find
it, each one a distributed aggregate over the histogram (source, size, count),
which stands for all documents.  Rates become whole copies by systematic
rounding along the sizes of a source: the copies of any run of documents differ
from its summed rates by less than one, so the words of a source miss the target
by about one document at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docbatch.llm.store import materialize
from docbatch.llm.textio import SPACE

_ONE = 1 << 20  # rates are whole multiples of 1/_ONE, so that sums don't depend on their order
_SRC = ["_none", "_src"]


def n_words(text: str = "text"):
    """Words between ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(SPACE.replace("[", "[^") + "+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, stop: float = 3.0) -> DataFrame:
    """sizes: one row per source with source_size.  Adds target.

    Sources weigh as weights, repeating, by code point, null last; they share
    ``share`` of all sizes.  A target stops at ``stop`` times its source's size
    and the excess goes to the others by weight: the level of a water filling.
    The windows run over one row per source.
    """
    every = Window.orderBy(*_SRC)
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(every) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("_w", w).withColumn("_cap", F.col("source_size") * stop)
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), *_SRC)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.orderBy(*_SRC).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after)
    rows = rows.withColumn("_level", level).withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_cap") / F.col("_w"), F.col("_level"))).over(whole))
    return rows.withColumn("target", F.coalesce(F.least(F.col("_cap"), F.col("_w") * F.col("_level")), F.col("_cap"))).drop("_w", "_cap", "_level")


def balance(hist: DataFrame, targets: DataFrame, max_copies: float = 3.0, steps: int = 60, tolerance: float = 1e-10) -> DataFrame:
    """The dual variable t of each source, and its scale: rates are min(max_copies, exp(t * size / scale))."""
    scale = hist.groupBy(*_SRC).agg((F.sum(F.col("size") * F.col("size") * F.col("n").cast("double")) / F.sum(F.col("size") * F.col("n"))).alias("scale"))
    state = targets.join(scale, _SRC).select(
        *_SRC, "target", "source_size", F.coalesce("scale", F.lit(1.0)).alias("scale"), F.lit(0.0).alias("t"),
        F.lit(float("-inf")).alias("lo"), F.lit(float("inf")).alias("hi"), F.lit(False).alias("done"),
    )
    state = materialize(state.withColumn("done", (F.col("target") <= 0) | (F.col("target") >= F.col("source_size") * max_copies)), "dual")
    fixed = state.where("done")
    open_ = state.where("not done")
    x = F.col("size") / F.col("scale")
    for _ in range(steps):
        r = F.least(F.lit(max_copies), F.exp(F.least(F.col("t") * x, F.lit(50.0))))
        words = F.col("n") * F.col("size") * r
        sums = hist.join(open_, _SRC).groupBy(*_SRC).agg(F.sum(words).alias("g"), F.sum(F.when(r < max_copies, words * x).otherwise(0.0)).alias("h"))
        miss = F.log(F.col("g") / F.col("target"))
        lo, hi = F.when(miss < 0, F.col("t")).otherwise(F.col("lo")), F.when(miss >= 0, F.col("t")).otherwise(F.col("hi"))
        stepped = open_.join(sums, _SRC).withColumn("lo", lo).withColumn("hi", hi)
        newton = F.col("t") - miss * F.col("g") / F.col("h")
        middle = F.when(F.col("lo") == float("-inf"), F.col("hi") * 2 - 1).when(F.col("hi") == float("inf"), F.col("lo") * 2 + 1).otherwise((F.col("lo") + F.col("hi")) / 2)
        t = F.when(F.abs(miss) <= tolerance, F.col("t")).when((F.col("h") > 0) & (newton > F.col("lo")) & (newton < F.col("hi")), newton).otherwise(middle)
        stuck = (F.col("hi") - F.col("lo")) < 1e-12
        open_ = materialize(stepped.withColumn("done", (F.abs(miss) <= tolerance) | stuck).withColumn("t", t).select(*state.columns), "dual")
        if open_.where("not done").isEmpty():
            break
    return fixed.withColumn("t", F.lit(None).cast("double")).unionByName(open_).select(*_SRC, "target", "source_size", "scale", "t")


def mixed_copies(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, max_copies: float = 3.0, rows_per_salt: int = 1000) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies.

    Null texts and texts of white space have size 0 and one copy.  Null is a
    source of its own.  The result depends on (doc_id, source, size) alone, so
    reruns agree; rows equal in all three are interchangeable.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").isNull().alias("_none"), F.coalesce("source", F.lit("")).alias("_src"), n_words().alias("size"))
    hash_ = F.xxhash64("doc_id")
    rows = materialize(rows, "sizes")
    hist = materialize(rows.groupBy(*_SRC, "size").agg(F.count("*").alias("n")), "histogram")
    total = hist.agg(F.sum("n")).first()[0] or 0
    targets = source_targets(hist.groupBy(*_SRC).agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, max_copies)
    dual = balance(hist, targets, max_copies)
    # capped from the start (no t): the most copies if there is a target, else none
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("t").isNotNull(), F.least(F.lit(max_copies), F.exp(F.least(F.round("t", 9) * F.col("size") / F.col("scale"), F.lit(50.0))))).otherwise(F.when(F.col("target") > 0, max_copies).otherwise(0.0))
    rates = hist.join(dual, _SRC).withColumn("rf", F.round(rate * _ONE).cast("long"))
    smaller = Window.partitionBy(*_SRC).orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    rates = materialize(rates.withColumn("p1", F.coalesce(F.sum(F.col("rf") * F.col("n")).over(smaller), F.lit(0))), "rates")

    salts = max(1, -(-total // rows_per_salt))
    rows = rows.withColumn("salt", F.pmod(hash_, F.lit(salts)))
    cells = rows.groupBy(*_SRC, "size", "salt").agg(F.count("*").alias("c"))
    cells = cells.withColumn("p2", F.coalesce(F.sum("c").over(Window.partitionBy(*_SRC, "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    cells = materialize(cells.select(*_SRC, "size", "salt", "p2"), "cells")
    cells = cells.join(rates.select(*_SRC, "size", "target", "source_size", "rf", "p1"), [*_SRC, "size"])
    rank = F.row_number().over(Window.partitionBy(*_SRC, "size", "salt").orderBy(hash_, "doc_id"))
    rows = rows.withColumn("m", rank).join(cells, [*_SRC, "size", "salt"])
    reached = lambda m: F.floor((F.col("p1") + F.col("rf") * m + _ONE // 2) / F.lit(_ONE).cast("decimal(20,0)"))
    copies = F.when(F.col("size") == 0, 1).otherwise(reached(F.col("p2") + F.col("m")) - reached(F.col("p2") + F.col("m") - 1))
    return rows.select("doc_id", F.when(~F.col("_none"), F.col("_src")).alias("source"), "size", "source_size", "target", copies.cast("int").alias("copies"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), share: float = 1.0, max_copies: float = 3.0) -> DataFrame:
    """The rows of docs, each as often as the mix takes it.

    Copies are found per (doc_id, source, size); of rows equal in all three each
    takes the average, rounded by its place.  Null texts stay once, an empty
    table stays empty, and all columns stay, whatever they are called.
    """
    own = mixed_copies(docs, weights, share, max_copies).groupBy("doc_id", "source", "size").agg(F.sum("copies").alias("sum"), F.count("*").alias("rows"))
    own = own.select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("size").alias("z"), "sum", "rows")
    # the rows of docs stay whole in one column, whatever theirs are called
    sized = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("source").alias("source"), n_words().alias("size"))
    joined = sized.join(own, sized["doc_id"].eqNullSafe(F.col("d")) & sized["source"].eqNullSafe(F.col("s")) & (sized["size"] == F.col("z")))
    twin = F.row_number().over(Window.partitionBy("d", "s", "z").orderBy(F.xxhash64("row.text")))
    times = F.floor(F.col("sum") * twin / F.col("rows")) - F.floor(F.col("sum") * (twin - 1) / F.col("rows"))
    taken = joined.withColumn("times", times.cast("int")).where("times > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("time"))
    return taken.select("row.*")
