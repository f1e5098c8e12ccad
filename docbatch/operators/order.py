"""Places in an order over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docbatch.sources.shared import stored

_IN_PARTITION = (1 << 33) - 1  # the low bits of monotonically_increasing_id count the rows of a partition


def places(rows: DataFrame, *order: Column, within: tuple[str, ...] = ()) -> DataFrame:
    """rows with place, from 1 on by order; equal rows by order take following places in any way.

    within: columns whose every group is numbered for itself, in its own order.

    The table is dealt by ranges of the order and sorted within them, so the work
    spreads over as many tasks as there are rows for, with no window over the
    whole; a range's first place is the number of rows in the ranges before it.
    The sorted table is stored, as ranges come from a sample and must not change
    between counting and numbering.  An empty table stays empty.
    """
    keys = [*map(F.col, within), *order]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = stored(dealt.withColumns({"_part": F.spark_partition_id(), "_row": F.monotonically_increasing_id()}), "sorted")
    before, starts = 0, []
    for part, n in sorted((r["_part"], r["n"]) for r in dealt.groupBy("_part").agg(F.count("*").alias("n")).collect()):  # a number per range
        starts.append((part, before))
        before += n
    offsets = rows.sparkSession.createDataFrame(starts, "_part int, _before long")
    placed = dealt.join(F.broadcast(offsets), "_part")
    placed = placed.select(*[f"`{c}`" for c in rows.columns], (F.col("_before") + F.col("_row").bitwiseAND(F.lit(_IN_PARTITION)) + 1).alias("place"))
    if not within:
        return placed
    firsts = placed.groupBy(*within).agg(F.min("place").alias("_first")).withColumnsRenamed({c: f"_{k}" for k, c in enumerate(within)})
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"_{k}")) for k, c in enumerate(within)]
    return placed.join(firsts, same).select(*[f"`{c}`" for c in rows.columns], (F.col("place") - F.col("_first") + 1).alias("place"))
