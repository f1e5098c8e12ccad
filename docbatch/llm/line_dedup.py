"""Line dedup over levelled sorted runs of line hashes, with DataFrame functions only.

``LineRuns`` keeps the hashes it has seen as sorted runs in levels: a batch adds
one run to level 0, and when a level holds ``fanout`` runs they are merged into
one run of the next level.  A new batch is merge-anti-joined with the runs, so
only hashes that no earlier batch had remain, and these become its own run.
Batches go from the largest doc_id down; whoever comes first keeps a line.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docbatch.llm.store import materialize

_STRIP = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends; its letters A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(_STRIP)), _UPPER, _LOWER)


def line_hash(key: Column) -> list[Column]:
    """128 bits of hash as two longs."""
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2")]


class LineRuns:
    """Sorted runs (h1, h2, keeper) in levels; each hash is in one run only."""

    def __init__(self, fanout: int = 4) -> None:
        self.fanout, self.levels = fanout, [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def unseen(self, batch: DataFrame) -> DataFrame:
        """Rows of batch whose hash no run holds: one merge-anti-join per run."""
        for run in self.runs():
            batch = batch.join(run.select(*KEY).hint("merge"), KEY, "left_anti")
        return batch

    def add(self, rows: DataFrame) -> None:
        self.levels[0].append(self._run(rows))
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                whole = self.levels[k][0]
                for run in self.levels[k][1:]:
                    whole = whole.unionByName(run)
                self.levels[k] = []
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._run(whole))

    @staticmethod
    def _run(rows: DataFrame) -> DataFrame:
        return materialize(rows.repartition(*KEY).sortWithinPartitions(*KEY), "run")

    def all(self) -> DataFrame | None:
        runs = self.runs()
        out = runs[0] if runs else None
        for run in runs[1:]:
            out = out.unionByName(run)
        return out


def _text_keys(text: Column) -> list[Column]:
    """128 bits that tell the texts of one doc_id apart."""
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit("text"), text).alias("t2")]


class _Salts:
    """Deals the rows of lines that are in very many places to several tasks, on both sides of a join.

    There are at most 2^12 such lines, as each has total / 2^12 places or more.
    """

    def __init__(self, counts: DataFrame, total: int, per_task: int = 1000) -> None:
        often = counts.where(F.col("n") >= max(per_task, total >> 12))
        self.hot = F.broadcast(materialize(often.select(*KEY, F.ceil(F.col("n") / per_task).alias("salts")), "often"))

    def deal(self, rows: DataFrame) -> DataFrame:
        salt = F.pmod(F.xxhash64("doc_id", "pos"), F.coalesce("salts", F.lit(1)))
        return rows.join(self.hot, KEY, "left").withColumn("salt", salt).drop("salts")

    def spread(self, keys: DataFrame) -> DataFrame:
        salts = F.sequence(F.lit(0).cast("long"), F.coalesce("salts", F.lit(1)) - 1)
        return keys.join(self.hot, KEY, "left").withColumn("salt", F.explode(salts)).drop("salts")


def dropped_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 4) -> DataFrame:
    """Rows (doc_id, t1, t2, places): of each text, the places of the lines that leave it, in order, from 0."""
    text = F.coalesce("text", F.lit(""))
    cut = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_text_keys(text), F.posexplode(F.split(text, "\n", -1)).alias("pos", "line"))
    keys = cut.select("doc_id", "t1", "t2", "pos", line_key(F.col("line")).alias("key"))
    lines = materialize(keys.where(F.length("key") >= min_chars).select("doc_id", "t1", "t2", "pos", *line_hash(F.col("key"))), "lines")
    # places bound documents from above, so few hashes are left for the exact count
    many = materialize(lines.groupBy(*KEY).agg(F.count("*").alias("n")).where(F.col("n") >= min_docs), "many")
    salts = _Salts(many, many.agg(F.sum("n")).first()[0] or 0)
    held = materialize(salts.deal(lines).join(salts.spread(many.select(*KEY)), [*KEY, "salt"], "left_semi"), "held")
    common = held.select("doc_id", *KEY).distinct().groupBy(*KEY).count().where(F.col("count") >= min_docs).select(*KEY)
    held = materialize(held.join(salts.spread(materialize(common, "common")), [*KEY, "salt"], "left_semi"), "common-lines")

    cuts = held.agg(F.percentile_approx("doc_id", [k / batches for k in range(1, batches)]).alias("cuts")).first()["cuts"] or []
    bounds = [None, *sorted(set(cuts), reverse=True), None]
    runs = LineRuns(fanout)
    for high, low in zip(bounds, bounds[1:], strict=False):
        inside = F.lit(True)
        if high is not None:
            inside = inside & (F.col("doc_id") <= high) if low is not None else (F.col("doc_id") <= high) | F.col("doc_id").isNull()
        if low is not None:
            inside = inside & (F.col("doc_id") > low)
        batch = held.where(inside).groupBy(*KEY).agg(F.max("doc_id").alias("keeper"))
        runs.add(runs.unseen(batch))
    gone = held.join(salts.spread(runs.all()), [*KEY, "salt"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return gone.groupBy("doc_id", "t1", "t2").agg(F.sort_array(F.collect_set("pos")).alias("places"))


def without(items: Column, places: Column) -> Column:
    """The items of an array that aren't at the places, sorted, from 0: the runs between them, so the time is linear."""
    after = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get(places, j - 1) + 1)
    until = lambda j: F.coalesce(F.get(places, j), F.size(items))
    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(places)), lambda j: F.slice(items, after(j) + 1, until(j) - after(j))))


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, batches: int = 4, fanout: int = 4) -> DataFrame:
    """The rows of docs with their other columns, text without dropped lines, and n_lines, n_dropped.

    A line's key has at least min_chars code points and lies in at least
    min_docs documents (rows with one doc_id are one document; null is the
    smallest doc_id) to be dropped everywhere but in the largest doc_id that
    holds it.  Null texts are empty ones: one empty line, kept.  An empty table
    stays empty.  Columns named n_lines or n_dropped are replaced, all others
    stay, whatever they are called.
    """
    drops = dropped_lines(docs, min_chars, min_docs, batches, fanout).withColumnsRenamed({"doc_id": "d", "t1": "u1", "t2": "u2"})
    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in rest]).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), *_text_keys(text))
    joined = rows.join(drops, rows["doc_id"].eqNullSafe(F.col("d")) & (F.col("t1") == F.col("u1")) & (F.col("t2") == F.col("u2")), "left")
    text = F.coalesce("row.text", F.lit(""))
    joined = joined.withColumn("lines", F.split(text, "\n", -1))
    kept = F.when(F.col("places").isNotNull(), F.array_join(without(F.col("lines"), F.col("places")), "\n")).otherwise(text)
    return joined.select(
        *[kept.alias("text") if c == "text" else F.col(f"row.`{c}`").alias(c) for c in rest],
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("places"), F.lit(0)).cast("long").alias("n_dropped"),
    )
