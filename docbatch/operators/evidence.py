"""From regions, readings and circles found on pages to the evidence that verdicts rest on."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Resolutions, thresholds of codes, rings and inks.
SCAN_DPI, COMPOSED_DPI = (100, 300), 200
SCAN_DEFAULT, COMPOSED_DEFAULT, SENSITIVITY = 0.74, 0.85, (0.55, 1.35)
UNREAD_REGULARITY, REGULARITY = 0.75, 0.62
RADIUS_MM, RING_MM = (3.5, 15), 4.0
BLUE_EXCESS, PALE_DARKNESS, BLACK_DARKNESS = 27, 60, 70


def clamp(value: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def page_scales(objects: DataFrame, scan_threshold: int = 74, threshold: int = 85) -> DataFrame:
    """objects (page, ord, left, bottom, right, top, px_w, px_h, page_w, page_h) to rows (page, dpi, scanned, sensitivity).

    The first image by ord that covers most of the page makes it a scan of the
    image's resolution; other pages are composed ones.
    """
    wide, tall = F.col("right") - F.col("left"), F.col("top") - F.col("bottom")
    covers = (wide > F.col("page_w") * 0.75) & (tall > F.col("page_h") * 0.65)
    dpi = F.greatest("px_w", "px_h") / F.greatest(wide, tall) * 72
    first = objects.groupBy("page").agg(F.min(F.when(covers, F.struct("ord", dpi.alias("dpi")))).alias("_first"))
    scanned = F.col("_first").isNotNull()
    share = F.when(scanned, F.lit(scan_threshold / 100 / SCAN_DEFAULT)).otherwise(F.lit(threshold / 100 / COMPOSED_DEFAULT))
    return first.select("page", F.when(scanned, clamp(F.col("_first.dpi"), *SCAN_DPI)).otherwise(F.lit(COMPOSED_DPI)).cast("double").alias("dpi"), scanned.alias("scanned"), clamp(share, *SENSITIVITY).alias("sensitivity"))


def page_box(box: dict[str, Column], rotated: Column, height: Column) -> list[Column]:
    """A box on the page from one on the page turned clockwise, where rotated."""
    turned = (box["y0"], height - 1 - box["x1"], box["y1"], height - 1 - box["x0"])
    return [F.when(rotated, t).otherwise(b).alias(c) for (c, b), t in zip(box.items(), turned, strict=True)]


def in_points(box: dict[str, Column], dpi: Column) -> list[Column]:
    """A box in points (72 to the inch) from one in the pixels of a page drawn at dpi."""
    return [(c / (dpi / 72)).alias(name) for name, c in box.items()]


def heading_strips(regions: DataFrame) -> DataFrame:
    """regions (…, x0, y0, x1, y1, read, reversed, width, height) with the bands beside them: ord, below, left, top, right, bottom.

    A read region has its heading above the bars, or below when it is reversed;
    others are looked at above, then below, each at two depths.
    """
    side = lambda below, at: [F.struct(F.lit(at + k).alias("ord"), F.lit(below).alias("below"), F.lit(depth).alias("depth")) for k, depth in enumerate((0.65, 1.1))]
    above, below, both = F.array(*side(False, 0)), F.array(*side(True, 0)), F.array(*side(False, 0), *side(True, 2))
    rows = regions.withColumn("_s", F.explode(F.when(~F.col("read"), both).when(F.col("reversed"), below).otherwise(above)))
    wide, tall = F.col("x1") - F.col("x0"), F.greatest(F.col("y1") - F.col("y0"), F.lit(30))
    down = F.col("_s.below")
    top = F.when(down, F.col("y1") - 2).otherwise(F.greatest(F.lit(0), (F.col("y0") - tall * F.col("_s.depth")).cast("int")))
    bottom = F.when(down, F.least(F.col("height"), (F.col("y1") + tall * F.col("_s.depth")).cast("int"))).otherwise(F.col("y0") + 2)
    left, right = F.greatest(F.lit(0), (F.col("x0") - wide * 0.05).cast("int")), F.least(F.col("width"), (F.col("x1") + wide * 0.05).cast("int"))
    return rows.select(*regions.columns, F.col("_s.ord").alias("ord"), down.alias("below"), left.alias("left"), top.alias("top"), right.alias("right"), bottom.alias("bottom"))


def first_heading_hit(strips: DataFrame, keys: list[str]) -> DataFrame:
    """Per region the first strip, by ord, in which a heading was recognised."""
    hit = F.min(F.when(F.col("confidence") > 0, F.struct("ord", "confidence", "left", "top", "right", "bottom"))).alias("_hit")
    return strips.groupBy(*keys).agg(hit).select(*keys, F.coalesce("_hit.confidence", F.lit(0.0)).alias("confidence"), *[F.col(f"_hit.{c}").alias(c) for c in ("left", "top", "right", "bottom")])


def region_filter(components: DataFrame) -> DataFrame:
    """components (w, h, dpi, regularity, bar_share, read) with region: keep, split (to be cut into blocks first) or drop."""
    tall = F.greatest(F.lit(8), (F.col("dpi") * 0.12).cast("int"))
    large = (F.col("w") >= F.col("dpi") * 0.5) & (F.col("h") >= tall)
    odd = (F.col("w") / F.col("h") < 1.5) | (F.col("h") > F.col("dpi") * 1.5)
    bars = (F.col("regularity") >= REGULARITY) & (F.col("bar_share") > 0.2) & (F.col("bar_share") < 0.8)
    likely = F.col("read") | (F.col("regularity") >= UNREAD_REGULARITY)
    return components.withColumn("region", F.when(~large, "drop").when(odd, "split").when(bars & likely, "keep").otherwise("drop"))


def blob_filter(blobs: DataFrame) -> DataFrame:
    """blobs (x, y, w, h, mm: pixels in a millimetre) of a stamp's size, with cx, cy, r."""
    r = F.greatest("w", "h") / 2
    sized = r.between(F.col("mm") * RADIUS_MM[0], F.col("mm") * RADIUS_MM[1]) & (F.col("w") / F.col("h")).between(0.6, 1.6)
    return blobs.where(sized).withColumns({"cx": F.col("x") + F.col("w") / 2, "cy": F.col("y") + F.col("h") / 2, "r": r})


def ring_plausible(s: Column, mm: Column) -> Column:
    """Whether ring features are those of a stamp at sensitivity s."""
    c = F.col
    ring = (c("cover") >= s * 0.45) & (c("prominence") >= s * 0.42) & (c("arcs") >= 0.55) & (c("sectors") >= 5) & c("interior").between(0.15, 0.9) & (c("radius") >= mm * RING_MM)
    thick = c("from_patch") & (c("mask") < 2) & (c("cover") >= 0.6) & (c("sectors") >= 7)
    return ring & ((c("thickness") <= 0.35) | thick)


def best_ring(readings: DataFrame, keys: list[str], s: Column, mm: Column) -> DataFrame:
    """readings (keys, mask, present, r and ring features): per candidate the best mask's, with plausible and score.

    Masks after the first count when they hold enough ink, and only where the
    first shows some ring that isn't plausible yet; the earlier mask wins ties.
    """
    rows = readings.withColumn("plausible", ring_plausible(s, mm)).withColumn("score", F.col("prominence") + F.col("cover") * 0.5)
    order = Window.partitionBy(*keys).orderBy(F.desc("plausible"), F.desc("score"), "mask")
    # over the whole candidate, in the order that row_number needs too: one sort serves both
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first = F.max(F.when(F.col("mask") == 0, (F.col("cover") < 0.3) | F.col("plausible"))).over(whole)
    rows = rows.withColumn("_ends", F.coalesce(first, F.lit(False)))
    rows = rows.where((F.col("mask") == 0) | (~F.col("_ends") & (F.col("present") >= F.lit(2 * math.pi * 0.4) * F.col("r")))).drop("_ends")
    return rows.withColumn("_at", F.row_number().over(order)).where("_at = 1").drop("_at")


def ink_class() -> Column:
    """Ink of a ring by blue_share, median_excess and dark; the first rule that holds decides."""
    bluish = F.col("blue_share") >= 0.5
    return F.when(bluish & (F.col("median_excess") >= BLUE_EXCESS), "blue").when(bluish & (F.col("dark") < PALE_DARKNESS), "pale_blue").when(F.col("dark") >= BLACK_DARKNESS, "black").otherwise("faint")


def stamp_accept(rings: DataFrame, s: Column, faint_blue_as_blue: bool = False) -> DataFrame:
    """Plausible rings with kind that are stamps, with kind, confidence, strength and pale; neutral ink has to show more."""
    c = F.col
    coloured = c("kind").isin("blue", "pale_blue")
    neutral = (c("cover") >= F.least(F.lit(1.0), s * 0.8)) & (c("prominence") >= s * 0.45) & (c("arcs") >= 0.8) & (c("sectors") >= 7) & (c("stroke") <= 0.2) & (c("parts") >= 3)
    limits = [c("cover") / 0.45, c("prominence") / 0.42]
    strength = F.when(coloured, F.least(*limits)).otherwise(F.least(*limits, c("cover") / 0.8, c("prominence") / 0.45))
    confidence = F.least(F.lit(1.0), F.least(F.lit(1.0), c("prominence") / 0.6) * 0.5 + c("cover") * 0.3 + c("arcs") * 0.2)
    pale = c("kind") == "pale_blue"
    kept = rings.where(c("plausible") & (coloured | neutral)).withColumns({"confidence": confidence, "strength": strength, "pale": pale})
    return kept.withColumn("kind", F.when(pale, "blue" if faint_blue_as_blue else "faint").otherwise(c("kind")))


def classify_reads(regions: DataFrame, reads: DataFrame) -> DataFrame:
    """regions (region, confidence of the heading), reads (region, value, score): rows (region, kind, value, score).

    Values of a region with a heading are reports, others are others; a heading
    without value is an unreadable report; a region without either gives none.
    """
    headed = F.col("confidence") > 0
    rows = regions.select("region", "confidence").join(reads.select("region", "value", "score"), "region", "left").where(headed | F.col("value").isNotNull())
    kind = F.when(~headed, "other").when(F.col("value").isNull(), "unreadable").otherwise("report")
    return rows.select("region", kind.alias("kind"), "value", F.when(headed, F.least("confidence", "score")).alias("score"))


def build_evidence(stamps: DataFrame, headings: DataFrame, reports: DataFrame) -> DataFrame:
    """Stamps (page, detail, strength, default), headings and reports (page, detail, confidence) as one list: page, ord, kind, box, detail, confidence.

    box is a struct (x0, y0, x1, y1), null where a table has none.
    """
    kind_of_box = "struct<x0:double,y0:double,x1:double,y1:double>"
    box = lambda rows: (F.col("box") if "box" in rows.columns else F.lit(None)).cast(kind_of_box).alias("box")
    part = lambda rows, ord_, kind, confidence: rows.select("page", F.lit(ord_).alias("ord"), F.lit(kind).alias("kind"), box(rows), "detail", confidence.alias("confidence"))
    found = part(stamps, 0, "stamp", F.least(F.lit(0.99), F.col("strength") * F.col("default")))
    return found.unionByName(part(headings, 1, "heading", F.col("confidence"))).unionByName(part(reports, 2, "barcode", F.col("confidence")))


def stacked_labels(regions: DataFrame) -> DataFrame:
    """regions (page, rotated, ord, x0, y0, x1, y1, read, reversed, confidence) with the confidence that a code directly under a headed one takes over.

    Regions found on the upright and on the turned page never meet.  They go by ord, so what one has taken over counts for those after it; the
    first headed region, by ord, that a region follows is the one.
    """
    fields = ["ord", "x0", "y0", "x1", "y1", "read", "reversed", "confidence"]
    page = regions.groupBy("page", "rotated").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("_r"))

    def follows(upper: Column, lower: Column) -> Column:
        gap = F.when(upper["reversed"], upper["y0"] - lower["y1"]).otherwise(lower["y0"] - upper["y1"])
        overlap = F.least(upper["x1"], lower["x1"]) - F.greatest(upper["x0"], lower["x0"])
        return gap.between(F.lit(0.0), (upper["y1"] - upper["y0"]) * 0.4) & (overlap >= F.least(upper["x1"] - upper["x0"], lower["x1"] - lower["x0"]) * 0.5)

    def step(now: Column, i: Column) -> Column:
        own = F.get(now, i)
        heads = F.filter(now, lambda u, j: (j != i) & u["read"] & (u["confidence"] > 0) & follows(u, own))
        taken = F.when((own["confidence"] == 0) & own["read"], F.coalesce(F.get(heads, F.lit(0))["confidence"], F.lit(0.0))).otherwise(own["confidence"])
        changed = F.struct(*[own[f].alias(f) for f in fields[:-1]], taken.alias("confidence"))
        return F.transform(now, lambda u, j: F.when(j == i, changed).otherwise(u))

    places = F.sequence(F.lit(0), F.size("_r") - 1)
    return page.select("page", "rotated", F.explode(F.aggregate(places, F.col("_r"), step)).alias("r")).select("page", "rotated", "r.*")


def merge_scanlines(reads: DataFrame, stride: int = 6) -> DataFrame:
    """reads (page, value, y, x0, x1, score) of single lines to symbols (page, value, x0, y0, x1, y1, score).

    By y, a reading joins the first symbol of its value nearby and moves its
    sides to its own; symbols of less than two lines go.
    """
    rows = reads.groupBy("page", "value").agg(F.sort_array(F.collect_list(F.struct("y", "x0", "x1", F.col("score").cast("double").alias("score")))).alias("_r"))
    symbol = lambda x0, y0, x1, y1, score: F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"), score.alias("score"))

    def step(found: Column, r: Column) -> Column:
        near = lambda s: (F.abs(s["x0"] - r["x0"]) < 8) & (F.abs(s["x1"] - r["x1"]) < 8) & (r["y"] - s["y1"] < max(stride * 3, 24))
        at = F.coalesce(F.array_position(F.transform(found, near), True), F.lit(0))
        joined = F.transform(found, lambda s, i: F.when(i + 1 == at, symbol(r["x0"], s["y0"], r["x1"], r["y"] + 1, F.least(s["score"], r["score"]))).otherwise(s))
        return F.when(at > 0, joined).otherwise(F.concat(found, F.array(symbol(r["x0"], r["y"], r["x1"], r["y"] + 1, r["score"]))))

    none = F.slice(F.transform("_r", lambda r: symbol(r["x0"], r["y"], r["x1"], r["y"] + 1, r["score"])), 1, 0)
    found = rows.select("page", "value", F.explode(F.aggregate("_r", none, step)).alias("s")).select("page", "value", "s.*")
    return found.where(F.col("y1") - F.col("y0") >= max(2, stride))
