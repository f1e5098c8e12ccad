"""Queries of the archive, the label codes and the watched folders, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from docbatch.functions.codes import LETTERS, START, STOP, WIDTHS, code39_label, code128_check, code128_label, code128_text
from docbatch.operators import archive, labels, queue
from docbatch.sources import fixtures
from docbatch.sources.shared import dealt
from docbatch.streaming.watch import stable_files


def _read(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _decided(spark, sf_dir):
    return fixtures.conversation_pages(spark, sf_dir).withColumnsRenamed({"barcode": "number", "state": "effective_state"})


def _files(spark, sf_dir):
    return _read(spark, sf_dir, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string"), F.when(F.col("o_custkey") % 3 == 0, ".PDF").when(F.col("o_custkey") % 3 == 1, ".pdf").otherwise(".txt")).alias("path"), (F.col("o_orderkey") % 5).alias("n_pages"))


def listed_pages(spark, sf_dir):
    return archive.list_pages(_files(spark, sf_dir))


def saveable_pages(spark, sf_dir):
    pending = F.col("idx") >= 3 + F.substring("source", 6, 20).cast("long") % 5
    return archive.saveable_prefix(_decided(spark, sf_dir).withColumn("effective_state", F.when(pending, "pending").otherwise(F.col("effective_state"))))


def archive_statuses(spark, sf_dir):
    return archive.archive_gate(_decided(spark, sf_dir))


def claimed_names(spark, sf_dir):
    part = _read(spark, sf_dir, "part").select(F.col("p_brand").alias("folder"), F.col("p_name").alias("stem"), "p_partkey", "p_size")
    taken = part.where("p_size % 2 = 0").select("folder", "stem", F.lit(1).alias("number")).distinct()
    return archive.claim_names(part.drop("p_size"), taken, "p_partkey")


def committed_jobs(spark, sf_dir):
    rows = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("job"), F.concat(F.lit("p"), F.col("l_linenumber").cast("string")).alias("name"), "l_quantity")
    line = dealt(rows, "job").groupBy("job", "name").agg(F.max("l_quantity").cast("long").alias("size"))
    return archive.committed(line, line.where("size % 17 <> 0"))


def drifted_sources(spark, sf_dir):
    seen = fixtures.file_observations(spark, sf_dir)
    last = lambda rows: rows.groupBy(F.col("path").alias("source")).agg(F.max_by("size", "poll").alias("signature"))
    return archive.source_drift(last(seen.where("poll < 10")), last(seen.where("poll >= 10")))


def free_stamps(spark, sf_dir):
    stamps = fixtures.stamp_candidates(spark, sf_dir)
    x0, y0 = F.col("l_partkey") % 300, F.col("l_suppkey") % 200
    boxes = _read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), x0.alias("x0"), (x0 + 100).alias("x1"), y0.alias("y0"), (y0 + 150).alias("y1"))
    return archive.exclude_stamps(stamps, boxes).groupBy("page").agg(F.count("*").alias("n_stamps"))


def job_progress(spark, sf_dir):
    """The last reported pages of each job, of all it has."""
    return archive.progress(fixtures.job_events(spark, sf_dir).withColumns({"done": F.col("event_id") % 9, "total": F.lit(9) + F.col("event_id") % 4}))


def label_texts(spark, sf_dir):
    """Brand in set B and number in set C as symbol values, with their checksum and read back."""
    part = _read(spark, sf_dir, "part").select("p_partkey", "p_brand", F.lpad(F.col("p_partkey").cast("string"), 8, "0").alias("_d"))
    letters = F.transform(F.filter(F.split("p_brand", ""), lambda c: c != ""), lambda c: F.ascii(c) - 32)
    pairs = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.substring(F.col("_d"), i * 2 + 1, F.lit(2)).cast("int"))
    rows = part.withColumn("_v", F.concat(letters, F.array(F.lit(99)), pairs))
    return rows.select("p_partkey", code128_check(F.lit(START["B"]), F.col("_v")).alias("check_value"), code128_text(F.lit(START["B"]), F.col("_v")).alias("label"))


def _scanned(symbols, table):
    """Widths of symbols as a scan gives them: some pixels a module, every third bar or gap a little off."""
    pixels = 2 + F.col("p_partkey") % 4
    known = F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(float(c)) for c in v]))])
    return F.transform(symbols, lambda s: F.transform(known[s], lambda m, i: m * pixels + F.when(i % 3 == 0, 0.2).otherwise(0.0)))


def scanned_labels(spark, sf_dir):
    """Brands as Code 128 in set B and parts' numbers as Code 39, read from widths; every seventh checksum is wrong."""
    part = dealt(_read(spark, sf_dir, "part").select("p_partkey", "p_brand"), "p_partkey", rows_per_task=20_000)
    letters = F.transform(F.filter(F.split("p_brand", ""), lambda c: c != ""), lambda c: F.ascii(c) - 32)
    check = (code128_check(F.lit(START["B"]), letters) + F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0)) % 103
    inner = F.concat(F.array(F.lit(START["B"])), letters, F.array(check))
    stop = F.transform(F.array(F.lit(0)), lambda _: F.array(*[F.lit(float(c)) * 2 for c in STOP]))
    code128 = F.concat(_scanned(inner, dict(enumerate(WIDTHS))), stop)
    digits = F.filter(F.split(F.concat(F.lit("*"), F.col("p_partkey").cast("string"), F.lit("*")), ""), lambda c: c != "")
    code39 = _scanned(digits, {k: v.replace("n", "1").replace("w", "3") for k, v in LETTERS.items()})
    scans = part.select("p_partkey", code128.alias("code128"), code39.alias("code39"))
    return scans.select("p_partkey", code128_label(F.col("code128")).alias("brand"), code39_label(F.col("code39"))["text"].alias("number"))


def _label_rows(spark, sf_dir):
    """Rows across the labels of parts, five to each of two scales, upright and turned: brands as Code 128, numbers as Code 39 by p_size.

    Every fifth label is upside down, every seventh Code 128 checksum is wrong, every eleventh
    label is whole in only one row of the first scale; a strip of bars without a label stands before each.
    """
    part = dealt(_read(spark, sf_dir, "part").select("p_partkey", "p_brand", (F.col("p_size") % 2 == 0).alias("_code39")), "p_partkey", rows_per_task=5_000)
    letters = F.transform(F.filter(F.split("p_brand", ""), lambda c: c != ""), lambda c: F.ascii(c) - 32)
    check = (code128_check(F.lit(START["B"]), letters) + F.when(F.col("p_partkey") % 7 == 0, 1).otherwise(0)) % 103
    pixels = 2 + F.col("p_partkey") % 4
    wide = lambda table: F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.array(*[F.lit(int(c)) for c in v]))])
    symbols = F.concat(F.array(F.lit(START["B"])), letters, F.array(check))
    code128 = F.concat(F.flatten(F.transform(symbols, lambda s: wide(dict(enumerate(WIDTHS)))[s])), F.array(*[F.lit(int(c)) for c in STOP]))
    digits = F.filter(F.split(F.concat(F.lit("*"), F.col("p_partkey").cast("string"), F.lit("*")), ""), lambda c: c != "")
    spaced = F.flatten(F.transform(digits, lambda s: F.concat(wide({k: v.replace("n", "1").replace("w", "3") for k, v in LETTERS.items()})[s], F.array(F.lit(1)))))
    code39 = F.slice(spaced, 1, F.size(spaced) - 1)
    own = F.transform(F.when(F.col("_code39"), code39).otherwise(code128), lambda w: w * pixels)
    strip = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.lit(7) + i % 2)
    upright = F.concat(F.array(F.lit(0)), strip, F.array(F.lit(60)), own, F.array(F.lit(50)))
    seen = F.when(F.col("p_partkey") % 5 == 0, F.reverse(upright)).otherwise(upright)
    rows = part.select("p_partkey", seen.alias("_seen")).withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(3))))
    flipped, factor = F.col("attempt") % 2 == 1, F.when(F.col("attempt") < 2, 2).otherwise(3)
    turned = F.when(flipped, F.reverse("_seen")).otherwise(F.col("_seen"))
    whole = F.transform(turned, lambda w: (w * factor).cast("double"))
    width = F.aggregate("_seen", F.lit(0).cast("long"), lambda a, w: a + w) * factor
    rows = rows.select("p_partkey", "attempt", flipped.alias("flipped"), factor.alias("factor"), whole.alias("_whole"), width.alias("width")).withColumn("line", F.explode(F.sequence(F.lit(0), F.lit(4))))
    blurred = (F.col("p_partkey") % 11 == 0) & (F.col("attempt") < 2) & (F.col("line") > 0)
    runs = F.when(blurred, F.slice("_whole", 1, F.size("_whole") - 14)).otherwise(F.col("_whole"))
    return rows.select(F.col("p_partkey").alias("region"), "attempt", "line", "flipped", "width", "factor", (F.col("p_partkey") % 100).alias("left"), runs.alias("runs"), F.lit(False).alias("dark"))


def region_votes(spark, sf_dir):
    """What the rows across a label agree on, with its box on the page."""
    return labels.region_labels(labels.read_rows(_label_rows(spark, sf_dir))).select("region", "attempt", "value", "kind", "rows", "x0", "x1", "reversed")


def rejected_files(spark, sf_dir):
    return archive.list_rejects(_files(spark, sf_dir))


def restarted_jobs(spark, sf_dir):
    """The jobs as their requests leave them, after a restart; what is committed as for their numbers' orders."""
    jobs = queue.transitions(fixtures.job_events(spark, sf_dir)).select("job", "status")
    done = jobs.select("job", (F.length("job") % 2 == 0).alias("committed")).where("job like '1%'")
    return archive.recover(jobs, done)


def stable_arrivals(spark, sf_dir):
    return stable_files(fixtures.file_observations(spark, sf_dir).withColumn("mtime_ns", F.lit(0).cast("long")), 1)


QUERIES = {f.__name__: f for f in (listed_pages, saveable_pages, archive_statuses, claimed_names, committed_jobs, drifted_sources, free_stamps, job_progress, label_texts, scanned_labels, region_votes, rejected_files, restarted_jobs, stable_arrivals)}

#: stable_arrivals has state per path; tests/test_archive.py holds it against a plain loop.  heading_lines: see tests/test_whole.py.
WITHOUT_SQL = {"stable_arrivals", "heading_lines"}


def oracles(conv: str, shared: str, loose: str, files: str, statuses: str) -> dict[str, str]:
    """conv, shared, loose and files: the common parts of the catalog's SQL; statuses: the SQL of job_statuses."""
    return {
        "listed_pages": "WITH f AS (SELECT 'o' || o_orderkey || CASE o_custkey % 3 WHEN 0 THEN '.PDF' WHEN 1 THEN '.pdf' ELSE '.txt' END AS source, (o_orderkey % 5)::BIGINT AS n FROM orders) SELECT source, unnest(range(n))::INT AS idx FROM f WHERE lower(source) LIKE '%.pdf' AND n > 0",
        "saveable_pages": f"""WITH {conv}, q AS (SELECT source, idx, CASE WHEN idx >= 3 + substring(source, 6)::BIGINT % 5 THEN 'pending' ELSE state END AS state FROM p),
w AS (SELECT *, lag(state) OVER (PARTITION BY source ORDER BY idx) AS before, min(idx) FILTER (WHERE state = 'pending') OVER (PARTITION BY source) AS f, count(*) FILTER (WHERE state <> 'pending') OVER (PARTITION BY source) AS seen FROM q),
c AS (SELECT *, max(idx) FILTER (WHERE state = 'cover' AND before IS DISTINCT FROM 'cover' AND idx < f) OVER (PARTITION BY source) AS cut FROM w)
SELECT source, count(*) AS pages, count(*) FILTER (WHERE f IS NULL OR seen = 0 OR idx < cut) AS saveable FROM c GROUP BY source""",
        "archive_statuses": f"""WITH {conv}, {shared} SELECT source, count(*) FILTER (WHERE kind = 'C') AS documents, count(*) FILTER (WHERE {loose}) AS unassigned,
CASE WHEN count(*) FILTER (WHERE kind = 'C') > 0 AND count(*) FILTER (WHERE {loose}) = 0 THEN 'exporting' ELSE 'review' END AS status FROM r GROUP BY source""",
        "claimed_names": """WITH n AS (SELECT p_brand AS folder, p_name AS stem, p_partkey, row_number() OVER w + (count(*) FILTER (WHERE p_size % 2 = 0) OVER (PARTITION BY p_brand, p_name) > 0)::INT AS k FROM part WINDOW w AS (PARTITION BY p_brand, p_name ORDER BY p_partkey))
SELECT folder, stem, p_partkey, CASE WHEN k = 1 THEN stem WHEN k < 10 THEN stem || '_0' || k ELSE stem || '_' || k END AS name FROM n""",
        "committed_jobs": "WITH f AS (SELECT l_orderkey AS job, l_linenumber, max(l_quantity)::BIGINT AS size FROM lineitem GROUP BY 1, 2) SELECT job, count(*) AS files, bool_and(size % 17 <> 0) AS committed FROM f GROUP BY job",
        "drifted_sources": f"""WITH {files}, a AS (SELECT path, arg_max(size, poll) AS s FROM o WHERE poll < 10 GROUP BY path), b AS (SELECT path, arg_max(size, poll) AS s FROM o WHERE poll >= 10 GROUP BY path)
SELECT a.path AS source, a.s IS NOT NULL AND a.s IS DISTINCT FROM b.s AS drifted, b.path IS NULL AS missing FROM a LEFT JOIN b ON a.path = b.path""",
        "free_stamps": """SELECT l_orderkey AS page, count(*) AS n_stamps FROM lineitem s WHERE NOT EXISTS (SELECT 1 FROM lineitem b WHERE b.l_orderkey = s.l_orderkey AND s.l_quantity * 8 BETWEEN b.l_partkey % 300 AND b.l_partkey % 300 + 100
AND s.l_partkey % 400 BETWEEN b.l_suppkey % 200 AND b.l_suppkey % 200 + 150) GROUP BY l_orderkey""",
        "job_progress": """WITH e AS (SELECT user_id || '-' || floor(datediff('day', DATE '2024-01-01', ts::DATE) / 3)::BIGINT AS job, ts, event_id,
CASE event_type WHEN 'view' THEN 'analyzing' WHEN 'click' THEN 'review' WHEN 'purchase' THEN 'exporting' WHEN 'signup' THEN 'done' WHEN 'error' THEN 'dismissed' END AS target FROM events)
SELECT job, arg_max(event_id, (ts, event_id)) % 9 AS done, 9 + arg_max(event_id, (ts, event_id)) % 4 AS total, count(*) AS reports FROM e GROUP BY job""",
        "scanned_labels": "SELECT p_partkey, CASE WHEN p_partkey % 7 <> 0 THEN p_brand END AS brand, p_partkey::VARCHAR AS number FROM part",
        "region_votes": """WITH l AS (SELECT p_partkey AS region, p_size % 2 = 0 AS c39, p_partkey % 5 = 0 AS reversed, p_partkey % 11 = 0 AS dim, 2 + p_partkey % 4 AS px, p_brand, p_partkey::VARCHAR AS d FROM part WHERE p_size % 2 = 0 OR p_partkey % 7 <> 0),
w AS (SELECT *, px * CASE WHEN c39 THEN 16 * (length(d) + 2) - 1 ELSE 11 * (length(p_brand) + 2) + 13 END AS size FROM l)
SELECT region, ((CASE WHEN dim THEN 2 ELSE 0 END) + reversed::INT)::INT AS attempt, CASE WHEN c39 THEN d ELSE p_brand END AS value, CASE WHEN c39 THEN 'Code 39' ELSE 'Code 128' END AS kind, 5::BIGINT AS rows,
region % 100 + CASE WHEN reversed THEN 50 ELSE 128 END AS x0, region % 100 + CASE WHEN reversed THEN 50 ELSE 128 END + size AS x1, reversed FROM w""",
        "rejected_files": "SELECT 'o' || o_orderkey || CASE o_custkey % 3 WHEN 0 THEN '.PDF' ELSE '.pdf' END AS path, 0::BIGINT AS n_pages, 'no_pages' AS reason FROM orders WHERE o_custkey % 3 < 2 AND o_orderkey % 5 = 0",
        "restarted_jobs": f"SELECT job, CASE WHEN status = 'analyzing' THEN 'queued' WHEN status = 'exporting' THEN CASE WHEN job LIKE '1%' AND length(job) % 2 = 0 THEN 'done' ELSE 'review' END ELSE status END AS status FROM ({statuses})",
        "label_texts": """WITH d AS (SELECT p_partkey, p_brand, lpad(p_partkey::VARCHAR, 8, '0') AS d, length(p_brand) AS n FROM part),
s AS (SELECT *, 104 + list_sum([(ascii(p_brand[i::INT]) - 32) * i FOR i IN range(1, n + 1)]) + 99 * (n + 1) + list_sum([substring(d, i * 2 + 1, 2)::BIGINT * (n + 2 + i) FOR i IN range(0, 4)]) AS t FROM d)
SELECT p_partkey, (t % 103)::INT AS check_value, p_brand || d AS label FROM s""",
    }
