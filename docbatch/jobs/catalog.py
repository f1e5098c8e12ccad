"""All queries of the library, with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from docbatch.functions.text import heading_line_distance, heading_text, natural_key, safe_filename, strip_distance
from docbatch.jobs import archive, batches, review
from docbatch.operators import grouping, queue, verdict
from docbatch.operators.order import places
from docbatch.sources import fixtures


def _analysed(spark, sf_dir):
    """Detections dealt by source once: the roll-up by page and all that follows by source need no other shuffle."""
    pages = verdict.stamp_rule(verdict.page_verdict(verdict.page_evidence(fixtures.detections(spark, sf_dir).repartition("source"))))
    return pages.withColumns({"number": F.col("barcode"), "effective_state": F.col("state")})


def _decided(spark, sf_dir):
    return fixtures.conversation_pages(spark, sf_dir).withColumnsRenamed({"barcode": "number", "state": "effective_state"})


def page_verdicts(spark, sf_dir):
    pages = _analysed(spark, sf_dir)
    return pages.select("source", "idx", "stamp", "target_found", "barcode", F.array_join("other_barcodes", ",").alias("other_barcodes"), "state", "reason", "first_page_error")


def split_shared(spark, sf_dir):
    return grouping.document_sizes(_analysed(spark, sf_dir), "shared")


def split_sequential(spark, sf_dir):
    return grouping.document_sizes(_analysed(spark, sf_dir), "sequential")


def split_decided(spark, sf_dir):
    return grouping.document_sizes(_decided(spark, sf_dir), "shared")


def loose_pages(spark, sf_dir):
    return grouping.unassigned(_decided(spark, sf_dir))


def batch_summary(spark, sf_dir):
    """Sources of which some pages are not analysed yet."""
    pending = F.col("idx") >= 3 + F.substring("source", 6, 20).cast("long") % 5
    return grouping.summary(_decided(spark, sf_dir).withColumn("effective_state", F.when(pending, "pending").otherwise(F.col("effective_state"))))


def batch_problems(spark, sf_dir):
    return grouping.approval_problems(_decided(spark, sf_dir))


def batch_pauses(spark, sf_dir):
    return grouping.pause_points(_decided(spark, sf_dir))


def read_votes(spark, sf_dir):
    return verdict.read_vote(fixtures.reads(spark, sf_dir)).withColumn("score", F.round("score", 6))


def kept_stamps(spark, sf_dir):
    return verdict.distinct_stamps(fixtures.stamp_candidates(spark, sf_dir)).withColumn("kept_score", F.round("kept_score", 2))


def job_statuses(spark, sf_dir):
    return queue.transitions(fixtures.job_events(spark, sf_dir))


def file_fingerprints(spark, sf_dir):
    files = fixtures.file_observations(spark, sf_dir).withColumn("mtime_ns", F.col("poll").cast("long"))
    return queue.folder_labels(files, ["/in/9", "/in/1", "/in/3"]).select("poll", "path", "label", queue.fingerprint().alias("fingerprint"))


def unseen_files(spark, sf_dir):
    files = fixtures.file_observations(spark, sf_dir).withColumn("mtime_ns", F.lit(0).cast("long")).withColumn("fingerprint", queue.fingerprint())
    known = files.where("poll < 5")
    return queue.new_files(files.where("poll >= 5").select("path", "size", "fingerprint"), known)


def heading_matches(spark, sf_dir):
    """Strips with the least edits to the heading: every line of the whole texts, and one made of the heading per text."""
    rows = fixtures.strips(spark, sf_dir).select("text_id", "strip", heading_text(F.col("raw")).alias("text")).withColumn("distance", strip_distance(F.col("text")))
    return rows.withColumn("confidence", F.round(F.when(F.col("distance") <= 3, 1 - F.col("distance") / 17).otherwise(0.0), 6))


def heading_lines(spark, sf_dir):
    """The heading in any line of the whole texts."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("text_id"), heading_line_distance(F.col("text")).alias("distance"))
    return rows.withColumn("confidence", F.round(F.when(F.col("distance") <= 3, 1 - F.col("distance") / 17).otherwise(0.0), 6))


def page_filenames(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", safe_filename(F.col("url")).alias("name"))


def natural_ranks(spark, sf_dir):
    """The place of every part's number among all, in natural order."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_brand", F.concat(F.lit("No"), F.col("p_partkey").cast("string")).alias("number"))
    return places(part, natural_key(F.col("number")))


QUERIES = {
    f.__name__: f
    for f in (page_verdicts, split_shared, split_sequential, split_decided, loose_pages, batch_summary, batch_problems, batch_pauses, read_votes, kept_stamps, job_statuses, file_fingerprints, unseen_files, heading_matches, heading_lines, page_filenames, natural_ranks)
} | archive.QUERIES | review.QUERIES | batches.QUERIES

_DETECTIONS = """
d AS (SELECT 'scan-' || l_orderkey AS source, (l_linenumber - 1)::INT AS idx, l_partkey, l_suppkey, l_extendedprice,
  CASE WHEN l_returnflag = 'R' THEN 'blue' WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'black' WHEN l_returnflag = 'A' AND l_linestatus = 'O' THEN 'faint' END AS stamp,
  l_discount <= 0.06 AS headed, CASE WHEN l_discount <= 0.06 AND l_tax <= 0.06 THEN 'RR' || l_partkey END AS report, CASE WHEN l_discount > 0.06 THEN 'P' || l_suppkey END AS other FROM lineitem),
e AS (SELECT source, idx, bool_or(stamp = 'blue') AS blue, bool_or(stamp = 'black') AS black, bool_or(stamp = 'faint') AS faint, bool_or(headed) AS target_found,
  bool_or(headed AND report IS NULL) AS unreadable, count(DISTINCT report) AS n, min(report) AS one,
  list(report ORDER BY l_partkey, l_suppkey, l_extendedprice) FILTER (WHERE report IS NOT NULL) AS reports,
  list(other ORDER BY l_partkey, l_suppkey, l_extendedprice) FILTER (WHERE other IS NOT NULL) AS others FROM d GROUP BY source, idx),
s AS (SELECT *, CASE WHEN blue AND (black OR faint) THEN 'mixed' WHEN black THEN 'black' WHEN faint THEN 'faint' WHEN blue THEN 'blue' ELSE 'none' END AS stamp FROM e),
v AS (SELECT *, CASE WHEN n = 1 THEN one ELSE '' END AS barcode, idx = 0 AND NOT target_found AND stamp = 'none' AS first_page_error,
  CASE WHEN idx = 0 AND NOT target_found AND stamp = 'none' THEN 'first_page' WHEN n > 1 THEN 'multiple_numbers' WHEN unreadable AND n = 0 THEN 'unreadable' WHEN n > 0 AND stamp = 'blue' THEN 'blue' WHEN n > 0 THEN 'stamp_' || stamp ELSE 'following' END AS reason FROM s),
p AS (SELECT *, CASE WHEN reason = 'blue' THEN 'cover' WHEN reason = 'following' THEN 'attachment' ELSE 'review' END AS state FROM v)"""

_CONV = """
p AS (SELECT 'conv-' || conv_id AS source, turn::INT AS idx, CASE WHEN length(text) % 13 = 0 THEN '' ELSE 'N' || length(text) END AS barcode,
  CASE WHEN role = 'system' OR turn = 0 OR length(text) % 5 = 0 THEN 'cover' WHEN length(text) % 11 = 0 THEN 'review' ELSE 'attachment' END AS state FROM conversations)"""

_PENDING = _CONV.replace("p AS", "a AS", 1) + ", p AS (SELECT source, idx, barcode, CASE WHEN idx >= 3 + substring(source, 6)::BIGINT % 5 THEN 'pending' ELSE state END AS state FROM a)"

_RUNS = """
k AS (SELECT source, idx, barcode AS number, state, CASE WHEN state = 'cover' AND barcode <> '' THEN 'C' WHEN state = 'attachment' THEN 'A' ELSE 'B' END AS kind FROM p),
b AS (SELECT *, {start} AS start FROM (SELECT *, lag(kind) OVER w AS before FROM k WINDOW w AS (PARTITION BY source ORDER BY idx))),
r AS (SELECT *, sum(start::INT) OVER w AS run, last_value(CASE WHEN kind <> 'A' THEN kind END IGNORE NULLS) OVER (PARTITION BY source ORDER BY idx ROWS UNBOUNDED PRECEDING) AS anchor FROM b WINDOW w AS (PARTITION BY source ORDER BY idx)),
m AS (SELECT source, idx AS cover_idx, number, idx AS page_idx FROM r WHERE kind = 'C'
  UNION ALL SELECT c.source, c.idx, c.number, a.idx FROM r c JOIN r a ON c.source = a.source AND c.run = a.run WHERE c.kind = 'C' AND a.kind = 'A' AND a.anchor = 'C')"""
_SHARED, _SEQUENTIAL = _RUNS.format(start="kind = 'C' AND before IS DISTINCT FROM 'C'"), _RUNS.format(start="kind = 'C'")
_SIZES = " SELECT source, cover_idx, number, count(*) AS n_pages, min(page_idx) AS first_page, max(page_idx) AS last_page FROM m GROUP BY source, cover_idx, number"
_LOOSE = "(kind = 'B' OR (kind = 'A' AND anchor IS DISTINCT FROM 'C'))"
_FILES = """
f AS (SELECT datediff('day', DATE '2024-01-01', ts::DATE) AS poll, user_id, arg_max(value, (ts, event_id)) AS value FROM events GROUP BY 1, 2),
o AS (SELECT poll, '/in/' || (user_id % 3 + 1) || '/f' || user_id || '.pdf' AS path, user_id, floor(value)::BIGINT % 3 AS size FROM f)"""

ORACLES = {
    "page_verdicts": f"WITH {_DETECTIONS} SELECT source, idx, stamp, target_found, barcode, array_to_string(list_filter(coalesce(others, []), lambda x, i: list_position(others, x) = i AND NOT list_contains(coalesce(reports, []), x)), ',') AS other_barcodes, state, reason, first_page_error FROM p",
    "split_shared": f"WITH {_DETECTIONS}, {_SHARED}{_SIZES}",
    "split_sequential": f"WITH {_DETECTIONS}, {_SEQUENTIAL}{_SIZES}",
    "split_decided": f"WITH {_CONV}, {_SHARED}{_SIZES}",
    "loose_pages": f"WITH {_CONV}, {_SHARED} SELECT source, idx, state AS effective_state, number FROM r WHERE {_LOOSE}",
    "batch_summary": f"""WITH {_PENDING}, {_SHARED} SELECT source, count(*) AS pages, count(*) FILTER (WHERE state = 'cover') AS covers, count(*) FILTER (WHERE state = 'review' OR state = 'cover' AND number = '') AS needs_review,
  count(*) FILTER (WHERE kind = 'C') AS documents, count(*) FILTER (WHERE kind = 'A' AND anchor IS DISTINCT FROM 'C') AS loose,
  count(*) FILTER (WHERE state = 'pending') AS pending, count(*) FILTER (WHERE state <> 'pending') AS analysed, count(*) FILTER (WHERE f IS NULL OR seen = 0 OR idx < cut) AS ready FROM
  (SELECT *, max(idx) FILTER (WHERE state = 'cover' AND prior IS DISTINCT FROM 'cover' AND idx < f) OVER (PARTITION BY source) AS cut FROM
  (SELECT *, lag(state) OVER (PARTITION BY source ORDER BY idx) AS prior, min(idx) FILTER (WHERE state = 'pending') OVER (PARTITION BY source) AS f, count(*) FILTER (WHERE state <> 'pending') OVER (PARTITION BY source) AS seen FROM r)) GROUP BY source""",
    "batch_problems": f"""WITH {_CONV}, {_SHARED},
i AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY idx) AS id, CASE WHEN {_LOOSE} THEN CASE state WHEN 'pending' THEN 1 WHEN 'review' THEN 2 WHEN 'cover' THEN 3 ELSE 4 END END AS w FROM r),
g AS (SELECT *, min(w) OVER (PARTITION BY source) AS f FROM i),
h AS (SELECT source, min(f) AS f, count(*) FILTER (WHERE w = f) AS n_pages, count(*) FILTER (WHERE kind = 'C') AS docs, coalesce(list(id ORDER BY id) FILTER (WHERE w = f), []) AS ids FROM g GROUP BY source)
SELECT source, CASE WHEN f IS NOT NULL THEN ['pending', 'review', 'cover_without_number', 'loose'][f] WHEN docs = 0 THEN 'no_documents' ELSE '' END AS problem, n_pages, array_to_string(ids[1:8], ',') AS page_ids, len(ids) > 8 AS truncated FROM h""",
    "batch_pauses": f"""WITH {_CONV}, w AS (SELECT *, lag(state) OVER (PARTITION BY source ORDER BY idx) AS before, max(idx) OVER (PARTITION BY source) AS last FROM p)
SELECT source, min(idx) FILTER (WHERE idx < last AND (state = 'cover' AND before = 'attachment' OR state = 'review' OR state = 'cover' AND barcode = '')) AS pause_idx FROM w GROUP BY source""",
    "read_votes": """WITH k AS (SELECT l_orderkey AS region, l_linenumber % 4 AS attempt, 'V' || (l_suppkey % 3) AS value, count(*) AS n, min(l_partkey) AS x0, max(l_partkey + 100) AS x1, round(min(1 - l_discount), 6) AS score FROM lineitem GROUP BY 1, 2, 3 HAVING count(*) >= 2)
SELECT * FROM k WHERE attempt = (SELECT min(attempt) FROM k j WHERE j.region = k.region)""",
    "kept_stamps": """WITH RECURSIVE c AS (SELECT l_orderkey AS page, l_quantity * 8 AS cx, l_partkey % 400 AS cy, 20 + l_suppkey % 10 AS r, l_extendedprice::DOUBLE AS score,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_linenumber, l_partkey, l_suppkey) AS i, count(*) OVER (PARTITION BY l_orderkey) AS n FROM lineitem),
g AS (SELECT page, 1 AS i, n, [{'x': cx::DOUBLE, 'y': cy::DOUBLE, 'r': r::DOUBLE}] AS kept, score AS total FROM c WHERE i = 1
  UNION ALL SELECT g.page, c.i, g.n, CASE WHEN near THEN kept ELSE list_append(kept, {'x': c.cx::DOUBLE, 'y': c.cy::DOUBLE, 'r': c.r::DOUBLE}) END, CASE WHEN near THEN total ELSE total + c.score END
  FROM (SELECT g.*, c.cx, c.cy, c.r, c.score, c.i AS ci, len(list_filter(kept, lambda k: sqrt((k.x - c.cx) * (k.x - c.cx) + (k.y - c.cy) * (k.y - c.cy)) < 0.8 * greatest(k.r, c.r))) > 0 AS near FROM g JOIN c ON c.page = g.page AND c.i = g.i + 1) AS x(page, i, n, kept, total, cx, cy, r, score, ci, near), LATERAL (SELECT x.page, x.n) AS g(page, n), LATERAL (SELECT x.ci AS i, x.cx, x.cy, x.r, x.score) AS c)
SELECT page, n AS n_candidates, len(kept) AS n_kept, round(total, 2) AS kept_score FROM g WHERE i = n""",
    "file_fingerprints": f"WITH {_FILES} SELECT poll, path, 'Tarama_' || CASE user_id % 3 WHEN 2 THEN 3 ELSE 2 END AS label, sha256(path || '|(' || size || ', ' || poll || ')') AS fingerprint FROM o",
    "unseen_files": f"WITH {_FILES} SELECT DISTINCT path, size, sha256(path || '|(' || size || ', 0)') AS fingerprint FROM o WHERE poll >= 5 AND (path, size) NOT IN (SELECT (path, size) FROM o WHERE poll < 5)",
    "job_statuses": """WITH RECURSIVE e AS (SELECT user_id || '-' || floor(datediff('day', DATE '2024-01-01', ts::DATE) / 3)::BIGINT AS job,
  CASE event_type WHEN 'view' THEN 'analyzing' WHEN 'click' THEN 'review' WHEN 'purchase' THEN 'exporting' WHEN 'signup' THEN 'done' WHEN 'error' THEN 'dismissed' END AS target, ts, event_id FROM events),
o AS (SELECT job, target, row_number() OVER (PARTITION BY job ORDER BY ts, event_id, target) AS i, count(*) OVER (PARTITION BY job) AS n FROM e),
g AS (SELECT DISTINCT job, 0::BIGINT AS i, n, 'queued' AS status, 0::BIGINT AS applied FROM o
  UNION ALL SELECT job, i, n, CASE WHEN ok THEN target ELSE status END, applied + ok::BIGINT FROM (SELECT o.job, o.i, o.n, o.target, g.status, g.applied,
    CASE o.target WHEN 'analyzing' THEN g.status = 'queued' WHEN 'review' THEN g.status IN ('analyzing', 'exporting') WHEN 'exporting' THEN g.status IN ('review', 'analyzing') WHEN 'done' THEN g.status = 'exporting'
      WHEN 'dismissed' THEN g.status IN ('queued', 'analyzing', 'review', 'error') ELSE false END AS ok FROM g JOIN o ON o.job = g.job AND o.i = g.i + 1))
SELECT job, status, applied, n AS requested FROM g WHERE i = n""",
    "heading_matches": """WITH l AS (SELECT doc_id AS text_id, string_split_regex(coalesce(text, ''), '\\r\\n|\\r|\\n') AS lines, substring('RECEIVING REPORT NO', (1 + doc_id % 6)::INT) AS made FROM documents),
x AS (SELECT text_id, unnest(range(1, len(lines) + 2))::INT AS strip, unnest(list_append(lines, made)) AS raw FROM l),
t AS (SELECT text_id, strip, translate(regexp_replace(upper(regexp_replace(raw, '[^ -~]', '', 'g')), '[^A-Z0-9|!]', '', 'g'), '01L|!58', 'OIIIISB') AS text FROM x),
q AS (SELECT *, list_min(flatten([[levenshtein(substring(text, a, n), 'REPORTNO') FOR a IN range(1, length(text) + 1)] FOR n IN [7, 8, 9]])) AS tail,
  list_min(flatten([[levenshtein(substring(text, a, n), 'RECEIVINGREPORTNO') FOR a IN range(1, length(text) + 1)] FOR n IN range(14, 21)])) AS whole FROM t WHERE regexp_matches(text, 'REPO|RTNO')),
z AS (SELECT text_id, strip, text, CASE WHEN tail > 1 THEN 17 ELSE least(whole, 4) END AS distance FROM q UNION ALL SELECT text_id, strip, text, 17 FROM t WHERE NOT regexp_matches(text, 'REPO|RTNO'))
SELECT *, CASE WHEN distance <= 3 THEN round(1 - distance / 17, 6) ELSE 0.0 END AS confidence FROM z""",
    "page_filenames": r"""WITH n AS (SELECT page_id, substring(trim(regexp_replace(url, '[<>:"/\\|?*\x00-\x1f]', '_', 'g'), ' .'), 1, 100) AS t FROM pages)
SELECT page_id, CASE WHEN t <> '' THEN CASE WHEN regexp_matches(upper(split_part(t, '.', 1)), '^(CON|PRN|AUX|NUL|COM[1-9]|LPT[1-9])$') THEN '_' || t ELSE t END END AS name FROM n""",
    "natural_ranks": "SELECT p_brand, 'No' || p_partkey AS number, row_number() OVER (ORDER BY p_partkey) AS place FROM part",
}

ORACLES |= archive.oracles(_CONV, _SHARED, _LOOSE, _FILES, ORACLES["job_statuses"])
ORACLES |= review.oracles(_DETECTIONS, _CONV, _SHARED, ORACLES["batch_problems"], ORACLES["read_votes"])
ORACLES |= batches.oracles(_CONV, _SHARED, _LOOSE, ORACLES["batch_problems"])
