"""The pN_ queries: each applies one problem's operator to its whole tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm import conversations as conv
from lumenframe.llm import eval_leaks, pair_defects, percentiles, scan_noise, site_lines, template_residue, tokenize_corpus
from lumenframe.session import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_noise.findings(table(spark, sf_dir, "doc_pages"), table(spark, sf_dir, "doc_files"))
    return found.select("doc_id", "page", "line_no", "defect", "repaired").distinct()


def p1_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "doc_pages")
    return scan_noise.repaired_pages(pages, scan_noise.findings(pages, table(spark, sf_dir, "doc_files")))


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and other percentiles of both times, a model and task type, per day and over all days."""
    rows = table(spark, sf_dir, "bench_results").select("rec_id", "routed_model", "task_type", F.to_date("ts").alias("day"), "latency_ms", "ttft_ms").distinct()
    keys = ["routed_model", "task_type"]
    parts = percentiles.sketches(rows, [*keys, "day"], {"latency_ms": 0, "ttft_ms": 1})
    return percentiles.percentiles(parts, keys, over="day")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.rejected(table(spark, sf_dir, "messages"), table(spark, sf_dir, "sessions"))


def p3_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conv.conversations(table(spark, sf_dir, "messages"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By files, as TESTDATA defines the cases."""
    return site_lines.boilerplate(table(spark, sf_dir, "doc_pages"), table(spark, sf_dir, "doc_files"), **site_lines.FILES)


def p4_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By clusters of near-duplicate files and days, the method's own setting."""
    return site_lines.boilerplate(table(spark, sf_dir, "doc_pages"), table(spark, sf_dir, "doc_files"), similar=site_lines.SIMILAR, **site_lines.CLUSTERS)


def p4_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "doc_pages")
    return site_lines.without_lines(pages, site_lines.boilerplate(pages, table(spark, sf_dir, "doc_files")))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_defects.defective_pairs(table(spark, sf_dir, "redteam_results"))


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenize_corpus.encode_corpus(table(spark, sf_dir, "documents"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return eval_leaks.leaked_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "eval_items")).select("doc_id", "item_id")


def p7_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    leaks = eval_leaks.leaked_passages(documents, table(spark, sf_dir, "eval_items"))
    return eval_leaks.without_leaks(documents.select("doc_id", "source", "n_chars"), leaks)


def p7_clean_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``p7_clean`` with all columns of its documents."""
    documents = table(spark, sf_dir, "documents")
    return eval_leaks.without_leaks(documents, eval_leaks.leaked_passages(documents, table(spark, sf_dir, "eval_items")))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return template_residue.residue(table(spark, sf_dir, "documents"))


def p8_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return documents.join(template_residue.residue(documents), "doc_id", "left_anti")


QUERIES = {f.__name__: f for f in (p1_found, p1_pages, p2_percentiles, p3_found, p3_conversations, p4_found, p4_lines, p4_clean, p5_found, p6_ids, p7_found, p7_clean, p7_clean_documents, p8_found, p8_clean)}

#: One speaker a spelling; the characters that show nothing; times in milliseconds.
_P3_ROWS = r"""
rows AS (
  SELECT session_id, role, content, ts, min(id) AS id FROM messages
  WHERE session_id IS NOT NULL AND length(regexp_replace(content, '[\s\p{Z}\p{Cc}\p{Cf}\x{034F}\x{115F}\x{1160}\x{3164}\x{2800}\x{FFA0}\x{FE00}-\x{FE0F}]', '', 'g')) > 0
  GROUP BY ALL),
told AS (
  SELECT session_id, id, content, CASE WHEN ts >= 100000000000 THEN ts // 1000 ELSE ts END AS ts,
    CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user'
         WHEN lower(trim(role)) IN ('assistant', 'ai', 'bot', 'model') THEN 'assistant'
         WHEN lower(trim(role)) IN ('tool', 'function') THEN 'tool'
         WHEN lower(trim(role)) IN ('system', 'developer') THEN 'system' END AS speaker
  FROM rows),
said AS (
  SELECT *, lead(speaker) OVER (PARTITION BY session_id ORDER BY ts, id) AS following
  FROM told WHERE speaker IN ('user', 'assistant')),
judged AS (
  SELECT session_id, count(*) FILTER (WHERE speaker IS NULL OR speaker NOT IN ('system', 'tool')) AS spoken,
    bool_or(speaker IS NULL) AS unknown,
    arg_min(coalesce(speaker, '?'), (ts, id)) FILTER (WHERE speaker IS NULL OR speaker <> 'system') AS first_speaker
  FROM told GROUP BY session_id),
missing AS (SELECT DISTINCT session_id FROM said WHERE speaker = 'user' AND coalesce(following, 'user') = 'user'),
names AS (SELECT session_id FROM messages WHERE session_id IS NOT NULL UNION SELECT session_id FROM sessions WHERE session_id IS NOT NULL),
verdict AS (
  SELECT n.session_id, CASE WHEN j.session_id IS NULL OR j.spoken = 0 THEN 'empty'
      WHEN j.unknown OR coalesce(j.first_speaker, '?') <> 'user' THEN 'broken'
      WHEN m.session_id IS NOT NULL THEN 'missing_reply' END AS reason
  FROM names n LEFT JOIN judged j USING (session_id) LEFT JOIN missing m USING (session_id))
"""

#: Lines by what is left of them, and those that stand in enough of their source's files.
_P4_LINES = r"""
owners AS (SELECT DISTINCT id AS doc_id, source FROM doc_files WHERE id IS NOT NULL),
sizes AS (SELECT source, count(*) AS of_files FROM owners GROUP BY source),
cut AS (
  SELECT doc_id, page, generate_subscripts(parts, 1) AS line_no, unnest(parts) AS line
  FROM (SELECT DISTINCT doc_id, page, string_split(text, chr(10)) AS parts FROM doc_pages WHERE text IS NOT NULL)),
keyed AS (SELECT doc_id, page, line_no, trim(regexp_replace(lower(line), '[^\p{L}]+', ' ', 'g')) AS key FROM cut),
long_lines AS (SELECT k.*, o.source FROM keyed k JOIN owners o USING (doc_id) WHERE key <> '' AND length(key) - length(replace(key, ' ', '')) >= 4),
often AS (
  SELECT l.source, l.key FROM (SELECT source, key, count(DISTINCT doc_id) AS files FROM long_lines GROUP BY ALL) l
  JOIN sizes s ON l.source IS NOT DISTINCT FROM s.source WHERE l.files >= 5 AND l.files >= s.of_files * 0.1),
lines AS (
  SELECT DISTINCT l.doc_id, l.page, CAST(l.line_no AS INTEGER) AS line_no
  FROM long_lines l JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.key = o.key)
"""

#: Words of both sides, and the runs of 12 (or the whole of a shorter item) that they share.
_P7_PAIRS = r"""
said AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '[\x{00AD}\x{034F}\x{061C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180F}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{206F}\x{3164}\x{FE00}-\x{FE0F}\x{FEFF}\x{FFA0}\x{FFF9}-\x{FFFB}]', '', 'g')), '[\p{L}\p{N}]+') AS w FROM documents WHERE text IS NOT NULL),
asked AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM eval_items WHERE text IS NOT NULL),
parts AS (
  SELECT item_id, least(len(w), 12) AS n, unnest(list_transform(generate_series(1, greatest(len(w) - 11, 1)), lambda i: array_to_string(list_slice(w, i, i + 11), ' '))) AS run
  FROM asked WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM parts),
runs AS (
  SELECT doc_id, n, unnest(list_transform(generate_series(1, len(w) - n + 1), lambda i: array_to_string(list_slice(w, i, i + n - 1), ' '))) AS run
  FROM said, sizes WHERE len(w) >= n),
pairs AS (SELECT DISTINCT doc_id, item_id FROM runs JOIN parts USING (n, run))
"""

ORACLES = {
    "p3_found": f"WITH {_P3_ROWS} SELECT session_id, reason FROM verdict WHERE reason IS NOT NULL",
    "p4_found": f"WITH {_P4_LINES} SELECT doc_id, page, line_no FROM lines",
    "p4_clean": f"""WITH {_P4_LINES} SELECT c.doc_id, c.page, string_agg(c.line, chr(10) ORDER BY c.line_no) FILTER (WHERE l.line_no IS NULL) AS text
        FROM cut c LEFT JOIN lines l ON c.doc_id = l.doc_id AND c.page = l.page AND c.line_no = l.line_no GROUP BY c.doc_id, c.page""",
    "p7_found": f"WITH {_P7_PAIRS} SELECT doc_id, item_id FROM pairs",
    "p7_clean": f"WITH {_P7_PAIRS} SELECT doc_id, source, n_chars FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM pairs)",
}
