"""Reports over files, pages, chunks and sessions, each one declarative plan. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions import text as fx
from lumenframe.operators import events, layout, store
from lumenframe.queries import ALIGNED, CELLS, ORACLES, ORDER, RUNS, STEPS, page_cells, query, session_steps
from lumenframe.session import table

#: Fixed value: tokens of one reading of a document.
READING_TOKENS = 2500
#: Headings that a report is expected to fill, in order.
SLOTS = ("Scope", "Findings", "Recommendations", "Conclusion")
#: Longest name of a sheet, and the least gap between lines that begins a paragraph, in median line heights.
NAME_CHARS, PARAGRAPH_GAP = 31, 1.6


@query("""WITH f AS (SELECT source, filename, max(ingested_at) AS last FROM doc_files GROUP BY ALL), k AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY source ORDER BY last DESC, filename) <= 10)
    SELECT source, coalesce(string_agg(filename, ', ' ORDER BY last DESC, filename), 'none') AS hint FROM k GROUP BY 1""")
def recent_files_hint(spark, d):
    """The ten files of each source that were taken in last, as one line (a top-k report)."""
    files = table(spark, d, "doc_files").groupBy("source", "filename").agg(F.max("ingested_at").alias("last"))
    w = Window.partitionBy("source").orderBy(F.desc("last"), "filename")
    few = files.withColumn("place", F.row_number().over(w)).where("place <= 10")
    listed = few.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("place", "filename"))).alias("f"))
    return listed.select("source", F.coalesce(F.array_join(F.transform("f", lambda x: x["filename"]), ", "), F.lit("none")).alias("hint"))


@query(f"""WITH {CELLS}, l AS (SELECT doc_id, page, line_no, length(trim(line)) AS w FROM cut WHERE length(trim(line)) > 0), c AS (SELECT doc_id, page, w, count(*) AS n, min(line_no) AS first FROM l GROUP BY ALL)
    SELECT doc_id, page, (SELECT median(w) FROM l WHERE l.doc_id = c.doc_id AND l.page = c.page) AS median_width, arg_max(w, (n, -first)) AS usual_width FROM c GROUP BY ALL""")
def page_line_widths(spark, d):
    """Median and usual width (the first seen on ties) of each page's lines."""
    pages = table(spark, d, "doc_pages").where("text is not null").select("doc_id", "page", "text").distinct()
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).withColumn("w", F.length(F.trim("line"))).where("w > 0")
    counts = lines.groupBy("doc_id", "page", "w").agg(F.count("*").alias("n"), F.min("line_no").alias("first"))
    usual = counts.groupBy("doc_id", "page").agg(F.max_by("w", F.struct("n", -F.col("first"))).alias("usual_width"))
    return lines.groupBy("doc_id", "page").agg(F.median("w").alias("median_width")).join(usual, ["doc_id", "page"])


@query("""SELECT source, count(DISTINCT id) AS files, sum(pages) AS pages, round(sum(ingest_ms) / sum(pages), 3) AS ms_per_page, round(avg(ingest_ms / pages) FILTER (WHERE scanned), 3) AS scanned_ms_per_page
    FROM (SELECT * FROM doc_files QUALIFY row_number() OVER (PARTITION BY id, source ORDER BY ingested_at DESC, ingest_ms DESC) = 1) WHERE pages > 0 GROUP BY 1""")
def ingest_profile(spark, d):
    """Cost of taking files in, by source, of each file's last registration."""
    files = store.latest(table(spark, d, "doc_files").select("id", "source", "pages", "ingest_ms", "ingested_at", "scanned"), ["id", "source"], ["ingested_at", "ingest_ms"]).where("pages > 0")
    each = F.col("ingest_ms") / F.col("pages")
    return files.groupBy("source").agg(F.count_distinct("id").alias("files"), F.sum("pages").alias("pages"), F.round(F.sum("ingest_ms") / F.sum("pages"), 3).alias("ms_per_page"), F.round(F.avg(F.when(F.col("scanned"), each)), 3).alias("scanned_ms_per_page"))


@query("""SELECT id, count(*) AS registrations, CASE WHEN count(sha256) = 0 THEN 'unpinned' WHEN count(DISTINCT sha256) > 1 THEN 'changed' WHEN count(sha256) < count(*) THEN 'partly' ELSE 'same' END AS checksum FROM doc_files GROUP BY 1""")
def checksum_report(spark, d):
    """Do a file's registrations agree on its checksum?"""
    n = table(spark, d, "doc_files").groupBy("id").agg(F.count("*").alias("registrations"), F.count("sha256").alias("pinned"), F.count_distinct("sha256").alias("sums"))
    state = F.when(F.col("pinned") == 0, "unpinned").when(F.col("sums") > 1, "changed").when(F.col("pinned") < F.col("registrations"), "partly").otherwise("same")
    return n.select("id", "registrations", state.alias("checksum"))


@query("SELECT c.doc_id, count(*) AS chunks, bool_or(f.id IS NULL) AS unregistered, bool_or(c.page_end < c.page) AS reversed FROM chunks c LEFT JOIN (SELECT DISTINCT id FROM doc_files) f ON c.doc_id = f.id GROUP BY 1")
def provenance_gaps(spark, d):
    """Chunks by file, and whether any lacks its file or ends before it begins."""
    known = table(spark, d, "doc_files").select(F.col("id").alias("doc_id"), F.lit(True).alias("known")).distinct()
    c = table(spark, d, "chunks").select("doc_id", "page", "page_end").join(known, "doc_id", "left")
    return c.groupBy("doc_id").agg(F.count("*").alias("chunks"), F.bool_or(F.col("known").isNull()).alias("unregistered"), F.bool_or(F.col("page_end") < F.col("page")).alias("reversed"))


@query("SELECT doc_id, section, max(page) AS last_page, count(*) AS chunks FROM chunks WHERE section <> '' GROUP BY 1, 2")
def section_last_pages(spark, d):
    return table(spark, d, "chunks").where("section <> ''").groupBy("doc_id", "section").agg(F.max("page").alias("last_page"), F.count("*").alias("chunks"))


SLOT_KEYS = ", ".join(f"('{s.lower()}', {i})" for i, s in enumerate(SLOTS))


@query(rf"""WITH s(slot, nth) AS (VALUES {SLOT_KEYS}), c AS (SELECT doc_id, section, min(chunk_index) AS first FROM chunks WHERE section <> '' GROUP BY ALL), m AS (SELECT doc_id, section, first, regexp_replace(lower(section), '[^\p{{L}}\p{{N}}]', '', 'g') AS slot FROM c),
    w AS (SELECT m.*, s.nth, row_number() OVER (PARTITION BY doc_id, s.slot ORDER BY first, section) AS k FROM m LEFT JOIN s ON m.slot = s.slot) SELECT doc_id, section, CASE WHEN nth IS NOT NULL AND k = 1 THEN nth END AS slot_no FROM w""")
def slot_matches(spark, d):
    """A file's sections against the slots of a report: the first section of a slot's heading fills it, the others and
    those of no slot are left over (null)."""
    slots = spark.createDataFrame([(s.lower(), i) for i, s in enumerate(SLOTS)], "slot string, nth int")
    own = table(spark, d, "chunks").where("section <> ''").groupBy("doc_id", "section").agg(F.min("chunk_index").alias("first"))
    told = own.withColumn("slot", fx.heading_key(F.col("section"))).join(F.broadcast(slots), "slot", "left")
    w = Window.partitionBy("doc_id", "slot").orderBy("first", "section")
    return told.withColumn("k", F.row_number().over(w)).select("doc_id", "section", F.when(F.col("k") == 1, F.col("nth")).alias("slot_no"))


@query(f"""WITH {RUNS}, l AS (SELECT DISTINCT doc_id, page, line_no FROM cells) SELECT l.doc_id, l.page, count(*) AS lines, count(t.table_no) AS in_tables FROM l LEFT JOIN tables t ON l.doc_id = t.doc_id AND l.page = t.page AND l.line_no BETWEEN t.first_line AND t.last_line GROUP BY 1, 2""")
def lines_in_tables(spark, d):
    """Lines of each page, and those whose centre lies inside a table's box."""
    placed = page_cells(spark, d)
    return lines_inside(placed, layout.table_runs(placed))


@query(ORACLES["lines_in_tables"].replace(RUNS, ALIGNED))
def lines_in_aligned_tables(spark, d):
    """The same for tables whose rows share columns."""
    placed = page_cells(spark, d)
    return lines_inside(placed, layout.aligned_tables(layout.set_in_columns(placed)))


def lines_inside(placed, runs):
    boxes = runs.select("doc_id", "page", "first_line", "last_line")
    held = boxes.groupBy("doc_id", "page").agg(F.collect_list(F.struct((F.col("first_line") * layout.LINE_HEIGHT - 2).alias("top"), (F.col("last_line") * layout.LINE_HEIGHT + 2).alias("bottom"))).alias("boxes"))
    lines = placed.groupBy("doc_id", "page", "line_no").agg(F.first("mid_y").alias("mid_y")).join(held, ["doc_id", "page"], "left")
    inside = F.coalesce(F.exists("boxes", lambda b: (F.col("mid_y") >= b["top"]) & (F.col("mid_y") <= b["bottom"])), F.lit(False))
    return lines.groupBy("doc_id", "page").agg(F.count("*").alias("lines"), F.count_if(inside).alias("in_tables"))


@query(f"""WITH {CELLS}, l AS (SELECT doc_id, page, line_no, line_no - lag(line_no) OVER (PARTITION BY doc_id, page ORDER BY line_no) AS gap FROM cut WHERE length(trim(line)) > 0)
    SELECT doc_id, page, count(*) AS lines, 1 + count(*) FILTER (WHERE gap > 1.6) AS paragraphs FROM l GROUP BY 1, 2""")
def gap_paragraphs(spark, d):
    """Paragraphs of each page by the gaps between its lines."""
    pages = table(spark, d, "doc_pages").where("text is not null").select("doc_id", "page", "text").distinct()
    lines = pages.select("doc_id", "page", F.posexplode(F.split("text", "\n")).alias("line_no", "line")).where(F.length(F.trim("line")) > 0)
    gap = (F.col("line_no") - F.lag("line_no").over(Window.partitionBy("doc_id", "page").orderBy("line_no"))) * layout.LINE_HEIGHT
    return lines.withColumn("gap", gap).groupBy("doc_id", "page").agg(F.count("*").alias("lines"), (1 + F.count_if(F.col("gap") > PARAGRAPH_GAP * layout.LINE_HEIGHT)).alias("paragraphs"))


@query("""WITH n AS (SELECT DISTINCT source, left(regexp_replace(filename, '[:\\\\/?*\\[\\]]', '-', 'g'), 31) AS base, id FROM doc_files WHERE filename IS NOT NULL), k AS (SELECT *, row_number() OVER (PARTITION BY source, lower(base) ORDER BY id) AS k FROM n)
    SELECT source, id, CASE WHEN k = 1 THEN base ELSE left(base, 31 - length('-' || k)) || '-' || k END AS sheet FROM k""")
def unique_sheet_names(spark, d):
    """A sheet name for each file, unique within its source whatever the case, in the order of ids."""
    f = table(spark, d, "doc_files").where("filename is not null").select("source", fx.sheet_name(F.col("filename")).alias("base"), "id").distinct()
    k = f.withColumn("k", F.row_number().over(Window.partitionBy("source", F.lower("base")).orderBy("id")))
    tail = F.concat(F.lit("-"), F.col("k").cast("string"))
    return k.select("source", "id", F.when(F.col("k") == 1, F.col("base")).otherwise(F.concat(F.left("base", NAME_CHARS - F.length(tail)), tail)).alias("sheet"))


@query(f"""WITH {STEPS} SELECT session_id, id, last_value(CASE WHEN speaker = 'assistant' AND starts_with(content, 'Calling ') THEN id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY sec, id, content NULLS FIRST ROWS UNBOUNDED PRECEDING) AS call_id, speaker FROM steps QUALIFY speaker = 'tool'""")
def tool_step_calls(spark, d):
    """The last call before each tool step of a session."""
    w = events.in_session().rowsBetween(Window.unboundedPreceding, 0)
    call = F.when((F.col("speaker") == "assistant") & F.col("content").startswith("Calling "), F.col("id"))
    return session_steps(spark, d).withColumn("call_id", F.last(call, ignorenulls=True).over(w)).where("speaker = 'tool'").select("session_id", "id", "call_id", "speaker")


@query(f"WITH {STEPS} SELECT time_bucket(INTERVAL 1 HOUR, CAST(make_timestamp(sec * 1000000) AS TIMESTAMP)) AS hour, speaker, count(*) AS steps FROM steps GROUP BY 1, 2")
def hourly_steps(spark, d):
    """Steps an hour and speaker (event-time windows)."""
    rows = session_steps(spark, d).withColumn("time", F.timestamp_seconds("at"))
    return rows.groupBy(F.window("time", "1 hour")["start"].cast("timestamp_ntz").alias("hour"), "speaker").agg(F.count("*").alias("steps"))


@query(f"WITH {STEPS} SELECT speaker IN ('user', 'assistant', 'tool', 'system') AS known, count(*) AS steps, count(DISTINCT session_id) AS sessions FROM steps GROUP BY 1")
def known_speakers(spark, d):
    """Steps whose speaker can be told, and those set aside."""
    return session_steps(spark, d).groupBy((F.col("speaker") != "unknown").alias("known")).agg(F.count("*").alias("steps"), F.count_distinct("session_id").alias("sessions"))


@query("""WITH r AS (SELECT DISTINCT rec_id, answer, stop FROM redteam_results) SELECT rec_id, left(coalesce(nullif(answer, ''), stop, ''), 200) AS summary, CASE WHEN length(answer) > 120 THEN left(answer, 120) || chr(10) || '[cut at 30 tokens]' ELSE answer END AS content FROM r""")
def result_summaries(spark, d):
    """The first 200 characters of each result or, failing that, why it stopped; and the result cut to thirty tokens."""
    r = table(spark, d, "redteam_results").select("rec_id", "answer", "stop").distinct()
    cut = F.when(F.length("answer") > 120, F.concat(F.left("answer", F.lit(120)), F.lit("\n[cut at 30 tokens]"))).otherwise(F.col("answer"))
    return r.select("rec_id", F.left(F.coalesce(F.nullif(F.col("answer"), F.lit("")), F.col("stop"), F.lit("")), F.lit(200)).alias("summary"), cut.alias("content"))


@query(f"""WITH p AS (SELECT DISTINCT doc_id, page, CASE WHEN length(text) = 0 THEN 0 ELSE CAST(floor(length(text) / 3.4) AS BIGINT) + 1 END AS tokens FROM doc_pages WHERE text IS NOT NULL)
    SELECT doc_id, page, tokens, sum(tokens) OVER (PARTITION BY doc_id ORDER BY page ROWS UNBOUNDED PRECEDING) <= {READING_TOKENS} AS shown FROM p""")
def reading_plan(spark, d):
    """Which pages of a file one reading shows: those up to which its tokens stay within the budget."""
    p = table(spark, d, "doc_pages").where("text is not null").select("doc_id", "page", fx.count_tokens(F.col("text")).alias("tokens"), F.xxhash64("text").alias("h")).distinct()
    w = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    return p.withColumn("shown", F.sum("tokens").over(w) <= READING_TOKENS).select("doc_id", "page", "tokens", "shown")


@query(r"""SELECT source, count(*) AS texts, count(*) FILTER (WHERE regexp_matches(text, 'https?://[^ \t\n]+|\bwww\.[a-z0-9.-]+')) AS with_links, count(*) FILTER (WHERE contains(text, '```')) AS with_code, count(*) FILTER (WHERE length(trim(text)) >= 120) AS native FROM documents WHERE text IS NOT NULL GROUP BY 1""")
def text_scan(spark, d):
    """Texts with links, with code, and long enough to be native, by source."""
    t = table(spark, d, "documents").where("text is not null")
    return t.groupBy("source").agg(F.count("*").alias("texts"), F.count_if(F.col("text").rlike(r"https?://[^ \t\n]+|\bwww\.[a-z0-9.-]+")).alias("with_links"), F.count_if(F.contains("text", F.lit("```"))).alias("with_code"), F.count_if(F.length(F.trim("text")) >= 120).alias("native"))


@query("""WITH m AS (SELECT task_type, avg(updated_ts - created_ts) AS eta FROM sessions WHERE updated_ts IS NOT NULL GROUP BY 1)
    SELECT s.session_id, round(least(100.0, (s.updated_ts - s.created_ts) / greatest(m.eta, 1) * 100), 4) AS percent, s.updated_ts - s.created_ts > m.eta AS overdue FROM sessions s JOIN m ON s.task_type IS NOT DISTINCT FROM m.task_type WHERE s.updated_ts IS NOT NULL""")
def session_progress(spark, d):
    """Each session's time as a share of what its task type takes on the whole."""
    s = table(spark, d, "sessions").where("updated_ts is not null").withColumn("took", F.col("updated_ts") - F.col("created_ts"))
    eta = s.groupBy(F.col("task_type").alias("kind")).agg(F.avg("took").alias("eta"))
    both = s.join(eta, F.col("task_type").eqNullSafe(F.col("kind")))
    percent = F.least(F.lit(100.0), F.col("took") / F.greatest(F.col("eta"), F.lit(1.0)) * 100)
    return both.select("session_id", F.round(percent, 4).alias("percent"), (F.col("took") > F.col("eta")).alias("overdue"))
