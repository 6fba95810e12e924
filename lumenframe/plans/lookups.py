"""Small operators over the given tables, each one declarative plan. Importing this module registers their queries."""

from __future__ import annotations

import uuid

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Window
from pyspark.sql import functions as F

from lumenframe.functions import text as fx
from lumenframe.operators import blocks as bx
from lumenframe.operators import evaluate, events, fusion, layout, routing, store
from lumenframe.queries import CALLS, CELLS, EDGES, HYBRID, ONCE, ORACLES, ORDER, RUNS, STEPS, asked, bench_once, capable_models, corpus, corpus_index, page_cells, query, query_vectors, session_steps, vectors
from lumenframe.session import ensure_checkpoint_dir, table
from lumenframe.sources import readers, sinks
from lumenframe.streaming import sessions as streams

STOPS = ", ".join(f"'{r}'" for r in fx.STOP_REASONS)


#: Messages as the stream reads them, repeated rows included.
STEPS_ALL = """steps AS (SELECT coalesce(length(content), 0) AS chars, CASE WHEN ts >= 100000000000 THEN ts // 1000 ELSE ts END AS sec,
    CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'ai', 'bot') THEN 'assistant' WHEN lower(trim(role)) IN ('tool', 'function') THEN 'tool' WHEN lower(trim(role)) = 'system' THEN 'system' ELSE 'unknown' END AS speaker
    FROM messages WHERE session_id IS NOT NULL)"""


# --- Texts -----------------------------------------------------------------------------------------------------------


@query("SELECT id, CASE WHEN low_conf THEN '" + fx.LOW_CONF_NOTE.strip() + "' || chr(10) || text ELSE text END AS shown FROM chunks WHERE text IS NOT NULL")
def doubtful_chunks(spark, d):
    return table(spark, d, "chunks").where("text is not null").select("id", fx.marked_low(F.col("text"), F.col("low_conf")).alias("shown"))


@query(f"""WITH o AS (SELECT DISTINCT rec_id, '[stopped: ' || stop || '] ' || answer AS content FROM redteam_results WHERE stop IS NOT NULL AND answer IS NOT NULL)
    SELECT rec_id, nullif(regexp_extract(content, '^\\[stopped: (final_answer|max_steps|error|cancelled)\\]', 1), '') AS reason, length(regexp_replace(content, '^\\[stopped: (final_answer|max_steps|error|cancelled)\\][\\s\\v]*', '')) AS chars FROM o""")
def stop_marks(spark, d):
    """Answers as they are kept, with a mark of their end, and parsed again."""
    rows = table(spark, d, "redteam_results").where("stop is not null and answer is not null").select("rec_id", F.concat(F.lit("[stopped: "), "stop", F.lit("] "), "answer").alias("content")).distinct()
    reason, rest = fx.stop_mark(F.col("content"))
    return rows.select("rec_id", reason.alias("reason"), F.length(rest).alias("chars"))


@query(f"WITH {ONCE} SELECT stop_reason, coalesce(stop_reason IN ({STOPS}), FALSE) AS known, count(*) AS n FROM once GROUP BY ALL")
def stop_reasons(spark, d):
    known = F.coalesce(F.col("stop_reason").isin(*fx.STOP_REASONS), F.lit(False))
    return bench_once(spark, d, "stop_reason").groupBy("stop_reason", known.alias("known")).agg(F.count("*").alias("n"))


@query(r"""SELECT DISTINCT rec_id, regexp_extract(prompt, '[A-Z]+-[0-9]+') AS pattern, regexp_matches(answer, regexp_extract(prompt, '[A-Z]+-[0-9]+'), 'i') AS hit FROM redteam_results WHERE answer IS NOT NULL AND prompt IS NOT NULL""")
def pattern_hits(spark, d):
    """A pattern of each row, looked for in its text, case aside."""
    r = table(spark, d, "redteam_results").where("answer is not null and prompt is not null").select("rec_id", F.regexp_extract("prompt", "[A-Z]+-[0-9]+", 0).alias("pattern"), "answer")
    return r.select("rec_id", "pattern", F.regexp_like("answer", F.concat(F.lit("(?i)"), "pattern")).alias("hit")).distinct()


SCENARIO_SQL = "CASE " + " ".join(f"WHEN regexp_matches(lower(content), '{'|'.join(words)}') THEN '{name}'" for name, words in fx.SCENARIO_WORDS) + " ELSE 'simple' END"


@query(f"SELECT {SCENARIO_SQL} AS scenario, count(*) AS n FROM messages WHERE content IS NOT NULL GROUP BY 1")
def scenarios(spark, d):
    return table(spark, d, "messages").where("content is not null").groupBy(fx.scenario(F.col("content")).alias("scenario")).agg(F.count("*").alias("n"))


@query("SELECT id, CASE WHEN page_end = page THEN [page] ELSE [page, page_end] END AS pages FROM chunks WHERE page IS NOT NULL AND page_end IS NOT NULL")
def page_lists(spark, d):
    """Lists of pages as users write them, parsed."""
    c = table(spark, d, "chunks").where("page is not null and page_end is not null")
    return c.select("id", F.array_distinct(fx.page_list(F.concat(F.col("page").cast("string"), F.lit(", "), F.col("page_end").cast("string"), F.lit(",")))).alias("pages"))


@query(f"""WITH {ONCE} SELECT routed_model, printf('%.1f GB', floor(median(tokens_in) / 1024.0 * 10 + 0.5) / 10) AS size, CASE WHEN max(tokens_in) >= 1024 THEN CAST(floor(max(tokens_in) / 1024.0 + 0.5) AS BIGINT) || 'K ctx' ELSE max(tokens_in) || ' ctx' END AS context,
    format('{{:,}}', CAST(sum(tokens_in) AS BIGINT)) AS total FROM once WHERE routed_model IS NOT NULL AND tokens_in IS NOT NULL GROUP BY 1""")
def size_labels(spark, d):
    r = bench_once(spark, d, "routed_model", "tokens_in").where("routed_model is not null and tokens_in is not null").groupBy("routed_model")
    r = r.agg(F.median("tokens_in").alias("mid"), F.max("tokens_in").alias("most"), F.sum("tokens_in").alias("all"))
    return r.select("routed_model", fx.gigabytes(F.floor(F.col("mid") / 1024 * 10 + 0.5) / 10 * 1024).alias("size"), fx.context_size(F.col("most")).alias("context"), F.format_number("all", 0).alias("total"))


BLURB_SQL = "list_filter([" + ", ".join(f"CASE WHEN list_contains(caps, '{c}') THEN '{t}' END" for c, t in fx.CAPABILITY_BLURBS) + "], lambda b: b IS NOT NULL)"


@query(f"""WITH {ONCE}, c AS (SELECT routed_model, task_type FROM once WHERE routed_model IS NOT NULL AND task_type IS NOT NULL GROUP BY ALL HAVING avg(CAST(success AS DOUBLE)) >= 0.5),
    m AS (SELECT routed_model, list(task_type) AS caps FROM c GROUP BY 1), b AS (SELECT routed_model, array_to_string(list_slice({BLURB_SQL}, 1, 2), ' and ') AS t FROM m)
    SELECT routed_model, CASE WHEN t = '' THEN 'No capabilities declared.' ELSE upper(left(t, 1)) || substr(t, 2) || '.' END AS description FROM b""")
def model_descriptions(spark, d):
    able = bench_once(spark, d, "routed_model", "task_type", "success").where("routed_model is not null and task_type is not null").groupBy("routed_model", "task_type").agg(F.avg(F.col("success").cast("double")).alias("rate")).where("rate >= 0.5")
    return able.groupBy("routed_model").agg(F.collect_set("task_type").alias("caps")).select("routed_model", fx.capability_sentence(F.col("caps")).alias("description"))


@query()
def fitted_texts(spark, d):
    """Texts within 100 tokens: whole, or cut with a notice of where the whole is kept."""
    t = table(spark, d, "documents").where("text is not null")
    fitted = fx.fit(F.col("text"), F.concat(F.lit("/raw/"), sinks.content_name(F.col("text"), "doc")), 100)
    return t.select("doc_id", fitted.alias("shown"))


# --- Filters, order, limits ------------------------------------------------------------------------------------------


@query(f"WITH {ONCE} SELECT least(greatest(steps, 2), 12) AS steps, coalesce(nullif(steps % 5, 0), 30) AS cap, count(*) AS n FROM once WHERE steps IS NOT NULL GROUP BY 1, 2")
def bounded_steps(spark, d):
    """Steps within their limits; a limit of nought means the default."""
    rows = bench_once(spark, d, "steps").where("steps is not null")
    return rows.groupBy(fx.clamped(F.col("steps"), 2, 12).alias("steps"), fx.or_default(F.col("steps") % 5).alias("cap")).agg(F.count("*").alias("n"))


@query("""WITH p AS (SELECT DISTINCT doc_id, page, text FROM doc_pages) SELECT 'some' AS asked, count(*) AS pages, 0 AS chunks FROM p WHERE page IN (1, 3, 5) UNION ALL SELECT 'none', count(*), 0 FROM p UNION ALL SELECT 'chunks', 0, count(*) FROM chunks WHERE page IN (2, 4)""")
def picked_pages(spark, d):
    """No list of pages asks for all of them; no list of chunks for none."""
    p, c = table(spark, d, "doc_pages").select("doc_id", "page", "text").distinct(), table(spark, d, "chunks")
    n = lambda df, name, pages, chunks: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("asked"), (F.col("n") * pages).alias("pages"), (F.col("n") * chunks).alias("chunks"))
    some, every = store.picked(p, "page", [1, 3, 5], True), store.picked(p, "page", [], True)
    held = store.picked(c, "page", [2, 4], False).unionByName(store.picked(c, "page", [], False))
    return n(some, "some", 1, 0).unionByName(n(every, "none", 1, 0)).unionByName(n(held, "chunks", 0, 1))


@query("SELECT tag, count(DISTINCT rec_id) AS cases, count(DISTINCT rec_id) FILTER (WHERE list_contains(tags, 'absent')) AS absent FROM (SELECT rec_id, tags, unnest(tags) AS tag FROM redteam_results) GROUP BY 1")
def tagged_cases(spark, d):
    r = table(spark, d, "redteam_results").select("rec_id", "tags", F.explode("tags").alias("tag"))
    return r.groupBy("tag").agg(F.count_distinct("rec_id").alias("cases"), F.count_distinct(F.when(F.array_contains("tags", "absent"), F.col("rec_id"))).alias("absent"))


@query("SELECT doc_id, chunk_index, id FROM chunks ORDER BY doc_id, chunk_index, id")
def corpus_order(spark, d):
    return table(spark, d, "chunks").select("doc_id", "chunk_index", "id").orderBy("doc_id", "chunk_index", "id")


@query(r"""WITH f AS (SELECT DISTINCT path FROM doc_files WHERE path IS NOT NULL) SELECT DISTINCT regexp_replace(path, '/[^/]*$', '') AS name, FALSE AS is_file FROM f UNION ALL SELECT path, TRUE FROM f""")
def folder_listing(spark, d):
    """Folders first, then files, by name."""
    f = table(spark, d, "doc_files").where("path is not null").select("path").distinct()
    folders = f.select(F.regexp_replace("path", "/[^/]*$", "").alias("name"), F.lit(False).alias("is_file")).distinct()
    return folders.unionByName(f.select(F.col("path").alias("name"), F.lit(True).alias("is_file"))).orderBy("is_file", "name")


@query(f"WITH {ONCE} SELECT task_type, list_slice(list_sort(list(DISTINCT routed_model) FILTER (WHERE routed_model IS NOT NULL)), 1, 10) AS models FROM once WHERE task_type IS NOT NULL GROUP BY 1")
def models_by_task(spark, d):
    """The distinct models of each task type, the first ten by name (a top-k report)."""
    r = bench_once(spark, d, "task_type", "routed_model").where("task_type is not null").select("task_type", "routed_model").distinct()
    return r.groupBy("task_type").agg(F.slice(F.array_sort(F.collect_set("routed_model")), 1, 10).alias("models"))


@query("""WITH l AS (SELECT id, source, filename, sha256, size_bytes, max(size_bytes) OVER (PARTITION BY id) AS expected FROM doc_files) SELECT DISTINCT id, filename, size_bytes = 0 OR size_bytes = expected AS sound FROM l WHERE sha256 IS NOT NULL""")
def manifest_rows(spark, d):
    """Registered files as a manifest: rows without a checksum are placeholders; a size of nought is not checked."""
    f = table(spark, d, "doc_files").select("id", "filename", "sha256", "size_bytes")
    held = f.join(f.groupBy("id").agg(F.max("size_bytes").alias("expected")), "id").where("sha256 is not null")
    return held.select("id", "filename", ((F.col("size_bytes") == 0) | (F.col("size_bytes") == F.col("expected"))).alias("sound")).distinct()


@query("""WITH f AS (SELECT source, filename, bool_or(indexed) AS ready, max(ingested_at) AS last FROM doc_files WHERE filename IS NOT NULL GROUP BY ALL), k AS (SELECT * FROM f WHERE ready QUALIFY row_number() OVER (PARTITION BY source ORDER BY last DESC, filename) <= 5),
    n AS (SELECT source, count(*) FILTER (WHERE ready) AS ready, count(*) FILTER (WHERE NOT ready) AS failed FROM f GROUP BY 1), p AS (SELECT source, 'Attached: ' || string_agg(filename, ', ' ORDER BY last DESC, filename) AS preamble FROM k GROUP BY 1)
    SELECT n.source, n.ready, n.failed, p.preamble FROM n LEFT JOIN p ON n.source IS NOT DISTINCT FROM p.source""")
def attachments(spark, d):
    """Files of a source that are ready and that failed, and a preamble that names the last five ready ones."""
    f = table(spark, d, "doc_files").where("filename is not null").groupBy("source", "filename").agg(F.bool_or("indexed").alias("ready"), F.max("ingested_at").alias("last"))
    w = Window.partitionBy("source").orderBy(F.desc("last"), "filename")
    few = f.where("ready").withColumn("place", F.row_number().over(w)).where("place <= 5").groupBy(F.col("source").alias("of")).agg(F.array_sort(F.collect_list(F.struct("place", "filename"))).alias("names"))
    n = f.groupBy("source").agg(F.count_if("ready").alias("ready"), F.count_if(~F.col("ready")).alias("failed"))
    named = F.concat(F.lit("Attached: "), F.array_join(F.transform("names", lambda x: x["filename"]), ", "))
    return n.join(few, F.col("source").eqNullSafe(F.col("of")), "left").select("source", "ready", "failed", named.alias("preamble"))


@query("""WITH f AS (SELECT id, source, min(filename) AS filename FROM doc_files WHERE filename IS NOT NULL GROUP BY ALL), c AS (SELECT *, min(id) OVER (PARTITION BY source, filename) AS first FROM f)
    SELECT source, id, CASE WHEN id = first THEN filename ELSE regexp_replace(filename, '(.)\\.[^.]+$', '\\1') || '-' || left(sha256(id), 8) || regexp_extract(filename, '.(\\.[^.]+)$', 1) END AS name FROM c""")
def free_names(spark, d):
    """Names of files in their source's folder; the first id keeps a name that several have."""
    f = table(spark, d, "doc_files").where("filename is not null").groupBy("id", "source").agg(F.min("filename").alias("filename"))
    first = f.groupBy(F.col("source").alias("of"), F.col("filename").alias("same")).agg(F.min("id").alias("first"))
    held = f.join(first, F.col("source").eqNullSafe(F.col("of")) & (F.col("filename") == F.col("same")))
    return held.select("source", "id", fx.collision_name(F.col("filename"), F.col("id") != F.col("first"), F.col("id")).alias("name"))


# --- Joins, sessions, trails -----------------------------------------------------------------------------------------


@query("SELECT t.id, any_value(t.max_steps) AS max_steps, count(DISTINCT b.rec_id) AS runs, count(DISTINCT b.rec_id) FILTER (WHERE b.steps > t.max_steps) AS beyond FROM bench_results b JOIN bench_tasks t ON b.id = t.id GROUP BY 1")
def task_runs(spark, d):
    """Every run with its task; a run of an unknown task is an error."""
    runs = bench_once(spark, d, "id", "steps").where("id is not null")
    joined = store.required(runs, table(spark, d, "bench_tasks").select("id", "max_steps"), "id")
    return joined.groupBy("id").agg(F.max("max_steps").alias("max_steps"), F.count("*").alias("runs"), F.count_if(F.col("steps") > F.col("max_steps")).alias("beyond"))


@query(f"WITH {STEPS}, g AS (SELECT session_id, speaker, greatest(0, sec - coalesce(lag(sec) OVER {ORDER}, sec)) AS gap FROM steps) SELECT session_id, coalesce(sum(gap), 0) AS seconds, count(DISTINCT speaker) AS stages FROM g GROUP BY 1")
def stage_sums(spark, d):
    """The sum of a session's map of stages."""
    p = events.phases(session_steps(spark, d)).groupBy("session_id").agg(F.map_from_entries(F.collect_list(F.struct("speaker", "seconds"))).alias("stages"))
    return p.select("session_id", F.aggregate(F.map_values("stages"), F.lit(0).cast("long"), lambda a, x: a + x).alias("seconds"), F.size("stages").cast("long").alias("stages"))


@query(f"""WITH {CALLS}, p AS (SELECT session_id, speaker, greatest(0, sec - coalesce(lag(sec) OVER {ORDER}, sec)) AS gap FROM steps), k AS (SELECT session_id, count(*) AS calls, count(*) FILTER (WHERE result_id IS NULL) AS open_calls, coalesce(sum(wall_s), 0) AS tool_s FROM calls GROUP BY 1),
    s AS (SELECT session_id, sum(gap) AS wall_s, coalesce(sum(gap) FILTER (WHERE speaker = 'assistant'), 0) AS said_s, coalesce(sum(gap) FILTER (WHERE speaker = 'user'), 0) AS asked_s, count(*) AS steps FROM p GROUP BY 1)
    SELECT s.*, coalesce(calls, 0) AS calls, coalesce(open_calls, 0) AS open_calls, coalesce(tool_s, 0) AS tool_s, wall_s - said_s - asked_s AS other_s FROM s LEFT JOIN k USING (session_id)""")
def task_records(spark, d):
    """One record a session: its steps, calls and the seconds of each phase, with those that no phase accounts for."""
    steps = session_steps(spark, d)
    of = lambda who, name: F.coalesce(F.sum(F.when(F.col("speaker") == who, F.col("seconds"))), F.lit(0)).alias(name)
    phases = events.phases(steps).groupBy("session_id").agg(F.sum("seconds").alias("wall_s"), of("assistant", "said_s"), of("user", "asked_s"), F.sum("steps").alias("steps"))
    calls = events.call_results(steps).groupBy("session_id").agg(F.count("*").alias("calls"), F.count_if(F.col("result_id").isNull()).alias("open_calls"), F.coalesce(F.sum("wall_s"), F.lit(0)).alias("tool_s"))
    none = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return phases.join(calls, "session_id", "left").select("session_id", "wall_s", "said_s", "asked_s", "steps", none("calls"), none("open_calls"), none("tool_s"), (F.col("wall_s") - F.col("said_s") - F.col("asked_s")).alias("other_s"))


@query(f"""WITH {CALLS}, e AS (SELECT session_id, max(sec) AS ended FROM steps GROUP BY 1) SELECT c.session_id, c.call_id, c.result_id IS NULL AS frozen, coalesce(c.wall_s, e.ended - s.sec) AS seconds
    FROM calls c JOIN e USING (session_id) JOIN (SELECT session_id, id, content, sec FROM steps WHERE speaker = 'assistant' AND content LIKE 'Calling %') s ON s.session_id = c.session_id AND s.id = c.call_id""")
def frozen_calls(spark, d):
    """Seconds of each call; one that is still open when its session ends is frozen there."""
    steps = session_steps(spark, d)
    ended = steps.groupBy("session_id").agg(F.max("at").alias("ended"))
    begun = steps.where("speaker = 'assistant' and content like 'Calling %'").select("session_id", F.col("id").alias("call_id"), "at")
    c = events.call_results(steps).join(ended, "session_id").join(begun, ["session_id", "call_id"])
    return c.select("session_id", "call_id", F.col("result_id").isNull().alias("frozen"), F.coalesce("wall_s", F.col("ended") - F.col("at")).alias("seconds"))


@query(f"""WITH {CALLS}, o AS (SELECT session_id, arg_max(tool, call_id) FILTER (WHERE result_id IS NULL) AS tool FROM calls GROUP BY 1) SELECT session_id, CASE WHEN tool IS NULL THEN 'generating' ELSE 'running ' || tool END AS doing FROM (SELECT DISTINCT session_id FROM steps) LEFT JOIN o USING (session_id)""")
def running_tools(spark, d):
    """What each session is doing: its last open call, if there is one."""
    steps = session_steps(spark, d)
    last = events.call_results(steps).where("result_id is null").groupBy("session_id").agg(F.max_by("tool", "call_id").alias("tool"))
    doing = F.coalesce(F.concat(F.lit("running "), "tool"), F.lit("generating"))
    return steps.select("session_id").distinct().join(last, "session_id", "left").select("session_id", doing.alias("doing"))


@query("""SELECT event_id, row_number() OVER (ORDER BY event_type = 'error', ts, event_id) AS seq FROM events""")
def trail_sequence(spark, d):
    """Events appended to a trail in two batches and read again: each has its number."""
    path = f"{ensure_checkpoint_dir(spark)}/trail-{uuid.uuid4().hex}"
    e = table(spark, d, "events").select("ts", "event_id", "event_type", "props")
    for batch in (e.where("event_type <> 'error'"), e.where("event_type = 'error'")):
        sinks.append_trail(batch, path, order=("ts", "event_id"))
    return spark.read.parquet(path).select("event_id", "seq")


@query("SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN label + 1 ELSE label END AS label, len(embedding) AS dim FROM embeddings WHERE embedding IS NOT NULL")
def upserted_vectors(spark, d):
    """Vectors written, half of them written again with another payload, and read back."""
    path = f"{ensure_checkpoint_dir(spark)}/vectors-{uuid.uuid4().hex}"
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label")
    sinks.upsert_vectors(v, path, buckets=8)
    sinks.upsert_vectors(v.where("id % 2 = 0").withColumn("label", F.col("label") + 1), path, buckets=8)
    return spark.read.parquet(path).select("id", "label", F.size("vector").cast("long").alias("dim"))


# --- Layout, retrieval, choice ---------------------------------------------------------------------------------------


@query(rf"""WITH {RUNS}, rows AS (SELECT t.doc_id, t.page, t.table_no, c.line_no - t.first_line AS nth, max(c.row_cells) AS k, '| ' || string_agg(replace(c.text, '|', '\|'), ' | ' ORDER BY cell_no) AS row FROM tables t JOIN cells c ON t.doc_id = c.doc_id AND t.page = c.page AND c.line_no BETWEEN t.first_line AND t.last_line GROUP BY ALL),
    w AS (SELECT doc_id, page, table_no, max(k) AS width, max(CASE WHEN nth = 0 THEN k END) AS named FROM rows GROUP BY ALL),
    pad AS (SELECT r.*, row || CASE WHEN nth = 0 THEN array_to_string(list_transform(generate_series(named + 1, width), lambda i: ' | Col ' || i), '') ELSE repeat(' | ', CAST(width - k AS INTEGER)) END || ' |' || CASE WHEN nth = 0 THEN chr(10) || '|' || repeat(' --- |', CAST(width AS INTEGER)) ELSE '' END AS line FROM rows r JOIN w USING (doc_id, page, table_no))
    SELECT doc_id, page, table_no, string_agg(line, chr(10) ORDER BY nth) AS text FROM pad GROUP BY ALL""")
def grid_tables(spark, d):
    """The tables of pages as grids in markdown, blank headers named; a page's table is one small group."""
    placed = page_cells(spark, d)
    inside = placed.join(layout.table_runs(placed), ["doc_id", "page"]).where("line_no between first_line and last_line")
    rows = inside.groupBy("doc_id", "page", "table_no", "line_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("cell_no", "text"))), lambda c: c["text"]).alias("cells"))
    grids = rows.groupBy("doc_id", "page", "table_no").agg(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "cells"))), lambda r: r["cells"]).alias("grid"))
    return grids.select("doc_id", "page", "table_no", bx.grid_markdown(F.col("grid")).alias("text"))


PLACES = f"""{EDGES}, ordered AS (SELECT p.doc_id, p.page, p.line_no, p.cell_no, CAST(CASE WHEN count(e.x) < 2 THEN 0 ELSE greatest(0, count(e.x) FILTER (WHERE e.x <= p.x0 + 2) - 1) END AS INTEGER) AS "column"
  FROM placed p LEFT JOIN edges e ON p.doc_id = e.doc_id AND p.page = e.page GROUP BY ALL)"""


@query(f"""WITH {PLACES} SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY "column", line_no, cell_no) AS place FROM ordered""")
def reading_places(spark, d):
    """Cells in reading order: columns by their start edges, then from top to bottom."""
    placed = page_cells(spark, d)
    return layout.reading_order(placed, layout.column_edges(placed))


def ablation_sql(config: str, only: str) -> str:
    return f"""SELECT '{config}' AS config, t.query_id, t.id, row_number() OVER (PARTITION BY t.query_id ORDER BY t.score DESC, t.id) AS rank FROM
      (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 12) AS score FROM lists WHERE {only} GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) <= 30) t
      JOIN documents d ON t.id = d.doc_id WHERE d.filename IS NOT NULL AND d.filename <> '' QUALIFY rank <= 10"""


@query(f"WITH {HYBRID} " + " UNION ALL ".join(f"({ablation_sql(c, o)})" for c, o in (("hybrid", "TRUE"), ("dense", "source = 'dense'"), ("sparse", "source = 'sparse'"))))
def retrieval_ablation(spark, d):
    """The same questions by both rankings and by each alone."""
    parts = None
    for mode in ("hybrid", "dense", "sparse"):
        h = fusion.hybrid(corpus(spark, d), vectors(spark, d), asked(spark, d), query_vectors(spark, d), top_k=10, mode=mode, index=corpus_index(spark, d))
        part = h.select(F.lit(mode).alias("config"), "query_id", "id", "rank")
        parts = part if parts is None else parts.unionByName(part)
    return parts


@query(f"""WITH chosen AS ({ORACLES["capable_models"]}), {ONCE} SELECT o.task_type, count(*) AS n, round(avg(CAST(coalesce(a.model_id = b.model_id, FALSE) AS DOUBLE)), 6) AS same_model FROM once o LEFT JOIN chosen a ON o.routed_task = a.need LEFT JOIN chosen b ON o.task_type = b.need WHERE o.task_type IS NOT NULL GROUP BY 1""")
def model_choice(spark, d):
    """How often the routed task leads to the model that the true task asks for."""
    chosen = capable_models(spark, d).select("need", "model_id")
    a, b = chosen.withColumnsRenamed({"need": "routed_task", "model_id": "a"}), chosen.withColumnsRenamed({"need": "task_type", "model_id": "b"})
    rows = bench_once(spark, d, "routed_task", "task_type").where("task_type is not null").join(a, "routed_task", "left").join(b, "task_type", "left")
    same = F.coalesce(F.col("a") == F.col("b"), F.lit(False)).cast("double")
    return rows.groupBy("task_type").agg(F.count("*").alias("n"), F.round(F.avg(same), 6).alias("same_model"))


@query(ORACLES["retrieval_summary"])
def gated_retrieval(spark, d):
    """``retrieval_summary``, which must reach a least recall."""
    from lumenframe.queries import retrieval_summary

    return evaluate.gate(retrieval_summary(spark, d), "recall_at_5", 0.05)


@query()
def vector_class_accuracy(spark, d):
    """Held-out accuracy by label of a classifier over the given vectors."""
    v = table(spark, d, "embeddings").select("vec_id", "embedding", F.col("label").cast("string").alias("label")).where("embedding is not null and label is not null")
    parts = routing.split(v, "label", "vec_id")
    model = routing.fit_vectors(parts.where("not held_out"), "embedding", "label", "vec_id")
    told = routing.classify(model, parts.where("held_out").withColumn("features", array_to_vector("embedding")), "label")
    return told.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("predicted") == F.col("label")).cast("double")), 4).alias("accuracy"))


@query()
def prompt_routing_accuracy(spark, d):
    """Held-out accuracy by task type of a classifier of sessions by their first user message."""
    first = session_steps(spark, d).where("speaker = 'user' and content is not null").groupBy("session_id").agg(F.min_by("content", F.struct("at", "id", "content")).alias("prompt"))
    labelled = table(spark, d, "sessions").where("task_type is not null").select("session_id", "task_type").join(first, "session_id")
    parts = routing.split(labelled, "task_type", "session_id")
    model = routing.fit(parts.where("not held_out"), "prompt", "task_type", "session_id")
    told = routing.classify(model, parts.where("held_out"), "task_type")
    return told.groupBy("task_type").agg(F.count("*").alias("n"), F.round(F.avg((F.col("predicted") == F.col("task_type")).cast("double")), 4).alias("accuracy"), F.round(F.avg("confidence"), 4).alias("confidence"))


# --- Streams and lines -----------------------------------------------------------------------------------------------


@query(f"WITH {STEPS_ALL} SELECT time_bucket(INTERVAL 1 HOUR, CAST(make_timestamp(sec * 1000000) AS TIMESTAMP)) AS hour, speaker, count(*) AS steps, sum(chars) AS chars FROM steps GROUP BY 1, 2")
def hourly_stream(spark, d):
    """Steps an hour and speaker of the messages read as a stream; no row is late for so long a watermark."""
    path = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    counts = streams.hourly(streams.read_messages(spark, f"{d}/messages.parquet"), late="20000 days").select(F.col("hour.start").cast("timestamp_ntz").alias("hour"), "speaker", "steps", "chars")
    return streams.drained(counts, path, keys=("hour", "speaker"))


@query("""WITH o AS (SELECT DISTINCT rec_id, kind, prompt FROM redteam_results WHERE kind IS NOT NULL) SELECT kind, count(*) AS cases, sum(length(prompt)) AS chars FROM o GROUP BY 1""")
def replayed_lines(spark, d):
    """Cases written as JSON lines and read again by a stated schema."""
    path = f"{ensure_checkpoint_dir(spark)}/lines-{uuid.uuid4().hex}"
    sinks.write_json(table(spark, d, "redteam_results").select("rec_id", "kind", "prompt").distinct(), path)
    rows = readers.json_lines(spark, path, "rec_id long, kind string, prompt string", needed="kind")
    return rows.groupBy("kind").agg(F.count("*").alias("cases"), F.sum(F.length("prompt")).alias("chars"))
