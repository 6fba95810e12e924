"""Registered queries of the core over the given tables, and the DuckDB twin of each that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.functions import text as fx
from lumenframe.operators import blocks as bx
from lumenframe.operators import bm25, dense, evaluate, events, fusion, layout, routing, snippets, store
from lumenframe.session import ensure_checkpoint_dir, table
from lumenframe.sources import readers, sinks
from lumenframe.streaming import sessions as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL twin."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- Text functions --------------------------------------------------------------------------------------------------

#: Search tokens in SQL.
TOKENS = r"""flatten(list_transform(regexp_extract_all(lower(text), '[a-z0-9]+(?:[-_/.][a-z0-9]+)*'), lambda t:
    CASE WHEN regexp_matches(t, '[-_/.]') THEN list_concat([t], list_filter(regexp_split_to_array(t, '[-_/.]'), lambda p: length(p) > 1)) ELSE [t] END))"""
STOP = ", ".join(f"'{w}'" for w in fx.STOPWORDS)
TERMS = rf"""list_sort(list_distinct(list_concat(
    list_filter(regexp_extract_all(lower({{0}}), '[a-z0-9]+(?:[-_/.][a-z0-9]+)*'), lambda t: length(t) > 2 AND NOT list_contains([{STOP}], t)),
    list_filter(flatten(list_transform(list_filter(regexp_extract_all(lower({{0}}), '[a-z0-9]+(?:[-_/.][a-z0-9]+)*'), lambda t: length(t) > 2 AND NOT list_contains([{STOP}], t)),
        lambda t: regexp_split_to_array(t, '[-_/.]'))), lambda t: length(t) > 2 AND NOT list_contains([{STOP}], t)))))"""


@query(f"SELECT doc_id, len(t) AS tokens, len(list_distinct(t)) AS distinct_tokens FROM (SELECT doc_id, {TOKENS} AS t FROM documents WHERE text IS NOT NULL)")
def tokenize_stats(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", fx.tokenize(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").alias("tokens"), F.size(F.array_distinct("t")).alias("distinct_tokens"))


@query("SELECT id, tokens, CASE WHEN coalesce(length(text), 0) = 0 THEN 0 ELSE CAST(floor(length(text) / 3.4) AS INTEGER) + 1 END AS estimate FROM chunks")
def token_counts(spark, d):
    return table(spark, d, "chunks").select("id", "tokens", fx.count_tokens(F.col("text")).alias("estimate"))


@query(r"""SELECT doc_id, len(s) AS sentences, list_max(list_transform(s, lambda x: length(x))) AS longest
    FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?;])[ \t\n\v\f\r]+', '\1' || chr(1), 'g'), chr(1)) AS s FROM documents WHERE text IS NOT NULL)""")
def sentence_stats(spark, d):
    rows = table(spark, d, "documents").where("text is not null").select("doc_id", fx.sentences(F.col("text")).alias("s"))
    return rows.select("doc_id", F.size("s").alias("sentences"), F.array_max(F.transform("s", lambda x: F.length(x))).alias("longest"))


@query(r"""WITH h AS (SELECT doc_id, text, left(text, 340) AS head FROM documents WHERE text IS NOT NULL),
    c AS (SELECT *, length(head) - strpos(reverse(head), chr(10)) AS last FROM h)
    SELECT doc_id, CASE WHEN length(text) = 0 OR floor(length(text) / 3.4) + 1 <= 100 THEN text
      ELSE regexp_replace(CASE WHEN contains(head, chr(10)) AND last > least(length(text), 340) * 0.85 THEN left(head, last) ELSE head END, '[\s\p{Z}\v]+$', '') END AS head FROM c""")
def truncated_heads(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", fx.truncate_tokens(F.col("text"), 100).alias("head"))


@query(r"SELECT doc_id, regexp_replace(right(text, 170), '^[\s\p{Z}\v]+', '') AS tail FROM documents WHERE text IS NOT NULL")
def text_tails(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", fx.tail_tokens(F.col("text"), 50).alias("tail"))


@query(r"""SELECT doc_id, CASE WHEN length(t) <= 320 THEN t ELSE left(t, 319) || '…' END AS snippet
    FROM (SELECT doc_id, trim(regexp_replace(text, '[\s\p{Z}\v]+', ' ', 'g')) AS t FROM documents WHERE text IS NOT NULL)""")
def plain_snippets(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", fx.snippet(F.col("text")).alias("snippet"))


@query(r"""SELECT DISTINCT id, regexp_replace(left(regexp_replace(regexp_replace(lower(filename), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 60), '-+$', '') AS slug,
    regexp_extract(path, '([^/]*)$', 1) AS base, lower(regexp_extract(filename, '(\.[^.]+)$', 1)) AS suffix, regexp_replace(filename, '\.[^.]+$', '') AS stem,
    regexp_replace(lower(source), '[^\p{L}\p{N}]', '', 'g') AS source_key FROM doc_files WHERE filename IS NOT NULL""")
def file_names(spark, d):
    f = table(spark, d, "doc_files").where("filename is not null")
    return f.select("id", fx.slugify(F.col("filename")).alias("slug"), fx.base_name(F.col("path")).alias("base"), fx.suffix(F.col("filename")).alias("suffix"), fx.stem(F.col("filename")).alias("stem"), fx.heading_key(F.col("source")).alias("source_key")).distinct()


@query(r"""SELECT DISTINCT rec_id, array_to_string(list_filter(regexp_extract_all(answer, '[A-Za-z0-9]+(?:[-./][A-Za-z0-9]+)*'), lambda t: regexp_matches(t, '[0-9]') OR length(t) > 4), ' ') AS keys
    FROM redteam_results WHERE answer IS NOT NULL""")
def answer_keys(spark, d):
    r = table(spark, d, "redteam_results").where("answer is not null")
    return r.select("rec_id", F.array_join(fx.answer_keys(F.col("answer")), " ").alias("keys")).distinct()


@query(f"""SELECT DISTINCT rec_id, len(terms) AS terms, CAST(len(list_filter(terms, lambda t: contains(lower(answer), t))) AS INTEGER) AS score
    FROM (SELECT rec_id, answer, {TERMS.format("prompt")} AS terms FROM redteam_results WHERE answer IS NOT NULL AND prompt IS NOT NULL)""")
def answer_overlap(spark, d):
    r = table(spark, d, "redteam_results").where("answer is not null and prompt is not null").withColumn("terms", fx.query_terms(F.col("prompt")))
    return r.select("rec_id", F.size("terms").alias("terms"), fx.line_score(F.col("answer"), F.col("terms")).alias("score")).distinct()


@query(f"""WITH a AS (SELECT DISTINCT rec_id, answer, {TERMS.format("prompt")} AS terms FROM redteam_results WHERE answer IS NOT NULL AND prompt IS NOT NULL),
    p AS (SELECT *, greatest(0, coalesce(list_min(list_filter(list_transform(terms, lambda t: strpos(lower(answer), t) - 1), lambda x: x >= 0)), 0) - 26) AS start FROM a),
    b AS (SELECT *, strpos(substr(answer, start + 1), ' ') - 1 AS blank FROM p),
    c AS (SELECT *, CASE WHEN start > 0 AND blank >= 0 AND blank < 30 THEN start + blank + 1 ELSE start END AS first, least(length(answer), start + 80) AS last FROM b)
    SELECT rec_id, (CASE WHEN first > 0 THEN '...' ELSE '' END) || regexp_replace(substr(answer, first + 1, greatest(0, last - first)), '^[\\s\\p{{Z}}\\v]+|[\\s\\p{{Z}}\\v]+$', '', 'g') || (CASE WHEN last < length(answer) THEN '...' ELSE '' END) AS slice FROM c""")
def answer_windows(spark, d):
    r = table(spark, d, "redteam_results").where("answer is not null and prompt is not null").select("rec_id", "answer", fx.query_terms(F.col("prompt")).alias("terms")).distinct()
    return r.select("rec_id", fx.window(F.col("answer"), F.col("terms"), 20).alias("slice"))


@query(r"""WITH t AS (SELECT DISTINCT rec_id, lower(regexp_extract(prompt, '[A-Z]+-[0-9]+[AB]?')) AS truth, trim(regexp_replace(replace(replace(lower(answer), 'degrees', ''), '°', ''), '[ \t\n\v\f\r]+', ' ', 'g')) AS said
      FROM redteam_results WHERE answer IS NOT NULL AND prompt IS NOT NULL)
    SELECT rec_id, truth <> '' AND regexp_matches(replace(said, ',', ''), regexp_extract(truth, '[0-9]+') || '([^0-9]|$)') AND contains(said, truth) AS states FROM t""")
def truths_stated(spark, d):
    r = table(spark, d, "redteam_results").where("answer is not null and prompt is not null")
    r = r.select("rec_id", F.regexp_extract("prompt", "[A-Z]+-[0-9]+[AB]?", 0).alias("truth"), "answer").distinct()
    return r.select("rec_id", fx.states_truth(F.col("truth"), F.col("answer")).alias("states"))


HONEST_SQL = "(regexp_matches(lower(answer), '\\b(?:did|does|do) not \\w+ (?:mention|state|specify|cover|include)') OR " + " OR ".join("contains(lower(answer), '" + m.replace("'", "''") + "')" for m in fx.HONEST_MARKERS) + ")"


@query(f"SELECT DISTINCT rec_id, {HONEST_SQL} AS honest FROM redteam_results WHERE answer IS NOT NULL")
def honest_answers(spark, d):
    return table(spark, d, "redteam_results").where("answer is not null").select("rec_id", fx.admits_absence(F.col("answer")).alias("honest")).distinct()


@query("""SELECT routed_model, string_agg(CASE WHEN regexp_matches(p, '^[0-9]+(\\.[0-9]+)?[bB]$') THEN upper(p) WHEN lower(p) = 'vl' THEN 'VL' WHEN lower(p) = 'moe' THEN 'MoE' WHEN lower(p) = 'llava' THEN 'LLaVA'
      WHEN lower(p) = 'vlm' THEN 'VLM' ELSE upper(left(p, 1)) || substr(p, 2) END, ' ' ORDER BY i) AS name, any_value(n) AS n
    FROM (SELECT routed_model, n, unnest(parts) AS p, generate_subscripts(parts, 1) AS i FROM (SELECT routed_model, string_split(routed_model, '-') AS parts, count(*) AS n FROM bench_results WHERE routed_model IS NOT NULL GROUP BY 1)) GROUP BY 1""")
def model_names(spark, d):
    return table(spark, d, "bench_results").where("routed_model is not null").groupBy("routed_model").agg(F.count("*").alias("n")).withColumn("name", fx.display_name(F.col("routed_model")))


@query(r"""SELECT doc_id, len(p) AS pieces, array_to_string(p, '') = text AS lossless FROM (SELECT doc_id, text, regexp_extract_all(text, '\A[ \t\n\v\f\r]+|[^ \t\n\v\f\r]+[ \t\n\v\f\r]*') AS p FROM documents WHERE text IS NOT NULL)""")
def replay_pieces(spark, d):
    r = table(spark, d, "documents").where("text is not null").select("doc_id", "text", fx.stream_pieces(F.col("text")).alias("p"))
    return r.select("doc_id", F.size("p").alias("pieces"), (F.array_join("p", "") == F.col("text")).alias("lossless"))


@query(r"""SELECT doc_id, CASE WHEN length(text) > 220 OR len(string_split(text, chr(10))) > 4 THEN left(array_to_string(list_slice(string_split(text, chr(10)), 1, 4), chr(10)), 220) || '…' ELSE text END AS preview
    FROM documents WHERE text IS NOT NULL""")
def previews(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", fx.preview(F.col("text")).alias("preview"))


@query()
def wrapped_lines(spark, d):
    r = table(spark, d, "documents").where("text is not null").select("doc_id", bx.wrap(F.col("text"), 80).alias("lines"))
    return r.select("doc_id", F.size("lines").alias("lines"), F.coalesce(F.array_max(F.transform("lines", lambda x: F.length(x))), F.lit(0)).alias("widest"))


@query(r"""SELECT DISTINCT rec_id, regexp_replace(CASE WHEN code <> '' THEN code ELSE answer END, '^[\s\p{Z}\v]+|[\s\p{Z}\v]+$', '', 'g') AS code
    FROM (SELECT rec_id, answer, regexp_extract(answer, '(?s)```[A-Za-z0-9_+-]*[ \t\v\f\r]*\n[ \t\n\v\f\r]*(.*?)```', 1) AS code FROM redteam_results WHERE answer LIKE '%```%')""")
def code_blocks(spark, d):
    return table(spark, d, "redteam_results").where(F.contains("answer", F.lit("```"))).select("rec_id", fx.code_block(F.col("answer")).alias("code")).distinct()


CELLS = r"""cut AS (SELECT doc_id, page, generate_subscripts(l, 1) AS line_no, unnest(l) AS line FROM (SELECT DISTINCT doc_id, page, string_split(text, chr(10)) AS l FROM doc_pages WHERE text IS NOT NULL)),
parts AS (SELECT doc_id, page, line_no, regexp_extract_all(line, '[^ \t\n\v\f\r]+(?: [^ \t\n\v\f\r]+)*') AS c FROM cut WHERE length(trim(line)) > 0),
cells AS (SELECT doc_id, page, line_no, len(c) AS row_cells, generate_subscripts(c, 1) - 1 AS cell_no, unnest(c) AS text FROM parts)"""


def page_cells(spark, d):
    return layout.cells(table(spark, d, "doc_pages").where("text is not null").select("doc_id", "page", "text").distinct())


@query(rf"""WITH {CELLS} SELECT doc_id, count(*) AS cells, count(v) AS numbers, round(sum(v), 4) AS total
    FROM (SELECT doc_id, CASE WHEN regexp_matches(text, '^[ \t]*-?([0-9]{{1,3}}(,[0-9]{{3}})+|[0-9]+)(\.[0-9]+)?[ \t]*$') THEN CAST(replace(text, ',', '') AS DOUBLE) END AS v FROM cells WHERE row_cells >= 3) GROUP BY 1""")
def numeric_cells(spark, d):
    wide = page_cells(spark, d).groupBy("doc_id", "page", "line_no").agg(F.collect_list("text").alias("c")).where(F.size("c") >= 3)
    values = wide.select("doc_id", F.explode("c").alias("c")).select("doc_id", fx.to_number(F.col("c")).alias("v"))
    return values.groupBy("doc_id").agg(F.count("*").alias("cells"), F.count("v").alias("numbers"), F.round(F.sum("v"), 4).alias("total"))


# --- Files, sessions, results ----------------------------------------------------------------------------------------

@query("""SELECT s.session_id, s.title, coalesce(m.n, 0) AS messages FROM sessions s LEFT JOIN (SELECT session_id, count(id) AS n FROM messages WHERE session_id IS NOT NULL GROUP BY 1) m USING (session_id)""")
def session_message_counts(spark, d):
    return store.left_counts(table(spark, d, "sessions").select("session_id", "title"), table(spark, d, "messages"), "session_id", "id", "messages")


@query("""SELECT (SELECT count(DISTINCT id) FROM doc_files) AS files, (SELECT sum(pages) FROM (SELECT id, max(pages) AS pages FROM doc_files GROUP BY 1)) AS pages,
    (SELECT count(*) FROM chunks) AS chunks, (SELECT count(*) FROM embeddings) AS vectors, (SELECT count(*) FROM documents) AS texts""")
def corpus_stats(spark, d):
    files = table(spark, d, "doc_files").groupBy("id").agg(F.max("pages").alias("pages")).agg(F.count("*").alias("files"), F.sum("pages").alias("pages"))
    one = lambda name, alias: table(spark, d, name).agg(F.count("*").alias(alias))
    out = files
    for name, alias in (("chunks", "chunks"), ("embeddings", "vectors"), ("documents", "texts")):
        out = out.join(F.broadcast(one(name, alias)))  # one row each
    return out


@query("SELECT id, filename, source, sha256, ingest_ms, ingested_at FROM doc_files QUALIFY row_number() OVER (PARTITION BY id, source ORDER BY ingested_at DESC, ingest_ms DESC) = 1")
def latest_files(spark, d):
    files = table(spark, d, "doc_files").select("id", "filename", "source", "sha256", "ingest_ms", "ingested_at")
    return store.latest(files, ["id", "source"], ["ingested_at", "ingest_ms"])


@query("""SELECT id, filename, CASE WHEN indexed THEN 'indexed' ELSE 'failed' END AS status, CASE WHEN size_bytes < 1024 THEN size_bytes || ' B' WHEN size_bytes < 1048576 THEN ((size_bytes * 10 + 512) // 1024) // 10 || '.' || ((size_bytes * 10 + 512) // 1024) % 10 || ' KB' ELSE ((size_bytes * 10 + 524288) // 1048576) // 10 || '.' || ((size_bytes * 10 + 524288) // 1048576) % 10 || ' MB' END AS size,
    CASE WHEN ingest_ms < 1000 THEN ingest_ms || ' ms' ELSE ((ingest_ms * 10 + 500) // 1000) // 10 || '.' || ((ingest_ms * 10 + 500) // 1000) % 10 || ' s' END AS took, ingested_at FROM doc_files""")
def file_listing(spark, d):
    f = table(spark, d, "doc_files")
    return f.select("id", "filename", F.when(F.col("indexed"), "indexed").otherwise("failed").alias("status"), fx.human_bytes(F.col("size_bytes")).alias("size"), fx.human_ms(F.col("ingest_ms")).alias("took"), "ingested_at").orderBy(F.desc("ingested_at"), "id")


@query(r"""WITH names AS (SELECT DISTINCT regexp_extract(filename, '^[A-Z]+-[0-9]+-[0-9]+') AS name FROM chunks UNION SELECT DISTINCT regexp_extract(filename, '[0-9]+-[0-9]+-[a-z]+') FROM chunks UNION SELECT DISTINCT filename FROM chunks UNION SELECT DISTINCT doc_id FROM chunks),
    f AS (SELECT id, filename, ingested_at FROM doc_files QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, filename DESC) = 1),
    t AS (SELECT n.name, f.*, 1 AS tier FROM names n JOIN f ON f.id = n.name UNION ALL SELECT n.name, f.*, 2 FROM names n JOIN f ON f.filename = n.name
      UNION ALL SELECT n.name, f.*, 3 FROM names n JOIN f ON starts_with(lower(f.filename), lower(n.name)) UNION ALL SELECT n.name, f.*, 4 FROM names n JOIN f ON contains(lower(f.filename), lower(n.name)))
    SELECT name, id, filename, tier FROM t QUALIFY row_number() OVER (PARTITION BY name ORDER BY tier, ingested_at DESC, id) = 1""")
def name_resolution(spark, d):
    c = table(spark, d, "chunks")
    asked = [F.regexp_extract("filename", "^[A-Z]+-[0-9]+-[0-9]+", 0), F.regexp_extract("filename", "[0-9]+-[0-9]+-[a-z]+", 0), F.col("filename"), F.col("doc_id")]
    names = c.select(F.explode(F.array(*asked)).alias("name")).distinct()
    return store.resolve(names, table(spark, d, "doc_files"))


@query(r"""WITH c AS (SELECT DISTINCT filename FROM chunks), names AS (SELECT left(filename, 11) AS name FROM c UNION SELECT substr(filename, 3, 9) FROM c UNION SELECT substr(upper(filename), 12, 8) FROM c UNION SELECT left(filename, 2) FROM c UNION SELECT substr(filename, 6, 1) FROM c),
    f AS (SELECT id, filename, ingested_at FROM doc_files QUALIFY row_number() OVER (PARTITION BY id ORDER BY ingested_at DESC, filename DESC) = 1),
    t AS (SELECT n.name, f.*, 1 AS tier FROM names n JOIN f ON f.id = n.name UNION ALL SELECT n.name, f.*, 2 FROM names n JOIN f ON f.filename = n.name
      UNION ALL SELECT n.name, f.*, CASE WHEN starts_with(lower(f.filename), lower(n.name)) THEN 3 ELSE 4 END FROM names n JOIN f ON contains(lower(f.filename), lower(n.name)))
    SELECT name, id, filename, tier FROM t QUALIFY row_number() OVER (PARTITION BY name ORDER BY tier, ingested_at DESC, id) = 1""")
def cut_name_resolution(spark, d):
    """Names cut inside words, and of one or two characters."""
    name = F.col("filename")
    cut = [F.left(name, F.lit(11)), F.substring(name, 3, 9), F.substring(F.upper(name), 12, 8), F.left(name, F.lit(2)), F.substring(name, 6, 1)]
    names = table(spark, d, "chunks").select("filename").distinct().select(F.explode(F.array(*cut)).alias("name"))
    return store.resolve(names, table(spark, d, "doc_files"))


@query("""WITH r AS (SELECT DISTINCT rec_id, routed_model, latency_ms FROM bench_results WHERE routed_model IS NOT NULL AND latency_ms >= 0)
    SELECT routed_model, CAST(greatest(1, round_even(avg(latency_ms / 1000.0), 0)) AS BIGINT) AS seconds FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY routed_model ORDER BY rec_id DESC) <= 3) GROUP BY 1""")
def last_three_mean(spark, d):
    r = table(spark, d, "bench_results").where("routed_model is not null and latency_ms >= 0").select("rec_id", "routed_model", "latency_ms").distinct()
    few = store.last_n(r, ["routed_model"], "rec_id", 3)
    return few.groupBy("routed_model").agg(F.greatest(F.lit(1), F.bround(F.avg(F.col("latency_ms") / 1000.0), 0)).cast("long").alias("seconds"))


STEPS = """steps AS (SELECT session_id, id, content, CASE WHEN ts >= 100000000000 THEN ts // 1000 ELSE ts END AS sec,
    CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'ai', 'bot') THEN 'assistant' WHEN lower(trim(role)) IN ('tool', 'function') THEN 'tool' WHEN lower(trim(role)) = 'system' THEN 'system' ELSE 'unknown' END AS speaker
    FROM (SELECT DISTINCT session_id, id, role, content, ts FROM messages WHERE session_id IS NOT NULL))"""
ORDER = "(PARTITION BY session_id ORDER BY sec, id, content NULLS FIRST)"


def session_steps(spark, d):
    return events.steps(table(spark, d, "messages"))


@query(f"WITH {STEPS} SELECT session_id, speaker, content FROM steps WHERE content IS NOT NULL QUALIFY row_number() OVER (PARTITION BY session_id, speaker ORDER BY sec DESC, id DESC, content DESC) = 1")
def latest_by_speaker(spark, d):
    rows = session_steps(spark, d).where("content is not null")
    return rows.groupBy("session_id", "speaker").agg(F.max_by("content", F.struct("at", "id", "content")).alias("content"))


@query(f"WITH {STEPS} SELECT session_id, id, sec, speaker FROM steps QUALIFY row_number() OVER {ORDER} <= 20")
def trail_heads(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy("at", "id", "content")
    return session_steps(spark, d).withColumn("place", F.row_number().over(w)).where("place <= 20").select("session_id", "id", F.col("at").alias("sec"), "speaker")


@query(f"WITH {STEPS} SELECT CAST(to_timestamp(sec) AS DATE) AS day, speaker, count(*) AS steps, sum(coalesce(length(content), 0)) AS chars FROM steps WHERE speaker IN ('user', 'assistant') GROUP BY 1, 2")
def talk_per_day(spark, d):
    rows = session_steps(spark, d).where(F.col("speaker").isin("user", "assistant"))
    return rows.groupBy(F.to_date(F.timestamp_seconds("at")).alias("day"), "speaker").agg(F.count("*").alias("steps"), F.sum(F.coalesce(F.length("content"), F.lit(0))).alias("chars"))


@query(r"""WITH f AS (SELECT DISTINCT id, regexp_extract(filename, '^([A-Z]+)-[0-9]{4}', 1) AS prefix, CAST(regexp_extract(filename, '^[A-Z]+-([0-9]{4})', 1) AS INTEGER) AS year FROM doc_files WHERE regexp_matches(filename, '^[A-Z]+-[0-9]{4}'))
    SELECT prefix, year, count(*) + 1 AS next_no, printf('%s-%d-%04d', prefix, year, count(*) + 1) AS reference FROM f GROUP BY prefix, year""")
def next_references(spark, d):
    f = table(spark, d, "doc_files").where(F.col("filename").rlike("^[A-Z]+-[0-9]{4}")).select("id", F.regexp_extract("filename", "^([A-Z]+)-([0-9]{4})", 1).alias("prefix"), F.regexp_extract("filename", "^([A-Z]+)-([0-9]{4})", 2).cast("int").alias("year"))
    n = f.groupBy("prefix", "year").agg((F.count_distinct("id") + 1).alias("next_no"))
    return n.withColumn("reference", F.format_string("%s-%d-%04d", "prefix", "year", "next_no"))


@query("SELECT source, count(DISTINCT id) AS files FROM doc_files WHERE ingested_at >= epoch(TIMESTAMP '2026-01-01') AND ingested_at < epoch(TIMESTAMP '2027-01-01') GROUP BY 1")
def files_of_year(spark, d):
    return table(spark, d, "doc_files").where(store.half_open_year(F.col("ingested_at"), 2026)).groupBy("source").agg(F.count_distinct("id").alias("files"))


@query("""WITH o AS (SELECT DISTINCT id, source, indexed, pages FROM doc_files WHERE NOT scanned), n AS (SELECT DISTINCT id, source, TRUE AS indexed, pages + 1 AS pages FROM doc_files WHERE scanned OR pages > 5)
    SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.id = o.id AND n.source = o.source) UNION ALL SELECT * FROM n""")
def upserted_files(spark, d):
    f = table(spark, d, "doc_files")
    old = f.where("not scanned").select("id", "source", "indexed", "pages").distinct()
    new = f.where("scanned or pages > 5").select("id", "source", F.lit(True).alias("indexed"), (F.col("pages") + 1).alias("pages")).distinct()
    return store.upsert(old, new, ["id", "source"])


@query("SELECT id, doc_id, chunk_index FROM chunks WHERE doc_id NOT IN (SELECT id FROM doc_files WHERE NOT indexed)")
def cascade_delete(spark, d):
    return store.delete(table(spark, d, "chunks").select("id", "doc_id", "chunk_index"), table(spark, d, "doc_files").where("not indexed"), "id", "doc_id")


@query("""SELECT id, doc_id, chunk_index, coalesce(last_value(nullif(section, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page, chunk_index, id ROWS UNBOUNDED PRECEDING), '') AS section FROM chunks""")
def running_sections(spark, d):
    return store.forward_fill(table(spark, d, "chunks"), ["doc_id"], ["page", "chunk_index", "id"], "section").select("id", "doc_id", "chunk_index", "section")


@query("""WITH p AS (SELECT DISTINCT doc_id, page, text, scanned, mean_conf FROM doc_pages)
    SELECT doc_id, round(coalesce(sum(mean_conf * length(text)) / nullif(sum(length(text)) FILTER (WHERE mean_conf IS NOT NULL), 0), 1.0), 6) AS weighted_conf, round(coalesce(avg(mean_conf) FILTER (WHERE scanned), 1.0), 6) AS scanned_conf,
      coalesce(list_sort(list(page) FILTER (WHERE mean_conf < 0.6)), []) AS low_pages FROM p GROUP BY 1""")
def page_confidence(spark, d):
    p = table(spark, d, "doc_pages").select("doc_id", "page", "text", "scanned", "mean_conf").distinct()
    length = F.when(F.col("mean_conf").isNotNull(), F.length("text"))
    return p.groupBy("doc_id").agg(
        F.round(F.coalesce(F.try_divide(F.sum(F.col("mean_conf") * F.length("text")), F.nullif(F.sum(length), F.lit(0))), F.lit(1.0)), 6).alias("weighted_conf"),
        F.round(F.coalesce(F.avg(F.when(F.col("scanned"), F.col("mean_conf"))), F.lit(1.0)), 6).alias("scanned_conf"),
        F.array_sort(F.collect_list(F.when(F.col("mean_conf") < 0.6, F.col("page")))).alias("low_pages"),
    )


ONCE = "once AS (SELECT DISTINCT * FROM bench_results)"


def bench_once(spark, d, *columns):
    return table(spark, d, "bench_results").select("rec_id", *columns).distinct()


@query(f"""WITH {ONCE} SELECT routed_model, count(*) AS n, round_even(avg(CAST(success AS DOUBLE)), 3) AS success_rate, round_even(avg(CAST(task_type = routed_task AS DOUBLE)), 3) AS route_accuracy,
    round_even(avg(CASE WHEN latency_ms >= 0 THEN latency_ms END), 0) AS avg_latency_ms FROM once GROUP BY 1""")
def bench_summary(spark, d):
    return events.bench_summary(bench_once(spark, d, "routed_model", "task_type", "routed_task", "success", "latency_ms"), ["routed_model"])


@query(f"""WITH {ONCE}, r AS (SELECT routed_model, latency_ms FROM once WHERE latency_ms >= 0), k AS (SELECT *, row_number() OVER (PARTITION BY routed_model ORDER BY latency_ms) AS i, count(*) OVER (PARTITION BY routed_model) AS n FROM r)
    SELECT routed_model, count(*) AS n, round(avg(latency_ms), 1) AS mean_ms, median(latency_ms) AS p50_ms, max(CASE WHEN i = greatest(1, CAST(floor(n * 0.95) AS BIGINT)) THEN latency_ms END) AS p95_ms, max(latency_ms) AS max_ms FROM k GROUP BY 1""")
def latency_summary(spark, d):
    return evaluate.latencies(bench_once(spark, d, "routed_model", "latency_ms").where("latency_ms >= 0"), ["routed_model"], "latency_ms")


TYPES = ("code", "data", "document", "general", "vision")


@query(f"WITH {ONCE} SELECT routed_model, " + ", ".join(f"round(avg(CASE WHEN task_type = '{t}' THEN CAST(success AS DOUBLE) END), 6) AS {t}" for t in TYPES) + " FROM once GROUP BY 1")
def success_pivot(spark, d):
    rows = bench_once(spark, d, "routed_model", "task_type", "success").withColumn("ok", F.col("success").cast("double"))
    return rows.groupBy("routed_model").pivot("task_type", list(TYPES)).agg(F.round(F.avg("ok"), 6))


@query(f"WITH {ONCE} SELECT routed_task, task_type, count(*) AS n FROM once GROUP BY 1, 2")
def label_confusion(spark, d):
    return bench_once(spark, d, "routed_task", "task_type").groupBy("routed_task", "task_type").agg(F.count("*").alias("n"))


@query(f"""WITH {ONCE}, r AS (SELECT run_id, success, sum(CAST(success AS INTEGER)) OVER (PARTITION BY run_id ORDER BY ts, rec_id) AS island FROM once WHERE success IS NOT NULL),
    s AS (SELECT run_id, island, count(*) AS run FROM r WHERE NOT success GROUP BY 1, 2) SELECT run_id, count(*) FILTER (WHERE run >= 3) AS streaks, max(run) AS longest FROM s GROUP BY 1""")
def failure_streaks(spark, d):
    return events.failure_streaks(bench_once(spark, d, "run_id", "ts", "success"), "run_id", ["ts", "rec_id"], "success")


@query(rf"""WITH o AS (SELECT DISTINCT rec_id, kind, answer, stop FROM redteam_results),
    g AS (SELECT kind, coalesce(stop <> 'error', TRUE) AND CASE kind WHEN 'honest' THEN coalesce({HONEST_SQL}, FALSE) WHEN 'absent' THEN regexp_replace(coalesce(answer, ''), '[\s\p{{Z}}\v]+', '', 'g') <> '' WHEN 'code' THEN coalesce(contains(answer, '```python'), FALSE) WHEN 'reject' THEN FALSE ELSE coalesce(stop = 'final_answer', FALSE) END AS ok FROM o)
    SELECT kind, count(*) AS total, count(*) FILTER (WHERE ok) AS passed FROM g GROUP BY 1""")
def graded_by_kind(spark, d):
    return events.graded(table(spark, d, "redteam_results")).groupBy("kind").agg(F.count("*").alias("total"), F.count_if("passed_again").alias("passed"))


@query(rf"""WITH o AS (SELECT DISTINCT rec_id, kind, coalesce(answer, '') AS answer, stop FROM redteam_results),
    g AS (SELECT kind, CASE WHEN stop = 'error' OR kind = 'reject' THEN FALSE WHEN kind = 'honest' AND NOT {HONEST_SQL} THEN FALSE WHEN kind = 'absent' AND regexp_replace(answer, '[\s\p{{Z}}\v]+', '', 'g') = '' THEN FALSE WHEN kind = 'code' AND NOT contains(answer, '```python') THEN FALSE
      WHEN kind IN ('fact', 'absent', 'honest', 'injection', 'cite', 'code') THEN NULL ELSE coalesce(stop = 'final_answer', FALSE) END AS ok FROM o)
    SELECT kind, count(*) AS total, count(*) FILTER (WHERE ok) AS passed, count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE ok IS NULL) AS unknown FROM g GROUP BY 1""")
def regraded_by_kind(spark, d):
    """What ``redteam_results`` lets the whole rules decide; it has none of the cases' inputs."""
    ok = F.col("passed_again")
    return events.regraded(table(spark, d, "redteam_results")).groupBy("kind").agg(F.count("*").alias("total"), F.count_if(ok).alias("passed"), F.count_if(~ok).alias("failed"), F.count_if(ok.isNull()).alias("unknown"))


CALLS = f"""{STEPS}, nxt AS (SELECT *, lead(speaker) OVER {ORDER} AS ns, lead(id) OVER {ORDER} AS ni, lead(sec) OVER {ORDER} AS na FROM steps),
calls AS (SELECT session_id, id AS call_id, regexp_extract(content, '^Calling ([A-Za-z0-9_]+)', 1) AS tool, CASE WHEN ns = 'tool' THEN ni END AS result_id, CASE WHEN ns = 'tool' THEN na - sec END AS wall_s
  FROM nxt WHERE speaker = 'assistant' AND regexp_matches(content, '^Calling [A-Za-z0-9_]'))"""


@query(f"WITH {CALLS} SELECT * FROM calls")
def call_results(spark, d):
    return events.call_results(session_steps(spark, d))


@query(f"WITH {CALLS} SELECT session_id, count(*) AS calls, sum(wall_s) AS wall_s FROM calls WHERE result_id IS NOT NULL GROUP BY 1")
def tool_times(spark, d):
    t = events.tool_times(events.call_results(session_steps(spark, d)))
    return t.select("session_id", "calls", F.aggregate(F.map_values("wall_by_tool"), F.lit(0).cast("long"), lambda a, x: a + x).alias("wall_s"))


@query(f"""WITH {STEPS}, c AS (SELECT *, lag(content, 1) OVER {ORDER} AS a, lag(content, 2) OVER {ORDER} AS b FROM steps WHERE speaker = 'assistant' AND starts_with(content, 'Calling ')) SELECT session_id, id FROM c WHERE content = a OR content = b""")
def repeated_calls(spark, d):
    return events.repeated_calls(session_steps(spark, d))


@query(f"WITH {STEPS}, g AS (SELECT session_id, speaker, greatest(0, sec - coalesce(lag(sec) OVER {ORDER}, sec)) AS gap FROM steps) SELECT session_id, speaker, count(*) AS steps, sum(gap) AS seconds FROM g GROUP BY 1, 2")
def session_phases(spark, d):
    return events.phases(session_steps(spark, d))


@query(f"WITH {STEPS}, a AS (SELECT session_id, min(sec) AS asked FROM steps WHERE speaker = 'user' GROUP BY 1) SELECT s.session_id, min(s.sec) - any_value(a.asked) AS first_reply_s FROM steps s JOIN a USING (session_id) WHERE s.speaker = 'assistant' AND s.sec >= a.asked GROUP BY 1")
def first_replies(spark, d):
    return events.first_replies(session_steps(spark, d))


@query(f"""WITH {STEPS} SELECT session_id, count(*) AS steps, first(speaker ORDER BY sec, id, content NULLS FIRST) IN ('system', 'user') AS opens, last(speaker ORDER BY sec, id, content NULLS FIRST) = 'assistant' AS closes, bool_and(speaker <> 'unknown') AS known FROM steps GROUP BY 1""")
def session_conformance(spark, d):
    return events.conformance(session_steps(spark, d))


@query(f"WITH {STEPS} SELECT session_id, CAST(sum(coalesce(length(content), 0)) // 4 AS BIGINT) AS tokens FROM steps GROUP BY 1")
def token_estimates(spark, d):
    return events.token_estimates(session_steps(spark, d))


@query(f"""WITH {STEPS}, p AS (SELECT *, row_number() OVER {ORDER} AS place, count(*) OVER (PARTITION BY session_id) AS n, coalesce(lag(speaker IN ('system', 'user')) OVER {ORDER}, FALSE) AS before FROM steps),
    k AS (SELECT *, (speaker IN ('system', 'user') AND (place = 1 OR (place = 2 AND before))) OR place > n - 4 OR n <= 6 AS kept FROM p)
    SELECT session_id, place, speaker, content FROM k WHERE kept UNION ALL
    SELECT session_id, min(place), 'system', 'Digest of earlier steps:' || chr(10) || string_agg('[' || speaker || '] ' || left(coalesce(content, ''), 200) || CASE WHEN length(content) > 200 THEN ' ...' ELSE '' END, chr(10) ORDER BY place) FROM k WHERE NOT kept GROUP BY 1""")
def compacted_sessions(spark, d):
    return events.compact(session_steps(spark, d))


@query("SELECT session_id, count(*) AS frames, count(*) AS good FROM messages WHERE session_id IS NOT NULL GROUP BY 1")
def frame_round_trip(spark, d):
    m = table(spark, d, "messages").where("session_id is not null")
    bodies = m.select("session_id", F.xxhash64("id", "content", "ts", "role").alias("x"), sinks.frame(F.lit("message"), F.struct("id", "role", "content", "ts")).alias("body"))
    parts = readers.frames(bodies.select(F.struct("session_id", "x", F.monotonically_increasing_id().alias("at")).alias("stream_id"), "body"))
    return parts.groupBy(F.col("stream_id.session_id").alias("session_id")).agg(F.count("*").alias("frames"), F.count_if("good").alias("good"))


VIEW_SQL = """SELECT session_id, count(*) AS steps, count(*) FILTER (WHERE s = 'user') AS asked, count(*) FILTER (WHERE s = 'assistant') AS said, count(*) FILTER (WHERE s = 'tool') AS tool_steps, sum(coalesce(length(content), 0)) AS chars, max(sec) AS last_at
    FROM (SELECT session_id, content, CASE WHEN ts >= 100000000000 THEN ts // 1000 ELSE ts END AS sec, CASE WHEN lower(trim(role)) IN ('user', 'human') THEN 'user' WHEN lower(trim(role)) IN ('assistant', 'ai', 'bot') THEN 'assistant' WHEN lower(trim(role)) IN ('tool', 'function') THEN 'tool' ELSE 'other' END AS s FROM messages WHERE session_id IS NOT NULL) GROUP BY 1"""


@query(VIEW_SQL)
def session_view(spark, d):
    return streams.batch_view(table(spark, d, "messages"))


@query(VIEW_SQL)
def session_view_stream(spark, d):
    import uuid

    path = f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"
    return streams.drained(streams.running_view(streams.read_messages(spark, f"{d}/messages.parquet")), path)


# --- Layout and blocks -----------------------------------------------------------------------------------------------

WIDE = rf"""{CELLS}, placed AS (SELECT *, coalesce(sum(length(text) + 2) OVER (PARTITION BY doc_id, page, line_no ORDER BY cell_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 5.0 AS x0 FROM cells)"""
RUNS = f"""{CELLS}, wide AS (SELECT DISTINCT doc_id, page, line_no FROM cells WHERE row_cells >= 3), isl AS (SELECT *, line_no - row_number() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS island FROM wide),
runs AS (SELECT doc_id, page, min(line_no) AS first_line, max(line_no) AS last_line, count(*) AS rows FROM isl GROUP BY doc_id, page, island HAVING count(*) >= 2),
tables AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY first_line) AS table_no, first_line, last_line, rows FROM runs)"""


@query(f"WITH {RUNS} SELECT * FROM tables")
def table_runs(spark, d):
    return layout.table_runs(page_cells(spark, d))


EDGES = f"""{WIDE}, gaps AS (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc_id, page ORDER BY x0) > 6.0 THEN 1 ELSE 0 END AS apart FROM placed WHERE row_cells >= 3),
grouped AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, page ORDER BY x0 RANGE UNBOUNDED PRECEDING) AS edge FROM gaps),
edges AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY edge) AS edge_no, x, n FROM (SELECT doc_id, page, edge, round(avg(x0), 6) AS x, count(*) AS n FROM grouped GROUP BY ALL HAVING count(*) >= 2))"""


@query(f"WITH {EDGES} SELECT * FROM edges")
def column_edges(spark, d):
    return layout.column_edges(page_cells(spark, d))


@query(f"""WITH {EDGES}, near AS (SELECT p.doc_id, p.page, p.line_no, p.cell_no, p.text, arg_min(e.edge_no, (abs(e.x - p.x0), e.edge_no)) AS edge_no FROM placed p JOIN edges e ON p.doc_id = e.doc_id AND p.page = e.page WHERE p.row_cells >= 3 GROUP BY ALL)
    SELECT doc_id, page, line_no, edge_no, string_agg(text, ' ' ORDER BY cell_no) AS text FROM near GROUP BY ALL""")
def nearest_columns(spark, d):
    placed = page_cells(spark, d)
    return layout.nearest_columns(placed, layout.column_edges(placed))


@query(rf"""WITH {CELLS}, l AS (SELECT doc_id, page, line_no, min(pos) AS x0, max(stop) AS x1 FROM (SELECT *, coalesce(sum(length(text) + 2) OVER w, 0) * 5.0 AS pos, (coalesce(sum(length(text) + 2) OVER w, 0) + length(text)) * 5.0 AS stop FROM cells WINDOW w AS (PARTITION BY doc_id, page, line_no ORDER BY cell_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) GROUP BY ALL),
    s AS (SELECT doc_id, page, count(*) AS n, count(*) FILTER (WHERE x0 < 160 AND x1 > 240) AS across, count(*) FILTER (WHERE x1 <= 240) AS l, count(*) FILTER (WHERE x0 >= 160) AS r FROM l GROUP BY ALL)
    SELECT doc_id, page, n >= 12 AND across = 0 AND l >= 5 AND l >= n * 0.25 AND r >= 5 AND r >= n * 0.25 AS two FROM s""")
def two_column_pages(spark, d):
    lines = page_cells(spark, d).groupBy("doc_id", "page", "line_no").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.lit(400.0).alias("width"))
    return layout.two_columns(lines)


@query(f"WITH {CELLS} SELECT doc_id, page, CAST(dense_rank() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS INTEGER) AS row_no, string_agg(text, ' ' ORDER BY cell_no) AS text FROM cells GROUP BY doc_id, page, line_no")
def reading_rows(spark, d):
    return layout.reading_rows(page_cells(spark, d))


@query(rf"""WITH {RUNS}, rows AS (SELECT t.doc_id, t.page, t.table_no, c.line_no - t.first_line AS nth, max(c.row_cells) AS k, '| ' || string_agg(replace(c.text, '|', '\|'), ' | ' ORDER BY cell_no) AS row FROM tables t JOIN cells c ON t.doc_id = c.doc_id AND t.page = c.page AND c.line_no BETWEEN t.first_line AND t.last_line GROUP BY ALL),
    w AS (SELECT doc_id, page, table_no, max(k) AS width, count(*) - 1 AS n FROM rows GROUP BY ALL), pad AS (SELECT r.*, w.width, w.n, row || repeat(' | ', CAST(w.width - k AS INTEGER)) || ' |' AS full_row FROM rows r JOIN w USING (doc_id, page, table_no)),
    head AS (SELECT doc_id, page, table_no, n, full_row || chr(10) || '|' || repeat(' --- |', CAST(width AS INTEGER)) AS h FROM pad WHERE nth = 0),
    body AS (SELECT doc_id, page, table_no, CAST((nth - 1) // 40 AS INTEGER) AS block, min(nth) AS first_row, max(nth) AS last_row, string_agg(full_row, chr(10) ORDER BY nth) AS b FROM pad WHERE nth > 0 GROUP BY ALL)
    SELECT h.doc_id, h.page, h.table_no, b.block, b.first_row, b.last_row, h.n AS rows, CASE WHEN h.n > 40 THEN printf('(rows %d-%d of %d)%s', b.first_row, b.last_row, h.n, chr(10)) ELSE '' END || h.h || chr(10) || b.b AS text FROM head h JOIN body b USING (doc_id, page, table_no)""")
def table_markdown(spark, d):
    placed = page_cells(spark, d)
    return markdown_of(placed, layout.table_runs(placed))


def markdown_of(placed, runs):
    inside = placed.join(runs, ["doc_id", "page"]).where("line_no between first_line and last_line")
    rows = inside.groupBy("doc_id", "page", "table_no", F.col("line_no").alias("row_no")).agg(F.transform(F.array_sort(F.collect_list(F.struct("cell_no", "text"))), lambda c: c["text"]).alias("cells"))
    return bx.markdown_tables(rows, ["doc_id", "page", "table_no"])


ALIGNED = f"""{CELLS}, wide AS (SELECT *, line_no - dense_rank() OVER (PARTITION BY doc_id, page ORDER BY line_no) AS island FROM cells WHERE row_cells >= 3),
widths AS (SELECT *, max(length(text)) OVER (PARTITION BY doc_id, page, island, row_cells, cell_no) AS widest FROM wide),
spots AS (SELECT *, coalesce(sum(widest + 2) OVER (PARTITION BY doc_id, page, line_no ORDER BY cell_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 5.0 AS x0 FROM widths),
gaps AS (SELECT *, CASE WHEN x0 - lag(x0) OVER (PARTITION BY doc_id, page, island ORDER BY x0) > 6.0 THEN 1 ELSE 0 END AS apart FROM spots),
numbered AS (SELECT *, sum(apart) OVER (PARTITION BY doc_id, page, island ORDER BY x0 RANGE UNBOUNDED PRECEDING) AS edge FROM gaps),
shared AS (SELECT doc_id, page, island FROM (SELECT doc_id, page, island, edge FROM numbered GROUP BY ALL HAVING count(*) >= 2) GROUP BY ALL HAVING count(*) >= 3),
runs AS (SELECT doc_id, page, min(line_no) AS first_line, max(line_no) AS last_line, count(DISTINCT line_no) AS rows FROM wide JOIN shared USING (doc_id, page, island) GROUP BY doc_id, page, island HAVING count(DISTINCT line_no) >= 2),
tables AS (SELECT doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY first_line) AS table_no, first_line, last_line, rows FROM runs)"""


@query(f"WITH {ALIGNED} SELECT * FROM tables")
def aligned_tables(spark, d):
    return layout.aligned_tables(layout.set_in_columns(page_cells(spark, d)))


@query(ORACLES["table_markdown"].replace(RUNS, ALIGNED))
def aligned_table_markdown(spark, d):
    placed = page_cells(spark, d)
    return markdown_of(placed, layout.aligned_tables(layout.set_in_columns(placed)))


def page_blocks(spark, d) -> DataFrame:
    """Pages as blocks: paragraphs between blank lines, headings where a paragraph's first line looks like one."""
    pages = table(spark, d, "doc_pages").where("text is not null").select("doc_id", "page", "text", "mean_conf").distinct()
    first = F.substring_index("text", "\n", 1)
    parts = bx.plain_blocks(pages.select("doc_id", "page", "text"))
    heading = bx.looks_like_heading(first)
    parts = parts.withColumn("section", F.when(heading, first).otherwise(""))
    parts = store.forward_fill(parts, ["doc_id"], ["page", "ord"], "section")
    low = pages.groupBy("doc_id", "page").agg(F.bool_or(F.col("mean_conf") < 0.6).alias("low_conf"))
    return parts.join(low, ["doc_id", "page"])


@query(r"""WITH p AS (SELECT DISTINCT doc_id, page, regexp_replace(text, '\r\n?', chr(10), 'g') AS text FROM doc_pages WHERE text IS NOT NULL),
    b AS (SELECT doc_id, page, generate_subscripts(l, 1) - 1 AS ord, regexp_replace(unnest(l), '^[\s\p{Z}\v]+|[\s\p{Z}\v]+$', '', 'g') AS text FROM (SELECT doc_id, page, string_split(text, chr(10) || chr(10)) AS l FROM p))
    SELECT doc_id, page, CAST(ord AS INTEGER) AS ord, 'paragraph' AS kind, text, '' AS section FROM b WHERE text <> ''""")
def plain_blocks(spark, d):
    return bx.plain_blocks(table(spark, d, "doc_pages").where("text is not null").select("doc_id", "page", "text").distinct())


@query(r"""WITH p AS (SELECT DISTINCT doc_id, page, regexp_replace(text, '\r\n?', chr(10), 'g') AS text FROM doc_pages WHERE text IS NOT NULL),
    b AS (SELECT doc_id, page, generate_subscripts(l, 1) AS ord, regexp_replace(unnest(l), '^[\s\p{Z}\v]+|[\s\p{Z}\v]+$', '', 'g') AS text FROM (SELECT doc_id, page, string_split(text, chr(10) || chr(10)) AS l FROM p))
    SELECT doc_id, page, string_agg(text, chr(10) || chr(10) ORDER BY ord) AS text FROM b WHERE text <> '' GROUP BY 1, 2""")
def page_texts(spark, d):
    return bx.page_text(plain_blocks(spark, d))


@query()
def chunk_fold(spark, d):
    return bx.chunks(page_blocks(spark, d)).drop("text")


@query()
def sheets(spark, d):
    return bx.paginate(plain_blocks(spark, d))


# --- Retrieval -------------------------------------------------------------------------------------------------------

BM25 = f"""toks AS (SELECT doc_id AS id, unnest({TOKENS}) AS tok FROM documents WHERE text IS NOT NULL), posts AS (SELECT id, tok, count(*) AS tf FROM toks GROUP BY ALL),
lens AS (SELECT d.doc_id AS id, coalesce(t.dl, 0) AS dl FROM documents d LEFT JOIN (SELECT id, count(*) AS dl FROM toks GROUP BY 1) t ON d.doc_id = t.id),
raw AS (SELECT tok, count(*) AS df, ln((SELECT count(*) FROM lens) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM posts GROUP BY tok),
stats AS (SELECT tok, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw)"""


def corpus(spark, d):
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", "filename", "source")


def corpus_index(spark, d) -> str:
    return bm25.refreshed(table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text"), "documents", table(spark, d, "documents"))


@query(f"WITH {BM25} SELECT tok, df, round(idf, 9) AS idf FROM stats")
def bm25_term_stats(spark, d):
    return bm25.terms(spark, corpus_index(spark, d)).select("tok", "df", F.round("idf", 9).alias("idf"))


SPARSE = f"""{BM25}, q AS (SELECT query_id, tok, count(*) AS asked FROM (SELECT item_id AS query_id, unnest({TOKENS}) AS tok FROM eval_items WHERE item_id % 50 = 0) GROUP BY ALL),
scored AS (SELECT q.query_id, p.id, round(sum(q.asked * s.idf * p.tf * 2.5 / (p.tf + 1.5 * (1 - 0.75 + 0.75 * l.dl / (SELECT avg(dl) FROM lens)))), 6) AS score FROM q JOIN posts p USING (tok) JOIN stats s USING (tok) JOIN lens l ON p.id = l.id GROUP BY 1, 2),
sparse AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 30),
found AS (SELECT * FROM sparse WHERE score > 0)"""


def asked(spark, d):
    return table(spark, d, "eval_items").where("item_id % 50 = 0").select(F.col("item_id").alias("query_id"), "text")


@query(f"WITH {SPARSE} SELECT query_id, id, score, rank FROM found")
def bm25_search(spark, d):
    return bm25.search(spark, corpus_index(spark, d), asked(spark, d))


DENSE = """qv AS (SELECT vec_id AS query_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id % 50 = 0), dv AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
dense AS (SELECT query_id, id, round(list_cosine_similarity(qv.v, dv.v), 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(list_cosine_similarity(qv.v, dv.v), 6) DESC, id) AS rank FROM qv, dv QUALIFY rank <= 30)"""


def vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query(f"WITH {DENSE} SELECT * FROM dense")
def dense_search(spark, d):
    v = vectors(spark, d)
    return dense.search(v, v.where("id % 50 = 0").select(F.col("id").alias("query_id"), "vector"))


HYBRID = f"""{SPARSE}, {DENSE}, lists AS (SELECT query_id, id, 'sparse' AS source, rank FROM found UNION ALL SELECT query_id, id, 'dense', rank FROM dense WHERE query_id IN (SELECT item_id FROM eval_items)),
fused AS (SELECT query_id, id, round(sum(1.0 / (60 + rank)), 12) AS score, max(CASE WHEN source = 'dense' THEN rank END) AS dense_rank, max(CASE WHEN source = 'sparse' THEN rank END) AS sparse_rank, array_to_string(list_sort(list(source)), ',') AS sources FROM lists GROUP BY 1, 2)"""


def query_vectors(spark, d):
    """A declared mapping, as the tables share no key: an item's vector is the embedding of the same number."""
    return vectors(spark, d).join(asked(spark, d), F.col("id") == F.col("query_id"), "left_semi").select(F.col("id").alias("query_id"), "vector")


@query(f"WITH {HYBRID} SELECT query_id, id, score, dense_rank, sparse_rank, sources, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM fused QUALIFY rank <= 30")
def fused_ranks(spark, d):
    lists = {"dense": dense.search(vectors(spark, d), query_vectors(spark, d)), "sparse": bm25.search(spark, corpus_index(spark, d), asked(spark, d))}
    f = fusion.fuse(lists)
    return f.select("query_id", "id", "score", F.col("ranks")["dense"].alias("dense_rank"), F.col("ranks")["sparse"].alias("sparse_rank"), F.array_join("sources", ",").alias("sources"), "rank")


@query(rf"""WITH {HYBRID}, top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS r FROM fused QUALIFY r <= 30)
    SELECT t.query_id, t.id, t.score, row_number() OVER (PARTITION BY t.query_id ORDER BY t.score DESC, t.id) AS rank, t.dense_rank, t.sparse_rank, d.filename FROM top t JOIN documents d ON t.id = d.doc_id WHERE d.filename IS NOT NULL AND d.filename <> '' QUALIFY rank <= 10""")
def hybrid_search(spark, d):
    h = fusion.hybrid(corpus(spark, d), vectors(spark, d), asked(spark, d), query_vectors(spark, d), top_k=10, index=corpus_index(spark, d))
    return h.select("query_id", "id", "score", "rank", "dense_rank", "sparse_rank", "filename")


def title_hits(spark, d) -> DataFrame:
    """Title search: every file whose number is divisible by 50 is asked for by its first page's first line."""
    number = F.conv(F.substring("id", -6, 6), 16, 10).cast("long")
    files = table(spark, d, "doc_files").where(number % 50 == 0).select("id", "filename", "source").distinct()
    first = table(spark, d, "doc_pages").where("page = 1 and text is not null").select(F.col("doc_id").alias("id"), F.substring_index(F.ltrim("text"), "\n", 2).alias("text")).distinct()
    questions = files.join(first, "id").groupBy(F.col("id").alias("query_id")).agg(F.min("text").alias("text"), F.min("filename").alias("expected_doc"), F.min("source").alias("kind"))
    chunks = table(spark, d, "chunks").select("id", "text", "filename", "page", "page_end", "doc_id", "section")
    index = bm25.refreshed(table(spark, d, "chunks").select("id", "text"), "chunks", table(spark, d, "chunks"))
    found = bm25.search(spark, index, questions.select("query_id", "text"), limit=10)
    return found.join(chunks, "id"), questions.select("query_id", "expected_doc", "kind", F.col("text").alias("question"), F.lit(1).alias("expected_page"))


TITLES = f"""f AS (SELECT DISTINCT id, filename, source FROM doc_files WHERE CAST('0x' || right(id, 6) AS BIGINT) % 50 = 0), one AS (SELECT DISTINCT doc_id AS id, array_to_string(list_slice(string_split(ltrim(text), chr(10)), 1, 2), chr(10)) AS text FROM doc_pages WHERE page = 1 AND text IS NOT NULL),
qs AS (SELECT f.id AS query_id, min(one.text) AS text, min(filename) AS expected_doc, min(source) AS kind FROM f JOIN one USING (id) GROUP BY 1),
toks AS (SELECT id, unnest({TOKENS}) AS tok FROM chunks WHERE text IS NOT NULL), posts AS (SELECT id, tok, count(*) AS tf FROM toks GROUP BY ALL),
lens AS (SELECT d.id, coalesce(t.dl, 0) AS dl FROM chunks d LEFT JOIN (SELECT id, count(*) AS dl FROM toks GROUP BY 1) t USING (id)),
raw AS (SELECT tok, ln((SELECT count(*) FROM lens) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM posts GROUP BY tok), stats AS (SELECT tok, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf FROM raw),
q AS (SELECT query_id, tok, count(*) AS asked FROM (SELECT query_id, unnest({TOKENS}) AS tok FROM qs) GROUP BY ALL),
scored AS (SELECT q.query_id, p.id, round(sum(q.asked * s.idf * p.tf * 2.5 / (p.tf + 1.5 * (1 - 0.75 + 0.75 * l.dl / (SELECT avg(dl) FROM lens)))), 6) AS score FROM q JOIN posts p USING (tok) JOIN stats s USING (tok) JOIN lens l ON p.id = l.id GROUP BY 1, 2),
hits AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored QUALIFY rank <= 10),
firsts AS (SELECT qs.query_id, qs.kind, min(CASE WHEN c.page <= 1 AND coalesce(c.page_end, c.page) >= 1 THEN h.rank END) AS first, min(CASE WHEN c.page = 1 THEN h.rank END) AS exact
  FROM qs LEFT JOIN (SELECT h.*, c.filename, c.page, c.page_end FROM hits h JOIN chunks c USING (id) WHERE h.score > 0) h ON h.query_id = qs.query_id AND h.filename = qs.expected_doc LEFT JOIN chunks c ON c.id = h.id GROUP BY 1, 2)"""


@query(f"""WITH {TITLES} SELECT count(*) AS n, round(avg(CASE WHEN first <= 1 THEN 1 ELSE 0 END), 4) AS recall_at_1, round(avg(CASE WHEN first <= 3 THEN 1 ELSE 0 END), 4) AS recall_at_3, round(avg(CASE WHEN first <= 5 THEN 1 ELSE 0 END), 4) AS recall_at_5,
    round(avg(CASE WHEN first <= 10 THEN 1 ELSE 0 END), 4) AS recall_at_10, round(avg(coalesce(1.0 / first, 0)), 4) AS mrr, round(avg(CASE WHEN exact <= 5 THEN 1 ELSE 0 END), 4) AS exact_at_5 FROM firsts""")
def retrieval_summary(spark, d):
    hits, questions = title_hits(spark, d)
    return evaluate.summary(evaluate.first_hits(hits, questions))


@query(f"WITH {TITLES} SELECT kind, count(*) AS n, sum(CASE WHEN first <= 5 THEN 1 ELSE 0 END) AS hits, round(avg(CASE WHEN first <= 5 THEN 1 ELSE 0 END), 3) AS recall_at_5 FROM firsts GROUP BY 1")
def retrieval_by_kind(spark, d):
    hits, questions = title_hits(spark, d)
    return evaluate.by_kind(evaluate.first_hits(hits, questions))


@query()
def search_payloads(spark, d):
    hits, questions = title_hits(spark, d)
    return snippets.payloads(hits.join(questions.select("query_id", "question"), "query_id"))


@query()
def search_citations(spark, d):
    return snippets.citations(search_payloads(spark, d))


@query()
def answers_in_payloads(spark, d):
    hits, questions = title_hits(spark, d)
    contents = snippets.payloads(hits.join(questions.select("query_id", "question"), "query_id"))
    return evaluate.answer_present(contents.join(questions.select("query_id", F.col("question").alias("answer")), "query_id").withColumnRenamed("content", "output"))


# --- Classification --------------------------------------------------------------------------------------------------

@query()
def routing_accuracy(spark, d):
    """Held-out accuracy by task type of a classifier of sessions by their titles."""
    labelled = table(spark, d, "sessions").where("task_type is not null and title <> ''").select("session_id", "title", "task_type")
    parts = routing.split(labelled, "task_type", "session_id")
    model = routing.fit(parts.where("not held_out"), "title", "task_type", "session_id")
    told = routing.classify(model, parts.where("held_out"), "task_type")
    return told.groupBy("task_type").agg(F.count("*").alias("n"), F.round(F.avg((F.col("predicted") == F.col("task_type")).cast("double")), 4).alias("accuracy"), F.round(F.avg("confidence"), 4).alias("confidence"))


@query()
def classified_sessions(spark, d):
    """Every session, labelled or not, with the task type that its title suggests."""
    rows = table(spark, d, "sessions").select("session_id", F.coalesce("title", F.lit("")).alias("title"), "task_type")
    model = routing.fit(rows.where("task_type is not null and title <> ''"), "title", "task_type", "session_id")
    told = routing.classify(model, rows.withColumn("given", F.col("task_type")), "task_type")
    return told.select("session_id", F.col("given").alias("task_type"), "predicted", "confidence")


@query(f"""WITH {ONCE}, m AS (SELECT routed_model AS model_id, CAST(median(tokens_in) AS BIGINT) AS size_mb FROM once WHERE routed_model IS NOT NULL GROUP BY 1), c AS (SELECT routed_model AS model_id, task_type AS need FROM once WHERE task_type IS NOT NULL AND routed_model IS NOT NULL GROUP BY ALL HAVING avg(CAST(success AS DOUBLE)) >= 0.5),
    needs AS (SELECT DISTINCT task_type AS need FROM once WHERE task_type IS NOT NULL), l AS (SELECT need, list(model_id ORDER BY size_mb, model_id) FILTER (WHERE model_id IS NOT NULL) AS ids FROM needs LEFT JOIN (SELECT * FROM c JOIN m USING (model_id)) USING (need) GROUP BY 1)
    SELECT need, ids[1] AS model_id, array_to_string(coalesce(ids[2:], []), ',') AS alternatives FROM l""")
def capable_models(spark, d):
    rows = bench_once(spark, d, "routed_model", "task_type", "tokens_in", "success").where("task_type is not null")
    named = rows.where("routed_model is not null")
    size = bench_once(spark, d, "routed_model", "tokens_in").where("routed_model is not null").groupBy(F.col("routed_model").alias("model_id")).agg(F.percentile("tokens_in", F.lit(0.5)).cast("long").alias("size_mb"))
    able = named.groupBy(F.col("routed_model").alias("model_id"), "task_type").agg(F.avg(F.col("success").cast("double")).alias("rate")).where("rate >= 0.5")
    models = able.groupBy("model_id").agg(F.collect_set("task_type").alias("capabilities")).join(size, "model_id")
    out = routing.cheapest_capable(rows.select(F.col("task_type").alias("need")), models)
    return out.select("need", "model_id", F.array_join("alternatives", ",").alias("alternatives"))
