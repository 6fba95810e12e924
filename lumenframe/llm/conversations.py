"""Problem 3: conversations from message rows.

Method: rows that name a conversation belong to it; rows that lack the name are put together as connected components
over their reply and quote links (alternating large-star and small-star joins), and a component that is linked to a
named conversation joins it. Then the rows of each conversation are ordered and the conversation is validated. The
messages are read and cleaned once, as narrow rows (texts as hashes), and cut; ordering is a range sort over (conversation, time, id), so that a very long
conversation spreads over several tasks; each task sums up its stretch, and the few stretches of a conversation are
folded in order.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.session import cut, stored

#: Spellings of the speakers, lower case and trimmed. Any other spelling is a speaker that cannot be told.
SPEAKERS = {
    "user": ("user", "human"),
    "assistant": ("assistant", "ai", "bot", "model"),
    "tool": ("tool", "function"),
    "system": ("system", "developer"),
}
#: Times from here on are milliseconds (seconds would lie beyond the year 5000).
MILLISECONDS_FROM = 100_000_000_000
#: A quotation links two rows if it has so many words; shorter ones ("Yes, please.") are not told apart by their text.
QUOTE_WORDS = 5
#: Characters without a visible mark, as a Java character class: spaces, controls, formats, fillers, variation selectors.
INVISIBLE_CLASS = r"[\s\p{Z}\p{Cc}\p{Cf}\u034f\u115f\u1160\u3164\u2800\uffa0\ufe00-\ufe0f]"


def speaker(role: Column) -> Column:
    """The speaker that a role names: user, assistant, tool, system, or null if it cannot be told."""
    name = F.lower(F.regexp_replace(role, r"^[\s\p{Z}]+|[\s\p{Z}]+$", ""))
    out = F.lit(None).cast("string")
    for kind, spellings in SPEAKERS.items():
        out = F.when(name.isin(*spellings), kind).otherwise(out)
    return out


def whole_seconds(ts: Column) -> Column:
    return F.when(ts >= MILLISECONDS_FROM, F.floor(ts / 1000)).otherwise(ts).cast("long")


def visible(content: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(content, INVISIBLE_CLASS, "")) > 0, F.lit(False))


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node`` and ``component`` (the least node of its component) of every node in ``edges`` (columns u, v).

    Alternates large-star and small-star steps until the edges no longer change; each round is cut to the shared
    checkpoint folder. A hub's neighbours are never gathered: each step is a grouped minimum and a join.
    Self-loops keep single nodes; null ends are ignored; no edges give no rows.
    """
    edges = edges.where("u is not null and v is not null")
    nodes = edges.select(F.col("u").alias("node")).union(edges.select(F.col("v").alias("node"))).distinct()
    links = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    links = cut(links)
    before = None
    for _ in range(most_rounds):
        state = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before = state
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        links = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
    else:
        raise RuntimeError(f"components still change after {most_rounds} rounds")
    roots = links.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("component", "node").alias("component"))


def plain_words(text: Column) -> Column:
    """A text's words, lower case, set apart by one blank each."""
    return F.trim(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]+", " ")))


def quote_links(messages: DataFrame) -> DataFrame:
    """``u``, ``v``, ``session_id``: links by quotations, lines that begin with > and whose words another row's own lines
    hold in a row. A quotation is a node of its own (v), so that many rows with one text make as many links, not all
    pairs. ``u`` is an unnamed row's node; rows of a conversation give its name instead, and a quotation that stands in
    several conversations names none of them. Candidates come from an equi-join on the first words of the quotation."""
    rows = messages.where(visible(F.col("content"))).select("id", "session_id", "content")
    lines = lambda pattern: F.array_join(F.regexp_extract_all("content", F.lit(pattern), 1), " ")
    asks = rows.where(F.col("content").rlike(r"(?m)^>")).select("id", "session_id", plain_words(lines(r"(?m)^>+[ \t]?(.*)$")).alias("quote"))
    asks = asks.where(F.size(F.split("quote", " ")) >= QUOTE_WORDS)
    asks = asks.withColumn("first", F.xxhash64(F.substring_index("quote", " ", QUOTE_WORDS)))
    said = rows.select("id", "session_id", plain_words(lines(r"(?m)^(?!>)(.*)$")).alias("text")).withColumn("w", F.split("text", " ")).where(F.size("w") >= QUOTE_WORDS)
    starts = F.sequence(F.lit(1), F.size("w") - QUOTE_WORDS + 1)
    runs = said.select("id", "session_id", "text", F.explode(F.array_distinct(F.transform(starts, lambda i: F.xxhash64(F.array_join(F.slice("w", i, F.lit(QUOTE_WORDS)), " "))))).alias("first"))
    held = F.contains(F.concat(F.lit(" "), "text", F.lit(" ")), F.concat(F.lit(" "), "quote", F.lit(" ")))
    wanted = asks.select("quote", "first").distinct()
    sayers = runs.join(wanted, "first").where(held).select("id", "session_id", "quote")
    ends = sayers.unionByName(asks.select("id", "session_id", "quote")).withColumn("v", F.concat(F.lit("q:"), F.sha2("quote", 256)))
    owners = ends.where("session_id is not null").groupBy("v").agg(F.min("session_id").alias("owner"), F.max("session_id").alias("last")).where("owner = last").select("v", "owner")
    unnamed = ends.where("session_id is null").select(node(F.col("id")).alias("u"), "v").distinct()
    return unnamed.join(owners, "v", "left").select("u", "v", F.col("owner").alias("session_id"))


def node(id_col: Column) -> Column:
    return F.concat(F.lit("m:"), id_col.cast("string"))


def reply_links(messages: DataFrame, reply_col: str = "reply_to") -> DataFrame:
    """``u``, ``v``, ``session_id``: links of an unnamed row u by reply, either way round: to another unnamed row v, or to a
    row of a conversation."""
    rows = messages.select("id", "session_id", reply_col).distinct()
    asked = rows.where(F.col(reply_col).isNotNull()).select(F.col("id").alias("a"), F.col("session_id").alias("a_name"), F.col(reply_col).alias("b"))
    pairs = asked.join(rows.select(F.col("id").alias("b"), F.col("session_id").alias("b_name")).distinct(), "b").where("a_name is null or b_name is null")
    both = pairs.select("a", "a_name", "b", "b_name").unionByName(pairs.select(F.col("b").alias("a"), F.col("b_name").alias("a_name"), F.col("a").alias("b"), F.col("a_name").alias("b_name")))
    both = both.where("a_name is null").distinct()
    return both.select(node(F.col("a")).alias("u"), F.when(F.col("b_name").isNull(), node(F.col("b"))).otherwise(node(F.col("a"))).alias("v"), F.col("b_name").alias("session_id"))


def link_unnamed(messages: DataFrame, quoted: bool = True, reply_col: str = "reply_to") -> DataFrame:
    """``id_text``, ``conversation``, ``named`` of the rows without a conversation name: those joined by reply links (if the
    column is there) and quotations are one component. A component linked to rows of a conversation belongs to it (to
    the first by name, if there are several); others are called after their least row."""
    alone = messages.where("session_id is null and id is not null").select(node(F.col("id")).alias("u")).select("u", F.col("u").alias("v"), F.lit(None).cast("string").alias("session_id"))
    links = alone
    if reply_col in messages.columns:
        links = links.unionByName(reply_links(messages, reply_col))
    if quoted:
        links = links.unionByName(quote_links(messages))
    links = stored(links.distinct())
    parts = connected_components(links.select("u", "v")).where(F.col("node").startswith("m:"))
    names = links.where("session_id is not null").select(F.col("u").alias("node"), "session_id")
    owners = parts.join(names, "node").groupBy("component").agg(F.min("session_id").alias("owner"))
    told = parts.join(owners, "component", "left")
    own = F.concat(F.lit("linked-"), F.expr("substring(component, 3)"))
    return told.select(F.expr("substring(node, 3)").alias("id_text"), F.coalesce("owner", own).alias("conversation"), F.col("owner").isNotNull().alias("named"))


def assemble(messages: DataFrame, texts: bool = False) -> DataFrame:
    """The rows of all conversations, cleaned and cut: ``conversation``, ``named``, ``id``, ``speaker`` (null if it cannot be
    told), ``ts`` (whole seconds), ``seen`` (false: the one row that stands for a conversation's invisible rows), and
    ``content`` if ``texts`` are asked for. Rows equal in session, role, content and ts count once, with the lowest id.
    Extra columns are ignored."""
    seen = visible(F.col("content"))
    shown = lambda c: F.when(F.col("seen"), c)
    rows = messages.select("id", "session_id", "role", "content", "ts").withColumn("seen", seen).where("seen or session_id is not null")
    keyed = rows.select(
        "session_id", "seen", F.when(F.col("session_id").isNull(), F.col("id")).alias("own"), shown(F.col("role")).alias("role"), shown(F.col("ts")).alias("ts"),
        shown(F.xxhash64("content")).alias("h1"), shown(F.hash("content")).alias("h2"), shown(F.contains("content", F.lit(">"))).alias("marked"), "id", "content",
    )
    keys = ["session_id", "seen", "own", "role", "ts", "h1", "h2"]
    text = [F.min_by("content", "id").alias("content")] if texts else []
    once = stored(keyed.groupBy(*keys).agg(F.min("id").alias("id"), F.bool_or("marked").alias("marked"), *text))
    kept = ["id", "role", "ts", "h1", "h2", "seen", *(["content"] if texts else [])]
    named = once.where("session_id is not null").select(F.col("session_id").alias("conversation"), F.lit(True).alias("named"), *kept)
    unnamed = once.where("session_id is null")
    if unnamed.take(1):
        # The small table is asked, not the messages: without a mark in any row there is no quotation to look for.
        linked = stored(link_unnamed(messages, bool(once.where("marked").take(1))))
        own = unnamed.withColumn("id_text", F.col("id").cast("string")).join(linked, "id_text", "left")
        own = own.select(F.coalesce("conversation", F.lit("linked-")).alias("conversation"), F.coalesce("named", F.lit(False)).alias("named"), *kept)
        again = lambda df: df.groupBy("conversation", "named", "role", "ts", "h1", "h2", "seen").agg(F.min("id").alias("id"), *text)
        # Only where a row joins a named conversation, its equals among the named rows must be looked for.
        joined = bool(linked.where("named").take(1))
        named = again(named.unionByName(own)) if joined else named.unionByName(again(own).select(*named.columns))
    columns = ["conversation", "named", "id", speaker(F.col("role")).alias("speaker"), whole_seconds(F.col("ts")).alias("ts"), "seen"]
    return named.select(*columns, *(["content"] if texts else []))


ORDER = ("conversation", "named", "ts", "id")
SUMMARY = "conversation string, named boolean, at long, turns long, spoken long, unknown boolean, first string, head string, open boolean, missing boolean"


def in_order(rows: DataFrame) -> DataFrame:
    """Rows sorted by conversation, time and id, a conversation in one or more neighbouring partitions."""
    return rows.repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)


def stretches(rows: DataFrame) -> DataFrame:
    """One row for each conversation and partition of the sorted rows: what is needed of the stretch to judge the whole.
    ``first``: speaker of its first row that is not system; ``head``: the first of user and assistant; ``open``: its
    last user row has no reply yet; ``missing``: a user row was followed by another before a reply."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, key, state = TaskContext.get().partitionId(), None, None
        done: list[tuple] = []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done, strict=True))
            done.clear()
            kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
            names = [f.split()[0] for f in SUMMARY.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for batch in batches:
            for own, named, who in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if (own, named) != key:
                    if key is not None:
                        done.append((*key, part, *state))
                    key, state = (own, named), [0, 0, False, None, None, False, False]
                state[0] += 1
                if who not in ("system", "tool"):
                    state[1] += 1
                if who is None:
                    state[2] = True
                if who != "system" and state[3] is None:
                    state[3] = who or "unknown"
                if who in ("user", "assistant"):
                    state[4] = state[4] or who
                    if who == "user":
                        state[6] = state[6] or state[5]
                    state[5] = who == "user"
            if len(done) > 10_000:
                yield out()
        if key is not None:
            done.append((*key, part, *state))
        if done:
            yield out()

    return in_order(rows).select("conversation", "named", "speaker").mapInArrow(run, SUMMARY)


def judge(rows: DataFrame) -> DataFrame:
    """``conversation``, ``named``, ``turns`` and ``reason`` (null: sound) of each conversation in assembled rows."""
    parts = F.array_sort(F.collect_list(F.struct("at", "turns", "spoken", "unknown", "first", "head", "open", "missing")))
    start = F.expr("named_struct('turns', 0L, 'spoken', 0L, 'unknown', false, 'first', cast(null as string), 'open', false, 'missing', false)")

    def step(a: Column, x: Column) -> Column:
        return F.struct(
            (a["turns"] + x["turns"]).alias("turns"),
            (a["spoken"] + x["spoken"]).alias("spoken"),
            (a["unknown"] | x["unknown"]).alias("unknown"),
            F.coalesce(a["first"], x["first"]).alias("first"),
            F.when(x["head"].isNull(), a["open"]).otherwise(x["open"]).alias("open"),
            (a["missing"] | x["missing"] | (a["open"] & F.coalesce(x["head"] == "user", F.lit(False)))).alias("missing"),
        )

    whole = stretches(rows).groupBy("conversation", "named").agg(parts.alias("parts"))
    whole = whole.select("conversation", "named", F.aggregate("parts", start, step).alias("s"))
    reason = (
        F.when(F.col("s.spoken") == 0, "empty")
        .when(F.col("s.unknown") | ~F.coalesce(F.col("s.first") == "user", F.lit(False)), "broken")
        .when(F.col("s.missing") | F.col("s.open"), "missing_reply")
    )
    return whole.select("conversation", "named", F.col("s.turns").alias("turns"), reason.alias("reason"))


def rejected(messages: DataFrame, sessions: DataFrame | None = None) -> DataFrame:
    """``session_id`` and ``reason`` of each named conversation that must be dropped, with the first reason that holds:
    ``empty`` (no row is left, system and tool rows aside), ``broken`` (a speaker cannot be told, or the first row that
    is not system is not the user's), ``missing_reply`` (a user row without an assistant row before the next user row
    or the end). Conversations of ``sessions`` without a row are empty. Null names name nothing; a null role is a
    speaker that cannot be told; equal times are ordered by id; a null time comes first; no rows give no rows."""
    rows = assemble(messages)
    names = rows.where("named").select(F.col("conversation").alias("session_id"))
    if sessions is not None:
        names = names.unionByName(sessions.where("session_id is not null").select("session_id"))
    judged = judge(rows.where("seen")).where("named").select(F.col("conversation").alias("session_id"), "turns", "reason")
    kept = names.distinct().join(judged, "session_id", "left")
    return kept.select("session_id", F.when(F.col("turns").isNull(), "empty").otherwise(F.col("reason")).alias("reason")).where("reason is not null")


def conversations(messages: DataFrame) -> DataFrame:
    """The rows of all sound conversations: ``conversation``, ``named`` (false: put together by links), ``turn`` (from
    1), ``speaker``, ``content``, ``ts``, ``id``. Turn numbers are a stretch's own count plus the rows of the stretches
    before it, so a long conversation is numbered by several tasks."""
    rows = assemble(messages, texts=True).where("seen").drop("seen")
    sound = rows.join(judge(rows).where("reason is null").select("conversation", "named"), ["conversation", "named"], "left_semi")
    # Cut, as the numbering below needs one and the same partitioning twice.
    placed = cut(in_order(sound)).withColumn("at", F.spark_partition_id())
    from pyspark.sql import Window

    stretch = Window.partitionBy("conversation", "named", "at").orderBy("ts", "id", "speaker", F.xxhash64("content"))
    before = Window.partitionBy("conversation", "named").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    sizes = placed.groupBy("conversation", "named", "at").count().withColumn("before", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    numbered = placed.withColumn("own", F.row_number().over(stretch)).join(sizes, ["conversation", "named", "at"])
    return numbered.select("conversation", "named", (F.col("before") + F.col("own")).cast("long").alias("turn"), "speaker", "content", "ts", "id")
