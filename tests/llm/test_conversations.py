"""Conversations: reasons, links, components against brute force, hot sessions over several tasks."""

from __future__ import annotations

import random

from lumenframe.llm import conversations as c

SCHEMA = "id long, session_id string, role string, content string, ts long"


def found(spark, rows, sessions=()):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as conversation", "true as named")
    names = spark.createDataFrame([(s,) for s in sessions], "session_id string") if sessions else None
    return {r["session_id"]: r["reason"] for r in c.rejected(df, names).collect()}


def test_reasons_in_order(spark):
    rows = [
        (1, "ok", "System", "s", 10), (2, "ok", "human", "q", 11), (3, "ok", "AI", "a", 12),
        (4, "swap", "assistant", "a", 1_700_000_005_000), (5, "swap", "user", "q", 1_700_000_004),
        (6, "who", "user", "q", 1), (7, "who", "???", "x", 2), (8, "who", "bot", "a", 3),
        (9, "first", "tool", "t", 1), (10, "first", "user", "q", 2), (11, "first", "bot", "a", 3),
        (12, "open", "user", "q", 1), (13, "open", "user", "r", 2), (14, "open", "bot", "a", 3),
        (15, "end", "user", "q", 1), (16, "blank", "user", "q", 1), (17, "blank", "assistant", "​  \n", 2),
        (18, "none", "system", "s", 1), (19, "none", "function", "t", 2), (20, "dup", "user", "q", 1), (21, "dup", "assistant", "a", 1), (22, "dup", "user", "q", 1),
        (23, None, "user", "lost", 1), (24, "nul", None, "x", None), (25, "gone", "user", None, 5),
    ]
    want = {"who": "broken", "first": "broken", "open": "missing_reply", "end": "missing_reply", "blank": "missing_reply", "none": "empty", "nul": "broken", "gone": "empty", "bare": "empty"}
    assert found(spark, rows, ["bare", "ok", None]) == want
    assert found(spark, rows + rows, ["bare"]) == want
    assert found(spark, []) == {}


def test_a_hot_session_spreads_and_is_judged_whole(spark):
    rows = [(i, "hot", ("user", "assistant")[i % 2], f"m{i}", 1_700_000_000 + i) for i in range(2000)]
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(rows, SCHEMA)
        assert c.stretches(c.assemble(df)).count() > 1
        assert found(spark, rows) == {}
        assert found(spark, [r for r in rows if r[0] != 1001]) == {"hot": "missing_reply"}
        turns = [r["turn"] for r in c.conversations(df).orderBy("ts").collect()]
        assert turns == list(range(1, 2001))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_components_equal_union_find(spark):
    rng = random.Random(5)
    edges = [(f"n{rng.randrange(60):02}", f"n{rng.randrange(60):02}") for _ in range(45)] + [("z", "z"), (None, "a")] + [(f"p{i:02}", f"p{i + 1:02}") for i in range(30)]
    parent: dict = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None:
            a, b = sorted((root(u), root(v)))
            parent[b] = a
    want = {n: root(n) for n in parent}
    got = {r["node"]: r["component"] for r in c.connected_components(spark.createDataFrame(edges, "u string, v string")).collect()}
    groups = lambda m: {frozenset(k for k in m if m[k] == v) for v in m.values()}
    assert groups(got) == groups(want) and all(v == min(k for k in got if got[k] == v) for v in got.values())
    assert c.connected_components(spark.createDataFrame([], "u string, v string")).count() == 0


def test_unnamed_rows_join_by_reply_and_quote(spark):
    text = "when is the next opening of the vessel due"
    rows = [(1, None, "user", text.capitalize(), 1, None), (2, None, "assistant", f"> {text}\nIn May.", 2, None), (3, None, "user", "Thanks, and the pump?", 3, 2), (4, None, "assistant", "In June.", 4, 3), (5, None, "user", "alone", 5, None), (6, None, "user", "> yes\nshort quotes link nothing", 6, None), (7, "s", "user", "named", 7, None)]
    df = spark.createDataFrame(rows, SCHEMA + ", reply_to long")
    out = c.assemble(df).collect()
    by = {r["id"]: r["conversation"] for r in out}
    assert by[1] == by[2] == by[3] == by[4] and len({by[1], by[5], by[6], by[7]}) == 4 and by[7] == "s"
    sound = c.conversations(df).orderBy("ts").collect()
    assert [(r["id"], r["turn"], r["named"]) for r in sound] == [(1, 1, False), (2, 2, False), (3, 3, False), (4, 4, False)]


def test_an_unnamed_reply_belongs_to_the_named_conversation(spark):
    said = "the seal of the pump was found leaking at the drive end"
    rows = [
        (1, "s1", "user", "Is the pump sound?", 1, None), (2, None, "assistant", "It is.", 2, 1), (3, None, "assistant", "Also the seal.", 3, 2),
        (4, "s2", "user", said.capitalize() + ", why?", 1, None), (5, None, "bot", "> found leaking at the drive end\nWear.", 2, None),
        (6, "s3", "user", "both ask what the level of the drum is", 1, None), (7, "s4", "user", "both ask what the level of the drum is", 1, None), (8, None, "bot", "> what the level of the drum is\n12 mm.", 2, None),
        (9, "s5", "assistant", "An answer", 2, 10), (10, None, "user", "A question", 1, None), (11, None, "assistant", "It is.", 2, 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA + ", reply_to long")
    by = {r["id"]: (r["conversation"], r["named"]) for r in c.assemble(df).collect()}
    assert by[2] == by[3] == ("s1", True) and by[5] == ("s2", True) and by[10] == ("s5", True)
    assert by[8] == ("linked-8", False) and 11 not in by  # equal in name, role, content and ts: counts once
    got = {r["session_id"]: r["reason"] for r in c.rejected(df).collect()}
    assert got == {"s3": "missing_reply", "s4": "missing_reply"}
