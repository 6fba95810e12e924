"""Small fixtures for the core operators."""

from __future__ import annotations

import json
import math
import zipfile

from pyspark.sql import Window
import pytest
from pyspark.sql import functions as F

from lumenframe.functions import text as fx
from lumenframe.functions import text as text_fx
from lumenframe.operators import blocks, bm25, dense, evaluate, events, fusion, layout, routing, snippets, store
from lumenframe.sources import readers, sinks
from lumenframe.streaming import sessions as streams


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values[n] for n in names)], ", ".join(f"{n} {'array<string>' if isinstance(values[n], list) else 'string'}" for n in names)).select(column.alias("x")).first()["x"]


def test_compound_tokens_keep_whole_and_parts(spark):
    assert one(spark, fx.tokenize(F.col("t")), t="PSV-2103 set at 8-P-1104") == ["psv-2103", "psv", "2103", "set", "at", "8-p-1104", "1104"]
    assert one(spark, fx.tokenize(F.col("t")), t="QTN/BHE/2024/0871") == ["qtn/bhe/2024/0871", "qtn", "bhe", "2024", "0871"]
    assert one(spark, fx.tokenize(F.col("t")), t="") == []


def test_query_terms_drop_stop_words(spark):
    assert one(spark, fx.query_terms(F.col("t")), t="What is the set pressure of PSV-2103?") == ["2103", "pressure", "psv", "psv-2103", "set"]


def test_budgets(spark):
    assert one(spark, fx.count_tokens(F.col("t")), t="") == 0
    assert one(spark, fx.count_tokens(F.col("t")), t="x" * 34) == 11
    assert one(spark, fx.truncate_tokens(F.col("t"), 10), t="a" * 32 + "\n" + "b" * 40) == "a" * 32
    assert one(spark, fx.tail_tokens(F.col("t"), 2), t="hello  you") == "o  you"


def test_cells_and_names(spark):
    assert one(spark, fx.to_number(F.col("t")), t="1,250.5") == 1250.5
    assert one(spark, fx.to_number(F.col("t")), t="12 mm") is None
    assert one(spark, fx.slugify(F.col("t")), t="  Ärger & Co: Report #7 ") == "rger-co-report-7"
    assert one(spark, fx.slugify(F.col("t")), t="---") == "untitled"
    assert one(spark, fx.display_name(F.col("t")), t="reader-vl-7b") == "Reader VL 7B"
    assert one(spark, fx.sheet_name(F.col("t")), t="a/b:c") == "a-b-c"
    assert one(spark, fx.human_bytes(F.col("t").cast("long")), t="1536") == "1.5 KB"


def test_truth_with_harmless_differences(spark):
    def states(truth, answer):
        return one(spark, fx.states_truth(F.col("t"), F.col("a")), t=truth, a=answer)

    assert states("7.8 mm", "It is 7.8 mm thick, or 7.80 to be exact")
    assert not states("7.8 mm", "It is 7.81 mm thick")
    assert states("185 degrees C", "about 185 C")
    assert not states("", "anything")


def test_wrap_is_greedy(spark):
    assert one(spark, blocks.wrap(F.col("t"), 7), t="aa bb ccc dddddddddd e") == ["aa bb", "ccc", "dddddddddd", "e"]
    assert one(spark, blocks.wrap(F.col("t"), 7), t="  ") == []


def test_bm25_exact_tag_wins_and_empty_corpus(spark):
    corpus = spark.createDataFrame([("a", "PSV-2103 set pressure 12.5 barg"), ("b", "the pump was set aside"), ("c", "flare header line list"), ("d", None)], "id string, text string")
    asked = spark.createDataFrame([(1, "PSV-2103 set pressure"), (2, ""), (3, None)], "query_id long, text string")
    rows = bm25.search_corpus(corpus, asked).orderBy("query_id", "rank").collect()
    assert rows[0]["id"] == "a" and {r["query_id"] for r in rows} == {1}
    assert bm25.search_corpus(corpus.where("false"), asked).count() == 0


def test_index_holds_a_row_a_token_and_segments_rank_as_the_whole(spark, tmp_path):
    words = ["set", "pump", "valve", "line", "tag-7", "flare", "header"]
    texts = [(f"c{i:04}", " ".join(words[(i * k) % 7] for k in range(1, 2 + i % 6))) for i in range(600)] + [("c0003", "pump again")]
    corpus = spark.createDataFrame(texts, "id string, text string")
    asked = spark.createDataFrame([(1, "pump tag-7"), (2, "set set flare"), (None, "header")], "query_id long, text string")
    found = []
    for chars in (10**9, 500):
        path = bm25.build(corpus, str(tmp_path / str(chars)), segment_chars=chars)
        posts = spark.read.parquet(f"{path}/postings")
        # Not a row a token and text.
        assert posts.count() <= posts.select("segment").distinct().count() * 11
        found.append(sorted(map(str, bm25.search(spark, path, asked, limit=20).collect())))
    assert found[0] == found[1] and len(found[0]) == 60

    # By hand, over whole rows.
    tokens = {}
    for i, t in texts:
        tokens.setdefault(i, []).extend(w for w in t.split() for w in ([w, "tag"] if w == "tag-7" else [w]))
    mean, hits = sum(map(len, tokens.values())) / len(texts), []
    for q, terms in ((1, ["pump", "tag-7", "tag"]), (2, ["set", "set", "flare"]), (None, ["header"])):
        df = {w: sum(w in t for t in tokens.values()) for t in tokens.values() for w in t}
        raw = {w: math.log(len(texts) - n + 0.5) - math.log(n + 0.5) for w, n in df.items()}
        idf = {w: v if v >= 0 else 0.25 * sum(raw.values()) / len(raw) for w, v in raw.items()}
        score = {i: round(sum(idf[w] * t.count(w) * 2.5 / (t.count(w) + 1.5 * (0.25 + 0.75 * len(t) / mean)) for w in terms), 6) for i, t in tokens.items()}
        hits += [(q, i, rank + 1) for rank, i in enumerate(sorted((i for i in score if score[i] > 0), key=lambda i: (-score[i], i))[:20])]
    ours = [(r["query_id"], r["id"], r["rank"]) for r in bm25.search(spark, path, asked, limit=20).collect()]
    assert sorted(ours, key=str) == sorted(hits, key=str)


def test_stored_index_is_kept_until_the_corpus_changes(spark, tmp_path):
    spark.createDataFrame([("a", "PSV-2103 set pressure"), ("b", "other words")], "id string, text string").coalesce(1).write.parquet(str(tmp_path / "c"))
    read = lambda: spark.read.parquet(str(tmp_path / "c"))
    first = bm25.refreshed(read(), "t", read())
    assert bm25.refreshed(read(), "t", read()) == first and {r["tok"] for r in bm25.terms(spark, first).collect()} == {"psv-2103", "psv", "2103", "set", "pressure", "other", "words"}
    spark.createDataFrame([("c", "set of tools")], "id string, text string").write.mode("append").parquet(str(tmp_path / "c"))
    assert bm25.refreshed(read(), "t", read()) != first


def test_fusion_formula_and_limit(spark):
    lists = {"dense": [(1, "a", 1), (1, "b", 2)], "sparse": [(1, "b", 1), (1, "a", 2)]}
    frames = {k: spark.createDataFrame(v, "query_id long, id string, rank int") for k, v in lists.items()}
    rows = fusion.fuse(frames).orderBy("rank").collect()
    assert [r["id"] for r in rows] == ["a", "b"] and abs(rows[0]["score"] - (1 / 61 + 1 / 62)) < 1e-9
    assert rows[0]["sources"] == ["dense", "sparse"] and rows[0]["ranks"] == {"dense": 1, "sparse": 2}
    many = spark.createDataFrame([(1, f"{i:03}", i) for i in range(1, 51)], "query_id long, id string, rank int")
    assert fusion.fuse({"dense": many}).count() == 30


def test_dense_finds_itself_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(dense, "ROW_BLOCK", 7)
    monkeypatch.setattr(dense, "QUERY_BLOCK", 2)
    rows = [(i, [float(i % 5), 1.0, float(i)]) for i in range(20)] + [(99, None), (98, [0.0, 0.0, 0.0])]
    held = spark.createDataFrame(rows, "id long, vector array<float>")
    asked = held.where("id in (3, 7, 11)").select(F.col("id").alias("query_id"), "vector")
    best = {r["query_id"]: r["id"] for r in dense.search(held, asked, limit=3).where("rank = 1").collect()}
    assert best == {3: 3, 7: 7, 11: 11}


def test_hashed_vectors_are_stable(spark):
    df = spark.createDataFrame([(1, "a b b"), (2, "")], "id long, text string")
    first, again = dense.hashed(df).collect(), dense.hashed(df).collect()
    assert first == again and abs(sum(v * v for v in first[0]["vector"]) - 1) < 1e-6


def block_rows(spark, rows):
    return spark.createDataFrame([("d", 1, i, kind, text, section, False) for i, (kind, text, section) in enumerate(rows)], "doc_id string, page int, ord int, kind string, text string, section string, low_conf boolean")


def test_tables_are_never_split_and_chunks_stay_in_budget(spark):
    words = " ".join(f"word{i}." for i in range(400))
    table = "\n".join(f"| CML-{r:02d} | {r}.5 reading |" for r in range(60))
    df = block_rows(spark, [("paragraph", words, "Intro"), ("table", table, "Readings"), ("paragraph", "Closing words. " * 30, "")])
    chunks = blocks.chunks(df, 280, 100).orderBy("chunk_index").collect()
    assert sum(table in c["text"] for c in chunks) == 1
    assert all(c["tokens"] <= 280 + 100 + 40 for c in chunks if not c["has_table"])
    assert [c["chunk_index"] for c in chunks] == list(range(len(chunks))) and chunks[0]["text"].startswith("Intro\n\n")
    assert [c["id"] for c in chunks] == [c["id"] for c in blocks.chunks(df, 280, 100).orderBy("chunk_index").collect()]


def test_overlap_carries_whole_sentences(spark):
    df = block_rows(spark, [("paragraph", "First one here. Second one here.", ""), ("paragraph", "Third one is here. " * 4, "")])
    chunks = blocks.chunks(df, 24, 8).orderBy("chunk_index").collect()
    assert chunks[1]["text"].startswith("Second one here.")


def test_markdown_tables_split_with_header(spark):
    rows = [("t", 0, ["a|b", "c"]), ("t", 1, ["", " "])] + [("t", i, [f"{i}\n", "x", "y"]) for i in range(2, 52)]
    df = spark.createDataFrame(rows, "id string, row_no int, cells array<string>")
    out = blocks.markdown_tables(df, ["id"]).orderBy("block").collect()
    assert len(out) == 2 and out[0]["rows"] == 50 and all(r["text"].split("\n", 1)[1].startswith("| a\\|b | c |  |\n| --- | --- | --- |") for r in out)
    assert out[1]["text"].startswith("(rows 41-50 of 50)\n")
    alone = blocks.markdown_tables(df.where("row_no = 0"), ["id"]).collect()
    assert alone[0]["text"] == "| a\\|b | c |\n| --- | --- |" and alone[0]["rows"] == 0


def test_markdown_sections_run_across_pages(spark):
    df = spark.createDataFrame([("d", 1, "# Scope #\n\none\n\n| a |"), ("d", 2, "two\r\n\r\n\r\n\r\n")], "doc_id string, page int, text string")
    rows = blocks.plain_blocks(df, markdown=True).orderBy("page", "ord").collect()
    assert [(r["kind"], r["section"]) for r in rows] == [("heading", "Scope"), ("paragraph", "Scope"), ("table", "Scope"), ("paragraph", "Scope")]


def test_paginate_never_splits(spark):
    df = block_rows(spark, [("paragraph", "x" * n, "") for n in (50, 60, 200, 10)])
    assert [r["sheet"] for r in blocks.paginate(df, 100).orderBy("ord").collect()] == [1, 2, 3, 4]


def test_headings(spark):
    def heading(text):
        return one(spark, blocks.looks_like_heading(F.col("t")), t=text)

    assert heading("3. Background") and heading("INCIDENT SUMMARY") and not heading("Page 3 of 4") and not heading("It was closed.") and not heading("")


def test_resolution_tiers(spark):
    files = spark.createDataFrame([("f1", "QTN-2024-1.pdf", 1), ("f2", "QTN-2024-10.pdf", 5), ("f3", "memo qtn-2024-1.txt", 9)], "id string, filename string, ingested_at long")
    names = spark.createDataFrame([("f2",), ("QTN-2024-1.pdf",), ("qtn-2024",), ("2024-10",), ("%",), (None,)], "name string")
    got = {r["name"]: (r["id"], r["tier"]) for r in store.resolve(names, files).collect()}
    assert got == {"f2": ("f2", 1), "QTN-2024-1.pdf": ("f1", 2), "qtn-2024": ("f2", 3), "2024-10": ("f2", 4)}


def test_names_may_end_inside_words(spark):
    files = spark.createDataFrame([("f1", "QTN-2023-5076-isolation.pdf", 1), ("f2", "MEMO-2024-1-isolation.pdf", 5), ("f3", "a_100%.txt", 2)], "id string, filename string, ingested_at long")
    names = spark.createDataFrame([("QTN-2023-50",), ("isolat",), ("solation.P",), ("-5",), ("q",), ("0%",), ("isolated",), ("_%",), ("",)], "name string")
    got = {r["name"]: (r["id"], r["tier"]) for r in store.resolve(names, files).collect()}
    assert got == {"QTN-2023-50": ("f1", 3), "isolat": ("f2", 4), "solation.P": ("f2", 4), "-5": ("f1", 4), "q": ("f1", 3), "0%": ("f3", 4), "": ("f2", 3)}


def test_first_hits_and_summary(spark):
    questions = spark.createDataFrame([(1, "a.pdf", 3, "x"), (2, "b.pdf", 1, "x"), (3, "c.pdf", 1, "y")], "query_id long, expected_doc string, expected_page int, kind string")
    hits = spark.createDataFrame([(1, 1, "z.pdf", 3, 3), (1, 2, "a.pdf", 2, 4), (1, 3, "a.pdf", 3, None), (2, 1, "b.pdf", 1, 1)], "query_id long, rank int, filename string, page int, page_end int")
    firsts = evaluate.first_hits(hits, questions)
    assert {r["query_id"]: (r["first"], r["exact"]) for r in firsts.collect()} == {1: (2, 3), 2: (1, 1), 3: (None, None)}
    row = evaluate.summary(firsts).first()
    assert (row["n"], row["recall_at_1"], row["recall_at_3"], row["mrr"]) == (3, 0.3333, 0.6667, 0.5)


def test_ordered_p95_is_a_value_of_the_data(spark):
    df = spark.createDataFrame([("k", v) for v in (9, 10, 1, 2, 3, 4, 5, 6, 7, 8)], "k string, v long")
    assert evaluate.ordered_p95(df, ["k"], "v").first()["p95"] == 9


def test_snippets_keep_answer_and_budget(spark):
    text = "Heading\n" + "filler words without it\n" * 30 + "| tag | pressure |\n| --- | --- |\n| PSV-2103 | 12.5 barg |\nlast line"
    asked = spark.createDataFrame([(1, "PSV-2103 pressure?", text), (2, "nothing of it", text), (3, "one PSV-2103", "one line PSV-2103 " * 99), (4, None, text), (5, "q", None)], "query_id long, question string, text string")
    out = {r["query_id"]: r["snippet"] for r in snippets.with_snippets(asked, budget=40).collect()}
    assert out[1] == "Heading\n...\n| tag | pressure |\n| --- | --- |\n| PSV-2103 | 12.5 barg |\nlast line"
    assert out[2].endswith(" …") and out[2].startswith("Heading\nfiller") and out[3].endswith(" …") and out[5] is None
    none = {r["query_id"]: r["snippet"] for r in snippets.with_snippets(asked, budget=0).collect()}
    assert none[1] == none[3] == ""


def test_a_long_line_is_shown_around_the_term(spark):
    text = "start\n" + "x " * 200 + "PSV-2103 opens at 12 barg " + "y " * 200
    row = snippets.with_snippets(spark.createDataFrame([("PSV-2103", text)], "question string, text string"), budget=40).first()
    assert "PSV-2103" in row["snippet"] and len(row["snippet"]) / 3.4 <= 48 and row["snippet"].startswith("...") and row["snippet"].endswith("...")


def test_payload_within_budget(spark):
    text = "Heading\n" + "filler words without it\n" * 30 + "| PSV-2103 | 12.5 barg |\nlast line"
    hits = [(1, "PSV-2103", i + 1, f"d{i}", "f", i, "", 1 / (i + 1), text) for i in range(20)] + [(2, "PSV-2103", 1, "z", "f", 1, None, 0.5, "short PSV-2103\ntext")]
    df = spark.createDataFrame(hits, "query_id long, question string, rank int, doc_id string, filename string, page int, section string, score double, text string")
    out = {r["query_id"]: json.loads(r["content"])["hits"] for r in snippets.payloads(df).collect()}
    assert len(json.dumps({"hits": out[1]}, ensure_ascii=False)) / 3.4 <= 1001 and out[1][0]["doc_id"] == "d0" and len(out[1]) > 5
    assert "12.5 barg" in out[1][0]["snippet"] and [h["doc_id"] for h in out[1]] == [f"d{i}" for i in range(len(out[1]))]
    assert out[2][0]["snippet"] == "short PSV-2103\ntext"
    cited = snippets.citations(snippets.payloads(df)).where("query_id = 1").collect()
    assert [r["doc_id"] for r in cited] == ["d0", "d1", "d2", "d3", "d4"]


def test_fit_tells_what_is_kept(spark):
    got = lambda text, budget: one(spark, text_fx.fit(F.col("t"), F.lit("/tmp/x.txt"), budget), t=text)
    long = "A sentence of some words. " * 200
    assert got("short", 100) == "short" and got(None, 100) is None
    cut = got(long, 200)
    assert len(cut) / 3.4 <= 200 and cut.startswith("A sentence") and "of 1530 tokens. Full output written to /tmp/x.txt." in cut
    assert got(long, 10).startswith("[truncated: showing about 0 of")


def test_grid_names_blank_headers(spark):
    grid = [["a|b", "", None], ["1\n2", " x "], ["", "", "", "more"]]
    df = spark.createDataFrame([(grid,), ([],)], "g array<array<string>>")
    rows = [r[0] for r in df.select(blocks.grid_markdown(F.col("g"))).collect()]
    assert rows == ["| a\\|b | Col 2 | Col 3 | Col 4 |\n| --- | --- | --- | --- |\n| 1 2 | x |  |  |\n|  |  |  | more |", ""]


def test_packed_sentences_stay_whole(spark):
    text = "One two three. Four five six! Seven eight nine? " + "word " * 40 + "end. Last."
    assert one(spark, blocks.packed(F.col("t"), 10), t=text) == ["One two three. Four five six!", "Seven eight nine?", "word " * 40 + "end.", "Last."]


def test_layout_rows_join_by_first_cell(spark):
    cells = spark.createDataFrame([("d", 1, 0, "a", 0.0, 10.0), ("d", 1, 1, "b", 9.0, 12.0), ("d", 1, 2, "c", 0.0, 14.0)], "doc_id string, page int, cell_no int, text string, x0 double, mid_y double")
    rows = layout.reading_rows(cells, 3.0).orderBy("row_no").collect()
    assert [r["text"] for r in rows] == ["a b", "c"]


def test_tables_share_three_edges(spark):
    spots = {1: (0, 50, 100), 2: (1, 52, 99), 4: (0, 50, 100), 5: (20, 70, 130), 7: (0, 50, 100), 8: (0, 50, 130)}
    rows = [("d", 1, line, k, "t", float(x), float(x + 5), line * 12.0) for line, xs in spots.items() for k, x in enumerate(xs)]
    placed = spark.createDataFrame(rows, "doc_id string, page int, line_no int, cell_no int, text string, x0 double, x1 double, mid_y double")
    assert sorted((r["first_line"], r["last_line"]) for r in layout.table_runs(placed).collect()) == [(1, 2), (4, 5), (7, 8)]
    assert [(r["table_no"], r["first_line"], r["last_line"], r["rows"]) for r in layout.aligned_tables(placed).collect()] == [(1, 1, 2, 2)]


def test_unaligned_texts_of_tables_stay_tables(spark):
    table = "CML-22  thrust bearing  40.0  200  Nil\nCML-20  bottom head  20.2  12.1  Acceptable"
    prose = "Rate  our  answer  on  a  scale  of  5003  to  815  stars (3)\nSOP-2025-9339   EXTERNAL INSPECTION REPORT   Page 6 of 8"
    pages = spark.createDataFrame([("t", 1, table), ("p", 1, prose)], "doc_id string, page int, text string")
    assert [r["doc_id"] for r in layout.aligned_tables(layout.set_in_columns(layout.cells(pages))).collect()] == ["t"]


def test_grading_uses_the_inputs_of_cases(spark):
    rows = [
        ("fact by pattern", "fact", "It is 7.80 MM.", "7\\.8\\d* mm", None, None, None, None, True),
        ("fact by truth", "fact", "It is 7.80 mm.", "nothing", "7.80 mm", None, None, None, True),
        ("fact wrong", "fact", "It is 6 mm.", "7 mm", None, None, None, None, False),
        ("absent", "absent", "None.", None, None, ["9 bar"], None, None, True),
        ("absent forbidden", "absent", "It is 9 BAR.", None, None, ["9 bar"], None, None, False),
        ("honest", "honest", "That is not mentioned.", None, None, None, None, None, True),
        ("honest forbidden", "honest", "Not mentioned, but 9 bar.", None, None, ["9 bar"], None, None, False),
        ("injection", "injection", "I stay with the facts.", None, None, ["pwned"], None, None, True),
        ("injection forbidden", "injection", "PWNED", None, None, ["pwned"], None, None, False),
        ("cite", "cite", "See there.", None, None, None, "sop-1", ["SOP-1.pdf p.2"], True),
        ("cite other", "cite", "See there.", None, None, None, "sop-1", ["SOP-2.pdf p.2"], False),
        ("cite nothing", "cite", "See there.", None, None, None, "sop-1", None, False),
        ("code", "code", "```python\nprint(1)\n```", "PRINT", None, None, None, None, True),
        ("code other", "code", "```python\npass\n```", "print", None, None, None, None, False),
    ]
    whole = spark.createDataFrame([(*r[:3], "final_answer", *r[3:8]) for r in rows], "rec_id string, kind string, answer string, stop string, expect string, truth string, forbid array<string>, doc string, citations array<string>")
    assert {r["rec_id"]: r["passed_again"] for r in events.regraded(whole).collect()} == {r[0]: r[8] for r in rows}
    bare = {r["rec_id"]: r["passed_again"] for r in events.regraded(whole.select("rec_id", "kind", "answer", "stop")).collect()}
    assert all(bare[r[0]] is None for r in rows)
    broken = whole.withColumn("stop", F.lit("error"))
    assert not any(r["passed_again"] for r in events.regraded(broken).collect())


def test_all_alternatives_stay(spark):
    models = spark.createDataFrame([(f"m{i:03}", i, ["chat"]) for i in range(130)], "model_id string, size_mb long, capabilities array<string>")
    needs = spark.createDataFrame([("chat",), ("none",)], "need string")
    got = {r["need"]: (r["model_id"], len(r["alternatives"])) for r in routing.cheapest_capable(needs, models).collect()}
    assert got == {"chat": ("m000", 129), "none": (None, 0)}


def test_held_out_share_of_each_label(spark):
    rows = spark.range(3000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") == 0, "one").when(F.col("id") % 7 == 0, None).when(F.col("id") % 3 == 0, "a").otherwise("b").alias("label"))
    w = Window.partitionBy("label").orderBy(F.xxhash64("k"), "k")
    want = {r["k"]: r["o"] for r in rows.select("k", (F.percent_rank().over(w) < 0.2).alias("o")).collect()}
    split = routing.split(rows, "label", "k")
    assert {r["k"]: r["held_out"] for r in split.collect()} == want
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert "percent_rank" not in plan


def test_every_session_is_classified(spark, tmp_path):
    from lumenframe import queries

    sessions = [(f"s{i}", ("plot the curve", "write a letter")[i % 2], ("chart", "text")[i % 2]) for i in range(20)] + [("open", "plot a curve", None), ("blank", None, None)]
    spark.createDataFrame(sessions, "session_id string, title string, task_type string").write.parquet(str(tmp_path / "sessions.parquet"))
    got = {r["session_id"]: (r["task_type"], r["predicted"]) for r in queries.QUERIES["classified_sessions"](spark, str(tmp_path)).collect()}
    assert len(got) == 22 and got["open"] == (None, "chart") and got["blank"][1] is not None


def test_readers_and_sinks(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text('x,"y, z"\n1,"2\n3"\n')
    (folder / "b.TXT").write_bytes(b"one\r\n\r\ntwo \xff")
    (folder / "c.exe").write_text("no")
    with zipfile.ZipFile(folder / "d.docx", "w") as z:
        w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f'<w:document {w}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Scope</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>')
    with zipfile.ZipFile(folder / "e.xlsx", "w") as z:
        m = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
        z.writestr("xl/workbook.xml", f'<workbook {m}><sheets><sheet name="S"/></sheets></workbook>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet {m}><sheetData><row><c r="A1" t="inlineStr"><is><t>h</t></is></c><c r="C1"><v>3</v></c></row><row><c r="A2"><v>1</v></c></row></sheetData></worksheet>')
    assert sorted(r["filename"] for r in readers.files(spark, str(folder)).select("filename").collect()) == ["a.csv", "b.TXT", "d.docx", "e.xlsx"]
    assert readers.csv_tables(spark, str(folder)).first()["text"] == "| x | y, z |\n| --- | --- |\n| 1 | 2 3 |"
    assert [r["text"] for r in blocks.plain_blocks(readers.text_pages(readers.files(spark, str(folder)))).orderBy("ord").collect()] == ["one", "two �"]
    assert [(r["kind"], r["section"]) for r in readers.document_blocks(spark, str(folder)).orderBy("ord").collect()] == [("heading", "Scope"), ("paragraph", "Scope"), ("table", "Scope")]
    assert readers.workbook_tables(spark, str(folder)).first()["text"] == "| h |  | 3 |\n| --- | --- | --- |\n| 1 |  |  |"
    out = str(tmp_path / "table")
    sinks.replace_by_key(spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k int, v string"), out, "k", 4)
    sinks.replace_by_key(spark.createDataFrame([(1, "z")], "k int, v string"), out, "k", 4)
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(out).collect()) == [(1, "z"), (2, "c")]
    texts = spark.createDataFrame([("long",), ("long",), ("other",)], "t string")
    for _ in range(2):
        sinks.spill(texts, "t", "search", str(tmp_path / "spill"))
    assert spark.read.parquet(str(tmp_path / "spill")).count() == 2


def test_frames(spark):
    body = 'data: {"a": 1}\n\nevent: x\ndata: {"b":\ndata: 2}\n\ndata: broken\n\n'
    df = spark.createDataFrame([("s", body)], "stream_id string, body string")
    assert [r["good"] for r in readers.frames(df).orderBy("seq").collect()] == [True, True, False]
    assert [r["good"] for r in readers.frames(df, joined=False).orderBy("seq").collect()] == [True, False, False, False]


def test_stream_equals_batch(spark, tmp_path):
    rows = [(i, f"s{i % 7}" if i % 11 else None, ("user", "Assistant ", "bot", None)[i % 4], f"text {i}", 1_700_000_000 + i) for i in range(200)]
    source = str(tmp_path / "messages")
    df = spark.createDataFrame(rows, "id long, session_id string, role string, content string, ts long")
    df.repartition(5).write.parquet(source)
    got = streams.drained(streams.running_view(streams.read_messages(spark, source + "/", 2)), str(tmp_path / "out"))
    want = streams.batch_view(df)
    key = lambda r: r["session_id"]
    assert sorted(got.select(want.columns).collect(), key=key) == sorted(want.collect(), key=key)


def test_trail_numbers_grow_with_time_and_batches(spark, tmp_path):
    path = str(tmp_path / "trail")
    first = spark.createDataFrame([(t, "s", "k", "{}") for t in (5, 3, 9, 1, 7, 7)], "ts long, session_id string, kind string, payload_json string")
    sinks.append_trail(first.repartition(3), path)
    sinks.append_trail(first.where("ts < 4"), path)
    sinks.append_trail(first.where("false"), path)
    rows = spark.read.parquet(path).orderBy("seq").collect()
    assert [r["seq"] for r in rows] == list(range(1, 9)) and [r["ts"] for r in rows] == [1, 3, 5, 7, 7, 9, 1, 3]


def test_lost_partners_and_low_measures_are_errors(spark):
    left, right = spark.createDataFrame([(1,), (2,)], "k long"), spark.createDataFrame([(1, "a"), (3, "b")], "k long, v string")
    assert [tuple(r) for r in store.required(left.where("k = 1"), right, "k").collect()] == [(1, "a")]
    with pytest.raises(Exception, match="no k 2"):
        store.required(left, right, "k").collect()
    assert evaluate.gate(left, "k", 1).count() == 2
    with pytest.raises(Exception, match="k is 1"):
        evaluate.gate(left, "k", 2).collect()


def test_picked_empty_lists(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "page int")
    assert [store.picked(df, "page", w, e).count() for w, e in (([1, 3], True), ([], True), ([], False))] == [2, 3, 0]


def test_small_scalars(spark):
    row = spark.createDataFrame([("[stopped: max_steps]  Half an answer", "1, 3,5", "1,x", "", "a/b/pump.tar.pdf", 5903, 4096, 900)], "m string, p string, q string, e string, f string, mb int, c int, d int").select(
        text_fx.stop_mark(F.col("m"))[0].alias("why"), text_fx.stop_mark(F.col("m"))[1].alias("rest"), text_fx.page_list(F.col("p")).alias("p"), text_fx.page_list(F.col("q")).alias("q"), text_fx.page_list(F.col("e")).alias("e"),
        text_fx.collision_name(F.col("f"), F.lit(True), F.lit("k")).alias("f"), text_fx.gigabytes(F.col("mb")).alias("gb"), text_fx.context_size(F.col("c")).alias("c"), text_fx.context_size(F.col("d")).alias("d"),
        text_fx.capability_sentence(F.array(F.lit("data"), F.lit("vision"), F.lit("code"))).alias("s"), text_fx.scenario(F.lit("Plot the ERROR chart")).alias("sc"), text_fx.marked_low(F.lit("x"), F.lit(True)).alias("low"),
    ).first()
    assert (row["why"], row["rest"], row["p"], row["q"], row["e"]) == ("max_steps", "Half an answer", [1, 3, 5], None, [])
    assert row["f"].startswith("pump.tar-") and row["f"].endswith(".pdf") and len(row["f"]) == len("pump.tar-12345678.pdf")
    assert (row["gb"], row["c"], row["d"], row["sc"]) == ("5.8 GB", "4K ctx", "900 ctx", "failure")
    assert row["s"] == "Reads images and scanned pages and writes and reviews code." and row["low"].startswith("[?] low-confidence")


def test_folder_is_read_by_suffix(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n\ntwo")
    (tmp_path / "b.md").write_text("# Head\n\ntext")
    (tmp_path / "c.csv").write_text("x,y\n1,2\n")
    (tmp_path / "d.exe").write_text("no")
    rows = readers.folder_blocks(spark, str(tmp_path)).orderBy("doc_id", "ord").collect()
    assert [(r["doc_id"][-5:], r["kind"]) for r in rows] == [("a.txt", "paragraph"), ("a.txt", "paragraph"), ("/b.md", "heading"), ("/b.md", "paragraph"), ("c.csv", "table")]
    assert rows[3]["section"] == "Head" and rows[4]["text"] == "| x | y |\n| --- | --- |\n| 1 | 2 |"


def test_columns_by_start_edge(spark):
    row = spark.range(1).select(*(layout.column_of(F.array(F.lit(0.0), F.lit(100.0)), F.lit(x)).alias(n) for n, x in (("a", 5.0), ("b", 98.5), ("c", 300.0), ("d", -9.0))), layout.column_of(F.array(F.lit(50.0)), F.lit(99.0)).alias("e")).first()
    assert tuple(row) == (0, 1, 1, 0, 0)


def test_registry_and_signatures(spark):
    rows = readers.registry(spark, [{"id": "a"}, {"id": "b", "ctx": 9}], {"id": "", "ctx": 1}).orderBy("id").collect()
    assert [(r["id"], r["ctx"]) for r in rows] == [("a", 1), ("b", 9)]
    df = spark.createDataFrame([({"b": "2", "a": "1"},), ({"a": "1", "b": "2"},)], "m map<string,string>")
    assert {r[0] for r in df.select(text_fx.canonical_json(F.col("m"))).collect()} == {'{"a":"1","b":"2"}'}


def test_sheets_are_found_by_their_relationship():
    import io

    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="B" sheetId="2" r:id="r2"/><sheet name="A" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="/xl/worksheets/sheet7.xml"/></Relationships>')
        for number, value in ((1, "one"), (7, "seven")):
            z.writestr(f"xl/worksheets/sheet{number}.xml", f'<worksheet xmlns="{main}"><sheetData><row><c r="A1"><is><t>{value}</t></is></c></row></sheetData></worksheet>')
    assert readers.sheet_rows(held.getvalue()) == [("B", 0, ["seven"]), ("A", 0, ["one"])]
