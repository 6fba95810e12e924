"""Repeated lines, defective pairs and template residue on small fixtures."""

from __future__ import annotations

import pytest

from lumenframe.llm import pair_defects, site_lines, template_residue

NOTICE = "Held by the archive, do not remove it from room {}"


def site(spark, n=20, held=6):
    files = [(f"d{i}", "src", 1_700_000_000) for i in range(n)] + [("d0", "src", 1_700_009_999), ("e1", "other", 1), (None, "src", 1)]
    pages = [(f"d{i}", 1, "Own text of file number " + "abcdefghijklmnopqrst"[i] + " goes here\n" + (NOTICE.format(i).upper() if i % 2 else NOTICE.format(i)) * (i < held) + "\nshort line") for i in range(n)]
    pages += [pages[0], ("d1", 2, None), ("d2", 2, ""), ("e1", 1, NOTICE.format(3)), ("lost", 1, NOTICE.format(3))]
    f = spark.createDataFrame(files, "id string, source string, ingested_at long").selectExpr("*", "'x' as doc_id", "1 as page")
    return spark.createDataFrame(pages, "doc_id string, page int, text string").selectExpr("*", "'y' as source", "2 as h1"), f


def test_lines_of_enough_files(spark):
    pages, files = site(spark)
    got = {(r["doc_id"], r["page"], r["line_no"]) for r in site_lines.boilerplate(pages, files).collect()}
    assert got == {(f"d{i}", 1, 2) for i in range(6)}
    clean = {(r["doc_id"], r["page"]): r["text"] for r in site_lines.without_lines(pages, site_lines.boilerplate(pages, files)).collect()}
    assert clean["d1", 1].count("\n") == 1 and clean["e1", 1] == NOTICE.format(3) and clean["d1", 2] is None


def test_limits_and_empty_tables(spark):
    pages, files = site(spark, 20, 4)
    assert site_lines.boilerplate(pages, files).count() == 0  # four files only
    assert site_lines.boilerplate(pages.where("false"), files).count() == 0 and site_lines.boilerplate(pages, files.where("false")).count() == 0


def test_six_names_of_one_article_are_no_boilerplate_by_clusters(spark):
    files = spark.createDataFrame([(f"d{i}", None, 86_400 * i) for i in range(6)], "id string, source string, ingested_at long")
    pages = spark.createDataFrame([(f"d{i}", 1, f"The same five words here, issue {i}\nand one more line of its text") for i in range(6)], "doc_id string, page int, text string")
    lines, found = site_lines.counted_lines(pages, files)
    assert [(r["files"], r["clusters"], r["days"]) for r in found.collect()] == [(6, 1, 1)] * 2 and lines.count() == 12
    assert site_lines.boilerplate(pages, files, **site_lines.FILES).count() == 12
    assert site_lines.boilerplate(pages, files, **site_lines.CLUSTERS).count() == 0


def test_near_duplicates_collapse_and_notices_stay(spark):
    body = " ".join(f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "klmnp")
    texts = [(f"n{i}", f"{NOTICE}\n{body} {'abcdefgh'[i] * 4}\nReprinted words of this one article") for i in range(8)]
    texts += [(f"o{i}", NOTICE + "\n" + " ".join("qrstuvwx"[i] + x for x in body.split())) for i in range(8)]
    pages = spark.createDataFrame([(d, 1, t) for d, t in texts], "doc_id string, page int, text string")
    files = spark.createDataFrame([(d, "src", 86_400 * i) for i, (d, _) in enumerate(texts)], "id string, source string, ingested_at long")
    by_files = {(r["doc_id"], r["line_no"]) for r in site_lines.boilerplate(pages, files, **site_lines.FILES).collect()}
    assert by_files == {(d, 1) for d, _ in texts} | {(f"n{i}", 3) for i in range(8)}
    got = {(r["doc_id"], r["line_no"]) for r in site_lines.boilerplate(pages, files, similar=0.8, **site_lines.CLUSTERS).collect()}
    assert got == {(d, 1) for d, _ in texts}


def test_copies_take_over_the_lines_of_one_file(spark, monkeypatch):
    files = spark.createDataFrame([(f"d{i}", "ab"[i // 6] if i < 12 else None, None) for i in range(18)] + [("d0", "b", 5)], "id string, source string, ingested_at long")
    pages = spark.createDataFrame([(f"d{i}", 1, f"The same five words here, issue {i}\nand one more line of its text") for i in range(18)], "doc_id string, page int, text string")
    looked, cut = [], site_lines.stored
    monkeypatch.setattr(site_lines, "stored", lambda df: looked.append(cut(df)) or looked[-1])
    found = site_lines.boilerplate(pages, files, **site_lines.FILES)
    assert sorted((r["doc_id"], r["line_no"]) for r in found.collect()) == sorted((f"d{i}", n) for i in range(18) for n in (1, 2))
    # One file a source (or two, where it has the name in common) is looked through, and days are not counted where none are asked for.
    assert {(r["source"], r["copy_of"]) for r in looked[1].collect()} == {("a", "d0"), ("b", "d0"), (None, "d12")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "copy_of" in plan and "unix_date" not in plan


CHECKS = "Checks before start-up:\n- the pump for a leak\n- the list with the laboratory chemist"
PAIRS = [
    ("empty", "q?", None), ("empty", "q?", " ​"), ("empty", None, "N/A"), ("empty", "q?", "```\n```"), ("empty", "q?", "..."),
    ("refusal", "How hot is it?", "Hello. I'm sorry, but I can't help with that."), ("refusal", "q", "This request goes against my guidelines, so no answer will be given."),
    ("refusal", "Warum?", "Es tut mir leid, dazu darf ich nichts sagen."), ("refusal", "Pourquoi ?", "Je ne répondrai pas à une question sur P-1."), ("refusal", "¿Por qué?", "Lo siento, no puedo ayudar con eso."),
    ("copied_question", "What is the level of D-1?", "WHAT IS THE LEVEL OF D-1?"), ("copied_question", "What is the level of D-1?", "You asked: What is the level of D-1?"),
    ("copied_question", "What is the level of D-1?", "What is the level of D-1? What is the level of D-1?"),
    ("truncated", "Which rule?", "The examination of H-6429 follows RLC 534, supplemented by Q"), ("truncated", "Code?", "```python\nprint(1"), ("truncated", "Why?", "It said (see the report."),
    ("other_language", "Who signs the certificate of the pump?", "Die Pumpe wurde wegen starker Schwingungen um 17:02 vom Schichtleiter abgestellt."),
    ("other_language", "Answer in Spanish: Who signs the certificate?", "Il faut remplacer le joint au prochain arrêt, comme l'indique la note."),
    (None, "Answer in Spanish: Who signs the certificate?", "La junta de la bomba debe cambiarse en la próxima parada, como indica la nota."),
    (None, "Is it allowed to run with it?", "No"), (None, "Who signs?", "The stores keeper"), (None, "When?", "June 2015"), (None, "List the checks.", CHECKS),
    (None, "What is the level of D-1?", "What is the level of D-1? The level of D-1 is 28.6 mm, as stated in SOP-1."), (None, "x", "I could not find any entry on SR-8127 in the indexed files."),
    (None, "x", "Operators cannot open SR-9 before the foreman has signed; I found this rule in Q-1."), (None, None, "A whole sentence that nobody asked for."), (None, "Code?", "Here: ```python\nprint(1)\n```"),
]


def pairs(spark, rows):
    return spark.createDataFrame([(i, p, a, "final_answer") for i, (_, p, a) in enumerate(rows)], "rec_id long, prompt string, answer string, stop string").selectExpr("*", "'x' as defect", "1 as tail")


def test_defects(spark):
    got = {r["rec_id"]: r["defect"] for r in pair_defects.defective_pairs(pairs(spark, PAIRS).union(pairs(spark, PAIRS))).collect()}
    assert got == {i: d for i, (d, _, _) in enumerate(PAIRS) if d}
    assert pair_defects.defective_pairs(pairs(spark, [])).count() == 0


def test_lists_cut_inside_an_item(spark):
    whole = [(None, "List.", CHECKS)] * 9 + [(None, "Who has the list?", "The isolation list is with the laboratory chemist, not with the pump crew.")]
    cut = [("truncated", "List.", CHECKS[:-8]), ("truncated", "List.", CHECKS[:-13]), (None, "List.", "Checks before start-up:\n- the pump for a leak")]
    got = {r["rec_id"]: r["defect"] for r in pair_defects.defective_pairs(pairs(spark, whole + cut)).collect()}
    assert got == {10: "truncated", 11: "truncated"}


@pytest.mark.parametrize(("text", "still"), [("a (b) c", None), ("a (b", "("), ('say "yes', '"'), ('5" pipe', None), ("<b>x", "b"), ("<br/>x", None), ("```x", "fence"), ("``` ( ``` x", None)])
def test_pushdown_parser(text, still):
    assert pair_defects.open_at_end(text) == still


RESIDUE = [
    ("placeholder", "Dear [INSERT NAME],\nthe pump was opened."), ("placeholder", "Prices are valid until {{ doc.date | upper }} only."), ("placeholder", "Hello %RECIPIENT%, done."), ("placeholder", "Opened on [Date to be entered]."), ("placeholder", "Replaces «vendor» of {3}."),
    (None, 'The template writes `{{tag}}` and "${DIR}/out" in quotes.'), (None, "Never accept a bracketed field such as [INSERT PRICE] in a quotation."), (None, '```python\nprint(f"{x}: {v}")\n```'),
    ("filler", "Real text stands here.\nYour text here\nMore real text."), ("filler", "Dolor sit amet consectetur elit."), ("filler", "xxxxx xxxx xxxxxx"), ("filler", "bla bla bla bla"), ("filler", "asdf qwer zxcv jkl"),
    (None, "The guide forbids wording like lorem ipsum in issued procedures."),
    ("error_page", "404\nThe requested document could not be found.\nReturn"), ("error_page", "FEHLER 404: DIE SEITE WURDE NICHT GEFUNDEN."), ("error_page", "502 Bad Gateway"), ("error_page", "Real text before. Your session has expired. Please sign in again."),
    (None, "At 05:54 the viewer answered with error 503 for 60 minutes."), (None, "The reading was 404 mm at H-404."), (None, 'The reader shows "access denied" when a permit has lapsed.'),
    ("script_notice", "Please enable JavaScript to view this document."), ("script_notice", "<noscript>Scripts must be allowed for the display</noscript>"), (None, "Before opening it on a kiosk, enable JavaScript in the browser settings and log in."),
    (None, None), (None, ""), (None, "   \n"), (None, "ordinary words. " * 5000),
]


def test_residue(spark):
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(RESIDUE)], "doc_id long, text string").selectExpr("*", "'x' as kind", "1 as leaf", "2 as record")
    got = {r["doc_id"]: r["kind"] for r in template_residue.residue(df.union(df)).collect()}
    assert got == {i: k for i, (k, _) in enumerate(RESIDUE) if k}
    assert template_residue.residue(df.where("false")).count() == 0
