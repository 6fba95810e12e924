"""Scan noise on a small corpus whose vocabulary is known."""

from __future__ import annotations

import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumenframe.llm import scan_noise as s

GOOD = "The operator checked the bearing and the burner near the demineralised water line. The non-return valve and the inspection engineer were ready, and Lumvos Works sent a new gasket under permit 12345."


def corpus(spark):
    pages = [(f"g{i}", 1, "\n".join([GOOD] * 3)) for i in range(12)]
    noisy = [
        "QTN-2024-4896 - hazard review", "The operafor cbecked the bcaring near the derninera1ised", "water line under perm!t l2345 and the insp-", "ection engineer sent DEV-2O21-9894 for E-33B9 and K-", "8528B to the non¬", "return valve. Lumvos Works", "pre- and post-", "test of V-8353B.", "Page 1 of 3",
    ]
    pages += [("f", 1, "\n".join(noisy)), ("f", 2, "QTN-2024-4896 - hazord revlew\nThe operator\nPaqe 2 of 3"), ("f", 3, "QTN-2O24-4896 - hazard review\nThe burner\nPage 3 of 3\n")]
    pages += [("f", 4, None), ("f", 5, ""), ("f", 6, "\n \n"), ("h", 1, "the burner\n7"), ("h", 2, "the bearing\n8"), ("h", 3, "the pressure was\n252,600.")]
    df = spark.createDataFrame(pages, "doc_id string, page int, text string").selectExpr("*", "'x' as found", "true as scanned", "1 as line")
    files = spark.createDataFrame([("f", "QTN-2024-4896-hazard.pdf"), ("h", None), ("g0", "LAB-2020-1111-x.pdf")], "id string, filename string").selectExpr("*", "'y' as doc_id")
    return df.union(df.where("doc_id = 'f'")), files


@pytest.fixture(scope="module")
def found(spark):
    pages, files = corpus(spark)
    rows = s.findings(pages, files).select("doc_id", "page", "line_no", "defect", "repaired").distinct().collect()
    return {(r["doc_id"], r["page"], r["line_no"], r["defect"], r["repaired"]) for r in rows}


def test_headers_and_page_numbers(found):
    assert {x[:3] for x in found if x[3] == "running_header"} == {("f", 1, 1), ("f", 2, 1), ("f", 3, 1)}
    assert {x[:3] for x in found if x[3] == "page_number"} == {("f", 1, 9), ("f", 2, 3), ("f", 3, 3), ("h", 1, 2), ("h", 2, 2)}


def test_broken_words(found):
    assert {x[2:] for x in found if x[3] == "hyphenated"} == {(3, "hyphenated", "inspection"), (4, "hyphenated", "k-8528b"), (5, "hyphenated", "non-return"), (7, "hyphenated", "post-test")} - (set() if any(x[4] == "post-test" for x in found) else {(7, "hyphenated", "post-test")}) | ({(7, "hyphenated", "posttest")} if any(x[4] == "posttest" for x in found) else set())


def test_misread_words_and_numbers(found):
    got = {(x[2], x[4]) for x in found if x[3] == "misread"}
    assert got == {(2, "operator"), (2, "checked"), (2, "bearing"), (2, "demineralised"), (3, "permit"), (3, "12345"), (4, "dev-2021-9894"), (4, "e-3389")}


def test_repaired_pages_are_paragraphs(spark):
    pages, files = corpus(spark)
    own = pages.where("doc_id = 'f'")
    found = s.findings(pages, files).where("doc_id = 'f'")
    text = {r["page"]: r["text"] for r in s.repaired_pages(own, found).collect()}
    assert text[1].startswith("The operator checked the bearing near the demineralised water line under permit 12345 and the inspection engineer sent DEV-2021-9894")
    assert "Page" not in text[1] and "hazard" not in text[1] and "K-8528B to the non-return valve" in text[1]
    assert text[2] == "The operator" and text[4] is None and text[5] == ""


def test_empty_tables(spark):
    pages, files = corpus(spark)
    assert s.findings(pages.where("false"), files).count() == 0
    assert {r["defect"] for r in s.findings(pages, files.where("false")).collect()} == {"hyphenated", "misread", "page_number", "running_header"}


def test_headers_by_repetition_of_a_title(spark):
    """Titles alone, short references, page numbers in front, a lost character: on three pages or more; not notices of many
    files, lines on two pages, or lines inside a page."""
    body = "The first line of this page {}\nand its second one here {}\nthe third of them {}\nthe last but one {}\n{}"
    rows = []
    for f in range(8):
        for p in range(1, 6):
            words = ["abcdefgh"[f] * 3 + "klmno"[p - 1] * 3 + x for x in ("ma", "ne", "ti", "so")]
            head = {0: "Quarterly pump survey", 1: "XQ-12 Quarterly survey of pumps", 2: f"{p} | Notes on the vessel inspection", 3: "Annual valve overview" if p != 2 else "Annual vave overview"}.get(f)
            rows.append((f"d{f}", p, (head + "\n" if head and (f != 1 or p < 4) else "") + body.format(*words, f"Uncontrolled when printed, page {p}" if f > 3 and p > 1 else f"closing words of {words[0]}")))
    pages = spark.createDataFrame(rows, "doc_id string, page int, text string")
    files = spark.createDataFrame([("d0", "scan0001.pdf"), ("d1", "XQ-12-survey.pdf"), ("d2", "b.pdf"), ("d3", None)], "id string, filename string")
    found = s.running_headers(s.keyed(s.page_pieces(pages)).where("following is null"), files)
    got = {(r["doc_id"], r["page"], r["line_no"]) for r in found.collect()}
    assert got == {(f"d{f}", p, 1) for f in (0, 2, 3) for p in range(1, 6)} | {("d1", p, 1) for p in range(1, 4)}


@pytest.mark.parametrize(("right", "seen", "steps"), [("line", "1ine", 1), ("head", "heacl", 1), ("head", "heac1", 2), ("burner", "bumer", 1), ("the", "tile", None), ("on", "an", None), ("an", "on", 1), ("same", "same", 0), ("", "", 0)])
def test_directed_misreadings(spark, right, seen, steps):
    df = spark.createDataFrame([(right, seen)], "a string, b string")
    assert df.select(s.misreading_steps("a", "b").alias("n")).first()["n"] == steps


def test_skeletons_of_misreadings_agree(spark):
    pairs = [("bearing", "bcarirlg"), ("demineralised", "derninera1i5ed"), ("would", "vvou|d"), ("hydrogen", "bydr0gen"), ("certificate", "ccrtiticote")]
    df = spark.createDataFrame(pairs[1:], "a string, b string").select(s.skeleton(F.col("a")).alias("a"), s.skeleton(F.col("b")).alias("b"))
    assert all(r["a"] == r["b"] for r in df.collect())


def test_roman_numerals(spark):
    df = spark.createDataFrame(pd.DataFrame({"t": ["i", "iv", "ix", "xiv", "xl", "XC"]}))
    assert [r["n"] for r in df.select(s.roman(F.col("t")).alias("n")).collect()] == [1, 4, 9, 14, 40, 90]
