"""Template residue in wordings that no list was written for, and ordinary text that comes close."""

from __future__ import annotations

from itertools import product

from pyspark.sql import functions as F

from lumenframe.llm import template_residue

FOUND = {
    "error_page": (
        "We couldn't locate what you were after.", "Sorry, the page you are looking for has been moved.", "This link is broken. Please go back.", "Unable to connect to the server. Please try again later.", "Oops, we can't find that page.",
        "You are not authorized to view this page.", "The site is currently offline, please come back later.", "Something unexpected happened and your request could not be processed: it took too long, please retry.", "Your connection was lost and we were unable to load this content.",
        "We are having trouble loading this page.", "Access to this page has been denied; you may contact us.", "The address you entered does not exist on this server.", "Please refresh: the server failed to respond and we could not retrieve your file.",
        "There was an unexpected error, please try again.", "Your login has expired, please sign in.", "Sorry, this content is no longer available.", "We're sorry, the service is temporarily unavailable.", "The requested resource has been deleted.", "It looks like nothing was found at this location, you may go back.",
    ),
    "script_notice": (
        "Scripting has been turned off in your settings.", "This page needs JavaScript to work properly.", "Without JavaScript this site will not work for you.", "Please turn on scripts and reload.", "To view this map, allow scripts in your browser.",
        "Your browser has JavaScript switched off.", "Sorry, you need JavaScript enabled to continue.", "The form requires scripting; enable it and refresh.", "For the best experience enable JavaScript in your browser.", "It looks like JavaScript is missing in your browser.",
    ),
    "placeholder": (
        "Dear [Name],\nthank you.", "Dear {name}, thank you for the order.", "Your order #{order_id} was sent.", "Name: ____", "Signed by ________ on 3 May.", "TODO: write this part", "Sent to [Company Name] in May.", "Hello {first_name}, welcome.", "- TBD: add the readings of June", "Valid from [Date] on.",
    ),
}
SOUND = (
    "The file could not be opened on the laptop of the engineer, so the printed copy was used.", "At 05:54 the viewer answered with error 503 for 60 minutes.", "The script of the talk is enabled in section two.", "The operator wrote a script that disables the alarm.",
    "The page has been moved to appendix B by the author.", "Access is denied to visitors during the shutdown.", "The service was restored and the server is running.", "See [1] and [Smith] for the date.", "The set {a, b} has two items.", "int main() { name(); }",
    "snake_case_names stay as they are, __init__ too.", "Todo lists are kept in the control room.", "He could not find the valve, we were told.", "The connection of the pump was closed and the seal replaced.", "Requests are answered within two days.",
    "JavaScript and Python are used in the control system.", "The gateway valve failed at noon.", "Please close the valve before you leave.", "The date [3 May] stands in the log.", "You may not enter the site without a permit.",
)


def test_recall_and_precision_of_other_wordings(spark):
    rows = [(kind, t) for kind, texts in FOUND.items() for t in texts] + [("", t) for t in SOUND]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(rows)], "doc_id long, text string")
    got = {r["doc_id"]: r["kind"] for r in template_residue.residue(df).collect()}
    for kind, texts in FOUND.items():
        right = [i for i, (k, _) in enumerate(rows) if k == kind and got.get(i) == kind]
        assert len(right) >= 0.9 * len(texts), [rows[i][1] for i, (k, _) in enumerate(rows) if k == kind and got.get(i) != kind]
    assert [rows[i][1] for i, (k, _) in enumerate(rows) if k == "" and i in got] == []


def test_records_of_one_leaf_are_told_apart(spark):
    """Both have the same number of words and the same ends: the verdict on one says nothing of the other."""
    rows = [(1, "The requested document could not be found in the archive."), (2, "The requested document could now be read in the archive.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    mined = template_residue.templates(template_residue.records(df))
    assert template_residue.leaves(mined).count() == 1 and mined.count() == 2
    assert {r["doc_id"]: r["kind"] for r in template_residue.residue(df).collect()} == {1: "error_page"}


def test_templates_count_records_but_for_variables(spark):
    df = spark.createDataFrame([(i, f"The pump P-{i} was opened.\n404 not found") for i in range(5)], "doc_id long, text string")
    mined = {r["template"]: r["n"] for r in template_residue.templates(template_residue.records(df)).collect()}
    assert mined == {"the pump p-* was opened.": 5, "404 not found": 5}


def test_records_of_a_leaf_become_one_template(spark):
    texts = [f"Sorry, the page of the archive by {name} could not be found today" for name in ("anna", "bertram", "chi")] + ["The requested document could not be found in the archive.", "The requested document could now be read in the archive.", "Other text."]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    mined = template_residue.templates(template_residue.records(df))
    found = {r["mined"]: len(r["records"]) for r in template_residue.tree(mined).collect()}
    assert found == {"sorry, the page of the archive by ******* could not be found today": 3, "the requested document could *** be ***** in the archive.": 2, "other text.": 0}
    # The second template says nothing, so its records are told apart.
    assert {r["doc_id"]: r["kind"] for r in template_residue.residue(df).collect()} == {0: "error_page", 1: "error_page", 2: "error_page", 3: "error_page"}


def test_filler_is_counted_only_where_known_words_are_neighbours(spark):
    """The counts make arrays, for which most of the verdicts' time went; what is passed over is never filler."""
    lorem, keyboard = set(template_residue.LOREM), set(template_residue.KEYBOARD)
    said = [w for n in (1, 2, 3, 4, 5, 6) for w in product(("in", "et", "jklö", "pump"), repeat=n)] + [w for n in (8, 10, 11) for w in product(("et", "pumps"), repeat=n)]
    said = [w for w in said if len(set(w)) > 1]  # one word again and again is filler by another rule
    texts = ["".join(s + w for s, w in zip(("", *(" ", ", ", "-", " 7 ", "…", " / ") * 2), words)) + "." for words in said]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, template string")
    counted = df.select("i", template_residue.verdict(F.col("template")).alias("kind"))
    got = {r["i"] for r in counted.where("kind = 'filler'").collect()}
    assert got == {i for i, w in enumerate(said) if len(w) >= 4 and max(sum(x in known for x in w) for known in (lorem, keyboard)) >= 0.8 * len(w)}
    assert 0 < len(got) < len(said) / 2
    plan = counted._jdf.queryExecution().optimizedPlan().toString()
    assert template_residue.NEIGHBOURS in plan[: plan.index("regexp_extract_all")]
