"""Problem 1: noise in the text of scanned pages.

Method: running headers and footers are lines that repeat, but for misread characters, at the edges of several pages of
a file; page numbers are edge lines whose numbers follow the pages. What is left is joined and corrected by the
vocabulary of the whole corpus. Recognition errors are undone by a skeleton: every character, and every group that is
mistaken for another, becomes one sign, so that a word and its misreadings have the same skeleton, and the frequent
word among those of one skeleton is the right one. All of it is grouping and joining on skeletons.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.session import stored

#: Characters taken for one another, by the sign that stands for all of them ...
ALIKE = (("i", "l1!|"), ("o", "a0"), ("s", "5"), ("z", "2"), ("g", "9q"), ("t", "f"), ("c", "e"))
#: ... and characters taken for a group of others (rn for m, cl for d, vv for w, ii for u, li or b for h, ri for n).
GROUPS = (("w", "vv"), ("m", "rn"), ("n", "ri"), ("d", "ci"), ("h", "ii"), ("b", "ii"), ("u", "ii"))
#: Letters that stand for digits inside numbers.
DIGITS_FROM, DIGITS_TO = "OlISB", "01158"
#: Words that follow a hyphen without going on with its word (pre- and post-test).
NO_PIECE = r"(?!(?i:and|or|to|und|oder|et|ou|y|o)\b)"
#: Signs that end a line inside a word.
HYPHENS = "-‐¬­"
#: How many times more frequent a word must be than a spelling that it corrects, if that is letters only: so many times
#: for a spelling that stands RARE times or less, else so many; and the share of the best word's count from which on a
#: word of the same skeleton is a candidate too.
RARE, RARE_RATIO, RATIO, CANDIDATE_SHARE = 4, 4, 15, 0.002
#: What recognition makes of a character or group, in one step.
MISREADINGS = {
    "e": "c", "c": "e", "n": "ri", "i": "l 1 !", "l": "1 | i", "s": "5", "t": "f", "f": "t", "a": "o", "o": "0", "d": "cl", "u": "ii",
    "g": "9 q", "m": "rn", "z": "2", "h": "b", "b": "h", "w": "vv", "ri": "n", "li": "h", "rn": "m", "cl": "d",
}
#: Pages of a file that a running header must stand on; words so frequent that they need no look-up (bounds a broadcast).
HEADER_PAGES, FREQUENT_WORDS = 3, 20_000
#: Characters of the longest line that may be a page number.
SHORT = 24

D = "[0-9OlISB]"
NUMBER = rf"^(?:[A-Z]{{1,4}}-)?{D}+(?:[-./,:](?:[A-Z]-)?{D}+)*[AB]?$"
REGULAR = r"^\W*(?:(?:[A-Z]{1,4}-)?[0-9]+(?:[-./,:](?:[A-Z]-)?[0-9]+)*|[A-Z]{1,4}-[0-9]{4}[AB])\W*$"
PAGE_NUMBER = r"(?i)^\W*(?:p[ao0][gq9][ec]|p\.|seite|blatt|página|sheet)?\s*\W?\s*([0-9OlISB|]{1,4}|[ivxlc]{1,7})\s*(?:(?:[oa0][ft]|/|von|de|sur)\s*[0-9OlISB|]{1,4})?\s*[-–—\])|]?\s*$"
#: A page number in front of a header, set off by a sign.
PAGE_BEFORE_HEADER = r"(?i)^\W*(?:p[ao0][gq9][ec]\s+)?[0-9OlISB|]{1,4}\s*(?:[|·–—]|-\s)\s*"
#: Characters of the bands by which header lines meet; files in which a title may stand besides its own.
BAND_CHARS, OTHER_FILES = 6, 2
PAGE_IN_HEADER = r"(?i)\s+(?:p[ao0][gq9][ec]\s+)?[0-9OlISB|]{1,4}(?:\s+[oa0][ft]\s+[0-9OlISB|]{1,4}|/[0-9OlISB|]{1,4})?\s*$"
ROMAN = (("i", 1), ("v", 5), ("x", 10), ("l", 50), ("c", 100))


def skeleton(word: Column) -> Column:
    """What a word and its misreadings have in common."""
    out = F.translate(F.lower(word), "".join(c for _, c in ALIKE), "".join(sign * len(c) for sign, c in ALIKE))
    for one, many in GROUPS:
        out = F.replace(out, F.lit(one), F.lit(many))
    return out


def line_skeleton(line: Column) -> Column:
    """The skeleton of a line, with 8 and B alike, and without blanks and punctuation."""
    return F.replace(skeleton(F.regexp_replace(line, r"[^\p{L}\p{N}!|]+", "")), F.lit("8"), F.lit("ii"))


def digits(text: Column) -> Column:
    return F.translate(text, DIGITS_FROM + "|", DIGITS_TO + "1")


def roman(text: Column) -> Column:
    """The value of a Roman numeral below 400."""
    values = F.transform(F.split(F.lower(text), ""), roman_sign)
    pairs = F.zip_with(values, F.concat(F.slice(values, 2, 99), F.array(F.lit(0))), lambda a, b: F.when(a < b, -a).otherwise(a))
    return F.aggregate(pairs, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))


def roman_sign(c: Column) -> Column:
    out = F.lit(0)
    for sign, value in ROMAN:
        out = F.when(c == sign, value).otherwise(out)
    return out


def page_pieces(pages: DataFrame) -> DataFrame:
    """What one reading of the pages gives: ``doc_id``, ``page``, ``line_no``, ``line`` of the two first and two last lines of
    each page that are not blank (``outer``: it is the first or the last; ``above``: it is among the first), and of each line
    that ends inside a word, with the line after it (``following``, null for the edges)."""
    flags = [T.StructField("line_no", T.IntegerType()), T.StructField("line", T.StringType()), T.StructField("following", T.StringType()), T.StructField("outer", T.BooleanType()), T.StructField("above", T.BooleanType())]
    schema = T.StructType([pages.schema["doc_id"], pages.schema["page"], *flags])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        broken = re.compile(rf"(?<=[^\W_]|[!|])[{HYPHENS}][ \t\r]*\n(?=[^\S\n]*(?:[^\W_]|[!|]))(?![^\S\n]*{NO_PIECE[3:-1]})").finditer
        for batch in batches:
            rows, out = [], ([], [], [], [], [])

            def add(at: int, *values) -> None:
                rows.append(at)  # noqa: B023
                for column, value in zip(out, values, strict=True):  # noqa: B023
                    column.append(value)

            for at, text in enumerate(batch.column(2).to_pylist()):
                lines = text.split("\n")
                first = ends_of(lines)
                for n in dict.fromkeys(first[:2] + first[-2:]):
                    add(at, n + 1, lines[n].strip(), None, n in (first[0], first[-1]), n == first[0])
                for found in broken(text):
                    n = text.count("\n", 0, found.start())
                    add(at, n + 1, lines[n], lines[n + 1], None, None)
            at = pa.array(rows, pa.int64())
            kinds = [pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))], names=[f.name for f in schema])

    return pages.select("doc_id", "page", "text").mapInArrow(run, schema)


def ends_of(lines: list[str]) -> list[int]:
    """Places of the first two and last two lines that are not blank."""

    def two(places) -> list[int]:
        found: list[int] = []
        for n in places:
            if lines[n].strip():
                found.append(n)
                if len(found) == 2:
                    break
        return found

    return sorted({*two(range(len(lines))), *two(range(len(lines) - 1, -1, -1))})


def keyed(pieces: DataFrame) -> DataFrame:
    """``pieces`` with the ``key`` of each edge line, and ``numbered``: it looks like a numbered heading."""
    numbered = F.col("line").rlike(r"^\d{1,2}(?:\.\d{1,2})*\.? +\p{L}")
    return pieces.withColumn("key", F.when(F.col("following").isNull(), header_key(F.col("line")))).withColumn("numbered", numbered)


def header_key(line: Column) -> Column:
    """What is left of a header's line without its page number and misreadings; null for a line too short to be one."""
    bare_line = F.regexp_replace(F.regexp_replace(line, PAGE_IN_HEADER, ""), PAGE_BEFORE_HEADER, "")
    return F.when(F.length(line) >= 8, line_skeleton(bare_line))


def running_headers(edge: DataFrame, files: DataFrame) -> DataFrame:
    """``doc_id``, ``page``, ``line_no`` of edge lines that stand, but for page number and misread characters, on three or more
    pages of their file, and are its title or reference: they hold the code or the words that its file name begins with,
    or are, numbered headings aside, the first line of its first page or a line that hardly any other file has at its edges.

    Lines are alike if their skeletons are, or differ by a tenth of their characters at most: candidates share the first
    or the last characters with the most frequent line of their file that has them.
    """
    own = edge.where(F.length("key") >= 5).withColumn("title", F.col("above") & (F.col("page") == 1))
    ends = F.explode(F.array(F.xxhash64("doc_id", F.left("key", F.lit(BAND_CHARS))), F.xxhash64("doc_id", F.right("key", F.lit(BAND_CHARS)), F.lit(1)))).alias("band")
    # Most bands hold a line or two: only those of three lines or more go on. Repeated rows may raise these counts; the
    # pages are counted exactly below.
    full = own.select(ends).groupBy("band").agg(F.count("*").alias("lines")).where(F.col("lines") >= HEADER_PAGES).select("band")
    held = own.select("doc_id", "key", "title", "numbered", ends).join(full, "band", "left_semi")
    held = stored(held.groupBy("band", "doc_id", "key").agg(F.count("*").alias("n"), F.max("title").alias("title"), F.max("numbered").alias("numbered")))
    heads = held.groupBy("band").agg(F.max_by("key", F.struct("n", "key")).alias("head"))
    near = F.levenshtein("key", "head") <= F.greatest(F.lit(1), F.floor(F.length("head") / 10))
    alike = held.join(heads, "band").where(near).groupBy("doc_id", "key", "head").agg(F.max("title").alias("title"), F.max("numbered").alias("numbered"))
    lines = stored(own.drop("title", "numbered").join(alike, ["doc_id", "key"]).select("doc_id", "page", "line_no", "head", "title", "numbered"))
    often = lines.groupBy("doc_id", "head").agg(F.count_distinct("page").alias("pages"), F.max("title").alias("title"), F.max("numbered").alias("numbered")).where(F.col("pages") >= HEADER_PAGES)
    # All files count that have the line at an edge, repeated or not: a section's heading may stand at edges by chance.
    often = stored(often)
    elsewhere = own.select("doc_id", F.col("key").alias("head")).join(often.select("head").distinct(), "head").groupBy("head").agg(F.count_distinct("doc_id").alias("files"))
    stem = F.regexp_replace("filename", r"\.[^.]+$", "")
    named = files.select(F.col("id").alias("doc_id"), line_skeleton(F.regexp_extract("filename", r"^([A-Za-z]+[-_ ]?\d[\d_-]*\d)", 1)).alias("ref"), line_skeleton(stem).alias("stem")).distinct()
    named = named.groupBy("doc_id").agg(F.collect_set("ref").alias("refs"), F.collect_set("stem").alias("stems"))
    told = often.join(elsewhere, "head").join(named, "doc_id", "left")
    holds = lambda names: F.coalesce(F.exists(names, lambda r: (F.length(r) >= 4) & F.contains("head", r)), F.lit(False))
    titled = holds("refs") | holds("stems") | (~F.col("numbered") & (F.coalesce("title", F.lit(False)) | (F.col("files") <= OTHER_FILES)))
    real = told.where(titled).select("doc_id", "head")
    return lines.join(real, ["doc_id", "head"], "left_semi").select("doc_id", "page", "line_no").distinct()


def page_numbers(edge: DataFrame) -> DataFrame:
    """``doc_id``, ``page``, ``line_no`` of edge lines with nothing but their page's number, in some form. The number
    minus the page must be the same on several pages of the file, or nought; a form that names itself (Page 7, [7],
    - 7 -, p. 7/9) needs no such support at a page's very edge."""
    likely = edge.where((F.length("line") <= SHORT) & F.col("line").rlike(PAGE_NUMBER))
    token = F.regexp_extract("line", PAGE_NUMBER, 1)
    is_roman = token.rlike("(?i)^[ivxlc]+$") & ~token.rlike("^[lI]{1,2}$") | (token.rlike("^[ivx]+$"))
    number = F.when(is_roman, roman(token)).otherwise(F.expr("try_cast(translate(token, 'OlISB|', '011581') as int)"))
    seen = likely.withColumn("token", token).withColumn("number", number).where("number is not null and number > 0")
    named = F.col("line").rlike(r"(?i)^\W*(?:p[ao0][gq9][ec]|p\.|seite|blatt|página|sheet)|^[-–—\[(].*[-–—\])]$|[ /]")
    seen = stored(seen.select("doc_id", "page", "line_no", "outer", "above", named.alias("named"), (F.col("number") - F.col("page")).alias("shift")))
    support = seen.groupBy("doc_id", "above", "shift").agg(F.count_distinct("page").alias("pages"))
    lone = seen.groupBy("doc_id").agg(F.count_distinct("page").alias("numbered"))
    judged = seen.join(support, ["doc_id", "above", "shift"]).join(lone, "doc_id")
    follows = (F.col("pages") >= 2) | (F.col("shift") == 0)
    at_edge = F.col("outer") & (follows | F.col("named") | (F.col("numbered") == 1))
    return judged.where(at_edge | (~F.col("outer") & (F.col("pages") >= 3) & F.col("named"))).select("doc_id", "page", "line_no").distinct()


def bare(word: Column) -> Column:
    """A word without the punctuation around it; | and ! may be misread letters and stay inside and in front."""
    return F.regexp_replace(word, r"^[^\p{L}\p{N}!|]+|[^\p{L}\p{N}|]+$", "")


def pieces_pattern() -> re.Pattern:
    """A hyphen at a line's end and the word that the next line begins with."""
    return re.compile(rf"[{HYPHENS}][ \t\r]*\n[ \t]*(?=[^\W_]|[!|]){NO_PIECE}\S+")


def whole_words(text: str, pieces: re.Pattern) -> str:
    """A page without the pieces of its broken words; its lines stay. The pattern begins at the hyphen, and the piece in
    front of it is found from there, so that most of a page is passed over quickly."""
    out, at = [], 0
    for found in pieces.finditer(text):
        hyphen = found.start()
        left = max(text.rfind(" ", at, hyphen), text.rfind("\n", at, hyphen), text.rfind("\t", at, hyphen)) + 1
        if max(left, at) < hyphen and (text[hyphen - 1].isalnum() or text[hyphen - 1] in "!|"):
            out += [text[at : max(left, at)], "\n"]
            at = found.end()
    return "".join([*out, text[at:]]) if out else text


def token_counts(pages: DataFrame, most: int = 300_000) -> DataFrame:
    """``token``, ``n``: what blanks set apart, counted a task, without single characters, regular numbers and the pieces of
    broken words.
    Counting the words of whole pages in one call costs a third of exploding them into rows; a task hands its counts on
    when it holds ``most`` tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, pieces, regular = Counter(), pieces_pattern(), re.compile(REGULAR).search

        def out() -> pa.RecordBatch:
            kept = {t: n for t, n in counts.items() if len(t) > 1 and not regular(t)}
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(kept.keys(), pa.string()), pa.array(kept.values(), pa.int64())], names=["token", "n"])

        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(whole_words(text, pieces).split())
            if len(counts) > most:
                yield out()
        yield out()

    return pages.select("text").mapInArrow(run, "token string, n long")


def rare_tokens(pages: DataFrame, frequent: set[str]) -> DataFrame:
    """``doc_id``, ``page``, ``line_no``, ``token`` of the tokens that are neither among ``frequent`` nor regular numbers."""
    shared = pages.sparkSession.sparkContext.broadcast(frequent)
    schema = T.StructType([pages.schema["doc_id"], pages.schema["page"], T.StructField("line_no", T.IntegerType()), T.StructField("token", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip, pieces, regular = shared.value, pieces_pattern(), re.compile(REGULAR).search
        known: set[str] = set()  # regular numbers met before, so that the pattern runs once for most
        for batch in batches:
            rows, lines, found = [], [], []
            for at, text in enumerate(batch.column(2).to_pylist()):
                for number, line in enumerate(whole_words(text, pieces).split("\n"), 1):
                    for token in line.split():
                        if token in skip or token in known or len(token) < 2:
                            continue
                        if regular(token):
                            known.add(token)
                        else:
                            rows.append(at)
                            lines.append(number)
                            found.append(token)
            if len(known) > 200_000:
                known.clear()
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(lines, pa.int32()), pa.array(found, pa.string())], names=[f.name for f in schema])

    return pages.select("doc_id", "page", "text").mapInArrow(run, schema)


def spellings(tasks: DataFrame) -> DataFrame:
    """``token``, ``n``, ``word`` (lower case, no punctuation around it; null for a number or code) and ``repaired`` (of a
    number or code with letters for digits) of each distinct token that a word or a misread number may stand in. The
    patterns run once a distinct token, not once a place."""
    counted = tasks.groupBy("token").agg(F.sum("n").alias("n"))
    bare_number = F.regexp_replace("token", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    numeric = counted.withColumn("bare", bare_number).withColumn("number", F.col("bare").rlike(NUMBER))
    wrong = F.col("number") & F.col("bare").rlike("[0-9]") & F.col("bare").rlike(f"[{DIGITS_FROM}]")
    numeric = numeric.withColumn("repaired", F.when(wrong, repaired_number(F.col("bare"))))
    numeric = numeric.withColumn("repaired", F.when(F.col("repaired") != F.lower("bare"), F.col("repaired")))
    word = F.when(~F.col("number"), F.lower(bare(F.col("token"))))
    out = numeric.select("token", "n", word.alias("word"), "repaired")
    told = F.col("repaired").isNotNull() | ((F.length("word") >= 2) & F.col("word").rlike(r"\p{L}"))
    # Naming the count keeps the filter, and its patterns, above the aggregation.
    return out.where(told | (F.col("n") < 0))


def vocabulary(raw: DataFrame) -> DataFrame:
    """``word``, ``n``, ``clean`` (letters with inner hyphens, or a unit such as m3/h that many pages hold), ``skel``."""
    counted = raw.where("word is not null").groupBy("word").agg(F.sum("n").alias("n"))
    clean = F.col("word").rlike(r"^\p{L}+(?:['’/-]\p{L}+)*$") | F.col("word").rlike(r"^\p{L}\d/\p{L}+$")
    return counted.select("word", "n", clean.alias("clean"), skeleton(F.col("word")).alias("skel"))


def candidates(vocab: DataFrame) -> DataFrame:
    """``skel``, ``best``, ``best_n``: the clean words of each skeleton that are not rare beside its most frequent one."""
    clean = vocab.where("clean")
    top = clean.groupBy("skel").agg(F.max("n").alias("top"))
    out = clean.join(top, "skel").where(F.col("n") >= F.col("top") * CANDIDATE_SHARE)
    return out.select("skel", F.col("word").alias("best"), F.col("n").alias("best_n"))


@F.pandas_udf(T.IntegerType())
def misreading_steps(right: pd.Series, seen: pd.Series) -> pd.Series:
    """The least number of misreadings that turn ``right`` into ``seen``; null if none do. A misread group may be
    misread again (d, cl, c1; a, o, 0), for one more step."""
    table: dict[str, dict[str, int]] = {}
    for source, targets in MISREADINGS.items():
        for target in targets.split():
            table.setdefault(source, {})[target] = 1
    for source, targets in list(table.items()):
        for target in list(targets):
            for k, c in enumerate(target):
                for again in MISREADINGS.get(c, "").split():
                    twice = target[:k] + again + target[k + 1 :]
                    if twice != source:
                        targets.setdefault(twice, 2)

    def steps(right: str, seen: str) -> int | None:
        reach = {0: {0: 0}}
        for i in range(len(right)):
            for j, cost in reach.pop(i, {}).items():
                for width in (1, 2):
                    part = right[i : i + width]
                    if len(part) < width:
                        continue
                    options = dict(table.get(part, {}))
                    if width == 1:
                        options[part] = 0
                    for target, more in options.items():
                        if seen.startswith(target, j):
                            row = reach.setdefault(i + width, {})
                            at = j + len(target)
                            row[at] = min(row.get(at, 99), cost + more)
        return reach.get(len(right), {}).get(len(seen))

    return pd.Series([None if r is None or s is None else steps(r, s) for r, s in zip(right, seen, strict=True)], dtype="Int32")


def nearest(pairs: DataFrame, key: str) -> DataFrame:
    """Of the candidates ``best`` for each ``key``, the one that the fewest misreadings turn into it (ties: the most
    frequent, then the first in order): ``key``, ``repaired``, ``known``."""
    told = pairs.withColumn("steps", misreading_steps("best", key)).where("steps is not null")
    order = F.struct("steps", -F.col("best_n"), "best")
    return told.groupBy(key).agg(F.min_by("best", order).alias("repaired"), F.min_by("best_n", order).alias("known"))


def corrections(vocab: DataFrame, best: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``word`` and ``repaired`` of each spelling that is a misreading of a far more frequent word; a spelling with a
    digit or sign among its letters is wrong in any case. With it the candidates that are left as right words."""
    enough = F.when(F.col("n") <= RARE, RARE_RATIO).otherwise(RATIO)
    pairs = vocab.where("clean").join(best, "skel").where((F.col("word") != F.col("best")) & (F.col("best_n") >= enough * F.col("n")))
    letters = nearest(pairs, "word").select("word", "repaired")
    right = best.join(letters.select(F.col("word").alias("best")), "best", "left_anti").select("skel", "best", "best_n")
    signs = nearest(vocab.where("not clean").join(right, "skel"), "word").select("word", "repaired")
    return letters.unionByName(signs), right


def misread(pages: DataFrame, raw: DataFrame, fixes: DataFrame) -> DataFrame:
    """``doc_id``, ``page``, ``line_no``, ``found``, ``repaired`` of each misread word or number. The most frequent tokens,
    which no correction concerns, are set aside by a broadcast of at most FREQUENT_WORDS of them, regular numbers by
    their form, before the rest meet the corrections."""
    by_word = raw.drop("repaired").join(fixes, "word").select("token", F.col("word").alias("found"), "repaired")
    by_form = raw.where("repaired is not null").select("token", F.regexp_replace("token", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("found"), "repaired")
    wrong = stored(by_word.unionByName(by_form))
    right = raw.orderBy(F.desc("n"), "token").limit(FREQUENT_WORDS).select("token").join(wrong.select("token"), "token", "left_anti")
    frequent = {r["token"] for r in right.collect()}
    return rare_tokens(pages, frequent).join(wrong, "token").select("doc_id", "page", "line_no", "found", "repaired")


def repaired_number(token: Column) -> Column:
    front = F.regexp_extract(token, rf"^([A-Z]{{1,4}}-)(?={D})", 1)
    rest = F.substr(token, F.length(front) + 1)
    last = F.when(front != "", F.regexp_extract(rest, rf"(?<![0-9OlISB]){D}{{4}}([AB])$", 1)).otherwise("")
    rest = F.substr(rest, F.lit(1), F.length(rest) - F.length(last))
    rest = F.replace(F.translate(F.replace(rest, F.lit("-S-"), F.lit("-\u0001-")), DIGITS_FROM, DIGITS_TO), F.lit("\u0001"), F.lit("S"))
    return F.lower(F.concat(front, rest, last))


def broken_words(lines: DataFrame, best: DataFrame) -> DataFrame:
    """``doc_id``, ``page``, ``line_no``, ``repaired`` of each line that ends inside a word, name or number. The pieces
    are joined with or without a hyphen, whichever the corpus vocabulary knows better; codes keep their dash."""
    left = F.regexp_extract(F.rtrim(F.col("line")), rf"(\S+)[{HYPHENS}]$", 1)
    right = F.regexp_extract("following", r"^\s*(\S+)", 1)
    left = F.regexp_replace(left, r"^[^\p{L}\p{N}!|]+", "")
    right = F.regexp_replace(right, r"[^\p{L}\p{N}|]+$", "")
    pieces = lines.select("doc_id", "page", "line_no", left.alias("left"), right.alias("right")).where("left <> '' and right <> ''").distinct()
    code = F.concat("left", F.lit("-"), "right")
    is_code = code.rlike(NUMBER) & F.col("right").rlike("[0-9]")
    codes = pieces.where(is_code).select("doc_id", "page", "line_no", repaired_number(code).alias("repaired"))
    joined = pieces.where(~is_code).select("doc_id", "page", "line_no", F.lower(F.concat("left", "right")).alias("one"), F.lower(code).alias("two"))
    both = joined.select(F.explode(F.array("one", "two")).alias("joined")).distinct()
    known = nearest(both.withColumn("skel", skeleton(F.col("joined"))).join(best, "skel"), "joined")
    ones = known.select(F.col("joined").alias("one"), F.col("repaired").alias("one_best"), F.col("known").alias("one_n"))
    twos = known.select(F.col("joined").alias("two"), F.col("repaired").alias("two_best"), F.col("known").alias("two_n"))
    told = joined.join(ones, "one", "left").join(twos, "two", "left")
    hyphen = F.coalesce("two_n", F.lit(0)) > F.coalesce("one_n", F.lit(0))
    whole = F.when(hyphen, F.col("two_best")).otherwise(F.coalesce("one_best", "one"))
    return told.select("doc_id", "page", "line_no", whole.alias("repaired")).unionByName(codes)


def findings(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Every defect of every page: ``doc_id``, ``page``, ``line_no``, ``defect``, ``found`` (the misread word, else
    null), ``repaired``.

    ``hyphenated``, ``misread``, ``running_header``, ``page_number``; within lines of the last two nothing else counts.
    ``scanned`` and ``mean_conf`` are not looked at. Null and blank texts have no defects; repeated rows count once;
    headers of unregistered files are known by their title alone; pages of any length are taken whole; other columns are ignored.
    """
    pages = pages.select("doc_id", "page", "text").where(F.col("text").isNotNull())
    pieces = stored(keyed(page_pieces(pages)))
    edge = pieces.where("following is null")
    headers, numbers = running_headers(edge, files), page_numbers(edge)
    aside = headers.withColumn("defect", F.lit("running_header")).unionByName(numbers.withColumn("defect", F.lit("page_number")))
    aside = stored(aside.groupBy("doc_id", "page", "line_no").agg(F.max("defect").alias("defect")))
    # The distinct spellings, a small part of the text, are cut: all that follows asks them several times.
    raw = stored(spellings(token_counts(pages)))
    vocab = vocabulary(raw)
    fixes, right = corrections(vocab, candidates(vocab))
    fixes, right = stored(fixes), stored(right)
    wrong = misread(pages, raw, fixes).withColumn("defect", F.lit("misread"))
    broken = broken_words(pieces.where("following is not null"), right).select("doc_id", "page", "line_no", F.lit("hyphenated").alias("defect"), F.lit(None).cast("string").alias("found"), "repaired")
    inside = wrong.select("doc_id", "page", "line_no", "defect", "found", "repaired").unionByName(broken)
    inside = inside.join(aside.select("doc_id", "page", "line_no"), ["doc_id", "page", "line_no"], "left_anti")
    outside = aside.select("doc_id", "page", "line_no", "defect", F.lit(None).cast("string").alias("found"), F.lit("").alias("repaired"))
    return inside.unionByName(outside)


def repaired_pages(pages: DataFrame, found: DataFrame) -> DataFrame:
    """``doc_id``, ``page``, ``text``: each page as continuous paragraphs. Headers and page numbers are gone, broken words
    joined, misread ones replaced (with the first letter's case), and the lines of a paragraph joined by blanks; blank
    lines, headings (numbered or all capitals) and table rows stay apart. Repeated page rows come out once."""
    item = F.struct("line_no", "defect", F.coalesce("found", F.lit("")).alias("found"), "repaired")
    own = found.groupBy("doc_id", "page").agg(F.collect_set(item).alias("items"))
    schema = T.StructType([pages.schema["doc_id"], pages.schema["page"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [None if t is None else paragraphs(t, items or []) for t, items in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.string())], names=[f.name for f in schema])

    rows = pages.select("doc_id", "page", "text").distinct().join(own, ["doc_id", "page"], "left")
    return rows.mapInArrow(run, schema)


def paragraphs(text: str, items: list[dict]) -> str:
    aside, joins, swaps = set(), {}, {}
    for x in items:
        if x["defect"] in ("running_header", "page_number"):
            aside.add(x["line_no"])
        elif x["defect"] == "hyphenated":
            joins[x["line_no"]] = x["repaired"]
        else:
            swaps.setdefault(x["line_no"], {})[x["found"].lower()] = x["repaired"]
    out: list[str] = []
    carry, fresh = None, True
    for number, line in enumerate(text.split("\n"), 1):
        if number in aside:
            continue
        tokens = line.split()
        apart = not tokens or "  " in line.strip() or bool(re.match(r"\d+\. \S+(?: \S+){0,3}$", line.strip())) or line.strip().isupper()
        if carry is not None and tokens:
            lead, tail = re.match(r"([^\w]*)[\w/'|!-]*(.*)$", tokens[0]).groups()
            tokens[0] = lead + carry + tail
            carry = None
        if number in joins and tokens:
            head = tokens.pop()
            carry = joins[number].upper() if re.fullmatch(r"[A-Z\d]+(?:-[A-Z\d]+)*.?", head) else joins[number].capitalize() if head[:1].isupper() else joins[number]
        for k, token in enumerate(tokens):
            core = re.sub(r"^[^\w!|]+|[^\w|]+$", "", token)
            right = swaps.get(number, {}).get(core.lower())
            if right and core:
                right = right.upper() if any(c.isdigit() for c in right) else right.capitalize() if core[:1].isupper() else right
                tokens[k] = token.replace(core, right)
        if not tokens and carry is None:
            fresh = True
        elif apart or fresh or not out:
            out.append(" ".join(tokens))
            fresh = apart
        else:
            out[-1] = (out[-1] + " " + " ".join(tokens)).strip()
    return "\n\n".join(p for p in out if p) if carry is None else "\n\n".join([*out[:-1], (out[-1] + " " + carry).strip()] if out else [carry])
