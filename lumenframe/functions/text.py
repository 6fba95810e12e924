"""Scalar text functions as column expressions; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumenframe.config import LIMITS

#: Compound terms (tags, references, paths) and the words that carry no meaning in a question.
COMPOUND = r"[a-z0-9]+(?:[-_/.][a-z0-9]+)*"
STOPWORDS = (
    "the and for what which was were are his her its from with that this into does did how why when who whom you your our has have "
    "had not any all can could would should will shall may"
).split()
#: Phrasings of an honest "the documents do not say".
HONEST_MARKERS = (
    "not in the documents", "not covered", "do not cover", "does not cover", "no document", "could not find", "couldn't find",
    "not found in", "not available in", "no information", "not mentioned", "do not have", "don't have", "not contain", "no record",
    "not present in", "did not mention", "does not mention", "not directly mentioned", "no mention", "not specified in",
    "not stated in", "not provided in", "did not find", "unable to find", "cannot find", "not included in",
)
HEDGED = r"\b(?:did|does|do) not \w+ (?:mention|state|specify|cover|include)"
#: How parts of a model's name are written.
NAME_PARTS = {"vl": "VL", "moe": "MoE", "llava": "LLaVA", "vlm": "VLM"}


def strip(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def tokenize(text: Column) -> Column:
    """Search tokens: lower-case runs of ASCII letters and digits, compounds whole and, after each, its parts of two
    characters or more. Null gives null."""
    whole = F.regexp_extract_all(F.lower(text), F.lit(COMPOUND), 0)
    return F.flatten(F.transform(whole, compound_parts))


def compound_parts(term: Column) -> Column:
    parts = F.filter(F.split(term, "[-_/.]"), lambda p: F.length(p) > 1)
    return F.when(term.rlike("[-_/.]"), F.concat(F.array(term), parts)).otherwise(F.array(term))


def query_terms(text: Column) -> Column:
    """The distinct content words of a question, compounds and their parts, sorted."""
    good = lambda t: (F.length(t) > 2) & ~t.isin(*STOPWORDS)
    whole = F.filter(F.regexp_extract_all(F.lower(text), F.lit(COMPOUND), 0), good)
    parts = F.filter(F.flatten(F.transform(whole, lambda t: F.split(t, "[-_/.]"))), good)
    return F.array_sort(F.array_distinct(F.concat(whole, parts)))


def line_score(line: Column, terms: Column) -> Column:
    """How many of the terms a line holds, anywhere inside it."""
    return F.size(F.filter(terms, lambda t: F.contains(F.lower(line), t)))


def count_tokens(text: Column) -> Column:
    """Estimated model tokens: none for no text, else a token for each 3.4 characters begun."""
    return F.when(F.coalesce(F.length(text), F.lit(0)) == 0, 0).otherwise(F.floor(F.length(text) / LIMITS.chars_per_token).cast("int") + 1)


def truncate_tokens(text: Column, budget: int | Column) -> Column:
    """The beginning of a text within a token budget, cut at a line end if one lies in the last 15 percent."""
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    at = F.least(F.floor(budget * LIMITS.chars_per_token), budget * 12 + 512).cast("int")
    head = F.left(text, at)
    last = F.length(head) - F.locate("\n", F.reverse(head))
    nearby = F.contains(head, F.lit("\n")) & (last > F.least(F.length(text), at) * 0.85)
    cut = F.regexp_replace(F.when(nearby, F.left(head, last.cast("int"))).otherwise(head), r"[\s\p{Z}]+$", "")
    return F.when(budget <= 0, F.lit("")).when(count_tokens(text) <= budget, text).otherwise(cut)


def tail_tokens(text: Column, budget: int) -> Column:
    """The end of a text within a token budget, without leading white space."""
    return F.regexp_replace(F.right(text, F.lit(int(budget * LIMITS.chars_per_token))), r"^[\s\p{Z}]+", "")


def fit(text: Column, path: Column, budget: int = LIMITS.tool_budget) -> Column:
    """A text within a token budget: unchanged if it fits, else its beginning and a notice (fixed wording) that tells how
    much is shown and where the whole is kept. The notice is measured with the path in it; the beginning shrinks up to
    twice by what it is over; if that is not enough, the notice stands alone."""
    total = count_tokens(text)

    def notice(shown: Column) -> Column:
        return F.concat(F.lit("\n\n[truncated: showing about "), shown.cast("string"), F.lit(" of "), total.cast("string"), F.lit(" tokens. Full output written to "), path, F.lit(". Narrow the query or request specific pages to see the rest.]"))

    def attempt(room: Column) -> Column:
        body = truncate_tokens(text, F.greatest(room, F.lit(0)))
        return F.concat(body, notice(count_tokens(body)))

    room = F.lit(budget) - count_tokens(notice(F.lit(budget)))
    state = F.struct(room.alias("room"), F.lit(None).cast("string").alias("content"))

    def step(a: Column, _: Column) -> Column:
        over = count_tokens(attempt(a["room"])) - budget
        return F.when(a["content"].isNotNull(), a).otherwise(F.struct((a["room"] - over - 4).alias("room"), F.when(over <= 0, attempt(a["room"])).alias("content")))

    shrunk = F.aggregate(F.array(F.lit(1), F.lit(2), F.lit(3)), state, step, lambda a: a["content"])
    return F.when(total <= budget, text).otherwise(F.coalesce(shrunk, strip(notice(F.lit(0)))))


def sentences(text: Column) -> Column:
    return F.split(text, r"(?<=[.!?;])\s+")


def snippet(text: Column, width: int = 320) -> Column:
    """White space collapsed, and an ellipsis where it was cut."""
    flat = strip(F.regexp_replace(text, r"[\s\p{Z}]+", " "))
    return F.when(F.length(flat) <= width, flat).otherwise(F.concat(F.left(flat, F.lit(width - 1)), F.lit("…")))


def window(line: Column, terms: Column, budget: int | Column) -> Column:
    """A slice of one long line around the first term in it, with ellipses; it does not begin inside a word."""
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    width = F.greatest(F.lit(80), F.floor(budget * LIMITS.chars_per_token)).cast("int")
    places = F.filter(F.transform(terms, lambda t: F.instr(F.lower(line), t) - 1), lambda p: p >= 0)
    start = F.greatest(F.lit(0), F.coalesce(F.array_min(places), F.lit(0)) - F.floor(width / 3).cast("int"))
    blank = F.instr(F.substr(line, start + 1), F.lit(" ")) - 1
    begin = F.when((start > 0) & (blank >= 0) & (blank < 30), start + blank + 1).otherwise(start)
    end = F.least(F.length(line), start + width)
    inside = strip(F.substr(line, begin + 1, F.greatest(F.lit(0), end - begin)))
    return F.concat(F.when(begin > 0, "...").otherwise(""), inside, F.when(end < F.length(line), "...").otherwise(""))


def slugify(text: Column, longest: int = 60) -> Column:
    dashed = F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(F.nullif(F.regexp_replace(F.left(dashed, F.lit(longest)), "-+$", ""), F.lit("")), F.lit("untitled"))


def heading_key(text: Column) -> Column:
    """What two spellings of a heading have in common: its letters and digits, lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def sheet_name(text: Column) -> Column:
    return F.left(F.regexp_replace(text, r"[:\\/?*\[\]]", "-"), F.lit(31))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/\\]*)$", 1)


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(base_name(path), r"(\.[^.]+)$", 1))


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), r"(?<=.)\.[^.]+$", "")


def to_number(cell: Column) -> Column:
    """A spreadsheet cell's number, thousands commas allowed; null if it is text."""
    good = cell.rlike(r"^\s*-?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?\s*$")
    return F.when(good, F.replace(F.trim(cell), F.lit(","), F.lit("")).try_cast("double"))


def answer_keys(answer: Column) -> Column:
    """The telling parts of an expected answer: tokens with a digit or of more than four characters."""
    return F.filter(F.regexp_extract_all(answer, F.lit("[A-Za-z0-9]+(?:[-./][A-Za-z0-9]+)*"), 0), lambda t: t.rlike(r"\d") | (F.length(t) > 4))


def states_truth(truth: Column, answer: Column) -> Column:
    """Does an answer state the truth, but for harmless differences? Every number must stand (trailing noughts and
    thousands commas aside), then every token with a digit or hyphen; a truth of words only needs its first three long
    words."""
    plain = lambda c: strip(F.regexp_replace(F.replace(F.replace(F.lower(c), F.lit("degrees"), F.lit("")), F.lit("°"), F.lit("")), r"\s+", " "))
    want, said = plain(truth), plain(answer)
    bare = F.replace(said, F.lit(","), F.lit(""))
    numbers = F.regexp_extract_all(want, F.lit(r"\d+(?:\.\d+)?"), 0)
    stands = lambda n: F.regexp_like(bare, F.concat(F.replace(n, F.lit("."), F.lit("\\.")), F.when(F.contains(n, F.lit(".")), "0*").otherwise(""), F.lit(r"(?!\d)")))
    keys = F.filter(F.regexp_extract_all(want, F.lit(r"[\w.\-/]+"), 0), lambda t: t.rlike(r"\d|-"))
    long_words = F.filter(F.regexp_extract_all(want, F.lit("[a-z]+"), 0), lambda w: F.length(w) > 3)
    by_words = (F.size(long_words) > 0) & F.forall(F.slice(long_words, 1, 3), lambda w: F.contains(said, w))
    by_keys = F.forall(keys, lambda k: F.contains(said, k))
    return (F.length(truth) > 0) & F.forall(numbers, stands) & F.when(F.size(keys) > 0, by_keys).otherwise(by_words)


def admits_absence(answer: Column) -> Column:
    low = F.lower(answer)
    out = low.rlike(HEDGED)
    for marker in HONEST_MARKERS:
        out = out | F.contains(low, F.lit(marker))
    return out


def code_block(text: Column) -> Column:
    """The code of the first fence, or the whole text; literal \\n sequences become line ends if there is no real one."""
    fenced = F.regexp_extract(text, r"(?s)```[A-Za-z0-9_+-]*\s*\n(.*?)```", 1)
    code = strip(F.when(fenced != "", fenced).otherwise(text))
    return F.when(F.contains(code, F.lit("\\n")) & ~F.contains(code, F.lit("\n")), F.replace(code, F.lit("\\n"), F.lit("\n"))).otherwise(code)


def tenths(n: Column, unit: int, name: str) -> Column:
    """A count in a larger unit with one decimal place, half up, in whole numbers so that no engine's floats differ."""
    t = F.floor((n.cast("long") * 10 + unit // 2) / unit)
    return F.concat(F.floor(t / 10).cast("string"), F.lit("."), (t % 10).cast("string"), F.lit(" " + name))


def human_bytes(n: Column) -> Column:
    small = F.concat(n.cast("long").cast("string"), F.lit(" B"))
    return F.when(n < 1024, small).when(n < 1024 * 1024, tenths(n, 1024, "KB")).otherwise(tenths(n, 1024 * 1024, "MB"))


def human_ms(n: Column) -> Column:
    return F.when(n < 1000, F.concat(n.cast("long").cast("string"), F.lit(" ms"))).otherwise(tenths(n, 1000, "s"))


def display_name(model_id: Column) -> Column:
    """A model id as people read it: sizes in capitals, known parts as they are written, the rest capitalised."""

    def part(p: Column) -> Column:
        out = F.concat(F.upper(F.left(p, F.lit(1))), F.substr(p, F.lit(2)))
        for key, written in NAME_PARTS.items():
            out = F.when(F.lower(p) == key, written).otherwise(out)
        return F.when(F.lower(p).rlike(r"^\d+(?:\.\d+)?b$"), F.upper(p)).otherwise(out)

    return F.array_join(F.transform(F.split(model_id, "-"), part), " ")


def preview(text: Column, width: int = 220, lines: int = 4) -> Column:
    """A summary's first part, with an ellipsis, if it is wider or longer than a preview."""
    long_text = (F.length(text) > width) | (F.size(F.split(text, "\n")) > lines)
    head = F.array_join(F.slice(F.split(text, "\n"), 1, lines), "\n")
    return F.when(long_text, F.concat(F.left(head, F.lit(width)), F.lit("…"))).otherwise(text)


def stream_pieces(text: Column) -> Column:
    """Pieces for replay: leading white space, then words with the white space after them; joined they are the text."""
    return F.regexp_extract_all(text, F.lit(r"^\s+|\S+\s*"), 0)


def canonical_json(entries: Column) -> Column:
    """A map as JSON with sorted keys, so that equal calls have equal signatures."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(entries))))


#: The mark of doubtful text, the reasons of an end, what a model's capabilities say of it, and the words that
#: tell what a message asks for, each list in order.
LOW_CONF_NOTE = "[?] low-confidence OCR, verify against the source page:\n"
STOP_REASONS = ("final_answer", "max_steps", "error", "cancelled")
CAPABILITY_BLURBS = (
    ("vision", "reads images and scanned pages"), ("code", "writes and reviews code"), ("document", "answers questions from your documents"),
    ("data", "works through tables and numbers"), ("fast", "answers short general questions quickly on the least VRAM"), ("general", "general questions and drafting"),
)
SCENARIO_WORDS = (
    ("failure", ("fail", "timeout", "error", "recover")),
    ("code", ("code", "python", "script", "downtime", "plot", "chart")),
    ("document", ("document", "sop", "wall loss", "thickness", "pdf", "cite", "citation", "report", "docx", "approval")),
)


def marked_low(text: Column, low: Column) -> Column:
    """A text with a note in front of it where its recognition is doubtful."""
    return F.when(F.coalesce(low, F.lit(False)), F.concat(F.lit(LOW_CONF_NOTE), text)).otherwise(text)


def stop_mark(text: Column) -> tuple[Column, Column]:
    """The reason in a message's leading stop mark (null without one), and the message without it."""
    mark = r"^\[stopped: (" + "|".join(STOP_REASONS) + r")\]\s*"
    return F.nullif(F.regexp_extract(text, mark, 1), F.lit("")), F.regexp_replace(text, mark, "")


def capability_sentence(capabilities: Column) -> Column:
    """What a model is for: the blurbs of its first two capabilities in the fixed order, as one sentence."""
    known = F.filter(F.array(*(F.when(F.array_contains(capabilities, c), F.lit(text)) for c, text in CAPABILITY_BLURBS)), lambda b: b.isNotNull())
    joined = F.array_join(F.slice(known, 1, 2), " and ")
    return F.when(F.size(known) == 0, "No capabilities declared.").otherwise(F.concat(F.upper(F.left(joined, F.lit(1))), F.substr(joined, F.lit(2)), F.lit(".")))


def scenario(message: Column) -> Column:
    """What a message asks for, by the first list that a word of stands in it."""
    low, out = F.lower(message), F.lit("simple")
    for name, words in reversed(SCENARIO_WORDS):
        out = F.when(low.rlike("|".join(words)), name).otherwise(out)
    return out


def page_list(text: Column) -> Column:
    """The pages of a list such as "1, 3,5"; null if one of them is no number."""
    parts = F.filter(F.split(F.replace(text, F.lit(" "), F.lit("")), ","), lambda p: p != "")
    pages = F.transform(parts, lambda p: p.try_cast("int"))
    return F.when(~F.exists(pages, lambda p: p.isNull()), pages)


def clamped(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def or_default(limit: Column, default: int = LIMITS.candidates) -> Column:
    """A limit of none or nought means the default."""
    return F.coalesce(F.nullif(limit, F.lit(0)), F.lit(default))


def gigabytes(megabytes: Column) -> Column:
    return F.format_string("%.1f GB", megabytes / 1024)


def context_size(tokens: Column) -> Column:
    return F.when(tokens >= 1024, F.concat(F.floor(tokens / 1024 + 0.5).cast("string"), F.lit("K ctx"))).otherwise(F.concat(tokens.cast("string"), F.lit(" ctx")))


def collision_name(name: Column, taken: Column, key: Column) -> Column:
    """A file's own name or, where that is taken, its stem, eight hex digits of ``key``, and its suffix."""
    own = base_name(name)
    return F.when(taken, F.concat(stem(own), F.lit("-"), F.left(F.sha2(key, 256), F.lit(8)), F.regexp_extract(own, r"(?<=.)(\.[^.]+)$", 1))).otherwise(own)
