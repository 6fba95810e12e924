"""Problem 8: template residue, filler, error pages and script notices where content should be.

Method: message templates are mined with a fixed-depth prefix tree. Documents are cut into records (lines, sentences);
a record's leaf is its number of words, its first words and its last words. Records with variables (words with digits,
quoted names) as wildcards hang from their leaf, where those that agree in most places become one template, with wildcards
where they differ. Each template is classified once by what all of its records say; where that tells nothing, its records
are classified each by itself, so that no record takes the verdict of another. Slots that a template left open inside ordinary records are found
apart, on the text with quotations and code taken out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import and_, eq

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Depth of the tree: leading and trailing words of a leaf.
LEADING, TRAILING = 4, 2
#: Least share of a record's words that stand in a template of its leaf at the same places.
ALIKE = 0.8
#: Words of the usual filler text (fixed values), and the share of a record's words that must be among them.
LOREM = (
    "lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisci elit sed do eiusmod tempor incididunt ut labore et dolore "
    "magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in "
    "reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui "
    "officia deserunt mollit anim id est laborum"
).split()
#: Runs of neighbouring keys and words that stand for any text (fixed values); the same share applies.
KEYBOARD = "asdf asdfg asdfgh asdfghjkl sdf sdfg dfgh fghj ghjk hjkl jkl jklö lkj qwer qwert qwerty qwertz wert uiop poiu zxc zxcv zxcvb zxcvbn yxcv yxcvb aaa bbb ccc foo bar baz qux test tests testing abc xyz blah bla".split()
LOREM_SHARE, LOREM_WORDS = 0.8, 4

#: Verdicts on templates: patterns over the lower-case record, from its beginning. Variables are *.
ERROR_PAGE = (
    r"(?:(?:http|status|error|erreur|fehler|code) )+(?:code )?[45]\d\d\s*(?:[-:–.]|$)",
    r"[45]\d\d[ :–-]+(?:page )?(?:not found|bad gateway|forbidden|unauthori[sz]ed|service unavailable|gateway time-?out|internal server error|bad request|too many requests)",
    r"(?:(?:the|this|your|requested|that) )+(?:requested )?(?:page|document|file|resource|url|address|site|item)\b.{0,60}\b(?:not (?:be )?found|does not exist|no longer (?:exists|available)|cannot be displayed|could not be (?:displayed|loaded|opened).{0,30}$|is corrupt|was moved)",
    r"(?:page|document|file|resource|seite|page|página) (?:not found|nicht gefunden|introuvable|no encontrad[oa])",
    r"(?:no se ha encontrado|no se encontró|no se pudo encontrar) (?:la|el) (?:página|documento|archivo)",
    r"(?:die|diese) (?:angeforderte )?(?:seite|datei) (?:wurde|konnte|ist) nicht",
    r"(?:la|cette) (?:page|ressource)\b.{0,30}\b(?:introuvable|n['’]existe)",
    r"(?:access|zugriff|accès|acceso|permission) (?:is |was |est |ist )?(?:denied|verweigert|refusé|interdit|denegado|forbidden).{0,12}$",
    r"you (?:do not|don['’]t) have (?:the )?(?:permission|access|rights?|authori[sz]ation)\b",
    r"(?:you have been|your (?:ip|address|account) (?:has been|is)) (?:temporarily )?blocked",
    r"(?:usted )?no tiene permiso|vous n['’]avez pas (?:le droit|la permission|accès)|sie haben keine berechtigung",
    r"(?:your|the|this|ihre|votre|su) (?:session|sitzung|sesión) (?:has |have |ist |a |ha )?(?:expired|timed out|abgelaufen|expiré|caducado|expirado)",
    r"(?:bad gateway|gateway time-?out|internal server error|too many requests|forbidden|unauthorized)\b[\s.!]*$",
    r"(?:the )?(?:upstream )?(?:server|gateway|backend) (?:did not|does not|could not|is not) (?:answer|respond|responding|reachable)",
    r"(?:the |this )?(?:service|server|site|website|system|page) (?:is )?(?:temporarily |currently )?(?:unavailable|down for maintenance|overloaded)",
    r"(?:le service|der dienst|el servicio) .{0,30}(?:indisponible|nicht verfügbar|no (?:está )?disponible)",
    r"we are (?:carrying out|performing|undergoing) (?:scheduled )?maintenance",
    r"(?:oops|ooops|whoops|uh oh)\b[\s!.,]*(?:$|something|that|this|page|we)",
    r"(?:sorry,? )?(?:something|an? (?:unexpected |unknown |internal )?error) (?:went wrong|has occurred|occurred)",
    r"(?:the )?(?:connection|request)\b.{0,40}\b(?:timed out|was reset|was refused|failed)\b.{0,16}$",
    r"(?:java|javax|org|com)\.[\w.]+(?:exception|error)\b",
    r"traceback \(most recent call last\)",
)
SCRIPT_NOTICE = (
    r"(?:please |kindly |bitte |veuillez |por favor,? )?(?:enable|activate|turn on|switch on|allow|unblock|aktivieren sie|schalten sie|activez|activer|active|habilite|permita) (?:java ?script|scripts?|scripting|script execution)\b",
    r"(?:java ?script|scripts?|scripting) (?:is|are|must be|should be|needs? to be|has to be|ist|est|está) (?:currently )?(?:disabled|enabled|turned off|turned on|switched off|switched on|blocked|required|allowed|not enabled|deaktiviert|désactivé|desactivado)",
    r"(?:your|this|ihr|votre|su) (?:web ?)?(?:browser|navigateur|navegador)\b.{0,30}\b(?:not support|block(?:s|ed)|disabled?|nicht|ne (?:prend|supporte)|no (?:admite|soporta))\b.{0,30}(?:script|, so)",
    r"you (?:need to|must|have to|should) (?:switch on|enable|turn on|activate|allow) (?:java ?script|scripts?|scripting)",
    r"(?:this|the) (?:application|app|page|site|website|viewer|document|content) (?:requires|needs) (?:java ?script|scripts?|scripting)",
    r"if nothing (?:appears|happens|loads|shows),? (?:please )?(?:allow|enable)",
    r"we (?:have )?detected that (?:java ?script|scripts?|scripting|script execution)",
)
FILLER = (
    r"(?:your|sample|example|dummy|placeholder|body|some|insert|enter|add|type|click to add) (?:text|copy|wording|content|title|heading|headline|caption)(?: (?:goes|comes|is|to go))?(?: here)?[\s.!…]*$",
    r"(?:text|content|copy|title|heading) (?:goes|comes|to follow|here)\b.{0,12}$",
    r"replace this (?:paragraph|text|section|sentence|line|copy|block)\b",
    r"this (?:section|paragraph|text|page|line|block|sentence) is (?:only |just )?(?:a |an )?(?:dummy|placeholder|filler|sample|blind|example)\b",
    r"(?:hier steht|hier kommt) (?:ihr|der|ein) (?:text|blindtext)|dies ist ein (?:blindtext|platzhalter)|(?:votre|texte) (?:texte|de remplissage|d['’]exemple)\b|(?:su|texto) (?:texto|de ejemplo|de relleno)\b",
)

#: Notices in other wordings: how a page addresses its reader, what failed or is asked for, and the words it has at most.
NOTICE_WORDS = 25
ADDRESSES = (
    r"^(?:we're |we are )?(?:sorry|oops|ooops|whoops|uh[- ]?oh|hmm|we|you|your|please|kindly|unable|cannot|can't|could not|couldn't|failed|error|fatal|nothing|something|it (?:looks|seems)|there (?:was|is|has been|seems)|"
    r"(?:the |this |that |your )?(?:requested |web ?)?(?:page|link|address|file|document|site|website|url|server|service|content|resource|item|connection|gateway)\b|request|invalid|bad|access|permission|login|sign[- ]?in|session)"
)
FAILS = (
    r"\b(?:not (?:be )?(?:found|located|reached|loaded|displayed|opened|available|responding|authori[sz]ed|allowed to (?:see|view|access|open))|"
    r"(?:couldn't|could not|can't|cannot|unable to|failed to|failure to|didn't|did not|having trouble|trouble|problems?) (?:to )?(?:\w+ )?(?:find|locate|load|display|open|reach|connect|process|complete|serve|retrieve|fetch|access|get|show|finding|loading|opening|reaching|connecting)|"
    r"does(?:n't| not) exist|isn't (?:here|available|working)|is not here|no longer (?:exists?|available|here|active|valid)|(?:has|have|may have) (?:been )?(?:moved|removed|deleted|expired|timed out|renamed)|went wrong|"
    r"(?:is|are) (?:currently |temporarily )?(?:broken|unavailable|down|offline|restricted|denied|forbidden|overloaded|invalid)|access (?:to (?:\w+ ){1,2})?(?:is |was |has been )?(?:denied|forbidden|restricted)|nothing (?:was |is )?found|too many (?:requests|attempts)|(?:took|taking) too long|(?:has|have) been (?:reset|refused|closed|logged out|signed out)|bad request|unexpected error)\b"
)
READER = r"\b(?:you|your|you're|we|us|our|to the server|sorry|oops|whoops|please|try again|retry|refresh|reload|go back|home ?page|requested|this (?:page|link|site|url|address|request)|that (?:page|link)|the (?:page|link|url|site|address) (?:you|may|could|can|does|cannot))\b"
SCRIPTS = r"\b(?:java ?script|scripts?|scripting)\b"
SCRIPT_STATE = r"\b(?:enabl\w*|disabl\w*|activat\w*|allow\w*|permit\w*|block\w*|unblock\w*|requir\w*|needs?|needed|supports?|supported|turn(?:ed|ing)?|switch(?:ed|ing)?|off|without|missing|not run|does(?:n't| not) run)\b"
SCRIPT_READER = (
    r"^(?:we're |we are )?(?:sorry|oops|please|kindly|you|your|we|this|the (?:page|site|website|app|application|viewer|content|form|document|map|chart|player|service)|java ?script|scripts?|scripting|to (?:view|see|use|continue|proceed|run|load|display|access|get)|"
    r"for (?:full|best|the)|it (?:looks|seems)|turn|switch|enable|activate|allow|unblock|without|browsers?|in order to|some (?:parts|features))\b"
)
SCRIPT_ASKS = r"\b(?:you|your|please|this (?:page|site|website|app|application|viewer|content|form|document|map|chart|player|service)|to (?:view|see|use|continue|proceed|run|load|display|access)|reload|refresh|(?:page|site|website|app|application|viewer|content|form|player) (?:needs|requires|will not|won't|does not|cannot|relies|depends))\b"

#: Slots as templates write them, and what a field is called in them.
FIELD = r"(?:(?:your|the|first|last|full|middle|company|client|customer|recipient|sender|contact|project|vendor|supplier|employee|user|job|order|invoice|account|phone|e-?mail|street|postal|start|end|due|current|today's) )*(?:name|date|time|company|address|title|number|no\.?|amount|e-?mail|phone|recipient|sender|signature|city|country|position|price|reference|ref|department|website|url|location|subject|salutation|greeting|day|month|year|author|reviewer|approver|client|customer|vendor|supplier|manager|project|product|value|unit|tag|id)"
SLOT = "|".join(
    (
        r"\{\{[^{}\r\n]{1,60}\}\}",
        r"\$\{[A-Za-z_][\w.]{0,40}\}",
        r"%\([A-Za-z_]\w{0,40}\)[sdfr]",
        r"%[A-Z][A-Z_]{1,40}%",
        r"@@\w{1,40}@@",
        r"<<[A-Za-z][\w ]{0,40}>>",
        r"«[A-Za-z_]{1,40}»",
        r"<[A-Za-z][\w ]{0,40} here>",
        r"\[(?:INSERT|ENTER|YOUR|SELECT|CHOOSE|FILL IN)\b[^\]\r\n]{0,40}\]",
        r"\[[^\[\]\r\n]{1,40} to be (?:entered|completed|filled in|added|confirmed|inserted|supplied|determined|advised)\]",
        r"(?<![\w\\)\]])\{\d{1,2}\}",
        r"(?<![\w\\)\]!$])\[(?i:" + FIELD + r")\](?![(\[:])",
        r"#\{[A-Za-z_][\w.]{0,40}\}",
        r"(?<![\w\\)\]$#{%=(,\[])\{(?i:" + FIELD.replace(" ", "[ _]") + r")\}(?![\w{(])",
        r"(?:[A-Za-z]: ?|\b(?:on|by|to|from|of|for|at|and|is|the|dear|mr|ms|mrs|no)\.? )_{3,}(?!\w)",
        r"(?m)^[ \t>*-]*(?:TODO|TBD|FIXME)[:, -]+(?i:write|add|insert|fill|complete|describe|replace|update|supply|provide|enter|put|expand|finish|check|confirm|text|content)\b",
    )
)
#: What stands right before a slot that is written about, not left open.
MENTION = r"(?<!such as |such as: |like |e\.g\. |for example |field |fields |variable |variables |token |tokens |marker |markers |called |named )"
#: Fenced and inline code, and double quotations.
QUOTED = r"(?s)```.*?(?:```|\z)|`[^`\r\n]*`|\"[^\"\r\n]*\"|“[^”\r\n]*”"
#: Where one record ends and the next begins.
RECORD_END = r"[\r\n\t]+| (?: +|(?<=[.!?…] ))"


def records(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``record`` (lower case, leading tags and signs taken off) of every line and sentence with a letter."""
    cut = documents.select("doc_id", F.explode(F.split(F.lower("text"), RECORD_END)).alias("record")).where(F.length("record") >= 3)
    plain = F.when(F.col("record").startswith("<"), F.regexp_replace("record", r"</?[a-z][^<>]{0,60}>", "")).otherwise(F.col("record"))
    return cut.where(F.col("record").rlike(r"\p{L}")).select("doc_id", F.regexp_replace(F.trim(plain), r"^[^\p{L}\p{N}<]++", "").alias("record"))


def masked(record: Column) -> Column:
    """A record with its variables as wildcards: from the first digit of a word on, but for the three digits of a status
    code, and names in quotation marks."""
    # A digit comes first in the pattern, so that most places are passed over at once.
    return F.regexp_replace(record, r'"[^"]*"|(?=\d)(?<!\d)(?!(?<!\S)[45]\d\d[:.,]?(?!\S))\S++', "*")


def leaf(template: Column) -> Column:
    """The leaf of the prefix tree that a template hangs from: its number of words, the first and the last ones."""
    size = F.length(template) - F.length(F.replace(template, F.lit(" "), F.lit("")))
    return F.concat_ws("\n", size.cast("string"), F.substring_index(template, " ", LEADING), F.substring_index(template, " ", -TRAILING))


def templates(cut: DataFrame) -> DataFrame:
    """``template`` and ``n`` (records that are equal to it but for variables)."""
    return cut.groupBy(masked(F.col("record")).alias("template")).agg(F.count("*").alias("n"))


class Template:
    """Words, None where the records differ, and the longest word of each of these places."""

    def __init__(self, words: list[str], record: str):
        self.words, self.widths, self.records = words, {}, [record]

    def takes(self, words: list[str], record: str) -> bool:
        """Whether the record is one of this template, which then has a wildcard wherever they differ."""
        same = list(map(eq, self.words, words))
        if len(words) != len(self.words) or sum(same) < ALIKE * len(same):
            return False
        for at, agrees in enumerate(same):
            if not agrees:
                self.widths[at] = max(self.widths.get(at, 0), len(self.words[at] or ""), len(words[at]))
                self.words[at] = None
        self.records.append(record)
        return True

    def row(self) -> tuple[str, list[str]]:
        # Wildcards as long as the longest word: what is told of a template within some distance holds for its records.
        return (self.records[0], []) if len(self.records) == 1 else (" ".join("*" * self.widths[at] if w is None else w for at, w in enumerate(self.words)), self.records)


def grown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``mined`` and ``records`` (none if it is only one, the same) of the templates of each leaf; rows come in order of leaves."""
    at, held = None, []
    rows: list[tuple[str, list[str]]] = []
    table = lambda: pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.string()))], names=["mined", "records"])
    for batch in batches:
        for leaf_key, record in zip(batch.column("leaf").to_pylist(), batch.column("template").to_pylist()):
            if leaf_key != at:
                rows.extend(t.row() for t in held)
                at, held = leaf_key, []
            words = record.split(" ")
            # Neighbours in order are the likeliest.
            if not any(t.takes(words, record) for t in reversed(held)):
                held.append(Template(words, record))
        if len(rows) >= 10_000:
            yield table()
            rows = []
    rows.extend(t.row() for t in held)
    if rows:
        yield table()


def tree(mined: DataFrame) -> DataFrame:
    """``mined`` (a template of a leaf of the tree) and ``records`` (the masked records that it stands for, none if it is
    itself the only one) of the masked records ``template``."""
    hung = mined.select(F.xxhash64(leaf(F.col("template"))).alias("leaf"), "template")
    return hung.repartition("leaf").sortWithinPartitions("leaf", "template").mapInArrow(grown, "mined string, records array<string>")


def judged(mined: DataFrame) -> DataFrame:
    """``template`` (a masked record) and ``kind`` of those that are residue, by the templates of the tree."""
    told = tree(mined).select("mined", "records", verdict(F.col("mined")).alias("told"))
    each = told.select("told", (F.size("records") > 0).alias("several"), F.explode(F.when(F.size("records") > 0, F.col("records")).otherwise(F.array("mined"))).alias("template"))
    own = F.when(F.col("told").isNull() & F.col("several"), verdict(F.col("template")))
    return each.select("template", F.coalesce("told", own).alias("kind")).where(F.col("kind").isNotNull())


def leaves(mined: DataFrame) -> DataFrame:
    """``leaf``, ``templates``, ``n`` (records) and ``kind`` (null if its templates differ in kind) of each leaf of the tree."""
    told = mined.select(leaf(F.col("template")).alias("leaf"), "n", F.coalesce(verdict(F.col("template")), F.lit("")).alias("kind"))
    kinds = told.groupBy("leaf").agg(F.count("*").alias("templates"), F.sum("n").alias("n"), F.min("kind").alias("low"), F.max("kind").alias("high"))
    return kinds.select("leaf", "templates", "n", F.when(F.col("low") == F.col("high"), F.nullif("low", F.lit(""))).alias("kind"))


def any_of(words: list[str]) -> str:
    """A pattern of any of the words that looks at each first letter once."""
    by = {c: sorted((w[1:] for w in words if w[0] == c), key=len, reverse=True) for c in sorted({w[0] for w in words})}
    return "(?:" + "|".join(f"{c}(?:{'|'.join(rest)})" for c, rest in by.items()) + ")"


#: Two neighbouring words of the lists, sought word by word from the beginning. Filler has them: if no two known words were
#: neighbours, at most (n + 1) / 2 of n words would be known, which is less than ``LOREM_SHARE`` of ``LOREM_WORDS`` or more.
KNOWN = any_of([*LOREM, *KEYBOARD]) + r"(?!\p{L})"
NEIGHBOURS = r"^[^\p{L}]*+(?:(?!" + KNOWN + r"[^\p{L}]++" + KNOWN + r")\p{L}++[^\p{L}]*+)*+\p{L}"


def verdict(template: Column) -> Column:
    """error_page, script_notice, filler, or null."""
    text = template
    # Counts by patterns: arrays of words would be built anew for each use.
    words = F.regexp_count(text, F.lit(r"\p{L}++"))
    share = lambda known: F.regexp_count(text, F.lit(r"(?<!\p{L})" + any_of(known) + r"(?!\p{L})")) >= words * LOREM_SHARE
    # Each count makes an array of its matches, so only records are counted in which two neighbouring words are known.
    lorem = text.rlike(NEIGHBOURS) & (words >= LOREM_WORDS) & (share(LOREM) | share(KEYBOARD))
    same = text.rlike(r"^(?:(\p{L}++)(?:[^\p{L}]++\1(?!\p{L})){2,}[^\p{L}]*$|(?:x{3,}+(?:[^\p{L}]++|$)){3,}$)")
    matches = lambda patterns: text.rlike("^(?:" + "|".join(patterns) + ")")
    # Other wordings: a short record that speaks to its reader of a failure, or of scripts that must run. The first pattern goes before the count of words.
    short = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit(""))) < NOTICE_WORDS
    said = lambda pattern: text.rlike(pattern.replace("'", "['’]"))
    every = lambda first, *others: reduce(and_, map(said, others), said(first) & short)
    return (
        F.when(matches(ERROR_PAGE), "error_page")
        .when(matches(SCRIPT_NOTICE) | (F.contains(text, F.lit("script")) & every(SCRIPTS, SCRIPT_READER, SCRIPT_STATE, SCRIPT_ASKS)), "script_notice")
        .when(every(ADDRESSES, FAILS, READER), "error_page")
        .when(lorem | same | matches(FILLER), "filler")
    )


def open_slots(text: Column) -> Column:
    """A template's slot stands unfilled in the text, outside quotations and code, and is not just written about."""
    likely = F.lit(False)
    for sign in ("{", "%", "@@", "<", "«", "[", "___", "TODO", "TBD", "FIXME"):
        likely = likely | text.contains(sign)
    return likely & F.regexp_replace(text, QUOTED, " ").rlike(MENTION + "(?:" + SLOT + ")")


def residue(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``kind`` of each document with ``error_page``, ``script_notice``, ``filler`` or ``placeholder``
    where content should be, however much real text is around it; one row a document, the first of these kinds.

    Null, empty and blank texts are no cases; repeated rows count once; very long texts are taken whole; other columns
    are ignored, whatever their names.
    """
    documents = documents.select("doc_id", "text").where(F.col("text").isNotNull())
    cut = records(documents)
    # Two hashes stand for a template (96 bits).
    key = lambda c: (F.xxhash64(c).alias("h1"), F.hash(c).alias("h2"))
    found = judged(templates(cut)).select(*key("template"), "kind")
    # Two steps, so that the template is made once for both hashes.
    told = cut.select("doc_id", masked(F.col("record")).alias("template")).select("doc_id", *key("template")).join(found, ["h1", "h2"]).select("doc_id", "kind")
    slots = documents.where(open_slots(F.col("text"))).select("doc_id", F.lit("placeholder").alias("kind"))
    order = F.array_position(F.array(*map(F.lit, ("error_page", "script_notice", "filler", "placeholder"))), F.col("kind"))
    return told.unionByName(slots).groupBy("doc_id").agg(F.min_by("kind", order).alias("kind"))
