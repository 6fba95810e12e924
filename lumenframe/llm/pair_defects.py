"""Problem 5: broken prompt and response pairs, each with its defect.

Method: refusal grammars and null markers are patterns of the plan itself; a pushdown parser over fences, brackets,
quotations, lists and markup finds answers that break off; greedy string tiling of the answer with the prompt finds
answers that only give back the question; script and function-word checks find answers in another language. Whether a
list item or an unpunctuated phrase is whole is decided by its last word and by statistics of all answers: does the word
usually go on, or is it the beginning of a longer word? Every answer is examined once, in one Arrow pass.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe.session import cut

#: Answers that stand for no answer.
NULL_MARKERS = ("none", "null", "nil", "nan", "na", "n/a", "n.a", "undefined", "empty", "no answer", "no response", "keine antwort", "sans réponse", "sin respuesta")
#: Words of an unpunctuated answer from which on it counts as a sentence even without a word that tells one.
SENTENCE_WORDS = 6
#: Least words of a tile, share of the prompt that the tiles must cover, and words that the answer may add.
TILE_WORDS, COPIED_SHARE, ADDED_WORDS = 3, 0.8, 3

#: Refusals as grammars of subject, negated modal and act, by language (Java patterns, case-insensitive).
_ACT_EN = r"(?:help|assist|answer|respond|reply|share|provide|comply|discuss|disclose|reveal|give|say|tell|talk|do|carry|support|fulfil|complete|process|engage|advise|comment|continue|proceed)"
REFUSALS = (
    rf"\b(?:i|we)\s?(?:cannot|can ?not|can['’]t|could not|couldn['’]t|won['’]t|will not|shall not|may not|must not|do not want to|don['’]t want to|would rather not|prefer not to|['’]d rather not)\s+(?:\w+\s+){{0,2}}?{_ACT_EN}\b",
    rf"\b(?:i am|i['’]m|we are|we['’]re)\s+(?:sorry,? )?(?:not|un)\s?(?:able|allowed|permitted|authori[sz]ed|willing|going|in a position)\s+to\s+(?:\w+\s+){{0,2}}?{_ACT_EN}\b",
    r"\b(?:i|we)\s+(?:must|have to|need to|am going to|will|would like to|respectfully)?\s*(?:decline|refuse)\b",
    r"\bi (?:have been|was|am) (?:told|instructed|asked|forbidden|required) not to\b",
    r"\bnot\b[^.!?]{0,40}\bi am (?:allowed|able|permitted|authori[sz]ed|willing) to\b",
    r"\b(?:something|a thing|nothing|task|topic|question|request)\b[^.!?]{0,20}\bi (?:won['’]t|will not|cannot|can['’]t|may not|am not)\b",
    r"\bagainst my (?:guidelines|rules|policy|policies|instructions|principles|programming)\b",
    r"\bno answer (?:will|can|may) be given\b|\boutside (?:of )?what i (?:may|can|am allowed to)\b",
    r"\b(?:ich|wir) (?:kann|können|darf|dürfen|werde|werden|möchte|will|muss)\b[^.!?]{0,60}\b(?:nicht|nichts|kein\w*|ablehnen)\b(?![^.!?]{0,30}(?:gefunden|finden|erwähnt|enthalten))",
    r"\b(?:kann|darf|werde|möchte|beantworte|gebe|sage) (?:ich|wir)\b[^.!?]{0,60}\b(?:nicht|nichts|kein\w*|ablehnen)\b(?![^.!?]{0,30}(?:gefunden|finden|erwähnt|enthalten))",
    r"\bich (?:lehne|verweigere)\b|\b(?:mir|uns) (?:ist es )?(?:nicht (?:erlaubt|gestattet)|untersagt|verboten)\b",
    r"\bje ne (?:peux|puis|vais|veux|souhaite|suis|répondrai|dois|donnerai|traiterai|dirai|fournirai)\b[^.!?]{0,20}\b(?:pas|rien)\b(?![^.!?]{0,12}trouv)",
    r"\bil (?:m['’]est|ne m['’]est pas) (?:interdit|défendu|impossible|permis|possible) de\b|\bje (?:refuse|dois refuser|décline)\b|\bje n['’]ai pas le droit\b",
    r"\bno (?:puedo|podré|voy a|debo|quiero|estoy autorizad[oa]|se me permite|me (?:está|es) permitido|me permiten)\b[^.!?]{0,24}(?:ayudar|responder|contestar|atender|decir|dar|facilitar|compartir|tratar|hablar|hacer|proporcionar)",
    r"\b(?:me niego|tengo prohibido|se me prohíbe|debo rechazar|rechazo)\b",
)

#: What a sentence of a refusal has of its speaker, regret, limit and demand, whatever its wording (lower case, straight
#: apostrophes), and what only a report of missing documents has.
SELF = r"\b(?:i|me|my|we|us|our|myself|as an? (?:ai|assistant|model)|this assistant)\b"
REGRET = r"\b(?:sorry|apolog\w+|afraid|unfortunately|regret\w*|forgive|pardon|thank you for (?:asking|understanding))\b"
LIMIT = r"\b(?:not|cannot|never|no|nothing|neither|nor|unable|refus\w+|declin\w+|unwilling|\w+n't)\b"
BARRED = (
    r"(?:\b(?:off the table|off[- ]limits|out of bounds|out of scope|no[- ]go|hands are tied|draw the line|steer clear|stay away|stay out|sit this one out|hold back)\b|"
    r"\b(?:have|has|need|going|prefer|choose|will|must|would|shall|may|can only|'ll|'d)(?: \w+){0,3}? (?:pass\b|abstain|refrain|say no|leave\b.{0,40}\b(?:unanswered|aside|alone|there|be)\b|leave (?:this|that|it)\b|turn\b.{0,40}\bdown|skip)|"
    r"(?:\bnot|n't|\bnever|\brather not|\bunable to|\bunwilling to|\buncomfortable)(?: \w+){0,3}? (?:comfortable|go there|get into|go into|take part|taking part|able to|allowed|permitted|authori[sz]ed|willing|free to|right for (?:me|us)|in a position|something (?:i|we)|go along|be (?:able|part|doing|answering|helping)|help|assist|answer|discuss|engag|touch|weigh in|speak|say|share|provid|do (?:this|that|it|so)|fulfil|oblige|entertain|comment|talking)|"
    r"\b(?:beyond|outside|against|violates?|conflicts? with|contrary to) (?:of )?(?:what (?:i|we)|my|our)\b|"
    r"\b(?:forbidden|prohibited|barred|restricted|prevented) (?:from|to)\b|\b(?:prevents?|keeps?|stops?|bars?|forbids?) (?:me|us)\b|\b(?:do(?:es)? not|do(?:es)?n't|will not|won't|cannot|can't) (?:allow|permit|let) (?:me|us)\b)"
)
ABSENT = r"\b(?:find|found|mention\w*|entry|entries|contain\w*|record\w*|index\w*|corpus|files?|documents?|store|cover\w*|listed|state[sd]?|specif\w+|available|information|data|sources?|search\w*|match\w*|see)\b"
MISSING = r"\b(?:find|found|mention\w*|entry|entries|contain\w*|record\w*|index\w*|corpus|match\w*)\b"
#: A word of a grammar stands in every refusal; texts without any of these pieces are none.
HINTS = (
    " not", "n't", "cannot", "unable", "declin", "refus", "against", "outside", "beyond", "sorry", "afraid", "apolog", "unfortunately", "regret", "forgive", "pardon", "thank you for", "no answer", "nothing",
    "off the table", "off limits", "off-limits", "out of bounds", "out of scope", "no go", "no-go", "to pass", "ll pass", "will pass", "must pass", "abstain", "refrain", "say no", "turn this", "turn that", "turn it", "skip", "leave",
    "rather", "never", "unwilling", "uncomfort", "violat", "conflict", "contrary", "forbid", "prohibit", "barred", "restricted", "prevent", "keeps ", "stops ", "tied", "draw the line", "steer clear", "stay away", "stay out", "sit this", "hold back",
    "nicht", "kein", "lehne", "verweiger", "untersagt", "verboten", "je ne ", "m'est", "interdit", "défendu", "refuse", "décline", "droit", "no puedo", "no podr", "no voy", "no debo", "no quiero", "no estoy", "no se me", "no me", "niego", "prohíb", "prohibido", "rechaz",
)

#: Fixed function words by language.
FUNCTION_WORDS = {
    "en": "the of and to in is was for on with that it at by an be may are not has this from after before which when what who how been were will must can should have had its their they there you your we i as or if no yes than then into about because".split(),
    "de": "der die das und den dem des ein eine einer einem im am an zu zur zum ist sind wurde wurden wird werden nicht mit von bei nach wegen um muss auf für durch sich noch keine kein beim vom als auch aus über ich sie wir er es war hat haben kann weil aber oder wenn dass".split(),
    "fr": "le la les de du des et un une au aux est été sont sur pour dans par à cause il elle ils faut qui que ne pas d'après comme ce cette son sa ses prochain dernier avec sans encore plus nous vous je mais ou où doit peut être était avant après toujours déjà".split(),
    "es": "el la los las de del y un una en es se fue para por con que no al según debe era demasiado porque está lo su como próxima último sin más pero o ya muy hay son ha han sobre este esta cuando también todavía".split(),
    "it": "il lo la i gli le di del della dei delle e un una è sono era stata stato per con che non al alla nel nella dal dalla si da ma anche come più ancora questo questa sul sulla durante prima dopo deve può ha hanno perché quando".split(),
    "pt": "o a os as de do da dos das e um uma em no na nos nas é são foi para por com que não ao à se mas mais como também ainda este esta pelo pela deve pode está tem porque quando já muito depois antes".split(),
    "nl": "de het een en van is zijn was werd wordt niet met voor door op aan bij naar om te dat die dit deze er ook nog maar als uit over moet kan heeft hebben omdat wanneer zonder geen".split(),
    "sv": "och att det som en ett är av för på med den till inte har de om var vid från men eller ska kan efter innan eftersom när utan denna detta också ännu".split(),
    "pl": "i w na z nie się że do jest to od po przez dla przy jak ale lub oraz był była było został została może musi ten ta który która które ponieważ jeszcze".split(),
    "tr": "ve bir bu için ile da de olarak değil çok daha sonra önce gibi kadar ama veya ancak olan olduğu göre her şu ne var yok".split(),
}
#: Language signs: letters, and elided articles.
LETTERS = {"de": "äößü", "fr": "èêëçœàù", "es": "ñ¿¡", "pt": "ãõ", "pl": "łżźśćąę", "tr": "şğı", "sv": "å"}
ELIDED = ("l'", "d'", "l’", "d’", "s'", "n'", "qu'", "c'", "j'")
#: Words that neither a sentence nor a phrase ends with, in the four languages of the prompts.
UNFINISHED = frozenset(
    (
        "the a an of and or but because if when while with by from to for at into than as is was are were be been has have had may must can will would should could shall "
        "which whose its their his her our your my between during under upon within without until since so although though where "
        "der die das und oder den dem des ein eine einen einem einer im am vom beim zum zur mit bei nach wegen um für durch weil wenn als dass ist wurde wird hat sowie gegen unter über "
        "le la les un une des du de et ou au aux à par pour dans sur avec sans parce que qui dont est sera très selon "
        "el los las del y o al por para con sin en porque cuando es fue será está se su muy según"
    ).split()
)
#: Verbs that make a clause of the words around them, and what a clause goes on with.
FINITE = frozenset("is was are were has had may must can will would should could shall does did ist sind war waren wurde wurden wird werden hat haben muss müssen kann können soll est sont était sera doit peut faut es son fue era será está están debe puede ha han".split())
GOES_ON = frozenset("and then|or then|and also|and so|such as|due to|in order|as well|und dann|und auch|sowie auch|et puis|et aussi|ainsi que|y luego|y también|así como".split("|"))
#: Names of the languages in the four languages, as a request for one uses them.
LANGUAGE_NAMES = {
    "en": r"english|englisch\w*|anglais\w*|inglés|ingles",
    "de": r"german|deutsch\w*|allemand\w*|alemán|aleman",
    "fr": r"french|französisch\w*|français\w*|francés|frances",
    "es": r"spanish|spanisch\w*|espagnol\w*|español|espanol|castellano",
    "it": r"italian|italienisch\w*|italien\w*|italiano",
    "pt": r"portuguese|portugiesisch\w*|portugais\w*|portugués|portugues",
    "nl": r"dutch|niederländisch\w*|holländisch\w*|néerlandais\w*|neerlandés|holandés",
    "sv": r"swedish|schwedisch\w*|suédois\w*|sueco",
    "pl": r"polish|polnisch\w*|polonais\w*|polaco",
    "tr": r"turkish|türkisch\w*|turc|turco",
    "cyrillic": r"russian|russisch\w*|russe|ruso",
    "greek": r"greek|griechisch\w*|grec|griego",
    "arabic": r"arabic|arabisch\w*|arabe|árabe",
    "han": r"chinese|chinesisch\w*|chinois\w*|chino|japanese|japanisch\w*|japonais\w*|japonés",
    "kana": r"japanese|japanisch\w*|japonais\w*|japonés",
    "hangul": r"korean|koreanisch\w*|coréen\w*|coreano",
    "hebrew": r"hebrew|hebräisch\w*|hébreu|hebreo",
    "devanagari": r"hindi",
    "thai": r"thai|thailändisch\w*|thaï|tailandés",
}
SCRIPTS = (("cyrillic", 0x400, 0x52F), ("greek", 0x370, 0x3FF), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x77F), ("devanagari", 0x900, 0x97F), ("thai", 0xE00, 0xE7F), ("kana", 0x3040, 0x30FF), ("han", 0x4E00, 0x9FFF), ("hangul", 0xAC00, 0xD7AF))


def says_nothing(answer: Column) -> Column:
    bare = F.lower(F.regexp_replace(answer, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))
    return answer.isNull() | (bare == "") | bare.isin(*NULL_MARKERS)


def declines(answer: Column) -> Column:
    """A refusal by one of the grammars, or a sentence that speaks of the speaker, a limit and a regret or a bar, but
    not of what documents hold. Only answers with a hint are read by the patterns."""
    text = F.replace(F.lower(answer), F.lit("’"), F.lit("'"))
    hinted = F.lit(False)
    for hint in HINTS:
        hinted = hinted | F.contains(text, F.lit(hint))
    by_grammar = F.lit(False)
    for pattern in REFUSALS:
        by_grammar = by_grammar | answer.rlike("(?iu)" + pattern)

    def refuses(sentence: Column) -> Column:
        barred = sentence.rlike(BARRED) & ~sentence.rlike(MISSING)
        regretted = sentence.rlike(LIMIT) & sentence.rlike(REGRET) & ~sentence.rlike(ABSENT)
        return sentence.rlike(SELF) & (barred | regretted)

    by_parts = F.exists(F.split(text, r"(?<=[.!?])\s+|\n+"), refuses)
    return F.when(hinted, by_grammar | F.when(text.rlike(SELF), by_parts).otherwise(False)).otherwise(False)


def words_of(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


LANGUAGES = tuple(FUNCTION_WORDS)
TELLING: dict[str, tuple[int, ...]] = {}
for _at, _words in enumerate(FUNCTION_WORDS.values()):
    for _w in _words:
        TELLING[_w] = (*TELLING.get(_w, ()), _at)
_WORD = re.compile(r"\b[^\W\d_]+(?:['’][^\W\d_]+)?\b")


def language(text: str) -> str | None:
    """The language (or foreign script) that most of the text's telling words belong to; null if nothing tells."""
    plain = text.isascii()
    if not plain and max(text) > "\u036f":
        scripts = Counter(name for c in text if ord(c) > 0x36F for name, low, high in SCRIPTS if low <= ord(c) <= high)
        if scripts and max(scripts.values()) * 3 > sum(c.isalpha() for c in text):
            return scripts.most_common(1)[0][0]
    low = text.lower()
    score = [0.0] * len(LANGUAGES)
    for word in _WORD.findall(low):
        for k in TELLING.get(word, ()):
            score[k] += 1
        if word[1:2] in "'’" and word[:2] in ELIDED:
            score[2] += 1
    if not plain:
        for name, letters in LETTERS.items():
            score[LANGUAGES.index(name)] += sum(map(low.count, letters)) * 0.6
    first, second = sorted(score, reverse=True)[:2]
    if first < 2 or first - second < 1:
        return None
    return LANGUAGES[score.index(first)]


ASKED = {name: re.compile(rf"\b(?:in|into|auf|ins|en|al|à l['’]|to)\s+(?:\w+\s+)?(?:{pattern})\b", re.IGNORECASE) for name, pattern in LANGUAGE_NAMES.items()}


def asked_languages(prompt: str) -> set[str]:
    return {name for name, pattern in ASKED.items() if pattern.search(prompt)}


def tiles(answer: list[str], prompt: list[str], least: int = TILE_WORDS) -> tuple[list[bool], list[bool]]:
    """Greedy string tiling: the words of answer and prompt covered by common runs, longest first, none used twice."""
    in_a, in_p = [False] * len(answer), [False] * len(prompt)
    places: dict[tuple, list[int]] = {}
    for j in range(len(prompt) - least + 1):
        places.setdefault(tuple(prompt[j : j + least]), []).append(j)
    while True:
        best = (0, 0, 0)
        for i in range(len(answer) - least + 1):
            for j in places.get(tuple(answer[i : i + least]), ()):
                n = 0
                while i + n < len(answer) and j + n < len(prompt) and answer[i + n] == prompt[j + n] and not in_a[i + n] and not in_p[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        n, i, j = best
        if n < least:
            return in_a, in_p
        in_a[i : i + n] = [True] * n
        in_p[j : j + n] = [True] * n


def gives_back(answer: list[str], prompt: list[str]) -> bool:
    """The answer is the prompt, once or more, with a few framing words at most."""
    if not answer or not prompt:
        return False
    # The tiles can't cover more of the prompt than the words that both have.
    both = set(answer)
    if sum(w in both for w in prompt) < COPIED_SHARE * len(prompt):
        return False
    left, share, rounds = answer, 0.0, 0
    while len(left) > ADDED_WORDS and rounds < 8:
        in_a, in_p = tiles(left, prompt, min(TILE_WORDS, len(prompt)))
        share = max(share, sum(in_p) / len(prompt))
        rest = [w for w, covered in zip(left, in_a, strict=True) if not covered]
        if len(rest) == len(left):
            return False
        left, rounds = rest, rounds + 1
    return share >= COPIED_SHARE or answer == prompt


OPENERS = re.compile(r"```|~~~|[<(\[{“«\"]")
CLOSES = {")": "(", "]": "[", "}": "{", "”": "“", "»": "«"}


def open_at_end(text: str) -> str | None:
    """What is still open where the text ends, by a pushdown parser: fence, tag, bracket or quotation. Inside a fence
    only the fence counts; a quotation mark opens at a word's beginning and closes at its end."""
    if not OPENERS.search(text):
        return None
    stack: list[str] = []
    pieces = re.split(r"```|~~~", text)
    fence = len(pieces) % 2 == 0
    for line in (line for piece in pieces[::2] for line in piece.split("\n")):
        for m in re.finditer(r"</?([a-zA-Z][\w-]*)(?:\s[^<>]*)?>|[()\[\]{}“”«»]|(?<!\w)[\"](?=\w)|(?<=[\w.,;:!?])[\"]", line):
            c = m.group()
            if c[0] == "<" and len(c) > 1:
                if c[1] == "/":
                    if c[2:-1].lower() in stack:
                        while stack.pop() != c[2:-1].lower():
                            pass
                elif not c.endswith("/>"):
                    stack.append(m.group(1).lower())
            elif c == '"':
                if '"' in stack:
                    while stack.pop() != '"':
                        pass
                elif line[m.end() : m.end() + 1].isalnum() and not line[: m.start()][-1:].isalnum():
                    stack.append('"')
            elif c in CLOSES:
                if CLOSES[c] in stack:
                    while stack.pop() != CLOSES[c]:
                        pass
            else:
                stack.append(c)
    return "fence" if fence else stack[-1] if stack else None


LIST_ITEM = re.compile(r"^\s*(?:[-*•+]|\d+[.)])\s+(.*)$")
ENDS = re.compile(r"(?:[.!?…。！？:|>][\"'”’»)\]*_]*|[\"”»)\]])$")
ITEM_ENDS = re.compile(r"[.!?…:;\"”»)\]]$")
FENCED, ASKS_FOR = re.compile(r"(?s)```.*?(?:```|$)"), re.compile(r"(?i)^\s*answer in \w+\s*:")


def breaks_off(last: str, own: list[str]) -> bool:
    """An unpunctuated last line of prose is no whole phrase: it ends in a word or sign that goes on, or is a clause."""
    if last[-1] in ",;-–(":
        return True
    low = [w.lower().strip(",;:()\"'") for w in own]
    if len(low) > 1 and (low[-1] in UNFINISHED or " ".join(low[-2:]) in GOES_ON):
        return True
    return len(own) >= SENTENCE_WORDS or (len(low) > 2 and not FINITE.isdisjoint(low[1:]))


def examine(prompt: str | None, answer: str) -> tuple[str | None, str | None, bool]:
    """Defect of an answer that says something and declines nothing; else the last word of its list item or unpunctuated
    phrase, to be judged by all answers, and whether it is a list's."""
    prompt = prompt or ""
    if gives_back(words_of(answer), words_of(prompt)):
        return "copied_question", None, False
    text = answer.rstrip()
    last = text.rsplit("\n", 1)[-1]
    item = LIST_ITEM.match(last) if "\n" in text else None
    if open_at_end(text):
        return "truncated", None, False
    tail = None
    if not item and not text.endswith(("```", "~~~")) and not ENDS.search(text):
        own = last.split()
        if breaks_off(last, own):
            return "truncated", None, False
        tail = own[-1].lower() if len(own) > 1 else None
    rest = FENCED.sub(" ", answer) if "```" in answer else answer
    if prompt and rest.lower().startswith(prompt.lower().rstrip(" ?.!")):
        rest = rest[len(prompt) :]
    spoken = language(rest)
    if spoken:
        own = language(ASKS_FOR.sub(" ", prompt))
        if own and spoken != own and spoken not in asked_languages(prompt):
            return "other_language", None, False
    if item and item.group(1).split() and not ITEM_ENDS.search(last):
        tail = item.group(1).split()[-1].lower()
    return None, tail, item is not None


def cut_lists(answers: DataFrame, tails: DataFrame) -> DataFrame:
    """Those of ``tails`` (rec_id, tail, listed) that are no end of a list item or phrase, by the words of all answers: in
    a list the word stands more often inside items than at their end; or it is unknown and begins a longer known word."""
    number = lambda c: F.regexp_replace(c, r"\d[\d.,]*", "9")
    items = answers.select(F.explode(F.expr(r"regexp_extract_all(answer, '(?m)^\\s*(?:[-*•+]|\\d+[.)])\\s+(.*)$', 1)")).alias("item"))
    items = items.select(F.filter(F.split(F.lower(number(F.col("item"))), r"\s+"), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    use = items.select(F.posexplode("w").alias("at", "word"), F.size("w").alias("n"))
    use = use.groupBy("word").agg(F.count_if(F.col("at") == F.col("n") - 1).alias("final"), F.count_if(F.col("at") < F.col("n") - 1).alias("inside"))
    every = F.filter(F.split(F.lower(F.regexp_replace(number(F.col("answer")), r"[^\p{L}\p{N}'/-]+", " ")), " "), lambda w: w != "")
    inner = answers.select(every.alias("w")).where(F.size("w") > 1).select(F.explode(F.slice("w", F.lit(1), F.size("w") - 1)).alias("word"))
    known = inner.groupBy("word").count()
    begun = known.where(F.length("word") > 1).select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda n: F.substring("word", F.lit(1), n))).alias("word")).distinct()
    ends = tails.withColumn("word", number(F.col("tail")))
    words = ends.select("word").distinct()
    judged = words.join(use, "word", "left").join(known, "word", "left").join(begun.withColumn("begins", F.lit(True)), "word", "left")
    goes_on = F.coalesce(F.col("inside") > F.col("final"), F.lit(False))
    in_word = F.col("count").isNull() & F.coalesce(F.col("begins"), F.lit(False))
    judged = judged.where(goes_on | in_word).select("word", in_word.alias("in_word"))
    return ends.join(judged, "word").where("listed or in_word").select("rec_id", F.lit("truncated").alias("defect"))


def defective_pairs(pairs: DataFrame) -> DataFrame:
    """``rec_id`` and ``defect`` of each defective pair of ``rec_id``, ``prompt``, ``answer``, one row a pair.

    ``empty``: null, blank or a null marker. ``copied_question``, ``refusal``, ``truncated``, ``other_language``: as the
    functions above decide, in this order. A null prompt copies nothing and has no language. Repeated rows count once;
    very long answers are examined whole; other columns (``stop`` among them) are ignored.
    """
    rows = pairs.select("rec_id", "prompt", "answer").distinct()
    answer = F.col("answer")
    judged = F.when(says_nothing(answer), "empty").when(declines(answer), "refusal")
    schema = T.StructType([pairs.schema["rec_id"], T.StructField("defect", T.StringType()), T.StructField("tail", T.StringType()), T.StructField("listed", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for prompt, answer, told in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                if told == "empty":
                    found.append((told, None, False))
                elif told:
                    found.append(("copied_question" if gives_back(words_of(answer), words_of(prompt or "")) else told, None, False))
                else:
                    found.append(examine(prompt, answer))
            kept = pa.array([n for n, (defect, tail, _) in enumerate(found) if defect or tail], pa.int64())
            found = [f for f in found if f[0] or f[1]]
            columns = (pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.string(), pa.bool_())))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(kept), *columns], names=[f.name for f in schema])

    # Defects and tails are few and short, and asked twice: cut, so that every answer is examined once.
    seen = cut(rows.select("rec_id", "prompt", "answer", judged.alias("judged")).mapInArrow(run, schema))
    lists = cut_lists(rows.where("answer is not null").select("answer"), seen.where("defect is null"))
    return seen.where("defect is not null").select("rec_id", "defect").unionByName(lists).distinct()
