"""Defective prompt and response pairs: empty, copied, refusing, truncated answers and answers in another language.

Copies are found by aligning response with prompt: shingle containment, then, for what passes, the longest common subsequence.
Refusals are found by aligning every sentence with templates of refusals and of what goes with them. Language is told by
profiles of character trigrams, fitted on a bounded sample of labelled documents. What is empty or truncated is told by column
expressions, and empty answers never leave Spark. A request for the very thing (translation, repetition, a bare word) is respected.
"""

import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.plans.lineage import stored


SHINGLE = 3
LIKE = 0.15  # least share of the response's shingles that the prompt has, for the two to be aligned; with less, their words must be nearly the same
COPIED = 0.8  # least share of response words in their common subsequence
GIVEN_BACK = 0.6  # least share of the prompt's words in the common subsequence
ALIGNED = 0.8  # least share of a template's words that a sentence has in order

# Stand-ins for a missing text.
STAND_INS = r"^(none|null|nil|undefined|nan|n\s?a|empty|no (content|response|answer|output|data|text|result)|not available|missing|keine antwort|kein inhalt|leer|aucune réponse|vide|sin respuesta|vacío|خالی|بدون پاسخ)$"
# Requests for the very thing that is a defect otherwise.
WANTS_TRANSLATION = r"(?iU)^\W*(please |bitte |por favor,? |s'il (te|vous) plaît,? |لطفا )?(translate|übersetz|tradui|traduc|traduz)|برگردان|ترجمه|\b(translate|render|rewrite) (this|it|the following)?.{0,40}\b(in|into|to) (english|german|french|spanish|persian|farsi)|\b(answer|reply|respond|write) in (english|german|french|spanish|persian|farsi)\b|\b(antworte|schreib\w*) auf (englisch|deutsch|französisch|spanisch|persisch)|\b(réponds?|répondez|écri\w+) en (anglais|allemand|français|espagnol|persan)|\b(responde|contesta|escribe) en (inglés|alemán|francés|español|persa)"
WANTS_REPETITION = r"(?iU)\b(repeat|echo|say it back|copy|quote|recite)\b.{0,60}(line|text|sentence|word|exactly|colon|back|following|as it is|without changes)|\bword for word\b|\bverbatim\b|^\W*wiederhol\w*\b|\bwortwörtlich\b|\bwort für wort\b|^\W*rép[èé]t\w*\b|\bmot pour mot\b|^\W*rep[ií]t\w*\b|\bpalabra por palabra\b|تکرار کن|کلمه به کلمه|عین همین"
WANTS_BARE = r"(?iU)\b(yes or no|name only|number only|one word|only the (name|number|word|path))\b|\b(ja oder nein|nur (der|die|das|den)? ?(name|zahl|wort|pfad)\w*)\b|\b(oui ou non|(nom|nombre|chiffre) seulement|seulement le (nom|nombre))\b|\b(sí o no|solo (el|la) (nombre|número|cifra)|(nombre|número) solamente)\b|بله یا (خیر|نه)|فقط (نام|عدد)"

LANGUAGES = ("en", "de", "fr", "es", "fa")
SAMPLE = 400  # documents per language that the profiles are fitted on, the first by a hash of their id
SLOTS = 1 << 15  # places for hashes of trigrams
TRIGRAMS = 14  # that a text must have for its language to be told
MARGIN = 0.25  # nats per trigram by which a language must be ahead of the next

# Templates of refusals and of the sentences that come with them; what a sentence has besides is its subject.
REFUSALS = """
i'm sorry but i can't help with | i'm sorry but i am unable to assist with | i'm sorry but i have to decline a discussion of | i'm afraid i can't help with | i'm afraid i won't comment on
i'm afraid i have to decline | my apologies i can't help with | my apologies i am unable to assist with | my apologies i won't comment on | unfortunately i can't help with | unfortunately i am unable to assist with
unfortunately i won't comment on | unfortunately i won't be able to answer | for safety reasons i can't help with | for safety reasons i won't comment on | for safety reasons i am unable to assist with
it isn't possible for me to advise on | i have to decline a discussion of | i cannot assist with this request | i can't assist with that | i must decline to work on | as a language model i am not able to do this
as an ai i can't do that | sorry this is outside what i may do | i can't comply with this request | i won't provide that | that is something i am not permitted to discuss | i'd rather not provide guidance on | my guidelines do not let me respond to this | i am not allowed to answer this
dabei kann ich nicht helfen | diese anfrage darf ich leider nicht beantworten | das kann ich leider nicht tun | als sprachmodell darf ich das nicht | dazu darf ich nichts sagen | dazu möchte ich mich nicht äußern | als sprachmodell ist es mir nicht möglich das zu tun
je ne peux pas vous aider sur ce point | je ne peux pas répondre à cette demande | je ne suis pas en mesure de répondre | il m'est impossible de répondre | je ne suis pas autorisé à le faire | en tant que modèle de langage je ne peux pas | je préfère ne pas traiter ce sujet
lo siento no puedo ayudarte con eso | como modelo de lenguaje no tengo permitido hacerlo | no puedo responder a esta petición | no me está permitido responder | prefiero no tratar ese asunto
نمی‌توانم در این مورد کمک کنم | اجازه ندارم به این درخواست پاسخ بدهم | نمی‌توانم به این پرسش پاسخ دهم | این کار از توان من بیرون است و آن را انجام نمی‌دهم
"""  # fmt: skip
COMPANIONS = """
sharing details about could be misused | the request touches and i have to stay within my limits | it would not be appropriate for me to comment on | is there something else i can do for you
thank you for understanding | please contact the team that owns it | you may want to ask a qualified person | i don't have permission to look at
das liegt außerhalb meiner vorgaben | bitte wende dich an die zuständige stelle | kann ich sonst etwas für dich tun | einzelheiten zu gebe ich nicht weiter | danke für dein verständnis | es tut mir leid
cela sort du cadre qui m'est fixé | merci de vous adresser au service concerné | puis-je vous aider autrement | je ne donne pas de détails sur | merci de votre compréhension | je suis désolé
eso queda fuera de mis límites | dirígete al equipo responsable por favor | puedo ayudarte con otra cosa | no doy detalles sobre | gracias por tu comprensión | lo siento
این بیرون از حد من است | کار دیگری هست که انجام دهم | درباره چیزی نمی‌گویم | لطفاً از گروه مسئول بپرسید | متأسفم
"""  # fmt: skip


def bind(column: Column, use) -> Column:
    """`use` of a column that is computed once, however often the result names it."""
    return F.element_at(F.transform(F.array(column), use), 1)


def common_length(a: list, b: list) -> int:
    """Length of the longest common subsequence, by bits."""
    at: dict = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        u = v & at.get(y, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def plain_words(text: str) -> list[str]:
    return [w for w in ("".join(c for c in t if c.isalnum() or c in "'‌") for t in text.casefold().replace("’", "'").split()) if w]


def _templates(block: str) -> list[list[str]]:
    return [plain_words(t) for line in block.strip().splitlines() for t in line.split("|")]


_REFUSALS, _COMPANIONS = _templates(REFUSALS), _templates(COMPANIONS)
_ALL = [(t, refuses) for block, refuses in ((_REFUSALS, True), (_COMPANIONS, False)) for t in block]
_WITH: dict[str, list[tuple[int, int]]] = {}  # of each word the templates that have it, and how often
for _i, (_t, _) in enumerate(_ALL):
    for _w, _n in Counter(_t).items():
        _WITH.setdefault(_w, []).append((_i, _n))


def aligned(sentence: list[str]) -> tuple[bool, bool]:
    """Whether the sentence is aligned with a refusal, and whether with anything that goes with one.

    A template may stand anywhere among the first words; what the sentence has after it is its subject.
    """
    shared: Counter = Counter()
    for w in set(sentence):
        for i, n in _WITH.get(w, ()):
            shared[i] += n
    refuses = goes_along = False
    for i, n in shared.items():
        t, refusal = _ALL[i]
        if n >= ALIGNED * len(t) and not (refuses if refusal else goes_along) and common_length(t, sentence[: 2 * len(t) + 8]) >= ALIGNED * len(t):
            refuses, goes_along = refuses or refusal, goes_along or not refusal
    return refuses, goes_along


def is_refusal(response: str) -> bool:
    """Every sentence is one of a refusal or goes with one, and at least one refuses."""
    refused = False
    for s in re.split(r"(?<=[.!?؟])[\"*_)”»\s]+|\n+", response):
        if w := plain_words(s):
            refuses, goes_along = aligned(w)
            if not refuses and not goes_along:
                return False
            refused = refused or refuses
    return refused


def containment(prompt: list[str], response: list[str]) -> float:
    """Share of the response's distinct shingles (of fewer words if it is shorter) that the prompt, said twice, has."""
    n = min(SHINGLE, len(response))
    shingles = lambda w: {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}
    mine = shingles(response)
    return len(mine & shingles(prompt + prompt)) / len(mine) if mine else 0.0


def is_copy(prompt: str, response: str) -> bool:
    """The response is words of the prompt in order, most of the prompt, once or several times, with nothing of its own after."""
    a, b = plain_words(prompt), plain_words(response)
    if a == b or not a or not b:
        return bool(a) and a == b
    if containment(a, b) < LIKE and (Counter(a * max(1, round(len(b) / len(a)))) & Counter(b)).total() < COPIED * len(b):
        return False  # fewer words in common than a common subsequence must have
    shared = common_length(a, b)
    times = max(1, round(len(b) / len(a)))
    if times > 1:
        shared = min(common_length(a * times, b), len(b))
    last = set(zip(a, a[1:]))
    answered = len(b) > len(a) * times and (b[-2], b[-1]) not in last
    return shared >= COPIED * len(b) and shared >= GIVEN_BACK * len(a) and not answered


# --- language ----------------------------------------------------------------------------------------------------------

_CODE = re.compile(r"(```|~~~).*?(\1|$)|`[^`\n]*`?", re.S)
_DATA = re.compile(r"^\s*[|{\[].*$", re.M)
_NAMES = re.compile(r"\S*[\d/_\\{}=<>]\S*")
_LETTERLESS = re.compile(r"[\W\d_]+")


def prose(text: str) -> str:
    """Words in lower case, without code, paths, identifiers, numbers and markup."""
    return _LETTERLESS.sub(" ", _NAMES.sub(" ", _DATA.sub(" ", _CODE.sub(" ", text)))).strip().lower()


def trigrams(plain: str) -> np.ndarray:
    codes = np.frombuffer(f" {plain} ".encode("utf-32-le"), dtype=np.uint32)
    h = codes[:-2] * np.uint32(0x9E3779B1) + codes[1:-1] * np.uint32(0x85EBCA77) + codes[2:] * np.uint32(0xC2B2AE3D)
    return (h ^ (h >> np.uint32(15))) % np.uint32(SLOTS)


class Profiles(NamedTuple):
    """Log-probabilities of trigrams by language, and the score per trigram below which a text of its length is in no language known."""

    log_p: np.ndarray
    floor: np.ndarray


def fit_profiles(documents: DataFrame) -> Profiles:
    """From at most SAMPLE documents (doc_id, text, lang) per language; languages without any have a flat profile."""
    lang = F.substring(F.lower("lang"), 1, 2)
    known = documents.where(lang.isin(*LANGUAGES) & F.col("text").isNotNull()).select("doc_id", lang.alias("lang"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    drawn = stored(known.withColumn("rank", rank).where(F.col("rank") <= SAMPLE).select("doc_id", "lang"))
    counts, texts = np.full((len(LANGUAGES), SLOTS), 0.05), {x: [] for x in LANGUAGES}
    for row in documents.select("doc_id", "text").join(F.broadcast(drawn), "doc_id").select("lang", "text").toLocalIterator():
        for line in row.text.splitlines():
            if len(plain := prose(line)) >= 40:
                texts[row.lang].append(trigrams(plain))
    for i, x in enumerate(LANGUAGES):
        for grams in texts[x]:
            np.add.at(counts[i], grams, 1)
    log_p = np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32)
    scores = [np.array([log_p[i, g].mean() for g in texts[x]] or [-20.0]) for i, x in enumerate(LANGUAGES)]
    return Profiles(log_p, np.array([np.median(x) - 2.0 for x in scores]))


def language(text: str | None, profiles: Profiles) -> tuple[str | None, np.ndarray | None]:
    """en, de, fr, es, fa, other (another script) or null where there is too little to tell, and the score of each profile."""
    plain = prose(text or "")
    if len(plain) < TRIGRAMS:
        return None, None
    codes = np.frombuffer(plain.replace(" ", "").encode("utf-32-le"), dtype=np.uint32)
    arabic, latin = ((codes >= 0x600) & (codes < 0x780)).mean(), ((codes < 0x250) | (codes - np.uint32(0x1E00) < 0x100)).mean()
    if arabic < 0.6 and latin < 0.4:
        return "other", None
    score = profiles.log_p[:, trigrams(plain)].mean(axis=1)
    order = np.argsort(-score)
    return (LANGUAGES[order[0]] if score[order[0]] - score[order[1]] >= MARGIN else None), score


def in_other_language(prompt: str | None, response: str, profiles: Profiles) -> bool:
    """Whether the prose of both can be told and differs, or that of the response is in no language known."""
    asked, _ = language(prompt, profiles)
    if asked is None:
        return False
    answered, score = language(response, profiles)
    if answered is None and score is None:
        return False
    if score is not None and asked != "other" and score[LANGUAGES.index(asked)] < profiles.floor[LANGUAGES.index(asked)] and len(prose(response)) >= 40:
        return True
    return answered is not None and answered != asked


def _align(profiles):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Adds copied, refused and other_language for the rows that are not empty."""
        known = profiles.value
        for b in batches:
            rows = list(zip(b["empty"], b["given_text"], b["bare"], b["prompt"], b["response"]))
            copied = [not empty and not given and isinstance(p, str) and is_copy(p, r) for empty, given, _, p, r in rows]
            refused = [not empty and is_refusal(r) for empty, _, _, _, r in rows]
            other = [not (empty or given or bare or c or f) and in_other_language(p, r, known) for (empty, given, bare, p, r), c, f in zip(rows, copied, refused)]
            yield b.assign(copied=copied, refused=refused, other_language=other)

    return run


def words(text: Column) -> Column:
    """Words as `plain_words` has them, in Spark."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}'\x{200c}\s]", ""), r"\s+"), lambda w: w != "")


def is_empty(response: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(response, r"(?s)<[a-zA-Z/!][^>]*>", " "), r"&\w+;", " ")
    said = F.trim(F.regexp_replace(F.lower(bare), r"[^\p{L}\p{N}]+", " "))
    return response.isNull() | (said == "") | said.rlike(STAND_INS)


CUT_NOTE = r"(?iU)(?:\[[^\]\n]*\b(?:closed|cut|interrupted|truncated|reached|aborted|lost|ended|stopped|limit)\b[^\]\n]*\]|<(?:max_tokens|eos|cut|truncated|length)>|\bfinish_reason\W+(?:length|max_tokens))$"
ITEM = r"^([-*+•]|\d+[.)])\s+"
# Words for numbers from two on, and what a list is announced to have.
NUMBERS = ("two|zwei|deux|dos|دو", "three|drei|trois|tres|سه", "four|vier|quatre|cuatro|چهار", "five|fünf|cinq|cinco|پنج", "six|sechs|seis|شش", "seven|sieben|sept|siete|هفت", "eight|acht|huit|ocho|هشت", "nine|neun|neuf|nueve|نه", "ten|zehn|dix|diez|ده")
PARTS = "steps|points|things|reasons|items|parts|risks|changes|schritte|punkte|dinge|gründe|teile|risiken|änderungen|étapes|points|choses|raisons|parties|risques|changements|pasos|puntos|cosas|razones|partes|riesgos|cambios|گام|مرحله|قدم|نکته|دلیل|بخش|مورد"
ANNOUNCED = rf"(?iU)\b({'|'.join(NUMBERS)}|\d{{1,2}})\s+(?:\p{{L}}+\s+)?(?:{PARTS})\b[^.!?؟\n]*[.:]?\s*\n\s*(?:[-*+•]|\d+[.)])\s"


def is_short_of_items(text: Column) -> Column:
    """Whether a list has fewer items than the line before it announces."""
    by_word = F.create_map(*(F.lit(x) for n, words in enumerate(NUMBERS, 2) for word in words.split("|") for x in (word, n)))
    announced = F.lower(F.regexp_extract(text, ANNOUNCED, 1))
    n = F.coalesce(announced.try_cast("int"), F.try_element_at(by_word, announced))
    return text.rlike(ANNOUNCED) & (F.regexp_count(text, F.lit(r"(?mU)^\s*(?:[-*+•]|\d+[.)])\s")) < F.coalesce(n, F.lit(0)))


def is_truncated(response: Column) -> Column:
    """Open fences and brackets, a broken table row or list item, a list short of what was announced, a sentence without its end, or a note of the cut.

    A last line that is a path, a name, a label with its value or an item of a list of phrases needs no full stop.
    """
    count = lambda c, p: F.regexp_count(c, F.lit(p))

    def whole(text: Column) -> Column:
        last = F.trim(F.element_at(F.split(text, r"\r\n|\n|\r"), -1))
        return (
            F.when(text.rlike(CUT_NOTE) | is_short_of_items(text) | (count(text, r"(?m)^\s*(```|~~~)") % 2 == 1), True)
            .when(text.rlike(r"(```|~~~)[\"*_)”]*$"), False)
            .when(text.rlike(r"^\s*[\[{]\s*[\"{\[\d]"), unbalanced(text))
            .otherwise(bind(last, lambda line: of_line(text, line)))
        )

    def unbalanced(c: Column) -> Column:
        return (count(c, r"[\[{]") != count(c, r"[\]}]")) | (count(c, r"\"") % 2 == 1)

    def of_line(text: Column, last: Column) -> Column:
        header = F.regexp_extract(text, r"(?s)(?:^|\n)(\|[^\n]*)\n\s*\|[ :|-]+\n", 1)
        broken_row = ~last.endswith("|") | ((header != "") & (count(last, r"\|") != count(header, r"\|")))
        inner = F.regexp_replace(F.regexp_replace(last, ITEM, ""), r"[*_]+$", "")
        return F.when(last.rlike(r"^[\[{]\s*[\"{\[]"), unbalanced(last)).when(last.startswith("|"), broken_row).otherwise(bind(inner, lambda i: of_sentence(text, last, i)))

    def of_sentence(text: Column, last: Column, inner: Column) -> Column:
        ended = inner.rlike(r"[.!?…؟。！？][\"'”»)*_\]]*$|[\x{2190}-\x{2bff}\x{1f000}-\x{1faff}]\x{fe0f}?$")
        label = inner.rlike(r"^[^.!?]{1,60}[:=] ?\S+$|^\S*[/_.\d]\S*(,? \S*[/_.\d]\S*)*$|^`[^`]*`(,? `[^`]*`)*$|^[→⇒>]")
        open_bracket = (count(inner, r"\(") > count(inner, r"\)")) & ~ended
        hanging = inner.rlike(r"[,;:(\[{–—/=&+-]$") | (count(last, "`") % 2 == 1) | open_bracket
        cut_path = inner.rlike(r"(^|\s)\w+(/\w+)+\.$")
        items_end = text.rlike(r"(?m)^\s*([-*+•]|\d+[.)])\s.*[.!?؟]\s*$")
        unfinished = F.when(last.rlike(ITEM), items_end & ~inner.rlike(r"^`[^`]*`$")).otherwise(F.size(words(inner)) >= 3)
        return F.when((hanging & ~label) | cut_path, True).when(ended | label, False).otherwise(unfinished)

    return bind(F.regexp_replace(response, r"[\s\p{Cf}\x{a0}]+$", ""), whole)


def defects(cache: DataFrame, documents: DataFrame) -> DataFrame:
    """(cache_key, defect) of the defective pairs; a pair has the first that holds of empty, copied, refusal, wrong_language
    and truncated.

    cache: (key, prompt, response); documents: (doc_id, text, lang), for the profiles of languages. A null prompt asks nothing, so its
    response can only be empty, refusing or truncated; repeated keys give one row per defect.
    """
    rows = cache.select(F.col("key").alias("cache_key"), "prompt", "response").where(F.col("cache_key").isNotNull())
    wants = lambda pattern: F.coalesce(F.col("prompt").rlike(pattern), F.lit(False))
    given = wants(WANTS_TRANSLATION) | wants(WANTS_REPETITION)
    rows = rows.select("*", is_empty(F.col("response")).alias("empty"), given.alias("given_text"), wants(WANTS_BARE).alias("bare"))
    profiles = rows.sparkSession.sparkContext.broadcast(fit_profiles(documents))
    names = "cache_key string, prompt string, response string, empty boolean, given_text boolean, bare boolean, copied boolean, refused boolean, other_language boolean"
    rows = rows.mapInPandas(_align(profiles), names)
    # text that was asked for is cut only if what the prompt gave was not
    cut = is_truncated(F.col("response")) & F.when(F.col("given_text"), ~F.coalesce(is_truncated(F.col("prompt")), F.lit(False))).otherwise(True)
    defect = (
        F.when(F.col("empty"), "empty")
        .when(F.col("copied"), "copied")
        .when(F.col("refused"), "refusal")
        .when(F.col("other_language"), "wrong_language")
        .when(~F.col("bare") & cut, "truncated")
    )
    return rows.select("cache_key", defect.alias("defect")).where(F.col("defect").isNotNull()).distinct()
