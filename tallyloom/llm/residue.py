"""Template residue and error-page text: placeholders never filled in, filler, error pages, notices that scripts are needed.

Messages (the sentences of a document's body, without code, quotes and markup) run through a prefix tree of fixed depth:
number of tokens, then the first tokens with numbers masked. All messages of a leaf make one template, whose tokens are kept
where all agree. Each distinct message is judged once; a leaf whose messages are all judged alike gives its verdict back to the
documents as a whole, the messages of any other leaf have their own. A document is
residue if at least one of its messages is, and none is content; headings say nothing against it. One message of content
decides, so the longest line of every document is judged first, and all lines only where that leaves it open.
Placeholders are found on their own, in any document: a slot is sure by its delimiters, or by ambiguous delimiters around a name
that sure slots of the corpus have, or that the list of usual names has.
"""

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.plans.lineage import stored

DEPTH = 4  # tokens of a message that lead to its leaf, after their number
BROADCAST_ROWS = 200_000  # verdicts or slot names that are sent to every executor; beyond that a shuffle join takes their place

LINE = r"\r\n|[\n\r\x0b\x0c\x85\x{2028}\x{2029}]"
FENCED = r"(?s)(```|~~~).*?(\1|$)"
INLINE_CODE = r"``[^`]+``|`[^`\n]*`"
QUOTED_STRAIGHT = r"\"[^\"\n]+\"|“[^”\n]+”|„[^“”\n]+[“”]"
QUOTED = r"\"[^\"\n]+\"|“[^”\n]+”|„[^“”\n]+[“”]|«[^»\n]+»|‹[^›\n]+›|(?<!\w)'[^'\n]{2,}'(?!\w)|(?<!\w)‘[^’\n]{2,}’(?!\w)"

# Delimiters that only templates have, each around a name.
NAME = r"[\p{L}_][\p{L}\p{M}\p{N}_ .\x{200c}-]*?"
SURE_SLOTS = (
    rf"\{{\{{\s*({NAME})\s*(?:\|[^}}\n]*)?\}}\}}", rf"\{{%\s*({NAME})\s*%\}}", rf"<%=?\s*({NAME})\s*%>", rf"#\{{({NAME})\}}", rf"\$\{{({NAME})\}}",
    rf"%\(({NAME})\)s", rf"\[\[({NAME})\]\]", rf"\(\(\(({NAME})\)\)\)", rf"@@({NAME})@@", rf"\[(?:TODO|TBD|FIXME):? ({NAME})\]", rf"<INSERT ({NAME})>",
    rf"&lt;({NAME})&gt;", rf"\[INSERT ({NAME})\]",
)
SURE_BEGINS = ("{{", "{%", "<%", "#{", "${", "%(", "[[", "(((", "@@", "[", "<INSERT ", "&lt;", "[INSERT ")  # of the delimiters above, in their order
OPEN_BEGINS = ("<", "{", "[", "__", "$", "%", "«")  # of the delimiters below
# Delimiters that ordinary text has too.
OPEN_SLOTS = (rf"<({NAME})>", rf"\{{({NAME})\}}", rf"\[({NAME})\](?![(\[:])", rf"\b__({NAME})__\b", rf"\$({NAME})\$", rf"%({NAME})%", rf"«({NAME})»")
# Names that placeholders usually have.
USUAL = (
    "your name", "your company", "your email", "your title", "your text here", "first name", "last name", "full name", "company name", "project name", "insert name", "insert date", "insert text", "insert title", "name here", "date here", "text here", "title here",
    "ihr name", "ihre firma", "vorname", "nachname", "firmenname", "projektname", "votre nom", "nom du projet", "prénom", "su nombre", "tu nombre", "nombre del proyecto", "apellido", "نام شما", "نام پروژه", "نام خانوادگی",
)

# Words of filler text after the classic one.
LOREM = (
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam "
    "quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla "
    "pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"
).split()
# Cues of filler, in the languages of the corpus.
FILLER = (
    r"\b(placeholder|dummy|sample|example|demo|filler) (text|copy|content|paragraph|headline|title|description|sentence)s?\b", r"\b(goes?|comes?) (in )?here\b", r"^\(?to be (written|added|filled|replaced|done)",
    r"\breplace (me|this)\b", r"\b(will be )?replaced later\b", r"\bwrite (a few|some) sentences\b", r"^(add|insert|enter|type) (a |an |the |your |some )?(description|text|title|content|summary|headline)", r"^your \w+ (here|to be (written|added|filled))\b",
    r"^(sub)?headline$", r"^body copy\b", r"\b(bla ?){2,}", r"\bfoo bar\b", r"\bplatzhalter\b", r"\b(beispiel|muster|blind|füll)text\b", r"^hier (steht|kommt|folgt) (später|noch|bald)", r"^(wird )?(noch|später) (ersetzt|ergänzt|gefüllt)",
    r"\btexte? d'(exemple|attente)\b", r"\btexte (factice|provisoire)\b", r"^ici (viendra|se trouvera|ira)\b", r"^à (remplacer|compléter|rédiger)", r"\btexto de (ejemplo|relleno|muestra|prueba)\b", r"^aquí (irá|va|vendrá)\b",
    r"^(por|para) (reemplazar|sustituir|completar|rellenar)\b", r"^(reemplazar|sustituir|completar)\b.{0,30}$", r"متن (نمونه|آزمایشی|ساختگی)", r"بعدا?ً? (پر|نوشته|جایگزین|تکمیل) (می|خواهد)", r"(این‌جا|اینجا) .{0,30}(می‌آید|خواهد آمد|قرار می‌گیرد|نوشته می‌شود)", r"^جای (متن|عنوان|توضیح)",
)
# Cues of error messages and pages.
ERRORS = (
    r"^(error |http |fehler |erreur |خطای |status )?(code )?[45]\d\d\b", r"\b(page|file|seite|site) (was )?(not found|nicht gefunden)\b", r"\bnot found\b", r"^(forbidden|unauthorized|bad (request|gateway)|gateway time-?out|gone)\b", r"\baccess(denied| denied| is denied| forbidden)\b",
    r"\bauthori[sz]ation required\b", r"\b(internal server|unexpected|fatal|server|unknown|application) error\b", r"\bservice (temporarily )?(is )?unavailable\b", r"\btoo many requests\b", r"\bsession (has )?expired\b", r"\b(sign|log) in again\b",
    r"\bsomething went wrong\b", r"\bcannot be (reached|displayed|found)\b", r"\btemporarily (down|unavailable|out of service)\b", r"\b(down|closed) for maintenance\b|\bunder maintenance\b", r"\btimed out\b", r"\bconnection (was |has been )?(reset|refused|closed|lost|aborted)\b",
    r"\b(please )?try again (in|later|soon|shortly)\b", r"^come back later", r"\bno route matches\b", r"\bthe page you (asked|requested|were looking)", r"\bupstream\b.{0,40}\b(answer|error|unavailable|response|invalid)\b", r"^panic\b", r"^traceback\b", r"^file ‹› ?, line", r"\b\w*(error|exception)$",
    r"^\w+(error|exception):?\s", r"\berr_\w*#?\w*\b", r"\bretry.after\b", r"\"(error|status|code|detail)\"\s*:", r"^</?error", r"^curl\b", r"^no such \w+$", r"\bchecking your browser\b", r"^(this takes|it takes) a few seconds", r"^just a moment", r"^loading\W*$", r"^we are (looking into|working on) it", r"^oops\b", r"\bdoes not exist\b.{0,20}$",
    r"\bcannot connect to\b", r"\b(server|site|page) (could|can|did) ?not (complete|process|handle|respond|load|be)\b", r"\byou (do not|don't) have (permission|access)\b", r"\bwe could not (load|find|open)\b", r"\brender failed\b", r"^gateway closed the stream",
    r"\b(seite|adresse|datei) (wurde )?nicht gefunden\b", r"\bzugriff (wurde )?verweigert\b", r"\binterner (server)?fehler\b", r"\bserverfehler\b", r"\b(dienst|server|seite|service) (ist )?(derzeit |zurzeit |vorübergehend )?nicht (verfügbar|erreichbar)\b", r"\bsitzung (ist )?abgelaufen\b", r"\bserver antwortet nicht\b",
    r"\bzu viele anfragen\b", r"\bversuchen sie es\b", r"\b(adresse|seite)( \w+)? (gibt es|existiert) nicht", r"\bzeitüberschreitung\b", r"\bwartungsarbeiten\b", r"\bbitte (melden|loggen) sie sich\b", r"\betwas ist schief",
    r"\bpage (introuvable|non trouvée)\b", r"\b(accès|demande) (refusée?|interdite?)\b", r"\berreur (interne|du serveur|inattendue)\b", r"\bservice (temporairement )?indisponible\b", r"\bsession (a )?expirée?\b", r"\bserveur ne répond pas\b", r"\btrop de (requêtes|demandes)\b", r"\bréessayez\b|\bveuillez réessayer\b",
    r"\b(adresse|page) n'existe (plus|pas)\b", r"\bdélai (d'attente )?dépassé\b", r"\bmaintenance en cours\b", r"\breconnectez-vous\b",
    r"\bpágina no (encontrada|existe|disponible)\b", r"\bacceso (denegado|prohibido)\b", r"\berror (interno|del servidor|inesperado)\b", r"\bservicio (temporalmente )?no disponible\b", r"\b(la )?sesión (ha )?(expirado|caducado|caducada|expirada)\b", r"\bservidor no responde\b", r"\bdemasiadas (solicitudes|peticiones)\b",
    r"\b(inténtelo|intente|inténtalo|vuelva a intentar)", r"\b(dirección|página) (ya )?no existe\b", r"\btiempo de espera\b", r"\bmantenimiento\b.{0,30}$",
    r"(صفحه|نشانی|پرونده).{0,25}(پیدا|یافت) نشد", r"(دسترسی|اجازه).{0,15}(رد شد|ندارید|مجاز نیست|ممنوع)", r"خطای (داخلی|سرور|ناشناخته|کارساز)", r"(سرور|کارساز).{0,15}(پاسخ نمی|در دسترس نیست)", r"(نشست|جلسه).{0,20}(منقضی|پایان یافت|به پایان رسید)", r"دوباره (تلاش|امتحان|وارد)|(دقیقه|لحظه|ثانیه) دیگر (تلاش|امتحان)", r"(سرویس|خدمت).{0,20}در دسترس نیست", r"درخواست‌?های? (بیش|زیاد)", r"این (صفحه|نشانی) (دیگر )?وجود ندارد",
)
# Cues of a notice that scripts are needed.
SCRIPTS = (
    r"\bnoscript\b", r"\b(enable|allow|turn on|switch on|activate|without|requires?|needs?|support(s|ing)?|run) (java)?script(s|ing)?\b", r"\b(java)?script(s|ing)? (is|are|must be|has to be|to be)? ?(switched off|disabled|turned off|required|needed|enabled|blocked)\b", r"\bjavascript\b.{0,60}$",
    r"\brequires? (java)?scripts?\b", r"\bbrowser does not (run|support)\b", r"\bskripte?n?\b.{0,40}\b(ein|aktiv\w*|erlauben|zulassen|sehen|benötigt|erforderlich)\b", r"\b(aktivier|erlaub|schalte)\w*\b.{0,30}\bskript", r"\b(activ|autoris|permit|habilit)\w*\b.{0,30}\bscripts?\b", r"جاوااسکریپت|جاوا اسکریپت|اسکریپت‌?(ها)?",
)
MOST_WORDS = 30  # that one cue speaks for; a longer message must have one for each of as many words
PLAIN = r"[#*_>|~=\[\]()<>]+|^\s*(?:[-+•]|\d+[.)])\s+|&\w+;"


def body(text: Column) -> Column:
    """The text without fenced and inline code."""
    fenceless = F.when(text.contains("```") | text.contains("~~~"), F.regexp_replace(text, FENCED, "\n")).otherwise(text)
    return F.when(text.contains("`"), F.regexp_replace(fenceless, INLINE_CODE, " ` ")).otherwise(fenceless)


def _whole(pattern: str) -> bool:
    """Whether a pattern has no alternatives outside its groups."""
    return "|" not in re.sub(r"\\.|\[[^\]]*\]|\((?:[^()]|\((?:[^()]|\([^()]*\))*\))*\)", "", pattern)


def _cues(patterns: tuple[str, ...]) -> str:
    """One pattern for many; what many begin with, a word or the message, is looked for once."""
    groups: dict[str, list[str]] = {}
    for p in patterns:
        begin = next((x for x in (r"\b", "^") if p.startswith(x) and _whole(p)), "")
        groups.setdefault(begin, []).append(p[len(begin) :])
    return "(?U)" + "|".join(f"{begin}(?:{'|'.join(f'(?:{p})' for p in found)})" for begin, found in groups.items())


def _names(delimiters: tuple[str, ...]) -> Column:
    """The names between the delimiters in `bare`; case, underscores and blanks made one."""
    found = F.concat(*(F.regexp_extract_all(F.col("bare"), F.lit(p), F.lit(1)) for p in delimiters))
    return F.array_distinct(F.transform(found, lambda name: F.trim(F.regexp_replace(F.lower(name), r"[_\s-]+", " "))))


def slots(documents: DataFrame) -> DataFrame:
    """(doc_id, sure, open): the names between either kind of delimiters, outside code and double quotes, of the documents with any.

    A pattern is looked for only in texts that have what it begins with.
    """
    begins = zip(SURE_BEGINS + OPEN_BEGINS, SURE_SLOTS + OPEN_SLOTS)
    some = documents.where(reduce(or_, (F.col("text").contains(begin) & F.col("text").rlike(p) for begin, p in begins)))
    bare = some.select("doc_id", F.regexp_replace(body(F.col("text")), QUOTED_STRAIGHT, " ").alias("bare"))
    return bare.select("doc_id", _names(SURE_SLOTS).alias("sure"), _names(OPEN_SLOTS).alias("open"))  # no filter on these: it would be pushed below and find them twice


def with_slots(documents: DataFrame) -> DataFrame:
    """(doc_id) of documents with unfilled placeholders outside code.

    A name in ambiguous delimiters counts if it is a usual one, or the corpus has it in at least two documents in sure ones.
    """
    found = stored(slots(documents))
    names = stored(found.select("doc_id", F.explode("sure").alias("name")).distinct().groupBy("name").agg(F.count("*").alias("n")).where(F.col("n") > 1).select("name"))
    few = names.count() <= BROADCAST_ROWS
    unsure = found.where(F.size("sure") == 0).select("doc_id", F.explode("open").alias("name"))
    known = unsure.join(F.broadcast(names) if few else names, "name", "left_semi").unionByName(unsure.where(F.col("name").isin(*USUAL)))
    return found.where(F.size("sure") > 0).select("doc_id").unionByName(known.select("doc_id")).distinct()


def longest_lines(documents: DataFrame) -> DataFrame:
    """(doc_id, line): the longest line of each body; the first in order of characters of equally long ones."""
    lines = F.transform(F.split(body(F.col("text")), LINE), lambda x: F.struct(F.length(x).alias("n"), x.alias("line")))
    return documents.select("doc_id", F.array_max(lines)["line"].alias("line"))


def lines(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", F.explode(F.split(body(F.col("text")), LINE)).alias("line"))


def messages(lines: DataFrame) -> DataFrame:
    """(doc_id, message, heading): the sentences of lines without code, quotes and markup, numbers masked as #, in lower case.

    A line of JSON or XML is one message. Messages without a letter or digit are left out; they say nothing either way.
    """
    data = F.col("line").rlike(r"^\s*[{<]")
    quoted = F.when(F.col("line").rlike("[\"“„«‹'‘]"), F.regexp_replace("line", QUOTED, " ‹› ")).otherwise(F.col("line"))
    prose = F.regexp_replace(quoted, PLAIN, " ")
    sentences = F.when(data, F.array("line")).otherwise(F.split(prose, r"(?<=[.!?؟:;…])\s+|\s+[-–—|]\s+"))
    split = lines.select("doc_id", F.col("line").rlike(r"^ {0,3}#{1,6} ").alias("heading"), F.explode(sentences).alias("m"))
    # numbers and hashes are masked, but for the three digits of a failed request
    masked = F.regexp_replace("m", r"(?i)\b(?=[0-9a-f]*\d)[0-9a-f]{6,40}\b|(?!\b[45]\d\d\b(?![.,:/-]?\d))\b\d+(?:[.,:/-]\d+)*", "#")
    masked = F.when(F.col("m").rlike("[0-9]"), masked).otherwise(F.col("m"))
    spaced = F.when(F.col("m").rlike(r"  |[\t\x0b\f\x{a0}]"), F.regexp_replace(masked, r"[\s\x{a0}]+", " ")).otherwise(masked)
    said = F.trim(F.lower(spaced))
    speaking = split.where(F.col("m").rlike(r"[\p{L}0-9`‹]"))
    return speaking.select("doc_id", F.regexp_replace(said, r"[.!,;:…]+$", "").alias("message"), "heading")


def leaf(message: Column) -> Column:
    """Where the prefix tree keeps a message: its number of tokens and the first DEPTH of them."""
    tokens = F.split(message, " ")
    return F.concat_ws(" ", F.size(tokens).cast("string"), F.slice(tokens, 1, DEPTH))


def judgements(said: DataFrame) -> DataFrame:
    """(leaf, message, kind, n_messages): every distinct message with its verdict and how often it is said."""
    distinct = said.groupBy("leaf", "message").agg(F.count("*").alias("n_messages"))
    return distinct.withColumn("kind", verdict(F.col("message")))


def leaf_verdicts(judged: DataFrame) -> DataFrame:
    """(leaf, kind): the verdict that all distinct messages of a leaf share, "divided" where any two of them are judged differently."""
    of = F.coalesce("kind", F.lit("content"))
    ends = judged.groupBy("leaf").agg(F.min(of).alias("least"), F.max(of).alias("most"))
    return ends.select("leaf", F.when(F.col("least") != F.col("most"), "divided").otherwise(F.col("least")).alias("kind"))


def templates(judged: DataFrame) -> DataFrame:
    """(leaf, template, kind, n_messages): the tokens that all messages of a leaf have at a place, <*> at the others, and the verdict.

    Places are compared by their least and greatest tokens, which are combined before the shuffle.
    """
    token = judged.select("leaf", F.posexplode(F.split("message", " ")).alias("at", "token"))
    ends = token.groupBy("leaf", "at").agg(F.min("token").alias("a"), F.max("token").alias("b"))
    shown = F.struct("at", F.when(F.col("a") == F.col("b"), F.col("a")).otherwise("<*>").alias("token"))
    named = ends.groupBy("leaf").agg(F.array_join(F.transform(F.array_sort(F.collect_list(shown)), lambda x: x["token"]), " ").alias("template"))
    counted = judged.groupBy("leaf").agg(F.sum("n_messages").alias("n_messages"))
    return named.join(leaf_verdicts(judged), "leaf").join(counted, "leaf").select("leaf", "template", "kind", "n_messages")


def verdict(template: Column) -> Column:
    """Of a message or template: filler, error, script, furniture (navigation and marks around a page), or null for content."""
    tokens = F.split(template, " ")
    n = F.size(tokens)
    common = reduce(and_, (template.contains(c) for c in "etaoni"))  # of the many messages that have all of these no letters need be counted
    letters = F.array_distinct(F.split(F.regexp_replace(template, r"[^\p{L}]", ""), ""))
    lorem = F.size(F.filter(tokens, lambda t: t.isin(LOREM)))
    mashed = (n >= 3) & ~common & (F.size(letters) <= 5) & ~template.rlike(r"[#`‹*]") & (F.size(letters) > 1)
    same_letters = (n >= 2) & F.forall(tokens, lambda t: t.rlike(r"^(\p{L})\1{2,}$"))

    def said(patterns: tuple[str, ...]) -> Column:
        """Whether cues speak for all of a message in lower case."""
        cues = _cues(patterns)
        return template.rlike(cues) & F.when(n <= MOST_WORDS, True).otherwise(n <= MOST_WORDS * F.regexp_count(template, F.lit(cues)))

    return (
        F.when((n >= 3) & (lorem >= 0.7 * n), "filler")
        .when(mashed | same_letters, "filler")
        .when(said(SCRIPTS), "script")
        .when(said(FILLER), "filler")
        .when(said(ERRORS), "error")
        .when((n <= 4) & ~template.rlike(r"[.!?؟`‹]$"), "furniture")
    )


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def with_verdicts(said: DataFrame) -> DataFrame:
    """`said` (doc_id, message, heading) with `kind`, that of the leaf of a message if its messages agree, else its own; content is null."""
    said = stored(said.withColumn("leaf", leaf(F.col("message"))))
    each = stored(judgements(said))
    leaves = stored(leaf_verdicts(each).where(F.col("kind") != "content").withColumnRenamed("kind", "of_leaf"))
    own = stored(each.where(F.col("kind").isNotNull()).join(_small(leaves.where("of_leaf = 'divided'").select("leaf")), "leaf", "left_semi").select("message", "kind"))
    known = said.join(_small(leaves), "leaf", "left").join(_small(own), "message", "left")
    return known.withColumn("kind", F.when(F.col("of_leaf") == "divided", F.col("kind")).otherwise(F.col("of_leaf")))


def residue(documents: DataFrame) -> DataFrame:
    """(doc_id, kind): documents whose body is only filler, an error message or a script notice; kind names which (or mixed).

    Null, empty and blank texts and texts of nothing but furniture, code or signs are none.
    """
    content = F.col("kind").isNull() & ~F.col("heading")
    decided = with_verdicts(messages(longest_lines(documents))).where(content).select("doc_id").distinct()
    ids = documents.where(F.length(F.trim("text")) > 0).select("doc_id").distinct()
    open_ = stored(ids.join(decided, "doc_id", "left_anti"))
    known = with_verdicts(messages(lines(documents.join(_small(open_), "doc_id", "left_semi"))))
    of = lambda kind: F.max(F.col("kind") == kind)
    whole = known.groupBy("doc_id").agg(F.max(content).alias("content"), *(F.coalesce(of(k), F.lit(False)).alias(k) for k in ("filler", "error", "script")))
    kinds = F.array_compact(F.array(*(F.when(F.col(k), k) for k in ("filler", "error", "script"))))
    found = whole.where(~F.col("content")).select("doc_id", kinds.alias("kinds")).where(F.size("kinds") > 0)
    return found.select("doc_id", F.when(F.size("kinds") == 1, F.col("kinds")[0]).otherwise("mixed").alias("kind"))


def not_content(documents: DataFrame) -> DataFrame:
    """(doc_id, kind) of all residue: placeholder, or the kind from `residue`; repeated doc_ids are judged together."""
    rows = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
    marked = with_slots(rows).withColumn("kind", F.lit("placeholder"))
    return residue(rows).unionByName(marked).groupBy("doc_id").agg(F.min("kind").alias("kind"))
