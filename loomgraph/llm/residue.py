"""Template residue, filler and error pages among documents.

Placeholders are found by one small grammar per pair of delimiters, in the prose only: fenced blocks,
inline code, link targets and paths are discounted, delimiters that prose, wikis or make files use
themselves must hold a name that reads like a field, and sentences about such marks, or a tutorial that
has several of them, are discounted unless the marks are dense.  A page is filler or an error page when, apart
from titles, navigation and courtesies, all of its sentences are: text *about* such pages brings
sentences of its own, or quotes.
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- what isn't prose -----------------------------------------------------------------------------

_FENCE = re.compile(r"^[ \t]*(```+|~~~+)[^\n]*\n.*?(?:^[ \t]*\1[^\n]*$|\Z)", re.S | re.M)
_INLINE = re.compile(r"``.+?``|`[^`\n]+`")
_INDENTED = re.compile(r"^(?: {4}|\t)\S[^\n]*$", re.M)
_HEAD = re.compile(r"<head\b.*?</head>|<title\b.*?</title>|<(script|style)\b.*?</\1>", re.S | re.I)
_TAGS = re.compile(r"</?(?:html|body|h\d|p|hr|br|div|span|a|b|i|em|strong|ul|ol|li|center|pre|code|table|tr|td|th|main|section|header|footer|nav|img|meta|link|title|head)\b[^<>]*>", re.I)

# --- placeholders ---------------------------------------------------------------------------------

#: Words that name a field of a form or template (fixed values).
_FIELDS = frozenset(
    "owner name names title date dates count number version author authors team project company organization organisation address email mail contact summary description status link url label year month day"
    " time user username customer client product phone city country amount subject package repository release department recipient sender firstname lastname reviewer assignee deadline".split()
)
_ASK = r"(?:insert|enter|your|add|put|choose|select|fill(?: in)?|replace|todo|tbd|fixme|hier|ici|aquí)"
_NAME = r"[^\W\d][\w.-]*"
_CAMEL = re.compile(r"[a-z][A-Z]")
_DUNDER = re.compile(r"[a-z]+\Z")
_ANY = re.compile(
    r"\{\{\{?[-~#/]?\s*[.$]?" + _NAME + r"(?: [\w.]+)*(?:\s*\|\s*\w+)*\s*[-~]?\}?\}\}"  # {{ name }}
    r"|<%[=-]?\s*" + _NAME + r"(?: [\w.]+)*\s*-?%>"  # <%= name %>
    r"|@@[^\W\d][\w ]*@@|%%[^\W\d][\w ]*%%"  # @@name@@ %%name%%
    r"|(?<![\w$])[#%$]\{\s*" + _NAME + r"(?: [\w.]+)*\s*\}|\{\$" + _NAME + r"(?: [\w.]+)*\}"  # #{name} %{name} ${name} {$name}
    r"|[<\[{(]\s*(?:" + _ASK + r")\b(?!\s*[)\]}>])[^<>\[\]{}()\n]{0,60}[>\]}](?![(:])"  # <insert name here>
    r"|[<\[{][^<>\[\]{}\n]{1,60}?\b(?:goes here|here|to be (?:added|filled in|done))\s*[>\]}]",  # [name goes here]
    re.I,
)
_SOME = re.compile(
    r"(?<![\w/$#%{=])\{\s*(?P<brace>" + _NAME + r"(?: \w+)?)\s*\}(?![}/])"
    r"|\[\[\s*(?P<wiki>[^\W\d][\w ]*)\s*\]\]"
    r"|(?<![\w\]\[!])\[\s*(?P<square>[^\W\d][\w -]{0,40})\s*\](?![(\[:\]])"
    r"|(?<![\w<])<\s*(?P<angle>[^\W\d][\w -]{0,40})\s*>"
    r"|(?<!\w)__(?P<under>[^\W\d_][\w ]*?)__(?!\w)"
    r"|\$\((?P<make>[^\W\d][\w ]*)\)"
)
_MAKE = re.compile(r"make|shell|bash|env\b|build file", re.I)
#: A line that speaks of such marks uses them as examples.
_ABOUT = re.compile(r"\b(?:placeholders?|curly|braces|brackets|syntax|handlebars|jinja2?|mustache|liquid|erb|interpolat\w+|substitut\w+|(?:template|format) (?:strings?|engines?|languages?|variables?)|(?:expands?|renders?|evaluates?) to|platzhalter|geschweifte|accolades|llaves|자리 ?표시자|치환)\b", re.I)
#: A form's field that nobody filled: a short name, a colon and nothing but a mark for later.
_EMPTY_FIELD = re.compile(r"^[ \t]*(?:[-*+•|]+[ \t]*)?(?:\*\*|__)?[^\W\d_][^\n:.,;!?|]{0,30}?(?:\*\*|__)?[ \t]*:(?:\*\*|__)?[ \t]*(?:tbd|tba|tbc|to be (?:determined|defined|announced|filled in)|_{4,}|\.{5,}|\?{3,}|x{4,})[ \t]*\.?[ \t]*$", re.I | re.M)
_LATER = re.compile(r":(?:\*\*|__)?[ \t]*(?:tb[acd]\b|to be |_{4}|\.{5}|\?{3}|x{4})", re.I)


def _field(name: str) -> bool:
    words = re.split(r"[\s_.-]+", name.strip())
    return "_" in name.strip("_") or _CAMEL.search(name) is not None or any(w.lower() in _FIELDS for w in words)


def prose(text: str) -> str:
    """The text without code."""
    return _INLINE.sub(" ", _FENCE.sub("\n", text))


def _marks(text: str):
    """Where unfilled placeholders stand in the prose."""
    for m in _ANY.finditer(text):
        a = m.start()
        if m.group()[0] in "<[{(" and m.group()[1] not in "{%$" and a and text[a - 1] in "\"'":
            continue
        yield m
    for m in _SOME.finditer(text):
        kind, name = m.lastgroup, m.group(m.lastgroup)
        if kind == "under":
            if name.isupper() or _field(name):
                yield m
        elif kind == "make":
            if not (name.isupper() and "_" not in name) and not (name.isupper() and _MAKE.search(text[max(0, m.start() - 60) : m.end() + 60])):
                yield m
        elif kind == "angle":
            if _field(name) and not name.islower() or "_" in name or name.lower() in _FIELDS and name.lower() not in ("title", "link", "address", "summary", "label", "time"):
                yield m
        elif _field(name):
            yield m
    if _LATER.search(text):
        yield from _EMPTY_FIELD.finditer(text)


def placeholder(text: str) -> bool:
    """Does the prose hold an unfilled placeholder?

    A mark in a sentence that speaks of marks is an example, and in a text with several such sentences
    (a tutorial) so are all others, unless they are denser than one in twelve words.
    """
    marks, about = 0, 0
    for m in _marks(text):
        a, b = text.rfind("\n", 0, m.start()) + 1, text.find("\n", m.end())
        if _ABOUT.search(text, a, b if b >= 0 else len(text)):
            about += 1
        else:
            marks += 1
    return marks > 0 and (about < 2 or marks * 12 > len(text.split()))


# --- sentences ------------------------------------------------------------------------------------

_WHAT = r"(?:page|address|document|resource|article|file|site|website|content|server|request|view|viewer|search|tab|repository|template|graph|app|application|link|service|wiki|url|account|host|proxy|upstream)"
_FAILED = r"(?:(?:could|can|does|do|did|was|were|is|has)(?: not|n['’]t)(?: be)? (?:found|exist|available|displayed|rendered|shown|loaded|load|reached|opened|processed|respond)|cannot be \w+|can['’]t be \w+|no longer (?:exists?|available)|has (?:been )?(?:moved|removed|deleted|expired|ended)|(?:was|is|been) (?:removed|deleted|gone|private|blocked|down)|is gone|failed with|took too long|timed out|(?:is )?(?:limited|restricted) to|needs? you to (?:log|sign) in|requires? (?:you to )?(?:log|sign)|(?:is )?(?:currently )?(?:unavailable|not available)|(?:under|down for) maintenance)"
_SCRIPT = r"(?:java ?script|\bjs\b|\bscripts?\b|\bscripting\b|client-side code|cookies)"
_STRONG = re.compile(
    r"(?:\b" + _WHAT + r"\b|/[\w/]+|['‘]\w+['’]).{0,60}?\b" + _FAILED + r"|^" + _WHAT + r"\b.{0,20}\b(?:not found|unavailable|expired)"
    r"|^\W*(?:(?:http|error|code|fehler|erreur|status|오류)[\s:-]*)?[a-z]?\d{3}\b\W*(?:[-–:]?\s*(?:page |file )?(?:not found|bad gateway|forbidden|unauthorized|bad request|service unavailable|gateway time-?out|internal (?:server )?error|too many requests|error)\b)?\W*$"
    r"|\b(?:access (?:is )?denied|forbidden|permission to (?:view|see|access|open)|unauthori[sz]ed|bad gateway|service (?:is )?(?:temporarily )?unavailable|internal server error|gateway time-?out|too many requests|something went wrong|session (?:has |is )?(?:ended|expired|timed out)|timed out while|checking your browser|(?:not|are) a (?:ro)?bot|captcha|you are (?:a )?human|rate limit(?:ed)? exceeded|page not found|does(?: not|n['’]t) support this|unsupported browser)\b"
    r"|\b" + _SCRIPT + r".{0,40}\b(?:required|needed|enabled?|allowed|blocked|switched off|turned off|off|disabled|did(?: not|n['’]t) load|failed to load|missing)\b|\b(?:enable|turn on|activate|allow|needs?|requires?|unblock)\b.{0,20}" + _SCRIPT + ""
    r"|wurde(?:n)? nicht gefunden|nicht (?:verfügbar|erreichbar|gefunden)|zugriff verweigert|keine berechtigung|fehler \d{3}|javascript,? (?:um|aktivieren)|aktivieren sie|wartungsarbeiten"
    r"|n['’]existe (?:plus|pas)|introuvable|a été déplacée?|accès (?:refusé|interdit)|activez|erreur \d{3}|en maintenance|indisponible|page .{0,20}supprimée"
    r"|no (?:pudimos|se pudo|podemos) (?:cargar|encontrar|mostrar)|no se (?:ha )?encontr|no existe|acceso denegado|activar javascript|habilit\w+ javascript|en mantenimiento|no está disponible"
    r"|^\W*just a moment\b|\berror establishing\b|^\W*attention required\b|\bverify(?:ing)? (?:that )?you are\b|^\W*[45]\d\d\b\W+(?:\w+\W*){1,3}$|^\W*(?:\w+\W+){1,2}[45]\d\d\W*$"
    r"|pagina (?:non trovata|niet gevonden)|non (?:esiste|è (?:stata trovata|disponibile))|accesso negato|página não (?:encontrada|existe)|acesso negado|não foi (?:possível|encontrad)|niet (?:gevonden|beschikbaar)|nie (?:znaleziono|istnieje)|strona .{0,20}nie "
    r"|страница не найдена|не (?:найден|существует|удалось)|доступ (?:запрещ|закрыт)|недоступ|見つかりません|存在しません|アクセスが(?:拒否|制限)|メンテナンス中|ご利用いただけません|页面(?:不存在|未找到|已删除)|頁面不存在|找不到(?:页面|頁面|网页)|禁止访问|拒绝访问|维护中|无法(?:访问|显示|加载)"
    r"|(?:richiede|richiesto|abilita\w*|attiva\w*|requer|habilite|ative|vereist|schakel|wymaga|włącz)\b.{0,40}" + _SCRIPT + r"|" + _SCRIPT + r".{0,40}(?:richiest|necessari|vereist|wymagan|disabilitat|desativad)|(?:включите|требует\w*|необходим\w*).{0,40}java ?script|java ?script.{0,30}(?:включ|отключ|необходим|требует)|javascript.{0,12}(?:有効|無効|必要|启用|啟用|禁用)|(?:启用|啟用|開啟|开启).{0,8}javascript"
    r"|찾을 수 없습니다|존재하지 않습니다|자바스크립트를? ?(?:를 )?(?:켜|활성|사용)|접근이 (?:거부|제한)|오류 ?\(?\d{3}|권한이 없습니다|점검 중",
    re.I,
)
#: Sentences that go along with an error and say nothing of their own.
_ALONG = re.compile(
    r"^\W*(?:sorry|oops|whoops|uh[- ]oh|hmm|ups|désolée?s?|lo sentimos|entschuldigung|죄송합니다)\W*$"
    r"|\b(?:try|come back|check back)\b.{0,30}\b(?:again|later|minutes|moment)\b|\b(?:sign|log) in\b.{0,20}\bagain\b|^wait \d+|please (?:wait|reload|refresh|try)|\bthis (?:may )?takes? (?:up to|about|a few)\b"
    r"|^(?:if this happens again|if the problem|contact|write to|ask)\b.{0,60}|^(?:go |return )?back to|^(?:allow|enable) it\b|\bload the \S+ page again|\bextension in your browser\b|\bmay be the cause\b|^reference\b|^\W*(?:request|ray|incident|trace|error|id)(?: id| no)?\W+[0-9a-f]{3,}\W*$|reload"
    r"|inténtelo|versuchen sie|réessayez|다시 시도|später (?:erneut|noch)|more tarde|más tarde|plus tard|^\W*\d*\W*$|^\W*[\w-]+/\d[\d.]*\W*$",
    re.I,
)
_FILLER = re.compile(
    r"\b(?:text|content|description|words?) (?:goes|go|comes|will (?:be|go|come)|to (?:go|come)) here\b|^\W*(?:some|sample|dummy|example|placeholder|filler|random|more) (?:text|words|content|copy|paragraph)\b|lorem ipsum"
    r"|\b(?:page|section|document|article|chapter) is (?:still |currently )?(?:empty|blank|a stub|under construction)\b|\b(?:coming soon|under construction|to be (?:written|completed|added|done|filled)|not (?:yet )?written(?: yet)?)\b|^(?:please )?(?:write|add|insert|enter|put|replace|describe|fill|type|provide)\b.{0,60}\b(?:description|text|words?|sentences?|paragraphs?|content|here|place|summary|section)\b"
    r"|texte? (?:à venir|d['’]exemple|de remplissage)|hier steht (?:später|bald)|\bbeispieltext\b|\bplatzhalter\b|inhalt folgt|(?:folgt|kommt) (?:in kürze|später|noch)|texto (?:de ejemplo|de relleno|aquí|pendiente)|escrib[ae] aquí|contenido pendiente|내용을? ?(?:을 )?(?:입력|작성)하세요|내용 ?(?:준비|작성) ?(?:중|예정)|준비 중입니다",
    re.I,
)
_KEYS = frozenset("blah bla test tests testing asdf asdfg asdfasdf qwer qwert qwerty qwertz jkl jklö foo bar baz abc yxcv zxcv hjkl dfgh fghj xyz lorem ipsum dolor sit amet text".split())
_GLUED = re.compile(r"(?:blah|bla|test|asdf|qwer|zxcv|yxcv|foo|bar|baz|abc|xyz|x{2,}|lorem|ipsum)+")
_WORD = re.compile(r"[^\W\d_]+")
#: The commonest words of the languages at hand (fixed values): real prose has some in each sentence.
_COMMON = frozenset(
    "the a an of to in is and it for that with on as by not be are was this from or at we you i its so no than when which can't but has have if after before see all any into only over under out up do does then"
    " der die das und ist nicht ein eine im in den dem des mit wird von zu auf sich für als auch bei so hat über man wir es"
    " le la les des un une est et en de du à au il ne que qui dès pour dans sur par nous se si avec ou"
    " el los las una y que no por para se con del al lo su más como si pero después".split()
)
_SENTENCE = re.compile(r"(?<=[.!?。])\s+|\n+")
_NAVIGATION = re.compile(r"^\W*(?:skip to (?:main )?content|back to top|\(c\).*|©.*|copyright\b.*|.*\bviewer|menu|home|search|help|login|imprint|contact)\W*$", re.I)
_BULLET = re.compile(r"^\s*(?:[-*+•]|\d+[.)])\s+")


def nonsense(words: list[str]) -> bool:
    """Do these lower-case words repeat without making sentences of any language at hand?"""
    n = len(words)
    if n < 2:
        return False
    distinct = len(set(words))
    if all(w in _KEYS or len(set(w)) == 1 for w in words):
        return True
    if all(_GLUED.fullmatch(w) or len(set(w)) == 1 for w in words):
        return True
    common = sum(w in _COMMON for w in words)
    return n >= 12 and common <= 0.03 * n and distinct <= 0.75 * n and all(w.isascii() for w in words)


def _page(plain: str, titles: bool = True) -> tuple[int, int] | None:
    """Sentences that are filler and errors, or None where the text has content of its own."""
    filler = error = 0
    for raw in plain.split("\n"):
        line = raw.strip()
        if not line or line.startswith("#"):
            continue
        if not _BULLET.match(line) and line[0] != "|" and len(line.split()) <= 8 and (" > " in line or " | " in line):
            if _STRONG.match(line.split(" | ")[0]):
                error += 1
            continue
        if _NAVIGATION.match(line) and len(line.split()) <= 6:
            continue
        words = [w.lower() for w in _WORD.findall(line)]
        if words and nonsense(words):
            filler += 1
            continue
        for s in _SENTENCE.split(line):
            s = s.strip()
            if not s or not re.search(r"\w", s):
                continue
            if '"' in s or "`" in s or s[0] == "|" or _BULLET.match(s):
                return None
            if (m := _FILLER.search(s)) and len(_WORD.findall(_FILLER.sub(" ", s))) <= 12:
                filler += 1
            # what goes on for long after its message is prose about it
            elif (m := _STRONG.search(s)) and len(s) - len(m.group()) <= 150:
                error += 1
            elif _ALONG.search(s):
                pass
            elif titles and len(s.split()) <= 3 and s[-1] not in ".!?。" and s == line:
                pass  # a title
            else:
                return None
    return filler, error


def page_of(text: str) -> str | None:
    """'filler' or 'error' if that is all a page has, else None.  A code block is content, unless what
    stands in it is an error message too."""
    plain = _TAGS.sub("\n", _HEAD.sub(" ", text)).replace("\r", "").replace("﻿", "")
    strong = [0, 0]
    if "```" in plain or "~~~" in plain:
        for m in _FENCE.finditer(plain):
            inner = _page("\n".join(m.group().split("\n")[1:]).replace(m.group(1), ""), False)
            if inner is None or not any(inner):
                return None
            strong = [a + b for a, b in zip(strong, inner, strict=True)]
        plain = _FENCE.sub("\n", plain)
    got = _page(plain)
    if got is None:
        return None
    filler, error = (a + b for a, b in zip(strong, got, strict=True))
    return "error" if error else "filler" if filler else None


_INVISIBLE = re.compile("[\u00ad\u200b-\u200f\u2060\ufeff]|<\\|[a-z_]+\\|>|</?s>")
#: Letters of other scripts that look like Latin ones (fixed values).
_ALIKE = str.maketrans("аеорсухіАЕОРСХВНКМТ", "aeopcyxiAEOPCXBHKMT")
_ACCENTS = re.compile("[\u0300-\u036f]+")
_LATIN = re.compile("[A-Za-z]")
_LIKE = re.compile("[аеорсухіАЕОРСХВНКМТ]")
_OTHER_SCRIPT = re.compile("[бвгджзийклмнптфцчшщъыьэюяБГДЖЗИЙЛПУФЦЧШЩЪЫЬЭЮЯ]")
_MIXED = re.compile(r"\w*(?:[A-Za-z][\u0400-\u04ff]|[\u0400-\u04ff][A-Za-z])\w*")
_WRONG = re.compile("[\u00c2-\u00f4][\u0080-\u00bf\u0152-\u2122]")


def readable(text: str) -> str:
    """The text without invisible characters and token marks, look-alike letters made Latin where the
    text is, and decoded again where UTF-8 was taken for a one-byte code."""
    text = _INVISIBLE.sub("", text)
    if len(_WRONG.findall(text)) >= 2:
        for code in ("latin-1", "cp1252"):
            try:
                text = text.encode(code).decode("utf-8")
                break
            except UnicodeError:
                pass
    if _LIKE.search(text) and _LATIN.search(text):
        # where other letters of the script stand too, only words that mix both are meant
        text = _MIXED.sub(lambda m: m.group().translate(_ALIKE), text) if _OTHER_SCRIPT.search(text) else text.translate(_ALIKE)
    return text


def _unaccented(text: str) -> str:
    return _ACCENTS.sub("", unicodedata.normalize("NFKD", text))


def residue(text: str | None) -> str | None:
    """'placeholder', 'filler', 'error' or None.  Null, empty and blank texts have none."""
    if not text or not text.strip():
        return None
    text = readable(text)
    if placeholder(prose(text)):
        return "placeholder"
    got = page_of(text)
    if got is None and not text.isascii():
        got = page_of(_unaccented(text))
    return got


def found(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and reason of the documents to leave out, read where they lie; a row for each row of
    ``docs`` that is one."""

    def run(batches):
        for b in batches:
            ids, why = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if w := residue(t):
                    ids.append(i)
                    why.append(w)
            yield pa.RecordBatch.from_arrays([pa.array(ids, b.schema.field(0).type), pa.array(why, pa.string())], names=["k", "reason"])

    kind = dict(docs.dtypes)[key]
    return docs.select(F.col(key).alias("k"), F.col(text).alias("t")).mapInArrow(run, f"k {kind}, reason string").select(F.col("k").alias(key), "reason")
