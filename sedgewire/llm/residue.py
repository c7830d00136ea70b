"""Template residue, filler and error-page text in documents.

Message templates are mined with a fixed-depth prefix tree over the sentences
of all documents, each template is classified and its verdict goes to every
sentence of it. A word that some verdict depends on is never a variable of a
template, so none is lost among other sentences of its leaf. Slots left open and
sections left blank are looked for in each record by itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from re import _parser as regex_parser

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewire.runtime import CACHE_KEYS, store

#: Leading words of a sentence that choose its leaf, and the share of a leaf's sentences a word must hold at its place to belong to the template.
TREE_DEPTH, CONSTANT_SHARE = 3, 0.3
#: A made-up word stands in at least so many sentences, and no more than this share of them has a function word.
FILLER_LEAST, FILLER_BOUND = 4, 0.1

# Names that templates give to their slots.
SLOT_NAMES = """
address amount author body branch city company content country customer date day description email
field first_name id key label last_name link message month name number owner path phone placeholder
price product project repo repo_url repository state status subject summary tag team text ticket
ticket_id title todo type url user username value version year
""".split()

# Words that only bind others, by language (en, de, fr, es, it, pt, nl).
FUNCTION_WORDS = frozenset(
    """
a an and any are as at be been but by can cannot could did do does down each every few first for from had has have how if in into
is it its last left may more most must new no not of off on once one only or other our out over own shall should so some such than
that the their them then there these they this those to too two under until up was we were what when where which while who why will
with without would you your don doesn isn nobody new all after again before because both few here just me my now old same she he very
aber als am auf aus bei bis bitte da das dass dem den der des die doch du durch ein eine einem einen einer er es für hat ich ihr im
ist kann keine man mit muss nach nicht noch nur oder ohne sehr sich sie sind so über um und uns vom von vor war was weil wenn wie wir
wird zu zum zur nicht blieb
au aux avec ce ces cette dans de des du elle en est et il ils la le les leur lui mais même ne nous on ou où par pas plus pour que
qui sa sans se ses son sont sur un une vous avant depuis chaque très faut
al algo como con contra cuando del desde donde el ella ellos entre era esta este fue ha hasta hay la las lo los más me mi muy nada ni
no nos nuestra o para pero por porque que quien se ser si sin sobre su sus también tiene todo un una y ya
che chi ci come con dal dalla degli dei del della delle di e gli i il lo ma nel nella non per più questo si sono su sul tra una uno
ao aos às com da das dos ele em essa esse eu foi isso mais mas na nas nem não o os ou pela pelo são seu sua também um uma
aan bij dan dat de deze die dit door een en er het hij ik ja je maar met naar niet nog of om ook op te tot uit van voor wat werd
""".split()
)

# The words of the customary filler text.
FILLER_WORDS = frozenset(
    """
lorem ipsum dolor sit amet consectetur consectetuer adipiscing adipisicing elit sed eiusmod tempor incididunt ut labore et dolore magna
aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in
reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui
officia deserunt mollit anim id est laborum vestibulum pellentesque curabitur vivamus praesent
""".split()
)

# Wordings of filler, error pages and notices about scripts, tried on a whole sentence.
FILLER_WORDING = (
    r"lorem ipsum|\b(?:dummy|sample|filler) (?:words|text|copy)\b.{0,60}$|^placeholder (?:paragraph|text)\b.{0,10}$|^replace (?:it|this)(?: text)? with (?:real|your)|"
    r"^write something (?:about|here)|(?:more|your) text (?:goes )?here|^(?:bla[ ,.]*){3}|^(?:blindtext|mustertext|texte d'exemple|texto de (?:ejemplo|relleno)|texto de exemplo)|"
    r"^hier steht (?:später|bald|demnächst) ein text|^(?:votre|mon) texte ici|^aquí (?:va|irá) (?:el|un|su) texto|^(?:qui|inserire qui) il testo|^здесь (?:будет|может быть) текст"
)
REASONS = (
    r"bad request|unauthori[sz]ed|sign[- ]in (?:needed|required)|log ?in required|forbidden|(?:access|permission) (?:is |was )?denied|not found|page missing|"
    r"(?:page|file|url|site) (?:was |is |could )?not (?:be )?(?:found|available)|method not allowed|request time-?out|gone|too many requests|internal server error|not implemented|bad gateway|"
    r"(?:service|temporarily|page) (?:is )?(?:temporarily )?unavailable|gateway time-?out|down for maintenance(?:,? come back soon)?|under maintenance|you may not view this page|nothing lives at this address|"
    r"page introuvable|accès (?:refusé|interdit)|service indisponible|seite nicht gefunden|zugriff verweigert|dienst nicht verfügbar|página no encontrada|acceso denegado|prohibido|"
    r"страница не найдена|доступ запрещ[её]н|页面(?:不存在|未找到)|找不到页面|禁止访问|ページが見つかりません|アクセスが拒否されました|페이지를 찾을 수 없습니다"
)
ERROR_WORDING = (
    rf"^(?:oops[!. ]*|sorry[!,. ]*|uh[- ]oh[!. ]*)?(?:(?:http )?(?:status|error|fehler|erreur|errore|erro|ошибка|错误|エラー)(?: code)?[ :#]*)?(?:[45]\d\d)?[ :,–—-]*(?:{REASONS})[.!]*$|"
    r"^(?:http )?(?:error|fehler|erreur|errore|erro|ошибка|错误|エラー)[ :#]*[45]\d\d[.!]*$|"
    r"^(?:sorry, )?(?:the|this) (?:page|file|document|address|url|resource|link) (?:you (?:asked for|requested|are looking for|followed|were looking for)|requested)\b.{0,40}\b(?:moved|exist(?:ed|s)?|not found|not be found|unavailable|removed)|"
    r"^the requested (?:url|page|resource)\b.{0,60}\b(?:not found|could not|unavailable)|^you (?:do not|don't|are not) (?:have permission|allowed|authori[sz]ed|have access) to (?:open|view|access|see|use|read)\b|"
    r"^the server (?:could not (?:complete|process|understand|handle) (?:your|the) request|encountered an? (?:internal |unexpected )?(?:error|condition)|is temporarily)|"
    r"^upstream (?:connect|request|server|timed)\b.{0,60}|^error establishing a\b.{0,40}connection|^(?:your|the) session has (?:ended|expired|timed out)|^please (?:sign|log) in(?: again)? to (?:continue|view|see)|"
    r"^rate limit (?:reached|exceeded) (?:for|on)\b|^too many (?:requests|attempts)\b.{0,30}(?:try|wait)|^this (?:repository|project|page|site|account) is (?:empty|private|suspended|unavailable)\b.{0,10}\b(?:or|and) you\b|"
    r"^(?:el enlace que (?:siguió|has seguido)|la página que (?:busca|buscas))\b|^die (?:angeforderte|gesuchte|aufgerufene) seite\b|^la page (?:demandée|que vous)\b|^(?:a página que|a pagina solicitada)\b|"
    r"^(?:запрошенная|запрашиваемая) страница|^(?:您|你)(?:访问|请求)的页面|^お探しのページ"
)
SCRIPT_WORDING = (
    r"^(?:<noscript>)?(?:please |you (?:need|have) to |you must |to continue,? )*(?:enable|allow|activate|turn on|switch on) (?:\w+ ){0,2}(?:java ?script|scripts|cookies)\b|^(?:<noscript>)?(?:sorry[,. ]*)?java ?script (?:is|must be|has been|needs to be) (?:turned off|disabled|required|not (?:enabled|available)|enabled|off)\b|"
    r"^(?:<noscript>)?(?:this|our|the) (?:site|page|app|application|website|web ?page) (?:needs|requires|does not work without|works best with|uses) (?:java ?script|scripts|cookies)|^turn (?:them|it|scripts) on in your browser|"
    r"^(?:<noscript>)?(?:your|this) browser (?:is not supported|is outdated|is out of date|does not support|doesn't support|blocks|has (?:java ?script|cookies|scripts))|^(?:<noscript>)?checking (?:your|the) browser\b|^scripts and cookies must|"
    r"^if nothing happens, check that scripts|^loading…? if nothing happens|^(?:<noscript>)?(?:bitte )?(?:aktivieren|schalten) sie (?:bitte )?(?:java ?script|cookies)|^(?:<noscript>)?(?:veuillez )?activez? (?:java ?script|les cookies)|"
    r"^(?:<noscript>)?(?:por favor,? )?(?:active|habilite|activa|habilita) (?:java ?script|las cookies)|^(?:пожалуйста, )?включите (?:java ?script|cookies)|请(?:启用|开启) ?javascript|javascript ?を有効に|javascript를 (?:활성화|사용)"
)
# The same by their parts, whatever stands between: who speaks of what, and what is wrong with it.
THING = r"(?:page|file|document|address|url|resource|link|site|website|web ?page|content|article|item)"
GONE = (
    r"(?:(?:is|was|were|has been|have been) (?:not found|removed|moved|deleted|unavailable|unpublished|blocked)|(?:can(?:'|’)?t|cannot|could(?: not|n(?:'|’)?t)|can not) be (?:found|reached|opened|displayed|loaded|located)|"
    r"(?:isn(?:'|’)?t|is (?:no longer|not|currently not|temporarily not)) (?:available|accessible|reachable)|(?:no longer exists?|does(?: not|n(?:'|’)?t) exist|may have been (?:moved|removed|deleted)|is (?:currently |temporarily )?(?:unavailable|offline|down)))"
)
ERROR_PARTS = (
    rf"^(?:oops|sorry|uh[- ]oh|whoops)?[!,. ]*(?:the|this|that|your|our) (?:requested )?{THING}(?: (?:that )?(?:you|at this)\b.{{0,50}}?)? {GONE}\b.{{0,40}}$|^(?:oops|sorry)?[!,. ]*we (?:could(?: not|n(?:'|’)?t)|can(?:not|(?:'|’)?t)) (?:find|load|display|open) (?:the|that|this) {THING}\b.{{0,40}}$|"
    r"^access to (?:this|the) (?:requested )?\w+(?: on (?:the|this) server)? (?:is|was|has been) (?:denied|forbidden|restricted|blocked)|^(?:oops|sorry)?[!,. ]*something (?:has gone|went) wrong\b.{0,50}$|^(?:sorry, )?an? (?:unexpected|unknown|internal|server) error (?:has |was )?(?:occurred|encountered)\b.{0,60}$|"
    r"^(?:this|our|the) (?:website|site|page|service|application) is (?:currently |temporarily )?(?:under (?:maintenance|construction)|undergoing maintenance|down for maintenance)\b.{0,40}$|^(?:site )?under (?:construction|maintenance)[.!]*$|"
    r"^you (?:must|need to|have to) (?:be (?:logged|signed) in|log in|sign in)(?: first)? (?:to|before) (?:view|see|access|continue|read|use|viewing)|^this (?:content|page|area|section) is (?:only )?(?:available|visible|accessible|restricted) (?:only )?to (?:registered|logged|signed|authori[sz]ed|members|subscribers)|"
    r"^(?:(?:unauthori[sz]ed|forbidden) (?:access|request)|(?:your )?request (?:was |has been )?(?:blocked|rejected))[.!]*$|^(?:[45]\d\d)? ?[-–—:]? ?(?:page|file|url) or (?:directory|page) not found[.!]*$|^(?:connection|request|operation) timed out[.!]*$|"
    r"^(?:diese|die) seite (?:wurde nicht gefunden|existiert nicht|ist nicht (?:mehr )?(?:verfügbar|erreichbar))|^cette page (?:n(?:'|’)existe (?:pas|plus)|est introuvable)|^(?:no se (?:ha encontrado|encontró|pudo encontrar)|no existe) la página|^esta página no (?:existe|está disponible)|^(?:a|esta) página não (?:foi encontrada|existe)|^(?:la )?pagina non (?:trovata|esiste)|^(?:de )?pagina (?:is )?niet gevonden"
)
SCRIPT_PARTS = (
    r"^please (?:turn|switch) (?:java ?script|scripts|cookies) (?:back )?on\b|^just a moment[.… ]*$|^checking (?:if|whether) the (?:site|connection)\b|^(?:please )?(?:verify|confirm|prove) (?:that )?you(?: are|'re|’re) (?:a |not a )?(?:human|robot)|^veuillez activer (?:java ?script|les cookies)|"
    r"^(?:you(?:r browser)? (?:seems? to )?(?:have|has) )(?:java ?script|cookies) (?:disabled|turned off)|^(?:abilita|attiva) (?:java ?script|i cookie)|^(?:schakel|zet) (?:java ?script|cookies) (?:in|aan)|^(?:ative|habilite) o? ?(?:java ?script)"
)
FILLER_PARTS = r"^your (?:content|text|description|title|headline) (?:goes|here)\b|^this is (?:a |some |just )*(?:placeholder|dummy|sample|filler|example) (?:text|paragraph|content|copy)\b.{0,30}$|^(?:add|enter|type|put) (?:your|some) (?:text|content|description) here"
_WORDINGS = {"filler": f"{FILLER_WORDING}|{FILLER_PARTS}", "error_page": f"{ERROR_WORDING}|{ERROR_PARTS}", "script_notice": f"{SCRIPT_WORDING}|{SCRIPT_PARTS}"}
_VERDICTS = [(kind, re.compile(rx, re.I)) for kind, rx in _WORDINGS.items()]
_SAME_WORD = re.compile(r"^(\w+)(?:[ ,]+\1){2,}\b", re.I)

_NAMES = "|".join(sorted(SLOT_NAMES, key=len, reverse=True))
_SLOT = re.compile(
    rf"\{{\{{[^{{}}\n]{{0,80}}\}}\}}|\{{%[^%\n]{{1,80}}%\}}|<%[^%\n]{{1,80}}%>|\$\{{[\w.\- ]{{1,60}}\}}|#\{{[\w.\- ]{{1,60}}\}}|@@\w{{1,40}}@@|%\(\w{{1,40}}\)[sd]|"
    rf"\[\[ ?(?i:{_NAMES}) ?\]\]|(?<!\w)__(?i:{_NAMES})__(?!\w)|\$(?i:{_NAMES})\$|(?<!\w)%(?i:{_NAMES})%(?!\w)|(?<![/\w$#{{])\{{(?i:{_NAMES})\}}(?![}}/\w])|"
    r"\[(?i:your|insert|enter|fill in|replace|add|put)\b[^\]\n]{0,60}\](?!\()"
)
_ANGLE = re.compile(rf"(?<![\w/])<((?i:{_NAMES}))>")
_DISCUSSES = re.compile(r"(?i)\b(?:template|placeholder|variable|syntax|renderer|escaped?|literal(?:ly)?|macro|interpolat\w+|substitut\w+)\b")
_BLANK = re.compile(
    r"(?i)^[-*+>\s]*(?:todo|tbd|tba|fixme|n/?a yet|coming soon|\.{2,}|…|\?{2,}|x{3,}|none yet|to be (?:done|determined|written|added|defined)|\[(?:fill in|todo|tbd|describe|explain)[^\]]*\]|"
    r"_(?:describe|explain|fill in|add|write|your|insert)[^_\n]{0,60}_|<!--.*?-->|<(?:describe|explain|fill in|add|write|your|insert)[^>\n]{0,60}>|(?:describe|explain|fill in|write|add|insert) (?:\w+ ){0,3}here)[.!:\s]*$"
)
_BLANKS = re.compile(_BLANK.pattern, re.M).search
_SLOT_SIGNS = re.compile(r"[\[{$%]|<(?![CQ]>)|__|@@").search
_HEADING = re.compile(r"^ {0,3}#{1,6}\s+\S|^[^\n]{1,60}:\s*$|^\*\*[^*\n]{1,60}\*\*:?\s*$")
_FENCE = re.compile(r"(?ms)^[ \t]*(```+|~~~+)[^\n]*\n.*?(?:^[ \t]*\1[`~]*[ \t]*$|\Z)")
_CODE = re.compile(r"(`+)[^`\n]+?\1")
_QUOTE = re.compile(r"\"[^\"\n]{1,300}\"|“[^”\n]{1,300}”|«[^»\n]{1,300}»|„[^“”\n]{1,300}[“”]|「[^」\n]{1,300}」")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|(?<=[。！？])|\n")
_URL, _PATH, _NUMBER = re.compile(r"https?://\S+"), re.compile(r"/(?<!\w/)[\w.-]+(?:/[\w.-]+)*"), re.compile(r"\d+(?:[.,]\d+)*")
_ID = re.compile(r"\b[0-9a-f]{8,}\b")
_DIGIT = re.compile(r"\d").search
_STATUS = re.compile(r"[45]\d\d")
_LETTERS = re.compile(r"[^\W\d_]+").findall
_LATIN = re.compile(r"[^a-zA-Z\u00c0-\u024f\u0300-\u036f.,;:!?'’\s-]").search


def _number(m: re.Match) -> str:
    """<N>, but an HTTP status stays."""
    return m[0] if _STATUS.fullmatch(m[0]) and m.string[m.start() - 1 : m.start()] not in (".", ",") else "<N>"


def mask(text: str) -> str:
    """A text with what varies between uses (numbers but HTTP statuses, ids, paths, links) replaced."""
    if "://" in text:
        text = _URL.sub("<U>", text)
    if "/" in text:
        text = _PATH.sub("<P>", text)
    if not _DIGIT(text):
        return text
    return _NUMBER.sub(_number, _ID.sub(lambda m: "<H>" if _DIGIT(m[0]) else m[0], text))


def own_text(text: str) -> str:
    """A record without code blocks, code spans, quotations and quoted lines, which are not its own text."""
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    if "```" in text or "~~~" in text:
        text = _FENCE.sub("\n", text)
    if "`" in text:
        text = _CODE.sub(" <C> ", text)
    text = _QUOTE.sub(" <Q> ", text)
    return "\n".join([x for x in text.split("\n") if not x.lstrip().startswith("> ")]) if "> " in text else text


def parts(text: str) -> list[tuple[str, str]]:
    """(kind, sentence) of a record: open slots, blank sections, and the masked sentences of its own prose."""
    own = own_text(text)
    out: list[tuple[str, str]] = []
    if _BLANKS(own):
        blank, heading = False, False
        for line in [*own.split("\n"), "# end"]:
            bare = line.strip()
            if _HEADING.match(line):
                if heading and blank:
                    out.append(("section", ""))
                    blank = False
                heading, filled = True, False
            elif bare and heading and not filled:
                blank = bool(_BLANK.match(bare))
                filled = not blank
    if _SLOT_SIGNS(own):
        for m in (*_SLOT.finditer(own), *(x for x in _ANGLE.finditer(own) if f"</{x[1]}>" not in text)):
            end = own.find("\n", m.end())
            if not _DISCUSSES.search(own[own.rfind("\n", 0, m.start()) + 1 : end if end >= 0 else len(own)]):
                out.append(("slot", ""))
    for sentence in _SENTENCE.split(mask(own)):
        words = sentence.lstrip("#*-+ \t").split()
        if words:
            out.append(("sentence", " ".join(words)))
    return out


def classify(sentence: str) -> str | None:
    """filler, error_page, script_notice or None for the wording of one sentence or template."""
    if _SAME_WORD.match(sentence) or _mostly_filler(_LETTERS(sentence.lower()), sentence.count("<*>")):
        return "filler"
    return next((kind for kind, rx in _VERDICTS if rx.search(sentence)), None)


def _runs(pattern: str) -> set[str]:
    """All runs of letters that stand in a pattern, in lower case."""
    found: set[str] = set()

    def walk(x) -> None:
        if isinstance(x, regex_parser.SubPattern):
            letters = "".join(chr(v) if k is regex_parser.LITERAL and chr(v).isalpha() else " " for k, v in x)
            found.update(letters.lower().split())
            for _, value in x:
                walk(value)
        elif isinstance(x, (tuple, list)):
            for part in x:
                walk(part)

    walk(regex_parser.parse(pattern, re.I))
    return found


def _needed(nodes) -> set[str] | None:
    """Strings one of which every match of a parsed pattern holds; None if there are none."""
    options: list[set[str]] = [{r} for r in "".join(chr(v).lower() if k is regex_parser.LITERAL else "\0" for k, v in nodes).split("\0") if len(r) > 2 or len(r) == 2 and not r.isascii()]
    for kind, value in nodes:
        if kind is regex_parser.SUBPATTERN:
            options.append(_needed(value[-1]))
        elif kind is regex_parser.MAX_REPEAT and value[0]:
            options.append(_needed(value[-1]))
        elif kind is regex_parser.BRANCH:
            ways = [_needed(way) for way in value[1]]
            options.append(None if None in ways else set().union(*ways))
    return max((x for x in options if x), key=lambda x: min(map(len, x)), default=None)


_HINTS = ahocorasick.Automaton()
for _hint in set().union(*(_needed(regex_parser.parse(w, re.I)) for w in _WORDINGS.values())):
    _HINTS.add_word(_hint, True)
_HINTS.make_automaton()
_WORD_RUNS = {x for w in _WORDINGS.values() for x in _runs(w)} | FILLER_WORDS
_STEMS = re.compile("|".join(sorted((x for x in _WORD_RUNS if len(x) > 2), key=len, reverse=True)) + r"|[45]\d\d", re.I).search
_SHORT = frozenset(x for x in _WORD_RUNS if len(x) < 3)


@lru_cache(CACHE_KEYS)
def telling(word: str) -> bool:
    """Whether a verdict may depend on this word."""
    return bool(_STEMS(word)) or not _SHORT.isdisjoint(_LETTERS(word.lower()))


_cased = lambda words: frozenset(words) | {w.capitalize() for w in words}
_BINDS, _FILLS = _cased(FUNCTION_WORDS), _cased(FILLER_WORDS - FUNCTION_WORDS)


def may_tell(sentence: str, words: list[str]) -> bool:
    """Whether a sentence (and its words as they stand) has what every sentence with a verdict has."""
    if next(_HINTS.iter(sentence.lower()), None) is not None or _SAME_WORD.match(sentence):
        return True
    return (not _FILLS.isdisjoint(words) or sentence.count(",") > 2) and _mostly_filler(_LETTERS(sentence.lower()))


def style_of(sentence: str, words: list[str]) -> str | None:
    """bound: with a function word; loose: at least four words, none of them a function word, all in Latin letters."""
    if not _BINDS.isdisjoint(words):
        return "bound"
    plain = _LETTERS(sentence.lower())
    return "bound" if not FUNCTION_WORDS.isdisjoint(plain) else "loose" if len(plain) >= 4 and not _LATIN(sentence) else None


def _mostly_filler(words: list[str], variables: int = 0) -> bool:
    return len(words) >= 4 and not FILLER_WORDS.isdisjoint(words) and sum(w in FILLER_WORDS for w in words) >= 0.8 * (len(words) + variables)


def leaf_of(sentence, depth: int = TREE_DEPTH):
    """The leaf of a sentence column in the prefix tree: its number of words, then its first words, what varies left open."""
    first = F.regexp_replace(F.substring_index(sentence, " ", depth), r"(?<=^| )(?:[^\w ]*<|[^ ]*\d)[^ ]*", "<*>")
    return F.xxhash64(F.length(sentence) - F.length(F.translate(sentence, " ", "")), first)


def mine_templates(sentences: DataFrame, share: float = CONSTANT_SHARE) -> DataFrame:
    """(leaf, constants) of the leaves that hold enough sentences to have variables.

    ``sentences``: leaf, sentence, one row per use. At each place of a leaf the
    words that at least ``share`` of its sentences have are constants ("place
    word"). Only counts are gathered, so a leaf may hold any number of
    sentences; one of 1 / share or fewer has no variables and no row.
    """
    totals = sentences.groupBy("leaf").agg(F.count("*").alias("total")).where(F.col("total") * share > 1)
    counted = sentences.select("leaf", F.posexplode(F.split("sentence", " ")).alias("at", "word")).groupBy("leaf", "at", "word").agg(F.count("*").alias("n"))
    return counted.join(totals, "leaf").where(F.col("n") >= share * F.col("total")).groupBy("leaf").agg(F.collect_list(F.concat_ws(" ", "at", "word")).alias("constants"))


def template_of(sentence: str, constants: frozenset[str] | None) -> str:
    """The sentence with its leaf's variables left open; words that a verdict may depend on are none."""
    if constants is None:
        return sentence
    return " ".join(w if f"{i} {w}" in constants or telling(w) else "<*>" for i, w in enumerate(sentence.split(" ")))


def _verdicts(told: DataFrame, doc_id: str) -> DataFrame:
    """(doc_id, kind) of the rows whose template has a verdict; a task classifies each template once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str | None] = {}
        leaves: dict[int, frozenset[str] | None] = {}
        for batch in batches:
            take, kinds = [], []
            for i, (sentence, leaf) in enumerate(zip(batch.column("sentence").to_pylist(), batch.column("leaf").to_pylist())):
                if leaf not in leaves:
                    if len(leaves) >= CACHE_KEYS:
                        leaves.clear()
                    constants = batch.column("constants")[i].as_py()
                    leaves[leaf] = None if constants is None else frozenset(constants)
                template = template_of(sentence, leaves[leaf])
                if template not in known:
                    if len(known) >= CACHE_KEYS:
                        known.clear()
                    known[template] = classify(template)
                if known[template] is not None:
                    take.append(i)
                    kinds.append(known[template])
            yield pa.RecordBatch.from_arrays([batch.column(doc_id).take(pa.array(take, pa.int64())), pa.array(kinds, pa.string())], names=[doc_id, "kind"])

    return told.select(doc_id, "sentence", "leaf", "constants").mapInArrow(run, f"{doc_id} {told.schema[doc_id].dataType.simpleString()}, kind string")


def _made_up(rows: DataFrame, doc_id: str) -> DataFrame:
    """(doc_id, kind) of loose sentences (no function word in them) of words that hardly ever stand beside a function word in the corpus."""
    words = F.split(F.translate(F.lower("sentence"), ".,;:!?()\"'", ""), " ")
    used = rows.where("style is not null").select("style", F.explode(F.when(F.col("style") == "loose", F.array_distinct(words)).otherwise(words)).alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.count_if(F.col("style") == "bound").alias("bound"))
    made_up = used.where((F.col("n") >= FILLER_LEAST) & (F.col("bound") <= FILLER_BOUND * F.col("n")) & F.col("word").rlike("^[a-z\u00c0-\u024f\u0300-\u036f]+$")).select("word")
    loose = rows.where("style = 'loose'").select(doc_id, F.xxhash64("sentence").alias("row"), F.explode(F.filter(F.array_distinct(words), lambda w: w != "")).alias("word"))
    hit = loose.join(made_up.withColumn("hit", F.lit(1)), "word", "left").groupBy(doc_id, "row").agg(F.count("*").alias("size"), F.count("hit").alias("made_up"))
    return hit.where("made_up >= 0.8 * size and made_up >= 4").select(doc_id, F.lit("filler").alias("kind"))


def find_residue(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, kind) for each kind of residue a document holds: slot, section, filler, error_page, script_notice.

    Null, empty and blank texts have none; a null doc_id is kept as a key of
    its own; texts of any length are read whole; repeated rows give one row;
    an empty table gives none; further columns are not read.

    Leaves of the prefix tree in which no sentence has a word that a verdict
    depends on cannot get one; they are not worked out.
    """
    schema = f"{doc_id} {documents.schema[doc_id].dataType.simpleString()}, kind string, sentence string, told boolean, style string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            take, kinds, found, told, styles = [], [], [], [], []
            for i, value in enumerate(batch.column("_text")):
                for kind, sentence in dict.fromkeys(parts(value.as_py() or "")):
                    take.append(i)
                    kinds.append(kind)
                    found.append(sentence)
                    words = sentence.split(" ")
                    told.append(may_tell(sentence, words))
                    styles.append(style_of(sentence, words))
            yield pa.RecordBatch.from_arrays([batch.column(doc_id).take(pa.array(take, pa.int64())), pa.array(kinds, pa.string()), pa.array(found, pa.string()), pa.array(told, pa.bool_()), pa.array(styles, pa.string())], names=[doc_id, "kind", "sentence", "told", "style"])

    rows = store(documents.select(doc_id, documents[text].alias("_text")).mapInArrow(run, schema).withColumn("leaf", leaf_of(F.col("sentence"))))
    sentences = rows.where("kind = 'sentence'")
    told = sentences.where("told").select(doc_id, "sentence", "leaf")
    constants = mine_templates(sentences.select("leaf", "sentence").join(told.select("leaf").distinct(), "leaf", "left_semi"))
    by_template = _verdicts(told.join(constants, "leaf", "left"), doc_id)
    return by_template.unionByName(_made_up(sentences, doc_id)).unionByName(rows.where("kind <> 'sentence'").select(doc_id, "kind")).distinct()


def without_residue(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no residue."""
    found = find_residue(documents, doc_id, text).select(doc_id).distinct()
    return documents.join(found, doc_id, "left_anti")
