"""Credentials embedded in source code: find and redact.

All literals are indexed corpus-wide with where they stand and what speaks for
their being credentials; values that many owners share, under whatever name, are
dropped as placeholders, rare structured and named values are confirmed (token
formats nobody listed are learned from the confirmed ones), and every body is
read again for the confirmed values with an automaton, the owners of all places
found being counted once more.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from math import log2

import ahocorasick
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewire.runtime import scan_keys, store

#: A named value of more owners is a placeholder; a token format is learned from so many confirmed values; confirmed values per automaton.
MOST_OWNERS, FORMAT_VALUES, AUTOMATON_VALUES = 20, 4, 200_000

# Words that name a credential by themselves.
SECRET_NAMES = """
password passwd passphrase passcode pwd secret credential credentials apikey bearer senha contrasena contraseña
kennwort passwort motdepasse wachtwoord haslo hasło salasana parola losenord lösenord parool пароль 密码 パスワード authtoken accesstoken
""".split()
# Words that name one after another word only ("db pass", "signing key").
SECRET_TAILS = {
    "pass": "db database user admin root smtp ftp ssh mail login",
    "pw": "db root admin user smtp login sudo",
    "key": "api access signing sign encryption private secret license licence master shared storage account hmac aes webhook ssh service subscription deploy stripe",
    "token": "access auth api private bearer refresh session id personal bot deploy service security oauth jwt csrf admin secret",
    "passe": "de",
    "credential": "",
}
# What may follow such a name in a longer one.
NAME_SUFFIXES = frozenset("prod production dev stage staging test live main default value str string old new tmp backup primary secondary v1 v2 v3 1 2 3".split())
# Token formats in public use, and what must follow the prefix.
KNOWN_FORMATS = (
    r"(?:AKIA|ASIA)[0-9A-Z]{16}(?![0-9A-Za-z])",
    r"gh[pousr]_[A-Za-z0-9]{36,}",
    r"github_pat_[A-Za-z0-9_]{22,}",
    r"glpat-[A-Za-z0-9_-]{20,}",
    r"xox[abeoprs]-[A-Za-z0-9-]{12,}",
    r"[sr]k_(?:live|test)_[A-Za-z0-9]{20,}",
    r"sk-(?:proj-|ant-|or-)?[A-Za-z0-9_-]{24,}",
    r"npm_[A-Za-z0-9]{36}",
    r"pypi-[A-Za-z0-9_-]{32,}",
    r"AIza[0-9A-Za-z_-]{35}",
    r"SG\.[\w-]{16,}\.[\w-]{16,}",
    r"hv[sb]\.[\w-]{24,}",
    r"dop_v1_[0-9a-f]{64}",
    r"shp(?:at|ss|ca|pa)_[0-9a-fA-F]{32}",
    r"ya29\.[\w-]{20,}",
    r"eyJ[\w-]{10,}\.eyJ[\w-]{10,}\.[\w-]{10,}",
)
_KNOWN = re.compile(r"(?<![\w+/-])(?:" + "|".join(KNOWN_FORMATS) + ")")
_PEM = re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY(?: BLOCK)?-----(?:\\[nr]|[\s\"'+,;\\])*([A-Za-z0-9+/=\s\\\"',]{40,})")
_URL_LOGIN = re.compile(r"(?<![\w])[A-Za-z][A-Za-z0-9+.-]{1,20}://([^\s:/@\"'`<>\\]*):([^\s/@\"'`\\]+)@[\w.\[-]")
_URL_PARAM = re.compile(r"[?&](?:\w*token|sig|signature|\w*key|code|\w*secret|password|passwd|pwd|auth|sv_sig)=([^&\s\"'`#<>\\]+)", re.I)
_WEBHOOK = re.compile(r"https?://hooks\.[\w.-]+/(?:services/)?(?:[A-Z]\w{6,}/){2}(\w{20,})")
_AUTH = re.compile(r"\b(Bearer|Basic|Token|ApiKey)\s+([A-Za-z0-9+/=_.~-]{8,})")
_FLAG = re.compile(r"(?<![\w-])--(?:[a-z]+-)*(?:password|passwd|pass|pwd|token|secret|api-?key|access-key|passphrase)(?:=|\s+)[\"']?([^\s\"'`,;|]+)", re.I)
_SHORT_P = re.compile(r"\b(?:\w*sql\w*|mysqldump|mongo\w*|sshpass)\b[^\n\"'`;|]*?\s-p ?([^\s\"'`,;|-][^\s\"'`,;|]*)")
_USER_PASS = re.compile(r"\b(?:curl|wget|http|https)\b[^\n\"'`;|]*?\s(?:-u|--user)[ =]?[\"']?([^\s:\"'`]+):([^\s\"'`]+)")
_LITERAL = re.compile(
    r"(?P<doc>\"\"\"(?:\\.|(?!\"\"\")[^\\])*\"\"\"|'''(?:\\.|(?!''')[^\\])*''')|\"(?P<dq>(?:\\.|[^\"\\\n])*)\"|'(?P<sq>(?:\\.|[^'\\\n])*)'|`(?P<bq>(?:\\.|[^`\\])*)`|(?P<note>(?<!:)//[^\n]*|(?:(?<=\s)|^)#(?![!{])[^\n]*|/\*(?:[^*]|\*(?!/))*\*/)",
    re.S | re.M,
)
# What stands before a literal, read backwards from it: no window is needed.
_NAME_BEFORE = re.compile(r"[rbuf@$]{0,2}\s*\(?\s*(?:=:|=\?\?|=\|\||>=|=|:|-<)\s*(?:[\w<>\[\]|. ]{1,200}?\s*:\s*)?\]?([\w$-]*[A-Za-z_$\u00c0-\uffff])(?=[\s({\[,;.&|]|\Z)")
_ENV_DEFAULT = re.compile(r"\s*(?:\?\?|\|\|)\s*(\w+)\.(?:vne|VNE)\b|\s*(?:\?\?|\|\||ro)\s*\]\s*[\"'](\w+)[\"']\s*\[(?:norivne|vne|VNE)")
_CALLED = re.compile(r"\s*\((\w+)")
_SETTER = re.compile(r"(?:set|with|use)_?([A-Za-z_]\w+)")
_OPENED = re.compile(r"\s*[\[{(,]")
_SHELL_DEFAULT = re.compile(r"\$\{(\w+):?[-=]([^}$]+)\}")
_SHELL_PLAIN = re.compile(r"(?m)^\s*(?:export\s+|local\s+|readonly\s+|declare\s+(?:-\w+\s+)?|set\s+)?([A-Za-z_]\w*)=([^\s\"'`$;|&()<>]+)")
_INNER = re.compile(r"\\?[\"']([\w.-]{2,})\\?[\"']\s*:\s*\\?[\"']((?:[^\"'\\]|\\[^\"'])+)\\?[\"']")
_INNER_PLAIN = re.compile(r"(?<![\w.-])([A-Za-z_][\w-]+)=([^\s;&,\"'`<>]{6,})")
_NOTE = re.compile(r"(?<![\w])((?:[^\W\d_][\w-]*\s+){0,3}[^\W\d_][\w-]*)\s*(?:=|:|\bis\b|\bwas\b|->|=>)\s*[\"'`]?([^\s\"'`]{6,})")
_NOTE_LOGIN = re.compile(r"\b(?:login|logon|account|user)\b:?\s+[\w.@-]+\s*(?:/|:|\bpw\b|\bpass(?:word)?\b)\s*([^\s\"'`]{6,})", re.I)
_CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])|[_\W]+")
_MASKED = re.compile(
    r"(?i)x{4,}|\*{3,}|\.{4,}|(?<![a-z0-9])(?:replace|example|dummy|placeholder|your|insert|todo|fixme|fake|sample|redacted|masked|hidden)(?![a-z0-9]*\d)|change[-_ ]?(?:me|it|this)|example(?:key)?$|not[-_ ]?a[-_ ]?real|secret here|here>|"
    r"^<.*>$|\{\{.*\}\}|^\$\{?\w|^%\(?\w|^%\w+%$|^\{\w*\}$|^(?:vault|ssm|secrets?|env|file|op|aws|gcp|azure|kms|arn|keychain|sops|doppler|keyvault|ref|sm)[:/]|^\$\(|^(?:none|null|nil|undefined|true|false|test|password|passwd|secret|token|pass|admin|root|user)$|^process\.|^os\.|getenv"
)
_HEX = re.compile(r"^[0-9a-fA-F]+$")
_TAIL = re.compile(r"^((?:[A-Za-z][A-Za-z0-9]{1,9}[-_.:]){1,3})([A-Za-z0-9][\w-]{14,})$")
_BENIGN_PREFIX = re.compile(r"(?i)^(?:sha\d+|md5|data|http|https|urn|uuid|v\d+|rev|ssh|text|image|application)[-_.:]")


def name_words(name: str) -> list[str]:
    return [w.lower() for w in _CAMEL.split(name) if w]


def names_credential(name: str) -> bool:
    """Whether a variable, field or comment names a credential itself rather than something about one."""
    words = name_words(name)
    while len(words) > 1 and words[-1] in NAME_SUFFIXES:
        words.pop()
    if not words:
        return False
    if words[-1] in SECRET_NAMES:
        return True
    before = SECRET_TAILS.get(words[-1])
    return before is not None and len(words) > 1 and words[-2] in before.split()


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * log2(c / n) for c in Counter(value).values()) if n else 0.0


def is_placeholder(value: str) -> bool:
    return len(value) < 6 or len(set(value)) <= 3 or bool(_MASKED.search(value))


def looks_secret(value: str) -> bool:
    """A password-like or random value: no placeholder, no plain words, no sentence, path or address."""
    if is_placeholder(value) or value.count(" ") > 1 or "://" in value:
        return False
    if _KNOWN.match(value):
        return True
    if value.isdigit():
        return len(value) >= 8
    words = [w for w in re.split(r"[-_./:# ]", value) if w]
    if all(w.isalpha() for w in words):
        turns = sum(a.islower() != b.islower() for a, b in zip(value, value[1:]) if a.isalpha() and b.isalpha())
        return len(words) == 1 and len(value) >= 16 and turns > len(value) / 4
    return any(c.isdigit() or not c.isalnum() for c in value)


def looks_random(value: str) -> bool:
    """A long value without words: what a value in no telling place must be."""
    return len(value) >= 20 and not _HEX.match(value) and not is_placeholder(value) and any(c.isdigit() for c in value) and any(c.isupper() for c in value) and any(c.islower() for c in value) and entropy(value) > 3.5


def _basic_login(encoded: str) -> bool:
    try:
        user, colon, password = base64.b64decode(encoded, validate=True).decode().partition(":")
    except ValueError:
        return False
    return bool(colon and user.isprintable() and not is_placeholder(password))


def value_format(value: str) -> str | None:
    """The telling beginning of a prefixed random value ("abc-live-" of "abc-live-0Yak...")."""
    m = _TAIL.match(value)
    return m[1] if m and not _BENIGN_PREFIX.match(value) and entropy(m[2]) > 3 else None


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def candidates(text: str) -> list[tuple[int, str, str]]:
    """(line, value, kind) of what may be a credential; kind: listed (private keys and listed formats), sure, named or shaped (to be confirmed by its format)."""
    return [(at, value, kind) for at, value, kind in literals(text) if kind]


def literals(text: str) -> list[tuple[int, str, str | None]]:
    """(line, value, kind) of all literals of a text, and of values inside them, in its comments and commands that may be credentials; no kind if nothing speaks for it."""
    found: dict[tuple[int, str], str | None] = {}
    ends = [m.start() for m in re.finditer("\n", text)]
    back, n = text[::-1], len(text)

    def add(at: int, value: str, kind: str | None) -> None:
        key = (bisect_left(ends, at) + 1, value)
        if _STRENGTH[kind] > _STRENGTH[found.get(key)] or key not in found:
            found[key] = kind

    for m in _PEM.finditer(text):
        if not is_placeholder(m[1].strip()):
            add(m.start(), m[0].split("-----")[1] + ":" + _digest(re.sub(r"\\[nr]|[\s\"'+,;\\]", "", m[1])), "listed")
    for m in _KNOWN.finditer(text):
        if not is_placeholder(m[0]):
            add(m.start(), m[0], "listed")
    for m in _URL_LOGIN.finditer(text):
        if not is_placeholder(m[2]) and not re.search(r"[{}<>$]|^%s", m[2]):
            add(m.start(2), m[2], "sure")
    for rx in (_URL_PARAM, _WEBHOOK):
        for m in rx.finditer(text):
            if len(m[1]) >= 12 and looks_secret(m[1]) and not m[1].startswith("{"):
                add(m.start(1), m[1], "sure")
    for m in _AUTH.finditer(text):
        if _basic_login(m[2]) if m[1] == "Basic" else looks_secret(m[2]) and len(m[2]) >= 16:
            add(m.start(2), m[2], "sure")
    for m in _USER_PASS.finditer(text):
        if not is_placeholder(m[2]) and "$" not in m[2]:
            add(m.start(2), m[2], "sure")
    for rx in (_FLAG, _SHORT_P):
        for m in rx.finditer(text):
            if looks_secret(m[1]) and "$" not in m[1][:1]:
                add(m.start(1), m[1], "sure")

    previous: tuple[int, int, str] | None = None  # start of the preceding literal chain, end, value
    spans = list(_LITERAL.finditer(text))
    i = 0
    while i < len(spans):
        m = spans[i]
        i += 1
        if m["note"] is not None:
            for rx, name in ((_NOTE, 1), (_NOTE_LOGIN, 0)):
                for x in rx.finditer(m["note"]):
                    value = x[rx.groups].rstrip(",") if x[rx.groups][-1:] == "," else x[rx.groups]
                    words = x[1].split() if name else []
                    if (not name or any(names_credential(" ".join(words[k:])) for k in range(len(words)))) and looks_secret(value) and not re.match(r"[\w.]+\(", value):
                        add(m.start() + x.start(rx.groups), value, "named")
            for x in _INNER_PLAIN.finditer(m["note"]):
                if names_credential(x[1]) and looks_secret(x[2]):
                    add(m.start() + x.start(2), x[2], "named")
            previous = None
            continue
        body = lambda s: next((s[g] for g in ("dq", "sq", "bq") if s[g] is not None), s["doc"] and s["doc"][3:-3]) or ""
        start, end, value = m.start(), m.end(), body(m)
        first_line_at = start
        while i < len(spans) and spans[i]["note"] is None and re.fullmatch(r"\s*\+\s*|\s+" if m["doc"] is None else r"\s*\+\s*", text[end : spans[i].start()]) and value:
            if not re.search(r"\+", text[end : spans[i].start()]) and "\n" in text[end : spans[i].start()]:
                break
            value += body(spans[i])
            end = spans[i].end()
            i += 1
        names: list[str] = []
        if x := _NAME_BEFORE.match(back, n - start):
            names.append(x[1][::-1])
        if x := _ENV_DEFAULT.match(back, n - start):
            names.append((x[1] or x[2])[::-1])
        if (x := _CALLED.match(back, n - start)) and (x := _SETTER.fullmatch(x[1][::-1])):
            names.append(x[1])
        if previous and re.fullmatch(r"\s*\]?\s*(?:[:,=]|=>|:=)\s*[rbuf]{0,2}", text[previous[1] : start]):
            between = text[previous[1] : start]
            if "," not in between or _OPENED.match(back, n - previous[0]):
                names.append(previous[2])
        if end - start > len(value) + 2 and _KNOWN.match(value) and not is_placeholder(value):
            add(first_line_at, value, "listed")  # joined from several literals
        elif any(names_credential(n) for n in names):
            if looks_secret(value):
                add(first_line_at, value, "named")
        elif looks_random(value) and value_format(value):
            add(first_line_at, value, "shaped")
        if value:
            add(first_line_at, value, None)
            for x in _SHELL_DEFAULT.finditer(value):
                if names_credential(x[1]) and looks_secret(x[2]):
                    add(start + 1, x[2], "named")
            for rx in (_INNER, _INNER_PLAIN):
                for x in rx.finditer(value):
                    if names_credential(x[1]) and looks_secret(x[2]):
                        add(start + 1 + x.start(2), x[2], "named")
        previous = (start, end, value)
    for m in _SHELL_DEFAULT.finditer(text):
        if names_credential(m[1]) and looks_secret(m[2]):
            add(m.start(2), m[2], "named")
    for m in _SHELL_PLAIN.finditer(text):
        if names_credential(m[1]) and looks_secret(m[2]) and not re.search(r"[({\[]", m[2]):
            add(m.start(2), m[2].rstrip(";"), "named")
    return [(at, value, kind) for (at, value), kind in found.items()]


#: Kinds of a literal, the stronger the greater.
_STRENGTH = {None: 0, "shaped": 1, "named": 2, "sure": 3, "listed": 4}
_INDEX = "key string, line_no bigint, literal bigint, context bigint, value string, kind string, format string"


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _indexed(text: str) -> list[tuple]:
    lines, out = text.split("\n"), []
    for at, value, kind in literals(text):
        format_ = value_format(value) if kind in ("named", "shaped") else None
        out.append((at, _hash(value), _hash(lines[at - 1].replace(value, "").strip()), value if kind else None, kind, format_))
    return out


def index_literals(bodies: DataFrame) -> DataFrame:
    """(key, line_no, literal, context, value, kind, format) of all literals of the bodies (key, text).

    literal is a hash of the value and context one of the rest of its line;
    value and kind are null if nothing speaks for its being a credential.
    """
    return scan_keys(bodies, "key", "text", _indexed, [("line_no", pa.int64()), ("literal", pa.int64()), ("context", pa.int64()), ("value", pa.string()), ("kind", pa.string()), ("format", pa.string())], _INDEX)


def _owners(places: DataFrame, holders: DataFrame) -> DataFrame:
    """(literal, owners): the lesser of the owners and the different lines of each literal among ``places`` (literal, key, context).

    Copies of one body have many owners too, but hold the value in one line of
    code; a placeholder stands in many different ones.
    """
    count = lambda df, c: df.select("literal", c).distinct().groupBy("literal").agg(F.count("*").alias(c))
    owner = count(places.select("literal", "key").distinct().join(holders, "key"), "owner")
    return owner.join(count(places, "context"), "literal").select("literal", F.least("owner", "context").alias("owners"))


def confirm(index: DataFrame, holders: DataFrame, most_owners: int = MOST_OWNERS, format_values: int = FORMAT_VALUES) -> DataFrame:
    """(value, literal, listed) of the values that are credentials: those few owners share, of a listed or a learned format or under a credential's name.

    Owners and lines are counted over all literals of the index. Private keys
    and listed formats are no placeholders, however many hold them.
    """
    found = index.where("kind is not null")
    kinds = found.groupBy("value", "literal").agg(F.bool_or(F.col("kind") == "listed").alias("listed"), F.bool_or(F.col("kind").isin("listed", "sure")).alias("sure"), F.bool_or(F.col("kind") == "named").alias("named"), F.max("format").alias("format"))
    owners = _owners(index.select("literal", "key", "context").join(found.select("literal").distinct(), "literal", "left_semi"), holders)
    values = kinds.join(owners, "literal").where(F.col("listed") | (F.col("owners") <= most_owners))
    formats = values.where("named and format is not null").groupBy("format").agg(F.count("*").alias("n")).where(F.col("n") >= format_values).select("format", F.lit(True).alias("learned"))
    return values.join(formats, "format", "left").where(F.col("sure") | F.col("named") | F.coalesce("learned", F.lit(False))).select("value", "literal", "listed")


_automata: dict[str, ahocorasick.Automaton] = {}


def _automaton(name: str, values: list[str]) -> ahocorasick.Automaton:
    """The automaton of a block of values; a worker keeps the last one."""
    if name not in _automata:
        _automata.clear()
        machine = ahocorasick.Automaton()
        for v in values:
            machine.add_word(v, v)
        machine.make_automaton()
        _automata[name] = machine
    return _automata[name]


def _whole(text: str, lo: int, hi: int) -> bool:
    return not (lo and (text[lo - 1].isalnum() or text[lo - 1] == "_") and (text[lo].isalnum() or text[lo] == "_")) and not (hi < len(text) and (text[hi].isalnum() or text[hi] == "_") and (text[hi - 1].isalnum() or text[hi - 1] == "_"))


def _quoted(text: str, lo: int, hi: int) -> bool:
    return lo > 0 and text[lo - 1] in "\"'`" and text[hi : hi + 1] == text[lo - 1]


def rescan(bodies: DataFrame, confirmed: DataFrame, block: int = AUTOMATON_VALUES) -> DataFrame:
    """(key, line_no, literal, context, value) of every place where a confirmed value stands; one under 8 characters only as a whole quoted literal.

    The values go to the workers in blocks of bounded size, one pass over the
    bodies per block.
    """
    spark = bodies.sparkSession
    values = confirmed.where(~F.col("value").rlike("^BEGIN .*:")).select("value")
    total = values.count()
    out = None
    for at in range(blocks := max(1, -(-total // max(1, block * 4 // 5)))):
        some = sorted(r.value for r in values.where(F.pmod(F.xxhash64("value"), F.lit(blocks)) == at).collect()) if total else []  # at most about AUTOMATON_VALUES
        sent, name = spark.sparkContext.broadcast(some), _digest("\0".join(some))

        def analyse(body: str, sent=sent, name=name) -> list[tuple]:
            if not sent.value:
                return []
            hits = {}
            for end, v in _automaton(name, sent.value).iter(body):
                lo = end + 1 - len(v)
                if _quoted(body, lo, end + 1) if len(v) < 8 else _whole(body, lo, end + 1):
                    first, last = body.rfind("\n", 0, lo) + 1, body.find("\n", lo)
                    line = body[first : last if last >= 0 else len(body)]
                    hits[body.count("\n", 0, lo) + 1, v] = _hash(line.replace(v, "").strip())
            return [(line_no, _hash(v), context, v) for (line_no, v), context in hits.items()]

        part = scan_keys(bodies, "key", "text", analyse, [("line_no", pa.int64()), ("literal", pa.int64()), ("context", pa.int64()), ("value", pa.string())], "key string, line_no bigint, literal bigint, context bigint, value string")
        out = part if out is None else out.unionByName(part)
    return out


def find_credentials(rows: DataFrame, row_id: str, owner: str, key: str, text: str, **limits: int) -> DataFrame:
    """(row_id, line_no, value) of the credentials in ``text``; line_no is the line on which the value begins.

    ``key`` names equal texts (a hash of the text), ``owner`` who holds a
    value. Null texts have no rows, a text with a null key is known by its own
    hash; texts are read whole; repeated rows give one row; an empty table
    gives none; other columns are not read. A private key's value stands as its
    kind and a hash of the whole key.
    """
    held = rows.where(F.col(text).isNotNull()).select(F.col(row_id).alias("row_id"), F.col(owner).alias("owner"), F.coalesce(F.col(key), F.concat(F.lit("text "), F.sha2(text, 256))).alias("key"), F.col(text).alias("text"))
    bodies, holders = held.select("key", "text"), held.select("key", F.coalesce("owner", F.lit("")).alias("owner")).distinct()
    index = store(index_literals(bodies))
    confirmed = store(confirm(index, holders, **limits))
    taken = index.where("kind is not null").join(confirmed.select("value"), "value", "left_semi").select("key", "line_no", "literal", "context", "value")
    places = store(taken.unionByName(rescan(bodies, confirmed)).distinct())
    bound = places.join(confirmed.where(~F.col("listed")).select("literal"), "literal", "left_semi")
    common = _owners(bound, holders).where(F.col("owners") > limits.get("most_owners", MOST_OWNERS)).select("literal")
    left = places.join(common, "literal", "left_anti").select("key", "line_no", "value").distinct()
    return held.select("row_id", "key").join(left, "key").select("row_id", "line_no", "value").distinct()


def redact(text: str, values: list[str], mask: str = "REDACTED") -> str:
    """``text`` with each of the credential values replaced, everything else as it was."""
    for value in sorted(values, key=len, reverse=True):
        if value.startswith("BEGIN ") and ":" in value:
            text = re.sub(r"(-----BEGIN (?:[A-Z]+ )?PRIVATE KEY(?: BLOCK)?-----)(.*?)(?=-----END|\Z)", lambda m: m[1] + re.sub(r"[A-Za-z0-9+/=]{16,}", mask, m[2]), text, flags=re.S)
        elif value in text:
            text = text.replace(value, mask)
        else:  # joined from several literals
            text = re.sub(r"(?:[\"'`]\s*\+?\s*[\"'`])?".join(map(re.escape, value)), lambda _: mask, text)
    return text


def redact_bodies(rows: DataFrame, found: DataFrame, row_id: str, text: str) -> DataFrame:
    """(row_id, redacted) of each row that holds a credential, once per row id."""
    values = found.groupBy("row_id").agg(F.collect_set("value").alias("values"))
    once = rows.where(F.col(text).isNotNull()).select(F.col(row_id).alias("row_id"), F.col(text).alias("text")).join(values, "row_id").dropDuplicates(["row_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [redact(t.as_py(), v.as_py()) for t, v in zip(batch.column("text"), batch.column("values"))]
            yield pa.RecordBatch.from_arrays([batch.column("row_id"), pa.array(done, pa.string())], names=["row_id", "redacted"])

    return once.mapInArrow(run, "row_id string, redacted string")
