"""Names, bodies and signatures of code as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words of code that say nothing about its subject.
NOISE_WORDS = """
const let var function return if else for while this new true false null undefined import export from async await class
interface type extends implements void string number boolean any unknown never promise
""".split()
# Whole words and their stems.
STEMS = {
    "handler": "handle", "service": "serve", "manager": "manage", "factory": "factor", "builder": "build", "provider": "provide",
    "controller": "control", "validator": "valid", "serializer": "serial", "repository": "repo", "middleware": "middle", "resolver": "resolv",
    "adapter": "adapt", "listener": "listen", "observer": "observ", "wrapper": "wrap", "helper": "help", "utility": "util",
}
# Wordings of commit subjects.
BUG_FIX = r"(?i)\bfix(?:e[sd])?\b|\bbug\b|\bpatch\b|\bhotfix\b|\bresolve[sd]?\b|\bclose[sd]?\s+#\d+|\bregression\b"
REVERT = r"(?i)^revert\b"
MERGE = r"(?i)^merge\s+(branch|pull\s+request|remote)"
# Spellings of languages.
LANGUAGE_NAMES = {"ts": "typescript", "js": "javascript", "py": "python", "sh": "bash", "shell": "bash", "golang": "go"}
IDENTIFIER = "[a-zA-Z_$][a-zA-Z0-9_$]*"


def language(c: Column) -> Column:
    """One spelling per language."""
    low = F.lower(F.trim(c))
    return reduce(lambda acc, kv: F.when(low == kv[0], kv[1]).otherwise(acc), LANGUAGE_NAMES.items(), low)


def split_compound(c: Column) -> Column:
    """Words of a compound name: at underscores, hyphens and changes of case."""
    marked = F.regexp_replace(F.regexp_replace(c, "([a-z])([A-Z])", "$1_$2"), "([A-Z]+)([A-Z][a-z])", "$1_$2")
    return F.filter(F.split(marked, "[_-]+"), lambda w: w != "")


def normalize_word(w: Column) -> Column:
    """Lower case, without trailing digits, stemmed; empty if shorter than two characters."""
    bare = F.regexp_replace(F.lower(w), r"\d+$", "")
    stems = F.create_map(*[F.lit(x) for kv in STEMS.items() for x in kv])
    out = F.coalesce(F.try_element_at(stems, bare), bare)
    return F.when(F.length(out) < 2, "").otherwise(out)


def _words(identifiers: Column, drop_noise: bool) -> Column:
    split = F.flatten(F.transform(identifiers, split_compound))
    words = F.filter(F.transform(split, normalize_word), lambda w: w != "")
    return F.filter(words, lambda w: ~w.isin(NOISE_WORDS)) if drop_noise else words


def name_tokens(c: Column) -> Column:
    return F.filter(F.transform(split_compound(c), normalize_word), lambda w: w != "")


def strip_literals(code: Column) -> Column:
    """Code without comments, string literals and numbers."""
    out = code
    for rx in (r"(?m)//.*$", r"/\*[\s\S]*?\*/", r"'(?:[^'\\]|\\.)*'", r'"(?:[^"\\]|\\.)*"', r"`(?:[^`\\]|\\.)*`", r"\b0[xX][0-9a-fA-F]+\b", r"\b0[bB][01]+\b", r"\b0[oO][0-7]+\b", r"\b\d+(?:\.\d+)?(?:[eE][+-]?\d+)?\b"):
        out = F.regexp_replace(out, rx, "")
    return out


def body_tokens(code: Column) -> Column:
    """Words of the identifiers of a body, with repeats, without noise words."""
    return _words(F.regexp_extract_all(strip_literals(code), F.lit(IDENTIFIER), F.lit(0)), True)


def signature_tokens(c: Column) -> Column:
    return _words(F.regexp_extract_all(c, F.lit(IDENTIFIER), F.lit(0)), True)


def loose_name_words(c: Column) -> Column:
    """Set of lower-case words of a name, neither stemmed nor stripped of digits."""
    marked = F.regexp_replace(F.regexp_replace(c, "([a-z])([A-Z])", "$1_$2"), "([A-Z])([A-Z][a-z])", "$1_$2")
    return F.array_distinct(F.filter(F.split(F.lower(marked), r"[_\-\s.]+"), lambda w: w != ""))


def trigrams(c: Column) -> Column:
    """Set of padded three-letter pieces of the words of a text."""
    words = F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda w: w != "")
    pieces = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))


def jaccard(a: Column, b: Column) -> Column:
    """Shared part of two sets, 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def jaccard_of(shared: Column, a: Column, b: Column) -> Column:
    """``jaccard`` from the sizes of two sets and of their shared part."""
    return F.when(a + b == 0, 0.0).otherwise(shared / (a + b - shared))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def name_similarity(a: Column, b: Column) -> Column:
    """Greater one of edit similarity (ignoring case) and word overlap."""
    longest = F.greatest(F.length(a), F.length(b))
    edit = F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(F.lower(a), F.lower(b)) / longest)
    return F.greatest(edit, jaccard(loose_name_words(a), loose_name_words(b)))


def signature_parts(s: Column) -> Column:
    """Number of parameters, what follows the last colon, and set of words of a signature."""
    params = F.size(F.filter(F.split(F.regexp_extract(s, r"\((.*?)\)", 1), ","), lambda p: p != ""))
    returns = F.trim(F.element_at(F.split(s, ":"), -1))
    words = F.array_distinct(F.filter(F.split(F.lower(F.regexp_replace(s, "[(),:]", " ")), r"\s+"), lambda t: F.length(t) > 1))
    return F.struct(params.alias("params"), returns.alias("returns"), words.alias("words"))


def parts_similarity(params: tuple[Column, Column], same_return: Column, both_words: Column, words: Column, weights: tuple[float, float, float] = (0.4, 0.4, 0.2)) -> Column:
    """Of two different signatures that are not empty: arity ratio, equal returns that are not empty, overlap of their words."""
    most = F.greatest(*params)
    arity = F.when(most == 0, 1.0).otherwise(F.least(*params) / most)
    return F.least(F.lit(1.0), weights[0] * arity + weights[1] * F.when(same_return, 1.0).otherwise(0.0) + weights[2] * F.when(both_words, words).otherwise(0.0))


def signature_similarity(a: Column, b: Column, weights: tuple[float, float, float] = (0.4, 0.4, 0.2)) -> Column:
    """Weighted agreement of two signatures: arity ratio, what follows the last colon, word overlap."""
    x, y = signature_parts(a), signature_parts(b)
    both = (F.size(x["words"]) > 0) & (F.size(y["words"]) > 0)
    score = parts_similarity((x["params"], y["params"]), (x["returns"] != "") & (x["returns"] == y["returns"]), both, jaccard(x["words"], y["words"]), weights)
    empty = a.isNull() | b.isNull() | (a == "") | (b == "")
    return F.when(empty, 0.0).when(a == b, 1.0).otherwise(score)


def return_type(signature: Column) -> Column:
    """What a signature says it returns: after ) and a colon or arrow, else empty."""
    return F.trim(F.regexp_extract(signature, r"\)\s*(?::|->)\s*(.+)$", 1))


def union_members(type_text: Column) -> Column:
    """Class names of a union type: wrappers, type arguments and primitives removed."""
    bare = F.regexp_replace(type_text, r"^(?:Optional|Promise|Awaitable|Union)\s*[<\[](.*)[>\]]$", "$1")
    parts = F.transform(F.split(bare, r"\s*[|,]\s*"), lambda p: F.trim(F.regexp_replace(p, r"[<\[].*$", "")))
    primitive = ["", "string", "number", "boolean", "void", "null", "undefined", "any", "unknown", "never", "int", "str", "float", "bool", "None"]
    return F.filter(parts, lambda p: ~p.isin(primitive))


def regex_domain(pattern: Column) -> Column:
    """What kind of value a text stands for."""
    kinds = (
        ("email", r"[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"),
        ("url", r"https?://[^\s'\"]+"),
        ("uuid", r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}"),
        ("phone", r"\(\d{3}\)\s*\d{3}-?\d{4}|\d{3}-\d{3}-\d{4}"),
        ("ipv4", r"(?:\d{1,3}\.){3}\d{1,3}"),
        ("datetime", r"\d{4}-\d{2}-\d{2}"),
        ("numeric", r"^\d+(?:\.\d+)?$"),
        ("alpha", r"^[A-Za-z]+$"),
    )
    out = F.lit("custom")
    for name, rx in reversed(kinds):
        out = F.when(pattern.rlike(rx), name).otherwise(out)
    return out


def shorten(text: Column, width: int) -> Column:
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > width, F.concat(F.substring(flat, 1, width - 3), F.lit("..."))).otherwise(flat)


def token_estimate(text: Column) -> Column:
    """About the number of tokens of a text: a quarter of its characters, rounded up."""
    return F.ceil(F.length(text) / 4).cast("long")


def confidence_band(c: Column) -> Column:
    return F.when(c >= 0.80, "high").when(c >= 0.50, "medium").otherwise("low")


def predicate_shape(predicate: Column, category: Column) -> Column:
    """A predicate with its names made one, for grouping."""
    names = F.trim(F.regexp_replace(F.regexp_replace(predicate, r"(?i)\b[a-z_]\w*\b", "_VAR"), r"\s+", " "))
    guard = F.trim(F.regexp_replace(F.regexp_replace(predicate, r"typeof\s+\w+", "typeof _VAR"), r"\w+\s+instanceof\s+", "_VAR instanceof "))
    return F.when(category == "type_guard", guard).when(category.startswith("normalization"), category).when(category.isin("regex_validation", "enum_restriction"), F.trim(F.regexp_replace(predicate, r"\s+", " "))).otherwise(names)


def is_test_path(path: Column) -> Column:
    return path.contains(".test.") | path.contains(".spec.") | path.contains("__tests__")


def is_ignored_path(path: Column) -> Column:
    """Binary files, lock files and build output, which say nothing about changes of code."""
    return path.rlike(r"(?i)\.(png|jpe?g|gif|ico|svg|woff2?|ttf|eot|mp[34]|zip|gz|pdf|lock|map)$|(^|/)(node_modules|dist|build|coverage|\.git)/|(^|/)(package-lock\.json|yarn\.lock|pnpm-lock\.yaml)$")


def native_symbol_score(name: Column, query: Column, public: Column) -> Column:
    """Rank of a name for a query: equal, equal but for case, prefix, contained, words in common."""
    low, q = F.lower(name), F.lower(query)
    hits = F.size(F.array_intersect(loose_name_words(name), loose_name_words(query)))
    score = F.when(name == query, 100).when(low == q, 92).when(low.startswith(q), 84).when(low.contains(q), 76).when(hits > 0, 40 + 12 * hits).otherwise(0)
    return F.when(score > 0, score + F.when(public, 3).otherwise(0)).otherwise(0)
