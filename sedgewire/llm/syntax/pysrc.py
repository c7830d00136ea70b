"""Python."""

from __future__ import annotations

import re

from sedgewire.llm.syntax.core import Fault, Parser, Unexpected

# Reserved words, and signs from longest to shortest.
RESERVED = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield".split())
SIGNS = "**= //= >>= <<= ... != -> += -= *= /= %= &= |= ^= @= == <= >= << >> ** // := + - * / % @ & | ^ ~ < > ( ) [ ] { } , : . ; =".split()
_TOKEN = re.compile(
    r"(?P<ws>[ \t\f]+|\\\r?\n)|(?P<nl>\r\n|\n|\r)|(?P<lc>#[^\n\r]*)|"
    r"(?P<str>(?:[rR]|[uU]|[bB]|[bB][rR]|[rR][bB])?(?:\"\"\"(?:[^\\]|\\[\s\S])*?\"\"\"|'''(?:[^\\]|\\[\s\S])*?'''|\"(?!\"\")(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?!'')(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'))|"
    r"(?P<fstr>(?:[fFtT][rR]?|[rR][fFtT])(?:\"\"\"|'''|\"|'))|"
    r"(?P<num>(?:0[xX](?:_?[0-9a-fA-F])+|0[oO](?:_?[0-7])+|0[bB](?:_?[01])+|(?:(?:0(?:_?0)*|[1-9](?:_?\d)*)(?![\d.eEjJ_])|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*(?=[eEjJ]))(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?))(?!\w))|"
    r"(?P<id>[^\W\d]\w*)|(?P<sign>" + "|".join(re.escape(s) for s in SIGNS) + ")"
)
_INDENT = re.compile(r"[ \t\f]*")


# Brackets that may be open at once, and levels of indentation with the outermost, by the language's own reader.
MOST_BRACKETS, MOST_LEVELS = 200, 100


class Scan:
    """Logical lines of a text as tokens between newline, indent and dedent marks."""

    def __init__(self, text: str):
        self.text = text
        self.faults: list[Fault] = []
        self.inner: list[tuple[list[str], list[int], int]] = []

    def string_end(self, at: int, opened: str) -> int:
        """Place after a formatted string whose opening ends at ``at``; its expressions go to ``inner``."""
        text, n = self.text, len(self.text)
        quote = opened.lstrip("fFrRtT")
        raw, long = "r" in opened.lower(), len(quote) == 3
        while at < n:
            c = text[at]
            if text.startswith(quote, at):
                return at + len(quote)
            if c == "\\" and not raw:
                at += 2
            elif c == "\\":
                at += 2 if text[at + 1 : at + 2] in ("\\", quote[0]) else 1
            elif c == "{":
                if text.startswith("{{", at):
                    at += 2
                else:
                    at = self.field(at + 1, quote)
            elif c == "}":
                if not text.startswith("}}", at):
                    self.faults.append(Fault(at, "single } in formatted string"))
                    at += 1
                else:
                    at += 2
            elif c in "\n\r" and not long:
                break
            else:
                at += 1
        self.faults.append(Fault(min(at, n), "unterminated string"))
        return at

    def field(self, at: int, quote: str) -> int:
        """A replacement field from after its brace; returns the place after the closing one."""
        text, n = self.text, len(self.text)
        kinds, places, at = self.line(at, True)
        if not kinds:
            self.faults.append(Fault(at, "empty field in formatted string"))
        self.inner.append((kinds, places, at))
        if text.startswith("=", at) and text[at + 1 : at + 2] in "!:} ":
            at += 1
            while text[at : at + 1] == " ":
                at += 1
        if text.startswith("!", at):
            at += 2
        if text.startswith(":", at):
            at += 1
            while at < n and text[at] != "}":
                if text.startswith(quote, at) or text[at] == "\n" and len(quote) == 1:
                    break
                at = self.field(at + 1, quote) if text[at] == "{" else at + 1
        if text.startswith("}", at):
            return at + 1
        self.faults.append(Fault(at, "unclosed field in formatted string"))
        return at

    def line(self, at: int, nested: bool) -> tuple[list[str], list[int], int]:
        """Tokens of one logical line from ``at``, or of a field up to what ends its expression."""
        text, match, n = self.text, _TOKEN.match, len(self.text)
        kinds: list[str] = []
        places: list[int] = []
        open_: list[str] = []
        while at < n:
            if nested and not open_ and (text[at] in "}:" or text[at] == "!" and not text.startswith("!=", at) or text[at] == "=" and not text.startswith("==", at)):
                if not (text[at] == ":" and "lambda" in kinds):
                    return kinds, places, at
            m = match(text, at)
            if m is None:
                self.faults.append(Fault(at, "unterminated string" if text[at] in "\"'" else f"unexpected character {text[at]!r}"))
                stop = n if text.startswith(('"""', "'''"), at) else min([x for x in (text.find("\n", at), text.find("\r", at)) if x >= 0], default=n)
                at = stop
                kinds.append("bad")
                places.append(at)
                continue
            group = m.lastgroup
            start, at = at, m.end()
            if group == "ws" or group == "lc":
                continue
            if group == "nl":
                if open_ or nested:
                    continue
                return kinds, places, at
            if group == "sign":
                kind = m[0]
                if kind in "([{":
                    open_.append(kind)
                    if len(open_) == MOST_BRACKETS + 1:
                        self.faults.append(Fault(start, "too many nested brackets"))
                elif kind in ")]}":
                    if not open_ or open_[-1] + kind not in ("()", "[]", "{}"):
                        self.faults.append(Fault(start, f"unmatched {kind}"))
                        if nested:
                            return kinds, places, start
                    else:
                        open_.pop()
            elif group == "id":
                kind = m[0] if m[0] in RESERVED or m[0] in ("match", "case", "type", "_") else "id"
            elif group == "num":
                kind = "num"
            elif group == "str":
                kind = "str"
            else:
                kind = "str"
                at = self.string_end(at, m[0])
            kinds.append(kind)
            places.append(start)
        if open_ or nested:
            self.faults.append(Fault(n, f"unclosed {open_[-1]}" if open_ else "unclosed field"))
        return kinds, places, at

    def lines(self):
        """(kinds, places, indent, place, end) of each logical line that has tokens; indent as (columns with tabs of 8, of 1)."""
        text, n, at = self.text, len(self.text), 0
        while at < n:
            m = _INDENT.match(text, at)
            place, at = at, m.end()
            space = m[0].rsplit("\f", 1)[-1]
            column = 0
            for c in space:
                column = column + 1 if c == " " else (column // 8 + 1) * 8
            kinds, places, at = self.line(at, False)
            if kinds:
                yield kinds, places, (column, len(space)), place, at


_BLOCK = frozenset("if elif else for while try except finally with def class async match case @".split())
# Binding strength of binary operators.
BINARY = {"|": 1, "^": 2, "&": 3, "<<": 4, ">>": 4, "+": 5, "-": 5, "*": 6, "/": 6, "//": 6, "%": 6, "@": 6}
COMPARE = frozenset("< > == >= <= != in is not".split())
AUGMENT = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
_KNOWN: set[str] = set()


class LineParser(Parser):
    """One logical line. A compound line's header ends at its colon; what follows may be a simple line."""

    known = _KNOWN

    def run_line(self) -> str:
        """The word that begins the line if a block has to follow, else ''. Raises Unexpected."""
        k = self.k[0]
        if k in _BLOCK or k == "type":
            rule = getattr(self, "l_" + {"@": "at"}.get(k, k))
            at = self.i
            word = rule()
            if word is not None:
                if word == "@":
                    return ""
                self.need(":")
                if self.i < self.n:
                    self.simple()
                    return "=" + word
                return word
            self.i = at
        self.simple()
        return ""

    def simple(self) -> None:
        while True:
            self.small()
            if not self.eat(";"):
                break
            if self.i >= self.n:
                return
        if self.i < self.n:
            self.fail()

    # headers

    def l_if(self):
        self.i += 1
        self.named()
        return "if"

    def l_elif(self):
        self.l_if()
        return "elif"

    def l_while(self):
        self.l_if()
        return "while"

    def l_else(self):
        self.i += 1
        return "else"

    def l_try(self):
        self.i += 1
        return "try"

    def l_finally(self):
        self.i += 1
        return "finally"

    def l_except(self):
        self.i += 1
        star = self.eat("*")
        if self.k[self.i] != ":" or star:
            self.test()
            if self.eat("as"):
                self.name()
            elif self.k[self.i] == ",":
                self.fail()
        return "except"

    def l_for(self):
        self.i += 1
        self.targets()
        self.need("in")
        self.stars()
        return "for"

    def l_with(self):
        self.i += 1
        if self.k[self.i] == "(" and self.close.get(self.i) is not None and self.k[self.close[self.i] + 1] == ":" and self.attempt(self.with_group):
            return "with"
        self.with_item()
        while self.eat(","):
            self.with_item()
        return "with"

    def with_group(self) -> None:
        self.need("(")
        while not self.eat(")"):
            self.with_item()
            if self.k[self.i] != ")":
                self.need(",")
        if self.k[self.i] != ":":
            self.fail()

    def with_item(self) -> None:
        self.test()
        if self.eat("as"):
            self.target(self.star_target())

    def star_target(self):
        if self.eat("*"):
            return self.binary(0)
        return self.primary()

    def l_async(self):
        self.i += 1
        k = self.k[self.i]
        if k not in ("def", "for", "with"):
            self.fail()
        return getattr(self, "l_" + k)()

    def type_parameters(self) -> None:
        if self.eat("["):
            while not self.eat("]"):
                if not self.eat("*"):
                    self.eat("**")
                self.name()
                if self.eat(":"):
                    self.test()
                if self.eat("="):
                    self.star_or_test()
                if self.k[self.i] != "]":
                    self.need(",")

    def l_def(self):
        self.i += 1
        self.name()
        self.type_parameters()
        self.need("(")
        self.parameters(")", True)
        self.need(")")
        if self.eat("->"):
            self.stars()
        return "def"

    def parameters(self, end: str, typed: bool) -> None:
        star = slash = default = False
        first = True
        while self.k[self.i] != end:
            if self.eat("/"):
                if slash or star or first:
                    self.fail()
                slash = True
            elif self.eat("**"):
                self.name()
                if typed and self.eat(":"):
                    self.test()
                self.eat(",")
                if self.k[self.i] != end:
                    self.fail()
                return
            elif self.eat("*"):
                if star:
                    self.fail()
                star = True
                if self.k[self.i] == ",":
                    if self.k[self.i + 1] in (end, "**"):
                        self.fail()
                else:
                    self.name()
                    if typed and self.eat(":"):
                        self.star_or_test()
            else:
                self.name()
                if typed and self.eat(":"):
                    self.test()
                if self.eat("="):
                    self.test()
                    default = True
                elif default and not star:
                    self.fail("parameter without a default")
            first = False
            if self.k[self.i] != end:
                self.need(",")

    def l_class(self):
        self.i += 1
        self.name()
        self.type_parameters()
        if self.k[self.i] == "(":
            self.arguments()
        return "class"

    def l_at(self):
        self.i += 1
        self.named()
        if self.i < self.n:
            self.fail()
        return "@"

    def l_match(self):
        if self.k[self.n - 1] != ":" or self.k[1] in (":", "=", ".", ",", ")", "]"):
            return None
        at = self.i
        self.i += 1
        try:
            self.stars()
        except Unexpected:
            self.i = at
            return None
        if self.k[self.i] != ":" or self.i != self.n - 1:
            self.i = at
            return None
        return "match"

    def l_case(self):
        if ":" not in self.k or self.k[1] in ("=", ".", ")", "]"):
            return None
        self.i += 1
        self.pattern()
        while self.eat(","):
            if self.k[self.i] in (":", "if"):
                break
            self.pattern()
        if self.eat("if"):
            self.named()
        return "case"

    def l_type(self):
        if self.k[1] not in ("id", "match", "case", "type", "_"):
            return None
        self.i += 1
        self.name()
        self.type_parameters()
        self.need("=")
        self.test()
        if self.i < self.n:
            self.fail()
        return "@"

    def pattern(self) -> None:
        if self.eat("*"):
            self.name()
            return
        self.closed_pattern()
        while self.eat("|"):
            self.closed_pattern()
        if self.eat("as"):
            self.name()

    def closed_pattern(self) -> None:
        k = self.k[self.i]
        if k in ("(", "["):
            end = ")" if k == "(" else "]"
            self.i += 1
            while not self.eat(end):
                self.pattern()
                if self.k[self.i] != end:
                    self.need(",")
        elif k == "{":
            self.i += 1
            while not self.eat("}"):
                if self.eat("**"):
                    self.name()
                else:
                    self.closed_pattern()
                    self.need(":")
                    self.pattern()
                if self.k[self.i] != "}":
                    self.need(",")
        elif k == "str":
            while self.eat("str"):
                pass
        elif k in ("num", "-"):
            self.eat("-")
            self.need("num")
            if self.k[self.i] in ("+", "-"):
                self.i += 1
                self.need("num")
        elif k in ("None", "True", "False"):
            self.i += 1
        else:
            self.name()
            while self.eat("."):
                self.name()
            if self.eat("("):
                while not self.eat(")"):
                    if self.k[self.i + 1] == "=":
                        self.name()
                        self.i += 1
                    self.pattern()
                    if self.k[self.i] != ")":
                        self.need(",")

    # simple statements

    def name(self) -> None:
        if self.k[self.i] not in ("id", "match", "case", "type", "_"):
            self.fail()
        self.i += 1

    def dotted(self) -> None:
        self.name()
        while self.eat("."):
            self.name()

    def small(self) -> None:
        k = self.k[self.i]
        if k in ("pass", "break", "continue"):
            self.i += 1
        elif k == "return":
            self.i += 1
            if self.k[self.i] not in (";", "eof"):
                self.stars()
        elif k == "raise":
            self.i += 1
            if self.k[self.i] not in (";", "eof"):
                self.test()
                if self.eat("from"):
                    self.test()
        elif k == "assert":
            self.i += 1
            self.test()
            if self.eat(","):
                self.test()
        elif k == "del":
            self.i += 1
            self.target(self.list_of(self.binary0))
        elif k in ("global", "nonlocal"):
            self.i += 1
            self.name()
            while self.eat(","):
                self.name()
        elif k == "import":
            self.i += 1
            while True:
                self.dotted()
                if self.eat("as"):
                    self.name()
                if not self.eat(","):
                    break
        elif k == "from":
            self.i += 1
            dots = False
            while self.k[self.i] in (".", "..."):
                self.i += 1
                dots = True
            if not dots or self.k[self.i] != "import":
                self.dotted()
            self.need("import")
            if self.eat("*"):
                return
            group = self.eat("(")
            while True:
                self.name()
                if self.eat("as"):
                    self.name()
                if not self.eat(",") or group and self.k[self.i] == ")":
                    break
            if group:
                self.need(")")
        else:
            self.assignment()

    def assignment(self) -> None:
        starred = self.k[self.i] == "*"
        left = self.yield_or_stars()
        k = self.k[self.i]
        if k == ":":
            if left not in ("name", "member"):
                self.fail()
            self.i += 1
            self.test()
            if self.eat("="):
                self.yield_or_stars()
        elif k in AUGMENT:
            if left not in ("name", "member"):
                self.fail("not a target")
            self.i += 1
            self.yield_or_stars()
        elif k == "=":
            while self.eat("="):
                self.target(left)
                left = self.yield_or_stars()
        elif starred and left == "star":
            self.fail("starred expression")

    def target(self, kind) -> None:
        if kind not in ("name", "member", "group", "star"):
            self.fail("not a target of an assignment")

    def targets(self) -> None:
        self.target(self.list_of(self.binary0))

    def binary0(self):
        if self.eat("*"):
            kind = self.binary(1)
            return "star" if kind in ("name", "member", "group") else None
        return self.binary(0)

    def list_of(self, item):
        """Items with commas between; the kind of the whole as a target."""
        kind = item()
        if self.k[self.i] != ",":
            return kind
        good = kind in ("name", "member", "group", "star")
        while self.eat(","):
            if self.k[self.i] in ("=", ")", "]", "}", ":", ";", "eof", "in") or self.k[self.i] in AUGMENT:
                break
            good = item() in ("name", "member", "group", "star") and good
        return "group" if good else None

    def yield_or_stars(self):
        if self.k[self.i] == "yield":
            self.yield_()
            return None
        return self.stars()

    def yield_(self) -> None:
        self.need("yield")
        if self.eat("from"):
            self.test()
        elif self.k[self.i] not in (")", "]", "}", ";", "=", "eof", ":"):
            self.stars()

    def stars(self):
        return self.list_of(self.star_or_named)

    def star_or_named(self):
        if self.eat("*"):
            kind = self.binary(0)
            return "star" if kind in ("name", "member", "group") else None
        return self.named()

    def star_or_test(self) -> None:
        if self.eat("*"):
            self.binary(0)
        else:
            self.test()

    # expressions

    def named(self):
        if self.k[self.i + 1] == ":=":
            self.name()
            self.i += 1
            self.test()
            return None
        return self.test()

    def test(self):
        if self.k[self.i] == "lambda":
            self.i += 1
            self.parameters(":", False)
            self.need(":")
            self.test()
            kind = None
        else:
            kind = self.disjunction()
            if self.eat("if"):
                self.disjunction()
                self.need("else")
                self.test()
                kind = None
        return kind

    def disjunction(self):
        kind = self.conjunction()
        while self.eat("or"):
            self.conjunction()
            kind = None
        return kind

    def conjunction(self):
        kind = self.inversion()
        while self.eat("and"):
            self.inversion()
            kind = None
        return kind

    def inversion(self):
        if self.eat("not"):
            self.inversion()
            return None
        kind = self.binary(0)
        while self.k[self.i] in COMPARE and not self.no_in:
            k = self.k[self.i]
            self.i += 1
            if k == "not":
                self.need("in")
            elif k == "is":
                self.eat("not")
            self.binary(0)
            kind = None
        return kind

    no_in = False

    def binary(self, least: int):
        kind = self.unary()
        while (strength := BINARY.get(self.k[self.i], 0)) > least:
            self.i += 1
            self.binary(strength)
            kind = None
        return kind

    def unary(self):
        if self.k[self.i] in ("+", "-", "~"):
            self.i += 1
            self.unary()
            return None
        if self.k[self.i] == "await":
            self.i += 1
            kind = self.primary() and None
        else:
            kind = self.primary()
        if self.eat("**"):
            self.unary()
            return None
        return kind

    def primary(self):
        kind = self.atom()
        while True:
            k = self.k[self.i]
            if k == ".":
                self.i += 1
                self.name()
                kind = "member"
            elif k == "(":
                self.arguments()
                kind = None
            elif k == "[":
                self.i += 1
                self.subscript()
                while self.eat(","):
                    if self.k[self.i] == "]":
                        break
                    self.subscript()
                self.need("]")
                kind = "member"
            else:
                return kind

    def subscript(self) -> None:
        if self.eat("*"):
            self.binary(0)
            return
        if self.k[self.i] != ":":
            self.named()
        if self.eat(":"):
            if self.k[self.i] not in (":", ",", "]"):
                self.test()
            if self.eat(":") and self.k[self.i] not in (",", "]"):
                self.test()

    def arguments(self) -> None:
        self.need("(")
        keyword = double = False
        while not self.eat(")"):
            if self.eat("**"):
                self.test()
                double = True
            elif self.eat("*"):
                if double:
                    self.fail()
                self.test()
            elif self.k[self.i + 1] == "=":
                self.name()
                self.i += 1
                self.test()
                keyword = True
            else:
                first = self.k[self.i - 1] == "("
                self.named()
                if self.k[self.i] in ("for", "async"):
                    self.comprehension()
                    if not (first and self.k[self.i] in (")",)):
                        if self.k[self.i] != ")" and not (self.k[self.i] == "," and self.k[self.i + 1] == ")" and first):
                            self.fail("generator needs brackets")
                elif keyword or double:
                    self.fail("argument after a keyword argument")
            if self.k[self.i] != ")":
                self.need(",")

    def comprehension(self) -> None:
        while self.k[self.i] in ("for", "async"):
            self.eat("async")
            self.need("for")
            self.targets()
            self.need("in")
            self.disjunction()
            while self.eat("if"):
                if self.k[self.i + 1] == ":=":
                    self.named()
                else:
                    self.disjunction()

    def atom(self):
        k = self.k[self.i]
        if k == "id" or k in ("match", "case", "type", "_"):
            self.i += 1
            return "name"
        if k == "str":
            while self.eat("str"):
                pass
            return None
        if k in ("num", "None", "True", "False", "..."):
            self.i += 1
            return None
        if k == "(":
            self.i += 1
            if self.eat(")"):
                return "group"
            if self.k[self.i] == "yield":
                self.yield_()
                self.need(")")
                return None
            kind = self.star_or_named()
            if self.k[self.i] in ("for", "async"):
                self.comprehension()
                self.need(")")
                return None
            if self.k[self.i] == ",":
                good = kind in ("name", "member", "group", "star")
                while self.eat(","):
                    if self.k[self.i] == ")":
                        break
                    good = self.star_or_named() in ("name", "member", "group", "star") and good
                kind = "group" if good else None
            elif kind == "star":
                self.fail("starred expression")
            self.need(")")
            return kind
        if k == "[":
            self.i += 1
            good = True
            while not self.eat("]"):
                good = self.star_or_named() in ("name", "member", "group", "star") and good
                if self.k[self.i] in ("for", "async"):
                    self.comprehension()
                    self.need("]")
                    return None
                if self.k[self.i] != "]":
                    self.need(",")
            return "group" if good else None
        if k == "{":
            self.i += 1
            while not self.eat("}"):
                if self.eat("**"):
                    self.binary(0)
                else:
                    star = self.k[self.i] == "*"
                    self.star_or_named()
                    if not star and self.eat(":"):
                        self.test()
                    if self.k[self.i] in ("for", "async"):
                        self.comprehension()
                        self.need("}")
                        return None
                if self.k[self.i] != "}":
                    self.need(",")
            return None
        self.fail()


#: What may go before a word that continues a statement.
_CONTINUES = {"elif": ("if", "elif"), "else": ("if", "elif", "for", "while", "except", "try"), "except": ("try", "except"), "finally": ("try", "except", "else")}


def check_python(text: str) -> list[Fault]:
    """Errors of a module; each logical line is parsed by itself, blocks by indentation."""
    scan = Scan(text)
    faults: list[Fault] = []
    levels = [(0, 0)]
    # per level: the word of the statement that may be continued, whether its try has a handler yet, whether a match block
    open_: list[str] = [""]
    pending: tuple[str, int] | None = None
    decorated = False
    in_match = [False]
    text_lines = scan.lines()
    for kinds, places, indent, place, end in text_lines:
        if pending is not None:
            word, at = pending
            pending = None
            if indent[0] > levels[-1][0]:
                if indent[1] <= levels[-1][1]:
                    faults.append(Fault(place, "tabs and spaces mixed"))
                levels.append(indent)
                open_.append("")
                in_match.append(word == "match")
                if len(levels) == MOST_LEVELS + 1:
                    faults.append(Fault(place, "too many levels of indentation"))
            else:
                faults.append(Fault(at, f"no block after {word}"))
        elif indent[0] > levels[-1][0]:
            faults.append(Fault(place, "unexpected indent"))
            levels.append(indent)
            open_.append("")
            in_match.append(False)
        while indent[0] < levels[-1][0] and len(levels) > 1:
            if open_[-1] == "try":
                faults.append(Fault(place, "try without handler"))
            levels.pop()
            open_.pop()
            in_match.pop()
        if indent != levels[-1]:
            if indent[0] != levels[-1][0]:
                faults.append(Fault(place, "indent matches no block"))
                levels[-1] = indent
            elif indent[1] != levels[-1][1]:
                faults.append(Fault(place, "tabs and spaces mixed"))
        first = kinds[0]
        if open_[-1] == "try" and first not in ("except", "finally"):
            faults.append(Fault(place, "try without handler"))
            open_[-1] = ""
        before = open_[-1]
        parser = LineParser(kinds, places, None, end)
        key = parser.codes
        word = ""
        if key in _KNOWN and first not in _BLOCK:
            open_[-1] = ""
        elif first in _CONTINUES and before not in _CONTINUES[first]:
            faults.append(Fault(place, f"{first} without a statement to continue"))
            open_[-1] = ""
            if parser.k[parser.n - 1] == ":":
                pending = (first, place)
            continue
        else:
            try:
                word = parser.run_line()
                if not word and first not in _BLOCK and "bad" not in kinds:
                    if len(_KNOWN) >= 50_000:
                        _KNOWN.clear()
                    _KNOWN.add(key)
            except Unexpected as e:
                parser.report(e)
                faults += parser.faults
                if kinds[-1] == ":":
                    word = first if first in _BLOCK else "statement"
            except RecursionError:
                faults.append(Fault(place, "nested too deeply"))
            done = word.lstrip("=")
            open_[-1] = done if done in ("if", "elif", "for", "while", "try", "except", "else", "finally") else ""
            if done == "else" and before in ("try",):
                faults.append(Fault(place, "else after try without handler"))
            if done == "else" and before not in ("except",) or done == "finally":
                open_[-1] = "" if done == "finally" or before != "except" else "else"
        if in_match[-1] and first != "case":
            faults.append(Fault(place, "only case may stand in match"))
        if decorated and first not in ("def", "class", "async", "@"):
            faults.append(Fault(place, "decorator without definition"))
        decorated = first == "@"
        if word and not word.startswith("="):
            pending = (word, place)
    n = len(text)
    if pending is not None:
        faults.append(Fault(pending[1], f"no block after {pending[0]}"))
    if decorated:
        faults.append(Fault(n, "decorator without definition"))
    if "try" in open_:
        faults.append(Fault(n, "try without handler"))
    for kinds, places, end in scan.inner:
        inner = LineParser(kinds, places, None, end)
        try:
            inner.yield_or_stars()
            if inner.i < inner.n:
                inner.fail()
        except Unexpected as e:
            inner.report(e)
            faults += inner.faults
    return sorted([*scan.faults, *faults])
