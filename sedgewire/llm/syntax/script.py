"""JavaScript and TypeScript."""

from __future__ import annotations

import re

from sedgewire.llm.syntax.core import CODES, Fault, Parser, Unexpected

# Reserved words, and signs from longest to shortest.
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with enum".split()
)
SIGNS = ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << >> ** { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @ #".split()
_TOKEN = re.compile(
    r"(?P<ws>[ \t\v\f ﻿ - 　]+)|(?P<nl>\r\n|[\n\r  ])|(?P<lc>//[^\n\r  ]*)|(?P<bc>/\*(?:[^*]|\*(?!/))*\*/)|"
    r"(?P<id>(?:[^\W\d]|\$|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:\w|\$|‌|‍|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*)|"
    r"(?P<num>(?:0[xX][0-9a-fA-F](?:_?[0-9a-fA-F])*|0[oO][0-7](?:_?[0-7])*|0[bB][01](?:_?[01])*|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)n?(?![\w$]))|"
    r"(?P<str>\"(?:[^\"\\\n\r]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*')|(?P<tick>`)|"
    r"(?P<sign>\?\.(?!\d)|" + "|".join(re.escape(s) for s in SIGNS if s != "?.") + ")"
)
_REGEX = re.compile(r"/(?![*/])(?:[^\[/\\\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/[\w$]*")
_BEFORE_OPERAND = frozenset("( [ { } ; , < > + - * / % & | ^ ! ~ ? : = == != === !== <= >= && || ?? => ... += -= *= /= %= &= |= ^= &&= ||= ??= **= << >> >>> <<= >>= >>>= ** return typeof case in of delete void throw new else do instanceof await yield extends default".split())
_MARKUP_START = re.compile(r"<(?:>|[A-Za-z_$][\w$.:-]*(?:\s*/?>|\s+[A-Za-z_{][^=;()]*?(?:[=/>]|\s)))")
_MARKUP_NAME = re.compile(r"\s*([A-Za-z_$][\w$.:-]*)")
_MARKUP_ATTR = re.compile(r"\s*(?:([A-Za-z_$][\w$:-]*)\s*(=\s*(?:\"[^\"]*\"|'[^']*'|(?=[{<])))?|(?=\{))")


class Scan:
    """Tokens of a text, with those of template and markup expressions kept apart in ``inner``."""

    def __init__(self, text: str, typed: bool, markup: bool):
        self.text, self.typed, self.markup = text, typed, markup
        self.inner: list[tuple[list[str], list[int], list[bool], int]] = []
        self.faults: list[Fault] = []

    def tokens(self, at: int, nested: bool) -> tuple[list[str], list[int], list[bool], int]:
        """Tokens from ``at`` to the end, or in a nested expression to the brace that closes it."""
        text, match, n = self.text, _TOKEN.match, len(self.text)
        kinds: list[str] = []
        places: list[int] = []
        newlines: list[bool] = []
        fresh, braces = False, 0
        last = ""
        while at < n:
            m = match(text, at)
            if m is None:
                self.faults.append(Fault(at, f"unexpected character {text[at]!r}" if text[at] not in "\"'/" else "unterminated literal"))
                at += 1
                if text[at - 1] in "\"'":
                    while at < n and text[at] not in "\n\r":
                        at += 1
                elif text.startswith("/*", at - 1):
                    at = n
                continue
            group = m.lastgroup
            start, at = at, m.end()
            if group == "ws" or group == "lc":
                continue
            if group == "nl":
                fresh = True
                continue
            if group == "bc":
                fresh = fresh or "\n" in m[0]
                continue
            if group == "sign":
                kind = m[0]
                if kind[0] == "/" and (last in _BEFORE_OPERAND or not last or last == "}"):
                    x = _REGEX.match(text, start)
                    if x:
                        kind, at = "regex", x.end()
                    elif last not in ("}", ")"):
                        self.faults.append(Fault(start, "unterminated regular expression"))
                elif kind == "/" and last == ")" and (x := _REGEX.match(text, start)) and self._condition_before(kinds):
                    kind, at = "regex", x.end()
                elif kind == "<" and self.markup and (last in _BEFORE_OPERAND or not last) and last not in ("}", ">") and (x := _MARKUP_START.match(text, start)):
                    at = self.element(start)
                    kind = "markup"
                elif kind == "{":
                    braces += 1
                elif kind == "}":
                    if nested and not braces:
                        return kinds, places, newlines, start
                    braces -= 1
            elif group == "id":
                kind = m[0] if m[0] in RESERVED or m[0] in _CONTEXTUAL else "id"
                if last in (".", "?."):
                    kind = "id"
            elif group == "num":
                kind = "num"
            elif group == "str":
                kind = "str"
            else:
                kind, at = "tmpl", self.template(at)
            kinds.append(kind)
            places.append(start)
            newlines.append(fresh)
            fresh, last = False, kind
        if nested:
            self.faults.append(Fault(n, "unterminated expression"))
        return kinds, places, newlines, n

    def _condition_before(self, kinds: list[str]) -> bool:
        depth = 0
        for j in range(len(kinds) - 1, -1, -1):
            if kinds[j] == ")":
                depth += 1
            elif kinds[j] == "(":
                depth -= 1
                if not depth:
                    return j > 0 and kinds[j - 1] in ("if", "while", "for", "with")
        return False

    def expression(self, at: int) -> int:
        """An embedded expression from after its brace; returns the place after the closing one."""
        kinds, places, newlines, end = self.tokens(at, True)
        self.inner.append((kinds, places, newlines, end))
        return end + 1

    def template(self, at: int) -> int:
        text, n = self.text, len(self.text)
        while at < n:
            c = text[at]
            if c == "`":
                return at + 1
            if c == "\\":
                at += 2
            elif c == "$" and text.startswith("{", at + 1):
                at = self.expression(at + 2)
            else:
                at += 1
        self.faults.append(Fault(n, "unterminated template"))
        return n

    def element(self, at: int) -> int:
        """A markup element from its first angle bracket; returns the place after it."""
        text, n = self.text, len(self.text)
        m = _MARKUP_NAME.match(text, at + 1)
        name, at = (m[1], m.end()) if m and not text.startswith(">", at + 1) else ("", at + 1)
        if self.typed and text.startswith("<", at):
            at = text.find(">", at) + 1 or n
        while True:  # attributes
            while at < n and text[at].isspace():
                at += 1
            if text.startswith("/>", at):
                return at + 2
            if text.startswith(">", at):
                at += 1
                break
            m = _MARKUP_ATTR.match(text, at)
            if at >= n or not m or m.end() == at and not text.startswith("{", at):
                self.faults.append(Fault(at, "bad markup"))
                return n
            at = m.end()
            if text.startswith("{", at) and (m[2] or not m[1]):
                at = self.expression(at + 1)
            elif m[2] and text.startswith("<", at):
                at = self.element(at)
        while at < n:  # children
            c = text[at]
            if c == "{":
                if re.compile(r"\{\s*(?:/\*(?:[^*]|\*(?!/))*\*/\s*)*\}").match(text, at):
                    at = text.index("}", at) + 1 if "*/" not in text[at : text.index("}", at)] else re.compile(r"\{\s*(?:/\*(?:[^*]|\*(?!/))*\*/\s*)*\}").match(text, at).end()
                    continue
                at = self.expression(at + 1)
            elif c == "<":
                if text.startswith("</", at):
                    m = re.compile(r"</\s*([\w$.:-]*)\s*>").match(text, at)
                    if not m or m[1] != name:
                        self.faults.append(Fault(at, "markup tags don't match"))
                        return m.end() if m else n
                    return m.end()
                at = self.element(at)
            elif c in "}>":
                self.faults.append(Fault(at, f"unexpected {c} in markup"))
                at += 1
            else:
                at += 1
        self.faults.append(Fault(n, "unterminated markup"))
        return n


_CONTEXTUAL = frozenset("async await of get set static let yield as satisfies is asserts infer keyof unique readonly declare abstract public private protected override type interface namespace module global require from implements accessor using out".split())
# Binding strength of binary operators.
BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, ">": 8, "<=": 8, ">=": 8, "instanceof": 8, "in": 8, "as": 8, "satisfies": 8, "<<": 9, ">>": 9, ">>>": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
ASSIGN = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??=".split())
PREFIX = frozenset("! ~ + - typeof void delete".split())
MEMBER_MODIFIERS = frozenset("public private protected static abstract override readonly declare async accessor".split())
_SIMPLE = re.compile("[^;{}]*;")
_HEADER = re.compile("[^;{}]*\\{")
_COMPOUND = frozenset(CODES[k] for k in "if for while do switch try function class interface enum case default else export import async abstract declare namespace module type".split())


class ScriptParser(Parser):
    known: set[str] = set()

    def __init__(self, scan: Scan, kinds, places, newlines, end):
        super().__init__(kinds, places, newlines, end)
        self.typed, self.markup = scan.typed, scan.markup
        self.tag = "T" if scan.typed else "J"
        self.known = _KNOWN[self.tag]
        self.split: list[tuple[int, str]] = []

    def attempt(self, rule) -> bool:
        mark = len(self.split)
        if super().attempt(rule):
            return True
        self.unsplit(mark)
        return False

    def unsplit(self, mark: int) -> None:
        """Put signs together again that a failed rule took for the ends of type arguments."""
        while len(self.split) > mark:
            at, kind = self.split.pop()
            self.k[at] = kind

    # names

    def is_name(self) -> bool:
        k = self.k[self.i]
        return k == "id" or k in _CONTEXTUAL

    def name(self) -> None:
        if not self.is_name():
            self.fail()
        self.i += 1

    def any_name(self) -> None:
        k = self.k[self.i]
        if not (k == "id" or k in _CONTEXTUAL or k in RESERVED):
            self.fail()
        self.i += 1

    # statements

    def end_statement(self) -> None:
        if self.eat(";"):
            return
        k = self.k[self.i]
        if k != "}" and k != "eof" and not self.nl[self.i]:
            self.fail(f"expected ; found {k}")

    def statement(self) -> None:
        codes, i = self.codes, self.i
        c = codes[i : i + 1]
        if c not in _COMPOUND:
            m = _SIMPLE.match(codes, i)
            if m:
                key = m[0]
                if key in self.known:
                    self.i = m.end()
                    return
                self.plain_statement()
                if self.i == m.end() and not any(self.nl[i + 1 : self.i]):
                    self.remember(key)
                return
        elif c in _FUNCTIONAL:
            m = _HEADER.match(codes, i)
            if m:
                key = m[0]
                if key in self.known:
                    self.i = m.end() - 1
                    self.block()
                    return
                self.plain_statement_headed(m.end() - 1, key)
                return
        self.plain_statement()

    def plain_statement_headed(self, brace: int, key: str) -> None:
        before = self.i
        self.plain_statement()
        if self.first_body == brace and not any(self.nl[before + 1 : brace]):
            self.remember(key)

    first_body = -1

    def plain_statement(self) -> None:
        k = self.k[self.i]
        rule = getattr(self, "s_" + k, None) if k in _RULES else None
        if rule is not None and rule() is not False:
            return
        if self.typed and k in _TYPED_RULES and self.typed_declaration(k):
            return
        if k == "{":
            self.block()
        elif k == ";":
            self.i += 1
        elif k == "@":
            self.decorators()
            self.statement()
        elif self.is_name() and self.k[self.i + 1] == ":":
            self.i += 2
            self.statement()
        else:
            self.expression()
            self.end_statement()

    def block(self) -> None:
        self.need("{")
        while self.k[self.i] != "}":
            if self.k[self.i] == "eof":
                self.fail("unclosed block")
            self.statement()
        self.i += 1

    def declarations(self, no_in: bool = False) -> None:
        while True:
            pattern = self.k[self.i] in ("[", "{")
            self.binding()
            if self.typed:
                self.eat("!")
                self.annotation()
            if self.eat("="):
                self.assignment(no_in)
            elif pattern and not no_in:
                self.fail("a pattern needs a value")
            if not self.eat(","):
                return

    def s_var(self):
        self.i += 1
        if self.typed and self.k[self.i] == "enum":
            return self.s_enum()
        self.declarations()
        self.end_statement()

    s_const = s_var

    def s_let(self):
        nxt = self.k[self.i + 1]
        if nxt in ("[", "{") or nxt == "id" or nxt in _CONTEXTUAL:
            return self.s_var()
        return False

    def s_using(self):
        return self.s_var() if self.k[self.i + 1] == "id" and not self.nl[self.i + 1] else False

    def s_await(self):
        if self.k[self.i + 1] == "using" and self.k[self.i + 2] == "id" and not self.nl[self.i + 2]:
            self.i += 1
            return self.s_var()
        return False

    def s_async(self):
        if self.k[self.i + 1] == "function" and not self.nl[self.i + 1]:
            self.i += 1
            return self.s_function()
        return False

    def s_function(self, named: bool = True):
        self.need("function")
        self.eat("*")
        if named or self.is_name():
            self.name()
        self.signature()
        if self.k[self.i] != "{" and self.typed:
            self.end_statement()
            return
        self.first_body = self.i
        body = self.i
        self.block()
        self.first_body = body

    def signature(self) -> None:
        if self.typed:
            self.type_parameters()
        self.parameters()
        if self.typed and self.eat(":"):
            self.return_type()

    def parameters(self) -> None:
        self.need("(")
        while not self.eat(")"):
            if self.k[self.i] == "@":
                self.decorators()
            if self.typed:
                while self.k[self.i] in MEMBER_MODIFIERS and self.k[self.i + 1] not in (",", ")", ":", "=", "?"):
                    self.i += 1
            self.eat("...")
            if self.k[self.i] == "this" and self.typed:
                self.i += 1
            else:
                self.binding()
            if self.typed:
                self.eat("?")
                self.annotation()
            if self.eat("="):
                self.assignment()
            if self.k[self.i] != ")":
                self.need(",")

    def binding(self) -> None:
        if self.eat("["):
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.binding()
                if self.eat("="):
                    self.assignment()
                if self.k[self.i] != "]":
                    self.need(",")
        elif self.eat("{"):
            while not self.eat("}"):
                if self.eat("..."):
                    self.name()
                else:
                    plain = self.is_name()
                    self.property_name()
                    if self.eat(":"):
                        self.binding()
                    elif not plain:
                        self.fail()
                    if self.eat("="):
                        self.assignment()
                if self.k[self.i] != "}":
                    self.need(",")
        else:
            self.name()

    def decorators(self) -> None:
        while self.eat("@"):
            if self.k[self.i] == "(":
                self.i += 1
                self.expression()
                self.need(")")
            else:
                self.any_name()
                while self.eat("."):
                    self.any_name()
                if self.typed and self.k[self.i] == "<":
                    self.attempt(self.type_arguments)
                if self.k[self.i] == "(":
                    self.arguments()

    def s_class(self):
        self.need("class")
        if self.is_name() and self.k[self.i] != "implements":
            self.i += 1
        if self.typed:
            self.type_parameters()
        if self.eat("extends"):
            self.postfix()
            if self.typed and self.k[self.i] == "<":
                self.type_arguments()
        if self.typed and self.eat("implements"):
            self.type()
            while self.eat(","):
                self.type()
        self.need("{")
        while not self.eat("}"):
            if self.k[self.i] == "eof":
                self.fail("unclosed class")
            self.member()

    def member(self) -> None:
        if self.eat(";"):
            return
        if self.k[self.i] == "@":
            self.decorators()
        if self.k[self.i] == "static" and self.k[self.i + 1] == "{":
            self.i += 1
            self.block()
            return
        ends = ("(", "=", ";", "}", ":", "?", "!", "<", ",")
        while self.k[self.i] in MEMBER_MODIFIERS and self.k[self.i + 1] not in ends and not (self.nl[self.i + 1] and self.k[self.i] not in ("static", "public", "private", "protected")):
            if not self.typed and self.k[self.i] not in ("static", "async", "accessor"):
                self.fail()
            self.i += 1
        if self.k[self.i] in ("get", "set") and self.k[self.i + 1] not in ends and not self.nl[self.i + 1]:
            self.i += 1
        self.eat("*")
        if self.typed and self.k[self.i] == "[" and self.k[self.i + 1] in ("id", *_CONTEXTUAL) and self.k[self.i + 2] == ":":
            self.i += 2
            self.annotation()
            self.need("]")
            self.annotation()
            self.end_statement()
            return
        self.property_name()
        if self.typed and not self.eat("?"):
            self.eat("!")
        if self.k[self.i] in ("(", "<"):
            self.signature()
            if self.k[self.i] == "{":
                self.block()
            elif self.typed:
                self.end_statement()
            else:
                self.fail()
            return
        if self.typed:
            self.annotation()
        if self.eat("="):
            self.assignment()
        self.end_statement()

    def property_name(self) -> None:
        k = self.k[self.i]
        if k in ("str", "num"):
            self.i += 1
        elif k == "[":
            self.i += 1
            self.assignment()
            self.need("]")
        elif k == "#":
            self.i += 1
            self.any_name()
        else:
            self.any_name()

    def condition(self) -> None:
        at = self.i
        end = self.close.get(at)
        key = "(" + self.codes[at : end + 1] if end is not None and self.k[at] == "(" else None
        if key is not None and key in self.known:
            self.i = end + 1
            return
        self.need("(")
        self.expression()
        self.need(")")
        if key is not None and self.i == end + 1 and "{" not in key:
            self.remember(key)

    def s_if(self):
        self.i += 1
        self.condition()
        self.statement()
        if self.eat("else"):
            self.statement()

    def s_while(self):
        self.i += 1
        self.condition()
        self.statement()

    s_with = s_while

    def s_do(self):
        self.i += 1
        self.statement()
        self.need("while")
        self.condition()
        self.eat(";")

    def s_for(self):
        self.i += 1
        self.eat("await")
        at, end = self.i, self.close.get(self.i)
        key = "f" + self.codes[at : end + 1] if end is not None else None
        if key is not None and key in self.known:
            self.i = end + 1
        else:
            self.need("(")
            if self.k[self.i] in ("var", "let", "const", "using") and self.k[self.i + 1] not in ("in", "of", ";", "="):
                self.i += 1
                self.declarations(no_in=True)
            elif self.k[self.i] != ";":
                self.expression(no_in=True)
            if self.k[self.i] in ("of", "in"):
                self.i += 1
                self.expression()
            else:
                self.need(";")
                if self.k[self.i] != ";":
                    self.expression()
                self.need(";")
                if self.k[self.i] != ")":
                    self.expression()
            self.need(")")
            if key is not None and self.i == end + 1 and "{" not in key:
                self.remember(key)
        self.statement()

    def s_switch(self):
        self.i += 1
        self.condition()
        self.need("{")
        while not self.eat("}"):
            if self.eat("case"):
                self.expression()
                self.need(":")
            elif self.eat("default"):
                self.need(":")
            else:
                self.fail()
            while self.k[self.i] not in ("case", "default", "}"):
                if self.k[self.i] == "eof":
                    self.fail("unclosed switch")
                self.statement()

    def s_try(self):
        self.i += 1
        self.block()
        caught = self.eat("catch")
        if caught:
            if self.eat("("):
                self.binding()
                if self.typed:
                    self.annotation()
                self.need(")")
            self.block()
        if self.eat("finally"):
            self.block()
        elif not caught:
            self.fail("try without catch")

    def s_return(self):
        self.i += 1
        if self.k[self.i] not in (";", "}", "eof") and not self.nl[self.i]:
            self.expression()
        self.end_statement()

    def s_throw(self):
        self.i += 1
        if self.nl[self.i]:
            self.fail()
        self.expression()
        self.end_statement()

    def s_break(self):
        self.i += 1
        if self.is_name() and not self.nl[self.i]:
            self.i += 1
        self.end_statement()

    s_continue = s_break

    def s_debugger(self):
        self.i += 1
        self.end_statement()

    def s_import(self):
        if self.k[self.i + 1] in ("(", "."):
            return False
        self.i += 1
        if self.eat("str"):
            self.import_attributes()
            self.end_statement()
            return
        if self.typed and self.k[self.i] == "type" and self.k[self.i + 1] not in ("from", ",", "="):
            self.i += 1
        if self.is_name():
            self.i += 1
            if self.typed and self.eat("="):
                if self.eat("require"):
                    self.arguments()
                else:
                    self.qualified()
                self.end_statement()
                return
            if not self.eat(","):
                self.need("from")
                self.need("str")
                self.import_attributes()
                self.end_statement()
                return
        if self.eat("*"):
            self.need("as")
            self.name()
        else:
            self.specifiers()
        self.need("from")
        self.need("str")
        self.import_attributes()
        self.end_statement()

    def import_attributes(self) -> None:
        if self.k[self.i] == "with" and self.k[self.i + 1] == "{":
            self.i += 1
            self.primary()

    def specifiers(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.typed and self.k[self.i] == "type" and self.k[self.i + 1] not in (",", "}", "as"):
                self.i += 1
            if not self.eat("str"):
                self.any_name()
            if self.eat("as") and not self.eat("str"):
                self.any_name()
            if self.k[self.i] != "}":
                self.need(",")

    def s_export(self):
        self.i += 1
        if self.eat("default"):
            if self.k[self.i] == "@":
                self.decorators()
            if self.k[self.i] == "async" and self.k[self.i + 1] == "function":
                self.i += 1
            if self.k[self.i] == "function":
                self.s_function(named=False)
            elif self.k[self.i] == "class" or self.typed and self.k[self.i] == "abstract":
                self.eat("abstract")
                self.s_class()
            elif self.typed and self.k[self.i] == "interface":
                self.typed_declaration("interface")
            else:
                self.assignment()
                self.end_statement()
            return
        if self.typed and self.eat("="):
            self.expression()
            self.end_statement()
            return
        if self.typed and self.k[self.i] == "as" and self.k[self.i + 1] == "namespace":
            self.i += 2
            self.name()
            self.end_statement()
            return
        if self.typed and self.k[self.i] == "type" and self.k[self.i + 1] in ("{", "*"):
            self.i += 1
        if self.eat("*"):
            if self.eat("as") and not self.eat("str"):
                self.any_name()
            self.need("from")
            self.need("str")
            self.import_attributes()
            self.end_statement()
        elif self.k[self.i] == "{":
            self.specifiers()
            if self.eat("from"):
                self.need("str")
                self.import_attributes()
            self.end_statement()
        elif self.k[self.i] in ("var", "let", "const", "function", "class", "async", "@", "import", "using") or self.typed and self.k[self.i] in _TYPED_RULES:
            self.plain_statement()
        else:
            self.fail()

    def s_enum(self):
        if not self.typed:
            self.fail()
        self.need("enum")
        self.name()
        self.need("{")
        while not self.eat("}"):
            self.property_name()
            if self.eat("="):
                self.assignment()
            if self.k[self.i] != "}":
                self.need(",")

    def typed_declaration(self, k: str) -> bool:
        nxt = self.k[self.i + 1]
        named = (nxt == "id" or nxt in _CONTEXTUAL) and not self.nl[self.i + 1]
        if k == "interface" and named:
            self.i += 2
            self.type_parameters()
            if self.eat("extends"):
                self.type()
                while self.eat(","):
                    self.type()
            self.type_members()
            return True
        if k == "type" and named:
            self.i += 2
            self.type_parameters()
            self.need("=")
            self.type()
            self.end_statement()
            return True
        if k in ("namespace", "module") and (named or nxt == "str"):
            self.i += 1
            if not self.eat("str"):
                self.qualified()
            if self.k[self.i] == "{":
                self.block()
            else:
                self.end_statement()
            return True
        if k == "abstract" and nxt == "class":
            self.i += 1
            self.s_class()
            return True
        if k == "declare" and not self.nl[self.i + 1] and (nxt in ("var", "let", "const", "function", "class", "abstract", "enum", "namespace", "module", "type", "interface", "global", "async")):
            self.i += 1
            if self.eat("global"):
                self.block()
            else:
                self.plain_statement()
            return True
        if k == "global" and nxt == "{":
            self.i += 1
            self.block()
            return True
        return False

    # expressions

    def expression(self, no_in: bool = False) -> None:
        self.assignment(no_in)
        while self.eat(","):
            self.assignment(no_in)

    def arrow_ahead(self) -> bool:
        end = self.close.get(self.i)
        if end is None:
            return False
        return self.k[end + 1] == "=>" or self.typed and self.k[end + 1] == ":"

    def arrow(self) -> None:
        if self.typed:
            self.type_parameters()
        if self.k[self.i] == "(":
            self.parameters()
            if self.typed and self.eat(":"):
                self.return_type()
        else:
            self.name()
        if self.nl[self.i]:
            self.fail()
        self.need("=>")

    def arrow_body(self, no_in: bool) -> None:
        if self.k[self.i] == "{":
            self.block()
        else:
            self.assignment(no_in)

    def assignment(self, no_in: bool = False) -> None:
        k = self.k[self.i]
        start = self.i
        if k == "async" and not self.nl[self.i + 1] and (self.k[self.i + 1] == "(" or (self.k[self.i + 1] == "id" or self.k[self.i + 1] in _CONTEXTUAL) and self.k[self.i + 2] == "=>" or self.typed and self.k[self.i + 1] == "<"):
            self.i += 1
            if self.k[self.i] != "(" or self.arrow_ahead():
                if self.attempt(self.arrow):
                    self.arrow_body(no_in)
                    return
            self.i = start
        elif (self.is_name() and self.k[self.i + 1] == "=>") or (k == "(" and self.arrow_ahead()) or (k == "<" and self.typed):
            if self.attempt(self.arrow):
                self.arrow_body(no_in)
                return
        if k == "yield" and self.k[self.i + 1] not in ("=>", ".", "=", "?.", "["):
            self.i += 1
            if not self.nl[self.i] and self.k[self.i] not in (")", "]", "}", ",", ";", ":", "eof", "in", "of"):
                self.eat("*")
                self.assignment(no_in)
            return
        target = self.binary(0, no_in)
        if self.eat("?"):
            self.assignment()
            self.need(":")
            self.assignment(no_in)
        elif self.k[self.i] in ASSIGN:
            if not target or self.k[self.i] != "=" and target == "pattern":
                self.fail("not a target of an assignment")
            self.i += 1
            self.assignment(no_in)

    def binary(self, least: int, no_in: bool):
        target = self.unary()
        while True:
            op = self.k[self.i]
            strength = BINARY.get(op)
            if strength is None or strength <= least and op != "**" or op == "**" and strength < least or op == "in" and no_in:
                return target
            if op in ("as", "satisfies"):
                if not self.typed or self.nl[self.i]:
                    return target
                self.i += 1
                self.type()
                target = target or "cast"
                continue
            self.i += 1
            self.binary(strength if op != "**" else strength - 1, no_in)
            target = None

    def unary(self):
        k = self.k[self.i]
        if k in PREFIX:
            self.i += 1
            self.unary()
            return None
        if k == "await" and self.k[self.i + 1] not in (")", "]", "}", ",", ";", "=", ".", "=>", ":", "eof", "in", "of", "?"):
            self.i += 1
            self.unary()
            return None
        if k in ("++", "--"):
            self.i += 1
            if not self.unary():
                self.fail("not a target")
            return None
        if k == "<" and self.typed and not self.markup:
            self.i += 1
            self.type()
            self.need(">")
            self.unary()
            return None
        if k == "#":
            self.i += 1
            self.any_name()
            if self.k[self.i] != "in":
                self.fail()
            return None
        target = self.postfix()
        if self.k[self.i] in ("++", "--") and not self.nl[self.i]:
            if not target or target == "pattern":
                self.fail("not a target")
            self.i += 1
            return None
        return target

    def postfix(self):
        if self.k[self.i] == "new":
            self.i += 1
            if self.eat("."):
                self.any_name()
            else:
                self.new_target()
            target = None
        else:
            target = self.primary()
        return self.suffixes(target, True)

    def new_target(self) -> None:
        if self.k[self.i] == "new":
            self.i += 1
            self.new_target()
        else:
            self.primary()
        self.suffixes(None, False)
        if self.typed and self.k[self.i] == "<":
            self.attempt(self.type_arguments)
        if self.k[self.i] == "(":
            self.arguments()

    def suffixes(self, target, calls: bool):
        while True:
            k = self.k[self.i]
            if k == ".":
                self.i += 1
                self.eat("#")
                self.any_name()
                target = "member"
            elif k == "?." and calls:
                self.i += 1
                if self.k[self.i] == "(":
                    self.arguments()
                elif self.eat("["):
                    self.expression()
                    self.need("]")
                elif self.k[self.i] != "tmpl":
                    self.eat("#")
                    self.any_name()
                target = None
            elif k == "[":
                self.i += 1
                self.expression()
                self.need("]")
                target = "member"
            elif k == "(" and calls:
                self.arguments()
                target = None
            elif k == "tmpl":
                self.i += 1
                target = None
            elif k == "!" and self.typed and not self.nl[self.i] and self.k[self.i + 1] != "=":
                self.i += 1
            elif k == "<" and self.typed and calls:
                at, mark = self.i, len(self.split)
                if not (self.attempt(self.type_arguments) and self.k[self.i] in ("(", "tmpl", ")", "]", ",", ";", ":", "}", "eof", "?.", "==", "===", "!=", "!==", "&&", "||", "??")):
                    self.i = at
                    self.unsplit(mark)
                    return target
                target = None
            else:
                return target

    def arguments(self) -> None:
        self.need("(")
        while not self.eat(")"):
            self.eat("...")
            self.assignment()
            if self.k[self.i] != ")":
                self.need(",")

    def primary(self):
        k = self.k[self.i]
        if k in ("num", "str", "tmpl", "regex", "markup", "null", "true", "false"):
            self.i += 1
            return None
        if k == "(":
            self.i += 1
            at = self.i
            self.expression()
            self.need(")")
            return "member" if self.i - at > 1 and self.k[self.i - 2] in ("id", "]") else None
        if k == "[":
            self.i += 1
            while not self.eat("]"):
                if self.eat(","):
                    continue
                self.eat("...")
                self.assignment()
                if self.k[self.i] != "]":
                    self.need(",")
            return "pattern"
        if k == "{":
            self.object()
            return "pattern"
        if k == "function" or k == "async" and self.k[self.i + 1] == "function" and not self.nl[self.i + 1]:
            self.eat("async")
            self.s_function(named=False)
            return None
        if k in ("class", "@"):
            self.decorators()
            self.s_class()
            return None
        if k in ("this", "super"):
            self.i += 1
            return None
        if k == "import":
            self.i += 1
            if self.eat("."):
                self.any_name()
            if self.k[self.i] == "(":
                self.arguments()
            return None
        self.name()
        return "name"

    def object(self) -> None:
        self.need("{")
        ends = (",", "}", "(", ":", "=", "<")
        while not self.eat("}"):
            if self.eat("..."):
                self.assignment()
            else:
                plain = self.is_name()
                method = False
                if self.k[self.i] == "async" and self.k[self.i + 1] not in ends:
                    self.i += 1
                    method = True
                if self.eat("*"):
                    method = True
                if self.k[self.i] in ("get", "set") and self.k[self.i + 1] not in ends:
                    self.i += 1
                    method = True
                self.property_name()
                if self.k[self.i] == "(" or self.k[self.i] == "<" and self.typed:
                    self.signature()
                    self.block()
                elif method:
                    self.fail()
                elif self.eat(":"):
                    self.assignment()
                elif not plain:
                    self.fail()
                elif self.eat("="):
                    self.assignment()
            if self.k[self.i] != "}":
                self.need(",")

    # types

    def annotation(self) -> None:
        if self.eat(":"):
            self.type()

    def return_type(self) -> None:
        if self.k[self.i] == "asserts" and (self.k[self.i + 1] in ("id", "this")):
            self.i += 2
            if self.eat("is"):
                self.type()
            return
        if (self.is_name() or self.k[self.i] == "this") and self.k[self.i + 1] == "is" and not self.nl[self.i + 1]:
            self.i += 2
        self.type()

    def type_parameters(self) -> None:
        if not self.eat("<"):
            return
        while True:
            while self.k[self.i] in ("const", "in", "out") and self.k[self.i + 1] not in (",", ">", "extends", "="):
                self.i += 1
            self.name()
            if self.eat("extends"):
                self.type()
            if self.eat("="):
                self.type()
            if not self.eat(",") or self.k[self.i] == ">":
                break
        self.close_angle()

    def type_arguments(self) -> None:
        self.need("<")
        self.type()
        while self.eat(","):
            self.type()
        self.close_angle()

    def close_angle(self) -> None:
        k = self.k[self.i]
        if k == ">":
            self.i += 1
        elif k[:1] == ">" and len(k) > 1:  # part of >> or >= and the like
            self.split.append((self.i, k))
            self.k[self.i] = k[1:]
        else:
            self.fail()

    def qualified(self) -> None:
        self.any_name()
        while self.eat("."):
            self.any_name()

    def type(self) -> None:
        if self.k[self.i] == "<" or self.k[self.i] == "new" or self.k[self.i] == "abstract" and self.k[self.i + 1] == "new":
            self.eat("abstract")
            self.eat("new")
            self.type_parameters()
            self.parameters()
            self.need("=>")
            self.return_type()
            return
        if self.k[self.i] == "(" and (end := self.close.get(self.i)) is not None and self.k[end + 1] == "=>" and self.attempt(self.function_type):
            return
        self.eat("|")
        self.intersection()
        while self.eat("|"):
            self.intersection()
        if self.k[self.i] == "extends" and not self.nl[self.i]:
            at = self.i
            self.i += 1
            self.type()
            if self.eat("?"):
                self.type()
                self.need(":")
                self.type()
            else:
                self.i = at

    def function_type(self) -> None:
        self.parameters()
        self.need("=>")
        self.return_type()

    def intersection(self) -> None:
        self.eat("&")
        self.type_operand()
        while self.eat("&"):
            self.type_operand()

    def type_operand(self) -> None:
        k = self.k[self.i]
        if k in ("keyof", "unique", "readonly", "infer") and self.k[self.i + 1] not in (",", ">", ")", "]", ";", "|", "&", "=", ".", "}") and (k in ("readonly", "keyof") or self.k[self.i + 1] != "["):
            self.i += 1
            self.type_operand()
            if k == "infer" and self.k[self.i] == "extends":
                self.attempt(self.infer_bound)
            return
        if k in ("str", "num", "null", "true", "false", "this", "void", "tmpl", "const"):
            self.i += 1
        elif k == "-":
            self.i += 1
            self.need("num")
        elif k == "typeof":
            self.i += 1
            if self.k[self.i] == "import":
                return self.type_operand()
            self.qualified()
            if self.k[self.i] == "<" and not self.nl[self.i]:
                self.type_arguments()
        elif k == "import":
            self.i += 1
            self.arguments()
            while self.eat("."):
                self.any_name()
            if self.k[self.i] == "<":
                self.type_arguments()
        elif k == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif k == "[":
            self.i += 1
            while not self.eat("]"):
                self.eat("...")
                if self.is_name() and (self.k[self.i + 1] == ":" or self.k[self.i + 1] == "?" and self.k[self.i + 2] == ":"):
                    self.i += 1
                    self.eat("?")
                    self.need(":")
                self.type()
                self.eat("?")
                if self.k[self.i] != "]":
                    self.need(",")
        elif k == "{":
            self.type_members()
        elif k == "id" or k in _CONTEXTUAL:
            self.qualified()
            if self.k[self.i] == "<" and not self.nl[self.i]:
                self.type_arguments()
        else:
            self.fail()
        while self.k[self.i] == "[" and not self.nl[self.i]:
            self.i += 1
            if not self.eat("]"):
                self.type()
                self.need("]")

    def infer_bound(self) -> None:
        self.need("extends")
        self.type_operand()

    def type_members(self) -> None:
        self.need("{")
        ends = (",", ";", "}", "(", ":", "?", "<")
        while not self.eat("}"):
            if self.k[self.i] in ("+", "-"):
                self.i += 1
            if self.k[self.i] == "readonly" and self.k[self.i + 1] not in ends:
                self.i += 1
            if self.k[self.i] == "new" and self.k[self.i + 1] in ("(", "<"):
                self.i += 1
            elif self.k[self.i] in ("get", "set") and self.k[self.i + 1] not in ends:
                self.i += 1
                self.property_name()
            elif self.k[self.i] == "[" and (self.k[self.i + 1] == "id" or self.k[self.i + 1] in _CONTEXTUAL) and self.k[self.i + 2] in (":", "in"):
                self.i += 2
                if self.eat("in"):
                    self.type()
                    if self.eat("as"):
                        self.type()
                else:
                    self.annotation()
                self.need("]")
                if self.k[self.i] in ("+", "-"):
                    self.i += 1
            elif self.k[self.i] not in ("(", "<"):
                self.property_name()
            self.eat("?")
            if self.k[self.i] in ("(", "<"):
                self.signature()
            else:
                self.annotation()
            if not (self.eat(",") or self.eat(";")) and self.k[self.i] != "}" and not self.nl[self.i]:
                self.fail()

    # recovery

    def skip(self) -> None:
        """To after the next ; or } that the failed statement can have ended with, or to a line that begins with a keyword."""
        while self.i < self.n:
            k = self.k[self.i]
            self.i += 1
            if k in (";", "}") or self.nl[self.i] and self.k[self.i] in _RULES:
                return


_KNOWN: dict[str, set[str]] = {"T": set(), "J": set()}
_RULES = frozenset(x[2:] for x in dir(ScriptParser) if x.startswith("s_"))
_TYPED_RULES = frozenset("interface type namespace module abstract declare global enum".split())
_FUNCTIONAL = frozenset(CODES[k] for k in "function async export".split())


def check_script(text: str, typed: bool, markup: bool) -> list[Fault]:
    """Errors of a module or script; ``typed`` allows types, ``markup`` elements in expressions."""
    if text.startswith("#!"):
        text = re.sub(r"^#![^\n]*", "", text)
    scan = Scan(text, typed, markup)
    tokens = scan.tokens(0, False)
    parser = ScriptParser(scan, *tokens)
    faults = parser.run(parser.statement, parser.skip, lambda: parser.i >= parser.n)
    for part in scan.inner:
        inner = ScriptParser(scan, *part)
        try:
            if inner.n and inner.k[0] == "...":
                inner.i = 1
            inner.expression()
            if inner.i < inner.n:
                inner.fail()
        except Unexpected as e:
            inner.i = 0
            if not (typed and inner.attempt(inner.type) and inner.i == inner.n):  # a template may be a type
                inner.report(e)
        except RecursionError:
            inner.report(Unexpected(0, "nested too deeply"))
        faults += inner.faults
    return sorted([*scan.faults, *faults])
