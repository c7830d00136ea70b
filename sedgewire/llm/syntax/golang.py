"""Go."""

from __future__ import annotations

import re

from sedgewire.llm.syntax.core import CODES, Fault, Parser, Unexpected

# Reserved words, and signs from longest to shortest.
RESERVED = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
SIGNS = "<<= >>= &^= ... << >> &^ += -= *= /= %= &= |= ^= && || <- ++ -- == != <= >= := + - * / % & | ^ < > = ! ( ) [ ] { } , ; . : ~".split()
_TOKEN = re.compile(
    r"(?P<ws>[ \t\r]+)|(?P<nl>\n)|(?P<lc>//[^\n]*)|(?P<bc>/\*(?:[^*]|\*(?!/))*\*/)|(?P<id>[^\W\d]\w*)|"
    r"(?P<num>(?:0[xX](?:_?[0-9a-fA-F])*(?:\.(?:[0-9a-fA-F](?:_?[0-9a-fA-F])*)?)?(?:[pP][+-]?\d(?:_?\d)*)?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)i?(?!\w))|"
    r"(?P<str>\"(?:[^\"\\\n]|\\(?:[abfnrtv\\\"]|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))*\"|`[^`]*`|'(?:[^'\\\n]|\\(?:[abfnrtv\\']|[0-7]{3}|x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}))')|"
    r"(?P<sign>" + "|".join(re.escape(s) for s in SIGNS) + ")"
)
_ENDS = frozenset("id num str break continue fallthrough return ++ -- ) ] }".split())
# Binding strength of binary operators.
BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())
_SIMPLE = re.compile("[^;{}]*;")
_HEADER = re.compile("[^{}]*\\{")
_PLAIN_HEADS = frozenset(CODES[k] for k in "id * & ( <- return defer go num str".split())
_HEADED = frozenset(CODES[k] for k in "if for switch func".split())
_KNOWN: set[str] = set()


def tokens(text: str) -> tuple[list[str], list[int], list[Fault]]:
    """Tokens with the semicolons that line ends stand for."""
    kinds: list[str] = []
    places: list[int] = []
    faults: list[Fault] = []
    at, n, last = 0, len(text), ""
    while at < n:
        m = _TOKEN.match(text, at)
        if m is None:
            faults.append(Fault(at, "unterminated literal" if text[at] in "\"'`/" else f"unexpected character {text[at]!r}"))
            stop = n if text[at] == "`" or text.startswith("/*", at) else text.find("\n", at)
            at = n if stop < 0 else stop
            last = "bad"
            continue
        group = m.lastgroup
        start, at = at, m.end()
        if group in ("ws", "lc"):
            continue
        if group == "nl" or group == "bc":
            if last in _ENDS and "\n" in m[0]:
                kinds.append(";")
                places.append(start)
                last = ";"
            continue
        kind = m[0] if group == "sign" or group == "id" and m[0] in RESERVED else group
        kinds.append(kind)
        places.append(start)
        last = kind
    if last in _ENDS:
        kinds.append(";")
        places.append(n)
    return kinds, places, faults


class GoParser(Parser):
    known = _KNOWN
    #: Below 0 a brace after an operand begins a block, not a literal.
    level = 0

    def context(self) -> int:
        return self.level

    def restore(self, context: int) -> None:
        self.level = context

    def file_item(self) -> None:
        if self.i == 0:
            while self.eat(";"):
                pass
            self.need("package")
            self.need("id")
            self.need(";")
            while self.eat("import"):
                self.group(self.import_spec)
                self.semicolon()
            return
        k = self.k[self.i]
        if k == "func":
            self.function()
        elif k in ("var", "const", "type"):
            self.declaration()
        elif k == "import":
            self.fail("import after declarations")
        elif k == ";":
            self.i += 1
            return
        else:
            self.fail()
        self.semicolon()

    def semicolon(self) -> None:
        if self.k[self.i] not in (")", "}", "eof"):
            self.need(";")

    def group(self, spec) -> None:
        if self.eat("("):
            while not self.eat(")"):
                spec()
                if self.k[self.i] != ")":
                    self.need(";")
        else:
            spec()

    def import_spec(self) -> None:
        if not self.eat("."):
            self.eat("id")
        self.need("str")

    def declaration(self) -> None:
        k = self.k[self.i]
        self.i += 1
        self.group({"var": self.value_spec, "const": self.const_spec, "type": self.type_spec}[k])

    def value_spec(self) -> None:
        self.names()
        if self.eat("="):
            self.expressions()
            return
        self.type()
        if self.eat("="):
            self.expressions()

    def const_spec(self) -> None:
        self.names()
        if self.k[self.i] in (";", ")"):
            return
        if self.k[self.i] != "=":
            self.type()
        self.need("=")
        self.expressions()

    def type_spec(self) -> None:
        self.need("id")
        if self.k[self.i] == "[" and self.k[self.i + 1] == "id" and self.k[self.i + 2] != "]":
            at = self.i
            if not self.attempt(self.type_parameters_then_type):
                self.i = at
                self.type()
            return
        self.eat("=")
        self.type()

    def type_parameters_then_type(self) -> None:
        self.type_parameters()
        self.eat("=")
        self.type()

    def type_parameters(self) -> None:
        self.need("[")
        while not self.eat("]"):
            self.names()
            self.constraint()
            if self.k[self.i] != "]":
                self.need(",")

    def constraint(self) -> None:
        while True:
            self.eat("~")
            self.type()
            if not self.eat("|"):
                return

    def names(self) -> None:
        self.need("id")
        while self.eat(","):
            self.need("id")

    def function(self) -> None:
        codes, i = self.codes, self.i
        m = _HEADER.match(codes, i)
        if m and m[0] in self.known:
            self.i = m.end() - 1
            self.block()
            return
        self.need("func")
        if self.k[self.i] == "(":
            self.parameters()
        self.need("id")
        if self.k[self.i] == "[":
            self.type_parameters()
        self.signature()
        if self.k[self.i] == "{":
            if m and self.i == m.end() - 1:
                self.remember(m[0])
            self.block()

    def signature(self) -> None:
        self.parameters()
        if self.k[self.i] == "(":
            self.parameters()
        elif self.k[self.i] in ("id", "*", "[", "map", "chan", "func", "struct", "interface", "<-"):
            self.type()

    def parameters(self) -> None:
        self.need("(")
        while not self.eat(")"):
            self.parameter()
            if self.k[self.i] != ")":
                self.need(",")

    def parameter(self) -> None:
        if self.eat("..."):
            self.type()
            return
        if self.k[self.i] == "id" and self.k[self.i + 1] not in (",", ")", ".", "["):
            self.i += 1
            self.eat("...")
            self.type()
            return
        if self.k[self.i] == "id" and self.k[self.i + 1] == "[":
            if self.attempt(self.named_parameter):
                return
        self.type()
        if self.eat("..."):
            self.type()

    def named_parameter(self) -> None:
        self.need("id")
        self.type()
        if self.k[self.i] not in (",", ")"):
            self.fail()

    def type(self) -> None:
        k = self.k[self.i]
        if k == "id":
            self.i += 1
            if self.eat("."):
                self.need("id")
            if self.k[self.i] == "[" and self.k[self.i + 1] != "]":
                self.attempt(self.type_arguments)
        elif k == "*":
            self.i += 1
            self.type()
        elif k == "(":
            self.i += 1
            self.type()
            self.need(")")
        elif k == "[":
            self.i += 1
            if not self.eat("]"):
                if not self.eat("..."):
                    level, self.level = self.level, 1
                    self.expression()
                    self.level = level
                self.need("]")
            self.type()
        elif k == "map":
            self.i += 1
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif k == "chan":
            self.i += 1
            self.eat("<-")
            self.type()
        elif k == "<-":
            self.i += 1
            self.need("chan")
            self.type()
        elif k == "func":
            self.i += 1
            self.signature()
        elif k == "struct":
            self.i += 1
            self.need("{")
            while not self.eat("}"):
                self.field()
                self.eat("str")
                self.semicolon()
        elif k == "interface":
            self.i += 1
            self.need("{")
            while not self.eat("}"):
                if self.k[self.i] == "id" and self.k[self.i + 1] == "(":
                    self.i += 1
                    self.signature()
                else:
                    self.constraint()
                self.semicolon()
        else:
            self.fail()

    def type_arguments(self) -> None:
        self.need("[")
        self.type()
        while self.eat(","):
            if self.k[self.i] == "]":
                break
            self.type()
        self.need("]")

    def field(self) -> None:
        if self.k[self.i] == "id" and self.k[self.i + 1] not in (";", "}", ".", "str"):
            if self.k[self.i + 1] == "[" and self.attempt(self.embedded):
                return
            self.names()
            self.type()
        else:
            self.embedded()

    def embedded(self) -> None:
        self.eat("*")
        self.type()
        if self.k[self.i] not in (";", "}", "str"):
            self.fail()

    # statements

    def block(self) -> None:
        level, self.level = self.level, 0
        self.need("{")
        self.statements()
        self.need("}")
        self.level = level

    def statements(self) -> None:
        while self.k[self.i] not in ("}", "case", "default"):
            if self.k[self.i] == "eof":
                self.fail("unclosed block")
            self.statement()
            self.semicolon()

    def statement(self) -> None:
        codes, i = self.codes, self.i
        c = codes[i : i + 1]
        m = None
        if c in _PLAIN_HEADS:
            m = _SIMPLE.match(codes, i)
            if m:
                if m[0] in self.known:
                    self.i = m.end() - 1
                    return
        elif c in _HEADED:
            m = _HEADER.match(codes, i)
            if m and m[0] in self.known:
                self.i = m.end() - 1
                if c == CODES["switch"]:
                    self.cases()
                else:
                    self.block()
                    if c == CODES["if"]:
                        self.otherwise()
                return
        self.header_end = -1
        self.plain()
        if m and (self.i == m.end() - 1 and c in _PLAIN_HEADS):
            self.remember(m[0])

    def plain(self) -> None:
        k = self.k[self.i]
        if k in ("var", "const", "type"):
            self.declaration()
        elif k == "{":
            self.block()
        elif k == "if":
            self.if_()
        elif k == "for":
            self.for_()
        elif k == "switch":
            self.switch()
        elif k == "select":
            self.i += 1
            self.cases(select=True)
        elif k == "return":
            self.i += 1
            if self.k[self.i] not in (";", "}"):
                self.expressions()
        elif k in ("break", "continue", "goto"):
            self.i += 1
            self.eat("id")
        elif k == "fallthrough":
            self.i += 1
        elif k in ("go", "defer"):
            self.i += 1
            self.expression()
            if self.k[self.i - 1] != ")":
                self.fail("call expected")
        elif k in (";",):
            return
        elif k == "func" and self.k[self.i + 1] == "id":
            self.fail("function inside a function")
        elif k == "id" and self.k[self.i + 1] == ":" and self.level >= 0:
            self.i += 2
            if self.k[self.i] != "}":
                self.eat(";")
                if self.k[self.i] not in ("}", "case", "default"):
                    self.statement()
        else:
            self.simple()

    def simple(self, ranged: bool = False) -> bool:
        """A simple statement; True if it was a range clause."""
        if ranged and self.eat("range"):
            self.expression()
            return True
        self.expressions()
        k = self.k[self.i]
        if k in ASSIGN:
            self.i += 1
            if ranged and k in ("=", ":=") and self.eat("range"):
                self.expression()
                return True
            self.expressions()
        elif k in ("++", "--"):
            self.i += 1
        elif k == "<-":
            self.i += 1
            self.expression()
        return False

    def header(self, start: int) -> None:
        m = _HEADER.match(self.codes, start)
        if m and self.i == m.end() - 1:
            self.remember(m[0])

    def if_(self) -> None:
        start = self.i
        self.i += 1
        level, self.level = self.level, -1
        if self.k[self.i] == "{":
            self.fail("condition missing")
        if self.k[self.i] != ";":
            self.simple()
        if self.eat(";"):
            if self.k[self.i] == "{":
                self.fail("condition missing")
            self.simple()
        self.level = level
        if self.k[self.i] == "{":
            self.header(start)
        self.block()
        self.otherwise()

    def otherwise(self) -> None:
        if self.eat("else"):
            if self.k[self.i] == "if":
                self.if_()
            else:
                self.block()

    def for_(self) -> None:
        start = self.i
        self.i += 1
        level, self.level = self.level, -1
        if self.k[self.i] != "{":
            ranged = self.k[self.i] != ";" and self.simple(ranged=True)
            if not ranged and self.eat(";"):
                if self.k[self.i] != ";":
                    if self.k[self.i] == "{":
                        self.fail("expected for loop condition")
                    self.simple()
                self.need(";")
                if self.k[self.i] != "{":
                    self.simple()
        self.level = level
        if self.k[self.i] == "{":
            self.header(start)
        self.block()

    def switch(self) -> None:
        start = self.i
        self.i += 1
        level, self.level = self.level, -1
        if self.k[self.i] != "{":
            if self.k[self.i] != ";":
                self.simple()
            if self.eat(";") and self.k[self.i] != "{":
                self.simple()
        self.level = level
        if self.k[self.i] == "{":
            self.header(start)
        self.cases()

    def cases(self, select: bool = False) -> None:
        level, self.level = self.level, 0
        self.need("{")
        while not self.eat("}"):
            if self.eat("case"):
                if select:
                    self.simple()
                else:
                    self.case_item()
                    while self.eat(","):
                        self.case_item()
            else:
                self.need("default")
            self.need(":")
            self.statements()
        self.level = level

    def case_item(self) -> None:
        at = self.i
        if self.attempt(self.expression) and self.k[self.i] in (",", ":"):
            return
        self.i = at
        self.type()

    # expressions

    def expressions(self) -> None:
        self.expression()
        while self.eat(","):
            self.expression()

    def expression(self) -> None:
        self.binary(0)

    def binary(self, least: int) -> None:
        self.unary()
        while (strength := BINARY.get(self.k[self.i], 0)) > least:
            self.i += 1
            self.binary(strength)

    def unary(self) -> None:
        k = self.k[self.i]
        if k == "<-" and self.k[self.i + 1] == "chan":
            self.type()
            self.suffixes(True)
        elif k in ("+", "-", "!", "^", "*", "&", "<-", "~"):
            self.i += 1
            self.unary()
        else:
            self.suffixes(self.operand())

    def operand(self) -> bool:
        """An operand; True if a literal's braces may follow."""
        k = self.k[self.i]
        if k in ("num", "str"):
            self.i += 1
            return False
        if k == "id":
            self.i += 1
            return True
        if k == "(":
            self.i += 1
            level, self.level = self.level, 1
            at = self.i
            if not (self.attempt(self.expression) and self.k[self.i] == ")"):
                self.i = at
                self.type()
            self.level = level
            self.need(")")
            return False
        if k == "func":
            self.i += 1
            self.signature()
            if self.k[self.i] == "{":
                self.block()
            return False
        if k in ("[", "map", "struct", "chan", "interface"):
            self.type()
            if self.k[self.i] == "{" and k in ("[", "map", "struct"):
                self.literal()
                return False
            return False
        self.fail()

    def suffixes(self, literal: bool) -> None:
        while True:
            k = self.k[self.i]
            if k == ".":
                self.i += 1
                if self.eat("("):
                    if not self.eat("type"):
                        self.type()
                    self.need(")")
                    literal = False
                else:
                    self.need("id")
            elif k == "[":
                self.i += 1
                level, self.level = self.level, 1
                if self.k[self.i] == "]":
                    self.fail("operand missing")
                if self.k[self.i] != ":":
                    self.element_or_type()
                    while self.eat(","):
                        if self.k[self.i] == "]":
                            break
                        self.element_or_type()
                for _ in range(2):
                    if self.eat(":") and self.k[self.i] not in (":", "]"):
                        self.expression()
                self.level = level
                self.need("]")
            elif k == "(":
                self.i += 1
                level, self.level = self.level, 1
                while not self.eat(")"):
                    self.element_or_type()
                    self.eat("...")
                    if self.k[self.i] != ")":
                        self.need(",")
                self.level = level
                literal = False
            elif k == "{" and literal and self.level >= 0:
                self.literal()
                literal = False
            else:
                return

    def element_or_type(self) -> None:
        at, level = self.i, self.level
        whole = self.attempt(self.expression)
        end = self.i
        if not (whole and self.k[end] in (",", ")", "]", ":", "...", "}")):
            self.i = at
            if not (self.attempt(self.type) and self.k[self.i] in (",", ")", "]")):
                self.i = end
                if not whole:
                    raise Unexpected(*self.failed["expression", at, level])

    def literal(self) -> None:
        level, self.level = self.level, 1
        self.need("{")
        while not self.eat("}"):
            self.value()
            if self.eat(":"):
                self.value()
            if self.k[self.i] != "}":
                self.need(",")
        self.level = level

    def value(self) -> None:
        if self.k[self.i] == "{":
            self.literal()
        else:
            self.expression()

    def skip(self) -> None:
        """To the next declaration at the beginning of a statement."""
        self.level = 0
        while self.i < self.n:
            if self.k[self.i] in ("func", "var", "const", "type") and self.i and self.k[self.i - 1] == ";":
                return
            self.i += 1


def check_go(text: str) -> list[Fault]:
    """Errors of a source file; one without any token counts as valid, as an empty one does."""
    kinds, places, faults = tokens(text)
    parser = GoParser(kinds, places, None, len(text))
    return sorted([*faults, *parser.run(parser.file_item, parser.skip, lambda: parser.i >= parser.n)])
