"""Java."""

from __future__ import annotations

import re

from sedgewire.llm.syntax.core import CODES, Fault, Parser

# Reserved words, and signs from longest to shortest. A run of > is one sign each, for type arguments.
RESERVED = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null _".split()
)
CONTEXTUAL = frozenset("var record sealed permits yield module open when non".split())
PRIMITIVE = frozenset("boolean byte char double float int long short".split())
MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed".split())
SIGNS = "<<= ... -> :: ++ -- && || == != <= += -= *= /= &= |= ^= %= << ( ) { } [ ] ; , . @ = > < ! ~ ? : + - * / & | ^ %".split()
_ESCAPE = r"\\(?:[btnfrs\"'\\]|[0-3]?[0-7]{1,2}|u+[0-9a-fA-F]{4}|\r?\n)"
_TOKEN = re.compile(
    r"(?P<ws>[ \t\r\n\f]+)|(?P<lc>//[^\n\r]*)|(?P<bc>/\*(?:[^*]|\*(?!/))*\*/)|(?P<id>(?:[^\W\d]|\$)(?:\w|\$)*)|"
    r"(?P<num>(?:0[xX](?:[0-9a-fA-F](?:_*[0-9a-fA-F])*)?(?:\.(?:[0-9a-fA-F](?:_*[0-9a-fA-F])*)?)?(?:[pP][+-]?\d(?:_*\d)*)?|0[bB][01](?:_*[01])*|(?:\d(?:_*\d)*(?:\.(?:\d(?:_*\d)*)?)?|\.\d(?:_*\d)*)(?:[eE][+-]?\d(?:_*\d)*)?)[lLfFdD]?(?![\w$]))|"
    rf"(?P<str>\"\"\"[ \t\f]*\r?\n(?:[^\"\\]|\"(?!\"\")|{_ESCAPE})*\"\"\"|\"(?:[^\"\\\n\r]|{_ESCAPE})*\"|'(?:[^'\\\n\r]|{_ESCAPE})')|(?P<sign>" + "|".join(re.escape(s) for s in SIGNS) + ")"
)
# Binding strength of binary operators.
BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, ">": 7, "<=": 7, ">=": 7, "instanceof": 7, "<<": 8, ">>": 8, ">>>": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())
_SIMPLE = re.compile("[^;{}]*;")
_KNOWN: set[str] = set()
_MEMBER_KEY, _CONDITION_KEY = "m", "("


def tokens(text: str) -> tuple[list[str], list[int], list[Fault]]:
    kinds: list[str] = []
    places: list[int] = []
    faults: list[Fault] = []
    at, n = 0, len(text)
    while at < n:
        m = _TOKEN.match(text, at)
        if m is None:
            if text[at] == "\x1a" and at == n - 1:
                break
            faults.append(Fault(at, "unterminated literal" if text[at] in "\"'/" else f"unexpected character {text[at]!r}"))
            stop = n if text.startswith(('"""', "/*"), at) else text.find("\n", at)
            at = n if stop < 0 else max(stop, at + 1)
            continue
        group = m.lastgroup
        start, at = at, m.end()
        if group in ("ws", "lc", "bc"):
            continue
        kinds.append(m[0] if group == "sign" or group == "id" and (m[0] in RESERVED or m[0] in CONTEXTUAL) else group)
        places.append(start)
    return kinds, places, faults


class JavaParser(Parser):
    known = _KNOWN

    def op(self) -> str:
        """The operator here, with > signs that touch put together."""
        k = self.k[self.i]
        if k != ">" or self.k[self.i + 1] not in (">", ">=", "=", "=="):
            if k == ">" and self.k[self.i + 1] == "=" and self.places[self.i + 1] == self.places[self.i] + 1:
                return ">="
            return k
        run, j = ">", self.i
        while j + 1 < self.n and self.places[j + 1] == self.places[j] + 1 and self.k[j + 1] in (">", "=") and len(run) < 4:
            run += self.k[j + 1]
            j += 1
            if run[-1] == "=":
                break
        if run[-1] == "=" and self.k[j + 1] == "=" and self.places[j + 1] == self.places[j] + 1:
            run = run[:-1]
        return run

    def is_name(self) -> bool:
        k = self.k[self.i]
        return k == "id" or k in CONTEXTUAL

    def name(self) -> None:
        if not self.is_name():
            self.fail()
        self.i += 1

    def qualified(self) -> None:
        self.name()
        while self.k[self.i] == "." and (self.k[self.i + 1] == "id" or self.k[self.i + 1] in CONTEXTUAL):
            self.i += 2

    # declarations

    def unit_item(self) -> None:
        if self.eat(";"):
            return
        if self.k[self.i] == "import":
            self.i += 1
            self.eat("static")
            self.qualified()
            if self.eat("."):
                self.need("*")
            self.need(";")
            return
        at = self.i
        self.modifiers()
        if self.k[self.i] == "package":
            self.i += 1
            self.qualified()
            self.need(";")
            return
        if self.k[self.i] in ("module", "open") and self.i == at and self.module():
            return
        if not self.type_declaration():
            self.fail("class, interface, enum or record expected")

    def module(self) -> bool:
        at = self.i
        self.eat("open")
        if not self.eat("module") or not self.is_name():
            self.i = at
            return False
        self.qualified()
        if self.k[self.i] != "{" or (end := self.close.get(self.i)) is None:
            self.i = at
            return False
        self.i = end + 1
        return True

    def modifiers(self) -> None:
        while True:
            k = self.k[self.i]
            if k == "@" and self.k[self.i + 1] != "interface":
                self.annotation()
            elif k == "non" and self.k[self.i + 1] == "-":
                self.i += 3
            elif k in MODIFIERS and not (k == "default" and self.k[self.i + 1] in (":", "->")) and not (k == "sealed" and self.k[self.i + 1] in ("=", ".", "(", ";", ",")):
                self.i += 1
            else:
                return

    def annotation(self) -> None:
        self.need("@")
        self.qualified()
        if self.eat("("):
            while not self.eat(")"):
                if self.is_name() and self.k[self.i + 1] == "=":
                    self.i += 2
                self.element_value()
                if self.k[self.i] != ")":
                    self.need(",")

    def element_value(self) -> None:
        if self.k[self.i] == "@":
            self.annotation()
        elif self.eat("{"):
            while not self.eat("}"):
                self.element_value()
                if self.k[self.i] != "}":
                    self.need(",")
        else:
            self.ternary()

    def type_declaration(self) -> bool:
        k = self.k[self.i]
        if k == "class":
            self.i += 1
            self.name()
            self.type_parameters()
            if self.eat("extends"):
                self.type()
            self.clauses()
            self.body()
        elif k == "interface" or k == "@":
            self.eat("@")
            self.need("interface")
            self.name()
            self.type_parameters()
            if self.eat("extends"):
                self.types()
            self.clauses()
            self.body()
        elif k == "enum":
            self.i += 1
            self.name()
            self.clauses()
            self.enum_body()
        elif k == "record" and (self.k[self.i + 1] == "id" or self.k[self.i + 1] in CONTEXTUAL) and self.k[self.i + 2] in ("(", "<"):
            self.i += 2
            self.type_parameters()
            self.parameters()
            self.clauses()
            self.body()
        else:
            return False
        return True

    def clauses(self) -> None:
        while self.k[self.i] in ("implements", "permits"):
            self.i += 1
            self.types()

    def types(self) -> None:
        self.type()
        while self.eat(","):
            self.type()

    def type_parameters(self) -> None:
        if self.eat("<"):
            while True:
                self.modifiers()
                self.name()
                if self.eat("extends"):
                    self.type()
                    while self.eat("&"):
                        self.type()
                if not self.eat(","):
                    break
            self.need(">")

    def body(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.k[self.i] == "eof":
                self.fail("unclosed body")
            self.member()

    def enum_body(self) -> None:
        self.need("{")
        while self.k[self.i] not in (";", "}"):
            self.modifiers()
            self.name()
            if self.k[self.i] == "(":
                self.arguments()
            if self.k[self.i] == "{":
                self.body()
            if self.k[self.i] not in (";", "}"):
                self.need(",")
        if self.eat(";"):
            while not self.eat("}"):
                if self.k[self.i] == "eof":
                    self.fail("unclosed body")
                self.member()
        else:
            self.need("}")

    def member(self) -> None:
        if self.eat(";"):
            return
        start = self.i
        brace = self.codes.find("{", start)
        key = _MEMBER_KEY + self.codes[start:brace] if brace >= 0 else None
        if key is not None and key in self.known:
            self.i = brace
            self.block()
            return
        if self.k[self.i] == "static" and self.k[self.i + 1] == "{":
            self.i += 1
            self.block()
            return
        if self.k[self.i] == "{":
            self.block()
            return
        self.modifiers()
        if self.type_declaration():
            return
        self.type_parameters()
        if self.is_name() and self.k[self.i + 1] == "(":
            self.i += 1
            self.method(start, key, brace)
            return
        if self.is_name() and self.k[self.i + 1] == "{":
            self.i += 1
            self.block()
            return
        if not self.eat("void"):
            self.type()
        self.name()
        if self.k[self.i] == "(":
            self.method(start, key, brace)
            return
        self.declarators()
        self.need(";")

    def method(self, start: int, key: str | None, brace: int) -> None:
        self.parameters()
        self.dimensions()
        if self.eat("throws"):
            self.types()
        if self.eat("default"):
            self.element_value()
        if self.eat(";"):
            return
        if self.i == brace and key is not None and ";" not in key:
            self.remember(key)
        self.block()

    def dimensions(self) -> None:
        while self.k[self.i] == "@" or self.k[self.i] == "[" and self.k[self.i + 1] == "]":
            if self.k[self.i] == "@":
                self.annotation()
            else:
                self.i += 2

    def declarators(self) -> None:
        """After the first name."""
        while True:
            self.dimensions()
            if self.eat("="):
                self.initializer()
            if not self.eat(","):
                return
            self.name()

    def initializer(self) -> None:
        if self.eat("{"):
            while not self.eat("}"):
                self.initializer()
                if self.k[self.i] != "}":
                    self.need(",")
        else:
            self.expression()

    def parameters(self) -> None:
        self.need("(")
        while not self.eat(")"):
            self.modifiers()
            self.type()
            while self.k[self.i] == "@":
                self.annotation()
            self.eat("...")
            if self.is_name() and self.k[self.i + 1] == ".":
                self.i += 2
            if not self.eat("this"):
                self.name()
            self.dimensions()
            if self.k[self.i] != ")":
                self.need(",")
                if self.k[self.i] == ")":
                    self.fail()

    def type(self) -> None:
        while self.k[self.i] == "@":
            self.annotation()
        if self.k[self.i] in PRIMITIVE:
            self.i += 1
        else:
            self.name()
            self.type_arguments()
            while self.k[self.i] == "." and self.k[self.i + 1] in ("id", "@", *CONTEXTUAL):
                self.i += 1
                while self.k[self.i] == "@":
                    self.annotation()
                self.name()
                self.type_arguments()
        self.dimensions()

    def type_arguments(self) -> None:
        if not self.eat("<"):
            return
        if self.eat(">"):
            return
        while True:
            while self.k[self.i] == "@":
                self.annotation()
            if self.eat("?"):
                if self.k[self.i] in ("extends", "super"):
                    self.i += 1
                    self.type()
            else:
                self.type()
            if not self.eat(","):
                break
        self.need(">")

    # statements

    def block(self) -> None:
        self.need("{")
        while not self.eat("}"):
            if self.k[self.i] == "eof":
                self.fail("unclosed block")
            self.statement()

    def statement(self) -> None:
        codes, i = self.codes, self.i
        m = None
        if codes[i : i + 1] not in _COMPOUND:
            m = _SIMPLE.match(codes, i)
            if m and m[0] in self.known:
                self.i = m.end()
                return
        self.plain()
        if m and self.i == m.end():
            self.remember(m[0])

    def condition(self) -> None:
        at, end = self.i, self.close.get(self.i)
        key = _CONDITION_KEY + self.codes[at : end + 1] if end is not None and self.k[at] == "(" else None
        if key is not None and key in self.known:
            self.i = end + 1
            return
        self.need("(")
        self.expression()
        self.need(")")
        if key is not None and self.i == end + 1 and "{" not in key:
            self.remember(key)

    def plain(self) -> None:
        k = self.k[self.i]
        rule = getattr(self, "s_" + k, None) if k.isalpha() and k in _RULES else None
        if rule is not None and rule() is not False:
            return
        if k == "{":
            self.block()
        elif k == ";":
            self.i += 1
        elif self.is_name() and self.k[self.i + 1] == ":":
            self.i += 2
            self.statement()
        elif k in ("class", "interface", "enum", "abstract", "static", "strictfp", "@", "final", "sealed", "non") or k == "record" and self.k[self.i + 2] in ("(", "<") and self.k[self.i + 1] == "id":
            self.modifiers()
            if not self.type_declaration():
                self.local()
                self.need(";")
        elif self.attempt(self.local_start):
            self.declarators()
            self.need(";")
        else:
            self.effect()
            self.need(";")

    def local(self) -> None:
        self.local_start()
        self.declarators()

    def local_start(self) -> None:
        self.type()
        self.name()
        if self.k[self.i] not in ("=", ";", ",", ":", "["):
            self.fail()

    def effect(self) -> None:
        """An expression that may stand as a statement."""
        start = self.i
        kind = self.expression()
        if kind != "effect":
            self.i = start
            self.fail("not a statement")

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

    def s_do(self):
        self.i += 1
        self.statement()
        self.need("while")
        self.condition()
        self.need(";")

    def s_for(self):
        self.i += 1
        at, end = self.i, self.close.get(self.i)
        key = "f" + self.codes[at : end + 1] if end is not None else None
        if key is not None and key in self.known:
            self.i = end + 1
        else:
            self.need("(")
            self.for_header()
            self.need(")")
            if key is not None and self.i == end + 1 and "{" not in key:
                self.remember(key)
        self.statement()

    def for_header(self) -> None:
        start = self.i
        self.modifiers()
        if self.i > start or self.k[self.i] != ";":
            if self.attempt(self.local_start):
                if self.eat(":"):
                    self.expression()
                    return
                self.declarators()
            else:
                self.effects()
        self.need(";")
        if self.k[self.i] != ";":
            self.expression()
        self.need(";")
        if self.k[self.i] != ")":
            self.effects()

    def effects(self) -> None:
        self.effect()
        while self.eat(","):
            self.effect()

    def s_switch(self):
        at = self.i
        self.switch()
        if self.k[self.i] in (".",):
            self.i = at
            return False

    def switch(self) -> None:
        self.need("switch")
        self.condition()
        self.need("{")
        while not self.eat("}"):
            if self.eat("default"):
                pass
            else:
                self.need("case")
                while True:
                    if not self.eat("default"):
                        self.label()
                    if not self.eat(","):
                        break
                if self.eat("when"):
                    self.expression()
            if self.eat("->"):
                if self.k[self.i] == "{":
                    self.block()
                elif self.k[self.i] == "throw":
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while self.k[self.i] not in ("case", "default", "}"):
                    if self.k[self.i] == "eof":
                        self.fail("unclosed switch")
                    self.statement()

    def label(self) -> None:
        at = self.i
        if self.attempt(self.pattern) and self.k[self.i] in (":", "->", ",", "when"):
            return
        self.i = at
        self.ternary(no_lambda=True)

    def pattern(self) -> None:
        self.modifiers()
        self.type()
        if self.eat("("):
            while not self.eat(")"):
                self.pattern()
                if self.k[self.i] != ")":
                    self.need(",")
            if self.is_name() and self.k[self.i] != "when":
                self.i += 1
        else:
            self.name()

    def s_try(self):
        self.i += 1
        handled = False
        if self.eat("("):
            handled = True
            while not self.eat(")"):
                self.modifiers()
                at = self.i
                if self.attempt(self.local_start):
                    self.need("=")
                    self.expression()
                else:
                    self.i = at
                    self.expression()
                if self.k[self.i] != ")":
                    self.need(";")
        self.block()
        while self.eat("catch"):
            handled = True
            self.need("(")
            self.modifiers()
            self.type()
            while self.eat("|"):
                self.type()
            self.name()
            self.need(")")
            self.block()
        if self.eat("finally"):
            handled = True
            self.block()
        if not handled:
            self.fail("try without catch")

    def s_synchronized(self):
        if self.k[self.i + 1] != "(":
            return False
        self.i += 1
        self.condition()
        self.block()

    def s_return(self):
        self.i += 1
        if self.k[self.i] != ";":
            self.expression()
        self.need(";")

    def s_throw(self):
        self.i += 1
        self.expression()
        self.need(";")

    def s_yield(self):
        if self.k[self.i + 1] in ("=", ".", "[", "++", "--", "("):
            return False
        self.i += 1
        self.expression()
        self.need(";")

    def s_break(self):
        self.i += 1
        if self.is_name():
            self.i += 1
        self.need(";")

    s_continue = s_break

    def s_assert(self):
        self.i += 1
        self.expression()
        if self.eat(":"):
            self.expression()
        self.need(";")

    # expressions: "effect" for calls, assignments, steps and creations, "place" for what can be assigned to, else None

    def lambda_ahead(self) -> bool:
        if self.is_name() and self.k[self.i + 1] == "->":
            return True
        return self.k[self.i] == "(" and (end := self.close.get(self.i)) is not None and self.k[end + 1] == "->"

    def expression(self):
        if self.lambda_ahead():
            self.lambda_()
            return None
        kind = self.ternary()
        op = self.op()
        if op in ASSIGN:
            if kind != "place":
                self.fail("not a target of an assignment")
            self.i += op.count(">") + op.endswith("=") if op[0] == ">" else 1
            self.expression()
            kind = "effect"
        return kind

    def lambda_(self) -> None:
        if self.is_name():
            self.i += 1
        elif not self.attempt(self.bare_parameters):
            self.parameters()
        self.need("->")
        if self.k[self.i] == "{":
            self.block()
        else:
            self.expression()

    def bare_parameters(self) -> None:
        self.need("(")
        while not self.eat(")"):
            if not self.eat("_"):
                self.name()
            if self.k[self.i] != ")":
                self.need(",")

    def ternary(self, no_lambda: bool = False):
        kind = self.binary(0)
        if self.eat("?"):
            self.branch()
            self.need(":")
            self.branch()
            return None
        return kind

    def branch(self) -> None:
        if self.lambda_ahead():
            self.lambda_()
        else:
            self.ternary()

    def binary(self, least: int):
        kind = self.unary()
        while True:
            op = self.op()
            strength = BINARY.get(op, 0)
            if strength <= least:
                return kind
            self.i += len(op) if op[0] == ">" else 1
            kind = None
            if op == "instanceof":
                self.eat("final")
                if not self.attempt(self.pattern):
                    self.type()
            else:
                self.binary(strength)

    def unary(self):
        k = self.k[self.i]
        if k in ("++", "--"):
            self.i += 1
            if self.unary() != "place":
                self.fail("not a target")
            return "effect"
        if k in ("+", "-", "!", "~"):
            self.i += 1
            self.unary()
            return None
        if k == "(" and self.attempt(self.cast):
            if self.lambda_ahead():
                self.lambda_()
            else:
                self.unary()
            return None
        return self.postfix()

    def cast(self) -> None:
        self.need("(")
        primitive = self.k[self.i] in PRIMITIVE
        self.type()
        plain = primitive and self.k[self.i - 1] in PRIMITIVE
        while self.eat("&"):
            self.type()
        self.need(")")
        k = self.k[self.i]
        if plain and k in ("+", "-", "++", "--"):
            return
        if not (k in ("id", "num", "str", "(", "!", "~", "this", "super", "new", "true", "false", "null", "switch") or k in CONTEXTUAL or k in PRIMITIVE or k == "void"):
            self.fail()

    def postfix(self):
        kind = self.primary()
        while True:
            k = self.k[self.i]
            if k == ".":
                self.i += 1
                if self.k[self.i] == "<":
                    self.type_arguments()
                if self.k[self.i] == "new":
                    self.creation()
                    kind = "effect"
                elif self.k[self.i] in ("this", "class", "super"):
                    self.i += 1
                    kind = None
                    if self.k[self.i] == "(":
                        self.arguments()
                        kind = "effect"
                else:
                    self.name()
                    kind = "place"
                    if self.k[self.i] == "(":
                        self.arguments()
                        kind = "effect"
            elif k == "[":
                if self.k[self.i + 1] == "]":
                    self.dimensions()
                    if self.k[self.i] == "." and self.k[self.i + 1] == "class":
                        self.i += 2
                    elif self.k[self.i] != "::":
                        self.fail()
                    kind = None
                    continue
                self.i += 1
                self.expression()
                self.need("]")
                kind = "place"
            elif k == "::":
                self.i += 1
                self.type_arguments()
                if not self.eat("new"):
                    self.name()
                kind = None
            elif k in ("++", "--"):
                if kind != "place":
                    self.fail("not a target")
                self.i += 1
                return "effect"
            else:
                return kind

    def arguments(self) -> None:
        self.need("(")
        if self.eat(")"):
            return
        self.expression()
        while self.eat(","):
            self.expression()
        self.need(")")

    def creation(self) -> None:
        self.need("new")
        self.type_arguments()
        while self.k[self.i] == "@":
            self.annotation()
        if self.k[self.i] in PRIMITIVE:
            self.i += 1
        else:
            self.name()
            self.type_arguments()
            while self.eat("."):
                self.name()
                self.type_arguments()
        if self.k[self.i] == "[":
            if self.k[self.i + 1] == "]":
                self.dimensions()
                if self.k[self.i] != "{":
                    self.fail("array dimension missing")
                self.initializer()
                return
            while self.k[self.i] == "[":
                self.i += 1
                if self.eat("]"):
                    continue
                self.expression()
                self.need("]")
            return
        self.arguments()
        if self.k[self.i] == "{":
            self.body()

    def primary(self):
        k = self.k[self.i]
        if k in ("num", "str", "true", "false", "null"):
            self.i += 1
            return None
        if k == "(":
            self.i += 1
            kind = self.expression()
            self.need(")")
            return "place" if kind == "place" else None
        if k in ("this", "super"):
            self.i += 1
            if self.k[self.i] == "(":
                self.arguments()
                return "effect"
            return None
        if k == "new":
            self.creation()
            return "effect"
        if k == "switch":
            self.switch()
            return None
        if k in PRIMITIVE or k == "void":
            self.i += 1
            self.dimensions()
            if self.k[self.i] == "." and self.k[self.i + 1] == "class":
                self.i += 2
            elif self.k[self.i] != "::":
                self.fail()
            return None
        if self.is_name():
            if self.k[self.i + 1] == "<" and self.attempt(self.generic_reference):
                return None
            self.i += 1
            if self.k[self.i] == "(":
                self.arguments()
                return "effect"
            return "place"
        self.fail()

    def generic_reference(self) -> None:
        self.type()
        if self.k[self.i] != "::":
            self.fail()

    def skip(self) -> None:
        while self.i < self.n:
            k = self.k[self.i]
            self.i += 1
            if k in (";", "}") and self.k[self.i] in ("class", "interface", "enum", "record", "public", "abstract", "final", "@", "import"):
                return


_RULES = frozenset(x[2:] for x in dir(JavaParser) if x.startswith("s_"))
_COMPOUND = frozenset(CODES[k] for k in [*_RULES, "{", "class", "interface", "enum", "case", "default"] if k not in ("return", "throw", "break", "continue", "assert"))


def check_java(text: str) -> list[Fault]:
    """Errors of a compilation unit."""
    kinds, places, faults = tokens(text)
    parser = JavaParser(kinds, places, None, len(text))
    return sorted([*faults, *parser.run(parser.unit_item, parser.skip, lambda: parser.i >= parser.n)])
