"""POSIX shell with the bash constructs in common use."""

from __future__ import annotations

import re

from sedgewire.llm.syntax.core import Fault, Unexpected

# Reserved words, and those that cannot begin a command.
RESERVED = frozenset("if then elif else fi for while until do done case esac function select in time { } ! [[ ]] coproc".split())
_CLOSERS = frozenset("then elif else fi do done esac } ) in".split())
_OPERATORS = re.compile(r"&&|\|\||;;&|;;|;&|\|&|&>>|&>|<<<|<<-|<<|>>|>\||<>|<&|>&|<\(|>\(|[;&|<>()]")
_REDIRECT = frozenset("< > >> >| <> <& >& &> &>> <<<".split())
_BLANK = re.compile(r"(?:[ \t]|\\\r?\n)+")
_NAME = re.compile(r"[A-Za-z_]\w*$")
_ASSIGN = re.compile(r"[A-Za-z_]\w*(?:\[[^\]\n]*\])?\+?=")
_WORD_END = frozenset(" \t\n;&|<>()")
_KNOWN: dict[str, bool] = {}


class ShellParser:
    """Reads commands straight from the text, since words, quotes and expansions nest in one another."""

    def __init__(self, text: str):
        self.s, self.n, self.i = text, len(text), 0
        self.faults: list[Fault] = []
        self.here: list[tuple[str, bool]] = []
        self.failed: dict[tuple[int, bool], tuple[int, str]] = {}

    def fail(self, message: str) -> None:
        raise Unexpected(self.i, message)

    # spaces and signs

    def blank(self) -> None:
        while True:
            m = _BLANK.match(self.s, self.i)
            if m:
                self.i = m.end()
            elif self.s.startswith("#", self.i) and (self.i == 0 or self.s[self.i - 1] in " \t\n;&|()"):
                end = self.s.find("\n", self.i)
                self.i = self.n if end < 0 else end
            else:
                return

    def newline(self) -> bool:
        """A line end, with the here-documents that wait for it."""
        if self.s.startswith("\r\n", self.i):
            self.i += 1
        if not self.s.startswith("\n", self.i):
            return False
        self.i += 1
        for word, dashed in self.here:
            while True:
                if self.i >= self.n:
                    break  # bash only warns
                end = self.s.find("\n", self.i)
                line = self.s[self.i : self.n if end < 0 else end]
                self.i = self.n if end < 0 else end + 1
                if (line.lstrip("\t") if dashed else line).rstrip("\r") == word:
                    break
        self.here = []
        return True

    def lines(self) -> None:
        self.blank()
        while self.newline():
            self.blank()

    def operator(self) -> str:
        m = _OPERATORS.match(self.s, self.i)
        return m[0] if m else ""

    def peek_word(self) -> str:
        """The plain word here, if it is one without quotes and expansions, not consumed."""
        j = self.i
        while j < self.n and self.s[j] not in _WORD_END:
            j += 1
        return self.s[self.i : j].rstrip("\r")

    def take(self, word: str) -> bool:
        self.blank()
        if self.peek_word() == word:
            self.i += len(word)
            return True
        return False

    def need(self, word: str) -> None:
        if not self.take(word):
            self.fail(f"expected {word}, found {self.peek_word() or self.operator() or 'end'}")

    # lists

    def script(self) -> None:
        while True:
            self.lines()
            if self.i >= self.n:
                return
            at = self.i
            try:
                self.and_or()
                self.separator(top=True)
            except Unexpected as e:
                self.faults.append(Fault(min(self.i, self.n), str(e)))
                self.here = []
                end = self.s.find("\n", max(self.i, at))
                self.i = self.n if end < 0 else end + 1

    def separator(self, top: bool = False) -> None:
        self.blank()
        op = self.operator()
        if op in (";", "&"):
            self.i += 1
        elif op or not (self.i >= self.n or self.s[self.i] in "\r\n"):
            if top or op not in (")", ";;", ";&", ";;&"):
                self.fail(f"unexpected {op or self.peek_word()}")

    def compound_list(self, *ends: str) -> str:
        """Commands up to one of the words ``ends``, at least one; the word is consumed and returned."""
        count = 0
        while True:
            self.lines()
            if self.i >= self.n:
                self.fail(f"end of file, expected {ends[0]}")
            word = self.peek_word()
            if word in ends or not word and self.operator() in ends:
                if not count:
                    self.fail(f"no command before {word or self.operator()}")
                self.i += len(word or self.operator())
                return word or ")"
            self.and_or()
            count += 1
            self.separator()
            if ")" not in ends and self.operator() == ")":
                self.fail("unexpected )")
            if self.operator() in (";;", ";&", ";;&"):
                if ";;" in ends:
                    return self.clause_end()
                self.fail(f"unexpected {self.operator()}")

    def clause_end(self) -> str:
        self.i += len(self.operator())
        return ";;"

    def and_or(self) -> None:
        self.pipeline()
        while True:
            self.blank()
            op = self.operator()
            if op not in ("&&", "||"):
                break
            self.i += 2
            self.lines()
            self.pipeline()

    def pipeline(self) -> None:
        while self.take("!") or self.take("time"):
            self.take("-p")
        self.command()
        while True:
            self.blank()
            op = self.operator()
            if op not in ("|", "|&"):
                return
            self.i += len(op)
            self.lines()
            self.command()

    # commands

    def command(self) -> None:
        self.blank()
        op = self.operator()
        if op == "(":
            if self.s.startswith("((", self.i):
                at = self.i
                try:
                    self.i += 2
                    self.arithmetic("))")
                    self.redirects()
                    return
                except Unexpected:
                    self.i = at
            self.i += 1
            self.compound_list(")")
            self.redirects()
            return
        word = self.peek_word()
        rule = {"if": self.if_, "while": self.loop, "until": self.loop, "for": self.for_, "select": self.for_, "case": self.case, "{": self.group, "function": self.function, "[[": self.test}.get(word)
        if rule is not None:
            self.i += len(word)
            rule()
            self.redirects()
            return
        if word == "coproc":
            self.i += 6
            self.command()
            return
        if word in _CLOSERS and word != "in":
            self.fail(f"unexpected {word}")
        self.simple()

    def group(self) -> None:
        self.compound_list("}")

    def if_(self) -> None:
        self.compound_list("then")
        while True:
            end = self.compound_list("fi", "elif", "else")
            if end == "elif":
                self.compound_list("then")
            elif end == "else":
                self.compound_list("fi")
                return
            else:
                return

    def loop(self) -> None:
        self.compound_list("do")
        self.compound_list("done")

    def for_(self) -> None:
        self.blank()
        if self.s.startswith("((", self.i):
            self.i += 2
            self.arithmetic("))")
            self.blank()
            if self.operator() == ";":
                self.i += 1
        else:
            if not _NAME.match(self.peek_word()):
                self.fail("name expected after for")
            self.i += len(self.peek_word())
            self.lines()
            if self.take("in"):
                while True:
                    self.blank()
                    if self.i >= self.n or self.operator() or self.s[self.i] in "\r\n":
                        break
                    self.word()
                if self.operator() == ";":
                    self.i += 1
                elif self.i >= self.n or not self.s[self.i] in "\r\n":
                    self.fail(f"unexpected {self.operator()}")
            elif self.operator() == ";":
                self.i += 1
        self.lines()
        if self.take("{"):
            self.compound_list("}")
            return
        self.need("do")
        self.compound_list("done")

    def case(self) -> None:
        self.blank()
        self.word()
        self.lines()
        self.need("in")
        while True:
            self.lines()
            if self.take("esac"):
                return
            if self.i >= self.n:
                self.fail("end of file, expected esac")
            if self.operator() == "(":
                self.i += 1
            while True:
                self.blank()
                self.word(pattern=True)
                self.blank()
                if self.operator() != "|":
                    break
                self.i += 1
            if self.operator() != ")":
                self.fail("expected ) after pattern")
            self.i += 1
            self.lines()
            op = self.operator()
            if op in (";;", ";&", ";;&"):
                self.i += len(op)
                continue
            if self.take("esac"):
                return
            if self.compound_list(";;", "esac") == "esac":
                return

    def function(self) -> None:
        self.blank()
        if not self.peek_word():
            self.fail("name expected")
        self.i += len(self.peek_word())
        self.blank()
        if self.operator() == "(":
            self.i += 1
            self.blank()
            if self.operator() != ")":
                self.fail("expected )")
            self.i += 1
        self.body()

    def body(self) -> None:
        self.lines()
        if self.peek_word() not in ("{", "if", "while", "until", "for", "case", "select", "[[") and self.operator() != "(":
            self.fail("function body expected")
        self.command()

    def test(self) -> None:
        """Up to ]]; words, operators and nested brackets."""
        open_, words = 0, 0
        while True:
            self.lines()
            if self.i >= self.n:
                self.fail("end of file, expected ]]")
            if self.peek_word() == "]]" and not open_:
                if not words:
                    self.fail("empty test")
                self.i += 2
                return
            op = self.operator()
            if op in ("(", ")"):
                open_ += 1 if op == "(" else -1
                if open_ < 0:
                    self.fail("unexpected )")
                self.i += 1
            elif op in ("&&", "||", "<", ">"):
                self.i += len(op)
            elif op and op not in ("<(", ">("):
                self.fail(f"unexpected {op} in test")
            else:
                at = self.i
                self.word(pattern=True)
                words += 1
                if self.s[at : self.i] == "=~":
                    self.blank()
                    self.regex()

    def regex(self) -> None:
        open_ = 0
        while self.i < self.n:
            c = self.s[self.i]
            if c in "(":
                open_ += 1
                self.i += 1
            elif c == ")":
                if not open_:
                    return
                open_ -= 1
                self.i += 1
            elif c in " \t\n" and not open_:
                return
            elif c in "|<>&;" or c in " \t":
                self.i += 1
            else:
                self.piece()

    def simple(self) -> None:
        words = assigned = 0
        while True:
            self.blank()
            if self.i >= self.n or self.s[self.i] in "\r\n" and (self.s[self.i] == "\n" or self.s.startswith("\r\n", self.i)):
                break
            op = self.operator()
            if self.redirect():
                assigned += 1
                continue
            if op in ("<(", ">("):
                self.word()
                words += 1
                continue
            if op == "(":
                if words == 1 and not assigned and self.plain:
                    self.i += 1
                    self.blank()
                    if self.operator() != ")":
                        self.fail("unexpected (")
                    self.i += 1
                    self.body()
                    return
                self.fail("unexpected (")
            if op:
                break
            at = self.i
            m = _ASSIGN.match(self.s, at)
            if m and (not words or self.declares):
                self.i = m.end()
                if self.s.startswith("(", self.i):
                    self.i += 1
                    self.array()
                elif self.i < self.n and self.s[self.i] not in _WORD_END or self.operator() in ("<(", ">("):
                    self.word()
                assigned += 1
                continue
            self.word()
            self.plain = not re.search(r"[\"'`$\\=]", self.s[at : self.i])
            if not words:
                self.declares = self.s[at : self.i] in ("declare", "local", "export", "readonly", "typeset", "alias", "eval")
            words += 1
        if not words and not assigned:
            self.fail(f"unexpected {self.operator() or 'end of line'}")

    plain = declares = False

    def array(self) -> None:
        while True:
            self.lines()
            if self.i >= self.n:
                self.fail("end of file in array")
            if self.operator() == ")":
                self.i += 1
                return
            if self.operator() and self.operator() not in ("<(", ">("):
                self.fail(f"unexpected {self.operator()} in array")
            self.word()

    def redirects(self) -> None:
        self.blank()
        while self.redirect():
            self.blank()

    def redirect(self) -> bool:
        m = re.compile(r"(?:\d+|\{\w+\})?(<<<|<<-|<<|&>>|&>|>>|>\||<>|<&|>&|<(?!\()|>(?!\())").match(self.s, self.i)
        if not m:
            return False
        self.i = m.end()
        self.blank()
        at = self.i
        if m[1] in ("<<", "<<-"):
            self.word()
            self.here.append((re.sub(r"[\"'\\]", "", self.s[at : self.i]), m[1] == "<<-"))
        else:
            if self.i >= self.n or self.s[self.i] in "\r\n" or self.operator() and self.operator() not in ("<(", ">("):
                self.fail("redirection without a target")
            self.word()
        return True

    # words

    def word(self, pattern: bool = False) -> None:
        at = self.i
        while self.i < self.n:
            c = self.s[self.i]
            if c in _WORD_END:
                if c in "<>" and self.s.startswith("(", self.i + 1):
                    self.i += 2
                    self.compound_list(")")
                    continue
                if c == "(" and self.i > at and self.s[self.i - 1] in "?*+@!":
                    self.i += 1
                    self.extended()
                    continue
                break
            if c == "\r" and self.s.startswith("\n", self.i + 1):
                break
            self.piece()
        if self.i == at:
            self.fail(f"unexpected {self.operator() or 'end'}")

    def extended(self) -> None:
        while self.i < self.n and self.s[self.i] != ")":
            if self.s[self.i] == "(":
                self.i += 1
                self.extended()
            elif self.s[self.i] in " \t|&;<>":
                self.i += 1
            else:
                self.piece()
        if self.i >= self.n:
            self.fail("unclosed pattern")
        self.i += 1

    def piece(self) -> None:
        c = self.s[self.i]
        if c == "\\":
            self.i += 2
        elif c == "'":
            end = self.s.find("'", self.i + 1)
            if end < 0:
                self.fail("unterminated '")
            self.i = end + 1
        elif c == '"':
            self.i += 1
            self.double()
        elif c == "`":
            self.backtick()
        elif c == "$":
            self.dollar()
        else:
            self.i += 1

    def backtick(self) -> None:
        start = self.i
        j = start + 1
        while j < self.n and self.s[j] != "`":
            j += 2 if self.s[j] == "\\" else 1
        if j >= self.n:
            self.fail("unterminated `")
        inner = ShellParser(re.sub(r"\\([`\\$])", r"\1", self.s[start + 1 : j]))
        inner.script()
        if inner.faults:
            self.fail("error in command substitution")
        self.i = j + 1

    def double(self) -> None:
        start = self.i
        while self.i < self.n:
            c = self.s[self.i]
            if c == '"':
                self.i += 1
                return
            if c == "\\":
                self.i += 2
            elif c == "`":
                self.backtick()
            elif c == "$":
                self.dollar(quoted=True)
            else:
                self.i += 1
        self.i = start - 1
        self.fail('unterminated "')

    def dollar(self, quoted: bool = False) -> None:
        """An expansion; one that failed in another reading fails again at once."""
        key, here = (self.i, quoted), self.here
        if key in self.failed:
            self.i, message = self.failed[key]
            self.fail(message)
        try:
            self.expansion(quoted)
        except Unexpected as e:
            self.failed[key] = self.i, str(e)
            self.here = here
            raise

    def expansion(self, quoted: bool) -> None:
        s = self.s
        if s.startswith("$((", self.i):
            at = self.i
            try:
                self.i += 3
                self.arithmetic("))")
                return
            except Unexpected:
                self.i = at
        if s.startswith("$(", self.i):
            self.i += 2
            self.lines()
            if self.operator() == ")":
                self.i += 1
                return
            here, self.here = self.here, []
            self.compound_list(")")
            self.here = here
        elif s.startswith("${", self.i):
            self.i += 2
            self.parameter(quoted)
        elif s.startswith("$'", self.i) and not quoted:
            j = self.i + 2
            while j < self.n and s[j] != "'":
                j += 2 if s[j] == "\\" else 1
            if j >= self.n:
                self.fail("unterminated $'")
            self.i = j + 1
        elif s.startswith('$"', self.i) and not quoted:
            self.i += 2
            self.double()
        elif s.startswith("$[", self.i):
            end = s.find("]", self.i)
            if end < 0:
                self.fail("unterminated $[")
            self.i = end + 1
        else:
            self.i += 1

    def parameter(self, quoted: bool) -> None:
        start = self.i
        while self.i < self.n:
            c = self.s[self.i]
            if c == "}":
                self.i += 1
                return
            if c == "'" and quoted:
                self.i += 1
            elif c in "\\'\"`$":
                if c == "'" and self.s.find("'", self.i + 1) < 0:
                    break
                self.piece()
            else:
                self.i += 1
        self.i = start
        self.fail("unterminated ${")

    def arithmetic(self, end: str) -> None:
        open_ = 0
        while self.i < self.n:
            c = self.s[self.i]
            if c == "(":
                open_ += 1
                self.i += 1
            elif c == ")":
                if not open_:
                    if not self.s.startswith(end, self.i):
                        self.fail(f"expected {end}")
                    self.i += len(end)
                    return
                open_ -= 1
                self.i += 1
            elif c in "\\\"'`$":
                self.piece()
            else:
                self.i += 1
        self.fail(f"end of file, expected {end}")


def check_shell(text: str) -> list[Fault]:
    """Errors of a script, each with the command in which it was met."""
    parser = ShellParser(text)
    try:
        parser.script()
    except RecursionError:
        parser.faults.append(Fault(parser.i, "nested too deeply"))
    return sorted(parser.faults)
