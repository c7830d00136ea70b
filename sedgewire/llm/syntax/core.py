"""What the parsers share: tokens, errors, memory of statements met before."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple


class Fault(NamedTuple):
    """An error: where it is (offset into the text) and what was wrong."""

    at: int
    message: str


class Unexpected(Exception):
    """Raised inside a parser where a token doesn't fit."""

    def __init__(self, index: int, message: str):
        super().__init__(message)
        self.index, self.message = index, message


#: Token-class strings of valid statements and headers that a parser remembers, by language; emptied when full.
KEPT = 50_000


class Codes(dict):
    """One character for each token kind, so that a run of tokens is a string."""

    def __missing__(self, kind: str) -> str:
        self[kind] = c = chr(0xE000 + len(self))
        return c


CODES = Codes()
for _k in (";", "{", "}", "(", ")", "[", "]"):
    CODES[_k] = _k


class Parser:
    """Cursor over tokens. ``kinds``: a keyword or sign itself, or a class as id, num, str."""

    known: set[str]

    def __init__(self, kinds: list[str], places: list[int], newlines: list[bool] | None = None, end: int = 0):
        self.n = len(kinds)
        self.k = [*kinds, "eof", "eof", "eof", "eof"]
        self.places = [*places, end]
        self.nl = [*newlines, True, True] if newlines is not None else None
        self.codes = "".join(map(CODES.__getitem__, kinds))
        self.i = 0
        self.faults: list[Fault] = []
        self.failed: dict[tuple, tuple[int, str]] = {}
        self.close: dict[int, int] = {}
        stack: list[int] = []
        for j, kind in enumerate(kinds):
            if kind in ("(", "[", "{"):
                stack.append(j)
            elif kind in (")", "]", "}") and stack:
                self.close[stack.pop()] = j

    def fail(self, message: str | None = None):
        raise Unexpected(self.i, message or f"unexpected {self.k[self.i]}")

    def eat(self, kind: str) -> bool:
        if self.k[self.i] == kind:
            self.i += 1
            return True
        return False

    def need(self, kind: str) -> None:
        if self.k[self.i] != kind:
            raise Unexpected(self.i, f"expected {kind}, found {self.k[self.i]}")
        self.i += 1

    def context(self) -> object:
        """What besides the cursor decides how a rule goes."""
        return None

    def restore(self, context: object) -> None:
        """Back to a context that a failed rule left."""

    def attempt(self, rule: Callable[[], object]) -> bool:
        """Try a rule; on failure the cursor stays where it was, and the rule is not tried there again."""
        at, context = self.i, self.context()
        key = (rule.__name__, at, context)
        if key in self.failed:
            return False
        try:
            rule()
            return True
        except Unexpected as e:
            self.i = at
            self.restore(context)
            self.failed[key] = e.index, e.message
            return False

    def remember(self, key: str) -> None:
        if len(self.known) >= KEPT:
            self.known.clear()
        self.known.add(key)

    def report(self, e: Unexpected) -> None:
        self.faults.append(Fault(self.places[min(e.index, self.n)], e.message))

    def run(self, statement: Callable[[], None], recover: Callable[[], None], done: Callable[[], bool]) -> list[Fault]:
        """Statements up to the end; after an error, skip to where ``recover`` finds the next one."""
        while not done():
            at = self.i
            try:
                statement()
            except Unexpected as e:
                self.report(e)
                self.i = max(self.i, e.index)
                recover()
            except RecursionError:
                self.report(Unexpected(self.i, "nested too deeply"))
                self.i = self.n
            if self.i <= at:
                self.i = at + 1
        return self.faults
