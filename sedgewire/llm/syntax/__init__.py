"""Syntax checking of source files: one recursive-descent parser per language."""

from __future__ import annotations

import sys

from sedgewire.llm.syntax.core import Fault
from sedgewire.llm.syntax.golang import check_go
from sedgewire.llm.syntax.java import check_java
from sedgewire.llm.syntax.pysrc import check_python
from sedgewire.llm.syntax.script import check_script
from sedgewire.llm.syntax.shell import check_shell

# Languages by file extension.
LANGUAGES = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "py": "python", "pyw": "python", "go": "go", "java": "java", "sh": "shell", "bash": "shell",
}


#: Calls of rules within one another; these take memory only. What nests deeper (some 100,000 brackets) no compiler reads either and is an error.
MOST_CALLS = 1_000_000


def language_of(path: str | None) -> str | None:
    """The language a path's extension stands for, or None."""
    name = (path or "").replace("\\", "/").rsplit("/", 1)[-1]
    return LANGUAGES.get(name.rsplit(".", 1)[1].lower()) if "." in name else None


def syntax_errors(text: str, language: str) -> list[Fault]:
    """All errors of a text in order of place; none if it is valid. An empty text is valid."""
    sys.setrecursionlimit(max(sys.getrecursionlimit(), MOST_CALLS))
    text = text.removeprefix("﻿")
    if language == "python":
        return check_python(text)
    if language == "go":
        return check_go(text) if text.strip() else []
    if language == "java":
        return check_java(text)
    if language == "shell":
        return check_shell(text)
    return check_script(text, typed=language != "javascript", markup=language != "typescript")
