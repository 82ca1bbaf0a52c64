"""SQL text to tokens with lines; comments dropped, no dialect refused."""

from __future__ import annotations

import re
from typing import NamedTuple

WORD, QUOTED, STRING, NUMBER, SIGN = "word", "quoted", "string", "number", "sign"


class Token(NamedTuple):
    kind: str
    text: str
    line: int
    start: int
    end: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == WORD else self.text

    @property
    def name(self) -> str:
        return self.text[1:-1] if self.kind == QUOTED else self.text


PATTERN = re.compile(
    r"""(?P<space>\s+)|(?P<comment>--[^\n]*|\#(?!>)[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>'(?:[^'\\]|\\.|'')*'?)|(?P<quoted>"[^"]*"|`[^`]*`|\[[A-Za-z_][\w ]*\])
    |(?P<number>\d+(?:\.\d*)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<word>\$\{[^}]*\}|[^\W\d][\w$]*)|(?P<sign>->>|->|::|<=|>=|<>|!=|\|\||=>|.)""",
    re.VERBOSE | re.DOTALL,
)


def tokenize(text: str) -> list[Token]:
    out, line, at = [], 1, 0
    while at < len(text):
        m = PATTERN.match(text, at)
        kind = m.lastgroup
        if kind == "quoted" and m[0][0] == "[" and out and (out[-1].kind in (WORD, QUOTED) and out[-1].upper not in ("FROM", "JOIN", "SELECT", "ON", "BY", "AS", "INTO", "UPDATE", "WHERE", "AND") or out[-1].text in ("]", ")")):
            m, kind = re.compile(r"\[").match(text, at), SIGN  # an index, not a quoted name
        if kind not in ("space", "comment"):
            out.append(Token(kind, m[0], line, m.start(), m.end()))
        line += m[0].count("\n")
        at = m.end()
    return out


def statements(text: str) -> list[list[Token]]:
    """Tokens of each statement, split at semicolons."""
    out: list[list[Token]] = [[]]
    for token in tokenize(text):
        if token.kind == SIGN and token.text == ";":
            out.append([])
        else:
            out[-1].append(token)
    return [s for s in out if s]


CONFIGURATION = re.compile(r"^\s*set\s+", re.IGNORECASE)
CHANGES = re.compile(r"^\s*(update|merge|delete|insert)\b", re.IGNORECASE)


def without_settings(text: str) -> str:
    """Lines ``SET key = value`` blanked, except within a statement that changes a table, up to its semicolon."""
    out, changing = [], False
    for line in text.split("\n"):
        changing = changing or bool(CHANGES.match(line))
        out.append("" if CONFIGURATION.match(line) and not changing else line)
        if line.rstrip().endswith(";"):
            changing = False
    return "\n".join(out)
