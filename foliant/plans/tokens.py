"""SQL text as tokens."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(r"(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^']|'')*')|(?P<quoted>\"(?:[^\"]|\"\")*\"|`(?:[^`]|``)*`)|(?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?|\.\d+)|(?P<word>[^\W\d]\w*)|(?P<sign>::|<=>|<=|>=|<>|!=|\|\||->|=>|.)", re.S)


@dataclass
class Token:
    kind: str
    text: str
    at: int

    @property
    def upper(self) -> str:
        return self.text.upper() if self.kind == "word" else self.text if self.kind == "sign" else ""

    @property
    def name(self) -> str:
        """An identifier's name: unquoted ones are lower-cased."""
        return self.text[1:-1].replace('""', '"').replace("``", "`") if self.kind == "quoted" else self.text.lower()

    @property
    def end(self) -> int:
        return self.at + len(self.text)


def tokens(sql: str) -> list[Token]:
    return [Token(m.lastgroup, m[0], m.start()) for m in _TOKEN.finditer(sql) if m.lastgroup != "space"]


def closing(ts: list[Token], i: int) -> int:
    """The place of the bracket that closes the one at i."""
    depth, pair = 0, {"(": ")", "[": "]"}[ts[i].text]
    for k in range(i, len(ts)):
        if ts[k].kind == "sign":
            depth += (ts[k].text == ts[i].text) - (ts[k].text == pair)
            if not depth:
                return k
    raise ValueError(f"{ts[i].text!r} is not closed")


def unquoted(s: str) -> str:
    return s[1:-1].replace("''", "'")


def spark_string(s: str) -> str:
    """A standard string literal as Spark reads it, where a backslash escapes."""
    return "'" + unquoted(s).replace("\\", "\\\\").replace("'", "\\'") + "'"
