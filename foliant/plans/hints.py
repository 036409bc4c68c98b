"""Type hints of JSON columns: ``JSON (a.b INT NOT NULL, c TEXT)``."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Spellings of types in hints (fixed values).
SPELLINGS = {
    "boolean": "BOOLEAN, BOOL",
    "byte": "TINYINT",
    "short": "SMALLINT, INT2, INT16",
    "int": "INT, INTEGER, INT4, INT32",
    "long": "BIGINT, INT8, INT64",
    "ubyte": "TINYINT UNSIGNED, UTINYINT, UINT8",
    "ushort": "SMALLINT UNSIGNED, INT2 UNSIGNED, USMALLINT, UINT16",
    "uint": "INT UNSIGNED, INTEGER UNSIGNED, INT4 UNSIGNED, UINT32",
    "ulong": "BIGINT UNSIGNED, INT8 UNSIGNED, UBIGINT, UINT64",
    "float": "FLOAT, REAL, FLOAT4, FLOAT32",
    "double": "DOUBLE, DOUBLE PRECISION, FLOAT8, FLOAT64",
    "string": "CHAR, VARCHAR, TEXT, STRING, CHARACTER, CHARACTER VARYING, CHAR VARYING",
}
BY_SPELLING = {s: kind for kind, names in SPELLINGS.items() for s in names.split(", ")}
#: The type that holds an unsigned one, and its bits.
WIDER = {"ubyte": ("short", 8), "ushort": ("int", 16), "uint": ("long", 32), "ulong": ("ulong", 64)}
SIGNED = {"byte": 8, "short": 16, "int": 32, "long": 64}
#: Names of types in error messages (fixed values).
NAMES = {"boolean": "Boolean", "byte": "Int8", "short": "Int16", "int": "Int32", "long": "Int64", "ubyte": "UInt8", "ushort": "UInt16", "uint": "UInt32", "ulong": "UInt64", "float": "Float32", "double": "Float64", "string": "Utf8"}


@dataclass(frozen=True)
class Hint:
    path: list[str]
    kind: str
    nullable: bool = True

    @property
    def type(self) -> str:
        """The stored type."""
        return WIDER[self.kind][0] if self.kind in WIDER else self.kind

    def bounds(self) -> tuple[int, int]:
        if self.kind in WIDER:
            return 0, (1 << WIDER[self.kind][1]) - 1
        bits = SIGNED[self.kind]
        return -(1 << (bits - 1)), (1 << (bits - 1)) - 1

    def name(self) -> str:
        return NAMES[self.kind]

    def as_json(self) -> dict:
        return {"path": self.path, "kind": self.kind, "nullable": self.nullable}


_WORD = re.compile(r'\s*("(?:[^"]|"")*"|`[^`]*`|\([^()]*\)|[^\s,()]+)')


def parse_hints(text: str) -> list[Hint]:
    """Hints from the inside of the parentheses. Separators are commas or the start of the next path; of several types
    that could be meant the longest counts."""
    out, words = [], []
    for part in _parts(text):
        words = _WORD.findall(part)
        while words:
            path = words.pop(0).strip('"`')
            for n in (2, 1):
                spelled = " ".join(words[:n]).upper()
                if spelled in BY_SPELLING:
                    break
            else:
                raise ValueError(f"type {' '.join(words[:2]) or '(none)'!r} of path {path!r} is not supported")
            del words[:n]
            if words and words[0].startswith("("):  # a length, as in VARCHAR(20)
                words.pop(0)
            nullable = True
            if words and words[0].upper() == "NOT":
                if len(words) < 2 or words[1].upper() != "NULL":
                    raise ValueError(f"NOT without NULL after path {path!r}")
                nullable = False
                del words[:2]
            elif words and words[0].upper() == "NULL":
                words.pop(0)
            out.append(Hint(path.split("."), BY_SPELLING[spelled], nullable))
    return out


def _parts(text: str) -> list[str]:
    """Split at commas outside parentheses."""
    out, depth, at = [], 0, 0
    for i, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[at:i])
            at = i + 1
    return [p for p in [*out, text[at:]] if p.strip()]
