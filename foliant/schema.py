"""The types that documents are inferred to have, and how two of them merge.

A type is a name, ``["list", item]``, or a dict of an object's members; all of it can be written as JSON. ``null`` is a
value never seen (also of ``{}``), ``unknown`` the item of an empty list, ``ulong`` an integer beyond 64 bits signed.
"""

from __future__ import annotations

from typing import Any

Type = Any  # str | ["list", Type] | dict[str, Type]

INTEGERS = ("byte", "short", "int", "long", "ulong")
FLOATS = ("float", "double")
#: The Spark SQL type of each scalar.
SPARK = {"boolean": "boolean", "byte": "tinyint", "short": "smallint", "int": "int", "long": "bigint", "ulong": "decimal(20,0)", "float": "float", "double": "double", "string": "string", "variant": "variant"}
LONG_MIN, LONG_MAX, ULONG_MAX = -(1 << 63), (1 << 63) - 1, (1 << 64) - 1


def is_list(t: Type) -> bool:
    return isinstance(t, list)


def merge(a: Type, b: Type) -> Type:
    """The type that holds the values of both; ``variant`` where none but it does."""
    if a == b:
        return a
    for unseen in ("null", "unknown"):
        if a == unseen:
            return b
        if b == unseen:
            return a
    if a == "variant" or b == "variant":
        return "variant"
    if isinstance(a, dict) and isinstance(b, dict):
        return {k: merge(a.get(k, "null"), b.get(k, "null")) for k in sorted(a.keys() | b.keys())}
    if is_list(a) and is_list(b):
        return ["list", merge(a[1], b[1])]
    if isinstance(a, str) and isinstance(b, str):
        if a in INTEGERS and b in INTEGERS:
            return max(a, b, key=INTEGERS.index)
        if {a, b} <= {*INTEGERS, *FLOATS}:
            return "double"
    return "variant"


def infer(value: Any) -> Type:
    """The type of a parsed JSON value; every element of a list counts."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, int):
        return "long" if LONG_MIN <= value <= LONG_MAX else "ulong" if 0 < value <= ULONG_MAX else "double"
    if isinstance(value, float):
        return "double"
    if isinstance(value, str):
        return "string"
    if isinstance(value, list):
        item: Type = "unknown"
        for v in value:
            item = merge(item, infer(v))
            if item == "variant":
                break
        return ["list", item]
    return {k: infer(v) for k, v in sorted(value.items())} or "null"


def infer_root(value: Any) -> dict[str, Type]:
    """A document's members; a document that is no object is the member ``value`` of one."""
    return {k: infer(v) for k, v in sorted(value.items())} if isinstance(value, dict) else {"value": infer(value)}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def spark_type(t: Type) -> str | None:
    """The Spark SQL type, or None for what has not been seen yet."""
    if isinstance(t, str):
        return SPARK.get(t)
    if is_list(t):
        item = spark_type(t[1])
        return item and f"array<{item}>"
    members = [f"{quoted(k)}: {s}" for k, v in sorted(t.items()) if (s := spark_type(v))]
    return f"struct<{', '.join(members)}>" if members else None


def known(t: Type) -> Type | None:
    """The type without the parts that have not been seen yet."""
    if isinstance(t, dict):
        return {k: v for k, x in sorted(t.items()) if (v := known(x)) is not None} or None
    if is_list(t):
        item = known(t[1])
        return item and ["list", item]
    return t if t in SPARK else None


def with_path(t: Type, path: list[str], leaf: Type) -> Type:
    """The type with the leaf put at the path, whatever was there."""
    if not path:
        return leaf
    members = dict(t) if isinstance(t, dict) else {}
    members[path[0]] = with_path(members.get(path[0], "null"), path[1:], leaf)
    return dict(sorted(members.items()))


def type_of(kind) -> Type | None:
    """The type of a Spark column; None for what documents cannot hold, such as maps and dates."""
    name = kind.typeName()
    if name == "struct":
        members = {f.name: type_of(f.dataType) for f in kind.fields}
        return None if None in members.values() else members
    if name == "array":
        item = type_of(kind.elementType)
        return item and ["list", item]
    found = {v: k for k, v in SPARK.items()}.get(kind.simpleString())
    return found or ("string" if name in ("varchar", "char") else None)
