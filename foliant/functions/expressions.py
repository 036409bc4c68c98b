"""SQL text for reading a path of a JSON value and for rendering it.

Three kinds of input: ``columns`` (typed nested columns, described by a ``schema.Type``), variants, and JSON text. Paths
are keys split at dots, case-sensitive; there are no list indexes. What is missing, null or incompatible is NULL.
"""

from __future__ import annotations

import json

from ..schema import FLOATS, INTEGERS, SPARK, Type, is_list, quoted


def literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def split_path(path: str) -> list[str]:
    return path.split(".") if path else []


def variant_path(keys: list[str]) -> str:
    return literal("$" + "".join("[" + json.dumps(k, ensure_ascii=False) + "]" for k in keys))


def render(expr: str, t: Type | None, depth: int = 0) -> str:
    """JSON text without null or empty members; NULL where nothing is left. Variants keep what is inside them."""
    if t is None:
        return "CAST(NULL AS STRING)"
    if isinstance(t, dict):
        members = [f"concat({literal(json.dumps(k, ensure_ascii=False) + ':')}, {render(f'{expr}.{quoted(k)}', v, depth)})" for k, v in sorted(t.items())]
        return f"nullif(concat('{{', array_join(array({', '.join(members)}), ','), '}}'), '{{}}')" if members else "CAST(NULL AS STRING)"
    if is_list(t):
        x = f"x{depth}"
        return f"nullif(concat('[', array_join(transform({expr}, {x} -> {render(x, t[1], depth + 1)}), ','), ']'), '[]')"
    if t == "string":
        return f"to_json(CAST({expr} AS VARIANT))"
    if t == "variant":
        return shown_variant(expr)
    if t in FLOATS:
        return shown_number(expr)
    return f"CAST({expr} AS STRING)"


def shown_number(expr: str) -> str:
    """A floating-point number as JSON writers have it: digits from 1e-4 up to 1e16, else the shortest with an exponent;
    0 for what JSON has no number for."""
    digits = f"regexp_replace(CAST(CAST({expr} AS DECIMAL(38, 20)) AS STRING), '(\\\\.[0-9]+?)0+$', '$1')"
    power = f"replace(regexp_replace(CAST({expr} AS STRING), '\\\\.0E', 'E'), 'E', 'e')"
    return f"CASE WHEN isnan({expr}) OR abs({expr}) = double('infinity') THEN '0' WHEN abs({expr}) >= 1e7 AND abs({expr}) < 1e16 OR abs({expr}) < 1e-3 AND abs({expr}) >= 1e-4 THEN {digits} WHEN abs({expr}) >= 1e16 OR abs({expr}) < 1e-3 AND {expr} <> 0 THEN {power} ELSE CAST({expr} AS STRING) END"


def shown_variant(expr: str) -> str:
    return f"nullif(nullif(nullif(to_json({expr}), 'null'), '[]'), '{{}}')"


def walk(expr: str, t: Type | None, keys: list[str]) -> tuple[str, Type | None, list[str]]:
    """Down the path as far as columns go: (expression, its type or None if there is no such path, rest inside a variant)."""
    for i, k in enumerate(keys):
        if t == "variant":
            return expr, t, keys[i:]
        if not isinstance(t, dict) or k not in t:
            return "NULL", None, []
        expr, t = f"{expr}.{quoted(k)}", t[k]
    return expr, t, []


def as_text(expr: str, t: Type | None, path: str) -> str:
    """The untyped getter: JSON text, with strings in quotes."""
    e, found, rest = walk(expr, t, split_path(path))
    if found == "variant" and rest:
        return shown_variant(f"try_variant_get({e}, {variant_path(rest)}, 'variant')")
    return render(e, found)


def as_type(expr: str, t: Type | None, path: str, wanted: str) -> str:
    """The typed getter; wanted is a Spark SQL type. NULL wherever the value cannot be had in that type."""
    e, found, rest = walk(expr, t, split_path(path))
    if found is None:
        return f"CAST(NULL AS {wanted})"
    if found == "variant":
        return from_variant(e, variant_path(rest), wanted)
    if not isinstance(found, str):
        if wanted.lower() in SPARK.values():
            return f"CAST(NULL AS {wanted})"
        return f"try_cast({e} AS {wanted})"
    return e if SPARK[found] == wanted.lower() else f"try_cast({e} AS {wanted})"


def from_variant(v: str, path: str, wanted: str) -> str:
    """A value inside a variant: integers only from integers, numbers only from numbers, booleans only from booleans, so
    that nothing is cut off or made up."""
    got, w = f"try_variant_get({v}, {path}, {literal(wanted)})", wanted.lower()
    kind = f"schema_of_variant(try_variant_get({v}, {path}, 'variant'))"
    if w in ("tinyint", "smallint", "int", "bigint"):
        return f"CASE WHEN {kind} = 'BIGINT' THEN {got} END"
    if w == "boolean":
        return f"CASE WHEN {kind} = 'BOOLEAN' THEN {got} END"
    return f"CASE WHEN {kind} NOT IN ('STRING', 'BOOLEAN') THEN {got} END" if w in ("float", "double") else got


def dynamic(v: str, path: str, kind: str) -> str:
    """``from_variant`` in a type that is SQL over type names, which Spark resolves with the plan."""
    if kind[0] == "'" and kind[-1] == "'":
        return from_variant(v, path, kind[1:-1])
    have = f"schema_of_variant(try_variant_get({v}, {path}, 'variant'))"
    return f"CASE WHEN {kind} = 'bigint' AND {have} <> 'BIGINT' OR {kind} = 'double' AND {have} IN ('STRING', 'BOOLEAN') THEN NULL ELSE try_variant_get({v}, {path}, {kind}) END"


def natural(expr: str, t: Type | None, path: str, otherwise: str = "string") -> tuple[str, str | None]:
    """The leaf in its own type; ``otherwise`` is the type of what has none of its own (variants, unseen paths)."""
    e, found, rest = walk(expr, t, split_path(path))
    if found is None or found == "variant":
        return as_type(expr, t, path, otherwise), None
    return e, found if isinstance(found, str) else "nested"


def is_number(t: str | None) -> bool:
    return t in INTEGERS or t in FLOATS


def text_as_text(expr: str, path: str) -> str:
    """The untyped getter on JSON text; malformed text is NULL."""
    v = f"try_parse_json({expr})"
    return shown_variant(f"try_variant_get({v}, {variant_path(split_path(path))}, 'variant')" if path else v)


def text_as_type(expr: str, path: str, wanted: str) -> str:
    """The strict typed getter on JSON text: strings only from strings, integers only from integers in range, booleans
    only from booleans, floating-point numbers from any number."""
    inner = f"try_variant_get(try_parse_json({expr}), {variant_path(split_path(path))}, 'variant')"
    kind, w = f"schema_of_variant({inner})", wanted.lower()
    if w == "string":
        test = f"{kind} = 'STRING'"
    elif w == "boolean":
        test = f"{kind} = 'BOOLEAN'"
    elif w in ("tinyint", "smallint", "int", "bigint"):
        test = f"{kind} = 'BIGINT'"
    elif w in ("float", "double"):
        test = f"({kind} IN ('BIGINT', 'DOUBLE', 'FLOAT') OR {kind} LIKE 'DECIMAL%')"
    elif w.startswith("decimal"):
        test = f"({kind} = 'BIGINT' OR {kind} LIKE 'DECIMAL%,0)')"
    else:
        test = "true"
    return f"CASE WHEN {test} THEN try_variant_get({inner}, '$', {literal(wanted)}) END"


def conform(expr: str, have: Type | None, want: Type, depth: int = 0) -> str:
    """A stored column in the table's type: missing parts are NULL, values meeting a variant keep their JSON value."""
    from ..schema import spark_type

    kind = spark_type(want)
    if have is None:
        return f"CAST(NULL AS {kind})"
    if have == want:
        return expr
    if want == "variant":
        if isinstance(have, str):
            return f"CAST({expr} AS VARIANT)"
        return f"try_parse_json({render(expr, have, depth)})"
    if isinstance(want, dict) and isinstance(have, dict):
        members = ", ".join(f"{literal(k)}, {conform(f'{expr}.{quoted(k)}', have.get(k), v, depth)}" for k, v in sorted(want.items()))
        return f"CASE WHEN {expr} IS NOT NULL THEN named_struct({members}) END"
    if is_list(want) and is_list(have):
        x = f"y{depth}"
        return f"transform({expr}, {x} -> {conform(x, have[1], want[1], depth + 1)})"
    if isinstance(want, str) and isinstance(have, str):
        return f"try_cast({expr} AS {kind})"
    return f"CAST(NULL AS {kind})"
