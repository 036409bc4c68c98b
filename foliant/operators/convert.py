"""From JSON text to typed nested columns by ``from_json``, and the test of type hints.

Inference and conversion read a text by one parser, and agree on which texts are JSON.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.expressions import literal, variant_path
from ..plans.hints import Hint
from ..schema import Type, known, quoted, spark_type


class HintError(ValueError):
    pass


def marked(column: str) -> str:
    """The text as the first item of a list that ends in a mark.

    Spark's parser stops after the first value and lets anything follow. The mark is the second item only if the text is
    one value and nothing else.
    """
    return f"try_parse_json(concat('[', {quoted(column)}, ',{MARK}]'))"


def whole(both: str) -> str:
    """The document as a variant, from what ``marked`` gave; NULL for blank text and for what is not one JSON value."""
    return f"CASE WHEN try_variant_get({both}, '$[1]', 'bigint') = {MARK} THEN try_variant_get({both}, '$[0]', 'variant') END"


#: A number that no document is expected to guess; a text that closes the list early would need it at the same place.
MARK = 4_207_851_263_940_718_529


def document(column: str) -> str:
    """The text if it is JSON, with a root that is no object put under ``value``; NULL for blank or malformed text."""
    c = quoted(column)
    return f"CASE WHEN NOT coalesce(try_variant_get({marked(column)}, '$[1]', 'bigint') = {MARK}, false) THEN NULL WHEN ltrim(' \\t\\r\\n', {c}) LIKE '{{%' THEN {c} ELSE concat('{{\"value\":', {c}, '}}') END"


def converted(column: str, t: Type) -> Column:
    """The column as nested columns of the type; values that do not fit are NULL, other values of string members are
    kept as their JSON text."""
    t = known(t)
    if t is None:
        return F.lit(None).cast("struct<value: string>")
    return F.expr(f"from_json({document(column)}, {literal(spark_type(t))})")


def violation(root: str, column: str, hints: list[Hint]) -> str:
    """SQL for what is wrong with a document (a variant) by the hints of its column, or NULL."""
    tests = []
    for h in hints:
        v = f"try_variant_get({root}, {variant_path(h.path)}, 'variant')"
        where = ".".join(h.path)
        if not h.nullable:
            tests.append(f"WHEN {v} IS NULL THEN {literal(f'column {column!r} is missing required path {where!r}')}")
            tests.append(f"WHEN is_variant_null({v}) THEN {literal(f'column {column!r} has null for required path {where!r}')}")
        kind = f"schema_of_variant({v})"
        if h.type == "boolean":
            bad = f"{kind} <> 'BOOLEAN'"
        elif h.type in ("float", "double"):
            bad = f"NOT ({kind} IN ('BIGINT', 'DOUBLE') OR {kind} LIKE 'DECIMAL%')"
        elif h.type == "string":
            continue  # any value has a text
        else:
            low, high = h.bounds()
            bad = f"NOT ({kind} = 'BIGINT' OR {kind} LIKE 'DECIMAL%,0)') OR coalesce(try_variant_get({v}, '$', 'decimal(38,0)') NOT BETWEEN {low} AND {high}, true)"
        # the wording of a mismatch is a fixed value
        tests.append(f"WHEN {v} IS NOT NULL AND NOT is_variant_null({v}) AND ({bad}) THEN {literal(f'column {column!r} has type mismatch at {where!r}: expected {h.name()}')}")
    return f"CASE WHEN {root} IS NOT NULL THEN CASE {' '.join(tests)} END END" if tests else "CAST(NULL AS STRING)"
