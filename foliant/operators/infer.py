"""What is in a column of JSON texts, in one pass: the merged type, and what breaks hints or NOT NULL.

Each row's shape is made in the JVM by ``schema_of_variant``; only distinct shapes, few in most tables, go to Python,
where they are merged by the rules of ``schema``. A list that holds empty objects beside other values is one of variants.
"""

from __future__ import annotations

import json
import re
import sys
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema
from ..functions.expressions import literal
from ..plans.hints import Hint
from ..schema import Type, infer_root, merge, quoted
from .convert import HintError, marked, violation, whole

# sent with the task, so that Python workers need not have this package
for _module in (sys.modules[__name__], schema):
    cloudpickle.register_pickle_by_value(_module)

_PART = re.compile(r"\s*(`(?:[^`]|``)*`|[A-Za-z0-9_]+(?:\(\d+,\s*-?\d+\))?|[<>,:])")
_SCALARS = {"BIGINT": "long", "DOUBLE": "double", "FLOAT": "double", "STRING": "string", "BOOLEAN": "boolean", "VOID": "null", "VARIANT": "variant"}
#: Whole numbers of 19 or 20 digits lie on both sides of the 64-bit bounds: their rows are looked at one by one.
_OPEN = r"DECIMAL\((19|20),0\)"


def shape(text: str) -> Type:
    """The type that the text of a variant's schema stands for."""
    parts, at = _PART.findall(text), 0

    def read() -> Type:
        nonlocal at
        word = parts[at]
        at += 1
        if word == "ARRAY":
            at += 1
            item = read()
            at += 1
            return ["list", "unknown" if item == "null" else item]
        if word == "OBJECT":
            at += 1
            members: dict[str, Type] = {}
            while parts[at] != ">":
                name = parts[at]
                at += 2
                members[name[1:-1].replace("``", "`") if name[0] == "`" else name] = read()
                at += parts[at] == ","
            at += 1
            return dict(sorted(members.items())) or "null"
        if word.startswith("DECIMAL"):
            return "double"
        return _SCALARS.get(word, "string")

    return read()


def rooted(t: Type, text: str) -> Type:
    """A document's members; what is no object is the member ``value`` of one."""
    if text.startswith("OBJECT<"):
        return {} if t == "null" else t
    return {"value": t}


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merges the shapes and documents (kinds s and d) of each column; errors (kind e) stay as they are."""
    found: dict[int, Type] = {}
    errors = []
    for batch in batches:
        for column, kind, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            if kind == "e":
                errors.append(text)
                continue
            if kind == "s":
                t = rooted(shape(text), text)
            else:
                t = json.loads(text) if kind == "t" else infer_root(json.loads(text))
            found[column] = merge(found.get(column, "null"), t or "null")
    rows = [(k, "t", json.dumps(t, ensure_ascii=False)) for k, t in found.items()] + [(-1, "e", e) for e in sorted(set(errors))[:1]]
    if rows:
        columns = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1]), pa.array(columns[2])], names=["c", "k", "t"])


def inspect(rows: DataFrame, documents: dict[str, list[Hint]], required: list[str] | None = None) -> dict[str, Type]:
    """The type of each column of documents ("null" if there is none); raises for the first violation found.

    One pass: each row gives a shape for each column, and what is wrong with it; equal ones meet before they leave the
    JVM, 16 tasks merge what is left, and the driver gets 16 rows at most for each column.
    """
    names, required = list(documents), required or []
    # step by step, so that each text is parsed once
    steps = rows.select(*(F.col(quoted(n)).alias(f"t{k}") for k, n in enumerate(names)), *(F.col(quoted(n)).isNull().alias(f"m{k}") for k, n in enumerate(required)))
    steps = steps.select("*", *(F.expr(marked(f"t{k}")).alias(f"b{k}") for k in range(len(names))))
    steps = steps.select("*", *(F.expr(whole(f"b{k}")).alias(f"v{k}") for k in range(len(names))))
    steps = steps.select("*", *(F.expr(f"schema_of_variant(v{k})").alias(f"s{k}") for k in range(len(names))))
    each = []
    for k, n in enumerate(names):
        each.append(f"CASE WHEN s{k} RLIKE {literal(_OPEN)} THEN named_struct('c', {k}, 'k', 'd', 't', t{k}) ELSE named_struct('c', {k}, 'k', 's', 't', s{k}) END")
        if any(h.type != "string" or not h.nullable for h in documents[n]):
            each.append(f"named_struct('c', -1, 'k', 'e', 't', {violation(f'v{k}', n, documents[n])})")
    if required:
        missing = " OR ".join(f"m{k}" for k in range(len(required)))
        each.append(f"named_struct('c', -1, 'k', 'e', 't', CASE WHEN {missing} THEN 'a NOT NULL column got NULL' END)")
    types: dict[str, Type] = dict.fromkeys(names, "null")
    if not each:
        return types
    seen = steps.select(F.expr(f"inline(array({', '.join(each)}))")).where("t IS NOT NULL").distinct()
    for r in seen.repartition(16).mapInArrow(_merge, "c int, k string, t string").collect():
        if r.k == "e":
            raise (ValueError if r.t.startswith("a NOT NULL") else HintError)(r.t)
        types[names[r.c]] = merge(types[names[r.c]], json.loads(r.t))
    return {n: t if isinstance(t, dict) else "null" for n, t in types.items()}
