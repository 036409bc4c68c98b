import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from foliant.operators.convert import converted
from foliant.operators.infer import inspect
from foliant.plans.hints import Hint, parse_hints
from foliant.schema import infer, infer_root, known, merge, spark_type, with_path


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("null", "long", "long"),
        ("long", "double", "double"),
        ("ulong", "long", "ulong"),
        ("ulong", "double", "double"),
        ("boolean", "long", "variant"),
        ("string", "long", "variant"),
        (["list", "unknown"], ["list", "long"], ["list", "long"]),
        (["list", "string"], ["list", "long"], ["list", "variant"]),
        ({"a": "long"}, {"a": "double", "b": "string"}, {"a": "double", "b": "string"}),
        ({"a": "long"}, "string", "variant"),
        ({"a": "long"}, ["list", "long"], "variant"),
        ("variant", {"a": "long"}, "variant"),
    ],
)
def test_merge(a, b, want):
    assert merge(a, b) == want == merge(b, a)


DOCUMENTS = [
    ('{"city":"Oslo","floor":3,"open":false}', {"city": "string", "floor": "long", "open": "boolean"}),
    ('{"heights":[4,5],"labels":["n","s"]}', {"heights": ["list", "long"], "labels": ["list", "string"]}),
    ('[{"kg":2},{"kg":"two","unit":"t"}]', {"value": ["list", {"kg": "variant", "unit": "string"}]}),
    ('[7,0.5,"seven",false]', {"value": ["list", "variant"]}),
    ("[[9],[8,7],[]]", {"value": ["list", ["list", "long"]]}),
    ('{"rows":[[],["x"],[]]}', {"rows": ["list", ["list", "string"]]}),
    ('[{"tag":"q"},{},{"tag":null,"at":6}]', {"value": ["list", {"tag": "string", "at": "long"}]}),
    ('{"void":{}}', {"void": "null"}),
    ("18446744073709551615", {"value": "ulong"}),
    ("18446744073709551616", {"value": "double"}),
    ("-9223372036854775809", {"value": "double"}),
    ('{"a":[1,9223372036854775808]}', {"a": ["list", "ulong"]}),
    ("12", {"value": "long"}),
    ("1.0", {"value": "double"}),
    ('{"a":[1,2.5],"b":[1,1e3],"d":[true,null]}', {"a": ["list", "double"], "b": ["list", "double"], "d": ["list", "boolean"]}),
    ('{"x y":{"`":1,"ö":"z"},"1a":2.25}', {"1a": "double", "x y": {"`": "long", "ö": "string"}}),
    ('{"s":"BIGINT<a: >,`"}', {"s": "string"}),
    ("{}", {}),
    ("null", {"value": "null"}),
]


@pytest.mark.parametrize(("text", "want"), DOCUMENTS)
def test_infer(text, want):
    assert infer_root(json.loads(text)) == want


def test_inference_in_the_jvm_agrees(spark):
    """Each document alone, by the same pass that an insert makes."""
    s = spark.newSession()
    s.conf.set("spark.sql.caseSensitive", "true")
    s.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    columns = {f"c{k}": [] for k in range(len(DOCUMENTS))}
    df = s.createDataFrame([tuple(t for t, _ in DOCUMENTS)], ", ".join(f"{c} string" for c in columns))
    got = inspect(df, columns)
    assert [known(got[f"c{k}"]) for k in range(len(DOCUMENTS))] == [known(want) for _, want in DOCUMENTS]


MALFORMED = ["", "  ", "{", '{"a":NaN}', "1 2", '{"a":1} x', '{"a":1}{', "[1] x", "1] x", "1],[2", '1,"k":2', "'a'", "01", "nul", '{"a":1},{"b":2}', '{"a" 1}', "\ufeff1", '{"a":1}]', "[1,2", '"x', "1 /* c */"]


def test_malformed_documents_are_null_alone_and_among_others(spark):
    rows = [(k, t) for k, t in enumerate([*MALFORMED, None])] + [(100, ' {"b":[1]} '), (101, "null"), (102, "7")]
    df = spark.createDataFrame(rows, "id int, d string")
    got = {r.id: r.d for r in df.select("id", converted("d", {"a": "long", "b": ["list", "long"], "value": "long"}).alias("d")).collect()}
    assert {k for k, v in got.items() if v is not None} == {100, 101, 102} and got[100].b == [1] and got[102].value == 7
    assert inspect(df, {"d": []}) == {"d": {"b": ["list", "long"], "value": "long"}}
    assert inspect(df.where("id < 100"), {"d": []}) == {"d": "null"}


def test_late_elements_count():
    assert infer([1] * 200 + ["x"]) == ["list", "variant"]


def test_spark_types():
    assert spark_type(known({"a": "long", "b": ["list", {"c": "double", "d": "null"}], "e": ["list", "unknown"]})) == "struct<`a`: bigint, `b`: array<struct<`c`: double>>>"
    assert known({"a": {"b": "null"}}) is None
    assert with_path({"a": "string"}, ["a", "b"], "int") == {"a": {"b": "int"}}


def test_hints():
    assert parse_hints("age INT NOT NULL, a.b DOUBLE PRECISION, s VARCHAR(20) NULL n BIGINT UNSIGNED") == [
        Hint(["age"], "int", False),
        Hint(["a", "b"], "double"),
        Hint(["s"], "string"),
        Hint(["n"], "ulong"),
    ]
    assert parse_hints("x INT8")[0].type == "long" and Hint(["x"], "ubyte").bounds() == (0, 255)
    for bad in ("a DATE", "a NUMERIC", "a INT NOT", "a"):
        with pytest.raises(ValueError, match="a"):
            parse_hints(bad)


values = st.recursive(st.none() | st.booleans() | st.integers(-(1 << 63), (1 << 63) - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=5), lambda c: st.lists(c, max_size=3) | st.dictionaries(st.text(max_size=3), c, max_size=3), max_leaves=8)


@given(values, values, values)
@settings(max_examples=200, deadline=None)
def test_merge_is_commutative_and_associative(a, b, c):
    x, y, z = infer(a), infer(b), infer(c)
    assert merge(x, y) == merge(y, x)
    assert merge(merge(x, y), z) == merge(x, merge(y, z))
    assert merge(x, x) == x
