"""What a path becomes where it stands: brackets, columns on the other side, mixed documents."""

import pytest

from foliant.engine import Engine


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    e = Engine(spark, f"file://{tmp_path_factory.mktemp('typing')}/base")
    e.sql("CREATE TABLE u (id INT, note TEXT, d DATE, data JSON)")
    e.sql("""INSERT INTO u VALUES
        (1, 'Ada', DATE '2024-01-05', '{"name":"Ada","age":39,"n":5,"v":7,"b":true,"s":"x","d":"2024-01-31","a":["q",1],"tags":["k","l"],"f":2.5}'),
        (2, 'Zoe', DATE '2024-02-05', '{"name":"Bob","age":40,"n":"txt","v":"7","b":false,"s":"x","d":"2023-05-01","a":[true],"tags":[],"f":4}'),
        (3, '41', DATE '2024-03-05', '{"name":"Cid","age":41,"n":7,"v":2.5,"s":"y","a":[2,3]}')""")
    e.sql("CREATE TABLE o (k BIGINT, w TEXT)")
    e.sql("INSERT INTO o VALUES (5, 'Ada'), (7, 'Bob'), (9, 'x')")
    return e


CASES = [
    # brackets change nothing
    ("SELECT id FROM u WHERE (data.name) = 'Ada'", [1]),
    ("SELECT id FROM u WHERE ((data.name)) = ('Ada')", [1]),
    ("SELECT id FROM u WHERE 'Ada' = (data.name)", [1]),
    ("SELECT id FROM u WHERE (data.s) IN ('x')", [1, 2]),
    ("SELECT id FROM u WHERE (data.b)", [1]),
    ("SELECT id FROM u WHERE NOT (data.b) AND (data.age) > 39", [2]),
    ("SELECT (data.d)::date AS x FROM u WHERE id = 1", ["2024-01-31"]),
    ("SELECT (data.name) FROM u WHERE id = 1", ['"Ada"']),
    ("SELECT CAST((data.age) AS DOUBLE) AS x FROM u WHERE id = 1", [39.0]),
    ("SELECT id FROM u WHERE (data.nope) IS NULL AND (data.age) BETWEEN (39) AND (40)", [1, 2]),
    # a mixed path follows the column or the expression beside it; what does not fit is NULL
    ("SELECT id FROM u WHERE data.n = id + 4", [1, 3]),
    ("SELECT id FROM u WHERE id + 4 = data.n", [1, 3]),
    ("SELECT id FROM u WHERE data.v > id - 1", [1]),
    ("SELECT id FROM u WHERE data.v > id - 0.5", [1]),
    ("SELECT id FROM u WHERE data.n BETWEEN id AND 5", [1]),
    ("SELECT id FROM u WHERE id BETWEEN 0 AND data.n", [1, 3]),
    ("SELECT id FROM u WHERE coalesce(data.n, 0) = 5", [1]),
    ("SELECT coalesce(data.n, id) + 1 AS x FROM u", [6, 3, 8]),
    ("SELECT id FROM u WHERE data.n IN (id + 4, 100)", [1, 3]),
    ("SELECT id FROM u WHERE data.n <=> id + 4", [1, 3]),
    ("SELECT id FROM u WHERE data.n IS NOT DISTINCT FROM id + 4", [1, 3]),
    ("SELECT u.id FROM u JOIN o ON u.data.n = o.k", [1, 3]),
    ("SELECT u.id FROM u JOIN o ON u.data.n = o.k + 2", [3]),
    ("SELECT u.id FROM u JOIN (SELECT k AS z FROM o) p ON u.data.n = p.z", [1, 3]),
    ("SELECT u.id FROM u JOIN (SELECT w AS z FROM o) p ON u.data.name = p.z", [1, 2]),
    ("SELECT id FROM u WHERE data.name = note", [1]),
    ("SELECT id FROM u WHERE data.age = note", [3]),
    ("SELECT id FROM u WHERE data.name = id", []),
    ("SELECT id FROM u WHERE data.age = 'abc'", []),
    ("SELECT id FROM u WHERE data.age = '39'", [1]),
    ("SELECT id FROM u WHERE data.v = 7", [1]),
    ("SELECT id FROM u WHERE data.d < d", [2]),
    ("SELECT id FROM u WHERE data.d < DATE '2024-01-01'", [2]),
    ("SELECT id FROM u WHERE data.n > (SELECT min(k) FROM o)", [3]),
    ("SELECT id FROM u WHERE data.n IN (SELECT 5)", [1]),
    ("SELECT id FROM u WHERE data.name IN (SELECT 'Bob' AS w)", [2]),
    ("SELECT id FROM u WHERE data.n IN (SELECT k FROM o)", [1, 3]),
    ("SELECT CAST(data.v AS INT) AS x FROM u", [7, None, None]),
    ("SELECT data.n + 1 AS x FROM u", [6, None, 8]),
    ("SELECT -data.age AS x FROM u WHERE id = 1", [-39]),
    # each CASE has its own types
    ("SELECT CASE WHEN id = 1 THEN data.name ELSE 'x' END AS x, CASE WHEN id = 1 THEN 1 ELSE 2 END AS y FROM u", ["Ada", "x", "x"]),
    ("SELECT CASE WHEN id = 1 THEN 1 ELSE 2 END AS y, CASE WHEN id = 1 THEN data.name ELSE 'x' END AS x FROM u", [1, 2, 2]),
    ("SELECT CASE id WHEN data.n - 4 THEN 'a' ELSE 'b' END AS x FROM u", ["a", "b", "a"]),
    ("SELECT CASE data.n WHEN id + 4 THEN 'a' ELSE 'b' END AS x FROM u", ["a", "b", "a"]),
    ("SELECT CASE WHEN (data.b) THEN 1 ELSE 0 END AS x FROM u", [1, 0, 0]),
    ("SELECT CASE WHEN id < 3 THEN data.n ELSE id * 10 END AS x FROM u", [5, None, 30]),
    # arrays: unseen, mixed, by index
    ("SELECT array_contains(data.nope, 'x') AS x FROM u WHERE id = 1", [None]),
    ("SELECT id FROM u WHERE size(data.nope) > 0", []),
    ("SELECT id FROM u LATERAL VIEW explode(data.nope) z AS e", []),
    ("SELECT id FROM u WHERE array_contains(data.a, 'q')", [1]),
    ("SELECT id FROM u WHERE array_contains(data.a, id - 1)", [3]),
    ("SELECT id FROM u WHERE array_contains(data.tags, data.name) OR array_contains(data.tags, 'l')", [1]),
    ("SELECT size(data.a) AS x FROM u", [2, 1, 2]),
    ("SELECT e FROM u LATERAL VIEW explode(data.a) z AS e WHERE id < 3", ['"q"', "1", "true"]),
    ("SELECT data.tags[5] AS x FROM u WHERE id = 1", [None]),
    ("SELECT data.tags[id] AS x FROM u WHERE id = 1", ["l"]),
    ("SELECT data.nope[0] AS x FROM u WHERE id = 1", [None]),
    ("SELECT data.a[0] AS x FROM u", ['"q"', "true", "2"]),
    ("SELECT id FROM u WHERE data.tags[0] = 'k'", [1]),
    ("SELECT id FROM u WHERE data.a[1] = id", [1, 3]),
    ("SELECT id FROM u WHERE data.a[1] = id + 0 OR data.a[1] = 3", [1, 3]),
    # arguments
    ("SELECT CAST(date_add(d, data.age) AS STRING) AS x FROM u WHERE id = 1", ["2024-02-13"]),
    ("SELECT year(data.d) AS x FROM u", [2024, 2023, None]),
    ("SELECT left(data.name, data.n) AS x FROM u", ["Ada", None, "Cid"]),
    ("SELECT extract(MONTH FROM data.d) AS x FROM u WHERE id = 1", [1]),
    ("SELECT upper((data.name)) AS x FROM u WHERE id = 1", ["ADA"]),
    ("SELECT round(data.f, 0) AS x FROM u WHERE id = 1", [3.0]),
    ("SELECT sum(data.n) FILTER (WHERE (data.b) OR id = 3) AS x FROM u", [12.0]),
    ("SELECT greatest(data.n, 6) AS x FROM u", [6, 6, 7]),
    ("SELECT if((data.b), data.name, 'no') AS x FROM u", ["Ada", "no", "no"]),
    ("SELECT rank() OVER (ORDER BY data.age::int DESC) AS x FROM u WHERE id = 3", [1]),
    # grouping by a path
    ("SELECT count(*) AS x FROM u GROUP BY data.s HAVING data.s = 'x'", [2]),
    ("SELECT upper(data.s) AS x FROM u GROUP BY data.s", ["X", "Y"]),
    ("SELECT max(data.age) AS x FROM u GROUP BY data.s HAVING max(data.age) > 40 AND data.s <> 'z'", [41]),
    ("SELECT data.b AS x FROM u GROUP BY data.b HAVING NOT (data.b)", ["false"]),
    ("SELECT CASE WHEN data.s = 'x' THEN count(*) ELSE 0 END AS x FROM u GROUP BY data.s", [2, 0]),
    ("SELECT data.s AS x FROM u GROUP BY data.s HAVING max(data.n) = 5 OR data.s IN ('z')", ['"x"']),
    ("SELECT count(*) AS x FROM u HAVING max(data.n) > min(id) + 5", [3]),
    ("SELECT id FROM (SELECT id, CASE WHEN lag(data.n) OVER (ORDER BY id) = id + 3 THEN 1 END AS x FROM u) q WHERE x = 1", [2]),
    ("SELECT max(data.v) AS x FROM u", ["7"]),
    # rows, value by value
    ("SELECT id FROM u WHERE (data.name, data.age) IN (('Ada', 39), ('Cid', 40))", [1]),
    ("SELECT id FROM u WHERE (data.n, data.s) = (id + 4, 'y')", [3]),
    # the two functions, on anything
    ("SELECT json_display(id) AS x FROM u", ["1", "2", "3"]),
    ("SELECT json_display(note) AS x FROM u WHERE id = 1", ['"Ada"']),
    ("SELECT json_display(array(1, NULL, 2)) AS x FROM u WHERE id = 1", ["[1,2]"]),
    ("SELECT json_display(named_struct('a', id, 'b', NULLIF(id, 1))) AS x FROM u WHERE id < 3", ['{"a":1}', '{"a":2,"b":2}']),
    ("SELECT get_field_typed(id, '') AS x FROM u WHERE id = 1", ["1"]),
    ("SELECT get_field_typed(id, 'a') AS x FROM u WHERE id = 1", [None]),
    ("SELECT get_field_typed(id, '', CAST(NULL AS DOUBLE)) AS x FROM u WHERE id = 1", [1.0]),
    ("SELECT id FROM u WHERE get_field_typed(data, 'age') > 40", [3]),
    ("SELECT get_field_typed('{\"a\":{\"b\":4}}', 'a.b', NULL::bigint) AS x", [4]),
    ("SELECT json_display(data) AS x FROM (SELECT data FROM u WHERE id = 3) q", ['{"a":[2,3],"age":41,"f":null}'.replace(',"f":null', "") and '{"a":[2,3],"age":41,"n":7,"name":"Cid","s":"y","v":2.5}']),
]


@pytest.mark.parametrize(("statement", "want"), CASES)
def test_path(engine, statement, want):
    got = [r[0] for r in engine.sql(statement).collect()]
    got = [str(x) if type(x).__name__ in ("date", "Decimal") else x for x in got]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_create_as_keeps_documents(engine):
    engine.sql("CREATE TABLE copy_of AS SELECT id, data FROM u")
    assert [r[0] for r in engine.sql("SELECT data.age + 1 AS x FROM copy_of WHERE data.name = 'Ada'").collect()] == [40]
    assert engine.table("copy_of").json_columns() == ["data"]


def test_alias_of_a_bracketed_path(engine):
    assert engine.sql("SELECT (data.name), data.age, get_field_typed(data, 's') AS t FROM u").columns == ["name", "age", "t"]
