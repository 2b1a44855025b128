"""Semantics of queries that the shared tables don't show: nulls, texts, errors."""

import pytest

from tessella.errors import EngineError
from tessella.session import Engine

NULLS = [(1, "a", 1.0, True), (2, None, None, None), (3, "", 0.0, False), (4, "a", None, True), (5, "z", None, None), (6, "z", None, False)]


@pytest.fixture(scope="module")
def s(spark):
    e = Engine(spark)
    e.attach("t", spark.createDataFrame(NULLS, "id int, grp string, x double, flag boolean"))
    e.attach("w", spark.createDataFrame([(p,) for p in ("river", "riverbed", "delta", "5% off", "_under", "back\\", "two\nlines")], "v string"))
    e.attach("n", spark.createDataFrame([("1",), ("x",), (" 2.5 ",), ("NaN",), ("1e2",), (None,)], "v string"))
    e.attach("j", spark.createDataFrame([(1, '{"a": {"b": [1, "two", null, {"c": 3.50}]}, "t": true}'), (2, "not json"), (3, None), (4, '{"a": 7, "k e": "v"}')], "id int, d string"))
    e.attach("arrays", spark.createDataFrame([(1, [1.0])], "id int, v array<double>"))
    return e.session()


def ids(s, where, params=None):
    return sorted(r["id"] for r in s.execute(f"SELECT id FROM t WHERE {where}", params))


@pytest.mark.parametrize(
    "where, want",
    [
        ("x = 1", [1]), ("NOT x = 1", [3]), ("x = NULL", []), ("x IS NULL", [2, 4, 5, 6]), ("NOT (x IS NULL)", [1, 3]), ("flag", [1, 4]), ("NOT flag", [3, 6]), ("grp", [1, 4, 5, 6]), ("x", [1]), ("NOT x", [3]),
        ("grp IN ('a', NULL)", [1, 4]), ("grp NOT IN ('a', NULL)", []), ("grp NOT IN ('a')", [3, 5, 6]), ("x > 0 OR flag", [1, 4]), ("x > 0 AND flag OR id = 5", [1, 5]), ("NOT (x > 0 AND flag)", [3, 6]), ("NOT (x > 0 OR id = 3)", []),
        ("id NOT IN (SELECT id FROM t WHERE id > 100)", [1, 2, 3, 4, 5, 6]), ("x NOT IN (SELECT id FROM t WHERE id > 100)", [1, 3]), ("grp NOT IN (SELECT grp FROM t WHERE id < 3)", [3, 5, 6]), ("NOT (grp IN (SELECT grp FROM t WHERE id < 3))", [3, 5, 6]),
        ("grp IN (SELECT grp FROM t WHERE id < 3) OR id = 6", [1, 4, 6]), ("id = 2 OR NOT (grp IN (SELECT grp FROM t WHERE id < 3) OR id = 3)", [2, 5, 6]), ("5 IN (SELECT id FROM t)", [1, 2, 3, 4, 5, 6]), ("EXISTS (SELECT id FROM t WHERE id = 9) OR id = 1", [1]),
        ("id > (SELECT AVG(id) FROM t)", [4, 5, 6]), ("id = (SELECT id FROM t ORDER BY id DESC LIMIT 1)", [6]), ("x = (SELECT x FROM t WHERE id = 99)", []), ("id = '3'", [3]), ("1 = 1", [1, 2, 3, 4, 5, 6]), ("'01' = '1'", []), ("3 < id", [4, 5, 6]), ("id >= 2 AND id < 4", [2, 3]),
        ("flag = 1", [1, 4]), ("flag = 'false'", [3, 6]), ("CURRENT_TIMESTAMP > '2020-01-01'", [1, 2, 3, 4, 5, 6]),
    ],
)
def test_predicates(s, where, want):
    assert ids(s, where) == want


@pytest.mark.parametrize("pattern, want", [("%", 7), ("%ver%", 2), ("%ta", 1), (r"5\% o%", 1), (r"\_u%", 1), ("back\\", 1), (r"\r%", 2), ("two%lines", 1), ("R%", 0), ("delt_", 1), ("", 0)])
def test_like(s, pattern, want):
    assert s.query("SELECT COUNT(*) AS n FROM w WHERE v LIKE ?", [pattern]).first()["n"] == want


@pytest.mark.parametrize(
    "sql, code",
    [
        ("SELECT nope FROM t", "UNKNOWN_COLUMN"), ("SELECT id FROM nope", "TABLE_NOT_FOUND"), ("SELECT id FROM nowhere.nope", "DATABASE_NOT_FOUND"), ("SELECT id FROM t WHERE id > 2.5", "INVALID_VALUE"), ("SELECT id FROM t WHERE grp = 5", "INVALID_VALUE"), ("SELECT id FROM t WHERE id IN (1, 'x')", "INVALID_VALUE"),
        ("SELECT id FROM t WHERE grp = x", "SQL_SEMANTIC"), ("SELECT id FROM t WHERE id LIKE '1%'", "INVALID_VALUE"), ("SELECT id FROM t AS a JOIN t AS b ON a.id = b.id", "AMBIGUOUS_COLUMN"), ("SELECT a.id FROM t AS a JOIN t AS a ON 1 = 1", "SQL_SEMANTIC"), ("SELECT id, id FROM t", "SQL_SEMANTIC"),
        ("SELECT id, COUNT(*) FROM t GROUP BY grp", "SQL_SEMANTIC"), ("SELECT grp FROM t GROUP BY grp HAVING nope = 1", "UNKNOWN_COLUMN"), ("SELECT id FROM t WHERE id = ?", "MISSING_PARAMETER"), ("SELECT id FROM t WHERE id = :x", "MISSING_PARAMETER"), ("SELECT id FROM t LIMIT :x", "MISSING_PARAMETER"),
        ("SELECT JSON_EXTRACT(grp, '$') FROM t", "SQL_SEMANTIC"), ("SELECT COUNT(*) AS n FROM t GROUP BY grp ORDER BY nope", "UNKNOWN_COLUMN"),
    ],
)
def test_errors(s, sql, code):
    with pytest.raises(EngineError) as e:
        s.execute(sql)
    assert e.value.code == code


def test_aggregates(s):
    assert s.execute("SELECT SUM(x) AS a, SUM(grp) AS b, AVG(grp) AS c, SUM(flag) AS d, COUNT(x) AS n, COUNT(*) AS m, MIN(flag) AS low, MAX(grp) AS high FROM t").fetchall() == [
        {"a": 1.0, "b": 0.0, "c": None, "d": 0.0, "n": 2, "m": 6, "low": False, "high": "z"}
    ]
    assert s.execute("SELECT SUM(v) AS a, AVG(v) AS b FROM n").fetchall() == [{"a": 103.5, "b": 34.5}]
    got = {r["grp"]: (r["count"], r["sum_x"]) for r in s.execute("SELECT grp, COUNT(*), SUM(x) FROM t GROUP BY grp")}
    assert got == {"a": (2, 1.0), None: (1, 0.0), "": (1, 0.0), "z": (2, 0.0)}
    assert s.execute("SELECT COUNT(*) AS n, MAX(x) AS x FROM t WHERE id > 100").fetchall() == [{"n": 0, "x": None}]


def test_order(s):
    assert [r["x"] for r in s.execute("SELECT x FROM t ORDER BY x, id")] == [None] * 4 + [0.0, 1.0]
    assert [r["id"] for r in s.execute("SELECT id FROM t ORDER BY x DESC, id DESC LIMIT 2 OFFSET 1")] == [3, 6]


def test_json(s):
    def one(path, where="id = 1"):
        return [r["v"] for r in s.execute(f"SELECT JSON_EXTRACT(d, ?) AS v FROM j WHERE {where}", [path])]

    assert one("$.a.b[0]") == [1] and one("$.a.b[1]") == ["two"] and one("$.a.b[2]") == [None] and one("$['a'].b[3].c") == [3.5] and one("$.a.b[3]") == ['{"c":3.5}'] and one("$.t") == [True]
    assert one("$.a", "id > 1 AND id < 4") == [None, None] and one('$["k e"]', "id = 4") == ["v"]

    def match(where):
        return [r["id"] for r in s.execute(f"SELECT id FROM j WHERE {where}")]

    assert match("JSON_EXTRACT(d, '$.a') > 6.5") == [4] and match("JSON_EXTRACT(d, '$.a.b[1]') = 'two'") == [1] and match("JSON_EXTRACT(d, '$.t') = TRUE") == [1]
    assert match("JSON_EXTRACT(d, '$.nope') IS NULL") == [1, 2, 3, 4] and match("JSON_EXTRACT(JSON_EXTRACT(d, '$.a'), '$.b[0]') = 1") == [1] and match("JSON_EXTRACT(d, '$.a') IN (7, 8)") == [4]


def test_nested_columns_are_json(s, spark):
    assert s.execute("SELECT v, JSON_EXTRACT(v, '$[0]') AS first FROM arrays").fetchall() == [{"v": "[1.0]", "first": 1.0}]
    with pytest.raises(EngineError) as e:
        Engine(spark).attach("x", spark.sql("SELECT 1 AS a, INTERVAL 1 DAY AS b"))
    assert e.value.code == "SCHEMA_ERROR" and "b" in e.value.message


def test_json_values_keep_their_type(s):
    """In rows; a DataFrame's column has one type, text."""
    sql = "SELECT id, JSON_EXTRACT(d, '$.a') AS a, JSON_EXTRACT(d, '$.t') AS t FROM j WHERE id IN (1, 4) ORDER BY id"
    assert s.execute(sql).fetchall() == [{"id": 1, "a": '{"b":[1,"two",null,{"c":3.5}]}', "t": True}, {"id": 4, "a": 7, "t": None}]
    assert [(r["a"], r["t"]) for r in s.query(sql).where("id = 4").collect()] == [("7", None)] and s.query(sql).columns == ["id", "a", "t"]
    assert s.execute("SELECT JSON_EXTRACT('{\"n\": \"5\"}', '$.n') AS v FROM j LIMIT 1").fetchall() == [{"v": "5"}]


def test_names(s):
    assert s.query("SELECT T.ID, `grp` AS \"G\" FROM T AS t LIMIT 0").columns == ["t.id", "g"]
    assert s.query("SELECT * FROM t AS a JOIN w AS b ON a.grp = b.v").columns == ["a.id", "a.grp", "a.x", "a.flag", "b.v"]


def test_params(s):
    assert ids(s, "id = ? OR id = ?", [1, 3]) == [1, 3] and ids(s, "id = :a", {"a": 2}) == [2] and ids(s, "id = :a", {":a": 2}) == [2]
    assert s.query("SELECT id FROM t ORDER BY id LIMIT ? OFFSET ?", [2, 1]).count() == 2
