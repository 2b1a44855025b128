"""Tables of the engine: rows, keys, sequences, definitions, transactions."""

import pytest
from pyspark.sql import functions as F

from tessella.errors import EngineError
from tessella.session import connect


def fails(db, sql, code, params=None):
    with pytest.raises(EngineError) as e:
        db.execute(sql, params)
    assert e.value.code == code


def test_each_type_keeps_its_values(db):
    """A value of each type, its extremes, null, and what is refused."""
    kinds = {
        "TINYINT": ([-128, 127], 128), "INT": ([-(2**31), 2**31 - 1], 2**31), "BIGINT": ([-(2**63), 2**63 - 1], "9x"), "FLOAT": ([0.5, -2.0], "much"), "DOUBLE": ([1e300, -0.1], "much"), "REAL": ([3.25], True), "BOOLEAN": ([True, False], 2), "VARCHAR(3)": (["abc", "", "äöü"], "abcd"),
        "TEXT": (["t" * 65_535], "t" * 65_536), "LONGTEXT": (["l" * 100_000], 5), "BLOB": ([b"", b"\x00\xff"], None), "TIMESTAMP": (["1999-12-31 23:59:59.999999"], "soon"), "DATETIME": (["2031-01-01 00:00:00.000000"], "2031-13-01"), "UUID": (["123e4567-e89b-42d3-a456-426614174000"], "123e4567"), "JSON": (['{"k":[1,null]}', "3"], "{"),
    }
    for n, (kind, (values, bad)) in enumerate(kinds.items()):
        db.execute(f"CREATE TABLE k{n} (n INT PRIMARY KEY AUTO_INCREMENT, v {kind})")
        for v in (*values, None):
            db.execute(f"INSERT INTO k{n} (v) VALUES (?)", [v])
        assert [r["v"] for r in db.execute(f"SELECT v FROM k{n} ORDER BY n")] == [*values, None], kind
        if bad is not None:
            fails(db, f"INSERT INTO k{n} (v) VALUES (?)", "INVALID_VALUE", [bad])
    db.execute("CREATE TABLE b (v BINARY(3))")
    db.execute("INSERT INTO b VALUES (X'01'), (X'010203')")
    assert [r["v"] for r in db.execute("SELECT v FROM b LIMIT 2")] == [b"\x01\0\0", b"\x01\x02\x03"]
    fails(db, "INSERT INTO b VALUES (X'01020304')", "INVALID_VALUE")


def test_keys_and_sequences(db):
    db.execute("CREATE TABLE boats (no BIGINT PRIMARY KEY AUTO_INCREMENT, hull VARCHAR(8) NOT NULL UNIQUE, length DOUBLE, afloat BOOLEAN DEFAULT TRUE INDEX, tag UUID DEFAULT UUID())")
    assert db.execute("INSERT INTO boats (hull, length) VALUES ('tern', 4.5), ('gull', 9)").last_insert_id == 2
    fails(db, "INSERT INTO boats (hull) VALUES ('gull')", "UNIQUE_VIOLATION")
    fails(db, "INSERT INTO boats (hull) VALUES (NULL)", "NOT_NULL_VIOLATION")
    assert db.execute("UPDATE boats SET length = 10.5 WHERE hull LIKE 'g%'").affected_rows == 1
    db.execute("ALTER TABLE boats AUTO_INCREMENT = 90")
    assert db.execute("INSERT INTO boats (hull) VALUES ('skua')").last_insert_id == 90
    assert [(r["no"], r["hull"], r["length"], r["afloat"]) for r in db.execute("SELECT * FROM boats ORDER BY no")] == [(1, "tern", 4.5, True), (2, "gull", 10.5, True), (90, "skua", None, True)]
    assert len({r["tag"] for r in db.execute("SELECT tag FROM boats")}) == 3
    d = {r["column"]: (r["key"], r["default"], r["auto_increment"]) for r in db.execute("DESCRIBE boats")}
    assert d == {"no": ("PRI", None, True), "hull": ("UNI", None, False), "length": ("", None, False), "afloat": ("MUL", "True", False), "tag": ("", "UUID()", False)}


def test_batches_are_atomic(db):
    db.execute("CREATE TABLE plates (plate VARCHAR(9) UNIQUE, town VARCHAR(9), no INT, UNIQUE both (town, no))")
    fails(db, "INSERT INTO plates VALUES ('q1', 'x', 1), ('q2', 'x', 2), ('q1', 'x', 3)", "UNIQUE_VIOLATION")
    assert db.query("SELECT * FROM plates").count() == 0
    before = [("q1", "x", 1), ("q2", "x", 2), (None, "y", 1), (None, None, 1)]
    db.execute("INSERT INTO plates VALUES (?, ?, ?), (?, ?, ?), (?, ?, ?), (?, ?, ?)", [v for r in before for v in r])
    for sql in ("UPDATE plates SET plate = 'q9' WHERE no < 3", "UPDATE plates SET no = 1 WHERE plate = 'q2'", "UPDATE plates SET town = 'x'", "UPDATE plates SET town = 'x', no = 2 WHERE plate IS NULL", "UPDATE plates SET plate = 'q2' WHERE plate = 'q1'"):
        fails(db, sql, "UNIQUE_VIOLATION")
    key = lambda rows: sorted(rows, key=repr)
    assert key((r["plate"], r["town"], r["no"]) for r in db.execute("SELECT * FROM plates")) == key(before)
    assert db.execute("UPDATE plates SET plate = NULL").affected_rows == 4 and db.execute("UPDATE plates SET no = 5 WHERE town = 'y'").affected_rows == 1
    many = ", ".join(f"(DEFAULT, {k})" for k in range(3000))
    db.execute("CREATE TABLE long (n INT PRIMARY KEY AUTO_INCREMENT, v INT)")
    assert db.execute(f"INSERT INTO long VALUES {many}").last_insert_id == 3000


def test_sequences_and_defaults(db):
    db.execute("CREATE TABLE s (id INT AUTO_INCREMENT UNIQUE, v INT DEFAULT 7)")
    assert db.execute("INSERT INTO s DEFAULT VALUES").last_insert_id == 1
    assert db.execute("INSERT INTO s VALUES (10, DEFAULT), (NULL, 1)").last_insert_id == 11
    assert db.execute("SELECT id, v FROM s ORDER BY id").fetchall() == [{"id": 1, "v": 7}, {"id": 10, "v": 7}, {"id": 11, "v": 1}]
    db.execute("TRUNCATE s")
    assert db.execute("INSERT INTO s (v) VALUES (1)").last_insert_id == 1
    fails(db, "INSERT INTO s (v, v) VALUES (1, 2)", "SQL_SEMANTIC")
    fails(db, "INSERT INTO s (v) VALUES (1, 2)", "SQL_SEMANTIC")
    fails(db, "INSERT INTO s (nope) VALUES (1)", "UNKNOWN_COLUMN")


def test_limit_without_order_is_insertion_order(db):
    db.execute("CREATE TABLE q (v INT)")
    for k in range(4):
        db.execute(f"INSERT INTO q VALUES ({9 - 2 * k}), ({8 - 2 * k})")
    assert [r["v"] for r in db.execute("SELECT v FROM q LIMIT 3 OFFSET 1")] == [8, 7, 6]
    db.execute("UPDATE q SET v = 0 WHERE v = 8")
    assert [r["v"] for r in db.execute("SELECT v FROM q LIMIT 3")] == [9, 0, 7]


def test_limits_read_few_files(db):
    """LIMIT alone takes the files with the least row ids; manifests know each file's."""
    db.execute("CREATE TABLE q (v INT)")
    for k in range(5):
        db.execute(f"INSERT INTO q VALUES ({k}), ({k + 10})")
    version = db._version("main", "q")[1]
    assert sorted(version.ranges.values()) == [(2, 2 * k + 1, 2 * k + 2) for k in range(5)]
    files = lambda sql: len(db.query(sql).inputFiles())
    assert files("SELECT v FROM q LIMIT 1") == 1 and files("SELECT v FROM q LIMIT 2 OFFSET 1") == 2 and files("SELECT v FROM q LIMIT 100") == 5 and files("SELECT v FROM q WHERE v > 0 LIMIT 1") == 5
    db.execute("UPDATE q SET v = 99 WHERE v = 10")
    assert [r["v"] for r in db.execute("SELECT v FROM q LIMIT 3")] == [0, 99, 1] and files("SELECT v FROM q LIMIT 1") == 1


def test_subquery_takes_the_first_row(db):
    db.execute("CREATE TABLE q (k INT, v INT)")
    db.execute("INSERT INTO q VALUES (1, 5)")
    db.execute("INSERT INTO q VALUES (2, 6)")
    db.execute("UPDATE q SET v = 7 WHERE k = 1")
    assert db.execute("SELECT k FROM q WHERE v = (SELECT v FROM q)").fetchall() == [{"k": 1}] == db.execute("SELECT k FROM q LIMIT 1").fetchall()
    assert db.execute("SELECT k FROM q WHERE v = (SELECT v FROM q LIMIT 1 OFFSET 1)").fetchall() == [{"k": 2}]


def test_ordered_keys_change_no_result(db):
    """Random rows in a table with ordered keys and in one without, and random ranges over each column."""
    import random

    rnd = random.Random(11)
    cells = [(rnd.randint(-50, 50), rnd.choice("xyz") * rnd.randint(0, 4), rnd.choice([None, round(rnd.uniform(-1, 1), 2)])) for _ in range(120)]
    for t, keys in (("keyed", ", INDEX a (i) ORDERED, INDEX b (s) ORDERED, INDEX c (s, i) ORDERED, INDEX d (x) ORDERED"), ("bare", "")):
        db.execute(f"CREATE TABLE {t} (n INT PRIMARY KEY AUTO_INCREMENT, i INT, s VARCHAR(9), x DOUBLE{keys})")
        for part in (cells[:70], cells[70:]):
            db.execute(f"INSERT INTO {t} (i, s, x) VALUES " + ", ".join("(?, ?, ?)" for _ in part), [v for r in part for v in r])
    for _ in range(12):
        column = rnd.choice("isx")
        one = lambda: {"i": str(rnd.randint(-60, 60)), "s": f"'{rnd.choice('xyz') * rnd.randint(0, 4)}'", "x": str(round(rnd.uniform(-1, 1), 2))}[column]  # noqa: B023, E731
        where = f"{column} {rnd.choice(['<', '<=', '>', '>=', '=', '!='])} {one()} {rnd.choice(['AND', 'OR'])} {one()} {rnd.choice(['<', '>='])} {column}"
        got = [sorted(r["n"] for r in db.execute(f"SELECT n FROM {t} WHERE {where}")) for t in ("keyed", "bare")]
        assert got[0] == got[1], where


def test_dml_with_subqueries(db):
    db.execute("CREATE TABLE a (k INT, v INT)")
    db.execute("INSERT INTO a VALUES (1, 1), (2, 2), (3, 3), (NULL, 4)")
    assert db.execute("UPDATE a SET v = 0 WHERE k IN (SELECT k FROM a WHERE v > 1)").affected_rows == 2
    assert db.execute("DELETE FROM a WHERE k > (SELECT MIN(k) FROM a) OR v = 4").affected_rows == 3
    assert db.execute("SELECT * FROM a").fetchall() == [{"k": 1, "v": 1}]
    assert db.execute("DELETE FROM a WHERE k = 77").affected_rows == 0


def test_transactions(db):
    db.execute("CREATE TABLE t (k INT PRIMARY KEY, v INT)")
    db.execute("INSERT INTO t VALUES (1, 1)")
    other = db.engine.session()
    db.execute("BEGIN WORK")
    fails(db, "BEGIN", "TRANSACTION_ACTIVE")
    fails(db, "DROP TABLE t", "TRANSACTION_DDL")
    db.execute("INSERT INTO t VALUES (2, 2)")
    db.execute("UPDATE t SET v = 9")
    assert db.query("SELECT * FROM t WHERE v = 9").count() == 2 and other.query("SELECT * FROM t").count() == 1
    db.execute("ROLLBACK")
    fails(db, "COMMIT", "TRANSACTION_INACTIVE")
    assert db.execute("SELECT * FROM t").fetchall() == [{"k": 1, "v": 1}]
    db.execute("BEGIN")
    db.execute("INSERT INTO t VALUES (3, 3)")
    other.execute("INSERT INTO t VALUES (4, 4)")
    fails(db, "COMMIT", "WRITE_CONFLICT")
    assert sorted(r["k"] for r in db.execute("SELECT k FROM t")) == [1, 4]


def test_readers_keep_their_version(db):
    db.execute("CREATE TABLE t (k INT)")
    db.execute("INSERT INTO t VALUES (1)")
    before = db.query("SELECT k FROM t")
    db.execute("DELETE FROM t")
    assert before.count() == 1 and db.query("SELECT k FROM t").count() == 0


def test_alter(db):
    db.execute("CREATE TABLE t (a INT PRIMARY KEY, b VARCHAR(10), c INT)")
    db.execute("INSERT INTO t VALUES (1, '5', 2), (2, '6', NULL)")
    db.execute("ALTER TABLE t ADD COLUMN d INT NOT NULL DEFAULT 3, ADD INDEX i (c), CHANGE b bb INT, RENAME COLUMN a TO id, RENAME INDEX i TO k")
    assert db.execute("SELECT * FROM t ORDER BY id").fetchall() == [{"id": 1, "bb": 5, "c": 2, "d": 3}, {"id": 2, "bb": 6, "c": None, "d": 3}]
    assert [(r["index"], r["column"]) for r in db.execute("SHOW INDEX FROM t")] == [("primary", "id"), ("k", "c")]
    fails(db, "ALTER TABLE t DROP COLUMN c", "SCHEMA_ERROR")
    db.execute("ALTER TABLE t DROP INDEX k, DROP COLUMN c")
    fails(db, "ALTER TABLE t MODIFY bb BOOLEAN", "INVALID_VALUE")
    fails(db, "ALTER TABLE t ADD UNIQUE u (d)", "UNIQUE_VIOLATION")
    fails(db, "ALTER TABLE t ADD COLUMN e INT NOT NULL", "NOT_NULL_VIOLATION")
    db.execute("ALTER TABLE t DROP PRIMARY KEY, ADD CONSTRAINT x UNIQUE (bb), COLLATE utf8mb4_bin")
    db.execute("ALTER TABLE t RENAME TO u")
    fails(db, "SELECT * FROM t", "TABLE_NOT_FOUND")
    assert db.query("SELECT * FROM u").columns == ["id", "bb", "d"]


def test_tables_move(db):
    db.execute("CREATE DATABASE IF NOT EXISTS other")
    fails(db, "CREATE DATABASE other", "DATABASE_EXISTS")
    db.execute("CREATE TABLE t (k INT UNIQUE)")
    db.execute("INSERT INTO t VALUES (1)")
    db.execute("COPY TABLE t TO other.t2")
    db.execute("RENAME TABLE t TO r")
    db.execute("MOVE TABLE r TO other")
    fails(db, "MOVE TABLE other.r TO other.t2", "TABLE_EXISTS")
    assert [r["table"] for r in db.execute("SHOW TABLES FROM other")] == ["r", "t2"]
    fails(db, "INSERT INTO other.t2 VALUES (1)", "UNIQUE_VIOLATION")
    db.execute("USE other")
    assert db.query("SELECT k FROM t2").count() == 1
    db.execute("DROP TABLE IF EXISTS nope")
    fails(db, "DROP TABLE nope", "TABLE_NOT_FOUND")
    db.execute("DROP DATABASE other")
    assert [r["database"] for r in db.execute("SHOW DATABASES")] == ["main"]


def test_maintenance(db):
    db.execute("CREATE TABLE t (k INT PRIMARY KEY, v VARCHAR(5), INDEX o (v) ORDERED)")
    for k in range(3):
        db.execute(f"INSERT INTO t VALUES ({k}, 'v{k}')")
    before = db.execute("CHECKSUM TABLE t").fetchall()
    r = db.execute("OPTIMIZE TABLE t")
    assert r.metadata["rows"] == 3 and db.execute("COMPACT TABLE t").metadata["chunks_removed"] > 0
    assert db.execute("CHECKSUM TABLE t").fetchall() == before
    db.execute("ANALYZE TABLE t")
    assert db._version("main", "t")[1].statistics["rows"] == 3
    assert db.execute("CHECK TABLE t").fetchall() == [{"status": "ok", "rows": 3, "errors": ""}]
    db.execute("FLUSH TABLES")
    got = db.execute("SELECT column_name, table_rows FROM information_schema WHERE table_name = 't' ORDER BY ordinal_position").fetchall()
    assert got == [{"column_name": "k", "table_rows": 3}, {"column_name": "v", "table_rows": 3}]
    assert db.query("SELECT value FROM sys WHERE variable_name = 'spark_version'").count() == 1


def test_compaction_deals_out_what_is_sorted(db, spark, monkeypatch):
    """Files of a sorted table are bounded by the memory of the sort, however well the rows compress."""
    monkeypatch.setattr("tessella.session.SORT_BYTES", 100_000, raising=False)
    db.execute("CREATE TABLE t (k INT PRIMARY KEY, v DOUBLE, s VARCHAR(200), INDEX o (v) ORDERED)")
    db.load("t", spark.range(2000).selectExpr("cast(id AS int) AS k", "cast(id % 1000 AS double) AS v", "if(id % 7 = 0, NULL, repeat('x', 200)) AS s"))
    before = db.execute("CHECKSUM TABLE t").fetchall()
    assert db.execute("COMPACT TABLE t").metadata["rows"] == 2000
    assert db.execute("CHECKSUM TABLE t").fetchall() == before
    ranges = db._version("main", "t")[1].ranges
    assert sum(r[0] for r in ranges.values()) == 2000 and len(ranges) >= 6 and max(r[0] for r in ranges.values()) < 700
    db.execute("CREATE TABLE e (k INT PRIMARY KEY, v DOUBLE, INDEX o (v) ORDERED)")
    assert db.execute("COMPACT TABLE e").metadata["rows"] == 0


@pytest.mark.parametrize("value", ["5.0D", "CAST(NULL AS DOUBLE)", "IF(id % 10 = 0, id / 1D, 7D)"])
def test_compaction_deals_out_equal_keys(db, spark, monkeypatch, value):
    """A value that most rows share doesn't bring them into one task."""
    monkeypatch.setattr("tessella.session.SORT_BYTES", 20_000, raising=False)
    db.execute("CREATE TABLE t (k INT PRIMARY KEY, v DOUBLE, INDEX o (v) ORDERED)")
    rows = spark.range(2000).selectExpr("cast(id AS int) AS k", f"{value} AS v")
    db.load("t", rows)
    db.execute("COMPACT TABLE t")
    ranges = db._version("main", "t")[1].ranges
    assert sum(r[0] for r in ranges.values()) == 2000 and max(r[0] for r in ranges.values()) < 700
    got = db.query("SELECT k, v FROM t")
    assert got.exceptAll(rows).isEmpty() and rows.exceptAll(got).isEmpty()
    assert [r["k"] for r in db.execute("SELECT k FROM t LIMIT 5")] == [0, 1, 2, 3, 4]


def test_compaction_keeps_ranges_apart(db, spark, monkeypatch):
    """Each file of a compacted table has a range of the ordered index of its own, so a range predicate needs few of them."""
    monkeypatch.setattr("tessella.session.SORT_BYTES", 20_000, raising=False)
    db.execute("CREATE TABLE t (k INT PRIMARY KEY, v DOUBLE, INDEX o (v) ORDERED)")
    rows = spark.range(2000).selectExpr("cast(id AS int) AS k", "if(id < 20, NULL, id * 919 % 2000 / 1D) AS v")
    db.load("t", rows)
    db.execute("COMPACT TABLE t")
    files = db.query("SELECT k, v FROM t").groupBy(F.input_file_name()).agg(F.min("v").alias("low"), F.max("v").alias("high")).collect()
    assert len(files) >= 6 and sum(f["high"] is not None and f["high"] >= 500 and f["low"] < 600 for f in files) <= 3
    got = db.query("SELECT k, v FROM t WHERE v >= 500.0 AND v < 600.0")
    want = rows.where("v >= 500 AND v < 600")
    assert want.count() > 90 and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()


def test_altering_deals_out_equal_keys(db, spark):
    """A table that ALTER TABLE sorts anew is dealt out though all rows have the same key."""
    db.execute("CREATE TABLE t (k INT PRIMARY KEY, v DOUBLE)")
    db.load("t", spark.range(2000).selectExpr("cast(id AS int) AS k", "7D AS v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        db.execute("CREATE INDEX o ON t (v) ORDERED")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    ranges = db._version("main", "t")[1].ranges
    assert sum(r[0] for r in ranges.values()) == 2000 and max(r[0] for r in ranges.values()) < 1000
    assert db.query("SELECT k, v FROM t WHERE v = 7.0").distinct().count() == 2000


def test_load(db, spark):
    db.execute("CREATE TABLE t (id BIGINT PRIMARY KEY, v VARCHAR(3))")
    assert db.load("t", spark.range(100).selectExpr("id", "'x' AS v")).affected_rows == 100
    with pytest.raises(EngineError) as e:
        db.load("t", spark.range(5).selectExpr("id", "'x' AS v"))
    assert e.value.code == "UNIQUE_VIOLATION" and db.query("SELECT id FROM t").count() == 100
    with pytest.raises(EngineError):
        db.load("t", spark.range(200, 201).selectExpr("id", "'long' AS v"))


@pytest.mark.parametrize(
    "sql",
    [
        "CREATE TABLE t (a INT AUTO_INCREMENT)", "CREATE TABLE t (a TEXT UNIQUE)", "CREATE TABLE t (a INT, a INT)", "CREATE TABLE t (a BINARY)", "CREATE TABLE t (a VARCHAR(0))", "CREATE TABLE t (a INT(5))", "CREATE TABLE t (a INT DEFAULT CURRENT_TIMESTAMP)", "CREATE TABLE t (a INT PRIMARY KEY, b INT PRIMARY KEY)",
        "CREATE TABLE con (a INT)", f"CREATE TABLE {'x' * 65} (a INT)", "CREATE TABLE t (a DOUBLE AUTO_INCREMENT UNIQUE)",
    ],
)
def test_schema_errors(db, sql):
    fails(db, sql, "SCHEMA_ERROR")


def test_names_beyond_ascii(db):
    db.execute("CREATE TABLE `Straße` (n INT PRIMARY KEY AUTO_INCREMENT, Größe INT NOT NULL, `ЁЛКА` VARCHAR(5))")
    db.execute("INSERT INTO straße (GRÖßE, ёлка) VALUES (3, 'a'), (4, NULL)")
    assert db.execute("SELECT größe, Ёлка FROM `straße` WHERE ёлка IS NOT NULL").fetchall() == [{"größe": 3, "ёлка": "a"}]


def test_many_columns(db):
    db.execute("CREATE TABLE wide (" + ", ".join(f"c{i} INT" for i in range(300)) + ")")
    db.execute("INSERT INTO wide (c0, c299) VALUES (1, 2)")
    assert db.execute("SELECT c0, c299, c5 FROM wide").fetchall() == [{"c0": 1, "c299": 2, "c5": None}]


def test_engine_reopens(spark, root):
    connect(spark, root).execute("CREATE TABLE t (k INT)")
    connect(spark, root).execute("INSERT INTO t VALUES (5)")
    assert connect(spark, root).execute("SELECT k FROM t").fetchall() == [{"k": 5}]


def test_result_cache(db):
    db.execute("CREATE TABLE t (k INT)")
    db.execute("INSERT INTO t VALUES (1)")
    cache, sql = db.engine.cache, "SELECT k FROM t WHERE k = ?"
    assert db.execute(sql, [1]).fetchall() == db.execute(sql, [1]).fetchall() == [{"k": 1}] and cache.hits == 1
    assert db.execute(sql, [2]).fetchall() == [] and cache.hits == 1
    db.execute("INSERT INTO t VALUES (1)")
    assert len(db.execute(sql, [1]).fetchall()) == 2 and cache.hits == 1
    for volatile in ("SELECT k FROM t WHERE CURRENT_TIMESTAMP > '2020-01-01'", "SELECT k FROM t WHERE k IN (SELECT k FROM t)"):
        db.execute(volatile).fetchall()
        db.execute(volatile).fetchall()
    assert cache.hits == 1
    db.execute("SET GLOBAL query_cache_size = 0")
    db.execute(sql, [1]).fetchall()
    assert cache.hits == 1
