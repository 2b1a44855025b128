"""The registered queries of the engine: one for each operator, with the SQL that DuckDB runs for it.

Most are a statement of the dialect over the attached tables; the oracle is that statement unless another text is given. The rest build tables of their own under a fresh root in the shared folder.
"""

from __future__ import annotations

import json
import logging
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import logs
from .errors import EngineError
from .session import Engine, Session, connect
from .streaming.changes import Follower

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def session(spark: SparkSession, sf_dir: str) -> Session:
    """A session over the test tables; a table is read when a statement names it."""
    engine = _Lazy(spark, sf_dir)
    return engine.session()


class _Lazy(Engine):
    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        super().__init__(spark)
        self.sf_dir, outer = sf_dir, self

        class Attached(dict):
            def __contains__(self, key: object) -> bool:
                if not super().__contains__(key) and isinstance(key, tuple) and key[0] == "main" and key[1] in TABLES:
                    outer.attach(key[1], f"{sf_dir}/{key[1]}.parquet")
                return super().__contains__(key)

        self.attached = Attached()


def fresh_root(spark: SparkSession) -> str:
    """A new folder where driver and executors can write: in ``spark.checkpoint.dir``, or the context's checkpoint folder; one of this machine only in local mode (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise EngineError("STORAGE_ERROR", "spark.checkpoint.dir names no folder that driver and executors share.")
        folder = "file://" + tempfile.mkdtemp(prefix="tessella-")
    return f"{folder.rstrip('/')}/engine-{uuid.uuid4().hex}"


SQL: dict[str, tuple] = {}


def _add(name: str, sql: str, oracle: str | None = None, params=None) -> None:
    SQL[name] = (sql, sql if oracle is None else oracle, params)


# Projection and scans
_add("scan_all", "SELECT * FROM region")
_add("project_alias", "SELECT c_custkey AS id, c_name AS name FROM customer")
_add("project_literal", "SELECT 1 AS one, 'x' AS tag, n_name FROM nation", "SELECT 1::BIGINT AS one, 'x' AS tag, n_name FROM nation")
# Predicates
_add("filter_eq", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
_add("filter_ne", "SELECT o_orderkey FROM orders WHERE o_orderstatus != 'F'")
_add("filter_lt", "SELECT p_partkey, p_size FROM part WHERE p_size < 10")
_add("filter_le", "SELECT p_partkey, p_size FROM part WHERE p_size <= 10")
_add("filter_gt", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000.0")
_add("filter_ge", "SELECT p_partkey, p_size FROM part WHERE 40 <= p_size", "SELECT p_partkey, p_size FROM part WHERE p_size >= 40")
_add("filter_and_or_not", "SELECT o_orderkey FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 200000.0) AND NOT o_orderpriority = '1-URGENT'")
_add("filter_is_null", "SELECT c.c_custkey AS k FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 400000.0 WHERE o.o_orderkey IS NULL")
_add("filter_is_not_null", "SELECT c.c_custkey AS k, o.o_orderkey AS o FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NOT NULL")
_add("filter_in", "SELECT c_custkey FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')")
_add("filter_not_in", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY')")
_add("filter_in_with_null", "SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', NULL)")
_add("filter_in_columns", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_partkey IN (l_suppkey, l_orderkey)")
_add("filter_like_prefix", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE 'S%'")
_add("filter_like_suffix", "SELECT p_partkey, p_type FROM part WHERE p_type LIKE '%L'")
_add("filter_like_contains", "SELECT doc_id FROM documents WHERE text LIKE '%the%ing%'")
_add("filter_like_underscore", "SELECT c_custkey, c_name FROM customer WHERE c_name LIKE 'Customer#0000000_1%'")
_add("filter_like_escape", r"SELECT page_id, url FROM pages WHERE url LIKE '%utm\_source%'", r"SELECT page_id, url FROM pages WHERE url LIKE '%utm\_source%' ESCAPE '\'")
_add("filter_not_like", "SELECT p_partkey FROM part WHERE p_name NOT LIKE '%a%'")
_add("filter_truthy", "SELECT doc_id FROM labels WHERE toxic", "SELECT doc_id FROM labels WHERE toxic <> 0")
_add("filter_params_positional", "SELECT c_custkey FROM customer WHERE c_mktsegment = ? AND c_acctbal > ?", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING' AND c_acctbal > 1000", ["BUILDING", 1000])
_add("filter_params_named", "SELECT c_custkey FROM customer WHERE c_mktsegment = :seg", "SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'", {"seg": "BUILDING"})
_add("filter_parenthesised", "SELECT o_orderkey FROM orders WHERE (o_totalprice) > (100000.0) AND (((o_orderstatus)) = ('F') OR (o_orderkey) IN (1, 2, 3))")
_add("filter_current_timestamp", "SELECT o_orderkey FROM orders WHERE o_orderdate < CURRENT_TIMESTAMP AND o_orderkey < 500")
_add("filter_uuid", "SELECT r_name FROM region WHERE UUID() LIKE '________-____-____-____-____________' AND r_name != UUID()", "SELECT r_name FROM region")
_add("filter_literals", "SELECT r_name FROM region WHERE r_regionkey >= -1 AND r_regionkey < 100 AND 'it''s' = 'it''s' AND TRUE AND NOT FALSE AND X'6162' = X'6162'", "SELECT r_name FROM region")
_add("json_nested_column", "SELECT vec_id, label FROM embeddings WHERE JSON_EXTRACT(embedding, '$[0]') > 0", "SELECT vec_id, label FROM embeddings WHERE embedding[1] > 0")
_add("filter_datetime", "SELECT o_orderkey FROM orders WHERE o_orderdate >= '1997-01-01 00:00:00' AND o_orderdate < '1998-01-01 00:00:00'")
# Aggregates
_add("agg_count_star", "SELECT COUNT(*) AS n FROM lineitem")
_add("agg_count_col", "SELECT COUNT(o.o_orderkey) AS n FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey")
_add("agg_sum", "SELECT SUM(l_quantity) AS s FROM lineitem")
_add("agg_sum_int", "SELECT SUM(p_size) AS s FROM part", "SELECT SUM(p_size)::DOUBLE AS s FROM part")
_add("agg_avg", "SELECT AVG(p_size) AS a FROM part", "SELECT AVG(p_size::DOUBLE) AS a FROM part")
_add("agg_min_max", "SELECT MIN(o_totalprice) AS low, MAX(o_totalprice) AS high, MIN(o_orderdate) AS first_day FROM orders")
_add("agg_mixed", "SELECT COUNT(*) AS n, SUM(l_quantity) AS s, MAX(l_shipdate) AS last_day FROM lineitem WHERE l_returnflag = 'R'")
_add("agg_sum_empty", "SELECT SUM(l_quantity) AS s FROM lineitem WHERE l_quantity < 0.0", "SELECT COALESCE(SUM(l_quantity), 0.0)::DOUBLE AS s FROM lineitem WHERE l_quantity < 0.0")
_add("agg_avg_empty", "SELECT AVG(l_quantity) AS a FROM lineitem WHERE l_quantity < 0.0")
_add("agg_min_max_string", "SELECT MIN(c_name) AS low, MAX(c_name) AS high FROM customer")
_add("group_by_one", "SELECT l_returnflag, COUNT(*) AS n, SUM(l_quantity) AS q FROM lineitem GROUP BY l_returnflag")
_add("group_by_many", "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, SUM(l_quantity) AS q, MIN(l_shipdate) AS d FROM lineitem GROUP BY l_returnflag, l_linestatus")
_add("group_by_keys_only", "SELECT o_orderstatus, o_orderpriority FROM orders GROUP BY o_orderstatus, o_orderpriority")
_add("group_having", "SELECT l_suppkey, SUM(l_quantity) AS total FROM lineitem GROUP BY l_suppkey HAVING total > 1000.5", "SELECT l_suppkey, SUM(l_quantity) AS total FROM lineitem GROUP BY l_suppkey HAVING SUM(l_quantity) > 1000.5")
_add("group_having_like", "SELECT p_brand, COUNT(*) AS n FROM part GROUP BY p_brand HAVING p_brand LIKE '%1%'")
_add("group_order_limit", "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 10")
_add("default_alias", "SELECT c_mktsegment, COUNT(*), MAX(c_acctbal), COUNT(c_name) FROM customer GROUP BY c_mktsegment", 'SELECT c_mktsegment, COUNT(*) AS "count", MAX(c_acctbal) AS max_c_acctbal, COUNT(c_name) AS count_c_name FROM customer GROUP BY c_mktsegment')
# Joins
_add("join_inner", "SELECT n.n_name AS nation, r.r_name AS region FROM nation AS n JOIN region AS r ON n.n_regionkey = r.r_regionkey")
_add("join_theta", "SELECT a.n_nationkey AS a, b.r_regionkey AS b FROM nation AS a JOIN region AS b ON a.n_regionkey < b.r_regionkey")
_add("join_left", "SELECT c.c_custkey AS k, o.o_orderkey AS o FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_totalprice > 150000.0")
_add("join_right", "SELECT o.o_orderkey AS o, c.c_custkey AS k FROM orders AS o RIGHT JOIN customer AS c ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'P'")
_add("join_cross", "SELECT a.r_name AS a, b.r_name AS b FROM region AS a CROSS JOIN region AS b")
_add("join_comma", "SELECT s.s_name AS s, n.n_name AS n FROM supplier AS s, nation AS n WHERE s.s_nationkey = n.n_nationkey")
_add("join_self", "SELECT a.n_name AS a, b.n_name AS b FROM nation AS a JOIN nation AS b ON a.n_regionkey = b.n_regionkey WHERE a.n_nationkey < b.n_nationkey")
_add("join_multi", "SELECT c.c_name AS c, o.o_orderkey AS o, n.n_name AS n, r.r_name AS r FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey JOIN nation AS n ON c.c_nationkey = n.n_nationkey JOIN region AS r ON n.n_regionkey = r.r_regionkey WHERE r.r_name = 'ASIA'")
_add("join_star_names", "SELECT * FROM nation AS n JOIN region AS r ON n.n_regionkey = r.r_regionkey", 'SELECT n.n_nationkey AS "n.n_nationkey", n.n_name AS "n.n_name", n.n_regionkey AS "n.n_regionkey", r.r_regionkey AS "r.r_regionkey", r.r_name AS "r.r_name" FROM nation n JOIN region r ON n.n_regionkey = r.r_regionkey')
_add("join_group", "SELECT n.n_name AS nation, COUNT(*) AS n, MAX(o.o_totalprice) AS top FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey JOIN nation AS n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name", "SELECT n.n_name AS nation, COUNT(*) AS n, MAX(o.o_totalprice) AS top FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey JOIN nation AS n ON c.c_nationkey = n.n_nationkey GROUP BY n.n_name")
_add("left_join_null_filter", "SELECT COUNT(*) AS n FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey WHERE o.o_orderkey IS NULL")
# Subqueries
_add("in_subquery", "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
_add("not_in_subquery", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000.0)")
_add(
    "not_in_subquery_nulls", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT o.o_orderkey FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F')",
    "SELECT o_orderkey FROM orders WHERE o_orderkey IS NOT NULL AND o_orderkey NOT IN (SELECT x FROM (SELECT o.o_orderkey AS x FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey AND o.o_orderstatus = 'F') WHERE x IS NOT NULL)",
)
_add("in_subquery_or", "SELECT o_orderkey FROM orders WHERE o_totalprice > 300000.0 OR o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0.0)")
_add("exists", "SELECT r_name FROM region WHERE EXISTS (SELECT n_nationkey FROM nation WHERE n_name = 'NATION_3')")
_add("not_exists", "SELECT r_name FROM region WHERE NOT EXISTS (SELECT n_nationkey FROM nation WHERE n_nationkey > 1000)")
_add("scalar_subquery", "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) FROM orders)")
_add("scalar_subquery_first_row", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice >= (SELECT o_totalprice FROM orders ORDER BY o_totalprice DESC LIMIT 1 OFFSET 4)")
# Order and bounds
_add("order_asc", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey LIMIT 20")
_add("order_desc", "SELECT c_custkey, c_acctbal FROM customer ORDER BY c_acctbal DESC, c_custkey DESC LIMIT 20")
_add("order_multi", "SELECT o_orderstatus, o_orderkey FROM orders ORDER BY o_orderstatus DESC, o_orderkey ASC LIMIT 25")
_add("order_unprojected", "SELECT p_name FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 15")
_add("order_nulls", "SELECT c.c_custkey AS k, o.o_orderkey AS o FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey ORDER BY o_orderkey, c_custkey LIMIT 30", "SELECT c.c_custkey AS k, o.o_orderkey AS o FROM customer AS c LEFT JOIN orders AS o ON c.c_custkey = o.o_custkey ORDER BY o_orderkey NULLS FIRST, c_custkey LIMIT 30")
_add("limit", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5")
_add("limit_offset", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 7")
_add("limit_comma", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 7, 5", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 5 OFFSET 7")
_add("offset_only", "SELECT n_nationkey FROM nation ORDER BY n_nationkey OFFSET 20")
_add("limit_zero", "SELECT o_orderkey FROM orders LIMIT 0")
# JSON
_add("json_extract_project", "SELECT event_id, JSON_EXTRACT(props, '$.k') AS k FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
_add("json_extract_filter_num", "SELECT event_id FROM events WHERE JSON_EXTRACT(props, '$.k') > 50", "SELECT event_id FROM events WHERE CAST(json_extract_string(props, '$.k') AS DOUBLE) > 50")
_add("json_extract_missing", "SELECT COUNT(*) AS n FROM events WHERE JSON_EXTRACT(props, '$.missing') IS NULL", "SELECT COUNT(*) AS n FROM events WHERE json_extract_string(props, '$.missing') IS NULL")
# Benchmark shapes
_add("flagship", "SELECT n.n_name AS nation, COUNT(*) AS orders, MAX(o.o_totalprice) AS top FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey JOIN nation AS n ON c.c_nationkey = n.n_nationkey WHERE o.o_orderstatus != 'P' GROUP BY n.n_name HAVING orders > 2 ORDER BY orders DESC, nation LIMIT 10", "SELECT n.n_name AS nation, COUNT(*) AS orders, MAX(o.o_totalprice) AS top FROM customer AS c JOIN orders AS o ON c.c_custkey = o.o_custkey JOIN nation AS n ON c.c_nationkey = n.n_nationkey WHERE o.o_orderstatus != 'P' GROUP BY n.n_name HAVING COUNT(*) > 2 ORDER BY orders DESC, nation LIMIT 10")
_add("point_lookup", "SELECT o_totalprice FROM orders WHERE o_orderkey = 100")


def _run_sql(name: str) -> Callable[[SparkSession, str], DataFrame]:
    sql, _, params = SQL[name]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return session(spark, sf_dir).query(sql, params)

    run.__name__ = name
    return run


# Queries that change tables of their own

_ORDERS = "CREATE TABLE o (k BIGINT PRIMARY KEY, cust BIGINT, status VARCHAR(1) NOT NULL, price DOUBLE, INDEX by_price (price) ORDERED)"


def _loaded(spark: SparkSession, sf_dir: str, changes: bool = False) -> Session:
    """A table of all orders, loaded through the engine."""
    s = connect(spark, fresh_root(spark), changes=changes)
    s.execute(_ORDERS)
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    s.load("o", orders.selectExpr("o_orderkey AS k", "o_custkey AS cust", "o_orderstatus AS status", "o_totalprice AS price"))
    return s


_BACK = "SELECT k, cust, status, price FROM o"


def dml_insert(spark, sf_dir):
    s = _loaded(spark, sf_dir)
    s.execute("INSERT INTO o (k, status, price) VALUES (-1, 'X', 1.5), (-2, 'Y', NULL)")
    return s.query(_BACK)


def dml_update(spark, sf_dir):
    s = _loaded(spark, sf_dir)
    s.execute("UPDATE o SET status = 'X', price = 0 WHERE price > 200000.0 OR status = 'P'")
    return s.query(_BACK)


def dml_delete(spark, sf_dir):
    s = _loaded(spark, sf_dir)
    s.execute("DELETE FROM o WHERE status LIKE 'F' AND price < 100000.0")
    return s.query(_BACK)


def dml_truncate(spark, sf_dir):
    s = _loaded(spark, sf_dir)
    s.execute("TRUNCATE TABLE o")
    return s.query(_BACK)


def txn_rollback(spark, sf_dir):
    s = _loaded(spark, sf_dir)
    s.execute("BEGIN")
    s.execute("DELETE FROM o WHERE status = 'F'")
    s.execute("UPDATE o SET price = 0")
    s.execute("ROLLBACK")
    return s.query(_BACK)


def txn_commit(spark, sf_dir):
    s = _loaded(spark, sf_dir)
    s.execute("BEGIN")
    s.execute("DELETE FROM o WHERE status = 'F'")
    s.execute("UPDATE o SET status = 'Z' WHERE price > 200000.0")
    s.execute("COMMIT")
    return s.query(_BACK)


def copy_table(spark, sf_dir):
    s = _loaded(spark, sf_dir)
    s.execute("CREATE DATABASE other")
    s.execute("COPY TABLE o TO other.p")
    s.execute("DELETE FROM o")
    return s.query("SELECT k, cust, status, price FROM other.p")


def alter_table(spark, sf_dir):
    s = _loaded(spark, sf_dir)
    s.execute("ALTER TABLE o ADD COLUMN note VARCHAR(10) DEFAULT 'new', RENAME COLUMN cust TO customer, MODIFY status VARCHAR(20) NOT NULL")
    return s.query("SELECT k, customer, status, price, note FROM o")


def policy_filter(spark, sf_dir):
    s = session(spark, sf_dir)
    s.execute("CREATE ROLE analyst")
    s.execute("GRANT SELECT ON main.customer TO analyst")
    s.execute("GRANT analyst TO ann")
    s.execute("CREATE POLICY segment ON customer FOR SELECT TO analyst USING (c_mktsegment = 'BUILDING')")
    s.execute("CREATE POLICY debt ON customer FOR ALL USING (c_acctbal < 0.0)")
    return s.engine.session("ann").query("SELECT c_custkey, c_name FROM customer WHERE c_custkey > 10")


def changes_replay(spark, sf_dir):
    s = _loaded(spark, sf_dir, changes=True)
    s.execute("UPDATE o SET status = 'X' WHERE price > 200000.0")
    s.execute("DELETE FROM o WHERE status = 'P'")
    s.execute("INSERT INTO o (k, status) VALUES (-5, 'N')")
    follower = connect(spark, fresh_root(spark))
    Follower(follower.engine, s.engine.store.root).run()
    return follower.query(_BACK)


def ordered_index_range(spark, sf_dir):
    s = _loaded(spark, sf_dir)
    s.execute("COMPACT TABLE o")
    return s.query("SELECT k, price FROM o WHERE price >= 50000.0 AND price < 60000.0")


def outcomes(s: Session, statements: list[tuple[Session, str] | str]) -> DataFrame:
    """What each statement comes to: step and outcome, which is the error's code, the rows of a query, or the rows that a command has changed."""
    out = []
    for k, entry in enumerate(statements, 1):
        on, sql = (s, entry) if isinstance(entry, str) else entry
        try:
            r = on.execute(sql)
            out.append((k, f"{len(r.fetchall())} rows" if r.kind == "rows" else f"{r.affected_rows} changed"))
        except EngineError as e:
            out.append((k, e.code))
    return s.engine.spark.createDataFrame(out, "step int, outcome string")


def _steps(*expected: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({k}, '{x}')" for k, x in enumerate(expected, 1)) + ") AS v(step, outcome)"


def _values(names: str, *rows: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({r})" for r in rows) + f") AS v({names})"


def databases(spark, sf_dir):
    s = connect(spark, fresh_root(spark))
    s.execute("CREATE DATABASE alpha")
    s.execute("CREATE DATABASE IF NOT EXISTS beta")
    s.execute("CREATE DATABASE gamma")
    s.execute("DROP DATABASE beta")
    return s.query("SHOW DATABASES")


def database_errors(spark, sf_dir):
    s = connect(spark, fresh_root(spark))
    return outcomes(s, ["CREATE DATABASE alpha", "CREATE DATABASE alpha", "CREATE DATABASE IF NOT EXISTS alpha", "DROP DATABASE nope", "DROP DATABASE IF EXISTS nope", "USE nope", "USE alpha", "SHOW TABLES", "DROP DATABASE alpha", "SHOW DATABASES"])


def use_database(spark, sf_dir):
    s = _loaded(spark, sf_dir)
    s.execute("CREATE DATABASE other")
    s.execute("USE other")
    s.execute("CREATE TABLE o (k INT)")
    s.execute("INSERT INTO o VALUES (1), (2)")
    return s.query("SELECT a.k AS mine, b.k AS theirs, b.status AS status FROM o AS a JOIN main.o AS b ON a.k = b.k")


def create_table(spark, sf_dir):
    s = connect(spark, fresh_root(spark))
    done = outcomes(s, [_ORDERS, _ORDERS, _ORDERS.replace("TABLE", "TABLE IF NOT EXISTS"), "CREATE TABLE b (a INT AUTO_INCREMENT)", "CREATE TABLE b (a INT, a INT)", "CREATE TABLE b (a TEXT UNIQUE)", "SELECT * FROM o"])
    return done


def drop_table(spark, sf_dir):
    s = _loaded(spark, sf_dir)
    return outcomes(s, ["SELECT k FROM o WHERE k < 3", "DROP TABLE o", "SELECT k FROM o", "DROP TABLE o", "DROP TABLE IF EXISTS o", _ORDERS, "SELECT k FROM o"])


def describe(spark, sf_dir):
    s = connect(spark, fresh_root(spark))
    s.execute(_ORDERS)
    return s.query("DESCRIBE o")


def show_tables(spark, sf_dir):
    s = connect(spark, fresh_root(spark))
    s.execute(_ORDERS)
    s.execute("CREATE TABLE b (a INT)")
    return s.query("SHOW TABLES")


def show_index(spark, sf_dir):
    s = connect(spark, fresh_root(spark))
    s.execute(_ORDERS)
    s.execute("CREATE UNIQUE INDEX pair ON o (cust, status)")
    return s.query("SHOW INDEX FROM o")


def create_index(spark, sf_dir):
    s = _loaded(spark, sf_dir)
    s.execute("CREATE INDEX by_cust ON o (cust)")
    s.execute("DROP INDEX by_price ON o")
    return s.query("SELECT k, cust FROM o WHERE cust = 7 OR price < 2000.0")


def index_errors(spark, sf_dir):
    s = _loaded(spark, sf_dir)
    return outcomes(s, ["CREATE INDEX by_cust ON o (cust)", "CREATE INDEX by_cust ON o (cust)", "CREATE INDEX IF NOT EXISTS by_cust ON o (cust)", "CREATE UNIQUE INDEX u ON o (status)", "CREATE INDEX x ON o (nope)", "DROP INDEX nope ON o", "DROP INDEX IF EXISTS nope ON o", "DROP INDEX `primary` ON o", "DROP INDEX by_cust ON o"])


def rename_table(spark, sf_dir):
    s = _loaded(spark, sf_dir)
    s.execute("RENAME TABLE o TO sales")
    s.execute("DELETE FROM sales WHERE status = 'F'")
    return s.query("SELECT k, cust, status, price FROM sales")


def move_table(spark, sf_dir):
    s = _loaded(spark, sf_dir)
    s.execute("CREATE DATABASE other")
    s.execute("MOVE TABLE o TO other.sales")
    s.execute("UPDATE other.sales SET status = 'M' WHERE price < 50000.0")
    return s.query("SELECT k, cust, status, price FROM other.sales")


def transfer_errors(spark, sf_dir):
    s = _loaded(spark, sf_dir)
    s.execute("CREATE TABLE p (k INT)")
    return outcomes(s, ["RENAME TABLE o TO p", "RENAME TABLE nope TO q", "MOVE TABLE o TO nowhere", "COPY TABLE o TO main.p", "COPY TABLE o TO main.q", "RENAME TABLE q TO r", "SELECT k FROM r WHERE k <= 5", "SELECT k FROM q"])


def alter_keys(spark, sf_dir):
    s = _loaded(spark, sf_dir)
    s.execute("ALTER TABLE o DROP PRIMARY KEY, CHANGE k number BIGINT NOT NULL, DROP INDEX by_price, DROP COLUMN price, ADD PRIMARY KEY (number), ADD INDEX by_cust (cust), RENAME INDEX by_cust TO c, COLLATE utf8mb4_bin")
    s.execute("ALTER TABLE o RENAME TO p")
    return s.query("SELECT number, cust, status FROM p")


def alter_auto_increment(spark, sf_dir):
    s = connect(spark, fresh_root(spark))
    s.execute("CREATE TABLE a (id INT PRIMARY KEY AUTO_INCREMENT, v VARCHAR(5))")
    s.execute("INSERT INTO a (v) VALUES ('x')")
    s.execute("ALTER TABLE a AUTO_INCREMENT = 700")
    s.execute("INSERT INTO a (v) VALUES ('y'), ('z')")
    return s.query("SELECT id, v FROM a")


def alter_errors(spark, sf_dir):
    s = _loaded(spark, sf_dir)
    return outcomes(s, ["ALTER TABLE o ADD UNIQUE u (status)", "ALTER TABLE o MODIFY status INT", "ALTER TABLE o ADD COLUMN n INT NOT NULL", "ALTER TABLE o DROP COLUMN price", "ALTER TABLE o DROP COLUMN nope", "ALTER TABLE o RENAME COLUMN cust TO status", "ALTER TABLE o DROP INDEX nope", "ALTER TABLE o ADD CONSTRAINT u UNIQUE (k)"])


def compact_table(spark, sf_dir):
    s = _loaded(spark, sf_dir)
    for k in range(3):
        s.execute(f"INSERT INTO o (k, status) VALUES ({-1 - k}, 'N')")
    s.execute("COMPACT TABLE o")
    return s.query(_BACK)


def analyze_table(spark, sf_dir):
    s = _loaded(spark, sf_dir)
    s.execute("ANALYZE TABLE o")
    found = s._version("main", "o")[1].statistics  # noqa: SLF001
    return spark.createDataFrame([(found["rows"], found["status/distinct"], found["cust/nulls"])], "row_count long, statuses long, null_customers long")


def check_table(spark, sf_dir):
    s = _loaded(spark, sf_dir)
    return s.query("CHECK TABLE o")


def checksum_table(spark, sf_dir):
    """The checksum is that of the rows, in whatever order and files."""
    s = _loaded(spark, sf_dir)
    sums = [s.query("CHECKSUM TABLE o").first()["checksum"]]
    s.execute("INSERT INTO o (k, status) VALUES (-1, 'N')")
    sums.append(s.query("CHECKSUM TABLE o").first()["checksum"])
    s.execute("DELETE FROM o WHERE k = -1")
    s.execute("COMPACT TABLE o")
    sums.append(s.query("CHECKSUM TABLE o").first()["checksum"])
    return spark.createDataFrame([(sums[0] == sums[2], sums[0] == sums[1])], "same boolean, with_another_row boolean")


def flush_tables(spark, sf_dir):
    s = _loaded(spark, sf_dir)
    return outcomes(s, ["FLUSH TABLE o", "FLUSH TABLES", "SELECT k FROM o WHERE k <= 10"])


def set_variables(spark, sf_dir):
    s = session(spark, sf_dir)
    s.execute("SET SESSION sort_buffer_size = 4M")
    s.execute("SET GLOBAL join_buffer_size = 65536")
    return s.query("SHOW VARIABLES LIKE '%buffer\\_size'")


def show_variables(spark, sf_dir):
    return session(spark, sf_dir).query("SHOW VARIABLES LIKE '%buffer%'")


def insert_limit(spark, sf_dir):
    """The rows of an INSERT, which pass the driver, are bounded."""
    s = connect(spark, fresh_root(spark))
    s.execute("CREATE TABLE t (v VARCHAR(100))")
    return outcomes(s, ["INSERT INTO t VALUES ('short')", "SET SESSION max_heap_table_size = 100", f"INSERT INTO t VALUES ('{'x' * 90}'), ('y')", "INSERT INTO t VALUES ('a'), ('b')", "SET SESSION max_heap_table_size = 1M", f"INSERT INTO t VALUES ('{'x' * 90}'), ('y')", "SELECT v FROM t"])


def variable_errors(spark, sf_dir):
    s = session(spark, sf_dir)
    return outcomes(s, ["SET nope = 1", "SET GLOBAL thread_stack = 5", "SET SESSION query_cache_size = 5", "SET sort_buffer_size = 'x'", "SET sort_buffer_size = 1K", "SHOW VARIABLES LIKE 'thread%'", "SHOW GLOBAL VARIABLES"])


def insert_defaults(spark, sf_dir):
    s = connect(spark, fresh_root(spark))
    s.execute("CREATE TABLE d (id INT PRIMARY KEY AUTO_INCREMENT, v INT DEFAULT 7, t VARCHAR(5) DEFAULT 'new', made TIMESTAMP DEFAULT CURRENT_TIMESTAMP, u UUID DEFAULT UUID())")
    s.execute("INSERT INTO d DEFAULT VALUES")
    s.execute("INSERT INTO d (v, t) VALUES (DEFAULT, 'x'), (NULL, DEFAULT)")
    s.execute("INSERT INTO d (id, made, u) VALUES (40, CURRENT_TIMESTAMP, UUID())")
    return s.query("SELECT id, v, t FROM d WHERE made <= CURRENT_TIMESTAMP AND u LIKE '________-____-____-____-____________'")


def unique_checks(spark, sf_dir):
    s = _loaded(spark, sf_dir)
    s.execute("CREATE TABLE c (a INT, b INT, t VARCHAR(5), UNIQUE pair (a, b))")
    return outcomes(s, [
        "INSERT INTO o (k, status) VALUES (1, 'X')", "INSERT INTO o (k, status) VALUES (-1, 'X'), (-1, 'Y')", "INSERT INTO o (k, status) VALUES (NULL, 'X')", "UPDATE o SET k = 2 WHERE k = 1", "UPDATE o SET k = -9 WHERE k < 3", "UPDATE o SET k = -9 WHERE k = 1",
        "INSERT INTO c VALUES (1, 1, 'x'), (1, 2, 'x'), (2, 1, 'y'), (1, NULL, 'z'), (1, NULL, 'z')", "INSERT INTO c VALUES (1, 2, 'w')", "UPDATE c SET a = 1 WHERE a = 2", "UPDATE c SET a = 3 WHERE a = 2", "UPDATE c SET b = 1", "SELECT a FROM c",
    ])


def load_checks(spark, sf_dir):
    """Keys of loaded rows are checked among themselves and against the table."""
    s = _loaded(spark, sf_dir)
    out = []
    for k, rows in enumerate(("SELECT -1L AS k, 'x' AS status", "SELECT -2L AS k, 'x' AS status UNION ALL SELECT -2L, 'y'", "SELECT 5L AS k, 'x' AS status", "SELECT -3L AS k, 'long' AS status", "SELECT -3L AS k, CAST(NULL AS STRING) AS status"), 1):
        try:
            out.append((k, f"{s.load('o', spark.sql(rows)).affected_rows} changed"))
        except EngineError as e:
            out.append((k, e.code))
    return spark.createDataFrame(out, "step int, outcome string")


def scalar_subquery_row_order(spark, sf_dir):
    """The first row of a subquery without an order is that with the least row id, also after its file was written anew."""
    s = connect(spark, fresh_root(spark))
    s.execute("CREATE TABLE t (id INT, v INT)")
    for k in range(1, 4):
        s.execute(f"INSERT INTO t VALUES ({k}, {10 * k})")
    s.execute("UPDATE t SET v = 15 WHERE id = 1")
    return s.query("SELECT id, v FROM t WHERE v = (SELECT v FROM t)")


def limit_insertion_order(spark, sf_dir):
    s = _loaded(spark, sf_dir)
    for k in range(3):
        s.execute(f"INSERT INTO o (k, status) VALUES ({-1 - k}, 'N')")
    s.execute("DELETE FROM o WHERE status != 'N'")
    s.execute("UPDATE o SET price = 1.5 WHERE k = -1")
    return s.query("SELECT k, price FROM o LIMIT 2")


def semantic_errors(spark, sf_dir):
    return outcomes(session(spark, sf_dir), [
        "SELECT n_regionkey FROM nation AS a JOIN nation AS b ON a.n_nationkey = b.n_nationkey", "SELECT a.n_name AS n FROM nation AS a JOIN nation AS a ON a.n_nationkey = a.n_nationkey", "SELECT n_name, COUNT(*) AS n FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, COUNT(*) AS n FROM nation GROUP BY n_regionkey",
        "SELECT nope FROM nation", "SELECT n_name FROM nowhere", "SELECT n_name, n_name FROM nation", "SELECT n_name FROM nation WHERE n_name = n_regionkey", "SELECT n_name FROM nation WHERE n_regionkey = 'x'", "SELECT n_name FROM nation WHERE n_regionkey = ?", "SELECT FROM nation", "SELECT n_name FROM nation LIMIT 3",
    ])


def privileges(spark, sf_dir):
    s = session(spark, sf_dir)
    ann = s.engine.session("ann")
    return outcomes(s, [
        (ann, "SELECT n_name FROM nation"), "CREATE ROLE reader", "CREATE ROLE reader", "GRANT SELECT ON main.nation TO reader", "GRANT reader TO ann", (ann, "SELECT n_name FROM nation"), (ann, "SELECT r_name FROM region"), (ann, "SELECT n_name FROM nation WHERE n_regionkey IN (SELECT r_regionkey FROM region)"),
        (ann, "GRANT SELECT ON main.region TO ann"), "GRANT SELECT ON main.re% TO ann", (ann, "SELECT r_name FROM region"), "REVOKE reader FROM ann", (ann, "SELECT n_name FROM nation"), "REVOKE SELECT ON main.re% FROM ann", (ann, "SELECT r_name FROM region"), "GRANT reader TO ann", "DROP ROLE reader", (ann, "SELECT n_name FROM nation"), "DROP ROLE reader",
    ])


def statement_privileges(spark, sf_dir):
    """Each kind of statement asks for its own privilege."""
    s = _loaded(spark, sf_dir)
    ann, out = s.engine.session("ann"), []
    for privilege, sql in (("INSERT", "INSERT INTO o (k, status) VALUES (-1, 'X')"), ("UPDATE", "UPDATE o SET status = 'Y' WHERE k = -1"), ("DELETE", "DELETE FROM o WHERE k = -1"), ("SHOW", "DESCRIBE o"), ("INDEX", "CREATE INDEX c ON o (cust)"), ("ALTER", "ALTER TABLE o ADD COLUMN n INT"), ("TRUNCATE", "TRUNCATE TABLE o"), ("DROP", "DROP TABLE o"), ("CREATE", "CREATE TABLE p (a INT)")):
        table = "main.p" if privilege == "CREATE" else "main.o"
        out += [(ann, sql), f"GRANT {privilege} ON {table} TO ann", (ann, sql)]
    return outcomes(s, out)


def policies_on_writes(spark, sf_dir):
    s = _loaded(spark, sf_dir)
    ann = s.engine.session("ann")
    return outcomes(s, [
        "GRANT ALL ON main.% TO ann", "CREATE POLICY mine ON o FOR ALL USING (status = 'P')", "CREATE POLICY mine ON o FOR SELECT USING (status = 'P')", (ann, "INSERT INTO o (k, status) VALUES (-1, 'F')"), (ann, "INSERT INTO o (k, status) VALUES (-1, 'P')"), (ann, "UPDATE o SET status = 'F' WHERE k = -1"),
        (ann, "UPDATE o SET price = 2 WHERE k = -1"), (ann, "SELECT k FROM o WHERE status != 'P'"), (ann, "DELETE FROM o WHERE k = -1"), (ann, "TRUNCATE TABLE o"), "DROP POLICY nope ON o", "DROP POLICY mine ON o", (ann, "INSERT INTO o (k, status) VALUES (-1, 'F')"),
    ])


def policy_join(spark, sf_dir):
    """A policy holds before a join: a LEFT JOIN keeps the rows whose partner it hides."""
    s = session(spark, sf_dir)
    s.execute("GRANT SELECT ON main.% TO ann")
    s.execute("CREATE POLICY europe ON region FOR SELECT USING (r_regionkey = 3)")
    return s.engine.session("ann").query("SELECT n.n_name AS nation, r.r_name AS region FROM nation AS n LEFT JOIN region AS r ON n.n_regionkey = r.r_regionkey")


def system_tables(spark, sf_dir):
    s = _loaded(spark, sf_dir)
    for sql in ("CREATE ROLE reader", "GRANT SELECT ON main.o TO reader", "GRANT reader TO ann", "CREATE POLICY p ON o FOR SELECT TO reader USING (k > 0)"):
        s.execute(sql)
    counts = [(t, s.query(f"SELECT * FROM system.{t}").count()) for t in ("users_schema", "roles", "role_assignments", "privileges", "policies", "replication_log", "sys_config", "config_schema")]
    counts += [(f"performance_schema.{r['metric_name']}", int(r["metric_value"])) for r in s.query("SELECT metric_name, metric_value FROM system.performance_schema WHERE metric_name IN ('statements', 'errors')").collect()]
    return spark.createDataFrame(counts, "name string, n long")


def sys_facts(spark, sf_dir):
    return connect(spark, fresh_root(spark)).query("SELECT variable_name FROM sys WHERE value IS NOT NULL AND variable_name LIKE '%version'")


def information_schema(spark, sf_dir):
    s = _loaded(spark, sf_dir)
    return s.query("SELECT table_name, column_name, ordinal_position, data_type, is_nullable, column_key, table_rows FROM information_schema WHERE table_name = 'o'")


def result_cache(spark, sf_dir):
    """Rows that were read are kept until their table changes."""
    s, hits = _loaded(spark, sf_dir), []
    for sql in ("SELECT k FROM o WHERE k <= 5", "SELECT k FROM o WHERE k <= 5", "DELETE FROM o WHERE k = 1", "SELECT k FROM o WHERE k <= 5", "SELECT k FROM o WHERE k <= 5", "SET GLOBAL query_cache_size = 0", "SELECT k FROM o WHERE k <= 5"):
        s.execute(sql).fetchall()
        hits.append((len(hits) + 1, s.engine.cache.hits))
    return spark.createDataFrame(hits, "step int, hits int")


def changes_prune(spark, sf_dir):
    s = _loaded(spark, sf_dir, changes=True)
    s.execute("UPDATE o SET status = 'X' WHERE price > 200000.0")
    s.execute("INSERT INTO o (k, status) VALUES (-5, 'N')")
    s.engine.changes.prune(4)
    return s.engine.changes.read().select("log_id", "change_type", "row_id").where("log_id >= 4").groupBy("log_id", "change_type").count().selectExpr("log_id", "change_type", "count AS n")


def statement_log(spark, sf_dir):
    """Log lines hold no literals."""
    lines: list[str] = []
    handler = logging.Handler()
    handler.emit = lambda record: lines.append(record.getMessage())
    level = logs.LOGGER.level
    logs.LOGGER.addHandler(handler)
    logs.LOGGER.setLevel(logging.INFO)
    try:
        outcomes(session(spark, sf_dir), ["SELECT n_name FROM nation WHERE n_name = 'NATION_3' AND n_nationkey < 5", "CREATE ROLE extra", "SELECT nope FROM nation"])
    finally:
        logs.LOGGER.removeHandler(handler)
        logs.LOGGER.setLevel(level)
    seen = [json.loads(x) for x in lines]
    return spark.createDataFrame([(x["log"], x["sql"], x.get("code")) for x in seen if x["log"] != "slow"], "log string, statement string, code string")


_BASE = "SELECT o_orderkey AS k, o_custkey AS cust, o_orderstatus AS status, o_totalprice AS price FROM orders"
TABLE_QUERIES = {
    dml_insert: f"{_BASE} UNION ALL VALUES (-1, NULL, 'X', 1.5::DOUBLE), (-2, NULL, 'Y', NULL)",
    dml_update: "SELECT o_orderkey AS k, o_custkey AS cust, CASE WHEN o_totalprice > 200000.0 OR o_orderstatus = 'P' THEN 'X' ELSE o_orderstatus END AS status, CASE WHEN o_totalprice > 200000.0 OR o_orderstatus = 'P' THEN 0.0::DOUBLE ELSE o_totalprice END AS price FROM orders",
    dml_delete: f"{_BASE} WHERE NOT (o_orderstatus = 'F' AND o_totalprice < 100000.0)",
    dml_truncate: f"{_BASE} WHERE false",
    txn_rollback: _BASE,
    txn_commit: "SELECT o_orderkey AS k, o_custkey AS cust, CASE WHEN o_totalprice > 200000.0 THEN 'Z' ELSE o_orderstatus END AS status, o_totalprice AS price FROM orders WHERE o_orderstatus <> 'F'",
    copy_table: _BASE,
    alter_table: "SELECT o_orderkey AS k, o_custkey AS customer, o_orderstatus AS status, o_totalprice AS price, 'new' AS note FROM orders",
    policy_filter: "SELECT c_custkey, c_name FROM customer WHERE c_custkey > 10 AND (c_mktsegment = 'BUILDING' OR c_acctbal < 0.0)",
    changes_replay: "SELECT * FROM (SELECT o_orderkey AS k, o_custkey AS cust, CASE WHEN o_totalprice > 200000.0 THEN 'X' ELSE o_orderstatus END AS status, o_totalprice AS price FROM orders) WHERE status <> 'P' UNION ALL VALUES (-5, NULL, 'N', NULL::DOUBLE)",
    ordered_index_range: "SELECT o_orderkey AS k, o_totalprice AS price FROM orders WHERE o_totalprice >= 50000.0 AND o_totalprice < 60000.0",
    databases: _values("database", "'alpha'", "'gamma'", "'main'"),
    database_errors: _steps("0 changed", "DATABASE_EXISTS", "0 changed", "DATABASE_NOT_FOUND", "0 changed", "DATABASE_NOT_FOUND", "0 changed", "0 rows", "0 changed", "1 rows"),
    use_database: "SELECT o_orderkey::INTEGER AS mine, o_orderkey AS theirs, o_orderstatus AS status FROM orders WHERE o_orderkey IN (1, 2)",
    create_table: _steps("0 changed", "TABLE_EXISTS", "0 changed", "SCHEMA_ERROR", "SCHEMA_ERROR", "SCHEMA_ERROR", "0 rows"),
    drop_table: "WITH n AS (SELECT count(*) AS n FROM orders WHERE o_orderkey < 3) SELECT step, CASE WHEN step = 1 THEN n || ' rows' ELSE outcome END AS outcome FROM (" + _steps("", "0 changed", "TABLE_NOT_FOUND", "TABLE_NOT_FOUND", "0 changed", "0 changed", "0 rows") + ") CROSS JOIN n",
    describe: _values('"column", type, nullable, key, "default", auto_increment', "'k', 'BIGINT', false, 'PRI', NULL::VARCHAR, false", "'cust', 'BIGINT', true, '', NULL, false", "'status', 'VARCHAR(1)', false, '', NULL, false", "'price', 'DOUBLE', true, 'MUL', NULL, false"),
    show_tables: _values('"table"', "'b'", "'o'"),
    show_index: _values('"index", "column", sequence, "unique", "primary", ordered', "'primary', 'k', 1, true, true, false", "'by_price', 'price', 1, false, false, true", "'pair', 'cust', 1, true, false, false", "'pair', 'status', 2, true, false, false"),
    create_index: "SELECT o_orderkey AS k, o_custkey AS cust FROM orders WHERE o_custkey = 7 OR o_totalprice < 2000.0",
    index_errors: _steps("0 changed", "INDEX_EXISTS", "0 changed", "UNIQUE_VIOLATION", "UNKNOWN_COLUMN", "INDEX_NOT_FOUND", "0 changed", "SCHEMA_ERROR", "0 changed"),
    rename_table: f"{_BASE} WHERE o_orderstatus <> 'F'",
    move_table: "SELECT o_orderkey AS k, o_custkey AS cust, CASE WHEN o_totalprice < 50000.0 THEN 'M' ELSE o_orderstatus END AS status, o_totalprice AS price FROM orders",
    transfer_errors: "WITH n AS (SELECT count(*) AS n FROM orders WHERE o_orderkey <= 5) SELECT step, CASE WHEN step = 7 THEN n || ' rows' ELSE outcome END AS outcome FROM (" + _steps("TABLE_EXISTS", "TABLE_NOT_FOUND", "DATABASE_NOT_FOUND", "TABLE_EXISTS", "0 changed", "0 changed", "", "TABLE_NOT_FOUND") + ") CROSS JOIN n",
    alter_keys: "SELECT o_orderkey AS number, o_custkey AS cust, o_orderstatus AS status FROM orders",
    alter_auto_increment: _values("id, v", "1, 'x'", "700, 'y'", "701, 'z'"),
    alter_errors: _steps("UNIQUE_VIOLATION", "INVALID_VALUE", "NOT_NULL_VIOLATION", "SCHEMA_ERROR", "UNKNOWN_COLUMN", "SCHEMA_ERROR", "INDEX_NOT_FOUND", "0 changed"),
    compact_table: f"{_BASE} UNION ALL VALUES (-1, NULL, 'N', NULL::DOUBLE), (-2, NULL, 'N', NULL), (-3, NULL, 'N', NULL)",
    analyze_table: "SELECT count(*) AS row_count, count(DISTINCT o_orderstatus) AS statuses, count(*) - count(o_custkey) AS null_customers FROM orders",
    check_table: "SELECT 'ok' AS status, count(*) AS rows, '' AS errors FROM orders",
    checksum_table: "SELECT true AS same, false AS with_another_row",
    flush_tables: "SELECT 1 AS step, '0 changed' AS outcome UNION ALL SELECT 2, '0 changed' UNION ALL SELECT 3, count(*) || ' rows' FROM orders WHERE o_orderkey <= 10",
    set_variables: _values("variable_name, value, scope, dynamic, description", "'join_buffer_size', '65536', 'BOTH', 'YES', 'Bytes for joins; advisory.'", "'sort_buffer_size', '4194304', 'BOTH', 'YES', 'Bytes for sorting; advisory.'"),
    show_variables: _values("variable_name, value, scope, dynamic, description", "'engine_buffer_pool_size', '67108864', 'GLOBAL', 'YES', 'Bytes for decoded rows; Spark''s own memory is used.'", "'join_buffer_size', '2097152', 'BOTH', 'YES', 'Bytes for joins; advisory.'", "'sort_buffer_size', '2097152', 'BOTH', 'YES', 'Bytes for sorting; advisory.'"),
    insert_limit: _steps("1 changed", "0 changed", "RESOURCE_LIMIT", "2 changed", "0 changed", "2 changed", "5 rows"),
    variable_errors: _steps("UNKNOWN_SYSTEM_VARIABLE", "READ_ONLY_VARIABLE", "INVALID_VARIABLE_SCOPE", "INVALID_SYSTEM_VARIABLE", "0 changed", "3 rows", "16 rows"),
    insert_defaults: _values("id, v, t", "1, 7, 'new'", "2, 7, 'x'", "3, NULL, 'new'", "40, 7, 'new'"),
    unique_checks: _steps("UNIQUE_VIOLATION", "UNIQUE_VIOLATION", "NOT_NULL_VIOLATION", "UNIQUE_VIOLATION", "UNIQUE_VIOLATION", "1 changed", "5 changed", "UNIQUE_VIOLATION", "UNIQUE_VIOLATION", "1 changed", "UNIQUE_VIOLATION", "5 rows"),
    load_checks: _steps("1 changed", "UNIQUE_VIOLATION", "UNIQUE_VIOLATION", "INVALID_VALUE", "INVALID_VALUE"),
    scalar_subquery_row_order: _values("id, v", "1, 15"),
    limit_insertion_order: _values("k, price", "-1::BIGINT, 1.5::DOUBLE", "-2, NULL"),
    semantic_errors: _steps("AMBIGUOUS_COLUMN", "SQL_SEMANTIC", "SQL_SEMANTIC", "5 rows", "UNKNOWN_COLUMN", "TABLE_NOT_FOUND", "SQL_SEMANTIC", "SQL_SEMANTIC", "INVALID_VALUE", "MISSING_PARAMETER", "SQL_SYNTAX", "3 rows"),
    privileges: _steps("ACCESS_DENIED", "0 changed", "ROLE_EXISTS", "0 changed", "0 changed", "25 rows", "ACCESS_DENIED", "ACCESS_DENIED", "ACCESS_DENIED", "0 changed", "5 rows", "0 changed", "ACCESS_DENIED", "0 changed", "ACCESS_DENIED", "0 changed", "0 changed", "ACCESS_DENIED", "ROLE_NOT_FOUND"),
    statement_privileges: "SELECT step, CASE WHEN step = 21 THEN (SELECT count(*) FROM orders) || ' changed' ELSE outcome END AS outcome FROM (" + _steps(*[x for done in ("1 changed", "1 changed", "1 changed", "4 rows", "0 changed", "0 changed", "", "0 changed", "0 changed") for x in ("ACCESS_DENIED", "0 changed", done)]) + ")",
    policies_on_writes: _steps("0 changed", "0 changed", "POLICY_EXISTS", "POLICY_VIOLATION", "1 changed", "POLICY_VIOLATION", "1 changed", "0 rows", "1 changed", "POLICY_VIOLATION", "POLICY_NOT_FOUND", "0 changed", "1 changed"),
    policy_join: "SELECT n_name AS nation, CASE WHEN n_regionkey = 3 THEN r_name END AS region FROM nation JOIN region ON n_regionkey = r_regionkey",
    system_tables: _values("name, n", "'users_schema', 2::BIGINT", "'config_schema', 4", "'performance_schema.statements', 13", "'performance_schema.errors', 0", "'roles', 1", "'role_assignments', 1", "'privileges', 1", "'policies', 1", "'replication_log', 0", "'sys_config', 16"),
    sys_facts: _values("variable_name", "'version'", "'spark_version'", "'python_version'"),
    information_schema: "SELECT 'o' AS table_name, v.*, (SELECT count(*) FROM orders) AS table_rows FROM (VALUES ('k', 1, 'bigint', 'NO', 'PRI'), ('cust', 2, 'bigint', 'YES', ''), ('status', 3, 'varchar', 'NO', ''), ('price', 4, 'double', 'YES', 'MUL')) AS v(column_name, ordinal_position, data_type, is_nullable, column_key)",
    result_cache: _values("step, hits", "1, 0", "2, 1", "3, 1", "4, 1", "5, 2", "6, 2", "7, 2"),
    changes_prune: _values("log_id, change_type, n", "4::BIGINT, 'INSERT', 1::BIGINT"),
    statement_log: _values("log, statement, code", "'general', 'SELECT n_name FROM nation WHERE n_name = ? AND n_nationkey < ?', NULL::VARCHAR", "'general', 'CREATE ROLE extra', NULL", "'audit', 'CREATE ROLE extra', NULL", "'general', 'SELECT nope FROM nation', NULL", "'error', 'SELECT nope FROM nation', 'UNKNOWN_COLUMN'"),
}

QUERIES = {name: _run_sql(name) for name in SQL} | {f.__name__: f for f in TABLE_QUERIES}
ORACLE_SQL = {name: oracle for name, (_, oracle, _) in SQL.items()} | {f.__name__: sql for f, sql in TABLE_QUERIES.items() if sql}
