"""Tables made from the catalog: information_schema and sys, and the frames of SHOW and DESCRIBE."""

from __future__ import annotations

import datetime as dt
import platform
import time
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from .. import logs
from ..functions import types as ty
from ..functions.types import SqlType
from ..operators.access import SUPERUSER
from ..plans.lower import Relation
from .tables import Column, Index

if TYPE_CHECKING:
    from ..session import Engine

SYSTEM_DATABASE = "system"
#: The columns of information_schema.
INFORMATION = "table_catalog string, table_schema string, table_name string, table_type string, engine string, table_collation string, table_rows long, data_length long, index_length long, column_name string, ordinal_position int, data_type string, is_nullable string, column_default string, character_set_name string, collation_name string, column_key string, extra string"
STARTED = time.time()


def relation_of(df: DataFrame) -> Relation:
    return Relation(df, {f.name: ty.of_spark(f.dataType) or SqlType("LONGTEXT") for f in df.schema.fields})


def key_of(name: str, indexes: tuple[Index, ...]) -> str:
    mine = [i for i in indexes if name in i.columns]
    if any(i.primary for i in mine):
        return "PRI"
    return "UNI" if any(i.unique and len(i.columns) == 1 for i in mine) else "MUL" if mine else ""


def default_text(column: Column) -> str | None:
    d = column.default
    return None if not d else "CURRENT_TIMESTAMP" if "now" in d else "UUID()" if "uuid" in d else f"X'{d['hex']}'" if "hex" in d else str(d["value"])


def information_schema(engine: Engine, user: str) -> DataFrame:
    """One row for each column of each table that the user may see; none for an engine without a root. Row counts come from the manifests."""
    rows = []
    for database in engine.store.databases() if engine.store else ():
        for table in engine.store.tables(database):
            if not engine.access.allows(user, "SHOW", database, table) and not engine.access.allows(user, "SELECT", database, table):
                continue
            v = engine.store.current(database, table)
            count = engine.store.rows(database, table, v)
            size = engine.store.files.size(f"{engine.store.folder(database, table)}/data")
            for k, c in enumerate(v.columns, 1):
                text = c.type.name in ty.TEXTS
                rows.append((
                    "def", database, table, "BASE TABLE", "parquet", v.collation, count, size, 0, c.name, k, c.type.name.lower(), "YES" if c.nullable else "NO", default_text(c),
                    "utf8mb4" if text else None, v.collation if text else None, key_of(c.name, v.indexes), "auto_increment" if c.auto else "",
                ))
    return engine.spark.createDataFrame(rows, INFORMATION)


def sys_table(engine: Engine) -> DataFrame:
    facts = {
        "version": "1.0.0", "spark_version": engine.spark.version, "python_version": platform.python_version(), "os": platform.system(), "architecture": platform.machine(), "hostname": platform.node(),
        "server_time": dt.datetime.now(dt.UTC).strftime("%Y-%m-%d %H:%M:%S"), "uptime_seconds": str(int(time.time() - STARTED)), "master": engine.spark.sparkContext.master,
        "default_parallelism": str(engine.spark.sparkContext.defaultParallelism), "shuffle_partitions": engine.spark.conf.get("spark.sql.shuffle.partitions"),
    }
    return engine.spark.createDataFrame(list(facts.items()), "variable_name string, value string")


#: Tables of the system database that show the engine's own state.
SYSTEM_TABLES = ("users_schema", "roles", "role_assignments", "privileges", "policies", "replication_log", "sys_config", "config_schema", "performance_schema")


def system_table(engine: Engine, name: str) -> DataFrame:
    spark, access = engine.spark, engine.access
    if name == "users_schema":
        # There are no accounts; users are those that something was granted to.
        users = {SUPERUSER} | {g for g, *_ in access.privileges} | {m for _, m in access.members}
        return spark.createDataFrame([(u, u == SUPERUSER) for u in sorted(users - set(access.roles))], "username string, superuser boolean")
    if name == "config_schema":
        facts = {"root": engine.store.root if engine.store else None, "change_log": "ON" if engine.changes else "OFF", "attached_tables": str(len(engine.attached)), "slow_statement_ms": str(logs.SLOW_MS)}
        return spark.createDataFrame(list(facts.items()), "config_key string, config_value string")
    if name == "performance_schema":
        facts = engine.counters | {"cache_hits": engine.cache.hits, "cached_results": len(engine.cache.rows), "cached_bytes": engine.cache.bytes, "uptime_seconds": time.time() - STARTED}
        return spark.createDataFrame([(n, float(v)) for n, v in facts.items()], "metric_name string, metric_value double")
    if name == "roles":
        return spark.createDataFrame([(r,) for r in access.roles], "role string")
    if name == "role_assignments":
        return spark.createDataFrame([tuple(m) for m in access.members], "role string, grantee string")
    if name == "privileges":
        return spark.createDataFrame([tuple(p) for p in access.privileges], "grantee string, privilege string, database_name string, table_name string")
    if name == "policies":
        keys = ("name", "database", "table", "operation", "scope", "sql")
        return spark.createDataFrame([tuple(p[k] for k in keys) for p in access.policies], "name string, database_name string, table_name string, operation string, scope string, expression string")
    if name == "replication_log":
        return engine.changes.read() if engine.changes else spark.createDataFrame([], "log_id long, logged_at timestamp, source_database string, source_table string, change_type string, row_id long, row string, change_sql string")
    return spark.createDataFrame([(n, v, d) for n, v, _, _, d in engine.settings.rows("GLOBAL", {})], "variable_name string, variable_value string, description string")
