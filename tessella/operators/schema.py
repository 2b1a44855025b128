"""Definitions: CREATE TABLE and ALTER TABLE on versions of a table."""

from __future__ import annotations

import datetime as dt
import re
import unicodedata
import uuid
from dataclasses import replace

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import types as ty
from ..plans import ast as A
from ..plans.lower import ROW_ID
from ..sources.tables import Column, Index, Store, Version

_DEVICES = frozenset(["con", "prn", "aux", "nul", *(f"{n}{i}" for n in ("com", "lpt") for i in range(1, 10))])
KEY_BYTES = 65_535


def check_name(name: str) -> str:
    if not 0 < len(name) <= 64 or any(unicodedata.combining(c) for c in name) or name.split(".")[0] in _DEVICES or re.search(r"[/\\\x00-\x1f.]", name) or name.startswith("_"):
        raise EngineError("SCHEMA_ERROR", f"{name!r} can't be a name.")
    return name


def compile_column(node: A.ColumnDef) -> Column:
    kind = ty.declared(node.type, node.length)
    default = None
    if isinstance(node.default, A.Now):
        if kind.name not in ty.TIMES:
            raise EngineError("SCHEMA_ERROR", "CURRENT_TIMESTAMP is a default for TIMESTAMP and DATETIME only.")
        default = {"now": True}
    elif isinstance(node.default, A.Uuid):
        if kind.name != "UUID":
            raise EngineError("SCHEMA_ERROR", "UUID() is a default for UUID only.")
        default = {"uuid": True}
    elif node.default is not None and node.default.value is not None:
        value = node.default.value
        ty.coerce(value, kind)
        default = {"hex": value.hex()} if isinstance(value, bytes) else {"value": value}
    if node.auto and (kind.name not in ty.BITS or default is not None):
        raise EngineError("SCHEMA_ERROR", "AUTO_INCREMENT takes a whole-number column without a default.")
    return Column(check_name(node.name), kind, node.nullable and not node.auto, default, node.auto)


def default_of(column: Column, now: dt.datetime) -> object:
    """The default of one new row, coerced; None if there is none."""
    d = column.default
    if not d:
        return None
    value = now if "now" in d else str(uuid.uuid4()) if "uuid" in d else bytes.fromhex(d["hex"]) if "hex" in d else d["value"]
    return ty.coerce(value, column.type)


def add_index(version: Version, node: A.IndexDef) -> Version:
    names = [c.name for c in version.columns]
    if not node.columns or len(set(node.columns)) < len(node.columns):
        raise EngineError("SCHEMA_ERROR", "An index names each of its columns once.")
    for c in node.columns:
        if c not in names:
            raise EngineError("UNKNOWN_COLUMN", f"There is no column {c}.")
        if version.column(c).type.name in ty.NOT_INDEXABLE:
            raise EngineError("SCHEMA_ERROR", f"{c}: {version.column(c).type} can't be indexed.")
    taken = {i.name for i in version.indexes}
    if node.primary and version.primary:
        raise EngineError("SCHEMA_ERROR", "There is a primary key already.")
    name = node.name
    if name is None:
        name = base = f"{'uniq' if node.unique else 'idx'}_{'_'.join(node.columns)}"[:56]
        k = 2
        while name in taken:
            name, k = f"{base}_{k}", k + 1
    if name in taken:
        raise EngineError("INDEX_EXISTS", f"There is an index {name} already.")
    columns = tuple(replace(c, nullable=False) if node.primary and c.name in node.columns else c for c in version.columns)
    return replace(version, columns=columns, indexes=(*version.indexes, Index(check_name(name) if name != "primary" else name, tuple(node.columns), node.unique, node.primary, node.ordered)))


def create(columns: list[A.ColumnDef], indexes: list[A.IndexDef]) -> Version:
    made = tuple(compile_column(c) for c in columns)
    if not made or len({c.name for c in made}) < len(made):
        raise EngineError("SCHEMA_ERROR", "A table has columns, with different names.")
    version = Version(uuid.uuid4().hex, 0, made)
    for node in indexes:
        version = add_index(version, node)
    check_auto(version)
    return version


def check_auto(version: Version) -> None:
    autos = [c for c in version.columns if c.auto]
    if len(autos) > 1 or (autos and not any(i.unique and i.columns == (autos[0].name,) for i in version.indexes)):
        raise EngineError("SCHEMA_ERROR", "AUTO_INCREMENT takes one column, with a unique or primary key of its own.")


def check_unique(rows: DataFrame, index: Index) -> None:
    """Fail if two rows have the same key; rows with a null in it don't count."""
    keys = [F.col(f"`{c}`") for c in index.columns]
    if not rows.select(*keys).dropna().groupBy(*keys).count().where(F.col("count") > 1).isEmpty():
        raise EngineError("UNIQUE_VIOLATION", f"The key {index.name} is not unique.")


def check_absent(existing: DataFrame, rows: DataFrame, version: Version, index: Index) -> None:
    """Fail if a row of ``existing`` has a key of ``rows``. Files and row groups outside the range of the new keys are passed over."""
    keys = [f"`{c}`" for c in index.columns]
    if version.column(index.columns[0]).type.name in ty.NUMBERS | ty.TEXTS:
        low, high = rows.agg(F.min(keys[0]), F.max(keys[0])).first()
        if low is None:
            return
        existing = existing.where(F.col(keys[0]).between(low, high))
    if not existing.select(*keys).join(rows.select(*keys).dropna(), list(index.columns), "left_semi").isEmpty():
        raise EngineError("UNIQUE_VIOLATION", f"The key {index.name} is not unique.")


def check_key_size(rows: DataFrame, version: Version, index: Index) -> None:
    total = F.lit(0)
    for c in index.columns:
        if version.column(c).type.name in ty.TEXTS | ty.BYTES:
            total = total + F.coalesce(F.octet_length(F.col(f"`{c}`")), F.lit(0))
    if not rows.where(total > KEY_BYTES).isEmpty():
        raise EngineError("INVALID_VALUE", f"A key of {index.name} is longer than {KEY_BYTES} bytes.")


def alter(store: Store, database: str, table: str, version: Version, actions: list[tuple], now: dt.datetime) -> Version:
    """The version after the actions, its rows written anew if columns have changed. RENAME TO is left to the session."""
    rows: DataFrame | None = None
    current = lambda: store.read(database, table, version) if rows is None else rows
    rebuilt = False
    for action in actions:
        kind, rest = action[0], action[1:]
        if kind == "add_index":
            version = add_index(version, rest[0])
            index = version.indexes[-1]
            check_key_size(current(), version, index)
            if index.primary and not current().where(_any_null(index.columns)).isEmpty():
                raise EngineError("NOT_NULL_VIOLATION", "A primary key has no nulls.")
            if index.unique:
                check_unique(current(), index)
            rebuilt = rebuilt or index.ordered
            rows = current() if index.ordered else rows
        elif kind == "drop_index":
            version = drop_index(version, rest[0])
        elif kind == "rename_index":
            old, new = rest
            if old not in {i.name for i in version.indexes} or old == "primary":
                raise EngineError("INDEX_NOT_FOUND", f"There is no index {old}.")
            if new in {i.name for i in version.indexes}:
                raise EngineError("INDEX_EXISTS", f"There is an index {new} already.")
            version = replace(version, indexes=tuple(replace(i, name=check_name(new)) if i.name == old else i for i in version.indexes))
        elif kind == "auto_increment":
            if version.auto is None:
                raise EngineError("SCHEMA_ERROR", "No column is AUTO_INCREMENT.")
            version = replace(version, next_auto=max(1, rest[0]))
        elif kind == "collate":
            version = replace(version, collation=rest[0])
        elif kind == "add_column":
            column = compile_column(rest[0])
            if column.name in {c.name for c in version.columns}:
                raise EngineError("SCHEMA_ERROR", f"There is a column {column.name} already.")
            value = F.expr("uuid()") if column.default and "uuid" in column.default else ty.literal(default_of(column, now), column.type)
            rows = current()
            if column.auto:
                value = F.col(ROW_ID).cast(column.type.spark)
            elif not column.nullable and column.default is None and not rows.isEmpty():
                raise EngineError("NOT_NULL_VIOLATION", f"{column.name} needs a default.")
            rows, rebuilt = rows.withColumn(column.name, value), True
            version = replace(version, columns=(*version.columns, column), next_auto=version.next_row if column.auto else version.next_auto)
            for node in rest[1]:
                version = add_index(version, node)
                if version.indexes[-1].unique:
                    check_unique(rows, version.indexes[-1])
        elif kind == "drop_column":
            column = version.column(rest[0])
            if column.auto or any(column.name in i.columns for i in version.indexes) or len(version.columns) == 1:
                raise EngineError("SCHEMA_ERROR", f"{column.name} is indexed, counts up, or is the only column.")
            rows, rebuilt = current().drop(column.name), True
            version = replace(version, columns=tuple(c for c in version.columns if c is not column))
        elif kind == "rename_column":
            rows, rebuilt = current().withColumnRenamed(*rest), True
            version = _renamed(version, *rest)
        elif kind == "change_column":
            old, column = version.column(rest[0]), compile_column(rest[1])
            column = replace(column, nullable=column.nullable and not (version.primary and old.name in version.primary.columns))
            if old.auto and column.type.name not in ty.BITS:
                raise EngineError("SCHEMA_ERROR", "AUTO_INCREMENT takes a whole-number column.")
            value, bad = ty.convert(F.col(f"`{old.name}`"), old.type, column.type)
            rows = current()
            if not rows.where(bad).isEmpty():
                raise EngineError("INVALID_VALUE", f"{old.name} holds what is no value of {column.type}.")
            if not column.nullable and not rows.where(F.col(f"`{old.name}`").isNull()).isEmpty():
                raise EngineError("NOT_NULL_VIOLATION", f"{old.name} holds nulls.")
            rows, rebuilt = rows.withColumn(old.name, value).withColumnRenamed(old.name, column.name), True
            version = _renamed(version, old.name, column.name) if old.name != column.name else version
            version = replace(version, columns=tuple(column if c.name == column.name else c for c in version.columns))
            for node in rest[2]:
                version = add_index(version, node)
            for i in version.indexes:
                if column.name in i.columns:
                    if column.type.name in ty.NOT_INDEXABLE:
                        raise EngineError("SCHEMA_ERROR", f"{column.type} can't be indexed.")
                    if i.unique:
                        check_unique(rows, i)
        else:
            raise EngineError("SQL_UNSUPPORTED", f"ALTER TABLE {kind} is not supported.")
        check_auto(version)
    if rebuilt and rows is not None and version.files:
        ordered = next((i for i in version.indexes if i.ordered), None)
        if ordered is not None:
            rows = rows.repartitionByRange(*[F.col(f"`{c}`") for c in (*ordered.columns, ROW_ID)])  # row ids part equal keys
        version = replace(version, files=store.write(database, table, rows, version), statistics=None)
    return version


def drop_index(version: Version, name: str) -> Version:
    found = next((i for i in version.indexes if i.name == name), None)
    if found is None:
        raise EngineError("INDEX_NOT_FOUND", f"There is no index {name}.")
    return replace(version, indexes=tuple(i for i in version.indexes if i is not found))


def _renamed(version: Version, old: str, new: str) -> Version:
    version.column(old)
    if new in {c.name for c in version.columns}:
        raise EngineError("SCHEMA_ERROR", f"There is a column {new} already.")
    check_name(new)
    swap = lambda n: new if n == old else n
    return replace(version, columns=tuple(replace(c, name=swap(c.name)) for c in version.columns), indexes=tuple(replace(i, columns=tuple(map(swap, i.columns))) for i in version.indexes))


def _any_null(columns: tuple[str, ...]) -> SparkColumn:
    out = F.lit(False)
    for c in columns:
        out = out | F.col(f"`{c}`").isNull()
    return out
