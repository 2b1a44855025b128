"""INSERT, UPDATE, DELETE and TRUNCATE on versions of a table: the new version, the number of rows, and what has changed."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import types as ty
from ..plans import ast as A
from ..plans.lower import ROW_ID, Context, Field, Scope, filtered
from ..sources.tables import Index, Store, Version
from .schema import check_absent, check_unique, default_of

#: Up to so many new keys are looked for by a list that is pushed down to the scan; more by a join.
MAX_LISTED_KEYS = 500


@dataclass
class Change:
    version: Version
    affected: int
    kind: str
    rows: DataFrame | None = None  # row id and the columns after the change (of deleted rows: the row id)
    last_id: int | None = None


def scope_of(context: Context, table: str, version: Version) -> Scope:
    return Scope(context, [Field(table, c.name, c.name, c.type) for c in version.columns])


def holds(node, kinds: tuple[type, ...]) -> bool:
    """Whether an expression has a node of one of the kinds."""
    if isinstance(node, kinds):
        return True
    return any(holds(x, kinds) for x in (vars(node).values() if hasattr(node, "__dataclass_fields__") else node if isinstance(node, tuple) else ()))


def _has_query(node) -> bool:
    return holds(node, (A.InQuery, A.Exists, A.Subquery))


def new_rows(version: Version, node: A.Statement, context: Context) -> tuple[list[tuple], Version, int | None]:
    """Coerced rows with row ids, the version with its sequences advanced, and the last AUTO_INCREMENT value."""
    names = node.columns if node.columns is not None else ([] if node.defaults else [c.name for c in version.columns])
    if len(set(names)) < len(names):
        raise EngineError("SQL_SEMANTIC", "INSERT names a column twice.")
    for n in names:
        version.column(n)
    row_id, auto, last, out = version.next_row, version.next_auto, None, []
    for cells in node.rows:
        if len(cells) != len(names):
            raise EngineError("SQL_SEMANTIC", f"INSERT has {len(names)} columns and a row of {len(cells)} values.")
        given = {n: c for n, c in zip(names, cells, strict=True) if not isinstance(c, A.Default)}
        row = [row_id]
        for c in version.columns:
            value = ty.coerce(context.constant(given[c.name]), c.type) if c.name in given else default_of(c, context.now)
            if c.auto:
                if value is None:
                    value = ty.coerce(auto, c.type)
                auto, last = max(auto, value + 1), value
            if value is None and not c.nullable:
                raise EngineError("NOT_NULL_VIOLATION", f"{c.name} takes no null.")
            row.append(value)
        out.append(tuple(row))
        row_id += 1
    return out, replace(version, next_row=row_id, next_auto=auto), last


def check_new_keys(existing: DataFrame, rows: list[tuple], version: Version) -> None:
    at = {c.name: k + 1 for k, c in enumerate(version.columns)}
    for index in version.indexes:
        if not index.unique:
            continue
        keys = [k for r in rows if None not in (k := tuple(r[at[c]] for c in index.columns))]
        problem = EngineError("UNIQUE_VIOLATION", f"The key {index.name} is not unique.")
        if len(set(keys)) < len(keys):
            raise problem
        if not keys or not version.files:
            continue
        columns = [version.column(c) for c in index.columns]
        if len(keys) <= MAX_LISTED_KEYS and len(columns) == 1:
            found = existing.where(F.col(f"`{columns[0].name}`").isin(*[ty.literal(k[0], columns[0].type) for k in keys]))
        else:
            wanted = existing.sparkSession.createDataFrame(keys, ", ".join(f"`k{i}` {c.type.spark.simpleString()}" for i, c in enumerate(columns)))
            same = F.lit(True)
            for i, c in enumerate(columns):
                same = same & (existing[f"`{c.name}`"] == wanted[f"k{i}"])
            found = existing.join(wanted, same, "left_semi")
        if not found.select(F.lit(1)).isEmpty():
            raise problem


def insert(store: Store, database: str, table: str, version: Version, node: A.Statement, context: Context, policy: SparkColumn | None, limit: int | None = None) -> Change:
    """``limit``: bytes that the values of literal rows, which the driver holds, may have."""
    rows, after, last = new_rows(version, node, context)
    if limit is not None and sum(len(v) if isinstance(v, (str, bytes)) else 8 for r in rows for v in r) > limit:
        raise EngineError("RESOURCE_LIMIT", f"The rows of an INSERT have more than {limit} bytes (max_heap_table_size).")
    check_new_keys(store.read(database, table, version), rows, version)
    df = store.spark.createDataFrame(rows, version.schema)
    _check_policy(df, policy)
    written = store.write(database, table, df.coalesce(1), version)
    return Change(replace(after, files=(*version.files, *written), statistics=None), len(rows), "INSERT", df, last)


def append(store: Store, database: str, table: str, version: Version, df: DataFrame, policy: SparkColumn | None) -> Change:
    """Load a DataFrame with the table's columns. Row ids follow its partitions; all checks run on executors."""
    columns, bad = [], F.lit(False)
    for c in version.columns:
        if c.name in df.columns:
            kind = ty.of_spark(df.schema[c.name].dataType)
            if kind is None:
                raise EngineError("INVALID_VALUE", f"{c.name} has a type that the engine lacks.")
            value, wrong = ty.convert(F.col(f"`{c.name}`"), kind, c.type)
            bad = bad | F.coalesce(wrong, F.lit(False))
            if not c.nullable:
                bad = bad | F.col(f"`{c.name}`").isNull()
        elif c.auto or not c.nullable:
            raise EngineError("NOT_NULL_VIOLATION", f"{c.name} is missing.")
        else:
            value = F.lit(None).cast(c.type.spark)
        columns.append(value.alias(c.name))
    if not df.where(bad).isEmpty():
        raise EngineError("INVALID_VALUE", "A row doesn't fit the columns' types.")
    rows = df.select((F.monotonically_increasing_id() + version.next_row).alias(ROW_ID), *columns)
    _check_policy(rows, policy)
    written = store.write(database, table, rows, version)
    stored = store.read(database, table, version, written)
    try:
        sums = stored.agg(F.count(F.lit(1)).alias("n"), F.max(ROW_ID).alias("last"), *([F.max(version.auto.name).alias("auto")] if version.auto else [])).first()
        for index in version.indexes:
            if index.unique:
                check_unique(stored, index)
                if version.files:
                    check_absent(store.read(database, table, version), stored, version, index)
    except EngineError:
        store.drop_files(database, table, written)
        raise
    auto = max(version.next_auto, (sums["auto"] or 0) + 1) if version.auto else version.next_auto
    return Change(replace(version, files=(*version.files, *written), next_row=(sums["last"] or version.next_row - 1) + 1, next_auto=auto, statistics=None), sums["n"], "INSERT", stored)


def _check_policy(rows: DataFrame, policy: SparkColumn | None) -> None:
    if policy is not None and not rows.where(~F.coalesce(policy, F.lit(False))).isEmpty():
        raise EngineError("POLICY_VIOLATION", "A row is outside what the row policies allow.")


def _matched(store: Store, database: str, table: str, version: Version, where, context: Context, policy: SparkColumn | None) -> tuple[DataFrame, list[str], int]:
    """The matched rows, the files that hold some (of the version's), and their number."""
    base = store.read(database, table, version)
    if policy is not None:
        base = base.where(policy)
    rows = filtered(base.withColumn("__file", F.input_file_name()), scope_of(context, table, version), where)
    counts = rows.groupBy("__file").count().collect()  # one row a file at most
    names = {r["__file"].rpartition("/data/")[2]: r["count"] for r in counts}
    files = [f for f in version.files if f.removeprefix("data/") in names]
    return rows.drop("__file"), files, sum(names.values())


def update(store: Store, database: str, table: str, version: Version, node: A.Statement, context: Context, policy: SparkColumn | None) -> Change:
    values = {n: ty.coerce(context.constant(v), version.column(n).type) for n, v in node.values.items()}
    for n, v in values.items():
        if v is None and not version.column(n).nullable:
            raise EngineError("NOT_NULL_VIOLATION", f"{n} takes no null.")
    matched, files, count = _matched(store, database, table, version, node.where, context, policy)
    if not count:
        return Change(version, 0, "UPDATE")
    new = {n: ty.literal(v, version.column(n).type) for n, v in values.items()}
    changed = matched.withColumns(new)
    _check_policy(changed, policy)
    held = store.read(database, table, version, tuple(files))
    if _has_query(node.where):
        rows = held.join(matched.select(ROW_ID), ROW_ID, "left_anti").unionByName(changed)
    else:
        hit = F.lit(True) if node.where is None else F.coalesce(scope_of(context, table, version).predicate(node.where), F.lit(False))
        hit = hit if policy is None else hit & F.coalesce(policy, F.lit(False))
        rows = held.select(ROW_ID, *[F.when(hit, new[c.name]).otherwise(F.col(f"`{c.name}`")).alias(c.name) if c.name in new else F.col(f"`{c.name}`") for c in version.columns])
    written = store.write(database, table, rows, version)
    kept = tuple(f for f in version.files if f not in files)
    auto = version.auto
    after = replace(version, files=(*kept, *written), statistics=None, next_auto=max(version.next_auto, values[auto.name] + 1) if auto and auto.name in values else version.next_auto)
    try:
        for index in version.indexes:
            if index.unique and set(index.columns) & set(values):
                _check_changed(store.read(database, table, after), changed, index, new, values)
    except EngineError:
        store.drop_files(database, table, written)
        raise
    return Change(after, count, "UPDATE", changed)


def _check_changed(after: DataFrame, changed: DataFrame, index: Index, new: dict[str, SparkColumn], values: dict[str, object]) -> None:
    """Fail if a changed row has the key of another. A key that is set as a whole is looked up; of others only the changed rows' keys are joined."""
    if any(values.get(c, "") is None for c in index.columns):
        return
    if set(index.columns) <= set(values):
        same = after
        for c in index.columns:
            same = same.where(F.col(f"`{c}`") == new[c])
        twice = len(same.select(F.lit(1)).limit(2).collect()) > 1
    else:
        mine = changed.select(F.col(ROW_ID).alias("__changed"), *[F.col(f"`{c}`") for c in index.columns]).dropna()
        twice = not after.join(mine, list(index.columns)).where(F.col(ROW_ID) != F.col("__changed")).isEmpty()
    if twice:
        raise EngineError("UNIQUE_VIOLATION", f"The key {index.name} is not unique.")


def delete(store: Store, database: str, table: str, version: Version, node: A.Statement, context: Context, policy: SparkColumn | None) -> Change:
    matched, files, count = _matched(store, database, table, version, node.where, context, policy)
    if not count:
        return Change(version, 0, "DELETE")
    left = store.read(database, table, version, tuple(files)).join(matched.select(ROW_ID), ROW_ID, "left_anti") if _has_query(node.where) else None
    if left is None:
        hit = F.lit(True) if node.where is None else F.coalesce(scope_of(context, table, version).predicate(node.where), F.lit(False))
        hit = hit if policy is None else hit & F.coalesce(policy, F.lit(False))
        left = store.read(database, table, version, tuple(files)).where(~hit)
    written = store.write(database, table, left, version)
    kept = tuple(f for f in version.files if f not in files)
    return Change(replace(version, files=(*kept, *written), statistics=None), count, "DELETE", matched.select(ROW_ID))


def truncate(version: Version, count: int) -> Change:
    return Change(replace(version, files=(), next_row=1, next_auto=1, statistics=None), count, "TRUNCATE")
