"""SELECT and predicates to DataFrames and Columns.

Every input's columns get names of their own (``__0_x``), so an expression is a plain Column however the inputs overlap. NOT is pushed to the leaves, so that an IN subquery, whose nulls are
ignored, can be planned as a semi or anti join (alone under AND) or an existence test (elsewhere).
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import EngineError
from ..functions import types as ty
from ..functions.text import json_path, like_pattern
from ..functions.types import SqlType
from . import ast as A

ROW_ID = "__row_id"
_OPS = {"=": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b}
_OPPOSITE = {"=": "!=", "!=": "=", "<": ">=", ">=": "<", ">": "<=", "<=": ">"}


@dataclass
class Relation:
    """A table as the planner sees it: columns with types, and the hidden row id if the table has one."""

    df: DataFrame
    types: dict[str, SqlType]
    has_row_id: bool = False
    #: The files that hold the first rows, so many, by row id; None where files can't be told apart.
    first: Callable[[int], DataFrame] | None = None


@dataclass(frozen=True)
class Field:
    alias: str
    name: str
    column: str
    type: SqlType


@dataclass
class Context:
    """What a statement needs besides its text."""

    relation: Callable[[tuple[str | None, str]], Relation]
    params: list | dict = field(default_factory=list)
    now: dt.datetime = field(default_factory=lambda: dt.datetime.now(dt.UTC))

    def param(self, key: int | str) -> object:
        try:
            if isinstance(key, int):
                return self.params[key]
            return self.params[key] if key in self.params else self.params[f":{key}"]
        except (KeyError, IndexError, TypeError):
            raise EngineError("MISSING_PARAMETER", f"There is no parameter {key!r}.") from None

    def constant(self, node) -> object:
        """The value of a literal, parameter, CURRENT_TIMESTAMP or UUID()."""
        if isinstance(node, A.Lit):
            return node.value
        if isinstance(node, A.Param):
            return self.param(node.key)
        if isinstance(node, A.Now):
            return self.now
        if isinstance(node, A.Uuid):
            return str(uuid.uuid4())
        raise EngineError("SQL_SEMANTIC", "Expected a constant.")


@dataclass
class Operand:
    """A lowered operand: ``type`` is None for JSON values; ``constant`` operands still have their Python value."""

    column: Column | None
    type: SqlType | None = None
    constant: bool = False
    value: object = None
    json: tuple[Column, str] | None = None

    @property
    def plain(self) -> Column:
        return _literal(self.value) if self.constant else self.column


def _literal(value: object) -> Column:
    return ty.literal(value, SqlType("TIMESTAMP")) if isinstance(value, dt.datetime) else F.lit(value)


class Scope:
    """Resolves names over the inputs of one SELECT."""

    def __init__(self, context: Context, fields: Iterable[Field]) -> None:
        self.context, self.fields = context, list(fields)

    def find(self, name: str, qualifier: str | None = None, at: int | None = None) -> Field:
        found = [f for f in self.fields if f.name == name and (qualifier is None or f.alias == qualifier)]
        if not found:
            raise EngineError("UNKNOWN_COLUMN", f"There is no column {qualifier + '.' if qualifier else ''}{name}.", at)
        if len(found) > 1:
            raise EngineError("AMBIGUOUS_COLUMN", f"More than one input has a column {name}.", at)
        return found[0]

    # Operands

    def operand(self, node) -> Operand:
        if isinstance(node, A.Col):
            f = self.find(node.name, node.qualifier, node.at)
            return Operand(F.col(f.column), f.type)
        if isinstance(node, A.Json):
            return self._json(node)
        if isinstance(node, A.Subquery):
            # The first row: by row id where the subquery has no order of its own.
            df, types = Planner(self.context).run(node.select if node.select.limit is not None else replace(node.select, limit=A.Lit(1)))
            first = df.columns[0]
            return Operand(df.limit(1).select(F.col(f"`{first}`")).scalar(), types[0])
        return Operand(None, None, True, self.context.constant(node))

    def _json(self, node: A.Json) -> Operand:
        path = json_path(self.context.constant(node.path))
        inner = self.operand(node.operand)
        if inner.constant:
            text = inner.value.decode("utf-8", "replace") if isinstance(inner.value, bytes) else inner.value
            if text is not None and not isinstance(text, str):
                text = str(text)
            source = F.lit(text).cast("string")
        elif inner.json is not None:
            source = inner.column
        else:
            source = F.decode(inner.column, "UTF-8") if inner.type.name in ty.BYTES else ty.as_text(inner.column, inner.type).cast("string")
        # An element that is null comes back as the text null; only where it does is the value looked at again.
        found = F.get_json_object(source, path)
        nothing = F.is_variant_null(F.try_variant_get(F.try_parse_json(source), path, "variant"))
        return Operand(F.when((found == "null") & nothing, None).otherwise(found), None, False, None, (source, path))

    def projected(self, node) -> tuple[Column, SqlType]:
        if isinstance(node, A.Lit):
            kind = SqlType("BIGINT") if isinstance(node.value, int) else SqlType("DOUBLE") if isinstance(node.value, float) else SqlType("LONGTEXT")
            return F.lit(node.value).cast(kind.spark), kind
        got = self.operand(node)
        return (got.plain if got.constant else got.column), got.type or SqlType("LONGTEXT")

    # Predicates

    def predicate(self, node, negated: bool = False) -> Column:
        if isinstance(node, A.Not):
            return self.predicate(node.item, not negated)
        if isinstance(node, A.Logic):
            items = [self.predicate(x, negated) for x in node.items]
            both = (node.op == "and") != negated
            out = items[0]
            for x in items[1:]:
                out = out & x if both else out | x
            return out
        if isinstance(node, A.Compare):
            return self._compare(_OPPOSITE[node.op] if negated else node.op, self.operand(node.left), self.operand(node.right))
        if isinstance(node, A.IsNull):
            got = self.operand(node.item)
            return got.plain.isNull() if node.negated == negated else got.plain.isNotNull()
        if isinstance(node, A.In):
            return self._in(node, node.negated != negated)
        if isinstance(node, A.InQuery):
            needle, sub, _ = self._in_query(node)
            found = needle.isin(sub)
            return needle.isNotNull() & (~found if node.negated != negated else found)
        if isinstance(node, A.Like):
            out = self._like(node)
            return ~out if node.negated != negated else out
        if isinstance(node, A.Exists):
            found = Planner(self.context).run(node.select)[0].limit(1).exists()
            return ~found if negated else found
        out = self._truth(self.operand(node.item))
        return ~out if negated else out

    def _compare(self, op: str, left: Operand, right: Operand) -> Column:
        apply = _OPS[op]
        if left.constant and right.constant:
            a, b = left.value, right.value
            if a is None or b is None:
                return F.lit(None).cast("boolean")
            if isinstance(a, str) != isinstance(b, str) and not (isinstance(a, bytes) or isinstance(b, bytes)):
                a, b = str(a), str(b)
            return apply(_literal(a), _literal(b))
        if left.json is not None or right.json is not None:
            return self._compare_json(apply, left, right)
        if left.constant:
            return apply(ty.literal(ty.coerce(left.value, right.type), right.type), right.column)
        if right.constant:
            return apply(left.column, ty.literal(ty.coerce(right.value, left.type), left.type))
        return apply(*_alike(left, right))

    def _compare_json(self, apply, left: Operand, right: Operand) -> Column:
        def side(mine: Operand, other: Operand) -> Column:
            if mine.json is None:
                return mine.plain.cast("double") if _numeric(mine) else mine.plain
            source, path = mine.json
            if other.json is not None:
                return mine.column
            if isinstance(other.value, bool) or (other.type and other.type.name == "BOOLEAN"):
                return F.try_variant_get(F.try_parse_json(source), path, "boolean")
            return F.try_variant_get(F.try_parse_json(source), path, "double") if _numeric(other) else mine.column

        return apply(side(left, right), side(right, left))

    def _in(self, node: A.In, negated: bool) -> Column:
        item, values = self.operand(node.item), [self.operand(v) for v in node.values]
        if not item.constant and item.json is None and all(v.constant for v in values):
            out = item.column.isin(*[ty.literal(ty.coerce(v.value, item.type), item.type) for v in values])
        else:
            out = self._compare("=", item, values[0])
            for v in values[1:]:
                out = out | self._compare("=", item, v)
        return ~out if negated else out

    def _in_query(self, node: A.InQuery) -> tuple[Column, DataFrame, str]:
        """The needle, the subquery's non-null values, and their name."""
        df, types = Planner(self.context).run(node.select)
        name = df.columns[0]
        sub = df.select(F.col(f"`{name}`").alias("__value")).where(F.col("__value").isNotNull())
        item = self.operand(node.item)
        needle = item.plain
        if item.constant:
            needle = ty.literal(ty.coerce(item.value, types[0]), types[0])
        elif item.type is not None:
            needle, value = _alike(item, Operand(F.col("__value"), types[0]))
            sub = sub.select(value.alias("__value"))
        return needle, sub, "__value"

    def _like(self, node: A.Like) -> Column:
        item, pattern = self.operand(node.item), self.operand(node.pattern)
        for got in (item, pattern):
            if (got.constant and got.value is not None and not isinstance(got.value, (str, bytes))) or (got.type is not None and got.type.name in ty.NUMBERS | {"BOOLEAN"}):
                raise EngineError("INVALID_VALUE", "LIKE compares texts.")
        text = F.lit(item.value).cast("string") if item.constant else item.column if item.type is None else ty.as_text(item.column, item.type).cast("string")
        if pattern.constant:
            if pattern.value is None:
                return F.lit(None).cast("boolean")
            value = pattern.value.decode() if isinstance(pattern.value, bytes) else pattern.value
            return text.like(like_pattern(value))
        # A pattern from a column: the same normalisation, by a regular expression.
        raw = pattern.column.cast("string")
        fixed = F.regexp_replace(F.regexp_replace(raw, r"(?s)\\([^%_\\])|(\\[%_\\])", "$1$2"), r"(?s)^((?:[^\\]|\\.)*)\\$", r"$1\\\\")
        return F.like(text, fixed)

    def _truth(self, got: Operand) -> Column:
        if got.constant:
            v = got.value
            return F.lit(None if v is None else bool(v) and v not in ("0", b"0")).cast("boolean")
        c = got.column
        if got.type is None:
            return (c != "") & (c != "0") & (c != "false")
        if got.type.name == "BOOLEAN":
            return c
        if got.type.name in ty.NUMBERS:
            return c != 0
        if got.type.name in ty.BYTES:
            return (F.octet_length(c) > 0) & (c != F.lit(b"0"))
        return F.lit(True) & c.isNotNull() if got.type.name in ty.TIMES else (c != "") & (c != "0")


def _numeric(got: Operand) -> bool:
    return (got.constant and isinstance(got.value, (int, float)) and not isinstance(got.value, bool)) or (got.type is not None and got.type.name in ty.NUMBERS)


def _alike(a: Operand, b: Operand) -> tuple[Column, Column]:
    """Two columns that can be compared; text and numbers can't."""
    kinds = [("number" if x.type.name in ty.NUMBERS else "text" if x.type.name in ty.TEXTS else "time" if x.type.name in ty.TIMES else "bytes" if x.type.name in ty.BYTES else "boolean") if x.type else "text" for x in (a, b)]
    if kinds[0] == kinds[1]:
        if kinds[0] == "time" and a.type.name != b.type.name:
            return a.column.cast("timestamp_ntz"), b.column.cast("timestamp_ntz")
        return a.column, b.column
    if set(kinds) == {"text", "time"}:
        return (ty.as_text(a.column, a.type) if a.type else a.column), (ty.as_text(b.column, b.type) if b.type else b.column)
    if set(kinds) == {"boolean", "number"}:
        return tuple(x.column.cast("int") if k == "boolean" else x.column for x, k in zip((a, b), kinds, strict=True))
    raise EngineError("SQL_SEMANTIC", f"A {kinds[0]} column can't be compared with a {kinds[1]} column.")


def _conjuncts(node) -> list:
    if isinstance(node, A.Logic) and node.op == "and":
        return [x for item in node.items for x in _conjuncts(item)]
    if isinstance(node, A.Not) and isinstance(node.item, A.InQuery):
        return [A.InQuery(node.item.item, node.item.select, not node.item.negated)]
    return [node]


def filtered(df: DataFrame, scope: Scope, where) -> DataFrame:
    """Rows for which the predicate is true. IN subqueries alone under AND become semi and anti joins on equality."""
    if where is None:
        return df
    rest, joins = [], []
    for node in _conjuncts(where):
        (joins if isinstance(node, A.InQuery) else rest).append(node)
    for node in rest:
        df = df.where(scope.predicate(node))
    for node in joins:
        needle, sub, value = scope._in_query(node)  # noqa: SLF001
        if node.negated:
            df = df.where(needle.isNotNull())
        df = df.withColumn("__needle", needle).join(sub, F.col("__needle") == F.col(value), "left_anti" if node.negated else "left_semi").drop("__needle")
    return df


class Planner:
    def __init__(self, context: Context) -> None:
        self.context = context
        #: The result with a further column of JSON for each JSON_EXTRACT, by the name of the column that it is for; None without one.
        self.native: tuple[DataFrame, dict[str, str]] | None = None

    def run(self, select: A.Select) -> tuple[DataFrame, list[SqlType]]:
        """The result and the types of its columns."""
        df, scope, row_ids = self._from(select.sources, self._wanted(select))
        df = filtered(df, scope, select.where)
        if select.group or any(isinstance(p.expr, A.Agg) for p in select.projections) or select.having is not None:
            return self._grouped(df, scope, select)
        order = []
        for name, down in select.order:
            column = F.col(scope.find(name).column)
            order.append(column.desc() if down else column.asc())
        bounded = select.limit is not None or select.offset is not None
        if order or bounded:
            # Ties, and rows without an order, stand as they were inserted.
            order += [F.col(c) for c in row_ids] if order or bounded else []
            if order:
                df = df.orderBy(*order)
        names, columns, types = self._projection(scope, select)
        df = self._bounds(df, select)
        shown = [c.alias(n) for c, n in zip(columns, names, strict=True)]
        values = {p.name: scope.operand(p.expr).json for p in select.projections if isinstance(p.expr, A.Json)}
        if values:
            hidden = {n: f"__json_{k}" for k, n in enumerate(values)}
            self.native = df.select(*shown, *[F.to_json(F.try_variant_get(F.try_parse_json(source), path, "variant")).alias(hidden[n]) for n, (source, path) in values.items()]), hidden
        return df.select(*shown), types

    def _wanted(self, select: A.Select) -> int | None:
        """How many rows a SELECT with nothing but bounds can use."""
        plain = len(select.sources) == 1 and select.where is None and not select.order and not select.group and select.having is None and not any(isinstance(p.expr, A.Agg) for p in select.projections)
        return (self._bound(select.offset) or 0) + self._bound(select.limit) if plain and select.limit is not None else None

    def _from(self, sources: tuple[A.Source, ...], wanted: int | None = None) -> tuple[DataFrame, Scope, list[str]]:
        out, fields, row_ids, seen = None, [], [], set()
        for k, source in enumerate(sources):
            if source.alias in seen:
                raise EngineError("SQL_SEMANTIC", f"Two inputs are named {source.alias}.")
            seen.add(source.alias)
            relation = self.context.relation(source.table)
            own = [Field(source.alias, name, f"__{k}_{name}", kind) for name, kind in relation.types.items()]
            columns = [F.col(f"`{f.name}`").alias(f.column) for f in own]
            if relation.has_row_id:
                row_ids.append(f"__{k}{ROW_ID}")
                columns.append(F.col(ROW_ID).alias(row_ids[-1]))
            df = (relation.df if wanted is None or relation.first is None else relation.first(wanted)).select(*columns)
            fields += own
            if out is None:
                out = df
            elif source.join == "cross":
                out = out.crossJoin(df)
            else:
                out = out.join(df, Scope(self.context, fields).predicate(source.on), source.join)
        return out, Scope(self.context, fields), row_ids

    def _projection(self, scope: Scope, select: A.Select) -> tuple[list[str], list[Column], list[SqlType]]:
        if not select.projections:
            many = len(select.sources) > 1
            return [f"{f.alias}.{f.name}" if many else f.name for f in scope.fields], [F.col(f"`{f.column}`") for f in scope.fields], [f.type for f in scope.fields]
        names = [p.name for p in select.projections]
        _unique(names)
        made = [scope.projected(p.expr) for p in select.projections]
        return names, [c for c, _ in made], [t for _, t in made]

    def _grouped(self, df: DataFrame, scope: Scope, select: A.Select) -> tuple[DataFrame, list[SqlType]]:
        if not select.projections:
            raise EngineError("SQL_SEMANTIC", "A grouped query names its columns.")
        names = [p.name for p in select.projections]
        _unique(names)
        keys = [scope.find(c.name, c.qualifier, c.at) for c in select.group]
        aggregates, outputs, types = [], [], []
        for k, p in enumerate(select.projections):
            if isinstance(p.expr, A.Agg):
                column, kind = self._aggregate(scope, p.expr)
                aggregates.append(column.alias(f"__agg_{k}"))
                outputs.append(F.col(f"__agg_{k}"))
            elif isinstance(p.expr, A.Lit):
                column, kind = scope.projected(p.expr)
                outputs.append(column)
            else:
                node = p.expr.operand if isinstance(p.expr, A.Json) else p.expr
                if not isinstance(node, A.Col) or scope.find(node.name, node.qualifier, node.at) not in keys:
                    raise EngineError("SQL_SEMANTIC", f"{p.name} is neither aggregated nor a group key.")
                column, kind = scope.projected(p.expr)
                outputs.append(column)
            types.append(kind)
        columns = [F.col(f"`{f.column}`") for f in keys]
        if keys:
            df = df.groupBy(*columns).agg(*aggregates) if aggregates else df.select(*columns).distinct()
        else:
            df = df.agg(*aggregates)
        df = df.select(*[c.alias(n) for c, n in zip(outputs, names, strict=True)])
        after = Scope(self.context, [Field("", n, f"`{n}`", t) for n, t in zip(names, types, strict=True)])
        df = filtered(df, after, select.having)
        if select.order:
            df = df.orderBy(*[(F.col(after.find(n).column).desc() if down else F.col(after.find(n).column).asc()) for n, down in select.order])
        return self._bounds(df, select), types

    def _aggregate(self, scope: Scope, agg: A.Agg) -> tuple[Column, SqlType]:
        if agg.arg is None:
            return F.count(F.lit(1)), SqlType("BIGINT")
        f = scope.find(agg.arg.name, agg.arg.qualifier, agg.arg.at)
        column = F.col(f"`{f.column}`")
        if agg.func == "COUNT":
            return F.count(column), SqlType("BIGINT")
        if agg.func in ("MIN", "MAX"):
            return (F.min if agg.func == "MIN" else F.max)(column), f.type
        value = ty.number(column, f.type)
        if value is None:
            value = F.lit(None).cast("double")
        return (F.coalesce(F.sum(value), F.lit(0.0)) if agg.func == "SUM" else F.avg(value)), SqlType("DOUBLE")

    def _bound(self, node) -> int | None:
        if node is None:
            return None
        value = self.context.constant(node)
        if isinstance(value, bool) or not isinstance(value, int) or value < 0:
            raise EngineError("SQL_SEMANTIC", "LIMIT and OFFSET take whole numbers from 0.")
        return min(value, 2**31 - 1)

    def _bounds(self, df: DataFrame, select: A.Select) -> DataFrame:
        offset, limit = self._bound(select.offset), self._bound(select.limit)
        if offset:
            df = df.offset(offset)
        return df if limit is None else df.limit(limit)


def _unique(names: list[str]) -> None:
    if len({n.lower() for n in names}) < len(names):
        raise EngineError("SQL_SEMANTIC", "Two result columns have the same name; use AS.")
