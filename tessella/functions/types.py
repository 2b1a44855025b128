"""The sixteen types: what each accepts, and how values and columns are turned into it.

Python values (literals, parameters, cells) are coerced here, strictly; columns are coerced by Spark expressions with the same rules when a column changes its type.
"""

from __future__ import annotations

import datetime as dt
import json
import math
import re
import struct
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import EngineError

_WHOLE = re.compile(r"[+-]?\d+")
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[1-8][0-9a-f]{3}-[89ab][0-9a-f]{3}-[0-9a-f]{12}")
#: What a text must look like to count as a number in SUM and AVG.
NUMERIC = r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"
TEXT_BYTES = 65_535
#: Bits of the whole-number types.
BITS = {"TINYINT": 8, "INT": 32, "BIGINT": 64}
NUMBERS = frozenset([*BITS, "FLOAT", "DOUBLE", "REAL"])
TEXTS = frozenset(["VARCHAR", "TEXT", "LONGTEXT", "UUID", "JSON"])
BYTES = frozenset(["BINARY", "BLOB"])
TIMES = frozenset(["TIMESTAMP", "DATETIME"])
NOT_INDEXABLE = frozenset(["TEXT", "LONGTEXT", "BLOB", "JSON"])
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss.SSSSSS"


@dataclass(frozen=True)
class SqlType:
    name: str
    length: int | None = None

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self.name]

    def __str__(self) -> str:
        return f"{self.name}({self.length})" if self.length is not None else self.name


_SPARK = {
    "TINYINT": T.ByteType(), "INT": T.IntegerType(), "BIGINT": T.LongType(), "FLOAT": T.FloatType(), "DOUBLE": T.DoubleType(), "REAL": T.DoubleType(), "BOOLEAN": T.BooleanType(), "VARCHAR": T.StringType(),
    "TEXT": T.StringType(), "LONGTEXT": T.StringType(), "BINARY": T.BinaryType(), "BLOB": T.BinaryType(), "TIMESTAMP": T.TimestampType(), "DATETIME": T.TimestampNTZType(), "UUID": T.StringType(), "JSON": T.StringType(),
}
_FROM_SPARK = {"tinyint": "TINYINT", "smallint": "INT", "int": "INT", "bigint": "BIGINT", "float": "FLOAT", "double": "DOUBLE", "boolean": "BOOLEAN", "string": "LONGTEXT", "binary": "BLOB", "timestamp": "TIMESTAMP", "timestamp_ntz": "DATETIME"}


def of_spark(kind: T.DataType) -> SqlType | None:
    """The type of a column of a foreign table; None if the dialect has none (arrays, maps, structs)."""
    name = kind.simpleString()
    if name.startswith(("varchar", "char")):
        return SqlType("LONGTEXT")
    return SqlType("DOUBLE") if name.startswith("decimal") else SqlType("DATETIME") if name == "date" else SqlType(_FROM_SPARK[name]) if name in _FROM_SPARK else None


def declared(name: str, length: int | None) -> SqlType:
    if name == "VARCHAR":
        length = 255 if length is None else length
        if not 1 <= length <= 65_535:
            raise EngineError("SCHEMA_ERROR", "VARCHAR takes a length from 1 to 65535.")
    elif name == "BINARY":
        if length is None or not 1 <= length <= 65_535:
            raise EngineError("SCHEMA_ERROR", "BINARY takes a length from 1 to 65535.")
    elif length is not None:
        raise EngineError("SCHEMA_ERROR", f"{name} takes no length.")
    return SqlType(name, length)


def _bad(value: object, kind: SqlType) -> EngineError:
    return EngineError("INVALID_VALUE", f"{value!r:.80} is no value of {kind}.")


def _whole(value, kind):
    if isinstance(value, str) and _WHOLE.fullmatch(value):
        value = int(value)
    half = 2 ** (BITS[kind.name] - 1)
    if isinstance(value, bool) or not isinstance(value, int) or not -half <= value < half:
        raise _bad(value, kind)
    return value


def _real(value, kind):
    if isinstance(value, str) and re.match(NUMERIC, value):
        value = float(value)
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        raise _bad(value, kind)
    try:
        out = struct.unpack("f", struct.pack("f", value))[0] if kind.name == "FLOAT" else float(value)
    except OverflowError:
        raise _bad(value, kind) from None
    if not math.isfinite(out):
        raise _bad(value, kind)
    return out


def _boolean(value, kind):
    if isinstance(value, str):
        value = {"1": True, "0": False, "true": True, "false": False}.get(value.lower(), value)
    if value in (0, 1) and not isinstance(value, (str, float)):
        return bool(value)
    raise _bad(value, kind)


def _text(value, kind):
    if not isinstance(value, str):
        raise _bad(value, kind)
    if (kind.name == "VARCHAR" and len(value) > kind.length) or (kind.name == "TEXT" and len(value.encode()) > TEXT_BYTES):
        raise _bad(value, kind)
    return value


def _bytes(value, kind):
    value = value.encode() if isinstance(value, str) else bytes(value) if isinstance(value, (bytes, bytearray, memoryview)) else None
    if value is None or (kind.length is not None and len(value) > kind.length):
        raise _bad(value, kind)
    return value.ljust(kind.length, b"\0") if kind.length is not None else value


def _time(value, kind):
    """TIMESTAMP: an instant, in UTC unless the text has a zone. DATETIME: wall-clock time without a zone."""
    if isinstance(value, int) and not isinstance(value, bool) and kind.name == "TIMESTAMP":
        value = dt.datetime.fromtimestamp(value, dt.UTC)
    elif isinstance(value, str):
        try:
            value = dt.datetime.fromisoformat(value.strip())
        except ValueError:
            raise _bad(value, kind) from None
    elif isinstance(value, dt.date) and not isinstance(value, dt.datetime):
        value = dt.datetime(value.year, value.month, value.day)
    if not isinstance(value, dt.datetime):
        raise _bad(value, kind)
    if kind.name == "DATETIME":
        return value.replace(tzinfo=None)
    return value.replace(tzinfo=dt.UTC) if value.tzinfo is None else value.astimezone(dt.UTC)


def _uuid(value, kind):
    if not isinstance(value, str) or not _UUID.fullmatch(value.lower()):
        raise _bad(value, kind)
    return value.lower()


def _json(value, kind):
    try:
        if isinstance(value, str):
            value = json.loads(value, parse_constant=lambda _: 1 / 0)
        return json.dumps(value, ensure_ascii=False, separators=(",", ":"), allow_nan=False)
    except (ValueError, TypeError, ZeroDivisionError):
        raise _bad(value, kind) from None


_RULES: dict[str, Callable] = {
    **dict.fromkeys(BITS, _whole), **dict.fromkeys(("FLOAT", "DOUBLE", "REAL"), _real), **dict.fromkeys(("VARCHAR", "TEXT", "LONGTEXT"), _text), **dict.fromkeys(BYTES, _bytes), **dict.fromkeys(TIMES, _time),
    "BOOLEAN": _boolean, "UUID": _uuid, "JSON": _json,
}


def coerce(value: object, kind: SqlType) -> object:
    """``value`` as a value of the type, or INVALID_VALUE; None stays None."""
    return None if value is None else _RULES[kind.name](value, kind)


def literal(value: object, kind: SqlType) -> Column:
    """A coerced value as a constant column."""
    if isinstance(value, dt.datetime):
        return F.lit(value.replace(tzinfo=None).isoformat(" ")).cast("timestamp_ntz").cast(kind.spark) if kind.name == "DATETIME" else F.lit(value.isoformat()).cast(kind.spark)
    return F.lit(value).cast(kind.spark)


def as_text(column: Column, kind: SqlType) -> Column:
    """Times as the text that they show; texts as they are."""
    return F.date_format(column, TIME_FORMAT) if kind.name in TIMES else column


def number(column: Column, kind: SqlType) -> Column | None:
    """What SUM and AVG add up: DOUBLE, null for what is no number; None for types that have no numbers."""
    if kind.name in NUMBERS:
        return column.cast("double")
    if kind.name in TEXTS:
        return F.when(column.rlike(NUMERIC), F.trim(column).cast("double"))
    return None


def convert(column: Column, old: SqlType, new: SqlType) -> tuple[Column, Column]:
    """The column in another type, and whether a value can't be converted (checked before the result is used)."""
    if old == new:
        return column, F.lit(False)
    if new.name in ("VARCHAR", "TEXT", "LONGTEXT"):
        if old.name not in TEXTS | TIMES:
            return F.lit(None).cast("string"), column.isNotNull()
        text = as_text(column, old)
        long = F.char_length(text) > new.length if new.name == "VARCHAR" else F.octet_length(text) > TEXT_BYTES if new.name == "TEXT" else F.lit(False)
        return text, F.coalesce(long, F.lit(False))
    if new.name in BYTES and old.name in BYTES | TEXTS:
        raw = column.cast("binary")
        out = F.rpad(raw, new.length, b"\0") if new.length else raw
        return out, F.coalesce(F.octet_length(raw) > new.length, F.lit(False)) if new.length else F.lit(False)
    if new.name in NUMBERS and old.name in NUMBERS | TEXTS:
        ok = F.lit(True)
        if old.name in TEXTS:
            ok = column.rlike(r"^[+-]?\d+$" if new.name in BITS else NUMERIC)
        elif new.name in BITS and old.name not in BITS:
            return F.lit(None).cast(new.spark), column.isNotNull()
        out = F.when(ok, F.trim(column) if old.name in TEXTS else column).try_cast(new.spark)
        return out, column.isNotNull() & (out.isNull() | (F.isnan(out) | (F.abs(out) == float("inf")) if new.name not in BITS else F.lit(False)))
    if new.name == "BOOLEAN" and old.name in BITS:
        return column.cast("boolean"), column.isNotNull() & ~column.isin(0, 1)
    if new.name == "BOOLEAN" and old.name in TEXTS:
        return F.lower(column).isin("1", "true"), column.isNotNull() & ~F.lower(column).isin("1", "0", "true", "false")
    if new.name in TIMES and old.name in TIMES | TEXTS:
        out = column.try_cast(new.spark)
        return out, column.isNotNull() & out.isNull()
    if new.name == "UUID" and old.name in TEXTS:
        return F.lower(column), column.isNotNull() & ~F.lower(column).rlike(f"^{_UUID.pattern}$")
    if new.name == "JSON" and old.name in TEXTS:
        out = F.to_json(F.try_parse_json(column))
        return out, column.isNotNull() & out.isNull()
    return F.lit(None).cast(new.spark), column.isNotNull()
