import datetime as dt

import pytest

from tessella.errors import EngineError
from tessella.functions.types import SqlType, coerce

GOOD = [
    ("TINYINT", None, "-128", -128), ("TINYINT", None, 127, 127), ("INT", None, "+5", 5), ("BIGINT", None, 2**63 - 1, 2**63 - 1), ("FLOAT", None, 0.1, 0.10000000149011612), ("DOUBLE", None, "1e3", 1000.0),
    ("BOOLEAN", None, "TRUE", True), ("BOOLEAN", None, 0, False), ("VARCHAR", 3, "äöü", "äöü"), ("TEXT", None, "x" * 65535, "x" * 65535), ("BINARY", 4, b"ab", b"ab\0\0"), ("BLOB", None, b"", b""),
    ("TIMESTAMP", None, "2026-07-22T12:30:00+02:00", dt.datetime(2026, 7, 22, 10, 30, tzinfo=dt.UTC)), ("TIMESTAMP", None, 0, dt.datetime(1970, 1, 1, tzinfo=dt.UTC)), ("DATETIME", None, "2026-07-22 12:30:00.25", dt.datetime(2026, 7, 22, 12, 30, 0, 250000)),
    ("UUID", None, "6BA7B810-9DAD-11D1-80B4-00C04FD430C8", "6ba7b810-9dad-11d1-80b4-00c04fd430c8"), ("JSON", None, '{"b": [1, "ä/"], "a": null}', '{"b":[1,"ä/"],"a":null}'), ("JSON", None, {"x": {}}, '{"x":{}}'), ("INT", None, None, None),
]
BAD = [
    ("TINYINT", None, 128), ("TINYINT", None, 1.0), ("INT", None, True), ("INT", None, "1.5"), ("INT", None, " 1"), ("BIGINT", None, 2**63), ("FLOAT", None, 1e39), ("DOUBLE", None, float("nan")), ("DOUBLE", None, "1d"), ("DOUBLE", None, "inf"),
    ("BOOLEAN", None, "yes"), ("BOOLEAN", None, 2), ("VARCHAR", 3, "abcd"), ("VARCHAR", 3, 5), ("TEXT", None, "ä" * 40000), ("BINARY", 2, b"abc"), ("BLOB", None, 5), ("TIMESTAMP", None, "noon"), ("DATETIME", None, 5),
    ("UUID", None, "6ba7b810-9dad-91d1-80b4-00c04fd430c8"), ("JSON", None, "{"), ("JSON", None, "NaN"),
]


@pytest.mark.parametrize("name, length, value, want", GOOD)
def test_accepts(name, length, value, want):
    assert coerce(value, SqlType(name, length)) == want


@pytest.mark.parametrize("name, length, value", BAD)
def test_rejects(name, length, value):
    with pytest.raises(EngineError) as e:
        coerce(value, SqlType(name, length))
    assert e.value.code == "INVALID_VALUE"
