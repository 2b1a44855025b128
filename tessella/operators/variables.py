"""SET and SHOW VARIABLES: typed settings with a global and, for some, a session value. Memory limits are accepted and shown; Spark spills instead."""

from __future__ import annotations

import re
from dataclasses import dataclass
from zoneinfo import available_timezones

from ..errors import EngineError


@dataclass(frozen=True)
class Variable:
    kind: str  # bytes, integer, boolean, enum, timezone
    default: object
    least: int = 0
    both: bool = False  # may be set for a session too
    dynamic: bool = True
    values: tuple[str, ...] = ()
    most: int | None = None
    description: str = ""


#: Names, types, defaults and limits.
VARIABLES = {
    "engine_buffer_pool_size": Variable("bytes", 67_108_864, description="Bytes for decoded rows; Spark's own memory is used."),
    "max_heap_table_size": Variable("bytes", 67_108_864, 1, True, description="Bytes that the rows of one INSERT may have."),
    "sort_buffer_size": Variable("bytes", 2_097_152, 1, True, description="Bytes for sorting; advisory."),
    "join_buffer_size": Variable("bytes", 2_097_152, 1, True, description="Bytes for joins; advisory."),
    "query_cache_size": Variable("bytes", 16_777_216, description="Bytes for results that are kept; 0 keeps none."),
    "tmp_table_size": Variable("bytes", 67_108_864, 1, True, description="Bytes for a temporary result; advisory."),
    "max_allowed_packet": Variable("bytes", 8_388_608, 1_024, True, most=16_777_216, description="Bytes of one statement."),
    "connect_timeout": Variable("integer", 10, 1, description="Seconds for a connection; advisory."),
    "wait_timeout": Variable("integer", 300, 1, True, description="Idle seconds of a session; advisory."),
    "interactive_timeout": Variable("integer", 300, 1, True, description="Idle seconds of an interactive session; advisory."),
    "max_connect_errors": Variable("integer", 100, 1, description="Errors before an address is blocked; advisory."),
    "skip_name_resolve": Variable("boolean", True, description="No reverse name look-ups."),
    "thread_cache_size": Variable("integer", 16, description="Sessions kept for reuse; advisory."),
    "thread_stack": Variable("bytes", 1_048_576, 1, dynamic=False, description="For compatibility."),
    "thread_handling": Variable("enum", "event-loop", dynamic=False, values=("event-loop",), description="For compatibility."),
    "system_time_zone": Variable("timezone", "UTC", description="Time zone of the engine's own output."),
}
_POWER = {"": 0, "K": 1, "M": 2, "G": 3, "T": 4}


def normalise(name: str, value: object) -> object:
    v = VARIABLES[name]

    def bad(why: str) -> EngineError:
        return EngineError("INVALID_SYSTEM_VARIABLE", f"{name}: {why}")

    if v.kind == "boolean":
        known = {"on": True, "true": True, "1": True, "off": False, "false": False, "0": False}
        if str(value).lower() not in known:
            raise bad("ON or OFF")
        return known[str(value).lower()]
    if v.kind == "enum":
        if str(value).lower() not in v.values:
            raise bad(f"one of {', '.join(v.values)}")
        return str(value).lower()
    if v.kind == "timezone":
        if str(value) not in available_timezones():
            raise bad("an unknown time zone")
        return str(value)
    m = None if isinstance(value, (bool, float)) else re.fullmatch(r"(\d+)\s*([KMGT]?)B?", str(value).strip(), re.I) if v.kind == "bytes" else re.fullmatch(r"(\d+)()", str(value))
    if m is None:
        raise bad("a whole number" + (", with K, M, G or T perhaps" if v.kind == "bytes" else ""))
    out = int(m[1]) * 1024 ** _POWER[m[2].upper()]
    if out < v.least or out >= 2**63 or (v.most is not None and out > v.most):
        raise bad(f"a number from {v.least}" + (f" to {v.most}" if v.most is not None else ""))
    return out


def shown(value: object) -> str:
    return ("ON" if value else "OFF") if isinstance(value, bool) else str(value)


class Settings:
    """Global values; sessions keep their own overrides."""

    def __init__(self) -> None:
        self.values = {n: v.default for n, v in VARIABLES.items()}

    def set(self, scope: str, name: str, value: object, own: dict[str, object]) -> object:
        v = VARIABLES.get(name)
        if v is None:
            raise EngineError("UNKNOWN_SYSTEM_VARIABLE", f"There is no variable {name}.")
        if scope == "GLOBAL":
            if not v.dynamic:
                raise EngineError("READ_ONLY_VARIABLE", f"{name} can't be changed.")
            self.values[name] = normalise(name, value)
            return self.values[name]
        if not v.both or not v.dynamic:
            raise EngineError("INVALID_VARIABLE_SCOPE", f"{name} is global.")
        own[name] = normalise(name, value)
        return own[name]

    def rows(self, scope: str, own: dict[str, object]) -> list[tuple[str, str, str, str, str]]:
        """variable_name, value, scope, dynamic, description, by name."""
        values = self.values | (own if scope != "GLOBAL" else {})
        return [(n, shown(values[n]), "BOTH" if v.both else "GLOBAL", "YES" if v.dynamic else "NO", v.description) for n, v in sorted(VARIABLES.items())]
