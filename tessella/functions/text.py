"""LIKE patterns and JSON paths."""

from __future__ import annotations

import re

from ..errors import EngineError

_STEP = re.compile(r"""\.([^\W\d]\w*|\d\w*)|\[(\d+)\]|\[\s*'([^']+)'\s*\]|\[\s*"([^"]+)"\s*\]""")


def like_pattern(pattern: str) -> str:
    """The pattern as Spark's LIKE reads it: a backslash escapes any character here, but only wildcards and itself there."""

    def one(m: re.Match) -> str:
        if m[1] is None:
            return "\\\\"  # a backslash at the end stands for itself
        return m[0] if m[1] in "%_\\" else m[1]

    return re.sub(r"\\(.)?", one, pattern, flags=re.S)


def json_path(path: object) -> str:
    """A path of keys and positions, normalised for get_json_object and variant paths; a bare ``$`` and wildcards are errors."""
    if not isinstance(path, str) or not path.startswith("$"):
        raise EngineError("SQL_SEMANTIC", "A JSON path is a text that starts with $.")
    at, out = 1, "$"
    while at < len(path):
        m = _STEP.match(path, at)
        if m is None:
            raise EngineError("SQL_SEMANTIC", f"The JSON path {path!r} is not valid from position {at}.")
        key = m[1] or m[3] or m[4]
        out += f"[{m[2]}]" if key is None else f"['{key}']"
        at = m.end()
    if out == "$":
        raise EngineError("SQL_SEMANTIC", "A JSON path needs a key or a position.")
    return out
