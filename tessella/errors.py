"""One error class; ``code`` is stable, ``offset`` is the place in the statement where there is one."""

from __future__ import annotations


class EngineError(Exception):
    def __init__(self, code: str, message: str, offset: int | None = None) -> None:
        super().__init__(f"{code}: {message}" + (f" (at {offset})" if offset is not None else ""))
        self.code, self.message, self.offset = code, message, offset
