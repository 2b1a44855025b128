"""JSON lines about statements, through Python's logging: general, slow, error and audit. Literals are blotted out, so logs hold no data."""

from __future__ import annotations

import datetime as dt
import json
import logging
import logging.handlers
import os

from .errors import EngineError
from .plans.lexer import tokenize

LOGGER = logging.getLogger("tessella")
#: Milliseconds from which a statement counts as slow. A SELECT counts until its plan is made; it runs when its rows are read.
SLOW_MS = 1000
AUDITED = frozenset(["CREATE", "DROP", "ALTER", "GRANT", "REVOKE", "SET", "RENAME", "MOVE", "COPY", "TRUNCATE"])


def redacted(sql: str) -> str:
    """The statement with ? for each literal; only its length if it can't be read."""
    try:
        tokens = tokenize(sql)
    except EngineError:
        return f"({len(sql)} characters)"
    return " ".join("?" if t.kind in ("string", "number", "bytes") else f":{t.text}" if t.kind == "named" else f"`{t.text}`" if t.kind == "quoted" else t.text for t in tokens[:-1])


KINDS = ("general", "slow", "error", "audit")


def to_files(folder: str, max_bytes: int = 16 * 2**20, keep: int = 5) -> list[logging.Handler]:
    """Write each kind of line to a file of its own on the driver (``general.log`` and so on), which is renamed when it would grow beyond ``max_bytes``; ``keep`` old ones stay."""
    os.makedirs(folder, exist_ok=True)
    made = []
    for kind in KINDS:
        handler = logging.handlers.RotatingFileHandler(os.path.join(folder, f"{kind}.log"), maxBytes=max_bytes, backupCount=keep, encoding="utf-8")
        handler.addFilter(lambda record, kind=kind: getattr(record, "kind", None) == kind)
        LOGGER.addHandler(handler)
        made.append(handler)
    LOGGER.setLevel(min(LOGGER.level or logging.INFO, logging.INFO))
    return made


def write(kind: str, level: int = logging.INFO, **facts: object) -> None:
    if LOGGER.isEnabledFor(level):
        LOGGER.log(level, json.dumps({"time": dt.datetime.now(dt.UTC).isoformat(), "log": kind, **facts}, ensure_ascii=False, default=str), extra={"kind": kind})


def statement(user: str, database: str | None, sql: str, ms: float, error: EngineError | None = None) -> None:
    if not LOGGER.isEnabledFor(logging.INFO):
        return
    facts = {"user": user, "database": database, "sql": redacted(sql), "ms": round(ms, 1)}
    write("general", **facts)
    if error is not None:
        write("error", logging.ERROR, code=error.code, **facts)
    if ms >= SLOW_MS:
        write("slow", logging.WARNING, **facts)
    if facts["sql"].split(" ", 1)[0].upper() in AUDITED:
        write("audit", outcome=error.code if error else "ok", **facts)
