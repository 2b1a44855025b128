"""The syntax tree. Expressions and statements are plain data; they are lowered in ``lower`` and run in ``session``."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any


@dataclass(frozen=True)
class Lit:
    value: Any  # None, bool, int, float, str, bytes; a whole number beyond 64 bits stays text
    text: str = ""


@dataclass(frozen=True)
class Param:
    key: int | str


@dataclass(frozen=True)
class Now:
    pass


@dataclass(frozen=True)
class Uuid:
    pass


@dataclass(frozen=True)
class Default:
    pass


@dataclass(frozen=True)
class Col:
    name: str
    qualifier: str | None = None
    at: int = 0

    @property
    def text(self) -> str:
        return f"{self.qualifier}.{self.name}" if self.qualifier else self.name


@dataclass(frozen=True)
class Json:
    operand: Any
    path: Any


@dataclass(frozen=True)
class Subquery:
    select: Select


@dataclass(frozen=True)
class Logic:
    op: str  # and, or
    items: tuple


@dataclass(frozen=True)
class Not:
    item: Any


@dataclass(frozen=True)
class Compare:
    op: str
    left: Any
    right: Any


@dataclass(frozen=True)
class IsNull:
    item: Any
    negated: bool


@dataclass(frozen=True)
class In:
    item: Any
    values: tuple
    negated: bool


@dataclass(frozen=True)
class InQuery:
    item: Any
    select: Select
    negated: bool


@dataclass(frozen=True)
class Like:
    item: Any
    pattern: Any
    negated: bool


@dataclass(frozen=True)
class Exists:
    select: Select


@dataclass(frozen=True)
class Truth:
    """An operand that stands as a predicate."""

    item: Any


@dataclass(frozen=True)
class Agg:
    func: str
    arg: Col | None


@dataclass(frozen=True)
class Projection:
    expr: Any
    name: str


@dataclass(frozen=True)
class Source:
    table: tuple[str | None, str]
    alias: str
    join: str = "first"  # first, inner, left, right, cross
    on: Any = None


@dataclass(frozen=True)
class Select:
    projections: tuple  # empty: *
    sources: tuple[Source, ...]
    where: Any = None
    group: tuple[Col, ...] = ()
    having: Any = None
    order: tuple[tuple[str, bool], ...] = ()  # name, descending
    limit: Any = None
    offset: Any = None


@dataclass
class ColumnDef:
    name: str
    type: str
    length: int | None = None
    nullable: bool = True
    default: Any = None  # an expression node, or None for no default
    auto: bool = False


@dataclass
class IndexDef:
    name: str | None
    columns: list[str]
    unique: bool = False
    primary: bool = False
    ordered: bool = False


@dataclass
class Statement:
    """Anything but SELECT: ``kind`` and what that kind has."""

    kind: str
    args: dict = field(default_factory=dict)

    def __getattr__(self, name: str):
        try:
            return self.args[name]
        except KeyError:
            raise AttributeError(name) from None
