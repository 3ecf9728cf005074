"""A parsed query."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Var:
    """A variable; ``name`` has no question mark."""

    name: str


@dataclass(frozen=True)
class Blank:
    """``_``: anything, bound to nothing."""


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Attr:
    """A keyword in attribute position, without colon."""

    name: str


Term = Var | Blank | Const | Attr


@dataclass(frozen=True)
class Pattern:
    entity: Term
    attribute: Term
    value: Term

    def variables(self) -> set[str]:
        return {t.name for t in (self.entity, self.attribute, self.value) if isinstance(t, Var)}


@dataclass(frozen=True)
class Predicate:
    op: str
    args: tuple[Term, ...]


@dataclass(frozen=True)
class GetElse:
    """``[(get-else $ ?e :attr default) ?v]``, beyond the plain grammar."""

    entity: Var
    attribute: str
    default: object
    out: str


@dataclass(frozen=True)
class Not:
    clauses: tuple[Clause, ...]


@dataclass(frozen=True)
class Or:
    branches: tuple[tuple[Clause, ...], ...]


Clause = Pattern | Predicate | GetElse | Not | Or


@dataclass(frozen=True)
class Aggregate:
    fn: str
    var: str


@dataclass(frozen=True)
class Query:
    find: tuple[Var | Aggregate, ...]
    where: tuple[Clause, ...]
    inputs: tuple[str, ...] = ()
    with_vars: tuple[str, ...] = field(default=())

    @property
    def aggregates(self) -> list[Aggregate]:
        return [f for f in self.find if isinstance(f, Aggregate)]

    @property
    def plain(self) -> list[str]:
        return [f.name for f in self.find if isinstance(f, Var)]

    def columns(self) -> list[str]:
        """Output names in :find order: variables as they are, aggregates as fn_var."""
        names = [(f.name if isinstance(f, Var) else f"{f.fn.replace('-', '_')}_{f.var}").strip() for f in self.find]
        return [n if names.index(n) == i else f"{n}_{names[:i].count(n) + 1}" for i, n in enumerate(names)]
