"""Predicates of :where clauses as Column expressions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import combinations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import TypeMismatchError

Builder = Callable[[list[Column]], Column]


def _chain(compare: Callable[[Column, Column], Column]) -> Builder:
    """``(< a b c)`` is a < b and b < c; one argument alone is true."""
    return lambda args: reduce(lambda x, y: x & y, [compare(a, b) for a, b in zip(args, args[1:], strict=False)], F.lit(True))


def _all_differ(args: list[Column]) -> Column:
    return reduce(lambda x, y: x & y, [a != b for a, b in combinations(args, 2)], F.lit(True))


OPERATORS: dict[str, Builder] = {
    "=": _chain(lambda a, b: a == b),
    "not=": lambda args: ~_chain(lambda a, b: a == b)(args),
    "<": _chain(lambda a, b: a < b),
    "<=": _chain(lambda a, b: a <= b),
    ">": _chain(lambda a, b: a > b),
    ">=": _chain(lambda a, b: a >= b),
    "distinct?": _all_differ,
    "includes?": lambda args: args[0].contains(args[1]),
}
_ALIASES = {"==": "=", "!=": "not=", "clojure.core/distinct?": "distinct?", "clojure.string/includes?": "includes?"}


def canonical(name: str) -> str:
    return _ALIASES.get(name, str(name))


def register_predicate(name: str, builder: Builder) -> None:
    """Make ``[(name ?x …)]`` usable; ``builder`` turns argument Columns into a boolean Column."""
    OPERATORS[name] = builder


def _family(kind: T.DataType) -> str:
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.DateType | T.TimestampType | T.TimestampNTZType):
        return "time"
    return "text" if isinstance(kind, T.StringType) else kind.typeName()


def predicate(op: str, args: list[tuple[Column, T.DataType | None]]) -> Column:
    """The condition; typed arguments of different families (null type: unknown) have no order, which is an error."""
    families = {_family(kind) for _, kind in args if kind is not None}
    if len(families) > 1:
        raise TypeMismatchError(f"({op} …) over {' and '.join(sorted(families))}")
    if op == "includes?" and (len(args) != 2 or families - {"text"}):
        raise TypeMismatchError("includes? takes two texts")
    return OPERATORS[op]([c for c, _ in args])
